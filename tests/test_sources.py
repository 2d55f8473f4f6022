"""Readers, writers, page parsing and incremental loads."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from podium import schema
from podium.operators import loads
from podium.sources import files, pages
from podium.streaming import incremental

RESULT_PAGE = """<html><head><title>Results &amp; more</title></head><body><h1>Club <b>Cup</b></h1><!-- <td>no</td> -->
<table border=1><tr><td bgcolor="#008080"><b>Course</b></td><td>Bay&nbsp;One<td bgcolor='#008080'>Race Date<td>5/6/99</table>
<TABLE class="summarytable"><caption>Sailed: 4, Discards: 1</caption><tr class=titlerow><th>Rank<th>HelmName<th>Sail #<th>Nett
<tr><td>1st<td>Ann &amp; Bob<td>34142<td><table><tr><td>inner</td></tr></table>7.0</tr><tr><td>2nd<td>Cy</table>
<table class="racetable"><tr><th>Pos</th><th>Boat</th><th>Elapsed</th></tr></table></body></html>"""


def test_table_rows(spark):
    df = spark.createDataFrame([(7, RESULT_PAGE), (8, None), (9, "<p>no tables")], "page_id long, html string")
    rows = [r.asDict() for r in pages.table_rows(df).collect()]
    by_kind = {}
    for r in rows:
        by_kind.setdefault((r["table_no"], r["kind"]), []).append(r["cells"])
    assert by_kind == {(0, "other"): [["Course", "Bay One", "Race Date", "5/6/99"]], (1, "summary"): [["1st", "Ann & Bob", "34142", "7.0"], ["2nd", "Cy"]],
                       (2, "other"): [["inner"]]}
    summary = pages.table_rows(df).where("kind = 'summary'")
    named = pages.named_cells(summary, ["rank", "boat", "sail_number", "nett"]).orderBy("row_no")
    assert [tuple(r) for r in named.select("rank", "boat", "sail_number", "nett").collect()] == [("1st", "Ann & Bob", "34142", "7.0"), ("2nd", "Cy", None, None)]
    assert summary.select(pages.participant_type("header").alias("p"), "caption").first() == ("helm", "Sailed: 4, Discards: 1")
    labels = pages.labelled_values(pages.table_rows(df)).collect()
    assert {r["label"]: r["value"] for r in labels} == {"course": "Bay One", "race date": "5/6/99"}


def test_fixed_layout(spark):
    cells = [["Mojo", "34142", "J/29", "100", "5/6/99", "19:00", "", "1:00:00", "0:55:00", "1", "0.75"], ["Echo", "1", "x", "9"], ["", "2", "y", "8"], ["Gone", "1", "x", "9", "", "DNF"]]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "row_no int, cells array<string>")
    got = pages.positional_cells(rows).orderBy("row_no").select("boat_name", "position", "points", "series_points", "status").collect()
    assert [tuple(r) for r in got] == [("Mojo", 1, 0.75, None, None), ("Echo", None, None, None, None), ("Gone", None, None, None, "DNF")]


def test_page_classes(spark):
    long = "word " * 20
    cases = {
        "xxxxxxx.htm": ("<body>" + long, "template"),
        "short.htm": ("<body>tiny</body>", "template"),
        "both.htm": (f"<body>{long}<table class='summarytable'></table><table class=racetable>", "sailwave-mixed"),
        "sum.htm": (f"<body>{long}<table id=1 class=\"summarytable\">", "sailwave-summary"),
        "race.htm": (f"<body>{long}<table class='racetable'>", "sailwave-race"),
        "entry.htm": (f"<body>Entry {long} list</body>", "entry-list"),
        "titled.htm": (f"<title>Sailwave results for x</title><body>{long}</body>", "sailwave-summary"),
        "other.htm": (f"<body>{long}</body>", "non-result-html"),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "path string, html string")
    got = {r["path"]: r["c"] for r in df.select("path", pages.page_class("html", "path").alias("c")).collect()}
    assert got == {k: v[1] for k, v in cases.items()}


def test_links(spark):
    hrefs = ["a.htm", "mailto:x@y", "#top", "http://other.org/x", "http://me.org/x", "../../up.htm", "http://else.org/?at=me.org", "http://www.ME.org/y", "../racing2001/x.htm", "/racing/a.pdf?q#f", "/else/b", ""]
    df = spark.createDataFrame([(h,) for h in hrefs], "href string")
    kept = df.where(pages.internal_link(F.col("href"), F.lit("me.org"), "/racing/")).select(pages.link_target(F.col("href")).alias("t"))
    assert [r["t"] for r in kept.collect()] == ["a.htm", "http://me.org/x", "http://www.ME.org/y", "/racing/a.pdf"]


def test_links_of_other_years(spark):
    urls = ["http://me.org/racing/racing2014/a/x.htm?y", "http://me.org/b.htm"]
    df = spark.createDataFrame([(u, h) for u in urls for h in ("/racing/racing2014/z.htm", "/racing/racing2015/z.htm")], "url string, href string")
    rows = df.select(pages.section_of("url"), pages.internal_link(F.col("href"), pages.host_of("url"), pages.section_of("url"))).collect()
    assert [tuple(r) for r in rows] == [("/racing/racing2014/", True), ("/racing/racing2014/", False), ("/", True), ("/", True)]


def test_certificate_lines(spark):
    texts = ["Name Blue Moon Sail Nr CAN-1 GPH: 600.5", "Name Blue\nMoon Sail Nr CAN-2\n601.5\nGPH", "Class J 24\nfleet  Designer A"]
    df = spark.createDataFrame([(s,) for s in texts], "s string").select(*pages.named_fields("s"))
    assert [(r["name"], r["sail_no"], r["boat_class"], r["gph"]) for r in df.collect()] == [
        ("Blue Moon", "CAN-1", None, 600.5), (None, "CAN-2", None, 601.5), (None, None, "J 24 fleet", None)
    ]


def test_headings(spark):
    df = spark.createDataFrame([(RESULT_PAGE,)], "html string")
    row = df.select(*[pages.element_text("html", t).alias(t) for t in ("title", "h1", "h2")]).first()
    assert tuple(row) == ("Results & more", "Club Cup", None)


def test_scan_pages(spark, tmp_path):
    folder = tmp_path / "racing2001" / "old"
    folder.mkdir(parents=True)
    (folder / "june.htm").write_text("<p>1")
    (folder / "index.htm").write_text("<p>2")
    (folder / "note.txt").write_text("x")
    (tmp_path / "racing2001" / "july.html").write_text("<p>3")
    got = {r["name"]: (r["year"], r["html"]) for r in files.scan_pages(spark, [str(tmp_path)]).collect()}
    assert got == {"june.htm": (2001, "<p>1"), "july.html": (2001, "<p>3")}


def parsed_page():
    scores = [{"race_key": "r1", "race_date": "2001-06-05", "raw_text": "1.0", "points": 1.0, "status": None, "is_discarded": False},
              {"race_key": "r2", "race_date": "2001-06-12", "raw_text": "(5.0 DNC)", "points": 5.0, "status": "DNC", "is_discarded": True}]
    return {
        "source_path": "racing2001/june_tns.htm", "year": 2001, "title": "t", "h1": "Club", "h2": "June TNS",
        "summaries": [{"scope": "overall", "metadata": {"sailed": "2", "discards": "1"}, "race_columns": [{"index": 5, "race_key": "r1", "date": "2001-06-05"}],
                       "rows": [{"rank": None, "boat": "Mojo", "sail_number": "#34142", "nett": "1.0", "total": "6.0", "scores": scores}]}],
        "races": [{"race_key": "r1", "date": None, "caption": "Time: 18:36:00", "rows": [
            {"rank": "1st", "boat": None, "sail_number": "34142", "boat_class": "J29", "elapsed_time": "1:00:00", "points": "1.0", "status": ""}]}],
    }


def test_one_page_end_to_end(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text(json.dumps(parsed_page()) + "\n")
    df = files.read_json_lines(spark, str(tmp_path / "p.jsonl"), schema.PARSED_PAGE)
    assert [tuple(r)[:7] for r in loads.page_events(df).collect()] == [("racing2001/june_tns.htm", 2001, "Club - June TNS", 2, 1, "tns", "june")]
    assert [tuple(r)[1:] for r in loads.page_races(df).collect()] == [("r1", "2001-06-05", "18:36:00")]
    result = loads.page_results(df).first()
    assert (result["participant"], result["class"], result["rank"], result["elapsed_s"], result["status"]) == ("Sail 34142", "J/29", 1, 3600, None)
    assert [tuple(r)[2:] for r in loads.page_standings(df).collect()] == [("Mojo", 1, 6.0, 1.0)]
    assert loads.page_scores(df).where("is_discarded").count() == 1 and loads.page_scores(df).count() == 2


def test_legacy_page(spark, tmp_path):
    page = {"source_path": "x", "metadata": {"race_number": 2, "race_date": "5/6/99"},
            "results": [{"boat_name": "", "sail_number": "7", "points": 0.75, "elapsed_time": "00 01:00:00"}, {"boat_name": "Mojo", "status": "DNF"}]}
    (tmp_path / "p.jsonl").write_text(json.dumps(page) + "\n")
    rows = loads.legacy_results(files.read_json_lines(spark, str(tmp_path / "p.jsonl"), schema.LEGACY_PAGE)).collect()
    assert [(r["race_no"], r["participant"], r["rank"], r["elapsed_s"], r["status"]) for r in rows] == [(2, "Sail 7", 1, 3600, None), (2, "Mojo", None, None, "DNF")]


def test_certificates(spark, tmp_path):
    doc = {"orc_ref": "C1", "boat_class": "J/29", "gph": 600.5, "scoring": {"coastal": {"tot": 1.01}, "coastal_triple": {"medium": {"tot": 0.9, "tod": 500}}}}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    row = files.read_certificates(spark, str(tmp_path)).first()
    assert (row["cert_ref"], row["coastal_tot"], row["coastal_med_tot"], row["coastal_low_tot"], row["wl_tod"]) == ("C1", 1.01, 0.9, None, None)


def test_csv_and_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("Mojo", 'a "b", c', 2001)], "boat_name string, notes string, year_start int")
    files.write_csv(df, str(tmp_path / "csv"), ["year_start", "boat_name", "notes"])
    back = files.read_csv(spark, str(tmp_path / "csv"), "year_start int, boat_name string, notes string")
    assert back.columns == ["year_start", "boat_name", "notes"] and back.first()["year_start"] == 2001
    files.write_json_lines(df, str(tmp_path / "json"))
    assert files.read_json_lines(spark, str(tmp_path / "json"), "boat_name string, notes string").first()["notes"] == 'a "b", c'


def test_documents_replace_only_their_keys(spark, tmp_path):
    path = str(tmp_path / "docs")
    files.write_documents(spark.createDataFrame([(2001, "a"), (2002, "b")], "period int, body string"), path, "period", files=2)
    files.write_documents(spark.createDataFrame([(2002, "c")], "period int, body string"), path, "period")
    assert {(r["period"], r["body"]) for r in spark.read.json(path).collect()} == {(2001, "a"), (2002, "c")}


def test_mart_selection(spark, tmp_path):
    builders = {"a": lambda: spark.range(2), "b": lambda: spark.range(3)}
    assert files.build_marts(builders, str(tmp_path / "m"), ["b"]) == ["b"]
    assert spark.read.json(str(tmp_path / "m/b")).count() == 3
    assert files.build_marts(builders, str(tmp_path / "n")) == ["a", "b"]
    with pytest.raises(ValueError, match="unknown marts: c"):
        files.build_marts(builders, str(tmp_path / "o"), ["a", "c"])


def test_reload_is_idempotent(spark, tmp_path):
    for _ in range(2):
        files.replace_table(spark.range(5), str(tmp_path / "t"))
    assert files.read_table(spark, str(tmp_path / "t")).count() == 5


def test_incremental_loads(spark, tmp_path):
    inbox, target, state = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "s")
    inbox.mkdir()
    ddl = "day string, speed int"

    def load(name, rows):
        (inbox / name).write_text("\n".join(json.dumps(r) for r in rows))
        incremental.load_batches(incremental.read_new_files(spark, str(inbox), ddl), target, state).awaitTermination()
        return {r["day"]: r["speed"] for r in incremental.current(spark, target, ["day"], [F.col("speed")]).collect()}

    assert load("1.json", [{"day": "a", "speed": 9}, {"day": "b", "speed": 2}]) == {"a": 9, "b": 2}
    assert load("2.json", [{"day": "a", "speed": 5}]) == {"a": 5, "b": 2}
    assert spark.read.parquet(target).count() == 3


def test_page_class_works_out_each_text_once(spark):
    df = spark.createDataFrame([("a.htm", 2000, "<!-- Points --><table><tr><td>Elapsed</td></tr></table>"), ("b.htm", 2000, "<p>Schedule</p>"), ("c.htm", 2000, None)],
                               "path string, year int, html string")
    got = df.select("path", pages.page_class("html", "path", "year").alias("c"))
    plan = got._jdf.queryExecution().analyzed().toString()
    assert plan.count("(?s)<!--.*?-->,") == 1  # comments are removed for all rules together
    assert plan.count("(?is)(<table") == 1  # the words of all tables are looked for in one text
    assert {r["path"]: r["c"] for r in got.collect()} == {"a.htm": "legacy-result", "b.htm": "non-result-html", "c.htm": "unknown"}


def test_packed_files_read_the_same(spark, tmp_path):
    df = spark.createDataFrame([(k, 2000 + k % 2, "text " * 50) for k in range(40)], "id long, period int, body string")
    ddl = "id long, period int, body string"
    lines, docs = str(tmp_path / "lines"), str(tmp_path / "docs")
    files.write_json_lines(df, lines, packed=True)
    files.append_lines(df.where("id < 2").selectExpr("'{' AS value"), lines, packed=True)
    files.write_documents(df, docs, "period", files=2, packed=True)
    files.write_documents(df.where("period = 2001 AND id < 9"), docs, "period", packed=True)
    back = files.read_json_lines(spark, lines, ddl, corrupt=True)
    rows = back.collect()
    assert sorted(r["id"] for r in rows if r["corrupt_record"] is None) == list(range(40))
    assert [r["corrupt_record"] for r in rows if r["corrupt_record"] is not None] == ["{", "{"]
    assert sorted(r["id"] for r in files.read_documents(spark, docs, ddl).collect()) == sorted([*range(0, 40, 2), 1, 3, 5, 7])
    written = [p for p in tmp_path.rglob("part-*")]
    assert written and all(p.suffix == ".gz" for p in written)
