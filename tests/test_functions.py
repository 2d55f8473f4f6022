"""Golden values of the scalar functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from podium.functions import identifiers as idn
from podium.functions import scoring, text, times
from podium.operators import events as ev
from podium.operators import history as hi
from podium.sources import files, pages


def lit(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize(
    "path, stem",
    [("june_tns_overall.htm", "june_tns"), ("glube_series.htm", "glube"), ("june_tns_seriesab.htm", "june_tns"),
     ("glube2.htm", "glube2"), (None, ""), ("all.htm", ""), ("x/Cup-Day_ab_overall.html", "cup_day"), ("ball.htm", "ball")],
)
def test_canonical_stem(one, path, stem):
    assert one(text.canonical_stem(lit(path))) == stem


@pytest.mark.parametrize("path, stem", [("glube2.htm", "glube"), ("fall12.htm", "fall"), ("a/fall_1_2.htm", "fall_1")])
def test_stem_without_number(one, path, stem):
    assert one(text.stem_without_number(lit(path))) == stem


@pytest.mark.parametrize("a, b", [("Boland's Cup", "Bolands Cup"), ("A & B", "A and B"), ("Sly\n Fox", "sly fox")])
def test_name_key_agrees(one, a, b):
    assert one(text.name_key(lit(a))) == one(text.name_key(lit(b))) != ""


@pytest.mark.parametrize(
    "name, canonical", [("June TNS A&B", "June TNS"), ("Race Summary", "Race"), ("Cup A & B & S", "Cup"), ("Ball Cup", "Ball Cup")]
)
def test_canonical_name(one, name, canonical):
    assert one(text.canonical_name(lit(name))) == canonical


def test_event_name(one):
    def name(h1, h2, title="", path="x/y.htm"):
        return one(text.event_name(lit(h1), lit(h2), lit(title), lit(path)))

    assert name("Club", "Club Cup") == "Club Cup"
    assert name("Club ??", "Cup") == "Club - Cup"
    assert name(None, None, "Sailwave results for Big Cup") == "Big Cup"
    assert name(None, None, None, "a/b/race_one.htm") == "race_one"


@pytest.mark.parametrize(
    "raw, seconds", [("3:29:58", 12598), ("00 04:46:32", 17192), ("45:30", 2730), ("DNF", None), (None, None), ("1:2:3:4", None)]
)
def test_duration(one, raw, seconds):
    assert one(times.duration_s(lit(raw))) == seconds


def test_clock(one):
    assert one(times.clock(F.lit(3661))) == "1:01:01"
    assert one(times.clock(F.lit(3661.6))) == "1:01:01"
    assert one(times.clock(F.lit(3661.6), rounded=True)) == "1:01:02"


@pytest.mark.parametrize(
    "raw, year, iso",
    [("5/6/99", 1999, "1999-06-05"), ("5/6/1999", 1999, "1999-06-05"), ("05-06-03", 2003, "2003-06-05"),
     ("03-06-05", 2003, "2003-06-05"), ("12/25/2004", 2004, "2004-12-25"), ("5/6/2020", 2003, "2003-06-05"),
     ("29/2/2020", 2003, "2020-02-29"), ("2/29/2020", 2003, None), ("Pos", 2003, None), ("", 2003, None),
     ("31/2/2003", 2003, None), ("5/6/98", None, "1998-06-05")],
)
def test_mixed_dates(one, raw, year, iso):
    assert one(times.iso_date(lit(raw), F.lit(year).cast("int"))) == iso


def test_month_names(one):
    assert one(times.month_name(lit("x_FALL.htm"))) == "september"
    assert one(times.month_name(lit("sept_2.htm"))) == "september"
    assert one(times.month_name(lit("series"), footer=lit("Thursday, Jun 1 2000"))) == "june"
    assert one(times.month_name(lit("series"), date=F.lit("2001-08-09").cast("date"))) == "august"
    assert one(times.month_number(lit("June"))) == 6 and one(times.month_number(lit("x"))) == 99


def test_identifiers(one):
    assert one(idn.identifier(lit(" #can 12 "))) == "CAN12"
    assert one(idn.identifier(lit("  "))) is None
    for dummy in ("???", "XX", "X1X", "0", "1111111", None, "12?"):
        assert one(idn.is_placeholder(lit(dummy)))
    assert not one(idn.is_placeholder(lit("34142")))
    assert one(idn.is_strong(lit("34142"))) and not one(idn.is_strong(lit("142"))) and not one(idn.is_strong(lit("ABCD")))
    assert one(idn.related(lit("34142"), lit("34143"))) and one(idn.related(lit("341"), lit("34142")))
    assert not one(idn.related(lit("34142"), lit("34255"))) and not one(idn.related(lit("34142"), lit(None)))


@pytest.mark.parametrize(
    "raw, name", [("J29", "J/29"), ("j/ 29", "J/ 29"), ("J/29 ib", "J/29 I/B"), ("J/29 O/B", "J/29 O/B"), ("C & C 30", "C&C 30"),
                  ("Far 30 ??", "Farr 30"), ("e22", "Etchells"), ("a3/15", "A3/15"), ("Sonar", "Sonar"), ("??", None), (None, None)]
)
def test_design_class(one, raw, name):
    assert one(idn.design_class(lit(raw))) == name


def test_person_keys(one):
    assert one(text.person_key(lit("Bob  Smith"))) == one(text.person_key(lit("robert SMITH"))) == "robert smith"
    assert one(text.person_name(lit("BOB SMITH"))) == "Bob Smith"
    assert one(text.person_name(lit(". Ann McKay"))) == "Ann McKay"
    assert one(idn.type_key(lit("J 29 FR IB"))) == one(idn.type_key(lit("J/29"))) == "j29"
    assert one(idn.type_key(lit("Beneteau First 44.7"))) == "beneteau"


def test_scoring(one):
    assert one(scoring.time_on_time(F.lit(3600), F.lit(0.85))) == 3060
    assert one(scoring.time_on_distance(F.lit(3600), F.lit(10), F.lit(60))) == 3000
    assert [one(scoring.wind_band(F.lit(k).cast("double"))) for k in (9.0, 9.1, 14.0, None)] == ["low", "medium", "high", "medium"]
    assert one(scoring.compass(F.lit(350))) == "N" and one(scoring.compass(F.lit(180))) == "S"
    assert one(scoring.condition(F.lit(61))) == "Light rain" and one(scoring.condition(F.lit(7))) == "Code 7"
    assert one(scoring.rate3(F.lit(2), F.lit(3))) == 0.667 and one(scoring.rate3(F.lit(0), F.lit(0))) == 0.0


def test_score_cells(one):
    got = one(pages.score_cell(lit("(5.0 DNC)")))
    assert got == {"points": 5.0, "status": "DNC", "is_discarded": True}
    assert one(pages.score_cell(lit("1.0"))) == {"points": 1.0, "status": None, "is_discarded": False}
    assert one(pages.score_cell(lit("dnf"))) == {"points": None, "status": "DNF", "is_discarded": False}
    assert one(pages.score_cell(lit(" "))) == {"points": None, "status": None, "is_discarded": False}


def test_captions_and_scopes(one):
    assert one(pages.caption_metadata(lit("Sailed: 4, Discards: 1, To count: 3, x"))) == {
        "sailed": "4", "discards": "1", "to_count": "3"}
    for title, scope in [("A Fleet", "a_fleet"), ("fleet b", "b_fleet"), ("Sonar", "s_fleet"), (None, "summary"), ("X & Y", "x_y")]:
        assert one(pages.scope_key(lit(title), lit("summary"))) == scope


@pytest.mark.parametrize(
    "entry, name, kind", [("Poohsticks J 92", "Poohsticks", "J 92"), ("Big Boat Farr 40 OD", "Big Boat", "Farr 40 OD"),
                          ("Nobody", "Nobody", ""), ("Old Lady Sonar", "Old Lady", "Sonar")]
)
def test_name_and_type(one, entry, name, kind):
    assert one(pages.split_name_and_type(lit(entry))) == {"name": name, "type": kind}


def test_fixed_courses(one):
    assert one(hi.fixed_course(lit("R.G.Smith (Tancook Race)")))["distance_nm"] == 22.2
    assert one(hi.fixed_course(lit("R. G. Smith Cup")))["distance_nm"] == 22.2
    assert one(hi.fixed_course(lit("Handicap - Glube Cup"))) is None


def test_event_types(one):
    assert one(ev.event_type(lit("Glube Series"))) == "tns"
    assert one(ev.event_type(lit("Canadian Nationals"), lit("x.htm"))) == "championship"
    assert one(ev.event_type(lit("Commodore Cup"))) == "trophy"


def test_paths(one):
    assert one(files.year_of_path(lit("racing1999/old/racing2003/x.htm"))) == 2003
    assert one(files.year_of_path(lit("x.htm"))) is None
    assert [one(files.file_type(lit(p))) for p in ("a.HTM", "a.pdf", "b.JPG", "c.doc", "d")] == ["html", "pdf", "image", "doc", "other"]
    assert one(pages.page_role(lit("a/june_ab.htm"))) == "variant" and one(pages.page_role(lit("june.htm"))) == "canonical"
    assert one(files.skipped_name(lit("a/Index.htm")))


def test_labels(one):
    labels = {"Bolands": "Boland's Cup", "RG Smith": "Smith Cup"}
    assert one(text.map_label(lit("CLUB - R.G. Smith"), labels)) == "Smith Cup"
    assert one(text.map_label(lit("CLUB - Other"), labels)) == "Other"
