"""Page and table extraction (H01-H17, S01, S02, S14, S15, C09), on one site of given and written pages."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from podium.functions import identifiers as idn
from podium.functions import text as tx
from podium.functions import times
from podium.operators import loads
from podium.operators.measures import count_if
from podium.plans import dialect as q
from podium.plans.registry import query
from podium.sources import files, pages
from podium.sources import result_pages as result

C = F.col
N = q.n()


def _plain(x: str) -> str:
    out = f"regexp_replace({x}, '(?s)<!--.*?-->|<[^>]*>', ' ', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{a}', '{b}')"
    return q.collapse(out)


def _element(tag: str) -> str:
    return f"nullif({_plain(f'''regexp_extract(html, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}>', 1)''')}, '')"


@query("H04_headings", f"SELECT page_id, {_element('title')} AS title, {_element('h1')} AS h1, {_element('h2')} AS h2 FROM pages")
def _(t):
    return t.pages.select("page_id", *[pages.element_text("html", tag).alias(tag) for tag in ("title", "h1", "h2")])


@query(
    "H02_page_role",
    f"""SELECT CASE WHEN regexp_matches(source_file, '_overall\\.htm|_ab\\.htm|_all\\.htm|-overall\\.htm') THEN 'variant' ELSE 'canonical' END AS role, {N} AS series
    FROM series GROUP BY 1""",
)
def _(t):
    return t.series.groupBy(pages.page_role("source_file").alias("role")).agg(F.count("*").alias("series"))


SUFFIX = """series_id, source_file || CASE series_id % 6 WHEN 0 THEN '' WHEN 1 THEN '.PDF' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.docx' WHEN 4 THEN '.xls'
    ELSE 'l' END AS path"""


@query(
    "H03_file_type",
    f"""SELECT CASE series_id % 6 WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' WHEN 2 THEN 'image' WHEN 3 THEN 'doc' WHEN 4 THEN 'other' ELSE 'html' END AS file_type,
        {N} AS series FROM series GROUP BY 1""",
)
def _(t):
    return (
        t.series.selectExpr("series_id", SUFFIX.split(", ", 1)[1])
        .groupBy(files.file_type("path").alias("file_type"))
        .agg(F.count("*").alias("series"))
    )


@query(
    "H05_internal_links",
    """WITH l AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host,
        coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+(/(?:[^?#]*/)?[a-zA-Z]*(?:19|20)\\d{2}/)', 1), ''), '/') AS root, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href FROM pages)
    SELECT page_id, regexp_replace(href, '[?#].*$', '') AS target, CAST(count(*) AS BIGINT) AS links FROM l WHERE href <> '' AND href NOT LIKE 'mailto:%'
        AND href NOT LIKE '#%' AND NOT (regexp_matches(href, '^[a-zA-Z]+://') AND lower(regexp_extract(href, '^[a-zA-Z]+://([^/:?#]+)', 1)) <> host
            AND NOT ends_with(lower(regexp_extract(href, '^[a-zA-Z]+://([^/:?#]+)', 1)), '.' || host)) AND href NOT LIKE '../../%'
        AND NOT regexp_matches(href, '^\\.\\./racing\\d{4}/') AND NOT (href LIKE '/%' AND NOT starts_with(href, root)) GROUP BY 1, 2""",
)
def _(t):
    found = t.pages.select("page_id", pages.host_of("url").alias("host"), pages.section_of("url").alias("root"), F.explode(pages.links("html")).alias("href"))
    kept = found.where(pages.internal_link(C("href"), "host", C("root")))
    return kept.groupBy("page_id", pages.link_target(C("href")).alias("target")).agg(F.count("*").alias("links"))


@query(
    "S01_page_scan",
    f"""SELECT page_id, url, CAST(length(html) AS INTEGER) AS size FROM pages WHERE NOT regexp_matches(lower(regexp_extract(url, '[^/]*$')), '^(xxxxxxx|index|matrix|.*instruction)')""",
)
def _(t):
    return t.pages.where(~files.skipped_name("url")).select("page_id", "url", F.length("html").alias("size"))


YEAR_PATH = "'site/racing' || CAST(2000 + series_id % 20 AS STRING) || CASE WHEN series_id % 3 = 0 THEN '/racing1999/' WHEN series_id % 3 = 1 THEN '/' ELSE 'x/' END || source_file AS path"


@query(
    "S02_year_of_path",
    f"SELECT CAST(CASE WHEN series_id % 3 = 0 THEN 1999 ELSE 2000 + series_id % 20 END AS INTEGER) AS year, {N} AS series FROM series GROUP BY 1",
)
def _(t):
    return t.series.selectExpr(YEAR_PATH).groupBy(files.year_of_path("path").alias("year")).agg(F.count("*").alias("series"))


@query("S15_checksum", f"SELECT sha256(text) AS checksum, {N} AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy(files.checksum("text").alias("checksum")).agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first_id")
    )


# --- the site: given pages, and result pages of four layouts --------------------------------------------------------

ROWS_PER_PAGE = 400
SCORE = "CASE WHEN status IN ('DNC', 'DNS') THEN '(' || CAST(points AS STRING) || '.0 ' || status || ')' WHEN status = 'DNF' THEN 'DNF' ELSE CAST(points AS STRING) || '.5' END"
# how a layout writes a row, by contest_id % 4: marked by classes, striped, unmarked, of fixed columns
CELLS = {
    "rank": "CASE WHEN rank <> 2 THEN CAST(rank AS STRING) || 'th' ELSE '' END",
    "name": "CASE WHEN entity_id % 5 > 0 THEN 'Boat ' || CAST(entity_id AS STRING) || '&nbsp;' ELSE ' ' END",
    "sail": "'# ' || CAST(boat_id AS STRING)",
    "class": "CASE boat_id % 3 WHEN 0 THEN 'J29' WHEN 1 THEN 'A1/2' ELSE '' END",
    "elapsed": "CAST(CAST(floor(elapsed_s / 60) AS BIGINT) AS STRING) || ':' || lpad(CAST(elapsed_s % 60 AS STRING), 2, '0')",
}
LAYOUT = "contest_id % 4"
SUMMARY_TR = f"""CASE {LAYOUT} WHEN 0 THEN '<tr class="odd summaryrow"><td>' WHEN 1 THEN '<tr class="even"><td>' ELSE '<tr class=odd><td>' END || {CELLS['rank']} || '</td><td>'
    || {CELLS['name']} || '</td><td>' || {CELLS['sail']} || '</td><td>' || {SCORE} || '</td><td>' || CAST(points AS STRING) || '</td><td><b>' || CAST(points AS STRING) || '</b></td></tr>'"""
RACE_TR = f"""CASE {LAYOUT} WHEN 0 THEN '<tr class="even racerow"><td>' WHEN 1 THEN '<TR class="odd"><td>' ELSE '<tr><td>' END || {CELLS['rank']} || '<td>' || {CELLS['name']} || '<td>'
    || {CELLS['sail']} || '<td><i>' || {CELLS['class']} || '</i><td>' || CAST(rating AS STRING) || '</td><td>' || {CELLS['elapsed']} || '</td><td>' || {SCORE} || '</td></tr>'"""
FIXED_TR = f"""'<tr><td bgcolor="#FFFFFF" height="24"><font>' || {CELLS['name']} || '</font></td><td>' || CAST(boat_id AS STRING) || '</td><td>' || {CELLS['class']} || '</td><td>' || CAST(rating AS STRING)
    || '</td><td>05/06/99</td><td>' || CASE WHEN status <> '' THEN status ELSE '19:05:10' END || '</td><td></td><td>' || {CELLS['elapsed']} || '</td><td>0:50:00</td>' || CASE WHEN rank % 7 <> 0 THEN '<td>'
    || CAST(rank AS STRING) || '</td><td>' || CAST(points AS STRING) || '.75</td><td>1</td><td>' || CAST(points * 2 AS STRING) || '</td><td>' || CAST(rank AS STRING) || '</td>' ELSE '' END || '</tr>'"""
# what stands around the rows; NAME, DAY and RACE are filled in
HEADS = {
    0: (
        """<html><head><title>Sailwave results for NAME</title></head><body><h1>Club</h1><h2>NAME</h2><h3 class="seriestitle">Results are final</h3>
        <h3 class="summarytitle" id="summaryoverall">Overall</h3><div class="caption summarycaption">Sailed: 4, Discards: 1, Entries: 9, Rating system: PHRF</div><table class="summarytable">
        <colgroup><col class="rank"/><col class="boat"></colgroup><tr class="titlerow"><th>Rank</th><th>Boat</th><th>SailNo</th><th><a class="racelink" href="#rRACE">DAY</a></th><th>Total</th><th>Nett</th></tr>""",
        """</table><h3 class="racetitle" id="rRACE">DAY - 28</h3><div class="caption racecaption">Start: Start 1, Time: 18:36:00</div><table class="racetable"><tr class="titlerow"><th>Rank</th><th>Boat</th>
        <th>SailNo</th><th>Class</th><th>PHRF</th><th>Elapsed</th><th>Points</th></tr>""",
    ),
    1: (
        """<html><body><!-- <table class="racetable"> --><h2>NAME</h2><h3 id="summarya">A Fleet</h3><div class="caption">Sailed: 0, Discards: 1</div><TABLE border=1><colgroup><col class="rank"><col class="boat">
        <col class="nett"></colgroup><tr><th>Rank<th>Boat Name<th>Sail Number<th><a class='racelink' href='#rRACE'>DAY</a><th>Total<th>Nett</tr>""",
        """</TABLE><h3 id="rRACE">Race</h3><div class="caption">Time: 18:36:00</div><table><colgroup><col class="rank"><col class="raceelapsed"></colgroup><tr><th>Rank<th>Yacht<th>Sail #<th>Type<th>Rating<th>Elapsed<th>Pts</tr>""",
    ),
    2: (
        """<html><head><title>NAME</title></head><body><table class="main"><tr><td>Results by <a href="x.htm">club</a></td></tr></table><div class="caption">Sailed: 4</div><table class="main"><tr><th>Pos</th><th>HelmName</th>
        <th>Sail No</th><th><b><a class="racelink" href="">DAY</a></b></th><th>Total</th><th>Net</th></tr>""",
        """</table><p class="race">Race RACE</p><p class="raceanno">held 5/Jun/1999, light wind</p><table class="main"><tr><th>Pos</th><th>Name</th><th>Sail No</th><th>Model</th><th>Handicap</th><th>Elapsed</th><th>Points</th></tr>""",
    ),
    3: (
        """<html><head><meta name="GENERATOR" content="WinRegatta 3"><title>NAME</title></head><body><table><tr><td bgcolor="#0000FF" colspan="4"><b>NAME</b></td></tr><tr><td bgcolor="#008080"><strong>Class</strong></td><td>All</td>
        <td bgcolor=#008080>Course</td><td>Bay&nbsp;One</td></tr><tr><td bgcolor="#008080">Race Date</td><td>DAY</td><td bgcolor="#008080">Wind Speed</td><td>12</td></tr><tr><td bgcolor="#008080">Race</td><td>3 of 9</td></tr></table>
        <table><tr><td bgcolor="#FF0000">Name</td><td bgcolor="#FF0000">Sail</td></tr>""",
        """<tr><td bgcolor="#C0C0C0" colspan="4">NAME</td><td bgcolor="#C0C0C0" colspan="5">Race 3</td><td bgcolor="#C0C0C0">Thursday, Jun 1 2000</td></tr></table>""",
    ),
}


ENTRY = ("rank", "entity_id", "boat_id", "points", "status", "rating", "elapsed_s")


def _rows(tr):
    """The rows of a page, put together from its entries."""
    of_entry = re.sub(rf"\b({'|'.join(ENTRY)})\b", r"x.\1", tr)
    return F.expr(f"array_join(transform(e, x -> {of_entry}), '')")


def result_pages(t):
    """One HTML page per contest and ROWS_PER_PAGE places, so a page never holds more rows than that.

    Entries are gathered as they are, which is a tenth of what they are as HTML, and written once gathered.
    """
    fixed = C("contest_id") % 4 == 3
    entry = F.struct(*ENTRY)
    part = F.floor((C("rank") - 1) / ROWS_PER_PAGE)
    listed = t.ranked.select("contest_id", part.alias("part"), entry.alias("e")).groupBy("contest_id", "part")
    rows = listed.agg(F.array_sort(F.collect_list("e")).alias("e"))
    heads = t.contest_headers.select(
        "contest_id", "period", F.concat(F.lit("Cup "), C("series_id").cast("string")).alias("name"), F.date_format("contest_date", "dd/MM/yy").alias("day")
    )

    def around(k: int):
        text = F.lit(HEADS[3][k])
        for layout in (0, 1, 2):
            text = F.when(C("contest_id") % 4 == layout, HEADS[layout][k]).otherwise(text)
        for mark, value in (("NAME", C("name")), ("DAY", C("day")), ("RACE", C("contest_id").cast("string"))):
            text = F.replace(text, F.lit(mark), value)
        return text

    first, second = F.when(fixed, _rows(FIXED_TR)).otherwise(_rows(SUMMARY_TR)), F.when(fixed, "").otherwise(_rows(RACE_TR))
    closing = F.when(~fixed, "</table></body></html>").otherwise("</body></html>")
    return rows.join(heads, "contest_id").select(
        (C("contest_id") * 1000 + C("part")).alias("page_id"),
        F.concat(F.lit("site/racing"), C("period").cast("string"), F.lit("/p"), (C("contest_id") * 1000 + C("part")).cast("string"), F.lit(".htm")).alias("source_path"),
        C("period").alias("year"),
        F.concat(around(0), first, around(1), second, closing).alias("html"),
    )


def site_parts(t, wanted=("tables", "fixed"), heads=(), rows_of=result.KINDS):
    """Parts of all pages of the site: the given ones, under negative numbers, and the result pages."""
    given = t.pages.select((-1 - C("page_id")).alias("page_id"), C("url").alias("source_path"), files.year_of_path("url").alias("year"), "html")
    return result.parts(given.unionByName(result_pages(t)), wanted, heads, rows_of)


def parsed_pages(t, heads=(), rows_of=result.KINDS):
    """All pages with data tables; the headings that aren't named, and rows of other kinds of tables, are left empty."""
    return result.parsed(site_parts(t, ["tables"], heads, rows_of))


def fixed_pages(t):
    return result.fixed_parsed(site_parts(t, ["fixed"]))


PAGED = """pg AS (SELECT *, contest_id * 1000 + CAST(floor((rank - 1) / 400) AS BIGINT) AS page_id, contest_id % 4 AS layout, row_number() OVER (PARTITION BY contest_id, floor((rank - 1) / 400)
        ORDER BY rank) AS pos, CASE WHEN entity_id % 5 > 0 THEN 'Boat ' || entity_id ELSE 'Sail # ' || boat_id END AS who, CASE boat_id % 3 WHEN 0 THEN 'J/29' WHEN 1 THEN 'A1/2' END AS design,
        CASE WHEN rank <> 2 THEN CAST(rank AS INTEGER) END AS shown_rank, strftime(contest_date, '%d/%m/%y') AS shown_day
        FROM ranked JOIN contest_headers USING (contest_id))"""


@query(
    "H06_table_rows",
    f"""WITH {PAGED} SELECT page_id, 'summary' AS kind, {N} AS rows_read, CAST(count(*) * 6 AS BIGINT) AS cells, CAST(1 AS BIGINT) AS race_links FROM pg WHERE layout < 3 GROUP BY 1
    UNION ALL SELECT page_id, 'race', {N}, CAST(count(*) * 7 AS BIGINT), 0 FROM pg WHERE layout < 3 GROUP BY 1
    UNION ALL SELECT page_id, 'fixed', {N}, CAST(sum(CASE WHEN rank % 7 <> 0 THEN 14 ELSE 9 END) AS BIGINT), 0 FROM pg WHERE layout = 3 GROUP BY 1""",
)
def _(t):
    def size(rows):
        return F.aggregate(rows, F.lit(0).cast("long"), lambda n, cells: n + F.size(cells))

    fixed = F.array(F.struct(F.lit("fixed").alias("kind"), C("fixed.rows").alias("rows"), F.lit(0).cast("long").alias("race_links")))
    tables = F.transform(
        "tables",
        lambda x: F.struct(x["kind"].alias("kind"), x["rows"].alias("rows"), F.size(F.array_compact(x["links"])).cast("long").alias("race_links")),
    )
    both = F.concat("tables", F.when(C("fixed").isNotNull(), fixed).otherwise(F.slice(fixed, 1, 0)))
    found = site_parts(t).withColumn("tables", tables).select("page_id", F.inline(both))
    return found.select("page_id", "kind", F.size("rows").cast("long").alias("rows_read"), size(C("rows")).alias("cells"), "race_links")


@query(
    "H07_named_columns",
    f"""WITH {PAGED} SELECT page_id, shown_rank AS rank, who AS boat, '# ' || boat_id AS sail_number, CAST(rating AS VARCHAR) AS phrf, elapsed_s AS elapsed, CAST(NULL AS VARCHAR) AS fleet
    FROM pg WHERE layout < 3""",
)
def _(t):
    rows = parsed_pages(t, rows_of=["race"]).select("page_id", F.inline("races")).select("page_id", F.inline("rows"))
    return rows.select(
        "page_id", times.first_number("rank").alias("rank"), "boat", "sail_number", C("phrf_rating").alias("phrf"),
        times.duration_s("elapsed_time").alias("elapsed"), "fleet",
    )


@query(
    "H09_score_cells",
    f"""SELECT status IN ('DNC', 'DNS') IS TRUE AS is_discarded, nullif(status, '') AS status, CAST(sum(CASE WHEN status = 'DNF' THEN NULL WHEN status IN ('DNC', 'DNS') THEN points
        ELSE points + 0.5 END) AS DOUBLE) AS points, {N} AS cells FROM results GROUP BY ALL""",
)
def _(t):
    cells = t.results.select(pages.score_cell(F.expr(SCORE)).alias("s"))
    return cells.groupBy("s.is_discarded", "s.status").agg(F.sum("s.points").alias("points"), F.count("*").alias("cells"))


@query(
    "H10_fixed_layout",
    f"""WITH {PAGED}, x AS (SELECT *, rank % 7 <> 0 AS full_row FROM pg WHERE layout = 3 AND entity_id % 5 > 0)
    SELECT page_id, 'Boat ' || entity_id AS boat_name, CAST(boat_id AS VARCHAR) AS sail_number, CASE boat_id % 3 WHEN 0 THEN 'J29' WHEN 1 THEN 'A1/2' ELSE '' END AS boat_class, CAST(rating AS VARCHAR) AS rating,
        '05/06/99' AS race_date, CASE WHEN status <> '' THEN status ELSE '19:05:10' END AS finish_time, '' AS penalty, elapsed_s // 60 || ':' || lpad(CAST(elapsed_s % 60 AS VARCHAR), 2, '0') AS elapsed_time,
        '0:50:00' AS corrected_time, CASE WHEN full_row THEN CAST(rank AS INTEGER) END AS position, CASE WHEN full_row THEN points + 0.75e0 END AS points, CASE WHEN full_row THEN '1' END AS espn,
        CASE WHEN full_row THEN CAST(points * 2 AS DOUBLE) END AS series_points, CASE WHEN full_row THEN CAST(rank AS INTEGER) END AS series_position, nullif(status, '') AS status FROM x""",
)
def _(t):
    rows = fixed_pages(t).select("page_id", F.inline("results"))
    return rows.select("page_id", *[name for name, *_ in result.FIXED_COLUMNS], "status")


@query(
    "H11_labelled_cells",
    f"""WITH {PAGED} SELECT page_id, 'Cup ' || series_id AS event_name, 'All' AS race_class, 'Bay One' AS course, shown_day AS race_date, CAST(NULL AS VARCHAR) AS distance, '12' AS wind_speed,
        CAST(3 AS INTEGER) AS race_number, CAST(9 AS INTEGER) AS race_total, 'Race 3' AS footer_race_info, 'Thursday, Jun 1 2000' AS footer_date FROM pg WHERE layout = 3
        GROUP BY page_id, series_id, shown_day HAVING count(*) FILTER (entity_id % 5 > 0) > 0""",
)
def _(t):
    fields = ("event_name", "race_class", "course", "race_date", "distance", "wind_speed", "race_number", "race_total")
    return fixed_pages(t).select("page_id", *[f"metadata.{f}" for f in fields], "footer_race_info", "footer_date")


@query(
    "H13_participant_type",
    f"""WITH {PAGED} SELECT CASE WHEN layout = 2 THEN 'helm' ELSE 'boat' END AS participant_type, {q.n('DISTINCT page_id')} AS pages FROM pg WHERE layout < 3 GROUP BY 1""",
)
def _(t):
    return parsed_pages(t, rows_of=[]).groupBy("participant_type").agg(F.count("*").alias("pages"))


# --- classes and provenance of all pages of the site -------------------------------------------------------------

# given pages under dated folders and telling names; a few say little, or announce a race
GIVEN_NAME = "CASE page_id % 11 WHEN 0 THEN 'racing.htm' WHEN 1 THEN 'Photo1.htm' WHEN 2 THEN 'handicap.htm' WHEN 3 THEN 'xxxxxxx1.htm' ELSE 'p' || CAST(page_id AS STRING) || '.htm' END"
GIVEN_PATH = f"'site/' || CASE WHEN page_id % 29 = 0 THEN 'undated' ELSE 'racing' || CAST(1999 + page_id % 27 AS STRING) END || '/' || {GIVEN_NAME}"
GIVEN_HTML = "CASE page_id % 13 WHEN 5 THEN html || '<p>Notice of Race</p>' WHEN 6 THEN '<body><b>back soon</b></body>' ELSE html END"
# every other group of twenty contests is dated fifteen years later; of the marked layout, some lack marks
LATER = "contest_id % 40 >= 20"
LACKING = "floor(contest_id / 4) % 5"


def classified(t):
    """(page_id, path, year, era, page_class, page_role, loaded) of all pages of the site."""
    given = t.pages.selectExpr("-1 - page_id AS page_id", "page_id AS known_as", f"{GIVEN_PATH} AS path", f"{GIVEN_HTML} AS html")
    contest = F.floor(C("page_id") / 1000).alias("contest_id")
    own = result_pages(t).select("page_id", contest, "year", "html").where("page_id % 1000 = 0")
    dated = F.when(F.expr(LATER), C("year") + 15).otherwise(C("year")).cast("string")
    lacking = F.when(C("contest_id") % 4 == 0, F.expr(LACKING)).otherwise(0)
    html = F.when(lacking.isin(1, 3, 4), F.replace(C("html"), F.lit('"racetable"'), F.lit('"plain"'))).otherwise(C("html"))
    html = F.when(lacking >= 2, F.replace(html, F.lit('"summarytable"'), F.lit('"plain"'))).otherwise(html)
    html = F.when(lacking == 4, F.concat(html, F.lit("Entry List"))).otherwise(html)
    path = F.concat(F.lit("site/racing"), dated, F.lit("/p"), C("contest_id").cast("string"), F.lit(".htm"))
    both = given.unionByName(own.select("page_id", C("contest_id").alias("known_as"), path.alias("path"), html.alias("html")))
    found = both.withColumn("year", files.year_of_path("path"))
    found = found.withColumn("page_class", pages.page_class("html", "path", "year"))
    loaded = t.labels.select(C("doc_id").alias("known_as")).distinct().withColumn("loaded", F.lit(True))
    return found.join(loaded, "known_as", "left").select(
        "page_id", "path", "year", F.when(C("year").isNotNull(), pages.era("year")).alias("era"), "page_class",
        F.when(C("page_class").isNotNull(), pages.page_role("path", "page_class", "year")).alias("page_role"),
        F.coalesce("loaded", F.lit(False)).alias("loaded"),
    )


BODY = _plain("regexp_extract(html, '(?is)<body\\b[^>]*>(.*)', 1)")
CLASSES = f"""gv AS (SELECT -1 - page_id AS page_id, page_id AS known_as, CASE WHEN page_id % 29 <> 0 THEN CAST(1999 + page_id % 27 AS INTEGER) END AS year, lower({GIVEN_NAME}) AS name, {GIVEN_HTML} AS html FROM pages),
    gw AS (SELECT *, {BODY} AS body, lower({_plain('html')}) AS words, lower(coalesce({_element('title')}, '')) AS title FROM gv),
    gc AS (SELECT *, CASE WHEN year IS NULL THEN NULL WHEN year >= 2014 THEN CASE WHEN starts_with(name, 'xxxxxxx') OR length(body) < 50 THEN 'template'
        WHEN contains(words, 'entry') AND contains(words, 'list') THEN 'entry-list' WHEN contains(title, 'sailwave') THEN 'sailwave-summary' ELSE 'non-result-html' END
        WHEN name = 'racing.htm' THEN 'legacy-index' WHEN contains(name, 'photo') THEN 'gallery' WHEN contains(name, 'handicap') OR contains(name, 'si') THEN 'non-result-html'
        WHEN contains(words, 'schedule') OR contains(words, 'notice of race') THEN 'non-result-html' WHEN starts_with(name, 'xxxxxxx') OR length(body) < 50 THEN 'template' ELSE 'unknown' END AS page_class FROM gw),
    oc AS (SELECT DISTINCT contest_id * 1000 AS page_id, contest_id AS known_as, CAST(CASE WHEN {LATER} THEN period + 15 ELSE period END AS INTEGER) AS year, 'p' AS name,
        CASE WHEN contest_id % 4 = 0 AND contest_id // 4 % 5 < 3 THEN CASE contest_id // 4 % 5 WHEN 0 THEN 'sailwave-mixed' WHEN 1 THEN 'sailwave-summary' ELSE 'sailwave-race' END
        WHEN period + CASE WHEN {LATER} THEN 15 ELSE 0 END >= 2014 THEN CASE WHEN contest_id % 4 = 0 AND contest_id // 4 % 5 = 4 THEN 'entry-list'
            WHEN contest_id % 4 = 0 THEN 'sailwave-summary' ELSE 'non-result-html' END
        WHEN contest_id % 4 = 3 THEN 'unknown' ELSE 'legacy-result' END AS page_class FROM results JOIN contest_headers USING (contest_id)),
    pc AS (SELECT page_id, known_as, year, name, page_class, CASE WHEN year >= 2014 THEN 'sailwave' WHEN year IS NOT NULL THEN 'legacy' END AS era, CASE WHEN year IS NULL THEN NULL
        WHEN year < 2014 THEN CASE page_class WHEN 'legacy-index' THEN 'index' WHEN 'gallery' THEN 'gallery' WHEN 'template' THEN 'template' WHEN 'unknown' THEN 'unknown' WHEN 'non-result-html' THEN 'unknown'
            ELSE 'canonical' END WHEN page_class = 'template' OR starts_with(name, 'xxxxxxx') THEN 'template' ELSE 'canonical' END AS page_role
        FROM (SELECT page_id, known_as, year, name, page_class FROM gc UNION ALL SELECT * FROM oc))"""


@query("H01_page_class", f"WITH {CLASSES} SELECT page_id, year, era, page_class, page_role FROM pc")
def _(t):
    return classified(t).select("page_id", "year", "era", "page_class", "page_role")


@query(
    "C09_provenance_status",
    f"""WITH {CLASSES} SELECT CASE WHEN known_as IN (SELECT doc_id FROM labels) THEN 'loaded' WHEN page_class IS NULL OR page_class = 'unknown' THEN 'unclassified'
        WHEN page_class IN ('legacy-result', 'sailwave-summary', 'sailwave-race', 'sailwave-mixed') THEN 'result-not-loaded'
        WHEN page_class IN ('template', 'gallery', 'legacy-index', 'entry-list') THEN 'skipped' ELSE 'non-result' END AS status, era, {N} AS pages FROM pc GROUP BY 1, 2""",
)
def _(t):
    status = pages.provenance("page_class", "loaded")
    return classified(t).groupBy(status.alias("status"), "era").agg(F.count("*").alias("pages"))


# --- pages to the nested tables ----------------------------------------------------------------------------------


@query(
    "S14_nested_events",
    f"""WITH {PAGED} SELECT DISTINCT 'site/racing' || period || '/p' || page_id || '.htm' AS source_path, period, CASE layout WHEN 0 THEN 'Club - Cup ' || series_id ELSE 'Cup ' || series_id END AS event_name,
        CASE layout WHEN 0 THEN 4 WHEN 1 THEN 0 ELSE 4 END AS races_sailed, CASE WHEN layout < 2 THEN 1 END AS discards, 'trophy' AS event_type, CAST(NULL AS VARCHAR) AS month, CAST(NULL AS INTEGER) AS to_count,
        CASE layout WHEN 0 THEN 9 END AS entries, CASE layout WHEN 0 THEN 'PHRF' END AS rating_system, CASE layout WHEN 0 THEN 'final' ELSE 'as-of' END AS publication_status FROM pg WHERE layout < 3""",
)
def _(t):
    return loads.page_events(parsed_pages(t, result.HEADS, rows_of=[]))


@query(
    "S14_nested_races",
    f"""WITH {PAGED} SELECT DISTINCT 'site/racing' || period || '/p' || page_id || '.htm' AS source_path, CASE layout WHEN 2 THEN 'race_' ELSE 'r' END || contest_id AS race_key,
        CASE layout WHEN 2 THEN '5/Jun/1999' ELSE shown_day END AS race_date, CASE WHEN layout < 2 THEN '18:36:00' END AS start_time FROM pg WHERE layout < 3""",
)
def _(t):
    return loads.page_races(parsed_pages(t, rows_of=[]))


@query(
    "S14_nested_results",
    f"""WITH {PAGED} SELECT CASE layout WHEN 2 THEN 'race_' ELSE 'r' END || contest_id AS race_key, who AS participant, CAST(boat_id AS VARCHAR) AS sail, design AS class,
        CASE WHEN design = 'A1/2' THEN 'A1/2' END AS fleet, shown_rank AS rank, elapsed_s, CASE WHEN status IS NULL OR status = '' THEN points + 0.5e0 END AS points, nullif(status, '') AS status
    FROM pg WHERE layout < 3""",
)
def _(t):
    return loads.page_results(parsed_pages(t, rows_of=["race"])).drop("source_path")


@query(
    "S14_nested_standings",
    f"""WITH {PAGED} SELECT CASE layout WHEN 1 THEN 'a_fleet' ELSE 'overall' END AS scope, who AS participant, {N} AS standings, CAST(sum(coalesce(shown_rank, pos)) AS BIGINT) AS ranks,
        CAST(sum(points) AS DOUBLE) AS nett FROM pg WHERE layout < 3 GROUP BY ALL""",
)
def _(t):
    rows = loads.page_standings(parsed_pages(t, rows_of=["summary"])).groupBy("scope", "participant")
    return rows.agg(F.count("*").alias("standings"), F.sum("rank").cast("long").alias("ranks"), F.sum("nett_points").alias("nett"))


@query(
    "S14_nested_scores",
    f"""WITH {PAGED} SELECT CASE WHEN layout = 2 THEN 'r1' ELSE 'r' || contest_id END AS race_key, shown_day AS race_date, {N} AS scores, CAST(sum(CASE WHEN status IN ('DNC', 'DNS') THEN points
        WHEN status = 'DNF' THEN NULL ELSE points + 0.5 END) AS DOUBLE) AS points, {q.n(cond="status IN ('DNC', 'DNS')")} AS discarded, {q.n(cond="status <> ''")} AS coded FROM pg WHERE layout < 3 GROUP BY ALL""",
)
def _(t):
    cells = loads.page_scores(parsed_pages(t, rows_of=["summary"])).groupBy("race_key", "race_date")
    return cells.agg(
        F.count("*").alias("scores"), F.sum("points").alias("points"), count_if(C("is_discarded")).alias("discarded"), F.count("status").alias("coded")
    )


@query(
    "S14_fixed_results",
    f"""WITH {PAGED} SELECT 'site/racing' || period || '/p' || page_id || '.htm' AS source_path, CAST(3 AS INTEGER) AS race_no, 'Boat ' || entity_id AS participant, CASE WHEN rank % 7 <> 0 THEN CAST(rank AS INTEGER) END AS rank,
        elapsed_s, CASE WHEN rank % 7 <> 0 THEN points + 0.75e0 END AS points, nullif(status, '') AS status FROM pg WHERE layout = 3 AND entity_id % 5 > 0""",
)
def _(t):
    return loads.legacy_results(fixed_pages(t)).drop("race_date")


CAPTION = "series_id, 'Sailed: ' || CAST(series_id % 9 AS STRING) || ', Discards: 1, Rating system: PHRF, none' AS caption"


@query(
    "H08_caption_metadata",
    f"SELECT CAST(series_id % 9 AS INTEGER) AS sailed, 1 AS discards, 'PHRF' AS rating_system, {N} AS series FROM series GROUP BY ALL",
)
def _(t):
    m = t.series.selectExpr(CAPTION.split(", ", 1)[1]).select(pages.caption_metadata("caption").alias("m"))
    return m.groupBy(
        C("m")["sailed"].try_cast("int").alias("sailed"),
        C("m")["discards"].try_cast("int").alias("discards"),
        C("m")["rating_system"].alias("rating_system"),
    ).agg(F.count("*").alias("series"))


SCOPES = "series_id, CASE series_id % 8 WHEN 0 THEN 'A Fleet' WHEN 1 THEN 'Fleet b' WHEN 2 THEN 'Sonar' WHEN 3 THEN NULL WHEN 4 THEN 'P Division' WHEN 5 THEN 'X & Y!' WHEN 6 THEN 'Overall - all' ELSE 'division s' END AS scope_title"


@query(
    "H12_scope_key",
    f"""SELECT CASE series_id % 8 WHEN 0 THEN 'a_fleet' WHEN 1 THEN 'b_fleet' WHEN 2 THEN 's_fleet' WHEN 3 THEN 'summary' WHEN 4 THEN 'p_division'
        WHEN 5 THEN 'x_y' WHEN 6 THEN 'overall' ELSE 's_division' END AS scope, {N} AS series FROM series GROUP BY 1""",
)
def _(t):
    s = t.series.selectExpr(SCOPES.split(", ", 1)[1])
    return s.groupBy(pages.scope_key("scope_title", F.lit("summary")).alias("scope")).agg(F.count("*").alias("series"))


@query(
    "H14_fill_dates",
    """WITH r AS (SELECT *, CASE WHEN contest_no IS NULL THEN NULL ELSE strftime(contest_date, '%Y-%m-%d') END AS d FROM contest_headers),
    k AS (SELECT series_id, start_hour, arg_min(d, contest_id) FILTER (d IS NOT NULL) AS f FROM r GROUP BY 1, 2)
    SELECT contest_id, coalesce(d, f) AS race_date FROM r LEFT JOIN k USING (series_id, start_hour)""",
)
def _(t):
    races = t.contest_headers.select(
        "contest_id",
        "series_id",
        "start_hour",
        F.when(C("contest_no").isNotNull(), F.date_format("contest_date", "yyyy-MM-dd")).alias("race_date"),
    )
    columns = races.withColumnRenamed("contest_id", "position")
    return pages.fill_dates(races, columns, ["series_id", "start_hour"]).select("contest_id", "race_date")


@query(
    "H15_display_name",
    f"""SELECT boat_id, coalesce(CASE WHEN boat_id % 3 > 0 THEN name END, 'Sail ' || sail, 'Bow ' || boat_id) AS display_name FROM boats""",
)
def _(t):
    named = t.boats.selectExpr("boat_id", "CASE WHEN boat_id % 3 > 0 THEN name END AS shown", "sail", "CAST(boat_id AS STRING) AS bow")
    return named.select("boat_id", idn.display_name("shown", "sail", "bow").alias("display_name"))


KINDS = "CASE p_partkey % 9 WHEN 0 THEN 'J 92' WHEN 1 THEN 'Farr 40 OD' WHEN 2 THEN 'C&C 27 mkV' WHEN 3 THEN 'Sonar' WHEN 4 THEN 'Laser28' WHEN 5 THEN 'Beneteau First 44.7' WHEN 6 THEN 'J29FR Custom' WHEN 7 THEN '' ELSE 'P Class' END"


@query("H16_name_and_type", f"SELECT p_partkey, p_name AS name, {KINDS} AS type FROM part")
def _(t):
    raw = t.part.selectExpr("p_partkey", f"trim(p_name || ' ' || {KINDS}) AS entry")
    return raw.select("p_partkey", pages.split_name_and_type("entry").alias("s")).select("p_partkey", "s.name", "s.type")


CERT_TEXT = """p_partkey, 'Certificate Name ' || CASE WHEN p_partkey % 5 = 0 THEN replace(p_name, ' ', chr(10)) ELSE p_name END || ' Sail Nr CAN-' || CAST(p_partkey AS STRING) || ' Class ' || p_type || ' Designer Ann Lee Builder B&B Series 3 Age date 01/1990 '
    || CASE WHEN p_size % 2 = 0 THEN 'Length Overall 10.5 m' ELSE 'LOA ' || CAST(p_size AS STRING) || '.25 m' END || ' Displacement 3,' || CAST(100 + p_size AS STRING) || ' kg '
    || CASE WHEN p_size % 3 = 0 THEN 'GPH: 600.5' ELSE '' END AS body"""


@query(
    "H17_named_fields",
    """SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 OR p_name NOT LIKE '% %' THEN p_name END AS name, 'CAN-' || p_partkey AS sail_no, p_type AS boat_class, 'Ann Lee' AS designer, 'B&B' AS builder, '01/1990' AS age_date,
        CAST(NULL AS VARCHAR) AS issued_on, CASE WHEN p_size % 2 = 0 THEN 10.5e0 ELSE p_size + 0.25e0 END AS loa_m, 3100e0 + p_size AS displacement_kg,
        CASE WHEN p_size % 3 = 0 THEN 600.5e0 END AS gph FROM part""",
)
def _(t):
    texts = t.part.selectExpr("p_partkey", CERT_TEXT.split(", ", 1)[1])
    wanted = ["p_partkey", "name", "sail_no", "boat_class", "designer", "builder", "age_date", "issued_on", "loa_m", "displacement_kg", "gph"]
    return texts.select("p_partkey", *pages.named_fields("body")).select(*wanted)
