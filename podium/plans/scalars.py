"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from podium.functions import identifiers as idn
from podium.functions import scoring, text, times
from podium.plans import dialect as q
from podium.plans.registry import query

C = F.col


@query("X01_collapse", f"SELECT boat_id, {q.collapse('name')} AS tidy FROM boats")
def _(t):
    return t.boats.select("boat_id", text.collapse("name").alias("tidy"))


@query(
    "X02_name_key",
    f"SELECT {q.name_key('name')} AS name_key, {q.n()} AS boats, min(boat_id) AS first_id FROM boats GROUP BY 1",
)
def _(t):
    return t.boats.groupBy(text.name_key("name").alias("name_key")).agg(
        F.count("*").alias("boats"), F.min("boat_id").alias("first_id")
    )


@query("X03_slug", f"SELECT boat_id, {q.slug('name')} AS slug FROM boats")
def _(t):
    return t.boats.select("boat_id", text.slug("name").alias("slug"))


@query("X04_canonical_stem", f"SELECT series_id, {q.canonical_stem('source_file')} AS stem FROM series")
def _(t):
    return t.series.select("series_id", text.canonical_stem("source_file").alias("stem"))


@query(
    "X05_stem_without_number",
    f"SELECT series_id, rtrim(regexp_replace({q.stem('source_file')}, '[0-9]+$', ''), '_') AS stem FROM series",
)
def _(t):
    return t.series.select("series_id", text.stem_without_number("source_file").alias("stem"))


@query("X06_canonical_name", f"SELECT series_id, {q.canonical_name('event_name')} AS canonical FROM series")
def _(t):
    return t.series.select("series_id", text.canonical_name("event_name").alias("canonical"))


@query(
    "X07_view_name",
    f"SELECT event_type, {q.n()} AS series, {q.n(cond=q.view_name('event_name'))} AS views FROM series GROUP BY 1",
)
def _(t):
    return t.series.groupBy("event_type").agg(
        F.count("*").alias("series"), F.count(F.when(text.is_view_name("event_name"), 1)).alias("views")
    )


@query("X08_clean_title", f"SELECT series_id, {q.clean_title('event_name')} AS title FROM series")
def _(t):
    return t.series.select("series_id", text.clean_title("event_name").alias("title"))


HEADS = """CASE WHEN series_id % 5 = 0 THEN NULL WHEN series_id % 5 = 1 THEN 'CUP' ELSE 'Club' END AS h1,
    CASE WHEN series_id % 4 = 0 THEN NULL ELSE event_name END AS h2,
    CASE WHEN series_id % 3 = 0 THEN NULL ELSE 'Sailwave results for ' || event_name END AS title, source_file"""


@query(
    "X09_event_name",
    f"""WITH heads AS (SELECT series_id, {HEADS} FROM series),
    tidy AS (SELECT series_id, {q.clean_title('h1')} AS a, {q.clean_title('h2')} AS b, {q.clean_title('title')} AS c,
        regexp_replace(regexp_extract(source_file, '[^/]*$'), '\\.[^.]*$', '') AS stem FROM heads)
    SELECT series_id, CASE WHEN a <> '' AND b <> '' THEN
            CASE WHEN contains(lower(b), lower(a)) THEN b ELSE {q.clean_title("a || ' - ' || b")} END
        WHEN b <> '' THEN b WHEN a <> '' THEN a
        WHEN c <> '' THEN {q.clean_title("regexp_replace(c, '(?i)^Sailwave results for +', '')")}
        ELSE stem END AS event_name FROM tidy""",
)
def _(t):
    heads = t.series.selectExpr("series_id", HEADS.split(",\n")[0], *[x.strip() for x in HEADS.split(",\n")[1:-1]],
                                "CASE WHEN series_id % 3 = 0 THEN NULL ELSE 'Sailwave results for ' || event_name END AS title",
                                "source_file")
    return heads.select("series_id", text.event_name("h1", "h2", "title", "source_file").alias("event_name"))


@query("X10_identifier", f"SELECT boat_id, {q.ident('sail')} AS ident FROM boats")
def _(t):
    return t.boats.select("boat_id", idn.identifier("sail").alias("ident"))


@query(
    "X11_identifier_quality",
    f"""SELECT {q.placeholder('sail')} AS is_placeholder, {q.strong('sail')} AS is_strong, {q.n()} AS boats
    FROM boats GROUP BY ALL""",
)
def _(t):
    return t.boats.groupBy(
        idn.is_placeholder("sail").alias("is_placeholder"),
        F.coalesce(idn.is_strong("sail"), F.lit(False)).alias("is_strong"),
    ).agg(F.count("*").alias("boats"))


OTHER = "CASE boat_id % 3 WHEN 0 THEN CAST(20000 + boat_id % 90 AS STRING) WHEN 1 THEN '2001' || CAST(boat_id % 10 AS STRING) ELSE sail || '7' END AS other"


@query(
    "X12_related_identifiers",
    f"""WITH pairs AS (SELECT boat_id, sail, {OTHER} FROM boats),
    ids AS (SELECT boat_id, {q.ident('sail')} AS a, {q.ident('other')} AS b FROM pairs)
    SELECT boat_id, coalesce(CASE WHEN a = b THEN true
        WHEN least(length(a), length(b)) >= 3 AND abs(length(a) - length(b)) <= 2
            AND (contains(a, b) OR contains(b, a)) THEN true
        WHEN length(a) = length(b) AND length(a) >= 4 THEN hamming(a, b) <= 1 ELSE false END, false) AS related
    FROM ids""",
)
def _(t):
    pairs = t.boats.selectExpr("boat_id", "sail", OTHER)
    return pairs.select("boat_id", idn.related("sail", "other").alias("related"))


@query(
    "X13_design_class",
    f"SELECT boat_id, {q.design_class('raw_class')} AS class, {q.family('raw_class')} AS family FROM boats",
)
def _(t):
    return t.boats.select(
        "boat_id", idn.design_class("raw_class").alias("class"), idn.class_family("raw_class").alias("family")
    )


@query(
    "X14_rating_band",
    f"SELECT {q.is_band('raw_class')} AS is_band, {q.n()} AS boats FROM boats GROUP BY 1",
)
def _(t):
    return t.boats.groupBy(idn.is_rating_band("raw_class").alias("is_band")).agg(F.count("*").alias("boats"))


@query(
    "X15_best_spelling",
    f"""SELECT {q.name_key('name')} AS name_key,
        arg_max({q.collapse('name')}, ({q.name_score('name')}, {q.collapse('name')})) AS best_name,
        arg_max({q.design_class('raw_class')}, ({q.class_score('raw_class')}, {q.design_class('raw_class')}))
            FILTER ({q.design_class('raw_class')} IS NOT NULL) AS best_class
    FROM boats GROUP BY 1""",
)
def _(t):
    tidy = t.boats.select(
        text.name_key("name").alias("name_key"),
        text.collapse("name").alias("n"),
        idn.design_class("raw_class").alias("c"),
    )
    return tidy.groupBy("name_key").agg(
        F.max(F.struct(idn.name_score("n"), "n"))["n"].alias("best_name"),
        F.max(F.when(C("c").isNotNull(), F.struct(idn.class_score("c"), "c")))["c"].alias("best_class"),
    )


PERSON = "CASE series_id % 4 WHEN 0 THEN 'BOB  SMITH ' WHEN 1 THEN 'mike jones ' WHEN 2 THEN '. Liz  Brown ' ELSE 'Ann McKay ' END || CAST(series_id % 50 AS STRING) AS person"


@query(
    "X16_person_and_type_keys",
    f"""WITH people AS (SELECT series_id, {PERSON} FROM series)
    SELECT CASE series_id % 4 WHEN 0 THEN 'Bob Smith ' WHEN 1 THEN 'Mike Jones ' WHEN 2 THEN 'Liz Brown '
            ELSE 'Ann McKay ' END || CAST(series_id % 50 AS VARCHAR) AS person_name,
        CASE series_id % 4 WHEN 0 THEN 'robert smith ' WHEN 1 THEN 'michael jones ' WHEN 2 THEN '. liz brown '
            ELSE 'ann mckay ' END || CAST(series_id % 50 AS VARCHAR) AS person_key,
        regexp_replace(lower(trim(person)), '[\\s./''-]+', '', 'g') AS fuzzy_key,
        {q.n()} AS people FROM people GROUP BY ALL""",
)
def _(t):
    people = t.series.selectExpr("series_id", PERSON)
    return people.groupBy(
        text.person_name("person").alias("person_name"),
        text.person_key("person").alias("person_key"),
        text.fuzzy_key("person").alias("fuzzy_key"),
    ).agg(F.count("*").alias("people"))


@query(
    "X16_type_key",
    f"""WITH k AS (SELECT boat_id, regexp_replace(lower({q.collapse('raw_class')}), '\\b([io])/b\\b', '\\1b', 'g') AS c FROM boats)
    SELECT boat_id, CASE WHEN regexp_matches(c, '^j ?[/-]?\\d') THEN 'j' || regexp_extract(c, '\\d+')
        ELSE replace(replace(c, 'c & c ', 'c&c'), 'farr ', 'farr') END AS type_key FROM k""",
)
def _(t):
    return t.boats.select("boat_id", idn.type_key("raw_class").alias("type_key"))


RAW_RANK = "CASE line_no % 4 WHEN 0 THEN CAST(points AS STRING) || 'th' WHEN 1 THEN 'DNC' WHEN 2 THEN CAST(points AS STRING) ELSE NULL END AS raw_rank"


@query(
    "X17_rank_and_safe_casts",
    f"""WITH r AS (SELECT {RAW_RANK} FROM results)
    SELECT TRY_CAST(nullif(regexp_extract(raw_rank, '[0-9]+'), '') AS INTEGER) AS rank,
        TRY_CAST(raw_rank AS INTEGER) AS whole, TRY_CAST(raw_rank AS DOUBLE) AS number, {q.n()} AS rows_seen
    FROM r GROUP BY ALL""",
)
def _(t):
    return (
        t.results.selectExpr(RAW_RANK)
        .groupBy(
            times.first_number("raw_rank").alias("rank"),
            C("raw_rank").try_cast("int").alias("whole"),
            C("raw_rank").try_cast("double").alias("number"),
        )
        .agg(F.count("*").alias("rows_seen"))
    )


Y4, Y2 = "CAST(period AS STRING)", "substr(CAST(period AS STRING), 3, 2)"
M1, D1 = "CAST(month AS STRING)", "CAST(day_no AS STRING)"
RAW_DATE = f"""CASE contest_id % 8 WHEN 0 THEN {D1} || '/' || {M1} || '/' || {Y2} WHEN 1 THEN {D1} || '/' || {M1} || '/' || {Y4}
    WHEN 2 THEN {D1} || '-' || {M1} || '-' || {Y2} WHEN 3 THEN {D1} || '-' || {M1} || '-' || {Y4}
    WHEN 4 THEN {M1} || '/' || {D1} || '/' || {Y4} WHEN 5 THEN {D1} || '/' || {M1} || '/2020'
    WHEN 6 THEN 'Pos' ELSE '31/2/' || {Y4} END AS raw_date"""


def _strp(fmt: str) -> str:
    p = f"try_strptime(raw_date, '{fmt}')"
    return f"CASE WHEN year({p}) > 2025 THEN {p} - INTERVAL 100 YEAR ELSE {p} END"


FORMATS = ["%d/%m/%y", "%d/%m/%Y", "%d-%m-%y", "%d-%m-%Y", "%y-%m-%d", "%m-%d-%y", "%m/%d/%y", "%m/%d/%Y"]


@query(
    "X18_mixed_dates",
    f"""WITH raw AS (SELECT contest_id, period, {RAW_DATE} FROM contest_headers),
    p AS (SELECT contest_id, period, {', '.join(f'{_strp(f)} AS d{i}' for i, f in enumerate(FORMATS))} FROM raw)
    SELECT contest_id, coalesce({', '.join(f"CASE WHEN year(d{i}) = period THEN strftime(d{i}, '%Y-%m-%d') END" for i in range(8))},
        {', '.join(f"strftime(TRY_CAST(format('{{:04d}}-{{:02d}}-{{:02d}}', period, month(d{i}), day(d{i})) AS DATE), '%Y-%m-%d')" for i in range(8))},
        {', '.join(f"strftime(d{i}, '%Y-%m-%d')" for i in range(4))}) AS iso_date FROM p""",
)
def _(t):
    raw = t.contest_headers.selectExpr("contest_id", "period", RAW_DATE)
    return raw.select("contest_id", times.iso_date("raw_date", C("period")).alias("iso_date"))


MONTH_TEXT = """CASE series_id % 7 WHEN 0 THEN 'x_fall.htm' WHEN 1 THEN 'Sep_2.htm' WHEN 2 THEN 'series' WHEN 3 THEN 'JULY open'
    ELSE coalesce(series_month, 'cup') END AS src"""
FOOTER = "CASE WHEN series_id % 2 = 0 THEN 'Thursday, Jun 1 2000' END AS footer"


@query(
    "X19_month_name",
    f"""WITH s AS (SELECT series_id, {MONTH_TEXT}, {FOOTER} FROM series)
    SELECT CASE WHEN lower(src) LIKE '%may%' THEN 'may' WHEN lower(src) LIKE '%june%' THEN 'june'
            WHEN lower(src) LIKE '%july%' THEN 'july' WHEN lower(src) LIKE '%august%' THEN 'august'
            WHEN lower(src) LIKE '%september%' OR contains(lower(src), 'sep_') OR contains(lower(src), '_fall') THEN 'september'
            WHEN contains(footer, 'Jun') THEN 'june' END AS month, {q.n()} AS series FROM s GROUP BY 1""",
)
def _(t):
    s = t.series.selectExpr("series_id", MONTH_TEXT, FOOTER)
    return s.groupBy(times.month_name("src", footer="footer").alias("month")).agg(F.count("*").alias("series"))


CAPTION = """CASE contest_id % 3 WHEN 0 THEN 'Start: A, Finishes: F, Time: ' || CAST(start_hour AS STRING) || ':36:00, Distance: 5'
    WHEN 1 THEN 'Time: 77:00:00' ELSE 'no time' END AS caption"""


@query(
    "X20_start_hour",
    f"""WITH c AS (SELECT start_hour, contest_id, {CAPTION} FROM contest_headers)
    SELECT CASE contest_id % 3 WHEN 0 THEN CAST(start_hour AS VARCHAR) || ':36:00' WHEN 1 THEN '77:00:00' END AS start_time,
        CAST(CASE contest_id % 3 WHEN 0 THEN start_hour ELSE 18 END AS INTEGER) AS hour, {q.n()} AS contests FROM c GROUP BY ALL""",
)
def _(t):
    c = t.contest_headers.selectExpr("contest_id", "start_hour", CAPTION)
    at = times.start_time("caption")
    return c.groupBy(at.alias("start_time"), times.start_hour(at).alias("hour")).agg(F.count("*").alias("contests"))


RAW_TIME = """CASE line_no % 4 WHEN 0 THEN '00 0' || CAST(floor(elapsed_s / 3600) AS STRING) || ':' || lpad(CAST(floor(elapsed_s / 60) % 60 AS STRING), 2, '0') || ':' || lpad(CAST(elapsed_s % 60 AS STRING), 2, '0')
    WHEN 1 THEN CAST(floor(elapsed_s / 60) AS STRING) || ':' || CAST(elapsed_s % 60 AS STRING) WHEN 2 THEN 'n/a'
    ELSE CAST(floor(elapsed_s / 3600) AS STRING) || ':' || CAST(floor(elapsed_s / 60) % 60 AS STRING) || ':' || CAST(elapsed_s % 60 AS STRING) END AS raw_time"""
RAW_TIME_DUCK = RAW_TIME.replace("floor(elapsed_s / 3600)", "(elapsed_s // 3600)").replace("floor(elapsed_s / 60)", "(elapsed_s // 60)")


@query(
    "X21_durations",
    f"""WITH r AS (SELECT elapsed_s, line_no FROM results)
    SELECT line_no, {q.n()} AS rows_seen,
        CAST(sum(CASE WHEN line_no % 4 <> 2 THEN elapsed_s END) AS BIGINT) AS seconds,
        max(CASE WHEN line_no % 4 <> 2 THEN format('{{}}:{{:02d}}:{{:02d}}', elapsed_s // 3600, elapsed_s // 60 % 60, elapsed_s % 60) END) AS last_clock
    FROM r GROUP BY line_no""",
)
def _(t):
    read = t.results.selectExpr("line_no", RAW_TIME).select("line_no", times.duration_s("raw_time").alias("s"))
    return read.groupBy("line_no").agg(
        F.count("*").alias("rows_seen"), F.sum("s").alias("seconds"), F.max(times.clock("s")).alias("last_clock")
    )


@query(
    "X22_wind_band",
    f"""SELECT CASE WHEN speed_c IS NULL THEN 'medium' WHEN speed_c <= 900 THEN 'low' WHEN speed_c >= 1400 THEN 'high'
        ELSE 'medium' END AS band, {q.n()} AS hours FROM observations GROUP BY 1""",
)
def _(t):
    return t.observations.groupBy(scoring.wind_band(C("speed_c") / 100).alias("band")).agg(F.count("*").alias("hours"))


@query(
    "X23_units",
    """SELECT obs_id, speed_c / 100e0 / 1.852e0 AS knots, 12e0 / ((3600 + obs_id) / 3600e0) AS boat_kt FROM observations""",
)
def _(t):
    return t.observations.select(
        "obs_id",
        scoring.knots(C("speed_c") / F.lit(100.0)).alias("knots"),
        scoring.speed_kt(F.lit(12.0), (C("obs_id") + 3600)).alias("boat_kt"),
    )


@query(
    "X24_compass",
    f"""SELECT ['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW']
        [1 + CAST(floor(direction / 22.5 + 0.5) AS INT) % 16] AS point, {q.n()} AS hours FROM observations GROUP BY 1""",
)
def _(t):
    return t.observations.groupBy(scoring.compass("direction").alias("point")).agg(F.count("*").alias("hours"))


@query(
    "X25_condition",
    f"""WITH c AS (SELECT CASE direction % 7 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 61 WHEN 3 THEN 95 ELSE direction % 7 END AS code FROM observations)
    SELECT CASE code WHEN 0 THEN 'Clear sky' WHEN 61 THEN 'Light rain' WHEN 95 THEN 'Thunderstorm'
        ELSE 'Code ' || CAST(code AS VARCHAR) END AS conditions, {q.n()} AS hours FROM c GROUP BY 1""",
)
def _(t):
    code = "CASE direction % 7 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 61 WHEN 3 THEN 95 ELSE direction % 7 END AS code"
    return t.observations.selectExpr(code).groupBy(scoring.condition("code").alias("conditions")).agg(
        F.count("*").alias("hours")
    )


LABELS = {"RG Smith Cup": "Smith Cup", "Bolands": "Boland's Cup", "Open Trophy": "Opening Regatta"}
RAW_LABEL = "CASE series_id % 5 WHEN 0 THEN 'Bolands' WHEN 1 THEN 'CLUB - Bolands' WHEN 2 THEN 'CLUB - R.G. Smith Cup' WHEN 3 THEN 'Open  Trophy.' ELSE event_name END AS raw_label"


@query(
    "X27_label_mapping",
    f"""SELECT CASE series_id % 5 WHEN 0 THEN 'Boland''s Cup' WHEN 1 THEN 'Boland''s Cup' WHEN 2 THEN 'Smith Cup'
        WHEN 3 THEN 'Opening Regatta' ELSE event_name END AS label, {q.n()} AS series FROM series GROUP BY 1""",
)
def _(t):
    s = t.series.selectExpr("event_name", RAW_LABEL)
    return s.groupBy(text.map_label("raw_label", LABELS).alias("label")).agg(F.count("*").alias("series"))


@query(
    "X28_local_time",
    f"""SELECT strftime(ts - INTERVAL 3 HOUR, '%Y-%m-%d') AS local_date, {q.n()} AS rows_seen,
        {q.n(cond="CAST(ts AS DATE) <> CAST(ts - INTERVAL 3 HOUR AS DATE)")} AS moved FROM events GROUP BY 1""",
)
def _(t):
    local = t.events.select(F.to_date("ts").alias("utc"), F.to_date(times.to_local("ts")).alias("local"))
    return local.groupBy(F.date_format("local", "yyyy-MM-dd").alias("local_date")).agg(
        F.count("*").alias("rows_seen"), F.count(F.when(C("utc") != C("local"), 1)).alias("moved")
    )


@query("X29_keywords", "SELECT boat_id, lower(concat_ws(' ', name, sail, raw_class)) AS keywords FROM boats")
def _(t):
    return t.boats.select("boat_id", text.keywords("name", "sail", "raw_class").alias("keywords"))


@query(
    "X30_rate_ratio",
    f"""SELECT obs_date_s, coalesce({q.pct('calm', 'n', 3)}, 0e0) AS calm_rate FROM (
        SELECT day AS obs_date_s, count(*) FILTER (speed_c <= 500) AS calm,
            count(*) FILTER (kind = 'view') AS n FROM observations GROUP BY 1)""",
)
def _(t):
    days = t.observations.groupBy(C("day").alias("obs_date_s")).agg(
        F.count(F.when(C("speed_c") <= 500, 1)).alias("calm"), F.count(F.when(C("kind") == "view", 1)).alias("n")
    )
    return days.select("obs_date_s", scoring.rate3("calm", "n").alias("calm_rate"))
