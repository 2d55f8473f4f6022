"""Event scope, canonical groups, completeness and season marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from podium.functions import text, times
from podium.operators import events as ev
from podium.operators.measures import count_if, half_up
from podium.operators.scope import exclude
from podium.plans import dialect as q
from podium.plans.registry import query
from podium.roles import define
from podium.session import shared_table

C = F.col
N = q.n()

EVENT_ROWS = """er AS (SELECT event_id, series_id, period, event_type, event_name, source_file, series_month,
        strftime(date_trunc('month', min(contest_date)), '%Y-%m-%d') AS first_date, count(*) AS contests FROM contests GROUP BY ALL)"""
STATS = f"""{EVENT_ROWS}, rs AS (SELECT event_id, count(*) AS results, count(DISTINCT entity_id) AS standings
        FROM star GROUP BY 1),
    es AS (SELECT er.*, coalesce(results, 0) AS results, coalesce(standings, 0) AS standings FROM er LEFT JOIN rs USING (event_id))"""


def event_heads(t):
    return t.contest_headers.groupBy("event_id", "series_id", "period").agg(
        F.date_format(F.trunc(F.min("contest_date"), "month"), "yyyy-MM-dd").alias("first_date"),
        F.count("*").alias("contests"),
    )


def event_rows(t):
    return event_heads(t).join(t.series, "series_id")


def stats(t, series=None):
    """Events with their counts; names and marks of their series are added last, so that they are not sent to meet the counts."""
    return ev.event_stats(event_heads(t), t.contest_headers, t.results).join(t.series if series is None else series, "series_id")


def marked(t):
    """Events with their counts and marks, written once.

    The rows are used several times; read from a table, they are not worked out for each use, and Spark does not test the
    marks of a series on every contest of it.
    """
    return shared_table(stats(t, ev.mark_views(t.series)), "marked")


def groups(t):
    """Canonical groups of all events, from the marked events."""
    return ev.canonical_groups(t.marked)


@query(
    "J02_left_chain_stats",
    f"""WITH {STATS} SELECT event_id, period, event_type, first_date, CAST(contests AS BIGINT) AS contests,
        CAST(results AS BIGINT) AS results, CAST(standings AS BIGINT) AS standings FROM es""",
)
def _(t):
    return stats(t).select("event_id", "period", "event_type", "first_date", "contests", "results", "standings")


STEM, ROOT = q.stem("source_file"), q.canonical_stem("source_file")
GROUPS = f"""{STATS}, mk AS (SELECT *, {STEM} AS stem, {ROOT} AS root, rtrim(regexp_replace({STEM}, '[0-9]+$', ''), '_') AS plain,
        {q.name_key(q.canonical_name('event_name'))} AS nm,
        ({ROOT} <> {STEM}) OR {q.view_name('event_name')} AS var FROM es),
    tw AS (SELECT *, count(*) OVER (PARTITION BY period, nm, first_date, plain) AS twins FROM mk),
    ky AS (SELECT *, CASE WHEN event_type = 'tns' AND series_month IS NOT NULL THEN 'tns:' || series_month
        WHEN twins > 1 AND nm <> '' AND plain <> '' THEN 'dated:' || nm || ':' || first_date || ':' || plain
        WHEN root <> '' THEN root ELSE 'event:' || CAST(event_id AS VARCHAR) END AS group_key FROM tw),
    gr AS (SELECT *, count(*) OVER g AS group_size, first_value(event_id) OVER w AS p_id, first_value(event_name) OVER w AS p_name
        FROM ky WINDOW g AS (PARTITION BY period, group_key), w AS (PARTITION BY period, group_key ORDER BY NOT var DESC,
            (root = stem) DESC, (contests > 0) DESC, results DESC, standings DESC, event_id DESC)),
    cg AS (SELECT event_id, period, event_type, event_name, group_key, CAST(group_size AS BIGINT) AS group_size,
        CASE WHEN group_size = 1 AND NOT var THEN event_id ELSE p_id END AS canonical_event_id,
        CASE WHEN group_size = 1 AND NOT var THEN event_name ELSE {q.canonical_name('p_name')} END AS canonical_name,
        group_size > 1 AND event_id <> p_id AS is_variant, CAST(contests AS BIGINT) AS contests, CAST(results AS BIGINT) AS results,
        CAST(standings AS BIGINT) AS standings FROM gr)"""


@query("C01_canonical_groups", f"WITH {GROUPS} SELECT * FROM cg")
def _(t):
    return groups(t)


@query(
    "W07_group_primary",
    f"""WITH {GROUPS} SELECT period, group_key, min(canonical_event_id) AS primary_id, {N} AS members
    FROM cg GROUP BY 1, 2""",
)
def _(t):
    return (
        groups(t)
        .groupBy("period", "group_key")
        .agg(F.min("canonical_event_id").alias("primary_id"), F.count("*").alias("members"))
    )


METRICS = f"""pe AS (SELECT DISTINCT event_id, period, boat_id AS p FROM results JOIN contest_headers USING (contest_id)),
    yp AS (SELECT period, p, count(*) AS c FROM pe GROUP BY 1, 2),
    mt AS (SELECT event_id, {N} AS participants, {q.n(cond="participant_type = 'helm'")} AS helms, {q.n(cond="participant_type = 'boat'")} AS boats,
        {q.n(cond='c = 1')} AS oneoffs FROM pe JOIN yp USING (period, p) JOIN boats ON boat_id = p GROUP BY 1),
    mr AS (SELECT *, {q.pct('helms', 'participants', 3)} AS helm_ratio, {q.pct('oneoffs', 'participants', 3)} AS oneoff_ratio FROM mt)"""


def metrics(t):
    # dealt by participant, as all that follows needs them: for being distinct, counted by period and given their type
    entries = (
        t.results.join(t.contest_headers, "contest_id")
        .select("event_id", "period", C("boat_id").alias("participant_id"))
        .where("period IS NOT NULL AND participant_id IS NOT NULL")
        .repartition("participant_id")
        .distinct()
    )
    people = t.boats.select(C("boat_id").alias("participant_id"), "participant_type")
    return ev.event_metrics(entries, people)


@query("J03_oneoff_metrics", f"WITH {METRICS} SELECT * FROM mr")
def _(t):
    return metrics(t)


LOCAL_RX = "|".join(ev.LOCAL_WORDS)
EXTERNAL_RX = "|".join(ev.EXTERNAL_WORDS)
SPECIAL = f"""{EVENT_ROWS}, {METRICS}, sn AS (SELECT er.event_id, er.period, event_name, event_type,
        coalesce(participants, 0) AS participants, coalesce(helm_ratio, 0) AS helm_ratio, coalesce(oneoff_ratio, 0) AS oneoff_ratio,
        event_type = 'championship' AS c, regexp_matches(lower(event_name), '{LOCAL_RX}') AS l,
        regexp_matches(lower(event_name), '{EXTERNAL_RX}') AS x FROM er LEFT JOIN mr USING (event_id)),
    sr AS (SELECT *, concat_ws(',', CASE WHEN c THEN 'event_type_championship' END, CASE WHEN l THEN 'special_local_keyword' END,
        CASE WHEN x THEN 'special_external_keyword' END,
        CASE WHEN participants >= 10 AND helm_ratio >= 0.8 THEN 'helm_dominated_large_event' END,
        CASE WHEN participants >= 12 AND oneoff_ratio >= 0.7 THEN 'mostly_oneoff_participants' END) AS reasons FROM sn),
    sp AS (SELECT event_id, period, event_type, event_name, CASE WHEN l OR (c AND contains(lower(event_name), 'women'))
        OR (NOT c AND NOT x) THEN 'special_local' ELSE 'special_external' END AS kind, reasons, participants, helm_ratio, oneoff_ratio
        FROM sr WHERE reasons <> '')"""


def specials(t):
    rows = event_rows(t).join(metrics(t), "event_id", "left")
    return ev.special_events(rows.fillna(0, ["participants", "helm_ratio", "oneoff_ratio"]))


@query("F05_special_events", f"WITH {SPECIAL} SELECT event_id, kind, reasons FROM sp")
def _(t):
    return specials(t).select("event_id", "kind", "reasons")


@query(
    "C11_special_event_review",
    f"""WITH {SPECIAL} SELECT event_id, period, event_name, kind, reasons, participants, helm_ratio, oneoff_ratio FROM sp
    ORDER BY oneoff_ratio DESC, participants DESC, period, event_name, event_id""",
)
def _(t):
    cols = ["event_id", "period", "event_name", "kind", "reasons", "participants", "helm_ratio", "oneoff_ratio"]
    return specials(t).select(*cols).orderBy(
        F.desc("oneoff_ratio"), F.desc("participants"), "period", "event_name", "event_id"
    )


# Events that leaderboards leave out: special by any of the five rules, or another view of an event that counts.
define(
    "skipped",
    ["contests", "star", "results", "contest_headers", "boats"],
    f"WITH {GROUPS}, {SPECIAL.removeprefix(EVENT_ROWS + ', ')} SELECT event_id FROM sp UNION SELECT event_id FROM cg WHERE is_variant",
)


define(
    "special_events",
    ["contests", "results", "contest_headers", "boats"],
    f"WITH {SPECIAL} SELECT event_id FROM sp",
)


def skip_flags(t):
    """(event_id, special, variant) of special events and of other views of an event."""
    special = specials(t).select("event_id", F.lit(True).alias("special"), F.lit(False).alias("variant"))
    variant = groups(t).where("is_variant").select("event_id", F.lit(False).alias("special"), F.lit(True).alias("variant"))
    return special.union(variant).groupBy("event_id").agg(F.max("special").alias("special"), F.max("variant").alias("variant"))


@query("U01_skip_set", "SELECT event_id FROM skipped")
def _(t):
    return skip_flags(t).select("event_id")


@query(
    "F01_analytic_scope",
    f"""SELECT period, event_type, {N} AS results, {q.n('DISTINCT contest_id')} AS contests FROM star
    WHERE event_id NOT IN (SELECT event_id FROM skipped) GROUP BY 1, 2""",
)
def _(t):
    kept = t.open_contests.select("contest_id", "period", "event_type")
    per = t.results.groupBy("contest_id").agg(F.count("*").alias("n"))
    return (
        per.join(kept, "contest_id")
        .groupBy("period", "event_type")
        .agg(F.sum("n").alias("results"), F.count("*").alias("contests"))
    )


WEEKLY_RX, CHAMP_RX = "|".join(ev.WEEKLY_WORDS), "|".join(ev.CHAMPIONSHIP_WORDS)
TITLE = """CASE series_id % 7 WHEN 0 THEN 'Thursday Night ' WHEN 1 THEN 'Glube ' WHEN 2 THEN 'One-Design Nationals '
    WHEN 3 THEN 'Race Week ' ELSE '' END || event_name AS title"""


@query(
    "F04_event_type_by_words",
    f"""WITH s AS (SELECT {TITLE}, source_file FROM series), k AS (SELECT lower(title || ' ' || source_file) AS x FROM s)
    SELECT CASE WHEN regexp_matches(x, '{WEEKLY_RX}') THEN 'tns' WHEN regexp_matches(x, '{CHAMP_RX}') THEN 'championship'
        ELSE 'trophy' END AS found_type, {N} AS series FROM k GROUP BY 1""",
)
def _(t):
    s = t.series.selectExpr(TITLE, "source_file")
    return s.groupBy(ev.event_type("title", "source_file").alias("found_type")).agg(F.count("*").alias("series"))


@query(
    "F06_excluded_text",
    f"""SELECT event_type, {N} AS series FROM series WHERE NOT regexp_matches(lower(event_name), 'ladies|overall|laser')
        AND length(event_name) > 4 GROUP BY 1""",
)
def _(t):
    name = F.lower("event_name")
    kept = t.series.where(~name.rlike("ladies|overall|laser") & (F.length("event_name") > 4))
    return kept.groupBy("event_type").agg(F.count("*").alias("series"))


TOKEN = """CASE WHEN contest_no IS NOT NULL THEN 'num:' || contest_no WHEN regexp_matches(contest_key, '[0-9]')
    THEN 'key:' || CAST(regexp_extract(contest_key, '[0-9]+') AS INT) ELSE 'date:' || contest_date END"""
RACES = f"""rc AS (SELECT event_id, event_type, count(DISTINCT {TOKEN}) AS logical_races, count(DISTINCT contest_date) AS dates
    FROM contests GROUP BY 1, 2)"""


@query("A21_logical_races", f"WITH {RACES} SELECT event_id, CAST(logical_races AS BIGINT) AS logical_races FROM rc")
def _(t):
    tokens = t.contest_headers.select("event_id", ev.race_token().alias("token")).distinct()
    return tokens.groupBy("event_id").agg(F.count("*").alias("logical_races"))


@query(
    "A22_shown_races",
    f"""WITH {RACES} SELECT event_id, CAST(logical_races AS BIGINT) AS logical_races, CAST(CASE WHEN event_type = 'tns' AND dates > 0
        THEN dates ELSE logical_races END AS BIGINT) AS shown_races FROM rc""",
)
def _(t):
    return ev.race_counts(t.contests)


NIGHTS = f"""nt AS (SELECT period, series_month AS month, {q.n('DISTINCT contest_date')} AS nights, {q.n('DISTINCT entity_id')} AS entities,
        {N} AS results FROM star WHERE event_type = 'tns' AND series_month IS NOT NULL AND event_id NOT IN (SELECT event_id FROM special_events) GROUP BY 1, 2)"""


def nights(t):
    # other views count too: the days of one series may stand on several pages
    weekly = exclude(t.contests.where("event_type = 'tns' AND series_month IS NOT NULL"), t.skipped.where("special"), on="event_id")
    keys = ["period", "series_month"]
    dates = weekly.select("contest_date", *keys, "contest_id")
    entries = t.results.select("contest_id", "entity_id").join(dates, "contest_id")
    sailed = entries.groupBy(*keys, "entity_id").agg(F.count("*").alias("n"))
    per_entity = sailed.groupBy(*keys).agg(F.count("*").alias("entities"), F.sum("n").alias("results"))
    # a night counts when somebody sailed it
    held = entries.select(*keys, "contest_date").distinct().groupBy(*keys).agg(F.count("*").alias("nights"))
    return per_entity.join(held, keys).withColumnRenamed("series_month", "month")


@query("A23_series_month_stats", f"WITH {NIGHTS} SELECT * FROM nt")
def _(t):
    return nights(t)


@query(
    "A24_period_rollup",
    f"""WITH {NIGHTS} SELECT period, CAST(sum(nights) AS BIGINT) AS nights, max(entities) AS most_entities,
        {q.pct('sum(results)', 'sum(nights)')} AS results_per_night FROM nt GROUP BY 1""",
)
def _(t):
    return (
        nights(t)
        .groupBy("period")
        .agg(
            F.sum("nights").alias("nights"),
            F.max("entities").alias("most_entities"),
            half_up(F.sum("results"), F.sum("nights"), 1).alias("results_per_night"),
        )
    )


@query(
    "L04_calendar_order",
    f"""WITH {NIGHTS} SELECT month, CAST(CASE month WHEN 'may' THEN 5 WHEN 'june' THEN 6 WHEN 'july' THEN 7 WHEN 'august' THEN 8
        WHEN 'september' THEN 9 ELSE 99 END AS INTEGER) AS position, period, nights FROM nt ORDER BY 2, month, period""",
)
def _(t):
    placed = nights(t).withColumn("position", times.month_number("month"))
    return placed.select("month", "position", "period", "nights").orderBy("position", "month", "period")


def _list(cond: str) -> str:
    months = ", ".join(f"'{m}'" for m in ev.EXPECTED_MONTHS)
    return f"array_to_string([x for x in [{months}] if {cond}], ', ')"


@query(
    "C08_series_completeness",
    f"""WITH w AS (SELECT period, series_month, contest_date, NULL AS races_sailed FROM contests WHERE event_type = 'tns'
        UNION ALL SELECT period, series_month, NULL, races_sailed FROM announced WHERE event_type = 'tns' AND list_no % 5 = 0),
    a AS (SELECT period, coalesce(list(DISTINCT series_month) FILTER (series_month IS NOT NULL), []) AS m, CASE WHEN count(contest_date) > 0 THEN count(DISTINCT contest_date) ELSE coalesce(max(races_sailed), 0) END AS nights FROM w GROUP BY 1),
    b AS (SELECT *, {_list('list_contains(m, x)')} AS months_present, {_list('NOT list_contains(m, x)')} AS months_missing,
        CASE WHEN list_contains(m, 'may') THEN 'unexpected months: may' END AS extra FROM a),
    c AS (SELECT *, CASE WHEN months_present = '' THEN 0 ELSE len(string_split(months_present, ',')) END AS found FROM b),
    d AS (SELECT *, concat_ws(' | ', CASE WHEN months_missing <> '' THEN 'missing months: ' || months_missing END, extra,
        CASE WHEN found <> 4 THEN 'expected 4 monthly series, found ' || found END,
        CASE WHEN nights < 12 OR nights > 17 THEN 'race nights = ' || nights || ' (expected 12-16)' END) AS notes FROM c)
    SELECT period, CAST(found AS INTEGER) AS months_found, months_present, months_missing, CAST(nights AS BIGINT) AS nights,
        CASE WHEN notes = '' THEN 'ok' ELSE 'review' END AS status, notes FROM d""",
)
def _(t):
    announced = t.announced.where("event_type = 'tns' AND list_no % 5 = 0")
    return ev.series_completeness(t.contests.where("event_type = 'tns'"), announced)


@query(
    "U04_missing_months",
    f"""WITH have AS (SELECT DISTINCT period, series_month AS month FROM contests WHERE event_type = 'tns' AND series_month IS NOT NULL
        AND contest_no = 1), want AS (SELECT DISTINCT period, m.month FROM contests,
        (VALUES ('june'), ('july'), ('august'), ('september'), ('october')) m(month) WHERE event_type = 'tns')
    SELECT period, month, 'missing' AS problem FROM (SELECT * FROM want EXCEPT SELECT * FROM have)
    UNION ALL SELECT period, month, 'unexpected' FROM (SELECT * FROM have EXCEPT SELECT * FROM want)""",
)
def _(t):
    weekly = t.contests.where("event_type = 'tns'")
    have = weekly.where("series_month IS NOT NULL AND contest_no = 1").select("period", C("series_month").alias("month"))
    wanted = F.array(*[F.lit(m) for m in (*ev.EXPECTED_MONTHS, "october")])
    want = weekly.select("period").distinct().select("period", F.explode(wanted).alias("month"))
    missing = want.exceptAll(have.distinct()).withColumn("problem", F.lit("missing"))
    return missing.unionByName(have.distinct().exceptAll(want).withColumn("problem", F.lit("unexpected")))


@query(
    "C14_season_mart",
    f"""WITH {GROUPS}, s AS (SELECT c.*, nm, event_id IN (SELECT event_id FROM special_events) AS special FROM cg c JOIN (SELECT event_id, nm FROM mk) k USING (event_id))
    SELECT period, {q.n(cond='NOT is_variant')} AS canonical_events, {q.n(cond="NOT is_variant AND event_type = 'tns'")} AS tns_events, {q.n("DISTINCT nm", "NOT is_variant AND event_type = 'trophy'")} AS trophy_series,
        {q.n(cond="NOT is_variant AND event_type = 'championship'")} AS championship_events, {q.n(cond='special')} AS special_events, {q.n(cond='NOT is_variant AND NOT special')} AS open_events,
        {q.n('DISTINCT nm')} AS unique_series, CAST(sum(contests) AS BIGINT) AS contests, CAST(sum(results) AS BIGINT) AS results
    FROM s GROUP BY 1""",
)
def _(t):
    root = text.name_key(text.canonical_name("event_name"), drop="'\"`|")
    special = t.skipped.where("special").select("event_id", "special")
    marked = groups(t).withColumn("root", root).join(special, "event_id", "left").fillna(False, ["special"])
    own = ~C("is_variant")
    by_root = marked.groupBy("period", "root").agg(
        count_if(own).alias("canonical_events"),
        count_if(own & (C("event_type") == "tns")).alias("tns_events"),
        F.max((own & (C("event_type") == "trophy")).cast("long")).alias("trophy_series"),
        count_if(own & (C("event_type") == "championship")).alias("championship_events"),
        count_if(C("special")).alias("special_events"),
        count_if(own & ~C("special")).alias("open_events"),
        F.sum("contests").alias("contests"),
        F.sum("results").alias("results"),
    )
    sums = [c for c in by_root.columns if c not in ("period", "root")]
    return by_root.groupBy("period").agg(F.count("*").alias("unique_series"), *[F.sum(c).alias(c) for c in sums])
