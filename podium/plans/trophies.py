"""The trophy mart: winners over all years and views, historical ones, owners at the time, course data, and event wins."""

from __future__ import annotations

from pyspark.sql import functions as F

from podium.functions import text
from podium.operators import boards
from podium.operators import history as hi
from podium.operators.measures import count_if, half_up
from podium.operators.ranking import keep_first, top_k
from podium.operators.scope import exclude
from podium.plans import dialect as q
from podium.plans.enrichment import DAILY, daily
from podium.plans.events import GROUPS, groups
from podium.plans.marts import STANDINGS, standings
from podium.plans.registry import query
from podium.session import shared_table

C = F.col
N = q.n()

# Parameters of this binding: canonical names of trophies, and courses found by a part of the name.
LABELS = {"Cup 1": "Harbour Cup", "Cup 2": "Harbour Cup", "Laser Regatta Cup 7": "Bay Trophy"}
COURSES = (("cup 1", "#1 Outer", 16.5), ("laser", "#2 Inner", 4.25), ("cup 7", "#4 Bay", 9.0))
TYPES = ("trophy", "championship")
LEAST_YEARS = 3
# Winners kept on file: a row for some of the series, several for one trophy and year.
ON_FILE = """series_id AS row_no, CASE series_id % 10 WHEN 0 THEN 'Harbour Cup' WHEN 1 THEN 'Bay Trophy' WHEN 2 THEN 'Old Plate' ELSE 'Cup ' || CAST(CAST(floor(series_id / 4) AS BIGINT) AS STRING) END AS label,
    CAST(1980 + series_id % 21 AS INT) AS period, CASE WHEN series_id % 7 > 0 THEN 'Skipper ' || CAST(series_id % 30 AS STRING) ELSE '' END AS skipper,
    CASE WHEN series_id % 3 = 0 THEN upper('Supplier#' || lpad(CAST(series_id % 40 AS STRING), 9, '0')) WHEN series_id % 3 = 1 THEN 'Unknown ' || CAST(series_id AS STRING) END AS boat_name,
    CASE WHEN series_id % 4 = 0 THEN CAST(1900 + series_id % 80 AS INT) END AS first_awarded"""


def on_file(t):
    return t.series.where("series_id % 10 < 4").selectExpr(*[x.strip() for x in _split(ON_FILE)])


def _split(columns: str) -> list[str]:
    """Select items of a binding, cut at commas outside brackets."""
    items, depth, start = [], 0, 0
    for k, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            items.append(columns[start:k])
            start = k + 1
    return [*items, columns[start:]]


def trophy_events(t):
    """(event_id, doc_id, label, name, event_type) of the views of every event that is awarded."""
    grouped = groups(t)
    awarded = grouped.where("event_id = canonical_event_id").where(C("event_type").isin(*TYPES))
    awarded = awarded.select(C("event_id").alias("doc_id"), C("canonical_name").alias("name"), "event_type")
    named = awarded.withColumn("label", text.map_label("name", LABELS))
    return grouped.select("event_id", C("canonical_event_id").alias("doc_id")).join(named, "doc_id")


def known_winners(t, views):
    """One winner of each trophy and year from the results: standings first, the races of events that have none."""
    contests = t.contest_headers.join(views, "event_id").select("contest_id", "event_id", "period", "doc_id", "label")
    scored = t.contests.where("event_type <> 'trophy'").select("event_id", "period").distinct()
    first = standings(t).where("rank = 1").join(scored, "event_id").join(views, "event_id")
    first = hi.preferred_winner(first.select("doc_id", "period", "event_id", "entity_id", C("points").alias("nett"), "scope"), ["doc_id", "period"])
    raced = t.ranked.where("rank = 1").join(contests, "contest_id")
    raced = raced.select("doc_id", "period", "event_id", "entity_id", C("points").cast("long").alias("nett"), "contest_id")
    second = keep_first(raced, ["doc_id", "period"], [C("nett"), C("contest_id")]).drop("contest_id").withColumn("scope", F.lit("race"))
    both = hi.with_fallback(first, second, ["doc_id"]).join(views.select("doc_id", "label").distinct(), "doc_id")
    return keep_first(both.select("label", "period", "doc_id", "event_id", "entity_id", "nett"), ["label", "period"], [C("doc_id")])


def all_winners(t, views):
    """Winners from the results, then those on file for the years the results do not know; names as of the year."""
    known = known_winners(t, views).select("label", "period", "event_id", "entity_id", "nett", F.lit("db").alias("source"))
    filed = keep_first(on_file(t).drop("first_awarded"), ["label", "period"], [C("row_no")])
    boats = t.entities.select(F.lower("entity_name").alias("boat_key"), C("entity_id"))
    past = filed.withColumn("boat_key", F.lower("boat_name")).join(boats, "boat_key", "left")
    past = past.select("label", "period", F.lit(None).cast("long").alias("event_id"), "entity_id", F.lit(None).cast("long").alias("nett"),
                       F.lit("historical").alias("source"), "skipper", "boat_name")
    known = known.withColumn("skipper", F.lit(None).cast("string")).withColumn("boat_name", F.lit(None).cast("string"))
    both = hi.with_fallback(known, past, ["label", "period"])
    owners = hi.owner_at(both.where("entity_id IS NOT NULL").select("entity_id", "period").distinct(), t.tenures).drop("covered")
    named = both.join(owners, ["entity_id", "period"], "left").join(t.entities.select("entity_id", "entity_name"), "entity_id", "left")
    filed_name = F.when(C("skipper") != "", F.coalesce("owner", "skipper")).otherwise("")
    shown = F.when(C("source") == "historical", filed_name).otherwise(F.coalesce("owner", "entity_name"))
    return named.select(
        "label", "period", "event_id", shown.alias("display_name"), F.coalesce("entity_name", "boat_name").alias("boat_name"), "entity_id", "nett", "source"
    )


TROPHIES = f"""{GROUPS}, {STANDINGS}, hs AS (SELECT {ON_FILE} FROM series WHERE series_id % 10 < 4),
    tv AS (SELECT c.event_id, c.canonical_event_id AS doc_id, p.canonical_name AS name, p.event_type, CASE p.canonical_name WHEN 'Cup 1' THEN 'Harbour Cup' WHEN 'Cup 2' THEN 'Harbour Cup' WHEN 'Laser Regatta Cup 7' THEN 'Bay Trophy'
        ELSE p.canonical_name END AS label FROM cg c JOIN cg p ON p.event_id = c.canonical_event_id AND p.canonical_event_id = p.event_id WHERE p.event_type IN ('trophy', 'championship')),
    w1 AS (SELECT doc_id, period, event_id, entity_id, nett FROM (SELECT doc_id, x.period, event_id, entity_id, points AS nett, row_number() OVER (PARTITION BY doc_id, x.period ORDER BY CASE scope WHEN 'overall' THEN 0 ELSE 1 END,
        points, entity_id, event_id) AS rn FROM ss JOIN tv USING (event_id) JOIN (SELECT DISTINCT event_id, period FROM contests WHERE event_type <> 'trophy') x USING (event_id) WHERE rank = 1) WHERE rn = 1),
    w2 AS (SELECT doc_id, period, event_id, entity_id, nett FROM (SELECT doc_id, period, event_id, entity_id, CAST(points AS BIGINT) AS nett, row_number() OVER (PARTITION BY doc_id, period ORDER BY points, contest_id) AS rn
        FROM ranked JOIN contest_headers USING (contest_id) JOIN tv USING (event_id) WHERE rank = 1) WHERE rn = 1 AND doc_id NOT IN (SELECT doc_id FROM w1)),
    w3 AS (SELECT label, period, event_id, entity_id, nett FROM (SELECT *, row_number() OVER (PARTITION BY label, period ORDER BY doc_id) AS rn FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2)
        JOIN (SELECT DISTINCT doc_id, label FROM tv) USING (doc_id)) WHERE rn = 1),
    h1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, period ORDER BY row_no) AS rn FROM hs) WHERE rn = 1 AND (label, period) NOT IN (SELECT (label, period) FROM w3)),
    w4 AS (SELECT label, period, event_id, entity_id, nett, 'db' AS source, CAST(NULL AS VARCHAR) AS skipper, CAST(NULL AS VARCHAR) AS boat_name FROM w3
        UNION ALL SELECT label, period, NULL, entity_id, NULL, 'historical', skipper, boat_name FROM h1 LEFT JOIN entities ON lower(entity_name) = lower(boat_name)),
    w5 AS (SELECT w4.*, (SELECT owner FROM tenures o WHERE o.entity_id = w4.entity_id ORDER BY w4.period BETWEEN coalesce(start_period, 0) AND coalesce(end_period, 9999) DESC,
        CASE WHEN w4.period BETWEEN coalesce(start_period, 0) AND coalesce(end_period, 9999) THEN 1 ELSE -1 END * coalesce(start_period, 0),
        CASE WHEN w4.period BETWEEN coalesce(start_period, 0) AND coalesce(end_period, 9999) THEN 1 ELSE -1 END * tenure_id LIMIT 1) AS held_by, entity_name FROM w4 LEFT JOIN entities USING (entity_id)),
    aw AS (SELECT label, period, event_id, CASE WHEN source = 'db' THEN coalesce(held_by, entity_name) WHEN skipper <> '' THEN coalesce(held_by, skipper) ELSE '' END AS display_name,
        coalesce(entity_name, boat_name) AS boat_name, entity_id, nett, source FROM w5)"""


def kept_trophies(t, views, winners):
    """Trophies on file, and others with winners in at least LEAST_YEARS years."""
    types = views.groupBy("label").agg(F.min_by("event_type", "doc_id").alias("event_type"))
    filed = on_file(t).groupBy("label").agg(F.min("first_awarded").alias("filed_first"), F.lit(True).alias("verified"))
    per = winners.groupBy("label").agg(
        F.count("*").alias("winners"), count_if(C("source") == "historical").alias("historical"), F.min("period").alias("first"), F.max("period").alias("last_awarded")
    )
    mart = per.join(types, "label", "left").join(filed, "label", "left")
    verified = F.coalesce("verified", F.lit(False))
    return mart.where(verified | (C("winners") >= LEAST_YEARS)).select(
        "label", F.coalesce("event_type", F.lit("trophy")).alias("event_type"), verified.alias("verified"), "winners", "historical",
        F.coalesce("filed_first", "first").alias("first_awarded"), "last_awarded",
    )


KEPT = f"""{TROPHIES}, tk AS (SELECT label, coalesce((SELECT arg_min(event_type, doc_id) FROM tv WHERE tv.label = aw.label), 'trophy') AS event_type, label IN (SELECT label FROM hs) AS verified, {N} AS winners,
        {q.n(cond="source = 'historical'")} AS historical, coalesce((SELECT min(first_awarded) FROM hs WHERE hs.label = aw.label), min(period)) AS first_awarded, max(period) AS last_awarded
        FROM aw GROUP BY label HAVING count(*) >= {LEAST_YEARS} OR label IN (SELECT label FROM hs))"""


@query("C15_trophy_mart", f"WITH {KEPT} SELECT * FROM tk")
def _(t):
    views = trophy_events(t)
    return kept_trophies(t, views, all_winners(t, views))


@query("C15_trophy_winners", f"WITH {KEPT} SELECT aw.* FROM aw WHERE label IN (SELECT label FROM tk)")
def _(t):
    views = trophy_events(t)
    winners = shared_table(all_winners(t, views), "winners")
    return winners.join(kept_trophies(t, views, winners).select("label"), "label", "left_semi")


def course_history(t):
    """Per course and year: finishers, non-finishers, the winner, and the weather of the day, of the event that comes first."""
    found = hi.fixed_course("name", COURSES)
    views = trophy_events(t).withColumn("c", found).where("c IS NOT NULL").select("event_id", "doc_id", "c.*")
    contests = t.contest_headers.drop("distance_nm").join(views, "event_id")
    rows = t.ranked.join(contests.select("contest_id", "period", "day", "doc_id", "course", "distance_nm"), "contest_id")
    yearly = hi.yearly_course_times(rows, ["course", "distance_nm", "period", "doc_id"])
    day = rows.groupBy("course", "period", "doc_id").agg(F.min(F.struct("rank", "contest_id", "day"))["day"].alias("day"))
    both = yearly.join(day, ["course", "period", "doc_id"])
    first = keep_first(both.select("course", "distance_nm", "period", "doc_id", "finishers", "unfinished", "winner_s", "winner_id", "day"), ["course", "distance_nm", "period"], [C("doc_id")])
    weather = daily(t).select("day", (C("mean_c") / 100).alias("wind_kmh"), "gust_c", "sky", "temp_c")
    return first.drop("doc_id").join(weather, "day", "left")


HISTORY = f"""{TROPHIES}, {DAILY}, cv AS (SELECT event_id, doc_id, CASE WHEN contains(lower(name), 'cup 1') THEN '#1 Outer' WHEN contains(lower(name), 'laser') THEN '#2 Inner' WHEN contains(lower(name), 'cup 7') THEN '#4 Bay' END AS course,
        CASE WHEN contains(lower(name), 'cup 1') THEN 16.5e0 WHEN contains(lower(name), 'laser') THEN 4.25e0 WHEN contains(lower(name), 'cup 7') THEN 9e0 END AS nm FROM tv),
    cr AS (SELECT course, nm, period, doc_id, day, contest_id, rank, elapsed_s, entity_id, coalesce(status IN ('DNF','DNS','OCS','DSQ','RAF','DNC','RET'), false) AS gone,
        elapsed_s > greatest(1200, CAST(floor(nm / 7.5e0 * 3600) AS INT)) AND elapsed_s < 36000 AS fair FROM ranked JOIN contest_headers USING (contest_id) JOIN cv USING (event_id) WHERE course IS NOT NULL),
    cy AS (SELECT course, nm AS distance_nm, period, doc_id, {q.n(cond='NOT gone AND fair')} AS finishers, {q.n(cond='gone')} AS unfinished, arg_min(elapsed_s, contest_id) FILTER (NOT gone AND fair AND rank = 1) AS winner_s,
        arg_min(entity_id, contest_id) FILTER (NOT gone AND fair AND rank = 1) AS winner_id, arg_min(day, rank * 100000000 + contest_id) AS day FROM cr GROUP BY 1, 2, 3, 4),
    ch AS (SELECT cy.* EXCLUDE (doc_id), mean_c / 100e0 AS wind_kmh, gust_c, sky, temp_c FROM cy LEFT JOIN dw USING (day) QUALIFY row_number() OVER (PARTITION BY course, period ORDER BY doc_id) = 1)"""


@query("C15_course_history", f"WITH {HISTORY} SELECT * FROM ch")
def _(t):
    return course_history(t)


@query(
    "C15_course_data",
    f"""WITH {HISTORY}, tm AS (SELECT *, row_number() OVER (PARTITION BY course ORDER BY winner_s, period) AS f, row_number() OVER (PARTITION BY course ORDER BY winner_s DESC, period) AS l,
        row_number() OVER (PARTITION BY course ORDER BY winner_s) - 1 AS i, count(*) OVER (PARTITION BY course) AS n FROM ch WHERE winner_s IS NOT NULL)
    SELECT c.course, distance_nm, CAST(count(winner_s) AS BIGINT) AS timed, {q.pct('CAST(sum(finishers) AS BIGINT)', 'count(*)')} AS avg_finishers, any_value(fastest_s) AS fastest_s, any_value(fastest_period) AS fastest_period,
        any_value(fastest_id) AS fastest_id, any_value(slowest_s) AS slowest_s, any_value(slowest_period) AS slowest_period, any_value(median) AS median_s,
        {q.n(cond='winner_s IS NOT NULL AND wind_kmh < 15')} AS light_n, CAST(sum(winner_s) FILTER (wind_kmh < 15) // count(winner_s) FILTER (wind_kmh < 15) AS BIGINT) AS light_s,
        {q.n(cond='winner_s IS NOT NULL AND wind_kmh BETWEEN 15 AND 25')} AS moderate_n, CAST(sum(winner_s) FILTER (wind_kmh BETWEEN 15 AND 25) // count(winner_s) FILTER (wind_kmh BETWEEN 15 AND 25) AS BIGINT) AS moderate_s,
        {q.n(cond='winner_s IS NOT NULL AND wind_kmh > 25')} AS heavy_n, CAST(sum(winner_s) FILTER (wind_kmh > 25) // count(winner_s) FILTER (wind_kmh > 25) AS BIGINT) AS heavy_s
    FROM ch c LEFT JOIN (SELECT course, max(winner_s) FILTER (f = 1) AS fastest_s, max(period) FILTER (f = 1) AS fastest_period, max(winner_id) FILTER (f = 1) AS fastest_id, max(winner_s) FILTER (l = 1) AS slowest_s,
        max(period) FILTER (l = 1) AS slowest_period, max(winner_s) FILTER (i = n // 2) AS median FROM tm GROUP BY 1) x ON x.course = c.course GROUP BY 1, 2""",
)
def _(t):
    history = shared_table(course_history(t), "courses")
    classes = {
        "light": C("wind_kmh") < hi.LIGHT_KMH,
        "moderate": C("wind_kmh").between(hi.LIGHT_KMH, hi.HEAVY_KMH),
        "heavy": C("wind_kmh") > hi.HEAVY_KMH,
    }
    aggs = []
    for name, cond in classes.items():
        timed = F.when(cond, C("winner_s"))
        aggs += [F.count(timed).alias(f"{name}_n"), F.when(F.count(timed) > 0, F.call_function("div", F.sum(timed), F.count(timed))).alias(f"{name}_s")]
    courses = history.groupBy("course", "distance_nm").agg(
        F.count("winner_s").alias("timed"), half_up(F.sum("finishers"), F.count("*"), 1).alias("avg_finishers"), *aggs
    )
    best = hi.records(history.withColumn("series_id", F.lit(0)), ["course"]).select("course", "fastest_s", "fastest_period", "fastest_id", "slowest_s", "slowest_period")
    middle = boards.upper_median(history, ["course"], "winner_s").select("course", C("median").alias("median_s"))
    return courses.join(best, "course", "left").join(middle, "course", "left")


EVENT_WINS = f"""{GROUPS}, {STANDINGS}, ew AS (SELECT entity_id, count(DISTINCT canonical_event_id) AS wins FROM ss JOIN cg USING (event_id)
        WHERE rank = 1 AND event_id NOT IN (SELECT event_id FROM special_events) GROUP BY 1),
    own AS (SELECT entity_id, coalesce(owner, 'boat:' || CAST(entity_id AS VARCHAR)) AS owner_key FROM entities)"""


def event_wins(t):
    """Events each entity won the standings of, special ones left out; the views of an event count once."""
    won = exclude(standings(t).where("rank = 1").select("event_id", "entity_id"), t.skipped.where("special"), on="event_id")
    once = won.join(groups(t).select("event_id", "canonical_event_id"), "event_id").select("entity_id", "canonical_event_id").distinct()
    return once.groupBy("entity_id").agg(F.count("*").alias("wins"))


@query("A20_distinct_event_wins", f"WITH {EVENT_WINS} SELECT entity_id, CAST(wins AS BIGINT) AS wins FROM ew")
def _(t):
    return event_wins(t)


@query(
    "A18_owner_trophies",
    f"""WITH {EVENT_WINS} SELECT owner_key, {N} AS members, CAST(sum(wins) AS BIGINT) AS wins
    FROM ew JOIN own USING (entity_id) GROUP BY 1 ORDER BY wins DESC, owner_key LIMIT 25""",
)
def _(t):
    return top_k(boards.rollup_sum(event_wins(t), t.entities, ["wins"]), [F.desc("wins"), C("owner_key")], 25)
