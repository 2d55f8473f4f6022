"""Audits of the loaded tables and of the marts made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.functions import identifiers as idn
from podium.functions import text
from podium.operators.measures import count_if
from podium.plans import dialect as q
from podium.plans.events import STATS
from podium.plans.pages import SUFFIX
from podium.plans.registry import BUILDERS, ORACLES, query
from podium.sources import files

C = F.col
N = q.n()


def audited_events(t):
    """All events with the counts of their races, results and standings: those sailed, and those announced."""
    none = F.lit(None)
    sailed = t.marked.select(
        "event_id", "period", "event_name", C("contests").alias("races"), "results", "standings",
        none.cast("int").alias("entries"), none.cast("int").alias("races_sailed"), none.cast("string").alias("publication_status"),
    )
    zero = F.lit(0).cast("long")
    listed = t.announced.where("list_no % 5 = 0").select(
        "event_id", "period", "event_name", zero.alias("races"), zero.alias("results"), zero.alias("standings"), "entries", "races_sailed", "publication_status"
    )
    return sailed.unionByName(listed)


EVENTS = f"""{STATS}, ae AS (SELECT event_id, period, event_name, contests AS races, results, standings, CAST(NULL AS INTEGER) AS entries, CAST(NULL AS INTEGER) AS races_sailed, CAST(NULL AS VARCHAR) AS publication_status FROM es
        UNION ALL SELECT event_id, period, event_name, 0, 0, 0, entries, races_sailed, publication_status FROM announced WHERE list_no % 5 = 0),
    af AS (SELECT *, coalesce(entries, 0) > 0 AND coalesce(races_sailed, 0) = 0 AND coalesce(publication_status, '') = 'as-of' AS provisional FROM ae)"""


def provisional():
    """An entry list that was published before anything was sailed."""
    return (F.coalesce("entries", F.lit(0)) > 0) & (F.coalesce("races_sailed", F.lit(0)) == 0) & (F.coalesce("publication_status", F.lit("")) == "as-of")


def untouched():
    return (C("races") == 0) & (C("standings") == 0)


@query(
    "U02_event_issues",
    f"""WITH {EVENTS}, i AS (SELECT event_id, CASE WHEN contains(event_name, '??') OR contains(event_name, '##') THEN 'suspicious_punctuation' ELSE 'double_spaces' END AS issue FROM af
        WHERE contains(event_name, '??') OR contains(event_name, '##') OR contains(event_name, '  ')
        UNION SELECT event_id, 'no_races_or_standings' FROM af WHERE races = 0 AND standings = 0 AND NOT provisional
        UNION SELECT event_id, 'provisional_entry_list' FROM af WHERE races = 0 AND standings = 0 AND provisional
        UNION SELECT event_id, 'event_has_no_results' FROM af WHERE races > 0 AND results = 0 AND standings = 0)
    SELECT event_id, issue, {q.collapse('event_name')} AS event_name, period, CAST(races AS BIGINT) AS races, CAST(standings AS BIGINT) AS standings FROM i JOIN af USING (event_id)""",
)
def _(t):
    name = C("event_name")
    odd = F.contains(name, F.lit("??")) | F.contains(name, F.lit("##"))
    checks = F.array_compact(
        F.array(
            F.when(odd, "suspicious_punctuation").when(F.contains(name, F.lit("  ")), "double_spaces"),
            F.when(untouched(), F.when(provisional(), "provisional_entry_list").otherwise("no_races_or_standings")),
            F.when((C("races") > 0) & (C("results") == 0) & (C("standings") == 0), "event_has_no_results"),
        )
    )
    # one pass over the events instead of one scan per check
    return audited_events(t).select("event_id", F.explode(checks).alias("issue"), text.collapse("event_name").alias("event_name"), "period", "races", "standings")


COUNTERS = f"""WITH {EVENTS} SELECT 'boats' AS counter, {N} AS n FROM boats UNION ALL SELECT 'boats_without_class', {q.n(cond='raw_class IS NULL')} FROM boats
    UNION ALL SELECT 'boats_without_sail', {q.n(cond='sail IS NULL')} FROM boats
    UNION ALL SELECT 'placeholder_sails', {q.n(cond=f"sail IS NOT NULL AND {q.placeholder('sail')}")} FROM boats
    UNION ALL SELECT 'contests', {N} FROM contest_headers UNION ALL SELECT 'contests_without_results', {N} FROM contest_headers WHERE contest_id NOT IN (SELECT contest_id FROM results)
    UNION ALL SELECT 'results', {N} FROM results UNION ALL SELECT 'helm_results', {N} FROM results JOIN entities USING (entity_id) WHERE participant_type = 'helm'
    UNION ALL SELECT 'boat_results', {N} FROM results JOIN entities USING (entity_id) WHERE participant_type = 'boat'
    UNION ALL SELECT 'results_without_boat', {N} FROM results WHERE boat_id NOT IN (SELECT boat_id FROM boats WHERE raw_class IS NOT NULL)
    UNION ALL SELECT 'tenures', {N} FROM tenures UNION ALL SELECT 'owners', {q.n('DISTINCT owner')} FROM tenures
    UNION ALL SELECT 'participants', {N} FROM entities UNION ALL SELECT 'pages', {N} FROM pages
    UNION ALL SELECT 'events', {N} FROM af UNION ALL SELECT 'empty_events', {q.n(cond='races = 0 AND standings = 0 AND NOT provisional')} FROM af
    UNION ALL SELECT 'provisional_events', {q.n(cond='races = 0 AND standings = 0 AND provisional')} FROM af
    UNION ALL SELECT 'weekly_periods', {q.n('DISTINCT period')} FROM contests WHERE event_type = 'tns'
    UNION ALL SELECT 'listed_files', {N} FROM series UNION ALL SELECT 'listed_assets', {q.n(cond='series_id % 6 BETWEEN 1 AND 4')} FROM series"""


def counters(t):
    """The twenty audit counters as (counter, n) rows; each table is scanned once."""

    def long(df: DataFrame, **cols) -> DataFrame:
        one = df.agg(*[c.alias(k) for k, c in cols.items()])
        pairs = ", ".join(f"'{k}', {k}" for k in cols)
        return one.select(F.expr(f"stack({len(cols)}, {pairs}) AS (counter, n)"))

    helm, boat = C("participant_type") == "helm", C("participant_type") == "boat"
    per = t.results.groupBy("entity_id", "boat_id").agg(F.count("*").alias("n"))
    classed = t.boats.where("raw_class IS NOT NULL").select("boat_id", F.lit(True).alias("classed"))
    typed = per.join(t.entities, "entity_id", "left").join(classed, "boat_id", "left")
    empty = t.contest_headers.join(t.results.select("contest_id").distinct(), "contest_id", "left_anti")
    listed = t.series.selectExpr("series_id", SUFFIX.split(", ", 1)[1])
    zero = F.lit(0)
    parts = [
        long(
            t.boats,
            boats=F.count("*"),
            boats_without_class=count_if(C("raw_class").isNull()),
            boats_without_sail=count_if(C("sail").isNull()),
            placeholder_sails=count_if(C("sail").isNotNull() & idn.is_placeholder("sail")),
        ),
        long(t.contest_headers, contests=F.count("*")),
        long(empty, contests_without_results=F.count("*")),
        long(
            typed,
            results=F.coalesce(F.sum("n"), zero),
            helm_results=F.coalesce(F.sum(F.when(helm, C("n"))), zero),
            boat_results=F.coalesce(F.sum(F.when(boat, C("n"))), zero),
            results_without_boat=F.coalesce(F.sum(F.when(C("classed").isNull(), C("n"))), zero),
        ),
        long(t.tenures, tenures=F.count("*")),
        long(t.tenures.select("owner").where("owner IS NOT NULL").distinct(), owners=F.count("*")),
        long(t.entities, participants=F.count("*")),
        long(t.pages, pages=F.count("*")),
        long(
            audited_events(t),
            events=F.count("*"),
            empty_events=count_if(untouched() & ~provisional()),
            provisional_events=count_if(untouched() & provisional()),
        ),
        long(t.contests.where("event_type = 'tns'").select("period").distinct(), weekly_periods=F.count("*")),
        long(listed, listed_files=F.count("*"), listed_assets=count_if(files.file_type("path") != "html")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("C07_quality_summary", COUNTERS)
def _(t):
    return counters(t)


# Fixed values of this binding: the least each counter and each mart must reach, and the columns a mart must have.
LEAST = {"boats": 100, "contests": 1000, "results": 5000, "participants": 5, "pages": 30, "tenures": 100, "empty_events": 1, "events": 700}
LEAST_ROWS = {"search": 500, "trophies": 30}
REQUIRED = {"boats": ("boat_id", "name", "owner"), "wins": ("entity_id", "wins"), "search": ("kind", "keywords"), "trophies": ("label", "first_awarded")}
NOT_EMPTY = ("wins", "avg_finish", "fleet")


def marts(t) -> dict[str, DataFrame]:
    """The marts that the checks look at."""
    return {"boats": t.boats} | {name: BUILDERS[key](t) for name, key in MARTS.items()}


def _known() -> str:
    columns = {"boats": ("boat_id", "name", "raw_class", "sail"), "wins": ("entity_id", "wins"), "search": ("kind", "keywords"), "trophies": ("label", "first_awarded")}
    rows = [(f"{name}.{c}", c in columns[name]) for name, wanted in REQUIRED.items() for c in wanted]
    return " UNION ALL ".join(f"SELECT 'required_key', '{name}', {str(ok).lower()}, {int(ok)}" for name, ok in rows)


MARTS = {"search": "U05_search_index", "wins": "L01_win_leaderboard", "avg_finish": "A06_field_normalised_finish", "fleet": "A09_fleet_by_period", "trophies": "C15_trophy_mart"}
CHECKS = f"""SELECT 'minimum' AS kind, counter AS check_name, n >= least AS ok, n AS observed FROM ({COUNTERS}) JOIN (VALUES {', '.join(f"('{k}', {v})" for k, v in LEAST.items())}) x(counter, least) USING (counter)
    {' '.join(f"UNION ALL SELECT 'minimum', '{name} rows', count(*) >= {rows}, count(*) FROM ({ORACLES[MARTS[name]]})" for name, rows in LEAST_ROWS.items())}
    {' '.join(f"UNION ALL SELECT 'not_empty', '{name}', count(*) > 0, count(*) FROM (SELECT * FROM ({ORACLES[MARTS[name]]}) LIMIT 1)" for name in NOT_EMPTY)}
    UNION ALL {_known()}"""


@query("C10_expectation_checks", CHECKS)
def _(t):
    made = marts(t)
    least = F.create_map(*[F.lit(x) for pair in LEAST.items() for x in pair])
    counted = counters(t).withColumn("least", F.try_element_at(least, C("counter"))).where("least IS NOT NULL")
    checks = [counted.select(F.lit("minimum").alias("kind"), C("counter").alias("check_name"), (C("n") >= C("least")).alias("ok"), C("n").alias("observed"))]
    for name, rows in LEAST_ROWS.items():
        size = made[name].agg(F.count("*").alias("n"))
        checks.append(size.select(F.lit("minimum").alias("kind"), F.lit(f"{name} rows").alias("check_name"), (C("n") >= rows).alias("ok"), C("n").alias("observed")))
    for name in NOT_EMPTY:
        some = made[name].limit(1).agg(F.count("*").alias("n"))
        checks.append(some.select(F.lit("not_empty").alias("kind"), F.lit(name).alias("check_name"), (C("n") > 0).alias("ok"), C("n").alias("observed")))
    # what a mart's columns are called is known before it is made
    known = [("required_key", f"{name}.{c}", c in made[name].columns, int(c in made[name].columns)) for name, columns in REQUIRED.items() for c in columns]
    checks.append(t.spark.createDataFrame(known, "kind string, check_name string, ok boolean, observed long"))
    return reduce(DataFrame.unionByName, checks)
