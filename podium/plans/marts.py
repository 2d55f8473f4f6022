"""Loads, documents, search and marts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from podium import schema
from podium.functions import identifiers as idn
from podium.functions import text as tx
from podium.functions import times
from podium.operators import boards, loads
from podium.operators import events as ev
from podium.operators import search as se
from podium.operators.measures import count_if, half_up, wins
from podium.operators.ranking import hot_groups, keep_first, rank_within, top_k, top_n_per_group
from podium.operators.scope import exclude, showed_up
from podium.plans import dialect as q
from podium.plans.enrichment import DAILY, daily, levels, monthly_means
from podium.plans.events import EVENT_ROWS, GROUPS, SPECIAL, TOKEN, event_rows, groups, specials
from podium.plans.registry import query
from podium.plans.rescoring import WIND
from podium.plans.pages import PAGED, parsed_pages
from podium.session import fresh_folder, shared_table
from podium.sources import files
from podium.sources.result_pages import HEADS

C = F.col
N = q.n()


# --- loads -------------------------------------------------------------------------------------------------------


@query(
    "S05_table_scan",
    f"SELECT r_name, {N} AS nations, min(n_name) AS first_nation FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
)
def _(t):
    joined = t.nation.join(t.region, C("n_regionkey") == C("r_regionkey"))
    return joined.groupBy("r_name").agg(F.count("*").alias("nations"), F.min("n_name").alias("first_nation"))


@query(
    "S09_insert_or_ignore",
    """SELECT contest_id, entity_id, boat_id, line_no, metric FROM (SELECT *, row_number() OVER (PARTITION BY contest_id, entity_id ORDER BY boat_id, line_no, metric) AS rn
        FROM results) WHERE rn = 1""",
)
def _(t):
    rows = t.results.select("contest_id", "entity_id", "boat_id", "line_no", "metric")
    return loads.insert_or_ignore(rows, ["contest_id", "entity_id"], [C("boat_id"), C("line_no"), C("metric")])


@query(
    "S10_upsert",
    """WITH b AS (SELECT day, hour, obs_id, speed_c, 0 AS u FROM observations WHERE kind = 'view' UNION ALL SELECT day, hour, obs_id, speed_c, 1 FROM observations WHERE kind = 'purchase')
    SELECT day, hour, obs_id, speed_c FROM (SELECT *, row_number() OVER (PARTITION BY day, hour ORDER BY u DESC, obs_id DESC) AS rn FROM b) WHERE rn = 1""",
)
def _(t):
    cols = ["day", "hour", "obs_id", "speed_c"]
    base, updates = t.observations.where("kind = 'view'").select(*cols), t.observations.where("kind = 'purchase'").select(*cols)
    return loads.upsert(base, updates, ["day", "hour"], [C("obs_id")])


@query(
    "S12_cache_misses",
    """WITH need AS (SELECT DISTINCT day, start_hour AS hour FROM contest_headers), have AS (SELECT DISTINCT day, hour, 1 AS h FROM observations WHERE kind = 'view')
    SELECT day, CAST(count(h) AS BIGINT) AS hits, CAST(count(*) - count(h) AS BIGINT) AS misses FROM need LEFT JOIN have USING (day, hour) GROUP BY 1""",
)
def _(t):
    need = t.contest_headers.select("day", C("start_hour").alias("hour")).distinct()
    cache = t.observations.where("kind = 'view'").select("day", "hour").distinct()
    misses = loads.cache_misses(need, cache, ["day", "hour"]).withColumn("miss", F.lit(1))
    return (
        need.join(misses, ["day", "hour"], "left")
        .groupBy("day")
        .agg((F.count("*") - F.count("miss")).alias("hits"), F.count("miss").alias("misses"))
    )


@query(
    "S16_load_report",
    f"""SELECT 'contests' AS what, period, {N} AS n FROM contest_headers GROUP BY 2 UNION ALL SELECT 'results', period, {N} FROM results JOIN contest_headers USING (contest_id) GROUP BY 2
    UNION ALL SELECT 'series', NULL, {N} FROM series UNION ALL SELECT 'entities', NULL, {N} FROM entities UNION ALL SELECT 'boats', NULL, {N} FROM boats""",
)
def _(t):
    per = t.results.groupBy("contest_id").agg(F.count("*").alias("n"))
    by_period = (
        t.contest_headers.join(per, "contest_id", "left")
        .groupBy("period")
        .agg(F.count("*").alias("contests"), F.coalesce(F.sum("n"), F.lit(0)).alias("results"))
        .select("period", F.expr("stack(2, 'contests', contests, 'results', results) AS (what, n)"))
        .where("n > 0")
    )
    dims = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), F.lit(None).cast("int").alias("period"), "n")
        for name, df in (("series", t.series), ("entities", t.entities), ("boats", t.boats))
    ]
    return reduce(DataFrame.unionByName, dims, by_period)


@query(
    "S08_selective_marts",
    f"""SELECT 'fleet' AS mart, period, {q.n('DISTINCT entity_id')} AS value FROM star GROUP BY 2
    UNION ALL SELECT 'contests', period, {N} FROM contest_headers GROUP BY 2""",
)
def _(t):
    def fleet():
        seen = t.results.join(t.contest_headers, "contest_id").select("period", "entity_id").distinct()
        return seen.groupBy("period").agg(F.count("*").alias("value"))

    builders = {
        "fleet": fleet,
        "contests": lambda: t.contest_headers.groupBy("period").agg(F.count("*").alias("value")),
        "boats": lambda: t.boats.groupBy(C("first_period").alias("period")).agg(F.count("*").alias("value")),
    }
    folder = fresh_folder(t.spark, "marts")
    built = files.build_marts(builders, folder, only=["fleet", "contests"])
    marts = {name: files.read_json_lines(t.spark, f"{folder}/{name}", "period int, value long") for name in built}
    return se.union_all([df.select(F.lit(name).alias("mart"), "period", "value") for name, df in marts.items()])


@query("S11_full_reload", f"SELECT entity_id, {N} AS tenures, min(start_period) AS first_period FROM tenures GROUP BY 1")
def _(t):
    folder = fresh_folder(t.spark, "reload")
    # what an earlier load left is replaced by the whole of the later one
    files.replace_table(t.tenures.where("entity_id % 3 = 0").withColumn("start_period", F.lit(1900)), folder)
    files.replace_table(t.tenures, folder)
    loaded = files.read_table(t.spark, folder)
    return loaded.groupBy("entity_id").agg(F.count("*").alias("tenures"), F.min("start_period").alias("first_period"))


@query(
    "J16_snapshot_diff",
    """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing_right' WHEN d.doc_id IS NULL THEN 'missing_left' ELSE 'changed' END AS change
    FROM documents d FULL OUTER JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR d.doc_id IS NULL OR md5(d.lang) <> md5(CASE WHEN l.quality = 1 THEN 'en' ELSE 'fr' END)""",
)
def _(t):
    left = t.documents.select("doc_id", F.md5(C("lang").cast("binary")).alias("checksum"))
    right = t.labels.select("doc_id", F.md5(F.when(C("quality") == 1, "en").otherwise("fr").cast("binary")).alias("checksum"))
    return loads.snapshot_diff(left, right, key="doc_id")


# --- files -------------------------------------------------------------------------------------------------------


@query(
    "S03_json_lines",
    f"""WITH {PAGED}, x AS (SELECT page_id, period, count(*) AS n FROM pg WHERE layout < 3 GROUP BY 1, 2)
    SELECT period AS year, {N} AS pages, CAST(sum(n) AS BIGINT) AS race_rows, CAST(sum(n) AS BIGINT) AS scores, CAST(0 AS BIGINT) AS malformed FROM x GROUP BY 1
    UNION ALL SELECT NULL, 0, 0, 0, count(*) FROM x WHERE page_id % 97 = 0 HAVING count(*) > 0""",
)
def _(t):
    folder = f"{fresh_folder(t.spark, 'parsed')}"
    files.write_json_lines(parsed_pages(t, HEADS), f"{folder}/pages", packed=True)
    lines = files.read_json_lines(t.spark, f"{folder}/pages", "page_id long").where("page_id % 97 = 0")
    files.append_lines(lines.select(F.concat(F.lit('{"page_id": '), C("page_id").cast("string"), F.lit(', "races": [{')).alias("value")), f"{folder}/pages", packed=True)
    back = files.read_json_lines(t.spark, f"{folder}/pages", schema.PARSED_PAGE, corrupt=True)
    bad = C(files.CORRUPT).isNotNull()

    def rows(tables, of):
        return F.coalesce(F.aggregate(tables, F.lit(0).cast("long"), lambda n, x: n + of(x)), F.lit(0).cast("long"))

    sizes = back.select(
        "year", bad.alias("bad"),
        rows(C("races"), lambda x: F.size(x["rows"])).alias("race_rows"),
        rows(C("summaries"), lambda x: F.size(F.flatten(F.transform(x["rows"], lambda r: r["scores"])))).alias("scores"),
    )
    return sizes.groupBy("year").agg(
        count_if(~C("bad")).alias("pages"), F.sum("race_rows").alias("race_rows"), F.sum("scores").alias("scores"), count_if(C("bad")).alias("malformed")
    )


# the owners' columns, in the order the file declares
OWNED = {
    "boat_name": "'Entity ' || CAST(entity_id AS STRING)",
    "sail_number": "CASE WHEN tenure_id % 3 > 0 THEN CAST(tenure_id AS STRING) END",
    "boat_class": "CAST(NULL AS STRING)",
    "first_year_seen": "start_period",
    "last_year_seen": "end_period",
    "owner_name": "owner",
    "year_start": "start_period",
    "year_end": "end_period",
    "notes": """CASE WHEN tenure_id % 4 = 0 THEN 'said "maybe", then no' END""",
}


@query(
    "S04_csv_fields",
    f"""SELECT owner AS owner_name, {N} AS tenures, CAST(sum(start_period) AS BIGINT) AS starts, {q.n(cond="tenure_id % 3 > 0")} AS numbered, {q.n(cond="tenure_id % 4 = 0")} AS notes, CAST(0 AS BIGINT) AS malformed
    FROM tenures GROUP BY 1 UNION ALL SELECT '(malformed)', 0, NULL, 0, 0, count(*) FROM tenures WHERE tenure_id % 50 = 7 HAVING count(*) > 0""",
)
def _(t):
    folder = f"{fresh_folder(t.spark, 'owners')}/csv"
    names = list(OWNED)
    files.write_csv(t.tenures.selectExpr(*[f"{expr} AS {name}" for name, expr in OWNED.items()]), folder, names)
    # files of a header and lines that don't read: a year that is none, or a line that ends early
    broken = t.tenures.where("tenure_id % 50 = 7").select(
        F.when(C("tenure_id") % 4 == 1, "Boat,1,,,,Owner,about 1990,1991,").otherwise("Boat,1,J/29").alias("value")
    )
    files.append_lines(broken.select(F.explode(F.array(F.lit(",".join(names)), C("value"))).alias("value")), folder)
    back = files.read_csv(t.spark, folder, schema.OWNERS_CSV, corrupt=True)
    # a header line in the middle of a file that several broken lines share is no line of data
    back = back.where("boat_name <> 'boat_name'")
    bad = C(files.CORRUPT).isNotNull()
    good = [F.when(~bad, C(c)) for c in ("year_start", "sail_number", "notes")]
    return back.groupBy(F.when(bad, "(malformed)").otherwise(C("owner_name")).alias("owner_name")).agg(
        count_if(~bad).alias("tenures"), F.sum(good[0]).alias("starts"), F.count(good[1]).alias("numbered"), F.count(good[2]).alias("notes"),
        count_if(bad).alias("malformed"),
    )


CERTIFICATES_PER_FILE = 500


def certificate_documents(t):
    """Arrays of at most CERTIFICATES_PER_FILE certificates as text of several lines, and a broken one for every fifth."""
    band = F.when(C("p_size") % 2 == 0, F.struct(F.lit(1.5).alias("tot"), F.lit(0.25).alias("tod")))
    scoring = F.struct(
        F.struct((C("p_size") / F.lit(64.0)).alias("tot")).alias("coastal"),
        F.struct(band.alias("low"), band.alias("high")).alias("coastal_triple"),
    )
    doc = F.struct(
        F.concat(F.lit("C"), C("p_partkey").cast("string")).alias("orc_ref"),
        C("p_type").alias("boat_class"),
        (C("p_size") + F.lit(500.0)).alias("gph"),
        scoring.alias("scoring"),
    )
    chunk = F.floor(C("p_partkey") / CERTIFICATES_PER_FILE).alias("chunk")
    text = F.to_json(doc, {"pretty": "true"})
    arrays = t.part.select(chunk, text.alias("doc")).groupBy("chunk").agg(F.array_join(F.collect_list("doc"), ",\n").alias("docs"))
    whole = F.concat(F.lit("[\n"), C("docs"), F.lit("\n]"))
    torn = F.when(C("chunk") % 5 == 0, F.lit('[{"orc_ref": "C0",\n "scoring": {'))
    return arrays.select(F.explode(F.array_compact(F.array(whole, torn))).alias("value"))


@query(
    "S06_nested_certificates",
    """SELECT 'C' || p_partkey AS cert_ref, p_type AS boat_class, 500e0 + p_size AS gph, p_size / 64e0 AS coastal_tot, CASE WHEN p_size % 2 = 0 THEN 1.5e0 END AS coastal_low_tot,
        CASE WHEN p_size % 2 = 0 THEN 0.25e0 END AS coastal_high_tod FROM part""",
)
def _(t):
    folder = fresh_folder(t.spark, "certificates")
    files.write_json_documents(certificate_documents(t), folder)
    flat = files.flatten_certificates(files.read_json_documents(t.spark, folder, schema.CERTIFICATE))
    return flat.select("cert_ref", "boat_class", "gph", "coastal_tot", "coastal_low_tot", "coastal_high_tod")


@query(
    "S06_malformed_documents",
    f"""SELECT CAST(count(DISTINCT p_partkey // {CERTIFICATES_PER_FILE}) FILTER (p_partkey // {CERTIFICATES_PER_FILE} % 5 = 0) AS BIGINT) AS malformed, {N} AS certificates FROM part""",
)
def _(t):
    folder = fresh_folder(t.spark, "certificates")
    files.write_json_documents(certificate_documents(t), folder)
    docs = files.read_json_documents(t.spark, folder, schema.CERTIFICATE)
    return docs.agg(F.count(files.CORRUPT).alias("malformed"), F.count("orc_ref").alias("certificates"))


# --- event documents ---------------------------------------------------------------------------------------------

ENTRIES_PER_DOC, RACES_PER_DOC = 500, 50
#: Tasks that write the documents of one period.
DOCUMENT_FILES = 4
#: Contests from which an event is split when its races and standings are numbered.
HOT_CONTESTS = 100_000
JSON = {"ignoreNullFields": "false"}


def hot_events(t, column: str = "event_id"):
    """Hashes of events with very many contests, or with a contest of very many entries."""
    heads = t.contest_headers
    found = set(hot_groups(heads, ["event_id"], HOT_CONTESTS))
    if t.hot_contests:
        large = heads.where(F.xxhash64("contest_id").isin(t.hot_contests)).select(F.xxhash64("event_id").alias("h")).distinct()
        found |= {r["h"] for r in large.collect()}  # no more than there are hot contests
    return sorted(found)


def standings(t):
    """(event_id, scope, entity_id, rank, points, best): standings of every event by points, ranked within their scope.

    Without hot events the results are dealt by event once, which both the sums and the ranks need.
    """
    scope = F.when(C("entity_id") % 3 == 0, "overall").otherwise("a_fleet").alias("scope")
    hot = hot_events(t)
    entered = t.ranked.join(t.contest_headers.select("contest_id", "event_id"), "contest_id")
    entered = entered.select("event_id", scope, "entity_id", "points", "rank")
    dealt = entered if hot else entered.repartition("event_id")
    summed = dealt.groupBy("event_id", "scope", "entity_id").agg(F.sum("points").alias("points"), F.min("rank").alias("best"))
    return rank_within(summed, ["event_id", "scope"], "points", [C("entity_id")], hot=hot, hot_on=["event_id"])


STANDINGS = """st AS (SELECT event_id, CASE WHEN entity_id % 3 = 0 THEN 'overall' ELSE 'a_fleet' END AS scope, entity_id, CAST(sum(points) AS BIGINT) AS points, min(rank) AS best FROM star GROUP BY ALL),
    ss AS (SELECT *, CAST(row_number() OVER (PARTITION BY event_id, scope ORDER BY points, entity_id) AS BIGINT) AS rank FROM st)"""


def people(t):
    return t.entities.select("entity_id", C("entity_name").alias("display_name"), "participant_type")


def standing_documents(t, members=None):
    """The first standing of each participant and scope over an event's views, in parts by rank.

    Without ``members`` every event has documents of its own, and the standings, dealt by event, stay where they are.
    """
    if members is None:
        own = standings(t).where("event_id IS NOT NULL").withColumn("doc_id", C("event_id"))
    else:
        own = standings(t).join(members, "event_id")
    first = keep_first(own.select("doc_id", "scope", "entity_id", "rank", "event_id", "points", "best"), ["doc_id", "scope", "entity_id"], [C("rank"), C("event_id")])
    entry = F.struct("scope", "rank", "entity_id", "points", "best", "display_name", "participant_type")
    part = F.floor((C("rank") - 1) / ENTRIES_PER_DOC).cast("int")
    rows = first.join(people(t), "entity_id").select("doc_id", part.alias("part"), entry.alias("e")).groupBy("doc_id", "part")
    return rows.agg(F.to_json(F.array_sort(F.collect_list("e")), JSON).alias("body")).select(
        C("doc_id").alias("event_id"), F.lit("standings").alias("section"), "part", F.lit(0).alias("subpart"), "body"
    )


def logical_races(t, members):
    """Contests with the race they belong to over an event's views: same number, key and date."""
    race = Window.partitionBy("doc_id", "contest_no", "contest_key", "contest_date")
    named = t.contest_headers.join(members, "event_id")
    return named.withColumn("race_id", F.min("contest_id").over(race))


def gathered(listed: DataFrame, *more, race=("race_id",), dealt: bool = False) -> DataFrame:
    """Entries of each race by subpart, dealt out by race as a join with the races needs them, so that they are sent once.

    Entries that are ``dealt`` out already, with no race in two tasks, stay where they are.
    """
    rows = listed if dealt else listed.repartition(*race)
    return rows.groupBy(*race, "subpart").agg(F.array_sort(F.collect_list("e")).alias("results"), *more)


def placed_races(t, contests):
    """Races of all documents with their place and part, written once: entries are dealt by them, and documents made of them."""
    races = contests.where("contest_id = race_id")
    races = races.withColumn("number", F.coalesce("contest_no", F.lit(999))).withColumn("key", F.coalesce("contest_key", F.lit("")))
    races = rank_within(races, ["doc_id"], "number", [C("key"), C("race_id")], out="place", hot=hot_events(t), hot_on=["event_id"])
    part = F.floor((C("place") - 1) / RACES_PER_DOC).cast("int").alias("part")
    return shared_table(races.select("doc_id", part, "place", "race_id", "contest_no", "contest_key", "day", "start_hour", "distance_nm"), "races")


def dealt_entries(t, contests, races):
    """Entries of every race with all the names of their participant and boat, and the races themselves, by document part.

    Names are added before and weather after this, so that entries are sent once and no more than this. A participant or boat
    that is listed twice gives an entry twice, so names come as arrays.
    """
    place = contests.select("contest_id", "race_id").join(races.select("race_id", "doc_id", "part", "place"), "race_id").drop("race_id")
    named = people(t).groupBy("entity_id").agg(F.collect_list(F.struct("display_name", "participant_type")).alias("people"))
    boats = t.boats.groupBy("boat_id").agg(F.collect_list(F.struct(C("name").alias("boat_name"), "raw_class")).alias("boats"))
    rows = t.ranked.join(place, "contest_id").join(named, "entity_id").join(boats, "boat_id", "left")
    rows = rows.select("doc_id", "part", "place", "entity_id", "contest_id", "rank", "boat_id", "line_no", "rating", "elapsed_s", "points", "status", "people", "boats")
    race = F.struct("race_id", "contest_no", "contest_key", "day", "start_hour", "distance_nm").alias("race")
    return rows.unionByName(races.select("doc_id", "part", "place", race), allowMissingColumns=True).repartition("doc_id", "part")


def race_results(dealt: DataFrame) -> DataFrame:
    """(doc_id, part, place, race, subpart, results): entries of each race by subpart, first ones of a participant only.

    ``dealt`` holds entries and, without a participant, the race of each place. A race without entries has one empty subpart. No
    row leaves its document part.
    """
    keys = ["doc_id", "part", "place"]
    order = F.struct("contest_id", "rank", "boat_id", "line_no")
    rest = F.struct("rating", "elapsed_s", "points", "status", "people", "boats")
    first = dealt.groupBy(*keys, "entity_id").agg(F.min(F.struct(order.alias("o"), rest.alias("v"))).alias("m"), F.min("race").alias("race"))

    def entry(person, boat):
        return F.struct(
            C("m.o.rank").alias("rank"), "entity_id", person["display_name"].alias("display_name"), person["participant_type"].alias("participant_type"),
            C("m.o.boat_id").alias("boat_id"), boat["boat_name"].alias("boat_name"), boat["raw_class"].alias("raw_class"), C("m.v.rating").alias("phrf_rating"),
            times.clock("m.v.elapsed_s").alias("elapsed_time"), C("m.v.points").alias("points"), C("m.v.status").alias("status"),
        )

    entries = F.flatten(F.transform("m.v.people", lambda p: F.transform("m.v.boats", lambda b: entry(p, b))))
    subpart = F.floor((C("m.o.rank") - 1) / ENTRIES_PER_DOC).cast("int").alias("subpart")
    # an entry whose boat is not listed is left out
    listed = first.where("race IS NOT NULL OR m.v.boats IS NOT NULL").select(*keys, "race", subpart, F.explode_outer(entries).alias("e"))
    found = gathered(listed, F.min("race").alias("own"), race=keys, dealt=True)
    one = Window.partitionBy(*keys)
    whole = found.withColumn("race", F.min("own").over(one)).withColumn("n", F.count("*").over(one))
    return whole.where("own IS NULL OR n = 1").select(*keys, "race", F.coalesce("subpart", F.lit(0)).alias("subpart"), "results")


def race_documents(t, members):
    """Races with their results, weather and readings: RACES_PER_DOC races and as many places of each as an entry holds."""
    contests = logical_races(t, members)
    races = placed_races(t, contests)
    results = race_results(dealt_entries(t, contests, races)).withColumn("day", C("race.day"))
    weather = F.when(
        C("n_obs").isNotNull(),
        F.struct("temp_c", C("mean_c").alias("wind_speed"), "direction", C("gust_c").alias("gust"), "rain_mm", C("sky").alias("conditions")),
    ).alias("weather")
    # one row a day of the calendar, with 24 readings at most
    full = results.join(F.broadcast(daily(t)), "day", "left").join(F.broadcast(levels(t)), "day", "left")
    one = F.struct("place", C("race.race_id").alias("id"), "race.contest_no", "race.contest_key", C("day").alias("date"), "race.start_hour", "race.distance_nm",
                   "results", weather, C("levels").alias("readings"))
    rows = full.select("doc_id", "part", "subpart", one.alias("e")).groupBy("doc_id", "part", "subpart")
    # places are unique within a document
    whole = F.array_sort(F.collect_list("e"), lambda x, y: (x["place"] - y["place"]).cast("int"))
    return rows.agg(F.to_json(whole, JSON).alias("body")).select(C("doc_id").alias("event_id"), F.lit("races").alias("section"), "part", "subpart", "body")


def header_documents(t, grouped, members):
    """One row per event that stands for itself and its views: names, counts over all views, and why it is special."""
    heads = grouped.where("event_id = canonical_event_id").select(C("event_id").alias("doc_id"), "period", "canonical_name", "event_type")
    contests = t.contest_headers.join(members, "event_id").join(heads.select("doc_id", "event_type"), "doc_id")
    races = ev.race_counts(contests.drop("event_id").withColumnRenamed("doc_id", "event_id")).select(C("event_id").alias("doc_id"), "shown_races")
    entered = t.results.join(contests.select("contest_id", "doc_id"), "contest_id").groupBy("doc_id", "entity_id").agg(F.count("*").alias("n"))
    entries = entered.groupBy("doc_id").agg(F.count("*").alias("entries"), F.sum("n").alias("results"))
    special = specials(t).select(C("event_id").alias("doc_id"), "kind", "reasons")
    views = members.groupBy("doc_id").agg(F.count("*").alias("views"))
    event = F.struct(
        C("doc_id").alias("id"), "period", C("canonical_name").alias("name"), "event_type", "views", C("shown_races").alias("races_sailed"),
        F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("results", F.lit(0)).alias("results"),
        C("kind").isNotNull().alias("exclude_from_handicap_stats"), C("kind").alias("special_event_kind"),
        F.coalesce("reasons", F.lit("")).alias("special_event_reasons"),
    )
    for more in (views, races, entries, special):
        heads = heads.join(more, "doc_id", "left")
    return heads.select(
        C("doc_id").alias("event_id"), F.lit("event").alias("section"), F.lit(0).alias("part"), F.lit(0).alias("subpart"), F.to_json(event, JSON).alias("body")
    )


def event_documents(t):
    """Documents of all events, the views of one event together: (event_id, section, part, subpart, body).

    The header is one document; standings, and races with their results, weather and readings, come in parts of fixed size.
    """
    grouped = groups(t)
    members = grouped.select("event_id", C("canonical_event_id").alias("doc_id"))
    return header_documents(t, grouped, members).unionByName(standing_documents(t, members)).unionByName(race_documents(t, members))


DOCUMENTS = f"""{GROUPS}, {SPECIAL.removeprefix(EVENT_ROWS + ', ')}, {STANDINGS}, {DAILY}, {WIND}, ls AS (SELECT day, list(struct_pack(hour := hour, wind_kc := CAST(wind_kc AS BIGINT)) ORDER BY hour) AS levels FROM hw GROUP BY 1),
    mb AS (SELECT event_id, canonical_event_id AS doc_id FROM cg),
    hd AS (SELECT canonical_event_id AS doc_id, any_value(period) AS period, max(CASE WHEN event_id = canonical_event_id THEN canonical_name END) AS name, max(CASE WHEN event_id = canonical_event_id THEN event_type END) AS event_type,
        count(*) AS views FROM cg GROUP BY 1),
    rc AS (SELECT doc_id, count(DISTINCT {TOKEN}) AS logical, count(DISTINCT contest_date) AS dates FROM contests JOIN mb USING (event_id) GROUP BY 1),
    en AS (SELECT doc_id, count(DISTINCT entity_id) AS entries, count(*) AS results FROM star JOIN mb USING (event_id) GROUP BY 1),
    d1 AS (SELECT doc_id AS event_id, 'event' AS section, 0 AS part, 0 AS subpart, CAST(to_json(struct_pack(id := doc_id, period := hd.period, name := hd.name, event_type := hd.event_type, views := views,
        races_sailed := CASE WHEN hd.event_type = 'tns' AND dates > 0 THEN dates ELSE logical END, entries := coalesce(entries, 0), results := coalesce(en.results, 0), exclude_from_handicap_stats := sp.kind IS NOT NULL,
        special_event_kind := sp.kind, special_event_reasons := coalesce(sp.reasons, ''))) AS VARCHAR) AS body FROM hd LEFT JOIN rc USING (doc_id) LEFT JOIN en USING (doc_id) LEFT JOIN sp ON sp.event_id = doc_id),
    sf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, scope, entity_id ORDER BY rank, event_id) AS rn FROM ss JOIN mb USING (event_id)) JOIN entities USING (entity_id) WHERE rn = 1),
    d2 AS (SELECT doc_id, 'standings', CAST((rank - 1) // {ENTRIES_PER_DOC} AS INTEGER), 0, CAST(to_json(list(struct_pack(scope := scope, rank := rank, entity_id := entity_id, points := points, best := best,
        display_name := entity_name, participant_type := participant_type) ORDER BY scope, rank, entity_id)) AS VARCHAR) FROM sf GROUP BY 1, 3),
    lr AS (SELECT *, min(contest_id) OVER (PARTITION BY doc_id, contest_no, contest_key, contest_date) AS race_id FROM contest_headers JOIN mb USING (event_id)),
    rr AS (SELECT * FROM (SELECT lr.race_id, r.*, row_number() OVER (PARTITION BY race_id, entity_id ORDER BY r.contest_id, rank, boat_id, line_no) AS rn FROM ranked r JOIN lr USING (contest_id)) WHERE rn = 1),
    rs2 AS (SELECT race_id, CAST((rank - 1) // {ENTRIES_PER_DOC} AS INTEGER) AS subpart, list(struct_pack(rank := rank, entity_id := entity_id, display_name := entity_name, participant_type := e.participant_type, boat_id := boat_id,
        boat_name := b.name, raw_class := raw_class, phrf_rating := rating, elapsed_time := format('{{}}:{{:02d}}:{{:02d}}', elapsed_s // 3600, elapsed_s // 60 % 60, elapsed_s % 60), points := points, status := status)
        ORDER BY rank, entity_id, entity_name, e.participant_type, boat_id) AS results FROM rr JOIN entities e USING (entity_id) JOIN boats b USING (boat_id) GROUP BY 1, 2),
    ra AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(contest_no, 999), coalesce(contest_key, ''), race_id) AS BIGINT) AS place FROM lr WHERE contest_id = race_id),
    d3 AS (SELECT doc_id, 'races', CAST((place - 1) // {RACES_PER_DOC} AS INTEGER), coalesce(subpart, 0), CAST(to_json(list(struct_pack(place := place, id := race_id, contest_no := contest_no, contest_key := contest_key, date := day,
        start_hour := start_hour, distance_nm := distance_nm, results := coalesce(results, []), weather := CASE WHEN n_obs IS NOT NULL THEN struct_pack(temp_c := temp_c, wind_speed := CAST(mean_c AS BIGINT), direction := direction,
        gust := gust_c, rain_mm := rain_mm, conditions := sky) END, readings := levels) ORDER BY place)) AS VARCHAR) FROM ra LEFT JOIN dw USING (day) LEFT JOIN ls USING (day) LEFT JOIN rs2 USING (race_id) GROUP BY 1, 3, 4),
    docs AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3)"""


@query("A46_event_documents", f"WITH {DOCUMENTS} SELECT * FROM docs")
def _(t):
    return event_documents(t)


DOCUMENT = "event_id long, section string, part int, subpart int, body string, version int, period int"


@query(
    "S07_keyed_documents",
    f"""WITH {STANDINGS}, p AS (SELECT DISTINCT event_id, period FROM contest_headers)
    SELECT period, CASE WHEN period >= 1996 THEN 2 ELSE 1 END AS version, {q.n('DISTINCT event_id')} AS documents, {N} AS entries
    FROM ss JOIN p USING (event_id) WHERE period < 1996 OR event_id // 10000 % 2 = 0 GROUP BY 1, 2""",
)
def _(t):
    folder = fresh_folder(t.spark, "documents")
    periods = t.contest_headers.select("event_id", "period").distinct()
    docs = standing_documents(t).join(periods, "event_id")
    files.write_documents(docs.withColumn("version", F.lit(1)), folder, "period", files=DOCUMENT_FILES, packed=True)
    # a later run with fewer keys, and fewer documents under them, replaces what it writes and keeps the other keys
    later = files.read_documents(t.spark, folder, DOCUMENT).where("period >= 1996 AND floor(event_id / 10000) % 2 = 0")
    files.write_documents(later.withColumn("version", F.lit(2)), f"{folder}-later", "period", files=DOCUMENT_FILES, packed=True)
    files.write_documents(files.read_documents(t.spark, f"{folder}-later", DOCUMENT), folder, "period", files=DOCUMENT_FILES, packed=True)
    back = files.read_documents(t.spark, folder, DOCUMENT)
    entries = F.size(F.from_json("body", "array<struct<rank:bigint>>"))
    return back.groupBy("period", "version").agg(F.count_distinct("event_id").alias("documents"), F.sum(entries).cast("long").alias("entries"))


# --- search ------------------------------------------------------------------------------------------------------

INDEX = f"""{GROUPS}, ix AS (SELECT 'boat' AS kind, p_partkey AS id, p_name AS label, p_type AS hint, lower(concat_ws(' ', p_name, p_type, p_brand)) AS keywords FROM part
    UNION ALL SELECT 'event', event_id, event_name, CAST(period AS VARCHAR), lower(concat_ws(' ', event_name, CAST(period AS VARCHAR), event_type, series_month)) FROM er WHERE event_id NOT IN (SELECT event_id FROM cg WHERE is_variant)
    UNION ALL SELECT 'entity', entity_id, entity_name, coalesce(owner, ''), lower(concat_ws(' ', entity_name, owner)) FROM entities
    UNION ALL SELECT DISTINCT 'season', CAST(period AS BIGINT), period || ' Season', '', CAST(period AS VARCHAR) FROM contest_headers)"""


def index(t):
    seasons = t.contest_headers.select("period").distinct().select(
        "period", F.concat(C("period").cast("string"), F.lit(" Season")).alias("label"), F.lit("").alias("hint")
    )
    listed = exclude(event_rows(t), t.skipped.where("variant"), on="event_id")
    return se.union_all(
        [
            se.index_rows(t.part, "boat", "p_partkey", "p_name", "p_type", "p_name", "p_type", "p_brand"),
            se.index_rows(listed, "event", "event_id", "event_name", "period", "event_name", "period", "event_type", "series_month"),
            se.index_rows(t.entities, "entity", "entity_id", "entity_name", "owner", "entity_name", "owner"),
            se.index_rows(seasons, "season", "period", "label", "hint", "period"),
        ]
    )


@query("U05_search_index", f"WITH {INDEX} SELECT * FROM ix")
def _(t):
    return index(t)


@query(
    "F09_multi_term_search",
    f"WITH {INDEX} SELECT kind, id, label FROM ix WHERE contains(keywords, 'red') AND contains(keywords, 'brand#1')",
)
def _(t):
    return index(t).where(tx.has_all_terms(C("keywords"), ["red", "Brand#1"])).select("kind", "id", "label")


@query(
    "W08_top_per_kind",
    f"""WITH {INDEX} SELECT kind, id, label, CAST(row_number() OVER (PARTITION BY kind ORDER BY label, id) AS INTEGER) AS place FROM ix WHERE contains(keywords, 'e')
    QUALIFY place <= 8""",
)
def _(t):
    return se.search(index(t), "e").select("kind", "id", "label", "place")


@query(
    "F10_facets",
    "SELECT boat_id, name, raw_class FROM boats WHERE (contains(lower(name), 'ri') OR contains(lower(sail), 'ri') OR contains(lower(raw_class), 'ri')) AND raw_class = 'J29'",
)
def _(t):
    hit = F.contains(F.lower(F.concat_ws("\n", "name", "sail", "raw_class")), F.lit("ri"))
    return t.boats.where(hit & (C("raw_class") == "J29")).select("boat_id", "name", "raw_class")


@query(
    "F11_nested_any_match",
    """SELECT series_id, event_name FROM series WHERE contains(lower(event_name), 'cup 2') OR series_id IN
        (SELECT series_id FROM contest_headers JOIN ranked USING (contest_id) JOIN entities USING (entity_id) WHERE rank = 1 AND contains(lower(entity_name), '7'))""",
)
def _(t):
    named = t.entities.where(F.contains(F.lower("entity_name"), F.lit("7"))).select("entity_id")
    won = t.ranked.where("rank = 1").select("contest_id", "entity_id").join(named, "entity_id", "left_semi")
    by_winner = won.join(t.contest_headers, "contest_id").select("series_id", F.lit(True).alias("won")).distinct()
    hit = F.contains(F.lower("event_name"), F.lit("cup 2")) | F.coalesce("won", F.lit(False))
    return t.series.join(by_winner, "series_id", "left").where(hit).select("series_id", "event_name")


PRIO = "series_id, source_file || CASE series_id % 5 WHEN 0 THEN 'l' WHEN 1 THEN '/__TI_CNF/x' ELSE '' END AS path, CASE WHEN series_id % 7 = 0 THEN 'Sailwave results for  - ' ELSE event_name END AS title, CASE WHEN series_id % 3 = 0 THEN 'sailwave-race' ELSE 'sailwave-mixed' END AS page_class"


@query(
    "F12_priority_label",
    f"""WITH p AS (SELECT {PRIO} FROM series), l AS (SELECT CASE WHEN contains(lower(path), '/__ti_cnf/') THEN NULL WHEN contains(lower(title), 'sailwave results for  -') THEN 'low'
        WHEN regexp_matches(path, '_overall|_ab|\\.html') THEN 'medium' WHEN page_class = 'sailwave-race' THEN 'medium' ELSE 'high' END AS level FROM p)
    SELECT level, {N} AS pages FROM l WHERE level IS NOT NULL GROUP BY 1""",
)
def _(t):
    p = t.series.selectExpr(
        "source_file || CASE series_id % 5 WHEN 0 THEN 'l' WHEN 1 THEN '/__TI_CNF/x' ELSE '' END AS path",
        "CASE WHEN series_id % 7 = 0 THEN 'Sailwave results for  - ' ELSE event_name END AS title",
        "CASE WHEN series_id % 3 = 0 THEN 'sailwave-race' ELSE 'sailwave-mixed' END AS page_class",
    )
    labelled = p.select(se.priority("path", "title", "page_class").alias("p")).where("p IS NOT NULL")
    return labelled.groupBy("p.level").agg(F.count("*").alias("pages"))


# --- audits ------------------------------------------------------------------------------------------------------


@query(
    "A42_value_counts",
    f"""SELECT 'status' AS dimension, status AS value, {N} AS n FROM star GROUP BY 2 UNION ALL SELECT 'event_type', event_type, {N} FROM star GROUP BY 2
    UNION ALL SELECT 'period', CAST(period AS VARCHAR), {N} FROM star GROUP BY 2""",
)
def _(t):
    # one scan: counts of the few combinations first, then one grouping set per dimension
    combos = (
        t.results.join(t.contests.select("contest_id", "event_type", C("period").cast("string").alias("period")), "contest_id")
        .groupBy("status", "event_type", "period")
        .agg(F.count("*").alias("c"))
    )
    sets = combos.groupingSets([["status"], ["event_type"], ["period"]], "status", "event_type", "period").agg(
        F.sum("c").alias("n"), F.grouping_id().alias("g")
    )
    name = F.when(C("g") == 3, "status").when(C("g") == 5, "event_type").otherwise("period")
    value = F.when(C("g") == 3, C("status")).when(C("g") == 5, C("event_type")).otherwise(C("period"))
    return sets.select(name.alias("dimension"), value.alias("value"), "n")


@query(
    "A43_grouped_examples",
    f"""WITH c AS (SELECT {q.design_class('raw_class')} AS class, {q.collapse('name')} AS name FROM boats), n AS (SELECT class, name, row_number() OVER (PARTITION BY class ORDER BY name) AS k
        FROM (SELECT DISTINCT class, name FROM c WHERE class IS NOT NULL))
    SELECT class, boats, examples FROM (SELECT class, {N} AS boats FROM c WHERE class IS NOT NULL GROUP BY 1) JOIN (SELECT class, string_agg(name, ' | ' ORDER BY k) AS examples
        FROM n WHERE k <= 8 GROUP BY 1) USING (class)""",
)
def _(t):
    named = (
        t.boats.select(idn.design_class("raw_class").alias("class"), tx.collapse("name").alias("name"))
        .where("class IS NOT NULL")
        .groupBy("class", "name")
        .agg(F.count("*").alias("n"))
    )
    sizes = named.groupBy("class").agg(F.sum("n").alias("boats"))
    first = top_n_per_group(named, ["class"], [C("name")], 8)
    examples = first.groupBy("class").agg(F.array_join(F.array_sort(F.collect_list("name")), " | ").alias("examples"))
    return sizes.join(examples, "class")


@query(
    "A45_pivot_wide",
    """SELECT period, CAST(count(DISTINCT entity_id) FILTER (event_type = 'tns') AS BIGINT) AS tns, CAST(count(DISTINCT entity_id) FILTER (event_type = 'trophy') AS BIGINT) AS trophy,
        CAST(count(DISTINCT entity_id) FILTER (event_type = 'championship') AS BIGINT) AS championship FROM star GROUP BY 1""",
)
def _(t):
    once = t.results.join(t.contests, "contest_id").select("period", "event_type", "entity_id").distinct()
    return once.groupBy("period").pivot("event_type", ["tns", "trophy", "championship"]).agg(F.count("entity_id")).fillna(0)


CLASS_BOATS = f"""cb AS (SELECT DISTINCT period, boat_id, {q.design_class('raw_class')} AS class FROM results JOIN contest_headers USING (contest_id) JOIN boats USING (boat_id)),
    cc AS (SELECT period, class, count(*) AS n FROM cb WHERE class IS NOT NULL GROUP BY 1, 2), tp AS (SELECT class FROM cc GROUP BY 1 ORDER BY sum(n) DESC, class LIMIT 8)"""


@query(
    "A45_top_classes_and_rest",
    f"""WITH {CLASS_BOATS} SELECT period, CASE WHEN class IN (SELECT class FROM tp) THEN class ELSE 'Other' END AS class, CAST(sum(n) AS BIGINT) AS boats FROM cc GROUP BY 1, 2""",
)
def _(t):
    classes = t.boats.select("boat_id", idn.design_class("raw_class").alias("class")).where("class IS NOT NULL")
    used = t.results.join(t.contest_headers, "contest_id").select("period", "boat_id").distinct()
    per = used.join(classes, "boat_id").groupBy("period", "class").agg(F.count("*").alias("n"))
    leaders = top_k(per.groupBy("class").agg(F.sum("n").alias("s")), [F.desc("s"), C("class")], 8)
    marked = per.join(F.broadcast(leaders.select("class", F.lit(True).alias("lead"))), "class", "left")  # eight rows
    name = F.when(C("lead"), C("class")).otherwise("Other")
    return marked.groupBy("period", name.alias("class")).agg(F.sum("n").alias("boats"))


YEARS = f"""fy AS (SELECT entity_id, min(period) AS f FROM best GROUP BY 1),
    py AS (SELECT period, {q.n('DISTINCT entity_id')} AS entities, {q.n('DISTINCT contest_id')} AS contests, {q.n(cond='rank = 1')} AS wins, {N} AS starts FROM best GROUP BY 1)"""


@query(
    "A49_derived_indicators",
    f"""WITH {YEARS} SELECT p.period, entities, CAST((SELECT count(*) FROM fy WHERE f = p.period) AS BIGINT) AS newcomers,
        CAST(entities - (SELECT count(*) FROM fy WHERE f = p.period) AS BIGINT) AS returning, contests, {q.pct('100 * wins', 'starts')} AS win_rate, {q.pct('starts', 'contests')} AS mean_starts FROM py p""",
)
def _(t):
    best = t.best
    seen = best.groupBy("period", "entity_id").agg(F.count("*").alias("starts"), wins().alias("wins"))
    per = seen.groupBy("period").agg(F.count("*").alias("entities"), F.sum("starts").alias("starts"), F.sum("wins").alias("wins"))
    contests = best.select("period", "contest_id").distinct().groupBy("period").agg(F.count("*").alias("contests"))
    new = boards.first_seen(seen.select("entity_id", "period"))
    joined = per.join(contests, "period").join(new, "period", "left").fillna(0, ["newcomers"])
    return joined.select(
        "period",
        "entities",
        "newcomers",
        (C("entities") - C("newcomers")).alias("returning"),
        "contests",
        half_up(C("wins") * 100, C("starts"), 1).alias("win_rate"),
        half_up("starts", "contests", 1).alias("mean_starts"),
    )


@query(
    "A50_relative_score",
    f"""WITH b AS (SELECT entity_id, {N} AS starts FROM best GROUP BY 1 ORDER BY starts DESC, entity_id LIMIT 20) SELECT entity_id, starts, CAST(starts AS DOUBLE) / max(starts) OVER () AS bar FROM b""",
)
def _(t):
    from pyspark.sql import Window

    board = top_k(t.best.groupBy("entity_id").agg(F.count("*").alias("starts")), [F.desc("starts"), C("entity_id")], 20)
    leader = F.max("starts").over(Window.partitionBy(F.lit(0)))  # over the twenty rows kept
    return board.select("entity_id", "starts", (C("starts").cast("double") / leader).alias("bar"))


@query(
    "L03_nulls_last_order",
    """SELECT contest_id, contest_no, contest_key FROM contest_headers ORDER BY contest_no NULLS LAST, contest_key NULLS LAST, contest_id""",
)
def _(t):
    return t.contest_headers.select("contest_id", "contest_no", "contest_key").orderBy(
        C("contest_no").asc_nulls_last(), C("contest_key").asc_nulls_last(), "contest_id"
    )


def sorted_by(df: DataFrame, key: str, descending: bool, unique: str) -> DataFrame:
    """Sort chosen at run time; nulls go last in either direction and ``unique`` settles ties."""
    order = C(key).desc_nulls_last() if descending else C(key).asc_nulls_last()
    return df.orderBy(order, unique)


@query(
    "L05_switchable_sort",
    f"""SELECT entity_id, {N} AS contests, {q.n(cond='rank = 1')} AS wins FROM best GROUP BY 1 ORDER BY wins DESC, entity_id""",
)
def _(t):
    board = t.best.groupBy("entity_id").agg(F.count("*").alias("contests"), wins().alias("wins"))
    return sorted_by(board, "wins", True, "entity_id")


# every result of events that are not special, other views marked; and the open ones among them
BASE = f"""{GROUPS}, {SPECIAL.removeprefix(EVENT_ROWS + ', ')}, bs AS (SELECT * FROM star WHERE event_id NOT IN (SELECT event_id FROM sp)),
    op AS (SELECT *, status IS NULL OR status NOT IN ('DNS', 'DNC') AS shown, CASE WHEN elapsed_s > 600 AND elapsed_s < 18000 THEN elapsed_s END AS e FROM bs WHERE event_id NOT IN (SELECT event_id FROM cg WHERE is_variant)),
    ow AS (SELECT entity_id, coalesce(owner, 'boat:' || CAST(entity_id AS VARCHAR)) AS owner_key FROM entities)"""
BRACKETS = (("calm", 4), ("light", 10), ("moderate", 16), ("fresh", 22))


FACTS = ("entity", "contest", "type", "boat", "sailor", "night")


def season_facts(t, wanted=FACTS):
    """(kind, period, label, id, day, n, shown, wins, elapsed, timed): all counts of the wanted kinds that the analysis mart is
    made of.

    The results are scanned and ranked once and reduced to (contest, entity); each of these rows then counts for its entity,
    contest, event type, boats, and in a weekly series for its month's entities and nights, in one mergeable aggregate. Spark
    can't leave out kinds that a query doesn't use, as they are rows, so the wanted ones are named here.
    """
    open_event = ~F.coalesce("variant", F.lit(False))
    flags = t.skipped.withColumnRenamed("event_id", "flagged")
    contests = t.contests.join(flags, C("event_id") == C("flagged"), "left").where("special IS NULL OR NOT special")
    contests = contests.select("contest_id", "period", "event_type", "series_month", "day", open_event.alias("open"))
    timed = F.when((C("elapsed_s") > 600) & (C("elapsed_s") < 18000), C("elapsed_s").cast("long"))
    once = (
        t.ranked.join(contests, "contest_id")
        .groupBy("contest_id", "entity_id", "period", "event_type", "series_month", "day", "open")
        .agg(
            F.count("*").alias("n"),
            F.min(F.when(showed_up("status"), C("rank"))).alias("best"),
            *([F.collect_set("boat_id").alias("boats")] if "boat" in wanted else []),
            F.sum(timed).alias("elapsed"),
            F.count(timed).alias("timed"),
        )
    )
    none = F.lit(None).cast("string")

    def fact(kind, label, number, day=none):
        return F.struct(F.lit(kind).alias("kind"), label.alias("label"), number.cast("long").alias("id"), day.alias("day"))

    weekly = (C("event_type") == ev.WEEKLY) & C("series_month").isNotNull()
    nothing = F.lit(0).cast("long")
    empty = F.slice(F.array(fact("none", none, nothing)), 1, 0)

    def listed(**kinds):
        return F.concat(empty, F.array(*[found for kind, found in kinds.items() if kind in wanted]))

    of_open = listed(
        entity=fact("entity", C("event_type"), C("entity_id")),
        contest=fact("contest", C("event_type"), C("contest_id")),
        type=fact("type", C("event_type"), nothing),
    )
    if "boat" in wanted:
        of_open = F.concat(of_open, F.transform("boats", lambda b: fact("boat", none, b)))
    of_week = listed(sailor=fact("sailor", C("series_month"), C("entity_id")), night=fact("night", C("series_month"), nothing, C("day")))
    facts = F.concat(F.when(C("open"), of_open).otherwise(empty), F.when(weekly, of_week).otherwise(empty))
    return (
        once.select("period", "n", "best", "elapsed", "timed", F.inline(facts))
        .groupBy("kind", "period", "label", "id", "day")
        .agg(
            F.sum("n").alias("n"), F.count("best").alias("shown"), count_if(C("best") == 1).alias("wins"), F.sum("elapsed").alias("elapsed"),
            F.sum("timed").alias("timed"),
        )
    )


@query(
    "C16_analysis_mart",
    f"""WITH {BASE}, {DAILY}, sv AS (SELECT DISTINCT entity_id, period FROM op), pz AS (SELECT DISTINCT period FROM op), nx AS (SELECT period, lead(period) OVER (ORDER BY period) AS np FROM pz),
    de AS (SELECT entity_id, contest_id, period, min(rank) AS best FROM op WHERE shown GROUP BY 1, 2, 3),
    mz AS (SELECT owner_key, count(*) AS races, count(*) FILTER (best = 1) AS wins FROM de JOIN ow USING (entity_id) GROUP BY 1),
    oy AS (SELECT DISTINCT owner_key, period FROM sv JOIN ow USING (entity_id)),
    oi AS (SELECT *, period - row_number() OVER (PARTITION BY owner_key ORDER BY period) AS i FROM oy), ru AS (SELECT owner_key, i, count(*) AS len, min(period) AS s FROM oi GROUP BY 1, 2),
    lo AS (SELECT owner_key, len, s FROM (SELECT *, row_number() OVER (PARTITION BY owner_key ORDER BY len DESC, s) AS rn FROM ru) WHERE rn = 1 AND len >= 3 ORDER BY len DESC, owner_key LIMIT 25),
    x(section, period, label, value, value2, value3) AS (
    SELECT 'fleet', period, NULL, count(DISTINCT entity_id), count(DISTINCT entity_id) FILTER (event_type = 'tns'), count(DISTINCT entity_id) FILTER (event_type = 'trophy') FROM op GROUP BY period
    UNION ALL SELECT 'newcomers', period, NULL, count(f.entity_id), NULL, NULL FROM pz LEFT JOIN (SELECT entity_id, min(period) AS period FROM sv GROUP BY 1) f USING (period) GROUP BY period
    UNION ALL SELECT 'return_rate', a.period, NULL, count(*), count(b.entity_id), {q.pct('100 * count(b.entity_id)', 'count(*)')} FROM sv a JOIN nx ON nx.period = a.period AND np IS NOT NULL
        LEFT JOIN sv b ON b.entity_id = a.entity_id AND b.period = np GROUP BY a.period
    UNION ALL SELECT 'class', period, class, count(DISTINCT boat_id), NULL, NULL FROM (SELECT period, boat_id, {q.design_class('raw_class')} AS class FROM op JOIN boats USING (boat_id)) WHERE class IS NOT NULL GROUP BY period, class
    UNION ALL SELECT 'field_size', period, event_type, {q.pct('count(*)', 'count(DISTINCT contest_id)')}, NULL, NULL FROM op GROUP BY period, event_type
    UNION ALL SELECT 'race_length', period, event_type, {q.pct('sum(e)', 'count(e)', 0)}, count(e), NULL FROM op WHERE event_type IN ('tns', 'trophy') GROUP BY period, event_type HAVING count(e) >= 5
    UNION ALL (SELECT 'most_races', NULL, owner_key, races, wins, (SELECT count(*) FROM oy WHERE oy.owner_key = mz.owner_key) FROM mz ORDER BY races DESC, owner_key LIMIT 30)
    UNION ALL SELECT 'streak', s, owner_key, len, s + len - 1, NULL FROM lo
    UNION ALL SELECT 'weekly', period, series_month, count(DISTINCT day), count(DISTINCT entity_id), count(*) FROM bs WHERE event_type = 'tns' AND series_month IS NOT NULL GROUP BY period, series_month
    UNION ALL SELECT 'wind', NULL, CASE WHEN mean_c < 400 THEN 'calm' WHEN mean_c < 1000 THEN 'light' WHEN mean_c < 1600 THEN 'moderate' WHEN mean_c < 2200 THEN 'fresh' ELSE 'strong' END, count(*), NULL, NULL FROM dw GROUP BY 3
    UNION ALL SELECT 'month', CAST(substr(day, 6, 2) AS INTEGER), NULL, {q.pct('CAST(sum(round(temp_c * 10)) AS BIGINT)', 'count(*) * 10')},
        {q.pct('sum(CASE WHEN mean_c <> 0 THEN mean_c END)', 'count(CASE WHEN mean_c <> 0 THEN mean_c END) * 100')}, count(*) FROM dw WHERE temp_c IS NOT NULL AND CAST(substr(day, 6, 2) AS INTEGER) BETWEEN 5 AND 10 GROUP BY 2
    UNION ALL SELECT 'dates', NULL, NULL, count(*), NULL, NULL FROM dw)
    SELECT section, CAST(period AS INTEGER) AS period, CAST(label AS VARCHAR) AS label, CAST(value AS DOUBLE) AS value, CAST(value2 AS DOUBLE) AS value2, CAST(value3 AS DOUBLE) AS value3 FROM x""",
)
def _(t):
    facts = shared_table(season_facts(t), "facts")
    entity, contest = facts.where("kind = 'entity'"), facts.where("kind = 'contest'")
    seen = entity.select(C("id").alias("entity_id"), "period").distinct()
    types = entity.groupBy("period", "id").agg(*[F.max((C("label") == x).cast("int")).alias(x) for x in ("tns", "trophy")])
    back = boards.returning(seen)
    classes = t.boats.select(C("boat_id").alias("id"), idn.design_class("raw_class").alias("class")).where("class IS NOT NULL")
    board = entity.select(C("id").alias("entity_id"), "shown", "wins").where("shown > 0")
    owned = boards.rollup_sum(board, t.entities, ["shown", "wins"]).join(boards.rollup_periods(seen, t.entities), "owner_key")
    runs = boards.longest_run(boards.with_owner(seen, t.entities).select("owner_key", "period").distinct(), "owner_key")
    weekly = facts.where("kind IN ('sailor', 'night')").groupBy("period", "label").agg(
        count_if(C("kind") == "night").alias("a"), count_if(C("kind") == "sailor").alias("b"), F.sum(F.when(C("kind") == "sailor", C("n"))).alias("c")
    )
    days = daily(t)
    bracket = F.lit("strong")
    for name, below in reversed(BRACKETS):
        bracket = F.when(C("mean_c") < below * 100, name).otherwise(bracket)
    months = monthly_means(t).select(C("month").alias("period"), "mean_temp", "mean_wind", "days")
    none = F.lit(None)

    def section(name, df, period=none, label=none, *values):
        values = [*values, none, none][:3]
        return df.select(F.lit(name).alias("section"), period.cast("int").alias("period"), label.cast("string").alias("label"),
                         *[v.cast("double").alias(k) for v, k in zip(values, ("value", "value2", "value3"), strict=True)])

    p, lab = C("period"), C("label")
    new = seen.select("period").distinct().join(boards.first_seen(seen), "period", "left")
    field = contest.groupBy("period", "label").agg(half_up(F.sum("n"), F.count("*"), 1).alias("v"))
    lengths = facts.where("kind = 'type' AND label IN ('tns', 'trophy') AND timed >= 5")
    parts = [
        section("fleet", types.groupBy("period").agg(F.count("*").alias("a"), F.sum("tns").alias("b"), F.sum("trophy").alias("c")), p, none, C("a"), C("b"), C("c")),
        section("newcomers", new, p, none, F.coalesce("newcomers", F.lit(0))),
        section("return_rate", back, p, none, C("entities"), C("returning"), half_up(C("returning") * 100, "entities", 1)),
        section("class", facts.where("kind = 'boat'").join(classes, "id").groupBy("period", "class").agg(F.count("*").alias("n")), p, C("class"), C("n")),
        section("field_size", field, p, lab, C("v")),
        section("race_length", lengths, p, lab, half_up("elapsed", "timed", 0), C("timed")),
        section("most_races", top_k(owned, [F.desc("shown"), C("owner_key")], 30), none, C("owner_key"), C("shown"), C("wins"), C("periods")),
        section("streak", top_k(runs, [F.desc("length"), C("owner_key")], 25), C("start"), C("owner_key"), C("length"), C("end")),
        section("weekly", weekly, p, lab, C("a"), C("b"), C("c")),
        section("wind", days.groupBy(bracket.alias("label")).agg(F.count("*").alias("n")), none, lab, C("n")),
        section("month", months, p, none, C("mean_temp"), C("mean_wind"), C("days")),
        section("dates", days.agg(F.count("*").alias("n")), none, none, C("n")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "A49_overall_indicators",
    f"""WITH {BASE}, {DAILY}, sv AS (SELECT DISTINCT entity_id, period FROM op), pz AS (SELECT DISTINCT period FROM op), nx AS (SELECT period, lead(period) OVER (ORDER BY period) AS np FROM pz),
    rr AS (SELECT a.period, CAST(round(({q.pct('100 * count(b.entity_id)', 'count(*)')}) * 10) AS BIGINT) AS r FROM sv a JOIN nx ON nx.period = a.period AND np IS NOT NULL LEFT JOIN sv b ON b.entity_id = a.entity_id AND b.period = np GROUP BY 1),
    fz AS (SELECT period, event_type, CAST(round(({q.pct('count(*)', 'count(DISTINCT contest_id)')}) * 10) AS BIGINT) AS f FROM op GROUP BY 1, 2),
    nt AS (SELECT period, series_month, count(DISTINCT day) AS n FROM bs WHERE event_type = 'tns' AND series_month IS NOT NULL GROUP BY 1, 2)
    SELECT (SELECT {q.pct('sum(r)', 'count(*) * 10')} FROM rr) AS mean_return_rate, (SELECT {q.pct('sum(f)', 'count(*) * 10')} FROM fz WHERE event_type = 'tns') AS mean_weekly_field,
        (SELECT {q.pct('sum(f)', 'count(*) * 10')} FROM fz WHERE event_type = 'trophy') AS mean_trophy_field, (SELECT {q.pct('100 * count(*) FILTER (mean_c >= 400 AND mean_c < 1600)', 'count(*)')} FROM dw) AS light_moderate_share,
        (SELECT CAST(sum(n) AS BIGINT) FROM nt) AS nights""",
)
def _(t):
    facts = shared_table(season_facts(t, ("entity", "contest", "night")), "facts")
    seen = facts.where("kind = 'entity'").select(C("id").alias("entity_id"), "period").distinct()
    rate = boards.returning(seen).select(F.round(half_up(C("returning") * 100, "entities", 1) * 10).cast("long").alias("v"))
    fields = facts.where("kind = 'contest'").groupBy("period", "label").agg(F.round(half_up(F.sum("n"), F.count("*"), 1) * 10).cast("long").alias("v"))

    def mean(df, name):
        return df.agg(half_up(F.sum("v"), F.count("*") * 10, 1).alias(name))

    calm_enough = (C("mean_c") >= 400) & (C("mean_c") < 1600)
    parts = [
        mean(rate, "mean_return_rate"),
        mean(fields.where("label = 'tns'"), "mean_weekly_field"),
        mean(fields.where("label = 'trophy'"), "mean_trophy_field"),
        daily(t).agg(half_up(count_if(calm_enough) * 100, F.count("*"), 1).alias("light_moderate_share")),
        facts.where("kind = 'night'").agg(F.count("*").alias("nights")),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])
