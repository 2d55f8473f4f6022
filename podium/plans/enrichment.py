"""Winners, records, owners over time, weather and integrity joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from podium.functions import scoring, times
from podium.operators import boards
from podium.operators import events as ev
from podium.operators import history as hi
from podium.operators.measures import count_if, half_up
from podium.operators.ranking import keep_first, top_k
from podium.operators.scope import clean_finish
from podium.plans import dialect as q
from podium.plans.registry import query
from podium.plans.rescoring import WIND, contest_wind, hourly

C = F.col
N = q.n()


@query(
    "J04_contests_without_results",
    "SELECT contest_id, period, event_id FROM contest_headers WHERE contest_id NOT IN (SELECT contest_id FROM results)",
)
def _(t):
    sailed = t.results.select("contest_id").distinct()
    return t.contest_headers.join(sailed, "contest_id", "left_anti").select("contest_id", "period", "event_id")


@query(
    "J05_orphan_check",
    f"""SELECT 'result_contest' AS reference, {N} AS orphans FROM results WHERE contest_id NOT IN (SELECT contest_id FROM contest_headers)
    UNION ALL SELECT 'result_entity', {N} FROM results WHERE entity_id NOT IN (SELECT entity_id FROM entities)
    UNION ALL SELECT 'contest_series', {N} FROM contest_headers WHERE series_id NOT IN (SELECT series_id FROM series)
    UNION ALL SELECT 'series_contest', {N} FROM series WHERE series_id NOT IN (SELECT series_id FROM contest_headers)""",
)
def _(t):
    def orphans(name, child, parent, key):
        # keys are reduced first, so a hot key crosses the shuffle once per task
        loose = child.groupBy(key).agg(F.count("*").alias("n")).join(parent.select(key), key, "left_anti")
        return loose.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans")).select(F.lit(name).alias("reference"), "orphans")

    return (
        orphans("result_contest", t.results, t.contest_headers, "contest_id")
        .union(orphans("result_entity", t.results, t.entities, "entity_id"))
        .union(orphans("contest_series", t.contest_headers, t.series, "series_id"))
        .union(orphans("series_contest", t.series, t.contest_headers, "series_id"))
    )


@query(
    "J06_scalar_subqueries",
    """SELECT contest_id, CAST((SELECT count(DISTINCT r.entity_id) FROM results r WHERE r.contest_id = c.contest_id) AS BIGINT) AS entries,
        (SELECT min(d.period) FROM contest_headers d WHERE d.series_id = c.series_id) AS first_period FROM contest_headers c""",
)
def _(t):
    entries = t.results.select("contest_id", "entity_id").distinct().groupBy("contest_id").agg(F.count("*").alias("entries"))
    first = t.contest_headers.groupBy("series_id").agg(F.min("period").alias("first_period"))
    return (
        t.contest_headers.select("contest_id", "series_id")
        .join(entries, "contest_id", "left")
        .join(first, "series_id")
        .select("contest_id", F.coalesce("entries", F.lit(0)).alias("entries"), "first_period")
    )


TOP_PAIRS = """act AS (SELECT entity_id, row_number() OVER (ORDER BY n DESC, entity_id) AS k FROM
        (SELECT entity_id, count(*) AS n FROM best GROUP BY 1 ORDER BY n DESC, entity_id LIMIT 10)),
    pr AS (SELECT a.k AS pair_id, a.entity_id AS a_id, b.entity_id AS b_id FROM act a JOIN act b ON b.k = a.k + 1)"""


@query(
    "J07_head_to_head",
    f"""WITH {TOP_PAIRS} SELECT CAST(pair_id AS INTEGER) AS pair_id, a_id, b_id, x.period, {N} AS shared, {q.n(cond='x.rank < y.rank')} AS a_wins,
        {q.n(cond='x.rank > y.rank')} AS b_wins, {q.n(cond='x.rank = y.rank')} AS ties
    FROM pr JOIN best x ON x.entity_id = a_id JOIN best y ON y.entity_id = b_id AND y.contest_id = x.contest_id GROUP BY ALL""",
)
def _(t):
    return hi.head_to_head(t.best, active_pairs(t))


def active_pairs(t):
    """The ten entities with most contests, each with the next."""
    active = top_k(t.best.groupBy("entity_id").agg(F.count("*").alias("n")), [F.desc("n"), C("entity_id")], 10)
    in_order = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "entity_id")  # ten rows
    return active.select(
        F.row_number().over(in_order).alias("pair_id"),
        C("entity_id").alias("a_id"),
        F.lead("entity_id").over(in_order).alias("b_id"),
    ).where("b_id IS NOT NULL")


@query(
    "J07_finishers_only",
    f"""WITH {TOP_PAIRS}, fin AS (SELECT contest_id, entity_id, period, min(rank) AS rank FROM scoped WHERE status IS NULL OR status = '' GROUP BY ALL)
    SELECT CAST(pair_id AS INTEGER) AS pair_id, a_id, b_id, x.period, {N} AS shared, {q.n(cond='x.rank < y.rank')} AS a_wins,
        {q.n(cond='x.rank > y.rank')} AS b_wins, {q.n(cond='x.rank = y.rank')} AS ties
    FROM pr JOIN fin x ON x.entity_id = a_id JOIN fin y ON y.entity_id = b_id AND y.contest_id = x.contest_id GROUP BY ALL""",
)
def _(t):
    finished = t.scoped.where(clean_finish()).groupBy("contest_id", "entity_id", "period").agg(F.min("rank").alias("rank"))
    return hi.head_to_head(finished, active_pairs(t))


@query(
    "J09_owner_at_period",
    """WITH w AS (SELECT DISTINCT entity_id, period FROM star), j AS (SELECT w.*, owner, tenure_id, coalesce(start_period, 0) AS s,
        tenure_id IS NOT NULL AND w.period BETWEEN coalesce(start_period, 0) AND coalesce(end_period, 9999) AS ok FROM w LEFT JOIN tenures USING (entity_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY entity_id, period ORDER BY ok DESC NULLS LAST,
        CASE WHEN ok THEN s ELSE -s END, CASE WHEN ok THEN tenure_id ELSE -tenure_id END) AS rn FROM j)
    SELECT entity_id, period, owner, coalesce(ok, false) AS covered FROM k WHERE rn = 1""",
)
def _(t):
    wanted = t.results.join(t.contest_headers, "contest_id").select("entity_id", "period").distinct()
    return hi.owner_at(wanted, t.tenures)


DAILY = f"""dw AS (SELECT day, sum(speed_c) // count(*) AS mean_c, max(speed_c) AS gust_c, count(*) AS n_obs, {q.pct('sum(temp_d)', 'count(temp_d) * 10')} AS temp_c, CAST(sum(rain_mm) AS BIGINT) AS rain_mm,
        CAST(sum(direction) // count(*) AS BIGINT) AS direction, min(sky) AS sky FROM observations GROUP BY 1)"""


def daily(t):
    """Weather of every date that has observations."""
    return t.observations.groupBy("day").agg(
        F.call_function("div", F.sum("speed_c"), F.count("*")).alias("mean_c"),
        F.max("speed_c").alias("gust_c"),
        F.count("*").alias("n_obs"),
        half_up(F.sum("temp_d"), F.count("temp_d") * 10, 1).alias("temp_c"),
        F.sum("rain_mm").alias("rain_mm"),
        F.call_function("div", F.sum("direction"), F.count("*")).alias("direction"),
        F.min("sky").alias("sky"),
    )


def levels(t):
    """Readings of every date in the order of hours, 24 at most."""
    return hourly(t).groupBy("day").agg(F.array_sort(F.collect_list(F.struct("hour", "wind_kc"))).alias("levels"))


@query(
    "J11_weather_by_date",
    f"""WITH {WIND}, {DAILY}, ls AS (SELECT day, string_agg(hour || ':' || wind_kc, ' ' ORDER BY hour) AS levels FROM hw GROUP BY 1)
    SELECT contest_id, day AS contest_date, CAST(mean_c AS BIGINT) AS mean_c, gust_c, CAST(n_obs AS BIGINT) AS n_obs, temp_c, rain_mm, direction, levels
    FROM contest_headers LEFT JOIN dw USING (day) LEFT JOIN ls USING (day)""",
)
def _(t):
    text = F.array_join(F.transform("levels", lambda x: F.concat_ws(":", x["hour"], x["wind_kc"])), " ")
    return (
        t.contest_headers.select("contest_id", "day")
        .join(daily(t).drop("sky"), "day", "left")
        .join(levels(t).select("day", text.alias("levels")), "day", "left")
        .withColumnRenamed("day", "contest_date")
    )


@query(
    "A25_wind_brackets",
    f"""WITH {WIND} SELECT CASE WHEN wind_kc < 400 THEN '0-3' WHEN wind_kc < 1000 THEN '4-9' WHEN wind_kc < 1600 THEN '10-15'
        WHEN wind_kc < 2200 THEN '16-21' ELSE '22+' END AS bracket, {N} AS contests FROM cw WHERE wind_kc IS NOT NULL GROUP BY 1""",
)
def _(t):
    k = C("wind_kc") / 100
    bracket = F.when(k < 4, "0-3").when(k < 10, "4-9").when(k < 16, "10-15").when(k < 22, "16-21").otherwise("22+")
    return contest_wind(t).where("wind_kc IS NOT NULL").groupBy(bracket.alias("bracket")).agg(F.count("*").alias("contests"))


@query(
    "A26_monthly_means",
    f"""WITH {DAILY} SELECT CAST(substr(day, 6, 2) AS INTEGER) AS month, {N} AS days, {q.pct('CAST(sum(round(temp_c * 10)) AS BIGINT)', 'count(*) * 10')} AS mean_temp,
        {q.pct('sum(CASE WHEN mean_c <> 0 THEN mean_c END)', 'count(CASE WHEN mean_c <> 0 THEN mean_c END) * 100')} AS mean_wind
    FROM dw WHERE temp_c IS NOT NULL AND CAST(substr(day, 6, 2) AS INTEGER) BETWEEN 5 AND 10 GROUP BY 1""",
)
def _(t):
    return monthly_means(t)


def monthly_means(t):
    month = F.substring("day", 6, 2).cast("int")
    blowing = F.when(C("mean_c") != 0, C("mean_c"))
    tenths = F.round(C("temp_c") * 10).cast("long")
    return (
        daily(t)
        .withColumn("month", month)
        .where("temp_c IS NOT NULL AND month BETWEEN 5 AND 10")
        .groupBy("month")
        .agg(
            F.count("*").alias("days"),
            half_up(F.sum(tenths), F.count("*") * 10, 1).alias("mean_temp"),
            half_up(F.sum(blowing), F.count(blowing) * 100, 1).alias("mean_wind"),
        )
    )


OUT = "coalesce(status IN ('DNF','DNS','OCS','DSQ','RAF','DNC','RET'), false)"
OK = "(elapsed_s > greatest(1200, CAST(floor(distance_nm / 7.5e0 * 3600) AS INT)) AND elapsed_s < 36000)"
YEARLY = f"""yc AS (SELECT series_id, period, distance_nm, event_type, {q.n(cond=f'NOT {OUT} AND {OK}')} AS finishers, {q.n(cond=OUT)} AS unfinished,
        arg_min(elapsed_s, contest_id) FILTER (NOT {OUT} AND {OK} AND rank = 1) AS winner_s,
        arg_min(entity_id, contest_id) FILTER (NOT {OUT} AND {OK} AND rank = 1) AS winner_id,
        min(contest_id) FILTER (NOT {OUT} AND {OK} AND rank = 1) AS contest_id FROM star GROUP BY 1, 2, 3, 4)"""


def yearly(t):
    return hi.yearly_course_times(t.star, ["series_id", "period", "distance_nm", "event_type"])


@query(
    "W14_first_winner_per_period",
    f"WITH {YEARLY} SELECT series_id, period, finishers, unfinished, contest_id, winner_s, winner_id FROM yc",
)
def _(t):
    return yearly(t).drop("distance_nm", "event_type")


@query(
    "F07_plausible_times",
    f"""SELECT period, {N} AS entries, {q.n(cond=OK)} AS plausible, {q.n(cond='elapsed_s > 600 AND elapsed_s < 18000')} AS usual
    FROM results JOIN contest_headers USING (contest_id) GROUP BY 1""",
)
def _(t):
    rows = t.results.join(t.contest_headers, "contest_id")
    return rows.groupBy("period").agg(
        F.count("*").alias("entries"),
        count_if(hi.plausible_time(C("elapsed_s"), C("distance_nm"))).alias("plausible"),
        count_if((C("elapsed_s") > 600) & (C("elapsed_s") < 18000)).alias("usual"),
    )


COURSES = (("cup 1", "#1 Outer", 16.5), ("laser", "#2 Inner", 4.25), ("s cup", "#3 Round", 22.0), ("cup 7", "#4 Bay", 9.0))


@query(
    "F08_fixed_course",
    f"""SELECT CASE WHEN contains(lower(event_name), 'cup 1') THEN '#1 Outer' WHEN contains(lower(event_name), 'laser') THEN '#2 Inner'
        WHEN contains(lower(event_name), 's cup') THEN '#3 Round' WHEN contains(lower(event_name), 'cup 7') THEN '#4 Bay' END AS course,
        CASE WHEN contains(lower(event_name), 'cup 1') THEN 16.5e0 WHEN contains(lower(event_name), 'laser') THEN 4.25e0
        WHEN contains(lower(event_name), 's cup') THEN 22e0 WHEN contains(lower(event_name), 'cup 7') THEN 9e0 END AS distance_nm, {N} AS series
    FROM series GROUP BY ALL""",
)
def _(t):
    found = t.series.select(hi.fixed_course("event_name", COURSES).alias("c"))
    return found.groupBy("c.course", "c.distance_nm").agg(F.count("*").alias("series"))


@query(
    "A27_wind_correlation",
    f"""WITH {YEARLY}, {WIND}, w AS (SELECT distance_nm, winner_s, wind_kc * 1.852e0 / 100 AS kmh FROM yc JOIN cw USING (contest_id)
        WHERE winner_s IS NOT NULL)
    SELECT distance_nm, {q.n(cond='kmh < 15')} AS light_n, {q.pct('sum(winner_s) FILTER (kmh < 15)', 'count(*) FILTER (kmh < 15)')} AS light_s,
        {q.n(cond='kmh >= 15 AND kmh <= 25')} AS moderate_n, {q.pct('sum(winner_s) FILTER (kmh >= 15 AND kmh <= 25)', 'count(*) FILTER (kmh >= 15 AND kmh <= 25)')} AS moderate_s,
        {q.n(cond='kmh > 25')} AS heavy_n, {q.pct('sum(winner_s) FILTER (kmh > 25)', 'count(*) FILTER (kmh > 25)')} AS heavy_s FROM w GROUP BY 1""",
)
def _(t):
    kmh = C("wind_kc") * F.lit(scoring.KMH_PER_KT) / 100
    rows = yearly(t).where("winner_s IS NOT NULL").join(contest_wind(t), "contest_id").withColumn("kmh", kmh)
    classes = {
        "light": C("kmh") < hi.LIGHT_KMH,
        "moderate": (C("kmh") >= hi.LIGHT_KMH) & (C("kmh") <= hi.HEAVY_KMH),
        "heavy": C("kmh") > hi.HEAVY_KMH,
    }
    aggs = []
    for name, cond in classes.items():
        aggs.append(count_if(cond).alias(f"{name}_n"))
        aggs.append(half_up(F.sum(F.when(cond, C("winner_s"))), count_if(cond), 1).alias(f"{name}_s"))
    return rows.groupBy("distance_nm").agg(*aggs)


@query(
    "A28_course_records",
    f"""WITH {YEARLY}, r AS (SELECT *, row_number() OVER (PARTITION BY distance_nm ORDER BY winner_s, period, series_id) AS f,
        row_number() OVER (PARTITION BY distance_nm ORDER BY winner_s DESC, period, series_id) AS l,
        count(*) OVER (PARTITION BY distance_nm) AS timed FROM yc WHERE winner_s IS NOT NULL)
    SELECT a.distance_nm, CAST(a.timed AS BIGINT) AS timed, a.winner_s AS fastest_s, a.period AS fastest_period, a.winner_id AS fastest_id,
        b.winner_s AS slowest_s, b.period AS slowest_period, b.winner_id AS slowest_id, a.distance_nm / (a.winner_s / 3600e0) AS fastest_kt
    FROM r a JOIN r b ON b.distance_nm = a.distance_nm AND b.l = 1 WHERE a.f = 1""",
)
def _(t):
    best = hi.records(yearly(t), ["distance_nm"])
    return best.withColumn("fastest_kt", scoring.speed_kt("distance_nm", "fastest_s"))


@query(
    "A29_upper_median",
    f"""WITH {YEARLY}, o AS (SELECT distance_nm, winner_s, row_number() OVER (PARTITION BY distance_nm ORDER BY winner_s) - 1 AS i,
        count(*) OVER (PARTITION BY distance_nm) AS n FROM yc WHERE winner_s IS NOT NULL)
    SELECT distance_nm, CAST(n AS BIGINT) AS n, winner_s AS median, format('{{}}:{{:02d}}:{{:02d}}', winner_s // 3600, winner_s // 60 % 60, winner_s % 60) AS clock
    FROM o WHERE i = n // 2""",
)
def _(t):
    return boards.upper_median(yearly(t), ["distance_nm"], "winner_s").withColumn("clock", times.clock("median"))


@query(
    "A38_hour_window",
    f"""SELECT day, {q.pct('sum(speed_c)', 'count(*) * 100')} AS kmh, max(speed_c) AS gust_c, {q.pct('sum(direction)', 'count(*)', 0)} AS direction,
        {q.n('DISTINCT hour')} AS hours FROM observations WHERE hour BETWEEN 13 AND 17 GROUP BY 1""",
)
def _(t):
    window = t.observations.where("hour BETWEEN 13 AND 17")
    per_hour = window.groupBy("day", "hour").agg(
        F.sum("speed_c").alias("s"), F.max("speed_c").alias("g"), F.sum("direction").alias("d"), F.count("*").alias("n")
    )
    return per_hour.groupBy("day").agg(
        half_up(F.sum("s"), F.sum("n") * 100, 1).alias("kmh"),
        F.max("g").alias("gust_c"),
        half_up(F.sum("d"), F.sum("n"), 0).alias("direction"),
        F.count("*").alias("hours"),
    )


@query(
    "A39_mode_start_hour",
    """SELECT strftime(contest_date, '%Y-%m-%d') AS contest_date, start_hour AS hour, n AS contests FROM (SELECT contest_date, start_hour,
        CAST(count(*) AS BIGINT) AS n, row_number() OVER (PARTITION BY contest_date ORDER BY count(*) DESC, start_hour) AS rn
        FROM contest_headers GROUP BY 1, 2) WHERE rn = 1""",
)
def _(t):
    counts = t.contest_headers.groupBy("contest_date", "start_hour").agg(F.count("*").alias("n"))
    best = counts.groupBy("contest_date").agg(F.max(F.struct("n", (-C("start_hour")).alias("h"))).alias("b"))
    return best.select(
        F.date_format("contest_date", "yyyy-MM-dd").alias("contest_date"),
        (-C("b.h")).alias("hour"),
        C("b.n").alias("contests"),
    )


@query(
    "W09_alternating_label",
    f"""WITH {WIND}, x AS (SELECT day, hour, wind_kc, row_number() OVER w AS i, count(*) OVER (PARTITION BY day) AS n,
        first_value(wind_kc) OVER w AS a, nth_value(wind_kc, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b
        FROM hw WINDOW w AS (PARTITION BY day ORDER BY hour))
    SELECT day, hour, CAST(wind_kc AS BIGINT) AS wind_kc, CASE WHEN n = 1 THEN CASE WHEN wind_kc > 100 THEN 'high' ELSE 'low' END
        WHEN a > b THEN CASE WHEN i % 2 = 1 THEN 'high' ELSE 'low' END ELSE CASE WHEN i % 2 = 1 THEN 'low' ELSE 'high' END END AS label FROM x""",
)
def _(t):
    return hi.high_low(hourly(t).drop("n_obs"), ["day"], "hour", "wind_kc", 100)


STAND = """sw AS (SELECT event_id, series_id, period, entity_id, CASE WHEN entity_id % 3 = 0 THEN 'overall' ELSE 'a_fleet' END AS scope,
        CAST(sum(points) AS BIGINT) AS nett FROM star WHERE event_type <> 'trophy' GROUP BY ALL HAVING min(rank) = 1),
    pw AS (SELECT series_id, period, event_id, entity_id, nett, scope FROM (SELECT *, row_number() OVER (PARTITION BY series_id, period
        ORDER BY CASE scope WHEN 'overall' THEN 0 ELSE 1 END, nett, entity_id) AS rn FROM sw) WHERE rn = 1),
    rw AS (SELECT series_id, period, event_id, entity_id, CAST(points AS BIGINT) AS nett, 'race' AS scope FROM (SELECT *, row_number() OVER
        (PARTITION BY series_id, period ORDER BY points, contest_id) AS rn FROM star WHERE rank = 1) WHERE rn = 1),
    wn AS (SELECT * FROM pw UNION ALL SELECT * FROM rw WHERE series_id NOT IN (SELECT series_id FROM pw))"""


def standing_winners(t):
    scope = F.when(C("entity_id") % 3 == 0, "overall").otherwise("a_fleet").alias("scope")
    return (
        t.star.where("event_type <> 'trophy'")
        .groupBy("event_id", "series_id", "period", "entity_id", scope)
        .agg(F.sum("points").alias("nett"), F.min("rank").alias("r"))
        .where("r = 1")
        .drop("r")
    )


def winners(t):
    first = hi.preferred_winner(standing_winners(t), ["series_id", "period"])
    rows = t.star.where("rank = 1").select(
        "series_id", "period", "event_id", "entity_id", C("points").cast("long").alias("nett"), "contest_id",
        F.lit("race").alias("scope"),
    )
    second = keep_first(rows, ["series_id", "period"], [C("nett"), C("contest_id")]).drop("contest_id")
    # races count only where a series has no standings at all
    return hi.with_fallback(first, second, ["series_id"])


@query("W04_preferred_winner", f"WITH {STAND} SELECT * FROM pw")
def _(t):
    return hi.preferred_winner(standing_winners(t), ["series_id", "period"])


@query("W05_fallback_winner", f"WITH {STAND} SELECT * FROM wn")
def _(t):
    return winners(t)


@query(
    "W06_first_per_logical_race",
    f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY event_id, contest_no, contest_key, contest_date, entity_id ORDER BY rank, contest_id, boat_id, line_no) AS rn FROM star)
    SELECT event_id, entity_id, contest_id, rank, boat_id FROM d WHERE rn = 1""",
)
def _(t):
    race = ["event_id", "contest_no", "contest_key", "contest_date", "entity_id"]
    rows = t.star.select(*race, "contest_id", "rank", "boat_id", "line_no")
    first = keep_first(rows, race, [C("rank"), C("contest_id"), C("boat_id"), C("line_no")])
    return first.select("event_id", "entity_id", "contest_id", "rank", "boat_id")


RAW_RANK = "CASE line_no % 4 WHEN 0 THEN CAST(points AS STRING) || 'th' WHEN 1 THEN 'DNC' WHEN 2 THEN CAST(points AS STRING) ELSE NULL END"


@query(
    "W11_rank_fill",
    f"""SELECT contest_id, boat_id, line_no, entity_id, CAST(CASE line_no % 4 WHEN 0 THEN points WHEN 2 THEN points
        ELSE CASE WHEN points > 5 THEN rank END END AS BIGINT) AS filled FROM ranked""",
)
def _(t):
    filled = F.coalesce(times.first_number(F.expr(RAW_RANK)), F.when(C("points") > 5, C("rank")))
    return t.ranked.select("contest_id", "boat_id", "line_no", "entity_id", filled.alias("filled"))


HISTORICAL = "series_id, CAST(1994 + series_id % 9 AS INT) AS period, 'Owner ' || CAST(series_id % 25 AS STRING) AS winner"


def trophy_winners(t):
    """Winners from the results, then historical ones for the years the results do not know."""
    known = winners(t).select(
        "series_id", "period", "event_id", F.concat(F.lit("Entity "), C("entity_id").cast("string")).alias("winner"),
        F.lit("results").alias("source"),
    )
    past = t.series.selectExpr(*[x.strip() for x in HISTORICAL.replace("AS INT),", "AS INT)").split(", ")])
    events = t.contest_headers.select("series_id", "period", "event_id").distinct()
    added = past.join(events, ["series_id", "period"], "left").withColumn("source", F.lit("historical"))
    return hi.with_fallback(known, added, ["series_id", "period"])


TROPHY = f"""{STAND}, hs AS (SELECT {HISTORICAL} FROM series), ek AS (SELECT DISTINCT series_id, period, event_id FROM contest_headers),
    tw AS (SELECT series_id, period, event_id, 'Entity ' || entity_id AS winner, 'results' AS source FROM wn UNION ALL
        SELECT series_id, period, event_id, winner, 'historical' FROM hs LEFT JOIN ek USING (series_id, period)
        WHERE (series_id, period) NOT IN (SELECT (series_id, period) FROM wn))"""


@query("J18_historical_union", f"WITH {TROPHY} SELECT * FROM tw")
def _(t):
    return trophy_winners(t)


@query(
    "A48_mart_totals",
    f"""WITH {TROPHY} SELECT {q.n('DISTINCT series_id')} AS trophies, {N} AS winners, {q.n(cond="source = 'historical'")} AS historical,
        min(period) AS oldest FROM tw""",
)
def _(t):
    per = trophy_winners(t).groupBy("series_id").agg(
        F.count("*").alias("n"), count_if(C("source") == "historical").alias("h"), F.min("period").alias("p")
    )
    return per.agg(
        F.count("*").alias("trophies"), F.sum("n").alias("winners"), F.sum("h").alias("historical"), F.min("p").alias("oldest")
    )


@query(
    "A44_most_frequent_winner",
    f"""WITH {STAND}, c AS (SELECT series_id, entity_id, count(*) AS n FROM wn GROUP BY 1, 2)
    SELECT series_id, entity_id, CAST(n AS BIGINT) AS wins FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY n DESC, entity_id) AS rn FROM c) WHERE rn = 1""",
)
def _(t):
    counts = winners(t).groupBy("series_id", "entity_id").agg(F.count("*").alias("n"))
    best = counts.groupBy("series_id").agg(F.max(F.struct("n", (-C("entity_id")).alias("e"))).alias("b"))
    return best.select("series_id", (-C("b.e")).alias("entity_id"), C("b.n").alias("wins"))
