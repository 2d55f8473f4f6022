"""Leaderboards, roll-ups, cohorts and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from podium.functions import identifiers as idn
from podium.operators import boards
from podium.operators.measures import count_if, half_up, wins
from podium.operators.ranking import hot_groups, rank_within, top_k
from podium.operators.scope import clean_finish, showed_up
from podium.plans import dialect as q
from podium.plans import events
from podium.plans.registry import query

C = F.col
N = q.n()
WINS = q.n(cond="rank = 1")


@query(
    "L01_win_leaderboard",
    f"""SELECT entity_id, {N} AS contests, {WINS} AS wins, {q.pct('100 * count(*) FILTER (rank = 1)', 'count(*)')} AS win_pct
    FROM best GROUP BY entity_id HAVING count(*) FILTER (rank = 1) > 0 ORDER BY wins DESC, entity_id LIMIT 25""",
)
def _(t):
    board = (
        t.best.groupBy("entity_id")
        .agg(F.count("*").alias("contests"), wins().alias("wins"))
        .where("wins > 0")
        .withColumn("win_pct", half_up(C("wins") * 100, "contests", 1))
    )
    return top_k(board, [F.desc("wins"), C("entity_id")], 25)


@query(
    "J01_star_join",
    f"""SELECT period, event_type, participant_type, {N} AS entries, CAST(sum(metric) AS DOUBLE) / 100 AS metric
    FROM star JOIN entities USING (entity_id) GROUP BY ALL""",
)
def _(t):
    return (
        t.results.join(t.contests, "contest_id")
        .join(t.entities, "entity_id")
        .groupBy("period", "event_type", "participant_type")
        .agg(F.count("*").alias("entries"), (F.sum("metric").cast("double") / 100).alias("metric"))
    )


@query(
    "A01_best_rank_tally",
    f"""SELECT entity_id, {N} AS contests, {WINS} AS wins, {q.n(cond='rank <= 3')} AS podiums,
        {q.pct('sum(rank)', 'count(rank)', 2)} AS avg_rank FROM best GROUP BY 1""",
)
def _(t):
    return boards.tally(t.best, ["entity_id"])


@query(
    "A02_kpi_snapshot",
    f"""WITH {events.GROUPS}, va AS (SELECT event_id FROM cg WHERE is_variant) SELECT (SELECT CAST(count(*) AS BIGINT) FROM contests) AS contests,
        (SELECT CAST(count(DISTINCT event_id) AS BIGINT) FROM contests) AS events,
        (SELECT CAST(count(DISTINCT event_id) AS BIGINT) FROM contests WHERE event_id NOT IN (SELECT event_id FROM va)) AS canonical_events,
        (SELECT CAST(count(DISTINCT event_id) AS BIGINT) FROM contests WHERE event_id NOT IN (SELECT event_id FROM special_events)) AS regular_events,
        (SELECT CAST(count(DISTINCT event_id) AS BIGINT) FROM open_contests) AS open_events,
        (SELECT CAST(count(DISTINCT period) AS BIGINT) FROM contests) AS seasons,
        (SELECT min(period) FROM contests) AS first_period, (SELECT max(period) FROM contests) AS last_period,
        (SELECT CAST(count(*) AS BIGINT) FROM star) AS results, (SELECT CAST(count(*) AS BIGINT) FROM star WHERE event_id NOT IN (SELECT event_id FROM va)) AS canonical_results,
        (SELECT CAST(count(*) AS BIGINT) FROM scoped) AS scoped_results, (SELECT CAST(count(DISTINCT entity_id) AS BIGINT) FROM scoped) AS scoped_entities,
        (SELECT CAST(count(*) AS BIGINT) FROM entities) AS entities""",
)
def _(t):
    flags = t.skipped.select(C("event_id").alias("flagged"), "special", "variant")
    contests = t.contests.join(flags, C("event_id") == C("flagged"), "left").fillna(False, ["special", "variant"])
    contests = contests.withColumn("open", ~C("special") & ~C("variant"))
    per_event = contests.groupBy("event_id", "period", "special", "variant", "open").agg(F.count("*").alias("n"))
    heads = per_event.groupBy("period").agg(
        F.sum("n").alias("n"), F.count("*").alias("e"), count_if(~C("variant")).alias("c"), count_if(~C("special")).alias("r"), count_if(C("open")).alias("o")
    ).agg(
        F.sum("n").alias("contests"),
        F.sum("e").alias("events"),
        F.sum("c").alias("canonical_events"),
        F.sum("r").alias("regular_events"),
        F.sum("o").alias("open_events"),
        F.count("*").alias("seasons"),
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
    )
    star = t.results.join(contests, "contest_id")
    inside = showed_up("status") & C("open")
    by_entity = star.groupBy("entity_id").agg(F.count("*").alias("n"), count_if(~C("variant")).alias("c"), count_if(inside).alias("s"))
    facts = by_entity.agg(
        F.sum("n").alias("results"), F.sum("c").alias("canonical_results"), F.sum("s").alias("scoped_results"), count_if(C("s") > 0).alias("scoped_entities")
    )
    dims = t.entities.agg(F.count("*").alias("entities"))
    rows = heads.unionByName(facts, True).unionByName(dims, True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


@query(
    "A03_conditional_distinct",
    """SELECT event_type, CAST(count(DISTINCT entity_id) AS BIGINT) AS entities,
        CAST(count(DISTINCT entity_id) FILTER (participant_type = 'helm') AS BIGINT) AS helms,
        CAST(count(DISTINCT entity_id) FILTER (participant_type = 'boat') AS BIGINT) AS boats
    FROM star JOIN entities USING (entity_id) GROUP BY 1""",
)
def _(t):
    once = t.results.join(t.contests, "contest_id").select("event_type", "entity_id").distinct()
    return (
        once.join(t.entities, "entity_id")
        .groupBy("event_type")
        .agg(
            F.count("*").alias("entities"),
            count_if(C("participant_type") == "helm").alias("helms"),
            count_if(C("participant_type") == "boat").alias("boats"),
        )
    )


@query(
    "A04_win_rate_by_type",
    f"""SELECT entity_id, event_type, {WINS} AS wins, {q.pct('100 * count(*) FILTER (rank = 1)', 'count(*)')} AS win_pct
    FROM best GROUP BY 1, 2""",
)
def _(t):
    return t.best.groupBy("entity_id", "event_type").agg(
        wins().alias("wins"), half_up(wins() * 100, F.count("*"), 1).alias("win_pct")
    )


@query(
    "A05_having_thresholds",
    f"""SELECT entity_id, {N} AS contests, {WINS} AS wins FROM best GROUP BY 1
    HAVING count(*) >= 20 AND count(*) FILTER (rank = 1) > 0""",
)
def _(t):
    board = t.best.groupBy("entity_id").agg(F.count("*").alias("contests"), wins().alias("wins"))
    return board.where("contests >= 20 AND wins > 0")


FIELD_SQL = f"""WITH clean AS (SELECT contest_id, entity_id, min(rank) AS rank FROM star
        WHERE contest_id IN (SELECT contest_id FROM open_contests) AND (status IS NULL OR status = '') GROUP BY 1, 2),
    field AS (SELECT contest_id, count(*) AS n FROM star WHERE contest_id IN (SELECT contest_id FROM open_contests)
        AND (status IS NULL OR status = '') GROUP BY 1),
    finish AS (SELECT entity_id, {N} AS contests,
        {q.pct('sum((2000000 * rank + n) // (2 * n))', 'count(*) * 10000')} AS avg_finish_pct
        FROM clean JOIN field USING (contest_id) GROUP BY 1)"""


def _finish(t):
    """Mean finishing place as a percentage of the field of clean finishers."""
    contests = t.open_contests.select("contest_id")
    clean = t.ranked.where(clean_finish()).join(contests, "contest_id")
    per_entity = clean.groupBy("contest_id", "entity_id").agg(F.min("rank").alias("rank"))
    field = clean.groupBy("contest_id").agg(F.count("*").alias("n"))
    ppm = F.call_function("div", C("rank") * 2_000_000 + C("n"), C("n") * 2)
    return (
        per_entity.join(field, "contest_id")
        .groupBy("entity_id")
        .agg(F.count("*").alias("contests"), half_up(F.sum(ppm), F.count("*") * 10_000, 1).alias("avg_finish_pct"))
    )


@query("A06_field_normalised_finish", f"{FIELD_SQL} SELECT * FROM finish WHERE contests >= 20")
def _(t):
    return _finish(t).where("contests >= 20")


@query(
    "F03_clean_finish",
    f"SELECT status, {N} AS entries, {q.n(cond='rank = 1')} AS winners FROM ranked WHERE rank IS NOT NULL AND (status IS NULL OR status = '') GROUP BY 1",
)
def _(t):
    return t.ranked.where(clean_finish()).groupBy("status").agg(F.count("*").alias("entries"), wins().alias("winners"))


@query(
    "F02_no_show_filter",
    f"SELECT status, {N} AS entries FROM results WHERE status IS NULL OR status NOT IN ('DNS', 'DNC') GROUP BY 1",
)
def _(t):
    from podium.operators.scope import showed_up

    return t.results.where(showed_up()).groupBy("status").agg(F.count("*").alias("entries"))


@query(
    "A07_status_of_best_row",
    """SELECT contest_id, entity_id, rank, status FROM (SELECT *, row_number() OVER (PARTITION BY contest_id, entity_id
        ORDER BY rank) AS rn FROM ranked) WHERE rn = 1""",
)
def _(t):
    # a struct keeps the status of the minimum row even where it is null
    best = t.ranked.groupBy("contest_id", "entity_id").agg(F.min(F.struct("rank", "status")).alias("b"))
    return best.select("contest_id", "entity_id", "b.rank", "b.status")


@query(
    "A08_per_period",
    f"""SELECT entity_id, period, {N} AS contests, {WINS} AS wins, {q.n(cond='rank <= 3')} AS podiums,
        {q.pct('sum(rank)', 'count(rank)', 2)} AS avg_rank FROM best GROUP BY 1, 2""",
)
def _(t):
    return boards.tally(t.best, ["entity_id", "period"])


@query(
    "A09_fleet_by_period",
    f"""SELECT period, CAST(count(DISTINCT entity_id) AS BIGINT) AS entities, {N} AS results
    FROM results JOIN open_contests USING (contest_id) GROUP BY 1""",
)
def _(t):
    open_contests = t.open_contests.select("contest_id", "period")
    per = t.results.join(open_contests, "contest_id").groupBy("period", "entity_id").agg(F.count("*").alias("n"))
    return per.groupBy("period").agg(F.count("*").alias("entities"), F.sum("n").alias("results"))


# Presence of stations on days: sparse enough for cohorts, returns and streaks to vary.
SEEN = "SELECT DISTINCT station_id AS entity_id, day_no AS period FROM observations WHERE speed_c >= 9000"


def _seen(t):
    return t.observations.where("speed_c >= 9000").selectExpr("station_id AS entity_id", "day_no AS period").distinct()


@query(
    "A10_first_appearance",
    f"SELECT period, {N} AS newcomers FROM (SELECT entity_id, min(period) AS period FROM ({SEEN}) GROUP BY 1) GROUP BY 1",
)
def _(t):
    return boards.first_seen(_seen(t))


RETURN_SQL = f"""WITH seen AS ({SEEN}), cal AS (SELECT period, lead(period) OVER (ORDER BY period) AS next_period
        FROM (SELECT DISTINCT period FROM seen)),
    ret AS (SELECT a.period, c.next_period, count(*) AS entities, count(b.entity_id) AS back FROM seen a JOIN cal c USING (period)
        LEFT JOIN seen b ON b.entity_id = a.entity_id AND b.period = c.next_period WHERE c.next_period IS NOT NULL GROUP BY 1, 2)"""


@query(
    "J08_consecutive_overlap",
    f"{RETURN_SQL} SELECT period, next_period, CAST(entities AS BIGINT) AS entities, CAST(back AS BIGINT) AS returning FROM ret",
)
def _(t):
    return boards.returning(_seen(t))


@query(
    "A11_retention_rate",
    f"{RETURN_SQL} SELECT next_period AS period, {q.pct('100 * back', 'entities')} AS return_rate FROM ret",
)
def _(t):
    back = boards.returning(_seen(t))
    return back.select(C("next_period").alias("period"), half_up(C("returning") * 100, "entities", 1).alias("return_rate"))


@query(
    "U03_seen_in_both",
    f"""WITH seen AS ({SEEN}) SELECT entity_id FROM seen WHERE period <= 15
        INTERSECT SELECT entity_id FROM seen WHERE period > 15""",
)
def _(t):
    seen = _seen(t)
    return seen.where("period <= 15").select("entity_id").intersect(seen.where("period > 15").select("entity_id"))


@query(
    "W03_longest_streak",
    f"""WITH seen AS ({SEEN}), runs AS (SELECT entity_id, count(*) AS n, min(period) AS s, max(period) AS e FROM
        (SELECT *, period - row_number() OVER (PARTITION BY entity_id ORDER BY period) AS g FROM seen) GROUP BY entity_id, g)
    SELECT entity_id, CAST(n AS BIGINT) AS length, s AS "start", e AS "end" FROM
        (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, s) AS rn FROM runs) WHERE rn = 1 AND n >= 3""",
)
def _(t):
    return boards.longest_run(_seen(t))


@query(
    "A12_class_mix",
    f"""SELECT period, class, {N} AS boats FROM (SELECT DISTINCT period, boat_id, {q.design_class('raw_class')} AS class
        FROM results JOIN contest_headers USING (contest_id) JOIN boats USING (boat_id)) WHERE class IS NOT NULL GROUP BY 1, 2""",
)
def _(t):
    classes = t.boats.select("boat_id", idn.design_class("raw_class").alias("class")).where("class IS NOT NULL")
    used = t.results.join(t.contest_headers, "contest_id").select("period", "boat_id").distinct()
    return used.join(classes, "boat_id").groupBy("period", "class").agg(F.count("*").alias("boats"))


@query(
    "A13_mean_field_size",
    f"""SELECT period, event_type, {q.pct('sum(n)', 'count(*)')} AS mean_field, {N} AS contests
    FROM (SELECT contest_id, period, event_type, count(*) AS n FROM best GROUP BY ALL) GROUP BY 1, 2""",
)
def _(t):
    sizes = t.best.groupBy("contest_id", "period", "event_type").agg(F.count("*").alias("n"))
    return sizes.groupBy("period", "event_type").agg(
        half_up(F.sum("n"), F.count("*"), 1).alias("mean_field"), F.count("*").alias("contests")
    )


@query(
    "A14_mean_with_min_sample",
    f"""WITH x AS (SELECT period, event_type, day_no, elapsed_s, CASE WHEN rating < 200 THEN elapsed_s * 650 // (550 + rating) END AS corrected_s FROM star),
    y AS (SELECT period, event_type, day_no, CASE WHEN elapsed_s > 600 AND elapsed_s < 18000 THEN elapsed_s END AS e,
        CASE WHEN corrected_s > 600 AND corrected_s < 18000 THEN corrected_s END AS c FROM x)
    SELECT period, event_type, day_no AS day, CASE WHEN count(e) >= 5 THEN {q.pct('sum(e)', 'count(e)')} END AS mean_elapsed,
        CASE WHEN count(c) >= 5 THEN {q.pct('sum(c)', 'count(c)')} END AS mean_corrected FROM y GROUP BY 1, 2, 3""",
)
def _(t):
    def plausible(x):
        return F.when((x > 600) & (x < 18000), x)

    corrected = F.when(C("rating") < 200, F.call_function("div", C("elapsed_s") * 650, C("rating") + 550))
    timed = t.results.select("contest_id", plausible(C("elapsed_s")).alias("e"), plausible(corrected).alias("c"))

    def mean(x):
        return F.when(F.count(x) >= 5, half_up(F.sum(x), F.count(x), 1))

    return (
        timed.join(t.contests, "contest_id")
        .groupBy("period", "event_type", C("day_no").alias("day"))
        .agg(mean("e").alias("mean_elapsed"), mean("c").alias("mean_corrected"))
    )


OWNERS = "own AS (SELECT entity_id, coalesce(owner, 'boat:' || CAST(entity_id AS VARCHAR)) AS owner_key FROM entities)"


@query(
    "A15_owner_sum",
    f"""WITH {OWNERS}, b AS (SELECT entity_id, count(*) AS contests, count(*) FILTER (rank = 1) AS wins FROM best GROUP BY 1),
    o AS (SELECT owner_key, {N} AS members, CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(contests) AS BIGINT) AS contests
        FROM b JOIN own USING (entity_id) GROUP BY 1)
    SELECT *, {q.pct('100 * wins', 'contests')} AS win_pct FROM o ORDER BY wins DESC, owner_key LIMIT 25""",
)
def _(t):
    board = t.best.groupBy("entity_id").agg(F.count("*").alias("contests"), wins().alias("wins"))
    merged = boards.rollup_sum(board, t.entities, ["wins", "contests"])
    return top_k(
        merged.withColumn("win_pct", half_up(C("wins") * 100, "contests", 1)), [F.desc("wins"), C("owner_key")], 25
    )


@query(
    "L02_cut_before_merge",
    f"""WITH {OWNERS}, b AS (SELECT entity_id, count(*) AS contests, count(*) FILTER (rank = 1) AS wins FROM best GROUP BY 1
        ORDER BY wins DESC, entity_id LIMIT 25)
    SELECT owner_key, {N} AS members, CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(contests) AS BIGINT) AS contests
    FROM b JOIN own USING (entity_id) GROUP BY 1""",
)
def _(t):
    board = t.best.groupBy("entity_id").agg(F.count("*").alias("contests"), wins().alias("wins"))
    first = top_k(board, [F.desc("wins"), C("entity_id")], 25)
    return boards.rollup_sum(first, t.entities, ["wins", "contests"])


@query(
    "A16_owner_weighted_mean",
    f"""{FIELD_SQL}, {OWNERS}, m AS (SELECT owner_key, sum(CAST(round(avg_finish_pct * 10) AS BIGINT) * contests) AS v,
        sum(contests) AS contests FROM finish JOIN own USING (entity_id) GROUP BY 1)
    SELECT owner_key, CAST(contests AS BIGINT) AS contests, {q.pct('v', 'contests * 10')} AS avg_finish_pct
    FROM m WHERE contests >= 20""",
)
def _(t):
    return boards.rollup_weighted(_finish(t), t.entities, "avg_finish_pct", "contests").where("contests >= 20")


@query(
    "A17_owner_periods",
    f"""WITH {OWNERS} SELECT owner_key, CAST(count(DISTINCT period) AS BIGINT) AS periods, min(period) AS first_period,
        max(period) AS last_period FROM results JOIN open_contests USING (contest_id) JOIN own USING (entity_id) GROUP BY 1""",
)
def _(t):
    seen = t.results.join(t.open_contests, "contest_id").select("entity_id", "period").distinct()
    return boards.rollup_periods(seen, t.entities)


@query(
    "A19_owner_members",
    f"""WITH {OWNERS}, u AS (SELECT entity_id, count(*) AS used, min(period) AS first_period FROM star GROUP BY 1),
    m AS (SELECT owner_key, entity_name, sum(used) AS used, min(first_period) AS first_period, min(entity_id) AS entity_id
        FROM u JOIN own USING (entity_id) JOIN entities USING (entity_id) GROUP BY 1, 2)
    SELECT owner_key, entity_name, CAST(row_number() OVER (PARTITION BY owner_key ORDER BY first_period, entity_id) AS BIGINT) AS member_no,
        first_period, row_number() OVER (PARTITION BY owner_key ORDER BY used DESC, entity_id) = 1 AS is_primary FROM m""",
)
def _(t):
    used = (
        t.results.join(t.contest_headers, "contest_id")
        .groupBy("entity_id")
        .agg(F.count("*").alias("used"), F.min("period").alias("first_period"))
    )
    members = (
        boards.with_owner(used, t.entities)
        .join(t.entities, "entity_id")
        .groupBy("owner_key", "entity_name")
        .agg(F.sum("used").alias("used"), F.min("first_period").alias("first_period"), F.min("entity_id").alias("entity_id"))
    )
    primary = members.groupBy("owner_key").agg(F.max(F.struct("used", -C("entity_id"))).alias("p"))
    named = t.entities.select(boards.owner_key(C("owner"), C("entity_id")).alias("owner_key"))
    hot = hot_groups(named, ["owner_key"], 2_000_000)
    numbered = rank_within(members, ["owner_key"], "first_period", [C("entity_id")], out="member_no", hot=hot)
    return numbered.join(primary, "owner_key").select(
        "owner_key",
        "entity_name",
        "member_no",
        "first_period",
        ((C("p.used") == C("used")) & (C("p.col2") == -C("entity_id"))).alias("is_primary"),
    )


@query(
    "W13_peak_period",
    """SELECT event_type, period, n AS entities FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, period DESC) AS rn
        FROM (SELECT event_type, period, CAST(count(DISTINCT entity_id) AS BIGINT) AS n FROM star GROUP BY 1, 2)) WHERE rn = 1""",
)
def _(t):
    per = (
        t.results.join(t.contests, "contest_id")
        .select("event_type", "period", "entity_id")
        .distinct()
        .groupBy("event_type", "period")
        .agg(F.count("*").alias("n"))
    )
    peak = per.groupBy("event_type").agg(F.max(F.struct("n", "period")).alias("p"))
    return peak.select("event_type", "p.period", C("p.n").alias("entities"))
