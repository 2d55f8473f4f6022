"""Re-scoring, agreement and sensitivity."""

from __future__ import annotations

from pyspark.sql import functions as F

from podium.functions import scoring
from podium.operators import rescore as rs
from podium.operators.measures import count_if
from podium.plans import dialect as q
from podium.plans.registry import query

C = F.col
N = q.n()

WIND = """hw AS (SELECT day, hour, sum(speed_c) // (count(speed_c) * 5) AS wind_kc, count(speed_c) AS n_obs FROM observations GROUP BY 1, 2),
    nh AS (SELECT day, start_hour, hour, wind_kc FROM (SELECT s.day, s.start_hour, h.hour, h.wind_kc, row_number() OVER
        (PARTITION BY s.day, s.start_hour ORDER BY abs(h.hour - s.start_hour), h.hour) AS rn
        FROM (SELECT DISTINCT day, start_hour FROM contest_headers) s JOIN hw h ON h.day = s.day) WHERE rn = 1),
    cw AS (SELECT contest_id, wind_kc FROM contest_headers JOIN nh USING (day, start_hour))"""


def hourly(t):
    return rs.hourly_wind(t.observations)


def contest_wind(t):
    near = rs.nearest_hour(t.contest_headers, hourly(t), ["wind_kc"])
    return t.contest_headers.join(near, ["day", "start_hour"]).select("contest_id", "wind_kc")


@query(
    "J10_nearest_hour",
    f"WITH {WIND} SELECT contest_id, start_hour, hour, CAST(wind_kc AS BIGINT) AS wind_kc FROM contest_headers JOIN nh USING (day, start_hour)",
)
def _(t):
    near = rs.nearest_hour(t.contest_headers, hourly(t), ["wind_kc"])
    return t.contest_headers.join(near, ["day", "start_hour"]).select("contest_id", "start_hour", "hour", "wind_kc")


BAND = "CASE WHEN wind_kc <= 900 THEN 'low' WHEN wind_kc >= 1400 THEN 'high' ELSE 'medium' END"
RATED = f"""{WIND}, rt AS (SELECT contest_id, entity_id, boat_id, line_no, rank, elapsed_s, wind_kc, {BAND} AS band, class, tot_low,
        tot_medium, tot_high, tod FROM ranked JOIN cw USING (contest_id) JOIN ratings USING (boat_id))"""
BOTH = f"""{RATED}, cv AS (SELECT *, CAST(elapsed_s AS BIGINT) * CASE band WHEN 'low' THEN tot_low WHEN 'high' THEN tot_high ELSE tot_medium END
        AS corrected FROM rt WHERE tot_low IS NOT NULL),
    br AS (SELECT *, CAST(row_number() OVER (PARTITION BY contest_id ORDER BY corrected, rank, boat_id, line_no) AS BIGINT) AS new_rank,
        CAST(row_number() OVER (PARTITION BY contest_id ORDER BY rank) AS BIGINT) AS old_rank FROM cv)"""


def rated(t):
    cols = ["contest_id", "entity_id", "boat_id", "line_no", "rank", "elapsed_s"]
    wind = contest_wind(t).withColumn("band", rs.band_of(C("wind_kc")))
    # ratings join first: the contest joins and windows that follow then share one partitioning
    return t.ranked.select(*cols).join(t.ratings, "boat_id").join(wind, "contest_id")


def ranks(t):
    return rs.both_ranks(rs.corrected(rated(t)), hot=t.hot_contests)


@query(
    "X26_handicap_times",
    f"""WITH {RATED} SELECT band, {N} AS entries, CAST(sum(CAST(elapsed_s AS BIGINT) * tot_medium) AS BIGINT) AS tot_single,
        CAST(sum(CAST(elapsed_s AS BIGINT) * CASE band WHEN 'low' THEN tot_low WHEN 'high' THEN tot_high ELSE tot_medium END) AS BIGINT) AS tot_banded,
        CAST(sum(CAST(elapsed_s AS BIGINT) - 12 * tod) AS BIGINT) AS tod_single FROM rt GROUP BY 1""",
)
def _(t):
    e = C("elapsed_s").cast("long")
    banded = scoring.by_band("band", C("tot_low"), C("tot_medium"), C("tot_high"))
    return rated(t).groupBy("band").agg(
        F.count("*").alias("entries"),
        F.sum(scoring.time_on_time(e, C("tot_medium"))).alias("tot_single"),
        F.sum(scoring.time_on_time(e, banded)).alias("tot_banded"),
        F.sum(scoring.time_on_distance(e, F.lit(12), C("tod"))).alias("tod_single"),
    )


@query(
    "W01_rank_by_corrected",
    f"WITH {BOTH} SELECT contest_id, boat_id, line_no, entity_id, corrected, new_rank FROM br",
)
def _(t):
    return ranks(t).select("contest_id", "boat_id", "line_no", "entity_id", "corrected", "new_rank")


@query("W02_rerank_in_subset", f"WITH {BOTH} SELECT contest_id, boat_id, line_no, entity_id, rank, old_rank FROM br")
def _(t):
    return ranks(t).select("contest_id", "boat_id", "line_no", "entity_id", "rank", "old_rank")


SUMMARY = f"""{BOTH}, sm AS (SELECT contest_id, band, {N} AS covered, {q.n(cond='new_rank <> old_rank')} AS rank_changes,
        max(abs(new_rank - old_rank)) AS max_swap, max(entity_id) FILTER (old_rank = 1) AS old_winner,
        max(entity_id) FILTER (new_rank = 1) AS new_winner FROM br GROUP BY 1, 2)"""


@query("A36_rescore_summary", f"WITH {SUMMARY} SELECT *, old_winner <> new_winner AS winner_change FROM sm")
def _(t):
    return rs.rescore_summary(ranks(t))


RHO = f"""{BOTH}, rh AS (SELECT contest_id, band, count(*) AS n, 1 - 6e0 * CAST(sum((new_rank - old_rank) * (new_rank - old_rank)) AS DOUBLE)
        / (CAST(count(*) AS DOUBLE) * (CAST(count(*) AS DOUBLE) * CAST(count(*) AS DOUBLE) - 1e0)) AS rho FROM br GROUP BY 1, 2 HAVING count(*) >= 2)"""


@query("A32_rank_agreement", f"WITH {RHO} SELECT contest_id, band, CAST(n AS BIGINT) AS n, rho FROM rh")
def _(t):
    return rs.rank_agreement(ranks(t), ["contest_id", "band"])


@query(
    "A33_agreement_by_band",
    f"""WITH {RHO}, mi AS (SELECT band, CAST(round(rho * 1000000) AS BIGINT) AS m FROM rh)
    SELECT coalesce(band, 'all') AS band, {N} AS contests, CAST(quantile_cont(m, 0.5) AS DOUBLE) / 1000000 AS median_rho,
        CAST(sum(m) AS DOUBLE) / count(*) / 1000000 AS mean_rho, {q.pct('100 * count(*) FILTER (m < 500000)', 'count(*)')} AS pct_below_half
    FROM mi GROUP BY ROLLUP (band)""",
)
def _(t):
    from podium.operators.measures import half_up

    rho = rs.rank_agreement(ranks(t), ["contest_id", "band"])
    micro = rho.select("band", F.round(C("rho") * 1_000_000).cast("long").alias("m"))
    # rho is held in millionths, so the exact median keeps a bounded count table per band
    return (
        micro.rollup("band")
        .agg(
            F.count("*").alias("contests"),
            (F.percentile("m", F.lit(0.5)) / 1_000_000).alias("median_rho"),
            (F.sum("m").cast("double") / F.count("*") / 1_000_000).alias("mean_rho"),
            half_up(count_if(C("m") < 500_000) * 100, F.count("*"), 1).alias("pct_below_half"),
        )
        .withColumn("band", F.coalesce("band", F.lit("all")))
    )


def spread_sql(trim: int) -> str:
    keep = f"WHERE cnt <= {trim + 1} OR new_rank <= cnt - {trim}" if trim else ""
    return f"""WITH {BOTH}, c AS (SELECT *, corrected // 1000 AS v, count(*) OVER (PARTITION BY contest_id) AS cnt FROM br),
    k AS (SELECT * FROM c {keep}),
    g AS (SELECT contest_id, band, count(*) AS n, min(v) AS f, max(v) AS l, sum(v) AS s, sum(v * v) AS s2,
        quantile_cont(v, 0.5) FILTER (new_rank > 1) AS mid FROM k GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT contest_id, band, CAST(n AS BIGINT) AS n, CAST(f AS BIGINT) AS fastest, CAST(l AS BIGINT) AS slowest,
        100e0 * (l - f) / f AS range_pct, mid - f AS median_gap, CAST(s - f * n AS DOUBLE) / (n - 1) AS mean_gap,
        sqrt(CAST(n * s2 - s * s AS DOUBLE) / (CAST(n AS DOUBLE) * CAST(n - 1 AS DOUBLE))) AS stdev,
        100e0 * sqrt(CAST(n * s2 - s * s AS DOUBLE) / (CAST(n AS DOUBLE) * CAST(n - 1 AS DOUBLE))) / (CAST(s AS DOUBLE) / n) AS stdev_pct FROM g"""


def _seconds(t):
    return ranks(t).withColumn("seconds", F.call_function("div", "corrected", F.lit(1000)))


@query("A30_spread", spread_sql(0))
def _(t):
    return rs.spread(_seconds(t), "seconds", "new_rank")


@query("A31_trimmed_spread", spread_sql(1))
def _(t):
    return rs.spread(_seconds(t), "seconds", "new_rank", trim=1)


@query(
    "A34_rank_shift_bias",
    f"""WITH {BOTH} SELECT class, {N} AS n, CAST(sum(new_rank - old_rank) AS DOUBLE) / count(*) AS mean_shift,
        {q.n(cond='old_rank = 1')} AS old_wins, {q.n(cond='new_rank = 1')} AS new_wins FROM br GROUP BY 1 HAVING count(*) >= 3""",
)
def _(t):
    shift = (C("new_rank") - C("old_rank")).cast("long")
    return (
        ranks(t)
        .groupBy("class")
        .agg(
            F.count("*").alias("n"),
            (F.sum(shift).cast("double") / F.count("*")).alias("mean_shift"),
            count_if(C("old_rank") == 1).alias("old_wins"),
            count_if(C("new_rank") == 1).alias("new_wins"),
        )
        .where("n >= 3")
    )


BIAS_COLS = ", ".join(
    f"{q.n(cond=f'band = {chr(39)}{b}{chr(39)}')} AS {b}_n, CAST(sum(new_rank - old_rank) FILTER (band = '{b}') AS DOUBLE) "
    f"/ nullif(count(*) FILTER (band = '{b}'), 0) AS {b}_shift"
    for b in rs.BANDS
)


@query("A35_bias_by_class_and_band", f"WITH {BOTH} SELECT class, {BIAS_COLS} FROM br GROUP BY 1")
def _(t):
    shift = (C("new_rank") - C("old_rank")).cast("long")
    sums = [F.count(F.lit(1)).alias("n"), F.sum(shift).alias("s")]
    wide = ranks(t).groupBy("class").pivot("band", list(rs.BANDS)).agg(*sums).fillna(0, [f"{b}_n" for b in rs.BANDS])
    return wide.select(
        "class",
        *[C(f"{b}_n") for b in rs.BANDS],
        *[(C(f"{b}_s").cast("double") / F.nullif(C(f"{b}_n"), F.lit(0))).alias(f"{b}_shift") for b in rs.BANDS],
    )


SHIFTS = (0, 3, 5, 7)


def _winner(shift: int) -> str:
    w = f"(wind_kc + {shift * 100})"
    return f"CASE WHEN {w} <= 900 THEN winner_low WHEN {w} >= 1400 THEN winner_high ELSE winner_medium END"


SCEN = f"""{RATED}, wb AS (SELECT contest_id, wind_kc, {N} AS covered, arg_min(entity_id, rank) AS published,
        {', '.join(f"arg_min(entity_id, (CAST(elapsed_s AS BIGINT) * tot_{b}, rank)) AS winner_{b}" for b in rs.BANDS)}
        FROM rt WHERE tot_low IS NOT NULL GROUP BY 1, 2),
    ws AS ({' UNION ALL '.join(
        f"SELECT contest_id, covered, published, {s} AS shift_kt, {BAND.replace('wind_kc', f'(wind_kc + {s * 100})')} AS band, "
        f"{_winner(s)} AS winner, {'false' if i == 0 else f'{_winner(s)} <> {_winner(SHIFTS[i - 1])}'} AS changed FROM wb"
        for i, s in enumerate(SHIFTS))})"""


def scenarios(t):
    return rs.wind_shift_scenarios(rs.winners_by_band(rated(t)), SHIFTS)


@query("J17_wind_shift_scenarios", f"WITH {SCEN} SELECT contest_id, covered, published, CAST(shift_kt AS INTEGER) AS shift_kt, band, winner FROM ws")
def _(t):
    return scenarios(t).drop("changed")


@query(
    "W10_change_marker",
    f"WITH {SCEN} SELECT contest_id, CAST(shift_kt AS INTEGER) AS shift_kt, winner, changed FROM ws WHERE changed",
)
def _(t):
    return scenarios(t).where("changed").select("contest_id", "shift_kt", "winner", "changed")


@query(
    "A37_scenario_summary",
    f"""WITH {SCEN} SELECT CAST(shift_kt AS INTEGER) AS shift_kt, {', '.join(f"{q.n(cond=f'band = {chr(39)}{b}{chr(39)}')} AS {b}_contests" for b in rs.BANDS)},
        {q.n(cond='winner <> published')} AS winner_flips, {q.n(cond='changed')} AS changed FROM ws GROUP BY 1""",
)
def _(t):
    return (
        scenarios(t)
        .groupBy("shift_kt")
        .agg(
            *[count_if(C("band") == b).alias(f"{b}_contests") for b in rs.BANDS],
            count_if(C("winner") != C("published")).alias("winner_flips"),
            count_if(C("changed")).alias("changed"),
        )
    )


PROXIES = {"fast": 950, "middle": 1000, "slow": 1050}
PROXY_SQL = ", ".join(
    f"arg_min(entity_id, (CAST(elapsed_s AS BIGINT) * coalesce(tot_medium, {v}), rank)) AS w_{k}" for k, v in PROXIES.items()
)


@query(
    "A37_proxy_sensitivity",
    f"""WITH {RATED}, p AS (SELECT contest_id, arg_min(entity_id, rank) AS published, {PROXY_SQL} FROM rt GROUP BY 1)
    SELECT {', '.join(f"{q.n(cond=f'w_{k} <> published')} AS flips_{k}" for k in PROXIES)},
        {q.n(cond='NOT (w_fast = w_middle AND w_middle = w_slow)')} AS sensitive, {N} AS contests FROM p""",
)
def _(t):
    def first(proxy: int):
        time = C("elapsed_s").cast("long") * F.coalesce("tot_medium", F.lit(proxy))
        return F.min(F.struct(time.alias("t"), "rank", "entity_id"))["entity_id"]

    per = rated(t).groupBy("contest_id").agg(
        F.min(F.struct("rank", "entity_id"))["entity_id"].alias("published"),
        *[first(v).alias(f"w_{k}") for k, v in PROXIES.items()],
    )
    same = (C("w_fast") == C("w_middle")) & (C("w_middle") == C("w_slow"))
    return per.agg(
        *[count_if(C(f"w_{k}") != C("published")).alias(f"flips_{k}") for k in PROXIES],
        count_if(~same).alias("sensitive"),
        F.count("*").alias("contests"),
    )


FACTORS = "fc AS (SELECT class, min(tot_low) AS tot_low, min(tot_medium) AS tot_medium, min(tot_high) AS tot_high FROM ratings GROUP BY 1)"


@query(
    "A47_factor_drift",
    f"""WITH {FACTORS}, r AS (SELECT f.class, g.class AS other, {', '.join(f"CAST(f.tot_{b} AS DOUBLE) / g.tot_{b} AS ratio_{b}" for b in rs.BANDS)}
        FROM fc f JOIN fc g ON f.class < g.class)
    SELECT *, greatest(ratio_low, ratio_medium, ratio_high) - least(ratio_low, ratio_medium, ratio_high) AS drift FROM r""",
)
def _(t):
    factors = t.ratings.groupBy("class").agg(*[F.min(f"tot_{b}").alias(f"tot_{b}") for b in rs.BANDS])
    return rs.factor_pairs(factors)


RESOLVE = """l AS (SELECT *, regexp_replace(upper(class), '[ /-]', '', 'g') AS ck FROM cert_register WHERE cert_ref IS NOT NULL),
    x1 AS (SELECT name, sail, arg_max(cert_ref, reg_no) AS r1 FROM l GROUP BY 1, 2),
    x2 AS (SELECT name, arg_min(cert_ref, reg_no) AS r2 FROM l GROUP BY 1),
    x3 AS (SELECT ck, arg_min(cert_ref, reg_no) AS r3 FROM l GROUP BY 1),
    mt AS (SELECT boat_id, coalesce(r1, r2, r3) AS cert_ref, CASE WHEN r1 IS NOT NULL THEN 'name+sail' WHEN r2 IS NOT NULL THEN 'name'
        WHEN r3 IS NOT NULL THEN 'class' END AS tier FROM cert_wanted w LEFT JOIN x1 USING (name, sail) LEFT JOIN x2 USING (name)
        LEFT JOIN x3 ON x3.ck = regexp_replace(upper(w.class), '[ /-]', '', 'g')),
    rv AS (SELECT mt.*, c.tot, c.tot_low, c.tot_high FROM mt LEFT JOIN certificates c USING (cert_ref))"""


def certs(t):
    return rs.resolve_certificates(t.cert_wanted, t.cert_register, t.certificates)


@query("J13_cascading_lookup", f"WITH {RESOLVE} SELECT boat_id, cert_ref, tier, tot FROM rv")
def _(t):
    return certs(t).select("boat_id", "cert_ref", "tier", "tot")


@query(
    "C17_rescore_by_certificate",
    f"""WITH {RESOLVE}, {WIND}, w AS (SELECT contest_id, {BAND} AS band FROM contest_headers LEFT JOIN cw USING (contest_id)),
    b AS (SELECT contest_id, band, entity_id, rank, boat_id, line_no,
        CAST(elapsed_s AS BIGINT) * CASE band WHEN 'low' THEN tot_low WHEN 'high' THEN tot_high ELSE tot END AS corrected
        FROM ranked JOIN rv USING (boat_id) JOIN w USING (contest_id) WHERE tot IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY corrected, rank) AS new_rank,
        row_number() OVER (PARTITION BY contest_id ORDER BY rank) AS old_rank FROM b),
    s AS (SELECT contest_id, band, count(*) AS covered, count(*) FILTER (new_rank <> old_rank) AS changes,
        max(entity_id) FILTER (old_rank = 1) <> max(entity_id) FILTER (new_rank = 1) AS flip FROM r GROUP BY 1, 2)
    SELECT band, CAST(sum(covered) AS BIGINT) AS covered, {N} AS contests, {q.n(cond='changes > 0')} AS contests_changed, {q.n(cond='flip')} AS flips FROM s GROUP BY 1""",
)
def _(t):
    # the contest's wind chooses the factor of the certificate; without wind it is the one for medium
    wind = t.contest_headers.select("contest_id").join(contest_wind(t), "contest_id", "left")
    wind = wind.select("contest_id", rs.band_of(C("wind_kc")).alias("band"))
    rated_boats = certs(t).where("tot IS NOT NULL").select("boat_id", "tot", "tot_low", "tot_high")
    rows = t.ranked.join(rated_boats, "boat_id").join(wind, "contest_id")
    factor = scoring.by_band("band", C("tot_low"), C("tot"), C("tot_high"))
    covered = rows.withColumn("corrected", scoring.time_on_time(C("elapsed_s").cast("long"), factor))
    summary = rs.rescore_summary(rs.both_ranks(covered, hot=t.hot_contests))
    return summary.groupBy("band").agg(
        F.sum("covered").alias("covered"),
        F.count("*").alias("contests"),
        count_if(C("rank_changes") > 0).alias("contests_changed"),
        count_if(C("winner_change")).alias("flips"),
    )
