"""Re-scoring under other ratings: corrected times, new ranks, agreement and sensitivity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.functions import scoring
from podium.operators.measures import count_if
from podium.operators.ranking import keep_first, keep_last, rank_within

C = F.col
BANDS = ("low", "medium", "high")


def hourly_wind(observations: DataFrame) -> DataFrame:
    """Mean speed per (day, hour), in hundredths of a knot; as many rows as the calendar has hours."""
    mean = F.call_function("div", F.sum("speed_c"), F.count("speed_c") * 5)
    return observations.groupBy("day", "hour").agg(mean.alias("wind_kc"), F.count("speed_c").alias("n_obs"))


def nearest_hour(wanted: DataFrame, hourly: DataFrame, keep: Sequence[str]) -> DataFrame:
    """For each wanted (day, start_hour) the reading of that hour, else of the closest one, the earlier on ties."""
    slots = wanted.select("day", "start_hour").distinct()
    gap = F.abs(C("hour") - C("start_hour"))
    best = (
        slots.join(hourly, "day")
        .groupBy("day", "start_hour")
        .agg(F.min(F.struct(gap.alias("gap"), "hour", *keep)).alias("b"))
    )
    return best.select("day", "start_hour", C("b.hour").alias("hour"), *[C(f"b.{k}").alias(k) for k in keep])


def band_of(wind_kc: Column) -> Column:
    return scoring.wind_band(wind_kc / 100)


def resolve_certificates(wanted: DataFrame, register: DataFrame, certificates: DataFrame) -> DataFrame:
    """Certificate of a boat by name and number, else by name, else by class.

    The register is reduced to one reference per key before each join. The first tier that names a reference
    decides; if that certificate is not on file the boat stays without one.
    """

    def class_key(c: str) -> Column:
        return F.regexp_replace(F.upper(C(c)), "[ /-]", "")

    listed = register.where("cert_ref IS NOT NULL").withColumn("class_key", class_key("class"))
    exact = keep_last(listed.select("name", "sail", "reg_no", C("cert_ref").alias("r1")), ["name", "sail"], [C("reg_no")])
    by_name = keep_first(listed.select("name", "reg_no", C("cert_ref").alias("r2")), ["name"], [C("reg_no")])
    by_class = keep_first(
        listed.select("class_key", "reg_no", C("cert_ref").alias("r3")), ["class_key"], [C("reg_no")]
    )
    tier = F.when(C("r1").isNotNull(), "name+sail").when(C("r2").isNotNull(), "name").when(C("r3").isNotNull(), "class")
    matched = (
        wanted.withColumn("class_key", class_key("class"))
        .join(exact.drop("reg_no"), ["name", "sail"], "left")
        .join(by_name.drop("reg_no"), "name", "left")
        .join(by_class.drop("reg_no"), "class_key", "left")
        .select("boat_id", F.coalesce("r1", "r2", "r3").alias("cert_ref"), tier.alias("tier"))
    )
    return matched.join(certificates.where("cert_ref IS NOT NULL"), "cert_ref", "left")


def corrected(rows: DataFrame) -> DataFrame:
    """Rows that have a certificate, with the corrected time of their wind band in whole milliseconds."""
    factor = scoring.by_band("band", C("tot_low"), C("tot_medium"), C("tot_high"))
    return rows.withColumn("corrected", scoring.time_on_time(C("elapsed_s").cast("long"), factor)).where(
        "corrected IS NOT NULL"
    )


def both_ranks(covered: DataFrame, hot: list[int] | None = None) -> DataFrame:
    """New rank by corrected time, and the published rank counted again among the covered rows."""
    order = [C("rank"), C("boat_id"), C("line_no")]
    new = rank_within(covered, ["contest_id"], "corrected", order, out="new_rank", hot=hot)
    return rank_within(new, ["contest_id"], "rank", [C("boat_id")], out="old_rank", hot=hot)


def rescore_summary(ranked: DataFrame) -> DataFrame:
    """Per contest: covered rows, rank changes, largest move, and both winners."""
    old, new = F.when(C("old_rank") == 1, C("entity_id")), F.when(C("new_rank") == 1, C("entity_id"))
    return ranked.groupBy("contest_id", "band").agg(
        F.count("*").alias("covered"),
        count_if(C("new_rank") != C("old_rank")).alias("rank_changes"),
        F.max(F.abs(C("new_rank") - C("old_rank"))).alias("max_swap"),
        F.max(old).alias("old_winner"),
        F.max(new).alias("new_winner"),
    ).withColumn("winner_change", C("old_winner") != C("new_winner"))


def rank_agreement(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spearman's rho of the two ranks per group of at least two."""
    # in doubles: exact while the sums stay below 2^53, and no overflow in a contest of any size
    gap = (C("new_rank") - C("old_rank")).cast("double")
    sums = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(gap * gap).alias("d2")).where("n >= 2")
    n = C("n").cast("double")
    rho = F.lit(1.0) - C("d2") * 6.0 / (n * (n * n - F.lit(1.0)))
    return sums.select(*keys, "n", rho.alias("rho"))


def spread(ranked: DataFrame, value: str, rank: str, trim: int = 0) -> DataFrame:
    """Spread of a time per contest: range, gaps to the fastest and standard deviation, in percent of the fastest or mean.

    ``trim`` slowest rows are left out where more than trim + 1 remain. The ranks are at hand, so trimming is a
    filter; the median is taken from a mergeable count per distinct second.
    """
    if trim:
        size = ranked.groupBy("contest_id").agg(F.count("*").alias("_n"))
        ranked = ranked.join(size, "contest_id").where((C("_n") <= trim + 1) | (C(rank) <= C("_n") - trim)).drop("_n")
    v = C(value).cast("long")
    sums = ranked.groupBy("contest_id", "band").agg(
        F.count("*").alias("n"),
        F.min(v).alias("fastest"),
        F.max(v).alias("slowest"),
        F.sum(v).alias("s"),
        F.sum((v * v).cast("decimal(18,0)")).alias("s2"),
        F.percentile(F.when(C(rank) > 1, v), F.lit(0.5)).alias("mid"),
    )
    n, s, s2 = C("n").cast("decimal(12,0)"), C("s").cast("decimal(19,0)"), C("s2").cast("decimal(26,0)")
    # n * sum of squares - square of the sum, exact before the one division
    variance = (n * s2 - s * s).cast("double") / (C("n").cast("double") * (C("n") - 1).cast("double"))
    return sums.where("n >= 2").select(
        "contest_id",
        "band",
        "n",
        "fastest",
        "slowest",
        (F.lit(100.0) * (C("slowest") - C("fastest")) / C("fastest")).alias("range_pct"),
        (C("mid") - C("fastest")).alias("median_gap"),
        ((C("s") - C("fastest") * C("n")).cast("double") / (C("n") - 1)).alias("mean_gap"),
        F.sqrt(variance).alias("stdev"),
        (F.lit(100.0) * F.sqrt(variance) / (C("s").cast("double") / C("n"))).alias("stdev_pct"),
    )


def winners_by_band(rows: DataFrame) -> DataFrame:
    """Published winner among covered rows and the winner under each wind band, in one pass."""

    def first(factor: str) -> Column:
        time = C("elapsed_s").cast("long") * C(factor)
        return F.min(F.struct(time.alias("t"), "rank", "boat_id", "line_no", "entity_id"))["entity_id"]

    return (
        rows.where("tot_low IS NOT NULL")
        .groupBy("contest_id", "wind_kc")
        .agg(
            F.count("*").alias("covered"),
            F.min(F.struct("rank", "entity_id"))["entity_id"].alias("published"),
            *[first(f"tot_{b}").alias(f"winner_{b}") for b in BANDS],
        )
    )


def wind_shift_scenarios(winners: DataFrame, shifts_kt: Sequence[int]) -> DataFrame:
    """Winner of each contest under each wind shift, and whether it differs from the shift before.

    Works on one row per contest; the scenarios are a fixed array, so nothing is joined or shuffled.
    """

    def winner(shift: int) -> Column:
        band = band_of(C("wind_kc") + shift * 100)
        return scoring.by_band(band, C("winner_low"), C("winner_medium"), C("winner_high"))

    rows = []
    for i, shift in enumerate(shifts_kt):
        changed = F.lit(False) if i == 0 else winner(shift) != winner(shifts_kt[i - 1])
        rows.append(
            F.struct(
                F.lit(shift).alias("shift_kt"),
                band_of(C("wind_kc") + shift * 100).alias("band"),
                winner(shift).alias("winner"),
                changed.alias("changed"),
            )
        )
    return winners.select("contest_id", "covered", "published", F.inline(F.array(*rows)))


def factor_pairs(factors: DataFrame) -> DataFrame:
    """Ratio of every two classes per band, the first in order over the second, and how far it drifts.

    ``factors`` has one row per class with a certificate of each band: a list of designs, not of boats.
    """
    entry = F.struct("class", *[C(f"tot_{b}") for b in BANDS])
    listed = factors.agg(F.array_sort(F.collect_list(entry)).alias("all"))
    first = listed.select("all", F.posexplode("all").alias("k", "a"))
    pairs = first.select("a", F.explode(F.slice("all", C("k") + 2, F.size("all"))).alias("b"))
    ratios = [C(f"a.tot_{b}").cast("double") / C(f"b.tot_{b}") for b in BANDS]
    return pairs.select(
        C("a.class").alias("class"),
        C("b.class").alias("other"),
        *[r.alias(f"ratio_{b}") for r, b in zip(ratios, BANDS)],
        (F.greatest(*ratios) - F.least(*ratios)).alias("drift"),
    )
