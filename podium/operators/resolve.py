"""Entity resolution: which register rows are one competitor, and who owned it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.functions import identifiers as idn
from podium.functions import text
from podium.operators.measures import count_if

C = F.col
TRAILING_MARKS = r"\s*(\*{2,}|\?{2,}|#{2,})\s*$"  # fixed value: marks left after a name


def canonical_boat_name(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(text.collapse(c), TRAILING_MARKS, ""))


def describe(boats: DataFrame) -> DataFrame:
    """Register rows with their comparison keys and quality marks."""
    tidy = boats.select(
        "boat_id",
        "uses",
        text.collapse("name").alias("tidy"),
        idn.identifier("sail").alias("ident"),
        idn.design_class("raw_class").alias("cls"),
        text.collapse("club").alias("club"),
    )
    return tidy.select(
        "*",
        text.name_key(F.regexp_replace("tidy", TRAILING_MARKS, "")).alias("key"),
        F.coalesce(idn.strong(C("ident")), F.lit(False)).alias("strong"),
        idn.unknown(C("ident")).alias("dummy"),
        idn.family(C("cls")).alias("family"),
        idn.spelling_score(C("tidy")).alias("nscore"),
        F.when(C("cls").isNotNull(), idn.design_score(C("cls"))).alias("cscore"),
    )


def _only(value: Column, where: Column | None = None) -> Column:
    """The one value of a group, null when there are several; a mergeable stand-in for a distinct count of 1."""
    v = value if where is None else F.when(where, value)
    return F.when(F.min(v) == F.max(v), F.min(v))


def reconcile(boats: DataFrame, manual: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Survivor, rule and best spelling for every register row.

    Per name key the first rule that applies decides: a manual rule; one strong identifier and one class family;
    a dominant row with unused near-copies; equal identifiers, with unknown ones where only one identifier is
    known. All of it is aggregates per key joined back, so a name shared by very many rows is never gathered.
    """
    rows = describe(boats)
    manual = manual or {}
    rules = F.create_map(*[F.lit(k) for key in manual for k in (key, key)]) if manual else None
    is_manual = F.try_element_at(rules, C("key")).isNotNull() if rules is not None else F.lit(False)

    dominance = F.struct("uses", C("strong").cast("int"), "nscore", (-C("boat_id")).alias("m"), "ident", "family", "boat_id")
    stats = rows.groupBy("key").agg(
        F.coalesce(F.min("family") == F.max("family"), F.lit(True)).alias("one_family"),
        _only(C("ident"), C("strong")).alias("sole_strong"),
        _only(C("ident"), ~C("dummy")).alias("sole_known"),
        count_if(~C("dummy")).alias("n_known"),
        F.max(dominance).alias("dom"),
    )
    marked = (
        rows.join(stats, "key")
        .withColumn("manual", is_manual)
        .withColumn(
            "in2",
            C("one_family")
            & C("sole_strong").isNotNull()
            & F.coalesce(
                (C("ident") == C("sole_strong")) | ~C("strong") | idn.near(C("ident"), C("sole_strong")), F.lit(False)
            ),
        )
        .withColumn(
            "in3",
            C("one_family")
            & C("dom.ident").isNotNull()
            & (
                (C("boat_id") == C("dom.boat_id"))
                | (
                    (C("uses") == 0)
                    & F.coalesce(C("family") == C("dom.family"), F.lit(True))
                    & F.coalesce(idn.near(C("ident"), C("dom.ident")), F.lit(False))
                )
            ),
        )
    )
    sizes = marked.groupBy("key").agg(count_if(C("in2")).alias("n2"), count_if(C("in3")).alias("n3"))
    rule = (
        F.when(C("manual"), 1)
        .when(C("n2") >= 2, F.when(C("in2"), 2).otherwise(0))
        .when(C("n3") >= 2, F.when(C("in3"), 3).otherwise(0))
        .otherwise(4)
    )
    # rule 4: rows of one identifier; unknown rows go to the only identifier if it has one row, else together
    by_ident = (
        F.when(~C("dummy"), C("ident"))
        .when(C("sole_known").isNotNull() & (C("n_known") == 1), C("sole_known"))
        .when(C("sole_known").isNotNull(), F.lit("?"))
        .otherwise(F.concat(F.lit("row:"), C("boat_id").cast("string")))
    )
    member_of = (
        F.when(C("rule") == 0, F.concat(F.lit("row:"), C("boat_id").cast("string")))
        .when(C("rule") == 4, by_ident)
        .otherwise(F.lit("all"))
    )
    sets = (
        marked.join(sizes, "key").withColumn("rule", rule).withColumn("set", member_of)
        .withColumn(
            "hit",
            F.when(C("rule") == 2, (C("ident") == C("sole_strong")).cast("int"))
            .when(C("rule") == 4, (~C("dummy")).cast("int"))
            .otherwise(0),
        )
    )
    c4 = F.when(C("rule") == 4, F.coalesce(C("cscore.design") * 1000 + C("cscore.length"), F.lit(0))).otherwise(0)
    claim = F.struct(
        F.coalesce("hit", F.lit(0)).alias("hit"),
        c4.alias("c"),
        "uses",
        F.when(C("rule") == 3, C("strong").cast("int")).otherwise(0).alias("s"),
        "nscore",
        (-C("boat_id")).alias("m"),
        "boat_id",
        "ident",
        "tidy",
        "cls",
        "club",
    )
    best = sets.groupBy("key", "rule", "set").agg(
        F.count("*").alias("members"),
        F.max(claim).alias("p"),
        F.max(F.struct("nscore", "tidy"))["tidy"].alias("best_name"),
        F.max(F.when(C("cls").isNotNull(), F.struct("cscore", "cls")))["cls"].alias("best_class"),
        _only(C("ident"), ~C("dummy")).alias("set_ident"),
        F.max("sole_strong").alias("sole_strong"),
    )
    merged = C("members") >= 2
    is2, is3 = C("rule") == 2, C("rule") == 3
    fixed = {
        i: F.create_map(*[F.lit(x) for key, vals in manual.items() for x in (key, vals[i])]) if manual else F.create_map()
        for i in range(3)
    }

    def manual_value(i: int, other: Column) -> Column:
        return F.coalesce(F.try_element_at(fixed[i], C("key")), other) if manual else other

    survivors = best.select(
        "key",
        "rule",
        "set",
        "members",
        C("p.boat_id").alias("canonical_id"),
        manual_value(0, F.when(~merged, canonical_boat_name("p.tidy")).when(is3, C("p.tidy")).otherwise(C("best_name"))).alias("best_name"),
        manual_value(
            1, F.when(merged & is2, C("sole_strong")).when(merged & ~is3, F.coalesce("set_ident", "p.ident")).otherwise(C("p.ident"))
        ).alias("best_ident"),
        manual_value(2, F.when(merged & ~is3, C("best_class")).otherwise(C("p.cls"))).alias("best_class"),
    )
    return sets.select("boat_id", "key", "rule", "set", "uses").join(survivors, ["key", "rule", "set"])


def absorb_synthetic(entities: DataFrame) -> DataFrame:
    """Made-up names ('Sail 123') that stand for exactly one real entity with that identifier and no other class.

    ``entities``: entity_id, name, ident, cls. Returns (entity_id, into_id).
    """
    made_up = idn.is_synthetic("name")
    real = (
        entities.where(~made_up & C("ident").isNotNull())
        .groupBy("ident")
        .agg(F.count("*").alias("n"), F.min("entity_id").alias("into_id"), F.min("cls").alias("real_class"))
        .where("n = 1")
    )
    agrees = C("cls").isNull() | C("real_class").isNull() | (C("cls") == C("real_class"))
    synthetic = entities.where(made_up & ~idn.unknown(C("ident")))
    return synthetic.join(real, "ident").where(agrees).select("entity_id", "into_id")


def assign(incoming: DataFrame, register: DataFrame) -> DataFrame:
    """Entity of each incoming (row_id, name, sail): same name and identifier, else the only one it can be.

    The order rows arrive in plays no part: an unknown identifier goes to the only known one of the name, a known
    one to a register row of the name that has none yet, and everything else is new.
    """
    reg = register.select(
        text.name_key(canonical_boat_name("name")).alias("key"), idn.identifier("sail").alias("ident"), "boat_id"
    ).withColumn("dummy", idn.unknown(C("ident")))
    exact = reg.where(~C("dummy")).groupBy("key", "ident").agg(F.min("boat_id").alias("exact_id"))
    per_key = reg.groupBy("key").agg(
        F.min(F.when(C("dummy"), C("boat_id"))).alias("blank_id"),
        _only(C("ident"), ~C("dummy")).alias("sole"),
        F.min(F.when(~C("dummy"), C("boat_id"))).alias("known_id"),
    )
    rows = incoming.select(
        "row_id", text.name_key(canonical_boat_name("name")).alias("key"), idn.identifier("sail").alias("ident")
    ).withColumn("dummy", idn.unknown(C("ident")))
    matched = rows.join(exact, ["key", "ident"], "left").join(per_key, "key", "left")
    tier = (
        F.when(C("exact_id").isNotNull(), "exact")
        .when(C("dummy") & C("sole").isNotNull(), "sole")
        .when(C("blank_id").isNotNull(), "blank")
        .otherwise("new")
    )
    target = F.when(tier == "exact", C("exact_id")).when(tier == "sole", C("known_id")).when(tier == "blank", C("blank_id"))
    return matched.select("row_id", tier.alias("tier"), target.alias("boat_id"))


# Identifiers that say nothing when two archives are matched.
EMPTY_SAILS = ("999", "0", "??", "???", "????", "xxxxxx", "xxx", "")


def match_keys(df: DataFrame, type_col: str) -> DataFrame:
    sail = F.lower(F.trim(F.regexp_replace(F.trim(C("sail")), r"^(?i:CAN|USA)\s+", "")))
    return df.select(
        "*",
        F.lower(F.trim("name")).alias("name_k"),
        text.fuzzy_key("name").alias("fuzzy_k"),
        sail.alias("sail_k"),
        idn.type_key(type_col).alias("type_k"),
    )


def _unique(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Per key whether all entries carry one name, read strictly or loosely."""
    return df.groupBy(*keys).agg(
        (F.min("name_k") == F.max("name_k")).alias(f"{out}_one"),
        ((F.min("name_k") == F.max("name_k")) | (F.min("fuzzy_k") == F.max("fuzzy_k"))).alias(f"{out}_near"),
    )


def match_cascade(boats: DataFrame, entries: DataFrame) -> DataFrame:
    """How each boat is found in another archive: by name, by loose name, by identifier; ambiguity goes to review.

    Each tier is a join to one row per key; type is used only to tell apart what a tier leaves ambiguous.
    """
    e = match_keys(entries, "type")
    b = match_keys(boats, "class")
    usable = ~C("sail_k").isin(*EMPTY_SAILS)
    typed = C("type_k") != ""
    found = (
        b.join(e.groupBy("name_k").agg(F.count("*").alias("by_name")), "name_k", "left")
        .join(_unique(e, ["fuzzy_k"], "f"), "fuzzy_k", "left")
        .join(_unique(e, ["fuzzy_k", "type_k"], "ft"), ["fuzzy_k", "type_k"], "left")
        .join(_unique(e, ["sail_k"], "s"), "sail_k", "left")
        .join(_unique(e, ["sail_k", "type_k"], "st"), ["sail_k", "type_k"], "left")
    )
    yes = lambda c: F.coalesce(C(c), F.lit(False))
    how = (
        F.when(C("by_name").isNotNull(), "name")
        .when(yes("f_one"), "fuzzy_name")
        .when(typed & yes("ft_one"), "fuzzy_name+type")
        .when(usable & yes("s_near"), "sail")
        .when(usable & typed & yes("st_near"), "sail+type")
    )
    reason = F.when(
        how.isNull() & usable & C("s_one").isNotNull(),
        F.when(~typed, "sail matches several names")
        .when(C("st_one").isNull(), "sail matches several names, none of this type")
        .otherwise("sail and type match several names"),
    )
    return found.select(
        "boat_id", "name_k", "fuzzy_k", "sail_k", "type_k", how.alias("match_type"), reason.alias("review_reason")
    )


TIER_KEYS = {
    "name": ("name_k",),
    "fuzzy_name": ("fuzzy_k",),
    "fuzzy_name+type": ("fuzzy_k", "type_k"),
    "sail": ("sail_k",),
    "sail+type": ("sail_k", "type_k"),
}


def tier_key() -> Column:
    out = None
    for tier, keys in TIER_KEYS.items():
        value = F.concat_ws("|", F.lit(tier), *keys)
        out = F.when(C("match_type") == tier, value) if out is None else out.when(C("match_type") == tier, value)
    return out


def owner_spans(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key and person: most common spelling, first and last period."""
    named = entries.select(
        *keys, text.person_key(text.person_name("skipper")).alias("person"), text.person_name("skipper").alias("form"), "period"
    )
    forms = named.groupBy(*keys, "person", "form").agg(
        F.count("*").alias("n"), F.min("period").alias("lo"), F.max("period").alias("hi")
    )
    best = forms.groupBy(*keys, "person").agg(
        F.max(F.struct("n", "form"))["form"].alias("owner"), F.min("lo").alias("first_period"), F.max("hi").alias("last_period")
    )
    return best


def owners_of_matches(matches: DataFrame, entries: DataFrame) -> DataFrame:
    """Number of owners and the latest one for each matched boat."""
    e = match_keys(entries, "type")
    per_tier = None
    for tier, keys in TIER_KEYS.items():
        keyed = e.withColumn("tier_key", F.concat_ws("|", F.lit(tier), *keys))
        per_tier = keyed if per_tier is None else per_tier.unionByName(keyed)
    spans = owner_spans(per_tier, ["tier_key"])
    latest = spans.groupBy("tier_key").agg(
        F.count("*").alias("owners"), F.max(F.struct("last_period", "owner"))["owner"].alias("latest_owner")
    )
    return matches.withColumn("tier_key", tier_key()).join(latest, "tier_key", "left").drop("tier_key")
