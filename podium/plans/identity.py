"""Entity resolution and owner matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from podium.functions import identifiers as idn
from podium.functions import text
from podium.operators import events as ev
from podium.operators import resolve as rv
from podium.operators.measures import count_if
from podium.plans import dialect as q
from podium.plans.registry import query

C = F.col
N = q.n()

# Fixed values of this binding: one name settled by hand.
MANUAL = {"redring": ("Red Ring", "21000", "J/29")}

CLEAN = f"regexp_replace({q.collapse('name')}, '\\s*(\\*{{2,}}|\\?{{2,}}|#{{2,}})\\s*$', '')"
USED = "us AS (SELECT b.*, coalesce(u.n, 0) AS uses FROM boats b LEFT JOIN (SELECT boat_id, count(*) AS n FROM results WHERE status IS NULL GROUP BY 1) u USING (boat_id))"


def used_boats(t):
    uses = t.results.where("status IS NULL").groupBy("boat_id").agg(F.count("*").alias("uses"))
    return t.boats.join(uses, "boat_id", "left").fillna(0, ["uses"])


def _related(a: str, b: str) -> str:
    return f"""coalesce(CASE WHEN {a} = {b} THEN true WHEN least(length({a}), length({b})) >= 3 AND abs(length({a}) - length({b})) <= 2
        AND (contains({a}, {b}) OR contains({b}, {a})) THEN true
        WHEN length({a}) = length({b}) AND length({a}) >= 4 THEN hamming({a}, {b}) <= 1 ELSE false END, false)"""


RECON = f"""{USED}, d0 AS (SELECT boat_id, uses, {q.collapse('name')} AS tidy, {q.name_key(CLEAN)} AS key, {q.ident('sail')} AS ident,
        {q.design_class('raw_class')} AS cls, {q.collapse('club')} AS club FROM us),
    d1 AS (SELECT *, {q.strong('ident')} IS TRUE AS strong, {q.placeholder('ident')} AS dummy, regexp_replace(cls, ' [IO]/B$', '') AS family,
        {q.name_score('tidy')} AS ns, (CASE WHEN regexp_full_match(cls, '[A-D]\\d+/\\d+[A-Z]?') THEN 0 ELSE 1000 END + length(cls)) AS cs FROM d0),
    st AS (SELECT key, count(DISTINCT family) <= 1 AS one_family,
        CASE WHEN count(DISTINCT ident) FILTER (strong) = 1 THEN min(ident) FILTER (strong) END AS sole_strong,
        CASE WHEN count(DISTINCT ident) FILTER (NOT dummy) = 1 THEN min(ident) FILTER (NOT dummy) END AS sole_known,
        count(*) FILTER (NOT dummy) AS n_known FROM d1 GROUP BY 1),
    dm AS (SELECT key, ident AS d_ident, family AS d_family, boat_id AS d_id FROM (SELECT *, row_number() OVER (PARTITION BY key
        ORDER BY uses DESC, strong DESC, ns DESC, boat_id) AS rn FROM d1) WHERE rn = 1),
    mk AS (SELECT d1.*, st.* EXCLUDE (key), dm.* EXCLUDE (key), one_family AND sole_strong IS NOT NULL AND coalesce(ident = sole_strong
            OR NOT strong OR {_related('ident', 'sole_strong')}, false) AS in2,
        one_family AND d_ident IS NOT NULL AND (boat_id = d_id OR (uses = 0 AND coalesce(family = d_family, true)
            AND {_related('ident', 'd_ident')})) AS in3 FROM d1 JOIN st USING (key) JOIN dm USING (key)),
    sz AS (SELECT *, count(*) FILTER (in2) OVER (PARTITION BY key) AS n2, count(*) FILTER (in3) OVER (PARTITION BY key) AS n3 FROM mk),
    ru AS (SELECT *, CASE WHEN key = 'redring' THEN 1 WHEN n2 >= 2 THEN CASE WHEN in2 THEN 2 ELSE 0 END
        WHEN n3 >= 2 THEN CASE WHEN in3 THEN 3 ELSE 0 END ELSE 4 END AS rule FROM sz),
    se AS (SELECT *, CASE WHEN rule = 0 THEN 'row:' || boat_id WHEN rule < 4 THEN 'all' WHEN NOT dummy THEN ident
        WHEN sole_known IS NOT NULL AND n_known = 1 THEN sole_known WHEN sole_known IS NOT NULL THEN '?' ELSE 'row:' || boat_id END AS st_key FROM ru),
    cn AS (SELECT *, count(*) OVER g AS members, first_value(boat_id) OVER w AS canonical_id,
        first_value(tidy) OVER w AS p_tidy, first_value(ident) OVER w AS p_ident, first_value(cls) OVER w AS p_cls,
        first_value(tidy) OVER (PARTITION BY key, rule, st_key ORDER BY ns DESC, tidy DESC) AS b_name,
        first_value(cls) OVER (PARTITION BY key, rule, st_key ORDER BY cs DESC NULLS LAST, cls DESC NULLS LAST) AS b_class,
        min(ident) FILTER (NOT dummy) OVER g AS i_lo, max(ident) FILTER (NOT dummy) OVER g AS i_hi
        FROM se WINDOW g AS (PARTITION BY key, rule, st_key), w AS (PARTITION BY key, rule, st_key ORDER BY
            CASE WHEN rule = 2 THEN coalesce(CAST(ident = sole_strong AS INT), 0) WHEN rule = 4 THEN CAST(NOT dummy AS INT) ELSE 0 END DESC,
            CASE WHEN rule = 4 THEN coalesce(cs, 0) ELSE 0 END DESC, uses DESC, CASE WHEN rule = 3 THEN CAST(strong AS INT) ELSE 0 END DESC,
            ns DESC, boat_id)),
    rc AS (SELECT boat_id, canonical_id, CAST(rule AS INTEGER) AS rule, CAST(members AS BIGINT) AS members, uses,
        CASE WHEN rule = 1 THEN 'Red Ring' WHEN members < 2 THEN regexp_replace(p_tidy, '\\s*(\\*{{2,}}|\\?{{2,}}|#{{2,}})\\s*$', '') WHEN rule = 3 THEN p_tidy ELSE b_name END AS best_name,
        CASE WHEN rule = 1 THEN '21000' WHEN members < 2 OR rule = 3 THEN p_ident WHEN rule = 2 THEN sole_strong
            ELSE coalesce(CASE WHEN i_lo = i_hi THEN i_lo END, p_ident) END AS best_ident,
        CASE WHEN rule = 1 THEN 'J/29' WHEN members < 2 OR rule = 3 THEN p_cls ELSE b_class END AS best_class FROM cn)"""


def reconciled(t):
    return rv.reconcile(used_boats(t), MANUAL)


@query(
    "C03_entity_reconciliation",
    f"WITH {RECON} SELECT boat_id, canonical_id, rule, members, best_name, best_ident, best_class FROM rc",
)
def _(t):
    return reconciled(t).select("boat_id", "canonical_id", "rule", "members", "best_name", "best_ident", "best_class")


@query(
    "C03_repointed_results",
    f"""WITH {RECON} SELECT canonical_id, {N} AS results, {q.n('DISTINCT contest_id')} AS contests FROM results JOIN rc USING (boat_id) GROUP BY 1""",
)
def _(t):
    per = t.results.join(reconciled(t).select("boat_id", "canonical_id"), "boat_id")
    once = per.groupBy("canonical_id", "contest_id").agg(F.count("*").alias("n"))
    return once.groupBy("canonical_id").agg(F.sum("n").alias("results"), F.count("*").alias("contests"))


@query(
    "C03_reconciliation_counts",
    f"""WITH {RECON} SELECT rule, {N} AS register_rows, {q.n(cond='boat_id = canonical_id')} AS survivors, {q.n(cond='boat_id <> canonical_id')} AS merged
    FROM rc GROUP BY 1""",
)
def _(t):
    return (
        reconciled(t)
        .groupBy("rule")
        .agg(
            F.count("*").alias("register_rows"),
            count_if(C("boat_id") == C("canonical_id")).alias("survivors"),
            count_if(C("boat_id") != C("canonical_id")).alias("merged"),
        )
    )


@query(
    "C04_synthetic_absorption",
    f"""WITH e AS (SELECT boat_id AS entity_id, {q.collapse('name')} AS name, {q.ident('sail')} AS ident, {q.design_class('raw_class')} AS cls FROM boats),
    r AS (SELECT ident, min(entity_id) AS into_id, min(cls) AS rc FROM e WHERE NOT regexp_full_match(name, '(?i)(sail|bow) \\S+') AND ident IS NOT NULL
        GROUP BY 1 HAVING count(*) = 1)
    SELECT entity_id, into_id FROM e JOIN r USING (ident) WHERE regexp_full_match(name, '(?i)(sail|bow) \\S+') AND NOT {q.placeholder('ident')}
        AND (cls IS NULL OR rc IS NULL OR cls = rc)""",
)
def _(t):
    entities = t.boats.select(
        C("boat_id").alias("entity_id"), "name", idn.identifier("sail").alias("ident"), idn.design_class("raw_class").alias("cls")
    )
    return rv.absorb_synthetic(entities)


INCOMING = """boat_id AS row_id, CASE WHEN boat_id % 6 = 0 THEN 'New ' || name ELSE name END AS name,
    CASE WHEN boat_id % 4 = 0 THEN '?' ELSE sail END AS sail"""


@query(
    "C02_entity_assignment",
    f"""WITH inc AS (SELECT {INCOMING} FROM boats), i AS (SELECT row_id, {q.name_key(CLEAN)} AS key, {q.ident('sail')} AS ident, {q.placeholder('sail')} AS dummy FROM inc),
    g AS (SELECT boat_id, {q.name_key(CLEAN)} AS key, {q.ident('sail')} AS ident, {q.placeholder('sail')} AS dummy FROM boats),
    x AS (SELECT key, ident, min(boat_id) AS exact_id FROM g WHERE NOT dummy GROUP BY 1, 2),
    k AS (SELECT key, min(boat_id) FILTER (dummy) AS blank_id, min(boat_id) FILTER (NOT dummy) AS known_id,
        count(DISTINCT ident) FILTER (NOT dummy) AS n_known FROM g GROUP BY 1)
    SELECT row_id, CASE WHEN exact_id IS NOT NULL THEN 'exact' WHEN dummy AND n_known = 1 THEN 'sole' WHEN blank_id IS NOT NULL THEN 'blank' ELSE 'new' END AS tier,
        CASE WHEN exact_id IS NOT NULL THEN exact_id WHEN dummy AND n_known = 1 THEN known_id WHEN blank_id IS NOT NULL THEN blank_id END AS boat_id
    FROM i LEFT JOIN x USING (key, ident) LEFT JOIN k USING (key)""",
)
def _(t):
    incoming = t.boats.selectExpr(
        "boat_id AS row_id",
        "CASE WHEN boat_id % 6 = 0 THEN 'New ' || name ELSE name END AS name",
        "CASE WHEN boat_id % 4 = 0 THEN '?' ELSE sail END AS sail",
    )
    return rv.assign(incoming, t.boats)


ALIAS = f"""al AS (SELECT boat_id, name, {q.collapse('name')} AS tidy, {q.name_key('name')} AS key, {q.ident('sail')} AS ident, uses FROM us),
    ng AS (SELECT 'name:' || key AS review_group, 'same_normalized_name' AS reason, boat_id, tidy, uses,
        CASE WHEN count(DISTINCT name) OVER (PARTITION BY key) <> count(*) OVER (PARTITION BY key) THEN 'high' ELSE 'medium' END AS confidence,
        first_value(boat_id) OVER (PARTITION BY key ORDER BY uses DESC, boat_id) AS canonical_id,
        first_value(tidy) OVER (PARTITION BY key ORDER BY uses DESC, boat_id) AS canonical_name, count(*) OVER (PARTITION BY key) AS members FROM al WHERE key <> ''),
    sg AS (SELECT 'sail:' || ident AS review_group, 'same_cleaned_sail_number' AS reason, boat_id, tidy, uses, 'medium' AS confidence,
        first_value(boat_id) OVER (PARTITION BY ident ORDER BY uses DESC, boat_id) AS canonical_id,
        first_value(tidy) OVER (PARTITION BY ident ORDER BY uses DESC, boat_id) AS canonical_name, count(*) OVER (PARTITION BY ident) AS members,
        count(DISTINCT key) OVER (PARTITION BY ident) AS names FROM al WHERE {q.strong('ident')}),
    ar AS (SELECT * FROM ng WHERE members > 1 UNION ALL SELECT * EXCLUDE (names) FROM sg WHERE members > 1 AND names > 1)"""


def alias_rows(t):
    """Rows that share a name key, or an identifier under different names, each with the row suggested to stay."""
    rows = used_boats(t).select(
        "boat_id",
        "name",
        "uses",
        text.collapse("name").alias("tidy"),
        text.name_key("name").alias("key"),
        idn.identifier("sail").alias("ident"),
    )
    # a row stands in the group of its name and, with a real identifier, in the group of that
    keyed = rows.withColumn(
        "review_group",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(C("key") != "", F.concat(F.lit("name:"), C("key"))),
                    F.when(idn.strong(C("ident")), F.concat(F.lit("sail:"), C("ident"))),
                )
            )
        ),
    )
    stay = F.max(F.struct("uses", (-C("boat_id")).alias("m"), "boat_id", "tidy")).alias("p")
    spelled = keyed.groupBy("review_group", "name").agg(
        F.count("*").alias("n"), stay, F.min("key").alias("lo"), F.max("key").alias("hi")
    )
    stats = spelled.groupBy("review_group").agg(
        F.sum("n").alias("members"),
        F.count("*").alias("names"),
        F.max("p").alias("p"),
        (F.min("lo") != F.max("hi")).alias("several"),
    )
    by_name = F.startswith("review_group", F.lit("name:"))
    return (
        keyed.join(stats.where("members > 1"), "review_group")
        .where(by_name | C("several"))
        .select(
            "review_group",
            F.when(by_name, "same_normalized_name").otherwise("same_cleaned_sail_number").alias("reason"),
            "boat_id",
            "tidy",
            "uses",
            F.when(by_name & (C("names") != C("members")), "high").otherwise("medium").alias("confidence"),
            "members",
            C("p.boat_id").alias("canonical_id"),
            C("p.tidy").alias("canonical_name"),
        )
    )


@query(
    "C05_alias_review",
    f"WITH {USED}, {ALIAS} SELECT review_group, reason, boat_id, tidy, CAST(uses AS BIGINT) AS uses, confidence, canonical_id, canonical_name FROM ar",
)
def _(t):
    return alias_rows(t).drop("members")


@query(
    "J15_duplicate_links",
    f"""WITH {USED}, {ALIAS} SELECT review_group, canonical_id AS candidate_a, boat_id AS candidate_b, confidence,
        CAST(members * (members - 1) // 2 AS BIGINT) AS pairs_in_group FROM ar WHERE boat_id <> canonical_id""",
)
def _(t):
    # every duplicate is linked to the row that stays; the other pairs of a group follow from these links
    pairs = F.call_function("div", C("members") * (C("members") - 1), F.lit(2))
    return alias_rows(t).where("boat_id <> canonical_id").select(
        "review_group",
        C("canonical_id").alias("candidate_a"),
        C("boat_id").alias("candidate_b"),
        "confidence",
        pairs.alias("pairs_in_group"),
    )


def _keys(type_col: str) -> str:
    c = f"regexp_replace(lower({q.collapse(type_col)}), '\\b([io])/b\\b', '\\1b', 'g')"
    return f"""lower(trim(name)) AS name_k, regexp_replace(lower(trim(name)), '[\\s./''-]+', '', 'g') AS fuzzy_k,
        lower(trim(regexp_replace(trim(sail), '^(CAN|USA) +', ''))) AS sail_k, {c} AS type_k"""


MATCH = f"""xe AS (SELECT *, {_keys('type')} FROM outside_entries), xb AS (SELECT *, {_keys('class')} FROM own_boats),
    f1 AS (SELECT fuzzy_k, count(DISTINCT name_k) AS fn FROM xe GROUP BY 1), f2 AS (SELECT fuzzy_k, type_k, count(DISTINCT name_k) AS ftn FROM xe GROUP BY 1, 2),
    s1 AS (SELECT sail_k, least(count(DISTINCT name_k), count(DISTINCT fuzzy_k)) AS sn FROM xe GROUP BY 1),
    s2 AS (SELECT sail_k, type_k, least(count(DISTINCT name_k), count(DISTINCT fuzzy_k)) AS stn FROM xe GROUP BY 1, 2),
    mm AS (SELECT *, sail_k NOT IN ('999','0','??','???','????','xxxxxx','xxx','') AS usable FROM xb LEFT JOIN (SELECT DISTINCT name_k, 1 AS byn FROM xe) USING (name_k)
        LEFT JOIN f1 USING (fuzzy_k) LEFT JOIN f2 USING (fuzzy_k, type_k) LEFT JOIN s1 USING (sail_k) LEFT JOIN s2 USING (sail_k, type_k)),
    ma AS (SELECT *, CASE WHEN byn = 1 THEN 'name' WHEN fn = 1 THEN 'fuzzy_name' WHEN type_k <> '' AND ftn = 1 THEN 'fuzzy_name+type'
        WHEN usable AND sn = 1 THEN 'sail' WHEN usable AND type_k <> '' AND stn = 1 THEN 'sail+type' END AS match_type FROM mm),
    mr AS (SELECT boat_id, name_k, fuzzy_k, sail_k, type_k, match_type, CASE WHEN match_type IS NULL AND usable AND sn IS NOT NULL THEN CASE WHEN type_k = '' THEN 'sail matches several names'
        WHEN stn IS NULL THEN 'sail matches several names, none of this type' ELSE 'sail and type match several names' END END AS review_reason FROM ma)"""


def matches(t):
    return rv.match_cascade(t.own_boats, t.outside_entries)


@query("J12_match_cascade", f"WITH {MATCH} SELECT boat_id, match_type, review_reason FROM mr")
def _(t):
    return matches(t).select("boat_id", "match_type", "review_reason")


PERSON = "CASE entry_id % 3 WHEN 0 THEN 'Bob Smith ' WHEN 1 THEN 'Robert Smith ' ELSE 'Bob Smith ' END || CAST(regexp_extract(skipper, '[0-9]+') AS VARCHAR)"
SPANS = f"""sp AS (SELECT *, {PERSON} AS form, 'robert smith ' || regexp_extract(skipper, '[0-9]+') AS person FROM xe)"""


def _best(key: str) -> str:
    return f"""SELECT tk, count(*) AS owners, arg_max(owner, (last_period, owner)) AS latest FROM (SELECT tk, person, arg_max(form, (n, form)) AS owner,
        max(hi) AS last_period FROM (SELECT {key} AS tk, person, form, count(*) AS n, max(period) AS hi FROM sp GROUP BY ALL) GROUP BY 1, 2) GROUP BY 1"""


OWNERS = f"""{MATCH}, {SPANS}, ow AS ({_best("'name|' || name_k")} UNION ALL {_best("'fuzzy_name|' || fuzzy_k")} UNION ALL {_best("'fuzzy_name+type|' || fuzzy_k || '|' || type_k")}
        UNION ALL {_best("'sail|' || sail_k")} UNION ALL {_best("'sail+type|' || sail_k || '|' || type_k")}),
    mo AS (SELECT boat_id, name_k, match_type, review_reason, owners, latest FROM (SELECT *, CASE match_type WHEN 'name' THEN 'name|' || name_k
        WHEN 'fuzzy_name' THEN 'fuzzy_name|' || fuzzy_k WHEN 'fuzzy_name+type' THEN 'fuzzy_name+type|' || fuzzy_k || '|' || type_k WHEN 'sail' THEN 'sail|' || sail_k
        WHEN 'sail+type' THEN 'sail+type|' || sail_k || '|' || type_k END AS tk FROM mr) LEFT JOIN ow USING (tk)),
    rg AS (SELECT lower(trim(name)) AS name_k, arg_min(owner, reg_no) AS reg FROM registry WHERE owner IS NOT NULL GROUP BY 1),
    fo AS (SELECT boat_id, coalesce(match_type, CASE WHEN reg IS NOT NULL THEN 'registry' END, 'none') AS match_type, coalesce(owners, 0) AS owners,
        coalesce(latest, 'Ann Lee ' || regexp_extract(reg, '[0-9]+')) AS owner, review_reason FROM mo LEFT JOIN rg USING (name_k))"""


def merged_owners(t):
    """Latest owner from the other archive, else the registry; what stays open goes to review."""
    found = rv.owners_of_matches(matches(t), t.outside_entries)
    first = (
        t.registry.where("owner IS NOT NULL")
        .groupBy(F.lower(F.trim("name")).alias("name_k"))
        .agg(F.min(F.struct("reg_no", "owner"))["owner"].alias("reg"))
    )
    joined = found.join(first, "name_k", "left")
    return joined.select(
        "boat_id",
        F.coalesce("match_type", F.when(C("reg").isNotNull(), "registry"), F.lit("none")).alias("match_type"),
        F.coalesce("owners", F.lit(0)).alias("owners"),
        F.coalesce("latest_owner", F.when(C("reg").isNotNull(), text.person_name("reg"))).alias("owner"),
        "review_reason",
    )


@query("W12_latest_owner", f"WITH {OWNERS} SELECT boat_id, match_type, CAST(owners AS BIGINT) AS owners, owner FROM fo")
def _(t):
    return merged_owners(t).drop("review_reason")


@query(
    "C06_merge_review",
    f"""WITH {OWNERS} SELECT match_type, coalesce(review_reason, CASE WHEN owners > 1 THEN 'several owners' END, 'settled') AS outcome,
        {N} AS boats FROM fo GROUP BY ALL""",
)
def _(t):
    outcome = F.coalesce("review_reason", F.when(C("owners") > 1, "several owners"), F.lit("settled"))
    return merged_owners(t).groupBy("match_type", outcome.alias("outcome")).agg(F.count("*").alias("boats"))


@query(
    "A40_common_spelling",
    f"""WITH xe AS (SELECT * FROM outside_entries), {SPANS} SELECT person, arg_max(form, (n, form)) AS owner, min(lo) AS first_period, max(hi) AS last_period FROM
        (SELECT person, form, count(*) AS n, min(period) AS lo, max(period) AS hi FROM sp GROUP BY ALL) GROUP BY 1""",
)
def _(t):
    return rv.owner_spans(t.outside_entries, [])


@query(
    "A41_counts_by_type",
    """SELECT entity_id, CAST(count(DISTINCT event_id) FILTER (event_type = 'tns') AS BIGINT) AS tns, CAST(count(DISTINCT event_id)
        FILTER (event_type = 'trophy') AS BIGINT) AS trophy FROM star GROUP BY 1""",
)
def _(t):
    once = t.results.join(t.contests, "contest_id").select("entity_id", "event_type", "event_id").distinct()
    return once.groupBy("entity_id").pivot("event_type", ["tns", "trophy"]).agg(F.count("event_id")).fillna(0)


@query(
    "L06_review_order",
    f"""WITH c AS (SELECT entity_id, count(DISTINCT event_id) FILTER (event_type = 'tns') AS a, count(DISTINCT event_id) FILTER (event_type = 'trophy') AS b
        FROM star GROUP BY 1) SELECT entity_id, CAST(a + b AS BIGINT) AS total, CASE WHEN a + b >= 150 THEN 'high' WHEN a + b >= 20 THEN 'medium' ELSE 'low' END AS priority
        FROM c ORDER BY total DESC, entity_id""",
)
def _(t):
    kept = t.results.join(t.contests.where("event_type IN ('tns', 'trophy')"), "contest_id")
    total = kept.select("entity_id", "event_id").distinct().groupBy("entity_id").agg(F.count("*").alias("total"))
    everyone = t.results.select("entity_id").distinct().join(total, "entity_id", "left").fillna(0, ["total"])
    label = F.when(C("total") >= 150, "high").when(C("total") >= 20, "medium").otherwise("low")
    return everyone.withColumn("priority", label).orderBy(F.desc("total"), "entity_id")


SHEET = """entity_id, CASE entity_id % 4 WHEN 0 THEN upper(entity_name) ELSE ' ' || entity_name END AS boat, CASE WHEN entity_id % 7 = 0 THEN NULL
    ELSE owner END AS owner_typed, CASE WHEN entity_id % 5 = 0 THEN 'x' ELSE CAST(nation_id AS STRING) END AS sail"""


@query(
    "J14_case_insensitive_join",
    f"""WITH s AS (SELECT {SHEET} FROM entities), j AS (SELECT s.*, e.entity_id AS hit FROM s LEFT JOIN entities e ON lower(trim(e.entity_name)) = lower(trim(s.boat))
        AND CAST(e.nation_id AS VARCHAR) = lower(trim(s.sail)))
    SELECT CASE WHEN owner_typed IS NULL THEN 'no_owner' WHEN hit IS NULL THEN 'no_boat' ELSE 'loaded' END AS outcome, {N} AS sheet_rows FROM j GROUP BY 1""",
)
def _(t):
    sheet = t.entities.selectExpr(
        "entity_id",
        "CASE entity_id % 4 WHEN 0 THEN upper(entity_name) ELSE ' ' || entity_name END AS boat",
        "CASE WHEN entity_id % 7 = 0 THEN NULL ELSE owner END AS owner_typed",
        "CASE WHEN entity_id % 5 = 0 THEN 'x' ELSE CAST(nation_id AS STRING) END AS sail",
    ).select("owner_typed", F.lower(F.trim("boat")).alias("n"), F.lower(F.trim("sail")).alias("s"))
    known = t.entities.select(
        F.lower(F.trim("entity_name")).alias("n"), C("nation_id").cast("string").alias("s"), C("entity_id").alias("hit")
    )
    outcome = F.when(C("owner_typed").isNull(), "no_owner").when(C("hit").isNull(), "no_boat").otherwise("loaded")
    return sheet.join(known, ["n", "s"], "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("sheet_rows"))


@query(
    "C12_sticky_owner_sheet",
    f"""WITH old AS (SELECT reg_no AS boat_id, owner, CASE WHEN reg_no % 3 = 0 THEN '' ELSE 'kept' END AS notes FROM registry WHERE owner IS NOT NULL)
    SELECT b.boat_id, {q.collapse('b.name')} AS name, coalesce(b.sail, '') AS sail, coalesce(old.owner, '') AS owner,
        coalesce(nullif(old.notes, ''), CAST(b.first_period AS VARCHAR)) AS notes FROM boats b LEFT JOIN old USING (boat_id)""",
)
def _(t):
    old = t.registry.where("owner IS NOT NULL").selectExpr(
        "reg_no AS boat_id", "owner", "CASE WHEN reg_no % 3 = 0 THEN '' ELSE 'kept' END AS notes"
    )
    return t.boats.join(old, "boat_id", "left").select(
        "boat_id",
        text.collapse("name").alias("name"),
        F.coalesce("sail", F.lit("")).alias("sail"),
        F.coalesce("owner", F.lit("")).alias("owner"),
        F.coalesce(F.nullif(C("notes"), F.lit("")), C("first_period").cast("string")).alias("notes"),
    )


@query(
    "C13_skipper_aliases",
    f"""SELECT {q.collapse('name')} AS name, coalesce(sail, '') AS sail, {q.design_class('raw_class')} AS class, {N} AS results,
        min(period) AS first_period, max(period) AS last_period FROM results JOIN contest_headers USING (contest_id) JOIN boats USING (boat_id)
    WHERE participant_type = 'helm' GROUP BY ALL""",
)
def _(t):
    helms = t.boats.where("participant_type = 'helm'")
    per = (
        t.results.join(t.contest_headers, "contest_id")
        .groupBy("boat_id")
        .agg(F.count("*").alias("n"), F.min("period").alias("lo"), F.max("period").alias("hi"))
    )
    return (
        per.join(helms, "boat_id")
        .groupBy(
            text.collapse("name").alias("name"),
            F.coalesce("sail", F.lit("")).alias("sail"),
            idn.design_class("raw_class").alias("class"),
        )
        .agg(F.sum("n").alias("results"), F.min("lo").alias("first_period"), F.max("hi").alias("last_period"))
    )


@query(
    "C18_renormalised_dimensions",
    f"""SELECT boat_id, {CLEAN} AS name, CASE WHEN {q.is_band('raw_class')} THEN NULL ELSE {q.design_class('raw_class')} END AS class,
        {q.ident('sail')} AS sail, coalesce(nullif({q.collapse('club')}, ''), 'HOME') AS club FROM boats""",
)
def _(t):
    return t.boats.select(
        "boat_id",
        rv.canonical_boat_name("name").alias("name"),
        F.when(~idn.is_rating_band("raw_class"), idn.design_class("raw_class")).alias("class"),
        idn.identifier("sail").alias("sail"),
        F.coalesce(text.blank_to_null(text.collapse("club")), F.lit("HOME")).alias("club"),
    )


@query(
    "S13_surrogate_keys",
    f"""SELECT key, md5(key) AS surrogate, {N} AS rows_seen FROM (SELECT {q.name_key('name')} AS key FROM boats) GROUP BY 1""",
)
def _(t):
    # the whole digest of the natural key needs no global numbering, is the same in every load and keeps keys apart
    key = text.name_key("name").alias("key")
    return t.boats.groupBy(key).agg(F.count("*").alias("rows_seen")).withColumn("surrogate", F.md5(C("key").cast("binary")))
