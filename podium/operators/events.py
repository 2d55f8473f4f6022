"""Event-level scope: canonical groups, special events, race counts and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.functions import text
from podium.operators.measures import count_if
from podium.functions.scoring import rate3

C = F.col

# Words in an event name that make it a special event.
LOCAL_WORDS = ("women", "womens", "ladies", "race week in a day", "fun & family", "white sail", "sail east")
EXTERNAL_WORDS = (
    "championship", "regatta", "nationals", "north american", "north americans", "canadians", "canada cup", "iod",
    "j/24", "j24", "j/29", "j29", "opti", "optimist", "laser", "chester",
)
# Words in titles and paths that decide the type of an event.
WEEKLY_WORDS = (
    "tns", "thursday night", "glube", "paceship", "paveship", "scotia trawler", "moosehead", "fall series",
    "fall september", "thursday night series",
)
CHAMPIONSHIP_WORDS = (
    "championship", "nationals", "north american", "canadians", "sailfest", "ipyc", "mbcc", "race week", "one design",
    "one-design", "rwiad", "sail east", "chester iod", "iod fleet", "iod north", "crw",
)
WEEKLY = "tns"
EXPECTED_MONTHS = ("june", "july", "august", "september")


def mentions(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(c, F.lit(word))
    return out


def event_type(*parts: Column | str) -> Column:
    """tns, championship or trophy, from all the text known about a page."""
    all_text = text.keywords(*parts)
    return (
        F.when(mentions(all_text, WEEKLY_WORDS), WEEKLY)
        .when(mentions(all_text, CHAMPIONSHIP_WORDS), "championship")
        .otherwise("trophy")
    )


def event_stats(events: DataFrame, contests: DataFrame, results: DataFrame) -> DataFrame:
    """Events (with their number of contests) together with their results and distinct entities.

    Results meet their event once and are reduced twice, first to (event, entity), so nothing fans out and no
    distinct count is needed.
    """
    entries = (
        results.select("contest_id", "entity_id")
        .join(contests.select("contest_id", "event_id"), "contest_id")
        .groupBy("event_id", "entity_id")
        .agg(F.count("*").alias("n"))
        .groupBy("event_id")
        .agg(F.sum("n").alias("results"), F.count("*").alias("standings"))
    )
    return events.join(entries, "event_id", "left").fillna(0, ["results", "standings"])


def mark_views(names: DataFrame) -> DataFrame:
    """Comparison marks of event_name and source_file, each text worked out once, in stages.

    Add them where the names are fewest, such as to the series, before the names are joined to anything.
    """
    return (
        names.withColumn("_stem", text.file_stem("source_file"))
        .withColumns(
            {
                "_root": text.strip_views(C("_stem")),
                "_plain": text.strip_number(C("_stem")),
                "_name": text.name_key(text.canonical_name("event_name"), drop="'\"`|"),
            }
        )
        .withColumn("_variant", (C("_root") != C("_stem")) | text.is_view_name("event_name"))
    )


def canonical_groups(events: DataFrame) -> DataFrame:
    """Which events are views of one and the same event, and which view stands for the group.

    ``events`` needs event_id, period, event_type, event_name, source_file, series_month, first_date and the counts of
    ``event_stats``. Groups are reduced to one row each by mergeable aggregates and joined back, so a month with
    very many views never meets in one task.
    """
    marked = events if "_root" in events.columns else mark_views(events)
    dated = ["period", "_name", "first_date", "_plain"]
    twins = (
        marked.where((C("_name") != "") & (C("_plain") != "") & C("first_date").isNotNull())
        .groupBy(*dated)
        .agg(F.count("*").alias("_twins"))
    )
    key = (
        F.when((C("event_type") == WEEKLY) & C("series_month").isNotNull(), F.concat(F.lit("tns:"), "series_month"))
        .when(C("_twins") > 1, F.concat_ws(":", F.lit("dated"), "_name", "first_date", "_plain"))
        .when(C("_root") != "", C("_root"))
        .otherwise(F.concat(F.lit("event:"), C("event_id").cast("string")))
    )
    keyed = marked.join(twins, dated, "left").withColumn("group_key", key)
    claim = F.struct(
        (~C("_variant")).cast("int").alias("a"),
        (C("_root") == C("_stem")).cast("int").alias("b"),
        (C("contests") > 0).cast("int").alias("c"),
        C("results"),
        C("standings"),
        C("event_id"),
        C("event_name"),
    )
    groups = keyed.groupBy("period", "group_key").agg(F.count("*").alias("members"), F.max(claim).alias("_p"))
    alone = C("group_key").startswith("event:") | ((C("members") == 1) & ~C("_variant"))
    return keyed.join(groups, ["period", "group_key"]).select(
        "event_id",
        "period",
        "event_type",
        "event_name",
        "group_key",
        C("members").alias("group_size"),
        F.when(alone, C("event_id")).otherwise(C("_p.event_id")).alias("canonical_event_id"),
        F.when(alone, C("event_name")).otherwise(text.canonical_name("_p.event_name")).alias("canonical_name"),
        (~alone & (C("event_id") != C("_p.event_id"))).alias("is_variant"),
        # kept in the result, so that both uses of the keyed rows share their shuffles
        "contests",
        "results",
        "standings",
    )


def event_metrics(entries: DataFrame, participants: DataFrame) -> DataFrame:
    """Participants of an event by type, and how many of them entered no other event of the period.

    ``entries`` holds distinct (event_id, period, participant_id).
    """
    # counted in a window, so that the entries are sent once, not again to be joined with their counts
    yearly = F.count("*").over(Window.partitionBy("period", "participant_id"))
    return (
        entries.where("period IS NOT NULL AND participant_id IS NOT NULL")
        .withColumn("_events", yearly)
        .join(participants, "participant_id")
        .groupBy("event_id")
        .agg(
            F.count("*").alias("participants"),
            count_if(C("participant_type") == "helm").alias("helms"),
            count_if(C("participant_type") == "boat").alias("boats"),
            count_if(C("_events") == 1).alias("oneoffs"),
        )
        .withColumn("helm_ratio", rate3("helms", "participants"))
        .withColumn("oneoff_ratio", rate3("oneoffs", "participants"))
    )


def special_events(events: DataFrame) -> DataFrame:
    """Events outside the regular programme, with the kind and the reasons. Needs the columns of ``event_metrics``."""
    name = F.lower(text.collapse("event_name"))
    championship = C("event_type") == "championship"
    local, external = mentions(name, LOCAL_WORDS), mentions(name, EXTERNAL_WORDS)
    crowd = (C("participants") >= 10) & (C("helm_ratio") >= 0.8)
    strangers = (C("participants") >= 12) & (C("oneoff_ratio") >= 0.7)
    reasons = F.concat_ws(
        ",",
        F.when(championship, "event_type_championship"),
        F.when(local, "special_local_keyword"),
        F.when(external, "special_external_keyword"),
        F.when(crowd, "helm_dominated_large_event"),
        F.when(strangers, "mostly_oneoff_participants"),
    )
    kind = F.when(local | (~championship & ~external), "special_local").otherwise("special_external")
    kind = F.when(championship & F.contains(name, F.lit("women")), "special_local").otherwise(kind)
    return events.withColumn("reasons", reasons).where(C("reasons") != "").withColumn("kind", kind)


def race_token(number: str = "contest_no", key: str = "contest_key", date: str = "contest_date") -> Column:
    """What makes two race headers the same race: number, digits of the key, date, or the key itself."""
    tidy = F.lower(text.collapse(key))
    digits = F.regexp_extract(tidy, r"(\d+)", 1)
    return F.coalesce(
        F.concat(F.lit("num:"), C(number).cast("string")),
        F.when(digits != "", F.concat(F.lit("key:"), digits.cast("decimal(38,0)").cast("string"))),
        F.concat(F.lit("date:"), C(date).cast("string")),
        F.concat(F.lit("key:"), F.when(tidy != "", tidy).otherwise("unknown")),
    )


def night_token(month: str, number: str = "contest_no", key: str = "contest_key", date: str = "contest_date") -> Column:
    """The audit's token: date first, fleet letters after the key dropped, month kept apart."""
    tidy = F.regexp_replace(F.lower(text.collapse(key)), "[abps]+$", "")
    digits = F.regexp_extract(tidy, r"(\d+)", 1)
    m = F.coalesce(C(month), F.lit(""))
    return F.coalesce(
        F.concat(F.lit("date:"), C(date).cast("string")),
        F.concat(F.lit("num:"), m, F.lit(":"), C(number).cast("string")),
        F.concat(F.lit("key:"), m, F.lit(":"), F.when(digits != "", digits.cast("decimal(38,0)").cast("string"))),
        F.concat(F.lit("key:"), m, F.lit(":"), F.when(tidy != "", tidy).otherwise("unknown")),
    )


def race_counts(contests: DataFrame) -> DataFrame:
    """Logical races per event, and the count shown: distinct dates for a weekly series that has dates."""
    tokens = contests.select("event_id", race_token().alias("v")).distinct().groupBy("event_id").agg(
        F.count("*").alias("logical_races")
    )
    dates = (
        contests.where("contest_date IS NOT NULL")
        .select("event_id", "event_type", "contest_date")
        .distinct()
        .groupBy("event_id", "event_type")
        .agg(F.count("*").alias("dates"))
    )
    shown = F.when((C("event_type") == WEEKLY) & (C("dates") > 0), C("dates")).otherwise(C("logical_races"))
    return tokens.join(dates, "event_id", "left").select(
        "event_id", "logical_races", F.coalesce(shown, "logical_races").alias("shown_races")
    )


def series_completeness(weekly: DataFrame, announced: DataFrame) -> DataFrame:
    """Per period: months of the weekly series present, missing and unexpected, race nights, and a verdict.

    ``weekly`` holds the contest headers of the weekly series with their resolved month, ``announced`` its events without
    contests; in a period without any contest the largest number of races an event claims counts.
    """
    nights = weekly.select("period", night_token("series_month").alias("n")).distinct().groupBy("period").agg(
        F.count("*").alias("nights")
    )
    # a set of month names holds at most the months of a year
    claims = weekly.select("period", "series_month", F.lit(0).alias("races_sailed")).unionByName(
        announced.select("period", "series_month", F.coalesce("races_sailed", F.lit(0)).alias("races_sailed"))
    )
    months = claims.groupBy("period").agg(F.array_sort(F.collect_set("series_month")).alias("m"), F.max("races_sailed").alias("claimed"))
    wanted = F.array(*[F.lit(m) for m in EXPECTED_MONTHS])
    present = F.filter(wanted, lambda x: F.array_contains(C("m"), x))
    missing = F.array_except(wanted, C("m"))
    extra = F.array_except(C("m"), wanted)

    def listed(a: Column) -> Column:
        return F.array_join(a, ", ")

    notes = F.concat_ws(
        " | ",
        F.when(F.size(missing) > 0, F.concat(F.lit("missing months: "), listed(missing))),
        F.when(F.size(extra) > 0, F.concat(F.lit("unexpected months: "), listed(extra))),
        F.when(
            F.size(present) != len(EXPECTED_MONTHS),
            F.concat(F.lit("expected 4 monthly series, found "), F.size(present).cast("string")),
        ),
        F.when(
            ~C("nights").between(12, 17),
            F.concat(F.lit("race nights = "), C("nights").cast("string"), F.lit(" (expected 12-16)")),
        ),
    )
    counted = months.join(nights, "period", "left").withColumn("nights", F.coalesce("nights", C("claimed").cast("long")))
    return counted.select(
        "period",
        F.size(present).alias("months_found"),
        listed(present).alias("months_present"),
        listed(missing).alias("months_missing"),
        "nights",
        F.when(notes == "", "ok").otherwise("review").alias("status"),
        notes.alias("notes"),
    )
