"""Search index, facets and priority labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.functions.text import as_col, has_all_terms, keywords
from podium.operators.ranking import top_n_per_group

C = F.col

# Marks of pages that need less attention when a gap is looked into.
NOISE = r"(^|/)__ti_cnf(/|$)|(^|/)filelist\.xml$"
LOW_PATH, LOW_TITLE = r"post_results_test|xxxxxxx", r"sailwave results for  -|xxxxxxxx"
MEDIUM_PATH = r"matrix|_summary|_overall|_ab|_all|\.html"


def index_rows(df: DataFrame, kind: str, key: str, label: str, hint: str, *words: str) -> DataFrame:
    """Rows of one kind in the schema of the search index."""
    return df.select(
        F.lit(kind).alias("kind"),
        C(key).cast("long").alias("id"),
        C(label).cast("string").alias("label"),
        F.coalesce(C(hint).cast("string"), F.lit("")).alias("hint"),
        keywords(*words).alias("keywords"),
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def search(index: DataFrame, text: str, per_kind: int = 8) -> DataFrame:
    """First hits of each kind that hold every term, in label order."""
    hits = index.where(has_all_terms(C("keywords"), text.split()))
    return top_n_per_group(hits, ["kind"], [C("label"), C("id")], per_kind, out="place")


def priority(path: Column | str, title: Column | str, page_class: Column | str) -> Column:
    """struct(level, reason) of a page missing from the load; null for noise."""
    p, ti = F.lower(as_col(path)), F.lower(F.trim(F.coalesce(as_col(title), F.lit(""))))

    def says(level: str, reason: str) -> Column:
        return F.struct(F.lit(level).alias("level"), F.lit(reason).alias("reason"))

    return (
        F.when(p.rlike(NOISE), F.lit(None))
        .when(p.rlike(LOW_PATH), says("low", "test-or-template-like filename"))
        .when(ti.rlike(LOW_TITLE), says("low", "blank-or-placeholder title"))
        .when(p.rlike(MEDIUM_PATH), says("medium", "variant-or-auxiliary result view"))
        .when(as_col(page_class).isin("sailwave-summary", "sailwave-race"), says("medium", "single-view summary-or-race page"))
        .otherwise(says("high", "standalone result page"))
    )
