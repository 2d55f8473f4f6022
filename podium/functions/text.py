"""Names, slugs, file stems and labels as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(c: Column | str) -> Column:
    """Runs of white space become one blank, ends are trimmed, null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(as_col(c), F.lit("")), r"\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def name_key(c: Column | str, drop: str = "'\"`") -> Column:
    """Comparison key of a name: lower case, '&' read as 'and', only letters and digits kept."""
    spelled = F.replace(F.lower(collapse(c)), F.lit("&"), F.lit("and"))
    return F.regexp_replace(F.translate(spelled, drop, ""), "[^a-z0-9]+", "")


def slug(c: Column | str, sep: str = "-") -> Column:
    return F.btrim(F.regexp_replace(F.lower(collapse(c)), "[^a-z0-9]+", sep), F.lit(sep))


def file_stem(c: Column | str) -> Column:
    """Last path component without its extension, lower case, '-' as '_'."""
    last = F.regexp_extract(F.coalesce(as_col(c), F.lit("")), r"([^/]*)$", 1)
    return F.translate(F.lower(F.regexp_replace(last, r"(?<=.)\.[^.]*$", "")), "-", "_")


# Suffixes that mark a view of an event rather than the event itself. The last two count only
# after an underscore, or when nothing else is left.
VIEW_SUFFIXES = r"(_*(overall|summary|seriesab|series)|_+(all|ab))+$"
BARE_VIEWS = ("all", "ab")


def canonical_stem(c: Column | str) -> Column:
    """File stem with every trailing view suffix removed."""
    return strip_views(file_stem(c))


def strip_views(stem: Column) -> Column:
    cut = F.regexp_replace(stem, VIEW_SUFFIXES, "")
    return F.when(cut.isin(*BARE_VIEWS), "").otherwise(cut)


def stem_without_number(c: Column | str) -> Column:
    return strip_number(file_stem(c))


def strip_number(stem: Column) -> Column:
    return F.regexp_replace(stem, r"_*\d+$|_+$", "")


# Words that mark a view in an event name; blanks around & do not count.
VIEW_TOKENS = ("A&B&S", "A,B&S", "AB&S", "A&B", "A,B", "AB", "All", "Overall", "Summary")
VIEW_WORDS = r"(?i)\s+(?:" + "|".join(VIEW_TOKENS).replace("&", r"\s*&\s*") + r")\b"
VIEW_NAME = r"\boverall\b|\bsummary\b|\ba\s*&\s*b\b|\ba,b\b|\ball\b"


def canonical_name(c: Column | str) -> Column:
    """The event's name without the words that mark a view of it."""
    return trim_ends(collapse(F.regexp_replace(collapse(c), VIEW_WORDS, "")))


def trim_ends(c: Column) -> Column:
    return F.btrim(c, F.lit(" -"))


def is_view_name(c: Column | str) -> Column:
    return F.lower(collapse(c)).rlike(VIEW_NAME)


def clean_title(c: Column | str) -> Column:
    """Title in which marks of doubt (?? and ##) count as blanks, and blanks before punctuation do not count."""
    certain = collapse(F.regexp_replace(collapse(c), r"[?]{2,}|#{2,}", " "))
    return trim_ends(F.regexp_replace(certain, " (?=[,.;:])", ""))


TITLE_PREFIX = r"(?i)^Sailwave results for\s+"  # fixed value: prefix the scoring program puts on page titles


def event_name(h1: Column | str, h2: Column | str, title: Column | str, path: Column | str) -> Column:
    """Best available name of an event: headings first, then the page title, then the file stem."""
    a, b, ti = clean_title(h1), clean_title(h2), clean_title(title)
    joined = F.when(F.contains(F.lower(b), F.lower(a)), b).otherwise(clean_title(F.concat(a, F.lit(" - "), b)))
    last = F.regexp_replace(F.regexp_extract(as_col(path), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return (
        F.when((a != "") & (b != ""), joined)
        .when(b != "", b)
        .when(a != "", a)
        .when(ti != "", clean_title(F.regexp_replace(ti, TITLE_PREFIX, "")))
        .otherwise(last)
    )


def keywords(*cols: Column | str) -> Column:
    """Lower-case search text of the non-null parts."""
    return F.lower(F.concat_ws(" ", *[as_col(c).cast("string") for c in cols]))


def has_all_terms(text: Column, terms: Sequence[str]) -> Column:
    """Every term occurs somewhere in ``text``."""
    out = F.lit(True)
    for term in terms:
        out = out & F.contains(text, F.lit(term.lower()))
    return out


def map_label(c: Column | str, labels: Mapping[str, str], prefix: str = r"^[A-Z]+ - ") -> Column:
    """Canonical label by lookup, tried on ever looser forms of the text.

    The tiers are: the text itself, without its prefix, without dots, with blanks collapsed; text no tier knows
    comes back without its prefix.
    """
    lookup = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    raw = as_col(c)
    bare = F.trim(F.regexp_replace(raw, prefix, ""))
    undotted = F.replace(bare, F.lit("."), F.lit(""))
    tiers = [raw, bare, undotted, collapse(undotted)]
    return F.coalesce(*[F.try_element_at(lookup, tier) for tier in tiers], bare)


# First names read as one person.
NICKNAMES = {
    "steve": "steven", "mike": "michael", "rob": "robert", "bob": "robert", "ted": "edward", "ed": "edward",
    "jim": "james", "bill": "william", "will": "william", "dick": "richard", "rick": "richard", "rich": "richard",
    "dan": "daniel", "dave": "david", "tom": "thomas", "chris": "christopher", "stu": "stuart", "greg": "gregory",
    "alex": "alexander", "jon": "jonathan", "liz": "elizabeth", "beth": "elizabeth", "sue": "susan",
    "pat": "patrick",
}


def person_name(c: Column | str) -> Column:
    """Tidy person name; names typed all in one case are put in title case (first letter of each word)."""
    tidy = collapse(c)
    one_case = ((F.upper(tidy) == tidy) | (F.lower(tidy) == tidy)) & tidy.rlike("[A-Za-z]")
    return F.regexp_replace(F.when(one_case, F.initcap(tidy)).otherwise(tidy), r"^\.\s*", "")


def person_key(c: Column | str) -> Column:
    """Key under which spellings of one person meet: lower case, nickname spelled out."""
    words = F.split(F.lower(collapse(c)), " ")
    names = F.create_map(*[F.lit(x) for pair in NICKNAMES.items() for x in pair])
    first = F.get(words, F.lit(0))
    rest = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.concat_ws(" ", F.coalesce(F.try_element_at(names, first), first), rest)


def fuzzy_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(as_col(c))), r"[\s\-/.']+", "")
