"""Identifiers and classes of competitors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from podium.functions.text import as_col, blank_to_null, collapse, let

# Identifiers typed where none was known.
DUMMIES = ("0", "000", "999", "9999", "1111111")
PLACEHOLDER = r"^[?X]+$|\?|^X+\d*X*$"
# A rating band stands in the class column but names a group, not a design.
RATING_BAND = r"^[A-D]\d+/\d+[A-Z]?$"
# Misspelt and short class names.
CLASS_ALIASES = {
    "far 30": "Farr 30",
    "ooen 40": "Open 40",
    "niagra 30": "Niagara 30",
    "benneteau 28.5": "Beneteau 28.5",
    "e22": "Etchells",
    "etchells-22": "Etchells",
    "k25": "Kirby 25",
}


def identifier(c: Column | str) -> Column:
    """Upper case, no blanks, no leading '#'; null when nothing is left."""
    return blank_to_null(F.regexp_replace(F.replace(F.upper(collapse(c)), F.lit(" "), F.lit("")), "^#", ""))


def is_placeholder(c: Column | str) -> Column:
    return unknown(identifier(c))


def is_strong(c: Column | str) -> Column:
    """A real identifier: not a placeholder, has a digit and at least four characters."""
    return strong(identifier(c))


def unknown(ident: Column) -> Column:
    """Same as ``is_placeholder`` for an identifier that is tidy already."""
    return ident.isNull() | ident.isin(*DUMMIES) | ident.rlike(PLACEHOLDER)


def strong(ident: Column) -> Column:
    return ~unknown(ident) & ident.rlike(r"\d") & (F.length(ident) >= 4)


def related(left: Column | str, right: Column | str) -> Column:
    """Two identifiers that may be one: equal, one inside the other, or one character apart."""
    ids = F.struct(identifier(left).alias("a"), identifier(right).alias("b"))
    return F.coalesce(let(ids, lambda p: near(p["a"], p["b"])), F.lit(False))


def near(a: Column, b: Column) -> Column:
    """Same as ``related`` for identifiers that are tidy already; null when either is."""
    la, lb = F.length(a), F.length(b)
    inside = (F.least(la, lb) >= 3) & (F.abs(la - lb) <= 2) & (F.contains(a, b) | F.contains(b, a))
    close = (la == lb) & (la >= 4) & (F.size(F.filter(_differing(a, b), lambda d: d)) <= 1)
    return (a == b) | inside | close


def _differing(a: Column, b: Column) -> Column:
    """Per character position, whether two texts of one length differ there."""
    return F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y)


def design_class(c: Column | str) -> Column:
    """Class in its usual spelling; null when empty."""
    text = F.regexp_replace(collapse(c), r"\s*(\?{2,}|\*{2,}|#{2,})\s*$", "")
    caps = F.upper(text)
    hull = r"^J/?(\d+)(?: ([IO])/?B)?$"
    number, suffix = F.regexp_extract(caps, hull, 1), F.regexp_extract(caps, hull, 2)
    aliases = F.create_map(*[F.lit(x) for pair in CLASS_ALIASES.items() for x in pair])
    twin = r"(?i)^C\s*&\s*C\s*(\d.*)$"
    return (
        F.when(text == "", F.lit(None))
        .when(caps.rlike(RATING_BAND), caps)
        .when(caps.rlike(hull) & (suffix != ""), F.concat(F.lit("J/"), number, F.lit(" "), suffix, F.lit("/B")))
        .when(caps.rlike(hull), F.concat(F.lit("J/"), number))
        .when(F.startswith(caps, F.lit("J/")), caps)
        .when(text.rlike(twin), F.concat(F.lit("C&C "), F.regexp_extract(text, twin, 1)))
        .otherwise(F.coalesce(F.try_element_at(aliases, F.lower(text)), text))
    )


def class_family(c: Column | str) -> Column:
    return family(design_class(c))


def family(design: Column) -> Column:
    return F.regexp_replace(design, r"\s+[IO]/B$", "")


def is_rating_band(c: Column | str) -> Column:
    return F.coalesce(design_class(c).rlike(RATING_BAND), F.lit(False))


def class_score(c: Column | str) -> Column:
    """Sort key for the better spelling of a class: real designs before bands, then the longer text."""
    return design_score(design_class(c))


def design_score(design: Column) -> Column:
    return F.struct(
        F.when(design.isNull() | design.rlike(RATING_BAND), 0).otherwise(1).alias("design"),
        F.coalesce(F.length(design), F.lit(0)).alias("length"),
    )


def name_score(c: Column | str) -> Column:
    """Sort key for the better spelling of a name."""
    return spelling_score(collapse(c))


def spelling_score(tidy: Column) -> Column:
    points = (
        tidy.rlike("[a-z]").cast("int") + F.contains(tidy, F.lit(" ")).cast("int") + (~tidy.rlike(r"[?*]")).cast("int")
    )
    return F.struct(F.when(tidy == "", 0).otherwise(points).alias("points"), F.length(tidy).alias("length"))


def is_synthetic(c: Column | str) -> Column:
    """A name made up from an identifier because no name was given."""
    return collapse(c).rlike(r"(?i)^(Sail|Bow)\s+\S+$")


def display_name(name: Column | str, sail: Column | str, bow: Column | str) -> Column:
    """The name, or one made up from an identifier."""
    n, s, b = (blank_to_null(as_col(x)) for x in (name, sail, bow))
    return F.coalesce(n, F.concat(F.lit("Sail "), s), F.concat(F.lit("Bow "), b))


# Equipment words after a type, and makers of whose types only the maker counts.
EQUIPMENT = ("fr", "ib", "i/b", "ob", "o/b", "od", "turbo", "mod", "mod.")
MAKER_ONLY = ("beneteau",)
# Blanks and marks between a maker and a number that do not count: after J, inside C & C and behind it, after Farr.
LOOSE = r"(?<=^j)[ /-]+(?=\d)|(?<=c) (?=&)|(?<=&) (?=c)|(?<=&c|& c) +|(?<=farr) +"


def type_key(c: Column | str) -> Column:
    """Type of a boat for comparison across sources: its words without equipment, spelt without loose blanks."""
    words = F.split(F.lower(collapse(c)), " ")
    telling = F.filter(words, lambda w, i: (i == 0) | ~w.isin(*EQUIPMENT))
    first = F.element_at(words, 1)
    return F.when(first.isin(*MAKER_ONLY), first).otherwise(F.regexp_replace(F.array_join(telling, " "), LOOSE, ""))
