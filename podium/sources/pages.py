"""What a result page holds: headings, links, class and role, table rows, score cells and labelled fields."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from html import unescape
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium import schema
from podium.functions.text import as_col, blank_to_null, collapse, let
from podium.sources.files import file_name

C = F.col

# Codes in score cells, in the order they are looked for.
STATUS_CODES = ("DNS", "DNC", "DNF", "OCS", "DSQ", "RET", "DPI", "UFD", "BFD", "SCP", "RDG", "ZFP")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
TEMPLATE_PREFIXES = ("xxxxxxx",)
SHORT_BODY = 50
# Marks of file names that show a view of an event.
VARIANT_NAME = r"_overall\.htm|_ab\.htm|_all\.htm|-overall\.htm"


def plain_text(html: Column | str) -> Column:
    """Text without tags and comments, common entities decoded, white space collapsed."""
    out = F.regexp_replace(as_col(html), r"(?s)<!--.*?-->|<[^>]*>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse(out)


def element_text(html: Column | str, tag: str) -> Column:
    """Text of the first element of a kind, null when there is none."""
    return blank_to_null(plain_text(F.regexp_extract(as_col(html), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)))


def links(html: Column | str) -> Column:
    return F.regexp_extract_all(as_col(html), F.lit(r"""(?i)href\s*=\s*["']([^"']*)["']"""), F.lit(1))


def internal_link(href: Column, host: Column | str, root: Column | str = "/") -> Column:
    """A link that stays within the site section: no mail, fragment, foreign host, parent site or other year.

    The host of a full link is the page's host or below it. ``root`` is the section's path, which a path from the top
    must begin with; ``section_of`` gives it for a page.
    """
    own, there = F.lower(as_col(host)), F.lower(host_of(href))
    other_host = href.rlike("^[a-zA-Z]+://") & (there != own) & ~F.endswith(there, F.concat(F.lit("."), own))
    outside = F.startswith(href, F.lit("/")) & ~F.startswith(href, F.lit(root) if isinstance(root, str) else root)
    return ~(
        (href == "")
        | F.startswith(href, F.lit("mailto:"))
        | F.startswith(href, F.lit("#"))
        | other_host
        | F.startswith(href, F.lit("../../"))
        | href.rlike(r"^\.\./racing\d{4}/")
        | outside
    )


def link_target(href: Column) -> Column:
    return F.regexp_replace(href, r"[?#].*$", "")


def host_of(url: Column | str) -> Column:
    return F.regexp_extract(as_col(url), r"^[a-zA-Z]+://([^/:?#]+)", 1)


def section_of(url: Column | str) -> Column:
    """Path of the page's year, such as /results/2014/; of a page without one, the top."""
    year = F.regexp_extract(as_col(url), r"^[a-zA-Z]+://[^/?#]+(/(?:[^?#]*/)?[a-zA-Z]*(?:19|20)\d{2}/)", 1)
    return F.when(year == "", "/").otherwise(year)


#: First year of the pages of the present scoring program.
PRESENT_ERA = 2014
# Words of file names and of tables by which pages of the earlier years are told apart.
INDEX_NAME = "racing.htm"
GALLERY_NAMES = ("photo", "gallery", "index1")
RESULT_WORDS = ("elapsed", "corrected", "finish time", "pos.", "points")
NOTICE_NAMES = ("handicap", "instruction", "si")
NOTICE_WORDS = ("schedule", "notice of race")


def era(year: Column | str) -> Column:
    return F.when(as_col(year) >= PRESENT_ERA, "sailwave").otherwise("legacy")


def _any_of(text: Column, words: Sequence[str]) -> Column:
    """Any of the words occurs in the text, which is worked out once for all of them."""
    return let(text, lambda whole: reduce(or_, [F.contains(whole, F.lit(word)) for word in words]))


def _is_template(html: Column, name: Column) -> Column:
    """A placeholder by its name, or a page whose body says next to nothing."""
    body = plain_text(F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*)", 1))
    template = html.rlike(r"(?i)<body\b") & (F.length(body) < SHORT_BODY)
    for prefix in TEMPLATE_PREFIXES:
        template = template | F.startswith(name, F.lit(prefix))
    return template


def _has_table(html: Column, css: str) -> Column:
    return html.rlike(rf"""(?i)<table[^>]*class\s*=\s*["']?{css}""")


def page_rules(html: Column, path: Column | str) -> dict[str, list[tuple[str, Column]]]:
    """For either era, classes with the conditions under which they hold for a page without comments; the first that does counts."""
    name = F.lower(file_name(path))
    summary, race = _has_table(html, "summarytable"), _has_table(html, "racetable")
    marked = [("sailwave-mixed", summary & race), ("sailwave-summary", summary), ("sailwave-race", race)]
    words = F.lower(plain_text(html))
    titled = F.contains(F.lower(F.coalesce(element_text(html, "title"), F.lit(""))), F.lit("sailwave"))
    tables = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)(<table\b.*?</table>)"), F.lit(1)), " ")
    entry_list = let(words, lambda w: F.contains(w, F.lit("entry")) & F.contains(w, F.lit("list")))
    return {
        "sailwave": [("template", _is_template(html, name)), *marked, ("entry-list", entry_list), ("sailwave-summary", titled),
                     ("non-result-html", F.lit(True))],
        "legacy": [("legacy-index", name == INDEX_NAME), ("gallery", _any_of(name, GALLERY_NAMES)), *marked,
                   ("legacy-result", _any_of(F.lower(plain_text(tables)), RESULT_WORDS)),
                   ("non-result-html", _any_of(name, NOTICE_NAMES)), ("non-result-html", _any_of(words, NOTICE_WORDS)),
                   ("template", _is_template(html, name)), ("unknown", F.lit(True))],
    }


def _first_rule(rules: Sequence[tuple[str, Column]]) -> Column:
    return F.coalesce(*[F.when(holds, F.lit(name)) for name, holds in rules])


def page_class(html: Column | str, path: Column | str, year: Column | str | None = None) -> Column:
    """Class of a page by what it holds. With ``year`` the rules are those of its era, and a page without a year has no
    class; else they are those of the present era."""

    def found(plain: Column) -> Column:
        rules = page_rules(plain, path)
        present = _first_rule(rules["sailwave"])
        if year is None:
            return present
        return F.when(era(year) == "sailwave", present).otherwise(_first_rule(rules["legacy"]))

    # the comments are removed once, not for each rule
    kind = let(F.regexp_replace(as_col(html), r"(?s)<!--.*?-->", ""), found)
    return kind if year is None else F.when(as_col(year).isNotNull(), kind)


# Roles of the classes of the earlier years; pages of the others are canonical or unknown.
LEGACY_ROLES = {"legacy-index": "index", "gallery": "gallery", "template": "template", "unknown": "unknown", "non-result-html": "unknown"}


def page_role(path: Column | str, found: Column | str | None = None, year: Column | str | None = None) -> Column:
    """Role of a page by its file name and, for the earlier years, by its class."""
    name = F.lower(file_name(path))
    template = name.rlike("^(" + "|".join(TEMPLATE_PREFIXES) + ")")
    if found is None:
        return F.when(name.rlike(VARIANT_NAME), "variant").when(template, "template").otherwise("canonical")
    kind = as_col(found)
    roles = F.create_map(*[F.lit(x) for pair in LEGACY_ROLES.items() for x in pair])
    old = F.coalesce(F.try_element_at(roles, kind), F.lit("canonical"))
    return F.when(era(year) == "legacy", old).when(kind == "template", "template").otherwise(page_role(path))


# Classes of pages that hold results, and of those that are skipped.
RESULT_CLASSES = ("sailwave-mixed", "sailwave-summary", "sailwave-race", "legacy-result")
SKIPPED_CLASSES = ("template", "gallery", "legacy-index", "entry-list", "external-link", "document", "binary-asset")


def provenance(found: Column | str, loaded: Column | str) -> Column:
    """What became of a page: loaded, not loaded though it holds results, skipped, without results, or unclassified."""
    kind = as_col(found)
    return (
        F.when(as_col(loaded), "loaded")
        .when(kind.isNull() | (kind == "unknown"), "unclassified")
        .when(kind.isin(*RESULT_CLASSES), "result-not-loaded")
        .when(kind.isin(*SKIPPED_CLASSES), "skipped")
        .otherwise("non-result")
    )


# every tag that shapes a table; text between two of them belongs to the cell or caption that is open
_SHAPE = re.compile(r"<(/?)(table|caption|tr|td|th)\b([^>]*)>", re.IGNORECASE)
_COMMENT = re.compile(r"<!--.*?-->", re.DOTALL)
_TAG = re.compile(r"<[^>]*>")
_CSS = re.compile(r"""class\s*=\s*["']?([^"'>]*)""", re.IGNORECASE)
_LABEL = re.compile(r"""bgcolor\s*=\s*["']?#008080""", re.IGNORECASE)


def _text(raw: str) -> str:
    if "<" in raw:
        raw = _TAG.sub("", raw)
    if "&" in raw:
        raw = unescape(raw)
    return " ".join(raw.split())


def page_tables(html: str) -> list[tuple]:
    """(table_no, kind, caption, row_no, header, cells, labels) of every row of every table, nested ones included.

    End tags may be missing: a new cell closes the open cell, a new row the open row.
    """
    found: list[tuple] = []
    outer: list[dict] = []
    t: dict | None = None
    tables = 0

    def end_row(t: dict) -> None:
        cells, heads = t["cells"], t["heads"]
        if not cells:
            return
        cells = [_text(c) for c in cells]
        if heads and t["header"] is None:
            t["header"] = [c.lower() for c in cells]
            t["kind"] = _kind(t["css"], t["header"])
        else:
            found.append((t["no"], t["kind"], t["caption"], t["rows"], t["header"] or [], cells, t["labels"]))
            t["rows"] += 1
        t["cells"], t["labels"], t["heads"] = [], [], False

    if "<!--" in html:
        html = _COMMENT.sub("", html)
    parts = _SHAPE.split(html)
    # text, then (slash, tag, attributes, text) for each tag
    for i in range(1, len(parts), 4):
        closing, tag, attrs, text = parts[i], parts[i + 1].lower(), parts[i + 2], parts[i + 3]
        if tag == "td" or tag == "th":
            if t is None:
                continue
            if not closing:
                t["cells"].append(text)
                t["heads"] = t["heads"] or tag == "th"
                t["labels"].append("008080" in attrs and bool(_LABEL.search(attrs)))
        elif tag == "tr":
            if t is not None:
                end_row(t)
        elif tag == "table":
            if closing:
                if t is not None:
                    end_row(t)
                    t = outer.pop()
                    if t is not None and t["cells"]:
                        t["cells"][-1] += text
                continue
            css = _CSS.search(attrs)
            css = css.group(1).lower() if css else ""
            outer.append(t)
            t = {"no": tables, "css": css, "kind": _kind(css, []), "caption": "", "header": None, "rows": 0, "cells": [],
                 "labels": [], "heads": False}
            tables += 1
        elif t is not None and not closing:
            t["caption"] = _text(text)
    while t is not None:
        end_row(t)
        t = outer.pop()
    return found


def _kind(css: str, header: Sequence[str]) -> str:
    if "summarytable" in css:
        return "summary"
    if "racetable" in css:
        return "race"
    if any(h in ("elapsed", "corrected", "finish") for h in header):
        return "race"
    return "summary" if any(h in ("nett", "net", "total") for h in header) else "other"


def table_rows(pages: DataFrame) -> DataFrame:
    """One row per table row of every page (page_id, html); the header of the table goes with each of its rows."""

    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        texts, flags = pa.list_(pa.string()), pa.list_(pa.bool_())
        types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), texts, texts, flags]
        names = ["page_id", "table_no", "kind", "caption", "row_no", "header", "cells", "labels"]
        for batch in batches:
            rows = [
                (page_id, *row)
                for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for row in page_tables(html or "")
            ]
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return pages.select(C("page_id").cast("long"), "html").mapInArrow(parse, schema.TABLE_ROW)


# Headings by the column they name; exact words, and words that may stand anywhere in the heading.
HEADINGS = {
    "fleet": ("fleet",),
    "division": ("division", "div"),
    "boat": ("boat", "boat name", "yacht", "yachtname", "name"),
    "class": ("class", "model", "type"),
    "sail_number": ("sailno", "sail number", "sail no", "sail #", "sail#"),
    "club": ("club",),
    "total": ("total",),
    "nett": ("nett", "net"),
    "gender": ("m/f",),
    "start": ("start",),
    "finish": ("finish",),
    "elapsed": ("elapsed",),
    "corrected": ("corrected",),
    "bcr": ("bcr",),
    "points": ("points", "pts"),
}
HEADING_PARTS = {"helm": "boat", "bow": "bow_number", "phrf": "phrf", "rating": "phrf", "handicap": "phrf"}


def canonical_heading(h: Column) -> Column:
    known = F.create_map(*[F.lit(x) for name, words in HEADINGS.items() for w in words for x in (w, name)])
    out = F.when(F.contains(h, F.lit("rank")) | (h == "pos"), F.lit("rank"))
    exact = F.try_element_at(known, h)
    parts = [F.when(F.contains(h, F.lit(part)), F.lit(name)) for part, name in HEADING_PARTS.items()]
    return F.coalesce(out, exact, *parts)


def named_cells(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Cells under their canonical column names; the last heading of a kind counts, a missing cell is null."""
    mapped = rows.withColumn("_h", F.transform("header", canonical_heading))

    def cell(name: str) -> Column:
        back = F.array_position(F.reverse("_h"), name)
        return F.when(back > 0, F.get(C("cells"), (F.size("_h") - back).cast("int")))

    return mapped.withColumns({name: blank_to_null(cell(name)) for name in names}).drop("_h")


# Columns of the fixed layout, by position.
FIXED_LAYOUT = (
    "boat_name", "sail_number", "boat_class", "rating", "race_date", "finish_time", "penalty", "elapsed_time",
    "corrected_time", "position", "points", "espn", "series_points", "series_position",
)


def positional_cells(rows: DataFrame) -> DataFrame:
    """Rows of the fixed layout by position; short rows give nulls, rows without a name are dropped."""
    named = rows.withColumns({name: F.get(C("cells"), F.lit(i)) for i, name in enumerate(FIXED_LAYOUT)})
    return named.where(F.coalesce("boat_name", F.lit("")) != "").withColumns(
        {
            "position": C("position").try_cast("int"),
            "points": C("points").try_cast("double"),
            "series_points": C("series_points").try_cast("double"),
            "series_position": C("series_position").try_cast("int"),
            "status": status_code(F.concat_ws(" ", C("cells"))),
        }
    )


def labelled_values(rows: DataFrame) -> DataFrame:
    """Label cells with the value of the cell after them."""
    cell = F.posexplode("cells").alias("pos", "label")
    at = rows.select("page_id", "table_no", "row_no", "cells", "labels", cell)
    return at.where(F.get(C("labels"), C("pos"))).select(
        "page_id", "table_no", "row_no", F.lower("label").alias("label"), F.get(C("cells"), C("pos") + 1).alias("value")
    )


def participant_type(header: Column | str) -> Column:
    helm = F.exists(as_col(header), lambda h: F.contains(F.lower(h), F.lit("helm")))
    return F.when(helm, "helm").otherwise("boat")


def caption_metadata(caption: Column | str) -> Column:
    """'Sailed: 4, Discards: 1' as a map with lower-case keys."""
    pairs = F.filter(F.split(F.coalesce(as_col(caption), F.lit("")), ","), lambda p: F.contains(p, F.lit(":")))

    def entry(p: Column) -> Column:
        key = F.replace(F.lower(F.trim(F.substring_index(p, ":", 1))), F.lit(" "), F.lit("_"))
        value = F.trim(F.substr(p, F.instr(p, F.lit(":")) + 1))
        return F.struct(key, value)

    return F.map_from_entries(F.transform(pairs, entry))


def status_code(raw: Column | str) -> Column:
    # a column inside a lambda is worked out each time it is named, so the text is made once for all codes
    return let(F.upper(as_col(raw)), lambda caps: F.coalesce(*[F.when(F.contains(caps, F.lit(code)), F.lit(code)) for code in STATUS_CODES]))


def score_cell(raw: Column | str) -> Column:
    """struct(points, status, is_discarded) of a cell such as '(5.0 DNC)'."""

    def read(text: Column) -> Column:
        dropped = F.startswith(text, F.lit("(")) & F.endswith(text, F.lit(")"))
        inner = F.when(dropped, F.regexp_replace(text, r"^\(|\)$", "")).otherwise(text)
        return let(inner, lambda x: F.struct(
            F.regexp_extract(x, r"([\d.]+)", 1).try_cast("double").alias("points"), status_code(x).alias("status"), dropped.alias("is_discarded")
        ))

    return let(F.trim(F.translate(F.coalesce(as_col(raw), F.lit("")), "\u00a0", " ")), read)


def scope_key(title: Column | str, section: Column | str) -> Column:
    """Key of a summary section: overall, a fleet, a division, or its own name."""
    raw = F.lower(F.trim(F.coalesce(blank_to_null(as_col(title)), as_col(section), F.lit(""))))
    slugged = F.btrim(F.regexp_replace(raw, "[^a-z0-9]+", "_"), F.lit("_"))
    # How fleets and divisions are written.
    return (
        F.when((raw == "") | F.contains(raw, F.lit("overall")), "overall")
        .when(raw.isin("a fleet", "a", "fleet a"), "a_fleet")
        .when(raw.isin("b fleet", "b", "fleet b"), "b_fleet")
        .when(raw.isin("s fleet", "s", "fleet s", "sonar"), "s_fleet")
        .when(raw.isin("p division", "p", "division p"), "p_division")
        .when(raw.isin("s division", "division s"), "s_division")
        .otherwise(F.when(slugged == "", "overall").otherwise(slugged))
    )


def fill_dates(races: DataFrame, columns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Race dates, the missing ones taken from the first summary column with the same race key that has one."""
    known = columns.where("race_date IS NOT NULL").groupBy(*keys).agg(F.min(F.struct("position", "race_date")).alias("k"))
    filled = races.join(known, list(keys), "left")
    return filled.withColumn("race_date", F.coalesce("race_date", "k.race_date")).drop("k")


# Patterns of boat types, the more specific ones first.
TYPE_PATTERNS = (
    r"(?:J[/-]?\s*\d+\S*)", r"(?:Farr\s+\d+\S*)", r"(?:C&C\s+\d+\S*)", r"(?:Sonar)", r"(?:IOD)", r"(?:Bluenose\s*\S*)",
    r"(?:Melges\s+\d+)", r"(?:1D35|ID35)", r"(?:Etchell\S*)", r"(?:Laser\s*\d*)", r"(?:11m\s+OD)", r"(?:Beneteau\s+\S+)",
    r"(?:Tripp\s+\d+)", r"(?:CM\s+\d+)", r"(?:Dash\s+\d+\S*)", r"(?:S2\s+\S+)", r"(?:Kirby\s+\d+)", r"(?:Santana\s+\d+)",
    r"(?:Viking\s+\d+)", r"(?:Hunter\s+\S+)", r"(?:Newport\s+\d+\S*)", r"(?:Moorings\s+\d+)", r"(?:Frers\s+\d+)",
    r"(?:CS\s*\d+)", r"(?:Taylor\s+\d+)", r"(?:Soto\s+\d+)", r"(?:S&S\s+\d+)", r"(?:Morgan\s+\d+)", r"(?:Roue\s+\d+)",
    r"(?:Folkboat)", r"(?:P\s+Class)", r"(?:B\s+36\.\d)", r"(?:Universal\s+Q)", r"(?:R-Boat)", r"(?:Classic)",
    r"(?:Custom)",
)


def split_name_and_type(c: Column | str) -> Column:
    """struct(name, type) split at the first pattern found; all of it is the name when none is."""
    text = as_col(c)
    whole = [rf"^(.*?\S.*?)\s({p}(?:\s.*)?)\s*$" for p in TYPE_PATTERNS]
    hit = F.coalesce(*[F.when(text.rlike(p), F.lit(i)) for i, p in enumerate(whole)])
    pattern = F.get(F.array(*[F.lit(p) for p in whole]), hit)
    name = F.when(hit.isNull(), text).otherwise(F.trim(F.regexp_extract_all(text, pattern, F.lit(1))[0]))
    kind = F.when(hit.isNull(), "").otherwise(F.trim(F.regexp_extract_all(text, pattern, F.lit(2))[0]))
    return F.struct(name.alias("name"), kind.alias("type"))


# Labels of certificate fields; the first pattern that matches counts. IN_LINES are those that read the
# text with its line ends, the others read it with single blanks.
IN_LINES = (r"Name\s+([^\n]+?)\s+Sail Nr", r"Sail Nr\s+([A-Z0-9/-]+)", r"([\d.]+)\s+GPH\b")
CERTIFICATE_FIELDS = {
    "name": (r"Name\s+([^\n]+?)\s+Sail Nr", r"Boat\s+([A-Z][A-Za-z0-9 .'-]*?)\s+[A-Z]{3}-?\d"),
    "sail_no": (r"Sail Nr\s+([A-Z0-9/-]+)", r"Boat\s+[A-Z][A-Za-z0-9 .'-]*?\s+([A-Z]{3}-?\d+)"),
    "boat_class": (r"Class\s+(.+?)\s+(?:Designer|ONE DESIGN)",),
    "designer": (r"Designer\s+([^\n]+?)\s+Builder",),
    "builder": (r"Builder\s+([^\n]+?)\s+(?:Series|Age)",),
    "age_date": (r"Age [Dd]ate\s+([\d/]+)",),
    "issued_on": (r"Issued [Oo]n\s+([\d/]+)",),
    "valid_until": (r"Valid until\s+([\d/]+)",),
}
CERTIFICATE_NUMBERS = {
    "loa_m": (r"Length Overall\s+([\d.]+)\s*m", r"\bLOA\s+([\d.]+)\s*m"),
    "beam_m": (r"Maximum Beam\s+([\d.]+)\s*m", r"\bMB\s+([\d.]+)\s*m"),
    "draft_m": (r"Draft\s+([\d.]+)\s*m",),
    "gph": (r"General Purpose Handicap \(GPH\)\s+([\d.]+)", r"\bGPH\s*[=:]\s*([\d.]+)", r"([\d.]+)\s+GPH\b"),
    "aph": (r"\bAPH\s*[=:]\s*([\d.]+)",),
    "cdl": (r"\bCDL\s*[=:]\s*([\d.]+)",),
    "displacement_kg": (r"Displacement\s+([\d,]+)\s*kg",),
}


def named_fields(
    c: Column | str,
    texts: Mapping[str, Sequence[str]] = CERTIFICATE_FIELDS,
    numbers: Mapping[str, Sequence[str]] = CERTIFICATE_NUMBERS,
) -> list[Column]:
    """One column per labelled field of a free text, null when no pattern finds it."""
    lines, text = as_col(c), collapse(c)

    def find(patterns: Sequence[str]) -> Column:
        return F.coalesce(*[blank_to_null(F.trim(F.regexp_extract(lines if p in IN_LINES else text, p, 1))) for p in patterns])

    out = [find(p).alias(name) for name, p in texts.items()]
    out += [F.replace(find(p), F.lit(","), F.lit("")).try_cast("double").alias(name) for name, p in numbers.items()]
    return out
