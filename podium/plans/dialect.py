"""Snippets of oracle SQL used by several queries."""

from __future__ import annotations


def rx(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def collapse(x: str) -> str:
    return f"trim({rx(f'coalesce({x}, {chr(39)}{chr(39)})', chr(92) + 's+', ' ')})"


def name_key(x: str) -> str:
    return rx(f"replace(lower({collapse(x)}), '&', 'and')", "[^a-z0-9]")


def ident(x: str) -> str:
    return f"nullif({rx(f'replace(upper({collapse(x)}), {chr(39)} {chr(39)}, {chr(39)}{chr(39)})', '^#')}, '')"


def placeholder(x: str) -> str:
    i = ident(x)
    return (
        f"({i} IS NULL OR {i} IN ('0','000','999','9999','1111111') OR contains({i}, '?') "
        f"OR regexp_full_match({i}, 'X+') OR regexp_full_match({i}, 'X+[0-9]*X*'))"
    )


def strong(x: str) -> str:
    i = ident(x)
    return f"(NOT {placeholder(x)} AND regexp_matches({i}, '[0-9]') AND length({i}) >= 4)"


def design_class(x: str) -> str:
    text = rx(collapse(x), r"\s*(\?{2,}|\*{2,}|#{2,})\s*$")
    caps = f"upper({text})"
    return f"""CASE WHEN {text} = '' THEN NULL
        WHEN regexp_full_match({caps}, '[A-D]\\d+/\\d+[A-Z]?') THEN {caps}
        WHEN regexp_full_match({caps}, 'J/?\\d+ I/?B') THEN 'J/' || regexp_extract({caps}, '\\d+') || ' I/B'
        WHEN regexp_full_match({caps}, 'J/?\\d+ O/?B') THEN 'J/' || regexp_extract({caps}, '\\d+') || ' O/B'
        WHEN regexp_full_match({caps}, 'J/?\\d+') THEN 'J/' || regexp_extract({caps}, '\\d+')
        WHEN {caps} LIKE 'J/%' THEN {caps}
        WHEN regexp_matches({caps}, '^C\\s*&\\s*C\\s*\\d') THEN 'C&C ' || regexp_replace({text}, '(?i)^C\\s*&\\s*C\\s*', '')
        WHEN lower({text}) = 'e22' THEN 'Etchells' WHEN lower({text}) = 'far 30' THEN 'Farr 30' ELSE {text} END"""


def family(x: str) -> str:
    return f"regexp_replace({design_class(x)}, ' [IO]/B$', '')"


def is_band(x: str) -> str:
    return f"coalesce(regexp_full_match({design_class(x)}, '[A-D]\\d+/\\d+[A-Z]?'), false)"


def class_score(x: str) -> str:
    """Design flag and length folded into one number."""
    return f"(CASE WHEN {is_band(x)} THEN 0 ELSE 1000 END + length({design_class(x)}))"


def name_score(x: str) -> str:
    c = collapse(x)
    return (
        f"(1000 * (CAST(regexp_matches({c}, '[a-z]') AS INT) + CAST(contains({c}, ' ') AS INT) "
        f"+ CAST(NOT regexp_matches({c}, '[?*]') AS INT)) + length({c}))"
    )


def stem(x: str) -> str:
    return f"lower(replace(regexp_replace(regexp_extract({x}, '[^/]*$'), '\\.[^.]*$', ''), '-', '_'))"


def canonical_stem(x: str) -> str:
    s = stem(x)
    cut = f"regexp_replace({s}, '(_*(overall|summary|seriesab|series)|_+(all|ab))+$', '')"
    return f"CASE WHEN {cut} IN ('all', 'ab') THEN '' ELSE rtrim({cut}, '_') END"


def canonical_name(x: str) -> str:
    words = r"(?i)\s+(A\s*&\s*B\s*&\s*S|A,B\s*&\s*S|AB\s*&\s*S|A\s*&\s*B|A,B|AB|All|Overall|Summary)\b"
    return f"trim({collapse(rx(collapse(x), words))}, ' -')"


def clean_title(x: str) -> str:
    out = rx(collapse(x), r"\s*(\?\?+|##+)\s*", " ")
    out = rx(out, r"\s+([,.;:])", r"\1")
    return f"trim({rx(out, chr(92) + 's{2,}', ' ')}, ' -')"


def view_name(x: str) -> str:
    return f"regexp_matches(lower({collapse(x)}), '\\boverall\\b|\\bsummary\\b|\\ba\\s*&\\s*b\\b|\\ba,b\\b|\\ball\\b')"


def slug(x: str) -> str:
    return f"trim({rx(f'lower({collapse(x)})', '[^a-z0-9]+', '-')}, '-')"


def pct(num: str, den: str, digits: int = 1) -> str:
    """num / den rounded half-up at ``digits`` in whole numbers."""
    s = 10**digits
    return (
        f"CASE WHEN ({den}) <> 0 THEN CAST((CAST({2 * s} AS HUGEINT) * ({num}) + ({den})) // (2 * ({den})) AS DOUBLE) "
        f"/ {s}e0 END"
    )


def n(expr: str = "*", cond: str | None = None) -> str:
    tail = f" FILTER (WHERE {cond})" if cond else ""
    return f"CAST(count({expr}){tail} AS BIGINT)"
