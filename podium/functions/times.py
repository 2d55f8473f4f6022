"""Dates, months, start hours and durations as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from podium.functions.text import as_col, blank_to_null, let

LAST_YEAR = 2025  # fixed value: two-digit years past it belong to the century before
DEFAULT_HOUR = 18  # fixed value: start hour assumed when none was recorded

MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
    "december",
)
# Short month marks and season words in file names.
MONTH_MARKS = (
    ("jan_", "january"), ("feb_", "february"), ("mar_", "march"), ("apr_", "april"), ("jun_", "june"),
    ("jul_", "july"), ("aug_", "august"), ("sep_", "september"), ("sept_", "september"), ("oct_", "october"),
    ("nov_", "november"), ("dec_", "december"), ("_fall", "september"), ("fall_", "september"),
)


def _valid(year: Column, month: Column, day: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return month.between(1, 12) & (day >= 1) & (day <= last)


def _padded(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _iso(year: Column, month: Column, day: Column) -> Column:
    """ISO text of a date, null when there is no such day."""
    return F.when(_valid(year, month, day), F.concat_ws("-", _padded(year, 4), _padded(month, 2), _padded(day, 2)))


def iso_date(raw: Column | str, event_year: Column) -> Column:
    """ISO text of a date typed in one of eight layouts.

    The first layout whose year agrees with the event wins; failing that the first readable layout with the year
    of the event; failing that day-first as typed.
    """
    text = F.trim(as_col(raw))
    parts = r"^(\d{1,2})([/-])(\d{1,2})[/-](\d{2}|\d{4})$"
    pieces = F.when(
        text.rlike(r"^\d+/\d+/\d+$|^\d+-\d+-\d+$") & text.rlike(parts),
        F.struct(*[F.regexp_extract(text, parts, i + 1).alias(n) for i, n in enumerate(("a", "sep", "b", "c"))]),
    )

    def year(x: Column) -> Column:
        n = x.cast("int")
        short = F.when(n > LAST_YEAR - 2000, n + 1900).otherwise(n + 2000)
        return F.when(F.length(x) == 2, short).when(n > LAST_YEAR, n - 100).otherwise(n)

    def readings(p: Column) -> Column:
        """(year, month, day) of each layout that fits, in the order they are tried."""
        a, b, c, slash, dash = p["a"], p["b"], p["c"], p["sep"] == "/", p["sep"] == "-"
        two = F.length(c) == 2

        def reading(fits: Column, y: Column, m: Column, d: Column, day_first: bool = False) -> Column:
            parsed = F.struct(
                year(y).alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"), F.lit(day_first).alias("df")
            )
            return F.when(fits, parsed)

        layouts = F.array(
            reading(slash | dash, c, b, a, day_first=True),
            reading(dash & two & (F.length(a) == 2), a, b, c),
            reading(slash | (dash & two), c, a, b),
        )
        return F.filter(layouts, lambda r: r.isNotNull() & _valid(r["y"], r["m"], r["d"]))

    def choose(found: Column) -> Column:
        agreeing = F.filter(found, lambda r: event_year.isNull() | (r["y"] == event_year))
        right = F.get(agreeing, F.lit(0))
        forced = F.transform(found, lambda r: _iso(event_year, r["m"], r["d"]))
        typed = F.get(F.filter(found, lambda r: r["df"]), F.lit(0))
        return F.coalesce(
            _iso(right["y"], right["m"], right["d"]),
            F.get(F.array_compact(forced), F.lit(0)),
            _iso(typed["y"], typed["m"], typed["d"]),
        )

    return let(pieces, lambda p: let(readings(p), choose))


def duration_s(raw: Column | str) -> Column:
    """Seconds of 'H:MM:SS' or 'MM:SS', a leading '00 ' day count dropped; null when unreadable."""
    text = F.regexp_replace(F.trim(as_col(raw)), r"^00\s+", "")
    parts = F.transform(F.split(text, ":"), lambda x: F.trim(x).try_cast("int"))
    p = [F.get(parts, F.lit(i)) for i in range(3)]
    n = F.size(parts)
    return F.when(n == 3, p[0] * 3600 + p[1] * 60 + p[2]).when(n == 2, p[0] * 60 + p[1])


def clock(seconds: Column | str, *, rounded: bool = False) -> Column:
    """'H:MM:SS' of a number of seconds, cut to whole seconds or rounded to the nearest."""
    s = as_col(seconds)
    whole = (F.round(s) if rounded else F.floor(s)).cast("long")
    div = lambda x, y: F.call_function("div", x, F.lit(y))
    parts = [div(whole, 3600).cast("string"), _padded(div(whole % 3600, 60), 2), _padded(whole % 60, 2)]
    return F.when(s.isNotNull(), F.concat_ws(":", *parts))


def month_name(*texts: Column | str, footer: Column | str | None = None, date: Column | None = None) -> Column:
    """Month named in the texts, else in the footer date, else of the date itself."""
    text = F.lower(F.concat_ws(" ", *[as_col(t) for t in texts]))
    tries = [F.when(F.contains(text, F.lit(m)), F.lit(m)) for m in MONTHS]
    tries += [F.when(F.contains(text, F.lit(mark)), F.lit(m)) for mark, m in MONTH_MARKS]
    if footer is not None:
        foot = F.lower(as_col(footer))
        tries += [F.when(F.contains(foot, F.lit(m[:3])), F.lit(m)) for m in MONTHS]
    if date is not None:
        tries.append(F.lower(F.date_format(date, "MMMM")))
    return F.coalesce(*tries)


def month_number(c: Column | str) -> Column:
    """Calendar position of a month name, 99 when unknown."""
    table = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)])
    return F.coalesce(F.try_element_at(table, F.lower(as_col(c))), F.lit(99))


def start_time(caption: Column | str) -> Column:
    return blank_to_null(F.regexp_extract(as_col(caption), r"Time:\s*(\d{1,2}:\d{2}:\d{2})", 1))


def start_hour(raw: Column | str) -> Column:
    hour = F.regexp_extract(as_col(raw), r"^\s*(\d{1,2}):", 1).try_cast("int")
    return F.when(hour.between(0, 23), hour).otherwise(DEFAULT_HOUR)


def first_number(c: Column | str) -> Column:
    """First run of digits as a number: '1st' -> 1."""
    return F.regexp_extract(as_col(c), r"(\d+)", 1).try_cast("int")


def to_local(ts: Column | str, hours_behind: int = 3) -> Column:
    """Local clock time of a UTC time stamp, for a fixed offset."""
    return as_col(ts) - F.expr(f"INTERVAL {hours_behind} HOURS")
