"""Human-readable sizes, durations and numbers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = "KMGTPE"


def byte_unit(n: Column) -> Column:
    """0 below 1024, else the number of the unit of base 1024."""
    out = F.lit(0)
    for k in range(1, len(UNITS) + 1):
        out = F.when(n >= 1024**k, k).otherwise(out)
    return out


def byte_value(n: Column) -> Column:
    """The size in its unit, to two decimals."""
    return F.round(n / F.pow(F.lit(1024.0), byte_unit(n)), 2)


def human_bytes(n: Column, decimals: int = 2) -> Column:
    out = F.format_string("%d B", n.cast("long"))
    for k, u in enumerate(UNITS, 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.{decimals}f {u}B", n / float(1024**k))).otherwise(out)
    return out


def human_duration(ns: Column) -> Column:
    """ns, µs, ms, s to three decimals; minutes and hours in whole parts. Null for null."""
    s = ns.cast("double") / 1e9
    whole = F.floor(s)
    return (
        F.when(ns.isNull(), F.lit(None).cast("string"))
        .when(ns < 1000, F.format_string("%dns", ns))
        .when(ns < 1_000_000, F.format_string("%.3fµs", ns / 1e3))
        .when(ns < 1_000_000_000, F.format_string("%.3fms", F.floor(ns / 1000) / 1e3))
        .when(ns < 60_000_000_000, F.format_string("%.3fs", s))
        .when(ns < 3_600_000_000_000, F.format_string("%dm%ds", F.floor(whole / 60), whole % 60))
        .otherwise(F.format_string("%dh%dm%ds", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60))
    )


def short_duration(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return F.when(seconds < 60, F.format_string("%.1fs", seconds.cast("double"))).when(seconds < 3600, F.format_string("%dm %ds", F.floor(whole / 60), whole % 60)).otherwise(F.format_string("%dh %dm %ds", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60))


def with_commas(n: Column) -> Column:
    return F.format_number(n, 0)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole; 0 where whole is 0."""
    return F.when(whole == 0, 0.0).otherwise(100.0 * part / whole)


def reduction(original: Column, compressed: Column) -> Column:
    """Saved share in percent; 0 for an empty original."""
    return F.when(original == 0, 0.0).otherwise(100.0 * (1 - compressed / original))


def overhead(actual: Column, expected: Column) -> Column:
    """Excess over what was expected in percent; 0 where nothing was."""
    return F.when(expected == 0, 0.0).otherwise(100.0 * (actual - expected) / expected)


def percent_text(value: Column, decimals: int = 2) -> Column:
    return F.format_string(f"%.{decimals}f%%", value.cast("double"))


def rate_of(n: Column, ns: Column) -> Column:
    """``n`` in ``ns`` nanoseconds, as a rate; "0/s" if no time passed."""
    return F.when(ns <= 0, "0/s").otherwise(rate(n / (ns / 1e9)))


def rate(n: Column) -> Column:
    return F.when(n >= 1e6, F.format_string("%.2fM/s", n / 1e6)).when(n >= 1e3, F.format_string("%.2fK/s", n / 1e3)).otherwise(F.format_string("%.2f/s", n.cast("double")))


def wrapped(x: Column, width: int = 80) -> Column:
    """The text itself if it fits, else a line break after each piece of ``width`` characters."""
    return F.when(F.length(x) > width, F.regexp_replace(x, f"(?s)(.{{1,{width}}})", "$1\n")).otherwise(x)


def gigabytes(n: Column) -> Column:
    return n / float(1024**3)
