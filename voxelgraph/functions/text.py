"""Text rules as column expressions: numbers to tokens, durations, ranges, TeX; patterns in names; forbidden tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def general(x: Column) -> Column:
    """Six significant digits without trailing zeros, for numbers from 1e-4 to a million."""
    scale = F.pow(F.lit(10.0), 5 - F.floor(F.log10(F.abs(x))))
    own = F.round(x * scale) / scale
    return F.when(x == 0, "0").otherwise(F.regexp_replace(own.cast("decimal(20,10)").cast("string"), r"\.?0+$", ""))


def token_of_number(x: Column) -> Column:
    return F.replace(F.replace(general(x), F.lit("-"), F.lit("m")), F.lit("."), F.lit("p"))


def token_of_text(x: Column) -> Column:
    """Every character but letters and digits as _; blank if nothing is left."""
    own = F.regexp_replace(F.trim(x), r"[^\p{L}\p{N}]", "_")
    return F.when(own == "", "blank").otherwise(own)


def values(x: Column) -> Column:
    """The parts of a comma list, without blanks and empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda v: F.trim(v)), lambda v: v != "")


def triple(x: Column) -> Column:
    """Whole numbers z, y, x of a text like (2, 4, 4)."""
    own = F.transform(values(F.regexp_replace(x, r"[()\[\]]", "")), lambda v: v.try_cast("int"))
    return F.struct(*(F.get(own, i).alias(c) for i, c in enumerate("zyx")))


def stride_of(x: Column) -> Column:
    """Strides of a name like stride_4x2x3_half; null without one."""
    parts = [F.regexp_extract(x, r"stride_(\d+)x(\d+)x(\d+)_half", k).try_cast("int") for k in (1, 2, 3)]
    return F.when(parts[0].isNotNull(), F.array(*parts))


def protocol_radius(x: Column, delta: float = 1.0) -> Column:
    """max(0, half the least stride - delta)."""
    return F.greatest(F.lit(0.0), F.array_min(stride_of(x)) * 0.5 - delta)


def duration(seconds: Column) -> Column:
    """1h02m03s, 2m03s or 3s; ? for what is no duration."""
    total = F.rint(seconds).cast("bigint")
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    own = F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, s)).when(m > 0, F.format_string("%dm%02ds", m, s)).otherwise(F.format_string("%ds", s))
    return F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0), "?").otherwise(own)


def scientific(x: Column) -> Column:
    return F.replace(F.replace(F.format_string("%.2e", x), F.lit("e-0"), F.lit("e-")), F.lit("e+0"), F.lit("e+"))


def compact(x: Column, digits: int = 3) -> Column:
    """Scientific from a thousand on and below a thousandth, else `digits` significant digits."""
    own = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when((F.abs(x) >= 1000) | ((F.abs(x) < 1e-3) & (x != 0)), F.format_string("%.2e", x)).otherwise(general(F.when(x == 0, x).otherwise(F.round(x * own) / own)))


def span(low: Column, high: Column) -> Column:
    return F.concat(F.rint(low).cast("bigint").cast("string"), F.lit("--"), F.rint(high).cast("bigint").cast("string"))


def grid_text(shape: Column) -> Column:
    return F.concat(F.lit("$"), F.replace(shape, F.lit("x"), F.lit("\\times")), F.lit("$"))


def tex(x: Column) -> Column:
    return F.regexp_replace(x, r"([_&%#])", r"\\$1")


def found_tokens(x: Column, tokens: list[str]) -> Column:
    """Which of the tokens stand in a text, in the order of the list."""
    return F.filter(F.array(*(F.lit(t) for t in tokens)), lambda t: F.contains(x, t))


def patched(x: Column, rules: list[tuple[str, str]]) -> Column:
    """Regular expressions replaced one after the other."""
    return reduce(lambda own, rule: F.regexp_replace(own, *rule), rules, x)
