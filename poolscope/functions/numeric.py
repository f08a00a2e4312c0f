"""Column arithmetic whose results must not depend on Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS = 1_000_000_000


def ieee_div(a: Column, b: Column) -> Column:
    """Floating division where a zero divisor gives infinity or NaN instead of an error."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def nine_places(x: Column) -> Column:
    """A non-negative double below 10^9, rounded to nine places, as text: plain down to 0.0001, and like 1.2e-05 below."""
    n = F.round(x * 10**9).cast("long")
    units, rest = F.call_function("div", n, F.lit(10**9)).cast("string"), F.lpad((n % 10**9).cast("string"), 9, "0")
    digits = F.regexp_replace(rest, "0+$", "")
    plain = F.concat(units, F.lit("."), F.when(digits == "", "0").otherwise(digits))
    first = F.length(F.regexp_extract(rest, "^0*", 0)) + 1  # place of the first digit that isn't 0
    more = F.substring(digits, first + 1, F.lit(9))
    short = F.concat(F.substring(digits, first, F.lit(1)), F.when(more == "", "").otherwise(F.concat(F.lit("."), more)), F.lit("e-0"), first.cast("string"))
    return F.when((n > 0) & (n < 10**5), short).otherwise(plain)


def rint_long(x: Column) -> Column:
    """double to long, half to even."""
    return F.rint(x).cast("long")


def half_up_long(x: Column) -> Column:
    """double to long: add a half, then truncate."""
    return (x + F.lit(0.5)).cast("long")


def int_div(a: Column, b: Column | int) -> Column:
    """Integer division of longs that truncates toward zero."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a, b)


def ts_nano(t: Column) -> Column:
    """Timestamp to nanoseconds since 1970."""
    return F.unix_micros(t.cast("timestamp")) * 1000


def nano_ts(t: Column) -> Column:
    """Nanoseconds since 1970 to timestamp, in whole microseconds."""
    return F.timestamp_micros(int_div(t, 1000))


def exact_sum(x: Column) -> Column:
    """Sum of longs that cannot overflow midway; an error only if the total leaves 64 bits."""
    return F.sum(x.cast("decimal(38,0)")).cast("long")


def number_text(x: Column) -> Column:
    """Shortest round-trip decimal text without exponent, as the API writes doubles; NaN and infinities by name."""
    plain = F.regexp_replace(F.format_string("%s", x.cast("decimal(38,18)").cast("string")), r"\.?0+$", "")
    odd = F.isnan(x) | (F.abs(x) == float("inf")) | (F.abs(x) >= 1e19)
    return F.when(odd, F.regexp_replace(x.cast("string"), "Infinity", "Inf")).otherwise(plain)
