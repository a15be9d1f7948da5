"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPECIAL = r"(?i)^\s*[-+]?(inf|infinity|nan)\s*$"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside one row expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is evaluated exactly once per row.

    The optimizer copies the expression of a plain column into every later filter and
    projection that names it, which multiplies heavy row expressions.  A one-element
    ``explode`` is a step it does not copy across.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def parse_double(text: Column) -> Column:
    """Text to double, NULL where the text is no number (Java suffixes such as ``1d`` are none)."""
    plain = ~text.rlike("[dDfFxXpP]")
    return F.when(plain | text.rlike(_SPECIAL), text.try_cast("double"))


def six_decimals(x: Column) -> Column:
    """A non-negative double as text with six decimals, rounded by its exact binary value,
    halves to even.

    ``format_string`` rounds the shortest decimal form half up, which differs where that
    form ends in a 5 at the seventh place.  Here the double is split into two halves whose
    products with 15625 are exact, so its distance to the nearest half step has the right sign.
    """

    wide = x * 134217729.0
    hi = wide - (wide - x)
    lo = x - hi
    below = F.floor(x * 1000000.0)
    half = (2 * below + 1).cast("double") / 128.0  # half step times 15625, exactly
    side = (hi * 15625.0 - half) + lo * 15625.0
    n = below + F.when(side > 0, 1).when(side < 0, 0).otherwise(F.pmod(below, F.lit(2)))
    whole, rest = trunc_div(n, 1000000), n % 1000000
    return F.concat(whole.cast("string"), F.lit("."), F.lpad(rest.cast("string"), 6, "0"))


def floor_div(num: Column, den: int) -> Column:
    """Integer division of longs rounding down, also for negative numerators."""
    den_col = F.lit(den).cast("bigint")
    return F.call_function("div", num - F.pmod(num, den_col), den_col)


def trunc_div(num: Column, den: Column | int) -> Column:
    """Integer division of longs truncating toward zero."""
    den = F.lit(den) if isinstance(den, int) else den
    return F.call_function("div", num, den)
