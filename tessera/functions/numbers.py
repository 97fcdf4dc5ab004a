"""Numbers: money, rounding, safe parsing and statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Name = str | Column


def col(c: Name) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Name) -> Column:
    """Exact cents: sums of doubles depend on the order of rows, sums of decimals don't."""
    return F.round(col(c).cast("decimal(18,4)"), 2).cast("decimal(18,2)")


def half_up(c: Name, digits: int) -> Column:
    """Rounded half away from zero on a decimal, so that every engine agrees."""
    return F.round(col(c).cast("decimal(38,10)"), digits).cast(f"decimal(28,{digits})")


def ratio(a: Name, b: Name, scale: float = 1.0) -> Column:
    """scale * a / b as a double; null where b is 0."""
    return F.lit(scale) * col(a).cast("double") / F.nullif(col(b).cast("double"), F.lit(0.0))


def parse_decimal(c: Name, precision: int = 18, scale: int = 4) -> Column:
    """Plain decimal text, or null: no exponents, no grouping."""
    text = F.trim(col(c))
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), text.try_cast(f"decimal({precision},{scale})"))


def z_score(x: Name, mean: Name, deviation: Name) -> Column:
    return (col(x) - col(mean)) / F.nullif(col(deviation), F.lit(0.0))


def bin_of(x: Name, low: Name, high: Name, bins: int) -> Column:
    """1 to bins in equal widths; the greatest value belongs to the last bin."""
    width = (col(high) - col(low)) / bins
    return F.least(F.floor((col(x) - col(low)) / F.nullif(width, F.lit(0.0))) + 1, F.lit(bins)).cast("int")


def is_strict_integer(variant: Name) -> Column:
    """An integer value of a variant: no boolean, no text, no fraction."""
    kind = F.call_function("schema_of_variant", col(variant))
    return kind == "BIGINT"
