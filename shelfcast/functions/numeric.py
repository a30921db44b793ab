"""Numeric helpers shared by every job (and mirrored in the DuckDB oracle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def hash_uniform(key: Column | str, salt: str | None = None) -> Column:
    """Deterministic U[0,1) from a key: first 8 hex digits of md5 / 2^32.

    Replaces order-dependent NumPy draws; DuckDB computes the same value with
    ``CAST(('0x' || substr(md5(k), 1, 8)) AS UBIGINT) / 4294967296.0``.
    """
    k = F.col(key) if isinstance(key, str) else key
    k = k.cast("string")
    if salt:
        k = F.concat(k, F.lit(salt))
    return F.conv(F.substring(F.md5(k), 1, 8), 16, 10).cast("double") / F.lit(TWO_POW_32)


def sql_hash_uniform(expr: str, salt: str | None = None) -> str:
    """DuckDB text of :func:`hash_uniform`."""
    k = f"CAST({expr} AS VARCHAR)"
    if salt:
        k = f"({k} || '{salt}')"
    return f"(CAST(('0x' || substr(md5({k}), 1, 8)) AS UBIGINT) / 4294967296.0)"


def round_int(c: Column) -> Column:
    """Python ``int(round(x))`` (half-even) as a bigint."""
    return F.bround(c, 0).cast("long")


def round_half_even(c: Column, scale: int) -> Column:
    return F.bround(c, scale)


def round_half_up_js(c: Column, scale: int = 0) -> Column:
    """JavaScript ``Math.round`` at a scale: floor(x*10^s + 0.5) / 10^s."""
    m = 10 ** scale
    return F.floor(c * F.lit(m) + F.lit(0.5)) / F.lit(float(m)) if scale else F.floor(c + F.lit(0.5))


def safe_ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    return F.when(den.isNull() | (den == 0), F.lit(default)).otherwise(num / den)


# Money is summed as exact integer cents (bigint adds inside codegen): the
# result does not depend on summation order, so rounding ties (x.5) come
# out the same on every engine and every partitioning.
def cents(c: Column) -> Column:
    return F.round(F.coalesce(c, F.lit(0.0)) * F.lit(100.0)).cast("long")


def money_sum(c: Column) -> Column:
    """Exact sum of a 2-decimal money column, in cents (bigint)."""
    return F.sum(cents(c))


def cents_to_int(c: Column) -> Column:
    """Whole units, half-even (Python ``int(round(x))``)."""
    return F.bround(c / F.lit(100.0), 0).cast("long")


def cents_to_money(c: Column, scale: int = 2) -> Column:
    return F.bround(c / F.lit(100.0), scale)


def round_decimal(c: Column, scale: int) -> Column:
    """Round a computed double half-up in decimal arithmetic: the value is
    first snapped to 6 decimal places (removing binary noise such as
    24.0249999...), so exact ties round the same on every engine. DuckDB:
    ``CAST(round(CAST(x AS DECIMAL(38,6)), s) AS DOUBLE)``; 6 places keep the
    scaled value well inside exact double range on both engines."""
    return F.round(c.cast("decimal(38,6)"), scale).cast("double")
