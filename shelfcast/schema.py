"""Canonical sales schema and the one-time ``canonicalize`` step.

Jobs assume these snake_case names; alternative spellings seen in raw files
(``Product_Name``, ``Store_Name``, ``Sale_Date`` ...) are mapped once at
ingest, optional columns are added as NULL so no job branches on presence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANONICAL = T.StructType([
    T.StructField("sale_id", T.StringType()),
    T.StructField("sale_date", T.DateType()),
    T.StructField("store_id", T.StringType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("category_id", T.StringType()),
    T.StructField("launch_date", T.DateType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("category_name", T.StringType()),
    T.StructField("store_name", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("total_sales", T.DoubleType()),
    T.StructField("store_stock_quantity", T.IntegerType()),
    T.StructField("inventory", T.IntegerType()),
    T.StructField("frozen_money", T.DoubleType()),
    T.StructField("safety_stock", T.IntegerType()),
    T.StructField("status", T.StringType()),
])

TEXT_COLS = [f.name for f in CANONICAL.fields if isinstance(f.dataType, T.StringType)]

# Alternative raw spellings -> canonical name (lower-cased lookup).
ALIASES = {
    "sale_id": "sale_id", "sale_date": "sale_date", "store_id": "store_id",
    "product_id": "product_id", "quantity": "quantity",
    "product_name": "product_name", "category_id": "category_id",
    "launch_date": "launch_date", "price": "price", "category_name": "category_name",
    "store_name": "store_name", "city": "city", "country": "country",
    "total_sales": "total_sales", "store_stock_quantity": "store_stock_quantity",
    "inventory": "inventory", "frozen_money": "frozen_money",
    "safety_stock": "safety_stock", "status": "status",
}


def _coerce(c: Column, dtype: T.DataType) -> Column:
    """pandas ``errors='coerce'``: bad values become NULL (ANSI-safe)."""
    if isinstance(dtype, T.DateType):
        s = F.substring(F.trim(c.cast("string")), 1, 10)
        return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd"))
    if isinstance(dtype, T.StringType):
        return c.cast("string")
    return c.cast("string").try_cast(dtype)


def canonicalize(raw: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Rename to snake_case, coerce types, clean text, back-fill optional
    columns. Numbers that fail to parse are NULL; ``quantity`` becomes 0
    and a missing ``total_sales`` is ``quantity * price``."""
    from shelfcast.functions.text import norm_text  # local import: no cycle

    by_lower = {}
    for name in raw.columns:
        key = name.strip().lower()
        if key in ALIASES and ALIASES[key] not in by_lower:
            by_lower[ALIASES[key]] = name
    cols = []
    for field in CANONICAL.fields:
        src = by_lower.get(field.name)
        c = F.col(f"`{src}`") if src else F.lit(None)
        c = _coerce(c, field.dataType)
        if field.name in TEXT_COLS:
            c = norm_text(c)
        cols.append(c.alias(field.name))
    out = raw.select(*cols, *[F.col(f"`{x}`") for x in (extra or [])])
    out = out.withColumn("quantity", F.coalesce(F.col("quantity"), F.lit(0)))
    out = out.withColumn(
        "total_sales",
        F.coalesce(F.col("total_sales"), F.col("quantity") * F.col("price")))
    return out.withColumn("sale_year", F.year("sale_date"))
