"""Data preparation jobs K1-K9 (dedup, coercion, synthetic fills, export,
sampling, enrichment, scaling, feedback append)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from shelfcast.functions.numeric import hash_uniform

# ---- fixed values ----------------------------------------------------------
STOCK_FACTOR_RANGE = (0.95, 1.30)   # store stock = q * (0.95 + 0.35 u)
DEFAULT_STATUS = "Normal"
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
SAMPLE_MIN_YEAR = 2020
SAMPLE_ROWS = 20000
SCALE_DIVISOR = 100
EXPORT_PARTS = 10
EXPORT_ROWS = 1_000_000             # rows that one task writes, about
MATCHES = ["matched", "not_found", "failed"]
# ---------------------------------------------------------------------------


def synth_store_stock(sales: DataFrame) -> DataFrame:
    """K3: store_stock_quantity = max(1, round(q * (0.95 + 0.35 u(sale_id))))
    where it is missing."""
    lo, hi = STOCK_FACTOR_RANGE
    q = F.coalesce(F.col("quantity"), F.lit(0))
    synth = F.greatest(F.lit(1), F.bround(q * (F.lit(lo) + F.lit(hi - lo) * hash_uniform("sale_id", "stock")), 0).cast("long"))
    cur = F.col("store_stock_quantity").cast("long") if "store_stock_quantity" in sales.columns else F.lit(None).cast("long")
    return sales.withColumn("store_stock_quantity", F.coalesce(cur, synth))


def dedup_sales(sales: DataFrame, order_col: str = "_ingest_order") -> DataFrame:
    """K1: one row per sale_id, the first by ingest order (a column the
    reader adds, e.g. file name + line) or by (sale_date, sale_id)."""
    order = [F.col(order_col)] if order_col in sales.columns else [F.col("sale_date"), F.col("sale_id")]
    w = Window.partitionBy("sale_id").orderBy(*order)
    return sales.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def coerce_sales(raw: DataFrame) -> DataFrame:
    """K2: integers and money coerced (bad -> 0), dates only when the first
    ten characters look like yyyy-MM-dd, status defaulting to Normal."""
    out = raw
    for c in ["quantity", "store_stock_quantity", "inventory", "safety_stock"]:
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(F.col(c).cast("string").try_cast("double").cast("long").cast("int"), F.lit(0)))
    for c in ["price", "total_sales", "frozen_money"]:
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(F.col(c).cast("string").try_cast("decimal(12,2)"), F.lit(0).cast("decimal(12,2)")))
    for c in ["sale_date", "launch_date"]:
        if c in out.columns:
            s = F.substring(F.trim(F.col(c).cast("string")), 1, 10)
            out = out.withColumn(c, F.when(s.rlike(DATE_PATTERN), F.try_to_date(s, "yyyy-MM-dd")))
    if "status" in out.columns:
        st = F.trim(F.col("status"))
        out = out.withColumn("status", F.when(st.isNull() | (st == ""), F.lit(DEFAULT_STATUS)).otherwise(st))
    return out


def export_parts(sales: DataFrame, out_dir: str, parts: int = EXPORT_PARTS, fmt: str = "parquet",
                 rows: int = EXPORT_ROWS) -> None:
    """K4: write the table as ``parts`` sale_id ranges (range partitioning,
    no driver loop), each in as many files, by sale_id too, as keep a task at about ``rows`` rows. ``fmt='sql'`` writes a dump that loads again: ``INSERT``
    statements with the column list, the table's definition in the first part
    (:mod:`shelfcast.sources.dump`)."""
    files = parts * max(1, -(-sales.count() // (parts * rows)))
    d = sales.repartitionByRange(files, "sale_id")
    if fmt == "sql":
        from shelfcast.sources.dump import write_dump
        write_dump(d, out_dir)
    else:
        d.write.mode("overwrite").format(fmt).save(out_dir)


def dashboard_sample(sales: DataFrame, n: int = SAMPLE_ROWS, min_year: int = SAMPLE_MIN_YEAR,
                     stratify: bool = False) -> DataFrame:
    """K5: year >= min_year, exactly n rows chosen by a hash order of
    sale_id (a sampling feature, reproducible on any partitioning);
    ``stratify`` keeps each country's share."""
    s = sales.filter(F.col("sale_year") >= min_year).withColumn("_h", F.md5(F.col("sale_id").cast("string")))
    if not stratify:
        return s.orderBy("_h").limit(n).drop("_h")
    per = s.groupBy("country").agg(F.count(F.lit(1)).alias("_c"))
    total = s.select(F.count(F.lit(1))).scalar()
    quota = per.select("country", F.ceil(F.col("_c") * n / total).alias("_q"))
    # The literal bound (no country needs more than n rows, plus rounding)
    # lets Spark insert a partial WindowGroupLimit before the shuffle, so a
    # country holding a third of all rows still sends at most that many rows
    # per partition; each country's own quota is applied afterwards.
    bound = int(n) + 1
    w = Window.partitionBy("country").orderBy("_h")
    ranked = s.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= bound)
    return (ranked.join(F.broadcast(quota), "country").filter(F.col("_r") <= F.col("_q"))
              .drop("_h", "_r", "_q"))


def enrich_inventory(sales: DataFrame, patch: DataFrame, finish: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """K6: left look-up on (date, store id, normalised product name, quantity,
    price): matched rows take the patch's stock, inventory, frozen money,
    safety stock and status; ``_match`` is matched / not_found, or failed where a part
    of the row's key is missing (text that did not parse). Of several
    patch rows of a key the first by ``ingest_order`` wins (without that
    column: the smallest by its values, so the choice never depends on how
    rows are partitioned). ``finish`` gets the joined rows: it may add columns of the sale
    that need not have moved for the join."""
    from shelfcast.functions.text import norm_name_key
    key = ["sale_date", "store_id", "_pkey", "quantity", "price"]
    p = patch.withColumn("_pkey", norm_name_key("product_name"))
    cols = ["store_stock_quantity", "inventory", "frozen_money", "safety_stock", "status"]
    first = ["ingest_order"] if "ingest_order" in patch.columns else cols
    p = p.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*first))).filter("_rn = 1")
    p = p.select(*key, *[F.col(c).alias(f"_p_{c}") for c in cols], F.lit(True).alias("_hit"))
    j = finish(sales.withColumn("_pkey", norm_name_key("product_name")).join(p, key, "left"))
    for c in cols:
        cur = F.col(c) if c in sales.columns else F.lit(None)
        j = j.withColumn(c, F.when(F.col("_hit"), F.col(f"_p_{c}")).otherwise(cur))
    no_key = F.greatest(*[F.col(c).isNull() for c in ("sale_date", "store_id", "product_name", "quantity", "price")])
    return (j.withColumn("_match", F.when(F.col("_hit"), "matched").when(no_key, "failed").otherwise("not_found"))
             .drop("_pkey", "_hit", *[f"_p_{c}" for c in cols]))


def enrich_into(sales: DataFrame, patch: DataFrame, out_path: str, fmt: str = "parquet",
                finish: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> dict[str, int]:
    """K6 as a job: write the enriched rows to ``out_path`` and give the counters matched,
    not_found and failed, which the write itself collects (no second pass)."""
    seen = Observation("enrich_inventory")
    count = lambda k: F.coalesce(F.sum((F.col("_match") == k).cast("long")), F.lit(0)).alias(k)
    rows = enrich_inventory(sales, patch, finish).observe(seen, *[count(k) for k in MATCHES])
    packed = {"compression": "zstd"} if fmt == "parquet" else {}
    rows.write.mode("overwrite").format(fmt).options(**packed).save(out_path)
    return {k: int(seen.get[k]) for k in MATCHES}


def scale_inventory(sales: DataFrame, divisor: int = SCALE_DIVISOR) -> DataFrame:
    """K7: inventory = max(0, inventory // 100)."""
    return sales.withColumn("inventory", F.greatest(F.floor(F.col("inventory") / divisor), F.lit(0)).cast("long"))


def feedback_append(feedback: DataFrame, out_path: str, fmt: str = "json") -> DataFrame:
    """K9: clicked_items = keys whose value is 1; appended to the log."""
    out = feedback.withColumn("clicked_items", F.map_keys(F.map_filter("feedback", lambda k, v: v == 1)))
    out.write.mode("append").format(fmt).save(out_path)
    return out
