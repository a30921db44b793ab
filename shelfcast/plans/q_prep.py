"""Registered preparation queries (K family) on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.functions.numeric import sql_hash_uniform as U
from shelfcast.operators import prep as K
from shelfcast.plans.catalog import register
from shelfcast.sources.tpch import tpch_sales, with_sales


@register("k1_dedup_sales", with_sales("""
SELECT sale_id, strftime(sale_date, '%Y-%m-%d') AS sale_date, store_id, product_id FROM (
  SELECT *, row_number() OVER (PARTITION BY sale_id ORDER BY sale_date, sale_id) AS rn FROM sales) WHERE rn = 1"""))
def k1(spark, d):
    return K.dedup_sales(tpch_sales(spark, d)).select(
        "sale_id", F.date_format("sale_date", "yyyy-MM-dd").alias("sale_date"), "store_id", "product_id")


@register("k5_dashboard_sample", with_sales("""
SELECT sale_id, country, strftime(sale_date, '%Y-%m-%d') AS sale_date FROM sales WHERE sale_year >= 1996 ORDER BY md5(sale_id) LIMIT 20000"""))
def k5(spark, d):
    return K.dashboard_sample(tpch_sales(spark, d), min_year=1996).select(
        "sale_id", "country", F.date_format("sale_date", "yyyy-MM-dd").alias("sale_date"))


@register("k7_scale_inventory", with_sales(f""",
st AS (SELECT product_id, avg(CAST(coalesce(quantity, 0) AS DOUBLE)) AS m,
              coalesce(stddev_samp(CAST(coalesce(quantity, 0) AS DOUBLE)), 0.0) AS sd FROM sales GROUP BY product_id)
SELECT sale_id, CAST(greatest(floor((CAST(ceil(m + 2 * sd) AS BIGINT) + coalesce(quantity, 0)) / 100), 0) AS BIGINT) AS inventory
FROM sales JOIN st USING (product_id)"""))
def k7(spark, d):
    from shelfcast.operators.inventory import safety_stock
    s = tpch_sales(spark, d)
    base = s.join(safety_stock(s), "product_id").withColumn("inventory", F.col("safety_stock") + F.coalesce("quantity", F.lit(0)))
    return K.scale_inventory(base).select("sale_id", "inventory")
