"""Registered queries that write the sales into the shared checkpoint folder and read
them back through the sources (S1, S2, S3, K4, K9), jobs that count while they write (K6),
and forecasts by a user's model (D2, D9, D11)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfcast.operators import forecast as D
from shelfcast.operators import funnel as U
from shelfcast.operators import inventory as I
from shelfcast.operators import prep as K
from shelfcast.plans.catalog import register, sql_forecast_ctes
from shelfcast.plans.q_inventory import SNAP, snap
from shelfcast.session import ensure_checkpoint_dir
from shelfcast.sources import dump, files
from shelfcast.sources.tpch import BASE_YEARS, TARGET_YEAR, sale_columns, sale_rows, table, tpch_sales, with_sales

COLUMNS = ["sale_id", "sale_date", "store_id", "product_id", "quantity", "product_name", "category_id", "price", "category_name",
           "store_name", "city", "country", "total_sales"]


def folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored_columns(spark, d):
    return tpch_sales(spark, d).select(*COLUMNS)


def summary(df):
    cents = lambda c: F.sum(F.round(F.col(c).cast("double") * 100).cast("long")).cast("long").alias(c)
    return df.groupBy("country", F.year(F.col("sale_date").cast("date")).alias("year")).agg(
        F.count(F.lit(1)).alias("sales"), F.sum(F.col("quantity").cast("long")).cast("long").alias("quantity"),
        cents("price"), cents("total_sales"), F.countDistinct("product_name").alias("names"))


SUMMARY = """
SELECT country, CAST(sale_year AS INTEGER) AS year, count(*) AS sales, CAST(sum(quantity) AS BIGINT) AS quantity,
       CAST(sum(CAST(round(CAST(price AS DOUBLE) * 100) AS BIGINT)) AS BIGINT) AS price,
       CAST(sum(CAST(round(CAST(total_sales AS DOUBLE) * 100) AS BIGINT)) AS BIGINT) AS total_sales,
       count(DISTINCT product_name) AS names
FROM sales GROUP BY country, sale_year"""


@register("k4_dump_read_back", with_sales(SUMMARY))
def k4(spark, d):
    """A dump of INSERT statements in ten ranges of sale_id, read back."""
    path = folder(spark, "dump")
    K.export_parts(stored_columns(spark, d), path, fmt="sql")
    return summary(dump.read_dump(spark, path).filter(f"{dump.CORRUPT} IS NULL"))


@register("s1_stored_sales", with_sales(SUMMARY))
def s1(spark, d):
    path = folder(spark, "stored")
    K.export_parts(stored_columns(spark, d), path)
    return summary(files.scan_sales(spark, path))


@register("s3_csv_sales", with_sales(SUMMARY))
def s3(spark, d):
    path = folder(spark, "csv")
    spelled = {"sale_date": "Sale_Date", "product_name": "Product_Name", "store_name": "Store_Name", "country": "Country"}
    rows = stored_columns(spark, d)
    rows.toDF(*[spelled.get(c, c) for c in rows.columns]).write.option("header", True).csv(path)
    return summary(files.scan_csv(spark, path))


@register("k6_counters", with_sales(SNAP + """,
patch AS (SELECT DISTINCT sale_date, store_id, regexp_replace(lower(product_name), '[^a-z0-9]', '', 'g') AS k, quantity, price
          FROM snap WHERE status <> 'Normal')
SELECT count(patch.k) AS matched, count(*) - count(patch.k) AS not_found, 0 AS failed
FROM sales s LEFT JOIN patch ON patch.sale_date = s.sale_date AND patch.store_id = s.store_id AND patch.quantity = s.quantity
     AND patch.price = s.price AND patch.k = regexp_replace(lower(s.product_name), '[^a-z0-9]', '', 'g')"""))
def k6(spark, d):
    """Counters of the job that writes the enriched sales."""
    patch = K.synth_store_stock(snap(spark, d).filter("status <> 'Normal'").withColumn("ingest_order", F.col("sale_id")))
    got = K.enrich_into(sale_rows(spark, d), patch, folder(spark, "enriched"), finish=sale_columns)
    return spark.createDataFrame([tuple(got[k] for k in K.MATCHES)], "matched long, not_found long, failed long")


@register("k9_feedback_log", """
WITH e AS (SELECT CAST(ts AS DATE) AS day, json_extract_string(props, '$.k') AS p, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS v
           FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2)
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS products, CAST(sum(v) AS BIGINT) AS clicked FROM e WHERE p IS NOT NULL GROUP BY 1""")
def k9(spark, d):
    """Daily feedback records appended to a log, which is read back."""
    e = U.feedback_from_events(table(spark, d, "events")).filter("product_id IS NOT NULL")
    e = e.groupBy(F.to_date("ts").alias("day"), "product_id").agg(F.max("value").alias("v"))
    records = e.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("product_id", "v"))).alias("feedback"))
    path = folder(spark, "feedback")
    K.feedback_append(records, path)
    back = spark.read.schema("day date, feedback map<string,int>, clicked_items array<string>").json(path)
    return back.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.size("feedback").cast("long").alias("products"),
                       F.size("clicked_items").cast("long").alias("clicked"))


def last_value(xs, ys, target):
    """A model of a user's: next year is as the last one."""
    return ys[-1]


@register("d2_by_user_model", with_sales(f""",
{sql_forecast_ctes(BASE_YEARS, TARGET_YEAR)},
p AS (SELECT q AS pq FROM py ORDER BY sale_year DESC LIMIT 1),
cat AS (SELECT trim(category_name) AS key, sum(coalesce(quantity, 0)) AS cq FROM sales WHERE sale_year BETWEEN {BASE_YEARS[0]} AND {BASE_YEARS[1]} GROUP BY 1)
SELECT 'year' AS section, CAST(sale_year AS VARCHAR) AS key, q AS quantity FROM py
UNION ALL SELECT 'total', NULL, CAST(sum(q) AS BIGINT) FROM py
UNION ALL SELECT 'predicted', 'last_value', pq FROM p
UNION ALL SELECT 'category', key, CAST(round_even(pq * (cq / (SELECT sum(cq) FROM cat)), 0) AS BIGINT) FROM cat, p"""))
def d2(spark, d):
    return D.quantity_forecast(tpch_sales(spark, d), model=last_value)


@register("d11_by_user_model", with_sales(f"""
SELECT product_id, CAST(arg_max(q, sale_year) AS BIGINT) AS predicted_quantity, 'last_value' AS method
FROM (SELECT product_id, sale_year, sum(coalesce(quantity, 0)) AS q FROM sales
      WHERE sale_year BETWEEN {BASE_YEARS[0]} AND {BASE_YEARS[1]} GROUP BY 1, 2) GROUP BY product_id"""))
def d11(spark, d):
    return D.product_forecast(tpch_sales(spark, d), model=last_value)


@register("d9_by_user_model", with_sales(f""",
{sql_forecast_ctes(BASE_YEARS, TARGET_YEAR)},
p AS (SELECT CAST(q AS DOUBLE) AS pq FROM py ORDER BY sale_year DESC LIMIT 1),
t AS (SELECT product_id, year(sale_date) * 4 + quarter(sale_date) - 1 AS qi, coalesce(quantity, 0) AS q FROM sales),
split AS (SELECT product_id, max(qi) AS split FROM t GROUP BY 1),
per AS (SELECT qi, sum(q) AS tq FROM t GROUP BY 1),
own AS (SELECT s.product_id, sum(q) AS p4 FROM split s JOIN t ON t.product_id = s.product_id AND qi > split - 4 GROUP BY 1),
whole AS (SELECT s.product_id, sum(tq) AS t4 FROM split s JOIN per ON qi BETWEEN split - 3 AND split GROUP BY 1)
SELECT product_id, split, CASE WHEN t4 > 0 THEN p4 / t4 ELSE 0.0 END AS share,
       pq * CASE WHEN t4 > 0 THEN p4 / t4 ELSE 0.0 END AS product_total
FROM split JOIN own USING (product_id) JOIN whole USING (product_id), p"""))
def d9(spark, d):
    return I.product_quarter_share(tpch_sales(spark, d), model=last_value)
