"""Registered streaming queries (X1-X3), each drained with availableNow."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.operators import inventory as I
from shelfcast.plans.catalog import register
from shelfcast.plans.q_funnel import U1_SQL
from shelfcast.plans.q_inventory import LIST, SNAP, snap
from shelfcast.sources.tpch import store_dim, table, with_sales
from shelfcast.streaming import jobs as X


@register("x1_stream_feedback", """
SELECT strftime(time_bucket(INTERVAL 10 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, product_id,
       count(*) AS impressions, CAST(sum(v) AS BIGINT) AS clicks
FROM (SELECT ts, json_extract_string(props, '$.k') AS product_id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS v
      FROM events WHERE event_type IN ('click', 'view')) GROUP BY 1, 2""")
def x1(spark, d):
    out = X.stream_feedback(X.events_stream(spark, f"{d}/events.parquet"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "product_id",
                      "impressions", "clicks")


@register("x2_stream_funnel", U1_SQL)
def x2(spark, d):
    return X.stream_funnel(X.events_stream(spark, f"{d}/events.parquet"))


@register("x1_feedback_windows", """
WITH e AS (SELECT ts, json_extract_string(props, '$.k') AS product_id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS v
           FROM events WHERE event_type IN ('click', 'view')),
w AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS s, product_id, count(*) AS impressions, CAST(sum(v) AS BIGINT) AS clicks
      FROM e GROUP BY 1, 2)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, product_id, impressions, clicks FROM w
WHERE s + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM e) - INTERVAL 10 MINUTE""")
def x1_windows(spark, d):
    """Windows that the watermark has finished; the events come as one file, so none is late."""
    out = X.stream_feedback_windows(X.events_stream(spark, f"{d}/events.parquet"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "product_id",
                      "impressions", "clicks")


@register("x2_funnel_sketches", U1_SQL)
def x2_sketches(spark, d):
    """Estimates, which are exact for as few users a day as the check tables have."""
    return X.stream_funnel_approx(X.events_stream(spark, f"{d}/events.parquet"))


@register("x3_stream_critical_alerts", with_sales(SNAP + LIST + """,
run AS (SELECT store_name, product_id, sale_id, sale_date, lst.safety_stock,
               CAST(lst.inventory - sum(quantity) OVER (PARTITION BY store_name, product_id ORDER BY sale_date, sale_id) AS BIGINT) AS stock
        FROM sales JOIN lst USING (store_name, product_id)),
low AS (SELECT *, CASE WHEN safety_stock > 0 THEN stock / safety_stock * 100.0 ELSE 0.0 END AS h FROM run)
SELECT store_name, product_id, arg_min(sale_id, (sale_date, sale_id)) AS sale_id, arg_min(stock, (sale_date, sale_id)) AS stock,
       min(safety_stock) AS safety_stock, round_even(arg_min(h, (sale_date, sale_id)), 1) AS health_index
FROM low WHERE h < 70 GROUP BY store_name, product_id"""))
def x3(spark, d):
    opening = I.inventory_list(snap(spark, d)).select(
        "store_name", "product_id", "inventory", "safety_stock")
    # the sales view as a stream: lineitem file stream joined with static dimensions
    schema = spark.read.parquet(f"{d}/lineitem.parquet").schema
    li = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(X.file_glob(f"{d}/lineitem.parquet"))
    return X.stream_critical_alerts(_stream_view(spark, d, li), opening)


def _stream_view(spark, d, li):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    s = li.join(part, li.l_partkey == part.p_partkey).join(store_dim(spark, d), li.l_suppkey == F.col("_suppkey"))
    return s.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("sale_id"),
                    F.to_date("l_shipdate").alias("sale_date"), "store_name",
                    F.col("l_partkey").cast("string").alias("product_id"), F.col("l_quantity").cast("int").alias("quantity"))
