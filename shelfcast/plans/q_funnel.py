"""Registered funnel / feedback / opportunity-cost queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.operators import funnel as U
from shelfcast.operators import inventory as I
from shelfcast.plans.catalog import register
from shelfcast.plans.q_inventory import SNAP
from shelfcast.sources.tpch import OVERSTOCK_PRODUCTS, tpch_sales, with_sales
from shelfcast.sources.tpch import table as _table


def table(spark, d, name):
    return _table(spark, d, name)

STAGE_SQL = ("CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 END")
NAME_SQL = ("CASE event_type WHEN 'view' THEN 'Main_Exposure' WHEN 'click' THEN 'Product_Click' "
            "WHEN 'signup' THEN 'Add_to_Cart' WHEN 'purchase' THEN 'Purchase' END")

U1_SQL = f"""WITH g AS (
  SELECT CAST(ts AS DATE) AS day, {STAGE_SQL} AS stage_order, {NAME_SQL} AS stage, count(DISTINCT user_id) AS user_count
  FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase') GROUP BY 1, 2, 3),
c AS (SELECT *, CASE WHEN lag(user_count) OVER w IS NULL THEN 100.0 ELSE user_count / lag(user_count) OVER w * 100.0 END AS conv,
             arg_min(user_count, stage_order) OVER (PARTITION BY day) AS f, arg_max(user_count, stage_order) OVER (PARTITION BY day) AS l
      FROM g WINDOW w AS (PARTITION BY day ORDER BY stage_order))
SELECT strftime(day, '%Y-%m-%d') AS day, CAST(stage_order AS INTEGER) AS stage_order, stage, user_count, round_even(conv, 2) AS conversion_rate,
       conv < 40.0 AS drop_off, round_even(l / f * 100.0, 2) AS overall_cvr FROM c"""


@register("u1_journey_funnel", U1_SQL)
def u1(spark, d):
    return U.journey_funnel(table(spark, d, "events"))


@register("u2_stage_weight", U1_SQL.replace("SELECT strftime(day, '%Y-%m-%d') AS day, CAST(stage_order", "SELECT *, CASE stage WHEN 'Main_Exposure' THEN 1.2 WHEN "
                                            "'Add_to_Cart' THEN 1.5 ELSE 1.0 END AS recommendation_weight FROM (SELECT strftime(day, '%Y-%m-%d') AS day, CAST(stage_order")
          + ")")
def u2(spark, d):
    return U.stage_weight(U.journey_funnel(table(spark, d, "events")))


@register("u3_feedback_clicks", """
SELECT product_id, count(*) AS impressions, CAST(sum(v) AS BIGINT) AS clicks, round_even(sum(v) / count(*) * 100.0, 2) AS click_rate
FROM (SELECT json_extract_string(props, '$.k') AS product_id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS v
      FROM events WHERE event_type IN ('click', 'view')) GROUP BY product_id""")
def u3(spark, d):
    return U.feedback_clicks(U.feedback_from_events(table(spark, d, "events")))


U4_SQL = with_sales(SNAP + """,
v AS (SELECT product_id, sum(CAST(round(frozen_money * 100) AS BIGINT)) / 100.0 AS inventory_value,
             max(sale_year) - min(sale_year) AS _y,
             datediff('day', min(sale_date), max(sale_date)) AS held_days FROM snap GROUP BY product_id)
SELECT product_id, inventory_value, held_days,
  CASE WHEN held_days > 0 AND inventory_value >= 0 THEN round_even(inventory_value * (held_days / 365.0) * 0.08, 2) ELSE 0.0 END AS opportunity_cost_before,
  CASE WHEN held_days > 0 AND inventory_value >= 0 THEN round_even(inventory_value * (30.0 / 365.0) * 0.08, 2) ELSE 0.0 END AS opportunity_cost_after,
  CASE WHEN held_days > 0 AND inventory_value >= 0 THEN round_even(greatest(inventory_value * (held_days / 365.0) * 0.08
       - inventory_value * (30.0 / 365.0) * 0.08, 0.0), 2) ELSE 0.0 END AS opportunity_cost_saved_annual
FROM v""")


@register("u4_opportunity_cost", U4_SQL)
def u4(spark, d):
    snap = I.inventory_snapshot(tpch_sales(spark, d), overstock_products=OVERSTOCK_PRODUCTS)
    v = snap.groupBy("product_id").agg(
        (F.sum(F.round(F.col("frozen_money") * 100).cast("long")) / 100.0).alias("inventory_value"),
        F.datediff(F.max("sale_date"), F.min("sale_date")).alias("held_days"))
    return U.opportunity_cost(v, "inventory_value", "held_days")
