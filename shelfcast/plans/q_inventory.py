"""Registered inventory queries (I1-I22, D8, D9) with their DuckDB oracles."""

from __future__ import annotations

from shelfcast.functions.numeric import sql_hash_uniform as U
from shelfcast.operators import inventory as I
from shelfcast.plans.catalog import register, sql_forecast_ctes
from shelfcast.sources.tpch import BASE_YEARS, OVERSTOCK_PRODUCTS, TARGET_YEAR, sale_columns, sale_rows, tpch_sales, with_sales

_TARGETS = ", ".join("'" + p.replace("'", "''") + "'" for p in OVERSTOCK_PRODUCTS)
FIRST = "arg_min({c}, (sale_date, sale_id))"

SNAP = f""",
st AS (SELECT product_id, avg(CAST(coalesce(quantity, 0) AS DOUBLE)) AS m,
              coalesce(stddev_samp(CAST(coalesce(quantity, 0) AS DOUBLE)), 0.0) AS sd FROM sales GROUP BY product_id),
ss AS (SELECT product_id, CAST(ceil((m + 2 * sd) * 1.0) AS BIGINT) AS safety_stock FROM st),
snap0 AS (SELECT s.*, ss.safety_stock,
   CAST(CASE WHEN {U('sale_id', 'danger')} < 0.03
             THEN greatest(floor(coalesce(ss.safety_stock, 1) * (0.3 + 0.65 * {U('sale_id', 'danger_factor')})), 0)
             WHEN product_name IN ({_TARGETS})
             THEN round_even(ss.safety_stock * round_even(3.0 + 1.5 * {U('product_name', 'overstock')}, 2), 0)
             ELSE ss.safety_stock + coalesce(quantity, 0) + floor({U('sale_id', 'inventory')} * 5) END AS BIGINT) AS inventory
   FROM sales s LEFT JOIN ss USING (product_id)),
snap AS (SELECT *, CASE WHEN inventory < safety_stock THEN 'Danger' WHEN inventory > safety_stock * 3 THEN 'Overstock'
                        ELSE 'Normal' END AS status,
                greatest((inventory - coalesce(quantity, 0)) * coalesce(price, 0.0), 0.0) AS frozen_money,
                CASE WHEN safety_stock > 0 THEN inventory / safety_stock * 100.0 ELSE 0.0 END AS h
         FROM snap0)"""

LIST = f""",
lst AS (SELECT store_name, product_id, {FIRST.format(c='product_name')} AS product_name,
               {FIRST.format(c='inventory')} AS inventory, {FIRST.format(c='safety_stock')} AS safety_stock,
               {FIRST.format(c='status')} AS status,
               round_even(sum(CAST(round(frozen_money * 100) AS BIGINT)) / 100.0, 2) AS frozen_money,
               coalesce({FIRST.format(c='price')}, 0.0) AS price
        FROM snap GROUP BY store_name, product_id)"""


def snap(spark, d, move=lambda rows: rows):
    """The snapshot; ``move`` gets the rows before the columns that others imply are made."""
    return I.inventory_snapshot(sale_rows(spark, d, by_product=True), overstock_products=OVERSTOCK_PRODUCTS,
                                finish=lambda rows: sale_columns(move(rows)))


@register("i1_safety_stock", with_sales(SNAP + "\nSELECT product_id, safety_stock FROM ss"))
def i1(spark, d):
    return I.safety_stock(tpch_sales(spark, d))


@register("i3_inventory_status", with_sales(SNAP + "\nSELECT sale_id, status FROM snap"))
def i3(spark, d):
    return snap(spark, d).select("sale_id", "status")


@register("i4_frozen_money", with_sales(SNAP + "\nSELECT sale_id, round_even(frozen_money, 2) AS frozen_money FROM snap"))
def i4(spark, d):
    from pyspark.sql import functions as F
    return snap(spark, d).select("sale_id", F.bround("frozen_money", 2).alias("frozen_money"))


@register("i5_status_counts", with_sales(SNAP + "\nSELECT status, count(*) AS count FROM snap GROUP BY ROLLUP (status)"))
def i5(spark, d):
    return I.status_counts(snap(spark, d))


FC = sql_forecast_ctes(BASE_YEARS, TARGET_YEAR)
SHARE = f""", {FC},
sq AS (SELECT product_id, year(sale_date) * 4 + quarter(sale_date) - 1 AS qi, coalesce(quantity, 0) AS q
       FROM sales WHERE sale_date IS NOT NULL),
per_q AS (SELECT qi, sum(q) AS tq FROM sq GROUP BY qi),
pq AS (SELECT product_id, qi, sum(q) AS pq FROM sq GROUP BY product_id, qi),
split AS (SELECT product_id, max(qi) AS split FROM pq GROUP BY product_id),
win AS (SELECT product_id, split, split - k AS qi FROM split, range(0, 4) r(k)),
j AS (SELECT win.product_id, split, coalesce(sum(tq), 0) AS t4, coalesce(sum(pq.pq), 0) AS p4
      FROM win LEFT JOIN per_q USING (qi) LEFT JOIN pq ON pq.product_id = win.product_id AND pq.qi = win.qi
      GROUP BY win.product_id, split),
share AS (SELECT product_id, split, CASE WHEN t4 > 0 THEN p4 / t4 ELSE 0.0 END AS share,
                 greatest(CAST(fc.predicted_quantity AS DOUBLE), 0.0) * CASE WHEN t4 > 0 THEN p4 / t4 ELSE 0.0 END AS product_total
          FROM j, fc)"""


@register("i6_kpi_summary", with_sales(SNAP + SHARE + f""",
g AS (SELECT round_even(sum(CAST(round(frozen_money * 100) AS BIGINT)) / 100.0, 2) AS f,
             count(*) FILTER (WHERE status = 'Danger') AS d, count(*) FILTER (WHERE status = 'Overstock') AS o FROM snap),
pr AS (SELECT product_id, coalesce({FIRST.format(c='price')}, 0.0) AS price FROM sales GROUP BY product_id),
dm AS (SELECT share.product_id, CAST(round_even(product_total / 6.0, 0) AS BIGINT) AS demand, price
       FROM share LEFT JOIN pr USING (product_id))
SELECT product_id, g.f AS total_frozen_money, g.d AS danger_count, g.o AS overstock_count,
       demand AS predicted_demand, round_even(demand * coalesce(price, 0.0), 2) AS expected_revenue FROM dm, g"""))
def i6(spark, d):
    s = tpch_sales(spark, d)
    return I.kpi_summary(I.inventory_snapshot(s, overstock_products=OVERSTOCK_PRODUCTS), s)


@register("i7_inventory_list", with_sales(SNAP + LIST + "\nSELECT * FROM lst"))
def i7(spark, d):
    return I.inventory_list(snap(spark, d))


@register("i8_overstock_by_region", with_sales(SNAP + """,
o AS (SELECT store_name, trim(coalesce(country, '')) AS country,
             coalesce(continent, CASE WHEN trim(coalesce(country, '')) <> '' THEN trim(country) END, 'Unknown') AS continent,
             trim(coalesce(category_name, '')) AS category, greatest(inventory - safety_stock, 0) AS x,
             CAST(round(frozen_money * 100) AS BIGINT) AS fc FROM snap WHERE status = 'Overstock'),
det AS (SELECT store_name, country, continent, category, sum(x) AS x, sum(fc) AS fc FROM o GROUP BY ALL)
SELECT store_name, country, continent, CAST(sum(x) AS BIGINT) AS overstock_qty, round_even(sum(fc) / 100.0, 2) AS frozen_money,
       arg_min(category, (-x, category)) AS category
FROM det GROUP BY store_name, country, continent"""))
def i8(spark, d):
    return I.overstock_by_region(snap(spark, d))


def _top_by_product(status: str) -> str:
    return f""",
a AS (SELECT product_id, CAST(sum(inventory) AS BIGINT) AS current_inventory, CAST(sum(safety_stock) AS BIGINT) AS target_inventory,
             coalesce({FIRST.format(c='price')}, 0.0) AS p, {FIRST.format(c='product_name')} AS product_name
      FROM snap WHERE status = '{status}' GROUP BY product_id)"""


@register("i9_overstock_top5", with_sales(SNAP + _top_by_product("Overstock") + """,
b AS (SELECT *, greatest(current_inventory - target_inventory, 0) AS overstock_qty FROM a)
SELECT product_id, product_name, current_inventory, target_inventory, overstock_qty,
       CASE WHEN target_inventory > 0 THEN round_even(overstock_qty / target_inventory * 100.0, 1) ELSE 0.0 END AS overstock_pct,
       round_even(overstock_qty * p, 0) AS savings_amount
FROM b WHERE overstock_qty > 0 ORDER BY overstock_qty DESC, product_id LIMIT 5"""))
def i9(spark, d):
    return I.overstock_top5(snap(spark, d))


@register("i10_risky_top5", with_sales(SNAP + _top_by_product("Danger") + """,
b AS (SELECT *, greatest(target_inventory - current_inventory, 0) AS order_quantity FROM a),
c AS (SELECT *, round_even(order_quantity * p, 0) AS expenditure FROM b WHERE order_quantity > 0
      ORDER BY expenditure DESC, product_id LIMIT 5)
SELECT CAST(row_number() OVER (ORDER BY expenditure DESC, product_id) AS INTEGER) AS rank, product_id, product_name,
       current_inventory, target_inventory, order_quantity, expenditure FROM c"""))
def i10(spark, d):
    return I.risky_top5(snap(spark, d))


@register("i11_critical_alerts", with_sales(SNAP + """,
c AS (SELECT DISTINCT store_name, product_id, h, inventory, safety_stock FROM snap WHERE h < 70.0)
SELECT store_name, product_id, round_even(h, 1) AS health_index, inventory, safety_stock,
       (SELECT count(*) FROM c) AS critical_count
FROM c ORDER BY h, store_name, product_id, inventory LIMIT 50"""))
def i11(spark, d):
    return I.critical_alerts(snap(spark, d))


@register("i12_inventory_health", with_sales(SNAP + f"""
SELECT product_id, round_even({FIRST.format(c='h')}, 1) AS health_index FROM snap GROUP BY product_id"""))
def i12(spark, d):
    return I.inventory_health(snap(spark, d))


@register("i13_frozen_money_alert", with_sales(SNAP + LIST + """
SELECT *, frozen_money >= (SELECT quantile_cont(frozen_money, 0.75) FROM lst) AND status IN ('Normal', '정상') AS investor_alert
FROM lst"""))
def i13(spark, d):
    return I.frozen_money_alert(snap(spark, d))


@register("i14_quarter_store_matrix", with_sales("""
SELECT trim(category_name) AS category, year(sale_date) || '-Q' || quarter(sale_date) AS period, store_name, country, continent,
       CAST(sum(coalesce(quantity, 0)) AS BIGINT) AS quantity
FROM sales WHERE sale_date IS NOT NULL GROUP BY ALL"""))
def i14(spark, d):
    return I.quarter_store_matrix(tpch_sales(spark, d))


@register("i15_sales_by_product", with_sales(f"""
SELECT trim(category_name) AS category, product_id, {FIRST.format(c='product_name')} AS product_name,
       CAST(sum(coalesce(quantity, 0)) AS BIGINT) AS quantity FROM sales GROUP BY 1, 2"""))
def i15(spark, d):
    return I.sales_by_product(tpch_sales(spark, d))


@register("i16_store_period_total", with_sales(f""",
f AS (SELECT DISTINCT store_name FROM sales WHERE sale_year = {BASE_YEARS[1]} ORDER BY store_name LIMIT 12)
SELECT year(sale_date) || '-Q' || quarter(sale_date) AS period, CAST(sum(coalesce(quantity, 0)) AS BIGINT) AS quantity
FROM sales WHERE sale_year = {BASE_YEARS[1]} AND store_name IN (SELECT store_name FROM f) GROUP BY 1"""))
def i16(spark, d):
    return I.store_period_total(tpch_sales(spark, d), BASE_YEARS[1])


@register("i17_danger_top5_store_product", with_sales(SNAP + LIST + """
SELECT *, safety_stock - inventory AS needed, round_even((safety_stock - inventory) * price, 2) AS expenditure
FROM lst WHERE status = 'Danger' ORDER BY needed DESC, store_name, product_id LIMIT 5"""))
def i17(spark, d):
    return I.danger_top5_store_product(I.inventory_list(snap(spark, d)))


@register("i18_overstock_top5_store", with_sales(SNAP + LIST + """
SELECT *, inventory - safety_stock AS excess FROM lst WHERE status = 'Overstock'
ORDER BY excess DESC, store_name, product_id LIMIT 5"""))
def i18(spark, d):
    return I.overstock_top5_store(I.inventory_list(snap(spark, d)))


@register("i19_normal_below_safety", with_sales(SNAP + LIST + """
SELECT * FROM lst WHERE status IN ('Normal', '정상') AND inventory < safety_stock"""))
def i19(spark, d):
    return I.normal_below_safety(I.inventory_list(snap(spark, d)))


@register("i20_frozen_ratio_top20", with_sales(SNAP + LIST + """
SELECT *, CASE WHEN inventory > 0 THEN CAST(round(CAST(frozen_money / inventory AS DECIMAL(38, 10)), 2) AS DOUBLE) ELSE 0.0 END AS frozen_ratio,
       CASE WHEN inventory > 0 THEN CAST(round(CAST(frozen_money / inventory AS DECIMAL(38, 10)) * 100, 0) AS BIGINT) ELSE 0 END AS frozen_ratio_pct
FROM lst ORDER BY frozen_money DESC, store_name, product_id LIMIT 20"""))
def i20(spark, d):
    return I.frozen_ratio_top20(I.inventory_list(snap(spark, d)))


@register("i21_stock_signal", with_sales(SNAP + LIST + """
SELECT *, CASE WHEN inventory < safety_stock THEN 'red' ELSE 'green' END AS signal FROM lst"""))
def i21(spark, d):
    return I.stock_signal(I.inventory_list(snap(spark, d)))


@register("i22_overstock_filters", with_sales(SNAP + """,
o AS (SELECT DISTINCT coalesce(continent, CASE WHEN trim(coalesce(country, '')) <> '' THEN trim(country) END, 'Unknown') AS continent,
             trim(coalesce(country, '')) AS country, store_name FROM snap WHERE status = 'Overstock')
SELECT continent, country, store_name FROM (
  SELECT *, row_number() OVER (PARTITION BY continent, country ORDER BY store_name) AS r FROM o) WHERE r <= 12"""))
def i22(spark, d):
    return I.overstock_filters(I.overstock_by_region(snap(spark, d)))


D9_BODY = """,
f AS (SELECT product_id, split, product_total, i FROM share, range(1, 7) r(i)),
g AS (SELECT product_id, split + i AS qi, greatest(product_total / 6.0, 0.0) AS yhat FROM f)
SELECT product_id, CAST(floor(qi / 4) AS INTEGER) || '-Q' || CAST(qi % 4 + 1 AS INTEGER) AS month,
       round_even(yhat, 2) AS yhat, round_even(yhat * 0.85, 2) AS yhat_lower, round_even(yhat * 1.15, 2) AS yhat_upper,
       round_even(yhat * 1.125, 2) AS store_stock_quantity FROM g"""


@register("d9_quarter_forecast_share", with_sales(SHARE + D9_BODY))
def d9(spark, d):
    return I.quarter_forecast_share(tpch_sales(spark, d))


D8_CTES = f""",
s AS (SELECT *, greatest(1, CAST(round_even(coalesce(quantity, 0) * (0.95 + 0.35 * {U('sale_id', 'stock')}), 0) AS BIGINT)) AS stock
      FROM sales WHERE sale_date IS NOT NULL),
ok AS (SELECT product_id FROM s GROUP BY product_id HAVING count(DISTINCT sale_date) >= 2),
d8 AS (SELECT product_id, year(sale_date) || '-Q' || quarter(sale_date) AS month, CAST(sum(coalesce(quantity, 0)) AS DOUBLE) AS yhat,
       CAST(sum(stock) AS DOUBLE) AS store_stock_quantity
FROM s WHERE product_id IN (SELECT product_id FROM ok) AND sale_year >= {BASE_YEARS[0]} GROUP BY 1, 2)"""


@register("d8_quarter_demand_chart", with_sales(D8_CTES + "\nSELECT * FROM d8"))
def d8(spark, d):
    return I.quarter_demand_chart(tpch_sales(spark, d))


D12_SQL = with_sales(SHARE + D9_BODY.replace("\nSELECT product_id, CAST(floor(qi / 4)", ",\nd9 AS (SELECT product_id, CAST(floor(qi / 4)")
                     + ")" + D8_CTES + """
SELECT coalesce(a.product_id, p.product_id) AS product_id, coalesce(a.month, p.month) AS month,
       a.yhat AS actual, p.yhat AS predicted
FROM d8 a FULL OUTER JOIN d9 p ON a.product_id = p.product_id AND a.month = p.month""")
