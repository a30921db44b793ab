"""Registered forecast and grading queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.operators import forecast as D
from shelfcast.operators import grading as G
from shelfcast.plans.catalog import MS, register, sql_forecast_ctes, sql_ols, sql_years
from shelfcast.sources.tpch import BASE_YEARS, TARGET_YEAR, tpch_sales, with_sales

Y = sql_years(*BASE_YEARS)
FC = sql_forecast_ctes(BASE_YEARS, TARGET_YEAR)
STRIP = "trim(regexp_replace(trim({x}), '^(?i)(apple\\s|애플\\s)', ''))"


@register("d1_linear_trend_by_category", with_sales(f""",
y AS (SELECT trim(category_name) AS category, sale_year, sum(coalesce(quantity, 0)) AS q FROM sales WHERE {Y} GROUP BY 1, 2)
SELECT category, greatest(0, CAST(round_even({sql_ols('sale_year', 'q', TARGET_YEAR)}, 0) AS BIGINT)) AS predicted
FROM y GROUP BY category"""))
def d1(spark, d):
    s = tpch_sales(spark, d)
    y = (s.filter(F.col("sale_year").between(*BASE_YEARS))
          .groupBy(F.trim("category_name").alias("category"), "sale_year")
          .agg(F.sum(F.coalesce("quantity", F.lit(0))).alias("q")))
    return D.linear_trend(y, ["category"], "sale_year", "q", TARGET_YEAR)


D2_SQL = with_sales(f""", {FC},
s AS (SELECT * FROM sales WHERE {Y}),
cat AS (SELECT trim(category_name) AS key, sum(coalesce(quantity, 0)) AS cq FROM s GROUP BY 1),
tc AS (SELECT sum(coalesce(quantity, 0)) AS t FROM s)
SELECT 'year' AS section, CAST(sale_year AS VARCHAR) AS key, q AS quantity FROM py
UNION ALL SELECT 'total', NULL, total_quantity FROM fc
UNION ALL SELECT 'predicted', method, predicted_quantity FROM fc
UNION ALL SELECT 'category', key, q FROM (
  SELECT key, greatest(0, CAST(round_even(fc.predicted_quantity * (cq / tc.t), 0) AS BIGINT)) AS q, tc.t AS t, fc.predicted_quantity AS p
  FROM cat, tc, fc) WHERE q > 0 AND t > 0 AND p > 0""")


@register("d2_quantity_forecast", D2_SQL)
def d2(spark, d):
    return D.quantity_forecast(tpch_sales(spark, d))


D3_CTES = f""", {FC},
sy AS (SELECT sale_year, CAST(round_even({MS} / 100.0, 0) AS BIGINT) AS t FROM sales WHERE {Y}
       GROUP BY store_id, city, country, sale_year),
byy AS (SELECT sale_year, sum(t) AS t FROM sy GROUP BY sale_year),
m AS (SELECT CAST(coalesce(sum(t), 0) AS BIGINT) AS total_sales,
             greatest(0, CAST(round_even({sql_ols('sale_year', 't', TARGET_YEAR)}, 0) AS BIGINT)) AS lin FROM byy),
d3 AS (SELECT CASE WHEN fc.predicted_quantity > 0 AND fc.total_quantity > 0 AND m.total_sales > 0
                   THEN greatest(0, CAST(round_even(fc.predicted_quantity * (m.total_sales / fc.total_quantity), 0) AS BIGINT))
                   ELSE m.lin END AS predicted_sales,
              'linear_trend' AS method, m.total_sales FROM m, fc)"""


@register("d3_sales_forecast_from_qty", with_sales(D3_CTES + "\nSELECT * FROM d3"))
def d3(spark, d):
    return D.sales_forecast_from_qty(tpch_sales(spark, d))


D4_CTES = f""",
vy AS (SELECT sale_year, {MS} / 100.0 AS v FROM sales WHERE sale_year IS NOT NULL GROUP BY sale_year),
d4 AS (SELECT greatest(0.0, coalesce(CAST(max(CASE WHEN sale_year = {TARGET_YEAR} THEN v END) AS DOUBLE),
         CASE WHEN max(sale_year) - min(sale_year) > 0
              THEN arg_max(v, sale_year) + (arg_max(v, sale_year) - arg_min(v, sale_year)) / CAST(max(sale_year) - min(sale_year) AS DOUBLE) * ({TARGET_YEAR} - max(sale_year))
              ELSE arg_max(v, sale_year) END)) AS forecast FROM vy)"""


@register("d4_endpoint_trend", with_sales(D4_CTES + "\nSELECT forecast FROM d4"))
def d4(spark, d):
    return G.annual_endpoint_forecast(tpch_sales(spark, d))


def _grade_sql(target_expr: str) -> str:
    return f""",
perf AS (SELECT country, store_name, sum(CAST(round(coalesce(total_sales, 0) * 100) AS BIGINT)) AS c FROM sales GROUP BY 1, 2),
tot AS (SELECT sum(CAST(round(coalesce(total_sales, 0) * 100) AS BIGINT)) / 100.0 AS total_all FROM sales),
n AS (SELECT count(DISTINCT store_name) AS n FROM perf),
tg AS (SELECT CASE WHEN ({target_expr}) <= 0 THEN 1.0 ELSE ({target_expr}) END AS tgt FROM n, tot, fcs),
gr AS (SELECT coalesce(trim(country), '') AS country, coalesce({STRIP.format(x='trim(store_name)')}, '') AS store_name,
              CAST(round_even(c / 100.0, 0) AS BIGINT) AS total_sales, CAST(round_even(tgt, 0) AS BIGINT) AS target_annual,
              (c / 100.0) / tgt * 100.0 AS rate FROM perf, tg)
"""


G_SELECT = """SELECT country, store_name, total_sales, target_annual, round_even(rate, 1) AS achievement_rate,
       CASE WHEN rate >= 100.0 THEN 'S' WHEN rate >= 80.0 THEN 'A' ELSE 'C' END AS grade FROM gr"""

G1_SQL = with_sales(D3_CTES + """,
fcs AS (SELECT CAST(predicted_sales AS DOUBLE) AS fcv FROM d3)""" + _grade_sql(
    "(CASE WHEN fcv <= 0 THEN total_all ELSE fcv END / 12.0) / n * 12.0") + G_SELECT)


@register("g1_store_grade_qty", G1_SQL)
def g1(spark, d):
    return G.store_grade_qty(tpch_sales(spark, d))


G2_CTES = D4_CTES + """,
fcs AS (SELECT forecast AS fcv FROM d4)""" + _grade_sql("CASE WHEN coalesce(fcv, 0.0) <= 0 THEN total_all ELSE fcv END / n")


@register("g2_store_grade_trend", with_sales(G2_CTES + G_SELECT))
def g2(spark, d):
    return G.store_grade_trend(tpch_sales(spark, d))


@register("g3_grade_distribution", with_sales(G2_CTES + f""", g AS ({G_SELECT}),
c AS (SELECT grade, count(*) AS cnt FROM g GROUP BY grade)
SELECT grades.grade, CAST(coalesce(cnt, 0) AS BIGINT) AS count,
       round_even(coalesce(cnt, 0) / (SELECT count(*) FROM g) * 100.0, 1) AS pct
FROM (VALUES ('S'), ('A'), ('C')) grades(grade) LEFT JOIN c USING (grade)"""))
def g3(spark, d):
    return G.grade_distribution(G.store_grade_trend(tpch_sales(spark, d)))


@register("g4_price_demand_corr", with_sales("""
SELECT product_name, n,
  CASE WHEN n < 2 THEN NULL WHEN r IS NULL OR isnan(r) THEN 0.0 ELSE round_even(r, 2) END AS correlation,
  CASE WHEN n < 2 THEN '가격·수량 데이터 부족' WHEN r IS NULL OR isnan(r) THEN '분석 중'
       WHEN r < -0.6 THEN '가격 민감도가 매우 높음: 할인 시 폭발적 수요 예상' ELSE '프리미엄 수요 안정적: 가격 유지 전략 권고' END AS insight
FROM (SELECT trim(product_name) AS product_name, count(*) AS n, corr(total_sales / quantity, CAST(quantity AS DOUBLE)) AS r
      FROM sales WHERE trim(product_name) <> '' AND quantity IS NOT NULL AND total_sales IS NOT NULL GROUP BY 1)"""))
def g4(spark, d):
    s = tpch_sales(spark, d).withColumn("unit_price", F.col("total_sales") / F.col("quantity"))
    return G.price_demand_corr(s, price_col="unit_price")


@register("g5_top20_achievement", with_sales(G2_CTES + f", g AS ({G_SELECT})\n"
                                             "SELECT * FROM g ORDER BY achievement_rate DESC, store_name, country LIMIT 20"))
def g5(spark, d):
    return G.top20_achievement(G.store_grade_trend(tpch_sales(spark, d)))


@register("b11_sales_summary", with_sales(D3_CTES + f""",
b1 AS (SELECT store_id, CAST(round_even({MS} / 100.0, 0) AS BIGINT) AS total_sales FROM sales WHERE {Y}
       GROUP BY store_id, city, country)
SELECT CAST(coalesce(sum(total_sales), 0) AS BIGINT) AS total_sum, count(*) AS store_count,
       (SELECT predicted_sales FROM d3) AS predicted_sales, (SELECT method FROM d3) AS forecast_method
FROM b1"""))
def b11(spark, d):
    from shelfcast.operators.sales import sales_summary
    return sales_summary(tpch_sales(spark, d))


DENSE = f""",
dd AS (SELECT store_id, sale_date, sum(CAST(round(coalesce(total_sales, 0) * 100) AS BIGINT)) AS c FROM sales
       WHERE sale_date IS NOT NULL GROUP BY 1, 2),
span AS (SELECT store_id, min(sale_date) AS a, max(sale_date) AS b FROM dd GROUP BY 1),
cal AS (SELECT store_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS sale_date FROM span),
dense AS (SELECT cal.store_id, cal.sale_date, coalesce(c, 0) / 100.0 AS value FROM cal LEFT JOIN dd USING (store_id, sale_date))"""


@register("d5_daily_sales_dense", with_sales(DENSE + "\nSELECT store_id, strftime(sale_date, '%Y-%m-%d') AS sale_date, value FROM dense"))
def d5(spark, d):
    return D.daily_sales_dense(tpch_sales(spark, d)).select(
        "store_id", F.date_format("sale_date", "yyyy-MM-dd").alias("sale_date"), "value")


@register("d6_store_sales_forecast", with_sales(DENSE + """,
ok AS (SELECT store_id FROM dense GROUP BY 1 HAVING count(*) >= 2),
q AS (SELECT store_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM dense GROUP BY 1),
kept0 AS (SELECT d.* FROM dense d JOIN q USING (store_id) WHERE store_id IN (SELECT store_id FROM ok)
          AND (q3 - q1 <= 0 OR (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)))),
kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY store_id ORDER BY sale_date) - 1 AS DOUBLE) AS pos FROM kept0),
fit AS (SELECT store_id, regr_slope(value, pos) AS b1, regr_intercept(value, pos) AS b0, count(*) AS n, max(sale_date) AS last,
               avg(value) AS mean, stddev_pop(value) AS sd_y FROM kept GROUP BY 1 HAVING count(*) >= 2),
res AS (SELECT kept.store_id, stddev_pop(value - (b1 * pos + b0)) AS sd_r FROM kept JOIN fit USING (store_id) GROUP BY 1),
f AS (SELECT fit.*, CASE WHEN s IS NULL OR isnan(s) OR s <= 0 THEN mean * 0.1 ELSE s END AS sd FROM (
        SELECT fit.*, CASE WHEN n > 2 THEN sd_r ELSE sd_y END AS s FROM fit JOIN res USING (store_id)) fit),
g AS (SELECT store_id, last, i, sd, greatest(0.0, b1 * (n + i - 1) + b0) AS val FROM f, range(1, 31) r(i))
SELECT store_id, strftime(last + CAST(i AS INTEGER), '%Y-%m-%d') AS date, round_even(val, 2) AS value,
       round_even(greatest(0.0, val - 1.96 * sd), 2) AS lower, round_even(val + 1.96 * sd, 2) AS upper FROM g"""))
def d6(spark, d):
    return D.store_sales_forecast(tpch_sales(spark, d))


@register("d7_mean_forecast", with_sales(DENSE + """,
q AS (SELECT store_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM dense GROUP BY 1 HAVING count(*) >= 2),
kept AS (SELECT d.* FROM dense d JOIN q USING (store_id)
         WHERE q3 <= q1 OR value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
m AS (SELECT store_id, avg(value) AS m, max(sale_date) AS last FROM kept GROUP BY 1 HAVING count(*) >= 2)
SELECT store_id, strftime(last + CAST(i AS INTEGER), '%Y-%m-%d') AS date, round_even(m, 2) AS value,
       round_even(m * 0.85, 2) AS lower, round_even(m * 1.15, 2) AS upper FROM m, range(1, 31) r(i)"""))
def d7(spark, d):
    return D.mean_forecast(tpch_sales(spark, d))


def _quarterly(spark, d):
    s = tpch_sales(spark, d).filter(F.col("sale_date").isNotNull())
    return s.groupBy("product_id", (F.year("sale_date") * 4 + F.quarter("sale_date") - 1).alias("qi")) \
            .agg(F.sum(F.coalesce("quantity", F.lit(0))).alias("q"))


@register("d10_quarter_growth_fallback", with_sales(""",
q AS (SELECT product_id, year(sale_date) * 4 + quarter(sale_date) - 1 AS qi, sum(coalesce(quantity, 0)) AS q
      FROM sales WHERE sale_date IS NOT NULL GROUP BY 1, 2),
t AS (SELECT *, lag(q) OVER (PARTITION BY product_id ORDER BY qi) AS prev FROM q),
l AS (SELECT product_id, max(qi) AS qi0, arg_max({'q': q, 'prev': prev}, qi) AS r FROM t
      GROUP BY 1 HAVING count(*) >= 2),
g AS (SELECT product_id, qi0, CAST(r.q AS DOUBLE) AS q0,
             least(greatest(CASE WHEN r.prev > 0 THEN (r.q - r.prev) / r.prev ELSE 0.0 END, -0.25), 0.25) AS growth FROM l),
f AS (SELECT g.*, i, qi0 + i AS qi FROM g, range(1, 7) r(i))
SELECT product_id, CAST(floor(qi / 4) AS INTEGER) || '-Q' || CAST(qi % 4 + 1 AS INTEGER) AS month,
       round_even(growth, 4) AS growth, CAST(round(CAST(q0 * pow(1 + growth, i) AS DECIMAL(38, 6)), 2) AS DOUBLE) AS yhat
FROM f"""))
def d10(spark, d):
    return D.quarter_growth_fallback(_quarterly(spark, d))


def _r6(x: str, n: int = 2) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38, 6)), {n}) AS DOUBLE)"


def _whole(x: str) -> str:
    return f"format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT))"


@register("d10_fallback_chart", with_sales(f""",
q AS (SELECT product_id, year(sale_date) * 4 + quarter(sale_date) - 1 AS qi, CAST(sum(coalesce(quantity, 0)) AS DOUBLE) AS q
      FROM sales WHERE sale_date IS NOT NULL GROUP BY 1, 2),
t AS (SELECT *, lag(q) OVER (PARTITION BY product_id ORDER BY qi) AS prev FROM q),
l AS (SELECT product_id, max(qi) AS qi0, arg_max({{'q': q, 'prev': prev}}, qi) AS r FROM t
      GROUP BY 1 HAVING count(*) >= 2 AND max(qi) >= {4 * BASE_YEARS[0]}),
f AS (SELECT product_id, qi0 + i AS qi, i, least(greatest(CASE WHEN r.prev > 0 THEN (r.q - r.prev) / r.prev ELSE 0.0 END, -0.25), 0.25) AS g,
             r.q AS q0 FROM l, range(1, 7) AS s(i)),
y AS (SELECT *, greatest(q0 * pow(1 + g, i), 0.0) AS y FROM f),
both_ AS (SELECT product_id, qi, round_even(q, 2) AS yhat, round_even(q, 2) AS yhat_lower, round_even(q, 2) AS yhat_upper,
                 CAST(NULL AS DOUBLE) AS store_stock_quantity, '판매 실적: ' || {_whole('q')} || '대' AS sales_label,
                 '당분기 재고 기준 (실적)' AS stock_label, '과거 실적' AS message
          FROM q WHERE qi >= {4 * BASE_YEARS[0]} AND product_id IN (SELECT product_id FROM l)
          UNION ALL
          SELECT product_id, qi, {_r6('y')}, {_r6('y * 0.85')}, {_r6('y * 1.15')}, {_r6('y * 1.125')},
                 '예측 판매량: ' || {_whole(_r6('y', 6))} || '대', '권장 재고: ' || {_whole(_r6('y * 1.15', 6))} || '대 (상한선 기준)',
                 CASE WHEN i = 1 AND g > 0.07 THEN '수요 증가 추세 — 선제적 발주 권장'
                      WHEN i = 1 AND g < -0.07 THEN '수요 감소 추세 — 재고 과잉 주의' ELSE '적정 재고 유지' END FROM y)
SELECT * EXCLUDE (qi), CAST(floor(qi / 4) AS INTEGER) || '-Q' || CAST(qi % 4 + 1 AS INTEGER) AS month FROM both_"""))
def d10_chart(spark, d):
    return D.growth_fallback_chart(tpch_sales(spark, d), BASE_YEARS[0])


def _d11_sql():
    from shelfcast.plans.q_demand import A9_BODY, _QSUM
    from shelfcast.plans.q_inventory import D8_CTES
    return with_sales(A9_BODY + D8_CTES + f""",
a9 AS (SELECT * FROM o WHERE {_QSUM} + predicted_quantity > 0)
SELECT product_id, month, yhat, false AS is_predicted FROM d8 WHERE CAST(substr(month, 1, 4) AS INTEGER) < {TARGET_YEAR}
UNION ALL
SELECT product_id, '{TARGET_YEAR}-Q' || CAST(qq AS INTEGER), round_even(predicted_quantity / 4.0, 2), true
FROM a9, range(1, 5) r(qq)""", launch=True)


@register("d11_chart_override", _d11_sql())
def d11(spark, d):
    from shelfcast.operators import demand as A
    from shelfcast.operators.inventory import quarter_demand_chart
    s = tpch_sales(spark, d)
    return D.chart_override(quarter_demand_chart(s), A.product_year_pivot(s).select("product_id", "predicted_quantity"),
                            TARGET_YEAR)


def _d12_sql():
    from shelfcast.plans.q_inventory import D12_SQL
    return D12_SQL


@register("d12_actual_predicted_merge", _d12_sql())
def d12(spark, d):
    from shelfcast.operators.inventory import quarter_demand_chart, quarter_forecast_share
    s = tpch_sales(spark, d)
    return D.actual_predicted_merge(quarter_demand_chart(s), quarter_forecast_share(s))


@register("g4_price_demand_scatter", with_sales("""
SELECT product_name, CAST(round(CAST(p AS DECIMAL(38, 6)), 2) AS DOUBLE) AS price, CAST(round_even(q, 0) AS BIGINT) AS quantity FROM (
  SELECT trim(product_name) AS product_name, total_sales / quantity AS p, CAST(quantity AS DOUBLE) AS q,
         row_number() OVER (PARTITION BY trim(product_name) ORDER BY sale_date, sale_id) AS rn
  FROM sales WHERE quantity IS NOT NULL AND total_sales IS NOT NULL AND total_sales / quantity IS NOT NULL)
WHERE rn <= 500"""))
def g4s(spark, d):
    s = tpch_sales(spark, d).withColumn("unit_price", F.col("total_sales") / F.col("quantity"))
    return G.price_demand_scatter(s, price_col="unit_price")
