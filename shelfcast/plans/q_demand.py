"""Registered demand queries (A family) with their DuckDB oracles."""

from __future__ import annotations

from shelfcast.operators import demand as A
from shelfcast.plans.catalog import register, sql_forecast_ctes, sql_norm_text as NT, sql_years
from shelfcast.sources.tpch import BASE_YEARS, TARGET_YEAR, tpch_sales, with_sales

Y = sql_years(*BASE_YEARS)
YS = list(range(BASE_YEARS[0], BASE_YEARS[1] + 1))
QS = "CAST(sum(coalesce(quantity, 0)) AS BIGINT)"
FC = sql_forecast_ctes(BASE_YEARS, TARGET_YEAR)


@register("a1_city_category_year", with_sales(f"""
SELECT {NT('city')} AS city, sale_year AS year, {NT('category_name')} AS category, {QS} AS quantity
FROM sales WHERE {Y} GROUP BY 1, 2, 3"""))
def a1(spark, d):
    return A.city_category_year(tpch_sales(spark, d))


@register("a2_store_category_year", with_sales(f"""
SELECT {NT('store_id')} AS store_id, sale_year AS year, {NT('category_name')} AS category, {QS} AS quantity
FROM sales WHERE {Y} GROUP BY 1, 2, 3"""))
def a2(spark, d):
    return A.store_category_year(tpch_sales(spark, d))


@register("a3_country_category_year", with_sales(f"""
SELECT {NT('country')} AS country, sale_year AS year, {NT('category_name')} AS category, {QS} AS quantity
FROM sales WHERE {Y} GROUP BY 1, 2, 3"""))
def a3(spark, d):
    return A.country_category_year(tpch_sales(spark, d))


@register("a4_country_store_category", with_sales(f"""
SELECT {NT('country')} AS country, {NT('store_id')} AS store_id, {NT('city')} AS city,
       {NT('category_name')} AS category, {QS} AS quantity
FROM sales WHERE {Y} GROUP BY 1, 2, 3, 4"""))
def a4(spark, d):
    return A.country_store_category(tpch_sales(spark, d))


@register("a5_continent_category_year", with_sales(f"""
SELECT continent, year, category, CAST(sum(q) AS BIGINT) AS quantity FROM (
  SELECT coalesce(continent, 'Other') AS continent, sale_year AS year, {NT('category_name')} AS category,
         coalesce(quantity, 0) AS q FROM sales WHERE {Y}) WHERE continent <> 'Other'
GROUP BY GROUPING SETS ((continent, year, category), (continent, category))"""))
def a5(spark, d):
    return A.continent_category_year(tpch_sales(spark, d))


@register("a6_continent_country_category", with_sales(f"""
SELECT coalesce(continent, 'Other') AS continent, {NT('country')} AS country, {NT('category_name')} AS category,
       {QS} AS quantity FROM sales WHERE {Y} GROUP BY 1, 2, 3"""))
def a6(spark, d):
    return A.continent_country_category(tpch_sales(spark, d))


@register("a7_store_product_qty", with_sales(f""",
s AS (SELECT *, {NT('product_id')} AS _pid FROM sales WHERE {Y}),
names AS (SELECT _pid, arg_min(product_name, (sale_date, sale_id)) FILTER (WHERE product_name IS NOT NULL) AS _pname
          FROM s GROUP BY _pid),
agg AS (SELECT {NT('store_id')} AS store_id, {NT('city')} AS city, _pid, {QS} AS quantity FROM s GROUP BY 1, 2, 3)
SELECT store_id, city, agg._pid AS product_id,
       CASE WHEN trim(_pname) IS NULL OR trim(_pname) = '' THEN agg._pid ELSE trim(_pname) END AS product_name, quantity
FROM agg LEFT JOIN names USING (_pid) WHERE quantity > 0"""))
def a7(spark, d):
    return A.store_product_qty(tpch_sales(spark, d))


@register("a8_yearly_quantity", with_sales(f"""
SELECT sale_year AS year, {QS} AS quantity FROM sales WHERE {Y} GROUP BY ROLLUP (sale_year)"""))
def a8(spark, d):
    from shelfcast.operators.forecast import yearly_quantity
    return yearly_quantity(tpch_sales(spark, d))


_QCOLS = ", ".join(f"CAST(coalesce(sum(CASE WHEN sale_year = {y} THEN coalesce(quantity, 0) END), 0) AS BIGINT) AS quantity_{y}"
                   for y in YS)
_QSUM = " + ".join(f"quantity_{y}" for y in YS)
_QLIST = ", ".join(f"quantity_{y}" for y in YS)
_PRED = ("CAST(CASE WHEN t.tq > 0 AND fc.predicted_quantity > 0 AND ({qs}) > 0 THEN "
         "greatest(0, CAST(round_even(fc.predicted_quantity * (({qs}) / t.tq), 0) AS BIGINT)) ELSE 0 END AS BIGINT)")

A9_BODY = f""", {FC},
s9 AS (SELECT * FROM sales_l WHERE {Y}),
t AS (SELECT sum(coalesce(quantity, 0)) AS tq FROM s9),
g AS (SELECT trim(product_id) AS product_id, {_QCOLS},
             arg_min(product_name, (sale_date, sale_id)) AS _name,
             arg_min(category_name, (sale_date, sale_id)) AS _cat,
             arg_min(launch_date, (sale_date, sale_id)) AS _launch
      FROM s9 GROUP BY trim(product_id)),
o AS (SELECT product_id,
             CASE WHEN {NT('_name')} = '' THEN product_id ELSE {NT('_name')} END AS product_name,
             {NT('_cat')} AS category,
             CAST(least(greatest(coalesce(year(_launch), {YS[0]}), {YS[0]}), {TARGET_YEAR}) AS INTEGER) AS launch_year,
             {_QLIST}, {_PRED.format(qs=_QSUM)} AS predicted_quantity
      FROM g, t, fc)"""
A9_SQL = with_sales(A9_BODY + f"""
SELECT * FROM o WHERE {_QSUM} + predicted_quantity > 0""", launch=True)


@register("a9_product_year_pivot", A9_SQL)
def a9(spark, d):
    return A.product_year_pivot(tpch_sales(spark, d, launch=True))


A10_CAT = f"CASE WHEN {NT('category_name')} = '' THEN 'Unknown' ELSE {NT('category_name')} END"
A10_SQL = f""", {FC},
s AS (SELECT * FROM sales WHERE {Y}),
t AS (SELECT sum(coalesce(quantity, 0)) AS tq FROM s),
g AS (SELECT {A10_CAT} AS _cat, {_QCOLS} FROM s GROUP BY 1),
ids AS (SELECT {NT('category_name')} AS _cat2, arg_min(category_id, (sale_date, sale_id)) AS _cid FROM s GROUP BY 1),
o AS (SELECT coalesce(trim(_cid), '') AS category_id, _cat AS category, {_QLIST},
             {_PRED.format(qs=_QSUM)} AS predicted_quantity
      FROM g LEFT JOIN ids ON g._cat = ids._cat2, t, fc)
SELECT * FROM o WHERE {_QSUM} + predicted_quantity > 0"""


@register("a10_category_year_pivot", with_sales(A10_SQL))
def a10(spark, d):
    return A.category_year_pivot(tpch_sales(spark, d))


_UNPIVOT = " UNION ALL ".join([f"SELECT category, {y} AS year, quantity_{y} AS q FROM a10" for y in YS]
                              + [f"SELECT category, {TARGET_YEAR} AS year, predicted_quantity AS q FROM a10"])


@register("a11_category_summary_by_year", with_sales(f"""{A10_SQL.replace('SELECT * FROM o WHERE', ', a10 AS (SELECT * FROM o WHERE')}),
l AS ({_UNPIVOT}),
per AS (SELECT year, CAST(sum(q) AS BIGINT) AS total_quantity, count(*) FILTER (WHERE q > 0) AS category_count FROM l GROUP BY year)
SELECT CAST(y.year AS INTEGER) AS year, CAST(coalesce(total_quantity, 0) AS BIGINT) AS total_quantity,
       CAST(coalesce(category_count, 0) AS BIGINT) AS category_count
FROM range({YS[0]}, {TARGET_YEAR + 1}) y(year) LEFT JOIN per ON per.year = y.year"""))
def a11(spark, d):
    return A.category_summary_by_year(tpch_sales(spark, d))


@register("a13_store_markers", with_sales(f""",
f AS (SELECT {NT('store_id')} AS store_id,
             arg_min({{'city': {NT('city')}, 'country': {NT('country')}, 'raw_name': {NT('store_name')}}}, (sale_date, sale_id)) AS r,
             min((sale_date, sale_id)) AS k
      FROM sales GROUP BY 1),
i AS (SELECT *, row_number() OVER (PARTITION BY r.city ORDER BY k, store_id) - 1 AS idx FROM f)
SELECT store_id, trim(regexp_replace(trim(r.raw_name), '^(?i)(apple\\s|애플\\s)', '')) AS store_name,
       CASE WHEN r.raw_name <> '' THEN trim(regexp_replace(trim(r.raw_name), '^(?i)(apple\\s|애플\\s)', '')) ELSE '' END AS store_name_ko,
       r.city AS city, r.country AS country,
       round_even(0.0 + CASE WHEN idx > 0 THEN ((idx % 3) - 1) * 0.12 ELSE 0.0 END, 6) AS lon,
       round_even(0.0 + CASE WHEN idx > 0 THEN floor(idx / 3) * 0.08 ELSE 0.0 END, 6) AS lat
FROM i"""))
def a13(spark, d):
    return A.store_markers(tpch_sales(spark, d))


@register("a14_category_share", with_sales(f""",
g AS (SELECT {NT('category_name')} AS category, {QS} AS quantity FROM sales WHERE {Y} GROUP BY 1),
t AS (SELECT sum(coalesce(quantity, 0)) AS tq FROM sales WHERE {Y})
SELECT category, quantity, floor(quantity / CASE WHEN coalesce(tq, 0) = 0 THEN 1 ELSE tq END * 1000 + 0.5) / 10.0 AS pct
FROM g, t"""))
def a14(spark, d):
    return A.category_share(tpch_sales(spark, d))


@register("a15_quarter_from_year", with_sales(f""", {FC},
y AS (SELECT sale_year AS year, false AS is_predicted, {QS} AS q FROM sales WHERE {Y} GROUP BY sale_year
      UNION ALL SELECT {TARGET_YEAR}, true, predicted_quantity FROM fc)
SELECT year || '-Q' || quarter AS period, CAST(year AS INTEGER) AS year, CAST(quarter AS INTEGER) AS quarter,
       CAST(floor(q / 4.0 + 0.5) AS BIGINT) AS quantity, is_predicted
FROM y, range(1, 5) r(quarter)"""))
def a15(spark, d):
    return A.quarter_from_year(tpch_sales(spark, d))


@register("a12_demand_dashboard", with_sales(f""",
s AS (SELECT coalesce(continent, 'Other') AS region, {NT('category_name')} AS category, sale_year, coalesce(quantity, 0) AS q FROM sales),
per AS (SELECT region, category, CAST(sum(q) AS BIGINT) AS quantity FROM s WHERE sale_year = {BASE_YEARS[1]}
        GROUP BY 1, 2 HAVING sum(q) > 0),
gl AS (SELECT category, CAST(sum(q) AS BIGINT) AS quantity FROM s WHERE sale_year = {BASE_YEARS[1]} GROUP BY 1 HAVING sum(q) > 0),
missing AS (SELECT DISTINCT region FROM s WHERE region NOT IN (SELECT region FROM per)),
r AS (SELECT region, category, quantity, false AS is_fallback FROM per
      UNION ALL SELECT m.region, g.category, g.quantity, true FROM missing m, gl g)
SELECT *, CAST(sum(quantity) OVER (PARTITION BY region) AS BIGINT) AS total_demand FROM r"""))
def a12(spark, d):
    return A.demand_dashboard(tpch_sales(spark, d))
