"""Registered sales queries (B family) with their DuckDB oracles."""

from __future__ import annotations

from shelfcast.operators import sales as S
from shelfcast.plans.catalog import MS, register, sql_cents_to_int as RC, sql_round_int as RI, sql_years
from shelfcast.sources.tpch import BASE_YEARS, tpch_sales, with_sales

Y = sql_years(*BASE_YEARS)

B1_SQL = f"""SELECT trim(store_id) AS store_id, trim(city) AS city, trim(country) AS country,
       {RC(MS)} AS total_sales
FROM sales WHERE {Y} GROUP BY store_id, city, country"""


@register("b1_store_sales", with_sales(B1_SQL))
def b1(spark, d):
    return S.store_sales(tpch_sales(spark, d), BASE_YEARS)


@register("b2_store_year_sales", with_sales(f"""
SELECT store_id, city, country, sale_year AS year, {RC(MS)} AS total_sales
FROM sales WHERE {Y} GROUP BY store_id, city, country, sale_year"""))
def b2(spark, d):
    return S.store_year_sales(tpch_sales(spark, d), BASE_YEARS)


DISPLAY = ("CASE WHEN coalesce(trim(regexp_replace(trim(_raw), '^(?i)(apple\\s|애플\\s)', '')), '') = '' "
           "THEN '(미지정)' ELSE trim(regexp_replace(trim(_raw), '^(?i)(apple\\s|애플\\s)', '')) END")


@register("b3_sales_by_store_name", with_sales(f""",
agg AS (SELECT trim(store_name) AS _raw, {RC(MS)} AS total_sales
        FROM sales WHERE {Y} GROUP BY trim(store_name))
SELECT store_name, total_sales FROM (
  SELECT {DISPLAY} AS store_name, total_sales, _raw FROM agg)
ORDER BY total_sales DESC, store_name, _raw LIMIT 50"""))
def b3(spark, d):
    return S.sales_by_store_name(tpch_sales(spark, d), BASE_YEARS)


@register("b4_sales_by_store_name_year", with_sales(f""",
per AS (SELECT {DISPLAY} AS store_name, year, total_sales FROM (
          SELECT trim(store_name) AS _raw, sale_year AS year, {RC(MS)} AS total_sales
          FROM sales WHERE {Y} GROUP BY trim(store_name), sale_year)),
leaders AS (SELECT store_name FROM per GROUP BY store_name ORDER BY sum(total_sales) DESC, store_name LIMIT 15)
SELECT store_name, year, total_sales FROM per WHERE store_name IN (SELECT store_name FROM leaders)"""))
def b4(spark, d):
    return S.sales_by_store_name_year(tpch_sales(spark, d), BASE_YEARS)


@register("b5_store_quarter_sales", with_sales(f"""
SELECT store_name, sale_year || '-Q' || quarter(sale_date) AS period, sale_year AS year,
       CAST(quarter(sale_date) AS INTEGER) AS quarter, {RC(MS)} AS total_sales
FROM sales WHERE {Y} AND sale_date IS NOT NULL GROUP BY store_name, sale_year, quarter(sale_date), sale_date IS NULL"""))
def b5(spark, d):
    return S.store_quarter_sales(tpch_sales(spark, d), years=BASE_YEARS)


@register("b6_store_quarter_category_sales", with_sales(f"""
SELECT store_name, sale_year || '-Q' || quarter(sale_date) AS period, sale_year AS year,
       CAST(quarter(sale_date) AS INTEGER) AS quarter,
       CASE WHEN trim(coalesce(category_name, '')) = '' THEN '(미분류)' ELSE trim(category_name) END AS category,
       {RC(MS)} AS total_sales
FROM sales WHERE {Y} AND sale_date IS NOT NULL
GROUP BY store_name, sale_year, quarter(sale_date),
         CASE WHEN trim(coalesce(category_name, '')) = '' THEN '(미분류)' ELSE trim(category_name) END"""))
def b6(spark, d):
    return S.store_quarter_category_sales(tpch_sales(spark, d), years=BASE_YEARS)


@register("b7_sales_by_city", with_sales(f""", b1 AS ({B1_SQL})
SELECT CASE WHEN city = '' THEN '(미지정)' ELSE city END AS city,
       CASE WHEN country = '' THEN '(미지정)' ELSE country END AS country,
       CAST(sum(total_sales) AS BIGINT) AS total_sales
FROM b1 WHERE city <> '' OR country <> '' GROUP BY 1, 2"""))
def b7(spark, d):
    return S.sales_by_city(tpch_sales(spark, d), BASE_YEARS)


@register("b8_sales_by_country", with_sales(f""", b1 AS ({B1_SQL})
SELECT country, CAST(sum(total_sales) AS BIGINT) AS total_sales FROM b1 WHERE country <> '' GROUP BY country"""))
def b8(spark, d):
    return S.sales_by_country(tpch_sales(spark, d), BASE_YEARS)


@register("b9_country_category_sales", with_sales(f"""
SELECT country, CASE WHEN grouping(category) = 1 THEN NULL WHEN category = '' THEN '(미분류)' ELSE category END AS category,
       {RC(MS)} AS total_sales
FROM (SELECT trim(country) AS country, trim(category_name) AS category, total_sales FROM sales WHERE {Y})
WHERE country <> '' GROUP BY GROUPING SETS ((country), (country, category))"""))
def b9(spark, d):
    return S.country_category_sales(tpch_sales(spark, d), BASE_YEARS)


@register("b10_sales_by_year", with_sales(f""",
b2 AS (SELECT sale_year AS year, {RC(MS)} AS t FROM sales WHERE {Y}
       GROUP BY store_id, city, country, sale_year)
SELECT CAST(y.year AS INTEGER) AS year, CAST(coalesce(sum(b2.t), 0) AS BIGINT) AS total_sales
FROM range({BASE_YEARS[0]}, {BASE_YEARS[1] + 1}) y(year) LEFT JOIN b2 ON b2.year = y.year GROUP BY y.year"""))
def b10(spark, d):
    return S.sales_by_year(tpch_sales(spark, d), BASE_YEARS)


@register("b12_sales_box", with_sales(f""", b1 AS ({B1_SQL})
SELECT CAST(coalesce(sum(total_sales), 0) AS BIGINT) AS total_sum, count(*) AS store_count FROM b1"""))
def b12(spark, d):
    return S.sales_box(tpch_sales(spark, d), BASE_YEARS)


@register("b13_retail_overview", with_sales(f""",
s AS (SELECT {MS} AS t, count(*) AS n, max(sale_date) AS last FROM sales)
SELECT 'summary' AS section, 'total_sales' AS key, round_even(t / 100.0, 2) AS sales, n FROM s
UNION ALL SELECT 'summary', 'avg_order_value', round_even(CASE WHEN n > 0 THEN t / 100.0 / n ELSE 0 END, 2), n FROM s
UNION ALL SELECT 'summary', 'last_updated:' || strftime(last, '%Y-%m-%d'), NULL, NULL FROM s
UNION ALL SELECT 'category', category_name, round_even({MS} / 100.0, 0), NULL FROM sales GROUP BY category_name
UNION ALL SELECT 'country', key, round_even(t / 100.0, 0), NULL FROM (
   SELECT country AS key, {MS} AS t FROM sales GROUP BY country ORDER BY t DESC, key LIMIT 10)
UNION ALL SELECT 'product', key, round_even(t / 100.0, 0), NULL FROM (
   SELECT product_name AS key, {MS} AS t FROM sales GROUP BY product_name ORDER BY t DESC, key LIMIT 10)
"""))
def b13(spark, d):
    return S.retail_overview(tpch_sales(spark, d))


@register("b14_region_category_pivot", with_sales(f"""
SELECT country, category, {RC('raw')} AS total_sales, {RC('sum(raw) OVER (PARTITION BY country)')} AS country_total_sales
FROM (SELECT trim(country) AS country, trim(category_name) AS category, {MS} AS raw
      FROM sales GROUP BY 1, 2)"""))
def b14(spark, d):
    return S.region_category_pivot(tpch_sales(spark, d))


@register("b15_country_category_share", with_sales(f"""
SELECT country, category, total_sales, pct FROM (
  SELECT country, category, {RC('raw')} AS total_sales,
         round_even(raw / sum(raw) OVER (PARTITION BY country) * 100.0, 1) AS pct,
         sum(raw) OVER (PARTITION BY country) AS tot
  FROM (SELECT trim(country) AS country, trim(category_name) AS category, {MS} AS raw
        FROM sales GROUP BY 1, 2)) WHERE tot > 0"""))
def b15(spark, d):
    return S.country_category_share(tpch_sales(spark, d))


@register("b16_top_products_categories", with_sales(f""",
p AS (SELECT product_name AS name, {MS} AS t FROM sales GROUP BY product_name ORDER BY t DESC, name LIMIT 15),
c AS (SELECT category_name AS name, {MS} AS t FROM sales GROUP BY category_name ORDER BY t DESC, name LIMIT 10)
SELECT 'product' AS kind, coalesce(trim(name), '') AS name, {RC('t')} AS sales,
       CAST(row_number() OVER (ORDER BY t DESC, name) AS INTEGER) AS rank FROM p
UNION ALL
SELECT 'category', coalesce(trim(name), ''), {RC('t')}, CAST(row_number() OVER (ORDER BY t DESC, name) AS INTEGER) FROM c"""))
def b16(spark, d):
    return S.top_products_categories(tpch_sales(spark, d))


@register("b17_sale_top15", with_sales(f"""
SELECT sale_id, coalesce(product_name, '') AS product, {RI('coalesce(total_sales, 0)')} AS total_sales,
       CASE WHEN trim(coalesce(product_name, '')) <> '' THEN sale_id || ' (' || substr(coalesce(product_name, ''), 1, 18) || ')'
            ELSE sale_id END AS label
FROM sales ORDER BY coalesce(total_sales, 0) DESC, sale_id LIMIT 15"""))
def b17(spark, d):
    return S.sale_top15(tpch_sales(spark, d))


@register("b18_continent_country_rollup", with_sales(f""", b1 AS ({B1_SQL}),
sc AS (SELECT store_id, arg_min(continent, (sale_date, sale_id)) AS continent FROM sales GROUP BY store_id),
j AS (SELECT b1.*, sc.continent FROM b1 LEFT JOIN sc USING (store_id)),
r AS (SELECT continent, country, CAST(sum(total_sales) AS BIGINT) AS total_sales, grouping(continent, country) AS g
      FROM j GROUP BY ROLLUP (continent, country))
SELECT CASE WHEN g = 1 THEN 'continent' ELSE 'country' END AS level, continent, country, total_sales,
       round_even(total_sales / sum(total_sales) OVER (PARTITION BY g, CASE WHEN g = 1 THEN NULL ELSE continent END) * 100.0, 1) AS pct
FROM r WHERE g < 3"""))
def b18(spark, d):
    return S.continent_country_rollup(tpch_sales(spark, d), BASE_YEARS)


@register("b19_period_category_matrix", with_sales(f""",
cells AS (SELECT sale_year || '-Q' || quarter(sale_date) AS period, trim(category_name) AS category,
                 {MS} AS raw
          FROM sales WHERE {Y} AND sale_date IS NOT NULL GROUP BY 1, 2)
SELECT period, category, {RC('raw')} AS total_sales,
       round_even(sum(raw) OVER (PARTITION BY category) / (SELECT sum(raw) FROM cells) * 100.0, 1) AS category_pct
FROM cells"""))
def b19(spark, d):
    return S.period_category_matrix(tpch_sales(spark, d), BASE_YEARS)


@register("b20_store_list", with_sales("""
SELECT trim(store_id) AS store_id, coalesce(trim(arg_min(store_name, (sale_date, sale_id))), trim(store_id)) AS store_name,
       coalesce(trim(arg_min(country, (sale_date, sale_id)) FILTER (WHERE country IS NOT NULL)), '') AS country
FROM sales GROUP BY trim(store_id)"""))
def b20(spark, d):
    return S.store_list(tpch_sales(spark, d))


@register("b21_store_summary", with_sales(f"""
SELECT trim(store_id) AS store_id, round_even({MS} / 100.0, 2) AS total_sales,
       count(DISTINCT product_name) AS product_count, arg_min(store_name, (sale_date, sale_id)) AS store_name
FROM sales GROUP BY trim(store_id)"""))
def b21(spark, d):
    return S.store_summary(tpch_sales(spark, d))


@register("b22_last_updated", with_sales("SELECT strftime(max(sale_date), '%Y-%m-%d') AS last_updated FROM sales"))
def b22(spark, d):
    return S.last_updated(tpch_sales(spark, d))


@register("b23_stores_of_country", with_sales(f""", b1 AS ({B1_SQL})
SELECT *, CAST(row_number() OVER (PARTITION BY country ORDER BY total_sales DESC, store_id) AS INTEGER) AS rank FROM b1"""))
def b23(spark, d):
    return S.stores_of_country(tpch_sales(spark, d), years=BASE_YEARS)


@register("b24_store_list_by_region", with_sales("""
SELECT trim(store_id) AS store_id, coalesce(trim(arg_min(store_name, (sale_date, sale_id))), trim(store_id)) AS store_name,
       coalesce(trim(arg_min(country, (sale_date, sale_id)) FILTER (WHERE country IS NOT NULL)), '') AS country,
       coalesce(arg_min(continent, (sale_date, sale_id)), '') AS continent
FROM sales GROUP BY trim(store_id)"""))
def b24(spark, d):
    return S.store_list_by_region(tpch_sales(spark, d))
