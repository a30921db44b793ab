"""Registered queries with what a user selects: region, store name, category,
status, quarter (P2-P6), scalar functions over real columns (F4-F16), and the
preparation jobs whose rules fire on the data (K1, K2, K6, J8, I19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.functions import geo, text
from shelfcast.operators import demand as A
from shelfcast.operators import filters as P
from shelfcast.operators import inventory as I
from shelfcast.operators import prep as K
from shelfcast.operators import sales as S
from shelfcast.plans.catalog import MS, register, sql_cents_to_int as RC, sql_norm_text as NT, sql_years
from shelfcast.plans.q_demand import A10_SQL, A9_BODY
from shelfcast.plans.q_inventory import FIRST, LIST, SNAP, snap
from shelfcast.sources.tpch import BASE_YEARS, table, tpch_sales, with_sales

Y = sql_years(*BASE_YEARS)
Q = "CAST(sum(coalesce(quantity, 0)) AS BIGINT) AS quantity"
NATION, REGION, STORE = "NATION_7", "ASIA", "Supplier#000000003"


# ---- regions (P2) --------------------------------------------------------------
@register("p2_sales_of_region", with_sales(f"""
SELECT city, store_id, {Q} FROM sales
WHERE lower(trim(country)) = 'nation_7' AND trim(continent) = (SELECT continent FROM sales WHERE country = '{NATION}' LIMIT 1)
GROUP BY city, store_id"""))
def p2(spark, d):
    """Quoted and lower-case spellings of a country and its continent."""
    s = tpch_sales(spark, d)
    nations, regions = table(spark, d, "nation"), table(spark, d, "region")
    of = nations.filter(F.col("n_name") == NATION).join(regions, F.col("n_regionkey") == F.col("r_regionkey")).first()["r_name"]
    return (P.region_filter(s, continent=f"'{of}'", country=" nation_7 ").groupBy("city", "store_id")
            .agg(F.sum(F.coalesce("quantity", F.lit(0))).cast("long").alias("quantity")))


_NATION = f"AND upper(trim(country)) = '{NATION}'"


@register("a2_of_store", with_sales(f"""
SELECT {NT('store_id')} AS store_id, sale_year AS year, {NT('category_name')} AS category, {Q}
FROM sales WHERE {Y} AND store_id = '3' GROUP BY 1, 2, 3"""))
def a2(spark, d):
    return A.store_category_year(tpch_sales(spark, d), store_id="3")


@register("a3_of_country", with_sales(f"""
SELECT {NT('country')} AS country, sale_year AS year, {NT('category_name')} AS category, {Q}
FROM sales WHERE {Y} {_NATION} GROUP BY 1, 2, 3"""))
def a3(spark, d):
    return A.country_category_year(tpch_sales(spark, d), country=NATION)


@register("a6_of_continent", with_sales(f"""
SELECT continent, {NT('country')} AS country, {NT('category_name')} AS category, {Q}
FROM sales WHERE {Y} AND continent = '{REGION}' GROUP BY 1, 2, 3"""))
def a6(spark, d):
    return A.continent_country_category(tpch_sales(spark, d), continent=REGION)


_SUM = " + ".join(f"quantity_{y}" for y in range(BASE_YEARS[0], BASE_YEARS[1] + 1))


@register("a9_of_country", with_sales(A9_BODY.replace(f"sales_l WHERE {Y}", f"sales_l WHERE {Y} {_NATION}") + f"""
SELECT * FROM o WHERE {_SUM} + predicted_quantity > 0""", launch=True))
def a9(spark, d):
    return A.product_year_pivot(tpch_sales(spark, d, launch=True), country="nation_7")


@register("a10_of_country", with_sales(A10_SQL.replace(f"s AS (SELECT * FROM sales WHERE {Y})",
                                                       f"s AS (SELECT * FROM sales WHERE {Y} {_NATION})")))
def a10(spark, d):
    return A.category_year_pivot(tpch_sales(spark, d), country="nation_7")


@register("b3_of_country", with_sales(f"""
SELECT trim(store_name) AS store_name, {RC(MS)} AS total_sales FROM sales WHERE {Y} AND country = '{NATION}'
GROUP BY 1 ORDER BY total_sales DESC, store_name LIMIT 50"""))
def b3(spark, d):
    return S.sales_by_store_name(tpch_sales(spark, d), BASE_YEARS, country=NATION)


# ---- one store by name (P3) ----------------------------------------------------
@register("b5_of_store", with_sales(f"""
SELECT sale_year || '-Q' || quarter(sale_date) AS period, sale_year AS year, CAST(quarter(sale_date) AS INTEGER) AS quarter,
       {RC(MS)} AS total_sales
FROM sales WHERE {Y} AND store_name = '{STORE}' GROUP BY sale_year, quarter(sale_date)"""))
def b5(spark, d):
    """The name as given in parentheses behind another one."""
    return S.store_quarter_sales(tpch_sales(spark, d), store_name=f"third store ( {STORE} )", years=BASE_YEARS)


@register("b6_of_store", with_sales(f"""
SELECT sale_year || '-Q' || quarter(sale_date) AS period, sale_year AS year, CAST(quarter(sale_date) AS INTEGER) AS quarter,
       trim(category_name) AS category, {RC(MS)} AS total_sales
FROM sales WHERE {Y} AND store_name = '{STORE}' GROUP BY sale_year, quarter(sale_date), trim(category_name)"""))
def b6(spark, d):
    return S.store_quarter_category_sales(tpch_sales(spark, d), store_name=STORE.lower(), years=BASE_YEARS)


# ---- category, quarter, status (P4-P6) -----------------------------------------
@register("p4_category_by_country", with_sales(f"""
SELECT country, {Q} FROM sales WHERE category_name = 'PROMO' GROUP BY country"""))
def p4(spark, d):
    return (P.category_filter(tpch_sales(spark, d), " promo ").groupBy("country")
            .agg(F.sum(F.coalesce("quantity", F.lit(0))).cast("long").alias("quantity")))


@register("p5_list_of_status", with_sales(SNAP + LIST + "\nSELECT * FROM lst WHERE status IN ('Danger', 'Overstock')"))
def p5(spark, d):
    return P.status_filter(I.inventory_list(snap(spark, d)), text.status_list("Danger, 과잉,위험"))


@register("i14_of_category", with_sales(f"""
SELECT trim(category_name) AS category, year(sale_date) || '-Q' || quarter(sale_date) AS period, store_name, country, continent, {Q}
FROM sales WHERE category_name = 'SMALL' AND country = '{NATION}' GROUP BY ALL"""))
def i14(spark, d):
    return I.quarter_store_matrix(tpch_sales(spark, d), category="small", country=NATION)


@register("i15_of_quarter", with_sales(f"""
SELECT trim(category_name) AS category, product_id, {FIRST.format(c='product_name')} AS product_name, {Q}
FROM sales WHERE sale_date >= DATE '1998-10-01' AND sale_date < DATE '1999-01-01' AND continent = '{REGION}' GROUP BY 1, 2"""))
def i15(spark, d):
    return I.sales_by_product(tpch_sales(spark, d), continent=REGION, period="1998-Q4")


# ---- scalar functions over columns (F4-F8, F11, F14-F16) -----------------------
_COUNTRIES = sorted(geo.COUNTRY_KO)


@register("f4_store_names", """
SELECT s_suppkey, s_name AS bare_name, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS name_key,
       s_name || '(' || n_name || ')' AS full_name, CAST(s_suppkey AS BIGINT) AS user_id, CAST(s_suppkey AS BIGINT) AS any_user_id
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def f4(spark, d):
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select("s_suppkey", text.strip_brand_store(F.concat(F.lit(" apple store "), "s_name")).alias("bare_name"),
                    text.norm_name_key("s_name").alias("name_key"),
                    text.norm_parens(F.concat(F.col("s_name"), F.lit(" ( "), F.col("n_name"), F.lit(" ) "))).alias("full_name"),
                    text.store_user_id(F.concat(F.lit("st-"), "s_suppkey")).alias("user_id"),
                    text.store_user_id(F.concat(F.lit("store "), "s_suppkey")).alias("any_user_id"))


_KO = ", ".join(f"({i}, '{c}', '{geo.COUNTRY_KO[c]}')" for i, c in enumerate(_COUNTRIES))


@register("f7_country_labels", f"""
SELECT c_custkey, en AS country, ko || '(' || en || ')' AS label
FROM customer JOIN (VALUES {_KO}) AS t(i, en, ko) ON i = c_custkey % {len(_COUNTRIES)}""")
def f7(spark, d):
    """Customers, dealt to the known countries by key, their country given in Korean."""
    ko = F.element_at(F.array(*[F.lit(geo.COUNTRY_KO[c]) for c in _COUNTRIES]),
                      (F.col("c_custkey") % len(_COUNTRIES) + 1).cast("int"))
    c = table(spark, d, "customer").select("c_custkey", geo.resolve_country(F.concat(F.lit(" "), ko)).alias("country"))
    return c.select("c_custkey", "country", geo.display_label("country", "country").alias("label"))


@register("f14_status_words", with_sales(SNAP + "\nSELECT sale_id, status, sale_id || ' (' || substr(product_name, 1, 18) || ')' AS label FROM snap"))
def f14(spark, d):
    """Statuses given as Korean words, and sale labels (F16)."""
    ko = F.create_map(*[F.lit(x) for k, v in text.STATUS_WORDS.items() for x in (v, k)])
    return snap(spark, d).select("sale_id", text.status_normalize(F.concat(ko[F.col("status")], F.lit(" "))).alias("status"),
                                 text.sale_label("sale_id", "product_name").alias("label"))


@register("f15_clamped_values", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 5.0 ELSE least(greatest(coalesce(value, 5.0), 2.0), 15.0) END AS value FROM events""")
def f15(spark, d):
    """Event values as text, unreadable for errors, between 2 and 15."""
    raw = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return table(spark, d, "events").select("event_id", text.safe_float_clamp(raw, 5.0, 2.0, 15.0).alias("value"))


# ---- preparation jobs ----------------------------------------------------------
@register("k1_dedup_lines", """
SELECT l_orderkey || '-' || l_linenumber AS sale_id, min(strftime(l_shipdate, '%Y-%m-%d')) AS sale_date
FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def k1(spark, d):
    """Order lines by (order, line number), which repeat: the first shipped stays."""
    li = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sale_id"),
                                            F.date_format("l_shipdate", "yyyy-MM-dd").alias("sale_date"))
    return K.dedup_sales(li)


@register("k2_coerced_lines", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN l_linenumber = 2 THEN 0 ELSE CAST(trunc(l_quantity) AS INTEGER) END AS quantity,
       CASE WHEN l_linenumber = 3 THEN 0.0 ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) END AS price,
       CASE WHEN l_linenumber <> 4 THEN strftime(l_shipdate, '%Y-%m-%d') END AS sale_date,
       CASE WHEN l_returnflag = 'R' THEN 'R' ELSE 'Normal' END AS status FROM lineitem""")
def k2(spark, d):
    """Order lines as text with unreadable numbers and dates and blank statuses."""
    n = F.col("l_linenumber")
    raw = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(n == 2, "two").otherwise(F.col("l_quantity").cast("string")).alias("quantity"),
        F.when(n == 3, "").otherwise(F.col("l_extendedprice").cast("string")).alias("price"),
        F.when(n == 4, "soon").otherwise(F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(" 10:00"))).alias("sale_date"),
        F.when(F.col("l_returnflag") == "R", "R ").otherwise(" ").alias("status"))
    out = K.coerce_sales(raw)
    return out.withColumns({"price": F.col("price").cast("double"), "sale_date": F.date_format("sale_date", "yyyy-MM-dd")})


@register("k6_enriched_sales", with_sales(SNAP + """,
patch AS (SELECT sale_date, store_id, regexp_replace(lower(product_name), '[^a-z0-9]', '', 'g') AS k, quantity, price,
                 arg_min(inventory, sale_id) AS inventory, arg_min(safety_stock, sale_id) AS safety_stock,
                 arg_min(status, sale_id) AS status
          FROM snap WHERE status <> 'Normal' GROUP BY ALL)
SELECT s.sale_id, CASE WHEN patch.k IS NULL THEN 'not_found' ELSE 'matched' END AS match,
       patch.inventory, patch.safety_stock, patch.status
FROM sales s LEFT JOIN patch ON patch.sale_date = s.sale_date AND patch.store_id = s.store_id AND patch.quantity = s.quantity
     AND patch.price = s.price AND patch.k = regexp_replace(lower(s.product_name), '[^a-z0-9]', '', 'g')"""))
def k6(spark, d):
    """Sales patched with the stock rows that are not normal; repeated keys: the first by sale_id."""
    patch = snap(spark, d).filter("status <> 'Normal'").withColumn("ingest_order", F.col("sale_id"))
    patch = K.synth_store_stock(patch)
    out = K.enrich_inventory(tpch_sales(spark, d), patch)
    return out.select("sale_id", F.col("_match").alias("match"), "inventory", "safety_stock", "status")


@register("j8_stock_signal", with_sales(SNAP + LIST + f"""
SELECT *, CASE WHEN safety_stock <= 0 THEN 'green' WHEN inventory < safety_stock THEN 'red' ELSE 'green' END AS signal FROM lst
WHERE product_name LIKE '%ring%' AND store_name = '{STORE}' ORDER BY frozen_money DESC, store_name, product_id LIMIT 1"""))
def j8(spark, d):
    return I.tolerant_stock_signal(I.inventory_list(snap(spark, d)), "ring", STORE)


@register("i19_after_open_orders", with_sales(SNAP + LIST + """,
open AS (SELECT store_name, product_id, CAST(sum(coalesce(quantity, 0)) AS BIGINT) AS q FROM sales WHERE sale_year = 2000 GROUP BY 1, 2),
left_ AS (SELECT lst.* EXCLUDE (inventory), lst.inventory - coalesce(q, 0) AS inventory FROM lst LEFT JOIN open USING (store_name, product_id))
SELECT * FROM left_ WHERE status = 'Normal' AND inventory < safety_stock"""))
def i19(spark, d):
    """I19 on the list less the last base year's sales as open orders: labels lag behind the stock."""
    s = tpch_sales(spark, d)
    orders = s.filter(f"sale_year = {BASE_YEARS[1]}").groupBy("store_name", "product_id").agg(
        F.sum(F.coalesce("quantity", F.lit(0))).cast("long").alias("_q"))
    lst = I.inventory_list(snap(spark, d)).join(orders, ["store_name", "product_id"], "left")
    lst = lst.withColumn("inventory", F.col("inventory") - F.coalesce("_q", F.lit(0))).drop("_q")
    return I.normal_below_safety(lst)


# ---- overview with stock --------------------------------------------------------
@register("b13_overview_with_stock", with_sales(SNAP + f""",
s AS (SELECT {MS} AS t, count(*) AS n, max(sale_date) AS last FROM sales)
SELECT 'summary' AS section, 'total_sales' AS key, round_even(t / 100.0, 2) AS sales, n FROM s
UNION ALL SELECT 'summary', 'avg_order_value', round_even(CASE WHEN n > 0 THEN t / 100.0 / n ELSE 0 END, 2), n FROM s
UNION ALL SELECT 'summary', 'last_updated:' || strftime(last, '%Y-%m-%d'), NULL, NULL FROM s
UNION ALL SELECT 'category', category_name, round_even({MS} / 100.0, 0), NULL FROM sales GROUP BY category_name
UNION ALL SELECT 'country', key, round_even(t / 100.0, 0), NULL FROM (
   SELECT country AS key, {MS} AS t FROM sales GROUP BY country ORDER BY t DESC, key LIMIT 10)
UNION ALL SELECT 'product', key, round_even(t / 100.0, 0), NULL FROM (
   SELECT product_name AS key, {MS} AS t FROM sales GROUP BY product_name ORDER BY t DESC, key LIMIT 10)
UNION ALL SELECT 'inventory_status', status, NULL, count(*) FROM snap GROUP BY status"""))
def b13(spark, d):
    return S.retail_overview(tpch_sales(spark, d), snapshot=snap(spark, d))
