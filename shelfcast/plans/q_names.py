"""Registered look-ups of whole tables of names."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.operators import inventory as I
from shelfcast.operators import names as N
from shelfcast.plans.catalog import MS, register
from shelfcast.plans.q_inventory import LIST, SNAP, snap
from shelfcast.sources.tpch import table, tpch_sales, with_sales


def requests(spark, d):
    """Four requests per store, from its number's product: a word of the name, a longer
    name and the end of the store's name, the name at any store, an unknown name."""
    both = table(spark, d, "supplier").join(table(spark, d, "part"), F.col("s_suppkey") == F.col("p_partkey"))
    key = F.col("s_suppkey").cast("string")
    cases = [("a", F.split("p_name", " ")[1], F.col("s_name")),
             ("b", F.concat("p_name", F.lit(" (new)")), F.substring("s_name", 15, 9)),
             ("c", F.concat(F.lit(" "), F.col("p_name")), F.lit("")),
             ("d", F.lit("no such product"), F.lit(None).cast("string"))]
    return both.select(F.explode(F.array(*(F.struct(F.concat(F.lit(k), key).alias("request_id"), p.alias("product_name"),
                                                    s.alias("store_name")) for k, p, s in cases))).alias("r")).select("r.*")


@register("j8_many_requests", with_sales(SNAP + LIST + """,
both_ AS (SELECT * FROM supplier JOIN part ON s_suppkey = p_partkey),
req AS (SELECT 'a' || s_suppkey AS request_id, string_split(p_name, ' ')[2] AS p, s_name AS s FROM both_
        UNION ALL SELECT 'b' || s_suppkey, p_name || ' (new)', substr(s_name, 15, 9) FROM both_
        UNION ALL SELECT 'c' || s_suppkey, p_name, '' FROM both_ UNION ALL SELECT 'd' || s_suppkey, 'no such product', '' FROM both_),
hit AS (SELECT request_id, lst.*, CASE WHEN s = '' OR contains(store_name, s) THEN 0 ELSE 1 END AS pref FROM req JOIN lst
        ON contains(product_name, p) OR contains(p, product_name))
SELECT * EXCLUDE (pref), CASE WHEN safety_stock <= 0 THEN 'green' WHEN inventory < safety_stock THEN 'red' ELSE 'green' END AS signal
FROM hit QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY pref, frozen_money DESC, store_name, product_id) = 1"""))
def j8_many(spark, d):
    return N.stock_signals(I.inventory_list(snap(spark, d)), requests(spark, d))


@register("p3_many_store_names", with_sales(f""",
req AS (SELECT 'third store ( ' || s_name || ' )' AS request, s_name AS want, TRUE AS whole FROM supplier
        UNION ALL SELECT lower(s_name), s_name, TRUE FROM supplier
        UNION ALL SELECT DISTINCT substr(s_name, 1, 17), substr(s_name, 1, 17), FALSE FROM supplier),
per AS (SELECT store_name, {MS} AS cents FROM sales GROUP BY store_name)
SELECT request, count(*) AS stores, CAST(sum(cents) AS BIGINT) AS cents FROM req JOIN per
ON CASE WHEN whole THEN store_name = want ELSE contains(store_name, want) END GROUP BY request"""))
def p3_many(spark, d):
    """Sales of all stores that each request names: in parentheses, in lower case, by the
    first part of the name."""
    sup = table(spark, d, "supplier").select("s_name")
    asked = sup.select(F.explode(F.array(F.concat(F.lit("third store ( "), "s_name", F.lit(" )")), F.lower("s_name"),
                                         F.substring("s_name", 1, 17))).alias("request")).distinct()
    per = tpch_sales(spark, d).groupBy("store_name").agg(
        F.sum(F.round(F.coalesce("total_sales", F.lit(0)) * 100).cast("long")).alias("cents"))
    return (N.store_name_matches(asked, per).join(per, "store_name").groupBy("request")
            .agg(F.count(F.lit(1)).alias("stores"), F.sum("cents").cast("long").alias("cents")))
