"""Registered rule-scoring queries (W family)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.operators import scoring as W
from shelfcast.plans.catalog import register
from shelfcast.session import cut_lineage
from shelfcast.sources.tpch import tpch_sales, with_sales

AS_OF = "2002-01-01"   # reference date for stock age on the driver's data

_TAGS = ("(CASE WHEN len(list_filter([{c}], lambda x: x IS NOT NULL)) = 0 THEN ['general'] "
         "ELSE list_filter([{c}], lambda x: x IS NOT NULL) END)")
_CONN = ("CASE WHEN lower(pn) LIKE '%magsafe%' OR lower(pn) LIKE '%mag safe%' THEN 'magsafe' END, "
         "CASE WHEN lower(pn) LIKE '%usb-c%' OR lower(pn) LIKE '%usbc%' OR lower(pn) LIKE '%usb c%' THEN 'usb-c' END, "
         "CASE WHEN lower(pn) LIKE '%lightning%' THEN 'lightning' END, "
         "CASE WHEN lower(coalesce(cat, '')) <> '' THEN replace(lower(cat), ' ', '_') END")
TAGS = _TAGS.format(c=_CONN)

W1_CTE = f""",
g AS (SELECT store_id, product_id, arg_min(product_name, (sale_date, sale_id)) AS pn, arg_min(price, (sale_date, sale_id)) AS pr,
             arg_min(category_name, (sale_date, sale_id)) AS cat, min(launch_date) AS l FROM sales_l GROUP BY 1, 2),
w1 AS (SELECT store_id, product_id, trim(pn) AS product_name, coalesce(CAST(pr AS DOUBLE), 299.0) AS price, 0.35 AS margin,
              CAST(greatest(coalesce(datediff('day', l, DATE '{AS_OF}'), 0), 0) AS INTEGER) AS stock_age,
              {TAGS} AS compatibility_tags, CAST(1 AS BIGINT) AS stock
       FROM g WHERE trim(pn) <> '')"""


@register("w1_engine_products", with_sales(W1_CTE + """
SELECT store_id, product_id, product_name, price, margin, stock_age, array_to_string(compatibility_tags, ',') AS tags, stock
FROM w1""", launch=True))
def w1(spark, d):
    p = W.engine_products(tpch_sales(spark, d, launch=True), AS_OF)
    return p.select("store_id", "product_id", "product_name", "price", "margin", "stock_age",
                    F.array_join("compatibility_tags", ",").alias("tags"), "stock")


marker = "SELECT store_id, product_id, product_name, passed, ceo_score, investor_score, operation_score, score,"
W5_SQL = with_sales(W1_CTE + """,
t AS (SELECT store_id, list(DISTINCT replace(lower(trim(category_name)), ' ', '_')) FILTER (WHERE trim(category_name) <> '') AS tt
      FROM sales GROUP BY 1),
m AS (SELECT store_id, arg_min(price, (-price, sale_date, sale_id)) AS main_price FROM sales WHERE price IS NOT NULL GROUP BY 1),
x AS (SELECT w1.*, m.main_price, list_has_any(list_transform(compatibility_tags, lambda z: lower(trim(z))), coalesce(t.tt, ['general'])) AS passed,
             CASE WHEN price <> 0 THEN least(1.0, price / 1500.0) ELSE 0.5 END AS ps,
             coalesce(m.main_price >= 1000.0 AND greatest(price, 0.0) <= 10.0, false) AS penal
      FROM w1 LEFT JOIN t USING (store_id) LEFT JOIN m USING (store_id)),
y AS (SELECT *, round_even(least(greatest(0.5 * ps + 0.5 * 0.35, 0.0), 1.0), 4) AS ceo_raw,
             round_even(least(greatest(stock_age / 180.0, 0.0), 1.0), 4) AS operation_score FROM x),
z AS (SELECT *, round_even(least(greatest(CASE WHEN penal THEN ceo_raw * 0.2 ELSE ceo_raw END, 0.0), 1.0), 4) AS ceo_score,
             round_even(least(greatest(CASE WHEN stock_age > 90 THEN least(1.5, 0.35 * 1.5) ELSE 0.35 END, 0.0), 1.5), 4) AS investor_score
      FROM y),
s AS (SELECT *, least(greatest(round_even((3 * CAST(round(ceo_score * 10000) AS BIGINT) + 4 * CAST(round(investor_score * 10000) AS BIGINT)
                                + 3 * CAST(round(operation_score * 10000) AS BIGINT)) / 10.0, 0) / 10000.0, 0.0), 2.0) AS score,
             CASE WHEN penal THEN '브랜드 격이 떨어져. 점수를 80% 깎아. (1000$ 기기+10$ 추천)'
                  WHEN stock_age > 90 THEN '돈이 묶여있어! 점수를 1.5배 높여서 빨리 팔게 유도해. (재고령>90일)'
                  ELSE '균형 점수에 의해 선정됨' END AS step FROM z)
SELECT store_id, product_id, product_name, passed, ceo_score, investor_score, operation_score, score,
       CASE WHEN passed THEN '이 아이템은 ' || step ELSE '이건 끼워 팔면 반품이야. 리스트에서 당장 빼!' END AS reason,
       CASE WHEN passed THEN CAST(row_number() OVER (PARTITION BY store_id, passed ORDER BY score DESC, product_name, product_id) AS INTEGER) END AS rank
FROM s""", launch=True)


def _scored(spark, d):
    s = tpch_sales(spark, d, launch=True)
    return s, W.score_products(W.engine_products(s, AS_OF), W.store_targets(s))


@register("w5_store_growth_scores", W5_SQL)
def w5(spark, d):
    _, sc = _scored(spark, d)
    return sc.select("store_id", "product_id", "product_name", "passed", "ceo_score", "investor_score",
                     "operation_score", "score", "reason", "rank")


def _w8_sql():
    body = W5_SQL.replace(marker, ", w5 AS (\n" + marker)
    return body + """),
empty AS (SELECT DISTINCT store_id FROM sales WHERE store_id NOT IN (SELECT store_id FROM w5 WHERE passed))
SELECT e.store_id, f.product_id, f.product_name, CAST(f.score AS DOUBLE) AS score, CAST(f.rank AS INTEGER) AS rank
FROM empty e, (VALUES ('FB-1', 'AppleCare+', 0.9, 1), ('FB-2', 'USB-C 어댑터', 0.85, 2),
                      ('FB-3', 'MagSafe 충전기', 0.8, 3)) f(product_id, product_name, score, rank)"""


@register("w8_growth_fallback", _w8_sql())
def w8(spark, d):
    s, sc = _scored(spark, d)
    return W.growth_fallback(s, sc)


W10_SQL = with_sales(W1_CTE + """,
mx AS (SELECT store_id, max(price) AS mp FROM w1 GROUP BY 1),
m AS (SELECT w1.store_id, min(w1.product_id) AS main_id FROM w1 JOIN mx ON w1.store_id = mx.store_id AND w1.price = mx.mp GROUP BY 1),
mm AS (SELECT m.store_id, m.main_id, w1.price AS main_price, list_transform(w1.compatibility_tags, lambda t: lower(t)) AS mtags
       FROM m JOIN w1 ON w1.store_id = m.store_id AND w1.product_id = m.main_id),
pr AS (SELECT mm.store_id, mm.main_id, mm.main_price, c.product_id, c.price, c.margin, c.stock_age
       FROM mm JOIN w1 c ON c.store_id = mm.store_id AND c.product_id <> mm.main_id
       WHERE list_has_any(mm.mtags, list_transform(c.compatibility_tags, lambda t: lower(t))) AND c.stock > 0),
sc AS (SELECT *, CASE WHEN main_price <= 0 THEN 0.5 ELSE least(price / main_price, 1.2) END AS base,
              CASE WHEN main_price > 0 THEN price / main_price ELSE 0.0 END AS ratio FROM pr),
sc2 AS (SELECT *, least(greatest(base, 0.1), 1.0) AS bn0,
               least(greatest(margin, 0.0), 1.0) * CASE WHEN stock_age >= 90 THEN 1.5 ELSE 1.0 END AS inv FROM sc),
sc3 AS (SELECT *, round_even(CASE WHEN main_price >= 1000.0 THEN CASE WHEN ratio < 0.2 THEN bn0 * 0.6 WHEN ratio < 0.4 THEN bn0 * 0.8
                                  ELSE bn0 END ELSE bn0 END, 4) AS ceo_score,
               round_even(least(inv, 1.5), 4) AS investor_score, 0.5 AS seller_score FROM sc2),
sc4 AS (SELECT *, round_even((3000 * CAST(round(ceo_score * 10000) AS BIGINT) + 4000 * CAST(round(investor_score * 10000) AS BIGINT)
                             + 3000 * CAST(round(seller_score * 10000) AS BIGINT)) / 10000.0, 0) / 10000.0 AS total_score,
               list_filter(['메인 기기와 호환성이 높아 번들 제안에 자연스럽습니다',
                            CASE WHEN main_price >= 1000.0 AND ceo_score >= 0.8 THEN '프리미엄 메인 기기와 가격·브랜드 톤이 잘 맞습니다'
                                 WHEN ceo_score >= 0.7 THEN '가격대와 브랜드 포지션이 메인 기기와 균형을 이룹니다' END,
                            CASE WHEN investor_score > 1.0 THEN '재고령이 길어 마진과 재고 턴오버 개선에 유리합니다'
                                 WHEN investor_score >= 0.8 THEN '마진과 재고 상태가 양호해 점포 수익성에 기여합니다' END,
                            CASE WHEN seller_score >= 0.8 THEN '설명이 간단하고 교차 판매 제안이 쉬워 판매자 입장에서 다루기 편합니다' END],
                           lambda x: x IS NOT NULL) AS clauses FROM sc3)
SELECT store_id, main_id, product_id, total_score, ceo_score, investor_score, seller_score,
       '이 제품은 ' || array_to_string(clauses[1:2], ' 그리고 ') || '로 인해 현재 가장 적합한 추천입니다' AS reason,
       CAST(row_number() OVER (PARTITION BY store_id, main_id ORDER BY total_score DESC, product_id) AS INTEGER) AS rank
FROM sc4""", launch=True)


@register("w10_bundle_rank", W10_SQL)
def w10(spark, d):
    s = tpch_sales(spark, d, launch=True)
    prods = W.engine_products(s, AS_OF)
    tg = W.store_targets(s)
    mains = prods.join(tg.select("store_id", F.col("main_device_price").alias("price")), ["store_id", "price"], "left_semi")
    mains = mains.groupBy("store_id").agg(F.min_by(F.struct(*prods.columns), F.col("product_id")).alias("m")).select("m.*")
    return W.bundle_rank(prods, mains).select("store_id", "main_id", "product_id", "total_score", "ceo_score",
                                              "investor_score", "seller_score", "reason", "rank")


@register("w7_seller_scripts", f"""
SELECT store_id, product_id, CASE WHEN passed THEN printf('''%s''은(는) %s로 인해 현재 가장 적합한 추천입니다. 고객님께 이렇게 말씀해 보세요.', product_name,
       substr(reason, length('이 아이템은 ') + 1)) END AS seller_script, rank FROM ({W5_SQL})""")
def w7(spark, d):
    _, sc = _scored(spark, d)
    return W.seller_script(sc).select("store_id", "product_id", "seller_script", "rank")


#: Accessories of a main device cost at most this share of it; some stores have none.
ACCESSORY = 0.46


def _bundle(spark, d, **kw):
    s = tpch_sales(spark, d, launch=True)
    prods = cut_lineage(W.engine_products(s, AS_OF))  # read by the main devices and, often twice, by the candidates
    mains = prods.join(W.store_targets(s).select("store_id", F.col("main_device_price").alias("price")), ["store_id", "price"], "left_semi")
    mains = mains.groupBy("store_id").agg(F.min_by(F.struct(*prods.columns), F.col("product_id")).alias("m")).select("m.*")
    return prods, cut_lineage(mains)  # a row per store, read several times too


@register("w10_campaign", W10_SQL.replace("(3000 * ", "(6000 * ").replace("+ 4000 * ", "+ 2286 * ").replace("+ 3000 * ", "+ 1714 * ").replace(
    "판매자 입장에서 다루기 편합니다' END]", "판매자 입장에서 다루기 편합니다' END, '" + W.BUNDLE_REASONS["campaign"] + "']"))
def w10_campaign(spark, d):
    return W.bundle_rank(*_bundle(spark, d), campaign=True).select(
        "store_id", "main_id", "product_id", "total_score", "ceo_score", "investor_score", "seller_score", "reason", "rank")


_FIXED = ", ".join(str((*x, i)) for i, x in enumerate(W.BEST_SELLERS, 1))


@register("w10_accessories_or_best_sellers", f"""
WITH r AS ({W10_SQL.replace("AND c.stock > 0),", f"AND c.stock > 0 AND c.price <= {ACCESSORY} * mm.main_price),")}),
mains AS ({W10_SQL[:W10_SQL.index("pr AS (SELECT mm")].rstrip().rstrip(",")} SELECT store_id, main_id FROM mm)
SELECT store_id, main_id, product_id, total_score, ceo_score, investor_score, seller_score, reason, rank, FALSE AS is_fallback FROM r
UNION ALL SELECT m.store_id, m.main_id, f.id, f.t, f.c, f.i, f.s, f.reason, CAST(f.rank AS INTEGER), TRUE
FROM mains AS m ANTI JOIN r ON r.store_id = m.store_id AND r.main_id = m.main_id,
     (VALUES {_FIXED}) AS f(id, name, t, c, i, s, reason, rank)""")
def w10_fallback(spark, d):
    prods, mains = _bundle(spark, d)
    few = prods.join(mains.select("store_id", F.col("price").alias("_main")), "store_id").filter(
        F.col("price") <= ACCESSORY * F.col("_main")).drop("_main")
    return W.bundle_fallback(W.bundle_rank(few, mains), mains).drop("product_name")
