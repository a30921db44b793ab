"""Rule scoring W1-W11 as column expressions over (store, product) rows.

The reference scores one product list per request in Python loops; here
every store's candidate list is one DataFrame and each rule is a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.rows import first_row
from shelfcast.functions.text import charger_type, compat_tags

# ---- fixed values (reference rules) ----------------------------------------
DEFAULT_PRICE = 299.0
DEFAULT_MARGIN = 0.35
DEFAULT_STOCK = 1
WEIGHTS = {"PREMIUM": (0.6, 0.2, 0.2), "OUTLET": (0.1, 0.7, 0.2), "STANDARD": (0.3, 0.4, 0.3)}
PREMIUM_DEVICE_PRICE = 1000.0
LOW_ITEM_PRICE = 10.0
BRAND_PENALTY = 0.2
AGED_DAYS = 90
AGED_BOOST = 1.5
AGED_CAP = 1.5
PRICE_NORM = 1500.0
AGE_NORM_DAYS = 180.0
STEP_PENALTY = "브랜드 격이 떨어져. 점수를 80% 깎아. (1000$ 기기+10$ 추천)"
STEP_AGED = "돈이 묶여있어! 점수를 1.5배 높여서 빨리 팔게 유도해. (재고령>90일)"
STEP_PREMIUM = "브랜드 이미지 최우선(CEO 가중)에 의해 선정됨"
STEP_OUTLET = "재고 비우기(INV 가중)에 의해 선정됨"
STEP_BALANCED = "균형 점수에 의해 선정됨"
REASON_PREFIX = "이 아이템은 "
REJECT_MESSAGE = "이건 끼워 팔면 반품이야. 리스트에서 당장 빼!"
FALLBACK_ITEMS = [("FB-1", "AppleCare+", 0.9), ("FB-2", "USB-C 어댑터", 0.85), ("FB-3", "MagSafe 충전기", 0.8)]
# bundle ranking (second engine)
BUNDLE_WEIGHTS = (0.3, 0.4, 0.3)
CAMPAIGN_CEO_WEIGHT = 0.6
BUNDLE_ETA_HOURS = 24.0
BUNDLE_LOW_RATIO, BUNDLE_LOW_FACTOR = 0.2, 0.6
BUNDLE_MID_RATIO, BUNDLE_MID_FACTOR = 0.4, 0.8
BUNDLE_REASONS = {
    "compatible": "메인 기기와 호환성이 높아 번들 제안에 자연스럽습니다",
    "premium": "프리미엄 메인 기기와 가격·브랜드 톤이 잘 맞습니다",
    "balanced_price": "가격대와 브랜드 포지션이 메인 기기와 균형을 이룹니다",
    "aged": "재고령이 길어 마진과 재고 턴오버 개선에 유리합니다",
    "margin": "마진과 재고 상태가 양호해 점포 수익성에 기여합니다",
    "seller": "설명이 간단하고 교차 판매 제안이 쉬워 판매자 입장에서 다루기 편합니다",
    "campaign": "현재 캠페인 모드에서 객단가 상승에 기여하도록 설계되었습니다",
    "even": "가격·마진·판매 편의성이 고르게 균형을 이루고 있습니다",
}
# What a seller says of a product (name, reason).
SELLER_SCRIPT = "'%s'은(는) %s로 인해 현재 가장 적합한 추천입니다. 고객님께 이렇게 말씀해 보세요."
SCRIPT_NAMELESS = "이 제품"
# Best sellers offered where nothing fits a main device:
# id, name, total, CEO, investor and seller score, reason.
BEST_SELLERS = [
    ("BS-001", "AppleCare+ for iPhone", 0.95, 0.9, 0.9, 0.95,
     "이 제품은 전 제품군에 안정적인 부가가치를 제공하여 현재 가장 적합한 추천입니다"),
    ("BS-002", "USB‑C 전원 어댑터", 0.9, 0.85, 0.88, 0.9,
     "이 제품은 대부분의 기기와 호환되며 구매 전환율이 높아 현재 가장 적합한 추천입니다"),
    ("BS-003", "MagSafe 듀얼 충전기", 0.88, 0.9, 0.82, 0.88,
     "이 제품은 프리미엄 액세서리로 번들 구성 시 객단가를 높일 수 있어 현재 가장 적합한 추천입니다"),
]
# -----------------------------------------------------------------------------


def _clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def engine_products(sales: DataFrame, as_of: str, per_store: bool = True) -> DataFrame:
    """Product records: first price (299 when missing), margin 0.35,
    stock age = as_of - first launch (>= 0), inferred tags, stock = summed
    inventory (1 when the data has none). ``per_store`` builds each store's
    own assortment (all stores at once)."""
    keys = (["store_id"] if per_store else []) + ["product_id"]
    aggs = [first_row("product_name", "price", "category_name").alias("_f")]
    aggs.append(F.min("launch_date").alias("_launch") if "launch_date" in sales.columns
                else F.lit(None).cast("date").alias("_launch"))
    aggs.append(F.sum("inventory").alias("_inv") if "inventory" in sales.columns else F.lit(None).cast("long").alias("_inv"))
    g = (sales.groupBy(*keys).agg(*aggs)
              .select(*keys, F.col("_f.product_name").alias("product_name"), F.col("_f.price").alias("_price"),
                      F.col("_f.category_name").alias("_cat"), "_launch", "_inv")
              .filter(F.trim("product_name") != ""))
    age = F.coalesce(F.datediff(F.lit(as_of).cast("date"), F.col("_launch")), F.lit(0))
    return g.select(*keys, F.trim("product_name").alias("product_name"),
                    F.coalesce(F.col("_price").cast("double"), F.lit(DEFAULT_PRICE)).alias("price"),
                    F.lit(DEFAULT_MARGIN).alias("margin"), F.greatest(age, F.lit(0)).alias("stock_age"),
                    compat_tags(F.col("product_name"), F.col("_cat")).alias("compatibility_tags"),
                    F.greatest(F.coalesce(F.col("_inv").cast("long"), F.lit(DEFAULT_STOCK)), F.lit(0)).alias("stock"),
                    F.lit(None).cast("string").alias("expected_eta"))


def store_targets(sales: DataFrame) -> DataFrame:
    """Per store: target tags = its categories (normalised like product
    tags), main device price = its most expensive sale, charger of that
    product."""
    cats = sales.groupBy("store_id").agg(F.collect_set(F.regexp_replace(F.lower(F.trim("category_name")), " ", "_")).alias("t"))
    # most expensive sale; ties -> first row by (sale_date, sale_id)
    main = sales.filter(F.col("price").isNotNull()).groupBy("store_id").agg(
        F.min_by(F.struct("product_id", "price", "product_name", "category_name"),
                 F.struct(-F.col("price"), F.col("sale_date"), F.col("sale_id"))).alias("m"))
    out = cats.join(main, "store_id", "left")
    tags = F.filter("t", lambda x: x != "")
    mt = compat_tags(F.col("m.product_name"), F.col("m.category_name"))
    ch = F.try_element_at(F.filter(mt, lambda x: x.isin("magsafe", "usb-c", "lightning")), F.lit(1))
    return out.select("store_id", F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("general"))).alias("target_tags"),
                      F.col("m.price").alias("main_device_price"), ch.alias("target_charger"))


def score_products(products: DataFrame, targets: DataFrame, store_types: DataFrame | None = None) -> DataFrame:
    """Validate, drop unsellable, split compatible / rejected, score
    and rank. Returns all rows with ``passed`` and, for passed rows, scores,
    rank and reason; rejected rows carry the reject message."""
    p = products.filter(F.col("price").isNotNull() & F.col("margin").isNotNull() & F.col("stock_age").isNotNull())
    p = p.withColumn("compatibility_tags", F.coalesce("compatibility_tags", F.array().cast("array<string>")))
    p = p.filter((F.col("stock") > 0) | (F.trim(F.coalesce("expected_eta", F.lit(""))) != ""))       # W3
    p = p.join(targets, "store_id", "left")
    if store_types is None:
        p = p.withColumn("store_type", F.lit("STANDARD"))
    else:
        p = p.join(store_types, "store_id", "left").withColumn("store_type", F.coalesce("store_type", F.lit("STANDARD")))
    # Weights by store type, normalised and rounded to 4 places
    wmap = {k: tuple(round(x / sum(v), 4) for x in v) for k, v in WEIGHTS.items()}
    def wcol(i):
        e = F.lit(wmap["STANDARD"][i])
        for k, v in wmap.items():
            e = F.when(F.col("store_type") == k, F.lit(v[i])).otherwise(e)
        return e
    p = p.withColumn("w_ceo", wcol(0)).withColumn("w_inv", wcol(1)).withColumn("w_op", wcol(2))
    # Tag overlap and charger agreement
    low = F.transform("compatibility_tags", lambda t: F.lower(F.trim(t)))
    tgt = F.transform("target_tags", lambda t: F.lower(F.trim(t)))
    overlap = F.when(F.size(F.coalesce(tgt, F.array())) == 0, F.lit(True)).otherwise(F.arrays_overlap(low, tgt))
    own_ch = charger_type(F.col("compatibility_tags"), F.col("product_name"))
    ch_ok = F.col("target_charger").isNull() | own_ch.isNull() | (own_ch == F.col("target_charger"))
    p = p.withColumn("passed", F.coalesce(overlap, F.lit(False)) & ch_ok)
    # W5
    price = F.greatest(F.col("price"), F.lit(0.0))
    margin = _clamp(F.col("margin"), 0.0, 1.0)
    age = F.greatest(F.col("stock_age"), F.lit(0))
    price_score = F.when(price != 0, F.least(F.lit(1.0), price / PRICE_NORM)).otherwise(0.5)
    ceo_raw = F.bround(_clamp(0.5 * price_score + 0.5 * margin, 0.0, 1.0), 4)
    inv_raw = F.bround(margin, 4)
    op_raw = F.bround(_clamp(age / AGE_NORM_DAYS, 0.0, 1.0), 4)
    inv = F.when(age > AGED_DAYS, F.least(F.lit(AGED_CAP), inv_raw * AGED_BOOST)).otherwise(inv_raw)
    penal = (F.col("main_device_price") >= PREMIUM_DEVICE_PRICE) & (price <= LOW_ITEM_PRICE)
    ceo = F.when(F.coalesce(penal, F.lit(False)), ceo_raw * BRAND_PENALTY).otherwise(ceo_raw)
    p = (p.withColumn("ceo_score", F.bround(_clamp(ceo, 0.0, 1.0), 4))
          .withColumn("investor_score", F.bround(_clamp(inv, 0.0, AGED_CAP), 4))
          .withColumn("operation_score", op_raw))
    # Exact total: weights are whole tenths and scores whole 1e-4 units, so
    # the weighted sum is an integer number of 1e-5 units; rounding it
    # half-even is then the same on every engine (no binary ties).
    def units(c: str, scale: int) -> Column:
        return F.round(F.col(c) * scale).cast("long")
    t5 = (units("w_ceo", 10) * units("ceo_score", 10000) + units("w_inv", 10) * units("investor_score", 10000)
          + units("w_op", 10) * units("operation_score", 10000))
    total = F.bround(t5 / 10.0, 0) / 10000.0
    p = p.withColumn("score", _clamp(total, 0.0, 2.0))
    # Reasoning path
    steps = F.array_compact(F.array(
        F.when(F.coalesce(penal, F.lit(False)), F.lit(STEP_PENALTY)),
        F.when(age > AGED_DAYS, F.lit(STEP_AGED)),
        F.when((F.col("store_type") == "PREMIUM") & (F.col("w_ceo") >= 0.5), F.lit(STEP_PREMIUM))
         .when((F.col("store_type") == "OUTLET") & (F.col("w_inv") >= 0.5), F.lit(STEP_OUTLET))))
    steps = F.when(F.size(steps) == 0, F.array(F.lit(STEP_BALANCED))).otherwise(steps)
    p = p.withColumn("if_then_path", steps).withColumn(
        "reason", F.when(F.col("passed"), F.concat(F.lit(REASON_PREFIX), F.try_element_at(steps, F.lit(1)))).otherwise(F.lit(REJECT_MESSAGE)))
    w = Window.partitionBy("store_id", "passed").orderBy(F.desc("score"), "product_name", "product_id")
    return p.withColumn("rank", F.when(F.col("passed"), F.row_number().over(w)))


def seller_script(scored: DataFrame) -> DataFrame:
    """What a seller says of each passed product (null for rejected ones)."""
    name = F.coalesce(F.when(F.col("product_name") != "", F.col("product_name")), F.col("product_id"), F.lit(SCRIPT_NAMELESS))
    return scored.withColumn("seller_script", F.when(F.col("passed"), F.format_string(
        SELLER_SCRIPT, name, F.try_element_at("if_then_path", F.lit(1)))))


def bundle_fallback(ranked: DataFrame, mains: DataFrame) -> DataFrame:
    """Main devices without any candidate get the three fixed best sellers;
    ``is_fallback`` tells them apart."""
    none = mains.select("store_id", F.col("product_id").alias("main_id")).join(
        ranked.select("store_id", "main_id").distinct(), ["store_id", "main_id"], "left_anti")
    names = ["product_id", "product_name", "total_score", "ceo_score", "investor_score", "seller_score", "reason"]
    items = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, x)], F.lit(i).alias("rank"))
                      for i, x in enumerate(BEST_SELLERS, 1)])
    fixed = none.select("store_id", "main_id", F.explode(items).alias("f")).select("store_id", "main_id", "f.*", F.lit(True).alias("is_fallback"))
    return ranked.select("store_id", "main_id", *names, "rank", F.lit(False).alias("is_fallback")).unionByName(fixed)


def growth_fallback(sales: DataFrame, scored: DataFrame) -> DataFrame:
    """Stores where nothing passed get the three fixed items."""
    ok = scored.filter("passed").select("store_id").distinct()
    empty = sales.select("store_id").distinct().join(ok, "store_id", "left_anti")
    items = F.array(*[F.struct(F.lit(i).alias("product_id"), F.lit(n).alias("product_name"), F.lit(s).alias("score"))
                      for i, n, s in FALLBACK_ITEMS])
    return empty.select("store_id", F.posexplode(items).alias("pos", "f")).select(
        "store_id", "f.product_id", "f.product_name", "f.score", (F.col("pos") + 1).alias("rank"))


def bundle_rank(products: DataFrame, mains: DataFrame, campaign: bool = False,
                seller_score: float = 0.5, age_col: str = "stock_age") -> DataFrame:
    """Every main device x its compatible candidates (its store's products
    with a shared tag; an equi-join by store, so a product moves once, not once per tag), stock > 0 or
    ETA <= 24 h, CEO / investor / seller scores, weighted total, up to two
    reason clauses; sorted by total."""
    bw = BUNDLE_WEIGHTS
    if campaign:
        rest = 1.0 - CAMPAIGN_CEO_WEIGHT
        w = (CAMPAIGN_CEO_WEIGHT, rest * bw[1] / (bw[1] + bw[2]), rest * bw[2] / (bw[1] + bw[2]))
    else:
        w = bw
    mt = mains.select("store_id", F.col("product_id").alias("main_id"), F.col("price").alias("main_price"),
                      F.transform("compatibility_tags", F.lower).alias("main_tags"))
    ct = products.select("store_id", "product_id", "product_name", "price", "margin", F.col(age_col).alias("age"), "stock",
                         F.lit(None).cast("double").alias("eta_hours"),
                         F.transform("compatibility_tags", F.lower).alias("tags"))
    pairs = (mt.join(ct, "store_id").filter(F.arrays_overlap("main_tags", "tags") & (F.col("product_id") != F.col("main_id")))
               .drop("main_tags", "tags")
               .dropDuplicates(["store_id", "main_id", "product_id"]))
    pairs = pairs.filter((F.col("stock") > 0) | ((F.col("stock") == 0) & (F.col("eta_hours") <= BUNDLE_ETA_HOURS)))
    ratio = F.when(F.col("main_price") > 0, F.col("price") / F.col("main_price")).otherwise(0.0)
    base = F.when(F.col("main_price") <= 0, F.lit(0.5)).otherwise(F.least(F.col("price") / F.col("main_price"), F.lit(1.2)))
    bn = _clamp(base, 0.1, 1.0)
    bn = F.when(F.col("main_price") >= PREMIUM_DEVICE_PRICE,
                F.when(ratio < BUNDLE_LOW_RATIO, bn * BUNDLE_LOW_FACTOR).when(ratio < BUNDLE_MID_RATIO, bn * BUNDLE_MID_FACTOR)
                 .otherwise(bn)).otherwise(bn)
    inv = _clamp(F.col("margin"), 0.0, 1.0)
    inv = F.when(F.col("age") >= AGED_DAYS, inv * 1.5).otherwise(inv)
    p = pairs.select("store_id", "main_id", "product_id", "product_name", "main_price",
                     F.bround(bn, 4).alias("ceo_score"), F.bround(F.least(inv, F.lit(1.5)), 4).alias("investor_score"),
                     F.bround(_clamp(F.lit(seller_score), 0.0, 1.0), 4).alias("seller_score"))
    # exact total (see score_products): weights in 1e-4 units here, since
    # the campaign weights are not whole tenths
    def units(c: str) -> Column:
        return F.round(F.col(c) * 10000).cast("long")
    wu = [int(round(x * 10000)) for x in w]
    t8 = wu[0] * units("ceo_score") + wu[1] * units("investor_score") + wu[2] * units("seller_score")
    p = p.withColumn("total_score", F.bround(t8 / 10000.0, 0) / 10000.0)
    r = BUNDLE_REASONS
    clauses = F.array_compact(F.array(
        F.lit(r["compatible"]),
        F.when((F.col("main_price") >= PREMIUM_DEVICE_PRICE) & (F.col("ceo_score") >= 0.8), F.lit(r["premium"]))
         .when(F.col("ceo_score") >= 0.7, F.lit(r["balanced_price"])),
        F.when(F.col("investor_score") > 1.0, F.lit(r["aged"])).when(F.col("investor_score") >= 0.8, F.lit(r["margin"])),
        F.when(F.col("seller_score") >= 0.8, F.lit(r["seller"])),
        F.lit(r["campaign"]) if campaign else F.lit(None).cast("string")))
    core = F.array_join(F.slice(clauses, 1, 2), " 그리고 ")
    p = p.withColumn("reason", F.concat(F.lit("이 제품은 "), core, F.lit("로 인해 현재 가장 적합한 추천입니다")))
    wr = Window.partitionBy("store_id", "main_id").orderBy(F.desc("total_score"), "product_id")
    return p.withColumn("rank", F.row_number().over(wr))
