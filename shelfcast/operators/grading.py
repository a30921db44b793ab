"""Store grading and price-demand correlation, G1-G5."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.numeric import cents, round_decimal, round_int
from shelfcast.functions.text import strip_brand
from shelfcast.operators.forecast import endpoint_trend, sales_forecast_from_qty
from shelfcast.sources.tpch import BASE_YEARS, TARGET_YEAR

# ---- fixed values ----------------------------------------------------------
GRADE_S_MIN = 100.0
GRADE_A_MIN = 80.0
GRADES = ["S", "A", "C"]
PRICE_SENSITIVE_CORR = -0.6
INSIGHT_PENDING = "분석 중"
INSIGHT_SENSITIVE = "가격 민감도가 매우 높음: 할인 시 폭발적 수요 예상"
INSIGHT_STABLE = "프리미엄 수요 안정적: 가격 유지 전략 권고"
INSIGHT_TOO_FEW = "가격·수량 데이터 부족"
# ---------------------------------------------------------------------------


def _store_perf(sales: DataFrame) -> DataFrame:
    """Per (country, store_name): exact total over all rows, in cents."""
    return sales.groupBy(F.col("country"), F.col("store_name")).agg(F.sum(cents(F.col("total_sales"))).alias("c"))


def _grade(perf: DataFrame, target) -> DataFrame:
    tgt = F.when(target <= 0, F.lit(1.0)).otherwise(target)
    rate = (F.col("c") / 100.0) / tgt * 100.0
    return perf.select(
        F.coalesce(F.trim("country"), F.lit("")).alias("country"),
        F.coalesce(strip_brand(F.trim("store_name")), F.lit("")).alias("store_name"),
        round_int(F.col("c") / 100.0).alias("total_sales"),
        round_int(tgt).alias("target_annual"),
        F.bround(rate, 1).alias("achievement_rate"),
        F.when(rate >= GRADE_S_MIN, "S").when(rate >= GRADE_A_MIN, "A").otherwise("C").alias("grade"))


def store_grade_qty(sales: DataFrame, years=BASE_YEARS, target_year: int = TARGET_YEAR) -> DataFrame:
    """G1: target per store = (D3 forecast / 12) / stores * 12 (the total of
    all sales when the forecast is 0); rate = sales / target * 100;
    S >= 100, A >= 80, else C."""
    perf = _store_perf(sales)
    fc = sales_forecast_from_qty(sales, years, target_year).select("predicted_sales").scalar()
    total_all = sales.select(F.sum(cents(F.col("total_sales"))) / 100.0).scalar()
    annual = F.when(fc <= 0, total_all).otherwise(fc.cast("double"))
    n = perf.select(F.countDistinct("store_name")).scalar()
    return _grade(perf, (annual / 12.0) / n * 12.0)


def annual_endpoint_forecast(sales: DataFrame, target_year: int = TARGET_YEAR) -> DataFrame:
    """D4 over the whole table: one row with the endpoint-trend forecast of
    yearly money (all years)."""
    by_year = (sales.filter(F.col("sale_year").isNotNull())
                    .groupBy("sale_year").agg((F.sum(cents(F.col("total_sales"))) / 100.0).alias("v")))
    return endpoint_trend(by_year.withColumn("_k", F.lit(0)), ["_k"], "sale_year", "v", target_year).drop("_k")


def store_grade_trend(sales: DataFrame, target_year: int = TARGET_YEAR) -> DataFrame:
    """Same grading with target = D4 forecast / stores."""
    perf = _store_perf(sales)
    fc = annual_endpoint_forecast(sales, target_year).select("forecast").scalar()
    total_all = sales.select(F.sum(cents(F.col("total_sales"))) / 100.0).scalar()
    annual = F.when(F.coalesce(fc, F.lit(0.0)) <= 0, total_all).otherwise(fc)
    n = perf.select(F.countDistinct("store_name")).scalar()
    return _grade(perf, annual / n)


def grade_distribution(graded: DataFrame) -> DataFrame:
    """Count and percentage (1 decimal) for S, A, C, zeros included."""
    spark = graded.sparkSession
    grades = spark.createDataFrame([(g,) for g in GRADES], "grade string")
    counts = graded.groupBy("grade").agg(F.count(F.lit(1)).alias("count"))
    total = graded.select(F.count(F.lit(1))).scalar()
    return (grades.join(counts, "grade", "left")
                  .select("grade", F.coalesce("count", F.lit(0)).cast("long").alias("count"),
                          F.bround(F.coalesce("count", F.lit(0)) / total * 100.0, 1).alias("pct")))


def price_demand_corr(sales: DataFrame, price_col: str = "price") -> DataFrame:
    """Pearson(price, quantity) for every product name in one job;
    NaN -> 0 with "analysing"; < -0.6 price sensitive; else stable."""
    s = sales.select(F.trim("product_name").alias("product_name"),
                     F.col(price_col).cast("double").alias("p"), F.col("quantity").cast("double").alias("q")) \
             .filter(F.col("product_name").isNotNull() & (F.col("product_name") != "")
                     & F.col("p").isNotNull() & F.col("q").isNotNull())
    g = s.groupBy("product_name").agg(F.count(F.lit(1)).alias("n"), F.corr("p", "q").alias("r"))
    bad = F.col("r").isNull() | F.isnan("r")
    return g.select(
        "product_name", "n",
        F.when(F.col("n") < 2, F.lit(None).cast("double")).when(bad, F.lit(0.0)).otherwise(F.bround("r", 2)).alias("correlation"),
        F.when(F.col("n") < 2, F.lit(INSIGHT_TOO_FEW)).when(bad, F.lit(INSIGHT_PENDING))
         .when(F.col("r") < PRICE_SENSITIVE_CORR, F.lit(INSIGHT_SENSITIVE)).otherwise(F.lit(INSIGHT_STABLE)).alias("insight"))


def price_demand_scatter(sales: DataFrame, product_name: str | None = None, limit: int = 500,
                         price_col: str = "price") -> DataFrame:
    """G4 scatter: the first ``limit`` (price, quantity) points per product
    in (sale_date, sale_id) order (a per-group top-k, not a global sort)."""
    from pyspark.sql import Window
    s = sales.select(F.trim("product_name").alias("product_name"), "sale_date", "sale_id",
                     F.col(price_col).cast("double").alias("p"), F.col("quantity").cast("double").alias("q")) \
             .filter(F.col("p").isNotNull() & F.col("q").isNotNull())
    if product_name:
        s = s.filter(F.col("product_name") == product_name.strip())
    w = Window.partitionBy("product_name").orderBy("sale_date", "sale_id")
    return (s.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
             .select("product_name", round_decimal(F.col("p"), 2).alias("price"), round_int(F.col("q")).alias("quantity")))


def top20_achievement(graded: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` stores with the highest achievement rate."""
    return graded.orderBy(F.desc("achievement_rate"), "store_name", "country").limit(n)
