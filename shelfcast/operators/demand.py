"""Demand (quantity) aggregations A1-A15.

Per-entity dashboards of the reference (one store, one country) are
computed for every entity in one grouped job; a parameter narrows it.
Year pivots use conditional sums over a literal year list: one hash
aggregate, one shuffle, a stable schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.geo import city_lon_lat, continent_of_col, store_name_ko
from shelfcast.functions.numeric import round_half_up_js, round_int
from shelfcast.functions.rows import first_row
from shelfcast.functions.text import norm_text, strip_brand
from shelfcast.operators.filters import base_years, region_filter
from shelfcast.operators.forecast import predicted_quantity
from shelfcast.sources.tpch import BASE_YEARS, TARGET_YEAR

UNKNOWN_CATEGORY = "Unknown"   # fixed value: label for a blank category in A10
OTHER_CONTINENT = "Other"      # fixed value: continent of unmapped countries


def _qty() -> Column:
    return F.coalesce(F.col("quantity"), F.lit(0))


def _first(col: str) -> Column:
    """Deterministic "first row" value: earliest (sale_date, sale_id)."""
    return F.min_by(col, F.struct("sale_date", "sale_id"))


def _first_nonnull(col: str) -> Column:
    key = F.when(F.col(col).isNotNull(), F.struct("sale_date", "sale_id"))
    return F.min_by(F.when(F.col(col).isNotNull(), F.col(col)), key)


def continent_col(sales: DataFrame) -> Column:
    if "continent" in sales.columns:
        return F.coalesce(F.col("continent"), continent_of_col("country", OTHER_CONTINENT))
    return continent_of_col("country", OTHER_CONTINENT)


def _by(sales: DataFrame, keys: list, years) -> DataFrame:
    s = base_years(sales, years)
    return s.groupBy(*keys).agg(F.sum(_qty()).cast("long").alias("quantity"))


def city_category_year(sales: DataFrame, years=BASE_YEARS) -> DataFrame:
    """A1: quantity by (city, year, category)."""
    return _by(sales, [norm_text("city").alias("city"), F.col("sale_year").alias("year"),
                       norm_text("category_name").alias("category")], years)


def store_category_year(sales: DataFrame, years=BASE_YEARS, store_id: str | None = None) -> DataFrame:
    """A2: per store (all stores unless one is given), year, category."""
    s = sales if not store_id else sales.filter(norm_text("store_id") == store_id.strip())
    return _by(s, [norm_text("store_id").alias("store_id"), F.col("sale_year").alias("year"),
                   norm_text("category_name").alias("category")], years)


def country_category_year(sales: DataFrame, years=BASE_YEARS, country: str | None = None) -> DataFrame:
    """A3: per country, year, category."""
    s = sales if not country else sales.filter(norm_text("country") == country.strip())
    return _by(s, [norm_text("country").alias("country"), F.col("sale_year").alias("year"),
                   norm_text("category_name").alias("category")], years)


def country_store_category(sales: DataFrame, years=BASE_YEARS, country: str | None = None) -> DataFrame:
    """A4: stores within a country x category (all countries at once)."""
    s = sales if not country else sales.filter(norm_text("country") == country.strip())
    return _by(s, [norm_text("country").alias("country"), norm_text("store_id").alias("store_id"),
                   norm_text("city").alias("city"), norm_text("category_name").alias("category")], years)


def continent_category_year(sales: DataFrame, years=BASE_YEARS) -> DataFrame:
    """A5: continent x year x category plus the all-years total per
    (continent, category) (year NULL); unmapped countries ("Other") dropped."""
    s = base_years(sales, years).select(continent_col(sales).alias("continent"),
                                        F.col("sale_year").alias("year"),
                                        norm_text("category_name").alias("category"), _qty().alias("q"))
    s = s.filter(F.col("continent") != OTHER_CONTINENT)
    return (s.groupingSets([["continent", "year", "category"], ["continent", "category"]],
                           "continent", "year", "category")
             .agg(F.sum("q").cast("long").alias("quantity")))


def continent_country_category(sales: DataFrame, years=BASE_YEARS, continent: str | None = None) -> DataFrame:
    """Countries within a continent x category."""
    s = base_years(sales, years).select(continent_col(sales).alias("continent"),
                                        norm_text("country").alias("country"),
                                        norm_text("category_name").alias("category"), _qty().alias("q"))
    if continent:
        s = s.filter(F.col("continent") == continent.strip())
    return s.groupBy("continent", "country", "category").agg(F.sum("q").cast("long").alias("quantity"))


def store_product_qty(sales: DataFrame, years=BASE_YEARS) -> DataFrame:
    """Per (store, city, product) quantity > 0 with the product's first
    non-null name (product id when blank)."""
    s = base_years(sales, years).withColumn("_pid", norm_text("product_id"))
    names = s.groupBy("_pid").agg(_first_nonnull("product_name").alias("_pname"))
    agg = s.groupBy(norm_text("store_id").alias("store_id"), norm_text("city").alias("city"), "_pid") \
           .agg(F.sum(_qty()).cast("long").alias("quantity")).filter(F.col("quantity") > 0)
    out = agg.join(names, "_pid", "left")
    pname = F.trim(F.col("_pname"))
    return out.select("store_id", "city", F.col("_pid").alias("product_id"),
                      F.when(pname.isNull() | (pname == ""), F.col("_pid")).otherwise(pname).alias("product_name"),
                      "quantity")


def _year_cols(years) -> list[int]:
    return list(range(int(years[0]), int(years[1]) + 1))


def product_year_pivot(sales: DataFrame, years=BASE_YEARS, target: int = TARGET_YEAR,
                       continent=None, country=None, store_id=None, city=None) -> DataFrame:
    """One row per product: first name/category/launch year (clamped to
    [first base year, target]), quantity per base year, and the target-year
    prediction = global forecast x the product's share of (selected) base
    quantity. Rows with nothing at all are dropped."""
    s = base_years(sales, years)
    if continent or country or store_id or city:
        s = region_filter(s, continent, country, store_id, city)
    ys = _year_cols(years)
    launch = "launch_date" if "launch_date" in s.columns else None
    aggs = [F.sum(F.when(F.col("sale_year") == y, _qty())).cast("long").alias(f"quantity_{y}") for y in ys]
    attrs = ["product_name", "category_name"] + ([launch] if launch else [])
    aggs.append(first_row(*attrs).alias("_f"))
    g = s.groupBy(F.trim("product_id").alias("product_id")).agg(*aggs).fillna(0, [f"quantity_{y}" for y in ys])
    g = g.select("*", F.col("_f.product_name").alias("_name"), F.col("_f.category_name").alias("_cat"),
                 (F.col(f"_f.{launch}") if launch else F.lit(None).cast("date")).alias("_launch"))
    total_q = s.select(F.sum(_qty())).scalar()
    pred = predicted_quantity(sales, years, target)
    q_sum = sum((F.col(f"quantity_{y}") for y in ys), F.lit(0))
    predicted = F.when((total_q > 0) & (pred > 0) & (q_sum > 0),
                       F.greatest(F.lit(0), round_int(pred * (q_sum / total_q)))).otherwise(F.lit(0))
    ly = F.coalesce(F.year("_launch"), F.lit(ys[0]))
    name = norm_text("_name")
    out = g.select("product_id",
                   F.when(name == "", F.col("product_id")).otherwise(name).alias("product_name"),
                   norm_text("_cat").alias("category"),
                   F.least(F.greatest(ly, F.lit(ys[0])), F.lit(int(target))).alias("launch_year"),
                   *[f"quantity_{y}" for y in ys], predicted.cast("long").alias("predicted_quantity"))
    return out.filter(sum((F.col(f"quantity_{y}") for y in ys), F.col("predicted_quantity")) > 0)


def category_year_pivot(sales: DataFrame, years=BASE_YEARS, target: int = TARGET_YEAR,
                        continent=None, country=None, store_id=None, city=None) -> DataFrame:
    """A10: A9 by category (blank -> "Unknown") with the first category_id."""
    s = base_years(sales, years)
    if continent or country or store_id or city:
        s = region_filter(s, continent, country, store_id, city)
    ys = _year_cols(years)
    cat = norm_text("category_name")
    s = s.withColumn("_cat", F.when(cat == "", F.lit(UNKNOWN_CATEGORY)).otherwise(cat))
    aggs = [F.sum(F.when(F.col("sale_year") == y, _qty())).cast("long").alias(f"quantity_{y}") for y in ys]
    g = s.groupBy("_cat").agg(*aggs).fillna(0, [f"quantity_{y}" for y in ys])
    # category_id: first row per raw category name, keyed like the reference
    ids = s.groupBy(cat.alias("_cat2")).agg(_first("category_id").alias("_cid"))
    total_q = s.select(F.sum(_qty())).scalar()
    pred = predicted_quantity(sales, years, target)
    q_sum = sum((F.col(f"quantity_{y}") for y in ys), F.lit(0))
    predicted = F.when((total_q > 0) & (pred > 0) & (q_sum > 0),
                       F.greatest(F.lit(0), round_int(pred * (q_sum / total_q)))).otherwise(F.lit(0))
    out = g.join(ids, g["_cat"] == ids["_cat2"], "left").select(
        F.coalesce(F.trim("_cid"), F.lit("")).alias("category_id"), F.col("_cat").alias("category"),
        *[f"quantity_{y}" for y in ys], predicted.cast("long").alias("predicted_quantity"))
    return out.filter(sum((F.col(f"quantity_{y}") for y in ys), F.col("predicted_quantity")) > 0)


def category_summary_by_year(sales: DataFrame, years=BASE_YEARS, target: int = TARGET_YEAR, **region) -> DataFrame:
    """Per base year and the target year: total quantity and the number
    of categories with quantity > 0 (unpivot of A10 with ``stack``)."""
    a10 = category_year_pivot(sales, years, target, **region)
    ys = _year_cols(years)
    pairs = ", ".join([f"{y}, quantity_{y}" for y in ys] + [f"{int(target)}, predicted_quantity"])
    long = a10.select("category", F.expr(f"stack({len(ys) + 1}, {pairs}) AS (year, q)"))
    per = long.groupBy("year").agg(F.sum("q").cast("long").alias("total_quantity"),
                                   F.count_if(F.col("q") > 0).alias("category_count"))
    spark = sales.sparkSession
    all_years = spark.range(int(years[0]), int(target) + 1).select(F.col("id").cast("int").alias("year"))
    return (all_years.join(per, "year", "left")
            .select("year", F.coalesce("total_quantity", F.lit(0)).cast("long").alias("total_quantity"),
                    F.coalesce("category_count", F.lit(0)).cast("long").alias("category_count")))


def store_markers(sales: DataFrame) -> DataFrame:
    """One marker per store from its first row; stores sharing a city
    are fanned out by their order of first appearance: the k-th (k >= 1)
    moves (k%3-1)*0.12 in longitude and (k//3)*0.08 in latitude."""
    first = sales.groupBy(norm_text("store_id").alias("store_id")).agg(
        F.min_by(F.struct(norm_text("city").alias("city"), norm_text("country").alias("country"),
                          norm_text("store_name").alias("raw_name")),
                 F.struct("sale_date", "sale_id")).alias("r"),
        F.min(F.struct("sale_date", "sale_id")).alias("k"))
    w = Window.partitionBy("r.city").orderBy("k", "store_id")
    idx = F.row_number().over(w) - 1
    lon, lat = city_lon_lat(F.col("r.city"))
    off_lon = F.when(idx > 0, ((idx % 3) - 1) * 0.12).otherwise(0.0)
    off_lat = F.when(idx > 0, F.floor(idx / 3) * 0.08).otherwise(0.0)
    return first.select(
        "store_id", strip_brand(F.col("r.raw_name")).alias("store_name"),
        F.when(F.col("r.raw_name") != "", store_name_ko(F.col("r.raw_name"))).otherwise(F.lit("")).alias("store_name_ko"),
        F.col("r.city").alias("city"), F.col("r.country").alias("country"),
        F.bround(lon + off_lon, 6).alias("lon"), F.bround(lat + off_lat, 6).alias("lat"))


def category_share(sales: DataFrame, years=BASE_YEARS) -> DataFrame:
    """Category percentage of base-year quantity, one decimal, rounded
    like the dashboard (half-up)."""
    g = _by(sales, [norm_text("category_name").alias("category")], years)
    total = base_years(sales, years).select(F.sum(_qty())).scalar()
    tot = F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(1)).otherwise(total)
    return g.select("category", "quantity", (F.floor(F.col("quantity") / tot * 1000 + 0.5) / 10.0).alias("pct"))


def quarter_from_year(sales: DataFrame, years=BASE_YEARS, target: int = TARGET_YEAR) -> DataFrame:
    """Yearly quantities (and the forecast year) split evenly into four
    quarters, rounded half-up."""
    yearly = base_years(sales, years).groupBy(F.col("sale_year").alias("year")) \
        .agg(F.sum(_qty()).cast("long").alias("q")).withColumn("is_predicted", F.lit(False))
    pred = sales.sparkSession.range(1).select(F.lit(int(target)).alias("year"),
                                              predicted_quantity(sales, years, target).cast("long").alias("q"),
                                              F.lit(True).alias("is_predicted"))
    y = yearly.unionByName(pred)
    out = y.select("year", "is_predicted", "q", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("quarter"))
    return out.select(F.format_string("%d-Q%d", "year", "quarter").alias("period"), "year", "quarter",
                      round_half_up_js(F.col("q") / 4.0).cast("long").alias("quantity"), "is_predicted")


LEVELS = {"continent": "continent", "country": "country", "store": "store_id", "city": "city"}


def demand_dashboard(sales: DataFrame, level: str = "continent", year: int = BASE_YEARS[1]) -> DataFrame:
    """A12 for every region of a level at once: category demand in ``year``
    (quantity > 0) and the region's total; a region with no rows that year
    falls back to the global category demand (``is_fallback``). The global
    list (one row per category) is carried as one array and exploded for
    the regions that need it, so no region x category join is formed."""
    col = LEVELS[level]
    reg = (continent_col(sales) if level == "continent" else norm_text(col)).alias("region")
    s = sales.select(reg, norm_text("category_name").alias("category"), "sale_year", _qty().alias("q"))
    per = (s.filter(F.col("sale_year") == int(year)).groupBy("region", "category")
             .agg(F.sum("q").cast("long").alias("quantity")).filter(F.col("quantity") > 0))
    glob = (s.filter(F.col("sale_year") == int(year)).groupBy("category").agg(F.sum("q").cast("long").alias("quantity"))
             .filter(F.col("quantity") > 0))
    glob_list = glob.agg(F.collect_list(F.struct("category", "quantity")).alias("l")).scalar()
    regions = s.select("region").distinct()
    missing = regions.join(per.select("region").distinct(), "region", "left_anti")
    fb = missing.select("region", F.explode(glob_list).alias("g")).select(
        "region", F.col("g.category").alias("category"), F.col("g.quantity").alias("quantity"), F.lit(True).alias("is_fallback"))
    rows = per.withColumn("is_fallback", F.lit(False)).unionByName(fb)
    tot = F.sum("quantity").over(Window.partitionBy("region"))
    return rows.withColumn("total_demand", tot.cast("long"))
