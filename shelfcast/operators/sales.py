"""Sales (money) aggregations, B1-B24.

Each job is ``(sales, ...params) -> DataFrame``. Aggregates are hash
aggregates with a map-side partial step; top-k lists compile to
TakeOrderedAndProject (no global sort); per-group ranks use windows
partitioned by the group key, never an un-partitioned window over the fact.
Money follows the reference's order of operations: per-store totals are
rounded half-even to whole units first and the rounded integers are summed
for the city/country/year roll-ups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.numeric import cents, cents_to_int, cents_to_money, money_sum, round_int
from shelfcast.functions.text import strip_brand
from shelfcast.operators.filters import base_years, store_name_match

UNNAMED = "(미지정)"        # fixed value: label for a blank store/city/country
UNCATEGORISED = "(미분류)"  # fixed value: label for a blank category
ALL_CATEGORIES = "(전체)"   # fixed value: label when no category column exists


def _money(sales: DataFrame) -> Column:
    return F.coalesce(F.col("total_sales"), F.lit(0.0))


def store_sales(sales: DataFrame, years=None) -> DataFrame:
    """B1: total sales per (store_id, city, country) over the base years."""
    s = base_years(sales, years)
    return (s.groupBy("store_id", "city", "country")
             .agg(cents_to_int(money_sum(F.col('total_sales'))).alias("total_sales"))
             .select(F.trim("store_id").alias("store_id"), F.trim("city").alias("city"),
                     F.trim("country").alias("country"), "total_sales"))


def store_year_sales(sales: DataFrame, years=None, store_id: str | None = None) -> DataFrame:
    """B2: B1 split by year; optional single store."""
    s = base_years(sales, years)
    if store_id:
        s = s.filter(F.trim("store_id") == str(store_id).strip())
    return (s.groupBy("store_id", "city", "country", F.col("sale_year").alias("year"))
             .agg(cents_to_int(money_sum(F.col('total_sales'))).alias("total_sales")))


def _display_store(c: Column) -> Column:
    d = strip_brand(c)
    return F.when(d.isNull() | (d == ""), F.lit(UNNAMED)).otherwise(d)


def sales_by_store_name(sales: DataFrame, years=None, country: str | None = None,
                        limit: int = 50) -> DataFrame:
    """Sales per store name (brand prefix dropped), top ``limit``."""
    s = base_years(sales, years)
    if country:
        s = s.filter(F.trim("country") == country.strip())
    agg = s.groupBy(F.trim("store_name").alias("_raw")).agg(cents_to_int(money_sum(F.col('total_sales'))).alias("total_sales"))
    out = agg.select(_display_store(F.col("_raw")).alias("store_name"), "total_sales", "_raw")
    return out.orderBy(F.desc("total_sales"), "store_name", "_raw").limit(limit).drop("_raw")


def sales_by_store_name_year(sales: DataFrame, years=None, country: str | None = None,
                             top: int = 15) -> DataFrame:
    """Per store name and year, for the ``top`` store names by total."""
    s = base_years(sales, years)
    if country:
        s = s.filter(F.trim("country") == country.strip())
    per = (s.groupBy(F.trim("store_name").alias("_raw"), F.col("sale_year").alias("year"))
            .agg(cents_to_int(money_sum(F.col('total_sales'))).alias("total_sales"))
            .withColumn("store_name", _display_store(F.col("_raw"))))
    leaders = (per.groupBy("store_name").agg(F.sum("total_sales").alias("_t"))
                  .orderBy(F.desc("_t"), "store_name").limit(top).select("store_name"))
    # The leader list has at most ``top`` rows: a proven bound for broadcast.
    return per.join(F.broadcast(leaders), "store_name", "left_semi").select("store_name", "year", "total_sales")


def _quarterly(s: DataFrame, keys: list) -> DataFrame:
    return (s.groupBy(*keys, F.col("sale_year").alias("year"), F.quarter("sale_date").alias("quarter"))
             .agg(cents_to_int(money_sum(F.col('total_sales'))).alias("total_sales"))
             .withColumn("period", F.format_string("%d-Q%d", F.col("year"), F.col("quarter"))))


def store_quarter_sales(sales: DataFrame, store_name: str | None = None,
                        country: str | None = None, years=None) -> DataFrame:
    """Quarterly sales of one store matched by name (P3); without a
    name, every store in one job (keyed by store_name)."""
    s = base_years(sales, years).filter(F.col("sale_date").isNotNull())
    if country:
        s = s.filter(F.lower(F.trim("country")) == country.strip().lower())
    if store_name is not None:
        s = s.filter(store_name_match(F.col("store_name"), store_name))
        return _quarterly(s, []).select("period", "year", "quarter", "total_sales")
    return _quarterly(s, ["store_name"]).select("store_name", "period", "year", "quarter", "total_sales")


def store_quarter_category_sales(sales: DataFrame, store_name: str | None = None,
                                 country: str | None = None, years=None) -> DataFrame:
    """B5 by category; blank category -> "(미분류)"."""
    s = base_years(sales, years).filter(F.col("sale_date").isNotNull())
    if country:
        s = s.filter(F.lower(F.trim("country")) == country.strip().lower())
    cat = F.trim(F.coalesce(F.col("category_name"), F.lit("")))
    s = s.withColumn("category", F.when(cat == "", F.lit(UNCATEGORISED)).otherwise(cat))
    if store_name is not None:
        s = s.filter(store_name_match(F.col("store_name"), store_name))
        return _quarterly(s, ["category"]).select("period", "year", "quarter", "category", "total_sales")
    return _quarterly(s, ["store_name", "category"]).select(
        "store_name", "period", "year", "quarter", "category", "total_sales")


def sales_by_city(sales: DataFrame, years=None) -> DataFrame:
    """Sum of the rounded per-store totals by (city, country)."""
    b1 = store_sales(sales, years).filter((F.col("city") != "") | (F.col("country") != ""))
    blank = lambda c: F.when(F.col(c) == "", F.lit(UNNAMED)).otherwise(F.col(c))
    return (b1.groupBy(blank("city").alias("city"), blank("country").alias("country"))
              .agg(F.sum("total_sales").alias("total_sales")))


def sales_by_country(sales: DataFrame, years=None) -> DataFrame:
    """Sum of the rounded per-store totals by country."""
    b1 = store_sales(sales, years).filter(F.col("country") != "")
    return b1.groupBy("country").agg(F.sum("total_sales").alias("total_sales"))


def country_category_sales(sales: DataFrame, years=None, country: str | None = None) -> DataFrame:
    """Categories of one country; without a country, every country's
    total and every (country, category) in one pass (GROUPING SETS)."""
    s = base_years(sales, years).select(
        F.trim("country").alias("country"), F.trim("category_name").alias("category"), "total_sales")
    if country:
        s = s.filter(F.col("country") == country.strip())
        out = s.groupBy("category").agg(cents_to_int(money_sum(F.col('total_sales'))).alias("total_sales"))
        return out.withColumn("category", F.when(F.col("category") == "", F.lit(UNCATEGORISED))
                              .otherwise(F.col("category")))
    out = (s.filter(F.col("country") != "").groupingSets([[F.col("country")], [F.col("country"), F.col("category")]], "country", "category")
           .agg(cents_to_int(money_sum(F.col("total_sales"))).alias("total_sales"), F.grouping("category").alias("_whole")))
    return out.select("country", F.when(F.col("_whole") == 1, F.lit(None)).when(F.col("category") == "", UNCATEGORISED)
                      .otherwise(F.col("category")).alias("category"), "total_sales")


def sales_by_year(sales: DataFrame, years=None) -> DataFrame:
    """Sum of rounded store-year totals per base year; absent years 0."""
    first, last = years or _years_default()
    b2 = store_year_sales(sales, (first, last))
    per = b2.groupBy("year").agg(F.sum("total_sales").alias("total_sales"))
    spark = sales.sparkSession
    all_years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    return (F.broadcast(all_years).join(per, "year", "left")
            .select("year", F.coalesce("total_sales", F.lit(0)).cast("long").alias("total_sales")))


def _years_default():
    from shelfcast.sources.tpch import BASE_YEARS
    return BASE_YEARS


def sales_box(sales: DataFrame, years=None) -> DataFrame:
    """Grand total = sum of rounded per-store totals; store count."""
    b1 = store_sales(sales, years)
    return b1.agg(F.coalesce(F.sum("total_sales"), F.lit(0)).cast("long").alias("total_sum"),
                  F.count(F.lit(1)).alias("store_count"))


def retail_overview(sales: DataFrame, top: int = 10, snapshot: DataFrame | None = None) -> DataFrame:
    """Overview over all rows, long form ``(section, key, sales, n)``:
    summary (total 2 dec., rows, average order value), sales by category
    (all), top-10 countries, top-10 products, last date, and rows per stock
    status where the ``snapshot`` (I4) is given."""
    money = cents(F.col("total_sales"))
    summary = sales.agg(F.sum(money).alias("t"), F.count(F.lit(1)).alias("n"),
                        F.max("sale_date").alias("last"))
    rows = [
        summary.select(F.lit("summary").alias("section"), F.lit("total_sales").alias("key"),
                       cents_to_money(F.col("t")).alias("sales"), F.col("n").alias("n")),
        summary.select(F.lit("summary").alias("section"), F.lit("avg_order_value").alias("key"),
                       F.bround(F.when(F.col("n") > 0, F.col("t") / 100.0 / F.col("n")).otherwise(0.0), 2).alias("sales"),
                       F.col("n")),
        summary.select(F.lit("summary").alias("section"),
                       F.concat(F.lit("last_updated:"), F.date_format("last", "yyyy-MM-dd")).alias("key"),
                       F.lit(None).cast("double").alias("sales"), F.lit(None).cast("long").alias("n")),
    ]
    by_cat = sales.groupBy(F.col("category_name").alias("key")).agg(F.sum(money).alias("t"))
    rows.append(by_cat.select(F.lit("category").alias("section"), "key", cents_to_money(F.col("t"), 0).alias("sales"),
                              F.lit(None).cast("long").alias("n")))
    for section, col in (("country", "country"), ("product", "product_name")):
        g = (sales.groupBy(F.col(col).alias("key")).agg(F.sum(money).alias("t"))
                  .orderBy(F.desc("t"), "key").limit(top))
        rows.append(g.select(F.lit(section).alias("section"), "key", cents_to_money(F.col("t"), 0).alias("sales"),
                             F.lit(None).cast("long").alias("n")))
    if snapshot is not None:
        rows.append(snapshot.groupBy(F.col("status").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("inventory_status").alias("section"), "key", F.lit(None).cast("double").alias("sales"), "n"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def region_category_pivot(sales: DataFrame) -> DataFrame:
    """B14 (long form): every (country, category) cell rounded, plus the
    rounded country total. Pivot to wide only at the edge with
    :func:`pivot_wide` and a literal category list."""
    s = sales.select(F.trim("country").alias("country"), F.trim("category_name").alias("category"),
                     cents(F.col("total_sales")).alias("v"))
    cell = s.groupBy("country", "category").agg(F.sum("v").alias("raw"))
    w = Window.partitionBy("country")
    return cell.select("country", "category", cents_to_int(F.col("raw")).alias("total_sales"),
                       cents_to_int(F.sum("raw").over(w)).alias("country_total_sales"))


def pivot_wide(long_df: DataFrame, row_key: str, col_key: str, value: str, values: list[str]) -> DataFrame:
    """Output-edge pivot with a literal value list (no extra job, stable schema)."""
    return long_df.groupBy(row_key).pivot(col_key, values).agg(F.first(value)).fillna(0)


def country_category_share(sales: DataFrame, country: str | None = None) -> DataFrame:
    """Share of each category within its country (1 decimal); every
    country at once unless one is given."""
    s = sales.select(F.trim("country").alias("country"), F.trim("category_name").alias("category"),
                     cents(F.col("total_sales")).alias("v"))
    if country:
        s = s.filter(F.col("country") == country.strip())
    cell = s.groupBy("country", "category").agg(F.sum("v").alias("raw"))
    tot = F.sum("raw").over(Window.partitionBy("country"))
    out = cell.select("country", "category", cents_to_int(F.col("raw")).alias("total_sales"),
                      F.bround(F.col("raw") / tot * 100.0, 1).alias("pct"), tot.alias("_tot"))
    return out.filter(F.col("_tot") > 0).drop("_tot")


def top_products_categories(sales: DataFrame, n_products: int = 15, n_categories: int = 10) -> DataFrame:
    """Top products (by name) and top categories by sales, ranked."""
    def top(col: str, kind: str, n: int) -> DataFrame:
        g = (sales.groupBy(F.col(col).alias("name")).agg(money_sum(F.col("total_sales")).alias("t"))
                  .orderBy(F.desc("t"), "name").limit(n))
        w = Window.orderBy(F.desc("t"), "name")  # over <= n rows after the limit
        return g.select(F.lit(kind).alias("kind"), F.coalesce(F.trim("name"), F.lit("")).alias("name"),
                        cents_to_int(F.col("t")).alias("sales"), F.row_number().over(w).alias("rank"))
    return top("product_name", "product", n_products).unionByName(top("category_name", "category", n_categories))


def sale_top15(sales: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` largest sale rows, with "id (name[:18])" labels."""
    name = F.coalesce(F.col("product_name"), F.lit(""))
    label = F.when(F.trim(name) != "",
                   F.concat(F.col("sale_id"), F.lit(" ("), F.substring(name, 1, 18), F.lit(")"))
                   ).otherwise(F.col("sale_id"))
    top = sales.select("sale_id", name.alias("product"), _money(sales).alias("_v"), label.alias("label"))
    return (top.orderBy(F.desc("_v"), "sale_id").limit(n)
               .select("sale_id", "product", round_int(F.col("_v")).alias("total_sales"), "label"))


def continent_country_rollup(sales: DataFrame, years=None) -> DataFrame:
    """ROLLUP(continent, country) of B1 totals with the percentage of
    each row within its parent level (1 decimal)."""
    b1 = store_sales(sales, years).join(
        store_continent(sales), "store_id", "left")
    r = (b1.rollup("continent", "country").agg(F.sum("total_sales").alias("total_sales"),
                                                F.grouping_id().alias("_g"))
           .filter(F.col("_g") < 3))
    parent = F.when(F.col("_g") == 1, F.lit(None).cast("string")).otherwise(F.col("continent"))
    w = Window.partitionBy(F.col("_g"), parent)
    pct = F.bround(F.col("total_sales") / F.sum("total_sales").over(w) * 100.0, 1)
    return r.select(F.when(F.col("_g") == 1, "continent").otherwise("country").alias("level"),
                    "continent", "country", "total_sales", pct.alias("pct"))


def store_continent(sales: DataFrame) -> DataFrame:
    """store_id -> continent (first seen by date, sale_id)."""
    return sales.groupBy("store_id").agg(
        F.min_by("continent", F.struct("sale_date", "sale_id")).alias("continent"))


def period_category_matrix(sales: DataFrame, years=None) -> DataFrame:
    """(quarter period, category) sales plus each category's share over
    all periods (the pie). Long form; the zero-filled matrix is produced at
    the output edge by :func:`pivot_wide` with a literal category list."""
    s = base_years(sales, years).filter(F.col("sale_date").isNotNull())
    s = s.select(F.format_string("%d-Q%d", F.col("sale_year"), F.quarter("sale_date")).alias("period"),
                 F.trim("category_name").alias("category"), cents(F.col("total_sales")).alias("v"))
    cells = s.groupBy("period", "category").agg(F.sum("v").alias("raw"))
    all_tot = cells.select(F.sum("raw")).scalar()  # one-row scalar subquery
    cat_tot = F.sum("raw").over(Window.partitionBy("category"))
    return cells.select("period", "category", cents_to_int(F.col("raw")).alias("total_sales"),
                        F.bround(cat_tot / all_tot * 100.0, 1).alias("category_pct"))


def store_list(sales: DataFrame) -> DataFrame:
    """One row per store: first name and first non-empty country seen
    (by sale_date, sale_id), ordered by (upper(id), id)."""
    first_key = F.struct("sale_date", "sale_id")
    d = sales.groupBy(F.trim("store_id").alias("store_id")).agg(
        F.min_by("store_name", first_key).alias("store_name"),
        F.min_by(F.when(F.col("country").isNotNull(), F.col("country")),
                 F.when(F.col("country").isNotNull(), first_key)).alias("country"))
    return d.select("store_id", F.coalesce(F.trim("store_name"), F.col("store_id")).alias("store_name"),
                    F.coalesce(F.trim("country"), F.lit("")).alias("country"))


def store_summary(sales: DataFrame) -> DataFrame:
    """Per store: total sales (2 dec.), distinct product names, name."""
    first_key = F.struct("sale_date", "sale_id")
    return sales.groupBy(F.trim("store_id").alias("store_id")).agg(
        cents_to_money(money_sum(F.col("total_sales"))).alias("total_sales"),
        F.countDistinct("product_name").alias("product_count"),
        F.min_by("store_name", first_key).alias("store_name"))


def last_updated(sales: DataFrame) -> DataFrame:
    """Latest sale date as yyyy-MM-dd."""
    return sales.agg(F.date_format(F.max("sale_date"), "yyyy-MM-dd").alias("last_updated"))


def stores_of_country(sales: DataFrame, country: str | None = None, years=None) -> DataFrame:
    """B1 rows of a country in descending order; for every country at
    once the rank within the country is returned."""
    b1 = store_sales(sales, years)
    if country:
        b1 = b1.filter(F.col("country") == country.strip())
    w = Window.partitionBy("country").orderBy(F.desc("total_sales"), "store_id")
    return b1.withColumn("rank", F.row_number().over(w))


def store_list_by_region(sales: DataFrame, continent: str | None = None,
                         country: str | None = None) -> DataFrame:
    """B20 with continent, filtered by continent and country options."""
    out = store_list(sales).join(store_continent(sales), "store_id", "left")
    out = out.withColumn("continent", F.coalesce("continent", F.lit("")))
    if continent:
        out = out.filter(F.lower("continent") == continent.strip().lower())
    if country:
        out = out.filter(F.lower("country") == country.strip().lower())
    return out


def sales_summary(sales: DataFrame, years=None, target: int | None = None) -> DataFrame:
    """One row: total of rounded store totals, store count, and the
    money forecast (D3) with its method. The child lists are B1/B3/B4/B7/B8
    /B10 (each its own job)."""
    from shelfcast.operators.forecast import sales_forecast_from_qty
    from shelfcast.sources.tpch import BASE_YEARS, TARGET_YEAR
    years = years or BASE_YEARS
    d3 = sales_forecast_from_qty(sales, years, target or TARGET_YEAR)
    box = sales_box(sales, years)
    return box.select("total_sum", "store_count",
                      d3.select("predicted_sales").scalar().alias("predicted_sales"),
                      d3.select("method").scalar().alias("forecast_method"))
