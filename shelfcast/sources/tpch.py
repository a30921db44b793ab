"""The canonical ``sales`` view over the driver's star-schema tables.

Mapping: one sale = one lineitem; store = supplier; product = part;
category = part type; country/continent = nation/region; basket = order.
The same view is written once as a DataFrame and once as DuckDB SQL text
(:data:`SALES_CTE`) so every oracle query starts from identical rows.

Scale notes: lineitem is the fact. part and supplier grow with the data
(20e9 and 1e9 rows at 100 TB), so no broadcast is forced on them; AQE picks
broadcast-hash only when runtime statistics are under
``autoBroadcastJoinThreshold`` (a checked size) and sort-merge otherwise.
nation and region have a fixed size (25 and 5 rows), so they are joined to
supplier first and broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Default analysis window for the driver's data (ship dates 1995-2001;
# 2001 is partial, so it is the prediction target, not a base year).
BASE_YEARS = (1996, 2000)
TARGET_YEAR = 2001
# Parameter for the inventory synth (I2) on this data: the reference pushes
# five named flagship products into overstock; these five part names play
# that role here.
OVERSTOCK_PRODUCTS = ["blue anvil", "blue bolt", "blue gear", "blue gizmo", "blue plate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def store_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier + nation + region: one row per store."""
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    reg = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = nat.join(F.broadcast(reg), nat.n_regionkey == reg.r_regionkey)
    s = sup.join(F.broadcast(geo), sup.s_nationkey == geo.n_nationkey)
    return s.select(
        F.col("s_suppkey").alias("_suppkey"),
        F.col("s_suppkey").cast("string").alias("store_id"),
        F.col("s_name").alias("store_name"),
        F.concat(F.col("n_name"), F.lit("-"), (F.col("s_suppkey") % 4).cast("string")).alias("city"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("continent"),
    )


def product_launch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """launch_date = first order date of the part (one row per product)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return (li.join(od, li.l_orderkey == od.o_orderkey)
              .groupBy("l_partkey")
              .agg(F.to_date(F.min("o_orderdate")).alias("launch_date"))
              .withColumnRenamed("l_partkey", "_lpartkey"))


SALES_COLUMNS = ["sale_id", "basket_id", "sale_date", "sale_year", "store_id", "store_name", "city", "country",
                 "continent", "product_id", "product_name", "category_id", "category_name", "quantity", "price",
                 "total_sales"]
# What sale_columns makes the other columns of a sale from.
ROW_COLUMNS = ["l_orderkey", "l_linenumber", "sale_date", "store_id", "store_name", "country", "continent", "product_id",
               "product_name", "category_name", "quantity", "price", "total_sales"]


def sale_rows(spark: SparkSession, sf_dir: str, launch: bool = False, by_product: bool = False) -> DataFrame:
    """The rows of the sales view without the columns that others imply (:func:`sale_columns`
    adds them): what a job moves between tasks. ``by_product`` joins the products last, on the
    text of their key, so that later steps by ``product_id`` find a product's rows in one place."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").alias("total_sales"), F.to_date("l_shipdate").alias("sale_date"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_retailprice")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    reg = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = nat.join(F.broadcast(reg), nat.n_regionkey == reg.r_regionkey)
    if launch:  # by product first: the fact's rows move as they lie in the table, without the dimensions' texts
        li = li.join(product_launch(spark, sf_dir), F.col("l_partkey") == F.col("_lpartkey"), "left")
    li = li.withColumn("product_id", F.col("l_partkey").cast("string"))
    # Fact joins plain dimension scans first, so the planner sees their
    # real (file) sizes; the fixed-size geography is broadcast last.
    s = li if by_product else li.join(part, F.col("l_partkey") == part.p_partkey)
    s = (s.join(sup, F.col("l_suppkey") == sup.s_suppkey)
          .join(F.broadcast(geo), F.col("s_nationkey") == geo.n_nationkey))
    if by_product:
        key = F.col("p_partkey").cast(li.schema["l_partkey"].dataType).cast("string")
        s = s.join(part.withColumn("_product", key), F.col("product_id") == F.col("_product"))
    names = {"store_name": "s_name", "country": "n_name", "continent": "r_name", "product_name": "p_name",
             "category_name": "p_type", "price": "p_retailprice"}
    s = s.withColumn("store_id", F.col("s_suppkey").cast("string"))
    return s.select(*[F.col(names.get(c, c)).alias(c) for c in ROW_COLUMNS], *(["launch_date"] if launch else []))


def sale_columns(rows: DataFrame) -> DataFrame:
    """:func:`sale_rows` with all columns of a sale; further columns stay behind them."""
    made = {"sale_id": F.concat_ws("-", "l_orderkey", "l_linenumber", "product_id", "store_id"),
            "basket_id": F.col("l_orderkey").cast("string"), "sale_year": F.year("sale_date"),
            "city": F.concat(F.col("country"), F.lit("-"), (F.col("store_id").cast("long") % 4).cast("string")),
            "category_id": F.col("category_name")}
    return rows.select(*[made[c].alias(c) if c in made else c for c in SALES_COLUMNS],
                       *[c for c in rows.columns if c not in ROW_COLUMNS])


def tpch_sales(spark: SparkSession, sf_dir: str, launch: bool = False, by_product: bool = False) -> DataFrame:
    """The canonical sales DataFrame (plus ``basket_id``, ``continent``,
    ``sale_year``). ``launch=True`` adds ``launch_date`` (costs one more
    join with orders, so only jobs that use it ask for it); ``by_product``: see :func:`sale_rows`."""
    return sale_columns(sale_rows(spark, sf_dir, launch, by_product))


SALES_CTE = """sales AS (
  SELECT
    concat_ws('-', l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey) AS sale_id,
    CAST(l.l_orderkey AS VARCHAR) AS basket_id,
    CAST(l.l_shipdate AS DATE) AS sale_date,
    CAST(year(l.l_shipdate) AS INTEGER) AS sale_year,
    CAST(l.l_suppkey AS VARCHAR) AS store_id,
    s.s_name AS store_name,
    n.n_name || '-' || CAST(s.s_suppkey % 4 AS VARCHAR) AS city,
    n.n_name AS country,
    r.r_name AS continent,
    CAST(l.l_partkey AS VARCHAR) AS product_id,
    p.p_name AS product_name,
    p.p_type AS category_id,
    p.p_type AS category_name,
    CAST(l.l_quantity AS INTEGER) AS quantity,
    p.p_retailprice AS price,
    l.l_extendedprice AS total_sales
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

LAUNCH_CTE = """launch AS (
  SELECT CAST(l.l_partkey AS VARCHAR) AS product_id, CAST(min(o.o_orderdate) AS DATE) AS launch_date
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  GROUP BY l.l_partkey
), sales_l AS (
  SELECT s.*, launch.launch_date FROM sales s LEFT JOIN launch USING (product_id)
)"""


def with_sales(body: str, launch: bool = False) -> str:
    """Prefix an oracle query with the sales CTE (and ``sales_l`` with
    launch dates). ``body`` may start with further ``name AS (...)`` CTEs
    when it begins with a comma."""
    ctes = SALES_CTE + (",\n" + LAUNCH_CTE if launch else "")
    body = body.strip()
    if body.startswith(","):
        return f"WITH {ctes}{body}"
    return f"WITH {ctes}\n{body}"
