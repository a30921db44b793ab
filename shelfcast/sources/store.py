"""Stored forms of the sales and of the inventory snapshot for jobs that run often.

* Sales by ``sale_year`` folders: base-year jobs (P1) list and read only their years, also
  where the years come from a joined table (dynamic partition pruning).
* The snapshot as a table bucketed and sorted by (store_name, product_id): the views
  I7, I13 and I17-I21 group by these keys where the rows lie, without an exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.moves import moved

SNAPSHOT_KEYS = ["store_name", "product_id"]
BUCKETS, FILES_PER_YEAR = 32, 8
BUCKET_ROWS = 1_000_000             # rows that one task sorts and writes, about


def write_sales(sales: DataFrame, path: str, files: int = FILES_PER_YEAR) -> str:
    """One folder per sale_year of up to ``files`` files; a year is dealt by a hash of
    the sale, so a year that holds most rows is written by several tasks."""
    part = F.pmod(F.xxhash64("sale_id"), F.lit(files))
    (sales.repartition(F.col("sale_year"), part).sortWithinPartitions("sale_year", "sale_date")
     .write.mode("overwrite").partitionBy("sale_year").parquet(path))
    return path


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def sales_of(sales: DataFrame, years: DataFrame) -> DataFrame:
    """Sales of the years in ``years`` (column sale_year)."""
    return sales.join(years.select("sale_year").distinct(), "sale_year", "left_semi")


def buckets_of(rows: int) -> int:
    """Buckets for a snapshot of ``rows`` rows: a task sorts about ``BUCKET_ROWS`` of them in memory."""
    return max(BUCKETS, -(-rows // BUCKET_ROWS))


def dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows as the buckets hold them, for :func:`write_snapshot`."""
    return moved(rows, buckets, *SNAPSHOT_KEYS)


def write_snapshot(snapshot: DataFrame, name: str, path: str, buckets: int = BUCKETS, lies: bool = False) -> DataFrame:
    """The snapshot as table ``name`` in ``path``: one sorted file per bucket, as rows
    are :func:`dealt` by the bucket keys before they are written (``lies``: they are already)."""
    (snapshot if lies else dealt(snapshot, buckets)).write.mode("overwrite").format("parquet").option("path", path).option(
        "compression", "zstd").bucketBy(buckets, *SNAPSHOT_KEYS).sortBy(*SNAPSHOT_KEYS).saveAsTable(name)
    return read_snapshot(snapshot.sparkSession, name)


def read_snapshot(spark: SparkSession, name: str) -> DataFrame:
    """The stored snapshot. Its sort order is used by aggregates if the session has
    ``spark.sql.legacy.bucketedTableScan.outputOrdering`` on."""
    return spark.table(name)
