"""Sources S1-S5: the sales table from Parquet/CSV, SQL INSERT dumps and
feedback JSON, all as Spark readers (no driver-side parsing)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.schema import canonicalize

# ---- fixed values ----------------------------------------------------------
DUMP_COLUMNS = ["sale_id", "sale_date", "store_id", "product_id", "quantity", "product_name", "category_id",
                "launch_date", "price", "category_name", "store_name", "city", "country", "total_sales",
                "store_stock_quantity", "inventory", "frozen_money", "safety_stock", "status"]
BOM = "﻿"
NULL_TOKEN = "NULL"
# ---------------------------------------------------------------------------


def scan_sales(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a stored sales table and canonicalize it (names, types,
    text cleaning, optional columns back-filled)."""
    if fmt == "csv":
        return scan_csv(spark, path)
    return canonicalize(spark.read.format(fmt).load(path))


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3: CSV with a header, read as strings (PERMISSIVE) and coerced by
    :func:`canonicalize`; a BOM on the first header name is removed."""
    raw = (spark.read.option("header", True).option("mode", "PERMISSIVE").option("inferSchema", False)
                .option("encoding", "UTF-8").csv(path))
    raw = raw.toDF(*[c.lstrip(BOM).strip() for c in raw.columns])
    return canonicalize(raw)


def scan_insert_dump(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """``INSERT INTO ... VALUES`` text dumps written one tuple per line.
    Lines starting with "(" are parsed with ``from_csv`` (quote and escape
    are the single quote, so '' is a literal quote); NULL becomes NULL;
    lines that do not parse keep their text in ``_corrupt``."""
    cols = columns or DUMP_COLUMNS
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cols] +
                          [T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter(F.col("line").startswith("("))
    body = F.regexp_extract("line", r"^\((.*)\)\s*[,;]?\s*$", 1)
    opts = {"quote": "'", "escape": "'", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true",
            "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = lines.select(F.from_csv(body, schema.simpleString(), opts).alias("r")).select("r.*")
    out = parsed.select(*[F.when(F.trim(F.col(c)) == NULL_TOKEN, F.lit(None)).otherwise(F.col(c)).alias(c) for c in cols],
                        "_corrupt")
    return out


def scan_feedback(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of feedback records per file (multiLine)."""
    schema = "ts timestamp, store_id string, user_id int, feedback map<string,int>, clicked_items array<string>"
    return spark.read.schema(schema).option("multiLine", True).json(path)
