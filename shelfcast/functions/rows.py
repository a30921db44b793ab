"""Deterministic "first row" aggregation.

The reference takes the first row of a group in file order; here the first
row is the one with the smallest (sale_date, sale_id). One
``min(struct(sale_date, sale_id, a, b, ...))`` returns all wanted
attributes of that row in a single aggregate (sale_id is unique, so the
extra fields never decide the order); several ``min_by`` calls would each
keep their own copy of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("sale_date", "sale_id")
# Cut points of a global order, and the rows they are chosen from (taken in
# the order of a hash of the key: a bounded sample that does not depend on
# how rows are partitioned).
CUTS, CUT_ROWS, HOP = 256, 8192, 16


def first_row(*cols: str) -> Column:
    """Aggregate: struct with fields ``cols`` of the first row (alias it and
    read fields as ``alias.col``)."""
    key = [F.col(c).alias(f"_k{i}") for i, c in enumerate(ORDER)]
    return F.min(F.struct(*key, *[F.col(c) for c in cols]))


def running_total(df: DataFrame, key: Column, weight: Column, name: str) -> DataFrame:
    """``df`` with ``name`` = sum of ``weight`` over all rows up to and
    including this one in the order of ``key`` (any orderable, unique value).

    No un-partitioned window and nothing that depends on physical
    partitions: rows fall into buckets between cut points of the key itself,
    each bucket has its own window, and the totals of earlier buckets (at
    most CUTS + 1 rows) are added. One plan for all sizes, no job is run here."""
    d = df.withColumn("_key", key).withColumn("_w", weight)
    some = d.select("_key").orderBy(F.xxhash64("_key"), "_key").limit(CUT_ROWS)
    step = max(1, CUT_ROWS // CUTS)
    cuts = some.agg(F.sort_array(F.collect_list("_key")).alias("c")).select(
        F.filter("c", lambda x, i: i % step == step - 1)).scalar()
    # the bucket by every HOP-th cut first, then by the HOP cuts behind the last one passed
    less = lambda c: c < F.col("_key")
    hops = F.filter("_cuts", lambda x, i: i % HOP == HOP - 1)
    d = d.withColumn("_cuts", cuts).withColumn("_hop", HOP * F.size(F.filter(hops, less)))
    d = d.withColumn("_b", F.col("_hop") + F.size(F.filter(F.slice("_cuts", F.col("_hop") + 1, HOP), less))).drop("_cuts", "_hop")
    total = d.groupBy("_b").agg(F.sum("_w").alias("_t"))
    before = total.select("_b", (F.sum("_t").over(Window.orderBy("_b")) - F.col("_t")).alias("_before"))
    own = F.sum("_w").over(Window.partitionBy("_b").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0))
    return (d.withColumn("_own", own).join(F.broadcast(before), "_b")
            .withColumn(name, F.col("_before") + F.col("_own")).drop("_b", "_before", "_own", "_key", "_w"))


def global_rank(df: DataFrame, value: str, tie: str, descending: bool = True) -> DataFrame:
    """``rank`` 1..n by ``value``, ties by ``tie`` ascending; (value, tie) is unique."""
    v = -F.col(value) if descending else F.col(value)
    return running_total(df, F.struct(v.alias("v"), F.col(tie).alias("t")), F.lit(1).cast("long"), "rank")


def exact_percentile(df: DataFrame, col: str, p: float) -> Column:
    """Exact linear-interpolation percentile (pandas / NumPy default, DuckDB
    ``quantile_cont``) of ``col`` over the whole DataFrame, as a scalar
    subquery column. Distinct values are counted first, so repeated values
    are one row; of the running counts only the two rows around position
    (n-1)p are read."""
    v = df.select(F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    n = v.groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    pos = (v.agg(F.count(F.lit(1))).scalar() - 1) * F.lit(float(p))
    upto = running_total(n, F.col("_v"), F.col("_n"), "_upto").withColumn("_pos", pos)
    # the smallest values of which more than floor / ceil of the position are not larger
    lo = F.min(F.when(F.col("_upto") > F.floor("_pos"), F.col("_v")))
    hi = F.min(F.when(F.col("_upto") > F.ceil("_pos"), F.col("_v")))
    part = F.max(F.col("_pos") - F.floor("_pos"))
    return upto.agg((lo + part * (hi - lo)).alias("p")).scalar()
