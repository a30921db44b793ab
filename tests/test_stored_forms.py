"""Plans over the stored forms: pruned years, views without an exchange."""

import tempfile

from pyspark.sql import functions as F

from conftest import SMOKE
from shelfcast.operators import inventory as I
from shelfcast.operators import sales as S
from shelfcast.sources import store
from shelfcast.sources.tpch import BASE_YEARS, OVERSTOCK_PRODUCTS, tpch_sales


def plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_years_are_pruned(spark, capsys):
    path = store.write_sales(tpch_sales(spark, SMOKE), tempfile.mkdtemp(prefix="sales-"))
    sales = store.read_sales(spark, path)
    assert sales.count() == tpch_sales(spark, SMOKE).count()
    text = plan(S.store_sales(sales, (1998, 1999)), capsys)
    part = text[text.index("PartitionFilters: [") + 19:]
    assert "sale_year" in part[: part.index("]")]
    years = spark.createDataFrame([(1998, "x"), (1999, "y")], "sale_year int, note string").filter("note = 'x'")
    got = store.sales_of(sales, years)
    assert "dynamicpruning" in plan(got, capsys)
    assert got.count() == tpch_sales(spark, SMOKE).filter("sale_year = 1998").count()


def test_views_of_the_snapshot_need_no_exchange(spark, capsys):
    snap = I.inventory_snapshot(tpch_sales(spark, SMOKE), overstock_products=OVERSTOCK_PRODUCTS)
    stored = store.write_snapshot(snap, "snapshot_test", tempfile.mkdtemp(prefix="snapshot-"), buckets=4)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    try:
        lst = I.inventory_list(stored)
        text = plan(lst, capsys)
        assert "Exchange" not in text and "Sort [" not in text
        assert "Exchange" in plan(I.inventory_list(snap), capsys)
        for view in (I.stock_signal(lst), I.normal_below_safety(lst)):
            assert "Exchange" not in plan(view, capsys)
        for view in (I.danger_top5_store_product(lst), I.overstock_top5_store(lst), I.frozen_ratio_top20(lst)):
            assert "Exchange" not in plan(view, capsys).replace("TakeOrderedAndProject", "")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.unset("spark.sql.legacy.bucketedTableScan.outputOrdering")
    same = lambda df: sorted(map(tuple, df.collect()))
    assert same(lst) == same(I.inventory_list(snap))
    assert same(I.frozen_money_alert(stored)) == same(I.frozen_money_alert(snap))
    spark.sql("DROP TABLE snapshot_test")


def test_snapshot_moves_rows_before_the_columns_that_others_imply(spark, capsys):
    from shelfcast.plans import q_inventory
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(q_inventory.snap(spark, SMOKE, lambda rows: store.dealt(rows, 4)), capsys)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = text[text.index("MapInArrow"):]
    assert "concat_ws" in text and "concat_ws" not in moved and "md5" not in moved
    # once by product, for the part and the safety stock; the other one is of the statistics
    assert len([x for x in moved.splitlines() if "Exchange hashpartitioning(product_id" in x]) <= 2
    plain = I.inventory_snapshot(tpch_sales(spark, SMOKE), overstock_products=OVERSTOCK_PRODUCTS)
    other = q_inventory.snap(spark, SMOKE, lambda rows: store.dealt(rows, 4)).select(*plain.columns)
    assert other.exceptAll(plain).isEmpty() and plain.exceptAll(other).isEmpty()


def test_buckets_grow_with_the_rows():
    assert store.buckets_of(0) == store.buckets_of(1_000_000) == store.BUCKETS
    assert store.buckets_of(216_000_000) == 216


def test_rows_moved_as_columns_lie_where_repartition_puts_them(spark, monkeypatch):
    from shelfcast.functions import moves
    monkeypatch.setattr(moves, "ROWS", 70)
    rows = spark.range(500).select(F.when(F.col("id") % 9 > 0, F.concat(F.lit("s"), F.col("id") % 7)).alias("store_name"),
                                   F.when(F.col("id") % 11 > 0, (F.col("id") % 13).cast("string")).alias("product_id"),
                                   F.expr("date_add(DATE'2020-01-01', cast(id as int))").alias("d"), (F.col("id") % 3 / 7).alias("x"),
                                   F.when(F.col("id") % 5 > 0, F.col("id") % 20).alias("n")).repartition(3)
    rows = rows.unionByName(rows.filter("n = 1"))
    at = lambda df: sorted(map(str, df.withColumn("at", F.spark_partition_id()).collect()))
    got = moves.moved(rows, 6, *store.SNAPSHOT_KEYS)
    assert got.schema.simpleString() == rows.schema.simpleString()
    assert at(got) == at(rows.repartition(6, *store.SNAPSHOT_KEYS))
    assert at(moves.moved(rows.limit(0), 6, "n")) == []


def test_a_bucket_is_one_file(spark):
    import os
    path = tempfile.mkdtemp(prefix="snapshot-")
    snap = I.inventory_snapshot(tpch_sales(spark, SMOKE), overstock_products=OVERSTOCK_PRODUCTS)
    store.write_snapshot(snap, "snapshot_files", path, buckets=6)
    spark.sql("DROP TABLE snapshot_files")
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 6
