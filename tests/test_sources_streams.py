import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SMOKE


def test_insert_dump(spark):
    from shelfcast.sources.files import scan_insert_dump
    d = tempfile.mkdtemp(prefix="dump-")
    with open(os.path.join(d, "a.sql"), "w", encoding="utf-8") as f:
        f.write("INSERT INTO sales_data (a, b, c) VALUES\n")
        f.write("(NULL, 1, 'a'),\n")
        f.write("('O''Neil (x), y', 2, 'b');\n")
    out = scan_insert_dump(spark, d, ["a", "b", "c"]).collect()
    assert out[0]["a"] is None and out[0]["c"] == "a"
    assert out[1]["a"] == "O'Neil (x), y" and out[1]["b"] == "2"


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    rows = entry(spark).collect()
    assert len(rows) > 0 and set(rows[0].asDict()) == {"country", "total_sales"}


def in_files(df, order, n=4):
    """``df`` as ``n`` Parquet files that a stream reads one by one; ``order`` deals the rows."""
    out = tempfile.mkdtemp(prefix="stream-in-")
    for i in range(n):
        df.filter(F.pmod(order, F.lit(n)) == i).coalesce(1).write.mode("append").parquet(out)
    return out


def test_event_streams_in_any_order_equal_batch(spark):
    from shelfcast.operators.funnel import journey_funnel
    from shelfcast.streaming import jobs as X
    ev = spark.read.parquet(f"{SMOKE}/events.parquet")
    # days dealt to files backwards: most rows come late
    path = in_files(ev, 100 - F.dayofmonth("ts"))
    want = X.feedback_counts(X.feedback_rows(ev))
    got = X.stream_feedback(X.events_stream(spark, path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, X.stream_funnel(X.events_stream(spark, path)).collect())) == sorted(
        map(tuple, journey_funnel(ev).collect()))
    nothing = X.events_stream(spark, in_files(ev.limit(0), F.lit(0), 1))
    assert X.stream_feedback(nothing).count() == 0


def test_stream_alerts_in_any_order_equal_batch(spark):
    from shelfcast.streaming import jobs as X
    rows = [(f"{s}{p}-{i:02d}", dt.date(2020, 1, 1) + dt.timedelta(days=(i * 7 + ord(p)) % 40), s, p, 1 + (i * 5) % 4)
            for s in "ab" for p in "xyz" for i in range(12)]
    sales = spark.createDataFrame(rows, "sale_id string, sale_date date, store_name string, product_id string, quantity int")
    opening = spark.createDataFrame([("a", "x", 30, 20), ("a", "y", 25, 30), ("a", "z", 500, 10), ("b", "x", 21, 0), ("b", "y", 40, 40)],
                                    "store_name string, product_id string, inventory long, safety_stock long")
    want = sorted(map(tuple, X.critical_alerts_batch(sales, opening).collect()))
    assert len(want) == 4
    path = in_files(sales, 400 - F.dayofyear("sale_date"), 5)
    source = lambda: spark.readStream.schema(sales.schema).option("maxFilesPerTrigger", 1).parquet(path)
    assert sorted(map(tuple, X.stream_critical_alerts(source(), opening, "60 days").collect())) == want
    # with a short delay every sale that comes after the watermark is told, and none is lost
    log = X.alert_log(source(), opening, "1 day")
    assert log.filter("late_sale IS NOT NULL").count() > 0
    assert log.filter("late_sale IS NOT NULL").join(sales, F.col("late_sale") == sales.sale_id).count() == log.filter(
        "late_sale IS NOT NULL").count()


def test_export_enrich_append(spark):
    import datetime as dt
    from shelfcast.operators import prep as K
    from shelfcast.sources.files import scan_insert_dump
    sales = spark.createDataFrame(
        [("a1", dt.date(2024, 1, 2), "ST-1", "MacBook Pro 16-inch", 1, 10.0, None),
         ("a2", dt.date(2024, 1, 3), "ST-1", "O'Neil Case", 2, 5.0, None)],
        "sale_id string, sale_date date, store_id string, product_name string, quantity int, price double, "
        "inventory int")
    out = tempfile.mkdtemp(prefix="export-")
    K.export_parts(sales, out, parts=2, fmt="sql")
    back = scan_insert_dump(spark, out, sales.columns).orderBy("sale_id").collect()
    assert [r["product_name"] for r in back] == ["MacBook Pro 16-inch", "O'Neil Case"]
    patch = spark.createDataFrame(
        [(dt.date(2024, 1, 2), "ST-1", "MacBook-Pro-16-inch", 1, 10.0, 9, 99, 1.0, 1, "Danger", 2),
         (dt.date(2024, 1, 2), "ST-1", "macbook pro 16 inch", 1, 10.0, 70, 40, 12.5, 30, "Normal", 1)],
        "sale_date date, store_id string, product_name string, quantity int, price double, store_stock_quantity int, "
        "inventory int, frozen_money double, safety_stock int, status string, ingest_order int")
    got = {r["sale_id"]: r for r in K.enrich_inventory(sales, patch).collect()}
    assert got["a1"]["_match"] == "matched" and got["a1"]["inventory"] == 40
    assert got["a2"]["_match"] == "not_found" and got["a2"]["inventory"] is None
    assert K.scale_inventory(spark.createDataFrame([(250,), (-5,)], "inventory int")).collect()[0]["inventory"] == 2
    fb = spark.createDataFrame([({"p1": 1, "p2": 0, "p3": 1},)], "feedback map<string,int>")
    log = tempfile.mkdtemp(prefix="fb-")
    res = K.feedback_append(fb, log).collect()[0]
    assert sorted(res["clicked_items"]) == ["p1", "p3"]
    assert spark.read.json(log).count() == 1


def test_stratified_sample_quotas(spark):
    from shelfcast.operators.prep import dashboard_sample
    from shelfcast.sources.tpch import tpch_sales
    s = tpch_sales(spark, SMOKE)
    out = dashboard_sample(s, n=600, min_year=1996, stratify=True)
    got = {r["country"]: r["c"] for r in out.groupBy("country").count().withColumnRenamed("count", "c").collect()}
    base = s.filter("sale_year >= 1996")
    total = base.count()
    for r in base.groupBy("country").count().collect():
        import math
        assert got.get(r["country"], 0) == min(r["count"], math.ceil(r["count"] * 600 / total))
    plain = dashboard_sample(s, n=600, min_year=1996).count()
    assert plain == 600


def test_csv_and_feedback_readers(spark):
    import json
    from shelfcast.sources.files import scan_csv, scan_feedback
    d = tempfile.mkdtemp(prefix="csv-")
    with open(os.path.join(d, "a.csv"), "w", encoding="utf-8") as f:
        f.write("﻿sale_id,Sale_Date,store_id,Product_Name,quantity,price,Store_Name,Country\n")
        f.write("s1,2024-01-05 10:00,ST-1,'MacBook Pro',2,10.50,Apple SoHo,nan\n")
        f.write("s2,bad-date,ST-1,iPad,x,3,Apple SoHo,United States\n")
    rows = {r["sale_id"]: r for r in scan_csv(spark, d).collect()}
    assert str(rows["s1"]["sale_date"]) == "2024-01-05" and rows["s1"]["product_name"] == "MacBook Pro"
    assert rows["s1"]["total_sales"] == 21.0 and rows["s1"]["country"] == ""
    assert rows["s2"]["sale_date"] is None and rows["s2"]["quantity"] == 0 and rows["s2"]["total_sales"] == 0.0
    assert rows["s2"]["city"] == "" and rows["s2"]["inventory"] is None
    fd = tempfile.mkdtemp(prefix="fbjson-")
    with open(os.path.join(fd, "feedback_20260224.json"), "w", encoding="utf-8") as f:
        json.dump([{"ts": "2026-02-24T10:00:00", "store_id": "ST-1", "user_id": 1,
                    "feedback": {"p1": 1, "p2": 0}, "clicked_items": ["p1"]}], f)
    fb = scan_feedback(spark, fd).collect()
    assert len(fb) == 1 and fb[0]["feedback"] == {"p1": 1, "p2": 0} and fb[0]["clicked_items"] == ["p1"]


def test_coerce_and_scan_sales(spark):
    from shelfcast.operators.prep import coerce_sales
    from shelfcast.sources.files import scan_sales
    raw = spark.createDataFrame([("a", "12", "9.999", "2024-03-01xx", "", None), ("b", "oops", "x", "24-3-1", "Danger", "3")],
                                "sale_id string, quantity string, price string, sale_date string, status string, inventory string")
    got = {r["sale_id"]: r for r in coerce_sales(raw).collect()}
    assert got["a"]["quantity"] == 12 and str(got["a"]["price"]) == "10.00" and str(got["a"]["sale_date"]) == "2024-03-01"
    assert got["a"]["status"] == "Normal" and got["a"]["inventory"] == 0
    assert got["b"]["quantity"] == 0 and str(got["b"]["price"]) == "0.00" and got["b"]["sale_date"] is None
    assert got["b"]["status"] == "Danger" and got["b"]["inventory"] == 3
    d = tempfile.mkdtemp(prefix="pq-")
    spark.createDataFrame([("s1", "2023-05-06", "ST-2", "AirPods", 3, 100.0, "Apple Ginza")],
                          "sale_id string, Sale_Date string, store_id string, Product_Name string, quantity int, "
                          "price double, Store_Name string").write.mode("overwrite").parquet(d + "/t")
    r = scan_sales(spark, d + "/t").collect()[0]
    assert r["product_name"] == "AirPods" and r["store_name"] == "Apple Ginza" and r["sale_year"] == 2023
    assert r["total_sales"] == 300.0 and r["safety_stock"] is None


def test_invariants_on_smoke_data(spark):
    from shelfcast.operators import recommend as R
    from shelfcast.operators.sales import country_category_share
    from shelfcast.sources.tpch import tpch_sales
    s = tpch_sales(spark, SMOKE)
    tot = country_category_share(s).groupBy("country").agg(F.sum("pct").alias("t")).collect()
    assert all(abs(r["t"] - 100.0) <= 0.5 for r in tot)
    own = R.owned(s)
    for df in (R.association(s), R.similar_store(s), R.latent_fallback(s), R.trend(s)):
        assert df.join(own, ["store_id", "product_id"], "left_semi").count() == 0
