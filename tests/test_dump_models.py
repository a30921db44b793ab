"""SQL dumps written and read by Spark, K6's counters, forecasts by a user's model."""

import datetime as dt
import decimal
import os
import tempfile

import duckdb
import numpy as np
from pyspark.sql import functions as F

from shelfcast.operators import forecast as D
from shelfcast.operators import inventory as I
from shelfcast.operators import prep as K
from shelfcast.sources import dump
from shelfcast.sources.files import DUMP_COLUMNS


def odd_rows(spark, n=1203):
    return spark.createDataFrame(
        [(i, f"O'Neil (x);\n), ('y {i}", dt.date(2024, 1, 1 + i % 28), 1.5 * i if i % 5 else None, None if i % 3 else "NULL",
          decimal.Decimal("12.30"), i % 2 == 0, "C:\\dir") for i in range(n)],
        "id long, name string, day date, v double, n string, m decimal(10,2), b boolean, p string").repartition(3)


def test_dump_read_back_is_equal_and_loads_into_a_database(spark):
    df, path = odd_rows(spark), tempfile.mkdtemp(prefix="dump-")
    dump.write_dump(df, path, table="t")
    dump.write_dump(df, path, table="t")  # overwrites
    back = dump.read_dump(spark, path)
    assert back.columns == [*df.columns, "_corrupt"] and back.filter("_corrupt IS NOT NULL").count() == 0
    same = back.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in df.schema.fields))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, df.collect()))
    parts = sorted(os.listdir(path))
    assert len(parts) == 3 and not any(p.startswith("_") for p in parts)
    con = duckdb.connect()
    for p in parts:
        con.execute(open(f"{path}/{p}", encoding="utf-8").read())
    assert sorted(con.execute("SELECT id, name, day, v, n, m, b, p FROM t").fetchall()) == sorted(map(tuple, df.collect()))


def test_dump_of_no_rows(spark):
    path = tempfile.mkdtemp(prefix="dump-")
    dump.write_dump(odd_rows(spark).limit(0), path)
    assert dump.read_dump(spark, path).count() == 0


def test_both_column_layouts_and_tuples_over_lines(spark, monkeypatch):
    path = tempfile.mkdtemp(prefix="dump-")
    short = DUMP_COLUMNS[:14]
    with open(f"{path}/a.sql", "w", encoding="utf-8") as f:
        f.write("\ufeff-- made by hand; not by a tool\nCREATE TABLE sales_data (\n sale_id TEXT, x INT);\n")
        f.write(f"insert into sales_data ({', '.join(short)})\nvalues\n")
        f.write("('s1',\n '2024-01-05', 'ST-1', NULL, 2, 'Mac (M3)', 'c', null, 10.5, 'Mac',\n'Apple SoHo', 'NY', 'US', 21.0),")
        f.write("('s2', 'too few');\n")
    with open(f"{path}/b.sql", "w", encoding="utf-8") as f:
        f.write(f"INSERT INTO `sales_data` (`{'`, `'.join(DUMP_COLUMNS)}`) VALUES ({', '.join(['1'] * 18)}, 'it''s');\n")
    for chunk in (1 << 20, 7):  # pieces of a few characters cut tuples, headers and letters
        monkeypatch.setattr(dump, "CHUNK", chunk)
        out = dump.read_dump(spark, path)
        assert out.columns == [*DUMP_COLUMNS, "_corrupt"]
        rows = {r.sale_id: r for r in out.collect()}
        assert rows["s1"].product_id is None and rows["s1"].launch_date is None and rows["s1"].product_name == "Mac (M3)"
        assert rows["s1"].quantity == "2" and rows["s1"].status is None
        assert rows["1"].status == "it's" and rows["1"].frozen_money == "1"
        assert rows[None]._corrupt == "'s2', 'too few'"


def test_a_failed_write_leaves_no_parts(spark):
    path = tempfile.mkdtemp(prefix="dump-")
    bad = spark.range(10, numPartitions=2).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise("x").alias("c"))
    try:
        dump.write_dump(bad, path)
        raise AssertionError("must fail")
    except Exception as e:  # noqa: BLE001
        assert "must fail" not in str(e)
    assert os.listdir(path) == []


def test_enrichment_counts_while_it_writes(spark):
    sales = spark.createDataFrame(
        [("a1", dt.date(2024, 1, 2), "ST-1", "MacBook Pro", 1, 10.0), ("a2", dt.date(2024, 1, 3), "ST-1", "Case", 2, 5.0),
         ("a3", None, "ST-1", "Case", 2, 5.0), ("a4", dt.date(2024, 1, 3), "ST-1", None, 2, 5.0)],
        "sale_id string, sale_date date, store_id string, product_name string, quantity int, price double")
    patch = spark.createDataFrame([(dt.date(2024, 1, 2), "ST-1", "macbook-pro", 1, 10.0, 9, 99, 1.0, 1, "Danger", 2)],
                                  "sale_date date, store_id string, product_name string, quantity int, price double, "
                                  "store_stock_quantity int, inventory int, frozen_money double, safety_stock int, status string, ingest_order int")
    path = tempfile.mkdtemp(prefix="enriched-")
    assert K.enrich_into(sales, patch, path) == {"matched": 1, "not_found": 1, "failed": 2}
    assert {r.sale_id: r._match for r in spark.read.parquet(path).collect()} == {
        "a1": "matched", "a2": "not_found", "a3": "failed", "a4": "failed"}


def yearly(spark):
    rows = [(f"t{p}{y}{i}", dt.date(y, 5, 1), f"p{p}", "s1", "cat", y, 10 * p + (y - 1996) * i) for p in (1, 2) for y in range(1996, 2001)
            for i in (1, 2)]
    return spark.createDataFrame(rows, "sale_id string, sale_date date, product_id string, store_id string, category_name string, "
                                       "sale_year int, quantity int")


def test_a_users_model_changes_d2_d9_and_d11(spark):
    def twice_the_best(xs, ys, target):
        assert list(xs) == sorted(xs) and target == 2001
        return 2 * float(np.max(ys))

    s = yearly(spark)
    per_year = {r.sale_year: r.q for r in s.groupBy("sale_year").agg(F.sum("quantity").alias("q")).collect()}
    want = 2 * max(per_year.values())
    got = {r.section: r for r in D.quantity_forecast(s, model=twice_the_best).filter("section = 'predicted'").collect()}
    assert got["predicted"].quantity == want and got["predicted"].key == "twice_the_best"
    plain = D.quantity_forecast(s).filter("section = 'predicted'").first()
    assert plain.key == "linear_trend" and plain.quantity != want
    for a, b in zip(I.product_quarter_share(s, model=twice_the_best).orderBy("product_id").collect(),
                    I.product_quarter_share(s).orderBy("product_id").collect()):
        assert abs(a.product_total / b.product_total - want / plain.quantity) < 1e-9
    per = {r.product_id: r for r in D.product_forecast(s, model=twice_the_best).collect()}
    assert {k: r.predicted_quantity for k, r in per.items()} == {"p1": 2 * 32, "p2": 2 * 52}


def test_a_model_that_fails_falls_back_on_the_trend(spark):
    def bad(xs, ys, target):
        if ys[0] > 30:
            raise ValueError("no")
        return float("nan")

    s = yearly(spark)
    got = sorted((r.product_id, r.predicted_quantity, r.method) for r in D.product_forecast(s, model=bad).collect())
    want = sorted((r.product_id, r.predicted_quantity, "linear_trend") for r in D.product_forecast(s).collect())
    assert got == want
