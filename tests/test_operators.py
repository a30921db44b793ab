import random

from pyspark.sql import functions as F

from shelfcast.operators import forecast as D
from shelfcast.operators import recommend as R


def test_ols_edges(spark):
    rows = [("two", 2020, 10.0), ("two", 2021, 20.0), ("one", 2020, 7.0),
            ("flat", 2020, 5.0), ("flat", 2020, 9.0)]
    df = spark.createDataFrame(rows, "k string, y int, v double")
    got = {r["k"]: r["predicted"] for r in D.linear_trend(df, ["k"], "y", "v", 2025).collect()}
    assert got == {"two": 60, "one": 7, "flat": 7}


def test_endpoint_trend(spark):
    df = spark.createDataFrame([("a", 2020, 100.0), ("a", 2022, 200.0), ("b", 2025, 50.0), ("b", 2020, 1.0)],
                               "k string, y int, v double")
    got = {r["k"]: r["forecast"] for r in D.endpoint_trend(df, ["k"], "y", "v", 2025).collect()}
    assert got == {"a": 350.0, "b": 50.0}


def test_topk_unowned_matches_brute_force(spark):
    rnd = random.Random(7)
    items = [(f"p{i}", rnd.random()) for i in range(40)]
    owned = [(f"s{s}", f"p{i}") for s in range(6) for i in range(40) if rnd.random() < 0.4]
    g = spark.createDataFrame(items, "product_id string, v double")
    ranked = R.global_rank(g, "v", "product_id")
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 41))
    own = spark.createDataFrame(owned, "store_id string, product_id string")
    stores = spark.createDataFrame([(f"s{s}",) for s in range(6)], "store_id string")
    got = {}
    for r in R.topk_unowned(ranked, own, stores, 5).collect():
        got.setdefault(r["store_id"], []).append((r["rank"], r["product_id"]))
    order = [p for p, _ in sorted(items, key=lambda t: (-t[1], t[0]))]
    for s in range(6):
        mine = {p for st, p in owned if st == f"s{s}"}
        expect = [p for p in order if p not in mine][:5]
        assert [p for _, p in sorted(got.get(f"s{s}", []))] == expect


def test_inventory_status_edges(spark):
    from shelfcast.operators.inventory import inventory_snapshot
    rows = [("1", "s", "p", 1, 10.0, 5, 5, None), ("2", "s", "p", 1, 10.0, 15, 5, None),
            ("3", "s", "p", 1, 10.0, 16, 5, None), ("4", "s", "p", 1, 10.0, 0, 5, None)]
    df = spark.createDataFrame(rows, "sale_id string, store_name string, product_id string, quantity int, price double, "
                                     "inventory int, safety_stock int, status string")
    got = {r["sale_id"]: r for r in inventory_snapshot(df).collect()}
    assert got["1"]["frozen_money"] == 40.0
    assert got["4"]["frozen_money"] == 0.0


def test_grade_edges(spark):
    from shelfcast.operators.grading import _grade
    perf = spark.createDataFrame([("c", "A", 8000), ("c", "B", 7990), ("c", "C", 10000)], "country string, store_name string, c long")
    got = {r["store_name"]: r["grade"] for r in _grade(perf, F.lit(100.0)).collect()}
    assert got == {"A": "A", "B": "C", "C": "S"}


def test_exact_percentile(spark):
    import numpy as np
    from shelfcast.functions import rows
    for n, p in ((501, 0.75), (4, 0.25), (1, 0.75), (30_000, 0.9)):
        vals = np.random.default_rng(1).normal(size=n).round(2)  # many ties
        df = spark.createDataFrame([(float(x),) for x in vals], "x double")
        got = df.select(rows.exact_percentile(df, "x", p)).first()[0]
        assert abs(got - float(np.percentile(vals, 100 * p))) < 1e-9


def test_global_rank_of_many_wide_rows(spark):
    from shelfcast.functions.rows import global_rank
    n = 200_000
    df = spark.range(n).select(F.concat(F.lit("p"), F.col("id")).alias("product_id"), (F.col("id") % 977).cast("double").alias("v"),
                               F.repeat(F.lit("x"), 200).alias("wide"))
    r = global_rank(df, "v", "product_id")
    got = r.agg(F.count("*"), F.countDistinct("rank"), F.min("rank"), F.max("rank")).first()
    assert tuple(got) == (n, n, 1, n)
    # the order is by falling v, ties by id
    top = [(x.v, x.product_id) for x in r.filter("rank <= 300").orderBy("rank").collect()]
    assert top == sorted(top, key=lambda t: (-t[0], t[1]))
    # a store that owns most of the head of the list still gets its items
    own = r.filter("rank <= 1000 AND rank % 5 < 3").selectExpr("'s' AS store_id", "product_id")
    got = R.topk_unowned(r, own, spark.createDataFrame([("s",)], "store_id string"), 5).collect()
    assert sorted(x["rank"] for x in got)[:5] == [3, 4, 8, 9, 13]


def test_mean_forecast_drops_outlier_days_and_short_series(spark):
    import datetime as dt
    days = [(f"{i}", "s", dt.date(2024, 1, i), 10.0 + i % 2) for i in range(1, 10)] + [("x", "s", dt.date(2024, 1, 10), 9000.0),
                                                                                       ("y", "t", dt.date(2024, 1, 1), 5.0)]
    df = spark.createDataFrame(days, "sale_id string, store_id string, sale_date date, total_sales double")
    got = D.mean_forecast(df, 1).collect()
    assert [(r["store_id"], r["date"], r["value"]) for r in got] == [("s", "2024-01-10", 10.56)]


def test_growth_fallback_needs_two_quarters(spark):
    q = spark.createDataFrame([("a", 8000, 10), ("b", 8000, 10), ("b", 8001, 11)], "product_id string, qi int, q long")
    assert {r["product_id"] for r in D.quarter_growth_fallback(q).collect()} == {"b"}



def test_demand_dashboard_fallback(spark):
    import datetime as dt
    from shelfcast.operators.demand import demand_dashboard
    rows = [("1", dt.date(2000, 1, 5), 2000, "Asia", "X", 3), ("2", dt.date(2000, 2, 5), 2000, "Asia", "Y", 2),
            ("3", dt.date(1999, 2, 5), 1999, "Europe", "X", 7)]
    df = spark.createDataFrame(rows, "sale_id string, sale_date date, sale_year int, continent string, "
                                     "category_name string, quantity int").withColumn("country", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("c"))
    got = {(r["region"], r["category"]): (r["quantity"], r["is_fallback"], r["total_demand"])
           for r in demand_dashboard(df, "continent", 2000).collect()}
    assert got[("Asia", "X")] == (3, False, 5)
    assert got[("Europe", "X")] == (3, True, 5) and got[("Europe", "Y")] == (2, True, 5)


def test_growth_fallback_when_nothing_passes(spark):
    from shelfcast.operators import scoring as W
    prods = spark.createDataFrame(
        [("s1", "p1", "Widget", 50.0, 0.35, 100, ["economy"], 1, None),
         ("s2", "p2", "Widget", 50.0, 0.35, 10, ["promo"], 1, None)],
        "store_id string, product_id string, product_name string, price double, margin double, stock_age int, "
        "compatibility_tags array<string>, stock long, expected_eta string")
    targets = spark.createDataFrame([("s1", ["large"], 900.0, None), ("s2", ["promo"], 900.0, None)],
                                    "store_id string, target_tags array<string>, main_device_price double, target_charger string")
    scored = W.score_products(prods, targets)
    got = {r["store_id"]: r for r in scored.collect()}
    assert got["s1"]["passed"] is False and got["s2"]["passed"] is True
    # stock age 100 > 90: investor 0.35 x 1.5; operation 100/180
    assert got["s2"]["rank"] == 1 and got["s1"]["rank"] is None
    sales = spark.createDataFrame([("s1",), ("s2",)], "store_id string")
    fb = {(r["store_id"], r["rank"]): r["product_id"] for r in W.growth_fallback(sales, scored).collect()}
    assert fb == {("s1", 1): "FB-1", ("s1", 2): "FB-2", ("s1", 3): "FB-3"}


def test_latent_demand_matches_numpy_svd(spark):
    import datetime as dt
    import numpy as np
    from shelfcast.operators import recommend as R
    rng = np.random.default_rng(3)
    n_s, n_p = 7, 12
    x = np.where(rng.random((n_s, n_p)) < 0.45, rng.integers(1, 9, (n_s, n_p)), 0).astype(float)
    rows, k = [], 0
    for i in range(n_s):
        for j in range(n_p):
            if x[i, j] > 0:
                k += 1
                rows.append((f"t{k}", dt.date(2000, 1, 1), f"s{i}", f"p{j:02d}", int(x[i, j])))
    sales = spark.createDataFrame(rows, "sale_id string, sale_date date, store_id string, product_id string, quantity int")
    got = {}
    for r in R.latent_demand(sales, top_n=3, max_rank=3).collect():
        got.setdefault(r["store_id"], []).append((r["rank"], r["product_id"], r["predicted_sales"]))
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    kk = max(2, min(3, n_s - 1, n_p - 1))
    xk = (u[:, :kk] * s[:kk]) @ vt[:kk]
    for i in range(n_s):
        cand = [(-xk[i, j], f"p{j:02d}") for j in range(n_p) if x[i, j] == 0 and xk[i, j] > 1e-9]
        want = [p for _, p in sorted(cand)[:3]]
        mine = [p for _, p, _ in sorted(got.get(f"s{i}", []))]
        assert mine == want
        for _, p, v in got.get(f"s{i}", []):
            assert abs(v - round(xk[i, int(p[1:])], 2)) < 0.011


def test_tolerant_stock_signal(spark):
    from shelfcast.operators.inventory import tolerant_stock_signal
    lst = spark.createDataFrame(
        [("Apple SoHo", "p1", "MacBook Pro 16-inch", 2, 5, "Danger", 50.0, 1.0),
         ("Apple Ginza", "p1", "MacBook Pro 16-inch", 9, 5, "Normal", 90.0, 1.0),
         ("Apple SoHo", "p2", "iPad", 1, 0, "Normal", 10.0, 1.0)],
        "store_name string, product_id string, product_name string, inventory long, safety_stock long, "
        "status string, frozen_money double, price double")
    r = tolerant_stock_signal(lst, "MacBook Pro", "SoHo").collect()
    assert len(r) == 1 and r[0]["store_name"] == "Apple SoHo" and r[0]["signal"] == "red"
    r = tolerant_stock_signal(lst, "MacBook Pro 16-inch (2023)", "Nowhere").collect()
    assert r[0]["store_name"] == "Apple Ginza" and r[0]["signal"] == "green"   # product-only fallback, most frozen
    assert tolerant_stock_signal(lst, "iPad", None).collect()[0]["signal"] == "green"   # safety 0
    assert tolerant_stock_signal(lst, "", None).count() == 0


def _sales(spark, rows):
    import datetime as dt
    return spark.createDataFrame(
        [(f"x{i}", dt.date.fromordinal(d), s, p, b, q, 1.0 * q) for i, (d, s, p, b, q) in enumerate(rows)],
        "sale_id string, sale_date date, store_id string, product_id string, basket_id string, quantity int, total_sales double")


def test_fixture_gap_days(spark):
    import datetime as dt
    from shelfcast.operators.forecast import daily_sales_dense
    d0 = dt.date(2024, 1, 1).toordinal()
    s = _sales(spark, [(d0, "s", "p", "b1", 2), (d0 + 1, "s", "p", "b2", 3), (d0 + 9, "s", "p", "b3", 4)])
    out = daily_sales_dense(s).collect()
    assert len(out) == 10 and sum(1 for r in out if r["value"] == 0) == 7


def test_fixture_windows_90d(spark):
    import datetime as dt
    from shelfcast.operators.recommend import trend
    last = dt.date(2024, 6, 30).toordinal()
    s = _sales(spark, [(last, "s1", "Z", "b1", 1), (last - 90, "s2", "A", "b2", 5),
                       (last - 180, "s2", "B", "b3", 4), (last, "s2", "B", "b4", 10)])
    got = {(r["store_id"], r["product_id"]): (r["growth_rate"], r["recent_sales"]) for r in trend(s).collect()}
    assert got[("s1", "A")] == (999.0, 5)        # L-90 is inside the recent window; new product
    assert got[("s1", "B")] == (150.0, 10)       # L-180 is inside the previous window
    assert ("s2", "A") not in got and ("s2", "B") not in got   # owned products are never recommended


def test_fixture_baskets(spark):
    import datetime as dt
    from shelfcast.operators.recommend import association
    d = dt.date(2024, 1, 1).toordinal()
    s = _sales(spark, [(d, "s1", "p1", "b1", 5), (d, "s2", "p2", "b1", 1), (d, "s1", "p1", "b2", 5),
                       (d, "s2", "p2", "b2", 1), (d, "s3", "p3", "b3", 1), (d, "s3", "p4", "b4", 1)])
    got = {(r["store_id"], r["product_id"]): (r["lift"], r["confidence"], r["support"]) for r in association(s).collect()}
    assert got[("s1", "p2")] == (2.0, 1.0, 0.5) and got[("s2", "p1")] == (2.0, 1.0, 0.5)
    assert not any(k[0] == "s3" for k in got)   # single-item baskets give no pairs


def test_fixture_vectors(spark):
    import datetime as dt
    from shelfcast.operators.recommend import store_neighbours
    d = dt.date(2024, 1, 1).toordinal()
    s = _sales(spark, [(d, "a", "p1", "b", 1), (d, "a", "p2", "b", 1), (d, "b", "p1", "b", 1), (d, "b", "p2", "b", 1),
                       (d, "c", "p1", "b", 1), (d, "c", "p3", "b", 1), (d, "d", "p4", "b", 1)])
    got = {(r["store_id"], r["other_store"]): round(r["similarity"], 9) for r in store_neighbours(s, k=3).collect()}
    assert got[("a", "b")] == 1.0 and got[("a", "c")] == 0.5 and got[("a", "d")] == 0.0


def test_fixture_half_even(spark):
    import datetime as dt
    from shelfcast.operators.sales import store_sales
    rows = [("s1", 0.5), ("s2", 1.5), ("s3", 2.5), ("s3", 0.0)]
    df = spark.createDataFrame([(st, "c", "k", v, dt.date(1998, 1, 1), 1998) for st, v in rows],
                               "store_id string, city string, country string, total_sales double, sale_date date, sale_year int")
    got = {r["store_id"]: r["total_sales"] for r in store_sales(df, (1996, 2000)).collect()}
    assert got == {"s1": 0, "s2": 2, "s3": 2}


def test_fixture_names(spark):
    from pyspark.sql import functions as F
    from shelfcast.operators.filters import store_name_match
    df = spark.createDataFrame([("Apple SoHo",), ("Apple Store SoHo",), ("SoHo",), ("Apple Rideau Center",), ("Apple Ginza",)],
                               "n string")
    hit = lambda name: sorted(r["n"] for r in df.filter(store_name_match(F.col("n"), name)).collect())
    assert hit("소호(SoHo)") == ["Apple SoHo", "Apple Store SoHo", "SoHo"]
    assert hit("Rideau Centre") == ["Apple Rideau Center"]
    assert hit("") == []


def test_fixture_stock_edges(spark):
    from shelfcast.operators.inventory import inventory_status
    df = spark.createDataFrame([(10, 10), (30, 10), (31, 10), (9, 10), (0, 0), (1, 0)], "inv long, safety long")
    got = [r["s"] for r in df.select(inventory_status(F.col("inv"), F.col("safety")).alias("s")).collect()]
    assert got == ["Normal", "Normal", "Overstock", "Danger", "Normal", "Overstock"]


def test_fixture_outlier_days(spark):
    from shelfcast.operators.filters import iqr_outlier
    vals = [8.0, 10.0, 12.0, 9.0, 11.0, 100.0, 10.0]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(vals)], "store_id string, day int, value double")
    kept = sorted(r["day"] for r in iqr_outlier(df, ["store_id"], "value").collect())
    assert kept == [0, 1, 2, 3, 4, 6]
    flat = spark.createDataFrame([("s", i, 5.0) for i in range(4)] + [("s", 9, 50.0)], "store_id string, day int, value double")
    assert iqr_outlier(flat, ["store_id"], "value").count() == 5   # IQR = 0: nothing removed


def test_fallback_rows_and_leading_engine_per_store(spark):
    from shelfcast.operators import recommend as R
    sales = spark.createDataFrame(
        [(f"s{i}", "2020-01-01", st, f"store {st}", p, f"name {p}", 1, 10.0 * i) for i, (st, p) in
         enumerate([("a", "p"), ("a", "q"), ("b", "q"), ("c", "r")], 1)],
        "sale_id string, sale_date string, store_id string, store_name string, product_id string, product_name string, "
        "quantity int, total_sales double")
    one = spark.createDataFrame([("a", "r", 2.0, 1), ("b", "r", 0.5, 1)], "store_id string, product_id string, lift double, rank int")
    two = spark.createDataFrame([("a", "x", 1.0, 1), ("a", "y", 2.0, 2)], "store_id string, product_id string, g double, rank int")
    recs = R.store_recommendations(sales, {"one": one, "two": two}, {"one": "lift", "two": "g"})
    fall = recs.filter("is_fallback").select("store_id", "engine", "product_id", "rank", "score").collect()
    assert sorted(map(tuple, fall)) == sorted((st, e, p, r, 0.0) for st, e in [("b", "two"), ("c", "one"), ("c", "two")]
                                              for r, p in enumerate("qrp", 1))
    assert {(r.store_id, r.store_total_sales, r.store_product_count) for r in recs.collect()} == {
        ("a", 30.0, 2), ("b", 30.0, 1), ("c", 40.0, 1)}
    got = {(r.store_id, r.engine): (r.avg_score, r.n_products, r.is_best) for r in R.engine_leader(recs).collect()}
    assert got == {("a", "one"): (2.0, 1, True), ("a", "two"): (1.5, 2, False), ("b", "one"): (0.5, 1, True),
                   ("b", "two"): (0.0, 3, False), ("c", "one"): (0.0, 3, False), ("c", "two"): (0.0, 3, False)}
