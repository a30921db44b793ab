"""Steps that must not grow faster than their input: what they move, call or hold."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from shelfcast.operators import recommend, similarity


def matrix_of(spark, x):
    rows = [(f"s{i:04d}", f"p{j:05d}", float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    return spark.createDataFrame(rows, "x string, p string, q double").repartition(4)


def test_neighbours_in_many_cells_equal_brute_force(spark, monkeypatch):
    """Cells of few stores, pairs formed in pieces, dense and sparse sums, ties."""
    rng = np.random.default_rng(3)
    x = rng.integers(1, 5, (90, 60)) * (rng.random((90, 60)) < 0.08)
    x[10:20] = x[:10]  # copies: ties
    x[30:40, 5] = 3
    norm = np.sqrt((x * x).sum(axis=1))
    c = np.divide(x @ x.T, np.outer(norm, norm), out=np.zeros((90, 90)), where=np.outer(norm, norm) > 0)
    for formed in (7, 1 << 20):
        monkeypatch.setattr(similarity, "FORMED", formed)
        got = {}
        for r in similarity.nearest_in_blocks(matrix_of(spark, x), 4, size=8, held=40).orderBy("x", F.desc("similarity"), "y").collect():
            got.setdefault(r.x, []).append((r.y, r.similarity))
        for i in range(90):
            want = sorted((-c[i, j], f"s{j:04d}") for j in range(90) if j != i and c[i, j] > 0)[:4]
            assert sorted((-v, s) for s, v in got.get(f"s{i:04d}", [])) == want, i


def test_neighbours_without_popular_products_form_no_table_of_pairs(spark, monkeypatch):
    def none(*_):
        raise AssertionError("a row per pair of stores")
    monkeypatch.setattr(similarity, "candidates", none)
    sales = spark.range(400).select((F.col("id") % 50).cast("string").alias("store_id"), (F.col("id") % 37).cast("string").alias("product_id"),
                                    F.lit(2).alias("quantity"))
    assert recommend.store_neighbours(sales).count() == 250


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_product_moves_the_narrow_factor_once_per_part(spark, monkeypatch):
    """Blocks sent by a product: parts x narrow blocks, not one per tile; both sides as the wide one."""
    from shelfcast.operators import latent
    monkeypatch.setattr(latent, "PARTS", 6)
    rng = np.random.default_rng(4)
    for shape in ((40, 300), (300, 40)):
        x = rng.poisson(0.3, shape).astype(float)
        e = matrix_of(spark, x).select(F.col("x").alias("r"), F.col("p").alias("c"), F.col("q").alias("v"))
        rows = latent.blocks_of(e.select(F.col("r").alias("id")).distinct(), 10).cache()
        cols = latent.blocks_of(e.select(F.col("c").alias("id")).distinct(), 10).cache()
        tiles = latent.tiles_of(e, rows, cols).cache()
        u, w = latent.svd_factors(tiles, cols, 40, rows.count(), cols.count())
        dense = {}
        for f, dim, name in ((u, rows, "u"), (w, cols, "w")):
            dense[name] = {r.id: np.frombuffer(r.v) for r in latent.vectors(f, dim).collect()}
        for r in e.collect():
            assert math.isclose(dense["u"][r.r] @ dense["w"][r.c], r.v, abs_tol=1e-8)
        wide, narrow = (cols, rows) if shape[0] < shape[1] else (rows, cols)
        blocks = [d.select("block").distinct().count() for d in (wide, narrow)]
        t = latent.Tiles(tiles, "c" if wide is cols else "r", *blocks)
        factor = latent.random_factor(narrow, 3)
        def counted(of_wide, both):
            def run(batches):
                for b in batches:
                    yield latent.batch([(0, 1, np.array([float(b.column("kind").to_pylist().count(0))]).tobytes())])
            return run
        with monkeypatch.context() as m:
            m.setattr(latent, "_products", counted)
            sent = sum(np.frombuffer(r.m)[0] for r in t.run(factor, False).collect())
        assert sent == t.parts * blocks[1] and t.parts <= 8 and sent < tiles.count()


def test_search_keeps_ties_and_floors_over_many_groups(spark, monkeypatch):
    from shelfcast.operators import latent
    monkeypatch.setattr(latent, "SPAN", 1)
    rng = np.random.default_rng(6)
    a, b = rng.integers(-2, 3, (30, 3)).astype(float), rng.integers(-2, 3, (200, 3)).astype(float)  # many ties
    side = lambda x, p: [(f"{p}{i:03d}", float(np.linalg.norm(v)), v.tobytes(), i % 4, i // 4) for i, v in enumerate(x)]
    schema = "id string, norm double, v binary, block int, pos int"
    owned = [(f"u{i:03d}", f"w{j:03d}") for i in range(30) for j in rng.choice(200, 20, replace=False)]
    got = {}
    for r in latent.top_products(spark.createDataFrame(side(a, "u"), schema), spark.createDataFrame(side(b, "w"), schema),
                                 spark.createDataFrame(owned, "id string, item string"), 7, size=9).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.item)
    for i in range(30):
        want = sorted((-float(a[i] @ b[j]), f"w{j:03d}") for j in range(200) if a[i] @ b[j] > 0 and (f"u{i:03d}", f"w{j:03d}") not in set(owned))
        assert got.get(f"u{i:03d}", []) == [p for _, p in want[:7]]


class Store:
    """State of one store and its timers, which counts what is asked of it."""

    def __init__(self):
        self.v, self.calls, self.timers = None, 0, set()

    def getValueState(self, *_):
        return self

    def exists(self):
        self.calls += 1
        return self.v is not None

    def get(self):
        self.calls += 1
        return self.v

    def update(self, v):
        self.calls += 1
        self.v = v

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class Times:
    def __init__(self, passed):
        self.passed = passed

    def getCurrentWatermarkInMs(self):
        return self.passed


def test_alerts_of_a_store_ask_its_state_once_per_batch():
    from pyspark.sql import Row
    from shelfcast.streaming import jobs as X
    rnd = random.Random(5)
    for _ in range(20):
        store, alerts, told, apart, one = Store(), X.StoreAlerts(), [], {}, []
        alerts.init(store)
        passed, sales = -1, [(rnd.randrange(1, 40), f"s{i:03d}", rnd.randrange(1, 6), f"p{rnd.randrange(50)}") for i in range(200)]
        while sales:
            some, sales = sales[:60], sales[60:]
            rows = [Row(ms=m, sale_id=s, quantity=q, inventory=14, safety_stock=15, product=p) for m, s, q, p in some]
            store.calls = 0
            told += list(alerts.handleInputRows(("a",), iter(rows), Times(passed)))
            assert store.calls <= 5  # it was some per product
            for p in {r.product for r in rows}:
                shelf = apart.setdefault(p, X.Shelf())
                one += list(shelf.alerts().handleInputRows(("a", p), iter([r for r in rows if r.product == p]), Times(passed)))
            passed = max(passed, max(m for m, *_ in some) - 20)
            if any(t <= passed for t in store.timers):
                store.timers = {t for t in store.timers if t > passed}
                told += list(alerts.handleExpiredTimer(("a",), Times(passed), None))
            for p, shelf in apart.items():
                if shelf.settled.value[7] is not None and shelf.settled.value[7] <= passed:
                    one += list(shelf.alerts().handleExpiredTimer(("a", p), Times(passed), None))
            kept = {p: (settled, pending) for p, settled, pending in store.v[1]}
            assert kept == {p: (tuple(s.settled.value), s.pending.value or []) for p, s in apart.items()}
            due = [x[0] for _, pending in kept.values() for x in pending]
            assert store.timers == ({min(due)} if due else set()) and all(t > passed for t in due)
        assert sorted(map(str, told)) == sorted(map(str, one))


def test_user_model_gets_series_in_batches(spark):
    from shelfcast.operators import forecast as D
    rows = [("a", 2000, 3.0), ("a", 1999, 2.0), ("b", 2000, None), ("c", 2000, float("nan")), ("c", 2001, 7.0), (None, 2000, 5.0),
            ("d", 1999, 1.0), ("d", 2000, 2.0)]
    df = spark.createDataFrame(rows, "k string, x int, y double").repartition(3)

    def model(xs, ys, target):
        if len(xs) == 2 and ys[0] == 1.0:
            raise ValueError
        ys[:] = ys + xs[0]  # its own copy
        return ys[-1]
    got = D.series_forecast(df, ["k"], "x", "y", 2001, model)
    assert "FlatMapGroups" not in plan_of(got)  # not a frame for each series
    assert {tuple(r) for r in got.collect()} == {("a", 2002, "model"), ("b", 0, "linear_trend"), ("c", 2008, "model"), (None, 2005, "model"),
                                                 ("d", 3, "linear_trend")}


def test_export_writes_each_range_in_files_of_bounded_rows(spark, tmp_path):
    from shelfcast.operators import prep as K
    sales = spark.range(4000).select(F.format_string("%05d", "id").alias("sale_id"), F.col("id").alias("quantity"))
    K.export_parts(sales, str(tmp_path / "p"), parts=4, rows=250)
    per = spark.read.parquet(str(tmp_path / "p")).groupBy(F.input_file_name().alias("f")).agg(
        F.count(F.lit(1)).alias("n"), F.min("sale_id").alias("a"), F.max("sale_id").alias("z")).orderBy("f").collect()
    assert len(per) >= 12 and max(r.n for r in per) <= 500 and sum(r.n for r in per) == 4000
    assert all(x.z < y.a for x, y in zip(per, per[1:]))


def test_quick_values_of_a_tuple_are_those_of_the_pattern():
    from shelfcast.sources import dump
    rnd = random.Random(8)
    pieces = ["'a'", "''", "'x,y'", "'it''s'", "NULL", "null", "1", " 2.5 ", "", "b c", "'", ",", " ", "'(q)'"]
    for _ in range(20000):
        text = rnd.choice([", ", ",", ""]).join(rnd.choice(pieces) for _ in range(rnd.randrange(0, 6)))
        quick = dump.plain_values(text) if "''" not in text else None
        if quick is not None:
            slow, at = [], 0
            while at <= len(text):
                m = dump._VALUE.match(text, at)
                if m is None:
                    slow = []
                    break
                quoted, plain = m.groups()
                slow.append(quoted if quoted is not None else None if plain.upper() == "NULL" else plain)
                if m.end() == len(text) and not text[m.start():m.end()].endswith(","):
                    break
                at = m.end()
            assert quick == slow, text


def test_many_requests_read_the_stock_once(spark):
    from shelfcast.operators import names
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b
    schema = "product_name string, store_name string, product_id string, inventory long, safety_stock long, frozen_money double"
    stock = spark.createDataFrame([(f"name {i % 7}", f"store {i % 5}", f"p{i}", i, 20, float(i % 11)) for i in range(70)], schema)
    asked = spark.createDataFrame([("a", "name 3", "store 2"), ("b", "name 4 (new)", ""), ("c", "none", None)],
                                  "request_id string, product_name string, store_name string")
    assert {r.request_id for r in names.stock_signals(stock.mapInArrow(seen, schema), asked).collect()} == {"a", "b"}
    assert reads.value == 70


def test_running_total_compares_a_key_with_few_cuts(spark):
    from shelfcast.functions import rows as R
    for n in (1, 15, 16, 17, 300, 20000):
        got = R.global_rank(spark.range(n).select((F.col("id") * 7919 % 20011).alias("v"), F.col("id").cast("string").alias("t")), "v", "t")
        got = [r.rank for r in got.orderBy(F.desc("v"), "t").select("rank").collect()]
        assert got == list(range(1, n + 1))
    assert R.HOP * R.HOP >= R.CUTS


def test_candidates_of_a_main_device_do_not_move_once_per_tag(spark):
    from shelfcast.operators import scoring as W
    schema = "store_id string, product_id string, product_name string, price double, margin double, stock_age int, stock long, compatibility_tags array<string>"
    products = spark.createDataFrame([("s", f"p{i}", "n", 10.0 + i, 0.3, 5, 1, ["A", "b", f"c{i % 2}", None][: 1 + i]) for i in range(4)]
                                     + [("s", "q", "n", 5.0, 0.3, 5, 1, ["z"]), ("t", "p0", "n", 1.0, 0.3, 5, 1, ["a"])], schema)
    got = W.bundle_rank(products, products.filter("product_id = 'p3'"))
    assert [r.product_id for r in got.orderBy("rank").collect()] == ["p2", "p1", "p0"]
    assert "Generate explode" not in plan_of(got)


def test_dense_days_need_no_exchange_of_their_own(spark):
    import datetime as dt
    from shelfcast.operators import forecast as D
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    sales = spark.createDataFrame([("a", day(0), 1.0), ("a", day(3), 2.0), ("a", day(3), 0.5), ("b", day(9), 4.0), ("a", None, 9.0)],
                                  "store_id string, sale_date date, total_sales double")
    got = D.daily_sales_dense(sales)
    assert sorted(map(tuple, got.collect())) == [("a", day(0), 1.0), ("a", day(1), 0.0), ("a", day(2), 0.0), ("a", day(3), 2.5), ("b", day(9), 4.0)]
    text = plan_of(got)
    assert "Join" not in text


def test_launch_date_joins_the_fact_before_the_dimensions(spark):
    from shelfcast.sources.tpch import tpch_sales
    s = tpch_sales(spark, "/root/testdata/sf0.001", launch=True)
    text = s._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in text.splitlines() if "Join " in line]
    assert "_lpartkey" not in joins[0] and s.count() == tpch_sales(spark, "/root/testdata/sf0.001").count()
    assert any("_lpartkey" in j for j in joins[2:])


def test_state_of_a_store_is_stored_compressed_and_read_back():
    from shelfcast.streaming import jobs as X

    class Cell:
        v = None

        def getValueState(self, name, schema):
            assert schema.endswith("binary")
            return self

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v
    cell, alerts = Cell(), X.PackedStoreAlerts()
    alerts.init(cell)
    assert alerts.load() == (None, {})
    shelves = {f"p{i}": X.Shelf((5 * i, 7, -1, None, None, f"s-{i}", 3, 86400000 * i), [(86400000 * i, f"sale {i} é", i)] if i % 2 else None)
               for i in range(200)}
    cell.registerTimer = lambda at: None
    alerts.keep(None, shelves)
    assert len(cell.v[0]) < 40 * 200
    timer, back = alerts.load()
    assert timer == 0 and {p: (s.settled.value, s.pending.value) for p, s in back.items()} == {
        p: (s.settled.value, s.pending.value) for p, s in shelves.items()}


def test_alerts_read_the_opening_stock_once(spark, tmp_path):
    from shelfcast.streaming import jobs as X
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b
    opening = spark.createDataFrame([("s", "p", 10, 10), ("s", "q", 10, 10)], "store_name string, product_id string, inventory long, safety_stock long")
    schema = "store_name string, product_id string, sale_id string, sale_date date, quantity int"
    for day in (1, 2, 3):
        spark.createDataFrame([("s", "p", f"a{day}", None, 2)], schema).withColumn("sale_date", F.expr(f"DATE'2020-01-0{day}'")).coalesce(
            1).write.mode("append").parquet(str(tmp_path / "in"))
    sales = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = X.stream_critical_alerts(sales, opening.mapInArrow(seen, opening.schema)).collect()
    assert [(r.sale_id, r.stock) for r in got] == [("a2", 6)] and reads.value == 2


def test_products_of_bundles_are_made_once(spark):
    from shelfcast.plans import q_scoring
    for query in (q_scoring.w10_campaign, q_scoring.w10_fallback):
        got = query(spark, "/root/testdata/sf0.001")
        assert "lineitem" not in got._jdf.queryExecution().toString() and not got.isEmpty()


def test_enriched_rows_move_without_the_columns_that_others_imply(spark):
    from shelfcast.operators import prep as K
    from shelfcast.plans.q_inventory import snap
    from shelfcast.sources.tpch import sale_columns, sale_rows, tpch_sales
    d = "/root/testdata/sf0.001"
    patch = K.synth_store_stock(snap(spark, d).filter("status <> 'Normal'").withColumn("ingest_order", F.col("sale_id")))
    got, want = K.enrich_inventory(sale_rows(spark, d), patch, sale_columns), K.enrich_inventory(tpch_sales(spark, d), patch)
    got = got.select(*want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    text = got._jdf.queryExecution().optimizedPlan().toString()
    joined = text[text.index("Join LeftOuter"):text.index("Window")]
    assert "concat_ws" in text[:text.index("Join LeftOuter")] and "concat_ws" not in joined


def test_blocks_reach_python_a_few_at_a_time(spark, monkeypatch):
    """Factor blocks of a megabyte and more: not all that a task reads in one Arrow batch."""
    from shelfcast.operators import latent
    most = latent.HANDED

    def checked(make):
        def of(*a):
            run = make(*a)

            def bounded(batches):
                def few():
                    for b in batches:
                        assert b.num_rows <= most, b.num_rows
                        yield b
                yield from run(few())
            return bounded
        return of
    for name in ("_products", "_scored"):
        monkeypatch.setattr(latent, name, checked(getattr(latent, name)))
    monkeypatch.setattr(latent, "PARTS", 2)
    rng = np.random.default_rng(9)
    e = matrix_of(spark, rng.poisson(0.4, (80, 90)).astype(float)).select(F.col("x").alias("r"), F.col("p").alias("c"), F.col("q").alias("v"))
    rows, cols = (latent.blocks_of(e.select(F.col(c).alias("id")).distinct(), 2).cache() for c in "rc")
    u, w = latent.svd_factors(latent.tiles_of(e, rows, cols).cache(), cols, 5, rows.count(), cols.count(), power=1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = latent.top_products(latent.vectors(u, rows), latent.vectors(w, cols), e.select(F.col("r").alias("id"), F.col("c").alias("item")), 3, size=2)
    assert got.groupBy("id").count().count() > 70
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before != str(most)


def test_neighbours_products_move_once_by_store(spark):
    sales = spark.createDataFrame([(f"s{i}", f"p{(i * j) % 11}", i + j) for i in range(6) for j in range(1, 8)],
                                  "store_id string, product_id string, quantity int").withColumn("sale_id", F.lit("x"))
    health = spark.createDataFrame([(f"p{j}", 100.0 + 10 * j) for j in range(5)] + [("p4", 90.0), ("p6", None), (None, 500.0)],
                                   "product_id string, health_index double")
    near = [("s0", "s1"), ("s0", "s2"), ("s1", "s4"), ("s2", "s5"), ("s2", "s3"), ("s2", "s0")]
    sim = spark.createDataFrame([(a, b, 0.5, 1) for a, b in near], "store_id string, other_store string, similarity double, sim_rank int")
    got = recommend.collab_boost(sales, health, sim)
    q, h = {}, {}
    for r in sales.collect():
        q[r.store_id, r.product_id] = q.get((r.store_id, r.product_id), 0) + r.quantity
    for r in health.collect():
        h.setdefault(r.product_id, []).append(1.2 if (r.health_index or 0) >= 120 else 1.0)
    want = set()
    for s in {a for a, _ in near}:
        others = [b for a, b in near if a == s]
        total = {}
        for (o, p), n in q.items():
            if o in others:
                total[p] = total.get(p, 0) + n
        score = sorted((-(n / len(others)) * b, p, b, n / len(others)) for p, n in total.items() for b in h.get(p, [1.0]))[:3]
        want |= {(s, p, round(base, 2), b, round(-x, 2), i) for i, (x, p, b, base) in enumerate(score, 1)}
    assert {tuple(r) for r in got.collect()} == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan_of(recommend.collab_boost(sales, health, sim))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = text[:text.index("SortMergeJoin")]
    assert above.count("Exchange") == 1 and "Exchange hashpartitioning(store_id" in above


def test_engines_read_the_joined_sales_that_are_written_once(spark, monkeypatch):
    from shelfcast.plans import q_recommend
    seen = []
    monkeypatch.setattr(q_recommend.R, "store_recommendations", lambda sales, engines, cols: seen.append((sales, engines)))
    monkeypatch.setattr(q_recommend.R, "association", lambda s: s)
    q_recommend._r9(spark, "/root/testdata/sf0.001", "association")
    (sales, engines), = seen
    text = sales._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text and engines["association"] is sales
