"""Many-name look-ups against brute force; finished windows, late rows and sketches
of event streams against the batch."""

import random
import tempfile

from pyspark.sql import functions as F

from conftest import SMOKE
from shelfcast.operators import funnel, inventory, names
from shelfcast.operators.filters import store_name_match
from shelfcast.streaming import jobs as X
from test_sources_streams import in_files


def word(rnd):
    return "".join(rnd.choice("abé가") for _ in range(rnd.randrange(1, 8)))


def test_containing_equals_brute_force(spark):
    rnd = random.Random(3)
    needles = {word(rnd) for _ in range(60)} | {"", "a", "ab", "zzz", "한국어"}
    texts = {" ".join(word(rnd) for _ in range(rnd.randrange(1, 4))) for _ in range(150)} | {"", "a"}
    got = names.containing(spark.createDataFrame([(n,) for n in needles for _ in range(2)], "needle string"),
                           spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(n, t) for n in needles for t in texts if n and t and n in t}


def test_containing_has_no_theta_join(spark, capsys):
    df = spark.range(1000).select(F.col("id").cast("string").alias("needle"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("text"))
    names.containing(df, df).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_store_names_of_many_requests_equal_the_rule_for_one(spark):
    stores = ["Apple SoHo", "Apple Store Ginza", "소호 (SoHo)", "Covent Garden Centre", "Apple Park", "Parker", "SoHo", " apple soho ", ""]
    asked = ["SoHo", "소호 ( SoHo )", "apple soho", "Ginza", "Covent Garden Center", "Park", "x", "", "Apple Park"]
    s = spark.createDataFrame([(x,) for x in stores], "store_name string")
    got = {tuple(r) for r in names.store_name_matches(spark.createDataFrame([(a,) for a in asked], "request string"), s).collect()}
    want = {(a, r.store_name) for a in asked for r in s.filter(store_name_match(F.col("store_name"), a)).collect()}
    assert got == want and len(want) > 8


def test_stock_signals_equal_the_rule_for_one(spark):
    rnd = random.Random(5)
    words = ["Mac", "Book", "Pro", "iPad", "Case", "Air"]
    rows = []
    for i in range(120):
        rows.append((rnd.choice(["Apple SoHo", "Apple Ginza", "", "Ginza West"]), f"p{i:03d}",
                     rnd.choice([" ".join(rnd.sample(words, rnd.randrange(1, 4))), "", None]), rnd.randrange(9), rnd.randrange(9),
                     float(rnd.randrange(12))))
    stock = spark.createDataFrame(rows, "store_name string, product_id string, product_name string, inventory long, "
                                        "safety_stock long, frozen_money double").cache()
    asked = [(f"r{i}", p, s) for i, (p, s) in enumerate(
        (p, s) for p in ("Mac", "MacBook Pro", "Pro Case 2024", " iPad ", "xyz", "", None) for s in ("Ginza", "Apple SoHo", "", None, "Nowhere"))]
    got = {r.request_id: tuple(r)[1:] for r in names.stock_signals(
        stock, spark.createDataFrame(asked, "request_id string, product_name string, store_name string")).collect()}
    for i, p, s in asked[::2]:
        one = inventory.tolerant_stock_signal(stock, p, s).collect()
        assert got.get(i) == (tuple(one[0]) if one else None), (p, s)


def test_finished_windows_and_late_rows_are_the_batch(spark):
    ev = spark.read.parquet(f"{SMOKE}/events.parquet")
    path = in_files(ev, F.dayofmonth("ts") * 7 + F.hour("ts"), 6)  # days and hours out of order
    delay = "20 days"
    done = X.stream_feedback_windows(X.events_stream(spark, path), delay).collect()
    late = X.late_feedback(X.events_stream(spark, path), delay)
    assert len({(r.w, r.product_id) for r in done}) == len(done)  # told once
    rows = X.window_rows(ev).withColumn("w", F.window("ts", X.FEEDBACK_WINDOW))
    passed = rows.select(F.max("ts") - F.expr(f"INTERVAL {delay}")).first()[0]
    want = {(r.w, r.product_id): (r.impressions, r.clicks) for r in X.feedback_counts(rows.filter(F.col("w.end") <= passed)).collect()}
    got = {(r.w, r.product_id): (r.impressions, r.clicks) for r in done}
    n_late = 0
    for r in X.feedback_counts(late.filter(F.col("w.end") <= passed)).collect():
        a, b = got.get((r.w, r.product_id), (0, 0))
        got[r.w, r.product_id] = (a + r.impressions, b + r.clicks)
        n_late += r.impressions
    assert got == want and n_late > 0 and len(done) > 0


def test_sketches_of_users_are_close_and_small(spark):
    """100,000 users on one day in six files; the sketch does not grow with them."""
    users = spark.range(120_000).select(
        F.lit("2024-01-02 03:04:05").cast("timestamp_ntz").alias("ts"), F.pmod("id", F.lit(100_000)).alias("user_id"),
        F.when(F.col("id") % 3 == 0, "click").otherwise("view").alias("event_type"))
    ev = users.select(F.monotonically_increasing_id().alias("event_id"), "ts", "user_id", "event_type", F.lit(0.0).alias("value"),
                      F.lit("{}").alias("props"))
    out = tempfile.mkdtemp(prefix="users-")
    ev.repartition(6).write.mode("append").parquet(out)
    exact = {r.stage: r.user_count for r in funnel.journey_funnel(ev).collect()}
    for lg, error in ((12, 0.06), (16, 0.015)):
        got = {r.stage: r.user_count for r in X.stream_funnel_approx(X.events_stream(spark, out), lg).collect()}
        assert set(got) == set(exact) and all(abs(got[s] / n - 1) < error for s, n in exact.items())
        size = X.stream_funnel_sketches(X.events_stream(spark, out), lg).select(F.max(F.length("users"))).first()[0]
        assert size <= 2 ** lg + 100


class OneValue:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    put = update

    def clear(self):
        self.v = None


class Handle:
    """State variables of one key and its timers, in plain Python."""

    def __init__(self):
        self.vars, self.timers = {}, set()

    def var(self, name, schema):
        return self.vars.setdefault(name, OneValue())

    getValueState = getListState = var

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Times:
    def __init__(self, passed):
        self.passed = passed

    def getCurrentWatermarkInMs(self):
        return self.passed


def test_settled_sales_leave_the_state_and_timers_follow_the_earliest():
    from pyspark.sql import Row
    rnd = random.Random(9)
    for _ in range(60):
        h, alerts = Handle(), X.StockAlerts()
        alerts.init(h)
        sales = [(rnd.randrange(1, 40), f"s{i:02d}", rnd.randrange(1, 6)) for i in range(rnd.randrange(1, 15))]
        told, passed, left = (None, None), -1, sales.copy()
        while left:
            some = [left.pop(rnd.randrange(len(left))) for _ in range(min(len(left), rnd.randrange(1, 4)))]
            rows = [Row(ms=m, sale_id=s, quantity=q, inventory=40, safety_stock=30) for m, s, q in some]
            got = list(alerts.handleInputRows(("a", "b"), iter(rows), Times(passed)))
            assert {r.late_sale for r in got if r.late_sale} == {s for m, s, _ in some if m <= passed}
            for r in got:
                told = told if r.late_sale else (r.sale_id, r.stock)
            passed = min(max(passed, max(m for m, _, _ in some) - 5), 60)
            for at in sorted(t for t in h.timers if t <= passed):
                h.timers.discard(at)
                assert list(alerts.handleExpiredTimer(("a", "b"), Times(passed), None)) == []
            pending = h.vars["pending"].v or []
            assert all(p[0] > passed for p in pending)  # what the watermark has passed is gone
            assert h.timers == ({min(pending)[0]} if pending else set())
            seen = sorted(set(sales) - set(left))
            assert h.vars["settled"].v[0] == 40 - sum(q for _, _, q in seen) + sum(p[2] for p in pending)
        in_order = all(m > passed for m, _, _ in sales)
        if in_order:
            stock, want = 40, (None, None)
            for m, s, q in sorted(sales):
                stock -= q
                if want[0] is None and X.health(stock, 30) < X.CRITICAL_HEALTH:
                    want = (s, stock)
            assert told == want
