"""Structured Streaming jobs X1-X3.

Sources are file streams (Parquet/JSON directories). Every micro-batch
replaces its own folder of a Parquet table under the session's checkpoint
folder (``spark.checkpoint.dir`` on a cluster), so a batch that is run again
after a failure does not count twice, and results never pass through the
driver.

X1 and X2 append what can be merged (counts; distinct users): readers merge
the batches, so rows count whenever they arrive, in any order, without a
watermark and without state. X3 depends on the order of sales: its state, a row per store, keeps
the sales that the watermark has not passed and corrects its alert when an
earlier sale turns up.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from shelfcast.operators.funnel import CLICK_EVENT, STAGES, VIEW_EVENT, funnel_rates, journey_funnel
from shelfcast.session import cut_lineage, ensure_checkpoint_dir

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
FEEDBACK_WINDOW = "10 minutes"
#: How far behind the newest event a feedback window is kept open.
FEEDBACK_DELAY = "10 minutes"
#: log2 of the registers of a sketch of users.
SKETCH_LG = 14
CRITICAL_HEALTH = 70.0
#: How far out of order sales may arrive before X3 reports them as late.
DELAY = "30 days"


def drain(df: DataFrame, name: str, each: Callable[[DataFrame], DataFrame] = lambda b: b, mode: str = "append") -> DataFrame:
    """Run a stream over all input there is (``availableNow``); the rows that
    ``each`` made of every micro-batch, with its number as ``batch``."""
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex[:12]}"
    shape = each(spark.createDataFrame([], df.schema))
    shape.write.parquet(f"{base}/out/batch=-1")  # a stream without input has a table too

    def sink(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{base}/out/batch={int(number)}")

    (df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint")
       .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(shape.schema.add("batch", "long")).parquet(f"{base}/out")


def file_glob(path: str) -> str:
    """A file stream needs a directory or a glob: turn a single-file path
    into a one-file glob (last character as a class)."""
    p = path.rstrip("/")
    return p[:-1] + "[" + p[-1] + "]"


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    path = file_glob(path) if path.endswith(".parquet") else path
    return spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


# ---- X1 ------------------------------------------------------------------------
def feedback_rows(events: DataFrame, window: str = FEEDBACK_WINDOW) -> DataFrame:
    """Window, product (props.k), click (1) or view (0) of each feedback event."""
    e = events.filter(F.col("event_type").isin(CLICK_EVENT, VIEW_EVENT))
    return e.select(F.window(F.col("ts").cast("timestamp"), window).alias("w"),
                    F.get_json_object("props", "$.k").alias("product_id"),
                    (F.col("event_type") == CLICK_EVENT).cast("long").alias("v"))


def feedback_counts(rows: DataFrame) -> DataFrame:
    """Impressions and clicks per window and product."""
    return rows.groupBy("w", "product_id").agg(F.count(F.lit(1)).alias("impressions"), F.sum("v").alias("clicks"))


def stream_feedback(events: DataFrame) -> DataFrame:
    """Click feedback of an event stream in tumbling windows. Batches add
    up, so late rows are counted like any other."""
    parts = drain(feedback_rows(events), "feedback", feedback_counts)
    return parts.groupBy("w", "product_id").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"))


def window_rows(events: DataFrame) -> DataFrame:
    """Event time, product (props.k), click (1) or view (0) of each feedback event."""
    e = events.filter(F.col("event_type").isin(CLICK_EVENT, VIEW_EVENT))
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").alias("product_id"),
                    (F.col("event_type") == CLICK_EVENT).cast("long").alias("v"))


def stream_feedback_windows(events: DataFrame, delay: str = FEEDBACK_DELAY, window: str = FEEDBACK_WINDOW) -> DataFrame:
    """X1 with bounded state: a window leaves the state, and is told once and for all,
    when the watermark (``delay`` behind the newest event) passes its end. Windows still
    open when the input ends are not told; rows of finished windows are :func:`late_feedback`."""
    rows = window_rows(events).withWatermark("ts", delay)
    done = rows.groupBy(F.window("ts", window).alias("w"), "product_id").agg(
        F.count(F.lit(1)).alias("impressions"), F.sum("v").alias("clicks"))
    return drain(done, "feedback-windows").drop("batch")


def late_feedback(events: DataFrame, delay: str = FEEDBACK_DELAY, window: str = FEEDBACK_WINDOW) -> DataFrame:
    """The side table of :func:`stream_feedback_windows`: (ts, product_id, v, w) of rows
    whose window was finished when they came. Reads the same files in the same
    batches; each batch leaves its newest event time, from which the next ones know
    the watermark that their rows met (that of the batch before, as Spark drops late
    rows by it)."""
    spark = events.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-late-{uuid.uuid4().hex[:12]}"
    rows = window_rows(events).withColumn("w", F.window("ts", window))
    spark.createDataFrame([], "newest timestamp").write.parquet(f"{base}/newest/batch=-1")
    spark.createDataFrame([], rows.schema).write.parquet(f"{base}/late/batch=-1")

    def sink(batch: DataFrame, number: int) -> None:
        batch.agg(F.max("ts").alias("newest")).write.mode("overwrite").parquet(f"{base}/newest/batch={int(number)}")
        seen = spark.read.schema("newest timestamp, batch long").parquet(f"{base}/newest").filter(F.col("batch") < number - 1)
        passed = (seen.select(F.max("newest")).scalar() - F.expr(f"INTERVAL {delay}"))
        batch.filter(F.col("w.end") <= passed).write.mode("overwrite").parquet(f"{base}/late/batch={int(number)}")

    (rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(rows.schema).parquet(f"{base}/late")


# ---- X2 ------------------------------------------------------------------------
def stream_funnel_sketches(events: DataFrame, lg: int = SKETCH_LG) -> DataFrame:
    """(ts, event_type, users): an HLL sketch of each day and stage, from sketches that the
    batches of an event stream left. The stored rows are days x stages per batch, of
    at most 2**``lg`` bytes each, whatever the number of users."""
    e = events.filter(F.col("event_type").isin(*[s[0] for s in STAGES]))
    e = e.select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), "event_type", "user_id")
    parts = drain(e, "funnel-sketches", lambda b: b.groupBy("ts", "event_type").agg(F.hll_sketch_agg("user_id", lg).alias("users")))
    return parts.groupBy("ts", "event_type").agg(F.hll_union_agg("users").alias("users"))


def stream_funnel_approx(events: DataFrame, lg: int = SKETCH_LG) -> DataFrame:
    """X2 from sketches: the daily funnel with estimated users (standard error about
    1.04 / 2**(lg / 2); nearly exact for few users)."""
    return funnel_rates(stream_funnel_sketches(events, lg).select(
        F.to_date("ts").alias("day"), "event_type", F.hll_sketch_estimate("users").alias("user_count")))


def stream_funnel(events: DataFrame) -> DataFrame:
    """The daily funnel (U1) of an event stream, exact: each batch keeps
    its distinct (day, stage, user) rows."""
    e = events.filter(F.col("event_type").isin(*[s[0] for s in STAGES]))
    e = e.select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), "event_type", "user_id")
    return journey_funnel(drain(e, "funnel", lambda b: b.distinct()).drop("batch"))


# ---- X3 ------------------------------------------------------------------------
ALERT_SCHEMA = ("store_name string, product_id string, sale_id string, stock long, safety_stock long, "
                "health_index double, late_sale string")
SETTLED = "stock long, safety long, upto long, alert_id string, alert_stock long, told_id string, told_stock long, timer long"
PENDING = "ms long, sale_id string, quantity long"
STRUCT = lambda ddl: "struct<" + ", ".join(f.strip().replace(" ", ": ") for f in ddl.split(",")) + ">"
STORE = f"timer long, products array<struct<product_id: string, settled: {STRUCT(SETTLED)}, pending: array<{STRUCT(PENDING)}>>>"
#: State variables and timers need RocksDB; rows that lie by store need not move to join by store and product.
ALERT_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
              "spark.sql.requireAllClusterKeysForCoPartition": "false"}


def health(stock: int, safety: int) -> float:
    return stock / safety * 100.0 if safety > 0 else 0.0


class StockAlerts(StatefulProcessor):
    """One product of one store. State: ``settled``, the stock after the sales that the
    watermark has passed, the alert they gave and the one last told; ``pending``, the
    sales after them. A timer at the earliest pending sale settles what the watermark
    has passed, so settled sales leave the state. A changed alert is told again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", SETTLED)
        self.pending = handle.getListState("pending", PENDING)

    def handleInputRows(self, key, rows, timerValues):
        passed = timerValues.getCurrentWatermarkInMs()
        state = list(self.settled.get()) if self.settled.exists() else None
        known = [tuple(p) for p in self.pending.get()] if state and state[7] is not None else []
        for r in rows:
            if state is None:
                state = [r.inventory, r.safety_stock, -1, None, None, None, None, None]
            known.append((r.ms, r.sale_id, r.quantity))
            if r.ms <= max(state[2], passed):
                yield Row(store_name=key[0], product_id=key[1], sale_id=None, stock=None, safety_stock=state[1],
                          health_index=None, late_sale=r.sale_id)
        known.sort()
        alert = self.first_alert(state, known)
        if alert != (state[5], state[6]):
            state[5], state[6] = alert
            yield Row(store_name=key[0], product_id=key[1], sale_id=alert[0], stock=alert[1], safety_stock=state[1],
                      health_index=health(alert[1], state[1]) if alert[0] else None, late_sale=None)
        self.keep(state, known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state, passed = list(self.settled.get()), timerValues.getCurrentWatermarkInMs()
        known = sorted(tuple(p) for p in self.pending.get())
        done = [p for p in known if p[0] <= passed]
        alert = self.first_alert(state, done)
        state[7] = None  # it has just gone off
        self.keep([state[0] - sum(p[2] for p in done), state[1], max([state[2], *(p[0] for p in done)]), *alert, *state[5:]],
                  known[len(done):])
        return iter(())

    @staticmethod
    def first_alert(state, sales) -> tuple:
        if state[3] is not None:
            return state[3], state[4]
        left = state[0]
        for _, sale, q in sales:
            left -= q
            if health(left, state[1]) < CRITICAL_HEALTH:
                return sale, left
        return None, None

    def keep(self, state, known) -> None:
        """Store the state; its timer stands at the earliest pending sale."""
        at = max(known[0][0], 0) if known else None
        if at != state[7]:
            if state[7] is not None:
                self.handle.deleteTimer(state[7])
            if at is not None:
                self.handle.registerTimer(at)
        state[7] = at
        self.settled.update(tuple(state))
        if known:
            self.pending.put(known)
        else:
            self.pending.clear()

    def close(self) -> None:
        pass


class Slot:
    """State variables and timer of one product inside its store's state."""

    def __init__(self, value=None):
        self.value = value

    def exists(self) -> bool:
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value) -> None:
        self.value = value

    put = update

    def clear(self) -> None:
        self.value = None


class Shelf:
    """What :class:`StockAlerts` asks of a handle, for one product; its timer is in ``settled``."""

    def __init__(self, settled=None, pending=None):
        self.settled, self.pending = Slot(settled), Slot(pending)

    def getValueState(self, *_) -> Slot:
        return self.settled

    def getListState(self, *_) -> Slot:
        return self.pending

    def registerTimer(self, at) -> None:
        pass

    deleteTimer = registerTimer

    def alerts(self) -> StockAlerts:
        one = StockAlerts()
        one.init(self)
        return one


class StoreAlerts(StatefulProcessor):
    """:class:`StockAlerts` of all products of a store under one key: the state is read and
    written once per store and batch, not per product, and the store has one timer, at the
    earliest pending sale of any product."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.store = handle.getValueState("store", STORE)

    def load(self) -> tuple[int | None, dict[str, Shelf]]:
        if not self.store.exists():
            return None, {}
        timer, products = self.store.get()
        return timer, {p: Shelf(tuple(settled), [tuple(x) for x in pending] or None) for p, settled, pending in products}

    def handleInputRows(self, key, rows, timerValues):
        timer, shelves = self.load()
        sales: dict[str, list] = {}
        for r in rows:
            sales.setdefault(r.product, []).append(r)
        for product, some in sales.items():
            shelf = shelves.setdefault(product, Shelf())
            yield from shelf.alerts().handleInputRows((key[0], product), iter(some), timerValues)
        self.keep(timer, shelves)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        _, shelves = self.load()
        passed = timerValues.getCurrentWatermarkInMs()
        for product, shelf in shelves.items():
            if shelf.settled.value[7] is not None and shelf.settled.value[7] <= passed:
                yield from shelf.alerts().handleExpiredTimer((key[0], product), timerValues, expiredTimerInfo)
        self.keep(None, shelves)  # its timer has just gone off

    def keep(self, timer: int | None, shelves: dict[str, Shelf]) -> None:
        at = min((s.settled.value[7] for s in shelves.values() if s.settled.value[7] is not None), default=None)
        if at != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if at is not None:
                self.handle.registerTimer(at)
        self.store.update((at, [(p, tuple(s.settled.value), s.pending.value or []) for p, s in shelves.items()]))

    def close(self) -> None:
        pass


class Packed:
    """A value state of one ``binary`` that holds a value of lists, texts and numbers, compressed."""

    def __init__(self, state):
        self.state = state

    def exists(self) -> bool:
        return self.state.exists()

    def get(self):
        return json.loads(zlib.decompress(self.state.get()[0]))

    def update(self, value) -> None:
        self.state.update((zlib.compress(json.dumps(value, separators=(",", ":")).encode(), 1),))


class PackedStoreAlerts(StoreAlerts):
    """:class:`StoreAlerts` whose state is stored compressed: it is a table of the store's products."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.store = Packed(handle.getValueState("store", "packed binary"))


def alert_log(sales: DataFrame, opening: DataFrame, delay: str = DELAY) -> DataFrame:
    """What X3 tells per batch: alerts as they change, and sales that came
    after the watermark (``late_sale``; they still reduce the stock). The opening stock is
    written once, as every batch reads it; rows join it where they lie by store."""
    s = sales.repartition("store_name").join(cut_lineage(opening), ["store_name", "product_id"])
    at = F.col("sale_date").cast("timestamp")
    # the time column goes after it has moved the watermark: Spark would drop late rows by it
    s = s.select("store_name", F.col("product_id").alias("product"), "sale_id", F.col("quantity").cast("long").alias("quantity"),
                 F.col("inventory").cast("long").alias("inventory"), F.col("safety_stock").cast("long").alias("safety_stock"),
                 F.unix_millis(at).alias("ms"), at.alias("at")).withWatermark("at", delay).drop("at")
    told = s.groupBy("store_name").transformWithState(
        PackedStoreAlerts(), T.StructType.fromDDL(ALERT_SCHEMA), "Update", "EventTime")
    conf = sales.sparkSession.conf
    before = {name: conf.get(name, None) for name in ALERT_CONF}
    for name, value in ALERT_CONF.items():
        conf.set(name, value)
    try:
        return drain(told, "alerts", mode="update")
    finally:
        for name, value in before.items():
            conf.set(name, value) if value else conf.unset(name)


def stream_critical_alerts(sales: DataFrame, opening: DataFrame, delay: str = DELAY) -> DataFrame:
    """Per (store, product) the first sale, in order of time, that takes
    the health index below 70. ``opening`` (static: store_name, product_id,
    inventory, safety_stock) is the stock before the first sale."""
    last = Window.partitionBy("store_name", "product_id").orderBy(F.desc("batch"))
    log = alert_log(sales, opening, delay).filter("late_sale IS NULL")
    return (log.withColumn("_r", F.row_number().over(last)).filter("_r = 1 AND sale_id IS NOT NULL")
            .select("store_name", "product_id", "sale_id", "stock", "safety_stock",
                    F.bround("health_index", 1).alias("health_index")))


def critical_alerts_batch(sales: DataFrame, opening: DataFrame) -> DataFrame:
    """Batch twin of X3: cumulative quantity per key and the first row whose
    health falls below 70."""
    s = sales.join(opening, ["store_name", "product_id"])
    w = Window.partitionBy("store_name", "product_id").orderBy("sale_date", "sale_id")
    s = s.withColumn("stock", (F.first("inventory").over(w) - F.sum("quantity").over(w)).cast("long"))
    s = s.withColumn("health_index", F.when(F.col("safety_stock") > 0, F.col("stock") / F.col("safety_stock") * 100.0).otherwise(0.0))
    hit = s.filter(F.col("health_index") < CRITICAL_HEALTH)
    w2 = Window.partitionBy("store_name", "product_id").orderBy("sale_date", "sale_id")
    return (hit.withColumn("_r", F.row_number().over(w2)).filter("_r = 1")
               .select("store_name", "product_id", "sale_id", "stock", F.col("safety_stock").cast("long"),
                       F.bround("health_index", 1).alias("health_index")))
