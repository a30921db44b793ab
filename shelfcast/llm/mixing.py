"""Mixing sources to target weights by pivotal dependent rounding, in SQL
functions only.

Every document has an expected number of copies, its source's target divided
by the source's size. The integral part is taken; the fractional parts are
rounded by the pivotal method: of a pair, word mass moves from one document
to the other, at random in direction, until one of them is integral. Expected
copies and the source's expected words are kept exactly by every step.

Pairs are fought out along a reduction tree: documents of a source are dealt
into groups of about ``FAN`` by a hash, a group is folded to at most one
fractional document, and these residuals form the next level's groups until
one is left per source; only that one is rounded alone. So a source misses
its target by less than one document. Levels grow with the logarithm
of the largest source; no task holds more than a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP = 1.5, 2.0
FAN = 64
SEED = 17


def word_count(text: str = "text") -> Column:
    """Number of words; null: 0."""
    blank = F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\f\r", "     ")
    return F.size(F.filter(F.split(blank, " "), lambda w: w != "")).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, size[, c = copies of the row]).

    Targets are ``min(cap * size, level * weight)`` with the level at which
    they sum to ``share`` of all sizes: the fixed point of resharing the
    excess by weight. The level lies where sources, in order of
    ``cap * size / weight``, stop being full."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights) + 1).cast("int"))
    by = (sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("c")).alias("source_size"))
          .withColumn("weight", w).withColumn("full", F.col("source_size") * F.lit(cap)))
    order = Window.orderBy("ratio", F.asc_nulls_last("source"))
    every = Window.partitionBy()
    by = (by.withColumn("ratio", F.col("full") / F.col("weight"))
          .withColumn("below", F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)))
          .withColumn("open", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
          .withColumn("total", F.sum("source_size").over(every) * F.lit(share))
          .withColumn("level", (F.col("total") - F.coalesce("below", F.lit(0.0))) / F.col("open")))
    # the first source that is not filled at its own level sets the level of all
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    target = F.least("full", F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return by.select("source", "source_size", target.cast("double").alias("target"))


# One fold step: ``hold`` is the fractional row so far, ``x`` the next; both
# have size > 0 and fraction f in (0, 1). Mass up moves words to ``hold``.
_FOLD = """
aggregate(items,
  named_struct('hold', cast(null as {item}), 'done', cast(array() as array<{item}>)),
  (s, x) -> CASE
    WHEN s.hold IS NULL THEN named_struct('hold', x, 'done', s.done)
    ELSE transform(array(named_struct(
        'up', least((1 - s.hold.f) * s.hold.size, x.f * x.size),
        'down', least(s.hold.f * s.hold.size, (1 - x.f) * x.size),
        'draw', (pmod(xxhash64(s.hold.h, x.h, {seed}), 1000000007) + 0.5D) / 1000000007)),
      t -> CASE
        WHEN t.draw * (t.up + t.down) < t.down THEN
          CASE WHEN (1 - s.hold.f) * s.hold.size <= x.f * x.size
            THEN named_struct('hold', {x_less}, 'done', concat(s.done, array({hold_1})))
            ELSE named_struct('hold', {hold_more}, 'done', concat(s.done, array({x_0}))) END
        ELSE
          CASE WHEN s.hold.f * s.hold.size <= (1 - x.f) * x.size
            THEN named_struct('hold', {x_more}, 'done', concat(s.done, array({hold_0})))
            ELSE named_struct('hold', {hold_less}, 'done', concat(s.done, array({x_1}))) END
      END)[0] END)
"""
_ITEM = "struct<size:bigint,h:bigint,doc_id:bigint,c:bigint,f:double>"


def _item(of: str, f: str) -> str:
    return (f"named_struct('size', {of}.size, 'h', {of}.h, 'doc_id', {of}.doc_id, 'c', {of}.c, "
            f"'f', cast({f} as double))")


def _fold(seed: int) -> Column:
    hold, x = "s.hold", "x"
    parts = {"hold_1": _item(hold, "1"), "hold_0": _item(hold, "0"), "x_1": _item(x, "1"), "x_0": _item(x, "0"),
             "x_less": _item(x, "x.f - t.up / x.size"), "x_more": _item(x, "x.f + t.down / x.size"),
             "hold_more": _item(hold, "s.hold.f + t.up / s.hold.size"),
             "hold_less": _item(hold, "s.hold.f - t.down / s.hold.size")}
    return F.expr(_FOLD.format(item=_ITEM, seed=seed, **parts))


def mix(docs: DataFrame, share: float = SHARE, cap: float = CAP, weights=WEIGHTS, fan: int = FAN,
        seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per row of ``docs``.

    ``taken`` is a whole number of copies of the document, at most ``cap``
    rounded up, times its size; 0 for empty and null texts. Null sources are
    one source. Equal rows (same source, doc_id and size) are rounded
    together and share the copies evenly. Reruns agree: draws are hashes.
    """
    rows = C.stored(docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), word_count().alias("size"))
                    .groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("c")))
    targets = C.stored(source_targets(rows, share, cap, weights))
    # salted, as one source may hold most rows; small sources ride on AQE
    n_of = rows.filter("size > 0").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    targets = C.stored(targets.join(n_of, targets["source"].eqNullSafe(n_of["source"]), "left")
                       .select(targets["*"], F.coalesce("n", F.lit(0)).alias("n")))
    t = targets.withColumnRenamed("source", "src")
    base = rows.join(t.hint("merge"), rows["source"].eqNullSafe(t["src"]), "left")
    copies = F.when(F.col("source_size") > 0, F.col("c") * F.col("target") / F.col("source_size")).otherwise(0.0)
    base = C.stored(base.withColumn("mean", copies).withColumn("whole", F.floor("mean"))
                    .withColumn("f", F.col("mean") - F.col("whole"))
                    .withColumn("h", F.xxhash64("doc_id", "size", F.lit(seed)))
                    .withColumn("sk", F.xxhash64("source"))
                    .select("src", "sk", "doc_id", "size", "c", "source_size", "target", "whole", "f", "h", "n"))
    live = "size > 0 AND f > 0 AND f < 1"
    top = targets.agg(F.max("n")).first()[0] or 0
    item = F.struct("size", "h", "doc_id", "c", "f").cast(_ITEM)
    groups = F.greatest(F.lit(1), F.ceil(F.col("n") / fan))
    level = (base.filter(live)
             .select("src", groups.alias("g_n"), F.pmod("h", groups).alias("g"), item.alias("item")))
    done = []
    depth = 0
    while True:
        folded = (level.groupBy("src", "g_n", "g").agg(F.collect_list("item").alias("items"))
                  # large documents first: the small ones that follow settle them
                  .withColumn("items", F.reverse(F.array_sort("items")))
                  .select("src", "g_n", "g", _fold(seed + depth).alias("r")))
        folded = C.stored(folded)
        done.append(folded.select("src", F.explode("r.done").alias("x")))
        left = folded.filter("r.hold IS NOT NULL").select("src", "g_n", "g", F.col("r.hold").alias("item"))
        # a residual that came out whole (by rounding of doubles) is done
        done.append(left.filter("item.f <= 0 OR item.f >= 1").select("src", F.col("item").alias("x")))
        left = left.filter("item.f > 0 AND item.f < 1")
        top = -(-top // fan)
        if top <= 1:
            break
        depth += 1
        up = F.greatest(F.lit(1), F.ceil(F.col("g_n") / fan))
        level = left.select("src", up.alias("g_n"), F.pmod("g", up).alias("g"), "item")
    draw = F.expr(f"(pmod(xxhash64(item.h, {seed}, 'last'), 1000000007) + 0.5D) / 1000000007")
    done.append(left.withColumn("up", (draw < F.col("item.f")).cast("double")).select(
        "src", F.col("item").withField("f", F.col("up")).alias("x")))
    extra = done[0]
    for d in done[1:]:
        extra = extra.unionAll(d)
    extra = extra.select("src", F.col("x.doc_id").alias("doc_id"), F.col("x.size").alias("size"),
                         F.col("x.f").alias("f"))
    none = base.filter(f"NOT ({live})").select("src", "doc_id", "size", F.lit(0.0).alias("f"))
    got = extra.unionAll(none).select(F.xxhash64("src").alias("sk"), F.col("src").alias("s2"), F.col("doc_id").alias("d2"),
                                      F.col("size").alias("z2"), F.round("f").cast("long").alias("extra"))
    out = base.join(got.hint("merge"), (base["doc_id"].eqNullSafe(got["d2"])) & (base["size"] == got["z2"])
                    & (base["sk"] == got["sk"]) & base["src"].eqNullSafe(got["s2"]))
    k = F.col("whole") + F.col("extra")
    one = F.floor(k / F.col("c")) + (F.col("i") <= F.pmod(k, F.col("c"))).cast("long")
    return (out.select("doc_id", "size", "source_size", "target", "whole", "extra", "c",
                       F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))).alias("i"))
            .select("doc_id", "size", "source_size", "target", (one * F.col("size")).cast("long").alias("taken")))
