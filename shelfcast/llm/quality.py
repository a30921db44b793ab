"""Quality classifier: random Fourier features of document statistics, ridge
scores from partition-summed normal equations, isotonic calibration.

1. Every text gets ``STATS`` statistics (one vectorised pass, whole texts).
2. Statistics are standardised with training moments and mapped to
   ``FEATURES`` random Fourier features, cos(Wx + b), whose inner products
   approximate a Gaussian kernel.
3. Each partition of the labelled training rows sums its Z'Z and Z'y (a fixed
   size, whatever the rows); partitions are added up in a tree, and the ridge
   system of FEATURES equations is solved on the driver.
4. Scores of a calibration part of the training rows are counted on a fixed
   grid; pooling adjacent violators on the grid gives a monotone curve, and
   scores between grid points are interpolated.

All labelled rows outside the held-out fold are used: nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

FEATURES, SEED, RIDGE = 192, 5, 1e-3
GRID = 512

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 non-ASCII, 6.. marks
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[32, 9, 11, 12, 13]], _CLASS[128:] = 4, 5
for _i, _marks in enumerate((b".", b",", b"!", b"?", b"|", b"\n", b":;", b"'\"", b"()[]{}", b"<>", b"@#$%^&*_=+~`\\/-")):
    _CLASS[list(_marks)] = 6 + _i
CLASSES = 17
_UTF8_TAIL = np.zeros(256, bool)
_UTF8_TAIL[128:192] = True
STATS = CLASSES + 14


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATS numbers per text; an empty text gives zeros."""
    w = C.Words(texts)
    m = len(texts)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    row = np.repeat(np.arange(m), np.diff(at))
    size = np.maximum(np.diff(at) - 1, 1)
    share = np.bincount(row * CLASSES + _CLASS[w.data], minlength=m * CLASSES).reshape(m, CLASSES) / size[:, None]
    h = w.hashes()
    n = np.diff(w.first)
    wrow = np.repeat(np.arange(m), n)
    tails = np.append(0, np.cumsum(_UTF8_TAIL[w.data]))
    length = (w.end - w.start - (tails[w.end] - tails[w.start])).astype(float)
    some = np.maximum(n, 1)

    def mean(x: np.ndarray) -> np.ndarray:
        return np.bincount(wrow, weights=x, minlength=m) / some

    first, last = w.data[w.start], w.data[np.maximum(w.end - 1, 0)]
    kind_first, kind_last = _CLASS[first], _CLASS[last]
    # distinct words and word pairs, most frequent word, repeats of the word before and of words 2 to 16 before
    order = np.lexsort((h, wrow))
    new = np.append(True, (np.diff(wrow[order]) != 0) | (np.diff(h[order]) != 0)) if len(h) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    runs = np.diff(np.append(start, len(h)))
    most = np.zeros(m)
    if len(start):
        np.maximum.at(most, wrow[order][start], runs)
    distinct = np.bincount(wrow[order][start], minlength=m) if len(start) else np.zeros(m)
    pair = C.mix64(h[:-1] + np.uint64(3) * h[1:]) if len(h) > 1 else np.zeros(0, np.uint64)
    prow = wrow[:-1] if len(h) > 1 else np.zeros(0, np.int64)
    inside = prow == wrow[1:] if len(h) > 1 else np.zeros(0, bool)
    pair, prow = pair[inside], prow[inside]
    po = np.lexsort((pair, prow))
    pnew = np.append(True, (np.diff(prow[po]) != 0) | (np.diff(pair[po]) != 0)) if len(pair) else np.zeros(0, bool)
    pairs = np.bincount(prow[po][pnew], minlength=m) if len(pair) else np.zeros(m)
    same = np.append(False, (h[1:] == h[:-1]) & (wrow[1:] == wrow[:-1])) if len(h) else np.zeros(0, bool)
    big = np.zeros(len(h), bool)
    if len(h):
        upper = np.append(0, np.cumsum(_CLASS[w.data] == 2))
        big = upper[w.end] - upper[w.start] > (w.end - w.start) / 2
    mean_len = mean(length)
    return np.column_stack([
        share, np.log1p(size) / 10, np.log1p(n) / 10, mean_len / 10, np.sqrt(np.maximum(mean(length**2) - mean_len**2, 0)) / 10,
        distinct / some, pairs / np.maximum(n - 1, 1), most / some, mean(same), mean(big), mean(kind_first == 2),
        mean(kind_last == 6), mean(kind_last == 7), mean(kind_last == 8), mean(length > 20)]) * (n > 0)[:, None]


def stat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, texts in C.slices(b.column("text")):
            x = statistics(texts).astype(np.float32)
            flat = pa.array(x.reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(at, len(texts)),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * STATS), flat)],
                ["doc_id", "x"])


class Model:
    """Standardised random Fourier features, ridge weights and the isotonic curve."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, features: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-6, std, 1.0)
        d = len(mean)
        self.w = rng.normal(size=(d, features)) / np.sqrt(d)
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.beta = np.zeros(features + 1)
        self.curve = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        return np.column_stack([np.cos(z @ self.w + self.b) * np.sqrt(2 / self.w.shape[1]), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        r = self.raw(x)
        # a slight slope inside flat steps keeps the order of the ridge scores
        return np.clip(0.999 * np.interp(r, *self.curve) + 0.001 * np.clip(r, 0, 1), 0, 1)


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.values if column.offset == 0 else column.flatten(), dtype=np.float64).reshape(len(column), STATS)


def summed(train: DataFrame, model: Model) -> np.ndarray:
    """[Z y]'[Z y] over all rows: each partition's sum, then a tree of sums."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.beta) + 1
        total = np.zeros((k, k))
        for b in batches:
            z = np.column_stack([model.features(matrix(b.column("x"))), np.asarray(b.column("y"), dtype=float)])
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    rows = train.select("x", "y").mapInArrow(part, "s binary").rdd.map(lambda r: np.frombuffer(r.s))
    k = len(model.beta) + 1
    return rows.treeReduce(np.add, depth=3).reshape(k, k)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: non-decreasing fit of y with weights n."""
    value, weight, width = [], [], []
    for yi, ni in zip(y, n):
        value.append(yi), weight.append(ni), width.append(1)
        while len(value) > 1 and value[-2] >= value[-1]:
            v, c, k = value.pop(), weight.pop(), width.pop()
            value[-1] = (value[-1] * weight[-1] + v * c) / (weight[-1] + c)
            weight[-1] += c
            width[-1] += k
    return np.repeat(value, width)


def fit(stats: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1, features: int = FEATURES,
        ridge: float = RIDGE, seed: int = SEED) -> Model | None:
    """Model from (doc_id, x) and (doc_id, y in 0/1) outside the held-out
    fold; None without both labels. Half of one training fold calibrates."""
    y = labels.filter("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    y = y.filter(C.fold(mod) != held)
    part = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    train = C.stored(stats.join(y.hint("merge"), "doc_id").withColumn("cal", F.pmod(F.floor(part / mod), F.lit(4)) == 0))
    at = [F.col("x")[i].cast("double") for i in range(STATS)]
    moments = train.agg(F.count(F.lit(1)), F.sum("y"), F.sum((~F.col("cal")).cast("int")),
                        *[F.avg(c) for c in at], *[F.stddev_pop(c) for c in at]).first()
    n, ones = moments[0], moments[1] or 0
    if not n or ones in (0, n):
        return None
    model = Model(np.array(moments[3:3 + STATS], float), np.array(moments[3 + STATS:], float), features, seed)
    s = summed(train.filter("NOT cal") if moments[2] else train, model)
    k = len(model.beta)
    penalty = np.diag(np.append(np.full(k - 1, ridge * max(s[k - 1, k - 1], 1)), 1e-9))
    model.beta = np.linalg.solve(s[:k, :k] + penalty, s[:k, k])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = np.clip(model.raw(matrix(b.column("x"))) * GRID, -GRID, 2 * GRID).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), b.column("y")], ["cell", "y"])

    cal = train.filter("cal") if moments[2] not in (0, n) else train
    grid = (cal.select("x", F.col("y").cast("long").alias("y")).mapInArrow(counted, "cell long, y long")
            .groupBy("cell").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("cell").collect())
    x, yy, nn = (np.array([r[i] for r in grid], float) for i in range(3))
    model.curve = (x + 0.5) / GRID, isotonic(x, yy, nn)
    return model


def stats_of(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return C.stored(rows.mapInArrow(stat_rows, "doc_id long, x array<float>"))


def scores(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``.

    ``labels``: (doc_id, y). Null and empty texts have all statistics 0 and
    are scored like any other. Without labels of both classes every score is
    0.5. Of several labels of a doc_id the larger counts. Extra columns are
    ignored; repeated rows score alike."""
    stats = stats_of(docs)
    model = fit(stats, labels, mod, held)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(matrix(b.column("x"))) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    out = stats.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", (C.fold(mod) == held).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, that score ``threshold`` or more. Texts
    are scored where they lie: only the labelled rows' statistics move."""
    model = fit(stats_of(docs), labels, mod, held)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.full(b.num_rows, 0.5)
            for at, texts in C.slices(b.column("text")):
                if model:
                    s[at:at + len(texts)] = model.score(statistics(texts).astype(np.float32).astype(float))
            yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(keep, docs.schema)
