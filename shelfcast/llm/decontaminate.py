"""Benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment.

A document holds an item if the best local alignment of their words scores at
least ``LEAK`` of a perfect copy's. Seeds are pairs of words at most one word apart,
in the item as in the document, so they outlive an edit between them.

*Why none is lost.* With ``m`` matched words and ``e`` errors the score is
``2 m - e >= 2 * LEAK * n`` for an item of ``n`` words. Of the ``m - 1`` neighbouring matches at
most ``e / 2`` have two errors between them; the others, at least
``LEAK * n - 1``, are seeds that start at different words of the item. So even
without the ``d`` starts that are most frequent in the corpus a document that
holds the item has ``LEAK * n - 1 - d`` of the others.

1. One pass over the texts keeps each document's seeds that some item has. Of an
   item's starts those that more than ``RARE`` of the documents have are left out,
   most frequent first, while at least one hit stays needed.
2. The documents' seeds join the items' rare ones in Spark; hits are added up per
   document and item, and a pair goes on with as many as it needs.
3. Of each pair, the stretches of the document with enough seeds of the item close
   together are aligned with it.

Tasks drop pairs of words that no item has with a Bloom filter of at most
``FILTER_BITS`` bits; a larger benchmark passes more of them on to the join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

LEAK = 0.4
MATCH, MISS, GAP = 2, -1, -1
#: Share of the documents beyond which a seed is frequent, and a number that never is.
RARE, FEW = 0.05, 100
#: Bits per seed and at most in all, and probes, of the filter.
BITS_PER_SEED, FILTER_BITS, PROBES = 32, 1 << 28, 4
#: Items that one row brings to a document's text, about.
TOGETHER = 64

_DROP = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def normal(text: bytes) -> bytes:
    """Lower-cased, ASCII punctuation dropped."""
    return text.decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass").translate(None, _DROP)


def matches_needed(n: int, leak: float) -> int:
    """Words of an item of ``n`` that a document with it matches at least."""
    return max(1, math.ceil(leak * n - 1e-9))


def seeds(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, word number and key of every pair of words at most one word apart."""
    w = C.Words([normal(t) for t in texts])
    key = w.keys()
    left, right = key * _ODD[1], C.mix64(key)
    n = np.diff(w.first)
    row = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(key)) - np.repeat(w.first[:-1], n)
    out = []
    for step in (1, 2):
        at = np.flatnonzero(row[step:] == row[:-step]) if len(key) > step else np.zeros(0, np.int64)
        out.append((row[at], place[at], left[at] + right[at + step]))
    return tuple(np.concatenate(x) for x in zip(*out))


class Filter:
    """Bloom filter over keys of 64 bits."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits = bits
        self.data = np.zeros(max(1, (1 << bits) // 8), np.uint8) if data is None else data

    def places(self, key: np.ndarray, odd: np.uint64) -> np.ndarray:
        return ((key * odd) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, key: np.ndarray) -> None:
        for odd in _ODD[:PROBES]:
            at = self.places(key, odd)
            np.bitwise_or.at(self.data, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def among(self, key: np.ndarray) -> np.ndarray:
        """Positions of the keys that may be in the set."""
        left = np.arange(len(key))
        for odd in _ODD[:PROBES]:
            at = self.places(key[left], odd)
            left = left[(self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        return left


def filter_of(keys: DataFrame) -> Filter:
    """Filter of a column ``key``, filled in a few tasks; its size is bounded."""
    n = keys.count()
    bits = min(FILTER_BITS.bit_length() - 1, max(16, (BITS_PER_SEED * n).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Filter(bits)
        for b in batches:
            one.add(np.asarray(b.column("key")).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([one.data.tobytes()], pa.binary())], ["data"])

    out = Filter(bits)
    for r in keys.select("key").coalesce(4).mapInArrow(fill, "data binary").collect():  # at most 4 bitmaps
        out.data |= np.frombuffer(r.data, np.uint8)
    return out


def item_rows(leak: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in C.slices(b.column("text")):
                row, pos, key = seeds(texts)
                n = np.array([len(normal(t).split()) for t in texts])
                keep = np.array([leak * x > 1 + 1e-9 for x in n])[row]
                row, pos, key = row[keep], pos[keep], key[keep]
                yield pa.RecordBatch.from_arrays(
                    [b.column("item_id").take(pa.array(row + at)), pa.array(n[row].astype(np.int32)),
                     pa.array(pos.astype(np.int32)), pa.array(C.as_long(key))], ["item_id", "n", "start", "key"])
    return run


def seed_rows(shared, bits: int):
    """The distinct keys of each document that pass the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(bits, np.frombuffer(shared.value, np.uint8))
        for b in batches:
            for at, texts in C.slices(b.column("text")):
                row, _, key = seeds(texts)
                some = known.among(key)
                if not len(some):
                    continue
                row, key = row[some], key[some]
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                new = np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]))
                src = pa.array(row[new] + at)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(src), b.column("th").take(src), pa.array(C.as_long(key[new]))], ["doc_id", "th", "key"])
    return run


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: score as a share of the item's own, and where it
    starts and ends in the passage."""
    m = len(passage)
    steps = np.arange(m + 1) * GAP
    prev, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    best, best_from, best_to = 0, 0, 0
    for x in item:
        diag = prev[:-1] + np.where(passage == x, MATCH, MISS)
        up = prev[1:] + GAP
        here = np.maximum(np.maximum(diag, up), 0)
        origin = np.where(here == 0, np.arange(1, m + 1), np.where(diag >= up, start[:-1], start[1:]))
        here, origin = np.append(0, here), np.append(0, origin)
        # gaps along the passage: the best cell to the left, less its distance
        reach = here - steps
        top = np.maximum.accumulate(reach)
        at = np.maximum.accumulate(np.where(reach == top, np.arange(m + 1), 0))
        prev, start = top + steps, origin[at]
        j = int(prev.argmax())
        if prev[j] > best:
            best, best_from, best_to = int(prev[j]), int(start[j]), j
    return best / (MATCH * len(item)), best_from, best_to


def pairs_of(code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Position and exact number of every pair of words at most one word apart."""
    return (np.concatenate([np.arange(max(len(code) - s, 0)) for s in (1, 2)]),
            np.concatenate([code[:-s] * size + code[s:] if len(code) > s else code[:0] for s in (1, 2)]))


def passages(at: np.ndarray, n: int, length: int, leak: float) -> list[tuple[int, int]]:
    """Merged stretches of a document's ``length`` words that any alignment of score
    ``leak`` lies in; ``at``: where its seeds meet those of an item of ``n`` words, in order.
    An alignment spans ``(3 - 2 leak) n`` words at most (n matches and as many errors as
    they can pay for) and holds enough seeds."""
    need, reach = max(1, matches_needed(n, leak) - 1), math.ceil((3 - 2 * leak) * n)
    if len(at) < need:
        return []
    close = np.flatnonzero(at[need - 1:] - at[: len(at) - need + 1] < reach)
    if not len(close):
        return []
    lo, hi = at[close], at[close + need - 1]
    cut = np.flatnonzero(lo[1:] - np.maximum.accumulate(hi)[:-1] > 2 * reach) + 1
    first, last = np.append(0, cut), np.append(cut - 1, len(lo) - 1)
    return list(zip(np.maximum(lo[first] - reach, 0).tolist(), np.minimum(hi[last] + reach, length).tolist()))


def aligned_rows(leak: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, (text, items) in enumerate(zip(b.column("text"), b.column("items"))):
                items = items.as_py()
                words = [normal((t or "").encode("utf-8", "surrogatepass")).split()
                         for t in [text.as_py(), *(x["text"] for x in items)]]
                code = pd.factorize(np.array([w for x in words for w in x] or [b""], dtype=object))[0]
                doc, *codes = np.split(code[: sum(map(len, words))], np.cumsum([len(w) for w in words])[:-1])
                size = int(code.max()) + 1
                place, pair = pairs_of(doc, size)
                for x, item in zip(items, codes):
                    best = (0.0, 0, 0)
                    at = np.sort(place[np.isin(pair, pairs_of(item, size)[1])])
                    for lo, hi in passages(at, len(item), len(doc), leak):
                        score, a, z = align(item, doc[lo:hi])
                        if score >= leak and score > best[0]:
                            best = (score, lo + a, lo + z)
                    if best[0]:
                        out.append((i, x["item_id"], *best))
            if out:
                row, item, score, x, y = zip(*out)
                src = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(src), b.column("th").take(src), pa.array(item, pa.int64()),
                     pa.array(score, pa.float64()), pa.array(x, pa.int32()), pa.array(y, pa.int32())],
                    ["doc_id", "th", "item_id", "score", "first_word", "end_word"])
    return run


LEAKS = "doc_id long, th long, item_id long, score double, first_word int, end_word int"


def rare_seeds(every: DataFrame, hits: DataFrame, documents: int, leak: float = LEAK, rare: float = RARE,
               few: int = FEW) -> DataFrame:
    """(key, item_id, start, need): the seeds of each item that are looked up, and how
    many different starts a document with the item has among them."""
    often = hits.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    limit = max(few, int(rare * documents))
    starts = every.join(often, "key", "left").groupBy("item_id", "n", "start").agg(
        F.sum(F.coalesce("c", F.lit(0))).alias("c"), F.collect_set("key").alias("keys"))
    # per item: the most frequent starts go, as long as one hit stays needed
    whole = starts.groupBy("item_id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "start", "keys")), asc=False).alias("s"))
    whole = whole.withColumn("hits", F.greatest(F.ceil(F.col("n") * F.lit(leak) - F.lit(1e-9)).cast("int") - 1, F.lit(1)))
    whole = whole.withColumn("gone", F.least(F.expr(f"size(filter(s, x -> x.c > {limit}))"), F.col("hits") - 1))
    kept = whole.select("item_id", (F.col("hits") - F.col("gone")).alias("need"),
                        F.explode(F.expr("slice(s, gone + 1, size(s))")).alias("x"))
    return kept.select("item_id", "need", F.col("x.start").alias("start"), F.explode("x.keys").alias("key"))


def leaks(docs: DataFrame, benchmark: DataFrame, leak: float = LEAK, rare: float = RARE, few: int = FEW) -> DataFrame:
    """(doc_id, th, item_id, score, first_word, end_word) of each pair of a
    document and an item it holds; words are counted after normalisation. Every
    pair whose alignment reaches ``leak`` is found; ``rare`` and ``few`` only move work.

    ``th`` tells rows of one doc_id with different texts apart. Null or empty
    texts and items, and items of at most ``1 / leak`` words (one shared word would do),
    give no rows; repeated rows give one; of several items with one id each counts as that
    id's text of the greatest length. Extra columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_hash().alias("th"), "text")
    items = C.stored(benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL")
                     .groupBy(F.col("item_id").cast("long").alias("item_id"))
                     .agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text")))
    every = C.stored(items.mapInArrow(item_rows(leak), "item_id long, n int, start int, key long").distinct())
    known = filter_of(every.select("key").distinct())
    shared = rows.sparkSession.sparkContext.broadcast(known.data.tobytes())  # at most FILTER_BITS
    hits = C.stored(rows.mapInArrow(seed_rows(shared, known.bits), "doc_id long, th long, key long"))
    wanted = C.stored(rare_seeds(every, hits, rows.count(), leak, rare, few))
    # different starts hit: at most as many as the item has words
    pairs = (hits.join(wanted, "key").groupBy("doc_id", "th", "item_id", "need")
             .agg(F.size(F.collect_set("start")).alias("got")).filter("got >= need"))
    # one row per document, or per TOGETHER of its items
    many = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("doc_id", "th")) / F.lit(TOGETHER))
    some = (pairs.withColumn("salt", F.pmod(F.xxhash64("item_id"), many)).join(items, "item_id").groupBy("doc_id", "th", "salt")
            .agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
            .select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), "items"))
    both = rows.join(some.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")))
    return both.select("doc_id", "th", "text", "items").mapInArrow(aligned_rows(leak), LEAKS).distinct()


def clean(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """Rows of ``docs``, all columns, that hold no benchmark item. Rows with null or
    empty texts stay, as do all if the benchmark is empty; repeated rows stay or go together."""
    bad = leaks(docs, benchmark, **kw).select(F.col("doc_id").alias("d2"), F.col("th").alias("t2")).distinct()
    rows = C.row_of(docs, F.col("doc_id").cast("long").alias("doc_id"), C.text_hash().alias("th"))
    return C.back_from(rows.join(bad.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")),
                                 "left_anti"), docs)
