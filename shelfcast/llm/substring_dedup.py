"""Repeated-substring removal by De Bruijn compaction over word k-mers.

Windows of ``window`` consecutive words that occur more than once are found
without shipping every window:

1. *Nodes*: word k-mers chosen by content alone (hash divisible by
   ``every``). The text between two consecutive nodes of a document is an
   edge; document start and end are edges too. Nodes are counted with a
   partial aggregate that keeps the smallest and largest in- and out-edge.
2. *Compaction*: a node with one in-edge and one out-edge does not branch, so
   all occurrences share the path through it. A window holding a node that
   occurs once is unique; a window whose nodes lead along nonbranching edges
   over both its ends is repeated. Both are decided without looking at words.
3. *Verification*: windows around branching nodes, and windows with no node,
   are counted by a 128-bit hash of all their words at their source
   coordinates. The kind of a window depends on its content only, so equal
   windows are always counted together and the result is exact.

Node and window joins are plain equi-joins after a partial aggregate, so a
passage that a third of the corpus shares is split by AQE, and per-document
lists are bounded by the document's own words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW, K, EVERY = 35, 8, 8


def _nodes(h: np.ndarray, first: np.ndarray, k: int, every: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index and hash of the chosen k-mers (none crosses a row)."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start = np.arange(n - k + 1)
    node = C.seq_hashes(h, start, start + k)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    keep = (node % np.uint64(every) == 0) & (row[: n - k + 1] == row[k - 1:])
    return start[keep], node[keep]


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], C.Words]]:
    for first, texts in C.slices(batch.column("text")):
        yield first, texts, C.Words(texts)


def node_rows(window: int, k: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts, w in _rows_of(b):
                h = w.keys()
                pos, node = _nodes(h, w.first, k, every)
                row = np.searchsorted(w.first, pos, side="right") - 1
                lo, hi = w.first[row], w.first[row + 1]
                long = hi - lo >= window
                pos, node, row, lo, hi = pos[long], node[long], row[long], lo[long], hi[long]
                if not len(pos):
                    continue
                same = row[1:] == row[:-1]
                left = np.append(False, same)
                right = np.append(same, False)
                in_from = np.where(left, np.roll(pos, 1), lo)
                out_to = np.where(right, np.roll(pos, -1) + k, hi)
                h_in = C.seq_hashes(h, in_from, pos + k) ^ np.where(left, 0, 0x5851F42D4C957F2D).astype(np.uint64)
                h_out = C.seq_hashes(h, pos, out_to) ^ np.where(right, 0, 0x5851F42D4C957F2D).astype(np.uint64)
                src = pa.array(row + at)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(src), b.column("th").take(src), pa.array((pos - lo).astype(np.int32)),
                     pa.array(C.as_long(node)), pa.array(C.as_long(h_in)), pa.array(C.as_long(h_out))],
                    ["doc_id", "th", "pos", "node", "h_in", "h_out"])
    return run


def window_rows(window: int, k: int, every: int):
    """Decide each window; ``n`` > 0: a repeated run of n windows from p;
    ``n`` = 0: one window to be counted by its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flags = b.column("flags")
            for at, texts, w in _rows_of(b):
                h = w.keys()
                pos, _ = _nodes(h, w.first, k, every)
                # flag of each node: 0 unique, else 4 | 1 (in branches) | 2 (out branches)
                mark = np.zeros(len(h) + 1, np.int8)
                for r in range(len(texts)):
                    f = flags[at + r]
                    if f.is_valid and len(f.values):
                        v = np.asarray(f.values, dtype=np.int64)
                        mark[w.first[r] + (v >> 3)] = v & 7
                flag = mark[pos]
                m = len(pos)
                idx = np.arange(m)
                uniq = np.append(0, np.cumsum(flag == 0))
                nxt = np.append(np.where(flag & 1, idx, m + 1), m + 1)
                nxt = np.minimum.accumulate(nxt[::-1])[::-1]
                prv = np.maximum.accumulate(np.append(-1, np.where(flag & 2, idx, -1)))
                n = np.diff(w.first)
                count = np.maximum(n - window + 1, 0)
                row = np.repeat(np.arange(len(texts)), count)
                p = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + w.first[:-1][row]
                a = np.searchsorted(pos, p)
                z = np.searchsorted(pos, p + window - k, side="right") - 1
                some = z >= a
                known = some & (uniq[z + 1] == uniq[a])
                first_in = np.minimum(nxt[a], z + 1)
                last_out = np.maximum(prv[z + 1], a - 1)
                path = known & (last_out < first_in - 1)
                ask = (known & ~path) | ~some
                lo = w.first[:-1][row]
                out = []
                if path.any():
                    q = np.flatnonzero(path)
                    cut = np.flatnonzero(np.append(True, (np.diff(q) != 1) | (np.diff(row[q]) != 0)))
                    size = np.diff(np.append(cut, len(q)))
                    s = q[cut]
                    zero = np.zeros(len(s), np.int64)
                    out.append((row[s], p[s] - lo[s], size, zero, zero))
                if ask.any():
                    s = np.flatnonzero(ask)
                    out.append((row[s], p[s] - lo[s], np.zeros(len(s), np.int64),
                                C.as_long(C.seq_hashes(h, p[s], p[s] + window)),
                                C.as_long(C.seq_hashes(w.keys(1), p[s], p[s] + window, 1))))
                for r, q, size, w1, w2 in out:
                    src = pa.array(r + at)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(src), b.column("th").take(src), pa.array(q.astype(np.int32)),
                         pa.array(size.astype(np.int32)), pa.array(w1), pa.array(w2)],
                        ["doc_id", "th", "p", "n", "w1", "w2"])
    return run


def cut_words(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column("spans")
            n_words, n_removed, kept = [], [], []
            for at, texts, w in _rows_of(b):
                for r, text in enumerate(texts):
                    words = text.translate(_BLANKS).split(b" ")
                    words = [x for x in words if x]
                    v = spans[at + r]
                    gone = np.zeros(len(words) + 1, np.int64)
                    if v.is_valid and len(v.values):
                        s = np.asarray(v.values, dtype=np.int64)
                        start, size = s >> 32, s & 0xFFFFFFFF
                        np.add.at(gone, start, 1)
                        np.add.at(gone, start + size + window - 1, -1)
                    stay = np.cumsum(gone)[:-1] == 0
                    n_words.append(len(words))
                    n_removed.append(int(len(words) - stay.sum()))
                    kept.append(b" ".join(words if stay.all() else [x for x, y in zip(words, stay) if y]))
            cols = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                    "kept": pa.array([x.decode("utf-8", "surrogatepass") for x in kept], pa.string()),
                    "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *cols.values()], ["doc_id", *cols])
    return run


_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def repeated_spans(docs: DataFrame, window: int = WINDOW, k: int = K, every: int = EVERY) -> DataFrame:
    """Repeated windows of (doc_id, th): start ``p``, ``n`` windows in a run."""
    keyed = _keyed(docs)
    nodes = keyed.mapInArrow(node_rows(window, k, every),
                             "doc_id long, th long, pos int, node long, h_in long, h_out long")
    # stored, so that both sides of the join below are plain shuffles and AQE
    # can split a node that very many documents share
    again = C.stored(nodes.groupBy("node")
             .agg(F.count(F.lit(1)).alias("c"), F.min("h_in").alias("i0"), F.max("h_in").alias("i1"),
                  F.min("h_out").alias("o0"), F.max("h_out").alias("o1"))
             .filter("c > 1")
             .selectExpr("node", "4 + int(i0 <> i1) + 2 * int(o0 <> o1) AS f"))
    flags = (nodes.select("doc_id", "th", "pos", "node").join(again.hint("merge"), "node")
             .groupBy("doc_id", "th").agg(F.collect_set(F.expr("pos * 8L + f")).alias("flags")))
    decided = C.stored(
        _with(keyed, flags, "flags")
        .mapInArrow(window_rows(window, k, every), "doc_id long, th long, p int, n int, w1 long, w2 long"))
    asked = decided.filter("n = 0")
    twice = C.stored(asked.groupBy("w1", "w2").count().filter("count > 1").select("w1", "w2"))
    found = asked.join(twice.hint("merge"), ["w1", "w2"]).selectExpr("doc_id", "th", "p", "1 AS n")
    return decided.filter("n > 0").select("doc_id", "th", "p", "n").unionAll(found)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, k: int = K, every: int = EVERY) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256), one row per row of ``docs``.

    Null or empty text: no words, ``kept`` empty. Repeated rows count as two
    documents, so their windows are repeated. Extra columns are ignored.
    """
    spans = (repeated_spans(docs, window, k, every)
             .groupBy("doc_id", "th").agg(F.collect_set(F.expr("shiftleft(bigint(p), 32) + n")).alias("spans")))
    return _with(_keyed(docs), spans, "spans").mapInArrow(
        cut_words(window), "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_hash().alias("th"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _with(keyed: DataFrame, found: DataFrame, name: str) -> DataFrame:
    f = found.select(F.col("doc_id").alias("d2"), F.col("th").alias("th2"), name)
    return (keyed.join(f.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("th2")), "left")
            .select("doc_id", "th", "text", name))
