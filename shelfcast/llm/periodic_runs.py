"""Periodic runs by multi-scale minimizers.

A run is a maximal stretch of words with smallest period ``q`` (words ``q``
apart are identical) of at least ``max(min_words, 2 * q)`` words.

* Periods below ``DIRECT`` come from direct lag scans.
* Longer ones come in scales ``k = 4, 8, 16, ..``: scale ``k`` serves periods
  from ``8 * k`` to ``16 * k - 1``. The leftmost least k-gram of each window of
  ``2 * k`` words is a minimizer. Windows one period apart are equal inside a
  run, so their minimizers lie one period apart, too: pairs of equal
  minimizers at such distances seed an exact extension.
* Minimizers follow one another closely only where a short period holds.
  Neighbours of the same k-gram at most ``k / 2`` apart form a chain; a pair
  needs one member that is an end of its chain. No run is lost: if all
  minimizers of the first period are one chain, then the run starts where
  that chain's stretch does, or its second period where another chain does.
  So a text of one repeated word costs no more pairs than its length.

K-grams are numbered exactly, by doubling (no hashes that could meet), and only
where they occur twice in their document, so ordinary text is done after a few
levels. All work on a document lies in one row; a text is as long as a task can
hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_WORDS = 12
DIRECT = 32

RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def numbered(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, a number for each word (equal only within a text:
    other texts and the ends of texts have other ones), and where texts start."""
    words = [t.split() for t in texts]
    first = np.cumsum([0] + [len(w) + 1 for w in words])
    code = np.full(first[-1], -1, np.int64)
    flat = [x for w in words for x in w]
    inside = np.ones(first[-1], bool)
    inside[first[1:] - 1] = False
    at = np.flatnonzero(inside)
    if len(flat):
        code[at] = pd.factorize(np.array(flat, dtype=object))[0]
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    top = int(code.max(initial=0)) + 1
    number = row * (top + 1) + code
    number[first[1:] - 1] = -1 - np.arange(len(texts))
    return words, number, first


def gram_levels(number: np.ndarray) -> list[np.ndarray]:
    """level[j][i]: number of the 2**j words from i, or -1 where they occur once.
    The last level still holds repeated ones."""
    n = len(number)
    out: list[np.ndarray] = []
    at, key = np.arange(n), number
    while len(at):
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = count[inverse] > 1
        at = at[twice]
        if not len(at):
            break
        level = np.full(n, -1, np.int32)
        level[at] = np.unique(inverse[twice], return_inverse=True)[1]
        out.append(level)
        step = 1 << (len(out) - 1)
        at = at[at + step < n]
        at = at[level[at + step] >= 0]
        key = level[at].astype(np.int64) * n + level[at + step]
    return out


def lag_runs(number: np.ndarray, q: int, min_words: int) -> np.ndarray:
    """Runs (start, length, q) of one period, by comparing words ``q`` apart."""
    same = np.flatnonzero(number[:-q] == number[q:]) if len(number) > q else np.zeros(0, np.int64)
    if not len(same):
        return np.zeros((0, 3), np.int64)
    cut = np.flatnonzero(np.diff(same) != 1) + 1
    start = same[np.append(0, cut)]
    length = np.diff(np.concatenate([[0], cut, [len(same)]])) + q
    keep = length >= max(min_words, 2 * q)
    return np.stack([start[keep], length[keep], np.full(keep.sum(), q)], axis=1)


def minimizers(level: np.ndarray, k: int) -> np.ndarray:
    """Positions of the leftmost least k-gram of every window of 2 * k words all
    of whose k-grams occur twice."""
    at = np.flatnonzero(level >= 0)
    width = k + 1
    if len(at) < width:
        return np.zeros(0, np.int64)
    order = np.lexsort((at, C.mix64(level[at].astype(np.uint64) + np.uint64(1))))
    rank = np.empty(len(at), np.int64)
    rank[order] = np.arange(len(at))
    # least rank of each window, from running minima of blocks in both directions
    blocks = -(-len(at) // width)
    padded = np.full(blocks * width, len(at), np.int64)
    padded[: len(at)] = rank
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = len(at) - width + 1
    whole = at[width - 1:] - at[:m] == width - 1
    least = np.minimum(behind[:m], ahead[width - 1: width - 1 + m])[whole]
    return np.unique(at[order[np.unique(least)]])


def seeds(level: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of pairs of equal minimizers, one of them a chain's end."""
    at = minimizers(level, k)
    if len(at) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = level[at].astype(np.int64)
    linked = (gram[1:] == gram[:-1]) & (np.diff(at) <= k // 2)
    end = ~(np.append(False, linked) & np.append(linked, False))
    big = len(level) + 16 * k + 1
    order = np.argsort(gram * big + at)
    at, gram, end = at[order], gram[order], end[order]
    place = gram * big + at
    e = np.flatnonzero(end)

    def pairs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, z = np.searchsorted(place, lo), np.searchsorted(place, hi)
        count = np.maximum(z - a, 0)
        one = np.repeat(np.arange(len(e)), count)
        return at[e[one]], at[np.repeat(a - (np.cumsum(count) - count), count) + np.arange(count.sum())]

    base = gram[e] * big
    first, later = pairs(base + at[e] + 8 * k, base + at[e] + 16 * k)
    back, before = pairs(base + np.maximum(at[e] - 16 * k + 1, 0), base + np.maximum(at[e] - 8 * k + 1, 0))
    both = np.unique(np.stack([np.append(first, before), np.append(later - first, back - before)], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def extended(levels: list[np.ndarray], at: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the stretch of words round ``at`` that equal those ``q`` later."""
    n = len(levels[0])
    lo, hi = at.copy(), at.copy()
    for j in range(len(levels) - 1, -1, -1):
        level, step = levels[j], 1 << j
        ok = hi + q < n
        x = np.where(ok, level[np.where(ok, hi, 0)], -1)
        hi = hi + step * ((x >= 0) & (x == level[np.where(ok, hi + q, 0)]))
        ok = lo >= step
        x = np.where(ok, level[np.where(ok, lo - step, 0)], -1)
        lo = lo - step * ((x >= 0) & (x == level[np.where(ok, lo - step + q, 0)]))
    return lo, hi


def runs_of(number: np.ndarray, longest: int, min_words: int = MIN_WORDS) -> np.ndarray:
    """All runs (start, length, smallest period), by start, then period; ``longest``:
    words of the longest text."""
    found = [lag_runs(number, q, min_words) for q in range(1, min(DIRECT, longest // 2 + 1))]
    if longest >= 2 * DIRECT:
        levels = gram_levels(number)
        for j in range((DIRECT // 8).bit_length() - 1, len(levels)):
            at, q = seeds(levels[j], 1 << j)
            if len(at):
                lo, hi = extended(levels, at, q)
                keep = (hi - lo >= q) & (hi - lo + q >= min_words)
                found.append(np.unique(np.stack([lo, hi - lo + q, q], axis=1)[keep], axis=0))
    every = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    # a stretch that repeats after q repeats after multiples of q, too
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    new = np.append(True, (np.diff(every[:, :2], axis=0) != 0).any(axis=1))[: len(every)]
    every = every[new]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def run_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in C.slices(b.column("text")):
                words, number, first = numbered(texts)
                runs = runs_of(number, max(len(w) for w in words), min_words)
                row = np.searchsorted(first, runs[:, 0], side="right") - 1
                bound = np.searchsorted(row, np.arange(len(texts) + 1))
                runs[:, 0] -= first[row]
                kept = []
                for r, w in enumerate(words):
                    mine = runs[bound[r]: bound[r + 1]]
                    if len(mine):
                        gone = np.zeros(len(w) + 1, np.int64)
                        np.add.at(gone, mine[:, 0] + mine[:, 2], 1)
                        np.add.at(gone, mine[:, 0] + mine[:, 1], -1)
                        w = [w[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
                    kept.append(b" ".join(w))
                found = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in runs.T], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, len(texts)), pa.array([len(w) for w in words], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), found),
                     pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed), one row per row of ``docs``: all runs of
    the text's words by start, then period, and the text with every run
    collapsed to its first period (words joined by one space).

    Null or empty texts have no words, no runs and an empty ``collapsed``. Rows
    without doc_id and repeated rows are worked off like others. Extra columns
    are ignored; an empty table gives an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run_rows(min_words), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def planted(text: str = "text", doc_id: str = "doc_id") -> Column:
    """The text, where crc32(doc_id) calls for it with a period put in: with
    ``h`` that checksum and ``g = h // 10``, if ``h % 10 = 0`` each of the ``n`` words from
    ``a = g % n`` on becomes word ``a + (i - a) % p``, ``p = 1 + (n - a) // (3 + g % 8)``.
    Rows without doc_id keep their text."""
    h = F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(C.WORD), F.lit(0))
    # one struct per step, so that the words are taken apart once
    parts = F.transform(F.array(words), lambda w: F.struct(w.alias("w"), F.size(w).cast("long").alias("n"), F.expr(
        f"crc32(cast(cast({doc_id} AS long) AS string)) div 10").alias("g")))
    parts = F.transform(parts, lambda s: F.struct(s["w"].alias("w"), s["n"].alias("n"), (s["g"] % s["n"]).alias("a"),
                                                  (s["g"] % 8 + 3).alias("d")))
    parts = F.transform(parts, lambda s: F.struct(s["w"].alias("w"), s["n"].alias("n"), s["a"].alias("a"),
                                                  (F.floor((s["n"] - s["a"]) / s["d"]) + 1).alias("p")))
    made = F.transform(parts, lambda s: F.array_join(F.transform(
        F.sequence(F.lit(0).cast("long"), s["n"] - 1),
        lambda i: F.element_at(s["w"], (F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]) + 1).cast("int"))), " "))
    some = F.coalesce(F.col(text), F.lit("")).rlike(C.WORD)
    return F.when((h % 10 == 0) & some, F.element_at(made, 1)).otherwise(F.col(text))
