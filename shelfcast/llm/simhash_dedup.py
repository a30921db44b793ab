"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart have a common variant within
``radius / 2`` bits of both, so each fingerprint emits all its variants
within half the radius and fingerprints meet where they share one.

* Equal fingerprints are one before anything is emitted.
* Variants are shuffled on their first ``PREFIX`` bits. Variants with the
  same first bits travel as one row, the fingerprint itself (137 rows in
  place of 2,081 for radius 4), and are spread out in the task that receives
  them, ``CHUNK`` at a time: a prefix with more of them is taken apart by its
  next eight bits.
* Fingerprints that share a variant are all within the radius of each other
  (triangle inequality), so one is linked with the others, not all with all;
  each link's distance is verified. The links of a chunk leave it as
  one link per fingerprint, to the least one it is connected with.
* Links are closed by connected components over Spark joins.

Nothing is capped, and what a task holds does not depend on the size of a
group of near copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

SHINGLE, RADIUS = 4, 4
BITS, PREFIX, STEP = 64, 16, 8
#: Seed of the shingle hash XXH64.
SEED = 42
#: Variants that a task spreads out at a time.
CHUNK = 1 << 21

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of every run of ``size`` words, joined by one space; of fewer words, of all."""
    words = text.translate(_LOWER).split()
    line = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(line, SEED)] if words else []
    length = np.array([len(w) + 1 for w in words])
    start = np.cumsum(length) - length
    end = (start + length - 1)[size - 1:]
    return [xxhash.xxh64_intdigest(line[a:z], SEED) for a, z in zip(start.tolist(), end.tolist())]


def fingerprint_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in C.slices(b.column("text")):
                hashes = [shingle_hashes(t, size) for t in texts]
                n = np.array([len(h) for h in hashes])
                some = np.flatnonzero(n)
                out = np.zeros(len(texts), np.uint64)
                if len(some):
                    flat = np.array([x for h in hashes for x in h], np.uint64)
                    bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    ones = np.add.reduceat(bits, np.cumsum(n[some]) - n[some], axis=0, dtype=np.int64)
                    out[some] = np.packbits(2 * ones > n[some, None], axis=1, bitorder="little").reshape(-1).view(np.uint64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(texts)), pa.array(C.as_long(out))],
                                                 ["doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp), one row per row of ``docs``: a bit of ``fp`` is set if it is in over
    half of the hashes of the text's shingles, repeats included. Texts
    without words, and null ones, have fingerprint 0."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        fingerprint_rows(size), "doc_id long, fp long")


def masks(bits: int, flips: int) -> list[np.ndarray]:
    """masks[d]: all numbers of ``bits`` bits with exactly ``d`` ones, d = 0 .. flips."""
    out = [np.zeros(1, np.uint64)]
    for _ in range(min(flips, bits)):
        lower = out[-1][:, None]
        one = (np.uint64(1) << np.arange(bits, dtype=np.uint64))[None, :]
        out.append(np.unique((lower | one)[(lower < one)]))
    return out


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def spread(prefix: np.ndarray, fp: np.ndarray, left: np.ndarray, low: int, step: int):
    """Variants of ``fp`` in the ``step`` bits below ``prefix``: (longer prefix, fp, flips left)."""
    shift = np.uint64(low - step)
    part = (fp >> shift) & np.uint64((1 << step) - 1)
    one = masks(step, int(left.max(initial=0)))
    got = []
    for flips, mask in enumerate(one):
        r = np.flatnonzero(left >= flips)
        p = (prefix[r] << np.uint64(step) | part[r])[:, None] ^ mask[None, :]
        got.append((p.reshape(-1), np.repeat(fp[r], len(mask)), np.repeat(left[r] - flips, len(mask))))
    return tuple(np.concatenate(x) for x in zip(*got))


def connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One link from each end of the links to the least one it is connected with."""
    ends, at = np.unique(np.append(a, b), return_inverse=True)
    x, y = at[: len(a)], at[len(a):]
    up = np.arange(len(ends))
    while True:
        low = np.minimum(up[x], up[y])
        new = up.copy()
        for e in (x, y, up[x], up[y]):
            np.minimum.at(new, e, low)
        new = new[new]
        if (new == up).all():
            break
        up = new
    away = up != np.arange(len(ends))
    return ends[away], ends[up[away]]


def meet(prefix: np.ndarray, fp: np.ndarray, left: np.ndarray, low: int, radius: int,
         chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of fingerprints that share a variant; ``low`` bits below ``prefix`` are
    still to be spread, with ``left`` flips."""
    order = np.argsort(prefix, kind="stable")
    prefix, fp, left = prefix[order], fp[order], left[order]
    new = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1])[: len(prefix)])
    size = np.diff(np.append(new, len(prefix)))
    many = np.repeat(size > 1, size)  # a prefix of one fingerprint meets nothing
    prefix, fp, left = prefix[many], fp[many], left[many]
    if not len(fp):
        return
    new = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
    cost = np.array([sum(len(m) for m in masks(low, f)) for f in range(int(left.max()) + 1)])[left]
    done = np.add.reduceat(cost, new)
    part = (np.cumsum(done) - done) // chunk
    edge = np.append(new[np.flatnonzero(np.append(True, np.diff(part) != 0))], len(fp))
    for i, z in zip(edge[:-1].tolist(), edge[1:].tolist()):
        p, f, r = prefix[i:z], fp[i:z], left[i:z]
        if cost[i:z].sum() > 2 * chunk and low > STEP:
            yield from meet(*spread(p, f, r, low, STEP), low - STEP, radius, chunk)
            continue
        v, f, _ = spread(p, f, r, low, low)
        order = np.lexsort((f, v))
        v, f = v[order], f[order]
        head = np.append(True, v[1:] != v[:-1])
        first = f[head][np.cumsum(head) - 1]
        pair = np.unique(np.stack([first, f], axis=1)[~head & (first != f)], axis=0)
        pair = pair[popcount(pair[:, 0] ^ pair[:, 1]) <= radius]
        if len(pair):
            yield connected(pair[:, 0], pair[:, 1])


def link_rows(radius: int, chunk: int):
    """Rows (prefix, fp) in order of prefix -> links (a, b)."""
    def links(prefix: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        left = radius // 2 - popcount((fp >> np.uint64(BITS - PREFIX)) ^ prefix)
        for a, b in meet(prefix, fp, left, BITS - PREFIX, radius, chunk):
            yield pa.RecordBatch.from_arrays([pa.array(C.as_long(a)), pa.array(C.as_long(b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            prefix, fp = (np.asarray(b.column(c)).astype(np.int64).view(np.uint64) for c in ("prefix", "fp"))
            held.append((prefix, fp))
            rows += len(prefix)
            if rows >= chunk >> 4 and prefix[0] != prefix[-1]:
                prefix, fp = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(prefix, prefix[-1]))  # the last prefix may go on in the next batch
                yield from links(prefix[:cut], fp[:cut])
                held, rows = [(prefix[cut:], fp[cut:])], len(prefix) - cut
        if held:
            yield from links(*(np.concatenate(x) for x in zip(*held)))
    return run


def ball_links(distinct: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links that connect what fingerprints (column ``fp``, distinct) at most
    ``radius`` bits apart connect."""
    if radius % 2 or not 0 < radius <= BITS - PREFIX:
        raise ValueError("radius must be even, positive and at most 48")
    flips = [int(m) for d in masks(PREFIX, radius // 2) for m in d]
    rows = distinct.select("fp", F.explode(F.lit(flips)).alias("flip")).select(
        F.shiftrightunsigned("fp", BITS - PREFIX).bitwiseXOR(F.col("flip")).alias("prefix"), "fp")
    return (rows.repartition("prefix").sortWithinPartitions("prefix")
            .mapInArrow(link_rows(radius, chunk), "a long, b long"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, fp, component_id, kept), one row per row of ``docs``; documents whose
    fingerprints differ in at most ``radius`` bits are linked, and ``component_id`` is
    the smallest doc_id that links reach.

    Texts without words, and null ones, have fingerprint 0 and are linked like
    others. Rows without doc_id take part; a component of such rows alone has a
    null ``component_id`` and keeps all of them. Repeated rows share a component and
    are all kept or not. Extra columns are ignored."""
    rows = C.stored(fingerprints(docs, size))
    distinct = C.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    comp = C.stored(components(ball_links(distinct, radius, chunk))).select(F.col("id").alias("fp"), "comp")
    one = C.stored(distinct.join(comp.hint("merge"), "fp", "left").select("fp", "low", F.coalesce("comp", "fp").alias("comp")))
    low = one.groupBy("comp").agg(F.min("low").alias("component_id"))
    whole = C.stored(one.join(low.hint("merge"), "comp").select("fp", "component_id"))
    return (rows.join(whole.hint("merge"), "fp").select(
        "doc_id", "fp", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
        .alias("kept")))
