"""Near-duplicate groups by MinHash with tensored banding.

``halves`` small hash collections of ``rows`` min-hashes each are computed per
distinct shingle set; the key of a table combines *two* of them, so
``halves * (halves - 1) / 2`` tables (66) need only ``halves * rows``
min-hashes (24). With 12 halves of 2 rows a pair of Jaccard 0.85 shares no
table with probability 7e-6.

Links are confirmed on full shingle sets. A pair need not be examined when
both documents are already in one component, so groups are closed in rounds:

* stars: in each bucket, all members against ``PIVOTS`` of them (those first in
  as many hash orders, so buckets that share members share pivots);
* then the members of buckets that still hold several components, by an exact
  prefix filter: a linked pair shares one of the ``100 - LINK`` percent rarest
  shingles of each set. For each such shingle, the members outside its largest
  component meet all members of other ones. Texts that share a template and
  nothing else do not meet there.

No bucket, partner or candidate is capped. Two exact bounds drop pairs before
their sets are fetched: set sizes, and a parity bitmap of the set (at least as
many elements differ as bits differ). The second step checks them inside the
join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .components import components

SHINGLE = 5
HALVES, ROWS = 12, 2
BITS = 1024
PIVOTS = 8
LINK = 85  # percent
#: Rows without a doc_id get one from their text, in this range.
NO_ID = 1 << 62
_SEEDS = np.random.default_rng(20240611).integers(1, 2**63, 2 * HALVES * ROWS, dtype=np.uint64)


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and the bounds of each text."""
    w = C.Words(texts, lower=True)
    h = w.keys()
    out, bound = [], [0]
    n = np.diff(w.first)
    if len(h) >= size:
        at = np.arange(len(h) - size + 1)
        every = C.seq_hashes(h, at, at + size)
    short = np.flatnonzero((n > 0) & (n < size))
    few = C.seq_hashes(h, w.first[short], w.first[short + 1])
    few = dict(zip(short.tolist(), few))
    for r in range(len(texts)):
        if n[r] >= size:
            out.append(np.unique(every[w.first[r]: w.first[r + 1] - size + 1]))
        elif n[r]:
            out.append(np.array([few[r]], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        bound.append(bound[-1] + len(out[-1]))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array(bound)


def signature_rows(size: int, halves: int, rows: int, seeds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in C.slices(b.column("text")):
                s, bound = shingle_sets(texts, size)
                n = np.diff(bound)
                full = np.flatnonzero(n)
                m = len(texts)
                s1, s2 = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
                half = np.zeros((m, halves), np.uint64)
                bits = np.zeros((m, BITS), np.uint8)
                if len(full):
                    start = bound[full]
                    s1[full] = np.add.reduceat(C.mix64(s), start)
                    s2[full] = np.add.reduceat(C.mix64(s ^ np.uint64(0x2545F4914F6CDD1D)), start)
                    for i in range(halves):
                        key = np.full(len(full), i + 1, np.uint64)
                        for j in range(rows):
                            k = 2 * (i * rows + j)
                            low = np.minimum.reduceat((s ^ seeds[k]) * (seeds[k + 1] | np.uint64(1)), start)
                            key = C.mix64(key * np.uint64(0x9E3779B97F4A7C15) + low)
                        half[full, i] = key
                    row = np.repeat(np.arange(m), n)
                    cell = np.bincount(row * BITS + (s >> np.uint64(54)).astype(np.int64), minlength=m * BITS)
                    bits = (cell & 1).astype(np.uint8).reshape(m, BITS)
                packed = np.packbits(bits, axis=1).reshape(-1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(at, m), b.column("lost").slice(at, m), pa.array(n.astype(np.int64)),
                     pa.array(C.as_long(s1)),
                     pa.array(C.as_long(s2)),
                     pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * halves),
                                              pa.array(C.as_long(half.reshape(-1)))),
                     pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * (BITS // 64)),
                                              pa.array(packed))],
                    ["id", "lost", "n", "s1", "s2", "halves", "bits"])
    return run


def set_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in C.slices(b.column("text")):
                s, bound = shingle_sets(texts, size)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(at, len(texts)),
                     pa.array([s[x:y].tobytes() for x, y in zip(bound[:-1], bound[1:])], pa.binary())], ["id", "set"])
    return run


def shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, cell in zip(b.column("id"), b.column("set")):
            s = np.frombuffer(cell.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i.as_py(), np.int64)), pa.array(s)], ["rep", "key"])


def rarest(sets: DataFrame, members: DataFrame, link: int) -> DataFrame:
    """(rep, key): of each member's shingles as many of the rarest (ties: by hash) as
    a linked set must share one of: all but ``link`` percent, and one more."""
    every = C.stored(sets.join(members.select(F.col("rep").alias("id")).hint("merge"), "id", "left_semi")
                     .mapInArrow(shingle_rows, "rep long, key long"))
    often = C.stored(every.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    known = every.join(often.hint("merge"), "key", "left").groupBy("rep").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "key"))).alias("s"))
    first = F.expr(f"slice(s, 1, size(s) - cast(ceil(size(s) * {link} / 100.0) AS int) + 1)")
    return known.select("rep", F.explode(first).alias("x")).filter("x.c > 1").select("rep", "x.key")


def may_link(link: int, a: str, b: str) -> str:
    """SQL condition that every linked pair meets: the sizes allow it, and not
    too many bits of the two parity bitmaps differ.
    J >= link/100  <=>  |A xor B| <= (|A| + |B|) * (100 - link) / (100 + link)."""
    bits = " + ".join(f"bit_count({a}.bits[{i}] ^ {b}.bits[{i}])" for i in range(BITS // 64))
    return (f"100 * least({a}.n, {b}.n) >= {link} * greatest({a}.n, {b}.n) "
            f"AND ({bits}) * {100 + link} <= ({a}.n + {b}.n) * {100 - link}")


def confirmed(link: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_a"), b.column("set_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= link * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def row_id() -> Column:
    """doc_id, or where that is null a number made from the text."""
    from_text = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID))
    return F.coalesce(F.col("doc_id").cast("long"), from_text)


def near_duplicates(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``;
    for the parameters see :func:`groups`.

    Empty and null texts have no shingles and no links. Rows of one doc_id
    are one document. Rows with null doc_id are documents of their own (equal
    texts: one); a component of such rows alone has a null component_id.
    Repeated rows share a component. Extra columns are ignored.
    """
    return groups(docs, **kw).drop("id")


def groups(docs: DataFrame, link: int = LINK, shingle: int = SHINGLE, halves: int = HALVES,
           rows: int = ROWS) -> DataFrame:
    """:func:`near_duplicates` with the ``id`` that stands for each row."""
    base = docs.select(row_id().alias("id"), F.col("doc_id").isNull().alias("lost"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sig = C.stored(base.mapInArrow(
        signature_rows(shingle, halves, rows, _SEEDS[: 2 * halves * rows]),
        "id long, lost boolean, n long, s1 long, s2 long, halves array<long>, bits array<long>"))
    # one representative per distinct set: its smallest id
    reps = C.stored(sig.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct("id", "lost")).alias("r"))
                    .select("s1", "s2", "n", F.col("r.id").alias("rep"), F.col("r.lost").alias("lost")))
    lost = reps.filter("lost").select(F.col("rep").alias("c"), "lost").distinct()
    reps = reps.drop("lost")
    one = sig.select(F.col("id").alias("rep"), "s1", "s2", "n", "halves", "bits")
    one = C.stored(one.join(reps.hint("merge"), ["rep", "s1", "s2", "n"], "left_semi")
                   .dropDuplicates(["rep", "s1", "s2", "n"]))

    half = one.select("rep", F.explode("halves").alias("half"))
    shared = C.stored(half.groupBy("half").count().filter("count > 1").select("half"))
    mine = C.stored(half.join(shared.hint("merge"), "half").groupBy("rep")
                    .agg(F.sort_array(F.collect_set("half")).alias("h")).filter("size(h) > 1"))
    # the tables: every pair of shared halves
    pairs = F.expr("flatten(transform(sequence(0, size(h) - 2), i -> transform(sequence(i + 1, size(h) - 1), "
                   "j -> xxhash64(h[i], h[j]))))")
    tables = mine.select("rep", F.explode(pairs).alias("key"))
    pivots = [F.min(F.struct(F.xxhash64("rep", F.lit(i)), "rep"))["rep"] for i in range(PIVOTS)]
    stars = C.stored(tables.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.array_distinct(F.array(*pivots)).alias("p"))
                     .filter("c > 1").select("key", "p"))
    buckets = C.stored(tables.join(stars.hint("merge"), "key"))

    wanted = C.stored(buckets.select(F.col("rep").alias("id")).distinct())
    sets = C.stored(base.join(wanted.hint("merge"), "id", "left_semi").mapInArrow(
        set_rows(shingle), "id long, set binary"))
    about = C.stored(one.join(wanted.withColumnRenamed("id", "rep").hint("merge"), "rep", "left_semi")
                     .select("rep", "n", "bits"))

    def confirmed_links(cand: DataFrame) -> DataFrame:
        """Of distinct pairs a < b, those that link on their full sets."""
        u = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
        v = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
        return C.stored(cand.join(u.hint("merge"), "a").join(v.hint("merge"), "b")
                        .mapInArrow(confirmed(link), "a long, b long"))

    star = buckets.select("rep", F.explode("p").alias("q")).filter("rep <> q")
    star = star.select(F.least("rep", "q").alias("a"), F.greatest("rep", "q").alias("b")).distinct()
    x, y = (about.select(F.col("rep").alias(c), F.struct("n", "bits").alias(f"x_{c}")) for c in "ab")
    tested = C.stored(star.join(x.hint("merge"), "a").join(y.hint("merge"), "b")
                      .filter(may_link(link, "x_a", "x_b")).select("a", "b"))
    links = confirmed_links(tested)
    comp = C.stored(components(links)).withColumnRenamed("id", "rep")
    state = C.stored(buckets.select("key", "rep").join(comp.hint("merge"), "rep", "left")
                     .selectExpr("key", "rep", "coalesce(comp, rep) AS comp"))
    size = state.groupBy("key", "comp").count()
    mixed = size.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("key")
    members = C.stored(state.join(mixed.hint("merge"), "key", "left_semi").select("rep", "comp").distinct())
    state = C.stored(rarest(sets, members, link).join(members.hint("merge"), "rep").select("key", "rep", "comp"))
    size = state.groupBy("key", "comp").count()
    mixed = C.stored(size.groupBy("key").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"),
                                             F.count(F.lit(1)).alias("k")).filter("k > 1").select("key", "main"))
    state = C.stored(state.join(mixed.hint("merge"), "key").join(about.hint("merge"), "rep"))
    m = state.alias("m")
    o = state.alias("o")
    cand = m.filter("comp <> main").join(
        o.hint("merge"), F.expr(f"m.key = o.key AND m.comp <> o.comp AND {may_link(link, 'm', 'o')}"))
    cand = cand.select(F.expr("least(m.rep, o.rep)").alias("a"), F.expr("greatest(m.rep, o.rep)").alias("b")).distinct()
    cand = C.stored(cand.join(tested.hint("merge"), ["a", "b"], "left_anti"))
    if not cand.isEmpty():
        links = confirmed_links(cand).unionAll(comp.filter("rep <> comp").selectExpr("rep AS a", "comp AS b"))
        comp = C.stored(components(links)).withColumnRenamed("id", "rep")
    whole = C.stored(reps.join(comp.hint("merge"), "rep", "left")
                     .select("s1", "s2", "n", F.coalesce("comp", "rep").alias("c"))
                     .join(lost.hint("merge"), "c", "left").withColumnRenamed("lost", "c_lost"))
    out = sig.select("id", "lost", "n", "s1", "s2").join(whole.hint("merge"), ["s1", "s2", "n"], "left")
    comp_id = F.coalesce("c", "id")
    no_comp = F.coalesce("c_lost", F.col("c").isNull() & F.col("lost"))
    return out.select("id", F.when(~F.col("lost"), F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"),
                      F.when(~no_comp, comp_id).alias("component_id"), (F.col("id") == comp_id).alias("kept"))


def deduplicated(docs: DataFrame, **kw) -> DataFrame:
    """Rows of ``docs``, all columns: one document of each group of near
    duplicates (its smallest doc_id), and of rows with the same doc_id and text one,
    the same one on every run."""
    kept = groups(docs, **kw).filter("kept").select("id").distinct()
    one = Window.partitionBy("id", "th").orderBy(C.in_order(docs))
    rows = C.row_of(docs, row_id().alias("id"), C.text_hash().alias("th")).join(kept.hint("merge"), "id", "left_semi")
    return C.back_from(rows.withColumn("n", F.row_number().over(one)).filter("n = 1"), docs)
