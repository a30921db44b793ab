"""Phrase collocation mining on a weighted de Bruijn graph.

Nodes are grams of ``max_words - 1`` words, edges those of ``max_words`` words, so
neighbouring nodes overlap. Per language:

1. *Edges.* Each task counts the longest grams of its texts; a piece that ends
   earlier gives an edge to nothing (the piece-end correction). Edges are
   packed by a hash of their node into rows of sorted word numbers with their
   own word list and merged per bucket. Words travel as themselves: counts are exact.
2. *Flow.* A node occurs as often as its edges leave it, piece ends included;
   the count of a shorter gram is the flow of the nodes that it begins, summed by Spark.
3. *Compaction.* A node that passes all it gets from one edge to another one is
   inside a unary path. Paths are closed by pointer doubling over joins, and
   nodes inside them take the count of their path.
4. *Scores.* Every cut of a candidate looks its two parts up by equi-joins.

A node with more than ``HOT`` edges in one slice is split: its edges go to
buckets of their own, its flow to the node's, and the parts of its edges are
summed by Spark. So neither a frequent node nor a frequent word fills a bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

MAX_WORDS, MIN_COUNT = 3, 10
#: A shorter phrase goes if a longer one has this share of its count, percent.
CONTAINED = 50
TOP = 2000
NO_LANG = "und"
#: Words that a slice of a task counts at a time, and characters of text per bucket.
SLICE_WORDS, BUCKET_CHARS = 2_000_000, 16_000_000
#: Edges of one node in one slice, beyond which they leave the node's bucket.
HOT = 4096

_END = b"\xff"  # never in UTF-8
_TABLE = bytearray(range(256))
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _TABLE[_c] = _c + 32
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_c] = 0xFF
_TABLE[9] = 0x20
_TABLE = bytes(_TABLE)

PACKED = "lang string, bucket int, size long, blob binary"
COUNTED = "lang string, k int, phrase string, n long, whole boolean, part boolean"


def distinct(cols: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of ``cols`` in order, and the sums of ``n``."""
    if not len(n):
        return cols, n
    key = cols[0].astype(np.int64)
    for c in cols[1:]:
        top = int(c.max()) + 1
        if (int(key.max()) + 1) * top >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * top + c
    order = np.argsort(key, kind="stable")
    new = starts(key[order])
    return [c[order[new]] for c in cols], np.add.reduceat(n[order], new)


def starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])


def node_starts(cols: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal rows start."""
    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def edges_of(texts: list[bytes], m: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Words, and the distinct edges as word numbers from 1 (0: the piece has ended)
    with their counts."""
    data = _END.join(texts).translate(_TABLE)
    tokens = data.replace(_END, b" \xff ").split()
    code, words = pd.factorize(np.array([_END, *tokens], dtype=object))
    code = np.append(code[1:], np.zeros(m, np.int64))  # the separator is number 0
    cols = [code[: len(tokens)]]
    for j in range(1, m):
        cols.append(np.where(cols[-1] == 0, 0, code[j: j + len(tokens)]))
    some = cols[0] > 0
    cols = [c[some] for c in cols]
    cols, n = distinct(cols, np.ones(len(cols[0]), np.int64))
    return words, cols, n


def planes(x: np.ndarray) -> bytes:
    """Bytes of 32-bit numbers, by place, which compresses well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(4, n).T.copy().view("<u4").reshape(-1).astype(np.int64)


def packed(words: np.ndarray, cols: list[np.ndarray], n: np.ndarray, flag: np.ndarray) -> tuple[int, bytes]:
    used = np.unique(np.concatenate([[0], *cols]))
    text = b" ".join(words[used[1:]])
    raw = b"".join([np.array([len(n), len(text)], "<u4").tobytes(), text,
                    *(planes(np.searchsorted(used, c)) for c in cols), planes(n), flag.astype(np.uint8).tobytes()])
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(size: int, blob: bytes, m: int) -> tuple[list[bytes], list[np.ndarray], np.ndarray, np.ndarray]:
    raw = pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True)
    rows, text = np.frombuffer(raw, "<u4", 2).tolist()
    at = 8 + text
    cols = [unplanes(raw[at + 4 * rows * i: at + 4 * rows * (i + 1)], rows) for i in range(m + 1)]
    return raw[8:at].split(b" ") if text else [], cols[:m], cols[m], np.frombuffer(raw, np.uint8, rows, at + 4 * rows * (m + 1))


def slice_rows(lang: str, texts: list[bytes], m: int, buckets: int, hot: int) -> Iterator[tuple]:
    """(lang, bucket, size, blob) of a slice. Flags: 0 an edge, 1 an edge of a split
    node, 2 the flow of a split node."""
    words, cols, n = edges_of(texts, m)
    if not len(n):
        return
    check = np.array([zlib.crc32(w) for w in words], np.uint64)
    hashed = np.zeros(len(n), np.uint64)
    for c in cols[:-1]:
        hashed = C.mix64(hashed * np.uint64(0x9E3779B97F4A7C15) + check[c])
    new = node_starts(cols[:-1])
    count = np.diff(np.append(new, len(n)))
    split = np.repeat(count > hot, count)
    bucket = np.where(split, C.mix64(hashed * np.uint64(0x9E3779B97F4A7C15) + check[cols[-1]]), hashed) % np.uint64(buckets)
    flag = split.astype(np.int64)
    keep = ~(split & (cols[-1] == 0))  # the flow of a split node tells its piece ends
    big = new[count > hot]
    flow = np.add.reduceat(n, new)[count > hot]
    cols = [np.append(c[keep], c[big]) for c in cols[:-1]] + [np.append(cols[-1][keep], np.zeros(len(big), np.int64))]
    n, flag = np.append(n[keep], flow), np.append(flag[keep], np.full(len(big), 2))
    bucket = np.append(bucket[keep], hashed[big] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = starts(bucket[order])
    for a, z in zip(cut.tolist(), np.append(cut[1:], len(order)).tolist()):
        one = order[a:z]
        yield lang, int(bucket[one[0]]), *packed(words, [c[one] for c in cols], n[one], flag[one])


def edge_rows(m: int, buckets: int, hot: int, slice_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            rows = list(slice_rows(lang, held.pop(lang), m, buckets, hot))
            size.pop(lang)
            if rows:
                cols = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    cols, (pa.string(), pa.int32(), pa.int64(), pa.binary()))], ["lang", "bucket", "size", "blob"])

        for b in batches:
            for lang, text in zip(b.column("lang"), b.column("text")):
                lang, text = lang.as_py(), (text.as_py() or "").encode("utf-8", "surrogatepass")
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] > 6 * slice_words:
                    yield from flush(lang)
            while sum(size.values()) > 6 * slice_words:  # of many languages the largest go first
                yield from flush(max(size, key=size.get))
        for lang in list(held):
            yield from flush(lang)
    return run


def merged(m: int, least: int):
    """Rows of one (lang, bucket) -> counts: nodes and edges with at least ``least``,
    shorter grams and edges of split nodes in parts."""

    def run(table: pa.Table) -> pa.Table:
        lists, cols, n, flag = [], [[] for _ in range(m)], [], []
        for size, blob in zip(table.column("size").to_pylist(), table.column("blob").to_pylist()):
            w, c, k, f = unpacked(size, blob, m)
            shift = sum(map(len, lists))
            for have, x in zip(cols, c):
                have.append(np.where(x == 0, 0, x + shift))
            lists.append(w)
            n.append(k)
            flag.append(f)
        code, words = pd.factorize(np.array([_END, *(x for w in lists for x in w)], dtype=object))
        cols = [code[np.concatenate(c)] for c in cols]
        n, flag = np.concatenate(n), np.concatenate(flag)
        out: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def emit(c: list[np.ndarray], count: np.ndarray, whole=False, part=False) -> None:
            out.append((len(c), phrases(words, c), count, np.full(len(count), whole), np.full(len(count), part)))

        own = flag != 1
        edge, count = distinct([c[own] for c in cols] + [flag[own].astype(np.int64)], n[own])
        split = edge.pop() == 2
        if len(count):
            new = node_starts(edge[:-1])
            size = np.diff(np.append(new, len(count)))
            flow = np.add.reduceat(count, new)
            halved = np.repeat(np.add.reduceat(split.astype(np.int64), new) > 0, size)
            full = edge[-1] > 0
            whole = np.repeat(size == 1, size) & full & ~halved
            inside = edge[m - 2][new] > 0
            # a node all of whose flow is one edge is told by that edge
            some = inside & (flow >= least) & ~whole[new]
            emit([c[new[some]] for c in edge[:-1]], flow[some])
            for is_whole in (False, True):
                pick = full & ~halved & (count >= least) & (whole == is_whole)
                emit([c[pick] for c in edge], count[pick], whole=is_whole)
            pick = full & halved
            emit([c[pick] for c in edge], count[pick], part=True)
            for k in range(1, m - 1):
                ok = edge[k - 1][new] > 0
                c, f = distinct([c[new[ok]] for c in edge[:k]], flow[ok])
                emit(c, f, part=True)
        far, count = distinct([c[~own] for c in cols], n[~own])
        if len(count):
            emit(far, count, part=True)
        k = np.concatenate([np.full(len(x[2]), x[0], np.int32) for x in out] or [np.zeros(0, np.int32)])
        text, count, whole, part = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, object) for i in range(1, 5))
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(k), pa.string()), "k": pa.array(k, pa.int32()),
                         "phrase": pa.array(text, pa.binary()).cast(pa.string()), "n": pa.array(count, pa.int64()),
                         "whole": pa.array(whole, pa.bool_()), "part": pa.array(part, pa.bool_())})
    return run


def phrases(words: np.ndarray, cols: list[np.ndarray]) -> np.ndarray:
    """Words joined by one space, as an array of bytes objects."""
    out = np.empty(len(cols[0]), object)
    out[:] = [b" ".join(x) for x in zip(*(words[c] for c in cols))]
    return out


def graph(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, hot: int = HOT,
          bucket_chars: int = BUCKET_CHARS, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(lang, k, phrase, n, whole): edges (``k = max_words``) and nodes with at least
    ``min_count`` occurrences, and all shorter grams. A node whose whole flow is one
    edge has no row of its own: that edge is marked ``whole``."""
    if max_words < 3:
        raise ValueError("max_words must be at least 3")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("string").alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(16, -(-int(chars) // bucket_chars))
    counted = C.stored(rows.mapInArrow(edge_rows(max_words, buckets, hot, slice_words), PACKED)
                       .groupBy("lang", "bucket").applyInArrow(merged(max_words, min_count), COUNTED))
    parts = (counted.filter("part").groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
             .filter((F.col("k") < max_words - 1) | (F.col("n") >= min_count)))
    return C.stored(counted.filter("NOT part").select("lang", "k", "phrase", "n", "whole")
                    .unionByName(parts.withColumn("whole", F.lit(False))))


def unary_paths(counted: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """(lang, phrase, n, edges, whole): maximal unary paths of the graph's edges, a path
    of one edge where none is longer; ``whole``: the first node's flow is the path's, too.

    Pointer doubling: in round i an edge knows the edge up to 2**i before it."""
    edges = counted.filter(F.col("k") == max_words).select("lang", "phrase", "n", "whole")
    tail = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    node = F.expr(f"substring_index(phrase, ' ', {max_words - 1})")
    after = edges.filter("whole").select("lang", node.alias("at"), F.col("phrase").alias("next"), F.col("n").alias("m"))
    links = C.stored(edges.select("lang", tail.alias("at"), "phrase", "n").join(after.hint("merge"), ["lang", "at"])
                     .filter("n = m AND phrase <> next").select("lang", F.col("phrase").alias("up"), F.col("next").alias("phrase")))
    state = C.stored(links.select("lang", "phrase", "up", F.lit(1).cast("long").alias("d")))
    while True:
        higher = state.select("lang", F.col("phrase").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"))
        new = C.stored(state.join(higher.hint("merge"), ["lang", "up"], "left").select(
            "lang", "phrase", F.coalesce("up2", "up").alias("up"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"),
            F.col("d2").isNotNull().alias("moved")))
        state = new.select("lang", "phrase", "up", "d")
        if new.filter("moved").isEmpty():
            break
    placed = edges.join(state.hint("merge"), ["lang", "phrase"], "left").select(
        "lang", "phrase", "n", "whole", F.coalesce("up", "phrase").alias("head"), F.coalesce("d", F.lit(0)).alias("d"))
    word = F.expr("IF(d = 0, phrase, substring_index(phrase, ' ', -1))")
    return (placed.groupBy("lang", "head").agg(
        F.sort_array(F.collect_list(F.struct("d", word.alias("w")))).alias("s"), F.first("n").alias("n"),
        F.bool_or(F.expr("d = 0 AND whole")).alias("whole"))
        .select("lang", F.array_join(F.transform("s", lambda x: x["w"]), " ").alias("phrase"), "n",
                F.size("s").alias("edges"), "whole"))


def counts(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, **kw) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, a) of all grams of up to ``max_words`` words with at least
    ``min_count`` occurrences, and (lang, n) with the words of each language."""
    g = graph(docs, max_words, min_count, **kw)
    paths = C.stored(unary_paths(g, max_words))
    words = F.split("phrase", " ")
    grams = paths.select("lang", "n", "whole", words.alias("w"))
    m = max_words
    edge = grams.select("lang", F.explode(F.expr(
        f"transform(sequence(1, size(w) - {m - 1}), i -> array_join(slice(w, i, {m}), ' '))")).alias("phrase"), F.col("n").alias("a"))
    # nodes inside a path, and the first one where the path is all of its flow
    node = grams.select("lang", F.explode(F.expr(
        f"transform(filter(sequence(1, size(w) - {m - 1}), i -> i > 1 OR whole), i -> array_join(slice(w, i, {m - 1}), ' '))"))
        .alias("phrase"), F.col("n").alias("a"))
    rest = g.filter((F.col("k") < m) & (F.col("n") >= min_count)).selectExpr("lang", "k", "phrase", "n AS a")
    every = (edge.select("lang", F.lit(m).alias("k"), "phrase", "a")
             .unionByName(node.select("lang", F.lit(m - 1).alias("k"), "phrase", "a")).unionByName(rest))
    return C.stored(every), g.filter("k = 1").groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, contained: int = CONTAINED,
                 top: int = TOP, **kw) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    Texts are lower-cased (A-Z) and split at ``.,;:!?`` and line ends into pieces,
    those at blanks and tabs into words. ``a``: occurrences of a phrase of 2 to
    ``max_words`` words, at least ``min_count``; ``l`` and ``r``: of its two parts at the cut with
    the least score ``a * a / (l * r)`` (in millionths, rounded down; ties: first cut); ``n``: words
    of the language. A phrase inside a longer one that has at least ``contained``
    percent of its occurrences is left out. Order: score, ``a``, then the phrase.

    Rows without lang count as ``und``; null and empty texts have no words; repeated
    rows count each. Extra columns are ignored; an empty table gives no rows."""
    known, total = counts(docs, max_words, min_count, **kw)
    cand = known.filter("k > 1")
    part = known.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    cuts = cand.select("lang", "phrase", "a", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', cut)"))
    cuts = cuts.withColumn("rest", F.expr("substring_index(phrase, ' ', cut - k)"))
    left = part.select("lang", F.col("part").alias("first"), F.col("f").alias("l"))
    right = part.select("lang", F.col("part").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(left.hint("merge"), ["lang", "first"]).join(right.hint("merge"), ["lang", "rest"])
    big = "cast({} AS decimal(15, 0))"
    a, l, r = (big.format(c) for c in "alr")
    scored = scored.withColumn("score", F.expr(f"cast(1000000 * {a} * {a} AS decimal(38, 0)) div ({l} * {r})"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s"))
    inner = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), "
                   "i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    longer = (cand.filter("k > 2").select("lang", F.explode(inner).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("most")))
    kept = (best.join(longer.hint("merge"), ["lang", "phrase"], "left")
            .filter(F.coalesce(100 * F.col("most") < contained * F.col("a"), F.lit(True))))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = (kept.select("lang", "phrase", "a", F.col("s.l").alias("l"), F.col("s.r").alias("r"), F.col("s.score").alias("score"))
              .withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
