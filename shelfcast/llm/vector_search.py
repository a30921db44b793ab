"""Approximate nearest neighbours by cosine: a hierarchical k-means tree with
best-bin-first search.

* The tree is fitted on a bounded sample of unit vectors (``SAMPLE``); every
  row of the table is indexed, at the leaf its greedy descent ends in.
* A query walks the tree with a priority queue: the closest open node is
  opened next, leaves come out best bin first. How many leaves to visit is
  calibrated: for ``CALIBRATE`` queries all rows are searched by brute force,
  and visits widen until the leaves visited hold ``RECALL`` of the true
  neighbours. A query goes on past that until its leaves hold ``k`` rows
  besides its own, so it finds fewer only if there are fewer.
* Rows and query visits meet in blocks. A leaf with many rows is salted into
  blocks of about ``ROWS``, one with many queries into blocks of about
  ``QUERIES``, so no task holds a hot leaf whole. Every block returns its best
  ``k`` per query, and the best of those are the result.

Scores are sums in a fixed order in double precision, so equal vectors tie
exactly wherever they are computed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SAMPLE, BRANCH, LEAF, SEED = 20_000, 8, 96, 3
CALIBRATE, RECALL = 256, 0.97
ROWS, QUERIES = 4096, 1024


class Tree:
    """Nodes as arrays: ``kids[i]`` are the children of node i (none: a leaf)."""

    def __init__(self, x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.centre, self.kids = [x.mean(axis=0)], [[]]
        todo = [(0, x)]
        while todo:
            node, pts = todo.pop()
            if len(pts) <= leaf:
                continue
            centre = pts[rng.choice(len(pts), branch, replace=False)].astype(float)
            for _ in range(12):
                near = (pts @ centre.T * 2 - (centre**2).sum(axis=1)).argmax(axis=1)
                total = np.zeros_like(centre)
                np.add.at(total, near, pts)
                n = np.bincount(near, minlength=branch)
                centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
            used = [j for j in range(branch) if (near == j).any()]
            if len(used) < 2:  # equal points
                continue
            for j in used:
                self.kids[node].append(len(self.kids))
                todo.append((len(self.kids), pts[near == j]))
                self.kids.append([])
                self.centre.append(centre[j])
        self.centre = np.array(self.centre)
        self.leaves = [i for i, k in enumerate(self.kids) if not k]

    def descend(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        at = np.zeros(len(x), np.int64)
        while True:
            moved = False
            for node in np.unique(at):
                if self.kids[node]:
                    rows = np.flatnonzero(at == node)
                    c = self.centre[self.kids[node]]
                    best = (x[rows] @ c.T * 2 - (c**2).sum(axis=1)).argmax(axis=1)
                    at[rows] = np.array(self.kids[node])[best]
                    moved = True
            if not moved:
                return at

    def walk(self, q: np.ndarray, visits: int, held: np.ndarray | None = None, need: int = 0) -> list[int]:
        """The first ``visits`` leaves for one query, best bin first, and more
        until they hold ``need`` rows (node i holds ``held[i]``)."""
        away = ((self.centre - q) ** 2).sum(axis=1)
        queue, out, got = [(0.0, 0)], [], 0
        while queue and (len(out) < visits or got < need):
            _, node = heapq.heappop(queue)
            while self.kids[node]:  # down to the nearest leaf; siblings wait
                kids = sorted(self.kids[node], key=lambda i: away[i])
                for i in kids[1:]:
                    heapq.heappush(queue, (away[i], i))
                node = kids[0]
            out.append(node)
            got += 0 if held is None else int(held[node])
        return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x**2).sum(axis=1))[:, None]


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of every pair; the sum over components runs in their order."""
    s, nq, nv = np.zeros((len(q), len(v))), np.zeros(len(q)), np.zeros(len(v))
    for d in range(q.shape[1]):
        s += q[:, d, None] * v[None, :, d]
        nq += q[:, d] ** 2
        nv += v[:, d] ** 2
    return s / (np.sqrt(nq)[:, None] * np.sqrt(nv)[None, :])


def best_of(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int, chunk: int = 64) -> pd.DataFrame:
    """The k nearest of v for each query but itself; ties to the smaller id."""
    order = np.argsort(vid, kind="stable")
    vid, v = vid[order], v[order]
    out = []
    for i in range(0, len(q), chunk):
        s = cosines(q[i:i + chunk], v)
        s[qid[i:i + chunk, None] == vid[None, :]] = -np.inf
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        out.append(pd.DataFrame({"query_id": np.repeat(qid[i:i + chunk], top.shape[1]), "vec_id": vid[top].reshape(-1),
                                 "score": np.take_along_axis(s, top, axis=1).reshape(-1)}))
    got = pd.concat(out)
    return got[np.isfinite(got.score)]


def usable(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>): rows with an id and a non-zero vector of finite components."""
    v = F.col(embedding).cast("array<double>")
    fine = (F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(v, lambda x: x != 0))
    return vectors.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _matrix(col) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=float) for x in col]) if len(col) else np.zeros((0, 1))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found rows of each query.

    Both inputs: (vec_id, embedding). Null, zero or non-finite vectors, rows
    without an id, and vectors of another length than the most frequent one
    take no part. A candidate with the query's id is the query's own row; of
    several query rows with one id the smallest vector counts, and repeated
    candidates are found once. Extra columns are ignored."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    dim = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if dim is None:
        return empty
    rows = rows.filter(F.size("v") == dim["d"])
    asked = usable(queries).filter(F.size("v") == dim["d"]).groupBy("vec_id").agg(F.min("v").alias("v"))
    some = rows.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(sample).select("v").toPandas()
    tree = Tree(unit(_matrix(some.v)))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["leaf"] = tree.descend(unit(_matrix(b.v)))
            else:
                b["leaf"] = np.zeros(0, np.int64)
            yield b[["vec_id", "v", "leaf"]]

    indexed = C.stored(rows.mapInPandas(index, "vec_id long, v array<double>, leaf long"))
    # of repeated rows one counts, at one leaf
    leaf = C.stored(indexed.groupBy("vec_id").agg(F.min("leaf").alias("leaf")))
    visits = calibrated(tree, indexed, leaf, asked, k, recall)
    held = np.zeros(len(tree.centre), np.int64)
    for r in leaf.groupBy("leaf").count().collect():  # at most the leaves of the tree
        held[r["leaf"]] = r["count"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["leaf"] = [tree.walk(q, visits, held, k + 1) for q in unit(_matrix(b.v))] if len(b) else []
            yield b.explode("leaf").astype({"leaf": "int64"})[["vec_id", "v", "leaf"]]

    ways = C.stored(asked.mapInPandas(walk, "vec_id long, v array<double>, leaf long"))
    # one row per leaf of the tree, whose size is bounded by the sample's
    n_rows = indexed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / ROWS).alias("row_blocks"))
    n_asks = ways.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("ask_blocks"))
    blocks = C.stored(n_rows.join(n_asks, "leaf"))
    salt = F.xxhash64("vec_id")
    both = F.broadcast(blocks)
    data = (indexed.join(both, "leaf").withColumn("i", F.pmod(salt, "row_blocks"))
            .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ask_blocks") - 1))))
    asks = (ways.join(both, "leaf").withColumn("j", F.pmod(salt, "ask_blocks"))
            .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("row_blocks") - 1))))

    def meet(data: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(asks):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return best_of(asks.vec_id.to_numpy(), _matrix(asks.v), data.vec_id.to_numpy(), _matrix(data.v), k)

    keys = ["leaf", "i", "j"]
    found = (data.select(*keys, "vec_id", "v").groupBy(*keys)
             .cogroup(asks.select(*keys, "vec_id", "v").groupBy(*keys))
             .applyInPandas(meet, "query_id long, vec_id long, score double"))
    return ranked(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def exact(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score[, leaf]) by brute force for a bounded
    number of queries, which go to all tasks."""
    got = queries.toPandas()
    qid, q = got.vec_id.to_numpy(), _matrix(got.v)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 2048):
                part = b.iloc[i:i + 2048]
                yield best_of(qid, q, part.vec_id.to_numpy(), _matrix(part.v), k)

    if not len(got):
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = rows.select("vec_id", "v").mapInPandas(scan, "query_id long, vec_id long, score double")
    return ranked(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)


def calibrated(tree: Tree, indexed: DataFrame, leaf: DataFrame, asked: DataFrame, k: int, recall: float) -> int:
    """Leaves to visit so that a sample of queries finds ``recall`` of its true neighbours."""
    few = asked.orderBy(F.xxhash64("vec_id", F.lit(SEED + 1)), "vec_id").limit(CALIBRATE)
    true = exact(indexed, few, k).select("query_id", "vec_id")
    true = F.broadcast(true)  # at most CALIBRATE * k rows
    pairs = leaf.join(true, "vec_id").select("query_id", "leaf").toPandas()
    if not len(pairs):
        return len(tree.leaves)
    vec = few.toPandas().set_index("vec_id").v
    depth = []
    for qid, part in pairs.groupby("query_id"):
        way = {leaf: i + 1 for i, leaf in enumerate(tree.walk(unit(_matrix([vec[qid]]))[0], len(tree.leaves)))}
        depth += [way[x] for x in part.leaf]
    return int(np.sort(depth)[max(0, int(np.ceil(recall * len(depth))) - 1)])
