"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Inputs of a token are a word embedding (hashed, lower-cased word), the mean of
embeddings of its byte trigrams, and the strongest evidence among its longer
byte n-grams (log odds beyond their standard error in the training sample). A forward and a backward GRU run over
windows of ``LENGTH`` words that start every ``STRIDE`` words and cover the
whole text; attention pools a window's states, a logistic unit scores it, and
a document's score is its most toxic window's, calibrated.

The network is trained in numpy on a bounded sample of labelled rows outside
the held-out fold (``SAMPLE``; the only bound here). Labels are of documents,
so training alternates between choosing each document's strongest window and
fitting on it. Scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Labelled rows that training may use, in the order of a hash of doc_id.
SAMPLE = 5000
LENGTH, STRIDE = 24, 12
WORDS, GRAMS = 1 << 15, 1 << 12
LONG, EVIDENCE = (5, 7), 1 << 18
DW, DC, H = 6, 6, 8
DX = DW + DC + 1
ROUNDS, EPOCHS, BATCH, RATE = 3, 4, 128, 0.05
#: Documents that a word must be in to be learned, standard errors that its
#: first log odds must exceed, and one in so many sampled documents calibrates.
FEW, SURE, CALIBRATE = 4, 2.5, 5
CHUNK = 20_000  # distinct words or windows of one vectorised step
SEED = 9


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+size[0]-1, start[1] .. and so on."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def _grams(letters: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of some words, each between two blanks: its trigram and
    the longer n-grams that start a byte before it."""
    off = np.append(0, np.cumsum(size))
    pos = _ranges(off[:-1] + 2 * np.arange(len(size)) + 1, size)
    data = np.full(off[-1] + 2 * len(size) + 1, 32, np.uint64)
    data[pos] = letters
    gram = (data[pos - 1] * np.uint64(65536) + data[pos] * np.uint64(256) + data[pos + 1]) + np.uint64(1)
    gram = (C.mix64(gram * C._MUL) % np.uint64(GRAMS)).astype(np.int32)
    data = data + np.uint64(1)
    stop = np.repeat(off[1:] + 2 * np.arange(len(size)) + 2, size)
    longer = np.stack([(C.span_hashes(data, C._SEQ_BASES[0], pos - 1, np.minimum(pos - 1 + n, stop)) % np.uint64(EVIDENCE))
                       .astype(np.int32) for n in LONG])
    return gram, longer


class Tokens:
    """Word ids of texts, trigram lists of the distinct words, and windows."""

    def __init__(self, texts: list[bytes]):
        hashes, firsts, uniq, sizes, letters = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], [], [], []
        for piece in C.pieces(texts):  # the words' bytes are only kept once
            w = C.Words(piece, lower=True)
            h = w.hashes()
            firsts.append(w.first[1:] + firsts[-1][-1])
            hashes.append(h)
            u, at = np.unique(h, return_index=True)
            size = w.end[at] - w.start[at]
            uniq.append(u), sizes.append(size), letters.append(C._LOWER[w.data[_ranges(w.start[at], size)]])
        first, words = np.concatenate(firsts), np.concatenate(hashes)
        uniq, sizes, letters = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (uniq, sizes, letters))
        starts = np.cumsum(sizes) - sizes
        self.uniq, at = np.unique(uniq, return_index=True)
        word = np.searchsorted(self.uniq, words)
        self.id = (self.uniq.astype(np.uint64) % np.uint64(WORDS)).astype(np.int64)
        self.size = size = sizes[at]
        self.off = off = np.append(0, np.cumsum(size))
        grams = [_grams(letters[_ranges(starts[at[i:i + CHUNK]], size[i:i + CHUNK])], size[i:i + CHUNK])
                 for i in range(0, max(len(size), 1), CHUNK)]
        self.gram = np.concatenate([g for g, _ in grams])
        self.longer = np.concatenate([x for _, x in grams], axis=1)
        n = np.diff(first)
        count = np.where(n > 0, np.maximum(-(-(n - LENGTH) // STRIDE), 0) + 1, 0)
        self.row = np.repeat(np.arange(len(texts)), count)
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        begin, stop = first[:-1][self.row] + k * STRIDE, first[1:][self.row]
        word = np.append(word, 0).astype(np.int32)
        self.window = np.zeros((len(begin), LENGTH), np.int32)
        for i in range(0, len(begin), CHUNK):
            idx = begin[i:i + CHUNK, None] + np.arange(LENGTH)[None, :]
            # the id len(uniq) is padding
            self.window[i:i + CHUNK] = np.where(idx >= stop[i:i + CHUNK, None], len(self.uniq),
                                                word[np.minimum(idx, len(word) - 1)])

    def inputs(self, p: dict) -> np.ndarray:
        """Input of each distinct word."""
        out = np.zeros((len(self.uniq), DX), np.float32)
        for i in range(0, len(out), CHUNK):
            j = min(i + CHUNK, len(out))
            lo, hi = self.off[i], self.off[j]
            out[i:j, :DW] = p["W"][self.id[i:j]]
            out[i:j, DW:DW + DC] = np.add.reduceat(p["C"][self.gram[lo:hi]], self.off[i:j] - lo) / self.size[i:j, None]
            out[i:j, -1] = np.maximum.reduceat(p["E"][self.longer[:, lo:hi]].max(axis=0), self.off[i:j] - lo)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def initial(rng: np.random.Generator) -> dict:
    def glorot(*shape):
        return (rng.normal(size=shape) * np.sqrt(1.0 / shape[0])).astype(np.float32)
    p = {"W": np.zeros((WORDS, DW), np.float32), "C": (rng.normal(size=(GRAMS, DC)) * 0.1).astype(np.float32),
         "E": np.zeros(EVIDENCE, np.float32), "u": glorot(2 * H), "o": glorot(2 * H), "c": np.zeros(1, np.float32)}
    for d in "fb":
        p["x" + d], p["h" + d] = glorot(DX, 3 * H), glorot(H, 3 * H)
        p["b" + d] = np.zeros(3 * H, np.float32)
    return p


def gru(p: dict, d: str, gates: np.ndarray, window: np.ndarray, keep: bool = False):
    """States (steps, windows, H); ``gates``: input gates of each id, the last row padding."""
    steps = range(LENGTH) if d == "f" else range(LENGTH - 1, -1, -1)
    h = np.zeros((len(window), H), np.float32)
    out = np.zeros((LENGTH, len(window), H), np.float32)
    saved = {}
    for t in steps:
        g = gates[window[:, t]]
        a = h @ p["h" + d]
        zr = sigmoid(g[:, : 2 * H] + a[:, : 2 * H])
        z, r = zr[:, :H], zr[:, H:]
        n = np.tanh(g[:, 2 * H:] + r * a[:, 2 * H:])
        if keep:
            saved[t] = (h, z, r, n, a[:, 2 * H:])
        h = h + z * (n - h)
        out[t] = h
    return (out, saved) if keep else out


def gate_table(p: dict, d: str, x: np.ndarray) -> np.ndarray:
    g = (x @ p["x" + d] + p["b" + d]).astype(np.float32)
    pad = np.zeros((1, 3 * H), np.float32)
    pad[:, :H] = -1e4  # padding leaves the state as it is
    return np.concatenate([g, pad])


def pooled(p: dict, hf: np.ndarray, hb: np.ndarray, real: np.ndarray):
    s = hf @ p["u"][:H] + hb @ p["u"][H:]
    s = np.where(real.T, s, -1e9)
    a = np.exp(s - s.max(axis=0))
    a /= a.sum(axis=0)
    v = np.concatenate([(a[:, :, None] * hf).sum(axis=0), (a[:, :, None] * hb).sum(axis=0)], axis=1)
    return a, v


def window_logits(p: dict, tok: Tokens, chunk: int = 8192) -> np.ndarray:
    x = tok.inputs(p)
    gf, gb = gate_table(p, "f", x), gate_table(p, "b", x)
    out = np.zeros(len(tok.window), np.float32)
    for i in range(0, len(out), chunk):
        w = tok.window[i:i + chunk]
        _, v = pooled(p, gru(p, "f", gf, w), gru(p, "b", gb, w), w < len(tok.uniq))
        out[i:i + chunk] = v @ p["o"] + p["c"]
    return out


def row_max(values: np.ndarray, row: np.ndarray, rows: int, empty: float) -> np.ndarray:
    out = np.full(rows, -np.inf)
    np.maximum.at(out, row, values)
    return np.where(np.isinf(out), empty, out)


def gradients(p: dict, tok: Tokens, windows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Gradients of the weighted log loss over some windows (back-propagation through time)."""
    w = tok.window[windows]
    ids, w = np.unique(w, return_inverse=True)
    w = w.reshape(-1, LENGTH)
    pad = len(ids) - 1 if ids[-1] == len(tok.uniq) else None
    ids = ids[ids < len(tok.uniq)]
    if pad is None:
        pad = len(ids)
    size = tok.size[ids]
    off = np.append(0, np.cumsum(size))
    chars = _ranges(tok.off[:-1][ids], size)
    gram = tok.gram[chars]
    x = np.concatenate([p["W"][tok.id[ids]], np.add.reduceat(p["C"][gram], off[:-1], axis=0) / size[:, None],
                        np.maximum.reduceat(p["E"][tok.longer[:, chars]].max(axis=0), off[:-1])[:, None]], axis=1)
    real = w < pad
    st = {d: gru(p, d, gate_table(p, d, x), w, True) for d in "fb"}
    a, v = pooled(p, st["f"][0], st["b"][0], real)
    dl = (sigmoid(v @ p["o"] + p["c"]) - y) * weight / weight.sum()
    g = {"o": v.T @ dl, "c": np.array([dl.sum()], np.float32)}
    dv = dl[:, None] * p["o"][None, :]
    both = np.concatenate([st["f"][0], st["b"][0]], axis=2)
    da = (both * dv[None]).sum(axis=2)
    ds = a * (da - (a * da).sum(axis=0))
    g["u"] = (both * ds[:, :, None]).sum(axis=(0, 1))
    dboth = a[:, :, None] * dv[None] + ds[:, :, None] * p["u"]
    dx = np.zeros_like(x)
    for d, part in (("f", slice(0, H)), ("b", slice(H, 2 * H))):
        out, saved = st[d]
        dgate = np.zeros((pad + 1, 3 * H), np.float32)
        dU = np.zeros_like(p["h" + d])
        dh = np.zeros((len(w), H), np.float32)
        for t in (range(LENGTH - 1, -1, -1) if d == "f" else range(LENGTH)):
            h, z, r, n, an = saved[t]
            dh = dh + dboth[t][:, part]
            dz = dh * (n - h) * z * (1 - z)
            dn = dh * z * (1 - n * n)
            dr = dn * an * r * (1 - r)
            pre = np.concatenate([dz, dr, dn], axis=1)
            rec = np.concatenate([dz, dr, dn * r], axis=1)
            dU += h.T @ rec
            np.add.at(dgate, w[:, t], pre)
            dh = dh * (1 - z) + rec @ p["h" + d].T
        dgate = dgate[:pad]
        g["x" + d], g["h" + d], g["b" + d] = x.T @ dgate, dU, dgate.sum(axis=0)
        dx += dgate @ p["x" + d].T
    g["W"] = (tok.id[ids], dx[:, :DW])
    g["C"] = (gram, np.repeat(dx[:, DW:DW + DC] / size[:, None], size, axis=0))
    return g


class Adagrad:
    """Adagrad steps; rows of W outside ``learned`` stay as they are."""

    def __init__(self, p: dict, rate: float, learned: np.ndarray):
        self.p, self.rate, self.learned = p, rate, learned
        self.s = {k: np.full_like(v, 1e-8) for k, v in p.items()}

    def step(self, g: dict) -> None:
        for k, v in g.items():
            if isinstance(v, tuple):
                at, where = np.unique(v[0], return_inverse=True)
                total = np.zeros((len(at), v[1].shape[1]), np.float32)
                np.add.at(total, where.reshape(-1), v[1])
                if k == "W":
                    total *= self.learned[at][:, None]
                self.s[k][at] += total**2
                self.p[k][at] -= self.rate * total / np.sqrt(self.s[k][at])
            else:
                self.s[k] += v**2
                self.p[k] -= self.rate * v / np.sqrt(self.s[k])


class Model:
    def __init__(self, p: dict, scale: float, shift: float):
        self.p, self.scale, self.shift = p, scale, shift

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Score of each text; one without words is scored like a window without evidence (its strongest logit is -20)."""
        tok = Tokens(texts)
        best = row_max(window_logits(self.p, tok), tok.row, len(texts), -20.0)
        return sigmoid(self.scale * best + self.shift).astype(float)


def train(texts: list[bytes], y: np.ndarray, seed: int = SEED) -> Model:
    """Fit on whole labelled texts (at most SAMPLE of them)."""
    rng = np.random.default_rng(seed)
    p = initial(rng)
    tok = Tokens(texts)
    fits = np.arange(len(texts)) % CALIBRATE != 0 if len(texts) >= 40 * CALIBRATE else np.ones(len(texts), bool)
    n1, n0 = y[fits].sum(), fits.sum() - y[fits].sum()
    c1, c0, e1, e0 = np.zeros(WORDS), np.zeros(WORDS), np.zeros(EVIDENCE), np.zeros(EVIDENCE)
    ends = np.searchsorted(tok.row, np.arange(len(texts) + 1))
    for r in np.flatnonzero(fits):  # documents that hold a word or a longer n-gram
        words = np.unique(tok.window[ends[r]:ends[r + 1]])
        words = words[words < len(tok.uniq)]
        size = tok.size[words]
        at = _ranges(tok.off[:-1][words], size)
        for ids, counts in ((tok.id[words], (c0, c1)), (tok.longer[:, at].reshape(-1), (e0, e1))):
            counts[int(y[r])][np.unique(ids)] += 1

    def odds_of(k1: np.ndarray, k0: np.ndarray) -> np.ndarray:
        """Log odds beyond SURE standard errors; zero for what is rarer than that can show."""
        odds = np.log((k1 + 0.5) / (n1 + 1)) - np.log((k0 + 0.5) / (n0 + 1))
        odds = np.sign(odds) * np.maximum(np.abs(odds) - SURE * np.sqrt(1 / (k1 + 0.5) + 1 / (k0 + 0.5)), 0)
        return np.where(k1 + k0 >= FEW, np.clip(odds, -3, 3), 0).astype(np.float32)

    odds = odds_of(c1, c0)
    p["W"][:, 0], p["E"] = odds, odds_of(e1, e0)
    learned = odds != 0
    strength = np.append(odds[tok.id] + tok.inputs(p)[:, -1], np.float32(-9))
    strongest = np.zeros(len(tok.window), np.float32)
    for t in range(LENGTH):
        np.maximum(strongest, strength[tok.window[:, t]], out=strongest)
    logits = strongest + 1e-6 * rng.random(len(strongest))
    opt = Adagrad(p, RATE, learned)
    every = np.flatnonzero(np.diff(ends))
    has = every[fits[every]]
    if not len(has):
        return Model(p, 0.0, float(np.log((n1 + 1) / (n0 + 1))))
    for _ in range(ROUNDS):
        order = np.lexsort((logits, tok.row))
        top = order[ends[has + 1] - 1]
        other = ends[has] + (rng.random(len(has)) * (ends[has + 1] - ends[has])).astype(np.int64)
        # the strongest window of every document, and any window of the clean ones
        pick = np.concatenate([top, other[y[has] == 0]])
        label = y[tok.row[pick]].astype(np.float32)
        weight = np.where(label > 0, 0.5 * len(label) / max(label.sum(), 1), 1.0).astype(np.float32)
        for _ in range(EPOCHS):
            perm = rng.permutation(len(pick))
            for i in range(0, len(perm), BATCH):
                b = perm[i:i + BATCH]
                opt.step(gradients(p, tok, pick[b], label[b], weight[b]))
        logits = window_logits(p, tok)
    if not fits.all():
        has = every[~fits[every]]
    best = row_max(logits, tok.row, len(texts), -20.0)[has]
    # calibrate the strongest window's logit (two parameters, damped Newton steps)
    beta, z, t = np.array([0.0, 1.0]), np.column_stack([np.ones(len(best)), best]), y[has]

    def loss(b: np.ndarray) -> float:
        v = z @ b
        return float((np.logaddexp(0, v) - t * v).sum() + 0.05 * ((b - [0, 1]) ** 2).sum())

    for _ in range(50):
        q = sigmoid(z @ beta)
        grad = z.T @ (q - t) + 0.1 * (beta - [0, 1])
        step = np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + 0.1 * np.eye(2), grad)
        while loss(beta - step) > loss(beta) and np.abs(step).max() > 1e-9:
            step = step / 2
        beta = beta - step
    return Model(p, float(beta[1]), float(beta[0]))


def fit(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2, sample: int = SAMPLE) -> Model | None:
    """Model from (doc_id, text) and (doc_id, y); None without both labels."""
    y = (labels.filter("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
         .filter(C.fold(mod) != held).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = (docs.join(F.broadcast(y), "doc_id")  # at most ``sample`` ids
            .select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y"))
    got = rows.toPandas().sort_values(["doc_id", "text"]).drop_duplicates("doc_id")
    if got.y.nunique() < 2:
        return None
    return train([t.encode("utf-8", "surrogatepass") for t in got.text], got.y.to_numpy(float))


def scores(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2, threshold: float = 0.3,
           sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``.

    Null and empty texts have no window and get the score of no evidence.
    Without labels of both classes every score is 0. Of several labels of a
    doc_id the larger counts. Extra columns are ignored; repeated rows score
    alike."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(rows, labels, mod, held, sample)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in C.slices(b.column("text")):
                s = model.score(texts) if model else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(texts)), pa.array(s)], ["doc_id", "score"])

    out = rows.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", (C.fold(mod) == held).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
