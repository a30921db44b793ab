"""Shared helpers: tables, scratch in the shared folder, label folds, and
vectorised word hashing of Arrow text batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step holds at most (one longer text is
#: a step of its own).
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. Only a local master (tests)
    may leave that unset and gets a private one; a cluster run stops."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="llm-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` once into the shared folder and read it back."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_hash(text: str | Column = "text") -> Column:
    """Second half of a row key: rows of one doc_id with different texts stay apart.
    64 bits: among millions of rows without a doc_id, 32 bits meet by chance."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def fold(mod: int, doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod ``mod`` (null doc_id: as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


# ---------------------------------------------------------------- hashing

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BYTE_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse mod 2**64
_SEQ_BASES = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser (public constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 12), base % (1 << 64), dtype=np.uint64)
        step[0] = 1
        have = np.cumprod(step)
        if len(have) <= 4 * SLICE_BYTES:
            _POWERS[base] = have
    return have[:n]


#: Longer spans are hashed in a prime field, too: modulo 2**64 alone, a long
#: Thue-Morse sequence and its complement have the same polynomial hash.
LONG_SPAN = 64
_PRIME = (1 << 31) - 1


def prime_powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo ``_PRIME``."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.append(out, out * np.uint64(pow(base, len(out), _PRIME)) % np.uint64(_PRIME))
    return out[:n]


def prime_hashes(values: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    p = np.uint64(_PRIME)
    pre = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values % p * prime_powers(base % _PRIME, len(values)) % p, out=pre[1:])
    back = prime_powers(pow(base % _PRIME, -1, _PRIME), int(start.max()) + 1)
    return (pre[end] - pre[start]) % p * back[start] % p


def span_hashes(values: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for many spans at once."""
    if not len(start):
        return np.zeros(0, np.uint64)
    long = np.flatnonzero(end - start > LONG_SPAN)
    if len(long):
        out = _ring_hashes(values, base, start, end)
        out[long] = mix64(out[long] + prime_hashes(values, base, start[long], end[long]) * _MUL)
        return out
    return _ring_hashes(values, base, start, end)


def _ring_hashes(values: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    pw = powers(base, len(values) + 1)
    pre = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * pw[:-1], out=pre[1:])
    inv = powers(pow(base, -1, 1 << 64), len(values) + 1)
    return mix64((pre[end] - pre[start]) * inv[start] + (end - start).astype(np.uint64) * _MUL)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def slices(texts: pa.Array) -> Iterator[tuple[int, list]]:
    """(first row, encoded texts) pieces of at most about SLICE_BYTES; null is b''."""
    first, size, out = 0, 0, []
    for i, t in enumerate(texts):
        b = (t.as_py() or "").encode("utf-8", "surrogatepass")
        if out and size + len(b) > SLICE_BYTES:
            yield first, out
            first, size, out = i, 0, []
        out.append(b)
        size += len(b) + 1
    if out:
        yield first, out


def pieces(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of at most about SLICE_BYTES."""
    size, out = 0, []
    for t in texts:
        if out and size + len(t) > SLICE_BYTES:
            yield out
            size, out = 0, []
        out.append(t)
        size += len(t) + 1
    if out:
        yield out


LONG_WORD = 64
_LANE_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LANE_ODD = np.uint64(0xD6E8FEB86659FD93)


class Words:
    """Words of a list of encoded texts: byte spans, row of each word, 64-bit hashes.

    ``start``/``end`` index ``data`` (all texts joined by one space);
    ``first[r]:first[r+1]`` are the words of row r."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        space = _SPACE[self.data]
        edge = np.diff(space.astype(np.int8), prepend=1)
        self.start = np.flatnonzero(edge == -1)
        self.end = np.flatnonzero(edge == 1)
        if len(self.end) < len(self.start):
            self.end = np.append(self.end, len(self.data))
        at = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, at)
        self.lower = lower

    def keys(self, which: int = 0) -> np.ndarray:
        """64 bits per word, mixed lane by lane of eight bytes (words of over ``LONG_WORD``
        bytes: XXH3); with seeds 0 and 1 they make 128 independent bits."""
        data = _LOWER[self.data] if self.lower else self.data
        size = self.end - self.start
        seed = mix64(np.array([which + 1], np.uint64) * _MUL)[0]
        out = mix64(size.astype(np.uint64) * _MUL ^ seed)
        padded = np.append(data, np.zeros(8, np.uint8))
        for at in range(0, LONG_WORD, 8):
            some = np.flatnonzero((size > at) & (size <= LONG_WORD))
            if not len(some):
                break
            lane = padded[(self.start[some] + at)[:, None] + np.arange(8)].view("<u8").reshape(-1)
            lane = lane & _LANE_MASK[np.minimum(size[some] - at, 8)]
            out[some] = mix64((out[some] ^ lane) * _LANE_ODD + seed)
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            out[i] = xxhash.xxh3_64_intdigest(data[self.start[i]:self.end[i]].tobytes(), which)
        return out

    def hashes(self) -> np.ndarray:
        """Polynomial hash of each word, for statistics; long words may meet."""
        data = _LOWER[self.data] if self.lower else self.data
        return span_hashes(data.astype(np.uint64) + np.uint64(1), _BYTE_BASE, self.start, self.end)


def row_of(docs: DataFrame, *keys: Column) -> DataFrame:
    """Each row of ``docs`` as one struct ``row`` beside ``keys``, so that no name of
    a helper column can meet one of the table's."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *keys)


def back_from(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from the struct ``row``."""
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def in_order(docs: DataFrame) -> Column:
    """A key that depends on all columns of ``row`` but maps, so that the choice
    among rows repeats."""
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*(F.col("row")[c] for c in plain)) if plain else F.lit(0)


def seq_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of the word sequences words[start:end]; two independent bases."""
    return span_hashes(words if which == 0 else mix64(words + _MUL), _SEQ_BASES[which], start, end)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)
