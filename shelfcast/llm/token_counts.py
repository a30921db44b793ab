"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging.

Distinct pre-tokens of a batch become one ragged numpy array of symbol ids.
In each round every sequence finds its lowest-rank adjacent pair and merges
all its occurrences (left to right, not overlapping), all sequences at once;
sequences with no ranked pair are done, and the symbols that survive are
counted. Pre-tokens repeat a lot, so each is merged once per task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The public split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 512
#: Pre-tokens whose counts one task remembers; beyond that it starts anew.
REMEMBER = 400_000
NO_RANK = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """Letter of the vocabulary file for each byte: printable Latin-1 stands
    for itself, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Merge table as sorted pair keys with the rank and id of each result."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.n = 1 + max(vocab.values())
        self.byte_id = np.zeros(256, np.int64)
        for letter, b in byte_letters().items():
            self.byte_id[b] = vocab[letter]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([vocab[a] * self.n + vocab[b] for a, b in merges], np.int64)
        result = np.array([vocab[a + b] for a, b in merges], np.int64)
        # a pair listed twice keeps its first rank
        order = np.lexsort((np.arange(len(key)), key))
        first = np.append(True, np.diff(key[order]) != 0)
        self.key, self.rank, self.result = key[order][first], order[first], result[order][first]
        self.special = [t["content"] for t in spec["added_tokens"]]

    def find(self, pair: np.ndarray) -> np.ndarray:
        """Index into the table, -1 where the pair has no rank."""
        at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        return np.where(self.key[at] == pair, at, -1)


def count_symbols(seqs: list[bytes], m: Merges) -> np.ndarray:
    """Symbols that survive in each sequence (none is empty)."""
    size = np.array([len(s) for s in seqs], np.int64)
    sym = m.byte_id[np.frombuffer(b"".join(seqs), np.uint8)]
    seq = np.repeat(np.arange(len(seqs)), size)
    done = np.ones(len(seqs), np.int64)
    while len(sym) > 1:
        at = m.find(sym[:-1] * m.n + sym[1:])
        rank = np.where((at >= 0) & (seq[:-1] == seq[1:]), m.rank[at], NO_RANK)
        rank = np.append(rank, NO_RANK)
        start = np.flatnonzero(np.append(True, np.diff(seq) != 0))
        low = np.minimum.reduceat(rank, start)
        length = np.diff(np.append(start, len(seq)))
        over = low == NO_RANK
        done[seq[start[over]]] = length[over]
        if over.all():
            return done
        low, over = np.repeat(low, length), np.repeat(over, length)
        hit = np.flatnonzero((rank == low) & ~over)
        # pairs that overlap (a a a) merge from the left: every other one of a run
        run = np.flatnonzero(np.append(True, np.diff(hit) != 1))
        odd = (np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2
        hit = hit[odd == 0]
        sym[hit] = m.result[at[hit]]
        keep = ~over
        keep[hit + 1] = False
        sym, seq = sym[keep], seq[keep]
    if len(seq):
        done[seq[0]] = 1
    return done


def count_rows(path: str, limit: int):
    """Mapper; the table is read once in each Python worker's task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        m, pattern = Merges(path), regex.compile(PATTERN)
        special = regex.compile("|".join(regex.escape(s) for s in sorted(m.special, key=len, reverse=True))) \
            if m.special else None
        known: dict[str, int] = {}
        for b in batches:
            texts = b.column("text")
            for first in range(0, b.num_rows, 256):
                rows, n_bytes = [], []
                fresh: dict[str, int] = {}
                for t in texts.slice(first, 256):
                    t = t.as_py() or ""
                    n_bytes.append(len(t.encode("utf-8", "surrogatepass")))
                    marks = 0
                    if special and special.search(t):
                        parts = special.split(t)
                        marks = len(parts) - 1
                        words = [w for p in parts for w in pattern.findall(p)]
                    else:
                        words = pattern.findall(t)
                    rows.append((marks, words))
                    fresh.update((w, 0) for w in set(words) if w not in known)
                if fresh:
                    words = list(fresh)
                    if len(known) + len(words) > REMEMBER:
                        known = {w: known[w] for _, ws in rows for w in set(ws) if w in known}
                    got = count_symbols([w.encode("utf-8", "surrogatepass") for w in words], m)
                    known.update(zip(words, got.tolist()))
                n = [marks + sum(map(known.__getitem__, words)) for marks, words in rows]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(first, 256), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()),
                     pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, in one pass
    without a shuffle. Null text counts as empty (0 bytes, 0 tokens);
    repeated rows and ids stay as they are; extra columns are ignored.
    ``path``: tokenizer file, readable on every executor."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(count_rows(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
