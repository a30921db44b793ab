"""Rows that move between tasks as compressed columns.

Spark moves rows one by one and compresses a few hundred of them at a time. Where wide rows
go to partitions by a key, :func:`moved` packs the rows that a task has for a partition into
record batches (columns, zstd), so the bytes on disk and network are a fraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and bytes that a task packs at a time.
ROWS, BYTES = 200_000, 32 << 20


def moved(rows: DataFrame, parts: int, *keys: str) -> DataFrame:
    """``rows.repartition(parts, *keys)``: the same rows in the same partitions."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [], 0, 0
        for b in batches:
            held.append(b)
            n, size = n + b.num_rows, size + b.nbytes
            if n >= ROWS or size >= BYTES:
                yield from packed(held)
                held, n, size = [], 0, 0
        if n:
            yield from packed(held)

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        t = t.take(pc.sort_indices(t, [("_part", "ascending")])).combine_chunks()
        ends = pc.value_counts(t.column("_part"))  # in order of appearance
        options, at = pa.ipc.IpcWriteOptions(compression="zstd"), 0
        t = t.drop_columns("_part")
        for part, count in zip(ends.field("values").to_pylist(), ends.field("counts").to_pylist()):
            piece = t.slice(at, count).combine_chunks().to_batches()[0]
            at += count
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([as_bytes(piece, options)], pa.binary())],
                                              ["_part", "rows"])

    def as_bytes(piece: pa.RecordBatch, options: pa.ipc.IpcWriteOptions) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, piece.schema, options=options) as w:
            w.write_batch(piece)
        return sink.getvalue().to_pybytes()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in b.column("rows"):
                yield from pa.ipc.open_stream(piece.as_buffer())

    blobs = rows.withColumn("_part", F.pmod(F.hash(*keys), F.lit(parts))).mapInArrow(pack, "_part int, rows binary")
    return blobs.repartitionById(parts, F.col("_part")).mapInArrow(unpack, rows.schema)
