"""S2 and K4 as a Spark data source: SQL dumps of ``INSERT`` statements.

``spark.read.format("insert_dump").load(path)`` reads the parts of a dump, one task
each, in pieces: columns come from the ``INSERT`` header (two layouts in one folder
give the columns of both), tuples may go over several lines, quotes are doubled
inside strings, ``NULL`` in any case is null, other text is kept as it stands. All
columns are strings; a tuple whose number of values does not fit its header
keeps its text in ``_corrupt``. Statements other than ``INSERT`` are skipped.

``df.write.format("insert_dump").save(path)`` writes one part per partition,
``ROWS`` tuples per statement; the first part opens with the table's definition,
so the parts in order of name load into a database. Parts appear when all
of them are written, and go when one fails.

Files are opened through ``pyarrow.fs``, so a path may name any store that it knows.
"""

from __future__ import annotations

import math
import re
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FORMAT, TABLE, ROWS, CORRUPT = "insert_dump", "sales_data", 500, "_corrupt"
#: Characters read, and rows handed on, at a time.
CHUNK, BATCH = 1 << 20, 10_000

_HEADER = re.compile(r"INSERT\s+INTO\s+([^\s(]+)\s*\(([^()]*)\)\s*VALUES", re.I)
_TUPLE = re.compile(r"[\s,]*\(((?:[^'()]|'(?:[^']|'')*')*)\)")
#: The same without going back, which tuples that are whole never need.
_WHOLE = re.compile(r"[\s,]*+\(((?:[^'()]++|'(?:[^']++|'')*+')*+)\)")
_END = re.compile(r"[\s,]*;")
_VALUE = re.compile(r"\s*(?:'((?:[^']|'')*)'|([^,']*?))\s*(?:,|$)")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def parts_of(path: str) -> list[str]:
    """Paths of the dump's parts, by name."""
    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [at]
    found = store.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True))
    hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(at.rstrip("/")):].split("/"))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and not hidden(f.path))


def plain_values(text: str) -> list[str | None] | None:
    """Values of a tuple's text without doubled quotes, by its quotes and commas; None where
    they do not fall as in a tuple."""
    out: list[str | None] = []
    pieces = text.split("'")
    end = len(pieces) - 1
    if end % 2:
        return None
    for n, piece in enumerate(pieces):
        if n % 2:
            out.append(piece)
            continue
        between = piece.split(",")
        if n and between.pop(0).strip() or n < end and (not between or between.pop().strip()):
            return None
        for v in between:
            v = v.strip()
            out.append(None if v.upper() == "NULL" else v)
    return out


def values_of(text: str) -> list[str | None]:
    """Values of a tuple's text."""
    if "''" not in text:
        quick = plain_values(text)
        if quick is not None:
            return quick
    out, at = [], 0
    while at <= len(text):
        m = _VALUE.match(text, at)
        if m is None:
            return []
        quoted, plain = m.groups()
        out.append(quoted.replace("''", "'") if quoted is not None else None if plain.upper() == "NULL" else plain)
        if m.end() == len(text) and not text[m.start():m.end()].endswith(","):
            break
        at = m.end()
    return out


def statements(stream) -> Iterator[tuple[list[str], str | None]]:
    """(columns, tuple's text) of each tuple, and (columns, None) at each header; the
    text is read in pieces, so a part need not fit in memory."""
    held, columns, more = "", None, True
    while True:
        at = 0
        while True:
            if columns is None:
                m = _HEADER.search(held, at)
                if m is None:
                    at = max(at, held.rfind(";") + 1) if more else len(held)
                    break
                columns, at = [c.strip().strip('`"') for c in m[2].split(",")], m.end()
                yield columns, None
                continue
            m = _WHOLE.match(held, at) or _TUPLE.match(held, at)
            if m is not None and (m.end() < len(held) or not more):
                yield columns, m[1]
                at = m.end()
                continue
            m = _END.match(held, at)
            if m is None:
                break
            columns, at = None, m.end()
        held = held[at:]
        if not more:
            return
        piece = stream.read(CHUNK)
        more = bool(piece)
        held += piece


class Lines:
    """Text of a part, decoded in pieces that end between characters."""

    def __init__(self, path: str, store: pafs.FileSystem):
        import codecs
        self.raw = store.open_input_stream(path)
        self.decode = codecs.getincrementaldecoder("utf-8-sig")("replace").decode

    def read(self, n: int) -> str:
        out = ""
        while not out:
            piece = self.raw.read(n)
            if not piece:
                return self.decode(b"", True)
            out = self.decode(piece)
        return out


@dataclass
class Part(InputPartition):
    path: str


class DumpReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.names = path, [f.name for f in schema.fields]

    def partitions(self) -> list[Part]:
        return [Part(p) for p in parts_of(self.path)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string()) for n in self.names])
        place = {n: i for i, n in enumerate(self.names)}
        rows: list[list[str | None]] = []
        same = False  # the statement has the columns as they are read
        for columns, text in statements(Lines(partition.path, opened(self.path)[0])):
            if text is None:
                same = [*columns, CORRUPT] == self.names
                continue
            got = values_of(text)
            row: list[str | None] = [None] * len(self.names)
            if same and len(got) == len(columns):
                row = [*got, None]
            elif len(got) == len(columns):
                for c, v in zip(columns, got):
                    if c in place:
                        row[place[c]] = v
            elif CORRUPT in place:
                row[place[CORRUPT]] = text
            rows.append(row)
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    name: str


_SQL_TYPES = {T.IntegerType: "INTEGER", T.LongType: "BIGINT", T.ShortType: "SMALLINT", T.DoubleType: "DOUBLE", T.FloatType: "DOUBLE",
              T.DateType: "DATE", T.TimestampType: "TIMESTAMP", T.BooleanType: "BOOLEAN"}


def sql_type(t: T.DataType) -> str:
    return f"DECIMAL({t.precision}, {t.scale})" if isinstance(t, T.DecimalType) else _SQL_TYPES.get(type(t), "TEXT")


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, float) and not math.isfinite(v):
        return "NULL"
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


class DumpWriter(DataSourceWriter):
    def __init__(self, path: str, schema: T.StructType, table: str, overwrite: bool):
        self.path, self.table, self.overwrite = path, table, overwrite
        self.fields = [(f.name, sql_type(f.dataType)) for f in schema.fields]
        self.run = uuid.uuid4().hex[:12]

    def write(self, rows: Iterator[T.Row]) -> Written:
        from pyspark import TaskContext
        store, at = opened(self.path)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{self.run}.sql"
        store.create_dir(f"{at}/_{self.run}", recursive=True)
        columns = ", ".join(n for n, _ in self.fields)
        # a retried task writes its own file; the one that is reported counts
        temp = f"{at}/_{self.run}/{name}.{context.taskAttemptId()}"
        with store.open_output_stream(temp) as out:
            if context.partitionId() == 0:
                defined = ",\n  ".join(f"{n} {t}" for n, t in self.fields)
                out.write(f"CREATE TABLE IF NOT EXISTS {self.table} (\n  {defined}\n);\n".encode())
            n = 0
            for row in rows:
                out.write((f"INSERT INTO {self.table} ({columns}) VALUES\n" if n % ROWS == 0 else ",\n").encode())
                out.write(("(" + ", ".join(literal(v) for v in row) + ")").encode())
                n += 1
                if n % ROWS == 0:
                    out.write(b";\n")
            if n % ROWS:
                out.write(b";\n")
        return Written(temp)

    def commit(self, messages: list[Written]) -> None:
        store, at = opened(self.path)
        if self.overwrite:
            for old in parts_of(self.path):
                store.delete_file(old)
        for m in messages:
            if m is not None:
                store.move(m.name, f"{at}/{m.name.rsplit('/', 1)[1].rsplit('.', 1)[0]}")
        store.delete_dir(f"{at}/_{self.run}")

    def abort(self, messages: list[Written]) -> None:
        store, at = opened(self.path)
        if store.get_file_info(f"{at}/_{self.run}").type == pafs.FileType.Directory:
            store.delete_dir(f"{at}/_{self.run}")


class InsertDump(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        """Columns of the parts' first headers, in order, and ``_corrupt``."""
        names: list[str] = []
        store, _ = opened(self.options["path"])
        for part in parts_of(self.options["path"]):
            for columns, _ in statements(Lines(part, store)):
                names += [c for c in columns if c not in names]
                break
        return T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])

    def reader(self, schema: T.StructType) -> DumpReader:
        return DumpReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DumpWriter:
        return DumpWriter(self.options["path"], schema, self.options.get("table", TABLE), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session; executors need only pyarrow."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(InsertDump)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).load(path)


def write_dump(df: DataFrame, path: str, table: str = TABLE) -> None:
    register(df.sparkSession)
    df.write.format(FORMAT).option("table", table).mode("overwrite").save(path)
