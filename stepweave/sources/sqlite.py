"""Tables of a SQLite file as a Spark data source: read in the tasks, by ranges of row numbers.

    spark.dataSource.register(SqliteSource)
    spark.read.format("sqlite").schema("id long, name string").option("table", "classes").load("old.db")

The columns of the schema are the columns that are read; a nullable one that the table lacks is null. Filters on columns of the
table are part of the query where spark.sql.python.filterPushdown.enabled is set. On a cluster the file must be on shared storage that
workers mount, or be shipped with SparkContext.addFile and named by `shipped`. Nothing is held on the driver but row numbers.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

#: Row numbers in a partition, and rows in a batch.
RANGE = 100_000
BATCH = 10_000


def connect(path: str) -> sqlite3.Connection:
    if not os.path.exists(path):
        raise ValueError(f"no file {path}")
    return sqlite3.connect(f"file:{quote(os.path.abspath(path))}?mode=ro", uri=True)


def tables(path: str) -> set[str]:
    con = connect(path)
    try:
        return {r[0] for r in con.execute("select name from sqlite_master where type = 'table'")}
    finally:
        con.close()


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Range(D.InputPartition):
    """Rows of numbers from low to below high; without low, all rows."""

    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        raise ValueError("sqlite: give a schema; its columns are read")

    def reader(self, schema: StructType) -> D.DataSourceReader:
        if str(self.options.get("pushdown", "")).lower() == "true":
            return FilteringReader(schema, self.options)
        return Reader(schema, self.options)


class Reader(D.DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.fields = [(f.name, f.dataType.typeName()) for f in schema]
        self.path, self.table = options.get("path"), options.get("table")
        self.shipped = options.get("shipped")
        self.range = int(options.get("range", RANGE))
        if not self.path or not self.table:
            raise ValueError("sqlite: give a path and a table")
        con = connect(self.path)
        try:
            self.there = {r[1] for r in con.execute(f"pragma table_info({quoted(self.table)})")}
        finally:
            con.close()
        self.where: list[tuple[str, list]] = []

    def partitions(self) -> list[Range]:
        con = connect(self.path)
        try:
            low, high = con.execute(f"select min(rowid), max(rowid) from {quoted(self.table)}").fetchone()
        except sqlite3.OperationalError:  # a table without row numbers
            return [Range(None, None)]
        finally:
            con.close()
        return [Range(0, 0)] if low is None else [Range(k, k + self.range) for k in range(low, high + 1, self.range)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        path = self.path
        if self.shipped and not os.path.exists(path):
            from pyspark import SparkFiles

            path = SparkFiles.get(self.shipped)
        clauses, values = [c for c, _ in self.where], [v for _, vs in self.where for v in vs]
        if part.low is not None:
            clauses, values = [*clauses, "rowid >= ?", "rowid < ?"], [*values, part.low, part.high]
        want = ", ".join(quoted(n) if n in self.there else "null" for n, _ in self.fields) or "1"
        con = connect(path)
        try:
            rows = con.execute(f"select {want} from {quoted(self.table)}" + (f" where {' and '.join(clauses)}" if clauses else ""), values)
            while some := rows.fetchmany(BATCH):
                cols = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays([_array(c, kind) for c, (_, kind) in zip(cols, self.fields, strict=False)], [n for n, _ in self.fields])
        finally:
            con.close()


def _array(values: tuple, kind: str) -> pa.Array:
    """SQLite types values, not columns: what a column's type can't hold is null."""
    if kind == "boolean":
        return pa.array([None if v is None else bool(v) for v in values], pa.bool_())
    if kind in ("long", "integer"):
        top = 1 << (63 if kind == "long" else 31)
        whole = [int(v) if isinstance(v, (int, float)) or isinstance(v, str) and v.strip().lstrip("+-").isdigit() else None for v in values]
        return pa.array([v if v is not None and -top <= v < top else None for v in whole], pa.int64() if kind == "long" else pa.int32())
    if kind == "double":
        return pa.array([float(v) if isinstance(v, (int, float)) else None for v in values], pa.float64())
    return pa.array([v.decode("utf-8", "replace") if isinstance(v, bytes) else None if v is None else str(v) for v in values], pa.string())


class FilteringReader(Reader):
    """A reader that takes filters on the table's own columns into its query; Spark applies them again, as SQLite compares by the values' types."""

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        signs = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}
        kinds = dict(self.fields)
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            kind = kinds.get(name)
            if name in self.there and kind in ("string", "long", "integer"):
                column = quoted(name) if kind != "string" else f"cast({quoted(name)} as text)"
                plain = lambda v, kind=kind: isinstance(v, str if kind == "string" else int) and not isinstance(v, bool)
                if type(f) in signs and plain(f.value) and (kind == "string") <= (type(f) is D.EqualTo):
                    self.where.append((f"{column} {signs[type(f)]} ?", [f.value]))
                elif isinstance(f, D.In) and 0 < len(f.value) <= 500 and all(map(plain, f.value)):
                    self.where.append((f"{column} in ({', '.join('?' * len(f.value))})", list(f.value)))
                elif isinstance(f, D.IsNotNull):
                    self.where.append((f"{quoted(name)} is not null", []))
            yield f
