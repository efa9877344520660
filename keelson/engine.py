"""The engine: SQL statements and the same operations as an API, over tables below one root folder.

Statements run in a session of the engine's own: ANSI off, so that integers wrap, names case-sensitive, UTC. The caller's
session is left as it is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError, quoted
from .functions.expressions import compile_expression, failing
from .operators import compact as compaction
from .operators.cursor import Cursor
from .operators.merge import BLOOM_BITS, alive, key_columns, newest, view
from .operators.modify import Mode, check_rows, delete, put, tombstones
from .plans.access import KeyRange, Point, plan_where
from .plans.parser import parse
from .plans.schema import Column, Kind, TableSchema, retyped
from .plans.syntax import CreateTable, Delete, Insert, Name, Select, Statement, Update
from .sources.catalog import Catalog
from .sources.exchange import PLACE, read_logs, read_sorted_files, write_sorted_files
from .sources.store import DELETED, SEQ, Manifest, Options, SegmentStore


def surfaced(error: Exception) -> Exception:
    """The engine's error for one that a row raised in a task, or the error itself."""
    found = re.search(r"\[USER_RAISED_EXCEPTION\] (.*?)(?: SQLSTATE: P0001|\n|$)", str(error))
    return EngineError(found[1].strip()) if found else error


@dataclass
class Result:
    """What a statement gave: rows changed, or a header and rows."""

    updated: int = 0
    header: list[str] | None = None
    frame: DataFrame | None = None

    def rows(self) -> list[tuple]:
        """All rows, in the order of the primary key."""
        if self.frame is None:
            return []
        try:
            return [tuple(r) for r in self.frame.collect()]
        except PySparkException as error:
            raise surfaced(error) from error


class Table:
    """One table by key, without SQL."""

    def __init__(self, engine: Engine, schema: TableSchema):
        self.schema = schema
        self.store = SegmentStore(engine.spark, engine.root, schema, engine.options)
        self._spark = engine.spark

    def _frame(self, rows) -> DataFrame:
        if isinstance(rows, DataFrame):
            missing = [n for n in self.schema.names if n not in rows.columns]
            if missing:
                raise EngineError(f"no such column {quoted(missing[0])}")
            return rows.select(*[F.col(f"`{c.name}`").cast(c.kind.spark).alias(c.name) for c in self.schema.columns])
        return self._spark.createDataFrame([tuple(r) for r in rows], self.schema.struct())

    def _ordered(self, rows: DataFrame, descending: bool = False) -> DataFrame:
        return rows.orderBy(*[F.col(k).desc() if descending else F.col(k) for k in key_columns(self.schema)])

    def get(self, *key) -> tuple | None:
        """The row of a key, or None."""
        got = view(self.store, predicate=Point(key).predicate(self.schema)).take(1)
        return tuple(got[0]) if got else None

    def scan(self) -> DataFrame:
        """All rows in key order."""
        return self._ordered(view(self.store))

    def seek(self, *prefix) -> DataFrame:
        """Rows from the first key at or after the prefix on."""
        return self.range(KeyRange.request(">=", prefix, "<=", None))

    def range(self, wanted: KeyRange | Point, ordered: bool = True) -> DataFrame:
        """Rows of a range, upwards or downwards as it says."""
        rows = view(self.store, predicate=wanted.predicate(self.schema))
        return self._ordered(rows, wanted.descending) if ordered else rows

    def cursor(self, wanted: KeyRange | None = None, page: int = 256) -> Cursor:
        """A cursor on the first row of a range, of all rows by default; it holds page rows at once."""
        now = self.store.live()

        def fetch(predicate, descending: bool, n: int) -> list[tuple]:
            return [tuple(r) for r in self._ordered(view(self.store, now, predicate), descending).limit(n).collect()]

        return Cursor(self.schema, fetch, wanted or KeyRange(), page)

    def as_of(self, version: int) -> DataFrame:
        """The rows as of a manifest that is still kept."""
        found = self.store.read_manifest(version) if version in self.store.versions() else None
        if found is None:
            raise EngineError(f"version {version} is not kept")
        return self._ordered(view(self.store, found))

    def versions(self) -> DataFrame:
        """Every stored version of every row, with @seq and @deleted."""
        return self.store.read_segments(self.store.live().segments)

    def _put(self, rows, mode: Mode) -> int:
        frame = self._frame(rows)
        check_rows(frame, self.schema)
        return put(self.store, frame, mode, sort=isinstance(rows, DataFrame))

    def insert(self, rows) -> int:
        """Write rows (a DataFrame or tuples) whose keys are absent; how many."""
        return self._put(rows, Mode.INSERT)

    def upsert(self, rows) -> int:
        return self._put(rows, Mode.UPSERT)

    def update(self, rows) -> int:
        """Replace rows whose keys are present; how many."""
        return self._put(rows, Mode.UPDATE)

    def delete(self, keys) -> int:
        """Delete by key: a DataFrame of the key columns, or tuples; how many were live."""
        if not isinstance(keys, DataFrame):
            fields = [self.schema.struct()[k] for k in self.schema.key]
            keys = self._spark.createDataFrame([tuple(k) if isinstance(k, (tuple, list)) else (k,) for k in keys], type(self.schema.struct())(fields))
        return delete(self.store, keys)

    def flush(self) -> bool:
        return compaction.flush(self.store)

    def compact(self) -> None:
        compaction.compact(self.store)

    def export(self, folder: str, files: int = 1) -> None:
        """Write the live rows as a byte-ordered store's sorted files."""
        write_sorted_files(view(self.store), self.schema, folder, files)

    def manifest(self) -> Manifest:
        return self.store.live()


class Engine:
    def __init__(self, spark: SparkSession, root: str, options: Options | None = None):
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.ansi.enabled", "false")
        self.spark.conf.set("spark.sql.caseSensitive", "true")
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.options = options or Options()
        self.spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.maxNumItems", str(self.options.bloom_rows))
        self.spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.maxNumBits", str(self.options.bloom_rows * BLOOM_BITS))
        self.root = root.rstrip("/")
        self.catalog = Catalog(self.spark, self.root)

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.catalog.forget()

    def schema(self, name: str) -> TableSchema:
        return self.catalog.get(name)

    def table(self, name: str) -> Table:
        return Table(self, self.schema(name))

    def create(self, schema: TableSchema) -> Table:
        self.catalog.create(schema)
        return Table(self, schema)

    def load(self, schema: TableSchema, rows: DataFrame) -> Table:
        """Create a table with rows of the caller's session, as one sorted run. Nulls and repeated keys are refused."""
        table = self.create(schema)
        frame = rows.select(*[F.col(f"`{c.name}`").cast(c.kind.spark).alias(c.name) for c in schema.columns])
        check_rows(frame, schema)
        version = table.store.next_version()
        run = table.store.write(frame.withColumn(DELETED, F.lit(False)), version)
        table.store.commit(Manifest(version, (), (run,) if run else ()))
        return table

    def adopt(self, schema: TableSchema, levels: list[str], logs: list[str] | None = None) -> Table:
        """Create a table from a byte-ordered store's files: sorted files or folders of them, the newest level first, and logs,
        which are newer than all levels, the newest first. The newest version of each key counts."""
        found = [read_logs(self.spark, schema, [path]) for path in logs or []] + [read_sorted_files(self.spark, schema, [path]) for path in levels]
        ranked = [rows.withColumn(SEQ, F.struct(F.lit(-age), F.col(f"`{PLACE}`"))) for age, rows in enumerate(found)]
        rows = alive(newest(reduce(DataFrame.unionAll, ranked), schema))
        return self.load(schema, rows)

    def exec(self, text: str) -> Result:
        return self.exec_statement(parse(text))

    def exec_statement(self, statement: Statement) -> Result:
        runs = {CreateTable: self._create, Insert: self._insert, Select: self._select, Update: self._update, Delete: self._delete}
        if type(statement) not in runs:
            raise EngineError(f"unknown statement {statement!r}")
        try:
            return runs[type(statement)](statement)
        except PySparkException as error:
            raise surfaced(error) from error

    def _create(self, s: CreateTable) -> Result:
        self.create(TableSchema(s.table, tuple(Column(n, Kind(k)) for n, k in s.columns), s.key))
        return Result()

    def _insert(self, s: Insert) -> Result:
        table = self.table(s.table)
        columns = table.schema.columns
        if len(s.values) != len(columns):
            raise EngineError(f"INSERT has {len(s.values)} values, table has {len(columns)} columns")
        row = tuple(retyped(v, c.kind) for v, c in zip(s.values, columns, strict=True))
        key = [row[table.schema.names.index(k)] for k in table.schema.key]
        if table.get(*key) is not None:
            raise EngineError("duplicate primary key")
        frame = self.spark.createDataFrame([row], table.schema.struct()).coalesce(1)
        return Result(updated=table.store.append(frame.withColumn(DELETED, F.lit(False))))

    def _select(self, s: Select) -> Result:
        table = self.table(s.table)
        values = [compile_expression(table.schema, node, strict=True)[0] for node in s.outputs]
        header = [node.name if isinstance(node, Name) else f"col{n}" for n, node in enumerate(s.outputs, 1)]
        rows = table.range(plan_where(table.schema, s.where))
        return Result(header=header, frame=rows.select(*[v.alias(n) for v, n in zip(values, header, strict=True)]))

    def _update(self, s: Update) -> Result:
        table = self.table(s.table)
        schema = table.schema
        changes = {}
        for name, node in s.changes:
            column = schema.column(name)
            if column is None:
                raise EngineError(f"no such column {quoted(name)}")
            if schema.is_key(name):
                raise EngineError("UPDATE cannot change a primary key column")
            value, kind = compile_expression(schema, node)
            if kind is not None and kind is not column.kind:
                value = failing(f"type mismatch assigning to {quoted(name)}", value)
            changes[name] = value.cast(column.kind.spark)
        rows = table.range(plan_where(schema, s.where), ordered=False)
        new = rows.select(*[changes.get(n, F.col(f"`{n}`")).alias(n) for n in schema.names], F.lit(False).alias(DELETED))
        return Result(updated=table.store.append(new))

    def _delete(self, s: Delete) -> Result:
        table = self.table(s.table)
        rows = table.range(plan_where(table.schema, s.where), ordered=False)
        return Result(updated=table.store.append(tombstones(rows, table.schema)))

