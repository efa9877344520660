"""Writes by key: insert if absent, upsert, update if present, delete. Each takes rows, distinct by key, and commits one segment."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..plans.schema import TableSchema
from ..sources.store import DELETED, SegmentStore
from .merge import key_columns, view


class Mode(Enum):
    UPSERT = 0
    INSERT = 1
    UPDATE = 2


def check_rows(rows: DataFrame, schema: TableSchema) -> None:
    """Refuse nulls and repeated keys: a table has neither. One pass finds both."""
    null = F.lit(False)
    for name in schema.names:
        null = null | F.col(f"`{name}`").isNull()
    by_key = rows.groupBy(*key_columns(schema)).agg(F.count(F.lit(1)).alias("@n"), F.max(null).alias("@null"))
    if bad := by_key.where("`@n` > 1 or `@null`").select("`@null`").take(1):
        raise EngineError("null in a table's row" if bad[0][0] else "duplicate primary key")


def put(store: SegmentStore, rows: DataFrame, mode: Mode = Mode.UPSERT, sort: bool = True) -> int:
    """Write the rows that the mode lets through; how many."""
    key = list(store.schema.key)
    if mode is not Mode.UPSERT:
        there = view(store).select(*key_columns(store.schema))
        rows = rows.join(there, key, "left_anti" if mode is Mode.INSERT else "left_semi")
    return store.append(rows.withColumn(DELETED, F.lit(False)), sort)


def delete(store: SegmentStore, keys: DataFrame) -> int:
    """Bury those of the keys that are live; how many."""
    live = view(store).select(*key_columns(store.schema)).join(keys.select(*key_columns(store.schema)).distinct(), list(store.schema.key), "left_semi")
    return store.append(tombstones(live, store.schema))


def tombstones(keys: DataFrame, schema: TableSchema) -> DataFrame:
    columns = [F.col(f"`{c.name}`") if schema.is_key(c.name) else F.lit(None).cast(c.kind.spark).alias(c.name) for c in schema.columns]
    return keys.select(*columns, F.lit(True).alias(DELETED))
