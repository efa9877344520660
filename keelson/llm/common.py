"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import Files, fresh_root, shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A word of the contracts: a run of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the folder that all executors share."""
    return fresh_root(spark, label)


def remove_path(spark: SparkSession, path: str) -> None:
    Files(spark, path).remove(path)


def stash(df: DataFrame) -> DataFrame:
    """Cut the lineage: what df holds, kept in the shared folder. For narrow tables; call it where a table is read more than once."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def drop_stash(df: DataFrame) -> None:
    """Remove the files of what stash() gave. Nothing that is still to be computed may read it."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        remove_path(df.sparkSession, file.get())


def drawn(key: Column, n: int, total: int) -> Column:
    """True for about n of total rows (for all, if there are no more): those whose hash is among the least. So a sample is
    taken in the partitions, and no more than it moves."""
    return key <= F.lit(min(int(-(2**63) + 2**64 * (n / max(total, 1))), 2**63 - 1)) if n < total else F.lit(True)


def hot_rows(total: int, most: int = 1 << 16) -> int:
    """Rows from which a key is dealt in parts: so many in any table, and less in a small one, where they are a task's share too."""
    return min(most, max(128, total // 2048))


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffles that nothing will read again, and delete their files on the executors."""
    spark.sparkContext._jvm.System.gc()


#: Rows of a list up to which it is broadcast.
BROADCAST_ROWS = 1 << 20


def small(df: DataFrame) -> DataFrame:
    """A stashed list of a few narrow columns, broadcast in joins if it has BROADCAST_ROWS at most, and joined by shuffle beyond."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def give_back() -> None:
    """Return memory that Arrow and the C library hold but don't use: an executor's Python workers live as long as it does."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() does the same on all-ASCII text and is much faster than translate()."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def running_total(df: DataFrame, group: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Add out: the sum of value over the rows of the same group that come before, by bucket and then by order.

    The sums are made in two levels, so no task holds a whole group: buckets are summed and accumulated, then the rows
    within each (group, bucket). group and bucket must not be null, and df must be cheap to read twice (stash it).
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*group, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(bases, [*group, bucket])
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .drop("_base")
    )


def drop_rows(docs: DataFrame, lost: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs less _lost rows of each (doc_id, raw), where raw is the text's xxhash64; its columns as they are, whatever their names.

    A row goes through as one struct, so its columns can't meet the ones made here. The window needs no exchange or sort
    beyond the join's own.
    """
    name = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    whole = docs.select(F.struct("*").alias("_doc"), name(F.col(id_col)).alias("_id"), F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)).alias("_raw"))
    lost = lost.select(name(F.col("doc_id")).alias("_id"), F.coalesce("raw", F.lit(0)).alias("_raw"), "_lost")
    place = F.row_number().over(Window.partitionBy("_id", "_raw").orderBy("_id"))
    left = whole.join(lost, ["_id", "_raw"], "left").withColumn("_place", place)
    return left.where(F.col("_lost").isNull() | (F.col("_place") > F.col("_lost"))).select("_doc.*")


#: Ids drawn to be marks on a grid, and even parts between two of them, whose bytes are counted to cut ranges.
MARKS, PARTS = 2048, 8


class Ranges:
    """Ranges of (id, tie) in order, of about as many bytes each: what place() gives never falls as ids grow, nor among
    rows of one id as their ties do. Null ids come first, by their ties alone.

    The bytes between the edges of a grid are counted exactly, MARKS * PARTS numbers; a part of the grid that holds more than a
    range is laid out evenly by id, and by tie within an id. Which ids are marks only matters for how fine the grid is.
    """

    def __init__(self, rows: DataFrame, target: int):
        """rows: doc_id (long), tie (long, a hash) and size (long); read three times, so it should be cheap or stashed."""
        known = rows.where(F.col("doc_id").isNotNull())
        chosen = known.where(drawn(F.xxhash64("doc_id", "tie", F.monotonically_increasing_id()), MARKS, known.count()))
        found = [r["doc_id"] for r in chosen.select("doc_id").collect()] or [0]
        marks = sorted({*found, *(min(x + 1, 2**63 - 1) for x in found)})  # an id with many rows gets a part of its own
        fine = {a + (b - a) * k // PARTS for a, b in zip(marks, marks[1:], strict=False) for k in range(PARTS)}
        edges = sorted(fine | {marks[-1]})
        self.edges = np.array(edges, dtype=np.int64)
        self.wide = np.array([*(b - a for a, b in zip(edges, edges[1:], strict=False)), 1], dtype=np.float64)
        self.below = np.zeros(len(edges) + 1)
        self.nulls, self.target = 0, target

        @F.pandas_udf("int")
        def cell(ids: pd.Series, known: pd.Series) -> pd.Series:
            return pd.Series(self._cell(ids.to_numpy(), known.to_numpy()))

        sizes = {r["cell"]: r["size"] for r in rows.groupBy(cell(*self._whole(F.col("doc_id"))).alias("cell")).agg(F.sum("size").alias("size")).collect()}
        self.nulls = -(-(sizes.pop(-1, 0) or 0) // target)
        for at, size in sizes.items():
            self.below[at + 1] = size
        self.below = np.cumsum(self.below)
        self.count = max(1, self.nulls + -(-int(self.below[-1]) // target))

    @staticmethod
    def _whole(ids: Column) -> tuple[Column, Column]:
        """Ids without nulls, which pandas would make floats, and whether they are known."""
        return F.coalesce(ids, F.lit(0).cast("bigint")), ids.isNotNull()

    def _cell(self, ids: np.ndarray, known: np.ndarray) -> np.ndarray:
        return np.where(known, np.clip(np.searchsorted(self.edges, ids, side="right") - 1, 0, None), -1).astype(np.int32)

    def _place(self, ids: np.ndarray, known: np.ndarray, ties: np.ndarray) -> np.ndarray:
        cell = self._cell(ids, known)
        part = np.clip((ties.astype(np.float64) + 2.0**63) / 2.0**64, 0, 1 - 1e-9)
        above = (ids.view(np.uint64) - self.edges[cell].view(np.uint64)).astype(np.float64)
        share = np.clip((above + np.where(self.wide[cell] < 2**40, part, 0)) / self.wide[cell], 0, 1)
        at = self.nulls + np.floor((self.below[cell] + share * (self.below[1:] - self.below[:-1])[cell]) / self.target)
        return np.clip(np.where(cell < 0, np.floor(part * self.nulls), at), 0, self.count - 1).astype(np.int32)

    def place(self, ids: Column, ties: Column) -> Column:
        @F.pandas_udf("int")
        def at(ids: pd.Series, known: pd.Series, ties: pd.Series) -> pd.Series:
            return pd.Series(self._place(ids.to_numpy(), known.to_numpy(), ties.to_numpy()))

        return at(*self._whole(ids), ties)
