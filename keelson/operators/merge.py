"""Merging segments: the newest version of each key, without the dead.

The oldest run is nearly all of a table. Newer segments shadow few of its rows, so it isn't shuffled to find them: few newer keys
are broadcast, and of many a Bloom filter is, made by a subquery, so that only rows it lets through meet the newer keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as Classic
from pyspark.sql.classic.column import _to_java_column, _to_seq
from pyspark.sql.window import Window

from ..plans.schema import TableSchema
from ..sources.store import DELETED, SEQ, Manifest, SegmentStore


def key_columns(schema: TableSchema) -> list[str]:
    return [f"`{k}`" for k in schema.key]


def newest(rows: DataFrame, schema: TableSchema) -> DataFrame:
    """The row with the highest @seq of each key, tombstones included."""
    latest = Window.partitionBy(*key_columns(schema)).orderBy(F.col(f"`{SEQ}`").desc())
    return rows.withColumn("@place", F.row_number().over(latest)).where(F.col("`@place`") == 1).drop("@place")


def alive(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col(f"`{DELETED}`"))


#: Bits to a key in a Bloom filter (about one key in a hundred passes wrongly).
BLOOM_BITS = 10


def may_be_among(keys: DataFrame, names: list[str], rows: int) -> Column:
    """Whether a row's key may stand in keys, of about so many rows: false only if it doesn't. Catalyst's own filter functions,
    which have no name in SQL."""
    context = keys.sparkSession.sparkContext
    jvm = context._jvm
    to_expression, to_column = jvm.org.apache.spark.sql.classic.ExpressionUtils.expression, jvm.org.apache.spark.sql.classic.ExpressionUtils.column
    hashed = F.xxhash64(*names)
    arguments = [hashed, F.lit(max(rows, 1)).cast("long"), F.lit(max(rows, 64) * BLOOM_BITS).cast("long")]
    built = Classic(jvm.PythonSQLUtils.internalFn("bloom_filter_agg", _to_seq(context, arguments, _to_java_column)))
    filtered = keys.select(built).scalar()
    return F.coalesce(Classic(to_column(jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(to_expression(filtered._jc), to_expression(hashed._jc)))), F.lit(False))


def view(store: SegmentStore, manifest: Manifest | None = None, predicate: Column | None = None) -> DataFrame:
    """The live rows as of a manifest (the newest by default), with user columns only, in no order.

    predicate must be of key columns alone; it goes to every segment's scan, below the merge. One segment needs no merge,
    and no filter of tombstones if it has none. If the segments above the oldest run are small (by the manifest's counts),
    their keys are broadcast to it; if they are larger, a filter of their keys is, and only what passes is shuffled. Beyond
    that all are merged by key in one exchange.
    """
    manifest = manifest or store.live()
    scan = lambda some: store.read_segments(some).where(predicate) if predicate is not None else store.read_segments(some)
    segments, schema, options = manifest.segments, store.schema, store.options
    names = [f"`{n}`" for n in schema.names]
    if len(segments) <= 1:
        rows = scan(segments)
        return (alive(rows) if any(s.tombstones for s in segments) else rows).select(*names)
    upper, oldest = segments[:-1], segments[-1]
    newer = sum(s.rows for s in upper)
    if not manifest.runs or newer > options.bloom_rows:
        return alive(newest(scan(segments), schema)).select(*names)
    over, base = newest(scan(upper), schema), scan([oldest])
    base = (alive(base) if oldest.tombstones else base).select(*names)
    keys, key = over.select(*key_columns(schema)), list(schema.key)
    if newer <= options.broadcast_rows and sum(s.bytes for s in upper) <= options.broadcast_bytes:
        under = base.join(F.broadcast(keys), key, "left_anti")
    else:
        hit = may_be_among(scan(upper), key_columns(schema), newer)
        under = base.where(~hit).unionAll(base.where(hit).join(keys, key, "left_anti").select(*names))
    return under.select(*names).unionAll(alive(over).select(*names))
