"""Mixing sources to target weights: a time-varying curriculum, in DataFrame operations only.

Each source has a demand for words (its target) and a weight schedule over training time, which runs from 0 to 1. The
integral of the schedule is the source's cumulative demand. Its documents stand in a keyed order; the words before a
document, inverted through that integral, give the time at which training reaches it. A source whose target exceeds its
size is gone through a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, documents, running_total, stash

#: Weights by the sources' order, repeating; the share of all words that is taken; the most a source is repeated.
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Slope of the schedule 1 + slope * (2 * time - 1), by weight: heavy sources come early, light ones late.
SLOPES = (-0.5, 0.0, 0.5)
SEED = 17
#: Hexadecimal digits of the order key that name a bucket: 4096 buckets to a source.
BUCKET_DIGITS = 3
#: Stretches of training time that copies are counted by to give them their global positions.
STRETCHES = 1 << 16
#: Bytes of text to a partition of take_mix, and the most partitions.
PART_BYTES, MOST_PARTS = 32 << 20, 20_000


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, _named, source_size, weight, slope, target of sizes(source, source_size), a row for each source.

    Weights are met by filling up: sources in order of MOST * size / weight reach their cap one after the other as long
    as the rest, shared by weight, would lift them above it. There may be as many sources as there are sites: places in
    both orders are counted by stretches, and only sums over all come to the driver.
    """
    cap, one = F.col("source_size") * float(MOST), F.lit(1)
    named = stash(sizes.withColumn("_named", _source_name(F.col("source"))).withColumn("_stretch", F.substring("_named", 1, 3)).withColumn("_one", one))
    place = F.col("_place") % len(WEIGHTS)
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), place.cast("int") + 1)
    placed = running_total(named, [], "_stretch", ["_named"], "_one", "_place")
    placed = placed.withColumn("weight", pick(WEIGHTS).cast("double")).withColumn("slope", pick(SLOPES)).withColumn("_cap", cap)
    placed = placed.withColumn("_ratio", F.col("_cap") / F.col("weight")).withColumn("_stretch", F.floor(F.log2(F.col("_ratio") + 1) * 16).cast("int"))
    placed = stash(placed.select("source", "_named", "source_size", "weight", "slope", "_cap", "_ratio", "_stretch"))
    everything = placed.agg(F.sum("source_size"), F.sum("weight")).first()
    demand, weights = (everything[0] or 0) * SHARE, everything[1] or 0.0
    order = ["_ratio", "_named"]
    filled = running_total(stash(running_total(placed, [], "_stretch", order, "_cap", "_lower")), [], "_stretch", order, "weight", "_lighter")
    level = (F.lit(demand) - F.col("_lower")) / (F.lit(weights) - F.col("_lighter"))
    filled = stash(filled.withColumn("_full", F.col("_cap") <= F.col("weight") * level))
    rest = filled.agg(F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)), F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("weight")))).first()
    shared = F.col("weight") * F.lit((demand - rest[0]) / rest[1] if rest[1] else None).cast("double")
    return filled.select("source", "_named", "source_size", "weight", "slope", F.when(F.col("_full"), F.col("_cap")).otherwise(shared).alias("target"))


def time_of(words: Column, target: Column, slope: Column) -> Column:
    """The time at which the cumulative demand target * (t + slope * (t * t - t)) reaches words."""
    part = words / target
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * part)
    return F.when(slope == 0, part).otherwise((root - (1 - slope)) / (2 * slope))


def _source_name(source: Column) -> Column:
    return F.concat(F.when(source.isNull(), F.lit("1")).otherwise(F.lit("0")), F.coalesce(source, F.lit("")))


def _order_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, _key, _named, carry, the source's row of source_targets, and _before: the words before the row in
    its source's order. Rows of one key and size stand in order of carry."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words.alias("size"), _order_key(F.col(id_col), seed).alias("_key"), *carry)
    slim = stash(slim.withColumn("_named", _source_name(F.col("source"))).withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS)))
    targets = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"))).drop("source")
    return running_total(slim, ["_named"], "_bucket", ["_key", "size", *carry], "size", "_before").join(targets, "_named")


def _taken(rows: DataFrame, cut: bool) -> DataFrame:
    """rows of _placed with first_taken, second_taken, copies, first_time, second_time; see mix_sources."""
    target, size, first = F.col("target"), F.col("size"), F.col("_before")
    second = first + F.col("source_size")
    goal = F.round(target).cast("bigint")
    zero = F.lit(0).cast("bigint")
    if cut:
        part = lambda start: F.greatest(F.least(goal - start, size), zero)
        below = lambda start: start < goal
    else:
        part = lambda start: F.when(below(start), size).otherwise(zero)
        below = lambda start: start + size / 2 < target
    copies = (F.when(below(first), 1).otherwise(0) + F.when(below(second), 1).otherwise(0)).cast("int")
    rows = rows.withColumn("copies", copies).withColumn("first_taken", part(first)).withColumn("second_taken", part(second))
    reached = lambda start, n: F.when(F.col("copies") >= n, time_of(start, target, F.col("slope")))
    return rows.withColumn("first_time", reached(first, 1)).withColumn("second_time", reached(second, 2))


def _each_copy(rows: DataFrame) -> DataFrame:
    """A row for each copy of rows of _taken: copy (1 or 2), words, time, and position: its place among all copies by time.

    Copies of one time stand by key. Stretches of time are counted and accumulated, then the copies within each.
    """
    copy = lambda n, words, time: F.struct(F.lit(n).alias("copy"), F.col(words).alias("words"), F.col(time).alias("time"))
    both = F.array(copy(1, "first_taken", "first_time"), copy(2, "second_taken", "second_time"))
    copies = rows.where("copies > 0").withColumn("_copy", F.explode(F.slice(both, F.lit(1), F.col("copies")))).select("*", "_copy.*")
    copies = copies.withColumn("_one", F.lit(1)).withColumn("_stretch", F.floor(F.col("time") * STRETCHES).cast("int"))
    return running_total(copies, [], "_stretch", ["time", "_key", "copy"], "_one", "position")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, cut: bool = True) -> DataFrame:
    """One row per row of docs, range-sorted by training time: doc_id, size, source, source_size, target, taken, copies,
    first_time, second_time, first_position, second_position.

    Null text has size 0. Null sources form one source of their own, last in order. taken: words that the mix takes of
    the document. With cut, the document at which a source meets its target counts in part, so that the source's taken
    words are its target, rounded. Without, documents count whole or not at all, by whether their middle lies below the
    target. A document of size 0 is taken with no words if its place lies below the target. Positions count the copies of
    all sources from 0 in order of their times. Documents that the mix leaves out have neither and come last. Rows that
    agree in id and text can't be told apart; an empty table gives none.
    """
    rows = stash(_taken(_placed(docs, id_col, text_col, source_col, seed), cut).withColumn("_row", F.monotonically_increasing_id()))
    at = lambda n: F.max(F.when(F.col("copy") == n, F.col("position")))
    places = _each_copy(rows.select("_row", "_key", "copies", "first_taken", "second_taken", "first_time", "second_time")).groupBy("_row").agg(at(1).alias("first_position"), at(2).alias("second_position"))
    out = rows.join(places, "_row", "left").orderBy(F.col("first_position").asc_nulls_last(), "_key")
    return out.select("doc_id", "size", "source", "source_size", "target", (F.col("first_taken") + F.col("second_taken")).alias("taken"), "copies", "first_time", "second_time", "first_position", "second_position")


def mix_schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, cut: bool = True) -> DataFrame:
    """The curriculum: one row per copy that mix_sources takes, range-sorted by position: doc_id, source, copy, words, time, position."""
    rows = stash(_taken(_placed(docs, id_col, text_col, source_col, seed), cut))
    return _each_copy(rows).select("doc_id", "source", "copy", "words", "time", "position").orderBy("position")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).drop("source", "copies")


def op4_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_schedule(documents(spark, sf_dir))


SQL = rf"""
WITH d AS (SELECT doc_id, source, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k,
    CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(sum(size)) OVER () AS BIGINT) AS total,
    [5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)]::DOUBLE AS weight,
    [-0.5, 0.0, 0.5][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)]::DOUBLE AS slope FROM d GROUP BY source),
l AS (SELECT *, (total * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM s WINDOW w AS (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST)),
f AS (SELECT *, source_size * 2.0::DOUBLE <= weight * level AS filled FROM l),
t AS (SELECT source, source_size, slope, CASE WHEN filled THEN source_size * 2.0::DOUBLE ELSE weight * ((total * 1.5::DOUBLE
    - sum(CASE WHEN filled THEN source_size * 2.0::DOUBLE ELSE 0.0::DOUBLE END) OVER ())
    / sum(CASE WHEN filled THEN 0.0::DOUBLE ELSE weight END) OVER ()) END AS target FROM f),
r AS (SELECT d.*, CAST(sum(size) OVER (PARTITION BY source ORDER BY k, size, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before FROM d),
g AS (SELECT r.*, t.source_size, t.target, t.slope, CAST(round(t.target) AS BIGINT) AS goal FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, 1 AS copy, before AS words FROM g WHERE before < goal UNION ALL
    SELECT *, 2 AS copy, before + source_size AS words FROM g WHERE before + source_size < goal),
m AS (SELECT *, CASE WHEN slope = 0 THEN words::DOUBLE / target
    ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * (words::DOUBLE / target)) - (1 - slope)) / (2 * slope) END AS time FROM c),
p AS (SELECT doc_id, k, copy, time, row_number() OVER (ORDER BY time, k, copy) - 1 AS position FROM m)
SELECT g.doc_id, g.size, g.source_size, g.target,
    CAST(greatest(least(goal - g.before, g.size), 0) + greatest(least(goal - g.before - g.source_size, g.size), 0) AS BIGINT) AS taken,
    a.time AS first_time, b.time AS second_time, a.position AS first_position, b.position AS second_position
FROM g LEFT JOIN p a ON a.doc_id = g.doc_id AND a.copy = 1 LEFT JOIN p b ON b.doc_id = g.doc_id AND b.copy = 2
"""


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """docs as the mix takes them: a row for each copy that mix_sources, without cuts, takes (0 to MOST of a row), range-sorted
    by training time, copies of one time by key; its columns as they are, whatever their names. Partitions are even stretches of
    time, in which about as many words are taken, so whole rows move once to be sorted and nothing has to be sampled."""
    size = docs.agg(F.sum(F.octet_length(text_col) + 1)).first()[0] or 0
    parts = max(1, min(-(-size * MOST // PART_BYTES), MOST_PARTS))
    raw = F.xxhash64(F.col(text_col))
    same = ["_key", "_named", "_raw"]
    # rows that agree in these follow one another in their source's order, so the first one's place gives them all
    groups = _placed(docs.withColumn("_raw", raw), id_col, text_col, source_col, seed, carry=("_raw",)).groupBy(*same)
    groups = groups.agg(F.min("_before").alias("_least"), *[F.min(c).alias(f"_{c}") for c in ("size", "source_size", "target", "slope")])
    groups = groups.where("_least + _size / 2 < _target")
    keyed = docs.select(F.struct("*").alias("_doc"), _order_key(F.col(id_col), seed).alias("_key"), _source_name(F.col(source_col)).alias("_named"), raw.alias("_raw"))
    place = F.row_number().over(Window.partitionBy(*same).orderBy(*same))  # sorted so by the join already
    rows = keyed.join(groups, same).withColumn("_before", F.col("_least") + (place - 1) * F.col("_size"))
    rows = rows.select("_doc", "_key", "_before", *[F.col(f"_{c}").alias(c) for c in ("size", "source_size", "target", "slope")])
    times = F.slice(F.array(F.struct(F.col("first_time").alias("time"), F.lit(1).alias("copy")), F.struct(F.col("second_time").alias("time"), F.lit(2).alias("copy"))), F.lit(1), F.col("copies"))
    copies = _taken(rows, cut=False).where("copies > 0").select("_doc", "_key", F.explode(times).alias("_at"))
    stretch = F.least(F.floor(F.col("_at.time") * parts), F.lit(parts - 1)).cast("int")
    return copies.withColumn("_part", stretch).repartitionById(parts, "_part").sortWithinPartitions("_at.time", "_key", "_at.copy").select("_doc.*")
