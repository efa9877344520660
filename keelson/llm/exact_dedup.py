"""Exact dedup by skew-safe combining, in DataFrame operations only.

A first pass keeps a digest of every normalised text. Digests that hold more rows than a task should are salted. Rows are
then grouped by digest, salt and the whole text: Spark's partial aggregation does this locally before anything is shuffled,
the exchange merges the salted groups, and the few winners of each salted group are combined globally, again by whole text.
The digest only routes rows. Should two texts share one, their rows are matched by whole text too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, documents, drop_rows, hot_rows, small, stash, text_or_empty

#: Parts that a hot digest's rows are dealt in.
SALTS = 64


def sha256_of(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=ascii_lower, digest=sha256_of, salts: int = SALTS
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. The largest id of each group of equal normalised texts is kept; a null id is smaller than
    any other. Where the kept id stands on several rows of the group, one of them is kept. An empty table gives no rows;
    other columns of docs are not read.
    """
    norm = normalise(text_or_empty(text_col))
    base = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"), F.xxhash64(F.col(text_col)).alias("raw"))
    base = base.select("doc_id", "norm", "raw", digest(F.col("norm")).alias("digest"), F.monotonically_increasing_id().alias("row"))
    slim = stash(base.select("doc_id", "raw", "digest", "row", sha256_of(F.col("norm")).alias("text_sha256")))

    last = F.max(F.struct("doc_id", "row"))["row"].alias("keep_row")  # of the rows with the largest id, one
    counts = stash(slim.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), last))
    hot = small(stash(counts.where(F.col("n") >= hot_rows(slim.count())).select("digest", F.lit(True).alias("hot"))))
    every = F.explode(F.sequence(F.lit(0), F.when(F.col("hot"), salts - 1).otherwise(0))).alias("salt")

    def salted(df: DataFrame) -> DataFrame:
        """By the row's place too, as many rows may have no id; a row's salt needn't be the same in every pass."""
        salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "row"), F.lit(salts))).otherwise(F.lit(0))
        return df.join(hot, "digest", "left").withColumn("hot", F.coalesce("hot", F.lit(False))).withColumn("salt", salt.cast("int"))

    groups = (
        salted(base.select("doc_id", "norm", "digest", "row"))
        .groupBy("digest", "salt", "hot", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", "hot", "keep_id", "group_size", F.when(F.col("hot"), F.col("norm")).alias("norm"))
    )
    groups = stash(groups)  # narrow: whole texts stay in it for hot digests only
    winners = groups.where("hot").groupBy("digest", "hot", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")).drop("norm")
    winners = winners.unionByName(groups.where("not hot").drop("norm"))
    shared = stash(winners.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"))
    clash = bool(shared.take(1))
    if clash:
        winners = winners.join(shared, "digest", "left_anti")
    winners = winners.join(counts.select("digest", "keep_row"), "digest").select("digest", every, "keep_id", "group_size", "keep_row")
    found = salted(slim).join(winners, ["digest", "salt"]).select("doc_id", "raw", "text_sha256", "row", "keep_id", "group_size", "keep_row")
    if clash:  # texts that share a digest: their rows meet by whole text
        rest = stash(salted(base.join(shared, "digest")))
        best = rest.groupBy("digest", "hot", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), last)
        rest = rest.join(best.select("digest", "norm", every, "keep_id", "group_size", "keep_row"), ["digest", "norm", "salt"])
        found = found.unionByName(rest.withColumn("text_sha256", sha256_of(F.col("norm"))).select(*found.columns))
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "raw")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("raw")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops; its columns as they are.

    Rows that agree in id and whole text can't be told apart; one of them stays.
    """
    lost = exact_dedup(docs, id_col, text_col).where(~F.col("kept")).groupBy("doc_id", "raw").agg(F.count(F.lit(1)).alias("_lost"))
    return drop_rows(docs, lost, id_col, text_col)


SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
