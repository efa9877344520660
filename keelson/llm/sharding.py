"""Sharding by histogram sort.

Rows have a key: the hash of the text, then doc_id. Splitters between shards are found by counting, never by sampling:
each round counts the exact bytes between candidate boundaries over all partitions and lays finer candidates where a
splitter must lie, until the bytes below every splitter are within tolerance of their goal. Rows are exchanged once,
when all splitters are known. Equal texts share a hash, so they stay together but where a splitter passes through them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, running_total, stash

SHARDS = 16
#: Candidate boundaries within an open interval in each round.
PROBES = 64
#: How far the bytes below a splitter may be from their goal, as a part of a shard's bytes.
TOLERANCE = 0.0005
LOW, HIGH = -(2**63), 2**63 - 1


def _below(rows: DataFrame, key: str, edges: list[int]) -> dict[int, tuple[int, int]]:
    """(bytes, rows) with key < edge, for each of the sorted edges: counted in the partitions, a few numbers each to the driver."""
    marks = np.array(edges, dtype=np.int64)

    def count(batches):
        total = np.zeros((2, len(marks) + 1), dtype=np.int64)
        for pdf in batches:
            at = np.searchsorted(marks, pdf[key].to_numpy(), side="right")
            np.add.at(total[0], at, pdf["size"].to_numpy())
            np.add.at(total[1], at, 1)
        at = np.nonzero(total[1])[0]
        yield pd.DataFrame({"at": at, "bytes": total[0][at], "n": total[1][at]})

    got = rows.select(key, "size").mapInPandas(count, "at long, bytes long, n long").groupBy("at").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()
    parts = [[0, 0] for _ in range(len(marks) + 1)]
    for r in got:
        parts[r["at"]] = [r["bytes"], r["n"]]
    below, out = [0, 0], {}
    for edge, part in zip(edges, parts, strict=False):
        below = [below[0] + part[0], below[1] + part[1]]
        out[edge] = (below[0], below[1])
    return out


def find_splitters(rows: DataFrame, key: str, goals: list[int], tolerance: float, probes: int = PROBES) -> list[tuple[int, int, bool]]:
    """(splitter, bytes below it, whether rows of one key must be parted) for each goal.

    Refines until the bytes are within tolerance, or one row at most lies between the candidates around the goal, or all
    rows between them have one key; only then must they be parted.
    """
    if not goals:
        return []
    ends = {g: ((LOW, 0, 0), None) for g in goals}
    done: dict[int, tuple[int, int, bool]] = {}
    while todo := [g for g in goals if g not in done]:
        edges = set()
        for g in todo:
            low, high = ends[g][0][0], ends[g][1][0] if ends[g][1] else HIGH
            edges |= {low + (high - low) * i // (probes + 1) for i in range(1, probes + 1)} | {high}
        at = _below(rows, key, sorted(edges - {LOW}))
        for g in todo:
            low, high = ends[g]
            for edge, (size, n) in sorted(at.items()):
                if edge > low[0] and (high is None or edge <= high[0]):
                    if size <= g:
                        low = (edge, size, n)
                    else:
                        high = (edge, size, n)
                        break
            ends[g] = low, high
            best = min((x for x in (low, high) if x), key=lambda x: abs(x[1] - g))
            if abs(best[1] - g) <= tolerance or high and high[2] - low[2] <= 1 or low[0] == HIGH:
                done[g] = (best[0], best[1], False)
            elif high and high[0] - low[0] <= 1:
                done[g] = (low[0], low[1], True)
    return [done[g] for g in goals]


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard, slot, and the columns named in carry.

    size: UTF-8 bytes of the text plus 1; null text counts as none. The law is `bytes`: shards' sizes differ by the
    tolerance and one row at most. A null id sorts as the smallest. Where one hash holds too many bytes (equal texts),
    the splitter goes on within it by a second key, from the id and the place among equal ids. Rows that agree in all
    may fall in either shard. Slots count from 0 in each shard without gaps. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.xxhash64(F.coalesce(F.col(id_col), F.lit(LOW)), F.monotonically_increasing_id()).alias("g"),
        *[F.col(c).alias(f"c_{c}") for c in carry],
    )
    rows = stash(rows)
    total = rows.agg(F.sum("size")).first()[0] or 0
    goals = sorted({total * i // shards for i in range(1, shards)}) if total else []
    allowed = tolerance * total / shards
    firsts = find_splitters(rows, "h", goals, allowed)
    splitters = []
    parted: dict[int, list[int]] = {}
    for goal, (h, below, part) in zip(goals, firsts, strict=True):
        if part:
            parted.setdefault(h, []).append(goal - below)
        else:
            splitters.append((h, LOW))  # between hashes: from h on
    for h, rest in parted.items():
        splitters += [(h, g) for g, _, _ in find_splitters(rows.where(F.col("h") == h), "g", rest, allowed)]
    splitters.sort()
    places = {}
    for h, g in splitters:
        places.setdefault(h, []).append(g)
    marks = np.array(sorted(places), dtype=np.int64)
    first_shard = np.cumsum([0, *(len(places[int(h)]) for h in marks)])
    within = [np.array(places[int(h)], dtype=np.int64) for h in marks]

    @F.pandas_udf("int")
    def shard_of(h: pd.Series, g: pd.Series) -> pd.Series:
        hs, gs = h.to_numpy(), g.to_numpy()
        at = np.searchsorted(marks, hs, side="left")
        out = first_shard[at].astype(np.int32)
        for i, gaps in enumerate(within):
            own = (at == i) & (hs == marks[i])
            out[own] += np.searchsorted(gaps, gs[own], side="right").astype(np.int32)
        return pd.Series(out)

    placed = rows.withColumn("shard", shard_of("h", "g") if len(marks) else F.lit(0))
    placed = stash(placed)  # read twice by the counts
    placed = placed.withColumn("one", F.lit(1)).withColumn("part", F.shiftright("h", 56) * 64 + F.pmod("g", F.lit(64)))
    placed = running_total(placed, ["shard"], "part", ["h", "g"], "one", "slot")
    return placed.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("bigint").alias("slot"), *[F.col(f"c_{c}").alias(c) for c in carry])


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
