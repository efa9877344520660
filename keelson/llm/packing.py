"""Best-fit packing in bulk-synchronous rounds.

Lengths run from 1 to the capacity, so documents and gaps, sorted by range, are histograms of at most `capacity` classes,
however many documents there are. A round takes the longest class that is left and sweeps the sorted gap classes for the
successor of its length: the smallest gap that holds it. If more documents than gaps meet, the lower ranks win, and the
rest goes to the next gap class, then to new sequences. Gaps are updated after each match. The rounds give intervals of
ranks, and every piece finds its sequence by its own rank within its length, counted in the partitions.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, give_back, running_total, stash, text_or_empty
from .tokens import WordEncoder, encoder, public_path, row_slices

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
BUCKETS = 1024


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece of each row of docs: doc_id, piece, start, length, ids_crc32, the columns named in carry."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches):
        tool = encoder(WordEncoder, path)
        for batch in batches:
            for first, end in row_slices(batch.column(1)):
                part = batch.slice(first, end - first)
                rows: list[tuple] = []
                source: list[int] = []
                for i, (doc, ids) in enumerate(zip(part.column(0).to_pylist(), tool.encode(part.column(1).to_pylist()), strict=True)):
                    ids += b"\0\0\0\0"
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
                        source.append(i)
                columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
                rest = [part.column(2 + j).take(pa.array(source, pa.int64())) for j in range(len(carry))]
                yield pa.RecordBatch.from_arrays([*columns, *rest], names=[*schema.names, *[f"c_{c}" for c in carry]])
                give_back()

    read = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"), *[F.col(c).alias(f"c_{c}") for c in carry])
    types = dict(docs.dtypes)
    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + "".join(f", `c_{c}` {types[c]}" for c in carry)
    return read.mapInArrow(cut, out)


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rules (length, first rank, number, first sequence, offset, pieces per sequence) and the number of sequences.

    counts: pieces of each length. A gap class holds runs (first sequence, number) of sequences with that much room.
    """
    rules, opened = [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []  # sorted sizes of gap classes that aren't empty

    def put(room: int, first: int, number: int) -> None:
        if room and number:
            if room not in gaps:
                gaps[room] = []
                bisect.insort(rooms, room)
            gaps[room].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                full, rest = divmod(left, each)
                for number, pieces in ((full, each), (1 if rest else 0, rest)):
                    if number:
                        rules.append((length, rank, number * pieces, opened, 0, pieces))
                        put(capacity - pieces * length, opened, number)
                        rank, opened = rank + number * pieces, opened + number
                left = 0
                continue
            room = rooms[i]
            first, number = gaps[room].pop()
            if not gaps[room]:
                del gaps[room], rooms[i]
            used = min(number, left)
            rules.append((length, rank, used, first, capacity - room, 1))
            put(room, first + used, number - used)
            put(room - length, first, used)
            rank, left = rank + used, left - used
    return rules, opened


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset: at most capacity in a sequence, offsets without gaps from 0.

    Lengths must be from 1 to capacity. The driver gets one number per length. An empty table gives no rows.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rules, _ = plan_sequences(counts, capacity)
    rules.sort()
    table = np.array(rules, dtype=np.int64).reshape(-1, 6)
    lengths = table[:, 0]
    spans = {int(n): (int(np.searchsorted(lengths, n)), int(np.searchsorted(lengths, n, side="right"))) for n in np.unique(lengths)}

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        ls, rs = length.to_numpy(), rank.to_numpy()
        at = np.zeros(len(ls), dtype=np.int64)
        for n in np.unique(ls):
            low, high = spans[int(n)]
            own = ls == n
            at[own] = low + np.searchsorted(table[low:high, 1], rs[own], side="right") - 1
        rule, beyond = table[at], rs - table[at, 1]
        return pd.DataFrame({"sequence_id": rule[:, 3] + beyond // rule[:, 5], "offset": rule[:, 4] + beyond % rule[:, 5] * ls})

    ranked = pieces.withColumn("_one", F.lit(1)).withColumn("_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)))
    ranked = running_total(ranked, ["length"], "_bucket", ["doc_id", "piece", "ids_crc32"], "_one", "_rank").withColumn("_place", place("length", "_rank"))
    return ranked.select(*pieces.columns, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the columns named in carry.

    Ids are whole numbers, or null. A document is its text's ids, then id 0; null text counts as empty, so every row of docs has a piece at least.
    Only documents longer than the capacity are cut. Repeated rows are packed each for itself.
    """
    pieces = stash(cut_pieces(docs, path or public_path(VOCABULARY), capacity, id_col, text_col, carry))
    out = pack(pieces, capacity)
    return out.withColumnsRenamed({f"c_{c}": c for c in carry})


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
