"""Document fingerprints by locally consistent parsing.

A text's bytes are names of level 0. At each level runs of one name are collapsed, deterministic coin tossing gives every
name a small label from the lowest bit in which it differs from its left neighbour, three times over, and the local
maxima of the labels cut the level into phrases. Cuts depend on a few names around them and on no position, so equal
substrings are cut alike in their interior wherever they stand. A phrase's name is the hash of its names, and the phrases
are the next level's names, until a text is one phrase. The names of all levels from FIRST_LEVEL on are the set that a
fingerprint stands for: BINS minima of 16 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Ranges, documents, give_back, stash, text_or_empty

BINS, EMPTY = 64, 0xFFFF
#: The lowest level whose names are in the set: phrases of about 12 bytes; each further level's are some three times as long.
FIRST_LEVEL = 2
ROUNDS = 3
#: Bytes parsed at once (a longer text goes whole, alone), and bytes of text to a range of ids.
AT_ONCE, RANGE_BYTES = 1 << 21, 8 << 20
#: Partitions; beyond, they hold several ranges, one after the other.
MOST_PARTS = 20_000

_ONE, _ODD = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)
_LOWEST = np.zeros(1 << 16, dtype=np.uint8)
for _k in range(15, -1, -1):
    _LOWEST[1 << _k :: 1 << (_k + 1)] = _k
_POWERS = np.cumprod(np.full(1 << 10, 0xD1B54A32D192ED03, dtype=np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _toss(x: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Labels by deterministic coin tossing; fresh marks names without a left neighbour."""
    differ = np.empty_like(x)
    differ[0] = 1
    np.bitwise_xor(x[1:], x[:-1], out=differ[1:])
    differ[fresh] = 1
    if x.dtype == np.uint64:
        differ[differ == 0] = 1
        k = np.bitwise_count((differ & (~differ + _ONE)) - _ONE)
        bit = ((x >> k.astype(np.uint64)) & _ONE).astype(np.uint8)
    else:
        k = _LOWEST[differ]
        bit = ((x >> k) & 1).astype(np.uint8)
    return (k << 1) | bit


def _level(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level's names and their documents."""
    change = np.empty(len(names), dtype=bool)
    change[0] = True
    np.not_equal(names[1:], names[:-1], out=change[1:])
    change[1:] |= doc[1:] != doc[:-1]
    at = np.nonzero(change)[0]
    runs = np.diff(np.concatenate((at, [len(names)])))
    doc, names = doc[at], names[at]
    fresh = np.empty(len(doc), dtype=bool)
    fresh[0] = True
    np.not_equal(doc[1:], doc[:-1], out=fresh[1:])
    labels = names
    for _ in range(ROUNDS):
        labels = _toss(labels.astype(np.uint16) if labels.dtype == np.uint8 else labels, fresh)
    cut = fresh.copy()
    cut[1:-1] |= (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:]) & ~fresh[2:]
    starts = np.nonzero(cut)[0]
    place = np.arange(len(doc)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(doc)]))))
    with np.errstate(over="ignore"):
        whole = _mix(names.astype(np.uint64) + runs.astype(np.uint64) * _ODD) * _POWERS[place & 1023]
        return _mix(np.add.reduceat(whole, starts)), doc[starts]


def sketches(texts: list[bytes]) -> np.ndarray:
    """BINS numbers for each text: equal texts give equal ones; a text without bytes has EMPTY in all."""
    out = np.full((len(texts), BINS), EMPTY, dtype=np.uint16)
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= AT_ONCE):
            size += len(texts[last])
            last += 1
        names = np.frombuffer(b"".join(texts[first:last]), dtype=np.uint8).astype(np.uint16)
        doc = np.repeat(np.arange(last - first, dtype=np.int32), [len(t) for t in texts[first:last]])
        keys = []
        level = 0
        while len(names):
            names, doc = _level(names, doc)
            level += 1
            if level >= FIRST_LEVEL:
                with np.errstate(over="ignore"):
                    mixed = _mix(names + np.uint64(level))
                keys.append(((doc.astype(np.uint64) * np.uint64(BINS) + (mixed & np.uint64(BINS - 1))) << np.uint64(32)) | (mixed >> np.uint64(32)))
                own = np.concatenate(([True], doc[1:] != doc[:-1], [True]))
                more = ~(own[:-1] & own[1:])  # a text of one phrase is done
                names, doc = names[more], doc[more]
        if keys:
            keys = np.sort(np.concatenate(keys))
            cell = keys >> np.uint64(32)
            least = np.concatenate(([True], cell[1:] != cell[:-1]))
            value = np.minimum(_mix(keys[least] & np.uint64(0xFFFFFFFF)) & np.uint64(0xFFFF), np.uint64(EMPTY - 1)).astype(np.uint16)
            out[first:last].reshape(-1)[cell[least].astype(np.int64)] = value
        first = last
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of bins, of those used by either, in which the rows of two sketches agree; 1 for two empty ones."""
    used = (a != EMPTY) | (b != EMPTY)
    n = used.sum(axis=1)
    return np.where(n == 0, 1.0, ((a == b) & used).sum(axis=1) / np.maximum(n, 1))


def spelt(sketch: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in sketch.astype(">u2")]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compared(ids: list, texts: list[bytes], after: list[bytes]) -> pa.RecordBatch:
    """Rows for documents and the texts of those that come next."""
    plain, coming = [t.decode(errors="replace") for t in texts], [t.decode(errors="replace") for t in after]
    edited = [(a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode() for a, b in zip(plain, coming, strict=True)]
    own = sketches([*texts, after[-1]])
    where = {id(t): i for i, t in enumerate(texts)}
    follow = own[[where.get(id(b), len(texts)) for b in after]]
    own, changed = own[:-1], sketches(edited)
    columns = [ids, [len(t) for t in plain], [hashlib.sha256(e).hexdigest() for e in edited], spelt(own), spelt(changed), likeness(own, changed), likeness(own, follow)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)


def _pairs(batches):
    """Batches of (part, edge, doc_id, tie, text) in order, the last row of a part being the first of the next: rows compared."""
    part, ids, texts, size = None, [], [], 0

    for batch in batches:
        for b, d, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
            if b != part or size >= AT_ONCE:
                if len(ids) > 1:
                    yield _compared(ids[:-1], texts[:-1], texts[1:])
                ids, texts = ([], []) if b != part else (ids[-1:], texts[-1:])
                part, size = b, sum(map(len, texts))
            ids.append(d)
            texts.append(t)
            size += len(t)
        give_back()
    if len(ids) > 1:
        yield _compared(ids[:-1], texts[:-1], texts[1:])


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Ids are whole numbers. Documents stand in descending order of id, null ids last, rows of one id by their texts' hash; the
    next of the last is the first, and that of a single one itself. Null text counts as empty; the fingerprint of an empty
    text is all f. A partition holds ranges of ids of about as many bytes each, one document after the other, and the first
    one of the next partition: MOST_PARTS such documents at most are looked up by a broadcast of their ids. An empty table
    gives no rows.
    """
    text = text_or_empty(text_col).cast("binary")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    sizes = stash(rows.select("doc_id", "tie", (F.octet_length("text") + 1).cast("bigint").alias("size")))
    ranges = Ranges(sizes, RANGE_BYTES)
    parts = min(ranges.count, MOST_PARTS)
    part = F.floor((F.lit(ranges.count - 1) - ranges.place(F.col("doc_id"), F.col("tie"))).cast("bigint") * parts / ranges.count).cast("int")
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")
    heads = sizes.select(part.alias("part"), order.alias("head")).groupBy("part").agg(F.max("head").alias("head"))
    by_part = Window.orderBy("part")  # one row for each partition
    before = F.coalesce(F.lag("part").over(by_part), F.max("part").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    edge = heads.select(before.alias("to"), F.col("head.doc_id").alias("head_id"), F.col("head.tie").alias("head_tie"))
    same = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    ends = rows.join(F.broadcast(edge), same).groupBy("to", "doc_id", "tie").agg(F.min("text").alias("text"))  # one row to a partition
    whole = rows.select(part.alias("part"), F.lit(0).alias("edge"), "doc_id", "tie", "text").unionAll(ends.select(F.col("to").alias("part"), F.lit(1).alias("edge"), "doc_id", "tie", "text"))
    whole = whole.repartitionById(parts, "part").sortWithinPartitions("part", "edge", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    return whole.mapInArrow(_pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))
