"""Removal of repeated substrings of WIDTH bytes, by blockwise suffix comparison over a content-defined cover.

Suffixes matter to a depth of WIDTH bytes only. A cover sample holds a place for every suffix: of the GRAM-byte strings in
its first WIDTH bytes the one with the least hash. Equal strings of WIDTH bytes have the same place in the sample, so they
meet in the bucket of that place's name. Suffixes in a row that share a place form a unit, and a unit's name is the hash of
all bytes that its strings span. Buckets are settled one by one from names alone:

1. Blocks (ranges of documents) send each distinct unit once. A unit whose name stands earlier is repeated as a whole. A
   place with one name holds nothing else. Only first units of places with several names stay open.
2. For those, blocks send the hash of each of their strings, distinct ones once; the earliest of each stays.

Names are pairs of 64-bit hashes. A task holds a block, or the distinct names of one bucket while what blocks sent to it
streams by in their order; both are bounded, whatever number of blocks share a passage. A block sends a row to each bucket
that it has names for, so there are never more rows than names. (A difference cover by position would do the same, but
samples 9 places of 64 where this samples one of about 30, as README says.)
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Ranges, documents, drop_stash, free_shuffles, give_back, remove_path, shared_path, stash, text_or_empty

WIDTH, GRAM = 100, 40
#: Bytes of text to a block and to a bucket; positions worked on at once.
BLOCK_BYTES, BUCKET_BYTES, AT_ONCE = 4 << 20, 12 << 20, 1 << 18
#: Files of blocks, and partitions of buckets; beyond, they hold several, one after the other.
MOST_FILES = 20_000
_PLACE = np.uint64((1 << 20) - 1)


class _Poly:
    """Hashes of all substrings of a chunk, as polynomials modulo 2**64 over random letters, mixed."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.letters = rng.integers(1, 2**63, 256, dtype=np.uint64)
        base = int(rng.integers(2**62, 2**63)) | 5
        n = AT_ONCE + 2 * WIDTH + 2
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, base, dtype=np.uint64))), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, pow(base, -1, 2**64), dtype=np.uint64))), dtype=np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.letters[data] * self.up[: len(data)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, starts, ends) -> np.ndarray:
        x = sums[ends] - sums[starts]
        x *= self.down[starts]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        return x


_POLY: list[_Poly] = []


def _polys() -> list[_Poly]:
    if not _POLY:
        _POLY.extend((_Poly(1), _Poly(2)))
    return _POLY


class Block:
    """Documents in order, as one buffer with a byte between them."""

    def __init__(self, table: pa.Table):
        ids, ties, texts = (table.column(c).to_pylist() for c in ("doc_id", "tie", "text"))
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, ties[i]))
        self.ids, self.texts = [ids[i] for i in order], [texts[i] for i in order]
        self.data = np.frombuffer(b"\0".join(self.texts) + b"\0" * (2 * WIDTH), dtype=np.uint8)
        sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.begins = np.concatenate(([0], np.cumsum(sizes + 1)))[: len(sizes)]
        self.ends = self.begins + sizes

    def chunks(self):
        """Of each chunk: its first position, the sums of both hashes, and its units: place, first and last suffix."""
        one, two = _polys()
        total = int(self.ends[-1]) if len(self.ends) else 0
        for at in range(0, max(total - WIDTH + 1, 0), AT_ONCE):
            n = min(AT_ONCE, total - WIDTH + 1 - at)
            data = self.data[at : at + n + WIDTH]
            with np.errstate(over="ignore"):
                sums = one.sums(data), two.sums(data)
                grams = one.hashes(sums[0], slice(0, n + WIDTH - GRAM), slice(GRAM, n + WIDTH))
            names = grams
            key = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
            wide, reach = WIDTH - GRAM + 1, 1
            while reach * 2 <= wide:
                key = np.minimum(key[:-reach], key[reach:])
                reach *= 2
            if wide > reach:
                key = np.minimum(key[: -(wide - reach)], key[wide - reach :])
            place = (key[:n] & _PLACE).astype(np.int64)
            starts = np.arange(at, at + n)
            own = np.searchsorted(self.begins, starts, side="right") - 1
            valid = starts + WIDTH <= self.ends[own]
            new = np.empty(n, dtype=bool)
            new[0] = True
            new[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1]) | (own[1:] != own[:-1])
            first = np.nonzero(new)[0]
            last = np.concatenate((first[1:], [n])) - 1
            some = valid[first]
            yield at, sums, names, place[first[some]], first[some], last[some]

    def units(self):
        """Names (two arrays) of all units in order, and their first and last suffixes' positions."""
        parts = []
        _, two = _polys()
        for at, sums, names, place, first, last in self.chunks():
            with np.errstate(over="ignore"):
                whole = two.hashes(sums[1], first, last + WIDTH) + np.uint64(0x9E3779B97F4A7C15) * ((place - first) * 128 + last - first).astype(np.uint64)
            parts.append((names[place], whole, at + first, at + last))
        if not parts:
            return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64))
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    def strings(self, open_first: np.ndarray, open_last: np.ndarray):
        """Names (two arrays) of every string that starts in one of the sorted intervals, and its position."""
        one, two = _polys()
        parts = []
        for at, sums, *_ in self.chunks():
            low, high = np.searchsorted(open_first, [at, at + AT_ONCE])
            if low == high:
                continue
            first, wide = open_first[low:high] - at, open_last[low:high] - open_first[low:high] + 1
            starts = np.repeat(first, wide) + np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
            with np.errstate(over="ignore"):
                parts.append((one.hashes(sums[0], starts, starts + WIDTH), two.hashes(sums[1], starts, starts + WIDTH), at + starts))
        if not parts:
            return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64))
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indexes, in order, of the first of each pair of names."""
    order = np.lexsort((np.arange(len(a)), b, a))
    x, y = a[order], b[order]
    new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(a) else np.zeros(0, dtype=bool)
    return np.sort(order[new])


def _bucket(name: np.ndarray, buckets: int) -> np.ndarray:
    """Names are least hashes, so they crowd at the low end and are mixed again."""
    x = name * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


SENT = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
REPLY = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("codes", pa.binary())])
#: Kinds of replies: codes (1: an equal one stands earlier) of units and of strings; places in a message whose units stay open.
UNITS, STRINGS, OPEN = 1, 2, 3


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _send(block: int, a: np.ndarray, b: np.ndarray, buckets: int) -> pa.Table:
    to = _bucket(a, buckets)
    order = np.argsort(to, kind="stable")
    edges = np.concatenate(([0], np.nonzero(np.diff(to[order]))[0] + 1, [len(to)])) if len(to) else np.zeros(1, dtype=np.int64)
    a, b = a[order], b[order]
    return _table([(block, int(to[order[x]]), a[x:y].tobytes(), b[x:y].tobytes()) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], SENT)


class _Bucket:
    """The distinct names of a bucket so far, sorted, with the message and the place in it that each first stood in."""

    def __init__(self):
        self.a, self.b = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        self.block, self.place = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def take(self, blocks: list[int], a: list[bytes], b: list[bytes]) -> list[bytes]:
        """Codes for further messages, in the order of their blocks."""
        sizes = np.array([len(x) // 8 for x in a])
        both = [np.concatenate((old, np.frombuffer(b"".join(new), dtype=np.uint64))) for old, new in ((self.a, a), (self.b, b))]
        block = np.concatenate((self.block, np.repeat(blocks, sizes)))
        place = np.concatenate((self.place, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)))
        order = np.lexsort((np.arange(len(block)), *both[::-1]))
        x, y = (v[order] for v in both)
        new = np.ones(len(x), dtype=bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        codes = np.ones(len(x), dtype=np.uint8)
        codes[order[new]] = 0
        codes = codes[len(self.a) :].tobytes()
        self.a, self.b, self.block, self.place = x[new], y[new], block[order[new]], place[order[new]]
        ends = np.cumsum(sizes).tolist()
        return [codes[e - n : e] for e, n in zip(ends, sizes.tolist(), strict=True)]

    def open(self) -> list[tuple[int, bytes]]:
        """By block: places in its message of the names that share their first half with others."""
        same = self.a[1:] == self.a[:-1]
        some = np.nonzero(np.concatenate(([False], same)) | np.concatenate((same, [False])))[0] if len(self.a) else np.zeros(0, dtype=np.int64)
        some = some[np.argsort(self.block[some], kind="stable")]
        edges = np.concatenate(([0], np.nonzero(np.diff(self.block[some]))[0] + 1, [len(some)])) if len(some) else np.zeros(1, dtype=np.int64)
        return [(int(self.block[some[x]]), self.place[some[x:y]].astype("<i4").tobytes()) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _settle(batches: Iterator[pa.RecordBatch], kind: int) -> Iterator[pa.Table]:
    """Replies to messages that come sorted by bucket and block."""
    now, bucket = None, _Bucket()

    def close() -> pa.Table:
        return _table([(block, now, OPEN, places) for block, places in bucket.open()], REPLY)

    for batch in batches:
        to = batch.column(1).to_numpy()
        edges = np.concatenate(([0], np.nonzero(np.diff(to))[0] + 1, [len(to)])) if len(to) else np.zeros(1, dtype=np.int64)
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if to[x] != now:
                if kind == UNITS:
                    yield close()
                now, bucket = int(to[x]), _Bucket()
            blocks, a, b = (batch.column(c).slice(x, y - x).to_pylist() for c in (0, 2, 3))
            yield _table([(k, now, kind, codes) for k, codes in zip(blocks, bucket.take(blocks, a, b), strict=True)], REPLY)
        give_back()
    if kind == UNITS:
        yield close()


def _codes(name: np.ndarray, chosen: np.ndarray, replies: pa.Table, kind: int, buckets: int) -> np.ndarray:
    """The code of every item: 1 for those not sent (an equal one stands earlier in the block); 2 for units that stay open."""
    out = np.ones(len(name), dtype=np.uint8)
    to = _bucket(name[chosen], buckets)
    order = np.argsort(to, kind="stable")
    got = sorted(zip(*(replies.column(c).to_pylist() for c in ("kind", "bucket", "codes")), strict=True))
    own = [(k, c) for t, k, c in got if t == kind]
    answers = np.frombuffer(b"".join(c for _, c in own), dtype=np.uint8).copy()
    if kind == UNITS:
        begins = dict(zip((k for k, _ in own), np.cumsum([0, *(len(c) for _, c in own)]).tolist(), strict=False))
        for t, k, places in got:
            if t == OPEN:
                answers[begins[k] + np.frombuffer(places, dtype="<i4")] = 2
    out[chosen[order]] = answers
    return out


def _strings(block: Block, replies: pa.Table, buckets: int):
    """The units' codes with their positions, and the names, positions and chosen ones of the strings of open units."""
    a, b, first, last = block.units()
    codes = _codes(a, _distinct(a, b), replies, UNITS, buckets)
    still = codes == 2
    x, y, at = block.strings(first[still], last[still])
    return codes, first, last, x, at, _distinct(x, y), y


def _runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals joined where they meet."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.concatenate(([True], starts[1:] > ends[:-1])) if len(starts) else np.zeros(0, dtype=bool)
    at = np.nonzero(new)[0]
    return starts[at], ends[np.concatenate((at[1:], [len(starts)])) - 1] if len(at) else ends[:0]


DONE = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())])


def _finished(table: pa.Table, replies: pa.Table, buckets: int, texts: bool) -> pa.Table:
    """The rows of a block's documents, from all replies to it."""
    block = Block(table)
    codes, first, last, x, at, chosen, _ = _strings(block, replies, buckets)
    give_back()
    again = at[_codes(x, chosen, replies, STRINGS, buckets) == 1]
    gone = codes == 1
    starts, ends = _runs(np.concatenate((first[gone], again)), np.concatenate((last[gone], again)) + WIDTH)
    low, high = np.searchsorted(starts, block.begins), np.searchsorted(starts, block.ends)
    rows = []
    for i, (doc, data) in enumerate(zip(block.ids, block.texts, strict=True)):
        x, y = starts[low[i] : high[i]] - block.begins[i], ends[low[i] : high[i]] - block.begins[i]
        edges = [0, *np.column_stack((x, y)).ravel().tolist(), len(data)]
        kept = b"".join(data[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
        rows.append((doc, len(data), len(data) - len(kept), len(x), hashlib.sha256(kept).hexdigest(), [[s, e] for s, e in zip(x.tolist(), y.tolist(), strict=True)], kept if texts else None))
    return _table(rows, DONE)


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and spans (start and end of every removed
    run, in bytes, as a list of pairs); with texts also kept, the remaining bytes.

    Ids are whole numbers. A byte goes if a string of WIDTH bytes that covers it also starts earlier: in a smaller id or, in
    the same row, further left. A null id is the smallest, rows of one id stand in the order of their texts' hash. Null text
    counts as empty. Matches never cross rows. An empty table gives no rows. Texts are laid out once by blocks, as a bucketed
    table in the shared folder, which goes when the result is there or the work has failed; the three passes over it don't
    shuffle texts again.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col).cast("binary")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    sizes = stash(rows.select("doc_id", "tie", (F.octet_length("text") + 1).cast("bigint").alias("size")))
    ranges = Ranges(sizes, BLOCK_BYTES)
    buckets = max(1, -(-ranges.count * BLOCK_BYTES // BUCKET_BYTES))
    files, parts = min(ranges.count, MOST_FILES), min(buckets, MOST_FILES)
    name, path = f"keelson_repeats_{uuid.uuid4().hex}", shared_path(spark, "repeats")
    laid = rows.withColumn("block", ranges.place(F.col("doc_id"), F.col("tie"))).repartition(files, "block")
    sent = "block int, bucket int, a binary, b binary"
    replied = "block int, bucket int, kind int, codes binary"

    def units(key, table):
        a, b, *_ = Block(table).units()
        chosen = _distinct(a, b)
        give_back()
        return _send(key[0].as_py(), a[chosen], b[chosen], buckets)

    def strings(key, table, replies):
        *_, x, _, chosen, y = _strings(Block(table), replies, buckets)
        give_back()
        return _send(key[0].as_py(), x[chosen], y[chosen], buckets)

    def finish(_, table, replies):
        return _finished(table, replies, buckets, texts)

    def settled(rows: DataFrame, kind: int) -> DataFrame:
        """Buckets one after the other in each partition, what blocks sent in their order."""

        def settle(batches):
            for table in _settle(batches, kind):
                yield from table.to_batches()

        return stash(rows.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket", "block").mapInArrow(settle, replied))

    try:
        laid.write.option("path", path).option("compression", "zstd").bucketBy(files, "block").format("parquet").saveAsTable(name)
        free_shuffles(spark)
        store = spark.table(name).groupBy("block")
        one = settled(store.applyInArrow(units, sent), UNITS)
        free_shuffles(spark)
        two = settled(store.cogroup(one.groupBy("block")).applyInArrow(strings, sent), STRINGS)
        free_shuffles(spark)
        made = store.cogroup(one.unionAll(two).groupBy("block")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<bigint>>, kept binary")
        made = stash(made if texts else made.drop("kept"))
        for done in (sizes, one, two):
            drop_stash(done)
        return made
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_path(spark, path)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(documents(spark, sf_dir)).drop("spans")
