"""SimHash near-dedup with a Gray-order hierarchical index.

Documents become 64-bit fingerprints; only distinct ones go on. Cut into k + 4 blocks of bits, two fingerprints that differ
in at most 4 bits agree in k blocks. So for every choice of k blocks, all fingerprints are keyed by their bits there: a key's
bucket is a node of the index in which these bits are shared. k grows with the number of fingerprints, so that buckets
don't. A bucket sorts its fingerprints by Gray rank, which brings those that share bits together, and builds a tree over
them: a node keeps the bits that all below it share, as mask and pattern. Pairs of nodes are compared on the way down by the
bits that they share and their parents didn't; the differences add up, and beyond 4 the whole groups are passed over. Links
found are joined into trees within the bucket, so a bucket returns fewer links than it has fingerprints, and connected
components are found over these by alternating stars.

A bucket with too many fingerprints is keyed again by other blocks of bits, and what is still too large is dealt into groups,
of which every two meet in a task of their own.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, drop_rows, drop_stash, give_back, hot_rows, small, stash, text_or_empty

WORDS, SEED = 4, 42
DIFFER = 4
#: Fingerprints to a bucket, as far as bits make it so, and the most that a task takes as one.
PER_BUCKET, MOST = 1 << 10, 1 << 15
FANOUT = 16
#: Documents of one fingerprint, or fingerprints of one component, from which on they are dealt in SALTS parts (less in a
#: small table).
HOT, SALTS = 1 << 16, 64
#: Pairs of nodes or fingerprints compared at once.
AT_ONCE = 1 << 18


def fingerprint(text: bytes) -> int:
    """The contract's fingerprint of a text in UTF-8."""
    words = text.lower().split()  # bytes: lowers A-Z and splits at the six ASCII blanks
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(0, len(words) - WORDS)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: last + 1].tolist(), ends[min(WORDS, len(words)) - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        bits = np.unpackbits(hashes[at : at + AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, raw (the text's xxhash64) and fingerprint (long) of every row. Null text counts as empty."""

    def make(batches):
        for batch in batches:
            made = np.array([fingerprint(t.as_py()) for t in batch.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made)], names=["doc_id", "raw", "fingerprint"])
            give_back()

    read = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("raw"), text_or_empty(text_col).cast("binary").alias("text"))
    return read.mapInArrow(make, "doc_id long, raw long, fingerprint long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in the Gray sequence."""
    out = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class Forest:
    """Union-find over 0 .. n - 1, joined many pairs at a time."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (flat := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = flat


def bucket_links(bucket: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect all fingerprints of the same bucket that chains of DIFFER bits at most connect within it."""
    order = np.lexsort((gray_rank(prints), bucket))
    bucket, prints = bucket[order], prints[order]
    n = len(prints)
    forest = Forest(n)
    differ = lambda a, b: np.bitwise_count(prints[a] ^ prints[b])
    for step in (1, 2, 3, 5, 8):  # neighbours in Gray order first: groups joined whole need no comparison later
        a = np.nonzero(bucket[step:] == bucket[:-step])[0] if n > step else np.array([], dtype=np.int64)
        a = a[differ(a, a + step) <= DIFFER]
        forest.join(a, a + step)
    # levels: first[l][k] is the first node of level l - 1 below node k of level l; level 0 are the fingerprints
    first, own = [], bucket
    both, some = [prints], [prints]
    while len(own) > 1 and (own[1:] == own[:-1]).any():
        begins = np.concatenate(([True], own[1:] != own[:-1]))
        at = np.arange(len(own))
        starts = np.nonzero(begins | ((at - np.maximum.accumulate(np.where(begins, at, 0))) % FANOUT == 0))[0]
        first.append(np.concatenate((starts, [len(own)])))
        both.append(np.bitwise_and.reduceat(both[-1], starts))
        some.append(np.bitwise_or.reduceat(some[-1], starts))
        own = own[starts]
    low, high = [forest.root], [forest.root]
    for edges in first:
        low.append(np.minimum.reduceat(low[-1], edges[:-1]))
        high.append(np.maximum.reduceat(high[-1], edges[:-1]))
    top, every = len(first), np.arange(len(own))
    stack = [(top, every, every, np.zeros(len(own), dtype=np.uint64), np.zeros(len(own), dtype=np.uint8))]
    while stack:
        level, a, b, seen, apart = stack.pop()
        if len(a) > AT_ONCE // FANOUT**2 and level:
            part = AT_ONCE // FANOUT**2
            stack += [(level, *(x[k : k + part] for x in (a, b, seen, apart))) for k in range(0, len(a), part)]
            continue
        if level:
            edges = first[level - 1]
            wide_a, wide_b = edges[a + 1] - edges[a], edges[b + 1] - edges[b]
            count = wide_a * wide_b
            pair = np.repeat(np.arange(len(a)), count)
            inner = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
            a, b = edges[a][pair] + inner // wide_b[pair], edges[b][pair] + inner % wide_b[pair]
            seen, apart, level = seen[pair], apart[pair], level - 1
        keep = a <= b if level else a < b
        a, b, seen, apart = a[keep], b[keep], seen[keep], apart[keep]
        # bits that both nodes share throughout and that haven't been counted above
        shared = ~(both[level][a] ^ some[level][a]) & ~(both[level][b] ^ some[level][b])
        apart = apart + np.bitwise_count((both[level][a] ^ both[level][b]) & shared & ~seen)
        one = (low[level][a] == high[level][b]) & (high[level][a] == low[level][b]) & (low[level][a] == high[level][a])
        keep = (apart <= DIFFER) & ~one
        if level:
            if keep.any():
                stack.append((level, a[keep], b[keep], shared[keep], apart[keep]))
        elif keep.any():
            forest.join(a[keep], b[keep])
    linked = np.nonzero(forest.root != np.arange(n))[0]
    return prints[linked], prints[forest.root[linked]]


def masks(n: int) -> list[int]:
    """Bits of the keys for n fingerprints: of k + DIFFER blocks, every choice of k, with the least k that makes buckets of
    PER_BUCKET if bits are even."""
    for k in range(1, 5):
        edges = [64 * i // (k + DIFFER) for i in range(k + DIFFER + 1)]
        blocks = [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        chosen = [sum(c) for c in combinations(blocks, k)]
        if n >> min(m.bit_count() for m in chosen) < PER_BUCKET:
            break
    return chosen


#: For buckets that are too large: DIFFER + 1 blocks of every fifth bit.
STRIPES = [sum(1 << b for b in range(i, 64, DIFFER + 1)) for i in range(DIFFER + 1)]


def _keyed(rows: DataFrame, bits: list[int], *within: str) -> DataFrame:
    """bucket and fingerprint for every choice of bits; keys are hashed, and buckets that meet by a clash do no harm."""
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint")
    keys = [F.xxhash64(*within, F.lit(i), F.col("fingerprint").bitwiseAND(signed(m))) for i, m in enumerate(bits)]
    return rows.select(F.explode(F.array(*keys)).alias("bucket"), "fingerprint")


def _parted(sent: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of buckets with MOST at most, and rows of others with the bucket's size n; None if there are none."""
    large = stash(sent.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST))
    if not large.take(1):
        return sent, None
    large = small(large)
    return sent.join(large, "bucket", "left_anti"), sent.join(large, "bucket")


def _search(batches):
    """Links within buckets; rows come sorted by bucket, and whole buckets are taken, MOST rows at once or little more."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []

    def found(parts):
        a, b = bucket_links(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).view(np.uint64))
        a, b = a.view(np.int64), b.view(np.int64)
        return pa.RecordBatch.from_pydict({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    for batch in batches:
        bucket, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(bucket):
            continue
        cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
        if cut or kept and kept[-1][0][-1] != bucket[0]:
            kept.append((bucket[:cut], prints[:cut]))
            if sum(len(k[0]) for k in kept) >= MOST:
                yield found(kept)
                kept = []
                give_back()
        kept.append((bucket[cut:], prints[cut:]))
    if kept:
        yield found(kept)


def find_links(distinct: DataFrame) -> DataFrame:
    """Links a, b (a > b as signed longs) between distinct fingerprints, fewer than their number times that of the keys, that
    connect all those that pairs of DIFFER bits at most connect."""
    sent, large = _parted(_keyed(distinct, masks(distinct.count())))
    if large is not None:
        again, large = _parted(_keyed(large, STRIPES, "bucket"))
        sent = sent.unionAll(again)
    if large is not None:
        groups = F.ceil(F.col("n") * 2 / MOST).cast("int")
        dealt = large.withColumn("groups", groups).withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.col("groups")).cast("int"))
        dealt = dealt.select("bucket", "fingerprint", "own", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("other"))
        sent = sent.unionAll(dealt.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "fingerprint"))
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_search, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that is not its component's smallest, by alternating large and small stars."""

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stash(links.where("a <> b").distinct())
    now, before = mark(edges), None
    while now != before:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        less = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        old, edges = edges, stash(less.distinct())
        now, before = mark(edges), now
        drop_stash(old)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, raw, fingerprint (long), component_id, root (the component's smallest fingerprint).

    Ids are whole numbers.     Fingerprints link at DIFFER or fewer differing bits; component_id is the smallest id that links reach. Texts without
    words have fingerprint zero and link like any other. Null ids are passed over in the choice of the smallest; a
    component of null ids only has a null component_id. An empty table gives no rows.
    """
    rows = stash(fingerprints(docs, id_col, text_col))
    distinct = stash(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    trees = components(find_links(distinct))
    placed = distinct.join(trees, distinct["fingerprint"] == trees["node"], "left").select("fingerprint", "least", "n", F.coalesce("root", "fingerprint").alias("root"))
    # most fingerprints are alone; the answers of the others are salted, as one component may hold a third of all
    many = hot_rows(rows.count(), HOT)
    parts = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(n >= many, SALTS - 1).otherwise(0).cast("bigint"))).alias("salt")
    salt = lambda n, *by: F.when(n >= many, F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(0).cast("bigint")
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size")).where("size > 1")
    vast = small(stash(smallest.where(F.col("size") >= many).select("root", "size")))
    placed = placed.join(vast, "root", "left").withColumn("salt", salt(F.coalesce("size", F.lit(0)), "fingerprint")).drop("size")
    classes = placed.join(smallest.select("root", "component_id", parts(F.col("size"))), ["root", "salt"], "left")
    classes = classes.select("fingerprint", "root", "n", F.coalesce("component_id", "least").alias("component_id"))
    # so are documents of one fingerprint
    hot = small(stash(distinct.where(F.col("n") >= many).select("fingerprint", "n")))
    rows = rows.join(hot, "fingerprint", "left").withColumn("salt", salt(F.coalesce("n", F.lit(0)), "doc_id", "raw")).drop("n")
    classes = classes.select("fingerprint", "root", "component_id", parts(F.col("n")))
    return rows.join(classes, ["fingerprint", "salt"]).select("doc_id", "raw", "fingerprint", "component_id", "root")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that with the smallest id; its columns as they are.

    Where that id stands on several rows of the component, one of them stays.
    """
    found = near_duplicates(docs, id_col, text_col)
    place = F.row_number().over(Window.partitionBy("root", "doc_id").orderBy("fingerprint", "raw"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (place == 1)
    lost = found.withColumn("_kept", kept).where(~F.col("_kept")).groupBy("doc_id", "raw").agg(F.count(F.lit(1)).alias("_lost"))
    return drop_rows(docs, lost, id_col, text_col)
