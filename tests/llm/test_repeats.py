"""Repeated substrings against plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from keelson.llm import common, repeats

from .util import ODD, near_name_clashes, table

SF = "/root/testdata/sf0.001"


def plain(rows):
    """rows: (doc_id, bytes) in order of id."""
    seen, out = set(), {}
    for i, data in rows:
        gone = bytearray(len(data))
        for at in range(len(data) - 99):
            s = data[at : at + 100]
            if s in seen:
                gone[at : at + 100] = b"\1" * 100
            else:
                seen.add(s)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.setdefault(i, []).append((len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def planted(rng):
    letters = "abcdefghij klmnop"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [make(n) for n in (99, 100, 101, 150, 260, 1000)]
    rows = []
    for i in range(150):
        text = make(rng.randrange(300))
        for _ in range(rng.randrange(4)):
            part = rng.choice(shared)
            cut = rng.randrange(40)
            text += part[cut:] if rng.random() < 0.3 else part
            text += make(rng.randrange(60))
        rows.append((i * 3, text))
    rows += [(1000 + i, "ab" * 300 + make(5)) for i in range(4)]
    rows += [(2000 + i, "é" * 90 + make(10)) for i in range(3)]
    near = make(800)
    for i in range(25):
        at = rng.randrange(800)
        rows.append((3000 + i, near[:at] + "#" + near[at + 1 :]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_find_repeats(spark, seed, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 9_000)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 30_000)
    monkeypatch.setattr(repeats, "MOST_FILES", (3, 20_000)[seed - 1])  # several blocks to a file, several buckets to a partition
    rng = random.Random(seed)
    rows = planted(rng) + [(r[0] and r[0] + 5000, r[1][:5000] if r[1] else r[1]) for r in ODD if r[0] != 2] + [(7000 + i, ODD[9][1][:3000]) for i in range(3)]
    rng.shuffle(rows)
    docs = near_name_clashes(table(spark, rows))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.find_repeats(docs).collect()}
    want = plain(sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0)))
    assert len(got) == len(want)
    for i, [w] in want.items():
        assert got[i] == w, i


def test_documents_and_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 60_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain(sorted((r.doc_id, r.text.encode()) for r in docs.collect()))
    for r in repeats.find_repeats(docs, texts=True).collect():
        assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)] == want[r.doc_id]
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.spans) == r.n_spans
    assert repeats.find_repeats(docs.limit(0)).count() == 0
    repeated = repeats.find_repeats(table(spark, [ODD[9]] * 3)).collect()
    assert sum(r.n_removed == r.n_bytes for r in repeated) == 2


def test_any_ids(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 3_000)
    rng = random.Random(3)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(400))
    ids = [-(2**63), -(2**62), -5, 0, 2**53, 2**53 + 1, 2**60, 2**63 - 1]
    rows = [(i, shared[rng.randrange(200) :] + f" own {i} " * 20) for i in ids]
    want = plain([(i, t.encode()) for i, t in rows])
    got = repeats.find_repeats(table(spark, rows[::-1])).collect()
    assert {r.doc_id: [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)] for r in got} == want
    nulls = repeats.find_repeats(table(spark, [(None, shared)] * 30 + rows)).collect()
    assert len(nulls) == 30 + len(rows) and sum(r.n_removed == 0 for r in nulls) == 1


def test_buckets_are_even(spark):
    """Names are least hashes; each of many buckets gets about its share of them all the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    made = pa.table({"doc_id": [r.doc_id for r in docs], "tie": [0] * len(docs), "text": [r.text.encode() for r in docs]})
    a, b, *_ = repeats.Block(made).units()
    chosen = repeats._distinct(a, b)
    counts = np.bincount(repeats._bucket(a[chosen], 40), minlength=40)
    assert len(chosen) > 5000 and counts.max() < 1.5 * counts.mean()


def test_a_bucket_that_streams_is_one_that_does_not(spark):
    """Codes of a bucket don't depend on how its messages are batched."""
    rng = np.random.default_rng(4)
    messages = [(k, rng.integers(0, 30, n, dtype=np.uint64).tobytes(), rng.integers(0, 3, n, dtype=np.uint64).tobytes()) for k, n in enumerate(rng.integers(1, 40, 25).tolist())]
    results = []
    for step in (1, 7, 25):
        bucket, codes = repeats._Bucket(), []
        for at in range(0, 25, step):
            codes += bucket.take(*map(list, zip(*messages[at : at + step], strict=True)))
        results.append((codes, bucket.open()))
    assert results[0] == results[1] == results[2]
    seen, places = {}, {}
    for (k, a, b), codes in zip(messages, results[0][0], strict=True):
        for i, name in enumerate(zip(np.frombuffer(a, np.uint64).tolist(), np.frombuffer(b, np.uint64).tolist(), strict=True)):
            assert codes[i] == (name in seen)
            seen.setdefault(name, (k, i))
            places.setdefault(name[0], set()).add(name)
    want = sorted(seen[n] for own in places.values() if len(own) > 1 for n in own)
    assert sorted((k, i) for k, p in results[0][1] for i in np.frombuffer(p, "<i4").tolist()) == want


def test_ranges_hold_like_bytes(spark):
    """Ids in a few clusters, one id and no id with a third of the rows each: ranges in order, none much above its bytes."""
    rng = random.Random(6)
    ids = [None] * 1000 + [77] * 1000 + [2**62 + 3] * 500 + [rng.choice([-(2**63), 10**6, 10**12, 2**62, 2**63 - 400]) + rng.randrange(400) for _ in range(1000)]
    rows = spark.createDataFrame([(i, rng.randrange(-(2**63), 2**63), rng.randrange(1, 200)) for i in ids], "doc_id long, tie long, size long")
    ranges = common.Ranges(rows, 3000)
    got = rows.withColumn("at", ranges.place(F.col("doc_id"), F.col("tie"))).collect()
    order = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie))
    assert [r.at for r in order] == sorted(r.at for r in got)
    sums = Counter()
    for r in got:
        sums[r.at] += r.size
    assert max(sums.values()) < 3 * 3000 and max(sums) < ranges.count
    assert common.Ranges(rows.limit(0), 3000).count == 1


def test_nothing_stays_behind(spark, monkeypatch):
    def fail(*_):
        raise ValueError("nothing can be stashed")

    before = {t.name for t in spark.catalog.listTables()}
    made = repeats.find_repeats(table(spark, ODD[:3]))
    assert made.count() == 3 and {t.name for t in spark.catalog.listTables()} == before
    calls = iter((repeats.stash, repeats.stash))
    monkeypatch.setattr(repeats, "stash", lambda df: next(calls, fail)(df))
    with pytest.raises(ValueError, match="nothing can be stashed"):
        repeats.find_repeats(table(spark, ODD[:3]))
    assert {t.name for t in spark.catalog.listTables()} == before


def settled_here(sent, kind):
    """_settle() over what blocks sent, by block."""
    rows = sorted((r for t in sent for r in zip(*(t.column(c).to_pylist() for c in range(4)), strict=True)), key=lambda r: (r[1], r[0]))
    made = pa.concat_tables(repeats._settle(repeats._table(rows, repeats.SENT).to_batches(max_chunksize=5), kind))
    return lambda block: made.filter(pc.equal(made.column("block"), block))


def test_chunk_borders(monkeypatch):
    """All three passes in one process, with chunks so short that units and matches are cut at their borders."""
    monkeypatch.setattr(repeats, "AT_ONCE", 997)
    monkeypatch.setattr(repeats, "_POLY", [])
    rows = [(i, t.encode()) for i, t in planted(random.Random(9))]
    blocks = [rows[k : k + 20] for k in range(0, len(rows), 20)]
    tables = [pa.table({"doc_id": [i for i, _ in b], "tie": [0] * len(b), "text": [t for _, t in b]}) for b in blocks]
    sent = []
    for k, t in enumerate(tables):
        a, b, *_ = repeats.Block(t).units()
        chosen = repeats._distinct(a, b)
        sent.append(repeats._send(k, a[chosen], b[chosen], 7))
    one, sent = settled_here(sent, repeats.UNITS), []
    for k, t in enumerate(tables):
        *_, x, _, chosen, y = repeats._strings(repeats.Block(t), one(k), 7)
        sent.append(repeats._send(k, x[chosen], y[chosen], 7))
    two = settled_here(sent, repeats.STRINGS)
    want = plain(rows)
    for k, t in enumerate(tables):
        for r in repeats._finished(t, pa.concat_tables([one(k), two(k)]), 7, False).to_pylist():
            assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])] == want[r["doc_id"]]
