"""SimHash: fingerprints and components against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from keelson.llm import simhash

from .util import ODD, near_name_clashes, table

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    known = sorted(root)
    array = np.array(known, dtype=np.uint64)
    for i, p in enumerate(known):
        for j in np.nonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= 4)[0]:
            root[find(known[i + 1 + j])] = find(p)
    return {p: find(p) for p in known}


def test_near_duplicates(spark):
    rng = random.Random(5)
    rows = list(ODD)
    base = [f"w{rng.randrange(400)}" for _ in range(400)]
    for i in range(120):
        words = list(base)
        for _ in range(i % 9):
            words[rng.randrange(len(words))] = "changed"
        rows.append((100 + i, " ".join(words)))
    rows += [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = near_name_clashes(table(spark, rows))
    got = simhash.near_duplicates(docs).collect()
    want = [(i, plain_fingerprint(t)) for i, t, *_ in rows]
    assert sorted([(r.doc_id, r.fingerprint % 2**64) for r in got], key=str) == sorted(want, key=str)
    classes = plain_components({p for _, p in want})
    least = {}
    for i, p in want:
        if i is not None:
            least[classes[p]] = min(i, least.get(classes[p], i))
    assert all(r.component_id == least.get(classes[r.fingerprint % 2**64]) for r in got)
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    want = [least.get(c) for c in set(classes.values())]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("kind", "most", "per_bucket"), [("random", 1 << 15, 1024), ("ball", 1 << 15, 1), ("balls", 1 << 15, 1024), ("zero", 1 << 15, 1024), ("random", 100, 1024), ("ball", 100, 1024), ("balls", 40, 1)])
def test_links_of_fingerprints(spark, monkeypatch, kind, most, per_bucket):
    monkeypatch.setattr(simhash, "MOST", most)  # beyond: other keys, then groups of which every two meet
    monkeypatch.setattr(simhash, "PER_BUCKET", per_bucket)
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(4)]
    if kind == "random":
        prints = {rng.getrandbits(24) for _ in range(3000)}
    elif kind == "zero":
        prints = {0, 1, 2**64 - 1, 2**63, 31, 63}
    else:
        prints = {centres[i % (4 if kind == "balls" else 1)] ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) % 2**64 for i in range(3000)}
    want = plain_components(prints)
    rows = [(p - 2**64 if p >= 2**63 else p, 1) for p in prints]
    trees = simhash.components(simhash.find_links(spark.createDataFrame(rows, "fingerprint long, least long")))
    root = {r.node: r.root for r in trees.collect()}
    got = {p: root.get(q, q) for (q, _), p in zip(rows, prints, strict=True)}
    pairs = {(want[p], got[p]) for p in prints}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_keys_miss_no_link():
    """Fingerprints that differ in 4 bits agree in one key at least, however many fingerprints there are."""
    rng = random.Random(2)
    sizes = []
    for n in (10, 10**6, 10**8, 10**10, 10**12):
        keys = simhash.masks(n)
        sizes.append((len(keys), min(k.bit_count() for k in keys)))
        for bits in (keys, simhash.STRIPES):
            for _ in range(2000):
                apart = sum(1 << b for b in rng.sample(range(64), 4))
                assert any(not apart & k for k in bits)
    assert sizes == [(5, 12), (5, 12), (15, 20), (35, 27), (70, 32)]


def test_hot_fingerprints_and_components(spark, monkeypatch):
    """Many documents of one fingerprint, and many fingerprints of one component, in parts."""
    monkeypatch.setattr(simhash, "HOT", 5)
    rng = random.Random(12)
    base = [f"w{rng.randrange(300)}" for _ in range(300)]
    rows = [(i, None if i % 3 else "") for i in range(40)] + [(100 + i, " ".join([*base[:-1], f"end{i}"])) for i in range(60)] + [(None, "no id " * 5)] * 9 + [(500 + i, f"other {rng.random()}") for i in range(20)]
    want = [(i, plain_fingerprint(t)) for i, t in rows]
    classes = plain_components({p for _, p in want})
    least = {}
    for i, p in want:
        if i is not None:
            least[classes[p]] = min(i, least.get(classes[p], i))
    got = simhash.near_duplicates(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(((i, least.get(classes[p])) for i, p in want), key=str)


def test_bucket_links_across_batches():
    """Buckets that go on over batches, and several in one, as if each stood alone."""
    rng = np.random.default_rng(3)
    bucket = np.sort(rng.integers(0, 40, 3000))
    prints = rng.integers(0, 2**12, 3000, dtype=np.uint64)
    order = np.arange(3000)
    made = []
    for step in (7, 500, 3000):
        batches = [pa.RecordBatch.from_pydict({"bucket": bucket[at : at + step], "fingerprint": prints[at : at + step].view(np.int64)}) for at in order[::step]]
        links = {(a, b) for out in simhash._search(iter(batches)) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)}
        root = {p: p for p in prints.tolist()}

        def find(p):
            while root[p] != p:
                p = root[p]
            return p

        for a, b in links:
            root[find(a)] = find(b)
        groups = {}
        for p in root:
            groups.setdefault(find(p), set()).add(p)
        made.append(sorted(map(sorted, groups.values())))
    assert made[0] == made[1] == made[2]


def test_query(spark):
    got = simhash.op9_simhash(spark, SF)
    assert got.where(~F.col("fingerprint").rlike("^[0-9a-f]{16}$")).count() == 0
