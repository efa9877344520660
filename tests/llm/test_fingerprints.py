"""Locally consistent parsing: equal substrings, likeness, and the edited texts against plain Python."""

import hashlib
import itertools
import random

import numpy as np

from keelson.llm import fingerprints

from .util import ODD, near_name_clashes, table

SF = "/root/testdata/sf0.001"


M = 2**64 - 1


def mix(x):
    for _ in range(2):
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & M
    return x ^ x >> 32


def plain_parse(text):
    """The names of all levels from 1 on, of one text, name by name."""
    names, levels = list(text), []
    while not levels or len(levels) < fingerprints.FIRST_LEVEL or len(names) > 1:
        runs = [(n, len(list(own))) for n, own in itertools.groupby(names)]
        labels = [n for n, _ in runs]
        for _ in range(3):
            tossed = []
            for i, x in enumerate(labels):
                differ = x ^ labels[i - 1] if i else 1
                k = (differ & -differ).bit_length() - 1 if differ else 0
                tossed.append(2 * k + (x >> k & 1))
            labels = tossed
        phrases = []
        for i, run in enumerate(runs):
            if not i or 0 < i < len(runs) - 1 and labels[i] > labels[i - 1] and labels[i] > labels[i + 1]:
                phrases.append([])
            phrases[-1].append(run)
        names = [mix(sum(mix(n + c * 0x9E3779B97F4A7C15 & M) * pow(0xD1B54A32D192ED03, i % 1024 + 1, 2**64) for i, (n, c) in enumerate(p)) & M) for p in phrases]
        levels.append(names)
    return levels


def plain_fingerprint(text):
    least = {}
    for level, names in enumerate(plain_parse(text) if text else [], 1):
        for x in (mix(n + level & M) for n in names if level >= fingerprints.FIRST_LEVEL):
            least[x & 63] = min(x >> 32, least.get(x & 63, M))
    return "".join(f"{min(mix(least[k]) & 0xFFFF, 0xFFFE) if k in least else 0xFFFF:04x}" for k in range(64))


def plain_likeness(a, b):
    pairs = [(a[i : i + 4], b[i : i + 4]) for i in range(0, 256, 4) if a[i : i + 4] != "ffff" or b[i : i + 4] != "ffff"]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0


def test_fingerprints_are_the_plain_parse():
    rng = random.Random(8)
    texts = [b"", b"a", b"ab", b"aaa", b"aaab", "é🙂".encode(), b"x" * 5000, b"ab" * 900]
    texts += [bytes(rng.choice(b"abcd ") for _ in range(rng.randrange(2000))) for _ in range(30)]
    texts += [rng.randbytes(rng.randrange(400)) for _ in range(20)]
    assert fingerprints.spelt(fingerprints.sketches(texts)) == [plain_fingerprint(t) for t in texts]
    assert len(plain_parse(rng.randbytes(20_000))) > 5  # the hierarchy goes up to the whole text


def test_interiors_are_cut_alike():
    rng = random.Random(1)
    inner = bytes(rng.randrange(97, 110) for _ in range(4000)) + b"a" * 700 + b"abab" * 100
    sets = []
    for k in range(12):
        names = np.frombuffer(bytes(rng.randrange(97, 123) for _ in range(37 * k)) + inner, dtype=np.uint8).astype(np.uint16)
        doc = np.zeros(len(names), dtype=np.int32)
        for _ in range(2):
            names, doc = fingerprints._level(names, doc)
        sets.append(set(names.tolist()))
    assert all(len(sets[0] - s) <= 6 for s in sets)


def test_phrases_are_short():
    rng = np.random.default_rng(2)
    names = rng.integers(0, 4, 100_000).astype(np.uint16)
    out, doc = fingerprints._level(names, np.zeros(len(names), dtype=np.int32))
    assert len(names) / 9 < len(out) < len(names) / 2


def test_likeness_follows_the_share():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    text = " ".join(word() for _ in range(4000))
    for share in (0.9, 0.5, 0.1):
        n = int(len(text) * share)
        other = " ".join(word() for _ in range(200)) + text[:n] + " ".join(word() for _ in range(int(4000 * (1 - share))))
        a = fingerprints.sketches([text.encode(), other.encode()])
        near = fingerprints.likeness(a[:1], a[1:])[0]
        assert abs(near - share / (2 - share)) < 0.2
    one = fingerprints.sketches([b"", b"", text.encode(), text.encode()])
    assert fingerprints.likeness(one[:2], one[1:3]).tolist() == [1.0, 0.0]
    assert (one[2] == one[3]).all()


def test_fingerprint_documents(spark):
    rows = [r for r in ODD if r[0] != 2] + [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    old, fingerprints.RANGE_BYTES = fingerprints.RANGE_BYTES, 60_000
    try:
        docs = near_name_clashes(table(spark, rows))
        got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs).collect()}
        assert len(got) == len(rows)
        assert fingerprints.fingerprint_documents(docs.limit(0)).count() == 0
        (single,) = fingerprints.fingerprint_documents(table(spark, [(1, "only one")])).collect()
        assert single.near_next == 1.0
        assert fingerprints.fingerprint_documents(table(spark, [ODD[2]] * 3)).count() == 3
    finally:
        fingerprints.RANGE_BYTES = old
    order = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -1))
    for (i, text, *_), (_, after, *_) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        plain = plain_fingerprint if len(text) + len(after) < 3000 else lambda t: fingerprints.spelt(fingerprints.sketches([t]))[0]
        own, other, follow = (plain(t.encode()) for t in (text, edited, after))
        assert r.fingerprint == own and r.edited_fingerprint == other
        assert r.near_edited == plain_likeness(own, other) and r.near_next == plain_likeness(own, follow)
    near = [(r.near_edited, r.near_next) for r in got.values() if r.n_chars > 1000]
    assert np.mean([a > b for a, b in near]) > 0.9 and 0.2 < np.mean([a for a, _ in near]) < 0.6


def test_any_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 300)
    ids = [2**63 - 1, 2**60, 2**53 + 1, 2**53, 7, 0, -5, -(2**62), -(2**63), None]
    rows = [(i, f"document {i} says {i} " * (3 + k)) for k, i in enumerate(ids)]
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(table(spark, rows[::-1])).collect()}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        assert got[i].edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
    many = fingerprints.fingerprint_documents(table(spark, [(None, f"no id {k} " * 9) for k in range(80)])).collect()
    assert len(many) == 80 and len({r.fingerprint for r in many}) == 80
