"""Quality classifier: held-out accuracy, exact voting, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import quality

from .util import ODD, near_name_clashes, table

SF = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = quality.op10_quality(spark, SF).collect()
    assert len(got) == 1000 and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    test = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([y == p for y, p in test]) > 0.97
    good, bad = ([r.score for r in got if r.held_out and truth.get(r.doc_id) == y] for y in (1, 0))
    wins = [(a > b) + (a == b) / 2 for a in good for b in bad]
    assert len(wins) > 500 and np.mean(wins) > 0.99, np.mean(wins)  # area under the curve of rows whose labels weren't read


def test_an_id_counts_once(spark):
    docs = table(spark, [(i, f"text {'!' * i} number {i}") for i in range(40)])
    labels = [(i, i % 2) for i in range(40)]
    one = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    two = quality.fit(docs, spark.createDataFrame(labels * 3 + [(100, 0), (100, 1)], "doc_id long, quality int"))
    assert one.share == two.share and np.array_equal(one.vectors, two.vectors)


def test_held_out_labels_are_not_read(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    turned = labels.assign(quality=[1 - q if held(i) else q for i, q in zip(labels.doc_id, labels.quality, strict=True)])
    one, two = (quality.score_documents(docs, spark.createDataFrame(x)).toPandas().sort_values("doc_id").score.to_numpy() for x in (labels, turned))
    assert np.array_equal(one, two)


def test_voting_is_exact():
    rng = np.random.default_rng(1)
    words = [b"alpha", b"BETA!!", b"x", b"12", b"*** ", b"mid. ", b"\xc3\xa9t\xc3\xa9"]
    texts = [b" ".join(words[j] for j in rng.integers(0, 7, 1 + i % 40)) for i in range(300)]
    model = quality.Model(quality.features(texts[:200]), np.arange(200) % 2, 0.7)
    vectors = model._unit((quality.features(texts) * model.idf).astype(np.float32) @ model.basis)
    for text, v in list(zip(texts, vectors, strict=True))[200:]:
        cosines = model.vectors @ v
        near = np.argsort(-cosines)[: quality.NEIGHBOURS]
        votes = cosines[near].clip(1e-3).astype(float) ** quality.POWER * model.weights[near]
        edge = np.sort(cosines)[-quality.NEIGHBOURS - 1 : -quality.NEIGHBOURS + 1]
        if edge[1] - edge[0] > 1e-5:
            assert model.score([text])[0] == pytest.approx((votes * model.labels[near]).sum() / votes.sum(), abs=1e-3)


def test_blocks_add_up():
    text = b"some words in a row, and more. " * 200_000
    assert len(text) > 2 * quality.BYTES_AT_ONCE
    whole, part = quality.features([text])[0], quality.features([text[: quality.BYTES_AT_ONCE // 2]])[0]
    assert np.abs(whole[:-24] - part[:-24]).max() < 0.01


def test_distinct_words_of_a_long_text_are_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(5)
    vocabulary = [f"word{k}".encode() for k in range(40_000)]
    long = b" ".join(vocabulary[k] for k in rng.integers(0, len(vocabulary), 700_000))
    assert len(long) > 2 * quality.BYTES_AT_ONCE
    texts = [b"short one", long, b"", long[:1000]]
    got = quality.features(texts)
    monkeypatch.setattr(quality, "BYTES_AT_ONCE", 1 << 30)
    want = quality.features(texts)
    tent = slice(quality.TERMS - 24, quality.TERMS - 8)
    assert np.array_equal(got[:, tent], want[:, tent])
    assert np.array_equal(got[[0, 2, 3]], want[[0, 2, 3]])


def test_odd_rows(spark):
    rows = [(i + 20 * k if i is not None else None, t, s) for k in range(8) for i, t, s in ODD]
    docs = near_name_clashes(table(spark, rows))
    labels = spark.createDataFrame([(i, 0 if i % 3 else 1, 0) for i in range(150)] + [(None, 1, 0), (3, None, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert quality.score_documents(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}


def test_the_sample_is_drawn_by_hash(spark, monkeypatch):
    """Where labels are many, the fitted rows are those with the least hashes, and as many as the sample."""
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('text ', repeat('a!', cast(id % 50 as int)), ' ', id) as text")
    labels = spark.range(6000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    model = quality.fit(docs, labels, sample=100)
    assert len(model.labels) == 200 and model.labels.sum() == 100
    usable = labels.where(~quality.held_out()).withColumn("h", F.xxhash64(F.lit("quality"), "doc_id")).collect()
    least = {r.doc_id for y in (0, 1) for r in sorted((r for r in usable if r.quality == y), key=lambda r: r.h)[:100]}
    texts = [t for _, t in sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in least)]
    want = quality.Model(quality.features([t.encode() for t in texts]).astype(np.float32).astype(float), model.labels, model.share)
    assert np.allclose(model.vectors, want.vectors, atol=1e-4)
