"""The pipeline's stages against plain Python, each on what its predecessor kept."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from keelson.llm import mixing, quality

from .test_native import expected_dedup
from .test_simhash import plain_components, plain_fingerprint
from .test_tokens import best_fit, plain_ids
from .util import ODD, near_name_clashes, table

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        assert k == 4 or docs.columns == columns
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.collect())
    good, distinct, unlike, mixed, packed = kept
    predicted = {r.doc_id for r in quality.op10_quality(spark, SF).collect() if r.predicted}
    assert {r.doc_id for r in good} == predicted and len(good) == len(predicted)
    assert sorted(r.doc_id for r in distinct) == sorted({keep for _, keep, *_ in expected_dedup([(r.doc_id, r.text) for r in good])})
    prints = {r.doc_id: plain_fingerprint(r.text) for r in distinct}
    classes = plain_components(set(prints.values()))
    least = {}
    for i, p in prints.items():
        least[classes[p]] = min(i, least.get(classes[p], i))
    assert sorted(r.doc_id for r in unlike) == sorted(least.values())
    copies = Counter(r.doc_id for r in mixed)
    told = mixing.mix_sources(spark.read.parquet(str(tmp_path / "2")), cut=False).collect()
    assert copies == Counter({r.doc_id: r.copies for r in told if r.copies})
    sizes = Counter()
    for r in told:
        sizes[r.source] += r.size * copies[r.doc_id]
    for r in told:
        assert abs(sizes[r.source] - r.target) <= max(x.size for x in told if x.source == r.source)
    lengths = []
    for ids in plain_ids([r.text for r in mixed]):
        n = len(ids) // 4 + 1
        lengths += [min(2048, n - at) for at in range(0, n, 2048)]
    assert Counter(r.length for r in packed) == Counter(lengths)
    assert len({r.sequence_id for r in packed}) == best_fit(lengths, 2048)
    spans = defaultdict(list)
    for r in packed:
        spans[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in own) <= 2048 for own in spans.values())
    whole = corpus_pipeline.run(spark, SF)
    assert whole.columns == spark.read.parquet(str(tmp_path / "4")).columns and whole.count() == len(packed)


def test_mix_of_odd_rows(spark):
    rows = ODD + [(50, "same row of words", "a")] * 5
    docs = near_name_clashes(table(spark, rows))
    out = mixing.take_mix(docs)
    assert out.columns == docs.columns
    copies = sum(r.copies for r in mixing.mix_sources(docs, cut=False).collect())
    assert out.count() == copies
    assert mixing.take_mix(docs.limit(0)).count() == 0
    assert max(r["count"] for r in out.where(F.col("doc_id") != 2).groupBy("doc_id", "text").count().collect()) <= 10
