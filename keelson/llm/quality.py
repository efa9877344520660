"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are triples of character classes, its runs collapsed, and how its words repeat; none depends on a word's
identity, so the classifier sees form and not topic or language. Terms are weighted by rarity and projected to a few
latent dimensions, found by a singular value decomposition of a bounded sample of labelled rows. The sample's terms are counted
where its texts are, and only these counts, TERMS numbers a text at most, come to the driver. The sample's vectors are broadcast;
every document's vector is multiplied with all of them, block by block, and the nearest vote for their labels, weighted by
cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drawn, give_back, stash, text_or_empty

#: Labelled rows fitted on, for each label: the bound of the sample, and so of what is collected and broadcast.
SAMPLE = 2048
TERMS, DIMENSIONS, NEIGHBOURS, POWER = 4096, 48, 15, 8
THRESHOLD = 0.7
#: Documents and bytes taken at once; a longer text goes in blocks of at most that size, cut behind white space. Their counts
#: are added, and their distinct words merged.
ROWS_AT_ONCE, BYTES_AT_ONCE = 256, 1 << 20
#: Rows whose texts are copied at once.
SCORED = 1024
_EXTRA = 24
_BUCKETS = 16

_CLASS = np.full(256, 1, dtype=np.int64)  # letters of other scripts count as lower-case ones
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[:33] = 4
_CLASS[10] = _CLASS[13] = 5
for _i, _c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _CLASS[_c] = 6 + _i
_BLANKS = (9, 10, 11, 12, 13, 32)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(_BLANKS)] = True
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, dtype=np.uint64))
_LETTER = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)


def _blocks(text: bytes) -> Iterator[bytes]:
    """text in blocks; only a word longer than a block is cut."""
    at = 0
    while at < len(text):
        end = at + BYTES_AT_ONCE
        if end < len(text):
            end = max(text.rfind(blank, at, end) for blank in _BLANKS) + 1 or end
        yield text[at:end]
        at = end


def _counts(data: np.ndarray, doc: np.ndarray, n: int, words: dict[int, list[np.ndarray]]) -> np.ndarray:
    """Counts of terms, n rows: data are the bytes of blocks that each end in a newline, doc the row of each byte. The hashes
    of the distinct words of rows in words are added there and not counted."""
    out = np.zeros((n, TERMS))
    if not len(data):
        return out
    kind = _CLASS[data]
    starts = np.nonzero(np.concatenate(([True], (kind[1:] != kind[:-1]) | (doc[1:] != doc[:-1]))))[0]
    long = np.diff(np.concatenate((starts, [len(data)]))) > 1
    code, row = kind[starts] + 40 * (long & (kind[starts] > 4)), doc[starts]
    triple = (code[:-2] * 80 + code[1:-1]) * 80 + code[2:]
    own = row[2:] == row[:-2]
    term = (triple * 2654435761 >> 7) % (TERMS - _EXTRA)
    out += np.bincount((row[2:] * TERMS + term)[own], minlength=n * TERMS).reshape(n, TERMS)

    word = ~_BLANK[data]
    begin = np.nonzero(word & np.concatenate(([True], ~word[:-1] | (doc[1:] != doc[:-1]))))[0]
    if len(begin):
        at = np.arange(len(data)) - np.repeat(begin, np.diff(np.concatenate((begin, [len(data)])))) if begin[0] == 0 else np.arange(len(data)) - np.concatenate((np.zeros(begin[0], dtype=np.int64), np.repeat(begin, np.diff(np.concatenate((begin, [len(data)]))))))
        with np.errstate(over="ignore"):
            value = np.where(word, _LETTER[data] * _POWERS[at & 63], np.uint64(0))
            hashed = np.add.reduceat(value, begin)
        row = doc[begin]
        for k, step in enumerate((1, 2, 3)):
            same = (hashed[step:] == hashed[:-step]) & (row[step:] == row[:-step])
            out[:, TERMS - 1 - k] += np.bincount(row[step:][same], minlength=n)
        order = np.lexsort((hashed, row))
        first = np.concatenate(([True], (hashed[order][1:] != hashed[order][:-1]) | (row[order][1:] != row[order][:-1])))
        hashed, once = hashed[order][first], row[order][first]
        out[:, TERMS - 4] += np.bincount(once, minlength=n)
        for r, found in words.items():
            found.append(hashed[once == r])
            out[r, TERMS - 4] = 0
        out[:, TERMS - 5] += np.bincount(row, minlength=n)
    return out


def features(texts: list[bytes]) -> np.ndarray:
    """Unweighted term vectors: roots of the terms' shares; zero for texts without words."""
    out = np.zeros((len(texts), TERMS))
    blocks: list[tuple[int, bytes]] = []
    words_of: dict[int, list[np.ndarray]] = {i: [] for i, text in enumerate(texts) if len(text) > BYTES_AT_ONCE}
    size = 0

    def flush():
        nonlocal blocks, size
        if blocks:
            data = np.frombuffer(b"".join(b + b"\n" for _, b in blocks), dtype=np.uint8)
            rows = sorted({i for i, _ in blocks})
            local = {i: k for k, i in enumerate(rows)}
            doc = np.repeat([local[i] for i, _ in blocks], [len(b) + 1 for _, b in blocks])
            out[rows] += _counts(data, doc, len(rows), {local[i]: words_of[i] for i in rows if i in words_of})
        blocks, size = [], 0

    for i, text in enumerate(texts):
        for block in _blocks(text):
            blocks.append((i, block))
            size += len(block)
            if size >= BYTES_AT_ONCE:
                flush()
    flush()
    for i, found in words_of.items():
        out[i, TERMS - 4] = len(np.unique(np.concatenate(found))) if found else 0
    words = out[:, TERMS - 5].copy()
    some = words > 0
    share = out[:, TERMS - 4] / np.maximum(words, 1)
    triples = out[:, : TERMS - _EXTRA]
    out[:, : TERMS - _EXTRA] = np.sqrt(triples / np.maximum(triples.sum(axis=1, keepdims=True), 1))
    repeats = out[:, TERMS - 3 :] / np.maximum(words, 1)[:, None]
    out[:, TERMS - _EXTRA :] = 0
    out[:, TERMS - 3 :] = np.sqrt(repeats)
    # the share of distinct words, as a tent over buckets; long texts repeat words by nature, so it is set off by length
    place = np.clip(share * (1 + 0.08 * np.log2(np.maximum(words, 1) / 64).clip(0)), 0, 1) * (_BUCKETS - 1)
    low = np.floor(place).astype(int)
    for k, weight in ((0, 1 - place + low), (1, place - low)):
        out[np.arange(len(texts)), TERMS - _EXTRA + np.minimum(low + k, _BUCKETS - 1)] += 0.35 * np.sqrt(weight)
    return out * some[:, None]


class Model:
    """Latent vectors of the labelled sample, and how to bring others there."""

    def __init__(self, raw: np.ndarray, labels: np.ndarray, share: float):
        """raw: features() of the sample. share: of label 1 among all rows that could have been sampled; votes are weighted so that it holds."""
        self.share = float(share)
        self.labels = labels.astype(np.float64)
        self.idf = np.log((1 + len(raw)) / (1 + (raw > 0).sum(axis=0))) + 0.3
        self.idf[TERMS - _EXTRA :] = 1.0 + 2.0 * (np.arange(_EXTRA) >= _EXTRA - 3)
        x = (raw * self.idf).astype(np.float32)
        rng = np.random.default_rng(11)
        basis = np.linalg.qr(x.T @ (x @ rng.standard_normal((TERMS, DIMENSIONS + 16)).astype(np.float32)))[0]
        for _ in range(3):
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        _, _, turn = np.linalg.svd(x @ basis, full_matrices=False) if len(x) else (0, 0, np.eye(basis.shape[1], dtype=np.float32))
        self.basis = (basis @ turn.T[:, :DIMENSIONS]).astype(np.float32)
        self.vectors = self._unit(x @ self.basis)
        ones = max(self.labels.sum(), 1)
        zeros = max(len(self.labels) - self.labels.sum(), 1)
        self.weights = np.where(self.labels == 1, self.share / ones, (1 - self.share) / zeros) * len(self.labels)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.share)
        for at in range(0, len(texts), ROWS_AT_ONCE):
            x = (features(texts[at : at + ROWS_AT_ONCE]) * self.idf).astype(np.float32) @ self.basis
            known = np.linalg.norm(x, axis=1) > 1e-9
            k = min(NEIGHBOURS, len(self.labels))
            if not known.any() or not k:
                continue
            cosines = self._unit(x[known]) @ self.vectors.T
            near = np.argpartition(cosines, len(self.labels) - k, axis=1)[:, len(self.labels) - k :]
            votes = np.take_along_axis(cosines, near, axis=1).clip(1e-3).astype(np.float64) ** POWER * self.weights[near]
            out[at : at + ROWS_AT_ONCE][known] = (votes * self.labels[near]).sum(axis=1) / votes.sum(axis=1)
        return np.clip(out, 0.0, 1.0)


def held_out(doc_id="doc_id"):
    """True for rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of at most sample rows of each label, those with the smallest keyed hash of their id. Rows held out are not
    read; rows without id, label or document don't count, nor do ids that have both labels; of repeated ids one does. Without
    labels scores are 0.5."""
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    usable = stash(usable.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other"))
    n = {0: 0, 1: 0} | {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    share = n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.5
    key = F.xxhash64(F.lit("quality"), "doc_id")

    def by_hash(label: int) -> DataFrame:
        """The sample rows of a label with the least hashes; twice as many are drawn first, where they are."""
        return usable.where((F.col("label") == label) & drawn(key, 2 * sample, n[label])).orderBy(key, "doc_id").limit(sample)

    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    rows = texts.join(F.broadcast(by_hash(0).unionAll(by_hash(1))), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    @F.pandas_udf("struct<at:binary,value:binary>")
    def terms(texts: pd.Series) -> pd.DataFrame:
        made = [features([bytes(t)])[0].astype(np.float32) for t in texts]
        return pd.DataFrame({"at": [np.nonzero(x)[0].astype("<u2").tobytes() for x in made], "value": [x[x != 0].astype("<f4").tobytes() for x in made]})

    got = sorted(rows.select("doc_id", "label", terms("text").alias("terms")).collect(), key=lambda r: r["doc_id"])  # 2 * sample rows at most
    raw = np.zeros((len(got), TERMS))
    for x, r in zip(raw, got, strict=True):
        x[np.frombuffer(r["terms"]["at"], "<u2")] = np.frombuffer(r["terms"]["value"], "<f4")
    return Model(raw, np.array([r["label"] for r in got]), share)


def scorer(spark: SparkSession, model: Model):
    """A column function: the score of a text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        parts = [shared.value.score([bytes(t) for t in texts.iloc[at : at + SCORED]]) for at in range(0, len(texts), SCORED)]
        give_back()
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return lambda text: score(text_or_empty(text).cast("binary"))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. Null text counts as empty; texts without words get the
    share of label 1. A null id is not held out. An empty table gives no rows."""
    score = scorer(docs.sparkSession, fit(docs, labels, id_col, text_col))
    out = docs.select(F.col(id_col).alias("doc_id"), score(text_col).alias("score"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that the classifier rejects; its columns as they are."""
    score = scorer(docs.sparkSession, fit(docs, labels, id_col, text_col))
    return docs.where(score(text_col) >= THRESHOLD)
