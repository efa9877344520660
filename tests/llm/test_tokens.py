"""Packing and binary output: ids against the libraries, round trips, best fit against plain Python."""

import bisect
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keelson.llm import binary_output, packing, tokens
from keelson.llm.tokens import ByteEncoder, WordEncoder, encoder, public_path

from .util import ODD, near_name_clashes, table

SF = "/root/testdata/sf0.001"
WIDE = [-(2**63), 2**63 - 1, 1, 2**60, None, None, None, 7, 7]
HARD = ["a<|endoftext|>b <|EndOfText|> <|startoftext|>", "a \n \u00a0 b  c   d\n\n  e ", "x \u2003 \u3000 y", "it's 'tis THEY'LL don''t ''s", "³½ x² a_b-c", "İstanbul ǅ Σας ς", "éÉ́é ﬁ", "<|endoftext|> a", "\x00\x1f\x85a\xa0b c", "😀 hi😀😀", "µ ª º ſ ŉ ĸ", "…—“x”’s €5  \n\n y", "a\xadb", "", " \t\n"]


def plain_ids(texts):
    """Ids of the library as it comes from its file, one text at a time."""
    library = Tokenizer.from_file(public_path(packing.VOCABULARY))
    return [np.asarray(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def test_special_tokens_in_a_text_are_themselves():
    tool = encoder(WordEncoder, public_path(packing.VOCABULARY))
    assert np.frombuffer(tool.encode([b"<|endoftext|> a"])[0], "<u4").tolist() == [49407, 320]


def test_word_ids_are_the_librarys(spark):
    texts = HARD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    tool = encoder(WordEncoder, public_path(packing.VOCABULARY))
    assert tool.fast
    for _ in range(2):
        assert tool.encode([t.encode() for t in texts]) == plain_ids(texts)


def test_byte_ids_are_the_librarys(spark):
    texts = HARD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    tool = encoder(ByteEncoder, public_path(binary_output.VOCABULARY))
    assert [np.frombuffer(x, tool.dtype).tolist() for x in tool.encode([t.encode() for t in texts])] == [tool.library.encode_ordinary(t) for t in texts]


def test_long_texts_are_cut_at_blanks(monkeypatch):
    monkeypatch.setattr(tokens, "AT_ONCE", 50)
    tool = encoder(WordEncoder, public_path(packing.VOCABULARY))
    byte = encoder(ByteEncoder, public_path(binary_output.VOCABULARY))
    texts = ["word and it's " * 40, "x" * 300, "", "short", " \n" * 100, "é" * 40 + " end"]
    assert [np.frombuffer(x, byte.dtype).tolist() for x in byte.encode([t.encode() for t in texts])] == [byte.library.encode_ordinary(t) for t in texts]
    assert tool.encode([t.encode() for t in texts]) == plain_ids(texts)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_ids_of_any_text(text):
    text = text.encode(errors="replace").decode()
    word = encoder(WordEncoder, public_path(packing.VOCABULARY))
    assert word.encode([text.encode()]) == plain_ids([text])
    byte = encoder(ByteEncoder, public_path(binary_output.VOCABULARY))
    assert np.frombuffer(byte.encode([text.encode()])[0], byte.dtype).tolist() == byte.library.encode_ordinary(text)


def best_fit(lengths, capacity):
    """Sequences that best-fit decreasing opens, one piece at a time."""
    rooms, opened = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, n)
        room = rooms.pop(i) if i < len(rooms) else capacity
        opened += room == capacity
        if room - n:
            bisect.insort(rooms, room - n)
    return opened


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_plan_is_best_fit(lengths):
    rules, opened = packing.plan_sequences(dict(Counter(lengths)), 50)
    assert opened == best_fit(lengths, 50)
    used = defaultdict(list)
    ranks = Counter()
    for length, rank, number, first, offset, each in rules:
        assert ranks[length] == rank
        ranks[length] += number
        for k in range(number):
            used[first + k // each].append((offset + k % each * length, length))
    assert ranks == Counter(lengths) and len(used) == opened
    for spans in used.values():
        end = 0
        for at, length in sorted(spans):
            assert at == end
            end += length
        assert end <= 50


def test_pack_documents(spark):
    rows = ODD + [(100 + i, "hot copy of a text") for i in range(300)] + [(1000 + i, "many words " * (i * 7 % 700)) for i in range(80)]
    docs = near_name_clashes(table(spark, rows))
    got = packing.pack_documents(docs, carry=("lang",)).collect()
    want = []
    for (i, *_), ids in zip(rows, plain_ids([r[1] or "" for r in rows]), strict=True):
        ids += bytes(4)
        want += [(i, k, k * 2048, len(p := ids[8192 * k : 8192 * k + 8192]) // 4, zlib.crc32(p)) for k in range(-(-len(ids) // 8192))]
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=str) == sorted(want, key=str)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        end = 0
        for at, length in sorted(spans):
            assert at == end
            end += length
        assert end <= 2048
    assert len(sequences) == best_fit([w[3] for w in want], 2048)
    assert packing.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 4097])
def test_permutation(size):
    out = binary_output.permute(np.arange(size), size)
    assert sorted(out.tolist()) == list(range(size))
    if size > 100:
        assert out.tolist() != binary_output.permute(np.arange(size), size, key=1).tolist()


def test_binary_output(spark, tmp_path):
    rows = ODD + [(100 + i, f"text {i} " * (i * 13 % 400)) for i in range(60)]
    out = str(tmp_path / "out")
    got = binary_output.write_shards(near_name_clashes(table(spark, rows)), out, shard_bytes=100_000).collect()
    tool = encoder(ByteEncoder, public_path(binary_output.VOCABULARY))
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert len({r.shard for r in got}) > 3
    texts = defaultdict(list)
    for r in sorted(got, key=lambda r: (str(r.doc_id), r.piece)):
        (row,) = binary_output.read_slots(spark, out, r.shard, r.shard_slot, 1)
        assert r.byte_offset == r.shard_slot * 1024 and r.start == r.piece * 512
        assert zlib.crc32(row[: r.n_ids].tobytes()) == r.ids_crc32 and (row[r.n_ids :] == binary_output.PAD).all()
        texts[r.doc_id].append(row[: r.n_ids])
    for i, text, *_ in rows:
        if i != 2:
            ids = np.concatenate(texts[i])
            assert ids[-1] == tool.size and tool.decode(ids[:-1]) == (text or "")
    assert [r.slot for r in got if r.doc_id == 2] != []
    again = binary_output.write_shards(near_name_clashes(table(spark, rows)), str(tmp_path / "again"), shard_bytes=100_000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert binary_output.write_shards(table(spark, rows).limit(0), str(tmp_path / "none")).count() == 0


def test_slots_follow_the_permuted_ordinals(spark, tmp_path):
    table(spark, [(i, f"text {i} " * (i * 37 % 900)) for i in range(200)]).repartition(5, "doc_id").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    tool = encoder(ByteEncoder, public_path(binary_output.VOCABULARY))
    ordinals, first = {}, 0
    for part in docs.rdd.glom().collect():
        for r in part:
            n = -(-(len(tool.library.encode_ordinary(r.text)) + 1) // 512)
            ordinals |= {(r.doc_id, k): first + k for k in range(n)}
            first += len(r.text.encode()) // 512 + 1
    order = sorted(ordinals, key=lambda x: int(binary_output.permute(np.array([ordinals[x]]), first)[0]))
    got = binary_output.write_shards(docs, str(tmp_path / "out"), shard_bytes=50_000).collect()
    assert [(r.doc_id, r.piece) for r in sorted(got, key=lambda r: r.slot)] == order


def test_binary_output_of_any_ids(spark, tmp_path):
    rows = [(d, f"{i} words " * 3000) for i, d in enumerate(WIDE)] + [(None, "same text")] * 40
    got = binary_output.write_shards(table(spark, rows), str(tmp_path / "out"), shard_bytes=20_000).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(r[0] for r in rows)
    assert len({r.shard for r in got if r.doc_id is None}) > 3  # rows of one id are parted
    assert not (tmp_path / "out" / "tmp").exists()


def test_packing_of_any_ids(spark):
    rows = [(d, "a word " * 900) for d in WIDE]
    got = packing.pack_documents(table(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
