"""A byte-ordered store's files: bytes written by hand are read, rows written are those bytes, and damage ends a log."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from keelson.plans.schema import TableSchema
from keelson.sources import exchange
from keelson.sources.exchange import DELETED

QUAY = TableSchema.of("quay", "tons int64, dock string, slot int64, ship string", "dock, slot")


def record(dock, slot, tons=None, ship=None, table="quay"):
    """A record byte by byte; without tons and ship, a deletion."""
    key = table.encode() + b"\0\2" + dock.encode().replace(b"\1", b"\1\2").replace(b"\0", b"\1\1") + b"\0\1" + struct.pack(">Q", slot + 2**63) + b"\0"
    value = b"" if ship is None else struct.pack("<qI", tons, len(ship.encode())) + ship.encode()
    return struct.pack("<IIB", len(key), len(value), ship is None) + key + value


def sorted_file(records):
    at = [8 + 8 * len(records) + sum(map(len, records[:k])) for k in range(len(records))]
    return struct.pack(f"<{1 + len(at)}Q", len(at), *at) + b"".join(records)


def log(records):
    return b"".join(struct.pack("<I", zlib.crc32(r)) + r for r in records)


def drawn(rng, n):
    keys = {("".join(rng.choice("\0\1aé") for _ in range(rng.randrange(4))), rng.randrange(-3, 3)) for _ in range(n)}
    return [(dock, slot, rng.choice([0, -(2**63), 2**63 - 1, rng.randrange(99)]), rng.choice(["", "Mole", "\0\1", "é🙂"])) for dock, slot in sorted(keys, key=lambda k: (k[0].encode(), k[1]))]


def test_rows_are_written_and_read_as_bytes(spark, tmp_path):
    rows = drawn(random.Random(1), 60)
    frame = spark.createDataFrame([(t, d, s, h) for d, s, t, h in rows], QUAY.struct()).withColumn(DELETED, F.col("slot") == 2).repartition(3)
    want = [record(d, s, *(() if s == 2 else (t, h))) for d, s, t, h in rows]
    exchange.write_sorted_files(frame, QUAY, str(tmp_path / "one"))
    assert (tmp_path / "one" / "000000").read_bytes() == sorted_file(want)
    exchange.write_log(frame, QUAY, str(tmp_path / "log"), [F.col("dock").desc(), F.col("slot")])
    order = sorted(range(len(rows)), key=lambda i: ([-x for x in rows[i][0].encode()] + [1], rows[i][1]))
    assert (tmp_path / "log" / "000000").read_bytes() == log([want[i] for i in order])
    expected = sorted([(None, d, s, None, True) if s == 2 else (t, d, s, h, False) for d, s, t, h in rows], key=str)
    for got in (exchange.read_sorted_files(spark, QUAY, [str(tmp_path / "one")]), exchange.read_logs(spark, QUAY, [str(tmp_path / "log")])):
        assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == expected


@pytest.mark.parametrize("damage", ["none", "cut head", "cut body", "sum", "empty"])
def test_a_log_ends_before_damage(spark, tmp_path, damage):
    records = [record("n", 1, 5, "Mole"), record("n", 2, 6, "other", table="pier"), record("n", 1), record("s", 3, 7, "Rat")]
    data = log(records)
    last = 4 + len(records[-1])
    data = {"none": data, "cut head": data[: 6 - last], "cut body": data[:-1], "sum": data[:-1] + b"!", "empty": b""}[damage]
    (tmp_path / "log").write_bytes(data)
    got = [(r.dock, r.slot, r.tons, r[DELETED], r["@place"]) for r in exchange.read_logs(spark, QUAY, [str(tmp_path / "log")]).collect()]
    whole = [("n", 1, 5, False, 0), ("n", 1, None, True, 2), ("s", 3, 7, False, 3)]
    assert got == {"none": whole, "empty": []}.get(damage, whole[:2])


def test_a_corrupt_index_is_refused(spark, tmp_path):
    (tmp_path / "bad").write_bytes(struct.pack("<QQ", 1, 3) + record("n", 1, 5, "Mole"))
    with pytest.raises(Exception, match="index is corrupt"):
        exchange.read_sorted_files(spark, QUAY, [str(tmp_path / "bad")]).collect()


def test_a_store_is_adopted_and_exported(make, tmp_path):
    """Two levels and a log, as a dictionary replays them; and back to files of the same rows."""
    rng = random.Random(4)
    model = {}
    old, new = drawn(rng, 40), drawn(rng, 25)
    (tmp_path / "old").write_bytes(sorted_file([record(*r) for r in old]))
    (tmp_path / "new").write_bytes(sorted_file([record(*r[: 2 if i % 4 == 0 else 4]) for i, r in enumerate(new)]))
    changes = [r[: 2 if rng.random() < 0.3 else 4] for r in (*drawn(rng, 20), *drawn(rng, 20))]
    (tmp_path / "log").write_bytes(log([record(*c) for c in changes]) + b"torn")
    for r in (*old, *(r[: 2 if i % 4 == 0 else 4] for i, r in enumerate(new)), *changes):
        model.pop(r[:2], None)
        if len(r) > 2:
            model[r[:2]] = r[2:]
    t = make().adopt(QUAY, [str(tmp_path / "new"), str(tmp_path / "old")], [str(tmp_path / "log")])
    assert {(r.dock, r.slot): (r.tons, r.ship) for r in t.scan().collect()} == model
    t.export(str(tmp_path / "out"))
    assert (tmp_path / "out" / "000000").read_bytes() == sorted_file([record(*k, *model[k]) for k in sorted(model, key=lambda k: (k[0].encode(), k[1]))])
