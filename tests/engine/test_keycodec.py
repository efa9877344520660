"""Byte keys: random tuples against Python's order of tuples, and back."""

import random

import pytest
from pyspark.sql import functions as F

from keelson.functions.keycodec import decode_key, encode_key
from keelson.plans.schema import TableSchema

LEAST, MOST = -(2**63), 2**63 - 1


def drawn(seed, n=250):
    """Rows of an integer and two strings that share prefixes, bytes near the codec's own, and each other's ends."""
    rng = random.Random(seed)
    number = lambda: rng.choice([LEAST, MOST, rng.randint(LEAST, MOST), rng.randint(-300, 300)])
    text = lambda: "".join(rng.choice("\x00\x01\x02\x7faz߿\U0001f600") for _ in range(rng.randrange(5)))
    return [(number(), text(), text()) for _ in range(n)]


@pytest.mark.parametrize("key", ["n, s, r", "s, n, r", "r, s, n"])
def test_bytes_order_as_keys(spark, key):
    schema = TableSchema.of("t", "n int64, s string, r string", key)
    rows = drawn(len(key) + ord(key[0]))
    got = spark.createDataFrame(rows, schema.struct()).select("n", "s", "r", encode_key(schema).alias("key")).collect()
    own = lambda row: tuple(v if isinstance(v, int) else v.encode() for v in (row["nsr".index(c)] for c in key.split(", ")))
    assert [own(r[:3]) for r in sorted(got, key=lambda r: bytes(r.key))] == sorted(map(own, rows))


def test_keys_come_back(spark):
    schema = TableSchema.of("t", "n int64, s string, r string", "s, n, r")
    rows = drawn(5)
    frame = spark.createDataFrame(rows, schema.struct()).withColumn("key", encode_key(schema))
    assert [tuple(r) for r in frame.select(*[decode_key(schema, F.col("key"))[n].alias(n) for n in "nsr"]).collect()] == rows
    other = TableSchema.of("u", "n int64", "n")
    assert frame.select(decode_key(other, F.col("key"))["n"]).distinct().collect()[0][0] is None


def test_layout(spark):
    """A tag for each kind, integers with the sign turned, strings with escaped low bytes and an end (fixed values)."""
    schema = TableSchema.of("t", "n int64, s string", "n, s")
    key = spark.createDataFrame([(-2, "\x01q\x00")], "n long, s string").select(encode_key(schema)).first()[0]
    assert bytes(key) == b"\x01" + (2**63 - 2).to_bytes(8, "big") + b"\x02" + b"\x01\x02q\x01\x01" + b"\x00" + b"\x00"
