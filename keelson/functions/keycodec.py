"""Order-preserving byte keys as columns: bytes compare as the key tuples do. Native sort order needs none of this; it
serves exchange with byte-ordered stores, and tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.schema import Kind, TableSchema

#: Tags before each column, by kind (fixed values).
TAGS = {Kind.INT: "01", Kind.TEXT: "02"}


def encode_int(column: Column) -> Column:
    """16 hexadecimal digits: big-endian with the sign bit turned."""
    return F.lpad(F.hex(column.bitwiseXOR(F.lit(-(2**63)))), 16, "0")


def encode_text(column: Column) -> Column:
    """Hexadecimal digits: the bytes 00 and 01 as 01 01 and 01 02, then 00 at the end."""
    pairs = F.regexp_replace(F.hex(column.cast("binary")), "(..)", "$1 ")  # a blank after each byte, to match whole bytes
    escaped = F.replace(F.replace(pairs, F.lit("01 "), F.lit("0102")), F.lit("00 "), F.lit("0101"))
    return F.concat(F.replace(escaped, F.lit(" ")), F.lit("00"))


def encode_key(schema: TableSchema, columns: list[Column] | None = None) -> Column:
    """The key of a row as binary."""
    parts = []
    for i, name in enumerate(schema.key):
        kind = schema.column(name).kind
        column = columns[i] if columns else F.col(f"`{name}`")
        parts += [F.lit(TAGS[kind]), encode_int(column) if kind is Kind.INT else encode_text(column)]
    return F.unhex(F.concat(*parts, F.lit("00")))


def decode_key(schema: TableSchema, key: Column) -> dict[str, Column]:
    """The key columns of a byte key, by name; null if the bytes are no key of this schema."""
    digits = F.hex(key)
    shapes = {Kind.INT: "([0-9A-F]{16})", Kind.TEXT: "((?:(?!00)[0-9A-F]{2})*+)00"}
    pattern = "^" + "".join(TAGS[k] + shapes[k] for k in schema.key_kinds) + "00$"
    out = {}
    for i, (name, kind) in enumerate(zip(schema.key, schema.key_kinds, strict=True), 1):
        part = F.regexp_extract(digits, pattern, i)
        if kind is Kind.INT:
            value = (F.conv(part, 16, 10).cast("decimal(20,0)") - F.lit(str(2**63)).cast("decimal(20,0)")).cast("bigint")
        else:
            pairs = F.regexp_replace(part, "(..)", "$1 ")
            plain = F.replace(F.replace(F.replace(pairs, F.lit("01 01 "), F.lit("00")), F.lit("01 02 "), F.lit("01")), F.lit(" "))
            value = F.unhex(plain).cast("string")
        out[name] = F.when(digits.rlike(pattern), value)
    return out
