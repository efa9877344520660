"""Exchange with byte-ordered key-value stores: their sorted files and logs of changes, read and written as DataFrames.

All numbers are little-endian (fixed values). A sorted file is an index and records in order of key:

    number of records (8 bytes), offset of each record from the file's start (8 each), records

A record is the length of the key (4), that of the value (4), 01 for a deletion or 00 (1), the key and the value. A log is
records, each after the CRC-32 of its bytes (4); a log ends where its bytes do, or before a record that is cut off or
whose sum doesn't hold. Keys are the table's name, 00 and the order-preserving key; values are the columns outside the key,
integers as 8 bytes, strings as a length (4) and their bytes.

A file goes to one task whole, so this is for files of the size that such stores keep, not for a table's own storage.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keycodec import TAGS, encode_key
from ..plans.schema import Kind, TableSchema

_HEAD = struct.Struct("<IIB")
#: Beside the user's columns: deletions, where a record stands in its file, and the file.
DELETED, PLACE, FILE = "@deleted", "@place", "@file"


def little_endian(number: Column, size: int) -> Column:
    """The lowest size bytes of a whole number, lowest first."""
    digits = F.lpad(F.hex(number.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(size)]))


def encode_value(schema: TableSchema) -> Column:
    """The columns outside the key, in order, as binary; empty for null ones, as of deletions."""
    parts = [F.lit(b"")]
    for c in schema.columns:
        if not schema.is_key(c.name):
            column = F.col(f"`{c.name}`")
            text = column.cast("binary")
            parts.append(little_endian(column, 8) if c.kind is Kind.INT else F.concat(little_endian(F.length(text), 4), text))
    return F.coalesce(F.concat(*parts), F.lit(b""))


def encode_record(schema: TableSchema, deleted: Column, summed: bool) -> Column:
    """A row as a record; summed: as it stands in a log."""
    key = F.concat(F.lit(schema.name.encode() + b"\0"), encode_key(schema))
    value = F.when(deleted, F.lit(b"")).otherwise(encode_value(schema))
    record = F.concat(little_endian(F.length(key), 4), little_endian(F.length(value), 4), F.when(deleted, F.lit(b"\1")).otherwise(F.lit(b"\0")), key, value)
    return F.concat(little_endian(F.crc32(record), 4), record) if summed else record


def _decoder(schema: TableSchema):
    """A function: the row of a key and a value in the order of the schema's columns, or None for another table's."""
    prefix = schema.name.encode() + b"\0"
    plain = {name: i for i, name in enumerate(schema.names)}

    def row(key: bytes, value: bytes, deleted: bool) -> list | None:
        if not key.startswith(prefix):
            return None
        out: list = [None] * len(plain)
        at = len(prefix)
        for name, kind in zip(schema.key, schema.key_kinds, strict=True):
            if key[at : at + 1] != bytes.fromhex(TAGS[kind]):
                raise ValueError(f"a key of {schema.name} holds another kind than {name}'s")
            at += 1
            if kind is Kind.INT:
                out[plain[name]] = int.from_bytes(key[at : at + 8], "big") - 2**63
                at += 8
            else:
                end = key.index(b"\0", at)
                out[plain[name]] = key[at:end].replace(b"\1\1", b"\0").replace(b"\1\2", b"\1").decode(errors="replace")
                at = end + 1
        at = 0
        for c in schema.columns:
            if schema.is_key(c.name) or deleted:
                continue
            if c.kind is Kind.INT:
                (out[plain[c.name]],) = struct.unpack_from("<q", value, at)
                at += 8
            else:
                (n,) = struct.unpack_from("<I", value, at)
                out[plain[c.name]] = value[at + 4 : at + 4 + n].decode(errors="replace")
                at += 4 + n
        return out

    return row


def _sorted_records(data: bytes) -> Iterator[tuple[bytes, bytes, bool]]:
    (n,) = struct.unpack_from("<Q", data)
    for at in struct.unpack_from(f"<{n}Q", data, 8):
        if not 8 + 8 * n <= at <= len(data) - _HEAD.size:
            raise ValueError("a sorted file's index is corrupt")
        key, value, deleted = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        yield data[at : at + key], data[at + key : at + key + value], bool(deleted)


def _log_records(data: bytes) -> Iterator[tuple[bytes, bytes, bool]]:
    at = 0
    while at + 4 + _HEAD.size <= len(data):
        (total,) = struct.unpack_from("<I", data, at)
        key, value, deleted = _HEAD.unpack_from(data, at + 4)
        begin, end = at + 4 + _HEAD.size, at + 4 + _HEAD.size + key + value
        if end > len(data) or zlib.crc32(memoryview(data)[at + 4 : end]) != total:
            return
        yield data[begin : begin + key], data[begin + key : end], bool(deleted)
        at = end


def _read(spark: SparkSession, schema: TableSchema, paths: list[str], records) -> DataFrame:
    out = schema.struct(nullable=True).add(DELETED, T.BooleanType()).add(PLACE, T.LongType()).add(FILE, T.StringType())
    types = pa.schema([(c.name, pa.int64() if c.kind is Kind.INT else pa.string()) for c in schema.columns] + [(DELETED, pa.bool_()), (PLACE, pa.int64()), (FILE, pa.string())])

    def parse(batches):
        row = _decoder(schema)
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made = ((row(*r), r[2], n) for n, r in enumerate(records(data)))
                rows = [(*values, deleted, n, path) for values, deleted, n in made if values is not None]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], schema=types)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(parse, out)


def read_sorted_files(spark: SparkSession, schema: TableSchema, paths: list[str]) -> DataFrame:
    """The rows of a table in sorted files, with @deleted, @place and @file. Other tables' records are passed over."""
    return _read(spark, schema, paths, _sorted_records)


def read_logs(spark: SparkSession, schema: TableSchema, paths: list[str]) -> DataFrame:
    """The changes of a table in logs, up to each log's last whole record, with @deleted, @place and @file."""
    return _read(spark, schema, paths, _log_records)


def _blobs(rows: DataFrame, record: Column, order: list[Column], indexed: bool, folder: str) -> None:
    """A file for each partition of rows that has any, named by its number; a task that is run again writes it again. A file
    with an index is held while it is made."""

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        task, written, held = TaskContext.get(), 0, []
        store, at = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        name = f"{at}/{task.partitionId():06d}"
        part, out = f"{name}.{task.taskAttemptId()}.part", None
        for batch in batches:
            records = batch.column(0).to_pylist()
            if records and out is None:
                store.create_dir(at, recursive=True)
                out = store.open_output_stream(part)
            written += len(records)
            if indexed:  # the index stands before the records, so they wait for it
                held += records
            elif records:
                out.write(b"".join(records))
        if indexed and held:
            sizes = [8 + 8 * len(held), *map(len, held)]
            out.write(struct.pack(f"<Q{len(held)}Q", len(held), *list(accumulate(sizes))[:-1]))
            for record in held:
                out.write(record)
        if out is not None:
            out.close()
            store.move(part, name)
        yield pa.RecordBatch.from_pydict({"n": pa.array([written], pa.int64())})

    rows.sortWithinPartitions(*order).select(record.alias("record")).mapInArrow(write, "n long").agg(F.sum("n")).collect()


def write_sorted_files(rows: DataFrame, schema: TableSchema, folder: str, files: int = 1) -> None:
    """rows (distinct by key; user columns, @deleted if there is one) as sorted files, ranges of keys one after the other."""
    key = [F.col(f"`{k}`") for k in schema.key]
    deleted = F.col(f"`{DELETED}`") if DELETED in rows.columns else F.lit(False)
    _blobs(rows.repartitionByRange(files, *key), encode_record(schema, deleted, summed=False), key, True, folder)


def write_log(rows: DataFrame, schema: TableSchema, folder: str, order: list[Column]) -> None:
    """rows as one log, in order."""
    deleted = F.col(f"`{DELETED}`") if DELETED in rows.columns else F.lit(False)
    _blobs(rows.coalesce(1), encode_record(schema, deleted, summed=True), order, False, folder)
