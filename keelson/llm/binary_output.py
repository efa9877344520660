"""Training-order materialisation: token ids in fixed-stride binary shards.

Documents are numbered by their partition's offset and their place in it, as a first pass counts the sequences that each
partition's texts can need at most (a sequence holds `length` ids, an id is a byte at least). So every sequence has an
ordinal of its own in 0 .. size - 1, whatever ids the documents have. A keyed Feistel network with cycle-walking permutes
these ordinals, and the permuted order is the global order: slots count the sequences that there are along it. Ranges of the
permuted space are the shards, so one exchange brings a shard's sequences together, and a task sorts and writes them at a
fixed stride. Slot s of a shard is at byte s * stride; a reader can start at any slot.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, give_back, remove_path, shared_path, text_or_empty
from .tokens import ByteEncoder, encoder, public_path, row_slices

LENGTH = 512
VOCABULARY = "byte_bpe_50k.tiktoken"
KEY = 0x5EED
ROUNDS = 4
#: UTF-8 bytes of text to a shard, until there are MOST_SHARDS; beyond, shards grow, and a task sorts its own on disk.
SHARD_BYTES, MOST_SHARDS = 32 << 20, 1 << 15
#: The fill of places after a sequence's last id.
PAD = 0xFFFF


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def permute(ordinals: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of 0 .. size - 1: a Feistel network on the next even power of two, walked until inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + i * 0xD1B54A32D192ED03) % 2**64) for i in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & low
        for k in keys:
            left, right = right, left ^ (_mix(right + k) & low)
        return (left << shift) | right

    out = np.asarray(ordinals, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = once(out)
        while (outside := out >= np.uint64(size)).any():
            out[outside] = once(out[outside])
    return out.astype(np.int64)


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _offsets(texts: DataFrame, length: int) -> tuple[dict[int, int], int, int]:
    """The first ordinal of each partition, the number of ordinals, and the texts' bytes; three numbers a partition."""
    size = F.octet_length("text").cast("bigint")
    most = F.floor(size / length) + 1
    found = texts.select(F.spark_partition_id().alias("part"), most.alias("most"), size.alias("size")).groupBy("part").agg(F.sum("most").alias("most"), F.sum("size").alias("size")).orderBy("part").collect()
    first, out = 0, {}
    for r in found:
        out[r["part"]] = first
        first += r["most"]
    return out, first, sum(r["size"] for r in found)


def write_shards(docs: DataFrame, out: str, path: str | None = None, length: int = LENGTH, key: int = KEY, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the shards below out, a folder that all executors share, and return the index, a row for each sequence:
    doc_id, piece, start, n_ids, shard, shard_slot, slot, byte_offset, ids_crc32.

    Null text counts as empty; a document is its ids and the end-of-text id, so every row has a sequence. Ids are 64-bit whole
    numbers of any size, null or repeated; rows are told apart by where they stand, so the order is the same as long as the
    input is read in the same partitions. An empty table writes no shard. A task writes its shard in tmp/ and moves it to
    shards/ when it is whole; a task that is run again finds it there and leaves it. index/ holds the index and manifest/
    the shape, as one line of JSON.
    """
    path = path or public_path(VOCABULARY)
    spark = docs.sparkSession
    tool = encoder(ByteEncoder, path)
    width, end_id = tool.dtype.itemsize, tool.size
    read = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    offsets, size, total = _offsets(read, length)
    shards = max(1, min(-(-total // shard_bytes), MOST_SHARDS))
    share = max(1, -(-size // shards))

    def sequences(batches):
        tool = encoder(ByteEncoder, path)
        end = np.array([end_id], tool.dtype).tobytes()
        step = width * length
        first = offsets.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            for low, high in row_slices(batch.column(1)):
                own, texts = (batch.column(c).slice(low, high - low).to_pylist() for c in (0, 1))
                doc, at, piece, n, ids = [], [], [], [], []
                for d, text, all_ids in zip(own, texts, tool.encode(texts), strict=True):
                    all_ids += end
                    for k, begin in enumerate(range(0, len(all_ids), step)):
                        part = all_ids[begin : begin + step]
                        doc.append(d)
                        at.append(first + k)
                        piece.append(k)
                        n.append(len(part) // width)
                        ids.append(part)
                    first += len(text) // length + 1
                order = permute(np.array(at, dtype=np.uint64) % np.uint64(max(size, 1)), max(size, 1), key)
                yield pa.RecordBatch.from_pydict(
                    {"shard": pa.array(order // share, pa.int32()), "place": order, "doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()), "n_ids": pa.array(n, pa.int32()), "ids": pa.array(ids, pa.binary())}
                )
                give_back()

    def write(batches):
        from pyarrow import fs

        store, folder = _store(out)
        for name in ("tmp", "shards"):
            store.create_dir(f"{folder}/{name}", recursive=True)
        stride, pad = width * length, np.array([PAD], f"<u{width}").tobytes()
        now, sink, names, slot = None, None, None, 0

        def close():
            if sink is not None:
                sink.close()
                if store.get_file_info(names[1]).type == fs.FileType.NotFound:
                    store.move(*names)
                else:
                    store.delete_file(names[0])

        for batch in batches:
            slots, sums = [], []
            for s, part in zip(batch.column(0).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if s != now:
                    close()
                    now, slot = s, 0
                    names = (f"{folder}/tmp/{s:06d}.{np.random.default_rng().integers(2**62)}", f"{folder}/shards/{s:06d}.bin")
                    sink = store.open_output_stream(names[0])
                sink.write(part + pad * ((stride - len(part)) // width))
                slots.append(slot)
                sums.append(zlib.crc32(part))
                slot += 1
            piece = batch.column(3)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(2), "piece": piece, "start": pa.array([p * length for p in piece.to_pylist()], pa.int64()), "n_ids": batch.column(4), "shard": batch.column(0),
                    "shard_slot": pa.array(slots, pa.int64()), "byte_offset": pa.array([x * stride for x in slots], pa.int64()), "ids_crc32": pa.array(sums, pa.int64()),
                }
            )
        close()

    made = read.mapInArrow(sequences, "shard int, place long, doc_id long, piece int, n_ids int, ids binary")
    made = made.repartitionById(shards, "shard").sortWithinPartitions("shard", "place")
    made.mapInArrow(write, "doc_id long, piece int, start long, n_ids int, shard int, shard_slot long, byte_offset long, ids_crc32 long").write.parquet(f"{out}/index")
    remove_path(spark, f"{out}/tmp")  # what attempts that died have left
    index = spark.read.parquet(f"{out}/index")
    per_shard = index.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_shard.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # MOST_SHARDS rows at most
    manifest = json.dumps({"shards": shards, "length": length, "vocabulary": path.rpartition("/")[2], "key": key, "pad": PAD, "bytes_per_id": width})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/manifest")
    return index.join(F.broadcast(bases), "shard").select("doc_id", "piece", "start", "n_ids", "shard", "shard_slot", (F.col("base") + F.col("shard_slot")).alias("slot"), "byte_offset", "ids_crc32")


def read_slots(spark: SparkSession, out: str, shard: int, first: int, count: int) -> np.ndarray:
    """count sequences of a shard from slot first on, as rows of ids: one sequential read, from any slot."""
    shape = json.loads(spark.read.text(f"{out}/manifest").first()[0])
    width, length = shape["bytes_per_id"], shape["length"]
    store, folder = _store(f"{out}/shards")
    with store.open_input_file(f"{folder}/{shard:06d}.bin") as f:
        f.seek(first * length * width)
        return np.frombuffer(f.read(count * length * width), dtype=f"<u{width}").reshape(-1, length)


def op2_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_shards(documents(spark, sf_dir), shared_path(spark, "op2-shards"))
