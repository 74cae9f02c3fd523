"""Token files: frequency-ranked ids in a byte-aligned variable-length coding with separate control bytes.

Ids are replaced by their rank in the corpus, the most frequent first, so that most take one byte. Two bits
a value in the control bytes give its length; the value's bytes follow one another in a stream of their own. Decoding looks
lengths up in a table by control byte and gathers bytes at their running sum, without a loop over values.

A file is a folder of blocks in ascending order of documents, written by Spark's own committer, so a lost executor or
a repeated task leaves no half-written block and any store that Spark can write to will do. A block is one binary
string (header, control bytes, value bytes) beside its documents' ids and lengths; the rank table is a block of its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe
from .common import Workspace, pieces, texts

_MAGIC = b"FLT1"
_HEADER = struct.Struct("<4sQQ")  # magic, values, bytes of values
#: The four lengths that a control byte stands for, lowest bits first.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def encode_block(values: np.ndarray) -> bytes:
    """Values under 2**32 as header, control bytes and value bytes."""
    v = values.astype("<u4")
    size = 1 + (v >= 1 << 8).astype(np.int64) + (v >= 1 << 16) + (v >= 1 << 24)
    code = np.zeros(-len(v) % 4 + len(v), np.uint8)
    code[: len(v)] = size - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    parts = v.view(np.uint8).reshape(-1, 4)
    data = parts[np.arange(4) < size[:, None]]
    return _HEADER.pack(_MAGIC, len(v), len(data)) + control.tobytes() + data.tobytes()


def decode_block(block: bytes) -> np.ndarray:
    magic, n, size = _HEADER.unpack_from(block)
    if magic != _MAGIC or len(block) != _HEADER.size + -(-n // 4) + size:
        raise ValueError("not a block of this format, or cut off")
    control = np.frombuffer(block, np.uint8, -(-n // 4), _HEADER.size)
    data = np.frombuffer(block, np.uint8, size, _HEADER.size + len(control))
    length = _LENGTHS[control].reshape(-1)[:n].astype(np.int64)
    start = np.cumsum(length) - length
    out = data[start].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for i in range(1, 4):
        longer = np.flatnonzero(length > i)
        out[longer] |= data[start[longer] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def _tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Blocks of raw ids in ascending order of documents: (shard, block, within, ids, lengths, n, width, raw); within: ids of the shard before the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, shard = bpe.encoder(path), TaskContext.get().partitionId()
        end, within = struct.pack("<I", end_id), 0
        for block, b in enumerate(pieces(batches, 1024)):
            packed = [p + end for p in e.encode_batch(texts(b, "text"))]
            lengths = [len(p) // 4 for p in packed]
            raw = np.frombuffer(b"".join(packed), "<u4")
            raw = raw.astype("<u2") if raw.max() < 1 << 16 else raw
            row = [[shard], [block], [within], [b.column(0).to_pylist()], [lengths], [sum(lengths)], [raw.dtype.itemsize], [raw.tobytes()]]
            within += sum(lengths)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.list_(b.column(0).type), pa.list_(pa.int32()), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["shard", "block", "within", "ids", "lengths", "n", "width", "raw"])

    kind = docs.schema["id"].dataType.simpleString()
    order = ["id", F.xxhash64("text")]
    return docs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"shard int, block int, within long, ids array<{kind}>, lengths array<int>, n long, width int, raw binary")


def _counts(blocks: DataFrame) -> DataFrame:
    """(token, n) over all blocks, counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for width, raw in zip(b.column("width").to_pylist(), b.column("raw"), strict=True):
                c = np.bincount(np.frombuffer(raw.as_buffer(), f"<u{width}"))
                total = np.pad(total, (0, max(0, len(c) - len(total))))
                total[: len(c)] += c
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["token", "n"])

    return blocks.select("width", "raw").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, appends ``end_id`` and writes the token files to ``folder`` in ascending order of ids.

    Null texts are empty; null ids come first; rows of one id follow one another in the order of their texts' hash. What comes
    to the driver is the rank table, no longer than the vocabulary, and one row for each shard.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "tokens")
    blocks = ws.stage(_tokenized(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), path, end_id), "raw")
    counted = _counts(blocks).collect()
    order = np.array([t for t, _ in sorted(counted, key=lambda r: (-r[1], r[0]))], np.int64)
    rank = np.zeros(int(order.max()) + 1 if len(order) else 0, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    spark.createDataFrame([(bytearray(encode_block(order)),)], "block binary").write.mode("errorifexists").parquet(f"{folder}/ranks")
    # Ids before each shard: one row for each partition of the range, however many rows these have.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded = [encode_block(rank[np.frombuffer(raw.as_buffer(), f"<u{width}")]) for width, raw in zip(b.column("width").to_pylist(), b.column("raw"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("shard", "block", "within", "ids", "lengths")] + [pa.array(coded, pa.binary())], ["shard", "block", "within", "ids", "lengths", "tokens"])

    ids = blocks.schema["ids"].dataType.simpleString()
    coded = blocks.mapInArrow(run, f"shard int, block int, within long, ids {ids}, lengths array<int>, tokens binary").join(F.broadcast(shards), "shard")
    coded = coded.withColumn("start", F.col("before") + F.col("within")).drop("before", "within")
    coded.write.option("compression", "none").mode("errorifexists").parquet(f"{folder}/blocks")
    ws.drop(blocks)


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files alone; with its ids packed as 32-bit integers if asked."""
    table = spark.read.parquet(f"{folder}/ranks").first()
    order = decode_block(bytes(table[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                lengths = np.asarray(b.column("lengths")[i].values, np.int64)
                tokens = order[decode_block(b.column("tokens")[i].as_py())].astype("<u4")
                ends = np.cumsum(lengths)
                raw, at = tokens.tobytes(), (np.append(0, ends) * 4).tolist()
                parts = [raw[p:q] for p, q in zip(at, at[1:], strict=False)]
                columns = [b.column("ids")[i].values, pa.array(ends - lengths + b.column("start")[i].as_py()), pa.array(lengths), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(parts, pa.binary())] * with_ids, ["id", "start", "n_tokens", "ids_crc32"] + ["token_ids"] * with_ids)

    files = spark.read.parquet(f"{folder}/blocks")
    kind = files.schema["ids"].dataType.elementType.simpleString()
    return files.select("ids", "lengths", "tokens", "start").mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long" + ", token_ids binary" * with_ids)
