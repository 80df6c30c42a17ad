"""Token ids in fixed-width bit-packed files (operator 3).

A folder of token files holds Parquet rows, each one block of whole documents:
its ids packed in as many bits as the vocabulary needs, its documents' sizes,
and its place in its shard.  Shards follow each other in ascending document
id, so a small shard table turns these places into corpus-wide offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wordloom.llm.pretokens import slices
from wordloom.llm.tokens import TextEncoder

BLOCK_SCHEMA = "shard int, block int, first long, n_ids long, bits int, doc_ids array<bigint>, sizes array<bigint>, payload binary"


def bits_for(vocabulary: int) -> int:
    """Bits that every id below ``vocabulary`` fits into."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a little-endian bit stream, ``bits`` bits each."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(payload: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """Ids ``first`` to ``first + count`` of a packed block, without unpacking the rest."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, first * bits // 8).astype("<u4")
    low = first * bits
    raw = np.frombuffer(payload, np.uint8)[low // 8 : (low + count * bits + 7) // 8]
    ones = np.unpackbits(raw, bitorder="little")[low % 8 : low % 8 + count * bits].reshape(count, bits)
    return (ones.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


def write_token_files(
    df: DataFrame, path: str, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 1 << 18, slice_bytes: int = 4_000_000
) -> None:
    """Encode every text and write token files to ``path``, a folder that all executors reach.

    Ids of rows ascend over the files; rows with a null id come first, rows of
    equal id follow each other by text.  A null text counts as empty, and an
    empty text gives the end id alone (nothing without ``end_id``).  A block is
    closed at ``block_ids`` ids; a longer document has a block of its own.
    An empty table gives token files without blocks.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = TextEncoder.of(tokenizer_path)
        bits = bits_for(max(encoder.vocabulary, (end_id or 0) + 1))
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        docs, sizes, held, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal block, first, size
            ids = np.concatenate(held) if held else np.zeros(0, "<u4")
            row = [[shard], [block], [first], [len(ids)], [bits], [list(docs)], [list(sizes)], [pack_bits(ids, bits)]]
            block, first, size = block + 1, first + len(ids), 0
            docs.clear(), sizes.clear(), held.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["shard", "block", "first", "n_ids", "bits", "doc_ids", "sizes", "payload"])

        texts = ((t, i) for b in batches for t, i in zip(b.column("text").to_pylist(), b.column("doc_id").to_pylist(), strict=True))
        for group in slices(texts, slice_bytes):
            ids, counts = encoder.encode([t for t, _ in group], end_id)
            at = 0
            for (_, doc), n in zip(group, counts.tolist(), strict=True):
                if docs and size + n > block_ids:
                    yield close()
                docs.append(doc), sizes.append(n), held.append(ids[at : at + n])
                at, size = at + n, size + n
        if docs:
            yield close()

    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.mode("overwrite").parquet(f"{path}/blocks")
    spark = df.sparkSession
    totals = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row for each shard
    totals.select("shard", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base")).write.mode("overwrite").parquet(f"{path}/shards")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    shards = spark.read.schema("shard int, n_ids long, base long").parquet(f"{path}/shards")
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    # the shard table has one row for each file, so it is small enough to send
    return blocks.join(F.broadcast(shards.select("shard", "base")), "shard").withColumn("first", F.col("first") + F.col("base")).drop("base")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """All documents of token files: doc_id, start, n_tokens, ids (little-endian 32-bit integers)."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                first, n, bits, docs, sizes, payload = (b.column(c)[row].as_py() for c in ("first", "n_ids", "bits", "doc_ids", "sizes", "payload"))
                ids = unpack_bits(payload, bits, 0, n)
                ends = np.cumsum(np.array(sizes, np.int64))
                raw = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32)), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(first + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), raw], ["doc_id", "start", "n_tokens", "ids"])

    return _blocks(spark, path).mapInArrow(unpack, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def read_span(spark: SparkSession, path: str, start: int, count: int) -> np.ndarray:
    """``count`` ids from corpus-wide offset ``start``; only the blocks that hold them are read."""
    hit = _blocks(spark, path).filter((F.col("first") < start + count) & (F.col("first") + F.col("n_ids") > start)).select("first", "n_ids", "bits", "payload")
    parts = []
    for r in sorted(hit.collect()):  # bounded by count
        low, high = max(start, r["first"]), min(start + count, r["first"] + r["n_ids"])
        parts.append(unpack_bits(bytes(r["payload"]), r["bits"], low - r["first"], high - low))
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")
