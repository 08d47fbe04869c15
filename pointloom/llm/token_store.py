"""Token-ID output: documents to patched frame-of-reference shards and back.

``write_tokens`` deals the documents out by ranges of doc_id, sorts each range,
encodes it and writes shards of whole documents, so that shards in the order of
(range, shard number) hold all documents in ascending doc_id order.
``read_tokens`` decodes them again.

Defined cases: a null text counts as empty and holds the end id alone; a null
doc_id comes first; rows with one doc_id are ordered by their text and each is
written; other columns, whatever their names, are not read; an empty table
gives an empty store. One document may be longer than a shard's target; it
gets a shard of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import common, pfor, word_bpe

END_ID = 2
#: A shard closes once it holds as many ids.
SHARD_IDS = 1 << 20
_SHARD = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("part_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("missing", pa.binary()), ("payload", pa.binary())])
SHARD_DDL = "part int, shard long, part_start long, n_ids long, doc_ids binary, missing binary, payload binary"
DOC_DDL = "part int, doc_id long, part_start long, n_tokens long, ids_crc32 long"


def _writer(model: str, end_id: int, shard_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_bpe.load(model)
        end = np.array([end_id], dtype="<u4").tobytes()
        part, shard, start = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal shard, start, held
            payload = pfor.encode(np.frombuffer(b"".join(parts), dtype="<u4"), [len(p) // 4 for p in parts])
            keys = np.array([d or 0 for d in docs], dtype="<i8").tobytes()
            gone = np.array([d is None for d in docs], dtype=np.uint8).tobytes()
            row = [part, shard, start, held, keys, gone, payload]
            shard, start, held = shard + 1, start + held, 0
            docs.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _SHARD.types, strict=True)], schema=_SHARD)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                ids = encoder.encode(text.as_py()) + end
                docs.append(doc)
                parts.append(ids)
                held += len(ids) // 4
                if held >= shard_ids:
                    yield close()
        if docs:
            yield close()

    return write


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            part, start, keys, gone, payload = (batch.column(i)[row].as_py() for i in range(5))
            ids, lengths = pfor.decode(payload)
            data, ends = memoryview(ids.tobytes()), np.cumsum(lengths, dtype=np.int64)
            starts = ends - lengths
            crc = np.fromiter((zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(ends))
            docs = pa.array(np.frombuffer(keys, "<i8"), mask=np.frombuffer(gone, np.uint8).astype(bool))
            cols = [pa.array(np.full(len(ends), part, np.int32)), docs, pa.array(start + starts), pa.array(lengths.astype(np.int64)), pa.array(crc)]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "doc_id", "part_start", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, path: str, model: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the shards of ``docs`` to ``path``; each row is a self-describing shard with its documents' ids.

    The only exchange deals (doc_id, text) out by doc_id; ids are never shuffled.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.whole_text(F.col(text_col)).alias("text"))
    dealt = picked.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    dealt.mapInArrow(_writer(model, end_id, shard_ids), SHARD_DDL).write.option("compression", "uncompressed").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_DDL).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every stored document, from the shards' bytes.

    Each range's total (one row a range) is summed up once and broadcast: as
    many rows as the store has ranges, whatever its size.
    """
    shards = read_shards(spark, path)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.selectExpr("part", "sum(n) over (order by part rows between unbounded preceding and 1 preceding) as before")
    docs = shards.select("part", "part_start", "doc_ids", "missing", "payload").mapInArrow(_reader, DOC_DDL)
    return docs.join(F.broadcast(before), "part").select(
        "doc_id", (F.coalesce("before", F.lit(0)) + F.col("part_start")).cast("long").alias("start"), "n_tokens", "ids_crc32"
    )
