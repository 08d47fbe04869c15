"""Quality classifier: gradient-boosted trees over document statistics.

The statistics come from the text alone. Labelled rows to learn from are chosen
by hash, ``TRAIN_ROWS`` of them at most, so that what the driver gathers is
bounded; every document is scored, in one map over the rows with the trees as
flat arrays.

Defined cases: null and empty texts have all-zero statistics and are scored
like any other; very long texts are read whole; repeated rows are scored each,
and of rows with one labelled doc_id that with the greatest text is learned
from; without labelled rows, or with labels of one kind only, the score is
constant; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm import common, gbdt

TRAIN_ROWS = 12_000
CUT = 0.3
_CLASS = np.zeros(256, dtype=np.uint8)
_SPACE, _LOWER, _UPPER, _DIGIT, _SYMBOL, _MARK, _HIGH, _OTHER = range(8)
_CLASS[:] = _OTHER
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = _LOWER, _UPPER, _DIGIT, _HIGH
_CLASS[list(b"#*$%&|<>@^~{}[]\\_=+/")] = _SYMBOL
_CLASS[list(b"!?.,;:'\"-()")] = _MARK
N_FEATURES = 26


def statistics(text: bytes) -> list[float]:
    """The statistics of one UTF-8 text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8)
    size = len(text)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    distinct = set(words)
    pairs = set(zip(words, words[1:]))
    same = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = [w[-1:] for w in words]
    capitals = sum(map(bytes.isupper, words))
    return [
        float(n), float(size), float(len(lines)), n / len(lines), size / n, float(lengths.std()), float(lengths.max()),
        *(kinds[k] / size for k in (_SPACE, _LOWER, _UPPER, _DIGIT, _SYMBOL, _MARK, _HIGH, _OTHER)),
        kinds[_SYMBOL] / n, len(distinct) / n, len(pairs) / max(1, n - 1), same / n, len(set(lines)) / len(lines),
        ends.count(b".") / n, ends.count(b"!") / n, ends.count(b",") / n, capitals / n, float((lengths == 1).mean()), float((lengths > 12).mean()),
    ]


def matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    texts = batch.column(column).cast(pa.binary())
    return np.array([statistics(t.as_py()) for t in texts], dtype=np.float64).reshape(len(texts), N_FEATURES)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = matrix(batch, 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])


def fold(column: str, parts: int, left_out: int):
    """Whether a row is held out: crc32 of the id as text, modulo ``parts``. A null id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(parts)) == left_out, F.lit(False))


def chosen(labels: DataFrame, label: str, parts: int, left_out: int, rows: int) -> DataFrame:
    """train_id, y: labelled rows outside the held-out fold, ``rows`` at most, by hash of the id."""
    d = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~fold("doc_id", parts, left_out))
    d = d.groupBy(F.col("doc_id").cast("long").alias("train_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    return d.orderBy(F.xxhash64("train_id"), "train_id").limit(rows)


def one_of_each(d: DataFrame) -> DataFrame:
    """train_id, y, text with one row an id: of repeated ids, the greatest text."""
    return d.groupBy("train_id").agg(F.max("y").alias("y"), F.max("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> gbdt.Forest:
    """Fit to ``labels.quality`` of rows outside the held-out fold."""
    picked = docs.select(F.col(id_col).alias("id"), common.whole_text(F.col(text_col)).alias("text"))
    # at most ``rows`` pairs of numbers are broadcast
    d = picked.join(F.broadcast(chosen(labels, "quality", 5, 0, rows)), F.col("id") == F.col("train_id"))
    found = one_of_each(d).select("y", "text").mapInArrow(_stats, "y int, x array<double>").toArrow()
    x = np.array(found.column("x").to_pylist(), dtype=np.float64).reshape(found.num_rows, N_FEATURES)
    y = np.array(found.column("y").to_pylist(), dtype=np.float64)
    # rows come in any order; sums over them must not depend on it
    order = np.lexsort((*x.T, y))
    return gbdt.fit(x[order], y[order])


def scorer(forest: gbdt.Forest, features: Callable[[pa.RecordBatch, int], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.score(features(batch, 1)))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, forest: gbdt.Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.whole_text(F.col(text_col)).alias("text"))
    d = picked.mapInArrow(scorer(forest, matrix), "doc_id long, score double")
    return d.select("doc_id", fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
