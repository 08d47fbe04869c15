"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint's halves are words of 31 bits (of 32; a bit left out only brings
fingerprints closer). The anchors of a half are the 2**26 words of the perfect
Hamming code of that length: every word lies within 1 of one anchor (covering
radius 1). Of two fingerprints with 3 or fewer differing bits, one half differs
in at most 1 bit. So a fingerprint is replicated, for each half, to all anchors
within covering radius plus 1: if x and y agree in a half but for one bit, y is
within 2 of the anchor nearest to x. A word has one nearest anchor and fifteen
at distance 2 (none of those if it is an anchor itself). At each anchor the
whole fingerprints are compared, so nothing is linked wrongly.

Equal fingerprints form a class and are compared once. An anchor with more than
``CROWD`` fingerprints is split by the other half: linked fingerprints differ
there in 3 bits at most, so one of its four pieces agrees, and each piece's
value is a group of its own. So anchors stay small however many documents
there are. A group that is still crowded is dealt into blocks, and each pair of
blocks is a group of its own, so no task gathers an unbounded group and every
pair still meets. Of a group's links a spanning forest is passed on, not all
pairs.

``keep_representatives`` drops near copies: texts that share four fifths of
their five-word shingles or more, by exact comparison of the sets. Candidates
are the links of the fingerprints and, since texts of that likeness differ in 4
to 12 bits as a rule, what meets in a band of ``resemblance``. Those give groups;
``resemblance.groups_linked`` then finds every link that they have left apart.

Defined cases: a null or blank text has fingerprint zero and is linked like any
other; repeated rows share class and component; a component's id is the least
doc_id in it, ids that are null aside (null if there is no other); very long
texts are hashed whole; other columns are not read; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm import common, components, resemblance

SHINGLE = 3
SEED = 42
THRESHOLD = 3
#: Fingerprints that an anchor's group holds at most; blocks of crowded anchors hold half as many.
CROWD = 2048
_BITS = 31


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text; a bit is set if it is in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    last = ends[min(size, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    bits = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    full = n // 255 * 255
    count = np.add.reduce(bits[full:], axis=0, dtype=np.uint8).astype(np.int64)
    if full:
        count += np.add.reduce(bits[:full].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        fp = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.whole_text(F.col(text_col)).alias("text"))
    return picked.mapInArrow(_fingerprints, "doc_id long, fp long")


def anchors(fps: DataFrame) -> DataFrame:
    """fp, anchor: each fingerprint with the anchors of both halves within covering radius plus one."""
    masks = [sum(1 << (p - 1) for p in range(1, _BITS + 1) if p >> k & 1) for k in range(5)]
    syndrome = " + ".join(f"(bit_count(x & {m}L) & 1) * {1 << k}" for k, m in enumerate(masks))
    d = fps.select("fp", F.explode(F.expr(f"array(struct(0 AS half, fp & {2**31 - 1}L AS x), struct(1 AS half, shiftrightunsigned(fp, 32) & {2**31 - 1}L AS x))")).alias("w"))
    d = d.select("fp", "w.half", "w.x").withColumn("s", F.expr(f"cast({syndrome} AS int)"))
    near = "CASE WHEN s = 0 THEN x ELSE x ^ shiftleft(1L, s - 1) END"
    far = "transform(filter(sequence(1, 31), i -> s <> 0 AND (i ^ s) > i), i -> x ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1))"
    return d.select("fp", F.explode(F.expr(f"transform(concat(array({near}), {far}), a -> a * 2 + half)")).alias("anchor"))


def _forest(fp: np.ndarray, most: int) -> tuple[list, list]:
    """Links of a spanning forest of the distinct ``fp`` under ``most`` differing bits."""
    left, a, b = fp, [], []
    while len(left) > 1:
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            hit = np.bitwise_count(left ^ x) <= most
            if hit.any():
                found = left[hit]
                a.append(np.full(len(found), x))
                b.append(found)
                stack.extend(found)
                left = left[~hit]
    return a, b


def _links(most: int):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 0), np.int64)

        def links(group: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero(np.diff(group)) + 1
            start = np.concatenate(([0], cut))
            size = np.diff(np.concatenate((start, [len(group)])))
            size_of = np.repeat(size, size)
            a, b = [], []
            for step in range(1, 8):
                row = np.flatnonzero((group[step:] == group[:-step]) & (size_of[step:] <= 8))
                row = row[np.bitwise_count((fp[row] ^ fp[row + step]).view(np.uint64)) <= most]
                a.append(fp[row])
                b.append(fp[row + step])
            for i in np.flatnonzero(size > 8):
                x, y = _forest(fp[start[i] : start[i] + size[i]].view(np.uint64), most)
                a += [v.view(np.int64) for v in x]
                b += [v.view(np.int64) for v in y]
            pairs = np.unique(np.stack((np.concatenate(a), np.concatenate(b))), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows = np.concatenate((held, rows), axis=1)
            if not rows.shape[1]:
                continue
            end = int(np.searchsorted(rows[0], rows[0, -1]))  # the last group may go on
            held = rows[:, end:]
            if end:
                yield from links(rows[0, :end], rows[1, :end])
        if held.shape[1]:
            yield from links(held[0], held[1])

    return match


def links(fps: DataFrame, most: int = THRESHOLD, crowd: int = CROWD) -> DataFrame:
    """u, v: links between distinct fingerprints ``fps`` (column fp) that connect what ``most`` differing bits connect."""
    if not 0 <= most <= 3:
        raise ValueError("halves share 3 differing bits so that one of them has 1 at most")
    at = common.staged(anchors(fps), "anchors")
    crowds = at.groupBy("anchor").count().filter(F.col("count") > crowd).select("anchor", F.lit(True).alias("crowded"))
    # pieces of the other half: a crowded anchor's fingerprints go on by (piece, its value)
    other = "CASE WHEN anchor & 1 = 0 THEN shiftrightunsigned(fp, 32) ELSE fp END"
    pieces = f"transform(sequence(0, 3), j -> xxhash64(anchor, j, shiftrightunsigned({other}, 8 * j) & CASE WHEN j = 3 THEN 127L ELSE 255L END))"
    d = at.join(crowds, "anchor", "left").select("fp", F.explode(F.expr(f"CASE WHEN crowded THEN {pieces} ELSE array(anchor) END")).alias("a"))
    still = d.groupBy("a").count().filter(F.col("count") > crowd).select("a", F.ceil(F.col("count") / (crowd // 2)).cast("int").alias("blocks"))
    d = d.join(still, "a", "left")
    # a block of a crowded group meets each block, itself included; others are one group
    own = "cast(pmod(xxhash64(fp), blocks) AS int)"
    d = d.select("fp", "a", F.explode(F.expr(
        f"CASE WHEN blocks IS NULL THEN array(0L) ELSE transform(sequence(0, blocks - 1), j -> cast(least({own}, j) AS bigint) * blocks + greatest({own}, j) + 1) END"
    )).alias("pair"))
    d = d.select(F.expr("CASE WHEN pair = 0 THEN a ELSE xxhash64(a, pair) END").alias("g"), "fp")
    return d.repartition("g").sortWithinPartitions("g").mapInArrow(_links(most), "u long, v long")


def near_duplicates(fps: DataFrame, most: int = THRESHOLD) -> DataFrame:
    """doc_id, fp, component_id of every row of ``fps`` (doc_id, fp; read a few times: hand over a stored table)."""
    classes = common.staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    nodes = common.staged(components.components(links(classes.select("fp"), most)).withColumnRenamed("node", "fp"), "nodes")
    least = nodes.join(classes, "fp").groupBy("root").agg(F.min("least").alias("component"))
    joined = common.looked_up(nodes, common.staged(least, "component-ids"), "root").select("fp", "component", F.lit(True).alias("linked"))
    of = classes.join(joined, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component")).otherwise(F.col("least")).alias("component_id"))
    return common.looked_up(fps, common.staged(of, "class-components"), "fp").select("doc_id", "fp", "component_id")


#: Rows of a batch that are sketched at once, so that a worker holds little beside the batch.
_AT_ONCE = 512


def _with_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, _AT_ONCE):
            batch = whole.slice(at, _AT_ONCE)
            texts = [t.as_py() for t in batch.column(0).cast(pa.binary())]
            fp = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
            keys, bands, n = zip(*map(resemblance.sketch, texts), strict=True)
            new = [pa.array(fp.view(np.int64)), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *new], names=[*batch.schema.names[1:], "__fp", "__key", "__bands", "__n"])


def near_copy_pairs(classes: DataFrame, texts: DataFrame, most: int = THRESHOLD) -> DataFrame:
    """u, v: pairs of class ids whose texts resemble each other, not all of them (see ``resemblance.groups_linked``). ``classes`` (id, fp, bands) and ``texts`` (__row: the id, text; bucketed by it) are stored."""
    named = classes.groupBy("fp").agg(F.min("id").alias("lead"))
    same = common.looked_up(classes.select("id", "fp"), common.staged(named, "fingerprint-leads"), "fp").filter("id <> lead").select(F.col("lead").alias("u"), F.col("id").alias("v"))
    linked = links(classes.select("fp").distinct(), most)
    of = lambda c, to: named.select(F.col("fp").alias(c), F.col("lead").alias(to))
    linked = linked.join(of("u", "a"), "u").join(of("v", "b"), "v").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    pairs = same.unionByName(linked).unionByName(resemblance.band_pairs(classes)).distinct()
    return resemblance.confirmed(pairs, texts)


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` of which each stands for its group of copies and near copies.

    Texts with equal words after A-Z are lowered are copies; those without
    words, null included, are copies of each other. It is the row with the
    least id that stays, ids that are null last; of rows with one id the first
    as the rows come.
    """
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    d = docs.select(common.whole_text(F.col(text_col)).alias("__text"), F.monotonically_increasing_id().alias("__row"), "*")
    d = common.bucketed(d.mapInArrow(_with_sketch, f"__row bigint, {kept}, __fp bigint, __key binary, __bands array<bigint>, __n bigint"), "__row", "sketched")
    least = F.min(F.struct(F.col(id_col).isNull().alias("gone"), F.col(id_col).cast("long").alias("doc_id"), F.col("__row").alias("id")))
    classes = d.groupBy("__key").agg(least.alias("least"), F.first("__fp").alias("fp"), F.first("__bands").alias("bands"), F.first("__n").alias("n"))
    classes = common.staged(classes.select(F.col("least.id").alias("id"), "least", "fp", "bands", "n"), "copy-classes")
    texts = d.select("__row", F.col(f"`{text_col}`").alias("text"))
    nodes = components.components(near_copy_pairs(classes, texts, most))
    groups = classes.select("id", "least", "n").join(nodes.select(F.col("node").alias("id"), "root"), "id", "left")
    groups = common.staged(groups.withColumn("root", F.coalesce("root", "id")), "groups")
    # what no search by fingerprint or band has joined: every link that is left between the groups
    joined = components.components(resemblance.groups_linked(groups, texts))
    least = groups.groupBy("root").agg(F.min("least").alias("least"))
    least = least.join(joined.select(F.col("node").alias("root"), F.col("root").alias("joined")), "root", "left")
    first = least.groupBy(F.coalesce("joined", "root").alias("root")).agg(F.min("least").alias("least"))
    stays = common.staged(first.select(F.col("least.id").alias("__row")), "stays")
    return d.join(stays, "__row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def fingerprint_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
