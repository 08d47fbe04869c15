"""Resemblance of texts: the share of word shingles that two texts have in common.

``sketches`` gives what a search needs of each text: an exact key of its words
and MinHash bands. ``band_pairs`` links the members of a band to two of them, so a
crowded band gives no square of pairs, and ``confirmed`` compares the whole
sets of shingles of each pair. That finds nearly all groups at a low cost, yet
some pairs meet in no band, or in crowded ones only. ``pairs_between`` finds
every pair that is left between the groups (``groups_linked`` the groups that
they join), by exact filters:

1. Two texts that resemble each other share four fifths of the shingles of each,
   so the fifth of a text's shingles that comes first in any order, one more and
   k more hold k + 1 shared ones or more (the k of the text that has the lesser
   one). Shingles are ordered by hash, k is an eighth of their number; a text
   of whose first ones too few stand in texts of other groups is done with.
2. Of the rest, a text is done with that has less than four fifths of all its
   shingles in common with the rest of other groups.
3. The shingles of what is left are ordered by the number of texts, those in one
   group only first; of each text the first fifth and one more are looked up.
   Texts of different groups that meet there are compared exactly, by chunks of
   texts: those of a large group, or those whose most frequent looked-up shingle
   is the same. A crowd makes a row for two chunks that meet, not for two texts.

Shingles are dealt to slots as 32-bit tags, in blocks of many texts; tags that
meet by chance only let more texts pass.

Shingles are ``WORDS`` words after A-Z are lowered; a text of fewer words is
one shingle, and a text without words has none and resembles nothing (its key
says that it equals other such texts).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm import common

WORDS = 5
#: Texts resemble each other from NUMERATOR / DENOMINATOR of their shingles on.
NUMERATOR, DENOMINATOR = 4, 5
BANDS, VALUES = 20, 4
#: One in so many shingles is read beside the shortest prefix.
SPARE = 8
#: Shingles of a slot, about, and those that a worker gathers before it deals them.
SLOT, _GATHER = 500_000, 250_000
#: Chunks that share a looked-up shingle and meet in one group.
CROWD = 1024
#: Shingles of a chunk, about; a text counts as ``_TEXT`` more.
CHUNK, _TEXT = 2**15, 96
#: Shingles that are worked on at once.
_STEP = 2048
_draw = np.random.default_rng(2024)
_PLACE = _draw.integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
_TIMES = _draw.integers(1, 2**63, BANDS * VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(0, 2**63, BANDS * VALUES, dtype=np.uint64) * np.uint64(2)
_FOLD = _draw.integers(1, 2**63, VALUES, dtype=np.uint64) | np.uint64(1)
_NUMBER = _draw.integers(1, 2**63, BANDS, dtype=np.uint64)


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of the shingles of lowered words, repeats included."""
    n = len(words)
    digest = xxhash.xxh64_intdigest
    w = np.fromiter((digest(x, 7) for x in words), np.uint64, n)
    size = min(n, WORDS)
    h = np.zeros(n - size + 1 if n else 0, np.uint64)
    for k in range(size):
        h += w[k : n - size + 1 + k] * _PLACE[k]
    return _scrambled(h)


def sketch(text: bytes) -> tuple[bytes, np.ndarray, int]:
    """The key of a UTF-8 text's words, its band keys (none for a text without words), its number of shingles with repeats."""
    words = text.lower().split()
    key = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    h = _shingles(words)
    if not len(h):
        return key, np.zeros(0, np.int64), 0
    low = np.full(BANDS * VALUES, 2**64 - 1, np.uint64)
    for at in range(0, len(h), _STEP):
        np.minimum(low, (h[at : at + _STEP, None] * _TIMES + _PLUS).min(axis=0), out=low)
    bands = (low.reshape(BANDS, VALUES) * _FOLD).sum(axis=1, dtype=np.uint64) + _NUMBER
    return key, _scrambled(bands).view(np.int64), len(h)


def band_pairs(texts: DataFrame) -> DataFrame:
    """u, v (u < v): members of a band with its least member, and with another drawn by hash. ``texts`` (id, bands) is stored."""
    rows = common.staged(texts.select("id", F.explode("bands").alias("band")), "bands")
    groups = rows.groupBy("band").agg(F.min("id").alias("one"), F.min(F.struct(F.xxhash64("band", "id").alias("h"), "id")).alias("other"), F.count("*").alias("n"))
    groups = common.staged(groups.filter("n > 1").select("band", "one", F.col("other.id").alias("other")), "band-leads")
    met = common.looked_up(rows.join(groups.select("band"), "band", "left_semi"), groups, "band")
    pairs = met.select(F.explode(F.array(F.struct("id", F.col("one").alias("lead")), F.struct("id", F.col("other").alias("lead")))).alias("p"))
    return pairs.filter("p.id <> p.lead").select(F.least("p.id", "p.lead").alias("u"), F.greatest("p.id", "p.lead").alias("v")).distinct()


def shingle_set(text: Column) -> Column:
    """Hashes of a text's distinct shingles; [] without words. Hashes of two texts meet by chance once in 10**13 or so."""
    lowered = F.translate(common.whole_text(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = F.transform(
        F.array(common.word_list(lowered)),
        lambda k: F.when(F.size(k) == 0, F.array().cast("array<bigint>")).when(F.size(k) < WORDS, F.array(F.xxhash64(k))).otherwise(
            F.array_distinct(F.transform(F.slice(k, F.lit(1), F.size(k) - (WORDS - 1)), lambda w, i: F.xxhash64(w, *[F.get(k, i + j) for j in range(1, WORDS)])))
        ),
    )
    return runs[0]


def confirmed(pairs: DataFrame, texts: DataFrame, part: int = NUMERATOR, whole: int = DENOMINATOR) -> DataFrame:
    """The pairs (u, v) of ids whose ``texts`` (__row: the id, text) share ``part`` of ``whole`` shingles or more.

    Only texts that stand in a pair are cut into shingles. A text in very many
    pairs is looked up apart, so no task meets all of its pairs.
    """
    pairs = common.staged(pairs, "pairs")
    wanted = pairs.select(F.col("u").alias("__row")).union(pairs.select("v")).distinct()
    sets = common.staged(texts.join(wanted, "__row", "left_semi").select(F.col("__row").alias("id"), shingle_set(F.col("text")).alias("s")), "shingle-sets")
    d = common.looked_up(pairs, sets.select(F.col("id").alias("u"), F.col("s").alias("a")), "u", 100)
    d = common.staged(d, "half-pairs")
    d = common.looked_up(d, sets.select(F.col("id").alias("v"), F.col("s").alias("b")), "v", 100)
    shared = F.size(F.array_intersect("a", "b"))
    return d.filter((part + whole) * shared >= part * (F.size("a") + F.size("b"))).filter(F.size("a") > 0).select("u", "v")


def needed(n):
    """Shingles that a text of ``n`` shares at least with any that it resembles; such a text has as many at least."""
    return -(-NUMERATOR * n // DENOMINATOR)


#: The same for a column n.
_NEEDED = f"(({NUMERATOR} * n + {DENOMINATOR - 1}) div {DENOMINATOR})"


def _parts(block: pa.Table, **types: type) -> list[np.ndarray]:
    """Columns of packed numbers, each as one array."""
    return [np.frombuffer(b"".join(block.column(c).to_pylist()), t) for c, t in types.items()]


def _dealt(slots: int, all_of_them: bool):
    """Blocks of many texts' shingles by slot: of each text in it the id, group, number of shingles and how many follow, and the tags."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, groups, sizes = [], [], [], []

        def blocks() -> pa.RecordBatch:
            h = np.concatenate(held)
            slot = (h & np.uint64(0xFFFFFFFF)) % np.uint64(slots)
            order = np.argsort(slot, kind="stable")
            slot, tag = slot[order], (h[order] >> np.uint64(32)).astype(np.uint32)
            doc = np.repeat(np.arange(len(held)), [len(x) for x in held])[order]
            run = np.flatnonzero(np.r_[True, (slot[1:] != slot[:-1]) | (doc[1:] != doc[:-1])])
            count = np.diff(np.r_[run, len(doc)]).astype(np.uint32)
            per_text = [np.array(x, t)[doc[run]] for x, t in ((ids, np.int64), (groups, np.int64), (sizes, np.uint32))] + [count]
            names, at = np.unique(slot, return_index=True)
            of_run = np.searchsorted(run, np.r_[at, len(doc)])
            cut = [[x[a:b].tobytes() for a, b in zip(of_run[:-1], of_run[1:], strict=True)] for x in per_text]
            tags = [tag[a:b].tobytes() for a, b in zip(at, np.r_[at[1:], len(doc)], strict=True)]
            for x in (held, ids, groups, sizes):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), *[pa.array(x, pa.binary()) for x in (*cut, tags)]], names=["slot", "ids", "roots", "sizes", "counts", "tags"])

        many = 0
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for k in range(batch.num_rows):
                h = np.unique(_shingles(texts[k].as_py().lower().split()))
                n = len(h)
                if not n:
                    continue
                held.append(h if all_of_them else h[: n - needed(n) + 1 + n // SPARE].copy())
                ids.append(batch.column(0)[k].as_py())
                groups.append(batch.column(1)[k].as_py())
                sizes.append(n)
                many += len(held[-1])
                if many >= _GATHER:
                    many = 0
                    yield blocks()
        if held:
            yield blocks()

    return deal


def _met(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids and sizes of a slot's texts; tag, text and number of texts of each shingle that stands in two groups or more."""
    ids, roots, sizes, counts, tags = _parts(block, ids=np.int64, roots=np.int64, sizes=np.uint32, counts=np.uint32, tags=np.uint32)
    doc = np.repeat(np.arange(len(ids), dtype=np.uint64), counts)
    both = np.sort(tags.astype(np.uint64) << np.uint64(32) | doc)
    tag, doc = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.flatnonzero(np.r_[True, tag[1:] != tag[:-1]])
    times = np.diff(np.r_[start, len(tag)])
    root = roots[doc]
    shared = np.repeat(np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start), times)
    return ids, sizes, tag[shared], doc[shared], np.repeat(times, times)[shared]


def _shared_counts(buckets: int):
    """Of a slot's texts the number of shared shingles, packed by bucket of ids, so that there are not as many rows as texts times slots."""

    def count(block: pa.Table) -> pa.Table:
        ids, sizes, _, doc, _ = _met(block)
        n = np.bincount(doc, minlength=len(ids)).astype(np.uint32)
        hit = np.flatnonzero(n)
        bucket = _scrambled(ids[hit].view(np.uint64)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        hit = hit[order]
        names, at = np.unique(bucket[order], return_index=True)
        ends = np.r_[at, len(hit)]  # no bucket if nothing is shared
        cut = [[x[hit[a:b]].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)] for x in (ids, sizes, n)]
        return pa.table([pa.array(names.astype(np.int32)), *[pa.array(x, pa.binary()) for x in cut]], names=["bucket", "ids", "sizes", "shared"])

    return count


def _passed(all_of_them: bool):
    """id and number of shingles of a bucket's texts that share as many as are needed."""

    def add(block: pa.Table) -> pa.Table:
        ids, sizes, shared = _parts(block, ids=np.int64, sizes=np.uint32, shared=np.uint32)
        order = np.argsort(ids, kind="stable")
        start = np.flatnonzero(np.r_[True, ids[order][1:] != ids[order][:-1]])
        n = sizes[order][start].astype(np.int64)
        least = needed(n) if all_of_them else needed(n) // SPARE + 1
        enough = np.add.reduceat(shared[order].astype(np.int64), start) >= least
        return pa.table({"id": ids[order][start][enough], "n": n[enough].astype(np.int32)})

    return add


def _rarest(block: pa.Table) -> pa.Table:
    """Of each text the shared shingles in the order of the number of texts, no more than can be looked up."""
    ids, sizes, tag, doc, times = _met(block)
    order = np.lexsort((tag, times, doc))
    tag, doc, times = tag[order], doc[order], times[order]
    n = np.bincount(doc, minlength=len(ids))
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    size = sizes.astype(np.int64)
    use = rank < (size - needed(size) + 1)[doc]
    kept = np.bincount(doc[use], minlength=len(ids))
    hit = np.flatnonzero(n)
    slot = block.column("slot")[0].as_py()
    entries = pa.StructArray.from_arrays([pa.array(times[use]), pa.array(slot << 32 | tag[use])], names=["times", "shingle"])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept[hit])].astype(np.int32)), entries)
    return pa.table({"id": pa.array(ids[hit]), "n": pa.array(sizes[hit].astype(np.int32)), "shared": pa.array(n[hit].astype(np.int32)), "entries": lists})


def _slots(groups: DataFrame, texts: DataFrame, all_of_them: bool) -> tuple[DataFrame, int]:
    """The blocks of the texts that ``groups`` (id, root, n: shingles) names, by slot, and the number of slots."""
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = 1 if all_of_them else 1 - NUMERATOR / DENOMINATOR + 1 / SPARE
    slots = int(total * share) // SLOT + 1
    named = texts.withColumnRenamed("__row", "id").join(groups.select("id", "root").hint("shuffle_hash"), "id").select("id", "root", common.whole_text(F.col("text")).alias("text"))
    return named.mapInArrow(_dealt(slots, all_of_them), "slot int, ids binary, roots binary, sizes binary, counts binary, tags binary"), slots


def _sieved(groups: DataFrame, texts: DataFrame, all_of_them: bool) -> DataFrame:
    """``groups`` without the texts that can resemble none of another group."""
    blocks, slots = _slots(groups, texts, all_of_them)
    met = blocks.groupBy("slot").applyInArrow(_shared_counts(slots), "bucket int, ids binary, sizes binary, shared binary")
    passed = met.groupBy("bucket").applyInArrow(_passed(all_of_them), "id long, n int")
    return common.staged(passed.join(groups.select("id", "root"), "id"), "sieved")


def _looked_up_shingles(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """id, n, root, shingles: what is left of ``groups``, with the shingles that are looked up, the most frequent one last."""
    left = _sieved(_sieved(groups, texts, False), texts, True)
    rare = _slots(left, texts, True)[0].groupBy("slot").applyInArrow(_rarest, "id long, n int, shared int, entries array<struct<times: bigint, shingle: bigint>>")
    rare = rare.groupBy("id").agg(F.max("n").alias("n"), F.sum("shared").alias("shared"), F.flatten(F.collect_list("entries")).alias("e"))
    room = f"cast(shared - {_NEEDED} + 1 AS int)"
    rare = rare.filter(f"{room} > 0").select("id", "n", F.expr(f"slice(array_sort(e), 1, {room}).shingle").alias("shingles"))
    return common.staged(rare.filter("size(shingles) > 0").join(left.select("id", "root"), "id"), "rarest")


def _chunked(rare: DataFrame) -> DataFrame:
    """``rare`` with the chunk of each text: of a large group's texts, or of those whose last shingle is the same, about ``CHUNK`` shingles."""
    weight = F.sum(F.col("n") + _TEXT)
    large = rare.groupBy("root").agg(weight.alias("w")).filter(F.col("w") * 2 > CHUNK).select("root", F.lit(True).alias("large"))
    rare = rare.join(large, "root", "left").withColumn("home", F.expr("CASE WHEN large THEN xxhash64(0, root) ELSE xxhash64(1, element_at(shingles, -1)) END"))
    cut = rare.groupBy("home").agg(F.ceil(weight / CHUNK).cast("int").alias("parts")).filter("parts > 1")
    rare = rare.join(cut, "home", "left").withColumn("chunk", F.expr("xxhash64(home, CASE WHEN parts IS NULL THEN 0 ELSE pmod(xxhash64(id), parts) END)"))
    return common.staged(rare.select("id", "n", "root", "chunk", "shingles"), "rarest-chunks")


def _chunk_pairs(rare: DataFrame) -> DataFrame:
    """s, l: chunks (also a chunk and itself) with texts of different groups that meet at a shingle and may resemble each other; s is the one of less shingles."""
    at = rare.select("chunk", "n", "root", F.explode("shingles").alias("shingle")).groupBy("shingle", "chunk")
    at = common.staged(at.agg(F.min("n").alias("n"), F.max("n").alias("most"), F.min("root").alias("a"), F.max("root").alias("b")), "chunk-shingles")
    crowds = at.groupBy("shingle").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.ceil(F.count("*") / CROWD).cast("int").alias("blocks")).filter("a <> b")
    at = common.staged(common.looked_up(at, common.staged(crowds.select("shingle", "blocks"), "shingle-blocks"), "shingle"), "shingle-chunks")
    end = lambda k: [F.col(c).alias(f"{c}{k}") for c in ("chunk", "n", "most", "a", "b")]
    one = at.select("shingle", F.expr("cast(pmod(xxhash64(chunk), blocks) AS int)").alias("block"), *end(1))
    other = at.select("shingle", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *end(2))
    near = f"{DENOMINATOR} * most1 >= {NUMERATOR} * n2 AND {DENOMINATOR} * most2 >= {NUMERATOR} * n1"
    pairs = one.join(other, ["shingle", "block"]).filter(f"chunk1 <= chunk2 AND {near} AND (least(a1, a2) <> greatest(b1, b2))").select("chunk1", "chunk2").distinct()
    weight = rare.groupBy("chunk").agg(F.sum("n").alias("w"))
    for k in (1, 2):
        pairs = pairs.join(weight.select(F.col("chunk").alias(f"chunk{k}"), F.col("w").alias(f"w{k}")), f"chunk{k}")
    return pairs.select(F.expr("CASE WHEN w1 <= w2 THEN chunk1 ELSE chunk2 END").alias("s"), F.expr("CASE WHEN w1 <= w2 THEN chunk2 ELSE chunk1 END").alias("l"))


def _links_between(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """links (array of u, v, root_u, root_v): for each two chunks that meet, the texts of different groups that resemble each other."""
    rare = _chunked(_looked_up_shingles(groups, texts))
    many = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = common.staged(_chunk_pairs(rare).repartition(many, "s", "l"), "chunk-pairs")
    met = pairs.select(F.col("s").alias("chunk")).union(pairs.select("l")).distinct()
    named = rare.join(met, "chunk", "left_semi").select(F.col("id").alias("__row"), "root", "chunk")
    sets = texts.join(named, "__row").select("chunk", F.struct(F.col("__row").alias("id"), "root", shingle_set(F.col("text")).alias("s")).alias("text"))
    chunks = common.staged(sets.groupBy("chunk").agg(F.collect_list("text").alias("texts")), "chunks")
    # few rows with much work each: dealt to as many tasks as there are partitions
    d = common.looked_up(pairs, chunks.select(F.col("chunk").alias("s"), F.col("texts").alias("x")), "s", 100)
    d = common.staged(d.repartition(many, "s", "l"), "half-pairs")
    d = common.looked_up(d, chunks.select(F.col("chunk").alias("l"), F.col("texts").alias("y")), "l", 100)
    a, b = "size(p.s)", "size(q.s)"
    like = f"{NUMERATOR + DENOMINATOR} * size(array_intersect(p.s, q.s)) >= {NUMERATOR} * ({a} + {b})"
    near = f"p.root <> q.root AND (s <> l OR p.id < q.id) AND {DENOMINATOR} * least({a}, {b}) >= {NUMERATOR} * greatest({a}, {b}) AND {like}"
    link = "named_struct('u', least(p.id, q.id), 'v', greatest(p.id, q.id), 'root_u', least(p.root, q.root), 'root_v', greatest(p.root, q.root))"
    return d.select(F.expr(f"flatten(transform(x, p -> transform(filter(y, q -> {near}), q -> {link})))").alias("links"))


def pairs_between(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """u, v: every pair of texts of different groups that resemble each other.

    ``groups`` (id, root, n: shingles, repeats counted or not) and ``texts``
    (__row: the id, text; bucketed by it) are stored.
    """
    return _links_between(groups, texts).select(F.explode("links").alias("p")).select("p.u", "p.v")


def groups_linked(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """u, v (u < v): the roots of every two groups with texts that resemble each other, once for two chunks; ``groups`` and ``texts`` as above."""
    roots = "array_distinct(transform(links, p -> struct(p.root_u AS u, p.root_v AS v)))"
    return _links_between(groups, texts).select(F.explode(F.expr(roots)).alias("p")).select("p.u", "p.v").distinct()
