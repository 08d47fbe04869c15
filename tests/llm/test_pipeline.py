"""The stages of the corpus pipeline, each on the last one's rows, against brute force."""

import collections
import random
import re

import pytest
import corpus_pipeline
from pyspark.sql import functions as F

from pointloom.llm import common


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    pick = random.Random(5)
    words = [f"{a}{b}{c}" for a in ("bor", "tin", "mel", "sar", "kov") for b in ("an", "el", "is", "or", "ut") for c in ("da", "le", "mi", "no", "ru", "sy")]
    rows = []
    for i in range(60):
        body = " ".join(pick.choice(words) for _ in range(60 + i)) + "."
        rows.append((i, body, "en", f"s{i % 3}", len(body)))
    rows += [(100 + i, rows[i][1], "en", "s0", rows[i][4]) for i in range(5)]
    rows += [(200 + i, "BUY NOW!! ### $$$ " * 40, "en", "s1", 700) for i in range(3)]
    leak = rows[10][1] + " password = hunter2hunter2"
    leak += " " + " ".join(pick.choice(words) for _ in range(40)) + "."
    rows += [(300, leak, "en", "s2", 1), (301, None, None, None, None), (302, "", "en", "s0", 0)]
    d = str(tmp_path_factory.mktemp("world"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(200 + i, 0, 0) for i in range(3)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, world):
    docs = common.table(spark, world, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.staged(stage(spark, docs, world), f"test-{name}")
        seen.append([r.asDict() for r in docs.collect()])
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    kept, single, clean, mixed, coded = seen
    assert {r["doc_id"] for r in kept} == {*range(60), *range(100, 105), 300}
    assert {r["doc_id"] for r in single} == {*range(60), 300} and len(single) == 61
    before = {r["doc_id"]: r["text"] for r in single}
    for r in clean:
        assert r["text"] == re.sub(r"password = hunter2hunter2", "<secret>", before[r["doc_id"]]) and r["n_chars"] in (len(r["text"]), len(before[r["doc_id"]]))
    sizes = collections.Counter()
    for r in clean:
        sizes[r["source"]] += len(r["text"].split())
    copies = collections.Counter(r["doc_id"] for r in mixed)
    assert max(copies.values()) <= 2 and sum(len(r["text"].split()) for r in mixed) == pytest.approx(1.5 * sum(sizes.values()), rel=0.05)
    assert sorted(r["doc_id"] for r in coded) == sorted(r["doc_id"] for r in mixed) and all(r["parity"] and r["round_trip"] for r in coded)


def test_run_is_the_stages(spark, world):
    got = corpus_pipeline.run(spark, world)
    assert got.agg(F.count("*")).first()[0] > 0 and len(corpus_pipeline.STAGES) == 5


def test_stages_take_odd_tables(spark, world):
    """Nulls in every column, blank texts, repeated rows, a very long text and a clashing column, with the rows each stage leaves."""
    docs = common.table(spark, world, "documents")
    long = " ".join(f"word{i}" for i in range(40_000)) + " token = 0123456789abcdef"
    rows = [
        (None, None, None, None, None, "x"), (None, "a b c", None, None, None, "y"), (1, "", "en", None, 0, "z"), (1, "", "en", None, 0, "z"), (2, "A  b\nc", "en", "s", 6, "w"),
        (3, long, "en", "s", len(long), "v"), (4, long.replace("word7 ", "other "), None, "s", None, "u"),
    ]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
    got = {name: stage(spark, odd, world).collect() for name, stage in corpus_pipeline.STAGES}
    assert {r.doc_id for r in got["quality_rules"]} <= {3, 4}
    assert sorted((r.doc_id, r.size) for r in got["simhash_near_dedup"]) == [(1, "z"), (2, "w"), (3, "v")]
    clean = {(r.doc_id, r.size): (r.text, r.n_chars) for r in got["secret_scan"]}
    assert len(got["secret_scan"]) == len(rows) and clean[(None, "x")] == (None, None) and clean[(2, "w")] == ("A  b\nc", 6)
    want = long.replace("token = 0123456789abcdef", "<secret>")
    assert clean[(3, "v")] == (want, len(want)) and clean[(4, "u")][1] is not None
    copies = collections.Counter(r.doc_id for r in got["mixing"])
    assert set(copies) <= {None, 1, 2, 3, 4} and max(copies.values()) <= 4 and {r.size for r in got["mixing"] if r.doc_id == 3} <= {"v"}
    assert sum(len((r.text or "").split()) for r in got["mixing"]) > 0
    ids = {(r.doc_id, r.n_tokens) for r in got["sentencepiece"]}
    assert len(got["sentencepiece"]) == len(rows) and (1, 0) in ids and min(n for d, n in ids if d in (3, 4)) > 40_000 and all(r.parity and r.round_trip for r in got["sentencepiece"])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), world).count() == 0
