"""Selection, saves, documents, repairs and generators on fixtures small enough to check by hand."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import text
from pointloom.operators import candidates, edits, joins, review, rules, validate
from pointloom.sources import documents, files
from pointloom.streaming import audit


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("raw", "want"), [
    ('```json\n{"a": 1,}\n```', {"a": 1}), ('so: {"a": "x}", "b": [1, 2', {"a": "x}", "b": [1, 2]}), ('{"a": "True, }", "b": True, "c": None}', {"a": "True, }", "b": True, "c": None}),
    ("{“a”: 2}", {"a": 2}), ('{"a": {"b": "cut of', {"a": {"b": "cut of"}}), ('{"a": 1} and {"b": 2}', {"a": 1}), ('{"a": [1, {"b": 2},', {"a": [1, {"b": 2}]}), ('{"a": "x\\"}{", "b": 3}', {"a": 'x"}{', "b": 3}),
])
def test_json_repair(spark, raw, want):
    assert json.loads(one(spark, text.repair_json(F.lit(raw)))) == want


def test_text_values(spark):
    assert one(spark, text.repair_json(F.lit("no brace"))) is None
    assert [one(spark, text.scalar(F.lit(v))) for v in (" ", "None", "TRUE", "[1,2]", '{"x":1}', "[1,2", 'say "x"')] == [None, None, "true", "[1,2]", '{"x":1}', '"[1,2"', '"say \\"x\\""']
    assert one(spark, text.safe_object(F.lit('{"a":1}'))) == '{"a":1}' and one(spark, text.safe_object(F.lit("[1]"))) == "{}" and one(spark, text.safe_object(F.lit(None).cast("string"))) == "{}"
    assert one(spark, text.compact(F.lit(0.000025), 5)) == 0.00002 and one(spark, text.escape_html(F.lit("<a&'"))) == "&lt;a&amp;&#x27;"
    assert one(spark, edits.target_executor(F.lit(""), F.lit("claw"))) == "hook"
    priors = {"mug": {"hook": ["handle"], "pick_up": ["rim"]}, "u": {"pick_up": ["body"]}}
    of = lambda cat, e, t: one(spark, joins.category_priors(F.lit(cat), F.lit(e), F.lit(t), priors))
    assert (of("Mug", "hook", "pick_up"), of("Mug", "suction", "pick_up"), of("Cup", "hook", "pick_up"), of("Mug", "suction", "open_pull"), of("Door", "hook", "pick_up")) == (["handle"], ["rim"], ["body"], [], [])


def test_selection_errors(spark):
    r = spark.createDataFrame([(1, "p", "hook", "pick_up"), (2, "p", "hook", None)], "seq int, pilot_id string, executor string, task string")
    assert [x.seq for x in edits.select_rows(r, "seq", "p", exclude=["open_pull"]).collect()] == [1, 2]
    with pytest.raises(Exception, match="no rows selected"):
        edits.select_rows(r, "seq", "q").collect()
    g = spark.createDataFrame([("p", "v1")], "pilot_id string, view string")
    with pytest.raises(Exception, match="no grounding for p|v2"):
        edits.with_grounding(spark.createDataFrame([("p", "v1"), ("p", "v2")], g.schema), g, ["pilot_id", "view"], False).collect()
    m = spark.createDataFrame([("s", 0, "a", False, 5, 4, 5), ("s", 1, "b", True, 4, 4, 5)], "s string, rank int, path string, `exists` boolean, rows int, cols int, n_points int")
    with pytest.raises(Exception, match="no usable mask: s"):
        edits.usable_masks(m, ["s"]).collect()


def test_saves_refuse_what_is_wrong(spark):
    masks = spark.createDataFrame([("k", "hook", 1), ("k", "hook", 2)], "row_key string, executor string, point int")
    counts = spark.createDataFrame([("k", 5)], "row_key string, n_points int")
    edit = lambda e, seen, ids: spark.createDataFrame([("k", e, ids, seen, 1)], "row_key string, executor string, positive_indices array<int>, visible_all_points boolean, seq int")
    new, audit_ = edits.save_edits(masks, counts, edit("hook", True, [4, 2, 2, 9, -1]), "seq", "point")
    assert {r.point for r in new.collect()} == {2, 4}
    a = audit_.first()
    assert (a.positive_points_before, a.positive_points_after, a.added_points, a.removed_points) == (2, 2, [4], [1])
    none, _ = edits.save_edits(masks, counts, edit("hook", True, []), "seq", "point")
    assert none.count() == 0
    for bad, says in ((edit("claw", True, [1]), "unknown executor"), (edit("hook", False, [1]), "partial")):
        with pytest.raises(Exception, match=says):
            edits.save_edits(masks, counts, bad, "seq", "point")[1].collect()
    s = spark.createDataFrame([("s",)], "sample_id string")
    with pytest.raises(Exception, match="unknown sample_id: t"):
        edits.save_reviews(s, edits.initial_review(s), spark.createDataFrame([("t", "x", 1)], "sample_id string, sample_notes string, seq int"), "seq", ["sample_id"]).collect()


def test_overlay_takes_the_last_row(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    over = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, " ", 1)], "k int, v string, seq int")
    assert sorted(map(tuple, joins.overlay(base, over, ["k"], ["v"], "seq").collect())) == [(1, "y"), (2, "b")]


def test_overrides_in_order(spark):
    base = spark.createDataFrame([("s", "hook", i) for i in (1, 2, 3)] + [("s", "gripper", 7)], "s string, executor string, point int")
    o = spark.createDataFrame([("s", "hook", "set", 5), ("s", "hook", "add", 6), ("s", "hook", "remove", 5), ("s", "gripper", "set", None)], "s string, executor string, op string, point int")
    assert sorted(map(tuple, rules.apply_overrides(base, o, ["s"], "point").collect())) == [("s", "hook", 6)]


def test_documents(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        documents.read_json(spark, str(tmp_path / "none.json"))
    (tmp_path / "b.json").write_text(json.dumps({"views": {"front": {"box": [1, 2, 3, 4]}, "top": [{"box": [0, 0, 1, 1]}, 5], "odd": 3}}))
    (tmp_path / "c.json").write_text(json.dumps({"side": [{"box": []}]}))
    d = documents.read_json_text(spark, str(tmp_path / "*.json"))
    assert sorted(r["view"] for r in documents.manual_boxes(d).collect()) == ["front", "side", "top"]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "v.json").write_text(json.dumps({"views": ["front", {"view": "top"}, {"name": "iso"}]}))
    names = documents.view_names(documents.read_json_text(spark, str(tmp_path / "m")))
    assert [r["view"] for r in names.orderBy("pos").collect()] == ["front", "top", "iso"]
    out = io.BytesIO()
    np.savez(out, ring=np.array([0, 1, 1, 0]), lip=np.array([5, 3, 3]))
    (tmp_path / "r.npz").write_bytes(out.getvalue())
    got = {(r["name"], r.point_idx) for r in documents.read_region_arrays(spark, str(tmp_path / "r.npz")).collect()}
    assert got == {("ring", 1), ("ring", 2), ("lip", 3), ("lip", 5)}
    np.save(tmp_path / "m2.npy", np.array([[0.0, 0.5], [0.0, 0.0]]))
    assert [tuple(r)[1:4] for r in documents.read_view_masks(spark, str(tmp_path / "m2.npy"), "hook").collect()] == [(0, 1, "hook")]
    with pytest.raises(Exception, match="needs an executor"):
        documents.read_view_masks(spark, str(tmp_path / "m2.npy")).collect()


def test_array_files(spark, tmp_path):
    masks = spark.createDataFrame([("a", 1, "hook"), ("a", 2, "gripper")], "s string, point int, executor string")
    counts = spark.createDataFrame([("a", 3), ("b", 2)], "s string, n_points int")
    documents.export_files(documents.mask_arrays(masks, counts, "s", "point"), str(tmp_path / "out"), "s", ".npy")
    a, b = np.load(tmp_path / "out" / "a.npy"), np.load(tmp_path / "out" / "b.npy")
    assert a.tolist() == [[0, 0, 0, 0], [0, 0, 1, 0], [1, 0, 0, 0]] and b.shape == (2, 4) and not b.any()
    back = files.masks_of_length(files.read_arrays(spark, str(tmp_path / "out" / "a.npy")), files.read_arrays(spark, str(tmp_path / "out" / "a.npy")).select("path").distinct().withColumn("n_points", F.lit(3)))
    assert {(r.point_idx, r.executor) for r in back.collect()} == {(1, "hook"), (2, "gripper")}
    cand = spark.createDataFrame([("a", 2, "B", [0]), ("a", 1, "A", [1, 2])], "s string, place int, candidate_id string, points array<int>")
    z = np.load(io.BytesIO(bytes(documents.candidate_archives(cand, counts, "s").first()["data"])))
    assert z["masks"].tolist() == [[0, 1, 1], [1, 0, 0]] and z["candidate_ids"].tolist() == ["A", "B"]
    px = spark.createDataFrame([("v", 1, 0, 9, 8, 7)], "view string, px int, py int, r int, g int, b int")
    import zlib

    data = bytes(documents.pictures(px, ["view"], 2).first()["data"])
    raw = zlib.decompress(data[data.index(b"IDAT") + 4 : data.index(b"IEND") - 8])
    assert list(raw[:7]) == [0, 14, 16, 20, 9, 8, 7]
    rows = spark.createDataFrame([("s1", "odd"), ("s2", "val")], "sample_id string, split string")
    documents.write_known_splits(rows, str(tmp_path / "splits"))
    assert sorted(p.name for p in (tmp_path / "splits").iterdir()) == ["contrast_test", "odd", "test", "train", "val"]
    s = documents.summary(rows, ["split"]).first()
    assert (s["rows"], s["split"]) == (2, {"odd": 1, "val": 1})


def test_lines_are_numbered_over_splits(spark, tmp_path):
    n = 3000
    (tmp_path / "f.jsonl").write_text("".join(json.dumps({"i": i, "pad": "x" * (i % 50)}) + "\n" for i in range(n)) + "[1]\n\nnope\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        lines = files.read_lines(spark, str(tmp_path / "f.jsonl"))
        assert spark.read.text(str(tmp_path / "f.jsonl")).rdd.getNumPartitions() > 3
        got = {r.line_no: r.value for r in lines.collect()}
        assert len(got) == n + 3 and all(json.loads(got[i + 1])["i"] == i for i in range(n))
        rows, issues = files.read_jsonl_checked(spark, str(tmp_path / "f.jsonl"), "i int", 5)
        assert [r.i for r in rows.orderBy("line_no").collect()] == list(range(5))
        assert sorted((r.line_no, r.message) for r in issues.collect()) == [(n + 1, "row is not an object"), (n + 3, "invalid JSON")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_state_keeps_few_versions(spark, tmp_path):
    schema = "k string, seq long, v string"
    (tmp_path / "log").mkdir()
    want = {}
    for batch in range(5):
        rows = [{"k": f"k{i}", "seq": batch * 10 + i, "v": f"{batch}.{i}"} for i in range(batch, batch + 4)]
        (tmp_path / "log" / f"{batch}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        want |= {r["k"]: r["v"] for r in rows}
        audit.latest_state(audit.read_log(spark, str(tmp_path / "log"), schema), str(tmp_path / "state"), str(tmp_path / "ck"), ["k"], "seq", 4).awaitTermination(90)
    assert {r.k: r.v for r in audit.current_state(spark, str(tmp_path / "state"), schema).collect()} == want


def test_split_issues_say_everything(spark):
    m = spark.createDataFrame([("a", "val")], "sample_id string, split string")
    f = spark.createDataFrame([("train", "a"), ("train", "a"), ("test", "a"), ("val", "z")], "split string, sample_id string")
    assert sorted((r.sample_id, r.message) for r in validate.split_issues(m, f).collect()) == [("a", "doubled in split file"), ("a", "in two splits"), ("z", "not in metadata")]


def _cloud(spark, n=160, weak=60):
    rng = np.random.default_rng(4)
    xyz = rng.normal(size=(n, 3)) * [1, 2, 0.4]
    rows = [("a", i, *map(float, p), [s for s, on in (("target", i < 50), ("veto", i % 9 == 0), ("weak_hook", 20 < i < weak)) if on]) for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "obj string, point long, x double, y double, z double, seeds array<string>")


def test_growth_by_hand(spark):
    """Growth candidates against plain loops: gates, components along out-edges, the pair, and what starts selected."""
    p = _cloud(spark)
    s = candidates.GROWTH
    pts = {r.point: (r.x, r.y, r.z, set(r.seeds)) for r in p.collect()}
    n = len(pts)
    near = {a: sorted((b for b in pts if b != a), key=lambda b: (sum((pts[a][k] - pts[b][k]) ** 2 for k in range(3)), b))[: s.neighbours] for a in pts}
    ok = {a for a in pts if "veto" not in pts[a][3]}
    grow = lambda seed: (seed | {b for a in seed for b in near[a]}) & ok

    def parts(seed):
        taken, found = set(), []
        for a in sorted(seed):
            if a not in taken:
                taken.add(a)
                queue = [a]
                for x in queue:
                    for b in near[x]:
                        if b in seed and b not in taken:
                            taken.add(b)
                            queue.append(b)
                found.append(set(queue))
        return sorted(found, key=lambda q: -len(q))[: s.components]

    target, weak = ({a for a in ok if k in pts[a][3]} for k in ("target", "weak_hook"))
    drafts = [("semantic_target_union", grow(target), 0.45, 20.0), ("semantic_target_core", target, 0.45, 30.0), ("source_weak_mask_fallback", grow(weak), 0.65, 7.0), ("source_weak_mask_core", weak, 0.65, 17.0)]
    drafts += [("source_weak_mask_component_expanded", grow(q), 0.65, 9 + 0.1 * i) for i, q in enumerate(parts(weak), 1)]
    for i, q in enumerate(parts(target), 1):
        drafts += [("semantic_target_component_expanded", grow(q), 0.45, 8 + 0.1 * i), ("semantic_target_component_core", q, 0.45, 18 + 0.1 * i)]
    if len(parts(target)) > 1:
        drafts.append(("semantic_paired_target_components", grow(parts(target)[0]) | grow(parts(target)[1]), 0.45, 6.0))
    kept = []
    for family, mask, most, priority in drafts:
        if s.least_points <= len(mask) <= int(n * most) and not any(len(mask & k[1]) / len(mask | k[1]) >= 0.90 for k in kept):
            kept.append((family, mask, most, priority))
    kept.sort(key=lambda k: (k[3], -len(k[1])))
    got = candidates.rank(candidates.generate(p, "obj", "point", "growth"), "obj").orderBy("place").collect()
    assert [(r.family, set(r.points), r.priority) for r in got] == [(f, m, pytest.approx(q)) for f, m, _, q in kept] and len(got) >= 3
    first = candidates.growth_defaults(candidates.rank(candidates.generate(p, "obj", "point", "growth"), "obj"), "obj").collect()
    assert first and all(r.candidate_id for r in first)


def test_high_recall_values(spark):
    """Priorities, groups and largest shares of the families; bands of an axis share a group, axes do not."""
    made = candidates.generate(_cloud(spark, weak=26), "obj", "point", "high_recall").collect()
    bands = {r.part_group: [] for r in made if r.family == "coarse_axis_partition"}
    for r in made:
        if r.family == "coarse_axis_partition":
            bands[r.part_group].append(round(r.priority, 2))
    assert bands == {"coarse_partition_x": [70.01, 70.02, 70.03], "coarse_partition_y": [71.01, 71.02, 71.03], "coarse_partition_z": [72.01, 72.02, 72.03]}
    by = lambda family: [r for r in made if r.family == family and not r.name.startswith("baseline_")]
    assert [(r.priority, r.part_group) for r in by("expanded_existing_weak_mask")] == [(18.0, "weak_mask_prior")] and [r.priority for r in by("existing_weak_mask")] == [34.0]
    base = {r.part_group for r in made if r.name.startswith("baseline_")}
    assert base and all(g.startswith("baseline_") for g in base) and {r.priority for r in made if r.name.startswith("baseline_")} <= {8, 12, 9, 13, 14, 18, 28, 34, 16, 32, 55, 48, 49, 60, 52, 53, 42, 80} | {round(b + 0.1 * i, 1) for b in (20, 44, 36, 22) for i in range(9)}
    for r in made:
        if r.family in ("small_part_seed", "expanded_small_part_seed"):
            assert r.point_count <= 16 and 16 < r.priority < 29
        if r.family in ("strict_loop_handle_lip_seed", "expanded_strict_loop_handle_lip_seed"):
            assert r.point_count <= int(160 * 0.38)
    placed = candidates.rank_high_recall(candidates.generate(_cloud(spark, weak=26), "obj", "point", "high_recall"), "obj").collect()
    assert len(placed) == len(made) <= 64


def test_review_counts(spark):
    s = spark.createDataFrame([("a", "pick_up"), ("b", "pick_up")], "sample_id string, task string")
    cols = ", ".join(f"{e}_{k} string" for e in ("gripper", "suction", "hook", "dexterous_hand") for k in ("decision", "issue_type", "notes"))
    r = spark.createDataFrame([("a", "checked", "yes", "refine", "over_label", *[""] * 10)], f"sample_id string, review_status string, keep_sample string, {cols}")
    got = {(x.counter, x.a, x.b): x.n for x in review.review_counters(s, r).collect()}
    assert got[("task_keep", "pick_up", "<empty>")] == 1 and got[("executor_refine", "gripper", "refine")] == 1 and got[("rule_error", "gripper", "over_label")] == 1 and got[("executor_decision", "hook", "<empty>")] == 1


def test_part_helpers(spark):
    assert candidates.oriented(3, 10, 10) == "rows" and candidates.oriented(10, 3, 10) == "columns"
    with pytest.raises(ValueError):
        candidates.oriented(3, 4, 10)
    lab = spark.createDataFrame([("o", 0, 1, 2), ("o", 1, -1, 0), ("o", 2, 1, None)], "obj string, point int, sem int, inst int")
    assert {(r.part, r.point) for r in candidates.masks_from_labels(lab, "obj", "point").collect()} == {("1_2", 0), ("1", 2)}
    made = spark.createDataFrame([("a", 1)], "obj string, x int")
    objs = spark.createDataFrame([("a",), ("b",)], "obj string")
    fall = spark.createDataFrame([("a", 5), ("b", 6)], "obj string, x int")
    assert sorted(map(tuple, candidates.with_fallback(made, objs, fall, "obj").collect())) == [("a", 1, False), ("b", 6, True)]


def test_parts_in_all_forms(spark, tmp_path):
    from pointloom.sources import parts

    of = lambda doc, n=4: [(a, b, c.tolist()) for a, b, c in parts.parts_of(doc, n)]
    assert of({"masks": [[1, 0, 0, 1], [0, 1, 0, 0]], "names": ["lid"], "scores": {"1": 0.5}}) == [("lid", None, [0, 3]), ("part_01", 0.5, [1])]
    assert of({"masks": np.array([[1, 0], [0, 1], [0, 0], [1, 0]])}) == [("part_00", None, [0, 3]), ("part_01", None, [1])]
    assert of({"semantic": [1, 1, -1, 2], "instance": [0, 1, 0, -1]}) == [("part_00", None, [0]), ("part_01", None, [1])]
    assert of({"labels": [5, -1], "point_indices": [3, 1]}) == [("part_00", None, [3])]
    assert of({"parts": [{"name": "rim", "indices": [2, 0, 2], "score": 1}]}) == [("rim", 1.0, [0, 2])]
    for bad in ({}, {"masks": [[1, 0, 1]]}, {"parts": [{"indices": [9]}]}):
        with pytest.raises(ValueError):
            of(bad)
    np.savez(tmp_path / "p.npz", masks=np.array([[1, 1, 0, 0], [0, 0, 1, 1], [0, 0, 0, 1]]), names=np.array(["a", "b", "c"]), scores=np.array([0.1, 0.9, 0.9]))
    got = parts.rank_parts(parts.read_parts(spark, str(tmp_path / "p.npz"), 4), ["path"], 1, 2).orderBy("place").collect()
    assert [(r.name, r.points) for r in got] == [("b", [2, 3]), ("c", [3])]


def test_archives_hold_plain_data_only(spark, tmp_path):
    import pickle
    import zipfile

    from pointloom.sources import parts

    items = [{"shape_id": "o1", "semantic class": "Mug", "full_shape": {"coordinate": np.zeros((2, 3)), "label": {"grasp": np.array([0.0, 0.7])}}}]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("ok.pkl", pickle.dumps(items))
        z.writestr("bad.pkl", pickle.dumps([print]))
    got = parts.read_archive(spark, str(tmp_path / "a.zip"), "ok.pkl").orderBy("point_idx").collect()
    assert [(r.object_id, r.category, r.labels) for r in got] == [("o1", "Mug", {}), ("o1", "Mug", {"grasp": 0.7})]
    with pytest.raises(pickle.UnpicklingError, match="not allowed"):
        parts.read_archive(spark, str(tmp_path / "a.zip"), "bad.pkl")
    with pytest.raises(ValueError):
        parts.read_archive(spark, str(tmp_path / "a.zip"), "none.pkl")
