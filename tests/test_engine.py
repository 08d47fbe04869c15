"""Operators that SQL cannot state, and edge cases, on fixtures small enough to check by hand."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom import constants as c
from pointloom.functions import boxes, text
from pointloom.operators import candidates, geometry, graph, joins, raster, review, rules, validate, votes, windows
from pointloom.plans import pipeline
from pointloom.sources import files
from pointloom.streaming import audit


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lattice(spark):
    pts = [("a", i, float(i % 3), float(i // 3 % 3), float(i // 9)) for i in range(27)]
    return spark.createDataFrame(pts, "obj string, point long, x double, y double, z double")


def test_labels_go_on_beyond_one_byte(spark):
    """First letters of codes from 256 on, a byte order mark and four-byte characters, as chr gives them."""
    firsts = [64, 90, 127, 128, 255, 256, 300, 0x1000, 0xD7FF, 0xE000, 0xFEFF, 0xFFFF, 0x10000, 0x10FFFF]
    at = [26 * (f - 64) + k for f in firsts[1:] for k in (0, 25)]
    got = spark.createDataFrame([(i,) for i in [*at, 0, -65, None]], "i long").select("i", text.candidate_label(F.col("i")).alias("v")).collect()
    assert {r.i: r.v for r in got} == {i: chr(64 + i // 26) + chr(65 + i % 26) for i in at} | {0: "A", -65: "\0", None: None}
    with pytest.raises(Exception, match="no character has code point 55296"):
        spark.range(1).select(text.candidate_label(F.col("id") + 26 * (0xD800 - 64))).collect()


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, text.sanitize_id(lit("  a b/c__ "))) == "a_b_c"
    assert one(spark, text.slug(lit("**"))) == "target_part"
    assert one(spark, text.safe_name(lit("ä b!!c"))) == "ä_b__c"
    assert one(spark, text.candidate_label(lit(27))) == "AB" and one(spark, text.candidate_label_numbered(lit(26))) == "C27"
    assert one(spark, text.parse_id_list(lit("b, a,B,,"))) == ["B", "A"]
    assert json.loads(one(spark, text.extract_json(lit('x {"a": 1} y')))) == {"a": 1}
    assert json.loads(one(spark, text.repair_json(lit('```json\n{“a”: True, "b": [1,2,],\n```')))) == {"a": True, "b": [1, 2]}
    assert one(spark, text.repair_json(lit("none here"))) is None
    assert one(spark, text.confidence(lit("1.7"))) == 1.0 and one(spark, text.confidence(lit("x"))) == 0.0
    assert one(spark, text.portable_path(lit("C:\\old\\Data\\m\\a.npy"), "Data")) == "m/a.npy"
    assert one(spark, text.next_free_number("M", F.array(lit("M1"), lit("M2")), lit(1))) == "M3"
    assert one(spark, text.row_key(lit(" "), lit("p"), lit(""), lit("hook"))) == "p|hook"
    assert [one(spark, text.scalar_kind(lit(v))) for v in ("None", "TRUE", '{"x":1}', "[1,2", "y")] == ["null", "boolean", "json", "string", "string"]


def test_boxes(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    w, h = F.lit(100), F.lit(50)
    assert one(spark, boxes.normalize_box(arr(0.9, 0.8, 0.1, 0.2), w, h)) == [10, 10, 90, 40]
    assert one(spark, boxes.normalize_box(arr(2.5, 3.5, 200, 20), w, h)) == [2, 4, 99, 20]
    assert one(spark, boxes.normalize_box(arr(5, 5, 5, 9), w, h)) is None
    assert one(spark, boxes.intersect(arr(0, 0, 4, 4), arr(4, 0, 8, 4))) is None
    assert one(spark, boxes.normalize_points(F.array(arr(0.5, 0.5), arr(50, 25), arr(1)), w, h)) == [[50, 25]]


def test_knn_ties_and_forms(spark):
    p = lattice(spark)
    a = {tuple(r) for r in geometry.knn(p, "obj", "point", 5).select("src", "rank", "dst").collect()}
    b = {tuple(r) for r in geometry.knn_join(p, "obj", "point", 5).select("src", "rank", "dst").collect()}
    assert a == b and len(a) == 27 * 5
    lone = p.filter("point = 0")
    assert geometry.knn(lone, "obj", "point", 5).count() == 0


def test_pca_of_a_plane_and_a_line(spark):
    pts = [("plane", i, float(i % 10), float(i // 10), 0.0) for i in range(100)] + [("line", i, float(i), 0.0, 0.0) for i in range(40)]
    p = spark.createDataFrame(pts, "obj string, point long, x double, y double, z double")
    f = geometry.local_pca(p, geometry.knn(p, "obj", "point", 8), "obj", "point").toPandas()
    plane, line = f[f.obj == "plane"], f[f.obj == "line"]
    assert plane.curvature.abs().max() < 1e-6 and (plane.nz.abs() > 0.999).all()
    assert (line.linearity > 0.999).all()


def test_normalize_degenerate(spark):
    p = spark.createDataFrame([("a", 0, 1.0, 1.0, 1.0)], "obj string, point long, x double, y double, z double")
    assert geometry.normalize(p, "obj", "unit_sphere", "one").first()["x"] == 0.0
    with pytest.raises(Exception, match="no extent"):
        geometry.normalize(p, "obj", "unit_sphere").collect()
    odd = spark.createDataFrame([("a", 0, float("nan"), 1.0, 1.0), ("a", 1, float("inf"), 0.0, 0.0), ("a", 2, 0.0, 0.0, 0.0)], p.schema)
    assert [r.point for r in geometry.finite_rows(odd).collect()] == [2]


def test_scan_components_are_directed(spark):
    seed = spark.createDataFrame([("a", i) for i in (0, 1, 2, 3)], "obj string, point long")
    # 1 -> 0 only: a scan from 0 does not reach 1
    g = spark.createDataFrame([("a", 1, 1, 0), ("a", 2, 1, 3)], "obj string, src long, rank int, dst long")
    found = {}
    for r in graph.scan_components(seed, g, "obj", "point").collect():
        found.setdefault(r.component, set()).add(r.point)
    assert sorted(map(sorted, found.values())) == [[0], [1], [2, 3]]
    assert graph.expand(seed.filter("point = 1"), g, "obj", "point", 1).count() == 2


def test_components_2d_and_dilation(spark):
    px = spark.createDataFrame([("v", 0, 0), ("v", 1, 1), ("v", 5, 5)], "view string, px int, py int")
    b = raster.component_boxes(raster.components_2d(px, ["view"]), ["view"]).orderBy("component").collect()
    assert [(r.area, r.x1, r.x2) for r in b] == [(2, 0, 1), (1, 5, 5)]
    assert raster.dilate(px.filter("px = 0"), ["view"], 1, 10).count() == 3


def test_projection_keeps_the_nearest(spark):
    p = spark.createDataFrame([("a", 0, 0.0, 0.0, 0.0), ("a", 1, 0.0, 0.0, 1.0), ("a", 2, 1.0, 1.0, 0.5)], "obj string, point long, x double, y double, z double")
    v = raster.project(p, raster.views(spark, ["front", "yaw180_elev000"]), "obj", "point", 20)
    assert {r.point for r in v.filter("view = 'front'").collect()} == {1, 2}
    assert {r.point for r in v.filter("view = 'yaw180_elev000'").collect()} == {0, 2}


def test_greedy_dedupe_at_the_limit(spark):
    sets = [("a", 0, list(range(10))), ("a", 1, list(range(9))), ("a", 2, list(range(8)) + [20, 21]), ("a", 3, list(range(10)))]
    d = spark.createDataFrame(sets, "obj string, ord int, points array<int>")
    assert sorted(r.ord for r in windows.greedy_dedupe(d, ["obj"], "ord", "points", 0.9).collect()) == [0, 2]
    assert sorted(r.ord for r in windows.greedy_dedupe(d, ["obj"], "ord", "points", 0.95).collect()) == [0, 1, 2]


def test_round_robin_and_caps(spark):
    d = spark.createDataFrame([(i, "x" if i < 5 else "y") for i in range(7)], "seq int, k string")
    assert [r.seq for r in windows.round_robin(d, ["k"], "seq", 4).orderBy("pick").collect()] == [0, 5, 1, 6]
    assert [r.seq for r in windows.round_robin(d, ["k"], "seq", 9).orderBy("pick").collect()] == list(range(7))
    assert [r.seq for r in windows.cap_per_group(d, ["k"], "seq", 2, 3).collect()] == [0, 1, 5]


def test_last_wins_and_upsert(spark):
    d = spark.createDataFrame([(1, "a", "old"), (2, "b", "x"), (3, "a", None)], "seq int, k string, v string")
    got = {r.k: (r.v, r.first_seq) for r in windows.last_wins(d, ["k"], "seq").collect()}
    assert got == {"a": (None, 1), "b": ("x", 2)}
    up = windows.upsert(d.filter("seq < 3"), spark.createDataFrame([(0, "a", "new")], d.schema), ["k"], "seq")
    assert {r.k: r.v for r in up.collect()} == {"a": "new", "b": "x"}


def test_rules(spark):
    f = lambda n, t: one(spark, rules.executors_of_region(F.lit(n), F.lit(t)))
    assert f("Handle-Ring", "pick_up") == ["gripper", "hook", "dexterous_hand"]
    assert f("spring", "open_pull") == ["hook"]  # keywords count inside words
    assert f("front panel", "open_pull") == ["suction"]
    gate = lambda d, shown, s, u: one(spark, rules.acceptance_gate(F.lit(d), F.lit(True), F.lit(shown).cast("boolean"), F.lit(s), F.lit(u), 2))
    assert gate("accept_candidate", False, 5, 0) == "reject_candidate"
    assert gate("accept_candidate", True, 1, 0) == "uncertain"
    assert gate("accept_candidate", None, 0, 0) == "reject_candidate"
    assert gate("uncertain", True, 2, 0) == "uncertain"


def test_weak_masks_gate_each_affordance(spark):
    labels = spark.createDataFrame([("o", "grasp", i) for i in range(8)] + [("o", "lift", i) for i in range(7)] + [("o", "pull", i) for i in range(30)], "obj string, affordance string, point int")
    totals = spark.createDataFrame([("o", 100)], "obj string, n_points int")
    m = rules.weak_masks(labels, totals, rules.weak_label_rules(spark), "obj", "point")
    n = {(r.task, r.executor): r["count"] for r in m.groupBy("task", "executor").count().collect()}
    assert n[("pick_up", "gripper")] == 8 and n[("open_pull", "gripper")] == 30 and n[("open_pull", "suction")] == 30 and ("open_pull", "hook") not in n


def test_votes(spark):
    px = spark.createDataFrame([("s", "v", 0, 0, 1), ("s", "v", 1, 0, 1), ("s", "v", 5, 5, 2), ("s", "w", 0, 0, 1)], "sid string, view string, px int, py int, point int")
    reg = spark.createDataFrame([("s", "v", 1, "target", 0, 0, 1, 1), ("s", "v", 2, "target", 0, 0, 0, 0)], "sid string, view string, region int, role string, x1 int, y1 int, x2 int, y2 int")
    got = {r.point: (r.votes, r.visible) for r in votes.region_votes(px, reg, ["sid"], "view", "point", 0, 10).collect()}
    assert got == {1: (3, 3), 2: (0, 1)}
    plans = spark.createDataFrame([("p", 0, ["a", "b"], 0.5), ("p", 1, ["b"], 1.0)], "pid string, seq int, parts array<string>, confidence double")
    top = votes.combine_plans(plans, ["pid"], "seq", ["parts"]).orderBy("place").collect()
    assert [(r.item, r.votes, r.mean_confidence) for r in top] == [("b", 2, 0.75), ("a", 1, 0.75)]


def test_validation_of_lines(spark, tmp_path):
    good = {f: "x" for f in c.REQUIRED_FIELDS}
    bad = dict(good)
    del bad["split"]
    (tmp_path / "s.jsonl").write_text("\n".join([json.dumps(good), "", "{oops", "[1]", json.dumps(bad)]))
    lines = files.read_lines(spark, str(tmp_path / "s.jsonl"))
    assert {(r.line_no, r.message) for r in validate.text_issues(lines).collect()} == {(3, "invalid JSON"), (4, "row is not an object")}
    assert {r.line_no: r.missing for r in validate.missing_fields(lines).collect() if r.missing} == {5: ["split"]}
    rows, issues = files.read_jsonl_checked(spark, str(tmp_path / "s.jsonl"), "object_id string, task string", 1)
    assert [r.line_no for r in rows.collect()] == [1] and issues.count() == 2


def test_split_issues(spark):
    s = spark.createDataFrame([("a", "train"), ("b", "val"), ("c", "val")], "sample_id string, split string")
    f = spark.createDataFrame([("train", "a"), ("val", "a"), ("val", "b"), ("val", "b"), ("val", "z")], "split string, sample_id string")
    assert {r.sample_id: r.message for r in validate.split_issues(s, f).collect()} == {"a": "in two splits", "b": "doubled in split file", "c": "missing from split file", "z": "not in metadata"}


def test_review_applies(spark):
    samples = spark.createDataFrame([("s1", "Mug", "pick_up", "weak"), ("s2", "Mug", "pick_up", "weak")], "sample_id string, object_category string, task string, quality_flag string")
    masks = spark.createDataFrame([("s1", "gripper", 1), ("s1", "hook", 2), ("s2", "hook", 3)], "sample_id string, executor string, point int")
    cols = ["sample_id", "review_status", "keep_sample", "sample_issue_type", "sample_notes", "quality_after_review"] + [f"{e}_{k}" for e in c.EXECUTORS for k in ("decision", "issue_type", "notes")]
    row = lambda sid, status, keep, hook: [sid, status, keep, "", "", "checked"] + [v for e in c.EXECUTORS for v in ((hook if e == "hook" else "keep"), "", "")]
    r = spark.createDataFrame([row("s1", "checked", "yes", "disable"), row("s2", "reject", "", "refine")], cols)
    out = review.apply_review(samples, masks, r, "point")
    assert [x.sample_id for x in out["kept"].collect()] == ["s1"] and out["rejected"].first().sample_id == "s2"
    assert {(x.executor, x.point) for x in out["masks"].collect()} == {("gripper", 1)}
    assert {x.executor: x.feasible for x in out["feasibility"].collect()} == {"gripper": True, "suction": False, "hook": False, "dexterous_hand": False}
    assert out["refine_queue"].count() == 0


def test_resolve_key(spark):
    d = spark.createDataFrame([("k1", "s"), ("k2", "s"), ("k3", "t")], "row_key string, sample_id string")
    assert review.resolve_key(d, "t").first().row_key == "k3" and review.resolve_key(d, "k1").count() == 1
    with pytest.raises(Exception, match="ambiguous"):
        review.resolve_key(d, "s").collect()


def test_strict_join_and_snap(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no partner for 2"):
        joins.strict_join(a, b, ["k"]).collect()
    pts = spark.createDataFrame([("v", 1, 5, 5)], "view string, id int, x int, y int")
    px = spark.createDataFrame([("v", 6, 5), ("v", 4, 5), ("v", 5, 4)], "view string, px int, py int")
    assert tuple(joins.snap(pts, px, ["view"], "id", 1).first())[2:4] == (5, 4)


def test_candidates(spark):
    rng = np.random.default_rng(0)
    pts = [("a", i, *map(float, rng.normal(size=3)), ["weak_hook"] if i < 40 else []) for i in range(200)] + [("tiny", 0, 0.0, 0.0, 0.0, [])]
    p = spark.createDataFrame(pts, "obj string, point long, x double, y double, z double, seeds array<string>")
    for kind in candidates.FAMILIES:
        got = candidates.rank(candidates.generate(p, "obj", "point", kind), "obj", 36).collect()
        assert got and {r.obj for r in got} == {"a"} and got[0].candidate_id == "A"
        for r in got:
            assert r.point_count == len(r.points) >= 4
        again = candidates.rank(candidates.generate(p.repartition(3), "obj", "point", kind), "obj", 36).collect()
        assert [(r.name, r.points) for r in got] == [(r.name, r.points) for r in again]


def test_arrays_round_trip(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(12).reshape(2, 6))
    np.savez(tmp_path / "b.npz", m=np.array([[1, 0, 0, 1], [0, 2, 0, 0]]))
    pts = files.points_of(files.read_arrays(spark, str(tmp_path / "a.npy"))).orderBy("point_idx").collect()
    assert [r.nz for r in pts] == [5.0, 11.0]
    m = files.masks_of(files.read_arrays(spark, str(tmp_path / "b.npz"), "m")).collect()
    assert {(r.point_idx, r.executor) for r in m} == {(0, "gripper"), (0, "dexterous_hand"), (1, "suction")}
    with pytest.raises(Exception, match="N x 4"):
        files.masks_of(files.read_arrays(spark, str(tmp_path / "a.npy"))).collect()


def test_manifest_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("\ufeffobject_id,task,feasible_hook,negative_reason_suction,a.b\no 1,pick_up,TRUE,,v\n", encoding="utf-8")
    d = files.normalize_samples(files.read_manifest(spark, str(tmp_path / "m.csv")))
    r = d.first()
    assert r.object_id == "o_1" and r.feasibility == {"gripper": False, "suction": False, "hook": True, "dexterous_hand": False} and r.a == {"b": "v"}


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([("train", "a", 1)], "split string, sample_id string, _seq int")
    files.write_jsonl(d, str(tmp_path / "j"))
    assert "_seq" not in spark.read.json(str(tmp_path / "j")).columns
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_jsonl(d, str(tmp_path / "j"))
    files.write_splits(d, str(tmp_path / "sp"))
    assert spark.read.text(str(tmp_path / "sp/split=train")).first()[0] == "a"
    assert files.read_jsonl_lenient(spark, str(tmp_path / "no.jsonl"), "a int").count() == 0


def test_audit_stream(spark, tmp_path):
    schema = "row_key string, seq long, v string"
    src = tmp_path / "log"
    src.mkdir()
    (src / "1.json").write_text('{"row_key":"a","seq":1,"v":"x"}\n{"row_key":"b","seq":2,"v":"y"}\n')
    for extra in (None, '{"row_key":"a","seq":3,"v":"z"}\n'):
        if extra:
            (src / "2.json").write_text(extra)
        audit.latest_state(audit.read_log(spark, str(src), schema), str(tmp_path / "state"), str(tmp_path / "ck"), ["row_key"], "seq").awaitTermination(60)
    assert {r.row_key: r.v for r in audit.current_state(spark, str(tmp_path / "state"), schema).collect()} == {"a": "z", "b": "y"}


def test_pipeline(spark):
    assert pipeline.stage_order(["build", "plan"]) == ["views", "plan", "build"]
    assert pipeline.task_filter("all", c.TASKS) is None and pipeline.task_filter("", c.TASKS) == []
    pts = lattice(spark).select(F.col("obj").alias("object_id"), F.col("point").alias("point_idx"), "x", "y", "z")
    pilots = spark.createDataFrame([("p", "a", "hook", "open_pull")], "pilot_id string, object_id string, executor string, task string")
    base = spark.createDataFrame([("p", "gripper", 0), ("p", "hook", 1)], "pilot_id string, executor string, point_idx long")
    out = pipeline.run(pts, pilots, pipeline.DryRun(view="v", kind="selected", confidence=1.0), base, 1, "standard")
    left = {(r.executor, r.point_idx) for r in out["masks"].collect()}
    assert ("gripper", 0) in left and out["scored"].count() > 0


def test_model_output(spark):
    from pointloom.functions import model_output as m

    raw = '```json\n{"target_part_names": [" a ", "a", "b"], "confidence": "2", "feasible": false}\n```'
    p = one(spark, m.plan(F.lit(raw)))
    assert (p.target_positive_parts, p.confidence, p.feasible) == (["a", "b"], 1.0, False)
    assert one(spark, m.plan(F.lit("no json"))).target_positive_parts == []
    s = one(spark, m.selection(F.lit('{"selected": ["a", "x"], "uncertain": ["A", "b"], "confidence": 0.5}'), F.array(F.lit("A"), F.lit("B"))))
    assert (s.selected_candidates, s.uncertain_candidates, s.rejected_candidates) == (["A"], ["B"], [])
    reg = '{"target_regions": [{"part_name": "p", "box": [0, 0, 1, 1], "positive_points": [[0.5, 0.5]], "confidence": 0.7}, {"part_name": "q"}, {"box": [5, 5, 20, 20]}]}'
    r = one(spark, m.regions(F.lit(reg), "target_regions", "target", F.lit(100), F.lit(100), 5, 0.6))
    assert [(x.box, x.positive_points) for x in r] == [(None, [[50, 50]]), ([5, 5, 20, 20], [])]
    c_ = one(spark, m.coverage(F.lit("{'bad"), F.lit(10), F.lit(10)))
    assert c_.coverage_status == "uncertain" and not c_.should_trigger_missing_candidate
    d = spark.range(1).select("id", m.selection(F.lit('{"selected": ["A"], "uncertain": ["B"]}'), F.array(F.lit("A"), F.lit("B"))).alias("selection"))
    assert {(x.candidate_id, x.kind) for x in m.explode_selection(d, ["id"]).collect()} == {("A", "selected"), ("B", "uncertain")}


def test_component_proposals(spark):
    body = [("o", "v", x, y, y * 40 + x) for y in range(20, 40) for x in range(40)]
    knob = [("o", "v", x, y, 5000 + y * 40 + x) for y in range(2, 6) for x in range(3, 7)]
    px = spark.createDataFrame(body + knob, "obj string, view string, px int, py int, point int")
    tot = spark.createDataFrame([("o", len(body) + len(knob))], "obj string, n_points int")
    got = raster.component_proposals(px, ["obj"], "view", "point", tot, 64, 1)
    assert got.count() == 0  # the only component is the largest one
    far = [("o", "v", x, y, 9000 + y * 64 + x) for y in range(7, 19) for x in range(20, 26)]
    got = raster.component_proposals(px.unionByName(spark.createDataFrame(far, px.schema)), ["obj"], "view", "point", tot.withColumn("n_points", F.lit(2000)), 64, 1)
    assert {r.point for r in got.collect()} == {k[4] for k in knob}


def test_region_documents(spark, tmp_path):
    from pointloom.sources import regions

    doc = {"executors": {"hook": {"indices": [2, 1, 2]}}, "regions": [{"name": "front panel", "mask": [0, 1, 1], "tasks": "open_pull"}], "extra_ring": [0]}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    d = regions.read_regions(spark, str(tmp_path / "r.json"))
    got = {(r["name"], r.point_idx) for r in d.collect()}
    assert got == {("hook", 1), ("hook", 2), ("front panel", 1), ("front panel", 2), ("extra_ring", 0)}
    masks = rules.region_masks(d.withColumn("sample_id", F.lit("s")), "open_pull", "sample_id", "point_idx")
    assert {(r.executor, r.point_idx) for r in masks.collect()} == {("hook", 0), ("hook", 1), ("hook", 2), ("suction", 1), ("suction", 2)}
    (tmp_path / "bad.json").write_text('{"executors": {"claw": [1]}}')
    with pytest.raises(Exception, match="unknown executor"):
        regions.read_regions(spark, str(tmp_path / "bad.json")).collect()
    lab = spark.createDataFrame([("o", {"Wrap Grasp": [0.0, 0.4], "lift": [0.0, 0.0]})], "obj string, label map<string,array<double>>")
    assert [tuple(r) for r in regions.label_masks(lab, "obj").collect()] == [("o", "wrap_grasp", 1)]
