"""Further queries over the test tables: selection, saves, context, boxes, colours, payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom import constants as c
from pointloom.functions import text
from pointloom.operators import candidates, edits, raster, review, rules, validate, votes
from pointloom.plans.driver import _CLOUDS, _in, _masks, _MASKS, clouds, query, read

_ROWS = f"(SELECT p_partkey AS seq, CAST(p_partkey AS VARCHAR) AS sample_id, 'p' || p_size AS pilot_id, ({c.EXECUTORS!r})[CAST(p_partkey % 4 AS INTEGER) + 1] AS executor, ({c.TASKS!r})[p_size % 4 + 1] AS task, p_brand FROM part)"


def _pick(values: list[str], i):
    return F.element_at(F.array(*[F.lit(v) for v in values]), i.cast("int") + 1)


def _rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, d, "part").select(k.alias("seq"), k.cast("string").alias("sample_id"), F.concat(F.lit("p"), F.col("p_size").cast("string")).alias("pilot_id"), _pick(c.EXECUTORS, k % 4).alias("executor"), _pick(c.TASKS, F.col("p_size") % 4).alias("task"), "p_brand")


@query(f"SELECT seq, pilot_id, executor, task FROM {_ROWS} WHERE executor = 'hook' AND task IN ('pick_up', 'open_pull') ORDER BY seq LIMIT 25")
def select_rows(spark: SparkSession, d: str) -> DataFrame:
    return edits.select_rows(_rows(spark, d), "seq", executor="hook", include=["pick_up", "open_pull", "press_push"], exclude=["press_push"], limit=25).select("seq", "pilot_id", "executor", "task")


@query(f"SELECT seq, sample_id, task FROM {_ROWS} WHERE sample_id IN ('3', '14', '15', '92', '65') AND task IN ('pick_up', 'lift_carry', 'press_push') ORDER BY seq LIMIT 4")
def export_rows(spark: SparkSession, d: str) -> DataFrame:
    return edits.export_rows(_rows(spark, d), "seq", ["3", "14", "15", "92", "65"], ["pick_up", "lift_carry", "press_push"], 4).select("seq", "sample_id", "task")


@query("SELECT p_partkey, NOT (p_partkey % 3 = 0 AND p_size % 2 = 0) AS any_feasible FROM part")
def negative_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    m = F.map_from_arrays(F.array(*[F.lit(e) for e in c.EXECUTORS]), F.array(F.lit(False), k % 3 != 0, F.lit(None).cast("boolean"), F.col("p_size") % 2 != 0))
    return read(spark, d, "part").select("p_partkey", edits.any_feasible(m).alias("any_feasible"))


@query("""SELECT o_orderkey, v.l_linenumber, l_quantity IS NOT NULL AS grounded, coalesce(l_quantity, -1) AS confidence FROM (SELECT o_orderkey, unnest([1, 2, 3]) AS l_linenumber FROM orders) v LEFT JOIN (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) g ON o_orderkey = l_orderkey AND v.l_linenumber = g.l_linenumber""")
def grounding_by_view(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "orders").select("o_orderkey", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("l_linenumber"))
    g = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_quantity").alias("confidence")).groupBy("o_orderkey", "l_linenumber").agg(F.max("confidence").alias("confidence"))
    return edits.with_grounding(v, g, ["o_orderkey", "l_linenumber"], True).select("o_orderkey", "l_linenumber", "grounded", F.coalesce("confidence", F.lit(-1.0)).alias("confidence"))


_BOX = "SELECT l_orderkey AS view, l_linenumber * 100000000 + l_partkey * 10 + CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END AS seq, l_returnflag AS query, CASE WHEN l_linestatus = 'F' THEN ' Object ' ELSE 'handle' END AS label, CAST(l_partkey % 300 AS INTEGER) AS x1, CAST(l_suppkey % 300 AS INTEGER) AS y1, CAST(l_partkey % 300 + l_quantity * 6 AS INTEGER) AS x2, CAST(l_suppkey % 300 + l_linenumber * 60 AS INTEGER) AS y2 FROM lineitem"


@query(f"""WITH b AS ({_BOX}), z AS (SELECT o_orderkey AS view, CASE WHEN o_orderkey % 5 <> 0 THEN 150 END AS zx1, 100 AS zy1, CAST(300 + o_orderkey % 100 AS INTEGER) AS zx2, 260 AS zy2 FROM orders),
j AS (SELECT *, (greatest(0, x2 - x1) * greatest(0, y2 - y1)) / 262144.0 > 0.2 OR lower(trim(label)) IN ('object') AS bad FROM b JOIN z USING (view)),
k AS (SELECT *, zx1 IS NOT NULL AND least(x2, zx2) > greatest(x1, zx1) AND least(y2, zy2) > greatest(y1, zy1) AS fits FROM j),
r AS (SELECT view, seq, query, label, CASE WHEN bad THEN 'clip_to_zoom_crop' ELSE 'keep' END AS action, CASE WHEN bad THEN greatest(x1, zx1) ELSE x1 END AS x1, CASE WHEN bad THEN greatest(y1, zy1) ELSE y1 END AS y1, CASE WHEN bad THEN least(x2, zx2) ELSE x2 END AS x2, CASE WHEN bad THEN least(y2, zy2) ELSE y2 END AS y2 FROM k WHERE NOT bad OR fits),
u AS (SELECT view, query, x1, y1, x2, y2, arg_min(label, seq) AS label, arg_min(action, seq) AS action FROM r GROUP BY ALL)
SELECT view, query, label, x1, y1, x2, y2, action FROM u UNION ALL SELECT view, 'handle', 'zoom_crop_fallback', zx1, zy1, zx2, zy2, 'fallback_to_zoom_crop' FROM z WHERE zx1 IS NOT NULL AND view NOT IN (SELECT view FROM u)""")
def refine_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "lineitem").selectExpr("l_orderkey AS view", "l_linenumber * 100000000 + l_partkey * 10 + CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END AS seq", "l_returnflag AS query", "CASE WHEN l_linestatus = 'F' THEN ' Object ' ELSE 'handle' END AS label", "cast(l_partkey % 300 AS int) AS x1", "cast(l_suppkey % 300 AS int) AS y1", "cast(l_partkey % 300 + l_quantity * 6 AS int) AS x2", "cast(l_suppkey % 300 + l_linenumber * 60 AS int) AS y2")
    z = read(spark, d, "orders").selectExpr("o_orderkey AS view", "CASE WHEN o_orderkey % 5 <> 0 THEN named_struct('x1', 150, 'y1', 100, 'x2', cast(300 + o_orderkey % 100 AS int), 'y2', 260) END AS crop", "'handle' AS first_query")
    return edits.refine_boxes(b, z, ["view"], "seq", 512 * 512, 0.2, ["object"])


def _context(spark: SparkSession, d: str, top: int | None) -> DataFrame:
    li = read(spark, d, "lineitem")
    cid = F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("candidate_id")
    ids = li.select(F.col("l_suppkey").alias("pilot"), cid).distinct()
    scores = li.filter("l_partkey % 9 <> 0").groupBy(F.col("l_suppkey").alias("pilot"), "l_partkey").agg(F.count(F.when(F.col("l_returnflag") == "A", 1)).alias("selected_votes"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("uncertain_votes"), F.max("l_discount").alias("rule_score"))
    scores = scores.select("pilot", F.upper(cid).alias("candidate_id"), "selected_votes", "uncertain_votes", "rule_score", _pick(["accept_candidate", "uncertain", "reject_candidate", ""], F.col("l_partkey") % 4).alias("decision"))
    records = li.groupBy(F.col("l_suppkey").alias("pilot"), "l_partkey").agg(F.count("*").alias("point_count")).select("pilot", cid, "point_count")
    start = li.filter("l_partkey % 50 = 0 AND l_suppkey % 3 = 0").select(F.col("l_suppkey").alias("pilot"), cid).distinct()
    out = edits.candidate_context(ids, scores, records, start, ["pilot"], top, 1)
    return out.select("pilot", "candidate_id", "selected_votes", "uncertain_votes", "rule_score", "decision", "point_count", "bucket", "auto_status", "default_checked", "place")


_CONTEXT_SQL = """WITH c AS (SELECT l_suppkey AS pilot, l_partkey AS k, count(*) AS point_count, l_partkey % 50 = 0 AND l_suppkey % 3 = 0 AS d FROM lineitem GROUP BY ALL),
s AS (SELECT l_suppkey AS pilot, l_partkey AS k, count(*) FILTER (l_returnflag = 'A') AS sv, count(*) FILTER (l_returnflag = 'R') AS uv, max(l_discount) AS rs, (['accept_candidate', 'uncertain', 'reject_candidate', ''])[CAST(l_partkey % 4 AS INTEGER) + 1] AS decision FROM lineitem WHERE l_partkey % 9 <> 0 GROUP BY ALL),
j AS (SELECT c.pilot, 'C' || c.k AS candidate_id, coalesce(sv, 0) AS selected_votes, coalesce(uv, 0) AS uncertain_votes, coalesce(rs, 0.0) AS rule_score, coalesce(decision, '') AS decision, point_count, d FROM c LEFT JOIN s ON c.pilot = s.pilot AND c.k = s.k),
b AS (SELECT *, CASE WHEN d THEN 0 WHEN decision = 'accept_candidate' THEN 1 WHEN selected_votes > 0 THEN 2 WHEN decision = 'uncertain' OR uncertain_votes > 0 THEN 3 ELSE 4 END AS bucket, CASE WHEN d THEN 'selected' WHEN decision = 'accept_candidate' THEN 'accepted' WHEN decision = 'uncertain' THEN 'uncertain' ELSE 'candidate' END AS auto_status,
CASE WHEN bool_or(d) OVER (PARTITION BY pilot) THEN d ELSE decision = 'accept_candidate' END AS default_checked FROM j),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY pilot ORDER BY bucket, selected_votes DESC, rule_score DESC, candidate_id) AS INTEGER) AS place FROM b)
"""


@query(_CONTEXT_SQL + "SELECT * EXCLUDE (d) FROM r")
def candidate_context(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d, None)


@query(_CONTEXT_SQL + "SELECT * EXCLUDE (d) FROM r WHERE d OR selected_votes >= 1 QUALIFY row_number() OVER (PARTITION BY pilot ORDER BY NOT d, place) <= 12")
def shown_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d, 12)


@query("""SELECT p_partkey, sample_id, object_category, task, review_status, keep_sample, sample_notes FROM (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS sample_id, p_brand AS object_category, p_type AS task FROM part) s
LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS u, coalesce(arg_max(event_type, event_id) FILTER (event_id % 3 <> 0), 'pending') AS review_status, coalesce(arg_max(CASE WHEN value > 50 THEN 'yes' ELSE 'no' END, event_id) FILTER (event_id % 4 <> 0), '') AS keep_sample, coalesce(arg_max('n' || event_id, event_id) FILTER (event_id % 2 = 0), '') AS sample_notes FROM events WHERE CAST(user_id AS VARCHAR) IN (SELECT CAST(p_partkey AS VARCHAR) FROM part) GROUP BY ALL
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'pending', '', '' FROM part WHERE p_partkey NOT IN (SELECT user_id FROM events)) r ON u = sample_id""")
def save_reviews(spark: SparkSession, d: str) -> DataFrame:
    samples = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("sample_id"), F.col("p_brand").alias("object_category"), F.col("p_type").alias("task"), "p_partkey")
    start = edits.initial_review(samples).drop("task").withColumn("task", F.lit("stale"))
    e = read(spark, d, "events").withColumn("sample_id", F.col("user_id").cast("string")).join(samples.select("sample_id"), "sample_id", "left_semi")
    told = e.selectExpr("sample_id", "event_id AS seq", "CASE WHEN event_id % 3 <> 0 THEN event_type END AS review_status", "CASE WHEN event_id % 4 <> 0 THEN CASE WHEN value > 50 THEN 'yes' ELSE 'no' END END AS keep_sample", "CASE WHEN event_id % 2 = 0 THEN concat('n', event_id) END AS sample_notes")
    done = edits.save_reviews(samples, start, told, "seq", ["sample_id", "object_category", "task", "p_partkey"])
    return done.select("p_partkey", "sample_id", "object_category", "task", "review_status", "keep_sample", "sample_notes")


_EDITED = "e AS (SELECT sample_id, executor, 1 AS seq, list(DISTINCT point + CAST(sample_id % 2 AS INTEGER)) FILTER (point % 3 <> 0) AS given FROM m WHERE executor IN ('hook', 'suction') AND sample_id % 4 <> 1 GROUP BY ALL)"


@query(f"""WITH {_MASKS}, {_EDITED}, n AS (SELECT sample_id, max(point) AS n_points FROM m GROUP BY ALL), a AS (SELECT e.sample_id, e.executor, list_filter(coalesce(given, []), lambda x: x < n_points) AS after, coalesce((SELECT list(DISTINCT point) FROM m WHERE m.sample_id = e.sample_id AND m.executor = e.executor), []) AS before FROM e JOIN n USING (sample_id))
SELECT sample_id, executor, len(before) AS positive_points_before, len(after) AS positive_points_after, len(list_filter(after, lambda x: NOT list_contains(before, x))) AS n_added, len(list_filter(before, lambda x: NOT list_contains(after, x))) AS n_removed FROM a""")
def save_edits(spark: SparkSession, d: str) -> DataFrame:
    _, audit = _saved(spark, d)
    return audit.select(F.col("row_key").alias("sample_id"), "executor", *[F.col(k).cast("long").alias(k) for k in ("positive_points_before", "positive_points_after")], F.size("added_points").cast("long").alias("n_added"), F.size("removed_points").cast("long").alias("n_removed"))


def _saved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = _masks(spark, d).withColumnRenamed("sample_id", "row_key")
    e = m.filter("executor IN ('hook', 'suction') AND row_key % 4 <> 1").groupBy("row_key", "executor").agg(F.collect_set(F.when(F.col("point") % 3 != 0, F.col("point") + F.col("row_key") % 2)).alias("positive_indices"))
    stale = e.select("row_key", "executor", F.array(F.lit(0).cast("long")).alias("positive_indices"), F.lit(0).alias("seq"))
    every = e.withColumn("seq", F.lit(1)).unionByName(stale).withColumn("visible_all_points", F.lit(True))
    return edits.save_edits(m, m.groupBy("row_key").agg(F.max("point").alias("n_points")), every, "seq", "point")


@query(f"""WITH {_MASKS}, {_EDITED}, n AS (SELECT sample_id, max(point) AS n_points FROM m GROUP BY ALL), a AS (SELECT sample_id, executor, unnest(given) AS point FROM e), x AS (SELECT sample_id, executor, point FROM m WHERE (sample_id, executor) NOT IN (SELECT (sample_id, executor) FROM e) UNION SELECT a.* FROM a JOIN n USING (sample_id) WHERE point < n_points)
SELECT sample_id, executor, count(*) AS n_points, CAST(sum(point) AS BIGINT) AS total FROM x GROUP BY ALL""")
def edited_masks(spark: SparkSession, d: str) -> DataFrame:
    masks, _ = _saved(spark, d)
    return masks.groupBy(F.col("row_key").alias("sample_id"), "executor").agg(F.count("*").alias("n_points"), F.sum("point").alias("total"))


@query(f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) WHEN event_id % 3 = 1 THEN event_id % 7 ELSE 0 END AS n, CASE WHEN event_id % 4 = 0 THEN 'gripper' WHEN event_id % 4 = 1 THEN 'suction' ELSE 'hook' END AS executor, CASE WHEN event_id % 5 = 0 THEN '{{}}' ELSE props END AS about FROM events")
def record_fields(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    first = F.when(i % 3 == 0, F.get_json_object("props", "$.k")).when(i % 3 == 1, F.lit(" ")).otherwise(F.lit("many"))
    second = F.when(i % 3 == 1, (i % 7).cast("string"))
    who = F.when(i % 4 == 0, F.lit("")).when(i % 4 == 1, F.lit("suction")).when(i % 4 == 2, F.lit("claw"))
    about = F.when(i % 10 == 0, F.lit("plain text")).when(i % 5 == 0, F.lit("[1]")).otherwise(F.col("props"))
    return read(spark, d, "events").select("event_id", edits.positive_count(first, second).alias("n"), edits.target_executor(who, F.when(i % 4 == 0, F.lit("gripper"))).alias("executor"), text.safe_object(about).alias("about"))


@query("""WITH p AS (SELECT l_suppkey AS view, l_orderkey AS px, l_linenumber AS py, l_quantity AS depth FROM lineitem), s AS (SELECT view, min(depth) AS lo, max(depth) AS hi FROM p GROUP BY view), v AS (SELECT p.*, CASE WHEN hi - lo < 1e-6 THEN 180 ELSE CAST(floor((depth - lo) / (hi - lo) * 205 + 50) AS INTEGER) END AS g FROM p JOIN s USING (view))
SELECT view, px, py, CAST(floor(g / 3) AS INTEGER) AS r, g, CAST(255 - floor(g / 4) AS INTEGER) AS b FROM v""")
def depth_colors(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("view"), F.col("l_orderkey").alias("px"), F.col("l_linenumber").alias("py"), F.col("l_quantity").alias("depth"))
    return raster.depth_colors(p, ["view"]).select("view", "px", "py", "r", "g", "b")


@query("""WITH k AS (SELECT p_partkey AS sample, unnest([1, 2, 3]) AS rank FROM part), f AS (SELECT *, (sample + rank) % 3 <> 0 AS there, CASE WHEN (sample * rank) % 4 = 1 THEN 2047 ELSE 2048 END AS rows, CASE (sample + 2 * rank) % 5 WHEN 0 THEN 3 WHEN 1 THEN NULL ELSE 4 END AS cols FROM k UNION ALL SELECT p_partkey, 9, true, 2048, NULL FROM part),
o AS (SELECT *, CASE WHEN there AND rows = 2048 AND cols = 4 THEN 'all_channels' WHEN there AND rows = 2048 AND cols IS NULL THEN 'target_channel' END AS how FROM f)
SELECT sample, 'm' || rank AS path, how FROM o WHERE how IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample ORDER BY rank) = 1""")
def usable_masks(spark: SparkSession, d: str) -> DataFrame:
    k = read(spark, d, "part").select(F.col("p_partkey").alias("sample"), F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("rank"))
    f = k.selectExpr("sample", "rank", "(sample + rank) % 3 <> 0 AS `exists`", "CASE WHEN (sample * rank) % 4 = 1 THEN 2047 ELSE 2048 END AS rows", "CASE (sample + 2 * rank) % 5 WHEN 0 THEN 3 WHEN 1 THEN NULL ELSE 4 END AS cols")
    f = f.unionByName(read(spark, d, "part").selectExpr("p_partkey AS sample", "9 AS rank", "true AS `exists`", "2048 AS rows", "cast(NULL AS int) AS cols"))
    return edits.usable_masks(f.withColumns({"path": F.concat(F.lit("m"), F.col("rank").cast("string")), "n_points": F.lit(2048)}), ["sample"])


@query(f"WITH {_CLOUDS} SELECT obj, count(*) FILTER (point % 3 = 0) AS preserved, count(*) FILTER (point % 3 <> 0) AS body FROM p GROUP BY obj")
def preserve_split(spark: SparkSession, d: str) -> DataFrame:
    p = clouds(spark, d)
    a, b = edits.split_by_mask(p, p.filter("point % 3 = 0").select("obj", "point"), ["obj", "point"])
    every = a.withColumn("k", F.lit("preserved")).unionByName(b.withColumn("k", F.lit("body")))
    return every.groupBy("obj").agg(F.count(F.when(F.col("k") == "preserved", 1)).alias("preserved"), F.count(F.when(F.col("k") == "body", 1)).alias("body"))


_SETS = "s AS (SELECT DISTINCT l_suppkey AS obj, 'C' || l_linenumber AS candidate_id, l_partkey AS point FROM lineitem)"


@query(f"WITH {_SETS}, t AS (SELECT p_partkey AS point, p_size / 50.0 AS a, p_retailprice AS b FROM part WHERE p_partkey % 5 <> 0) SELECT obj, candidate_id, round(avg(coalesce(a, 0)), 9) AS mean_target_score, max(coalesce(b, 0)) AS max_reject_score FROM s LEFT JOIN t USING (point) GROUP BY ALL")
def candidate_point_scores(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("obj"), F.concat(F.lit("C"), F.col("l_linenumber").cast("string")).alias("candidate_id")).agg(F.collect_set("l_partkey").alias("points"))
    t = read(spark, d, "part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("point"), (F.col("p_size") / 50.0).alias("target_score"), F.col("p_retailprice").alias("reject_score"))
    seen = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("obj"), F.col("l_partkey").alias("point")).distinct().join(t, "point")
    got = candidates.point_scores(s, seen, ["obj"], "point")
    return got.withColumn("mean_target_score", F.round("mean_target_score", 9))


_RANKED = "r AS (SELECT l_orderkey AS obj, l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey AS place, CASE WHEN l_partkey % 11 = 0 THEN 'semantic_paired_target_components' WHEN l_partkey % 3 = 0 THEN 'semantic_target_core' ELSE 'semantic_target_component_expanded' END AS family FROM lineitem WHERE l_suppkey % 2 = 0 OR l_partkey % 3 = 0)"


@query(f"""WITH {_RANKED}, g AS (SELECT *, bool_or(family = 'semantic_paired_target_components') OVER (PARTITION BY obj) AS p, bool_or(family = 'semantic_target_component_expanded') OVER (PARTITION BY obj) AS e, row_number() OVER (PARTITION BY obj, family = 'semantic_target_component_expanded' ORDER BY place) AS n, row_number() OVER (PARTITION BY obj ORDER BY place) AS q FROM r),
f AS (SELECT obj, CAST(q AS INTEGER) AS place FROM g WHERE CASE WHEN p THEN family = 'semantic_paired_target_components' WHEN e THEN family = 'semantic_target_component_expanded' AND n <= 3 ELSE q = 1 END)
SELECT obj, place, chr(64 + place) AS candidate_id FROM f""")
def growth_defaults(spark: SparkSession, d: str) -> DataFrame:
    from pointloom.operators import windows

    r = read(spark, d, "lineitem").filter("l_suppkey % 2 = 0 OR l_partkey % 3 = 0").selectExpr("l_orderkey AS obj", "l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey AS line", "CASE WHEN l_partkey % 11 = 0 THEN 'semantic_paired_target_components' WHEN l_partkey % 3 = 0 THEN 'semantic_target_core' ELSE 'semantic_target_component_expanded' END AS family")
    r = windows.ranked(r, ["obj"], [F.col("line")]).withColumn("candidate_id", text.candidate_label_numbered(F.col("place") - 1))
    return candidates.growth_defaults(r, "obj").select("obj", "place", "candidate_id")


@query("""WITH n AS (SELECT l_orderkey AS obj, l_linenumber AS line, 'M' || l_linenumber AS name FROM lineitem WHERE l_linenumber <= 2), o AS (SELECT l_orderkey AS obj, l_linenumber AS line, 'C' || l_linenumber AS name FROM lineitem)
SELECT obj, name, CAST(row_number() OVER (PARTITION BY obj ORDER BY late, line) AS INTEGER) AS place, late = 0 AS starts_selected FROM (SELECT *, 0 AS late FROM n UNION ALL SELECT *, 1 FROM o)""")
def prepend_candidates(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    of = lambda mark, rows: rows.selectExpr("l_orderkey AS obj", "l_linenumber AS place", f"concat('{mark}', l_linenumber) AS name")
    return candidates.prepend(of("M", li.filter("l_linenumber <= 2")), of("C", li), ["obj"]).select("obj", "name", "place", "starts_selected")


_VOTED = f"""v AS (SELECT p_partkey, p_size AS pilot, ({['accept_candidate', 'uncertain', 'reject_candidate']!r})[CAST(p_partkey % 3 AS INTEGER) + 1] AS decision, CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_partkey % 4 END AS sv, CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_partkey % 3 END AS uv, p_size % 3 <> 0 AS ran, CASE p_partkey % 7 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS shown FROM part),
g AS (SELECT *, max(sv) OVER (PARTITION BY pilot) + max(uv) OVER (PARTITION BY pilot) > 0 AS sign FROM v),
r AS (SELECT *, CASE WHEN ran AND sign THEN CASE WHEN shown = false THEN 'reject_candidate' WHEN sv >= 2 THEN decision WHEN decision = 'accept_candidate' AND (sv > 0 OR uv > 0) THEN 'uncertain' WHEN decision = 'accept_candidate' THEN 'reject_candidate' ELSE decision END WHEN ran THEN CASE WHEN decision = 'accept_candidate' THEN 'uncertain' ELSE decision END ELSE 'uncertain' END AS gated FROM g)"""


def _gated(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    v = read(spark, d, "part").select(
        "p_partkey", size.alias("pilot"), _pick(["accept_candidate", "uncertain", "reject_candidate"], k % 3).alias("decision"), F.when(size % 5 == 0, 0).otherwise(k % 4).alias("selected_votes"),
        F.when(size % 5 == 0, 0).otherwise(k % 3).alias("uncertain_votes"), (size % 3 != 0).alias("selection_ran"), F.when(k % 7 == 0, False).when(k % 7 == 1, None).otherwise(True).alias("shown"),
    )
    return rules.row_gate(v, ["pilot"], 2, rules_alone=False)


@query(f"WITH {_VOTED} SELECT p_partkey, pilot, gated AS decision FROM r")
def row_gate(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d).select("p_partkey", "pilot", "decision")


@query(f"""WITH {_VOTED}, l AS (SELECT pilot, string_agg('C' || p_partkey, ',' ORDER BY p_partkey) FILTER (gated = 'accept_candidate') AS a, string_agg('C' || p_partkey, ',' ORDER BY p_partkey) FILTER (gated = 'uncertain') AS u FROM r GROUP BY pilot)
SELECT pilot, coalesce(a, '') AS accepted, coalesce(u, '') AS uncertain, coalesce(a, u, '') AS starts FROM l""")
def manifest_defaults(spark: SparkSession, d: str) -> DataFrame:
    g = _gated(spark, d).withColumns({"place": F.col("p_partkey"), "candidate_id": F.concat(F.lit("C"), F.col("p_partkey").cast("string"))})
    m = rules.manifest_defaults(g, ["pilot"], "accept_or_uncertain")
    return m.select("pilot", F.array_join("accepted", ",").alias("accepted"), F.array_join("uncertain", ",").alias("uncertain"), F.array_join("default_selected_candidates", ",").alias("starts"))


@query("""WITH s AS (SELECT user_id, event_type AS task, event_id, value, 0 AS src FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_type, event_id, value * 2, 1 FROM events WHERE event_id % 5 = 0)
SELECT user_id, task, event_id, round(value, 6) AS value FROM s WHERE task NOT IN ('signup') QUALIFY row_number() OVER (PARTITION BY user_id, task ORDER BY src DESC, event_id DESC) = 1""")
def reload_rows(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", F.col("event_type").alias("task"), "event_id", "value").withColumn("seq", F.col("event_id"))
    got = edits.reload_rows([e.filter("event_id % 2 = 0"), e.filter("event_id % 5 = 0").withColumn("value", F.col("value") * 2)], ["user_id", "task"], "seq", None, ["signup"])
    return got.select("user_id", "task", "event_id", F.round("value", 6).alias("value"))


@query(f"""WITH {_CLOUDS}, m AS (SELECT obj, ({c.EXECUTORS!r})[CAST(point % 4 AS INTEGER) + 1] AS executor, point FROM p WHERE x > 0),
q AS (SELECT obj, count(*) AS n_points, md5(string_agg(point || ':' || CAST(round_even(x * 100000, 0) AS BIGINT), ',' ORDER BY point)) AS xs_md5 FROM p GROUP BY obj)
SELECT obj, n_points, xs_md5, {', '.join(f"(SELECT count(*) FROM m WHERE m.obj = q.obj AND executor = '{e}') AS {e}_points" for e in c.EXECUTORS)} FROM q""")
def sample_payload(spark: SparkSession, d: str) -> DataFrame:
    p = clouds(spark, d)
    m = p.filter("x > 0").select("obj", _pick(c.EXECUTORS, F.col("point") % 4).alias("executor"), "point")
    got = edits.sample_payload(p, m, "obj", "point")
    whole = F.array_join(F.transform("points", lambda q: F.concat(q["point"].cast("string"), F.lit(":"), F.bround(q["x"] * 100000, 0).cast("long").cast("string"))), ",")
    return got.select("obj", "n_points", F.md5(whole).alias("xs_md5"), *[f"{e}_points" for e in c.EXECUTORS])


@query("SELECT l_suppkey, CASE WHEN l_suppkey % 10 = 3 THEN NULL ELSE round(sum(l_quantity), 3) END AS total, CASE WHEN l_suppkey % 10 = 3 THEN 'ValueError: bad cloud' END AS error FROM lineitem GROUP BY l_suppkey")
def guarded_rows(spark: SparkSession, d: str) -> DataFrame:
    import pandas as pd

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["l_suppkey"].iloc[0] % 10 == 3:
            raise ValueError("bad cloud")
        return pd.DataFrame({"total": [round(float(pdf["l_quantity"].sum()), 3)]})

    return edits.guarded(read(spark, d, "lineitem").select("l_suppkey", "l_quantity"), "l_suppkey", work, "total double")


@query("SELECT p_partkey, replace(replace(replace(p_name || ' <' || p_type || '> & \"x\"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS shown, CAST(round_even(p_retailprice * 1000, 0) AS BIGINT) AS price FROM part")
def export_text(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("p_name", F.lit(" <"), "p_type", F.lit('> & "x"'))
    return read(spark, d, "part").select("p_partkey", F.replace(text.escape_html(raw), F.lit("&quot;"), F.lit('"')).alias("shown"), (text.compact(F.col("p_retailprice"), 3) * 1000).cast("decimal(20,0)").cast("long").alias("price"))


@query("WITH k AS (SELECT l_orderkey AS image, l_linenumber AS mask, l_extendedprice AS score FROM lineitem) SELECT image, arg_max(mask, (score, -mask)) AS mask, max(score) AS score FROM k GROUP BY image")
def best_mask(spark: SparkSession, d: str) -> DataFrame:
    k = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("mask"), F.col("l_extendedprice").alias("score"))
    return votes.best_mask(k, ["image"], "mask", "score")


@query("""WITH t AS (SELECT DISTINCT CAST(l_suppkey % 20 AS BIGINT) AS view, CAST(l_partkey % 64 AS INTEGER) AS px, CAST(l_orderkey % 64 AS INTEGER) AS py FROM lineitem), g AS (SELECT o_orderkey AS region, o_orderkey % 20 AS view, CAST(o_custkey % 40 AS DOUBLE) AS x, CAST(o_orderkey % 37 AS DOUBLE) AS y FROM orders WHERE o_orderstatus = 'F'),
e AS (SELECT region, view, x, y, unnest([1, 2, 3]) AS i FROM g), f AS (SELECT region, view, x + CASE i WHEN 1 THEN 0 WHEN 2 THEN 13 ELSE 5 END AS x1, y + CASE i WHEN 1 THEN 0 WHEN 2 THEN 3 ELSE 17 END AS y1, x + CASE i WHEN 1 THEN 13 WHEN 2 THEN 5 ELSE 0 END AS x2, y + CASE i WHEN 1 THEN 3 WHEN 2 THEN 17 ELSE 0 END AS y2 FROM e),
h AS (SELECT region, view, px, py, count(*) FILTER ((y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / (y2 - y1) + x1) AS n FROM t JOIN f USING (view) GROUP BY ALL) SELECT region, count(*) AS pixels FROM h WHERE n % 2 = 1 GROUP BY region""")
def polygon_pixels(spark: SparkSession, d: str) -> DataFrame:
    from pointloom.plans.driver import _spots

    corner = lambda a, b: f"named_struct('x', cast(o_custkey % 40 AS double) + {a}, 'y', cast(o_orderkey % 37 AS double) + {b})"
    g = read(spark, d, "orders").filter("o_orderstatus = 'F'").selectExpr("o_orderkey AS region", "o_orderkey % 20 AS view", f"array({corner(0, 0)}, {corner(13, 3)}, {corner(5, 17)}) AS corners")
    return raster.in_polygons(_spots(spark, d), g, ["view"], "region").groupBy("region").agg(F.count("*").alias("pixels"))


@query("""WITH r AS (SELECT p_partkey AS line_no, CAST(p_partkey AS VARCHAR) AS object_id, p_partkey % 13 = 0 AS bare, CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE p_brand END AS task_instruction, (['weak', 'checked', 'verified', 'odd'])[CAST(p_partkey % 4 AS INTEGER) + 1] AS quality_flag FROM part)
SELECT 'ERROR' AS level, line_no, object_id, 'missing required fields: split' AS message FROM r WHERE bare UNION ALL SELECT 'ERROR', line_no, object_id, 'empty task_instruction' FROM r WHERE NOT bare AND trim(task_instruction) = '' UNION ALL SELECT 'ERROR', line_no, object_id, 'invalid quality_flag: ' || quality_flag FROM r WHERE NOT bare AND quality_flag = 'odd'""")
def sample_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    r = read(spark, d, "part").select(k.alias("line_no"), k.cast("string").alias("object_id"), F.when(k % 13 != 0, F.lit("val")).alias("split"), F.when(k % 11 == 0, F.lit(" ")).otherwise(F.col("p_brand")).alias("task_instruction"), _pick(["weak", "checked", "verified", "odd"], k % 4).alias("quality_flag"))
    return validate.check_samples(r, ["split"], ["task_instruction"], {"quality_flag": c.QUALITY_FLAGS})


@query(f"SELECT 'val' AS split, CAST(o_orderkey AS VARCHAR) AS sample_id FROM orders WHERE o_orderpriority IN {_in(['1-URGENT', '2-HIGH'])}")
def all_val_splits(spark: SparkSession, d: str) -> DataFrame:
    return review.all_val(read(spark, d, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(F.col("o_orderkey").cast("string").alias("sample_id")))


@query("""WITH w AS (SELECT p_partkey AS pilot_id, unnest(['p' || p_partkey || '/segments.npz', 's' || p_size || '/p' || p_partkey || '.npz', 's' || p_size || '_' || p_brand || '.json']) AS path, unnest([0, 1, 2]) AS place FROM part),
e AS (SELECT 'p' || p_partkey || '/segments.npz' AS path FROM part WHERE p_partkey % 4 = 1 UNION ALL SELECT 's' || p_size || '/p' || p_partkey || '.npz' FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT DISTINCT 's' || p_size || '_' || p_brand || '.json' FROM part)
SELECT pilot_id, arg_min(path, place) AS path, min(place) AS place FROM w SEMI JOIN e USING (path) GROUP BY pilot_id""")
def prediction_paths(spark: SparkSession, d: str) -> DataFrame:
    from pointloom.sources import parts

    p = read(spark, d, "part").select(F.col("p_partkey").alias("pilot_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("sample_id"), F.col("p_brand").alias("task"))
    there = p.filter("pilot_id % 4 = 1").select(F.concat("name", F.lit("/segments.npz")).alias("path")).union(p.filter("pilot_id % 3 = 0").select(F.concat("sample_id", F.lit("/"), "name", F.lit(".npz")))).union(p.select(F.concat_ws("_", "sample_id", F.concat("task", F.lit(".json")))))
    return parts.prediction_paths(p, there, ("{name}/segments.npz", "{sample_id}/{name}.npz", "{sample_id}_{task}.json"))
