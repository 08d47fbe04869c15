"""Queries over the test tables, each through the package's operators, with equivalent SQL.

Adapters give the tables the roles of the data model: embeddings are point
clouds (label: object, vec_id: point), parts are samples (brand: category,
type: task), order lines are votes or labels (part: candidate, supplier: view),
events are reviews and edits, conversations are views of pilots.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom import constants as c
from pointloom.functions import boxes, text
from pointloom.operators import candidates, geometry, graph, joins, raster, review, rules, validate, votes, windows
from pointloom.streaming import audit

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def clouds(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return read(spark, d, "embeddings").select(F.col("label").alias("obj"), F.col("vec_id").alias("point"), *[e[i].cast("double").alias(n) for i, n in enumerate("xyz")])


_CLOUDS = "p AS (SELECT label AS obj, vec_id AS point, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
_KNN = "k AS (SELECT * FROM (SELECT a.obj, a.point AS src, b.point AS dst, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2, row_number() OVER (PARTITION BY a.obj, a.point ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z), b.point) AS rank FROM p a JOIN p b ON a.obj = b.obj AND a.point <> b.point) WHERE rank <= 8)"
_SEED = "seed AS (SELECT obj, point FROM p WHERE point % 10 = 0)"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# ---- weak labels: gate, rules, union, feasibility, counts

_RULES = ", ".join(f"('{t}', '{e}', '{a}', {low}, {high})" for t, e, a, low, high in c.WEAK_LABEL_RULES)
_AFFORDANCE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'grasp' WHEN '2-HIGH' THEN 'support' WHEN '3-MEDIUM' THEN 'pull' WHEN '4-NOT SPECIFIED' THEN 'pushable' ELSE 'press' END"


@query(f"""WITH l AS (SELECT DISTINCT l_suppkey AS obj, {_AFFORDANCE} AS affordance, l_orderkey * 10 + l_linenumber AS point FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
t AS (SELECT obj, count(DISTINCT point) AS n_points FROM l GROUP BY obj), r(task, executor, affordance, low, high) AS (VALUES {_RULES}),
g AS (SELECT obj, affordance, count(*) AS n FROM l GROUP BY ALL),
ok AS (SELECT g.obj, g.affordance, r.task, r.executor FROM g JOIN t USING (obj) JOIN r USING (affordance) WHERE n >= 8 AND n / CAST(n_points AS DOUBLE) >= low AND n / CAST(n_points AS DOUBLE) <= high),
m AS (SELECT DISTINCT l.obj, ok.task, ok.executor, l.point FROM l JOIN ok USING (obj, affordance)),
f AS (SELECT o.obj, o.task, e.executor, count(m.point) AS n FROM (SELECT DISTINCT obj, task FROM t CROSS JOIN (SELECT unnest({c.TASKS!r}) AS task)) o CROSS JOIN (SELECT unnest({c.EXECUTORS!r}) AS executor) e LEFT JOIN m ON m.obj = o.obj AND m.task = o.task AND m.executor = e.executor GROUP BY ALL)
SELECT task, executor, count(*) AS samples, CAST(sum(CASE WHEN n >= 8 THEN 1 ELSE 0 END) AS BIGINT) AS feasible, CAST(sum(n) AS BIGINT) AS points FROM f GROUP BY ALL""")
def gate_rule_feasibility(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", F.expr(_AFFORDANCE).alias("affordance"))
    li = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("obj"), F.col("l_orderkey").alias("o_orderkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point"))
    labels = li.join(o, "o_orderkey").select("obj", "affordance", "point").distinct()
    totals = labels.groupBy("obj").agg(F.countDistinct("point").alias("n_points"))
    masks = rules.weak_masks(labels, totals, rules.weak_label_rules(spark), "obj", "point")
    samples = totals.select("obj").join(F.broadcast(joins.task_dim(spark)).select("task"))
    f = rules.feasibility(masks, samples, ["obj", "task"], 8)
    return f.groupBy("task", "executor").agg(F.count("*").alias("samples"), F.count(F.when(F.col("feasible"), 1)).alias("feasible"), F.sum("n_points").alias("points"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_prop_counts(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_type", text.extract_json(F.col("props")).alias("j"))
    return e.groupBy("event_type", F.get_json_object("j", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query(r"""SELECT p_partkey, trim(regexp_replace(trim(p_name), '[^A-Za-z0-9_.-]+', '_', 'g'), '_') AS id, lower(trim(regexp_replace(replace(trim(p_type), ' ', '_'), '[^A-Za-z0-9_]+', '_', 'g'), '_')) AS key,
CASE WHEN trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') = '' THEN 'target_part' ELSE trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') END AS slug, replace(replace(lower(p_name), '-', '_'), ' ', '_') AS name FROM part""")
def id_sanitize(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    return read(spark, d, "part").select("p_partkey", text.sanitize_id(n).alias("id"), text.sanitize_key(F.col("p_type")).alias("key"), text.slug(F.col("p_brand")).alias("slug"), text.normalize_name(n).alias("name"))


def _any(words: list[str], name: str = "n") -> str:
    return "(" + " OR ".join(f"contains({name}, '{w}')" for w in words) + ")"


_GRIP = f"((task IN ('pick_up', 'lift_carry') AND ({_any(c.HANDLE_LIKE)} OR {_any(c.BODY_LIKE)})) OR (task = 'open_pull' AND ({_any(c.HANDLE_LIKE)} OR {_any(c.PULL_EDGE)})))"


@query(f"""WITH s AS (SELECT p_partkey, task, replace(replace(lower(p_name || ' ' || p_type), '-', '_'), ' ', '_') AS n FROM part CROSS JOIN (SELECT unnest({c.TASKS!r}) AS task)),
f AS (SELECT *, {_GRIP} AS g, ((task IN ('pick_up', 'lift_carry') AND {_any(c.FLAT_LIKE)}) OR (task = 'open_pull' AND {_any(c.FLAT_LIKE)} AND {_any(c.PULL_FLAT)}) OR (task = 'press_push' AND {_any(c.FLAT_LIKE)} AND NOT {_any(c.HOOKABLE)})) AS s,
(task IN ('pick_up', 'lift_carry', 'open_pull') AND {_any(c.HOOKABLE)}) AS h, (task = 'press_push' AND {_any(c.PRESS_LIKE)}) AS p FROM s)
SELECT p_partkey, task, concat_ws(',', CASE WHEN g THEN 'gripper' END, CASE WHEN s THEN 'suction' END, CASE WHEN h THEN 'hook' END, CASE WHEN g OR p THEN 'dexterous_hand' END) AS executors FROM f""")
def keyword_rules(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").join(F.broadcast(joins.task_dim(spark)))
    return p.select("p_partkey", "task", F.array_join(rules.executors_of_region(F.concat_ws(" ", "p_name", "p_type"), F.col("task")), ",").alias("executors"))


# ---- queues, sampling, keyed rows

_QUEUE = f"""s AS (SELECT p_partkey AS seq, p_brand AS category, (['pick_up', 'lift_carry', 'open_pull', 'press_push'])[p_size % 4 + 1] AS task,
(['Door', 'Mug', 'Laptop', 'Display', 'Knife'])[CAST(p_partkey % 5 AS INTEGER) + 1] AS object_category FROM part),
q AS (SELECT seq, object_category, task, e.executor, e.channel, NOT ((task = 'open_pull' AND object_category NOT IN {_in(c.TASK_CATEGORIES['open_pull'])}) OR (task = 'press_push' AND object_category NOT IN {_in(c.TASK_CATEGORIES['press_push'])})) AS sensible,
(seq + e.channel) % 3 <> 0 AS able FROM s CROSS JOIN (SELECT unnest({c.EXECUTORS!r}) AS executor, unnest([0, 1, 2, 3]) AS channel) e)"""


def _samples(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), i.cast("int") + 1)
    able = F.map_from_arrays(F.array(*[F.lit(e) for e in c.EXECUTORS]), F.array(*[(F.col("p_partkey") + i) % 3 != 0 for i in range(4)]))
    return read(spark, d, "part").select(
        F.col("p_partkey").alias("seq"), F.col("p_partkey").cast("string").alias("sample_id"), pick(["Door", "Mug", "Laptop", "Display", "Knife"], F.col("p_partkey") % 5).alias("object_category"),
        pick(c.TASKS, F.col("p_size") % 4).alias("task"), able.alias("feasibility"),
    )


@query(f"""WITH {_QUEUE} SELECT seq, object_category, task, executor, sensible AS object_task_feasible, sensible AND able AS executor_feasible,
CASE WHEN sensible AND able THEN 'refine' ELSE 'not_applicable' END AS decision, CASE WHEN sensible AND able THEN 'review' ELSE 'empty' END AS review_mode,
CASE WHEN sensible AND able THEN '' ELSE 'no_' || executor || '_feasible_region' END AS negative_reason, CASE WHEN sensible THEN '' ELSE 'common_sense_object_task_mismatch:' || object_category || ':' || task END AS skip_reason FROM q""")
def executor_cross_queue(spark: SparkSession, d: str) -> DataFrame:
    return review.build_queue(_samples(spark, d)).select("seq", "object_category", "task", "executor", "object_task_feasible", "executor_feasible", "decision", "review_mode", "negative_reason", "skip_reason")


@query("""WITH r AS (SELECT p_partkey, p_brand, p_type, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS rn, min(p_partkey) OVER (PARTITION BY p_brand, p_type) AS fs FROM part)
SELECT * FROM (SELECT p_partkey, p_brand, p_type, 'pilot_' || lpad(CAST(row_number() OVER (ORDER BY rn, fs) AS VARCHAR), 6, '0') AS pilot_id FROM r ORDER BY rn, fs LIMIT 120)""")
def round_robin_sample(spark: SparkSession, d: str) -> DataFrame:
    s = windows.round_robin(read(spark, d, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"], "p_partkey", 120)
    return windows.running_id(s, "pick", "pilot_", "pilot_id").drop("pick")


@query("SELECT p_partkey, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 5 ORDER BY p_partkey LIMIT 100")
def cap_per_group(spark: SparkSession, d: str) -> DataFrame:
    return windows.cap_per_group(read(spark, d, "part").select("p_partkey", "p_brand"), ["p_brand"], "p_partkey", 5, 100)


@query("SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, round(arg_max(value, event_id), 6) AS value, min(event_id) AS first_seq, count(*) AS edits FROM events GROUP BY ALL")
def last_wins_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "event_type", "event_id", "value").withColumn("seq", F.col("event_id"))
    last = windows.last_wins(e, ["user_id", "event_type"], "seq")
    n = e.groupBy("user_id", "event_type").agg(F.count("*").alias("edits"))
    return last.join(n, ["user_id", "event_type"]).select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"), "first_seq", "edits")


@query("""WITH r AS (SELECT p_size % 4 AS pilot, p_brand AS grp, p_partkey, p_size AS priority, CAST(p_retailprice AS BIGINT) AS cnt, row_number() OVER (PARTITION BY p_size % 4, p_brand ORDER BY p_size, CAST(p_retailprice AS BIGINT) DESC, p_partkey) AS rn,
min(p_size) OVER (PARTITION BY p_size % 4, p_brand) AS gp, min(p_partkey) OVER (PARTITION BY p_size % 4, p_brand) AS gs FROM part),
o AS (SELECT *, row_number() OVER (PARTITION BY pilot ORDER BY CASE WHEN rn <= 2 THEN 0 ELSE 1 END, CASE WHEN rn <= 2 THEN rn END NULLS FIRST, CASE WHEN rn <= 2 THEN gp END NULLS FIRST, CASE WHEN rn <= 2 THEN gs END NULLS FIRST, priority, cnt DESC, p_partkey) AS place FROM r)
SELECT pilot, grp, p_partkey, CAST(place AS INTEGER) AS place, CAST(row_number() OVER (PARTITION BY pilot, grp ORDER BY place) AS INTEGER) AS rank_in_group FROM o WHERE place <= 60""")
def topk_group_then_fill(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select((F.col("p_size") % 4).alias("pilot"), F.col("p_brand").alias("grp"), "p_partkey", F.col("p_size").alias("priority"), F.bround("p_retailprice", 0).cast("long").alias("cnt"))
    return windows.topk_then_fill(p, "pilot", "grp", "priority", "cnt", "p_partkey", 2, 60).select("pilot", "grp", "p_partkey", "place", "rank_in_group")


_LINE_VOTES = "SELECT l_suppkey, l_partkey, count(*) FILTER (l_returnflag = 'A') AS selected, count(*) FILTER (l_returnflag = 'R') AS uncertain, coalesce(sum(l_discount) FILTER (l_returnflag = 'A'), 0) / greatest(1, count(*) FILTER (l_returnflag = 'A')) AS mean_confidence FROM lineitem GROUP BY ALL"


def _selections(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "selected").when(F.col("l_returnflag") == "R", "uncertain").otherwise("shown")
    return read(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("candidate_id"), kind.alias("kind"), F.col("l_discount").alias("confidence"))


@query(f"""WITH v AS ({_LINE_VOTES}), b AS (SELECT *, CASE WHEN l_partkey % 50 = 0 THEN 0 WHEN l_partkey % 7 = 0 THEN 1 WHEN selected > 0 THEN 2 WHEN uncertain > 0 THEN 3 ELSE 4 END AS bucket FROM v)
SELECT l_suppkey, l_partkey AS candidate_id, bucket, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY bucket, selected DESC, l_partkey) AS INTEGER) AS place FROM b""")
def rank_bucket(spark: SparkSession, d: str) -> DataFrame:
    v = votes.candidate_votes(_selections(spark, d), ["l_suppkey"])
    k = F.col("candidate_id")
    v = v.withColumn("bucket", windows.rank_bucket(k % 50 == 0, k % 7 == 0, F.col("selected"), F.col("uncertain")))
    return windows.ranked(v, ["l_suppkey"], [F.col("bucket"), F.col("selected").desc(), k]).select("l_suppkey", "candidate_id", "bucket", "place")


_REASON = """CASE WHEN task NOT IN ('click', 'view', 'purchase', 'signup') THEN 'task_not_included:' || task WHEN task IN ('signup') THEN 'task_excluded:' || task
WHEN status NOT IN ('s0', 's1', 's2', 'reject') THEN 'status_filtered:' || status WHEN quality NOT IN ('weak', 'checked') THEN 'quality_filtered:' || CASE WHEN quality = '' THEN '<empty>' ELSE quality END WHEN status = 'reject' THEN 'review_rejected' END"""
_REVIEWS = "(SELECT event_id, user_id, event_type AS task, CASE WHEN event_id % 7 = 0 THEN 'reject' ELSE 's' || (event_id % 5) END AS status, (['weak', 'checked', 'verified', ''])[CAST(event_id % 4 AS INTEGER) + 1] AS quality FROM events)"


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    status = F.when(i % 7 == 0, F.lit("reject")).otherwise(F.concat(F.lit("s"), (i % 5).cast("string")))
    quality = F.element_at(F.array(*[F.lit(v) for v in ("weak", "checked", "verified", "")]), (i % 4).cast("int") + 1)
    return read(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("task"), status.alias("point_review_status"), quality.alias("quality_flag"))


def _why() -> object:
    return review.release_reason(["click", "view", "purchase", "signup"], ["signup"], ["s0", "s1", "s2", "reject"], ["weak", "checked"])


@query(f"SELECT event_id, {_REASON} AS reason FROM {_REVIEWS}")
def first_reason_filter(spark: SparkSession, d: str) -> DataFrame:
    return _reviews(spark, d).select("event_id", _why().alias("reason"))


@query(f"SELECT reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM {_REVIEWS}) WHERE reason IS NOT NULL GROUP BY ALL")
def skip_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return _reviews(spark, d).withColumn("reason", _why()).filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH l AS (SELECT r.* FROM {_REVIEWS} r QUALIFY row_number() OVER (PARTITION BY user_id, task ORDER BY event_id DESC) = 1)
SELECT user_id, task, event_id, status AS point_review_status, quality AS quality_flag, 'val' AS split FROM l WHERE ({_REASON}) IS NULL""")
def release_rows(spark: SparkSession, d: str) -> DataFrame:
    r = _reviews(spark, d).withColumn("seq", F.col("event_id"))
    kept, _ = review.release(r, ["user_id", "task"], "seq", _why(), "val")
    return kept.select("user_id", "task", "event_id", "point_review_status", "quality_flag", "split")


@query("""SELECT c_custkey, coalesce(CASE WHEN s_name IS NOT NULL AND trim(s_name) <> '' THEN s_name END, c_name) AS name, c_mktsegment FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def left_join_overlay(spark: SparkSession, d: str) -> DataFrame:
    base = read(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), "c_mktsegment")
    over = read(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("name"))
    return joins.overlay(base, over, ["c_custkey"], ["name"])


@query("SELECT count(*) AS pairs, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey")
def strict_inner_join(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    j = joins.strict_join(o, read(spark, d, "customer").select("c_custkey"), ["c_custkey"])
    return j.agg(F.count("*").alias("pairs"), F.countDistinct("c_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT doc_id, 'missing' AS side FROM (SELECT DISTINCT doc_id FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 3 <> 0) UNION ALL
SELECT doc_id, 'extra' FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id % 3 <> 0) WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def split_anti_both_ways(spark: SparkSession, d: str) -> DataFrame:
    return joins.both_ways(read(spark, d, "documents"), read(spark, d, "labels").filter("doc_id % 3 <> 0"), "doc_id")


@query("SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS first_line FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_first_seen(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select(F.md5("text").alias("text_md5"), F.col("doc_id").alias("line_no"))
    return validate.duplicate_ids(t, "text_md5")


@query("""WITH r AS (SELECT p_partkey AS line_no, CAST(p_partkey AS VARCHAR) AS object_id, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS nm, (['weak', 'checked', 'verified', 'odd'])[CAST(p_partkey % 4 AS INTEGER) + 1] AS quality_flag FROM part)
SELECT 'ERROR' AS level, line_no, object_id, 'empty name' AS message FROM r WHERE nm = '' UNION ALL SELECT 'ERROR', line_no, object_id, 'invalid quality_flag: ' || quality_flag FROM r WHERE quality_flag NOT IN ('weak', 'checked', 'verified')""")
def validation_issues(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    r = read(spark, d, "part").select(
        k.alias("line_no"), k.cast("string").alias("object_id"), F.when(k % 11 == 0, F.lit("")).otherwise(F.col("p_name")).alias("name"),
        F.element_at(F.array(*[F.lit(v) for v in ("weak", "checked", "verified", "odd")]), (k % 4).cast("int") + 1).alias("quality_flag"),
    )
    return validate.union([validate.blank_issues(r, ["name"]), validate.enum_issues(r, {"quality_flag": c.QUALITY_FLAGS})])


# ---- votes and rules

_VIEW = "SELECT DISTINCT l_suppkey % 10 AS obj, l_linenumber AS view, CAST(l_orderkey % 64 AS INTEGER) AS px, CAST(l_partkey % 64 AS INTEGER) AS py"


@query(f"""WITH p AS ({_VIEW}, l_partkey % 500 AS point FROM lineitem), m AS ({_VIEW}, CASE l_linestatus WHEN 'O' THEN 'hook' ELSE 'gripper' END AS executor, CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.25 END AS value FROM lineitem WHERE l_linenumber <> 4),
s AS (SELECT obj, point, count(*) AS visible FROM p WHERE (obj, view) IN (SELECT (obj, view) FROM m) GROUP BY ALL), h AS (SELECT obj, point, executor, count(*) AS votes FROM p JOIN m USING (obj, view, px, py) WHERE value >= 0.5 GROUP BY ALL)
SELECT obj, point, executor, votes, visible, round(votes / CAST(visible AS DOUBLE), 9) AS score FROM h JOIN s USING (obj, point) WHERE votes / CAST(visible AS DOUBLE) >= 0.3 AND visible >= 2""")
def vote_scores(spark: SparkSession, d: str) -> DataFrame:
    view = ["l_suppkey % 10 AS obj", "l_linenumber AS view", "cast(l_orderkey % 64 AS int) AS px", "cast(l_partkey % 64 AS int) AS py"]
    li = read(spark, d, "lineitem")
    p = li.selectExpr(*view, "l_partkey % 500 AS point").distinct()
    m = li.filter("l_linenumber <> 4").selectExpr(*view, "CASE l_linestatus WHEN 'O' THEN 'hook' ELSE 'gripper' END AS executor", "CASE WHEN l_discount >= 0.05 THEN 1D ELSE 0.25D END AS value").distinct()
    return votes.fuse(votes.mask_votes(p, m, ["obj"], ["view"], "point"), 0.3, 2).withColumn("score", F.round("score", 9))


@query(f"""WITH v AS ({_LINE_VOTES}) SELECT l_suppkey, l_partkey AS candidate_id, selected, uncertain, round(mean_confidence, 9) AS mean_confidence,
CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY selected DESC, round(mean_confidence, 9) DESC, uncertain DESC, l_partkey) AS INTEGER) AS place FROM v""")
def candidate_vote_rank(spark: SparkSession, d: str) -> DataFrame:
    v = votes.candidate_votes(_selections(spark, d), ["l_suppkey"]).withColumn("mean_confidence", F.round("mean_confidence", 9))
    return windows.ranked(v, ["l_suppkey"], votes.vote_order())


@query("""WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS item, unnest(range(len(string_split(text, ' ')))) AS pos FROM conversations),
g AS (SELECT conv_id, item, count(*) AS votes, min(turn * 1000000 + pos) AS fs FROM w WHERE item <> '' GROUP BY ALL)
SELECT conv_id, item, votes, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY votes DESC, fs) AS place FROM g) WHERE place <= 5""")
def plan_most_common(spark: SparkSession, d: str) -> DataFrame:
    w = read(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "item")).filter("item <> ''")
    w = w.withColumn("seq", F.col("turn") * 1000000 + F.col("pos"))
    return votes.most_common(w, ["conv_id"], "item", "seq", 5).select("conv_id", "item", "votes", "place")


_FAMILY = f"({[*c.HOOK_FAMILIES[:6], *c.SMOOTH_FAMILIES]!r})[CAST(p_partkey % 12 AS INTEGER) + 1]"
_CAND = f"""k AS (SELECT p_partkey, e.executor, e.channel, (['pick_up', 'lift_carry', 'open_pull', 'press_push'])[p_size % 4 + 1] AS task, {_FAMILY} AS family, p_partkey % 4 AS sv, p_partkey % 3 AS uv, p_size / 50.0 AS frac, p_size / 60.0 AS ext, (p_partkey % 5) * 0.01e0 AS thin
FROM part CROSS JOIN (SELECT unnest({c.EXECUTORS!r}) AS executor, unnest([0, 1, 2, 3]) AS channel) e)"""
_H, _S = f"family IN {_in(c.HOOK_FAMILIES)}", f"family IN {_in(c.SMOOTH_FAMILIES)}"
_SCORE = f"""(0.0 + CASE WHEN (p_partkey + channel) % 2 = 0 THEN 0.25 ELSE 0.0 END + CASE WHEN sv >= 2 THEN 0.40 ELSE 0.0 END + CASE WHEN sv < 2 AND uv > 0 THEN 0.10 ELSE 0.0 END) +
(0.0 + CASE WHEN executor = 'suction' AND family IN ('smooth_surface', 'smooth_extreme_patch', 'existing_weak_mask') THEN 0.55 ELSE 0.0 END + CASE WHEN executor = 'suction' AND {_H} THEN -0.45 ELSE 0.0 END
+ CASE WHEN executor = 'hook' AND {_H} THEN 0.50 ELSE 0.0 END + CASE WHEN executor = 'hook' AND {_S} THEN -0.35 ELSE 0.0 END + CASE WHEN executor = 'gripper' AND {_H} THEN 0.45 ELSE 0.0 END
+ CASE WHEN executor = 'gripper' AND family IN ('smooth_surface', 'central_body') THEN -0.20 ELSE 0.0 END + CASE WHEN executor = 'dexterous_hand' AND ({_H} OR family IN ('central_body', 'existing_weak_mask')) THEN 0.38 ELSE 0.0 END
+ CASE WHEN executor = 'dexterous_hand' AND family IN ('smooth_surface', 'smooth_extreme_patch') AND task <> 'press_push' THEN -0.20 ELSE 0.0 END
+ CASE WHEN task = 'press_push' AND executor = 'dexterous_hand' AND family IN {_in(c.PRESS_FAMILIES)} THEN 0.18 ELSE 0.0 END + CASE WHEN task IN ('open_pull', 'lift_carry') AND executor = 'hook' AND {_H} THEN 0.12 ELSE 0.0 END) +
(0.0 + CASE WHEN frac > 0.45 AND executor IN ('hook', 'gripper') THEN -0.35 ELSE 0.0 END + CASE WHEN frac > 0.45 AND executor = 'suction' THEN -0.10 ELSE 0.0 END + CASE WHEN executor = 'hook' AND ext > 0.65 AND frac > 0.18 THEN -0.25 ELSE 0.0 END
+ CASE WHEN executor = 'suction' AND (least(ext, thin) < 0.02 OR frac < 0.02) THEN -0.30 ELSE 0.0 END)"""
# doubles, as the operator adds them: sums of decimals would be exact
_SCORE = re.sub(r"(\d\.\d+)", r"\1e0", _SCORE)
_DECIDED = f"s AS (SELECT *, {_SCORE} AS total FROM k), r AS (SELECT *, round(total, 4) AS rule_score, CASE WHEN total >= 0.55e0 THEN 'accept_candidate' WHEN total >= 0.25e0 THEN 'uncertain' ELSE 'reject_candidate' END AS decision FROM s)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), i.cast("int") + 1)
    p = read(spark, d, "part").join(F.broadcast(joins.executor_dim(spark)))
    d2 = p.select(
        "p_partkey", "executor", pick(c.TASKS, F.col("p_size") % 4).alias("task"), pick([*c.HOOK_FAMILIES[:6], *c.SMOOTH_FAMILIES], k % 12).alias("candidate_family"),
        F.when((k + F.col("channel")) % 2 == 0, F.array("executor")).otherwise(F.array().cast("array<string>")).alias("recommended_executors"), (k % 4).alias("selected_votes"), (k % 3).alias("uncertain_votes"),
        (F.col("p_size") / 50.0).alias("point_fraction"), F.array((k % 5) * F.lit(0.01), F.col("p_size") / 60.0).alias("bbox_extent_ratio"), F.lit("").alias("source"), F.lit("").alias("provenance"),
    )
    return rules.score_candidates(d2, 2)


@query(f"WITH {_CAND}, {_DECIDED} SELECT p_partkey, executor, CAST(rule_score AS DOUBLE) AS rule_score, decision FROM r")
def rule_score_decision(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("p_partkey", "executor", "rule_score", "decision")


@query(f"""WITH {_CAND}, {_DECIDED}, g AS (SELECT p_partkey, executor, CASE WHEN p_partkey % 5 = 0 THEN 'reject_candidate' WHEN sv >= 2 THEN decision WHEN decision = 'accept_candidate' AND (sv > 0 OR uv > 0) THEN 'uncertain' WHEN decision = 'accept_candidate' THEN 'reject_candidate' ELSE decision END AS gated, decision FROM r)
SELECT decision, gated, count(*) AS n FROM g GROUP BY ALL""")
def acceptance_gate(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    gated = rules.acceptance_gate(F.col("decision"), F.lit(True), F.col("p_partkey") % 5 != 0, F.col("selected_votes"), F.col("uncertain_votes"), 2)
    return s.select("decision", gated.alias("gated")).groupBy("decision", "gated").agg(F.count("*").alias("n"))


_MASKS = "m AS (SELECT DISTINCT l_suppkey AS sample_id, (['gripper', 'suction', 'hook', 'dexterous_hand'])[l_linenumber % 4 + 1] AS executor, l_partkey AS point FROM lineitem)"


def _masks(spark: SparkSession, d: str) -> DataFrame:
    e = F.element_at(F.array(*[F.lit(v) for v in c.EXECUTORS]), F.col("l_linenumber") % 4 + 1)
    return read(spark, d, "lineitem").select(F.col("l_suppkey").alias("sample_id"), e.alias("executor"), F.col("l_partkey").alias("point")).distinct()


@query(f"""WITH {_MASKS}, n AS (SELECT DISTINCT sample_id, 'hook' AS executor, point FROM m WHERE executor = 'suction' AND point % 3 = 0 AND sample_id % 2 = 0),
o AS (SELECT * FROM m WHERE NOT (executor = 'hook' AND sample_id IN (SELECT sample_id FROM n)) UNION SELECT * FROM n) SELECT sample_id, executor, count(*) AS n_points FROM o GROUP BY ALL""")
def channel_overwrite(spark: SparkSession, d: str) -> DataFrame:
    m = _masks(spark, d)
    new = m.filter("executor = 'suction' AND point % 3 = 0 AND sample_id % 2 = 0").withColumn("executor", F.lit("hook"))
    return rules.overwrite_channel(m, new, ["sample_id"], "point").groupBy("sample_id", "executor").agg(F.count("*").alias("n_points"))


@query(f"""WITH {_MASKS}, o AS (SELECT DISTINCT l_suppkey AS sample_id, (['gripper', 'suction', 'hook', 'dexterous_hand'])[l_linenumber % 4 + 1] AS executor, (['set', 'add', 'remove'])[CAST(l_suppkey % 3 AS INTEGER) + 1] AS op, l_partkey + 1 AS point FROM lineitem WHERE l_quantity > 40),
x AS (SELECT * FROM m WHERE (sample_id, executor) NOT IN (SELECT (sample_id, executor) FROM o WHERE op = 'set') UNION SELECT sample_id, executor, point FROM o WHERE op IN ('set', 'add'))
SELECT sample_id, executor, count(*) AS n_points FROM x WHERE (sample_id, executor, point) NOT IN (SELECT (sample_id, executor, point) FROM o WHERE op = 'remove') GROUP BY ALL""")
def manual_overrides(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), i.cast("int") + 1)
    o = read(spark, d, "lineitem").filter("l_quantity > 40").select(F.col("l_suppkey").alias("sample_id"), pick(c.EXECUTORS, F.col("l_linenumber") % 4).alias("executor"), pick(["set", "add", "remove"], F.col("l_suppkey") % 3).alias("op"), (F.col("l_partkey") + 1).alias("point")).distinct()
    return rules.apply_overrides(_masks(spark, d), o, ["sample_id"], "point").groupBy("sample_id", "executor").agg(F.count("*").alias("n_points"))


@query(f"""WITH {_MASKS}, a AS (SELECT sample_id, point FROM m WHERE executor = 'gripper'), b AS (SELECT sample_id, point FROM m WHERE executor = 'hook'),
k AS (SELECT sample_id FROM a UNION SELECT sample_id FROM b) SELECT sample_id, (SELECT count(*) FROM b WHERE b.sample_id = k.sample_id AND point NOT IN (SELECT point FROM a WHERE a.sample_id = k.sample_id)) AS n_added,
(SELECT count(*) FROM a WHERE a.sample_id = k.sample_id AND point NOT IN (SELECT point FROM b WHERE b.sample_id = k.sample_id)) AS n_removed FROM k""")
def edit_diff(spark: SparkSession, d: str) -> DataFrame:
    m = _masks(spark, d)
    diff = review.edit_diff(m.filter("executor = 'gripper'"), m.filter("executor = 'hook'"), ["sample_id"], "point")
    return diff.select("sample_id", F.size("added").cast("long").alias("n_added"), F.size("removed").cast("long").alias("n_removed"))


# ---- geometry

_ROUND = ", ".join(f"round({k}, 9) AS {k}" for k in "xyz")


def _rounded(df: DataFrame, columns: list[str], places: int = 9) -> DataFrame:
    return df.withColumns({k: F.round(k, places) for k in columns})


@query(f"WITH {_CLOUDS}, q AS (SELECT obj, point, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, z - avg(z) OVER w AS z FROM p WINDOW w AS (PARTITION BY obj)), r AS (SELECT *, max(sqrt(x*x+y*y+z*z)) OVER (PARTITION BY obj) AS s FROM q) SELECT obj, point, round(x/s, 9) AS x, round(y/s, 9) AS y, round(z/s, 9) AS z FROM r")
def unit_sphere(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(geometry.normalize(geometry.finite_rows(clouds(spark, d)), "obj", "unit_sphere"), list("xyz"))


_MID = "q AS (SELECT obj, point, x - (min(x) OVER w + max(x) OVER w) / 2 AS x, y - (min(y) OVER w + max(y) OVER w) / 2 AS y, z - (min(z) OVER w + max(z) OVER w) / 2 AS z, greatest(max(x) OVER w - min(x) OVER w, max(y) OVER w - min(y) OVER w, max(z) OVER w - min(z) OVER w) AS side FROM p WINDOW w AS (PARTITION BY obj))"


@query(f"WITH {_CLOUDS}, {_MID} SELECT obj, point, round(x/side, 9) AS x, round(y/side, 9) AS y, round(z/side, 9) AS z FROM q")
def unit_bbox(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(geometry.normalize(clouds(spark, d), "obj", "unit_bbox"), list("xyz"))


@query(f"WITH {_CLOUDS}, {_MID}, r AS (SELECT *, max(sqrt(x*x+y*y+z*z)) OVER (PARTITION BY obj) AS s FROM q) SELECT obj, point, round(x/s, 9) AS x, round(y/s, 9) AS y, round(z/s, 9) AS z FROM r")
def midbox_norm(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(geometry.normalize(clouds(spark, d), "obj", "mid_sphere"), list("xyz"))


@query(f"WITH {_CLOUDS}, b AS (SELECT obj, quantile_cont(x, 0.18) AS lo, quantile_cont(x, 0.82) AS hi FROM p GROUP BY obj) SELECT obj, point, CASE WHEN x <= lo THEN 'low' ELSE 'high' END AS side FROM p JOIN b USING (obj) WHERE x <= lo OR x >= hi")
def quantile_masks(spark: SparkSession, d: str) -> DataFrame:
    p = clouds(spark, d)
    d2 = p.join(geometry.quantile_bounds(p, ["obj"], "x", {"lo": 0.18, "hi": 0.82}), "obj").filter("x <= lo OR x >= hi")
    return d2.select("obj", "point", F.when(F.expr("x <= lo"), "low").otherwise("high").alias("side"))


@query(f"WITH {_CLOUDS}, w AS (SELECT obj, max(x)-min(x) AS wx, max(y)-min(y) AS wy, max(z)-min(z) AS wz FROM p GROUP BY obj), i AS (SELECT obj, point % 5 AS item, max(x)-min(x) AS px, max(y)-min(y) AS py, max(z)-min(z) AS pz FROM p GROUP BY ALL) SELECT obj, item, round(px/(wx+1e-8), 9) AS extent_x, round(py/(wy+1e-8), 9) AS extent_y, round(pz/(wz+1e-8), 9) AS extent_z FROM i JOIN w USING (obj)")
def bbox_extent(spark: SparkSession, d: str) -> DataFrame:
    p = clouds(spark, d).withColumn("item", F.col("point") % 5)
    return _rounded(geometry.extent_ratio(p, p, "obj", "item"), ["extent_x", "extent_y", "extent_z"])


@query(f"WITH {_CLOUDS}, {_KNN} SELECT obj, src, CAST(rank AS INTEGER) AS rank, dst, round(d2, 9) AS d2 FROM k")
def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(geometry.knn(clouds(spark, d), "obj", "point", 8), ["d2"])


_COV = "v AS (SELECT k.obj, src, " + ", ".join(f"covar_samp(p.{a}, p.{b}) AS c{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) + " FROM k JOIN p ON k.obj = p.obj AND k.dst = p.point GROUP BY k.obj, src)"
_EIG = """e1 AS (SELECT *, (cxx+cyy+czz)/3 AS q FROM v), e2 AS (SELECT *, sqrt(((cxx-q)*(cxx-q)+(cyy-q)*(cyy-q)+(czz-q)*(czz-q)+2*(cxy*cxy+cxz*cxz+cyz*cyz))/6) AS p FROM e1),
e3 AS (SELECT *, acos(least(1.0, greatest(-1.0, ((cxx-q)*((cyy-q)*(czz-q)-cyz*cyz)-cxy*(cxy*(czz-q)-cyz*cxz)+cxz*(cxy*cyz-(cyy-q)*cxz))/(2*p*p*p))))/3 AS phi FROM e2),
e4 AS (SELECT *, q+2*p*cos(phi) AS l2, q+2*p*cos(phi+2*pi()/3) AS l0 FROM e3), e5 AS (SELECT *, 3*q-l0-l2 AS l1 FROM e4)"""


@query(f"WITH {_CLOUDS}, {_KNN}, {_COV}, {_EIG} SELECT obj, src, round(l0/(l0+l1+l2+1e-8), 6) AS curvature, round((l2-l1)/(l2+1e-8), 6) AS linearity, round((l1-l0)/(l2+1e-8), 6) AS planarity FROM e5")
def local_pca(spark: SparkSession, d: str) -> DataFrame:
    p = clouds(spark, d)
    f = geometry.local_pca(p, geometry.knn(p, "obj", "point", 8), "obj", "point")
    return _rounded(f.select("obj", "src", "curvature", "linearity", "planarity"), ["curvature", "linearity", "planarity"], 6)


@query(f"WITH {_CLOUDS}, {_KNN}, {_SEED}, h1 AS (SELECT * FROM seed UNION SELECT k.obj, k.dst FROM seed JOIN k ON seed.obj = k.obj AND seed.point = k.src), h2 AS (SELECT * FROM h1 UNION SELECT k.obj, k.dst FROM h1 JOIN k ON h1.obj = k.obj AND h1.point = k.src) SELECT obj, point FROM h2")
def knn_expand_hops(spark: SparkSession, d: str) -> DataFrame:
    p = clouds(spark, d)
    return graph.expand(p.filter("point % 10 = 0").select("obj", "point"), geometry.knn(p, "obj", "point", 8), "obj", "point", 2)


@query(f"WITH {_CLOUDS}, {_KNN}, {_SEED}, ok AS (SELECT obj, point FROM p WHERE point % 7 <> 0), s AS (SELECT * FROM seed SEMI JOIN ok USING (obj, point)), g AS (SELECT k.obj, k.src, k.dst FROM k JOIN ok ON k.obj = ok.obj AND k.dst = ok.point), h1 AS (SELECT * FROM s UNION SELECT g.obj, g.dst FROM s JOIN g ON s.obj = g.obj AND s.point = g.src), h2 AS (SELECT * FROM h1 UNION SELECT g.obj, g.dst FROM h1 JOIN g ON h1.obj = g.obj AND h1.point = g.src) SELECT obj, point FROM h2")
def veto_expand(spark: SparkSession, d: str) -> DataFrame:
    p = clouds(spark, d)
    return graph.expand(p.filter("point % 10 = 0").select("obj", "point"), geometry.knn(p, "obj", "point", 8), "obj", "point", 2, p.filter("point % 7 <> 0"))


@query()
def directed_components(spark: SparkSession, d: str) -> DataFrame:
    p = clouds(spark, d)
    return graph.scan_components(p.filter("x > 0").select("obj", "point"), geometry.knn(p, "obj", "point", 4), "obj", "point", 2)


_SETS = "s AS (SELECT DISTINCT l_suppkey AS obj, l_linenumber AS item, l_partkey % 40 AS point FROM lineitem)"


def _sets(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_suppkey").alias("obj"), F.col("l_linenumber").alias("item"), (F.col("l_partkey") % 40).alias("point")).distinct()


@query(f"WITH {_SETS}, n AS (SELECT obj, item, count(*) AS n FROM s GROUP BY ALL), i AS (SELECT a.obj, a.item AS a, b.item AS b, count(*) AS shared FROM s a JOIN s b ON a.obj = b.obj AND a.point = b.point AND a.item < b.item GROUP BY ALL) SELECT i.obj, a, b, shared, na.n + nb.n - shared AS united, round(shared / CAST(na.n + nb.n - shared AS DOUBLE), 9) AS iou FROM i JOIN n na ON na.obj = i.obj AND na.item = a JOIN n nb ON nb.obj = i.obj AND nb.item = b")
def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(joins.overlaps(_sets(spark, d), "obj", "item", "point"), ["iou"])


@query(f"""WITH RECURSIVE {_SETS}, g AS (SELECT obj, item, list(point) AS pts FROM s GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY obj ORDER BY item) AS n FROM g),
f AS (SELECT obj, n, [n] AS kept FROM o WHERE n = 1 UNION ALL SELECT f.obj, o.n, CASE WHEN EXISTS (SELECT 1 FROM o k WHERE k.obj = f.obj AND list_contains(f.kept, k.n) AND len(list_intersect(k.pts, o.pts)) / CAST(len(k.pts) + len(o.pts) - len(list_intersect(k.pts, o.pts)) AS DOUBLE) >= 0.5) THEN f.kept ELSE list_append(f.kept, o.n) END FROM f JOIN o ON o.obj = f.obj AND o.n = f.n + 1),
l AS (SELECT obj, arg_max(kept, n) AS kept FROM f GROUP BY obj) SELECT o.obj, o.item, CAST(len(pts) AS BIGINT) AS n_points FROM o JOIN l ON o.obj = l.obj AND list_contains(l.kept, o.n)""")
def greedy_iou_dedupe(spark: SparkSession, d: str) -> DataFrame:
    g = _sets(spark, d).groupBy("obj", "item").agg(F.collect_list("point").alias("points"))
    return windows.greedy_dedupe(g, ["obj"], "item", "points", 0.5).select("obj", "item", F.size("points").cast("long").alias("n_points"))


# ---- raster

_PIX = f"""v AS (SELECT obj, point, x AS u, y AS v, z AS depth FROM p), b AS (SELECT obj, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1 FROM v GROUP BY obj),
pix AS (SELECT obj, point, depth, CAST(round_even((0.08 + 0.84 * (u - u0) / (u1 - u0)) * CAST(63 AS DOUBLE), 0) AS INTEGER) AS px, CAST(round_even((1 - (0.08 + 0.84 * (v - v0) / (v1 - v0))) * CAST(63 AS DOUBLE), 0) AS INTEGER) AS py FROM v JOIN b USING (obj))"""


_VIEWS = ["front", "yaw045_elev20", "top"]
_TURNS = ", ".join("(" + ", ".join([f"'{n}'", *(f"{x!r}::DOUBLE" for x in raster.view_matrix(n))]) + ")" for n in _VIEWS)


@query(f"""WITH {_CLOUDS}, t(view, r0, r1, r2, r3, r4, r5, r6, r7, r8) AS (VALUES {_TURNS}), v AS (SELECT obj, point, view, x*r0+y*r1+z*r2 AS u, x*r3+y*r4+z*r5 AS v, x*r6+y*r7+z*r8 AS depth FROM p, t),
b AS (SELECT obj, view, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1 FROM v GROUP BY ALL), o AS (SELECT * FROM (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) AS o(dx, dy)),
pix AS (SELECT obj, view, point, depth, dx + CAST(round_even((CAST(0.08 AS DOUBLE) + CAST(0.84 AS DOUBLE) * (u - u0) / (u1 - u0)) * CAST(63 AS DOUBLE), 0) AS INTEGER) AS px, dy + CAST(round_even((1 - (CAST(0.08 AS DOUBLE) + CAST(0.84 AS DOUBLE) * (v - v0) / (v1 - v0))) * CAST(63 AS DOUBLE), 0) AS INTEGER) AS py FROM v JOIN b USING (obj, view), o)
SELECT obj, view, py, px, point, round(depth, 9) AS depth FROM pix WHERE px BETWEEN 0 AND 63 AND py BETWEEN 0 AND 63 QUALIFY row_number() OVER (PARTITION BY obj, view, py, px ORDER BY depth DESC, point) = 1""")
def zbuffer_project(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(raster.project(clouds(spark, d), raster.views(spark, _VIEWS), "obj", "point", 64, 1), ["depth"])


_SPOTS = "t AS (SELECT DISTINCT CAST(l_suppkey % 20 AS BIGINT) AS view, CAST(l_partkey % 64 AS INTEGER) AS px, CAST(l_orderkey % 64 AS INTEGER) AS py FROM lineitem)"
_DISC = "o AS (SELECT dx, dy FROM (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy) WHERE dx*dx+dy*dy <= 4)"


def _spots(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("view"), (F.col("l_partkey") % 64).cast("int").alias("px"), (F.col("l_orderkey") % 64).cast("int").alias("py")).distinct()


@query(f"WITH {_SPOTS}, {_DISC} SELECT DISTINCT view, CAST(px + dx AS INTEGER) AS px, CAST(py + dy AS INTEGER) AS py FROM t, o WHERE px + dx BETWEEN 0 AND 63 AND py + dy BETWEEN 0 AND 63")
def disc_dilate(spark: SparkSession, d: str) -> DataFrame:
    return raster.dilate(_spots(spark, d), ["view"], 2, 64)


@query()
def view_components(spark: SparkSession, d: str) -> DataFrame:
    return raster.component_boxes(raster.components_2d(_spots(spark, d), ["view"]), ["view"])


_REGIONS = "r AS (SELECT DISTINCT l_suppkey % 20 AS view, l_orderkey AS region, CASE WHEN l_returnflag = 'A' THEN 'reject' ELSE 'target' END AS role, l_partkey % 40 AS x1, l_orderkey % 40 AS y1, l_partkey % 40 + 12 AS x2, l_orderkey % 40 + 9 AS y2 FROM lineitem)"


@query(f"WITH {_SPOTS}, {_REGIONS}, h AS (SELECT view, px, py, role, count(DISTINCT (region, x1, y1)) AS votes FROM t JOIN r USING (view) WHERE px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2 GROUP BY ALL) SELECT view, role, count(*) AS hit_pixels, CAST(sum(votes) AS BIGINT) AS votes FROM h GROUP BY ALL")
def box_range_votes(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "lineitem").selectExpr("l_suppkey % 20 AS view", "l_orderkey AS region", "CASE WHEN l_returnflag = 'A' THEN 'reject' ELSE 'target' END AS role", "l_partkey % 40 AS x1", "l_orderkey % 40 AS y1", "l_partkey % 40 + 12 AS x2", "l_orderkey % 40 + 9 AS y2").distinct()
    h = joins.in_boxes(_spots(spark, d), r, ["view"]).groupBy("view", "px", "py", "role").agg(F.count("*").alias("votes"))  # regions are distinct, so each row is a vote
    return h.groupBy("view", "role").agg(F.count("*").alias("hit_pixels"), F.sum("votes").alias("votes"))


@query(f"WITH {_SPOTS}, q AS (SELECT DISTINCT l_suppkey % 20 AS view, l_orderkey * 10 + l_linenumber AS id, l_partkey % 64 AS x, l_suppkey % 64 AS y FROM lineitem), m AS (SELECT view, id, x, y, px, py, (px-x)*(px-x)+(py-y)*(py-y) AS d2 FROM q JOIN t USING (view) WHERE (px-x)*(px-x)+(py-y)*(py-y) <= 36) SELECT view, id, px, py, d2 FROM m QUALIFY row_number() OVER (PARTITION BY view, id ORDER BY d2, py, px) = 1")
def nearest_snap(spark: SparkSession, d: str) -> DataFrame:
    q = read(spark, d, "lineitem").selectExpr("l_suppkey % 20 AS view", "l_orderkey * 10 + l_linenumber AS id", "l_partkey % 64 AS x", "l_suppkey % 64 AS y").distinct()
    return joins.snap(q, _spots(spark, d), ["view"], "id", 6)


@query(f"WITH {_SPOTS}, n AS (SELECT view, py, count(*) AS n FROM t GROUP BY ALL), f AS (SELECT view, max(n) AS most FROM n GROUP BY view) SELECT view, min(py) AS body_top FROM n JOIN f USING (view) WHERE n >= greatest(2, round_even(CAST(most AS DOUBLE) * CAST(0.18 AS DOUBLE), 0)) GROUP BY view")
def body_top_rows(spark: SparkSession, d: str) -> DataFrame:
    return raster.body_top(_spots(spark, d), ["view"], 0.18, 2)


@query(f"WITH {_QUEUE} SELECT object_category, task, executor, count(*) AS n, CAST(sum(CASE WHEN sensible AND able THEN 1 ELSE 0 END) AS BIGINT) AS feasible FROM q GROUP BY GROUPING SETS ((object_category), (task), (executor), (task, executor), ())")
def union_extents_grouping(spark: SparkSession, d: str) -> DataFrame:
    q = review.build_queue(_samples(spark, d))
    sets = [["object_category"], ["task"], ["executor"], ["task", "executor"], []]
    g = q.groupingSets([[F.col(k) for k in s] for s in sets], F.col("object_category"), F.col("task"), F.col("executor"))
    return g.agg(F.count("*").alias("n"), F.count(F.when(F.col("executor_feasible"), 1)).alias("feasible"))


@query("SELECT field, value, count(*) AS n FROM (SELECT 'event_type' AS field, event_type AS value FROM events UNION ALL SELECT 'user_mod', CAST(user_id % 10 AS VARCHAR) FROM events) GROUP BY ALL")
def grouped_counts(spark: SparkSession, d: str) -> DataFrame:
    return review.counts_by(read(spark, d, "events").select("event_type", (F.col("user_id") % 10).alias("user_mod")), ["event_type", "user_mod"])


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 100 AS DOUBLE) + 0.5 AS a, CAST(l_suppkey % 80 AS DOUBLE) AS b, CAST(l_orderkey % 90 AS DOUBLE) AS c, CAST(l_quantity AS DOUBLE) + 30.5 AS d FROM lineitem),
n AS (SELECT l_orderkey, l_linenumber, CAST(least(greatest(round_even(a, 0), 0), 63) AS INTEGER) AS a, CAST(least(greatest(round_even(b, 0), 0), 47) AS INTEGER) AS b, CAST(least(greatest(round_even(c, 0), 0), 63) AS INTEGER) AS c, CAST(least(greatest(round_even(d, 0), 0), 47) AS INTEGER) AS d FROM b)
SELECT l_orderkey, l_linenumber, least(a, c) AS x1, least(b, d) AS y1, greatest(a, c) AS x2, greatest(b, d) AS y2 FROM n WHERE a <> c AND b <> d""")
def box_normalize(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    box = F.array((F.col("l_partkey") % 100).cast("double") + 0.5, (F.col("l_suppkey") % 80).cast("double"), (F.col("l_orderkey") % 90).cast("double"), F.col("l_quantity") + 30.5)
    n = li.select("l_orderkey", "l_linenumber", boxes.normalize_box(box, F.lit(64), F.lit(48)).alias("b")).filter("b IS NOT NULL")
    return n.select("l_orderkey", "l_linenumber", *[F.col("b")[i].alias(k) for i, k in enumerate(("x1", "y1", "x2", "y2"))])


@query("""WITH i AS (SELECT vec_id AS i FROM embeddings) SELECT i, CASE WHEN i < 26 THEN chr(CAST(65 + i AS INTEGER)) ELSE chr(CAST(65 + i // 26 - 1 AS INTEGER)) || chr(CAST(65 + i % 26 AS INTEGER)) END AS label, CASE WHEN i < 26 THEN chr(CAST(65 + i AS INTEGER)) ELSE 'C' || (i + 1) END AS numbered FROM i""")
def candidate_labels(spark: SparkSession, d: str) -> DataFrame:
    i = read(spark, d, "embeddings").select(F.col("vec_id").alias("i"))
    return i.select("i", text.candidate_label(F.col("i")).alias("label"), text.candidate_label_numbered(F.col("i")).alias("numbered"))


@query()
def standard_candidates(spark: SparkSession, d: str) -> DataFrame:
    made = candidates.generate(clouds(spark, d), "obj", "point", "standard")
    return candidates.rank(made, "obj", 36).drop("points", "extent")


@query()
def high_recall_candidates(spark: SparkSession, d: str) -> DataFrame:
    made = candidates.generate(clouds(spark, d), "obj", "point", "high_recall")
    return candidates.rank_high_recall(made, "obj").drop("points", "extent")


@query()
def growth_candidates(spark: SparkSession, d: str) -> DataFrame:
    seeds = F.array_compact(F.array(F.when(F.col("x") > 0.1, F.lit("target")), F.when(F.col("y") > 0.2, F.lit("veto")), F.when(F.col("z") > 0, F.lit("weak_hook"))))
    return candidates.rank(candidates.generate(clouds(spark, d).withColumn("seeds", seeds), "obj", "point", "growth"), "obj").drop("points", "extent")


# ---- further operators

@query("SELECT c_custkey, coalesce(s.event_type, 'pending') AS status, coalesce(s.event_id, -1) AS event_id FROM customer LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id) s ON c_custkey = s.user_id")
def latest_review_status(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("status"), "event_id").withColumn("seq", F.col("event_id"))
    last = windows.last_wins(e, ["c_custkey"], "seq").select("c_custkey", "status", "event_id")
    return review.reconcile(read(spark, d, "customer").select("c_custkey").withColumn("sample_id", F.col("c_custkey")), last.withColumn("sample_id", F.col("c_custkey")).drop("c_custkey"), ["c_custkey", "sample_id"], {"status": "pending", "event_id": -1}).select("c_custkey", "status", F.col("event_id").cast("long").alias("event_id"))


@query(r"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus || o_orderkey ELSE concat_ws('|', CASE WHEN trim(o_orderstatus) <> '' THEN o_orderstatus END, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderpriority END, CAST(o_custkey AS VARCHAR)) END AS row_key FROM orders")
def row_keys(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    explicit = F.when(k % 3 == 0, F.concat("o_orderstatus", k.cast("string"))).otherwise(F.lit(" "))
    return read(spark, d, "orders").select("o_orderkey", text.row_key(explicit, F.col("o_orderstatus"), F.when(k % 2 == 0, F.lit("")).otherwise(F.col("o_orderpriority")), F.col("o_custkey").cast("string")).alias("row_key"))


@query("""WITH w AS (SELECT p_partkey, upper(trim(u.w)) AS w, u.i FROM (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_type || '  ' || p_name, ' ')) AS w, generate_subscripts(string_split(p_name || ' ' || p_type || '  ' || p_name, ' '), 1) AS i FROM part) u),
f AS (SELECT p_partkey, w, min(i) AS i FROM w WHERE w <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS n FROM f) SELECT p_partkey, string_agg(w, ',' ORDER BY n) AS items FROM r WHERE n <= 4 GROUP BY ALL""")
def string_lists(spark: SparkSession, d: str) -> DataFrame:
    words = F.slice(text.id_list(F.split(F.concat_ws(" ", "p_name", "p_type", F.lit(""), "p_name"), " ")), 1, 4)
    return read(spark, d, "part").select("p_partkey", F.array_join(words, ",").alias("items"))


@query("""WITH r AS (SELECT event_id, (['missing_positive', 'over_label', 'none', 'wrong_region', 'task_mismatch', 'executor_mismatch'])[CAST(event_id % 6 AS INTEGER) + 1] AS issue, (['keep', 'refine', 'disable', 'add_missing', ''])[CAST(event_id % 5 AS INTEGER) + 1] AS decision FROM events)
SELECT CASE WHEN issue = 'missing_positive' OR decision = 'add_missing' THEN 'missing_label' WHEN issue IN ('over_label', 'wrong_region', 'executor_mismatch', 'task_mismatch') THEN issue WHEN decision = 'refine' THEN 'needs_refinement' WHEN decision = 'disable' THEN 'channel_disabled' ELSE 'other' END AS class,
CASE WHEN decision = '' THEN '<empty>' ELSE decision END AS decision, count(*) AS n FROM r GROUP BY ALL""")
def rule_error_classes(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % len(values)).cast("int") + 1)
    r = read(spark, d, "events").select(pick(["missing_positive", "over_label", "none", "wrong_region", "task_mismatch", "executor_mismatch"]).alias("issue"), pick(["keep", "refine", "disable", "add_missing", ""]).alias("decision"))
    shown = F.when(F.col("decision") == "", F.lit("<empty>")).otherwise(F.col("decision"))
    return r.select(text.rule_error(F.col("issue"), F.col("decision")).alias("class"), shown.alias("decision")).groupBy("class", "decision").agg(F.count("*").alias("n"))


@query(f"WITH {_SETS}, t AS (SELECT obj, count(DISTINCT point) AS n FROM s GROUP BY obj), c AS (SELECT obj, item, count(*) AS k FROM s GROUP BY ALL) SELECT obj, item, k >= 8 AND k <= floor(n * 0.6::DOUBLE) AS fits, k AS n_points FROM c JOIN t USING (obj)")
def candidate_size_gate(spark: SparkSession, d: str) -> DataFrame:
    s = _sets(spark, d)
    t = s.groupBy("obj").agg(F.countDistinct("point").alias("n"))
    k = s.groupBy("obj", "item").agg(F.count("*").alias("n_points")).join(t, "obj")
    return k.select("obj", "item", geometry.size_ok(F.col("n_points"), F.col("n"), 8, 0.6).alias("fits"), "n_points")


@query(f"WITH {_SETS}, t AS (SELECT obj, count(*) AS n FROM s GROUP BY obj), g AS (SELECT obj, item FROM s JOIN t USING (obj) GROUP BY obj, item, n HAVING count(*) >= 5 AND count(*) / CAST(n AS DOUBLE) BETWEEN 0.05 AND 0.3) SELECT obj, count(DISTINCT point) AS n_points FROM s SEMI JOIN g USING (obj, item) GROUP BY obj")
def gated_union(spark: SparkSession, d: str) -> DataFrame:
    s = _sets(spark, d)
    t = s.groupBy("obj").agg(F.count("*").alias("n_points"))
    return geometry.area_gate(s, ["obj", "item"], t, ["obj"], 5, 0.05, 0.3).groupBy("obj").agg(F.countDistinct("point").alias("n_points"))


_BOXES = "b AS (SELECT DISTINCT l_suppkey % 20 AS view, l_orderkey * 10 + l_linenumber AS id, l_partkey % 50 AS x1, l_suppkey % 50 AS y1, l_partkey % 50 + 8 AS x2, l_suppkey % 50 + 8 AS y2 FROM lineitem)"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").selectExpr("l_suppkey % 20 AS view", "l_orderkey * 10 + l_linenumber AS id", "l_partkey % 50 AS x1", "l_suppkey % 50 AS y1", "l_partkey % 50 + 8 AS x2", "l_suppkey % 50 + 8 AS y2").distinct()


@query(f"""WITH {_SPOTS}, {_BOXES}, g AS (SELECT view, id, x1, y1, x2, y2, min(px) FILTER (i) AS a1, min(py) FILTER (i) AS b1, max(px) FILTER (i) AS a2, max(py) FILTER (i) AS b2, min(px) FILTER (n) AS c1, min(py) FILTER (n) AS d1, max(px) FILTER (n) AS c2, max(py) FILTER (n) AS d2
FROM (SELECT b.*, px, py, px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2 AS i, abs(px - (x1 + x2) / 2.0) <= 12 AND abs(py - (y1 + y2) / 2.0) <= 12 AS n FROM b LEFT JOIN t USING (view)) GROUP BY view, id, x1, y1, x2, y2)
SELECT view, id, CAST(coalesce(a1, c1, x1) AS BIGINT) AS x1, CAST(coalesce(b1, d1, y1) AS BIGINT) AS y1, CAST(coalesce(a2, c2, x2) AS BIGINT) AS x2, CAST(coalesce(b2, d2, y2) AS BIGINT) AS y2 FROM g""")
def box_tighten(spark: SparkSession, d: str) -> DataFrame:
    t = joins.tighten(_boxes(spark, d), _spots(spark, d), ["view"], "id", 12)
    return t.select("view", "id", *[F.col(k).cast("long").alias(k) for k in ("x1", "y1", "x2", "y2")])


@query(f"WITH {_SPOTS} SELECT view, greatest(min(px) - 3, 0) AS x1, greatest(min(py) - 3, 0) AS y1, least(max(px) + 3, 63) AS x2, least(max(py) + 3, 63) AS y2 FROM t GROUP BY view")
def union_boxes(spark: SparkSession, d: str) -> DataFrame:
    return raster.union_box(_spots(spark, d), ["view"], 3, 64)


@query("""WITH m AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS sample_id, (['train', 'val', 'test'])[CAST(doc_id % 3 AS INTEGER) + 1] AS meant FROM documents), f AS (SELECT CAST(doc_id + 5 AS VARCHAR) AS sample_id, (['train', 'val', 'test'])[CAST((doc_id + quality) % 3 AS INTEGER) + 1] AS split FROM labels UNION ALL SELECT CAST(doc_id AS VARCHAR), 'train' FROM labels WHERE doc_id % 4 = 0),
s AS (SELECT sample_id, count(DISTINCT split) AS k, count(*) AS n, min(split) AS split FROM f GROUP BY sample_id),
j AS (SELECT * FROM m FULL JOIN s USING (sample_id)) SELECT 'ERROR' AS level, sample_id, 'missing from split file' AS message FROM j WHERE n IS NULL UNION ALL SELECT 'ERROR', sample_id, 'not in metadata' FROM j WHERE meant IS NULL UNION ALL SELECT 'ERROR', sample_id, 'in two splits' FROM j WHERE k > 1
UNION ALL SELECT 'ERROR', sample_id, 'doubled in split file' FROM j WHERE n > k UNION ALL SELECT 'ERROR', sample_id, 'in another split''s file' FROM j WHERE k = 1 AND split <> meant""")
def split_file_issues(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda i: F.element_at(F.array(*[F.lit(v) for v in ("train", "val", "test")]), (i % 3).cast("int") + 1)
    k = F.col("doc_id")
    m = read(spark, d, "documents").select(k.cast("string").alias("sample_id"), pick(k).alias("split"))
    labels = read(spark, d, "labels")
    f = labels.select(pick(k + F.col("quality")).alias("split"), (k + 5).cast("string").alias("sample_id"))
    return validate.split_issues(m, f.unionByName(labels.filter(k % 4 == 0).select(F.lit("train").alias("split"), k.cast("string").alias("sample_id"))))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def unfinished_work(spark: SparkSession, d: str) -> DataFrame:
    done = read(spark, d, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return audit.unfinished(read(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("""WITH w AS (SELECT l_partkey AS id, 'f' || l_suppkey AS path, l_linenumber AS rank FROM lineitem), e AS (SELECT DISTINCT 'f' || s_suppkey AS path FROM supplier WHERE s_suppkey % 3 <> 0)
SELECT id, rank, min(path) AS path FROM w SEMI JOIN e USING (path) WHERE (id, rank) IN (SELECT (id, min(rank)) FROM w SEMI JOIN e USING (path) GROUP BY id) GROUP BY id, rank""")
def first_path(spark: SparkSession, d: str) -> DataFrame:
    w = read(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("path"), F.col("l_linenumber").alias("rank"))
    e = read(spark, d, "supplier").filter("s_suppkey % 3 <> 0").select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("path"))
    return joins.first_present(w, e, "id", "path", "rank")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(try_cast(CASE WHEN event_id % 5 = 0 THEN 'none' ELSE CAST(value AS VARCHAR) END AS DOUBLE), 0.0))) AS confidence FROM events""")
def json_recovery(spark: SparkSession, d: str) -> DataFrame:
    wrapped = F.concat(F.lit("```json\nanswer: "), F.col("props"), F.lit("\n```"))
    given = F.when(F.col("event_id") % 5 == 0, F.lit("none")).otherwise(F.col("value").cast("string"))
    return read(spark, d, "events").select("event_id", F.get_json_object(text.extract_json(text.repair_json(wrapped)), "$.k").cast("long").alias("k"), text.confidence(given).alias("confidence"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brass') THEN 'brass' WHEN contains(lower(p_type), 'steel') THEN 'steel' WHEN contains(lower(p_type), 'o') THEN 'o' END AS prior FROM part WHERE contains(lower(p_type), 'brass') OR contains(lower(p_type), 'steel') OR contains(lower(p_type), 'o')")
def category_priors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", joins.category_prior(F.col("p_type"), ["brass", "steel", "o"]).alias("prior")).filter("prior IS NOT NULL")


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_type", F.col("ts"))
    return e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")
