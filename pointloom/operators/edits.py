"""Row selection, review and point-edit saves, candidate context: what the servers answer, as keyed operators."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom import constants as c
from pointloom.functions import text
from pointloom.operators import rules, windows


def not_empty(rows: DataFrame, says: str) -> DataFrame:
    """``rows``; an error where there are none."""
    n = rows.limit(1).agg(F.count("*").alias("__n"))
    ok = F.when(F.col("__n") == 0, F.raise_error(F.lit(says)).cast("boolean")).otherwise(F.lit(True))
    return rows.join(F.broadcast(n.filter(ok)), F.lit(True), "right").filter("__n > 0").drop("__n")  # one row


def select_rows(rows: DataFrame, seq: str, pilot_id: str | None = None, executor: str | None = None, include: list[str] | None = None, exclude: list[str] = [], limit: int | None = None) -> DataFrame:  # noqa: B006
    """The first ``limit`` rows in file order of a pilot, an executor and tasks; none is an error."""
    d = rows if pilot_id is None else rows.filter(F.col("pilot_id") == pilot_id)
    d = d if executor is None else d.filter(F.col("executor") == executor)
    d = d if include is None else d.filter(F.col("task").isin(*include))
    d = d.filter(~F.coalesce(F.col("task"), F.lit("")).isin(*exclude)) if exclude else d
    return not_empty(d if limit is None else d.orderBy(seq).limit(limit), "no rows selected")


def export_rows(rows: DataFrame, seq: str, sample_ids: list[str] | None, tasks: list[str] | None, limit: int | None) -> DataFrame:
    """Rows of an export: given samples and tasks, the first ``limit``; none is no error."""
    d = rows if not sample_ids else rows.filter(F.col("sample_id").isin(*sample_ids))
    d = d if not tasks else d.filter(F.col("task").isin(*tasks))
    return d if limit is None else d.orderBy(seq).limit(limit)


def any_feasible(feasibility: Column) -> Column:
    """Whether any executor is feasible; without a map none is."""
    return F.coalesce(F.exists(F.map_values(feasibility), lambda v: F.coalesce(v, F.lit(False))), F.lit(False))


def with_grounding(views: DataFrame, grounding: DataFrame, keys: list[str], allow_missing: bool) -> DataFrame:
    """Views with their grounding; one that is missing is an error, or gives a row with ``grounded`` false."""
    d = views.join(grounding.withColumn("grounded", F.lit(True)), keys, "left").withColumn("grounded", F.coalesce("grounded", F.lit(False)))
    if allow_missing:
        return d
    miss = F.raise_error(F.concat(F.lit("no grounding for "), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))).cast("boolean")
    return d.filter(F.when(F.col("grounded"), F.lit(True)).otherwise(miss))


def _area(b: dict[str, Column]) -> Column:
    return F.greatest(F.lit(0), b["x2"] - b["x1"]) * F.greatest(F.lit(0), b["y2"] - b["y1"])


def refine_boxes(boxes: DataFrame, crops: DataFrame, keys: list[str], seq: str, area: int, most_share: float, bad_labels: list[str], clip: bool = True, fall_back: bool = True) -> DataFrame:
    """keys, query, label, x1 .. y2, action of each view's boxes.

    A box with a bad label or too large a share of the image is clipped to the
    view's crop, or goes where that leaves nothing. Of equal boxes for one
    query the first stays; a view that is left without any gets its crop.
    ``crops`` has one row a view (keys, crop: struct of x1 .. y2, first_query).
    """
    d = boxes.withColumnRenamed(seq, "__seq").join(crops, keys)
    box = {k: F.col(k) for k in ("x1", "y1", "x2", "y2")}
    cut = {k: (F.greatest if k[1] == "1" else F.least)(F.col(k), F.col(f"crop.{k}")) for k in box}
    bad = (_area(box) / F.lit(float(area)) > most_share) | F.lower(F.trim("label")).isin(*bad_labels)
    fits = F.lit(clip) & F.col("crop").isNotNull() & (cut["x2"] > cut["x1"]) & (cut["y2"] > cut["y1"])
    d = d.withColumn("action", F.when(~bad, F.lit("keep")).when(fits, F.lit("clip_to_zoom_crop"))).filter("action IS NOT NULL")
    d = d.select(*keys, "__seq", "query", "label", "action", *[F.when(F.col("action") == "keep", F.col(k)).otherwise(v).alias(k) for k, v in cut.items()])
    d = d.groupBy(*keys, "query", *box).agg(F.min_by(F.struct("label", "action"), "__seq").alias("r")).select(*keys, "query", "r.label", *box, "r.action")
    if not fall_back:
        return d
    bare = crops.filter("crop IS NOT NULL").join(d.select(*keys).distinct(), keys, "left_anti")
    return d.unionByName(bare.select(*keys, F.col("first_query").alias("query"), F.lit("zoom_crop_fallback").alias("label"), *[F.col(f"crop.{k}").alias(k) for k in box], F.lit("fallback_to_zoom_crop").alias("action")))


def candidate_context(candidates: DataFrame, scores: DataFrame, records: DataFrame, update: DataFrame, keys: list[str], top: int | None = None, least_votes: int = 0) -> DataFrame:
    """Ranked candidates with what the rules, the manifest and the last update say of them.

    ``scores`` (keys, candidate_id, selected_votes, uncertain_votes,
    rule_score, decision), ``records`` (keys, candidate_id, candidate_name,
    candidate_family, point_count) and ``update`` (keys, candidate_id: those
    that start selected) meet on upper-case ids. With ``top``, ones that start
    selected come first, then those with enough votes, ``top`` in all.
    """
    upper = lambda d: d.withColumn("candidate_id", F.upper("candidate_id"))
    on = [*keys, "candidate_id"]
    d = upper(candidates).join(upper(scores), on, "left").join(upper(records), on, "left").join(upper(update).select(*on).distinct().withColumn("__default", F.lit(True)), on, "left")
    d = d.withColumns({k: F.coalesce(k, F.lit(0)) for k in ("selected_votes", "uncertain_votes", "point_count")} | {"rule_score": F.coalesce("rule_score", F.lit(0.0)), "decision": F.coalesce("decision", F.lit("")), "__default": F.coalesce("__default", F.lit(False))})
    accepted, uncertain = F.col("decision") == "accept_candidate", (F.col("decision") == "uncertain") | (F.col("uncertain_votes") > 0)
    bucket = F.when(F.col("__default"), 0).when(accepted, 1).when(F.col("selected_votes") > 0, 2).when(uncertain, 3).otherwise(4)
    status = F.when(F.col("__default"), "selected").when(accepted, "accepted").when(F.col("decision") == "uncertain", "uncertain").otherwise("candidate")
    has = d.groupBy(*keys).agg(F.max("__default").alias("__has"))
    d = d.withColumns({"bucket": bucket, "auto_status": status}).join(has, keys)
    d = d.withColumn("default_checked", F.when(F.col("__has"), F.col("__default")).otherwise(accepted))
    d = windows.ranked(d, keys, [F.col("bucket"), F.col("selected_votes").desc(), F.col("rule_score").desc(), F.col("candidate_id")])
    if top is not None:
        d = windows.ranked(d.filter(F.col("__default") | (F.col("selected_votes") >= least_votes)), keys, [(~F.col("__default")).cast("int"), F.col("place")], "__shown").filter(F.col("__shown") <= top).drop("__shown")
    return d.drop("__default", "__has")


def initial_review(samples: DataFrame, page: str = "{sample_id}.html") -> DataFrame:
    """A pending review row of each sample: identity from the sample, all answers blank."""
    before, _, after = page.partition("{sample_id}")
    given = lambda k: F.coalesce(F.col(k), F.lit("")).alias(k) if k in samples.columns else F.lit("").alias(k)
    answers = ["keep_sample", "quality_after_review", "sample_issue_type", "sample_notes", *[f"{e}_{k}" for e in c.EXECUTORS for k in ("decision", "issue_type", "notes")]]
    return samples.select(
        "sample_id", *[given(k) for k in ("object_id", "object_category", "task")], F.concat(F.lit(before), "sample_id", F.lit(after)).alias("visualization_html_path"),
        *[given(k) for k in ("point_cloud_path", "multi_channel_mask_path")], F.lit("pending").alias("review_status"), *[F.lit("").alias(k) for k in answers],
    )


def save_reviews(samples: DataFrame, reviews: DataFrame, payloads: DataFrame, seq: str, identity: list[str]) -> DataFrame:
    """``reviews`` after ``payloads``: of each answer the last one that a payload gives; identity stays the sample's.

    A null in a payload leaves the answer as it is. A payload of an unknown
    sample is an error.
    """
    answers = [k for k in reviews.columns if k not in identity]
    told = payloads.groupBy("sample_id").agg(*[F.max_by(F.col(k), F.when(F.col(k).isNotNull(), F.col(seq))).alias(f"__{k}") for k in answers if k in payloads.columns])
    known = samples.select("sample_id").withColumn("__known", F.lit(True))
    bad = F.when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit("unknown sample_id: "), "sample_id")).cast("boolean")).otherwise(F.lit(True))
    told = told.join(known, "sample_id", "left").filter(bad).drop("__known")
    d = samples.select(*identity).join(reviews.select("sample_id", *answers), "sample_id", "left").join(told, "sample_id", "left")
    return d.select(*identity, *[F.coalesce(*([f"__{k}"] if k in payloads.columns else []), k, F.lit("pending" if k == "review_status" else "")).alias(k) for k in answers])


def save_edits(masks: DataFrame, counts: DataFrame, edits: DataFrame, seq: str, point: str, partial_too: bool = False) -> tuple[DataFrame, DataFrame]:
    """Masks (row_key, executor, point) after point edits, and the audit row of each edit that counts.

    ``edits`` has row_key, executor, positive_indices, visible_all_points and
    ``seq``; the last one of a row and channel counts. Indices outside the
    row's points (``counts``: row_key, n_points) are left out; an unknown
    executor, or a save that did not see all points, is an error.
    """
    wrong = F.when(~F.col("executor").isin(*c.EXECUTORS), F.raise_error(F.concat(F.lit("unknown executor: "), "executor")).cast("boolean"))
    wrong = wrong.when(~F.coalesce("visible_all_points", F.lit(False)) & ~F.lit(partial_too), F.raise_error(F.lit("refusing a partial save")).cast("boolean")).otherwise(F.lit(True))
    on = ["row_key", "executor"]
    last = windows.last_wins(edits.filter(wrong), on, seq).drop("first_seq").join(counts, "row_key")
    last = last.withColumn("after", F.array_sort(F.array_distinct(F.filter("positive_indices", lambda i: (i >= 0) & (i < F.col("n_points"))))))
    old = masks.join(last.select(*on), on, "left_semi").groupBy(*on).agg(F.array_sort(F.collect_set(point)).alias("before"))
    d = last.join(old, on, "left").withColumn("before", F.coalesce("before", F.array().cast(dict(old.dtypes)["before"]))).withColumn("after", F.col("after").cast(dict(old.dtypes)["before"]))
    audit = d.withColumns({
        "positive_points_before": F.size("before"), "positive_points_after": F.size("after"),
        "added_points": F.array_sort(F.array_except("after", "before")), "removed_points": F.array_sort(F.array_except("before", "after")),
    }).drop("before", "after", "positive_indices", "n_points", "visible_all_points")
    new = d.select(*on, F.explode_outer("after").alias(point))
    return rules.overwrite_channel(masks, new, ["row_key"], point), audit


def reload_rows(sources: list[DataFrame], keys: list[str], seq: str, include: list[str] | None, exclude: list[str]) -> DataFrame:
    """Rows of all sources, later sources over earlier ones and the last row of a key, of the wanted tasks."""
    every = None
    for i, s in enumerate(sources):
        d = s.withColumn("__source", F.lit(i))
        every = d if every is None else every.unionByName(d, allowMissingColumns=True)
    d = windows.last_wins(every.withColumn("__seq", F.struct("__source", seq)), keys, "__seq").drop("__source", "__seq", "first_seq")
    task = F.coalesce(F.col("task"), F.lit(""))
    d = d if include is None else d.filter(task.isin(*include))
    return d.filter(~task.isin(*exclude)) if exclude else d


def sample_payload(points: DataFrame, masks: DataFrame, key: str, point: str) -> DataFrame:
    """One row a sample: points in order, rounded to 5 places, counts and positive points by channel."""
    p = points.groupBy(key).agg(F.count("*").alias("n_points"), F.sort_array(F.collect_list(F.struct(point, *[F.bround(k, 5).alias(k) for k in "xyz"]))).alias("points"))
    m = masks.groupBy(key, "executor").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(point)).alias("ids"))
    m = m.groupBy(key).agg(*[F.coalesce(F.max(F.when(F.col("executor") == e, F.col("n"))), F.lit(0)).alias(f"{e}_points") for e in c.EXECUTORS], F.map_from_entries(F.array_sort(F.collect_list(F.struct("executor", "ids")))).alias("positive"))
    return p.join(m, key, "left").withColumns({f"{e}_points": F.coalesce(f"{e}_points", F.lit(0)) for e in c.EXECUTORS})


def guarded(rows: DataFrame, key: str, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on each group, with a column ``error``: a group that fails becomes one row that says why, and the others go on.

    ``schema`` is that of ``work``'s rows without the key.
    """
    kinds = dict(rows.dtypes)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        which = pdf[key].iloc[0]
        try:
            out = work(pdf)
            out = out[names].assign(error=None)
        except Exception as e:  # a bad group is data
            out = pd.DataFrame([{n: None for n in names} | {"error": f"{type(e).__name__}: {e}"}])
        out.insert(0, key, which)
        return out

    return rows.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {schema}, error string")


def positive_count(*given: Column) -> Column:
    """The first value that is there and is a whole number, else 0."""
    return F.coalesce(*[text.blank_to_null(g.cast("string")).try_cast("long") for g in given], F.lit(0))


def target_executor(*given: Column) -> Column:
    """The first value that is not blank, if it is an executor; else hook."""
    first = F.coalesce(*[text.blank_to_null(g) for g in given])
    return F.when(first.isin(*c.EXECUTORS), first).otherwise(F.lit("hook"))


def split_by_mask(points: DataFrame, mask: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Points to preserve, and the body that is left."""
    on = mask.select(*keys).distinct()
    return points.join(on, keys, "left_semi"), points.join(on, keys, "left_anti")


def usable_masks(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, how of each sample's first mask in order of ``rank`` that exists and fits.

    ``found`` has keys, rank, path, exists, rows, cols (null for a flat
    array) and n_points. A flat mask of the right length stands for the target
    channel alone. A sample without any is an error.
    """
    how = F.when((F.col("rows") == F.col("n_points")) & (F.col("cols") == len(c.EXECUTORS)), "all_channels").when((F.col("rows") == F.col("n_points")) & F.col("cols").isNull(), "target_channel")
    d = found.withColumn("how", F.when(F.col("exists"), how))
    d = d.groupBy(*keys).agg(F.min(F.when(F.col("how").isNotNull(), F.struct("rank", "path", "how"))).alias("r"))
    bad = F.when(F.col("r").isNull(), F.raise_error(F.concat(F.lit("no usable mask: "), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))).cast("boolean")).otherwise(F.lit(True))
    return d.filter(bad).select(*keys, "r.path", "r.how")
