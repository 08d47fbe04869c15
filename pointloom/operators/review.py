"""Human review: queues, decisions, edits and releases as keyed DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom import constants as c
from pointloom.functions import text
from pointloom.operators import joins, rules, windows


def build_queue(samples: DataFrame, least_reviews: Column | None = None, common_sense: bool = True, keep_infeasible: bool = True) -> DataFrame:
    """One row a sample and executor with decision, issue, mode and reason.

    ``samples`` has seq, sample_id, object_category, task and the map
    feasibility; a missing map or entry counts as infeasible.
    """
    d = samples.join(F.broadcast(joins.executor_dim(samples.sparkSession)))
    sensible = joins.compatible(F.col("object_category"), F.col("task")) if common_sense else F.lit(True)
    feasible = F.coalesce(F.col("feasibility")[F.col("executor")], F.lit(False)) & sensible
    d = d.withColumns({"object_task_feasible": sensible, "executor_feasible": feasible, "skip_reason": joins.mismatch_reason(F.col("object_category"), F.col("task")) if common_sense else F.lit("")})
    d = d.withColumns({
        "decision": F.when(F.col("executor_feasible"), F.lit("refine")).otherwise(F.lit("not_applicable")),
        "issue_type": F.when(F.col("executor_feasible"), F.lit("needs_geometry_rule")).otherwise(F.lit("none")),
        "review_mode": F.when(F.col("executor_feasible"), F.lit("review")).otherwise(F.lit("empty")),
        "negative_reason": rules.negative_reason(F.col("executor"), F.col("executor_feasible")),
    })
    if least_reviews is not None:
        d = d.filter(least_reviews)
    return d if keep_infeasible else d.filter("executor_feasible")


def first_reason(checks: list[tuple[Column, Column]]) -> Column:
    """The reason of the first check that a row fails, else null."""
    out = F.lit(None).cast("string")
    for fails, reason in reversed(checks):
        out = F.when(F.coalesce(fails, F.lit(False)), reason).otherwise(out)
    return out


def release_reason(include: list[str] | None, exclude: list[str], statuses: list[str] | None, qualities: list[str] | None) -> Column:
    """Why a row is left out of a release; the order of the checks is part of the result."""
    task, status, quality = (F.coalesce(F.col(k), F.lit("")) for k in ("task", "point_review_status", "quality_flag"))
    shown = lambda v: F.when(v == "", F.lit("<empty>")).otherwise(v)
    checks = []
    if include is not None:
        checks.append((~task.isin(*include), F.concat(F.lit("task_not_included:"), task)))
    if exclude:
        checks.append((task.isin(*exclude), F.concat(F.lit("task_excluded:"), task)))
    if statuses is not None:
        checks.append((~status.isin(*statuses), F.concat(F.lit("status_filtered:"), shown(status))))
    if qualities is not None:
        checks.append((~quality.isin(*qualities), F.concat(F.lit("quality_filtered:"), shown(quality))))
    checks.append((status == "reject", F.lit("review_rejected")))
    return first_reason(checks)


def release(rows: DataFrame, keys: list[str], seq: str, reason: Column, split: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of the release, last of each key, and counts of why others are left out."""
    last = windows.last_wins(rows, keys, seq).withColumn("reason", reason)
    kept = last.filter("reason IS NULL").drop("reason")
    if split is not None:
        kept = kept.withColumn("split", F.lit(split))
    return kept, last.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def review_counters(samples: DataFrame, review: DataFrame) -> DataFrame:
    """counter, a, b, n: the counts of an applied review, blanks as <empty>.

    status; keep by task; decision by executor; issue by executor; refine rows
    by executor; errors of the rules by executor.
    """
    show = lambda v: F.when(F.coalesce(F.trim(v), F.lit("")) == "", F.lit("<empty>")).otherwise(v)
    d = samples.select("sample_id", "task").join(review.select("sample_id", "review_status", "keep_sample"), "sample_id", "left")
    channel = long_decisions(review).join(samples.select("sample_id"), "sample_id", "left_semi")
    refine = F.col("decision").isin(*c.REFINE_DECISIONS)
    rows = lambda df, name, a, b: df.select(F.lit(name).alias("counter"), a.alias("a"), b.alias("b"))
    parts = [
        rows(d, "review_status", show(F.col("review_status")), F.lit("")), rows(d, "task_keep", F.col("task"), show(F.col("keep_sample"))),
        rows(channel, "executor_decision", F.col("executor"), show(F.col("decision"))), rows(channel, "executor_issue", F.col("executor"), show(F.col("issue_type"))),
        rows(channel.filter(refine), "executor_refine", F.col("executor"), F.col("decision")), rows(channel.filter(refine), "rule_error", F.col("executor"), text.rule_error(F.col("issue_type"), F.col("decision"))),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("counter", "a", "b").agg(F.count("*").alias("n"))


def long_decisions(review: DataFrame) -> DataFrame:
    """sample_id, executor, decision, issue_type, notes from three columns an executor."""
    parts = ", ".join(f"'{e}', {e}_decision, {e}_issue_type, {e}_notes" for e in c.EXECUTORS)
    return review.selectExpr("sample_id", f"stack({len(c.EXECUTORS)}, {parts}) AS (executor, decision, issue_type, notes)")


def apply_review(samples: DataFrame, masks: DataFrame, review: DataFrame, point: str, least: int = 1) -> dict[str, DataFrame]:
    """kept, rejected, refine_queue, masks and feasibility after a review.

    ``samples`` left-joins ``review`` (one row a sample); a sample that is not
    kept or is rejected goes, disabled channels become empty, channels to
    refine are queued, and feasibility is counted anew.
    """
    r = review.select("sample_id", "review_status", "keep_sample", "sample_issue_type", "sample_notes", "quality_after_review")
    d = samples.join(r, "sample_id", "left")
    gone = (F.coalesce("keep_sample", F.lit("")) == "no") | (F.coalesce("review_status", F.lit("")) == "reject")
    kept, rejected = d.filter(~gone), d.filter(gone)
    channel = long_decisions(review).join(kept.select("sample_id", "object_category", "task"), "sample_id")
    off = channel.filter(F.col("decision").isin(*c.DISABLE_DECISIONS)).select("sample_id", "executor")
    left = masks.join(kept.select("sample_id"), "sample_id", "left_semi").join(off, ["sample_id", "executor"], "left_anti")
    given = text.blank_to_null(F.col("quality_after_review"))
    given = F.when(given.isNotNull() & ~given.isin(*c.QUALITY_FLAGS), F.raise_error(F.concat(F.lit("quality_after_review: "), given)).cast("string")).otherwise(given)
    quality = F.coalesce(given, F.col("quality_flag"))
    return {
        "kept": kept.withColumn("quality_flag", quality), "rejected": rejected.select("sample_id", "object_category", "task", "review_status", "keep_sample", "sample_issue_type", "sample_notes"),
        "refine_queue": channel.filter(F.col("decision").isin(*c.REFINE_DECISIONS)), "masks": left, "feasibility": rules.feasibility(left, kept, ["sample_id"], least),
    }


def reconcile(samples: DataFrame, review: DataFrame, identity: list[str], defaults: dict[str, str]) -> DataFrame:
    """Each sample's review row: identity from the samples, answers from the review, defaults where there are none."""
    answers = [c_ for c_ in review.columns if c_ not in identity or c_ == "sample_id"]
    d = samples.select(*identity).join(review.select(*answers), "sample_id", "left")
    return d.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in defaults.items()})


def edit_diff(before: DataFrame, after: DataFrame, keys: list[str], point: str) -> DataFrame:
    """keys, added, removed: sorted points that an edit adds and takes away; only what differs is gathered."""
    old, new = before.select(*keys, point).distinct(), after.select(*keys, point).distinct()
    gather = lambda a, b, name: a.join(b, [*keys, point], "left_anti").groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias(name))
    every = before.select(*keys).union(after.select(*keys)).distinct()
    d = every.join(gather(new, old, "added"), keys, "left").join(gather(old, new, "removed"), keys, "left")
    none = F.array().cast(f"array<{dict(before.dtypes)[point]}>")
    return d.withColumns({k: F.coalesce(k, none) for k in ("added", "removed")})


def resolve_key(rows: DataFrame, wanted: str) -> DataFrame:
    """The row with that row_key, or the only one with that sample_id; several are an error."""
    d = rows.filter((F.col("row_key") == wanted) | (F.col("sample_id") == wanted)).withColumn("exact", F.col("row_key") == wanted)
    n = d.agg(F.max(F.col("exact").cast("int")).alias("e"), F.count("*").alias("n"))
    d = d.join(F.broadcast(n)).filter(F.col("exact") | (F.col("e") == 0))  # one row
    bad = (F.col("e") == 0) & (F.col("n") > 1)
    return d.filter(F.when(bad, F.raise_error(F.lit(f"ambiguous sample: {wanted}")).cast("boolean")).otherwise(F.lit(True))).drop("exact", "e", "n")


def counts_by(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, value, n of several columns at once; blanks are <empty>."""
    shown = [F.when(F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")) == "", F.lit("<empty>")).otherwise(F.col(k).cast("string")).alias(k) for k in columns]
    parts = ", ".join(f"'{k}', {k}" for k in columns)
    return df.select(*shown).selectExpr(f"stack({len(columns)}, {parts}) AS (field, value)").groupBy("field", "value").agg(F.count("*").alias("n"))


def all_val(rows: DataFrame) -> DataFrame:
    """split, sample_id: every row in val."""
    return rows.select(F.lit("val").alias("split"), "sample_id")
