"""Rules that decide: keyword priors, weak labels, candidate scores, gates, channel writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom import constants as c
from pointloom.functions import text
from pointloom.operators import geometry, joins


def executors_of_region(name: Column, task: Column) -> Column:
    """Executors that a region's name suggests for a task, in the fixed order. Keywords are found inside words too."""
    n = text.normalize_name(name)
    hook, handle, flat, body, press = (text.has_any(n, w) for w in (c.HOOKABLE, c.HANDLE_LIKE, c.FLAT_LIKE, c.BODY_LIKE, c.PRESS_LIKE))
    lift, pull, push = task.isin("pick_up", "lift_carry"), task == "open_pull", task == "press_push"
    grip = (lift & (handle | body)) | (pull & (handle | text.has_any(n, c.PULL_EDGE)))
    says = {
        "gripper": grip,
        "suction": (lift & flat) | (pull & flat & text.has_any(n, c.PULL_FLAT)) | (push & flat & ~hook),
        "hook": (lift | pull) & hook,
        "dexterous_hand": grip | (push & press),
    }
    return F.array_compact(F.array(*[F.when(says[e], F.lit(e)) for e in c.EXECUTORS]))


def weak_label_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(c.WEAK_LABEL_RULES, "task string, executor string, affordance string, low double, high double")


def weak_masks(labels: DataFrame, totals: DataFrame, rules: DataFrame, obj: str, point: str, least: int = 8) -> DataFrame:
    """obj, task, executor, point: for each rule, the affordance's points if it has enough and its share fits.

    ``labels`` has one row an object, affordance and positive point, ``totals``
    obj and n_points. Affordances are gated once each, before the union.
    """
    n = labels.groupBy(obj, "affordance").agg(F.count("*").alias("__n")).join(totals, obj)
    ok = n.join(F.broadcast(rules), "affordance")  # the fixed rule table
    share = F.col("__n") / F.col("n_points")
    ok = ok.filter((F.col("__n") >= least) & (share >= F.col("low")) & (share <= F.col("high"))).select(obj, "affordance", "task", "executor")
    return labels.join(ok, [obj, "affordance"]).select(obj, "task", "executor", point).distinct()


def feasibility(masks: DataFrame, samples: DataFrame, keys: list[str], least: int) -> DataFrame:
    """keys, executor, n_points, feasible for all four executors of every sample."""
    every = samples.select(*keys).distinct().join(F.broadcast(joins.executor_dim(samples.sparkSession)))
    n = masks.groupBy(*keys, "executor").agg(F.count("*").alias("n_points"))
    return every.join(n, [*keys, "executor"], "left").select(
        *keys, "executor", "channel", F.coalesce("n_points", F.lit(0)).alias("n_points"), (F.coalesce("n_points", F.lit(0)) >= least).alias("feasible")
    )


def label_source(feasible: Column, given: str = "existing_affordance_mask") -> Column:
    return F.when(feasible, F.lit(given)).otherwise(F.lit("unavailable"))


def negative_reason(executor: Column, feasible: Column, given: Column | None = None) -> Column:
    made = F.when(feasible, F.lit("")).otherwise(F.concat(F.lit("no_"), executor, F.lit("_feasible_region")))
    return F.coalesce(text.blank_to_null(given), made) if given is not None else made


def _terms(parts: list[tuple[Column, float, str]]) -> tuple[Column, Column]:
    """Sum of the weights that apply, in order, and their names."""
    score, reasons = F.lit(0.0), []
    for when, weight, name in parts:
        when = F.coalesce(when, F.lit(False))
        score = score + F.when(when, F.lit(weight)).otherwise(F.lit(0.0))
        reasons.append(F.when(when, F.lit(name)))
    return score, F.array_compact(F.array(*reasons))


def family_score(executor: Column, family: Column, task: Column) -> tuple[Column, Column]:
    f = F.lower(family)
    hook, smooth = f.isin(*c.HOOK_FAMILIES), f.isin(*c.SMOOTH_FAMILIES)
    suction, hooks, grip, hand = (executor == e for e in ("suction", "hook", "gripper", "dexterous_hand"))
    return _terms([
        (f == "vlm_coverage_missing_region", 0.42, "reported missing by coverage check"),
        (suction & f.isin("smooth_surface", "smooth_extreme_patch", "existing_weak_mask"), 0.55, "smooth or prior mask suits suction"),
        (suction & hook, -0.45, "thin or edged parts do not seal"),
        (hooks & hook, 0.50, "edges and protrusions may hook"),
        (hooks & (f == "paired_loop_or_handle"), 0.18, "paired loop"),
        (hooks & (f == "paired_loop_handle_candidate"), 0.20, "paired loop candidate"),
        (hooks & smooth, -0.35, "plain surfaces do not interlock"),
        (grip & hook, 0.45, "thin parts may be gripped"),
        (grip & f.isin("smooth_surface", "central_body"), -0.20, "large faces need an opposite face"),
        (hand & (hook | f.isin("central_body", "existing_weak_mask")), 0.38, "fit for fingers"),
        (hand & f.isin("smooth_surface", "smooth_extreme_patch") & (task != "press_push"), -0.20, "large faces are no hand target"),
        ((task == "press_push") & hand & f.isin(*c.PRESS_FAMILIES), 0.18, "may be pressed"),
        (task.isin("open_pull", "lift_carry") & hooks & hook, 0.12, "pulling favours edges"),
    ])


def size_score(executor: Column, share: Column, extent: Column) -> tuple[Column, Column]:
    most = F.coalesce(F.array_max(extent), F.lit(0.0))
    least = F.coalesce(F.array_min(extent), F.lit(0.0))
    return _terms([
        ((share > 0.45) & executor.isin("hook", "gripper"), -0.35, "too large"),
        ((share > 0.45) & (executor == "suction"), -0.10, "very large"),
        (share < 0.005, -0.12, "very few points"),
        ((executor == "hook") & (most > 0.65) & (share > 0.18), -0.25, "spans the object"),
        ((executor == "suction") & ((least < 0.02) | (share < 0.02)), -0.30, "too narrow to seal"),
    ])


def score_candidates(df: DataFrame, least_votes: int, external_sources: tuple[str, ...] = ()) -> DataFrame:
    """Adds rule_score (4 places, rounded after deciding), decision and reasons.

    Columns: executor, task, candidate_family, recommended_executors,
    selected_votes, uncertain_votes, point_fraction, bbox_extent_ratio, source,
    provenance. Terms are added in a fixed order, as sums of binary fractions
    at the thresholds depend on it.
    """
    voted = F.col("selected_votes") >= least_votes
    outside = F.lit(False)
    for s in external_sources:
        outside = outside | (F.lower("source") == s) | F.contains(F.lower("provenance"), F.lit(s))
    base, why = _terms([
        (F.array_contains("recommended_executors", F.col("executor")), 0.25, "recommended"),
        (voted, 0.40, "selected by votes"),
        (voted & outside, 0.20, "external part"),
        (~voted & (F.col("uncertain_votes") > 0), 0.10, "uncertain votes"),
    ])
    fs, fr = family_score(F.col("executor"), F.coalesce("candidate_family", F.lit("")), F.col("task"))
    ss, sr = size_score(F.col("executor"), F.coalesce("point_fraction", F.lit(0.0)), F.col("bbox_extent_ratio"))
    d = df.withColumns({"__s": (base + fs) + ss, "reasons": F.concat(why, fr, sr)})
    decision = F.when(F.col("__s") >= c.ACCEPT_SCORE, "accept_candidate").when(F.col("__s") >= c.UNCERTAIN_SCORE, "uncertain").otherwise("reject_candidate")
    return d.withColumns({"rule_score": F.round("__s", 4), "decision": decision}).drop("__s")


def acceptance_gate(decision: Column, ran: Column, shown: Column, selected: Column, uncertain: Column, least_votes: int) -> Column:
    """What votes leave of a rule's decision, once a selection has run.

    ``shown`` is null if no list of shown candidates exists.
    """
    weak = (selected > 0) | (uncertain > 0)
    accepted = decision == "accept_candidate"
    gated = (
        F.when(F.coalesce(~shown, F.lit(False)), F.lit("reject_candidate"))
        .when(selected >= least_votes, decision)
        .when(accepted & weak, F.lit("uncertain"))
        .when(accepted, F.lit("reject_candidate"))
        .otherwise(decision)
    )
    return F.when(ran, gated).otherwise(decision)


def row_gate(df: DataFrame, keys: list[str], least_votes: int, require_votes: bool = True, rules_alone: bool = True) -> DataFrame:
    """The decision after what a selection says of the row's candidates as a whole.

    Where a selection ran without any sign, accepted candidates become
    uncertain and the acceptance gate does not run; where it gave signs, the
    gate runs if ``require_votes``; where none ran, every candidate becomes
    uncertain unless ``rules_alone``. Columns: decision, selected_votes,
    uncertain_votes, selection_ran, shown (null without a list of shown ones).
    """
    signal = df.groupBy(*keys).agg((F.max("selected_votes") + F.max("uncertain_votes") > 0).alias("__signal"), F.max("selection_ran").alias("__ran"))
    d = df.join(signal, keys)
    gated = acceptance_gate(F.col("decision"), F.lit(require_votes), F.col("shown"), F.col("selected_votes"), F.col("uncertain_votes"), least_votes)
    without = F.col("decision") if rules_alone else F.lit("uncertain")
    after = F.when(F.col("__ran") & F.col("__signal"), gated).when(F.col("__ran"), F.when(F.col("decision") == "accept_candidate", F.lit("uncertain")).otherwise(F.col("decision"))).otherwise(without)
    return d.withColumn("decision", after).drop("__signal", "__ran")


def manifest_defaults(rules: DataFrame, keys: list[str], policy: str = "accepted") -> DataFrame:
    """keys, default_selected_candidates, accepted, uncertain: what a manifest starts with after the rules.

    ``policy`` "accept_or_uncertain" falls back on the uncertain ones where none is accepted.
    """
    of = lambda d: F.transform(F.sort_array(F.collect_list(F.when(F.col("decision") == d, F.struct("place", "candidate_id")))), lambda x: x["candidate_id"])
    out = rules.groupBy(*keys).agg(of("accept_candidate").alias("accepted"), of("uncertain").alias("uncertain"))
    first = F.when(F.size("accepted") == 0, F.col("uncertain")).otherwise(F.col("accepted")) if policy == "accept_or_uncertain" else F.col("accepted")
    return out.withColumn("default_selected_candidates", first)


def selected_ids(rules: DataFrame, keys: list[str], uncertain_too: bool = False) -> DataFrame:
    wanted = ["accept_candidate"] + (["uncertain"] if uncertain_too else [])
    return rules.filter(F.col("decision").isin(*wanted)).select(*keys, "candidate_id")


def overwrite_channel(base: DataFrame, new: DataFrame, keys: list[str], point: str) -> DataFrame:
    """keys, executor, point: ``new`` (keys, executor, point) takes the place of those channels in ``base``.

    A target without points is given by a row with a null point: the channel becomes empty.
    """
    targets = new.select(*keys, "executor").distinct()
    kept = base.join(targets, [*keys, "executor"], "left_anti").select(*keys, "executor", point)
    return kept.unionByName(new.filter(F.col(point).isNotNull()).select(*keys, "executor", point)).distinct()


def apply_overrides(base: DataFrame, overrides: DataFrame, keys: list[str], point: str) -> DataFrame:
    """Set, then add, then remove, for each channel; ``overrides`` is (keys, executor, op, point).

    One pass: a point's flags say where it comes from, and the channels that
    are set are looked up. A ``set`` with a null point empties the channel.
    """
    on = [*keys, "executor"]
    every = base.select(*on, point, F.lit("base").alias("op")).unionByName(overrides.select(*on, point, "op")).filter(F.col(point).isNotNull())
    flags = every.groupBy(*on, point).agg(*[F.max(F.col("op") == op).alias(f"__{op}") for op in ("base", "set", "add", "remove")])
    told = overrides.filter("op = 'set'").select(*on).distinct().withColumn("__told", F.lit(True))
    d = flags.join(told, on, "left")
    return d.filter("NOT __remove AND (__set OR __add OR (__base AND __told IS NULL))").select(*on, point)


def region_masks(regions: DataFrame, task: str, key: str, point: str) -> DataFrame:
    """key, executor, point of named regions: executors given, or inferred from the name; absent tasks mean all."""
    fits = F.col("tasks").isNull() | F.array_contains("tasks", task)
    who = F.coalesce(F.when(F.size("executors") > 0, text.ordered_executors(F.col("executors"), c.EXECUTORS)), executors_of_region(F.col("name"), F.lit(task)))
    return regions.filter(fits).select(key, F.explode(who).alias("executor"), point).distinct()


def weak_mask_pipeline(regions: DataFrame, normals: DataFrame, overrides: DataFrame, task: str, key: str, point: str, least_normal: float = 0.95) -> DataFrame:
    """Regions, united with axis-aligned suction points, then overrides."""
    flat = geometry.axis_aligned(normals, least_normal).select(key, F.lit("suction").alias("executor"), point)
    return apply_overrides(region_masks(regions, task, key, point).unionByName(flat).distinct(), overrides, [key], point)
