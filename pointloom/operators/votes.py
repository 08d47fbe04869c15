"""Votes of views on points and candidates, and fusion by thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators import joins, raster


def scores(df: DataFrame) -> DataFrame:
    """score = votes / visible, 0 for what no view sees."""
    return df.withColumn("score", F.when(F.col("visible") > 0, F.col("votes") / F.col("visible")).otherwise(F.lit(0.0)))


def mask_votes(pixels: DataFrame, masks: DataFrame, keys: list[str], view: list[str], point: str, threshold: float = 0.5) -> DataFrame:
    """keys, point, executor, votes, visible, score.

    ``pixels`` (keys, view, px, py, point) says which point a pixel shows,
    ``masks`` (keys, view, px, py, executor, value) is the 2-D mask; a view
    whose mask is missing counts neither votes nor sight.
    """
    on = [*keys, *view]
    seen = pixels.join(masks.select(*on).distinct(), on, "left_semi").groupBy(*keys, point).agg(F.count("*").alias("visible"))
    hit = pixels.join(masks.filter(F.col("value") >= threshold), [*on, "px", "py"]).groupBy(*keys, point, "executor").agg(F.count("*").alias("votes"))
    return scores(hit.join(seen, [*keys, point]))


def region_votes(pixels: DataFrame, regions: DataFrame, keys: list[str], view: str, point: str, radius: int, size: int) -> DataFrame:
    """keys, point, role, votes, visible, score of target and reject regions.

    Each region (keys, view, region, role, x1 .. y2) votes by itself, so where
    regions overlap a point gets several votes and its score may pass 1. Views
    without regions count as sight.
    """
    on = [*keys, view]
    inside = joins.in_boxes(pixels, regions, on).select(*on, "region", "role", "px", "py")
    grown = raster.dilate(inside, [*on, "region", "role"], radius, size)
    hits = grown.join(pixels, [*on, "px", "py"]).groupBy(*keys, point, "role").agg(F.count("*").alias("votes"))
    seen = pixels.groupBy(*keys, point).agg(F.count("*").alias("visible"))
    roles = regions.select("role").distinct()  # a fixed handful of names
    every = seen.join(F.broadcast(roles)).join(hits, [*keys, point, "role"], "left").na.fill(0, ["votes"])
    return scores(every)


def points_hit(pixels: DataFrame, regions: DataFrame, keys: list[str], point: str) -> DataFrame:
    """Distinct points of each region, and their sum."""
    return joins.in_boxes(pixels, regions, keys).groupBy(*keys, "region").agg(F.countDistinct(point).alias("n_points"))


def candidate_votes(selections: DataFrame, keys: list[str]) -> DataFrame:
    """keys, candidate_id, selected, uncertain, mean_confidence over views (keys, view, candidate_id, kind, confidence)."""
    chosen = F.col("kind") == "selected"
    return selections.groupBy(*keys, "candidate_id").agg(
        F.count(F.when(chosen, 1)).alias("selected"),
        F.count(F.when(F.col("kind") == "uncertain", 1)).alias("uncertain"),
        (F.coalesce(F.sum(F.when(chosen, F.col("confidence"))), F.lit(0.0)) / F.greatest(F.lit(1), F.count(F.when(chosen, 1)))).alias("mean_confidence"),
    )


def vote_order() -> list[Column]:
    """Selected votes, mean confidence, uncertain votes, all falling; then the id."""
    return [F.col("selected").desc(), F.col("mean_confidence").desc(), F.col("uncertain").desc(), F.col("candidate_id")]


def most_common(items: DataFrame, keys: list[str], item: str, seq: str, k: int | None = None) -> DataFrame:
    """keys, item, votes, first_seen, place: counts in falling order, first seen first."""
    from pyspark.sql import Window

    d = items.groupBy(*keys, item).agg(F.count("*").alias("votes"), F.min(seq).alias("first_seen"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    d = d.withColumn("place", F.row_number().over(w.orderBy(F.col("votes").desc(), "first_seen")))
    return d if k is None else d.filter(F.col("place") <= k)


def combine_plans(plans: DataFrame, keys: list[str], seq: str, lists: list[str]) -> DataFrame:
    """keys, field, item, votes, place of the lists of each view's plan, and each key's mean confidence."""
    stacked = None
    for name in lists:
        part = plans.select(*keys, seq, F.lit(name).alias("field"), F.posexplode(name).alias("pos", "item"))
        stacked = part if stacked is None else stacked.unionByName(part)
    ranked = most_common(stacked.withColumn("__at", F.struct(seq, "pos")), [*keys, "field"], "item", "__at").drop("first_seen")
    mean = plans.groupBy(*keys).agg(F.avg("confidence").alias("mean_confidence"), F.count("*").alias("views"))
    return ranked.join(mean, keys)


def fuse(votes: DataFrame, least_score: float, least_visible: int = 1) -> DataFrame:
    """Points whose score and sight reach the thresholds."""
    return votes.filter((F.col("score") >= least_score) & (F.col("visible") >= least_visible))


def mask_union(candidate_points: DataFrame, chosen: DataFrame, keys: list[str], point: str) -> DataFrame:
    """Distinct points of the chosen candidates."""
    return candidate_points.join(chosen.select(*keys, "candidate_id").distinct(), [*keys, "candidate_id"], "left_semi").select(*keys, point).distinct()


def supplement(proposals: DataFrame, pixels: DataFrame, keys: list[str], view: str, point: str, name: Column, groups: int) -> DataFrame:
    """keys, slug, point: missing regions with one slug joined over views, the first ``groups`` slugs by first sight."""
    d = proposals.withColumn("slug", name)
    order = most_common(d, keys, "slug", "seq").groupBy(*keys, "slug").agg(F.min("first_seen").alias("first_seen"))
    from pyspark.sql import Window

    top = order.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("first_seen"))).filter(F.col("__n") <= groups).select(*keys, "slug", "first_seen")
    hit = joins.in_boxes(pixels, d, [*keys, view]).select(*keys, "slug", point).distinct()
    return hit.join(top, [*keys, "slug"])


def best_mask(masks: DataFrame, keys: list[str], mask: str, score: str) -> DataFrame:
    """keys, mask, score of the best mask of each prompt; of equal scores the first."""
    best = masks.groupBy(*keys).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(mask).alias("m"))).alias("b"))
    return best.select(*keys, F.col("b.m").alias(mask), (-F.col("b.s")).alias(score))
