"""Joins by meaning: overlays, strict joins, checks both ways, rule lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom import constants as c
from pointloom.operators import windows

#: Side of the tiles by which pixels meet boxes and points.
TILE = 16


def executor_dim(spark: SparkSession) -> DataFrame:
    """executor, channel: four rows."""
    return spark.createDataFrame([(e, i) for i, e in enumerate(c.EXECUTORS)], "executor string, channel int")


def task_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, i) for i, t in enumerate(c.TASKS)], "task string, task_no int")


def overlay(base: DataFrame, over: DataFrame, keys: list[str], fields: list[str], seq: str | None = None) -> DataFrame:
    """``base`` with ``fields`` from ``over`` where those are not blank; of rows of ``over`` with one key the last by ``seq`` counts."""
    o = windows.last_wins(over.select(*keys, seq, *fields), keys, seq) if seq else over
    o = o.select(*keys, *[F.col(f).alias(f"__{f}") for f in fields])
    d = base.join(o, keys, "left")
    fresh = {f: F.coalesce(F.when(F.trim(F.col(f"__{f}").cast("string")) != "", F.col(f"__{f}")), F.col(f)) for f in fields}
    return d.withColumns(fresh).drop(*[f"__{f}" for f in fields])


def strict_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join that fails if a left row finds no partner."""
    marked = right.withColumn("__there", F.lit(True))
    d = left.join(marked, keys, "left")
    miss = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return d.filter(F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("no partner for "), miss)).cast("boolean")).otherwise(F.lit(True))).drop("__there")


def both_ways(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side: keys that only one side has ("missing" on the right, "extra" there)."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def compatible(category: Column, task: Column) -> Column:
    """Whether a task makes sense on a category; a small fixed table, so an expression."""
    out = F.lit(True)
    for t, allowed in c.TASK_CATEGORIES.items():
        out = F.when((task == t) & ~F.coalesce(category.isin(*allowed), F.lit(False)), F.lit(False)).otherwise(out)
    return out


def mismatch_reason(category: Column, task: Column) -> Column:
    return F.when(~compatible(category, task), F.concat(F.lit("common_sense_object_task_mismatch:"), category, F.lit(":"), task)).otherwise(F.lit(""))


def category_prior(category: Column, keys: list[str]) -> Column:
    """The first key that the lower-case category contains, else null."""
    out = F.lit(None).cast("string")
    for k in reversed(keys):
        out = F.when(F.contains(F.lower(category), F.lit(k)), F.lit(k)).otherwise(out)
    return out


def category_priors(category: Column, executor: Column, task: Column, priors: dict[str, dict[str, list[str]]]) -> Column:
    """Entry of the first prior whose key the category contains: the executor's, else the task's, else none."""
    out = F.array().cast("array<string>")
    for key, entries in reversed(priors.items()):
        of = F.array().cast("array<string>")
        for names, who in ((c.TASKS, task), (c.EXECUTORS, executor)):
            for n in names:
                if n in entries:
                    of = F.when(who == n, F.array(*[F.lit(v) for v in entries[n]])).otherwise(of)
        out = F.when(F.contains(F.lower(category), F.lit(key)), of).otherwise(out)
    return out


def first_present(wanted: DataFrame, existing: DataFrame, key: str, path: str, rank: str) -> DataFrame:
    """Of each key's paths in order of ``rank``, the first that exists."""
    there = wanted.join(existing.select(path).distinct(), path, "left_semi")
    return there.groupBy(key).agg(F.min(F.struct(rank, path)).alias("__r")).select(key, f"__r.{path}", f"__r.{rank}")


def overlaps(points: DataFrame, partition: str, item: str, point: str) -> DataFrame:
    """partition, a, b, shared, united, iou of pairs (a < b) of items that share a point."""
    size = points.groupBy(partition, item).agg(F.count("*").alias("n"))
    a, b = points.select(partition, point, F.col(item).alias("a")), points.select(partition, point, F.col(item).alias("b"))
    d = a.join(b, [partition, point]).filter("a < b").groupBy(partition, "a", "b").agg(F.count("*").alias("shared"))
    d = d.join(size.select(partition, F.col(item).alias("a"), F.col("n").alias("na")), [partition, "a"]).join(size.select(partition, F.col(item).alias("b"), F.col("n").alias("nb")), [partition, "b"])
    return d.select(partition, "a", "b", "shared", (F.col("na") + F.col("nb") - F.col("shared")).alias("united")).withColumn("iou", F.col("shared") / F.col("united"))


def _tiled(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns({"__tx": F.floor(F.col("px") / TILE), "__ty": F.floor(F.col("py") / TILE)})


def _over_tiles(d: DataFrame, x1: str, y1: str, x2: str, y2: str) -> DataFrame:
    """A row for each tile that the rectangle touches; none for a rectangle of no extent."""
    span = lambda a, b: F.expr(f"CASE WHEN {b} >= {a} THEN sequence(floor(({a}) / {TILE}), floor(({b}) / {TILE})) ELSE array() END")
    return d.withColumn("__tx", F.explode(span(x1, x2))).withColumn("__ty", F.explode(span(y1, y2)))


def in_boxes(pixels: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels (px, py) inside boxes (x1, y1, x2, y2), both ends included; a pixel meets only boxes that touch its tile."""
    d = _tiled(pixels).join(_over_tiles(boxes, "x1", "y1", "x2", "y2"), [*keys, "__tx", "__ty"])
    return d.filter("px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2").drop("__tx", "__ty")


def in_discs(pixels: DataFrame, points: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Pixels within ``radius`` of points (x, y)."""
    d = _tiled(pixels).join(_over_tiles(points, f"x - {radius}", f"y - {radius}", f"x + {radius}", f"y + {radius}"), [*keys, "__tx", "__ty"])
    return d.filter(f"(px - x) * (px - x) + (py - y) * (py - y) <= {radius * radius}").drop("__tx", "__ty")


def snap(points: DataFrame, pixels: DataFrame, keys: list[str], point_id: str, radius: int) -> DataFrame:
    """Each point's nearest pixel within ``radius``; of equally near ones the first by row, then column."""
    d = in_discs(pixels, points, keys, radius).withColumn("d2", F.expr("(px - x) * (px - x) + (py - y) * (py - y)"))
    return d.groupBy(*keys, point_id).agg(F.min(F.struct("d2", "py", "px")).alias("n")).select(*keys, point_id, "n.px", "n.py", "n.d2")


def tighten(boxes: DataFrame, pixels: DataFrame, keys: list[str], box_id: str, margin: int) -> DataFrame:
    """Each box drawn to the pixels inside; with none inside, to those within ``margin`` of its middle; else as it is."""
    on = [*keys, box_id, "x1", "y1", "x2", "y2"]
    b = boxes.select(*on).withColumns({"mx": (F.col("x1") + F.col("x2")) / 2, "my": (F.col("y1") + F.col("y2")) / 2})
    reach = _over_tiles(b, f"least(x1, mx - {margin})", f"least(y1, my - {margin})", f"greatest(x2, mx + {margin})", f"greatest(y2, my + {margin})")
    d = _tiled(pixels).join(reach, [*keys, "__tx", "__ty"])
    inside = F.expr("px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2")
    near = F.expr(f"abs(px - mx) <= {margin} AND abs(py - my) <= {margin}")
    agg = [f(F.when(w, F.col(p))).alias(f"{n}_{p}_{f.__name__}") for n, w in (("in", inside), ("near", near)) for p in ("px", "py") for f in (F.min, F.max)]
    g = b.select(*on).join(d.groupBy(*on).agg(*agg), on, "left")
    new = {"x1": ("px", "min"), "y1": ("py", "min"), "x2": ("px", "max"), "y2": ("py", "max")}
    return g.select(*keys, box_id, *[F.coalesce(f"in_{p}_{f}", f"near_{p}_{f}", k).alias(k) for k, (p, f) in new.items()])
