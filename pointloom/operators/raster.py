"""Views of point clouds and pixel operators. Pixels are rows (px, py); what is not there is background."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators import joins, windows

_NAMED = {"front": (0, 0), "back": (180, 0), "left": (90, 0), "right": (-90, 0), "top": (0, 90), "bottom": (0, -90), "iso": (45, 30)}


def view_matrix(name: str) -> list[float]:
    """Nine entries, row by row, of the rotation of a view: turn about y, then tilt about x."""
    m = re.fullmatch(r"yaw(-?\d+)_elev(-?\d+)", name)
    yaw, tilt = (math.radians(float(v)) for v in (m.groups() if m else _NAMED[name]))
    turn = np.array([[math.cos(yaw), 0, math.sin(yaw)], [0, 1, 0], [-math.sin(yaw), 0, math.cos(yaw)]])
    lean = np.array([[1, 0, 0], [0, math.cos(tilt), -math.sin(tilt)], [0, math.sin(tilt), math.cos(tilt)]])
    return (lean @ turn).ravel().tolist()


def views(spark: SparkSession, names: list[str]) -> DataFrame:
    """view, r0 .. r8: as many rows as views are named."""
    return spark.createDataFrame([(n, *view_matrix(n)) for n in names], "view string, " + ", ".join(f"r{i} double" for i in range(9)))


def disc(spark: SparkSession, radius: int) -> DataFrame:
    """dx, dy of a disc."""
    r = range(-radius, radius + 1)
    return spark.createDataFrame([(x, y) for x in r for y in r if x * x + y * y <= radius * radius], "dx int, dy int")


def _offsets(radius: int) -> str:
    r = range(-radius, radius + 1)
    return "array(" + ", ".join(f"struct({x} AS dx, {y} AS dy)" for x in r for y in r if x * x + y * y <= radius * radius) + ")"


def project(points: DataFrame, view: DataFrame, obj: str, point: str, size: int, radius: int = 0) -> DataFrame:
    """obj, view, py, px, point, depth: the nearest point at each pixel.

    Points are turned, each axis is stretched to [0.08, 0.92] of the image by
    itself, y points up, rounding is half to even, points are drawn as discs,
    and the largest depth wins; of equal depths the lowest number.
    """
    d = points.join(F.broadcast(view))  # a handful of views
    d = d.select(obj, point, "view", *[F.expr(f"x * r{i} + y * r{i + 1} + z * r{i + 2}").alias(n) for i, n in ((0, "u"), (3, "v"), (6, "depth"))])
    box = d.groupBy(obj, "view").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("u", "v") for f in (F.min, F.max)])
    d = d.join(box, [obj, "view"])
    share = lambda c: f"(0.08D + 0.84D * ({c} - min_{c}) / (CASE WHEN max_{c} > min_{c} THEN max_{c} - min_{c} ELSE 1D END))"
    d = d.withColumns({"px": F.expr(f"cast(bround({share('u')} * {size - 1}, 0) AS int)"), "py": F.expr(f"cast(bround((1 - {share('v')}) * {size - 1}, 0) AS int)")})
    d = d.withColumn("o", F.explode(F.expr(_offsets(radius)))).selectExpr(obj, point, "view", "depth", "px + o.dx AS px", "py + o.dy AS py")
    d = d.filter(f"px BETWEEN 0 AND {size - 1} AND py BETWEEN 0 AND {size - 1}")
    best = d.groupBy(obj, "view", "py", "px").agg(F.min(F.struct((-F.col("depth")).alias("d"), F.col(point).alias("p"))).alias("b"))
    return best.select(obj, "view", "py", "px", F.col("b.p").alias(point), (-F.col("b.d")).alias("depth"))


def dilate(pixels: DataFrame, keys: list[str], radius: int, size: int) -> DataFrame:
    """Pixels within ``radius`` of a pixel, inside the image."""
    d = pixels.withColumn("o", F.explode(F.expr(_offsets(radius)))).selectExpr(*keys, "px + o.dx AS px", "py + o.dy AS py")
    return d.filter(f"px BETWEEN 0 AND {size - 1} AND py BETWEEN 0 AND {size - 1}").distinct()


def components_2d(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, component, px, py: 8-connected components, numbered in the order of their first pixel by row and column."""

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        at = {(y, x): -1 for y, x in zip(pdf["py"], pdf["px"], strict=True)}
        n = 0
        for start in sorted(at):
            if at[start] >= 0:
                continue
            at[start], stack = n, [start]
            while stack:
                y, x = stack.pop()
                for near in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                    if at.get(near, 0) < 0:
                        at[near] = n
                        stack.append(near)
            n += 1
        out = pd.DataFrame([(c, x, y) for (y, x), c in at.items()], columns=["component", "px", "py"]).astype("int32")
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    kinds = dict(pixels.dtypes)
    return pixels.groupBy(*keys).applyInPandas(label, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", component int, px int, py int")


def component_boxes(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Area, box and centre of each component."""
    return labelled.groupBy(*keys, "component").agg(
        F.count("*").alias("area"), F.min("px").alias("x1"), F.min("py").alias("y1"), F.max("px").alias("x2"), F.max("py").alias("y2"), F.avg("px").alias("cx"), F.avg("py").alias("cy")
    )


def union_box(pixels: DataFrame, keys: list[str], pad: int, size: int) -> DataFrame:
    d = pixels.groupBy(*keys).agg(F.min("px").alias("x1"), F.min("py").alias("y1"), F.max("px").alias("x2"), F.max("py").alias("y2"))
    return d.withColumns({c: F.greatest(F.col(c) - pad, F.lit(0)) for c in ("x1", "y1")} | {c: F.least(F.col(c) + pad, F.lit(size - 1)) for c in ("x2", "y2")})


def body_top(pixels: DataFrame, keys: list[str], share: float = 0.18, least: int = 6) -> DataFrame:
    """keys, body_top: the uppermost row that is as full as a body's: max(least, share of the fullest row, half to even)."""
    rows = pixels.groupBy(*keys, "py").agg(F.count("*").alias("n"))
    full = rows.groupBy(*keys).agg(F.max("n").alias("most"))
    d = rows.join(full, keys).filter(F.col("n") >= F.greatest(F.lit(least), F.bround(F.col("most") * F.lit(share), 0)))
    return d.groupBy(*keys).agg(F.min("py").alias("body_top"))


def above_body(pixels: DataFrame, keys: list[str], point: str, margin: int, share: float = 0.18) -> DataFrame:
    """Distinct points that are seen above the body's top."""
    d = pixels.join(body_top(pixels, keys, share), keys).filter(F.col("py") < F.col("body_top") - margin)
    return d.select(*keys, point).distinct()


def component_proposals(pixels: DataFrame, keys: list[str], view: str, point: str, totals: DataFrame, size: int, radius: int = 2, least: int = 8, most_share: float = 0.22) -> DataFrame:
    """keys, seed, point: parts that stand out in a view, united over views.

    Above each view's body, pixels are dilated and cut into components; one
    counts if it shows between ``least`` points and the whole-number share of
    all. Detached ones are small beside the largest and lie high in the image;
    small ones are much smaller than the largest.
    """
    on = [*keys, view]
    high = pixels.join(body_top(pixels, on), on).filter("py < body_top").select(*on, "px", "py").distinct()
    parts = components_2d(dilate(high, on, radius, size), on)
    boxes = component_boxes(parts, on)
    most = boxes.groupBy(*on).agg(F.max("area").alias("most"))
    shown = parts.join(pixels, [*on, "px", "py"]).select(*on, "component", point).distinct()
    n = shown.groupBy(*on, "component").agg(F.count("*").alias("n")).join(totals, keys)
    ok = n.filter((F.col("n") >= least) & (F.col("n") <= F.floor(F.col("n_points") * F.lit(most_share)))).select(*on, "component")
    d = boxes.join(most, on).join(ok, [*on, "component"])
    up = F.expr(f"area < 0.45 * most AND (cy <= {0.58 * size} OR y1 <= {0.42 * size})")
    small = F.expr("area < 0.18 * most")
    seed = F.array_compact(F.array(F.when(up, F.lit("visual_detached_component")), F.when(small, F.lit("visual_small_component"))))
    d = d.select(*on, "component", F.explode(seed).alias("seed"))
    return shown.join(d, [*on, "component"]).select(*keys, "seed", point).distinct()


def top_components(boxes: DataFrame, keys: list[str], score: str, most: int) -> DataFrame:
    """The ``most`` best components of each view; of equal scores the first."""
    return windows.ranked(boxes, keys, [F.col(score).desc(), F.col("component")]).filter(F.col("place") <= most)


def depth_colors(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """r, g, b of pixels by depth within each view: 50 to 255 from the least to the largest, 180 where all are one."""
    span = pixels.groupBy(*keys).agg(F.min("depth").alias("__lo"), F.max("depth").alias("__hi"))
    v = F.when(F.col("__hi") - F.col("__lo") < 1e-6, F.lit(180)).otherwise(F.floor((F.col("depth") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * 205 + 50)).cast("int")
    d = pixels.join(span, keys).withColumn("g", v)
    return d.withColumns({"r": F.floor(F.col("g") / 3).cast("int"), "b": 255 - F.floor(F.col("g") / 4).cast("int")}).drop("__lo", "__hi")


def in_polygons(pixels: DataFrame, polygons: DataFrame, keys: list[str], polygon: str) -> DataFrame:
    """keys, polygon, px, py of pixels inside polygons (keys, polygon, corners: array of x, y) by the even-odd rule."""
    edge = "transform(corners, (a, i) -> struct(a.x AS x1, a.y AS y1, corners[(i + 1) % size(corners)].x AS x2, corners[(i + 1) % size(corners)].y AS y2))"
    box = [f"array_{f}(transform(corners, a -> a.{k})) AS {k}{n}" for f, n in (("min", 1), ("max", 2)) for k in "xy"]
    d = joins.in_boxes(pixels, polygons.selectExpr(*keys, polygon, f"{edge} AS edges", *box), keys)
    crossed = "size(filter(edges, e -> (e.y1 > py) <> (e.y2 > py) AND px < (e.x2 - e.x1) * (py - e.y1) / (e.y2 - e.y1) + e.x1))"
    return d.filter(f"{crossed} % 2 = 1").select(*keys, polygon, "px", "py").distinct()


def component_score(upper: Column, small: Column, bonus: Column) -> Column:
    """Score of a hook component: twice if it is high, half a point if small, and a bonus."""
    return F.when(upper, 2.0).otherwise(0.0) + F.when(small, 0.5).otherwise(0.0) + bonus


def point_count(views: DataFrame, pixels: DataFrame, key: str, point: str) -> DataFrame:
    """key, n_points: the manifest's number, else the largest point that is seen plus one."""
    seen = pixels.groupBy(key).agg((F.max(point) + 1).alias("seen"))
    return views.select(key, "num_points").distinct().join(seen, key, "left").select(key, F.coalesce("num_points", "seen").alias("n_points"))
