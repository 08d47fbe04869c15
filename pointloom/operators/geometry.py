"""Point-cloud geometry over long tables: object, point, x, y, z."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def finite_rows(points: DataFrame, columns: tuple[str, ...] = XYZ) -> DataFrame:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return points.filter(ok)


def normalize(points: DataFrame, obj: str, mode: str, degenerate: str = "error") -> DataFrame:
    """Centre and scale each object.

    unit_sphere: mean centre, largest norm; unit_bbox: middle of the box,
    longest side; mid_sphere: middle of the box, largest norm. An object of no
    extent is an error, or keeps scale 1.
    """
    if mode == "none":
        return points
    centre = {c: (F.avg(c) if mode == "unit_sphere" else (F.min(c) + F.max(c)) / 2).alias(f"c{c}") for c in XYZ}
    sides = F.greatest(*[F.max(c) - F.min(c) for c in XYZ]).alias("side")
    stats = points.groupBy(obj).agg(*centre.values(), sides)
    d = points.join(stats, obj).withColumns({c: F.col(c) - F.col(f"c{c}") for c in XYZ}).drop(*[f"c{c}" for c in XYZ])
    if mode == "unit_bbox":
        d = d.withColumnRenamed("side", "scale")
    else:
        norm = d.groupBy(obj).agg(F.max(F.sqrt(F.expr("x * x + y * y + z * z"))).alias("scale"))
        d = d.drop("side").join(norm, obj)
    one = F.lit(1.0) if degenerate == "one" else F.raise_error(F.concat(F.lit("no extent: "), F.col(obj).cast("string"))).cast("double")
    scale = F.when(F.col("scale") > 0, F.col("scale")).otherwise(one)
    return d.withColumns({c: F.col(c) / scale for c in XYZ}).drop("scale")


def unit_normals(points: DataFrame) -> DataFrame:
    """Normals of length 1; those of 1e-8 or shorter become zero."""
    n = F.sqrt(F.expr("nx * nx + ny * ny + nz * nz"))
    return points.withColumns({c: F.when(n > 1e-8, F.col(c) / n).otherwise(F.lit(0.0)) for c in ("nx", "ny", "nz")})


def axis_aligned(points: DataFrame, least: float = 0.95) -> DataFrame:
    """Points whose normal lies along an axis; without normals none."""
    n = F.sqrt(F.expr("nx * nx + ny * ny + nz * nz"))
    return points.filter((n > 0) & (F.greatest(F.abs("nx"), F.abs("ny"), F.abs("nz")) / n >= least))


def seeded_sample(points: DataFrame, obj: str, point: str, n: int, seed: int) -> DataFrame:
    """``n`` points of each object, the same on every run."""
    from pyspark.sql import Window

    w = Window.partitionBy(obj).orderBy(F.xxhash64(F.lit(seed), obj, point), point)
    return points.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def quantile_bounds(values: DataFrame, keys: list[str], column: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one column each."""
    return values.groupBy(*keys).agg(*[F.percentile(column, F.lit(q)).alias(name) for name, q in quantiles.items()])


def quantile_mask(values: DataFrame, keys: list[str], column: str, q: float, side: str) -> DataFrame:
    """Rows at or beyond an object's quantile (side: "low" or "high")."""
    d = values.join(quantile_bounds(values, keys, column, {"__q": q}), keys)
    return d.filter(F.col(column) <= F.col("__q") if side == "low" else F.col(column) >= F.col("__q")).drop("__q")


def extent_ratio(part: DataFrame, whole: DataFrame, obj: str, item: str) -> DataFrame:
    """Sides of each item's box over those of its object's box, per axis; 0 for an item without points."""
    a = whole.groupBy(obj).agg(*[(F.max(c) - F.min(c)).alias(f"w{c}") for c in XYZ])
    b = part.groupBy(obj, item).agg(*[(F.max(c) - F.min(c)).alias(f"p{c}") for c in XYZ])
    return b.join(a, obj).select(obj, item, *[(F.coalesce(f"p{c}", F.lit(0.0)) / (F.col(f"w{c}") + 1e-8)).alias(f"extent_{c}") for c in XYZ])


def knn(points: DataFrame, obj: str, point: str, k: int) -> DataFrame:
    """obj, src, rank, dst, d2: the ``k`` nearest other points of each point; ties go to the lower number.

    A point has as many neighbours as its object has others, if those are
    fewer. Distances are worked out in blocks of rows, so memory is bounded by
    block times object, and each object by itself in a grouped task.
    """
    if k < 1:
        raise ValueError("k is 1 at least")

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(point)
        ids, xyz = pdf[point].to_numpy(), pdf[list(XYZ)].to_numpy(dtype=np.float64)
        n, out = len(ids), []
        m = min(k, n - 1)
        if m < 1:
            return pd.DataFrame({obj: pdf[obj].iloc[:0], "src": ids[:0], "rank": np.zeros(0, np.int32), "dst": ids[:0], "d2": np.zeros(0)})
        step = max(1, 4_000_000 // n)
        for at in range(0, n, step):
            diff = xyz[at : at + step, None, :] - xyz[None]
            d2 = diff[..., 0] ** 2 + diff[..., 1] ** 2 + diff[..., 2] ** 2
            d2[np.arange(len(d2)), np.arange(at, at + len(d2))] = np.inf
            # a stable sort keeps the order of ids in ties
            order = np.argsort(d2, axis=1, kind="stable")[:, :m]
            out.append(pd.DataFrame({
                "src": np.repeat(ids[at : at + step], m), "rank": np.tile(np.arange(1, m + 1, dtype=np.int32), len(d2)),
                "dst": ids[order.ravel()], "d2": np.take_along_axis(d2, order, 1).ravel(),
            }))
        found = pd.concat(out)
        found.insert(0, obj, pdf[obj].iloc[0])
        return found

    kinds = dict(points.dtypes)
    schema = f"{obj} {kinds[obj]}, src {kinds[point]}, rank int, dst {kinds[point]}, d2 double"
    return points.select(obj, point, *XYZ).groupBy(obj).applyInPandas(near, schema)


def knn_join(points: DataFrame, obj: str, point: str, k: int) -> DataFrame:
    """The same by a self-join and a ranked window, without Python; for objects of a few hundred points."""
    from pyspark.sql import Window

    a = points.select(obj, F.col(point).alias("src"), *[F.col(c).alias(f"a{c}") for c in XYZ])
    b = points.select(obj, F.col(point).alias("dst"), *[F.col(c).alias(f"b{c}") for c in XYZ])
    d2 = F.expr("(ax - bx) * (ax - bx) + (ay - by) * (ay - by) + (az - bz) * (az - bz)")
    d = a.join(b, obj).filter("src <> dst").select(obj, "src", "dst", d2.alias("d2"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(obj, "src").orderBy("d2", "dst"))).filter(F.col("rank") <= k).select(obj, "src", "rank", "dst", "d2")


def covariance(graph: DataFrame, points: DataFrame, obj: str, point: str) -> DataFrame:
    """Sample covariance of each point's neighbours: cxx, cxy, cxz, cyy, cyz, czz."""
    p = points.select(obj, F.col(point).alias("dst"), *XYZ)
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    d = graph.join(p, [obj, "dst"]).groupBy(obj, "src").agg(*[F.covar_samp(a, b).alias(f"c{a}{b}") for a, b in pairs])
    return d.na.fill(0.0, [f"c{a}{b}" for a, b in pairs])


def eigenvalues(df: DataFrame) -> DataFrame:
    """l0 <= l1 <= l2 of the symmetric matrix in cxx .. czz, in closed form."""
    q = F.expr("(cxx + cyy + czz) / 3")
    d = df.withColumn("__q", q)
    p2 = F.expr("(cxx - __q) * (cxx - __q) + (cyy - __q) * (cyy - __q) + (czz - __q) * (czz - __q) + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)")
    d = d.withColumn("__p", F.sqrt(p2 / 6))
    det = F.expr(
        "((cxx - __q) * ((cyy - __q) * (czz - __q) - cyz * cyz) - cxy * (cxy * (czz - __q) - cyz * cxz) + cxz * (cxy * cyz - (cyy - __q) * cxz)) / (2 * __p * __p * __p)"
    )
    d = d.withColumn("__phi", F.when(F.col("__p") > 0, F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), det))) / 3).otherwise(F.lit(0.0)))
    d = d.withColumns({"l2": F.expr("__q + 2 * __p * cos(__phi)"), "l0": F.expr("__q + 2 * __p * cos(__phi + 2 * pi() / 3)")})
    return d.withColumn("l1", F.expr("3 * __q - l0 - l2")).drop("__q", "__p", "__phi")


def shape_features(eigen: DataFrame) -> DataFrame:
    """curvature, linearity and planarity from l0 <= l1 <= l2."""
    return eigen.withColumns({
        "curvature": F.expr("l0 / (l0 + l1 + l2 + 1e-8)"),
        "linearity": F.expr("(l2 - l1) / (l2 + 1e-8)"),
        "planarity": F.expr("(l1 - l0) / (l2 + 1e-8)"),
    })


def normal_of(eigen: DataFrame) -> DataFrame:
    """nx, ny, nz: eigenvector of l0, the longest cross product of two rows of (C - l0 I); zero if there is none."""
    rows = [("cxx - l0", "cxy", "cxz"), ("cxy", "cyy - l0", "cyz"), ("cxz", "cyz", "czz - l0")]

    def cross(a: tuple[str, ...], b: tuple[str, ...]) -> str:
        x, y, z = (f"(({a[i]}) * ({b[j]}) - ({a[j]}) * ({b[i]}))" for i, j in ((1, 2), (2, 0), (0, 1)))
        return f"struct({x} * {x} + {y} * {y} + {z} * {z} AS n, {x} AS x, {y} AS y, {z} AS z)"

    best = f"array_max(array({cross(rows[0], rows[1])}, {cross(rows[0], rows[2])}, {cross(rows[1], rows[2])}))"
    d = eigen.withColumn("__v", F.expr(best))
    return d.withColumns({f"n{c}": F.expr(f"CASE WHEN __v.n > 0 THEN __v.{c} / sqrt(__v.n) ELSE 0D END") for c in XYZ}).drop("__v")


def local_pca(points: DataFrame, graph: DataFrame, obj: str, point: str) -> DataFrame:
    """Eigenvalues, shape features and normal of each point's neighbourhood; no Python."""
    return normal_of(shape_features(eigenvalues(covariance(graph, points, obj, point))))


def area_gate(points: DataFrame, keys: list[str], totals: DataFrame, total_keys: list[str], least: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Rows of groups with ``least`` points or more and a share of the total within [low, high]."""
    n = points.groupBy(*keys).agg(F.count("*").alias("__n")).join(totals.select(*total_keys, F.col("n_points").alias("__t")), total_keys)
    ok = n.filter((F.col("__n") >= least) & (F.col("__n") / F.col("__t") <= high) & (F.col("__n") / F.col("__t") >= low)).select(*keys)
    return points.join(ok, keys, "left_semi")


def size_ok(count: Column, n: Column, least: int, share: float) -> Column:
    """Candidates' gate: the upper bound is a whole number, rounded down."""
    return (count >= least) & (count <= F.floor(n * F.lit(share)))
