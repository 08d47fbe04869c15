"""Directed neighbour graphs: bounded growth and components in scan order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand(seed: DataFrame, graph: DataFrame, obj: str, point: str, hops: int, allowed: DataFrame | None = None) -> DataFrame:
    """The seed and what out-edges reach in ``hops`` steps; with ``allowed``, seed and steps stay inside it.

    ``seed`` may have further key columns beside obj and point.
    """
    keys = [c for c in seed.columns if c != point]
    edges = graph.select(obj, F.col("src").alias(point), "dst")
    if allowed is not None:
        ok = allowed.select(obj, point).distinct()
        seed = seed.join(ok, [obj, point], "left_semi")
        edges = edges.join(ok.withColumnRenamed(point, "dst"), [obj, "dst"], "left_semi")
    reached = seed.distinct()
    for _ in range(hops):
        step = reached.join(edges, [obj, point]).select(*keys, F.col("dst").alias(point))
        reached = reached.unionByName(step).distinct()
    return reached.select(*seed.columns)


def scan_components(seed: DataFrame, graph: DataFrame, obj: str, point: str, least: int = 1, most: int | None = None, top: int | None = None) -> DataFrame:
    """obj, component, point: components that a scan of the seed's points in order finds along out-edges.

    A component is what is reachable inside the seed and not yet taken, so the
    result depends on the scan's order; it is not that of undirected
    components. Components outside [least, most] points are dropped; the rest
    is numbered by size, then by discovery, and cut at ``top``.
    """
    kinds = dict(seed.dtypes)
    inside = graph.join(seed.select(obj, F.col(point).alias("src")), [obj, "src"], "left_semi").join(seed.select(obj, F.col(point).alias("dst")), [obj, "dst"], "left_semi")
    rows = seed.select(obj, F.col(point).alias("a"), F.lit(None).cast(kinds[point]).alias("b"), F.lit(0).alias("r")).unionByName(
        inside.select(obj, F.col("src").alias("a"), F.col("dst").alias("b"), F.col("rank").alias("r"))
    )

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(pdf.loc[pdf["r"] == 0, "a"].unique())
        edges = pdf[pdf["r"] > 0].sort_values(["a", "r"])
        out = {a: g.tolist() for a, g in edges.groupby("a")["b"]}
        taken: set = set()
        found = []
        for start in nodes:
            if start in taken:
                continue
            taken.add(start)
            queue, at = [start], 0
            while at < len(queue):
                for b in out.get(queue[at], ()):
                    if b not in taken:
                        taken.add(b)
                        queue.append(int(b))
                at += 1
            if len(queue) >= least and (most is None or len(queue) <= most):
                found.append(queue)
        found.sort(key=len, reverse=True)
        rows = [(i, p) for i, members in enumerate(found[:top]) for p in sorted(members)]
        done = pd.DataFrame(rows, columns=["component", point]).astype({"component": "int32"})
        done.insert(0, obj, pdf[obj].iloc[0])
        return done

    return rows.groupBy(obj).applyInPandas(scan, f"{obj} {kinds[obj]}, component int, {point} {kinds[point]}")
