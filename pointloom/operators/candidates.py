"""Candidate regions of an object: families of masks emitted in order, gated, deduplicated, ranked.

Whether a candidate is kept depends on those kept before it and components
depend on scan order, so one object is one grouped task; objects are bounded by
their point count. Neighbours and local features are the engine's own
(``geometry.knn``, ``geometry.local_pca``) and reach the task as arrays. A
family is a ``Draft``: what it is called, its mask, the largest share of the
points that it may take, its priority, and the group within which near-equal
masks collapse and ranks are given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom import constants as c
from pointloom.functions import text
from pointloom.operators import geometry, windows


@dataclass(frozen=True)
class Settings:
    neighbours: int = 24
    hops: int = 1
    least_points: int = 4
    most_share: float = 0.60
    most_candidates: int = 36
    overlap: float = 0.88
    components: int = 8
    per_group: int = 5
    small_share: float = 0.10
    source_share: float = 0.65
    executor: str = "hook"


#: Defaults of each way to generate (fixed values).
STANDARD = Settings()
HIGH_RECALL = Settings(most_share=0.70, most_candidates=64, overlap=0.985, components=5)
GROWTH = Settings(most_share=0.45, overlap=0.90, components=6)


@dataclass(frozen=True)
class Draft:
    family: str
    name: str
    mask: np.ndarray
    most: float
    priority: float
    group: str = ""


class Cloud:
    """One object's points with the neighbours and features that the engine worked out."""

    def __init__(self, xyz: np.ndarray, near: list[np.ndarray], features: np.ndarray):
        self.xyz, self.n, self.near = xyz, len(xyz), near
        self.curvature, self.linearity, self.planarity = features.T

    def reach(self, mask: np.ndarray) -> np.ndarray:
        out = mask.copy()
        for i in np.flatnonzero(mask):
            out[self.near[i]] = True
        return out

    def grow(self, mask: np.ndarray, hops: int, allowed: np.ndarray | None = None) -> np.ndarray:
        out = mask if allowed is None else mask & allowed
        for _ in range(hops):
            step = self.reach(out)
            out = step if allowed is None else step & allowed
        return out

    def parts(self, mask: np.ndarray, least: int, most: float) -> list[np.ndarray]:
        """Components in scan order along out-edges inside the mask, largest first."""
        taken, found = np.zeros(self.n, bool), []
        for start in np.flatnonzero(mask):
            if taken[start]:
                continue
            taken[start], members, at = True, [start], 0
            while at < len(members):
                for b in self.near[members[at]]:
                    if mask[b] and not taken[b]:
                        taken[b] = True
                        members.append(b)
                at += 1
            if least <= len(members) <= most:
                part = np.zeros(self.n, bool)
                part[members] = True
                found.append(part)
        return sorted(found, key=lambda p: -int(p.sum()))

    def extent(self, mask: np.ndarray) -> np.ndarray:
        return np.ptp(self.xyz[mask], axis=0) / (np.ptp(self.xyz, axis=0) + 1e-8) if mask.any() else np.zeros(3)


Emitted = Iterator[Draft]


def _quantile(v: np.ndarray, q: float, low: bool) -> np.ndarray:
    bound = np.quantile(v, q)
    return v <= bound if low else v >= bound


def _pair(cloud: Cloud, parts: list[np.ndarray], s: Settings) -> np.ndarray | None:
    """The two best parts together, each grown: large ones, and rounder ones by 20 a point."""
    best = []
    for p in parts:
        grown = cloud.grow(p, s.hops)
        if grown.sum() <= int(0.35 * cloud.n):
            sides = np.sort(cloud.extent(p))
            best.append((int(p.sum()) + 20 * max(0.0, 4 - min(4.0, sides[2] / (sides[1] + 1e-8))), grown))
    best.sort(key=lambda x: -x[0])
    return best[0][1] | best[1][1] if len(best) > 1 else None


def standard_families(cloud: Cloud, seeds: dict[str, np.ndarray], s: Settings) -> Emitted:
    """Drafts in the order in which candidates are tried."""
    most = s.most_share
    # fixed values: shares and priorities of each family
    for seed, p, grown_share, share in (("visual_detached_structure", 8, 0.36, 0.30), ("visual_detached_component", 9, 0.40, 0.35), ("visual_small_component", 14, 0.40, 0.35)):
        if seed in seeds:
            yield Draft("visual_component_expanded", f"{seed}_expanded", cloud.grow(seeds[seed], s.hops), min(most, grown_share), p)
            yield Draft(seed, seed, seeds[seed], min(most, share), p + 4)
    for name in sorted(k for k in seeds if k.startswith("weak_")):
        yield Draft("expanded_existing_weak_mask", f"{name}_expanded", cloud.grow(seeds[name], s.hops), most, 28)
        yield Draft("existing_weak_mask", name, seeds[name], most, 34)
    smooth, flat = _quantile(cloud.curvature, 0.35, True), _quantile(cloud.planarity, 0.60, False)
    sharp, line = _quantile(cloud.curvature, 0.82, False), _quantile(cloud.linearity, 0.82, False)
    edge = sharp | line
    parts = cloud.parts(edge, max(s.least_points, 8), 0.35 * cloud.n)
    for i, p in enumerate(parts[: s.components]):
        yield Draft("expanded_loop_or_handle", f"loop_{i}_expanded", cloud.grow(p, s.hops), min(most, 0.42), 20 + 0.1 * i)
        yield Draft("loop_or_hole_boundary", f"loop_{i}", p, min(most, 0.35), 44 + 0.1 * i)
    pair = _pair(cloud, parts, s)
    if pair is not None:
        yield Draft("paired_loop_or_handle", "paired", pair, min(most, 0.55), 16)
    for low_q, high_q, family, share, p in ((0.5, 0.5, "expanded_axis_part_component", 0.34, 36), (0.18, 0.82, "expanded_extreme_part_component", 0.32, 22)):
        for a in range(3):
            v = cloud.xyz[:, a]
            for j, side in enumerate((v <= np.quantile(v, low_q), v >= np.quantile(v, high_q))):
                yield Draft(family, f"{family}_{'xyz'[a]}{j}", cloud.grow(edge & side, s.hops), min(most, share), p + 0.2 * a + 0.1 * j)
    yield Draft("expanded_functional_seed", "functional", cloud.grow(edge, s.hops), min(most, 0.62), 32)
    yield Draft("smooth_surface", "smooth", smooth & flat, most, 55)
    yield Draft("edge_or_boundary", "sharp", sharp, most, 48)
    yield Draft("thin_structure", "line", line, most, 49)
    for a in range(3):
        v = cloud.xyz[:, a]
        for j, side in enumerate((v <= np.quantile(v, 0.12), v >= np.quantile(v, 0.88))):
            name = f"{'xyz'[a]}{j}"
            yield Draft("smooth_extreme_patch", f"patch_{name}", side & smooth & flat, most, 60)
            yield Draft("extreme_edge_or_lip", f"lip_{name}", side & sharp, most, 52)
            yield Draft("protruding_or_thin_part", f"thin_{name}", side & line, most, 53)
    ends = np.any([(cloud.xyz[:, a] >= np.quantile(cloud.xyz[:, a], 0.93)) | (cloud.xyz[:, a] <= np.quantile(cloud.xyz[:, a], 0.07)) for a in range(3)], axis=0)
    yield Draft("small_protrusion", "protrusion", ends & sharp, most, 42)
    yield Draft("central_body", "body", np.all([(cloud.xyz[:, a] >= np.quantile(cloud.xyz[:, a], 0.2)) & (cloud.xyz[:, a] <= np.quantile(cloud.xyz[:, a], 0.8)) for a in range(3)], axis=0), most, 80)


def _admitted(cloud: Cloud, drafts: Iterator[Draft], s: Settings, within_group: bool) -> list[Draft]:
    """Drafts of a fitting size that no earlier one of them (of the same group) nearly equals."""
    kept: list[Draft] = []
    for d in drafts:
        count = int(d.mask.sum())
        if count < s.least_points or count > int(cloud.n * d.most):
            continue
        rivals = [k for k in kept if not within_group or k.group == d.group]
        if any((k.mask & d.mask).sum() / (k.mask | d.mask).sum() >= s.overlap for k in rivals):
            continue
        kept.append(d)
    return kept


def _by_priority(drafts: list[Draft]) -> list[Draft]:
    return sorted(drafts, key=lambda d: (d.priority, -int(d.mask.sum())))


#: Component families: name, family, group, thresholds, most share, priority, whether seeds are tried too (fixed values).
_PART_FAMILIES = (
    ("loop_handle_or_lip_loose", "loop_handle_lip_seed", "loop_handle_lip", "loose", 0.50, 20.0, True),
    ("loop_handle_or_lip_strict", "strict_loop_handle_lip_seed", "loop_handle_lip_strict", "strict", 0.38, 24.0, True),
    ("smooth_panel_or_surface", "smooth_surface_component", "smooth_panel_surface", "smooth", 0.65, 38.0, False),
    ("small_button_knob_joint", "small_part_seed", "small_part", "small", None, 16.0, True),
)


def high_recall_families(cloud: Cloud, seeds: dict[str, np.ndarray], s: Settings) -> Emitted:
    """The standard candidates as a base, then axis bands, views, priors, component families, small parts and a pair."""
    wide = max(s.most_share, 0.82)
    base = replace(STANDARD, most_share=s.most_share, least_points=s.least_points, most_candidates=s.most_candidates)
    for d in _by_priority(_admitted(cloud, standard_families(cloud, seeds, base), base, False))[: base.most_candidates]:
        yield replace(d, name=f"baseline_{d.name}", most=wide, group=f"baseline_{d.family}")
    for a, axis in enumerate("xyz"):
        v = cloud.xyz[:, a]
        q = np.quantile(v, [0, 0.34, 0.67, 1])
        for j in (1, 2, 3):
            yield Draft("coarse_axis_partition", f"coarse_axis_{axis}_band_{j}", (v >= q[j - 1]) & (v <= q[j]), 0.70, 70.0 + a + 0.01 * j, f"coarse_partition_{axis}")
    for name in [k for k in ("visual_detached_structure", "visual_detached_component", "visual_small_component") if k in seeds]:
        yield Draft("visual_component_expanded", f"{name}_expanded", cloud.grow(seeds[name], s.hops), 0.55, 12.0, "visual_partial_component")
        yield Draft("visual_component_seed", name, seeds[name], 0.45, 28.0, "visual_partial_component_seed")
    for name in [f"weak_{e}" for e in c.EXECUTORS if f"weak_{e}" in seeds]:
        yield Draft("expanded_existing_weak_mask", f"{name}_prior_expanded", cloud.grow(seeds[name], max(1, s.hops)), wide, 18.0, "weak_mask_prior")
        yield Draft("existing_weak_mask", f"{name}_prior_seed", seeds[name], wide, 34.0, "weak_mask_prior_seed")
    sharp = {q: _quantile(cloud.curvature, q, False) for q in (0.70, 0.88)}
    line = {q: _quantile(cloud.linearity, q, False) for q in (0.70, 0.88)}
    ends = np.any([_quantile(cloud.xyz[:, a], 0.10, True) | _quantile(cloud.xyz[:, a], 0.90, False) for a in range(3)], axis=0)
    masks = {
        "loose": sharp[0.70] | line[0.70], "strict": sharp[0.88] | line[0.88],
        "smooth": _quantile(cloud.curvature, 0.45, True) & _quantile(cloud.planarity, 0.55, False), "small": (ends & sharp[0.70]) | sharp[0.88],
    }

    def parts(mask: np.ndarray, share: float) -> list[np.ndarray]:
        return cloud.parts(mask, max(1, s.least_points), max(s.least_points, int(cloud.n * share)))

    for name, family, group, which, share, priority, with_seed in _PART_FAMILIES:
        share = max(s.small_share, 0.03) if share is None else share
        for i, part in enumerate(parts(masks[which], share)[: s.per_group], 1):
            yield Draft(f"expanded_{family}", f"{name}_{i:02d}_expanded", cloud.grow(part, s.hops), share, priority + 0.01 * i, group)
            if with_seed:
                yield Draft(family, f"{name}_{i:02d}_seed", part, share, priority + 12.0 + 0.01 * i, f"{group}_seed")
    pair = parts(masks["loose"], 0.40)[:2]
    if len(pair) == 2:
        yield Draft("paired_loop_handle_candidate", "paired_loop_handle_or_ring_components", cloud.grow(pair[0], s.hops) | cloud.grow(pair[1], s.hops), 0.60, 14.0, "paired_parts")


def growth_families(cloud: Cloud, seeds: dict[str, np.ndarray], s: Settings) -> Emitted:
    """Growth from ``target`` that stays clear of ``veto``, with the executor's own mask (``weak_<executor>``) as another source."""
    none = np.zeros(cloud.n, bool)
    allowed = ~seeds.get("veto", none)
    clean = seeds.get("target", none) & allowed
    found = cloud.parts(clean, 1, cloud.n)[: max(1, s.components)]
    if clean.any():
        yield Draft("semantic_target_union", "target_seed_union_reject_aware_expanded", cloud.grow(clean, s.hops, allowed), s.most_share, 20.0)
        yield Draft("semantic_target_core", "target_seed_core_without_reject", clean, s.most_share, 30.0)
    source = seeds.get(f"weak_{s.executor}", none) & allowed
    if source.any():
        wider = max(1, s.hops)
        yield Draft("source_weak_mask_fallback", "source_executor_mask_reject_aware_expanded", cloud.grow(source, wider, allowed), s.source_share, 7.0)
        yield Draft("source_weak_mask_core", "source_executor_mask_core_without_reject", source, s.source_share, 17.0)
        for i, part in enumerate(cloud.parts(source, 1, cloud.n)[: max(1, s.components)], 1):
            yield Draft("source_weak_mask_component_expanded", f"source_mask_component_{i:02d}_expanded", cloud.grow(part, wider, allowed), s.source_share, 9.0 + 0.1 * i)
    for i, part in enumerate(found, 1):
        yield Draft("semantic_target_component_expanded", f"target_component_{i:02d}_expanded", cloud.grow(part, s.hops, allowed), s.most_share, 8.0 + 0.1 * i)
        yield Draft("semantic_target_component_core", f"target_component_{i:02d}_core", part, s.most_share, 18.0 + 0.1 * i)
    if len(found) > 1 and s.executor in ("hook", "gripper", "dexterous_hand"):
        both = cloud.grow(found[0], s.hops, allowed) | cloud.grow(found[1], s.hops, allowed)
        yield Draft("semantic_paired_target_components", "paired_target_components_reject_aware", both, min(s.most_share, 0.60), 6.0)


FAMILIES: dict[str, Callable[[Cloud, dict[str, np.ndarray], Settings], Emitted]] = {
    "standard": standard_families, "high_recall": high_recall_families, "growth": growth_families,
}
DEFAULTS = {"standard": STANDARD, "high_recall": HIGH_RECALL, "growth": GROWTH}


def generate(points: DataFrame, obj: str, point: str, kind: str = "standard", settings: Settings | None = None) -> DataFrame:
    """obj, ord, family, name, part_group, priority, point_count, point_fraction, extent, points of each object's candidates.

    ``points`` has x, y, z and, if wanted, ``seeds``: an array of seed names of
    each point (weak_<executor>, visual_*, target, veto). Objects without
    candidates give no row.
    """
    families, s = FAMILIES[kind], settings or DEFAULTS[kind]
    if "seeds" not in points.columns:
        points = points.withColumn("seeds", F.array().cast("array<string>"))
    kinds = dict(points.dtypes)
    graph = geometry.knn(points, obj, point, s.neighbours)
    near = graph.groupBy(obj, F.col("src").alias(point)).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "dst"))), lambda e: e["dst"]).alias("near"))
    shape = geometry.local_pca(points, graph, obj, point).select(obj, F.col("src").alias(point), "curvature", "linearity", "planarity")
    every = points.select(obj, point, "x", "y", "z", "seeds").join(near, [obj, point], "left").join(shape, [obj, point], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(point)
        ids = pdf[point].to_numpy()
        place = [np.zeros(0, np.int64) if v is None else np.searchsorted(ids, np.asarray(v)) for v in pdf["near"]]
        cloud = Cloud(pdf[["x", "y", "z"]].to_numpy(dtype=np.float64), place, pdf[["curvature", "linearity", "planarity"]].fillna(0.0).to_numpy(dtype=np.float64))
        names = sorted({n for row in pdf["seeds"] if row is not None for n in row})
        seeds = {n: np.array([row is not None and n in row for row in pdf["seeds"]]) for n in names}
        rows = [
            (pdf[obj].iloc[0], i, d.family, d.name, d.group, float(d.priority), int(d.mask.sum()), d.mask.sum() / cloud.n, cloud.extent(d.mask).tolist(), ids[d.mask].tolist())
            for i, d in enumerate(_admitted(cloud, families(cloud, seeds, s), s, kind == "high_recall"))
        ]
        return pd.DataFrame(rows, columns=[obj, "ord", "family", "name", "part_group", "priority", "point_count", "point_fraction", "extent", "points"])

    schema = f"{obj} {kinds[obj]}, ord int, family string, name string, part_group string, priority double, point_count long, point_fraction double, extent array<double>, points array<{kinds[point]}>"
    return every.groupBy(obj).applyInPandas(run, schema)


def rank(candidates: DataFrame, obj: str, most: int | None = None) -> DataFrame:
    """Adds place (priority, then larger first) and the candidate's label; cut at ``most``."""
    d = windows.ranked(candidates, [obj], [F.col("priority"), F.col("point_count").desc(), F.col("ord")])
    d = d if most is None else d.filter(F.col("place") <= most)
    return d.withColumn("candidate_id", text.candidate_label_numbered((F.col("place") - 1).cast("int")))


def rank_high_recall(candidates: DataFrame, obj: str, per_group: int = HIGH_RECALL.per_group, most: int = HIGH_RECALL.most_candidates) -> DataFrame:
    d = windows.topk_then_fill(candidates, obj, "part_group", "priority", "point_count", "ord", per_group, most)
    return d.withColumn("candidate_id", text.candidate_label((F.col("place") - 1).cast("int")))


def growth_defaults(ranked: DataFrame, obj: str) -> DataFrame:
    """obj, candidate_id, place of the candidates that start selected: the pair, else three grown components, else the first."""
    paired, grown = F.col("family") == "semantic_paired_target_components", F.col("family") == "semantic_target_component_expanded"
    d = windows.ranked(ranked.withColumn("__grown", grown), [obj, "__grown"], [F.col("place")], "__nth")
    has = ranked.groupBy(obj).agg(F.max(paired).alias("__pair"), F.max(grown).alias("__any"))
    d = d.join(has, obj)
    keep = F.when(F.col("__pair"), paired).when(F.col("__any"), F.col("__grown") & (F.col("__nth") <= 3)).otherwise(F.col("place") == 1)
    return d.filter(keep).select(obj, "candidate_id", "place")


def point_scores(candidates: DataFrame, scores: DataFrame, keys: list[str], point: str) -> DataFrame:
    """keys, candidate_id, mean_target_score, max_reject_score over a candidate's points; points without a score count 0.

    ``candidates`` has an array ``points``, ``scores`` (keys, point, target_score, reject_score).
    """
    d = candidates.select(*keys, "candidate_id", F.explode("points").alias(point)).join(scores, [*keys, point], "left")
    zero = F.lit(0.0)
    return d.groupBy(*keys, "candidate_id").agg(F.avg(F.coalesce("target_score", zero)).alias("mean_target_score"), F.max(F.coalesce("reject_score", zero)).alias("max_reject_score"))


def prepend(new: DataFrame, old: DataFrame, keys: list[str], order: str = "place") -> DataFrame:
    """``new`` candidates before ``old`` ones, numbered anew; new ones start selected."""
    both = new.withColumn("__late", F.lit(0)).unionByName(old.withColumn("__late", F.lit(1)), allowMissingColumns=True)
    d = windows.ranked(both, keys, [F.col("__late"), F.col(order)], "__place")
    return d.withColumns({order: F.col("__place"), "starts_selected": F.col("__late") == 0}).drop("__late", "__place")


def parts_from_labels(labels: DataFrame, obj: str, point: str, least: int) -> DataFrame:
    """Masks of an outside segmentation: one a (sem, inst) pair, label -1 left out, ranked by score, then size."""
    d = labels.filter("sem <> -1").groupBy(obj, "sem", "inst").agg(F.count("*").alias("point_count"), F.max(F.coalesce("score", F.lit(0.0))).alias("score"), F.sort_array(F.collect_list(point)).alias("points"))
    return windows.ranked(d.filter(F.col("point_count") >= least), [obj], [F.col("score").desc(), F.col("point_count").desc(), F.col("sem"), F.col("inst")])


def masks_from_labels(labels: DataFrame, obj: str, point: str) -> DataFrame:
    """obj, part, point of label vectors (semantic label, instance or null): one part a pair, -1 left out."""
    named = F.concat_ws("_", F.col("sem").cast("string"), F.col("inst").cast("string"))
    return labels.filter("sem <> -1 AND coalesce(inst, 0) <> -1").select(obj, named.alias("part"), point)


def oriented(rows: int, columns: int, n_points: int) -> str:
    """Whether an array's masks lie in its rows or its columns; a shape that fits neither is an error."""
    if columns == n_points:
        return "rows"
    if rows == n_points:
        return "columns"
    raise ValueError(f"{rows} x {columns}: no side has {n_points} points")


def with_provenance(records: DataFrame, backend: str) -> DataFrame:
    """Records with where they come from, and defaults where a field is blank."""
    blank = lambda k, v: F.coalesce(text.blank_to_null(F.col(k).cast("string")), F.lit(v)) if k in records.columns else F.lit(v)
    return records.withColumns({"provenance": F.lit(backend), "source": blank("source", backend), "quality_hint": blank("quality_hint", "external_part"), "confidence_hint": blank("confidence_hint", "medium"), "need_review": F.lit(True)})


def with_fallback(made: DataFrame, objects: DataFrame, fallback: DataFrame, obj: str) -> DataFrame:
    """Candidates of a backend, and the fallback's for objects that it gave none; ``from_fallback`` says which."""
    bare = objects.select(obj).distinct().join(made.select(obj).distinct(), obj, "left_anti")
    return made.withColumn("from_fallback", F.lit(False)).unionByName(fallback.join(bare, obj, "left_semi").withColumn("from_fallback", F.lit(True)), allowMissingColumns=True)
