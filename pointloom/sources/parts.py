"""Outside part segmentations and object archives as long tables."""

from __future__ import annotations

import io
import json
import pickle
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators import candidates, joins

#: Where a prediction may lie below its root, first match first (fixed values).
PLACES = (
    "{pilot_id}/partslippp_candidates.npz", "{pilot_id}/segments.npz", "{pilot_id}/prediction.npz", "{pilot_id}/result.npz", "{pilot_id}/partslippp_candidates.json", "{pilot_id}/segments.json",
    "{sample_id}/{pilot_id}.npz", "{sample_id}/segments.npz", "{sample_id}/partslippp_candidates.npz", "{pilot_id}.npz", "{sample_id}_{task}_{executor}.npz", "{sample_id}.npz",
    "{pilot_id}.json", "{sample_id}_{task}_{executor}.json", "{sample_id}.json",
)


def prediction_paths(rows: DataFrame, existing: DataFrame, places: tuple[str, ...] = PLACES) -> DataFrame:
    """pilot_id, path, place: each row's first place that is in ``existing`` (path); none is an error."""
    def filled(place: str):
        parts, rest = [], place
        while "{" in rest:
            before, _, rest = rest.partition("{")
            name, _, rest = rest.partition("}")
            parts += [F.lit(before), F.coalesce(F.col(name).cast("string"), F.lit(""))]
        return F.concat(*parts, F.lit(rest))

    wanted = rows.select("pilot_id", F.posexplode(F.array(*[filled(p) for p in places])).alias("place", "path"))
    d = rows.select("pilot_id").distinct().join(joins.first_present(wanted, existing, "pilot_id", "path", "place"), "pilot_id", "left")
    bad = F.when(F.col("path").isNull(), F.raise_error(F.concat(F.lit("no prediction for "), F.col("pilot_id").cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return d.filter(bad)


def _text(value) -> str:
    value = value.item() if isinstance(value, np.ndarray) and value.size == 1 else value
    return value.decode("utf-8", "ignore") if isinstance(value, bytes) else str(value)


def payload_list(payload, k: int, other) -> list:
    """``k`` values of a payload that is a list, an array, or a mapping by number; ``other(i)`` where it has none."""
    if isinstance(payload, np.ndarray):
        payload = payload.item() if payload.shape == () else payload.reshape(-1).tolist()
    if isinstance(payload, dict):
        return [payload.get(str(i), payload.get(i, other(i))) for i in range(k)]
    values = list(payload) if isinstance(payload, (list, tuple)) else []
    return [values[i] if i < len(values) else other(i) for i in range(k)]


def _labelled(sem: np.ndarray, inst: np.ndarray | None) -> list[np.ndarray]:
    if inst is None:
        return [sem == v for v in np.unique(sem) if v != -1]
    pairs = sorted({(s, i) for s, i in zip(sem.tolist(), inst.tolist(), strict=True) if s != -1 and i != -1})
    return [(sem == s) & (inst == i) for s, i in pairs]


def parts_of(doc: dict, n_points: int) -> list[tuple[str, float | None, np.ndarray]]:
    """(name, score, points) of a segmentation: listed parts, masks in either orientation, or label vectors.

    With ``point_indices`` the arrays number a subset's points.
    """
    subset = np.asarray(doc["point_indices"], dtype=np.int64) if doc.get("point_indices") is not None else None
    n = n_points if subset is None else len(subset)
    if doc.get("parts") is not None:
        out = []
        for i, p in enumerate(doc["parts"]):
            ids = np.flatnonzero(np.asarray(p["mask"])) if p.get("mask") is not None else np.unique(np.asarray(p.get("indices", p.get("point_indices", [])), dtype=np.int64))
            out.append((_text(p.get("name", p.get("label", f"part_{i:02d}"))), None if p.get("score") is None else float(p["score"]), ids))
        found = out
    else:
        if doc.get("masks") is not None:
            a = np.asarray(doc["masks"])
            a = a.reshape(1, -1) if a.ndim == 1 else a
            masks = list((a if candidates.oriented(*a.shape, n) == "rows" else a.T) > 0)
        else:
            sem = doc.get("semantic", doc.get("labels"))
            if sem is None:
                raise ValueError("neither parts, masks nor labels")
            inst = doc.get("instance")
            masks = _labelled(np.asarray(sem).reshape(-1), None if inst is None else np.asarray(inst).reshape(-1))
        names = [_text(v) for v in payload_list(doc.get("names"), len(masks), lambda i: f"part_{i:02d}")]
        scores = [None if v is None else float(v) for v in payload_list(doc.get("scores"), len(masks), lambda i: None)]
        found = [(name, score, np.flatnonzero(m)) for name, score, m in zip(names, scores, masks, strict=True)]
    found = [(name, score, ids if subset is None else subset[ids]) for name, score, ids in found]
    for name, _, ids in found:
        if len(ids) and (ids.min() < 0 or ids.max() >= n_points):
            raise ValueError(f"{name}: a point is out of range")
    return found


def read_parts(spark: SparkSession, path: str, n_points: int) -> DataFrame:
    """path, part, name, score, point_idx of npz and json segmentations. Nothing is unpickled."""

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, data in zip(f["path"], f["content"], strict=True):
                if p.endswith(".json"):
                    doc = json.loads(bytes(data))
                else:
                    with np.load(io.BytesIO(bytes(data)), allow_pickle=False) as z:
                        doc = {k: z[k] for k in z.files}
                rows = [(p, i, name, score, int(x)) for i, (name, score, ids) in enumerate(parts_of(doc, n_points)) for x in ids]
                yield pd.DataFrame(rows, columns=["path", "part", "name", "score", "point_idx"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(load, "path string, part int, name string, score double, point_idx int")


def rank_parts(parts: DataFrame, keys: list[str], least: int, most: int) -> DataFrame:
    """keys, part, name, score, points, place: parts by score, then size; a missing score is 0."""
    from pointloom.operators import windows

    g = parts.groupBy(*keys, "part").agg(F.first("name").alias("name"), F.max("score").alias("score"), F.sort_array(F.collect_list("point_idx")).alias("points")).filter(F.size("points") >= least)
    return windows.ranked(g, keys, [F.coalesce("score", F.lit(0.0)).desc(), F.size("points").desc(), F.col("part")]).filter(F.col("place") <= most)


class _Plain(pickle.Unpickler):
    """Only arrays, numbers, strings, lists and mappings: names outside the list below are refused."""

    _MAY = {
        ("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"), ("numpy.core.multiarray", "scalar"), ("numpy._core.multiarray", "scalar"),
        ("numpy", "ndarray"), ("numpy", "dtype"), ("_codecs", "encode"),
    }

    def find_class(self, module: str, name: str):
        if (module, name) not in self._MAY:
            raise pickle.UnpicklingError(f"{module}.{name} is not allowed in an archive")
        return super().find_class(module, name)


def read_archive(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """object_id, category, point_idx, x, y, z, labels (map of positive values) of an archive's list of objects.

    The one-off reading of an archive runs on the driver, with an unpickler
    that takes plain data alone; write the result as a table.
    """
    data = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if entry not in z.namelist():
            raise ValueError(f"{entry} is not in {path}")
        items = _Plain(io.BytesIO(z.read(entry)), encoding="latin1").load()
    if not isinstance(items, list):
        raise ValueError(f"{entry}: not a list")
    frames = []
    for i, item in enumerate(items):
        shape = item.get("full_shape", item)
        xyz = np.asarray(shape["coordinate"], dtype=np.float64)
        marks = {str(k): np.asarray(v).reshape(-1) for k, v in shape.get("label", {}).items()}
        if any(len(v) != len(xyz) for v in marks.values()):
            raise ValueError(f"object {i}: labels and points differ in length")
        frames.append(pd.DataFrame({
            "object_id": str(item.get("shape_id", i)), "category": str(item.get("semantic class", "unknown")), "point_idx": np.arange(len(xyz), dtype=np.int32),
            "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "labels": [{k: float(v[j]) for k, v in marks.items() if v[j] > 0} for j in range(len(xyz))],
        }))
    ddl = "object_id string, category string, point_idx int, x double, y double, z double, labels map<string,double>"
    return spark.createDataFrame(pd.concat(frames), ddl) if frames else spark.createDataFrame([], ddl)
