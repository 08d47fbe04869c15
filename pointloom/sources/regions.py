"""Region specifications: JSON documents and label dictionaries as long tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom import constants as c
from pointloom.functions import text

_DDL = "path string, name string, point_idx int, tasks array<string>, executors array<string>"
#: Keys of a document that are not regions of their own.
_KNOWN = {"executors", "direct_executors", "regions", "num_points", "metadata", "object_id", "task"}


def _points(spec, where: str) -> list[int]:
    """Positive points of a mask (0/1 a point) or an index list; the first key that is there counts."""
    if isinstance(spec, dict):
        if "mask" in spec:
            return [i for i, v in enumerate(spec["mask"]) if v]
        if "indices" in spec:
            spec = spec["indices"]
        elif "array" in spec:
            return _points(spec["array"], where)
        else:
            raise ValueError(f"{where}: neither mask nor indices")
    if not isinstance(spec, list) or any(isinstance(v, bool) or int(v) != v or v < 0 for v in spec):
        raise ValueError(f"{where}: not a list of indices")
    return sorted({int(v) for v in spec})


def _names(value) -> list[str] | None:
    return None if value is None else [value] if isinstance(value, str) else [str(v) for v in value]


def _regions(doc: dict, where: str) -> Iterator[tuple[str, list[int], list[str] | None, list[str] | None]]:
    for box in ("executors", "direct_executors"):
        for e, spec in (doc.get(box) or {}).items():
            if e not in c.EXECUTORS:
                raise ValueError(f"{where}: unknown executor {e}")
            yield e, _points(spec, where), None, [e]
    listed = doc.get("regions") or []
    named = [(r.get("name", ""), r) for r in listed] if isinstance(listed, list) else list(listed.items())
    named += [(k, v) for k, v in doc.items() if k not in _KNOWN and isinstance(v, (dict, list))]
    for name, spec in named:
        about = spec if isinstance(spec, dict) else {}
        yield name, _points(spec, f"{where}: {name}"), _names(about.get("tasks")), _names(about.get("executors"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """path, name, point_idx, tasks, executors of region documents, one JSON object a file."""

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, data in zip(f["path"], f["content"], strict=True):
                rows = [(p, name, i, tasks, executors) for name, points, tasks, executors in _regions(json.loads(bytes(data)), p) for i in points]
                yield pd.DataFrame(rows, columns=["path", "name", "point_idx", "tasks", "executors"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(load, _DDL)


def label_masks(labels: DataFrame, key: str) -> DataFrame:
    """key, affordance, point_idx of positive values; ``labels`` has a map from affordance to the points' values."""
    d = labels.select(key, F.explode("label").alias("affordance", "values"))
    return d.select(key, text.sanitize_key(F.col("affordance")).alias("affordance"), F.posexplode("values").alias("point_idx", "value")).filter("value > 0").drop("value")


def scatter(part: DataFrame, subset: DataFrame, keys: list[str]) -> DataFrame:
    """Points of a subset's own numbering back to the object's: ``subset`` has (keys, local, point_idx)."""
    return part.join(subset, [*keys, "local"]).drop("local")
