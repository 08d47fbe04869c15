"""JSON documents, configurations, manual boxes, region arrays, and writers of arrays and pictures."""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom import constants as c
from pointloom.sources import files


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One row a document, with its path in ``file``; no document is an error."""
    if not files.exists(spark, path):
        raise FileNotFoundError(path)
    r = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (r.schema(schema) if schema else r).json(path).withColumn("file", F.input_file_name())


def read_json_text(spark: SparkSession, path: str) -> DataFrame:
    """file, value: whole documents as text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")


def write_json(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """One document a row; what is there is an error unless ``overwrite``."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def read_yaml(spark: SparkSession, path: str) -> dict:
    """A configuration document, read on the driver; needs a YAML library."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML configurations need the yaml package") from e
    found = yaml.safe_load(read_json_text(spark, path).first()["value"])
    if not isinstance(found, dict):
        raise ValueError(f"{path}: not a mapping")
    return found


def manual_boxes(documents: DataFrame) -> DataFrame:
    """file, view, box: from documents (file, value) keyed by view, or with such an object in ``views``.

    A single box object stands for a list of one; what is no object is left out.
    """
    whole = F.coalesce(F.get_json_object("value", "$.views"), F.col("value"))
    d = documents.select("file", F.explode(F.from_json(whole, "map<string,string>")).alias("view", "boxes"))
    listed = F.when(F.col("boxes").startswith("["), F.from_json("boxes", "array<string>")).otherwise(F.array("boxes"))
    return d.select("file", "view", F.explode(listed).alias("box")).filter(F.col("box").startswith("{"))


def view_names(documents: DataFrame) -> DataFrame:
    """file, pos, view: view names of manifests, given as strings or as objects with a name."""
    d = documents.select("file", F.posexplode(F.from_json(F.get_json_object("value", "$.views"), "array<string>")).alias("pos", "v"))
    name = F.when(F.col("v").startswith("{"), F.coalesce(F.get_json_object("v", "$.view"), F.get_json_object("v", "$.name"), F.get_json_object("v", "$.view_name"))).otherwise(F.col("v"))
    return d.select("file", "pos", name.alias("view"))


def read_region_arrays(spark: SparkSession, path: str) -> DataFrame:
    """path, name, point_idx of region masks in npz (a region a key) and npy (one region, named by its file). Nothing is unpickled.

    An array of 0 and 1 is a mask, others are lists of indices.
    """

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, data in zip(f["path"], f["content"], strict=True):
                a = np.load(io.BytesIO(bytes(data)), allow_pickle=False)
                stem = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                named = {k: a[k] for k in a.files} if isinstance(a, np.lib.npyio.NpzFile) else {stem: a}
                for name, v in named.items():
                    v = v.ravel()
                    ids = np.flatnonzero(v) if len(v) > 1 and np.isin(v, (0, 1)).all() else np.unique(v).astype(np.int64)
                    if (ids < 0).any():
                        raise ValueError(f"{p}: {name}: an index is negative")
                    yield pd.DataFrame({"path": p, "name": name, "point_idx": ids.astype(np.int32)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(load, "path string, name string, point_idx int")


def read_view_masks(spark: SparkSession, path: str, executor: str | None = None) -> DataFrame:
    """path, py, px, executor, value: pixels above 0 of 2-D masks in npy files of one channel (for ``executor``) or four."""

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, data in zip(f["path"], f["content"], strict=True):
                a = np.load(io.BytesIO(bytes(data)), allow_pickle=False).astype(np.float32)
                if a.ndim == 2 and executor is None:
                    raise ValueError(f"{p}: a mask of one channel needs an executor")
                if a.ndim not in (2, 3) or (a.ndim == 3 and a.shape[2] != len(c.EXECUTORS)):
                    raise ValueError(f"{p}: shape {a.shape}")
                names = [executor] if a.ndim == 2 else c.EXECUTORS
                y, x, k = np.nonzero(a.reshape(*a.shape[:2], -1))
                yield pd.DataFrame({"path": p, "py": y.astype(np.int32), "px": x.astype(np.int32), "executor": [names[i] for i in k], "value": a.reshape(*a.shape[:2], -1)[y, x, k]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(load, "path string, py int, px int, executor string, value float")


def _npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


def mask_arrays(masks: DataFrame, counts: DataFrame, key: str, point: str) -> DataFrame:
    """key, data: each sample's mask of N x 4 bytes as an npy file; samples without positive points are all zero."""
    kinds = dict(counts.dtypes)
    d = counts.select(key, "n_points").join(masks.groupBy(key).agg(F.collect_list(F.struct(F.col(point).alias("p"), "executor")).alias("on")), key, "left")

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            files_ = []
            for n, on in zip(f["n_points"], f["on"], strict=True):
                a = np.zeros((int(n), len(c.EXECUTORS)), np.uint8)
                for r in on if on is not None else ():
                    a[int(r["p"]), c.EXECUTORS.index(r["executor"])] = 1
                files_.append(_npy(a))
            yield pd.DataFrame({key: f[key], "data": files_})

    return d.mapInPandas(build, f"{key} {kinds[key]}, data binary")


def candidate_archives(candidates: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """key, data: an npz of each object's candidates: ``masks`` (K x N) and ``candidate_ids``, in order of place."""
    kinds = dict(counts.dtypes)
    d = candidates.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "candidate_id", "points"))).alias("all")).join(counts.select(key, "n_points"), key)

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            files_ = []
            for n, every in zip(f["n_points"], f["all"], strict=True):
                masks = np.zeros((len(every), int(n)), np.uint8)
                for i, r in enumerate(every):
                    masks[i, np.asarray(r["points"], dtype=np.int64)] = 1
                out = io.BytesIO()
                np.savez_compressed(out, masks=masks, candidate_ids=np.array([r["candidate_id"] for r in every], dtype=str))
                files_.append(out.getvalue())
            yield pd.DataFrame({key: f[key], "data": files_})

    return d.mapInPandas(build, f"{key} {kinds[key]}, data binary")


def export_files(rows: DataFrame, folder: str, name: str, suffix: str) -> None:
    """Write each row's ``data`` as a file of its own in ``folder``, a path that all executors share."""
    import os

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for f in frames:
            for k, data in zip(f[name], f["data"], strict=True):
                with open(os.path.join(folder, f"{k}{suffix}.part"), "wb") as out:
                    out.write(bytes(data))
                os.replace(os.path.join(folder, f"{k}{suffix}.part"), os.path.join(folder, f"{k}{suffix}"))
            yield pd.DataFrame({"n": [len(f)]})

    rows.select(name, "data").mapInPandas(put, "n long").agg(F.sum("n")).collect()


def png(pixels: np.ndarray) -> bytes:
    """An H x W x 3 picture of bytes as PNG."""
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in pixels)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 6)) + part(b"IEND", b"")


def pictures(pixels: DataFrame, keys: list[str], size: int, background: tuple[int, int, int] = (14, 16, 20)) -> DataFrame:
    """keys, data: PNG files of pixels (px, py, r, g, b)."""
    kinds = dict(pixels.dtypes)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.full((size, size, 3), background, np.uint8)
        a[pdf["py"], pdf["px"]] = pdf[["r", "g", "b"]].to_numpy(np.uint8)
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), png(a)]], columns=[*keys, "data"])

    return pixels.groupBy(*keys).applyInPandas(draw, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", data binary")


def write_all_val(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """All rows into val; the other splits' folders are there and empty."""
    write_known_splits(rows.withColumn("split", F.lit("val")), path, mode)


def write_known_splits(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of ids for each of the known splits, empty ones too; unknown splits get theirs besides."""
    spark = rows.sparkSession
    known = [s for s in c.SPLITS]
    if mode != "overwrite" and files.exists(spark, path):
        raise FileExistsError(path)
    more = [r[0] for r in rows.select("split").distinct().collect() if r[0] not in known]  # as many rows as splits
    for s in [*known, *sorted(more)]:
        rows.filter(F.col("split") == s).select(F.col("sample_id").alias("value")).write.mode("overwrite").text(f"{path}/{s}")


def summary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the number of rows, and each column's counts as a map in the order of its keys."""
    n = rows.agg(F.count("*").alias("rows"))
    for k in columns:
        m = rows.groupBy(F.coalesce(F.col(k).cast("string"), F.lit("<empty>")).alias("k")).agg(F.count("*").alias("n"))
        n = n.join(F.broadcast(m.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(k))))  # one row
    return n
