"""Readers and writers: JSON lines, CSV manifests, arrays, split files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pointloom import constants as c
from pointloom.functions import text


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.globStatus(p) is not None and len(fs.globStatus(p)) > 0


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Strict: a bad line fails the read. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_lenient(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A missing file is empty."""
    return read_jsonl(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1), value.

    Files are read by splits. A split's lines are numbered by themselves; the
    splits' line counts, one row a split, are summed up in file order and added.
    """
    d = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = d.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return d.join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).cast("int").alias("line_no"), "value")


def read_jsonl_checked(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Good rows with line_no (the first ``limit``), and issues of the others."""
    from pointloom.operators import validate

    lines = read_lines(spark, path)
    good = lines.filter(F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False)))
    rows = good.select("line_no", F.from_json("value", schema).alias("r")).select("line_no", "r.*")
    return (rows.orderBy("line_no").limit(limit) if limit is not None else rows), validate.text_issues(lines)


def with_sample_id(rows: DataFrame) -> DataFrame:
    given = F.col("sample_id") if "sample_id" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("sample_id", text.sample_identifier(given, F.col("object_id"), F.col("task")))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; a byte-order mark is dropped and blank cells are empty strings."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).na.fill("")


def read_manifest(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """By suffix: .csv, else JSON lines."""
    if path.endswith(".csv"):
        return nested(read_csv(spark, path))
    return read_jsonl(spark, path, schema) if schema else spark.read.json(path)


def nested(rows: DataFrame) -> DataFrame:
    """Flat columns of a manifest as maps: feasibility_<executor>, label_source_<executor> and the like; a dotted name is a map entry."""
    groups = {"feasibility_": "feasibility", "feasible_": "feasibility", "label_source_": "label_source", "negative_reason_": "negative_reason"}
    maps: dict[str, list[tuple[str, str]]] = {}
    plain = []
    for col in rows.columns:
        prefix = next((p for p in groups if col.startswith(p)), None)
        if prefix:
            maps.setdefault(groups[prefix], []).append((col[len(prefix) :], col))
        elif col.count(".") == 1:
            outer, inner = col.split(".")
            maps.setdefault(outer, []).append((inner, col))
        else:
            plain.append(col)
    made = []
    for name, entries in maps.items():
        values = [text.blank_to_null(F.col(f"`{col}`")) for _, col in entries]
        if name == "feasibility":
            values = [text.coerce_bool(v, name) for v in values]
        made.append(F.map_from_arrays(F.array(*[F.lit(k) for k, _ in entries]), F.array(*values)).alias(name))
    return rows.select(*[F.col(f"`{p}`") for p in plain], *made)


def normalize_samples(rows: DataFrame, path_template: str = "{object_id}.npy") -> DataFrame:
    """Samples with defaults filled: id, executor order, maps over exactly the four executors, quality, paths."""
    d = with_sample_id(rows)
    d = d.withColumns({"object_id": text.sanitize_id(F.col("object_id")), "sample_id": text.sanitize_id(F.col("sample_id"))})
    fill = {"feasibility": F.lit(False), "label_source": F.lit("unavailable"), "negative_reason": F.lit("")}
    names = F.array(*[F.lit(e) for e in c.EXECUTORS])
    new = {}
    for m, default in fill.items():
        given = F.col(m) if m in d.columns else F.lit(None).cast(f"map<string,{'boolean' if m == 'feasibility' else 'string'}>")
        unknown = F.size(F.array_except(F.coalesce(F.map_keys(given), F.array().cast("array<string>")), names)) > 0
        filled = F.map_from_arrays(names, F.array(*[F.coalesce(given[e], default) for e in c.EXECUTORS]))
        new[m] = F.when(unknown, F.raise_error(F.lit(f"{m}: unknown executor")).cast(filled_type(m))).otherwise(filled)
    before, _, after = path_template.partition("{object_id}")
    path = F.concat(F.lit(before), F.col("object_id"), F.lit(after))
    new |= {"executor_order": names, "quality_flag": F.coalesce(text.blank_to_null(F.col("quality_flag")), F.lit("weak")) if "quality_flag" in d.columns else F.lit("weak")}
    new |= {"point_cloud_path": F.coalesce(text.blank_to_null(F.col("point_cloud_path")), path) if "point_cloud_path" in d.columns else path}
    return d.withColumns(new)


def filled_type(name: str) -> str:
    return "map<string,boolean>" if name == "feasibility" else "map<string,string>"


def _array(data: bytes, path: str, key: str | None, delimiter: str | None = None, skip_rows: int = 0) -> np.ndarray:
    if path.endswith(".npz"):
        with np.load(io.BytesIO(data), allow_pickle=False) as z:
            a = z[key or z.files[0]]
    elif path.endswith(".npy"):
        a = np.load(io.BytesIO(data), allow_pickle=False)
    else:
        sep = delimiter or ("," if path.endswith(".csv") else None)
        a = np.loadtxt(io.StringIO(data.decode()), delimiter=sep, skiprows=skip_rows, ndmin=2)
    return a.reshape(1, -1) if a.ndim == 1 else a


def read_arrays(spark: SparkSession, path: str, key: str | None = None, delimiter: str | None = None, skip_rows: int = 0) -> DataFrame:
    """path, row, values: rows of 2-D arrays in npy, npz, xyz, pts, txt or csv files. Nothing is unpickled.

    ``delimiter`` and ``skip_rows`` are for the text kinds.
    """

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, data in zip(f["path"], f["content"], strict=True):
                a = _array(bytes(data), p, key, delimiter, skip_rows)
                if a.ndim != 2 or a.dtype.kind not in "iufb":
                    raise ValueError(f"{p}: not a 2-D array of numbers")
                yield pd.DataFrame({"path": p, "row": np.arange(len(a), dtype=np.int32), "values": list(a.astype(np.float64))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(load, "path string, row int, values array<double>")


def points_of(arrays: DataFrame) -> DataFrame:
    """path, point_idx, x, y, z, nx, ny, nz; arrays are N x 3 or N x 6."""
    v = F.col("values")
    ok = F.when(~F.size(v).isin(3, 6), F.raise_error(F.concat(F.lit("not N x 3 or N x 6: "), "path")).cast("boolean")).otherwise(F.lit(True))
    names = ("x", "y", "z", "nx", "ny", "nz")
    return arrays.filter(ok).select("path", F.col("row").alias("point_idx"), *[F.when(F.size(v) > i, F.get(v, F.lit(i))).alias(n) for i, n in enumerate(names)])


def masks_of(arrays: DataFrame) -> DataFrame:
    """path, point_idx, executor of positive entries of N x 4 arrays."""
    v = F.col("values")
    ok = F.when(F.size(v) != 4, F.raise_error(F.concat(F.lit("not N x 4: "), "path")).cast("boolean")).otherwise(F.lit(True))
    names = F.array(*[F.lit(e) for e in c.EXECUTORS])
    d = arrays.filter(ok).select("path", F.col("row").alias("point_idx"), F.posexplode(v).alias("k", "value"))
    return d.filter("value > 0").select("path", "point_idx", F.get(names, F.col("k")).alias("executor"))


def masks_of_length(arrays: DataFrame, counts: DataFrame) -> DataFrame:
    """``masks_of`` arrays that have as many rows as ``counts`` (path, n_points) says; another length is an error."""
    n = arrays.groupBy("path").agg(F.count("*").alias("__n")).join(counts, "path")
    bad = F.when(F.col("__n") != F.col("n_points"), F.raise_error(F.concat(F.lit("mask and points differ in length: "), "path")).cast("boolean")).otherwise(F.lit(True))
    return masks_of(arrays.join(n.filter(bad).select("path"), "path", "left_semi"))


def mask_from_indices(spec: DataFrame, key: str, n: str) -> DataFrame:
    """key, point_idx of index lists; an index out of range fails."""
    d = spec.select(key, n, F.explode("indices").alias("point_idx"))
    bad = (F.col("point_idx") < 0) | (F.col("point_idx") >= F.col(n))
    return d.filter(F.when(bad, F.raise_error(F.lit("index out of range")).cast("boolean")).otherwise(F.lit(True))).select(key, "point_idx").distinct()


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """split, sample_id from <split>.txt files, one id a line."""
    d = spark.read.text(path).select(F.trim("value").alias("sample_id"), F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("split"))
    return d.filter("sample_id <> ''").select("split", "sample_id")


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; columns that begin with _ are left out."""
    rows.drop(*[k for k in rows.columns if k.startswith("_")]).write.mode(mode).json(path)


def write_csv(rows: DataFrame, path: str, columns: list[str], mode: str = "errorifexists") -> None:
    rows.select(*columns).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_splits(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of ids for each split."""
    rows.select("split", F.col("sample_id").alias("value")).write.mode(mode).partitionBy("split").text(path)


def rewrite_paths(rows: DataFrame, columns: list[str], root_name: str) -> tuple[DataFrame, DataFrame]:
    """Rows with portable paths, and the number of changes by column."""
    new = {k: text.portable_path(F.col(k), root_name) for k in columns}
    changed = rows.select(*[F.sum(F.when(~F.col(k).eqNullSafe(v), 1).otherwise(0)).alias(k) for k, v in new.items()])
    return rows.withColumns(new), changed
