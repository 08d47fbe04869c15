"""Validation: every rule gives rows (level, line_no, object_id, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom import constants as c


def _issue(df: DataFrame, when: Column, message: Column | str, level: str = "ERROR") -> DataFrame:
    m = F.lit(message) if isinstance(message, str) else message
    return df.filter(when).select(F.lit(level).alias("level"), "line_no", F.coalesce("object_id", F.lit("")).alias("object_id"), m.alias("message"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def text_issues(lines: DataFrame) -> DataFrame:
    """``lines`` (line_no, value): rows that are no JSON, or no object; blank lines are skipped."""
    d = lines.filter(F.trim("value") != "").withColumns({"object_id": F.lit(None).cast("string"), "v": F.try_parse_json("value")})
    kind = F.schema_of_variant("v")
    return union([
        _issue(d, F.col("v").isNull(), "invalid JSON"),
        _issue(d, F.col("v").isNotNull() & ~kind.startswith("OBJECT"), "row is not an object"),
    ])


def missing_fields(lines: DataFrame) -> DataFrame:
    """line_no, object_id, missing: required keys that a row lacks; a key with a null is there."""
    d = lines.filter(F.trim("value") != "").withColumn("keys", F.json_object_keys("value")).filter("keys IS NOT NULL")
    gone = F.array_except(F.array(*[F.lit(f) for f in c.REQUIRED_FIELDS]), F.col("keys"))
    return d.select("line_no", F.get_json_object("value", "$.object_id").alias("object_id"), gone.alias("missing"))


def check_samples(df: DataFrame, required: list[str], filled: list[str], allowed: dict[str, list[str]]) -> DataFrame:
    """All checks of sample rows: a row that lacks required fields (null) gets that one issue, others blank and enum issues.

    Executor columns are checked where ``df`` has them.
    """
    gone = F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in required]))
    d = df.withColumn("__gone", gone)
    whole = d.filter(F.size("__gone") == 0)
    parts = [_issue(d, F.size("__gone") > 0, F.concat(F.lit("missing required fields: "), F.array_join("__gone", ", "))), blank_issues(whole, filled), enum_issues(whole, allowed)]
    if {"executor_order", "feasibility", "label_source", "negative_reason"} <= set(df.columns):
        parts.append(executor_issues(whole))
    return union(parts)


def file_issues(missing: dict[str, str]) -> list[tuple[str, int, str, str]]:
    """Issue rows of inputs (name -> path) that do not exist."""
    return [("ERROR", 0, "", f"{name} does not exist: {path}") for name, path in missing.items()]


def enum_issues(df: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    return union([_issue(df, ~F.coalesce(F.col(k).isin(*v), F.lit(False)), F.concat(F.lit(f"invalid {k}: "), F.coalesce(k, F.lit("null")))) for k, v in allowed.items()])


def blank_issues(df: DataFrame, fields: list[str]) -> DataFrame:
    return union([_issue(df, F.coalesce(F.trim(F.col(f)), F.lit("")) == "", f"empty {f}") for f in fields])


def executor_issues(df: DataFrame) -> DataFrame:
    """Rules on executor_order (array) and the maps feasibility, label_source and negative_reason."""
    order = F.array(*[F.lit(e) for e in c.EXECUTORS])
    keys = F.array_sort(order)
    parts = [_issue(df, ~F.coalesce(F.col("executor_order") == order, F.lit(False)), "executor_order differs")]
    parts += [_issue(df, ~F.coalesce(F.array_sort(F.map_keys(m)) == keys, F.lit(False)), f"{m}: wrong executors") for m in ("feasibility", "label_source", "negative_reason")]
    for e in c.EXECUTORS:
        ok = F.coalesce(F.col("feasibility")[e], F.lit(True))
        parts.append(_issue(df, F.col("label_source")[e].isNotNull() & ~F.col("label_source")[e].isin(*c.LABEL_SOURCES), f"invalid label_source of {e}"))
        parts.append(_issue(df, ~ok & (F.coalesce(F.trim(F.col("negative_reason")[e]), F.lit("")) == ""), f"no negative_reason for {e}"))
    return union(parts)


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """key, n, first_line of keys that occur more than once; a grouped count, so a hot key is reduced first."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min("line_no").alias("first_line")).filter("n > 1")


def mask_issues(samples: DataFrame, points: DataFrame, masks: DataFrame) -> DataFrame:
    """``samples`` (line_no, object_id, point_cloud_path, multi_channel_mask_path) against
    ``points`` (path, n, width, numeric) and ``masks`` (path, n, channels, odd_values)."""
    p = points.select(F.col("path").alias("point_cloud_path"), F.col("n").alias("pn"), "width", "numeric")
    m = masks.select(F.col("path").alias("multi_channel_mask_path"), F.col("n").alias("mn"), "channels", "odd_values")
    d = samples.join(p, "point_cloud_path", "left").join(m, "multi_channel_mask_path", "left")
    return union([
        _issue(d, F.col("pn").isNull(), "point cloud missing"),
        _issue(d, F.col("mn").isNull(), "mask missing"),
        _issue(d, F.col("pn").isNotNull() & ~F.col("width").isin(3, 6), "point cloud is not N x 3 or N x 6"),
        _issue(d, ~F.col("numeric"), "point cloud is not numeric"),
        _issue(d, F.col("channels") != 4, "mask is not N x 4"),
        _issue(d, F.col("pn") != F.col("mn"), "mask and points differ in length"),
        _issue(d, F.col("odd_values") > 0, "mask holds values besides 0 and 1", "WARNING"),
    ])


def split_issues(samples: DataFrame, splits: DataFrame) -> DataFrame:
    """sample ids against split files (split, sample_id): missing, extra, doubled, and in two splits; a row for each that holds."""
    s = splits.groupBy("sample_id").agg(F.countDistinct("split").alias("k"), F.count("*").alias("n"), F.min("split").alias("split"))
    m = samples.select("sample_id", F.col("split").alias("meant")).distinct()
    d = m.join(s, "sample_id", "full_outer")
    says = [
        (F.col("n").isNull(), "missing from split file"), (F.col("meant").isNull(), "not in metadata"), (F.col("k") > 1, "in two splits"),
        (F.col("n") > F.col("k"), "doubled in split file"), ((F.col("k") == 1) & (F.col("split") != F.col("meant")), "in another split's file"),
    ]
    every = F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(what)) for when, what in says]))
    return d.select(F.lit("ERROR").alias("level"), "sample_id", F.explode(every).alias("message"))


def missing_splits(found: list[str]) -> list[str]:
    return [s for s in c.SPLITS if s not in found]
