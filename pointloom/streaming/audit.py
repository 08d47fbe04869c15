"""The append-only audit log as a stream, and the latest state of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pointloom.operators import windows
from pointloom.sources import files


def read_log(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(kind).load(path)


#: Buckets of keys that the state is kept in.
BUCKETS = 64


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _newest(spark: SparkSession, target: str, schema: str) -> DataFrame | None:
    """Rows of each bucket's newest version, with bucket and state_version; None before the first."""
    if not files.exists(spark, f"{target}/state_version=*"):
        return None
    every = spark.read.schema(f"{schema}, state_version long, bucket int").option("basePath", target).parquet(f"{target}/state_version=*")
    newest = every.groupBy("bucket").agg(F.max("state_version").alias("state_version"))
    return every.join(F.broadcast(newest), ["bucket", "state_version"])  # one row a bucket


def latest_state(log: DataFrame, target: str, checkpoint: str, keys: list[str], seq: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep ``target`` at the last row of each key.

    The state lies in buckets of keys. A batch merges only the buckets that it
    touches and writes their next version; a batch that is run again starts
    from the versions before it and writes the same anew, so restarts leave no
    trace. Versions that two later ones have replaced are removed.
    """
    schema = log.schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.withColumn("bucket", _bucket(keys, buckets))
        touched = [r[0] for r in own.select("bucket").distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        _drop(spark, [f"{target}/state_version={number}"])
        state = _newest(spark, target, ddl)
        if state is not None:
            own = own.unionByName(state.filter(F.col("bucket").isin(*touched)).select(*own.columns))
        done = windows.last_wins(own, keys, seq).select(*schema.names, "bucket")
        done.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/state_version={number}")
        kept = _newest(spark, target, ddl).select("bucket", "state_version").distinct().collect()
        least = min(v for _, v in kept)
        _drop(spark, [f"{target}/state_version={v}" for v in _versions(spark, target) if v < min(least, number - 1)])

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, target: str) -> list[int]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/state_version=*")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(int(f.getPath().getName().split("=")[1]) for f in found or [])


def _drop(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def current_state(spark: SparkSession, target: str, schema: str) -> DataFrame:
    return _newest(spark, target, schema).drop("state_version", "bucket")


def windowed_counts(log: DataFrame, time: str, late: str, width: str, by: list[str]) -> DataFrame:
    """Counts by time window; rows later than ``late`` are left out."""
    return log.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def unfinished(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")
