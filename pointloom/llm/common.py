"""What the operators share: tables, shared folders, lineage cuts, text helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of sessions that name none, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    A folder of its own is made only where the session names none and runs in
    one process, as in tests; on a cluster a machine's own folder would lose
    what other machines write, so a missing name is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share: the master is {master}")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="pointloom-")
        named = _own[app]
    return named.rstrip("/")


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    The files outlive any executor, so later stages never recompute what stands
    above the cut; unlike ``checkpoint()`` the columns stay prunable.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` dealt by ``key`` and stored below the shared folder as a bucketed table.

    Rows are shuffled once, for the table; later joins on ``key`` read the
    buckets where they lie, at every size of the other side.
    """
    spark = df.sparkSession
    table, n = f"{name.replace('-', '_')}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/{table}"
    df.repartition(n, key).write.format("parquet").option("path", path).option("compression", compression).bucketBy(n, key).saveAsTable(table)
    return spark.table(table)


def numbered(df: DataFrame, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """``df`` in ``order`` with running totals of what stands before each row, without a task that holds all rows.

    ``sums`` maps new columns to the expressions that they total. Rows are
    dealt by ranges; each range is summed up by itself, and the ranges' totals
    (one row each) are summed up and broadcast.
    """
    dealt = staged(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), name)
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = dealt.withColumns({k: F.coalesce(F.sum(F.expr(v)).over(own), F.expr(f"0 * ({v})")) for k, v in sums.items()})
    totals = dealt.groupBy("__part").agg(*[F.sum(F.expr(v)).alias(f"__{k}") for k, v in sums.items()])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = totals.select("__part", *[F.coalesce(F.sum(f"__{k}").over(earlier), F.lit(0)).alias(f"__{k}") for k in sums])
    d = d.join(F.broadcast(before), "__part")
    return d.select(*df.columns, *[(F.col(k) + F.col(f"__{k}")).alias(k) for k in sums])


def looked_up(rows: DataFrame, table: DataFrame, key: str, hot: int = 1000) -> DataFrame:
    """``rows`` joined to ``table``, which has one row a key, with keys that are not null.

    A key that holds more than one in ``hot`` of all rows is hot; there are
    fewer than ``hot`` such keys, so their rows of ``table`` are broadcast
    and no task meets a hot key. ``rows`` is read three times.
    """
    n = rows.groupBy(key).agg(F.count("*").alias("__n"))
    total = rows.agg(F.count("*")).first()[0]
    named = staged(n.filter(F.col("__n") * hot > total).select(key), "hot-keys")
    if named.isEmpty():
        return rows.join(table, key)
    few = table.join(F.broadcast(named), key, "left_semi")
    return rows.join(F.broadcast(few), key).unionByName(rows.join(F.broadcast(named), key, "left_anti").join(table, key))


def sealed(df: DataFrame, keep: list[str], worked_out: list[str]) -> DataFrame:
    """``keep`` and ``worked_out`` columns of ``df``; filters on the latter are not pushed below them.

    A filter that the optimizer pushed through would put the columns'
    expressions inside its own, and inside lambda functions they would be
    worked out again for each element. It does not push filters through a
    projection that numbers its rows.
    """
    number = F.monotonically_increasing_id().alias("__row_number")
    held = df.select(*keep, F.struct(*worked_out, number).alias("__held"))
    return held.select(*keep, *[F.col(f"__held.{c}").alias(c) for c in worked_out])


def whole_text(text: Column) -> Column:
    """The text with null as empty."""
    return F.coalesce(text, F.lit(""))


def word_list(text: Column) -> Column:
    """Words in order, [] for null or blank texts; one regex pass."""
    return F.filter(F.split(whole_text(text), SPACE), lambda w: w != "")
