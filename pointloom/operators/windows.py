"""Ranking, sampling and last-wins operators. ``seq`` is the row's place in its file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _key(columns: list[str]) -> list[Column]:
    return [F.col(c) for c in columns]


def cap_per_group(df: DataFrame, keys: list[str], seq: str, cap: int, total: int | None = None) -> DataFrame:
    """The first ``cap`` rows of each group, then the first ``total`` of all, in file order."""
    w = Window.partitionBy(*keys).orderBy(seq)
    out = df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= cap).drop("__rn")
    return out.orderBy(seq).limit(total) if total is not None else out


def round_robin(df: DataFrame, keys: list[str], seq: str, limit: int) -> DataFrame:
    """``limit`` rows, one of each group in turn; groups come in the order in which they are first seen.

    With no more rows than ``limit`` the file order stays. Adds ``pick``, from 1.
    Only the ``limit`` best rows of each group meet in the final order, and that
    is a top-k, so no task holds all rows.
    """
    w = Window.partitionBy(*keys).orderBy(seq)
    ranked = df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= limit)
    first = ranked.filter("__rn = 1").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(seq).alias("__first"))
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = c if on is None else on & c
    total = df.agg(F.count("*").alias("n")).scalar()
    turn = F.when(total > limit, F.col("__rn")).otherwise(F.lit(0))
    place = F.when(total > limit, F.col("__first")).otherwise(F.col(seq))
    top = ranked.join(first, on).withColumns({"__turn": turn, "__place": place}).orderBy("__turn", "__place").limit(limit)
    return top.withColumn("pick", F.row_number().over(Window.orderBy("__turn", "__place"))).drop("__rn", "__first", "__turn", "__place", *[f"__{k}" for k in keys])


def running_id(df: DataFrame, order: str, prefix: str, column: str = "running_id") -> DataFrame:
    """``prefix`` and a six-digit number in ``order``; for rows that a limit has bounded."""
    n = F.row_number().over(Window.orderBy(order))
    return df.withColumn(column, F.concat(F.lit(prefix), F.lpad(n.cast("string"), 6, "0")))


def last_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Each key's last row, with ``first_seq``, the place at which the key was first seen.

    A grouped maximum, so that rows of a hot key are reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("__r"), F.min(seq).alias("first_seq"))
    return g.select(*keys, "__r.*", "first_seq")


def upsert(base: DataFrame, edits: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """``edits`` come after ``base``; the last row of a key wins."""
    a = base.withColumn("__late", F.lit(0))
    b = edits.withColumn("__late", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__seq", F.struct("__late", seq))
    return last_wins(both, keys, "__seq").drop("__late", "__seq", "first_seq")


def topk_then_fill(df: DataFrame, partition: str, group: str, priority: str, count: str, seq: str, k: int, total: int) -> DataFrame:
    """For each ``partition``: the best ``k`` of each group rank by rank, then others by priority, ``total`` in all.

    Adds ``place`` and ``rank_in_group``.
    """
    w = Window.partitionBy(partition, group).orderBy(priority, F.col(count).desc(), seq)
    g = Window.partitionBy(partition, group)
    d = df.withColumns({"__rn": F.row_number().over(w), "__gp": F.min(priority).over(g), "__gs": F.min(seq).over(g)})
    first = F.col("__rn") <= k
    order = [
        F.when(first, 0).otherwise(1), F.when(first, F.col("__rn")), F.when(first, F.col("__gp")), F.when(first, F.col("__gs")),
        F.col(priority), F.col(count).desc(), F.col(seq),
    ]
    d = d.withColumn("place", F.row_number().over(Window.partitionBy(partition).orderBy(*order))).filter(F.col("place") <= total)
    return d.withColumn("rank_in_group", F.row_number().over(Window.partitionBy(partition, group).orderBy("place"))).drop("__rn", "__gp", "__gs")


def rank_bucket(is_default: Column, accepted: Column, selected: Column, uncertain: Column) -> Column:
    """0 default, 1 accepted, 2 selected by votes, 3 uncertain, 4 other."""
    return F.when(is_default, 0).when(accepted, 1).when(selected > 0, 2).when(uncertain > 0, 3).otherwise(4)


def ranked(df: DataFrame, partition: list[str], order: list[Column], column: str = "place") -> DataFrame:
    return df.withColumn(column, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def greedy_dedupe(sets: DataFrame, partition: list[str], order: str, points: str, limit: float, within: str | None = None) -> DataFrame:
    """Rows in ``order`` of which each overlaps every kept earlier one by less than ``limit`` (shared over united).

    ``points`` is an array of distinct values. With ``within``, only rows that
    agree in that column are held against each other. A fold in each partition:
    whether a row stays depends on those kept before it, and a partition is one
    object's candidates.
    """
    rest = [c for c in sets.columns if c not in (*partition, order, points)]
    item = F.struct(F.col(order).alias("o"), F.col(points).alias("p"), (F.col(within) if within else F.lit(0)).alias("w"), F.struct(F.lit(0).alias("__none"), *rest).alias("r"))
    grouped = sets.groupBy(*partition).agg(F.sort_array(F.collect_list(item)).alias("items"))
    kind = dict(grouped.dtypes)["items"]
    fold = (
        f"aggregate(items, cast(array() AS {kind}), (kept, x) -> CASE WHEN exists(kept, k -> k.w <=> x.w AND size(array_union(k.p, x.p)) > 0"
        f" AND size(array_intersect(k.p, x.p)) / size(array_union(k.p, x.p)) >= {limit}D) THEN kept ELSE concat(kept, array(x)) END)"
    )
    out = grouped.select(*partition, F.explode(F.expr(fold)).alias("x"))
    return out.select(*partition, F.col("x.o").alias(order), F.col("x.p").alias(points), *[F.col(f"x.r.{c}").alias(c) for c in rest])
