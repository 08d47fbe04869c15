"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the copies that each of its documents
gets on average; the fractional part is rounded dependently. Two documents of a
source exchange fractional words until one of them has a whole number of
copies: each of the two outcomes leaves the words of the pair as they are and
is drawn so that neither document's expectation changes. The documents of a
source are dealt into buckets by hash; each bucket is folded to one document
that is still fractional, and the buckets' residuals are folded again, level by
level, until a source has one residual. That one is drawn by its chance; the
words by which the draw misses the target are then made up for as far as one
document can: the one of the source whose size fits best changes over.

Only DataFrame functions run: a level is a grouped aggregate over at most
``FAN`` rows a bucket on average, and decided rows leave the tree at once, so a
hot source spreads over as many tasks as its rows need. Targets need the ranks
of the sources and totals in order of their tops; both are totals of ranges,
so no task holds all sources.

Defined cases: sources rank by code point, null last; a null text has size 0
and is taken as often as the whole part of its source's rate says; very long
texts are single units; rows that agree in doc_id, source and text are units of
their own, numbered, and are drawn apart; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm import common

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Rows that a bucket of the reduction tree folds on average.
FAN = 24
SEED = 20_24


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target; one row a source. ``sizes`` has one row a source and is read a few times.

    Sources that stop at ``most`` times their size are those with the smallest
    size for their weight, so one pass in that order finds how far the excess
    is passed on.
    """
    d = common.numbered(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], {"rank": "1L"}, "mix-ranks")
    w = f"element_at(array({', '.join(f'{x}D' for x in weights)}), cast(rank % {len(weights)} AS int) + 1)"
    d = d.selectExpr("source", "source_size", f"{w} AS w", f"source_size * {most}D AS top").withColumn("k", F.col("top") / F.col("w"))
    total = d.agg(F.sum("source_size").alias("words"), F.sum("w").alias("w")).first()
    words, all_w = float(total["words"] or 0), float(total["w"] or 0)
    d = common.numbered(d, [F.col("k"), F.col("source").asc_nulls_last()], {"tops": "top", "passed": "w"}, "mix-tops")
    # what is left for this source and all behind it, by weight; the first in that order that stays below its top fixes the level
    d = d.withColumn("level", (F.lit(words * share) - F.col("tops")) / (F.lit(all_w) - F.col("passed")))
    first = d.filter("level * w <= top").agg(F.min(F.struct("k", "level")).alias("f")).first()["f"]
    level = F.lit(None).cast("double") if first is None else F.lit(first["level"])
    return d.select("source", "source_size", F.least("top", F.coalesce(level * F.col("w"), F.col("top"))).cast("double").alias("target"))


#: Fold of a bucket's units. ``open`` is the one unit that is still fractional.
#: a: words that can move from y to x; b: from x to y. The chance of the first is b / (a + b), so expectations stay.
_FOLD = """
aggregate(units, named_struct('done', cast(array() AS array<{t}>), 'open', cast(NULL AS {t})),
  (s, y) -> CASE
    WHEN y.part <= 0D OR y.mass = 0 THEN named_struct('done', concat(s.done, array(y)), 'open', s.open)
    WHEN s.open IS NULL THEN named_struct('done', s.done, 'open', y)
    ELSE aggregate(array(named_struct(
        'a', least(s.open.mass * (1D - s.open.part), y.mass * y.part),
        'b', least(s.open.mass * s.open.part, y.mass * (1D - y.part)),
        'u', shiftrightunsigned(xxhash64({seed}, {level}, s.open.h, y.h), 11) * {unit})),
      s, (z, m) -> CASE
        WHEN m.u * (m.a + m.b) < m.b THEN CASE
          WHEN s.open.mass * (1D - s.open.part) <= y.mass * y.part
          THEN named_struct('done', concat(s.done, array({x1})), 'open', {y_less})
          ELSE named_struct('done', concat(s.done, array({y0})), 'open', {x_more}) END
        ELSE CASE
          WHEN s.open.mass * s.open.part <= y.mass * (1D - y.part)
          THEN named_struct('done', concat(s.done, array({x0})), 'open', {y_more})
          ELSE named_struct('done', concat(s.done, array({y1})), 'open', {x_less}) END
      END) END)
"""
_UNIT = "struct<h: bigint, doc_id: bigint, size: bigint, text: bigint, mass: double, base: bigint, part: double>"


def _with(unit: str, part: str) -> str:
    keep = ", ".join(f"'{c}', {unit}.{c}" for c in ("h", "doc_id", "size", "text", "mass", "base"))
    return f"named_struct({keep}, 'part', {part})"


def _fold(level: int) -> str:
    x, y = "s.open", "y"
    return _FOLD.format(
        t=_UNIT, seed=SEED, level=level, unit=f"{2.0**-53!r}D",
        x1=_with(x, "1D"), x0=_with(x, "0D"), y1=_with(y, "1D"), y0=_with(y, "0D"),
        y_less=_with(y, "y.part - m.a / y.mass"), x_more=_with(x, "s.open.part + m.a / s.open.mass"),
        y_more=_with(y, "y.part + m.b / y.mass"), x_less=_with(x, "s.open.part - m.b / s.open.mass"),
    )


def word_count(text: Column) -> Column:
    return F.regexp_count(common.whole_text(text), F.lit(common.WORD)).cast("long")


def text_hash(text: Column) -> Column:
    return F.xxhash64(common.whole_text(text))


def units(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, size, text (its hash), n: how many rows agree in these."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), text_hash(F.col(text_col)).alias("text"))
    return d.groupBy("doc_id", "source", "size", "text").agg(F.count("*").alias("n"))


#: Rows that agree in all are numbered in runs of as many, so no row holds a long array.
_RUN = 4096


def mix(unit: DataFrame, fan: int = FAN) -> DataFrame:
    """doc_id, source, size, text, source_size, target, copies: one row for each row of the documents.

    ``unit`` is read a few times: hand over a stored table.
    """
    sizes = common.staged(unit.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("units")), "mix-sizes")
    sources = common.staged(targets(sizes).join(sizes.select(F.col("source").alias("s"), "units"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-sources")
    most = sources.agg(F.max("units")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    named = sources.select(F.col("source").alias("s"), F.struct("source_size", "target", rate.alias("rate"), "units").alias("about"))
    d = unit.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _RUN))))
    d = d.withColumn("nth", F.explode(F.sequence(F.col("run") * _RUN, F.least(F.col("n"), (F.col("run") + 1) * _RUN) - 1)))
    d = d.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    base = F.floor("about.rate")
    d = d.select(
        "source", "about", F.xxhash64(F.lit(SEED), "doc_id", "size", "text", "nth").alias("h"), F.col("doc_id").cast("long").alias("doc_id"), "size", "text",
        F.col("size").cast("double").alias("mass"), base.cast("long").alias("base"), (F.col("about.rate") - base).alias("part"),
    )
    levels, left = [], most
    while left > 1:
        left = 1 if left <= 2 * fan else math.ceil(left / fan)
        levels.append(left)
    decided = []
    fields = ("h", "doc_id", "size", "text", "mass", "base", "part")
    for level, buckets in enumerate(levels):
        # each source has as many buckets as its own rows need, in proportion to the largest
        own = F.greatest(F.lit(1), F.ceil(F.lit(buckets) * F.col("about.units") / F.lit(most)))
        grouped = d.withColumn("bucket", F.pmod(F.xxhash64("h", F.lit(level)), own)).groupBy("source", "bucket").agg(
            F.first("about").alias("about"), F.sort_array(F.collect_list(F.struct(*fields))).alias("units")
        )
        folded = grouped.select("source", "about", F.expr(_fold(level)).alias("f"))
        folded = common.staged(folded, f"mix-level{level}")
        decided.append(folded.select("source", "about", F.inline("f.done")))
        d = folded.filter("f.open IS NOT NULL").select("source", "about", "f.open.*")
    done = d.withColumn("last", F.lit(True))
    for part in decided:
        done = done.unionByName(part.withColumn("last", F.lit(False)))
    return _settle(done)


def _settle(done: DataFrame) -> DataFrame:
    """Draw each source's residual and change over the unit that best makes up for it."""
    last = done.filter("last AND mass > 0").groupBy("source").agg(F.max(F.struct("mass", "part", "h", "doc_id", "size")).alias("r"))
    drawn = F.expr(f"shiftrightunsigned(xxhash64({SEED}, -1, r.h), 11) * {2.0**-53!r}D < r.part")
    last = last.select(F.col("source").alias("s"), F.col("r.h").alias("rh"), F.col("r.part").alias("rpart"), F.col("r.mass").alias("rmass"), drawn.alias("up"))
    # up: the residual takes a copy more, too many words; else it takes none, too few
    last = last.selectExpr("*", "CASE WHEN up THEN -(1D - rpart) * rmass ELSE rpart * rmass END AS short")
    d = done.join(last, F.col("source").eqNullSafe(F.col("s")), "left")
    # a change must lessen what is missing: from 0 to 1 when words are short, from 1 to 0 when there are too many
    fits = "NOT last AND mass > 0 AND abs(short) > 0 AND ((short > 0 AND part < 0.5D) OR (short < 0 AND part >= 0.5D)) AND mass < 2 * abs(short) AND about.rate < 2D"
    best = d.filter(fits).groupBy("source").agg(F.min(F.expr("struct(abs(abs(short) - mass) AS miss, h, doc_id)")).alias("b"))
    best = best.select(F.col("source").alias("bs"), F.col("b.h").alias("bh"), F.col("b.doc_id").alias("bid"))
    d = d.join(best, F.col("source").eqNullSafe(F.col("bs")), "left")
    flip = F.expr("bs IS NOT DISTINCT FROM source AND bh IS NOT NULL AND h = bh AND doc_id IS NOT DISTINCT FROM bid AND NOT last")
    rounded = F.when(F.col("last"), F.coalesce("up", F.lit(False))).otherwise(F.col("part") >= 0.5).cast("long")
    one = F.when(F.expr("mass = 0"), F.lit(0).cast("long")).when(flip, 1 - rounded).otherwise(rounded)
    return d.select("doc_id", "source", "size", "text", "about.source_size", "about.target", (F.col("base") + one).alias("copies"))


def taken_rows(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` (what ``mix`` gives for them) takes it.

    Of rows that agree in id, source and text one stands for all that are taken of them.
    """
    per = mixed.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text").alias("__hash")).agg(F.count("*").alias("__n"), F.sum("copies").alias("__copies"))
    per = per.filter("__copies > 0")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & F.col(source_col).eqNullSafe(F.col("__source")) & (F.col("__own") == F.col("__hash"))
    d = docs.withColumn("__own", text_hash(F.col(text_col))).join(per, same)
    one = d.filter("__n = 1").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "__copies")
    many = d.filter("__n > 1").groupBy("__id", "__source", "__hash").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__row"), F.first("__copies").alias("__copies"))
    every = one.unionByName(many.select("__row", "__copies"))
    every = every.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__copies") - 1) / _RUN))))
    every = every.withColumn("__nth", F.explode(F.sequence(F.col("__run") * _RUN, F.least(F.col("__copies"), (F.col("__run") + 1) * _RUN) - 1)))
    return every.select("__row.*")
