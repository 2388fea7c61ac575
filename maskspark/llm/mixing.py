"""Mixing sources to target weights: per-source repetition rates, whole copies plus one hash-seeded Bernoulli copy.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskspark.llm.shared import WORD, cut, positional

#: Weights of the sources in code point order, repeated as often as needed.
WEIGHTS = (5, 2, 1)
#: No source, and no document, is repeated more often on average.
MAX_RATE = 3
SEED = "mix-1"
#: Draws tried for each source; the one whose total comes nearest the target is taken.
DRAWS = 32
#: A plan of this many sources at most is broadcast.
BROADCAST_SOURCES = 20_000

_BITS = 48


def words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _draw(k: Column | int) -> Column:
    """The k-th of pairwise independent uniform numbers of a row."""
    k = F.lit(k) if isinstance(k, int) else k
    return (F.col("__a") + k * F.col("__b")).bitwiseAND(F.lit(2**_BITS - 1)) / F.lit(float(2**_BITS))


def _sized(docs: DataFrame, seed: str, id_col: str, source_col: str, text_col: str) -> DataFrame:
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("__size").cast("string")).cast("binary"))
    number = lambda at: F.conv(F.substring("__md5", at, _BITS // 4), 16, 10).cast("long")
    return (
        docs.withColumn("__size", words(F.col(text_col))).withColumn("__md5", digest).withColumn("__source", F.col(source_col).cast("string"))
        .withColumn("__a", number(1)).withColumn("__b", number(13).bitwiseOR(F.lit(1))).drop("__md5")
    )


def _targets(sizes: DataFrame, weights: tuple[int, ...], max_rate: int) -> DataFrame:
    """Shares the sum of all sizes by weight; what a source cannot take (max_rate times its size) goes to the others.

    The shares that no source exceeds any more are min(limit, level * weight) with one level for all: in ascending order
    of limit / weight, the level is what is left for the first source that its share doesn't fill. One row a source is
    all that the two ordered windows see.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("limit", (F.col("source_size") * max_rate).cast("double"))
    by_fill = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    earlier = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = (
        s.withColumn("at", F.row_number().over(by_fill))
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0)))
        .withColumn("among", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("among"))
    )
    first = F.min(F.when(F.col("limit") > F.col("level") * F.col("weight"), F.struct("at", "level"))).over(everything)
    s = s.withColumn("final", first.getField("level"))
    return s.select("source", "source_size", F.coalesce(F.least("limit", F.col("final") * F.col("weight")), F.col("limit")).alias("target"))


def source_plan(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """One row a source: (source, source_size, target, rate, pick).

    rate = target / source_size; pick numbers the draw, of DRAWS hash-seeded ones, whose total of taken words comes nearest
    the target. Sums are pre-aggregated, so that a source of a third of all rows is no hot key.
    """
    sized = cut(_sized(docs, seed, id_col, source_col, text_col).select("__source", "__size", "__a", "__b"))
    sizes = sized.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size"))
    plan = _targets(sizes, weights, max_rate)
    plan = plan.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_rate)))).otherwise(0.0))
    plan = cut(plan)
    rows = _with_plan(sized, plan)
    part = F.col("rate") - F.floor("rate")
    totals = rows.groupBy("source").agg(F.array(*[F.sum(F.when(_draw(k) < part, F.col("__size")).otherwise(0)) for k in range(DRAWS)]).alias("extra"))
    plan = plan.join(totals.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    whole = F.floor("rate") * F.col("source_size")
    off = F.transform("extra", lambda x, k: F.struct(F.abs(whole + x - F.col("target")).alias("off"), k.alias("k")))
    return cut(plan.withColumn("pick", F.array_min(off).getField("k")).drop("extra"))


def _with_plan(sized: DataFrame, plan: DataFrame) -> DataFrame:
    small = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return sized.join(F.broadcast(plan) if small else plan, F.col("__source").eqNullSafe(F.col("source")))


def with_copies(
    docs: DataFrame, plan: DataFrame, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", out: str = "copies"
) -> DataFrame:
    """docs with the number of copies that the mix takes of each, and its size, source_size and target as __size, __source_size, __target."""
    names = [c for c in docs.columns if c != out]
    inner = [f"__c{i}" for i in range(len(names))]
    moved = docs.select(*[F.col(f"`{n}`").alias(i) for n, i in zip(names, inner)])
    sized = _sized(moved, seed, inner[names.index(id_col)], inner[names.index(source_col)], inner[names.index(text_col)])
    rows = _with_plan(sized, plan)
    copies = F.floor("rate") + F.when(_draw(F.col("pick")) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return rows.select(*[F.col(i).alias(n) for n, i in zip(names, inner)], F.col("__size"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), copies.cast("int").alias(out))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix: each row of docs floor(rate) times plus once more with probability rate - floor(rate), same columns.

    A size is the number of words of the whole text; null and empty texts have none, and go floor(rate) times or more as
    any other row does (they add no words). Null sources are one source, last in order; null ids are drawn by their size;
    equal rows are drawn alike; a source without words has rate 0. The draw depends on seed, id and size alone: reruns agree.
    Columns of any name pass through. No rows give no rows.
    """
    plan = source_plan(docs, weights, max_rate, seed, id_col, source_col, text_col)
    at = {c: f"c{docs.columns.index(c)}" for c in (id_col, source_col, text_col)}
    moved = docs.select(*positional(docs, docs.columns))
    rows = with_copies(moved, plan, seed, at[id_col], at[source_col], at[text_col]).where("copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
