"""Percentile ranks, their fusion, interleaving and unions of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def pit(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``name`` = (average rank - 0.5) / n of ``value`` among the rows of its group, ties sharing their average rank."""
    group = Window.partitionBy(*by)
    ties = Window.partitionBy(*by, value)
    least = F.rank().over(group.orderBy(value))
    average = least + (F.count(F.lit(1)).over(ties) - 1) / 2.0
    return df.withColumn(name, (average - 0.5) / F.count(F.lit(1)).over(group))


def fuse(judge: Column, dense: Column, alpha: float = 0.1) -> Column:
    return (1 - alpha) * judge + alpha * dense


def round_robin(lists: DataFrame, by: str, source: str, rank: str, item: str, cap: int) -> DataFrame:
    """``by, item, position``: first items of all sources, then second ones; an item stays where it first comes, up to ``cap``."""
    first = lists.groupBy(by, item).agg(F.min(F.struct(rank, source)).alias("at"))
    order = Window.partitionBy(by).orderBy("at", item)
    return first.withColumn("position", F.row_number().over(order)).where(F.col("position") <= cap).select(by, item, "position")


def ordered_union(lists: DataFrame, by: str, source: str, rank: str, item: str, cap: int) -> DataFrame:
    """``by, item, position``: the sources one after another, first occurrences only, up to ``cap``."""
    first = lists.groupBy(by, item).agg(F.min(F.struct(source, rank)).alias("at"))
    order = Window.partitionBy(by).orderBy("at", item)
    return first.withColumn("position", F.row_number().over(order)).where(F.col("position") <= cap).select(by, item, "position")


def repeats(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """``by, value, first, length``: runs of equal values in the order of ``order``; a run of two is a converged answer."""
    along = Window.partitionBy(by).orderBy(order)
    change = F.when(F.lag(value).over(along).eqNullSafe(F.col(value)), 0).otherwise(1)
    runs = df.withColumn("__c", change).withColumn("__run", F.sum("__c").over(along))
    return runs.groupBy(by, value, "__run").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("length")).drop("__run")


def boost(ranked: DataFrame, supported: DataFrame, on: list[str], score: str, bonus: float, by: str, tie: str) -> DataFrame:
    """``ranked`` with ``bonus`` added to the score of rows that ``supported`` names, and their new rank."""
    named = supported.select(*on).distinct().withColumn("__hit", F.lit(1))
    scored = ranked.join(named, on, "left").withColumn(score, F.col(score) + bonus * F.coalesce("__hit", F.lit(0))).drop("__hit")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round(score, 5)), tie)))


def converged(answers: DataFrame, by: str, order: str, value: str, gamma: str, least: float = 0.70) -> DataFrame:
    """``by, at, value``: where an iteration converges: the first answer that repeats the one before it, is not empty and has
    a gamma of ``least`` or more. Groups that never converge are left out."""
    along = Window.partitionBy(by).orderBy(order)
    again = F.lag(value).over(along).eqNullSafe(F.col(value)) & (F.col(value) != "") & (F.coalesce(gamma, F.lit(0.0)) >= least) & (F.row_number().over(along) > 1)
    first = answers.withColumn("__again", again).where("__again").groupBy(by).agg(F.min(F.struct(order, value)).alias("f"))
    return first.select(by, F.col(f"f.{order}").alias("at"), F.col(f"f.{value}").alias(value))


def stability(answers: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """``by, n, distinct, share``: how many answers an iteration has, how many different ones, and the share of the earlier
    ones that equal its last. Values and their counts are aggregated first; no task holds a group."""
    last = answers.groupBy(by).agg(F.max(F.struct(order, value)).alias("l"), F.count(F.lit(1)).alias("n")).select(by, "n", F.col(f"l.{value}").alias("__last"))
    counts = answers.groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    joined = counts.join(last, by).groupBy(by, "n").agg(F.count(F.lit(1)).alias("distinct"), F.sum(F.when(F.col(value).eqNullSafe(F.col("__last")), F.col("c")).otherwise(0)).alias("same"))
    return joined.select(by, "n", "distinct", F.round(F.coalesce(F.try_divide(F.col("same") - 1, F.col("n") - 1), F.lit(1.0)), 6).alias("share"))


def unseen(found: DataFrame, seen: DataFrame, by: str, item: str, rank: str, cap: int) -> DataFrame:
    """The first ``cap`` items of each list that were not seen before, in their order."""
    fresh = found.join(seen.select(by, item).distinct(), [by, item], "left_anti")
    return fresh.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(rank, item))).where(F.col("position") <= cap)
