"""Retrieval and answer metrics, exact order statistics and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.session import cut


def exact_percentiles(df: DataFrame, by: list[str], value: str, ps: list[float], linear: bool = False) -> DataFrame:
    """``by, p, n, value``: the value at rank floor(p * (n - 1)) of each group (ranks from 0), exactly; with ``linear``
    the value between the two nearest ranks.

    Values are range-partitioned and counted where they lie; a group's partitions only exchange their sums. No task
    holds a group, and equal values are one row. What lies where is written down before it is used twice.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    placed = cut(counts.repartitionByRange(*by, value).withColumn("part", F.spark_partition_id()))
    sums = placed.groupBy(*by, "part").agg(F.sum("c").alias("s"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"), F.sum("s").over(Window.partitionBy(*by)).alias("n"))
    inner = Window.partitionBy(*by, "part").orderBy(value)
    same = F.lit(True)
    for c in (*by, "part"):
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    ranked = placed.withColumn("upto", F.sum("c").over(inner)).alias("l").join(offsets.alias("r"), same).select(*[F.col(f"l.{c}").alias(c) for c in (*by, value, "c", "upto")], "r.start", "r.n")
    end = F.col("start") + F.col("upto")
    rank = lambda p: F.lit(p) * (F.col("n") - 1)
    wanted = [F.struct(F.lit(p).alias("p"), f(rank(p)).alias("at"), s.alias("share")) for p in ps for f, s in ((F.floor, 1 - (rank(p) - F.floor(rank(p))) if linear else F.lit(1.0)), *([(F.ceil, rank(p) - F.floor(rank(p)))] if linear else []))]
    found = ranked.select(*by, value, "n", (end - F.col("c")).alias("a"), end.alias("b"), F.explode(F.array(*wanted)).alias("w")).where((F.col("w.at") >= F.col("a")) & (F.col("w.at") < F.col("b")))
    if not linear:
        return found.select(*by, "w.p", "n", value)
    return found.select(*by, "w.p", "n", (F.col(value) * F.col("w.share")).alias(value)).groupBy(*by, "p", "n").agg(F.sum(value).alias(value))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of a share, within [0, 1]; null where n is 0."""
    p = F.try_divide(successes, n)
    centre, wide = (p + z * z / (2 * n)), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.greatest((centre - wide) / scale, F.lit(0.0)), F.least((centre + wide) / scale, F.lit(1.0))


def ranked_metrics(hits: DataFrame, by: str, k: int) -> DataFrame:
    """``by, recall, precision, ndcg`` from rows ``by, rank, relevant, n_relevant``."""
    gain = F.when(F.col("relevant"), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("total"), F.lit(k))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    found = hits.where(F.col("rank") <= k).groupBy(by).agg(F.sum(F.col("relevant").cast("int")).alias("hits"), F.sum(gain).alias("dcg"), F.max("n_relevant").cast("int").alias("total"))
    return found.select(
        by, F.when(F.col("total") > 0, F.round(F.col("hits") / F.col("total"), 6)).otherwise(0.0).alias("recall"), F.round(F.col("hits") / k, 6).alias("precision"),
        F.when(F.col("total") > 0, F.round(F.col("dcg") / ideal, 6)).otherwise(0.0).alias("ndcg"),
    )


#: Cumulative probabilities of a Poisson variable of mean 1, for the weights of bootstrap draws.
POISSON = (0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582)


def bootstrap(df: DataFrame, by: str, key: str, value: str, draws: int = 1000, alpha: float = 0.05) -> DataFrame:
    """``by, mean, low, high``: the interval of a mean from Poisson bootstrap draws, whose weights follow from a hash.

    Every row counts 0, 1, 2... times in a draw, independently of all others, so a draw is one aggregation with partial
    sums and the rows never meet. A draw without any row, as small groups have, has no mean and does not count.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in POISSON), F.lit(0))
    each = df.where(F.col(value).isNotNull()).select(by, key, value, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    means = each.withColumn("w", weight).groupBy(by, "draw").agg(F.try_divide(F.sum(F.col("w") * F.col(value)), F.sum("w")).alias("m"))
    ordered = means.groupBy(by).agg(F.array_sort(F.collect_list("m")).alias("ms"))
    low, high = (F.least(F.floor(p * F.size("ms")), F.size("ms") - 1).cast("int") for p in (alpha / 2, 1 - alpha / 2))
    total = df.groupBy(by).agg(F.avg(value).alias("mean"))
    return ordered.join(total, by).select(by, F.round("mean", 6).alias("mean"), F.round(F.get("ms", low), 6).alias("low"), F.round(F.get("ms", high), 6).alias("high"))


def list_recall(found: DataFrame, gold: DataFrame, by: str, item: str, k: int) -> DataFrame:
    """``by, recall, list_recall``: the share of the different gold items among the first k found ones, and of all gold rows,
    repeated ones too; null gold lists have no row. ``found`` has ``by, item, rank``, ``gold`` ``by, item``."""
    top = found.where(F.col("rank") <= k).select(by, item).distinct().withColumn("__hit", F.lit(1))
    joined = gold.join(top, [by, item], "left")
    each = joined.groupBy(by, item).agg(F.count(F.lit(1)).alias("rows"), F.max(F.coalesce("__hit", F.lit(0))).alias("hit"))
    return each.groupBy(by).agg(F.round(F.avg("hit"), 6).alias("recall"), F.round(F.sum(F.col("hit") * F.col("rows")) / F.sum("rows"), 6).alias("list_recall"))


def document_recall(found: DataFrame, gold: DataFrame, by: str, doc: str, k: int) -> DataFrame:
    """``by, recall``: recall of documents: the documents of found chunks are made distinct, at their best rank, before the
    first k are taken."""
    best = found.groupBy(by, doc).agg(F.min("rank").alias("rank"))
    first = best.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("rank", doc)))
    return list_recall(first, gold.distinct(), by, doc, k).select(by, "recall")


def rates(rows: DataFrame, bucket: str, status: str, good: str = "valid") -> DataFrame:
    """``bucket, n, good, rate``: the share of rows with a good status; rows without a status count, a null bucket is ``unknown``."""
    return rows.groupBy(F.coalesce(bucket, F.lit("unknown")).alias(bucket)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce((F.col(status) == good).cast("int"), F.lit(0))).alias("good")).withColumn("rate", F.round(F.col("good") / F.col("n"), 6))


def faithfulness(rows: DataFrame, score: str, abstains: Column, *by: str) -> DataFrame:
    """``by, n, n_abstain, inclusive, strict``: the mean score over all answers, where abstentions have 0, and over the others."""
    own = F.when(abstains, 0.0).otherwise(F.coalesce(score, F.lit(0.0)))
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(abstains.cast("int")).alias("n_abstain"), F.sum(own).alias("__s"))
    return sums.select(*by, "n", "n_abstain", F.round(F.col("__s") / F.greatest("n", F.lit(1)), 6).alias("inclusive"), F.round(F.col("__s") / F.greatest(F.col("n") - F.col("n_abstain"), F.lit(1)), 6).alias("strict"))
