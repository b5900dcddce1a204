"""Mixing sources to target token shares by entropy balancing.

For each (mix, source) the document rates w = min(R, q * exp(lambda * x)) are the exponential tilt of the uniform rate q
that is closest to it in relative entropy among the rates with the wanted number of tokens and at most R copies; x is
the document's tokens over the source's mean. The convex dual has one unknown per (mix, source); all are solved together
by safeguarded Newton steps, each one distributed aggregation over the histogram (source, tokens, documents), which
holds exactly what the sums need. Rates become copies by systematic rounding along the documents' sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.llm.tokens import token_counts
from lodestone.session import cut

MAX_STEPS = 40
TOLERANCE = 1e-9
#: Documents that are rounded together; more make more buckets.
BUCKET_DOCS = 5000
#: Solutions are broadcast up to so many (mix, source) rows.
BROADCAST_ROWS = 10_000


def document_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, source, n_tokens``, kept in the checkpoint folder. Rows that repeat an id and source add up."""
    return cut(token_counts(docs, ["doc_id", "source"], "text", path))


def _rate(lam: Column, x: Column) -> Column:
    tilted = F.exp(F.least(F.log("q") + lam * x, F.lit(700.0)))
    return F.when(F.col("want") <= 0, 0.0).when(F.col("full"), F.col("r")).otherwise(F.least(F.col("r"), tilted))


def solve(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per distinct row of ``targets``: ``mix_id, source, target_share, r, want, have, capacity, reachable, full, q, mean, lam, reached``.

    ``want`` is the target in tokens, ``have`` the tokens of the source's documents, ``capacity`` what ``max_repeats``
    copies of them hold, ``reached`` what the solved rates give. A source that the documents lack has none. Null shares and budgets count as 0, a null or
    negative ``max_repeats`` as 0. Rows of ``sizes`` without a source count in the total only.
    """
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).select("t").scalar()
    histogram = cut(sizes.where(F.col("source").isNotNull() & (F.col("n_tokens") > 0)).groupBy("source", "n_tokens").agg(F.count(F.lit(1)).cast("double").alias("docs")))
    by_source = histogram.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("docs")).alias("have"), F.sum("docs").alias("n"), F.min("n_tokens").alias("least")
    )
    share, budget = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("target_share", "budget_ratio"))
    state = (
        targets.select("mix_id", "source", share.alias("target_share"), budget.alias("budget"), F.greatest(F.coalesce(F.col("max_repeats"), F.lit(0)), F.lit(0)).cast("double").alias("r"))
        .distinct()
        .join(by_source, "source", "left")
        .na.fill({"have": 0.0, "n": 0.0})
        .withColumn("want", F.col("target_share") * F.col("budget") * total)
        .withColumn("capacity", F.col("have") * F.col("r"))
        .withColumn("reachable", F.col("capacity") >= F.col("want"))
        .withColumn("full", F.col("capacity") <= F.col("want"))
        .withColumn("q", F.greatest(F.least("budget", "r"), F.lit(1e-9)))
        .withColumn("mean", F.col("have") / F.greatest("n", F.lit(1.0)))
        .withColumn("high", F.log(F.greatest("r", F.lit(1e-9)) / F.col("q")) * F.col("mean") / F.col("least") + 1)
        .withColumn("low", -60 * F.col("mean") / F.col("least"))
        .withColumns({"lam": F.lit(0.0), "off": F.lit(1.0)})
    )
    state = cut(state)
    for _ in range(MAX_STEPS):
        # histogram rows meet the (mix, source) rows of their source; mixes are few, sizes within a source too
        x = F.col("n_tokens") / F.col("mean")
        rate = _rate(F.col("lam"), x)
        sums = (
            histogram.join(state.where(~F.col("full") & (F.col("want") > 0)), "source")
            .select("mix_id", "source", "target_share", "r", "budget", (F.col("docs") * F.col("n_tokens") * rate).alias("g"), F.when(rate < F.col("r"), F.col("docs") * F.col("n_tokens") * x * rate).otherwise(0.0).alias("h"))
            .groupBy("mix_id", "source", "target_share", "r", "budget")
            .agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        )
        step = F.log(F.col("want") / F.col("g")) * F.col("g") / F.col("h")
        low = F.when(F.col("g") < F.col("want"), F.greatest("low", "lam")).otherwise(F.col("low"))
        high = F.when(F.col("g") > F.col("want"), F.least("high", "lam")).otherwise(F.col("high"))
        moved = F.when((F.col("h") > 0) & (F.col("g") > 0), F.col("lam") + F.when(F.col("h") > 0, step))
        state = cut(
            state.drop("off")
            .join(sums, ["mix_id", "source", "target_share", "r", "budget"], "left")
            .withColumns({"low": low, "high": high, "off": F.coalesce(F.abs(F.col("g") / F.col("want") - 1), F.lit(0.0)), "moved": moved})
            .withColumn("lam", F.when(F.col("g").isNull() | (F.col("off") <= TOLERANCE), F.col("lam")).when(F.col("moved") > F.col("low"), F.least("moved", (F.col("lam") + F.col("high")) / 2 + F.abs(F.col("high") - F.col("lam")) / 2)).otherwise((F.col("low") + F.col("high")) / 2))
            .drop("g", "h", "moved")
        )
        if (state.agg(F.max("off")).first()[0] or 0.0) <= TOLERANCE:
            break
    # what the solution really reaches: one more pass of the dual's sums, over all rows, those at the bound included
    rate = _rate(F.col("lam"), F.col("n_tokens") / F.col("mean"))
    ids = ["mix_id", "source", "target_share", "r", "budget"]
    got = histogram.join(state, "source").groupBy(*ids).agg(F.sum(F.col("docs") * F.col("n_tokens") * rate).alias("reached"))
    return cut(state.drop("off", "low", "high").join(got, ids, "left").na.fill({"reached": 0.0}))


def unreachable(solved: DataFrame) -> DataFrame:
    """``mix_id, source`` of the rows whose source cannot reach its share: the solver ended at the bound of the dual, where
    every document has ``max_repeats`` copies, and the tokens reached there are fewer than wanted."""
    return solved.where(F.col("full") & (F.col("reached") < F.col("want"))).select("mix_id", "source").distinct()


def copies(sizes: DataFrame, solved: DataFrame) -> DataFrame:
    """``mix_id, source, doc_id, n_tokens, rate, copies`` of every document that a mix uses; copies never exceed ``max_repeats``.

    Documents of a source are rounded in buckets of about ``BUCKET_DOCS``, in the order of their sizes, so that the
    tokens of a bucket come out within one document of their expectation; a source with a third of all rows just has
    more buckets.
    """
    counted = sizes.where(F.col("source").isNotNull() & (F.col("n_tokens") > 0))
    if solved.count() <= BROADCAST_ROWS:  # else a shuffle by source
        solved = F.broadcast(solved)
    each = counted.join(solved.where(F.col("want") > 0), "source").withColumn("rate", _rate(F.col("lam"), F.col("n_tokens") / F.col("mean")))
    bucket = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / BUCKET_DOCS))
    along = Window.partitionBy("mix_id", "source", "target_share", "__bucket").orderBy("n_tokens", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    start = F.pmod(F.xxhash64("mix_id", "source", "__bucket"), F.lit(1_000_003)) / 1_000_003.0
    return (
        each.withColumn("__bucket", bucket)
        .withColumn("__part", F.col("rate") - F.floor("rate"))
        .withColumn("__end", F.sum("__part").over(along) + start)
        .withColumn("copies", (F.floor("rate") + F.floor("__end") - F.floor(F.col("__end") - F.col("__part"))).cast("int"))
        .withColumn("copies", F.least("copies", F.col("r").cast("int")))
        .where(F.col("copies") > 0)
        .select("mix_id", "source", "doc_id", "n_tokens", "rate", "copies")
    )


def shares(solved: DataFrame, mix: DataFrame) -> DataFrame:
    """What each source of a mix really contributes: ``mix_id, source, target_share, want_tokens, tokens, share, reachable``."""
    got = mix.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    all_of = Window.partitionBy("mix_id")
    return (
        solved.join(got, ["mix_id", "source"], "left")
        .withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        .withColumn("share", F.try_divide(F.col("tokens"), F.sum("tokens").over(all_of)))
        .select("mix_id", "source", "target_share", F.col("want").alias("want_tokens"), "tokens", "share", "reachable")
    )
