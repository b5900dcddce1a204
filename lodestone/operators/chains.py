"""Chains of evidence: reranking by facts that connect a question's hops, coherence of sub-questions, spines of passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.functions.questions import chain_terms
from lodestone.functions.text import lookup_key
from lodestone.operators.ranking import fuse, pit

#: Facts that a question keeps, results, and the weights of the bands of gamma.
FACTS, RESULTS = 4, 5
HIGH, LOW, WEIGHT_HIGH, WEIGHT_MIDDLE = 0.66, 0.33, 1.0, 0.5


def words(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(lookup_key(text), " ")), lambda w: w != "")


def select_facts(asked: DataFrame, facts: DataFrame, k: int = FACTS) -> DataFrame:
    """``query_id, subject, object, gamma``: the facts of a question's candidates that share most words with it, k at most.

    ``asked`` has ``query_id, question``, ``facts`` has ``query_id, subject, predicate, object, gamma, place``; equal facts
    (lower case) count once, at their first place; facts that share nothing are left out.
    """
    low = {c: F.lower(c) for c in ("subject", "predicate", "object")}
    once = facts.groupBy("query_id", *[v.alias(f"__{c}") for c, v in low.items()]).agg(F.min(F.struct("place", "subject", "object", "gamma")).alias("f")).select("query_id", "f.*")
    ends = F.array_distinct(F.concat(words(F.col("subject")), words(F.col("object"))))
    scored = once.join(asked.select("query_id", words(F.col("question")).alias("__q")), "query_id").withColumn("__n", F.size(F.array_intersect(ends, "__q"))).where("__n > 0")
    best = Window.partitionBy("query_id").orderBy(F.desc("__n"), "place", "subject", "object")
    return scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("query_id", "subject", "object", "gamma")


def fact_words(subject: Column, object_: Column) -> Column:
    return F.array_distinct(F.concat(words(subject), words(object_)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 where one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def prior(rank: Column, n: Column, gain: float = 0.5) -> Column:
    """The prior of a candidate from its rank (from 0): 1 for the last of n, 1 + gain for the first."""
    return F.when(n > 1, 1.0 + gain * (n - 1 - rank) / (n - 1)).otherwise(1.0)


def chain_rerank(asked: DataFrame, candidates: DataFrame, facts: DataFrame, k: int = RESULTS, alpha: float = 0.1) -> DataFrame:
    """``query_id, doc, rank, chained``: candidates fused from the chain score of the facts that they hold and their own
    score, for questions that pass the gate; the others, and those without a fact in any candidate, keep their order.

    ``asked`` has ``query_id, question, gate``, ``candidates`` ``query_id, doc, score, rank, text`` and ``facts`` as in
    ``select_facts``. A fact counts for a candidate whose text has all words of both ends, by the band of its gamma.
    """
    kept = select_facts(asked.where("gate"), facts)
    n = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    text = candidates.select("query_id", "doc", "rank", words(F.col("text")).alias("__t")).join(n, "query_id")
    gamma = F.greatest(F.least(F.col("gamma"), F.lit(1.0)), F.lit(0.0))
    weight = F.when(gamma >= HIGH, WEIGHT_HIGH).when(gamma >= LOW, WEIGHT_MIDDLE).otherwise(0.0)
    held = text.join(kept, "query_id").where((F.size(words(F.col("subject"))) > 0) & (F.size(F.array_except(fact_words(F.col("subject"), F.col("object")), "__t")) == 0))
    chain = held.groupBy("query_id", "doc").agg(F.round(F.sum(weight * gamma) * F.max(prior(F.col("rank") - 1, F.col("n"))), 9).alias("chain"))
    scored = candidates.select("query_id", "doc", "score", "rank").join(chain, ["query_id", "doc"], "left").na.fill({"chain": 0.0})
    fused = pit(pit(scored, ["query_id"], "chain", "a"), ["query_id"], "score", "b")
    fused = fused.withColumn("some", F.max("chain").over(Window.partitionBy("query_id")) > 0)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.when(F.col("some"), F.round(fuse(F.col("a"), F.col("b"), alpha), 9)).otherwise(0.0)), "old")
    return fused.withColumnRenamed("rank", "old").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc", "rank", F.col("some").alias("chained"))


def coherence(hops: DataFrame, key: str) -> DataFrame:
    """``key, coherent, broken_at``: whether every hop's answer is taken up by the context of the next one.

    ``hops`` has ``key, hop, answer, context``; a link holds if a name, number or longer word of the answer stands in the
    next context. ``broken_at`` is the first hop without a link; chains of one hop are coherent.
    """
    along = Window.partitionBy(key).orderBy("hop")
    after = F.lower(F.lead("context").over(along))
    linked = F.exists(chain_terms(F.col("answer")), lambda t: F.contains(F.col("__next"), t))
    each = hops.withColumns({"__next": after, "__last": F.lead("hop").over(along).isNull()}).withColumn("__ok", F.col("__last") | F.coalesce(linked, F.lit(False)))
    return each.groupBy(key).agg(F.min("__ok").alias("coherent"), F.min(F.when(~F.col("__ok"), F.col("hop"))).alias("broken_at"))


def along_spine(passages: DataFrame, key: str, spine: str, text: str, place: str) -> DataFrame:
    """``passages`` with ``position``: those that mention the earliest entity of the spine (an array) first, those without
    one last, else in their own order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    at = F.array_position(F.transform(spine, lambda e: F.contains(F.col("__low"), F.lower(e))), True)
    ranked = passages.withColumn("__low", low).withColumn("__at", F.when(at > 0, at).otherwise(F.size(spine) + 1))
    return ranked.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("__at", place))).drop("__low", "__at")


def aspect_agreement(arms: DataFrame, key: str, aspects: DataFrame) -> DataFrame:
    """``key, arm, aspect, share``: the share of a question's arms that have an aspect of an arm's answer, in any case; the
    arm itself counts. ``aspects`` has ``key, arm, aspect``; arms and aspects are distinct before they meet."""
    n = arms.select(key, "arm").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    low = aspects.select(key, "arm", F.lower("aspect").alias("__a")).distinct().groupBy(key, "__a").agg(F.count(F.lit(1)).alias("have"))
    return aspects.distinct().withColumn("__a", F.lower("aspect")).join(low, [key, "__a"]).join(n, key).select(key, "arm", "aspect", F.round(F.col("have") / F.col("n"), 6).alias("share"))
