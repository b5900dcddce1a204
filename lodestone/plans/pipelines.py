"""Compositions of operators: a batch of questions from text to arbitrated answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.functions import questions as Q
from lodestone.functions.text import lookup_key, tokens
from lodestone.operators.arbitration import agreement, arbitrate
from lodestone.operators.evidence import link_entities
from lodestone.operators.graph import edges

#: The arms of an answer, by their columns.
ARMS = {"v3bu": "v3bu_pred", "decompose": "dec_pred", "iter": "pred"}


def answers_once(answers: DataFrame) -> DataFrame:
    """Answers without what logging adds; rows that were logged twice are one."""
    return answers.select("answer_id", "qid", "question", "gold", "pred", "em", "f1", "v3bu_pred", "dec_pred", "decision", "soft_em").distinct()


def question_scores(questions: DataFrame, text: str = "question") -> DataFrame:
    """The distinct questions with their scores (``s_...``) and arm probabilities (``p_...``)."""
    own = questions.select(text).distinct()
    scored = own.select(text, *[c.alias(f"s_{n}") for n, c in Q.scores(F.col(text)).items()])
    s = {c[2:]: F.col(c) for c in scored.columns if c != text}
    hops = scored.select("*", *[c.alias(f"h_{n}") for n, c in Q.hops(s).items()])
    h = {c[2:]: F.col(c) for c in hops.columns if c.startswith("h_")}
    return hops.select("*", *[c.alias(f"p_{n}") for n, c in Q.arm_probabilities(s, h).items()])


def arm_table(answers: DataFrame, responses: DataFrame) -> DataFrame:
    """``answer_id, arm, answer, gamma, faith, p``: one row per arm, with signals that need no labels.

    ``p`` is the arm's probability for the question. ``gamma`` is the share of the answer's words that stand in the
    responses to the same question, null without responses; the words of both are made distinct per question before
    they meet, so that a question with a third of all rows is spread over its words. ``faith`` is left to a judge.
    """
    p = question_scores(answers).select("question", *[F.col(f"p_{a}").alias(a) for a in ARMS])
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(c).alias("answer"), F.col(a).alias("p")) for a, c in ARMS.items()])).alias("e")
    rated = answers.join(p, answers.question.eqNullSafe(p.question)).select("answer_id", "qid", each).select("answer_id", "qid", "e.*")
    said = responses.where("qid IS NOT NULL AND text IS NOT NULL").select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("w")).distinct()
    asked = said.select("qid").distinct().withColumn("has", F.lit(True))
    words = rated.select("answer_id", "arm", "qid", F.explode(F.array_distinct(tokens(F.col("answer")))).alias("w")).join(said.withColumn("hit", F.lit(1)), ["qid", "w"], "left")
    share = words.join(asked, "qid").groupBy("answer_id", "arm").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("gamma"))
    return rated.join(share, ["answer_id", "arm"], "left").select("answer_id", "arm", "answer", "gamma", F.lit(None).cast("double").alias("faith"), F.round("p", 9).alias("p"))


def answer_batch(answers: DataFrame, triples: DataFrame, responses: DataFrame) -> DataFrame:
    """``answer_id, arm, answer, score, n_entities, n_facts``: entities are linked, facts counted as evidence, arms
    compared and one answer chosen for every question."""
    own = answers_once(answers)
    facts = edges(triples).groupBy(F.col("subject").alias("entity")).agg(F.count(F.lit(1)).alias("facts"))
    linked = link_entities(own, "answer_id", "question", facts).join(facts, "entity").groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_entities"), F.sum("facts").alias("n_facts"))
    chosen = arbitrate(agreement(arm_table(own, responses), "answer_id"), "answer_id")
    return chosen.select("answer_id", "arm", "answer", "score").join(linked, "answer_id", "left").na.fill(0, ["n_entities", "n_facts"])


def provider_lists(responses: DataFrame) -> DataFrame:
    """``qid, provider, rank, item``: each provider's responses to a question in the order of their ids."""
    own = responses.where(F.col("qid").isNotNull()).select("response_id", "qid", F.coalesce("provider", F.lit("")).alias("provider"), lookup_key(F.col("text")).alias("item")).distinct()
    return own.where("item <> ''").withColumn("rank", F.row_number().over(Window.partitionBy("qid", "provider").orderBy("response_id"))).select("qid", "provider", "rank", "item")
