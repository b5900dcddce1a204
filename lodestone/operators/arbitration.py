"""Choosing one of several arms' answers. Arms are a long table: ``key, arm, answer`` and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.functions.questions import asks_second_fact
from lodestone.functions.text import has_substance, is_abstention, is_uncertain, is_uncertain_fallback, is_uncertain_normalised, let, normalize_answer, overlap_f1, token_f1, tokens
from lodestone.operators.metrics import exact_percentiles

#: Weights of the signals, and the similarity from which answers agree.
WEIGHTS = {"gamma": 1.0, "agree": 0.5, "faith": 0.3}
AGREE_AT = 0.70
#: Arms in the order in which they win ties.
PRIORITY = ("v3bu", "decompose", "iter")


def agreement(arms: DataFrame, key: str) -> DataFrame:
    """``agree``: the share of the other non-empty answers to the same question that agree with an arm's answer.

    The arms of a question are few, so they are compared inside one row, by higher-order functions.
    """
    bags = arms.select(key, "arm", F.array_distinct(tokens(F.col("answer"))).alias("bag"))
    rows = bags.groupBy(key).agg(F.collect_list(F.struct("arm", "bag")).alias("all"))

    def rate(e: Column) -> Column:
        others = F.filter("all", lambda o: (o["arm"] != e["arm"]) & (F.size(o["bag"]) > 0))
        agreeing = F.filter("all", lambda o: (o["arm"] != e["arm"]) & (F.size(o["bag"]) > 0) & (overlap_f1(e["bag"], o["bag"]) >= AGREE_AT))
        share = F.when(F.size(e["bag"]) > 0, F.coalesce(F.try_divide(F.size(agreeing), F.size(others)), F.lit(0.0))).otherwise(0.0)
        return F.struct(e["arm"].alias("arm"), share.alias("agree"))

    return arms.join(rows.select(key, F.explode(F.transform("all", rate)).alias("e")).select(key, "e.*"), [key, "arm"])


def _signals() -> dict[str, Column]:
    """Signals within [0, 1]; a missing one is 1 for gamma, faith and the probability, 0 for agreement."""
    defaults = {"gamma": 1.0, "agree": 0.0, "faith": 1.0, "p": 1.0}
    return {c: F.greatest(F.least(F.coalesce(F.col(c).cast("double"), F.lit(d)), F.lit(1.0)), F.lit(0.0)) for c, d in defaults.items()}


def arbitrate(arms: DataFrame, key: str) -> DataFrame:
    """``key, arm, answer, score, signal``: the arm with the best weighted signals (columns gamma, agree, faith, p).

    Uncertain answers score 0; ties go to the first arm by name, and where all are uncertain the longest answer wins.
    ``signal`` is the component that weighs most in the winning score (consensus before gamma before faith), or fallback.
    """
    v = _signals()
    certain = ~is_uncertain(F.col("answer"))
    score = F.when(certain, v["p"] * sum((w * v[c] for c, w in WEIGHTS.items()), F.lit(0.0))).otherwise(0.0)
    parts = [F.struct((v["p"] * WEIGHTS[c] * v[c]).alias("v"), F.lit(rank).alias("r"), F.lit(name).alias("n")) for rank, (c, name) in enumerate((("faith", "faith"), ("gamma", "gamma"), ("agree", "consensus")))]
    signal = let(F.greatest(*parts), lambda top: F.when(top["v"] > 0, top["n"]).otherwise("fallback"))
    rated = arms.withColumns({"certain": certain, "score": F.round(score + 1e-9, 6), "signal": F.when(certain, signal).otherwise("fallback")})
    length = F.when(F.col("certain"), 0).otherwise(F.length(F.coalesce("answer", F.lit(""))))
    order = Window.partitionBy(key).orderBy(F.desc("certain"), F.desc("score"), F.desc(length), "arm")
    return rated.withColumn("r", F.row_number().over(order)).where("r = 1").select(key, "arm", "answer", "score", "signal")


def fired(arms: DataFrame) -> DataFrame:
    """The arms that really answered: applicable (unless false), with an answer that is not empty and no fallback."""
    fallback = F.coalesce("is_fallback", F.lit(False)) if "is_fallback" in arms.columns else F.lit(False)
    return arms.where(F.coalesce("applicable", F.lit(True)) & (F.coalesce("answer", F.lit("")) != "") & ~fallback)


def arbitrate_pool(arms: DataFrame, key: str) -> DataFrame:
    """As ``arbitrate``, over fired arms only, and with their agreement among themselves, so that an arm that did not
    fire changes nothing. Questions without a fired arm have an empty arm and answer."""
    chosen = arbitrate(agreement(fired(arms), key), key)
    return arms.select(key).distinct().join(chosen, key, "left").na.fill({"arm": "", "answer": "", "score": 0.0, "signal": "fallback"})


def status_gamma(status: Column) -> Column:
    """The signal of a proof status: invalid 0, partial one half, valid 1, others missing."""
    return F.when(status == "invalid", 0.0).when(status == "partial", 0.5).when(status == "valid", 1.0)


def _rank() -> Column:
    rank = F.lit(len(PRIORITY))
    for i, a in enumerate(PRIORITY):
        rank = F.when(F.col("arm") == a, i).otherwise(rank)
    return rank


def probable(arms: DataFrame, key: str, mode: str = "argmax", threshold: float = 0.3) -> DataFrame:
    """``key, answer, reason`` by the arms' probabilities ``p``: the most probable certain answer (``argmax``), the same
    among those over the threshold (``subset``), or the answer whose equal forms have the most probability together
    (``weighted_mix``). Without a certain answer the first that is not empty wins. Ties go by the arms' priority."""
    if mode not in ("argmax", "subset", "weighted_mix"):
        raise ValueError(f"no mode {mode}")
    rated = arms.withColumns({"rank": _rank(), "p": F.coalesce("p", F.lit(0.0)), "given": F.coalesce("answer", F.lit(""))}).where("given <> ''").withColumn("certain", ~is_uncertain_normalised(F.col("answer")))
    own = Window.partitionBy(key, F.when(F.col("certain"), normalize_answer(F.col("answer"))))
    if mode == "weighted_mix":
        rated = rated.withColumns({
            "total": F.round(F.sum("p").over(own) + 1e-9, 6), "top": F.min(F.struct(-F.col("p"), "rank")).over(own), "first": F.min(F.struct("rank", "answer")).over(own),
        }).withColumns({"order": F.struct(-F.col("total"), F.col("top.rank").alias("r")), "answer": F.when(F.col("certain"), F.col("first.answer")).otherwise(F.col("answer"))})
    elif mode == "subset":
        rated = rated.withColumn("order", F.struct((F.col("p") <= threshold).cast("double").alias("out"), -F.col("p"), "rank"))
    else:
        rated = rated.withColumn("order", F.struct(-F.col("p"), "rank"))
    last = F.when(F.col("certain"), F.col("order")).otherwise(F.lit(None))
    best = Window.partitionBy(key).orderBy(F.desc("certain"), F.asc_nulls_last(last), "rank", "arm")
    top = rated.withColumn("n", F.row_number().over(best)).where("n = 1")
    label = {"argmax": F.lit("argmax"), "subset": F.when(F.col("p") > threshold, "subset").otherwise("subset_fallback_argmax"), "weighted_mix": F.lit("weighted_mix")}[mode]
    found = top.select(key, "answer", F.when(F.col("certain"), F.concat_ws(":", label, "arm") if mode != "weighted_mix" else label).otherwise(F.concat_ws(":", F.lit("all_uncertain"), "arm")).alias("reason"))
    return arms.select(key).distinct().join(found, key, "left").na.fill({"answer": "", "reason": "no_answers"})


def weighted_vote(arms: DataFrame, key: str) -> DataFrame:
    """``key, answer, votes, weight``: equal certain answers pool their weights ``p``; the heaviest pool wins, ties by the
    priority of the most probable arm. ``answer`` is the pool's first form by priority."""
    rated = arms.where(~is_uncertain_normalised(F.col("answer"))).withColumn("rank", _rank())
    pooled = rated.groupBy(key, normalize_answer(F.col("answer")).alias("norm")).agg(
        F.count(F.lit(1)).alias("votes"), F.round(F.sum("p") + 1e-9, 6).alias("weight"), F.min(F.struct(-F.col("p"), "rank")).alias("top"), F.min(F.struct("rank", "answer")).alias("first")
    )
    order = Window.partitionBy(key).orderBy(F.desc("weight"), "top.rank", "norm")
    return pooled.withColumn("r", F.row_number().over(order)).where("r = 1").select(key, F.col("first.answer").alias("answer"), "votes", "weight")


def gamma_pool(arms: DataFrame, key: str, high: float = 0.66, low: float = 0.33) -> DataFrame:
    """``key, answer, band, gamma``: only the best occupied band of gamma counts (a missing gamma is 0); answers pool,
    ties by members then text."""
    gamma = F.coalesce("gamma", F.lit(0.0))
    banded = arms.withColumn("gamma", gamma).withColumn("band", F.when(F.col("gamma") >= high, 2).when(F.col("gamma") >= low, 1).otherwise(0))
    top = banded.groupBy(key).agg(F.max("band").alias("band"))
    pooled = banded.join(top, [key, "band"]).groupBy(key, "band", normalize_answer(F.col("answer")).alias("answer")).agg(F.round(F.sum("gamma"), 6).alias("total"), F.count(F.lit(1)).alias("n"), F.round(F.avg("gamma"), 6).alias("gamma"))
    order = Window.partitionBy(key).orderBy(F.desc("total"), F.desc("n"), F.desc("answer"))
    return pooled.withColumn("r", F.row_number().over(order)).where("r = 1").select(key, "answer", "band", "gamma")


def selective(first: Column, second: Column, question: Column | None = None) -> tuple[Column, Column]:
    """The answer of the two-arm rule and its reason: certain before uncertain, agreement, the second arm where the
    question asks for a second fact, the longer of answers that overlap by half, else the first."""
    first, second = F.coalesce(first, F.lit("")), F.coalesce(second, F.lit(""))
    u1, u2 = is_uncertain_normalised(first), is_uncertain_normalised(second)
    same = normalize_answer(first) == normalize_answer(second)
    second_fact = F.lit(False) if question is None else asks_second_fact(question)
    longer = F.when(F.length(first) >= F.length(second), first).otherwise(second)
    near = token_f1(first, second) >= 0.5
    answer = F.when(u1 & ~u2, second).when(u1 | u2 | same, first).when(second_fact, second).when(near, longer).otherwise(first)
    reason = (
        F.when(u1 & ~u2, "first-uncertain").when(u1, "both-uncertain").when(u2, "second-uncertain").when(same, "agree").when(second_fact, "second-fact")
        .when(near, F.when(longer == first, "first-longer").otherwise("second-longer")).otherwise("first")
    )
    return answer, reason


def routed(v3bu: Column, decompose: Column, iterative: Column, question: Column, label: Column) -> tuple[Column, Column]:
    """The answer by question class, and its reason: the iterative arm for deep chains, the decomposing one for bridges
    (each with the next arm where it is uncertain), else the two-arm rule."""
    unsure = is_uncertain_normalised
    answer, reason = selective(v3bu, decompose, question)
    deep, bridge = label == "chain_deep", label == "bridge_entity"
    chosen = F.when(deep, F.when(~unsure(iterative), iterative).when(~unsure(decompose), decompose).otherwise(v3bu)).when(bridge, F.when(~unsure(decompose), decompose).otherwise(v3bu)).otherwise(answer)
    why = (
        F.when(deep, F.when(~unsure(iterative), "chain:iter").when(~unsure(decompose), "chain:decompose").otherwise("chain:v3bu"))
        .when(bridge, F.when(~unsure(decompose), "bridge:decompose").otherwise("bridge:v3bu")).otherwise(F.concat(F.lit("rule:"), reason))
    )
    return F.coalesce(chosen, F.lit("")), why


def without_single_shot(decompose: Column, iterative: Column, fallback: Column, question: Column, label: Column) -> tuple[Column, Column]:
    """The answer and reason where the single-shot arm is excluded: by class the iterative or the decomposing arm first,
    the two-arm rule of both for other questions, and the single-shot answer as a last resort."""
    sure = lambda c: ~is_uncertain_normalised(c)
    last, last_why = F.when(sure(fallback), fallback).otherwise(F.coalesce(decompose, F.lit(""))), F.when(sure(fallback), "last:v3bu").otherwise("last:uncertain")
    answer, reason = selective(iterative, decompose, question)
    by = {
        "chain_deep": [(sure(iterative), iterative, F.lit("chain:iter")), (sure(decompose), decompose, F.lit("chain:decompose"))],
        "bridge_entity": [(sure(decompose), decompose, F.lit("bridge:decompose")), (sure(iterative), iterative, F.lit("bridge:iter"))],
        "semantic_rich": [(sure(iterative), answer, F.concat(F.lit("rich:"), reason)), (sure(decompose), decompose, F.lit("rich:decompose"))],
    }
    chosen, why = last, last_why
    for kind, options in by.items():
        for test, value, name in reversed(options):
            chosen, why = F.when((label == kind) & test, value).otherwise(chosen), F.when((label == kind) & test, name).otherwise(why)
    return chosen, why


def retry(chosen: Column, *fallbacks: Column) -> tuple[Column, Column]:
    """A cascade: the chosen answer unless uncertain, else the first fallback that is certain; with its step. Where none
    is, the chosen answer as it is, or the first fallback that is not empty."""
    answer, step = F.when(~is_uncertain_fallback(chosen), chosen), F.when(~is_uncertain_fallback(chosen), 0)
    for i, f in enumerate(fallbacks, 1):
        answer, step = F.coalesce(answer, F.when(~is_uncertain_fallback(f), f)), F.coalesce(step, F.when(~is_uncertain_fallback(f), i))
    return F.coalesce(answer, *[F.nullif(c, F.lit("")) for c in (chosen, *fallbacks)], F.lit("")), F.coalesce(step, F.lit(-1))


def longest_other(chosen: Column, *answers: Column) -> Column:
    """The longest certain answer of another arm that differs from the chosen one, the first of equally long ones; or null."""
    fit = [F.when(~is_uncertain_fallback(a) & ~a.eqNullSafe(chosen), F.struct(F.length(a).alias("n"), F.lit(-i).alias("i"), a.alias("a"))) for i, a in enumerate(answers)]
    return F.greatest(*fit)["a"]


def suppress(answer: Column, status: Column) -> Column:
    """Whether the cascade is cut short: the proof is invalid, yet the answer has substance."""
    return F.coalesce(status == "invalid", F.lit(False)) & has_substance(answer)


def abstention_signal(chosen: Column, reason: Column, cancelled: Column | None = None, disagree: Column | None = None) -> Column:
    """The kind of an abstention: by words of the reason, then by cancelled or disagreeing arms, then an empty answer; or null."""
    r = F.lower(F.coalesce(reason, F.lit("")))
    return (
        F.when(r.rlike("gamma|γ"), "gamma_refuse").when(r.rlike("h4|refuse"), "h4_refuse").when(r.rlike("h12|how_many"), "h12_refuse")
        .when(F.lit(False) if cancelled is None else cancelled, "iter_abstain").when(F.lit(False) if disagree is None else disagree, "cross_arm_disagree")
        .when(is_abstention(chosen), "empty_answer")
    )


def consensus(first: Column, second: Column, third: Column, alike) -> Column:
    """The longest answer of the largest group of similar ones among three arms; null where no two are similar.

    ``alike`` compares two answers. Groups are stars: answers join the first free one that they resemble. Ties of size
    cannot occur among three answers, as a group needs two.
    """
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    pair = lambda a, b: given(a) & given(b) & alike(a, b)
    ab, ac, bc = pair(first, second), pair(first, third), pair(second, third)
    member = [ab | ac, ab | (bc & ~ac), ac | (bc & ~ab)]
    entries = [F.when(m, F.struct(F.length(c).alias("n"), F.lit(-i).alias("i"), c.alias("a"))) for i, (m, c) in enumerate(zip(member, (first, second, third)))]
    return F.greatest(*entries)["a"]


def other_answers(chosen: Column, *answers: Column) -> Column:
    """The distinct answers, by normalised form, that are neither empty nor the chosen one; first forms in their order."""
    every = F.filter(F.array(*answers), lambda a: a.isNotNull() & ~normalize_answer(a).isin("") & (normalize_answer(a) != normalize_answer(chosen)))
    return let(every, lambda xs: F.filter(xs, lambda x, i: F.array_position(F.transform(xs, normalize_answer), normalize_answer(x)) == i + 1))


def phases(vectors: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """``group, key, kept``: candidates whose projection on the group's centroid reaches the median are kept, the others cancel.

    Sums and medians are taken per group with partial aggregation; groups of one keep their only candidate.
    """
    own = vectors.where(F.col(vector).isNotNull()).select(group, key, F.col(vector).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) + 1e-9
    unit = own.withColumn("l", length).select(group, key, F.posexplode(F.transform("v", lambda x: x.cast("double") / F.col("l"))).alias("pos", "x"))
    centre = unit.groupBy(group, "pos").agg(F.avg("x").alias("m"))
    projected = unit.join(centre, [group, "pos"]).groupBy(group, key).agg(F.round(F.sum(F.col("x") * F.col("m")), 9).alias("projection"))
    middle = exact_percentiles(projected, [group], "projection", [0.5], linear=True).select(group, F.col("projection").alias("median"))
    return projected.join(middle, group).select(group, key, (F.col("projection") >= F.col("median") - 1e-9).alias("kept"))
