"""Proofs of answers: steps checked against the passages that they cite, by five rules, and the status of the whole.

A tree is a row ``key, steps, is_complete, answer``. ``steps`` is an array of ``STEP``; it holds what one model call
wrote, so it is short, and is folded inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions.text import SPACE, let

STEP = "struct<step:int,rule:string,predicate:string,subject:string,object:string,claim:string,doc_id:string,span:string,inputs:array<int>,type_tag:string>"
# Predicates that chain, kinds of order, and answers that say that there is no proof.
TRANSITIVE = ["located_in", "subset_of", "instance_of"]
ORDERED = ["temporal", "numeric"]
REFUSED = ["REFUSE_NO_PROOF", "REFUSE_PARSE_FAILURE"]


def squashed(text: Column) -> Column:
    """Lower case, single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"{SPACE}+", " "))


def plain(text: Column) -> Column:
    """Lower case without ASCII punctuation, single blanks."""
    return squashed(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[!-/:-@\[-`{-~]", ""))


def any_token_in(needle: Column, hay: Column) -> Column:
    """Whether a word of three letters or more of one plain text stands in another; true if there is none."""
    words = F.filter(F.split(needle, " "), lambda w: F.length(w) > 2)
    return (F.size(words) == 0) | F.arrays_overlap(words, F.split(hay, " "))


def overlap(a: Column, b: Column) -> Column:
    """The share of the words of two letters or more of one plain text that stand in another; 1 if there is none."""
    words = F.array_distinct(F.filter(F.split(a, " "), lambda w: F.length(w) > 1))
    return F.when(F.size(words) == 0, 1.0).otherwise(F.size(F.array_intersect(words, F.split(b, " "))) / F.size(words))


def lookup_reason(step: Column, passage: Column, relaxed: bool = False) -> Column:
    """Why a lookup is invalid, or ``valid``: its source must be given and known, its span stand there word for word, its
    subject be in the passage, its object in the span (all of its words in the passage if relaxed), its claim say something."""
    span, text = plain(step["span"]), plain(passage)
    words = F.filter(F.split(plain(step["object"]), " "), lambda w: F.length(w) > 1)
    grounded = (F.size(F.array_except(words, F.split(text, " "))) == 0) if relaxed else any_token_in(plain(step["object"]), span)
    given = lambda c: F.coalesce(step[c], F.lit("")) != ""
    return (
        F.when(step["doc_id"].isNull(), "no source").when(passage.isNull(), "unknown source")
        .when((squashed(step["span"]) == "") | ~F.contains(squashed(passage), squashed(step["span"])), "span not found")
        .when(given("subject") & ~any_token_in(plain(step["subject"]), text), "subject not grounded")
        .when(given("object") & ~grounded, "object not grounded").when(plain(step["claim"]) == "", "empty claim").otherwise("valid")
    )


def _derived(step: Column, known: Column) -> Column:
    """The status of a step that is no lookup, from the steps before it (``step, status, subject, object``)."""
    of = lambda i: F.try_element_at(F.filter(known, lambda k: k["step"] == i), F.lit(-1))
    inputs = F.coalesce(step["inputs"], F.array().cast("array<int>"))
    sound = F.forall(inputs, lambda i: F.coalesce(of(i)["status"] == "valid", F.lit(False)))
    first, second = of(F.get(inputs, 0)), of(F.get(inputs, 1))
    end, start = plain(first["object"]), plain(second["subject"])
    bridge = (end == "") | (start == "") | any_token_in(end, start)
    ok = (
        F.when(step["rule"] == "conjunction", (F.size(inputs) >= 2) & sound)
        .when(step["rule"] == "transitivity", (F.size(inputs) == 2) & sound & step["predicate"].isin(TRANSITIVE) & bridge)
        .when(step["rule"] == "comparison_before", step["type_tag"].isin(ORDERED) & (F.size(inputs) == 2) & sound)
        .otherwise(step["rule"] == "negation_as_failure")
    )
    return F.when(F.coalesce(ok, F.lit(False)), "valid").otherwise("invalid")


def verify(trees: DataFrame, key: str, passages: DataFrame, relaxed: bool = False) -> DataFrame:
    """``key, status, liberal, checked``: the status of every tree, strict and liberal, and its steps with their own ones
    (``step, rule, status, reason``). ``passages`` has ``doc_id, text``; a passage that comes twice counts once.

    Lookups meet the passages by an equi-join; the other rules are folded over the steps in their order, so that a step
    sees only those before it. ``refuse``: nothing but refusals; ``invalid``: an invalid step; ``valid`` or ``partial``:
    complete or not. Liberal: with a valid lookup, the answer may rest on any step that shares half of its words.
    """
    held = passages.groupBy(F.col("doc_id").alias("__doc")).agg(F.max("text").alias("__text"))
    each = trees.select(key, F.posexplode("steps").alias("__at", "s"))
    looked = each.join(held, F.when(F.col("s.rule") == "lookup", F.col("s.doc_id")) == F.col("__doc"), "left")
    reason = F.when(F.col("s.rule") == "lookup", lookup_reason(F.col("s"), F.col("__text"), relaxed))
    ordered = looked.select(key, "__at", "s", reason.alias("why")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__at", "s", "why"))).alias("all"))
    none = F.array().cast("array<struct<step:int,rule:string,status:string,reason:string,subject:string,object:string>>")

    def step(done: Column, x: Column) -> Column:
        s = x["s"]
        status = F.when(s["rule"] == "lookup", F.when(x["why"] == "valid", "valid").otherwise("invalid")).otherwise(_derived(s, done))
        return F.array_append(done, F.struct(s["step"].alias("step"), s["rule"].alias("rule"), status.alias("status"), F.coalesce(x["why"], status).alias("reason"), s["subject"].alias("subject"), s["object"].alias("object")))

    folded = ordered.select(key, "all", F.aggregate("all", none, step).alias("checked"))
    rows = trees.select(key, "is_complete", "answer").join(folded, key, "left")
    checked = F.coalesce("checked", none)
    refusal, bad = F.exists(checked, lambda c: c["rule"] == "negation_as_failure"), F.exists(checked, lambda c: c["status"] == "invalid")
    complete = F.coalesce("is_complete", F.lit(False))
    strict = (
        F.when(refusal & F.forall(checked, lambda c: c["rule"] == "negation_as_failure"), "refuse").when(bad, "invalid").when(complete, "valid").otherwise("partial")
    )
    said = F.flatten(F.transform("all", lambda x: F.array(x["s"]["object"], x["s"]["claim"], x["s"]["span"])))
    best = let(plain(F.col("answer")), lambda a: F.coalesce(F.array_max(F.transform(F.filter(F.transform(said, plain), lambda t: t != ""), lambda t: overlap(a, t))), F.lit(0.0)))
    grounded = F.exists(checked, lambda c: (c["rule"] == "lookup") & (c["status"] == "valid"))
    liberal = (
        F.when(F.size(checked) == 0, "invalid").when(F.col("answer").isin(REFUSED), "refuse").when(~grounded, F.when(bad, "invalid").otherwise("valid")).when(plain(F.col("answer")) == "", "partial")
        .when(best >= 0.5, "valid").when(best >= 0.25, "partial").otherwise("invalid")
    )
    return rows.select(key, strict.alias("status"), liberal.alias("liberal"), F.transform(checked, lambda c: F.struct(c["step"].alias("step"), c["rule"].alias("rule"), c["status"].alias("status"), c["reason"].alias("reason"))).alias("checked"))


def parse_tree(raw: Column) -> Column:
    """``struct<steps, is_complete, answer>`` of a proof tree in JSON (see ``parsing.balanced_object``); sources may stand
    under ``source`` or ``sources``, as objects or as bare ids. Null if the text holds no tree."""
    v = F.try_parse_json(raw)
    get = lambda x, p, t="string": F.try_variant_get(x, p, t)

    def one(x: Column) -> Column:
        src = F.coalesce(get(x, "$.sources[0]", "variant"), get(x, "$.sources", "variant"), get(x, "$.source", "variant"))
        bare = F.schema_of_variant(src) == "STRING"
        return F.struct(
            F.coalesce(get(x, "$.step", "int"), F.lit(0)).alias("step"), F.coalesce(get(x, "$.rule"), F.lit("")).alias("rule"), get(x, "$.predicate").alias("predicate"), get(x, "$.subject").alias("subject"),
            get(x, "$.object").alias("object"), F.coalesce(get(x, "$.claim_text"), F.lit("")).alias("claim"), F.when(bare, F.trim(get(src, "$"))).otherwise(get(src, "$.doc_id")).alias("doc_id"),
            F.when(bare, "").otherwise(F.coalesce(get(src, "$.span_text"), F.lit(""))).alias("span"), F.coalesce(get(x, "$.inputs", "array<int>"), F.array().cast("array<int>")).alias("inputs"), get(x, "$.type_tag").alias("type_tag"),
        )

    steps = F.transform(F.filter(F.coalesce(get(v, "$.steps", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x).startswith("OBJECT")), one)
    answer = F.coalesce(*[F.nullif(get(v, f"$.{k}"), F.lit("")) for k in ("naturalized_answer", "naturalised_answer", "answer")], F.lit(""))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.struct(steps.alias("steps"), F.coalesce(get(v, "$.is_complete", "boolean"), F.lit(False)).alias("is_complete"), answer.alias("answer")))
