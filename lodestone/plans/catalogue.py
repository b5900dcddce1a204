"""The registered queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lodestone.functions import text as T
from lodestone.operators import arbitration as A, evidence as E, extract as X, graph as G, index as I, ingest as N, metrics as M, ranking as R, search as S
from lodestone.plans import pipelines as P, questions as PQ
from lodestone.plans.registry import F1, ONCE, ORACLES, QUERIES, SET_F1, key as _key, norm as _norm, plain, query, strip as _strip, substantial, tokens as _tokens, uncertain, uncertain_fallback, uncertain_normalised
from lodestone.session import cut, load
from lodestone.sources.loaders import record_text
from lodestone.streaming.upserts import stream_latest, windowed_counts

FLAGSHIP = "answer_batch"


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return P.answers_once(load(spark, d, "selective_answers"))


# answers and their scores


@query(f"SELECT answer_id, {_norm('pred')} AS pred_norm, {_norm('gold')} AS gold_norm FROM ({ONCE})")
def normalized_answers(spark, d):
    return _answers(spark, d).select("answer_id", T.normalize_answer(F.col("pred")).alias("pred_norm"), T.normalize_answer(F.col("gold")).alias("gold_norm"))


@query(f"""WITH t AS (SELECT answer_id, {_tokens('pred')} AS p, {_tokens('gold')} AS g FROM ({ONCE}))
SELECT answer_id, (array_to_string(p, ' ') = array_to_string(g, ' '))::DOUBLE AS exact, round({F1}, 6) AS f1, round({SET_F1}, 6) AS set_f1 FROM t""")
def answer_scores(spark, d):
    p, g = F.col("pred"), F.col("gold")
    return _answers(spark, d).select("answer_id", T.exact_match(p, g).alias("exact"), F.round(T.token_f1(p, g), 6).alias("f1"), F.round(T.set_f1(p, g), 6).alias("set_f1"))


@query(f"""WITH t AS (SELECT answer_id, {_tokens('pred')} AS p, unnest([gold, v3bu_pred]) AS alias FROM ({ONCE})), s AS (SELECT answer_id, p, {_tokens('alias')} AS g FROM t)
SELECT answer_id, max((array_to_string(p, ' ') = array_to_string(g, ' '))::DOUBLE) AS best_exact, max(round({F1}, 6)) AS best_f1 FROM s GROUP BY answer_id""")
def best_over_aliases(spark, d):
    p = F.col("pred")
    return _answers(spark, d).select("answer_id", *[F.greatest(*[F.round(f(p, F.col(a)), 6) for a in ("gold", "v3bu_pred")]).alias(n) for n, f in (("best_exact", T.exact_match), ("best_f1", T.token_f1))])


@query(f"""SELECT answer_id, {_strip('pred')} IN ('', 'not in passages', 'i don''t know', 'i do not know', 'unknown', 'no answer', 'cannot answer', 'none') AS abstains, {uncertain('pred')} AS uncertain, {uncertain_normalised('pred')} AS uncertain_normalised,
{uncertain_fallback('pred')} AS uncertain_fallback, {_strip('pred')} = '' OR regexp_matches({_strip('pred')}, 'not in passages|not in the passages|no answer|cannot determine|i don''t know|i do not know') AS unfaithful, {substantial('pred')} AS substantial FROM ({ONCE})""")
def answer_predicates(spark, d):
    a = F.col("pred")
    tests = {"abstains": T.is_abstention, "uncertain": T.is_uncertain, "uncertain_normalised": T.is_uncertain_normalised, "uncertain_fallback": T.is_uncertain_fallback, "unfaithful": T.is_unfaithful, "substantial": T.has_substance}
    return _answers(spark, d).select("answer_id", *[f(a).alias(n) for n, f in tests.items()])


@query(f"""WITH w AS (SELECT answer_id, list_filter(list_distinct(string_split(trim(regexp_replace(lower(coalesce(pred, '')), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda x: x <> '') AS p, list_filter(list_distinct(string_split(trim(regexp_replace(lower(coalesce(gold, '')), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda x: x <> '') AS g FROM ({ONCE})),
f AS (SELECT answer_id, CASE WHEN len(p) = 0 OR len(g) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(p, g)) / (len(p) + len(g)) END AS f FROM w) SELECT answer_id, round(f, 6) AS set_f1, (f >= 0.7)::INT AS soft FROM f""")
def soft_matches(spark, d):
    """The set F1 of the ASCII keys, and whether it reaches the threshold of a soft match."""
    f = T.set_f1_plain(F.col("pred"), F.col("gold"))
    return _answers(spark, d).select("answer_id", F.round(f, 6).alias("set_f1"), (f >= 0.7).cast("int").alias("soft"))


_RULE = f"""rule AS (SELECT *, {uncertain_normalised('a')} AS u1, {uncertain_normalised('b')} AS u2, array_to_string(p, ' ') = array_to_string(g, ' ') AS same, {PQ.SECOND_FACT} AS second_fact, {F1} >= 0.5 AS near FROM pair),
chosen_by_rule AS (SELECT *, CASE WHEN u1 AND NOT u2 THEN b WHEN u1 OR u2 OR same THEN a WHEN second_fact THEN b WHEN near AND length(b) > length(a) THEN b ELSE a END AS rule_answer,
CASE WHEN u1 AND NOT u2 THEN 'first-uncertain' WHEN u1 THEN 'both-uncertain' WHEN u2 THEN 'second-uncertain' WHEN same THEN 'agree' WHEN second_fact THEN 'second-fact' WHEN near AND length(b) > length(a) THEN 'second-longer' WHEN near THEN 'first-longer' ELSE 'first' END AS rule_reason FROM rule)"""


def _pair(first: str, second: str, more: str = "") -> str:
    return f"pair AS (SELECT answer_id, coalesce({first}, '') AS a, coalesce({second}, '') AS b, {plain('question')} AS t, {_tokens(first)} AS p, {_tokens(second)} AS g{more} FROM ({ONCE}))"


@query(f"WITH {_pair('v3bu_pred', 'dec_pred')}, {_RULE} SELECT answer_id, rule_answer AS answer, rule_reason AS reason FROM chosen_by_rule")
def selective_rule(spark, d):
    answer, reason = A.selective(F.col("v3bu_pred"), F.col("dec_pred"), F.col("question"))
    return _answers(spark, d).select("answer_id", answer.alias("answer"), reason.alias("reason"))


@query(f"""WITH {PQ.FEATURES}, {_pair('v3bu_pred', 'dec_pred', ', pred')}, {_RULE}, j AS (SELECT c.*, cohort, {uncertain_normalised('pred')} AS u3 FROM chosen_by_rule c JOIN classes USING (answer_id))
SELECT answer_id, coalesce(CASE cohort WHEN 'chain_deep' THEN CASE WHEN NOT u3 THEN pred WHEN NOT u2 THEN b ELSE a END WHEN 'bridge_entity' THEN CASE WHEN NOT u2 THEN b ELSE a END ELSE rule_answer END, '') AS answer,
CASE cohort WHEN 'chain_deep' THEN CASE WHEN NOT u3 THEN 'chain:iter' WHEN NOT u2 THEN 'chain:decompose' ELSE 'chain:v3bu' END WHEN 'bridge_entity' THEN CASE WHEN NOT u2 THEN 'bridge:decompose' ELSE 'bridge:v3bu' END ELSE 'rule:' || rule_reason END AS reason FROM j""")
def routed_answers(spark, d):
    """Answers by the class of the question."""
    j = _answers(spark, d).join(PQ.question_cohorts(spark, d), "answer_id")
    answer, reason = A.routed(F.col("v3bu_pred"), F.col("dec_pred"), F.col("pred"), F.col("question"), F.col("cohort"))
    return j.select("answer_id", answer.alias("answer"), reason.alias("reason"))


@query(f"""WITH {PQ.FEATURES}, {_pair('pred', 'dec_pred', ', v3bu_pred')}, {_RULE}, j AS (SELECT c.*, cohort, {uncertain_normalised('v3bu_pred')} AS u3 FROM chosen_by_rule c JOIN classes USING (answer_id))
SELECT answer_id, CASE WHEN cohort = 'chain_deep' AND NOT u1 THEN a WHEN cohort = 'chain_deep' AND NOT u2 THEN b WHEN cohort = 'bridge_entity' AND NOT u2 THEN b WHEN cohort = 'bridge_entity' AND NOT u1 THEN a
WHEN cohort = 'semantic_rich' AND NOT u1 THEN rule_answer WHEN cohort = 'semantic_rich' AND NOT u2 THEN b WHEN NOT u3 THEN v3bu_pred ELSE b END AS answer,
CASE WHEN cohort = 'chain_deep' AND NOT u1 THEN 'chain:iter' WHEN cohort = 'chain_deep' AND NOT u2 THEN 'chain:decompose' WHEN cohort = 'bridge_entity' AND NOT u2 THEN 'bridge:decompose' WHEN cohort = 'bridge_entity' AND NOT u1 THEN 'bridge:iter'
WHEN cohort = 'semantic_rich' AND NOT u1 THEN 'rich:' || rule_reason WHEN cohort = 'semantic_rich' AND NOT u2 THEN 'rich:decompose' WHEN NOT u3 THEN 'last:v3bu' ELSE 'last:uncertain' END AS reason FROM j""")
def excluded_single_shot(spark, d):
    """Answers where the single-shot arm is excluded."""
    j = _answers(spark, d).join(PQ.question_cohorts(spark, d), "answer_id")
    answer, reason = A.without_single_shot(F.col("dec_pred"), F.col("pred"), F.col("v3bu_pred"), F.col("question"), F.col("cohort"))
    return j.select("answer_id", answer.alias("answer"), reason.alias("reason"))


@query(f"""SELECT decision, count(*) AS n, round(avg(em), 6) AS mean_em, round(avg(f1), 6) AS mean_f1, round(avg(coalesce(soft_em, em)), 6) AS mean_soft,
round(avg(coalesce(soft_em, em)) - avg(em), 6) AS gain, sum(({uncertain('pred')})::INT)::BIGINT AS n_uncertain FROM ({ONCE}) GROUP BY decision""")
def decision_report(spark, d):
    soft = F.coalesce("soft_em", "em")
    return _answers(spark, d).groupBy("decision").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("em"), 6).alias("mean_em"), F.round(F.avg("f1"), 6).alias("mean_f1"), F.round(F.avg(soft), 6).alias("mean_soft"),
        F.round(F.avg(soft) - F.avg("em"), 6).alias("gain"), F.sum(T.is_uncertain(F.col("pred")).cast("int")).alias("n_uncertain"),
    )


# arbitration

ARM_SQL = f"""{PQ.PROBABLE}, arms AS (SELECT answer_id, qid, arm, answer, {_tokens('answer')} AS p, w FROM (
SELECT answer_id, qid, unnest([{{'arm': 'v3bu', 'answer': v3bu_pred, 'w': v3bu}}, {{'arm': 'decompose', 'answer': dec_pred, 'w': decompose}}, {{'arm': 'iter', 'answer': pred, 'w': iter}}], recursive := true) FROM ({ONCE}) JOIN (SELECT answer_id, v3bu, decompose, iter FROM probable) USING (answer_id))),
said AS (SELECT qid, list_distinct(flatten(list({_tokens('text')}))) AS words FROM reader_responses WHERE qid IS NOT NULL AND text IS NOT NULL GROUP BY qid),
signals AS (SELECT answer_id, arm, answer, p, w, CASE WHEN words IS NOT NULL THEN round(len(list_filter(list_distinct(p), lambda t: list_contains(words, t))) / nullif(len(list_distinct(p)), 0), 6) END AS gamma FROM arms LEFT JOIN (SELECT qid, words FROM said WHERE len(words) > 0) USING (qid))"""


def _agree(of: str) -> str:
    return f"""pairs AS (SELECT a.answer_id, a.arm, a.p, b.p AS g FROM {of} a JOIN {of} b ON a.answer_id = b.answer_id AND a.arm <> b.arm WHERE len(a.p) > 0 AND len(b.p) > 0),
agreed AS (SELECT answer_id, arm, avg((({SET_F1}) >= 0.7)::INT) AS share FROM pairs GROUP BY ALL),
agree AS (SELECT a.answer_id, a.arm, coalesce(share, 0.0) AS agree FROM {of} a LEFT JOIN agreed USING (answer_id, arm))"""


def _arms(spark, d):
    return P.arm_table(_answers(spark, d), load(spark, d, "reader_responses"))


@query(f"WITH {ARM_SQL} SELECT answer_id, arm, gamma, round(w, 6) AS p FROM signals")
def arm_signals(spark, d):
    """What speaks for each arm's answer without looking at labels: its words in the responses, and the arm's probability."""
    return _arms(spark, d).select("answer_id", "arm", "gamma", F.round("p", 6).alias("p"))


@query(f"WITH {ARM_SQL}, {_agree('arms')} SELECT answer_id, arm, round(agree, 6) AS agree FROM agree")
def arm_agreement(spark, d):
    return A.agreement(_arms(spark, d), "answer_id").select("answer_id", "arm", F.round("agree", 6).alias("agree"))


def _rated(of: str) -> str:
    return f"""parts AS (SELECT answer_id, arm, answer, {uncertain('answer')} AS unsure, least(w, 1.0) AS w, coalesce(gamma, 1.0) AS gamma, agree FROM {of} JOIN agree USING (answer_id, arm)),
rated AS (SELECT *, round(CASE WHEN unsure THEN 0.0 ELSE w * (gamma + 0.5 * agree + 0.3) END + 1e-9, 6) AS score, CASE WHEN unsure THEN 'fallback' WHEN w * 0.5 * agree > 0 AND 0.5 * agree >= gamma AND 0.5 * agree >= 0.3 THEN 'consensus' WHEN gamma >= 0.3 THEN 'gamma' ELSE 'faith' END AS signal FROM parts),
chosen AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY answer_id ORDER BY unsure, score DESC, CASE WHEN unsure THEN length(coalesce(answer, '')) ELSE 0 END DESC, arm) = 1)"""


ARBITRATED = f"WITH {ARM_SQL}, {_agree('arms')}, {_rated('signals')}"


@query(f"{ARBITRATED} SELECT answer_id, arm, answer, score, signal FROM chosen")
def arbitrated_answers(spark, d):
    return A.arbitrate(A.agreement(_arms(spark, d), "answer_id"), "answer_id")


@query(f"""WITH {ARM_SQL}, fit AS (SELECT answer_id, polar > 0 AS f1, two_entities > 0 AS f2, chain > 0 AS f3 FROM scores), fired AS (SELECT s.* FROM signals s JOIN fit USING (answer_id)
WHERE coalesce(answer, '') <> '' AND (arm <> 'iter' OR f3 OR NOT (f1 OR f2)) AND (arm <> 'decompose' OR f2 OR NOT (f1 OR f3)) AND (arm <> 'v3bu' OR f1 OR NOT (f2 OR f3))), {_agree('fired')}, {_rated('fired')}
SELECT answer_id, coalesce(arm, '') AS arm, coalesce(answer, '') AS answer, coalesce(score, 0.0) AS score, coalesce(signal, 'fallback') AS signal FROM (SELECT DISTINCT answer_id FROM arms) LEFT JOIN chosen USING (answer_id)""")
def pool_answers(spark, d):
    """Arbitration among the arms that take the question for theirs, or all arms where none does."""
    fit = PQ.arm_applicability(spark, d).select("answer_id", F.array(*[F.struct(F.lit(a).alias("a"), F.col(a).alias("v")) for a in P.ARMS]).alias("fit"))
    own = F.exists("fit", lambda x: (x["a"] == F.col("arm")) & x["v"])
    arms = _arms(spark, d).join(fit, "answer_id").withColumn("applicable", own | ~F.exists("fit", lambda x: x["v"])).drop("fit")
    return A.arbitrate_pool(arms, "answer_id")


@query(f"""WITH {ARM_SQL}, r AS (SELECT *, CASE arm WHEN 'v3bu' THEN 0 WHEN 'decompose' THEN 1 ELSE 2 END AS rank FROM arms WHERE NOT {uncertain_normalised('answer')}),
pooled AS (SELECT answer_id, array_to_string(p, ' ') AS n, count(*) AS votes, round(sum(round(w, 9)) + 1e-9, 6) AS weight, min((-round(w, 9), rank)) AS top, arg_min(answer, rank) AS answer FROM r GROUP BY ALL)
SELECT answer_id, answer, votes, weight FROM pooled QUALIFY row_number() OVER (PARTITION BY answer_id ORDER BY weight DESC, top[2], n) = 1""")
def weighted_vote(spark, d):
    return A.weighted_vote(_arms(spark, d), "answer_id")


_PROBABLE = f"""r AS (SELECT answer_id, arm, coalesce(answer, '') AS answer, array_to_string(p, ' ') AS n, round(w, 9) AS w, CASE arm WHEN 'v3bu' THEN 0 WHEN 'decompose' THEN 1 ELSE 2 END AS rank FROM arms), given AS (SELECT *, n NOT IN ('', 'not in passages', 'unknown', 'no answer', 'none') AS sure FROM r WHERE answer <> '')"""


@query(f"""WITH {ARM_SQL}, {_PROBABLE}, best AS (SELECT * FROM given QUALIFY row_number() OVER (PARTITION BY answer_id ORDER BY sure DESC, CASE WHEN sure THEN -w END, rank) = 1)
SELECT answer_id, coalesce(answer, '') AS answer, CASE WHEN arm IS NULL THEN 'no_answers' WHEN sure THEN 'argmax:' || arm ELSE 'all_uncertain:' || arm END AS reason FROM (SELECT DISTINCT answer_id FROM arms) LEFT JOIN best USING (answer_id)""")
def most_probable_answers(spark, d):
    return A.probable(_arms(spark, d), "answer_id")


@query(f"""WITH {ARM_SQL}, {_PROBABLE}, best AS (SELECT * FROM given QUALIFY row_number() OVER (PARTITION BY answer_id ORDER BY sure DESC, CASE WHEN sure THEN (w <= 0.5)::INT END, CASE WHEN sure THEN -w END, rank) = 1)
SELECT answer_id, coalesce(answer, '') AS answer, CASE WHEN arm IS NULL THEN 'no_answers' WHEN NOT sure THEN 'all_uncertain:' || arm WHEN w > 0.5 THEN 'subset:' || arm ELSE 'subset_fallback_argmax:' || arm END AS reason FROM (SELECT DISTINCT answer_id FROM arms) LEFT JOIN best USING (answer_id)""")
def subset_answers(spark, d):
    return A.probable(_arms(spark, d), "answer_id", "subset", 0.5)


@query(f"""WITH {ARM_SQL}, banded AS (SELECT *, CASE WHEN coalesce(gamma, 0) >= 0.66 THEN 2 WHEN coalesce(gamma, 0) >= 0.33 THEN 1 ELSE 0 END AS band FROM signals),
best AS (SELECT * FROM banded QUALIFY band = max(band) OVER (PARTITION BY answer_id)),
pooled AS (SELECT answer_id, band, {_norm('answer')} AS a, round(sum(coalesce(gamma, 0)), 6) AS total, count(*) AS n, round(avg(coalesce(gamma, 0)), 6) AS gamma FROM best GROUP BY ALL)
SELECT answer_id, a AS answer, band, gamma FROM pooled QUALIFY row_number() OVER (PARTITION BY answer_id ORDER BY total DESC, n DESC, a DESC) = 1""")
def gamma_pool(spark, d):
    return A.gamma_pool(_arms(spark, d), "answer_id")


@query(f"""WITH v AS (SELECT qid, {_norm('pred')} AS answer, count(*) AS votes, min(answer_id) AS first FROM ({ONCE}) WHERE {_norm('pred')} <> '' GROUP BY ALL)
SELECT qid, answer, votes FROM v QUALIFY row_number() OVER (PARTITION BY qid ORDER BY votes DESC, first, answer) = 1""")
def majority_answers(spark, d):
    """The most frequent answer of a question over its reruns, the first one of those that tie."""
    votes = _answers(spark, d).groupBy("qid", T.normalize_answer(F.col("pred")).alias("answer")).agg(F.count(F.lit(1)).alias("votes"), F.min("answer_id").alias("first")).where("answer <> ''")
    order = F.struct((-F.col("votes")).alias("v"), "first", "answer")
    return votes.groupBy("qid").agg(F.min(order).alias("o")).select("qid", F.col("o.answer").alias("answer"), (-F.col("o.v")).alias("votes"))


@query(f"""SELECT answer_id, coalesce(CASE WHEN NOT {uncertain_fallback('pred')} THEN pred END, CASE WHEN NOT {uncertain_fallback('dec_pred')} THEN dec_pred END, CASE WHEN NOT {uncertain_fallback('v3bu_pred')} THEN v3bu_pred END, nullif(pred, ''), nullif(dec_pred, ''), nullif(v3bu_pred, ''), '') AS answer,
CASE WHEN NOT {uncertain_fallback('pred')} THEN 0 WHEN NOT {uncertain_fallback('dec_pred')} THEN 1 WHEN NOT {uncertain_fallback('v3bu_pred')} THEN 2 ELSE -1 END AS step FROM ({ONCE})""")
def retry_cascade(spark, d):
    answer, step = A.retry(F.col("pred"), F.col("dec_pred"), F.col("v3bu_pred"))
    return _answers(spark, d).select("answer_id", answer.alias("answer"), step.alias("step"))


def _alike(a: str, b: str) -> str:
    return f"(coalesce({a}, '') <> '' AND coalesce({b}, '') <> '' AND (SELECT {SET_F1} FROM (SELECT {_tokens(a)} AS p, {_tokens(b)} AS g)) >= 0.7)"


@query(f"""WITH s AS (SELECT answer_id, v3bu_pred AS a, dec_pred AS b, pred AS c, {_alike('v3bu_pred', 'dec_pred')} AS ab, {_alike('v3bu_pred', 'pred')} AS ac, {_alike('dec_pred', 'pred')} AS bc FROM ({ONCE})),
m AS (SELECT answer_id, list_filter([{{'n': length(a), 'i': 0, 'v': a, 'm': ab OR ac}}, {{'n': length(b), 'i': -1, 'v': b, 'm': ab OR (bc AND NOT ac)}}, {{'n': length(c), 'i': -2, 'v': c, 'm': ac OR (bc AND NOT ab)}}], lambda x: x.m) AS l FROM s)
SELECT answer_id, list_max(l).v AS answer FROM m""")
def consensus_answers(spark, d):
    """The longest answer of those arms that agree, null where no two do."""
    alike = lambda a, b: T.set_f1(a, b) >= A.AGREE_AT
    return _answers(spark, d).select("answer_id", A.consensus(F.col("v3bu_pred"), F.col("dec_pred"), F.col("pred"), alike).alias("answer"))


@query(f"""WITH o AS (SELECT answer_id, list_filter([{{'n': length(pred), 'i': 0, 'v': pred, 'u': {uncertain_fallback('pred')}}}, {{'n': length(dec_pred), 'i': -1, 'v': dec_pred, 'u': {uncertain_fallback('dec_pred')}}}], lambda x: NOT x.u AND x.v IS DISTINCT FROM v3bu_pred) AS l, v3bu_pred, dec_pred, decision FROM ({ONCE}))
SELECT answer_id, list_max(l).v AS other, CASE WHEN regexp_matches(lower(coalesce(decision, '')), 'gamma|γ') THEN 'gamma_refuse' WHEN regexp_matches(lower(coalesce(decision, '')), 'h4|refuse') THEN 'h4_refuse' WHEN regexp_matches(lower(coalesce(decision, '')), 'h12|how_many') THEN 'h12_refuse'
WHEN {_strip('v3bu_pred')} IN ('', 'not in passages', 'i don''t know', 'i do not know', 'unknown', 'no answer', 'cannot answer', 'none') THEN 'empty_answer' END AS signal FROM o""")
def fallback_answers(spark, d):
    """For the single-shot answer: the kind of its abstention, and the longest certain answer of another arm."""
    a = F.col("v3bu_pred")
    return _answers(spark, d).select("answer_id", A.longest_other(a, F.col("pred"), F.col("dec_pred")).alias("other"), A.abstention_signal(a, F.col("decision")).alias("signal"))


@query(f"""WITH x AS (SELECT answer_id, unnest([{{'i': 1, 'v': v3bu_pred}}, {{'i': 2, 'v': dec_pred}}, {{'i': 3, 'v': gold}}], recursive := true), {_norm('pred')} AS c FROM ({ONCE})), n AS (SELECT answer_id, i, v, c, {_norm('v')} AS n FROM x),
f AS (SELECT answer_id, n, arg_min(v, i) AS v, min(i) AS i FROM n WHERE n <> '' AND n <> c AND v IS NOT NULL GROUP BY ALL) SELECT answer_id, string_agg(v, '|' ORDER BY i) AS rejected, count(*)::INT AS n FROM f GROUP BY answer_id""")
def rejected_answers(spark, d):
    """The other distinct answers to a question."""
    others = A.other_answers(F.col("pred"), F.col("v3bu_pred"), F.col("dec_pred"), F.col("gold"))
    return _answers(spark, d).select("answer_id", others.alias("o")).where(F.size("o") > 0).select("answer_id", F.array_join("o", "|").alias("rejected"), F.size("o").alias("n"))


@query("""WITH p AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), n AS (SELECT vec_id, sqrt(sum(x * x)) + 1e-9 AS l FROM p GROUP BY vec_id),
u AS (SELECT label, vec_id, pos, x / l AS x FROM p JOIN n USING (vec_id)), c AS (SELECT label, pos, avg(x) AS m FROM u GROUP BY ALL), j AS (SELECT label, vec_id, round(sum(x * m), 9) AS s FROM u JOIN c USING (label, pos) GROUP BY ALL)
SELECT label, vec_id, s >= median(s) OVER (PARTITION BY label) - 1e-9 AS kept FROM j""")
def phase_filter(spark, d):
    """Which vectors of a label lie on the centroid's side of their median."""
    return A.phases(load(spark, d, "embeddings"), "label", "vec_id", "embedding")


# vector search, by queries whose id is divisible by 100, against all rows


def _vectors(spark, d):
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


_SIM = "list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))"


def _dense_sql(extra: str = "") -> str:
    return f"""SELECT q.vec_id AS query_id, e.vec_id AS id, round({_SIM}, 5) AS similarity FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id {extra}
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_SIM}, 9) DESC, e.vec_id) <= 10"""


@query(_dense_sql())
def dense_top_k(spark, d):
    v = _vectors(spark, d)
    return S.exact_top_k(v.where("id % 100 = 0"), v, 10, 64).select("query_id", "id", F.round("similarity", 5).alias("similarity"))


@query(_dense_sql("AND q.label = e.label"))
def dense_top_k_filtered(spark, d):
    v = _vectors(spark, d)
    return S.exact_top_k(v.where("id % 100 = 0"), v, 10, 64, "label").select("query_id", "id", F.round("similarity", 5).alias("similarity"))


@query(f"""WITH ranked AS (SELECT q.vec_id AS query_id, (q.label = e.label) AS relevant, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_SIM}, 9) DESC, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id),
sizes AS (SELECT q.vec_id AS query_id, count(*) - 1 AS total FROM embeddings q JOIN embeddings e ON q.label = e.label WHERE q.vec_id % 100 = 0 GROUP BY ALL)
SELECT query_id, round(sum(relevant::INT) / any_value(total), 6) AS recall, round(sum(relevant::INT) / 10, 6) AS precision,
round(sum(CASE WHEN relevant THEN 1 / log2(rank + 1.0) ELSE 0 END) / any_value(list_sum(list_transform(range(1, least(total, 10) + 1), lambda i: 1 / log2(i + 1.0)))), 6) AS ndcg
FROM ranked JOIN sizes USING (query_id) WHERE rank <= 10 GROUP BY query_id""")
def retrieval_metrics(spark, d):
    v = _vectors(spark, d)
    labels = v.select("id", "label")
    sizes = labels.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_relevant"))
    found = S.exact_top_k(v.where("id % 100 = 0"), v, 10, 64)
    own = labels.select(F.col("id").alias("query_id"), F.col("label").alias("own")).join(sizes.withColumnRenamed("label", "own"), "own")
    return M.ranked_metrics(found.join(labels, "id").join(own, "query_id").withColumn("relevant", F.col("label") == F.col("own")), "query_id", 10)


_CENTROIDS = """parts AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), means AS (SELECT label, pos, avg(x) AS m FROM parts GROUP BY ALL),
lens AS (SELECT label, sqrt(sum(m * m)) AS l FROM means GROUP BY label), centroids AS (SELECT label, pos, round(m / l, 6) AS value FROM means JOIN lens USING (label))"""


@query(f"WITH {_CENTROIDS} SELECT label, pos::INT AS pos, round(value + 1e-9, 4) AS value FROM centroids")
def anchor_centroids(spark, d):
    return N.centroids(load(spark, d, "embeddings"), "label", "embedding").select("label", "pos", F.round(F.col("value") + 1e-9, 4).alias("value"))


@query(f"""WITH {_CENTROIDS}, vecs AS (SELECT label, list(value ORDER BY pos) AS c FROM centroids GROUP BY label)
SELECT e.vec_id, v.label AS anchor FROM embeddings e CROSS JOIN vecs v QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY round(list_dot_product(e.embedding::DOUBLE[], v.c), 7) DESC, v.label) <= 3""")
def anchor_top3(spark, d):
    """Each vector's three nearest anchors, in blocks of both, however many anchors there are."""
    e = load(spark, d, "embeddings")
    c = N.centroids(e, "label", "embedding").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v"))  # as many entries as a vector has
    anchors = c.select(F.col("label").cast("bigint").alias("id"), F.transform("v", lambda x: x["value"]).alias("vector"))
    near = S.exact_top_k(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), anchors, 3, 64, same=False)
    return near.select(F.col("query_id").alias("vec_id"), F.col("id").cast("int").alias("anchor"))


_TERMS = "unnest(list_filter(string_split({}, ' '), lambda t: t <> ''))"


def bm25_sql(asked: str = "") -> str:
    return f"""WITH docs AS (SELECT DISTINCT doc_id AS doc, text FROM documents), terms AS (SELECT doc, {_TERMS.format(_key('text'))} AS term FROM docs), tf AS (SELECT doc, term, count(*) AS tf FROM terms GROUP BY ALL),
lens AS (SELECT doc, count(*) AS len FROM terms GROUP BY doc), st AS (SELECT count(*) AS n, avg(len) AS mean FROM lens), raw_df AS (SELECT term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st GROUP BY term), df AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw_df) ELSE idf END AS idf FROM raw_df),
asked AS (SELECT DISTINCT answer_id AS query_id, {_TERMS.format(_key('question'))} AS term FROM ({ONCE}){asked}),
scored AS (SELECT query_id, doc, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) AS score FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN lens USING (doc), st GROUP BY ALL)
SELECT query_id, doc, round(score, 5) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) <= 10"""


def bm25_of(answers: DataFrame, spark, d) -> DataFrame:
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").distinct()
    return S.bm25(answers.select(F.col("answer_id").alias("id"), F.col("question").alias("text")), docs, 10).select("query_id", "doc", F.round("score", 5).alias("score"))


@query(bm25_sql(" WHERE answer_id % 100 = 0"))
def bm25_top_k(spark, d):
    return bm25_of(_answers(spark, d).where("answer_id % 100 = 0"), spark, d)


# ranked lists

_RESP = "SELECT DISTINCT response_id, qid, n_input_tokens, n_output_tokens FROM reader_responses WHERE qid IS NOT NULL AND n_input_tokens IS NOT NULL AND n_output_tokens IS NOT NULL"


@query(f"""WITH r AS ({_RESP}), p AS (SELECT *, (rank() OVER (PARTITION BY qid ORDER BY n_output_tokens) + (count(*) OVER (PARTITION BY qid, n_output_tokens) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY qid) AS a,
(rank() OVER (PARTITION BY qid ORDER BY n_input_tokens) + (count(*) OVER (PARTITION BY qid, n_input_tokens) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY qid) AS b FROM r)
SELECT response_id, round(a, 6) AS pit, round(0.9 * a + 0.1 * b, 6) AS fused FROM p""")
def pit_fusion(spark, d):
    r = load(spark, d, "reader_responses").select("response_id", "qid", "n_input_tokens", "n_output_tokens").distinct().na.drop(subset=["qid", "n_input_tokens", "n_output_tokens"])
    both = R.pit(R.pit(r, ["qid"], "n_output_tokens", "a"), ["qid"], "n_input_tokens", "b")
    return both.select("response_id", F.round("a", 6).alias("pit"), F.round(R.fuse(F.col("a"), F.col("b")), 6).alias("fused"))


_LISTS = f"""own AS (SELECT DISTINCT response_id, qid, coalesce(provider, '') AS provider, {_key('text')} AS item FROM reader_responses WHERE qid IS NOT NULL),
lists AS (SELECT qid, provider, item, row_number() OVER (PARTITION BY qid, provider ORDER BY response_id) AS rank FROM own WHERE item <> '')"""


@query(f"""WITH {_LISTS}, f AS (SELECT qid, item, min((rank, provider)) AS first FROM lists GROUP BY ALL)
SELECT qid, item, row_number() OVER (PARTITION BY qid ORDER BY first, item) AS position FROM f QUALIFY position <= 10""")
def round_robin_union(spark, d):
    return R.round_robin(P.provider_lists(load(spark, d, "reader_responses")), "qid", "provider", "rank", "item", 10)


@query(f"""WITH {_LISTS}, f AS (SELECT qid, item, min((provider, rank)) AS first FROM lists GROUP BY ALL)
SELECT qid, item, row_number() OVER (PARTITION BY qid ORDER BY first, item) AS position FROM f QUALIFY position <= 15""")
def ordered_union(spark, d):
    return R.ordered_union(P.provider_lists(load(spark, d, "reader_responses")), "qid", "provider", "rank", "item", 15)


# graph and evidence

_EDGES = f"""raw AS (SELECT {_key('subject')} AS subject, {_key('predicate')} AS predicate, {_key('object')} AS object, source_chunk_id AS chunk, CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0.7 ELSE confidence END AS confidence FROM raw_triples),
edges AS (SELECT subject, predicate, object, chunk, max(confidence) AS confidence FROM raw WHERE subject <> '' AND object <> '' AND subject <> object GROUP BY ALL)"""


def _edges(spark, d):
    return G.edges(load(spark, d, "raw_triples"))


@query(f"WITH {_EDGES} SELECT least(subject, object) AS a, greatest(subject, object) AS b, predicate, count(*) AS n, max(confidence) AS confidence FROM edges GROUP BY ALL")
def graph_edges(spark, d):
    return G.symmetric(_edges(spark, d))


@query(f"WITH {_EDGES}, ends AS (SELECT subject AS node, object AS other FROM edges UNION SELECT object, subject FROM edges) SELECT node, count(*) AS degree FROM ends GROUP BY node")
def graph_degrees(spark, d):
    return G.degrees(_edges(spark, d))


@query(f"""WITH {_EDGES} SELECT a.chunk, concat_ws(' > ', a.subject, a.predicate, a.object, b.predicate, b.object) AS path, round(a.confidence * b.confidence, 6) AS confidence
FROM edges a JOIN edges b ON a.chunk = b.chunk AND a.object = b.subject WHERE a.subject <> b.object""")
def graph_paths(spark, d):
    return G.chunk_paths(_edges(spark, d))


@query(f"""WITH {_EDGES}, ids AS (SELECT DISTINCT chunk, concat_ws('|', least(subject, object), predicate, greatest(subject, object)) AS id FROM edges)
SELECT chunk, count(*)::INT AS n_edges, sha1(string_agg(id || chr(0), '' ORDER BY id)) AS traversal FROM ids GROUP BY chunk""")
def traversal_hashes(spark, d):
    return G.traversal_hash(_edges(spark, d))


def _question_anchors(spark, d, walk):
    nodes = walk.select(F.col("lo").alias("entity")).union(walk.select("hi")).distinct()
    return E.link_entities(_answers(spark, d), "answer_id", "question", nodes).select("answer_id", F.col("entity").alias("anchor"))


@query()
def anchor_paths(spark, d):
    """The best walks from each anchor of each question, over the whole graph."""
    walk = G.walk_edges(load(spark, d, "raw_triples"))
    asked = cut(_question_anchors(spark, d, walk))
    return asked.join(G.anchor_paths(walk, asked), "anchor").select("answer_id", "anchor", "rank", "path", F.size("edges").alias("hops"), F.round("confidence", 9).alias("confidence"))


@query()
def anchor_traversals(spark, d):
    walk = G.walk_edges(load(spark, d, "raw_triples"))
    return G.path_hashes(G.anchor_paths(walk, _question_anchors(spark, d, walk)), "anchor")


@query()
def personalised_pagerank(spark, d):
    e = _edges(spark, d)
    nodes = e.select(F.col("subject").alias("entity")).union(e.select("object")).distinct()
    seeds = E.link_entities(_answers(spark, d), "answer_id", "question", nodes).select(F.col("answer_id").alias("query_id"), F.col("entity").alias("node"))
    return G.pagerank(e, seeds, key="query_id").select("query_id", "node", F.round("score", 9).alias("score"))


_SETS = "list_distinct(string_split({}, ' '))"


@query(f"""WITH t AS (SELECT DISTINCT triple_id, subject, object, source_chunk_id FROM raw_triples), c AS (SELECT chunk_id, max(text) AS text FROM chunks GROUP BY chunk_id),
j AS (SELECT triple_id, {_key('subject')} AS s, {_key('object')} AS o, text, list_has_all({_SETS.format(_key('text'))}, {_SETS.format(_key('subject'))}) AS hs, list_has_all({_SETS.format(_key('text'))}, {_SETS.format(_key('object'))}) AS ho FROM t LEFT JOIN c ON chunk_id = source_chunk_id)
SELECT DISTINCT triple_id, CASE WHEN s = '' OR o = '' OR text IS NULL THEN 'refuse' WHEN hs AND ho THEN 'valid' WHEN hs OR ho THEN 'partial' ELSE 'invalid' END AS status FROM j""")
def triple_support(spark, d):
    return E.support(load(spark, d, "raw_triples"), load(spark, d, "chunks"))


@query(f"""WITH e AS (SELECT DISTINCT chunk_id, unnest(entities) AS name FROM openie_results) SELECT {_key('name')} AS entity, count(DISTINCT chunk_id) AS n_chunks FROM e WHERE {_key('name')} <> '' GROUP BY 1""")
def entity_index(spark, d):
    e = load(spark, d, "openie_results").select("chunk_id", F.explode("entities").alias("name")).select("chunk_id", T.lookup_key(F.col("name")).alias("entity"))
    return e.where("entity <> ''").distinct().groupBy("entity").agg(F.count("chunk_id").alias("n_chunks"))


_GRAMS = "SELECT DISTINCT answer_id, array_to_string(w[i:i + n], ' ') AS entity FROM (SELECT answer_id, w, i, unnest(range(0, len(w) - i + 1)) AS n FROM (SELECT answer_id, w, unnest(range(1, len(w) + 1)) AS i FROM w))"


@query(f"""WITH {_EDGES}, names AS (SELECT subject AS entity FROM edges UNION SELECT object FROM edges), w AS (SELECT answer_id, list_filter(string_split({_key('question')}, ' '), lambda x: x <> '') AS w FROM ({ONCE})), grams AS ({_GRAMS})
SELECT answer_id, entity, row_number() OVER (PARTITION BY answer_id ORDER BY length(entity) DESC, entity) AS position FROM grams JOIN names USING (entity) WHERE length(entity) >= 3 QUALIFY position <= 8""")
def entity_links(spark, d):
    e = _edges(spark, d)
    nodes = e.select(F.col("subject").alias("entity")).union(e.select("object")).distinct()
    return E.link_entities(_answers(spark, d), "answer_id", "question", nodes)


_DOCS = "(SELECT DISTINCT doc_id, text FROM documents)"


def _clean(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({x}, '<!--.*?-->', '', 'g'), '\[\[(?:[^|\]]+\|)?([^\]]+)\]\]', '\1', 'g'), '[ \t]+', ' ', 'g'))"


_INFOBOX = f"""d AS (SELECT doc_id, regexp_extract_all(text, '(?m)^\\| *([a-z_]+) *= *([^\\r\\n]*)', 1) AS k, regexp_extract_all(text, '(?m)^\\| *([a-z_]+) *= *([^\\r\\n]*)', 2) AS v FROM {_DOCS} WHERE contains(text, '{{{{Infobox')),
r AS (SELECT doc_id, {_clean("v[list_position(k, 'name')]")} AS subject, unnest(k) AS attribute, {_clean('unnest(v)')} AS value FROM d),
infobox AS (SELECT DISTINCT doc_id, subject, attribute, value FROM r WHERE attribute NOT IN ('name', 'image', 'caption', 'image_size', 'alt') AND length(value) BETWEEN 1 AND 200 AND length(subject) BETWEEN 1 AND 80)"""


@query(f"WITH {_INFOBOX} SELECT * FROM infobox")
def infobox_facts(spark, d):
    return X.infobox_triples(load(spark, d, "documents").select("doc_id", "text").distinct())


_WS = r"[\x{9}-\x{D}\x{85}\p{Z}]"
_WORD = r"[\p{L}\p{M}\p{N}_]"
_BEFORE = rf"(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])"
_PERSON = rf"\p{{L}}[\p{{L}}\p{{M}}\p{{N}}_.\-]*(?:{_WS}+\p{{L}}[\p{{L}}\p{{M}}\p{{N}}_.\-]*){{0,4}}"
_ANY = rf"(?:{_PERSON}|(?:(?:the|a|an){_WS}+)?\p{{L}}[\p{{L}}\p{{M}}\p{{N}}_\-]+(?:{_WS}+\p{{L}}[\p{{L}}\p{{M}}\p{{N}}_\-]+){{0,4}})"
_VERB = "founded|created|directed|wrote|composed|invented|discovered|acquired|started|published|released|established|signed|elected|played|hosted|formed|developed|owned|owns|produced|designed|adapted|succeeded|preceded|married|joined|led|leads|managed|won|received|earned|achieved|attended|studied"
_SAID = [
    (rf"(?i){_BEFORE}({_PERSON}){_WS}+({_VERB}){_WS}+({_ANY})", 2, 3), (rf"(?i){_BEFORE}({_PERSON}){_WS}+(?:is|was|are|were){_WS}+(?:the|a|an){_WS}+({_WORD}+(?:{_WS}+{_WORD}+){{0,2}}){_WS}+of{_WS}+({_ANY})", 2, 3),
    (rf"(?i){_BEFORE}({_PERSON})''s{_WS}+({_WORD}+(?:{_WS}+{_WORD}+){{0,2}}){_WS}+(?:is|was|are|were){_WS}+({_ANY})", 2, 3), (rf"(?i){_BEFORE}({_PERSON}){_WS}+(?:was|is){_WS}+born{_WS}+in{_WS}+({_ANY})", "born_in", 2),
    (rf"(?i){_BEFORE}({_PERSON}){_WS}+(?:was|is){_WS}+born{_WS}+(?:on{_WS}+)?([^.;,(]+?)(?:[.;,(]|$)", "born_on", 2), (rf"(?i){_BEFORE}({_PERSON}){_WS}+died{_WS}+in{_WS}+({_ANY})", "died_in", 2),
]


def _all_of(text: str, key: str, table: str, forms: list) -> str:
    rows = []
    for family, (pattern, predicate, group) in enumerate(forms):
        s, o = (f"regexp_extract_all({text}, '{pattern}', {g})" for g in (1, group))
        p = f"'{predicate}'" if isinstance(predicate, str) else f"unnest(regexp_extract_all({text}, '{pattern}', {predicate}))"
        rows.append(f"SELECT {key}, {family} AS family, unnest({s}) AS subject, generate_subscripts({s}, 1) AS place, {p} AS predicate, unnest({o}) AS object FROM {table}")
    return " UNION ALL ".join(rows)


def _squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


_STATED = f"""c AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE text IS NOT NULL), said AS ({_all_of('text', 'chunk_id', 'c', _SAID)}),
clean AS (SELECT chunk_id, family, place, {_squash('subject')} AS subject, regexp_replace(lower(trim(predicate)), '{_WS}+', '_', 'g') AS predicate, {_squash('object')} AS object FROM said),
statements AS (SELECT chunk_id, (min((family, place, subject, object))).subject AS subject, predicate, (min((family, place, subject, object))).object AS object FROM (SELECT *, {_key('subject')} AS sk, {_key('object')} AS ok FROM clean WHERE subject <> '' AND object <> '' AND length(subject) <= 80 AND length(object) <= 200) GROUP BY chunk_id, sk, predicate, ok)"""
_STATED = _STATED.replace("(min((family, place, subject, object))).subject", "arg_min(subject, (family, place, subject, object))").replace("(min((family, place, subject, object))).object", "arg_min(object, (family, place, subject, object))")


@query(f"WITH {_STATED} SELECT * FROM statements")
def extracted_statements(spark, d):
    return X.statements(load(spark, d, "chunks").select("chunk_id", "text").distinct(), "chunk_id", "text")


_SOMEONE = r"(\p{L}(?:[\p{L}\p{M}\p{N}_.\- ])+?)"
_UPTO = r"([^.;,(]+?)(?:[.;,(]|$)"
_FACT_FORMS = [
    (rf"(?i){_BEFORE}{_SOMEONE}{_WS}+(?:was|is){_WS}+born{_WS}+(?:on{_WS}+)?{_UPTO}", "born", 2), (rf"(?i){_BEFORE}{_SOMEONE}{_WS}+(?:was|is){_WS}+born{_WS}+in{_WS}+{_UPTO}", "birthplace", 2),
    (rf"(?i){_BEFORE}{_SOMEONE}{_WS}+died{_WS}+(?:on{_WS}+)?{_UPTO}", "died", 2), (rf"(?i){_BEFORE}{_SOMEONE}{_WS}+died{_WS}+in{_WS}+{_UPTO}", "deathplace", 2),
    (rf"(?i){_BEFORE}The capital of{_WS}+(\p{{L}}[\p{{L}}\p{{M}}\p{{N}}_. ]+?){_WS}+is{_WS}+{_UPTO}", "capital", 2), (rf"(?i){_BEFORE}{_SOMEONE}{_WS}+is{_WS}+the capital of{_WS}+(\p{{L}}[\p{{L}}\p{{M}}\p{{N}}_. ]+?)(?:[.;,(]|$)", "capital_of", 2),
    (rf"(?i){_BEFORE}{_SOMEONE}{_WS}+is{_WS}+(?:an?{_WS}+)?({_WORD}+(?:{_WS}+{_WORD}+){{0,2}}){_WS}+(?:actor|actress|director|singer|author|writer|scientist|politician|player)(?:$|[^\p{{L}}\p{{M}}\p{{N}}_])", "nationality", 2),
]
_PLAIN = f"""pc AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE text IS NOT NULL), told AS ({_all_of('text', 'chunk_id', 'pc', _FACT_FORMS)}),
facts AS (SELECT DISTINCT chunk_id, {_squash('subject')} AS subject, predicate AS attribute, {_squash('object')} AS value FROM told WHERE {_squash('subject')} <> '' AND {_squash('object')} <> '' AND length({_squash('subject')}) <= 80 AND length({_squash('object')}) <= 200)"""


@query(f"WITH {_PLAIN} SELECT * FROM facts")
def stated_facts(spark, d):
    return X.plain_facts(load(spark, d, "chunks").select("chunk_id", "text").distinct(), "chunk_id", "text")


_ALIAS = "CASE {0} WHEN 'date_of_birth' THEN 'born' WHEN 'birth_date' THEN 'born' WHEN 'born_date' THEN 'born' WHEN 'date_of_death' THEN 'died' WHEN 'death_date' THEN 'died' WHEN 'place_of_birth' THEN 'birthplace' WHEN 'birth_place' THEN 'birthplace' WHEN 'place_of_death' THEN 'deathplace' WHEN 'death_place' THEN 'deathplace' WHEN 'alma_matter' THEN 'alma_mater' WHEN 'profession' THEN 'occupation' WHEN 'citizenship' THEN 'nationality' WHEN 'spouse_s' THEN 'spouse' WHEN 'spouses' THEN 'spouse' WHEN 'partner' THEN 'spouse' WHEN 'parent' THEN 'parents' WHEN 'fathers' THEN 'father' WHEN 'mothers' THEN 'mother' WHEN 'headquartered_in' THEN 'headquarters' WHEN 'headquartered' THEN 'headquarters' WHEN 'hq' THEN 'headquarters' WHEN 'capital_city' THEN 'capital' ELSE {0} END"


def _attribute(x: str) -> str:
    return _ALIAS.format(rf"regexp_replace(regexp_replace(lower(trim({x})), '[\x{{9}}-\x{{D}}\x{{85}}\p{{Z}}-]+', '_', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}_]+', '', 'g')".replace("{", "{{").replace("}", "}}")).replace("{{", "{").replace("}}", "}")


_INDEX = f"""{_INFOBOX}, {_PLAIN}, every AS (SELECT doc_id::VARCHAR AS source, subject, attribute, value, 1.0::DOUBLE AS confidence FROM infobox UNION ALL SELECT chunk_id, subject, attribute, value, 0.7::DOUBLE FROM facts
UNION ALL SELECT source_chunk_id, subject, predicate, object, 0.7::DOUBLE FROM (SELECT DISTINCT source_chunk_id, subject, predicate, object FROM raw_triples)), keyed AS (SELECT {_key('subject')} AS subject_key, {_attribute('attribute')} AS attribute, {_key('value')} AS value_key, subject, value, source, confidence FROM every),
fact_index AS (SELECT subject_key, attribute, value_key, arg_min(value, (-confidence, coalesce(source, ''), subject, value)) AS value, max(confidence) AS confidence, arg_min(coalesce(source, ''), (-confidence, coalesce(source, ''), subject, value)) AS source, arg_min(subject, (-confidence, coalesce(source, ''), subject, value)) AS subject FROM keyed WHERE subject_key <> '' AND attribute <> '' AND value_key <> '' GROUP BY ALL)"""


def _fact_index(spark, d):
    """Facts of infoboxes, of texts and of triples, by keys."""
    boxes = infobox_facts(spark, d).select(F.col("doc_id").cast("string").alias("source"), "subject", "attribute", "value")
    texts = stated_facts(spark, d).select(F.col("chunk_id").alias("source"), "subject", "attribute", "value")
    triples = load(spark, d, "raw_triples").select(F.col("source_chunk_id").alias("source"), "subject", F.col("predicate").alias("attribute"), F.col("object").alias("value")).distinct()
    return X.fact_index(boxes, texts.unionByName(triples))


@query(f"WITH {_INDEX} SELECT subject_key, attribute, value_key, value, confidence, source FROM fact_index")
def indexed_facts(spark, d):
    return _fact_index(spark, d).select("subject_key", "attribute", "value_key", "value", "confidence", "source")


_LOOKED_UP = f"""{_INDEX}, {PQ.HINTS}, hinted AS (SELECT DISTINCT answer_id, {_key('subject')} AS subject_key, {_attribute('attribute')} AS attribute FROM hints WHERE subject <> '' AND attribute <> ''),
answers AS (SELECT DISTINCT answer_id, subject, attribute, value, source, confidence FROM hinted JOIN fact_index USING (subject_key, attribute))"""


def _looked_up(spark, d):
    return X.look_up(PQ.question_hints(spark, d), "answer_id", _fact_index(spark, d))


@query(f"WITH {_LOOKED_UP} SELECT answer_id, arg_min(value, (-confidence, attribute, value)) AS value, max(confidence) AS confidence FROM answers GROUP BY answer_id")
def looked_up_answers(spark, d):
    """What the fact index answers to attribute questions."""
    return X.best_fact(_looked_up(spark, d), "answer_id")


@query(f"""WITH {_LOOKED_UP}, c AS (SELECT chunk_id, max(text) AS text FROM chunks GROUP BY chunk_id), j AS (SELECT coalesce(chunk_id, 'infobox:' || substr({_key('subject')}, 1, 32) || ':' || attribute) AS chunk_id, chunk_id IS NULL AS made,
CASE WHEN chunk_id IS NULL THEN subject || ' -- ' || attribute || ': ' || value ELSE text END AS text FROM answers LEFT JOIN c ON source = chunk_id) SELECT chunk_id, made, min(text) AS text FROM j GROUP BY ALL""")
def answering_chunks(spark, d):
    """The chunks of those facts, made ones where a fact has none."""
    return X.fact_chunks(_looked_up(spark, d), load(spark, d, "chunks").select("chunk_id", "text"))


@query(f"""WITH {_INDEX}, w AS (SELECT DISTINCT {_key('gold')} AS value FROM ({ONCE}) WHERE answer_id % 100 = 0 AND length({_key('gold')}) >= 3) SELECT DISTINCT w.value, subject_key, attribute FROM w JOIN fact_index f ON contains(' ' || f.value_key || ' ', ' ' || w.value || ' ')""")
def subjects_by_value(spark, d):
    """Of what a value is a value: subjects and attributes whose value holds the words of an asked answer. An equi-join
    on word runs of the lengths that are asked for."""
    asked = _answers(spark, d).where("answer_id % 100 = 0").select(T.lookup_key(F.col("gold")).alias("value")).where("length(value) >= 3").distinct()
    lengths = sorted(r[0] for r in asked.select(F.size(F.split("value", " "))).distinct().collect())
    runs = _fact_index(spark, d).select("subject_key", "attribute", F.explode(E.n_grams(F.col("value_key"), lengths)).alias("value"))
    return runs.join(asked, "value").select("value", "subject_key", "attribute").distinct()


@query(r"""WITH r AS (SELECT DISTINCT response_id, text FROM reader_responses WHERE text IS NOT NULL), p AS (SELECT response_id, regexp_extract(text, '"answer": *"([^"]*)"', 1) AS j, regexp_extract(text, '\*\*Answer: ([^*]+)\*\*', 1) AS m,
regexp_replace(regexp_extract(regexp_replace(text, '[ \r\n]+$', ''), '([^\r\n]*)$', 1), '\.$', '') AS l FROM r) SELECT response_id, CASE WHEN j <> '' THEN j WHEN m <> '' THEN m ELSE l END AS answer FROM p""")
def structured_answers(spark, d):
    r = load(spark, d, "reader_responses").where("text IS NOT NULL").select("response_id", "text").distinct()
    return r.select("response_id", X.structured_answer(F.col("text")).alias("answer"))


@query(f"""WITH t AS (SELECT DISTINCT {_key('subject')} AS subject, {_key('predicate')} AS predicate, {_key('object')} AS value FROM raw_triples)
SELECT subject, predicate, count(*) AS n_values, min(value) AS first_value FROM t WHERE subject <> '' AND value <> '' GROUP BY ALL""")
def attribute_values(spark, d):
    return X.multi_values(load(spark, d, "raw_triples"))


@query(f"""WITH m AS (SELECT DISTINCT chunk_id, {_key('name')} AS entity FROM (SELECT chunk_id, unnest(entities) AS name FROM openie_results)), p AS (SELECT DISTINCT chunk_id, doc_id FROM chunks),
j AS (SELECT doc_id, entity, count(*) AS m FROM m JOIN p USING (chunk_id) WHERE entity <> '' GROUP BY ALL) SELECT doc_id, count(*) AS n_members, sum(m)::BIGINT AS n_mentions FROM j GROUP BY doc_id HAVING count(*) >= 2""")
def document_anchors(spark, d):
    return X.document_anchors(load(spark, d, "openie_results"), load(spark, d, "chunks"))


@query(f"""WITH a AS (SELECT qid, answer_id, {_norm('pred')} AS answer FROM ({ONCE})), c AS (SELECT *, CASE WHEN lag(answer) OVER w IS NOT DISTINCT FROM answer AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM a WINDOW w AS (PARTITION BY qid ORDER BY answer_id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY qid ORDER BY answer_id) AS run FROM c) SELECT qid, answer, min(answer_id) AS first, count(*) AS length FROM r GROUP BY qid, answer, run""")
def answer_runs(spark, d):
    a = _answers(spark, d).select("qid", "answer_id", T.normalize_answer(F.col("pred")).alias("answer"))
    return R.repeats(a, "qid", "answer_id", "answer")


_WEIGHT = " + ".join(f"(u >= {c})::INT" for c in ("0.36787944", "0.73575888", "0.9196986", "0.98101184", "0.99634015", "0.99940582"))


@query(f"""WITH e AS (SELECT decision, f1, ('0x' || substr(md5(answer_id || ':' || draw), 1, 8))::BIGINT / 4294967296.0 AS u, draw FROM ({ONCE}), (SELECT unnest(range(1, 1001)) AS draw) WHERE f1 IS NOT NULL),
m AS (SELECT decision, draw, sum(({_WEIGHT}) * f1) / nullif(sum({_WEIGHT}), 0) AS m FROM e GROUP BY ALL), o AS (SELECT decision, list_sort(list(m) FILTER (m IS NOT NULL)) AS ms FROM m GROUP BY decision), t AS (SELECT decision, avg(f1) AS mean FROM ({ONCE}) GROUP BY decision)
SELECT decision, round(mean, 6) AS mean, round(ms[floor(0.025 * len(ms))::INT + 1], 6) AS low, round(ms[least(floor(0.975 * len(ms))::INT, len(ms) - 1) + 1], 6) AS high FROM o JOIN t USING (decision)""")
def bootstrap_intervals(spark, d):
    return M.bootstrap(_answers(spark, d), "decision", "answer_id", "f1")


@query(f"""WITH r AS (SELECT DISTINCT response_id, qid, text FROM reader_responses WHERE text IS NOT NULL), a AS (SELECT DISTINCT qid, gold FROM ({ONCE}) WHERE {_norm('gold')} <> ''),
j AS (SELECT response_id, len(list_intersect(list_distinct({_tokens('gold')}), list_distinct({_tokens('text')}))) / len(list_distinct({_tokens('gold')})) AS share FROM r JOIN a USING (qid))
SELECT response_id, round(max(share), 6) AS grounding FROM j GROUP BY response_id""")
def response_grounding(spark, d):
    """How much of a labelled answer stands in a response to its question, the best over the question's labels."""
    r = load(spark, d, "reader_responses").where("text IS NOT NULL").select("response_id", "qid", "text").distinct().select("response_id", "qid", F.array_distinct(T.tokens(F.col("text"))).alias("t"))
    a = _answers(spark, d).where(T.normalize_answer(F.col("gold")) != "").select("qid", F.array_distinct(T.tokens(F.col("gold"))).alias("g")).distinct()
    share = F.size(F.array_intersect("g", "t")) / F.size("g")
    return r.join(a, "qid").groupBy("response_id").agg(F.round(F.max(share), 6).alias("grounding"))


@query(f"SELECT {_key('predicate')} AS attribute, replace({_key('predicate')}, ' ', '_') AS slug, count(DISTINCT triple_id) AS n FROM raw_triples GROUP BY 1, 2")
def attribute_slugs(spark, d):
    t = load(spark, d, "raw_triples").select("triple_id", T.lookup_key(F.col("predicate")).alias("attribute")).distinct()
    return t.groupBy("attribute").agg(F.count(F.lit(1)).alias("n")).select("attribute", F.replace("attribute", F.lit(" "), F.lit("_")).alias("slug"), "n")


@query(f"""WITH b AS ({ORACLES['bm25_top_k']}), l AS ({ORACLES['entity_links']}), m AS (SELECT DISTINCT {_key('name')} AS entity, chunk_id FROM (SELECT chunk_id, unnest(entities) AS name FROM openie_results)), p AS (SELECT DISTINCT chunk_id, doc_id FROM chunks),
s AS (SELECT DISTINCT query_id, doc FROM b JOIN l ON answer_id = query_id JOIN m USING (entity) JOIN p USING (chunk_id) WHERE doc_id = doc), r AS (SELECT query_id, doc, b.score + CASE WHEN s.doc IS NULL THEN 0 ELSE 2.0 END AS score FROM b LEFT JOIN s USING (query_id, doc))
SELECT query_id, doc, round(score + 1e-7, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, doc) AS rank FROM r""")
def boosted_rerank(spark, d):
    """BM25 candidates whose document mentions an entity of the question move up. Only the candidates' documents are looked up."""
    ranked = bm25_top_k(spark, d)
    mentions = load(spark, d, "openie_results").select("chunk_id", F.explode("entities").alias("name")).select("chunk_id", T.lookup_key(F.col("name")).alias("entity")).distinct()
    places = load(spark, d, "chunks").select("chunk_id", F.col("doc_id").alias("doc")).distinct()
    of_candidates = ranked.select("query_id", "doc").join(places, "doc").join(mentions, "chunk_id").select("query_id", "doc", "entity").distinct()
    links = entity_links(spark, d).select(F.col("answer_id").alias("query_id"), "entity")
    found = R.boost(ranked, of_candidates.join(links, ["query_id", "entity"]), ["query_id", "doc"], "score", 2.0, "query_id", "doc")
    return found.select("query_id", "doc", F.round(F.col("score") + 1e-7, 4).alias("score"), "rank")


@query(r"""WITH r AS (SELECT DISTINCT response_id, string_split(replace(regexp_extract(text, '"passages": *\[([0-9, ]*)\]', 1), ' ', ''), ',') AS p FROM reader_responses WHERE text IS NOT NULL),
e AS (SELECT response_id, list_filter(p, lambda x: x <> '') AS p FROM r) SELECT DISTINCT response_id, unnest(p)::BIGINT AS passage, (generate_subscripts(p, 1) - 1)::INT AS position FROM e""")
def cited_passages(spark, d):
    return X.cited_passages(load(spark, d, "reader_responses").where("text IS NOT NULL"), "response_id", "text")


# ingestion and index


@query(r"""WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, text, list_transform(list_filter(string_split(regexp_replace(regexp_replace(text, '^[\x{9}-\x{D}\x{1C}-\x{1F}\x{85}\p{Z}]+|[\x{9}-\x{D}\x{1C}-\x{1F}\x{85}\p{Z}]+$', '', 'g'), '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^[\x{9}-\x{D}\x{1C}-\x{1F}\x{85}\p{Z}]+|[\x{9}-\x{D}\x{1C}-\x{1F}\x{85}\p{Z}]+$', '', 'g') <> ''),
lambda s: [[{'s': s, 'n': len(list_filter(regexp_split_to_array(s, '[ \t\r\n]+'), lambda w: w <> ''))}]]) AS e FROM d), packed AS (SELECT doc_id, text, list_reduce(e, lambda a, x: CASE WHEN list_sum(list_transform(a[-1], lambda y: y.n)) + x[1][1].n > 400
THEN list_append(a, list_concat(list_filter(a[-1], lambda y, i: list_sum(list_transform(a[-1][i:], lambda z: z.n)) <= 50), x[1])) ELSE list_append(a[:-2], list_concat(a[-1], x[1])) END) AS c FROM p WHERE len(e) > 0),
u AS (SELECT doc_id, text AS t, unnest(c) AS c, generate_subscripts(c, 1) - 1 AS pos FROM packed) SELECT doc_id || '#chunk' || pos AS chunk_id, doc_id, pos::INT AS pos, array_to_string(list_transform(c, lambda y: y.s), ' ') AS text FROM u""")
def sentence_chunks(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text").distinct()
    return N.chunks(docs, "doc_id", N.pack_sentences(F.col("text")))


@query(r"""WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split(regexp_replace(text, '\n[ \t\r]*\n', chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^[\x{9}-\x{D}\x{1C}-\x{1F}\x{85}\p{Z}]+|[\x{9}-\x{D}\x{1C}-\x{1F}\x{85}\p{Z}]+$', '', 'g')), lambda s: s <> ''), lambda s: [s]) AS e FROM d),
packed AS (SELECT doc_id, list_transform(list_reduce(e, lambda a, x: CASE WHEN length(a[-1]) + length(x[1]) < 1500 THEN list_append(a[:-2], a[-1] || chr(10) || chr(10) || x[1]) ELSE list_concat(a, x) END), lambda s: [s]) AS c FROM p WHERE len(e) > 0),
merged AS (SELECT doc_id, list_reduce(c, lambda a, x: CASE WHEN length(x[1]) < 100 THEN list_append(a[:-2], a[-1] || chr(10) || chr(10) || x[1]) ELSE list_concat(a, x) END) AS c FROM packed),
u AS (SELECT doc_id, unnest(c) AS text, generate_subscripts(c, 1) - 1 AS pos FROM merged) SELECT doc_id || '#chunk' || pos AS chunk_id, doc_id, pos::INT AS pos, text FROM u""")
def paragraph_chunks(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text").distinct()
    return N.chunks(docs, "doc_id", N.pack_paragraphs(F.col("text")))


@query(f"""WITH w AS (SELECT doc_id, {_TERMS.format(_key('text'))} AS w FROM (SELECT DISTINCT doc_id, text FROM documents)), c AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 256 AS bucket, count(*) AS c FROM w GROUP BY ALL)
SELECT doc_id, bucket, round(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)), 6) AS weight FROM c""")
def hash_embeddings(spark, d):
    return N.hash_embedding(load(spark, d, "documents").select("doc_id", "text").distinct(), "doc_id", "text")


_FIELDS = ", ".join(f"nullif(trim(json_extract_string(props, '$.{k}')), '')" for k in ("text", "content", "body", "passage", "answer"))


@query(f"SELECT event_id, coalesce({_FIELDS}, props) AS text FROM events")
def json_records(spark, d):
    return load(spark, d, "events").select("event_id", record_text(F.col("props")).alias("text"))


@query("SELECT vec_id, chunk_id, doc_id, pos, text FROM chunks QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY ingested_at DESC) = 1")
def upserted_chunks(spark, d):
    """The chunks as an index into which every ingestion was upserted."""
    return I.latest(load(spark, d, "chunks").select("vec_id", "chunk_id", "doc_id", "pos", "text", "ingested_at"), "vec_id", "ingested_at").select("vec_id", "chunk_id", "doc_id", "pos", "text")


@query("""WITH last AS (SELECT chunk_id, doc_id, text FROM chunks QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY ingested_at DESC) = 1), stale AS (SELECT DISTINCT doc_id FROM documents WHERE text IS NULL OR length(trim(text)) = 0)
SELECT chunk_id, doc_id, text FROM last WHERE doc_id NOT IN (SELECT doc_id FROM stale)""")
def deleted_documents(spark, d):
    """The index without the chunks of documents that have no text any more."""
    stale = load(spark, d, "documents").where(F.col("text").isNull() | (F.length(F.trim("text")) == 0)).select("doc_id")
    return I.delete(upserted_chunks(spark, d), stale, "doc_id").select("chunk_id", "doc_id", "text")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def streamed_latest_events(spark, d):
    return stream_latest(spark, d, "user_id", "ts", "events.parquet").select("user_id", "event_id", "event_type", "value")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    return windowed_counts(load(spark, d, "events"), "ts", "event_type", "1 hour", "10 minutes")


# runs

_RUNS = "SELECT DISTINCT run_id, arm, query_id, category, recall_at_5, recall_at_10, ndcg_at_5, latency_ms, tokens_in, tokens_out, cost_cents FROM arm_runs"


def _runs(spark, d):
    return load(spark, d, "arm_runs").select("run_id", "arm", "query_id", "category", "recall_at_5", "recall_at_10", "ndcg_at_5", "latency_ms", "tokens_in", "tokens_out", "cost_cents").distinct()


@query(f"""SELECT arm, category, grouping(category)::INT AS all_categories, count(*) AS n, round(avg(recall_at_5), 6) AS recall_at_5, round(avg(recall_at_10), 6) AS recall_at_10, round(avg(ndcg_at_5), 6) AS ndcg_at_5, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out,
round(sum(cost_cents), 2) AS cost_cents FROM ({_RUNS}) GROUP BY GROUPING SETS ((arm, category), (arm))""")
def arm_summary(spark, d):
    return (
        _runs(spark, d).groupingSets([["arm", "category"], ["arm"]], "arm", "category")
        .agg(F.grouping("category").cast("int").alias("all_categories"), F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall_at_5", "recall_at_10", "ndcg_at_5")],
             *[F.sum(c).alias(c) for c in ("tokens_in", "tokens_out")], F.round(F.sum("cost_cents"), 2).alias("cost_cents"))
    )


_MEASURED = f"SELECT arm, latency_ms FROM ({_RUNS}) WHERE latency_ms >= 0 AND NOT isnan(latency_ms)"


@query(f"""WITH r AS (SELECT arm, latency_ms, row_number() OVER (PARTITION BY arm ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY arm) AS n FROM ({_MEASURED}))
SELECT arm, p, n, latency_ms FROM r, (SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS p) WHERE i = floor(p * (n - 1))""")
def latency_percentiles(spark, d):
    r = _runs(spark, d).where("latency_ms >= 0 AND NOT isnan(latency_ms)")
    return M.exact_percentiles(r, ["arm"], "latency_ms", [0.5, 0.95, 0.99])


@query(f"""WITH c AS (SELECT arm, sum((recall_at_5 > 0)::INT) AS k, count(*) AS n FROM ({_RUNS}) WHERE recall_at_5 IS NOT NULL GROUP BY arm), s AS (SELECT arm, n, k / n AS p FROM c)
SELECT arm, n, round(p, 6) AS share, round(greatest((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 0), 6) AS low, round(least((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 1), 6) AS high FROM s""")
def hit_intervals(spark, d):
    c = _runs(spark, d).where("recall_at_5 IS NOT NULL").groupBy("arm").agg(F.sum((F.col("recall_at_5") > 0).cast("int")).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = M.wilson(F.col("k"), F.col("n"))
    return c.select("arm", "n", F.round(F.col("k") / F.col("n"), 6).alias("share"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"""WITH m AS (SELECT query_id, arm, avg(latency_ms) AS l FROM ({_RUNS}) WHERE latency_ms > 0 AND NOT isnan(latency_ms) GROUP BY ALL)
SELECT a.query_id, round(greatest(a.l, b.l) + 1e-6, 3) AS parallel_ms, round(a.l + b.l + 1e-6, 3) AS sequential_ms FROM m a JOIN m b ON a.query_id = b.query_id AND a.arm = 'arm-a-plain-top20' AND b.arm = 'arm-c-adaptive-rag'""")
def ensemble_latency(spark, d):
    """Two arms on the same question, side by side and one after the other; means first, so that a hot question joins as one row."""
    m = _runs(spark, d).where("latency_ms > 0 AND NOT isnan(latency_ms)").groupBy("query_id", "arm").agg(F.avg("latency_ms").alias("l"))
    a, b = (m.where(F.col("arm") == x).select("query_id", F.col("l").alias(n)) for x, n in (("arm-a-plain-top20", "a"), ("arm-c-adaptive-rag", "b")))
    return a.join(b, "query_id").select("query_id", F.round(F.greatest("a", "b") + 1e-6, 3).alias("parallel_ms"), F.round(F.col("a") + F.col("b") + 1e-6, 3).alias("sequential_ms"))


@query(f"""{ARBITRATED}, {_EDGES}, facts AS (SELECT subject AS entity, count(*) AS facts FROM edges GROUP BY 1), w AS (SELECT answer_id, list_filter(string_split({_key('question')}, ' '), lambda x: x <> '') AS w FROM ({ONCE})), grams AS ({_GRAMS}),
linked AS (SELECT answer_id, facts FROM grams JOIN facts USING (entity) WHERE length(entity) >= 3 QUALIFY row_number() OVER (PARTITION BY answer_id ORDER BY length(entity) DESC, entity) <= 8), n AS (SELECT answer_id, count(*) AS n_entities, sum(facts)::BIGINT AS n_facts FROM linked GROUP BY 1)
SELECT answer_id, arm, answer, score, coalesce(n_entities, 0) AS n_entities, coalesce(n_facts, 0) AS n_facts FROM chosen LEFT JOIN n USING (answer_id)""")
def answer_batch(spark, d):
    return P.answer_batch(load(spark, d, "selective_answers"), load(spark, d, "raw_triples"), load(spark, d, "reader_responses"))
