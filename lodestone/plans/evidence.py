"""Queries over evidence: the graph beyond direct neighbours, proofs, chains, anchors, and reports over runs."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lodestone.functions import parsing as Y, questions as Q, text as T
from lodestone.operators import anchors as H, chains as C, evidence as E, graph as G, metrics as M, proofs as V, ranking as R, search as S
from lodestone.plans import catalogue as K, pipelines as P, questions as PQ
from lodestone.plans.registry import ONCE, ORACLES, SPACE, key, norm, query, substantial
from lodestone.session import cut, load
from lodestone.sources import corpus
from lodestone.sources.loaders import html_text

_PAIRS = f"{K._EDGES}, both_ways AS (SELECT subject AS x, object AS y, confidence FROM edges UNION ALL SELECT object, subject, confidence FROM edges), near AS (SELECT x, y, max(confidence) AS c FROM both_ways GROUP BY ALL)"


@query(f"WITH {_PAIRS} SELECT x AS a, y AS b, c AS confidence FROM near WHERE x < y")
def graph_pairs(spark, d):
    return G.pairs(K._edges(spark, d))


@query(f"""WITH {K._EDGES}, l AS ({ORACLES['entity_links']}), asked AS (SELECT DISTINCT p.entity AS a, q.entity AS b FROM l p JOIN l q ON p.answer_id = q.answer_id AND p.entity < q.entity)
SELECT a, b, predicate, true AS forward FROM asked JOIN edges ON subject = a AND object = b UNION SELECT a, b, predicate, false FROM asked JOIN edges ON subject = b AND object = a""")
def linked_predicates(spark, d):
    """What connects two entities of one question."""
    l = K.entity_links(spark, d)
    asked = l.select("answer_id", F.col("entity").alias("a")).join(l.select("answer_id", F.col("entity").alias("b")), "answer_id").where("a < b")
    return G.predicates_between(K._edges(spark, d), asked)


_REACHED = f"""{_PAIRS}, l AS ({ORACLES['entity_links']}), src AS (SELECT DISTINCT entity AS source FROM l WHERE answer_id % 100 = 0), h1 AS (SELECT source, y AS node, c AS confidence, 1 AS hops, [source, y] AS path FROM src JOIN near ON x = source),
h2 AS (SELECT source, y AS node, confidence * c AS confidence, 2 AS hops, list_append(path, y) AS path FROM h1 JOIN near ON x = node WHERE y <> source),
best AS (SELECT * FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) QUALIFY row_number() OVER (PARTITION BY source, node ORDER BY confidence DESC, hops, path) = 1),
reached AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY confidence DESC, hops, node) AS rank FROM best QUALIFY rank <= 10)"""


def _reached(spark, d):
    src = K.entity_links(spark, d).where("answer_id % 100 = 0").select(F.col("entity").alias("source")).distinct()
    return G.reach(K._edges(spark, d), src)


@query(f"WITH {_REACHED} SELECT source, node, rank, round(confidence, 9) AS confidence, array_to_string(path, ' > ') AS path FROM reached")
def reachable_entities(spark, d):
    """What the entities of questions reach best within two hops."""
    return _reached(spark, d).select("source", "node", "rank", F.round("confidence", 9).alias("confidence"), F.array_join("path", " > ").alias("path"))


@query(f"""WITH {_REACHED}, held AS (SELECT DISTINCT least(subject, object) AS a, greatest(subject, object) AS b, chunk FROM edges WHERE chunk IS NOT NULL), steps AS (SELECT source || '|' || node AS id, unnest(range(0, len(path) - 1)) AS hop, path FROM reached)
SELECT id, min(hop)::INT AS hop, chunk FROM steps JOIN held ON a = least(path[hop + 1], path[hop + 2]) AND b = greatest(path[hop + 1], path[hop + 2]) GROUP BY id, chunk""")
def path_evidence(spark, d):
    """The chunks along those paths."""
    paths = _reached(spark, d).select(F.concat_ws("|", "source", "node").alias("id"), "path")
    return G.path_evidence(K._edges(spark, d), paths, "id")


@query(f"""WITH {_PAIRS}, b AS ({K.bm25_sql()}), l AS ({ORACLES['entity_links']}), h1 AS (SELECT DISTINCT answer_id, entity AS source, y AS node, c AS confidence, 1 AS hops FROM l JOIN near ON x = entity),
h2 AS (SELECT answer_id, source, y AS node, confidence * c AS confidence, 2 AS hops FROM h1 JOIN near ON x = node WHERE y <> source), one AS (SELECT answer_id, source, node, max(confidence) AS confidence FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL),
hops_of AS (SELECT o.*, min(h.hops) AS hops FROM one o JOIN (SELECT * FROM h1 UNION ALL SELECT * FROM h2) h USING (answer_id, source, node, confidence) GROUP BY ALL),
hood AS (SELECT * FROM hops_of QUALIFY row_number() OVER (PARTITION BY answer_id, source ORDER BY confidence DESC, hops, node) <= 200), every AS (SELECT answer_id AS query_id, node AS entity FROM hood UNION SELECT answer_id, entity FROM l),
m AS (SELECT DISTINCT {key('name')} AS entity, chunk_id FROM (SELECT chunk_id, unnest(entities) AS name FROM openie_results)), p AS (SELECT DISTINCT chunk_id, doc_id AS doc FROM chunks), s AS (SELECT DISTINCT query_id, doc FROM b JOIN p USING (doc) JOIN m USING (chunk_id) JOIN every USING (query_id, entity)),
r AS (SELECT query_id, doc, b.score + CASE WHEN s.doc IS NULL THEN 0 ELSE 2.0 END AS score FROM b LEFT JOIN s USING (query_id, doc)) SELECT query_id, doc, round(score + 1e-7, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, doc) AS rank FROM r""")
def neighbourhood_rerank(spark, d):
    """BM25 candidates whose document mentions what the question's entities reach within two hops (200 at most each) move up."""
    answers, edges = cut(K._answers(spark, d).select("answer_id", "question")), cut(K._edges(spark, d))
    ranked = cut(K.bm25_of(answers, spark, d))
    nodes = edges.select(F.col("subject").alias("entity")).union(edges.select("object")).distinct()
    links = cut(E.link_entities(answers, "answer_id", "question", nodes).select(F.col("answer_id").alias("query_id"), "entity"))
    sources = links.select(F.col("entity").alias("source"))
    near = G.neighbourhood(edges, sources, 2, 200).withColumnRenamed("node", "entity").unionByName(sources.distinct().withColumn("entity", F.col("source")))
    places = load(spark, d, "chunks").select("chunk_id", F.col("doc_id").alias("doc")).distinct()
    told = places.join(_mentions(spark, d), "chunk_id").select("doc", "entity").distinct()
    asked = ranked.select("query_id", "doc").join(links.withColumnRenamed("entity", "source"), "query_id").join(told, "doc")  # a question has few entities, but they reach many
    found = R.boost(ranked, asked.join(near, ["source", "entity"]), ["query_id", "doc"], "score", 2.0, "query_id", "doc")
    return found.select("query_id", "doc", F.round(F.col("score") + 1e-7, 4).alias("score"), "rank")


def _mentions(spark, d):
    own = load(spark, d, "openie_results").select("chunk_id", F.explode("entities").alias("name")).select("chunk_id", T.lookup_key(F.col("name")).alias("entity"))
    return own.where("entity <> ''").distinct()


# proofs

_SQUASH = f"trim(regexp_replace(lower(coalesce({{}}, '')), '{SPACE}+', ' ', 'g'))"
_PLAIN = rf"trim(regexp_replace(regexp_replace(lower(coalesce({{}}, '')), '[!-/:-@\[-`{{{{-~]', '', 'g'), '{SPACE}+', ' ', 'g'))".replace("{{{{", "{{").replace(SPACE, SPACE.replace("{", "{{").replace("}", "}}"))
_SQUASH = _SQUASH.replace(SPACE, SPACE.replace("{", "{{").replace("}", "}}"))


def _any(needle: str, hay: str) -> str:
    words = f"list_filter(string_split({needle}, ' '), lambda w: length(w) > 2)"
    return f"(len({words}) = 0 OR list_has_any({words}, string_split({hay}, ' ')))"


def _look(subject: str, object_: str) -> str:
    return f"""CASE WHEN source_chunk_id IS NULL THEN 'no source' WHEN text IS NULL THEN 'unknown source' WHEN {_SQUASH.format(object_)} = '' OR NOT contains({_SQUASH.format('text')}, {_SQUASH.format(object_)}) THEN 'span not found'
WHEN coalesce({subject}, '') <> '' AND NOT {_any(_PLAIN.format(subject), _PLAIN.format('text'))} THEN 'subject not grounded' WHEN coalesce({object_}, '') <> '' AND NOT {_any(_PLAIN.format(object_), _PLAIN.format(object_))} THEN 'object not grounded' WHEN {_PLAIN.format('claim')} = '' THEN 'empty claim' ELSE 'valid' END"""


def _overlap(a: str, b: str) -> str:
    words = f"list_distinct(list_filter(string_split({a}, ' '), lambda w: length(w) > 1))"
    return f"CASE WHEN {b} = '' THEN 0.0 WHEN len({words}) = 0 THEN 1.0 ELSE len(list_intersect({words}, string_split({b}, ' '))) / len({words}) END"


_PROVED = f"""t AS (SELECT DISTINCT triple_id, subject, predicate, object, source_chunk_id, confidence, concat_ws(' ', subject, predicate, object) AS claim, regexp_matches(coalesce(predicate, ''), 'located') AS located FROM raw_triples), c AS (SELECT chunk_id, max(text) AS text FROM chunks GROUP BY chunk_id),
j AS (SELECT t.*, text FROM t LEFT JOIN c ON chunk_id = source_chunk_id), r AS (SELECT *, {_look('subject', 'object')} AS one, {_look('object', 'subject')} AS two FROM j),
x AS (SELECT *, one = 'valid' AND two = 'valid' AS both_valid, located AND one = 'valid' AND two = 'valid' AS chained, coalesce(confidence, 0) >= 0.5 AS complete FROM r)"""


@query(f"""WITH {_PROVED}, l AS (SELECT *, greatest({_overlap(_PLAIN.format('object'), _PLAIN.format('object'))}, {_overlap(_PLAIN.format('object'), _PLAIN.format('subject'))}, {_overlap(_PLAIN.format('object'), _PLAIN.format('claim'))}) AS best FROM x)
SELECT triple_id, CASE WHEN NOT (both_valid AND chained) THEN 'invalid' WHEN complete THEN 'valid' ELSE 'partial' END AS status,
CASE WHEN one <> 'valid' AND two <> 'valid' THEN 'invalid' WHEN {_PLAIN.format('object')} = '' THEN 'partial' WHEN best >= 0.5 THEN 'valid' WHEN best >= 0.25 THEN 'partial' ELSE 'invalid' END AS liberal, concat_ws('|', one, two, CASE WHEN both_valid THEN 'valid' ELSE 'invalid' END, CASE WHEN chained THEN 'valid' ELSE 'invalid' END) AS reasons FROM l""")
def verified_triples(spark, d):
    """Every triple as a proof over its chunk: two lookups, one each way, their conjunction, and a transitive step."""
    t = load(spark, d, "raw_triples").select("triple_id", "subject", "predicate", "object", "source_chunk_id", "confidence").distinct()
    claim = F.concat_ws(" ", "subject", "predicate", "object")
    none = F.lit(None).cast("string")

    def step(n, rule, predicate, subject, object_, doc, span, inputs):
        return F.struct(F.lit(n).alias("step"), F.lit(rule).alias("rule"), predicate.alias("predicate"), subject.alias("subject"), object_.alias("object"), claim.alias("claim"), doc.alias("doc_id"), span.alias("span"), F.array(*[F.lit(i) for i in inputs]).cast("array<int>").alias("inputs"), none.alias("type_tag"))

    s, p, o, doc = F.col("subject"), F.col("predicate"), F.col("object"), F.col("source_chunk_id")
    chain = F.when(F.contains(F.coalesce(p, F.lit("")), F.lit("located")), "located_in").otherwise("related_to")
    steps = F.array(step(1, "lookup", p, s, o, doc, o, []), step(2, "lookup", p, o, s, doc, s, []), step(3, "conjunction", none, none, none, none, none, [1, 2]), step(4, "transitivity", chain, s, s, none, none, [1, 2]))
    trees = t.select("triple_id", steps.alias("steps"), (F.coalesce("confidence", F.lit(0.0)) >= 0.5).alias("is_complete"), o.alias("answer"))
    proved = V.verify(trees, "triple_id", load(spark, d, "chunks").select(F.col("chunk_id").alias("doc_id"), "text"))
    return proved.select("triple_id", "status", "liberal", F.array_join(F.transform("checked", lambda c: c["reason"]), "|").alias("reasons"))


@query(f"""WITH v AS ({ORACLES.get('verified_triples', '')}), t AS (SELECT DISTINCT triple_id, {key('predicate')} AS predicate FROM raw_triples), d AS (SELECT unnest(['valid', 'partial', 'invalid', 'refuse']) AS liberal)
SELECT d.liberal, count(v.triple_id) AS n FROM d LEFT JOIN v USING (liberal) GROUP BY d.liberal""")
def proof_statuses(spark, d):
    """How many proofs have each liberal status; a status without any has 0."""
    known = spark.createDataFrame([(x,) for x in ("valid", "partial", "invalid", "refuse")], "liberal string")
    return known.join(verified_triples(spark, d).groupBy("liberal").agg(F.count(F.lit(1)).alias("n")), "liberal", "left").na.fill({"n": 0})


@query(f"""WITH v AS ({ORACLES.get('verified_triples', '')}), t AS (SELECT DISTINCT triple_id, {key('predicate')} AS predicate FROM raw_triples) SELECT predicate, count(*) AS n, sum((liberal = 'valid')::INT)::BIGINT AS good, round(sum((liberal = 'valid')::INT) / count(*), 6) AS rate FROM t JOIN v USING (triple_id) GROUP BY predicate""")
def proof_rates(spark, d):
    """The share of valid proofs by predicate."""
    t = load(spark, d, "raw_triples").select("triple_id", T.lookup_key(F.col("predicate")).alias("predicate")).distinct()
    return M.rates(t.join(verified_triples(spark, d), "triple_id"), "predicate", "liberal")


# chains

_CHAIN_WORDS = "list_filter(list_distinct(string_split({}, ' ')), lambda w: w <> '')"


@query(f"""WITH {PQ.FEATURES}, b AS ({ORACLES['bm25_top_k']}), cand AS (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM b), docs AS (SELECT DISTINCT doc_id AS doc, {key('text')} AS k FROM documents),
places AS (SELECT DISTINCT chunk_id, doc_id AS doc FROM chunks), f AS (SELECT query_id, lower(subject) AS ls, lower(predicate) AS lp, lower(object) AS lo, min((rank * 1000000000000 + triple_id, subject, object, coalesce(confidence, 0.7))) AS m FROM cand JOIN places USING (doc) JOIN (SELECT DISTINCT triple_id, subject, predicate, object, source_chunk_id, confidence FROM raw_triples) ON source_chunk_id = chunk_id GROUP BY ALL),
one AS (SELECT query_id, m[1] AS place, m[2] AS subject, m[3] AS object, m[4] AS gamma, {_CHAIN_WORDS.format(key('m[2]'))} AS sw, {_CHAIN_WORDS.format(key('m[3]'))} AS ow FROM f),
kept AS (SELECT o.query_id, place, subject, object, gamma, sw, list_distinct(list_concat(sw, ow)) AS w, len(list_intersect(list_distinct(list_concat(sw, ow)), {_CHAIN_WORDS.format(key('q'))})) AS n FROM one o JOIN features ON answer_id = query_id WHERE greatest(np_depth, n_relations) >= 2 OR has_chain),
four AS (SELECT * FROM kept WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, place, subject, object) <= 4), sized AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total FROM cand JOIN docs USING (doc)),
chain AS (SELECT query_id, doc, round(sum(CASE WHEN greatest(least(gamma, 1.0), 0.0) >= 0.66 THEN 1.0 WHEN greatest(least(gamma, 1.0), 0.0) >= 0.33 THEN 0.5 ELSE 0.0 END * greatest(least(gamma, 1.0), 0.0)) * max(CASE WHEN total > 1 THEN 1.0 + 0.5 * (total - rank) / (total - 1) ELSE 1.0 END), 9) AS chain
FROM sized JOIN four USING (query_id) WHERE len(sw) > 0 AND list_has_all(string_split(k, ' '), w) GROUP BY ALL), s AS (SELECT query_id, doc, rank, score, coalesce(chain, 0.0) AS chain FROM cand LEFT JOIN chain USING (query_id, doc)),
p AS (SELECT *, (rank() OVER (PARTITION BY query_id ORDER BY chain) + (count(*) OVER (PARTITION BY query_id, chain) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY query_id) AS a, (rank() OVER (PARTITION BY query_id ORDER BY score) + (count(*) OVER (PARTITION BY query_id, score) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY query_id) AS b, max(chain) OVER (PARTITION BY query_id) > 0 AS chained FROM s)
SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN chained THEN round(0.9 * a + 0.1 * b, 9) ELSE 0.0 END DESC, rank) AS rank, chained FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN chained THEN round(0.9 * a + 0.1 * b, 9) ELSE 0.0 END DESC, rank) <= 5""")
def chain_reranked(spark, d):
    """BM25 candidates reranked by the triples of their chunks, for questions of several hops; gamma is a triple's confidence."""
    asked = PQ._asked(spark, d).where("answer_id % 100 = 0").join(PQ.question_gates(spark, d).select("answer_id", F.col("several_hops").alias("gate")), "answer_id").withColumnRenamed("answer_id", "query_id")
    ranked = cut(K.bm25_top_k(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc"))))
    texts = load(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text").distinct()
    places = load(spark, d, "chunks").select("chunk_id", F.col("doc_id").alias("doc")).distinct()
    triples = load(spark, d, "raw_triples").select("triple_id", "subject", "predicate", "object", F.col("source_chunk_id").alias("chunk_id"), F.coalesce("confidence", F.lit(0.7)).alias("gamma")).distinct()
    facts = ranked.select("query_id", "doc", "rank").join(places, "doc").join(triples, "chunk_id").select("query_id", "subject", "predicate", "object", "gamma", (F.col("rank") * 1_000_000_000_000 + F.col("triple_id")).alias("place"))
    return C.chain_rerank(asked, ranked.join(texts, "doc"), facts)


_FINAL = r"regexp_replace(trim(CASE WHEN regexp_matches(text, '(?:Final answer|Final Answer|FINAL ANSWER|final answer):') THEN regexp_extract(text, '(?:Final answer|Final Answer|FINAL ANSWER|final answer):[\s]*([^\n]*)', 1) ELSE regexp_extract(regexp_replace(text, '\s+$', ''), '([^\n]*)$', 1) END), '\.+$', '')"


@query(f"SELECT DISTINCT response_id, trim({_FINAL}) AS answer FROM reader_responses WHERE text IS NOT NULL")
def final_answers(spark, d):
    return load(spark, d, "reader_responses").where("text IS NOT NULL").select("response_id", Y.final_answer(F.col("text")).alias("answer")).distinct()


@query()
def hop_coherence(spark, d):
    """The responses to a question as hops, each a context whose last line is its answer."""
    r = load(spark, d, "reader_responses").where("qid IS NOT NULL AND text IS NOT NULL").select("response_id", "qid", "text").distinct()
    return C.coherence(r.select("qid", F.col("response_id").alias("hop"), Y.final_answer(F.col("text")).alias("answer"), F.col("text").alias("context")), "qid")


@query(f"""WITH l AS (SELECT answer_id, entity, position FROM ({ORACLES['entity_links']}) WHERE answer_id % 100 = 0), b AS ({ORACLES['bm25_top_k']}), c AS (SELECT query_id, doc, lower(coalesce(text, '')) AS t, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS place FROM b JOIN (SELECT DISTINCT doc_id AS doc, text FROM documents) USING (doc)),
n AS (SELECT answer_id, count(*) AS n FROM l GROUP BY 1), a AS (SELECT query_id, doc, place, min(position) AS spot FROM c JOIN l ON answer_id = query_id AND contains(t, entity) GROUP BY ALL)
SELECT c.query_id, c.doc, row_number() OVER (PARTITION BY c.query_id ORDER BY coalesce(spot, n + 1), c.place)::INT AS position FROM c JOIN n ON n.answer_id = c.query_id LEFT JOIN a USING (query_id, doc)""")
def spine_order(spark, d):
    """BM25 candidates in the order of the question's entities that they mention."""
    spine = K.entity_links(spark, d).where("answer_id % 100 = 0").groupBy(F.col("answer_id").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("position", "entity"))).alias("s")).select("query_id", F.transform("s", lambda x: x["entity"]).alias("spine"))
    ranked = K.bm25_top_k(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")))
    texts = load(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text").distinct()
    return C.along_spine(ranked.join(texts, "doc").join(spine, "query_id"), "query_id", "spine", "text", "place").select("query_id", "doc", "position")


@query()
def aspect_agreement(spark, d):
    """Which share of the arms has each aspect of an answer."""
    arms = K._answers(spark, d).select("answer_id", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(c).alias("answer")) for a, c in P.ARMS.items()])).alias("e")).select("answer_id", "e.*")
    aspects = arms.select("answer_id", "arm", F.explode(Q.aspects(F.col("answer"))).alias("aspect"))
    return C.aspect_agreement(arms, "answer_id", aspects)


@query(f"""WITH {K.ARM_SQL}, r AS (SELECT o.qid, answer_id, {norm('pred')} AS answer, gamma FROM ({ONCE}) o JOIN (SELECT answer_id, gamma FROM signals WHERE arm = 'iter') USING (answer_id)), w AS (SELECT *, lag(answer) OVER o AS before, row_number() OVER o AS n FROM r WINDOW o AS (PARTITION BY qid ORDER BY answer_id)),
f AS (SELECT qid, min(answer_id) AS first_id FROM w WHERE n > 1 AND before = answer AND answer <> '' AND coalesce(gamma, 0) >= 0.7 GROUP BY qid) SELECT f.qid, first_id AS "at", answer FROM f JOIN r ON r.qid = f.qid AND answer_id = first_id""")
def converged_answers(spark, d):
    """Where the reruns of a question repeat an answer that stands in the responses."""
    gamma = K._arms(spark, d).where("arm = 'iter'").select("answer_id", "gamma")
    a = K._answers(spark, d).select("qid", "answer_id", T.normalize_answer(F.col("pred")).alias("answer")).join(gamma, "answer_id")
    return R.converged(a, "qid", "answer_id", "answer", "gamma")


@query(f"""WITH r AS (SELECT qid, answer_id, {norm('pred')} AS answer FROM ({ONCE})), l AS (SELECT qid, arg_max(answer, answer_id) AS last, count(*) AS n, count(DISTINCT answer) AS distinct FROM r GROUP BY qid)
SELECT l.qid, any_value(n) AS n, any_value(l.distinct) AS "distinct", round(CASE WHEN any_value(n) > 1 THEN (sum((answer = last)::INT) - 1) / (any_value(n) - 1) ELSE 1.0 END, 6) AS share FROM r JOIN l ON r.qid = l.qid GROUP BY l.qid""")
def answer_stability(spark, d):
    """How far the reruns of a question agree with the last one."""
    return R.stability(K._answers(spark, d).select("qid", "answer_id", T.normalize_answer(F.col("pred")).alias("answer")), "qid", "answer_id", "answer")


# reports

_MEASURED = f"SELECT arm, category, latency_ms FROM ({K._RUNS}) WHERE latency_ms >= 0 AND NOT isnan(latency_ms)"


@query(f"""WITH m AS ({_MEASURED}), b AS (SELECT category, latency_ms FROM m UNION ALL SELECT 'all categories', latency_ms FROM m) SELECT category, count(*) AS n, round(avg(latency_ms), 4) AS mean_ms, round(quantile_cont(latency_ms, 0.5) + 1e-6, 3) AS p50, round(quantile_cont(latency_ms, 0.95) + 1e-6, 3) AS p95, round(quantile_cont(latency_ms, 0.99) + 1e-6, 3) AS p99 FROM b GROUP BY category""")
def category_summary(spark, d):
    """Latency by category and over all, percentiles between the two nearest ranks."""
    m = K._runs(spark, d).where("latency_ms >= 0 AND NOT isnan(latency_ms)").select("category", "latency_ms")
    both = m.unionByName(m.withColumn("category", F.lit("all categories")))
    p = M.exact_percentiles(both, ["category"], "latency_ms", [0.5, 0.95, 0.99], linear=True)
    wide = p.groupBy("category", "n").agg(*[F.round(F.max(F.when(F.col("p") == v, F.col("latency_ms"))) + 1e-6, 3).alias(c) for v, c in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])
    mean = both.groupBy("category").agg(F.round(F.avg("latency_ms"), 4).alias("mean_ms"))
    return wide.join(mean, wide.category.eqNullSafe(mean.category)).select(wide.category, "n", "mean_ms", "p50", "p95", "p99")


@query(f"""WITH r AS ({K._RUNS}), m AS (SELECT arm, count(*) AS n, round(avg(latency_ms), 4) AS mean_ms, min(latency_ms) AS least_ms, max(latency_ms) AS most_ms, round(sum(latency_ms) / 1000, 3) AS total_s, round(count(*) / (sum(latency_ms) / 1000), 6) AS per_second FROM r WHERE latency_ms > 0 AND NOT isnan(latency_ms) GROUP BY arm),
t AS (SELECT arm, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum(cost_cents) / count(*) * 10, 4) AS dollars_per_1000 FROM r GROUP BY arm) SELECT * FROM m JOIN t USING (arm)""")
def latency_report(spark, d):
    """Latency, throughput, tokens and cost of each arm; runs without a latency count for tokens and cost only."""
    r = K._runs(spark, d)
    ms = F.col("latency_ms")
    m = r.where("latency_ms > 0 AND NOT isnan(latency_ms)").groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ms), 4).alias("mean_ms"), F.min(ms).alias("least_ms"), F.max(ms).alias("most_ms"), F.round(F.sum(ms) / 1000, 3).alias("total_s"), F.round(F.count(F.lit(1)) / (F.sum(ms) / 1000), 6).alias("per_second"))
    t = r.groupBy("arm").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("cost_cents") / F.count(F.lit(1)) * 10, 4).alias("dollars_per_1000"))
    return m.join(t, "arm")


@query(f"""WITH {K.ARM_SQL}, j AS (SELECT s.*, decision FROM signals s JOIN (SELECT answer_id, decision FROM ({ONCE})) USING (answer_id)), x AS (SELECT decision, {K._strip('answer')} = '' OR regexp_matches({K._strip('answer')}, 'not in passages|not in the passages|no answer|cannot determine|i don''t know|i do not know') AS out, coalesce(gamma, 0) AS g FROM j)
SELECT decision, count(*) AS n, sum(out::INT)::BIGINT AS n_abstain, round(sum(CASE WHEN out THEN 0 ELSE g END) / count(*), 6) AS inclusive, round(sum(CASE WHEN out THEN 0 ELSE g END) / greatest(count(*) - sum(out::INT), 1), 6) AS strict FROM x GROUP BY decision""")
def faithfulness_report(spark, d):
    """How far answers stand in the responses to their questions, by decision."""
    arms = K._arms(spark, d).join(K._answers(spark, d).select("answer_id", "decision"), "answer_id")
    return M.faithfulness(arms, "gamma", T.is_unfaithful(F.col("answer")), "decision")


@query(f"""WITH {K.ARM_SQL}, x AS (SELECT answer_id, arm, answer, CASE WHEN gamma >= 0.66 THEN 'valid' WHEN gamma >= 0.33 THEN 'partial' WHEN gamma IS NOT NULL THEN 'invalid' END AS status FROM signals)
SELECT answer_id, arm, status, CASE status WHEN 'valid' THEN 1.0 WHEN 'partial' THEN 0.5 WHEN 'invalid' THEN 0.0 END::DOUBLE AS signal, coalesce(status = 'invalid', false) AND {substantial('answer')} AS suppressed FROM x""")
def suppressed_answers(spark, d):
    """Whether an answer whose words the responses do not have keeps the cascade from running all the same."""
    from lodestone.operators import arbitration as A

    g = F.col("gamma")
    x = K._arms(spark, d).withColumn("status", F.when(g >= 0.66, "valid").when(g >= 0.33, "partial").when(g.isNotNull(), "invalid"))
    return x.select("answer_id", "arm", "status", A.status_gamma(F.col("status")).alias("signal"), A.suppress(F.col("answer"), F.col("status")).alias("suppressed"))


@query(f"""WITH b AS ({ORACLES['bm25_top_k']}), f AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM b), g AS (SELECT answer_id AS query_id, doc_id AS doc FROM (SELECT answer_id, {key('gold')} AS k FROM ({ONCE}) WHERE answer_id % 100 = 0 AND length({key('gold')}) >= 3)
JOIN (SELECT DISTINCT chunk_id, {key('name')} AS k FROM (SELECT chunk_id, unnest(entities) AS name FROM openie_results)) USING (k) JOIN (SELECT DISTINCT chunk_id, doc_id FROM chunks) USING (chunk_id)), e AS (SELECT g.query_id, g.doc, count(*) AS rows, max((rank <= 5)::INT) AS hit FROM g LEFT JOIN f ON f.query_id = g.query_id AND f.doc = g.doc GROUP BY ALL)
SELECT query_id, round(avg(coalesce(hit, 0)), 6) AS recall, round(sum(coalesce(hit, 0) * rows) / sum(rows), 6) AS list_recall FROM e GROUP BY query_id""")
def answer_recall(spark, d):
    """How much of the documents that mention the labelled answer is found, by documents and by mentions."""
    found = K.bm25_top_k(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")))
    gold = K._answers(spark, d).where("answer_id % 100 = 0").select(F.col("answer_id").alias("query_id"), T.lookup_key(F.col("gold")).alias("entity")).where("length(entity) >= 3")
    places = load(spark, d, "chunks").select("chunk_id", F.col("doc_id").alias("doc")).distinct()
    return M.list_recall(found, gold.join(_mentions(spark, d), "entity").join(places, "chunk_id").select("query_id", "doc"), "query_id", "doc", 5)


@query()
def surface_keys(spark, d):
    """The ASCII keys of names, accents folded."""
    names = load(spark, d, "raw_triples").select("subject").distinct()
    return names.select("subject", T.surface_key("subject").alias("surface"))


# corpora, question sets, anchors


@query(rf"""WITH t AS (SELECT DISTINCT chunk_id, doc_id, pos, s.source_key FROM chunks JOIN (SELECT DISTINCT doc_id, source_key FROM documents) s USING (doc_id)), x AS (SELECT *, regexp_replace(trim(regexp_replace(lower(coalesce(source_key, '')), '[^\p{{L}}\p{{M}}\p{{N}}_\x{{9}}-\x{{D}}\p{{Z}}-]+', '', 'g')), '[\x{{9}}-\x{{D}}\p{{Z}}-]+', '-', 'g') AS s FROM t)
SELECT chunk_id, 'doc_' || CASE WHEN s = '' THEN 'unknown' ELSE s END || '_chunk_' || pos AS corpus_id, coalesce(nullif(source_key, ''), doc_id::VARCHAR) AS passage FROM x""")
def corpus_ids(spark, d):
    """The ids of chunks in a prepared corpus, by the key of their document, and of passages."""
    docs = load(spark, d, "documents").select("doc_id", "source_key").distinct()
    rows = load(spark, d, "chunks").select("chunk_id", "doc_id", "pos").distinct().join(docs, "doc_id")
    return rows.select("chunk_id", corpus.chunk_ids(F.col("source_key"), F.col("pos")).alias("corpus_id"), corpus.passage_ids(F.col("source_key"), F.lit(None), F.col("doc_id"), F.col("chunk_id")).alias("passage"))


@query(f"""WITH a AS (SELECT qid, question, gold, v3bu_pred, {key('gold')} AS t FROM ({ONCE}) WHERE qid IS NOT NULL) SELECT DISTINCT qid, question, gold AS answer, 'paragraphs' AS dialect, CASE WHEN v3bu_pred IS NULL THEN 0 ELSE 1 END AS n_aliases, 1 AS n_supporting FROM a""")
def question_sets(spark, d):
    """The questions written as records of one dialect and read back as the common form."""
    a = K._answers(spark, d).where("qid IS NOT NULL")
    paragraphs = F.array(*[F.struct(F.lit(i).alias("idx"), F.col(c).alias("title"), F.col(c).alias("paragraph_text"), F.lit(i == 0).alias("is_supporting")) for i, c in enumerate(("gold", "pred"))])
    record = F.to_json(F.struct(F.col("qid").alias("id"), "question", F.col("gold").alias("answer"), F.filter(F.array("v3bu_pred"), lambda x: x.isNotNull()).alias("answer_aliases"), paragraphs.alias("paragraphs")))
    read = corpus.normalize_questions(a.select(record.alias("record")), "paragraphs")
    return read.select("qid", "question", "answer", F.lit("paragraphs").alias("dialect"), F.size("aliases").alias("n_aliases"), F.size("supporting").alias("n_supporting")).distinct()


@query(f"SELECT DISTINCT qid FROM ({ONCE}) WHERE qid IS NOT NULL EXCEPT SELECT qid FROM reader_responses WHERE qid IS NOT NULL")
def open_questions(spark, d):
    """The questions that no response answers yet: where a broken run goes on."""
    asked = K._answers(spark, d).select("qid").where("qid IS NOT NULL").distinct()
    done = load(spark, d, "reader_responses").select("qid", F.lit(0.0).alias("em"), F.lit(0.0).alias("f1"))
    return corpus.resume(asked, done)[0]


@query(r"""SELECT DISTINCT doc_id, regexp_replace(text, '^[\x{9}-\x{D}\x{1C}-\x{1F}\x{85}\p{Z}]+|[\x{9}-\x{D}\x{1C}-\x{1F}\x{85}\p{Z}]+$', '', 'g') AS text FROM documents WHERE text IS NOT NULL""")
def html_texts(spark, d):
    """Documents written as pages of HTML and read back: heads, menus and scripts go, entities are resolved."""
    docs = load(spark, d, "documents").select("doc_id", "text").where("text IS NOT NULL").distinct()
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><head><title>t</title></head><body><nav>menu</nav><p>"), escaped, F.lit("</p><script>x()</script><footer>f</footer></body></html>"))
    return docs.select("doc_id", html_text(page).alias("text"))


@query()
def compared_passages(spark, d):
    """For comparisons: the passages of each compared entity by BM25, taken in turn."""
    q = F.col("question")
    asked = PQ._asked(spark, d).where("answer_id % 100 = 0").where(Q.is_comparison(q)).select("answer_id", F.posexplode(F.slice(Q.compared_entities(q), 1, 3)).alias("place", "entity"), F.array_join(Q.comparison_attributes(q), " ").alias("about"))
    each = cut(asked.select("answer_id", "place", (F.col("answer_id") * 8 + F.col("place")).alias("id"), F.concat_ws(" ", "entity", "about").alias("text")))
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").distinct()
    found = S.bm25(each.select("id", "text"), docs, 15)
    lists = found.select(F.floor(F.col("query_id") / 8).alias("answer_id"), (F.col("query_id") % 8).alias("place"), "rank", "doc")
    return R.round_robin(lists, "answer_id", "place", "rank", "doc", 10)


@query()
def anchor_routes(spark, d):
    """Where the chunks whose id is divisible by 100, as queries, are sent: anchors of four layers, boosts, policy."""
    rows = load(spark, d, "chunks").select("vec_id", "chunk_id", "doc_id", "text", F.col("embedding").alias("vector"))
    sound = F.col("vector").isNotNull() & (F.size("vector") == 64) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("vector", lambda x: x != 0)
    chunks = cut(rows.where(sound).groupBy("chunk_id").agg(F.min(F.struct("vec_id", "doc_id", "text", "vector")).alias("r")).select("chunk_id", "r.*"))
    mentions = cut(_mentions(spark, d))
    members, anchors = H.build(chunks.select("chunk_id", "doc_id", "vector"), mentions, K._edges(spark, d), 64)
    queries = chunks.where("vec_id % 100 = 0")
    links = E.link_entities(queries, "vec_id", "text", members.select("entity").distinct()).select(F.col("vec_id").alias("query_id"), "entity")
    top = H.classify(queries.select(F.col("vec_id").alias("id"), "vector"), links, members, anchors, 64)
    sizes = members.join(mentions, "entity").select("anchor", "chunk_id").distinct().groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    return H.route(top, sizes).select("query_id", "route", F.array_join("anchors", "|").alias("anchors"))
