"""Queries over questions: features, scores, classes, arm probabilities, gates and hints."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import questions as Q
from lodestone.plans import pipelines as P
from lodestone.plans.registry import ONCE, plain, query
from lodestone.session import load


def _asked(spark, d):
    """``answer_id, question`` of the distinct answers."""
    return load(spark, d, "selective_answers").select("answer_id", "question").distinct()


_ASKED = f"asked AS (SELECT DISTINCT answer_id, question, coalesce(question, '') AS q, {plain('question')} AS t FROM selective_answers)"
_RELATION = (
    r"directed\s+by|written\s+by|produced\s+by|composed\s+by|founded\s+by|directed|direct|directs|wrote|written|writes|writing|born|birth|died|death|married|marries|marriage|founded|founding|owned|owns|owning|"
    "starred|stars|starring|played|plays|playing|published|publishes|publishing|created|creates|creating|authored|authors|produced|produces|producing|composed|composes|designed|designs|adapted|adapts|adaptation|"
    "succeeded|preceded|director|actor|actress|spouse|wife|husband|mother|father|parent|son|daughter|child|children|brother|sister|sibling|founder|creator|owner|author|publisher|composer|producer|designer|"
    "predecessor|successor|star|grandfather|grandmother|grandparent|grandparents|grandson|granddaughter|grandchild|grandchildren|aunt|uncle|nephew|niece|cousin|cousins|stepfather|stepmother|stepsister|"
    "stepbrother|stepson|stepdaughter|stepchild|godfather|godmother|godson|goddaughter"
)
_COMPARATIVE = "first|earlier|later|earliest|latest|older|younger|oldest|youngest|longer|shorter|longest|shortest|before|after|biggest|smallest|highest|lowest|tallest|born|died|lived"
_KIN = (
    "father|mother|parent|son|daughter|child|children|brother|sister|sibling|spouse|wife|husband|grandfather|grandmother|grandparent|grandson|granddaughter|grandchild|aunt|uncle|nephew|niece|cousin|"
    "stepfather|stepmother|stepsister|stepbrother|stepson|stepdaughter|godfather|godmother|godson|goddaughter"
)
_THAN = "older|younger|larger|smaller|taller|shorter|earlier|later|longer|wider|deeper|richer|poorer|faster|slower|more|less|better|worse"
_NAME = r"[A-Z]\w*(?:\s+(?:(?i:and|of|on|in|at|the|to|for|by|with|from|de|la|le|du|von|van)|&|[A-Z]\w*))*"
_NAME_OR = r"[A-Z]\w*(?:\s+(?:(?i:and|or|of|on|in|at|the|to|for|by|with|from|de|la|le|du|von|van)|&|[A-Z]\w*))*"
# negative look-ahead is rewritten as a test of what lies in between
_MIDDLE_THAN = rf"regexp_extract(t, '^\s*(?i:are|is|was|were|did|do|does|which|who|what)\b([^?]{{0,30}}?)\b(?i:{_THAN}|higher|lower|greater)\s+than\b', 1)"
_MIDDLE_CHOICE = rf"regexp_extract(t, '^\s*(?i:which|who|what|between)\b([^?]*?),\s+{_NAME}\s+(?i:or)\s+{_NAME}\s*\??\s*$', 1)"
_POLAR = rf"""(regexp_matches(t, '^\s*(?i:are|is|was|were|did|do|does|have|has|can|could|would|will)\b[^?]*\b(?i:both|same|either|neither)\b')
OR (regexp_matches(t, '^\s*(?i:are|is|was|were|did|do|does|which|who|what)\b[^?]{{0,30}}?\b(?i:{_THAN}|higher|lower|greater)\s+than\b') AND NOT regexp_matches({_MIDDLE_THAN}, '\b(?i:who|whose|which|that|whom)\b'))
OR regexp_matches(t, '^\s*{_NAME_OR}\s+(?i:or)\s+{_NAME}\s*\??\s*$')
OR (regexp_matches(t, '^\s*(?i:which|who|what|between)\b[^?]*?,\s+{_NAME}\s+(?i:or)\s+{_NAME}\s*\??\s*$') AND NOT regexp_matches({_MIDDLE_CHOICE}, '\b(?i:who|whose|which|that|whom|has|have|had)\b')))"""
_HEADS = "'who', 'what', 'when', 'where', 'why', 'how', 'which', 'whose', 'whom', 'is', 'are', 'was', 'were', 'did', 'do', 'does', 'the', 'an', 'a', 'in', 'of', 'on', 'at', 'to', 'by'"
FEATURES = rf"""{_ASKED}, features AS (SELECT answer_id, q, t, len(regexp_extract_all(t, '\b\w+\b')) AS n_tokens,
len(list_filter(list_distinct(list_transform(regexp_extract_all(t, '\b[A-Z][a-zA-Z0-9''\-]+(?:\s+(?:of|the|de|la|le|du|von|van|and|&|[A-Z][a-zA-Z0-9''\-]+))*'), lambda x: lower(x))), lambda x: x NOT IN ({_HEADS}))) AS n_entities,
len(list_distinct(list_transform(regexp_extract_all(t, '(?i)\b(?:{_RELATION})\b'), lambda x: lower(x)))) AS n_relations,
len(regexp_extract_all(t, '(?i)\bof\b')) + (regexp_matches(t, '(?i)\bof\s+(?:the\s+)?\w+(?:\s+\w+){{0,2}}\s+(?:who|which|that)\b'))::INT AS np_depth,
len(regexp_extract_all(t, '(?i)\bof\b')) >= 2 OR regexp_matches(t, '(?i)\bof\s+(?:the\s+)?\w+(?:\s+\w+){{0,2}}\s+(?:who|which|that)\b') AS has_chain, {_POLAR} AS is_polar,
regexp_matches(t, '(?i)\bor\b') AND regexp_matches(t, '(?i)\b(?:{_COMPARATIVE})\b') AS is_comparative_selection, regexp_matches(t, '(?i)''s\s+(?:\w+\s+)?(?:{_KIN})\b') AS is_kinship_possessive FROM asked),
labels AS (SELECT *, CASE WHEN n_tokens < 15 AND (has_chain OR (n_relations >= 2 AND n_tokens >= 8) OR (n_relations >= 1 AND n_entities >= 2)) THEN 'bridge_entity' ELSE 'semantic_rich' END AS cohort_v1 FROM features),
classes AS (SELECT *, CASE WHEN np_depth >= 3 OR n_relations >= 3 THEN 'chain_deep' ELSE cohort_v1 END AS cohort FROM labels)"""


@query(f"WITH {FEATURES} SELECT answer_id, n_tokens, n_entities, n_relations, np_depth, has_chain, is_polar, is_comparative_selection, is_kinship_possessive FROM features")
def question_features(spark, d):
    return _asked(spark, d).select("answer_id", *[c.alias(n) for n, c in Q.features(F.col("question")).items()])


@query(f"WITH {FEATURES} SELECT answer_id, cohort_v1, cohort FROM classes")
def question_cohorts(spark, d):
    f = question_features(spark, d)
    held = {c: F.col(c) for c in f.columns}
    return f.select("answer_id", Q.class_v1(held).alias("cohort_v1"), Q.class_v2(held).alias("cohort"))


def _graded(pattern: str, low: str, step: str, most: int) -> str:
    n = f"len(regexp_extract_all(t, '{pattern}'))"
    return f"CASE WHEN {n} > 0 THEN least({low} + {step} * least({n}, {most}), 1.0) ELSE 0.0 END::DOUBLE"


_VERBS = "is|was|has|had|did|does|founded|wrote|directed|composed|invented|discovered|owns|owned|acquired|started|published|released|established|created|signed|elected|played|hosted|formed|developed"
_ATTRIBUTE = r"born|died|death|birth|birthplace|birthday|founded|established|created|spouse|wife|husband|partner|nationality|occupation|profession|age|religion|alma\s+mater|capital|population|area|height|headquartered|based|located"
SCORES = rf"""{_ASKED}, runs AS (SELECT *, regexp_extract_all(t, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b') AS r FROM asked), inner_runs AS (SELECT *, list_filter(r, lambda n: contains(n, ' ') OR NOT starts_with(ltrim(q), n)) AS i FROM runs),
one AS (SELECT *, CASE WHEN len(i) = 1 THEN 0.8 WHEN len(i) = 0 AND len(r) >= 1 THEN 0.4 ELSE 0.0 END::DOUBLE AS single_entity, CASE WHEN len(list_distinct(i)) = 2 THEN 0.8 ELSE 0.0 END::DOUBLE AS two_entities,
{_graded(rf'(?i)\b(?:{_ATTRIBUTE})\b', '0.4', '0.3', 2)} AS attribute,
CASE WHEN regexp_matches(t, '(?i)\bthat\b(?:\s+\w+){{0,6}}\s+(?:{_VERBS})') THEN 0.9 WHEN contains(lower(q), ' of the ') OR contains(lower(q), ' of which ') THEN 0.6 ELSE 0.0 END::DOUBLE AS multi_hop,
{_graded(r'(?i)\b(?:first|then|later|subsequently|after that|prior to|following|next)\b', '0.5', '0.2', 3)} AS chain,
{_graded(r'(?i)\b(?:19|20)[0-9]{2}\b|\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\b|\b(?:yesterday|today|tomorrow|recently|currently|previously|formerly|earlier|later)\b', '0.4', '0.2', 3)} AS temporal,
CASE WHEN regexp_matches(t, '(?i)\b(?:both|either|neither|vs|versus|or)\b|\b(?:{_THAN}) than\b') THEN 0.7 ELSE 0.0 END::DOUBLE AS comparison,
len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) / 25.0 + 0.2 * (length(q) - length(replace(q, ',', ''))) + 0.3 * (len(regexp_extract_all(t, '(?i)\b(?:that|which|who|whom|whose)\b')) - (regexp_matches(ltrim(t), '(?i)^(?:that|which|who|whom|whose)\b'))::INT) AS raw,
CASE WHEN {_POLAR} THEN 1.0 ELSE 0.0 END::DOUBLE AS polar FROM inner_runs),
scores AS (SELECT *, CASE WHEN regexp_matches(t, '(?i)\b(?:of the|of [A-Z])\b') THEN CASE WHEN two_entities > 0 THEN 0.8 ELSE 0.5 END ELSE 0.0 END::DOUBLE AS bridge_entity, CASE WHEN raw < 0.4 THEN 0.0 ELSE least(raw, 1.0) END::DOUBLE AS complexity,
CASE WHEN regexp_matches(t, '\b\w+''s\s+\w+\b') THEN CASE WHEN multi_hop < 0.3 THEN 0.7 ELSE 0.4 END ELSE 0.0 END::DOUBLE AS single_hop FROM one)"""
_ELEVEN = ("single_entity", "attribute", "multi_hop", "bridge_entity", "chain", "temporal", "comparison", "complexity", "two_entities", "single_hop", "polar")


@query(f"WITH {SCORES} SELECT answer_id, {', '.join(f'round({c}, 6) AS {c}' for c in _ELEVEN)} FROM scores")
def question_scores(spark, d):
    return _asked(spark, d).select("answer_id", *[F.round(c, 6).alias(n) for n, c in Q.scores(F.col("question")).items()])


_HOPS = """hops AS (SELECT *, polar > 0 AS h_polar, single_hop = 0 AND two_entities > 0 AND chain = 0 AND bridge_entity > 0 AS h_bridge, chain > 0 AND two_entities > 0 AND multi_hop > 0 AS h_chain,
single_entity > 0 AND attribute > 0 AND two_entities = 0 AND multi_hop = 0 AND chain = 0 AS h_attribute FROM scores), general AS (SELECT *, multi_hop > 0 AND NOT h_polar AND NOT h_bridge AND NOT h_chain AND NOT h_attribute AS h_general FROM hops),
probable AS (SELECT *, CASE WHEN h_polar OR h_attribute THEN 2.0 WHEN h_bridge OR h_chain THEN 0.1 ELSE 1.0 END / (1 + exp(-(0.5 * single_entity + 0.4 * attribute + 0.3 * single_hop + CASE WHEN h_polar THEN 0.3 * comparison ELSE 0 END - 0.3 * multi_hop - 0.2 * chain + 0.2))) AS v3bu,
CASE WHEN h_bridge OR h_chain THEN 2.0 WHEN h_polar THEN 0.1 ELSE 1.0 END / (1 + exp(-(0.5 * bridge_entity + 0.3 * two_entities + 0.2 * attribute - 0.3 * single_hop + 0.3))) AS decompose,
CASE WHEN h_chain OR h_general THEN 2.0 WHEN h_polar THEN 0.1 ELSE 1.0 END / (1 + exp(-(0.5 * chain + 0.4 * temporal + 0.3 * complexity + 0.3 * multi_hop - 0.2 * single_entity + 0.3))) AS iter,
1 / (1 + exp(-(0.5 * attribute + 0.4 * single_hop + 0.2 * single_entity - 0.7 * multi_hop - 0.2 * chain))) AS infobox,
1 / (1 + exp(-(0.5 * bridge_entity + 0.4 * (0.6 * complexity + 0.4 * multi_hop) + 0.3 * two_entities - 0.3 * single_hop + 0.25))) AS graph FROM general)"""
#: Probabilities by answer: arms ``v3bu, decompose, iter, infobox, graph``.
PROBABLE = f"{SCORES}, {_HOPS}"


@query(f"WITH {PROBABLE} SELECT answer_id, h_polar, h_bridge, h_chain, h_attribute, h_general FROM probable")
def hop_structures(spark, d):
    s = question_scores(spark, d)
    h = Q.hops({c: F.col(c) for c in _ELEVEN})
    return s.select("answer_id", *[h[k].alias(n) for k, n in (("polar", "h_polar"), ("bridge", "h_bridge"), ("chain", "h_chain"), ("entity_attribute", "h_attribute"), ("general_multihop", "h_general"))])


def _probabilities(spark, d):
    return _asked(spark, d).join(P.question_scores(_asked(spark, d)).withColumnRenamed("question", "q"), F.col("question").eqNullSafe(F.col("q")))


_FIVE = ("v3bu", "decompose", "iter", "infobox", "graph")


@query(f"WITH {PROBABLE} SELECT answer_id, {', '.join(f'round({a}, 6) AS {a}' for a in _FIVE)} FROM probable")
def arm_probabilities(spark, d):
    return _probabilities(spark, d).select("answer_id", *[F.round(f"p_{a}", 6).alias(a) for a in _FIVE])


@query(f"""WITH {FEATURES}, {PROBABLE.replace('asked AS', 'asked2 AS', 1).replace('FROM asked)', 'FROM asked2)')}, j AS (SELECT c.*, p.v3bu, p.decompose, p.iter, p.infobox, p.graph FROM classes c JOIN probable p USING (answer_id))
SELECT answer_id, CASE WHEN (cohort IN ('chain_deep', 'bridge_entity') AND NOT is_polar) OR (cohort = 'semantic_rich' AND (is_comparative_selection OR is_kinship_possessive)) THEN 'decompose,iter' ELSE 'v3bu,decompose,iter' END
|| CASE WHEN infobox > 0.5 THEN ',infobox' ELSE '' END || CASE WHEN graph > 0.5 THEN ',graph' ELSE '' END AS binary_arms,
array_to_string(list_transform(list_filter([{{'a': 'v3bu', 'p': v3bu}}, {{'a': 'decompose', 'p': decompose}}, {{'a': 'iter', 'p': iter}}, {{'a': 'infobox', 'p': infobox}}, {{'a': 'graph', 'p': graph}}], lambda x: x.p > 0.3), lambda x: x.a), ',') AS likely_arms FROM j""")
def arm_subsets(spark, d):
    """Which arms to run, by classes and by probabilities. Some arm is always over the threshold here."""
    f = question_features(spark, d)
    p = _probabilities(spark, d).select("answer_id", *[F.col(f"p_{a}").alias(a) for a in _FIVE])
    j = f.join(p, "answer_id")
    held, ps = {c: F.col(c) for c in f.columns}, {a: F.col(a) for a in _FIVE}
    return j.select("answer_id", F.array_join(Q.binary_subset(held, ps), ",").alias("binary_arms"), F.array_join(Q.likely_subset(ps), ",").alias("likely_arms"))


_W = r"[\w\s''\-\.]+"
_ONE = [
    rf"\bwhen (?:was|did|is) {_W} (?:born|die|died|founded|established|created|invented|discovered|published|released|signed|crowned|elected)\b",
    rf"\bwho (?:is|was) {_W} (?:spouse|wife|husband|partner|parent|father|mother|sibling|brother|sister|child|son|daughter|founder|ceo|chairman|president)\b",
    rf"\bwhat (?:is|was) {_W} (?:date of birth|birthplace|birth date|date of death|deathplace|death date|nationality|height|profession|occupation|age|net worth|salary|capital|population|area|religion|spouse|alma mater)\b",
    rf"\bwhere (?:was|is) {_W} (?:born|die|died|located|headquartered|based|situated|founded|established)\b",
    rf"\bwhich (?:country|city|state|town|year|month|day|continent|region|county) (?:is|was|does|did) {_W} (?:born|located|based|founded|established|headquartered|situated|set)\b",
    rf"\bhow (?:old|tall|much|many) (?:is|was|does) {_W}\b", rf"\bwhat (?:is|was) the capital of {_W}\b",
]
_MANY = [
    r"\bthat (?:is|was|has|had|did|does|founded|wrote|directed|composed|invented|discovered|owns|owned)\b", r"\bwhich .*\b(?:also|then|later|subsequently|after|before)\b",
    r"\b(?:before|after|earlier|later|prior to|following) (?:than|did|the|when)\b", r"\b(?:both|either|neither) \w+ (?:and|or|nor)\b",
    r"\b(?:older|younger|larger|smaller|taller|shorter|earlier|later|longer|wider|deeper|richer|poorer|faster|slower|more|less) than\b", r"\b(?:\w+ ){1,5}or (?:\w+ ){0,3}\?",
]
_RELATIONAL = r"\bwhich\b.*\b(?:also|both|same)\b|\bwho\b.*\bof\b.*\bwhich\b|\b(?:who|what)\b.*\bafter\b|\bbetween\b.*\band\b|\bcommon\b|\bsame\b.*\bas\b|\bborn in\b|located in|born in|founded by|directed by|written by|produced by|starring|married to|father of|child of|company of|employer of|nationality of|capital of|part of"
_SECOND = r"\bco-?commentator\b|\bco-?author\b|\bco-?host\b|\bco-?star\b|\bformer\b|\bpredecessor\b|\bsuccessor\b|\bsucceeded by\b|\bpreceded by\b|\boriginally (?:named|called)\b|\bnow located\b|\bcreator of\b|\bcreated the\b.+\bthat\b"
SECOND_FACT = f"regexp_matches(t, '(?i){_SECOND}')"
_COMPOSING = r"\bof\s+(?:a|an)\b|(?:\bof\s+the\b[^?]*?){2,}|\b(?:who|which|that)\b[^?]*\bof\b|\bin\s+the\s+\w+\s+(?:where|in\s+which)\b"


@query(rf"""WITH {FEATURES} SELECT answer_id, trim(q) <> '' AND NOT regexp_matches(trim(t), '(?i){'|'.join(_MANY)}') AND regexp_matches(trim(t), '(?i){'|'.join(_ONE)}') AS one_attribute, regexp_matches(lower(t), '{_RELATIONAL}') AS relational,
{SECOND_FACT} AS second_fact, greatest(np_depth, n_relations) >= 2 OR has_chain AS several_hops,
regexp_matches(t, '(?i)\b(?:what|who|which|when|where|how\s+many|whose|whom)\b') AND regexp_matches(t, '(?i){_COMPOSING}') AS composed FROM features""")
def question_gates(spark, d):
    """The gates that questions pass: one attribute of one thing, a relation, a second fact, several hops, a composition."""
    q = F.col("question")
    f = _asked(spark, d).select("answer_id", "question", *[c.alias(n) for n, c in Q.features(q).items() if n in ("np_depth", "n_relations", "has_chain")])
    several = (F.greatest("np_depth", "n_relations") >= 2) | F.col("has_chain")
    return f.select("answer_id", Q.is_attribute_question(q).alias("one_attribute"), Q.is_relational(q).alias("relational"), Q.asks_second_fact(q).alias("second_fact"), several.alias("several_hops"), Q.is_composition(q).alias("composed"))


@query(f"""WITH {SCORES} SELECT answer_id, polar > 0 AS v3bu, two_entities > 0 AS decompose, chain > 0 AS iter, single_hop > 0 AS infobox FROM scores""")
def arm_applicability(spark, d):
    s = question_scores(spark, d)
    return s.select("answer_id", *[c.alias(a) for a, c in Q.applicable({c: F.col(c) for c in _ELEVEN}).items()])


_L = r"[\p{L}\p{M}\p{N}_]"
_WHO = rf"([A-Z](?:{_L}|[\.\- ])+?)"
_FORMS = [
    (rf"(?i)\b(?:when|on\s+what\s+date)\s+(?:was|were)\s+{_WHO}\s+born", "'born'", 1), (rf"(?i)\bwhere\s+(?:was|were)\s+{_WHO}\s+born", "'birthplace'", 1),
    (rf"(?i)\bwhere\s+did\s+{_WHO}\s+die", "'deathplace'", 1), (rf"(?i)\bwhen\s+did\s+{_WHO}\s+die", "'died'", 1),
    (rf"(?i)\bwhat\s+is\s+the\s+capital\s+of\s+([A-Z](?:{_L}|[\.\- ])+)", "'capital'", 1), (rf"(?i)\bwho\s+is\s+{_WHO}[''’]s\s+(spouse|wife|husband|partner)", 2, 1),
    (rf"(?i)\bwho\s+is\s+the\s+(spouse|wife|husband|partner|father|mother|son|daughter|director|author|composer|founder|president|prime\s+minister|ceo|chairman)\s+of\s+([A-Z](?:{_L}|[\.\- ])+)", 1, 2),
    (rf"(?i)\bwhat\s+is\s+{_WHO}[''’]s\s+(nationality|occupation|profession|religion)", 2, 1),
]
HINTS = f"{_ASKED}, hints AS (" + " UNION ".join(
    f"SELECT answer_id, trim(unnest(regexp_extract_all(q, '{p}', {s}))) AS subject, trim({a if isinstance(a, str) else f'''unnest(regexp_extract_all(q, '{p}', {a}))'''}) AS attribute FROM asked" for p, a, s in _FORMS
) + ")"


@query(f"WITH {HINTS} SELECT DISTINCT answer_id, subject, attribute FROM hints WHERE subject <> '' AND attribute <> ''")
def question_hints(spark, d):
    return _asked(spark, d).select("answer_id", F.explode(Q.hints(F.col("question"))).alias("h")).select("answer_id", "h.*").distinct()


@query(rf"""WITH a AS (SELECT DISTINCT answer_id, pred, {plain('pred')} AS t FROM ({ONCE})), x AS (SELECT answer_id, list_filter(list_transform(list_concat(regexp_extract_all(t, '\b(?:[A-Z][a-z]{{2,}}(?:\s+[A-Z][a-z]+){{0,3}})\b'),
regexp_extract_all(t, '(?i)\b[0-9]+(?:[,.][0-9]+)?(?:[KMB])?(?:\s*(?:%|km|miles?|years?|kg|m|cm))?\b')), lambda s: trim(s)), lambda s: s <> '') AS l FROM a),
u AS (SELECT answer_id, unnest(l) AS aspect, generate_subscripts(l, 1) AS i FROM x), f AS (SELECT answer_id, aspect, min(i) AS i FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY i) AS position FROM f)
SELECT answer_id, position::INT AS position, aspect FROM r WHERE position <= 8""")
def answer_aspects(spark, d):
    """The aspects of an answer: its names, then its quantities."""
    a = load(spark, d, "selective_answers").select("answer_id", "pred").distinct()
    return a.select("answer_id", F.posexplode(Q.aspects(F.col("pred"))).alias("p", "aspect")).select("answer_id", (F.col("p") + 1).alias("position"), "aspect")


@query()
def comparison_questions(spark, d):
    """What is compared with what in which respect, and the specialist for the question."""
    q = F.col("question")
    return _asked(spark, d).select("answer_id", Q.slot(q).alias("slot"), F.array_join(Q.compared_entities(q), "|").alias("entities"), F.array_join(Q.comparison_attributes(q), "|").alias("attributes"))
