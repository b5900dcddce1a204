"""Questions as Column expressions: surface features, graded scores, classes, arm probabilities and arm subsets.

Patterns run with ``(?U)``, so that word boundaries hold in every script. A null question counts as an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lodestone.functions.text import let

# Words that name a relation, in the forms in which questions use them.
RELATIONS = [
    "directed", "direct", "directs", "wrote", "written", "writes", "writing", "born", "birth", "died", "death", "married", "marries", "marriage", "founded", "founding",
    "owned", "owns", "owning", "starred", "stars", "starring", "played", "plays", "playing", "published", "publishes", "publishing", "created", "creates", "creating",
    "authored", "authors", "produced", "produces", "producing", "composed", "composes", "designed", "designs", "adapted", "adapts", "adaptation", "succeeded", "preceded",
    "directed by", "written by", "produced by", "composed by", "founded by",
    "director", "actor", "actress", "spouse", "wife", "husband", "mother", "father", "parent", "son", "daughter", "child", "children", "brother", "sister", "sibling",
    "founder", "creator", "owner", "author", "publisher", "composer", "producer", "designer", "predecessor", "successor", "star",
    "grandfather", "grandmother", "grandparent", "grandparents", "grandson", "granddaughter", "grandchild", "grandchildren", "aunt", "uncle", "nephew", "niece", "cousin", "cousins",
    "stepfather", "stepmother", "stepsister", "stepbrother", "stepson", "stepdaughter", "stepchild", "godfather", "godmother", "godson", "goddaughter",
]
# Capitalised words at the head of a question that are no names.
HEADS = "who what when where why how which whose whom is are was were did do does the an a in of on at to by".split()
# Words inside a name that have no capital.
LINKS = "of|the|de|la|le|du|von|van|and|&"
# Comparisons, kinship, attributes, chains, times.
COMPARATIVE = "first earlier later earliest latest older younger oldest youngest longer shorter longest shortest before after biggest smallest highest lowest tallest shortest born died lived".split()
KINSHIP = (
    "father mother parent son daughter child children brother sister sibling spouse wife husband grandfather grandmother grandparent grandson granddaughter grandchild "
    "aunt uncle nephew niece cousin stepfather stepmother stepsister stepbrother stepson stepdaughter godfather godmother godson goddaughter"
).split()
ATTRIBUTES = [
    "born", "died", "death", "birth", "birthplace", "birthday", "founded", "established", "created", "spouse", "wife", "husband", "partner", "nationality", "occupation", "profession",
    "age", "religion", "alma mater", "capital", "population", "area", "height", "headquartered", "based", "located",
]
CHAIN = ["first", "then", "later", "subsequently", "after that", "prior to", "following", "next"]
MONTHS = "january february march april may june july august september october november december".split()
TIMES = "yesterday today tomorrow recently currently previously formerly earlier later".split()
SET_COMPARISON = "both either neither vs versus or".split()
THAN = "older younger larger smaller taller shorter earlier later longer wider deeper richer poorer faster slower more less better worse".split()
THAN_POLAR = [*THAN, "higher", "lower", "greater"]
CLAUSE_VERBS = (
    "is was has had did does founded wrote directed composed invented discovered owns owned acquired started published released established created signed elected played hosted formed developed"
).split()
# A choice between two capitalised names, and the heads before it.
_CONNECT = "and|of|on|in|at|the|to|for|by|with|from|de|la|le|du|von|van"
_NAME_AND = rf"[A-Z]\w*(?:\s+(?:(?i:{_CONNECT})|&|[A-Z]\w*))*"
_NAME_OR = rf"[A-Z]\w*(?:\s+(?:(?i:{_CONNECT}|or)|&|[A-Z]\w*))*"
POLAR = (
    r"(?U)(?:^\s*(?i:are|is|was|were|did|do|does|have|has|can|could|would|will)\b[^?]*\b(?i:both|same|either|neither)\b)"
    rf"|(?:^\s*(?i:are|is|was|were|did|do|does|which|who|what)\b(?:(?!\b(?i:who|whose|which|that|whom)\b)[^?]){{0,30}}?\b(?i:{'|'.join(THAN_POLAR)})\s+than\b)"
    rf"|(?:^\s*{_NAME_OR}\s+(?i:or)\s+{_NAME_AND}\s*\??\s*$)"
    rf"|(?:^\s*(?i:which|who|what|between)\b(?:(?!\b(?i:who|whose|which|that|whom|has|have|had)\b)[^?])*?,\s+{_NAME_AND}\s+(?i:or)\s+{_NAME_AND}\s*\??\s*$)"
)
# Questions that ask for one attribute of one thing, and marks of several steps that veto them.
ATTRIBUTE_QUESTIONS = [
    r"\bwhen (?:was|did|is) [\w\s\-'\.]+ (?:born|die|died|founded|established|created|invented|discovered|published|released|signed|crowned|elected)\b",
    r"\bwho (?:is|was) [\w\s'\-\.]+ (?:spouse|wife|husband|partner|parent|father|mother|sibling|brother|sister|child|son|daughter|founder|ceo|chairman|president)\b",
    r"\bwhat (?:is|was) [\w\s'\-\.]+ (?:date of birth|birthplace|birth date|date of death|deathplace|death date|nationality|height|profession|occupation|age|net worth|salary|capital|population|area|religion|spouse|alma mater)\b",
    r"\bwhere (?:was|is) [\w\s'\-\.]+ (?:born|die|died|located|headquartered|based|situated|founded|established)\b",
    r"\bwhich (?:country|city|state|town|year|month|day|continent|region|county) (?:is|was|does|did) [\w\s'\-\.]+ (?:born|located|based|founded|established|headquartered|situated|set)\b",
    r"\bhow (?:old|tall|much|many) (?:is|was|does) [\w\s'\-\.]+\b",
    r"\bwhat (?:is|was) the capital of [\w\s'\-\.]+\b",
]
SEVERAL_STEPS = [
    r"\bthat (?:is|was|has|had|did|does|founded|wrote|directed|composed|invented|discovered|owns|owned)\b",
    r"\bwhich .*\b(?:also|then|later|subsequently|after|before)\b",
    r"\b(?:before|after|earlier|later|prior to|following) (?:than|did|the|when)\b",
    r"\b(?:both|either|neither) \w+ (?:and|or|nor)\b",
    r"\b(?:older|younger|larger|smaller|taller|shorter|earlier|later|longer|wider|deeper|richer|poorer|faster|slower|more|less) than\b",
    r"\b(?:\w+ ){1,5}or (?:\w+ ){0,3}\?",
]
# Questions about a relation between things.
RELATIONAL = [r"\bwhich\b.*\b(also|both|same)\b", r"\bwho\b.*\bof\b.*\bwhich\b", r"\b(who|what)\b.*\bafter\b", r"\bbetween\b.*\band\b", r"\bcommon\b", r"\bsame\b.*\bas\b", r"\bborn in\b"]
RELATIONAL_PHRASES = [
    "located in", "born in", "founded by", "directed by", "written by", "produced by", "starring", "married to", "father of", "child of", "company of", "employer of", "nationality of", "capital of", "part of",
]
# Questions whose answer is a second fact about what they name.
SECOND_FACT = [
    r"\bco-?commentator\b", r"\bco-?author\b", r"\bco-?host\b", r"\bco-?star\b", r"\bformer\b", r"\bpredecessor\b", r"\bsuccessor\b", r"\bsucceeded by\b", r"\bpreceded by\b",
    r"\boriginally (?:named|called)\b", r"\bnow located\b", r"\bcreator of\b", r"\bcreated the\b.+\bthat\b",
]
# Marks of comparisons and of compositions.
COMPARING = [r"\bboth\b", r"\bsame\b", r"\bcompared?\s+(?:to|with)\b", r"\bdiffer(?:ent|ence)?\b", r"\beither\b", r"\bneither\b", r"\bmore\s+\w+\s+than\b", r"\bless\s+\w+\s+than\b", r"\b(?:older|younger|taller|shorter|larger|smaller|longer)\b"]
YES_NO = r"\b(?:are|is|was|were|do|does|did|has|have|had|can|could|will|would)\b.*\?"
QUESTION_WORDS = "are is was were do does did has have had can could will would who what which when where why how whose whom".split()
COMPOSING = [r"\bof\s+(?:a|an)\b", r"(?:\bof\s+the\b[^?]*?){2,}", r"\b(?:who|which|that)\b[^?]*\bof\b", r"\bin\s+the\s+\w+\s+(?:where|in\s+which)\b"]
ASKING = r"\b(?:what|who|which|when|where|how\s+many|whose|whom)\b"
# Arms, and the weight of each hop structure for an arm, the first one that applies.
ARMS = ("v3bu", "decompose", "iter")
HOP_WEIGHTS = {
    "v3bu": {"polar": 2.0, "entity_attribute": 2.0, "bridge": 0.1, "chain": 0.1},
    "decompose": {"bridge": 2.0, "chain": 2.0, "polar": 0.1},
    "iter": {"chain": 2.0, "general_multihop": 2.0, "polar": 0.1},
}


def _q(question: Column) -> Column:
    return F.coalesce(question, F.lit(""))


def _words(entries: list[str]) -> str:
    return rf"(?iU)\b(?:{'|'.join(e.replace(' ', r'\s+') for e in sorted(entries, key=lambda e: (-len(e), e)))})\b"


def _found(q: Column, pattern: str) -> Column:
    return F.regexp_extract_all(q, F.lit(pattern), F.lit(0))


def _any(q: Column, patterns: list[str]) -> Column:
    return q.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns))


def name_runs(question: Column) -> Column:
    """Distinct lower-case runs of capitalised words, with small words inside, that are no question heads."""
    runs = _found(F.trim(_q(question)), rf"(?U)\b[A-Z][a-zA-Z0-9'\-]+(?:\s+(?:{LINKS}|[A-Z][a-zA-Z0-9'\-]+))*")
    return F.filter(F.array_distinct(F.transform(runs, F.lower)), lambda x: ~x.isin(HEADS))


def relation_words(question: Column) -> Column:
    return F.array_distinct(F.transform(_found(_q(question), _words(RELATIONS)), F.lower))


def is_polar(question: Column) -> Column:
    """A yes/no comparison, or a choice between two names."""
    return _q(question).rlike(POLAR)


def features(question: Column) -> dict[str, Column]:
    """Counts on which routing rests."""
    q = _q(question)
    nested = q.rlike(r"(?iU)\bof\s+(?:the\s+)?\w+(?:\s+\w+){0,2}\s+(?:who|which|that)\b")
    n_of = F.regexp_count(q, F.lit(r"(?iU)\bof\b"))
    return {
        "n_tokens": F.regexp_count(q, F.lit(r"(?U)\b\w+\b")),
        "n_entities": F.size(name_runs(question)),
        "n_relations": F.size(relation_words(question)),
        "np_depth": n_of + nested.cast("int"),
        "has_chain": (n_of >= 2) | nested,
        "is_polar": is_polar(question),
        "is_comparative_selection": q.rlike(r"(?iU)\bor\b") & q.rlike(_words(COMPARATIVE)),
        "is_kinship_possessive": q.rlike(rf"(?iU)'s\s+(?:\w+\s+)?(?:{'|'.join(KINSHIP)})\b"),
    }


def class_v1(f: dict[str, Column]) -> Column:
    """``bridge_entity`` for short questions over a relation of things, else ``semantic_rich``."""
    short = f["n_tokens"] < 15
    bridge = f["has_chain"] | ((f["n_relations"] >= 2) & (f["n_tokens"] >= 8)) | ((f["n_relations"] >= 1) & (f["n_entities"] >= 2))
    return F.when(short & bridge, "bridge_entity").otherwise("semantic_rich")


def class_v2(f: dict[str, Column]) -> Column:
    """``chain_deep`` first, then as the first version."""
    return F.when((f["np_depth"] >= 3) | (f["n_relations"] >= 3), "chain_deep").otherwise(class_v1(f))


def scores(question: Column) -> dict[str, Column]:
    """Eleven graded scores between 0 and 1."""
    q = _q(question)
    head = F.ltrim(q)
    runs = _found(q, r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b")
    inner = lambda r: F.filter(r, lambda n: F.contains(n, F.lit(" ")) | ~F.startswith(head, n))
    graded = lambda n, low, step, most: F.when(n > 0, F.least(low + step * F.least(n, F.lit(most)), F.lit(1.0))).otherwise(0.0)
    clause = q.rlike(rf"(?iU)\bthat\b(?=(?:\s+\w+){{0,6}}\s+(?:{'|'.join(CLAUSE_VERBS)}))")
    multi = F.when(clause, 0.9).when(F.lower(q).rlike(" of the | of which "), 0.6).otherwise(0.0)
    two = let(runs, lambda r: F.when(F.size(F.array_distinct(inner(r))) == 2, 0.8).otherwise(0.0))
    single = let(runs, lambda r: F.when(F.size(inner(r)) == 1, 0.8).when((F.size(inner(r)) == 0) & (F.size(r) >= 1), 0.4).otherwise(0.0))
    subordinators = F.regexp_count(q, F.lit(r"(?iU)\b(?:that|which|who|whom|whose)\b")) - head.rlike(r"(?iU)^(?:that|which|who|whom|whose)\b").cast("int")
    n_words = F.size(F.filter(F.split(q, r"(?U)\s+"), lambda w: w != ""))
    raw = n_words / 25.0 + 0.2 * F.regexp_count(q, F.lit(",")) + 0.3 * subordinators
    return {
        "single_entity": single,
        "attribute": graded(F.regexp_count(q, F.lit(_words(ATTRIBUTES))), 0.4, 0.3, 2),
        "multi_hop": multi,
        "bridge_entity": F.when(q.rlike(r"(?iU)\b(?:of the|of [A-Z])\b"), F.when(two > 0, 0.8).otherwise(0.5)).otherwise(0.0),
        "chain": graded(F.regexp_count(q, F.lit(r"(?iU)\b(?:" + "|".join(CHAIN) + r")\b")), 0.5, 0.2, 3),
        "temporal": graded(F.regexp_count(q, F.lit(rf"(?iU)\b(?:19|20)\d{{2}}\b|\b(?:{'|'.join(MONTHS)})\b|\b(?:{'|'.join(TIMES)})\b")), 0.4, 0.2, 3),
        "comparison": F.when(q.rlike(rf"(?iU)\b(?:{'|'.join(SET_COMPARISON)})\b|\b(?:{'|'.join(THAN)}) than\b"), 0.7).otherwise(0.0),
        "complexity": let(raw, lambda r: F.when(r < 0.4, 0.0).otherwise(F.least(r, F.lit(1.0)))),
        "two_entities": two,
        "single_hop": F.when(q.rlike(r"(?U)\b\w+'s\s+\w+\b"), F.when(multi < 0.3, 0.7).otherwise(0.4)).otherwise(0.0),
        "polar": F.when(is_polar(question), 1.0).otherwise(0.0),
    }


def hops(s: dict[str, Column]) -> dict[str, Column]:
    """The hop structure that the scores show; several may apply."""
    on = {k: v > 0 for k, v in s.items()}
    polar = on["polar"]
    bridge = ~on["single_hop"] & on["two_entities"] & ~on["chain"] & on["bridge_entity"]
    chain = on["chain"] & on["two_entities"] & on["multi_hop"]
    attribute = on["single_entity"] & on["attribute"] & ~on["two_entities"] & ~on["multi_hop"] & ~on["chain"]
    return {"polar": polar, "bridge": bridge, "chain": chain, "entity_attribute": attribute, "general_multihop": on["multi_hop"] & ~polar & ~bridge & ~chain & ~attribute}


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def hop_weight(arm: str, h: dict[str, Column]) -> Column:
    weight = F.lit(1.0)
    for structure, w in reversed(HOP_WEIGHTS[arm].items()):
        weight = F.when(h[structure], w).otherwise(weight)
    return weight


def arm_probabilities(s: dict[str, Column], h: dict[str, Column]) -> dict[str, Column]:
    """How well each arm fits a question; over 1 where an arm is a specialist for its hop structure."""
    boost = F.when(h["polar"], 0.3 * s["comparison"]).otherwise(0.0)
    relational = 0.6 * s["complexity"] + 0.4 * s["multi_hop"]
    linear = {
        "v3bu": 0.5 * s["single_entity"] + 0.4 * s["attribute"] + 0.3 * s["single_hop"] + boost - 0.3 * s["multi_hop"] - 0.2 * s["chain"] + 0.2,
        "decompose": 0.5 * s["bridge_entity"] + 0.3 * s["two_entities"] + 0.2 * s["attribute"] - 0.3 * s["single_hop"] + 0.3,
        "iter": 0.5 * s["chain"] + 0.4 * s["temporal"] + 0.3 * s["complexity"] + 0.3 * s["multi_hop"] - 0.2 * s["single_entity"] + 0.3,
        "infobox": 0.5 * s["attribute"] + 0.4 * s["single_hop"] + 0.2 * s["single_entity"] - 0.7 * s["multi_hop"] - 0.2 * s["chain"],
        "graph": 0.5 * s["bridge_entity"] + 0.4 * relational + 0.3 * s["two_entities"] - 0.3 * s["single_hop"] + 0.25,
    }
    return {arm: sigmoid(x) * hop_weight(arm, h) if arm in HOP_WEIGHTS else sigmoid(x) for arm, x in linear.items()}


def binary_subset(f: dict[str, Column], p: dict[str, Column], gamma_status: Column | None = None) -> Column:
    """The arms to run: the three basic ones, without the single-shot arm for questions of several steps (unless they
    are polar) or after an invalid proof; the optional arms from a probability of one half on."""
    label = class_v2(f)
    excluded = label.isin("chain_deep", "bridge_entity")
    invalid = F.lit(False) if gamma_status is None else F.coalesce(gamma_status == "invalid", F.lit(False))
    implicit = f["is_comparative_selection"] | f["is_kinship_possessive"]
    without = invalid | F.when(excluded, ~f["is_polar"]).otherwise(implicit)
    base = F.when(without, F.array(F.lit("decompose"), F.lit("iter"))).otherwise(F.array(*[F.lit(a) for a in ARMS]))
    extra = F.filter(F.array(*[F.when(p[a] > 0.5, F.lit(a)) for a in ("infobox", "graph")]), lambda a: a.isNotNull())
    return F.concat(base, extra)


def likely_subset(p: dict[str, Column], threshold: float = 0.3) -> Column:
    """The arms whose probability is over the threshold, or the most probable one."""
    arms = F.array(*[F.struct(v.alias("p"), F.lit(-i).alias("i"), F.lit(a).alias("a")) for i, (a, v) in enumerate(p.items())])
    likely = F.filter(arms, lambda x: x["p"] > threshold)
    return let(arms, lambda _: F.when(F.size(likely) > 0, F.transform(likely, lambda x: x["a"])).otherwise(F.array(F.array_max(arms)["a"])))


def applicable(s: dict[str, Column]) -> dict[str, Column]:
    """Which arms take a question for their own; other arms always do."""
    return {"v3bu": s["polar"] > 0, "decompose": s["two_entities"] > 0, "iter": s["chain"] > 0, "infobox": s["single_hop"] > 0}


def is_attribute_question(question: Column) -> Column:
    """One attribute of one thing, and no mark of several steps."""
    q = F.trim(_q(question))
    return (q != "") & ~_any(q, SEVERAL_STEPS) & _any(q, ATTRIBUTE_QUESTIONS)


def is_relational(question: Column) -> Column:
    """Patterns of relations, or one of the phrases."""
    low = F.lower(_q(question))
    found = low.rlike("(?U)" + "|".join(f"(?:{p})" for p in RELATIONAL))
    for phrase in RELATIONAL_PHRASES:
        found = found | F.contains(low, F.lit(phrase))
    return found


def asks_second_fact(question: Column) -> Column:
    return _any(_q(question), SECOND_FACT)


def compared_entities(question: Column) -> Column:
    """Quoted names, both sides of "between ... and", and runs of capitalised words without leading question words; first forms, in this order."""
    q = _q(question)
    quoted = F.regexp_extract_all(q, F.lit(r'["“]([^"”]{2,})["”]'), F.lit(1))
    between = F.array(*[F.regexp_extract(q, r"(?iU)\bbetween\s+(.+?)\s+and\s+(.+?)(?:[?,.]|$)", g) for g in (1, 2)])
    runs = F.regexp_extract_all(q, F.lit(r"(?U)\b([A-Z][\w.&'-]*(?:\s+[A-Z][\w.&'-]*)*)"), F.lit(1))
    led = F.transform(runs, lambda r: F.trim(F.regexp_replace(r, rf"^(?:(?i:{'|'.join(QUESTION_WORDS)})(?:\s+|$))+", "")))
    every = F.filter(F.transform(F.concat(quoted, between, led), lambda t: F.trim(t)), lambda s: (F.length(s) >= 2) & ~F.lower(s).isin(QUESTION_WORDS))
    return let(every, lambda xs: F.filter(xs, lambda x, i: F.array_position(F.transform(xs, F.lower), F.lower(x)) == i + 1))


def comparison_attributes(question: Column) -> Column:
    """What is compared: "the X of", "same X", and known attributes."""
    q = _q(question)
    return F.array_distinct(F.transform(F.concat(
        F.regexp_extract_all(q, F.lit(r"(?iU)\bthe\s+([a-z]+?)s?\s+of\b"), F.lit(1)), F.regexp_extract_all(q, F.lit(r"(?iU)\bsame\s+([a-z]+)\b"), F.lit(1)),
        _found(q, r"(?iU)\b(?:older|younger|taller|shorter|larger|smaller|longer|nationality|country|director|author|birthplace|profession)\b"),
    ), F.lower))


def is_comparison(question: Column) -> Column:
    q = _q(question)
    return _any(q, COMPARING) & q.rlike("(?iU)" + YES_NO) & (F.size(compared_entities(question)) >= 2)


def is_composition(question: Column) -> Column:
    q = _q(question)
    return q.rlike("(?iU)" + ASKING) & _any(q, COMPOSING)


def slot(question: Column) -> Column:
    """The specialist for the decomposing slot: comparisons before compositions before the generic arm."""
    return F.when(is_comparison(question), "compare").when(is_composition(question), "compose").otherwise("generic")


def chain_terms(text: Column) -> Column:
    """Lower-case names, numbers of two to four digits and words of four letters or more: what an answer hands on."""
    t = _q(text)
    stop = "the a an of in on at to and or is was what who which when where did do does year".split()
    words = F.filter(F.transform(_found(t, r"[A-Za-z][A-Za-z'-]+"), F.lower), lambda w: (F.length(w) >= 4) & ~w.isin(stop))
    return F.array_distinct(F.concat(F.transform(F.regexp_extract_all(t, F.lit(r"(?U)\b([A-Z][\w.&'-]*(?:\s+[A-Z][\w.&'-]*)*)"), F.lit(1)), F.lower), F.regexp_extract_all(t, F.lit(r"(?U)\b(\d{2,4})\b"), F.lit(1)), words))


def aspects(answer: Column, most: int = 8) -> Column:
    """Names first, then quantities of an answer, distinct, ``most`` at most (a part of an answer is one of its aspects)."""
    a = _q(answer)
    names = _found(a, r"(?U)\b(?:[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]+){0,3})\b")
    numbers = _found(a, r"(?iU)\b\d+(?:[,.]\d+)?(?:[KMB])?(?:\s*(?:%|km|miles?|years?|kg|m|cm))?\b")
    return F.slice(F.array_distinct(F.filter(F.transform(F.concat(names, numbers), lambda t: F.trim(t)), lambda x: x != "")), 1, most)


def hints(question: Column) -> Column:
    """``array<struct<subject, attribute>>``: what an attribute question asks of whom, in the order of the patterns."""
    q = _q(question)
    name = r"([A-Z][\w\.\- ]+?)"
    # The forms of attribute questions; the attribute is fixed or captured.
    forms = [
        (rf"\b(?:when|on\s+what\s+date)\s+(?:was|were)\s+{name}\s+born", "born"),
        (rf"\bwhere\s+(?:was|were)\s+{name}\s+born", "birthplace"),
        (rf"\bwhere\s+did\s+{name}\s+die", "deathplace"),
        (rf"\bwhen\s+did\s+{name}\s+die", "died"),
        (r"\bwhat\s+is\s+the\s+capital\s+of\s+([A-Z][\w\.\- ]+)", "capital"),
        (rf"\bwho\s+is\s+{name}['’]s\s+(spouse|wife|husband|partner)", 2),
        (r"\bwho\s+is\s+the\s+(spouse|wife|husband|partner|father|mother|son|daughter|director|author|composer|founder|president|prime\s+minister|ceo|chairman)\s+of\s+([A-Z][\w\.\- ]+)", 1),
        (rf"\bwhat\s+is\s+{name}['’]s\s+(nationality|occupation|profession|religion)", 2),
    ]
    found = []
    for pattern, attribute in forms:
        lit = F.lit("(?iU)" + pattern)
        subject = F.regexp_extract_all(q, lit, F.lit(2 if attribute == 1 else 1))
        second = F.array_repeat(F.lit(attribute), F.size(subject)) if isinstance(attribute, str) else F.regexp_extract_all(q, lit, F.lit(attribute))
        found.append(F.zip_with(subject, second, lambda s, a: F.struct(F.trim(s).alias("subject"), F.trim(a).alias("attribute"))))
    return F.filter(F.concat(*found), lambda h: (h["subject"] != "") & (h["attribute"] != ""))
