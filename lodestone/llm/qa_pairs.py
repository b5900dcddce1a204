"""Defective answers of question-answer pairs: labelling functions combined by an expectation-maximization label model.

Every (row, side) gets the votes of a few noisy labelling functions for each defect: 1 (defective), 0 (not) or none.
Statistics that functions need (how texts end, which words belong to which language, answers given to many questions)
are counted over all rows. For each defect the votes form one of at most 3^m patterns; expectation maximization fits
the functions' accuracies to the pattern counts, and a pattern's posterior labels its rows. A row keeps every defect
whose posterior exceeds the defect's cutoff; cutoffs are validated on pairs that were made defective on purpose.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.llm.truncation import endings
from lodestone.session import cut as keep

DEFECTS = ("empty", "truncated", "refusal", "copied_question", "other_language")
#: Rows of the validation set (per defect), and the cutoffs that are tried.
VALIDATION_ROWS = 2000
CUTOFFS = (0.3, 0.5, 0.7, 0.9)
#: An answer that so many different questions get is a set phrase.
SET_PHRASE = 8
EM_STEPS = 50
#: A function is taken to be better than chance: a vote moves the log odds by SURE (against: half of it) at least, no vote by UNSURE at most.
SURE, UNSURE = 4.5, 0.5

# Answer labels, written-out nulls, and words of refusals.
LABELS = r"answer|final answer|ans|a|antwort|réponse|reponse|respuesta|ответ|答案|回答|response|output"
NULLS = r"null|nan|none|nil|undefined|\(null\)|<null>|#n/a"
REFUSAL = [
    r"\b(?:do|does|did|is|are|was|were|can|could|would|will|wo)(?: ?n[o']t|n[’']t)\b.{0,40}\b(?:answer|say|tell|know|state|stated|mention|mentioned|cover|given|found|specified|provided|determine|help|contain|enough)",
    r"\b(?:can ?not|can[’']t|cant|won[’']t|dont|don[’']t|unable|impossible|insufficient|refuse|decline|sorry)\b",
    r"\bnot? (?:\w+ ){0,3}(?:in|from|by|enough|covers?|mentions?|states?|stated|specified|mentioned|available|provided|given|known|found|sure|answer|information|evidence|passages?|context|text)\b",
    r"\bno (?:answer|idea|information|passage|evidence|data|relevant|mention)\b|^\W*(?:unknown|unanswerable|n/?a)\b",
    r"\bnone of (?:the|these)\b|\b(?:could|can) not be\b|\bnot (?:specified|stated|known|available|given|found|sure)\b",
]
REFUSAL_OTHER = [
    r"\bno (?:aparece|se (?:dice|menciona|indica|sabe)|lo s[ée]|puedo|hay|consta|figura)|\bsin respuesta|\blo siento|\bno est[áa] en|desconocid[oa]|\bno s[ée]\b",
    r"\bne (?:le |la |l[’'])?(?:\w+ ){0,3}(?:disent|dit|sais|sait|peux|peut|mentionne|mentionnent|précise|permet|figure|trouve)|\bn[’'](?:est|a|y|apparaît|en)\b.{0,30}\bpas\b|désolé|\binconnue?\b|\bpas (?:de réponse|d[’']information|mentionné|précisé|dans)|\baucun(?:e)? (?:passage|réponse|information)|je ne",
    r"\bsteht nichts\b|\bkeine (?:antwort|angabe|information|ahnung)|\bnicht (?:angegeben|bekannt|genannt|erwähnt|beantwort\w*|im text|in den|möglich|sagen|hervor|gefunden|enthalten)|\bweiß (?:ich |es )?nicht|\bunbekannt\b|\bleider\b|\bkann (?:ich )?.{0,30}nicht|\btut mir leid",
    r"не (?:указано|известно|знаю|могу|упоминается|сказано)|неизвестно|нет (?:ответа|данных|информации)|不知道|无法|沒有|没有(?:提到|说明|答案|足够)|未提及|わかりません|不明|記載|لا (?:أعرف|يمكن|توجد|يوجد)|غير (?:معروف|مذكور)|δεν |नहीं|ไม่",
]
#: An answer follows after all.
YET = r"\bbut (?:it|he|she|they|the answer) (?:was|is|were|are)\b|\b(?:mais|pero|aber) (?:c[’']|es|fue|era|war|il|elle)\b"
# Frequent short words of languages written in Latin letters.
FUNCTION_WORDS = {
    "en": "the of and to in was is that it for on with as by at from which an be had has were who how what why did does where many known not are this between both or into after because later still near his her".split(),
    "de": "der die das und den dem des ein eine einer wurde war ist im von mit für auf nicht zu als weil wer wann welchem welcher warum später nach dort sich aus dass bei zum zur".split(),
    "fr": "le les des une un et du la que qui dans est fut pour par sur au aux en quelle quel pourquoi avait été ne pas cette plus après où son sa il elle".split(),
    "es": "el los las una un y del la que quién en fue por para con qué año se había porque dejó dónde más al su está después allí lo no".split(),
    "it": "il lo gli una che di della nel è fu per con perché anno dove sono dopo".split(),
    "pt": "o os as uma um e do da que em foi por para com ano onde não depois mais".split(),
}
SCRIPTS = {
    "zh": r"\p{IsHan}", "ja": r"[\p{IsHiragana}\p{IsKatakana}]", "ko": r"\p{IsHangul}", "ru": r"\p{IsCyrillic}", "ar": r"\p{IsArabic}",
    "hi": r"\p{IsDevanagari}", "el": r"\p{IsGreek}", "th": r"\p{IsThai}", "he": r"\p{IsHebrew}",
}
LANGUAGE_NAMES = r"(?i)\b(?:english|german|french|spanish|russian|arabic|chinese|japanese|greek|hindi|thai|latin|italian|portuguese|translate|translated into|translation)\b"
QUOTED = r"(?i)\b(?:repl(?:y|ied)|said|say|respond|written over|painted over|inscription|motto|question is|titled?|called)\b"


def _bare(text: Column) -> Column:
    """Lower-case letters and digits, single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def _lower_words(text: Column) -> Column:
    """Words without a capital; names have none of a language's words."""
    return F.filter(_words(text), lambda w: w.rlike(r"^\p{Ll}[\p{L}\p{M}]*$"))


def languages(texts: DataFrame) -> DataFrame:
    """``text, script, spoken, learned`` of the different texts of ``text, planted``: the language by script, by function
    words and by a word model.

    The word model is naive Bayes over all words of the texts that function words identify, counted over all of them but
    planted ones. Null where nothing tells.
    """
    script = F.lit(None).cast("string")
    for name in ("zh", "ja", "ko", "ru", "ar", "hi", "el", "th", "he"):
        script = F.when(F.col("text").rlike(SCRIPTS[name]), name).otherwise(script) if name == "ja" else F.coalesce(script, F.when(F.col("text").rlike(SCRIPTS[name]), name))
    hits = {k: F.size(F.array_intersect("__w", F.array(*[F.lit(w) for w in v]))) for k, v in FUNCTION_WORDS.items()}
    ranked = F.array_sort(F.array(*[F.struct((-n).alias("n"), F.lit(k).alias("k")) for k, n in hits.items()]))
    top, second = F.element_at(ranked, 1), F.element_at(ranked, 2)
    spoken = F.when((top["n"] <= -2) & (top["n"] < second["n"]), top["k"])
    own = texts.where("text IS NOT NULL").groupBy("text").agg(F.min("planted").alias("planted")).withColumn("__w", F.array_distinct(F.transform(_lower_words(F.col("text")), F.lower)))
    own = keep(own.select("text", "planted", "__w", script.alias("script")).withColumn("spoken", spoken))
    words = own.select("text", "spoken", "planted", F.explode("__w").alias("word"))
    names = list(FUNCTION_WORDS)
    counts = words.where("spoken IS NOT NULL AND NOT planted").groupBy("word").agg(*[F.sum((F.col("spoken") == k).cast("int")).alias(k) for k in names])
    counts = counts.select("word", F.array(*[F.log(F.col(k) + 0.1) - F.log(sum((F.col(x) for x in names), F.lit(0.1 * len(names)))) for k in names]).alias("p"))
    scored = words.join(counts, "word").groupBy("text").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("p")[i]).alias(k) for i, k in enumerate(names)])
    best = F.array_sort(F.array(*[F.struct((-F.col(k)).alias("s"), F.lit(k).alias("k")) for k in names]))
    learned = scored.select("text", F.when(F.element_at(best, 2)["s"] - F.element_at(best, 1)["s"] > 1.0, F.element_at(best, 1)["k"]).alias("learned"))
    return own.join(learned, "text", "left").select("text", "script", "spoken", "learned")


def _ends(texts: DataFrame) -> DataFrame:
    """``text, cut_word, no_end, may_end`` of distinct texts, from how all texts go on after their words."""
    base = F.regexp_replace("text", r"(?:\s*(?:\.\.\.|…|\[\.\.\.\]))+\s*$", "")
    rows = texts.where("text IS NOT NULL").groupBy("text").agg(F.sum((~F.col("planted")).cast("int")).alias("times")).withColumn("base", base)
    rows = rows.withColumn("__tokens", F.regexp_extract_all("base", F.lit(r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]"), F.lit(0)))
    words, pairs, longer = endings(rows.where("times > 0"))  # planted texts are cut on purpose
    last, before = F.try_element_at("__tokens", F.lit(-1)), F.try_element_at("__tokens", F.lit(-2))
    shape = F.when(last.rlike(r"^\p{N}+$"), F.concat(F.lit("#"), F.least(F.length(last), F.lit(5)).cast("string"))).otherwise(last)
    context = F.coalesce(F.when(before.rlike(r"^\p{Lu}"), F.lit("N")).otherwise(before), F.lit("^"))
    ended = rows.where(last.rlike(r"^[\p{L}\p{M}\p{N}]")).select("text", "times", shape.alias("word"), F.concat_ws(" ", context, shape).alias("pair"))
    at_end = ended.groupBy("word").agg(F.sum("times").alias("stops"))
    stems = words.where((F.col("n") >= 2) & ~F.col("word").startswith("#") & (F.length("word") > 1)).select(
        F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", F.lit(1), i))).alias("word"), "n"
    )
    stems = stems.groupBy("word").agg(F.sum("n").alias("grown"))
    seen = (
        at_end.join(words.select("word", "n", "ends"), "word", "left").join(stems, "word", "left")
        .select("word", "stops", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "ends", "grown")))
    )
    share = F.coalesce(F.try_divide(F.col("stops") + F.col("ends"), F.col("stops") + F.col("n")), F.lit(0.0))
    pair = ended.select("pair").distinct().join(pairs.select("pair", F.col("n").alias("pn")), "pair", "left").join(longer, F.col("pair") == F.col("stem"), "left")
    pair = pair.select("pair", (F.coalesce("longer", F.lit(0)) > 3 * F.coalesce("pn", F.lit(0)) + 3).alias("grows"))
    return (
        ended.join(seen, "word").join(pair, "pair")
        .select(
            "text",
            ((F.col("n") == 0) & (F.col("grown") >= 3) & (F.col("stops") <= F.greatest(F.lit(2.0), 0.03 * F.col("grown"))) | (F.col("grows") & (share < 0.2))).alias("cut_word"),
            ((F.col("n") >= 20) & (share < 0.03) & F.col("word").rlike(r"^\p{Ll}")).alias("no_end"),
            ((share >= 0.3) & (F.col("stops") + F.col("ends") >= 5)).alias("may_end"),
        )
    )


def _vote(positive: Column | None, negative: Column | None = None) -> Column:
    vote = F.lit(None).cast("int")
    if negative is not None:
        vote = F.when(F.coalesce(negative, F.lit(False)), 0).otherwise(vote)
    if positive is not None:
        vote = F.when(F.coalesce(positive, F.lit(False)), 1).otherwise(vote)
    return vote


def _of_answers(pairs: DataFrame) -> DataFrame:
    """What can be said of a distinct answer by itself, once for all rows that have it: ``answer`` and columns ``a_...``."""
    answer = F.col("answer")
    own = pairs.select("answer").where("answer IS NOT NULL").distinct().withColumns({"a_bare": _bare(answer), "a_low": F.lower("answer")})
    plain = F.regexp_replace(F.regexp_replace(answer, r"<[^<>]{0,40}>", " "), r"[\p{Cf}\p{Cc}\p{Z}\p{P}\p{S}\x{3164}\x{2800}]+", " ")
    own = own.withColumns({"a_content": F.trim(plain), "a_lower": F.size(_lower_words(answer)), "a_words": F.size(F.filter(F.split("a_bare", " "), lambda w: w != ""))})
    low = F.col("a_low")
    # the patterns of refusals need one of these, which is found faster than they are
    may_refuse = F.lit(False)
    for sign in ("no", "n't", "n’t", "an't", "an’t", "cant", "unable", "impossible", "insufficient", "refuse", "decline", "sorry", "unanswerable", "na", "n/a"):
        may_refuse = may_refuse | F.contains(low, F.lit(sign))
    refusing, refusing_other = F.lit(False), F.lit(False)
    for r in REFUSAL:
        refusing = refusing | low.rlike(r)
    for r in REFUSAL_OTHER:
        refusing_other = refusing_other | low.rlike(r)
    dots = answer.rlike(r"[\p{L}\p{N},](?:\s*(?:\.\.\.|…|\[\.\.\.\]))+\s*$")
    return own.withColumns({
        "a_refusing": may_refuse & refusing, "a_refusing_other": refusing_other, "a_dots": dots, "a_yet": low.rlike(YET),
        "a_closed": answer.rlike(r"[.!?。！？।؟][\"'”’»）)\]}」』*\s]*$") & ~dots,
        "a_label": F.trim(F.regexp_replace(F.lower("a_content"), f"^(?:{LABELS})$", "")) == "",
        "a_null": F.lower(F.trim(answer)).rlike(f"^\\W*(?:{NULLS})\\W*$"), "a_none": F.contains(low, F.lit("none")),
        "a_title": answer.rlike(r"^(?:\p{Lu}\S*\s?)+$"),
    }).drop("a_low")


def _of_questions(pairs: DataFrame) -> DataFrame:
    """What can be said of a distinct question: ``question`` and columns ``q_...``."""
    own = pairs.select("question").where("question IS NOT NULL").distinct().withColumn("q_bare", _bare(F.col("question")))
    return own.withColumns({
        "q_many": F.col("q_bare").rlike(r"^how (?:many|much)|^combien|^wie ?viele?|^cu[aá]nt"), "q_quoted": F.col("question").rlike(QUOTED), "q_language": F.col("question").rlike(LANGUAGE_NAMES),
    })


def votes(pairs: DataFrame) -> tuple[DataFrame, dict[str, list[str]]]:
    """``pairs`` (``__key, side, question, answer, others, planted``) with one column per labelling function; the columns of each defect."""
    both = pairs.select(F.explode(F.array("question", "answer")).alias("text"), "planted")
    spoken, ends = languages(both), _ends(pairs.select(F.col("answer").alias("text"), "planted"))
    phrases = pairs.where("NOT planted").groupBy(_bare(F.col("answer")).alias("a_bare")).agg(F.approx_count_distinct(_bare(F.col("question"))).alias("asked")).where(F.col("asked") >= SET_PHRASE)
    tongue = lambda side, name: spoken.select(F.col("text").alias(name), *(F.col(c).alias(f"{side}_{c}") for c in ("script", "spoken", "learned")))
    answers = _of_answers(pairs).join(tongue("a", "answer"), "answer", "left").join(ends.withColumnRenamed("text", "answer"), "answer", "left").join(phrases, "a_bare", "left")
    questions = _of_questions(pairs).join(tongue("q", "question"), "question", "left")
    rows = pairs.join(questions, "question", "left").join(answers, "answer", "left")
    flags = [c for c in rows.columns if c in ("q_many", "q_quoted", "q_language", "a_refusing", "a_refusing_other", "a_dots", "a_yet", "a_closed", "a_none", "a_title")]
    rows = rows.na.fill({c: False for c in flags} | {"a_null": False, "a_label": True, "a_bare": "", "q_bare": "", "a_content": "", "a_lower": 0, "a_words": 0})

    answer, bare, asked = F.coalesce("answer", F.lit("")), F.col("a_bare"), F.col("q_bare")
    n_words, quoted, language, yet, dots, closed = (F.col(c) for c in ("a_words", "q_quoted", "q_language", "a_yet", "a_dots", "a_closed"))
    refusing, refusing_other, lower_only = F.col("a_refusing"), F.col("a_refusing_other"), F.col("a_lower") == 0
    rows = rows.withColumns({"__a": F.array_distinct(F.split(bare, " ")), "__q": F.array_distinct(F.split(asked, " "))}).withColumn("__shared", F.size(F.array_intersect("__a", "__q")))
    shared = F.col("__shared")
    added, covered = F.size("__a") - shared, shared / F.greatest(F.size("__q"), F.lit(1))
    # of long texts only those are measured that share half of the words, and no further than it matters
    most = F.greatest(F.length(bare), F.length(asked), F.lit(1))
    alike = (covered >= 0.5) & (F.least(F.length(bare), F.length(asked)) >= 0.8 * most)
    band = F.expr("levenshtein(a_bare, q_bare, cast(floor(0.2 * greatest(length(a_bare), length(q_bare), 1)) as int))")
    rows = rows.withColumn("__near", F.when(most <= 400, F.when(F.least(F.length(bare), F.length(asked)) < 0.4 * most, 1.0).otherwise(F.levenshtein(bare, asked) / most)).when(alike, F.when(band >= 0, 0.0).otherwise(1.0)).otherwise(1.0))
    near, fuller = F.col("__near"), F.size("__q") >= 3
    phrase = F.col("asked").isNotNull()
    longer = F.exists("others", lambda o: (F.length(o) > F.length(answer) + 2) & o.startswith(F.regexp_replace(answer, r"(?:\s*(?:\.\.\.|…))+\s*$", "")) & (F.length(answer) >= 8))

    def differ(kind: str) -> tuple[Column, Column]:
        one, two = F.col(f"q_{kind}"), F.col(f"a_{kind}")
        return one.isNotNull() & two.isNotNull() & (one != two), one.isNotNull() & two.isNotNull() & (one == two)

    # Han alone reads as Chinese or Japanese; a text without letters of another script is Latin
    script = F.col("a_script").isNotNull() & ~F.coalesce(F.col("a_script").eqNullSafe(F.col("q_script")) | (F.col("q_script").isin("zh", "ja") & F.col("a_script").isin("zh", "ja")), F.lit(False))
    latin = F.col("q_script").isNotNull() & F.col("a_script").isNull() & F.col("a_spoken").isNotNull()
    functions = {
        "empty": [
            _vote(F.col("a_content") == "", (n_words >= 2)),
            _vote(F.col("a_label"), F.length("a_content") > 20),
            _vote(F.col("a_null") & ~(F.col("q_many") & F.col("a_none")), (n_words >= 1) & ~phrase),
        ],
        "truncated": [
            _vote(F.col("cut_word") & ~closed, closed),
            _vote(F.col("no_end") & ~closed & ~phrase, (n_words <= 2) & ~dots & ~F.coalesce("cut_word", F.lit(False))),
            _vote(dots & (n_words >= 3)),
            _vote(longer & ~closed),
            _vote(None, F.col("may_end") & ~F.col("cut_word") & ~dots),
        ],
        "refusal": [
            _vote(refusing & ~quoted & ~yet, (F.length(bare) > 0) & ~refusing & ~refusing_other),
            _vote(refusing_other & ~quoted),
            _vote(phrase & (n_words >= 2) & ~lower_only & ~quoted & (F.coalesce(F.col("asked"), F.lit(0)) >= SET_PHRASE), (lower_only & (n_words <= 4)) | (shared >= 3) & ~refusing),
            _vote(None, yet),
            _vote(None, quoted | (F.col("a_title") & (n_words >= 2))),
        ],
        "copied_question": [
            _vote(fuller & (covered >= 0.8) & (added <= 1), (covered < 0.5) | (added >= 3)),
            _vote(fuller & (near <= 0.2), near > 0.6),
            _vote(fuller & (F.length(asked) >= 8) & F.contains(bare, asked) & (F.trim(F.regexp_replace(F.replace(bare, asked, F.lit("")), r"^(?:q|question|a|answer|frage|pregunta)\b", "")) == ""), added >= 4),
            _vote(None, (n_words <= 2)),
        ],
        "other_language": [
            _vote((script | latin) & ~language & ~quoted, F.col("a_script").isNotNull() & (F.col("a_script").eqNullSafe(F.col("q_script")))),
            _vote(differ("spoken")[0] & F.col("a_script").isNull() & ~language & ~quoted, differ("spoken")[1]),
            _vote(differ("learned")[0] & F.col("a_script").isNull() & (F.col("a_lower") >= 2) & ~language & ~quoted, differ("learned")[1]),
            _vote(None, (lower_only & F.col("a_script").isNull()) | language),
        ],
    }
    named = {d: [f"{d}_{i}" for i in range(len(v))] for d, v in functions.items()}
    columns = [v.alias(n) for d in DEFECTS for v, n in zip(functions[d], named[d])]
    return rows.select("__key", "side", "planted", *columns), named


def fit_label_model(patterns: list[tuple[str, int]], made: list[tuple[str, int]] = ()) -> dict[str, float]:
    """The posterior of every vote pattern (characters 1, 0, -) by expectation maximization with Dirichlet priors.

    The patterns are at most 3 to the number of functions, whatever the number of rows. ``made`` are the patterns of
    answers that were made defective on purpose; they say what to expect of a defective answer, and all rows together
    what to expect of a sound one.
    """
    votes_of = np.array([["10-".index(c) for c in p] for p, _ in patterns])
    n = np.array([c for _, c in patterns], dtype=float)
    m = votes_of.shape[1]
    first = np.zeros((2, m, 3))
    for j in range(m):
        all_rows = np.bincount(votes_of[:, j], weights=n, minlength=3)
        first[0, j] = (all_rows + 0.5) / (all_rows + 0.5).sum()
        can = [bool((votes_of[:, j] == v).any()) for v in range(3)]
        guess, planted = np.array((0.6 * can[0] + 0.001, 0.02 * can[1] + 0.001, 0.4)), np.full(3, 1e-3)
        for p, c in made:
            planted["10-".index(p[j])] += c
        first[1, j] = (guess / guess.sum() + planted / planted.sum()) / 2
    strength = max(50.0, 0.02 * n.sum())
    theta, prior, post = first.copy(), 0.03, None
    for _ in range(EM_STEPS):
        ratio = np.log(theta[1]) - np.log(theta[0])
        ratio = np.stack([np.maximum(ratio[:, 0], SURE), np.minimum(ratio[:, 1], -SURE / 2), np.clip(ratio[:, 2], -UNSURE, UNSURE / 2)], axis=1)
        logs = ratio[np.arange(m), votes_of].sum(axis=1) + np.log(prior) - np.log(1 - prior)
        post = 1 / (1 + np.exp(-np.clip(logs, -60, 60)))
        weights = (n * (1 - post), n * post)
        for y in (0, 1):
            for j in range(m):
                found = np.bincount(votes_of[:, j], weights=weights[y], minlength=3)
                theta[y, j] = (found + strength * first[y, j] + 1e-9) / (found.sum() + strength)
        prior = float(np.clip(weights[1].sum() / n.sum(), 1e-4, 0.5))
    return {p: float(x) for (p, _), x in zip(patterns, post)}


def _planted(pairs: DataFrame) -> DataFrame:
    """A bounded sample of pairs made defective on purpose, and of untouched ones; ``truth`` names the defect."""
    some = pairs.where((F.size(_words(F.col("answer"))) >= 6) & F.col("answer").rlike(r"\.$")).orderBy(F.xxhash64("__key", "side")).limit(VALIDATION_ROWS)
    share = F.lit(0.4) + F.pmod(F.xxhash64("__key"), F.lit(50)) / 100
    made = {
        "empty": F.lit(" "),
        "truncated": F.rtrim(F.substring("answer", F.lit(1), F.ceil(F.length("answer") * share).cast("int"))),
        "refusal": F.element_at(F.array(*[F.lit(x) for x in ("The passages do not say.", "I cannot answer this.", "Not stated in the text.", "Unknown.")]), (F.pmod(F.xxhash64("__key"), F.lit(4)) + 1).cast("int")),
        "copied_question": F.col("question"),
        "other_language": F.lit("Город был основан давно, и никто не помнит, кем."),
        "none": F.col("answer"),
    }
    made = F.explode(F.array(*[F.struct(F.lit(k).alias("truth"), v.alias("made")) for k, v in made.items()]))
    return some.select("__key", "question", F.array().cast("array<string>").alias("others"), made.alias("m")).select(
        "__key", F.concat(F.lit("="), F.col("m.truth")).alias("side"), "question", F.col("m.made").alias("answer"), "others", F.lit(True).alias("planted")
    )


def find_defects(df: DataFrame, key: str = "answer_id", question: str = "question", sides: tuple[str, ...] = ("pred", "gold"), siblings: tuple[str, ...] = ("v3bu_pred", "dec_pred")) -> DataFrame:
    """``key, side, defect, posterior`` of every defective answer; an answer may have several defects.

    ``siblings`` are other answers to the question, which show what a truncated one should have been. Null answers are
    empty; a null question makes no defect by itself. Repeated rows count once. An empty table gives no rows; other
    columns are ignored.
    """
    side = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("answer"), F.filter(F.array(*[F.col(o) for o in (*sides, *siblings) if o != s]), lambda o: o.isNotNull()).alias("others")) for s in sides]))
    pairs = df.select(F.col(key).alias("__key"), F.col(question).alias("question"), side.alias("s")).select("__key", "s.side", "question", "s.answer", "s.others", F.lit(False).alias("planted")).distinct()
    pairs = keep(pairs)
    voted, named = votes(pairs.unionByName(_planted(pairs)))
    pattern = {d: F.concat_ws("", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in named[d]]).alias(d) for d in DEFECTS}
    voted = keep(voted.select("__key", "side", "planted", *pattern.values()))
    long = voted.select("__key", "side", "planted", F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), F.col(d).alias("pattern")) for d in DEFECTS])).alias("v")).select("__key", "side", "planted", "v.*")
    counted = long.groupBy("defect", "pattern", "planted", F.when(F.col("planted"), F.col("side")).alias("truth")).agg(F.count(F.lit(1)).alias("n")).collect()
    rows = []
    for d in DEFECTS:
        real = [(r.pattern, r.n) for r in counted if r.defect == d and not r.planted]
        seen = {p for p, _ in real}
        extra = sorted({r.pattern for r in counted if r.defect == d} - seen)
        if not real and not extra:
            continue
        defective = [(r.pattern, r.n) for r in counted if r.defect == d and r.planted and r.truth == f"={d}"]
        post = fit_label_model(real + [(p, 0) for p in extra], defective)
        made = [(post[r.pattern], r.truth == f"={d}", r.n) for r in counted if r.defect == d and r.planted and r.truth in (f"={d}", "=none")]
        cutoff = _cutoff(made)
        rows += [(d, p, x, cutoff) for p, x in post.items()]
    fitted = df.sparkSession.createDataFrame(rows, "defect string, pattern string, posterior double, cutoff double")
    found = long.where("NOT planted").join(F.broadcast(fitted), ["defect", "pattern"]).where(F.col("posterior") > F.col("cutoff"))
    # an answer that is empty has no other defect, and a refusal stays one in whatever language or form
    strong = found.groupBy("__key", "side").agg(F.collect_list(F.struct("defect", "posterior")).alias("all"))
    has = lambda d: F.exists("all", lambda x: x["defect"] == d)
    kept = F.when(has("empty"), F.filter("all", lambda x: x["defect"] == "empty")).when(has("refusal"), F.filter("all", lambda x: x["defect"].isin("refusal", "truncated"))).otherwise(F.col("all"))
    return strong.select(F.col("__key").alias(key), "side", F.explode(kept).alias("x")).select(key, "side", "x.*")


def _cutoff(made: list[tuple[float, bool, int]]) -> float:
    """The cutoff with the best F1 on the validation pairs, the middle one of those that tie."""
    if not made:
        return 0.5
    scores = []
    for c in CUTOFFS:
        hit = sum(n for p, t, n in made if p > c and t)
        wrong = sum(n for p, t, n in made if (p > c) != t)
        scores.append(2 * hit / max(1, 2 * hit + wrong))
    best = [c for c, s in zip(CUTOFFS, scores) if s >= max(scores) - 1e-9]
    return best[len(best) // 2]
