"""What models write, parsed: lists, scores, entities, triples, steps, sub-questions; all by built-in expressions.

Broken text gives empty results, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lodestone.functions.text import let


def _text(raw: Column) -> Column:
    return F.coalesce(raw, F.lit(""))


def _between(raw: Column, opening: str, closing: str) -> Column:
    """From the first opening to the last closing mark; empty without both."""
    return F.regexp_extract(_text(raw), rf"(?s)\{opening}.*\{closing}", 0)


def sub_questions(raw: Column) -> Column:
    """The texts of a JSON list in noisy text; all of them must be texts that aren't blank, else there are none."""
    items = F.try_variant_get(F.try_parse_json(_between(raw, "[", "]")), "$", "array<variant>")

    def body(xs: Column) -> Column:
        texts = F.transform(xs, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.trim(F.try_variant_get(x, "$", "string"))).otherwise(""))
        return F.when(xs.isNull() | F.exists(texts, lambda t: t == ""), F.array().cast("array<string>")).otherwise(texts)

    return let(items, body)


def text_list(raw: Column, most: int) -> Column:
    """The first ``most`` distinct texts of a JSON list in noisy text; other values are left out."""
    items = F.coalesce(F.try_variant_get(F.try_parse_json(_between(raw, "[", "]")), "$", "array<variant>"), F.array().cast("array<variant>"))
    texts = F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.trim(F.try_variant_get(x, "$", "string"))).otherwise(""))
    kept = F.filter(texts, lambda t: t != "")
    first = let(kept, lambda ts: F.filter(ts, lambda t, i: F.array_position(F.transform(ts, F.lower), F.lower(t)) == i + 1))
    return F.slice(first, 1, most)


def judge_scores(raw: Column, n: Column, low: float = 0.0, high: float = 10.0) -> Column:
    """``n`` scores of a JSON list in noisy text, within bounds; missing ones and other values are the middle."""
    middle = (low + high) / 2
    items = F.coalesce(F.from_json(_between(raw, "[", "]"), "array<string>"), F.array().cast("array<string>"))
    score = lambda x: F.greatest(F.least(F.coalesce(F.try_cast(x, "double") if hasattr(F, "try_cast") else x.try_cast("double"), F.lit(middle)), F.lit(high)), F.lit(low))
    given = F.transform(F.slice(items, F.lit(1), F.greatest(n, F.lit(0))), score)
    return F.concat(given, F.array_repeat(F.lit(middle), F.greatest(n - F.size(given), F.lit(0))))


def two_entities(raw: Column) -> Column:
    """``struct<e1, e2>`` of a JSON object in noisy text; empty where missing."""
    obj = _between(raw, "{", "}")
    return F.struct(*[F.coalesce(F.trim(F.get_json_object(obj, f"$.{k}")), F.lit("")).alias(k) for k in ("e1", "e2")])


def named_entities(raw: Column) -> Column:
    """The list ``named_entities`` of the first flat JSON object that has one."""
    obj = F.regexp_extract(_text(raw), r'(?s)\{[^{}]*"named_entities"\s*:\s*\[[^\]]*\][^{}]*\}', 0)
    return F.coalesce(F.from_json(obj, "named_entities array<string>")["named_entities"], F.array().cast("array<string>"))


def listed_triples(raw: Column) -> Column:
    """The triples of the first flat JSON object with a list ``triples``; only lists of three are triples."""
    obj = F.regexp_extract(_text(raw), r'(?s)\{[^{}]*"triples"\s*:\s*\[\s*(?:\[[^\]]*\]\s*,?\s*)*\][^{}]*\}', 0)
    every = F.coalesce(F.from_json(obj, "triples array<array<string>>")["triples"], F.array().cast("array<array<string>>"))
    return F.filter(every, lambda t: (F.size(t) == 3) & F.forall(t, lambda x: x.isNotNull()))


def final_answer(raw: Column) -> Column:
    """The line after "Final answer:", else the last line that isn't blank; without its final points."""
    marked = F.regexp_extract(_text(raw), r"(?:Final answer|Final Answer|FINAL ANSWER|final answer):\s*([^\n]*)", 1)
    last = F.regexp_extract(F.regexp_replace(_text(raw), r"\s+$", ""), r"([^\n]*)$", 1)
    chosen = F.when(F.regexp_like(_text(raw), F.lit(r"(?:Final answer|Final Answer|FINAL ANSWER|final answer):")), marked).otherwise(last)
    return F.trim(F.regexp_replace(F.trim(chosen), r"\.+$", ""))


def intermediate(raw: Column, most_facts: int = 6) -> Column:
    """``struct<answer, missing, next_query, facts>`` of a structured step: lines ANSWER, MISSING and NEXT_QUERY, and the
    bullets of the block EXTRACT, or of the whole text without one; null where a line is missing."""
    t = _text(raw)
    line = lambda k: F.nullif(F.trim(F.regexp_extract(t, rf"(?im)^\s*(?:\*\*)?{k}(?:\*\*)?\s*:\s*(.+?)\s*$", 1)), F.lit(""))
    block = F.regexp_extract(t, r"(?is)(?:^|\n)\s*1[.)]\s*EXTRACT[^\n]*\n(.+?)(?=\n\s*2[.)]\s*INTEGRATE|\z)", 1)
    bullets = F.regexp_extract_all(F.when(block != "", block).otherwise(t), F.lit(r"(?m)^\s*[-*]\s+(.+?)\s*$"), F.lit(1))
    return F.struct(F.trim(F.regexp_replace(line("ANSWER"), r"\.+$", "")).alias("answer"), line("MISSING").alias("missing"), line("NEXT_QUERY").alias("next_query"), F.slice(F.filter(F.transform(bullets, lambda t: F.trim(t)), lambda b: b != ""), 1, most_facts).alias("facts"))


def resolve(question: Column, answers: Column) -> Column:
    """A sub-question with ``{prev}`` and ``{answer}`` replaced by the last of the earlier answers, ``{N}`` by the N-th;
    missing ones are empty."""
    last = F.coalesce(F.try_element_at(answers, F.lit(-1)), F.lit(""))
    filled = F.regexp_replace(_text(question), F.lit(r"(?i)\{(?:prev|answer)\}"), F.replace(F.replace(last, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")))
    numbered = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(answers), F.lit(1))), filled, lambda s, i: F.replace(s, F.concat(F.lit("{"), i.cast("string"), F.lit("}")), F.coalesce(F.try_element_at(answers, i), F.lit(""))))
    return F.trim(F.regexp_replace(numbered, r"\{\d+\}", ""))


def proper_nouns(text: Column, most: int = 3) -> Column:
    """The first distinct runs of capitalised words that are no question words."""
    runs = F.regexp_extract_all(_text(text), F.lit(r"(?U)\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})\b"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(runs, lambda r: ~r.isin("Who", "What", "Where", "When", "Why", "How", "Which", "Find", "The", "A", "An"))), 1, most)


def next_query(question: Column, entities: Column, cue: Column | None = None, most: int = 8) -> Column:
    """The question with the entities seen so far, and what to look for."""
    seen = F.array_join(F.slice(entities, 1, most), ", ")
    focus = F.lit("") if cue is None else F.coalesce(cue, F.lit(""))
    widened = F.when(focus != "", F.concat(question, F.lit(" (entities seen: "), seen, F.lit(", focus: "), focus, F.lit(")"))).otherwise(F.concat(question, F.lit(" (entities seen: "), seen, F.lit("; alternative phrasings, different keywords)")))
    return F.when(F.size(entities) > 0, widened).otherwise(question)


def seeded_query(question: Column, cue: Column) -> Column:
    """The question with up to three names of a cue."""
    names = proper_nouns(cue)
    return F.when(F.size(names) > 0, F.concat_ws(" ", question, F.array_join(names, " "))).otherwise(question)


def balanced_object(raw: Column) -> Column:
    """The first JSON object of a text with balanced braces, texts inside quotation marks left alone; null without one.

    A text is cut at its braces, quotation marks and backslashes, and the depth is folded over these pieces only.
    """
    start = F.locate("{", _text(raw))
    pieces = F.regexp_extract_all(F.substring(_text(raw), start, F.length(_text(raw))), F.lit(r'(?s)\\.|"|\{|\}|[^\\"{}]+|\\'), F.lit(0))
    state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).cast("int").alias("length"), F.lit(False).alias("done"))

    def step(s: Column, p: Column) -> Column:
        quoted = F.when(p == '"', ~s["quoted"]).otherwise(s["quoted"])
        depth = s["depth"] + F.when(~s["quoted"] & (p == "{"), 1).when(~s["quoted"] & (p == "}"), -1).otherwise(0)
        return F.when(s["done"], s).otherwise(F.struct(depth.alias("depth"), quoted.alias("quoted"), (s["length"] + F.length(p)).alias("length"), (~s["quoted"] & (p == "}") & (depth == 0)).alias("done")))

    return F.when(start > 0, let(F.aggregate(pieces, state, step), lambda s: F.when(s["done"], F.substring(_text(raw), start, s["length"]))))
