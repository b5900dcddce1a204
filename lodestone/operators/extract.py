"""Facts from text by patterns: infobox templates, statements, plain facts, structured answers; and tables of values."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions.text import lookup_key

#: Longest subject and longest value of a fact.
MOST_SUBJECT, MOST_LENGTH = 80, 200
# Rows of an infobox that say how it looks.
LAYOUT = {"name", "image", "caption", "image_size", "alt"}
# Attribute names that mean another one.
ALIASES = {
    "date_of_birth": "born", "birth_date": "born", "born_date": "born", "date_of_death": "died", "death_date": "died", "place_of_birth": "birthplace", "birth_place": "birthplace",
    "place_of_death": "deathplace", "death_place": "deathplace", "alma_matter": "alma_mater", "profession": "occupation", "citizenship": "nationality", "spouse_s": "spouse", "spouses": "spouse",
    "partner": "spouse", "parent": "parents", "fathers": "father", "mothers": "mother", "headquartered_in": "headquarters", "headquartered": "headquarters", "hq": "headquarters", "capital_city": "capital",
}
# Verbs of statements "subject verb object".
VERBS = (
    "founded created directed wrote composed invented discovered acquired started published released established signed elected played hosted formed developed owned owns produced designed adapted "
    "succeeded preceded married joined led leads managed won received earned achieved attended studied"
).split()
_NAME = r"\p{L}[\w.\-]*(?:\s+\p{L}[\w.\-]*){0,4}"
_THING = rf"(?:{_NAME}|(?:(?:the|a|an)\s+)?\p{{L}}[\w\-]+(?:\s+\p{{L}}[\w\-]+){{0,4}})"
#: Statements: pattern with the groups of subject, predicate (or a fixed one) and object.
STATEMENTS = [
    (rf"\b({_NAME})\s+({'|'.join(VERBS)})\s+({_THING})", 2, 3),
    (rf"\b({_NAME})\s+(?:is|was|are|were)\s+(?:the|a|an)\s+(\w+(?:\s+\w+){{0,2}})\s+of\s+({_THING})", 2, 3),
    (rf"\b({_NAME})'s\s+(\w+(?:\s+\w+){{0,2}})\s+(?:is|was|are|were)\s+({_THING})", 2, 3),
    (rf"\b({_NAME})\s+(?:was|is)\s+born\s+in\s+({_THING})", "born_in", 2),
    (rf"\b({_NAME})\s+(?:was|is)\s+born\s+(?:on\s+)?([^.;,(]+?)(?=[.;,(]|\z)", "born_on", 2),
    (rf"\b({_NAME})\s+died\s+in\s+({_THING})", "died_in", 2),
]
_WHO = r"(\p{L}[\w.\- ]+?)"
_REST = r"([^.;,(]+?)(?:[.;,(]|\z)"
#: Plain facts: pattern of subject and value, and the attribute.
FACTS = [
    (rf"\b{_WHO}\s+(?:was|is)\s+born\s+(?:on\s+)?{_REST}", "born"),
    (rf"\b{_WHO}\s+(?:was|is)\s+born\s+in\s+{_REST}", "birthplace"),
    (rf"\b{_WHO}\s+died\s+(?:on\s+)?{_REST}", "died"),
    (rf"\b{_WHO}\s+died\s+in\s+{_REST}", "deathplace"),
    (rf"\bThe capital of\s+(\p{{L}}[\w. ]+?)\s+is\s+{_REST}", "capital"),
    (rf"\b{_WHO}\s+is\s+the capital of\s+(\p{{L}}[\w. ]+?)(?:[.;,(]|\z)", "capital_of"),
    (rf"\b{_WHO}\s+is\s+(?:an?\s+)?(\w+(?:\s+\w+){{0,2}})\s+(?:actor|actress|director|singer|author|writer|scientist|politician|player)\b", "nationality"),
]


def attribute_key(name: Column) -> Column:
    """An attribute's name in lower case with underscores, aliases collapsed."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"(?U)[\s\-]+", "_"), r"(?U)[^\w]+", "")
    known = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, plain), plain)


_COMMENT, _TEMPLATE = re.compile(r"<!--.*?-->", re.S), re.compile(r"\{\{([^{}]+)\}\}")
_LINK = re.compile(r"\[\[(?:[^\]|]+\|)?([^\]]+)\]\]")
_ROW = re.compile(r"\|\s*([\w\s\-]+?)\s*=\s*(.*?)(?=\n\s*\||\n\s*\}\}|<!--)", re.S)


def _clean(value: str) -> str:
    """A value without comments and link marks; of nested templates, the arguments without a name."""
    value, before = _COMMENT.sub("", value), None
    while before != value:
        before = value
        value = _TEMPLATE.sub(lambda m: " ".join(p.strip() for p in m.group(1).split("|")[1:] if "=" not in p), value)
    return " ".join(_LINK.sub(r"\1", value).split())


def _template(text: str) -> str | None:
    """The first infobox of a text, up to the brace that closes it."""
    found = re.search(r"\{\{\s*[Ii]nfobox\b", text)
    if not found:
        return None
    depth = 0
    for m in re.finditer(r"\{\{|\}\}", text[found.start() :]):
        depth += 1 if m.group() == "{{" else -1
        if not depth:
            return text[found.start() : found.start() + m.end()]
    return text[found.start() :]


def infobox_triples(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, subject, attribute, value``: the rows of the first infobox template of a text, attributes as written.

    The subject is the row ``name``, else the first link of the text. Rows of layout and empty values are none; texts
    without a template or subject have none. Only texts with a template reach Python, in Arrow batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = _template(t)
                if body is None:
                    continue
                name, link = re.search(r"\|\s*name\s*=\s*((?:\[\[[^\]\n]*\]\]|[^\n|])+)", body), _LINK.search(t)
                subject = (_clean(name.group(1)) if name else "") or (link.group(1) if link else "")
                if subject:
                    out += [(key, subject, k.strip(), v) for k, raw in _ROW.findall(body) if k.strip() and k.strip().lower() not in LAYOUT and (v := _clean(raw))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], batch.schema.field(0).type if i == 0 else pa.string()) for i in range(4)], names=["doc_id", "subject", "attribute", "value"])

    own = docs.where(F.lower(text).contains("infobox")).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, subject string, attribute string, value string")
    return found.where((F.length("value") <= MOST_LENGTH) & (F.length("subject") <= MOST_SUBJECT)).distinct()


def _matches(rows: DataFrame, key: str, text: str, forms: list[tuple[str, Column | int, int]]) -> DataFrame:
    """``key, family, place, subject, predicate, object`` of all matches of patterns with groups of subject and object."""
    def found(family: int, pattern: str, predicate: str | int, group: int) -> Column:
        lit = F.lit("(?iU)" + pattern)
        said = [F.regexp_extract_all(F.col(text), lit, F.lit(g)) for g in (1, predicate if isinstance(predicate, int) else 1, group)]
        return F.transform(F.arrays_zip(*[x.alias(n) for x, n in zip(said, ("s", "p", "o"))]), lambda m, i: F.struct(
            F.lit(family).alias("family"), i.alias("place"), m["s"].alias("subject"), (m["p"] if isinstance(predicate, int) else F.lit(predicate)).alias("predicate"), m["o"].alias("object"),
        ))

    every = [found(family, *form) for family, form in enumerate(forms)]
    return rows.select(key, F.explode(F.concat(*every)).alias("m")).select(key, "m.*")


def _squashed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def statements(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """``key, subject, predicate, object`` of the statements in a text, six families of patterns over the whole text.

    Equal statements of a text, by lookup keys, come once, in the form that the first family finds first. Subjects of
    more than 80 and objects of more than 200 characters are none.
    """
    found = _matches(chunks.where(F.col(text).isNotNull()), key, text, STATEMENTS).select(
        key, "family", "place", _squashed(F.col("subject")).alias("subject"), F.regexp_replace(F.lower(F.trim("predicate")), r"(?U)\s+", "_").alias("predicate"), _squashed(F.col("object")).alias("object")
    )
    sound = found.where((F.length("subject") <= MOST_SUBJECT) & (F.length("object") <= MOST_LENGTH) & (F.col("subject") != "") & (F.col("object") != ""))
    first = F.min(F.struct("family", "place", "subject", "object")).alias("f")
    return sound.groupBy(key, lookup_key(F.col("subject")).alias("__s"), "predicate", lookup_key(F.col("object")).alias("__o")).agg(first).select(key, "f.subject", "predicate", "f.object")


def plain_facts(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """``key, subject, attribute, value`` of births, deaths, capitals and callings that a text states, seven patterns."""
    found = _matches(chunks.where(F.col(text).isNotNull()), key, text, [(p, a, 2) for p, a in FACTS])
    own = found.select(key, _squashed(F.col("subject")).alias("subject"), F.col("predicate").alias("attribute"), _squashed(F.col("object")).alias("value"))
    return own.where((F.length("subject") <= MOST_SUBJECT) & (F.length("value") <= MOST_LENGTH) & (F.col("subject") != "") & (F.col("value") != "")).distinct()


def fact_index(infobox: DataFrame, facts: DataFrame) -> DataFrame:
    """``subject_key, attribute, value_key, subject, value, source, confidence``: facts of templates (confidence 1) and of
    texts (0.7), each once by its keys, in the most certain form. Both have ``source, subject, attribute, value``."""
    every = infobox.withColumn("confidence", F.lit(1.0)).unionByName(facts.withColumn("confidence", F.lit(0.7)))
    keyed = every.select(lookup_key(F.col("subject")).alias("subject_key"), attribute_key(F.col("attribute")).alias("attribute"), lookup_key(F.col("value")).alias("value_key"), "subject", "value", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "confidence")
    best = F.min(F.struct(-F.col("confidence"), "source", "subject", "value")).alias("b")
    kept = keyed.where("subject_key <> '' AND attribute <> '' AND value_key <> ''").groupBy("subject_key", "attribute", "value_key").agg(best)
    return kept.select("subject_key", "attribute", "value_key", "b.subject", "b.value", "b.source", (-F.col("b.col1")).alias("confidence"))


def look_up(hints: DataFrame, key: str, index: DataFrame) -> DataFrame:
    """``key, subject, attribute, value, source, confidence``: the facts that answer the hints (``key, subject, attribute``)."""
    asked = hints.select(key, lookup_key(F.col("subject")).alias("subject_key"), attribute_key(F.col("attribute")).alias("attribute")).distinct()
    return asked.join(index, ["subject_key", "attribute"]).select(key, "subject", "attribute", "value", "source", "confidence").distinct()


def best_fact(found: DataFrame, key: str) -> DataFrame:
    """``key, value, confidence``: the most certain fact, ties by attribute and value."""
    first = F.min(F.struct(-F.col("confidence"), "attribute", "value")).alias("f")
    return found.groupBy(key).agg(first).select(key, F.col("f.value").alias("value"), (-F.col("f.col1")).alias("confidence"))


def fact_chunks(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """``chunk_id, text, made``: the chunks that facts come from, and for facts without one a made chunk that states them.
    ``chunks`` has ``chunk_id, text``."""
    held = chunks.groupBy("chunk_id").agg(F.max("text").alias("text"))
    joined = facts.join(held, facts.source == held.chunk_id, "left")
    own_id = F.concat(F.lit("infobox:"), F.substring(lookup_key(F.col("subject")), 1, 32), F.lit(":"), F.col("attribute"))
    stated = F.concat(F.col("subject"), F.lit(" -- "), F.col("attribute"), F.lit(": "), F.col("value"))
    rows = joined.select(F.coalesce("chunk_id", own_id).alias("chunk_id"), F.when(F.col("chunk_id").isNull(), stated).otherwise(F.col("text")).alias("text"), F.col("chunk_id").isNull().alias("made"))
    return rows.groupBy("chunk_id", "made").agg(F.min("text").alias("text"))


def structured_answer(text: Column) -> Column:
    """The answer in a reader's output: a JSON field, a marked line, else the last line without its final point."""
    as_json = F.regexp_extract(text, r'"answer": *"([^"]*)"', 1)
    marked = F.regexp_extract(text, r"\*\*Answer: ([^*]+)\*\*", 1)
    last = F.regexp_replace(F.regexp_extract(F.regexp_replace(text, r"[ \r\n]+$", ""), r"([^\r\n]*)$", 1), r"\.$", "")
    return F.when(as_json != "", as_json).when(marked != "", marked).otherwise(last)


def multi_values(triples: DataFrame) -> DataFrame:
    """``subject, predicate, n_values, first_value``: the different values of each (subject, predicate), by lookup keys.

    Values are made distinct before they are counted, so that a subject with a third of all rows is counted by many tasks.
    """
    own = triples.select(lookup_key(F.col("subject")).alias("subject"), lookup_key(F.col("predicate")).alias("predicate"), lookup_key(F.col("object")).alias("value"))
    distinct = own.where("subject <> '' AND value <> ''").distinct()
    return distinct.groupBy("subject", "predicate").agg(F.count(F.lit(1)).alias("n_values"), F.min("value").alias("first_value"))


def document_anchors(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """``doc_id, n_members, n_mentions``: documents as anchors of the entities that their chunks mention, two at least."""
    mentions = entities.select("chunk_id", F.explode("entities").alias("name")).select("chunk_id", lookup_key(F.col("name")).alias("entity")).where("entity <> ''").distinct()
    places = chunks.select("chunk_id", "doc_id").distinct()
    return mentions.join(places, "chunk_id").groupBy("doc_id", "entity").agg(F.count(F.lit(1)).alias("m")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_members"), F.sum("m").alias("n_mentions")).where("n_members >= 2")


def cited_passages(responses: DataFrame, key: str, text: str) -> DataFrame:
    """``key, passage, position``: the numbers of the list ``passages`` in a JSON response, in their order; texts without one give none."""
    listed = F.regexp_extract(F.col(text), r'"passages": *\[([0-9, ]*)\]', 1)
    numbers = F.filter(F.split(F.regexp_replace(listed, " ", ""), ","), lambda x: x != "")
    return responses.select(key, F.posexplode(numbers).alias("position", "p")).select(key, F.col("p").cast("bigint").alias("passage"), "position").distinct()
