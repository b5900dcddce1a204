"""From a question to its evidence: entities by name, triples, chunks, and checks of what a chunk supports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.functions.text import let, lookup_key

#: Entities per question.
MOST_ENTITIES = 8


def n_grams(text: Column, lengths: list[int]) -> Column:
    """All runs of the given numbers of words of a text, as lookup keys."""
    sizes = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")

    def runs(w: Column) -> Column:
        of = lambda n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " ")))
        return F.array_distinct(F.flatten(F.filter(F.transform(sizes, of), lambda x: x.isNotNull())))

    return let(F.filter(F.split(lookup_key(text), " "), lambda x: x != ""), runs)


def link_entities(questions: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """``key, entity, position``: names (``entity``, lookup keys) that stand in a question, longest first, at most eight.

    An equi-join on word runs, not a comparison of every question with every name. Runs have the lengths that names
    really have, which are counted first: a few different numbers, however many names there are.
    """
    own = names.select("entity").where(F.length("entity") >= 3).distinct()
    lengths = sorted(r[0] for r in own.select(F.size(F.split("entity", " "))).distinct().collect())
    runs = questions.select(key, F.explode(n_grams(F.col(text), lengths)).alias("entity"))
    found = runs.join(own, "entity")
    order = Window.partitionBy(key).orderBy(F.desc(F.length("entity")), "entity")
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= MOST_ENTITIES).select(key, "entity", "position")


def support(triples: DataFrame, chunks: DataFrame) -> DataFrame:
    """``triple_id, status``: ``valid`` if the chunk of a triple has all words of subject and object, ``partial`` if of
    one, ``invalid`` if of neither, ``refuse`` if there is no such chunk or an end is empty."""
    words = lambda c: F.array_distinct(F.split(lookup_key(F.col(c)), " "))
    own = triples.select("triple_id", "subject", "object", "source_chunk_id").distinct()
    text = chunks.groupBy(F.col("chunk_id").alias("source_chunk_id")).agg(F.max("text").alias("text"))
    has = lambda c: F.size(F.array_except(words(c), words("text"))) == 0
    s, o = has("subject"), has("object")
    empty = (lookup_key(F.col("subject")) == "") | (lookup_key(F.col("object")) == "") | F.col("text").isNull()
    status = F.when(empty, "refuse").when(s & o, "valid").when(s | o, "partial").otherwise("invalid")
    return own.join(text, "source_chunk_id", "left").select("triple_id", status.alias("status")).distinct()
