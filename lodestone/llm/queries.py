"""The queries of the numbered problems: name -> (spark, data folder) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm import mixing, names, neighbours, qa_pairs, quantiles, sentences, tokens, truncation
from lodestone.session import load

#: Parts that a vector visits of 16 (see ``neighbours.probed``): few find what is very similar, many what is similar at all.
P1_PROBES, P1_WIDE_PROBES = 4, 64


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = neighbours.similar(load(spark, d, "chunks"), "vec_id", "embedding", 64, k=10, least=0.85, probes=P1_PROBES)
    pairs = neighbours.similar_pairs(found)
    return pairs.select(F.col("a").alias("vec_id_a"), F.col("b").alias("vec_id_b"))


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar chunks of every chunk whose id is divisible by 100, however weak the similarity."""
    found = neighbours.similar(load(spark, d, "chunks"), "vec_id", "embedding", 64, k=10, probes=P1_WIDE_PROBES, queries=F.col("vec_id") % 100 == 0)
    return found.select("id", "neighbour", F.round("similarity", 6).alias("similarity"), "rank")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return qa_pairs.find_defects(load(spark, d, "selective_answers")).select("answer_id", "side", "defect").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.find_cut(load(spark, d, "reader_responses")).where("cut").select("response_id").distinct()


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(truncation.find_cut(load(spark, d, "reader_responses")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    spelt = names.table_names(load(spark, d, "openie_results"), load(spark, d, "raw_triples"))
    return names.variants(names.entities(spelt))


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.rollup(quantiles.daily_sketches(load(spark, d, "arm_runs")))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(load(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The round trip: the ids of all texts decoded again."""
    ids = tokens.token_ids(load(spark, d, "documents"))
    return ids.select("doc_id", tokens.decode_ids(F.col("ids"), tokens.read_ranks()).alias("text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    solved = mixing.solve(mixing.document_tokens(load(spark, d, "documents")), load(spark, d, "mix_targets"))
    return mixing.unreachable(solved)


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    sizes = mixing.document_tokens(load(spark, d, "documents"))
    return mixing.copies(sizes, mixing.solve(sizes, load(spark, d, "mix_targets"))).select("mix_id", "doc_id", "copies")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes = mixing.document_tokens(load(spark, d, "documents"))
    solved = mixing.solve(sizes, load(spark, d, "mix_targets"))
    return mixing.shares(solved, mixing.copies(sizes, solved))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(load(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_neighbours, p2_found, p3_found, p3_rates, p4_found, p5_percentiles, p6_ids, p6_decoded, p7_found, p7_mix, p7_shares, p8_found)}
