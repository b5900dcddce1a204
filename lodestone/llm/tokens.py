"""Token ids of whole texts by a byte-level BPE rank file, with Spark higher-order functions.

Texts are split into words with the vocabulary's own pattern; every distinct word of the corpus is merged once, by an
``aggregate`` that folds the ranked merges over the word's bytes against a literal rank map, and the occurrences pick
up the ids by a join. No Python runs on the executors.

A piece is a string that holds one character (U+0000 to U+00FF) per byte, so that string functions act on bytes.
"""

from __future__ import annotations

import base64
import json
import os
import zlib

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.session import cut, shuffle_width

#: Place of the public rank files unless a caller passes another.
TOKENIZERS = os.environ.get("LODESTONE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

# The split pattern of the vocabulary, with the Unicode white space spelt out for Java.
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)

BUCKETS = 16384
NO_RANK = 2**31 - 1
#: A word is hot if it makes up at least 1/HOT of all occurrences; there can be no more than HOT of those.
HOT = 2000


def read_ranks(path: str | None = None) -> dict[str, int]:
    """The rank file as {piece: id}; a vocabulary is a file of fixed size."""
    with open(path or os.path.join(TOKENIZERS, VOCABULARY), "rb") as f:
        pairs = (line.split() for line in f if line.strip())
        return {base64.b64decode(token).decode("latin-1"): int(rank) for token, rank in pairs}


def rank_map(ranks: dict[str, int]) -> Column:
    """The ranks as one literal: an array of small maps, addressed by the piece's CRC."""
    table: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        table[zlib.crc32(piece.encode("utf-8")) % BUCKETS][piece] = rank
    return F.from_json(F.lit(json.dumps(table)), "array<map<string,int>>")


def _rank(table: Column, piece: Column) -> Column:
    bucket = F.element_at(table, (F.crc32(F.encode(piece, "UTF-8")) % BUCKETS).cast("int") + 1)
    return F.coalesce(F.element_at(bucket, piece), F.lit(NO_RANK))


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` evaluated and stored once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def as_bytes(text: Column) -> Column:
    """A string with one character for each byte of the UTF-8 form of ``text``."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def _fold(table: Column, piece: Column) -> Column:
    """Merge the lowest-ranked adjacent pair, again and again, then look the pieces up."""
    parts = F.split(piece, "")
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda i: _rank(table, F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))),
    )
    start = F.struct(parts.alias("p"), pairs.alias("r"))

    def merge(state: Column, _: Column) -> Column:
        p, r = state["p"], state["r"]

        def at(i: Column) -> Column:
            joined = F.concat(F.element_at(p, i), F.element_at(p, i + 1))
            left = F.when(i > 1, F.array(_rank(table, F.concat(F.element_at(p, F.greatest(i - 1, F.lit(1))), joined))))
            right = F.when(i + 1 < F.size(p), F.array(_rank(table, F.concat(joined, F.element_at(p, F.least(i + 2, F.size(p)))))))
            none = F.array().cast("array<int>")
            return F.struct(
                F.concat(F.slice(p, F.lit(1), i - 1), F.array(joined), F.slice(p, i + 2, F.greatest(F.size(p) - i - 1, F.lit(0)))).alias("p"),
                F.concat(
                    F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))),
                    F.coalesce(left, none),
                    F.coalesce(right, none),
                    F.slice(r, i + 2, F.greatest(F.size(r) - i - 1, F.lit(0))),
                ).alias("r"),
            )

        least = F.array_min(r)
        return F.when(least.isNull() | (least == NO_RANK), state).otherwise(_let(F.array_position(r, least).cast("int"), at))

    return F.aggregate(
        F.sequence(F.lit(1), F.size(parts) - 1), start, merge, lambda s: F.transform(s["p"], lambda x: _rank(table, x))
    )


def word_ids(word: Column, ranks: dict[str, int]) -> Column:
    """The ids of one word, as ``array<int>``."""

    def body(table: Column) -> Column:
        def ids(piece: Column) -> Column:
            return _let(
                _rank(table, piece),
                lambda whole: F.when(whole != NO_RANK, F.array(whole)).otherwise(_fold(table, piece)),
            )

        return _let(as_bytes(word), ids)

    return _let(rank_map(ranks), body)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def _occurrences(docs: DataFrame, key: list[str], text: str) -> DataFrame:
    full = docs.where(F.length(text) > 0)
    return full.select(*key, F.posexplode(words(F.col(text))).alias("__pos", "__word"))


def dictionary(found: DataFrame, path: str | None = None) -> DataFrame:
    """``word, n, ids`` of every distinct word of the occurrences, kept in the checkpoint folder.

    Folding is much work for few bytes, so the words are dealt over at least as many tasks as there are cores, whatever
    their size.
    """
    counts = found.groupBy(F.col("__word").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    spread = counts.repartition(shuffle_width(found.sparkSession), "word")
    return cut(spread.withColumn("ids", word_ids(F.col("word"), read_ranks(path))))


def _with_words(found: DataFrame, key: list[str], entries: DataFrame, value: str) -> DataFrame:
    """Occurrences with ``value`` of their word. Words that make up 1/HOT of all occurrences or more, at most HOT of
    them, are broadcast; the others meet their occurrences by a shuffle in which no word can be hot."""
    total = entries.agg(F.sum("n").alias("t")).select("t").scalar()
    entry = entries.select(F.col("word").alias("__word"), F.col(value).alias("__value"), "n")
    hot = F.broadcast(entry.where(F.col("n") * HOT >= total).drop("n"))
    cold = entry.where(F.col("n") * HOT < total).drop("n")
    return (
        found.join(hot, "__word")
        .select(*key, "__pos", "__value")
        .unionByName(found.join(hot, "__word", "left_anti").join(cold, "__word").select(*key, "__pos", "__value"))
    )


def token_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, ids array<int>`` of all documents.

    Null and empty texts give an empty list. Strings that look like special tokens are ordinary text. Repeated rows
    (the same id and text) come out once; one id with several texts comes out once for each text. A null id is an id
    like any other. An empty table gives no rows; other columns are ignored.
    """
    own = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    own = own.withColumns({"__h": F.xxhash64("__text"), "__n": F.length("__text")})
    key = ["__id", "__h", "__n"]
    found = _occurrences(own, key, "__text")
    valued = _with_words(found, key, dictionary(found, path), "ids")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("__pos").alias("p"), F.col("__value").alias("v"))))
    once = F.filter("o", lambda x, i: (i == 0) | (x["p"] != F.get("o", i - 1)["p"]))  # a repeated row gives each place again
    ids = valued.groupBy(*key).agg(ordered.alias("o")).select("__id", F.flatten(F.transform(once, lambda x: x["v"])).alias("ids"))
    blank = own.where(F.col("__text").isNull() | (F.length("__text") == 0)).select("__id", F.array().cast("array<int>").alias("ids")).distinct()
    return ids.unionByName(blank).withColumnRenamed("__id", doc_id)


def token_counts(docs: DataFrame, key: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """``key..., n_tokens bigint`` of all rows, rows with the same key added up; null and empty texts count 0."""
    own = docs.select(*key, F.col(text).alias("__text"))
    found = _occurrences(own, key, "__text")
    entries = dictionary(found, path).withColumn("size", F.size("ids").cast("bigint"))
    counted = _with_words(found, key, entries, "size").select(*key, "__value")
    return counted.unionByName(own.select(*key, F.lit(0).cast("bigint").alias("__value"))).groupBy(*key).agg(F.sum("__value").alias("n_tokens"))


def decode_ids(ids: Column, ranks: dict[str, int]) -> Column:
    """The text of a list of ids: the binary pieces one after another, read as UTF-8."""
    by_id = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        by_id[rank] = piece
    pieces = F.from_json(F.lit(json.dumps(by_id)), "array<string>")
    joined = _let(pieces, lambda table: F.array_join(F.transform(ids, lambda i: F.element_at(table, i + 1)), ""))
    return F.decode(F.encode(joined, "ISO-8859-1"), "UTF-8")
