"""Chunking, chunk ids and the offline embedder; all as folds over array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions.text import EDGES, lookup_key


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def _n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[ \t\r\n]+"), lambda w: w != ""))


def pack_sentences(text: Column, size: int = 400, overlap: int = 50) -> Column:
    """Chunks of whole sentences of up to ``size`` words. A sentence that would overfill a chunk begins the next one,
    which first takes over the last sentences of the finished chunk that together have ``overlap`` words at most. A
    longer sentence stands alone. Null and blank texts have no chunks."""
    parts = F.filter(F.split(_trim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])[ \t\r\n]+"), lambda s: _trim(s) != "")
    entries = F.transform(parts, lambda s: F.struct(s.alias("s"), _n_words(s).alias("n")))
    none = F.array().cast("array<struct<s:string,n:int>>")
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x["n"])
    tail = lambda xs: F.aggregate(
        F.reverse(xs), F.struct(none.alias("kept"), F.lit(0).alias("n"), F.lit(True).alias("open")),
        lambda a, x: F.when(a["open"] & (a["n"] + x["n"] <= overlap), F.struct(F.concat(F.array(x), a["kept"]).alias("kept"), (a["n"] + x["n"]).alias("n"), F.lit(True).alias("open"))).otherwise(F.struct(a["kept"].alias("kept"), a["n"].alias("n"), F.lit(False).alias("open"))),
        lambda a: a["kept"],
    )
    join = lambda xs: F.array_join(F.transform(xs, lambda x: x["s"]), " ")

    def step(a: Column, x: Column) -> Column:
        full = (F.size(a["now"]) > 0) & (total(a["now"]) + x["n"] > size)
        return F.when(full, F.struct(F.concat(a["done"], F.array(join(a["now"]))).alias("done"), F.concat(tail(a["now"]), F.array(x)).alias("now"))).otherwise(
            F.struct(a["done"].alias("done"), F.concat(a["now"], F.array(x)).alias("now"))
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), none.alias("now"))
    return F.aggregate(entries, start, step, lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(join(a["now"])))).otherwise(a["done"]))


def pack_paragraphs(text: Column, least: int = 100, most: int = 1500) -> Column:
    """Paragraphs packed while their characters are fewer than ``most``; chunks under ``least`` join their predecessor."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n[ \t\r]*\n"), lambda t: _trim(t)), lambda p: p != "")
    empty = F.array().cast("array<string>")
    glue = lambda xs, p: F.concat(F.slice(xs, F.lit(1), F.size(xs) - 1), F.array(F.concat(F.element_at(xs, -1), F.lit("\n\n"), p)))
    packed = F.aggregate(parts, empty, lambda a, p: F.when((F.size(a) > 0) & (F.length(F.try_element_at(a, F.lit(-1))) + F.length(p) < most), glue(a, p)).otherwise(F.concat(a, F.array(p))))
    return F.aggregate(packed, empty, lambda a, p: F.when((F.size(a) > 0) & (F.length(p) < least), glue(a, p)).otherwise(F.concat(a, F.array(p))))


def chunks(docs: DataFrame, doc_id: str, packed: Column) -> DataFrame:
    """``chunk_id, doc_id, pos, text`` from a column of packed chunks."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(packed).alias("pos", "text"))
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("#chunk"), F.col("pos").cast("string")).alias("chunk_id"), "doc_id", "pos", "text")


def hash_embedding(docs: DataFrame, doc_id: str, text: str, buckets: int = 256) -> DataFrame:
    """``doc_id, bucket, weight``: word counts by MD5 bucket at unit length; the sparse form of the offline embedder."""
    words = F.explode(F.filter(F.split(lookup_key(F.col(text)), " "), lambda w: w != ""))
    own = docs.select(F.col(doc_id).alias("doc_id"), words.alias("w"))
    bucket = F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("bigint") % buckets
    counts = own.groupBy("doc_id", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
    length = counts.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("c") * F.col("c")).cast("double")).alias("l"))
    return counts.join(length, "doc_id").select("doc_id", "bucket", F.round(F.col("c") / F.col("l"), 6).alias("weight"))


def centroids(vectors: DataFrame, by: str, vector: str) -> DataFrame:
    """``by, pos, value``: mean vectors at unit length, one row per component; the sums are combined before the shuffle."""
    parts = vectors.where(F.col(vector).isNotNull()).select(by, F.posexplode(vector).alias("pos", "x"))
    mean = parts.groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    length = mean.groupBy(by).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("l"))
    return mean.join(length, by).select(by, "pos", F.round(F.col("m") / F.col("l"), 6).alias("value"))
