"""Anchors: groups of entities at several grains, their vectors, and the way from a query to them.

Layer 1 are topics of documents, 2 documents, 3 groups of a document's chunks, 4 entities with their neighbours. Members
and vectors are tables (``anchor, entity`` and ``anchor, layer, parent, vector``), as a topic may have very many members.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.operators.search import exact_top_k
from lodestone.session import cut

#: What a linked entity adds to the score of an anchor, by layer; entities with anchors of their own; rounds of grouping.
BOOST = {1: 0.05, 2: 0.10, 3: 0.15, 4: 0.30}
MOST_ENTITIES, ROUNDS = 200, 4
#: Cuts of the policy, and chunks under which a sure anchor takes its parent along.
SURE, LIKELY, FEW_CHUNKS = 0.7, 0.4, 50


def document_members(mentions: DataFrame, places: DataFrame) -> DataFrame:
    """``anchor, entity`` of layer 2: a document with what its chunks mention, if that is anything."""
    return places.join(mentions, "chunk_id").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("anchor"), "entity").distinct()


def entity_members(e: DataFrame, most: int = MOST_ENTITIES) -> DataFrame:
    """``anchor, entity`` of layer 4: the entities of the highest degree with their neighbours."""
    pairs = e.select(F.col("subject").alias("node"), F.col("object").alias("entity")).unionByName(e.select(F.col("object").alias("node"), F.col("subject").alias("entity"))).distinct()
    top = pairs.groupBy("node").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node").limit(most)
    own = pairs.join(F.broadcast(top.select("node")), "node").unionByName(top.select("node", F.col("node").alias("entity")))
    return own.select(F.concat(F.lit("ent:"), F.col("node")).alias("anchor"), "entity").distinct()


def means(rows: DataFrame, by: list[str], vector: str, dims: int) -> DataFrame:
    """``by, vector``: mean vectors at unit length; components are averaged as columns, with partial sums."""
    sums = rows.groupBy(*by).agg(*[F.avg(F.col(vector)[i].cast("double")).alias(f"__{i}") for i in range(dims)])
    mean = sums.select(*by, F.array(*[F.col(f"__{i}") for i in range(dims)]).alias("m"))
    length = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x))
    return mean.withColumn("l", length).select(*by, F.transform("m", lambda x: x / F.when(F.col("l") > 0, F.col("l")).otherwise(1.0)).alias("vector"))


def topics(chunks: DataFrame, dims: int) -> DataFrame:
    """``doc_id, topic`` of layer 1: k-means over the mean vectors of documents, k the root of their number (2 to 20)."""
    docs = cut(means(chunks, ["doc_id"], "vector", dims))
    n = docs.count()
    k = max(2, min(20, int(n**0.5)))
    if n <= k:
        return docs.select("doc_id", F.lit(0).alias("topic"))
    model = KMeans(k=k, seed=42, featuresCol="f", predictionCol="topic").fit(docs.select("doc_id", array_to_vector("vector").alias("f")))
    return model.transform(docs.select("doc_id", array_to_vector("vector").alias("f"))).select("doc_id", "topic")


def chunk_groups(chunks: DataFrame, dims: int) -> DataFrame:
    """``chunk_id, doc_id, part`` of layer 3: the chunks of every document with four or more, in two or three groups.

    Lloyd's rounds for all documents together: centres are averaged per (document, part) with partial sums, and a chunk
    only sees the three centres of its document, so that a document with very many chunks is spread over many tasks.
    """
    sizes = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 4").withColumn("k", F.least(F.lit(3), F.greatest(F.lit(2), F.floor(F.col("n") / 3))).cast("int"))
    now = cut(chunks.join(sizes, "doc_id").select("chunk_id", "doc_id", "vector", "k", F.pmod(F.xxhash64("chunk_id"), F.col("k")).cast("int").alias("part")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    for _ in range(ROUNDS):
        centres = means(now, ["doc_id", "part"], "vector", dims).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "vector"))).alias("cs"))  # three of a document at most
        nearest = F.array_max(F.transform("cs", lambda c: F.struct(F.round(dot(F.col("vector"), c["vector"]), 9).alias("s"), (-c["part"]).alias("p"))))["p"]
        now = cut(now.join(centres, "doc_id").select("chunk_id", "doc_id", "vector", "k", (-nearest).alias("part")))
    return now.select("chunk_id", "doc_id", "part")


def build(chunks: DataFrame, mentions: DataFrame, e: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """The tables of members (``anchor, entity``) and of anchors (``anchor, layer, parent, vector``).

    ``chunks`` has ``chunk_id, doc_id, vector``, ``mentions`` ``chunk_id, entity`` and ``e`` the edges. The vector of an
    anchor is the mean of the distinct chunks that mention a member; topics need five members, other layers two or three.
    """
    places = chunks.select("chunk_id", "doc_id").distinct()
    by_topic = cut(topics(chunks, dims))
    groups = cut(chunk_groups(chunks, dims))
    neighbours = e.select(F.col("subject").alias("entity"), F.col("object").alias("other")).unionByName(e.select(F.col("object").alias("entity"), F.col("subject").alias("other"))).distinct()
    in_topic = places.join(by_topic, "doc_id").join(mentions, "chunk_id").select(F.concat(F.lit("topic:"), F.col("topic").cast("string")).alias("anchor"), "entity").distinct()
    wider = in_topic.unionByName(in_topic.join(neighbours, "entity").select("anchor", F.col("other").alias("entity"))).distinct()
    in_group = groups.join(mentions, "chunk_id").select(F.concat(F.lit("part:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("part").cast("string")).alias("anchor"), "entity").distinct()
    every = None
    for layer, members, least in ((1, wider, 5), (2, document_members(mentions, places), 1), (3, in_group, 2), (4, entity_members(e), 2)):
        enough = members.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("anchor")
        one = members.join(enough, "anchor").withColumn("layer", F.lit(layer))
        every = one if every is None else every.unionByName(one)
    every = cut(every)
    parent = F.when(F.col("layer") == 3, F.concat(F.lit("doc:"), F.regexp_extract("anchor", r"^part:(.*):\d+$", 1)))
    # an anchor meets each chunk once, however many of its members stand there
    met = every.join(mentions, "entity").select("anchor", "layer", "chunk_id").distinct().join(chunks.select("chunk_id", "vector"), "chunk_id")
    vectors = means(met, ["anchor", "layer"], "vector", dims).withColumn("parent", parent)
    return every.select("anchor", "entity"), cut(vectors.select("anchor", "layer", "parent", "vector"))


def classify(queries: DataFrame, links: DataFrame, members: DataFrame, anchors: DataFrame, dims: int, k: int = 3) -> DataFrame:
    """``query_id, rank, anchor, layer, parent, score``: the k best anchors of each query (``id, vector``).

    The score is the cosine with the anchor's vector plus the boost of its layer for every linked entity (``query_id,
    entity``) among its members. The best by cosine alone and all boosted ones are enough to find the best of all.
    """
    numbered = cut(anchors.withColumn("id", F.xxhash64("anchor")))
    near = exact_top_k(queries, numbered.select("id", "vector"), k, dims, same=False).select("query_id", "id")
    boost = F.coalesce(*[F.when(F.col("layer") == layer, b) for layer, b in BOOST.items()], F.lit(0.1))
    lifted = links.select("query_id", "entity").distinct().join(members, "entity").join(anchors.select("anchor", "layer"), "anchor").groupBy("query_id", F.xxhash64("anchor").alias("id")).agg(F.sum(boost).alias("boost"))
    pairs = near.unionByName(lifted.select("query_id", "id")).distinct().join(lifted, ["query_id", "id"], "left")
    q = queries.select(F.col("id").alias("query_id"), F.col("vector").alias("qv"))
    both = pairs.join(q, "query_id").join(numbered, "id")
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    cosine = F.aggregate(F.zip_with("qv", "vector", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x) / (size(F.col("qv")) * size(F.col("vector")))
    scored = both.select("query_id", "anchor", "layer", "parent", F.round(cosine + F.coalesce("boost", F.lit(0.0)), 6).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "anchor")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "anchor", "layer", "parent", "score")


def route(top: DataFrame, sizes: DataFrame) -> DataFrame:
    """``query_id, route, anchors``: where to look, from the best anchors: the first if it is sure, with its parent if it has
    few chunks (``anchor, n``); the first three if it is likely; else a topic and the first."""
    best = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "anchor", "layer", "parent", "score"))).alias("t"))  # three of a query
    first = F.col("t")[0]
    rows = best.join(sizes.withColumnsRenamed({"anchor": "__a", "n": "__n"}), first["anchor"] == F.col("__a"), "left")
    small = (F.coalesce("__n", F.lit(0)) < FEW_CHUNKS) & first["parent"].isNotNull()
    topic = F.try_element_at(F.filter("t", lambda a: a["layer"] == 1), F.lit(1))["anchor"]
    kind = F.when(first["score"] >= SURE, F.when(small, "escalate-parent").otherwise("high-conf")).when(first["score"] >= LIKELY, "warm-up").when(topic.isNull(), "low-conf-no-l1").otherwise("fallback-l1")
    chosen = (
        F.when(kind == "escalate-parent", F.array(first["parent"], first["anchor"])).when(kind.isin("high-conf", "low-conf-no-l1"), F.array(first["anchor"]))
        .when(kind == "warm-up", F.transform("t", lambda a: a["anchor"])).otherwise(F.array(topic, first["anchor"]))
    )
    return rows.select("query_id", kind.alias("route"), F.array_distinct(chosen).alias("anchors"))
