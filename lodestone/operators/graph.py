"""Triples as a graph: symmetric edges, degrees, bounded paths, evidence and personalised PageRank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from lodestone.functions.text import lookup_key
from lodestone.session import cut, shuffle_width

SALTS = 16
#: Edges of a node in one salt of PageRank; rounds after which ranks must have settled.
EDGES_PER_SALT, MOST_ROUNDS = 1000, 500
#: Bytes of names and links up to which a whole graph is sent to the tasks of PageRank; rankings that a task finds at once,
#: links of a node that are summed over all nodes together, and rows that a task returns at once.
GRAPH_BYTES, AT_ONCE, LAYERS, ROWS_AT_ONCE = 64 << 20, 8, 32, 65536
#: Sources whose neighbourhoods a task returns at once; rankings from equal seeds that go to one task of PageRank, which finds them once.
SOURCES_AT_ONCE, KEYS_PER_SALT = 256, 64
#: Paths that meet a node's edges in one salt.
PATHS_PER_SALT = 256


def edges(triples: DataFrame) -> DataFrame:
    """``subject, predicate, object, chunk, confidence``: normalised distinct edges without loops and empty ends; the
    confidence is the best of equal edges, 0.7 where unknown."""
    own = triples.select(lookup_key(F.col("subject")).alias("subject"), lookup_key(F.col("predicate")).alias("predicate"), lookup_key(F.col("object")).alias("object"), F.col("source_chunk_id").alias("chunk"), F.coalesce(F.nanvl("confidence", F.lit(0.7)), F.lit(0.7)).alias("confidence"))
    sound = own.where((F.col("subject") != "") & (F.col("object") != "") & (F.col("subject") != F.col("object")))
    return sound.groupBy("subject", "predicate", "object", "chunk").agg(F.max("confidence").alias("confidence"))


def symmetric(e: DataFrame) -> DataFrame:
    """``a, b, predicate, n, confidence`` with a < b: undirected edges and the chunks that have them."""
    return e.groupBy(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b"), "predicate").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"))


def degrees(e: DataFrame) -> DataFrame:
    """``node, degree``: the number of different neighbours. Pairs are made distinct first, so that a node with a third
    of all edges is counted by many tasks."""
    pairs = e.select(F.col("subject").alias("node"), F.col("object").alias("other")).unionByName(e.select(F.col("object").alias("node"), F.col("subject").alias("other"))).distinct()
    return pairs.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def chunk_paths(e: DataFrame) -> DataFrame:
    """``chunk, path, confidence, ends``: paths of two edges inside a chunk, the confidence their product. A chunk's edges are few."""
    a = e.select("chunk", F.col("subject").alias("start"), F.col("predicate").alias("p1"), F.col("object").alias("middle"), F.col("confidence").alias("c1"))
    b = e.select("chunk", F.col("subject").alias("middle"), F.col("predicate").alias("p2"), F.col("object").alias("finish"), F.col("confidence").alias("c2"))
    return a.join(b, ["chunk", "middle"]).where("start <> finish").select("chunk", F.concat_ws(" > ", "start", "p1", "middle", "p2", "finish").alias("path"), F.round(F.col("c1") * F.col("c2"), 6).alias("confidence"))


def traversal_hash(e: DataFrame) -> DataFrame:
    """``chunk, n_edges, traversal``: SHA-1 of the sorted undirected edge ids of a chunk, each ended by a NUL."""
    edge = F.concat_ws("|", F.least("subject", "object"), "predicate", F.greatest("subject", "object"))
    ids = e.select("chunk", edge.alias("id")).distinct().groupBy("chunk").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return ids.select("chunk", F.size("ids").alias("n_edges"), F.sha1(F.array_join(F.transform("ids", lambda i: F.concat(i, F.lit("\0"))), "")).alias("traversal"))


def walk_edges(triples: DataFrame) -> DataFrame:
    """``lo, hi, edge, confidence``: undirected edges of the whole graph, loops included, once per predicate and pair of
    ends. Of equal edges the first triple counts; its confidence is clamped to [0, 1], 0.7 where unknown."""
    s, o = lookup_key(F.col("subject")), lookup_key(F.col("object"))
    own = triples.where(F.col("predicate") != "").select("triple_id", F.least(s, o).alias("lo"), "predicate", F.greatest(s, o).alias("hi"), F.coalesce(F.nanvl("confidence", F.lit(0.7)), F.lit(0.7)).alias("c"))
    first = own.where("lo <> '' AND hi <> ''").groupBy("lo", "predicate", "hi").agg(F.min(F.struct("triple_id", "c")).alias("first"))
    return first.select("lo", "hi", F.concat_ws("|", "lo", "predicate", "hi").alias("edge"), F.greatest(F.least(F.col("first.c"), F.lit(1.0)), F.lit(0.0)).alias("confidence"))


def anchor_paths(walk: DataFrame, anchors: DataFrame, depth: int = 2, k: int = 8) -> DataFrame:
    """``anchor, rank, edges, path, finish, confidence``: the k best walks of 1 to ``depth`` edges from every anchor
    (``anchor``) over the whole graph in both directions, no edge twice; ``path`` is the edge ids in order.

    Walks rank by the product of confidences, then by path. A walk is no better than its own beginning, so the k best
    after each hop hold all beginnings that count, and the k best unused edges of a node all continuations: both cuts are
    exact. Nodes then have k + depth - 1 edges at most, dealt over salts against hubs that many walks reach.
    """
    ends = walk.select(F.col("lo").alias("node"), F.col("hi").alias("other"), "edge", "confidence").unionByName(walk.where("lo <> hi").select(F.col("hi").alias("node"), F.col("lo").alias("other"), "edge", "confidence"))
    strongest = Window.partitionBy("node").orderBy(F.desc("confidence"), "edge")
    near = ends.withColumn("r", F.row_number().over(strongest)).where(F.col("r") <= k + depth - 1).select("node", "other", "edge", F.col("confidence").alias("c"))
    near = cut(near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    best = Window.partitionBy("anchor").orderBy(F.desc("confidence"), "path")
    empty = F.array().cast("array<string>")
    kept = anchors.select("anchor").distinct().select("anchor", empty.alias("edges"), F.lit("").alias("path"), F.col("anchor").alias("finish"), F.lit(1.0).alias("confidence"))
    for hop in range(depth):
        last = kept.where(F.size("edges") == hop).withColumn("salt", F.pmod(F.xxhash64("anchor", "path"), F.lit(SALTS)).cast("int"))
        longer = last.join(near, (last.finish == near.node) & (last.salt == near.salt)).where(~F.array_contains("edges", F.col("edge"))).select(
            "anchor", F.array_append("edges", F.col("edge")).alias("edges"), F.concat_ws("->", F.array_append("edges", F.col("edge"))).alias("path"),
            F.col("other").alias("finish"), (F.col("confidence") * F.col("c")).alias("confidence"),
        )
        every = longer if hop == 0 else kept.unionByName(longer)
        kept = cut(every.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r"))
    return kept.withColumn("rank", F.row_number().over(best))


def path_hashes(paths: DataFrame, key: str) -> DataFrame:
    """``key, n_edges, traversal``: SHA-1 of the sorted edge ids of the paths of a key, repeated ones too, each ended by a
    NUL. A key has the k best paths, so its list is short."""
    ids = paths.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("edges"))).alias("ids"))
    return ids.select(key, F.size("ids").alias("n_edges"), F.sha1(F.array_join(F.transform("ids", lambda i: F.concat(i, F.lit("\0"))), "")).alias("traversal"))


def _chebyshev(done: int, weight: float, damping: float) -> float:
    return 1.0 if done == 0 else 2 / (2 - damping**2) if done == 1 else 1 / (1 - damping**2 * weight / 4)


def _whole_graph(links: pa.Table) -> tuple:
    """``names, degree, layers, rest, first, part`` of undirected links: the nodes with most links first; in ``layers[k]``
    the k-th neighbour of every node that has one; in ``rest`` the neighbours beyond ``LAYERS`` of those that have more,
    where ``first`` has the place of each node's first; in ``part`` a number of the connected part of each node."""
    a, b = (links.column(c).combine_chunks() for c in ("subject", "object"))
    names = pc.unique(pa.concat_arrays([a, b]))
    i, j = (pc.index_in(x, value_set=names).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
    source, target = np.concatenate([i, j[i != j]]), np.concatenate([j, i[i != j]])
    degree = np.bincount(target, minlength=len(names))
    order = np.argsort(-degree, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    names, degree, source, target = names.take(pa.array(order)), degree[order], place[source], place[target]
    source = source[np.argsort(target, kind="stable")].astype(np.int32)
    start = np.cumsum(degree) - degree
    layers = [source[start[degree > k] + k] for k in range(min(LAYERS, degree.max(initial=0)))]
    rest = source[np.arange(len(source)) - np.repeat(start, degree) >= LAYERS]
    more = degree[degree > LAYERS] - LAYERS
    part = np.arange(len(names))
    while len(part) and not np.array_equal(part, low := (near := np.minimum(part, np.minimum.reduceat(part[source], start)))[near]):
        part = low
    return names, degree, layers, rest, np.cumsum(more) - more, part


def _pagerank_in_tasks(links: DataFrame, own: DataFrame, key: str, rounds: int, damping: float, tolerance: float) -> DataFrame:
    graph = links.sparkSession.sparkContext.broadcast(_whole_graph(links.toArrow()))
    most = MOST_ROUNDS

    def rank(sets: list[np.ndarray], n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Place in ``sets``, nodes and scores of each ranking; ``n`` nodes, of which the last may have no links."""
        names, degree, layers, rest, first, part = graph.value
        home = np.zeros((n, len(sets)))
        for c, nodes in enumerate(sets):
            home[nodes, c] = 1 / len(nodes)
        m, weight, open_ = len(names), 1.0, np.arange(len(sets))
        score, last, met = home, np.zeros_like(home), home != 0
        for done in range(rounds):
            weight = _chebyshev(done, weight, damping)
            share, got = score[:m] / degree[:, None], np.zeros_like(score)
            for at in layers:
                got[: len(at)] += np.take(share, at, axis=0)
            if len(rest):
                got[: len(first)] += np.add.reduceat(np.take(share, rest, axis=0), first, axis=0)
            score, last = weight * (damping * got + (1 - damping) * home) + (1 - weight) * last, score
            change = np.abs(score - last).sum(axis=0)
            if rounds < most:
                met = met | (score != 0)
            ends = (change <= tolerance) | (done == rounds - 1 and rounds < most)
            for c in np.flatnonzero(ends):
                if rounds >= most:  # all that can be reached, whatever the rounds were
                    own = sets[open_[c]]
                    met[:m, c] = np.isin(part, part[own[own < m]])
                at = np.flatnonzero(met[:, c])
                yield int(open_[c]), at, score[at, c]
            if ends.any():
                score, last, home, met, open_ = score[:, ~ends], last[:, ~ends], home[:, ~ends], met[:, ~ends], open_[~ends]
            if not len(open_):
                return
        raise RuntimeError(f"ranks still change by {change.max()} after {rounds} rounds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, nodes = batch.column(0), batch.column(1).flatten()
            known = graph.value[0]
            names = pa.concat_arrays([known, pc.unique(nodes.filter(pc.invert(pc.is_in(nodes, value_set=known))))])
            place = pc.index_in(nodes, value_set=names).to_numpy(zero_copy_only=False)
            asking: dict[tuple, list[int]] = {}  # equal seeds are ranked once
            for row, x in enumerate(np.split(place, np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))[:-1])):
                asking.setdefault(tuple(x), []).append(row)
            sets = list(asking)
            for a in range(0, len(sets), AT_ONCE):
                for c, at, score in rank([np.array(x) for x in sets[a : a + AT_ONCE]], len(names)):
                    node = names if len(at) == len(names) else names.take(pa.array(at))
                    for row in asking[sets[a + c]]:
                        found = pa.RecordBatch.from_arrays([pa.repeat(keys[row], len(at)), node, pa.array(score)], names=[key, "node", "score"])
                        yield from (found.slice(b, ROWS_AT_ONCE) for b in range(0, len(at), ROWS_AT_ONCE))

    asked = own.where("node IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    alike = asked.groupBy("nodes").agg(F.ceil(F.count(F.lit(1)) / KEYS_PER_SALT).alias("salts"))
    dealt = asked.join(alike, "nodes").withColumn("salt", F.pmod(F.xxhash64(key), F.col("salts")))
    # by hashes: a repartition by what the rows are joined by already would be left out, and their few bytes joined in one task
    return dealt.repartition(shuffle_width(own.sparkSession), F.xxhash64("nodes", "salt")).select(key, "nodes").mapInArrow(run, f"`{key}` {own.schema[key].dataType.simpleString()}, node string, score double")


def pagerank(e: DataFrame, seeds: DataFrame, rounds: int = MOST_ROUNDS, damping: float = 0.85, tolerance: float = 1e-8, key: str | None = None) -> DataFrame:
    """``key, node, score`` of personalised PageRank from the ``seeds`` (``key, node``) of each key, or ``node, score``
    from all seeds (``node``) where there is no key.

    Rounds go on until a key's scores change by no more than ``tolerance`` in sum, ``rounds`` at most (an error if that is
    not enough, unless fewer are asked for). The graph is undirected, so Chebyshev's weights apply, which need about a
    quarter of the rounds of plain iteration.

    A graph of up to ``GRAPH_BYTES`` is sent to the tasks, which rank for their keys one block after another and write no
    ranks down between rounds. Beyond that, ranks of all keys are shuffled each round: shares are summed per key and node
    before the shuffle, the edges of a node are salted by its degree, lineage is cut in the shared checkpoint folder.
    """
    by = [key] if key else []
    half = cut(e.select(F.least("subject", "object").alias("subject"), F.greatest("subject", "object").alias("object")).distinct())
    size = half.agg(F.sum(F.octet_length("subject") + F.octet_length("object") + 8)).first()[0] or 0
    own = seeds.select(*by, "node").distinct()
    if size <= GRAPH_BYTES:
        found = _pagerank_in_tasks(half, own if key else own.withColumn("all", F.lit(0)), key or "all", rounds, damping, tolerance)
        return found.select(*by, "node", "score")
    pairs = half.unionByName(half.where("subject <> object").select(F.col("object").alias("subject"), F.col("subject").alias("object")))
    out = cut(pairs.groupBy("subject").agg(F.count(F.lit(1)).alias("out")).withColumn("salts", F.ceil(F.col("out") / EDGES_PER_SALT).cast("int")))
    links = cut(pairs.join(out.select("subject", "salts"), "subject").select("subject", "object", F.pmod(F.xxhash64("object"), F.col("salts")).cast("int").alias("salt")))
    n = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    seed = cut((own.join(n, by) if by else own.crossJoin(n)).select(*by, "node", (1.0 / F.col("n")).alias("start")))
    rank, weight = cut(seed.select(*by, "node", F.col("start").alias("score"), F.lit(0.0).alias("last"))), 1.0
    for done in range(rounds):
        weight = _chebyshev(done, weight, damping)
        share = rank.join(out, rank.node == out.subject).select(*by, "node", (F.col("score") / F.col("out")).alias("share"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        got = share.join(links, (share.node == links.subject) & (share.salt == links.salt)).groupBy(*by, F.col("object").alias("node")).agg((weight * damping * F.sum("share")).alias("score")).withColumn("last", F.lit(0.0))
        home = seed.select(*by, "node", (weight * (1 - damping) * F.col("start")).alias("score"), F.lit(0.0).alias("last"))
        held = rank.select(*by, "node", ((1 - weight) * F.col("last")).alias("score"), F.col("score").alias("last"))
        rank = cut(got.unionByName(home).unionByName(held).groupBy(*by, "node").agg(F.sum("score").alias("score"), F.sum("last").alias("last")))
        change = rank.groupBy(*by).agg(F.sum(F.abs(F.col("score") - F.col("last"))).alias("change")).agg(F.max("change")).first()[0] or 0.0
        if change <= tolerance:
            break
    else:
        if rounds >= MOST_ROUNDS:
            raise RuntimeError(f"ranks still change by {change} after {rounds} rounds")
    return rank.select(*by, "node", "score")


def pairs(e: DataFrame) -> DataFrame:
    """``a, b, confidence`` with a < b: each pair of connected nodes with its best confidence."""
    return e.groupBy(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).agg(F.max("confidence").alias("confidence"))


def predicates_between(e: DataFrame, asked: DataFrame) -> DataFrame:
    """``a, b, predicate, forward``: the predicates that connect the asked pairs (``a, b``), in either direction."""
    both = e.select(F.col("subject").alias("a"), F.col("object").alias("b"), "predicate", F.lit(True).alias("forward")).unionByName(e.select(F.col("object").alias("a"), F.col("subject").alias("b"), "predicate", F.lit(False).alias("forward")))
    return asked.select("a", "b").distinct().join(both, ["a", "b"]).select("a", "b", "predicate", "forward").distinct()


def onward(last: DataFrame, near: DataFrame) -> DataFrame:
    """Each path (``source, node``) of ``last`` with each edge (``from``) of ``near`` at its end. Where more than
    ``PATHS_PER_SALT`` paths reach a node, its edges are repeated once per so many paths; all others travel once."""
    hubs = last.groupBy("node").agg(F.count(F.lit(1)).alias("paths")).where(F.col("paths") > PATHS_PER_SALT).select("node", F.ceil(F.col("paths") / PATHS_PER_SALT).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    paths = last.join(hubs, "node", "left").withColumn("salt", F.pmod(F.xxhash64("source"), salts).cast("int")).drop("salts")
    held = near.join(hubs.withColumnRenamed("node", "from"), "from", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return paths.join(held, (paths.node == held["from"]) & (paths.salt == held.salt)).drop("salt", "from")


def reach(e: DataFrame, sources: DataFrame, hops: int = 2, k: int = 10, least: float = 0.0, paths: bool = True) -> DataFrame:
    """``source, node, rank, confidence, path``: the k nodes that each source (``source``) reaches best within ``hops``;
    without ``path`` if no ``paths`` are asked for, which then don't travel either.

    A path's confidence is the product of its edges' ones; a node counts by its best path, then by fewer hops, then by
    name. The k best after each hop hold every node over which a better one can be reached, and 2k + 1 edges of a node
    all continuations: both cuts are exact. Hubs that many paths reach are dealt over salts.
    """
    both = pairs(e)
    ends = both.select(F.col("a").alias("from"), F.col("b").alias("to"), "confidence").unionByName(both.select(F.col("b").alias("from"), F.col("a").alias("to"), "confidence"))
    near = ends.withColumn("r", F.row_number().over(Window.partitionBy("from").orderBy(F.desc("confidence"), "to"))).where(F.col("r") <= 2 * k + 1)
    near = cut(near.select("from", "to", F.col("confidence").alias("c")))
    known = ends.select(F.col("from").alias("source")).distinct()
    best, way = Window.partitionBy("source").orderBy(F.desc("confidence"), "hops", "node"), ["path"] if paths else []
    kept = sources.select("source").distinct().join(known, "source", "left_semi").select("source", F.col("source").alias("node"), F.lit(1.0).alias("confidence"), F.lit(0).alias("hops"), *[F.array("source").alias(c) for c in way])
    for hop in range(hops):
        last = kept.where(F.col("hops") == hop)
        longer = onward(last, near).select("source", F.col("to").alias("node"), (F.col("confidence") * F.col("c")).alias("confidence"), F.lit(hop + 1).alias("hops"), *[F.array_append(c, F.col("to")).alias(c) for c in way])
        longer = longer.where((F.col("confidence") >= least) & (F.col("node") != F.col("source")))
        if paths:
            one = kept.unionByName(longer).groupBy("source", "node").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "hops", "path")).alias("b")).select("source", "node", (-F.col("b.c")).alias("confidence"), "b.hops", "b.path")
        else:  # a node is kept once, with fewer hops than any new way to it, so plain maxima suffice
            none = F.lit(None)
            every = kept.select("source", "node", F.col("confidence").alias("old"), F.col("hops").alias("before"), none.cast("double").alias("new")).unionByName(longer.select("source", "node", none.cast("double").alias("old"), none.cast("int").alias("before"), F.col("confidence").alias("new")))
            one = every.groupBy("source", "node").agg(F.max("old").alias("old"), F.max("before").alias("before"), F.max("new").alias("new"))
            stays = F.col("new").isNull() | (F.col("old") >= F.col("new"))
            one = one.select("source", "node", F.when(stays, F.col("old")).otherwise(F.col("new")).alias("confidence"), F.when(stays, F.col("before")).otherwise(hop + 1).alias("hops"))
        kept = cut(one.withColumn("r", F.row_number().over(best)).where((F.col("r") <= k + 1)).drop("r"))
    return kept.where("node <> source").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("source", "node", "rank", "confidence", *way)


def _near_graph(both: pa.Table, most: int) -> tuple:
    """``names`` in order, and of each the ``start`` and ``degree`` of its best edges, ``most`` at most, in ``other`` and ``weight``."""
    a, b = (both.column(c).combine_chunks() for c in ("a", "b"))
    names = pc.unique(pa.concat_arrays([a, b]))
    names = names.take(pc.sort_indices(names))
    i, j = (pc.index_in(x, value_set=names).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
    c = both.column("confidence").to_numpy()
    source, other, weight = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([c, c])
    order = np.lexsort((other, -weight, source))
    degree = np.bincount(source, minlength=len(names))
    held = np.arange(len(order)) - np.repeat(np.cumsum(degree) - degree, degree) < most
    degree = np.minimum(degree, most)
    return names, np.cumsum(degree) - degree, degree, other[order][held], weight[order][held]


def neighbourhood(e: DataFrame, sources: DataFrame, hops: int, k: int, least: float = 0.0) -> DataFrame:
    """``source, node``: the nodes of ``reach``. A graph of up to ``GRAPH_BYTES`` is sent to the tasks, where the ways from a
    source are not written down; beyond that ``reach`` itself finds them."""
    both = cut(pairs(e))
    size = both.agg(F.sum(F.octet_length("a") + F.octet_length("b") + 16)).first()[0] or 0
    asked = sources.select("source").distinct()
    if size > GRAPH_BYTES:
        return reach(e, asked, hops, k, least, paths=False).select("source", "node")
    graph = e.sparkSession.sparkContext.broadcast(_near_graph(both.toArrow(), 2 * k + 1))

    def best(source: int) -> np.ndarray:
        names, start, degree, other, weight = graph.value
        node, value, far = np.array([source]), np.array([1.0]), np.array([0])
        for hop in range(hops):
            last = far == hop
            n, v = degree[node[last]], value[last]
            at = np.arange(n.sum()) + np.repeat(start[node[last]] - (np.cumsum(n) - n), n)
            to, c = other[at], np.repeat(v, n) * weight[at]
            sound = (c >= least) & (to != source)
            new = np.full(len(names), -np.inf)
            np.maximum.at(new, to[sound], c[sound])
            more = new[node] > value
            value, far = np.where(more, new[node], value), np.where(more, hop + 1, far)
            new[node] = -np.inf
            fresh = np.flatnonzero(new > -np.inf)
            node, value, far = np.concatenate([node, fresh]), np.concatenate([value, new[fresh]]), np.concatenate([far, np.full(len(fresh), hop + 1)])
            kept = np.lexsort((node, far, -value))[: k + 1]
            node, value, far = node[kept], value[kept], far[kept]
        return node[node != source][:k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = graph.value[0]
        for batch in batches:
            for a in range(0, batch.num_rows, SOURCES_AT_ONCE):
                own = batch.column(0).slice(a, SOURCES_AT_ONCE)
                own = own.filter(pc.is_in(own, value_set=names))
                found = [best(x) for x in pc.index_in(own, value_set=names).to_pylist()]
                if found:
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))), names.take(pa.array(np.concatenate(found)))], names=["source", "node"])

    return asked.repartition(shuffle_width(e.sparkSession), F.xxhash64("source")).mapInArrow(run, "source string, node string")


def path_evidence(e: DataFrame, paths: DataFrame, key: str) -> DataFrame:
    """``key, hop, chunk``: the chunks whose edges connect consecutive nodes of a path (``key, path``), each at its first hop."""
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("x"), F.element_at("path", i + 1).alias("y")))
    each = paths.where(F.size("path") > 1).select(key, F.posexplode(steps).alias("hop", "s")).select(key, "hop", F.least("s.x", "s.y").alias("a"), F.greatest("s.x", "s.y").alias("b"))
    held = e.select(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b"), "chunk").where("chunk IS NOT NULL").distinct()
    return each.join(held, ["a", "b"]).groupBy(key, "chunk").agg(F.min("hop").alias("hop")).select(key, "hop", "chunk")
