"""Most similar vectors for every vector, over learned partitions.

The index is fitted on a bounded sample: its neighbour graph is cut into balanced parts (recursive halving along the
graph's second eigenvector, with a size constraint), and a small softmax classifier learns each vector's part from the
parts of its neighbours. Of a collection that needs more parts than the sample can show, a bounded sample of each part is
cut and learned in the same way, in the executors, and parts of parts take the place of parts. Every vector of the collection is stored in its most probable part and looks for neighbours in
its several most probable parts, more of them where there are more parts; candidates are reranked by exact cosine in
double precision. Equal vectors are one class, looked up once. Parts that split late lie in one group, and a vector
travels once to each group of its parts. A group with more rows than a block holds is split into blocks that every query
of the group visits, so none is too large for a task and none is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from lodestone.session import cut as keep, shuffle_width

#: Vectors on which the index is fitted, whatever the size of the collection.
SAMPLE = 16_384
#: Neighbours in the graph of the sample.
GRAPH_K = 10
#: Rows that a part should have, and parts at most (the sample has SAMPLE / MOST_PARTS vectors of each).
PART_ROWS, MOST_PARTS = 1024, 512
#: Parts of a part at most, and the sample of a part for each of them.
MOST_WITHIN, WITHIN_SAMPLE = 64, 64
#: Parts of a group, and rows of a block within a group.
GROUP_PARTS, BLOCK = 16, 32_768
#: Cells up to which each has a partition of its own.
MOST_TASKS = 4096
#: Candidates are taken this far below the least cosine, as they are found in single precision.
MARGIN = 1e-3
EPOCHS, RATE, DECAY = 60, 0.5, 1e-5
#: Rows that are routed at a time.
ROUTED = 2048


class Router(NamedTuple):
    """A linear softmax over parts (``w`` of dims x parts, ``b``), and one within each (``ws`` of parts x dims x within, ``bs``)."""

    w: np.ndarray
    b: np.ndarray
    ws: np.ndarray | None = None
    bs: np.ndarray | None = None

    @property
    def parts(self) -> int:
        return self.w.shape[1] * (1 if self.bs is None else self.bs.shape[1])

    def best(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``probes`` most probable parts of each row of ``x``, and the most probable of them. The low bits of a
        part are its first splits."""
        first = x @ self.w + self.b
        if self.bs is None:
            every = np.argpartition(-first, probes - 1, axis=1)[:, :probes] if probes < first.shape[1] else np.tile(np.arange(first.shape[1]), (len(x), 1))
            return every, first.argmax(axis=1)
        outer, within = self.bs.shape
        first -= np.log(np.exp(first - first.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) + first.max(axis=1, keepdims=True)
        wide = min(outer, probes)
        seen = np.argpartition(-first, wide - 1, axis=1)[:, :wide] if wide < outer else np.tile(np.arange(outer), (len(x), 1))
        joint = np.empty((len(x), wide, within), dtype=np.float32)
        for p in np.unique(seen):
            i, j = np.nonzero(seen == p)
            z = x[i] @ self.ws[p] + self.bs[p]
            z -= z.max(axis=1, keepdims=True)
            joint[i, j] = z - np.log(np.exp(z).sum(axis=1, keepdims=True)) + first[i, p][:, None]
        joint = joint.reshape(len(x), -1)
        ids = (seen[:, :, None] + outer * np.arange(within)).reshape(len(x), -1)
        top = np.argpartition(-joint, probes - 1, axis=1)[:, :probes] if probes < joint.shape[1] else np.tile(np.arange(joint.shape[1]), (len(x), 1))
        n = np.arange(len(x))
        return ids[n[:, None], top], ids[n, joint.argmax(axis=1)]


def usable(vectors: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """``__id, __cls, __v`` (packed in their own precision) of vectors of the right length without null, NaN or infinite
    values, not all zero. Equal vectors have one class, a 64-bit hash of their bytes (two different vectors among a
    billion share one with a probability of 3 %, among a hundred million of 0.03 %)."""
    v = F.col(vector)
    own_type = np.float32 if vectors.schema[vector].dataType.elementType == T.FloatType() else np.float64
    sound = v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(own_type).reshape(batch.num_rows, dims) + own_type(0)
                packed = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["__id", "__v"])

    own = vectors.where(sound & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("__id"), v.alias("__v"))
    return own.mapInArrow(pack, "__id bigint, __v binary").select("__id", F.xxhash64("__v").alias("__cls"), "__v")


def _units(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Unit vectors of a column of packed vectors, one per row, in double precision."""
    packed = b"".join(column.to_pylist())
    x = np.frombuffer(packed, dtype=np.float32 if len(packed) == 4 * dims * len(column) else np.float64).reshape(len(column), dims).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Unit vectors in single precision."""
    return _units(column, dims).astype(np.float32)


def probed(probes: int, parts: int) -> int:
    """The parts to visit of ``parts``: ``probes`` of 16 or fewer, and more by the square root of their number, as the
    same share of the true neighbours lies in more parts when these are smaller."""
    return min(parts, int(np.ceil(probes * max(1.0, parts / 16) ** 0.5)))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ids of the k most similar other vectors of each vector of the sample."""
    found = []
    for a in range(0, len(x), 128):  # small blocks, as this runs on the driver
        s = x[a : a + 128] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        found.append(np.argpartition(s, -min(k, s.shape[1] - 1), axis=1)[:, -k:].astype(np.int32))
    return np.concatenate(found)


def _split(nodes: np.ndarray, graph: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """True for one half of ``nodes``: a direction in space as a start, then rounds in which a node follows its
    neighbours, the halves kept equal."""
    centred = x[nodes] - x[nodes].mean(axis=0)
    d = rng.normal(size=x.shape[1])
    for _ in range(5):
        d = centred.T @ (centred @ d)
        d /= np.linalg.norm(d) + 1e-12
    score = centred @ d
    place = np.full(len(x), -1)
    place[nodes] = np.arange(len(nodes))
    near = place[graph[nodes]]
    inside = near >= 0
    score = score / (np.abs(score).max() + 1e-12)
    for _ in range(15):
        around = np.where(inside, score[near], 0).sum(axis=1) / np.maximum(inside.sum(axis=1), 1)
        score = 0.5 * score + 0.5 * around
        score = score - np.median(score)
        score /= np.abs(score).max() + 1e-12
    half = np.zeros(len(nodes), dtype=bool)
    half[np.argsort(score, kind="stable")[len(nodes) // 2 :]] = True
    return half


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """The part of each vector of the sample; ``parts`` is a power of two and all parts are equally large, or nearly."""
    rng = np.random.default_rng(0)
    part = np.zeros(len(x), dtype=int)
    width = 1
    while width < parts:
        for p in range(width):
            nodes = np.flatnonzero(part == p)
            if len(nodes) > 1:
                part[nodes[_split(nodes, graph, x, rng)]] += width
        width *= 2
    return part


def train(x: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression from a vector to the parts of itself and its neighbours."""
    w, b = np.zeros((x.shape[1], parts), dtype=np.float32), np.zeros(parts, dtype=np.float32)
    for p in range(parts):
        if (part == p).any():
            w[:, p] = 8 * x[part == p].mean(axis=0)
    rng = np.random.default_rng(0)
    soft = np.zeros((len(x), parts), dtype=np.float32)
    np.add.at(soft, (np.arange(len(x))[:, None], part[graph]), 0.5 / graph.shape[1])
    soft[np.arange(len(x)), part] += 0.5
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 1024):
            i = order[a : a + 1024]
            z = x[i] @ w + b
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            g = (z - soft[i]) / len(i)
            rate = RATE * parts * (1 - epoch / EPOCHS)
            w -= rate * (x[i].T @ g + DECAY * w)
            b -= rate * g.sum(axis=0)
    return w, b


def fit(vectors: DataFrame, dims: int, n: int) -> Router:
    """The classifier, from a sample of at most SAMPLE rows of ``vectors`` (``__cls``, ``__v``) drawn by hash, and of at
    most WITHIN_SAMPLE rows for each part of a part."""
    wanted = 1
    while wanted < MOST_PARTS * MOST_WITHIN and wanted * PART_ROWS * 2 <= n:
        wanted *= 2
    parts = min(wanted, MOST_PARTS)
    if parts == 1:
        return Router(np.zeros((dims, 1), dtype=np.float32), np.zeros(1, dtype=np.float32))
    rows = vectors.where(_drawn(7, SAMPLE, n)).limit(SAMPLE).toArrow()
    x = _matrix(rows.column("__v"), dims)
    graph = neighbour_graph(x, GRAPH_K)
    outer = Router(*train(x, graph, balanced_parts(x, graph, parts), parts))
    return outer if wanted == parts else _fit_within(vectors, dims, n, outer, wanted // parts)


def _drawn(salt: int, rows: int, n: int) -> Column:
    """True for about ``rows`` of ``n`` classes and a tenth more, by hash."""
    return (F.xxhash64("__cls", F.lit(salt)).cast("double") / 2.0**63 + 1) / 2 < 1.1 * rows / n


def _fit_within(vectors: DataFrame, dims: int, n: int, outer: Router, within: int) -> Router:
    """A classifier within each part, fitted where the part's sample is; no sample is larger than ``bound``."""
    parts, bound = outer.parts, WITHIN_SAMPLE * within
    held = vectors.sparkSession.sparkContext.broadcast(outer)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROUTED):
                some = batch.slice(a, ROUTED)
                part = held.value.best(_matrix(some.column(1), dims), 1)[1]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(part.astype(np.int32))], names=["__cls", "__v", "part"])

    def learn(t: pa.Table) -> pa.Table:
        x = _matrix(t.column("__v"), dims)
        w, b = np.zeros((dims, within), dtype=np.float32), np.full(within, -30, dtype=np.float32)
        b[0] = 0  # a part of few vectors stays whole
        if len(x) >= 2 * within and len(x) > GRAPH_K:
            graph = neighbour_graph(x, GRAPH_K)
            # the vectors of a part lie in one direction; what is left beside it tells its parts
            centre = x.mean(axis=0)
            beside = x - centre
            scale = np.linalg.norm(beside, axis=1).mean() + 1e-9
            w, b = train(beside / scale, graph, balanced_parts(x, graph, within), within)
            w = w / scale
            b = b - centre @ w
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "w": [w.astype(np.float32).tobytes()], "b": [b.astype(np.float32).tobytes()]})

    sample = vectors.where(_drawn(11, parts * bound, n)).select("__cls", "__v").mapInArrow(place, "__cls bigint, __v binary, part int")
    first = Window.partitionBy("part").orderBy(F.xxhash64("__cls", F.lit(11)), "__cls")
    few = sample.withColumn("r", F.row_number().over(first)).where(F.col("r") <= bound).select("part", "__v")
    ws, bs = np.zeros((parts, dims, within), dtype=np.float32), np.tile(np.where(np.arange(within) > 0, -30, 0).astype(np.float32), (parts, 1))
    for r in few.groupBy("part").applyInArrow(learn, "part int, w binary, b binary").collect():  # a row for each of MOST_PARTS parts
        ws[r.part], bs[r.part] = np.frombuffer(r.w, np.float32).reshape(dims, within), np.frombuffer(r.b, np.float32)
    return outer._replace(ws=ws, bs=bs)


def route(vectors: DataFrame, model: Router, dims: int, probes: int) -> DataFrame:
    """``__cls, __v, grp, home, mask`` of ``vectors`` (``__cls, __v, asked``): one row per vector and group of parts that
    it is stored in or asks. ``home`` is its own part within the group, -1 in other groups; the bits of ``mask`` are the
    parts of the group that it asks, of its ``probes`` most probable ones."""
    held = vectors.sparkSession.sparkContext.broadcast(model)
    probes, groups = min(probes, model.parts), group_count(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROUTED):
                some = batch.slice(a, ROUTED)
                top, best = held.value.best(_matrix(some.column("__v"), dims), probes)
                n, asked = np.arange(len(best)), some.column("asked").to_numpy(zero_copy_only=False).astype(bool)
                key = (n[:, None] * groups + top % groups).ravel()
                order = np.argsort(key, kind="stable")
                key, start = np.unique(key[order], return_index=True)
                mask = np.bitwise_or.reduceat((1 << (top // groups)).ravel()[order], start)
                i, g = key // groups, key % groups
                mask = np.where(asked[i], mask, 0).astype(np.int32)
                home = np.where(best[i] % groups == g, best[i] // groups, -1).astype(np.int32)
                sent = (mask > 0) | (home >= 0)
                i, g, home, mask = i[sent], g[sent], home[sent], mask[sent]
                yield pa.RecordBatch.from_arrays([some.column("__cls").take(pa.array(i)), some.column("__v").take(pa.array(i)), pa.array(g.astype(np.int32)), pa.array(home), pa.array(mask)], names=["__cls", "__v", "grp", "home", "mask"])

    return vectors.select("__cls", "__v", "asked").mapInArrow(run, "__cls bigint, __v binary, grp int, home int, mask int")


def group_count(model: Router) -> int:
    return max(1, model.parts // GROUP_PARTS)


def _best(a: np.ndarray, b: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k pairs of each ``a`` with the highest ``v``."""
    if not len(a):
        return a, b, v
    order = np.lexsort((b, -v, a))
    a, b, v = a[order], b[order], v[order]
    first = np.r_[0, np.flatnonzero(np.diff(a)) + 1]
    keep_ = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)])) < k
    return a[keep_], b[keep_], v[keep_]


def _search(k: int, least: float, dims: int):
    def run(t: pa.Table) -> pa.Table:
        ids, home, mask = (t.column(c).to_numpy() for c in ("__cls", "home", "mask"))
        exact = _units(t.column("__v"), dims)
        x = exact.astype(np.float32)
        found = [(np.array([], np.int64), np.array([], np.int64), np.array([]))]
        for part in np.unique(home[home >= 0]):
            data, asks = np.flatnonzero(home == part), np.flatnonzero(mask >> part & 1)
            for a in range(0, len(asks), 1024):
                q = asks[a : a + 1024]
                s = x[q] @ x[data].T
                s[ids[q][:, None] == ids[data][None, :]] = -2
                if least > -1:
                    i, j = np.nonzero(s >= least - MARGIN)
                else:
                    top = np.argpartition(-s, 2 * k - 1, axis=1)[:, : 2 * k] if s.shape[1] > 2 * k else np.tile(np.arange(s.shape[1]), (len(s), 1))
                    i, j = np.repeat(np.arange(len(s)), top.shape[1]), top.ravel()
                    ok = s[i, j] > -1.5
                    i, j = i[ok], j[ok]
                i, j, _ = _best(i, j, s[i, j], 2 * k)
                v = np.einsum("ij,ij->i", exact[q[i]], exact[data[j]])
                ok = v >= least if least > -1 else np.full(len(v), True)
                found.append((ids[q[i[ok]]], ids[data[j[ok]]], v[ok]))
        out = _best(*(np.concatenate(c) for c in zip(*found)), k)
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64()), "s": pa.array(out[2], pa.float64())})

    return run


def similar(
    vectors: DataFrame, key: str, vector: str, dims: int, k: int = 10, least: float = -1.0, probes: int = 8, queries: Column | None = None
) -> DataFrame:
    """``id, neighbour, similarity, rank``: the k most similar other vectors of every vector, or of those with ``queries``.

    Only neighbours with a cosine of ``least`` or more are returned. Ties between different vectors go by the hash
    of their bytes, among equal vectors to the smaller id. ``probes`` equal to the number of parts makes the search exact.
    Vectors that are null, of another length, all zero or with NaN take no part; an id that comes several times counts once. Equal vectors
    count each: they are the first neighbours of one another. An empty table gives no rows.
    """
    sound = usable(vectors, key, vector, dims)
    ids = keep(sound.select("__id", "__cls").distinct())
    member = keep(sound.groupBy("__cls").agg(F.min("__v").alias("__v")))
    n = member.count()
    model = fit(member, dims, max(n, 1))
    asked = member.withColumn("asked", F.lit(True))
    if queries is not None:
        wanted = ids.withColumnRenamed("__id", key).where(queries).select("__cls").distinct().withColumn("asked", F.lit(True))
        asked = member.join(wanted, "__cls", "left").withColumn("asked", F.col("asked").isNotNull())
    # a row is stored in one block of a group and visits all blocks; the queries of a crowded group are dealt over as
    # many lanes, each with all of the data
    rows = route(asked, model, dims, probed(probes, model.parts))
    stored = route(member.withColumn("asked", F.lit(False)), model, dims, 1)
    crowded = stored.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).collect()  # MOST_PARTS * MOST_WITHIN / GROUP_PARTS rows at most
    blocks = F.element_at(F.array(*[F.lit(b) for b in _by_group(crowded, group_count(model))]), F.col("grp") + 1)
    own = {c: F.pmod(F.xxhash64("__cls", F.lit(salt)), blocks).cast("int") for c, salt in (("block", 5), ("lane", 3))}
    cells = F.transform(F.sequence(F.lit(0), blocks * blocks - 1), lambda c: F.struct(F.floor(c / blocks).cast("int").alias("block"), (c % blocks).cast("int").alias("lane")))
    placed = rows.withColumns({"own_block": own["block"], "own_lane": own["lane"], "cell": F.explode(cells)}).select(
        "__cls", "__v", "grp", "cell.block", "cell.lane",
        F.when(F.col("cell.block") == F.col("own_block"), F.col("home")).otherwise(-1).alias("home"),
        F.when(F.col("cell.lane") == F.col("own_lane"), F.col("mask")).otherwise(0).alias("mask"),
    ).where("home >= 0 OR mask > 0")
    # every cell has a number of its own, and where they are few one that falls into a partition of its own
    counts = _by_group(crowded, group_count(model))
    before = np.cumsum([0] + [c * c for c in counts])
    width = max(shuffle_width(vectors.sparkSession), int(before[-1]))
    number = F.element_at(F.array(*[F.lit(int(x)) for x in before[:-1]]), F.col("grp") + 1) + F.col("block") * blocks + F.col("lane")
    if before[-1] <= MOST_TASKS:
        number = F.element_at(F.array(*[F.lit(x) for x in _apart(vectors.sparkSession, int(before[-1]), width)]), number + 1)
    found = placed.withColumn("cell", number.cast("int")).repartition(width, "cell").groupBy("cell").applyInArrow(_search(k, least, dims), "a bigint, b bigint, s double")
    # two classes may meet only once, as a stored row is in one part; k classes are as good as all
    best = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    top = keep(found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("a", "b", "s"))
    return _expand(ids, top, key, k, queries)


def _apart(spark: SparkSession, n: int, width: int) -> list[int]:
    """``n`` numbers that a repartition over ``width`` partitions puts into different ones, as far as that is possible."""
    slot = F.pmod(F.hash(F.col("id").cast("int")), F.lit(width))
    found = spark.range(16 * width).groupBy(slot.alias("slot")).agg(F.min("id").alias("id")).orderBy("slot").limit(n).collect()
    own = [r.id for r in found]
    return own + [16 * width + i for i in range(n - len(own))]


def _by_group(counted: list, groups: int) -> list[int]:
    found = {r.grp: r.blocks for r in counted}
    return [found.get(g, 1) for g in range(groups)]


def _expand(ids: DataFrame, top: DataFrame, key: str, k: int, queries: Column | None) -> DataFrame:
    """From neighbouring classes to neighbouring ids; of each class the k + 1 least ids are as good as all."""
    size = ids.groupBy("__cls").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    single = ids.join(size, "__cls", "left_anti")
    # the least ids of a large class are found in two steps, so that no task sorts all of it
    several = ids.join(size, "__cls").withColumn("lane", F.pmod(F.xxhash64("__id"), F.ceil(F.col("size") / 10_000)))
    some = several.withColumn("i", F.row_number().over(Window.partitionBy("__cls", "lane").orderBy("__id"))).where(F.col("i") <= k + 1)
    first = some.withColumn("i", F.row_number().over(Window.partitionBy("__cls").orderBy("__id"))).where(F.col("i") <= k + 1).select("__id", "__cls")
    own = size.select(F.col("__cls").alias("a"), F.col("__cls").alias("b"), F.lit(1.0).alias("s"))
    near = top.unionByName(own).join(single.unionByName(first).select(F.col("__cls").alias("b"), F.col("__id").alias("neighbour")), "b").select("a", "neighbour", "s")
    asked = ids if queries is None else ids.withColumnRenamed("__id", key).where(queries).withColumnRenamed(key, "__id")
    rows = near.join(asked.select(F.col("__cls").alias("a"), F.col("__id").alias("id")), "a").where(F.col("id") != F.col("neighbour"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"), "neighbour"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "neighbour", F.col("s").alias("similarity"), "rank")


def similar_pairs(found: DataFrame) -> DataFrame:
    """``a, b`` (a < b) of ids of which one is among the other's neighbours."""
    return found.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()
