"""Exact top-k vector search of a stated query set, in blocks, and BM25 over an inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.functions.text import lookup_key
from lodestone.session import cut

#: Rows of a block of queries and of the collection; a task holds one of each.
QUERY_BLOCK, DATA_BLOCK = 2048, 16384
#: The same for BM25; terms of more than one in ``WIDE`` documents are summed over a whole block, whose best are found by runs of ``RUN``.
ASKED_BLOCK, DOC_BLOCK, WIDE, RUN = 32768, 32768, 64, 64


def exact_top_k(queries: DataFrame, data: DataFrame, k: int, dims: int, group: str | None = None, same: bool = True) -> DataFrame:
    """``query_id, id, similarity, rank`` of the k rows of ``data`` most similar to each query by cosine.

    Both tables have ``id`` and ``vector`` (and ``group``, if rows may only meet their own group). Vectors that are
    null, of another length or with a null take no part; a row is no neighbour of its own id (unless the two tables have ids of their own, not the ``same``). Ties go to the smaller
    id. Every block of queries meets every block of data once, so the work is spread whatever the two sizes are.
    """
    sound = F.col("vector").isNotNull() & (F.size("vector") == dims) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("vector", lambda x: x != 0)
    keep = ["id", "vector"] + ([group] if group else [])
    # own names for the queries: they may come from the same table as the data
    if group:  # only equal groups meet: the group is part of the blocks' key
        sound = sound & F.col(group).isNotNull()
    q, d = queries.where(sound).select(*[F.col(c).alias(f"q_{c}") for c in keep]), data.where(sound).select(*keep)
    n_q, n_d = (int(np.ceil(x.count() / b)) or 1 for x, b in ((q, QUERY_BLOCK), (d, DATA_BLOCK)))
    q = q.withColumn("qb", F.pmod(F.xxhash64("q_id"), F.lit(n_q)).cast("int")).withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(n_d - 1))))
    d = d.withColumn("db", F.pmod(F.xxhash64("id"), F.lit(n_d)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_d, out_s = [np.array([], np.int64)], [np.array([], np.int64)], [np.array([])]
        if left.num_rows and right.num_rows:
            x, y = (t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, dims) for t, c in ((left, "q_vector"), (right, "vector")))
            x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
            ids = right.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, y = ids[order], y[order]
            mine = left.column("q_id").to_numpy()
            for a in range(0, len(x), 256):
                s = x[a : a + 256] @ y.T
                if same:
                    s[mine[a : a + 256, None] == ids[None, :]] = -2
                top = np.argsort(-np.round(s, 12), axis=1, kind="stable")[:, :k]
                v = np.take_along_axis(s, top, axis=1)
                i, j = np.nonzero(v > -1.5)
                out_q.append(mine[a + i])
                out_d.append(ids[top[i, j]])
                out_s.append(v[i, j])
        return pa.table({"query_id": pa.array(np.concatenate(out_q), pa.int64()), "id": pa.array(np.concatenate(out_d), pa.int64()), "similarity": pa.array(np.concatenate(out_s), pa.float64())})

    left_key, right_key = (["qb", "db", *([c] if group else [])] for c in (f"q_{group}", group))
    found = q.groupBy(*left_key).cogroup(d.groupBy(*right_key)).applyInArrow(run, "query_id bigint, id bigint, similarity double")
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc, term, tf, len`` of every term of every text."""
    terms = F.filter(F.split(lookup_key(F.col(text)), " "), lambda t: t != "")
    own = docs.select(F.col(doc_id).alias("doc"), terms.alias("terms"))
    return own.select("doc", F.size("terms").alias("len"), F.explode("terms").alias("term")).groupBy("doc", "term", "len").agg(F.count(F.lit(1)).alias("tf"))


def _best_of_sets(sets: list[tuple], spans: list[tuple], wide: np.ndarray, positive: np.ndarray, n: int, k: int) -> Iterator[tuple]:
    """Each of the sorted ``sets`` of terms, widest first, with its k best of ``n`` documents and their scores; ``spans`` has
    the documents of a term and what it adds to them.

    Sums over wide terms are kept for the sets that begin alike. The k best of all runs of documents bound the k best of such
    a sum from below; what lies under that bound can only be among the best through one of the other terms.
    """
    sums, known, common, base, least = [np.zeros(-(-n // RUN) * RUN)], (), None, None, None
    for own in sets:
        if all(positive[t] for t in own):
            mine = tuple(t for t in own if wide[t])
            if mine != common:
                same = next((i for i, (x, y) in enumerate(zip(known, mine)) if x != y), min(len(known), len(mine)))
                for d in range(same, len(mine)):
                    if len(sums) == d + 1:
                        sums.append(np.empty_like(sums[0]))
                    np.copyto(sums[d + 1], sums[d])
                    at, more = spans[mine[d]]
                    sums[d + 1][at] += more
                known, common, base = mine, mine, sums[len(mine)]
                runs = base.reshape(-1, RUN)
                tops = runs.max(axis=1)
                bound = max((np.partition(tops, len(tops) - k)[len(tops) - k] if len(tops) >= k else 0.0) - 1e-8, 0.0)
                high = np.flatnonzero(tops >= bound)
                x, y = np.nonzero((runs[high] >= bound) & (runs[high] > 0))
                least = high[x] * RUN + y
            rare = [spans[t] for t in own if not wide[t]]
            at, same = np.unique(np.concatenate([least, *(x for x, _ in rare)]), return_inverse=True)
            score = base[at] + np.bincount(same, np.concatenate([np.zeros(len(least)), *(y for _, y in rare)]), minlength=len(at))
        else:  # a document that has a term counts, whatever its weight
            at, same = np.unique(np.concatenate([spans[t][0] for t in own]), return_inverse=True)
            score = np.bincount(same, np.concatenate([spans[t][1] for t in own]), minlength=len(at))
        best = np.argsort(-np.round(score, 9), kind="stable")[:k]
        yield own, at[best], score[best]


def bm25(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """``query_id, doc, score, rank`` of the k best documents by Okapi BM25.

    ``queries`` and ``docs`` have ``id`` and ``text``. A term of more than half of the documents, whose weight would be
    negative, has ``floor`` times the mean weight of all terms instead, so no term is dropped. Documents are dealt into
    blocks that every block of queries meets: scores are summed where the documents lie, and a block sends its k best.
    """
    own = cut(docs.select(F.col("id").alias("doc"), lookup_key(F.col("text")).alias("key")).where(F.length("key") > 0))
    held = own.select("doc", F.split("key", " ").alias("terms"))
    stats = held.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("terms")).alias("mean")).first()
    n, mean = stats["n"], stats["mean"]
    weight = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = cut(held.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", weight))
    common = floor * (terms.agg(F.avg("idf")).first()[0] or 0.0)
    words = F.filter(F.split(lookup_key(F.col("text")), " "), lambda t: t != "")
    asked = queries.select(F.col("id").alias("query_id"), F.explode(F.array_distinct(words)).alias("term")).join(terms, "term").select("query_id", "term", F.when(F.col("idf") < 0, common).otherwise(F.col("idf")).alias("idf"))
    n_q, n_d = (int(np.ceil(c / size)) or 1 for c, size in ((queries.count(), ASKED_BLOCK), (n, DOC_BLOCK)))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int")).withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(n_d - 1))))
    held = held.withColumn("db", F.pmod(F.xxhash64("doc"), F.lit(n_d)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, docs_of = (pc.unique(t.column(c).combine_chunks()) for t, c in ((left, "query_id"), (right, "doc")))
        out_q, out_d, out_s = [np.array([], np.int64)], [np.array([], np.int64)], [np.array([])]
        if left.num_rows and right.num_rows:
            texts, asks, docs_of = right.column("terms").combine_chunks(), left.column("term").combine_chunks(), docs_of.sort()
            vocabulary = pc.unique(asks)
            sizes = pc.list_value_length(texts).to_numpy(zero_copy_only=False)
            code = pc.fill_null(pc.index_in(texts.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            cell, tf = np.unique(code[code >= 0] * len(sizes) + row[code >= 0], return_counts=True)
            code, row = cell // len(sizes), cell % len(sizes)
            place = pc.index_in(right.column("doc").combine_chunks(), value_set=docs_of).to_numpy(zero_copy_only=False)[row]
            term = pc.index_in(asks, value_set=vocabulary).to_numpy(zero_copy_only=False)
            idf = np.zeros(len(vocabulary))
            idf[term] = left.column("idf").to_numpy()
            part = idf[code] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[row] / mean))
            cell, same = np.unique(code * len(docs_of) + place, return_inverse=True)  # a document may have several texts
            code, place, part = cell // len(docs_of), cell % len(docs_of), np.bincount(same, part, minlength=len(cell))
            held = np.bincount(code, minlength=len(vocabulary))
            start = np.cumsum(held) - held
            spans = [(place[a : a + n], part[a : a + n]) for a, n in zip(start, held)]
            widest = np.argsort(np.argsort(-held, kind="stable"), kind="stable")
            of = pc.index_in(left.column("query_id").combine_chunks(), value_set=ids).to_numpy(zero_copy_only=False)
            order = np.lexsort((widest[term], of))
            asking: dict[tuple, list[int]] = {}  # equal sets of terms are searched once
            for q, own in enumerate(np.split(term[order], np.flatnonzero(np.diff(of[order])) + 1)):
                asking.setdefault(tuple(own.tolist()), []).append(q)
            wide = (held * WIDE > len(docs_of)) & (idf > 0)
            for own, best, score in _best_of_sets(sorted(asking, key=lambda t: [widest[x] for x in t]), spans, wide, idf > 0, len(docs_of), k):
                for q in asking[own]:
                    out_q.append(np.full(len(best), q))
                    out_d.append(best)
                    out_s.append(score)
        return pa.table({"query_id": ids.take(pa.array(np.concatenate(out_q))), "doc": docs_of.take(pa.array(np.concatenate(out_d))), "score": pa.array(np.concatenate(out_s), pa.float64())})

    shape = f"query_id {queries.schema['id'].dataType.simpleString()}, doc {docs.schema['id'].dataType.simpleString()}, score double"
    scored = asked.groupBy("qb", "db").cogroup(held.groupBy("qb", "db")).applyInArrow(run, shape)
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

