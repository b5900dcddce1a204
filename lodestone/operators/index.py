"""Changing an index of chunks: insert, upsert, delete and replace by document, without rebuilding."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def latest(changes: DataFrame, key: str, at: str) -> DataFrame:
    """The last row of every key; rows equal in ``at`` are told apart by all their columns. No window, hence no sort of a hot key."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max(F.struct(F.col(at).alias("__at"), *rest)).alias("__row")).select(key, *[F.col(f"__row.{c}").alias(c) for c in rest])


def upsert(index: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The index with the rows of ``changes`` in place of those with the same keys."""
    return index.join(changes.select(key).distinct(), key, "left_anti").select(*index.columns).unionByName(changes.select(*index.columns))


def delete(index: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The index without the given keys; unknown keys are ignored."""
    return index.join(keys.select(key).distinct(), key, "left_anti").select(*index.columns)


def replace_documents(index: DataFrame, fresh: DataFrame, doc: str = "doc_id") -> DataFrame:
    """All chunks of the documents in ``fresh`` give way to its chunks."""
    return delete(index, fresh, doc).unionByName(fresh.select(*index.columns))
