"""Percentiles of very large columns by relative-rank compactors.

A sketch is a stack of levels; an item of level h stands for 2^h values. A level that is full sorts itself and compacts
its lower part: every second item moves up, the others go. How far the compaction reaches into the level follows a
schedule that leaves the upper items alone most of the time, so that the rank error is proportional to the distance
from the top: p99.9 is as sharp relative to its tail as p50 is to the half above it. Sketches of partitions or days
merge level by level, in any order.

Sketches are tables, one row per (key, level): ``n`` and ``items`` of the level with the compactor's state. They can be
stored by day and united later.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lodestone.session import cut as keep

#: Items of a section and sections of a new level; a level holds 2 * SECTION * SECTIONS items.
SECTION, SECTIONS = 32, 3
#: Rows that a task groups at a time, and rows of sketches.
CHUNK_ROWS, CHUNK_SKETCHES = 400_000, 20_000
#: Rows of partial sketches of one key that a task merges.
FAN = 512

STATE = "level int, state bigint, section int, sections int, items array<double>"


class Compactor:
    """One level of a sketch."""

    __slots__ = ("items", "state", "section", "sections")

    def __init__(self, items: np.ndarray, state: int = 0, section: int = SECTION, sections: int = SECTIONS):
        self.items, self.state, self.section, self.sections = items, state, section, sections

    @property
    def capacity(self) -> int:
        return 2 * self.section * self.sections

    def compact(self, coin: int) -> np.ndarray:
        """What moves to the next level; the rest stays."""
        items = np.sort(self.items)
        ones = (~self.state & (self.state + 1)).bit_length() - 1
        spared = self.capacity // 2 + (self.sections - min(ones + 1, self.sections)) * self.section
        reach = max(0, len(items) - spared) // 2 * 2
        self.items = items[reach:]
        self.state += 1
        if self.state >= 1 << (self.sections - 1):
            self.sections *= 2
            self.section = max(4, int(round(self.section / np.sqrt(2) / 2)) * 2)
        return items[coin:reach:2]


def compress(levels: dict[int, Compactor], seed: int) -> None:
    """Compact from the bottom until no level is over its capacity. The coins follow from the seed and the states."""
    h = 0
    while h <= max(levels):
        level = levels.get(h)
        while level is not None and len(level.items) >= level.capacity:
            coin = (seed * 0x9E3779B97F4A7C15 + h * 0xBF58476D1CE4E5B9 + level.state * 0x94D049BB133111EB >> 29) & 1
            up = level.compact(coin)
            if h + 1 in levels:
                levels[h + 1].items = np.concatenate([levels[h + 1].items, up])
            else:
                levels[h + 1] = Compactor(up)
        h += 1


def _groups(table: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys together, and where each group begins."""
    code = np.zeros(table.num_rows, dtype=np.int64)
    for k in keys:
        column = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        width = len(column.dictionary) + 1
        code = code * width + column.indices.to_numpy(zero_copy_only=False)
        _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    return order, np.flatnonzero(np.r_[True, np.diff(code[order]) != 0]) if len(order) else np.array([], dtype=int)


def _emit(keys: pa.Table, rows: list[tuple[int, int, Compactor]], schema: pa.Schema) -> pa.RecordBatch | None:
    """Rows (row of keys, level, compactor) as one batch."""
    if not rows:
        return None
    at = pa.array([r[0] for r in rows])
    sizes = np.array([len(r[2].items) for r in rows])
    offsets = pa.array(np.r_[0, np.cumsum(sizes)], type=pa.int32())
    values = pa.array(np.concatenate([r[2].items for r in rows]), type=pa.float64())
    columns = [keys.column(n).combine_chunks().take(at) for n in keys.column_names]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    columns += [
        pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].state for r in rows], pa.int64()),
        pa.array([r[2].section for r in rows], pa.int32()), pa.array([r[2].sections for r in rows], pa.int32()),
        pa.ListArray.from_arrays(offsets, values),
    ]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _schema(df: DataFrame, keys: list[str]) -> tuple[T.StructType, list[str]]:
    return T.StructType([df.schema[k] for k in keys] + list(T._parse_datatype_string(STATE).fields)), keys


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= most:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def sketch(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys..., level, state, section, sections, items``: the partial sketches of every partition; no shuffle.

    Null, NaN and infinite values do not count; null keys are keys like any other. An empty table gives no rows.
    """
    schema, _ = _schema(df, keys)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = _arrow(schema)
        for table in _chunks(batches, CHUNK_ROWS):
            order, starts = _groups(table, keys)
            values = table.column("__value").to_numpy()[order]
            rows = []
            for a, b in zip(starts, np.r_[starts[1:], len(order)]):
                levels = {0: Compactor(values[a:b])}
                compress(levels, int(a) + len(order))
                rows += [(int(order[a]), h, c) for h, c in levels.items() if len(c.items) or h == 0]
            batch = _emit(table.select(keys), rows, target)
            if batch is not None:
                yield batch

    own = df.select(*keys, F.col(value).cast("double").alias("__value"))
    own = own.where(F.col("__value").isNotNull() & ~F.isnan("__value") & (F.abs("__value") < float("inf")))
    return own.mapInArrow(build, schema)


def _merged(table: pa.Table, keys: list[str]) -> list[tuple[int, dict[int, Compactor]]]:
    order, starts = _groups(table, keys)
    level, state, section, sections = (table.column(c).to_numpy()[order] for c in ("level", "state", "section", "sections"))
    lists = table.column("items").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    found = []
    for a, b in zip(starts, np.r_[starts[1:], len(order)]):
        levels: dict[int, Compactor] = {}
        parts: dict[int, list[int]] = {}
        for i in range(a, b):
            parts.setdefault(int(level[i]), []).append(i)
        for h, rows in parts.items():
            items = np.concatenate([values[offsets[order[i]] : offsets[order[i] + 1]] for i in rows])
            levels[h] = Compactor(items, int(np.bitwise_or.reduce(state[rows])), int(section[rows].min()), int(sections[rows].max()))
        for h in range(max(levels)):
            levels.setdefault(h, Compactor(np.array([])))
        compress(levels, int(b - a))
        found.append((int(order[a]), levels))
    return found


def _whole_keys(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of about CHUNK_SKETCHES rows from rows that are sorted by key, no key in two of them."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < CHUNK_SKETCHES:
            continue
        table = pa.Table.from_batches(held)
        order, starts = _groups(table, keys)
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(order)]))
        last = int(np.flatnonzero(group == group[-1])[0])
        if last:
            yield table.slice(0, last)
        held = table.slice(last).to_batches()
        rows = table.num_rows - last
    if rows:
        yield pa.Table.from_batches(held)


def _merge_once(sketches: DataFrame, keys: list[str]) -> DataFrame:
    schema, _ = _schema(sketches, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_keys((b for b in batches if b.num_rows), keys):
            found = [(at, h, c) for at, levels in _merged(table, keys) for h, c in sorted(levels.items()) if len(c.items)]
            batch = _emit(table.select(keys), found, _arrow(schema))
            if batch is not None:
                yield batch

    own = sketches.select(*keys, "level", "state", "section", "sections", "items")
    return own.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).mapInArrow(run, schema)


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One sketch per key from any number of partial ones, kept in the checkpoint folder.

    Partial sketches of a key merge in a tree: where a key has more than FAN rows they are dealt over lanes of about that
    many, each lane is merged by a task of its own, and so on until one is left. No task reads more rows of a key than
    FAN, nor more than CHUNK_SKETCHES rows at a time.
    """
    lane = "__lane"
    held = keep(sketches.select(*keys, "level", "state", "section", "sections", "items"))
    while True:
        most = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).agg(F.max("__rows")).first()[0] or 0
        if most <= FAN:
            return keep(_merge_once(held, keys))
        lanes = int(np.ceil(most / FAN))  # as many for all keys: keys of few rows only spread
        dealt = held.withColumn(lane, F.pmod(F.xxhash64("items", "level"), F.lit(lanes)).cast("int"))
        merged = keep(_merge_once(dealt, [*keys, lane]).drop(lane))
        if (merged.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) >= most:
            return keep(_merge_once(merged, keys))  # what is left are the levels of few large sketches
        held = merged


def percentiles(merged: DataFrame, keys: list[str], ps: list[float]) -> DataFrame:
    """``keys..., n, percentiles array<double>`` of merged sketches: the least kept value whose estimated rank reaches
    ``ceil(p * n)``. Exact while a group has no more values than a level holds."""
    held = F.array_sort(F.flatten(F.collect_list("pairs")))
    pairs = F.transform("items", lambda x: F.struct(x.alias("x"), F.pow(F.lit(2.0), F.col("level")).cast("bigint").alias("w")))
    grouped = merged.withColumn("pairs", pairs).groupBy(*keys).agg(held.alias("pairs"))
    total = F.aggregate("pairs", F.lit(0).cast("bigint"), lambda s, x: s + x["w"])
    wanted = [F.ceil(F.lit(p) * F.col("n")).cast("bigint") for p in ps]
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.array(*[F.lit(None).cast("double") for _ in ps]).alias("q"))

    def step(s: Column, x: Column) -> Column:
        seen = s["seen"] + x["w"]
        q = F.array(*[F.when(s["q"][i].isNull() & (seen >= w), x["x"]).otherwise(s["q"][i]) for i, w in enumerate(wanted)])
        return F.struct(seen.alias("seen"), q.alias("q"))

    return grouped.withColumn("n", total).select(*keys, "n", F.aggregate("pairs", start, step, lambda s: s["q"]).alias("percentiles"))


PERCENTILES = [0.5, 0.9, 0.95, 0.99, 0.999]


def measured(runs: DataFrame) -> DataFrame:
    """``arm, category, day, metric, value`` of every measured value of every distinct run.

    Rows that repeat a run count once. Null, NaN, infinite and negative values are not measured. Categories are lower
    case without punctuation; null and empty ones are ``unknown``.
    """
    once = runs.select("run_id", "arm", "category", "run_at", "latency_ms", "cost_cents").dropDuplicates()
    plain = F.regexp_replace(F.lower("category"), r"[^\p{L}\p{N}]+", "")
    category = F.when(F.coalesce(plain, F.lit("")) == "", "unknown").otherwise(plain)
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("latency_ms", "cost_cents")])).alias("v")
    long = once.select("arm", category.alias("category"), F.to_date("run_at").alias("day"), values).select("arm", "category", "day", "v.*")
    return long.where((F.col("value") >= 0) & ~F.isnan("value") & (F.col("value") < float("inf")))


def daily_sketches(runs: DataFrame) -> DataFrame:
    """The sketches of every (arm, category, day, metric), the grain from which all longer spans are merged."""
    keys = ["arm", "category", "day", "metric"]
    return merge(sketch(measured(runs), keys, "value"), keys)


#: The scopes of a roll-up, from fine to wide: what each keeps, and the finer scope from which it is merged.
SCOPES = [
    {"arm_category": (("arm", "category"), "arm_category_day"), "arm_day": (("arm", "day"), "arm_category_day"), "category_day": (("category", "day"), "arm_category_day")},
    {"arm": (("arm",), "arm_category"), "category": (("category",), "arm_category"), "day": (("day",), "arm_day")},
    {"all": ((), "arm")},
]


def rollup(daily: DataFrame) -> DataFrame:
    """Percentiles by category, arm, day, their pairs and all three: ``scope, arm, category, day, metric, n, p, value``.

    Every scope is merged from the next finer one, so that the widest reads as many sketches as there are arms.
    """
    nothing = {"arm": F.lit(None).cast("string"), "category": F.lit(None).cast("string"), "day": F.lit(None).cast("date")}
    keys, state = ["scope", "arm", "category", "day", "metric"], ["level", "state", "section", "sections", "items"]
    finer = daily.withColumn("scope", F.lit("arm_category_day")).select(*keys, *state)
    out = finer
    for scopes in SCOPES:
        into = F.explode(F.array(*[
            F.struct(F.lit(scope).alias("to"), F.lit(parent).alias("of"), *[(F.col(c) if c in kept else e).alias(c) for c, e in nothing.items()]) for scope, (kept, parent) in scopes.items()
        ])).alias("s")
        wide = finer.select(into, "scope", "metric", *state).where("s.of = scope").select(F.col("s.to").alias("scope"), "s.arm", "s.category", "s.day", "metric", *state)
        finer = merge(wide, keys)
        out = out.unionByName(finer)
    found = percentiles(out, keys, PERCENTILES)
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col("percentiles")[i].alias("value")) for i, p in enumerate(PERCENTILES)])).alias("q")
    return found.select(*keys, "n", each).select(*keys, "n", "q.*")
