"""Prepared corpora, question sets and results: what is read before a run and written after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.functions.text import slug

ENTITY = "id string, name string, type string, summary string"
EDGE = "src string, dst string, type string, predicate string"
CHUNK = "id string, text string, entity_id string, mentions array<string>"
QUESTION = "qid string, question string, answer string, aliases array<string>, supporting array<struct<title string, sent int>>"
PARAGRAPH = "id string, question string, answer string, answer_aliases array<string>, paragraphs array<struct<idx int, title string, paragraph_text string, is_supporting boolean>>"


def load_corpus(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables ``entities``, ``edges`` and ``chunks`` of a prepared corpus (two JSON files and one of JSON lines)."""
    whole = spark.read.option("multiLine", "true")
    return {
        "entities": whole.schema(ENTITY).json(f"{folder}/entities.json"), "edges": whole.schema(EDGE).json(f"{folder}/edges.json"),
        "chunks": spark.read.schema(CHUNK).json(f"{folder}/chunks.jsonl"),
    }


def chunk_ids(title: Column, index: Column) -> Column:
    """The ids of a prepared corpus: ``doc_<slug of the title>_chunk_<index>``."""
    return F.concat(F.lit("doc_"), slug(title), F.lit("_chunk_"), index.cast("string"))


def passage_ids(entity_id: Column, passage_id: Column, doc_id: Column, own: Column) -> Column:
    """The id of a passage: the first that is given of its entity, passage, document and own id."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in (entity_id, passage_id, doc_id, own)])


def write_corpus(entities: DataFrame, edges: DataFrame, chunks: DataFrame, folder: str) -> DataFrame:
    """Append to a corpus what it lacks, and return ``table, rows`` of what was added.

    Chunks of documents (``entity_id``) that were written before are left out by an anti-join, so that a run that broke
    off goes on where it stopped; edges are distinct by ends and predicate.
    """
    spark = chunks.sparkSession
    keys = {"entities": ["id"], "edges": ["src", "predicate", "dst"], "chunks": ["entity_id"]}
    counts = []
    for name, rows in (("entities", entities), ("edges", edges), ("chunks", chunks)):
        rows = rows if name == "chunks" else rows.dropDuplicates(keys[name])
        known = _known(spark, f"{folder}/{name}", rows.schema)
        fresh = rows if known is None else rows.join(known.select(*keys[name]).distinct(), keys[name], "left_anti")
        before = 0 if known is None else known.count()
        fresh.select(*rows.columns).write.mode("append").parquet(f"{folder}/{name}")
        counts.append((name, spark.read.parquet(f"{folder}/{name}").count() - before))
    return spark.createDataFrame(counts, "table string, rows bigint")


def _known(spark: SparkSession, path: str, schema) -> DataFrame | None:
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files)
    return spark.read.schema(schema).parquet(path) if exists else None


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """The raw records of a question set, ``record`` as JSON: lines, an array, or an object with ``queries``."""
    if path.lower().endswith(".jsonl"):
        return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("record"))
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$.queries", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    return whole.select(F.explode(listed).alias("x")).select(F.to_json("x").alias("record"))


def normalize_questions(records: DataFrame, dialect: str) -> DataFrame:
    """``qid, question, answer, aliases, supporting`` from records (``record``) of one of three dialects.

    ``paragraphs``: paragraphs with flags, each supporting one becomes (title, 0). ``evidence`` and ``common``: supporting
    facts as pairs of title and sentence. Other dialects raise ValueError.
    """
    if dialect == "paragraphs":
        r = records.select(F.from_json("record", PARAGRAPH).alias("r")).select("r.*")
        supporting = F.transform(F.filter(F.coalesce("paragraphs", F.array()), lambda p: p["is_supporting"]), lambda p: F.struct(p["title"].alias("title"), F.lit(0).alias("sent")))
        return r.select(F.col("id").alias("qid"), "question", "answer", F.coalesce("answer_aliases", F.array().cast("array<string>")).alias("aliases"), supporting.alias("supporting"))
    if dialect not in ("evidence", "common"):
        raise ValueError(f"no dialect {dialect}")
    r = records.select(F.from_json("record", "_id string, question string, answer string, supporting_facts array<array<string>>").alias("r")).select("r.*")
    facts = F.transform(F.coalesce("supporting_facts", F.array()), lambda f: F.struct(F.get(f, 0).alias("title"), F.get(f, 1).cast("int").alias("sent")))
    return r.select(F.col("_id").alias("qid"), "question", "answer", F.array().cast("array<string>").alias("aliases"), facts.alias("supporting"))


def write_results(rows: DataFrame, folder: str, fields: tuple[str, ...] = ("em", "f1")) -> DataFrame:
    """Write the rows of a run (``qid`` and scores) and a summary with the count and the mean of each field; returns the
    summary. Rows of a run that goes on are appended."""
    rows.write.mode("append").json(f"{folder}/per_question")
    spark = rows.sparkSession
    every = spark.read.schema(rows.schema).json(f"{folder}/per_question")
    summary = every.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in fields])
    summary.write.mode("overwrite").json(f"{folder}/summary")
    return summary


def resume(questions: DataFrame, done: DataFrame | None, key: str = "qid", fields: tuple[str, ...] = ("em", "f1")) -> tuple[DataFrame, DataFrame]:
    """The questions that a broken run still lacks, and the sums of its scores so far; all of them, and zeros, without one."""
    if done is None:
        return questions, questions.sparkSession.range(1).select(*[F.lit(0.0).alias(f) for f in fields])
    totals = done.agg(*[F.coalesce(F.sum(F.col(f).cast("double")), F.lit(0.0)).alias(f) for f in fields])
    return questions.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti"), totals
