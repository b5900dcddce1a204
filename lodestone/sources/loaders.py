"""Documents from files: text and Markdown, JSON and JSON lines, HTML; one row per document.

All loaders give ``doc_id, text, metadata``. A missing id is the SHA-256 of the text, the same in every run. A folder is
read with all its subfolders; endings count whatever their case. Bytes that are no UTF-8 are replaced.
"""

from __future__ import annotations

import os
from collections.abc import Iterable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# The fields that may hold a record's text, in this order.
TEXT_KEYS = ["text", "content", "body", "passage", "answer"]
# Elements without readable text.
SKIPPED = {"script", "style", "noscript", "iframe", "svg", "head", "header", "footer", "nav"}
FORMATS = {"txt": "text", "md": "markdown", "markdown": "markdown", "json": "json", "jsonl": "lines", "html": "html", "htm": "html"}
DOCUMENT = "doc_id string, text string, metadata map<string,string>"


def _glob(ending: str) -> str:
    """A file pattern for an ending in upper or lower case."""
    return "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ending)


def _files(spark: SparkSession, path: str, endings: Iterable[str] = ()) -> DataFrame:
    """``source, filename, ending, size, raw`` of the files under a path, of all endings or the given ones."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if endings:
        reader = reader.option("pathGlobFilter", "{" + ",".join(_glob(e) for e in endings) + "}")
    files = reader.load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.col("path").alias("source"), name.alias("filename"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("ending"), F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("raw"))


def _documents(rows: DataFrame, text: Column, metadata: Column) -> DataFrame:
    return rows.select(text.alias("text"), metadata.alias("metadata")).select(F.sha2("text", 256).alias("doc_id"), "text", "metadata")


def _about(form: Column) -> Column:
    return F.create_map(F.lit("source"), F.col("source"), F.lit("filename"), F.col("filename"), F.lit("format"), form, F.lit("size_bytes"), F.col("size").cast("string"))


def load_text(spark: SparkSession, path: str, endings: Iterable[str] = ()) -> DataFrame:
    """One row per file of text or Markdown."""
    form = F.when(F.col("ending").isin("md", "markdown"), "markdown").otherwise("text")
    return _documents(_files(spark, path, endings), F.col("raw"), _about(form))


def record_text(record: Column) -> Column:
    """The first of the usual text fields of a JSON record that isn't blank, else the record itself."""
    fields = [F.get_json_object(record, f"$.{k}") for k in TEXT_KEYS]
    return F.coalesce(*[F.when(F.trim(f) != "", f) for f in fields], record)


def _records(rows: DataFrame, record: Column, base: Column) -> DataFrame:
    """Documents of JSON records given as text. A string is its own text; of an object the other fields are metadata, and
    its own ones go before those of ``base``. Other values and broken records are none."""
    own = rows.select(F.try_parse_json(record).alias("v"), record.alias("r"), base.alias("base"))
    kind = F.schema_of_variant("v")
    fields = F.coalesce(F.map_filter(F.try_variant_get("v", "$", "map<string,string>"), lambda k, _: ~k.isin(TEXT_KEYS)), F.create_map().cast("map<string,string>"))
    said = own.where(kind.startswith("OBJECT") | (kind == "STRING")).withColumns({"rest": F.when(kind.startswith("OBJECT"), fields).otherwise(F.create_map().cast("map<string,string>")), "plain": kind == "STRING"})
    text = F.when(F.col("plain"), F.try_variant_get("v", "$", "string")).otherwise(record_text(F.col("r")))
    return _documents(said, text, F.map_concat(F.map_filter("base", lambda k, _: ~F.map_contains_key("rest", k)), F.col("rest")))


def load_lines(spark: SparkSession, path: str, endings: Iterable[str] = ()) -> DataFrame:
    """JSON lines, one record each; the files are split among tasks."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if endings:
        reader = reader.option("pathGlobFilter", "{" + ",".join(_glob(e) for e in endings) + "}")
    lines = reader.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("source"))
    return _records(lines, F.col("value"), F.create_map(F.lit("source"), F.col("source")))


def load_json(spark: SparkSession, path: str, endings: Iterable[str] = ()) -> DataFrame:
    """JSON files that hold one record or an array of records, over any number of lines; metadata has the record's index."""
    files = _files(spark, path, endings).withColumn("v", F.try_parse_json("raw"))
    listed = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    each = files.where(F.col("v").isNotNull()).select("source", F.posexplode(listed).alias("index", "x"))
    return _records(each, F.to_json("x"), F.create_map(F.lit("source"), F.col("source"), F.lit("index"), F.col("index").cast("string")))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in SKIPPED

    def handle_endtag(self, tag):
        self.depth -= tag in SKIPPED and self.depth > 0

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.parts.append(data.strip())


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    """The readable text of HTML, one line per text node."""

    def one(h: str | None) -> str | None:
        if h is None:
            return None
        p = _Text()
        p.feed(h)
        p.close()
        return "\n".join(p.parts)

    return html.map(one)


def load_html(spark: SparkSession, path: str, endings: Iterable[str] = ()) -> DataFrame:
    """One row per HTML file, its readable text."""
    return _documents(_files(spark, path, endings), html_text("raw"), _about(F.lit("html")))


LOADERS = {"text": load_text, "markdown": load_text, "json": load_json, "lines": load_lines, "html": load_html}


def load(spark: SparkSession, *paths: str) -> DataFrame:
    """Files and folders of several formats, each format by its own loader. A folder's files of other formats are left
    out; a single file of another format raises ValueError, formats that need an absent library NotImplementedError."""
    out = spark.createDataFrame([], DOCUMENT)
    for path in paths:
        ending = os.path.basename(path.rstrip("/")).rpartition(".")[2].lower() if "." in os.path.basename(path.rstrip("/")) else ""
        if ending in FORMATS:
            out = out.unionByName(LOADERS[FORMATS[ending]](spark, path))
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
        if files.where(~F.rtrim("path", F.lit("/")).endswith("/" + os.path.basename(path.rstrip("/")))).limit(1).count() == 0 and ending:
            raise (NotImplementedError if ending in ("pdf", "docx", "epub", "pptx") else ValueError)(f"no loader for .{ending}")
        for loader in dict.fromkeys(LOADERS.values()):
            out = out.unionByName(loader(spark, path, [e for e, f in FORMATS.items() if LOADERS[f] is loader]))
    return out


def from_texts(spark: SparkSession, source: str | Iterable[str | dict]) -> DataFrame:
    """Documents from memory: one text, or several texts or ``{"text": ..., "metadata": ...}``. A text that is the path of
    an existing file or folder is loaded. Other values raise TypeError."""
    if isinstance(source, str):
        if len(source) < 4096 and "\n" not in source and os.path.exists(source):
            return load(spark, source)
        source = [source]
    rows = []
    for item in source:
        if isinstance(item, str):
            rows.append((item, {}))
        elif isinstance(item, dict) and isinstance(item.get("text"), str):
            rows.append((item["text"], {str(k): str(v) for k, v in item.get("metadata", {}).items()}))
        else:
            raise TypeError(f"no document: {type(item).__name__}")
    return _documents(spark.createDataFrame(rows, "text string, metadata map<string,string>"), F.col("text"), F.col("metadata"))
