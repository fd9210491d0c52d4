"""Annotated documents: JSON Lines in, tokens whose bounds hold all gold bounds, documents from plain texts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noteforge.operators.rejects import decode
from noteforge.operators.spans import tokens

SCHEMA = "doc_id bigint, text string, entities array<struct<start:int,end:int,label:string>>, context map<string,array<string>>"


def annotation_problems(spark: SparkSession, path: str, text_key: str = "text") -> tuple[DataFrame, DataFrame]:
    """(good, bad) of a UTF-8 JSON Lines file or folder: good in SCHEMA plus `path` and `line_no` from 1; bad (path, line_no, reason).

    Large files are read by several tasks. Lines are numbered within their part of the file; numbers of lines of earlier parts are summed up. Blank lines
    are kept and are bad.
    """
    parts = ["path", "block"]
    read = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("raw"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = read.groupBy(*parts).agg(F.count("*").alias("n")).select(*parts, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = read.withColumn("k", F.row_number().over(Window.partitionBy(*parts).orderBy("place"))).join(before, parts)
    lines = numbered.select("path", (F.col("before") + F.col("k")).cast("int").alias("line_no"), "raw")
    if text_key != "text":
        lines = lines.withColumn("raw", _rename(text_key)(F.col("raw")))
    key = F.concat_ws("\u0000", "path", F.lpad(F.col("line_no").cast("string"), 12, "0"))
    decoded = decode(lines.select(key.alias("key"), F.lit("notes_jsonl").alias("feed"), "raw"), "key")
    at = F.split("key", "\u0000")
    rows = decoded.withColumn("path", at[0]).withColumn("line_no", at[1].cast("int"))
    good = rows.where("reason IS NULL").select(F.xxhash64("key").alias("doc_id"), "text", "entities", "context", "path", "line_no")
    return good, rows.where("reason IS NOT NULL").select("path", "line_no", "reason")


def _rename(text_key: str):
    @F.pandas_udf("string")
    def run(raw: pd.Series) -> pd.Series:
        def one(x):
            try:
                value = json.loads(x)
            except (ValueError, TypeError):
                return x
            if isinstance(value, dict):
                value["text"] = value.get(text_key)
                return json.dumps(value)
            return x

        return raw.map(one)

    return run


def read_annotations(spark: SparkSession, path: str, text_key: str = "text") -> DataFrame:
    """Annotated documents of a JSON Lines file, in SCHEMA; raises ValueError with path, line and reason of the first bad line, or if there is no line."""
    good, bad = annotation_problems(spark, path, text_key)
    first = bad.orderBy("path", "line_no").limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['path']}:{first[0]['line_no']}: {first[0]['reason']}")
    if good.isEmpty():
        raise ValueError(f"{path}: no documents")
    return good.select("doc_id", "text", "entities", "context")


def documents_from_texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Documents without annotations or context, numbered from 0."""
    return spark.createDataFrame([(k, t, None, None) for k, t in enumerate(texts)], SCHEMA)


def refined_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, token_no, token_start, token_end): stretches between neighbouring places among the ends of the text, of tokens and of gold spans, so that spans begin and end
    with them even inside a word."""
    ends = tokens(docs).select("doc_id", F.col("token_end").alias("p"))
    gold = docs.select("doc_id", F.explode("entities").alias("e")).select("doc_id", F.explode(F.array("e.start", "e.end")).alias("p"))
    start = docs.where("text IS NOT NULL").select("doc_id", F.lit(0).alias("p"))
    places = ends.unionByName(gold).unionByName(start).where("p IS NOT NULL").distinct()
    w = Window.partitionBy("doc_id").orderBy("p")
    pairs = places.select("doc_id", (F.row_number().over(w) - 1).alias("token_no"), F.col("p").alias("token_start"), F.lead("p").over(w).alias("token_end"))
    return pairs.where("token_end IS NOT NULL")
