"""Queries of the operators for text corpora; each runs over its whole tables with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noteforge.functions.layout import spread
from noteforge.llm import mixing, normalise, overlap, packing, pieces, pii, reading

#: File of the tokenizer whose tokens measure texts.
TOKENIZER = os.environ.get("NOTEFORGE_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(_read(spark, folder, "documents"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder).select("doc_id", "split", "text")
    return overlap.overlap_pairs(*overlap.overlaps(docs))


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder).select("doc_id", "split", "source", "text")
    return overlap.overlap_counts(docs, *overlap.overlaps(docs))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.cut_levels(_documents(spark, folder))


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.split_texts(_documents(spark, folder))


def p2_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Of each note: where its pieces begin and end, whether none is too long, and whether each starts within the overlap before the end of the one before it."""
    w = Window.partitionBy("doc_id").orderBy("piece_no")
    rows = p2_pieces(spark, folder).withColumn("before", F.lag("span_end").over(w))
    joined = F.col("before").isNull() | F.col("span_start").between(F.col("before") - pieces.OVERLAP, F.col("before"))
    return rows.groupBy("doc_id").agg(F.min("span_start").alias("first_start"), F.max("span_end").alias("last_end"), F.bool_and(F.col("span_end") - F.col("span_start") <= pieces.LIMIT).alias("within"), F.bool_and(joined).alias("joined"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return normalise.find_unusual(_documents(spark, folder))


def p3_canonical(spark: SparkSession, folder: str) -> DataFrame:
    docs = normalise.canonical_frame(_documents(spark, folder).select("doc_id", "text", "context"))
    return docs.select("doc_id", "canonical_text", F.to_json("canonical_context").alias("canonical_context"), "changed")


def p3_changed(spark: SparkSession, folder: str) -> DataFrame:
    return normalise.canonical_frame(_documents(spark, folder).select("doc_id", "text", "context")).select("doc_id", "changed")


def _unlabelled(spark: SparkSession, folder: str) -> tuple[DataFrame, bytes]:
    docs = _documents(spark, folder).select("doc_id", "text", "entities")
    return docs.where("entities IS NULL"), pii.fit(docs)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_mentions(*_unlabelled(spark, folder))


def p4_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redact(*_unlabelled(spark, folder))


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_texts(_documents(spark, folder), TOKENIZER)


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packing_report(p6_packed(spark, folder))


def p6_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of notes placed, of bins over the capacity, of notes split that would fit, and of pieces that don't start where the one before them in their bin ends."""
    packed = p6_packed(spark, folder)
    w = Window.partitionBy("bin_id").orderBy("bin_offset", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    bins = packed.groupBy("bin_id").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > packing.CAPACITY).alias("n_overfull"))
    notes = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("m")).agg(F.count("*").alias("n_notes"), F.count_if((F.col("n") <= packing.CAPACITY) & (F.col("m") > 1)).alias("n_split"))
    gaps = packed.where("n_tokens > 0").withColumn("room", F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).agg(F.count_if(F.col("room") != F.col("bin_offset")).alias("n_misplaced"))
    return notes.join(bins).join(gaps)  # one row each


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_documents(spark, folder), _read(spark, folder, "mix_targets"), TOKENIZER)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_documents(spark, folder), _read(spark, folder, "mix_targets"), TOKENIZER)[1]


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Of each target: whether its repeats are kept, and whether its share of the mix is the one wanted among sources with notes, to one in a hundred."""
    report = p7_shares(spark, folder)
    wanted = F.when(F.col("n_available") > 0, F.col("target_weight") / F.sum(F.when(F.col("n_available") > 0, F.col("target_weight"))).over(Window.partitionBy())).otherwise(0.0)
    return report.select("source", (F.col("most_used") <= F.col("max_repeats")).alias("repeats_kept"), (F.abs(F.col("actual_share") - wanted) < 0.01).alias("share_reached"))


def p8_levels(spark: SparkSession, folder: str) -> DataFrame:
    return reading.reading_levels(_documents(spark, folder), _read(spark, folder, "labels"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    rated = _read(spark, folder, "labels").select("doc_id").distinct()
    return p8_levels(spark, folder).select("doc_id", "level").join(rated, "doc_id", "left_anti")


def p8_profile(spark: SparkSession, folder: str) -> DataFrame:
    levels = p8_levels(spark, folder).join(_read(spark, folder, "documents").select("doc_id", mixing.plain_source(F.col("source")).alias("source")), "doc_id")
    return levels.groupBy("source", "level").agg(F.count("*").alias("n_documents"), F.avg("sentence_words").alias("mean_sentence_words"), F.avg("unfamiliar").alias("mean_unfamiliar"))


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p2_found, p2_pieces, p2_checks, p3_found, p3_canonical, p3_changed, p4_found, p4_redacted, p6_packed, p6_fill, p6_checks, p7_mix, p7_shares, p7_checks, p8_found, p8_levels, p8_profile)}

_UNUSUAL = r"[\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{fff9}-\x{fffb}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{2010}-\x{2012}\x{58a}\x{1806}\x{ff01}-\x{ffdc}\x{ffe0}-\x{ffee}\x{fb00}-\x{fb06}\x{fb13}-\x{fb17}\x{fb1d}-\x{fb4f}\x{fe50}-\x{fe6b}]"
_MIXED = r"\p{Latin}[\p{L}\p{M}]*[\p{Greek}\p{Cyrillic}\p{Armenian}\p{Hebrew}\p{Arabic}]|[\p{Greek}\p{Cyrillic}\p{Armenian}\p{Hebrew}\p{Arabic}][\p{L}\p{M}]*\p{Latin}"

_UNUSUAL_FIELDS = rf"""
WITH terms AS (SELECT doc_id, unnest(flatten(map_values(context))) AS s FROM documents), fields AS (SELECT doc_id, 'text' AS field, text AS s FROM documents UNION ALL SELECT doc_id, 'context', s FROM terms),
-- joiners and selectors within an emoji are no case
bare AS (SELECT doc_id, field, regexp_replace(s, '[\x{{2190}}-\x{{2bff}}\x{{1f000}}-\x{{1faff}}][\x{{fe0e}}\x{{fe0f}}\x{{1f3fb}}-\x{{1f3ff}}]*(\x{{200d}}[\x{{2190}}-\x{{2bff}}\x{{1f000}}-\x{{1faff}}]\x{{fe0f}}?)*', '', 'g') AS s FROM fields)
SELECT DISTINCT doc_id, field FROM bare WHERE regexp_matches(s, '{_UNUSUAL}') OR nfc_normalize(s) <> s OR regexp_matches(s, '{_MIXED}')"""

ORACLE: dict[str, str] = {
    "p2_found": r"""
SELECT doc_id, CASE WHEN list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) <= 2000 THEN 'line'
  WHEN list_max(list_transform(regexp_split_to_array(text, '[ \t\n]'), lambda x: length(x))) <= 2000 THEN 'word' ELSE 'char' END AS cut_level
FROM documents WHERE length(text) > 2000""",
    "p2_checks": "SELECT doc_id, 0::BIGINT AS first_start, n_chars AS last_end, true AS within, true AS joined FROM documents WHERE text IS NOT NULL",
    "p3_found": _UNUSUAL_FIELDS,
    "p3_changed": f"SELECT doc_id, doc_id IN (SELECT doc_id FROM ({_UNUSUAL_FIELDS})) AS changed FROM documents",
    "p6_checks": "SELECT count(*) AS n_notes, 0::BIGINT AS n_split, 0::BIGINT AS n_overfull, 0::BIGINT AS n_misplaced FROM documents WHERE text IS NOT NULL",
    "p7_checks": "SELECT source, true AS repeats_kept, true AS share_reached FROM mix_targets WHERE source IS NOT NULL AND weight > 0",
}
