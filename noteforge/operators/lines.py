"""Physical lines: splitting, selection by score, packing into one text, projection of spans back to the document.

documents (doc_id, text, ...); lines (doc_id, line_no, line_start, line_end, content); segments (doc_id, seg_no, packed_start, packed_end,
document_start). Offsets are code points, ends exclusive. A null or empty text has no lines. Ids must be unique for what groups by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noteforge.functions.text import running_sums

SEPARATOR = "\n"


def line_array(text: Column) -> Column:
    """Lines of a text, each with its line feed; nothing after a last line feed."""
    return F.regexp_extract_all(text, F.lit("[^\\n]*\\n|[^\\n]+"), F.lit(0))


def split_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line_no, line_start, line_end, content) of all documents, without a shuffle: offsets are sums within the array of lines."""
    parts = docs.select("doc_id", line_array(F.col(text)).alias("parts"))
    ends = running_sums(F.transform("parts", lambda p: F.length(p).cast("long")))
    rows = parts.select("doc_id", F.posexplode(F.arrays_zip(F.col("parts").alias("content"), ends.alias("line_end"))).alias("line_no", "z"))
    end = F.col("z.line_end").cast("int")
    return rows.select("doc_id", "line_no", (end - F.length("z.content")).alias("line_start"), end.alias("line_end"), F.col("z.content").alias("content"))


def latest_scores(scores: DataFrame) -> DataFrame:
    """(doc_id, line_no, score): the score loaded last of each line (ties: scored last, then the larger); null and NaN scores are left out first."""
    good = scores.where(F.col("score").isNotNull() & ~F.isnan("score"))
    return good.groupBy("doc_id", "line_no").agg(F.max_by("score", F.struct("loaded_at", "scored_at", "score")).alias("score"))


def select_lines(lines: DataFrame, scores: DataFrame | None, threshold: float | None) -> DataFrame:
    """Lines whose score reaches the threshold; without a threshold all lines, whatever the scores."""
    if threshold is None:
        return lines
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("a threshold lies between 0 and 1")
    return lines.join(scores.where(F.col("score") >= threshold).select("doc_id", "line_no"), ["doc_id", "line_no"], "left_semi")


def _runs(selected: DataFrame, text: bool) -> DataFrame:
    """Runs of adjacent lines: (doc_id, run, run_start, run_end), and their `chunk` of text if asked for."""
    w = Window.partitionBy("doc_id").orderBy("line_start")
    new = F.when(F.col("line_start") == F.lag("line_end").over(w), 0).otherwise(1)
    numbered = selected.select("doc_id", "line_start", "line_end", *(["content"] if text else [])).withColumn("new", new)
    numbered = numbered.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    chunk = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "content"))), lambda x: x["content"]), "").alias("chunk")
    return numbered.groupBy("doc_id", "run").agg(F.min("line_start").alias("run_start"), F.max("line_end").alias("run_end"), *([chunk] if text else []))


def segments(selected: DataFrame, separator: str = SEPARATOR) -> DataFrame:
    """(doc_id, seg_no, packed_start, packed_end, document_start): where runs of adjacent lines stand in the packed text of a document."""
    if not separator:
        raise ValueError("a separator has at least one character")
    runs = _runs(selected, text=False)
    w = Window.partitionBy("doc_id").orderBy("run")
    length = F.col("run_end") - F.col("run_start")
    before = F.coalesce(F.sum(length + len(separator)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return runs.select("doc_id", (F.row_number().over(w) - 1).alias("seg_no"), before.alias("packed_start"), (before + length).alias("packed_end"), F.col("run_start").alias("document_start"))


def pack_lines(selected: DataFrame, separator: str = SEPARATOR) -> DataFrame:
    """(doc_id, packed_text, n_segments, selected_characters, model_characters): the selected lines of each document as one text, runs of adjacent lines
    apart by the separator. A document without a selected line has no row."""
    ordered = F.array_sort(F.collect_list(F.struct("run", "chunk")))
    packed = _runs(selected, text=True).groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["chunk"]), separator).alias("packed_text"), F.count("*").cast("int").alias("n_segments"), F.sum(F.col("run_end") - F.col("run_start")).cast("int").alias("selected_characters"))
    return packed.withColumn("model_characters", F.length("packed_text"))


def project_spans(spans: DataFrame, segs: DataFrame) -> DataFrame:
    """Spans in packed offsets moved to the document. A span that touches a separator or crosses a gap lies in no segment and is dropped."""
    s, g = spans.alias("s"), segs.alias("g")
    inside = (F.col("s.doc_id") == F.col("g.doc_id")) & (F.col("g.packed_start") <= F.col("s.span_start")) & (F.col("s.span_end") <= F.col("g.packed_end"))
    shift = F.col("g.document_start") - F.col("g.packed_start")
    rest = [F.col(f"s.{c}") for c in spans.columns if c not in ("doc_id", "span_start", "span_end")]
    return s.join(g, inside).select("s.doc_id", (F.col("s.span_start") + shift).alias("span_start"), (F.col("s.span_end") + shift).alias("span_end"), *rest)


def spans_in_segments(spans: DataFrame, segs: DataFrame) -> DataFrame:
    """Document spans in packed offsets, for those that lie within one segment."""
    s, g = spans.alias("s"), segs.alias("g")
    inside = (F.col("s.doc_id") == F.col("g.doc_id")) & (F.col("g.document_start") <= F.col("s.span_start")) & (F.col("s.span_end") <= F.col("g.document_start") + F.col("g.packed_end") - F.col("g.packed_start"))
    shift = F.col("g.packed_start") - F.col("g.document_start")
    rest = [F.col(f"s.{c}") for c in spans.columns if c not in ("doc_id", "span_start", "span_end")]
    return s.join(g, inside).select("s.doc_id", (F.col("s.span_start") + shift).alias("span_start"), (F.col("s.span_end") + shift).alias("span_end"), *rest)
