"""Spans: union of overlaps, trimming, alignment to tokens, overlap with lines, coverage.

spans (doc_id, span_start, span_end, label, source); source 0 stands for the model, 1 for rules. Spans with null or impossible offsets or a null or empty label
are no spans (`valid_spans`). Where a document has none, it has no row in the results.
"""

from __future__ import annotations

import re
import string

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noteforge.functions.text import alnum_count

#: Other spellings of labels (fixed values).
LABEL_ALIASES = {"EMAIL": "MAIL", "TELEPHONE": "TEL"}
#: Labels known to identify a patient (fixed values).
IDENTIFIERS = ("ADRESSE", "DATE", "DATE_NAISSANCE", "IPP", "MAIL", "NDA", "NOM", "PRENOM", "SECU", "TEL", "VILLE", "ZIP")


def plain_label(label: Column) -> Column:
    """One spelling of a label."""
    x = F.upper(F.trim(label))
    for a, b in LABEL_ALIASES.items():
        x = F.when(x == a, b).otherwise(x)
    return x


def gold_spans(docs: DataFrame, entities: str = "entities") -> DataFrame:
    """(doc_id, span_start, span_end, label) of annotated documents, labels in one spelling; null and empty annotations give no rows."""
    e = docs.select("doc_id", F.explode(entities).alias("e"))
    return e.select("doc_id", F.col("e.start").alias("span_start"), F.col("e.end").alias("span_end"), plain_label(F.col("e.label")).alias("label"))


def valid_spans(spans: DataFrame) -> DataFrame:
    """Spans delivered twice (same span_id) once, labels in one spelling, without impossible ones."""
    once = spans.dropDuplicates(["span_id"]) if "span_id" in spans.columns else spans
    good = (F.col("span_start") >= 0) & (F.col("span_end") > F.col("span_start")) & (F.length("label") > 0)
    return once.withColumn("label", plain_label(F.col("label"))).where(good)


def merge_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, span_start, span_end, label): overlapping spans united, so that no covered character is lost. Spans that only touch stay apart.

    The union has the label of its longest span; of those the leftmost, then the model's before a rule's, then the first label by name. A span starts
    a union if no span that starts before it reaches over its start; the union's key is that start, so equal spans can't part. One
    exchange by document serves the windows and the aggregation.
    """
    w = Window.partitionBy("doc_id").orderBy("span_start")
    reach = F.max("span_end").over(w.rangeBetween(Window.unboundedPreceding, -1))
    marked = spans.select("doc_id", "span_start", "span_end", "label", "source").withColumn("first", F.when(F.col("span_start") < reach, None).otherwise(F.col("span_start")))
    islands = marked.withColumn("island", F.max("first").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    best = F.struct(-(F.col("span_end") - F.col("span_start")), "span_start", "source", "label")
    return islands.groupBy("doc_id", "island").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"), F.min_by("label", best).alias("label")).drop("island")


_ALL = "".join("\\" + c for c in string.punctuation)


def _trim_pattern(lead: str, tail: str) -> str:
    return rf"(?s)^([\s{lead}]*)(.*?)[\s{tail}]*$"


def _without(chars: str) -> str:
    return "".join("\\" + c for c in string.punctuation if c not in chars)


#: By label: what is cut off at the start and at the end. TEL keeps a leading + or (, PRENOM a final dot.
TRIMS = {"TEL": _trim_pattern(_without("+("), _ALL), "PRENOM": _trim_pattern(_ALL, _without(".")), "": _trim_pattern(_ALL, _ALL)}


def trim_spans(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans of documents without blanks and punctuation at their ends (by label, see TRIMS); those of nothing else are dropped."""
    joined = spans.join(docs.select("doc_id", "text"), "doc_id").withColumn("piece", F.expr("substring(text, span_start + 1, span_end - span_start)")).drop("text")
    pick = lambda g: F.when(F.col("label") == "TEL", F.regexp_extract("piece", TRIMS["TEL"], g)).when(F.col("label") == "PRENOM", F.regexp_extract("piece", TRIMS["PRENOM"], g)).otherwise(F.regexp_extract("piece", TRIMS[""], g))
    blank = F.regexp_replace("piece", rf"[ \n{_ALL}]+", "") == ""
    cut = joined.where(~blank).withColumn("lead", F.length(pick(1))).withColumn("kept", F.length(pick(2)))
    start = F.col("span_start") + F.col("lead")
    return cut.where("kept > 0").withColumn("span_start", start).withColumn("span_end", F.col("span_start") + F.col("kept")).select(*spans.columns)


#: Tokens: runs of digits, runs of letters with their marks, line feeds, runs of other blanks, single other characters.
TOKEN_PATTERN = r"\p{Nd}+|\p{L}[\p{L}\p{M}]*|\n|[\s&&[^\n]]+|."
TOKEN = re.compile(r"\d+|[^\W\d_]+|\n|[^\S\n]+|.", re.DOTALL)


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, token_no, token_start, token_end, token) of all texts. Offsets are running sums by document, whose exchange later joins by document share."""
    rows = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s){TOKEN_PATTERN}"), F.lit(0))).alias("token_no", "token"))
    end = F.sum(F.length("token")).over(Window.partitionBy("doc_id").orderBy("token_no").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return rows.withColumn("token_end", end).select("doc_id", "token_no", (F.col("token_end") - F.length("token")).alias("token_start"), "token_end", "token")


_TOKEN = regex.compile(r"(?s)\p{Nd}+|\p{L}[\p{L}\p{M}]*|\n|[ \t\x0b\f\r]+|.")


def touched_tokens(spans: DataFrame, docs: DataFrame, start: str = "span_start", end: str = "span_end") -> DataFrame:
    """Distinct `spans` with `first` and `last`, the bounds of the tokens they touch, and `n_tokens`, their number; spans that touch none are left out.

    Only documents with spans are read, each once, and its spans are found among its tokens by bisection: nothing is joined token by token.
    """
    rest = [c for c in spans.columns if c != "doc_id"]

    @F.pandas_udf("array<struct<first:int,last:int,n_tokens:int>>")
    def find(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for t, a, b in zip(text, starts, ends):
            begins = np.array([m.start() for m in _TOKEN.finditer(t or "")], np.int64)
            stops = np.r_[begins[1:], len(t or "")]
            i, j = np.searchsorted(begins, a, side="right") - 1, np.searchsorted(begins, b, side="left") - 1
            out.append([{"first": begins[x], "last": stops[y], "n_tokens": y - x + 1} if 0 <= x <= y and stops[x] > s else None for x, y, s in zip(i.tolist(), j.tolist(), a)])
        return pd.Series(out)

    grouped = spans.groupBy("doc_id").agg(F.collect_set(F.struct(*rest)).alias("s")).join(docs.select("doc_id", "text"), "doc_id")
    found = grouped.withColumn("t", find.asNondeterministic()("text", F.transform("s", lambda x: x[start]), F.transform("s", lambda x: x[end])))
    rows = found.select("doc_id", F.explode(F.arrays_zip("s", "t")).alias("z")).where("z.t IS NOT NULL")
    return rows.select("doc_id", *(F.col(f"z.s.{c}") for c in rest), "z.t.first", "z.t.last", "z.t.n_tokens").select(*spans.columns, "first", "last", "n_tokens")


def align_spans(spans: DataFrame, docs: DataFrame, mode: str = "expand") -> DataFrame:
    """Distinct spans on token bounds. "expand": widened to the tokens they touch; "strict": only those that begin and end with tokens, as they are."""
    if mode not in ("expand", "strict"):
        raise ValueError("mode is 'expand' or 'strict'")
    ends = touched_tokens(spans, docs)
    if mode == "strict":
        return ends.where((F.col("first") == F.col("span_start")) & (F.col("last") == F.col("span_end"))).select(*spans.columns)
    return ends.withColumn("span_start", F.col("first")).withColumn("span_end", F.col("last")).select(*spans.columns)


def line_span_overlaps(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, line_no, span_start, span_end, label): every line with every span that shares a character with it."""
    a, s = lines.alias("a"), spans.alias("s")
    meet = (F.col("a.doc_id") == F.col("s.doc_id")) & (F.col("s.span_start") < F.col("a.line_end")) & (F.col("a.line_start") < F.col("s.span_end"))
    return a.join(s, meet).select("a.doc_id", "a.line_no", "s.span_start", "s.span_end", "s.label")


def covered_ranges(spans: DataFrame) -> DataFrame:
    """(doc_id, span_start, span_end): the characters of all spans as disjoint ranges, so that none is counted twice."""
    return merge_spans(spans.withColumn("source", F.lit(0)) if "source" not in spans.columns else spans).select("doc_id", "span_start", "span_end")


def rule_coverage(lines: DataFrame, rule_spans: DataFrame) -> DataFrame:
    """(doc_id, line_no, n_rules, rules, covered, alnum, coverage_bucket) of every line: number of rule spans on it (at most 8 counted), their distinct labels in order,
    letters and numerics they cover, all of them, and the tenths covered, rounded half to even."""
    hits = line_span_overlaps(lines, rule_spans).groupBy("doc_id", "line_no").agg(F.least(F.lit(8), F.count("*")).cast("int").alias("n_rules"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("rules"))
    a, c = lines.alias("a"), covered_ranges(rule_spans).alias("c")
    meet = (F.col("a.doc_id") == F.col("c.doc_id")) & (F.col("c.span_start") < F.col("a.line_end")) & (F.col("a.line_start") < F.col("c.span_end"))
    low, high = F.greatest("a.line_start", "c.span_start"), F.least("a.line_end", "c.span_end")
    piece = F.substring(F.col("a.content"), low - F.col("a.line_start") + 1, high - low)
    covered = a.join(c, meet).groupBy("a.doc_id", "a.line_no").agg(F.sum(alnum_count(piece)).cast("int").alias("covered"))
    out = lines.select("doc_id", "line_no", alnum_count(F.col("content")).alias("alnum")).join(hits, ["doc_id", "line_no"], "left").join(covered, ["doc_id", "line_no"], "left")
    out = out.na.fill({"n_rules": 0, "covered": 0, "rules": ""})
    tenths = F.least(F.lit(10), F.bround(10.0 * F.col("covered") / F.greatest(F.lit(1), F.col("alnum")), 0).cast("int"))
    return out.select("doc_id", "line_no", "n_rules", "rules", "covered", "alnum", tenths.alias("coverage_bucket"))


def longest_first(spans: list[tuple[int, int]]) -> list[int]:
    """Places of the spans kept when the longest are taken first (ties: leftmost, then given first) and those that overlap one already taken are left out."""
    taken: list[tuple[int, int]] = []
    keep = []
    for k in sorted(range(len(spans)), key=lambda k: (spans[k][0] - spans[k][1], spans[k][0], k)):
        s, e = spans[k]
        if all(e <= a or b <= s for a, b in taken):
            taken.append((s, e))
            keep.append(k)
    return sorted(keep)
