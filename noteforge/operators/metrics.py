"""Measures of spans against gold: exact matches, and recall of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteforge.operators.lines import split_lines
from noteforge.operators.spans import covered_ranges

KEY = ["doc_id", "span_start", "span_end", "label"]


def exact_counts(gold: DataFrame, predicted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., tp, n_predicted, n_gold): distinct spans per document, equal in bounds and label. `by` is among KEY's columns."""
    sides = gold.select(*KEY, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(predicted.select(*KEY, F.lit(0).alias("g"), F.lit(1).alias("p")))
    each = sides.groupBy(*KEY).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return each.groupBy(*(by or [])).agg(total(F.col("g") * F.col("p")).alias("tp"), total(F.col("p")).alias("n_predicted"), total(F.col("g")).alias("n_gold"))


def with_rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and F2 of counts; 0 where the denominator is 0."""
    rate = lambda a, b: F.when(b != 0, a.cast("double") / b).otherwise(F.lit(0.0))
    tp, p, g = F.col("tp"), F.col("n_predicted"), F.col("n_gold")
    return counts.select("*", rate(tp, p).alias("precision"), rate(tp, g).alias("recall"), rate(2 * tp, g + p).alias("f1"), rate(5 * tp, 4 * g + p).alias("f2"))


def rate(metric: str, tp: int, p: int, g: int) -> float:
    """"precision", "recall", "f1" or "f2" of what was found rightly, found, and there; 0 where the denominator is 0."""
    formulas = {"precision": (tp, p), "recall": (tp, g), "f1": (2 * tp, g + p), "f2": (5 * tp, 4 * g + p)}
    if metric not in formulas:
        raise ValueError("unknown metric")
    above, below = formulas[metric]
    return float(above / below) if below else 0.0


def score_spans(gold: list[set], predicted: list[set], metric) -> float:
    """One score of rows of (start, end, label): "precision", "recall", "f1", "f2" or a callable of both lists; a callable must give a finite number."""
    import math
    from numbers import Real

    if len(gold) != len(predicted):
        raise ValueError("as many predicted documents are needed as gold ones")
    if not callable(metric):
        return rate(metric, sum(len(set(a) & set(b)) for a, b in zip(gold, predicted)), sum(len(set(b)) for b in predicted), sum(len(set(a)) for a in gold))
    value = metric(gold, predicted)
    if isinstance(value, bool) or not isinstance(value, Real) or not math.isfinite(value):
        raise ValueError("a metric must give a finite number")
    return float(value)


def gold_characters(docs: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id, pos, label): letters and numerics of gold spans, one row for each character and label."""
    spans = gold.join(docs.select("doc_id", "text"), "doc_id")
    span = F.expr("substring(text, span_start + 1, span_end - span_start)")
    chars = spans.select("doc_id", "span_start", "label", F.posexplode(F.filter(F.split(span, ""), lambda c: c != "")).alias("k", "c"))
    return chars.where(F.col("c").rlike(r"^[\p{L}\p{N}]$")).select("doc_id", (F.col("span_start") + F.col("k")).alias("pos"), "label").distinct()


def character_recall(docs: DataFrame, gold: DataFrame, predicted: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(grp, covered, support, recall): letters and numerics of gold spans that lie in any predicted span, whatever its label; in all (grp "all"), or for
    each group of labels in `groups` (grp, label), whose groups may overlap. A group without support has a null recall."""
    chars = gold_characters(docs, gold)
    ranges = covered_ranges(predicted)
    c, r = chars.alias("c"), ranges.alias("r")
    hit = (F.col("c.doc_id") == F.col("r.doc_id")) & (F.col("r.span_start") <= F.col("c.pos")) & (F.col("c.pos") < F.col("r.span_end"))
    marked = c.join(r, hit, "left").select("c.doc_id", "c.pos", "c.label", F.col("r.doc_id").isNotNull().alias("hit"))
    marked = marked.withColumn("grp", F.lit("all")) if groups is None else marked.join(F.broadcast(groups), "label")
    each = marked.groupBy("grp", "doc_id", "pos").agg(F.max("hit").alias("hit"))
    return each.groupBy("grp").agg(F.count_if("hit").alias("covered"), F.count("*").alias("support")).withColumn("recall", F.try_divide(F.col("covered").cast("double"), F.col("support")))


def residual_lines(docs: DataFrame, gold: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, line_no, is_residual): whether a line holds a letter or numeric of a gold span that no rule span covers."""
    chars = gold_characters(docs, gold).select("doc_id", "pos").distinct()
    c, r = chars.alias("c"), covered_ranges(rules).alias("r")
    missed = c.join(r, (F.col("c.doc_id") == F.col("r.doc_id")) & (F.col("r.span_start") <= F.col("c.pos")) & (F.col("c.pos") < F.col("r.span_end")), "left_anti")
    lines = split_lines(docs).drop("content")
    a, m = lines.alias("a"), missed.alias("m")
    on = (F.col("a.doc_id") == F.col("m.doc_id")) & (F.col("a.line_start") <= F.col("m.pos")) & (F.col("m.pos") < F.col("a.line_end"))
    hit = a.join(m, on, "left_semi").select("doc_id", "line_no", F.lit(True).alias("hit"))
    return lines.join(hit, ["doc_id", "line_no"], "left").select("doc_id", "line_no", F.coalesce("hit", F.lit(False)).alias("is_residual"))


def label_inventory(spans: DataFrame) -> DataFrame:
    """(label, n_spans, n_documents)."""
    return spans.groupBy("label").agg(F.count("*").alias("n_spans"), F.countDistinct("doc_id").alias("n_documents"))


def overlapping_annotations(gold: DataFrame) -> DataFrame:
    """(doc_id, span_start, span_end, next_start): gold spans that reach over the start of the next one of their document. Touching is allowed."""
    from pyspark.sql.window import Window

    following: Column = F.lead("span_start").over(Window.partitionBy("doc_id").orderBy("span_start", "span_end", "label"))
    return gold.withColumn("next_start", following).where("span_end > next_start").select("doc_id", "span_start", "span_end", "next_start")
