"""Routing thresholds within budgets of recall.

A document's state under a threshold depends only on which of its lines reach it, so it has one state for each of its own scores, and one with no line.
All measures of a state are whole numbers: gold characters covered (in all and by group), characters sent, characters selected. The sum over documents at
threshold t is that of the states without lines, plus the changes from state to state of all scores at least t: one `lag` by document, one
aggregation by score and one running sum over the distinct scores, instead of every threshold with every document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noteforge.operators.router import line_bounds, spans_of
from noteforge.operators.rules import unite

#: Largest loss of recall of each profile, as a share (fixed values).
BUDGETS = {"prudent": 0.001, "balanced": 0.005, "fast": 0.010}
SLACK = 1e-12


def pack(text: str, bounds: Sequence[tuple[int, int]], separator: str = "\n") -> tuple[str, list[tuple[int, int, int]]]:
    """Selected lines as one text, with (packed start, packed end, document start) of each run of adjacent lines."""
    if not separator:
        raise ValueError("a separator has at least one character")
    runs: list[list[int]] = []
    for s, e in bounds:
        if not 0 <= s < e <= len(text) or (runs and s < runs[-1][1]):
            raise ValueError("lines must lie in the text, in order, apart")
        if runs and runs[-1][1] == s:
            runs[-1][1] = e
        else:
            runs.append([s, e])
    at, segs = 0, []
    for s, e in runs:
        segs.append((at, at + e - s, s))
        at += e - s + len(separator)
    return separator.join(text[s:e] for s, e in runs), segs


def project(spans: Sequence[tuple[int, int, str]], segs: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """Spans of the packed text in the document; those not within one segment are dropped."""
    return [(s - a + d, e - a + d, label) for s, e, label in spans for a, b, d in segs if a <= s and e <= b]


def route(text: str, rules: Sequence[tuple[int, int, str]], predict: Callable[[list[str]], list], scores: Sequence[float] | None, threshold: float | None) -> tuple[list[tuple[int, int, str]], int, int]:
    """(entities, selected characters, model characters) of one document: the selected lines go to the model as one text, and what it finds is united
    with the rule spans. Without a selected line the model isn't called; without a threshold all lines are selected and scores aren't needed."""
    bounds = line_bounds(text)
    if threshold is not None:
        if scores is None or len(scores) != len(bounds):
            raise ValueError("one score is needed for each line")
        bounds = [b for b, s in zip(bounds, scores) if s >= threshold]
    own = [(*r, 1) for r in rules]
    if not bounds:
        return unite(own), 0, 0
    packed, segs = pack(text, bounds)
    (found,) = predict([packed])
    return unite([(*x, 0) for x in project(found, segs)] + own), sum(e - s for s, e in bounds), len(packed)


def document_states(docs: DataFrame, predict: Callable[[list[str]], list], groups: Mapping[str, Sequence[str]], most: int = 4_000_000) -> DataFrame:
    """(doc_id, state, score, model_chars, selected_chars, covered array<bigint>, support array<bigint>) of documents with `rules`, `entities` and `scores` (in line order): a row for
    each distinct score of a document's lines and one with a null score for no line. covered and support are by group, in order of names.

    Texts of the states of a block of documents go to the model together. A block has up to `most` characters in its states, or is one document.
    """
    names = sorted(groups)
    wanted = [frozenset(groups[n]) for n in names]
    kind = dict(docs.dtypes)["doc_id"]

    def measured(plans: list[tuple], texts: list[str]) -> pd.DataFrame:
        found = predict(texts) if texts else []
        if len(found) != len(texts):
            raise RuntimeError("the model gave another number of documents than it was given")
        rows = []
        for d, t, r, marks, states in plans:
            support = [int(m.sum()) for m in marks]
            for score, chosen, segs, at, sent in states:
                entities = unite([(*x, 0) for x in (project(found[at], segs) if at is not None else [])] + [(*x, 1) for x in r])
                seen = np.zeros(len(t) + 1, bool)
                for s, e, _ in entities:
                    seen[s:e] = True
                rows.append((d, score, sent, sum(e - s for s, e in chosen), [int((m & seen).sum()) for m in marks], support))
        return pd.DataFrame(rows, columns=["doc_id", "score", "model_chars", "selected_chars", "covered", "support"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            plans, texts, size = [], [], 0
            for d, t, r, g, s in zip(b["doc_id"], b["text"], b["rules"], b["entities"], b["scores"]):
                bounds, s = line_bounds(t), [float(x) for x in s]
                if len(s) != len(bounds):
                    raise ValueError("one score is needed for each line")
                marks = [np.zeros(len(t) + 1, bool) for _ in wanted]
                for x, e, label in spans_of(g):
                    for mark, labels in zip(marks, wanted):
                        if label in labels:
                            mark[x:e] = [c.isalnum() for c in t[x:e]]
                states = []
                for score in [*sorted(set(s), reverse=True), None]:
                    chosen = [] if score is None else [x for x, y in zip(bounds, s) if y >= score]
                    packed, segs = pack(t, chosen) if chosen else ("", [])
                    states.append((score, chosen, segs, len(texts) if chosen else None, len(packed)))
                    texts += [packed] if chosen else []
                    size += len(packed)
                plans.append((d, t, spans_of(r), marks, states))
                if size > most:
                    yield measured(plans, texts)
                    plans, texts, size = [], [], 0
            yield measured(plans, texts)

    return docs.select("doc_id", "text", "rules", "entities", "scores").mapInPandas(run, f"doc_id {kind}, score double, model_chars bigint, selected_chars bigint, covered array<bigint>, support array<bigint>")


def _bucket(score: Column) -> Column:
    """A number that grows with a score, from 0 to 2,002: the place of the logistic function's argument, which is between -20 and 20, in steps of a fiftieth. It is the same at each
    evaluation, and scores crowd at neither end of it."""
    inside = F.floor(50 * F.ln(score / (1 - score))).cast("int") + 1001
    return F.when(score <= 0, 0).when(score >= 1, 2002).otherwise(F.greatest(F.lit(1), F.least(F.lit(2001), inside)))


def calibration_points(states: DataFrame, measures: Sequence[str]) -> DataFrame:
    """(threshold, measures...): sums over documents at each distinct score, and at 0 and 1, from states (doc_id, score, measures...) with a null score for no line.

    A document without any state counts as nothing. Sums by score run on within buckets of scores, in parallel, and start at what the buckets above hold, which is
    a running sum over at most 2,004 rows.
    """
    w = Window.partitionBy("doc_id").orderBy(F.col("score").desc_nulls_first())
    change = [(F.col(m) - F.coalesce(F.lag(m).over(w), F.lit(0))).alias(m) for m in measures]
    deltas = states.select(F.coalesce("score", F.lit(float("inf"))).alias("s"), *change).groupBy("s").agg(*(F.sum(m).alias(m) for m in measures))
    ends = states.sparkSession.range(1).select(F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("s"), *(F.lit(0).cast("long").alias(m) for m in measures))
    summed = deltas.unionByName(ends).groupBy("s").agg(*(F.sum(m).alias(m) for m in measures))
    summed = summed.withColumn("bucket", F.when(F.col("s") > 1, 2003).otherwise(_bucket(F.col("s"))))
    above = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bases = summed.groupBy("bucket").agg(*(F.sum(m).alias(m) for m in measures)).select("bucket", *(F.coalesce(F.sum(m).over(above), F.lit(0)).alias(f"{m} above") for m in measures))
    run = Window.partitionBy("bucket").orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    within = summed.select("s", "bucket", *(F.sum(m).over(run).alias(m) for m in measures)).join(F.broadcast(bases), "bucket")
    return within.select(F.col("s").alias("threshold"), *((F.col(m) + F.col(f"{m} above")).alias(m) for m in measures)).where("threshold <= 1")


def choose_thresholds(points: DataFrame, baseline: DataFrame, budgets: DataFrame) -> DataFrame:
    """(profile, threshold, model_chars, selected_chars): for each budget (profile, loss) the threshold that sends the fewest characters to the model (ties: fewest
    selected, then the higher threshold) among those whose recall, in all and in each group, is at most `loss` below the baseline's.

    points (threshold, recall, group_recall map, model_chars, selected_chars); baseline: one row (recall, group_recall). A null map has no groups.
    """
    b = baseline.select(F.col("recall").alias("base"), F.col("group_recall").alias("base_groups"))
    crossed = points.join(F.broadcast(b)).join(F.broadcast(budgets))  # one row, and one for each profile
    most = F.col("loss") + SLACK
    groups = F.forall(F.map_keys("base_groups"), lambda k: F.coalesce(F.col("base_groups")[k] - F.col("group_recall")[k] <= most, F.lit(True)))
    fits = crossed.where((F.col("base") - F.col("recall") <= most) & F.coalesce(groups, F.lit(True)))
    key = F.struct("model_chars", "selected_chars", -F.col("threshold"))
    return fits.groupBy("profile").agg(F.min_by(F.struct("threshold", "model_chars", "selected_chars"), key).alias("x")).select("profile", "x.*")


def calibrate(docs: DataFrame, predict: Callable[[list[str]], list], targets: Sequence[str], groups: Mapping[str, Sequence[str]], budgets: Mapping[str, float] = BUDGETS) -> dict[str, float]:
    """Threshold of each profile on documents with `rules`, `entities` and `scores`; the baseline sends all lines, which is what threshold 0 does."""
    if not groups:
        raise ValueError("groups of labels are needed")
    names = ["", *sorted(groups)]
    states = document_states(docs, predict, {"": targets, **groups})
    flat = states.select("doc_id", "score", "model_chars", "selected_chars", *(F.col("covered")[k].alias(f"c{k}") for k in range(len(names))), *(F.when(F.col("score").isNull(), F.col("support")[k]).otherwise(0).alias(f"n{k}") for k in range(len(names)))).persist()
    try:
        support = flat.agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(len(names)))).first()
        if not all(support):
            raise ValueError("recall is undefined without gold characters")
        points = calibration_points(flat, ["model_chars", "selected_chars", *(f"c{k}" for k in range(len(names)))])
        recall = lambda k: F.col(f"c{k}") / F.lit(float(support[k]))
        by_group = F.map_from_arrays(F.array(*(F.lit(n) for n in names[1:])), F.array(*(recall(k) for k in range(1, len(names)))))
        points = points.select("threshold", recall(0).alias("recall"), by_group.alias("group_recall"), "model_chars", "selected_chars")
        spark = docs.sparkSession
        table = spark.createDataFrame(list(budgets.items()), "profile string, loss double")
        return {r["profile"]: r["threshold"] for r in choose_thresholds(points, points.where("threshold = 0"), table).collect()}
    finally:
        flat.unpersist()
