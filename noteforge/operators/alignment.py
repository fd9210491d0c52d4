"""Gold spans on the tokens of a model.

Blanks at the ends of a span are cut off; a span of blanks only is an error in `align_gold` and gone in `aligned_gold`. Bounds inside a token are widened to the
token. Where widened spans overlap they are united, with the label of the one of most tokens (ties: the leftmost, then the first given).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noteforge.operators.spans import longest_first, touched_tokens


def _widened(text: str, tokens: Sequence[tuple[int, int]], spans: Sequence[tuple[int, int, str]]) -> list[tuple[int, int, int, str]]:
    """(first token, token after the last, place in the order given, label) of each span."""
    out = []
    for k, (s, e, label) in enumerate(spans):
        piece = text[s:e]
        s, e = s + len(piece) - len(piece.lstrip()), e - len(piece) + len(piece.rstrip())
        if s >= e:
            raise ValueError("a gold span holds nothing but blanks")
        touched = [i for i, (a, b) in enumerate(tokens) if a < e and s < b]
        if not touched:
            raise ValueError(f"a gold span has no token: {s}:{e}")
        out.append((touched[0], touched[-1] + 1, k, label))
    return out


def align_gold(text: str, tokens: Sequence[tuple[int, int]], spans: Sequence[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Disjoint spans on token bounds."""
    groups: list[list] = []
    for x in sorted(_widened(text, tokens, spans)):
        if groups and x[0] < max(y[1] for y in groups[-1]):
            groups[-1].append(x)
        else:
            groups.append([x])
    return [(tokens[min(x[0] for x in g)][0], tokens[max(x[1] for x in g) - 1][1], min(g, key=lambda x: (x[0] - x[1], x[0], x[2]))[3]) for g in groups]


def overlapping_and_longest(text: str, tokens: Sequence[tuple[int, int]], spans: Sequence[tuple[int, int, str]]) -> tuple[list, list]:
    """All widened spans, and the subset that stays when the longest are taken first and none overlaps: what nested and flat targets train on."""
    wide = _widened(text, tokens, spans)
    every = [(tokens[a][0], tokens[b - 1][1], label) for a, b, _, label in wide]
    return every, [every[k] for k in longest_first([(a, b) for a, b, _, _ in wide])]


def aligned_gold(docs: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id, span_start, span_end, label) of all documents; the order given is that of offsets, then of labels."""
    text = gold.join(docs.select("doc_id", "text"), "doc_id").withColumn("piece", F.expr("substring(text, span_start + 1, span_end - span_start)"))
    lead, kept = F.length("piece") - F.length(F.regexp_replace("piece", r"(?U)^\s+", "")), F.length(F.regexp_replace("piece", r"(?U)^\s+|\s+$", ""))
    cut = text.where(kept > 0).select("doc_id", (F.col("span_start") + lead).alias("a"), (F.col("span_start") + lead + kept).alias("b"), "span_start", "span_end", "label")
    wide = touched_tokens(cut, docs, "a", "b").select("doc_id", "span_start", "span_end", "label", F.col("first").alias("s"), F.col("last").alias("e"), F.col("n_tokens").alias("n"))
    w = Window.partitionBy("doc_id").orderBy("s", "e", "span_start", "span_end", "label")
    marked = wide.withColumn("new", F.when(F.col("s") < F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1))
    islands = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.struct(-F.col("n"), "s", "span_start", "span_end", "label")
    return islands.groupBy("doc_id", "island").agg(F.min("s").alias("span_start"), F.max("e").alias("span_end"), F.min_by("label", best).alias("label")).drop("island")
