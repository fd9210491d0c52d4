"""Reading level of each document by a familiar-word formula: the share of words outside lists of frequent words, and the length of sentences.

The lists hold the words of at least a share of the documents of a language, at several shares; they come from the document frequencies of
the whole corpus. A document has the median and the mean over its sentences of the share of words outside each list, and the average, median and
quartile lengths of its sentences. The formula is linear in these, one for each level, with coefficients fitted to rated documents.

Only running text counts: sentences of at least three words; words with digits, and runs of forty or more characters without blanks, are left
out. Medians keep a few headings, standard paragraphs or lines of machine output from moving a document.

Nulls: a null text, or one without a sentence, gets the features of a typical sentence, so a level in the middle of the formula; a null or unknown
language is taken as the one whose most frequent words cover the document best. Ratings that repeat (same document and rater) count once, null ones not at all.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteforge.functions.sampling import smallest_hashes
from noteforge.llm.normalise import fold
from noteforge.llm.shared import written

#: Shares of documents that make a word familiar, list by list.
SHARES = (0.3, 0.2, 0.1, 0.05, 0.02, 0.005)
LEVELS = (1, 2, 3)
#: Runs without blanks that hold a digit or are very long, but for a mark that ends a sentence after them.
_NOISE = re.compile(r"(?<!\S)(?:[^\s\d]*+\d\S*?|\S{40,}?)(?=[.!?;]?(?:\s|\Z))")
_PARTS = re.compile(r"[^\W\d_]+|\n|[.!?;](?=\s)")
_WORD = re.compile(r"[^\W\d_]+")
_ENDS = dict.fromkeys("\n.!?;", -1)


def plain_language(lang: Column) -> Column:
    """The two-letter code, or null."""
    code = F.lower(F.substring(F.trim(lang), 1, 2))
    return F.when(code.rlike("^[a-z]{2}$"), code)


def running_words(text: str | None) -> list[str]:
    """Words of a text outside of noise."""
    return _WORD.findall(_NOISE.sub(" ", fold(text)))


def familiar_words(docs: DataFrame, text: str = "text", lang: Column | None = None, least: int = 20) -> dict[str, dict[str, int]]:
    """For each language of at least `least` documents: word -> number of lists it is in.

    Partitions count before the shuffle. A word of the last list stands in at least a share of the documents, so there are at most as many
    as a document has distinct words on average, divided by that share; no more reach the driver.
    """
    lang = plain_language(F.col("lang")) if lang is None else lang

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = {}
        flush = lambda: pd.DataFrame([(k, w, n) for k, c in seen.items() for w, n in c.items()], columns=["lang", "word", "n"])
        for b in batches:
            for k, x in zip(b["lang"], b["text"]):
                c = seen.setdefault(k, Counter())
                c.update(set(running_words(x)))
                c[""] += 1  # the number of documents
            if sum(map(len, seen.values())) > 300_000:
                yield flush()
                seen.clear()
        yield flush()

    rows = docs.select(lang.alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = written(rows.mapInPandas(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
    n_docs = {r["lang"]: r["n"] for r in counts.where("word = '' AND n >= " + str(least)).collect()}
    if not n_docs:
        return {}
    floor = F.coalesce(*[F.when(F.col("lang") == k, F.lit(SHARES[-1] * n)) for k, n in n_docs.items()])
    out: dict[str, dict[str, int]] = {k: {} for k in n_docs}
    for r in counts.where((F.col("word") != "") & F.col("lang").isin(*n_docs) & (F.col("n") >= floor)).collect():
        out[r["lang"]][r["word"]] = sum(r["n"] >= n_docs[r["lang"]] * s for s in SHARES)
    return out


def _lists_of(parts: list[str], lang: str | None, lists: dict[str, dict[str, int]]) -> dict[str, int]:
    known = lists.get(lang)
    if known is None and lists:
        common = {k: sum(v.get(w, 0) == len(SHARES) for w in parts) for k, v in lists.items()}
        known = lists[max(sorted(common), key=common.get)]
    return known or {}


def features(texts, langs, lists: dict[str, dict[str, int]]) -> np.ndarray:
    """A row of features for each document: logarithms of lengths of sentences (median, mean, quartiles, mean by words), then medians and means of the
    shares of unfamiliar words, list by list."""
    ids, owner = [], []
    for k, (text, lang) in enumerate(zip(texts, langs)):
        parts = _PARTS.findall(_NOISE.sub(" ", fold(text)))
        get = _lists_of(parts, lang, lists).get
        ids += [-1 if p in _ENDS else get(p, 0) for p in parts]
        ids.append(-1)
        owner.append(len(ids))
    out = np.empty((len(owner), 5 + 2 * len(SHARES)))
    out[:, :5], out[:, 5:] = np.log(12.0), 0.3
    x = np.array(ids, np.int8)
    stop = np.flatnonzero(x == -1)
    begin = np.r_[0, stop[:-1] + 1]
    keep = stop - begin >= 3
    begin, stop = begin[keep], stop[keep]
    if not len(begin):
        return out
    doc = np.searchsorted(owner, stop, side="left")
    size = (stop - begin).astype(float)
    above = np.stack([np.r_[0, np.cumsum((x >= 0) & (x < k))] for k in range(1, len(SHARES) + 1)], axis=1)
    unknown = (above[stop] - above[begin]).astype(float)
    there, first, count = np.unique(doc, return_index=True, return_counts=True)
    total = lambda v: np.add.reduceat(v, first, axis=0)

    def ranked(v: np.ndarray) -> np.ndarray:
        return v[np.lexsort((v, doc))]

    def median(v: np.ndarray) -> np.ndarray:
        r = ranked(v)
        return (r[first + (count - 1) // 2] + r[first + count // 2]) / 2

    ordered = ranked(size)
    quarter = lambda q: ordered[first + (q * (count - 1) + 0.5).astype(int)]
    words = total(size)
    out[there, :5] = np.log(np.stack([median(size), words / count, quarter(0.25), quarter(0.75), total(size * size) / words], axis=1))
    out[there, 5 : 5 + len(SHARES)] = np.stack([median(unknown[:, k] / size) for k in range(len(SHARES))], axis=1)
    out[there, 5 + len(SHARES) :] = total(unknown) / words[:, None]
    return out


def fit_formula(x: np.ndarray, y: np.ndarray, rounds: int = 2000, penalty: float = 1e-3) -> dict:
    """Coefficients of a linear formula for each level: x features, y shares of the ratings by level; multinomial logistic regression."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros((z.shape[1], y.shape[1]))
    for _ in range(rounds):
        p = z @ w
        p = np.exp(p - p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= 0.5 * (z.T @ (p - y) / len(z) + penalty * w)
    return {"mean": mean, "scale": scale, "w": w}


def level_of(x: np.ndarray, formula: dict | None) -> np.ndarray:
    """Levels of rows of features. Without any rated document: by average length of sentences, up to 10 words, up to 16, and above."""
    if formula is None:
        return np.digitize(np.exp(x[:, 1]), (10, 16)) + 1
    return (np.c_[(x - formula["mean"]) / formula["scale"], np.ones(len(x))] @ formula["w"]).argmax(1) + 1


def reading_levels(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text: str = "text", lang: Column | None = None, sample: int = 4000, seed: int = 5) -> DataFrame:
    """(id, level, unfamiliar, sentence_words): level of each row; share of words in at most a twentieth of documents; mean length of sentences.

    The formula is fitted on at most `sample` rated documents (the smallest hashes of ids); ratings are (doc_id, rater, level).
    """
    lang = plain_language(F.col("lang")) if lang is None else lang
    lists = familiar_words(docs, text, lang)
    sent = docs.sparkSession.sparkContext.broadcast(lists)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), F.col(text).alias("text"))

    each = ratings.where(F.col("level").isin(*LEVELS) & F.col("doc_id").isNotNull()).select("doc_id", F.lower(F.trim("rater")).alias("rater"), "level").distinct()
    rated = each.groupBy(F.col("doc_id").cast(kind).alias("id")).agg(*(F.avg((F.col("level") == k).cast("double")).alias(f"y{k}") for k in LEVELS))
    rated = smallest_hashes(rated, "id", sample, seed)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": list(features(b["text"], b["lang"], sent.value)), **{f"y{k}": b[f"y{k}"].to_numpy() for k in LEVELS}})

    got = rows.join(F.broadcast(rated), "id").mapInPandas(featured, "x array<double>, " + ", ".join(f"y{k} double" for k in LEVELS)).toPandas()  # at most `sample` rows
    formula = None
    if len(got):
        x = np.stack(got["x"])
        order = np.lexsort(x.T)
        formula = fit_formula(x[order], got[[f"y{k}" for k in LEVELS]].to_numpy()[order])

    def levelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at : at + 1000]
                x = features(part["text"], part["lang"], sent.value)
                yield pd.DataFrame({"id": part["id"].array, "level": level_of(x, formula), "unfamiliar": x[:, 5 + len(SHARES) + 3], "sentence_words": np.exp(x[:, 1])})

    return rows.mapInPandas(levelled, f"id {kind}, level int, unfamiliar double, sentence_words double").withColumnRenamed("id", id_col)
