"""Personal information inside free text: found by a character-level BiLSTM-CRF trained on labelled spans, replaced by typed placeholders.

Nulls: a note with a null or empty text has no mentions and keeps its text; a note whose spans are null is not labelled and is no training
example; null or unknown labels of spans are ignored. Repeated rows get equal results each. Texts of any length are read whole, in
windows that overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteforge.functions.sampling import smallest_hashes
from noteforge.llm.crf_tagger import Tagger, char_ids

LABELS = ("ADRESSE", "IPP", "MAIL", "NDA", "NOM", "PRENOM", "SECU", "TEL", "VILLE", "ZIP")
#: Other spellings of labels (fixed values).
ALIASES = {"EMAIL": "MAIL", "TELEPHONE": "TEL"}
FOUND = "span_start int, span_end int, label string"


def gold_spans(entities, labels=LABELS) -> list[tuple[int, int, str]]:
    """Spans with a known label, in one spelling."""
    out = []
    for e in entities if entities is not None else ():
        label = (e.get("label") or "").strip().upper()
        label = ALIASES.get(label, label)
        if label in labels and e.get("start") is not None and e.get("end") is not None:
            out.append((e["start"], e["end"], label))
    return out


def training_windows(notes: list[tuple[str, list[tuple[int, int, str]]]], labels=LABELS, size: int = 160, step: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """All windows of notes as character ids and tags; of a mention cut by the start of a window, the rest is blanked."""
    ids, tags = [np.zeros((0, size), np.uint8)], [np.zeros((0, size), np.int16)]
    for text, spans in notes:
        starts = range(0, max(1, len(text) - size + step), step)
        x, y = np.zeros(starts[-1] + size, np.uint8), np.zeros(starts[-1] + size, np.int16)
        x[: len(text)] = char_ids(text)
        for s, e, label in spans:
            k = 2 * labels.index(label) + 1
            y[s:e], y[s : s + 1] = k + 1, k
        at = np.array(starts)[:, None] + np.arange(size)
        a, b = x[at], y[at]
        for row in np.flatnonzero((b[:, 0] > 0) & (b[:, 0] % 2 == 0)):
            end = int(np.argmin(np.r_[b[row], -1] == b[row, 0]))
            a[row, :end], b[row, :end] = 0, 0
        ids.append(a)
        tags.append(b)
    return np.concatenate(ids), np.concatenate(tags)


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", entities: str = "entities", sample: int = 4000, steps: int = 800, hidden: int = 16, seed: int = 7) -> bytes:
    """Weights of a tagger, trained in one task on `sample` labelled notes (those with the smallest hashes of their ids).

    `sample` and `steps` bound the work of training; what the sample holds depends on the rows only, and training draws from all windows of its
    notes, evenly. Without any labelled note the tagger finds nothing.
    """
    labelled = docs.where(F.col(entities).isNotNull() & (F.length(text) > 0)).select(F.col(id_col).alias("i"), F.col(text).alias("text"), F.to_json(entities).alias("entities"))
    notes = smallest_hashes(labelled, "i", sample, seed).select("text", "entities").coalesce(1)

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        rows = [(t, gold_spans(json.loads(e))) for b in batches for t, e in zip(b["text"], b["entities"])]
        ids, tags = training_windows(rows)
        tagger = Tagger(list(LABELS), hidden, seed)
        if len(ids):
            tagger.fit(ids, tags, steps, min(96, len(ids)), seed=seed)
        else:
            tagger.p["out"][:], tagger.p["bias"][1:] = 0, -50
        yield pd.DataFrame({"weights": [tagger.dump()]})

    got = notes.mapInPandas(train, "weights binary").collect()
    if got:
        return bytes(got[0]["weights"])
    tagger = Tagger(list(LABELS), hidden, seed)
    tagger.p["out"][:], tagger.p["bias"][1:] = 0, -50
    return tagger.dump()


_LOADED: dict[int, Tagger] = {}


def _tag(weights, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Spans of texts; the weights are unpacked once a process."""
    key = weights.id if hasattr(weights, "id") else id(weights)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tagger.load(weights.value)
    return _LOADED[key].tag(texts)


def whole_words(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans widened over letters that continue a word at either end, never over another span; blank ends cut off, empty ones dropped."""
    out, floor = [], 0
    for k, (s, e, label) in enumerate(spans):
        roof = spans[k + 1][0] if k + 1 < len(spans) else len(text)
        while s > floor and text[s].isalpha() and text[s - 1].isalpha():
            s -= 1
        while e < roof and text[e - 1].isalpha() and text[e].isalpha():
            e += 1
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if s < e:
            out.append((s, e, label))
            floor = e
    return out


def find_mentions(docs: DataFrame, weights: bytes, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, span_start, span_end, label): mentions in all notes of `docs`, with offsets in code points, ends exclusive."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [x or "" for x in b["text"]]
            rows = [(i, *m) for i, t, ms in zip(b["id"], texts, _tag(sent, texts)) for m in whole_words(t, ms)]
            yield pd.DataFrame(rows, columns=["id", "span_start", "span_end", "label"])

    types = dict(docs.dtypes)
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInPandas(run, f"id {types[id_col]}, {FOUND}").withColumnRenamed("id", id_col)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its label in square brackets."""
    parts, at = [], 0
    for s, e, label in spans:
        parts += [text[at:s], f"[{label}]"]
        at = e
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, weights: bytes, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, redacted_text, n_mentions): readable texts with typed placeholders; a null text stays null, with 0 mentions."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [x or "" for x in b["text"]]
            found = [whole_words(t, ms) for t, ms in zip(texts, _tag(sent, texts))]
            yield pd.DataFrame({"id": b["id"], "redacted_text": [None if x is None else masked(t, ms) for x, t, ms in zip(b["text"], texts, found)], "n_mentions": [len(ms) for ms in found]})

    types = dict(docs.dtypes)
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInPandas(run, f"id {types[id_col]}, redacted_text string, n_mentions int").withColumnRenamed("id", id_col)
