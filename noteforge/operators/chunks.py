"""Training chunks of annotated documents: pieces of whole sentences where they fit, with spans clipped to them."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from noteforge.operators.router import spans_of

#: The tokens of `spans.TOKEN` that aren't blanks.
_FILLED = re.compile(r"\d+|[^\W\d_]+|\n|\S")
_END = re.compile(r"[.!?…]+|\n")


def token_bounds(text: str) -> list[tuple[int, int]]:
    """Tokens that aren't blanks, but for line feeds, which are tokens."""
    return [m.span() for m in _FILLED.finditer(text)]


def sentence_ends(text: str, tokens: list[tuple[int, int]], spans: list[tuple[int, int, str]]) -> list[int]:
    """Numbers of tokens after which a sentence ends: after a full stop, a question or exclamation mark or a line feed; never inside a span; and at the end."""
    ends = [k + 1 for k, (s, e) in enumerate(tokens) if _END.fullmatch(text[s:e]) and not any(a < tokens[k + 1][1] and tokens[k + 1][0] < b and a < e for a, b, _ in spans if k + 1 < len(tokens))]
    return ends if ends and ends[-1] == len(tokens) else [*ends, len(tokens)]


def chunk_bounds(ends: list[int], most: int, chance: random.Random) -> list[tuple[int, int]]:
    """Chunks of tokens: sentences are gathered until they exceed `most`; then pieces of random length, mostly near `most`, are cut off, and the rest closes
    at the end of the sentence. What remains at the end is the last chunk."""
    out, opened = [], 0
    for close in ends:
        if close - opened <= most:
            continue
        cuts = [opened]
        while close - cuts[-1] > most:
            cuts.append(cuts[-1] + max(1, int(most * chance.random() ** 0.3)))
        out += zip(cuts, [*cuts[1:], close])
        opened = close
    return out + [(opened, ends[-1])] * bool(ends and opened < ends[-1])


def training_chunks(docs: DataFrame, max_length: int = 384, seed: int = 42) -> DataFrame:
    """(doc_id, chunk_no, text, entities) of annotated documents. The random lengths depend on the seed and the id; chunks of blanks only are left out.

    Null or empty texts have no chunks; null entities count as none.
    """
    if max_length < 1:
        raise ValueError("max_length must be positive")
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, text, entities in zip(b["doc_id"], b["text"], b["entities"]):
                text, spans, n = text or "", spans_of(entities), 0
                toks = token_bounds(text)
                if not toks:
                    continue
                for a, z in chunk_bounds(sentence_ends(text, toks, spans), max_length, random.Random(f"{seed}:{d}")):
                    low, high = toks[a][0], toks[z - 1][1]
                    if text[low:high].strip():
                        inside = [{"start": max(s, low) - low, "end": min(e, high) - low, "label": x} for s, e, x in spans if s < high and low < e]
                        rows.append((d, n, text[low:high], inside))
                        n += 1
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "text", "entities"])

    return docs.select("doc_id", "text", "entities").mapInPandas(run, f"doc_id {kind}, chunk_no int, text string, entities array<struct<start:int,end:int,label:string>>")
