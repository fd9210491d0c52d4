"""Rows that fail to parse, separated with the reason from those that load.

Records of separated values are checked for their quoting, then read by pyarrow as strings; rows of a wrong shape come back through its
callback for invalid rows. The strings are cast as whole vectors, and the first failing cell of a row labels it. JSON records are decoded strictly
(RFC 8259: no NaN, no comments, no trailing text) and checked member by member.

A null record has no JSON value (`syntax`) and is one empty field (`columns`); JSON nested deeper than the parser follows counts as `syntax`. A feed
that is null or unknown gives `feed`. Repeated rows are judged each; columns other than the three named pass by.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTITIES = "array<struct<start:int,end:int,label:string>>"
DECODED = f"reason string, text string, entities {ENTITIES}, context map<string,array<string>>, note string, span_start bigint, span_end bigint, label string"
_COLUMNS = ["k", "note", "text", "start", "end", "label"]
_FIELD = r'(?:"(?:[^"]|"")*"|[^";]*)'
_RECORD = re.compile(rf"{_FIELD}(?:;{_FIELD})*")
_QUOTED = re.compile(r'"(?:[^"]|"")*"')
#: Stand for line breaks outside quotes while a record is read.
_FEED, _RETURN = "﷐", "﷑"


def _no_constant(name: str):
    raise ValueError(name)


def _whole(digits: str) -> int:
    return int(digits) if len(digits) < 20 else 10**20 * (-1 if digits[0] == "-" else 1)


def decode_note(raw: str | None) -> tuple[str | None, dict | None]:
    """(reason, note) of a JSON record; the reason is None if the note is valid."""
    try:
        note = json.loads(raw or "", parse_constant=_no_constant, parse_int=_whole)
    except (ValueError, RecursionError):
        return "syntax", None
    if not isinstance(note, dict):
        return "object", None
    text, entities, context = note.get("text"), note.get("entities"), note.get("context")
    if not isinstance(text, str) or not text:
        return "text", None
    if not isinstance(entities, list) or not all(isinstance(e, dict) for e in entities):
        return "entity", None
    spans = []
    for e in entities:
        start, end = e.get("start"), e.get("end")
        if type(start) is not int or type(end) is not int or not 0 <= start < end <= len(text):
            return "offsets", None
        spans.append((start, end))
    if not all(isinstance(e.get("label"), str) and e["label"] for e in entities):
        return "label", None
    spans.sort()
    if any(a[1] > b[0] for a, b in zip(spans, spans[1:])):
        return "overlap", None
    if context is not None and not (isinstance(context, dict) and all(isinstance(v, list) and all(isinstance(x, str) for x in v) for v in context.values())):
        return "context", None
    return None, {"text": text, "entities": [{"start": e["start"], "end": e["end"], "label": e["label"]} for e in sorted(entities, key=lambda e: (e["start"], e["end"]))], "context": context}


def decode_spans(raw: list[str | None]) -> pd.DataFrame:
    """reason, note, text, span_start, span_end, label of records of five separated fields, in order."""
    n = len(raw)
    reason = np.array([None if _RECORD.fullmatch(r or "") else "quoting" for r in raw], object)
    lines = []
    for k in np.flatnonzero(reason == None).tolist():  # noqa: E711
        r = raw[k] or ""
        if "\n" in r or "\r" in r:
            mark = lambda s: s.replace("\n", _FEED).replace("\r", _RETURN)
            parts, at = [], 0
            for m in _QUOTED.finditer(r):
                parts += [mark(r[at : m.start()]), m[0]]
                at = m.end()
            r = "".join([*parts, mark(r[at:])])
        lines.append(f"{k};{r}\n")
    out = {c: np.full(n, None, object) for c in ("note", "text", "span_start", "span_end", "label")}
    if lines:
        data = "".join(lines).encode()

        def invalid(row) -> str:
            reason[int(row.text.partition(";")[0].strip('"'))] = "columns"
            return "skip"

        table = csv.read_csv(
            io.BytesIO(data),
            csv.ReadOptions(use_threads=False, block_size=len(data) + 1, column_names=_COLUMNS),
            csv.ParseOptions(delimiter=";", newlines_in_values=True, ignore_empty_lines=False, invalid_row_handler=invalid),
            csv.ConvertOptions(column_types={c: pa.string() for c in _COLUMNS}, strings_can_be_null=False),
        ).combine_chunks()
        at = np.array(table["k"].to_pylist(), np.int64)
        digits = [pc.match_substring_regex(table[c], r"^[0-9]+$") for c in ("start", "end")]
        numbers = []
        for c, good in zip(("start", "end"), digits):
            short = pc.replace_substring_regex(table[c], r"^0+([0-9])", r"\1")
            fits = pc.and_(good, pc.less_equal(pc.binary_length(short), 18))
            numbers.append(pc.cast(pc.if_else(fits, short, pa.scalar("-1")), pa.int64()))
        start, end = (x.to_numpy(zero_copy_only=False) if isinstance(x, pa.Array) else x.to_numpy() for x in numbers)
        length = table["text"].to_pandas().map(len).to_numpy(np.int64) if len(at) else np.zeros(0, np.int64)
        empty = {c: pc.equal(table[c], "").to_numpy() for c in ("text", "label")}
        found = np.select([empty["text"], (start < 0) | (end <= start) | (end > length), empty["label"]], ["text", "offsets", "label"], "")
        reason[at] = [x or None for x in found.tolist()]
        back = lambda s: s.replace(_FEED, "\n").replace(_RETURN, "\r")
        for c in ("note", "text", "label"):
            out[c][at] = [back(x) for x in table[c].to_pylist()]
        out["span_start"][at], out["span_end"][at] = start, end
    frame = pd.DataFrame({"reason": reason, **out})
    frame.loc[frame["reason"].notna(), ["note", "text", "span_start", "span_end", "label"]] = None
    return frame


def decode(rows: DataFrame, id_col: str = "row_id", feed: str = "feed", raw: str = "raw") -> DataFrame:
    """(id, feed, reason, text, entities, context, note, span_start, span_end, label): every row, with a reason or with what it loads to."""
    kind = dict(rows.dtypes)[id_col]
    clean = lambda s: s if s is None else s.encode("utf-8", "replace").decode()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            notes = b[b["feed"] == "notes_jsonl"]
            spans = b[b["feed"] == "spans_csv"]
            rest = b[~b["feed"].isin(["notes_jsonl", "spans_csv"])]
            empty = dict.fromkeys(["text", "entities", "context", "note", "span_start", "span_end", "label"])
            if len(notes):
                got = [decode_note(x) for x in notes["raw"]]
                value = lambda c: [None if g is None else g[c] for _, g in got]
                yield pd.DataFrame(
                    {
                        **empty, "id": notes["id"].array, "feed": notes["feed"].array, "reason": [r for r, _ in got], "text": [clean(x) for x in value("text")],
                        "entities": [x if x is None else [{**e, "label": clean(e["label"])} for e in x] for x in value("entities")],
                        "context": [x if x is None else {clean(k): [clean(s) for s in v] for k, v in x.items()} for x in value("context")],
                    }
                )
            if len(spans):
                got = decode_spans(spans["raw"].tolist())
                got["span_start"], got["span_end"] = got["span_start"].astype("Int64"), got["span_end"].astype("Int64")
                yield got.assign(id=spans["id"].array, feed=spans["feed"].array, entities=None, context=None)
            if len(rest):
                yield pd.DataFrame({**empty, "id": rest["id"].array, "feed": rest["feed"].array, "reason": "feed"})

    return rows.select(F.col(id_col).alias("id"), F.col(feed).alias("feed"), F.col(raw).alias("raw")).mapInPandas(run, f"id {kind}, feed string, {DECODED}").withColumnRenamed("id", id_col)


def rejected(rows: DataFrame, id_col: str = "row_id", feed: str = "feed", raw: str = "raw") -> DataFrame:
    """(id, reason): one row for each invalid row."""
    return decode(rows, id_col, feed, raw).where("reason IS NOT NULL").select(id_col, "reason")


def loaded_notes(decoded: DataFrame, id_col: str = "row_id") -> DataFrame:
    """(id, text, entities, context) of valid notes; entities in order of offsets."""
    return decoded.where("reason IS NULL AND feed = 'notes_jsonl'").select(id_col, "text", "entities", "context")


def loaded_spans(decoded: DataFrame, id_col: str = "row_id") -> DataFrame:
    """(id, note, text, span_start, span_end, label) of valid spans."""
    return decoded.where("reason IS NULL AND feed = 'spans_csv'").select(id_col, "note", "text", "span_start", "span_end", "label")
