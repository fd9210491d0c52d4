"""Fixed rules: phone numbers, mail addresses, national identity numbers, street addresses and known terms of the patient.

The rules read a fold of the text of the same length (small letters, no accents, plain quotes), so offsets need no mapping. `case_preserving`
lets address rules read the text as it is, where capital street and city names count too. Results are trimmed, widened to tokens and united.

One Arrow pass over documents; nothing is shuffled. A null text has no spans; a null context, and null lists and terms in it, are empty;
a context of another shape raises ValueError.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping
from string import punctuation

import pandas as pd
from pyspark.sql import DataFrame

from noteforge.operators.spans import longest_first

SPANS = "array<struct<span_start:int,span_end:int,label:string>>"

# Words for kinds of streets, without accents; each may have a plural s.
STREETS = "allee ave avenue bd boulevard chemin cite cour cours faubourg impasse parvis passage place quai residence route rue sentier square villa".split()
#: Words before a kind of street that make it something else: "en cours", "de la place", "en route", "de passage" (fixed values).
NOT_AFTER = {"cour": {"en", "au", "le"}, "place": {"en", "de", "la"}, "route": {"en"}, "passage": {"de"}}
#: Words of one letter in names of streets, and what may follow a number (fixed values).
SMALL_WORDS, REPEATS = {"a", "à", "d", "l"}, ("bis", "ter", "a", "b")

_ATOM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789!#$%&'*+-/=?^_`{|}~")
_LABEL = re.compile(r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?")
_LITERAL = re.compile(r"\[(\d{1,3}) ?\. ?(\d{1,3}) ?\. ?(\d{1,3}) ?\. ?(\d{1,3})\]")
_DOT = re.compile(r" ?\. ?")
_TRUNK = re.compile(r"(?<!\w)(?:(?:\+|00)33[ .-]{0,3}(?:\(0\)[ .-]{0,3})?|0)(?=[1-9])")
_DIGITS_15 = re.compile(r"(?<!\w)[1-478](?: ?[\dab]){14}(?!\w)", re.ASCII)
_DIGIT_BEFORE, _DIGIT_AFTER = re.compile(r"\d[ ./+=_-]{0,3}\Z"), re.compile(r"[ .-]{0,3}\d")
_KIND = re.compile(rf"(?<!\w)({'|'.join(STREETS)})s?(?=[ -])")
_STREET_WORD = re.compile(r"[DdL]'|[^\W\d_]+")
_HOUSE = re.compile(rf"(?<![\w:])\d+,?(?:\s*(?:{'|'.join(REPEATS)}))? +\Z")
_ADRESSE = re.compile(r"[Aa]dresse ?: *\Z")
_ZIP = re.compile(r"(?: *[à,.-])? *\n? *\(?(\d\d ?\d{3}|(?:[1-9]|1\d|20)[èe]m?e?)(?!\w)", re.IGNORECASE)
_CITY = re.compile(r"(?: *[à,.-] *| *\n? *)([A-ZÀ-ÖØ-Þ]{2,}(?:[- ](?:[A-ZÀ-ÖØ-Þ]{2,}|sur|en))*(?:(?<=CEDEX) *\d\d)?)(?!\w)")

_QUOTES = str.maketrans("’‘ʼ′“”«»", "''''\"\"\"\"")
_EDGE = punctuation + " \t\r\n\f\v  "


class _Folds(dict):
    """Folds of characters by code point, made when first asked for."""

    def __missing__(self, point: int) -> str:
        c = chr(point).translate(_QUOTES)
        if not c.isascii():
            d = unicodedata.normalize("NFKD", c.lower())
            c = d[0] if d and not unicodedata.combining(d[0]) else c
        self[point] = c = c.lower() if len(c.lower()) == 1 else c
        return c


_FOLDS = _Folds()
_LATIN = "".join(_FOLDS[k] for k in range(256))
#: The folds of Latin-1 as a table of bytes; 0 where the fold lies outside.
_LATIN_BYTES = bytes(ord(c) if ord(c) < 256 else 0 for c in _LATIN)


def same_length_fold(text: str) -> str:
    """Small letters without accents and plain quotes, character by character."""
    if text.isascii():
        return text.lower()
    try:
        b = text.encode("latin-1").translate(_LATIN_BYTES)
        if b"\0" not in b:
            return b.decode("latin-1")
    except UnicodeEncodeError:
        pass
    return text.translate(_FOLDS)


def _clear(text: str, start: int, end: int) -> bool:
    """Whether no other digits stand near a number, with at most three separators between."""
    return not _DIGIT_BEFORE.search(text, max(0, start - 4), start) and not _DIGIT_AFTER.match(text, end)


def _grouped(text: str, at: int, breaks: tuple[int, ...], mark: str) -> int | None:
    """The end of nine digits from `at` on with `mark` after those counted in `breaks`; a blank as mark may be missing."""
    for k in range(9):
        if k in breaks:
            if text.startswith(mark, at):
                at += 1
            elif mark != " ":
                return None
        if not ("0" <= text[at : at + 1] <= "9"):
            return None
        at += 1
    return at


def _phones(folded: str) -> list[tuple[int, int, str]]:
    """French numbers: 0 and nine digits, or +33 / 0033 with an optional (0); in pairs or triples, one kind of separator throughout."""
    spans, done = [], 0
    for m in _TRUNK.finditer(folded):
        if m.start() >= done:
            ends = (_grouped(folded, m.end(), breaks, mark) for breaks in ((1, 3, 5, 7), (3, 6)) for mark in ".- ")
            done = next((e for e in ends if e is not None and not folded[e : e + 1].isalnum() and _clear(folded, m.start(), e)), done)
            if done > m.start():
                spans.append((m.start(), done, "TEL"))
    return spans


def _is_identity(s: str) -> bool:
    """Whether 15 signs are a national identity number, field by field: sex, year, month, place and order of birth, key. Numbers that begin with 3, 4, 7 or 8 are
    temporary and have digits only. Months above 12 stand for unknown ones (20 to 42, 50 to 99)."""
    if s[0] not in "12":
        return s.isdecimal()
    place, commune, rest = s[5:7], s[7:10], s[1:5] + s[10:]
    if not rest.isdecimal() or not commune.isdecimal() or not (place.isdecimal() or place in ("2a", "2b")):
        return False
    month, order, key = int(s[3:5]), int(s[10:13]), int(s[13:])
    if place in ("97", "98"):  # overseas: a third figure for the territory, two for the commune
        born = 1 <= int(commune[1:]) <= 90
    else:
        born = place != "00" and 1 <= int(commune) <= 990
    return (month <= 12 or 20 <= month <= 42 or month >= 50) and born and order > 0 and 1 <= key <= 97


def _identities(folded: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), "SECU") for m in _DIGITS_15.finditer(folded) if _clear(folded, *m.span()) and _is_identity(m[0].replace(" ", ""))]


def _domain_end(text: str, at: int) -> int | None:
    """The end of a domain of two labels or more from `at` on, or of an address literal; single blanks may stand around dots."""
    literal = _LITERAL.match(text, at)
    if literal:
        return literal.end() if all(int(x) < 256 for x in literal.groups()) else None
    m, n = _LABEL.match(text, at), 0
    while m:
        end, n = m.end(), n + 1
        dot = _DOT.match(text, end)
        m = _LABEL.match(text, dot.end()) if dot else None
    return end if n > 1 else None


def _local_start(text: str, end: int, floor: int) -> int | None:
    """The start of the local part that ends at `end`: atoms with dots, single blanks around them, or a quoted string of one line."""
    if end - 1 > floor and text[end - 1] == '"':
        line = text.rfind("\n", floor, end) + 1
        start = text.find('"', max(floor, line), end - 1)
        return start if start >= 0 else None
    start = None
    while True:
        low = end
        while low > floor and text[low - 1] in _ATOM:
            low -= 1
        if low == end:
            return start
        start = end = low
        end -= end > floor and text[end - 1] == " "
        if not (end > floor and text[end - 1] == "."):
            return start
        end -= 1
        end -= end > floor and text[end - 1] == " "


def _mails(folded: str) -> list[tuple[int, int, str]]:
    """Mail addresses: what stands around an @."""
    spans, floor, at = [], 0, folded.find("@")
    while at >= 0:
        end = _domain_end(folded, at + 1 + folded.startswith(" ", at + 1))
        before = at - (at > floor and folded[at - 1] == " ")
        if end is not None and (start := _local_start(folded, before, floor)) is not None:
            spans.append((start, end, "MAIL"))
            floor = end
        at = folded.find("@", max(floor, at + 1))
    return spans


def mail_values(folded: str) -> list[str]:
    """Mail addresses of a fold, as they stand there."""
    return [folded[s:e] for s, e, _ in _mails(folded)]


def _street_end(text: str, at: int, capitals: bool) -> tuple[int, bool, bool] | None:
    """Of the name of a street from `at` on: its end, whether it holds a word with a capital, and whether one of small letters. Words are apart by blanks and hyphens; after a kind
    of street in `capitals` all are in capitals."""
    end, name, word = None, False, False
    while True:
        gap = at
        while text[gap : gap + 1] in (" ", "-"):
            gap += 1
        m = _STREET_WORD.match(text, gap)
        if m is None or (capitals and not m[0].isupper()) or (len(m[0]) == 1 and m[0].lower() not in SMALL_WORDS):
            return None if end is None else (end, name, word)
        at = m.end()
        if not m[0].endswith("'"):
            end = at
            name, word = name or (len(m[0]) > 1 and m[0][0].isupper()), word or (len(m[0]) > 1 and m[0].islower())


def _addresses(text: str, folded: str, cased: bool) -> list[tuple[int, int, str]]:
    """Addresses with a number, words of a street and what supports them: a postcode; in cased text also a city in capitals, before or after the postcode, the word
    "adresse" before, or a name with a capital."""
    source, found, done = text if cased else folded, [], 0
    for m in _KIND.finditer(folded):
        written = source[m.start() : m.end()]
        before = folded[max(0, m.start() - 8) : m.start()].split(" ")
        if m.start() < done or (before[-1] == "" and len(before) > 1 and before[-2] in NOT_AFTER.get(m[1].rstrip("s"), ())) or not (written.islower() or written.istitle() or written.isupper()):
            continue
        capitals = cased and written.isupper()
        street = _street_end(source, m.end(), capitals)
        if street is None:
            continue
        end, name, word = street
        done = end
        house = _HOUSE.search(folded, max(0, m.start() - 24), m.start())
        start = house.start() if house else m.start()
        zip_ = _ZIP.match(source, end)
        city = _CITY.match(source, zip_.end() + source.startswith(")", zip_.end()) if zip_ else end) if cased else None
        if city and not zip_:
            zip_ = _ZIP.match(source, city.end())
        named = bool(zip_ or city or (cased and _ADRESSE.search(source, max(0, start - 12), start)))
        if (capitals and house) or (zip_ and city and house) or (named and (name or (house and word))):
            found.append((start, end, city, zip_))
    spans = []
    for k in longest_first([x[:2] for x in found]):
        start, end, city, zip_ = found[k]
        spans += [(start, end, "ADRESSE"), *((*x.span(1), label) for x, label in ((city, "VILLE"), (zip_, "ZIP")) if x)]
    return spans


def checked_context(context) -> dict[str, list[str]]:
    """Terms by label, in one spelling of labels; null lists and terms are left out. ValueError unless labels are not empty and terms are lists of strings."""
    if isinstance(context, list) and all(isinstance(x, tuple) and len(x) == 2 for x in context):
        context = dict(context)  # as Arrow gives maps
    if not isinstance(context, Mapping):
        raise ValueError("context must map labels to lists of strings")
    terms: dict[str, list[str]] = {}
    for label, values in context.items():
        if not isinstance(label, str) or not label or isinstance(values, (str, bytes, Mapping)) or not (values is None or hasattr(values, "__iter__")):
            raise ValueError("context must map labels to lists of strings")
        values = [v for v in (values if values is not None else ()) if v is not None]
        if not all(isinstance(v, str) for v in values):
            raise ValueError("terms of a context must be strings")
        terms.setdefault({"EMAIL": "MAIL", "NOM_NAISS": "NOM"}.get(label, label), []).extend(values)
    return terms


def _context(folded: str, context) -> list[tuple[int, int, str]]:
    """Occurrences of the patient's terms as whole tokens; EMAIL counts as MAIL, NOM_NAISS as NOM."""
    spans = []
    for label, values in checked_context(context if context is not None else {}).items():
        for v in {" ".join(same_length_fold(v).split()) for v in values}:
            if not v.strip(punctuation + " "):
                continue
            if " " in v:  # a blank of a term matches any run of blanks
                pattern = re.compile(rf"(?=({r'\s+'.join(map(re.escape, v.split(' ')))}))")
                spans += [(*m.span(1), label) for m in pattern.finditer(folded) if _whole(folded, *m.span(1))]
                continue
            at = folded.find(v)
            while at >= 0:
                if _whole(folded, at, at + len(v)):
                    spans.append((at, at + len(v), label))
                at = folded.find(v, at + 1)
    return spans


def _whole(text: str, start: int, end: int) -> bool:
    """Whether no letter or digit stands right before or after."""
    return not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())


def trimmed(text: str, start: int, end: int, label: str) -> tuple[int, int] | None:
    """A span without blanks and punctuation at its ends: TEL keeps a leading + or (, PRENOM a final dot. None if nothing is left."""
    if not text[start:end].strip(punctuation + " \n"):
        return None
    lead = _EDGE.replace("+", "").replace("(", "") if label == "TEL" else _EDGE
    tail = _EDGE.replace(".", "") if label == "PRENOM" else _EDGE
    while start < end and text[start] in lead:
        start += 1
    while end > start and text[end - 1] in tail:
        end -= 1
    return (start, end) if start < end else None


def unite(spans: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str]]:
    """Overlapping spans (start, end, label, source) united as in `merge_spans`."""
    out: list[list] = []
    for s in sorted(spans):
        if out and s[0] < out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
            out[-1][2].append(s)
        else:
            out.append([s[0], s[1], [s]])
    return [(a, b, min(members, key=lambda x: (x[0] - x[1], x[0], x[3], x[2]))[2]) for a, b, members in out]


def cleaned(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans trimmed, widened to the tokens they touch, and united."""
    kept = [(*t, label) for s, e, label in spans if (t := trimmed(text, s, e, label))]
    if not kept:
        return []
    return unite([(_token_start(text, s), _token_end(text, e), label, 0) for s, e, label in kept])


def _kind(c: str) -> int:
    """Of a character, the kind of token it is part of: 1 digits, 2 letters, 3 blanks, 0 a token of its own."""
    return 1 if c.isdecimal() else 2 if c.isalnum() else 3 if c.isspace() and c != "\n" else 0


def _token_start(text: str, s: int) -> int:
    """Start of the token that holds the character at s."""
    k = _kind(text[s])
    while k and s and _kind(text[s - 1]) == k:
        s -= 1
    return s


def _token_end(text: str, e: int) -> int:
    """End of the token that holds the character before e."""
    k = _kind(text[e - 1])
    while k and e < len(text) and _kind(text[e]) == k:
        e += 1
    return e


def rule_spans(text: str | None, context=None, case_preserving: bool = False) -> list[tuple[int, int, str]]:
    """All rule spans of a text, disjoint and in order."""
    if not text:
        return []
    folded = same_length_fold(text)
    return cleaned(text, _mails(folded) + _phones(folded) + _identities(folded) + _addresses(text, folded, case_preserving) + _context(folded, context))


def with_rule_spans(docs: DataFrame, context: str | None = "context", case_preserving: bool = False) -> DataFrame:
    """`docs` with `rules`: the rule spans of each document as an array.

    The function is called nondeterministic, as Spark would else evaluate it again for the filter it derives from an explode.
    """
    from pyspark.sql import functions as F

    if context and context in docs.columns:

        @F.pandas_udf(SPANS)
        def run(text: pd.Series, terms: pd.Series) -> pd.Series:
            return pd.Series([_structs(rule_spans(t, c, case_preserving)) for t, c in zip(text, terms)])

        return docs.withColumn("rules", run.asNondeterministic()("text", context))

    @F.pandas_udf(SPANS)
    def plain(text: pd.Series) -> pd.Series:
        return pd.Series([_structs(rule_spans(t, None, case_preserving)) for t in text])

    return docs.withColumn("rules", plain.asNondeterministic()("text"))


def _structs(spans: list[tuple[int, int, str]]) -> list[dict]:
    return [{"span_start": s, "span_end": e, "label": x} for s, e, x in spans]


def exploded(docs: DataFrame, column: str = "rules") -> DataFrame:
    """(doc_id, span_start, span_end, label) of an array of spans."""
    from pyspark.sql import functions as F

    return docs.select("doc_id", F.explode(column).alias("s")).select("doc_id", "s.span_start", "s.span_end", "s.label")
