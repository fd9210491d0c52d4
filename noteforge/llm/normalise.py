"""One consistent form for text that looks the same but holds other characters.

The canonical form of a text: NFC; width forms, presentation forms, ligatures and mathematical or circled letters replaced by what they stand for; invisible
characters removed (joiners and variation selectors inside emoji stay); all spaces but tab and line breaks the ordinary one; hyphens `-`; and in words
that mix Latin letters with letters of another script, those replaced by Latin letters: look-alikes of Greek and Cyrillic by a table, all other letters by
the Latin letter their Unicode name gives them. `µ`, `°`, `œ`, guillemets, emoji, Greek letters standing alone and words of another script stay as they are, and so
do ideographs, whose names give no letter.

A text is only touched where it is unstable. The quick check is one search for the class of characters that can be unstable; the class is derived from the Unicode
data at hand: what has not "yes" in NFC's quick check (it is replaced by NFC, or is a mark), what has one of the compatibility decompositions above, spaces,
hyphens, invisible characters, letters of other scripts. Each place found is widened to a segment between white space: no step of the form reaches
across it, but for a mark right after it, which takes it along. Segments are normalised and spliced into the untouched text.

What is found unusual is what this changes: `find_unusual` and `canonical_frame` share `changes`.

Nulls stay null, empty texts empty; equal rows give equal results.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of Greek and Cyrillic that look like Latin ones, and those (fixed values).
LOOKALIKES = dict(
    zip(
        "аеоіјѕрсухԁһԛԝӏкмтвнАВЕЗКМНОРСТУХІЈЅԌԚԜӀ" + "αορνικτυχγηωεμΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeoijspcyxdhqwlkmtbhABE3KMHOPCTYXIJSGQWl" + "aopviktuxynweµABEZHIKMNOPTYX",
    )
)
#: What a hyphen other than `-` may be (fixed values): hyphen, non-breaking hyphen, figure dash, small and full-width hyphen, Armenian and Mongolian ones.
HYPHENS = r"\u2010\u2011\u2012\ufe63\uff0d\u058a\u1806"
#: Characters without a shape (fixed values): soft hyphen, joiners, marks of direction, fillers, variation selectors, tags.
INVISIBLE = r"\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb\U000e0000-\U000e0fff"
#: Spaces other than U+0020 (fixed values).
SPACES = r"\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where characters with decompositions lie: the basic plane but for surrogates, historic scripts, mathematical and enclosed letters, compatibility ideographs.
_PLANES = (range(0xA0, 0xD800), range(0xE000, 0x10000), range(0x11000, 0x12000), range(0x1D100, 0x1D800), range(0x1F100, 0x1F200), range(0x2F800, 0x2FA20))


def _is_form(c: str) -> bool:
    """Whether a character is another form of what its compatibility decomposition stands for, and looks like it."""
    tag = unicodedata.decomposition(c).partition(" ")[0]
    if tag in ("<wide>", "<narrow>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>"):
        return True
    if tag == "<font>":
        return c >= "\U0001d400"  # mathematical letters; older ones, as the sign for litre, have uses of their own
    if tag not in ("<compat>", "<circle>") or c == "µ" or (tag == "<compat>" and unicodedata.category(c)[0] != "L"):
        return False
    plain = unicodedata.normalize("NFKC", c)
    return plain.isalpha() and (len(plain) > 1 or plain.isascii())


def _class(points: list[int]) -> str:
    """A class of characters for a pattern, from their code points in order."""
    out, k = [], 0
    while k < len(points):
        m = k
        while m + 1 < len(points) and points[m + 1] == points[m] + 1:
            m += 1
        out.append(rf"\U{points[k]:08x}" + (rf"-\U{points[m]:08x}" if m > k else ""))
        k = m + 1
    return "".join(out)


_ALL = [c for r in _PLANES for c in map(chr, r) if unicodedata.decomposition(c)]
_FORMS = _class([ord(c) for c in _ALL if _is_form(c)])
#: Characters that NFC replaces although they are no mark.
_REPLACED = _class([ord(c) for c in _ALL if not unicodedata.is_normalized("NFC", c)])

#: A text without any of these is canonical. The class is spelled out for the basic plane, as a search for it is fast then; of the others it holds all that may be letters or marks.
_LETTERS = "".join(chr(k) for r in (range(0xA0, 0xD800), range(0xE000, 0x10000)) for k in r if unicodedata.category(chr(k))[0] in "LM")
_UNSTABLE = _class(sorted(map(ord, regex.findall(r"\p{M}|[^\p{Latin}µ]", _LETTERS))))
UNSTABLE = re.compile(rf"[{INVISIBLE}{SPACES}{HYPHENS}{_FORMS}{_REPLACED}{_UNSTABLE}\U00010000-\U0001efff\U0001f100-\U0001f1ff\U00020000-\U0003ffff]")
_INVISIBLE, _SPACES, _HYPHENS, _WIDE = (re.compile(f"[{x}]") for x in (INVISIBLE, SPACES, HYPHENS, _FORMS))
#: An emoji with what joins or selects its parts.
_EMOJI = regex.compile(
    r"(?:\p{Emoji_Presentation}|\p{Extended_Pictographic}|\p{Regional_Indicator}|[#*0-9](?=\ufe0f?\u20e3))[\ufe0e\ufe0f\u20e3\U0001f3fb-\U0001f3ff\U000e0020-\U000e007f]*"
    r"(?:\u200d\p{Extended_Pictographic}[\ufe0e\ufe0f\U0001f3fb-\U0001f3ff]*)*"
)
_WORD = regex.compile(r"(?:\p{L}\p{M}*)+")
_LATIN, _FOREIGN = regex.compile(r"\p{Latin}"), regex.compile(r"[^\P{L}\p{Latin}µ]")


def is_mixed(word: str) -> bool:
    """Whether a run of letters mixes Latin letters with letters of another script (`µ` counts for neither)."""
    return bool(_LATIN.search(word) and _FOREIGN.search(word))


class _Latin(dict):
    """Latin letters for letters of other scripts, by code point, made when first asked for."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        x = LOOKALIKES.get(c, c)
        if x == c and _FOREIGN.match(c):
            last = unicodedata.name(c, "").split(" ")[-1]
            x = c if not last.isalpha() else last[0] if unicodedata.category(c) == "Lu" else last[0].lower()
        self[point] = x
        return x


_LATIN_FOR = _Latin()


def _latin_word(m) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", m[0]).translate(_LATIN_FOR)) if is_mixed(m[0]) else m[0]


def _canonical_segment(s: str) -> str:
    s = _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), s)
    s = _SPACES.sub(" ", s)
    s = _HYPHENS.sub("-", s)
    if _INVISIBLE.search(s):
        kept, at = [], 0
        for m in _EMOJI.finditer(s):
            kept += [_INVISIBLE.sub("", s[at : m.start()]), m[0]]
            at = m.end()
        s = "".join([*kept, _INVISIBLE.sub("", s[at:])])
    s = unicodedata.normalize("NFC", s)
    return _WORD.sub(_latin_word, s) if _FOREIGN.search(s) else s


def changes(text: str | None) -> Iterator[tuple[int, int, str]]:
    """(start, end, canonical form) of the segments of a text whose canonical form differs, in order."""
    if not text or text.isascii():
        return
    at, n = 0, len(text)
    m = UNSTABLE.search(text)
    while m is not None:
        a, b = m.start(), m.end()
        while a > at and not text[a - 1].isspace():
            a -= 1
        if a > at and unicodedata.combining(text[a]):
            a -= 1
        while b < n and not (text[b].isspace() and not (b + 1 < n and unicodedata.combining(text[b + 1]))):
            b += 1
        s = text[a:b]
        if (form := _canonical_segment(s)) != s:
            yield a, b, form
        at = b
        m = UNSTABLE.search(text, b)


def canonical(text: str | None) -> str | None:
    """The canonical form of a text: stable text is returned as it is, else only unstable segments are normalised and spliced in."""
    out, at = [], 0
    for a, b, form in changes(text):
        out += [text[at:a], form]
        at = b
    return "".join([*out, text[at:]]) if out else text


def fold(text: str | None) -> str:
    """The canonical form without letter case, accents and ligatures, for comparison; null as empty.

    Latin-1 characters that fold one to one take one pass over their bytes. Only segments between white space that hold others go the long way, those near each
    other together; the result is the same as that of the long way over the whole.
    """
    if not text:
        return ""
    m = _HARD.search(text)
    if m is None:
        return _folded_plain(text)
    out, at, n = [], 0, len(text)
    while m is not None:
        a, b = m.start(), m.end()
        while a > at and not text[a - 1].isspace():
            a -= 1
        if a > at and unicodedata.combining(text[a]):
            a -= 1
        while m is not None and m.start() - b <= 40:
            b = max(b, m.end())
            while b < n and not (text[b].isspace() and not (b + 1 < n and unicodedata.combining(text[b + 1]))):
                b += 1
            m = _HARD.search(text, b)
        out += [_folded_plain(text[at:a]), _folded(text[a:b])]
        at = b
    return "".join([*out, _folded_plain(text[at:])])


def _folded(text: str) -> str:
    t = canonical(text)
    for x, y in _ONE_TO_MANY:
        t = t.replace(x, y)
    return _MARKS.sub("", unicodedata.normalize("NFKD", t.casefold())).replace("\u03bc", "\u00b5")


def _folded_plain(text: str) -> str:
    for x, y in _ONE_TO_MANY:
        if x in text:
            text = text.replace(x, y)
    return text.encode("latin-1").translate(_FOLDED).decode("latin-1")


_MARKS = regex.compile(r"\p{Mn}+")
#: What folds to more than one character, or to one outside Latin-1 (fixed values).
_ONE_TO_MANY = (("\u0153", "oe"), ("\u0152", "oe"), ("\u00e6", "ae"), ("\u00c6", "ae"), ("\u2019", "'"), ("\u00df", "ss"))


def _folded_byte(k: int) -> int:
    c = chr(k)
    if c == "\u00b5":
        return k
    f = _MARKS.sub("", unicodedata.normalize("NFKD", c.casefold()))
    return 0 if UNSTABLE.search(c) or len(f) != 1 or ord(f) > 255 else ord(f)


_FOLDED = bytes(map(_folded_byte, range(256)))
#: What the table of bytes doesn't fold.
_HARD = re.compile("[^" + "".join(re.escape(chr(k)) for k in range(256) if _FOLDED[k]) + "".join(x for x, _ in _ONE_TO_MANY) + "]")


def canonical_frame(docs: DataFrame, text: str = "text", context: str = "context") -> DataFrame:
    """`docs` with `canonical_text` and `canonical_context` (terms of the map in canonical form) and `changed` (whether either differs).

    Null texts and maps stay null, null lists and terms too; other columns pass through. Columns of these names are replaced.
    """

    @F.pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        return column.map(canonical, na_action="ignore")

    has = context in docs.columns
    out = docs.withColumn("canonical_text", F.when(stable(F.col(text)), F.col(text)).otherwise(texts(F.when(~stable(F.col(text)), F.col(text)))))
    changed = ~F.col("canonical_text").eqNullSafe(F.col(text))
    if has:

        @F.pandas_udf("map<string,array<string>>")
        def terms(column: pd.Series) -> pd.Series:
            return column.map(lambda m: None if m is None else {k: None if v is None else [canonical(x) for x in v] for k, v in (m.items() if isinstance(m, dict) else m)})

        out = out.withColumn("canonical_context", terms(F.col(context)))
        changed = changed | ~F.to_json("canonical_context").eqNullSafe(F.to_json(F.col(context)))
    return out.withColumn("changed", changed)


def stable(text):
    """The quick check in the JVM: a text of ASCII and the usual accented letters and signs needs no look in Python; null counts as stable."""
    return F.coalesce(~text.rlike(_JVM_UNSTABLE), F.lit(True))


#: Up to U+024F what UNSTABLE leaves out, and a few signs; as few ranges, which Java's patterns try one by one.
_JVM_UNSTABLE = "[^" + re.sub(r"\\U0000(....)", r"\\u\1", _class([k for k in range(0x250) if not UNSTABLE.match(chr(k))])) + r"\u2013\u2014\u2018-\u201f\u2026\u20ac]"


def find_unusual(docs: DataFrame, id_col: str = "doc_id", text: str = "text", context: str = "context") -> DataFrame:
    """(doc_id, field): fields that the canonical form changes, `text` or `context` (any term of the map).

    A row for each such field of each row of `docs`; null and empty fields give none. Fields that the JVM's quick check calls stable never
    reach Python, and others are read up to the first segment that changes.
    """
    joined = F.array_join(F.flatten(F.transform(F.map_values(F.col(context)), lambda v: F.coalesce(v, F.array().cast("array<string>")))), "\n")
    fields = F.array(F.struct(F.lit("text").alias("field"), F.col(text).alias("s")), F.struct(F.lit("context").alias("field"), joined.alias("s")))
    rows = docs.select(F.col(id_col), F.explode(fields).alias("f")).select(id_col, "f.field", "f.s").where(~stable(F.col("s")))

    def changed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[next(changes(x), None) is not None for x in b["s"]], [id_col, "field"]]

    types = dict(docs.dtypes)
    return rows.mapInPandas(changed, f"`{id_col}` {types[id_col]}, field string")
