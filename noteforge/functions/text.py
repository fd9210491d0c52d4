"""Text functions of lines: normal form, shape, words, n-grams, hashed buckets, running sums.

Column functions stay in the JVM; those that need Unicode folding (`fold_line`, `normal_form`) are Arrow functions over whole columns. All
of them give null for null, and an empty string or array for the empty string.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Index 0 of a feature vector is the bias.
BIAS = 0
WORD = re.compile(r"[a-z0-9]+|[^\w\s]", re.IGNORECASE)
_BLANK = re.compile(r"\s+")


class _Each(dict):
    """What a function of single characters gives, by code point; made when first asked for."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, point: int) -> str:
        self[point] = x = self.of(chr(point))
        return x


_FOLDED = _Each(lambda c: "" if unicodedata.combining(c) else "0" if c.isdigit() else c)
_SHAPED = _Each(lambda c: "A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else " " if c.isspace() else c)
_RUNS = re.compile(r"([Aa0 ])\1+")


def fold_line(text: str) -> str:
    """Case folded, accents dropped (compatibility forms too), each digit as 0, blanks collapsed and cut off at the ends."""
    t = text.lower() if text.isascii() else unicodedata.normalize("NFKD", text.casefold())
    return _BLANK.sub(" ", t.translate(_FOLDED)).strip()


def line_shape(text: str) -> str:
    """Runs of capitals as A, of small letters as a, of digits as 0, of blanks as one blank; other characters stay; blank ends cut off."""
    return _RUNS.sub(r"\1", text.translate(_SHAPED)).strip()


@F.pandas_udf(T.StringType())
def normal_form(text: pd.Series) -> pd.Series:
    """`fold_line` of a column."""
    return text.map(fold_line, na_action="ignore")


def shape(text: Column) -> Column:
    """`line_shape` in the JVM. Superscript and circled digits count as digits, as in Python."""
    digits = r"[\p{Nd}²³¹⁰-⁹₀-₉①-⑨]+"
    t = F.regexp_replace(text, r"\p{IsUppercase}+", "A")
    t = F.regexp_replace(t, r"\p{IsLowercase}+", "a")
    t = F.regexp_replace(t, digits, "0")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def words(normal: Column) -> Column:
    """Words of a normal form: runs of a-z and 0-9, and single signs; underscores and letters of other alphabets give none."""
    return F.regexp_extract_all(normal, F.lit(r"(?U)[a-z0-9]+|[^\p{L}\p{N}_\s]"), F.lit(0))


def bigrams(tokens: Column) -> Column:
    """Neighbouring words joined by `_`."""
    n = F.size(tokens)
    return F.when(n >= 2, F.zip_with(F.slice(tokens, F.lit(1), n - 1), F.slice(tokens, F.lit(2), n - 1), lambda a, b: F.concat_ws("_", a, b))).when(n >= 0, F.array().cast("array<string>"))


def ngrams(text: Column, size: int) -> Column:
    """Runs of `size` characters, in order; none of a shorter text. One look-ahead scan; texts with characters beyond the basic plane, whose halves the
    scan would also stop at, are cut by place, which takes the square of their length."""
    n = F.length(text)
    scanned = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))
    placed = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(n >= size, F.when(text.rlike(r"[\x{10000}-\x{10ffff}]"), placed).otherwise(scanned)).when(n >= 0, F.array().cast("array<string>"))


def bucket(value: Column, dimension: int) -> Column:
    """Index of a feature: a CRC-32 of its UTF-8 bytes over the places after the bias."""
    return (F.lit(1) + F.crc32(F.encode(value, "utf-8")) % F.lit(dimension - 1)).cast("int")


def sigmoid(x: Column) -> Column:
    """The logistic function, of a value clamped to 20 either way."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), x))))


def is_alnum(char: Column) -> Column:
    """Whether a character is a letter or numeric."""
    return char.rlike(r"^[\p{L}\p{N}]$")


def alnum_count(text: Column) -> Column:
    """Number of letters and numerics."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def running_sums(values: Column, block: int = 64) -> Column:
    """Sums of an array of longs up to and with each place. In blocks, so that n values cost about n * block and (n / block)^2 steps."""
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    zero = F.array(F.lit(0).cast("long"))
    n = F.size(values)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / F.lit(block)).cast("int")))
    blocks = F.transform(starts, lambda k: F.slice(values, k * block + 1, F.lit(block)))
    bases = F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + x)), zero, grow)
    inner = lambda b, base: F.transform(F.slice(F.aggregate(b, zero, grow), F.lit(2), F.greatest(F.lit(0), F.size(b))), lambda x: x + base)
    return F.when(n > 0, F.flatten(F.zip_with(blocks, F.slice(bases, F.lit(1), F.size(blocks)), inner))).when(n == 0, F.array().cast("array<bigint>"))
