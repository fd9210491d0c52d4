"""Cutting oversized texts into pieces under a limit, at natural boundaries, with an overlap between consecutive pieces.

No worker needs a whole item. An item, be it a text in a column or a file, is UTF-8 bytes that are read in ranges with a halo on either side. The
border between two ranges is moved to the first natural boundary at or after it within the halo (the place after a line feed, else a word's start,
else the border itself, or the end of the character it would split); as both neighbours see the same bytes there, they agree on it. Each worker
detects the boundaries of its section and cuts it; the table of sections is stitched in order, lengths in characters (which a byte range doesn't know
beforehand) and numbers of pieces are prefix-summed, and pieces are emitted by offset. Ranges of one long text go to several tasks; a range is sliced
from the bytes at its place, so the work grows with the length. Texts of one range aren't shuffled.

Texts in a column: `split_texts`, `cut_levels`. Files of any size: `split_files`, `file_levels`, which read byte ranges only. Invalid bytes of files count as one
character each.

Nulls: a null text gives no row. A text within the limit is one piece, the empty text one empty piece. Rows need unique ids; the sections of
rows that share an id would be mixed up if they are longer than a range.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import merge

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Most characters of a piece and of an overlap; bytes of a range of a text and of a file.
LIMIT, OVERLAP, RANGE, FILE_RANGE = 2000, 200, 1 << 14, 1 << 26
_LINE, _BLANK, _BLANK_BYTES = re.compile(r"\n"), re.compile(r"[ \t\n]+"), re.compile(rb"[ \t\n]+")
#: What a worker reports of its section; head, most and tail: lengths of the first, the longest inner and the last line (run without blanks).
SECTION = "range_no int, length bigint, line_cuts int, line_head int, line_most int, line_tail int, run_cuts int, run_head int, run_most int, run_tail int, pieces array<struct<s:bigint,e:bigint,bs:bigint,be:bigint,cut:string>>"


def boundaries(text: str) -> tuple[list[int], list[int], list[int]]:
    """Of a text: places after line feeds, starts of runs of blanks (space, tab, line feed), ends of them."""
    blanks = [m.span() for m in _BLANK.finditer(text)]
    return [m.end() for m in _LINE.finditer(text)], [a for a, _ in blanks], [b for _, b in blanks]


def cut(first: int, last: int, lines: list[int], words: list[int], limit: int = LIMIT, overlap: int = OVERLAP, led: bool = False) -> list[tuple[int, int, str]]:
    """Pieces (start, end, kind of the cut at the end) of the stretch from `first` to `last`, given its boundaries in order.

    A piece ends at the last line end within the limit if that leaves it at least half full, else at the last place between words, else
    (inside an unbroken run) at the limit. The next piece starts within `overlap` before that end: at the first line start there, else
    the first place between words, else exactly `overlap` before a cut inside a run, else at the end itself. The last piece's cut is
    "end". `led`: the first piece, too, starts within `overlap` before `first`.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")

    def start_before(end: int, kind: str) -> int:
        for places in (lines, words):
            k = bisect_left(places, end - overlap)
            if k < len(places) and places[k] < end:
                return places[k]
        return end - overlap if kind == "char" else end

    out, start = [], start_before(first, "word") if led else first
    while last - start > limit:
        most, end, kind = start + limit, start + limit, "char"
        for places, name, floor in ((lines, "line", start + max(overlap, limit // 2)), (words, "word", start + overlap)):
            k = bisect_right(places, most) - 1
            if k >= 0 and places[k] > floor:
                end, kind = places[k], name
                break
        out.append((start, end, kind))
        start = start_before(end, kind)
    return [*out, (start, last, "end")]


def halos(limit: int, overlap: int) -> tuple[int, int]:
    """Bytes a worker needs before and after its range: a character has at most four."""
    return 4 * overlap + 4, 4 * limit + 8


def whole_character(raw: bytes, at: int) -> int:
    """`at`, or the end of the character of UTF-8 that it lies inside of. Bytes that are no part of a character are one each."""
    for start in range(at - 1, max(-1, at - 4), -1):
        lead = raw[start]
        if lead & 0xC0 != 0x80:
            end = start + (1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            if end > at:
                try:
                    raw[start:end].decode()
                    return end
                except UnicodeDecodeError:
                    pass
            break
    return at


def border_of(raw: bytes, at: int, limit: int) -> int:
    """Where the border of two ranges moves to, in bytes that hold both halos around it."""
    k = raw.find(b"\n", at, at + 4 * limit)
    if k >= 0:
        return k + 1
    m = _BLANK_BYTES.search(raw, at, at + 4 * limit)
    return m.end() if m else whole_character(raw, at)


def _parts(length: int, starts: list[int], ends: list[int]) -> tuple[int, int, int, int]:
    """Number of cuts, and lengths of the first, longest inner and last of the parts that lie between cuts [start, end)."""
    if not starts:
        return 0, length, 0, length
    return len(starts), starts[0], max((b - a for a, b in zip(ends, starts[1:])), default=0), length - ends[-1]


def section(raw: bytes, low: int, border: int, size: int, last: bool, limit: int, overlap: int, places: bool = True) -> tuple:
    """What SECTION holds from `length` on, for the range of an item from byte `border` on, `size` bytes long. raw: the item's bytes from `low` on, with both
    halos. Pieces have offsets in characters from the section's start, and in bytes in the item (with `places`, else null)."""
    a = border_of(raw, border - low, limit) if border else 0
    z = len(raw) if last else border_of(raw, border - low + size, limit)
    z = max(a, z)
    lead = whole_character(raw, max(0, a - 4 * overlap)) if a else 0
    head, own = raw[lead:a].decode(errors="surrogateescape"), raw[a:z].decode(errors="surrogateescape")
    text, d, n = head + own, len(head), len(own)
    lines, starts, ends = boundaries(text)
    got = cut(d, d + n, lines, list(merge(starts, ends)), limit, overlap, led=border > 0) if n or not border else []
    at: dict[int, int | None] = {}
    if places:
        known, byte = 0, low + lead
        for p in sorted({p for s, e, _ in got for p in (s, e)}):
            byte += len(text[known:p].encode(errors="surrogateescape"))
            at[p], known = byte, p
    feeds = [p - 1 - d for p in lines if p > d]
    first = bisect_right(ends, d)
    spans = [(max(x, d) - d, y - d) for x, y in zip(starts[first:], ends[first:])]
    return (n, *_parts(n, feeds, [p + 1 for p in feeds]), *_parts(n, [x for x, _ in spans], [y for _, y in spans]), [(s - d, e - d, at.get(s), at.get(e), k) for s, e, k in got])


def _table(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["id", "ranges", *(x.split()[0] for x in SECTION.split(", "))])


def sections(docs: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE, several: bool = True) -> DataFrame:
    """(id, ranges, SECTION) of texts. `several`: texts of several ranges of `size` bytes, which are dealt out over tasks; else texts of any length as one range each."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("raw"))
    before, after = halos(limit, overlap)
    if several:
        n = F.octet_length("raw")
        rows = rows.withColumn("ranges", F.ceil(n / F.lit(size)).cast("int")).select("id", "raw", "ranges", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)).alias("range_no"))
        low = F.greatest(F.lit(0), F.col("range_no") * size - before)
        rows = rows.select("id", "ranges", "range_no", low.alias("low"), F.substring("raw", low + 1, (F.col("range_no") + 1) * size + after - low).alias("part")).repartition("id", "range_no")
    else:
        rows = rows.select("id", F.lit(1).alias("ranges"), F.lit(0).alias("range_no"), F.lit(0).alias("low"), F.col("raw").alias("part"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _table([(i, m, k, *section(p, o, k * size, size, k == m - 1, limit, overlap, False)) for i, m, k, o, p in zip(b["id"], b["ranges"], b["range_no"], b["low"], b["part"])])

    return rows.mapInPandas(run, f"id {dict(docs.dtypes)[id_col]}, ranges int, {SECTION}")


def _by_ranges(docs: DataFrame, id_col: str, text: str, limit: int, overlap: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Sections of the texts longer than the limit: of those of one range, and of those of several, each read once."""
    long, one = F.length(text) > limit, F.octet_length(text) <= size
    return sections(docs.where(long & one), id_col, text, limit, overlap, size, False), sections(docs.where(long & ~one), id_col, text, limit, overlap, size)


def _emitted(single: DataFrame, ranged: DataFrame) -> DataFrame:
    """(id, piece_no, span_start, span_end, byte_start, byte_end, cut) of sections; lengths and numbers of pieces are summed up only over items of several ranges."""
    w = Window.partitionBy("id").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    several = ranged.select("id", "pieces", F.coalesce(F.sum("length").over(w), F.lit(0)).alias("at"), F.coalesce(F.sum(F.size("pieces")).over(w), F.lit(0)).cast("int").alias("before"))
    one = single.select("id", "pieces", F.lit(0).cast("long").alias("at"), F.lit(0).alias("before"))
    rows = one.unionByName(several).select("id", "at", "before", F.posexplode("pieces").alias("k", "p"))
    return rows.select("id", (F.col("before") + F.col("k")).alias("piece_no"), (F.col("at") + F.col("p.s")).alias("span_start"), (F.col("at") + F.col("p.e")).alias("span_end"), F.col("p.bs").alias("byte_start"), F.col("p.be").alias("byte_end"), F.col("p.cut").alias("cut"))


def split_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """(id, piece_no, span_start, span_end, cut) of all texts; those within the limit are one piece and known by their length in the JVM."""
    rows = _emitted(*_by_ranges(docs, id_col, text, limit, overlap, size)).drop("byte_start", "byte_end")
    n = F.length(text).cast("long")
    short = docs.where(F.length(text) <= limit).select(F.col(id_col).alias("id"), F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("span_start"), n.alias("span_end"), F.lit("end").alias("cut"))
    return rows.unionByName(short).withColumnRenamed("id", id_col)


def _longest(kind: str):
    """The longest line or run of an item from its sections in order: those inside sections, and those joined over borders."""
    cuts, head, most, tail = (f"{kind}_{x}" for x in ("cuts", "head", "most", "tail"))
    start = F.struct(F.lit(0).cast("long").alias("best"), F.lit(0).cast("long").alias("open"))

    def add(s, r):
        joined = s["open"] + r[head]
        best = F.greatest(s["best"], joined, F.when(r[cuts] > 0, r[most]).otherwise(0)).cast("long")
        return F.struct(best.alias("best"), F.when(r[cuts] > 0, r[tail]).otherwise(joined).cast("long").alias("open"))

    return F.aggregate(F.col("r"), start, add, lambda s: F.greatest(s["best"], s["open"]))


def cut_levels(docs: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """(id, cut_level) of each text longer than `limit`: `line` if no line (between line feeds) is longer, else `word` if no run without space,
    tab or line feed is, else `char`. From the stitched tables of sections."""
    return _levels(*_by_ranges(docs, id_col, text, limit, overlap, size), limit).withColumnRenamed("id", id_col)


def _levels(single: DataFrame, ranged: DataFrame, limit: int) -> DataFrame:
    row = F.struct("range_no", *(f"{k}_{x}" for k in ("line", "run") for x in ("cuts", "head", "most", "tail")))
    one = single.select("id", F.array(row).alias("r"))
    several = ranged.groupBy("id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    level = F.when(_longest("line") <= limit, "line").when(_longest("run") <= limit, "word").otherwise("char")
    return one.unionByName(several).select("id", level.alias("cut_level"))


def file_sections(spark: SparkSession, paths: list[str], limit: int = LIMIT, overlap: int = OVERLAP, size: int = FILE_RANGE) -> DataFrame:
    """(id, ranges, SECTION) of files, read in byte ranges of `size` with halos; `id` is the path. Missing files raise."""
    from pyarrow import fs

    def opened(path):
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    table = []
    for p in paths:
        f, q = opened(p)
        n = f.get_file_info(q).size
        if n is None:
            raise FileNotFoundError(p)
        m = max(1, -(-n // size))
        table += [(p, m, k, k * size, n) for k in range(m)]
    rows = spark.createDataFrame(table, "id string, ranges int, range_no int, border bigint, bytes bigint").repartition(max(1, min(len(table), 10_000)), "id", "range_no")
    before, after = halos(limit, overlap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, m, k, border, n in b.itertuples(index=False):
                f, q = opened(path)
                low, high = max(0, border - before), min(n, border + size + after)
                with f.open_input_file(q) as file:
                    file.seek(low)
                    raw = file.read(high - low)
                yield _table([(path, m, k, *section(raw, low, border, size, k == m - 1, limit, overlap))])

    return rows.mapInPandas(run, f"id string, ranges int, {SECTION}")


def split_files(spark: SparkSession, paths: list[str], limit: int = LIMIT, overlap: int = OVERLAP, size: int = FILE_RANGE) -> DataFrame:
    """(path, piece_no, span_start, span_end, byte_start, byte_end, cut) of UTF-8 files. span_*: offsets in characters, byte_*: in bytes.

    `paths` are what pyarrow's file systems open (local, hdfs, s3 ...), seen by all executors.
    """
    table = file_sections(spark, paths, limit, overlap, size)
    return _emitted(table.limit(0), table).withColumnRenamed("id", "path")


def file_levels(spark: SparkSession, paths: list[str], limit: int = LIMIT, overlap: int = OVERLAP, size: int = FILE_RANGE) -> DataFrame:
    """(path, cut_level) of files of any length, as `cut_levels` has them of texts."""
    table = file_sections(spark, paths, limit, overlap, size)
    return _levels(table.limit(0), table, limit).withColumnRenamed("id", "path")
