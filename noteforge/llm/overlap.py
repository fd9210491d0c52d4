"""Records that stand in two splits, exactly or nearly: a weighted cosine join between the splits.

A text is a vector over its phrases. Its words are folded (no case, accents, punctuation, spacing or look-alike characters) and cut into phrases of
about `length` words, between those neighbours whose common hash is divisible by `length`: where a phrase ends depends on the words there only, so an edit changes the
phrase it is in, or two, and no others. A phrase weighs the root of log(1 + N / n), where n of all N texts hold it; both are counted over all
documents, texts with the same words counting once for each side, as many copies of one text would else make its own phrases weigh little against an
edit. Vectors have length 1.

Inverted lists hold, of each vector, only what a pair at the threshold must share:
- A phrase that no text of the other side holds adds nothing to any product, and a vector whose other phrases' norm is below the threshold has no partner.
- Of each list the largest weights are known, by side and by class of size: texts whose numbers of words admit enough common words are in the same class or in
  neighbouring ones. The largest weight a partner can have for a phrase bounds what the phrase can add to a product.
- Phrases are put in one order for all texts, rarest first. From each place on, both the sum of weights times largest weights of partners and the norm bound
  what the rest of the vector can add. Only places where both reach the threshold are indexed: a pair that shares none of them has a smaller product.
- Entries meet only if the product of the norms that remain at both reaches the threshold, and if the numbers of words admit enough common words. Lists of frequent
  phrases are salted: one side's entries are dealt out over parts, the other's are copied to each, so that no task gets a whole long list.
- An entry brings along the numbers of its text's words by `BUCKETS` buckets of their hashes. The sum of the smaller numbers is at least the number of common
  words, so pairs are dropped where it is too small for the exact check, before anything else is read of them.

The exact product of each pair that is left is taken from its two vectors. Only pairs that reach the threshold have their texts read, for an
exact check of common words and of their order. Texts with the same words form a class, which takes part once for each side, however many copies it has.

Nulls: a null text, or one without words, has no partner; a null split counts as neither side. Copies within a class are all reported.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteforge.llm.normalise import fold
from noteforge.llm.shared import discard, written

#: At COMMON with scattered edits the cosine is 0.25 on average (README: what falls below the threshold). What lies above is left to the exact check.
LENGTH, THRESHOLD = 6, 0.2
#: Least share of common words, of the longer text's, and of those in the same order.
COMMON, ORDERED = 0.79, 0.65
#: Buckets of words by hash; documents of a list that one task pairs with all entries of the other side.
BUCKETS, LIST = 128, 4096

_WORD = re.compile(r"[^\W_]+")
_HASHES: dict[str, int] = {}


#: Whether words have a character, by code point; of each Latin-1 character itself, if so, else a blank.
_IN_WORDS = np.zeros(0x110000, bool)
for _m in _WORD.finditer("".join(map(chr, range(0x110000)))):
    _IN_WORDS[_m.start() : _m.end()] = True
_BLANKED = bytes(k if _IN_WORDS[k] else 32 for k in range(256))


def worded(text: str | None) -> str:
    """The words of a text, folded, with blanks between them and nothing else."""
    t = fold(text)
    try:
        return t.encode("latin-1").translate(_BLANKED).decode("latin-1").strip()
    except UnicodeEncodeError:
        points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.where(_IN_WORDS[points], points, np.uint32(32)).tobytes().decode("utf-32-le").strip()


def words_of(text: str | None) -> list[str]:
    return worded(text).split()


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, end to end, and the texts' numbers of words."""
    joined = [worded(x) for x in texts]
    sizes = np.zeros(len(texts), np.int64)
    if there := [k for k, x in enumerate(joined) if x]:
        lists = pc.ascii_split_whitespace(pa.array([joined[k] for k in there], pa.large_string()))
        sizes[there] = lists.value_lengths().to_numpy()
        words = lists.flatten().dictionary_encode()
        return hashes_of(words.dictionary.to_pylist())[words.indices.to_numpy()], sizes
    return np.zeros(0, np.uint64), sizes


def hashes_of(words: list[str]) -> np.ndarray:
    """64-bit hashes of words; those of frequent words are kept."""
    if len(_HASHES) > 500_000:
        _HASHES.clear()
    try:
        return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    except KeyError:
        _HASHES.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(words) - _HASHES.keys())
        return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Odd factors for the places of words in a phrase.
_PLACES = np.random.default_rng(1).integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def phrases_of(hashes: np.ndarray, sizes: np.ndarray | None = None, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the phrases of texts, given those of their words end to end and the texts' numbers of words, each at least 1 (by default one text);
    and the numbers of phrases."""
    n = len(hashes)
    sizes = np.array([n]) if sizes is None else sizes
    begins = np.cumsum(sizes) - sizes
    new = np.zeros(n, bool)
    new[1:] = _mixed((hashes[:-1] * _A) ^ hashes[1:]) % np.uint64(length) == 0
    new[begins] = True
    start = np.flatnonzero(new)
    place = np.arange(n) - np.repeat(start, np.diff(np.r_[start, n]))
    made = _mixed(np.add.reduceat(_mixed(hashes) * _PLACES[place % len(_PLACES)], start))
    owner = np.searchsorted(begins, start, side="right") - 1
    order = np.argsort(made)
    order = order[np.argsort(owner[order].astype(np.uint16 if len(sizes) <= 1 << 16 else np.int64), kind="stable")]  # sixteen bits are sorted by radix
    made, owner = made[order], owner[order]
    first = np.r_[True, (made[1:] != made[:-1]) | (owner[1:] != owner[:-1])]
    return made[first], np.bincount(owner[first], minlength=len(sizes))


def bags_of(hashes: np.ndarray, sizes: np.ndarray | None = None) -> list[bytes]:
    """Of each text the numbers of words by bucket of their hash, one byte each; 255 stands for that many or more."""
    sizes = np.array([len(hashes)]) if sizes is None else sizes
    at = np.repeat(np.arange(len(sizes)) * BUCKETS, sizes) + (hashes % np.uint64(BUCKETS)).astype(np.int64)
    counts = np.minimum(np.bincount(at, minlength=BUCKETS * len(sizes)), 255).astype(np.uint8).tobytes()
    return [counts[k : k + BUCKETS] for k in range(0, len(counts), BUCKETS)]


def may_share(a: list[bytes] | pa.BinaryArray, b: list[bytes] | pa.BinaryArray, needed: np.ndarray) -> np.ndarray:
    """Of pairs of bags, whether as many words as needed may be common: never false where they are. A bucket full on both sides tells nothing."""
    x, y = (pa.array(z, pa.binary()).cast(pa.binary(BUCKETS)) for z in (a, b))
    x, y = (np.frombuffer(z.buffers()[1], np.uint8, len(z) * BUCKETS, z.offset * BUCKETS).reshape(-1, BUCKETS) for z in (x, y))
    least = np.minimum(x, y)
    return (least.sum(1, dtype=np.int64) >= needed) | (least == 255).any(1)


def ordered_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two lists of words (rows of bits as whole numbers)."""
    if len(a) < len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for k, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def alike(a: list[str], b: list[str], common: float = COMMON, ordered: float = ORDERED) -> bool:
    """The exact check: common words, with repetition, and common words in order, both as shares of the longer text."""
    most = max(len(a), len(b))
    if not most or min(len(a), len(b)) < common * most:
        return False
    return sum((Counter(a) & Counter(b)).values()) >= common * most and ordered_words(a, b) >= ordered * most


def split_side(split: Column) -> Column:
    """1 for the training split, 0 for those of evaluation, else null; spelling of case and blanks apart."""
    s = F.lower(F.trim(split))
    return F.when(s == "train", 1).when(s.isin("validation", "test"), 0)


def by_text(rows: DataFrame, run: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """What `run` makes of batches of whole texts, given where each begins. `rows` has one row for each text, with a null `df`, and others for its phrases; a batch has
    the row of the text first, then its phrases, rarest first. Rows are dealt out and sorted by `node` alone, which the JVM does by radix, and put in order here."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            node = b["node"].to_numpy()
            # a batch ends where the last node of what has come begins
            if kept and node[0] != last:
                yield made(kept)
                kept = []
            last = node[-1]
            at = int(np.searchsorted(node, last))
            if at:
                yield made([*kept, b.slice(0, at)])
                kept = []
            kept.append(b.slice(at))
        if kept:
            yield made(kept)

    def made(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.concat_batches(kept)
        node = b["node"].to_numpy()
        group = np.cumsum(np.r_[False, node[1:] != node[:-1]])
        group = 2 * group + b["side"].to_numpy()
        order = np.lexsort((_numbers(b["s"]), _numbers(b["df"]), group.astype(np.uint16) if group[-1] < 1 << 16 else group))
        b = b.take(pa.array(order))
        return run(b, np.flatnonzero(b["df"].is_null().to_numpy(zero_copy_only=False)))

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(whole, schema)


def _numbers(column: pa.Array, null: float = 0) -> np.ndarray:
    return column.fill_null(pa.scalar(null, column.type)).to_numpy(zero_copy_only=False)


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)


def weighted(heads: DataFrame, threshold: float, common: float) -> DataFrame:
    """(side, node, id, words, bag, cls, df, s, w) of the texts in `heads` that may have a partner: phrases that the other side holds, rarest first, the number of
    texts with each, and their weights in the vector of length 1. `cls`: the class of size; those of two texts with enough common words differ by 1 at most."""
    total = float(heads.count())
    postings = heads.select("side", "node", F.explode("s").alias("s"))
    stats = postings.groupBy("s").agg(F.count("*").cast("int").alias("df"), (F.max(F.col("side") == 0) & F.max(F.col("side") == 1)).alias("both")).where("df > 1")
    # phrases of one text only are not sent around: each adds the same to the norm; of those that the other side hasn't, only the number of texts is
    known = postings.where("side IS NOT NULL").join(stats, "s").select("side", "node", "df", F.when(F.col("both"), F.col("s")).alias("s"))
    own = heads.where("side IS NOT NULL").select("side", "node", F.lit(None).cast("int").alias("df"), F.lit(None).cast("bigint").alias("s"), "id", "words", "bag", F.size("s").alias("size"))

    def run(b: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(np.r_[starts, b.num_rows])
        mass = np.log1p(total / _numbers(b["df"], 1))
        mass[starts] = 0
        texts = b.take(pa.array(starts))
        norm = np.sqrt(np.add.reduceat(mass, starts) + (_numbers(texts["size"]) - (sizes - 1)) * np.log1p(total))
        w = (np.sqrt(mass) / np.repeat(norm, sizes)).astype(np.float32)
        both = b["s"].is_valid().to_numpy(zero_copy_only=False)
        good = np.add.reduceat(np.where(both, w.astype(np.float64) ** 2, 0), starts) >= threshold * threshold - 1e-6
        numbers = np.add.reduceat(both.astype(np.int64), starts)[good]
        at = np.flatnonzero(both & np.repeat(good, sizes))
        z = b.select(["df", "s"]).take(pa.array(at))
        texts = texts.filter(pa.array(good))
        cls = np.floor(np.log(_numbers(texts["words"]).astype(np.float64)) / (1e-9 - np.log(common))).astype(np.int32)
        columns = [texts[c] for c in ("side", "node", "id", "words", "bag")] + [pa.array(cls)] + [_lists(x, numbers) for x in (z["df"], z["s"], pa.array(w[at]))]
        return pa.RecordBatch.from_arrays(columns, ["side", "node", "id", "words", "bag", "cls", "df", "s", "w"])

    kind = dict(heads.dtypes)["id"]
    schema = f"side int, node bigint, id {kind}, words int, bag binary, cls int, df array<int>, s array<bigint>, w array<float>"
    return by_text(known.unionByName(own, allowMissingColumns=True), run, schema)


def indexed(vectors: DataFrame, threshold: float) -> DataFrame:
    """(side, node, words, bag, z array<struct<s, df, rest>>): what of each vector is indexed, with the norm that remains from each place on."""
    z = F.explode(F.arrays_zip("df", "s", "w"))
    entries = vectors.select("side", "node", "cls", z.alias("z")).select("side", "node", "cls", "z.*")
    largest = entries.groupBy("s", "side", "cls").agg(F.max("w").alias("b"))
    # phrase, side and class as one number, which is sorted by radix; should two have the same, the larger bound holds for both
    key = lambda side, cls: F.col("s").bitwiseXOR((cls * 2 + side).cast("bigint")).alias("key")
    # what the other side's texts of this class or a neighbouring one can weigh at most; without any, the phrase adds nothing
    partners = largest.select(F.explode(F.array(*(key(1 - F.col("side"), F.col("cls") + k) for k in (-1, 0, 1)))).alias("key"), "b").groupBy("key").agg(F.max("b").alias("b"))
    keyed = entries.select(key(F.col("side"), F.col("cls")), "side", "cls", "node", "df", "w")
    bounded = keyed.join(partners, "key").select("side", "node", "df", F.col("key").bitwiseXOR((F.col("cls") * 2 + F.col("side")).cast("bigint")).alias("s"), "w", "b")
    own = vectors.select("side", "node", F.lit(None).cast("int").alias("df"), F.lit(None).cast("bigint").alias("s"), "words", "bag")

    def run(b: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(np.r_[starts, b.num_rows])
        w, most = (_numbers(b[c]).astype(np.float64) for c in ("w", "b"))

        def after(x: np.ndarray) -> np.ndarray:
            # sums from the commonest phrases up to each place
            sums = np.cumsum(x)
            return np.repeat(sums[starts + sizes - 1], sizes) - sums + x

        m = after(w * w)
        good = (m >= threshold * threshold - 1e-6) & (after(w * most) >= threshold - 1e-6)
        good[starts] = False
        numbers = np.add.reduceat(good.astype(np.int64), starts)
        at = pa.array(np.flatnonzero(good))
        entry = pa.StructArray.from_arrays([b["s"].take(at), b["df"].take(at), pa.array(np.sqrt(m[good]).astype(np.float32))], ["s", "df", "rest"])
        texts = b.select(["side", "node", "words", "bag"]).take(pa.array(starts[numbers > 0]))
        return pa.RecordBatch.from_arrays([*texts.columns, _lists(entry, numbers[numbers > 0])], [*texts.schema.names, "z"])

    return by_text(bounded.unionByName(own, allowMissingColumns=True), run, "side int, node bigint, words int, bag binary, z array<struct<s: bigint, df: int, rest: float>>")


def candidates(index: DataFrame, threshold: float, common: float, most: int = LIST) -> DataFrame:
    """(node_0, node_1) of entries that meet in a list and may share enough words. A list of n texts is dealt out over 1 + n / `most` parts."""

    def lists(k: int) -> DataFrame:
        parts = 1 + F.floor(F.col("df") / F.lit(most)).cast("int")
        salt = F.explode(F.sequence(F.lit(0), parts - 1)) if k == 0 else F.pmod(F.xxhash64("node"), parts).cast("int")
        x = index.where(F.col("side") == k).select("node", "words", "bag", F.explode("z").alias("z")).select("node", "words", "bag", "z.*")
        x = x.select("s", salt.alias("salt"), *(F.col(c).alias(f"{c}_{k}") for c in ("node", "words", "rest", "bag")))
        # as one number, which is sorted by radix; should two lists have the same, their pairs are told apart by the exact products
        return x.withColumn("list", F.xxhash64("s", "salt")).drop("s", "salt")

    a, b = F.col("words_0"), F.col("words_1")
    meets = (F.col("rest_0") * F.col("rest_1") >= threshold - 1e-5) & (a >= b * common) & (b >= a * common) & (F.col("node_0") != F.col("node_1"))
    met = lists(0).join(lists(1), "list").where(meets).select("node_0", "node_1", (F.greatest(a, b) * common).alias("needed"), "bag_0", "bag_1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                good = may_share(b["bag_0"], b["bag_1"], b["needed"].to_numpy())
                yield b.select(["node_0", "node_1"]).filter(pa.array(good))

    return met.mapInArrow(run, "node_0 bigint, node_1 bigint").distinct()


def overlaps(docs: DataFrame, id_col: str = "doc_id", text: str = "text", side: Column | None = None, threshold: float = THRESHOLD, common: float = COMMON, ordered: float = ORDERED) -> tuple[DataFrame, DataFrame]:
    """(members, links). members (id, side, node): the class of each row that has words. links (node_0, node_1, cosine): classes of side 0 and of side 1
    whose texts are the same (cosine 1) or nearly. Every pair of a member of node_0 on side 0 and one of node_1 on side 1 is a case."""
    side = split_side(F.col("split")) if side is None else side
    rows = docs.select(F.col(id_col).alias("id"), side.alias("side"), F.col(text).alias("text"))
    kind = dict(docs.dtypes)[id_col]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # many texts at once, but a bounded number of characters
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                h, sizes = hashed(part["text"].to_pylist())
                there = np.flatnonzero(sizes)
                if not len(there):
                    continue
                sizes = sizes[there]
                ends = np.cumsum(sizes).tolist()
                nodes = [xxhash.xxh3_64_intdigest(h[s:e].tobytes()) - (1 << 63) for s, e in zip([0, *ends], ends)]
                phrases, counts = phrases_of(h, sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(phrases.view(np.int64)))
                columns = [part["id"].take(pa.array(there)), part["side"].take(pa.array(there)), pa.array(nodes, pa.int64()), pa.array(sizes.astype(np.int32)), pa.array(bags_of(h, sizes), pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(columns, ["id", "side", "node", "words", "bag", "s"])

    # texts are read and cut into words once; what follows works on numbers. Tables are dropped when nothing reads them any more
    table = written(rows.where(F.col("text").isNotNull()).mapInArrow(vectors, f"id {kind}, side int, node bigint, words int, bag binary, s array<bigint>"), "overlap-phrases")
    members = written(table.where("side IS NOT NULL").select("id", "side", "node"), "overlap-members")
    # one member of each class stands for it: in the counts, in the lists, and in the check
    heads = written(table.groupBy("side", "node").agg(F.min_by(F.struct("id", "words", "bag", "s"), "id").alias("h")).select("side", "node", "h.*"), "overlap-classes")
    discard(table)
    weights = written(weighted(heads, threshold, common), "overlap-weights")
    discard(heads)
    index = written(indexed(weights, threshold), "overlap-index")
    pairs = written(candidates(index, threshold, common), "overlap-pairs")
    discard(index)

    # exact products, from the vectors of both
    vector = weights.select("side", "node", "id", "s", "w")
    with_0 = pairs.join(vector.where("side = 0").select(F.col("node").alias("node_0"), F.col("id").alias("id_0"), F.col("s").alias("s_0"), F.col("w").alias("w_0")), "node_0")
    with_both = with_0.join(vector.where("side = 1").select(F.col("node").alias("node_1"), F.col("id").alias("id_1"), F.col("s").alias("s_1"), F.col("w").alias("w_1")), "node_1")

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cosines = []
            for x, u, y, v in zip(b["s_0"], b["w_0"], b["s_1"], b["w_1"]):
                _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                cosines.append(float(np.dot(u[i].astype(np.float64), v[j].astype(np.float64))))
            made = b[["node_0", "node_1", "id_0", "id_1"]].assign(cosine=cosines)
            yield made[made["cosine"] >= threshold - 1e-6]

    close = written(with_both.mapInPandas(multiply, f"node_0 bigint, node_1 bigint, id_0 {kind}, id_1 {kind}, cosine double"), "overlap-close")
    discard(weights)
    discard(pairs)

    # the exact check, on the texts of what is left, brought together by pair
    ends = close.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("id_0").alias("id")), F.struct(F.lit(1).alias("side"), F.col("id_1").alias("id")))).alias("e"), "node_0", "node_1", "cosine").select("e.*", "node_0", "node_1", "cosine")
    both = ends.join(rows.select("id", "text"), "id").groupBy("node_0", "node_1", "cosine").agg(F.max(F.when(F.col("side") == 0, F.col("text"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("text"))).alias("b"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = [alike(words_of(x), words_of(y), common, ordered) for x, y in zip(b["a"], b["b"])]
            yield b.loc[good, ["node_0", "node_1", "cosine"]]

    near = both.mapInPandas(verify, "node_0 bigint, node_1 bigint, cosine double")
    same = members.groupBy("node").agg(F.count_if(F.col("side") == 0).alias("n_0"), F.count_if(F.col("side") == 1).alias("n_1")).where("n_0 > 0 AND n_1 > 0")
    links = written(near.unionByName(same.select(F.col("node").alias("node_0"), F.col("node").alias("node_1"), F.lit(1.0).alias("cosine"))), "overlap-links")
    discard(close)
    return members, links


def overlap_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: all cases, one row for each pair of documents."""
    a = members.where("side = 0").select(F.col("id").alias("x"), F.col("node").alias("node_0"))
    b = members.where("side = 1").select(F.col("id").alias("y"), F.col("node").alias("node_1"))
    return links.join(a, "node_0").join(b, "node_1").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def overlap_counts(docs: DataFrame, members: DataFrame, links: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(split, source, n_documents, n_overlapping, n_links) for each split and source as spelled, null sources as one: documents in all, those with
    a partner on the other side, and their links to documents there. Counted by class, without listing pairs."""
    size = members.groupBy("node").agg(F.count_if(F.col("side") == 0).alias("n_0"), F.count_if(F.col("side") == 1).alias("n_1"))
    by_0 = links.join(size.select(F.col("node").alias("node_1"), "n_1"), "node_1").groupBy(F.col("node_0").alias("node")).agg(F.sum("n_1").alias("partners")).withColumn("side", F.lit(0))
    by_1 = links.join(size.select(F.col("node").alias("node_0"), "n_0"), "node_0").groupBy(F.col("node_1").alias("node")).agg(F.sum("n_0").alias("partners")).withColumn("side", F.lit(1))
    partners = members.join(by_0.unionByName(by_1), ["side", "node"]).select(F.col("id").alias(id_col), "partners")
    return (
        docs.select(id_col, "split", "source")
        .join(partners, id_col, "left")
        .groupBy("split", "source")
        .agg(F.count("*").alias("n_documents"), F.count("partners").alias("n_overlapping"), F.coalesce(F.sum("partners"), F.lit(0)).alias("n_links"))
    )
