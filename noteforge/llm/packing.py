"""Filling containers of fixed capacity with items, never splitting an item unless it alone exceeds the capacity.

Where an item goes depends on its size only, so the plan is made for the table of sizes, which has at most one row for each size up to
the capacity however many items there are. Items larger than a third of the capacity are matched: at most two of them fit a
bin, the largest with the largest that still fits beside it. Smaller items, largest first, go to the smallest gap that holds them (best
fit), and open new bins when there is none. A step of the plan places a whole run of equal items into a whole run of equal bins.

Items find their bin by their rank among the items of their size. Ranks come from counts by size and shard, summed up over shards, and
ranks within shards, so no task gets all items of a frequent size.

An item larger than the capacity is cut into full containers and a rest. Items of size 0 (empty texts) share bin 0 with others and take no
room; a null text or size gives no row. Ties go by id. Rows need unique ids.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noteforge.llm.shared import count_tokens, written

CAPACITY = 512


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, n_tokens) of whole texts under the tokenizer in the file `tokenizer`; null texts count null."""
    names = list(dict.fromkeys([id_col, *keep]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, there = b[names].copy(), b["__text"].notna()
            counts = iter(count_tokens(b["__text"][there].tolist(), tokenizer))
            out["n_tokens"] = pd.array([next(counts) if x else None for x in there], dtype="Int64")
            yield out

    types = dict(docs.dtypes)
    return docs.select(*names, F.col(text).alias("__text")).mapInPandas(run, ", ".join(f"`{c}` {types[c]}" for c in names) + ", n_tokens bigint")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Steps (size, first rank, number, first bin, offset in the bin) and the number of bins: items of a size with ranks r0 ... r0 + m - 1 go to
    bins b0 ... b0 + m - 1, one each."""
    left = {s: n for s, n in counts.items() if n > 0 and 0 < s <= capacity}
    rank: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs (first bin, number)
    steps, bins = [], 0

    def place(size: int, m: int, first: int, gap: int) -> None:
        steps.append((size, rank[size], m, first, capacity - gap))
        rank[size] += m
        left[size] -= m

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for s in large:
        while left[s]:
            mate = next((x for x in large if left[x] and x <= capacity - s and (x < s or left[s] > 1)), None)
            m = left[s] if mate is None else left[s] // 2 if mate == s else min(left[s], left[mate])
            first, bins = bins, bins + m
            place(s, m, first, capacity)
            gap = capacity - s
            if mate is not None:
                place(mate, m, first, gap)
                gap -= mate
            if gap:
                gaps[gap].append((first, m))
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            gap = min((g for g, runs in gaps.items() if g >= s and runs), default=None)
            if gap is None:
                m = -(-left[s] // (capacity // s))
                gaps[capacity].append((bins, m))
                bins, gap = bins + m, capacity
            first, there = gaps[gap].pop()
            m = min(left[s], there)
            place(s, m, first, gap)
            if there > m:
                gaps[gap].append((first + m, there - m))
            if gap > s:
                gaps[gap - s].append((first, m))
    return steps, bins


def pack(sizes: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", size: str = "n_tokens", per_shard: int = 200_000) -> DataFrame:
    """(id, piece_no, n_tokens, bin_id, bin_offset): a row for each item, or for each piece of an item larger than the capacity."""
    item = F.col(size)
    pieces = F.greatest(F.lit(1), F.ceil(item / F.lit(capacity)).cast("int"))
    items = sizes.where(item.isNotNull()).select(F.col(id_col).alias("id"), item.cast("long").alias("n"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece_no"))
    items = items.select("id", "piece_no", F.least(F.lit(capacity), F.col("n") - F.col("piece_no") * capacity).cast("int").alias("n_tokens"))
    counted = items.groupBy("n_tokens").count().collect()  # at most capacity + 1 rows
    shards = max(1, -(-max((r["count"] for r in counted), default=0) // per_shard))
    steps, _ = plan({r["n_tokens"]: r["count"] for r in counted}, capacity)
    by_size: dict[int, tuple] = {}
    for s in {x[0] for x in steps}:
        own = sorted(x[1:] for x in steps if x[0] == s)
        by_size[s] = tuple(np.array(c, np.int64) for c in zip(*own))

    sharded = items.withColumn("shard", F.pmod(F.xxhash64("id", "piece_no"), F.lit(shards)).cast("int"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("n_tokens").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sharded.groupBy("n_tokens", "shard").agg(F.count("*").alias("m")).select("n_tokens", "shard", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("n_tokens", "shard").orderBy("id", "piece_no")) - 1
    ranked = sharded.withColumn("within", within).join(offsets, ["n_tokens", "shard"]).select("id", "piece_no", "n_tokens", (F.col("before") + F.col("within")).alias("rank"))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            where, at = np.zeros(len(b), np.int64), np.zeros(len(b), np.int32)
            n, rank = b["n_tokens"].to_numpy(), b["rank"].to_numpy()
            for s in np.unique(n):
                if s:
                    ranks, _, bins, offset = by_size[int(s)]
                    own = n == s
                    k = np.searchsorted(ranks, rank[own], side="right") - 1
                    where[own], at[own] = bins[k] + rank[own] - ranks[k], offset[k]
            yield pd.DataFrame({"id": b["id"], "piece_no": b["piece_no"], "n_tokens": n, "bin_id": where, "bin_offset": at})

    kind = dict(sizes.dtypes)[id_col]
    return ranked.mapInPandas(assign, f"id {kind}, piece_no int, n_tokens int, bin_id bigint, bin_offset int").withColumnRenamed("id", id_col)


def pack_texts(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`pack` of the texts of `docs`, measured in tokens; texts are tokenized once and only their sizes kept."""
    return pack(written(token_counts(docs, tokenizer, id_col, text), "token-counts"), capacity, id_col)


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(n_bins, n_tokens, least_bins, fill): how many bins are used, the fewest that could hold as many tokens, and the share of room in use."""
    r = packed.where("n_tokens > 0").agg(F.countDistinct("bin_id").alias("n_bins"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    return r.select("n_bins", "n_tokens", F.ceil(F.col("n_tokens") / F.lit(capacity)).alias("least_bins"), F.try_divide(F.col("n_tokens").cast("double"), F.col("n_bins") * capacity).alias("fill"))
