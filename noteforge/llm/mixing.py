"""Mixing sources to target weights, in an order along which each source's share follows a schedule.

Each source has a share of the tokens as a function of the position t in the mix, from 0 to 1. By default it moves linearly through its target,
from nearer to an equal share at the start to as much beyond it at the end, so that its integral is the target weight. The integral of the schedule is
the source's cumulative demand for tokens; a record whose tokens end at c of its source's sequence belongs where the demand reaches c. The
demand is inverted in closed form, and records are sorted by range of position.

Size: targets are those of sources that have tokens, divided by their sum; the total is the largest, up to `budget`, at which every source
reaches its share within its repeats. A source runs through its records in an order by hash, again and again, until its demand is met; the last
record is used if at least half of it is demanded. Running sums are taken by source and shard, and over shards, so no task gets a whole source.

Nulls: records with a null text or source, or a source without a target, aren't used; targets with a null source, or a null or non-positive
weight, are ignored; null repeats count as 1. Sources are compared without case, outer blanks and with `-` and blanks as `_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noteforge.llm.packing import token_counts
from noteforge.llm.shared import written


def plain_source(source: Column) -> Column:
    """One spelling of a source."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s-]+", "_")


def demand(available: dict[str, int], targets: dict[str, tuple[float, int]], budget: int | None = None, curve: float = 0.5) -> dict[str, tuple[float, float, float, int]]:
    """For each source with tokens: (share, tokens demanded, slope, tokens available). The share at t is share + slope * (1 - 2 t)."""
    there = {s: w for s, (w, _) in targets.items() if available.get(s)}
    total = sum(there.values())
    if not total:
        return {}
    share = {s: w / total for s, w in there.items()}
    size = min([float(budget if budget is not None else sum(available[s] for s in there)), *(available[s] * targets[s][1] / share[s] for s in there)])
    even = 1 / len(there)
    # no share may be negative at either end: the slopes, which sum to 0, are scaled together
    most = min([curve, *(share[s] / abs(even - share[s]) for s in there if even != share[s])])
    return {s: (share[s], size * share[s], most * (even - share[s]), available[s]) for s in there}


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str, budget: int | None = None, curve: float = 0.5, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = 11, per_shard: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(mixed, report). mixed (id, source, copy, n_tokens, position), sorted by position. report (source, target_weight, actual_share, n_tokens,
    n_records, n_available, most_used, max_repeats): a row for each target, with what was reached of it."""
    # one row a source; targets are as many as their table names, not as the records
    wanted = {r["s"]: (float(r["weight"]), int(r["max_repeats"] if r["max_repeats"] is not None else 1)) for r in targets.where("source IS NOT NULL AND weight > 0").select(plain_source(F.col("source")).alias("s"), "weight", "max_repeats").collect()}
    keyed = docs.withColumn("__source", plain_source(F.col(source))).where(F.col("__source").isin(*wanted) if wanted else F.lit(False))
    sized = written(token_counts(keyed, tokenizer, id_col, text, ("__source",)).where("n_tokens > 0").select(F.col(id_col).alias("id"), F.col("__source").alias("source"), "n_tokens"), "mix-sizes")
    found = {r["source"]: (r["t"], r["n"]) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    plan = demand({s: t for s, (t, _) in found.items()}, wanted, budget, curve)
    spark = docs.sparkSession
    rows = [(s, w, r, *plan.get(s, (0.0, 0.0, 0.0, found.get(s, (0, 0))[0]))) for s, (w, r) in wanted.items()]
    table = spark.createDataFrame(rows, "source string, target_weight double, max_repeats int, share double, demanded double, slope double, available bigint")

    shards = max(1, -(-max((n for _, n in found.values()), default=0) // per_shard))
    h = F.xxhash64(F.lit(seed), "id")
    sharded = sized.withColumn("h", h).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int"))
    earlier = Window.unboundedPreceding, -1
    sums = sharded.groupBy("source", "shard").agg(F.sum("n_tokens").alias("t"))
    sums = sums.select("source", "shard", F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("shard").rowsBetween(*earlier)), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("source", "shard").orderBy("h", "id").rowsBetween(*earlier)), F.lit(0))
    placed = sharded.withColumn("within", within).join(sums, ["source", "shard"]).join(F.broadcast(table), "source")
    begin = F.col("base") + F.col("within")
    half = begin + F.col("n_tokens") / 2
    copies = F.least(F.col("max_repeats"), F.floor((F.col("demanded") - half) / F.col("available")).cast("int") + 1)
    used = placed.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(0, copies - 1)")))
    # share * t + slope * (t - t^2) = part of the demand up to the middle of the record, as a part of the whole mix
    c = F.least(F.lit(1.0), (half + F.col("copy") * F.col("available")) / F.col("demanded")) * F.col("share")
    b, a = F.col("share") + F.col("slope"), -F.col("slope")
    position = F.when(F.abs(a) < 1e-12, c / b).otherwise((2 * c) / (b + F.sqrt(F.greatest(F.lit(0.0), b * b + 4 * a * c))))
    mixed = used.select(F.col("id").alias(id_col), "source", "copy", F.col("n_tokens").cast("int").alias("n_tokens"), F.least(F.lit(1.0), position).alias("position"))

    reached = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_records"), (F.max("copy") + 1).alias("most_used"))
    report = table.select("source", "target_weight", "max_repeats", F.col("available").alias("n_available")).join(reached, "source", "left").na.fill(0)
    share = F.try_divide(F.col("n_tokens").cast("double"), F.sum("n_tokens").over(Window.partitionBy()))
    report = report.select("source", "target_weight", F.coalesce(share, F.lit(0.0)).alias("actual_share"), "n_tokens", "n_records", "n_available", "most_used", "max_repeats")
    return mixed.orderBy("position", "source", id_col, "copy"), report
