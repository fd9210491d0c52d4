import random
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from noteforge.llm import mixing, packing
from noteforge.llm.shared import count_tokens

TOKENIZER = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=12))
def test_plans_place_every_item_within_capacity(counts):
    steps, bins = packing.plan(counts, 64)
    fill, seen, large = defaultdict(int), defaultdict(set), defaultdict(int)
    for size, rank, m, first, offset in steps:
        for k in range(m):
            assert fill[first + k] == offset
            fill[first + k] += size
            large[first + k] += 3 * size > 64
            seen[size].add(rank + k)
    assert all(0 < f <= 64 for f in fill.values()) and len(fill) == bins and all(n <= 2 for n in large.values())
    assert {s: len(x) for s, x in seen.items()} == {s: n for s, n in counts.items() if n}
    total = sum(s * n for s, n in counts.items())
    assert bins <= 1.5 * total / 64 + 1 + sum(n for s, n in counts.items() if 3 * s > 64)


def test_pack_whole_items_and_cut_only_what_exceeds(spark):
    r = random.Random(1)
    rows = [(i, r.choice([7, 7, 7, r.randint(1, 900), 512, 513]), 5, 1) for i in range(3000)] + [(9001, 0, 0, 0), (9002, None, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, bin_id int, shard int")
    got = packing.pack(df, per_shard=200).collect()
    use, spans, by = defaultdict(int), defaultdict(list), defaultdict(list)
    for x in got:
        use[x["bin_id"]] += x["n_tokens"]
        spans[x["bin_id"]].append((x["bin_offset"], x["n_tokens"]))
        by[x["doc_id"]].append(x["n_tokens"])
    assert max(use.values()) <= 512
    for s in spans.values():
        s = sorted(x for x in s if x[1])
        assert all(a + n <= b for (a, n), (b, _) in zip(s, s[1:]))
    for i, n, *_ in rows:
        if n is None:
            assert i not in by
        else:
            assert sum(by[i]) == n and len(by[i]) == max(1, -(-n // 512))
    report = packing.packing_report(packing.pack(df)).first()
    assert report["fill"] > 0.97
    assert packing.pack(df.limit(0)).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Bonjour à tous"), (2, ""), (3, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(df, TOKENIZER).collect()}
    assert got == {1: count_tokens(["Bonjour à tous"], TOKENIZER)[0], 2: 0, 3: None}
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        assert count_tokens(["un deux"], public_tokenizers.path(name))[0] > 1


def test_demand_keeps_within_repeats_and_sums_up():
    d = mixing.demand({"a": 100, "b": 10}, {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 5)})
    assert set(d) == {"a", "b"}
    assert abs(sum(x[0] for x in d.values()) - 1) < 1e-12 and abs(sum(x[2] for x in d.values())) < 1e-12
    assert d["b"][1] <= 20 + 1e-9 and all(x[0] - abs(x[2]) >= -1e-12 for x in d.values())
    assert mixing.demand({}, {"a": (1.0, 1)}) == {}


def test_mix_reaches_its_targets_in_order(spark):
    r = random.Random(2)
    docs = [(i, r.choice(["A", "a ", "A"]) if i % 3 else r.choice(["b-x", "B x"]), " ".join(["mot"] * r.randint(1, 30)), "c") for i in range(1500)]
    docs += [(5000, None, "x", ""), (5001, "z", "x", ""), (5002, "a", None, ""), (5003, "a", "", "")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string, copy string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b_x", 0.4, 3), ("none", 0.1, 2), (None, 0.5, 1), ("q", None, None)], "source string, weight double, max_repeats int")
    mixed, report = mixing.mix(df, targets, TOKENIZER, per_shard=100)
    rows = mixed.collect()
    assert [x["position"] for x in rows] == sorted(x["position"] for x in rows) and 0 <= rows[0]["position"] and rows[-1]["position"] <= 1
    rep = {x["source"]: x for x in report.collect()}
    assert abs(rep["a"]["actual_share"] - 5 / 9) < 0.01 and abs(rep["b_x"]["actual_share"] - 4 / 9) < 0.01 and rep["none"]["actual_share"] == 0
    used = defaultdict(int)
    for x in rows:
        used[x["doc_id"], x["copy"]] += 1
    assert max(used.values()) == 1 and max(c for _, c in used) < 3 and not any(i >= 5000 for i, _ in used)
    # the share of the first half follows the schedule's integral
    first = [x for x in rows if x["position"] < 0.5]
    a = sum(x["n_tokens"] for x in first if x["source"] == "a") / sum(x["n_tokens"] for x in first)
    share, _, slope, _ = mixing.demand({"a": rep["a"]["n_available"], "b_x": rep["b_x"]["n_available"]}, {"a": (0.5, 1), "b_x": (0.4, 3)})["a"]
    assert abs(a - (share * 0.5 + slope * 0.25) / 0.5) < 0.02
    empty, r2 = mixing.mix(df.limit(0), targets, TOKENIZER)
    assert empty.count() == 0 and r2.count() == 3


@pytest.mark.parametrize("x,y", [("Chu-Notes ", "chu_notes"), ("A  b", "a_b")])
def test_sources(spark, x, y):
    from pyspark.sql import functions as F

    assert spark.range(1).select(mixing.plain_source(F.lit(x))).first()[0] == y
