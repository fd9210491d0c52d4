import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noteforge.functions import text as tx
from noteforge.operators import calibration, lines, spans
from noteforge.operators.router import line_bounds
from noteforge.operators.rules import unite

DOC = "doc_id bigint, text string"


def _docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), DOC)


def _rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_normal_form_and_shape():
    assert tx.fold_line("  Élève\t N°12,5 ﬁn ß") == "eleve n°00,0 fin ss"
    assert tx.line_shape("  Jean DUPONT, 06 12") == "Aa A, 0 0"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aÀ1² .é\n_-ßЖ", max_size=12), min_size=1, max_size=6))
def test_python_model_of_lines(texts):
    for t in texts:
        assert "".join(t[s:e] for s, e in line_bounds(t)) == t
        assert all(t[s:e].endswith("\n") or e == len(t) for s, e in line_bounds(t)) and all("\n" not in t[s : e - 1] for s, e in line_bounds(t))


def test_text_functions_in_spark_equal_python(spark):
    texts = ["Élève N°12", "", None, "a_b Ж c1 d", "x" * 3, "ab", "été\xa0 ²3", "a🌿b🌿\nc", "\n\n\n\n"]
    df = _docs(spark, *texts).withColumn("n", tx.normal_form("text")).withColumn("w", tx.words(F.col("n")))
    got = df.select("doc_id", "n", "w", tx.bigrams(F.col("w")).alias("b"), tx.shape(F.col("text")).alias("s"), tx.ngrams(F.col("text"), 3).alias("g"), tx.bucket(F.col("text"), 1024).alias("k"), tx.alnum_count(F.col("text")).alias("a")).orderBy("doc_id").collect()
    import zlib

    for t, r in zip(texts, got):
        if t is None:
            assert all(r[c] is None for c in "nwbsgk")
            continue
        w = tx.WORD.findall(tx.fold_line(t))
        assert (r["n"], r["w"], r["b"], r["s"]) == (tx.fold_line(t), w, [f"{x}_{y}" for x, y in zip(w, w[1:])], tx.line_shape(t))
        assert r["g"] == [t[i : i + 3] for i in range(len(t) - 2)] and r["k"] == 1 + zlib.crc32(t.encode()) % 1023 and r["a"] == sum(map(str.isalnum, t))
    r = spark.range(1).select(tx.sigmoid(F.lit(0.0)), tx.sigmoid(F.lit(50.0)), tx.is_alnum(F.lit("é")), tx.is_alnum(F.lit("-"))).first()
    assert r[0] == 0.5 and r[1] == 1 / (1 + 2.718281828459045**-20) and r[2] and not r[3]


def test_running_sums(spark):
    c = random.Random(1)
    lists = [[c.randint(0, 9) for _ in range(n)] for n in (0, 1, 3, 4, 5, 63, 200)]
    got = spark.createDataFrame(list(enumerate(lists)), "k int, v array<bigint>").select("k", tx.running_sums(F.col("v"), 4).alias("s")).orderBy("k").collect()
    for v, r in zip(lists, got):
        total = 0
        assert r["s"] == [total := total + x for x in v]


def test_split_pack_project(spark):
    docs = _docs(spark, "alpha\nbeta\ngamma", "", None, "un\r\ndeux\n\n")
    got = lines.split_lines(docs)
    assert _rows(got.where("doc_id = 0").drop("content"), "line_no") == [(0, 0, 0, 6), (0, 1, 6, 11), (0, 2, 11, 16)]
    assert [r["content"] for r in got.where("doc_id = 3").orderBy("line_no").collect()] == ["un\r\n", "deux\n", "\n"]
    assert got.where("doc_id IN (1, 2)").count() == 0 and lines.split_lines(docs.limit(0)).count() == 0
    chosen = got.where("doc_id = 0 AND line_no IN (0, 2)")
    assert _rows(lines.pack_lines(chosen), "doc_id") == [(0, "alpha\n\ngamma", 2, 11, 12)]
    assert _rows(lines.segments(chosen), "seg_no") == [(0, 0, 0, 6, 0), (0, 1, 7, 12, 11)]
    packed = spark.createDataFrame([(0, 0, 5, "A"), (0, 5, 8, "B"), (0, 7, 12, "C")], "doc_id bigint, span_start int, span_end int, label string")
    assert _rows(lines.project_spans(packed, lines.segments(chosen)), "span_start") == [(0, 0, 5, "A"), (0, 11, 16, "C")]
    assert lines.pack_lines(chosen.limit(0)).count() == 0
    with pytest.raises(ValueError):
        lines.segments(chosen, "")
    text, segs = calibration.pack("alpha\nbeta\ngamma", [(0, 6), (11, 16)])
    assert (text, segs) == ("alpha\n\ngamma", [(0, 6, 0), (7, 12, 11)])
    assert calibration.project([(0, 5, "A"), (5, 8, "B"), (7, 12, "C")], segs) == [(0, 5, "A"), (11, 16, "C")]


def test_scores_and_selection(spark):
    import datetime as d

    t = d.datetime(2024, 1, 1)
    rows = [(1, 0, 0.5, t, t), (1, 0, 0.7, t, t + d.timedelta(1)), (1, 0, float("nan"), t, t + d.timedelta(2)), (1, 1, None, t, t), (1, 2, 0.2, t, t), (1, 2, 0.3, t, t)]
    s = lines.latest_scores(spark.createDataFrame(rows, "doc_id bigint, line_no int, score double, scored_at timestamp, loaded_at timestamp"))
    assert _rows(s, "line_no") == [(1, 0, 0.7), (1, 2, 0.3)]
    x = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "doc_id bigint, line_no int")
    assert lines.select_lines(x, None, None).count() == 3 and lines.select_lines(x, s, 0.5).count() == 1 and lines.select_lines(x, s, 1.0).count() == 0
    with pytest.raises(ValueError):
        lines.select_lines(x, s, 1.5)


SPAN = "doc_id bigint, span_start int, span_end int, label string, source int"


@pytest.mark.parametrize(
    "given_spans,want",
    [
        ([(0, 4, "MODEL", 0), (0, 4, "RULE", 1)], [(0, 4, "MODEL")]),
        ([(1, 5, "MODEL", 0), (0, 4, "RULE", 1)], [(0, 5, "RULE")]),
        ([(1, 5, "MODEL", 0), (0, 6, "RULE", 1)], [(0, 6, "RULE")]),
        ([(0, 6, "NOM", 0), (9, 12, "PRENOM", 0), (4, 10, "MAIL", 1), (12, 15, "TEL", 1)], [(0, 12, "NOM"), (12, 15, "TEL")]),
    ],
)
def test_merge_examples(spark, given_spans, want):
    assert unite(given_spans) == want
    assert [r[1:] for r in _rows(spans.merge_spans(spark.createDataFrame([(7, *s) for s in given_spans], SPAN)), "span_start")] == want


def test_merge_equals_the_python_model_on_random_spans(spark):
    c = random.Random(2)
    rows = [(d, s := c.randint(0, 60), s + c.randint(1, 9), c.choice("ABC"), c.randint(0, 1)) for d in range(60) for _ in range(c.randint(0, 14))]
    got = {}
    for d, *r in _rows(spans.merge_spans(spark.createDataFrame(rows, SPAN)), "doc_id", "span_start"):
        got.setdefault(d, []).append(tuple(r))
    assert got == {d: unite([r[1:] for r in rows if r[0] == d]) for d in {r[0] for r in rows}}


def test_valid_trimmed_aligned(spark):
    raw = spark.createDataFrame([(1, 0, 0, 4, "nom", 0), (1, 0, 0, 4, "nom", 0), (2, 0, 3, 3, "NOM", 0), (3, 0, -1, 3, "NOM", 0), (4, 0, 0, 3, None, 0), (5, 0, 0, 3, " email ", 1), (6, 0, None, 3, "NOM", 1)], "span_id bigint, doc_id bigint, span_start int, span_end int, label string, source int")
    assert sorted(r["label"] for r in spans.valid_spans(raw).collect()) == ["MAIL", "NOM"]
    text = "(+33) 6 12 34 56 78!!! | !!! Alice. | !!!"
    docs = _docs(spark, text)
    rows = [(0, 0, 22, "TEL", 1), (0, 25, 35, "PRENOM", 1), (0, 25, 35, "NOM", 1), (0, 38, 41, "NOM", 1)]
    got = spans.trim_spans(spark.createDataFrame(rows, SPAN), docs).collect()
    assert {(r["label"], text[r["span_start"] : r["span_end"]]) for r in got} == {("TEL", "(+33) 6 12 34 56 78"), ("PRENOM", "Alice."), ("NOM", "Alice")}
    docs = _docs(spark, "Jean-Paul 0612345678.\nfin")
    toks = spans.tokens(docs)
    assert "".join(r["token"] for r in toks.orderBy("token_no").collect()) == "Jean-Paul 0612345678.\nfin"
    s = spark.createDataFrame([(0, 1, 3, "NOM", 0), (0, 10, 20, "TEL", 0)], SPAN)
    assert [r[1:3] for r in _rows(spans.align_spans(s, docs), "span_start")] == [(0, 4), (10, 20)]
    assert [r[1:3] for r in _rows(spans.align_spans(s, docs, "strict"), "span_start")] == [(10, 20)]
    with pytest.raises(ValueError):
        spans.align_spans(s, docs, "other")
    assert spans.longest_first([(0, 5), (4, 12), (12, 14), (3, 4)]) == [1, 2, 3]


def test_coverage_counts_characters_once(spark):
    docs = _docs(spark, "abcd efgh\nxy")
    rules = spark.createDataFrame([(0, 0, 4, "A", 1), (0, 2, 6, "B", 1)], SPAN)
    got = _rows(spans.rule_coverage(lines.split_lines(docs), rules), "line_no")
    assert got == [(0, 0, 2, "A,B", 5, 8, 6), (0, 1, 0, "", 0, 2, 0)]


def test_samples_are_bounded_and_depend_on_rows_only(spark):
    from noteforge.functions.sampling import smallest_hashes

    df = spark.range(5000)
    got = [r["id"] for r in smallest_hashes(df, "id", 100, 3).collect()]
    assert got == [r["id"] for r in df.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(100).collect()]
    assert got == [r["id"] for r in smallest_hashes(df.repartition(7), "id", 100, 3).collect()]
    assert smallest_hashes(df.limit(50), "id", 100).count() == 50 and smallest_hashes(df.limit(0), "id", 5).count() == 0
