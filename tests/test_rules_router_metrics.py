import random

import numpy as np
import pytest

from noteforge.operators import calibration, chunks, metrics, rules
from noteforge.operators.router import LineRouter, RouterConfig, class_balance, line_features, residual_lines, score_of

DOCS = "doc_id bigint, text string, entities array<struct<start:int,end:int,label:string>>, context map<string,array<string>>"


def _found(text, context=None, **k):
    return [(label, text[s:e]) for s, e, label in rules.rule_spans(text, context, **k)]


@pytest.mark.parametrize("phone", ["06 12 34 56 78", "06.12.34.56.78", "06-12-34-56-78", "+33 6 12 34 56 78", "0033 6 12 34 56 78", "+33 (0)6 12 34 56 78", "0612345678", "0612 345 678"])
@pytest.mark.parametrize("cased", [False, True])
def test_phones(phone, cased):
    assert _found(f"Tel : {phone}.", case_preserving=cased) == [("TEL", phone)]


def test_mail_identity_address():
    assert _found("Contact : test@example.fr ou 06 12 34 56 78.") == [("MAIL", "test@example.fr"), ("TEL", "06 12 34 56 78")]
    assert _found("Écrire à JEAN.DUPONT @ hopital . test ce jour") == [("MAIL", "JEAN.DUPONT @ hopital . test")]
    assert _found("Numéro 1 84 05 75 116 006 11") == [("SECU", "1 84 05 75 116 006 11")]
    for cased in (False, True):
        assert ("ADRESSE", "12 rue de la Paix") in (got := _found("Le patient habite 12 rue de la Paix 75002 PARIS.", case_preserving=cased)) and ("ZIP", "75002") in got
    assert _found("Le patient habite 12 rue de la Paix 75002 PARIS.") == [("ADRESSE", "12 rue de la Paix"), ("ZIP", "75002")]
    assert _found("en cours de traitement, place de la chirurgie") == [] and _found("lot 184057511600611999") == []


def test_context_terms():
    assert _found("Luc Martin consulte.", {"PRENOM": ["LUC"], "NOM": ["martin"]}) == [("PRENOM", "Luc"), ("NOM", "Martin")]
    context = {"EMAIL": ["a.b@c.fr"], "NOM_NAISS": ["Élie"], "TEL": None, "NOM": [None, " -"]}
    assert _found("a.b@c.fr pour Elie", context) == [("MAIL", "a.b@c.fr"), ("NOM", "Elie")]
    assert context["EMAIL"] == ["a.b@c.fr"]
    assert _found("Martinet", {"NOM": ["martin"]}) == [] and rules.rule_spans(None) == [] and rules.rule_spans("") == []


def test_cities_stand_before_or_after_the_postcode():
    cased = lambda t: _found(t, case_preserving=True)
    assert cased("Domicile : 12 rue de la Paix, PARIS 75002.") == [("ADRESSE", "12 rue de la Paix"), ("VILLE", "PARIS"), ("ZIP", "75002")]
    assert ("VILLE", "LYON CEDEX 03") in cased("Adresse : 8 quai Perrache\n69003 LYON CEDEX 03")
    assert cased("Adresse : rue Pasteur") == [("ADRESSE", "rue Pasteur")]


def test_malformed_contexts_are_refused():
    for bad in ({"NOM": "Luc"}, ["NOM"], {"NOM": ["Luc", 3]}, {"": ["Luc"]}, {3: ["Luc"]}, "NOM", {"NOM": {"Luc": 1}}):
        with pytest.raises(ValueError):
            rules.rule_spans("Luc", bad)


def test_identity_numbers_field_by_field():
    good = ["184057511600611", "1 84 05 2A 116 006 11", "299129712345697".replace("12345", "10145"), "300000000000000"]
    bad = ["184137511600611", "184050011600611", "184057500000611", "184057511600600", "184057511600698", "18405751160061", "184059799100611"]
    assert [rules._identities(x.lower()) != [] for x in good] == [True] * 4
    assert [rules._identities(x.lower()) != [] for x in bad] == [False] * 7
    assert _found("0184057511600611") == [] and _found("12-184057511600611") == []


def test_cleanup():
    assert rules.cleaned("Alice Bob Claire", [(0, 9, "A"), (6, 16, "OTHER"), (2, 4, "B"), (0, 5, "C"), (10, 16, "D")]) == [(0, 16, "OTHER")]
    assert rules.cleaned("!!!", [(0, 3, "NOM")]) == []
    assert len(rules.same_length_fold("Éœﬁ’ßＡ")) == 6


def test_rules_in_spark(spark):
    df = spark.createDataFrame([(1, "Luc au 0612345678", None, {"PRENOM": ["Luc"]}), (2, None, None, None), (3, "", None, {})], DOCS)
    got = rules.exploded(rules.with_rule_spans(df)).orderBy("span_start").collect()
    assert [(r["doc_id"], r["label"]) for r in got] == [(1, "PRENOM"), (1, "TEL")]
    assert rules.exploded(rules.with_rule_spans(df.drop("context"))).count() == 1


def _corpus(spark, n=30):
    rows = [(i, f"{('Jean', 'Marie', 'Luc')[i % 3]} DUPONT{i}\nligne neutre numero {i % 5}\n", [(0, len(("Jean", "Marie", "Luc")[i % 3]), "PRENOM"), (len(("Jean", "Marie", "Luc")[i % 3]) + 1, len(("Jean", "Marie", "Luc")[i % 3]) + 7 + len(str(i)), "NOM")], None) for i in range(n)]
    return spark.createDataFrame(rows, DOCS)


def test_router_learns_continues_and_is_saved(spark, tmp_path):
    docs = rules.with_rule_spans(_corpus(spark))
    config = RouterConfig(dimension=1024, epochs=2)
    router = LineRouter(config)
    with pytest.raises(RuntimeError):
        router.scores("x", [])
    router.fit(docs, ["NOM"])
    scores = router.score_lines(docs).collect()
    assert min(r["score"] for r in scores if r["line_no"] == 0) > max(r["score"] for r in scores if r["line_no"] == 1)
    by = {(r["doc_id"], r["line_no"]): r["score"] for r in scores}
    assert [by[0, 0], by[0, 1]] == router.scores("Jean DUPONT0\nligne neutre numero 0\n", [])
    router.save(tmp_path / "r")
    again = LineRouter.load(tmp_path / "r")
    assert (again.weights == router.weights).all()
    before = router.weights.copy()
    assert (router.fit(docs, ["NOM"]).weights != before).any()
    with pytest.raises(ValueError):
        router.fit(docs, ["NOM"], RouterConfig(dimension=2048))
    with pytest.raises(ValueError):
        LineRouter(config).fit(docs, ["AUTRE"])
    with pytest.raises(FileExistsError):
        router.save(tmp_path / "r")
    (tmp_path / "r" / "weights.bin").write_bytes(b"0" * 9)
    with pytest.raises(ValueError):
        LineRouter.load(tmp_path / "r")


@pytest.mark.parametrize("bad,error", [({"dimension": 10}, ValueError), ({"epochs": 0}, ValueError), ({"seed": 1.5}, TypeError), ({"ngrams": [3]}, TypeError), ({"ngrams": ()}, ValueError), ({"learning_rate": True}, TypeError), ({"learning_rate": float("nan")}, ValueError)])
def test_router_settings(bad, error):
    with pytest.raises(error):
        RouterConfig(**bad)


def test_features_are_sorted_distinct_with_bias():
    rows = line_features("Jean\nneutre\n", [(0, 4, "NOM")], RouterConfig(dimension=1024))
    assert len(rows) == 2 and all(x[0] == 0 and (np.diff(x) > 0).all() for x in rows)
    with pytest.raises(ValueError):
        line_features("a", [(0, 5, "X")], RouterConfig())
    assert residual_lines("Jean\nab\n", [(0, 4, "NOM"), (5, 7, "TEL")], [(0, 4, "X")], frozenset({"NOM", "TEL"})) == [False, True]
    assert 0 < score_of(np.full(1024, -1e9), np.array([0, 5])) < 1e-8


def test_metrics(spark):
    s = "doc_id bigint, span_start int, span_end int, label string"
    gold = spark.createDataFrame([(1, 0, 3, "NOM"), (1, 5, 8, "TEL"), (2, 0, 2, "NOM"), (2, 0, 2, "NOM")], s)
    pred = spark.createDataFrame([(1, 0, 3, "NOM"), (2, 1, 2, "NOM"), (1, 0, 3, "NOM")], s)
    r = metrics.with_rates(metrics.exact_counts(gold, pred)).first()
    assert (r["tp"], r["n_predicted"], r["n_gold"]) == (1, 2, 3) and (r["precision"], r["recall"], r["f1"], r["f2"]) == (1 / 2, 1 / 3, 2 / 5, 5 / 14)
    none = metrics.with_rates(metrics.exact_counts(gold.limit(0), pred.limit(0))).first()
    assert none["f2"] == 0.0 and none["tp"] == 0
    rows = [{(0, 3, "NOM"), (5, 8, "TEL")}, {(0, 2, "NOM")}]
    assert metrics.score_spans(rows, [{(0, 3, "NOM")}, {(1, 2, "NOM")}], "f2") == 5 / 14
    assert metrics.score_spans(rows, rows, lambda a, b: 0.25) == 0.25
    for bad in ("other", lambda a, b: float("nan"), lambda a, b: True):
        with pytest.raises(ValueError):
            metrics.score_spans(rows, rows, bad)
    docs = spark.createDataFrame([(1, "abc d-fgh"), (2, "xy")], "doc_id bigint, text string")
    rec = {x["grp"]: x for x in metrics.character_recall(docs, gold, pred, spark.createDataFrame([("g", "NOM"), ("h", "NOM"), ("h", "TEL")], "grp string, label string")).collect()}
    assert (rec["g"]["covered"], rec["g"]["support"]) == (4, 5) and (rec["h"]["covered"], rec["h"]["support"]) == (4, 7)
    assert metrics.residual_lines(docs, gold, pred).where("is_residual").count() == 2
    assert class_balance(metrics.residual_lines(docs, gold, pred)).first()["positive_weight"] == 0.0
    assert metrics.overlapping_annotations(spark.createDataFrame([(1, 0, 3, "A"), (1, 2, 5, "B"), (1, 5, 6, "C")], s)).count() == 1


def test_router_bypass_and_empty_selection():
    calls = []

    def model(texts):
        calls.append(texts)
        return [[(0, 4, "NOM")] for _ in texts]

    assert calibration.route("Jean\nfin\n", [], model, None, None) == ([(0, 4, "NOM")], 9, 9) and len(calls) == 1
    assert calibration.route("Jean\nfin\n", [(5, 8, "X")], model, [0.2, 0.2], 1.0) == ([(5, 8, "X")], 0, 0) and len(calls) == 1
    with pytest.raises(ValueError):
        calibration.route("Jean\n", [], model, None, 0.5)


def _scored(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, rules array<struct<span_start:int,span_end:int,label:string>>, entities array<struct<start:int,end:int,label:string>>, scores array<double>")


def test_calibration_examples(spark):
    empty = lambda texts: [[] for _ in texts]
    docs = _scored(spark, [(1, "JEAN\nMARIE\n", [(0, 4, "NOM")], [(0, 4, "NOM"), (5, 10, "NOM")], [0.2, 0.8])])
    upper = lambda texts: [[(i, i + 5, "NOM") for i in [t.find("MARIE")] if i >= 0] for t in texts]
    assert calibration.calibrate(docs, upper, ["NOM"], {"g": ["NOM"]}) == {"prudent": 0.8, "balanced": 0.8, "fast": 0.8}
    everything = lambda texts: [[(0, len(t), "X")] for t in texts]
    text = "A" * 1000 + "\nB"
    rare = _scored(spark, [(1, text, [], [(0, 1000, "COMMON"), (1001, 1002, "RARE")], [0.9, 0.2])])
    assert calibration.calibrate(rare, everything, ["COMMON", "RARE"], {"g": ["COMMON", "RARE"]})["prudent"] == 0.9
    assert set(calibration.calibrate(rare, everything, ["COMMON", "RARE"], {"c": ["COMMON"], "r": ["RARE"]}).values()) == {0.2}
    with pytest.raises(ValueError):
        calibration.calibrate(rare, empty, ["NONE"], {"g": ["NONE"]})
    with pytest.raises(ValueError):
        calibration.calibrate(rare, empty, ["RARE"], {})


def test_points_equal_brute_force(spark):
    c = random.Random(3)
    docs = {d: [(c.choice([0.1, 0.2, 0.3, 0.5, 0.9, 1.0]), c.randint(1, 20)) for _ in range(c.randint(1, 6))] for d in range(30)}
    states = [(d, s, sum(n for x, n in v if x >= s)) for d, v in docs.items() for s in {x for x, _ in v}] + [(d, None, 0) for d in docs]
    got = {r["threshold"]: r["m"] for r in calibration.calibration_points(spark.createDataFrame(states, "doc_id bigint, score double, m bigint"), ["m"]).collect()}
    assert set(got) == {0.0, 1.0, *(x for v in docs.values() for x, _ in v)}
    assert got == {t: sum(n for v in docs.values() for x, n in v if x >= t) for t in got}


def test_chunks(spark):
    text = "Un deux trois. Quatre cinq six sept.\nHuit neuf."
    df = spark.createDataFrame([(1, text, [(0, 7, "NOM")]), (2, "", None), (3, None, None), (4, " \t ", [])], "doc_id bigint, text string, entities array<struct<start:int,end:int,label:string>>")
    got = chunks.training_chunks(df, max_length=5).orderBy("chunk_no").collect()
    assert {r["doc_id"] for r in got} == {1} and got[0]["entities"][0]["label"] == "NOM"
    assert "".join("".join(r["text"].split()) for r in got) == "".join(text.split())
    assert got == chunks.training_chunks(df, max_length=5).orderBy("chunk_no").collect()
    assert chunks.chunk_bounds([4, 8, 9], 8, random.Random(1))[-1][1] == 9
    with pytest.raises(ValueError):
        chunks.training_chunks(df, 0)


def test_gold_alignment(spark):
    from noteforge.operators import alignment, spans

    text, tokens = " Dr.Dupont ", [(0, 1), (1, 6), (6, 10), (10, 11)]
    assert alignment.align_gold(text, tokens, [(1, 7, "LONG"), (8, 10, "SHORT")]) == [(1, 10, "LONG")]
    assert alignment.align_gold(text, tokens, [(0, 5, "A"), (6, 11, "B")]) == [(1, 6, "A"), (6, 10, "B")]
    with pytest.raises(ValueError):
        alignment.align_gold(text, tokens, [(0, 1, "A")])
    every, flat = alignment.overlapping_and_longest(text, tokens, [(1, 10, "A"), (6, 10, "B")])
    assert len(every) == 2 and flat == [(1, 10, "A")]
    docs = spark.createDataFrame([(1, "Jean-Paul Durand"), (2, None)], "doc_id bigint, text string")
    gold = spark.createDataFrame([(1, 1, 3, "A"), (1, 2, 9, "B"), (1, 9, 12, "C")], "doc_id bigint, span_start int, span_end int, label string")
    assert [tuple(r) for r in alignment.aligned_gold(docs, gold).orderBy("span_start").collect()] == [(1, 0, 9, "B"), (1, 10, 16, "C")]
