import json
import sys

import pytest

from noteforge.operators import rejects
from noteforge.operators.router import RouterConfig
from noteforge.plans.adapters import EntityAdapter, LexiconAdapter, TokenAdapter, TokenTraining, create_preset, training_metadata
from noteforge.plans.pipeline import Deidentifier, routing_value
from noteforge.sources import annotations
from noteforge.streaming.predict import document_stream, predict_stream


def _line(**k):
    return json.dumps({"text": "Maël-Dupont\nconsulte.", "entities": [{"start": 1, "end": 3, "label": "NOM"}], **k})


NOTES = [
    (_line(), None), (_line(context=None), None), (_line(context={"NOM": ["a"]}, other=1), None), (f" {_line()}\r\n", None), (_line(entities=[]), None),
    (None, "syntax"), ("", "syntax"), ("{", "syntax"), (_line() + "x", "syntax"), ('{"text": NaN}', "syntax"), ("{'text': 1}", "syntax"), ("[" * 100000, "syntax"), ("[]", "object"), ("null", "object"),
    (_line(text=""), "text"), (_line(text=3), "text"), ('{"entities": []}', "text"), (_line(entities=None), "entity"), (_line(entities=[1]), "entity"),
    (_line(entities=[{"start": 1.0, "end": 3, "label": "X"}]), "offsets"), (_line(entities=[{"start": True, "end": 3, "label": "X"}]), "offsets"), (_line(entities=[{"start": 3, "end": 3, "label": ""}]), "offsets"),
    (_line(entities=[{"start": 0, "end": 99, "label": "X"}]), "offsets"), (_line(entities=[{"start": 0, "label": "X"}]), "offsets"), ('{"text": "a", "entities": [{"start": 0, "end": %s, "label": "X"}]}' % ("9" * 5000), "offsets"),
    (_line(entities=[{"start": 0, "end": 2, "label": ""}]), "label"), (_line(entities=[{"start": 0, "end": 2}]), "label"),
    (_line(entities=[{"start": 2, "end": 5, "label": "X"}, {"start": 0, "end": 3, "label": "Y"}]), "overlap"), (_line(entities=[{"start": 2, "end": 5, "label": "X"}, {"start": 0, "end": 2, "label": "Y"}]), None),
    (_line(context=[]), "context"), (_line(context={"A": "b"}), "context"), (_line(context={"A": [1]}), "context"),
]
SPANS = [
    ("n;abc;0;3;NOM", None), ('"n";"a;b\nc ""x""";0;3;NOM', None), ('n;"été🌿";3;4;"NOM"', None), (";abc;00;003;X", None),
    (None, "columns"), ("", "columns"), ("a;b;c", "columns"), ("a;b;0;1;X;", "columns"), ("a,b", "columns"), ("n\nx", "columns"),
    ('n;a"b;0;1;X', "quoting"), ('n;"ab;0;1;X', "quoting"), ('n;"a"b;0;1;X', "quoting"), ('n; "ab";0;1;X', "quoting"),
    ("n;;0;1;X", "text"), ('n;"";0;1;', "text"), ("n;abc;-1;2;X", "offsets"), ("n;abc;1;1;X", "offsets"), ("n;abc;0;4;X", "offsets"), ("n;abc;٠;2;X", "offsets"), ("n;abc;;2;X", "offsets"), ("n;abc;0;" + "9" * 40 + ";X", "offsets"), ("n;abc; 0;2;X", "offsets"),
    ("n;abc;0;2;", "label"), ('n;abc;0;2;""', "label"),
]


def test_rejects(spark):
    rows = [(k, "notes_jsonl" if k < len(NOTES) else "spans_csv", raw, "x") for k, (raw, _) in enumerate(NOTES + SPANS)] + [(900, None, "x", ""), (901, "other", None, "")]
    df = spark.createDataFrame(rows, "row_id bigint, feed string, raw string, reason string")
    want = {k: r for k, (_, r) in enumerate(NOTES + SPANS) if r} | {900: "feed", 901: "feed"}
    assert {r["row_id"]: r["reason"] for r in rejects.rejected(df).collect()} == want
    decoded = rejects.decode(df)
    notes, spans = rejects.loaded_notes(decoded).collect(), {r["row_id"]: r for r in rejects.loaded_spans(decoded).collect()}
    assert len(notes) + len(spans) + len(want) == len(rows)
    second = spans[len(NOTES) + 1]
    assert (second["note"], second["text"], second["span_start"], second["span_end"]) == ("n", 'a;b\nc "x"', 0, 3)
    assert rejects.rejected(df.limit(0)).count() == 0


def test_unquoted_line_breaks_are_data():
    got = rejects.decode_spans(["n;a\nb;0;2;X", "n\r;ab;0;2;X"])
    assert got["reason"].tolist() == [None, None] and got["text"][0] == "a\nb" and got["note"][1] == "n\r"


def test_lines_of_a_file_read_in_parts_keep_their_numbers(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text("".join((_line() if k % 7 else "{") + "\n" for k in range(1, 400)), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        good, bad = annotations.annotation_problems(spark, str(path))
        assert good.rdd.getNumPartitions() >= 1 and sorted(r["line_no"] for r in bad.collect()) == list(range(7, 400, 7))
        assert sorted(r["line_no"] for r in good.collect()) == [k for k in range(1, 400) if k % 7]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_read_annotations(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text("\n".join([json.dumps({"note_text": "Maël-Dupont", "entities": [{"start": 1, "end": 3, "label": "NOM"}], "context": {"NOM": ["x"]}}), json.dumps({"note_text": "b", "entities": []})]) + "\n", encoding="utf-8")
    docs = annotations.read_annotations(spark, str(path), "note_text")
    rows = {r["text"]: r for r in docs.collect()}
    e = rows["Maël-Dupont"]["entities"][0]
    assert rows["Maël-Dupont"]["text"][e["start"] : e["end"]] == "aë" and rows["Maël-Dupont"]["context"] == {"NOM": ["x"]} and rows["b"]["context"] is None
    bounds = [(r["token_start"], r["token_end"]) for r in annotations.refined_tokens(docs.where("text <> 'b'")).orderBy("token_no").collect()]
    assert bounds == [(0, 1), (1, 3), (3, 4), (4, 5), (5, 11)]
    path.write_text(_line() + "\n\n" + _line() + "\n{", encoding="utf-8")
    with pytest.raises(ValueError, match=":2: syntax"):
        annotations.read_annotations(spark, str(path))
    good, bad = annotations.annotation_problems(spark, str(path))
    assert good.count() == 2 and sorted(r["line_no"] for r in bad.collect()) == [2, 4]
    path.write_text("")
    with pytest.raises(ValueError, match="no documents"):
        annotations.read_annotations(spark, str(path))
    assert [r["doc_id"] for r in annotations.documents_from_texts(spark, ["a", "b"]).collect()] == [0, 1]


@pytest.fixture(scope="module")
def corpora(spark):
    names = ["Alice", "Bob", "Chloé", "Denis", "Emma"]
    rows = [(i, f"{names[i % 5]} MARTIN{i % 7}\nligne neutre {i % 3}\nTel 06123456{i:02d}\n", [{"start": 0, "end": len(names[i % 5]), "label": "PRENOM"}, {"start": len(names[i % 5]) + 1, "end": len(names[i % 5]) + 8, "label": "NOM"}], None) for i in range(40)]
    df = spark.createDataFrame([(i, t, [(e["start"], e["end"], e["label"]) for e in es], c) for i, t, es, c in rows], annotations.SCHEMA)
    return df.where("doc_id < 30"), df.where("doc_id >= 30")


def test_pipeline_fits_predicts_continues_and_reloads(spark, corpora, tmp_path):
    train, validation = corpora
    pipe = Deidentifier.from_preset("lexicon")
    with pytest.raises(RuntimeError):
        pipe.predict(train)
    pipe.fit(train, validation, router=RouterConfig(dimension=1024, epochs=1), recall_groups={"names": ["NOM", "PRENOM"]})
    assert set(pipe.thresholds) == {"prudent", "balanced", "fast"} and isinstance(pipe.adapter, EntityAdapter)
    everything = {r["doc_id"]: r for r in pipe.predict(validation).collect()}
    assert [(e["start"], e["end"], e["label"]) for e in everything[30]["entities"]][:2] == [(0, 5, "PRENOM"), (6, 12, "NOM")]
    assert {r["doc_id"]: r["entities"] for r in pipe.predict(validation, 0.0).collect()} == {k: v["entities"] for k, v in everything.items()}
    rules_only = pipe.predict(validation, 1.0).collect()
    assert all(r["model_characters"] == 0 and {e["label"] for e in r["entities"]} == {"TEL"} for r in rules_only)
    assert sum(r["model_characters"] for r in pipe.predict(validation, "fast").collect()) <= sum(r["model_characters"] for r in everything.values())
    pipe.routing = "fast"
    pipe.save(tmp_path / "p")
    again = Deidentifier.load(tmp_path / "p")
    assert again.routing == "fast" and again.thresholds == pipe.thresholds and again.preset == "lexicon"
    assert again.predict(validation).collect() == pipe.predict(validation).collect()
    again.fit(train, validation)
    assert again.router.config == pipe.router.config
    with pytest.raises(ValueError):
        again.fit(train, validation, router=RouterConfig(dimension=2048))
    again.fit(train, validation, router=RouterConfig(dimension=2048, epochs=1), reset_router=True)
    assert len(again.router.weights) == 2048
    with pytest.raises(FileExistsError):
        pipe.save(tmp_path / "p")
    custom = Deidentifier.load(tmp_path / "p", loader=LexiconAdapter.load, routing="prudent")
    assert custom.preset is None and custom.routing == "prudent"
    m = json.loads((tmp_path / "p" / "manifest.json").read_text())
    for broken in ({"format_version": 3}, {"thresholds": {"fast": 0.1}}, {"thresholds": {**m["thresholds"], "fast": 2}}, {"preset": None}):
        (tmp_path / "p" / "manifest.json").write_text(json.dumps({**m, **broken}))
        with pytest.raises(ValueError):
            Deidentifier.load(tmp_path / "p")


def test_failures(spark, corpora, tmp_path):
    train, validation = corpora

    class Broken(LexiconAdapter):
        def fit(self, *_, **__):
            raise RuntimeError("broken")

    pipe = Deidentifier(Broken())
    bad = [
        ({"target_labels": ["AUTRE"]}, ValueError), ({"recall_groups": {}}, ValueError), ({"recall_groups": {"g": ["TEL"]}}, ValueError), ({"router": 3}, TypeError), ({"reset_router": 1}, TypeError),
        ({"training": object()}, TypeError), ({"work_dir": tmp_path}, FileExistsError),
    ]
    (tmp_path / "x").write_text("")
    for k, error in bad:
        with pytest.raises(error):
            pipe.fit(train, validation, **k)
    for a, b in ((train.limit(0), validation), (train, validation.limit(0))):
        with pytest.raises(ValueError):
            pipe.fit(a, b)
    with pytest.raises(RuntimeError, match="broken"):
        pipe.fit(train, validation)
    with pytest.raises(RuntimeError, match="earlier"):
        pipe.fit(train, validation)
    for value, error in (("slow", ValueError), (True, TypeError), (None, TypeError), (2, ValueError), (float("nan"), ValueError)):
        with pytest.raises(error):
            routing_value(value)


def test_token_adapter(spark, corpora, tmp_path):
    train, validation = corpora
    a = TokenAdapter().fit(train, validation, TokenTraining(steps=6, validation_interval=2, batch_size=30), tmp_path / "w")
    assert a.selected_score == 1.0 and a.selected_step in (2, 4, 6) and (tmp_path / "w" / "training.json").exists()
    assert [x["step"] for x in a.history] == [2, 4, 6] and a.history[0]["loss"] >= a.history[-1]["loss"]
    assert a.predict(["Alice MARTIN3\nligne"])[0] == [(0, 5, "PRENOM"), (6, 13, "NOM")]
    a.save(tmp_path / "m")
    assert TokenAdapter.load(tmp_path / "m").predict(["Bob MARTIN1"]) == a.predict(["Bob MARTIN1"])
    assert a.predict([]) == [] and a.predict([""]) == [[]]
    last = TokenAdapter().fit(train, validation, TokenTraining(steps=5, validation_interval=2, batch_size=5, checkpoint_selection="last"))
    assert last.selected_step == 5


def test_settings_and_presets():
    for kind, k, error in (
        (TokenTraining, {"steps": 0}, ValueError), (TokenTraining, {"dropout": 1.0}, ValueError), (TokenTraining, {"seed": True}, TypeError), (TokenTraining, {"learning_rate": 0.0}, ValueError),
        (TokenTraining, {"selection_labels": ()}, ValueError), (TokenTraining, {"selection_metric": "x"}, ValueError), (TokenTraining, {"l2": float("nan")}, ValueError), (TokenTraining, {"greater_is_better": 1}, TypeError),
    ):
        with pytest.raises(error):
            kind(**k)
    assert create_preset("token", {"batch_size": 4}).batch_size == 4
    for args in (("none",), ("camembert",), ("token", {"x": 1})):
        with pytest.raises(ValueError):
            create_preset(*args)
    assert training_metadata(None) is None and training_metadata(TokenTraining(selection_metric=len))["selection_metric"] == "custom"


def test_stream_equals_batch(spark, corpora, tmp_path):
    train, validation = corpora
    pipe = Deidentifier(LexiconAdapter()).fit(train, validation, router=RouterConfig(dimension=1024, epochs=1))
    validation.repartition(3).write.parquet(str(tmp_path / "in"))
    docs = document_stream(spark, str(tmp_path / "in"), validation.schema, 1)
    query = predict_stream(pipe, docs, str(tmp_path / "out"), str(tmp_path / "state"), "balanced")
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = pipe.predict(validation, "balanced")
    assert sorted(got.select(want.columns).collect(), key=lambda r: r["doc_id"]) == sorted(want.collect(), key=lambda r: r["doc_id"])


def test_entry_works_without_the_subpackage(monkeypatch):
    import __spark_entry__ as e

    assert {"p5_found", "merged_spans"} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    monkeypatch.setitem(sys.modules, "noteforge.llm", None)
    assert "p5_found" in e.queries() and "p1_found" not in e.queries() and "merged_spans" in e.oracle_sql()
