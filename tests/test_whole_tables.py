"""Queries that fit a model read every document of their table, not the annotated ones of a split."""

import pytest

from noteforge.operators.router import LineRouter, RouterConfig
from noteforge.plans import catalogue
from noteforge.plans.adapters import TokenAdapter
from noteforge.plans.pipeline import Deidentifier

SCHEMA = "doc_id bigint, text string, entities array<struct<start:int,end:int,label:string>>, context map<string,array<string>>, split string"
NAMES = ["Alice", "Bob", "Chloé", "Denis", "Emma"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = []
    for i in range(40):
        name = NAMES[i % 5]
        spans = [(0, len(name), "Prenom" if i % 4 else "PRENOM"), (len(name) + 1, len(name) + 8, "NOM")]
        rows.append((i, f"{name} MARTIN{i % 7}\nligne neutre {i % 3}\nTel 06123456{i:02d}\n", None if i % 8 == 7 else spans, None, ("train", "validation", "test")[(i % 4) // 2 + (i % 8 == 6)]))
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_prediction_covers_documents_without_annotation_and_all_splits(spark, folder):
    rows = catalogue.predict_end_to_end(spark, folder).collect()
    assert {r["doc_id"] for r in rows} == set(range(40))
    assert {"NOM", "PRENOM", "TEL"} == {r["label"] for r in rows}
    assert {(r["span_start"], r["span_end"], r["label"]) for r in rows if r["doc_id"] == 7} >= {(0, 5, "PRENOM"), (6, 13, "NOM")}
    # the router chose lines: neutral lines don't go to the model
    assert all(0 < r["selected_characters"] < 35 for r in rows)


def test_router_scores_cover_every_line_with_the_default_settings(spark, folder, monkeypatch):
    configs, fit = [], LineRouter.fit
    monkeypatch.setattr(LineRouter, "fit", lambda self, *a, **k: configs.append(self.config) or fit(self, *a, **k))
    rows = catalogue.router_scores(spark, folder).collect()
    assert {(r["doc_id"], r["line_no"]) for r in rows} == {(i, k) for i in range(40) for k in range(3)} and len(rows) == 120
    assert configs == [RouterConfig()]


def test_profiles_are_calibrated_with_the_token_model_and_the_default_router(spark, folder, monkeypatch):
    made = []

    def fit(self, train, validation, training=None, router=None, **_):
        made.append((type(self.adapter), self.preset, training, router, train.count(), validation.count()))
        self.thresholds = {"fast": 0.5}
        return self

    monkeypatch.setattr(Deidentifier, "fit", fit)
    assert [tuple(r) for r in catalogue.fitted_profiles(spark, folder).collect()] == [("fast", 0.5)]
    assert made == [(TokenAdapter, "token", None, None, 20, 10)]


def test_queries_stay_where_something_the_corpus_operators_need_is_missing():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    n, m = map(int, subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True, check=True).stdout.split())
    assert n == 45 and m >= 38
