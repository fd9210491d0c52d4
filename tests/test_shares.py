"""Models are trained on all documents, however many, in shares that depend on the rows only."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteforge.functions.shares import dealt, shares_for
from noteforge.operators.router import LineRouter, RouterConfig, line_features, mixed
from noteforge.plans.adapters import TokenAdapter, TokenTraining


@pytest.fixture(scope="module")
def many(spark):
    """More documents than the samples of former rounds held (20,000); those with the largest hashes, left out by these, are the only ones with a label and a missed name."""
    none = F.expr("cast(array() as array<struct<start:int,end:int,label:string>>)")
    ids = spark.range(20_300).withColumn("h", F.xxhash64(F.lit(0), F.col("id")))
    cut = ids.orderBy(F.col("h").desc()).offset(99).first()["h"]
    rare = F.array(F.struct(F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit("RARE").alias("label")))
    docs = ids.select(F.col("id").alias("doc_id"), F.when(F.col("h") >= cut, "Zora").otherwise("neutre").alias("text"), F.when(F.col("h") >= cut, rare).otherwise(none).alias("entities"), none.alias("rules"))
    docs = docs.persist()
    yield docs
    docs.unpersist()


def test_router_learns_from_all_documents(many):
    router = LineRouter(RouterConfig(dimension=1024, epochs=1)).fit(many, ["RARE"])
    assert router.scores("Zora", [])[0] > 0.5 > router.scores("neutre", [])[0]


def test_token_model_learns_from_all_documents(many):
    model = TokenAdapter().fit(many, None, TokenTraining(steps=2, batch_size=1))
    assert model.labels == {"RARE"} and model.predict(["Zora", "neutre"]) == [[(0, 4, "RARE")], []]


def _word(i):
    return f"zq{chr(97 + i // 8)}{chr(97 + i % 8)}x"


def _named(spark, n):
    rows = [(i, f"{_word(i)} nom\nligne neutre\n", [(0, 5, "NOM")], []) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, entities array<struct<start:int,end:int,label:string>>, rules array<struct<start:int,end:int,label:string>>")


def test_every_document_of_every_share_counts(spark):
    docs, config = _named(spark, 60), RouterConfig(epochs=2)
    one, few = (LineRouter(config).fit(d, ["NOM"], share=s) for d, s in ((docs, 100), (docs, 9)))
    again = LineRouter(config).fit(docs.repartition(5), ["NOM"], share=9)
    assert few.weights.tobytes() == again.weights.tobytes() and few.weights.tobytes() != one.weights.tobytes()
    for i in range(60):
        own = line_features(f"{_word(i)} nom\nligne neutre\n", [], config)[0]
        others = np.unique(np.concatenate([line_features(f"{_word(j)} nom\nligne neutre\n", [], config)[0] for j in range(60) if j != i]))
        assert (few.weights[np.setdiff1d(own, others)] != 0).any()
        assert few.scores(f"{_word(i)} nom\nligne neutre\n", [])[0] > 0.5
    model = TokenAdapter(share=9).fit(docs, docs, TokenTraining(steps=4, validation_interval=2, batch_size=3))
    other = TokenAdapter(share=9).fit(docs.repartition(5), docs, TokenTraining(steps=4, validation_interval=2, batch_size=3, selection_metric=lambda g, f: len(f) / 60))
    assert model.weights.tobytes() == other.weights.tobytes() and other.selected_score == 1.0 and [x["step"] for x in model.history] == [2, 4]
    assert model.selected_score == 1.0 and all(model.predict([f"{_word(i)} nom\nligne neutre\n"]) == [[(0, 5, "NOM")]] for i in range(60))


def test_shares_hold_all_rows(spark):
    df = spark.range(1000).withColumn("id", F.when(F.col("id") > 0, F.col("id")))
    got = dealt(df, "id", 7).withColumn("at", F.spark_partition_id()).collect()
    assert len(got) == 1000 and all(r["at"] == r["share"] for r in got)
    sizes = np.bincount([r["share"] for r in got], minlength=7)
    assert sizes.min() > 100 and sizes.max() < 190
    assert [shares_for(n, 10) for n in (0, 1, 10, 11, 95)] == [1, 1, 1, 2, 10]


def test_mixed_weights():
    start, seen = np.array([1.0, 1.0, 1.0]), [np.array([1e-3, 2e-3, 3e-3]), np.array([1e-3, 1e-3, 2e-3])]
    assert np.allclose(mixed(start, [np.array([1.0, 3.0, 4.0]), np.array([1.0, 1.0, 7.0])], seen), [1.0, 3.0, 5.0])


def test_path_is_the_best_one():
    model, chance = TokenAdapter(), np.random.default_rng(1)
    valid = lambda p: all(not (k and k % 2 == 0) or (i and p[i - 1] in (k - 1, k)) for i, k in enumerate(p))
    for n in (1, 2, 3, 4, 5):
        paths = [p for p in itertools.product(range(5), repeat=n) if valid(p)]
        for _ in range(40):
            scores = chance.normal(size=(n, 5)).astype(np.float32)
            scores[:, 2::2] += 1
            assert tuple(model._path(scores)) == max(paths, key=lambda p: sum(scores[i, k] for i, k in enumerate(p)))


def test_tasks_are_sent_weights_that_are_not_zero():
    import pickle

    model = TokenAdapter()
    model.tags, model.weights = ["O", "B-NOM", "I-NOM"], np.zeros((model.PLACES, 3), np.float32)
    model.weights[[1, 5, 99], [0, 2, 1]] = 1.5, -2, 3
    sent = pickle.dumps(model)
    again = pickle.loads(sent)
    assert len(sent) < 2000 and again.tags == model.tags and (again.weights == model.weights).all() and again.weights.dtype == np.float32
