import random

import numpy as np

from noteforge.llm import reading as r

EASY, WARD, HARD = ["le pain est bon", "on boit de l'eau", "il dort bien ici"], ["la patiente décrit une toux et une fièvre depuis deux jours avec repos"], ["l'analyse électrophysiologique des prélèvements met en évidence une hétérogénéité interstitielle contrastant avec l'intégrité apparente des structures adjacentes sous réserve d'exploration"]


def test_levels_follow_ratings_and_edge_rows_have_one(spark):
    c = random.Random(1)
    docs, rated = [], []
    for i in range(240):
        k = i % 3
        docs.append((i, ". ".join(c.choice((EASY, WARD, HARD)[k]) for _ in range(8)) + ".", c.choice(["fr", "FR", None]), 7))
        if i < 90:
            rated += [(i, "r1", k + 1), (i, "R1 ", k + 1), (i, "r2", k + 1 if i % 10 else 2), (i, "r3", None)]
    docs += [(900, None, None, 0), (901, "", "fr", 0), (902, "CRP 12,5 : 3/4", "xx-long", 0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, level int")
    ratings = spark.createDataFrame(rated, "doc_id bigint, rater string, level int")
    got = {x["doc_id"]: x["level"] for x in r.reading_levels(df, ratings).collect()}
    assert len(got) == len(docs)
    assert sum(got[i] == i % 3 + 1 for i in range(90, 240)) >= 147
    assert all(got[i] in (1, 2, 3) for i in (900, 901, 902))
    unrated = {x["doc_id"]: x["level"] for x in r.reading_levels(df, ratings.limit(0)).collect()}
    assert unrated[0] == 1 and unrated[2] == 3
    assert r.reading_levels(df.limit(0), ratings).count() == 0


def test_features_equal_a_plain_count():
    lists = {"fr": {"le": 6, "pain": 3, "est": 2}}
    text = "Le pain est bon. Trop court.\nLe pain 12:34:56 est est est 45x."
    x = r.features([text, None, text], ["fr", "fr", "fr"], lists)
    sizes, none = [4, 5], [[1, 1, 1], [0, 0, 0]]
    assert np.allclose(np.exp(x[0, :2]), [4.5, 4.5])
    assert np.isclose(x[0, 5], np.median([1 / 4, 0]))
    assert np.isclose(x[0, 11 + 2], np.mean([0]) + (1 + 1 + 3) / 9) and sizes and none
    assert np.allclose(x[0], x[2]) and np.allclose(x[1, :5], np.log(12))


def test_noise_is_left_out():
    assert r.running_words("Export c2:ed:73 " + "Z" * 50 + " fin 12,5.") == ["export", "fin"]
