import numpy as np

from noteforge.llm import pii
from noteforge.llm.crf_tagger import Tagger, char_ids

SCHEMA = "doc_id bigint, text string, entities array<struct<start:int,end:int,label:string>>, label string"


def _brute_path(m, e):
    t, start = m.transitions(), m.p["start"].copy()
    start[2::2] = -1e4
    score, back = start + e[:, 0], []
    for k in range(1, e.shape[1]):
        x = score[:, None] + t
        back.append(x.argmax(0))
        score = x.max(0) + e[:, k]
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_pruned_decoding_equals_the_whole_search():
    r, n_open, n_all = np.random.default_rng(0), 0, 0
    for seed in range(300):
        m = Tagger(["A", "B", "C"], 4, seed)
        for k in ("trans", "start"):
            m.p[k] = r.normal(size=m.p[k].shape).astype(np.float32) * r.choice([0.3, 1.5])
        limits = np.cumsum([0, *r.integers(0, 40, 6)])
        e = r.normal(size=(7, limits[-1])).astype(np.float32) * 3
        e[0] += r.choice([0, 3, 6])
        first, got = np.zeros(limits[-1], bool), np.zeros(limits[-1], np.int16)
        first[[x for x in limits[:-1] if x < limits[-1]]] = True
        a, b = m.open_stretches(*m.gains(e, first), first)
        n_open += (b - a).sum()
        n_all += limits[-1]
        m._search(e, a, a, b, first, got, cells=int(r.choice([1, 30, 1000])))
        for a, b in zip(limits[:-1], limits[1:]):
            if a < b:
                assert got[a:b].tolist() == _brute_path(m, e[:, a:b])
    assert 0.1 * n_all < n_open < 0.9 * n_all


def test_a_text_longer_than_a_block_is_tagged_as_in_one():
    m = Tagger(["A", "B"], 6, 2)
    m.p["bias"][0] = -0.3
    text = "".join(chr(97 + k) for k in np.random.default_rng(3).integers(0, 26, 9000)) + " Jean et Marie."
    whole = m.tag([text], window=64, halo=8)
    assert len(whole[0]) > 50
    assert m.tag([text, "", "abc"], window=64, halo=8, block=1000)[:1] == whole
    assert m.tag([text], window=64, halo=8, block=1000) == whole


def test_gradients_equal_differences():
    r = np.random.default_rng(1)
    m = Tagger(["A", "B"], 3, 1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    ids = r.integers(0, 50, (6, 4)).astype(np.uint8)
    tags = np.array([[0, 1, 2, 2], [1, 2, 2, 0], [2, 0, 3, 0], [0, 1, 4, 1], [3, 2, 0, 2], [4, 0, 1, 2]])
    _, g = m._gradient(ids, tags)
    for k in ("trans", "out", "bias", "rec", "start"):
        at = (0,) * m.p[k].ndim
        old = m.p[k][at]
        m.p[k][at] = old + 1e-3
        up = m._gradient(ids, tags)[0]
        m.p[k][at] = old - 1e-3
        down = m._gradient(ids, tags)[0]
        m.p[k][at] = old
        assert abs((up - down) / 2e-3 * len(ids) - g[k][at]) < 1e-3


def test_windows_reconcile_to_the_run_over_the_whole():
    m = Tagger(["A"], 6, 2)
    m.p["bias"][0] = 0
    text = "Jean et Marie habitent ici. " * 20
    a, b = (set(m.tag([text], window=w, halo=60)[0]) for w in (64, 4096))
    assert len(a & b) >= 0.97 * len(a | b)  # an untrained state remembers beyond the halo, a little
    assert m.tag([]) == [] and m.tag(["", "x"])[0] == []


def test_training_finds_held_out_mentions_and_redacts(spark):
    names = "Zomar Livia Noel Garance Ulysse Petra Hugo Irma Kevin Lena".split()
    rows = []
    for i in range(160):
        x = names[i % 10] + "abcdefgh"[i % 8]
        t = f"Note pour {x} du jour.\nTel : 06{i:08d}"
        rows.append((i, t, [(10, 10 + len(x), "prenom "), (len(t) - 10, len(t), "TELEPHONE"), (0, 4, None)] if i < 120 else None, "clash"))
    rows += [(500, None, None, None), (501, "", None, None), (502, "Rien ici.", [], None)]
    df = spark.createDataFrame(rows, SCHEMA)
    w = pii.fit(df, sample=130, steps=250)
    assert w == pii.fit(df, sample=130, steps=250)
    held = df.where("entities IS NULL")
    found = {tuple(r) for r in pii.find_mentions(held, w).collect()}
    want = {(i, 10, 10 + len(t.split(" ")[2]), "PRENOM") for i, t, e, _ in rows if e is None and t} | {(i, len(t) - 10, len(t), "TEL") for i, t, e, _ in rows if e is None and t}
    assert len(found & want) >= 0.9 * len(want) and len(found - want) <= 0.1 * len(want)
    red = {r["doc_id"]: r for r in pii.redact(held, w).collect()}
    assert red[500]["redacted_text"] is None and red[501]["redacted_text"] == "" and "[TEL]" in red[130]["redacted_text"]


def test_without_labels_nothing_is_found(spark):
    df = spark.createDataFrame([(1, "Jean", None, "")], SCHEMA)
    w = pii.fit(df)
    assert pii.find_mentions(df, w).count() == 0
    assert pii.find_mentions(df.limit(0), w).count() == 0


def test_spans_are_widened_to_words_not_over_each_other():
    assert pii.whole_words("Vermathel Semee", [(1, 9, "NOM"), (10, 15, "PRENOM")]) == [(0, 9, "NOM"), (10, 15, "PRENOM")]
    assert pii.whole_words("ab", [(0, 1, "A"), (1, 2, "B")]) == [(0, 1, "A"), (1, 2, "B")]
    assert pii.masked("Jean va", [(0, 4, "PRENOM")]) == "[PRENOM] va"


def test_ids_cover_all_characters_one_to_one():
    text = "Éa１​́🌿\ud800"
    assert len(char_ids(text)) == len(text)
    assert char_ids("ÉＥE").tolist() == [char_ids("E")[0]] * 3
