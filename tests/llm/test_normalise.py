import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from noteforge.llm import normalise as n

CASES = {
    "Ｖｅｒ": "Ver",
    "ﬁn": "fin",
    "été": "été",
    "a​b": "ab",
    "a­b": "ab",
    "a b": "a b",
    "a‑b": "a-b",
    "Аlice": "Alice",
    "\u13aabc": "Gbc",
    "\u056fbc": "kbc",
    "\U0001d400\U0001d41b": "Ab",
    "\u24b6b": "Ab",
    "mi\u017fe": "mise",
    "\u0133s": "ijs",
    "\u01c6": "d\u017e",
    "I\u0416": "IZ",
    "\ufefb": "\u0644\u0627",
    "\u212bl": "\u00c5l",
}
FINE = ["5 µg", "3 m²", "1ª", "№ 5", "2 ℓ", "20 € – 30 €…", "“x”", "中文", "37 °C", "œil", "« oui »", "onde δ", "Мне лучше", "🌿 👨‍⚕️", "été", "", "a-b", "tab\tici\n", None]


def test_cases_and_what_is_none():
    for text, form in CASES.items():
        assert n.canonical(text) == form and n.canonical(form) == form, text
    for text in FINE:
        assert n.canonical(text) == text and not list(n.changes(text))


def test_the_quick_check_calls_no_character_stable_that_changes(spark):
    rows = [(k, chr(k)) for r in n._PLANES[:1] for k in r if k < 0x400]
    df = spark.createDataFrame(rows, "k int, c string")
    calm = {r["k"] for r in df.where(n.stable(df["c"])).collect()}
    assert len(calm) > 400 and all(n.canonical(chr(k)) == chr(k) and n.canonical("a" + chr(k)) == "a" + chr(k) for k in calm)
    for plane in n._PLANES:
        for c in map(chr, plane):
            if not n.UNSTABLE.search(c):
                assert unicodedata.is_normalized("NFC", c)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeé \ń̀​ Ａﬁаеoο🌿‍µœ-‑3"), max_size=30))
def test_the_form_is_stable_and_splicing_equals_the_whole(text):
    once = n.canonical(text)
    assert n.canonical(once) == once
    assert n._canonical_segment(text) == once or unicodedata.normalize("NFC", once) == once


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aÉß œŒæ’µ²½ªａ́е9 "), max_size=20))
def test_the_short_way_of_folding_equals_the_long_one(text):
    t = n.canonical(text)
    for x, y in n._ONE_TO_MANY:
        t = t.replace(x, y)
    assert n.fold(text) == n._MARKS.sub("", unicodedata.normalize("NFKD", t.casefold())).replace("μ", "µ")


def test_frames(spark):
    rows = [(1, "a b", {"NOM": ["x", None, "Аb"], "TEL": None}, "k"), (2, None, None, None), (3, "", {}, "k"), (4, "ok", {"NOM": ["é"]}, "k"), (4, "ok", {"NOM": ["é"]}, "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, context map<string,array<string>>, field string")
    assert sorted(map(tuple, n.find_unusual(df).collect())) == [(1, "context"), (1, "text"), (4, "context"), (4, "context")]
    got = {r["doc_id"]: r for r in n.canonical_frame(df).collect()}
    assert got[1]["canonical_text"] == "a b" and got[1]["canonical_context"] == {"NOM": ["x", None, "Ab"], "TEL": None} and got[1]["changed"]
    assert got[2]["canonical_text"] is None and not got[2]["changed"] and not got[3]["changed"] and got[4]["changed"]
    assert n.find_unusual(df.limit(0)).count() == 0 and n.canonical_frame(df.limit(0)).count() == 0
