import random
import re

import pytest

from noteforge.llm import pieces as p


def _texts(r, n):
    return ["".join(r.choice("ab \n" if r.random() < 0.5 else "abcdéfghij") for _ in range(r.randint(0, 400))) for _ in range(n)]


def _check(text, got, limit, overlap):
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (a, b, _), (c, d, _) in zip(got, got[1:]):
        assert c <= b and b - c <= overlap and a < b < d
    assert all(b - a <= limit for a, b, _ in got)


def test_sections_cover_texts_and_know_the_longest_line_and_run():
    r = random.Random(1)
    for text in _texts(r, 800):
        limit = r.randint(10, 40)
        overlap, size = r.randint(0, limit - 1), r.randint(20, 90)
        m = max(1, -(-len(text) // size))
        raw, (before, after) = text.encode(), p.halos(limit, overlap)
        m = max(1, -(-len(raw) // size))
        rows = [p.section(raw[(low := max(0, k * size - before)) : (k + 1) * size + after], low, k * size, size, k == m - 1, limit, overlap) for k in range(m)]
        at, got = 0, []
        for row in rows:
            got += [(s + at, e + at, kind) for s, e, _, _, kind in row[9]]
            assert all(raw[bs:be].decode() == text[s + at : e + at] for s, e, bs, be, _ in row[9])
            at += row[0]
        _check(text, got, limit, overlap)


def test_split_texts_and_levels_in_spark_equal_python(spark):
    r = random.Random(2)
    texts = [t * 3 for t in _texts(r, 60)] + ["", None, "x" * 500, "mot " * 200, "l\n" * 300]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, id string")
    got = {}
    for row in p.split_texts(df, limit=60, overlap=10, size=100).orderBy("doc_id", "piece_no").collect():
        got.setdefault(row["doc_id"], []).append((row["span_start"], row["span_end"], row["piece_no"]))
    assert set(got) == {i for i, t in enumerate(texts) if t is not None}
    for i, rows in got.items():
        assert [x[2] for x in rows] == list(range(len(rows)))
        _check(texts[i], [(a, b, "") for a, b, _ in rows], 60, 10)
    levels = {r["doc_id"]: r["cut_level"] for r in p.cut_levels(df, limit=60, overlap=10, size=100).collect()}
    for i, t in enumerate(texts):
        if t is not None and len(t) > 60:
            want = "line" if max(map(len, t.split("\n"))) <= 60 else "word" if max(map(len, re.split(r"[ \t\n]", t))) <= 60 else "char"
            assert levels.pop(i) == want
    assert not levels
    assert p.split_texts(df.limit(0)).count() == 0 and p.cut_levels(df.limit(0)).count() == 0


def test_cuts_prefer_lines_then_words():
    text = "aaaa bbbb\ncccc dddd eeee\n" + "f" * 30
    lines, starts, ends = p.boundaries(text)
    words = sorted(starts + ends)
    assert [c for *_, c in p.cut(0, len(text), lines, words, 12, 3)][:2] == ["line", "word"]
    with pytest.raises(ValueError):
        p.cut(0, 5, [], [], 4, 4)


def test_files_are_read_in_ranges(spark, tmp_path):
    r = random.Random(4)
    text = "".join(r.choice("éa b\nçdef🌿") for _ in range(5000)) + "z" * 400 + " fin"
    path = tmp_path / "gros.txt"
    path.write_text(text, encoding="utf-8", newline="")
    (tmp_path / "vide.txt").write_text("")
    rows = p.split_files(spark, [str(path), str(tmp_path / "vide.txt")], limit=80, overlap=10, size=700).orderBy("path", "piece_no").collect()
    raw = text.encode()
    own = [x for x in rows if x["path"] == str(path)]
    _check(text, [(x["span_start"], x["span_end"], "") for x in own], 80, 10)
    assert [x["piece_no"] for x in own] == list(range(len(own)))
    for x in own:
        assert raw[x["byte_start"] : x["byte_end"]].decode() == text[x["span_start"] : x["span_end"]]
    assert len(rows) - len(own) == 1
    assert {x["cut_level"] for x in p.file_levels(spark, [str(path)], limit=80, overlap=10, size=700).collect()} == {"char"}
    with pytest.raises(FileNotFoundError):
        p.split_files(spark, [str(tmp_path / "nulle.txt")])


def test_invalid_bytes_keep_all_byte_offsets(spark, tmp_path):
    r = random.Random(9)
    raw = b"".join(r.choice([b"\xff", b"\x80\x80\x80\x80\x80", "é".encode(), "�".encode(), b"mot ", b"\n", b"\xe2\x82", "🌿".encode(), b"abcdefgh"]) for _ in range(3000))
    path = tmp_path / "casse.txt"
    path.write_bytes(raw)
    rows = p.split_files(spark, [str(path)], limit=60, overlap=10, size=500).orderBy("piece_no").collect()
    assert rows[0]["byte_start"] == 0 and rows[-1]["byte_end"] == len(raw)
    for x, y in zip(rows, rows[1:]):
        assert x["byte_start"] < y["byte_start"] <= x["byte_end"] < y["byte_end"]
    for x in rows:
        assert len(raw[x["byte_start"] : x["byte_end"]].decode(errors="surrogateescape")) == x["span_end"] - x["span_start"] <= 60


def test_a_long_text_is_dealt_out_and_takes_time_in_proportion(spark):
    text = "Une ligne de texte assez longue, avec des accents é è à, pour une note.\n" * 60_000
    df = spark.createDataFrame([(1, text), (2, "x" * 100_000)], "doc_id bigint, text string")
    table = p.sections(df.where("doc_id = 1"))
    assert table.where("length > 0").count() == -(-len(text.encode()) // p.RANGE)
    assert {r["doc_id"]: r["cut_level"] for r in p.cut_levels(df).collect()} == {1: "line", 2: "char"}
    rows = p.split_texts(df.where("doc_id = 1")).orderBy("piece_no").collect()
    _check(text, [(r["span_start"], r["span_end"], "") for r in rows], p.LIMIT, p.OVERLAP)
