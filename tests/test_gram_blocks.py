"""Blocks of grams: long texts, texts with the same key, queries over several grams."""

import random
import time

from threadlake.operators import substrings as G

SHAPE = "archive string, tid long, title string"


def test_long_texts_take_time_in_proportion(spark, tmp_path):
    """The characters of a text were split anew for each of its places: 60,000 of them took minutes."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(60_000)) for _ in range(4)]
    rows = [("a", i, t + ("needle in it" if i == 2 else "")) for i, t in enumerate(texts)]
    began = time.time()
    index = G.store_grams(spark.createDataFrame(rows, SHAPE), ["archive", "tid"], "title", str(tmp_path))
    for q in ("needle in", "abcdef", "h a"):
        assert sorted(r.tid for r in G.find_substring(index, q).collect()) == [i for _, i, t in rows if q in t]
    assert time.time() - began < 60


def test_blocks_equal_containment(spark, tmp_path, monkeypatch):
    """Blocks of few texts; a character of no meaning, and keys that repeat, give what SQL gives for each row."""
    monkeypatch.setattr(G, "BLOCK", 40)
    rng = random.Random(7)
    some = ["", "x￿y", "x￾y", "￿", "文", "中文", "xab", "ab"]
    rows = [("a", i // 2, t) for i, t in enumerate(some + ["".join(rng.choice("ab中文. ") for _ in range(rng.randrange(60))) for _ in range(120)])]
    G.store_grams(spark.createDataFrame(rows, SHAPE), ["archive", "tid"], "title", str(tmp_path))
    index = G.open_grams(spark, ["archive", "tid"], str(tmp_path))
    assert index.texts.select("block").distinct().count() > 20
    for q in ["￿", "￾", "x￿", "b", "a中", "中文a", "文中文中", "ab a", ". ", "中文中", "bab文", "a中文b"]:
        assert sorted(r.tid for r in G.find_substring(index, q).collect()) == sorted(i for _, i, t in rows if q in t), q


def test_an_empty_table(spark, tmp_path):
    index = G.store_grams(spark.createDataFrame([], SHAPE), ["archive", "tid"], "title", str(tmp_path))
    assert G.find_substring(index, "abcd").isEmpty() and G.find_substring(index, "abc").isEmpty()
