"""Substring search by grams against plain containment."""

import random

import pytest

from threadlake.operators import reader as R
from threadlake.operators import substrings as G


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    some = ["High and low", "anana banana", "中文测试文本", "测试", "a中b文", "中 文", "", " ", "x", "ÀÉ É", "100% _sure_ \\ yes", "aaaa", "a\0b", None, "日本語テスト中文", "𠀀𠀁 rare"]
    return [("a" if i % 2 else "b", i, t, f"f{i % 3}") for i, t in enumerate(some + ["".join(rng.choice("ab中文 A") for _ in range(rng.randrange(40))) for _ in range(150)])]


@pytest.fixture(scope="module")
def stored(spark, texts, tmp_path_factory):
    table = spark.createDataFrame(texts, "archive string, tid long, title string, forum_name string")
    return table, G.store_grams(table, ["archive", "tid"], "title", str(tmp_path_factory.mktemp("grams")))


def test_same_as_containment(spark, texts, stored):
    rng = random.Random(6)
    queries = ["high", "ANA", "中文", "文", "测试", "a", "ab", "中b文", "% _", "\\", "é", " ", "aaaa", "aaaaa", "none of it", "𠀀𠀁", "テスト中", "中文a中"] + ["".join(rng.choice("ab中文 ") for _ in range(rng.randrange(2, 6))) for _ in range(6)]
    for q in queries:
        got = sorted(r.tid for r in G.find_substring(stored[1], q).collect())
        assert got == [i for _, i, t, _ in texts if t is not None and q.lower() in t.lower()], q
    with pytest.raises(ValueError):
        G.find_substring(stored[1], "")


def test_reads_postings_of_its_grams_only(stored):
    """A Chinese word within a longer run is found, by the postings of its pair of characters, without a look at the texts."""
    df = G.find_substring(stored[1], "中文")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() > 2 and "In(gram, [中文])" in plan.replace("EqualTo(gram,中文)", "In(gram, [中文])") and "folded" not in plan


def test_suggestions_equal_a_scan(stored):
    table, index = stored
    for q in ("an", "A中", "high"):
        assert [tuple(r) for r in G.suggest_indexed(index, table, q).collect()] == [tuple(r) for r in R.suggest(table, q).collect()]
