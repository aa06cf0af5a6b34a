"""Segments, deletions and block bounds of the search index, against rebuilt indexes and brute force."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadlake.operators import search as X

SHAPE = "archive string, tid long, id long, floor long, contents string"
WORDS = [f"w{i}" for i in range(60)]


def made(rng, n, first=0):
    """Posts of different lengths in which low words are frequent."""
    return [("a" if i % 3 else "b", i // 7, i, i % 7, " ".join(WORDS[min(int(rng.expovariate(0.12)), 59)] for _ in range(rng.randrange(1, 90)))) for i in range(first, first + n)]


def page(spark, index, rows, query, **more):
    threads = spark.createDataFrame(sorted({(r[0], r[1], "t") for r in rows}), "archive string, tid long, title string")
    return [tuple(r) for r in X.search(index, threads, query, **more).select("archive", "tid", "post_id", "rank", "total").collect()]


def brute(rows, words, k):
    """A page of posts with any of the words, by the same formula."""
    docs = [(r[:3], re.findall(r"\w+", r[4] or "")) for r in rows]
    n, average = len(docs), sum(len(t) for _, t in docs) / len(docs)
    df = {w: sum(w in t for _, t in docs) for w in words}
    idf = {w: max(math.log((n - d + 0.5) / (d + 0.5)), 0) or X.FLOOR for w, d in df.items()}
    hits = []
    for key, t in docs:
        c = Counter(t)
        if any(c[w] for w in words):
            rank = -sum(idf[w] * c[w] * (X.K1 + 1) / (c[w] + X.K1 * (1 - X.B + X.B * len(t) / average)) for w in words if c[w])
            hits.append((round(rank, 6), *key))
    return [(a, t, i, r, len(hits)) for r, a, t, i in sorted(hits)[:k]]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = made(random.Random(2), 4000)
    return rows, X.store_index(spark.createDataFrame(rows, SHAPE), str(tmp_path_factory.mktemp("index")))


@pytest.mark.parametrize("query", ["w0", "w20", "w30 OR w22", "w59 OR w58 OR w0"])
def test_pages_equal_brute_force(spark, corpus, query):
    rows, index = corpus
    want = brute(rows, query.split(" OR "), 20)
    got = page(spark, index, rows, query)
    assert [x[:3] for x in got] == [x[:3] for x in want] and all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want, strict=True)) and got[0][4] == want[0][4]
    assert page(spark, index, rows, query, total=False) == [(*x[:4], None) for x in got]


def test_frequent_words_read_few_spans(spark, corpus):
    """A third of the posts has the word, and so every span; the bounds of the blocks leave a part of them."""
    rows, index = corpus
    for query in ("w20", "w40 OR w22"):
        all_, read = X.spans_read(index, query, 10)
        assert all_ > 50 and read < 0.6 * all_
    assert page(spark, index, rows, "w20", page=3, page_size=7) == page(spark, index, rows, "w20", page_size=21)[14:]


def test_extended_index_equals_a_rebuilt_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "SEGMENTS", 2)
    rng = random.Random(3)
    rows = made(rng, 400)
    index = X.store_index(spark.createDataFrame(rows, SHAPE), str(tmp_path / "i"))
    for step in range(4):
        # new, changed and deleted posts; a changed one leaves all numbers as they were
        rows = [r for r in rows if r[2] % 97 != step] + made(rng, 5, 1000 + 10 * step)
        at = rng.randrange(len(rows))
        rows[at] = (*rows[at][:4], " ".join(reversed((rows[at][4] + " changed").split())))
        posts = spark.createDataFrame(rows, SHAPE)
        assert X.index_currency(index, posts).where("not current").count() > 0
        index = X.extend_index(index, posts)
    assert X.index_currency(index, posts).where("not current").isEmpty() and X.extend_index(index, posts) is index
    assert len(index.manifest["segments"]) <= X.SEGMENTS and index.manifest == X.open_index(spark, str(tmp_path / "i")).manifest
    rebuilt = X.store_index(posts, str(tmp_path / "j"))
    assert index.statistics == rebuilt.statistics
    for query in ("changed", "w20 OR w2", '"w1 w2"', "w1 AND w2 NOT w3"):
        assert page(spark, index, rows, query, page_size=40) == page(spark, rebuilt, rows, query, page_size=40)


def test_changed_post_with_equal_counts_is_seen(spark, tmp_path):
    rows = [("a", 1, 1, 1, "one two"), ("a", 1, 2, 2, None), ("a", 2, 3, 1, "two three")]
    index = X.store_index(spark.createDataFrame(rows, SHAPE), str(tmp_path / "i"))
    swapped = spark.createDataFrame([(*rows[0][:4], "two one"), *rows[1:]], SHAPE)
    assert [r.indexed for r in X.index_currency(index, swapped).where("not current").collect()] == [2]
    index = X.extend_index(index, swapped)
    assert page(spark, index, rows, '"two one"') == [("a", 1, 1, page(spark, index, rows, '"two one"')[0][3], 1)] and page(spark, index, rows, '"one two"') == []


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], SHAPE)
    index = X.store_index(none, str(tmp_path / "i"))
    assert page(spark, index, [("a", 1)], "word") == [] and index.statistics == (0, 0)
    index = X.extend_index(index, spark.createDataFrame([("a", 1, 1, 1, "word")], SHAPE))
    assert [x[2] for x in page(spark, index, [("a", 1)], "word")] == [1]
    index = X.extend_index(index, none)
    assert page(spark, index, [("a", 1)], "word") == [] and index.statistics == (0, 0) and index.live(index.posts.select("segment", "doc", F.lit(1))).isEmpty()
