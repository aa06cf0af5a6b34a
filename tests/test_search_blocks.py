"""Blocks of the search index: made by the task that holds their posts, against a brute force."""

import random
from collections import defaultdict

from threadlake.operators import search as X

SHAPE = "archive string, tid long, id long, floor long, contents string"


def rows_of(rng, n):
    return [("a" if i % 3 else "b", i // 7, i, i % 7, " ".join(f"w{min(int(rng.expovariate(0.2)), 30)}" for _ in range(rng.choice([0, 1, 5, 40])))) for i in range(n)]


def test_blocks_equal_brute_force(spark, tmp_path, monkeypatch):
    """Every post of a token is in one block, whatever is made at once; a front holds what no other post beats in count and length."""
    monkeypatch.setattr(X, "AT_ONCE", 300)
    index = X.store_index(spark.createDataFrame(rows_of(random.Random(11), 700), SHAPE), str(tmp_path))
    posts = {r.doc: r for r in index.posts.collect()}
    assert [tuple(posts[d][c] for c in ("archive", "tid", "post_id")) for d in sorted(posts)] == sorted((r.archive, r.tid, r.post_id) for r in posts.values())
    want = defaultdict(dict)
    for r in posts.values():
        for i, t in enumerate(r.tokens):
            want[t].setdefault(r.doc, []).append(i)
    got = defaultdict(dict)
    spans = set()
    for b in index.postings.collect():
        at = [(e.doc, e.n_tokens, e.positions) for e in b.entries]
        assert [x[0] for x in at] == sorted(x[0] for x in at) and len({d >> X.SPAN for d, *_ in at}) == 1 and b.span <= at[0][0]
        assert (b.token, b.segment, b.span) not in spans
        spans.add((b.token, b.segment, b.span))
        assert all(n == len(posts[d].tokens) for d, n, _ in at)
        pairs = {(len(p), n) for _, n, p in at}
        assert (b.n, b.most, b.least) == (len(at), max(c for c, _ in pairs), min(n for _, n in pairs))
        assert {tuple(f) for f in b.front} == {(c, n) for c, n in pairs if not any((c2 >= c and n2 <= n) and (c2, n2) != (c, n) for c2, n2 in pairs)}
        for d, _, p in at:
            assert d not in got[b.token]
            got[b.token][d] = p
    assert got == want


def test_building_shuffles_no_tokens(spark, tmp_path):
    """Tokens went through a shuffle, a row for each, that was many times the texts; blocks are made where their posts are."""
    index = X.store_index(spark.createDataFrame(rows_of(random.Random(12), 50), SHAPE), str(tmp_path))
    plan = X._blocks(index.posts, 1).sortWithinPartitions("token", "span")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_texts_without_marks_take_the_same_tokens(spark):
    texts = ["Plain ASCII, 2x", "É à İstanbul ﬁ ẞ", "İ", "", "ÀB c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.tokens(df.t)).collect()] == [X._query_tokens(t) for t in texts]


def test_deleted_posts_move_no_tokens(spark, tmp_path, monkeypatch):
    """More deleted posts than may be broadcast one by one: their marks are, and neither tokens nor matches are shuffled for them."""
    rows = rows_of(random.Random(13), 600)
    index = X.store_index(spark.createDataFrame(rows, SHAPE), str(tmp_path / "i"))
    now = spark.createDataFrame([r for r in rows if r[2] % 4], SHAPE)
    monkeypatch.setattr(X, "BROADCAST_ROWS", 30)
    less = X.extend_index(index, now)
    assert less.manifest["gone"] == 150
    plan = less.live(less.posts.select("segment", "doc", "tokens"))._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    assert sorted(r.post_id for r in less.live(less.posts).collect()) == [r[2] for r in rows if r[2] % 4]
    assert less.statistics == X.store_index(now, str(tmp_path / "j")).statistics
    monkeypatch.setattr(X, "BROADCAST_ROWS", 1)
    assert less.live(less.posts).count() == 450


def test_phrases_and_prefixes_are_counted_once(spark, tmp_path, monkeypatch):
    """A query of phrases and prefixes alone meets its posts when it counts them; they were met a second time for their ranks."""
    rows = rows_of(random.Random(14), 300)
    index = X.store_index(spark.createDataFrame(rows, SHAPE), str(tmp_path))
    threads = spark.createDataFrame(sorted({(r[0], r[1], "t") for r in rows}), "archive string, tid long, title string")
    times, counts = [], X._Asked.counts
    monkeypatch.setattr(X._Asked, "counts", lambda self, *a: times.append(a) or counts(self, *a))
    for query, fits in (('"w1 w2"', lambda t: "w1 w2 " in f"{t} "), ("w1*", lambda t: "w1" in t), ('"w3 w1" OR w2*', lambda t: "w3 w1 " in f"{t} " or "w2" in t)):
        want = sorted(r[2] for r in rows if fits(r[4]))
        for total in (True, False):
            times.clear()
            got = X.search(index, threads, query, page_size=200, total=total).collect()
            assert len(want) < 200 and len(times) == 1
            assert sorted(r.post_id for r in got) == want and {r.total for r in got} == {len(want) if total else None}


def test_blocks_store_bounds_once(spark, tmp_path):
    """The largest count and the smallest length are the ends of the front; stored beside it they made rows that spilled when they were sorted."""
    index = X.store_index(spark.createDataFrame(rows_of(random.Random(15), 60), SHAPE), str(tmp_path))
    folder = index.manifest["segments"][0]["folder"]
    assert set(spark.read.parquet(f"{tmp_path}/segments/{folder}/postings").columns) == {"token", "segment", "span", "n", "front", "entries"}
    assert all((b.most, b.least) == (max(len(e.positions) for e in b.entries), min(e.n_tokens for e in b.entries)) for b in index.postings.collect())
