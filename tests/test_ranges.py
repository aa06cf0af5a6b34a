"""Ranges of floors that are merged as posts arrive, against statistics of all posts."""

import random

from test_runs import posts, source

from threadlake.operators import audit as A
from threadlake.plans import jobs
from threadlake.sources import runs

POST = "archive string, tid long, id long, floor long, parent_id long"


def test_merged_ranges_equal_full_statistics(spark, monkeypatch):
    """Gaps over the ends of buckets, equal floors, floors without a number, threads of sub-posts only, in any order of parts."""
    monkeypatch.setattr(A, "BUCKET", 7)
    rng = random.Random(6)
    rows = [("a", rng.randrange(9), i, rng.choice([None, *range(1, 12), *range(20, 60)]), rng.choice([0, 0, 0, 5])) for i in range(400)]
    rows += [("b", 1, 1, 3, 0), ("b", 2, 1, 3, 0), ("b", 2, 2, 3, 0), ("b", 3, 1, 1, 9), ("b", 4, 1, 1, 0), ("b", 4, 2, 100_000_000, 0), ("b", 5, 1, None, 0)]
    whole = spark.createDataFrame(rows, POST)
    want = sorted(map(tuple, A.thread_stats(whole).collect()))
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        cuts, merged = [0, 3, 150, 151, len(rows)], None
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = A.floor_ranges(spark.createDataFrame(rows[a:b], POST))
            merged = part if merged is None else A.merge_ranges(merged, part)
        assert sorted(map(tuple, A.stats_of_ranges(merged).collect())) == want


def test_audit_of_a_store(spark, tmp_path):
    """Equal to an audit of all posts after any runs, from the ranges that the runs keep."""
    store = runs.Store(spark, str(tmp_path / "store"), 8)
    jobs.consolidate_run(spark, source(spark, tmp_path / "one", [(t, 100 * t + f, f) for t in range(1, 6) for f in range(1, 5 * t)], replies=60), store)
    jobs.consolidate_run(spark, source(spark, tmp_path / "two", [(2, 260 + f, 40 + f) for f in range(9)] + [(8, 800, 1)], replies=60), store, resume=False)
    jobs.heal_run(store, posts(spark, [(3, 300 + f, f) for f in range(1, 50)]))
    said = [tuple(r) for r in jobs.audit_store(store).collect()]
    assert said == [tuple(r) for r in A.audit(store.read("thread"), store.read("post")).collect()] and len(said) > 3
    shown = jobs.audit_store(store)._jdf.queryExecution().executedPlan().toString()
    assert "/post/" not in shown and "contents" not in shown
