"""Stored orders, comparisons by digests, sketches and spread groups against plain forms of the same."""

import random
from collections import defaultdict

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlake.operators import digests as DG
from threadlake.operators import media as D
from threadlake.operators import reader as R
from threadlake.operators.pages import StoredOrder
from threadlake.streaming import streams


def test_deep_page_reads_its_ranges(spark, tmp_path):
    """Page 10,000 equals sort, offset and limit, and reads one or two files; ties, nulls and pages after the end."""
    threads = spark.range(0, 100_050).select(F.lit("a").alias("archive"), F.col("id").alias("tid"), F.when(F.col("id") % 50 != 0, F.pmod(F.xxhash64("id"), F.lit(9000))).alias("t"))
    order = StoredOrder(spark, str(tmp_path / "order"), ["-t", "archive", "tid"]).write(threads, 5_000)
    for page in (1, 501, 10_000, 10_005, 10_006):
        got = order.page(page, 10)
        want = R.list_threads(threads.withColumnRenamed("t", "agree"), "agree", "desc", page, 10)
        assert [(r.tid, r.t, r.total) for r in got.collect()] == [(r.tid, r.agree, r.total) for r in want.collect()]
        assert [r.place for r in got.collect()] == list(range((page - 1) * 10 + 1, (page - 1) * 10 + 1 + got.count()))
    rows = spark.read.parquet(f"{order.path}/rows")
    assert len(rows.inputFiles()) > 15
    read = order.page(10_000, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in read
    hit = order.offsets().where("before < 100000 and before + n >= 99991").count()
    assert hit <= 2
    assert order.page(1, 10).count() == 10 and StoredOrder(spark, str(tmp_path / "none"), ["t"]).write(threads.limit(0)).page(1, 5).count() == 0


def test_places_of_hot_groups(spark, tmp_path):
    """One thread holds most rows and lies in several ranges."""
    rng = random.Random(1)
    rows = [("a", 1 if i % 3 else rng.randrange(2, 9), i, rng.choice([None, *range(40)])) for i in range(3000)]
    posts = spark.createDataFrame(rows, "archive string, tid long, id long, create_time long")
    want = posts.withColumn("place", F.row_number().over(W.partitionBy("archive", "tid").orderBy("create_time", "id")))
    assert sorted(map(tuple, R.timeline(posts).select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    order = StoredOrder(spark, str(tmp_path / "order"), ["create_time", "id"], ["archive", "tid"]).write(posts, 300)
    assert order.offsets().where("tid = 1").count() > 3
    last = posts.withColumn("place", F.row_number().over(W.partitionBy("archive", "tid").orderBy(F.asc_nulls_last("create_time"), "id")))
    assert sorted(map(tuple, order.places().select(last.columns).collect()), key=str) == sorted(map(tuple, last.collect()), key=str)
    assert [r.id for r in order.page(50, 30, archive="a", tid=1).collect()] == [r.id for r in last.where("tid = 1 and place between 1471 and 1500").orderBy("place").collect()]


def test_sessions_by_spans(spark):
    """Against a loop over the sorted times of each key; silences of exactly the gap, equal times, no time."""
    rng = random.Random(3)
    rows = [(k, rng.choice([None, *range(-3000, 20_000, 40)])) for k in (1, 1, 1, 2, 3) for _ in range(60)]
    events = spark.createDataFrame(rows, "tid long, s long").select("tid", F.timestamp_seconds("s").alias("ts"))
    times, want = defaultdict(list), []
    for k, s in rows:
        if s is not None:
            times[k].append(s)
    for k, xs in times.items():
        xs.sort()
        run = [xs[0]]
        for x in [*xs[1:], None]:
            if x is None or x - run[-1] > 360:
                want.append((k, run[0], run[-1], len(run)))
                run = []
            run.append(x)
    got = streams.activity_sessions_batch(events).select("tid", F.unix_seconds("start"), F.unix_seconds("end"), "events").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 20


def index(spark, rows):
    return spark.createDataFrame(rows, "archive string, path string, tar string, offset long")


def test_diff_by_digest(spark):
    """Equal to the full outer join for random changes; few rows are left where few differ; an archive without differences has its row."""
    rng = random.Random(8)
    base = {(a, f"{i}/p"): (rng.choice(["x.tar", "y.tar", None]), rng.choice([i, None])) for a in "abc" for i in range(600)}
    changed = dict(base)
    for key in rng.sample([k for k in base if k[0] != "c"], 40):
        change = rng.randrange(4)
        if change == 0:
            del changed[key]
        elif change == 1:
            changed[(key[0], key[1] + "new")] = ("x.tar", 5)
        else:
            tar, offset = changed[key]
            changed[key] = ("z.tar", offset) if change == 2 else (tar, 10_000)
    old, new = (index(spark, [(*k, *v) for k, v in d.items()]) for d in (base, changed))
    want = sorted(map(tuple, D.diff_index(old, new, "x.tar").collect()))
    assert sorted(map(tuple, DG.diff_index_by_digest(old, new, "x.tar").collect())) == want
    assert sorted(map(tuple, DG.diff_index_by_digest(old, new, "x.tar", 3).collect())) == want
    same = sorted(map(tuple, DG.diff_index_by_digest(old, old, "x.tar").collect()))
    assert same == [(a, 0, 0, 0, 0) for a in "abc"]
    assert DG.diff_index_by_digest(old.limit(0), new.limit(0), "x.tar").count() == 0
    left = [df.count() for df in DG.only_differing(old, new, ["archive", "path"])]
    assert max(left) <= 80
    whole = DG.leaf_digests(old, ["archive", "path"], 16)
    parts = DG.add_digests(*(DG.leaf_digests(old.where(w), ["archive", "path"], 16) for w in ("offset % 2 = 0", "offset % 2 = 1 or offset is null")))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_sketches(spark, tmp_path):
    """The error is bounded, repeated users count once, a second run changes nothing, and an update leaves other archives' files."""
    path = str(tmp_path / "sketches")
    users = spark.range(0, 120_000).select(F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("archive"), F.concat(F.lit("p"), F.col("id") % 90_000).alias("portrait"), F.when(F.col("id") % 5 != 0, F.col("id") * 3).alias("scrape_time"))
    DG.update_sketches(users, path)
    exact = {r.archive: r.n for r in users.groupBy("archive").agg(F.count_distinct("portrait").alias("n")).collect()}
    read = lambda: spark.read.parquet(path)
    said = {r.archive: r.users for r in DG.distinct_users(read()).collect()}
    assert said.keys() == exact.keys() and all(abs(said[k] - n) <= 0.03 * n for k, n in exact.items())
    assert DG.distinct_users(read(), ["archive", "day"]).count() == read().count() == 12
    before = {p for p in map(str, (tmp_path / "sketches" / "archive=b").glob("*.parquet"))}
    DG.update_sketches(users.where("archive = 'a'"), path)
    assert {r.archive: r.users for r in DG.distinct_users(read()).collect()} == said
    DG.update_sketches(spark.createDataFrame([("a", "new", None), ("a", None, 5)], "archive string, portrait string, scrape_time long"), path)
    assert {p for p in map(str, (tmp_path / "sketches" / "archive=b").glob("*.parquet"))} == before
    assert said["b"] == DG.distinct_users(read().where("archive = 'b'")).head().users
