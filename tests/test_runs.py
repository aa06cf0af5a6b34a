"""Consolidation by runs over buckets: resuming, killed runs, healing in between, and what a run touches."""

import pytest
from pyspark.sql import functions as F

from threadlake.plans import jobs
from threadlake.sources import io as IO
from threadlake.sources import runs

POST = "archive string, tid long, id long, floor long, parent_id long, user_id long, contents string, create_time long, is_thread_author boolean, scrape_batch_id long"


def posts(spark, rows, archive="a"):
    """rows: (tid, id, floor[, contents, batch])"""
    return spark.createDataFrame([(archive, r[0], r[1], r[2], 0, 5, r[3] if len(r) > 3 else "x", 100, False, r[4] if len(r) > 4 else 0) for r in rows], POST)


def source(spark, path, rows, archive="a", status=0, replies=1, **more):
    """A source folder with the threads and one user of the posts."""
    tids = sorted({r[0] for r in rows})
    IO.write_archive(posts(spark, rows, archive), f"{path}/post", "post")
    IO.write_archive(spark.createDataFrame([(archive, t, f"title {t}", "f", 1, replies, status) for t in tids], "archive string, tid long, title string, forum_name string, forum_id long, reply_num long, scrape_status int"), f"{path}/thread", "thread")
    IO.write_archive(spark.createDataFrame([(archive, t, f"p{t}", "n") for t in tids], "archive string, tid long, portrait string, nickname string"), f"{path}/user", "user")
    for name, df in more.items():
        df.write.parquet(f"{path}/{name}")
    return str(path)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    return runs.Store(spark, str(tmp_path / "store"), 16)


def test_run_equals_consolidate(spark, tmp_path, store):
    listing = spark.createDataFrame([("a", 9, "lost", 5, 2, 100, 0)], "archive string, tid long, title string, author_id long, reply_num long, create_time long, pos long")
    progress = spark.createDataFrame([("a", 9, "deleted"), ("a", 3, "failed")], "archive string, tid long, state string")
    one = source(spark, tmp_path / "one", [(t, 10 * t + i, i) for t in range(1, 6) for i in range(1, 4)])
    two = source(spark, tmp_path / "two", [(2, 21, 7, "later", 9), (2, 29, 9), (6, 61, 2, "second", 5), (6, 61, 3, "first", 4), (7, 0, 1)], listing=listing, progress=progress)
    for path in (one, two):
        jobs.consolidate_tables(spark, path, str(tmp_path / "target"), str(tmp_path / "staging"))
        jobs.consolidate_run(spark, path, store, resume=False)
    for name, columns in (("post", ["tid", "id", "floor", "contents"]), ("thread", ["tid", "title", "forum_name", "scrape_status"]), ("user", ["tid", "portrait"]), ("search_index", ["tid", "post_id", "tokens"])):
        assert got(store.read(name), *columns) == got(spark.read.parquet(f"{tmp_path}/target/{name}"), *columns)
    assert (6, 61, 3, "first") in got(store.read("post"), "tid", "id", "floor", "contents")
    assert got(jobs.archive_totals(store), "archive", "threads", "complete", "deleted", "failed", "posts", "users") == got(spark.read.parquet(f"{tmp_path}/target/summary"), "archive", "threads", "complete", "deleted", "failed", "posts", "users")


def test_used_staging_folder_rolls_nothing_back(spark, tmp_path):
    """A heal between two runs stays, though the second run has the first one's staging folder."""
    target, staging = str(tmp_path / "target"), str(tmp_path / "staging")
    jobs.consolidate_tables(spark, source(spark, tmp_path / "one", [(1, 11, 1)]), target, staging)
    IO.write_archive(posts(spark, [(1, 11, 1), (1, 12, 2)]), f"{tmp_path}/healed", "post")
    IO.write_archive(IO.read_table(spark, f"{tmp_path}/healed", "post"), f"{target}/post", "post")
    jobs.consolidate_tables(spark, source(spark, tmp_path / "two", [(5, 51, 1)], "b"), target, staging)
    assert got(IO.read_table(spark, f"{target}/post", "post"), "archive", "id") == [("a", 11), ("a", 12), ("b", 51)]


def test_heal_between_runs(spark, tmp_path, store):
    jobs.consolidate_run(spark, source(spark, tmp_path / "one", [(1, 1, 1)], replies=40), store)
    report = jobs.heal_run(store, posts(spark, [(1, i, i, "late", 2) for i in range(1, 31)] + [(1, 7, 7, "first", 1)]))
    assert got(report, "archive", "added_posts") == [("a", 29)]
    jobs.consolidate_run(spark, source(spark, tmp_path / "two", [(2, 2, 1)], "b"), store)
    assert store.read("post").where("archive = 'a'").count() == 30 and got(store.read("post").where("id = 7"), "contents") == [("first",)]
    assert got(jobs.archive_totals(store), "archive", "posts") == [("a", 30), ("b", 1)]


def test_only_touched_buckets_are_written(spark, tmp_path, store):
    jobs.consolidate_run(spark, source(spark, tmp_path / "one", [(t, t, 1) for t in range(1, 200)]), store)
    before = store.manifest()
    jobs.consolidate_run(spark, source(spark, tmp_path / "two", [(3, 1003, 2), (700, 700, 1)]), store, resume=False)
    after = store.manifest()
    changed = {b for b, folders in after["tables"]["post"].items() if before["tables"]["post"].get(b) != folders}
    assert len(before["tables"]["post"]) == 16 and changed == set(map(str, store.touched(posts(spark, [(3, 1, 1), (700, 1, 1)]))))
    files = {f.rsplit("/", 2)[-2] for f in store.read("post").where("tid = 3").inputFiles()} and store.read("post", store.touched(posts(spark, [(3, 1, 1)]))).inputFiles()
    assert all(after["tables"]["post"][str(store.touched(posts(spark, [(3, 1, 1)]))[0])][0] in f for f in files)
    assert store.read("post").count() == 201 and store.read("merge_progress").count() == 200


def test_killed_run_leaves_the_old_state(spark, tmp_path, store, monkeypatch):
    one, two = source(spark, tmp_path / "one", [(1, 11, 1), (2, 21, 1)]), source(spark, tmp_path / "two", [(1, 12, 2), (3, 31, 1)])
    jobs.consolidate_run(spark, one, store)
    was = store.manifest()
    write = runs.Run.write
    for dies_at in ("user", "search_index", "summary"):
        def dying(self, name, *rest, at=dies_at):
            if name == at:
                raise KeyboardInterrupt
            return write(self, name, *rest)

        monkeypatch.setattr(runs.Run, "write", dying)
        with pytest.raises(KeyboardInterrupt):
            jobs.consolidate_run(spark, two, store, resume=False)
        monkeypatch.undo()
        assert store.manifest() == was and got(store.read("post"), "id") == [(11,), (21,)]
    left = store.vacuum(older_than=-60)
    assert len(left) == 3 and got(store.read("post"), "id") == [(11,), (21,)]
    jobs.consolidate_run(spark, two, store, resume=False)
    assert got(store.read("post"), "id") == [(11,), (12,), (21,), (31,)]


def test_resumed_run_skips_merged_threads(spark, tmp_path, store):
    jobs.consolidate_run(spark, source(spark, tmp_path / "one", [(1, 11, 1)]), store)
    again = source(spark, tmp_path / "two", [(1, 12, 2), (2, 21, 1)])
    jobs.consolidate_run(spark, again, store)
    assert got(store.read("post"), "id") == [(11,), (21,)]
    assert jobs.consolidate_run(spark, again, store) is None and store.manifest()["run"] == 2
    jobs.consolidate_run(spark, again, store, resume=False)
    assert got(store.read("post"), "id") == [(11,), (12,), (21,)]


def test_two_runs_at_once(spark, store):
    rows = IO.conform(posts(spark, [(1, 11, 1)]), "post")
    one, two = store.begin(), store.begin()
    one.write("post", rows, store.touched(rows))
    two.write("post", rows.withColumn("id", F.lit(99).cast("long")), store.touched(rows))
    assert one.commit(stream=4) == 1
    with pytest.raises(runs.Conflict):
        two.commit()
    assert got(store.read("post"), "id") == [(11,)] and store.manifest()["marks"] == {"stream": 4}


def test_appends_are_compacted(spark, store):
    for i in range(20):
        run = store.begin()
        run.append("post", IO.conform(posts(spark, [(t, 100 * t + i, i) for t in (1, 2)]), "post"))
        run.commit()
    places = store.manifest()["tables"]["post"]
    assert store.read("post").count() == 40 and max(map(len, places.values())) <= runs.FOLDERS + 1
    assert got(store.read("post", store.touched(posts(spark, [(1, 1, 1)]))).where("tid = 1"), "floor") == got(spark.range(20), "id")
