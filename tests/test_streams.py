"""Streams whose results don't depend on how rows are cut into batches."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from threadlake.operators import merge as M
from threadlake.sources import io as IO
from threadlake.sources import runs
from threadlake.streaming import streams

SHAPE = "k string, ts timestamp, n long, note string"
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def first(rows, delay, until):
    """Windows and their first rows by (n, k, note, ts), as the stream's rules say, up to a watermark."""
    out = []
    for k in {r[0] for r in rows}:
        left = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        while left:
            inside = [r for r in left if r[1] <= left[0][1] + delay]
            if left[0][1] + delay < until:
                out.append(min(inside, key=lambda r: (r[2] is not None, r[2] or 0, r[3] is not None, r[3] or "", r[1])))
            left = left[len(inside) :]
    return sorted(map(str, out))


def run(spark, place, parts, delay):
    for i, rows in enumerate(parts):
        spark.createDataFrame([(k, at(t), n, note) for k, t, n, note in rows], SHAPE).coalesce(1).write.mode("append").parquet(f"{place}/in")
        stream = streams.stream_first(spark.readStream.schema(SHAPE).parquet(f"{place}/in"), ["k"], "ts", delay, ["n"])
        stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/check").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(SHAPE).parquet(f"{place}/out").select("k", F.unix_seconds("ts").alias("t"), "n", "note").collect()
    return sorted(str((r.k, r.t - int(START.timestamp()), r.n, r.note)) for r in got)


def test_first_rows_do_not_depend_on_batches(spark, tmp_path):
    """Rows that come late within the delay, repeated rows, ties and nulls; large integers beside nulls stay exact."""
    rng, delay = random.Random(4), 100
    rows = [(rng.choice("abc"), t, rng.choice([None, 3, 2**60 + 1, 5]), rng.choice(["x", None, "y"])) for t in sorted(rng.randrange(0, 3000) for _ in range(150))]
    rows += rows[20:25] + [("end", 9000, 1, "z")]
    late = sorted(rows, key=lambda r: r[1] + rng.randrange(90))
    want = first(rows, delay, 9000 - delay)
    one = run(spark, tmp_path / "one", [rows], delay)
    cut = run(spark, tmp_path / "cut", [late[:40], late[40:41], late[41:110], late[110:]], delay)
    assert one == cut == want and len(want) > 20


def posts(spark, rows):
    return IO.conform(spark.createDataFrame([("a", t, i, f, 0, 5, "x", 100, b) for t, i, f, b in rows], "archive string, tid long, id long, floor long, parent_id long, user_id long, contents string, create_time long, scrape_batch_id long"), "post")


def test_merge_in_scrape_order_with_flat_reading(spark, tmp_path, monkeypatch):
    """As many files for the last batch as for an early one, and only files of the batch's buckets and ids."""
    monkeypatch.setattr(runs, "FOLDERS", 3)
    scanned, read = [], runs.Store.read

    def counted(self, name, *rest, **more):
        df = read(self, name, *rest, **more)
        if df is not None and rest:
            scanned.append(len(df.inputFiles()))
        return df

    monkeypatch.setattr(runs.Store, "read", counted)
    merged = None
    for i in range(9):
        rows = [(1, 10 * i + j, j, 9 - j) for j in range(1, 4)] + [(1, 10 * i + 1, 77, 0), (1, 10 * i - 9, 88, 0), (1, 0, 1, 0)]
        part = posts(spark, rows)
        merged = M.merge_posts(posts(spark, []) if merged is None else merged, part, ["scrape_batch_id"])
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streams.stream_merge(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), buckets=4)
    rows = lambda df: sorted(tuple(r) for r in df.select("tid", "id", "floor").collect())
    assert rows(streams.read_merged(spark, str(tmp_path / "out"))) == rows(merged) and (1, 1, 77) in rows(merged)
    assert max(scanned) <= 4 and len(scanned) >= 8


def test_batch_that_runs_again_changes_nothing(spark, tmp_path):
    posts(spark, [(1, 1, 1, 0)]).write.parquet(str(tmp_path / "in"))
    for check in ("one", "one"):
        streams.stream_merge(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / check))
    store = runs.Store(spark, str(tmp_path / "out"))
    assert store.manifest()["run"] == 1 and list(store.manifest()["marks"].values()) == [0]
    # the stream's progress is lost, the store's isn't: the batch has a number that the store knows
    import shutil

    shutil.rmtree(tmp_path / "one")
    streams.stream_merge(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "one"))
    assert store.manifest()["run"] == 1 and store.read("post").count() == 1
    with pytest.raises(runs.Conflict):
        late = store.begin()
        store.begin().commit()
        late.commit()
