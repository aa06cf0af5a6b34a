"""Hand-written archives: one case for each rule of the operators."""

import sqlite3
import tarfile

import pytest
from pyspark.sql import functions as F

from threadlake.functions import scalars as C
from threadlake.operators import audit as A
from threadlake.operators import media as D
from threadlake.operators import merge as M
from threadlake.operators import planning as P
from threadlake.operators import search as X
from threadlake.operators import select as S
from threadlake.operators import users as U
from threadlake.plans import jobs
from threadlake.sources import io as IO
from threadlake.sources.tars import read_tar_members
from threadlake.streaming import streams

POST = "archive string, tid long, id long, floor long, parent_id long, user_id long, contents string, create_time long, is_thread_author boolean, scrape_batch_id long"


def posts(spark, rows):
    """rows: (tid, id, floor, parent_id[, user_id, contents, author, batch])"""
    full = [("a", r[0], r[1], r[2], r[3], r[4] if len(r) > 4 else 5, r[5] if len(r) > 5 else "x", 100, r[6] if len(r) > 6 else False, r[7] if len(r) > 7 else 0) for r in rows]
    return spark.createDataFrame(full, POST)


def threads(spark, rows):
    return spark.createDataFrame([("a", *r) for r in rows], "archive string, tid long, title string, reply_num long, scrape_status int")


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def run(tid, first, last, start=1):
    return [(tid, 1000 * tid + f, f, 0) for f in range(first, last + 1)]


def test_merge_first_wins_and_is_idempotent(spark):
    target = posts(spark, [(1, 11, 1, 0)])
    source = posts(spark, [(1, 11, 9, 0), (1, 12, 3, 0), (1, 12, 2, 0), (1, 0, 1, 0), (1, -1, 1, 0), (1, 13, 1, 0, 5, None)])
    once = M.merge_posts(target, source)
    assert got(once, "id", "floor") == [(11, 1), (12, 2)]
    assert got(M.merge_posts(once, source), "id", "floor") == got(once, "id", "floor")
    halves = M.merge_posts(M.merge_posts(target, source.where("floor <= 2")), source.where("floor > 2"))
    assert got(halves, "id", "floor") == got(once, "id", "floor")


def test_users_need_portrait_and_nickname(spark):
    shape = "archive string, tid long, portrait string, nickname string"
    source = spark.createDataFrame([("a", 1, "p", "n"), ("a", 1, "q", None), ("a", 1, None, "m")], shape)
    assert got(M.merge_users(source.limit(0), source), "portrait") == [("p",)]


def test_audit_reasons(spark):
    rows = [*run(1, 1, 30), *run(1, 61, 90), *run(2, 1, 30), *run(3, 1, 30), *run(3, 61, 90), (5, 51, 1, 7), *run(6, 1, 3), *run(7, 1, 3), *run(8, 1, 30)]
    t = threads(spark, [(1, "gap", 90, 0), (2, "short", 60, 0), (3, "deleted floors", 60, 0), (4, "empty", 5, 0), (5, "subs only", 5, 0), (6, "x" * 70, 7, 1), (7, "failed", 7, 2), (8, "lost", 60, 0)])
    lost = A.lost_page_tids(spark.createDataFrame([("a", 8, "d - ERROR - m - FetchPosts - < pn:3 > - Request failed"), ("a", 2, "d - ERROR - m - Other - Request failed")], "archive string, tid long, line string"))
    found = A.audit(t, posts(spark, rows), lost_tids=lost)
    assert got(found, "tid", "reason", "missing", "max_gap", "floors_saved") == [(1, "page-gap(30)", 30, 30, 60), (2, "short", 30, 0, 30), (4, "empty", 5, 0, 0), (5, "empty", 4, 0, 0), (6, "verify-del", 7, 0, 0), (7, "retry-failed", 4, 0, 3), (8, "log-confirmed", 30, 0, 30)]
    assert [r.tid for r in found.collect()] == [1, 2, 8, 6, 4, 5, 7]
    assert found.where("tid = 6").first().title == "x" * 60
    assert A.audit(t, posts(spark, rows), skip_deleted=True).where("reason = 'verify-del'").isEmpty()


def test_equal_floors_have_gap_minus_one(spark):
    rows = posts(spark, [(1, 1, 1, 0), (1, 2, 1, 0), (2, 3, 4, 0), (3, 4, 1, 0), (3, 5, 250_001, 0)])
    expected = [(1, -1), (2, 0), (3, 249_999)]
    assert got(A.thread_stats(rows), "tid", "max_gap") == got(A.thread_stats(rows, two_step=True), "tid", "max_gap") == expected


def test_heal(spark):
    t = threads(spark, [(1, "del", 3, 1), (2, "del", 3, 1), (3, "short", 60, 0)])
    p = posts(spark, run(3, 1, 3))
    fetched = posts(spark, [*run(1, 1, 3), *run(3, 1, 60), *run(9, 1, 2)])
    out = jobs.audit_and_heal(t, p, fetched)
    assert got(out["thread"], "tid", "scrape_status") == [(1, 0), (2, 1), (3, 0)]
    assert got(out["report"], "added_posts", "revived") == [(60, 1)]
    assert got(out["left"], "tid") == [(2,)]
    assert out["post"].where("tid = 9").isEmpty()


def test_stubs(spark):
    progress = spark.createDataFrame([("a", 1, "deleted"), ("a", 1, "failed"), ("a", 2, "failed"), ("a", 3, "deleted"), ("b", 4, "deleted")], "archive string, tid long, state string")
    listing = spark.createDataFrame([("a", 1, "one", 7, 2, 50, 0)], "archive string, tid long, title string, author_id long, reply_num long, create_time long, pos long")
    merged = spark.createDataFrame([("a", 3)], "archive string, tid long")
    assert got(M.stub_threads(listing, progress, merged, "f"), "tid", "title", "scrape_status") == [(1, "one", 1), (2, "[tid=2]", 2)]


def test_forums(spark):
    shape = "archive string, forum_name string, forum_id long, member_num long, post_num long, thread_num long, slogan string"
    rows = [("a", "p", 0, 1, 0, 0, "s"), ("a", "p", 0, 9, 0, 0, ""), ("a", "q", 0, 0, 0, 0, ""), ("a", "x", 7, 0, 0, 0, ""), ("a", "y", 7, 0, 0, 0, "")]
    source = spark.createDataFrame(rows, shape)
    merged = M.merge_forums(source.limit(0), source, ["member_num"])
    assert got(merged, "forum_name", "forum_id", "member_num", "slogan") == [("p", -1, 9, "s"), ("q", -2, 0, ""), ("x", 7, 0, ""), ("y", -3, 0, "")]
    again = M.merge_forums(merged, spark.createDataFrame([("a", "r", 0, 0, 0, 0, ""), ("a", "p", 7, 0, 0, 0, "")], shape))
    assert got(again, "forum_name", "forum_id") == [("p", -1), ("q", -2), ("r", -4), ("x", 7), ("y", -3)]


def test_folders(spark):
    names = spark.createDataFrame([("[a吧][12]x",), ("[吧][13]y",), ("[a吧][14]t]u",), ("foo",), ("_logs",)], "name string")
    parsed, rejected = S.parse_folder_names(names)
    assert got(parsed, "forum", "tid", "title") == [("", 13, "y"), ("a", 12, "x"), ("a", 14, "t]u")]
    assert got(rejected, "name") == [("foo",)]


def test_coverage(spark):
    listing = spark.createDataFrame([("a", 1, 10, 0), ("a", 2, 100, 1), ("a", 3, 101, 2), ("a", 4, 0, 3), ("a", 5, 0, 4), ("a", 7, 0, 5)], "archive string, tid long, create_time long, pos long")
    kept = spark.createDataFrame([("a", 4, 0), ("a", 6, 5), ("a", 7, 200)], "archive string, tid long, create_time long")
    flags = A.coverage(listing, kept, 100)
    assert got(flags, "tid", "missing", "after_cutoff", "gone", "undated") == [(1, True, False, False, False), (2, True, False, False, False), (3, False, True, False, False), (4, False, False, False, True), (5, True, False, False, True), (6, False, False, True, False), (7, False, True, False, False)]


def test_media(spark):
    members = spark.createDataFrame([("a", "data.tar", "1/x", 0, 5), ("a", "media.tar", "1/x", 9, 5), ("a", "data.tar", "1/y", 7, 5), ("a", "data.tar", "1/z", 8, 5)], "archive string, tar string, name string, offset long, size long")
    files = D.files_map(members)
    assert got(files, "path", "tar", "offset") == [("1/x", "media.tar", 9), ("1/y", "data.tar", 7), ("1/z", "data.tar", 8)]
    old = spark.createDataFrame([("a", "1/y", None, 6), ("a", "1/z", "media.tar", 8), ("a", "1/w", None, 1)], "archive string, path string, tar string, offset long")
    assert got(D.diff_index(old, files, "data.tar"), "missing_now", "added_now", "stale_offset", "other_tar") == [(1, 1, 1, 1)]
    sizes = [10, 10, 20, 20]
    again = spark.createDataFrame([("a", f"1/p_1_1_{i:016d}.jpg", "t", i, s, i) for i, s in enumerate(sizes)], "archive string, path string, tar string, offset long, size long, seq long")
    assert got(D.dedupe_assets(again), "seq", "is_reused", "stored_offset") == [(0, False, 0), (1, True, 0), (2, False, 2), (3, False, 3)]


def test_fragments(spark):
    rows = [("[]",), ("plain",), ('{"type":1,"text":"lone"}',), ('[{"type":1,"text":"a"},{"type":4,"text":"@b","user_id":3},{"type":-1,"error_frag_type":9}]',), (None,), ("[not json",)]
    df = spark.createDataFrame(rows, "c string").select("c", C.parse_frags(F.col("c")).alias("f"))
    shown = [(r[0], r[1]) for r in df.where("c is not null").select(F.size("f"), C.frag_text(F.col("f"))).collect()]
    assert shown == [(0, ""), (1, "plain"), (1, '{"type":1,"text":"lone"}'), (3, "a @b"), (1, "[not json")]
    assert df.where("c is null").first().f is None
    assert df.where(C.has_scrape_error(F.col("f"))).count() == 1


def test_links(spark):
    urls = ["http://go.example/c?url=http%3A%2F%2Fa.b%2F%3Fx%3D1", "http://go.example/c?url=", "http://other.example/c?url=z", "http://GO.example/c?url=q"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(C.unwrap_redirect(F.col("u"), "go.example", "/c", "url").alias("t"))
    assert [r.t for r in df.collect()] == ["http://a.b/?x=1", None, urls[2], "q"]


@pytest.mark.parametrize("mode,ids", [(1, [1, 2, 3, 10, 11, 12, 13]), (2, [1, 10, 11]), (3, [1, 10]), (4, [1, 2, 10, 11, 12, 13]), (5, [1, 2, 10, 12])])
def test_selection_modes(spark, mode, ids):
    rows = [(1, 1, 1, 0, 5, "x", True), (1, 2, 2, 0, 6), (1, 3, 3, 0, 7, "x", False, 1), (1, 10, 1, 1, 5, "x", True), (1, 11, 1, 1, 6), (1, 12, 2, 2, 5, "x", True), (1, 13, 2, 2, 6)]
    late = [(1, 14, 3, 3, 5, "x", True, 2)] if mode in (4, 5) else []
    assert sorted(i for (i,) in got(S.filter_posts(posts(spark, rows + late), mode), "id")) == ids


def test_users(spark):
    rows = spark.createDataFrame([("a", 1, 1, 0, 0, 0, "[]"), ("a", 1, 2, 0, 5, 0, '[{"type":4,"text":"@nick","user_id":8}]'), ("a", 1, 3, 2, 6, 9, "[]")], "archive string, tid long, id long, parent_id long, user_id long, reply_to_id long, contents string")
    assert got(U.collect_users(rows), "user_id", "nickname", "priority") == [(5, None, 1), (6, None, 2), (8, "nick", 3), (9, None, 4)]
    users = spark.createDataFrame([("a", 1, "p", 5, "old", "n", False), ("a", 1, "q", 6, "old", "n", False), ("a", 1, "r", 7, "old", "n", False), ("a", 1, "s", 8, "old", "n", True)], "archive string, tid long, portrait string, user_id long, username string, nickname string, completed boolean").withColumns({"site_uid": F.lit(3).cast("long"), "status": F.lit(0), "scrape_time": F.lit(0).cast("long")})
    profiles = spark.createDataFrame([(5, "-", "", "second", "third", 0), (6, "", "first", "", "", 4), (8, "new", "new", "", "", 9)], "user_id long, user_name string, nick_name_new string, nick_name_old string, nick_name string, site_uid long")
    out = U.complete_users(users, profiles, 99)
    assert got(out, "user_id", "username", "nickname", "site_uid", "status", "completed", "scrape_time") == [(5, "old", "second", None, 0, True, 99), (6, None, "first", 4, 0, True, 99), (7, "old", "n", 3, 1, True, 99), (8, "old", "n", 3, 0, True, 0)]


def test_missing_pages(spark):
    pages = spark.createDataFrame([("a", 1, 1, 4, 30), ("a", 1, 2, 4, 0), ("a", 1, 4, 4, 0)], "archive string, tid long, page long, total long, posts long")
    assert got(P.missing_pages(pages), "page") == [(2,), (3,)]


def test_search(spark, tmp_path):
    texts = ["The Café opens", "cafe terrace by the sea", "中文测试 text", '[{"type":3,"filename":"x.jpg"}]', "sea view terrace", "by the by the by"]
    p = spark.createDataFrame([("a", i, i, 1, t) for i, t in enumerate(texts)], "archive string, tid long, id long, floor long, contents string")
    t = p.select("archive", "tid", F.lit("t").alias("title"))
    index = {mode: X.store_index(p, f"{tmp_path}/{mode}", mode) for mode in ("text", "raw")}
    hits = lambda q, mode="text": [r.post_id for r in X.search(index[mode], t, q).collect()]
    assert sorted(hits("cafe")) == [0, 1] and sorted(hits("terr*")) == [1, 4] and hits('"sea view"') == [4] and hits("sea NOT cafe") == [4]
    assert sorted(hits("opens OR view")) == [0, 4] and hits("中文测试") == [2] and hits("中文") == []
    assert sorted(hits('"by the"')) == [1, 5] and hits('"by the by"') == [5] and hits('"by the" AND opens') == [] and hits('"the b"*') == [5]
    assert hits("filename") == [] and hits("filename", "raw") == [3]
    assert X.search(index["text"], t, "sea").first().snippet.count("<mark>sea</mark>") == 1
    for bad in ("   ", "NOT sea", "(sea)"):
        with pytest.raises(ValueError):
            X.search(index["text"], t, bad)


def test_search_reads_the_index_only(spark, tmp_path):
    """No tokenizer runs at query time, and the scan of the postings gets the query's tokens."""
    p = spark.createDataFrame([("a", 1, 1, 1, "by the sea")], "archive string, tid long, id long, floor long, contents string")
    index = X.store_index(p, str(tmp_path / "i"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    shown = plan(X.search(index, p.select("archive", "tid", F.lit("t").alias("title")), '"the sea" OR b*'))
    found = plan(index.postings.where(X.Phrase(("the",)).fits(F.col("token"), 0) | X.Phrase(("b",), True).fits(F.col("token"), 0)))
    assert "regexp_extract_all" not in shown + found and "translate" not in shown
    assert "EqualTo(token,the)" in found and "StringStartsWith(token,b)" in found


def test_content_dbs_and_tars(spark, tmp_path):
    for tid in (1, 2):
        with sqlite3.connect(tmp_path / f"{tid}.db") as db:
            db.execute("create table post (id integer, contents text, floor integer, user_id integer, create_time integer, is_thread_author integer)")
            db.execute("insert into post values (?, 'c', 1, 5, 9, 1)", [tid * 10])
    paths = spark.createDataFrame([("a", t, str(tmp_path / f"{t}.db")) for t in (1, 2)], "archive string, tid long, path string")
    assert got(IO.read_content_dbs(spark, paths, "post"), "tid", "id", "is_thread_author", "scrape_batch_id") == [(1, 10, True, 0), (2, 20, True, 0)]
    assert IO.read_content_dbs(spark, paths, "user").isEmpty()
    (tmp_path / "f.txt").write_text("hello")
    with tarfile.open(tmp_path / "m.tar", "w") as tar:
        tar.add(tmp_path / "f.txt", "1/f.txt")
    members = read_tar_members(spark, spark.createDataFrame([("a", str(tmp_path / "m.tar"))], "archive string, path string"))
    (name, offset, size), = got(members, "name", "offset", "size")
    assert (name, (tmp_path / "m.tar").read_bytes()[offset : offset + size]) == ("1/f.txt", b"hello")


def test_stream_merge_equals_batch(spark, tmp_path):
    one, two = posts(spark, [(1, 11, 1, 0), (1, 12, 2, 0), (1, 0, 9, 0)]), posts(spark, [(1, 12, 7, 0), (2, 13, 1, 0)])
    for part in (one, two, two):
        IO.conform(part, "post").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streams.stream_merge(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    merged = streams.read_merged(spark, str(tmp_path / "out"))
    assert got(merged, "tid", "id", "floor") == got(M.merge_posts(M.merge_posts(one.limit(0), one), two), "tid", "id", "floor")


def test_streaming_forms(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (1, "2024-01-01 00:01:00"), (1, "2024-01-01 01:00:00"), (1, "2024-01-01 02:00:00")], "tid long, t string").select("tid", F.to_timestamp("t").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    for i, df in enumerate((streams.stream_dedupe(stream, ["tid", "ts"], "ts", "1 hour"), streams.goodput(stream), streams.activity_sessions(stream))):
        df.writeStream.format("memory").queryName(f"out{i}").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"c{i}")).start().awaitTermination()
    assert spark.table("out0").count() == 4
    assert sorted(r.finished for r in spark.table("out1").collect())[-1] == 3
    assert got(spark.table("out2"), "events")[-1] == (3,)


def test_consolidate_tables(spark, tmp_path):
    for side, rows in (("source", [(1, 11, 1, 0), (2, 21, 1, 0)]), ("target", [(1, 11, 5, 0)])):
        IO.write_archive(posts(spark, rows), str(tmp_path / side / "post"), "post")
        t = threads(spark, [(1, "one", 1, 0)] + ([(2, "two", 1, 0)] if side == "source" else []))
        IO.write_archive(t.withColumn("forum_name", F.lit("f")).withColumn("forum_id", F.lit(1)), str(tmp_path / side / "thread"), "thread")
        IO.write_archive(spark.createDataFrame([("a", 1, "p", "n")], "archive string, tid long, portrait string, nickname string"), str(tmp_path / side / "user"), "user")
    source = str(tmp_path / "source")
    IO.write_archive(spark.createDataFrame([("a", 5, "f", 9)], "archive string, forum_id long, forum_name string, post_num long"), f"{source}/forum", "forum")
    IO.write_archive(spark.createDataFrame([("a", 1, 1, "v", "{}", 7)], "archive string, id long, tid long, scraper_version string, scrape_config string, scrape_time long"), f"{source}/scrape_batch", "scrape_batch")
    IO.write_archive(spark.createDataFrame([("a", 4, 1, "x.jpg", 3, "src")], "archive string, id long, tid long, filename string, content_frag_type int, origin_src string"), f"{source}/media_source", "media_source")
    IO.write_archive(spark.createDataFrame([("a", 1, "p", "level", "3", 7)], "archive string, tid long, portrait string, field_name string, field_value string, scrape_time long"), f"{source}/user_info_history", "user_info_history")
    spark.createDataFrame([("a", 9, "lost", 5, 2, 100, 0)], "archive string, tid long, title string, author_id long, reply_num long, create_time long, pos long").write.parquet(f"{source}/listing")
    spark.createDataFrame([("a", 9, "deleted")], "archive string, tid long, state string").write.parquet(f"{source}/progress")
    for n in range(2):  # a second run changes nothing
        written = jobs.consolidate_tables(spark, source, str(tmp_path / "target"), str(tmp_path / f"staging{n}"))
        assert {"thread", "post", "user", "forum", "media_source", "scrape_batch", "user_info_history", "search_index", "summary", "merge_progress"} == set(written)
        table = lambda name: spark.read.parquet(str(tmp_path / "target" / name))
        assert got(table("forum"), "forum_id", "post_num") == [(5, 9)] and table("media_source").count() == table("scrape_batch").count() == table("user_info_history").count() == 1
        assert got(table("merge_progress"), "tid", "forum_name") == [(1, "f"), (2, "f")] and got(table("summary"), "threads", "deleted", "posts") == [(3, 1, 2)] and table("search_index").count() == 2
        assert got(IO.read_table(spark, str(tmp_path / "target/post"), "post"), "tid", "id", "floor") == [(1, 11, 5), (2, 21, 1)]
        assert got(IO.read_table(spark, str(tmp_path / "target/thread"), "thread"), "tid", "title", "forum_name") == [(1, "one", "f"), (2, "two", "f"), (9, "lost", "f")]


def test_first_scraped_row_wins(spark):
    """Of repeated rows the one of the first batch wins, whatever else is smaller."""
    rows = [(1, 11, 1, 0, 5, "x", False, 7), (1, 11, 9, 0, 5, "z", False, 3)]
    none = posts(spark, []).limit(0)
    source = {"folders": threads(spark, []).select("archive", "tid", F.lit("f").alias("forum"), "title"), "thread": threads(spark, []), "post": posts(spark, rows), "user": spark.createDataFrame([], "archive string, tid long, portrait string, nickname string, scrape_time long")}
    out = jobs.consolidate(source, {"thread": threads(spark, []), "post": none, "user": source["user"]})
    assert got(out["post"], "floor", "scrape_batch_id") == [(9, 3)]


def test_users_are_found_by_portrait_too(spark):
    users = spark.createDataFrame([("a", 1, "5", None, "five", "", "f.jpg"), ("a", 1, "p6", 6, "six", "", ""), ("a", 1, "6", 0, "not six", "", ""), ("a", 1, "0", 0, "zero", "", "")], "archive string, tid long, portrait string, user_id long, nickname string, username string, avatar string")
    rows = posts(spark, [(1, i, i, 0, i) for i in (5, 6, 7)] + [(1, 8, 8, 0, 0)])
    assert got(U.attach_users(rows, users), "user_id", "display_name") == [(0, "匿名"), (5, "five"), (6, "six"), (7, "匿名")]


def test_numbered_spans_ranges(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2900, "a").otherwise("b").alias("g"), (F.col("id") * 7919 % 3001).alias("x"))
    got_ = P.numbered(rows, "g", ["x"], "pos").collect()
    for g in "ab":
        assert [r.pos for r in sorted((r for r in got_ if r.g == g), key=lambda r: r.x)] == list(range(2900 if g == "a" else 100))


def test_smoothed_goodput_is_the_fold(spark, monkeypatch):
    """Blocks give what folding window by window gives, with gaps, a group and another weight."""
    import random

    monkeypatch.setattr(streams, "BLOCK", 7)
    rng = random.Random(1)
    rows = [(g, 1_700_000_000 + rng.randrange(90 * 300)) for g in "ab" for _ in range(400)]
    events = spark.createDataFrame(rows, "g string, t long").select("g", F.timestamp_seconds("t").alias("ts"))
    for alpha in (0.5, 0.1):
        rows = streams.smoothed_goodput(events, alpha=alpha, group="g").collect()
        for g in "ab":
            was = None
            for r in sorted((r for r in rows if r.g == g), key=lambda r: r.start):
                now = r.per_hour if was is None else alpha * r.per_hour + (1 - alpha) * was
                assert abs(r.ewma - now) < 1e-9 * now and (r.change is None if was is None else abs(r.change - (now - was) / was) < 1e-9)
                was = now


def test_plans(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    p = posts(spark, run(1, 1, 3))
    for text in (plan(A.thread_stats(p)), plan(M.merge_posts(p, p)), plan(A.audit(threads(spark, [(1, "t", 3, 0)]), p))):
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "Python" not in text
