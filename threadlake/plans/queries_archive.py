"""Queries of merges, users, audits, planning, selection, media indexes and streams."""

from __future__ import annotations

import contextlib
import os
from functools import partial

from pyspark.sql import functions as F

from threadlake.operators import audit as A
from threadlake.operators import media as D
from threadlake.operators import merge as M
from threadlake.operators import planning as P
from threadlake.operators import select as S
from threadlake.operators import users as U
from threadlake.operators.digests import diff_index_by_digest
from threadlake.plans import jobs
from threadlake.plans.bindings import view, with_views
from threadlake.sources import io as IO
from threadlake.sources.places import scratch, stored
from threadlake.sources.runs import Store
from threadlake.sources.tars import read_tar_members
from threadlake.streaming import streams

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None, *views: str):
    """Registers fn(get, ...) as a query; get(view) binds a view."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(partial(view, spark, sf_dir))
        if sql is not None:
            SQL[name] = with_views(sql, *views)
        return fn

    return add


POST = "archive, id, tid, contents, floor, user_id, agree, disagree, create_time, is_thread_author, reply_num, parent_id, reply_to_id, scrape_batch_id"
#: The order of scraping, then a total one.
_SCRAPED = "scrape_batch_id, agree, contents, create_time, disagree, floor, is_thread_author, parent_id, reply_num, reply_to_id, user_id"
_REST = "agree, contents, create_time, disagree, floor, is_thread_author, parent_id, reply_num, reply_to_id, scrape_batch_id, user_id"


def _first(source: str, keys: str, order: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS n FROM {source}) WHERE n = 1)"


# --- merges ---------------------------------------------------------------

_MERGED = f"""SELECT {POST} FROM post WHERE user_id % 2 = 0 UNION ALL
SELECT {POST} FROM {_first("raw_post", "archive, tid, id", _REST)} s WHERE {{extra}} NOT EXISTS (SELECT 1 FROM post t WHERE t.user_id % 2 = 0 AND t.archive = s.archive AND t.tid = s.tid AND t.id = s.id)"""


@query("m1_merge_ignore", _MERGED.format(extra=""), "post")
def _(get):
    return M.merge_ignore(get("post").where("user_id % 2 = 0"), get("raw_post"), ["archive", "tid", "id"])


@query("m2_merge_posts", _MERGED.format(extra="s.id > 0 AND"), "post")
def _(get):
    return M.merge_posts(get("post").where("user_id % 2 = 0"), get("raw_post"))


@query(
    "m3_merge_users",
    """t AS (SELECT archive, tid, portrait, user_id, username, nickname FROM member WHERE user_id % 3 = 0 AND nickname <> '')
SELECT * FROM t UNION ALL
SELECT archive, tid, portrait, user_id, username, nickname FROM (SELECT *, row_number() OVER (PARTITION BY archive, tid, portrait ORDER BY nickname, user_id, username) AS n FROM member WHERE nickname <> '') s
WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM t WHERE t.archive = s.archive AND t.tid = s.tid AND t.portrait = s.portrait)""",
    "member",
)
def _(get):
    users = get("member").select("archive", "tid", "portrait", "user_id", "username", F.nullif("nickname", F.lit("")).alias("nickname"))
    return M.merge_users(users.where("user_id % 3 = 0").dropna(subset=["nickname"]), users)


@query(
    "m4_merge_media_sources",
    """s AS (SELECT archive, tid, id, contents AS filename, 3 AS content_frag_type, contents AS origin_src FROM raw_post WHERE reply_num > 0),
t AS (SELECT archive, tid, id, contents AS filename, 3 AS content_frag_type, contents AS origin_src FROM post WHERE floor = 2)
SELECT * FROM t UNION ALL SELECT archive, tid, id, min(filename), 3, min(origin_src) FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.archive = s.archive AND t.tid = s.tid AND t.id = s.id) GROUP BY archive, tid, id""",
    "post",
)
def _(get):
    shape = lambda df: df.select("archive", "tid", "id", F.col("contents").alias("filename"), F.lit(3).alias("content_frag_type"), F.col("contents").alias("origin_src"))
    return M.merge_media_sources(shape(get("post").where("floor = 2")), shape(get("raw_post").where("reply_num > 0")))


@query(
    "m4_merge_batches",
    """s AS (SELECT archive, tid, scrape_batch_id AS id, '1.3' AS scraper_version, '{}' AS scrape_config, create_time AS scrape_time FROM raw_post)
SELECT archive, tid, id, min(scraper_version) AS scraper_version, min(scrape_config) AS scrape_config, min(scrape_time) AS scrape_time FROM s GROUP BY archive, tid, id""",
    "raw_post",
)
def _(get):
    source = get("raw_post").select("archive", "tid", F.col("scrape_batch_id").alias("id"), F.lit("1.3").alias("scraper_version"), F.lit("{}").alias("scrape_config"), F.col("create_time").alias("scrape_time"))
    return M.merge_batches(source.limit(0), source, ["scrape_time"])


@query("m5_user_history", "SELECT DISTINCT archive, tid, portrait, 'nickname' AS field_name, nickname AS field_value, tid AS scrape_time FROM member", "member")
def _(get):
    rows = get("member").select("archive", "tid", "portrait", F.lit("nickname").alias("field_name"), F.col("nickname").alias("field_value"), F.col("tid").alias("scrape_time"))
    return M.append_user_history(rows.where("tid % 2 = 0"), rows)


@query(
    "m6_merge_threads",
    """t AS (SELECT archive, tid, title, forum_id, forum_name, reply_num, scrape_status FROM thread WHERE tid % 10 = 0),
f AS (SELECT archive, tid, concat('folder ', CAST(tid AS VARCHAR(19))) AS title, 'forumX' AS forum FROM thread)
SELECT * FROM t UNION ALL
SELECT f.archive, f.tid, coalesce(nullif(d.title, ''), f.title), coalesce(d.forum_id, 0), coalesce(nullif(d.forum_name, ''), f.forum), d.reply_num, 0
FROM f LEFT JOIN (SELECT * FROM thread WHERE tid % 4 <> 0) d USING (archive, tid) WHERE f.tid % 10 <> 0""",
    "thread",
)
def _(get):
    threads = get("thread")
    target = threads.where("tid % 10 = 0").select("archive", "tid", "title", "forum_id", "forum_name", "reply_num", "scrape_status")
    folders = threads.select("archive", "tid", F.concat(F.lit("folder "), F.col("tid").cast("string")).alias("title"), F.lit("forumX").alias("forum"))
    return M.merge_threads(folders, threads.where("tid % 4 <> 0").select("archive", "tid", "title", "forum_id", "forum_name", "reply_num"), target)


@query(
    "m7_merge_forums",
    """src AS (SELECT archive, forum_name, forum_id, member_num, post_num, thread_num, slogan FROM forum UNION ALL SELECT archive, forum_name, forum_id, member_num + 1, post_num, thread_num, '' FROM forum),
g AS (SELECT archive, forum_name, max(member_num) AS member_num, max(post_num) AS post_num, max(thread_num) AS thread_num, max(slogan) AS slogan, min(CASE WHEN forum_id > 0 THEN forum_id END) AS real FROM src GROUP BY archive, forum_name),
o AS (SELECT *, real IS NOT NULL AND row_number() OVER (PARTITION BY archive, real ORDER BY forum_name) = 1 AS owns FROM g)
SELECT archive, CASE WHEN owns THEN real ELSE -row_number() OVER (PARTITION BY archive, owns ORDER BY forum_name) END AS forum_id, forum_name, member_num, post_num, thread_num, slogan FROM o""",
    "forum",
)
def _(get):
    forums = get("forum").select("archive", "forum_name", "forum_id", "member_num", "post_num", "thread_num", "slogan")
    again = forums.withColumn("member_num", F.col("member_num") + 1).withColumn("slogan", F.lit(""))
    return M.merge_forums(forums.limit(0), forums.unionByName(again), ["member_num"])


@query(
    "m8_stub_threads",
    """m AS (SELECT archive, tid FROM thread WHERE tid % 3 = 0)
SELECT p.archive, p.tid, coalesce(nullif(l.title, ''), concat('[tid=', CAST(p.tid AS VARCHAR(19)), ']')) AS title, 'board' AS forum_name, coalesce(l.author_id, 0) AS author_user_id, coalesce(l.reply_num, 0) AS reply_num, coalesce(l.create_time, 0) AS create_time, CASE state WHEN 'deleted' THEN 1 ELSE 2 END AS scrape_status
FROM progress p LEFT JOIN listing l ON l.archive = p.archive AND l.tid = p.tid WHERE state <> 'done' AND NOT EXISTS (SELECT 1 FROM m WHERE m.archive = p.archive AND m.tid = p.tid)""",
    "thread", "listing", "progress",
)
def _(get):
    return M.stub_threads(get("listing"), get("progress"), get("thread").where("tid % 3 = 0"), "board")


@query(
    "m8_stub_threads_own_forum",
    """m AS (SELECT archive, tid, forum_name FROM thread WHERE tid % 3 = 0),
f AS (SELECT archive, forum_name FROM (SELECT archive, forum_name, row_number() OVER (PARTITION BY archive ORDER BY count(*) DESC, forum_name) AS n FROM m WHERE forum_name <> '' GROUP BY archive, forum_name) WHERE n = 1)
SELECT p.archive, p.tid, coalesce(f.forum_name, '') AS forum_name, CASE state WHEN 'deleted' THEN 1 ELSE 2 END AS scrape_status
FROM progress p LEFT JOIN f ON f.archive = p.archive WHERE state <> 'done' AND NOT EXISTS (SELECT 1 FROM m WHERE m.archive = p.archive AND m.tid = p.tid)""",
    "thread", "listing", "progress",
)
def _(get):
    return M.stub_threads(get("listing"), get("progress"), get("thread").where("tid % 3 = 0")).select("archive", "tid", "forum_name", "scrape_status")


@query(
    "m9_refresh_posts",
    f"""t AS (SELECT {POST} FROM post WHERE id > 0 AND user_id % 2 = 0),
s AS (SELECT archive, id, tid, contents || ' later' AS contents, floor, user_id, agree + 1 AS agree, disagree, create_time, is_thread_author, reply_num + 2 AS reply_num, parent_id, reply_to_id, scrape_batch_id FROM post WHERE id > 0 AND user_id % 3 = 0)
SELECT t.archive, t.id, t.tid, t.contents, t.floor, t.user_id, coalesce(s.agree, t.agree) AS agree, coalesce(s.disagree, t.disagree) AS disagree, t.create_time, t.is_thread_author,
  CASE WHEN s.id IS NULL THEN t.reply_num WHEN t.parent_id <> 0 THEN 0 ELSE s.reply_num END AS reply_num, t.parent_id, t.reply_to_id, t.scrape_batch_id
FROM t LEFT JOIN s USING (archive, tid, id)
UNION ALL SELECT archive, id, tid, contents, floor, user_id, agree, disagree, create_time, is_thread_author, CASE WHEN parent_id <> 0 THEN 0 ELSE reply_num END, parent_id, reply_to_id, scrape_batch_id
FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.archive = s.archive AND t.tid = s.tid AND t.id = s.id)""",
    "post",
)
def _(get):
    posts = get("post").where("id > 0")
    later = posts.where("user_id % 3 = 0").withColumns({"contents": F.concat("contents", F.lit(" later")), "agree": F.col("agree") + 1, "reply_num": F.col("reply_num") + 2})
    return M.refresh_posts(posts.where("user_id % 2 = 0"), later)


@query(
    "m9_refresh_posts_newest",
    f"""t AS (SELECT {POST} FROM post WHERE id > 0 AND user_id % 2 = 0),
c AS (SELECT archive, tid, id, max({{'b': scrape_batch_id, 'a': agree, 'd': disagree, 'r': reply_num}}) AS m FROM raw_post WHERE id > 0 GROUP BY archive, tid, id),
w AS (SELECT * FROM t UNION ALL SELECT {POST} FROM {_first("raw_post", "archive, tid, id", _SCRAPED)} s WHERE id > 0 AND NOT EXISTS (SELECT 1 FROM t WHERE t.archive = s.archive AND t.tid = s.tid AND t.id = s.id))
SELECT archive, id, tid, contents, floor, user_id, coalesce(m.a, agree) AS agree, coalesce(m.d, disagree) AS disagree, create_time, is_thread_author,
  CASE WHEN m IS NULL THEN reply_num WHEN parent_id <> 0 THEN 0 ELSE m.r END AS reply_num, parent_id, reply_to_id, scrape_batch_id FROM w LEFT JOIN c USING (archive, tid, id)""",
    "post", "raw_post",
)
def _(get):
    return M.refresh_posts(get("post").where("id > 0 and user_id % 2 = 0"), get("raw_post"))


@query(
    "m10_pending_threads",
    """SELECT archive, tid FROM thread t WHERE NOT EXISTS (SELECT 1 FROM thread m WHERE m.tid % 3 = 0 AND m.archive = t.archive AND m.tid = t.tid)
OR NOT EXISTS (SELECT 1 FROM media WHERE media.archive = t.archive AND TRY_CAST(split_part(path, '/', 1) AS BIGINT) = t.tid)""",
    "thread", "media",
)
def _(get):
    return M.pending_threads(get("thread"), get("thread").where("tid % 3 = 0"), get("media"))


@query(
    "m12_archive_summary",
    """SELECT t.*, posts, users FROM (SELECT archive, count(*) AS threads, count(*) FILTER (scrape_status = 0) AS complete, count(*) FILTER (scrape_status = 1) AS deleted, count(*) FILTER (scrape_status = 2) AS failed FROM thread GROUP BY archive) t
JOIN (SELECT archive, count(*) AS posts FROM post GROUP BY archive) USING (archive) JOIN (SELECT archive, count(*) AS users FROM member GROUP BY archive) USING (archive)""",
    "thread", "post", "member",
)
def _(get):
    return M.archive_summary(get("thread"), get("post"), get("member"))


@query(
    "m11_consolidate",
    f"""t AS (SELECT archive, tid, scrape_status FROM thread WHERE tid % 2 = 1 UNION ALL SELECT archive, tid, 0 FROM thread WHERE tid % 2 = 0 AND tid % 3 = 0),
st AS (SELECT p.archive, p.tid, CASE state WHEN 'deleted' THEN 1 ELSE 2 END AS scrape_status FROM progress p WHERE state <> 'done' AND NOT EXISTS (SELECT 1 FROM t WHERE t.archive = p.archive AND t.tid = p.tid)),
al AS (SELECT * FROM t UNION ALL SELECT * FROM st),
po AS (SELECT archive FROM post WHERE user_id % 2 = 0 UNION ALL SELECT archive FROM post s WHERE s.id > 0 AND user_id % 2 <> 0)
SELECT archive, count(*) AS threads, count(*) FILTER (scrape_status = 0) AS complete, count(*) FILTER (scrape_status = 1) AS deleted, count(*) FILTER (scrape_status = 2) AS failed,
 (SELECT count(*) FROM po WHERE po.archive = al.archive) AS posts, (SELECT count(DISTINCT (tid, portrait)) FROM member m WHERE m.archive = al.archive) AS users FROM al GROUP BY archive""",
    "thread", "post", "member", "listing", "progress",
)
def _(get):
    return _consolidated(get)["summary"]


def _consolidated(get):
    threads, columns = get("thread"), ["archive", "tid", "title", "forum_id", "forum_name", "reply_num", "scrape_status"]
    source = {"folders": threads.where("tid % 3 = 0").select("archive", "tid", F.col("forum_name").alias("forum"), "title"), "thread": threads.where("tid % 3 = 0").select(*columns[:-1]), "post": get("raw_post"), "user": get("member"), "listing": get("listing"), "progress": get("progress")}
    target = {"thread": threads.where("tid % 2 = 1").select(*columns), "post": get("post").where("user_id % 2 = 0"), "user": get("member").limit(0)}
    return jobs.consolidate(source, target)


@query("m11_consolidated_posts", _MERGED.format(extra="s.id > 0 AND").replace(_REST, "scrape_batch_id, " + _REST), "post", "raw_post")
def _(get):
    return _consolidated(get)["post"].select(*POST.split(", "))


@query(
    "m11_consolidated_threads",
    """t AS (SELECT archive, tid, title, forum_name, reply_num, scrape_status FROM thread WHERE tid % 2 = 1 UNION ALL SELECT archive, tid, title, forum_name, reply_num, 0 FROM thread WHERE tid % 2 = 0 AND tid % 3 = 0),
f AS (SELECT archive, forum_name FROM (SELECT archive, forum_name, row_number() OVER (PARTITION BY archive ORDER BY count(*) DESC, forum_name) AS n FROM t WHERE forum_name <> '' GROUP BY archive, forum_name) WHERE n = 1)
SELECT * FROM t UNION ALL
SELECT p.archive, p.tid, coalesce(nullif(l.title, ''), concat('[tid=', CAST(p.tid AS VARCHAR(19)), ']')), coalesce(f.forum_name, ''), coalesce(l.reply_num, 0), CASE state WHEN 'deleted' THEN 1 ELSE 2 END
FROM progress p LEFT JOIN listing l ON l.archive = p.archive AND l.tid = p.tid LEFT JOIN f ON f.archive = p.archive WHERE state <> 'done' AND NOT EXISTS (SELECT 1 FROM t WHERE t.archive = p.archive AND t.tid = p.tid)""",
    "thread", "listing", "progress",
)
def _(get):
    return _consolidated(get)["thread"].select("archive", "tid", "title", "forum_name", "reply_num", "scrape_status")


def _runs(get):
    """A store after two runs: threads of every third id with half of their posts, then all threads with all posts, and stubs."""
    threads, posts, place = get("thread"), get("raw_post"), scratch(get("thread").sparkSession)
    spark = threads.sparkSession
    store = Store(spark, f"{place}/store", 16)
    for n, part in enumerate(("tid % 3 = 0", "tid % 2 = 0")):
        for name, df in (("thread", threads), ("post", posts if n else posts.where("user_id % 2 = 0")), ("user", get("member"))):
            IO.conform(df.where(part), name).write.parquet(f"{place}/source{n}/{name}")
    get("listing").write.parquet(f"{place}/source1/listing")
    get("progress").write.parquet(f"{place}/source1/progress")
    for n in (0, 1):
        jobs.consolidate_run(spark, f"{place}/source{n}", store, resume=False)
    return store


_RUN_POSTS = f"""a AS (SELECT * FROM raw_post WHERE id > 0 AND tid % 3 = 0 AND user_id % 2 = 0), b AS (SELECT * FROM raw_post WHERE id > 0 AND tid % 2 = 0),
fa AS (SELECT {POST} FROM {_first("a", "archive, tid, id", _SCRAPED)}),
po AS (SELECT * FROM fa UNION ALL SELECT {POST} FROM {_first("b", "archive, tid, id", _SCRAPED)} s WHERE NOT EXISTS (SELECT 1 FROM fa WHERE fa.archive = s.archive AND fa.tid = s.tid AND fa.id = s.id))"""
_RUN_THREADS = """th AS (SELECT archive, tid, title, forum_name, 0 AS scrape_status FROM thread WHERE tid % 3 = 0 OR tid % 2 = 0),
fo AS (SELECT archive, forum_name FROM (SELECT archive, forum_name, row_number() OVER (PARTITION BY archive ORDER BY count(*) DESC, forum_name) AS n FROM th WHERE forum_name <> '' GROUP BY archive, forum_name) WHERE n = 1),
al AS (SELECT * FROM th UNION ALL
  SELECT p.archive, p.tid, coalesce(nullif(l.title, ''), concat('[tid=', CAST(p.tid AS VARCHAR(19)), ']')), coalesce(fo.forum_name, ''), CASE state WHEN 'deleted' THEN 1 ELSE 2 END
  FROM progress p LEFT JOIN listing l ON l.archive = p.archive AND l.tid = p.tid LEFT JOIN fo ON fo.archive = p.archive WHERE state <> 'done' AND NOT EXISTS (SELECT 1 FROM th WHERE th.archive = p.archive AND th.tid = p.tid))"""


@query("m11_run_posts", f"{_RUN_POSTS} SELECT {POST} FROM po", "raw_post")
def _(get):
    return _runs(get).read("post").select(*POST.split(", "))


@query("m11_run_threads", f"{_RUN_THREADS} SELECT * FROM al", "thread", "listing", "progress")
def _(get):
    return _runs(get).read("thread").select("archive", "tid", "title", "forum_name", "scrape_status")


@query(
    "m11_run_totals",
    f"""{_RUN_POSTS}, {_RUN_THREADS},
us AS (SELECT archive, count(DISTINCT (tid, portrait)) AS users FROM member WHERE tid % 3 = 0 OR tid % 2 = 0 GROUP BY archive)
SELECT archive, count(*) AS threads, count(*) FILTER (scrape_status = 0) AS complete, count(*) FILTER (scrape_status = 1) AS deleted, count(*) FILTER (scrape_status = 2) AS failed,
 any_value((SELECT count(*) FROM po WHERE po.archive = al.archive)) AS posts, any_value(users) AS users FROM al JOIN us USING (archive) GROUP BY archive""",
    "raw_post", "thread", "listing", "progress", "member",
)
def _(get):
    return jobs.archive_totals(_runs(get))


# --- users ------------------------------------------------------------------


@query(
    "u1_collect_users",
    """a AS (SELECT archive, tid, user_id, CASE WHEN parent_id = 0 THEN 1 ELSE 2 END AS priority FROM post UNION ALL SELECT archive, tid, reply_to_id, 4 FROM post)
SELECT archive, tid, user_id, p.portrait, p.nick_name AS nickname, min(priority) AS priority FROM a LEFT JOIN profile p USING (user_id) WHERE user_id <> 0 GROUP BY ALL""",
    "post", "profile",
)
def _(get):
    return U.collect_users(get("post"), get("profile"))


@query("u2_users_to_complete", "SELECT archive, tid, portrait, user_id FROM member WHERE NOT completed", "member")
def _(get):
    return U.users_to_complete(get("member")).select("archive", "tid", "portrait", "user_id")


@query(
    "u3_complete_users",
    """SELECT m.archive, m.tid, m.portrait, m.user_id,
 CASE WHEN NOT m.completed AND p.user_id IS NOT NULL THEN CASE WHEN p.user_name = '-' THEN m.username ELSE nullif(p.user_name, '') END ELSE m.username END AS username,
 CASE WHEN NOT m.completed AND p.user_id IS NOT NULL THEN coalesce(nullif(p.nick_name_new, ''), nullif(p.nick_name_old, ''), nullif(p.nick_name, ''), '') ELSE m.nickname END AS nickname,
 CASE WHEN NOT m.completed AND p.user_id IS NOT NULL THEN nullif(p.site_uid, 0) ELSE m.site_uid END AS site_uid,
 CASE WHEN NOT m.completed AND p.user_id IS NULL THEN 1 ELSE status END AS status, true AS completed, CASE WHEN m.completed THEN 0 ELSE 1700000000 END AS scrape_time
FROM member m LEFT JOIN profile p ON m.user_id = p.user_id""",
    "member", "profile",
)
def _(get):
    users = get("member").select("archive", "tid", "portrait", "user_id", "username", "nickname", "site_uid", "status", "completed", "scrape_time")
    profiles = get("profile").drop("portrait")
    return U.complete_users(users, profiles, 1_700_000_000)


@query(
    "u4_attach_users",
    """k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY archive, tid, user_id ORDER BY portrait, avatar, nickname, username) AS n FROM member WHERE user_id <> 0) WHERE n = 1)
SELECT p.archive, p.tid, p.id, p.user_id, CASE WHEN p.user_id = 0 THEN '匿名' ELSE coalesce(nullif(k.nickname, ''), nullif(k.username, ''), '匿名') END AS display_name, k.avatar AS user_avatar
FROM post p LEFT JOIN k ON k.archive = p.archive AND k.tid = p.tid AND k.user_id = p.user_id""",
    "post", "member",
)
def _(get):
    return U.attach_users(get("post"), get("member")).select("archive", "tid", "id", "user_id", "display_name", "user_avatar")


# --- selection -----------------------------------------------------------------

_IN = "EXISTS (SELECT 1 FROM f WHERE f.archive = p.archive AND f.tid = p.tid AND f.id = p.parent_id)"
_ANSWERED = "EXISTS (SELECT 1 FROM post s WHERE s.parent_id <> 0 AND s.is_thread_author AND s.archive = p.archive AND s.tid = p.tid AND s.parent_id = p.id AND s.scrape_batch_id = p.scrape_batch_id)"
for _name, _mode, _floor, _sub in (("all", 1, None, None), ("author", 2, "is_thread_author", "true"), ("author_only", 3, "is_thread_author", "is_thread_author"), ("replied", 4, f"(is_thread_author OR {_ANSWERED})", "true"), ("replied_only", 5, f"(is_thread_author OR {_ANSWERED})", "is_thread_author")):
    _sql = f"SELECT {POST} FROM post" if _mode == 1 else f"f AS (SELECT * FROM post p WHERE parent_id = 0 AND {_floor}) SELECT {POST} FROM f UNION ALL SELECT {POST} FROM post p WHERE parent_id <> 0 AND {_sub} AND {_IN}"
    query(f"pf4_filter_posts_{_name}", _sql, "post")(lambda get, mode=_mode: S.filter_posts(get("post"), mode))


@query("pf5_users_with_posts", "SELECT archive, tid, portrait FROM member m WHERE user_id <> 0 AND EXISTS (SELECT 1 FROM post p WHERE p.archive = m.archive AND p.tid = m.tid AND p.user_id = m.user_id)", "member", "post")
def _(get):
    return S.drop_users_without_posts(get("member"), get("post")).select("archive", "tid", "portrait")


@query(
    "pf6_drop_assets",
    """f AS (SELECT DISTINCT archive, CAST(split_part(name, '/', 1) AS BIGINT) AS tid, name AS filename FROM member_file)
SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM post p WHERE p.parent_id <> 0 AND p.archive = f.archive AND p.tid = f.tid AND p.id = CAST(regexp_extract(f.filename, 'p_([0-9]+)_', 1) AS BIGINT))""",
    "member_file", "post",
)
def _(get):
    files = get("member_file").select("archive", F.split_part("name", F.lit("/"), F.lit(1)).cast("bigint").alias("tid"), F.col("name").alias("filename")).distinct()
    return S.drop_assets_of(get("post").where("parent_id <> 0"), files)


@query("pf7_author_only", f"SELECT {POST} FROM post WHERE is_thread_author", "post")
def _(get):
    return S.author_only(get("post"))


# --- audit and coverage -----------------------------------------------------------

_STATS = """s AS (SELECT archive, tid, count(*) FILTER (parent_id = 0) AS floors, count(*) FILTER (parent_id <> 0) AS comments, coalesce(max(floor) FILTER (parent_id = 0), 0) AS max_floor FROM post GROUP BY archive, tid),
g AS (SELECT archive, tid, max(gap) AS gap FROM (SELECT archive, tid, floor - lag(floor) OVER (PARTITION BY archive, tid ORDER BY floor) - 1 AS gap FROM post WHERE parent_id = 0) GROUP BY archive, tid),
st AS (SELECT s.*, coalesce(gap, 0) AS max_gap FROM s LEFT JOIN g USING (archive, tid))"""
_AUDIT = (
    _STATS
    + """,
j AS (SELECT t.archive, t.tid, left(title, 60) AS title, reply_num, scrape_status, coalesce(floors, 0) AS floors, coalesce(comments, 0) AS comments, coalesce(max_floor, 0) AS max_floor, coalesce(max_gap, 0) AS max_gap FROM thread t LEFT JOIN st USING (archive, tid)),
r AS (SELECT *, reply_num - floors - comments AS lacking FROM j),
su AS (SELECT archive, tid, title, reply_num, CASE WHEN scrape_status = 1 THEN 0 ELSE floors END AS floors_saved, CASE WHEN scrape_status = 1 THEN 0 ELSE comments END AS comments_saved, CASE WHEN scrape_status = 0 THEN max_floor ELSE 0 END AS max_floor, CASE WHEN scrape_status = 0 THEN max_gap ELSE 0 END AS max_gap,
 CASE WHEN scrape_status = 1 THEN reply_num ELSE lacking END AS missing,
 CASE scrape_status WHEN 1 THEN 'verify-del' WHEN 2 THEN 'retry-failed' ELSE CASE WHEN floors = 0 AND reply_num > 0 THEN 'empty' WHEN lacking >= 2 AND {lost} THEN 'log-confirmed' WHEN lacking >= 2 AND max_gap >= 2 THEN 'page-gap(' || max_gap || ')' WHEN lacking >= 2 THEN 'short' END END AS reason FROM r)"""
)
_SUSPECTS = "SELECT * FROM su WHERE reason IS NOT NULL"


def _audit(get, **more):
    return A.audit(get("thread"), get("post"), gap=2, **more)


@query("a1_thread_stats", _STATS + " SELECT * FROM st", "post")
def _(get):
    return A.thread_stats(get("post"))


@query("a1_thread_stats_two_step", _STATS + " SELECT * FROM st", "post")
def _(get):
    return A.thread_stats(get("post"), two_step=True)


@query("a2_audit", _AUDIT.format(lost="false") + _SUSPECTS, "thread", "post")
def _(get):
    return _audit(get)


@query("a1_stats_of_ranges", _STATS + " SELECT * FROM st", "post")
def _(get):
    """Ranges of three parts of the posts, merged one after the other."""
    posts = get("post")
    parts = [A.floor_ranges(posts.where(f"(user_id + floor) % 3 = {i}")) for i in range(3)]
    return A.stats_of_ranges(A.merge_ranges(parts[2], A.merge_ranges(parts[0], parts[1])))


@query("a3_audit_summary", _AUDIT.format(lost="false") + " SELECT archive, regexp_replace(reason, '\\(.*', '') AS reason, count(*) AS threads FROM su WHERE reason IS NOT NULL GROUP BY ALL", "thread", "post")
def _(get):
    return A.audit_summary(_audit(get))


@query("a3_audit_top", _AUDIT.format(lost="false") + _SUSPECTS + " ORDER BY missing DESC, archive, tid LIMIT 25", "thread", "post")
def _(get):
    return A.audit_top(_audit(get))


_LOG = "lg AS (SELECT archive, tid, CASE event_type WHEN 'error' THEN 'x - ERROR - FetchPosts - Request failed' ELSE 'x - INFO - FetchPosts - ok' END AS line FROM activity)"


@query("a4_lost_pages", _LOG + ", lo AS (SELECT DISTINCT archive, tid FROM lg WHERE contains(line, 'FetchPosts') AND (contains(line, 'Request failed') OR contains(line, 'Thread unavailable'))), " + _AUDIT.format(lost="EXISTS (SELECT 1 FROM lo WHERE lo.archive = r.archive AND lo.tid = r.tid)") + _SUSPECTS, "thread", "post", "activity")
def _(get):
    lines = get("activity").select("archive", "tid", F.when(F.col("event_type") == "error", "x - ERROR - FetchPosts - Request failed").otherwise("x - INFO - FetchPosts - ok").alias("line"))
    return _audit(get, lost_tids=A.lost_page_tids(lines))


@query("a5_archive_label", "n AS (SELECT archive, list_sort(list(DISTINCT forum_name) FILTER (forum_name <> '')) AS f FROM thread GROUP BY archive) SELECT archive, CASE WHEN len(f) = 1 THEN f[1] ELSE archive END AS label, len(f) > 1 AS is_collection, array_to_string(CASE WHEN len(f) > 1 THEN f END, ',') AS sub_forums FROM n", "thread")
def _(get):
    return A.archive_label(get("thread")).withColumn("sub_forums", F.array_join("sub_forums", ","))


@query("a6_prepare_retry", _AUDIT.format(lost="false") + ", si AS (" + _SUSPECTS + ") SELECT p.archive, p.tid, state FROM progress p WHERE NOT EXISTS (SELECT 1 FROM si WHERE si.archive = p.archive AND si.tid = p.tid) UNION ALL SELECT archive, tid, 'retry' FROM si", "thread", "post", "progress")
def _(get):
    done, progress, retry = A.prepare_retry(get("progress").where("state = 'done'"), get("progress").where("state <> 'done'"), _audit(get))
    return done.unionByName(progress).unionByName(retry.withColumn("state", F.lit("retry")))


_HEAL = _AUDIT.format(lost="false") + f""", si AS ({_SUSPECTS}), fx AS (SELECT * FROM raw_post r WHERE id > 0 AND EXISTS (SELECT 1 FROM si WHERE si.archive = r.archive AND si.tid = r.tid)),
nw AS (SELECT * FROM {_first("fx", "archive, tid, id", _SCRAPED)} s WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.archive = s.archive AND k.tid = s.tid AND k.id = s.id)),
rv AS (SELECT archive, count(*) AS revived FROM thread t WHERE scrape_status <> 0 AND EXISTS (SELECT 1 FROM fx WHERE fx.archive = t.archive AND fx.tid = t.tid) GROUP BY archive)
SELECT archive, count(*) AS added_posts, any_value(revived) AS revived FROM nw JOIN rv USING (archive) GROUP BY archive"""


@query("a7_heal_report", "kept AS (SELECT * FROM post WHERE user_id % 2 = 0), " + _HEAL, "thread", "post")
def _(get):
    return A.heal(get("thread"), get("post").where("user_id % 2 = 0"), get("raw_post"), _audit(get))[2]


@query(
    "a7_healed_posts",
    f"kept AS (SELECT * FROM post WHERE user_id % 2 = 0), {_HEAL.partition('rv AS')[0].rstrip().rstrip(',')} SELECT {POST} FROM kept UNION ALL SELECT {POST} FROM nw",
    "thread", "post",
)
def _(get):
    return A.heal(get("thread"), get("post").where("user_id % 2 = 0"), get("raw_post"), _audit(get))[1].select(*POST.split(", "))


@query("a7_heal_status", _AUDIT.format(lost="false") + f", si AS ({_SUSPECTS}) SELECT archive, tid, CASE WHEN EXISTS (SELECT 1 FROM si WHERE si.archive = t.archive AND si.tid = t.tid) AND EXISTS (SELECT 1 FROM raw_post r WHERE r.id > 0 AND r.archive = t.archive AND r.tid = t.tid) THEN 0 ELSE scrape_status END AS scrape_status FROM thread t", "thread", "post")
def _(get):
    return A.heal(get("thread"), get("post").where("user_id % 2 = 0"), get("raw_post"), _audit(get))[0].select("archive", "tid", "scrape_status")


_CUT = 852076800
_COVER = """b AS (SELECT coalesce(l.archive, a.archive) AS archive, coalesce(l.tid, a.tid) AS tid, coalesce(nullif(l.create_time, 0), nullif(a.create_time, 0)) AS create_time, l.tid IS NOT NULL AS li, a.tid IS NOT NULL AS ar FROM listing l FULL JOIN archived a ON a.archive = l.archive AND a.tid = l.tid),
c AS (SELECT archive, tid, create_time, li AND NOT ar AND (create_time IS NULL OR create_time <= 852076800) AS missing, coalesce(li AND create_time > 852076800, false) AS after_cutoff, ar AND NOT li AS gone, li AND create_time IS NULL AS undated FROM b)"""


@query("c1_coverage", _COVER + " SELECT * FROM c", "listing", "archived")
def _(get):
    return A.coverage(get("listing"), get("archived"), _CUT)


@query("c1_coverage_counts", _COVER + " SELECT archive, count(*) FILTER (missing) AS missing, count(*) FILTER (after_cutoff) AS after_cutoff, count(*) FILTER (gone) AS gone, count(*) FILTER (undated) AS undated FROM c GROUP BY archive", "listing", "archived")
def _(get):
    return A.coverage_counts(A.coverage(get("listing"), get("archived"), _CUT))


@query("c2_infer_cutoff", "n AS (SELECT tid, CASE WHEN tid % 3 = 0 THEN 'plain' ELSE concat('Ba_x_', strftime(to_timestamp(create_time), '%y%m%d')) END AS name, create_time FROM thread) SELECT tid, name, CASE WHEN tid % 3 <> 0 THEN CAST(floor((create_time + CASE WHEN create_time < 946684800 THEN 3155760000 ELSE 0 END) / 86400) AS BIGINT) * 86400 + 86399 END AS cutoff FROM n", "thread")
def _(get):
    named = get("thread").select("tid", F.when(F.col("tid") % 3 == 0, "plain").otherwise(F.concat(F.lit("Ba_x_"), F.date_format(F.timestamp_seconds("create_time"), "yyMMdd"))).alias("name"))
    return named.withColumn("cutoff", A.infer_cutoff(F.col("name")))


# --- planning ------------------------------------------------------------------------


@query("w1_plan_crawl", "SELECT l.archive, l.tid, l.pos, l.pos % 2 = 0 AND EXISTS (SELECT 1 FROM progress p WHERE p.state = 'failed' AND p.archive = l.archive AND p.tid = l.tid) AS is_retry FROM listing l WHERE NOT EXISTS (SELECT 1 FROM progress p WHERE (p.state = 'done' OR p.state = 'deleted' AND p.tid % 2 = 0) AND p.archive = l.archive AND p.tid = l.tid)", "listing", "progress")
def _(get):
    p = get("progress")
    return P.plan_crawl(get("listing"), p.where("state = 'done'"), p.where("state = 'deleted' and tid % 2 = 0"), p.where("state = 'failed' and tid % 2 = 0"))


@query("w2_completed_tids", "SELECT archive, tid, count(*) AS posts FROM post GROUP BY ALL", "post")
def _(get):
    return P.completed_tids(get("post"))


@query(
    "w3_build_listing",
    """p AS (SELECT archive, tid, floor(tid % 50) AS page, id AS pos, create_time FROM raw_post),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY archive, tid ORDER BY page DESC, pos, create_time) AS n FROM p) WHERE n = 1)
SELECT archive, tid, create_time, row_number() OVER (PARTITION BY archive ORDER BY create_time, page DESC, pos, tid) - 1 AS pos FROM f""",
    "raw_post",
)
def _(get):
    return P.build_listing(get("raw_post").select("archive", "tid", (F.col("tid") % 50).alias("page"), F.col("id").alias("pos"), "create_time"))


@query("w4_user_tids", "SELECT archive, tid FROM post WHERE user_id = 7 UNION SELECT archive, tid FROM thread WHERE author_user_id = 7", "post", "thread")
def _(get):
    return P.user_tids(get("post").where("user_id = 7"), get("thread").where("author_user_id = 7"))


@query(
    "w5_missing_pages",
    """p AS (SELECT archive, tid, floor AS page, max(floor) OVER (PARTITION BY archive, tid) AS total, CASE reply_num WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE reply_num END AS posts FROM post),
w AS (SELECT archive, tid, unnest(generate_series(1, max(total))) AS page FROM p GROUP BY archive, tid)
SELECT archive, tid, page FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.archive = w.archive AND p.tid = w.tid AND p.page = w.page AND (posts > 0 OR posts = 0 AND p.page = total))""",
    "post",
)
def _(get):
    from pyspark.sql import Window as W

    pages = get("post").select("archive", "tid", F.col("floor").alias("page"), F.max("floor").over(W.partitionBy("archive", "tid")).alias("total"), F.when(F.col("reply_num") == 0, F.lit(0)).when(F.col("reply_num") != 1, F.col("reply_num")).alias("posts"))
    return P.missing_pages(pages)


# --- media ---------------------------------------------------------------------------

_FILES = "fm AS (SELECT archive, name AS path, max({'tar': tar, 'offset': \"offset\", 'size': size}) AS m, count(*) AS copies FROM member_file GROUP BY archive, name), fi AS (SELECT archive, path, m.tar AS tar, m.\"offset\" AS \"offset\", m.size AS size, copies FROM fm)"


@query("d1_files_map", _FILES + " SELECT * FROM fi", "member_file")
def _(get):
    return D.files_map(get("member_file"))


@query("d1_collisions", _FILES + " SELECT archive, count(*) AS paths, CAST(sum(copies - 1) AS BIGINT) AS collisions FROM fi GROUP BY archive", "member_file")
def _(get):
    return D.collisions(D.files_map(get("member_file")))


@query("d2_primary_tar", _FILES + ", c AS (SELECT archive, tar, count(*) AS entries FROM fi GROUP BY ALL) SELECT archive, tar, entries FROM (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY entries DESC, tar) AS n FROM c) WHERE n = 1", "member_file")
def _(get):
    return D.primary_tar(D.files_map(get("member_file")))


@query("d2_tar_counts", _FILES + " SELECT archive, tar, count(*) AS entries FROM fi GROUP BY ALL", "member_file")
def _(get):
    return D.tar_counts(D.files_map(get("member_file")))


@query(
    "d3_diff_index",
    _FILES + """, o AS (SELECT archive, path, CASE WHEN size % 3 = 0 THEN 'media0.tar' ELSE tar END AS tar, CASE WHEN size % 5 = 0 THEN "offset" + 1 ELSE "offset" END AS "offset" FROM media WHERE size % 7 <> 0),
n AS (SELECT * FROM fi WHERE size % 11 <> 0)
SELECT coalesce(o.archive, n.archive) AS archive, count(*) FILTER (n.path IS NULL) AS missing_now, count(*) FILTER (o.path IS NULL) AS added_now, count(*) FILTER (o."offset" <> n."offset") AS stale_offset, count(*) FILTER (o."offset" = n."offset" AND o.tar <> n.tar) AS other_tar
FROM o FULL JOIN n ON o.archive = n.archive AND o.path = n.path GROUP BY ALL""",
    "member_file", "media",
)
def _(get):
    return D.diff_index(*_two_indexes(get), "media0.tar")


def _two_indexes(get):
    old = get("media").where("size % 7 <> 0").select("archive", "path", F.when(F.col("size") % 3 != 0, F.col("tar")).alias("tar"), F.when(F.col("size") % 5 == 0, F.col("offset") + 1).otherwise(F.col("offset")).alias("offset"))
    return old, D.files_map(get("member_file")).where("size % 11 <> 0")


QUERIES["d3_diff_by_digest"] = lambda spark, sf_dir: diff_index_by_digest(*_two_indexes(partial(view, spark, sf_dir)), "media0.tar")
SQL["d3_diff_by_digest"] = SQL["d3_diff_index"]


@query(
    "d5_dedupe_assets",
    """a AS (SELECT archive, concat(CAST(tid AS VARCHAR(19)), '/p_', CAST(id AS VARCHAR(9)), '_1_', lpad(CAST(agree AS VARCHAR(19)), 16, '0'), '.jpg') AS path, 'media.tar' AS tar, create_time AS "offset", disagree AS size, create_time AS seq, concat(CAST(tid AS VARCHAR(19)), '/p_', CAST(id AS VARCHAR(9)), '_1.jpg') AS identity FROM raw_post),
d AS (SELECT DISTINCT * FROM a),
f AS (SELECT *, row_number() OVER (PARTITION BY archive, identity ORDER BY seq, path, "offset", size) AS n FROM d),
u AS (SELECT archive, path, min(tar) AS tar, min("offset") AS "offset", min(size) AS size, seq, identity FROM d GROUP BY archive, path, seq, identity),
g AS (SELECT *, first_value(size) OVER w AS fs, first_value("offset") OVER w AS fo, row_number() OVER w AS n FROM u WINDOW w AS (PARTITION BY archive, identity ORDER BY seq, path))
SELECT archive, path, tar, "offset", size, seq, identity, tar AS stored_tar, CASE WHEN size = fs THEN fo ELSE "offset" END AS stored_offset, size = fs AND n > 1 AS is_reused FROM g""",
    "raw_post",
)
def _(get):
    stamp = F.lpad(F.col("agree").cast("string"), 16, "0")
    base = F.concat(F.col("tid").cast("string"), F.lit("/p_"), F.col("id").cast("string"), F.lit("_1_"), stamp, F.lit(".jpg"))
    rows = get("raw_post").select("archive", base.alias("path"), F.lit("media.tar").alias("tar"), F.col("create_time").alias("offset"), F.col("disagree").alias("size"), F.col("create_time").alias("seq"))
    rows = rows.groupBy("archive", "path", "seq").agg(F.min("tar").alias("tar"), F.min("offset").alias("offset"), F.min("size").alias("size"))
    return D.dedupe_assets(rows.select("archive", "path", "tar", "offset", "size", "seq"))


@query("d6_resolve_avatars", "SELECT archive, tid, portrait, concat(CAST(tid AS VARCHAR(19)), '/user_avatar/', avatar) AS path FROM member WHERE avatar <> '' AND user_id % 2 = 0", "member")
def _(get):
    users = get("member")
    there = users.where("user_id % 2 = 0").select("archive", F.concat_ws("/", F.col("tid").cast("string"), F.lit("user_avatar"), "avatar").alias("path"))
    return D.resolve_avatars(users, there)


@query(
    "d6_resolve_media",
    """f AS (SELECT archive, tid, id AS post_id, concat('p_', CAST(disagree AS VARCHAR(9)), '_', CAST(floor AS VARCHAR(9)), '.jpg') AS filename FROM post),
m AS (SELECT archive, CAST(split_part(path, '/', 1) AS BIGINT) AS tid, split_part(path, '/', -1) AS filename, min(path) AS path FROM media GROUP BY ALL)
SELECT archive, tid, post_id, 0 AS idx, 'file' AS kind, filename, m.path FROM f LEFT JOIN m USING (archive, tid, filename)""",
    "post", "media",
)
def _(get):
    name = F.concat(F.lit("p_"), F.col("disagree").cast("string"), F.lit("_"), F.col("floor").cast("string"), F.lit(".jpg"))
    frags = get("post").select("archive", "tid", F.col("id").alias("post_id"), F.lit(0).alias("idx"), F.lit(3).alias("type"), name.alias("filename"), F.lit("").alias("cover_filename"))
    return D.resolve_media(frags, get("media"))


@query(
    "d7_duplicate_files",
    """f AS (SELECT archive, tid, 'image' AS kind, concat(CAST(id AS VARCHAR(9)), '.jpg') AS path, CAST(agree % 5 AS VARCHAR(9)) AS content, id = 3 AS is_target FROM post),
h AS (SELECT *, first_value(path) OVER (PARTITION BY archive, tid, kind, content ORDER BY is_target DESC, path) AS keep_path FROM f)
SELECT archive, tid, kind, path, md5(content) AS hash, keep_path FROM h WHERE path <> keep_path""",
    "post",
)
def _(get):
    content = (F.col("agree") % 5).cast("string")
    return D.duplicate_files(get("post").select("archive", "tid", F.lit("image").alias("kind"), F.concat(F.col("id").cast("string"), F.lit(".jpg")).alias("path"), F.length(content).alias("size"), content.cast("binary").alias("content"), (F.col("id") == 3).alias("is_target")))


@query(
    "d8_verify_index",
    """s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY md5(path), path) AS n FROM media) WHERE n <= 40)
SELECT archive, path, tar, "offset", size, EXISTS (SELECT 1 FROM member_file m WHERE m.archive = s.archive AND m.tar = s.tar AND m."offset" = s."offset" AND m.name = s.path AND m.size = s.size) AS ok FROM s""",
    "media", "member_file",
)
def _(get):
    return D.verify_index(get("media"), get("member_file")).select("archive", "path", "tar", "offset", "size", "ok")


@query("d10_media_counts", "SELECT archive, TRY_CAST(split_part(path, '/', 1) AS BIGINT) AS tid, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM media GROUP BY ALL", "media")
def _(get):
    return D.media_counts(get("media"))


# --- files of threads ------------------------------------------------------------------


def _place(df) -> str:
    """A new folder below the shared one, as a path that SQLite and tarfile open."""
    path = scratch(df.sparkSession).removeprefix("file://")
    os.makedirs(path, exist_ok=True)
    return path


@query("io2_content_dbs", "SELECT archive, tid, id, floor, contents, is_thread_author, CAST(0 AS BIGINT) AS scrape_batch_id FROM text_post", "text_post")
def _(get):
    """A file for each thread, written where tasks run, then read as the posts of an archive."""
    posts = get("text_post").select("archive", "tid", "id", "floor", "contents", "is_thread_author")
    place = _place(posts)

    def write(rows):
        import sqlite3

        path = f"{place}/{rows.tid[0]}.db"
        with contextlib.suppress(FileNotFoundError):
            os.remove(path)  # of a task that was lost
        with sqlite3.connect(path) as db:
            db.execute("create table post (id integer, floor integer, contents text, is_thread_author integer)")
            db.executemany("insert into post values (?, ?, ?, ?)", [(int(r.id), int(r.floor), r.contents, int(r.is_thread_author)) for r in rows.itertuples()])
        return rows[["archive", "tid"]].head(1).assign(path=path)

    paths = stored(posts.groupBy("archive", "tid").applyInPandas(write, "archive string, tid long, path string"), "paths")
    return IO.read_content_dbs(posts.sparkSession, paths, "post").select("archive", "tid", "id", "floor", "contents", "is_thread_author", "scrape_batch_id")


@query(
    "io8_tar_members",
    """m AS (SELECT archive, concat('part', CAST(tid % 4 AS VARCHAR(9)), '.tar') AS tar, concat(CAST(tid AS VARCHAR(19)), '/', CAST(id AS VARCHAR(19)), '.txt') AS name, tid, id, strlen(contents) AS size FROM text_post)
SELECT archive, tar, name, CAST(512 + coalesce(sum(512 + (size + 511) // 512 * 512) OVER (PARTITION BY tar ORDER BY tid, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", size FROM m""",
    "text_post",
)
def _(get):
    """Four archives of the threads' texts, written where tasks run, then listed by their headers."""
    posts = get("text_post").select("archive", (F.col("tid") % 4).alias("part"), "tid", "id", "contents")
    place = _place(posts)

    def write(rows):
        import io
        import tarfile

        path = f"{place}/part{rows.part[0]}.tar"
        with tarfile.open(path, "w") as tar:
            for r in rows.sort_values(["tid", "id"]).itertuples():
                data, member = r.contents.encode(), tarfile.TarInfo(f"{r.tid}/{r.id}.txt")
                member.size = len(data)
                tar.addfile(member, io.BytesIO(data))
        return rows[["archive"]].head(1).assign(path=path)

    paths = stored(posts.groupBy("archive", "part").applyInPandas(write, "archive string, path string"), "tars")
    return read_tar_members(posts.sparkSession, paths, range_bytes=1 << 16)


# --- streams in their batch form ------------------------------------------------------

_BUCKET = "g AS (SELECT time_bucket(INTERVAL 90 SECOND, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS finished FROM activity GROUP BY 1)"


@query("st3_goodput", _BUCKET + " SELECT start, finished, finished * 40.0::DOUBLE AS per_hour FROM g", "activity")
def _(get):
    return streams.goodput(get("activity"))


_SMOOTHED = """n AS (SELECT *, finished * 40.0::DOUBLE AS per_hour FROM g),
e AS (SELECT start, finished, list_reduce(list(per_hour) OVER (ORDER BY start ROWS BETWEEN 79 PRECEDING AND CURRENT ROW), lambda a, x: 0.5::DOUBLE * x + 0.5::DOUBLE * a) AS ewma FROM n),
w AS (SELECT *, lag(ewma) OVER (ORDER BY start) AS was FROM e),
c AS (SELECT *, CASE WHEN was > 0 THEN (ewma - was) / was END AS change FROM w)
SELECT start, finished, round(ewma, 6) AS ewma, CASE WHEN abs(change) < 0.0000005 THEN 0.0::DOUBLE ELSE round(change, 6) END AS change FROM c"""


@query("st3_smoothed_goodput", f"{_BUCKET}, {_SMOOTHED}", "activity")
def _(get):
    change = F.when(F.abs("change") < 5e-7, F.lit(0.0)).otherwise(F.round("change", 6))  # no zero has a sign
    return streams.smoothed_goodput(get("activity")).select("start", "finished", F.round("ewma", 6).alias("ewma"), change.alias("change"))


@query(
    "st1_stream_merge",
    f"""a AS (SELECT * FROM raw_post WHERE user_id % 2 = 0 AND id > 0), b AS (SELECT * FROM raw_post WHERE user_id % 2 = 1 AND id > 0)
SELECT {POST} FROM {_first("a", "archive, tid, id", _SCRAPED)} UNION ALL
SELECT {POST} FROM {_first("b", "archive, tid, id", _SCRAPED)} s WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.archive = s.archive AND a.tid = s.tid AND a.id = s.id)""",
    "raw_post",
)
def _(get):
    posts = IO.conform(get("raw_post"), "post")
    spark, place = posts.sparkSession, scratch(posts.sparkSession)
    for arrived in ("user_id % 2 = 0", "user_id % 2 = 1", "user_id % 2 = 1"):  # the last one repeats files that are known
        posts.where(arrived).write.mode("append").parquet(f"{place}/in")
        streams.stream_merge(spark, f"{place}/in", f"{place}/out", f"{place}/check")
    return streams.read_merged(spark, f"{place}/out").select(*POST.split(", "))


@query("st2_stream_dedupe", "SELECT DISTINCT archive, tid, event_type FROM activity", "activity")
def _(get):
    events = get("activity").withColumn("ts", F.col("ts").cast("timestamp"))
    spark, place = events.sparkSession, scratch(events.sparkSession)
    events.write.parquet(f"{place}/in")
    first = streams.stream_dedupe(spark.readStream.schema(events.schema).parquet(f"{place}/in"), ["archive", "tid", "event_type"], "ts", "36500 days")
    first.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{place}/out").select("archive", "tid", "event_type")


_FIRST = """e AS (SELECT *, archive || '/' || tid || '/' || event_type AS k FROM activity),
w AS (SELECT k, min(ts) AS a FROM e GROUP BY k UNION ALL SELECT e.k, min(e.ts) FROM w JOIN e ON e.k = w.k AND e.ts > w.a + INTERVAL 86400 SECOND GROUP BY e.k, w.a)
SELECT archive, tid, ts, event_id, event_type FROM (SELECT e.*, row_number() OVER (PARTITION BY e.k, w.a ORDER BY event_id, archive, event_type, tid, ts) AS n FROM w JOIN e ON e.k = w.k AND e.ts BETWEEN w.a AND w.a + INTERVAL 86400 SECOND
  WHERE w.a + INTERVAL 172800 SECOND + INTERVAL 1 MILLISECOND <= (SELECT time_bucket(INTERVAL 1 MILLISECOND, max(ts)) FROM activity)) WHERE n = 1"""


@query("st2_stream_first", _FIRST, "activity")
def _(get):
    """Whole rows, the delay of a day, and files that arrive one after the other."""
    events = get("activity").withColumn("ts", F.col("ts").cast("timestamp"))
    spark, place = events.sparkSession, scratch(events.sparkSession)
    for days in ("day(ts) <= 10", "day(ts) between 11 and 20", "day(ts) > 20"):
        events.where(days).write.mode("append").parquet(f"{place}/in")
        first = streams.stream_first(spark.readStream.schema(events.schema).parquet(f"{place}/in"), ["archive", "tid", "event_type"], "ts", 86_400, ["event_id"])
        first.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{place}/out").select("archive", "tid", "ts", "event_id", "event_type")


SQL["st2_stream_first"] = SQL["st2_stream_first"].replace("WITH ", "WITH RECURSIVE ", 1)

_SESSION = """o AS (SELECT tid, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY tid ORDER BY ts)) > 360000000, true) AS b FROM activity),
n AS (SELECT *, sum(b::INTEGER) OVER (PARTITION BY tid ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
SELECT tid, min(ts) AS start, {end} AS "end", count(*) AS events FROM n GROUP BY tid, s"""


@query("st4_activity_sessions", _SESSION.format(end="max(ts) + INTERVAL 360 SECOND"), "activity")
def _(get):
    return streams.activity_sessions(get("activity"))


@query("st4_activity_sessions_batch", _SESSION.format(end="max(ts)"), "activity")
def _(get):
    return streams.activity_sessions_batch(get("activity"))
