"""Queries of the reader: lists, views, search, directories and statistics."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from threadlake.operators import digests as DG
from threadlake.operators import reader as R
from threadlake.operators import search as X
from threadlake.operators import substrings as G
from threadlake.operators.pages import StoredOrder
from threadlake.plans.bindings import view, with_views
from threadlake.sources.places import scratch

QUERIES: dict = {}
SQL: dict = {}
#: Indexes that are built, for a session and its tables.
_INDEXES: dict = {}


def query(name: str, sql: str | None = None, *views: str):
    """Registers fn(get, ...) as a query; get(view) binds a view."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(partial(view, spark, sf_dir))
        if sql is not None:
            SQL[name] = with_views(sql, *views) if views else sql
        return fn

    return add


for _sort, _order, _page in (("create_time", "desc", 1), ("reply_num", "asc", 2), ("view_num", "desc", 3), ("agree", "desc", 1)):
    query(
        f"r1_list_threads_{_sort}",
        f"SELECT archive, tid, title, {_sort}, (SELECT count(*) FROM thread) AS total FROM thread ORDER BY {_sort} {_order}, archive, tid LIMIT 50 OFFSET {50 * (_page - 1)}",
        "thread",
    )(lambda get, a=(_sort, _order, _page): R.list_threads(get("thread").select("archive", "tid", "title", a[0]), *a, page_size=50))

_KNOWN = "k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY archive, tid, user_id ORDER BY portrait, avatar, nickname, username) AS n FROM member WHERE user_id <> 0) WHERE n = 1), a AS (SELECT p.*, CASE WHEN p.user_id = 0 THEN '匿名' ELSE coalesce(nullif(k.nickname, ''), nullif(k.username, ''), '匿名') END AS display_name FROM post p LEFT JOIN k ON k.archive = p.archive AND k.tid = p.tid AND k.user_id = p.user_id WHERE true {more})"
_VIEW = _KNOWN + """,
s AS (SELECT archive, tid, parent_id AS id, string_agg(concat(CAST(id AS VARCHAR(9)), ':', display_name), ',' ORDER BY id) AS sub_posts FROM a WHERE parent_id <> 0 GROUP BY ALL)
SELECT a.archive, a.tid, t.title, a.floor, a.id, a.user_id, a.display_name, a.contents, a.create_time, a.agree, s.sub_posts
FROM a LEFT JOIN s USING (archive, tid, id) LEFT JOIN thread t USING (archive, tid) WHERE a.parent_id = 0"""


def _thread_view(get, **more):
    threads = get("thread")
    seen = R.thread_view(threads, get("post"), get("member"), threads.select("archive", "tid"), **more)
    return seen.withColumn("sub_posts", F.array_join(F.transform("sub_posts", lambda s: F.concat(s["id"].cast("string"), F.lit(":"), s["display_name"])), ","))


@query("r2_thread_view", _VIEW.format(more=""), "thread", "post", "member")
def _(get):
    return _thread_view(get)


@query("r2_thread_media", "m AS (SELECT archive, CAST(split_part(path, '/', 1) AS BIGINT) AS tid, path FROM media) SELECT m.* FROM m JOIN thread t ON t.archive = m.archive AND t.tid = m.tid WHERE t.scrape_status = 1", "media", "thread")
def _(get):
    return R.thread_media(get("media"), get("thread").where("scrape_status = 1"))


@query("pf7_thread_view_author", _VIEW.format(more="AND is_thread_author"), "thread", "post", "member")
def _(get):
    return _thread_view(get, author_only=True)


for _sort, _by in (("floor", "floor"), ("floor-desc", "floor DESC"), ("agree", "agree DESC, floor"), ("replies", "reply_num DESC, floor")):
    query(
        f"r3_thread_page_{_sort.replace('-', '_')}",
        f"SELECT archive, tid, id, place FROM (SELECT *, row_number() OVER (PARTITION BY archive, tid ORDER BY {_by}, floor, id) AS place FROM post WHERE parent_id = 0) WHERE ceil(place / 3.0) = 1",
        "post",
    )(lambda get, sort=_sort: R.thread_page(get("post"), sort, page_size=3).select("archive", "tid", "id", "place"))


@query("r1_deep_page", "SELECT archive, tid, title, create_time, row_number() OVER (ORDER BY create_time DESC NULLS LAST, archive, tid) AS place, count(*) OVER () AS total FROM thread ORDER BY place LIMIT 50 OFFSET 1000", "thread")
def _(get):
    threads = get("thread").select("archive", "tid", "title", "create_time")
    spark = threads.sparkSession
    return StoredOrder(spark, f"{scratch(spark)}/order", ["-create_time", "archive", "tid"]).write(threads, 500).page(21, 50)


@query("r3_stored_places", "SELECT archive, tid, id, row_number() OVER (PARTITION BY archive, tid ORDER BY agree DESC, floor, id) AS place, count(*) OVER (PARTITION BY archive, tid) AS total FROM post WHERE parent_id = 0", "post")
def _(get):
    floors = get("post").where("parent_id = 0").select("archive", "tid", "id", "floor", "agree")
    spark = floors.sparkSession
    return StoredOrder(spark, f"{scratch(spark)}/order", ["-agree", "floor", "id"], ["archive", "tid"]).write(floors, 10_000).places().drop("floor", "agree")


@query("r4_comment_preview", "SELECT archive, tid, parent_id, id, place, total FROM (SELECT *, row_number() OVER (PARTITION BY archive, tid, parent_id ORDER BY id) AS place, count(*) OVER (PARTITION BY archive, tid, parent_id) AS total FROM post WHERE parent_id <> 0) WHERE total <= 2 OR place <= 1", "post")
def _(get):
    return R.comment_preview(get("post"), few=2, shown=1).select("archive", "tid", "parent_id", "id", "place", "total")


@query("r5_timeline", "SELECT archive, tid, id, create_time, row_number() OVER (PARTITION BY archive, tid ORDER BY create_time, id) AS place FROM post", "post")
def _(get):
    return R.timeline(get("post")).select("archive", "tid", "id", "create_time", "place")


@query("r6_latest_posts", "SELECT archive, tid, parent_id, max(id) AS id FROM post GROUP BY ALL", "post")
def _(get):
    return R.latest_posts(get("post"))


@query("r7_suggest", "SELECT archive, forum_name, tid, title FROM (SELECT *, row_number() OVER (PARTITION BY forum_name ORDER BY archive, tid) AS n FROM thread WHERE contains(lower(title), 'high')) WHERE n <= 5 ORDER BY forum_name, archive, tid LIMIT 10", "thread")
def _(get):
    return R.suggest(get("thread"), "HIGH")


@query("r7_suggest_indexed", "SELECT archive, forum_name, tid, title FROM (SELECT *, row_number() OVER (PARTITION BY forum_name ORDER BY archive, tid) AS n FROM thread WHERE contains(lower(title), 'high')) WHERE n <= 5 ORDER BY forum_name, archive, tid LIMIT 10", "thread")
def _(get):
    return G.suggest_indexed(_grams(get("thread"), "title"), get("thread"), "HIGH")


@query("r7_substring", "SELECT archive, tid FROM corpus WHERE contains(lower(contents), 'hin')", "corpus")
def _(get):
    return G.find_substring(_grams(get("corpus"), "contents"), "hIN")


def _grams(rows, text):
    key = (rows.sparkSession.sparkContext.applicationId, tuple(rows.inputFiles()), text)
    if key not in _INDEXES:
        _INDEXES[key] = G.store_grams(rows, ["archive", "tid"], text, scratch(rows.sparkSession))
    return _INDEXES[key]


@query(
    "r10_forum_directory",
    """SELECT f.*, coalesce(threads, 0) AS threads, coalesce(media, 0) AS media FROM (SELECT archive, forum_name, member_num, post_num FROM (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY forum_name) AS n FROM forum) WHERE n = 1) f
LEFT JOIN (SELECT archive, count(*) AS threads FROM thread GROUP BY archive) USING (archive) LEFT JOIN (SELECT archive, count(*) AS media FROM media GROUP BY archive) USING (archive)""",
    "forum", "thread", "media",
)
def _(get):
    return R.forum_directory(get("forum"), get("thread"), get("media"))


@query("r11_collections", "SELECT collection, count(*) AS forums, string_agg(forum_name, ',' ORDER BY forum_name) AS names FROM forum GROUP BY collection", "forum")
def _(get):
    return R.collections(get("forum")).withColumn("names", F.array_join("names", ","))


@query("r11_forum_keys", "SELECT url AS path, regexp_replace(url, '/[^/]*$', '') AS key, CASE WHEN contains(regexp_replace(url, '/[^/]*$', ''), '/') THEN regexp_replace(regexp_replace(url, '/[^/]*$', ''), '/[^/]*$', '') END AS collection FROM pages")
def _(get):
    return R.forum_keys(get("page").select(F.col("url").alias("path")))


@query(
    "r12_global_stats",
    """SELECT (SELECT count(*) FROM forum) AS forums, (SELECT count(*) FROM thread) AS threads, (SELECT count(*) FROM post) AS posts, (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(DISTINCT portrait) AS n FROM member GROUP BY archive)) AS users,
(SELECT min(create_time) FROM thread WHERE create_time > 0) AS earliest, (SELECT max(create_time) FROM thread) AS latest, (SELECT count(*) FROM media) AS media""",
    "forum", "thread", "post", "member", "media",
)
def _(get):
    return R.global_stats(get("forum"), get("thread"), get("post"), get("member"), get("media"))


@query("r12_distinct_users", "SELECT archive, count(DISTINCT portrait) AS users, true AS is_close FROM member GROUP BY archive", "member")
def _(get):
    """Sketches of two halves that share users, united, against exact counts: within 3 %."""
    users = get("member").select("archive", "tid", "portrait", "scrape_time")
    both = DG.unite_sketches(DG.user_sketches(users.where("tid % 3 <> 0")), DG.user_sketches(users.where("tid % 3 <> 1")))
    exact = users.groupBy("archive").agg(F.count_distinct("portrait").alias("exact"))
    joined = DG.distinct_users(both).join(exact, "archive")
    return joined.select("archive", F.col("exact").alias("users"), (F.abs(F.col("users") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.03 * F.col("exact"))).alias("is_close"))


@query("r13_locate_threads", "SELECT tid, archive, title FROM thread WHERE tid IN (SELECT tid FROM post WHERE user_id = 3)", "thread", "post")
def _(get):
    return R.locate_threads(get("thread"), get("post").where("user_id = 3"))


@query("r13_resolve_forum", "SELECT archive, forum_name, collection FROM forum WHERE forum_name = 'NATION_7'", "forum")
def _(get):
    forums = get("forum").withColumn("key", F.concat_ws("/", "collection", "forum_name")).withColumn("display_name", F.upper(F.concat("forum_name", F.lit("!"))))
    return R.resolve_forum(forums, "NATION_7").select("archive", "forum_name", "collection")


# --- search ------------------------------------------------------------------------------

_TOKENS = "ix AS (SELECT archive, tid, id AS post_id, floor, regexp_extract_all(strip_accents(lower(contents)), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+') AS tokens FROM {source})"


@query("r9_search_index", _TOKENS.format(source="text_post") + " SELECT archive, tid, post_id, floor, array_to_string(tokens, ' ') AS tokens, len(tokens) AS n_tokens FROM ix", "text_post")
def _(get):
    return X.build_search_index(get("text_post")).withColumn("tokens", F.array_join("tokens", " "))


@query(
    "r9_index_is_current",
    "SELECT 'all' AS posts_of, (SELECT count(*) FROM text_post) AS indexed, (SELECT count(*) FROM text_post) AS posts, true AS current"
    " UNION ALL SELECT 'users', (SELECT count(*) FROM text_post WHERE is_thread_author), (SELECT count(*) FROM text_post), (SELECT count(*) FROM text_post WHERE NOT is_thread_author) = 0",
    "text_post",
)
def _(get):
    posts = get("text_post")
    of = lambda name, part: X.index_is_current(X.build_search_index(part), posts).select(F.lit(name).alias("posts_of"), "*")
    return of("all", posts).unionByName(of("users", posts.where("is_thread_author")))


@query("r9_postings", _TOKENS.format(source="text_post") + " SELECT archive, tid, post_id, unnest(generate_series(0, len(tokens) - 1)) AS pos, unnest(tokens) AS token FROM ix WHERE len(tokens) > 0", "text_post")
def _(get):
    return X.postings(X.build_search_index(get("text_post")))


def _search_sql(counts: dict[str, str], where: str, source: str, threads: str, size: int = 50, marked: str | None = None) -> str:
    """counts: occurrences of each scored phrase over tokens; marked: whether a token x is one of them, for snippets."""
    start = f"greatest(coalesce(list_position(list_transform(tokens, lambda x: {marked}), true), 1), 1)"
    snippet = f", array_to_string(list_transform(tokens[{start}:{start} + {X.SNIPPET - 1}], lambda x: CASE WHEN {marked} THEN '<mark>' || x || '</mark>' ELSE x END), ' ') AS snippet" if marked else ""
    shown = ", snippet" if marked else ""
    score = " + ".join(f"(CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 0.000001 ELSE ln((n - d{i} + 0.5) / (d{i} + 0.5)) END) * {c} * 2.2 / ({c} + 1.2 * (0.25 + 0.75 * len(tokens) / av))" for i, c in enumerate(counts))
    return (
        _TOKENS.format(source=source)
        + f", c AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in counts.items())} FROM ix), st AS (SELECT count(*)::DOUBLE AS n, avg(len(tokens)) AS av, count(*) FILTER ({where}) AS total, {', '.join(f'count(*) FILTER ({c} > 0) AS d{i}' for i, c in enumerate(counts))} FROM c)"
        + f" SELECT archive, tid, post_id, title, rank, total{shown} FROM (SELECT archive, tid, post_id, round(-({score}), 6) AS rank, total{snippet} FROM c, st WHERE {where} ORDER BY rank, archive, tid, post_id LIMIT {size}) JOIN {threads} USING (archive, tid)"
    )


_one = lambda w: f"len(list_filter(tokens, lambda x: x = '{w}'))"
_prefix = lambda w: f"len(list_filter(tokens, lambda x: starts_with(x, '{w}')))"
_two = lambda a, b: f"len(list_filter(range(1, len(tokens)), lambda i: tokens[i] = '{a}' AND tokens[i + 1] = '{b}'))"
for _name, _text, _counts, _where in (
    ("term", "thing", {"c1": _one("thing")}, "c1 > 0"),
    ("and", "the of", {"c1": _one("the"), "c2": _one("of")}, "c1 > 0 AND c2 > 0"),
    ("or_not", "and OR thing NOT was", {"c1": _one("and"), "c2": _one("thing")}, "(c1 > 0 OR c2 > 0 AND NOT list_contains(tokens, 'was'))"),
    ("phrase", '"of the"', {"c1": _two("of", "the")}, "c1 > 0"),
    ("prefix", "inon*", {"c1": _prefix("inon")}, "c1 > 0"),
):
    query(f"r8_search_{_name}", _search_sql(_counts, _where, "corpus", "corpus_thread"), "corpus", "corpus_thread")(lambda get, q=_text: X.search(_stored(get("corpus")), get("corpus_thread"), q, page_size=50).drop("snippet"))


def _stored(posts):
    """The index of the posts; it is built once for a session and its tables, as every query only asks it."""
    key = (posts.sparkSession.sparkContext.applicationId, tuple(posts.inputFiles()), tuple(posts.columns))
    if key not in _INDEXES:
        _INDEXES[key] = X.store_index(posts, scratch(posts.sparkSession))
    return _INDEXES[key]


@query("r9_store_index", _TOKENS.format(source="corpus") + " SELECT token, count(*) AS posts, CAST(sum(times) AS BIGINT) AS times FROM (SELECT tid, unnest(tokens) AS token, 1 AS times FROM ix) GROUP BY token".replace("count(*)", "count(DISTINCT tid)"), "corpus")
def _(get):
    """Building alone: a new index each time, and what its blocks hold."""
    blocks = X.store_index(get("corpus"), scratch(get("corpus").sparkSession)).postings
    times = F.aggregate("entries", F.lit(0).cast("long"), lambda a, e: a + F.size(e["positions"]))
    return blocks.groupBy("token").agg(F.sum("n").alias("posts"), F.sum(times).alias("times"))


@query(
    "r9_index_currency",
    "SELECT 'same' AS now, (SELECT count(*) FROM text_post) AS indexed, (SELECT count(*) FROM text_post) AS posts, true AS current UNION ALL SELECT 'one changed', (SELECT count(*) FROM text_post), (SELECT count(*) FROM text_post), (SELECT count(*) FROM text_post WHERE tid = 1) = 0",
    "text_post",
)
def _(get):
    posts = get("text_post")
    index = _stored(posts)
    changed = posts.withColumn("contents", F.when(F.col("tid") == 1, F.reverse("contents")).otherwise(F.col("contents")))
    of = lambda name, now: X.index_currency(index, now).agg(F.lit(name).alias("now"), F.sum("indexed").alias("indexed"), F.sum("posts").alias("posts"), F.bool_and("current").alias("current"))
    return of("same", posts).unionByName(of("one changed", changed))


@query("r8_search_extended", _search_sql({"c1": _one("and"), "c2": _one("thing")}, "(c1 > 0 OR c2 > 0)", "corpus", "corpus_thread"), "corpus", "corpus_thread")
def _(get):
    """Over an index of a part of the posts, some with another text and some that are no longer there, brought up to all of them."""
    posts = get("corpus")
    old = posts.where("tid % 3 <> 0").withColumn("contents", F.when(F.col("tid") % 5 == 0, F.lit("thing and thing")).otherwise(F.col("contents")))
    index = X.store_index(old.unionByName(posts.where("tid % 10 = 1").withColumn("id", F.lit(2).cast("long"))), scratch(posts.sparkSession))
    return X.search(X.extend_index(index, posts), get("corpus_thread"), "and OR thing", page_size=50).drop("snippet")


@query("r8_search_snippet", _search_sql({"c1": _one("the"), "c2": _prefix("wh")}, "(c1 > 0 OR c2 > 0)", "text_post", "text_thread", 20, "x = 'the' OR starts_with(x, 'wh')"), "text_post", "text_thread")
def _(get):
    return X.search(_stored(get("text_post")), get("text_thread"), "the OR wh*", page_size=20)
