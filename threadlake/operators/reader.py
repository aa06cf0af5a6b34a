"""Reader queries: lists, thread views, timelines, suggestions, directories and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlake.operators.planning import numbered
from threadlake.operators.users import attach_users

SORTS = ("create_time", "reply_num", "view_num", "agree")
PAGE = 30


def list_threads(threads: DataFrame, sort: str = "create_time", order: str = "desc", page: int = 1, page_size: int = 20) -> DataFrame:
    """One page (1 to 200 threads) of an ordered list, with the total; ties by archive and tid."""
    if sort not in SORTS or order not in ("asc", "desc") or page < 1:
        raise ValueError("unknown sort, order or page")
    size = min(max(page_size, 1), 200)
    key = F.desc_nulls_last(sort) if order == "desc" else F.asc_nulls_last(sort)
    total = threads.agg(F.count("*")).scalar()
    return threads.orderBy(key, "archive", "tid").offset((page - 1) * size).limit(size).withColumn("total", total)


def thread_view(threads: DataFrame, posts: DataFrame, users: DataFrame, tids: DataFrame, author_only: bool = False) -> DataFrame:
    """archive, tid, title, floor rows in order, each with its author's name and its sub-posts by id."""
    key = ["archive", "tid"]
    wanted = attach_users(posts.join(tids.select(*key), key, "left_semi").select(*posts.columns), users)
    if author_only:
        wanted = wanted.where("is_thread_author")
    subs = wanted.where("parent_id <> 0").groupBy(*key, F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "user_id", "display_name", "contents", "create_time"))).alias("sub_posts"))
    floors = wanted.where("parent_id = 0").join(subs, [*key, "id"], "left").join(threads.select(*key, "title"), key, "left")
    return floors.select(*key, "title", "floor", "id", "user_id", "display_name", "contents", "create_time", "agree", "sub_posts").orderBy(*key, "floor", "id")


def thread_media(media: DataFrame, tids: DataFrame) -> DataFrame:
    """archive, tid, path of the files of threads: those whose path begins with the thread."""
    own = media.select("archive", F.split_part("path", F.lit("/"), F.lit(1)).try_cast("bigint").alias("tid"), "path").where(F.col("path").contains("/"))
    return own.join(tids.select("archive", "tid").distinct(), ["archive", "tid"], "left_semi").select("archive", "tid", "path")


def thread_page(posts: DataFrame, sort: str = "floor", page: int = 1, author_only: bool = False, page_size: int = PAGE) -> DataFrame:
    """One page of each thread's floors: by floor, floor-desc, agree or replies (most first); ties keep floor order.

    For deep pages of large threads, see StoredOrder.
    """
    first = {"floor": F.asc("floor"), "floor-desc": F.desc("floor"), "agree": F.desc("agree"), "replies": F.desc("reply_num")}[sort]
    floors = posts.where("parent_id = 0")
    if author_only:
        floors = floors.where("is_thread_author")
    place = F.row_number().over(W.partitionBy("archive", "tid").orderBy(first, "floor", "id"))
    # the upper bound lets a window drop what is beyond it before the shuffle
    return floors.withColumn("place", place).where((F.col("place") <= page * page_size) & (F.col("place") > (page - 1) * page_size))


def comment_preview(posts: DataFrame, few: int = 5, shown: int = 3) -> DataFrame:
    """Sub-posts shown under each floor: all up to ``few``, else the first ``shown``; with the total."""
    parent = W.partitionBy("archive", "tid", "parent_id")
    ranked = posts.where("parent_id <> 0").withColumn("place", F.row_number().over(parent.orderBy("id"))).withColumn("total", F.count("*").over(parent))
    return ranked.where((F.col("total") <= few) | (F.col("place") <= shown))


def timeline(posts: DataFrame) -> DataFrame:
    """Posts (of different archive, tid and id) with their place in the thread by time; a hot thread is spread over tasks."""
    return numbered(posts, ["archive", "tid"], ["create_time", "id"], "place").withColumn("place", F.col("place") + 1)


def latest_posts(posts: DataFrame) -> DataFrame:
    """archive, tid, parent_id, id of the latest floor of each thread (parent_id 0) and sub-post of each floor."""
    return posts.groupBy("archive", "tid", "parent_id").agg(F.max("id").alias("id"))


def suggest(threads: DataFrame, q: str, per_forum: int = 5, total: int = 10) -> DataFrame:
    """Titles that contain q whatever the case, a few of each forum; no wildcards in q."""
    pattern = "%" + q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    hits = threads.where(F.col("title").ilike(pattern)).select("archive", "forum_name", "tid", "title")
    place = F.row_number().over(W.partitionBy("forum_name").orderBy("archive", "tid"))
    return hits.withColumn("_p", place).where(F.col("_p") <= per_forum).drop("_p").orderBy("forum_name", "archive", "tid").limit(total)


def forum_directory(forums: DataFrame, threads: DataFrame, media: DataFrame) -> DataFrame:
    """archive, forum_name, archived threads and media files, most threads first."""
    t = threads.groupBy("archive").agg(F.count("*").alias("threads"))
    m = media.groupBy("archive").agg(F.count("*").alias("media"))
    first = forums.groupBy("archive").agg(F.min_by(F.struct("forum_name", "member_num", "post_num"), "forum_name").alias("f"))
    return first.join(t, "archive", "left").join(m, "archive", "left").select("archive", "f.*", F.coalesce("threads", F.lit(0)).alias("threads"), F.coalesce("media", F.lit(0)).alias("media")).orderBy(F.desc("threads"), "archive")


def forum_keys(paths: DataFrame, col: str = "path") -> DataFrame:
    """paths with collection and key of <collection>/<archive>/... or <archive>/...: the folder of the database and what is above."""
    folder = F.regexp_replace(col, r"/[^/]*$", "")
    return paths.withColumn("key", folder).withColumn("collection", F.when(folder.contains("/"), F.regexp_extract(folder, r"^(.*)/[^/]*$", 1)))


def collections(forums: DataFrame) -> DataFrame:
    """collection, forums, names (sorted) of forums that belong to one."""
    return forums.where("collection is not null").groupBy("collection").agg(F.count("*").alias("forums"), F.array_sort(F.collect_list("forum_name")).alias("names"))


def global_stats(forums: DataFrame, threads: DataFrame, posts: DataFrame, users: DataFrame, media: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: forums, threads, posts, users (distinct portraits of each archive, summed), first and last time, media."""
    distinct = F.approx_count_distinct("portrait") if approximate else F.count_distinct("portrait")
    one = threads.agg(F.count("*").alias("threads"), F.min(F.when(F.col("create_time") > 0, F.col("create_time"))).alias("earliest"), F.max("create_time").alias("latest"))
    people = users.groupBy("archive").agg(distinct.alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)))
    count = lambda df: df.agg(F.count("*")).scalar()
    return one.select("*", count(forums).alias("forums"), count(posts).alias("posts"), people.scalar().alias("users"), count(media).alias("media"))


def locate_threads(threads: DataFrame, tids: DataFrame) -> DataFrame:
    """tid and archive of every archive that holds a wanted thread."""
    return threads.join(tids.select("tid").distinct(), "tid", "left_semi").select("tid", "archive", "title")


def resolve_forum(forums: DataFrame, name: str) -> DataFrame:
    """The forum whose key, else display name, else stored name is ``name``; nothing if none fits."""
    place = F.when(F.col("key") == name, 1).when(F.col("display_name") == name, 2).when(F.col("forum_name") == name, 3)
    return forums.withColumn("matched", place).where("matched is not null").orderBy("matched", "key").limit(1)
