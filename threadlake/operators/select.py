"""Projections, filters and predicates over folders, posts, users and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions.scalars import asset_pid

# The form of folder names: fixed value.
_FOLDER = r"^\[(.*?)吧\]\[(\d+)\](.*)$"
ALL, AUTHOR, AUTHOR_ONLY, REPLIED, REPLIED_ONLY = range(1, 6)


def parse_folder_names(df: DataFrame, col: str = "name") -> tuple[DataFrame, DataFrame]:
    """(parsed with forum, tid and title; rejected) folders; names with a leading underscore are neither."""
    name = F.col(col)
    there = df.where(~name.startswith("_"))
    parsed = there.where(name.rlike(_FOLDER)).withColumns({"forum": F.regexp_extract(name, _FOLDER, 1), "tid": F.regexp_extract(name, _FOLDER, 2).cast("bigint"), "title": F.regexp_extract(name, _FOLDER, 3)})
    return parsed, there.where(~name.rlike(_FOLDER))


def recover_forum_name(threads: DataFrame, forum_json: DataFrame, thread_json: DataFrame) -> DataFrame:
    """threads with an empty forum filled from the archive's forum document, then the thread's own document.

    forum_json: archive, forum_name; thread_json: archive, tid, forum_name; both unique by key.
    """
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    joined = threads.join(forum_json.select("archive", F.col("forum_name").alias("_f")), "archive", "left").join(thread_json.select("archive", "tid", F.col("forum_name").alias("_t")), ["archive", "tid"], "left")
    return joined.withColumn("forum", F.coalesce(some("forum"), some("_f"), some("_t"), F.lit(""))).select(*threads.columns)


def archive_name(name: Column, meta_type: Column, created_at: Column, mtime: Column) -> Column:
    """Ba_ or User_<name>_<YYMMDD>; names of that form stay; mtime is epoch seconds."""
    day = F.coalesce(F.nullif(F.substring(F.replace(F.left(created_at, F.lit(10)), F.lit("-"), F.lit("")), 3, 6), F.lit("")), F.date_format(F.timestamp_seconds(mtime), "yyMMdd"))
    prefix = F.when(meta_type == "user", "User").otherwise("Ba")
    return F.when(name.rlike(r"^(Ba|User)_.+_\d{6}$"), name).otherwise(F.concat_ws("_", prefix, name, day))


def filter_posts(posts: DataFrame, mode: int) -> DataFrame:
    """Posts of one of five modes.

    ALL; AUTHOR: the author's floors with all their sub-posts; AUTHOR_ONLY: with the author's sub-posts;
    REPLIED and REPLIED_ONLY: also floors under which the author has a sub-post in
    the same scrape batch.
    """
    if mode == ALL:
        return posts
    author = F.coalesce("is_thread_author", F.lit(False))
    floors, subs = posts.where(F.col("parent_id") == 0), posts.where(F.col("parent_id") != 0)
    kept = floors.where(author)
    if mode in (REPLIED, REPLIED_ONLY):
        answered = subs.where(author).select("archive", "tid", F.col("parent_id").alias("id"), "scrape_batch_id").distinct()
        kept = kept.unionByName(floors.where(~author).join(answered, ["archive", "tid", "id", "scrape_batch_id"], "left_semi").select(*posts.columns))
    if mode in (AUTHOR_ONLY, REPLIED_ONLY):
        subs = subs.where(author)
    parents = kept.select("archive", "tid", F.col("id").alias("parent_id")).distinct()
    return kept.unionByName(subs.join(parents, ["archive", "tid", "parent_id"], "left_semi").select(*posts.columns))


def drop_users_without_posts(users: DataFrame, posts: DataFrame) -> DataFrame:
    writers = posts.where("user_id <> 0").select("archive", "tid", "user_id").distinct()
    return users.join(writers, ["archive", "tid", "user_id"], "left_semi").select(*users.columns)


def drop_assets_of(removed: DataFrame, media: DataFrame, name: str = "filename") -> DataFrame:
    """media without the rows whose name carries the id of a removed post of the thread."""
    gone = removed.select("archive", "tid", F.col("id").alias("_pid")).distinct()
    return media.withColumn("_pid", asset_pid(F.col(name))).join(gone, ["archive", "tid", "_pid"], "left_anti").select(*media.columns)


def author_only(posts: DataFrame) -> DataFrame:
    return posts.where("is_thread_author")


# Names of files that the merge reads itself: fixed values.
MERGED_FILES = ("thread.json", "forum.json", "content.db", "scrape_info.json", "content.db-wal", "content.db-shm")


def asset_paths(files: DataFrame) -> DataFrame:
    """files (archive, tid, path) that are assets, with archive_path <tid>/<path without post_assets/>."""
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.where(~base.isin(*MERGED_FILES)).withColumn("archive_path", F.concat_ws("/", F.col("tid").cast("string"), F.regexp_replace("path", r"(^|/)post_assets/", "$1")))
