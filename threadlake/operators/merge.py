"""Keyed merges of archive tables: the first row of a key wins, and running twice changes nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlake.schemas import KEYS, REQUIRED, scrape_order


def first_rows(df: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """One row for each key: the first by ``order_by``, then by all other columns, so the order is total."""
    rest = [c for c in sorted(df.columns) if c not in keys and c not in order_by and df.schema[c].dataType.typeName() != "map"]
    order = W.partitionBy(*keys).orderBy(*order_by, *rest)
    return df.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def merge_ignore(target: DataFrame, source: DataFrame, keys: Sequence[str], order_by: Sequence[str] = (), required: Sequence[str] = ()) -> DataFrame:
    """target and the source rows whose key it lacks.

    Existing rows win; among source rows of one key the first wins (see first_rows); source rows with
    a null in ``required`` or in the key are dropped.
    """
    # the anti join and the window share one exchange on the key for each side
    fine = source.dropna(subset=[*dict.fromkeys([*keys, *required])])
    fresh = first_rows(fine.join(target.select(*keys), list(keys), "left_anti").select(*source.columns), keys, order_by)
    return target.unionByName(fresh, allowMissingColumns=True)


def _merge(name: str, target: DataFrame, source: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    required = [c for c in REQUIRED[name] if c in source.columns]
    return merge_ignore(target, source, KEYS[name], order_by, required)


def merge_posts(target: DataFrame, source: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    """By thread and id; spurious posts (id 0 and below) are dropped."""
    return _merge("post", target, source.where("id > 0"), order_by)


def merge_users(target: DataFrame, source: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    return _merge("user", target, source, order_by)


def merge_media_sources(target: DataFrame, source: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    return _merge("media_source", target, source, order_by)


def merge_batches(target: DataFrame, source: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    return _merge("scrape_batch", target, source, order_by)


def append_user_history(target: DataFrame, source: DataFrame, dedupe: bool = True) -> DataFrame:
    """Both histories; equal rows once, unless told otherwise."""
    both = target.unionByName(source.dropna(subset=[c for c in REQUIRED["user_info_history"] if c in source.columns]))
    return both.dropDuplicates() if dedupe else both


def merge_threads(folders: DataFrame, thread_json: DataFrame, target: DataFrame) -> DataFrame:
    """target and the threads of folders (archive, tid, forum, title) that it lacks.

    Metadata come from the thread's document (archive, tid and columns of the table); without one
    the title is the folder's and the forum id 0.
    """
    own = [c for c in target.columns if c not in ("archive", "tid", "folder_name", "scrape_status")]
    docs = thread_json.select("archive", "tid", *(F.col(c).alias(f"_{c}") for c in own if c in thread_json.columns))
    joined = folders.join(docs, ["archive", "tid"], "left")
    values = {"title": F.col("title"), "forum_name": F.col("forum"), "forum_id": F.lit(0)}
    columns = []
    for c in own:
        found = F.col(f"_{c}") if c in thread_json.columns else F.lit(None)
        found = F.nullif(found, F.lit("")) if c in ("title", "forum_name") else found
        columns.append(F.coalesce(found, values.get(c, F.lit(None))).cast(target.schema[c].dataType).alias(c))
    for c, value in (("folder_name", F.format_string("[%s吧][%d]%s", "forum", "tid", "title")), ("scrape_status", F.lit(0).cast("int"))):
        if c in target.columns:
            columns.append(value.alias(c))
    return merge_ignore(target, joined.select("archive", "tid", *columns), KEYS["thread"], required=["title"])


def merge_forums(target: DataFrame, source: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    """One row for each archive and forum name.

    Counts are the largest seen and slogan the last non-empty one in order.  A name gets its real id (the
    first positive one) unless another name holds it: the target's holder first, then the
    smallest name.  Names without an id of their own get negative numbers, by name,
    below the target's.
    """
    counts = ["member_num", "post_num", "thread_num"]
    row = F.struct(*([F.col(c) for c in order_by] + [F.col("slogan")]))
    both = target.withColumn("_new", F.lit(0)).unionByName(source.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    at = F.struct("_new", row)
    named = both.groupBy("archive", "forum_name").agg(
        *(F.max(F.coalesce(c, F.lit(0))).alias(c) for c in counts),
        F.coalesce(F.max_by("slogan", F.when(F.coalesce("slogan", F.lit("")) != "", at)), F.lit("")).alias("slogan"),
        F.min_by("forum_id", F.when(F.col("forum_id") > 0, F.struct("_new", "forum_id"))).alias("real"),
        F.min(F.when(F.col("_new") == 0, F.col("forum_id"))).alias("held"),
        F.min("_new").alias("_new"),
    )
    holder = W.partitionBy("archive", "real").orderBy(F.when(F.col("held") == F.col("real"), 0).otherwise(1), "_new", "forum_name")
    owned = named.withColumn("owns", F.col("real").isNotNull() & (F.row_number().over(holder) == 1))
    wants = ~F.col("owns") & ~F.coalesce(F.col("held") < 0, F.lit(False))
    # forums are few: the windows over an archive's names are small
    lowest = F.least(F.min("held").over(W.partitionBy("archive")), F.lit(0))
    number = F.row_number().over(W.partitionBy("archive", wants).orderBy("forum_name"))
    numbered = owned.withColumn("lowest", F.coalesce(lowest, F.lit(0))).withColumn("number", number)
    forum_id = F.when(F.col("owns"), F.col("real")).when(F.col("held") < 0, F.col("held")).otherwise(F.col("lowest") - F.col("number"))
    return numbered.select("archive", forum_id.cast("bigint").alias("forum_id"), "forum_name", *counts, "slogan")


def stub_threads(listing: DataFrame, progress: DataFrame, merged: DataFrame, forum_name: str | None = None, others: DataFrame | None = None) -> DataFrame:
    """Rows for deleted (status 1) and failed (status 2) threads that were never merged.

    An archive without a listing has no stubs.  Titles not listed are [tid=N].  The forum is ``forum_name``, or
    by default the one that most of the archive's merged threads name (ties to the smallest; none: '').  ``others`` (archive, forum_name)
    are further threads that count for the name, where merged is only a part of the archive.
    """
    state = progress.where(F.col("state").isin("deleted", "failed")).groupBy("archive", "tid").agg(F.max(F.col("state") == "deleted").alias("deleted"))
    fresh = state.join(merged.select("archive", "tid"), ["archive", "tid"], "left_anti").join(listing.select("archive").distinct(), "archive", "left_semi")
    meta = first_rows(listing.select("archive", "tid", "title", "author_id", "reply_num", "create_time", "pos"), ["archive", "tid"], ["pos"])
    joined = fresh.join(meta, ["archive", "tid"], "left")
    if forum_name is None:
        named = merged.select("archive", "forum_name")
        named = named if others is None else named.unionByName(others.select("archive", "forum_name"))
        names = named.where("forum_name <> ''").groupBy("archive", "forum_name").agg(F.count("*").alias("n"))
        joined = joined.join(names.groupBy("archive").agg(F.min_by("forum_name", F.struct(-F.col("n"), "forum_name")).alias("_forum")), "archive", "left")
    forum = F.coalesce("_forum", F.lit("")) if forum_name is None else F.lit(forum_name)
    zero = lambda c: F.coalesce(c, F.lit(0))
    title = F.coalesce(F.nullif("title", F.lit("")), F.format_string("[tid=%d]", "tid"))
    return joined.select("archive", "tid", title.alias("title"), forum.alias("forum_name"), zero("author_id").alias("author_user_id"), zero("reply_num").alias("reply_num"), zero("create_time").alias("create_time"), F.when(F.col("deleted"), 1).otherwise(2).alias("scrape_status"))


def refresh_posts(target: DataFrame, snapshot: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """Known posts take only agree, disagree and reply_num (0 for sub-posts) of the snapshot; new posts come whole.

    A key may stand in several rounds of the snapshot, in the order of ``order_by`` (by default that of scraping): the newest round
    gives the counters, and a new post's other columns are those of the first.  Of rows of one round the larger counters win.
    """
    keys, counters = KEYS["post"], ["agree", "disagree", "reply_num"]
    order = scrape_order("post", snapshot.columns) if order_by is None else list(order_by)
    seen = snapshot.where("id > 0")
    newest = seen.groupBy(*keys).agg(F.max(F.struct(*order, *(F.col(c).alias(f"_{c}") for c in counters))).alias("_new"))
    reply = lambda known: F.when(F.col("parent_id") != 0, F.lit(0)).otherwise(F.coalesce("_new._reply_num", known)).cast("bigint")
    values = {c: F.coalesce(f"_new._{c}", c) for c in counters[:2]}
    known = target.join(newest, keys, "left").withColumns(values | {"reply_num": F.when(F.col("_new").isNull(), F.col("reply_num")).otherwise(reply(F.col("reply_num")))})
    fresh = first_rows(seen.join(target.select(*keys), keys, "left_anti"), keys, order).join(newest, keys).withColumns(values | {"reply_num": reply(F.col("reply_num"))})
    return known.select(*target.columns).unionByName(fresh.select(*target.columns))


def pending_threads(threads: DataFrame, merged: DataFrame, media: DataFrame) -> DataFrame:
    """archive and tid of threads that are not merged or whose files are not packed."""
    packed = media.select("archive", F.split_part("path", F.lit("/"), F.lit(1)).try_cast("bigint").alias("tid")).where("tid is not null").distinct()
    all_ = threads.select("archive", "tid").distinct()
    return all_.join(merged.select("archive", "tid"), ["archive", "tid"], "left_anti").union(all_.join(packed, ["archive", "tid"], "left_anti")).distinct()


def archive_summary(threads: DataFrame, posts: DataFrame, users: DataFrame) -> DataFrame:
    """archive, threads by status, posts and users."""
    status = F.coalesce("scrape_status", F.lit(0))
    t = threads.groupBy("archive").agg(F.count("*").alias("threads"), *(F.count_if(status == i).alias(n) for i, n in enumerate(("complete", "deleted", "failed"))))
    p = posts.groupBy("archive").agg(F.count("*").alias("posts"))
    u = users.groupBy("archive").agg(F.count("*").alias("users"))
    return t.join(p, "archive", "left").join(u, "archive", "left").na.fill(0, ["posts", "users"])
