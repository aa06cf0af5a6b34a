"""Whole jobs: consolidating archives, into plain folders or by runs over buckets, and audit with healing."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.operators import audit as A
from threadlake.operators import merge as M
from threadlake.operators import search as X
from threadlake.schemas import KEYS, scrape_order
from threadlake.sources import io as IO
from threadlake.sources.places import stored
from threadlake.sources.runs import Store

#: Tables that a source or a target may have.
TABLES = ("thread", "post", "user", "forum", "media_source", "scrape_batch", "user_info_history")

def consolidate(source: dict[str, DataFrame], target: dict[str, DataFrame], forum_name: str | None = None, others: DataFrame | None = None) -> dict[str, DataFrame]:
    """The target's tables with what the source has and they lack, and search_index and summary.

    source: folders (archive, tid, forum, title), thread, post, user, and if there are any forum, media_source,
    scrape_batch, user_info_history, listing and progress.  Of rows that repeat a key the one scraped
    first wins (see SCRAPED).  ``others`` are threads beside the target that count for the name of stubs' forums.  Post, user and batch rows
    are all keyed by thread, so one hash partitioning by thread can serve them.
    """
    out = {"thread": M.merge_threads(source["folders"], source["thread"], target["thread"])}
    for name, merge in (("post", M.merge_posts), ("user", M.merge_users), ("forum", M.merge_forums), ("media_source", M.merge_media_sources), ("scrape_batch", M.merge_batches)):
        if name in source:
            out[name] = merge(target[name] if name in target else source[name].limit(0), source[name], scrape_order(name, source[name].columns))
        elif name in target:
            out[name] = target[name]
    if "user_info_history" in source:
        history = source["user_info_history"]
        out["user_info_history"] = M.append_user_history(target.get("user_info_history", history.limit(0)), history)
    elif "user_info_history" in target:
        out["user_info_history"] = target["user_info_history"]
    if "listing" in source and "progress" in source:
        stubs = M.stub_threads(source["listing"], source["progress"], out["thread"], forum_name, others)
        out["thread"] = M.merge_ignore(out["thread"], stubs, KEYS["thread"])
    out["search_index"] = X.build_search_index(out["post"])
    out["summary"] = M.archive_summary(out["thread"], out["post"], out["user"])
    return out


def _there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _source(spark: SparkSession, source_dir: str) -> dict[str, DataFrame]:
    """The tables of a source folder, and the folders of its threads."""
    source = {n: IO.read_table(spark, f"{source_dir}/{n}", n) for n in TABLES if _there(spark, f"{source_dir}/{n}")}
    source |= {n: spark.read.parquet(f"{source_dir}/{n}") for n in ("listing", "progress") if _there(spark, f"{source_dir}/{n}")}
    return source | {"folders": source["thread"].select("archive", "tid", F.col("forum_name").alias("forum"), "title")}


def consolidate_tables(spark: SparkSession, source_dir: str, target_dir: str, staging_dir: str, forum_name: str | None = None) -> list[str]:
    """consolidate over Parquet folders, one for each table; archives that the source touches are rewritten.

    The source has thread, post and user, and what there is of forum, media_source, scrape_batch, user_info_history,
    listing and progress; the target may lack any.  Written are all merged tables, search_index, summary, and
    merge_progress (the threads that are merged).  Results are staged first, in a new folder below ``staging_dir``, as a folder that is being read can't be overwritten.
    Returns the names of the tables written.  A run that is killed may leave some tables written; consolidate_run has no such state.
    """
    source, staging = _source(spark, source_dir), f"{staging_dir}/{uuid.uuid4().hex}"
    target = {n: IO.read_table(spark, f"{target_dir}/{n}", n) if _there(spark, f"{target_dir}/{n}") else source[n].limit(0) for n in TABLES if n in source or _there(spark, f"{target_dir}/{n}")}
    touched = stored(reduce(DataFrame.union, (source[n].select("archive") for n in source)).distinct(), "touched")
    merged = consolidate(source, target, forum_name)
    known = {n: df for n, df in merged.items() if n in TABLES}
    for n, df in known.items():
        IO.write_archive(df.join(touched, "archive", "left_semi"), f"{staging}/{n}", n)
    for n in known:
        IO.write_archive(IO.read_table(spark, f"{staging}/{n}", n).join(touched, "archive", "left_semi"), f"{target_dir}/{n}", n)
    now = {n: IO.read_table(spark, f"{target_dir}/{n}", n) for n in known}
    done = now["thread"].where("scrape_status = 0").select("archive", "tid", "forum_name", F.unix_timestamp().alias("merged_at"))
    derived = {"search_index": X.build_search_index(now["post"]), "summary": M.archive_summary(now["thread"], now["post"], now["user"]), "merge_progress": done}
    for n, df in derived.items():
        df.write.mode("overwrite").parquet(f"{target_dir}/{n}")
    return [*known, *derived]


def _write(store: Store, tables: dict[str, DataFrame], touched: list[int], forums: list[int], done: DataFrame | None) -> int:
    """Commits a run that replaces the touched buckets of tables (those of archives for forums), and of what is derived from them.

    done are the threads whose progress is to be marked.
    """
    run = store.begin()
    now = {n: run.write(n, IO.conform(df, n), forums if n == "forum" else touched) for n, df in tables.items()}
    part = lambda n: now[n] if n in now else store.read(n, touched, run.base)
    thread, post, user = part("thread"), part("post"), part("user")
    if done is not None:
        fresh = done.select("archive", "tid", "forum_name", F.unix_timestamp().alias("merged_at"))
        old = store.read("merge_progress", touched, run.base)
        run.write("merge_progress", fresh if old is None else M.merge_ignore(old, fresh, KEYS["merge_progress"]), touched)
    if post is not None and "post" in now:
        run.write("search_index", X.build_search_index(post), touched)
        known, old = store.read("floor_ranges", touched, run.base), store.read("post", touched, run.base)
        fresh = post if old is None else post.join(old.select(*KEYS["post"]), KEYS["post"], "left_anti")  # merging only adds posts
        ranges = A.floor_ranges(fresh)
        run.write("floor_ranges", ranges if known is None else A.merge_ranges(known, ranges), touched)
    if thread is not None and post is not None and user is not None:
        # a row for each archive and bucket; totals are sums
        cut = lambda df: df.withColumn("archive", F.struct("archive", store.bucket(df, run.base).alias("bucket")))
        counts = M.archive_summary(cut(thread), cut(post), cut(user))
        # the bucket of a row of counts is that of its threads, so one of them stands for all
        one = cut(thread).groupBy("archive").agg(F.min("tid").alias("tid"))
        run.write("summary", counts.join(one, "archive").withColumn("archive", F.col("archive.archive")), touched)
    return run.commit()


def consolidate_run(spark: SparkSession, source_dir: str, store: Store, forum_name: str | None = None, resume: bool = True) -> int | None:
    """consolidate into a store of bucketed tables, as one run; the number of the run, None if there was nothing to do.

    Only buckets of threads that the source has are read and written.  With ``resume`` threads whose merge is marked as done are left
    alone, unless the store has a media table that lacks their files (see pending_threads); without it all of the source is merged again, which
    adds what is new.  The store has the tables of the source, merge_progress, search_index, floor_ranges (see audit_store), and summary (see archive_totals).  Several sources may be
    consolidated one after the other, in any number of runs; a run that is killed changes nothing.
    """
    source, m = _source(spark, source_dir), store.manifest()
    marked, media = store.read("merge_progress", manifest=m), store.read("media", manifest=m)
    if resume and marked is not None:
        threads = source["thread"].select("archive", "tid")
        keys = ["archive", "tid"]
        pending = threads.join(marked, keys, "left_anti") if media is None else M.pending_threads(threads, marked, media)
        pending = stored(pending.select(*keys).distinct(), "pending")
        source = {n: df.join(pending, keys, "left_semi").select(*df.columns) if "tid" in df.columns and n not in ("listing", "progress") else df for n, df in source.items()}
        if "progress" in source and (known := store.read("thread", manifest=m)) is not None:
            source["progress"] = source["progress"].join(known.select(*keys), keys, "left_anti")
    by_thread = [df for n, df in source.items() if n not in ("forum", "listing")]
    touched, forums = store.touched(*by_thread), store.touched(source["forum"]) if "forum" in source else []
    if not touched:
        return None
    target = {}
    for n in TABLES:
        have = store.read(n, forums if n == "forum" else touched, m)
        if have is not None or n in source:
            target[n] = have if have is not None else source[n].limit(0)
    others = store.read("thread", [b for b in range(m["buckets"]) if b not in touched], m)
    merged = consolidate(source, target, forum_name, others)
    tables = {n: df for n, df in merged.items() if n in source and n in TABLES}
    return _write(store, tables, touched, forums, source["thread"].select("archive", "tid", "forum_name").distinct())


def heal_run(store: Store, recrawl_posts: DataFrame, gap: int = A.SHORT) -> DataFrame:
    """Fills suspect threads of a store from re-crawled posts, as one run over the buckets that those touch; returns heal's report."""
    m = store.manifest()
    touched = store.touched(recrawl_posts)
    threads, posts = store.read("thread", touched, m), store.read("post", touched, m)
    suspects = stored(A.audit(threads, posts, gap), "suspects")
    healed, merged, report = A.heal(threads, posts, IO.conform(recrawl_posts, "post"), suspects)
    report = stored(report, "report")
    _write(store, {"thread": healed, "post": merged}, touched, [], None)
    return report


def audit_store(store: Store, gap: int = A.SHORT, skip_deleted: bool = False, lost_tids: DataFrame | None = None) -> DataFrame:
    """audit of a store's threads from the ranges of floors that its runs keep; no post is read."""
    m = store.manifest()
    return A.audit_stats(store.read("thread", manifest=m), A.stats_of_ranges(store.read("floor_ranges", manifest=m)), gap, skip_deleted, lost_tids)


def archive_totals(store: Store) -> DataFrame:
    """The summary of each archive, from the counts that each run keeps for its buckets."""
    sums = ("threads", "complete", "deleted", "failed", "posts", "users")
    return store.read("summary").groupBy("archive").agg(*(F.sum(c).alias(c) for c in sums))


def audit_and_heal(threads: DataFrame, posts: DataFrame, recrawl_posts: DataFrame, gap: int = A.SHORT) -> dict[str, DataFrame]:
    """suspects, the healed threads and posts, a report, and the suspects that are left."""
    suspects = stored(A.audit(threads, posts, gap), "suspects")  # each of the next steps reads them
    healed, merged, report = A.heal(threads, posts, recrawl_posts, suspects)
    return {"suspects": suspects, "thread": healed, "post": merged, "report": report, "left": A.audit(healed, merged, gap)}
