"""Work planning: which threads and pages are still to be fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlake.operators.merge import first_rows
from threadlake.sources.places import stored


def plan_crawl(all_tids: DataFrame, done: DataFrame, deleted: DataFrame, failed: DataFrame) -> DataFrame:
    """archive, tid, pos, is_retry of open threads: fresh ones first, then earlier failures, each in list order."""
    key = ["archive", "tid"]
    listed = first_rows(all_tids.select(*key, "pos"), key, ["pos"])
    over = done.select(*key).union(deleted.select(*key))
    open_ = listed.join(over, key, "left_anti")
    retried = open_.join(failed.select(*key, F.lit(True).alias("_r")).distinct(), key, "left")
    return retried.select(*key, "pos", F.coalesce("_r", F.lit(False)).alias("is_retry")).orderBy("archive", "is_retry", "pos")


def completed_tids(posts: DataFrame) -> DataFrame:
    """archive, tid, posts of threads with a saved post."""
    return posts.groupBy("archive", "tid").agg(F.count("*").alias("posts"))


def build_listing(pages: DataFrame) -> DataFrame:
    """Listing rows of pages (archive, page, pos, tid, create_time): the oldest page's entry of a thread wins.

    pos is the place by creation time, ties in visiting order (highest page first).
    """
    first = pages.withColumn("_visit", -F.col("page"))
    first = first_rows(first, ["archive", "tid"], ["_visit", "pos"])
    return numbered(first.withColumnRenamed("pos", "_pos"), "archive", ["create_time", "_visit", "_pos", "tid"], "pos").drop("_visit", "_pos", "page").select(*(c for c in pages.columns if c != "page"))


def numbered(df: DataFrame, group: str | list[str], order: list[str], name: str) -> DataFrame:
    """df with the place of each row, from 0, in its group; ``order`` must be total.

    Rows are cut into ranges by group and order; places come from those within a range and the sizes of the ranges before it, so
    a group of any size is spread over tasks.
    """
    group = [group] if isinstance(group, str) else group
    ranges = stored(df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(*group, "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy(*group, "_range").orderBy(*order)) - 1
    return ranges.withColumn("_within", within).join(sizes, [*group, "_range"]).withColumn(name, (F.col("_before") + F.col("_within")).cast("bigint")).drop("_range", "_within", "_before")


def user_tids(replies: DataFrame, threads: DataFrame) -> DataFrame:
    return replies.select("archive", "tid").union(threads.select("archive", "tid")).distinct().orderBy("archive", "tid")


def missing_pages(pages: DataFrame) -> DataFrame:
    """archive, tid, page of pages 1 to total that are not done.

    pages: archive, tid, page, total, posts (null: not fetched).  An empty page counts as done only if it is the last one.
    """
    thread = ["archive", "tid"]
    wanted = pages.groupBy(*thread).agg(F.max("total").alias("total")).where("total > 0").select(*thread, "total", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("total"))).alias("page"))
    done = pages.where("posts > 0 or (posts = 0 and page = total)").select(*thread, "page").distinct()
    return wanted.join(done, [*thread, "page"], "left_anti").select(*thread, "page")
