"""Finding incomplete threads, comparing archives with listings, and healing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlake.operators.merge import first_rows, merge_posts
from threadlake.schemas import scrape_order
from threadlake.sources.places import stored

SHORT = 20
#: Floors in a bucket when gaps are found in two steps.
BUCKET = 100_000


def thread_stats(posts: DataFrame, two_step: bool = False) -> DataFrame:
    """archive, tid, floors, comments, max_floor, max_gap.

    max_gap is the longest run of missing numbers between saved floors; one floor has 0, and
    equal floors only have -1.  ``two_step`` finds gaps in buckets of floors and
    then between buckets, for threads too long for one task's window.
    """
    thread = ["archive", "tid"]
    stats = posts.groupBy(*thread).agg(F.count_if(F.col("parent_id") == 0).alias("floors"), F.count_if(F.col("parent_id") != 0).alias("comments"), F.max(F.when(F.col("parent_id") == 0, F.col("floor"))).alias("top"))
    floors = posts.where("parent_id = 0").select(*thread, "floor")
    step = lambda *part: F.col("floor") - F.lag("floor").over(W.partitionBy(*part).orderBy("floor")) - 1
    if two_step:
        inside = floors.withColumn("bucket", F.floor(F.col("floor") / BUCKET)).withColumn("gap", step(*thread, "bucket"))
        buckets = inside.groupBy(*thread, "bucket").agg(F.min("floor").alias("low"), F.max("floor").alias("high"), F.max("gap").alias("gap"))
        between = F.col("low") - F.lag("high").over(W.partitionBy(*thread).orderBy("bucket")) - 1
        gaps = buckets.withColumn("gap", F.greatest("gap", between)).groupBy(*thread).agg(F.max("gap").alias("gap"))
    else:
        gaps = floors.withColumn("gap", step(*thread)).groupBy(*thread).agg(F.max("gap").alias("gap"))
    return stats.join(gaps, thread, "left").select(*thread, "floors", "comments", F.coalesce("top", F.lit(0)).alias("max_floor"), F.coalesce("gap", F.lit(0)).alias("max_gap"))


#: What a thread's saved floors are, as far as an audit needs: sorted runs of consecutive floors, with the number of floors and of sub-posts.
RANGES = "archive string, tid long, floors long, comments long, twice boolean, ranges array<struct<low:long,high:long>>"


def _joined(ranges: Column) -> Column:
    """Sorted ranges with those that touch or overlap as one."""
    one = lambda r, high: F.struct(r["low"].alias("low"), high.alias("high"))
    none = F.array().cast("array<struct<low:bigint,high:bigint>>")

    def step(kept, r):
        last = F.element_at(kept, -1)
        meets = (F.size(kept) > 0) & (r["low"] <= F.try_add(last["high"], F.lit(1)))
        before = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(meets, F.concat(before, F.array(one(last, F.greatest(last["high"], r["high"]))))).otherwise(F.concat(kept, F.array(one(r, r["high"]))))

    return F.aggregate(F.array_sort(ranges), none, step)


def floor_ranges(posts: DataFrame) -> DataFrame:
    """RANGES of each thread of new posts; runs are found within buckets of floors, so a task holds no more than a bucket of a long thread.

    A floor without a number counts as a floor, and isn't in the ranges; ``twice`` says whether a floor number stands there more than once.
    """
    thread = ["archive", "tid"]
    counts = posts.groupBy(*thread).agg(F.count_if(F.col("parent_id") == 0).alias("floors"), F.count_if(F.col("parent_id") != 0).alias("comments"))
    numbers = posts.where("parent_id = 0 and floor is not null").groupBy(*thread, "floor").agg(F.count("*").alias("n"))
    here = W.partitionBy(*thread, "bucket").orderBy("floor")
    # floors less their places are equal within a run
    placed = numbers.withColumn("bucket", F.floor(F.col("floor") / BUCKET)).withColumn("run", F.col("floor") - F.row_number().over(here))
    runs = placed.groupBy(*thread, "bucket", "run").agg(F.min("floor").alias("low"), F.max("floor").alias("high"), F.max(F.col("n") > 1).alias("twice"))
    ranges = runs.groupBy(*thread).agg(F.max("twice").alias("twice"), F.collect_list(F.struct("low", "high")).alias("ranges"))
    none = F.array().cast("array<struct<low:bigint,high:bigint>>")
    return counts.join(ranges, thread, "left").select(*thread, "floors", "comments", F.coalesce("twice", F.lit(False)).alias("twice"), F.coalesce(_joined(F.col("ranges")), none).alias("ranges"))


def merge_ranges(one: DataFrame, other: DataFrame) -> DataFrame:
    """RANGES of the posts of both, which have no post in common; the order of merging doesn't matter."""
    numbers = F.aggregate(F.flatten(F.collect_list("ranges")), F.lit(0).cast("long"), lambda n, r: n + r["high"] - r["low"] + 1)
    both = one.unionByName(other).groupBy("archive", "tid").agg(F.sum("floors").alias("floors"), F.sum("comments").alias("comments"), F.max("twice").alias("twice"), _joined(F.flatten(F.collect_list("ranges"))).alias("ranges"), numbers.alias("_n"))
    shorter = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["high"] - r["low"] + 1) < F.col("_n")
    return both.select("archive", "tid", "floors", "comments", (F.col("twice") | shorter).alias("twice"), "ranges")


def stats_of_ranges(ranges: DataFrame) -> DataFrame:
    """thread_stats from RANGES: gaps lie between them."""
    n = F.size("ranges")
    gaps = F.transform(F.sequence(F.lit(2), n), lambda i: F.element_at("ranges", i)["low"] - F.element_at("ranges", i - 1)["high"] - 1)
    one = F.element_at("ranges", 1)
    # between neighbours is a gap of 0, between equal floors one of -1
    within = F.when(one["low"] < one["high"], 0).when(F.col("twice"), -1).otherwise(0)
    gap = F.when(n > 1, F.array_max(gaps)).when(n == 1, within).otherwise(0)
    return ranges.select("archive", "tid", "floors", "comments", F.when(n > 0, F.element_at("ranges", -1)["high"]).otherwise(0).alias("max_floor"), gap.cast("long").alias("max_gap"))


def audit(threads: DataFrame, posts: DataFrame, gap: int = SHORT, skip_deleted: bool = False, lost_tids: DataFrame | None = None) -> DataFrame:
    """Suspect threads with a reason, most missing first.

    empty: replies but no floor; page-gap(N): N floors missing in a row; short: ``gap`` or more posts
    missing; log-confirmed instead of the two where ``lost_tids`` (archive, tid) has
    evidence; verify-del and retry-failed: status 1 and 2.
    """
    return audit_stats(threads, thread_stats(posts, two_step=True), gap, skip_deleted, lost_tids)


def audit_stats(threads: DataFrame, stats: DataFrame, gap: int = SHORT, skip_deleted: bool = False, lost_tids: DataFrame | None = None) -> DataFrame:
    """As audit, from the threads' statistics (see thread_stats and stats_of_ranges)."""
    joined = threads.join(stats, ["archive", "tid"], "left").na.fill(0, ["floors", "comments", "max_floor", "max_gap"])
    if lost_tids is not None:
        joined = joined.join(lost_tids.select("archive", "tid", F.lit(True).alias("lost")).distinct(), ["archive", "tid"], "left")
    else:
        joined = joined.withColumn("lost", F.lit(None).cast("boolean"))
    status, replies = F.coalesce("scrape_status", F.lit(0)), F.coalesce("reply_num", F.lit(0))
    missing = replies - F.col("floors") - F.col("comments")
    hole = (F.col("max_gap") >= gap) & (missing >= gap)
    kind = F.when(hole, F.format_string("page-gap(%d)", "max_gap")).when(missing >= gap, F.lit("short"))
    open_ = F.when((F.col("floors") == 0) & (replies > 0), "empty").when(kind.isNotNull() & F.col("lost"), "log-confirmed").otherwise(kind)
    reason = F.when(status == 0, open_).when(status == 1, F.lit(None if skip_deleted else "verify-del").cast("string")).when(status == 2, "retry-failed")
    seen = lambda c, *also: F.when(status.isin(0, *also), F.col(c)).otherwise(0).cast("bigint").alias(c)
    left = F.when(status == 1, replies).otherwise(missing)
    found = joined.select("archive", "tid", F.left("title", F.lit(60)).alias("title"), replies.alias("reply_num"), seen("floors", 2), seen("comments", 2), seen("max_floor"), seen("max_gap"), left.alias("missing"), reason.alias("reason"), status.alias("_status"))
    found = found.withColumnsRenamed({"floors": "floors_saved", "comments": "comments_saved"})
    return found.where("reason is not null").orderBy(F.desc("missing"), "_status", "archive", "tid").drop("_status")


def audit_summary(suspects: DataFrame) -> DataFrame:
    return suspects.groupBy("archive", F.regexp_replace("reason", r"\(.*", "").alias("reason")).agg(F.count("*").alias("threads"))


def audit_top(suspects: DataFrame, n: int = 25) -> DataFrame:
    return suspects.orderBy(F.desc("missing"), "archive", "tid").limit(n)


def lost_page_tids(log_lines: DataFrame) -> DataFrame:
    """archive and tid of logs (archive, tid, line) with a page that could not be fetched."""
    line = F.col("line")
    return log_lines.where(line.contains("FetchPosts") & (line.contains("Request failed") | line.contains("Thread unavailable"))).select("archive", "tid").distinct()


def archive_label(threads: DataFrame) -> DataFrame:
    """archive, label, is_collection, sub_forums (sorted; null unless it is a collection)."""
    names = F.array_sort(F.collect_set(F.nullif("forum_name", F.lit(""))))
    many = F.size("names") > 1
    return threads.groupBy("archive").agg(names.alias("names")).select("archive", F.when(F.size("names") == 1, F.col("names")[0]).otherwise(F.col("archive")).alias("label"), many.alias("is_collection"), F.when(many, F.col("names")).alias("sub_forums"))


def prepare_retry(done: DataFrame, progress: DataFrame, suspects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(done, progress) without the suspects, and the sorted list of suspects to fetch again."""
    ids = suspects.select("archive", "tid").distinct()
    return done.join(ids, ["archive", "tid"], "left_anti"), progress.join(ids, ["archive", "tid"], "left_anti"), ids.orderBy("archive", "tid")


def heal(threads: DataFrame, posts: DataFrame, recrawl_posts: DataFrame, suspects: DataFrame, recrawl_threads: DataFrame | None = None, refresh_metadata: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(threads, posts, report) after the fetched rows of suspects filled missing keys.

    Deleted and failed threads that now have fetched posts get status 0.  Of fetched rows of one key the one
    scraped first comes in.  Metadata stay as they were, unless refreshed from ``recrawl_threads``.  The report has archive, added_posts, revived.
    """
    ids = suspects.select("archive", "tid").distinct()
    # threads, posts and the report all need what was fetched, so it is found once
    fetched = stored(recrawl_posts.where("id > 0").join(ids, ["archive", "tid"], "left_semi").select(*posts.columns), "fetched")
    merged = merge_posts(posts, fetched, scrape_order("post", fetched.columns))
    alive = fetched.select("archive", "tid").distinct().withColumn("_alive", F.lit(True))
    marked = threads.join(alive, ["archive", "tid"], "left")
    revived = F.col("_alive") & (F.coalesce("scrape_status", F.lit(0)) != 0)
    healed = marked.withColumn("scrape_status", F.when(revived, 0).otherwise(F.col("scrape_status"))).select(*threads.columns)
    if refresh_metadata and recrawl_threads is not None:
        fresh = first_rows(recrawl_threads, ["archive", "tid"]).select("archive", "tid", *(F.col(c).alias(f"_{c}") for c in ("title", "reply_num")))
        joined = healed.join(fresh, ["archive", "tid"], "left")
        healed = joined.withColumns({c: F.coalesce(f"_{c}", c) for c in ("title", "reply_num")}).select(*threads.columns)
    before = fetched.dropDuplicates(["archive", "tid", "id"]).join(posts.select("archive", "tid", "id"), ["archive", "tid", "id"], "left_anti")
    added = before.groupBy("archive").agg(F.count("*").alias("added_posts"))
    report = marked.groupBy("archive").agg(F.count_if(revived).alias("revived")).join(added, "archive", "left").select("archive", F.coalesce("added_posts", F.lit(0)).alias("added_posts"), "revived")
    return healed, merged, report


def coverage(listing: DataFrame, threads: DataFrame, cutoff: int | Column) -> DataFrame:
    """archive, tid, create_time, and the flags missing, after_cutoff, gone, undated of a fresh listing against an archive.

    Creation times not listed come from the archive.  In scope is what is dated up to the cutoff, or undated and not archived;
    missing is in scope and not archived; gone is archived and no longer listed.
    """
    listed = listing.groupBy("archive", "tid").agg(F.max_by("create_time", "pos").alias("listed_time"), F.lit(True).alias("listed"))
    kept = threads.groupBy("archive", "tid").agg(F.max("create_time").alias("kept_time"), F.lit(True).alias("archived"))
    both = listed.join(kept, ["archive", "tid"], "full_outer")
    time = F.coalesce(F.nullif("listed_time", F.lit(0)), F.nullif("kept_time", F.lit(0)))
    is_listed, archived = F.coalesce("listed", F.lit(False)), F.coalesce("archived", F.lit(False))
    limit = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    dated = time.isNotNull()
    return both.select("archive", "tid", time.alias("create_time"), (is_listed & ~archived & (~dated | (time <= limit))).alias("missing"), F.coalesce(is_listed & (time > limit), F.lit(False)).alias("after_cutoff"), (archived & ~is_listed).alias("gone"), (is_listed & ~dated).alias("undated"))


def coverage_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("archive").agg(*(F.count_if(c).alias(c) for c in ("missing", "after_cutoff", "gone", "undated")))


def infer_cutoff(archive: Column) -> Column:
    """Epoch seconds of the end of the day in the _YYMMDD suffix (session time zone); null without one."""
    part = lambda i: F.nullif(F.regexp_extract(archive, r"_(\d{2})(\d{2})(\d{2})/?$", i), F.lit("")).cast("int")
    return F.unix_seconds(F.try_make_timestamp(years=2000 + part(1), months=part(2), days=part(3), hours=F.lit(23), mins=F.lit(59), secs=F.lit(59)))
