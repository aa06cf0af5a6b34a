"""Structured Streaming forms: incremental merge, stateful first-wins, goodput and activity sessions."""

from __future__ import annotations

import datetime
import hashlib
import math

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from threadlake.operators.merge import first_rows
from threadlake.schemas import KEYS, REQUIRED, schema, scrape_order
from threadlake.sources.io import conform
from threadlake.sources.runs import Store


def stream_merge(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, name: str = "post", buckets: int = 64) -> None:
    """Merges newly arrived Parquet files of a table into the store in out_dir and returns when all are merged.

    Known keys are ignored; of a batch's rows of one key the one scraped first comes in.  A batch is a run of the store: it reads the keys of the
    buckets that its rows fall into, and of those, for posts, only files with ids in the range of the batch's; it appends a folder to those buckets, which are
    written anew when they have many.  The run's manifest holds the batch's number, so a batch that runs again changes nothing.
    """
    keys, required = KEYS[name], REQUIRED.get(name, [])
    store = Store(spark, out_dir, buckets)
    mark = f"stream-{hashlib.md5(checkpoint.encode()).hexdigest()}"

    def one(batch: DataFrame, batch_id: int) -> None:
        m = store.manifest()
        if m["marks"].get(mark, -1) >= batch_id:
            return
        source = conform(batch, name).dropna(subset=[*dict.fromkeys([*keys, *required])])
        source = (source.where("id > 0") if name == "post" else source).persist()
        try:
            known, run = store.read(name, store.touched(source), m), store.begin()
            if known is not None:
                if "id" in keys:
                    ends = source.agg(F.min("id"), F.max("id")).first()
                    known = known.where(F.col("id").between(*ends)) if ends[0] is not None else known.limit(0)
                fresh = source.join(known.select(*keys), keys, "left_anti")
            else:
                fresh = source
            run.append(name, first_rows(fresh, keys, scrape_order(name, source.columns)).select(*schema(name).fieldNames()))
            run.commit(**{mark: batch_id})
        finally:
            source.unpersist()

    stream = spark.readStream.schema(schema(name)).parquet(in_dir)
    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_merged(spark: SparkSession, out_dir: str, name: str = "post") -> DataFrame:
    """The rows that are merged so far."""
    rows = Store(spark, out_dir).read(name)
    return spark.createDataFrame([], schema(name)) if rows is None else rows


def stream_dedupe(df: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark's delay."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


class _First(StatefulProcessor):
    """Keeps a key's rows until the watermark has passed the end of their window, then gives the first of each window."""

    def __init__(self, shape: StructType, ts: str, delay: float, order: list[str]):
        self.shape, self.ts, self.delay, self.order = shape, ts, datetime.timedelta(seconds=delay), [*order, *(c for c in sorted(shape.names) if c not in order)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.rows = handle, handle.getListState("rows", self.shape)

    def _place(self, row) -> tuple:
        # null first, as in a sort
        return tuple((row[c] is not None, row[c]) for c in self.order)

    def _wait(self, rows: list) -> None:
        end = min(r[self.ts] for r in rows) + self.delay
        self.handle.registerTimer(int(end.timestamp() * 1000) + 1)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        new = [r for r in rows if r[self.ts] is not None]
        if new:
            self.rows.appendList([tuple(r[c] for c in self.shape.names) for r in new])
            self._wait(new)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        have = sorted((Row(**dict(zip(self.shape.names, r, strict=True))) for r in self.rows.get()), key=lambda r: r[self.ts])
        now, out = timerValues.getCurrentWatermarkInMs(), []
        while have and int((have[0][self.ts] + self.delay).timestamp() * 1000) + 1 <= now:
            inside = [r for r in have if r[self.ts] <= have[0][self.ts] + self.delay]
            out.append(min(inside, key=self._place))
            have = have[len(inside) :]
        self.rows.clear()
        if have:
            self.rows.put([tuple(r) for r in have])
            self._wait(have)
        return iter(out)

    def close(self) -> None:
        pass


def stream_first(df: DataFrame, keys: list[str], ts: str, delay_seconds: int, order_by: list[str] | None = None) -> DataFrame:
    """The first row of each key and window by ``order_by`` (by default the time), then by all other columns, as a stream.

    A key's first window begins with its earliest row and lasts ``delay_seconds``, the next one begins with its earliest row after that.  A row comes
    out when the watermark, which is ``delay_seconds`` behind the latest time seen, has passed the end of its window; the window's rows
    then leave the state.  So the result doesn't depend on how the rows are cut into batches, as long as no row is later than the
    watermark; those are dropped.  Rows without a key have nulls in it, which count as equal; rows without a time are left out.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # keyed state with timers needs it
    seen = df.withWatermark(ts, f"{delay_seconds} seconds")
    return seen.groupBy(*keys).transformWithState(statefulProcessor=_First(df.schema, ts, delay_seconds, order_by or [ts]), outputStructType=df.schema, outputMode="Append", timeMode="EventTime")


def goodput(events: DataFrame, window: str = "90 seconds", ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """start, finished, per_hour of tumbling windows; works on streams and on tables."""
    source = events.withWatermark(ts, delay) if events.isStreaming else events
    seconds = F.unix_timestamp(F.col("w.end").cast("timestamp")) - F.unix_timestamp(F.col("w.start").cast("timestamp"))
    return source.groupBy(F.window(ts, window).alias("w")).agg(F.count("*").alias("finished")).select(F.col("w.start").alias("start"), "finished", (F.col("finished") * 3600.0 / seconds).alias("per_hour"))


#: Windows of a block; a carry joins the blocks of a group.
BLOCK = 960


def smoothed_goodput(events: DataFrame, window: str = "90 seconds", alpha: float = 0.5, ts: str = "ts", group: str | None = None) -> DataFrame:
    """goodput of a table with the moving average ewma and the relative change to the average before.

    The average starts with the first window's rate, for each ``group`` or for all together.  It has two steps: windows are
    averaged within blocks of time, and the few rows of blocks hand their averages on.  Sums reach back as far as weights
    matter in double precision.
    """
    keys = [group] if group else []
    counted = events.groupBy(*keys, F.window(ts, window).alias("w")).agg(F.count("*").alias("finished"))
    seconds = F.unix_timestamp(F.col("w.end").cast("timestamp")) - F.unix_timestamp(F.col("w.start").cast("timestamp"))
    block = F.floor(F.unix_timestamp(F.col("w.start").cast("timestamp")) / (seconds * BLOCK))
    counted = counted.select(*keys, F.col("w.start").alias("start"), "finished", (F.col("finished") * 3600.0 / seconds).alias("per_hour"), block.alias("block"))
    keep, far = 1 - alpha, 0 if alpha == 1 else int(-60 * math.log(2) / math.log(1 - alpha))
    here = W.partitionBy(*keys, "block").orderBy("start")
    fold = lambda xs, step: F.aggregate(xs, F.lit(0.0), step)
    # what the block's own windows give, without a carry, and how much of a carry is left
    own = fold(F.collect_list("per_hour").over(here.rowsBetween(-far, 0)), lambda acc, x: keep * acc + alpha * x)
    inside = counted.withColumn("_own", own).withColumn("_left", F.pow(F.lit(keep), F.row_number().over(here)))
    blocks = inside.groupBy(*keys, "block").agg(F.max_by(F.struct("_own", "_left"), "start").alias("end"), F.min_by("per_hour", "start").alias("first"))
    order = W.partitionBy(*keys).orderBy("block")
    start = F.first("first").over(order.rowsBetween(W.unboundedPreceding, 0))
    ends = F.collect_list("end").over(order.rowsBetween(-far - 1, -1))
    # with the first rate as carry into the first block, the average starts with it
    carry = F.aggregate(ends, start, lambda acc, e: e["_own"] + e["_left"] * acc)
    blocks = blocks.select(*keys, "block", carry.alias("_carry"), (F.row_number().over(order) == 1).alias("_begins"))
    both = inside.join(blocks, [*keys, "block"]).withColumn("ewma", F.col("_own") + F.col("_left") * F.col("_carry"))
    was = F.coalesce(F.lag("ewma").over(here), F.when(~F.col("_begins"), F.col("_carry")))
    both = both.withColumn("_was", was)
    return both.select(*keys, "start", "finished", "per_hour", "ewma", F.when(F.col("_was") > 0, (F.col("ewma") - F.col("_was")) / F.col("_was")).alias("change"))


def activity_sessions(events: DataFrame, gap: str = "360 seconds", key: str = "tid", ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """key, start, end, events of runs of activity without a silence longer than gap."""
    source = events.withWatermark(ts, delay) if events.isStreaming else events
    return source.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def activity_sessions_batch(events: DataFrame, seconds: int = 360, key: str = "tid", ts: str = "ts") -> DataFrame:
    """As activity_sessions, for tables, with the last event's time as end; events without a time are left out.

    Events within one span of the gap's length belong together, so they are counted before the shuffle; a window then joins
    spans, of which a key has no more than its time has, however many events it has.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    spans = events.where(F.col(ts).isNotNull()).groupBy(key, (micros(ts) - F.pmod(micros(ts), F.lit(seconds * 1_000_000))).alias("_span")).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("events"))
    order = W.partitionBy(key).orderBy("_span")
    silence = micros("start") - F.unix_micros(F.lag("end").over(order).cast("timestamp"))
    began = F.coalesce(silence > seconds * 1_000_000, F.lit(True))
    marked = spans.withColumn("_s", F.sum(began.cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return marked.groupBy(key, "_s").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("events").alias("events")).drop("_s")
