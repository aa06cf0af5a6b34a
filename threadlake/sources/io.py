"""Reading and writing archive tables, JSON documents and per-thread SQLite files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.schemas import DEFAULTS, FORUM_JSON, SCRAPE_INFO_JSON, THREAD_JSON, schema


def conform(df: DataFrame, name: str) -> DataFrame:
    """df with the columns of a table: missing ones are null or their default, others go, types are cast."""
    defaults = DEFAULTS.get(name, {})
    columns = []
    for f in schema(name):
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        if f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]))
        columns.append(c.cast(f.dataType).alias(f.name))
    return df.select(*columns)


def read_table(spark: SparkSession, path: str, name: str, kind: str = "parquet") -> DataFrame:
    """A table of any version, from Parquet or JSON lines; columns never come from inference over JSON."""
    reader = spark.read.option("mergeSchema", "true") if kind == "parquet" else spark.read.schema(schema(name))
    return conform(reader.format(kind).load(path), name)


def write_archive(df: DataFrame, path: str, name: str, buckets: int = 8) -> None:
    """Replaces the partitions of the archives in df and leaves others; large archives get several files."""
    key = "tid" if "tid" in df.columns else df.columns[1]
    spread = conform(df, name).repartition("archive", F.pmod(F.xxhash64(key), F.lit(buckets)))
    spread.sortWithinPartitions("archive", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("archive").parquet(path)


def read_content_dbs(spark: SparkSession, paths: DataFrame, name: str, per_task: int = 200, include_share_origin: bool = False, renames: dict[str, str] | None = None) -> DataFrame:
    """Rows of a table from per-thread SQLite files; paths has archive, tid and path (and is_share_origin, if known).

    Files are read where tasks run, ``per_task`` of them in a task.  Files of shared
    originals are left out unless asked for.  A file without the table gives no rows.  ``renames`` gives
    columns of the files the names of the schema, for instance to the site's own user number, which is site_uid here.
    """
    renames = dict(renames or {})
    fields = schema(name)
    if "is_share_origin" in paths.columns and not include_share_origin:
        paths = paths.where(~F.coalesce("is_share_origin", F.lit(False)))
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(fields)
    convert = {"boolean": bool, "long": int, "integer": int, "double": float}
    kinds = [(f.name, convert.get(f.dataType.typeName(), str)) for f in fields]

    def run(batches):
        import sqlite3

        import pyarrow as pa

        for batch in batches:
            for archive, tid, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    if not db.execute("select 1 from sqlite_master where type = 'table' and name = ?", [name]).fetchone():
                        continue
                    cursor = db.execute(f'select * from "{name}"')
                    names = [renames.get(c[0], c[0]) for c in cursor.description]
                    while rows := cursor.fetchmany(10_000):
                        have = dict(zip(names, zip(*rows, strict=True), strict=True)) | {"archive": [archive] * len(rows), "tid": [tid] * len(rows)}
                        empty = [None] * len(rows)
                        columns = [[None if x is None else kind(x) for x in have.get(c, empty)] for c, kind in kinds]
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, shape, strict=True)], schema=shape)

    n = max(1, -(-paths.count() // per_task))
    return conform(paths.select("archive", "tid", "path").repartition(n, "path").mapInArrow(run, fields), name)


def parse_thread_json(df: DataFrame, col: str = "json") -> DataFrame:
    """df with the thread table's columns from a document, bare or under "thread"; each field has its default."""
    bare, wrapped = F.from_json(col, THREAD_JSON), F.from_json(col, f"thread STRUCT<{THREAD_JSON}>")["thread"]
    pick = lambda k: F.coalesce(wrapped[k], bare[k])
    zero = lambda k: F.coalesce(pick(k), F.lit(0)).alias(k)
    text = lambda k: F.coalesce(pick(k), F.lit("")).alias(k)
    flag = lambda k: F.coalesce(pick(k), F.lit(False)).alias(k)
    vote = F.coalesce(F.get_json_object(col, "$.thread.vote_info"), F.get_json_object(col, "$.vote_info"))
    return df.select(
        *[c for c in df.columns if c != col], zero("id"), text("title"), zero("forum_id"), F.coalesce(F.nullif(pick("forum_name"), F.lit("")), pick("fname"), F.lit("")).alias("forum_name"),
        zero("post_id"), zero("user_id"), zero("type"), flag("is_share"), flag("is_help"), vote.alias("vote_info"), zero("share_origin"), zero("view_num"), zero("reply_num"), zero("share_num"), zero("agree"), zero("disagree"), zero("create_time"), zero("status"),
    )


def parse_forum_json(df: DataFrame, col: str = "json") -> DataFrame:
    """df with forum_id, forum_name, counts and slogan of a document, bare or under "forum"."""
    bare, wrapped = F.from_json(col, FORUM_JSON), F.from_json(col, f"forum STRUCT<{FORUM_JSON}>")["forum"]
    pick = lambda k: F.coalesce(wrapped[k], bare[k])
    zero = lambda k: F.coalesce(pick(k), F.lit(0)).alias(k)
    return df.select(*[c for c in df.columns if c != col], F.coalesce(pick("id"), pick("forum_id"), F.lit(0)).alias("forum_id"), F.coalesce(F.nullif(pick("name"), F.lit("")), pick("forum_name"), F.lit("")).alias("forum_name"), zero("member_num"), zero("post_num"), zero("thread_num"), F.coalesce(pick("slogan"), F.lit("")).alias("slogan"))


def read_thread_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_thread_json(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("json")))


def read_forum_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_forum_json(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("json")))


_ITEM = "STRUCT<tid BIGINT, title STRING, author_id BIGINT, reply_num BIGINT, create_time BIGINT>"


def parse_tid_list(df: DataFrame, col: str = "json") -> DataFrame:
    """Rows (tid, title, author_id, reply_num, create_time, pos) of a listing in any of its four shapes.

    Shapes: a list of objects, a list of numbers, an object with all_tids, a list of one such object.
    """
    rest = [c for c in df.columns if c != col]
    objects = F.from_json(col, f"ARRAY<{_ITEM}>")
    number = lambda ids: F.transform(ids, lambda x: F.struct(x.alias("tid"), F.lit(None).cast("string").alias("title"), *(F.lit(None).cast("bigint").alias(k) for k in ("author_id", "reply_num", "create_time"))))
    inner = F.coalesce(F.get_json_object(col, "$.all_tids"), F.get_json_object(col, "$[0].all_tids"))
    first = F.left(F.ltrim(F.regexp_replace(col, r"^\s*\[", "")), F.lit(1))
    shape = F.when(inner.isNotNull(), number(F.from_json(inner, "ARRAY<BIGINT>"))).when(first == "{", objects).otherwise(number(F.from_json(col, "ARRAY<BIGINT>")))
    return df.select(*rest, F.posexplode(shape).alias("pos", "t")).select(*rest, "t.*", F.col("pos").cast("bigint").alias("pos")).where("tid is not null")


def parse_progress(df: DataFrame, col: str = "json") -> DataFrame:
    """Rows (tid, state, detail): deleted ids and failed ids with their messages."""
    rest = [c for c in df.columns if c != col]
    p = df.withColumn("_p", F.from_json(col, "deleted ARRAY<BIGINT>, failed_details MAP<STRING, STRING>"))
    deleted = p.select(*rest, F.explode("_p.deleted").alias("tid"), F.lit("deleted").alias("state"), F.lit(None).cast("string").alias("detail"))
    failed = p.select(*rest, F.explode("_p.failed_details").alias("k", "detail")).select(*rest, F.col("k").try_cast("bigint").alias("tid"), F.lit("failed").alias("state"), "detail")
    return deleted.unionByName(failed).where("tid is not null")


def parse_scrape_info(df: DataFrame, col: str = "json") -> DataFrame:
    """df with scraper_version, scrape_time and config as stored, and update_time and the last record's config."""
    info = F.from_json(col, SCRAPE_INFO_JSON)
    config = F.coalesce(F.get_json_object(col, "$.config"), F.lit("{}"))
    last = F.get_json_object(F.element_at(F.from_json(F.get_json_object(col, "$.scrape_records"), "ARRAY<STRING>"), -1), "$.scrape_config")
    some = F.coalesce(F.size(info["scrape_records"]), F.lit(0)) > 0
    return df.select(*[c for c in df.columns if c != col], F.coalesce(info["scraper_version"], F.lit("")).alias("scraper_version"), F.coalesce(info["scrape_time"], F.lit(0)).alias("scrape_time"), config.alias("config"), info["update_time"].alias("update_time"), F.when(some, last).alias("last_config"))


def parse_media_index(df: DataFrame, col: str = "json") -> DataFrame:
    """Rows (path, tar, offset, size) of an index; entries without a tar take the index's own."""
    rest = [c for c in df.columns if c != col]
    index = F.from_json(col, "tar_file STRING, files MAP<STRING, STRUCT<tar STRING, offset BIGINT, size BIGINT>>")
    return df.withColumn("_i", index).select(*rest, F.explode("_i.files").alias("path", "e"), "_i.tar_file").select(*rest, "path", F.coalesce("e.tar", "tar_file").alias("tar"), "e.offset", "e.size")


#: Entries of a part of a media index, about.
INDEX_PART = 50_000


def build_media_index(files: DataFrame, entries: int = INDEX_PART) -> DataFrame:
    """archive, part and the part's index as JSON, version 2, entries by path.

    Each part is a valid index of some of the archive's files; an archive of ``entries`` files or fewer has one
    part, so no row holds the index of a large archive.  Paths are spread over parts by their hash.
    """
    parts = files.groupBy("archive").agg(F.ceil(F.count("*") / entries).alias("parts"))
    dealt = files.join(parts, "archive").withColumn("part", F.pmod(F.xxhash64("path"), "parts").cast("int"))
    entry = F.struct(F.col("path"), F.struct("tar", "offset", "size"))
    grouped = dealt.groupBy("archive", "part").agg(F.array_sort(F.collect_set("tar")).alias("tars"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("files"))
    return grouped.select("archive", "part", F.to_json(F.struct(F.lit(2).alias("version"), "tars", "files")).alias("json"))
