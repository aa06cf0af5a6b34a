"""Media indexes of archives: building, comparing, de-duplicating and resolving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlake.functions.scalars import asset_identity


def files_map(members: DataFrame) -> DataFrame:
    """One entry for each path: of several tars the last by name wins, in a tar the last member."""
    last = F.struct("tar", "offset", "size")
    return members.groupBy("archive", F.col("name").alias("path")).agg(F.max(last).alias("m"), F.count("*").alias("copies")).select("archive", "path", "m.tar", "m.offset", "m.size", "copies")


def collisions(files: DataFrame) -> DataFrame:
    return files.groupBy("archive").agg(F.count("*").alias("paths"), F.sum(F.col("copies") - 1).alias("collisions"))


def tar_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("archive", "tar").agg(F.count("*").alias("entries"))


def primary_tar(files: DataFrame) -> DataFrame:
    """archive and the tar with most entries, ties to the smallest name."""
    best = F.min_by("tar", F.struct(-F.col("entries"), F.col("tar")))
    return tar_counts(files).groupBy("archive").agg(best.alias("tar"), F.max("entries").alias("entries"))


def diff_index(old: DataFrame, new: DataFrame, declared_tar: str) -> DataFrame:
    """archive and counts of an index against a rebuilt one.

    missing_now, added_now, stale_offset, and other_tar: right offset, but in another tar than
    the old entry's, or the declared one where it names none.
    """
    o = old.select("archive", "path", F.coalesce("tar", F.lit(declared_tar)).alias("o_tar"), F.col("offset").alias("o_offset"), F.lit(True).alias("o"))
    n = new.select("archive", "path", F.col("tar").alias("n_tar"), F.col("offset").alias("n_offset"), F.lit(True).alias("n"))
    both = F.col("o") & F.col("n")
    same = F.col("o_offset").eqNullSafe(F.col("n_offset"))
    return o.join(n, ["archive", "path"], "full_outer").groupBy("archive").agg(F.count_if(F.col("n").isNull()).alias("missing_now"), F.count_if(F.col("o").isNull()).alias("added_now"), F.count_if(both & ~same).alias("stale_offset"), F.count_if(both & same & (F.col("o_tar") != F.col("n_tar"))).alias("other_tar"))


def dedupe_assets(assets: DataFrame) -> DataFrame:
    """assets (archive, path, tar, offset, size, seq) with stored_tar, stored_offset and is_reused.

    A file of the size of its identity's first one points at that; any other size is stored.
    """
    order = W.partitionBy("archive", "identity").orderBy("seq", "path").rowsBetween(W.unboundedPreceding, W.currentRow)
    with_first = assets.withColumn("identity", asset_identity(F.col("path"))).withColumn("f", F.first(F.struct("tar", "offset", "size", "seq", "path")).over(order))
    reused = (F.col("size") == F.col("f.size")) & ~((F.col("seq") == F.col("f.seq")) & (F.col("path") == F.col("f.path")))
    return with_first.select(*assets.columns, "identity", F.when(reused, F.col("f.tar")).otherwise(F.col("tar")).alias("stored_tar"), F.when(reused, F.col("f.offset")).otherwise(F.col("offset")).alias("stored_offset"), F.coalesce(reused, F.lit(False)).alias("is_reused"))


def resolve_media(frags: DataFrame, media: DataFrame) -> DataFrame:
    """archive, tid, post_id, idx, kind, filename, path of image, video and voice files and covers; null path if not found.

    media paths begin with the thread; a file is found by its own name there.
    """
    named = frags.where(F.col("type").isin(3, 7, 8)).select("archive", "tid", "post_id", "idx", F.explode(F.array(F.struct(F.lit("file").alias("kind"), F.col("filename").alias("filename")), F.struct(F.lit("cover").alias("kind"), F.col("cover_filename").alias("filename")))).alias("f")).select("archive", "tid", "post_id", "idx", "f.*").where("filename <> ''")
    there = media.select("archive", F.split_part("path", F.lit("/"), F.lit(1)).try_cast("bigint").alias("tid"), F.substring_index("path", "/", -1).alias("filename"), "path").groupBy("archive", "tid", "filename").agg(F.min("path").alias("path"))
    return named.join(there, ["archive", "tid", "filename"], "left").select("archive", "tid", "post_id", "idx", "kind", "filename", "path")


def resolve_avatars(users: DataFrame, media: DataFrame) -> DataFrame:
    """archive, tid, portrait, path of avatars that the archive holds."""
    wanted = users.where("avatar <> ''").select("archive", "tid", "portrait", F.concat_ws("/", F.col("tid").cast("string"), F.lit("user_avatar"), "avatar").alias("path"))
    return wanted.join(media.select("archive", "path").distinct(), ["archive", "path"], "left_semi").select("archive", "tid", "portrait", "path")


def duplicate_files(files: DataFrame) -> DataFrame:
    """files (archive, tid, kind, path, size, content, is_target) that repeat another's bytes, with the path that stays.

    Only files of a size that occurs twice in a thread and kind are hashed.  The
    target's file stays, then the smallest path.
    """
    same = ["archive", "tid", "kind"]
    sizes = files.groupBy(*same, "size").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    hashed = files.join(sizes, [*same, "size"], "left_semi").select(*same, "path", F.md5("content").alias("hash"), F.coalesce("is_target", F.lit(False)).alias("is_target"))
    stays = F.first("path").over(W.partitionBy(*same, "hash").orderBy(F.desc("is_target"), "path"))
    return hashed.withColumn("keep_path", stays).where("path <> keep_path").select(*same, "path", "hash", "keep_path")


def verify_index(index: DataFrame, members: DataFrame, n: int = 40) -> DataFrame:
    """n entries of each index, by hashed path, with ok if a real member has their tar, offset, name and size."""
    order = W.partitionBy("archive").orderBy(F.md5("path"), "path")
    # the window keeps n rows of each archive and partition before it shuffles
    sample = index.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")
    real = members.select("archive", "tar", "offset", F.col("name").alias("path"), "size", F.lit(True).alias("_ok")).distinct()
    return sample.join(real, ["archive", "tar", "offset", "path", "size"], "left").select("archive", "path", "tar", "offset", "size", F.coalesce("_ok", F.lit(False)).alias("ok"))


def media_counts(media: DataFrame) -> DataFrame:
    """archive, tid (null: none in the path), files, bytes."""
    return media.groupBy("archive", F.split_part("path", F.lit("/"), F.lit(1)).try_cast("bigint").alias("tid")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
