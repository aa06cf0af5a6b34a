"""Comparing tables by sums of row hashes, so that only what differs is joined, and sketches of distinct users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.operators.media import diff_index
from threadlake.sources.places import stored

#: Parts of a table that have a digest each; bounds what a comparison broadcasts.
LEAVES = 65_536


def leaf_digests(df: DataFrame, keys: list[str], leaves: int = LEAVES) -> DataFrame:
    """leaf, rows, total, mixed of the rows whose keys hash to the leaf; sums, so digests of parts of a table add up."""
    row = F.xxhash64(F.lit(1), *[F.struct(F.col(c).isNull(), c) for c in sorted(df.columns)])
    other = F.xxhash64(F.lit(2), *[F.struct(F.col(c).isNull(), c) for c in sorted(df.columns)])
    hashed = df.select(F.pmod(F.xxhash64(*keys), F.lit(leaves)).cast("int").alias("leaf"), row.alias("a"), other.alias("b"))
    return hashed.groupBy("leaf").agg(F.count("*").alias("rows"), F.sum(F.col("a").cast("decimal(20,0)")).alias("total"), F.bit_xor("b").alias("mixed"))


def add_digests(*parts: DataFrame) -> DataFrame:
    """The digests of the tables' union."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("leaf").agg(F.sum("rows").alias("rows"), F.sum("total").cast("decimal(30,0)").alias("total"), F.bit_xor("mixed").alias("mixed"))


def differing_leaves(old: DataFrame, new: DataFrame) -> DataFrame:
    """leaf of the digests that are not the same in both; written, as two tables are cut by it."""
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("rows", "total", "mixed")]
    joined = old.alias("o").join(new.alias("n"), F.col("o.leaf") == F.col("n.leaf"), "full_outer")
    return stored(joined.where(~(same[0] & same[1] & same[2])).select(F.coalesce("o.leaf", "n.leaf").alias("leaf")), "leaves")


def only_differing(old: DataFrame, new: DataFrame, keys: list[str], leaves: int = LEAVES, digests: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables without the leaves that are equal in both; columns must have the same names and types.

    A key's rows lie in one leaf, so a join on the keys finds all differences in what is left.  Digests that were
    kept may be given; else both tables are read for them, but only sums are shuffled.  At most ``leaves`` numbers are broadcast.
    Two different leaves pass as equal with the chance that two independent 64-bit hashes agree.
    """
    o, n = digests or (leaf_digests(old, keys, leaves), leaf_digests(new, keys, leaves))
    wrong = F.broadcast(differing_leaves(o, n))
    cut = lambda df: df.withColumn("leaf", F.pmod(F.xxhash64(*keys), F.lit(leaves)).cast("int")).join(wrong, "leaf", "left_semi").drop("leaf")
    return cut(old), cut(new)


def diff_index_by_digest(old: DataFrame, new: DataFrame, declared_tar: str, leaves: int = LEAVES) -> DataFrame:
    """As diff_index, for indexes whose paths are unique in an archive: only leaves with a difference are joined."""
    shape = lambda df, tar: df.select("archive", "path", tar.alias("tar"), F.col("offset").cast("bigint").alias("offset"))
    o, n = shape(old, F.coalesce("tar", F.lit(declared_tar))), shape(new, F.col("tar"))
    found = diff_index(*only_differing(o, n, ["archive", "path"], leaves), declared_tar)
    archives = o.select("archive").union(n.select("archive")).distinct()
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in found.columns if c != "archive"]
    return archives.join(found, "archive", "left").select("archive", *counts)


# --- distinct users ------------------------------------------------------------------

#: Base-2 logarithm of a sketch's cells; the standard error is about 0.8 / sqrt(2 ** LG_CELLS), less than 0.7 %.
LG_CELLS = 14


def user_sketches(users: DataFrame, lg_cells: int = LG_CELLS) -> DataFrame:
    """archive, day, people: a sketch of the distinct portraits scraped on a day (null: unknown) of UTC."""
    day = F.date_from_unix_date((F.floor(F.col("scrape_time") / 86_400)).cast("int"))
    return users.where("portrait is not null").groupBy("archive", day.alias("day")).agg(F.hll_sketch_agg("portrait", lg_cells).alias("people"))


def unite_sketches(*parts: DataFrame) -> DataFrame:
    """One row for each archive and day of several tables of sketches; repeated users count once, so a second run changes nothing."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("archive", "day").agg(F.hll_union_agg("people").alias("people"))


def update_sketches(users: DataFrame, path: str, lg_cells: int = LG_CELLS) -> None:
    """Adds users to the sketches stored under ``path``; only the folders of their archives are read and written."""
    spark, fresh = users.sparkSession, user_sketches(users, lg_cells)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        touched = F.broadcast(users.select("archive").distinct())  # archives, of which an update has few
        fresh = unite_sketches(spark.read.schema(fresh.schema).parquet(path).join(touched, "archive", "left_semi"), fresh)
    fresh = stored(fresh, "sketches")  # a folder can't be read and replaced at once
    fresh.repartition("archive").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("archive").parquet(path)


def distinct_users(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Estimated users of each archive, or of each group ``by`` of archive and day, from sketches only."""
    by = by or ["archive"]
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("people")).alias("users"))
