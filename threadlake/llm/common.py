"""Shared folder, staged tables and small helpers of the llm operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or an own one where it is unset in local mode (tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder, with a folder for each value of ``by``; lost executors can't take it away.

    The table goes with release(), or when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/threadlake/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    system, where = _folder(spark, path)
    system.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes staged tables of which nothing is read any more."""
    for t in tables:
        system, where = _folder(t.sparkSession, t._staged_path)
        system.delete(where, True)


#: Ids that may be broadcast: some 16 MB.
BROADCAST_ROWS = 500_000


def beside(docs: DataFrame, ids: DataFrame, how: str, on: str | list[str] = "doc_id") -> DataFrame:
    """docs joined to a staged table of ids alone, which is broadcast only if counting shows that it is small.

    Beyond the bound both sides are shuffled on the id.
    """
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if small else ids, on, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else unchanged."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
