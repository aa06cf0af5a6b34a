"""Lists that are stored in their order, so that any page reads the ranges it lies in and nothing else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a range, about.
RANGE_ROWS = 100_000


def sort_keys(order: list[str]) -> list[Column]:
    """Columns to sort by; a name that begins with - is taken in descending order; nulls come last."""
    return [F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_last(c) for c in order]


class StoredOrder:
    """Rows under ``path``, in folders by range, with the number of rows of each group that lie before each range.

    A group (none: all rows are one) has places 1 to its size by ``order``, which must be total.  A range holds rows of one or more
    groups, a large group lies in several, so no group is one task's work.
    """

    def __init__(self, spark: SparkSession, path: str, order: list[str], group: list[str] | None = None):
        self.spark, self.path, self.order, self.group = spark, path.rstrip("/"), order, group or []

    def write(self, df: DataFrame, range_rows: int = RANGE_ROWS) -> StoredOrder:
        """Replaces what is stored by the rows of df."""
        keys = [F.asc_nulls_last(c) for c in self.group] + sort_keys(self.order)
        n = max(1, -(-df.count() // range_rows))
        ranges = df.repartitionByRange(n, *keys).withColumn("range", F.spark_partition_id())
        ranges.sortWithinPartitions("range", *keys).write.mode("overwrite").partitionBy("range").parquet(f"{self.path}/rows")
        df.limit(0).write.mode("overwrite").parquet(f"{self.path}/shape")  # an empty partitioned table has no file that tells its columns
        sizes = self.rows().groupBy(*self.group, "range").agg(F.count("*").alias("n"))
        by_range = W.partitionBy(*self.group).orderBy("range")
        before = F.coalesce(F.sum("n").over(by_range.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        total = F.sum("n").over(W.partitionBy(*self.group))
        offsets = sizes.select(*self.group, "range", "n", before.alias("before"), total.alias("total"))
        offsets.write.mode("overwrite").parquet(f"{self.path}/offsets")
        return self

    def rows(self) -> DataFrame:
        shape = self.spark.read.parquet(f"{self.path}/shape").schema
        return self.spark.read.schema(shape.add("range", "integer")).parquet(f"{self.path}/rows")

    def offsets(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/offsets")

    def _placed(self, rows: DataFrame, offsets: DataFrame) -> DataFrame:
        within = W.partitionBy(*self.group, "range").orderBy(*sort_keys(self.order))
        joined = rows.withColumn("_within", F.row_number().over(within)).join(offsets.select(*self.group, "range", "before", "total"), [*self.group, "range"])
        return joined.withColumn("place", F.col("before") + F.col("_within")).drop("_within", "before", "range")

    def page(self, page: int, size: int, **group) -> DataFrame:
        """Rows of one page of a group, with place and total, in order; only folders of ranges with rows of the page are read."""
        if page < 1 or size < 1 or set(group) != set(self.group):
            raise ValueError("page, size or group")
        first, last = (page - 1) * size + 1, page * size
        own = F.lit(True)
        for c, v in group.items():
            own = own & F.col(c).eqNullSafe(F.lit(v))
        offsets = self.offsets().where(own & (F.col("before") < last) & (F.col("before") + F.col("n") >= first))
        here = [r["range"] for r in offsets.select("range").collect()]  # at most those that the page covers
        rows = self.rows().where(own & F.col("range").isin(here))
        return self._placed(rows, offsets).where(F.col("place").between(first, last)).orderBy("place")

    def places(self) -> DataFrame:
        """All rows with place and total; groups must not be null."""
        return self._placed(self.rows(), self.offsets())
