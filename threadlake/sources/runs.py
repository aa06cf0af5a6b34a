"""Tables cut into buckets of threads and written by runs; a run's manifest is its commit.

    <path>/manifests/00000007.json   for each table and bucket, the folders that hold its rows
    <path>/runs/00000007-<random>/<table>/bucket=<n>/...

A run writes into a folder of its own: buckets anew, or further folders of a bucket.  Nothing is visible before its manifest
is there under the next number, which only one run can take; a run that is killed leaves a folder
that nobody reads (see ``vacuum``).  Readers take the last manifest, and what it names is never changed.
A run that touches few buckets therefore reads and writes those only, whatever the size of the tables.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a new store; a table of many terabytes takes thousands.
BUCKETS = 64
#: Folders of a bucket from which on ``append`` writes the bucket anew.
FOLDERS = 8


class Conflict(RuntimeError):
    """Another run has committed in between."""


class Manifests:
    """Numbered JSON files under ``path``/manifests, each taken by one writer only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def names(self, path: str) -> list[str]:
        fs, where = self.fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.names(f"{self.path}/manifests") if n.endswith(".json") and not n.startswith(".")]

    def get(self, number: int) -> dict:
        fs, where = self.fs(f"{self.path}/manifests/{number:08d}.json")
        stream = fs.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def last(self) -> dict | None:
        numbers = self.numbers()
        return self.get(numbers[-1]) if numbers else None

    def put(self, content: dict, number: int) -> None:
        """Writes the file of a number; Conflict if there is one."""
        sc, at = self.spark.sparkContext, f"{self.path}/manifests"
        fs, temporary = self.fs(f"{at}/.{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        out.write(json.dumps(content).encode())
        out.close()
        jvm = sc._jvm.org.apache.hadoop.fs
        files = jvm.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
        try:
            files.rename(temporary, jvm.Path(f"{at}/{number:08d}.json"), sc._gateway.new_array(getattr(jvm, "Options$Rename"), 0))  # never replaces one
        except Exception as e:
            fs.delete(temporary, False)
            raise Conflict(f"number {number} is taken") from e

    def drop(self, number: int) -> None:
        fs, where = self.fs(f"{self.path}/manifests/{number:08d}.json")
        fs.delete(where, False)


class Store:
    """The tables under ``path``.  The number of buckets is fixed by the first commit."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.manifests = spark, path.rstrip("/"), Manifests(spark, path)
        self._new = {"run": 0, "buckets": buckets, "schemas": {}, "tables": {}, "marks": {}}

    def manifest(self) -> dict:
        """The last commit; an empty store has run 0 and no tables."""
        return self.manifests.last() or self._new

    def bucket(self, df: DataFrame, manifest: dict | None = None) -> Column:
        """The bucket of a row, by its thread, or by its archive alone where the table has no threads."""
        n = (manifest or self.manifest())["buckets"]
        return F.pmod(F.xxhash64(*(["archive", "tid"] if "tid" in df.columns else ["archive"])), F.lit(n)).cast("int")

    def touched(self, *tables: DataFrame) -> list[int]:
        """The buckets of the rows of tables, at most all there are."""
        m, found = self.manifest(), set()
        for df in tables:
            found.update(r[0] for r in df.select(self.bucket(df, m).alias("b")).distinct().collect())
        return sorted(found)

    def names(self) -> list[str]:
        return sorted(self.manifest()["tables"])

    def read(self, name: str, buckets: Iterable[int] | None = None, manifest: dict | None = None) -> DataFrame | None:
        """Rows of a table, of some buckets or of all; None where there is no such table."""
        m = manifest or self.manifest()
        if name not in m["schemas"]:
            return None
        shape, places = StructType.fromJson(m["schemas"][name]), m["tables"][name]
        wanted = places if buckets is None else [str(b) for b in buckets if str(b) in places]
        paths = [f"{self.path}/runs/{folder}/{name}/bucket={b}" for b in wanted for folder in places[b]]
        return self.spark.read.schema(shape).parquet(*paths) if paths else self.spark.createDataFrame([], shape)

    def begin(self) -> Run:
        return Run(self)

    def vacuum(self, keep: int = 2, older_than: float = 86_400.0) -> list[str]:
        """Deletes run folders that none of the last ``keep`` manifests names, and older manifests; returns the folders.

        Folders younger than ``older_than`` seconds stay, as a run may still be writing them.
        """
        numbers, m = self.manifests.numbers(), self.manifests
        used = {f for n in numbers[-keep:] for t in m.get(n)["tables"].values() for folders in t.values() for f in folders}
        gone = []
        for folder in m.names(f"{self.path}/runs"):
            fs, where = m.fs(f"{self.path}/runs/{folder}")
            if folder not in used and fs.getFileStatus(where).getModificationTime() <= (time.time() - older_than) * 1000:
                fs.delete(where, True)
                gone.append(folder)
        for n in numbers[:-keep]:
            m.drop(n)
        return gone


class Run:
    """Writes of one run, which ``commit`` makes visible together."""

    def __init__(self, store: Store):
        self.store, self.base = store, store.manifest()
        self.folder = f"{self.base['run'] + 1:08d}-{uuid.uuid4().hex}"
        self.next = json.loads(json.dumps(self.base)) | {"run": self.base["run"] + 1}

    def _write(self, name: str, df: DataFrame, order: list[str]) -> list[str]:
        path = f"{self.store.path}/runs/{self.folder}/{name}"
        # buckets meet in tasks; a large one is dealt over several
        dealt = df.withColumn("bucket", self.store.bucket(df, self.base)).hint("rebalance", "bucket")
        dealt.sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(path)
        self.next["schemas"][name] = json.loads(df.schema.json())
        return [n.partition("=")[2] for n in self.store.manifests.names(path) if n.startswith("bucket=")]

    def write(self, name: str, df: DataFrame, buckets: Iterable[int]) -> DataFrame:
        """Replaces buckets of a table by the rows of df, all of which lie in them; returns the rows as written."""
        order = [c for c in ("archive", "tid", "id") if c in df.columns]
        there, places = self._write(name, df, order), self.next["tables"].setdefault(name, {})
        for b in map(str, buckets):
            places.pop(b, None)
        places |= {b: [self.folder] for b in there}
        return self.store.read(name, map(int, there), self.next)

    def append(self, name: str, df: DataFrame) -> None:
        """Adds rows to a table; a bucket of FOLDERS folders is written anew, as one."""
        order = [c for c in ("archive", "tid", "id") if c in df.columns]
        many = [b for b, folders in self.base["tables"].get(name, {}).items() if len(folders) >= FOLDERS]
        if many:
            in_many = self.store.bucket(df, self.base).isin([int(b) for b in many])
            old = self.store.read(name, map(int, many), self.base)
            # only buckets that get rows are due
            due = [str(b) for b in self.store.touched(df.where(in_many))]
            old = self.store.read(name, map(int, due), self.base) if due else old.limit(0)
            df, many = old.unionByName(df.select(*old.columns)), due
        there, places = self._write(name, df, order), self.next["tables"].setdefault(name, {})
        for b in there:
            places[b] = [self.folder] if b in many else [*places.get(b, []), self.folder]

    def commit(self, **marks: int) -> int:
        """Makes the run visible; Conflict if another run took its number.  marks are kept in the manifest."""
        self.next["marks"] |= marks
        self.store.manifests.put(self.next, self.next["run"])
        return self.next["run"]
