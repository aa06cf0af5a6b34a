"""Listings of tar files, a range of bytes in a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from threadlake.sources.places import stored

BLOCK = 512
#: Bytes of a tar that one task lists.
RANGE_BYTES = 64 << 20
#: How gzip, bzip2 and xz files begin.
_PACKED = (b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00")
_WALK = "archive string, path string, start bigint, stop bigint, entry bigint, leaves bigint, ended boolean, members array<struct<name string, offset bigint, size bigint>>"


def _header_at(file, start: int, stop: int) -> int:
    """The first place in [start, stop), in steps of a block, whose bytes sum up to the checksum they state; stop if none does."""
    import tarfile

    import numpy as np

    for at in range(start, stop, 2048 * BLOCK):
        file.seek(at)
        data = file.read(min(2048 * BLOCK, stop - at))
        blocks = np.frombuffer(data, np.uint8, len(data) // BLOCK * BLOCK).reshape(-1, BLOCK)
        sums = blocks.sum(axis=1, dtype=np.int64) - blocks[:, 148:156].sum(axis=1, dtype=np.int64) + 8 * 32
        for i in np.flatnonzero((sums > 8 * 32) & np.isin(blocks[:, 148], np.frombuffer(b" 01234567", np.uint8))):
            try:
                if tarfile.nti(bytes(blocks[i, 148:156])) == sums[i]:
                    return at + int(i) * BLOCK
            except tarfile.HeaderError:
                continue
    return stop


def _walk(file, entry: int, stop: int) -> tuple[int, bool, list[dict]]:
    """Where the headers from entry on leave the range, whether the archive's end came first, and its regular members up to there.

    After an end, which a tar within a tar has too, the way is found again at the next header: it only tells where to leave.
    """
    import tarfile

    members, ended, at = [], False, entry
    while at < stop:
        file.seek(at)
        try:
            tar = tarfile.TarFile(fileobj=file, mode="r")
            while (m := tar.next()) is not None:
                tar.members = []
                if m.isreg() and not ended:
                    members.append({"name": m.name, "offset": m.offset_data, "size": m.size})
                at = max(tar.offset, at + BLOCK)
                if at >= stop:
                    return at, ended, members
        except (tarfile.TarError, ValueError, OverflowError):
            pass
        ended = True
        at = _header_at(file, at + BLOCK, stop)
    return at, ended, members


def read_tar_members(spark: SparkSession, paths: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """archive, tar, name, offset, size of the regular members; paths has archive and path.

    Only headers are read where a range begins with one; offset is where a member's bytes begin.  A tar is cut into ranges.  Each is listed from
    the first place that looks like a header; ranges that the one before leaves for another place (bytes of a
    member can look like headers) are listed again from there, until all of them meet.  Each round settles
    at least one more range of a tar, and mostly all.  A tar ends where its first range that sees an end
    does; one that is cut off gives the members whose headers are there.  Global attributes of pax headers give
    no names.  A path that is listed twice gives its members twice.  A compressed tar is one task's work; a file that is no tar is an error.
    """
    step = max(BLOCK, range_bytes // BLOCK * BLOCK)

    def sizes(batches):
        import os

        import pyarrow as pa

        def size(path):
            with open(path, "rb") as file:
                return 1 if file.read(6).startswith(_PACKED) else os.path.getsize(path)

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([size(p) for p in batch.column(1).to_pylist()], pa.int64())], ["archive", "path", "bytes"])

    def walks(batches):
        import tarfile

        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                entry = r["entry"]
                if r["start"] == 0:
                    entry = 0
                    with tarfile.open(r["path"]) as tar:  # an error if it is no tar
                        packed = [{"name": m.name, "offset": m.offset_data, "size": m.size} for m in tar if m.isreg()] if r["stop"] == 1 else None
                with open(r["path"], "rb") as file:
                    if entry is None:
                        entry = _header_at(file, r["start"], r["stop"])
                    leaves, ended, members = (1, True, packed) if r["stop"] == 1 else _walk(file, entry, r["stop"])
                made = {k: r[k] for k in ("archive", "path", "start", "stop")} | {"entry": entry, "leaves": leaves, "ended": ended, "members": members}
                yield pa.RecordBatch.from_pylist([made], schema=shape)

    shape = to_arrow_schema(T._parse_datatype_string(_WALK))
    listed = paths.select("archive", "path").groupBy("archive", "path").agg(F.count("*").alias("times"))
    measured = listed.select("archive", "path").mapInArrow(sizes, "archive string, path string, bytes bigint")
    ranges = measured.select("archive", "path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(step).cast("bigint"))).alias("start"), "bytes")
    ranges = ranges.select("archive", "path", "start", F.least(F.col("start") + step, "bytes").alias("stop"), F.lit(None).cast("bigint").alias("entry"))
    # a range is a task's work for seconds, so they are spread one by one
    spread = lambda df: df.repartition(max(1, min(df.count(), 100_000)), "path", "start")
    known = stored(spread(stored(ranges, "ranges")).mapInArrow(walks, _WALK), "walks")
    before = W.partitionBy("archive", "path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    while True:
        heads = known.select("archive", "path", "start", "stop", "entry", "leaves").withColumn("due", F.coalesce(F.max("leaves").over(before), F.lit(0)))
        wrong = stored(heads.where("due <> entry and not (due >= stop and entry >= stop)").select("archive", "path", "start", "stop", F.col("due").alias("entry")), "wrong")
        if wrong.isEmpty():
            break
        again = spread(wrong).mapInArrow(walks, _WALK)
        known = stored(known.join(wrong.select("archive", "path", "start"), ["archive", "path", "start"], "left_anti").select(*known.columns).unionByName(again), "walks")
    end = known.where("ended").groupBy("archive", "path").agg(F.min("start").alias("end"))
    kept = known.join(end, ["archive", "path"], "left").where("end is null or start <= end").join(listed, ["archive", "path"])
    kept = kept.where("times = 1").unionByName(kept.where("times > 1").withColumn("_", F.explode(F.sequence(F.lit(1).cast("bigint"), "times"))).drop("_"))
    return kept.select("archive", F.substring_index("path", "/", -1).alias("tar"), F.explode("members").alias("m")).select("archive", "tar", "m.name", "m.offset", "m.size")
