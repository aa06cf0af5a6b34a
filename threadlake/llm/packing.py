"""Length buckets of least padding, and token-budget batches within them.

The lengths of all texts are counted exactly: the histogram has a row for each different length, so at most
as many as the longest text has tokens.  Dynamic programming over it chooses the bucket boundaries that minimise total
padding; as the best place of a boundary moves only forward with the end of its bucket, all ends of
a layer are solved by halving.  Texts of a bucket are then dealt into batches whose padded size stays within the
token budget.  Positions come from counts of small hashed groups, so no task holds a whole bucket,
and equal rows are counted, not listed, until their places are known.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlake.llm.common import release, staged, table

#: Buckets, tokens in a batch, different rows in a group, equal rows that one task lists.
BUCKETS, BUDGET, GROUP, EQUAL = 16, 65_536, 4000, 4096


def count_words(docs: DataFrame) -> DataFrame:
    """doc_id (as it is) and n_tokens, the words between ASCII white space, of rows (doc_id, text)."""

    def run(batches):
        for batch in batches:
            sizes = [len(x.split()) if x else 0 for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def _layer(best: np.ndarray, most: int, lengths: np.ndarray, many: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the first j lengths, j = 0 .. n: the least padding with one bucket more than best (``most``: there is no way), and where that bucket begins.

    The middle of each open range of ends is solved first; it bounds the choices of the ends on both sides.
    All ranges of one depth are searched together.
    """
    n = len(lengths)
    fresh, came = np.full(n + 1, most), np.zeros(n + 1, dtype=np.int64)
    low, high = np.array([1]), np.array([n])  # ends of the ranges, and the choices open to them
    first, last = np.array([0]), np.array([n - 1])
    while len(low):
        mid = (low + high) // 2
        size = np.minimum(last, mid - 1) - first + 1
        ptr = np.concatenate(([0], np.cumsum(size)))
        start = np.repeat(first - ptr[:-1], size) + np.arange(ptr[-1])
        end = np.repeat(mid, size)
        cost = best[start] + lengths[end - 1] * (many[end] - many[start]) - (tokens[end] - tokens[start])
        least = np.minimum.reduceat(cost, ptr[:-1])
        hits = np.flatnonzero(cost == np.repeat(least, size))
        at = start[hits[np.searchsorted(hits, ptr[:-1])]]  # the earliest of equally good ones
        fresh[mid], came[mid] = least, at
        left, right = mid > low, mid < high
        low, high, first, last = (np.concatenate((a[left], b[right])) for a, b in ((low, mid + 1), (mid - 1, high), (first, at), (at, last)))
    return fresh, came


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Longest length of each bucket, ascending, such that total padding is least.

    ``lengths`` ascend and differ; ``counts`` says how many texts have each.  Of equally good
    choices the one with fewer buckets, then with earlier boundaries, is taken.
    """
    n = len(lengths)
    if not n:
        return []
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    many, tokens = (np.concatenate(([0], np.cumsum(x))) for x in (counts, counts * lengths))
    most = int(lengths[-1] * many[-1]) + 1
    best = np.concatenate(([0], np.full(n, most)))
    back = []
    for _ in range(min(buckets, n)):
        best, came = _layer(best, most, lengths, many, tokens)
        back.append((best[n], came))
    k = min(range(len(back)), key=lambda i: (back[i][0], i))
    out, j = [], n
    for i in range(k, -1, -1):
        out.append(int(lengths[j - 1]))
        j = int(back[i][1][j])
    return out[::-1]


def pack(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_tokens, batch, slot, padding for every row of docs.

    bucket counts from 0; texts of a bucket are padded to bucket_tokens.  batch counts from 0 within
    the bucket and has budget // bucket_tokens slots (one, if a text alone is over
    the budget; nothing is cut).  Only a bucket's last batch can have free slots.  The
    length is ``length``, a column with each row's number of tokens (for instance that of byte_bpe), by default the words of the text; null, empty and blank texts have
    length 0 and go to the first bucket.  Repeated and null ids are rows like others; rows equal in id
    and length get neighbouring places.  Other columns are not read.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("n_tokens")) if length is not None else count_words(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    lengths = staged(rows, "lengths")
    rows = staged(lengths.groupBy("doc_id", "n_tokens").agg(F.count("*").alias("n")), "rows")
    release(lengths)
    # a row for each different length, with how many different and how many equal rows have it
    histogram = rows.groupBy("n_tokens").agg(F.sum("n").alias("n"), F.count("*").alias("different")).orderBy("n_tokens").toArrow()
    sizes, n, different = (histogram[c].to_numpy() for c in ("n_tokens", "n", "different"))
    ends = boundaries(sizes, n, buckets)
    at = np.searchsorted(ends, sizes)
    groups = [-(-int(different[at == i].sum()) // GROUP) for i in range(len(ends))]
    ends, groups = ends or [0], groups or [1]
    bucket = F.size(F.filter(F.lit(ends).cast("array<long>"), lambda b: b < F.col("n_tokens")))
    pick = lambda values: F.get(F.lit(values).cast("array<long>"), F.col("bucket"))
    placed = rows.withColumn("bucket", bucket).withColumn("bucket_tokens", pick(ends)).withColumn("group", F.pmod(F.xxhash64("doc_id", "n_tokens"), pick(groups)))
    counts = placed.groupBy("bucket", "group").agg(F.sum("n").alias("rows"))
    earlier = W.partitionBy("bucket").orderBy("group").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("bucket", "group", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    within = F.sum("n").over(W.partitionBy("bucket", "group").orderBy("doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    first = placed.withColumn("within", within).join(counts, ["bucket", "group"]).select("doc_id", "n_tokens", "n", "bucket", "bucket_tokens", (F.col("before") + F.col("within")).alias("first"))
    first = staged(first, "places")
    few = first.where(F.col("n") <= EQUAL).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    # many equal rows are first cut into runs, which are spread over tasks
    runs = first.where(F.col("n") > EQUAL).withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / EQUAL))))
    runs = runs.repartition("doc_id", "n_tokens", "run").withColumn("k", F.explode(F.sequence(F.col("run") * EQUAL, F.least(F.col("n"), (F.col("run") + 1) * EQUAL) - 1))).drop("run")
    place = few.withColumn("k", F.col("k").cast("long")).unionByName(runs).withColumn("place", F.col("first") + F.col("k"))
    slots = F.greatest(F.floor(budget / F.greatest(F.col("bucket_tokens"), F.lit(1))), F.lit(1)).cast("long")
    return place.select("doc_id", "n_tokens", "bucket", "bucket_tokens", F.floor(F.col("place") / slots).cast("long").alias("batch"), (F.col("place") % slots).cast("long").alias("slot"), (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"))


def op4_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
