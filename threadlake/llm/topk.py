"""Exact inner-product top-k with an impact-ordered, score-at-a-time index.

Rows are cut into blocks.  In each block every (dimension, sign) is a posting list, cut into segments by
quantised impact (the magnitude of the component); the levels follow the block's own magnitudes.
A query processes segments by descending product of its component and the segment's impact, and
each posting counts with the middle of its level.  After each portion of the postings every row has an
interval that holds its true score: what was seen is off by half a level at most, and what
was not seen is at most the query's component times the largest impact left in that dimension.  A query
stops only when its intervals prove that few enough rows can be among its best k, or when no
segment is left; the rows that can be are rescored exactly.  Queries are
broadcast in blocks of bounded size; each block is one pass over the rows, and its results are written before the next.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlake.llm.common import staged, table

BLOCK_ROWS = 4096
#: Most bytes of queries that are broadcast at once.
BROADCAST_BYTES = 32 << 20
#: Cuts of the magnitudes by rank, and as many by size; shares of the postings after which a query tries to stop.
LEVELS, TRIES = 24, (0.1, 0.3, 0.5, 0.75, 0.9, 0.95, 1.0)


class ImpactIndex:
    """Posting segments of one block of integer vectors; ``stops`` counts how searches ended."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows, self.stops = ids, rows, Counter()
        n, dim = rows.shape
        size = np.abs(rows)
        there = size > 0
        values = np.sort(size[there])
        top = int(values[-1]) if len(values) else 1
        by_rank = values[(np.arange(1, LEVELS) * len(values)) // LEVELS] if len(values) else values
        cuts = np.unique(np.concatenate([by_rank, np.linspace(1, top, LEVELS + 1)[1:-1].astype(np.int64)]))[::-1]
        # level 0 has the largest impacts; zeros are in no level
        level = np.searchsorted(-cuts, -size, side="left")
        self.levels = len(cuts) + 1
        level[~there] = self.levels
        self.low, self.high = np.zeros(self.levels + 1), np.zeros(self.levels + 1)
        bounds = np.concatenate(([0], np.searchsorted(values, cuts[::-1], side="left"), [len(values)]))[::-1]
        for i, (b, a) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if b > a:
                self.low[i], self.high[i] = values[a], values[b - 1]
        self.level = level.astype(np.uint8)
        # the largest impact left when the levels before are done
        self.left = np.maximum.accumulate(self.high[::-1])[::-1]
        # a segment for each dimension and level, positive postings before negative ones
        at_row, at_dim = np.nonzero(there)
        key = (at_dim * self.levels + level[at_row, at_dim]) * 2 + (rows[at_row, at_dim] < 0)
        order = np.argsort(key, kind="stable")
        self.posting = at_row[order].astype(np.int32)
        self.ends = np.searchsorted(key[order], np.arange(2 * dim * self.levels + 1))
        self.largest = size.max(axis=0, initial=0)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, row ids, scores) of the best k rows of the block for each query."""
        for one, q in zip(query_ids.tolist(), queries, strict=True):
            yield self._search(one, q, k)

    def _search(self, query_id: int, q: np.ndarray, k: int):
        n, dim = self.rows.shape
        weight, other = np.abs(q).astype(np.float64), self.ids != query_id
        most = float(weight @ self.largest)
        impact = weight[:, None] * self.high[None, :-1]
        order = np.argsort(-impact, axis=None, kind="stable")
        of_dim, of_level = order // self.levels, order % self.levels
        counts = self.ends[2 * order + 2] - self.ends[2 * order]
        done = np.cumsum(counts)
        tries = np.unique((np.searchsorted(done, np.array(TRIES) * done[-1], side="left") + 1).clip(max=len(order)))
        got, slack, next_level, at = np.zeros(n), np.full(n, most * 2**-40), np.zeros(dim, dtype=np.int64), 0
        possible = other
        for end in tries:
            part = order[at:end]
            for sign in (0, 1):
                a, b = self.ends[2 * part + sign], self.ends[2 * part + sign + 1]
                size = b - a
                rows = self.posting[np.repeat(a - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())]
                middle = q[part // self.levels] * (self.low + self.high)[part % self.levels] / 2
                got += np.bincount(rows, np.repeat(-middle if sign else middle, size), n)
                slack += np.bincount(rows, np.repeat(weight[part // self.levels] * (self.high - self.low)[part % self.levels] / 2, size), n)
            # in each dimension the levels come in order, as the weight is the same
            np.maximum.at(next_level, of_dim[at:end], of_level[at:end] + 1)
            at = end
            off = slack + (self.level >= next_level) @ (weight * self.left[next_level])
            lower = np.where(other, got - off, -np.inf)
            bar = np.partition(lower, n - k)[n - k] if n > k else -np.inf
            possible = other & (got + off >= bar)
            if possible.sum() <= max(64, 4 * k):
                break
        self.stops["proof" if at < tries[-1] else "end"] += 1
        rows = np.flatnonzero(possible)
        if most >= 2**62:
            score = np.array([sum(int(x) * int(y) for x, y in zip(r, q, strict=True)) for r in self.rows[rows]], dtype=object)
            if any(abs(x) >= 2**63 for x in score):
                raise ArithmeticError(f"a score of query {query_id} needs more than 64 bits")
            score = score.astype(np.int64)
        else:
            score = self.rows[rows] @ q
        best = np.lexsort((self.ids[rows], -score))[:k]
        return query_id, self.ids[rows][best], score[best]


def _blocks(batch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and integer components of the rows (id, components) of a batch, by length."""
    lists = batch.column(1)
    starts, ids = lists.offsets.to_numpy(), batch.column(0).to_numpy(zero_copy_only=False)
    sizes, flat = np.diff(starts), lists.values.to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        which = np.flatnonzero(sizes == dim)
        for a in range(0, len(which), BLOCK_ROWS):
            part = which[a : a + BLOCK_ROWS]
            rows = flat[starts[part][:, None] + np.arange(dim)[None, :]].astype(np.int64)
            if rows.size and (rows.min() < -(2**62) or rows.max() > 2**62):
                raise ArithmeticError("a component needs more than 63 bits")
            yield ids[part].astype(np.int64), rows


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _searcher(k: int, asked):
    def run(batches):
        for batch in batches:
            for ids, rows in _blocks(batch):
                if rows.shape[1] not in asked.value:
                    continue
                found = [x for x in ImpactIndex(ids, rows).search(*asked.value[rows.shape[1]], k) if len(x[1])]
                if found:
                    n = [len(x[1]) for x in found]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in found], n).astype(np.int64)), pa.array(np.concatenate([x[1] for x in found])), pa.array(np.concatenate([x[2] for x in found]).astype(np.int64))], schema=_FOUND)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """Each query's k best rows by integer inner product: query_id, rank (from 1), vec_id, score.

    A component x counts as floor(scale * x).  Ties go to the smaller id.  A query
    isn't its own candidate.  Vectors that are null or empty or hold a null, NaN or
    infinity, and rows without an id, take no part; vectors of different length never
    meet.  Rows that repeat an id are candidates each, with a rank each, but never of
    their own id; equal rows are one query.  Fewer than k candidates: all of them.
    A component or a score that 64 bits can't hold is an error (ArithmeticError), never a wrong
    score.  An empty table gives an empty result.
    """
    v = F.col(vector_col)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    rows = vectors.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(scale * x.cast("double")).cast("long")).alias("v"), is_query.alias("_q"))
    queries = staged(rows.where("_q").select("vec_id", "v").distinct(), "queries")
    total = queries.agg(F.sum(8 * F.size("v") + 8)).first()[0] or 0
    passes = max(1, -(-total // BROADCAST_BYTES))
    best, found = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"), []
    for i in range(passes):
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i).toArrow().combine_chunks().to_batches()  # about BROADCAST_BYTES
        by_dim: dict[int, list] = {}
        for ids, q in (x for batch in part for x in _blocks(batch)):
            by_dim.setdefault(q.shape[1], []).append((ids, q))
        asked = queries.sparkSession.sparkContext.broadcast({d: tuple(map(np.concatenate, zip(*x, strict=True))) for d, x in by_dim.items()})
        hits = rows.select("vec_id", "v").mapInArrow(_searcher(k, asked), "query_id long, vec_id long, score long")
        found.append(staged(hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "hits"))
        asked.destroy()
    return reduce(DataFrame.unionByName, found)


def op9_top_k(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
WHERE rank <= 10
"""
