"""Hard negatives of labelled vectors, by segment summary filtering.

A vector is cut into segments, and each of those into halves, down to SHORT components.  For every
segment its mean and its deviation are stored beside the row, once.  The product of two vectors over
a segment of n components is n times the product of the means, plus or minus n times the product of the
deviations at most, so the sums over the segments bound the score from both sides.  Rows whose bounds rule
them out go; for the others the segments are halved and the bounds drawn closer, and what is left after the shortest
segments gets its exact score.

Anchors are broadcast in blocks of bounded size.  A block makes two passes over the stored summaries: one
finds each anchor's positives, the other, which knows their scores, the rows below them.  Every task keeps the best rows of
each anchor so far, which tells what later rows must reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlake.llm.common import release, staged, table

#: Segments at first, components of the shortest segments, rows and anchors of a step.
FIRST, SHORT, ROWS, ANCHORS = 4, 2, 4096, 64
#: Most bytes of anchors that are broadcast at once, and pairs whose bounds are worked out at once.
BROADCAST_BYTES, PAIRS = 32 << 20, 1 << 16
#: What single precision of the summaries and the order of sums can change of a score, as a share of the product of both lengths.
ROUNDING = 2.0**-18
_LEAST = np.iinfo(np.int64).min


def segment_levels(dim: int) -> list[np.ndarray]:
    """Bounds of the segments of a vector of dim components, from FIRST segments on, each level halving the one before."""
    edges = np.unique(np.arange(FIRST + 1) * dim // FIRST)
    levels = []
    while dim:
        levels.append(edges)
        if np.diff(edges).max() <= SHORT:
            break
        edges = np.unique(np.concatenate([edges, (edges[:-1] + edges[1:]) // 2]))
    return levels


def summaries(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of all segments of all levels, side by side, each times the root of the segment's length."""
    mean, off = [], []
    for edges in segment_levels(rows.shape[1]):
        size = np.diff(edges)
        m = np.add.reduceat(rows, edges[:-1], axis=1) / size
        squares = np.add.reduceat((rows - np.repeat(m, size, axis=1)) ** 2, edges[:-1], axis=1)
        mean.append(m * np.sqrt(size))
        off.append(np.sqrt(squares))
    none = [np.zeros((len(rows), 0))]
    return np.concatenate(mean or none, axis=1).astype(np.float32), np.concatenate(off or none, axis=1).astype(np.float32)


class Block:
    """Rows of one length with their summaries."""

    def __init__(self, ids, labels, rows, mean, off):
        self.ids, self.labels, self.rows, self.mean, self.off = ids, labels, rows, mean.astype(np.float64), off.astype(np.float64)
        self.real = rows.astype(np.float64)
        self.length = np.sqrt((self.real**2).sum(axis=1))

    def take(self, which) -> Block:
        out = Block.__new__(Block)
        for k, v in vars(self).items():
            setattr(out, k, v[which])
        return out


def _in_parts(n: int) -> Iterator[slice]:
    for a in range(0, n, PAIRS):
        yield slice(a, a + PAIRS)


class Filter:
    """Bounds of the scores of a block's rows and of anchors, level by level."""

    def __init__(self, block: Block, anchors: Block):
        self.block, self.anchors = block, anchors
        ends = np.cumsum([len(e) - 1 for e in segment_levels(block.rows.shape[1])]).tolist()
        self.levels = list(zip([0, *ends], ends, strict=False))

    def dense(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all pairs (row, anchor)."""
        a, b = self.levels[level]
        middle = self.block.mean[:, a:b] @ self.anchors.mean[:, a:b].T
        away = self.block.off[:, a:b] @ self.anchors.off[:, a:b].T + ROUNDING * np.outer(self.block.length, self.anchors.length)
        return middle - away, middle + away

    def of_pairs(self, level: int, row: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.levels[level]
        low, high = np.empty(len(row)), np.empty(len(row))
        for s in _in_parts(len(row)):
            r, q = row[s], anchor[s]
            middle = np.einsum("ij,ij->i", self.block.mean[r, a:b], self.anchors.mean[q, a:b])
            away = np.einsum("ij,ij->i", self.block.off[r, a:b], self.anchors.off[q, a:b]) + ROUNDING * self.block.length[r] * self.anchors.length[q]
            low[s], high[s] = middle - away, middle + away
        return low, high

    def exact(self, row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Integer scores; a score that 64 bits can't hold is an error."""
        out = np.empty(len(row), dtype=np.int64)
        if not len(row):
            return out
        most = float(self.block.length[row].max() * self.anchors.length[anchor].max())
        for s in _in_parts(len(row)):
            r, q = row[s], anchor[s]
            if most < 2**52:
                out[s] = np.einsum("ij,ij->i", self.block.real[r], self.anchors.real[q]).astype(np.int64)
            elif most < 2**62:
                out[s] = np.einsum("ij,ij->i", self.block.rows[r], self.anchors.rows[q])
            else:
                for k, (i, j) in enumerate(zip(r.tolist(), q.tolist(), strict=True), s.start):
                    score = sum(int(x) * int(y) for x, y in zip(self.block.rows[i], self.anchors.rows[j], strict=True))
                    if abs(score) >= 2**63:
                        raise ArithmeticError(f"a score of anchor {self.anchors.ids[j]} needs more than 64 bits")
                    out[k] = score
        return out


def _kth(low: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each column, minus infinity if there are fewer."""
    return np.partition(low, len(low) - k, axis=0)[len(low) - k] if len(low) >= k else np.full(low.shape[1], -np.inf)


def _kth_of_pairs(low: np.ndarray, col: np.ndarray, k: int, was: np.ndarray) -> np.ndarray:
    """The k-th largest value of the pairs of each column, or what it was, if that is more."""
    order = np.lexsort((-low, col))
    starts = np.searchsorted(col[order], np.arange(len(was) + 1))
    many = np.flatnonzero(np.diff(starts) >= k)
    out = was.copy()
    out[many] = np.maximum(out[many], low[order][starts[many] + k - 1])
    return out


class Best:
    """The best k (score, id) of each of many lists, as new ones come in."""

    def __init__(self, lists: int, k: int):
        self.k, self.score, self.id, self.n = k, np.full((lists, k), _LEAST), np.zeros((lists, k), np.int64), np.zeros(lists, np.int64)

    def bar(self) -> np.ndarray:
        """What a new score must reach, for each list."""
        return np.where(self.n == self.k, self.score[:, -1].astype(np.float64), -np.inf)

    def add(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(which)
        old = np.repeat(touched, self.n[touched])
        at = np.arange(len(old)) - np.repeat(np.cumsum(self.n[touched]) - self.n[touched], self.n[touched])
        lists, scores, names = np.concatenate([old, which]), np.concatenate([self.score[old, at], score]), np.concatenate([self.id[old, at], ids])
        order = np.lexsort((names, -scores, lists))
        lists, scores, names = lists[order], scores[order], names[order]
        place = np.arange(len(lists)) - np.searchsorted(lists, lists, side="left")
        fine = place < self.k
        self.score[lists[fine], place[fine]], self.id[lists[fine], place[fine]] = scores[fine], names[fine]
        np.maximum.at(self.n, lists[fine], place[fine] + 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        which = np.repeat(np.arange(len(self.n)), self.n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        return which, self.id[which, at], self.score[which, at]


def _positives(block: Block, anchors: Block, numbers: np.ndarray, best: Best) -> None:
    """Adds to ``best`` (lists by the anchors' numbers) the block's rows of an anchor's own label."""
    f = Filter(block, anchors)
    other = block.ids[:, None] != anchors.ids[None, :]
    row, col = np.nonzero(other)
    for level in range(len(f.levels)):
        if level == 0:
            low, high = f.dense(0)
            bar = np.maximum(_kth(np.where(other, low, -np.inf), best.k), best.bar()[numbers])
            fine = (high >= bar)[row, col]
        else:
            low, high = f.of_pairs(level, row, col)
            bar = _kth_of_pairs(low, col, best.k, bar)
            fine = high >= bar[col]
        row, col = row[fine], col[fine]
    best.add(numbers[col], f.exact(row, col), block.ids[row])


def _negatives(block: Block, anchors: Block, numbers: np.ndarray, caps: np.ndarray, best: Best, share: tuple[int, int]) -> None:
    """Adds to ``best`` (lists by number * positives + place) the block's rows of another label, within the share of a positive's score.

    caps holds the positives' scores of each anchor, the smallest integer where there is none.
    """
    f, places = Filter(block, anchors), caps.shape[1]
    there = caps != _LEAST
    floors = np.where(there, -((-share[0] * caps.astype(object)) // share[1]), 0)
    floor, cap = np.where(there, floors.astype(np.float64), np.inf), np.where(there, caps.astype(np.float64), -np.inf)
    bar = np.maximum(floor, best.bar().reshape(-1, places)[numbers])
    row, col = np.nonzero(block.labels[:, None] != anchors.labels[None, :])
    for level in range(len(f.levels)):
        if level == 0:
            low, high = (x[row, col] for x in f.dense(0))
        else:
            low, high = f.of_pairs(level, row, col)
        fine = np.zeros(len(row), dtype=bool)
        for p in range(places):
            # a little room, as caps and bars are whole numbers in double precision
            fine |= (high * (1 + 1e-12) + 0.5 >= bar[col, p]) & (low * (1 - 1e-12) - 0.5 <= cap[col, p])
        row, col = row[fine], col[fine]
    score = f.exact(row, col)
    for p in range(places):
        whole = np.array([int(x) if ok else 0 for x, ok in zip(floors[:, p], there[:, p], strict=True)], dtype=np.int64)
        fits = there[col, p] & (score <= caps[col, p]) & (score >= whole[col])
        best.add(numbers[col[fits]] * places + p, score[fits], block.ids[row[fits]])


_SUMMED = "vec_id long, label long, v array<long>, mean array<float>, off array<float>"


def _by_length(batch, *more: int) -> Iterator[tuple]:
    """Ids, labels, components and further lists (by column) of a batch's rows of each length, ROWS at a time."""
    lists = batch.column(2)
    sizes = np.diff(lists.offsets.to_numpy())
    for dim in np.unique(sizes):
        which = np.flatnonzero(sizes == dim)
        for a in range(0, len(which), ROWS):
            part = batch.take(pa.array(which[a : a + ROWS]))
            n = part.num_rows
            wide = [part.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, *more)]
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), *(x.reshape(n, len(x) // n) for x in wide)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel(), kind))


def _summarise(batches):
    for batch in batches:
        for ids, labels, rows in _by_length(batch):
            mean, off = summaries(rows.astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), _lists(rows, pa.int64()), _lists(mean, pa.float32()), _lists(off, pa.float32())], names=["vec_id", "label", "v", "mean", "off"])


_FOUND = pa.schema([("anchor", pa.int64()), ("place", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _found(best: Best, places: int):
    which, ids, score = best.rows()
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (which // places, which % places, ids, score)], schema=_FOUND)


def _searcher(asked, k: int, share: tuple[int, int] | None):
    """Positives of the broadcast anchors without ``share``, else negatives.  One task's best rows for each anchor go on, k each."""

    def run(batches):
        anchors, caps = asked.value
        places = 1 if share is None else caps.shape[1]
        best = Best(sum(len(b.ids) for _, b in anchors.values()) * places, k)
        for batch in batches:
            for ids, labels, rows, mean, off in _by_length(batch, 3, 4):
                if rows.shape[1] not in anchors:
                    continue
                numbers, of = anchors[rows.shape[1]]
                block = Block(ids, labels, rows, mean, off)
                if share is None:
                    for label in np.intersect1d(labels, of.labels):
                        mine, theirs = block.take(labels == label), np.flatnonzero(of.labels == label)
                        for a in range(0, len(theirs), ANCHORS):
                            some = theirs[a : a + ANCHORS]
                            _positives(mine, of.take(some), numbers[some], best)
                else:
                    for a in range(0, len(of.ids), ANCHORS):
                        some = np.arange(a, min(a + ANCHORS, len(of.ids)))
                        _negatives(block, of.take(some), numbers[some], caps[numbers[some]], best, share)
        if best.n.any():
            yield _found(best, places)

    return run


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "vec_id", label_col: str | Column = "label", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x), scores are inner products, higher ones first, ties to the smaller id.
    An anchor's positives are its first other rows of the same label; each gets the first rows of another label whose score is at most the
    positive's and at least share[0] / share[1] of it, which a negative positive's score leaves none.
    Rows with a null id, label or vector, or with a null, NaN or infinite component take no part.  Vectors of different length never meet; an
    empty one scores 0.  Rows that repeat an id are candidates each, but never of their own id; equal anchor rows are one anchor, others of the
    same id an anchor each.  A component or score that 64 bits can't hold is an error (ArithmeticError).  An empty table gives an empty result.
    """
    v = F.col(vector_col)
    fine = v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    label = (label_col if isinstance(label_col, Column) else F.col(label_col)).cast("long")
    rows = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & fine)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.transform(v, lambda x: F.floor(scale * x.cast("double")).cast("long")).alias("v"), is_anchor.alias("_a"))
    summed = staged(rows.select("vec_id", "label", "v").mapInArrow(_summarise, _SUMMED), "summaries")
    anchors = staged(rows.where("_a").select("vec_id", "label", "v").distinct(), "anchors")
    spark, sent = vectors.sparkSession, vectors.sparkSession.sparkContext.broadcast
    total = anchors.agg(F.sum(16 * F.size("v") + 16 * positives + 32)).first()[0] or 0
    blocks, found = max(1, -(-total * 4 // BROADCAST_BYTES)), []
    for i in range(blocks):
        part = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).toArrow().combine_chunks().to_batches()  # of BROADCAST_BYTES, about
        by_dim, names = _numbered(part)
        if not names:
            continue
        asked = sent((by_dim, None))
        order = W.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
        hits = summed.mapInArrow(_searcher(asked, positives, None), "anchor long, place long, vec_id long, score long")
        near = staged(hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives), "positives")
        asked.destroy()
        caps = np.full((len(names), positives), _LEAST)
        for a, p, s in zip(*(c.to_pylist() for c in near.select("anchor", "place", "score").toArrow().columns), strict=True):  # positives of this block's anchors
            caps[a, p - 1] = s
        asked = sent((by_dim, caps))
        order = W.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id")
        hits = summed.mapInArrow(_searcher(asked, negatives, share), "anchor long, place long, vec_id long, score long")
        far = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).withColumn("place", F.col("place") + 1).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
        named = spark.createDataFrame(pa.table({"anchor": pa.array(range(len(names)), pa.int64()), "anchor_id": pa.array(names, pa.int64())}))
        both = near.withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"}).join(far, ["anchor", "place"]).join(F.broadcast(named), "anchor")
        found.append(staged(both.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives"))
        asked.destroy()
        release(near)
    if not found:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    release(summed, anchors)
    return reduce(DataFrame.unionByName, found)


def _numbered(batches) -> tuple[dict[int, tuple[np.ndarray, Block]], list[int]]:
    """Anchors by length with a number each, and their ids by number."""
    parts: dict[int, list] = {}
    for batch in batches:
        for ids, labels, rows in _by_length(batch):
            parts.setdefault(rows.shape[1], []).append((ids, labels, rows))
    out, names = {}, []
    for dim, some in parts.items():
        ids, labels, rows = (np.concatenate(x) for x in zip(*some, strict=True))
        out[dim] = (np.arange(len(names), len(names) + len(ids)), Block(ids, labels, rows, *summaries(rows.astype(np.float64))))
        names += ids.tolist()
    return out, names


def op12_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label_col=label)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
