"""Text quality by positive-unlabelled learning.

The positives are trusted: rows labelled good.  All else is unlabelled text, good and bad.  With the share of good
texts (the prior), the risk of a classifier on bad texts is its risk on unlabelled text less the prior's share of good
ones, which must not become negative; the fit minimises the non-negative form of that unbiased risk.  Labels of bad texts are not used.

The prior is estimated from the two samples: for any set of texts, the share of unlabelled text in it is at
least the prior times the share of good texts in it, so the smallest ratio over upper sets of a first classifier's scores,
which tells good from unlabelled text, bounds it, and where bad texts can be told at all it is close.

A text is described by shares of kinds of characters, of repeated words and lines, by lengths, and by words
that carry signs; a feature counts by the interval it falls into.  A bounded sample is fitted, all
texts are scored in one pass with the broadcast weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import staged, table
from threadlake.llm.words import Words, freed, slices

#: Most positive and most unlabelled rows that are fitted, and intervals of a feature.
SAMPLE, BINS = 20_000, 16
#: Strength of the L2 penalty, steps of a fit, their size at first, and over how much risk the non-negative part bends.
L2, STEPS, RATE, BEND = 1e-4, 400, 0.03, 1e-2
#: Least share of good texts in the sets that the prior is estimated on, and by how many standard errors the estimate is drawn down:
#: too high a prior lets as many bad texts pass, one that is too low loses nothing while it is over half of the true one.
LEAST_SHARE, ERRORS = 0.5, 3.0

_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_BYTES = 256


def _kinds() -> np.ndarray:
    """The kind of each byte: signs one by one, then upper-case, lower-case, digits, line feeds, other space, other control, non-ASCII."""
    kind = np.full(_BYTES, len(_SIGNS) + 6)
    for i, c in enumerate(_SIGNS):
        kind[ord(c)] = i
    for k, some in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "\n", " \t\x0b\x0c\r")):
        kind[[ord(c) for c in some]] = len(_SIGNS) + k
    for b in range(32):
        if chr(b) not in "\n\t\x0b\x0c\r":
            kind[b] = len(_SIGNS) + 5
    return kind


_KIND = _kinds()
KINDS = len(_SIGNS) + 7
#: Features besides the kinds: bytes, words, mean and largest bytes of a word, distinct words, distinct pairs, most frequent word, words that begin or end with a sign, words without a letter, lines, distinct lines, words of a line.
MORE = 12


def _of_sorted(codes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of distinct codes and of the most frequent one's places, for each text."""
    order = np.lexsort((codes, text))
    c, t = codes[order], text[order]
    first = np.ones(len(c), dtype=bool)
    first[1:] = (c[1:] != c[:-1]) | (t[1:] != t[:-1])
    starts = np.flatnonzero(first)
    sizes, most = np.diff(np.append(starts, len(c))), np.zeros(n)
    np.maximum.at(most, t[starts], sizes)
    return np.bincount(t[starts], minlength=n), most


def features(texts: pa.Array) -> np.ndarray:
    """A row of KINDS + MORE numbers for each text; null and empty texts have zeros."""
    words, n = Words(texts), len(texts)
    size = np.diff(words.offsets)
    owner = np.repeat(np.arange(n), size)
    kind = _KIND[words.data]
    out = np.zeros((n, KINDS + MORE))
    out[:, :KINDS] = np.bincount(owner * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS)
    count = words.counts()
    of = np.repeat(np.arange(n), count)
    length = words.end - words.begin
    per = lambda x: x / np.maximum(count, 1)
    distinct, most = _of_sorted(words.code, of, n)
    pairs = words.grams(2)
    whole = of[1:] == of[:-1]
    two, _ = _of_sorted(pairs[whole], of[1:][whole], n)
    sign = kind < len(_SIGNS)
    letters = np.concatenate(([0], np.cumsum((kind == len(_SIGNS)) | (kind == len(_SIGNS) + 1) | (kind == len(_SIGNS) + 6))))
    edge = sign[words.begin] | sign[words.end - 1] if len(of) else np.zeros(0, bool)
    bare = letters[words.end] == letters[words.begin] if len(of) else np.zeros(0, bool)
    longest = np.zeros(n)
    np.maximum.at(longest, of, length)
    # a line's code is the sum of its words' codes by place; empty lines don't count
    breaks = np.cumsum(words.data == 10)
    line = breaks[words.begin] if len(of) else np.zeros(0, np.int64)
    begins = np.ones(len(of), dtype=bool)
    begins[1:] = (line[1:] != line[:-1]) | (of[1:] != of[:-1])
    starts = np.flatnonzero(begins)
    place = np.arange(len(of)) - np.repeat(starts, np.diff(np.append(starts, len(of))))
    sums = np.add.reduceat(words.code * (2 * place.astype(np.uint64) + np.uint64(1)), starts) if len(of) else np.zeros(0, np.uint64)
    lines = np.bincount(of[starts], minlength=n)
    other, _ = _of_sorted(sums, of[starts], n)
    shares = out[:, :KINDS] / np.maximum(size, 1)[:, None]
    out[:, :KINDS] = shares
    out[:, KINDS:] = np.column_stack([
        np.log1p(size), np.log1p(count), per(np.bincount(of, length, n)), np.log1p(longest), per(distinct), two / np.maximum(count - 1, 1), per(most),
        per(np.bincount(of, edge, n)), per(np.bincount(of, bare, n)), np.log1p(lines), other / np.maximum(lines, 1), count / np.maximum(lines, 1),
    ])
    return out


@dataclass
class Model:
    """Cuts of each feature's intervals, a weight for each interval, the intercept, and the estimated prior."""

    cuts: list[np.ndarray]
    weights: np.ndarray
    intercept: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.weights[places(self.cuts, x)].sum(axis=1) + self.intercept)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def cut_places(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Cuts between equal parts of each column's different values and of its rows."""
    some = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.concatenate([np.quantile(c, some), np.quantile(np.unique(c), some)])) for c in x.T]


def places(cuts: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """The number of the interval of each value, counted over all columns."""
    starts = np.concatenate(([0], np.cumsum([len(c) + 1 for c in cuts])[:-1]))
    return np.column_stack([np.searchsorted(c, x[:, i], side="right") + starts[i] for i, c in enumerate(cuts)]).astype(np.int32)


class _Fit:
    """Weights of intervals by gradients with steps of falling size, scaled for each weight by its gradients so far."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, size: int):
        self.p, self.u, self.size = positive, unlabelled, size

    def margins(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return w[self.p].sum(axis=1) + w[-1], w[self.u].sum(axis=1) + w[-1]

    def back(self, of_p: np.ndarray, of_u: np.ndarray) -> np.ndarray:
        """The gradient by the weights of gradients by the margins."""
        out = np.zeros(self.size + 1)
        for at, g in ((self.p, of_p), (self.u, of_u)):
            out[:-1] += np.bincount(at.ravel(), np.repeat(g, at.shape[1]), self.size)
            out[-1] += g.sum()
        return out

    def run(self, slope, w: np.ndarray, steps: int = STEPS, rate: float = RATE) -> np.ndarray:
        """Weights after the steps from w on; slope gives the gradients by both margins."""
        mean, square = np.zeros(self.size + 1), np.zeros(self.size + 1)
        for t in range(1, steps + 1):
            g = self.back(*slope(*self.margins(w))) + L2 * np.append(w[:-1], 0)
            mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
            size = rate * 0.5 * (1 + np.cos(np.pi * (t - 1) / steps))
            w = w - size * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-9)
        return w


def estimate_prior(good: np.ndarray, unlabelled: np.ndarray) -> float:
    """The smallest ratio of the shares of unlabelled and of good texts at or over a score, less a margin for chance."""
    levels = np.unique(np.quantile(good, np.linspace(0, 1 - LEAST_SHARE, 501)))
    share = lambda x: 1 - np.searchsorted(np.sort(x), levels, side="left") / len(x)
    g, u = share(good), share(unlabelled)
    margin = ERRORS * (np.sqrt(u * (1 - u) / len(unlabelled)) + u / np.maximum(g, 1e-9) * np.sqrt(g * (1 - g) / len(good)))
    return float(np.clip(np.min((u - margin) / np.maximum(g, 1e-9)), 0.01, 0.99))


def risk_parts(prior: float, at_p: np.ndarray, at_u: np.ndarray) -> tuple[float, float]:
    """The sigmoid risk on good texts, and that on bad ones as unlabelled less good ones."""
    return prior * float(_sigmoid(-at_p).mean()), float(_sigmoid(at_u).mean() - prior * _sigmoid(at_p).mean())


def fit(good: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """Features of good and of unlabelled texts to a model; the prior is estimated if it isn't given.

    Without good texts all score 0, without unlabelled ones 1.
    """
    if not len(good) or not len(unlabelled):
        return Model([np.zeros(0)] * (KINDS + MORE), np.zeros(KINDS + MORE), 35.0 if len(good) else -35.0, float(len(good) > 0))
    cuts = cut_places(np.concatenate([good, unlabelled]))
    size = sum(len(c) + 1 for c in cuts)
    both = _Fit(places(cuts, good), places(cuts, unlabelled), size)
    n_p, n_u = len(good), len(unlabelled)
    # good against unlabelled text, by logistic loss; halves judge each other, as a fit flatters the rows it has seen
    sides, nothing = [], np.zeros(size + 1)
    for k in (0, 1):
        half = _Fit(both.p[k::2], both.u[k::2], size)
        enough = len(half.p) and len(half.u)
        sides.append(half.run(lambda a, b, h=half: (-0.5 * _sigmoid(-a) / len(h.p), 0.5 * _sigmoid(b) / len(h.u)), nothing, STEPS // 2) if enough else nothing)
    if prior is None:
        prior = estimate_prior(*(np.concatenate([w[x[1 - k :: 2]].sum(axis=1) + w[-1] for k, w in enumerate(sides)]) for x in (both.p, both.u)))

    def slope(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = float(_sigmoid(np.array(risk_parts(prior, a, b)[1] / BEND)))  # max(0, risk on bad texts), bent
        of_p, of_u = _sigmoid(a) * _sigmoid(-a) / n_p, _sigmoid(b) * _sigmoid(-b) / n_u
        return -prior * (1 + counts) * of_p, counts * of_u

    w = both.run(slope, (sides[0] + sides[1]) / 2)
    return Model(cuts, w[:-1], float(w[-1]), prior)


_KEPT = "part int, x array<double>"


def _featured(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            x = features(part.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["part", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE, prior: float | None = None) -> Model:
    """docs (doc_id, text), labels (doc_id, quality); held_out is over doc_id.

    Held-out rows take no part, with or without a label.  At most ``sample`` good rows and as many of all others and them are fitted, those
    whose hashed ids are smallest; rows with a null id are left out, of labels and texts that repeat an id the greatest counts.
    """
    learn = lambda df: df.where(F.col("doc_id").isNotNull() & ~held_out)
    good = learn(labels).groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    ids = learn(docs).select("doc_id").distinct()
    pick = lambda df, seed: df.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)
    good = pick(good.join(ids, "doc_id", "left_semi"), "good").select("doc_id", F.lit(0).alias("part"))
    picked = staged(good.unionByName(pick(ids, "all").select("doc_id", F.lit(1).alias("part"))), "sample")
    rows = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "part").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    kept = rows.select("part", "text").mapInArrow(freed(_featured), _KEPT).toArrow()  # at most 2 * sample rows
    part = kept["part"].to_numpy()
    x = kept["x"].combine_chunks().flatten().to_numpy().reshape(len(part), KINDS + MORE) if len(part) else np.zeros((0, KINDS + MORE))
    order = np.lexsort((*x.T[::-1], part))  # whatever the order of tasks
    x, part = x[order], part[order]
    mix = np.random.default_rng(0).permutation(len(part))
    x, part = x[mix], part[mix]
    return fit(x[part == 0], x[part == 1], prior)


def _scorer(model):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                p = np.round(model.value.score(features(part.column(1))), 6)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(p)], names=["doc_id", "held_out", "score"])

    return freed(run)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, prior: float | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    held_out is whether the checksum of the id, as text, is divisible by ``folds``; nothing is learned from such rows (a null id is not held out, and has no label).
    predicted is 1 where the score reaches the threshold.  Null and empty texts are scored like any other, by zeros.  Rows are
    scored one by one, so repeated and null ids come back as they are.  Without positives all score 0.  Other columns are not read.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels.select("doc_id", "quality"), held, sample, prior))
    return docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op13_quality(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
