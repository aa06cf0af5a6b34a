"""Toxicity categories by a classifier chain of linear models.

Categories are predicted one after the other.  Each has a logistic model over the
words of a text and their prefixes (present or not) and the probabilities of the categories before it.
While training, those probabilities are out-of-fold predictions, so that a later
model sees what it will see on texts nobody labelled.  Models are fitted on a
bounded sample of labelled rows; vocabulary statistics of the sample come from Spark, and
every text is scored by broadcast weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import staged, table
from threadlake.llm.words import Words, freed, slices

#: Most labelled rows that are fitted, words of the vocabulary for each category, rows that a word needs, folds.
SAMPLE, VOCABULARY, LEAST, FOLDS = 20_000, 1_000, 3, 3
#: Bytes of the prefixes of words that are features.
PREFIXES = (4, 5, 6)
#: Strength of the L1 and L2 penalties, most steps of the fit, and the change of the weights that ends it earlier.
L1, L2, STEPS, STILL = 1e-3, 1e-4, 600, 1e-6


@dataclass
class Linear:
    """Weights of words, then of earlier categories, and the intercept."""

    words: np.ndarray
    earlier: np.ndarray
    intercept: float

    def predict(self, sums: np.ndarray, before: np.ndarray) -> np.ndarray:
        z = sums + before @ self.earlier + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class _Groups:
    """Sums of values by keys below n, for many arrays of values of the same keys."""

    def __init__(self, keys: np.ndarray, n: int):
        """keys ascend."""
        self.n, self.starts = n, np.flatnonzero(np.diff(keys, prepend=-1))
        self.keys = keys[self.starts]

    def sum(self, ordered: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(ordered):
            out[self.keys] = np.add.reduceat(ordered, self.starts)
        return out


def fit_linear(rows: np.ndarray, words: np.ndarray, n: int, size: int, before: np.ndarray, y: np.ndarray) -> Linear:
    """L1-regularised logistic regression on pairs (row, word), in the order of rows; both classes weigh the same.

    A word counts with the log ratio of its shares in the two classes, so that the penalty
    weighs least on words that tell most.  Without rows or with one class only the model answers that class always.
    """
    d = before.shape[1]
    if n == 0 or y.all() or not y.any():
        return Linear(np.zeros(size), np.zeros(d), 35.0 if n and y.all() else -35.0)
    of_true, of_all = np.bincount(words[y[rows]], minlength=size), np.bincount(words, minlength=size)
    ratio = np.log((of_true + 0.5) / (y.sum() + 1)) - np.log((of_all - of_true + 0.5) / (n - y.sum() + 1))
    weight = np.where(y, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    w = np.zeros(size + d + 1)
    look, t = w.copy(), 1.0
    # a bound of the curvature: power iteration on the weighted Gram matrix
    v = np.ones(size + d + 1)

    # the sparse matrix by rows and by columns
    order = np.argsort(words, kind="stable")
    by_row, by_word = _Groups(rows, n), _Groups(words[order], size)
    rows = rows[order]
    del order

    def forward(w):
        return by_row.sum((ratio * w[:size])[words]) + before @ w[size:-1] + w[-1]

    def back(r):
        return np.concatenate([ratio * by_word.sum(r[rows]), before.T @ r, [r.sum()]])

    for _ in range(20):
        v = back(weight * forward(v))
        scale = np.linalg.norm(v)
        v /= scale
    rate = 1 / (0.25 * 1.1 * scale + L2)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(forward(look), -35, 35)))
        step = look - rate * (back(weight * (p - y)) + L2 * look)
        fresh = np.sign(step) * np.maximum(np.abs(step) - rate * L1, 0)
        fresh[-1] = step[-1]  # the intercept is not shrunk
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        change = fresh - w
        look, w = fresh + (was - 1) / t * change, fresh
        if np.abs(change).max() <= STILL * max(1.0, np.abs(w).max()):
            break
    return Linear(ratio * w[:size], w[size:-1], float(w[-1]))


@dataclass
class Chain:
    """Sorted word hashes and one model for each category, in order."""

    categories: tuple[str, ...]
    vocabulary: np.ndarray
    models: list[Linear]

    def score(self, codes: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """Probabilities, a row for each text and a column for each category."""
        n = len(ptr) - 1
        rows, words = present(codes, ptr, self.vocabulary)
        out = np.zeros((n, 0))
        for model in self.models:
            p = model.predict(np.bincount(rows, model.words[words], n) if len(rows) else np.zeros(n), out)
            out = np.column_stack([out, p])
        return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of their first letters, so that a known stem counts with any ending."""
    return Words(texts, lower=True, letters=True).with_prefixes(*PREFIXES)


def present(codes: np.ndarray, ptr: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (text, place in the vocabulary)."""
    if not len(vocabulary) or not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, codes), len(vocabulary) - 1)
    hit = np.flatnonzero(vocabulary[at] == codes)
    rows = np.searchsorted(ptr, hit, side="right") - 1
    pairs = np.unique(rows * len(vocabulary) + at[hit])
    return pairs // len(vocabulary), pairs % len(vocabulary)


def _distinct_words():
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                codes, ptr = features(part.column(part.schema.get_field_index("text")))
                sets = [np.unique(codes[a:b]).view(np.int64) for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)]
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["fold", "y", "words"])

    return freed(run)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], sample: int = SAMPLE) -> Chain:
    """docs (doc_id, text), labels (doc_id and a 0/1 column for each category).

    At most ``sample`` labelled rows are fitted, those whose hashed ids are smallest.  Rows with a
    null id or label are left out; of labels that repeat an id the greatest of each category count, of
    documents that repeat an id the one with the greatest text.
    """
    fine = labels.dropna(subset=["doc_id", *categories]).groupBy("doc_id").agg(*(F.max(c).alias(c) for c in categories))
    picked = fine.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    truth = F.array(*(F.col(c).cast("int") for c in categories)).alias("y")
    rows = docs.join(F.broadcast(picked), "doc_id")
    if not rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        # one text for each id, so there are never more rows than the sample has
        rows = rows.groupBy("doc_id", *categories).agg(F.max("text").alias("text"))
    rows = rows.select(fold, truth, "text")
    rows = staged(rows.mapInArrow(_distinct_words(), "fold int, y array<int>, words array<long>"), "labelled")
    n = rows.count()
    counts = rows.select(F.explode("words").alias("word"), "y").groupBy("word").agg(F.count("*").alias("n"), *(F.sum(F.get("y", F.lit(i))).alias(f"n{i}") for i in range(len(categories)))).where(F.col("n") >= LEAST)
    positive = rows.agg(*(F.sum(F.get("y", F.lit(i))) for i in range(len(categories)))).first()
    chosen: set[int] = set()
    for i in range(len(categories)):
        expected = F.col("n") * F.lit((positive[i] or 0) / max(n, 1))
        gap = F.col(f"n{i}") - expected
        best = counts.where(expected > 0).orderBy(F.desc(gap * gap / (expected * (1 - F.col("n") / F.lit(n + 1.0)))), "word").limit(VOCABULARY)
        chosen.update(r[0] for r in best.select("word").collect())  # at most VOCABULARY words
    vocabulary = np.sort(np.array(sorted(chosen), dtype=np.int64).view(np.uint64))
    kept = rows.mapInArrow(_places(vocabulary), "fold int, y array<int>, places array<int>").toArrow()  # at most sample rows
    folds, y = kept["fold"].to_numpy(), np.array(kept["y"].to_pylist(), dtype=bool).reshape(-1, len(categories))
    lists = kept["places"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    at, words = np.repeat(np.arange(n, dtype=np.int32), sizes), lists.flatten().to_numpy().astype(np.int32)
    del kept, lists
    before, models = np.zeros((n, 0)), []
    for i in range(len(categories)):
        models.append(fit_linear(at, words, n, len(vocabulary), before, y[:, i]))
        unseen = np.zeros(n)
        for f in range(FOLDS) if i + 1 < len(categories) else ():
            inside = folds != f
            place = (np.cumsum(inside) - 1).astype(np.int32)
            use = inside[at]
            model = fit_linear(place[at[use]], words[use], int(inside.sum()), len(vocabulary), before[inside], y[inside, i])
            unseen[~inside] = model.predict(np.bincount(at, model.words[words], n), before)[~inside]
        before = np.column_stack([before, unseen])
    return Chain(categories, vocabulary, models)


def _places(vocabulary: np.ndarray):
    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            rows, words = present(lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy() - lists.offsets[0].as_py(), vocabulary)
            offsets = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(offsets), pa.array(words.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), places], names=["fold", "y", "places"])

    return freed(run)


def _scorer(chain):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                p = chain.value.score(*features(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.round(p[:, i], 6)) for i in range(p.shape[1]))], names=["doc_id", *(f"p_{c}" for c in chain.value.categories)])

    return freed(run)


def score_toxicity(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("low_quality", "toxic"), reject: str = "toxic", threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_<category> for each category, rejected (p of ``reject`` at or over the threshold), for every row of docs.

    Null and empty texts have no words.  Without labels, or with labels of one class
    only, a category's probability is about 0 or about 1 for all.  Rows are scored one by one, so
    repeated and null ids come back as they are.  Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chain = docs.sparkSession.sparkContext.broadcast(fit_chain(docs, labels, categories))
    kinds = ", ".join(f"p_{c} double" for c in categories)
    return docs.mapInArrow(_scorer(chain), f"doc_id long, {kinds}").withColumn("rejected", F.col(f"p_{reject}") >= threshold)


def given_labels(spark, sf_dir) -> DataFrame:
    """The labels table with a column for each category of the chain."""
    return table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op3_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), given_labels(spark, sf_dir))
