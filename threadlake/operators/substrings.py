"""Substring search over short or long texts: postings of positional character n-grams.

Every place of a text has one gram: two characters where both are Han, else three (fewer at the end).
Which one it is depends on the characters alone, so the grams within a query stand at the same places of every text that holds it.
Postings are made for blocks of texts, in one pass and without a shuffle, and stored in the order of grams; their numbers are packed by bytes.  A query reads those of
grams that cover it, and a gram's beginning where no whole gram does; so texts are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from threadlake.operators.blocks import binaries, changes, freed, pieces, unpacked

#: Characters of a block, about.
BLOCK = 2**21
#: First characters of ranges of Han script, and the ones after their last.
_HAN = np.array([0x2E80, 0x2FD6, 0x3005, 0x3006, 0x3007, 0x3008, 0x3021, 0x302A, 0x3038, 0x303C, 0x3400, 0x4DC0, 0x4E00, 0xA000, 0xF900, 0xFADA, 0x16FE2, 0x16FF2, 0x20000, 0x323B0], np.uint32)
_POSTINGS = "gram string, block long, docs binary, counts binary, positions binary"


@dataclass(frozen=True)
class GramIndex:
    """Stored postings and texts, which are a block and a place in it, and their keys.

    postings has gram, block, docs (differences of the places of the texts that have it, in order), counts (how often, for each) and
    positions (differences within each text).
    """

    keys: tuple[str, ...]
    postings: DataFrame
    texts: DataFrame


def _han(characters: np.ndarray) -> np.ndarray:
    return np.searchsorted(_HAN, characters, "right") % 2 == 1


def _grams(characters: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The gram of each place: its characters, each one more and in 21 bits; left is how many characters a place's text still has, with its own."""
    second, third = (np.zeros(len(characters), np.uint64) for _ in range(2))
    for k, to in ((1, second), (2, third)):
        to[:-k] = characters[k:] + np.uint64(1)
        to[left <= k] = 0
    if len(characters) and characters.max() >= _HAN[0]:
        han = _han(characters)
        third[:-1][han[:-1] & han[1:] & (left[:-1] > 1)] = 0
    return (characters + np.uint64(1)) << np.uint64(42) | second << np.uint64(21) | third


def _postings(texts: list[str], lengths: np.ndarray, block: int) -> pa.RecordBatch:
    """The postings of a block."""
    characters = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    doc = np.repeat(np.arange(len(texts)), lengths)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    found = pa.array(_grams(characters, lengths[doc] - pos)).dictionary_encode()
    # one sort by gram and place; places have the order of texts and positions
    order = found.indices.to_numpy().astype(np.uint64) << np.uint64(32) | np.arange(len(doc), dtype=np.uint64)
    order.sort()
    gram, at = (order >> np.uint64(32)).astype(np.int64), (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc, pos = doc[at], pos[at]
    new_gram = changes(gram)
    new_doc = new_gram | changes(doc)
    first = np.flatnonzero(new_doc)
    of_gram = np.flatnonzero(new_gram[first])  # among the first places of texts
    pos[1:] -= np.where(new_doc[1:], 0, pos[:-1])
    docs = doc[first]
    docs[1:] -= np.where(new_gram[first][1:], 0, docs[:-1])
    counts = np.diff(np.append(first, len(gram)))
    names = found.dictionary.to_numpy()[gram[first[of_gram]]]
    text = ["".join(chr(c - 1) for c in (g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF) if c) for g in names.tolist()]
    return pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(np.full(len(text), block)), binaries(docs, of_gram), binaries(counts, of_gram), binaries(pos, first[of_gram])], ["gram", "block", "docs", "counts", "positions"])


def _indexer(shape: str):
    """For rows of keys and folded: the postings of blocks, and their texts' keys and places."""
    schema, limit = to_arrow_schema(T._parse_datatype_string(shape)), BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32

        def filled(part: str, rows: int, columns: dict) -> pa.RecordBatch:
            columns = {"part": pa.array([part] * rows, pa.string())} | columns
            return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

        for batch in batches:
            texts = [t.decode("utf-8", "replace") for t in batch.column("folded").cast(pa.binary()).to_pylist()]
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            for start, piece in pieces(batch, lengths, limit):
                here = slice(start, start + piece.num_rows)
                found = _postings(texts[here], lengths[here], block)
                yield filled("grams", found.num_rows, {n: found.column(n) for n in found.schema.names})
                yield filled("texts", piece.num_rows, {"block": pa.array(np.full(piece.num_rows, block)), "place": pa.array(np.arange(piece.num_rows)), "key": piece.column("key")})
                block += 1

    return freed(run)


def _shape(key: str) -> str:
    return f"{_POSTINGS}, place long, key {key}, part string"


def store_grams(rows: DataFrame, keys: list[str], text: str, path: str) -> GramIndex:
    """Writes the index of a table's texts, whatever their case; a null text holds nothing."""
    read = rows.where(F.col(text).isNotNull()).select(F.struct(*keys).alias("key"), F.lower(text).alias("folded"))
    key = read.schema["key"].dataType.simpleString()
    made = read.mapInArrow(_indexer(_shape(key)), _shape(key)).sortWithinPartitions("part", "gram", "block")
    made.write.partitionBy("part").option("compression", "zstd").parquet(f"{path}/grams")
    return _open(rows.sparkSession, keys, key, path)


def open_grams(spark: SparkSession, keys: list[str], path: str) -> GramIndex:
    return _open(spark, keys, spark.read.parquet(f"{path}/grams").schema["key"].dataType.simpleString(), path)


def _open(spark: SparkSession, keys: list[str], key: str, path: str) -> GramIndex:
    stored = spark.read.schema(_shape(key)).parquet(f"{path}/grams")
    return GramIndex(tuple(keys), stored.where("part = 'grams'").select("gram", "block", "docs", "counts", "positions"), stored.where("part = 'texts'").select("block", "place", "key"))


def _parts(folded: str) -> list[tuple[int, str, bool]]:
    """(place, gram, whether it is whole) of grams that cover a query; its end may be covered by a gram's beginning only."""
    han = _han(np.array([ord(c) for c in folded], np.uint32)).tolist()
    grams = [(i, folded[i : i + 2] if all(han[i : i + 2]) and i + 1 < len(folded) else folded[i : i + 3]) for i in range(len(folded))]
    whole = [(i, g, True) for i, g in grams if len(g) == 3 or len(g) == 2 and all(han[i : i + 2])]
    out, reach = [], 0
    while reach < len(folded):
        best = max((w for w in whole if w[0] <= reach < w[0] + len(w[1])), key=lambda w: w[0] + len(w[1]), default=None)
        if best is None:  # no whole gram goes on: the first that is cut off by the end
            i = len(whole)
            best = (i, folded[i:], False)
        out.append(best)
        reach = best[0] + len(best[1])
    return out


def _docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, place of all texts of postings."""
    for batch in batches:
        found = [np.cumsum(unpacked(d)) for d in batch.column("docs").to_pylist()]
        blocks = np.repeat(batch.column("block").to_numpy(), [len(d) for d in found])
        yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(np.concatenate(found) if found else blocks)], ["block", "place"])


def _met(parts: list[tuple[int, str, bool]]):
    """For one block's postings of the parts' grams: block, place of the texts in which the parts follow each other."""

    def starts(r: dict) -> np.ndarray:
        docs, counts, pos = np.cumsum(unpacked(r["docs"])), unpacked(r["counts"]), np.cumsum(unpacked(r["positions"]))
        first = np.cumsum(counts) - counts
        before = np.concatenate(([0], pos))[first]
        return np.repeat(docs, counts) << 32 | (pos - np.repeat(before, counts))

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        of = {r["gram"]: starts(r) for r in rows}
        none = np.zeros(0, np.int64)
        met = None
        for place, gram, whole in parts:
            at = np.concatenate([none, *(s for g, s in of.items() if (g == gram if whole else g.startswith(gram)))])
            at = at[at & 0xFFFFFFFF >= place] - place
            met = at if met is None else np.intersect1d(met, at, assume_unique=True)
        docs = np.unique(met >> 32)
        return pa.table([pa.array(np.full(len(docs), rows[0]["block"])), pa.array(docs)], ["block", "place"])

    return run


def find_substring(index: GramIndex, q: str) -> DataFrame:
    """The keys of the texts that hold q, whatever the case; a key for each text."""
    spark = index.postings.sparkSession
    folded = spark.range(1).select(F.lower(F.lit(q))).first()[0]
    if not folded:
        raise ValueError("empty query")
    parts = _parts(folded)
    whole = sorted({g for _, g, w in parts if w})
    wanted: list[Column] = [F.col("gram").isin(whole)] if whole else []
    found = index.postings.where(reduce(Column.__or__, wanted + [F.col("gram").startswith(g) for _, g, w in parts if not w]))
    if len(parts) == 1:
        hits = found.select("block", "docs").mapInArrow(_docs, "block long, place long")
    else:
        hits = found.groupBy("block").applyInArrow(_met(parts), "block long, place long")
    return index.texts.join(hits, ["block", "place"], "left_semi").select(*(F.col("key").getField(k).alias(k) for k in index.keys))


def suggest_indexed(index: GramIndex, threads: DataFrame, q: str, per_forum: int = 5, total: int = 10) -> DataFrame:
    """As suggest, from an index of titles by archive and tid."""
    hits = threads.join(find_substring(index, q), ["archive", "tid"], "left_semi").select("archive", "forum_name", "tid", "title")
    place = F.row_number().over(W.partitionBy("forum_name").orderBy("archive", "tid"))
    return hits.withColumn("_p", place).where(F.col("_p") <= per_forum).drop("_p").orderBy("forum_name", "archive", "tid").limit(total)
