"""Removal of word passages that an earlier document has, by suffix automata.

A window is ``length`` consecutive words.  Documents with one word sequence are one class: its
smallest id speaks for it, and all words of the others are in the first one.  The rest goes in
rounds over the windows that are not decided yet:

1. each window has an anchor, its smallest k-gram hash.  Windows whose anchor is in one
   document only are unique and drop out;
2. the windows of an anchor meet at its home, the document with the smallest id that has it.
   Windows of that document are the reference; runs of windows of other documents with one home
   are streamed.  A home with many anchors is divided by anchors, so a long text is too;
3. the reference is cut into shards.  A bounded block of shards is broadcast, the pieces routed to
   it are streamed, what they give is written, and the broadcast is destroyed before the next.
   A worker builds a shard's suffix automaton when it first needs it;
   where the matching statistic reaches ``length``, the window is removed.

Other windows share a k-gram with their home but aren't there; they go to the next round, whose k-grams are
longer.  In the last one the gram is the window, so every repeated window has met the first
document that has it.  Anchors only say where to look: equality is decided by the automata, on 64-bit codes
of words.  Every round is grouped by keys whose rows aggregate map-side or are streamed, and each
streamed piece meets one shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import release, staged, table
from threadlake.llm.words import Words, freed, rolling, slices

#: Words of the k-grams that are anchors, for each round but the last, whose grams are whole windows.
GRAMS = (16, 32)
#: Anchors of a part of a home, words in a shard, and words in a block of shards that is broadcast.
PART_ANCHORS, SHARD_WORDS, BLOCK_WORDS = 1 << 10, 1 << 16, 1 << 22
#: Bytes of streamed pieces whose spans a worker remembers for each shard.
MEMO_BYTES = 4 << 20
#: Words that a window of the reference takes on average, for sizing shards and blocks; a block that turns out larger takes several passes.
WORDS_OF_ANCHOR = 40


def anchors(codes: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The smallest gram hash in the window from each word on."""
    low, size, width = rolling(codes, gram), 1, length - gram + 1
    if len(low) < width:
        return np.zeros(0, np.uint64)
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    over = width - size
    return np.minimum(low[: len(low) - over], low[over:]) if over else low


class SuffixAutomaton:
    """All substrings of some sequences of codes."""

    def __init__(self, sequences):
        self.next, self.link, self.length = [{}], [-1], [0]
        for s in sequences:
            last = 0
            for c in s:
                last = self._add(last, c)

    def _add(self, last: int, c: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        q = nexts[last].get(c)
        if q is not None and length[q] == length[last] + 1:
            return q
        fresh = -1
        if q is None:
            fresh = len(nexts)
            nexts.append({})
            link.append(0)
            length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = fresh
            p = link[p]
        if p < 0:
            return fresh
        q = nexts[p][c]
        if length[q] != length[p] + 1:
            copy = len(nexts)
            nexts.append(dict(nexts[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            link[q] = copy
            while p >= 0 and nexts[p].get(c) == q:
                nexts[p][c] = copy
                p = link[p]
            q = copy
        if fresh < 0:
            return q
        link[fresh] = q
        return fresh

    def matching(self, codes) -> list[int]:
        """For each code the length of the longest match that ends with it."""
        nexts, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for c in codes:
            while state and c not in nexts[state]:
                state = link[state]
                size = length[state]
            to = nexts[state].get(c)
            if to is not None:
                state, size = to, size + 1
            out.append(size)
        return out


def _class_of(codes: np.ndarray) -> bytes:
    return hashlib.blake2b(codes.tobytes(), digest_size=16).digest()


def _lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """(first, one past the last) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _profile(length: int, gram: int):
    """Of rows (doc_id, text): the number of words, the class and the distinct anchors."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("cls", pa.binary()), ("anchors", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column(1))
                low = anchors(words.code, length, gram).view(np.int64)
                cls, found = [], []
                for a, b in zip(words.ptr[:-1].tolist(), words.ptr[1:].tolist(), strict=True):
                    cls.append(_class_of(words.code[a:b]))
                    found.append(np.unique(low[a : b - length + 1]) if b - a >= length else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.counts(), pa.int64()), pa.array(cls, pa.binary()), _lists(found)], schema=schema)

    return freed(run)


def _anchored(length: int, gram: int):
    """Of undecided runs (doc, cls, start, codes): the distinct anchors."""
    schema = pa.schema([("doc", pa.int64()), ("cls", pa.binary()), ("start", pa.int64()), ("anchors", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            found = [np.unique(anchors(np.frombuffer(x.as_buffer(), np.uint64), length, gram).view(np.int64)) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _lists(found)], schema=schema)

    return freed(run)


def _of_texts(batches) -> Iterator[tuple]:
    """(doc, cls, start, codes, routes) of rows (doc_id, text, known: array of (cls, routes))."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column(1))
            for i, (a, b) in enumerate(zip(words.ptr[:-1].tolist(), words.ptr[1:].tolist(), strict=True)):
                cls = _class_of(words.code[a:b])
                known = part.column(2)[i].values
                for k, other in enumerate(known.field("cls").to_pylist()):
                    if other == cls:  # else another row with this id
                        yield part.column(0)[i].as_py(), cls, 0, words.code[a:b], known.field("routes")[k].values


def _of_runs(batches) -> Iterator[tuple]:
    """The same of undecided runs (doc, cls, start, codes, routes)."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield *(batch.column(k)[i].as_py() for k in range(3)), np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64), batch.column(4)[i].values


PIECES = "home long, doc long, cls binary, start long, codes binary, at_home boolean"


def _pieces(length: int, gram: int, read):
    """Runs of windows of one home; of windows at home, the first of equal ones."""
    schema = pa.schema([("home", pa.int64()), ("doc", pa.int64()), ("cls", pa.binary()), ("start", pa.int64()), ("codes", pa.binary()), ("at_home", pa.bool_())])

    def run(batches):
        out, size = [[] for _ in schema], 0
        for doc, cls, start, codes, routes in read(batches):
            low = anchors(codes, length, gram).view(np.int64)
            anchor, homes, owns = (routes.field(k).to_numpy(zero_copy_only=False) for k in ("anchor", "home", "at_home"))
            order = np.argsort(anchor)
            at = order[np.minimum(np.searchsorted(anchor, low, sorter=order), len(order) - 1)]
            take, home, own = anchor[at] == low, homes[at], owns[at]
            mine = np.flatnonzero(take & own)
            if len(mine):
                once = np.unique(rolling(codes, length)[mine], return_index=True)[1]
                take[mine] = False
                take[mine[once]] = True
            pos = np.flatnonzero(take)
            home, own = home[pos], own[pos]
            cuts = np.flatnonzero((np.diff(pos) != 1) | (np.diff(home) != 0) | (own[1:] != own[:-1])) + 1
            for part in np.split(np.arange(len(pos)), cuts) if len(pos) else []:
                a, b = int(pos[part[0]]), int(pos[part[-1]]) + length
                for column, x in zip(out, (int(home[part[0]]), doc, cls, start + a, codes[a:b].tobytes(), bool(own[part[0]])), strict=True):
                    column.append(x)
                size += b - a
            if size > 1 << 18:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)
                out, size = [[] for _ in schema], 0
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return freed(run)


RUNS = "doc long, cls binary, first long, past long, codes binary"


def _stream(length: int, shards):
    """Spans (doc, cls, first word, one past the last) of windows in the shard of their piece; those of other windows with their codes."""
    schema = pa.schema([("doc", pa.int64()), ("cls", pa.binary()), ("first", pa.int64()), ("past", pa.int64()), ("codes", pa.binary())])

    def run(batches):
        at, automaton, known, room = None, None, {}, 0
        for batch in batches:
            out = [[] for _ in schema]
            for i in range(batch.num_rows):
                shard = batch.column(0)[i].as_py()
                if shard != at:
                    automaton = known = None  # before the next one is built
                    at, automaton, known, room = shard, SuffixAutomaton(np.frombuffer(x, np.uint64).tolist() for x in shards.value.get(shard, ())), {}, MEMO_BYTES
                raw = batch.column(4)[i].as_py()
                spans = known.get(raw)
                if spans is None:
                    there = np.array(automaton.matching(np.frombuffer(raw, np.uint64).tolist()))[length - 1 :] >= length
                    spans = [(a, b + length - 1, None) for a, b in _runs(there)] + [(a, b + length - 1, raw[8 * a : 8 * (b + length - 1)]) for a, b in _runs(~there)]
                    if len(raw) <= room:
                        known[raw], room = spans, room - len(raw)
                start = batch.column(3)[i].as_py()
                for a, b, codes in spans:
                    for column, x in zip(out, (batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), start + a, start + b, codes), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return freed(run)


def _cut(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = [[], [], []]
                for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = (text or "").encode().split()  # at the six ASCII white-space bytes
                    n = len(words)
                    if spans:
                        cls = _class_of(Words(pa.array([text])).code)
                        keep = np.ones(n, dtype=bool)
                        for s in spans:
                            if s["cls"] == cls:
                                keep[s["first"] : s["past"]] = False
                        words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                    for column, x in zip(out, (n, n - len(words), b" ".join(words).decode()), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, f.type) for x, f in zip(out, list(schema)[1:], strict=True))], schema=schema)

    return freed(run)


def _routes(having: DataFrame, *key: str) -> tuple[DataFrame, int]:
    """(anchor, home, at_home) of the anchors that two documents have, for each key; and the number of such anchors.

    having: the key, whose first column is the document, and an anchor.
    """
    doc = key[0]
    common = having.groupBy("anchor").agg(F.min(doc).alias("low"), F.max(doc).alias("high")).where("low < high").select("anchor", "low")
    common = staged(common, "anchors")
    long = common.groupBy("low").agg(F.count("*").alias("n")).where(F.col("n") > PART_ANCHORS).select("low", F.ceil(F.col("n") / PART_ANCHORS).alias("parts"))
    part = F.pmod("anchor", F.coalesce("parts", F.lit(1)))
    common = common.join(long, "low", "left").select("anchor", "low", F.xxhash64("low", part).alias("home"))
    routed = having.join(common, "anchor").groupBy(*key).agg(F.collect_list(F.struct("anchor", "home", (F.col("low") == F.col(doc)).alias("at_home"))).alias("routes"))
    return staged(routed, "routes"), common.count()


def _passes(pieces: DataFrame, n_anchors: int, length: int) -> list[DataFrame]:
    """What the pieces give, a staged table (of RUNS) for each block of shards."""
    words = n_anchors * WORDS_OF_ANCHOR
    blocks, shards = max(1, -(-words // BLOCK_WORDS)), max(1, -(-words // SHARD_WORDS))
    shard = F.pmod(F.col("home"), F.lit(shards))
    # a block's pieces lie together, so each pass reads its own only
    pieces = pieces.select("*", shard.alias("shard"), F.pmod(shard, F.lit(blocks)).cast("int").alias("block")).drop("home")
    pieces = staged(pieces.hint("rebalance", "shard").sortWithinPartitions("block", "shard"), "pieces", by="block")
    sizes = pieces.where("at_home").groupBy("block").agg(F.sum(F.length("codes") / 8).alias("words"))
    found = []
    for block, total in sorted(sizes.toArrow().to_pandas().itertuples(index=False)):  # a row for each block
        turns = max(1, int(-(-total // BLOCK_WORDS)))
        for turn in range(turns):
            mine = pieces.where((F.col("block") == block) & (F.pmod(F.floor(F.col("shard") / blocks), F.lit(turns)) == turn))
            codes = mine.where("at_home").groupBy("shard").agg(F.collect_list("codes").alias("codes")).toArrow()
            reference = pieces.sparkSession.sparkContext.broadcast(dict(zip(codes["shard"].to_pylist(), codes["codes"].to_pylist(), strict=True)))
            streamed = mine.where("not at_home").select("shard", "doc", "cls", "start", "codes").sortWithinPartitions("shard")
            found.append(staged(streamed.mapInArrow(_stream(length, reference), RUNS), "runs"))
            reference.destroy()
    release(pieces)
    return found


def repeated_spans(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, what: array of (cls, first, past), for documents (doc_id, text) with words to remove."""
    grams = sorted({min(g, length) for g in (*GRAMS, length)})
    docs = docs.where("doc_id is not null")
    rows = staged(docs.mapInArrow(_profile(length, grams[0]), "doc_id long, n_words long, cls binary, anchors array<long>").where(F.col("n_words") >= length), "profiles")
    classes = staged(rows.groupBy("cls").agg(F.min("doc_id").alias("doc"), F.count("*").alias("size"), F.first("anchors").alias("anchors")), "classes")
    copied = staged(classes.where("size > 1").select("cls", "doc"), "copied")
    copies = rows.join(copied, "cls").where("doc_id > doc")
    spans = [staged(copies.select(F.col("doc_id").alias("doc"), "cls", F.lit(0).cast("long").alias("first"), F.col("n_words").alias("past")), "whole")]
    release(rows, copied)
    routes, n = _routes(classes.select("doc", "cls", F.explode("anchors").alias("anchor")), "doc", "cls")
    release(classes)
    # routes grow with the input, so they are never broadcast
    known = staged(routes.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("cls", "routes")).alias("known")), "known")
    release(routes)
    pieces = docs.join(known.hint("merge"), "doc_id").select("doc_id", "text", "known").mapInArrow(_pieces(length, grams[0], _of_texts), PIECES)
    runs = _passes(pieces, n, length)
    release(known)
    for gram in [*grams[1:], None]:
        spans += runs
        left = reduce(DataFrame.unionByName, runs).where("codes is not null").select("doc", "cls", F.col("first").alias("start"), "codes") if runs else None
        if gram is None or left is None or left.isEmpty():
            break
        having = left.mapInArrow(_anchored(length, gram), "doc long, cls binary, start long, anchors array<long>").select("doc", "cls", "start", F.explode("anchors").alias("anchor"))
        routes, n = _routes(having, "doc", "cls", "start")
        pieces = left.join(routes, ["doc", "cls", "start"]).select("doc", "cls", "start", "codes", "routes").mapInArrow(_pieces(length, gram, _of_runs), PIECES)
        runs = _passes(pieces, n, length)
        release(routes)
    removed = [s.where("codes is null").drop("codes") if "codes" in s.columns else s for s in spans]
    removed = reduce(DataFrame.unionByName, removed).groupBy(F.col("doc").alias("doc_id"))
    out = staged(removed.agg(F.collect_list(F.struct("cls", "first", "past")).alias("what")), "spans")
    release(*spans)
    return out


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for every row of docs.

    Removed are the words of windows of ``length`` words whose sequence also starts in
    a row with a smaller id; windows are judged on the input.  Words are runs of
    anything but ASCII white space, compared as they are; kept words are joined by one
    space.  Null, empty and short texts keep all words.  Rows that repeat an id don't
    count against each other.  Rows without an id take no part and keep all words.
    Other columns are not read.  An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = docs.join(repeated_spans(docs, length).hint("merge"), "doc_id", "left").select("doc_id", "text", "what")
    return marked.mapInArrow(_cut(length), "doc_id long, n_words long, n_removed long, kept_text string")


def op7_substring_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS p FROM d)),
r AS (SELECT doc_id, p FROM n JOIN (SELECT h, min(doc_id) AS low FROM n GROUP BY h) USING (h) WHERE low < doc_id),
c AS (SELECT doc_id, list_distinct(flatten(list(generate_series(p, p + 49)))) AS gone FROM r GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(generate_series(1, len(w)), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
