"""Full-text search over posts: a stored index of segments with blocks of postings, BM25 order and snippets.

Posts are numbered in the order of threads, and numbers cut into spans.  A block holds what one token has in one span, with its
number of posts, and the counts and lengths of its best posts, which bound what a span's posts can score.  A task makes the blocks of its own posts, so tokens are never shuffled, and
stores them in the order of tokens.  A query is
alternatives of required and excluded phrases.  It reads the heads of its own tokens' blocks, as each file is in the order of
tokens, then the blocks of the most promising spans; the scores found there rule out the spans that can't reach them.
The text of posts is read only for the snippets of one page.

An index is made of immutable segments.  Posts that are new or changed come into a further segment, and what they replace is
listed as deleted; small segments are merged when there are too many.  Sums of row hashes for each bucket of threads tell which
buckets have changed since.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlake.functions.scalars import frag_text, parse_frags
from threadlake.operators.blocks import changes, freed, pieces
from threadlake.sources.places import stored
from threadlake.sources.runs import Manifests

K1, B, FLOOR = 1.2, 0.75, 1e-6
SNIPPET = 32
_TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def _diacritics() -> tuple[str, str]:
    """Latin letters with marks, and the letters without, from Unicode's decompositions."""
    marked, bare = [], []
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(c))
        if len(parts) > 1 and parts[0].isascii():
            marked.append(chr(c))
            bare.append(parts[0])
    return "".join(marked), "".join(bare)


_MARKED, _BARE = _diacritics()


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, Latin letters without their marks."""
    # a text of ASCII has no marks
    bare = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(F.lower(F.translate(text, _MARKED, _BARE)), _MARKED, _BARE))
    return F.regexp_extract_all(bare, F.lit(_TOKEN), 0)


def _query_tokens(word: str) -> list[str]:
    plain = word.translate(str.maketrans(_MARKED, _BARE)).lower().translate(str.maketrans(_MARKED, _BARE))
    return ["".join(t) for t in re.findall(r"[^\W_]+", plain)]


def searched_text(contents: Column, mode: str = "text") -> Column:
    """What is searched: readable text of the fragments, or the stored text as it is (mode raw)."""
    if mode not in ("text", "raw"):
        raise ValueError("mode is text or raw")
    return F.coalesce(contents if mode == "raw" else frag_text(parse_frags(contents)), F.lit(""))


def build_search_index(posts: DataFrame, mode: str = "text", *more: str) -> DataFrame:
    """archive, tid, post_id, floor, tokens, n_tokens, and further columns of posts; a projection without a shuffle."""
    read = posts.select("archive", "tid", F.col("id").alias("post_id"), "floor", searched_text(F.col("contents"), mode).alias("_text"), *more)
    made = read.select("archive", "tid", "post_id", "floor", tokens(F.col("_text")).alias("tokens"), *more)
    return made.withColumn("n_tokens", F.size("tokens").cast("bigint"))


def postings(index: DataFrame) -> DataFrame:
    """archive, tid, post_id, pos, token."""
    return index.select("archive", "tid", "post_id", F.posexplode("tokens").alias("pos", "token"))


def index_is_current(index: DataFrame, posts: DataFrame) -> DataFrame:
    """One row: whether the index has as many rows as the posts."""
    return index.agg(F.count("*").alias("indexed")).withColumn("posts", posts.agg(F.count("*")).scalar()).withColumn("current", F.col("indexed") == F.col("posts"))


#: Bits of a post's number within its span; buckets of fingerprints; segments of an index from which on small ones are merged.
SPAN, BUCKETS, SEGMENTS = 6, 256, 8
#: Tokens whose blocks are made at once, about.
AT_ONCE = 2**18
_BLOCKS = "token string, segment int, span long, n long, front array<struct<count:long,length:long>>, entries array<struct<doc long, n_tokens long, positions array<int>>>"
#: Spans that are read first, to learn what the best posts score; a page's posts are a few spans more.
FIRST_SPANS = 16
#: Marks of deleted posts that may be broadcast, some 16 MB; a mark has the bits of 64 posts whose numbers follow each other.
BROADCAST_ROWS = 500_000
_POST = ["archive", "tid", "post_id"]


def _bucket() -> Column:
    return F.pmod(F.xxhash64("archive", "tid"), F.lit(BUCKETS)).cast("int")


def fingerprints(rows: DataFrame) -> DataFrame:
    """bucket, n, high, low, mixed of rows (archive, tid, row_hash): sums and the exclusive or of row hashes, which can be added and taken away."""
    h = F.col("row_hash")
    return rows.groupBy(_bucket().alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.shiftright(h, 32)).alias("high"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.bit_xor(h).alias("mixed"))


def _hashed(posts: DataFrame) -> DataFrame:
    return posts.withColumn("row_hash", F.xxhash64("archive", "tid", "id", "floor", "contents"))


@dataclass(frozen=True)
class SearchIndex:
    """A stored index as of one commit.

    posts has segment, doc, archive, tid, post_id, floor, tokens, n_tokens, row_hash, in the order of threads; postings has token, segment, span (its first post's doc), n, front (count, length), entries (doc, n_tokens, positions), and
    most and least, the ends of front, each file in the order of tokens; removed has segment, doc, token of posts that no longer count.
    """

    spark: SparkSession
    path: str
    manifest: dict

    def _read(self, folders: list[str], table: str, shape: str) -> DataFrame:
        return self.spark.read.schema(shape).parquet(*(f"{self.path}/segments/{f}/{table}" for f in folders)) if folders else self.spark.createDataFrame([], shape)

    @property
    def posts(self) -> DataFrame:
        return self._read([s["folder"] for s in self.manifest["segments"]], "posts", "segment int, doc long, archive string, tid long, post_id long, floor long, tokens array<string>, n_tokens long, row_hash long")

    @property
    def postings(self) -> DataFrame:
        return self._read([s["folder"] for s in self.manifest["segments"]], "postings", _BLOCKS).withColumns({"most": F.get("front", F.lit(0))["count"], "least": F.element_at("front", -1)["length"]})

    @property
    def removed(self) -> DataFrame:
        return self._read(self.manifest["removed"], "removed", "segment int, doc long, token string")

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows (segment, doc, ...) without those of removed posts."""
        if not self.manifest["removed"]:
            return rows
        return self.marked(rows, self.removed, self.manifest["gone"], "left").where("_marks is null or getbit(_marks, doc & 63) = 0").drop("_group", "_marks")

    def marked(self, rows: DataFrame, gone: DataFrame, n: int, how: str = "inner") -> DataFrame:
        """rows (segment, doc, ...) with the marks of gone, n posts (segment, doc), that lie with them; rows are not shuffled, unless there are too many marks."""
        group = F.shiftright("doc", 6).alias("_group")
        marks = gone.groupBy("segment", group).agg(F.bit_or(F.expr("shiftleft(1L, CAST(doc & 63 AS INT))")).alias("_marks"))
        most = min(n, sum(s["posts"] for s in self.manifest["segments"]) >> 6)
        return rows.select("*", group).join(F.broadcast(marks) if most <= BROADCAST_ROWS else marks, ["segment", "_group"], how)

    @property
    def statistics(self) -> tuple[int, int]:
        """Numbers of posts and of their tokens."""
        return self.manifest["posts"], self.manifest["tokens"]


def _blocks_of(posts: pa.RecordBatch, number: int) -> pa.RecordBatch:
    """The blocks of some posts (doc, n_tokens, tokens), in the order of numbers; a span that was cut is two.

    front has the counts and lengths of the posts that no other post of the block beats in both: one of them has the best score, whatever the average length is.
    """
    doc, length = posts.column("doc").to_numpy(), posts.column("n_tokens").to_numpy()
    firsts = changes(doc >> SPAN)
    span = doc[firsts][np.cumsum(firsts) - 1]
    found = posts.column("tokens").flatten().dictionary_encode()
    per_post = posts.column("tokens").value_lengths().to_numpy()
    post = np.repeat(np.arange(len(doc)), per_post)
    pos = (np.arange(len(post)) - np.repeat(np.cumsum(per_post) - per_post, per_post)).astype(np.int32)
    # one sort by token and place; places have the order of spans, posts and positions
    order = found.indices.to_numpy().astype(np.uint64) << np.uint64(32) | np.arange(len(post), dtype=np.uint64)
    order.sort()
    token, at = (order >> np.uint64(32)).astype(np.int64), (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
    post = post[at]
    new_block = changes(token, span[post])
    first = np.flatnonzero(new_block | changes(post))  # of entries, among places
    block = np.flatnonzero(new_block[first])  # of blocks, among entries
    counts, posts_of = np.diff(np.append(first, len(post))), np.diff(np.append(block, len(first)))
    post, lengths = post[first], length[post[first]]
    # the best by count, and of further ones those that are shorter than all before
    of = np.repeat(np.arange(len(block)), posts_of)
    best = np.lexsort((lengths, -counts, of))
    shorter = lengths[best] - of * (int(lengths.max(initial=0)) + 1)  # less in each block than in those before
    kept = best[np.concatenate((np.ones(min(len(best), 1), bool), shorter[1:] < np.minimum.accumulate(shorter)[:-1]))]
    front = np.concatenate(([0], np.cumsum(np.bincount(of[kept], minlength=len(block)))))
    lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
    entries = pa.StructArray.from_arrays([pa.array(doc[post]), pa.array(lengths), lists(np.append(first, len(pos)), pa.array(pos[at]))], ["doc", "n_tokens", "positions"])
    bests = pa.StructArray.from_arrays([pa.array(counts[kept]), pa.array(lengths[kept])], ["count", "length"])
    columns = {
        "token": found.dictionary.take(pa.array(token[first[block]])), "segment": pa.array(np.full(len(block), number, np.int32)), "span": pa.array(span[post[block]]), "n": pa.array(posts_of),
        "front": lists(front, bests), "entries": lists(np.append(block, len(first)), entries),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _blocks(posts: DataFrame, number: int) -> DataFrame:
    """The blocks of a segment's posts, which lie in their files in the order of numbers; no shuffle."""
    at_once = AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("doc").to_numpy() >> SPAN
            firsts = np.flatnonzero(changes(spans))
            # a span counts at its first post, so that none is cut
            sizes = np.zeros(len(spans), np.int64)
            if len(firsts):
                sizes[firsts] = np.add.reduceat(batch.column("n_tokens").to_numpy(), firsts)
            for _, piece in pieces(batch, sizes, at_once):
                yield _blocks_of(piece, number)

    return posts.select("doc", "n_tokens", "tokens").mapInArrow(freed(run), _BLOCKS)


def _write_segment(rows: DataFrame, folder: str, number: int, made: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[int, int]:
    """Writes a segment of rows, of which ``made`` makes the posts table (without numbers); returns its numbers of posts and tokens.

    Rows are put in order before, as a text is less to move than its tokens.  A block has the posts of one span, so a token that many posts have is spread over many blocks and files.
    """
    spark = rows.sparkSession
    key = ["archive", "tid", "id" if "id" in rows.columns else "post_id"]
    ordered = made(rows.repartitionByRange(*key).sortWithinPartitions(*key))
    packed = lambda df: df.write.option("compression", "zstd")
    packed(ordered.select(F.lit(number).alias("segment"), F.monotonically_increasing_id().alias("doc"), *_POST, "floor", "tokens", "n_tokens", "row_hash")).parquet(f"{folder}/posts")
    posts = spark.read.parquet(f"{folder}/posts")
    packed(_blocks(posts, number).sortWithinPartitions("token", "span")).parquet(f"{folder}/postings")
    n, tokens_ = posts.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    return n, tokens_


def store_index(posts: DataFrame, path: str, mode: str = "text") -> SearchIndex:
    """Writes the index of the posts, as one segment; what was in ``path`` is replaced."""
    manifests = Manifests(posts.sparkSession, path)
    last = manifests.last() or {"run": 0}
    empty = {"run": last["run"], "mode": mode, "segments": [], "removed": [], "gone": 0, "posts": 0, "tokens": 0}
    return _extended(SearchIndex(posts.sparkSession, path.rstrip("/"), empty), _hashed(posts), None)


def open_index(spark: SparkSession, path: str) -> SearchIndex:
    manifest = Manifests(spark, path).last()
    if manifest is None:
        raise FileNotFoundError(f"no index in {path}")
    return SearchIndex(spark, path.rstrip("/"), manifest)


def index_currency(index: SearchIndex, posts: DataFrame) -> DataFrame:
    """bucket, indexed, posts, current for each bucket of threads, by the fingerprints of both: a changed post tells even where the numbers are equal."""
    old = fingerprints(index.live(index.posts.select("segment", "doc", "archive", "tid", "row_hash")))
    both = old.join(fingerprints(_hashed(posts)).select("bucket", *(F.col(c).alias(f"_{c}") for c in ("n", "high", "low", "mixed"))), "bucket", "full_outer")
    same = F.coalesce((F.col("n") == F.col("_n")) & (F.col("high") == F.col("_high")) & (F.col("low") == F.col("_low")) & (F.col("mixed") == F.col("_mixed")), F.lit(False))
    return both.select("bucket", F.coalesce("n", F.lit(0)).alias("indexed"), F.coalesce("_n", F.lit(0)).alias("posts"), same.alias("current"))


def extend_index(index: SearchIndex, posts: DataFrame) -> SearchIndex:
    """The index brought up to the posts as they are now, by one further segment; the same index where nothing has changed.

    Only buckets whose fingerprints differ are compared row by row, on keys and hashes.
    """
    due = [r.bucket for r in index_currency(index, posts).where("not current").collect()]  # at most BUCKETS
    if not due:
        return index
    rows = _hashed(posts).where(_bucket().isin(due))
    have = index.live(index.posts.select("segment", "doc", *_POST, "row_hash").where(_bucket().isin(due)))
    key = [F.col(a) == F.col(b) for a, b in (("archive", "_archive"), ("tid", "_tid"), ("id", "_id"), ("row_hash", "_hash"))]
    known = lambda df, names: df.select(*(F.col(c).alias(n) for c, n in zip(names, ("_archive", "_tid", "_id", "_hash"), strict=True)))
    fresh = rows.join(known(have, [*_POST, "row_hash"]), key, "left_anti")
    gone = have.withColumnRenamed("post_id", "id").join(known(rows, ["archive", "tid", "id", "row_hash"]), key, "left_anti").select("segment", "doc")
    return _extended(index, stored(fresh, "fresh"), stored(gone, "gone"))


def _extended(index: SearchIndex, fresh: DataFrame, gone: DataFrame | None) -> SearchIndex:
    """Commits a segment of fresh posts, and the posts that are gone; merges small segments when there are too many."""
    m, spark = dict(index.manifest), index.spark
    m |= {"run": m["run"] + 1, "segments": list(m["segments"]), "removed": list(m["removed"])}
    folder = f"{m['run']:08d}-{uuid.uuid4().hex}"
    if gone is not None:
        old = index.marked(index.posts.select("segment", "doc", "tokens", "n_tokens"), gone, gone.count()).where("getbit(_marks, doc & 63) = 1")
        words = old.select("segment", "doc", F.explode_outer(F.array_distinct("tokens")).alias("token"))
        words.repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{index.path}/segments/{folder}/removed")
        n, less = old.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
        if n:
            m |= {"removed": [*m["removed"], folder], "gone": m["gone"] + n, "posts": m["posts"] - n, "tokens": m["tokens"] - less}
    n, more = _write_segment(fresh, f"{index.path}/segments/{folder}", m["run"], lambda rows: build_search_index(rows, m["mode"], "row_hash"))
    m |= {"segments": [*m["segments"], {"folder": folder, "number": m["run"], "posts": n}], "posts": m["posts"] + n, "tokens": m["tokens"] + more}
    if len(m["segments"]) > SEGMENTS:
        m = _merged(SearchIndex(spark, index.path, m))
    Manifests(spark, index.path).put(m, m["run"])
    return SearchIndex(spark, index.path, m)


def _merged(index: SearchIndex) -> dict:
    """The manifest with all segments but the largest as one, from their stored tokens; posts that are gone from them leave the lists."""
    m = dict(index.manifest)
    largest = max(m["segments"], key=lambda s: s["posts"])
    small = [s["number"] for s in m["segments"] if s is not largest]
    # a new number, as those of its posts start anew
    number, folder = m["run"] * 2**12 + 1, f"{m['run']:08d}-{uuid.uuid4().hex}"
    rows = index.live(index.posts.where(F.col("segment").isin(small)))
    n, _ = _write_segment(rows.drop("segment", "doc"), f"{index.path}/segments/{folder}", number)
    left = index.removed.where(~F.col("segment").isin(small))
    left.repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{index.path}/segments/{folder}/removed")
    gone = left.select("doc").distinct().count()
    return m | {"segments": [largest, {"folder": folder, "number": number, "posts": n}], "removed": [folder] if gone else [], "gone": gone}


@dataclass(frozen=True)
class Phrase:
    """Tokens that follow each other; with ``prefix`` the last one may go on."""

    tokens: tuple[str, ...]
    prefix: bool = False

    def fits(self, token: Column, i: int) -> Column:
        return token.startswith(self.tokens[i]) if self.prefix and i == len(self.tokens) - 1 else token == self.tokens[i]


@dataclass(frozen=True)
class Alternative:
    """What a post must have all of, and none of."""

    required: tuple[Phrase, ...]
    excluded: tuple[Phrase, ...] = ()


def alternatives(query: str) -> list[Alternative]:
    """Words and "phrases" (all needed), prefix*, NOT before what is excluded, OR between alternatives.

    A bare word of several tokens is a phrase.  There are no parentheses: write what they stand for as alternatives.
    """
    out, required, excluded, negative = [], [], [], False
    words = re.findall(r'"[^"]*"\*?|[^\s"]+', query)
    if any(set(w) & set("()") for w in words if not w.startswith('"')):
        raise ValueError("parentheses have no meaning in a query")
    for w in [*words, "OR"]:
        if w == "OR":
            if required:
                out.append(Alternative(tuple(required), tuple(excluded)))
            required, excluded, negative = [], [], False
        elif w == "NOT":
            negative = True
        elif w != "AND" and (found := tuple(_query_tokens(w))):
            (excluded if negative else required).append(Phrase(found, w.endswith("*")))
            negative = False
    if not out:
        raise ValueError("empty query")
    return out


class _Asked:
    """A query against an index: its phrases, the heads of their blocks, and what posts have of them."""

    def __init__(self, index: SearchIndex, query: str | list[Alternative]):
        self.index, self.asked = index, alternatives(query) if isinstance(query, str) else list(query)
        self.scored = list(dict.fromkeys(p for a in self.asked for p in a.required))
        self.phrases = list(dict.fromkeys([*self.scored, *(p for a in self.asked for p in a.excluded)]))
        token = F.col("token")
        self.places = [(n, i, p.fits(token, i)) for n, p in enumerate(self.phrases) for i in range(len(p.tokens))]
        self.own = reduce(Column.__or__, (fits for *_, fits in self.places))
        self.plain = [len(p.tokens) == 1 and not p.prefix for p in self.phrases]
        self.n, total = index.statistics
        self.average = total / self.n if self.n else 1.0
        #: What posts have of all phrases, where their numbers of posts had to be counted so.
        self.met: DataFrame | None = None

    def roles(self, of: list[int] | None = None) -> Column:
        """The phrases, and places in them, that a token has; only phrases ``of``, if given."""
        return F.array_compact(F.array(*(F.when(fits, F.struct(F.lit(n).alias("phrase"), F.lit(i).alias("place"))) for n, i, fits in self.places if of is None or n in of)))

    def heads(self) -> DataFrame:
        """segment, span, and for each phrase the number of its posts and bounds of its counts and of their lengths; null where it can't be."""
        heads = self.index.postings.where(self.own).select("segment", "span", "n", "most", "least", "front", F.explode(self.roles()).alias("role"))
        by_place = heads.groupBy("segment", "span", "role.phrase", "role.place").agg(F.sum("n").alias("n"), F.sum("most").alias("most"), F.min("least").alias("least"), F.max("front").alias("front"))
        whole = by_place.groupBy("segment", "span", "phrase").agg(F.count("*").alias("places"), F.min("n").alias("n"), F.min("most").alias("most"), F.max("least").alias("least"), F.max("front").alias("front"))
        need = F.get(F.array(*(F.lit(len(p.tokens)) for p in self.phrases)), F.col("phrase"))
        here = lambda i: F.when((F.col("phrase") == i) & (F.col("places") == need), F.struct("n", "most", "least", "front"))
        return whole.groupBy("segment", "span").agg(*(F.max(here(i)).alias(f"_h{i}") for i in range(len(self.phrases))))

    def matches(self, has, excludes: bool = True) -> Column:
        """Whether an alternative's phrases are there; has tells it of one phrase."""
        return reduce(Column.__or__, (reduce(Column.__and__, [*map(has, a.required), *(~has(p) for p in a.excluded if excludes)]) for a in self.asked))

    def counts(self, spans: DataFrame | None, of: list[int] | None = None) -> DataFrame:
        """segment, doc, n_tokens, and how often each phrase stands in the post (_f0, ...), over all blocks of the query's tokens or over those of spans only."""
        wanted = list(range(len(self.phrases))) if of is None else of
        blocks = self.index.postings.where(reduce(Column.__or__, (fits for n, _, fits in self.places if n in wanted)))
        if spans is not None:
            blocks = blocks.join(spans.select("segment", "span"), ["segment", "span"], "left_semi")
        found = blocks.select("segment", F.explode(self.roles(wanted)).alias("role"), "entries").select("segment", "role", F.explode("entries").alias("e"))
        long = [n for n in wanted if len(self.phrases[n].tokens) > 1]
        post = ["segment", F.col("e.doc").alias("doc"), F.col("e.n_tokens").alias("n_tokens"), F.col("role.phrase").alias("phrase")]
        rows = found.where(~F.col("role.phrase").isin(long)) if long else found
        rows = rows.select(*post, F.size("e.positions").cast("long").alias("times"))
        if long:
            starts = found.where(F.col("role.phrase").isin(long)).select(*post, F.col("role.place").alias("place"), F.explode("e.positions").alias("pos"))
            lengths = F.get(F.array(*(F.lit(len(p.tokens)) for p in self.phrases)), F.col("phrase"))
            met = starts.groupBy("segment", "doc", "n_tokens", "phrase", (F.col("pos") - F.col("place")).alias("start")).agg(F.count("*").alias("n")).where(F.col("n") == lengths)
            rows = rows.unionByName(met.select("segment", "doc", "n_tokens", "phrase", F.lit(1).cast("long").alias("times")))
        sums = rows.groupBy("segment", "doc", "n_tokens").agg(*(F.coalesce(F.sum(F.when(F.col("phrase") == n, F.col("times"))), F.lit(0)).alias(f"_f{n}") for n in wanted))
        return self.index.live(sums)

    def frequencies(self, heads: DataFrame) -> list[int]:
        """How many posts have each scored phrase: of single tokens from the heads of blocks, of others from their postings."""
        many = list(range(len(self.scored)))
        sums = heads.agg(*(F.coalesce(F.sum(f"_h{i}.n"), F.lit(0)) for i in many)).first()
        out = [sums[i] for i in many]
        if self.index.manifest["removed"] and any(self.plain[i] for i in many):
            gone = self.index.removed.agg(*(F.count_if(self.phrases[i].fits(F.col("token"), 0)) for i in many)).first()
            out = [n - gone[i] for i, n in zip(many, out, strict=True)]
        if other := [i for i in many if not self.plain[i]]:
            met = self.counts(None, other)
            if len(other) == len(self.phrases):
                met = self.met = stored(met, "met")
            found = met.agg(*(F.count_if(F.col(f"_f{i}") > 0) for i in other)).first()
            for i, n in zip(other, found, strict=True):
                out[i] = n
        return out

    def weight(self, times: Column, length: Column) -> Column:
        """What a phrase's count in a post of that length weighs, at most K1 + 1."""
        return times * (K1 + 1) / (times + K1 * (1 - B + B * length / F.lit(self.average)))

    def score(self, frequencies: list[int], weight) -> Column:
        """Less than nothing, the more the better: the sum of the scored phrases' weights by their rarity."""
        rank = F.lit(0.0)
        for i, d in enumerate(frequencies):
            idf = math.log((self.n - d + 0.5) / (d + 0.5)) if self.n >= d else FLOOR
            rank = rank - F.lit(idf if idf > 0 else FLOOR) * weight(i)
        return rank

    def _bound(self, i: int) -> Column:
        h = F.col(f"_h{i}")
        # a single word's best post is one of its block's front; of others the largest count and the shortest post are known
        best = F.array_max(F.transform(h["front"], lambda x: self.weight(x["count"], x["length"]))) if self.plain[i] else self.weight(h["most"], h["least"])
        return F.coalesce(best, F.lit(0.0))

    def spans(self, heads: DataFrame, frequencies: list[int]) -> DataFrame:
        """segment, span, bound of the spans that may have matches by their heads; bound is the best rank possible there."""
        bound = self.score(frequencies, self._bound)
        possible = self.matches(lambda p: F.col(f"_h{self.phrases.index(p)}").isNotNull(), excludes=False)
        return heads.where(possible).select("segment", "span", bound.alias("bound"))

    def ranked(self, spans: DataFrame, frequencies: list[int]) -> DataFrame:
        """segment, doc, rank of the matching posts of spans, or of all where those have been met."""
        fits = self.matches(lambda p: F.col(f"_f{self.phrases.index(p)}") > 0)
        rank = self.score(frequencies, lambda i: self.weight(F.col(f"_f{i}"), F.col("n_tokens")))
        return (self.counts(spans) if self.met is None else self.met).where(fits).select("segment", "doc", F.round(rank, 6).alias("rank"))


def _open_spans(q: _Asked, heads: DataFrame, frequencies: list[int], k: int) -> tuple[DataFrame, int, int]:
    """The spans that can have one of the best k posts, the number of spans that may have matches, and that of those which are open."""
    spans = stored(q.spans(heads, frequencies), "spans")
    all_ = spans.count()
    first = FIRST_SPANS + k // 2
    if all_ > 2 * first:
        some = q.ranked(F.broadcast(spans.orderBy("bound", "segment", "span").limit(first)), frequencies)
        last = some.orderBy("rank").offset(k - 1).limit(1).collect()
        if last:  # ranks are rounded; a bound that is just as good may win by its key
            spans = stored(spans.where(F.round(F.col("bound") - 1e-9, 6) <= last[0]["rank"]), "open")
            return spans, all_, spans.count()
    return spans, all_, all_


def spans_read(index: SearchIndex, query: str | list[Alternative], k: int = 20) -> tuple[int, int]:
    """How many spans have matches by the heads of their blocks, and how many of them are read for the best k posts."""
    q = _Asked(index, query)
    heads = stored(q.heads(), "heads")
    return _open_spans(q, heads, q.frequencies(heads), k)[1:]


def search(index: SearchIndex, threads: DataFrame, query: str | list[Alternative], page: int = 1, page_size: int = 20, total: bool = True) -> DataFrame:
    """archive, tid, post_id, title, rank, snippet, total of one page of hits, best (smallest rank) first.

    Ties by archive, tid and post.  Scores are sums over the required phrases that a post has.  The total counts matching posts; without it
    (null), or for a single word, only blocks are read that can hold one of the page's posts or of those before.  Only blocks of the query's tokens are read;
    they are counted map-side by post (and by start, for phrases), so a token that a third of the posts have is no group of its own.
    """
    q = _Asked(index, query)
    size = min(max(page_size, 1), 200)
    heads = stored(q.heads(), "heads")
    frequencies = q.frequencies(heads)
    if len(q.phrases) == 1 and q.plain[0] or not total and q.met is None:
        best, n = q.ranked(_open_spans(q, heads, frequencies, page * size)[0], frequencies), frequencies[0] if total else None
    else:  # whoever counts all matches has met them all
        best = stored(q.ranked(q.spans(heads, frequencies), frequencies), "matches")
        n = best.count() if total else None
    # numbers have the order of keys within a segment
    place = F.row_number().over(W.partitionBy("segment").orderBy("rank", "doc"))
    kept = best.withColumn("_place", place).where(F.col("_place") <= page * size)
    order = ("rank", *_POST)
    names = index.posts.select("segment", "doc", *_POST)
    hits = stored(kept, "best").join(names, ["segment", "doc"]).orderBy(*order).offset((page - 1) * size).limit(size)
    hits = stored(hits.select("segment", "doc", *order, F.lit(n).cast("long").alias("total")), "hits")
    shown = [(r.segment, r.doc) for r in hits.select("segment", "doc").collect()]  # at most 200
    texts = index.posts.where(F.col("doc").isin([d for _, d in shown]) & F.col("segment").isin([s for s, _ in shown])).select("segment", "doc", "tokens")
    marked = lambda x: reduce(Column.__or__, (p.fits(x, i) for p in q.scored for i in range(len(p.tokens))))
    start = F.greatest(F.coalesce(F.array_position(F.transform("tokens", marked), F.lit(True)), F.lit(1)), F.lit(1)).cast("int")
    snippet = F.array_join(F.transform(F.slice("tokens", start, SNIPPET), lambda x: F.when(marked(x), F.concat(F.lit("<mark>"), x, F.lit("</mark>"))).otherwise(x)), " ")
    whole = hits.join(texts, ["segment", "doc"]).join(threads.select("archive", "tid", "title"), ["archive", "tid"])
    return whole.select("archive", "tid", "post_id", "title", "rank", snippet.alias("snippet"), "total").orderBy(*order)
