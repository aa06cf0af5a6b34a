"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

Sketch: in rounds, every shingle hash goes to a random bin with a value that is smaller the
earlier the round; once each bin of a text is filled its sketch is complete.  Random
rounds fill all bins of large sets at once, and later rounds, in which every shingle
visits one given bin, fill what is left, so each of the t coordinates always has a
value and agreement concentrates around the Jaccard similarity.

Texts with equal shingle sets are one class with one representative.  Classes that
agree on a band of the sketch meet in a bucket:

1. in rounds, each bucket with several components takes a new centre, and its other members are verified, on full sets, against
   it: a row for each member;
2. what buckets this leaves open goes to an exact prefix filter over their representatives: shingles in an
   order from rare to frequent, by exact counts, and two sets can only reach the threshold if they share a shingle in the few
   first positions that their two sizes allow.  Shingles whose bearers are all in one component
   already are dropped, bearers of others meet only within size classes that can reach the threshold, and only pairs that
   pass all bounds are listed, once each, and verified on full sets.

A family of texts that share a frequent core has its own rare shingles first, so it makes no
pairs unless it is linked.  No link between texts that met in a bucket is lost.  With t = 128 and 4 coordinates in a band, a
pair at similarity 0.8 misses all 32 bands with a probability of about 5e-8.  Hashes of shingles have 64 bits.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlake.llm.common import beside, release, staged, table
from threadlake.llm.components import components
from threadlake.llm.words import U64, Words, freed, mix, slices

COORDS, ROWS = 128, 4
#: Rounds of centres before the prefix filter.
ROUNDS = 3

_FULL = np.iinfo(np.uint64).max


def sketch(sets: list[np.ndarray], coords: int = COORDS) -> np.ndarray:
    """The sketches of sets of hashes, a row each; a row of an empty set is all ones."""
    n = len(sets)
    out = np.full(n * coords, _FULL, dtype=np.uint64)
    elements = np.concatenate([*sets, np.zeros(0, np.uint64)])
    place = np.repeat(np.arange(n) * coords, [len(s) for s in sets])
    for i in range(2 * coords):
        if not len(elements):
            break
        h = mix(elements ^ U64((i + 1) * 0xA24BAED4963EE407 % (1 << 64)))
        at = place + ((h & U64(coords - 1)).astype(np.int64) if i < coords else i - coords)
        np.minimum.at(out, at, U64(i << 55) | (h >> U64(9)))
        open_ = (out.reshape(n, coords) == _FULL).any(axis=1)
        go = open_[place // coords]
        elements, place = elements[go], place[go]
    return out.reshape(n, coords)


def bands(sketches: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    n, coords = sketches.shape
    key = np.zeros((n, coords // rows), dtype=np.uint64)
    key += np.arange(1, coords // rows + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)
    for k in range(rows):
        key = mix(key ^ sketches[:, k::rows])
    return key.view(np.int64)


def _set_id(shingles: bytes) -> bytes:
    return hashlib.blake2b(shingles, digest_size=16).digest()


def _sketcher(shingle: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = Words(part.column(1), lower=True).shingle_sets(shingle)
                full = [len(s) > 0 for s in sets]
                ids = [_set_id(s.tobytes()) if f else None for s, f in zip(sets, full, strict=True)]
                keys = bands(sketch(sets))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), keys.shape[1]).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), lists], schema=schema)

    return freed(run)


def _setter(shingle: int):
    schema = pa.schema([("doc_id", pa.int64()), ("set_id", pa.binary()), ("shingles", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [s.tobytes() for s in Words(part.column(1), lower=True).shingle_sets(shingle)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_set_id(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], schema=schema)

    return freed(run)


def _linked(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], schema=schema)

    return freed(run)


def _shingles():
    """A row (token, doc, set_id, n, component) for each shingle of (doc_id, set_id, component, shingles)."""
    schema = pa.schema([("token", pa.int64()), ("doc", pa.int64()), ("set_id", pa.binary()), ("n", pa.int64()), ("component", pa.int64())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(3)[i].as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x), *(pa.repeat(v, len(x)) for v in (batch.column(0)[i], batch.column(1)[i], pa.scalar(len(x), pa.int64()), batch.column(2)[i]))], schema=schema)

    return freed(run)


def _rare_first(rest: DataFrame, percent: int) -> DataFrame:
    """(token, pos, n, doc, set_id, component) of the first positions of each set that others in other components can share."""
    tokens = staged(rest.select("doc_id", "set_id", "component", "shingles").mapInArrow(_shingles(), "token long, doc long, set_id binary, n long, component long"), "tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("often"), F.min("component").alias("low"), F.max("component").alias("high"))
    often = staged(often.where("often > 1").select("token", "often", (F.col("low") < F.col("high")).alias("mixed")), "often")
    ordered = tokens.join(often, "token", "left")
    place = F.row_number().over(W.partitionBy("doc", "set_id").orderBy(F.coalesce("often", F.lit(1)), "token")) - 1
    first = ordered.withColumn("pos", place).where((F.col("pos") <= F.col("n") - F.ceil(percent * F.col("n") / 100)) & F.col("mixed"))
    first = staged(first.select("token", "pos", "n", "doc", "set_id", "component"), "first")
    release(tokens, often)
    return first


def _candidates(first: DataFrame, percent: int) -> DataFrame:
    """(a, set_a, b, set_b), a < b, of sets in different components that their first positions allow to reach the threshold."""
    # sizes of sets that reach it are less than a factor apart, so their classes are equal or neighbours
    kind = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).cast("int")
    classed = first.withColumn("kind", kind)
    x = classed.alias("x")
    y = classed.withColumn("kind", F.explode(F.array(F.col("kind") - 1, F.col("kind"), F.col("kind") + 1))).alias("y")
    need = F.ceil(percent * (F.col("x.n") + F.col("y.n")) / (100 + percent) - 1e-9)
    may = (F.col("x.token") == F.col("y.token")) & (F.col("x.kind") == F.col("y.kind")) & (F.col("x.doc") < F.col("y.doc")) & (F.col("x.component") != F.col("y.component"))
    may &= (F.col("x.pos") <= F.col("x.n") - need) & (F.col("y.pos") <= F.col("y.n") - need)
    may &= (1 + F.least(F.col("x.n") - 1 - F.col("x.pos"), F.col("y.n") - 1 - F.col("y.pos"))) >= need
    return x.join(y, may).select(F.col("x.doc").alias("a"), F.col("x.set_id").alias("set_a"), F.col("y.doc").alias("b"), F.col("y.set_id").alias("set_b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    A text's set is its distinct shingles of ``shingle`` lower-cased words; a shorter
    text is one shingle; null, empty and blank texts have none, are linked with nothing, and
    are their own component.  Texts are linked when 100 |A & B| >= percent |A | B|;
    component_id is the smallest id reachable.  Rows that repeat an id are judged each by its own text, in the
    component of that id's links: equal ids are one node.  Rows without an id take no part; their component_id is
    null and they are kept.  Other columns are not read.  An empty table gives
    an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = staged(docs.mapInArrow(_sketcher(shingle), "doc_id long, n_shingles long, set_id binary, bands array<long>"), "sketches")
    full = rows.where("doc_id is not null and set_id is not null")
    classes = staged(full.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    keyed = classes.select(F.explode("bands").alias("key"), "rep", "n", "set_id")
    shared = staged(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key"), "shared")
    members = staged(keyed.join(shared, "key"), "members")
    met = staged(members.select(F.col("rep").alias("doc_id")).distinct(), "met")
    sets = beside(docs.where("doc_id is not null"), met, "left_semi").mapInArrow(_setter(shingle), "doc_id long, set_id binary, shingles binary")
    sets = staged(sets.dropDuplicates(["doc_id", "set_id"]), "sets")
    release(shared, met)

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among distinct pairs (a, set_a, b, set_b), a staged table."""
        pairs = staged(pairs, "pairs")
        of = lambda x: sets.select(F.col("doc_id").alias(x), F.col("set_id").alias(f"set_{x}"), F.col("shingles").alias(f"full_{x}"))
        both = pairs.join(of("a"), ["a", "set_a"]).join(of("b"), ["b", "set_b"]).select("a", "b", "full_a", "full_b")
        out = staged(both.mapInArrow(_linked(percent), "a long, b long"), "edges")
        release(pairs)
        return out

    def lowest(rows: DataFrame) -> DataFrame:
        """The open buckets with their smallest component; staged, so that a join with it can split a hot bucket."""
        return staged(rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key", "low"), "low")

    edges, found, open_ = [], None, members.withColumn("component", F.col("rep"))
    near = 100 * F.least("n", "centre.n") >= percent * F.greatest("n", "centre.n")
    for turn in range(ROUNDS):
        # the first centre is the smallest; later ones are drawn from outside the component of the smallest
        pick = F.struct("rep", "n", "set_id") if not turn else F.struct(F.xxhash64("rep", F.lit(turn)).alias("draw"), "rep", "n", "set_id")
        rest = open_
        if turn:
            low = lowest(open_)
            rest = staged(open_.join(low, "key"), "open")
            release(low)
        if rest.isEmpty():
            break
        centres = staged(rest.where(F.col("component") != F.col("low") if turn else F.lit(True)).groupBy("key").agg(F.min(pick).alias("centre"), F.min_by("component", pick).alias("with")), "centres")
        stars = rest.join(centres, "key").where((F.col("component") != F.col("with")) & (F.col("rep") != F.col("centre.rep")) & near)
        a_first = F.col("centre.rep") < F.col("rep")
        pair = lambda c: (F.when(a_first, F.col(f"centre.{c}")).otherwise(F.col(c)), F.when(a_first, F.col(c)).otherwise(F.col(f"centre.{c}")))
        (a, b), (set_a, set_b) = pair("rep"), pair("set_id")
        edges.append(verified(stars.select(a.alias("a"), set_a.alias("set_a"), b.alias("b"), set_b.alias("set_b")).distinct()))
        release(centres, *([rest] if turn else []))
        found = components(reduce(DataFrame.unionByName, edges))
        open_ = members.join(found, F.col("rep") == F.col("node"), "left").select("key", "rep", "n", "set_id", F.coalesce("component", "rep").alias("component"))
    low = lowest(open_)
    rest = open_.join(low, "key", "left_semi").select(F.col("rep").alias("doc_id"), "set_id", "component").distinct()
    rest = staged(rest.join(sets, ["doc_id", "set_id"]), "rest")
    release(low)
    if not rest.isEmpty():
        first = _rare_first(rest, percent)
        edges.append(verified(_candidates(first, percent)))
        release(first)
        found = components(reduce(DataFrame.unionByName, edges))
    release(rest, members, sets)
    if found is None:
        of_class = classes.select("set_id", F.col("rep").alias("component_id"))
    else:
        of_class = staged(classes.select("set_id", "rep").join(found, F.col("rep") == F.col("node"), "left").select("set_id", F.coalesce("component", "rep").alias("component_id")), "of_class")
        release(classes, *edges)
    linked = full.select("doc_id", "n_shingles", "set_id").join(of_class, "set_id").select("doc_id", "n_shingles", "component_id")
    apart = rows.where("doc_id is null or set_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(apart).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def components_sql(sets: str, percent: int) -> str:
    """Links and components of ``s(doc_id, g)``, g the shingles of a document, as common table expressions."""
    return f"""
WITH RECURSIVE {sets},
e AS (SELECT doc_id, unnest(g) AS x, len(g) AS n FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.c FROM r JOIN l ON r.doc_id = l.a),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)"""


def shingles_sql(source: str, shingle: int) -> str:
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{low}'), '[^\x20\x09-\x0D]+') AS w FROM {source}),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {shingle} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {shingle - 2}), lambda i: array_to_string(w[i:i + {shingle - 1}], ' '))) END AS g FROM d)"""


OP6_SQL = components_sql(shingles_sql("documents", 4), 80) + """
SELECT doc_id, len(g) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
"""
