"""The prefix trie of conversations, by truncation peeling.

Each turn becomes a short digest, and each prefix of a conversation a chained digest of its turns, its node.
Conversations that are equal as a whole are one sequence with several members.  Peeling starts at the
greatest depth: the sequences that end there are nodes; each node loses its last turn and meets, at the
depth above, the nodes with the same rest and the sequences that end there.  A node is complete when it is
found, so one pass finds and counts all.

A task peels the sequences below one light prefix (of LIGHT sequences or fewer), as a stream in the order of falling depth that
holds one level.  Prefixes that more sequences share are few; they are peeled afterwards, from the tops of the light
parts, by grouping with map-side sums, a level at a time.  So no prefix, however hot, is one task's group.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlake.llm.common import beside, staged, table

#: Most different sequences below a prefix that one task peels.
LIGHT = 1000
#: Ids that are joined to one piece of text before hashing.
PIECE = 4096
#: Bytes of a digest.
DIGEST = 16


def ordered_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, place (from 1), digest, chars of each turn, by turn (null first); ties by digest.  Rows without an id are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(2 * DIGEST)))
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest"))
    return rows.select("conv_id", place.alias("place"), "digest", "chars")


def with_shared_heads(turns: DataFrame, ids: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """turns (a staged table) in which each conversation's first h are those of the first conversation of its group, h by the id's checksum."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    heads = turns.where((F.col("conv_id") % group == 0) & (F.col("place") < most)).select(F.col("conv_id").alias("base"), "place", "digest", "chars")
    lent = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h")).join(heads, "base").where("place <= h")
    return turns.where(F.col("place") > h).unionByName(lent.select(*turns.columns))


_CHAIN = pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()), ("first", pa.binary()), ("chars", pa.int64()), ("last", pa.bool_())])


def _chain(batches):
    """Chained digests of the turns of each conversation; rows come by conversation and place.  Only one row is held back."""
    conv, node, first, depth, held = None, b"", b"", 0, None
    for batch in batches:
        out = [] if held is None else [held]
        for c, digest, chars in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            if out and c != conv:
                out[-1][6] = True
            if c != conv:
                conv, node, depth = c, b"", 0
            parent, node, depth = node, hashlib.blake2b(node + digest, digest_size=DIGEST).digest(), depth + 1
            if depth == 1:
                first = node
            out.append([c, depth, node, parent, first, chars, False])
        held = out.pop() if out else None
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _CHAIN, strict=True)], schema=_CHAIN)
    if held is not None:
        held[6] = True
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(held, _CHAIN, strict=True)], schema=_CHAIN)


_PEELED = pa.schema([("node", pa.binary()), ("depth", pa.int32()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.int64()), ("end_id", pa.int64()), ("parent", pa.binary())])
NODES = "node binary, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends long, end_id long, parent binary"


class _Peel:
    """Peels the sequences below one prefix at a time; ``done`` takes the finished nodes.  A top keeps its parent's digest."""

    def __init__(self):
        self.done, self.key = [], None
        self.level, self.merged, self.depth = {}, {}, 0

    def add(self, key: bytes, depth: int, node: bytes, parent: bytes, conv: int, chars: int, ends: int) -> None:
        if key != self.key:
            self.finish()
            self.key = key
        elif depth != self.depth:
            self._strip()
        self.depth = depth
        have = self.level.get(node)
        if have is None:
            self.level[node] = [parent, chars, ends, conv if ends else None]
        elif ends:
            have[2:] = ends, conv

    def _strip(self) -> None:
        """Completes the nodes of the level, and merges them by what is left without the last turn."""
        above = {}
        for node, (parent, chars, ends, end_id) in self.level.items():
            below = self.merged.get(node, [])
            conv = min([x[2] for x in below] + ([end_id] if ends else []))
            n = ends + sum(x[4] for x in below)
            for x in below:
                x[3] = conv
            self.done += below
            leaves = sum(x[6] for x in below) if below else 1
            whole = [node if ends > 1 else None, self.depth, conv, None, n, len(below), leaves, sum(x[7] for x in below) + (n - 1) * chars, ends, end_id, None]
            above.setdefault(parent, []).append(whole)
        self.level, self.merged = {}, above

    def finish(self) -> None:
        if self.level:
            self._strip()
            for parent, tops in self.merged.items():
                for x in tops:
                    x[10] = parent
                    self.done.append(x)
        self.level, self.merged = {}, {}

    def take(self):
        rows, self.done = self.done, []
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _PEELED, strict=True)], schema=_PEELED)


def _peel(batches):
    peel = _Peel()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            peel.add(*row)
        if peel.done:
            yield peel.take()
    peel.finish()
    if peel.done:
        yield peel.take()


def _pieces(batches):
    """Sorted (node, conv_id) as texts of up to PIECE ids: node, the first id, ids joined by commas."""
    shape = pa.schema([("node", pa.binary()), ("first_id", pa.int64()), ("ids", pa.string())])
    for batch in batches:
        out, start = [], 0
        nodes, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i in range(1, len(ids) + 1):
            if i == len(ids) or nodes[i] != nodes[start] or i - start == PIECE:
                out.append((nodes[start], ids[start], ",".join(map(str, ids[start:i]))))
                start = i
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)


def _hashes(batches):
    """Sorted pieces to (node, SHA-256 of all of a node's ids), as a stream."""
    shape = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
    node, state = None, None
    for batch in batches:
        out = []
        for n, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if n != node:
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], schema=shape)


def _peel_heavy(heavy: DataFrame, tops: DataFrame, ends: DataFrame) -> DataFrame:
    """The nodes of heavy (node, parent, depth, chars; the root among them), deepest first, from the tops of the light parts below them."""
    kid = lambda df: df.select(F.col("parent").alias("node"), "conv_id", "n_convs", F.lit(1).alias("child"), "n_leaves", "saved_tokens", F.lit(0).alias("ends"), F.lit(None).cast("long").alias("end_id"))
    own = ends.select("node", F.col("rep").alias("conv_id"), F.col("members").alias("n_convs"), F.lit(0).alias("child"), F.lit(0).alias("n_leaves"), F.lit(0).alias("saved_tokens"), F.col("members").alias("ends"), F.col("rep").alias("end_id"))
    found: list[DataFrame] = []
    for depth in range(heavy.agg(F.max("depth")).first()[0], -1, -1):
        here = heavy.where(F.col("depth") == depth)
        parts = [kid(tops.where(F.col("depth") == depth + 1)), own, *(kid(x) for x in found[-1:])]
        sums = reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "child", "n_leaves", "saved_tokens", "ends")), F.min("end_id").alias("end_id"))
        whole = beside(sums, here, "inner", "node")
        found.append(staged(whole.select("node", "depth", "conv_id", "n_convs", F.col("child").alias("n_children"), F.when(F.col("child") == 0, 1).otherwise(F.col("n_leaves")).alias("n_leaves"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"), "ends", "end_id", "parent"), "heavy"))
    return reduce(DataFrame.unionByName, found)


def prefix_trie(turns: DataFrame, ids: DataFrame, light: int = LIGHT) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, n_ends, ends_sha256.

    turns has conv_id, place, digest and chars of each turn (see ordered_turns), ids every conv_id once; an id without turns ends at the
    root.  conv_id is a node's smallest member, and so with its depth a key.  n_leaves counts the childless nodes of the subtree, the node included;
    saved_tokens sums, over the subtree, (members - 1) times the code points of a node's last text; n_ends counts the members that
    end at the node, and ends_sha256 is the hash of their ids, ascending and joined by commas.  Without ids there is no node.
    Null roles and texts are empty ones.  Conversations may have any length and any number of copies.
    """
    chain = staged(turns.select("conv_id", "place", "digest", "chars").repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_chain, "conv_id long, depth int, node binary, parent binary, first binary, chars long, last boolean"), "chain")
    last = chain.where("last").select("node", "conv_id").unionByName(ids.join(chain.where("depth = 1").select("conv_id"), "conv_id", "left_anti").select(F.lit(b"").alias("node"), "conv_id"))
    last = staged(last, "last")
    ends = staged(last.groupBy("node").agg(F.min("conv_id").alias("rep"), F.count("*").alias("members")), "ends")
    several = staged(ends.where("members > 1"), "several")
    # equal sequences are one, by its smallest member
    alike = staged(beside(last, several, "inner", "node"), "alike")
    copies = staged(alike.where("conv_id <> rep").select("conv_id"), "copies")
    rows = beside(chain, copies, "left_anti", "conv_id")
    rows = beside(rows, several.select("node", "members"), "left", "node")
    rows = rows.withColumn("ends", F.when(F.col("last"), F.coalesce("members", F.lit(1))).otherwise(F.lit(0)).cast("long")).drop("members")
    shared = staged(rows.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > light).select("node"), "shared")
    root = chain.sparkSession.createDataFrame([(b"", None, 0, 0)], "node binary, parent binary, depth int, chars long")
    if shared.isEmpty():
        keyed, heavy = rows.withColumn("key", F.col("first")), staged(root, "root")
    else:
        within = beside(rows, shared, "inner", "node").groupBy("node", "parent", "depth", "chars").agg(F.count("*").alias("n")).drop("n")
        heavy = staged(root.unionByName(within), "prefixes")
        rest = beside(rows, shared, "left_anti", "node")
        # where a sequence leaves the heavy prefixes
        leaves = staged(beside(rest, shared.select(F.col("node").alias("parent")), "left_semi", "parent").select("conv_id", F.col("node").alias("key")), "tops")
        keyed = beside(rest, leaves, "left", "conv_id").withColumn("key", F.coalesce("key", "first"))
    order = keyed.select("key", "depth", "node", "parent", "conv_id", "chars", "ends").repartition("key").sortWithinPartitions("key", F.desc("depth"), "node")
    peeled = staged(order.mapInArrow(_peel, NODES), "peeled")
    tops = peeled.where("parent is not null")
    above = _peel_heavy(heavy, tops, staged(beside(ends, heavy.select("node"), "left_semi", "node"), "heavy-ends"))
    of_parent = staged(above.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parents")
    known = lambda df: beside(df.drop("parent_conv_id"), of_parent, "left", "parent").select(*peeled.columns)
    nodes = peeled.where("parent is null").unionByName(known(tops)).unionByName(known(above))
    # nodes where several conversations end: their ids are sorted over all tasks, and hashed as a stream of pieces
    texts = alike.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_pieces, "node binary, first_id long, ids string")
    hashes = texts.repartition("node").sortWithinPartitions("node", "first_id").mapInArrow(_hashes, "node binary, ends_sha256 string")
    few = nodes.where("ends < 2").withColumn("ends_sha256", F.sha2(F.when(F.col("ends") == 1, F.col("end_id").cast("string")).otherwise(F.lit("")).cast("binary"), 256))
    whole = few.unionByName(nodes.where("ends > 1").join(hashes, "node"), allowMissingColumns=True)
    return whole.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("n_ends"), "ends_sha256")


def op11_prefix_trie(spark, sf_dir):
    turns = staged(ordered_turns(table(spark, sf_dir, "conversations")), "turns")
    ids = staged(turns.where("place = 1").select("conv_id"), "ids")
    return prefix_trie(with_shared_heads(turns, ids), ids)


# crc32 bit by bit, as DuckDB has no such function
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
OP11_SQL = f"""
WITH t AS (SELECT conv_id, turn, left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS digest, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place FROM t),
i AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM t),
r AS (
  SELECT i.conv_id, place, digest, chars FROM i JOIN o USING (conv_id) WHERE place > h
  UNION ALL SELECT i.conv_id, place, digest, chars FROM i JOIN o ON o.conv_id = i.base WHERE place <= h),
s AS (
  SELECT conv_id, row_number() OVER p AS depth, string_agg(digest, '') OVER p AS node, chars FROM r WINDOW p AS (PARTITION BY conv_id ORDER BY place)
  UNION ALL SELECT conv_id, 0, '', 0 FROM i),
l AS (SELECT conv_id, max(depth) AS deepest FROM s GROUP BY conv_id),
n AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, count(*) FILTER (depth = deepest) AS n_ends, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = deepest), '') AS ends
  FROM s JOIN l USING (conv_id) GROUP BY node, depth),
k AS (SELECT left(node, 32 * (depth - 1)) AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
b AS (
  SELECT s.node, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * y.chars)::BIGINT AS saved_tokens
  FROM n y LEFT JOIN k ON k.node = y.node JOIN s ON s.conv_id = y.conv_id AND s.depth <= y.depth GROUP BY s.node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.n_ends, sha256(n.ends) AS ends_sha256
FROM n JOIN b USING (node) LEFT JOIN k USING (node) LEFT JOIN n p ON n.depth > 0 AND p.node = left(n.node, 32 * (n.depth - 1))
"""
