"""Views that give the test tables the shape of archive tables, in SQL that Spark and DuckDB share.

``@epoch(c)`` stands for the epoch seconds of a timestamp; each engine has its own, as
for ``@offset``, a column whose name DuckDB wants quoted.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: View: (tables it reads, SQL over them).
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "thread": (
        ("orders",),
        "SELECT concat('arc', CAST(o_orderkey % 2 AS VARCHAR(9))) AS archive, o_orderkey AS tid, concat(o_orderpriority, ' ', CAST(o_orderkey AS VARCHAR(19))) AS title, "
        "o_custkey % 7 AS forum_id, CASE WHEN o_custkey % 11 = 0 THEN '' ELSE concat('forum', CAST(o_custkey % 7 AS VARCHAR(9))) END AS forum_name, o_custkey AS author_user_id, "
        "CAST(floor(o_totalprice) AS BIGINT) AS view_num, CAST(floor(o_totalprice / 50000) AS BIGINT) AS reply_num, o_custkey % 97 AS agree, @epoch(o_orderdate) AS create_time, "
        "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS scrape_status FROM orders",
    ),
    # ids repeat within a thread, as rows of several crawls do
    "raw_post": (
        ("lineitem",),
        "SELECT concat('arc', CAST(l_orderkey % 2 AS VARCHAR(9))) AS archive, CAST(l_linenumber - 1 AS BIGINT) AS id, l_orderkey AS tid, concat('part ', CAST(l_partkey AS VARCHAR(19)), ' ', l_returnflag) AS contents, "
        "CAST(l_linenumber AS BIGINT) AS floor, l_suppkey % 40 AS user_id, CAST(l_quantity AS BIGINT) AS agree, l_partkey % 10 AS disagree, @epoch(l_shipdate) AS create_time, l_linestatus = 'O' AS is_thread_author, "
        "l_partkey % 5 AS reply_num, CASE WHEN l_returnflag = 'R' THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS parent_id, CASE WHEN l_partkey % 3 = 0 THEN l_suppkey % 50 ELSE 0 END AS reply_to_id, l_suppkey % 3 AS scrape_batch_id FROM lineitem",
    ),
    "post": (
        ("raw_post",),
        "SELECT archive, id, tid, contents, floor, user_id, agree, disagree, create_time, is_thread_author, reply_num, parent_id, reply_to_id, scrape_batch_id FROM ("
        "SELECT *, row_number() OVER (PARTITION BY archive, tid, id ORDER BY agree, contents, create_time, disagree, floor, is_thread_author, parent_id, reply_num, reply_to_id, scrape_batch_id, user_id) AS n FROM raw_post) AS r WHERE n = 1",
    ),
    "text_post": (
        ("conversations",),
        "SELECT 'arc0' AS archive, conv_id AS tid, turn AS id, turn AS floor, role = 'user' AS is_thread_author, text AS contents FROM conversations",
    ),
    "text_thread": (("conversations",), "SELECT DISTINCT 'arc0' AS archive, conv_id AS tid, concat('talk ', CAST(conv_id AS VARCHAR(19))) AS title FROM conversations"),
    "corpus": (("documents",), "SELECT source AS archive, doc_id AS tid, CAST(1 AS BIGINT) AS id, CAST(1 AS BIGINT) AS floor, text AS contents FROM documents"),
    "corpus_thread": (("documents",), "SELECT source AS archive, doc_id AS tid, concat('doc ', CAST(doc_id AS VARCHAR(19))) AS title, source AS forum_name FROM documents"),
    "member": (
        ("customer", "orders"),
        "SELECT concat('arc', CAST(o_orderkey % 2 AS VARCHAR(9))) AS archive, o_orderkey AS tid, c_name AS portrait, c_custkey % 40 AS user_id, CASE c_nationkey % 3 WHEN 0 THEN '' ELSE c_mktsegment END AS nickname, "
        "CASE c_nationkey % 4 WHEN 0 THEN '' ELSE c_name END AS username, concat(c_name, '.jpg') AS avatar, CASE c_custkey % 5 WHEN 0 THEN 0 ELSE c_custkey END AS site_uid, 0 AS status, c_custkey % 2 = 0 AS completed, CAST(0 AS BIGINT) AS scrape_time FROM customer JOIN orders ON o_custkey = c_custkey",
    ),
    "profile": (("customer",), "SELECT c_custkey % 40 AS user_id, max(c_name) AS portrait, CASE WHEN c_custkey % 40 % 3 = 0 THEN '-' WHEN c_custkey % 40 % 3 = 1 THEN '' ELSE min(c_name) END AS user_name, CASE WHEN c_custkey % 40 % 2 = 0 THEN '' ELSE max(c_mktsegment) END AS nick_name_new, "
        "CASE WHEN c_custkey % 40 % 5 = 0 THEN '' ELSE min(c_mktsegment) END AS nick_name_old, min(c_name) AS nick_name, CASE WHEN c_custkey % 40 % 7 = 0 THEN 0 ELSE min(c_custkey) END AS site_uid FROM customer WHERE c_custkey % 40 < 30 GROUP BY c_custkey % 40"),  # fmt: skip
    "forum": (("nation", "region"), "SELECT concat('arc', CAST(n_regionkey % 2 AS VARCHAR(9))) AS archive, r_name AS collection, n_name AS forum_name, CAST(n_nationkey % 10 AS BIGINT) AS forum_id, CAST(n_nationkey * 3 AS BIGINT) AS member_num, CAST(n_nationkey * 5 % 7 AS BIGINT) AS post_num, CAST(n_nationkey AS BIGINT) AS thread_num, CASE n_nationkey % 3 WHEN 0 THEN '' ELSE concat('about ', n_name) END AS slogan FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "member_file": (
        ("lineitem",),
        "SELECT concat('arc', CAST(l_orderkey % 2 AS VARCHAR(9))) AS archive, concat('media', CAST(l_linenumber % 3 AS VARCHAR(9)), '.tar') AS tar, concat(CAST(l_orderkey AS VARCHAR(19)), '/img/p_', CAST(l_partkey % 50 AS VARCHAR(9)), '_', CAST(l_linenumber AS VARCHAR(9)), '.jpg') AS name, l_partkey * 512 AS @offset, CAST(l_quantity AS BIGINT) AS size FROM lineitem",
    ),
    "media": (("member_file",), "SELECT archive, name AS path, max(tar) AS tar, max(@offset) AS @offset, max(size) AS size, min(@offset) AS seq FROM member_file GROUP BY archive, name"),
    "listing": (("orders",), "SELECT concat('arc', CAST(o_orderkey % 2 AS VARCHAR(9))) AS archive, o_orderkey AS tid, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('listed ', CAST(o_orderkey AS VARCHAR(19))) END AS title, o_custkey AS author_id, CAST(floor(o_totalprice / 50000) AS BIGINT) AS reply_num, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE @epoch(o_orderdate) END AS create_time, o_orderkey AS pos FROM orders WHERE o_orderkey % 7 <> 0"),
    "archived": (("thread",), "SELECT archive, tid, title, CASE WHEN tid % 4 = 0 THEN 0 ELSE create_time END AS create_time FROM thread WHERE tid % 5 <> 0"),
    "progress": (("orders",), "SELECT concat('arc', CAST(o_orderkey % 2 AS VARCHAR(9))) AS archive, o_orderkey AS tid, CASE o_orderstatus WHEN 'O' THEN 'deleted' WHEN 'P' THEN 'failed' ELSE 'done' END AS state FROM orders"),
    "page": (("pages",), "SELECT page_id, url, html FROM pages"),
    "document": (("documents",), "SELECT doc_id, text, lang, source, n_chars FROM documents"),
    "activity": (("events",), "SELECT concat('arc', CAST(user_id % 2 AS VARCHAR(9))) AS archive, user_id AS tid, ts, event_id, event_type FROM events"),
}


def _needs(name: str) -> list[str]:
    """Views below a view, lowest first, and itself."""
    out: list[str] = []
    for t in VIEWS[name][0]:
        out += [x for x in _needs(t) if x not in out] if t in VIEWS else []
    return [*out, name]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A bound view over the Parquet tables of a folder."""
    tables, sql = VIEWS[name]
    frames = {t: view(spark, sf_dir, t) if t in VIEWS else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    sql = re.sub(r"@epoch\((\w+)\)", r"unix_seconds(CAST(\1 AS TIMESTAMP))", sql).replace("@offset", "offset")
    for t in frames:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **frames)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the views in front of a query (which starts with SELECT or with more expressions)."""
    order: list[str] = []
    for n in names:
        order += [x for x in _needs(n) if x not in order]
    parts = [f"{n} AS ({re.sub(r'@epoch\((\w+)\)', r'CAST(epoch(\1) AS BIGINT)', VIEWS[n][1]).replace('@offset', '"offset"')})" for n in order]
    return f"WITH {', '.join(parts)} {sql}" if sql.lstrip().upper().startswith("SELECT") else f"WITH {', '.join(parts)}, {sql}"
