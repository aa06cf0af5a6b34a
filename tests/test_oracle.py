"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from threadlake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
#: One or two of each family; TEST_ALL=1 runs all.
SOME = ["m2_merge_posts", "m7_merge_forums", "m8_stub_threads", "m9_refresh_posts", "m9_refresh_posts_newest", "a7_healed_posts", "m11_run_threads", "r9_index_currency", "r7_suggest_indexed", "u3_complete_users", "pf4_filter_posts_replied_only", "a1_thread_stats_two_step", "a2_audit", "a7_heal_report", "c1_coverage", "w1_plan_crawl", "d3_diff_index", "d3_diff_by_digest", "io8_tar_members", "r1_deep_page", "r3_stored_places", "r5_timeline", "r12_distinct_users", "st4_activity_sessions_batch", "d5_dedupe_assets", "r2_thread_view", "r8_search_or_not", "r8_search_phrase", "r12_global_stats", "s3_explode_frags", "s15_parse_log", "io4_tid_list", "io9_write_archive", "st3_smoothed_goodput", "st4_activity_sessions", "m11_consolidated_posts", "m11_consolidated_threads", "st1_stream_merge", "st2_stream_dedupe", "r8_search_snippet", "w3_build_listing", "io7_media_index"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(names, values):
    order = sorted(names)
    return sorted((tuple(repr(plain(r[names.index(n)])) for n in order) for r in values), key=str), order


@pytest.mark.parametrize("name", sorted(registry.SQL) if os.environ.get("TEST_ALL") else SOME)
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    theirs = duck.sql(registry.SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(list(theirs.columns), theirs.fetchall())


def test_entry_and_registry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
