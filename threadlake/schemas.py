"""Schemas of the archive tables, their keys, and the defaults of columns that older versions lack."""

from __future__ import annotations

from pyspark.sql.types import StructType

TABLES: dict[str, str] = {
    "forum": "archive STRING, forum_id BIGINT, forum_name STRING, member_num BIGINT, post_num BIGINT, thread_num BIGINT, slogan STRING, avatar_url STRING, scraped_at BIGINT",
    "thread": "archive STRING, tid BIGINT, title STRING, forum_id BIGINT, forum_name STRING, post_id BIGINT, author_user_id BIGINT, type INT, is_share BOOLEAN, is_help BOOLEAN, vote_info STRING, share_origin BIGINT, view_num BIGINT, reply_num BIGINT, share_num BIGINT, agree BIGINT, disagree BIGINT, create_time BIGINT, status INT, folder_name STRING, scrape_status INT",
    "post": "archive STRING, id BIGINT, tid BIGINT, contents STRING, floor BIGINT, user_id BIGINT, agree BIGINT, disagree BIGINT, create_time BIGINT, is_thread_author BOOLEAN, sign STRING, reply_num BIGINT, parent_id BIGINT, reply_to_id BIGINT, scrape_batch_id BIGINT",
    "user": "archive STRING, portrait STRING, tid BIGINT, user_id BIGINT, username STRING, nickname STRING, site_uid BIGINT, avatar STRING, glevel INT, gender INT, ip STRING, is_vip BOOLEAN, is_god BOOLEAN, age DOUBLE, sign STRING, post_num BIGINT, agree_num BIGINT, fan_num BIGINT, follow_num BIGINT, forum_num BIGINT, level INT, is_bawu BOOLEAN, status INT, completed BOOLEAN, scrape_time BIGINT",
    "user_info_history": "archive STRING, tid BIGINT, portrait STRING, username STRING, site_uid BIGINT, field_name STRING, field_value STRING, scrape_time BIGINT",
    "media_source": "archive STRING, id BIGINT, tid BIGINT, filename STRING, content_frag_type INT, origin_src STRING",
    "scrape_batch": "archive STRING, id BIGINT, tid BIGINT, scraper_version STRING, scrape_config STRING, scrape_time BIGINT",
    "scrape_info": "archive STRING, tid BIGINT, scraper_version STRING, scrape_time BIGINT, config STRING, raw_json STRING",
    "merge_progress": "archive STRING, tid BIGINT, forum_name STRING, merged_at BIGINT",
    "media": "archive STRING, path STRING, tar STRING, offset BIGINT, size BIGINT, seq BIGINT",
}

KEYS: dict[str, list[str]] = {
    "forum": ["archive", "forum_name"],
    "thread": ["archive", "tid"],
    "post": ["archive", "tid", "id"],
    "user": ["archive", "tid", "portrait"],
    "media_source": ["archive", "tid", "id"],
    "scrape_batch": ["archive", "tid", "id"],
    "scrape_info": ["archive", "tid"],
    "merge_progress": ["archive", "tid"],
    "media": ["archive", "path"],
}

REQUIRED: dict[str, list[str]] = {
    "forum": ["archive", "forum_id", "forum_name"],
    "thread": ["archive", "tid", "title", "forum_id", "forum_name"],
    "post": ["archive", "id", "tid", "contents", "floor", "user_id", "create_time"],
    "user": ["archive", "portrait", "tid", "nickname"],
    "user_info_history": ["archive", "tid", "field_name", "field_value", "scrape_time"],
    "media_source": ["archive", "id", "tid", "filename", "content_frag_type", "origin_src"],
    "scrape_batch": ["archive", "id", "tid", "scraper_version", "scrape_config", "scrape_time"],
}

#: Columns that say in which order rows were scraped; of repeated source rows the first one wins.
SCRAPED: dict[str, str] = {"post": "scrape_batch_id", "user": "scrape_time", "scrape_batch": "scrape_time", "media_source": "scrape_batch_id", "forum": "scraped_at"}

#: Values of columns that tables written by older versions don't have.
DEFAULTS: dict[str, dict[str, object]] = {
    "post": {"scrape_batch_id": 0, "user_id": 0, "parent_id": 0},
    "user": {"user_id": 0, "completed": False, "scrape_time": 0},
    "thread": {"scrape_status": 0},
}

FRAGMENTS = "ARRAY<STRUCT<type INT, text STRING, id STRING, desc STRING, filename STRING, user_id BIGINT, title STRING, raw_url STRING, url STRING, cover_filename STRING, duration INT, width INT, height INT, view_num BIGINT, md5 STRING, error_frag_type INT, error_frag_name STRING>>"

VOTE = "STRUCT<title STRING, is_multi BOOLEAN, total_vote BIGINT, total_user BIGINT, options ARRAY<STRUCT<text STRING, vote_num BIGINT>>>"

THREAD_JSON = f"id BIGINT, title STRING, forum_id BIGINT, forum_name STRING, fname STRING, post_id BIGINT, user_id BIGINT, type INT, is_share BOOLEAN, is_help BOOLEAN, vote_info {VOTE}, share_origin BIGINT, view_num BIGINT, reply_num BIGINT, share_num BIGINT, agree BIGINT, disagree BIGINT, create_time BIGINT, status INT"

FORUM_JSON = "id BIGINT, forum_id BIGINT, name STRING, forum_name STRING, member_num BIGINT, post_num BIGINT, thread_num BIGINT, slogan STRING"

SCRAPE_CONFIG = "STRUCT<POST_FILTER_TYPE INT, DOWNLOAD_USER_AVATAR_MODE INT, SCRAPE_SHARE_ORIGIN BOOLEAN, UPDATE_SHARE_ORIGIN BOOLEAN>"

SCRAPE_INFO_JSON = f"main_thread BIGINT, scrape_time BIGINT, config STRING, create_time BIGINT, update_time BIGINT, scraper_version STRING, scrape_records ARRAY<STRUCT<scrape_time BIGINT, scrape_config {SCRAPE_CONFIG}>>"


def scrape_order(name: str, columns: list[str]) -> list[str]:
    """The column of the order of scraping, if the table has one and it is there."""
    return [c for c in [SCRAPED.get(name)] if c in columns]


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])
