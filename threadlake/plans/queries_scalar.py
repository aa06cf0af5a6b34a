"""Queries of scalar functions, sources and sinks; inputs are built from columns of the test tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from threadlake.functions import scalars as C
from threadlake.operators import select as S
from threadlake.plans.bindings import view, with_views
from threadlake.sources import io as IO

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None, *views: str):
    """Registers fn(get, ...) as a query; get(view) binds a view."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(partial(view, spark, sf_dir))
        if sql is not None:
            SQL[name] = with_views(sql, *views) if views else sql
        return fn

    return add



# --- fragments ------------------------------------------------------------------------------

_CONTENTS = """CASE tid % 5
 WHEN 0 THEN concat('[{"type":1,"text":"', contents, '"},{"type":2,"id":"e1","desc":"smile"},{"type":3,"filename":"p_1_2.jpg"}]')
 WHEN 1 THEN concat('[{"type":4,"text":"@u', CAST(user_id AS VARCHAR(9)), '","user_id":', CAST(user_id AS VARCHAR(9)), '},{"type":5,"title":"","text":"t","url":"http://a.example/"}]')
 WHEN 2 THEN contents WHEN 3 THEN '[]' ELSE '[{"type":-1,"error_frag_type":9,"error_frag_name":"odd"}]' END"""


def _frag_posts(get):
    return get("post").withColumn("contents", F.expr(_CONTENTS.replace("VARCHAR(9)", "STRING")))


@query("s1_parse_frags", f"SELECT archive, tid, id, CASE tid % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 0 ELSE 1 END AS n, CASE tid % 5 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 1 WHEN 4 THEN -1 END AS first_type FROM post", "post")
def _(get):
    frags = C.parse_frags(F.col("contents"))
    return _frag_posts(get).select("archive", "tid", "id", F.size(frags).alias("n"), F.try_element_at(frags, F.lit(1))["type"].alias("first_type"))


@query("s2_frag_text", "SELECT archive, tid, id, CASE tid % 5 WHEN 0 THEN contents || ' [smile]' WHEN 1 THEN '@u' || user_id || ' t' WHEN 2 THEN contents ELSE '' END AS text FROM post", "post")
def _(get):
    return _frag_posts(get).select("archive", "tid", "id", C.frag_text(C.parse_frags(F.col("contents"))).alias("text"))


@query(
    "s3_explode_frags",
    """x AS (SELECT archive, tid, id AS post_id, CASE tid % 5 WHEN 0 THEN [1, 2, 3] WHEN 1 THEN [4, 5] WHEN 2 THEN [1] WHEN 3 THEN [NULL] ELSE [-1] END AS types FROM post)
SELECT archive, tid, post_id, CASE WHEN tid % 5 <> 3 THEN unnest(generate_series(0, len(types) - 1)) END AS idx, unnest(types) AS type FROM x""",
    "post",
)
def _(get):
    return C.explode_frags(_frag_posts(get)).select("archive", "tid", "post_id", "idx", "type")


@query(
    "s4_frag_types",
    """x AS (SELECT tid % 5 AS m FROM post), y AS (SELECT unnest(CASE m WHEN 0 THEN ['text', 'emoji', 'image'] WHEN 1 THEN ['at', 'link'] WHEN 2 THEN ['text'] WHEN 3 THEN [] ELSE ['scrape_error'] END) AS name FROM x)
SELECT name, count(*) AS n FROM y GROUP BY name""",
    "post",
)
def _(get):
    return C.explode_frags(_frag_posts(get)).where("type is not null").groupBy(C.frag_type_name(F.col("type")).alias("name")).agg(F.count("*").alias("n"))


@query("s4_scrape_errors", "SELECT archive, tid, id FROM post WHERE tid % 5 = 4", "post")
def _(get):
    return _frag_posts(get).where(C.has_scrape_error(C.parse_frags(F.col("contents")))).select("archive", "tid", "id")


# --- urls and names ---------------------------------------------------------------------------

_PAIR = [
    ("s5_unwrap_link", "http://GO.example.com/mo/checkurl?url=", "", "go.example.com", "/mo/checkurl", "url"),
    ("s6_unwrap_image", "http://img.example.com/c/img?size=9&src=", "&x=1", "img.example.com", "/c/img", "src"),
]
for _name, _before, _after, _host, _path, _param in _PAIR:
    query(
        _name,
        f"SELECT page_id, CASE page_id % 3 WHEN 0 THEN nullif(trim(url), '') WHEN 1 THEN NULL ELSE concat('http://other.example.com/mo?url=', page_id::VARCHAR) END AS target FROM pages",
    )(
        lambda get, a=(_before, _after, _host, _path, _param): get("page").select(
            "page_id",
            C.unwrap_redirect(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(a[0]), F.url_encode("url"), F.lit(a[1]))).when(F.col("page_id") % 3 == 1, F.lit(a[0] + a[1])).otherwise(F.concat(F.lit("http://other.example.com/mo?url="), F.col("page_id").cast("string"))), *a[2:]).alias("target"),
        )
    )


@query("s7_percent_encode", "SELECT doc_id, url_encode(text) AS encoded FROM documents")
def _(get):
    return get("document").select("doc_id", C.percent_encode(F.col("text")).alias("encoded"))


@query("s8_sanitize_title", r"""SELECT doc_id, coalesce(nullif(left(regexp_replace(regexp_replace(regexp_replace(text || '?*. ', '[\x00-\x1f\x7f]', '', 'g'), '[<>:"/\\|?*]', '', 'g'), '[. ]+$', ''), 80), ''), 'untitled') AS title FROM documents""")
def _(get):
    return get("document").select("doc_id", C.sanitize_title(F.concat("text", F.lit("?*. "))).alias("title"))


@query("s9_urls", "SELECT archive, tid, portrait, concat('http://avatar.example/', portrait) AS avatar, concat('http://voice.example/?md5=', portrait, '&play=1') AS voice FROM member", "member")
def _(get):
    return get("member").select("archive", "tid", "portrait", C.joined_url("http://avatar.example/", F.col("portrait")).alias("avatar"), C.joined_url("http://voice.example/?md5=", F.col("portrait"), "&play=1").alias("voice"))


@query("s10_asset_names", "SELECT name, CAST(regexp_extract(name, 'p_([0-9]+)_([0-9]+)', 1) AS BIGINT) AS pid, CAST(regexp_extract(name, 'p_([0-9]+)_([0-9]+)', 2) AS BIGINT) AS idx FROM member_file", "member_file")
def _(get):
    return get("member_file").withColumn("p", C.asset_name_parts(F.col("name"))).select("name", "p.pid", "p.idx")


@query("s11_human_count", "SELECT tid, CASE WHEN view_num >= 10000 THEN ((view_num + 500) // 1000 // 10) || '.' || ((view_num + 500) // 1000 % 10) || '万' WHEN view_num >= 1000 THEN ((view_num + 50) // 100 // 10) || '.' || ((view_num + 50) // 100 % 10) || 'k' ELSE view_num::VARCHAR END AS shown FROM thread", "thread")
def _(get):
    return get("thread").select("tid", C.human_count(F.col("view_num")).alias("shown"))


_AS_OF = 873024000


@query(
    "s12_relative_time",
    f"""x AS (SELECT tid, CASE WHEN tid % 10 = 0 THEN 0 WHEN tid % 10 < 5 THEN {_AS_OF} - tid * 7 ELSE create_time END AS ts FROM thread),
y AS (SELECT *, {_AS_OF} - ts AS gap, make_timestamp(ts * 1000000) AS w, make_timestamp({_AS_OF}::BIGINT * 1000000) AS o FROM x)
SELECT tid, CASE WHEN ts = 0 THEN '' WHEN gap < 60 THEN '刚刚' WHEN gap < 3600 THEN floor(gap / 60)::BIGINT || '分钟前' WHEN gap < 86400 THEN floor(gap / 3600)::BIGINT || '小时前' WHEN year(w) = year(o) THEN strftime(w, '%m-%d %H:%M') ELSE strftime(w, '%Y-%m-%d %H:%M') END AS ago,
 CASE WHEN ts = 0 THEN '' WHEN w::DATE = o::DATE THEN strftime(w, '%H:%M') WHEN year(w) = year(o) THEN strftime(w, '%m-%d') ELSE strftime(w, '%Y-%m-%d') END AS day FROM y""",
    "thread",
)
def _(get):
    ts = F.when(F.col("tid") % 10 == 0, 0).when(F.col("tid") % 10 < 5, _AS_OF - F.col("tid") * 7).otherwise(F.col("create_time"))
    return get("thread").select("tid", C.relative_time(ts, F.lit(_AS_OF)).alias("ago"), C.short_date(ts, F.lit(_AS_OF)).alias("day"))


_VOTE = "CASE WHEN tid % 3 = 0 THEN concat('{\"title\":\"v\",\"total_vote\":', CAST(reply_num AS STRING), ',\"options\":[{\"text\":\"a\",\"vote_num\":', CAST(reply_num AS STRING), '},{\"text\":\"b\",\"vote_num\":1}]}') WHEN tid % 3 = 1 THEN '{\"total_vote\":0,\"options\":[]}' END"


@query("s13_vote_options", "SELECT archive, tid, unnest([0, 1]) AS idx, unnest(['a', 'b']) AS text, unnest([reply_num, 1]) AS vote_num FROM thread WHERE tid % 3 = 0", "thread")
def _(get):
    return C.vote_options(get("thread").withColumn("vote_info", F.expr(_VOTE)))


@query("s13_votes", "SELECT archive, tid, CASE WHEN tid % 3 = 0 THEN reply_num END AS total_vote FROM thread", "thread")
def _(get):
    return get("thread").withColumn("vote_info", F.expr(_VOTE)).select("archive", "tid", C.parse_vote(F.col("vote_info"))["total_vote"].alias("total_vote"))


@query("s14_forum_key", "SELECT page_id, url_encode(replace(url, '/', '~')) AS encoded, replace(url, '~', '/') AS decoded FROM pages")
def _(get):
    encoded = C.encode_forum_key(F.col("url"))
    return get("page").select("page_id", encoded.alias("encoded"), C.decode_forum_key(encoded).alias("decoded"))


_LINE = "concat(date_format(timestamp_seconds(create_time), 'yyyy-MM-dd HH:mm:ss'), ',123 - ERROR - mod.file.py - FetchPosts', CASE WHEN tid % 2 = 0 THEN concat(' - < pn:', CAST(tid AS STRING), ', k:v >') ELSE '' END, CASE WHEN tid % 3 = 0 THEN ' - Request failed' ELSE '' END)"


@query(
    "s15_parse_log",
    "SELECT tid, make_timestamp(create_time * 1000000 + 123000) AS ts, 'ERROR' AS level, 'mod.file.py' AS module, 'FetchPosts' AS label, CASE WHEN tid % 2 = 0 THEN tid::VARCHAR END AS pn, CASE WHEN tid % 3 = 0 THEN 'Request failed' ELSE '' END AS message FROM thread",
    "thread",
)
def _(get):
    lines = get("thread").select("tid", C.parse_log(F.expr(_LINE)).alias("l"))
    return lines.select("tid", F.col("l.ts").cast("timestamp_ntz").alias("ts"), "l.level", "l.module", "l.label", F.try_element_at("l.attrs", F.lit("pn")).alias("pn"), "l.message")


@query("s16_strip_ansi", "SELECT tid, title || ' end' AS plain FROM thread", "thread")
def _(get):
    return get("thread").select("tid", C.strip_ansi(F.concat(F.lit("\x1b[31m"), "title", F.lit("\x1b[0;1m end"))).alias("plain"))


@query(
    "s17_config_changes",
    """c AS (SELECT archive, tid, create_time AS scrape_time, min(agree % 3) AS f, min(disagree % 2) AS a FROM raw_post GROUP BY ALL),
o AS (SELECT *, lag(f) OVER w AS pf, lag(a) OVER w AS pa FROM c WINDOW w AS (PARTITION BY archive, tid ORDER BY scrape_time))
SELECT archive, tid, scrape_time, pf IS NOT NULL AND f <> pf AS filter_changed, pa IS NOT NULL AND a <> pa AS avatar_changed FROM o""",
    "raw_post",
)
def _(get):
    rows = get("raw_post").groupBy("archive", "tid", F.col("create_time").alias("scrape_time")).agg(F.min(F.col("agree") % 3).alias("f"), F.min(F.col("disagree") % 2).alias("a"))
    return C.config_changes(rows.withColumn("config", F.format_string('{"POST_FILTER_TYPE":%d,"DOWNLOAD_USER_AVATAR_MODE":%d}', "f", "a")))


@query("d4_asset_identity", "SELECT name, regexp_replace(name, '_1\\.jpg$', '.png') AS identity FROM member_file", "member_file")
def _(get):
    stamped = F.regexp_replace("name", r"_1\.jpg$", "_0123456789012345.png")
    return get("member_file").select("name", C.asset_identity(stamped).alias("identity"))


#: Endings that the query deals out to pages: every known one, upper case, unknown ones and none.
_ENDINGS = [*C.CONTENT_TYPES, *(x.upper() for x in C.CONTENT_TYPES), ".bin", ".jpg.", "x", ""]


@query(
    "d9_content_type",
    f"SELECT url, CASE {' '.join(f"WHEN ends_with(lower(url), '{e}') THEN '{t}'" for e, t in C.CONTENT_TYPES.items())} ELSE 'application/octet-stream' END AS kind"
    f" FROM (SELECT 'm/' || page_id || ([{', '.join(f"'{e}'" for e in _ENDINGS)}])[page_id % {len(_ENDINGS)} + 1] AS url FROM pages)",
)
def _(get):
    ending = F.get(F.array(*map(F.lit, _ENDINGS)), (F.col("page_id") % len(_ENDINGS)).cast("int"))
    named = get("page").select(F.concat(F.lit("m/"), F.col("page_id").cast("string"), ending).alias("url"))
    return named.select("url", C.content_type(F.col("url")).alias("kind"))


# --- sources, folders, sinks ---------------------------------------------------------------------


@query("io1_conform", "SELECT archive, tid, id, contents, coalesce(user_id, 0) AS user_id, 0 AS scrape_batch_id, 0 AS parent_id FROM post", "post")
def _(get):
    old = get("post").drop("scrape_batch_id", "parent_id", "sign")
    return IO.conform(old, "post").select("archive", "tid", "id", "contents", "user_id", "scrape_batch_id", "parent_id")


@query("io3_thread_json", "SELECT tid, CASE WHEN tid % 2 = 0 THEN title ELSE '' END AS title, CASE WHEN tid % 3 = 0 THEN forum_id ELSE 0 END AS forum_id, reply_num FROM thread", "thread")
def _(get):
    field = "concat('\"id\":', CAST(tid AS STRING), CASE WHEN tid % 2 = 0 THEN concat(',\"title\":\"', title, '\"') ELSE '' END, CASE WHEN tid % 3 = 0 THEN concat(',\"forum_id\":', CAST(forum_id AS STRING)) ELSE '' END, ',\"reply_num\":', CAST(reply_num AS STRING))"
    docs = get("thread").select(F.expr(f"CASE WHEN tid % 5 = 0 THEN concat('{{\"thread\":{{', {field}, '}}}}') ELSE concat('{{', {field}, '}}') END").alias("json"))
    return IO.parse_thread_json(docs).select(F.col("id").alias("tid"), "title", "forum_id", "reply_num")


@query("io3_forum_json", "SELECT forum_id, forum_name, member_num, slogan FROM forum", "forum")
def _(get):
    one = F.to_json(F.struct(F.col("forum_id").alias("id"), F.col("forum_name").alias("name"), "member_num", "slogan"))
    other = F.to_json(F.struct(F.struct("forum_id", "forum_name", "member_num", "slogan").alias("forum")))
    return IO.parse_forum_json(get("forum").select(F.when(F.col("forum_id") % 2 == 0, one).otherwise(other).alias("json"))).select("forum_id", "forum_name", "member_num", "slogan")


@query("io4_tid_list", "SELECT tid AS k, tid + unnest([0, 1]) AS tid, CASE WHEN tid % 4 = 0 THEN 't' END AS title, unnest([0, 1]) AS pos FROM thread", "thread")
def _(get):
    ids = "concat('[', CAST(tid AS STRING), ',', CAST(tid + 1 AS STRING), ']')"
    shapes = f"CASE tid % 4 WHEN 0 THEN concat('[{{\"tid\":', CAST(tid AS STRING), ',\"title\":\"t\"}},{{\"tid\":', CAST(tid + 1 AS STRING), ',\"title\":\"t\"}}]') WHEN 1 THEN {ids} WHEN 2 THEN concat('{{\"all_tids\":', {ids}, '}}') ELSE concat('[{{\"all_tids\":', {ids}, '}}]') END"
    return IO.parse_tid_list(get("thread").select(F.col("tid").alias("k"), F.expr(shapes).alias("json"))).select("k", "tid", "title", "pos")


@query("io5_progress", "SELECT tid, 'deleted' AS state, NULL AS detail FROM thread UNION ALL SELECT tid + 1, 'failed', title FROM thread", "thread")
def _(get):
    json = F.to_json(F.struct(F.array("tid").alias("deleted"), F.create_map((F.col("tid") + 1).cast("string"), F.col("title")).alias("failed_details")))
    return IO.parse_progress(get("thread").select(json.alias("json")))


@query("io6_scrape_info", "SELECT tid, '1.3' AS scraper_version, 0 AS scrape_time, '{}' AS config, create_time AS update_time, '{\"POST_FILTER_TYPE\":' || reply_num || '}' AS last_config FROM thread", "thread")
def _(get):
    record = F.struct(F.lit(1).alias("scrape_time"), F.struct(F.col("reply_num").alias("POST_FILTER_TYPE")).alias("scrape_config"))
    json = F.to_json(F.struct(F.lit("1.3").alias("scraper_version"), F.col("create_time").alias("update_time"), F.array(record, record).alias("scrape_records")))
    return IO.parse_scrape_info(get("thread").select("tid", json.alias("json")))


@query("io7_media_index", 'SELECT archive, path, tar, "offset", size FROM media', "media")
def _(get):
    return IO.parse_media_index(IO.build_media_index(get("media"), 5_000)).drop("part")


@query("io9_write_archive", "SELECT archive, tid, title, reply_num + CASE WHEN archive = 'arc1' THEN 1 ELSE 0 END AS reply_num FROM thread", "thread")
def _(get):
    from threadlake.sources.places import scratch

    threads = get("thread")
    path = f"{scratch(threads.sparkSession)}/threads"
    IO.write_archive(threads, path, "thread")
    IO.write_archive(threads.where("archive = 'arc1'").withColumn("reply_num", F.col("reply_num") + 1), path, "thread")
    return IO.read_table(threads.sparkSession, path, "thread").select("archive", "tid", "title", "reply_num")


_FOLDER = "CASE tid % 4 WHEN 0 THEN concat('[', forum_name, '吧][', CAST(tid AS VARCHAR(19)), ']', title) WHEN 1 THEN concat('[吧][', CAST(tid AS VARCHAR(19)), ']t]', title) WHEN 2 THEN concat('_', title) ELSE title END"


@query("pf1_folder_names", f"SELECT name, CASE m WHEN 0 THEN forum_name WHEN 1 THEN '' END AS forum, CASE WHEN m < 2 THEN tid END AS tid, CASE m WHEN 0 THEN title WHEN 1 THEN 't]' || title END AS title FROM (SELECT *, tid % 4 AS m, {_FOLDER} AS name FROM thread) WHERE m <> 2", "thread")
def _(get):
    parsed, rejected = S.parse_folder_names(get("thread").select(F.expr(_FOLDER.replace("VARCHAR(19)", "STRING")).alias("name")))
    return parsed.unionByName(rejected, allowMissingColumns=True)


@query("pf2_recover_forum", "SELECT archive, tid, coalesce(nullif(forum_name, ''), CASE archive WHEN 'arc0' THEN 'main' END, CASE WHEN tid % 2 = 1 AND tid % 3 = 0 THEN 'own' END, '') AS forum FROM thread", "thread")
def _(get):
    threads = get("thread").select("archive", "tid", F.col("forum_name").alias("forum"))
    forum_json = threads.select("archive").distinct().withColumn("forum_name", F.when(F.col("archive") == "arc0", "main").otherwise(""))
    return S.recover_forum_name(threads, forum_json, threads.where("tid % 3 = 0").select("archive", "tid", F.lit("own").alias("forum_name")))


@query("pf3_archive_name", "SELECT tid, CASE tid % 3 WHEN 0 THEN 'Ba_x_260530' WHEN 1 THEN 'User_f_260101' ELSE 'Ba_f_' || strftime(make_timestamp(create_time * 1000000), '%y%m%d') END AS name FROM thread", "thread")
def _(get):
    m = F.col("tid") % 3
    return get("thread").select("tid", S.archive_name(F.when(m == 0, "Ba_x_260530").otherwise("f"), F.when(m == 1, "user"), F.when(m == 1, "2026-01-01 10:00:00").otherwise(""), F.col("create_time")).alias("name"))


@query("pf8_asset_paths", "SELECT archive, tid, path, tid || '/' || replace(path, 'post_assets/', '') AS archive_path FROM (SELECT archive, tid, CASE id % 3 WHEN 0 THEN 'content.db' WHEN 1 THEN 'post_assets/img/' || id || '.jpg' ELSE 'user_avatar/' || id || '.jpg' END AS path, id FROM post) WHERE id % 3 <> 0", "post")
def _(get):
    name = F.when(F.col("id") % 3 == 0, "content.db").when(F.col("id") % 3 == 1, F.concat(F.lit("post_assets/img/"), F.col("id").cast("string"), F.lit(".jpg"))).otherwise(F.concat(F.lit("user_avatar/"), F.col("id").cast("string"), F.lit(".jpg")))
    return S.asset_paths(get("post").select("archive", "tid", name.alias("path")))
