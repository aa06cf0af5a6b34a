"""Scalar functions over columns: fragments, urls, names, numbers, times and log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.schemas import FRAGMENTS, SCRAPE_CONFIG, VOTE

# Fragment types of stored posts: fixed values.
FRAGMENT_TYPES = {1: "text", 2: "emoji", 3: "image", 4: "at", 5: "link", 6: "ad", 7: "video", 8: "voice", -1: "scrape_error"}

# Content types by file extension: fixed values.
CONTENT_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp", ".bmp": "image/bmp", ".mp4": "video/mp4", ".mp3": "audio/mpeg", ".wav": "audio/wav"}


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def parse_frags(contents: Column) -> Column:
    """Fragments of a JSON array; anything else is one text fragment; null stays null."""
    array = F.from_json(contents, FRAGMENTS, {"mode": "PERMISSIVE"})
    empty = F.from_json(F.lit("[{}]"), FRAGMENTS)[0]
    plain = F.array(empty.withField("type", F.lit(1)).withField("text", contents))
    looks = F.left(F.ltrim(contents), F.lit(1)) == "["
    valid = looks & F.try_parse_json(contents).isNotNull()
    return F.when(contents.isNull(), None).when(valid & array.isNotNull(), array).otherwise(plain)


def frag_text(frags: Column) -> Column:
    """Readable text of text, at, link, ad and emoji fragments, joined by one space."""
    shown = F.transform(
        frags,
        lambda f: F.when(f["type"].isin(1, 4), f["text"])
        .when(f["type"] == 2, F.concat(F.lit("["), F.coalesce(f["desc"], f["id"]), F.lit("]")))
        .when(f["type"].isin(5, 6), F.coalesce(F.nullif(f["title"], F.lit("")), F.nullif(f["text"], F.lit("")), f["url"])),
    )
    return F.array_join(F.filter(shown, lambda x: x.isNotNull() & (x != "")), " ")


def explode_frags(posts: DataFrame, contents: str = "contents") -> DataFrame:
    """archive, tid, post_id, idx and the fields of each fragment; a post without fragments has one row of nulls."""
    return posts.select("archive", "tid", F.col("id").alias("post_id"), F.posexplode_outer(parse_frags(F.col(contents))).alias("idx", "frag")).select("archive", "tid", "post_id", "idx", "frag.*")


def frag_type_name(kind: Column) -> Column:
    return F.coalesce(_lookup(FRAGMENT_TYPES, kind), F.lit("unknown"))


def has_scrape_error(frags: Column) -> Column:
    return F.coalesce(F.exists(frags, lambda f: f["type"] == -1), F.lit(False))


def unwrap_redirect(url: Column, host: str, path: str, param: str) -> Column:
    """The decoded parameter of a redirect url (null if missing or blank); other urls stay as they are."""
    wrapped = (F.lower(F.try_parse_url(url, F.lit("HOST"))) == host) & (F.try_parse_url(url, F.lit("PATH")) == path)
    target = F.nullif(F.trim(F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(param)))), F.lit(""))
    return F.when(F.coalesce(wrapped, F.lit(False)), target).otherwise(url)


def percent_encode(s: Column) -> Column:
    """RFC 3986 percent encoding without any safe character but the unreserved ones."""
    form = F.url_encode(s)
    return F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def sanitize_title(title: Column, size: int = 80) -> Column:
    """A title that can be a folder name; 'untitled' if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(title, r"[\x00-\x1f\x7f]", ""), r'[<>:"/\\|?*]', "")
    return F.coalesce(F.nullif(F.left(F.regexp_replace(clean, r"[. ]+$", ""), F.lit(size)), F.lit("")), F.lit("untitled"))


def joined_url(base: str, key: Column, suffix: str = "") -> Column:
    """Avatar, voice and user page urls: base, key, suffix; null for an empty key."""
    return F.concat(F.lit(base), F.nullif(key, F.lit("")), F.lit(suffix))


def asset_name_parts(name: Column) -> Column:
    """Struct (pid, idx) of names like p_<pid>_<idx>_...; nulls for other names."""
    part = lambda i: F.nullif(F.regexp_extract(name, r"p_(\d+)_(\d+)", i), F.lit("")).cast("bigint")
    return F.struct(part(1).alias("pid"), part(2).alias("idx"))


def asset_pid(name: Column) -> Column:
    """pid of names that contain p_<pid>_; null for others."""
    return F.nullif(F.regexp_extract(name, r"p_(\d+)_", 1), F.lit("")).cast("bigint")


def asset_identity(path: Column) -> Column:
    """The path without the 16-digit stamp before its extension."""
    return F.regexp_replace(path, r"^(.*)_\d{16}(\.[^.]+)$", "$1$2")


def content_type(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.coalesce(_lookup(CONTENT_TYPES, extension), F.lit("application/octet-stream"))


def human_count(n: Column) -> Column:
    """Ten thousands and thousands with one decimal, rounded half up; smaller numbers as they are."""

    def tenths(unit: int, mark: str) -> Column:
        t = F.floor((n + unit // 20) / (unit // 10))
        return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit(mark))

    return F.when(n >= 10000, tenths(10000, "万")).when(n >= 1000, tenths(1000, "k")).otherwise(n.cast("string"))


def relative_time(ts: Column, as_of: Column) -> Column:
    """How long before as_of (both epoch seconds) ts was; days as dates; '' for zero and null."""
    gap, when, now = as_of - ts, F.timestamp_seconds(ts), F.timestamp_seconds(as_of)
    text = F.when(gap < 60, F.lit("刚刚")).when(gap < 3600, F.concat(F.floor(gap / 60).cast("string"), F.lit("分钟前"))).when(gap < 86400, F.concat(F.floor(gap / 3600).cast("string"), F.lit("小时前")))
    text = text.when(F.year(when) == F.year(now), F.date_format(when, "MM-dd HH:mm")).otherwise(F.date_format(when, "yyyy-MM-dd HH:mm"))
    return F.when(F.coalesce(ts, F.lit(0)) == 0, "").otherwise(text)


def short_date(ts: Column, as_of: Column) -> Column:
    """Time of day on the day of as_of, else month and day in its year, else the date; '' for zero and null."""
    when, now = F.timestamp_seconds(ts), F.timestamp_seconds(as_of)
    text = F.when(F.to_date(when) == F.to_date(now), F.date_format(when, "HH:mm")).when(F.year(when) == F.year(now), F.date_format(when, "MM-dd")).otherwise(F.date_format(when, "yyyy-MM-dd"))
    return F.when(F.coalesce(ts, F.lit(0)) == 0, "").otherwise(text)


def parse_vote(vote_info: Column) -> Column:
    """The vote, or null if it has neither options nor votes."""
    vote = F.from_json(vote_info, VOTE)
    none = (F.coalesce(F.size(vote["options"]), F.lit(0)) < 1) & (F.coalesce(vote["total_vote"], F.lit(0)) == 0)
    return F.when(~none, vote)


def vote_options(threads: DataFrame) -> DataFrame:
    """archive, tid, idx, text, vote_num for each option."""
    return threads.select("archive", "tid", F.posexplode(parse_vote(F.col("vote_info"))["options"]).alias("idx", "o")).select("archive", "tid", "idx", "o.text", "o.vote_num")


def encode_forum_key(key: Column) -> Column:
    return percent_encode(F.replace(key, F.lit("/"), F.lit("~")))


def decode_forum_key(encoded: Column) -> Column:
    return F.replace(F.try_url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B"))), F.lit("~"), F.lit("/"))


_LOG = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - (\w+) - (\S+) - (.*)$"


def parse_log(line: Column) -> Column:
    """Struct (ts, level, module, label, attrs, message) of a log line; null fields if it has another shape.

    The part after the module is ``label - < key:value, ... > - message``; each of the three may be missing.
    """
    fits, rest = line.rlike(_LOG), F.regexp_extract(line, _LOG, 4)
    pairs = F.nullif(F.trim(F.regexp_extract(rest, r"< (.*?) >", 1)), F.lit(""))
    label = F.trim(F.when(rest.rlike(r"< .*? >"), F.regexp_extract(rest, r"^(.*?)(?: - )?< ", 1)).otherwise(F.regexp_extract(rest, r"^(.*?)(?: - |$)", 1)))
    message = F.when(rest.rlike(r"< .*? >"), F.regexp_extract(rest, r" > - (.*)$", 1)).otherwise(F.regexp_extract(rest, r"^.*? - (.*)$", 1))
    ts = F.try_to_timestamp(F.replace(F.regexp_extract(line, _LOG, 1), F.lit(","), F.lit(".")), F.lit("yyyy-MM-dd HH:mm:ss.SSS"))
    field = lambda c: F.when(fits, c)
    return F.struct(field(ts).alias("ts"), field(F.regexp_extract(line, _LOG, 2)).alias("level"), field(F.regexp_extract(line, _LOG, 3)).alias("module"), field(label).alias("label"), field(F.str_to_map(pairs, F.lit(", "), F.lit(":"))).alias("attrs"), field(message).alias("message"))


def strip_ansi(s: Column) -> Column:
    return F.regexp_replace(s, "\x1b\\[[0-9;]*m", "")


def config_changes(records: DataFrame) -> DataFrame:
    """archive, tid, scrape_time and, against the record before it, whether filter mode and avatar mode changed.

    records: archive, tid, scrape_time, config (JSON).  A first record changes nothing.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy("archive", "tid").orderBy("scrape_time", "config")
    now = records.withColumn("c", F.from_json("config", SCRAPE_CONFIG)).withColumn("p", F.lag("c").over(order)).withColumn("first", F.row_number().over(order) == 1)
    changed = lambda k: (~F.col("first") & ~F.col("c")[k].eqNullSafe(F.col("p")[k])).alias
    return now.select("archive", "tid", "scrape_time", changed("POST_FILTER_TYPE")("filter_changed"), changed("DOWNLOAD_USER_AVATAR_MODE")("avatar_changed"))
