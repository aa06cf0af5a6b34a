"""Users of threads: who is mentioned, what is still to be looked up, and names for posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions.scalars import explode_frags
from threadlake.operators.merge import first_rows

ANONYMOUS = "匿名"


def collect_users(posts: DataFrame, profiles: DataFrame | None = None, frags: DataFrame | None = None) -> DataFrame:
    """archive, tid, user_id, nickname, portrait of everyone mentioned; the first registration wins.

    Order: floor authors, sub-post authors, @-mentions (whose text is the nickname), reply-to ids.
    User id 0 is nobody.  ``profiles`` (user_id, portrait, nick_name) fills authors' names.
    """
    frags = explode_frags(posts) if frags is None else frags
    none = F.lit(None).cast("string").alias("nickname")
    base = lambda df, who, name, priority: df.select("archive", "tid", F.col(who).alias("user_id"), name, F.lit(priority).alias("priority")).distinct()
    everyone = base(posts.where("parent_id = 0"), "user_id", none, 1).union(base(posts.where("parent_id <> 0"), "user_id", none, 2))
    everyone = everyone.union(base(frags.where("type = 4"), "user_id", F.regexp_replace("text", "^@", "").alias("nickname"), 3)).union(base(posts, "reply_to_id", none, 4))
    found = first_rows(everyone.where("user_id <> 0"), ["archive", "tid", "user_id"], ["priority", "nickname"])
    if profiles is None:
        return found.select("archive", "tid", "user_id", F.lit(None).cast("string").alias("portrait"), "nickname", "priority")
    known = first_rows(profiles.select("user_id", "portrait", F.col("nick_name").alias("_nick")), ["user_id"])
    return found.join(known, "user_id", "left").select("archive", "tid", "user_id", "portrait", F.coalesce("nickname", "_nick").alias("nickname"), "priority")


def users_to_complete(users: DataFrame) -> DataFrame:
    return users.where(~F.coalesce("completed", F.lit(False)))


def complete_users(users: DataFrame, profiles: DataFrame, ts: int) -> DataFrame:
    """users not completed yet, with what a lookup found; others as they are.

    No profile: status 1.  A username of '-' keeps the old one and an empty one is null; nickname is the new,
    the old, the plain one or ''; a site number of 0 is null.
    """
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    p = first_rows(profiles, ["user_id"]).select(F.col("user_id"), *(F.col(c).alias(f"_{c}") for c in profiles.columns if c != "user_id"), F.lit(True).alias("_found"))
    open_ = ~F.coalesce("completed", F.lit(False))
    joined = users.withColumn("_open", open_).join(p, "user_id", "left")
    found, now = F.col("_open") & F.col("_found"), F.col("_open")
    values = {
        "username": F.when(found, F.when(F.col("_user_name") == "-", F.col("username")).otherwise(some("_user_name"))).otherwise(F.col("username")),
        "nickname": F.when(found, F.coalesce(some("_nick_name_new"), some("_nick_name_old"), some("_nick_name"), F.lit(""))).otherwise(F.col("nickname")),
        "site_uid": F.when(found, F.nullif(F.col("_site_uid"), F.lit(0))).otherwise(F.col("site_uid")),
        "status": F.when(now & F.col("_found").isNull(), F.lit(1)).otherwise(F.col("status")),
        "completed": F.when(now, F.lit(True)).otherwise(F.col("completed")),
        "scrape_time": F.when(now, F.lit(ts)).otherwise(F.col("scrape_time")),
    }
    for c in profiles.columns:
        if c in users.columns and c not in values and c != "user_id":
            values[c] = F.when(found, F.col(f"_{c}")).otherwise(F.col(c))
    return joined.select(*(values[c].cast(users.schema[c].dataType).alias(c) if c in values else F.col(c) for c in users.columns))


def attach_users(posts: DataFrame, users: DataFrame) -> DataFrame:
    """posts with display_name and avatar of their authors; id 0 and unknown authors are anonymous.

    A user is found by id, else by a portrait that equals the id (older versions have no ids).  Id 0 is
    a hot key that never matches, so its rows don't take part in the join.
    """
    row = ["archive", "tid", "username", "nickname", F.col("avatar").alias("user_avatar"), "portrait"]
    by_id = users.where("user_id <> 0").select(*row, "user_id", F.lit(0).alias("_by"))
    by_portrait = users.select(*row, F.col("portrait").try_cast("bigint").alias("user_id"), F.lit(1).alias("_by")).where("user_id <> 0 and portrait = cast(user_id as string)")
    known = first_rows(by_id.unionByName(by_portrait), ["archive", "tid", "user_id"], ["_by", "portrait"])
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    named = posts.where("user_id <> 0").join(known, ["archive", "tid", "user_id"], "left").select(*(posts[c] for c in posts.columns if c not in ("archive", "tid", "user_id")), "archive", "tid", "user_id", F.coalesce(some("nickname"), some("username"), F.lit(ANONYMOUS)).alias("display_name"), "user_avatar")
    nobody = posts.where("user_id = 0 or user_id is null").withColumn("display_name", F.lit(ANONYMOUS)).withColumn("user_avatar", F.lit(None).cast("string"))
    return named.select(*posts.columns, "display_name", "user_avatar").unionByName(nobody)
