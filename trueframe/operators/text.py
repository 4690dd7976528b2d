"""Comment and post-metadata jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as ft
from ..functions.rules import first_of
from .ordered import row_rank

VOTES = ("ai", "real", "admission", "source")


def claim_votes(votes: DataFrame, comments: DataFrame) -> DataFrame:
    """Directional comment counts from 1-based index arrays.

    Indices outside the sample are dropped, repeats count once, an index in
    both directions is an AI claim only, and an admission must be the creator's.
    ``comments`` is (clip_id, position, is_creator).
    """
    size = comments.groupBy("clip_id").agg(F.count(F.lit(1)).alias("sample_size"))
    rows = votes.join(size, "clip_id", "left").fillna(0, ["sample_size"])
    legal = lambda c: F.array_distinct(F.filter(c, lambda i: i.between(1, F.col("sample_size"))))
    rows = rows.withColumns({v: legal(v) for v in VOTES})
    claimed = rows.select("clip_id", F.explode("admission").alias("position")).join(
        comments.filter("is_creator").select("clip_id", "position"), ["clip_id", "position"], "left_semi").select("clip_id").distinct().withColumn("_admitted", F.lit(True))
    return rows.join(claimed, "clip_id", "left").select(
        "clip_id", "sample_size", F.size("ai").alias("claiming_ai"), F.size(F.array_except("real", "ai")).alias("claiming_real"),
        F.coalesce("_admitted", F.lit(False)).alias("creator_admission"), (F.size("source") > 0).alias("credible_source"))


def comment_batch(comments: DataFrame, order: str, block: int = 4096, limit: int = 800) -> DataFrame:
    """Comments numbered from 1 per clip, on one line, cut to the batch's length."""
    ranked = row_rank(comments.withColumn("_b", F.floor(F.col(order) / block)), ["clip_id"], "_b", [F.col(order)], "number")
    return ranked.withColumn("text", ft.one_line(F.col("text"), limit)).drop("_b")


RECORD = ("extractor string, extractorKey string, id string, displayId string, playlistCount string, "
          "playlistIndex string, description string")


def match_metadata(posts: DataFrame, record: str = "record") -> DataFrame:
    """Extractor record against the requested post: (platform, media_id requested).

    One media item, the right extractor, and an id equal to the request's;
    share links carry no id to compare. Reject code is null on a match, and
    ``disclosed`` says whether the matched post's caption claims an AI origin.
    """
    r = F.from_json(record, RECORD)
    rows = posts.withColumn("_r", r)
    c = lambda f: F.col(f"_r.{f}")
    safe = lambda v: F.when(v.rlike(r"^[A-Za-z0-9_-]{1,80}\z") & (v != "NA"), v)
    name = F.when(F.col("platform") == "x", "twitter").otherwise(F.col("platform"))
    pretty = first_of((F.col("platform") == "x", "Twitter"), (F.col("platform") == "instagram", "Instagram"), (F.col("platform") == "tiktok", "TikTok"))
    media, shown = safe(c("id")), safe(c("displayId"))
    number = lambda f: F.coalesce(c(f).try_cast("double"), F.lit(0.0))  # noqa: E731  (a count may come as text)
    count, index = number("playlistCount"), number("playlistIndex")
    asked = F.when(F.col("platform") == "x", shown).otherwise(media)
    reject = first_of(
        (~F.col("platform").isin("instagram", "tiktok", "x"), "platform_not_supported"),
        (~F.lower(c("extractor")).eqNullSafe(name) | ~c("extractorKey").eqNullSafe(pretty), "wrong_extractor"),
        ((count > 1) | (index > 1) | ((index > 0) & (count != 1)), "several_media_items"),
        (media.isNull(), "media_id_unverified"),
        (~F.startswith("media_id", F.lit("share-")) & ~asked.eqNullSafe(F.col("media_id")), "different_post"))
    caption = ft.scrub_links(F.nullif(c("description"), F.lit("NA")))
    ok = reject.isNull()
    # a column of its own, so that the scrubbed caption, which costs the most, is made once for both uses
    matched = rows.withColumns({"reject": reject, "matched_id": F.when(ok, media), "post_id": F.when(ok, asked), "caption": F.when(ok, caption)})
    return matched.withColumn("disclosed", F.when(F.col("reject").isNull(), ft.caption_claim(F.col("caption")))).drop("_r")
