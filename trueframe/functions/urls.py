"""Canonical media URLs and deep links as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .policy import moment_seconds
from .rules import first_of

# Hosts of each platform.
YOUTUBE = ("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtube-nocookie.com", "www.youtube-nocookie.com")
TIKTOK = ("tiktok.com", "www.tiktok.com", "m.tiktok.com")
TIKTOK_SHORT = ("vm.tiktok.com", "vt.tiktok.com")
INSTAGRAM = ("instagram.com", "www.instagram.com", "m.instagram.com")
X = ("x.com", "www.x.com", "m.x.com", "mobile.x.com", "twitter.com", "www.twitter.com", "m.twitter.com", "mobile.twitter.com")
# Id formats.
FORMATS = {
    "youtube_id": r"^[A-Za-z0-9_-]{11}\z", "tiktok_id": r"^\d{8,24}\z", "tiktok_code": r"^[A-Za-z0-9_-]{4,64}\z",
    "instagram_code": r"^[A-Za-z0-9_-]{5,32}\z", "instagram_token": r"^[A-Za-z0-9_-]{5,64}\z",
    "instagram_handle": r"^@?[A-Za-z0-9._]{1,30}\z", "x_id": r"^[1-9]\d{0,19}\z", "x_handle": r"^[A-Za-z0-9_]{1,15}\z",
}
MAX_LENGTH = 2048


def parsed(url: Column) -> dict[str, Column]:
    value = F.regexp_replace(url, r"^\s+|\s+\z", "")
    scheme = F.lower(F.regexp_extract(value, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(value, r"^[^:/?#]+:/+([^/?#]*)", 1)
    host_port = F.regexp_replace(authority, r"^.*@", "")
    path = F.regexp_extract(value, r"^[^:/?#]+:/+[^/?#]*([^?#]*)", 1)
    return {
        "value": value, "scheme": scheme, "authority": authority,
        "host": F.regexp_replace(F.lower(F.regexp_replace(host_port, r":\d*\z", "")), r"\.\z", ""),
        "port": F.regexp_extract(host_port, r":(\d+)\z", 1), "path": path,
        "parts": F.filter(F.split(path, "/"), lambda p: p != ""),
        "query": F.regexp_extract(value, r"^[^?#]*\?([^#]*)", 1)}


def with_canonical(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds platform, media_id, canonical_key, canonical_url and a reject code.

    Tracking parameters never survive: the canonical URL is rebuilt from the
    id. The parsed parts are columns of their own, so each is computed once.
    """
    df = df.withColumns({f"_u_{k}": v for k, v in parsed(F.col(url)).items()})
    u = {k: F.col(f"_u_{k}") for k in ("value", "scheme", "authority", "host", "port", "path", "parts", "query")}
    host, parts, n = u["host"], u["parts"], F.size(u["parts"])
    part = lambda i: F.get(parts, F.lit(i))
    fits = lambda text, name: F.coalesce(text.rlike(FORMATS[name]), F.lit(False))
    default_port = ((u["scheme"] == "https") & (u["port"] == "443")) | ((u["scheme"] == "http") & (u["port"] == "80"))
    invalid = first_of(
        ((u["value"] == "") | (F.length(u["value"]) > MAX_LENGTH), "empty_or_too_long"),
        ((u["scheme"] == "") | (u["authority"] == "") | u["value"].rlike(r"^[^?#]*\s") & (u["authority"].rlike(r"\s")), "not_a_url"),
        (~u["scheme"].isin("http", "https"), "scheme_not_supported"),
        (u["authority"].contains("@") | ((u["port"] != "") & ~default_port), "credentials_or_port"))

    watch = F.try_url_decode(F.regexp_extract(u["query"], r"(?:^|&)v=([^&]*)", 1))
    short_tube = host == "youtu.be"
    tube_kind = part(0).isin("shorts", "embed", "live")
    tube_id = F.nullif(first_of(
        (short_tube, F.when(n == 1, part(0))), (host.isin(*YOUTUBE) & (u["path"] == "/watch"), watch),
        (host.isin(*YOUTUBE) & tube_kind & (n == 2), part(1))), F.lit(""))
    tube_error = first_of(
        (short_tube & (n != 1), "youtube_share_invalid"),
        (host.isin(*YOUTUBE) & (u["path"] != "/watch") & tube_kind & (n != 2), "youtube_path_invalid"),
        (tube_id.isNotNull() & ~fits(tube_id, "youtube_id"), "youtube_id_invalid"))

    tok_video = host.isin(*TIKTOK) & (n == 3) & F.startswith(part(0), F.lit("@")) & (part(1) == "video")
    tok_path = (host == "www.tiktok.com") & (n == 2) & (part(0) == "t")
    tok_host = host.isin(*TIKTOK_SHORT) & (n == 1)
    tok_code = F.when(tok_path, part(1)).when(tok_host, part(0))
    tok = host.isin(*TIKTOK, *TIKTOK_SHORT)
    tok_error = F.when(tok, first_of(
        (tok_video & ~fits(part(2), "tiktok_id"), "tiktok_id_invalid"), ((tok_path | tok_host) & ~fits(tok_code, "tiktok_code"), "tiktok_share_invalid"),
        (~(tok_video | tok_path | tok_host), "tiktok_not_a_video")))

    gram = host.isin(*INSTAGRAM)
    gram_kinds = ("reel", "reels", "p", "tv")
    gram_share = (n == 3) & (part(0) == "share") & (part(1) == "reel")
    gram_short = (n == 2) & part(0).isin(*gram_kinds)
    gram_long = (n == 3) & fits(part(0), "instagram_handle") & part(1).isin(*gram_kinds)
    gram_kind = F.when(gram_short, part(0)).when(gram_long, part(1))
    gram_code = F.when(gram_short, part(1)).when(gram_long, part(2))
    gram_error = F.when(gram, first_of(
        (gram_share & ~fits(part(2), "instagram_token"), "instagram_share_invalid"),
        (gram_share, None), (~(gram_short | gram_long), "instagram_not_a_post"), (~fits(gram_code, "instagram_code"), "instagram_code_invalid")))

    x = host.isin(*X)
    x_plain = (n == 3) & (part(0) == "i") & (part(1) == "status")
    x_named = (n >= 3) & fits(part(0), "x_handle") & (part(1) == "status") & ~x_plain
    x_tail = (n == 3) | ((n == 5) & part(3).isin("video", "photo") & part(4).rlike(r"^[1-9]\d*\z"))
    x_web = (n == 4) & (part(0) == "i") & (part(1) == "web") & (part(2) == "status")
    x_old = (n == 2) & (part(0) == "statuses")
    x_id = first_of((x_plain | x_named, part(2)), (x_web, part(3)), (x_old, part(1)))
    x_error = F.when(x, first_of(
        (x_named & ~x_tail, "x_path_invalid"), (~(x_plain | x_named | x_web | x_old), "x_not_a_status"), (~fits(x_id, "x_id"), "x_id_invalid")))

    df = df.withColumns({
        "_tube": tube_id, "_tube_error": tube_error, "_tok": F.coalesce(tok, F.lit(False)), "_tok_video": F.coalesce(tok_video, F.lit(False)),
        "_tok_path": F.coalesce(tok_path, F.lit(False)), "_tok_code": tok_code, "_gram_share": F.coalesce(gram & gram_share, F.lit(False)),
        "_gram_kind": gram_kind, "_gram_code": gram_code, "_x_id": x_id,
        "_error": F.coalesce(invalid, tube_error, tok_error, gram_error, x_error)})
    tube_id, tube_error, tok, tok_video, tok_path, tok_code = (F.col(c) for c in (
        "_tube", "_tube_error", "_tok", "_tok_video", "_tok_path", "_tok_code"))
    gram_share, gram_kind, gram_code, x_id = (F.col(c) for c in ("_gram_share", "_gram_kind", "_gram_code", "_x_id"))
    platform = first_of((tube_id.isNotNull() | tube_error.isNotNull(), "youtube"), (tok, "tiktok"), (gram, "instagram"), (x, "x"))
    df = df.withColumn("_platform", platform)
    platform = F.col("_platform")
    share = F.concat(F.lit("share-"), host, F.lit("-"), tok_code)
    media = first_of((platform == "youtube", tube_id), (tok_video, part(2)), (tok, share),
                     (gram_share, F.concat(F.lit("share-reel-"), part(2))), (gram, gram_code), (x, x_id))
    key = first_of(
        (tok & ~tok_video, F.concat(F.lit("tiktok:share:"), host, F.lit(":"), tok_code)),
        (gram_share, F.concat(F.lit("instagram:share:reel:"), part(2))), otherwise=F.concat(platform, F.lit(":"), F.col("_media")))
    target = first_of(
        (platform == "youtube", F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("_media"))),
        (tok_video, F.concat(F.lit("https://www.tiktok.com/@_/video/"), F.col("_media"))),
        (tok_path, F.concat(F.lit("https://www.tiktok.com/t/"), tok_code, F.lit("/"))),
        (tok, F.concat(F.lit("https://"), host, F.lit("/"), tok_code)),
        (gram_share, F.concat(F.lit("https://www.instagram.com/share/reel/"), part(2), F.lit("/"))),
        (gram, F.concat(F.lit("https://www.instagram.com/"), F.when(gram_kind == "p", "p").otherwise("reel"), F.lit("/"), F.col("_media"), F.lit("/"))),
        (x, F.concat(F.lit("https://x.com/i/status/"), F.col("_media"))))
    df = df.withColumn("_media", media).withColumn("reject", F.coalesce("_error", F.when(platform.isNull(), "unsupported")))
    ok = F.col("reject").isNull()
    out = df.withColumns({"platform": F.when(ok, platform), "media_id": F.when(ok, F.col("_media")),
                          "canonical_key": F.when(ok, key), "canonical_url": F.when(ok, target)})
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def moment_link(url: Column, timestamp: Column) -> Column:
    """The source URL with t=Ns for the one platform that supports it, else null."""
    u = parsed(url)
    seconds = moment_seconds(timestamp)
    fragment = F.regexp_extract(u["value"], r"(#.*)\z", 1)
    others = F.array_join(F.filter(F.split(u["query"], "&"), lambda q: (q != "") & ~q.rlike(r"^t(=|\z)")), "&")
    stamp = F.concat(F.lit("t="), F.floor(seconds).cast("string"), F.lit("s"))
    path = F.when(u["path"] == "", "/").otherwise(u["path"])
    built = F.concat(u["scheme"], F.lit("://"), u["host"], path, F.lit("?"),
                     F.when(others == "", stamp).otherwise(F.concat(others, F.lit("&"), stamp)), fragment)
    here = u["host"].rlike(r"(^|\.)youtube\.com\z") | (u["host"] == "youtu.be")
    return F.when(here & seconds.isNotNull(), built)
