import pytest
from pyspark.sql import functions as F

from trueframe.functions import text as ft
from trueframe.functions import urls as fu
from trueframe.functions.rules import decision_of, error_category
from trueframe.operators import text as o


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("text, want", [
    ("This video was made with AI.", True), ("our reel is AI-generated", True), ("Look! #AIgenerated", True), ("Our clip was created with Sora today", True), ("Clip created with Sora today", False),
    ("generated by generative AI", True), ("Made using Kling", True),
    ("Is this AI-generated?", False), ("Not AI-generated at all.", False), ("Learn how: made with AI", False), ("this was filmed; made with care", False),
    ("A tutorial. Made with AI", True),  # only the statement with the word is dropped
    ("no way\nmade with AI", True), ("#aigeneratedart", False), ("somebody said ai-generated", False), ("", False), (None, False)])
def test_caption_claims(spark, text, want):
    assert one(spark, text, ft.caption_claim) is want


@pytest.mark.parametrize("text, want", [
    ("see https://a.example/x?y=1 now", "see [link removed] now"), ("WWW.Example.com/path, ok", "[link removed] ok"), ("go to foo.example.org", "go to [link removed]"),
    ("a\x00b\x07c", "abc"), ("   ", None), ("", None), (None, None), ("é.com stays", "é.com stays"), ("x" * 2500, "x" * 2000)])
def test_scrub(spark, text, want):
    assert one(spark, text, ft.scrub_links) == want


def test_disclosures(spark):
    def found(title, text):
        df = spark.createDataFrame([(title, text)], "a string, b string")
        return df.select(ft.disclosure_codes(F.col("a"), F.col("b")).alias("x")).first().x
    assert found("[AI-generated] - clip", "nothing") == ["title_label"]
    assert found("x", "This is AI generated\r\nmade with Veo") == ["description_ai_generated", "description_names_generator"]
    assert found("x", "Is this ai-generated? no idea") == []
    assert found("x", "never ai-generated\n#syntheticmedia") == ["description_hashtag"]


URLS = [
    ("https://www.youtube.com/watch?v=dQw4w9WgXcQ&t=3", "youtube:dQw4w9WgXcQ", None), ("https://youtu.be/dQw4w9WgXcQ?si=x", "youtube:dQw4w9WgXcQ", None),
    ("HTTPS://M.YouTube.com/live/dQw4w9WgXcQ", "youtube:dQw4w9WgXcQ", None), ("https://www.youtube.com/embed/dQw4w9WgXcQ/more", None, "youtube_path_invalid"),
    ("https://youtube.com/watch?v=abc", None, "youtube_id_invalid"), ("https://youtube.com/watch", None, "unsupported"),
    ("https://www.tiktok.com/@a/video/12345678901", "tiktok:12345678901", None), ("https://vt.tiktok.com/ZSabc/", "tiktok:share:vt.tiktok.com:ZSabc", None),
    ("https://m.tiktok.com/t/ZSabc", None, "tiktok_not_a_video"), ("https://www.tiktok.com/t/Z", None, "tiktok_share_invalid"),
    ("https://www.instagram.com/some.user/reel/CabcDEF/", "instagram:CabcDEF", None), ("https://instagram.com/tv/Cabc_12", "instagram:Cabc_12", None),
    ("https://www.instagram.com/share/reel/tok_1", "instagram:share:reel:tok_1", None), ("https://www.instagram.com/p/ab", None, "instagram_code_invalid"),
    ("https://x.com/user/status/1234/photo/2", "x:1234", None), ("https://twitter.com/user/status/1234/likes", None, "x_path_invalid"),
    ("https://x.com/i/web/status/99", "x:99", None), ("https://x.com/home", None, "x_not_a_status"), ("https://x.com./i/status/77", "x:77", None),
    ("https://x.com:8080/i/status/1", None, "credentials_or_port"), ("https://x.com:443/i/status/1", "x:1", None), ("https://me@x.com/i/status/1", None, "credentials_or_port"),
    ("ftp://x.com/i/status/1", None, "scheme_not_supported"), ("", None, "empty_or_too_long"), ("x.com/i/status/1", None, "not_a_url"),
    ("https://example.com/watch?v=dQw4w9WgXcQ", None, "unsupported"), ("https://youtube.com.evil.org/watch?v=dQw4w9WgXcQ", None, "unsupported")]


def test_canonical_urls(spark):
    df = fu.with_canonical(spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(URLS)], "i int, url string"))
    got = {r.i: (r.canonical_key, r.reject) for r in df.collect()}
    for i, (url, key, reject) in enumerate(URLS):
        assert got[i] == (key, reject), url


def test_moment_links(spark):
    df = spark.createDataFrame([("https://www.youtube.com/watch?v=a&t=9s", "1:05.9"), ("https://youtu.be/a", "0:61"), ("https://x.com/a", "0:01")], "u string, t string")
    got = [r.x for r in df.select(fu.moment_link(F.col("u"), F.col("t")).alias("x")).collect()]
    assert got == ["https://www.youtube.com/watch?v=a&t=65s", None, None]


def test_votes_are_counted_once_and_in_range(spark):
    comments = spark.createDataFrame([(1, i, i == 2) for i in (1, 2, 3)], "clip_id int, position long, is_creator boolean")
    votes = spark.createDataFrame([(1, [1, 1, 2, 9], [2, 3, 0], [1, 2], [4]), (2, [1], [], [], [])],
                                  "clip_id int, ai array<bigint>, real array<bigint>, admission array<bigint>, source array<bigint>")
    got = {r.clip_id: tuple(r)[1:] for r in o.claim_votes(votes, comments).collect()}
    assert got == {1: (3, 2, 1, True, False), 2: (0, 0, 0, False, False)}


def test_decision_words_and_error_priority(spark):
    df = spark.createDataFrame([("Likely AI", None), ("UNCERTAIN", None), ("Likely AI", "not_ai"), ("maybe", None)], "v string, d string")
    assert [r.x for r in df.select(decision_of(F.col("d"), F.col("v")).alias("x")).collect()] == ["ai", "abstain", "not_ai", None]
    for text, want in (("HTTP 429 invalid json", "ProviderRateLimit"), ("request timed out while parsing", "OperationalTimeout"), ("IdentityMismatch: cache", "IdentityMismatch: cache"), ("?", "UnclassifiedOperationalError")):
        assert one(spark, text, error_category) == want


def test_bare_domains_as_by_the_plain_pattern(spark):
    import random
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a", "B", "7", "-", ".", "_", "/", " ", "é", "co", "x.y"]) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.regexp_replace("text", rf"(?i){ft.BOUND}(?:[a-z0-9-]+\.)+[a-z]{{2,}}(?:/[^\s   ﻿<>\"']*)?", "[link removed]")
    assert df.filter(~ft.scrub_links(F.col("text")).eqNullSafe(F.nullif(ft.strip(plain), F.lit("")))).collect() == []


def test_matched_captions_are_scrubbed_once(spark):
    from trueframe.plans import QUERIES
    plan = QUERIES["match_disclosures"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("https?:") == 2  # one scrub, whose nullif names it twice


def test_strip_trims_what_the_space_class_matches(spark):
    every = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(f"{c}{c}x{c} y{c}",) for c in every] + [("",), (" \u3000 ",), (None,)], "text string")
    assert df.filter(~ft.strip(F.col("text")).eqNullSafe(F.regexp_replace("text", rf"^{ft.SPACE}+|{ft.SPACE}+\z", ""))).collect() == []
