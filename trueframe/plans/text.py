"""URL, caption, disclosure and comment queries."""

from pyspark.sql import functions as F

from ..functions import text as ft
from ..functions import urls as fu
from ..operators import text as o
from ..session import spread
from .registry import ORACLES, query

EXPECTED = """CASE form WHEN 0 THEN 'youtube:'||k WHEN 1 THEN 'youtube:'||k WHEN 2 THEN 'youtube:'||k WHEN 3 THEN 'youtube:'||k WHEN 6 THEN 'tiktok:'||n
   WHEN 7 THEN 'tiktok:share:vm.tiktok.com:'||k WHEN 8 THEN 'tiktok:share:www.tiktok.com:'||k WHEN 10 THEN 'instagram:'||k WHEN 11 THEN 'instagram:'||k WHEN 12 THEN 'instagram:share:reel:'||k
   WHEN 14 THEN 'x:'||n WHEN 15 THEN 'x:'||n WHEN 16 THEN 'x:'||n WHEN 22 THEN 'x:'||n END"""
TARGET = """CASE form WHEN 0 THEN 'https://www.youtube.com/watch?v='||k WHEN 1 THEN 'https://www.youtube.com/watch?v='||k WHEN 2 THEN 'https://www.youtube.com/watch?v='||k WHEN 3 THEN 'https://www.youtube.com/watch?v='||k
   WHEN 6 THEN 'https://www.tiktok.com/@_/video/'||n WHEN 7 THEN 'https://vm.tiktok.com/'||k WHEN 8 THEN 'https://www.tiktok.com/t/'||k||'/' WHEN 10 THEN 'https://www.instagram.com/reel/'||k||'/'
   WHEN 11 THEN 'https://www.instagram.com/p/'||k||'/' WHEN 12 THEN 'https://www.instagram.com/share/reel/'||k||'/' WHEN 14 THEN 'https://x.com/i/status/'||n WHEN 15 THEN 'https://x.com/i/status/'||n
   WHEN 16 THEN 'https://x.com/i/status/'||n WHEN 22 THEN 'https://x.com/i/status/'||n END"""
REJECT = """CASE form WHEN 4 THEN 'youtube_id_invalid' WHEN 5 THEN 'youtube_share_invalid' WHEN 9 THEN 'tiktok_not_a_video' WHEN 13 THEN 'instagram_not_a_post' WHEN 17 THEN 'x_id_invalid'
   WHEN 18 THEN 'credentials_or_port' WHEN 19 THEN 'scheme_not_supported' WHEN 20 THEN 'not_a_url' WHEN 21 THEN 'unsupported' WHEN 23 THEN 'unsupported' END"""


@query("canonical_urls", f"SELECT page_id, form, split_part({EXPECTED}, ':', 1) AS platform, {EXPECTED} AS canonical_key, {TARGET} AS canonical_url, {REJECT} AS reject FROM {{urls}}")
def _(t):
    return fu.with_canonical(t.urls.select("page_id", "form", "url")).select(
        "page_id", "form", "platform", "canonical_key", "canonical_url", "reject")


@query("moment_links", """SELECT page_id, form, CASE WHEN page_id % 5<>4 AND form IN (0,1,2,4,5,23) THEN CASE form WHEN 0 THEN 'https://www.youtube.com/watch?v='||k||'&utm_source=share&t='
   WHEN 1 THEN 'http://youtu.be/'||k||'?si=abc&t=' WHEN 2 THEN 'https://m.youtube.com/shorts/'||k||'/?t=' WHEN 4 THEN 'https://youtube.com/watch?v=short&t=' WHEN 5 THEN 'https://youtu.be/'||k||'/extra?t='
   ELSE 'https://www.youtube.com/channel/abc?t=' END || (60*(page_id % 3)+page_id % 50+10) || 's' END AS link FROM {urls} WHERE form NOT IN (18, 20)""")
def _(t):
    p = F.col("page_id")
    stamp = F.when(p % 5 == 4, "1:75").otherwise(F.concat((p % 3).cast("string"), F.lit(":"), (p % 50 + 10).cast("string"), F.lit(".5")))
    return t.urls.filter("form not in (18, 20)").select("page_id", "form", fu.moment_link(F.col("url"), stamp).alias("link"))


@query("scrub_links", r"""SELECT doc_id, nullif(substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(caption, '(?i)(?:https?://|www\.)[^\s<>"'']+', '[link removed]', 'g'),
   '(?i)\b(?:[a-z0-9-]+\.)+[a-z]{{2,}}(?:/[^\s<>"'']*)?', '[link removed]', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '^\s+|\s+$', '', 'g'), 1, 2000), '') AS caption FROM {captions}""")
def _(t):
    return spread(t.captions.select("doc_id", "caption")).select("doc_id", ft.scrub_links(F.col("caption")).alias("caption"))


SUBJ = r"^\s*(?:(?:this|the|my|our)\s+(?:video|clip|reel|scene|footage)\s+(?:(?:is|was)\s+)?)?"


@query("caption_claims", r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(replace(caption, chr(10), chr(1)), '([.!?])[\s\x01]+', '\1' || chr(1), 'g'), chr(1))) AS s FROM {captions}),
  k AS (SELECT DISTINCT doc_id FROM s WHERE NOT contains(s,'?') AND NOT regexp_matches(s, '(?i)\b(?:not|no|never|without|isn''t|isnt|wasn''t|wasnt|tutorial|learn|review|example|detector|detect|spot)\b')
   AND (regexp_matches(s, '(?i)""" + SUBJ + r"""(?:ai[- ]generated|generated (?:with|using|by) (?:generative )?ai|made (?:with|using) (?:generative )?ai)\b')
     OR regexp_matches(s, '(?i)(?:^|\s)#(?:aigenerated|aivideo|madewithai|syntheticmedia)\b')
     OR regexp_matches(s, '(?i)""" + SUBJ + r"""(?:made|generated|created) (?:with|using|by) (?:veo|sora|runway|kling|hailuo|luma|pika|higgsfield)\b')))
  SELECT c.doc_id, k.doc_id IS NOT NULL AS claim FROM {captions} c LEFT JOIN k ON c.doc_id=k.doc_id""")
def _(t):
    return spread(t.captions.select("doc_id", "caption")).select("doc_id", ft.caption_claim(F.col("caption")).alias("claim"))


@query("disclosure_scan", r"""WITH l AS (SELECT doc_id, unnest(string_split_regex(caption, '\r?\n')) AS s FROM {captions}), d AS (SELECT doc_id, string_agg(s, chr(10)) AS x FROM l WHERE
    NOT (contains(s,'?') AND regexp_matches(s, '(?i)\b(?:is|was|could|might).{{0,30}}(?:ai[ -]generated|synthetic)\b'))
    AND NOT regexp_matches(s, '(?i)\b(?:not|no|never|without)\b.{{0,30}}\b(?:ai[ -]generated|generated (?:using|with|by) (?:generative )?ai|synthetic media)\b') GROUP BY 1)
  SELECT c.doc_id, concat_ws('|', CASE WHEN regexp_matches(title, '(?i)^\s*[\[(]?(?:ai[ -]generated|synthetic media|made with (?:veo|sora|runway|kling))[\])]?\s*[:|-]') THEN 'title_label' END,
   CASE WHEN regexp_matches(x, '(?i)\b(?:ai|artificial intelligence)[ -]generated\b') THEN 'description_ai_generated' END,
   CASE WHEN regexp_matches(x, '(?i)\bgenerated (?:using|with|by) (?:generative )?(?:ai|artificial intelligence)\b') THEN 'description_ai_generator' END,
   CASE WHEN regexp_matches(x, '(?i)\bmade (?:using|with) (?:generative )?(?:ai|artificial intelligence)\b') THEN 'description_made_with_ai' END,
   CASE WHEN regexp_matches(x, '(?i)\b(?:synthetic media|synthetic video|ai[ -]altered|ai[ -]created)\b') THEN 'description_synthetic_media' END,
   CASE WHEN regexp_matches(x, '(?i)#(?:aigenerated|syntheticmedia)\b') THEN 'description_hashtag' END,
   CASE WHEN regexp_matches(x, '(?i)\bmade (?:using|with) (?:veo|sora|runway|kling|hailuo|luma|pika|higgsfield)\b') THEN 'description_names_generator' END) AS reasons
  FROM {captions} c LEFT JOIN d ON c.doc_id=d.doc_id""")
def _(t):
    return spread(t.captions.select("doc_id", "title", "caption")).select("doc_id", F.array_join(ft.disclosure_codes(F.col("title"), F.col("caption")), "|").alias("reasons"))


VOTE = {"ai": (2, 2, 1, 5), "real": (3, 2, 4, 6), "admission": (2, 7, 11, 9), "source": (40, 13, 40, 40)}


@query("claim_votes", "WITH n AS (SELECT conv_id, count(*) AS k, list(turn+1) FILTER (role='assistant') AS mine FROM {conversations} GROUP BY 1), v AS (SELECT conv_id, k, mine, "
       + ", ".join(f"list_filter(list_distinct([{', '.join(f'(conv_id % {m})::BIGINT' for m in mods)}, {mods[0]}::BIGINT]), lambda i: i>=1 AND i<=k) AS {name}" for name, mods in VOTE.items())
       + """ FROM n) SELECT conv_id AS clip_id, k AS sample_size, len(ai)::INT AS claiming_ai, len(list_filter(real, lambda i: NOT list_contains(ai, i)))::INT AS claiming_real,
   len(list_filter(admission, lambda i: list_contains(mine, i)))>0 AS creator_admission, len(source)>0 AS credible_source FROM v""")
def _(t):
    k = F.col("conv_id")
    comments = t.conversations.select(k.alias("clip_id"), (F.col("turn") + 1).alias("position"), (F.col("role") == "assistant").alias("is_creator"))
    votes = t.conversations.select("conv_id").distinct().select(k.alias("clip_id"), *[
        F.array(*[(k % m).cast("long") for m in mods], F.lit(mods[0]).cast("long")).alias(name) for name, mods in VOTE.items()])
    return o.claim_votes(votes, comments)


@query("comment_batch", r"""SELECT conv_id AS clip_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number, role='assistant' AS is_creator,
   substr(regexp_replace(text, '\s+', ' ', 'g'), 1, 800) AS text FROM {conversations}""")
def _(t):
    rows = t.conversations.select(F.col("conv_id").alias("clip_id"), "turn", (F.col("role") == "assistant").alias("is_creator"), "text")
    return o.comment_batch(rows, "turn").select("clip_id", "number", "is_creator", "text")


@query("match_metadata", """SELECT page_id, CASE WHEN p % 4=3 THEN 'platform_not_supported' WHEN p % 9=2 THEN 'wrong_extractor' WHEN p % 10=3 THEN 'several_media_items' WHEN p % 11=4 THEN 'media_id_unverified'
    WHEN p % 13=5 THEN 'different_post' END AS reject, CASE WHEN p % 4<>3 AND p % 9<>2 AND p % 10<>3 AND p % 11<>4 AND p % 13<>5 THEN 'm'||p END AS matched_id,
    CASE WHEN p % 4<>3 AND p % 9<>2 AND p % 10<>3 AND p % 11<>4 AND p % 13<>5 THEN 'look [link removed] now' END AS caption FROM (SELECT page_id, page_id AS p FROM {pages})""")
def _(t):
    p = F.col("page_id")
    platform = F.when(p % 4 == 3, "youtube").when(p % 4 == 0, "x").when(p % 4 == 1, "tiktok").otherwise("instagram")
    own = F.concat(F.lit("m"), p.cast("string"))
    record = F.to_json(F.struct(
        F.when(p % 9 == 2, "generic").when(p % 4 == 0, "Twitter").when(p % 4 == 1, "tiktok").otherwise("instagram").alias("extractor"),
        F.when(p % 4 == 0, "Twitter").when(p % 4 == 1, "TikTok").otherwise("Instagram").alias("extractorKey"),
        F.when(p % 11 == 4, "NA").otherwise(own).alias("id"), own.alias("displayId"), F.when(p % 10 == 3, 2).otherwise(1).alias("playlistCount"),
        F.lit(1).alias("playlistIndex"), F.concat(F.lit(" look "), "url", F.lit(" now ")).alias("description")))
    rows = t.pages.select("page_id", "url", platform.alias("platform"), F.when(p % 13 == 5, "zz").otherwise(own).alias("media_id"), record.alias("record"))
    return o.match_metadata(rows).select("page_id", "reject", "matched_id", "caption")


@query("match_disclosures", "WITH sc AS (" + ORACLES["scrub_links"] + "), cl AS (" + ORACLES["caption_claims"].replace("{captions}", "sc") + """)
  SELECT doc_id, CASE WHEN doc_id % 7=3 THEN 'different_post' END AS reject, CASE WHEN doc_id % 7<>3 THEN claim END AS disclosed FROM cl""")
def _(t):
    own = F.concat(F.lit("m"), F.col("doc_id").cast("string"))
    record = F.to_json(F.struct(F.lit("TikTok").alias("extractor"), F.lit("TikTok").alias("extractorKey"), own.alias("id"),
                                F.col("caption").alias("description")))
    posts = spread(t.captions.select("doc_id", "caption")).select(
        "doc_id", F.lit("tiktok").alias("platform"), F.when(F.col("doc_id") % 7 == 3, "zz").otherwise(own).alias("media_id"), record.alias("record"))
    return o.match_metadata(posts).select("doc_id", "reject", "disclosed")
