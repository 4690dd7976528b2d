"""Validation and selection queries."""

from pyspark.sql import functions as F

from ..functions.rules import media_reject, quality_reject
from ..operators import quality as q
from .policy import SECS, reports  # noqa: F401
from .registry import query

MANIFEST = """mf AS (SELECT CASE WHEN num % 61=0 THEN NULL WHEN num % 47=3 THEN '1' ELSE id END AS id, CASE WHEN num % 17=1 THEN '' ELSE group_id END AS group_id, CASE WHEN num % 19=2 THEN 'test' ELSE split END AS split,
   'media/' || id AS path, CASE WHEN num % 23=3 THEN NULL ELSE sha256 END AS sha256, CASE WHEN num % 29=4 THEN 'unknown' ELSE label END AS label FROM {truth})"""


@query("validate_manifest", "WITH " + MANIFEST + """ SELECT id, rule, count(*) AS n FROM (SELECT id, 'missing_id' AS rule FROM mf WHERE id IS NULL UNION ALL SELECT id, 'missing_group_id' FROM mf WHERE group_id='' UNION ALL SELECT id, 'missing_sha256' FROM mf WHERE sha256 IS NULL
   UNION ALL SELECT id, 'unknown_split' FROM mf WHERE split='test' UNION ALL SELECT id, 'unknown_label' FROM mf WHERE label='unknown'
   UNION ALL SELECT id, 'duplicate_id' FROM mf WHERE id IS NOT NULL GROUP BY 1 HAVING count(*)>1) GROUP BY 1,2""")
def _(t):
    n = F.col("num")
    rows = t.truth.select(
        F.when(n % 61 == 0, None).when(n % 47 == 3, "1").otherwise(F.col("id")).alias("id"), F.when(n % 17 == 1, "").otherwise(F.col("group_id")).alias("group_id"),
        F.when(n % 19 == 2, "test").otherwise(F.col("split")).alias("split"), F.concat(F.lit("media/"), "id").alias("path"),
        F.when(n % 23 != 3, F.col("sha256")).alias("sha256"), F.when(n % 29 == 4, "unknown").otherwise(F.col("label")).alias("label"),
        *[F.lit("x").alias(c) for c in ("source_url", "license", "ground_truth")])
    return q.validate_manifest(rows).groupBy("id", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("validate_result", """WITH r AS (SELECT *, CASE WHEN h % 31=0 THEN 'blurry' ELSE visual_assessment END AS va, CASE WHEN h % 37=0 THEN NULL ELSE evidence_sufficiency END AS es, n_chars % 1200 AS sl, h % 7 AS ls FROM {clips})
  SELECT clip_id, rule FROM (SELECT clip_id, 'visual_assessment_value' AS rule FROM r WHERE va='blurry' UNION ALL SELECT clip_id, 'ai_likelihood_range' FROM r WHERE ai_likelihood NOT BETWEEN 1 AND 99
   UNION ALL SELECT clip_id, 'summary_length' FROM r WHERE sl NOT BETWEEN 1 AND 1000 UNION ALL SELECT clip_id, 'limitations_size' FROM r WHERE ls>5)""")
def _(t):
    h = F.col("h")
    rows = reports(t).withColumns({
        "visual_assessment": F.when(h % 31 == 0, "blurry").otherwise(F.col("visual_assessment")),
        "evidence_sufficiency": F.when(h % 37 != 0, F.col("evidence_sufficiency")),
        "summary": F.repeat(F.lit("s"), (F.col("n_chars") % 1200).cast("int")), "limitations": F.array_repeat(F.lit("limit"), (h % 7).cast("int"))})
    return q.validate_result(rows)


@query("validate_cache_row", """SELECT event_id, rule FROM (SELECT event_id, 'canonical_key_null' AS rule FROM {cached} WHERE canonical_key IS NULL UNION ALL SELECT event_id, 'platform_domain' FROM {cached} WHERE platform='vimeo'
   UNION ALL SELECT event_id, 'status_domain' FROM {cached} WHERE status='stored' UNION ALL SELECT event_id, 'final_score_range' FROM {cached} WHERE final_score NOT BETWEEN 1 AND 99)""")
def _(t):
    return q.validate_cache_row(t.cached)


@query("validate_census", """SELECT name, rule FROM (SELECT name, 'name_pattern' AS rule FROM {census} WHERE name NOT LIKE '%.mp4' UNION ALL SELECT name, 'flags' FROM {census} WHERE flags NOT IN (2048, 2050)
   UNION ALL SELECT name, 'method' FROM {census} WHERE method=12 UNION ALL SELECT name, 'deflate_flags_on_stored' FROM {census} WHERE method<>8 AND flags=2050
   UNION ALL SELECT name, 'uncompressed_size' FROM {census} WHERE uncompressed_bytes>8388608 UNION ALL SELECT name, 'crc32' FROM {census} WHERE crc32='ZZ' UNION ALL SELECT name, 'offset' FROM {census} WHERE local_header_offset<0)""")
def _(t):
    return q.validate_census(t.census, r"^train/(?:real|fake/[^/]+)/[^/]+\.mp4\z")


MEDIA = """SELECT p_partkey AS id, p_size*12000000 AS size, CASE WHEN p_partkey % 50=0 THEN 0 ELSE p_size*4.5::DOUBLE END AS duration, CASE WHEN p_partkey % 40=1 THEN 5000 ELSE 640 END AS width, 360 AS height,
   CASE WHEN p_partkey % 30=2 THEN NULL WHEN p_partkey % 30=3 THEN 300 ELSE 25 END AS rate FROM {part}"""


def media(t):
    k = F.col("p_partkey")
    return t.part.select(
        k.alias("id"), (F.col("p_size") * 12_000_000).alias("size"), F.when(k % 50 == 0, 0.0).otherwise(F.col("p_size") * 4.5).alias("duration"),
        F.when(k % 40 == 1, 5000).otherwise(640).alias("width"), F.lit(360).alias("height"),
        F.when(k % 30 == 2, None).when(k % 30 == 3, 300.0).otherwise(25.0).alias("rate"), (F.col("p_size") * 9).alias("frames"))


@query("media_limits", f"SELECT reject, count(*) AS n FROM (SELECT CASE WHEN size<=0 OR size>500000000 THEN 'size_outside_bound' WHEN duration<=0 OR duration>180 THEN 'duration_outside_bound' WHEN width>4096 THEN 'dimensions_outside_bound' WHEN rate IS NULL OR rate>240 THEN 'rate_outside_bound' END AS reject FROM ({MEDIA})) GROUP BY 1")
def _(t):
    reject = media_reject(F.col("size"), F.col("duration"), F.col("width"), F.col("height"), F.col("rate"), max_bytes=500_000_000, max_seconds=180)
    return media(t).groupBy(reject.alias("reject")).agg(F.count(F.lit(1)).alias("n"))


@query("quality_reject", f"SELECT id, CASE WHEN frames<60 THEN 'too_few_frames' WHEN id % 40=5 THEN 'low_resolution' WHEN coalesce(frames/rate,0)<4 THEN 'too_short' END AS reject FROM (SELECT p_partkey AS id, p_size*9 AS frames, CASE WHEN p_partkey % 30=2 THEN NULL WHEN p_partkey % 30=3 THEN 300.0::DOUBLE ELSE 25 END AS rate FROM {{part}})".replace("{{", "{").replace("}}", "}"))
def _(t):
    width = F.when(F.col("id") % 40 == 5, 128).otherwise(F.col("width"))
    return media(t).select("id", quality_reject(F.col("frames"), width, F.col("height"), F.col("rate"), min_frames=60, min_resolution=224, min_seconds=4.0).alias("reject"))


@query("cohort_select", "SELECT label, count(*) AS clips, count(DISTINCT group_id) AS groups FROM (SELECT * FROM {truth} WHERE split='development') GROUP BY ROLLUP(label)")
def _(t):
    return q.plan_counts(q.cohort_select(t.truth, "development"))


@query("reusable_filter", """SELECT event_id FROM (SELECT *, event_id % 4 AS np, event_id % 9=0 AS failed, platform='vimeo' AS v FROM {cached}) WHERE analyzer_version='v1' AND canonical_key IS NOT NULL AND event_id % 10<>3 AND np>=2 AND NOT failed
    AND (platform='youtube' OR event_id % 6<>1) AND CASE WHEN platform='upload' THEN event_id % 5<>2 ELSE TRUE END""")
def _(t):
    e = F.col("event_id")
    media_hash = F.substring("canonical_key", 8, 64)
    rows = t.cached.withColumns({
        "detector_fingerprint": F.when(e % 10 == 3, "old").otherwise("current"), "result_key": F.col("canonical_key"),
        "passes": F.transform(F.array_repeat(F.lit(1), (e % 4).cast("int")), lambda x, i: F.struct(
            F.when((e % 9 == 0) & (i == 0), "failed").otherwise("complete").alias("status"))),
        "receipt_sha256": F.when(e % 6 != 1, media_hash), "platform_video_id": F.when(e % 5 == 2, "other").otherwise(media_hash),
        "canonical_url": F.when(F.col("platform") != "upload", "https://example.org")})
    return rows.filter(q.reusable("current", "v1")).select("event_id")


@query("identity_check", """WITH f AS (SELECT clip_id, count(*) AS n, count(*) FILTER (model<>'model-a') AS om, count(*) FILTER (kind='sweep' AND mode='static' AND fps=2) AS s, count(*) FILTER (kind='review' AND mode='agentic' AND fps IS NULL) AS r FROM {passes} GROUP BY 1),
   j AS (SELECT num, decision FROM {judged})
  SELECT num AS clip_id, concat_ws('|', CASE WHEN num % 7=3 THEN 'media_hash' END, CASE WHEN num % 8=4 THEN 'cache' END, CASE WHEN coalesce(n,0)<2 THEN 'missing_pass_receipts' END, CASE WHEN om>0 THEN 'pass_model' END,
    CASE WHEN coalesce(s,0)=0 THEN 'sweep_configuration' END, CASE WHEN coalesce(r,0)=0 THEN 'review_configuration' END, CASE WHEN decision IS NULL THEN 'decision_schema' END) AS mismatches FROM j LEFT JOIN f ON j.num=f.clip_id""")
def _(t):
    n = F.col("num")
    runs = t.judged.select(n.alias("clip_id"), "decision", F.when(n % 7 == 3, "other").otherwise(F.col("sha256")).alias("media_sha256"),
                           F.col("sha256").alias("expected_sha256"), (n % 8 == 4).alias("cache_hit"))
    return q.identity_check(runs, t.passes, "model-a").withColumn("mismatches", F.array_join("mismatches", "|"))
