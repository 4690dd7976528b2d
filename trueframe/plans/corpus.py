"""Selection, split and corpus construction queries."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import corpus as c
from ..session import settled
from .registry import query

MEDIA = "md AS (SELECT *, CASE WHEN name LIKE 'train/real/%' THEN 'real' ELSE split_part(name,'/',3) END AS bucket FROM {census} WHERE name LIKE '%.mp4')"


def media(t):
    label, generator = c.census_bucket(F.col("name"))
    return t.census.filter(F.col("name").endswith(".mp4")).withColumn("bucket", F.when(label == "real", "real").otherwise(generator))


@query("hash_ranked_sample", "WITH " + MEDIA + """ SELECT name, bucket, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY sha256('selection-v1:'||name), name) AS rank FROM md
   WHERE uncompressed_bytes <= 9000000) WHERE rank <= CASE WHEN bucket='real' THEN 12 ELSE 2 END""")
def _(t):
    rows = media(t).filter("uncompressed_bytes <= 9000000")
    return c.hash_ranked_sample(rows, "bucket", "name", 2, special={"real": 12}).select("name", "bucket", "rank")


@query("hash_ranked_split", "WITH " + MEDIA + """ SELECT name, bucket, CASE WHEN r<=200 THEN 'train' ELSE 'internal_development' END AS split FROM (SELECT *, row_number() OVER
   (PARTITION BY bucket ORDER BY sha256('selection-v1:'||name), name) AS r FROM md) WHERE r <= 250
   UNION ALL SELECT 'available ' || count(*), bucket, 'short' FROM md GROUP BY bucket HAVING count(*) < 250""")
def _(t):
    picked, short = c.hash_ranked_split(media(t), "bucket", "name", 200, 50)
    return picked.select("name", "bucket", "split").unionByName(short.select(
        F.concat(F.lit("available "), F.col("available").cast("string")).alias("name"), "bucket", F.lit("short").alias("split")))


@query("round_robin_assign", """SELECT id, ['original','mild','severe'][((turn-1)%3)+1] AS quality, row_number() OVER (ORDER BY sha256('order|'||sha256), id) AS position FROM
   (SELECT id, sha256, row_number() OVER (ORDER BY sha256('quality|'||sha256), id) AS turn FROM {truth})""")
def _(t):
    return c.round_robin(t.truth.select("id", "sha256"), c.sha("quality|", F.col("sha256")), ["original", "mild", "severe"],
                         c.sha("order|", F.col("sha256")), "id").select("id", "quality", "position")


@query("stratified_split", """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('sample-v1:'||doc_id), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM {documents})
   SELECT doc_id, source, CASE WHEN r <= greatest(1, floor(least(n,40)*0.1::DOUBLE)) THEN 'validation' ELSE 'train' END AS split FROM r WHERE r<=40""")
def _(t):
    return c.stratified_split(t.documents.select("doc_id", "source"), "source", "doc_id", 40).select("doc_id", "source", "split")


# Rows wanted of a source, its label and how hard it is; "absent" has no rows.
TARGETS = {"src0": (25, "ai", "hard"), "src3": (7, "ai", "hard"), "src5": (1, "ai", "easy"), "src8": (0, "ai", "medium"), "src10": (400000, "real", "easy"),
           "src12": (12, "real", "hard"), "absent": (30, "real", "hard")}


@query("stratified_targets", "WITH pl(source, target, label, difficulty) AS (VALUES " + ", ".join(f"('{k}',{n},'{x}','{d}')" for k, (n, x, d) in TARGETS.items()) + """),
   r AS (SELECT d.source, target, row_number() OVER (PARTITION BY d.source ORDER BY sha256('sample-v1:'||doc_id), doc_id) AS r, count(*) OVER (PARTITION BY d.source) AS n FROM {documents} d JOIN pl USING (source)),
   s AS (SELECT pl.*, (SELECT count(*) FROM {documents} d WHERE d.source=pl.source) AS available, (SELECT count(*) FROM r WHERE r.source=pl.source AND r.r<=r.target) AS got,
      (SELECT count(*) FROM r WHERE r.source=pl.source AND r.r<=r.target AND r.r<=greatest(1, floor(least(n,r.target)*0.1::DOUBLE))) AS validation FROM pl)
  SELECT coalesce(label,'all') AS label, coalesce(difficulty,'all') AS difficulty, coalesce(source,'all') AS source, sum(target)::BIGINT AS target, sum(available)::BIGINT AS available, sum(got-validation)::BIGINT AS train,
    sum(validation)::BIGINT AS validation, sum(greatest(0, target-got))::BIGINT AS short FROM s GROUP BY ROLLUP (label, difficulty, source)""")
def _(t):
    docs = t.documents.select("doc_id", "source")
    plan = t.spark.createDataFrame([(k, x, d, n) for k, (n, x, d) in TARGETS.items()], "source string, label string, difficulty string, target long")
    picked = c.stratified_split(docs, "source", "doc_id", 0, targets={k: n for k, (n, _, _) in TARGETS.items()})
    return c.target_summary(docs, picked, plan, "source")


@query("split_three_way", """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('shuffle-v1:'||doc_id), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM {documents})
   SELECT doc_id, source, CASE WHEN r<=floor(n*0.8::DOUBLE) THEN 'train' WHEN r<=floor(n*0.8::DOUBLE)+floor(n*0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r""")
def _(t):
    return c.split_three_way(t.documents.select("doc_id", "source"), "source", "doc_id").select("doc_id", "source", "split")


@query("hash_split", """WITH g AS (SELECT doc_id, md5(text) AS group_id, ('0x'||substr(sha256('split-v1:'||md5(text)),1,8))::BIGINT % 10 AS b FROM {documents}),
   f AS (SELECT DISTINCT md5(text) AS group_id FROM {documents} d JOIN {labels} l ON d.doc_id=l.doc_id WHERE l.toxic=1)
   SELECT doc_id, CASE WHEN group_id IN (SELECT group_id FROM f) OR b<4 THEN 'development' WHEN b<6 THEN 'calibration' ELSE 'holdout' END AS split FROM g""")
def _(t):
    docs = t.documents.select("doc_id", F.md5("text").alias("group_id"))
    forced = docs.join(t.labels.filter("toxic = 1"), "doc_id").select("group_id")
    return c.hash_split(docs, forced=forced).select("doc_id", "split")


@query("debug_topn", """SELECT platform, generator, id FROM (SELECT *, row_number() OVER (PARTITION BY platform, generator ORDER BY num) AS r FROM {truth}) WHERE r<=3""")
def _(t):
    order = W.partitionBy("platform", "generator").orderBy("num")
    return t.truth.select("platform", "generator", "id", "num").withColumn("r", F.row_number().over(order)).filter(
        "r <= 3").select("platform", "generator", "id")


@query("budget_filter", "WITH " + MEDIA + " SELECT count(*) AS members, sum(uncompressed_bytes)::BIGINT AS bytes, sum(uncompressed_bytes) > 1800000000 AS over_budget FROM md WHERE uncompressed_bytes <= 5000000")
def _(t):
    return c.budget_filter(media(t), "uncompressed_bytes", 5_000_000, 1_800_000_000)[1]


@query("manifest_order", "SELECT id, label, split FROM {truth} ORDER BY id")
def _(t):
    return t.truth.select("id", "label", "split").orderBy("id")


@query("derivative_manifest", """SELECT substr(sha256(id||':'||r||':v1'),1,24) AS id, id AS parent_id, group_id, split, r AS transformation
   FROM {truth}, (VALUES ('mild_720p'),('severe_360p')) v(r) WHERE transformation='original'""")
def _(t):
    originals = t.truth.filter("transformation = 'original'").select("id", "group_id", "split")
    return c.derivative_manifest(originals, ["mild_720p", "severe_360p"])


@query("recipe_cross", "SELECT label, r AS recipe, count(*) AS planned FROM {truth}, (VALUES ('mild_720p'),('severe_360p')) v(r) GROUP BY 1,2")
def _(t):
    return c.recipe_cross(t.truth, ["mild_720p", "severe_360p"]).groupBy("label", "recipe").agg(F.count(F.lit(1)).alias("planned"))


@query("opaque_ids", "WITH " + MEDIA + " SELECT id, parent_id, 'entry:'||id AS group_id, (SELECT count(*)-count(DISTINCT name) FROM md) AS repeated FROM (SELECT sha256('rev-7|'||name) AS id, sha256('rev-7|'||name) AS parent_id FROM md)")
def _(t):
    ids = c.opaque_ids(media(t).select("name"), "name", "rev-7")
    repeated = c.collisions(ids).agg(F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("repeated"))
    return ids.select("id", "parent_id", "group_id").crossJoin(F.broadcast(repeated))


NAMES = "CASE doc_id % 13 WHEN 0 THEN 'Sora' WHEN 1 THEN 'open-sora v2' WHEN 2 THEN 'KLING' WHEN 3 THEN 'msrvtt' WHEN 4 THEN 'gen' WHEN 5 THEN 'my latte clip' WHEN 6 THEN 'Zeroscope' WHEN 7 THEN 'svd xt' WHEN 8 THEN 'crafter' WHEN 9 THEN 'kinetics-400' WHEN 10 THEN 'camera' WHEN 11 THEN 'you' ELSE 'dynamicrafter' END"
FAMILY_SQL = "CASE " + " ".join(f"WHEN w='{k}' THEN '{v}'" for k, v in c.GENERATOR_FAMILIES) + " " + " ".join(
    f"WHEN contains(w,'{k}') OR contains('{k}',w) THEN '{v}'" for k, v in c.GENERATOR_FAMILIES) + " ELSE 'unknown' END"


@query("generator_type", f"SELECT name, {FAMILY_SQL} AS family, count(*) AS n FROM (SELECT name, translate(lower(trim(name)),'- ','__') AS w FROM (SELECT {NAMES} AS name FROM {{documents}})) WHERE w<>'zeroscope' GROUP BY 1,2".replace("{{", "{").replace("}}", "}"))
def _(t):
    named = t.documents.selectExpr(f"{NAMES} AS name").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return named.filter(~F.lower("name").isin(*c.SKIPPED_SOURCES)).select("name", c.generator_family(F.col("name")).alias("family"), "n")


EPOCH = """x AS (SELECT id, CASE WHEN label IN ('ai','mixed') THEN 'ai' ELSE 'real' END AS label, transformation AS quality FROM {truth}),
  re AS (SELECT id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256('host:'||id), id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM x WHERE label='real'),
  fa AS (SELECT id AS donor_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256('epoch-v1:4:'||id), id) AS r, count(*) OVER (PARTITION BY quality) AS m FROM x WHERE label='ai'),
  ho AS (SELECT re.*, m, ('0x'||substr(sha256('epoch-v1:4:start:'||id),1,12))::BIGINT % 7 AS start,
     1 + ('0x'||substr(sha256('epoch-v1:4:offset:'||quality),1,12))::BIGINT % greatest(1, n-1) AS off FROM re JOIN (SELECT quality, max(m) AS m FROM fa GROUP BY 1) USING (quality))"""


@query("epoch_pairs", "WITH " + EPOCH + """ SELECT id, NULL::VARCHAR AS donor_id, NULL::BIGINT AS start, (label='ai')::INT AS target, 'whole' AS kind, quality FROM x
  UNION ALL SELECT ho.id, fa.donor_id, start, 1, 'real_ai_splice', ho.quality FROM ho JOIN fa ON fa.quality=ho.quality AND fa.r=(ho.r-1)%ho.m+1
  UNION ALL SELECT ho.id, re.id, start, 0, 'real_real_splice', ho.quality FROM ho JOIN re ON re.quality=ho.quality AND re.r=(ho.r-1+ho.off)%ho.n+1 WHERE ho.n>1""")
def _(t):
    rows = t.truth.select("id", F.when(F.col("label").isin("ai", "mixed"), "ai").otherwise("real").alias("label"),
                          F.col("transformation").alias("quality"))
    return c.epoch_pairs(rows, 4)


@query("feature_manifest", """WITH p AS (SELECT id, q, num, substr(sha256(id||'|feature-v1|'||q),1,24) AS fid FROM {truth}, (VALUES ('original'),('mild'),('severe')) v(q)),
   f AS (SELECT fid FROM p WHERE num % 17<>3 UNION ALL SELECT fid FROM p WHERE num % 19=2 UNION ALL SELECT 'x'||id FROM {truth} WHERE num % 23=1)
  SELECT coalesce(p.fid, s.fid) AS id, CASE WHEN n IS NULL THEN 'missing' WHEN p.fid IS NULL THEN 'unplanned' ELSE 'duplicate' END AS problem
  FROM p FULL JOIN (SELECT fid, count(*) AS n FROM f GROUP BY 1) s ON p.fid=s.fid WHERE n IS NULL OR p.fid IS NULL OR n>1""")
def _(t):
    base = t.truth.select("id", "num")
    ids = base.withColumn("q", F.explode(F.array(*[F.lit(q) for q in ("original", "mild", "severe")]))).select(
        "num", F.substring(c.sha(F.col("id"), "|feature-v1|", F.col("q")), 1, 24).alias("id"))
    found = ids.filter("num % 17 <> 3").select("id").unionByName(ids.filter("num % 19 = 2").select("id")).unionByName(
        base.filter("num % 23 = 1").select(F.concat(F.lit("x"), "id").alias("id")))
    return c.feature_manifest(base, found, ["original", "mild", "severe"])


FP = """fp AS (SELECT doc_id, sha256('{{"doc_id":'||doc_id||',"lang":"'||lang||'","n_chars":'||n_chars||'}}') AS fingerprint FROM {documents})"""
LEVELS = "l0 AS (SELECT row_number() OVER (ORDER BY fingerprint, doc_id)-1 AS a, fingerprint AS d FROM fp)" + "".join(
    f", l{i + 1} AS (SELECT a//1024 AS a, sha256(string_agg(d, '' ORDER BY a)) AS d FROM l{i} GROUP BY a//1024)" for i in range(4))


@query("row_fingerprint", "WITH " + FP + ", " + LEVELS + " SELECT doc_id, fingerprint FROM fp UNION ALL SELECT NULL, d FROM l4")
def _(t):
    rows = c.row_fingerprint(t.documents.select("doc_id", "lang", "n_chars"), ["n_chars", "lang", "doc_id"])
    whole = c.set_fingerprint(rows, "doc_id")
    return rows.select("doc_id", "fingerprint").unionByName(whole.select(
        F.lit(None).cast("long").alias("doc_id"), F.col("digest").alias("fingerprint")))


EDITED = """ed AS (SELECT doc_id, CASE WHEN doc_id % 37=5 THEN 'xx' ELSE lang END AS lang, n_chars FROM {documents} WHERE doc_id % 41<>7
   UNION ALL SELECT doc_id, lang, n_chars FROM {documents} WHERE doc_id % 53=11),
 fe AS (SELECT sha256('{{"doc_id":'||doc_id||',"lang":"'||lang||'","n_chars":'||n_chars||'}}') AS fingerprint FROM ed)"""


@query("fingerprint_differences", "WITH " + FP + ", " + EDITED + """ SELECT coalesce(a.fingerprint, b.fingerprint) AS fingerprint, coalesce(a.n, 0) AS in_first, coalesce(b.n, 0) AS in_second
  FROM (SELECT fingerprint, count(*) AS n FROM fp GROUP BY 1) a FULL JOIN (SELECT fingerprint, count(*) AS n FROM fe GROUP BY 1) b ON a.fingerprint=b.fingerprint
  WHERE a.n IS DISTINCT FROM b.n""")
def _(t):
    docs, names = t.documents.select("doc_id", "lang", "n_chars"), ["n_chars", "lang", "doc_id"]
    edited = docs.filter("doc_id % 41 <> 7").withColumn("lang", F.when(F.col("doc_id") % 37 == 5, "xx").otherwise(F.col("lang"))).unionByName(
        docs.filter("doc_id % 53 = 11"))
    first, second = (settled(c.row_fingerprint(rows, names).select("fingerprint"), "fingerprints") for rows in (docs, edited))
    depth = c.tree_depth(max(first.count(), second.count()), leaf=64)
    return c.fingerprint_differences(first, second, c.fingerprint_tree(first, depth), c.fingerprint_tree(second, depth), depth)
