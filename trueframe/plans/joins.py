"""Exclusion, overlap and set queries."""

from pyspark.sql import functions as F

from ..operators import joins as j
from .registry import query

CAND = "cd AS (SELECT doc_id AS id, md5(text) AS basename, substr(md5(text),1,8) AS crc, length(text) AS size, sha256(text) AS sha256 FROM {documents})"
KNOWN = """kn AS (SELECT md5(text) AS basename, substr(md5(text),1,8) AS crc, length(text) AS size, sha256(text) AS sha256 FROM {benchmark}
   UNION ALL SELECT md5(text), substr(md5(text),1,8), length(text), sha256(text) FROM {documents} WHERE doc_id % 11 = 4)"""


def identity(df, *extra):
    text = F.col("text")
    return df.select(*extra, F.md5(text).alias("basename"), F.substring(F.md5(text), 1, 8).alias("crc"),
                     F.length(text).cast("long").alias("size"), F.sha2(text, 256).alias("sha256"))


def corpora(t):
    docs = t.documents
    return (identity(docs, F.col("doc_id").alias("id")),
            identity(t.benchmark).unionByName(identity(docs.filter("doc_id % 11 = 4"))))


@query("exclude_known", "WITH " + CAND + ", " + KNOWN + """ SELECT id, sha256 FROM cd WHERE basename NOT IN (SELECT basename FROM kn) AND sha256 NOT IN (SELECT sha256 FROM kn)
   AND (crc, size) NOT IN (SELECT (crc, size) FROM kn)""")
def _(t):
    return j.exclude_known(*corpora(t)).select("id", "sha256")


def _shared(key, cols):
    match = " AND ".join(f"kn.{c}=cd.{c}" for c in cols)
    tup = "(" + ",".join(cols) + ")" if len(cols) > 1 else cols[0]
    return (f"SELECT '{key}' AS identity, (SELECT count(DISTINCT {tup}) FROM cd WHERE EXISTS (SELECT 1 FROM kn WHERE {match})) AS shared_values, "
            f"(SELECT count(*) FROM cd WHERE EXISTS (SELECT 1 FROM kn WHERE {match})) AS first_rows, (SELECT count(*) FROM kn WHERE EXISTS (SELECT 1 FROM cd WHERE {match})) AS second_rows")


@query("overlap_audit", "WITH " + CAND + ", " + KNOWN + " " + " UNION ALL ".join(
    _shared("+".join(k), k) for k in j.IDENTITY_KEYS))
def _(t):
    return j.overlap_audit(*corpora(t))


@query("split_leakage", """WITH m AS (SELECT md5(text) AS group_id, sha256(text) AS sha256, CASE doc_id % 3 WHEN 0 THEN 'development' WHEN 1 THEN 'calibration' ELSE 'holdout' END AS split FROM {documents})
  SELECT 'group_id' AS key, group_id AS value, count(DISTINCT split) AS splits, count(*) AS rows FROM m GROUP BY 2 HAVING count(DISTINCT split)>1
  UNION ALL SELECT 'sha256', sha256, count(DISTINCT split), count(*) FROM m GROUP BY 2 HAVING count(DISTINCT split)>1""")
def _(t):
    third = F.col("doc_id") % 3
    rows = t.documents.select(F.md5("text").alias("group_id"), F.sha2("text", 256).alias("sha256"), F.when(
        third == 0, "development").when(third == 1, "calibration").otherwise("holdout").alias("split"))
    return j.split_leakage(rows)


@query("cohort_set_equal", """WITH c AS (SELECT dataset AS cohort, id, label FROM {truth} UNION ALL SELECT 'all', id, label FROM {truth} UNION ALL
     SELECT 'mislabelled', id, CASE WHEN num % 50=0 THEN 'cgi' ELSE label END FROM {truth} WHERE dataset='set-1'),
   s AS (SELECT id, label FROM {truth} WHERE dataset='set-1')
  SELECT cohort, count(*) AS registered, (SELECT count(*) FROM s) AS selected, count(s.id) AS common, count(*) FILTER (s.label<>c.label) AS changed,
    count(*)=(SELECT count(*) FROM s) AND count(s.id)=count(*) AND count(*) FILTER (s.label<>c.label)=0 AS equal FROM c LEFT JOIN s ON c.id=s.id GROUP BY 1""")
def _(t):
    rows = t.truth.select("id", "label", "dataset", "num")
    cohorts = rows.select(F.col("dataset").alias("cohort"), "id", "label").unionByName(
        rows.select(F.lit("all").alias("cohort"), "id", "label")).unionByName(rows.filter("dataset = 'set-1'").select(
            F.lit("mislabelled").alias("cohort"), "id", F.when(F.col("num") % 50 == 0, "cgi").otherwise(F.col("label")).alias("label")))
    return j.cohort_set_equal(rows.filter("dataset = 'set-1'").select("id", "label"), cohorts, fields=["label"])


@query("case_set_match", """WITH r AS (SELECT id FROM {before_run} UNION ALL SELECT id FROM {before_run} WHERE num % 60=1 UNION ALL SELECT 'new-'||id FROM {before_run} WHERE num % 90=2)
  SELECT coalesce(m.id, r.id) AS id, CASE WHEN r.id IS NULL THEN 'not_retained' WHEN m.id IS NULL THEN 'unplanned' ELSE 'duplicate' END AS problem
  FROM {truth} m FULL JOIN (SELECT id, count(*) AS n FROM r GROUP BY 1) r ON m.id=r.id WHERE r.id IS NULL OR m.id IS NULL OR n>1""")
def _(t):
    run = t.before_run.select("id", "num")
    got = run.select("id").unionByName(run.filter("num % 60 = 1").select("id")).unionByName(
        run.filter("num % 90 = 2").select(F.concat(F.lit("new-"), "id").alias("id")))
    return j.case_set_match(t.truth, got)


@query("union_cohorts", """SELECT cohort, expected_ai, count(*) AS n FROM (SELECT 'benchmark' AS cohort, label IN ('ai','mixed') AS expected_ai FROM {truth} WHERE dataset='set-0'
   UNION ALL SELECT 'control', label IN ('ai','mixed') FROM {truth} WHERE dataset<>'set-0' AND platform='en') GROUP BY 1,2""")
def _(t):
    parts = {"benchmark": t.truth.filter("dataset = 'set-0'"), "control": t.truth.filter("dataset <> 'set-0' AND platform = 'en'")}
    return j.union_cohorts(parts).groupBy("cohort", "expected_ai").agg(F.count(F.lit(1)).alias("n"))


@query("known_subset", """SELECT DISTINCT sha256(b.text) AS sha256 FROM {benchmark} b WHERE sha256(b.text) NOT IN (SELECT sha256(text) FROM {benchmark} WHERE item_id % 5<>0)""")
def _(t):
    hashed = lambda df: df.select(F.sha2("text", 256).alias("sha256"))
    return j.known_subset(hashed(t.benchmark), hashed(t.benchmark.filter("item_id % 5 <> 0")))


@query("dedupe_content", "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM {documents} GROUP BY 1 HAVING count(*)>1")
def _(t):
    return j.dedupe_content(t.documents.select(F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("id")))


@query("ancestor_sets", """WITH n AS (SELECT DISTINCT unnest([l_suppkey, l_partkey % 130]) AS parent_id FROM {lineitem}),
   h AS (SELECT parent_id, count(*) AS copies FROM (SELECT s_suppkey AS parent_id FROM {supplier} WHERE s_suppkey % 17<>0 UNION ALL SELECT s_suppkey FROM {supplier} WHERE s_suppkey % 23=1
      UNION ALL SELECT s_suppkey+100000 FROM {supplier} WHERE s_suppkey % 31=2) GROUP BY 1)
  SELECT coalesce(n.parent_id,h.parent_id) AS parent_id, CASE WHEN copies IS NULL THEN 'missing_receipt' WHEN n.parent_id IS NULL THEN 'unused_receipt' ELSE 'duplicate_receipt' END AS problem
  FROM n FULL JOIN h ON n.parent_id=h.parent_id WHERE copies IS NULL OR n.parent_id IS NULL OR copies>1""")
def _(t):
    k = F.col("s_suppkey")
    keys = lambda cond, plus=0: t.supplier.filter(cond).select((k + plus).alias("parent_id"))
    receipts = keys(k % 17 != 0).unionByName(keys(k % 23 == 1)).unionByName(keys(k % 31 == 2, 100_000))
    cases = t.lineitem.select(F.array("l_suppkey", F.col("l_partkey") % 130).alias("ancestors"))
    return j.ancestor_sets(cases, receipts)


@query("dedupe_by_key", """SELECT key, arg_max(page_id, page_id) AS page_id, arg_max(url, page_id) AS url FROM (SELECT *, regexp_extract(lower(url), '^https?://(?:www[.]|m[.])?([^/?#]+)', 1) AS key FROM {pages}) GROUP BY 1""")
def _(t):
    keyed = t.pages.select("page_id", "url", F.regexp_extract(F.lower("url"), r"^https?://(?:www\.|m\.)?([^/?#]+)", 1).alias("key"))
    return j.dedupe_by_key(keyed, "key", ["page_id"], ["page_id", "url"])
