"""Streaming queries: the event table is read as a stream until it is used up."""

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import sinks
from ..streaming import jobs, tables, timed
from .registry import BINDINGS, SPARK, query
from .timeline import VALID, RUNS

HOUR_US = 3_600_000_000
ORIGIN_US = 1_704_067_200_000_000


def source(t, name="events"):
    """The table's file as a stream with its own declared schema."""
    schema = t.spark.read.parquet(f"{t.path}/{name}.parquet").schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxBytesPerTrigger", str(1 << 30)).parquet(t.path)


def bound(t, binding, table="events"):
    """A binding's SELECT over the stream instead of the table."""
    stream = source(t, table)
    for field in stream.schema:
        if field.dataType.typeName() == "timestamp_ntz":
            stream = stream.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return t.spark.sql(BINDINGS[binding](SPARK), **{table: stream})


def finished(t, stream, name):
    folder = shared_folder(t.spark, name)
    jobs.to_files(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/out")


WALK = """WITH RECURSIVE o AS (SELECT case_id AS key, event_id, at_us, row_number() OVER (PARTITION BY case_id ORDER BY at_us, event_id) AS i FROM {samples}),"""


@query("stream_admission", WALK + f""" w AS (SELECT key, event_id, at_us, i, TRUE AS ok, [at_us] AS ts, NULL::BIGINT AS retry FROM o WHERE i=1
   UNION ALL SELECT o.key, o.event_id, o.at_us, o.i, len(list_filter(w.ts, lambda x: x > o.at_us-{24*HOUR_US})) < 3,
     CASE WHEN len(list_filter(w.ts, lambda x: x > o.at_us-{24*HOUR_US})) < 3 THEN list_append(list_filter(w.ts, lambda x: x > o.at_us-{24*HOUR_US}), o.at_us) ELSE list_filter(w.ts, lambda x: x > o.at_us-{24*HOUR_US}) END,
     CASE WHEN len(list_filter(w.ts, lambda x: x > o.at_us-{24*HOUR_US})) < 3 THEN NULL ELSE greatest(1, ceil((list_filter(w.ts, lambda x: x > o.at_us-{24*HOUR_US})[1]+{24*HOUR_US}-o.at_us)/1e6))::BIGINT END
   FROM w JOIN o ON o.key=w.key AND o.i=w.i+1)
  SELECT key, event_id, at_us, CASE WHEN ok THEN 'admitted' ELSE 'refused' END AS outcome, retry AS retry_after FROM w""")
def _(t):
    rows = bound(t, "samples").select(F.col("case_id").alias("key"), "at_us", "event_id")
    out = timed.finished(rows, lambda s: timed.by_time(s, "key", timed.TimedAdmission(3, 24 * HOUR_US)), "admission")
    return out.drop("late")


@query("stream_coalesce", WALK + f""" w AS (SELECT key, event_id, at_us, i, event_id AS leader, at_us AS opened FROM o WHERE i=1
   UNION ALL SELECT o.key, o.event_id, o.at_us, o.i, CASE WHEN o.at_us >= w.opened+{12*HOUR_US} THEN o.event_id ELSE w.leader END, CASE WHEN o.at_us >= w.opened+{12*HOUR_US} THEN o.at_us ELSE w.opened END
   FROM w JOIN o ON o.key=w.key AND o.i=w.i+1) SELECT key, event_id, leader, leader=event_id AS opened_flight, FALSE AS late FROM w""")
def _(t):
    rows = bound(t, "samples").select(F.col("case_id").alias("key"), "at_us", "event_id")
    return timed.finished(rows, lambda s: timed.by_time(s, "key", timed.TimedCoalesce(12 * HOUR_US)), "coalesce")


@query("stream_runs", "WITH " + VALID + ", " + RUNS + " SELECT case_id, first_event_id, n, f AS first_nano, l AS last_nano, max_score, FALSE AS late FROM runs")
def _(t):
    rows = bound(t, "samples").withColumn("valid", F.col("score").isNotNull() & (F.col("nano") >= 0) & (F.col("nano") < 31_000_000_000)).fillna(0.0, ["score"])
    return timed.finished(rows, lambda s: timed.by_time(s, "case_id", timed.TimedRuns(600_000_000, 30 * 24 * HOUR_US)), "runs")


@query("stream_error_stop", """WITH e AS (SELECT case_id, at_us, event_id, CASE WHEN event_type IN ('error','view') THEN event_type END AS error, row_number() OVER (PARTITION BY case_id ORDER BY at_us, event_id) AS i FROM {samples}),
  l AS (SELECT *, lag(error) OVER w AS e1, lag(error,2) OVER w AS e2 FROM e WINDOW w AS (PARTITION BY case_id ORDER BY i))
  SELECT case_id, at_us, event_id, error, FALSE AS late FROM l WHERE error=e1 AND error=e2 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY i)=1""")
def _(t):
    rows = bound(t, "samples").withColumn("error", F.when(F.col("event_type").isin("error", "view"), F.col("event_type")))
    return timed.finished(rows, lambda s: timed.by_time(s, "case_id", timed.TimedErrorStop(3, 365 * 24 * HOUR_US)), "errors")


@query("stream_op_budget", """SELECT seq, kind, reserved, CASE WHEN sequence <> rn THEN 'sequence_gap' WHEN kind='reserve' AND reserved > 2000000000 THEN 'over_budget' END AS problem
  FROM (SELECT *, row_number() OVER (ORDER BY seq)-1 AS rn, sum(CASE WHEN kind='reserve' THEN bytes ELSE 0 END) OVER (ORDER BY seq)::BIGINT AS reserved FROM {ledger})""")
def _(t):
    folder = shared_folder(t.spark, "budget")
    jobs.op_budget(bound(t, "ledger", "orders"), 2_000_000_000, folder, f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.schema("seq long, kind string, reserved long, problem string").parquet(f"{folder}/rows/*")


REUSABLE = "status = 'complete' AND canonical_key IS NOT NULL AND final_score BETWEEN 1 AND 99"
LATEST = "lt AS (SELECT * FROM {cached} WHERE status='complete' AND canonical_key IS NOT NULL AND final_score BETWEEN 1 AND 99 QUALIFY row_number() OVER (PARTITION BY canonical_key ORDER BY analyzed_us DESC, event_id DESC)=1)"


@query("stream_cache_upsert", "WITH " + LATEST + " SELECT canonical_key, event_id, platform, analyzer_version, final_score, expires_us FROM lt")
def _(t):
    folder = shared_folder(t.spark, "upsert")
    rows = bound(t, "cached").select("canonical_key", "analyzed_us", "event_id", "status", "platform", "analyzer_version", "final_score", "expires_us")
    tables.keep_latest(rows, f"{folder}/table", f"{folder}/checkpoint", F.expr(REUSABLE)).awaitTermination()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return tables.cache_table(t.spark, f"{folder}/table", schema).latest().drop("status", "analyzed_us")


@query("stream_cache_join", "WITH " + LATEST + """ SELECT s.event_id, 'upload:'||s.user_id AS canonical_key, lt.final_score AS cached_score, lt.final_score IS NOT NULL AS served
   FROM {cached} s LEFT JOIN lt ON lt.canonical_key='upload:'||s.user_id AND lt.analyzer_version='v1' AND lt.expires_us > s.analyzed_us""")
def _(t):
    table = t.cached.filter(REUSABLE).groupBy("canonical_key").agg(F.max_by(F.struct(
        "status", "analyzer_version", "final_score", "expires_us"), F.struct("analyzed_us", "event_id")).alias("r")).select("canonical_key", "r.*")
    requests = bound(t, "cached").select("event_id", F.concat(F.lit("upload:"), F.col("user_id").cast("string")).alias("canonical_key"),
                                         F.col("analyzed_us").alias("at_us"))
    return finished(t, jobs.cache_join(requests, table, "v1"), "served")


@query("sink_append_progress", "SELECT case_id, count(*) AS finished, sum(CASE WHEN event_type='error' THEN 1 ELSE 0 END)::BIGINT AS errors FROM {samples} GROUP BY 1")
def _(t):
    folder = shared_folder(t.spark, "progress")
    rows = bound(t, "samples").select("case_id", "event_id", "event_type")
    sinks.sink_append_progress(rows, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    back = t.spark.read.schema("case_id long, event_id long, event_type string").json(f"{folder}/out")
    return back.groupBy("case_id").agg(F.count(F.lit(1)).alias("finished"), F.sum((F.col("event_type") == "error").cast("int")).alias("errors"))
