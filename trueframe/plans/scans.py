"""Source and sink queries; documents are derived from the tables and read back."""

from pyspark.sql import functions as F

from ..operators import metrics as m
from ..session import shared_folder
from ..sources import flatten as fl
from ..sources import readers as rd
from ..sources import sinks
from .metrics import COUNT_SQL, FLAGS
from .registry import query


@query("scan_manifest", "SELECT id, group_id, split, label, sha256, generator, dataset, transformation, platform FROM {truth}")
def _(t):
    folder = shared_folder(t.spark, "manifest")
    cols = ("id", "group_id", "split", "label", "sha256", "generator", "dataset", "transformation", "platform")
    lines = t.truth.select(F.concat(F.to_json(F.struct(*cols)), F.when(F.col("num") % 9 == 0, "\n").otherwise("")).alias("value"))
    lines.write.text(folder)
    return rd.scan_manifest(t.spark, folder).select(*cols)


@query("scan_predictions", """SELECT id, decision, error, copies FROM (SELECT *, count(*) OVER (PARTITION BY id) AS copies FROM (SELECT id, num, decision, error FROM {before_run} UNION ALL SELECT id, num, decision, error FROM {before_run} WHERE num % 77=1))""")
def _(t):
    folder = shared_folder(t.spark, "predictions")
    run = t.before_run
    run.unionByName(run.filter("num % 77 = 1")).select("id", "sha256", "decision", "confidence", "elapsed_ms", "error", "score").write.json(folder)
    rows = rd.scan_predictions(t.spark, folder)
    return rows.join(rd.repeated_predictions(rows), "id", "left").select("id", "decision", "error", F.coalesce("copies", F.lit(1)).alias("copies"))


@query("scan_census", """SELECT name, CASE WHEN name LIKE '%/real/%' THEN 'real' ELSE 'ai' END AS label, CASE WHEN name LIKE '%/fake/%' THEN split_part(name,'/',3) END AS generator FROM {census} WHERE name LIKE '%.mp4'""")
def _(t):
    return rd.scan_census(t.census).select("name", "label", "generator")


@query("scan_track_tree", """SELECT track, solution, subcat, count(*) AS n FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'id' WHEN 1 THEN 'ood' WHEN 2 THEN 'wild' ELSE 'extra' END AS track, CASE WHEN doc_id % 5<2 THEN 'A' ELSE 'B' END AS solution,
   CASE WHEN doc_id % 5<2 THEN 'real' ELSE source END AS subcat FROM {documents} WHERE doc_id % 7<>3) WHERE track<>'extra' GROUP BY 1,2,3""")
def _(t):
    k = F.col("doc_id")
    track = F.element_at(F.array(*[F.lit(x) for x in ("id", "ood", "wild", "extra")]), (k % 4 + 1).cast("int"))
    path = F.concat(F.lit("/data/bench/"), track, F.when(k % 5 < 2, "/real/").otherwise(F.concat(F.lit("/fake/"), "source", F.lit("/"))),
                    F.lit("v"), k.cast("string"), F.when(k % 7 == 3, ".json").otherwise(".mp4"))
    return rd.track_rows(t.documents.select(path.alias("path"))).groupBy("track", "solution", "subcat").agg(F.count(F.lit(1)).alias("n"))


@query("flatten_frames", """SELECT event_id, 0 AS index, event_id*0.5::DOUBLE AS position, CASE WHEN event_type='error' THEN NULL ELSE value END AS score FROM {events}
   UNION ALL SELECT event_id, 1, CASE WHEN event_id % 5=0 THEN NULL ELSE event_id*0.5::DOUBLE+0.25 END, value FROM {events} WHERE event_id % 3<>0""")
def _(t):
    e = F.col("event_id")
    frame = lambda pos, score: F.concat(F.lit('{"info":{"position":'), pos, F.lit('},"type":{"ai_generated":'), score, F.lit("}}"))
    one = frame((e * 500).cast("string"), F.when(F.col("event_type") == "error", '"high"').otherwise(F.col("value").cast("string")))
    two = frame(F.when(e % 5 == 0, "true").otherwise((e * 500 + 250).cast("string")), F.col("value").cast("string"))
    doc = F.concat(F.lit('{"request":{"operations":10},"data":{"frames":['), one, F.when(e % 3 != 0, F.concat(F.lit(","), two)).otherwise(""), F.lit("]}}"))
    return fl.flatten_frames(t.events.select("event_id", doc.alias("document")), "event_id")


@query("flatten_probe", """SELECT p_partkey AS id, CASE WHEN p_partkey % 19=0 THEN NULL ELSE p_size*1.5::DOUBLE END AS duration, CASE WHEN p_partkey % 13=0 THEN NULL ELSE 640 END AS width, CASE WHEN p_partkey % 13=0 THEN NULL ELSE 360 END AS height,
   CASE WHEN p_partkey % 13=0 OR p_partkey % 11=0 THEN NULL ELSE round(30000.0::DOUBLE/1001,9) END AS fps, p_partkey % 3=0 AS has_audio, p_partkey % 19=0 OR p_partkey % 13=0 AS rejected FROM {part}""")
def _(t):
    k = F.col("p_partkey")
    video = F.struct(F.when(k % 13 == 0, "data").otherwise("video").alias("codec_type"), F.lit(640).alias("width"), F.lit(360).alias("height"),
                     F.when(k % 11 == 0, "0/0").otherwise("30000/1001").alias("avg_frame_rate"))
    audio = F.struct(F.when(k % 3 == 0, "audio").otherwise("subtitle").alias("codec_type"), F.lit(None).cast("int").alias("width"),
                     F.lit(None).cast("int").alias("height"), F.lit("0/0").alias("avg_frame_rate"))
    doc = F.to_json(F.struct(F.struct(F.when(k % 19 == 0, "N/A").otherwise((F.col("p_size") * 1.5).cast("string")).alias("duration")).alias("format"), F.array(audio, video).alias("streams")))
    return fl.flatten_probe(t.part.select(k.alias("id"), doc.alias("document")), "id").withColumn("fps", F.round("fps", 9))


@query("flatten_comments", r"""SELECT conv_id, text, is_creator FROM (SELECT conv_id, regexp_replace(CASE WHEN turn % 4=3 THEN '  ' ELSE '  ' || text || ' ' END, '^\s+|\s+$', '', 'g') AS text, role='assistant' AS is_creator FROM {conversations}) WHERE text<>''""")
def _(t):
    author = F.when(F.col("role") == "assistant", "creator").otherwise("viewer")
    snippet = F.struct(F.struct(F.struct(F.when(F.col("turn") % 4 == 3, "  ").otherwise(F.concat(F.lit("  "), "text", F.lit(" "))).alias("textDisplay"), F.struct(author.alias("value")).alias("authorChannelId")).alias("snippet")).alias("topLevelComment"))
    doc = F.to_json(F.struct(F.array(F.struct(snippet.alias("snippet"))).alias("items")))
    return fl.flatten_comments(t.conversations.select("conv_id", doc.alias("document")), "conv_id", F.lit("creator"))


@query("flatten_assertions", """SELECT doc_id, CASE WHEN doc_id % 3=0 AND doc_id % 5<>1 AND doc_id % 7<>2 THEN 'trainedAlgorithmicMedia' ELSE '' END AS types, CASE WHEN doc_id % 4=0 THEN 'invalid' ELSE 'found' END AS status,
   doc_id % 4 IN (1,2) AS valid, doc_id % 4=2 AS trusted FROM {documents}""")
def _(t):
    k = F.col("doc_id")
    trained = fl.GENERATIVE_SOURCE_TYPES[0]
    action = F.struct(F.lit("c2pa.created").alias("action"), F.when(k % 3 == 0, trained).otherwise(fl.SOURCE_TYPE_ROOT + "digitalCapture").alias("digitalSourceType"))
    body = lambda label: F.struct(F.array(F.struct(label.alias("label"), F.struct(F.array(action, action).alias("actions")).alias("data"))).alias("assertions"))
    label = F.when(k % 7 == 2, "custom.actions").otherwise("c2pa.actions.v2")
    doc = F.to_json(F.struct(
        F.when(k % 5 == 1, "absent").otherwise("m1").alias("active_manifest"), F.element_at(F.array(*[F.lit(x) for x in ("Invalid", "Valid", "Trusted", "Unknown")]), (k % 4 + 1).cast("int")).alias("validation_state"),
        F.create_map(F.lit("m1"), body(label), F.lit("old"), body(F.lit("c2pa.actions"))).alias("manifests")))
    out = fl.flatten_assertions(t.documents.select("doc_id", doc.alias("document")), "doc_id")
    short = F.transform("source_types", lambda s: F.substring_index(s, "/", -1))
    return out.select("doc_id", F.array_join(short, "|").alias("types"), "status", "valid", "trusted")


@query("known_hashes", """SELECT DISTINCT h AS sha256 FROM (SELECT sha256(text) AS h FROM {documents} WHERE doc_id % 3<>0 UNION ALL SELECT sha256('p'||doc_id) FROM {documents} WHERE doc_id % 2=0 UNION ALL SELECT sha256('c'||doc_id) FROM {documents} WHERE doc_id % 10=4
   UNION ALL SELECT sha256('d'||doc_id) FROM {documents} WHERE doc_id % 7=2 UNION ALL SELECT sha256('e'||doc_id) FROM {documents} WHERE doc_id % 7<>2)""")
def _(t):
    k = F.col("doc_id")
    digest = lambda c: F.sha2(c, 256)
    parent = F.struct(F.when(k % 2 == 0, "B.MOV").otherwise("notes.txt").alias("path"), digest(F.concat(F.lit("p"), k.cast("string"))).alias("sha256"),
                      F.when(k % 10 == 4, digest(F.concat(F.lit("c"), k.cast("string")))).when(k % 10 == 5, "short").alias("cgiSourceSha256"))
    # six levels down, through arrays in arrays and objects in objects
    leaf = F.struct(F.when(k % 7 == 2, "deep.MKV").otherwise("deep.txt").alias("path"), digest(F.concat(F.lit("d"), k.cast("string"))).alias("sha256"),
                    F.when(k % 7 != 2, digest(F.concat(F.lit("e"), k.cast("string")))).alias("cgiSourceSha256"))
    deep = F.array(F.array(F.struct(F.struct(F.array(leaf, leaf).alias("items")).alias("batch"), F.lit(1).alias("n"))))
    doc = F.to_json(F.struct(F.when(k % 3 != 0, "a.mp4").otherwise("a.json").alias("path"), digest(F.col("text")).alias("sha256"), F.array(parent).alias("parents"),
                           deep.alias("archive")))
    return fl.known_hashes(t.documents.select(doc.alias("document")))


@query("read_cache", """SELECT event_id, canonical_key, final_score FROM {cached} WHERE status='complete' AND analyzer_version='v1' AND expires_us > 1705708800000000 AND canonical_key='upload:8'""")
def _(t):
    folder = shared_folder(t.spark, "cache")
    t.cached.write.parquet(folder)
    return rd.read_cache(t.spark, folder, "v1", F.lit(1705708800000000), "upload:8").select("event_id", "canonical_key", "final_score")


@query("sink_report", "WITH " + FLAGS + f" SELECT 'report' AS part, {COUNT_SQL} FROM flags UNION ALL SELECT 'predictions', count(*), 0,0,0,0,0,0,0,0,0,0,0 FROM flags")
def _(t):
    folder = shared_folder(t.spark, "run")
    rows = t.judged.select("id", "group_id", "label", "decision", "confidence", "error")
    sinks.sink_report(rows, m.confusion(rows), folder)
    back = t.spark.read.schema("id string, decision string").json(f"{folder}/predictions").agg(F.count(F.lit(1)).alias("attempted"))
    report = t.spark.read.schema(", ".join(f"{c} long" for c in m.COUNTS)).json(f"{folder}/report").withColumn("part", F.lit("report"))
    zeros = back.select(F.lit("predictions").alias("part"), "attempted", *[F.lit(0).cast("long").alias(c) for c in m.COUNTS if c != "attempted"])
    return report.select("part", *m.COUNTS).unionByName(zeros)
