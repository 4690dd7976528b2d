"""Window, shot and lineage queries."""

from pyspark.sql import functions as F

from ..operators import shots as s
from ..operators.ordered import split_hot
from ..session import spread
from .ranking import rounded
from .registry import query
from .timeline import ORDER, positioned

HOUR_US = 3_600_000_000

DUR = "d AS (SELECT p_partkey AS id, p_size + (p_partkey % 4) * 0.25::DOUBLE AS duration FROM {part})"
PLAN = """w AS (SELECT id, duration, k AS window_no, k::DOUBLE AS start FROM d, range(60) r(k) WHERE duration > 2 AND k <= floor(duration-2)
   UNION ALL SELECT id, duration, floor(duration-2)::BIGINT+1, duration-2 FROM d WHERE duration > 2 AND abs(floor(duration-2)-(duration-2)) > 1e-6
   UNION ALL SELECT id, duration, 0, 0 FROM d WHERE duration <= 2 AND duration >= 0.5)"""


def durations(t):
    return t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") + (F.col("p_partkey") % 4) * 0.25).alias("duration"))


@query("sliding_windows", "WITH " + DUR + ", " + PLAN + ' SELECT id, window_no::INT AS window_no, start, CASE WHEN duration<=2 THEN duration ELSE start+2 END AS "end", NULL::VARCHAR AS problem FROM w UNION ALL SELECT id, NULL, NULL, NULL, \'unsupported_duration\' FROM d WHERE duration < 0.5 OR duration > 120')
def _(t):
    return s.sliding_windows(durations(t)).select("id", "window_no", "start", "end", "problem")


@query("plan_windows_udtf", "WITH " + DUR + ", " + PLAN + """ SELECT id, count(*) AS windows, max(start) AS last_start, NULL::VARCHAR AS problem FROM w GROUP BY 1
  UNION ALL SELECT id, 0, NULL, 'unsupported_duration' FROM d WHERE duration < 0.5 OR duration > 120""")
def _(t):
    s.register_plan_windows(t.spark)
    planned = t.spark.sql("SELECT c.id, w.start, w.problem IS NULL AS planned FROM {clips} c, LATERAL plan_windows_checked(c.duration, 2D, 1D) w",
                          clips=spread(durations(t)))
    # grouped without the text, so rows are hashed; with it they would all be sorted
    found = planned.groupBy("id", "planned").agg(F.count("start").alias("windows"), F.max("start").alias("last_start"))
    return found.select("id", "windows", "last_start", F.when(~F.col("planned"), "unsupported_duration").alias("problem"))


FRAMES = "f AS (SELECT case_id, at_us, event_id, nano/1e9::DOUBLE AS pts FROM {samples})"
WINS = """lasts AS (SELECT case_id, greatest(0, floor(max(pts)))::BIGINT AS last FROM f GROUP BY 1),
  wn AS (SELECT case_id, k AS start, k+2 AS stop FROM (SELECT case_id, unnest(range(0, last+1)) AS k FROM lasts))"""
MEMBERS = "m AS (SELECT f.case_id, f.event_id, f.at_us, f.pts, wn.start FROM f JOIN wn ON f.case_id=wn.case_id AND f.pts>=wn.start AND f.pts<wn.stop)"


def frames(t):
    return positioned(t.samples).select("case_id", "at_us", "event_id", F.col("position").cast("double").alias("pts"),
                                        "event_type", "value")


def bucketed(rows, width_us):
    """Time buckets of the cases too large for one task."""
    return split_hot(rows, ["case_id"], F.floor(F.col("at_us") / width_us), "cell")


def windows(t):
    """Two-second windows from each second up to the case's last position."""
    last = F.greatest(F.lit(0), F.floor(F.max("pts"))).cast("int")
    return frames(t).groupBy("case_id").agg(last.alias("last")).select("case_id", F.explode(F.sequence(F.lit(0), "last")).alias("start")).withColumn(
        "end", F.col("start") + 2)


def members(t, rows=None):
    return s.window_membership(frames(t) if rows is None else rows, windows(t), 2.0)


@query("window_membership", "WITH " + FRAMES + ", " + WINS + ", " + MEMBERS + " SELECT case_id, start, event_id FROM m")
def _(t):
    return members(t).select("case_id", F.col("start").cast("long").alias("start"), "event_id")


@query("frame_pick", "WITH " + FRAMES + ", " + WINS + ", " + MEMBERS + """, r AS (SELECT *, row_number() OVER (PARTITION BY case_id, start ORDER BY at_us, event_id)-1 AS at_,
    count(*) OVER (PARTITION BY case_id, start) AS n FROM m)
  SELECT case_id, start, i AS slot, event_id, n AS frames FROM r, range(8) x(i) WHERE n>=8 AND at_ = (i*(n-1))//7
  UNION ALL SELECT wn.case_id, wn.start, NULL, NULL, count(m.event_id) FROM wn LEFT JOIN m ON wn.case_id=m.case_id AND wn.start=m.start GROUP BY 1,2 HAVING count(m.event_id)<8""")
def _(t):
    inside = members(t, bucketed(frames(t), HOUR_US))
    picked = s.frame_pick(inside, ["case_id", "start"], ORDER, "cell")
    short = s.short_windows(windows(t), inside, ["case_id", "start"])
    cols = ("case_id", F.col("start").cast("long").alias("start"))
    return picked.select(*cols, "slot", "event_id", "frames").unionByName(short.select(
        *cols, F.lit(None).cast("long").alias("slot"), F.lit(None).cast("long").alias("event_id"), "frames"))


SHOTS = """n AS (SELECT case_id, event_type='signup' AND value>60 AS cut, row_number() OVER w - 1 AS i,
     sum((event_type='signup' AND value>60)::INT) OVER w AS k FROM {samples} WINDOW w AS (PARTITION BY case_id ORDER BY at_us, event_id)),
  sh AS (SELECT case_id, k, min(i) AS a, count(*) AS len FROM n GROUP BY 1,2)"""


@query("shot_windows", "WITH " + SHOTS + """, st AS (SELECT *, len>=8 AS ok, least(8,len) AS width FROM sh),
  g AS (SELECT *, unnest(CASE WHEN ok THEN list_distinct(list_append(range(0, len-width+1, 4), len-width)) ELSE [NULL::BIGINT] END) AS o FROM st)
  SELECT case_id, a AS start_frame, a+len AS end_frame, ok AS supported, a+o AS window_start, a+o+width AS window_end,
    CASE WHEN ok THEN array_to_string(list_transform(range(16), lambda i: a+o+(i*(width-1))//15), ',') END AS frames,
    CASE WHEN ok THEN 16-length(list_distinct(list_transform(range(16), lambda i: (i*(width-1))//15))) END::INT AS duplicates FROM g""")
def _(t):
    rows = bucketed(frames(t), 24 * HOUR_US).withColumn("is_cut", (F.col("event_type") == "signup") & (F.col("value") > 60))
    found = s.shots(rows, ORDER, "cell", fps=2)
    return s.shot_windows(found, fps=2).withColumn("frames", F.array_join(F.col("frames").cast("array<string>"), ","))


@query("clip_from_windows", """SELECT clip_id, round(max(logit),9) AS max_logit, count(logit) AS valid, count(*) FILTER (logit IS NULL) AS failed,
  CASE WHEN max(logit)>=0 THEN TRUE WHEN count(*) FILTER (logit IS NULL)=0 THEN FALSE END AS ai FROM {window_runs} GROUP BY 1""")
def _(t):
    return rounded(s.clip_from_windows(t.window_runs), "max_logit")


@query("window_plan_check", """WITH pl AS (SELECT clip_id, window_no, max(p % 5) AS start FROM {window_runs} GROUP BY 1,2),
   ex AS (SELECT clip_id, CASE WHEN s % 17=0 THEN window_no+100 ELSE window_no END AS window_no, max(CASE WHEN p % 13=0 THEN p % 5 + 1 ELSE p % 5 END) AS start FROM {window_runs}
      WHERE s % 11<>0 GROUP BY 1,2)
  SELECT * FROM (SELECT coalesce(pl.clip_id,ex.clip_id) AS clip_id, coalesce(pl.window_no,ex.window_no) AS window_no, pl.start AS planned, ex.start AS ran,
   CASE WHEN ex.clip_id IS NULL THEN 'missing' WHEN pl.clip_id IS NULL THEN 'extra' WHEN pl.start<>ex.start THEN 'moved' END AS problem
   FROM pl FULL JOIN ex ON pl.clip_id=ex.clip_id AND pl.window_no=ex.window_no) WHERE problem IS NOT NULL""")
def _(t):
    w = t.window_runs
    five = F.col("p") % 5
    plan = w.groupBy("clip_id", "window_no").agg(F.max(five).alias("start"))
    ran = w.filter("s % 11 <> 0").withColumn("window_no", F.when(F.col("s") % 17 == 0, F.col("window_no") + 100).otherwise(
        F.col("window_no"))).groupBy("clip_id", "window_no").agg(F.max(F.when(F.col("p") % 13 == 0, five + 1).otherwise(five)).alias("start"))
    return s.window_plan_check(plan, ran)


LINEAGE = """ln AS (SELECT e.*, i AS output_index, CASE WHEN NOT (i>=36 AND i<84) THEN 0 WHEN composition='hardcut' THEN 1
     WHEN composition='blend' THEN least(1, (2*(i-36)+1)/12.0::DOUBLE, (95-2*(i-36))/12.0::DOUBLE) ELSE 0 END::DOUBLE AS alpha FROM (SELECT *, unnest(range(96 + 24 * (case_id % 3))) AS i FROM {edits}) e),
  lb AS (SELECT *, (CASE WHEN host_ai THEN 1-alpha ELSE 0 END + CASE WHEN donor_ai THEN alpha ELSE 0 END)::DOUBLE AS ai_share, case_id*120+output_index AS key FROM ln)"""


def edits(t):
    """Edits of 96, 120 or 144 frames."""
    return t.edits.withColumn("frames", 96 + 24 * (F.col("case_id") % 3))


@query("lineage_build", "WITH " + LINEAGE + " SELECT case_id, output_index::INT AS output_index, output_index::INT AS master_index, host_id, donor_id, round(alpha,9) AS alpha, round(ai_share,9) AS ai_share FROM lb")
def _(t):
    return rounded(s.lineage_build(edits(t)), "alpha", "ai_share")


def recorded(t):
    """Built lineage with known defects, as a stored copy would have."""
    built = s.lineage_build(edits(t)).withColumn("key", F.col("case_id") * 120 + F.col("output_index"))
    return built.filter("key % 307 <> 0").select(
        "case_id", "output_index", "host_id", "donor_id", "key",
        F.when(F.col("key") % 401 == 0, F.col("master_index") - 3).otherwise(F.col("master_index")).alias("master_index"),
        (F.col("alpha") + F.when(F.col("key") % 211 == 0, 0.1).otherwise(0.0)).alias("alpha"),
        (F.col("ai_share") + F.when(F.col("key") % 223 == 0, 0.1).otherwise(0.0)).alias("ai_share"),
        F.when((F.col("alpha") > 0) & (F.col("key") % 227 != 0), F.col("master_index") * 2).alias("donor_frame"),
        (F.col("master_index") * 3 + F.when(F.col("key") % 229 == 0, 1).otherwise(0)).alias("host_frame"))


RECORDED = LINEAGE + """, rc AS (SELECT case_id, composition, host_ai, donor_ai, host_id, donor_id, output_index, CASE WHEN key % 401=0 THEN output_index-3 ELSE output_index END AS master_index,
    alpha + CASE WHEN key % 211=0 THEN 0.1 ELSE 0 END AS alpha, ai_share + CASE WHEN key % 223=0 THEN 0.1 ELSE 0 END AS ai_share,
    CASE WHEN alpha>0 AND key % 227<>0 THEN output_index*2 END AS donor_frame, output_index*3 + CASE WHEN key % 229=0 THEN 1 ELSE 0 END AS host_frame FROM lb WHERE key % 307<>0)"""


@query("lineage_check", "WITH " + RECORDED + """, x AS (SELECT *, CASE WHEN NOT (master_index>=36 AND master_index<84) THEN 0 WHEN composition='hardcut' THEN 1
     WHEN composition='blend' THEN least(1, (2*(master_index-36)+1)/12.0::DOUBLE, (95-2*(master_index-36))/12.0::DOUBLE) ELSE 0 END::DOUBLE AS pl FROM rc)
  SELECT case_id, output_index::INT AS output_index, problem FROM (
   SELECT case_id, output_index, 'alpha_differs' AS problem FROM x WHERE abs(alpha-pl)>1e-7
   UNION ALL SELECT case_id, output_index, 'ai_share_differs' FROM x WHERE abs(ai_share-(CASE WHEN host_ai THEN 1-pl ELSE 0 END + CASE WHEN donor_ai THEN pl ELSE 0 END))>1e-7
   UNION ALL SELECT case_id, output_index, 'donor_frame_presence' FROM x WHERE (donor_frame IS NOT NULL) <> (pl>0)
   UNION ALL SELECT case_id, output_index, 'master_not_increasing' FROM (SELECT *, lag(master_index) OVER (PARTITION BY case_id ORDER BY output_index) AS pm FROM rc) WHERE master_index<=pm
   UNION ALL SELECT case_id, output_index, 'missing_frame' FROM lb WHERE key % 307=0)""")
def _(t):
    plan = edits(t).select("case_id", "composition", "host_ai", "donor_ai", "frames")
    return s.lineage_check(recorded(t).drop("host_id", "donor_id"), plan)


@query("lineage_counts", "WITH " + LINEAGE + """, pk AS (SELECT case_id, w AS window_no, w*24+(i*95)//15 AS output_index FROM {edits}, range(2) a(w), range(16) b(i))
  SELECT case_id, window_no::INT AS window_no, count(*) AS sampled, count(*) FILTER (alpha>0) AS donor, count(*) FILTER (alpha=1) AS full_donor, count(*) FILTER (alpha>0 AND alpha<1) AS blend_edge,
   count(*) FILTER (ai_share>0) AS known_ai, count(*) FILTER (ai_share=1) AS full_ai FROM pk JOIN lb USING (case_id, output_index) GROUP BY 1,2""")
def _(t):
    picks = t.edits.select("case_id").withColumn("window_no", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "output_index", F.explode(F.transform(s.evenly(16, F.lit(96)), lambda i: i + F.col("window_no") * 24)))
    return s.lineage_counts(picks, s.lineage_build(edits(t)))


@query("lineage_source_match", "WITH " + RECORDED + """ SELECT case_id, output_index::INT AS output_index, CASE WHEN host_frame IS DISTINCT FROM master_index*3 THEN 'host_frame_differs' ELSE 'donor_frame_differs' END AS problem
  FROM rc WHERE host_frame IS DISTINCT FROM master_index*3 OR donor_frame IS DISTINCT FROM CASE WHEN alpha>0 AND donor_id IS NOT NULL THEN master_index*2 END""")
def _(t):
    parents = t.edits.select(F.col("host_id").alias("parent_id"), F.lit(3).alias("step")).unionByName(
        t.edits.filter("donor_id is not null").select(F.col("donor_id").alias("parent_id"), F.lit(2).alias("step"))).distinct()
    native = parents.withColumn("master_index", F.explode(F.sequence(F.lit(-3), F.lit(143)))).select(
        "parent_id", "master_index", (F.col("master_index") * F.col("step")).alias("native_frame"))
    return s.lineage_source_match(recorded(t), native).select("case_id", "output_index", "problem")


SHOWN = """sf AS (SELECT case_id, min(event_id) AS frame_id, at_us AS at_, at_us + max(CAST(floor(value*1800) AS BIGINT))*1000000 AS raw FROM {samples} GROUP BY case_id, at_us)"""


def shown(t):
    return t.samples.groupBy("case_id", F.col("at_us").alias("at")).agg(
        F.min("event_id").alias("frame_id"), F.max(F.floor(F.col("value") * 1800)).alias("d")).select(
        "case_id", "at", "frame_id", (F.col("at") + F.col("d") * 1_000_000).alias("ends"), F.floor(F.col("at") / (24 * HOUR_US)).alias("day"))


@query("presentation_coverage", "WITH " + SHOWN + f""", x AS (SELECT case_id, at_, raw, lead(at_) OVER w AS nxt FROM sf WINDOW w AS (PARTITION BY case_id ORDER BY at_))
  SELECT case_id, min(at_) AS first, arg_max(raw, at_) AS last, count(*) FILTER (nxt IS NOT NULL AND greatest(least(raw,nxt),{72*HOUR_US}) < least(nxt,{96*HOUR_US})) AS holes,
   min(at_) <= {72*HOUR_US} AND arg_max(raw, at_) >= {96*HOUR_US} AND count(*) FILTER (nxt IS NOT NULL AND greatest(least(raw,nxt),{72*HOUR_US}) < least(nxt,{96*HOUR_US}))=0 AS covered FROM x GROUP BY 1""")
def _(t):
    return s.presentation_coverage(shown(t), "day", F.lit(72 * HOUR_US), F.lit(96 * HOUR_US))


@query("asof_frame", "WITH " + SHOWN + f""", c AS (SELECT *, {12*HOUR_US}*(2*slot+1) AS at_ FROM (SELECT case_id, unnest(range(greatest(30, max(at_)//{24*HOUR_US} + 1))) AS slot FROM sf GROUP BY 1))
  SELECT c.case_id, slot::INT AS slot, c.at_ AS "at", CASE WHEN c.at_ < sf.raw THEN frame_id END AS frame_id
  FROM c ASOF LEFT JOIN sf ON c.case_id=sf.case_id AND c.at_ >= sf.at_""")
def _(t):
    # the 30 slots of the study for every case, and all later ones up to the case's last frame
    last = F.greatest(F.lit(29), F.floor(F.max("at_us") / (24 * HOUR_US)).cast("int"))
    centres = t.samples.groupBy("case_id").agg(last.alias("last")).select("case_id", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("slot")).withColumn(
        "at", F.lit(12 * HOUR_US) * (2 * F.col("slot") + 1))
    return s.asof_frame(shown(t), centres, lambda at: F.floor(at / (24 * HOUR_US)))


@query("entry_boundary", """SELECT name, local_header_offset, coalesce(lead(local_header_offset) OVER (ORDER BY local_header_offset, name), 99000000000) AS boundary,
   coalesce(lead(local_header_offset) OVER (ORDER BY local_header_offset, name) = local_header_offset, FALSE) AS duplicate FROM {census}""")
def _(t):
    return s.entry_boundary(t.census, 99_000_000_000)


@query("hash_window", """SELECT id, round(start,9) AS start, round(start+least(2,duration),9) AS "end" FROM (SELECT id, duration,
   round((('0x'||substr(sha256('window-v1:'||sha256(id::VARCHAR)),1,16))::UBIGINT::DOUBLE/18446744073709551616.0::DOUBLE)*greatest(0,duration-least(2,duration)),9) AS start
   FROM (SELECT p_partkey AS id, p_size + (p_partkey % 4) * 0.25::DOUBLE AS duration FROM {part}))""")
def _(t):
    clips = durations(t).withColumn("parent_sha256", F.sha2(F.col("id").cast("string"), 256))
    return rounded(s.hash_window(clips).select("id", "start", "end"), "start", "end")


@query("center_window_pick", """WITH c AS (SELECT p_partkey AS id, (p_size*7+5)::BIGINT AS frames, (p_partkey % 3)*12.0::DOUBLE + 12 AS fps FROM {part}),
   w AS (SELECT *, greatest(least(floor(4.0*fps)::BIGINT, frames), 16) AS size FROM c),
   b AS (SELECT *, CASE WHEN size>=frames THEN 0 ELSE (frames-size)//2 END AS a, CASE WHEN size>=frames THEN frames-1 ELSE (frames-size)//2+size-1 END AS z FROM w)
  SELECT id, i::INT AS slot, CASE WHEN i=15 THEN z ELSE floor(i*((z-a)::DOUBLE/15)+a)::BIGINT END AS frame FROM b, range(16) r(i)""")
def _(t):
    clips = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") * 7 + 5).cast("long").alias("frames"),
                          ((F.col("p_partkey") % 3) * 12.0 + 12).alias("fps"))
    return s.center_window_pick(clips, 16).select("id", "slot", "frame")


@query("frame_mean_score", """SELECT clip_id, n AS frames, CASE WHEN n=8 THEN round(m,9) END AS score, CASE WHEN n<>8 THEN 'error' WHEN m>0 THEN 'ai' ELSE 'not_ai' END AS decision
   FROM (SELECT clip_id, count(*) AS n, avg(embedding[1]::DOUBLE) AS m FROM {vectors} GROUP BY 1)""")
def _(t):
    from ..operators.vectors import frame_mean_score
    return rounded(frame_mean_score(t.vectors.select("clip_id", F.col("embedding")[0].cast("double").alias("logit"))), "score")
