"""SELECTs that shape the driver's tables into operator inputs.

The text is shared by Spark and the check engine, so a binding is only an
input definition; every operator's own logic is written twice.
"""

from __future__ import annotations

from .registry import Dialect, binding


@binding
def truth(d: Dialect) -> str:
    """Manifest rows: one per labelled document."""
    bucket = f"{d.hexnum('substr(' + d.sha(chr(39) + 'split-v1:' + chr(39) + ' || md5(t.text)') + ', 1, 8)')} % 10"
    return f"""
    SELECT CAST(t.doc_id AS STRING) AS id, t.doc_id AS num, md5(t.text) AS group_id,
           {d.sha('t.text')} AS sha256,
           CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'real' WHEN l.quality = 1 THEN 'cgi'
                WHEN l.toxic = 1 THEN 'mixed' ELSE 'ai' END AS label,
           CASE WHEN {bucket} < 4 THEN 'development' WHEN {bucket} < 6 THEN 'calibration'
                ELSE 'holdout' END AS split,
           t.source AS generator, t.lang AS platform,
           'set-' || CAST(t.doc_id % 4 AS STRING) AS dataset,
           CASE t.doc_id % 3 WHEN 0 THEN 'original' WHEN 1 THEN 'mild' ELSE 'severe' END AS transformation,
           t.n_chars AS n_chars
    FROM {{documents}} t JOIN {{labels}} l ON t.doc_id = l.doc_id"""


def _run(a: int, b: int, missing: str) -> str:
    score = f"((t.n_chars * {a} + t.doc_id * {b}) % 1000) / 1000.0E0"
    return f"""
    SELECT id, num, sha256, score,
           CASE WHEN num % 29 = 0 THEN 'timeout' END AS error,
           CASE WHEN num % 29 = 0 THEN NULL WHEN score >= 0.55E0 THEN 'ai'
                WHEN score < 0.45E0 THEN 'not_ai' ELSE 'abstain' END AS decision,
           CASE WHEN score >= 0.85E0 OR score <= 0.15E0 THEN 'High'
                WHEN score >= 0.65E0 OR score <= 0.35E0 THEN 'Medium' ELSE 'Low' END AS confidence,
           CASE WHEN num % 31 = 0 THEN NULL ELSE CAST(n_chars % 5003 AS DOUBLE) END AS elapsed_ms
    FROM (SELECT CAST(t.doc_id AS STRING) AS id, t.doc_id AS num, {score} AS score, t.n_chars AS n_chars,
                 CASE WHEN t.doc_id % 53 = 0 THEN 'changed' ELSE SHA_TEXT END AS sha256
          FROM {{documents}} t JOIN {{labels}} l ON t.doc_id = l.doc_id
          WHERE t.doc_id % {missing} <> 5) q"""


@binding
def before_run(d: Dialect) -> str:
    """One detector run; a few clips were never attempted, a few bytes differ."""
    return _run(1, 0, "41").replace("SHA_TEXT", d.sha("t.text"))


@binding
def after_run(d: Dialect) -> str:
    return _run(3, 7, "43").replace("SHA_TEXT", d.sha("t.text"))


@binding
def judged(d: Dialect) -> str:
    """Truth with the first run's outcome; every clip present, hashes equal."""
    return """
    SELECT m.id AS id, m.num AS num, m.group_id AS group_id, m.label AS label, m.split AS split,
           m.generator AS generator, m.platform AS platform, m.dataset AS dataset,
           m.transformation AS transformation, m.sha256 AS sha256,
           (m.n_chars % 1000) / 1000.0E0 AS score,
           (m.n_chars % 37) / 50.0E0 AS disagreement,
           CASE WHEN m.num % 29 = 0 THEN 'timeout' END AS error,
           CASE WHEN m.num % 29 = 0 THEN NULL WHEN m.n_chars % 1000 >= 550 THEN 'ai'
                WHEN m.n_chars % 1000 < 450 THEN 'not_ai' ELSE 'abstain' END AS decision,
           CASE WHEN m.n_chars % 1000 >= 850 OR m.n_chars % 1000 <= 150 THEN 'High'
                WHEN m.n_chars % 1000 >= 650 OR m.n_chars % 1000 <= 350 THEN 'Medium' ELSE 'Low' END AS confidence,
           CASE WHEN m.num % 31 = 0 THEN NULL ELSE CAST(m.n_chars % 5003 AS DOUBLE) END AS elapsed_ms
    FROM {truth} m"""


@binding
def rejudged(d: Dialect) -> str:
    """The same clips judged by a second detector."""
    return """
    SELECT m.id AS id, m.num AS num, m.group_id AS group_id, m.label AS label, m.sha256 AS sha256,
           ((m.n_chars * 3 + m.num * 7) % 1000) / 1000.0E0 - 0.5E0 AS score,
           CASE WHEN m.num % 37 = 0 THEN 'quota' END AS error,
           CASE WHEN m.num % 37 = 0 THEN NULL WHEN (m.n_chars * 3 + m.num * 7) % 1000 >= 500 THEN 'ai'
                WHEN (m.n_chars * 3 + m.num * 7) % 1000 < 380 THEN 'not_ai' ELSE 'abstain' END AS decision,
           'Low' AS confidence
    FROM {truth} m"""


@binding
def samples(d: Dialect) -> str:
    """Time-sampled scores: case = user, position in days as whole nano-days."""
    us = f"({d.micros('e.ts')} - {d.micros('TIMESTAMP ' + chr(39) + '2024-01-01 00:00:00' + chr(39))})"
    nano = f"({us} * 1000 - ({us} * 1000) % 86400)"
    return f"""
    SELECT e.user_id AS case_id, e.event_id AS event_id, {us} AS at_us,
           CAST({nano} / 86400 AS BIGINT) AS nano,
           CASE WHEN e.event_type = 'error' AND e.event_id % 97 = 0 THEN NULL
                WHEN e.value >= 70 THEN 1.0E0 ELSE e.value / 70 END AS score,
           e.event_type AS event_type, e.value AS value
    FROM {{events}} e"""


@binding
def cases(d: Dialect) -> str:
    """Planned cases: one per customer key, most of which also have samples."""
    return """
    SELECT c.c_custkey AS case_id, 31.0E0 AS duration, c.c_mktsegment AS segment,
           CASE c.c_custkey % 3 WHEN 0 THEN 'publisher_assigned_ai' WHEN 1 THEN 'documented_negative'
                ELSE 'receipt_backed_same_parent_check' END AS cohort,
           CASE c.c_nationkey % 3 WHEN 0 THEN 'original' WHEN 1 THEN 'mild' ELSE 'severe' END AS quality,
           c.c_custkey % 40 AS parent_id
    FROM {customer} c"""


@binding
def census(d: Dialect) -> str:
    """Archive listing: one member per part."""
    return """
    SELECT CASE WHEN p.p_partkey % 3 = 0 THEN 'train/real/' ELSE 'train/fake/' || lower(p.p_type) || '/' END
             || 'm' || CAST(p.p_partkey AS STRING)
             || CASE WHEN p.p_partkey % 17 = 0 THEN '.txt' ELSE '.mp4' END AS name,
           p.p_partkey AS num, p.p_type AS kind,
           CASE WHEN p.p_partkey % 41 = 0 THEN 1 WHEN p.p_partkey % 7 = 0 THEN 2050 ELSE 2048 END AS flags,
           CASE WHEN p.p_partkey % 43 = 0 THEN 12 WHEN p.p_partkey % 5 = 0 THEN 0 ELSE 8 END AS method,
           CAST(p.p_size * 97 + p.p_partkey % 11 AS BIGINT) AS compressed_bytes,
           CAST(p.p_size * 211000 AS BIGINT) AS uncompressed_bytes,
           CASE WHEN p.p_partkey % 47 = 0 THEN 'ZZ' ELSE substr(md5(CAST(p.p_partkey AS STRING)), 1, 8) END AS crc32,
           CAST(p.p_partkey * 3000 - CASE WHEN p.p_partkey % 71 = 70 THEN 3000 ELSE 0 END AS BIGINT) AS local_header_offset
    FROM {part} p"""


@binding
def passes(d: Dialect) -> str:
    """Inspection passes: clip = conversation, pass = turn."""
    return """
    SELECT c.conv_id AS clip_id, c.turn AS turn,
           CASE c.role WHEN 'system' THEN 'adjudication' WHEN 'user' THEN 'sweep' ELSE 'review' END AS kind,
           CASE WHEN c.turn % 2 = 0 THEN 'static' ELSE 'agentic' END AS mode,
           CASE WHEN length(c.text) % 5 = 0 THEN 'model-b' ELSE 'model-a' END AS model,
           CASE WHEN length(c.text) % 7 = 0 THEN 'failed' WHEN length(c.text) % 23 = 0 THEN 'lost'
                ELSE 'complete' END AS status,
           CASE WHEN length(c.text) % 11 = 0 THEN NULL ELSE CAST(length(c.text) AS BIGINT) END AS input_tokens,
           CASE WHEN length(c.text) % 13 = 0 THEN NULL ELSE CAST(length(c.text) % 97 AS BIGINT) END AS output_tokens,
           CASE WHEN length(c.text) % 17 = 0 THEN NULL ELSE CAST(length(c.text) * 3 AS DOUBLE) END AS elapsed_ms,
           CASE WHEN length(c.text) % 3 = 0 THEN TRUE WHEN length(c.text) % 3 = 1 THEN FALSE END AS valid_for_corroboration,
           CASE WHEN c.turn % 2 = 0 THEN 2.0E0 END AS fps,
           CAST(length(c.text) AS BIGINT) AS n
    FROM {conversations} c"""


@binding
def clips(d: Dialect) -> str:
    """Clip reports with up to two cited moments, spread over all rule paths."""
    def pick(expr: str, *values: str) -> str:
        arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
        return f"CASE {expr} {arms} ELSE '{values[-1]}' END"

    n = "t.n_chars"
    h = d.hexnum("substr(md5(CAST(t.doc_id AS STRING)), 1, 12)")
    return f"""
    SELECT q.*, CASE WHEN q.h2 % 8 = 0 THEN 'no_audio' WHEN q.h2 % 8 = 1 THEN 'limited' ELSE 'adequate' END AS audio_coverage
    FROM (
    SELECT t.doc_id AS clip_id, {h} AS h, CAST(FLOOR({h} / 1000.0E0) AS BIGINT) AS h2,
           CASE WHEN {h} % 3 = 0 THEN CAST({n} % 101 AS DOUBLE) ELSE CAST({n} % 60 + 3 AS DOUBLE) END AS ai_likelihood,
           {pick(f'{h} % 9', 'likely_ai_generated', 'possibly_ai_generated', 'mixed_or_ai_edited', 'inconclusive', 'likely_not_ai_generated')} AS visual_classification,
           {pick(f'{h} % 7', 'generated', 'edited', 'inconclusive', 'likely_authentic')} AS visual_assessment,
           {pick(f'{h} % 11', 'synthetic', 'likely_synthetic', 'inconclusive', 'likely_recorded')} AS audio_assessment,
           {pick(f'{h} % 13', 'face_swap', 'lip_sync_manipulation', 'inconclusive', 'none_detected')} AS identity_manipulation,
           {pick(f'{h} % 10', 'limited', 'insufficient', 'sufficient')} AS evidence_sufficiency,
           {pick(f'{h} % 14', 'disagree', 'not_available', 'resolved', 'agree')} AS review_agreement,
           {pick(f'{h} % 15', 'limited', 'unavailable', 'adequate')} AS visual_coverage,
           {pick(f'{h} % 12', 'limited', 'unknown', 'adequate')} AS temporal_coverage,
           CASE WHEN {h} % 21 = 0 THEN TRUE ELSE FALSE END AS invalid_observations,
           CASE WHEN {h} % 16 = 0 THEN NULL ELSE 20.0E0 END AS duration,
           CASE WHEN {n} % 4 = 0 THEN NULL WHEN {n} % 4 = 1 THEN '00:' || CAST(10 + {n} % 50 AS STRING)
                WHEN {n} % 4 = 2 THEN '0:0' || CAST({n} % 10 AS STRING) || '.5' ELSE '1:75' END AS m1_time,
           {pick(f'{n} % 3', 'low', 'medium', 'high')} AS m1_severity,
           {pick(f'{n} % 5', 'audio', 'identity', 'physics', 'text', 'temporal')} AS m1_category,
           CASE WHEN {n} % 6 < 3 THEN NULL ELSE '00:0' || CAST({n} % 9 AS STRING) END AS m2_time,
           {pick(f'({n} + 1) % 3', 'low', 'medium', 'high')} AS m2_severity,
           {pick(f'({n} + 2) % 4', 'audio', 'identity', 'lighting', 'other')} AS m2_category,
           CASE WHEN {n} % 22 = 3 THEN 'found' ELSE 'not_found' END AS provenance_status,
           CASE WHEN {n} % 44 = 3 THEN TRUE ELSE FALSE END AS provenance_trusted,
           CASE WHEN {n} % 66 = 3 THEN FALSE ELSE TRUE END AS provenance_valid,
           CASE WHEN {n} % 5 = 0 THEN NULL WHEN {n} % 5 < 3 THEN TRUE ELSE FALSE END AS provenance_generative,
           CASE WHEN {n} % 19 = 4 THEN TRUE ELSE FALSE END AS disclosed,
           CASE WHEN {n} % 23 = 5 THEN TRUE ELSE FALSE END AS creator_admission,
           {n} AS n_chars
    FROM {{documents}} t) q"""


@binding
def vectors(d: Dialect) -> str:
    """Embedding sequences: eight consecutive vectors make one clip."""
    return """
    SELECT CAST(FLOOR(v.vec_id / 8.0E0) AS BIGINT) AS clip_id, CAST(v.vec_id % 8 AS INT) AS frame_no,
           v.embedding AS embedding, v.label AS label
    FROM {embeddings} v"""


@binding
def ledger(d: Dialect) -> str:
    """Operation ledger: reserve and receive events in sequence order."""
    return """
    SELECT o.o_orderkey AS seq, o.o_custkey AS row_id,
           CASE WHEN o.o_orderstatus = 'F' THEN 'received' ELSE 'reserve' END AS kind,
           CAST(CASE WHEN o.o_orderkey % 211 = 7 THEN o.o_orderkey + 1 ELSE o.o_orderkey END AS BIGINT) AS sequence,
           CAST(FLOOR(o.o_totalprice) AS BIGINT) AS bytes
    FROM {orders} o"""


@binding
def receipts(d: Dialect) -> str:
    """Case receipts of a frozen screen: case = order, parent = customer."""
    return """
    SELECT o.o_orderkey AS id, o.o_custkey AS parent_id,
           CASE o.o_orderstatus WHEN 'F' THEN 'publisher_assigned_ai' WHEN 'O' THEN 'documented_negative'
                ELSE 'receipt_backed_same_parent_check' END AS cohort,
           CASE o.o_orderkey % 3 WHEN 0 THEN 'original' WHEN 1 THEN 'mild' ELSE 'severe' END AS quality,
           CASE WHEN o.o_custkey % 31 = 0 THEN 'technical_error' WHEN o.o_custkey % 37 = 1 THEN 'not_attempted'
                WHEN CAST(FLOOR(o.o_totalprice) AS BIGINT) % 3 = 0 THEN 'persistent_ai_indicators'
                WHEN CAST(FLOOR(o.o_totalprice) AS BIGINT) % 7 = 0 THEN 'inconclusive' ELSE 'no_clear_indicators' END AS decision,
           CASE WHEN o.o_orderkey % 11 = 0 THEN o.o_orderkey % 3 ELSE 0 END AS isolated,
           CAST(FLOOR(o.o_totalprice) AS BIGINT) % 9001 AS elapsed, o.o_orderpriority AS generator
    FROM {orders} o"""


@binding
def window_runs(d: Dialect) -> str:
    """Executed score windows: clip = order, window = line."""
    return """
    SELECT l.l_orderkey AS clip_id, l.l_linenumber AS window_no, l.l_suppkey AS s, l.l_partkey AS p,
           CASE WHEN l.l_suppkey % 23 = 0 THEN NULL ELSE (l.l_partkey % 100) / 50.0E0 - 1.3E0 END AS logit,
           CASE WHEN l.l_suppkey % 19 = 0 THEN NULL ELSE (l.l_partkey % 90) / 50.0E0 - 1.1E0 END AS control_logit
    FROM {lineitem} l"""


@binding
def edits(d: Dialect) -> str:
    """Edited study cases: one per supplier."""
    return """
    SELECT s.s_suppkey AS case_id, CASE s.s_suppkey % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'hardcut' ELSE 'blend' END AS composition,
           s.s_nationkey AS host_id, CASE WHEN s.s_suppkey % 3 = 0 THEN NULL ELSE s.s_nationkey + 100 END AS donor_id,
           s.s_nationkey % 2 = 0 AS host_ai, s.s_suppkey % 5 = 0 AND s.s_suppkey % 3 <> 0 AS donor_ai
    FROM {supplier} s"""


@binding
def captions(d: Dialect) -> str:
    """Whole document texts, some followed by a claim, denial or question."""
    tails = ["This video was made with AI.", "Is this AI-generated?", "Not AI-generated at all.", "Look #aigenerated", "Clip made with Sora today",
             "see www.example.com/a?b=1 and foo.example.org/x now", "Learn how: generated with AI", "our reel is ai-generated", "Synthetic media inside",
             "Artificial intelligence generated art", "nothing to add", "https://example.net/path"]
    arms = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(tails))
    titles = ["[AI-generated] : clip", "Made with Veo - clip", "plain title", "synthetic media | x", "Not ai-generated: x"]
    names = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(titles))
    return f"""
    SELECT t.doc_id AS doc_id, t.text || chr(10) || CASE t.doc_id % 12 {arms} END AS caption, CASE t.doc_id % 5 {names} END AS title
    FROM {{documents}} t"""


URL_FORMS = [
    "'https://www.youtube.com/watch?v=' || k || '&utm_source=share&t=3s'", "'http://youtu.be/' || k || '?si=abc'",
    "'https://m.youtube.com/shorts/' || k || '/'", "'https://www.youtube-nocookie.com/embed/' || k",
    "'https://youtube.com/watch?v=short'", "'https://youtu.be/' || k || '/extra'",
    "'https://www.tiktok.com/@someone/video/' || n || '?lang=en'", "'https://vm.tiktok.com/' || k || '/'",
    "'https://www.tiktok.com/t/' || k", "'https://www.tiktok.com/@someone'",
    "'https://www.instagram.com/reel/' || k || '/?igsh=x'", "'https://instagram.com/some.one/p/' || k",
    "'https://www.instagram.com/share/reel/' || k", "'https://www.instagram.com/explore'",
    "'https://x.com/someone/status/' || n || '/video/1'", "'https://twitter.com/i/web/status/' || n",
    "'https://mobile.twitter.com/statuses/' || n", "'https://x.com/someone/status/0123'",
    "'https://user:pw@x.com/i/status/1'", "'ftp://x.com/i/status/1'", "'not a url'", "u",
    "'  https://X.com/i/status/' || n || '  '", "'https://www.youtube.com/channel/abc'"]


@binding
def urls(d: Dialect) -> str:
    """Every page's own URL, and one platform URL derived from it."""
    arms = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(URL_FORMS))
    return f"""
    SELECT page_id, f AS form, k, n, u, CASE f {arms} END AS url FROM (
      SELECT p.page_id AS page_id, p.page_id % 24 AS f, substr(md5(p.url), 1, 11) AS k, CAST(p.page_id * 1000003 + 10000000 AS STRING) AS n, p.url AS u FROM {{pages}} p
      UNION ALL SELECT p.page_id, 21, substr(md5(p.url), 1, 11), CAST(p.page_id AS STRING), p.url FROM {{pages}} p) q"""


@binding
def cached(d: Dialect) -> str:
    """Analysis results in arrival order: one per event."""
    return f"""
    SELECT e.event_id AS event_id, CASE WHEN e.event_id % 83 = 0 THEN NULL ELSE 'upload:' || CAST(e.user_id AS STRING) END AS canonical_key,
           CASE e.event_id % 7 WHEN 0 THEN 'youtube' WHEN 1 THEN 'vimeo' WHEN 2 THEN 'x' ELSE 'upload' END AS platform,
           CASE e.event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'stored' ELSE 'complete' END AS status,
           'v' || CAST(e.event_id % 3 AS STRING) AS analyzer_version, CAST(FLOOR(e.value) AS BIGINT) % 120 AS final_score,
           {d.micros('e.ts')} AS analyzed_us, {d.micros('e.ts')} + 604800000000 AS expires_us, e.user_id AS user_id
    FROM {{events}} e"""
