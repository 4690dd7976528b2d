"""Window plans, frame picks, shots, lineage and presentation coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import codes, first_of, truthy
from .ordered import adjacent_pairs, as_of, next_in_order, row_rank, running_sums


def window_starts(duration: Column, width: float, stride: float) -> Column:
    """Even starts, plus one end-aligned start when the grid misses the end."""
    last = duration - width
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(last / stride)).cast("int"))
    grid = F.transform(steps, lambda i: i * F.lit(float(stride)))
    tail = F.when(F.abs(F.element_at(grid, -1) - last) > 1e-6, F.array(last.cast("double"))).otherwise(
        F.array().cast("array<double>"))
    return F.when(duration <= width, F.array(F.lit(0.0))).otherwise(F.concat(grid, tail))


def sliding_windows(clips: DataFrame, width: float = 2.0, stride: float = 1.0, *, shortest: float = 0.5,
                    longest: float = 120.0) -> DataFrame:
    """(id, window_no, start, end, problem); a clip outside the supported length has one row with nulls and the problem."""
    supported = truthy(F.col("duration").between(shortest, longest + 1e-6))
    planned = F.when(supported, window_starts(F.col("duration"), width, stride))
    return clips.select("*", F.posexplode_outer(planned).alias("window_no", "start")).withColumns({
        "end": F.when(F.col("duration") <= width, F.col("start") + F.col("duration")).otherwise(F.col("start") + width),
        "problem": F.when(~supported, "unsupported_duration")})


def register_plan_windows(spark: SparkSession, name: str = "plan_windows") -> None:
    """SQL faces of ``sliding_windows``: SELECT * FROM clips, LATERAL plan_windows(duration, 2D, 1D).

    SQL table functions, so their bodies are planned with the query around them.
    ``plan_windows_checked`` gives one more column and, for a clip outside the
    supported length, one row with its problem; ``plan_windows`` gives windows only.
    """
    checked = f"{name}_checked"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {checked}(duration DOUBLE, width DOUBLE, stride DOUBLE)
        RETURNS TABLE (window_no INT, start DOUBLE, end DOUBLE, problem STRING) RETURN
        SELECT n, s, IF(duration <= width, s + duration, s + width), IF(s IS NULL, 'unsupported_duration', NULL) FROM (
            SELECT posexplode_outer(CASE WHEN duration IS NULL OR duration < 0.5 OR duration > 120.000001 THEN NULL WHEN duration <= width THEN array(0D)
                ELSE concat(transform(sequence(0, CAST(floor((duration - width) / stride) AS INT)), i -> i * stride),
                     IF(abs(floor((duration - width) / stride) * stride - (duration - width)) > 1e-6, array(duration - width), array())) END) AS (n, s))""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(duration DOUBLE, width DOUBLE, stride DOUBLE)
        RETURNS TABLE (window_no INT, start DOUBLE, end DOUBLE) RETURN
        SELECT w.window_no, w.start, w.end FROM {checked}(duration, width, stride) w WHERE w.problem IS NULL""")


def window_membership(frames: DataFrame, windows: DataFrame, width: float, key: str = "case_id") -> DataFrame:
    """Frames inside each half-open window, windows may overlap.

    A window touches at most two width-sized cells of the time axis, so the
    range join is an equi-join on (key, cell) plus a filter.
    """
    cells = windows.withColumn("_cell", F.explode(F.sequence(
        F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    placed = frames.withColumn("_cell", F.floor(F.col("pts") / width))
    return placed.join(cells, [key, "_cell"]).filter(
        (F.col("pts") >= F.col("start")) & (F.col("pts") < F.col("end"))).drop("_cell")


def evenly(count: int, n: Column) -> Column:
    """``count`` indices of 0..n-1 spaced evenly, both ends included."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * (n - 1) / (count - 1)))


def frame_pick(members: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: str, count: int = 8) -> DataFrame:
    """``count`` evenly spaced frames of each window that has at least that many."""
    ranked = row_rank(members, keys, bucket, [F.col(c) for c in order], "at", start=0, total="frames")
    slot = F.array_position(evenly(count, F.col("frames")), F.col("at"))
    return ranked.filter((F.col("frames") >= count) & (slot > 0)).withColumn("slot", slot - 1)


def short_windows(windows: DataFrame, members: DataFrame, keys: Sequence[str], count: int = 8) -> DataFrame:
    seen = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"))
    return windows.join(seen, list(keys), "left").select(*keys, F.coalesce("frames", F.lit(0)).alias("frames")).filter(
        F.col("frames") < count)


def shots(frames: DataFrame, order: Sequence[str], bucket: str, fps: int, min_frames: int = 8) -> DataFrame:
    """Shots between cut frames; a cut frame starts its shot. Short shots stay visible."""
    cut = F.col("is_cut").cast("int")
    numbered = running_sums(frames, ["case_id"], bucket, [F.col(c) for c in order],
                            {"position": F.lit(1), "cuts": cut})
    # a cut on the first frame opens no extra shot
    found = numbered.groupBy("case_id", "cuts").agg(F.min("position").alias("p"), F.count(F.lit(1)).alias("length"))
    return found.select("case_id", (F.col("p") - 1).alias("start_frame"),
                        (F.col("p") - 1 + F.col("length")).alias("end_frame"), "length",
                        ((F.col("length") >= fps) & (F.col("length") >= min_frames)).alias("supported"))


def shot_windows(found: DataFrame, fps: int, seconds: int = 4, stride: int = 2, picks: int = 16) -> DataFrame:
    """Windows of each supported shot with their requested frames; one null window otherwise."""
    width = F.least(F.lit(seconds * fps), F.col("length"))
    last = F.col("length") - width
    grid = F.sequence(F.lit(0).cast("long"), last, F.lit(stride * fps).cast("long"))
    starts = F.when(F.element_at(grid, -1) == last, grid).otherwise(F.concat(grid, F.array(last)))
    rows = found.withColumn("width", width).withColumn(
        "local", F.explode_outer(F.when(F.col("supported"), starts)))
    first = F.col("start_frame") + F.col("local")
    asked = F.transform(evenly(picks, F.col("width")), lambda i: i + first)
    return rows.select("case_id", "start_frame", "end_frame", "supported", first.alias("window_start"),
                       (first + F.col("width")).alias("window_end"),
                       F.when(F.col("supported"), asked).alias("frames"),
                       F.when(F.col("supported"), picks - F.size(F.array_distinct(asked))).alias("duplicates"))


def clip_from_windows(windows: DataFrame, logit: str = "logit") -> DataFrame:
    """A positive window decides even if others failed; a negative needs every window."""
    return windows.groupBy("clip_id").agg(
        F.max(logit).alias("max_logit"), F.count(logit).alias("valid"),
        F.count_if(F.col(logit).isNull()).alias("failed")).withColumn(
        "ai", F.when(F.col("max_logit") >= 0, True).when(F.col("failed") == 0, False))


def window_plan_check(plan: DataFrame, executed: DataFrame) -> DataFrame:
    """Windows missing from, added to, or moved against the plan."""
    a = plan.select("clip_id", "window_no", F.col("start").alias("planned"))
    b = executed.select("clip_id", "window_no", F.col("start").alias("ran"))
    return a.join(b, ["clip_id", "window_no"], "full_outer").withColumn("problem", first_of(
        (F.col("ran").isNull(), "missing"), (F.col("planned").isNull(), "extra"),
        (F.col("planned") != F.col("ran"), "moved"))).filter("problem is not null")


def donor_alpha(composition: Column, frame: Column, start: int = 36, end: int = 84, ramp: int = 6) -> Column:
    """Donor share of a master frame: a hard cut, or a linear ramp at both ends."""
    inside = (frame >= start) & (frame < end)
    rise = (2 * (frame - start) + 1) / (2 * ramp)
    fall = (2 * (end - frame) - 1) / (2 * ramp)
    return F.when(inside & (composition == "hardcut"), 1.0).when(
        inside & (composition == "blend"), F.least(F.lit(1.0), rise, fall)).otherwise(0.0)


def ai_share(alpha: Column) -> Column:
    return (F.when(F.col("host_ai"), 1 - alpha).otherwise(0.0) + F.when(F.col("donor_ai"), alpha).otherwise(0.0))


def _frame_count(cases: DataFrame) -> Column:
    return F.col("frames").cast("int") if "frames" in cases.columns else F.lit(120)


def _frames(cases: DataFrame) -> Column:
    """Frame numbers of a case: as many as its own ``frames`` say, 120 where cases have no such column."""
    last = _frame_count(cases) - 1
    return F.when(last >= 0, F.sequence(F.lit(0), last))


def lineage_build(cases: DataFrame) -> DataFrame:
    """Per output frame of each edit: donor share and known AI share.

    A case whose number of frames is unknown or not positive has one row without them.
    """
    rows = cases.withColumn("frame", F.explode_outer(_frames(cases)))
    alpha = F.when(F.col("frame").isNotNull(), donor_alpha(F.col("composition"), F.col("frame")))
    share = F.when(F.col("frame").isNotNull(), ai_share(alpha))
    return rows.select("case_id", F.col("frame").alias("output_index"), F.col("frame").alias("master_index"),
                       "host_id", "donor_id", alpha.alias("alpha"), share.alias("ai_share"))


def lineage_check(lineage: DataFrame, cases: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Problems of recorded lineage: missing frames, frames past the case's end,
    backward master index, shares or donor frames that differ from the plan, and
    cases whose number of frames is unknown."""
    # Spark takes rows exploded from cases for as small as those, so the hints keep them from being broadcast
    rows = lineage.join(cases.hint("shuffle_hash"), "case_id")
    planned = donor_alpha(F.col("composition"), F.col("master_index"))
    wrong = rows.select("case_id", "output_index", F.explode(codes(
        (F.abs(F.col("alpha") - planned) > tolerance, "alpha_differs"),
        (F.abs(F.col("ai_share") - ai_share(planned)) > tolerance, "ai_share_differs"),
        (~F.col("donor_frame").isNotNull().eqNullSafe(planned > 0), "donor_frame_presence"))).alias("problem"))
    back = adjacent_pairs(lineage.withColumn("_band", F.floor(F.col("output_index") / 4096)), ["case_id"], "_band",
                          ["output_index"], ["master_index"]).filter(
        "cur.master_index <= prev.master_index").select("case_id", F.col("cur.output_index").alias("output_index"),
                                                        F.lit("master_not_increasing").alias("problem"))
    planned_frames = cases.select("case_id", F.explode_outer(_frames(cases)).alias("output_index"))
    unknown = planned_frames.filter("output_index is null").withColumn("problem", F.lit("unknown_frames"))
    wanted = planned_frames.filter("output_index is not null")
    stored = lineage.select("case_id", "output_index")
    last = cases.select(F.col("case_id").alias("_case"), (_frame_count(cases) - 1).alias("_last"))
    extra = stored.join(last.hint("shuffle_hash"), (F.col("case_id") == F.col("_case")) & F.col("output_index").between(
        0, F.col("_last")), "left_anti").join(cases.select("case_id").hint("shuffle_hash"), "case_id", "left_semi").withColumn(
        "problem", F.lit("past_the_end"))
    lost = wanted.join(stored.hint("merge"), ["case_id", "output_index"], "left_anti").withColumn(
        "problem", F.lit("missing_frame"))
    return wrong.unionByName(back).unionByName(lost).unionByName(extra).unionByName(unknown)


def lineage_counts(picks: DataFrame, lineage: DataFrame) -> DataFrame:
    """What the sampled frames of each window are known to contain."""
    a, k = F.col("alpha"), F.col("ai_share")
    # both sides are exploded from their cases, whose size Spark takes for theirs: no broadcast
    return picks.join(lineage.hint("merge"), ["case_id", "output_index"]).groupBy("case_id", "window_no").agg(
        F.count(F.lit(1)).alias("sampled"), F.count_if(a > 0).alias("donor"), F.count_if(a == 1).alias("full_donor"),
        F.count_if((a > 0) & (a < 1)).alias("blend_edge"), F.count_if(k > 0).alias("known_ai"),
        F.count_if(k == 1).alias("full_ai"))


def lineage_source_match(lineage: DataFrame, native: DataFrame) -> DataFrame:
    """Lineage rows whose recorded host or donor native frame is not the parent's."""
    host = native.select(F.col("parent_id").alias("host_id"), "master_index", F.col("native_frame").alias("host_native"))
    donor = native.select(F.col("parent_id").alias("donor_id"), "master_index", F.col("native_frame").alias("donor_native"))
    rows = lineage.join(host, ["host_id", "master_index"], "left").join(donor, ["donor_id", "master_index"], "left")
    expected = F.when(F.col("alpha") > 0, F.col("donor_native"))
    return rows.withColumn("problem", first_of(
        (~F.col("host_frame").eqNullSafe(F.col("host_native")), "host_frame_differs"),
        (~F.col("donor_frame").eqNullSafe(expected), "donor_frame_differs"))).filter("problem is not null")


def presentation_coverage(frames: DataFrame, bucket: str, start: Column, end: Column) -> DataFrame:
    """Whether frames, each shown until its end or the next start, fill [start, end)."""
    shown = adjacent_pairs(frames, ["case_id"], bucket, ["at"], ["ends"])
    hole = F.least(F.col("prev.ends"), F.col("cur.at"))
    holes = shown.groupBy("case_id").agg(F.count_if(
        F.greatest(hole, start) < F.least(F.col("cur.at"), end)).alias("holes"))
    span = frames.groupBy("case_id").agg(F.min("at").alias("first"), F.max_by("ends", "at").alias("last"))
    return span.join(holes, "case_id", "left").fillna(0, ["holes"]).withColumn(
        "covered", (F.col("first") <= start) & (F.col("last") >= end) & (F.col("holes") == 0))


def asof_frame(frames: DataFrame, centres: DataFrame, bucket_of) -> DataFrame:
    """For each centre time, the last frame that started by then, if still shown."""
    one = frames.select("case_id", "at", F.lit(0).alias("_kind"), F.struct("frame_id", "ends").alias("_frame"),
                        F.lit(None).cast("int").alias("slot"))
    two = centres.select("case_id", "at", F.lit(1).alias("_kind"),
                         F.lit(None).cast("struct<frame_id:bigint,ends:bigint>").alias("_frame"), "slot")
    both = one.unionByName(two).withColumn("_cell", bucket_of(F.col("at")))
    found = as_of(both, ["case_id"], "_cell", ["at", "_kind", "slot"], F.col("_frame"), "_hit")
    return found.filter("_kind = 1").select("case_id", "slot", "at", F.when(
        F.col("at") < F.col("_hit.ends"), F.col("_hit.frame_id")).alias("frame_id"))


def entry_boundary(entries: DataFrame, central: int | Column, block: int = 1 << 20, keys: Sequence[str] = ()) -> DataFrame:
    """End of each archive entry: the next entry's offset, or the central directory.

    ``keys`` name the archive where there are several; ``central`` is then a
    column of its own offset. Entries are linked by block of offsets, and blocks
    by their first entries, level over level.
    """
    extra = [central.alias("_central")] if isinstance(central, Column) else [F.lit(central).cast("long").alias("_central")]
    at = entries.select(*keys, "name", "local_header_offset", *extra)
    linked = next_in_order(at, keys, "local_header_offset", ["local_header_offset", "name"], block)
    following = F.col("_next.local_header_offset")
    return linked.select(*keys, "name", "local_header_offset", F.coalesce(following, F.col("_central")).alias("boundary"),
                         F.coalesce(following == F.col("local_header_offset"), F.lit(False)).alias("duplicate"))


def hash_window(clips: DataFrame, salt: str = "window-v1:", length: float = 2.0) -> DataFrame:
    """Window start from the parent's hash, so all derivatives share it."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), F.col("parent_sha256")), 256), 1, 16), 16, 10)
    share = head.cast("decimal(20,0)").cast("double") / F.lit(18446744073709551616.0)
    width = F.least(F.lit(length), F.col("duration"))
    start = F.round(share * F.greatest(F.lit(0.0), F.col("duration") - width), 9)
    return clips.withColumn("start", start).withColumn("end", start + width)


def center_window_pick(clips: DataFrame, count: int, seconds: float = 4.0, place: Column | None = None) -> DataFrame:
    """``count`` even frame numbers of a centred window, or of one placed by the
    hash in ``place``; the whole clip when it is shorter than the window."""
    total = F.col("frames")
    size = F.greatest(F.least(F.floor(F.lit(seconds) * F.col("fps")), total), F.lit(count).cast("long"))
    room = total - size
    start = F.floor(room / 2) if place is None else F.pmod(place, room + 1)
    first = F.when(size >= total, F.lit(0)).otherwise(start)
    stop = F.when(size >= total, total - 1).otherwise(start + size - 1)
    step = (stop - first) / (count - 1)
    picks = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.when(
        i == count - 1, stop).otherwise(F.floor(i * step + first)))
    return clips.select("*", F.posexplode(picks).alias("slot", "frame"))


def overlap_free_topk(clips: DataFrame, seconds: Column, reach: float = 2.0, limit: int = 3) -> DataFrame:
    """Up to three non-overlapping intervals around the gravest moments of a clip.

    ``moments`` is the clip's own short array, so the greedy choice is a fold
    inside the row: no shuffle and no Python. ``limit`` is part of the rule;
    ``left_out`` counts the moments that got no interval.
    """
    rank = lambda m: F.when(m["severity"] == "high", 0).when(m["severity"] == "medium", 1).otherwise(2)
    listed = F.array_sort(F.transform("moments", lambda m, i: F.struct(
        rank(m).alias("rank"), i.alias("at"), seconds(m["timestamp"]).alias("s"))))
    empty = F.array().cast("array<struct<start:double,end:double>>")

    def keep(kept, m):
        start, end = F.greatest(F.lit(0.0), m["s"] - reach), F.least(F.col("duration"), m["s"] + reach)
        usable = m["s"].isNotNull() & truthy(m["s"] <= F.col("duration")) & truthy(end > start)
        clash = F.exists(kept, lambda w: (w["start"] <= end) & (w["end"] >= start))
        return F.when(usable & ~clash & (F.size(kept) < limit),
                      F.concat(kept, F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(kept)

    kept = clips.withColumn("windows", F.aggregate(listed, empty, keep))
    return kept.withColumn("left_out", F.greatest(F.size("moments"), F.lit(0)) - F.size("windows"))
