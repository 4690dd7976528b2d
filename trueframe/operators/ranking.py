"""Rank statistics over scores: AUROC, average precision, FPR thresholds.

Rows are first reduced to positive/negative counts per distinct score, so a
score shared by a third of the rows is one row by the time it is ordered.
The ordering itself is split by score band (see ``ordered``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import is_positive
from ..functions.stats import ratio
from .ordered import running_sums, score_bucket

EXACT = "decimal(38,0)"


def score_counts(df: DataFrame, score: str = "score", keys: Sequence[str] = (), *,
                 positive: Column | None = None, weight: Column | None = None) -> DataFrame:
    """Counts per distinct score; a missing score is an error, not a low score."""
    pos = is_positive(F.col("label")) if positive is None else positive
    one = F.lit(1) if weight is None else weight
    known = F.coalesce(F.col(score), F.raise_error(F.lit("score missing")).cast("double"))
    return df.groupBy(*keys, known.alias("score")).agg(
        F.sum(F.when(pos, one).otherwise(0)).alias("pos"), F.sum(F.when(pos, 0).otherwise(one)).alias("neg"))


def auroc_from_counts(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Chance that a positive outranks a negative, ties one half; null without both classes."""
    scanned = running_sums(counts.withColumn("band", score_bucket(F.col("score"))), keys, "band",
                           [F.col("score")], {"below": F.col("neg")}, inclusive=False)
    twice = F.col("pos").cast(EXACT) * (2 * F.col("below") + F.col("neg"))
    grouped = scanned.groupBy(*keys) if keys else scanned
    sums = grouped.agg(F.sum(twice.cast(EXACT)).alias("twice"), F.sum("pos").alias("positives"),
                       F.sum("neg").alias("negatives"))
    base = 2.0 * F.col("positives") * F.col("negatives")
    return sums.select(*keys, "positives", "negatives", ratio(F.col("twice").cast("double"), base).alias("auroc"))


def auroc(df: DataFrame, score: str = "score", keys: Sequence[str] = (), positive: Column | None = None) -> DataFrame:
    return auroc_from_counts(score_counts(df, score, keys, positive=positive), keys)


def average_precision(df: DataFrame, score: str = "score", keys: Sequence[str] = (),
                      positive: Column | None = None) -> DataFrame:
    """Sum over descending thresholds of recall gained times precision reached."""
    counts = score_counts(df, score, keys, positive=positive).withColumn("band", score_bucket(-F.col("score")))
    scanned = running_sums(counts, keys, "band", [F.col("score").desc()],
                           {"tp": F.col("pos"), "fp": F.col("neg")})
    gain = F.when(F.col("pos") > 0, F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    grouped = scanned.groupBy(*keys) if keys else scanned
    return grouped.agg(F.sum(gain).alias("g"), F.sum("pos").alias("p")).select(
        *keys, ratio(F.col("g"), F.col("p")).alias("ap"))


def class_accuracy(df: DataFrame, score: str = "score", threshold: float = 0.5) -> DataFrame:
    pos, hit = is_positive(F.col("label")), F.col(score) > threshold
    return df.agg(
        ratio(F.count_if(~pos & ~hit), F.count_if(~pos)).alias("real_acc"),
        ratio(F.count_if(pos & hit), F.count_if(pos)).alias("fake_acc"),
        ratio(F.count_if(pos == hit), F.count(F.lit(1))).alias("acc"))


def threshold_at_fpr(df: DataFrame, targets: Sequence[float], split: str | None = "development") -> DataFrame:
    """Threshold per target rate: the negative at position floor(rate * n), descending.

    Only counts per distinct score are ranked: the position falls in the score
    whose running negative count first exceeds it. The rule is strictly above.
    """
    rows = df if split is None else df.filter(F.col("split") == split)
    counts = score_counts(rows).withColumn("band", score_bucket(-F.col("score")))
    scanned = running_sums(counts, [], "band", [F.col("score").desc()],
                           {"neg_at_or_above": F.col("neg"), "pos_at_or_above": F.col("pos")})
    totals = scanned.agg(F.sum("neg").alias("negatives"), F.sum("pos").alias("positives"))
    wanted = totals.withColumn("target", F.explode(F.array(*[F.lit(float(x)) for x in targets]))).withColumn(
        "position", F.floor(F.col("target") * F.col("negatives")))
    hit = scanned.join(F.broadcast(wanted), (F.col("neg_at_or_above") > F.col("position")) &
                       (F.col("neg_at_or_above") - F.col("neg") <= F.col("position")))
    return hit.select(
        "target", F.col("score").alias("threshold"), "negatives", "positives",
        (F.col("neg_at_or_above") - F.col("neg")).alias("false_positives"),
        (F.col("pos_at_or_above") - F.col("pos")).alias("true_positives"),
        ratio((F.col("pos_at_or_above") - F.col("pos")), F.col("positives")).alias("recall"))


def per_generator(df: DataFrame, higher_is_real: bool = True) -> DataFrame:
    """AUROC and AP of each source model against all real rows.

    Every generator meets the same negatives, so they are ranked once: each
    distinct score learns how many real rows lie below and at it, and the
    generators' own counts are joined to that by score. No row is repeated.
    """
    sign = F.lit(-1.0 if higher_is_real else 1.0)
    pos = is_positive(F.col("label"))
    rows = df.filter(pos | (F.col("label") == "real")).select(
        (F.col("score") * sign).alias("score"), F.when(pos, F.col("generator")).alias("generator"), pos.alias("pos"))
    fake = rows.filter("pos").groupBy("generator", "score").agg(F.count(F.lit(1)).alias("pos"))
    at = rows.groupBy("score").agg(F.count_if(~F.col("pos")).alias("neg"))
    ranked = running_sums(at.withColumn("band", score_bucket(F.col("score"))), [], "band", [F.col("score")],
                          {"below": F.col("neg")}, inclusive=False).select("score", "neg", "below")
    total = at.agg(F.sum("neg").alias("negatives"))
    met = fake.join(ranked, "score").crossJoin(F.broadcast(total))
    banded = running_sums(met.withColumn("band", score_bucket(-F.col("score"))), ["generator"], "band",
                          [F.col("score").desc()], {"tp": F.col("pos")})
    above = F.col("negatives") - F.col("below")
    out = banded.groupBy("generator").agg(
        F.sum("pos").alias("positives"), F.max("negatives").alias("negatives"),
        F.sum((F.col("pos").cast(EXACT) * (2 * F.col("below") + F.col("neg"))).cast(EXACT)).alias("twice"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + above)).alias("gain"))
    base = 2.0 * F.col("positives") * F.col("negatives")
    return out.select("generator", "positives", "negatives", ratio(F.col("twice").cast("double"), base).alias("auroc"),
                      (F.col("gain") / F.col("positives")).alias("ap"))


def source_auc_fpr(df: DataFrame, scores: Sequence[str], source: str = "generator") -> DataFrame:
    """Per source and score column: AUROC where both classes exist, and the
    share of false alarms at .5 where every row is negative."""
    long = df.select(source, "label", F.explode(F.array(*[
        F.struct(F.lit(s).alias("branch"), F.col(s).alias("score")) for s in scores])).alias("b")).select(
        source, "label", "b.*")
    area = auroc(long, keys=[source, "branch"])
    alarms = long.groupBy(source, "branch").agg(
        F.count_if(F.col("score") >= 0.5).alias("alarms"), F.count(F.lit(1)).alias("n"))
    return area.join(alarms, [source, "branch"]).select(
        source, "branch", "n", "auroc",
        F.when(F.col("positives") == 0, F.col("alarms") / F.col("n")).alias("fpr"))


def calibration_rank(scores: DataFrame, reference: DataFrame, score: str = "score") -> DataFrame:
    """Share of reference scores at or below each score; both are ordered once."""
    marked = scores.withColumn("_ref", F.lit(0)).unionByName(
        reference.select(score).withColumn("_ref", F.lit(1)), allowMissingColumns=True)
    by_score = marked.groupBy(score).agg(F.sum("_ref").alias("n")).withColumn("band", score_bucket(F.col(score)))
    scanned = running_sums(by_score, [], "band", [F.col(score)], {"at_or_below": F.col("n")})
    total = reference.agg(F.count(F.lit(1)).alias("_total"))
    return scores.join(scanned.select(score, "at_or_below"), score).crossJoin(F.broadcast(total)).withColumn(
        "percentile", F.col("at_or_below") / F.col("_total")).drop("at_or_below", "_total")
