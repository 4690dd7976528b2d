"""Confusion counts, rates with intervals, and calibration metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import completed, is_negative, is_positive, truthy
from ..functions.stats import ratio, wilson_bounds

COUNTS = ("attempted", "completed", "errors", "source_groups", "tp", "fn", "fp", "tn",
          "abstained_ai", "abstained_non_ai", "high", "high_wrong")

# rate name -> (numerator, denominator) over the confusion columns
RATES = {
    "ai_recall": ("tp", "tp + fn + abstained_ai"),
    "false_positive_rate": ("fp", "fp + tn + abstained_non_ai"),
    "ai_detection_failure_rate": ("fn + abstained_ai", "tp + fn + abstained_ai"),
    "false_negative_rate": ("fn", "tp + fn + abstained_ai"),
    "false_negative_contamination": ("fn", "fn + tn"),
    "ai_precision": ("tp", "tp + fp"),
    "abstention_rate": ("abstained_ai + abstained_non_ai", "completed"),
    "coverage": ("completed - abstained_ai - abstained_non_ai", "completed"),
    "committed_accuracy": ("tp + tn", "tp + tn + fp + fn"),
    "high_confidence_error_rate": ("high_wrong", "high"),
    "completion_rate": ("completed", "attempted"),
}

SLICES = ("label", "generator", "split", "dataset", "transformation", "platform")


def outcome_flags(df: DataFrame) -> DataFrame:
    """0/1 columns whose sums are the confusion counts.

    An abstention on a positive is not a hit and an error is in no class.
    """
    done = completed(F.col("error"), F.col("decision"))
    pos, neg = is_positive(F.col("label")), is_negative(F.col("label"))
    said = F.col("decision")
    sure = done & (said != "abstain") & truthy(F.lower("confidence") == "high")
    flags = {
        "completed": done, "tp": done & pos & (said == "ai"), "fn": done & pos & (said == "not_ai"),
        "fp": done & neg & (said == "ai"), "tn": done & neg & (said == "not_ai"),
        "abstained_ai": done & pos & (said == "abstain"), "abstained_non_ai": done & neg & (said == "abstain"),
        "high": sure, "high_wrong": sure & ((pos & (said == "not_ai")) | (neg & (said == "ai"))),
    }
    return df.withColumns({f"is_{k}": truthy(v).cast("int") for k, v in flags.items()})


def confusion_aggs() -> list[Column]:
    sums = [F.coalesce(F.sum(f"is_{c}"), F.lit(0)).alias(c) for c in COUNTS
            if c not in ("attempted", "errors", "source_groups")]
    return [F.count(F.lit(1)).alias("attempted"),
            (F.count(F.lit(1)) - F.coalesce(F.sum("is_completed"), F.lit(0))).alias("errors"),
            F.count_distinct("group_id").alias("source_groups"), *sums]


def confusion(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    flagged = outcome_flags(df)
    grouped = flagged.groupBy(*keys) if keys else flagged
    return grouped.agg(*confusion_aggs()).select(*keys, *COUNTS)


def rates(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per rate with numerator, denominator, estimate and 95% interval."""
    listed = counts.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(name).alias("rate"), F.expr(top).cast("long").alias("numerator"),
                 F.expr(base).cast("long").alias("denominator"))
        for name, (top, base) in RATES.items()])).alias("r")).select(*keys, "r.*")
    low, high = wilson_bounds(F.col("numerator"), F.col("denominator"))
    return listed.withColumns({"estimate": ratio(F.col("numerator"), F.col("denominator")),
                               "low": low, "high": high})


def breakdown(df: DataFrame, slices: Sequence[str] = SLICES) -> DataFrame:
    """Confusion counts overall and by each slice column in one pass.

    Rows are summed per group and combination of slices before they are
    repeated for every slice.
    """
    names = [c for c in COUNTS if c not in ("attempted", "errors", "source_groups")]
    flagged = outcome_flags(df).select(
        "group_id", *[F.coalesce(F.col(s).cast("string"), F.lit("unknown")).alias(s) for s in slices],
        *[F.col(f"is_{c}").alias(c) for c in names])
    summed = flagged.groupBy("group_id", *slices).agg(F.count(F.lit(1)).alias("attempted"), *[F.sum(c).alias(c) for c in names])
    sets = [[F.col(s)] for s in slices] + [[]]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    grouped = summed.groupingSets(sets, *[F.col(s) for s in slices]).agg(
        *[total(c).alias(c) for c in ("attempted", *names)], (total("attempted") - total("completed")).alias("errors"),
        F.count_distinct("group_id").alias("source_groups"), *[F.grouping(s).alias(f"_g_{s}") for s in slices])
    which = F.lit("overall")
    value = F.lit("all")
    for s in slices:
        which = F.when(F.col(f"_g_{s}") == 0, F.lit(s)).otherwise(which)
        value = F.when(F.col(f"_g_{s}") == 0, F.col(s)).otherwise(value)
    return grouped.select(which.alias("slice"), value.alias("value"), *COUNTS)


def end_to_end(df: DataFrame) -> DataFrame:
    """Recall and correctness over every selected row; errors are failures."""
    done = completed(F.col("error"), F.col("decision"))
    pos = is_positive(F.col("label"))
    right = F.when(pos, F.col("decision") == "ai").otherwise(F.col("decision") == "not_ai")
    out = df.agg(
        F.count(F.lit(1)).alias("selected"), F.count_if(pos).alias("ai_selected"),
        F.count_if(pos & done & (F.col("decision") == "ai")).alias("ai_hits"),
        F.count_if(done & right).alias("correct"))
    return out.withColumns({
        "ai_recall": ratio(F.col("ai_hits"), F.col("ai_selected")),
        "correct_rate": ratio(F.col("correct"), F.col("selected"))})


EPS = 1e-8


def threshold_counts(score: Column, positive: Column, threshold: float | Column = 0.5) -> dict[str, Column]:
    hit = score >= threshold
    return {"tp": F.count_if(hit & positive), "fp": F.count_if(hit & ~positive),
            "fn": F.count_if(~hit & positive), "tn": F.count_if(~hit & ~positive)}


def threshold_rates() -> dict[str, Column]:
    """Guarded rates over tp, fp, fn, tn columns."""
    c = F.col
    precision = c("tp") / (c("tp") + c("fp") + EPS)
    recall = c("tp") / (c("tp") + c("fn") + EPS)
    return {"accuracy": ratio(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")),
            "precision": precision, "recall": recall,
            "f1": 2 * precision * recall / (precision + recall + EPS),
            "fpr": c("fp") / (c("fp") + c("tn") + EPS)}


def threshold_metrics(df: DataFrame, keys: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    pos = is_positive(F.col("label"))
    grouped = df.groupBy(*keys) if keys else df
    counts = grouped.agg(*[v.alias(k) for k, v in threshold_counts(F.col("score"), pos, threshold).items()])
    return counts.withColumns(threshold_rates())


def metrics_by_source(df: DataFrame, dims: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """``threshold_metrics`` for each value of each dimension, one grouping pass."""
    pos = is_positive(F.col("label"))
    counts = df.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(
        *[v.alias(k) for k, v in threshold_counts(F.col("score"), pos, threshold).items()],
        *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    which, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dims:
        which = F.when(F.col(f"_g_{d}") == 0, F.lit(d)).otherwise(which)
        value = F.when(F.col(f"_g_{d}") == 0, F.col(d)).otherwise(value)
    return counts.withColumns(threshold_rates()).select(
        which.alias("dimension"), value.alias("value"), "tp", "fp", "fn", "tn",
        "accuracy", "precision", "recall", "f1", "fpr")


def calibration_bins(df: DataFrame, prob: str, keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Counts and sums per half-open bin; a probability of exactly 1 is in none."""
    pos = is_positive(F.col("label")).cast("int")
    return (df.filter((F.col(prob) >= 0) & (F.col(prob) < 1))
              .groupBy(*keys, F.floor(F.col(prob) * bins).alias("bin"))
              .agg(F.count(F.lit(1)).alias("n"), F.sum(pos).alias("positives"), F.sum(prob).alias("prob_sum")))


def ece(df: DataFrame, prob: str = "score", keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Expected calibration error; rows outside every bin still count in n."""
    binned = calibration_bins(df, prob, keys, bins)
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")) if keys else df.agg(
        F.count(F.lit(1)).alias("rows"))
    gaps = binned.groupBy(*keys).agg(F.sum(F.abs(F.col("positives") - F.col("prob_sum"))).alias("gap")) \
        if keys else binned.agg(F.sum(F.abs(F.col("positives") - F.col("prob_sum"))).alias("gap"))
    joined = total.join(gaps, list(keys), "left") if keys else total.crossJoin(gaps)
    return joined.select(*keys, "rows", (F.coalesce("gap", F.lit(0.0)) / F.col("rows")).alias("ece"))


def temperature_grid(df: DataFrame, low: float, high: float, steps: int, score: str = "score") -> DataFrame:
    """ECE of sigmoid(logit / T) on an even grid of T.

    Rows are first reduced to counts per distinct score, so the grid multiplies
    score values and not rows.
    """
    pos = is_positive(F.col("label")).cast("int")
    clipped = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(score)))
    by_score = df.filter(F.col(score).isNotNull()).groupBy(F.log(clipped / (1 - clipped)).alias("logit")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(pos).alias("positives"))
    width = (high - low) / steps
    wide = by_score.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn(
        "t", F.lit(low) + F.col("k") * width).withColumn("p", 1 / (1 + F.exp(-F.col("logit") / F.col("t"))))
    bins = wide.groupBy("k", "t", F.floor(F.round(F.col("p") * 10, 9)).alias("bin")).agg(
        F.sum("n").alias("n"), F.sum("positives").alias("positives"), F.sum(F.col("p") * F.col("n")).alias("prob_sum"))
    return bins.groupBy("k", "t").agg(
        (F.sum(F.when(F.col("bin") < 10, F.abs(F.col("positives") - F.col("prob_sum"))).otherwise(0.0))
         / F.sum("n")).alias("ece"))


def temperature_fit(df: DataFrame, low: float = 0.1, high: float = 5.0, steps: int = 98, rounds: int = 2) -> DataFrame:
    """Best T by a grid that is refined ``rounds`` times around its minimum.

    Only the chosen grid point (one number) comes back between rounds.
    """
    lo, hi = low, high
    for _ in range(rounds):
        best = temperature_grid(df, lo, hi, steps).agg(F.min_by("t", F.struct("ece", "t")).alias("t")).first()["t"]
        if best is None:
            break
        width = (hi - lo) / steps
        lo, hi = max(low, best - width), min(high, best + width)
    grid = temperature_grid(df, lo, hi, steps)
    return grid.agg(F.min_by(F.struct("t", "ece"), F.struct("ece", "t")).alias("b")).select(
        F.col("b.t").alias("temperature"), F.col("b.ece").alias("ece"))


def uncertainty_sweep(df: DataFrame, min_rows: int = 50) -> DataFrame:
    """Every disagreement threshold 0.10, 0.12 .. 0.68 with its score and the best flag.

    A row with disagreement d counts at each threshold above d, so rows are
    first reduced to counts per threshold step and then accumulated.
    """
    pos = is_positive(F.col("label"))
    # first step whose threshold exceeds the disagreement, tested on exact step values
    first = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(29)),
                                 lambda k: F.col("disagreement") < (k * 2 + 10) / 100))
    per_step = df.withColumn("step", first).filter("step is not null").groupBy("step").agg(
        *[v.alias(k) for k, v in threshold_counts(F.col("score"), pos).items()])
    every = per_step.withColumn("k", F.explode(F.sequence(F.col("step"), F.lit(29)))).groupBy("k").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    scored = every.withColumns(threshold_rates()).filter(
        F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") >= min_rows).withColumn(
        "objective", (1 - F.col("fpr")) * 0.6 + F.col("f1") * 0.4)
    best = scored.agg(F.max_by("k", F.struct("objective", -F.col("k"))).alias("best_k"))
    return scored.crossJoin(F.broadcast(best)).select(
        ((F.col("k") * 2 + 10) / 100).alias("threshold"), "tp", "fp", "fn", "tn", "fpr", "f1", "objective",
        (F.col("k") == F.col("best_k")).alias("best"))


def flat_accuracy(df: DataFrame) -> DataFrame:
    """Two-class accuracy in percent, two decimals, and the mean of both classes."""
    right = F.col("correct").cast("int")
    real = F.col("label") == "real"
    sums = df.agg(
        F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(right), F.lit(0)).alias("correct"),
        F.count_if(real).alias("real_total"), F.count_if(real & F.col("correct")).alias("real_correct"),
        F.count_if(~real).alias("fake_total"), F.count_if(~real & F.col("correct")).alias("fake_correct"))
    return sums.withColumns({
        "overall_accuracy": percent(F.col("correct"), F.col("total")),
        "real_accuracy": percent(F.col("real_correct"), F.col("real_total")),
        "fake_accuracy": percent(F.col("fake_correct"), F.col("fake_total")),
    }).withColumn("acc_g", F.round((F.col("real_accuracy") + F.col("fake_accuracy")) / 2.0, 2))


def percent(top: Column, base: Column) -> Column:
    return F.round(F.coalesce(ratio(top * 100.0, base), F.lit(0.0)), 2)


def track_accuracy(df: DataFrame) -> DataFrame:
    """Accuracy by track and subcategory, by track, and overall, with the mean
    of a track's fake accuracy and the accuracy on ``id`` real clips."""
    right = F.col("correct").cast("int")
    fake = F.col("subcat") != "real"
    sums = df.rollup("track", "subcat").agg(
        F.count(F.lit(1)).alias("total"), F.sum(right).alias("correct"),
        F.count_if(fake).alias("fake_total"), F.count_if(fake & F.col("correct")).alias("fake_correct"),
        F.grouping("track").alias("_no_track"), F.grouping("subcat").alias("_no_subcat"))
    level = F.when(F.col("_no_track") == 1, "overall").when(F.col("_no_subcat") == 1, "track").otherwise("subcat")
    table = sums.select(level.alias("level"), "track", "subcat", "total", "correct",
                        percent(F.col("correct"), F.col("total")).alias("accuracy"),
                        F.when((F.col("_no_subcat") == 1) & (F.col("_no_track") == 0),
                               percent(F.col("fake_correct"), F.col("fake_total"))).alias("fake_accuracy"))
    real = df.filter((F.col("track") == "id") & (F.col("subcat") == "real")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(right).alias("k")).select(
        F.when(F.col("n") > 0, percent(F.col("k"), F.col("n"))).alias("id_real"))
    fake_shown = F.when(F.col("id_real").isNotNull(), F.col("fake_accuracy"))
    return table.crossJoin(F.broadcast(real)).select(
        "level", "track", "subcat", "total", "correct", "accuracy", fake_shown.alias("fake_accuracy"),
        F.when(F.col("track").isin("ood", "wild") & (F.col("level") == "track"),
               F.round((fake_shown + F.col("id_real")) / 2.0, 2)).alias("acc_g"))
