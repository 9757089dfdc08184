"""Quality of scored, labelled pairs: confusion counts, ranks, calibration and threshold searches.

Every operator reduces the rows to counts per score bucket first, so the searches work on tables whose size
is set by the grid and not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def ratio(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def _rates(tp: Column, fp: Column, tn: Column, fn: Column, *, empty_precision: float = 0.0) -> dict[str, Column]:
    precision, recall = ratio(tp, tp + fp, empty_precision), ratio(tp, tp + fn, 0.0)
    return {
        "precision": precision, "recall": recall, "f1": F.when(precision + recall > 0, 2.0 * precision * recall / (precision + recall)).otherwise(0.0),
        "accuracy": ratio(tp + tn, tp + fp + tn + fn, 0.0), "fpr": ratio(fp, fp + tn, 0.0),
    }


def _usable(scored: DataFrame) -> DataFrame:
    return scored.where("label in (0, 1) and score is not null and not isnan(score)")


def binary_metrics(scored: DataFrame, group: list[str], *, threshold: float, empty_precision: float = 0.0) -> DataFrame:
    """Confusion counts and rates per group at ``score >= threshold``; rows without label or score do not count.

    Precision without any positive prediction is ``empty_precision`` (0 for model metrics, 1 for benchmarks).
    """
    hit = F.col("score") >= threshold
    one = F.col("label") == 1
    counts = _usable(scored).groupBy(*group).agg(
        F.count("*").alias("examples"), F.count_if(hit & one).alias("tp"), F.count_if(hit & ~one).alias("fp"), F.count_if(~hit & ~one).alias("tn"), F.count_if(~hit & one).alias("fn")
    )
    rates = _rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")], empty_precision=empty_precision)
    return counts.select(*group, "examples", F.lit(threshold).alias("threshold"), "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(n) for n, c in rates.items()])


def roc_auc(scored: DataFrame, group: list[str], *, slices: int = 1024) -> DataFrame:
    """``(positives, negatives, auc)`` per group by average ranks of the exact scores; null where one class is missing.

    Scores are counted per value. Running sums go over slices of the scores first and inside each slice then, so a
    large group is never ordered in one task.
    """
    values = _usable(scored).groupBy(*group, "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    sliced = values.withColumn("_s", F.floor(F.col("score") * slices))
    earlier = lambda keys, order: W.Window.partitionBy(*keys).orderBy(order).rowsBetween(W.Window.unboundedPreceding, -1)
    per = sliced.groupBy(*group, "_s").agg(F.sum("n").alias("_n"))
    before = per.select(*group, "_s", F.coalesce(F.sum("_n").over(earlier(group, "_s")), F.lit(0)).alias("_before"))
    inside = sliced.withColumn("_below", F.coalesce(F.sum("n").over(earlier([*group, "_s"], "score")), F.lit(0)))
    wins = _join_null_safe(inside, before, [*group, "_s"]).withColumn("won", F.col("p") * (F.col("_before") + F.col("_below") + F.col("n") / 2.0))
    total = wins.groupBy(*group).agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum("won").alias("won"))
    pairs = F.col("positives") * F.col("negatives")
    return total.select(*group, "positives", "negatives", F.round(F.when(pairs > 0, F.col("won") / pairs), 6).alias("auc"))


def calibration_error(scored: DataFrame, group: list[str], *, bins: int = 10) -> DataFrame:
    """``(examples, ece)`` per group over equal bins, the last one closed; scores outside 0..1 count but fall in no bin."""
    inside = F.col("score").between(0.0, 1.0)
    rows = _usable(scored).withColumn("bin", F.when(inside, F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))))
    per_bin = rows.groupBy(*group, "bin").agg(F.count("*").alias("n"), F.avg("score").alias("conf"), F.avg(F.col("label").cast("double")).alias("acc"))
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("acc") - F.col("conf"))).otherwise(0.0)
    return per_bin.groupBy(*group).agg(F.sum("n").alias("examples"), F.sum(gap).alias("gap")).select(*group, "examples", F.round(F.col("gap") / F.col("examples"), 6).alias("ece"))


def class_weights(pairs: DataFrame, group: list[str]) -> DataFrame:
    """``(negative_weight, positive_weight)`` = rows / (2 * rows of the class); 1 and 1 where a class is missing."""
    counts = pairs.where("label in (0, 1)").groupBy(*group).agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("p"))
    both = (F.col("p") > 0) & (F.col("p") < F.col("n"))
    weight = lambda c: F.round(F.when(both, F.col("n") / (2.0 * c)).otherwise(1.0), 6)
    return counts.select(*group, weight(F.col("n") - F.col("p")).alias("negative_weight"), weight(F.col("p")).alias("positive_weight"))


def label_summary(pairs: DataFrame, group: list[str]) -> DataFrame:
    return pairs.groupBy(*group).agg(F.count("*").alias("rows"), F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))


def _steps_passed(score: Column, lowest: float, step: float, count: int) -> Column:
    """How many thresholds ``lowest + i * step`` a score reaches; both are rounded so that ties agree everywhere."""
    return F.greatest(F.lit(0), F.least(F.lit(count), F.floor(F.round((score - lowest) / step, 6)) + 1)).cast("int")


def _grid(spark, count: int, name: str) -> DataFrame:
    return spark.range(count).select(F.col("id").cast("int").alias(name))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be null; the keys come from the left."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    conditions = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, conditions, "left").drop(*[f"_r_{k}" for k in keys])


def threshold_sweep(scored: DataFrame, group: list[str], *, lowest: float = 0.0, step: float = 0.01, count: int = 101) -> DataFrame:
    """Confusion counts and rates per group at each of ``count`` thresholds.

    Rows are counted per number of thresholds they pass; suffix sums of the counts give all thresholds at once.
    """
    rows = _usable(scored).withColumn("passed", _steps_passed(F.col("score"), lowest, step, count))
    counts = rows.groupBy(*group, "passed").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    totals = counts.groupBy(*group).agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    steps = totals.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    passed = _join_null_safe(steps, counts.withColumn("at", F.col("passed") - 1).drop("passed"), [*group, "at"]).fillna(0, ["p", "n"])
    above = W.Window.partitionBy(*group).orderBy(F.desc("at")).rowsBetween(W.Window.unboundedPreceding, 0)
    summed = passed.withColumn("tp", F.sum("p").over(above)).withColumn("fp", F.sum("n").over(above))
    full = summed.withColumn("fn", F.col("_p") - F.col("tp")).withColumn("tn", F.col("_n") - F.col("fp"))
    rates = _rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])
    return full.select(*group, F.round(F.lit(lowest) + F.col("at") * step, 6).alias("threshold"), "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(n) for n, c in rates.items()])


def best_precision(sweep: DataFrame, group: list[str], *, target_recall: float) -> DataFrame:
    """Row of a sweep with the highest precision among those with enough recall, ties by recall; else the highest recall."""
    enough = F.when(F.col("recall") >= target_recall - 1e-9, 1).otherwise(0)
    order = W.Window.partitionBy(*group).orderBy(F.desc(enough), F.desc(F.when(enough == 1, F.col("precision"))), F.desc("recall"), F.desc("precision"), "threshold")
    return sweep.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def grid_search(scored: DataFrame, group: list[str], *, first: tuple[float, float, int], second: tuple[float, float, int], fpr_limits: dict[str, float], limit_key: str) -> DataFrame:
    """Best pair of thresholds per group: highest f1, then precision, then lowest false positive rate, then the lowest thresholds.

    ``scored`` has label, classifier_score and cross_encoder_score; a row is a hit if both reach their threshold.
    ``first`` and ``second`` are ``(lowest, step, count)``. A group named in ``fpr_limits`` (by ``limit_key``) only
    takes pairs below its limit. Rows are reduced to counts per cell of the grid before any search.
    """
    t1, t2 = first, second
    spark = scored.sparkSession
    rows = scored.where("label in (0, 1) and classifier_score is not null and cross_encoder_score is not null")
    cells = rows.groupBy(*group, _steps_passed(F.col("classifier_score"), *t1).alias("a"), _steps_passed(F.col("cross_encoder_score"), *t2).alias("b")).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    totals = cells.groupBy(*group).agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    seen = cells.where("a > 0 and b > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("a") - 1)))
    by_row = seen.groupBy(*group, "i", "b").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    summed = by_row.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b") - 1))).groupBy(*group, "i", "j").agg(F.sum("p").alias("tp"), F.sum("n").alias("fp"))
    grid = F.broadcast(_grid(spark, t1[2], "i").join(_grid(spark, t2[2], "j"), F.lit(True)))
    every = totals.join(grid, F.lit(True))
    joined = _join_null_safe(every, summed, [*group, "i", "j"]).fillna(0, ["tp", "fp"])
    full = joined.withColumn("fn", F.col("_p") - F.col("tp")).withColumn("tn", F.col("_n") - F.col("fp"))
    rates = {n: F.round(c, 6) for n, c in _rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")], empty_precision=1.0).items()}
    rated = full.select(*group, "i", "j", "tp", "fp", "tn", "fn", *[c.alias(n) for n, c in rates.items()])
    limit = F.lit(None).cast("double")
    for name, value in fpr_limits.items():
        limit = F.when(F.col(limit_key) == name, F.lit(value)).otherwise(limit)
    allowed = rated.where(limit.isNull() | (F.col("fpr") < limit))
    order = W.Window.partitionBy(*group).orderBy(F.desc("f1"), F.desc("precision"), "fpr", "i", "j")
    best = allowed.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    at = lambda t, c: F.round(F.lit(t[0]) + F.col(c) * t[1], 6)
    return best.select(*group, at(t1, "i").alias("classifier_threshold"), at(t2, "j").alias("cross_threshold"), "tp", "fp", "tn", "fn", "precision", "recall", "f1", "fpr")


def blocked_false_positives(scored: DataFrame, group: list[str], *, cosine_threshold: float, classifier_threshold: float) -> DataFrame:
    """False positives of the cosine alone and of the classifier, and those the classifier blocks."""
    negative = F.col("label") == 0
    cosine, model = F.col("similarity_score") >= cosine_threshold, F.col("classifier_score") >= classifier_threshold
    return scored.where("label in (0, 1)").groupBy(*group).agg(
        F.count_if(negative).alias("negatives"), F.count_if(negative & cosine).alias("cosine_fp"), F.count_if(negative & model).alias("classifier_fp"), F.count_if(negative & cosine & ~F.coalesce(model, F.lit(False))).alias("blocked")
    )


def stage_report(decided: DataFrame, group: list[str]) -> DataFrame:
    """Hits, bypassed hits and bypass rate per group of decided queries."""
    hit = F.col("decision") == "hit"
    counts = decided.groupBy(*group).agg(F.count("*").alias("lookups"), F.count_if(hit).alias("hits"), F.count_if(F.col("reason") == "mlp_bypass").alias("bypassed"))
    return counts.withColumn("bypass_rate", F.round(ratio(F.col("bypassed"), F.col("hits"), 0.0), 6))


#: The ways of deciding that are compared: cosine alone, classifier, both scorers, and the whole ladder (an own decision).
METHODS = ("cosine", "classifier", "double", "full")


def method_decisions(decided: DataFrame, *, cosine: float = 0.90, classifier: float = 0.85, double: tuple[float, float] = (0.95, 0.90)) -> DataFrame:
    """Each decided row once per method, with ``method`` and ``hit``; a missing score never reaches a threshold."""
    reaches = lambda name, t: F.coalesce(F.col(name) >= t, F.lit(False))
    hits = {"cosine": reaches("similarity_score", cosine), "classifier": reaches("classifier_score", classifier), "double": reaches("classifier_score", double[0]) & reaches("cross_encoder_score", double[1]), "full": F.col("decision") == "hit"}
    sides = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), hits[m].alias("hit")) for m in METHODS]))
    return decided.withColumn("_m", sides).select(*decided.columns, "_m.method", "_m.hit")


def comparison_matrix(decided: DataFrame, group: list[str], **thresholds) -> DataFrame:
    """Confusion counts and rates of every method per group, on labelled rows; precision without hits is 1."""
    one, hit = F.col("label") == 1, F.col("hit")
    rows = method_decisions(decided.where("label in (0, 1)"), **thresholds)
    counts = rows.groupBy(*group, "method").agg(F.count("*").alias("examples"), F.count_if(hit & one).alias("tp"), F.count_if(hit & ~one).alias("fp"), F.count_if(~hit & ~one).alias("tn"), F.count_if(~hit & one).alias("fn"))
    rates = _rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")], empty_precision=1.0)
    return counts.select(*group, "method", "examples", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(n) for n, c in rates.items()])


def scenario_summary(scored: DataFrame, group: list[str], *, thresholds: list[float]) -> DataFrame:
    """The cosine baseline as scenarios: per group and threshold the hits, wrong hits, missed reuse and the share of right decisions."""
    steps = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    rows = scored.where("label in (0, 1)").withColumn("threshold", steps)
    hit, one = F.coalesce(F.col("similarity_score") >= F.col("threshold"), F.lit(False)), F.col("label") == 1
    return rows.groupBy(*group, "threshold").agg(F.count("*").alias("cases"), F.count_if(hit).alias("hits"), F.count_if(hit & ~one).alias("wrong_hits"), F.count_if(~hit & one).alias("missed_reuse"), F.round(F.avg(F.when(hit == one, 1.0).otherwise(0.0)), 6).alias("right_share"))


def expectation_report(decided: DataFrame, group: list[str]) -> DataFrame:
    """Drift report of decisions with an ``expected`` one: safety, reuse and both kinds of errors, in per cent."""
    expected_hit, hit = F.col("expected") == "hit", F.col("decision") == "hit"
    c = decided.where("expected in ('hit', 'miss')").groupBy(*group).agg(
        F.count_if(~expected_hit).alias("must_miss"), F.count_if(expected_hit).alias("must_hit"), F.count_if(~expected_hit & ~hit).alias("blocked"), F.count_if(expected_hit & hit).alias("reused")
    )
    pct = lambda part, whole: F.when(F.col(whole) > 0, F.round(100.0 * part / F.col(whole), 1)).otherwise(0.0)
    wrong, missed = F.col("must_miss") - F.col("blocked"), F.col("must_hit") - F.col("reused")
    return c.select(*group, "must_miss", "must_hit", pct(F.col("blocked"), "must_miss").alias("safety_pct"), pct(F.col("reused"), "must_hit").alias("reuse_pct"), wrong.alias("dangerous_hits"), pct(wrong, "must_miss").alias("dangerous_pct"), missed.alias("missed_reuse"), pct(missed, "must_hit").alias("missed_pct"))
