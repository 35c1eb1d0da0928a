"""Scores: detection over all rows, localisation over true positives, a paired comparison with a baseline.

Rows hold true_tampered, tamper_type, true_box_pixel, width, height and ``pred`` (a parsed prediction or null). Each report is one
aggregation over the rows: counts only cross the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docprobe.functions.geometry import iou, pixel_to_norm
from docprobe.functions.stats import mcnemar_p, ratio, wilson
from docprobe.sources.ordinals import paired_lines


def flagged(pred: Column) -> Column:
    """What the prediction says; an unparsable one says nothing, which counts as clean."""
    return F.coalesce(pred["tampered"], F.lit(False))


def correct_detection(df: DataFrame) -> DataFrame:
    return df.withColumn("correct_det", F.coalesce(F.col("true_tampered"), F.lit(False)) == flagged(F.col("pred")))


def with_iou(df: DataFrame, name: str = "iou") -> DataFrame:
    """Adds the IoU on the 0..1000 grid; null without a predicted box. The true box is a column of its own first, as every corner is read often."""
    got = df.withColumn("_gt", pixel_to_norm(F.col("true_box_pixel"), F.col("width"), F.col("height")))
    return got.withColumn(name, F.when(F.coalesce(F.size("pred.box_norm"), F.lit(0)) > 0, iou(F.col("pred.box_norm"), F.col("_gt")))).drop("_gt")


def _cells() -> list[Column]:
    yes, says = F.coalesce(F.col("true_tampered"), F.lit(False)), flagged(F.col("pred"))
    return [F.count(F.lit(1)).alias("n"), F.count_if(yes & says).alias("tp"), F.count_if(~yes & says).alias("fp"), F.count_if(yes & ~says).alias("fn"), F.count_if(~yes & ~says).alias("tn"), F.count_if(F.col("pred").isNull()).alias("parse_failures")]


CELLS = ("n", "tp", "fp", "fn", "tn", "parse_failures")


def _detected(c: DataFrame) -> DataFrame:
    """Rates from the counts in CELLS."""
    p, r = wilson(F.col("tp"), F.col("tp") + F.col("fp")), wilson(F.col("tp"), F.col("tp") + F.col("fn"))
    c = c.select("*", *(v.alias(f"{name}{end}") for name, got in (("precision", p), ("recall", r)) for v, end in zip(got, ("", "_lo", "_hi"))))
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)
    return c.select("*", f1.alias("f1"), ratio(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"), ratio(F.col("parse_failures"), F.col("n")).alias("parse_failure_rate"))


def detection(df: DataFrame, *by: str) -> DataFrame:
    """n, tp, fp, fn, tn, parse_failures, parse_failure_rate, precision and recall with intervals, f1, accuracy."""
    return _detected(df.groupBy(*by).agg(*_cells()))


def true_positives(df: DataFrame) -> DataFrame:
    """Rows that are tampered and flagged, with ``iou`` (0 where no box was given)."""
    return with_iou(df.where(F.col("true_tampered") & flagged(F.col("pred")))).withColumn("iou", F.coalesce("iou", F.lit(0.0)))


def _kind() -> Column:
    return F.coalesce(F.nullif("tamper_type", F.lit("")), F.lit("unknown"))


def localisation(df: DataFrame, threshold: float = 0.5, by_type: bool = False) -> DataFrame:
    """n_true_positive, mean_iou, hits, hit_rate with interval; with ``by_type`` a row for each tamper type, null and '' as unknown."""
    tp = true_positives(df)
    if by_type:
        tp = tp.withColumn("tamper_type", _kind())
    got = tp.groupBy(*(["tamper_type"] if by_type else [])).agg(F.count(F.lit(1)).alias("n_true_positive"), F.coalesce(F.avg("iou"), F.lit(0.0)).alias("mean_iou"), F.count_if(F.col("iou") >= threshold).alias("hits"))
    share, lo, hi = wilson(F.col("hits"), F.col("n_true_positive"))
    return got.select("*", share.alias("hit_rate"), lo.alias("hit_lo"), hi.alias("hit_hi"))


def paired(df: DataFrame, baseline: DataFrame, *keys: str) -> DataFrame:
    """keys, correct_a, correct_b of rows of both tables, matched by key; a row without a partner is an error."""
    a = correct_detection(df).select(*keys, F.col("correct_det").alias("correct_a"))
    b = correct_detection(baseline).select(*keys, F.col("correct_det").alias("correct_b"))
    left, right = a.alias("l"), b.alias("r")
    both = left.join(right, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "full_outer")
    lone = F.col("correct_a").isNull() | F.col("correct_b").isNull()
    guard = F.when(lone, F.raise_error(F.lit("mcnemar: rows without a partner")).cast("boolean")).otherwise(F.lit(True))
    return both.where(guard).select(*(F.col(f"l.{k}").alias(k) for k in keys), "correct_a", "correct_b")


def paired_dumps(spark: SparkSession, one: str, two: str, flag: str = "correct_det") -> DataFrame:
    """position, correct_a, correct_b of two dumps of JSON lines that list the same examples in the same order, matched by line.

    Dumps of unequal length are an error at once; a line without the flag is one when it is read.
    """
    read = lambda c: F.from_json(c, f"`{flag}` boolean")[flag]
    sure = lambda c: F.coalesce(read(c), F.raise_error(F.concat(F.lit(f"no {flag} in line: "), c)).cast("boolean"))
    return paired_lines(spark, one, two).select("position", sure(F.col("one")).alias("correct_a"), sure(F.col("two")).alias("correct_b"))


def mcnemar(pairs: DataFrame) -> DataFrame:
    """b, c, n_discordant (null if there are none), p_value of correct_a against correct_b."""
    got = pairs.agg(F.count_if(F.col("correct_a") & ~F.col("correct_b")).alias("b"), F.count_if(~F.col("correct_a") & F.col("correct_b")).alias("c"))
    return got.select("b", "c", F.nullif(F.col("b") + F.col("c"), F.lit(0)).alias("n_discordant"), mcnemar_p(F.col("b"), F.col("c")).alias("p_value"))


def report(df: DataFrame, baseline: DataFrame | None = None, keys: tuple[str, ...] = ("doc_id", "variant"), threshold: float = 0.5) -> DataFrame:
    """One row of structs: detection, localization, by_type (map), and with a baseline also baseline, mcnemar, delta."""

    def side(rows: DataFrame) -> DataFrame:
        """One pass: cells and overlaps by tamper type, added up."""
        hit = F.col("true_tampered") & flagged(F.col("pred"))
        iou = F.when(hit, F.coalesce("iou", F.lit(0.0)))
        by = with_iou(rows).withColumn("kind", _kind()).groupBy("kind").agg(*_cells(), F.count(iou).alias("n_hit"), F.sum(iou).alias("sum_iou"), F.count_if(iou >= threshold).alias("hits"))
        one = F.struct("kind", F.struct(F.col("n_hit").alias("n_true_positive"), (F.col("sum_iou") / F.col("n_hit")).alias("mean_iou"), ratio(F.col("hits"), F.col("n_hit")).alias("hit_rate")))
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*CELLS, "n_hit", "sum_iou", "hits")]
        whole = by.agg(*sums, F.map_from_entries(F.collect_list(F.when(F.col("n_hit") > 0, one))).alias("by_type"))
        got = _detected(whole.select(*CELLS, F.struct("n_hit", "sum_iou", "hits").alias("l"), "by_type"))
        share, lo, hi = wilson(F.col("l.hits"), F.col("l.n_hit"))
        local = F.struct(F.col("l.n_hit").alias("n_true_positive"), ratio(F.col("l.sum_iou"), F.col("l.n_hit")).alias("mean_iou"), F.col("l.hits").alias("hits"), share.alias("hit_rate"), lo.alias("hit_lo"), hi.alias("hit_hi"))
        return got.select(F.struct(*(c for c in got.columns if c not in ("l", "by_type"))).alias("detection"), local.alias("localization"), "by_type")

    out = side(df)
    if baseline is None:
        return out
    base = side(baseline)
    out = out.crossJoin(base.select(F.struct("detection", "localization").alias("baseline"))).crossJoin(mcnemar(paired(df, baseline, *keys)).select(F.struct("*").alias("mcnemar")))
    delta = F.struct((F.col("detection.f1") - F.col("baseline.detection.f1")).alias("f1"), (F.col("localization.hit_rate") - F.col("baseline.localization.hit_rate")).alias("hit_rate"))
    return out.withColumn("delta", delta)


def overfit_report(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """n, detected, n_boxes, mean_iou, hits. Unparsable rows are wrong; only correct tampered rows with a box count for IoU."""
    right = F.col("pred").isNotNull() & (F.col("pred.tampered") == F.col("true_tampered"))
    rows = with_iou(df).select(right.alias("right"), F.when(right & F.col("true_tampered"), F.col("iou")).alias("iou"))
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("right", F.lit(False))).alias("detected"), F.count("iou").alias("n_boxes"), F.coalesce(F.avg("iou"), F.lit(0.0)).alias("mean_iou"), F.count_if(F.col("iou") >= threshold).alias("hits"))
    return got


def slim(df: DataFrame) -> DataFrame:
    """The dump of predictions without bulky columns."""
    return df.select("doc_id", "tamper_type", "true_tampered", F.col("pred.tampered").alias("pred_tampered"), F.col("pred.box_norm").alias("pred_box_norm"))
