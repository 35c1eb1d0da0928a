"""Counts of a built dataset, by split and in all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprobe.functions.stats import clean_fraction


def _counts(rows: DataFrame, key: Column, name: str) -> DataFrame:
    each = rows.where(key.isNotNull()).groupBy("split", key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("split").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias(name))  # a few types or sources a split


def manifest(rows: DataFrame, splits: Sequence[str] | None = None) -> DataFrame:
    """split, examples, docs, clean, tampered, clean_frac, by_tamper_type (tampered rows only), by_source.

    With ``splits`` each of them has a row, whether or not it has records.
    """
    plain = rows.groupBy("split").agg(F.count(F.lit(1)).alias("examples"), F.count_distinct("doc_id").alias("docs"), F.count_if(~F.col("tampered")).alias("clean"), F.count_if("tampered").alias("tampered"))
    types = _counts(rows, F.when(F.col("tampered"), F.col("tamper_type")), "by_tamper_type")
    got = plain.join(types, "split", "left").join(_counts(rows, F.col("source"), "by_source"), "split", "left")
    if splits is not None:
        got = rows.sparkSession.createDataFrame([(s,) for s in splits], "split string").join(got, "split", "left")
    zero, none = F.lit(0).cast("bigint"), F.create_map().cast("map<string,bigint>")
    return got.select("split", *(F.coalesce(c, zero).alias(c) for c in ("examples", "docs", "clean", "tampered")), F.coalesce(clean_fraction(F.col("clean"), F.col("examples")), F.lit(0.0)).alias("clean_frac"), *(F.coalesce(c, none).alias(c) for c in ("by_tamper_type", "by_source")))


def totals(rows: DataFrame) -> DataFrame:
    """split (null: all), examples, clean, tampered."""
    return rows.rollup("split").agg(F.count(F.lit(1)).alias("examples"), F.count_if(~F.col("tampered")).alias("clean"), F.count_if("tampered").alias("tampered"))


def as_dict(rows: DataFrame, splits: Sequence[str] | None = None) -> dict:
    """The manifest as it is written to a file."""
    out = {r["split"]: {k: v for k, v in r.asDict().items() if k != "split"} for r in manifest(rows, splits).collect()}
    return {"splits": out, "totals": {k: sum(s[k] for s in out.values()) for k in ("examples", "clean", "tampered")}}
