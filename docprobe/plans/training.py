"""Rows for training: clean copies dropped again, or a small mixed subset for a smoke run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docprobe.operators.split import keep_first_clean, round_robin
from docprobe.sources.readers import read_records


def load_splits(spark: SparkSession, data_root: str, order: str, overfit: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(train, val). ``order`` is a unique column that stands for the rows' order."""
    train, val = (read_records(spark, f"{data_root}/split={s}") for s in ("train", "val"))
    if overfit:
        return round_robin(train, overfit, order), None
    return keep_first_clean(train, order), val
