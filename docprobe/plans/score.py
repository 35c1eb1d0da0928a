"""Scores a test split: records, a predictor, an optional baseline, a report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprobe.operators.evaluate import report, slim
from docprobe.operators.predict import Predictor, collect_predictions, generate
from docprobe.sources.scratch import stored
from docprobe.sources.sinks import summary_lines, write_document


def evaluation_rows(records: DataFrame, make: Callable[[], Predictor], limit: int | None = None) -> DataFrame:
    """Records through a predictor, with ``variant`` as the second half of their key."""
    got = collect_predictions(generate(records, make), limit=limit)
    return got.withColumn("variant", F.coalesce("tamper_type", F.lit("clean")))


def run(records: DataFrame, make: Callable[[], Predictor], make_baseline: Callable[[], Predictor] | None = None, out_path: str | None = None, limit: int | None = None) -> dict:
    """The report as a dict; with a path also one JSON document of the report and both dumps of predictions, row by row.

    Each model runs once over the records: its rows are stored, and everything else reads them.
    """
    rows = stored(evaluation_rows(records, make, limit), "predictions")
    base = None if make_baseline is None else stored(evaluation_rows(records, make_baseline, limit), "baseline-predictions")
    found = report(rows, base).first().asDict(recursive=True)
    if out_path:
        write_document({"report": found, "predictions": slim(rows), "baseline_predictions": None if base is None else slim(base)}, out_path)
    for line in summary_lines(found):
        print(line)
    return found
