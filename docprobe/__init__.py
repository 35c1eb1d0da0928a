"""Document-tamper analytics on PySpark: boxes, verdicts, synthetic forgeries, evaluation."""
