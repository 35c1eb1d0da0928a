"""Free places by a grid are those that a scan of all boxes finds, and no place is a row."""

import numpy as np
from pyspark.sql import functions as F

from docprobe.operators import forge


def test_free_places_are_drawn_beside_the_grid(spark):
    rng = np.random.default_rng(4)
    kind = "array<struct<pos:int,text:string,box_pixel:array<int>,label:string,is_numeric:boolean>>"
    rows = []
    for i in range(60):
        n = int(rng.integers(0, 60))
        boxes = [(k, "t", [int(a) - 10, int(b) - 10, int(a + c), int(b + d)], "", False) for k, (a, b, c, d) in enumerate(zip(rng.integers(0, 290, n), rng.integers(0, 250, n), rng.integers(0, 140, n), rng.integers(0, 70, n)))]
        rows.append((i, 300, 260, boxes + boxes[:3], int(rng.integers(0, 305)) if i % 5 == 0 else 30, 20))
    pages = spark.createDataFrame(rows, f"doc_id bigint, width int, height int, ocr_boxes {kind}, patch_w int, patch_h int")
    for margin, tries in ((4, 60), (0, 3)):
        scan = forge.free_box(F.col("ocr_boxes"), F.col("width"), F.col("height"), F.col("patch_w"), F.col("patch_h"), 7, F.col("doc_id"), tries, margin)
        want = {r.doc_id: r.p for r in pages.select("doc_id", scan.alias("p")).collect() if r.p is not None}
        found = forge.free_places(pages, 7, tries, margin)
        assert {r.doc_id: r.place for r in found.collect()} == want and 5 < len(want) < 60
    plan = forge.free_places(pages, 7)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "LeftAnti" not in plan and plan.count("Exchange hashpartitioning") <= 2
