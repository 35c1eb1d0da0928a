"""Image files are on disk a share of the pages at a time, and shuffle files no longer than what they are for."""

import os
import time
import uuid

import numpy as np
import pytest

from docprobe.operators.pixels import png_bytes
from docprobe.plans import catalogue_order, catalogue_pixels
from docprobe.sources import readers
from docprobe.sources.scratch import stored

SF = "/root/testdata/sf0.001"


def files_below(path):
    return sum(name.endswith((".png", ".jpg")) for _, _, names in os.walk(path) for name in names)


@pytest.mark.parametrize("query", [catalogue_pixels.q_image_files, catalogue_order.q_image_sizes])
def test_files_of_a_round_go_before_the_next(spark, tmp_path, monkeypatch, query):
    want = sorted(map(tuple, query(spark, SF).collect()))
    most, keep = [], catalogue_pixels.delete_folder
    monkeypatch.setattr(catalogue_pixels, "fresh", lambda spark, name: f"{tmp_path}/{name}-{uuid.uuid4().hex}")
    monkeypatch.setattr(catalogue_pixels, "FILES_AT_ONCE", len(want) // 3)
    monkeypatch.setattr(catalogue_pixels, "delete_folder", lambda path: most.append(files_below(tmp_path)) or keep(path))
    got = query(spark, SF)
    left = files_below(tmp_path)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 1000
    assert len(most) == 3 and 0 < left < 0.4 * len(want) and max(most) < 0.4 * len(want) and not list(tmp_path.glob("pages-*"))


def test_sizes_of_files_that_tasks_list(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for i in range(20):
        (tmp_path / ("a/b" if i % 2 else "a") / f"{i}.png").write_bytes(png_bytes(np.zeros((2 + i, 3, 3), np.uint8)))
    got = {r.name: (r.format, r.width, r.height) for r in readers.read_header_sizes(spark, str(tmp_path)).collect()}
    assert got == {f"a/{'b/' if i % 2 else ''}{i}.png": ("png", 3, 2 + i) for i in range(20)}
    (tmp_path / "bad.png").write_bytes(b"no image")
    assert readers.read_header_sizes(spark, str(tmp_path), skip_invalid=True).count() == 20
    with pytest.raises(Exception, match="not an image: .*bad.png"):
        readers.read_header_sizes(spark, str(tmp_path)).collect()


def test_what_is_stored_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {b for b in disk.getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}
    before = shuffles()
    df = spark.range(20_000).repartition(7, "id")
    kept = stored(df, "shuffled")
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before and kept.count() == 20_000 and df.count() == 20_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")
