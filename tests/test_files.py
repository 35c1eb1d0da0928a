"""Files written by executors: all or none, whatever tasks fail, are retried or run twice."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docprobe.functions.headers import image_size
from docprobe.operators import pixels
from docprobe.plans.build import write_images
from docprobe.sources import readers
from docprobe.sources.files import FileTreeWriter, write_files


def rows(spark, n=40, parts=5):
    return spark.range(0, n, 1, parts).select(F.format_string("a%d/f%d.bin", F.col("id") % 3, "id").alias("name"), F.repeat(F.lit("x"), F.col("id").cast("int")).cast("binary").alias("content"))


def files(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in Path(folder).rglob("*") if p.is_file() and not p.name.endswith(".crc")}


WANT = {f"a{i % 3}/f{i}.bin": b"x" * i for i in range(40)}


def test_commit(spark, tmp_path):
    write_files(rows(spark), f"{tmp_path}/out")
    assert files(f"{tmp_path}/out") == WANT and [p.name for p in tmp_path.iterdir()] == ["out"]
    got = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{tmp_path}/out")
    assert got.agg(F.count(F.lit(1)), F.sum("length")).first() == (39, sum(range(40)))  # Spark passes over the empty file
    with pytest.raises(Exception, match="exists"):
        write_files(rows(spark), f"{tmp_path}/out")
    assert files(f"{tmp_path}/out") == WANT and [p.name for p in tmp_path.iterdir()] == ["out"]
    write_files(rows(spark, 2), f"file://{tmp_path}/out", overwrite=True)
    assert set(files(f"{tmp_path}/out")) == {"a0/f0.bin", "a1/f1.bin"}
    write_files(rows(spark, 0), f"{tmp_path}/none")
    assert files(f"{tmp_path}/none") == {} and (tmp_path / "none").is_dir()


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    bad = rows(spark).withColumn("name", F.when(F.col("name") == "a0/f39.bin", F.raise_error(F.lit("boo"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="boo"):
        write_files(bad, f"{tmp_path}/out")
    assert list(tmp_path.iterdir()) == []
    for name in ("../x", "/x", "", None, "a/../../x"):
        with pytest.raises(Exception, match="not a file's name"):
            write_files(spark.createDataFrame([(name, b"x")], "name string, content binary"), f"{tmp_path}/out")
    assert list(tmp_path.iterdir()) == []


def batches(ids, fails_at=None):
    for i in ids:
        if i == fails_at:
            raise OSError("the task is lost")
        yield pa.RecordBatch.from_pydict({"name": [f"a{i % 3}/f{i}.bin"], "content": pa.array([b"x" * i], pa.binary())})


def test_retries_and_twins_leave_one_copy(tmp_path):
    writer = FileTreeWriter(f"{tmp_path}/out", False)
    with pytest.raises(OSError):
        writer.write(batches(range(20), fails_at=12))
    done = [writer.write(batches(range(20))), writer.write(batches(range(20, 40))), writer.write(batches(range(20, 40)))]
    assert not (tmp_path / "out").exists() and done[0].files == 20
    writer.commit(done)
    assert files(tmp_path / "out") == WANT and [p.name for p in tmp_path.iterdir()] == ["out"]
    other = FileTreeWriter(f"{tmp_path}/other", False)
    other.write(batches(range(5)))
    other.abort([None])
    other.abort([None])
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_task_that_dies_half_way_is_retried(tmp_path):
    """In a session that retries tasks: every first attempt fails after it has sent some of its rows."""
    program = """
import sys
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import SparkSession
from docprobe.sources.files import write_files

def half(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            if k == 3 and TaskContext.get().attemptNumber() == 0:
                raise OSError("the task is lost")
            i = batch.column(0)[k].as_py()
            yield pa.RecordBatch.from_pydict({"name": [f"a{i % 3}/f{i}.bin"], "content": pa.array([b"x" * i], pa.binary())})

conf = {"spark.ui.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "2", "spark.task.maxFailures": "3"}
spark = SparkSession.builder.master("local[2,3]").config(map=conf).getOrCreate()
write_files(spark.range(0, 40, 1, 4).mapInArrow(lambda it: half([pa.Table.from_batches(it).combine_chunks().to_batches()[0]]), "name string, content binary"), sys.argv[1])
"""
    run = subprocess.run([sys.executable, "-c", program, f"{tmp_path}/out"], capture_output=True, text=True, timeout=180)
    assert run.returncode == 0, run.stderr[-2000:]
    assert "the task is lost" in run.stderr and files(tmp_path / "out") == WANT and [p.name for p in tmp_path.iterdir()] == ["out"]


def image_rows(spark, tmp_path, images):
    write_files(spark.createDataFrame([(f"{k}.png", pixels.png_bytes(v)) for k, v in images.items()], "name string, content binary"), f"{tmp_path}/in")
    return readers.read_images(spark, f"{tmp_path}/in").select(F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("doc_id"), "image")


PLAN = "op string, gt array<int>, field string, source_box array<int>, paste array<int>, patch_w int, patch_h int, angle double, alpha double, donor_idx bigint, patch_quality int, page_quality int"


def test_records_images_are_written_once(spark, tmp_path):
    rng = np.random.default_rng(4)
    images = {k: rng.integers(0, 255, (30, 40, 3), np.uint8) for k in ("p", "q")}
    plan = ("copy_move", [20, 10, 30, 18], "total", [2, 3, 12, 11], [20, 10], 10, 8, None, None, None, None, None)
    recs = [("images/train/p__clean.png", "p", None), ("images/train/p__copy_move.png", "p", plan), ("images/train/p__copy_move.png", "p", plan), ("images/val/q__clean.png", "q", None)]
    df = spark.createDataFrame(recs, f"image_path string, doc_id string, plan struct<{PLAN.replace(' ', ':').replace(',:', ',')}>").join(image_rows(spark, tmp_path, images), "doc_id")
    write_images(df, f"{tmp_path}/data", max_side=None)
    got = {r.path.rpartition("/data/")[2]: pixels.from_source(*(r.image[c] for c in ("height", "width", "nChannels", "data"))) for r in readers.read_images(spark, f"{tmp_path}/data/images/*/").collect()}
    assert set(got) == {r[0] for r in recs}
    assert (got["images/train/p__clean.png"] == images["p"]).all() and (got["images/val/q__clean.png"] == images["q"]).all()
    moved = got["images/train/p__copy_move.png"] != images["p"]
    assert (got["images/train/p__copy_move.png"][10:18, 20:30] == images["p"][3:11, 2:12]).all()
    moved[10:18, 20:30] = False
    assert not moved.any()


# --- headers ---


def jpeg(w, h, frame=0xC0, before=b"", fill=0):
    return b"\xff\xd8" + b"\xff\xe0\x00\x04ab" + before + b"\xff" * fill + bytes([0xFF, frame]) + b"\x00\x11\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x03" + b"\x01\x11\x00" * 3 + b"\xff\xd9"


def test_sizes_without_decoding(spark, tmp_path):
    images = {"a": np.zeros((3, 70, 3), np.uint8), "b": np.zeros((500, 2, 3), np.uint8)}
    decoded = {r.doc_id: (r.image["width"], r.image["height"]) for r in image_rows(spark, tmp_path, images).collect()}
    probed = readers.read_image_sizes(spark, f"{tmp_path}/in").collect()
    assert {Path(r.path).stem: (r.width, r.height) for r in probed} == decoded == {"a": (70, 3), "b": (2, 500)}
    segment = b"\xff\xe1\x00\x06\xff\xc0\x01\x02"  # holds what looks like a frame
    cases = [
        (jpeg(640, 480), ("jpeg", 640, 480)),
        (jpeg(9, 65535, 0xC2, segment * 20, 3), ("jpeg", 9, 65535)),
        (jpeg(5, 6, 0xCF, b"\xff\x01" + b"\xff\xc4\x00\x03z"), ("jpeg", 5, 6)),
        (jpeg(0, 6), (None, None, None)),
        (jpeg(640, 480)[:12], (None, None, None)),
        (jpeg(1, 1, 0xD8), (None, None, None)),
        (b"\xff\xd8\xff\xe0\x00\x00" + b"\x00" * 50, (None, None, None)),
        (b"\xff\xd8" + b"\xff" * 400, (None, None, None)),
        (pixels.png_bytes(images["a"])[:20], (None, None, None)),
        (b"\x89PNG\r\n\x1a\nxxxxyyyy" + b"\0\0\0\1" * 2, (None, None, None)),
        (b"", (None, None, None)),
        (b"GIF89a", (None, None, None)),
        (None, (None, None, None)),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c binary").select("i", image_size(F.col("c")).alias("s"))
    assert [tuple(r.s) for r in df.orderBy("i").collect()] == [want for _, want in cases]


def test_files_that_are_no_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(pixels.png_bytes(np.zeros((2, 3, 3), np.uint8)))
    (tmp_path / "b.png").write_bytes(b"broken")
    assert [(r.format, r.width, r.height) for r in readers.read_image_sizes(spark, str(tmp_path), skip_invalid=True).collect()] == [("png", 3, 2)]
    with pytest.raises(Exception, match="not an image"):
        readers.read_image_sizes(spark, str(tmp_path)).collect()
