"""Builds a dataset: pages to split, forged, balanced, checked records, and its manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprobe.functions.codec import image_path, variant_tag
from docprobe.functions.validate import require_valid
from docprobe.operators import forge, pixels
from docprobe.operators.manifest import as_dict
from docprobe.operators.names import spare
from docprobe.operators.sampling import order_key
from docprobe.operators.split import SPLITS, assert_no_leakage, assign_splits, balance, group_docs
from docprobe.sources.files import write_files
from docprobe.sources.readers import RECORD
from docprobe.sources.scratch import stored
from docprobe.sources.sinks import write_json, write_records

DEFAULTS = {"seed": 0, "split_ratios": {"train": 0.7, "val": 0.15, "test": 0.15}, "n_tampered_variants": 2, "balance_train_5050": True, "image_format": "jpg"}


def build_records(pages: DataFrame, config: dict | None = None, checked: bool = True) -> DataFrame:
    """split and the ten record fields, and ``plan`` and ``copy``; train is balanced, val and test keep their shares.

    Images stay out of every shuffle: rows carry ids and coordinates. Forgeries are planned once and stored; counting and oversampling read the copy.
    """
    cfg = DEFAULTS | (config or {})
    light = pages.select("doc_id", "source", "width", "height", "ocr_boxes")
    dealt = group_docs(light, stored(assign_splits(light, cfg["split_ratios"], cfg["seed"]), "splits"))  # dealt once: donors and pages both read it
    pool = forge.harvest_donors(dealt)
    recs = forge.forge_variants(forge.with_donor_counts(dealt, pool), cfg["n_tampered_variants"], cfg["seed"], keep=["split"])
    recs = recs.withColumn("image_path", image_path(F.col("split"), F.col("doc_id"), variant_tag(F.col("tampered"), F.col("tamper_type")), cfg["image_format"]))
    recs = stored(require_valid(recs) if checked else recs, "records")
    assert_no_leakage(recs)
    if not cfg["balance_train_5050"]:
        return recs.withColumn("copy", F.lit(0).cast("bigint"))
    train = balance(recs.where("split = 'train'"), "image_path", seed=cfg["seed"])
    return train.unionByName(recs.where("split <> 'train'").withColumn("copy", F.lit(0).cast("bigint")))


def write_images(recs: DataFrame, out_dir: str, **how) -> None:
    """The image files that records name, under ``out_dir``, written by executors: all of them or, if a task fails for good, none.

    recs: image_path, plan, image and, for splices, donor_image (see ``pixels.rendered``, which takes ``how``). Copies of a record share its file, so one row a path is drawn.
    """
    write_files(pixels.rendered(recs.dropDuplicates(["image_path"]), **how), out_dir, "image_path")


def in_file_order(recs: DataFrame, seed: int = 0) -> DataFrame:
    """Split by split; train mixed by a seeded order, so that copies and classes do not lie together, the others by path."""
    (k,) = spare(recs, "_k")
    key = F.when(F.col("split") == "train", order_key(seed, "shuffle", F.col("image_path"), F.col("copy"))).otherwise("")
    return recs.withColumn(k, key).orderBy("split", k, "image_path", "copy").drop(k)


def build(pages: DataFrame, out_dir: str, config: dict | None = None, manifest_path: str | None = None) -> dict:
    """Writes JSON lines by split and returns the manifest, counted on what was written (after balancing)."""
    cfg = DEFAULTS | (config or {})
    recs = build_records(pages, cfg)
    write_records((in_file_order(recs, cfg["seed"]) if cfg["balance_train_5050"] else recs).drop("plan", "copy"), out_dir)
    found = as_dict(pages.sparkSession.read.schema(f"{RECORD}, split string").json(out_dir), SPLITS)
    if manifest_path:
        write_json(found, manifest_path)
    return found
