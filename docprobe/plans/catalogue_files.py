"""Scans, sinks and extension points as queries: what is written to the shared folder is read back and held against SQL."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docprobe.functions.geometry import box_height, box_width, clamp_box
from docprobe.operators import chat, forge, ingest, pixels, predict
from docprobe.operators import manifest as manifests
from docprobe.operators import split as splits
from docprobe.plans import score, views
from docprobe.plans.catalogue import _FORMS, _M, _RECEIPTS, BOXES, NAMES, ORACLE, TRUTH, _flat, _listed, _manifest_rows, _raw_forms, _raw_receipts, _table, query
from docprobe.plans.catalogue_forge import _B, _CLAMPED, _POOL_ALL, _SPLICE_ALL, MOVE, _pool_pages
from docprobe.sources import readers, sinks
from docprobe.sources.scratch import fresh

LIMIT = 40


def _written(df: DataFrame, name: str) -> str:
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return path


# --- scans ---


@query(_RECEIPTS)
def q_scan_receipts(spark, sf):
    return _listed(readers.read_receipts(spark, _written(_raw_receipts(spark, sf), "receipts")))


@query(_FORMS)
def q_scan_forms(spark, sf):
    return _listed(readers.read_forms(spark, _written(_raw_forms(spark, sf), "forms"), names=NAMES))


def _paths(spark, sf):
    return {"sroie": _written(_raw_receipts(spark, sf), "receipts"), "funsd": _written(_raw_forms(spark, sf), "forms")}


_FIRST = f"(SELECT DISTINCT doc_id FROM ({BOXES}) ORDER BY doc_id LIMIT {LIMIT})"


def _boxes_of(rows: str, source: str, where: str = "") -> str:
    return f"SELECT '{source}' AS source, doc_id, count(*) AS boxes FROM ({rows}) {where} GROUP BY doc_id"


_OF_FIRST = f"WHERE split_part(doc_id, '-', 3)::BIGINT IN {_FIRST}"


@query(f"{_boxes_of(_RECEIPTS, 'sroie', _OF_FIRST)} UNION ALL {_boxes_of(_FORMS, 'funsd', _OF_FIRST)}")
def q_read_sources(spark, sf):
    """Both sources, each with its own limit (that is the feature), from files."""
    got = readers.read_sources(spark, _paths(spark, sf), limit_per_source=LIMIT, names=NAMES)
    return got.where(F.size("ocr_boxes") > 0).select("source", "doc_id", F.size("ocr_boxes").cast("bigint").alias("boxes"))


@query(f"{_boxes_of(_RECEIPTS.replace('sroie-', 'slips-'), 'slips')} UNION ALL {_boxes_of(_FORMS, 'funsd')}")
def q_loader_registry(spark, sf):
    """A source that the caller's own loader reads, beside a known one."""
    paths = _paths(spark, sf)

    def read_slips(spark: SparkSession, path: str, split: str, limit: int | None, names: list[str] | None) -> DataFrame:
        return ingest.normalise_receipts(spark.read.parquet(path), "slips", split)

    got = readers.read_sources(spark, paths | {"slips": paths["sroie"]}, ("slips", "funsd"), names=NAMES, loaders=readers.LOADERS | {"slips": read_slips})
    return got.where(F.size("ocr_boxes") > 0).select("source", "doc_id", F.size("ocr_boxes").cast("bigint").alias("boxes"))


@query("SELECT o_orderkey::VARCHAR AS doc_id, o_orderpriority AS source, o_orderkey % 2 = 0 AS tampered, NULL::INT AS width FROM orders")
def q_jsonl_blank_lines(spark, sf):
    """Blank lines between records, fields that are not there, and a split that does not exist."""
    rows = _table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.col("o_orderpriority").alias("source"), (F.col("o_orderkey") % 2 == 0).alias("tampered"))
    out = fresh(spark, "lines")
    rows.select(F.concat(F.lit("\n  \n"), F.to_json(F.struct("*")), F.when(F.col("tampered"), "\n").otherwise("")).alias("value")).write.text(f"{out}/train")
    return readers.read_records(spark, f"{out}/train", f"{out}/val").select("doc_id", "source", "tampered", "width")


_CONFIG = {"seed": 7, "split_ratios": {"train": 0.7, "val": 0.15, "test": 0.15}, "sources": ["sroie", "funsd"], "image": {"format": "jpg", "max_side": 1024}, "balance_train_5050": True}


def _leaves(value: object, name: str = "") -> list[tuple[str, str]]:
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else None
    return [(name, json.dumps(value))] if items is None else [x for k, v in items for x in _leaves(v, f"{name}.{k}" if name else str(k))]


def _yaml(value: dict, indent: int = 0) -> str:
    out = ""
    for k, v in value.items():
        out += " " * indent + f"{k}:" + (f"\n{_yaml(v, indent + 2)}" if isinstance(v, dict) else f" {json.dumps(v)}\n")
    return out


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _leaves(_CONFIG)) + ") t(name, value)")
def q_config(spark, sf):
    """A configuration as YAML (as JSON where PyYAML is not installed), read back."""
    try:
        import yaml  # noqa: F401

        text = "# a comment\n" + _yaml(_CONFIG)
    except ImportError:
        text = json.dumps(_CONFIG)
    with tempfile.TemporaryDirectory() as folder:  # the driver's own file
        path = os.path.join(folder, "data.yaml")
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        got = readers.load_config(path)
    return spark.createDataFrame(_leaves(got), "name string, value string")


@query("SELECT n_name AS name, 'part-' || n_nationkey AS folder, NULL::VARCHAR AS nothing FROM nation")
def q_locate_root(spark, sf):
    """A data root at some depth: one for each nation, found by its record file."""
    nations = _table(spark, sf, "nation").select("n_nationkey", "n_name").collect()  # 25 rows
    out = fresh(spark, "roots")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for r in nations:
        deep = jvm.org.apache.hadoop.fs.Path(f"{out}/{r['n_nationkey']}/{'x/' * (r['n_nationkey'] % 3)}part-{r['n_nationkey']}/train.jsonl")
        deep.getFileSystem(conf).create(deep).close()
        found = readers.locate(spark, f"{out}/{r['n_nationkey']}")
        rows.append((r["n_name"], found.rstrip("/").rpartition("/")[2], readers.locate(spark, f"{out}/{r['n_nationkey']}", "val.jsonl")))
    return spark.createDataFrame(rows, "name string, folder string, nothing string")


@query("SELECT n_nationkey AS k, (20 + n_nationkey)::INT AS width, (30 + 2 * n_nationkey)::INT AS height, printf('%02X%02X%02X', (3 * n_nationkey)::INT, (2 * n_nationkey)::INT, n_nationkey::INT) AS pixel FROM nation")
def q_image_scan(spark, sf):
    """PNG files, one a nation, decoded by the image source: size, and the first pixel (blue, green, red)."""
    import numpy as np

    out = fresh(spark, "images")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for (k,) in _table(spark, sf, "nation").select("n_nationkey").collect():  # 25 rows
        image = np.broadcast_to(np.array([k, 2 * k, 3 * k], np.uint8), (30 + 2 * k, 20 + k, 3))
        path = jvm.org.apache.hadoop.fs.Path(f"{out}/{k}.png")
        file = path.getFileSystem(conf).create(path)
        file.write(bytearray(pixels.png_bytes(np.ascontiguousarray(image))))
        file.close()
    got = readers.read_images(spark, out)
    return got.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("int").alias("k"), "width", "height", F.hex(F.substring("image.data", 1, 3)).alias("pixel"))


# --- sinks ---


@query("SELECT o_orderkey, CASE WHEN greatest(w, h) > 1024 THEN greatest(1, round_even(w * (1024.0::DOUBLE / greatest(w, h)), 0)::INT) ELSE w END AS sw, CASE WHEN greatest(w, h) > 1024 THEN greatest(1, round_even(h * (1024.0::DOUBLE / greatest(w, h)), 0)::INT) ELSE h END AS sh FROM (SELECT o_orderkey, (1 + o_orderkey * 37 % 4000)::INT AS w, (1 + o_orderkey * 53 % 3000)::INT AS h FROM orders)")
def q_saved_size(spark, sf):
    o = _table(spark, sf, "orders").select("o_orderkey", (1 + F.col("o_orderkey") * 37 % 4000).cast("int").alias("w"), (1 + F.col("o_orderkey") * 53 % 3000).cast("int").alias("h"))
    w, h = sinks.saved_size(F.col("w"), F.col("h"))
    return o.select("o_orderkey", w.alias("sw"), h.alias("sh"))


@query("SELECT n_nationkey AS k, (2 * (10 + n_nationkey) + 2 * (5 + n_nationkey) + 2 * (12 + n_nationkey) + 2 * (7 + n_nationkey))::BIGINT AS green FROM nation")
def q_overlay(spark, sf):
    """Pixels of the outline around a box on a black page: the rectangle and the one around it."""
    import numpy as np

    def run(batches):
        for rows in batches:
            counts = [int((pixels.outlined(np.zeros((100, 100, 3), np.uint8), [20, 20, 30 + k, 25 + k]) == pixels.GREEN).all(-1).sum()) for k in rows["k"]]
            yield rows.assign(green=counts)

    return _table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).mapInPandas(run, "k bigint, green bigint").withColumn("k", F.col("k").cast("int"))


@query(f"{_M} SELECT split, count(*) AS examples, count(DISTINCT doc_id) AS docs, count(*) FILTER (NOT tampered) AS clean, round_even(count(*) FILTER (NOT tampered) / count(*), 3) AS clean_frac, count(*) FILTER (tamper_type = 'splice') AS splices FROM r GROUP BY split")
def q_manifest_file(spark, sf):
    """The manifest as a JSON file of the driver, read back."""
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "deep", "manifest.json")
        sinks.write_json(manifests.as_dict(_manifest_rows(spark, sf), splits.SPLITS), path)
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
    rows = [(s, m["examples"], m["docs"], m["clean"], m["clean_frac"], m["by_tamper_type"].get("splice", 0)) for s, m in got["splits"].items()]
    return spark.createDataFrame(rows, "split string, examples bigint, docs bigint, clean bigint, clean_frac double, splices bigint")


def _says(rule):
    """Makes a predictor from a rule on a row's width."""
    return lambda: lambda rows: rows["width"].map(lambda w: '{"tampered": %s, "field": null, "box": null, "reason": "w"}' % ("true" if rule(w) else "false"))


def _report_records(spark, sf):
    t = views.in_spark(spark, sf, views.TRUTH).select(*views.truth_columns())
    return t.withColumnsRenamed({"true_tampered": "tampered", "true_box_pixel": "box_pixel"}).withColumn("doc_id", F.col("doc_id").cast("string"))


def _said_sql(flag: str) -> str:
    return f"count(*) FILTER (true_tampered AND {flag}) AS tp, count(*) FILTER (NOT true_tampered AND {flag}) AS fp"


@query(
    f"""SELECT 'predictions' AS part, count(*) AS n, sum(doc_id)::BIGINT AS ids, {_said_sql('width % 3 = 0')} FROM ({TRUTH}) UNION ALL SELECT 'baseline_predictions', count(*), sum(doc_id)::BIGINT, {_said_sql('width % 4 = 0')} FROM ({TRUTH})
 UNION ALL SELECT 'report', count(*), NULL, {_said_sql('width % 3 = 0')} FROM ({TRUTH})"""
)
def q_report_file(spark, sf):
    """The report with both dumps of predictions in one JSON document, read back."""
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "eval", "report.json")
        score.run(_report_records(spark, sf), _says(lambda w: w % 3 == 0), _says(lambda w: w % 4 == 0), out_path=path)
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
    out = []
    for part in ("predictions", "baseline_predictions"):
        rows = got[part]
        out.append((part, len(rows), sum(int(r["doc_id"]) for r in rows), sum(r["true_tampered"] and r["pred_tampered"] for r in rows), sum(not r["true_tampered"] and r["pred_tampered"] for r in rows)))
    d = got["report"]["detection"]
    return spark.createDataFrame([*out, ("report", d["n"], None, d["tp"], d["fp"])], "part string, n bigint, ids bigint, tp bigint, fp bigint")


@query(f"SELECT 'parse failures: 0 (0.0%)' AS line UNION ALL SELECT printf('IoU hit rate 0.000 over %d true positives, mean IoU 0.000', count(*) FILTER (true_tampered AND width % 3 = 0)) FROM ({TRUTH})")
def q_summary_lines(spark, sf):
    """What a run prints, without its first line, whose figures q_detection has."""
    found = score.run(_report_records(spark, sf), _says(lambda w: w % 3 == 0))
    return spark.createDataFrame([(line,) for line in sinks.summary_lines(found)[1:]], "line string")


@query(f"SELECT doc_id::VARCHAR AS doc_id, true_tampered, width % 3 = 0 AS pred_tampered FROM ({TRUTH}) ORDER BY doc_id::VARCHAR LIMIT {LIMIT}")
def q_predictions_limit(spark, sf):
    """The first predictions by id: the limit is the feature."""
    got = predict.collect_predictions(predict.generate(_report_records(spark, sf), _says(lambda w: w % 3 == 0)), limit=LIMIT)
    return got.select("doc_id", "true_tampered", F.col("pred.tampered").alias("pred_tampered"))


# --- extension points ---


@query(f"WITH {_B}, {_POOL_ALL}, {MOVE}, {_SPLICE_ALL}, al AS (SELECT doc_id, 'copy_move' AS op, g1, g2, g3, g4, field FROM mv UNION ALL SELECT doc_id, 'splice', g1, g2, g3, g4, field FROM sp) SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY md5('0:order:' || doc_id || ':' || op)) = 1")
def q_forge_ops_override(spark, sf):
    """Two of the operations instead of the default three; the tampered record of each page."""
    p, pool = _pool_pages(spark, sf)
    got = forge.forge_variants(forge.with_donor_counts(p, pool, split=None), 1, ops=("copy_move", "splice"))
    return got.where("tampered").select("doc_id", F.col("tamper_type").alias("op"), *_flat("box_pixel", "g1", "g2", "g3", "g4"), "field")


def _plan_blackout(pages: DataFrame, seed: int = 0, out: str = "blackout") -> DataFrame:
    """An operation of the caller's own: the first box is painted over."""
    box = F.element_at("ocr_boxes", 1)["box_pixel"]
    made = forge._plan("blackout", clamp_box(box, F.col("width"), F.col("height")), F.lit("first"), source_box=box, paste=F.slice(box, 1, 2), patch_w=box_width(box), patch_h=box_height(box))
    return pages.withColumn(out, F.when(forge.has_boxes(3), made))


BLACKOUT = forge.ForgeryOp("blackout", _plan_blackout, lambda: forge.has_boxes(3))


@query(f"WITH {_B}, first AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM b), {_POOL_ALL}, {_SPLICE_ALL} SELECT doc_id, 'blackout' AS op, {_CLAMPED.format('')}, 'first' AS field FROM first WHERE pos = 1 AND n >= 3 UNION ALL SELECT doc_id, 'splice', g1, g2, g3, g4, field FROM sp")
def q_forge_own_op(spark, sf):
    """An operation that the caller brings, beside a known one."""
    p, pool = _pool_pages(spark, sf)
    got = forge.forge_variants(forge.with_donor_counts(p, pool, split=None), 2, ops=(BLACKOUT, "splice"))
    return got.where("tampered").select("doc_id", F.col("tamper_type").alias("op"), *_flat("box_pixel", "g1", "g2", "g3", "g4"), "field")


@query(f"WITH {_B}, c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM b WHERE x2 - x1 >= 6 AND y2 - y1 >= 6 AND label = 'date') SELECT doc_id, pos FROM c WHERE k = ('0x' || substr(md5('3:dated:' || doc_id), 1, 8))::BIGINT % n")
def q_pick_predicate(spark, sf):
    """A pick among boxes that a caller's predicate allows."""
    p = views.pages(spark, sf).withColumn("c", forge.candidates(F.col("ocr_boxes"), lambda b: b["label"] == "date"))
    return p.select("doc_id", forge.pick(F.col("c"), 3, "dated", F.col("doc_id"))["pos"].alias("pos")).where("pos is not null")


SPECIAL = chat.Special(start=1, end=2, pad=0, image=9, header=1)


def _tokenizer():
    """Start, header, an id for each part of a turn (by a text's length, or the image's), end."""
    return lambda batch: [[t for m in ms for t in (1, 3, *(9 if p["type"] == "image" else 10 + len(p["text"]) % 50 for p in m["content"]), 2)] for ms in batch]


@query(f"SELECT doc_id, 13::BIGINT AS real, 2 AS learnable, false AS truncated, (10 + length(target) % 50)::INT AS first_label, {10 + len(chat.SYSTEM_PROMPT) % 50} AS system_id FROM ({ORACLE['q_target_json']})")
def q_collate(spark, sf):
    """A message builder and a tokenizer given to the collator."""
    t = views.in_spark(spark, sf, views.TRUTH)
    box = F.when(F.col("x1").isNotNull(), F.array("x1", "y1", "x2", "y2"))
    t = t.select("doc_id", F.col("true_tampered").alias("tampered"), F.nullif("tamper_type", F.lit("")).alias("field"), box.alias("box_pixel"), "width", "height", F.concat(F.lit('say "'), "source", F.lit('"\nü')).alias("reason"), F.format_string("images/%d.jpg", "doc_id").alias("image_path"))
    got = chat.collate(t, _tokenizer, SPECIAL, build=chat.messages("/data"))
    return got.select("doc_id", F.size(F.filter("attention_mask", lambda x: x == 1)).cast("bigint").alias("real"), "learnable", "truncated", F.get(F.filter("labels", lambda x: x != chat.IGNORED), F.lit(0)).alias("first_label"), F.get("input_ids", F.lit(2)).alias("system_id"))
