"""Rows by their place: ids, limits, pairs, batches and shards that follow from the order of files or from a seed, and never from partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprobe.operators import batches, chat, evaluate, forge, predict, raster
from docprobe.operators import split as splits
from docprobe.operators.sampling import order_key
from docprobe.plans import score, views
from docprobe.plans.catalogue import _FORMS, _RECEIPTS, BOXES, NAMES, ORACLE, PAGES, TRUTH, _listed, _raw_forms, _raw_receipts, _table, query
from docprobe.plans.catalogue_files import LIMIT, SPECIAL, _report_records, _says
from docprobe.plans.catalogue_forge import _detection_sql, _rounded, _stub
from docprobe.plans.catalogue_pixels import THUMB, _by_files
from docprobe.sources import readers, sinks
from docprobe.sources.files import write_files
from docprobe.sources.ordinals import first_files
from docprobe.sources.scratch import fresh, stored


def _in_files(df: DataFrame, name: str, order: str, files: int, kind: str = "parquet", drop: bool = True) -> str:
    """The rows in ``order`` over some files whose names follow it; without the column itself if ``drop``."""
    path = fresh(df.sparkSession, name)
    dealt = df.repartitionByRange(files, order).sortWithinPartitions(order)
    (dealt.drop(order) if drop else dealt).write.format(kind).save(path)
    return path


# --- rows without a number of their own ---

_PLACES = f"pl AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM (SELECT DISTINCT doc_id FROM ({BOXES})))"


@query(f"WITH {_PLACES}, f AS ({_RECEIPTS}) SELECT f.* REPLACE ('sroie-train-' || k AS doc_id) FROM f JOIN pl ON f.doc_id = 'sroie-train-' || pl.doc_id")
def q_unnumbered_receipts(spark, sf):
    """Receipts without a stored number: ids from the rows' places in several files."""
    return _listed(readers.read_receipts(spark, _in_files(_raw_receipts(spark, sf), "receipts", "ordinal", 7)))


@query(f"WITH {_PLACES}, f AS ({_FORMS}) SELECT f.* REPLACE ('funsd-train-' || k AS doc_id) FROM f JOIN pl ON f.doc_id = 'funsd-train-' || pl.doc_id")
def q_unnumbered_forms(spark, sf):
    return _listed(readers.read_forms(spark, _in_files(_raw_forms(spark, sf), "forms", "ordinal", 5), names=NAMES))


@query(f"WITH {_PLACES}, f AS ({_RECEIPTS}) SELECT 'sroie-train-' || k AS doc_id, count(*) AS boxes, 1::BIGINT AS files FROM f JOIN pl ON f.doc_id = 'sroie-train-' || pl.doc_id WHERE k < {LIMIT} GROUP BY k")
def q_limit_opens_few_files(spark, sf):
    """The first rows of a source in 9 files, and how many of those the limit opens (the limit is the feature)."""
    path = _in_files(_raw_receipts(spark, sf), "receipts", "ordinal", 9)
    got = readers.read_receipts(spark, path, limit=LIMIT)
    own = path.rpartition("/")[2]
    opened = {f.rpartition("/")[2] for f in got.inputFiles() if f"/{own}/" in f}  # the plan also reads the files' places, a table of its own
    if opened != {f.rpartition("/")[2] for f in first_files(spark, path, LIMIT)}:
        raise AssertionError(f"files beyond the limit are read: {sorted(opened)}")
    return got.select("doc_id", F.size("ocr_boxes").cast("bigint").alias("boxes"), F.lit(len(opened)).cast("bigint").alias("files"))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS position, o_orderkey::VARCHAR AS doc_id, o_orderpriority AS source, o_orderkey % 2 = 0 AS tampered FROM orders")
def q_numbered_records(spark, sf):
    """JSON lines with blank lines between them: a record's number is its place among the records."""
    rows = _table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("doc_id"), F.col("o_orderpriority").alias("source"), (F.col("o_orderkey") % 2 == 0).alias("tampered"))
    text = rows.select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 3 == 0, "\n  \n").otherwise(""), F.to_json(F.struct("doc_id", "source", "tampered"))).alias("value"))
    return readers.read_numbered_records(spark, _in_files(text, "lines", "o_orderkey", 6, "text")).select("position", "doc_id", "source", "tampered")


@query(ORACLE["q_mcnemar"])
def q_mcnemar_by_position(spark, sf):
    """Two dumps of predictions in different numbers of files, paired line by line."""
    paths = []
    for says, files in (("says", 3), ("base_says", 8)):
        dump = evaluate.correct_detection(views.evaluation(spark, sf, says)).select("doc_id", "correct_det")
        paths.append(_in_files(dump, "dump", "doc_id", files, "json"))
    return _rounded(evaluate.mcnemar(evaluate.paired_dumps(spark, *paths)))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('3:shuffle:' || doc_id), doc_id) AS place FROM documents")
def q_shuffle(spark, sf):
    """The place of every document in a seeded order of the whole table."""
    docs = _table(spark, sf, "documents").select("doc_id")
    return splits.ranked(docs.withColumn("o", order_key(3, "shuffle", F.col("doc_id"))), "doc_id", "o", "place").drop("o")


# --- batches ---


def _batches_sql(rows: str, length: str, size: int = 8, pool: int = 64) -> str:
    """batch_of(doc_id, length, batch)."""
    return f"""bo AS (SELECT doc_id, {length} AS length, md5('0:batch:0:' || doc_id) AS o FROM {rows}),
bc AS (SELECT *, (row_number() OVER (ORDER BY o, doc_id) - 1) // {size * pool} AS chunk FROM bo),
batch_of AS (SELECT doc_id, length, chunk * {pool} + (row_number() OVER (PARTITION BY chunk ORDER BY coalesce(length, 0) DESC, o, doc_id) - 1) // {size} AS batch FROM bc)"""


@query(f"WITH {_batches_sql('documents', 'n_chars')} SELECT doc_id, batch, md5('0:turn:0:' || batch) AS turn FROM batch_of")
def q_batches(spark, sf):
    return batches.batched(_table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars").select("doc_id", "batch", "turn")


@query(f"""WITH {_batches_sql('documents', 'n_chars')}, e AS (SELECT 'batched' AS how, * FROM batch_of UNION ALL SELECT 'arrival', doc_id, n_chars, doc_id // 8 FROM documents),
s AS (SELECT how, batch, max(length) * count(*) - sum(length) AS padded, sum(length) AS tokens FROM e GROUP BY ALL) SELECT how, count(*) AS batches, sum(tokens)::BIGINT AS tokens, sum(padded)::BIGINT AS padded FROM s GROUP BY how""")
def q_batch_padding(spark, sf):
    """What padding adds if rows of like length share a batch, and if rows come as they are."""
    docs = _table(spark, sf, "documents").select("doc_id", "n_chars")
    sides = {"batched": batches.batched(docs, "doc_id", "n_chars"), "arrival": docs.withColumn("batch", F.floor(F.col("doc_id") / 8))}
    one, two = (batches.padding(df, "batch", "n_chars").select(F.lit(how).alias("how"), "*") for how, df in sides.items())
    return one.unionByName(two)


def _long_tokenizer():
    """Start, header, as many ids as a part's text asks for, end."""
    return lambda group: [[t for m in ms for t in (1, 3, *(i for p in m["content"] for i in [9 if p["type"] == "image" else 10] * (1 if p["type"] == "image" else 1 + len(p["text"]) % 13)), 2)] for ms in group]


_CONST = 9 + 1 + (1 + len(chat.SYSTEM_PROMPT) % 13) + (1 + len(chat.USER_INSTRUCTION) % 13)


@query(
    f"""WITH tg AS ({ORACLE['q_target_json']}), rl AS (SELECT doc_id, {_CONST} + 1 + length(target) % 13 AS real, 2 + length(target) % 13 AS learnable FROM tg), {_batches_sql('tg', 'length(target)')}
SELECT doc_id, batch, real::INT AS real, max(real) OVER (PARTITION BY batch)::INT AS width, learnable::INT AS learnable FROM rl JOIN batch_of USING (doc_id)"""
)
def q_collate_batches(spark, sf):
    """Batches by length of the target, padded to their longest row."""
    t = views.in_spark(spark, sf, views.TRUTH)
    box = F.when(F.col("x1").isNotNull(), F.array("x1", "y1", "x2", "y2"))
    t = t.select("doc_id", F.col("true_tampered").alias("tampered"), F.nullif("tamper_type", F.lit("")).alias("field"), box.alias("box_pixel"), "width", "height", F.concat(F.lit('say "'), "source", F.lit('"\nü')).alias("reason"), F.format_string("images/%d.jpg", "doc_id").alias("image_path"))
    said = F.get(F.element_at(chat.messages("/data"), 3)["content"], F.lit(0))["text"]
    dealt = batches.batched(t.withColumn("target_length", F.length(said)), "doc_id", "target_length")
    got = batches.collate_batches(dealt, _long_tokenizer, SPECIAL, build=chat.messages("/data"))
    return got.select("doc_id", "batch", F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).alias("real"), F.size("input_ids").alias("width"), "learnable")


# --- work that resumes ---


@query(f"SELECT doc_id, true_tampered, width % 3 = 0 AS pred_tampered, 1::BIGINT AS times FROM ({TRUTH})")
def q_resumed_predictions(spark, sf):
    """Predictions over two calls: the first does 5 jobs of 3 shards each, the second what is left. times: rows that any run has stored of a record."""
    t = views.in_spark(spark, sf, views.TRUTH).select(*views.truth_columns()).withColumnsRenamed({"true_tampered": "tampered", "true_box_pixel": "box_pixel"})
    path = fresh(spark, "predictions")
    predict.generate_resumable(t, _stub, path, "doc_id", shards=32, at_once=3, max_jobs=5)
    got = predict.generate_resumable(t, _stub, path, "doc_id", shards=32, at_once=3)
    times = spark.read.parquet(f"{path}/rows").groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"))
    return predict.collect_predictions(got).select("doc_id", "true_tampered", F.col("pred.tampered").alias("pred_tampered")).join(times, "doc_id")


# --- places on crowded pages, headers, overlays ---


@query(ORACLE["q_free_box"])
def q_free_places(spark, sf):
    """The places of q_free_box, found by cells of a grid on every page."""
    pages = stored(views.pages(spark, sf), "pages")
    planned = stored(forge.plan_copy_move(pages, crowded=0).select("doc_id", "copy_move.*"), "places").where("paste is not null")
    x, y = F.element_at("paste", 1), F.element_at("paste", 2)
    return planned.select("doc_id", x.alias("x1"), y.alias("y1"), (x + F.col("patch_w")).alias("x2"), (y + F.col("patch_h")).alias("y2"))


_SAVED = f"CASE WHEN greatest(width, height) > {THUMB} THEN greatest(1, round_even({{0}} * ({float(THUMB)!r}::DOUBLE / greatest(width, height)), 0)::INT) ELSE {{0}} END"


@query(
    f"""SELECT doc_id || CASE WHEN doc_id % 2 = 0 THEN '.png' ELSE '.jpg' END AS name, CASE WHEN doc_id % 2 = 0 THEN 'png' ELSE 'jpeg' END AS format,
 (CASE WHEN doc_id % 2 = 0 THEN {_SAVED.format('width')} ELSE width END)::INT AS width, (CASE WHEN doc_id % 2 = 0 THEN {_SAVED.format('height')} ELSE height END)::INT AS height FROM ({PAGES})"""
)
def q_image_sizes(spark, sf):
    """Sizes from the headers of files: pages drawn as PNG, and headers of JPEG files with a varying number of segments before the size."""
    folder = F.col("doc_id") % 61  # each is listed by a task of its own
    two = lambda c: F.lpad(F.hex(c), 4, "0")
    segment = F.concat(F.lit("FFE1"), two(F.lit(2) + F.col("doc_id") % 5), F.repeat(F.lit("FF"), (F.col("doc_id") % 5).cast("int")))
    frame = F.when(F.col("doc_id") % 3 == 0, F.lit("FFC2")).otherwise(F.lit("FFC0"))
    head = F.concat(F.lit("FFD8"), F.repeat(segment, (F.col("doc_id") % 4).cast("int")), F.repeat(F.lit("FF"), (F.col("doc_id") % 3).cast("int")), frame, F.lit("001108"), two("height"), two("width"), F.lit("03"), F.repeat(F.lit("00"), 9), F.lit("FFD9"))

    def made(p: DataFrame, path: str) -> None:
        drawn = raster.page_files(p.where("doc_id % 2 = 0"), F.format_string("%d/%d.png", folder, "doc_id"), THUMB)
        lines = p.where("doc_id % 2 <> 0").select(F.format_string("%d/%d.jpg", folder, "doc_id").alias("name"), F.unhex(head).alias("content"))
        write_files(drawn.unionByName(lines), path)

    return _by_files(spark, sf, made, lambda path: readers.read_header_sizes(spark, path).select(F.regexp_extract("name", r"([^/]+)$", 1).alias("name"), "format", "width", "height"))


@query(
    f"""WITH r AS ({ORACLE['q_corpus_sample']}), k AS (SELECT r.*, p.width, p.height, p.source AS page_source FROM r JOIN ({PAGES}) p USING (doc_id) WHERE tamper_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p.source, tamper_type ORDER BY doc_id) <= 2),
b AS (SELECT *, g1 - grow AS a, g2 - grow AS b, g3 + grow AS c, g4 + grow AS d FROM k, (VALUES (0), (1)) v(grow)),
e AS (SELECT doc_id, tamper_type, page_source, width, height, x, y FROM b, range(a, c + 1) s(x), (SELECT unnest([0, 1]) AS low) q, LATERAL (SELECT CASE WHEN low = 0 THEN b.b ELSE b.d END AS y)
 UNION ALL SELECT doc_id, tamper_type, page_source, width, height, x, y FROM b, range(b.b, d + 1) s(y), (SELECT unnest([0, 1]) AS low) q, LATERAL (SELECT CASE WHEN low = 0 THEN a ELSE c END AS x)),
u AS (SELECT DISTINCT * FROM e WHERE x >= 0 AND y >= 0 AND x < width AND y < height)
SELECT page_source AS source, tamper_type, doc_id, count(*) AS pixels, sum(31 * x + 17 * y)::BIGINT AS places FROM u GROUP BY ALL"""
)
def q_sample_overlays(spark, sf):
    """Two tampered samples of each source and operation (the number is the feature), and the pixels of the outline around their ground truth."""
    recs = stored(forge.corpus_sample(views.pages(spark, sf)), "sample")
    some = splits.first_per_group(recs.where("tampered"), 2, ["doc_id"], "source", "tamper_type")
    marks = raster.outline_pixels(some)
    return marks.groupBy("source", "tamper_type", "doc_id").agg(F.count(F.lit(1)).alias("pixels"), F.sum(31 * F.col("x") + 17 * F.col("y")).alias("places"))


@query(
    f"""WITH e AS (SELECT true_tampered, width % 3 = 0 AS flag, true AS parsed FROM ({TRUTH})), d AS ({_detection_sql('flag')})
SELECT printf('n=%d  P=%.3f [%.3f, %.3f]  R=%.3f [%.3f, %.3f]  F1=%.3f', n, precision, precision_lo, precision_hi, recall, recall_lo, recall_hi, f1) AS line FROM d"""
)
def q_summary_first_line(spark, sf):
    found = score.run(_report_records(spark, sf), _says(lambda w: w % 3 == 0))
    return spark.createDataFrame([(sinks.summary_lines(found)[0],)], "line string")
