"""Every operator as a query over the driver's tables, and the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docprobe.functions import codec, geometry, stats
from docprobe.functions.validate import violations
from docprobe.operators import chat, evaluate, forge, ingest, predict
from docprobe.operators import manifest as manifests
from docprobe.operators import split as splits
from docprobe.operators.sampling import order_key
from docprobe.plans import views
from docprobe.plans.views import in_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

BOXES, PAGES, SAID, TRUTH, COMPLETIONS = (in_sql(v) for v in (views.BOXES, views.PAGES, views.SAID, views.TRUTH, views.COMPLETIONS))
RATIOS = {"train": 0.7, "val": 0.15, "test": 0.15}
NAMES = ["O", "B-CLICK", "I-CLICK", "B-VIEW", "I-VIEW", "HEADER-x-Y"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _flat(box: str, *names: str) -> list:
    return [F.element_at(box, i + 1).alias(n) for i, n in enumerate(names or ("x1", "y1", "x2", "y2"))]


KEY = "doc_id, pos"


# --- geometry ---


@query(f"SELECT {KEY}, greatest(10, least(200, x1)) AS x, greatest(0.0, least(1.0, y1 / 100.0)) AS y FROM ({BOXES})")
def q_clamp_scalar(spark, sf):
    return views.boxes(spark, sf).select("doc_id", "pos", geometry.clamp(F.col("x1"), 10, 200).alias("x"), geometry.clamp(F.col("y1") / 100.0, 0.0, 1.0).alias("y"))


def _norm_sql(c: str, w: str, top: str = "1000") -> str:
    return f"CAST(round_even(greatest(0.0, least(1000.0, {c}::DOUBLE / {w} * 1000)), 0) AS INT)"


@query(f"SELECT {KEY}, {', '.join(f'{_norm_sql(c, w)} AS {n}' for c, w, n in (('x1', 'width', 'n1'), ('y1', 'height', 'n2'), ('x2', 'width', 'n3'), ('y2', 'height', 'n4')))} FROM ({BOXES})")
def q_pixel_to_norm(spark, sf):
    got = views.boxes(spark, sf).withColumn("n", geometry.pixel_to_norm(F.col("box"), F.col("width"), F.col("height")))
    return got.select("doc_id", "pos", *_flat("n", "n1", "n2", "n3", "n4"))


@query(f"SELECT {KEY}, {', '.join(f'CAST(round_even(greatest(0.0, least({w}::DOUBLE, {c}::DOUBLE / 1000 * {w})), 0) AS INT) AS p{i}' for i, (c, w) in enumerate((('x1', 'width'), ('y1', 'height'), ('x2', 'width'), ('y2', 'height')), 1))} FROM ({BOXES})")
def q_norm_to_pixel(spark, sf):
    got = views.boxes(spark, sf).withColumn("p", geometry.norm_to_pixel(F.col("box"), F.col("width"), F.col("height")))
    return got.select("doc_id", "pos", *_flat("p", "p1", "p2", "p3", "p4"))


def _iou_sql(a: str, b: str) -> str:
    w = f"(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
    h = f"(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    area = lambda t: f"({t}.x2 - {t}.x1) * ({t}.y2 - {t}.y1)"
    return f"CASE WHEN {w} <= 0 OR {h} <= 0 THEN 0.0 ELSE ({w} * {h})::DOUBLE / ({area(a)} + {area(b)} - {w} * {h}) END"


@query(f"WITH b AS ({BOXES}) SELECT a.doc_id, a.pos, c.pos AS other, round({_iou_sql('a', 'c')}, 9) AS iou FROM b a JOIN b c ON a.doc_id = c.doc_id AND c.pos = a.pos + 1")
def q_iou(spark, sf):
    b = views.boxes(spark, sf).select("doc_id", "pos", "box")
    c = b.select("doc_id", F.col("pos").alias("other"), (F.col("pos") - 1).alias("pos"), F.col("box").alias("box2"))
    return b.join(c, ["doc_id", "pos"]).select("doc_id", "pos", "other", F.round(geometry.iou(F.col("box"), F.array(*(F.element_at("box2", i) for i in (3, 4, 1, 2)))), 9).alias("iou"))


@query(f"SELECT {KEY}, CAST(round_even(x1 + 0.5, 0) AS INT) AS x1, CAST(round_even(y1 - 0.5, 0) AS INT) AS y1, CAST(round_even(x2 + 0.5, 0) AS INT) AS x2, CAST(round_even(y2 + 1.5, 0) AS INT) AS y2 FROM ({BOXES})")
def q_quad_to_bbox(spark, sf):
    p = lambda x, y: F.array((F.col(x) + 0.5).cast("double"), y)
    quad = F.array(p("x2", F.col("y1") + 0.5), p("x1", F.col("y1") - 0.5), p("x1", F.col("y2") + 1.5), p("x2", F.col("y2") + 0.5))
    return views.boxes(spark, sf).select("doc_id", "pos", geometry.quad_to_bbox(quad).alias("b")).select("doc_id", "pos", *_flat("b"))


_SIDES = (("x1", "width"), ("y1", "height"), ("x2", "width"), ("y2", "height"))


@query(f"SELECT {KEY}, {', '.join(f'CAST(greatest(0, least({w}, round_even({c} * 2.25::DOUBLE - 100.5, 0))) AS INT) AS {c}' for c, w in _SIDES)}, x2 > 100 AND x1 < 200 AND y2 > 100 AND y1 < 300 AS hits FROM ({BOXES})")
def q_clamp_overlap(spark, sf):
    """Corners in quarters of a pixel: half of them round to even."""
    b = views.boxes(spark, sf).select("doc_id", "pos", "box", geometry.clamp_box(F.transform("box", lambda v: v * F.lit(2.25) - 100.5), F.col("width"), F.col("height")).alias("c"))
    return b.select("doc_id", "pos", *_flat("c"), geometry.overlap(F.col("box"), F.array(*map(F.lit, (100, 100, 200, 300)))).alias("hits"))


@query(f"SELECT {KEY}, x2 - 20 - x1 AS w, y2 - 10 - y1 AS h FROM ({BOXES}) WHERE x2 - 20 > x1 AND y2 - 10 > y1")
def q_box_area_filter(spark, sf):
    b = views.boxes(spark, sf).withColumn("s", F.array("x1", "y1", F.col("x2") - 20, F.col("y2") - 10))
    return b.where(geometry.has_area(F.col("s"))).select("doc_id", "pos", geometry.box_width(F.col("s")).alias("w"), geometry.box_height(F.col("s")).alias("h"))


@query(f"WITH b AS ({BOXES}) SELECT a.doc_id, a.pos, count(*) AS others, count(*) FILTER (a.x2 > c.x1 AND c.x2 > a.x1 AND a.y2 > c.y1 AND c.y2 > a.y1) AS hits FROM b a JOIN b c ON a.doc_id = c.doc_id AND a.pos <> c.pos GROUP BY ALL")
def q_box_pairs(spark, sf):
    p = views.pages(spark, sf).select("doc_id", "ocr_boxes", F.explode("ocr_boxes").alias("a"))
    others = F.filter("ocr_boxes", lambda o: o["pos"] != F.col("a.pos"))
    return p.select("doc_id", F.col("a.pos").alias("pos"), F.size(others).cast("bigint").alias("others"), F.size(F.filter(others, lambda o: geometry.overlap(F.col("a.box_pixel"), o["box_pixel"]))).cast("bigint").alias("hits")).where("others > 0")


# --- text ---


@query(f"SELECT {KEY}, '<|box_start|>(' || x1 || ',' || y1 || '),(' || x2 || ',' || y2 || ')<|box_end|>' AS t, x1::BIGINT AS x1, y1::BIGINT AS y1, x2::BIGINT AS x2, y2::BIGINT AS y2, CASE WHEN pos % 3 = 0 THEN x1::BIGINT END AS loose FROM ({BOXES})")
def q_format_parse_box(spark, sf):
    b = views.boxes(spark, sf).withColumn("t", codec.format_box(F.col("box")))
    loose = F.when(F.col("pos") % 3 == 0, F.format_string("at ( %d , %d ) , (%d,%d) and (1,2),(3,4)", "x1", "y1", "x2", "y2")).otherwise(F.format_string("[%d,%d,%d,%d]", "x1", "y1", "x2", "y2"))
    b = b.withColumn("p", codec.parse_box(F.col("t"))).withColumn("q", codec.parse_box(loose))
    return b.select("doc_id", "pos", "t", *_flat("p"), F.element_at("q", 1).alias("loose"))


REASON_LIST = ", ".join("'" + r.replace("'", "''") + "'" for r in codec.CLEAN_REASONS)


def _reason_sql(key: str) -> str:
    return f"([{REASON_LIST}])[CAST(('0x' || md5({key}))::UHUGEINT % 12 AS INT) + 1]"


@query(f"SELECT doc_id, {_reason_sql(chr(39) + 'img' + chr(39) + ' || doc_id')} AS reason, {_reason_sql(chr(39) * 2)} AS none FROM documents")
def q_clean_reason(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", codec.clean_reason(F.concat(F.lit("img"), F.col("doc_id").cast("string"))).alias("reason"), codec.clean_reason(F.lit(None).cast("string")).alias("none"))


def _json_text(c: str) -> str:
    return f"coalesce(to_json({c})::VARCHAR, 'null')"


_BOX_SQL = "'<|box_start|>(' || " + " || ',' || ".join((_norm_sql("x1", "width"), _norm_sql("y1", "height"))) + " || '),(' || " + " || ',' || ".join((_norm_sql("x2", "width"), _norm_sql("y2", "height"))) + " || ')<|box_end|>'"


@query(
    f"""SELECT doc_id, CASE WHEN true_tampered THEN '{{"tampered": true, "field": ' || {_json_text('nullif(tamper_type, ' + chr(39) * 2 + ')')} || ', "box": "' || {_BOX_SQL} || '", "reason": ' || {_json_text("'say ' || chr(34) || source || chr(34) || chr(10) || 'ü'")} || '}}'
 ELSE '{{"tampered": false, "field": null, "box": null, "reason": "' || {_reason_sql("'images/' || doc_id || '.jpg'")} || '"}}' END AS target FROM ({TRUTH})"""
)
def q_target_json(spark, sf):
    t = views.in_spark(spark, sf, views.TRUTH)
    box = F.when(F.col("x1").isNotNull(), F.array("x1", "y1", "x2", "y2"))
    reason = F.concat(F.lit('say "'), "source", F.lit('"\nü'))
    return t.select("doc_id", codec.target_json(F.col("true_tampered"), F.nullif("tamper_type", F.lit("")), box, F.col("width"), F.col("height"), reason, F.format_string("images/%d.jpg", "doc_id")).alias("target"))


@query(f"SELECT doc_id, CASE WHEN shape = 2 OR shape = 6 THEN NULL WHEN shape IN (0, 1) OR shape > 6 THEN good ELSE completion END AS object FROM ({COMPLETIONS})")
def q_extract_object(spark, sf):
    return views.in_spark(spark, sf, views.COMPLETIONS).select("doc_id", codec.first_json_object(F.col("completion")).alias("object"))


_PARSED = "CASE WHEN shape IN (2, 3, 4, 6) THEN NULL WHEN shape = 5 THEN true ELSE says END"


@query(
    f"""WITH c AS ({COMPLETIONS}), p AS (SELECT *, {_PARSED} AS t, shape <> 5 AND says AS boxed FROM c)
SELECT doc_id, t IS NULL AS failed, t AS tampered, CASE WHEN t THEN 'total' END AS field, CASE WHEN t AND boxed THEN bx1::BIGINT END AS x1, CASE WHEN t AND boxed THEN by1::BIGINT END AS y1, CASE WHEN t AND boxed THEN bx2::BIGINT END AS x2, CASE WHEN t AND boxed THEN by2::BIGINT END AS y2,
 CASE WHEN shape = 5 OR t IS NULL THEN NULL WHEN t THEN 'edges {{differ}}' ELSE 'fine' END AS reason FROM p"""
)
def q_parse_prediction(spark, sf):
    c = views.in_spark(spark, sf, views.COMPLETIONS).select("doc_id", codec.parse_prediction(F.col("completion")).alias("p"))
    return c.select("doc_id", F.col("p").isNull().alias("failed"), "p.tampered", "p.field", *_flat("p.box_norm"), "p.reason")


@query(f"SELECT {KEY}, regexp_matches(text, '\\p{{Nd}}') AS numeric_text FROM ({BOXES})")
def q_is_numeric(spark, sf):
    return views.boxes(spark, sf).select("doc_id", "pos", F.col("is_numeric").alias("numeric_text"))


@query("SELECT doc_id, regexp_matches(coalesce(text, ''), '\\p{Nd}') AS numeric_text FROM documents")
def q_is_numeric_documents(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", codec.is_numeric(F.col("text")).alias("numeric_text"))


_TAG = "CASE p_partkey % 5 WHEN 0 THEN 'B-' || p_type WHEN 1 THEN 'I-' || p_type || '-X' WHEN 2 THEN 'O' WHEN 3 THEN '' ELSE p_type END"


@query(f"SELECT p_partkey, CASE WHEN {_TAG} IN ('', 'O') THEN 'other' ELSE lower(regexp_replace({_TAG}, '^[^-]*-', '')) END AS label FROM part")
def q_strip_bio(spark, sf):
    return _table(spark, sf, "part").select("p_partkey", codec.strip_bio(F.expr(_TAG)).alias("label"))


@query(f"SELECT {KEY}, coalesce(nullif(label, ''), 'field') AS field FROM ({BOXES})")
def q_label_field(spark, sf):
    return views.boxes(spark, sf).select("doc_id", "pos", codec.label_to_field(F.col("label")).alias("field"))


#: crc32 (reflected, polynomial 0xEDB88320), its table made by shifting each byte eight times.
_CRC = """WITH t AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b, range(0, 8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)
SELECT doc_id, xor(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295::BIGINT), 7) AS seed FROM documents, t"""


@query(_CRC)
def q_doc_seed(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", codec.doc_seed(F.col("doc_id"), 7).alias("seed"))


@query(
    f"""WITH t AS (SELECT *, CASE WHEN true_tampered THEN coalesce(nullif(tamper_type, ''), 'splice') ELSE 'clean' END AS tag FROM ({TRUTH}))
SELECT doc_id, tag, 'images/test/' || doc_id || '__' || tag || '.jpg' AS image_path, 'file:///data/processed/images/test/' || doc_id || '__' || tag || '.jpg' AS uri,
 CASE tag WHEN 'digit_swap' THEN 'The total field appears altered: a digit was overwritten and its stroke weight and edges differ from the surrounding characters.' WHEN 'copy_move' THEN 'The total region shows copy-move tampering; a duplicated patch with matching texture was pasted into otherwise empty space.'
 WHEN 'splice' THEN 'The total field was spliced from another document; font and lighting differ from the surrounding text at the region edges.' END AS reason FROM t"""
)
def q_record_fields(spark, sf):
    t = views.in_spark(spark, sf, views.TRUTH)
    kind = F.when(F.col("true_tampered"), F.coalesce(F.nullif("tamper_type", F.lit("")), F.lit("splice")))
    t = t.withColumn("tag", codec.variant_tag(F.col("true_tampered"), kind))
    t = t.withColumn("image_path", codec.image_path(F.lit("test"), F.col("doc_id"), F.col("tag"), "jpeg"))
    return t.select("doc_id", "tag", "image_path", codec.image_uri(F.col("image_path"), "/data/x/../processed").alias("uri"), codec.reason_for(F.col("tag"), F.lit("total")).alias("reason"))


# --- records ---

_FAULTS = """SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'images/' || doc_id END AS image_path, CASE WHEN doc_id % 8 = 0 THEN 0 ELSE width END AS width, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE height END AS height,
 CASE WHEN doc_id % 41 = 0 THEN NULL ELSE pos % 2 = 0 END AS tampered, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE label END AS field, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'splice' END AS tamper_type,
 x1, y1, CASE WHEN doc_id % 6 = 0 THEN x1 - 1 ELSE x2 END AS x2, y2, doc_id % 10 = 0 AS no_box, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 'r' END AS reason, pos FROM boxes"""
_CODES = [
    ("image_path", "image_path = ''"),
    ("width", "width <= 0"),
    ("height", "height IS NULL"),
    ("tampered", "tampered IS NULL"),
    ("reason", "reason IS NULL"),
    ("box", "tampered AND no_box"),
    ("box_order", "tampered AND NOT no_box AND (x2 <= x1 OR y2 <= y1)"),
    ("field", "tampered AND coalesce(field, '') = ''"),
    ("tamper_type", "tampered AND tamper_type IS NULL"),
    ("clean_field", "NOT tampered AND field IS NOT NULL"),
    ("clean_tamper_type", "NOT tampered AND tamper_type IS NOT NULL"),
    ("clean_box", "NOT tampered AND NOT no_box"),
]


@query(f"WITH boxes AS ({BOXES}), f AS ({_FAULTS}) SELECT doc_id, pos, concat_ws(',', {', '.join(f'CASE WHEN {c} THEN {chr(39)}{n}{chr(39)} END' for n, c in _CODES)}) AS codes FROM f")
def q_validate(spark, sf):
    views.in_spark(spark, sf, views.BOXES).createOrReplaceTempView("docprobe_boxes")
    f = spark.sql(_FAULTS.replace("FROM boxes", "FROM docprobe_boxes"))
    f = f.withColumn("box_pixel", F.when(~F.col("no_box"), F.array("x1", "y1", "x2", "y2")))
    return f.select("doc_id", "pos", F.array_join(violations(f), ",").alias("codes"))


def _raw_receipts(spark, sf):
    b = views.boxes(spark, sf)
    p = lambda x, y: F.array(F.col(x).cast("double"), F.col(y).cast("double"))
    x2 = F.when(F.col("pos") == 2, F.col("x1")).otherwise(F.col("x2"))
    e = F.struct("pos", F.array(p("x1", "y1"), F.array(x2.cast("double"), F.col("y1").cast("double")), F.array(x2.cast("double"), F.col("y2").cast("double")), p("x1", "y2")).alias("box"), "label", "text")
    return b.groupBy(F.col("doc_id").alias("ordinal"), "width", "height").agg(F.sort_array(F.collect_list(e)).alias("ocr")).select("ordinal", F.struct("width", "height").alias("image"), "ocr")


def _listed(pages: DataFrame) -> DataFrame:
    return pages.select("source", "doc_id", F.explode("ocr_boxes").alias("b")).select("source", "doc_id", F.col("b.text").alias("text"), *_flat("b.box_pixel"), F.col("b.label").alias("label"), F.col("b.is_numeric").alias("is_numeric"))


_RECEIPTS = f"SELECT 'sroie' AS source, 'sroie-train-' || doc_id AS doc_id, text, x1, y1, x2, y2, label, regexp_matches(text, '\\p{{Nd}}') AS is_numeric FROM ({BOXES}) WHERE pos <> 2"


@query(_RECEIPTS)
def q_normalize_receipts(spark, sf):
    return _listed(ingest.normalise_receipts(_raw_receipts(spark, sf)))


def _raw_forms(spark, sf):
    b = views.boxes(spark, sf)
    e = F.sort_array(F.collect_list(F.struct("pos", "text", "box", "label")))
    got = b.groupBy(F.col("doc_id").alias("ordinal"), "width", "height").agg(e.alias("e"))
    n = F.size("e")
    tags = F.transform("e", lambda x: (x["pos"] % len(NAMES)).cast("int"))
    return got.select("ordinal", F.struct("width", "height").alias("image"), F.transform("e", lambda x: x["text"]).alias("words"), F.transform("e", lambda x: x["box"]).alias("bboxes"), F.when(n > 3, F.slice(tags, F.lit(1), n - 1)).otherwise(tags).alias("ner_tags"))


_FORM_LABELS = "['other', 'click', 'click', 'view', 'view', 'x-y']"
_PX = {n: f"CAST(round_even(greatest(0.0, least({w}::DOUBLE, {n}::DOUBLE / 1000 * {w})), 0) AS INT)" for n, w in (("x1", "width"), ("y1", "height"), ("x2", "width"), ("y2", "height"))}
_FORMS = f"""SELECT 'funsd' AS source, 'funsd-train-' || doc_id AS doc_id, text, {', '.join(f'{v} AS {k}' for k, v in _PX.items())}, ({_FORM_LABELS})[pos % 6 + 1] AS label, regexp_matches(text, '\\p{{Nd}}') AS is_numeric
 FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM ({BOXES})) WHERE (n <= 3 OR pos < n) AND {_PX['x2']} > {_PX['x1']} AND {_PX['y2']} > {_PX['y1']}"""


@query(_FORMS)
def q_normalize_forms(spark, sf):
    return _listed(ingest.normalise_forms(_raw_forms(spark, sf), names=NAMES))


@query(f"SELECT event_id, ({_FORM_LABELS})[CAST(event_id % 6 AS INT) + 1] AS label FROM events")
def q_tag_lookup(spark, sf):
    return _table(spark, sf, "events").select("event_id", ingest.tag_label((F.col("event_id") % 6).cast("int"), NAMES).alias("label"))


@query(f"""WITH b AS ({BOXES}) SELECT 'docs' AS kind, source AS key, count(DISTINCT doc_id) AS n FROM ({PAGES}) GROUP BY ALL UNION ALL SELECT 'boxes', source || ':' || label, count(*) FROM b GROUP BY ALL UNION ALL SELECT 'numeric', '', count(*) FILTER (regexp_matches(text, '\\p{{Nd}}')) FROM b""")
def q_ingest_stats(spark, sf):
    return ingest.ingest_stats(views.pages(spark, sf))


@query(f"SELECT source, doc_id, count(*) AS boxes FROM ({_RECEIPTS}) GROUP BY ALL UNION ALL SELECT source, doc_id, count(*) FROM ({_FORMS}) GROUP BY ALL")
def q_source_union(spark, sf):
    light = [s.drop("image") for s in (ingest.normalise_receipts(_raw_receipts(spark, sf)), ingest.normalise_forms(_raw_forms(spark, sf), names=NAMES))]
    return light[0].unionByName(light[1]).where(F.size("ocr_boxes") > 0).select("source", "doc_id", F.size("ocr_boxes").cast("bigint").alias("boxes"))


# --- splits, balance, selection ---

_SPLIT = "SELECT doc_id, CASE WHEN rn <= round_even(n * 0.7, 0) THEN 'train' WHEN rn <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('0:split:' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM {0}))"
DOC_SPLIT, PAGE_SPLIT = _SPLIT.format("documents"), _SPLIT.format(f"({PAGES})")


@query(DOC_SPLIT)
def q_split_assign(spark, sf):
    return splits.assign_splits(_table(spark, sf, "documents"), RATIOS)


def _split_docs(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", "source", "lang")
    return splits.group_docs(docs, splits.assign_splits(docs, RATIOS))


@query(f"WITH s AS ({DOC_SPLIT}), r AS (SELECT * FROM s UNION ALL SELECT doc_id, 'test' FROM documents WHERE doc_id % 50 = 0) SELECT doc_id FROM r GROUP BY doc_id HAVING count(DISTINCT split) > 1")
def q_leakage(spark, sf):
    s = splits.assign_splits(_table(spark, sf, "documents"), RATIOS)
    return splits.leaked_ids(s.unionByName(_table(spark, sf, "documents").where("doc_id % 50 = 0").select("doc_id", F.lit("test").alias("split"))))


@query(f"WITH s AS ({DOC_SPLIT}) SELECT split, source, count(*) AS n FROM documents JOIN s USING (doc_id) GROUP BY ALL")
def q_group_docs(spark, sf):
    return _split_docs(spark, sf).groupBy("split", "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT l_orderkey FROM lineitem ORDER BY 1")
def q_distinct_ids(spark, sf):
    return splits.distinct_ids(_table(spark, sf, "lineitem"), "l_orderkey")


@query(
    """WITH r AS (SELECT doc_id, toxic = 1 AS tampered FROM labels), n AS (SELECT count(*) FILTER (tampered) AS yes, count(*) FILTER (NOT tampered) AS no FROM r), few AS (SELECT doc_id, tampered, row_number() OVER (ORDER BY md5('0:rank:' || doc_id), doc_id) AS rank FROM r, n WHERE tampered = (yes < no)),
p AS (SELECT i AS copy, ('0x' || substr(md5('0:copy:' || i), 1, 8))::BIGINT % least(yes, no) + 1 AS rank FROM n, unnest(range(1, abs(yes - no) + 1)) t(i) WHERE yes > 0 AND no > 0)
SELECT doc_id, tampered, 0::BIGINT AS copy FROM r UNION ALL SELECT doc_id, tampered, copy FROM p JOIN few USING (rank)"""
)
def q_balance(spark, sf):
    return splits.balance(_table(spark, sf, "labels").select("doc_id", (F.col("toxic") == 1).alias("tampered")), "doc_id")


@query("SELECT doc_id, text_md5 AS image_path, quality = 0 AS tampered FROM (SELECT *, row_number() OVER (PARTITION BY text_md5, quality = 0 ORDER BY doc_id) AS k FROM (SELECT doc_id, md5(text) AS text_md5, coalesce(quality, 1) AS quality FROM documents LEFT JOIN labels USING (doc_id))) WHERE quality = 0 OR k = 1")
def q_keep_first_dedup(spark, sf):
    d = _table(spark, sf, "documents").join(_table(spark, sf, "labels"), "doc_id", "left")
    rows = d.select("doc_id", F.md5(F.col("text").cast("binary")).alias("image_path"), (F.coalesce("quality", F.lit(1)) == 0).alias("tampered"))
    return splits.keep_first_clean(rows, "doc_id")


@query(
    """WITH e AS (SELECT event_id, event_type, event_type <> 'click' AS tampered FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn, min(event_id) OVER (PARTITION BY event_type) AS f FROM e WHERE tampered),
b AS (SELECT event_id, event_type, tampered FROM r ORDER BY rn, f, event_id LIMIT 15), g AS (SELECT * FROM e WHERE NOT tampered ORDER BY event_id LIMIT 15) SELECT * FROM b UNION ALL SELECT * FROM g"""
)
def q_round_robin_subset(spark, sf):
    e = _table(spark, sf, "events").select("event_id", "event_type", (F.col("event_type") != "click").alias("tampered"))
    return splits.round_robin(e, 30, "event_id", kind="event_type")


@query(f"SELECT l_returnflag, {', '.join(c for c in views.LINEITEM.split(', ') if c in ('l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber'))} FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {views.LINEITEM}) AS k FROM lineitem) WHERE k <= 5")
def q_samples_per_group(spark, sf):
    return splits.first_per_group(_table(spark, sf, "lineitem"), 5, views.LINEITEM.split(", "), "l_returnflag").select("l_returnflag", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('3:shuffle:' || doc_id), doc_id) AS place FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50)")
def q_shuffle_limit(spark, sf):
    from pyspark.sql import Window

    few = splits.first_rows(_table(spark, sf, "documents").select("doc_id"), 50, "doc_id")
    return few.select("doc_id", F.row_number().over(Window.orderBy(order_key(3, "shuffle", F.col("doc_id")), "doc_id")).cast("bigint").alias("place"))


# --- manifest ---

_M = f"WITH s AS ({DOC_SPLIT}), r AS (SELECT doc_id, split, source, coalesce(quality, 1) = 0 AS tampered, CASE WHEN quality = 0 THEN ['digit_swap', 'copy_move', 'splice'][CAST(doc_id % 3 AS INT) + 1] END AS tamper_type FROM documents JOIN s USING (doc_id) LEFT JOIN labels USING (doc_id))"


def _manifest_rows(spark, sf):
    d = _split_docs(spark, sf).join(_table(spark, sf, "labels"), "doc_id", "left")
    bad = F.coalesce("quality", F.lit(1)) == 0
    kinds = F.array(*map(F.lit, ("digit_swap", "copy_move", "splice")))
    return d.select("doc_id", "split", "source", bad.alias("tampered"), F.when(bad, F.element_at(kinds, (F.col("doc_id") % 3).cast("int") + 1)).alias("tamper_type"))


def _map_sql(key: str, where: str) -> str:
    return f"(SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT {key} AS k, count(*) AS n FROM r x WHERE x.split = r.split AND {where} GROUP BY 1))"


@query(f"{_M} SELECT split, count(*) AS examples, count(DISTINCT doc_id) AS docs, count(*) FILTER (NOT tampered) AS clean, count(*) FILTER (tampered) AS tampered, {_map_sql('tamper_type', 'tampered')} AS types, {_map_sql('source', 'true')} AS sources FROM r GROUP BY split")
def q_manifest(spark, sf):
    m = manifests.manifest(_manifest_rows(spark, sf), splits.SPLITS)
    flat = lambda c: F.array_join(F.transform(F.sort_array(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return m.select("split", "examples", "docs", "clean", "tampered", flat("by_tamper_type").alias("types"), flat("by_source").alias("sources"))


@query(f"{_M} SELECT split, count(*) AS examples, count(*) FILTER (NOT tampered) AS clean, count(*) FILTER (tampered) AS tampered FROM r GROUP BY ROLLUP (split)")
def q_manifest_totals(spark, sf):
    return manifests.totals(_manifest_rows(spark, sf))


@query(f"{_M} SELECT split, round_even(count(*) FILTER (NOT tampered) / count(*), 3) AS clean_frac FROM r GROUP BY split")
def q_clean_fraction(spark, sf):
    got = _manifest_rows(spark, sf).groupBy("split").agg(F.count_if(~F.col("tampered")).alias("c"), F.count(F.lit(1)).alias("n"))
    return got.select("split", stats.clean_fraction(F.col("c"), F.col("n")).alias("clean_frac"))


@query("SELECT o_orderkey::VARCHAR AS doc_id, o_orderpriority AS source, CAST(300 + o_orderkey % 400 AS INT) AS width, CASE WHEN o_orderkey % 2 = 0 THEN 'ü \"' || o_orderstatus END AS reason, CASE WHEN o_orderkey % 3 = 0 THEN 1 + (o_orderkey % 5)::INT END AS x1 FROM orders")
def q_jsonl_roundtrip(spark, sf):
    from docprobe.sources.readers import read_records
    from docprobe.sources.scratch import fresh
    from docprobe.sources.sinks import write_records

    rows = _table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.col("o_orderpriority").alias("source"), (300 + F.col("o_orderkey") % 400).cast("int").alias("width"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('ü "'), "o_orderstatus")).alias("reason"), F.when(F.col("o_orderkey") % 3 == 0, F.array((1 + F.col("o_orderkey") % 5).cast("int"))).alias("box_pixel"), F.when(F.col("o_orderkey") % 4 == 0, "val").otherwise("train").alias("split"))
    out = fresh(spark, "jsonl")
    write_records(rows, out)
    back = read_records(spark, f"{out}/split=train", f"{out}/split=val", f"{out}/split=test")
    return back.select("doc_id", "source", "width", "reason", F.get("box_pixel", F.lit(0)).alias("x1"))
