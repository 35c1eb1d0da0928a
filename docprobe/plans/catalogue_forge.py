"""Forging, evaluation and chat as queries over the driver's tables, and the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from docprobe.functions import codec, stats
from docprobe.operators import chat, evaluate, forge, predict
from docprobe.operators.split import assign_splits, group_docs
from docprobe.plans import views
from docprobe.plans.catalogue import BOXES, COMPLETIONS, PAGE_SPLIT, PAGES, RATIOS, SAID, TRUTH, _flat, _iou_sql, _norm_sql, _table, query

# --- the SQL side of sampling ---


def _draw(purpose: str, *keys: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', '0:{purpose}', {', '.join(keys)})), 1, 8))::BIGINT"


def _between(purpose: str, lo: str, hi: str, *keys: str) -> str:
    return f"(({lo}) + {_draw(purpose, *keys)} % (({hi}) - ({lo}) + 1))"


def _pick(rows: str, purpose: str, where: str, name: str) -> str:
    """Two CTEs: candidates of each page with their place and number, and the one that the draw takes."""
    return f"""{name}_c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM {rows} WHERE {where}),
{name} AS (SELECT * FROM {name}_c WHERE k = {_draw(purpose, 'doc_id')} % n)"""


_LARGE = "x2 - x1 >= 6 AND y2 - y1 >= 6"
_PREF = ", ".join(f"'{x}'" for x in forge.PREFERRED_LABELS)
_DONOR = ", ".join(f"'{x}'" for x in forge.DONOR_LABELS)
_B = f"b AS (SELECT *, regexp_matches(text, '\\p{{Nd}}') AS num FROM ({BOXES}))"
_CLAMPED = "greatest(0, least(width, {0}x1))::INT AS g1, greatest(0, least(height, {0}y1))::INT AS g2, greatest(0, least(width, {0}x2))::INT AS g3, greatest(0, least(height, {0}y2))::INT AS g4"

SWAP = f"""nu AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS nn, count(*) FILTER (label IN ({_PREF})) OVER (PARTITION BY doc_id) AS np FROM b WHERE num),
{_pick('nu', 'swap:target', f"nn >= 2 AND (np = 0 OR label IN ({_PREF})) AND {_LARGE}", 't')},
nd AS (SELECT nu.* FROM nu JOIN t ON nu.doc_id = t.doc_id AND nu.pos <> t.pos),
{_pick('nd', 'swap:donor', _LARGE, 'd')},
sw0 AS (SELECT t.*, d.x1 AS dx1, d.y1 AS dy1, d.x2 AS dx2, d.y2 AS dy2, greatest(6, least(t.y2 - t.y1, d.x2 - d.x1)) AS glyph FROM t JOIN d USING (doc_id)),
sw1 AS (SELECT *, CASE WHEN dy2 - dy1 = y2 - y1 THEN glyph ELSE greatest(4, round_even((glyph * (y2 - y1))::DOUBLE / (dy2 - dy1), 0)::INT) END AS pw FROM sw0),
sw2 AS (SELECT *, greatest(x1, x2 - pw) AS last, (x1 + x2) // 2 AS mid FROM sw1),
sw AS (SELECT doc_id, {_CLAMPED.format('')}, coalesce(nullif(label, ''), 'field') AS field, {_between('swap:dx', 'dx1', 'greatest(dx1, dx2 - glyph)', 'doc_id')}::INT AS sx, pw AS patch_w,
 (CASE WHEN last > x1 THEN {_between('swap:px', 'CASE WHEN last > mid THEN mid ELSE x1 END', 'last', 'doc_id')} ELSE x1 END)::INT AS px, (y1 + {_between('swap:py', '-1', '1', 'doc_id')})::INT AS py FROM sw2)"""

MOVE = f"""{_pick('b', 'move:source', _LARGE, 'm')},
fr0 AS (SELECT m.*, i, {_between('free:x', '4', 'greatest(4, width - (x2 - x1) - 4)', 'doc_id', 'i')} AS fx, {_between('free:y', '4', 'greatest(4, height - (y2 - y1) - 4)', 'doc_id', 'i')} AS fy FROM m, range(0, 60) r(i) WHERE x2 - x1 < width AND y2 - y1 < height),
fr1 AS (SELECT * FROM fr0 WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.doc_id = fr0.doc_id AND fx + (fr0.x2 - fr0.x1) + 4 > o.x1 AND o.x2 > fx - 4 AND fy + (fr0.y2 - fr0.y1) + 4 > o.y1 AND o.y2 > fy - 4)),
fr AS (SELECT doc_id, source, width, height, label, fx AS x1, fy AS y1, fx + (x2 - x1) AS x2, fy + (y2 - y1) AS y2 FROM fr1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1),
mv AS (SELECT doc_id, {_CLAMPED.format('')}, coalesce(nullif(label, ''), 'field') AS field FROM fr)"""


def _pool(groups: str, rows: str) -> str:
    return f"pool AS (SELECT {groups}, row_number() OVER (PARTITION BY {groups} ORDER BY doc_id, pos) - 1 AS donor_idx, doc_id, pos FROM {rows} WHERE label IN ({_DONOR}) AND x2 - x1 >= 12 AND y2 - y1 >= 8 QUALIFY row_number() OVER (PARTITION BY {groups} ORDER BY doc_id, pos) <= 300), cnt AS (SELECT {groups}, count(*) AS nd FROM pool GROUP BY ALL)"


def _splice(join: str) -> str:
    return f"""{_pick('b', 'splice:target', _LARGE, 'st')},
sp AS (SELECT st.doc_id, st.source, {_CLAMPED.format('')}, coalesce(nullif(label, ''), 'field') AS field, {_draw('splice:donor', 'st.doc_id')} % nd AS donor_idx FROM st {join})"""


_POOL_ALL, _SPLICE_ALL = _pool("source", "b"), _splice("JOIN cnt USING (source)")


def _made(df, op):
    """doc_id and the plan's fields where there is one. A filter on the plan would be pushed below it and compute it again; a generator is not."""
    return df.select("doc_id", F.explode(F.filter(F.array(op), lambda m: m.isNotNull())).alias("made_plan")).select("doc_id", "made_plan.*")


def _pool_pages(spark, sf):
    p = views.pages(spark, sf)
    return p, forge.harvest_donors(p, split=None)


@query(f"WITH {_B}, {_POOL_ALL} SELECT source, donor_idx, doc_id, pos FROM pool")
def q_donor_topk(spark, sf):
    return _pool_pages(spark, sf)[1].select("source", "donor_idx", "doc_id", "pos")


@query(f"WITH {_B}, {_POOL_ALL}, {_SPLICE_ALL} SELECT sp.doc_id, pool.doc_id AS donor_doc_id, pool.pos AS donor_pos FROM sp JOIN pool ON sp.source = pool.source AND sp.donor_idx = pool.donor_idx")
def q_donor_join(spark, sf):
    p, pool = _pool_pages(spark, sf)
    planned = forge.plan_splice(forge.with_donor_counts(p, pool, split=None)).where("splice is not null").select("doc_id", "source", F.col("splice.donor_idx").alias("donor_idx"))
    return planned.join(pool.withColumnRenamed("doc_id", "donor_doc_id"), ["source", "donor_idx"]).select("doc_id", "donor_doc_id", F.col("pos").alias("donor_pos"))


@query(f"WITH {_B}, {_POOL_ALL}, c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (num) AS nn FROM b GROUP BY 1) SELECT p.doc_id, coalesce(nn, 0) >= 2 AS digit_swap, coalesce(n, 0) >= 1 AS copy_move, coalesce(n, 0) >= 1 AND coalesce(nd, 0) > 0 AS splice FROM ({PAGES}) p LEFT JOIN c USING (doc_id) LEFT JOIN cnt USING (source)")
def q_applicability(spark, sf):
    p, pool = _pool_pages(spark, sf)
    return forge.with_donor_counts(p, pool, split=None).select("doc_id", *(forge.applicable(n).alias(n) for n in forge.OP_NAMES))


@query(f"WITH {_B}, {_pick('b', 'any', f'num AND {_LARGE}', 't')} SELECT doc_id, pos, n AS candidates FROM t")
def q_pick_box(spark, sf):
    p = views.pages(spark, sf).withColumn("c", forge.candidates(F.col("ocr_boxes"), lambda b: b["is_numeric"]))
    return p.select("doc_id", forge.pick(F.col("c"), 0, "any", F.col("doc_id"))["pos"].alias("pos"), F.size("c").cast("bigint").alias("candidates")).where("pos is not null")


@query(f"WITH {_B}, {SWAP} SELECT doc_id, g1, g2, g3, g4, field, sx, patch_w, px, py FROM sw")
def q_digit_swap_geometry(spark, sf):
    got = _made(forge.plan_digit_swap(views.pages(spark, sf)), "digit_swap")
    return got.select("doc_id", *_flat("gt", "g1", "g2", "g3", "g4"), "field", F.element_at("source_box", 1).alias("sx"), "patch_w", *_flat("paste", "px", "py")[:2])


@query(f"WITH {_B}, {MOVE} SELECT doc_id, x1::INT AS x1, y1::INT AS y1, x2::INT AS x2, y2::INT AS y2 FROM fr")
def q_free_box(spark, sf):
    got = _made(forge.plan_copy_move(views.pages(spark, sf)), "copy_move")
    x, y = F.element_at("paste", 1), F.element_at("paste", 2)
    return got.select("doc_id", x.alias("x1"), y.alias("y1"), (x + F.col("patch_w")).alias("x2"), (y + F.col("patch_h")).alias("y2"))


@query(f"WITH {_B}, {MOVE} SELECT doc_id, g1, g2, g3, g4, field FROM mv")
def q_copy_move_geometry(spark, sf):
    got = _made(forge.plan_copy_move(views.pages(spark, sf)), "copy_move")
    return got.select("doc_id", *_flat("gt", "g1", "g2", "g3", "g4"), "field")


@query(f"WITH {_B}, {_POOL_ALL}, {_SPLICE_ALL} SELECT doc_id, g1, g2, g3, g4, field, donor_idx FROM sp")
def q_splice_geometry(spark, sf):
    p, pool = _pool_pages(spark, sf)
    got = _made(forge.plan_splice(forge.with_donor_counts(p, pool, split=None)), "splice")
    return got.select("doc_id", *_flat("gt", "g1", "g2", "g3", "g4"), "field", "donor_idx")


_GHOST = f"""gh AS (SELECT *, 1 + {_draw('ghost:shift', 'doc_id')} % 4 AS off FROM t),
gp AS (SELECT doc_id, {_CLAMPED.format('')}, coalesce(nullif(label, ''), 'field') AS field, greatest(0, least(x1 + off, width - (x2 - x1)))::INT AS px, greatest(0, least(y1 + off, height - (y2 - y1)))::INT AS py, [90, 95][{_draw('ghost:patch', 'doc_id')} % 2 + 1]::INT AS patch_quality, [70, 75, 80][{_draw('ghost:page', 'doc_id')} % 3 + 1]::INT AS page_quality FROM gh)"""


@query(f"WITH {_B}, {_pick('b', 'ghost:target', 'x2 - x1 >= 10 AND y2 - y1 >= 10', 't')}, {_GHOST} SELECT * FROM gp")
def q_recompress_ghost_geometry(spark, sf):
    got = _made(forge.plan_recompress_ghost(views.pages(spark, sf)), "recompress_ghost")
    return got.select("doc_id", *_flat("gt", "g1", "g2", "g3", "g4"), "field", *_flat("paste", "px", "py")[:2], "patch_quality", "page_quality")


_ALL = """al AS (SELECT doc_id, 'digit_swap' AS op, g1, g2, g3, g4, field FROM sw UNION ALL SELECT doc_id, 'copy_move', g1, g2, g3, g4, field FROM mv UNION ALL SELECT doc_id, 'splice', g1, g2, g3, g4, field FROM sp),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('0:order:' || doc_id || ':' || op)) AS k FROM al)"""
_REASON = "CASE tamper_type " + " ".join(f"WHEN '{op}' THEN replace('{r}', '%s', field)" for op, r in codec.REASONS.items()) + f" ELSE '{codec.CLEAN_REASON}' END AS reason"


def _records(df):
    return df.select("doc_id", "source", "width", "height", "tampered", "field", "tamper_type", *_flat("box_pixel", "g1", "g2", "g3", "g4"), "reason")


_ONE_SQL = f"""SELECT *, {_REASON} FROM (SELECT p.doc_id, p.source, p.width, p.height, op IS NOT NULL AS tampered, field, op AS tamper_type, g1, g2, g3, g4 FROM ({PAGES}) p LEFT JOIN rk ON rk.doc_id = p.doc_id AND rk.k = 1 AND {_draw('clean', 'p.doc_id')} / 4294967296.0 >= {{0}})"""


@query(f"WITH {_B}, {_POOL_ALL}, {SWAP}, {MOVE}, {_SPLICE_ALL}, {_ALL} {_ONE_SQL.format(0.25)}")
def q_forge_one(spark, sf):
    p, pool = _pool_pages(spark, sf)
    return _records(forge.forge_one(forge.with_donor_counts(p, pool, split=None), p_clean=0.25))


@query(f"WITH {_B}, {_POOL_ALL}, {SWAP}, {MOVE}, {_SPLICE_ALL}, {_ALL} {_ONE_SQL.format(0.5)}")
def q_corpus_sample(spark, sf):
    return _records(forge.corpus_sample(views.pages(spark, sf)))


_SPLIT_B = f"sl AS ({PAGE_SPLIT}), b AS (SELECT x.*, split, regexp_matches(text, '\\p{{Nd}}') AS num FROM ({BOXES}) x JOIN sl USING (doc_id))"


@query(
    f"""WITH {_SPLIT_B}, {_pool('split, source', 'b')}, {SWAP}, {MOVE}, {_splice('JOIN cnt ON cnt.split = st.split AND cnt.source = st.source')}, {_ALL},
v AS (SELECT p.doc_id, p.source, p.width, p.height, false AS tampered, NULL AS field, NULL AS tamper_type, NULL::INT AS g1, NULL::INT AS g2, NULL::INT AS g3, NULL::INT AS g4 FROM ({PAGES}) p UNION ALL
 SELECT p.doc_id, p.source, p.width, p.height, true, field, op, g1, g2, g3, g4 FROM ({PAGES}) p JOIN rk USING (doc_id) WHERE k <= 2)
SELECT split, v.*, {_REASON} FROM v JOIN sl USING (doc_id)"""
)
def q_forge_variants(spark, sf):
    p = views.pages(spark, sf)
    dealt = group_docs(p, assign_splits(p, RATIOS))
    got = forge.forge_variants(forge.with_donor_counts(dealt, forge.harvest_donors(dealt)), 2, keep=["split"])
    return got.select("split", "doc_id", "source", "width", "height", "tampered", "field", "tamper_type", *_flat("box_pixel", "g1", "g2", "g3", "g4"), "reason")


# --- evaluation ---

_E = f"e AS (SELECT *, shape <> 6 AS parsed, shape <> 6 AND says AS flag, shape <> 6 AND base_says AS bflag FROM ({SAID}))"


def _wilson_sql(k: str, n: str) -> tuple[str, str, str]:
    z, p = "1.96::DOUBLE", f"(({k})::DOUBLE / nullif({n}, 0))"
    half = f"({z} * sqrt({p} * (1 - {p}) / ({n}) + {z} * {z} / (4 * ({n}) * ({n}))) / (1 + {z} * {z} / ({n})))"
    mid = f"(({p} + {z} * {z} / (2 * ({n}))) / (1 + {z} * {z} / ({n})))"
    zero = f"CASE WHEN ({n}) = 0 THEN 0.0 ELSE "
    return f"{zero}round({p}, 9) END", f"{zero}round(greatest(0.0, {mid} - {half}), 9) END", f"{zero}round(least(1.0, {mid} + {half}), 9) END"


def _detection_sql(flag: str) -> str:
    cells = f"SELECT count(*) AS n, count(*) FILTER (true_tampered AND {flag}) AS tp, count(*) FILTER (NOT true_tampered AND {flag}) AS fp, count(*) FILTER (true_tampered AND NOT {flag}) AS fn, count(*) FILTER (NOT true_tampered AND NOT {flag}) AS tn, count(*) FILTER (NOT parsed) AS parse_failures FROM e"
    p, r = _wilson_sql("tp", "tp + fp"), _wilson_sql("tp", "tp + fn")
    return f"""SELECT n, tp, fp, fn, tn, parse_failures, {', '.join(f'{x} AS precision{s}' for x, s in zip(p, ('', '_lo', '_hi')))}, {', '.join(f'{x} AS recall{s}' for x, s in zip(r, ('', '_lo', '_hi')))},
 CASE WHEN tp = 0 THEN 0.0 ELSE round(2.0 * tp / (2 * tp + fp + fn), 9) END AS f1, round((tp + tn)::DOUBLE / n, 9) AS accuracy, round(parse_failures::DOUBLE / n, 9) AS parse_failure_rate FROM ({cells})"""


def _rounded(df):
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(f"WITH {_E} {_detection_sql('flag')}")
def q_detection(spark, sf):
    return _rounded(evaluate.detection(views.evaluation(spark, sf)))


_PARSE_E = f"e AS (SELECT *, coalesce(CASE WHEN shape = 5 THEN true ELSE says END, false) AND shape NOT IN (2, 3, 4, 6) AS flag, shape NOT IN (2, 3, 4, 6) AS parsed FROM ({COMPLETIONS}))"


@query(f"WITH {_PARSE_E} {_detection_sql('flag')}")
def q_completion_detection(spark, sf):
    """From completions in free text to the detection report: the flagship."""
    c = views.in_spark(spark, sf, views.COMPLETIONS)
    rows = c.select("true_tampered", codec.parse_prediction(F.col("completion")).alias("pred"))
    return _rounded(evaluate.detection(rows))


_W = _wilson_sql("k", "n")


@query(f"SELECT source, n, k, {_W[0]} AS p, {_W[1]} AS lo, {_W[2]} AS hi FROM (SELECT source, count(*) AS n, count(*) FILTER (length(text) > 2000) AS k FROM documents GROUP BY 1)")
def q_wilson(spark, sf):
    g = _table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") > 2000).alias("k"))
    return g.select("source", "n", "k", *(F.round(c, 9).alias(a) for c, a in zip(stats.wilson(F.col("k"), F.col("n")), ("p", "lo", "hi"))))


_N = {c: _norm_sql(c, w) for c, w in (("x1", "width"), ("y1", "height"), ("x2", "width"), ("y2", "height"))}


def _tp_sql(flag: str) -> str:
    return f"""tp AS (SELECT doc_id, coalesce(nullif(tamper_type, ''), 'unknown') AS tamper_type, CASE WHEN shape = 5 THEN 0.0 ELSE {_iou_sql('p', 'g')} END AS iou FROM
 (SELECT doc_id, tamper_type, shape, {{'x1': least(bx1, bx2), 'y1': least(by1, by2), 'x2': greatest(bx1, bx2), 'y2': greatest(by1, by2)}} AS p, {{{', '.join(f"'{k}': {v}" for k, v in _N.items())}}} AS g FROM e WHERE true_tampered AND {flag}))"""


_H = _wilson_sql("hits", "n_true_positive")
_LOC = f"n_true_positive, round(mean_iou, 9) AS mean_iou, hits, {_H[0]} AS hit_rate, {_H[1]} AS hit_lo, {_H[2]} AS hit_hi"


@query(f"WITH {_E}, {_tp_sql('flag')} SELECT doc_id, round(iou, 9) AS iou FROM tp")
def q_pred_flag_iou(spark, sf):
    return evaluate.true_positives(views.evaluation(spark, sf)).select("doc_id", F.round("iou", 9).alias("iou"))


@query(f"WITH {_E}, {_tp_sql('flag')} SELECT {_LOC} FROM (SELECT count(*) AS n_true_positive, coalesce(avg(iou), 0) AS mean_iou, count(*) FILTER (iou >= 0.5) AS hits FROM tp)")
def q_localization(spark, sf):
    return _rounded(evaluate.localisation(views.evaluation(spark, sf)))


@query(f"WITH {_E}, {_tp_sql('flag')} SELECT tamper_type, {_LOC} FROM (SELECT tamper_type, count(*) AS n_true_positive, coalesce(avg(iou), 0) AS mean_iou, count(*) FILTER (iou >= 0.5) AS hits FROM tp GROUP BY 1)")
def q_localization_by_type(spark, sf):
    return _rounded(evaluate.localisation(views.evaluation(spark, sf), by_type=True))


_MC = "mc AS (SELECT count(*) FILTER (flag = true_tampered AND bflag <> true_tampered) AS b, count(*) FILTER (flag <> true_tampered AND bflag = true_tampered) AS c FROM e)"
_PV = "(SELECT CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0::DOUBLE))) FROM range(0, least(b, c) + 1) r(i))) END FROM mc)"


@query(f"WITH {_E}, {_MC} SELECT b, c, nullif(b + c, 0) AS n_discordant, round({_PV}, 9) AS p_value FROM mc")
def q_mcnemar(spark, sf):
    a, b = views.evaluation(spark, sf), views.evaluation(spark, sf, "base_says")
    return _rounded(evaluate.mcnemar(evaluate.paired(a, b, "doc_id", "variant")))


def _f1(flag: str) -> str:
    return f"(SELECT coalesce(2.0 * count(*) FILTER (true_tampered AND {flag}) / nullif(2 * count(*) FILTER (true_tampered AND {flag}) + count(*) FILTER (NOT true_tampered AND {flag}) + count(*) FILTER (true_tampered AND NOT {flag}), 0), 0.0) FROM e)"


@query(
    f"WITH {_E}, {_MC}, {_tp_sql('flag')}, {_tp_sql('bflag').replace('tp AS', 'btp AS', 1)} SELECT round({_f1('flag')}, 9) AS f1, (SELECT round(coalesce(avg((iou >= 0.5)::INT), 0), 9) FROM tp) AS hit_rate, round({_f1('flag')} - {_f1('bflag')}, 9) AS delta_f1, round((SELECT coalesce(avg((iou >= 0.5)::INT), 0) FROM tp) - (SELECT coalesce(avg((iou >= 0.5)::INT), 0) FROM btp), 9) AS delta_hit_rate, round({_PV}, 9) AS p_value, (SELECT count(DISTINCT tamper_type) FROM tp) AS types"
)
def q_report(spark, sf):
    r = evaluate.report(views.evaluation(spark, sf), views.evaluation(spark, sf, "base_says"))
    return _rounded(r.select("detection.f1", "localization.hit_rate", F.col("delta.f1").alias("delta_f1"), F.col("delta.hit_rate").alias("delta_hit_rate"), "mcnemar.p_value", F.size("by_type").cast("bigint").alias("types")))


@query(f"WITH {_E}, {_tp_sql('flag')} SELECT (SELECT count(*) FROM e) AS n, (SELECT count(*) FILTER (parsed AND says = true_tampered) FROM e) AS detected, count(*) FILTER (doc_id % 11 <> 5) AS n_boxes, round(coalesce(avg(iou) FILTER (doc_id % 11 <> 5), 0), 9) AS mean_iou, count(*) FILTER (iou >= 0.5 AND doc_id % 11 <> 5) AS hits FROM tp")
def q_overfit_report(spark, sf):
    return _rounded(evaluate.overfit_report(views.evaluation(spark, sf)))


@query(f"WITH {_E} SELECT doc_id, tamper_type, true_tampered, CASE WHEN parsed THEN says END AS pred_tampered, CASE WHEN flag AND shape <> 5 THEN concat_ws(',', bx1, by1, bx2, by2) END AS box FROM e")
def q_slim(spark, sf):
    return evaluate.slim(views.evaluation(spark, sf)).select("doc_id", "tamper_type", "true_tampered", "pred_tampered", F.when(F.col("pred_box_norm").isNotNull(), F.array_join(F.col("pred_box_norm").cast("array<string>"), ",")).alias("box"))


def _stub():
    """A predictor that any model could stand for: flags long enough rows."""
    return lambda rows: rows["width"].map(lambda w: '{"tampered": %s, "field": null, "box": null, "reason": "w"}' % ("true" if w % 3 == 0 else "false"))


@query(f"SELECT doc_id, true_tampered, width % 3 = 0 AS pred_tampered FROM ({TRUTH})")
def q_collect_predictions(spark, sf):
    t = views.in_spark(spark, sf, views.TRUTH).select(*views.truth_columns()).withColumnsRenamed({"true_tampered": "tampered", "true_box_pixel": "box_pixel"})
    return predict.collect_predictions(predict.generate(t, _stub)).select("doc_id", "true_tampered", F.col("pred.tampered").alias("pred_tampered"))


# --- chat ---



@query(f"SELECT doc_id, 3 AS n, 'system,user,assistant' AS roles, 'file:///data/images/' || doc_id || '.jpg' AS image, 'Inspect this document for tampering.' AS instruction, true_tampered AS flagged FROM ({TRUTH})")
def q_messages(spark, sf):
    t = views.in_spark(spark, sf, views.TRUTH)
    box = F.when(F.col("x1").isNotNull(), F.array("x1", "y1", "x2", "y2"))
    t = t.select("doc_id", "width", "height", F.col("true_tampered").alias("tampered"), F.lit("total").alias("field"), box.alias("box_pixel"), F.lit("r").alias("reason"), F.format_string("images/%d.jpg", "doc_id").alias("image_path")).withColumn("m", chat.messages("/data"))
    body = F.get(F.element_at("m", 3)["content"], F.lit(0))["text"]
    return t.select("doc_id", F.size("m").alias("n"), F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), F.get(F.element_at("m", 2)["content"], F.lit(0))["image"].alias("image"), F.get(F.element_at("m", 2)["content"], F.lit(1))["text"].alias("instruction"), codec.parse_prediction(body)["tampered"].alias("flagged"))


#: Token runs of conversations: 1 start, 2 end, 3 header, 0 padding, 9 an image; a turn is start, header, 5 + turn body tokens, end.
_TOKENS = "SELECT conv_id, max(turn) AS last, count(*) AS turns, max(turn) % 3 = 0 AS cut FROM conversations GROUP BY 1"


def _token_rows(spark, sf):
    turns = _table(spark, sf, "conversations")
    body = F.concat(F.array(F.lit(1), F.lit(3)), F.transform(F.sequence(F.lit(0), (F.col("turn") + 4).cast("int")), lambda i: F.when(i == 2, 9).otherwise(100 + i)), F.array(F.lit(2)))
    seq = turns.groupBy("conv_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("turn", body.alias("b")))), lambda x: x["b"])).alias("ids"), F.max("turn").alias("last"))
    kept = F.when(F.col("last") % 3 == 0, F.slice("ids", F.lit(1), F.size("ids") - 1)).otherwise(F.col("ids"))
    return seq.select("conv_id", chat.padded(kept, F.size("ids") + 4, 0).alias("input_ids"))


@query(
    f"""WITH t AS ({_TOKENS}), n AS (SELECT conv_id, sum(8 + turn)::INT AS n FROM conversations GROUP BY 1),
l AS (SELECT conv_id, n.n + 4 AS size, list_concat(list_transform(range(0, (last + 5)::BIGINT), lambda i: CASE WHEN i = 2 THEN -100 ELSE 100 + i END), CASE WHEN cut THEN [] ELSE [2] END) AS tail FROM t JOIN n USING (conv_id))
SELECT conv_id, size, len(list_filter(tail, lambda x: x <> -100))::INT AS learnable, array_to_string(list_concat(list_transform(range(0, size - 4 - len(tail) - (CASE WHEN list_contains(tail, 2) THEN 0 ELSE 1 END)), lambda i: -100), tail, list_transform(range(0, 4 + (CASE WHEN list_contains(tail, 2) THEN 0 ELSE 1 END)), lambda i: -100)), ',') AS labels FROM l"""
)
def q_loss_mask(spark, sf):
    got = chat.loss_mask(_token_rows(spark, sf), start_id=1, end_id=2, pad_id=0, image_id=9, header=1)
    return got.select("conv_id", F.size("labels").alias("size"), "learnable", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


@query(f"SELECT conv_id, NOT cut AS terminated, cut AS truncated FROM ({_TOKENS})")
def q_truncation_guard(spark, sf):
    got = chat.loss_mask(_token_rows(spark, sf), start_id=1, end_id=2, pad_id=0, image_id=9, header=1)
    return got.select("conv_id", "terminated", "truncated")
