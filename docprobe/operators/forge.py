"""Synthetic forgeries as geometry: which boxes change, where patches go, what the ground truth is.

A page is one row: doc_id, source, width, height, ocr_boxes ARRAY<STRUCT<pos, text, box_pixel, label, is_numeric>>. Every random
choice is an md5 counter of (seed, purpose, doc_id), so a retried task plans the same forgery. Pixels are a later, optional step (``pixels``):
plans carry coordinates, never images.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docprobe.functions.codec import CLEAN_REASON, label_to_field, reason_for
from docprobe.functions.geometry import box_height, box_width, clamp_box
from docprobe.operators.names import spare
from docprobe.operators.sampling import below, between, order_key, unit

# --- fixed values ---
OP_NAMES = ("digit_swap", "copy_move", "splice")
DONOR_LABELS = ("total", "line_total", "date", "company", "address", "answer")
PREFERRED_LABELS = ("total", "line_total", "date", "answer")
#: JPEG qualities of a recompressed patch and of the page around it.
PATCH_QUALITIES, PAGE_QUALITIES = (90, 95), (70, 75, 80)
# --- end of fixed values ---

PLAN = "struct<op:string,gt:array<int>,field:string,source_box:array<int>,paste:array<int>,patch_w:int,patch_h:int,angle:double,alpha:double,donor_idx:bigint,patch_quality:int,page_quality:int>"


def large_enough(box: Column, min_w: int, min_h: int) -> Column:
    return (box_width(box) >= min_w) & (box_height(box) >= min_h)


def candidates(boxes: Column, predicate: Callable[[Column], Column] | None = None, min_w: int = 6, min_h: int = 6) -> Column:
    """The boxes that a pick may take."""
    return F.filter(boxes, lambda b: large_enough(b["box_pixel"], min_w, min_h) & (predicate(b) if predicate else F.lit(True)))


def pick(cands: Column, seed: int, purpose: str, key: Column) -> Column:
    """One of the candidates, null if there are none. cands should be a column of its own."""
    return F.get(cands, below(seed, purpose, F.size(cands).cast("bigint"), key).cast("int"))


def harvest_donors(pages: DataFrame, order: str = "doc_id", per_source: int = 300, min_w: int = 12, min_h: int = 8, split: str | None = "split") -> DataFrame:
    """split, source, donor_idx (0-based), doc_id, pos, box_pixel: the first field-value boxes of each (split, source) in scan order."""
    groups = [c for c in (split, "source") if c]
    boxes = pages.select(*dict.fromkeys([*groups, order, "doc_id"]), F.explode("ocr_boxes").alias("b"))
    good = boxes.where(F.col("b.label").isin(*DONOR_LABELS) & large_enough(F.col("b.box_pixel"), min_w, min_h))
    (k,) = spare(good, "_k")
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(order, F.col("b.pos")))
    return good.withColumn(k, rank).where(F.col(k) <= per_source).select(*groups, (F.col(k) - 1).cast("bigint").alias("donor_idx"), "doc_id", F.col("b.pos").alias("pos"), F.col("b.box_pixel").alias("box_pixel"))


def with_donor_counts(pages: DataFrame, donors: DataFrame, split: str | None = "split") -> DataFrame:
    """pages and n_donors: donors of the same split and source, 0 if there are none. At most one row a group: broadcast by size, else a shuffle."""
    groups = [c for c in (split, "source") if c]
    counts = donors.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_donors"))
    return pages.join(counts, groups, "left").withColumn("n_donors", F.coalesce("n_donors", F.lit(0).cast("bigint")))


def has_boxes(n: int = 1) -> Column:
    """Whether a page (columns ocr_boxes, n_donors) has n boxes."""
    return F.size("ocr_boxes") >= n


def applicable(op: str | ForgeryOp) -> Column:
    """Whether an operation can be tried on a page."""
    return (OPS[op] if isinstance(op, str) else op).applicable()


def seeded_place(k: Column, w: Column, h: Column, patch_w: Column, patch_h: Column, seed: int, key: Column, margin: int = 4) -> Column:
    """The k-th place that is tried for a patch, as a box."""
    lo = F.lit(margin)
    x = between(seed, "free:x", lo, F.greatest(lo, w - patch_w - margin), key, k)
    y = between(seed, "free:y", lo, F.greatest(lo, h - patch_h - margin), key, k)
    return F.array(x, y, (x + patch_w).cast("int"), (y + patch_h).cast("int"))


def touches(place: Column, box: Column, margin: int = 4) -> Column:
    """Whether a box comes nearer than the margin to a place."""
    at = lambda b, c: F.element_at(b, c)
    return (at(place, 3) + margin > at(box, 1)) & (at(box, 3) > at(place, 1) - margin) & (at(place, 4) + margin > at(box, 2)) & (at(box, 4) > at(place, 2) - margin)


def free_places(pages: DataFrame, seed: int = 0, tries: int = 60, margin: int = 4, cell: int = 64) -> DataFrame:
    """doc_id, place: for pages (doc_id, ocr_boxes, width, height, patch_w, patch_h) the place that ``free_box`` finds; no row if there is none.

    A page is cut into cells of ``cell`` pixels, and its boxes are gathered by the cells that they reach into: a page's grid is a row of columns of cells, and a place meets only the boxes
    of its own cells. A cell that one box fills, or covers with its margin all over, holds one box however many lie in it: whatever touches it is taken. Places are never rows: they are
    drawn beside the grid, the later ones only if the first are taken. Grids are a row a page, and no size that Spark guesses makes it broadcast them.
    """
    asked = pages.where((F.col("patch_w") < F.col("width")) & (F.col("patch_h") < F.col("height"))).select("doc_id", "ocr_boxes", "width", "height", "patch_w", "patch_h")
    cells = lambda lo, hi: F.sequence(F.floor(lo / cell), F.greatest(F.floor(lo / cell), F.floor((hi - 1) / cell)))
    at = lambda b, i: F.element_at(b, i)
    box = F.col("box")
    boxes = asked.select("doc_id", F.explode("ocr_boxes").alias("b")).select("doc_id", F.col("b.box_pixel").alias("box"))
    boxes = boxes.select("doc_id", "box", F.explode(cells(at(box, 1), at(box, 3))).alias("cx")).select("doc_id", "box", "cx", F.explode(cells(at(box, 2), at(box, 4))).alias("cy"))
    x, y = F.col("cx") * cell, F.col("cy") * cell
    whole = (at(box, 1) <= x) & (at(box, 3) >= x + cell) & (at(box, 2) <= y) & (at(box, 4) >= y + cell)
    # of a filled cell one box stands for all; everything of a page is grouped where its first grouping has put it
    kept = boxes.repartition("doc_id").groupBy("doc_id", "cx", "cy").agg(F.max(F.when(whole, box)).alias("full"), F.collect_set("box").alias("all"))
    near = F.when(F.col("full").isNotNull(), F.array("full")).otherwise(F.col("all")).alias("near")
    columns = kept.groupBy("doc_id", "cx").agg(F.collect_list(F.struct("cy", near)).alias("cells"))
    grids = columns.groupBy("doc_id").agg(F.collect_list(F.struct("cx", "cells")).alias("grid"))

    def taken(place: Column) -> Column:
        lo = lambda i: F.floor((at(place, i) - margin) / cell)
        within = lambda v, i: (v >= lo(i)) & (v <= F.greatest(lo(i), F.floor((at(place, i + 2) + margin - 1) / cell)))
        return F.exists("grid", lambda c: within(c["cx"], 1) & F.exists(c["cells"], lambda d: within(d["cy"], 2) & F.exists(d["near"], lambda b: touches(place, b, margin))))

    place = lambda k: seeded_place(k, F.col("width"), F.col("height"), F.col("patch_w"), F.col("patch_h"), seed, F.col("doc_id"), margin)
    first = lambda a, b: F.get(F.filter(F.transform(F.sequence(F.lit(a), F.lit(b - 1)), place), lambda p: ~F.coalesce(taken(p), F.lit(False))), F.lit(0))
    rows = asked.drop("ocr_boxes").join(grids.hint("merge"), "doc_id", "left")
    found = rows.select("doc_id", F.coalesce(*(first(a, b) for a, b in _stages(tries))).alias("place"))
    return found.where("place is not null")


def _stages(tries: int) -> list[tuple[int, int]]:
    """Most pages have room at one of the first places: the later ones are drawn only if those fail."""
    ends = [0, *(n for n in (2, 6, 18) if n < tries), tries]
    return list(zip(ends, ends[1:]))


def free_box(boxes: Column, w: Column, h: Column, patch_w: Column, patch_h: Column, seed: int, key: Column, tries: int = 60, margin: int = 4) -> Column:
    """The first of ``tries`` seeded places of a patch that keeps ``margin`` away from every box; null if none does or the patch fills the page."""
    def first(a: int, b: int) -> Column:
        places = F.transform(F.sequence(F.lit(a), F.lit(b - 1)), lambda k: seeded_place(k, w, h, patch_w, patch_h, seed, key, margin))
        return F.get(F.filter(places, lambda p: ~F.exists(boxes, lambda o: touches(p, o["box_pixel"], margin))), F.lit(0))

    return F.when((patch_w < w) & (patch_h < h), F.coalesce(*(first(a, b) for a, b in _stages(tries))))


def _plan(op: str, gt: Column, field: Column, **more: Column) -> Column:
    kinds = {"source_box": "array<int>", "paste": "array<int>", "patch_w": "int", "patch_h": "int", "angle": "double", "alpha": "double", "donor_idx": "bigint", "patch_quality": "int", "page_quality": "int"}
    return F.struct(F.lit(op).alias("op"), gt.alias("gt"), field.alias("field"), *(more.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()))


def plan_digit_swap(pages: DataFrame, seed: int = 0, out: str = "digit_swap") -> DataFrame:
    """A glyph-wide slice of another numeric line is pasted into a numeric line, by preference an amount or date."""
    key = F.col("doc_id")
    n, p, c, t_, d_, g, w = spare(pages, "_n", "_p", "_c", "_t", "_d", "_g", "_w")
    df = pages.withColumn(n, F.filter("ocr_boxes", lambda b: b["is_numeric"]))
    df = df.withColumn(p, F.filter(n, lambda b: b["label"].isin(*PREFERRED_LABELS)))
    df = df.withColumn(c, candidates(F.when(F.size(p) > 0, F.col(p)).otherwise(F.col(n))))
    df = df.withColumn(t_, pick(F.col(c), seed, "swap:target", key))
    df = df.withColumn(d_, F.when(F.col(t_).isNotNull(), candidates(F.filter(n, lambda b: b["pos"] != F.col(t_)["pos"]))))
    df = df.withColumn(d_, pick(F.col(d_), seed, "swap:donor", key))
    t, d = [F.element_at(F.col(t_)["box_pixel"], i) for i in range(1, 5)], [F.element_at(F.col(d_)["box_pixel"], i) for i in range(1, 5)]
    line, donor_h = t[3] - t[1], d[3] - d[1]
    df = df.withColumn(g, F.greatest(F.lit(6), F.least(line, d[2] - d[0])))
    glyph = F.col(g)
    df = df.withColumn(w, F.when(donor_h == line, glyph).otherwise(F.greatest(F.lit(4), F.rint(glyph * line / donor_h).cast("int"))))
    middle, last = F.floor((t[0] + t[2]) / 2).cast("int"), F.greatest(t[0], t[2] - F.col(w))
    x = F.when(last > t[0], between(seed, "swap:px", F.when(last > middle, middle).otherwise(t[0]), last, key)).otherwise(t[0])
    y = t[1] + between(seed, "swap:py", F.lit(-1), F.lit(1), key)
    dx = between(seed, "swap:dx", d[0], F.greatest(d[0], d[2] - glyph), key)
    angle = F.when(unit(seed, "swap:turn", key) < 0.7, unit(seed, "swap:angle", key) * 8.0 - 4.0)
    made = _plan("digit_swap", clamp_box(F.col(t_)["box_pixel"], F.col("width"), F.col("height")), label_to_field(F.col(t_)["label"]), source_box=F.array(dx, d[1], dx + glyph, d[3]), paste=F.array(x, y), patch_w=F.col(w), patch_h=line, angle=angle)
    ok = applicable("digit_swap") & F.col(t_).isNotNull() & F.col(d_).isNotNull()
    return df.withColumn(out, F.when(ok, made)).drop(n, p, c, t_, d_, g, w)


def plan_copy_move(pages: DataFrame, seed: int = 0, out: str = "copy_move", crowded: int | None = None) -> DataFrame:
    """A field's patch is pasted where the page is empty.

    Places are tried against every box of the page; on pages with more than ``crowded`` boxes, if given, against those that share a cell of a grid with the place
    (``free_places``: a join by page; doc_id must be unique). The places are the same ones.
    """
    key = F.col("doc_id")
    c, s, to = spare(pages, "_c", "_s", "_to")
    df = pages.withColumn(c, candidates(F.col("ocr_boxes"))).withColumn(s, pick(F.col(c), seed, "move:source", key))
    source = F.col(s)["box_pixel"]
    w, h = box_width(source), box_height(source)
    scan = F.col(s).isNotNull() if crowded is None else F.col(s).isNotNull() & (F.size("ocr_boxes") <= crowded)
    df = df.withColumn(to, F.when(scan, free_box(F.col("ocr_boxes"), F.col("width"), F.col("height"), w, h, seed, key)))
    if crowded is not None:
        many = df.where((F.size("ocr_boxes") > crowded) & F.col(s).isNotNull())
        found = free_places(many.select("doc_id", "ocr_boxes", "width", "height", w.alias("patch_w"), h.alias("patch_h")), seed)
        (place,) = spare(df, "_place")
        df = df.join(found.withColumnRenamed("place", place).hint("merge"), "doc_id", "left").withColumn(to, F.coalesce(F.col(to), F.col(place)))
    alpha = F.when(unit(seed, "move:blend", key) < 0.6, 0.1 + 0.15 * unit(seed, "move:alpha", key))
    made = _plan("copy_move", clamp_box(F.col(to), F.col("width"), F.col("height")), label_to_field(F.col(s)["label"]), source_box=source, paste=F.slice(to, 1, 2), patch_w=w, patch_h=h, alpha=alpha)
    return df.select(*pages.columns, F.when(F.col(to).isNotNull(), made).alias(out))


def plan_splice(pages: DataFrame, seed: int = 0, out: str = "splice") -> DataFrame:
    """A donor crop of the same split and source is resized over a field; needs n_donors."""
    key = F.col("doc_id")
    c, t_ = spare(pages, "_c", "_t")
    df = pages.withColumn(c, candidates(F.col("ocr_boxes"))).withColumn(t_, pick(F.col(c), seed, "splice:target", key))
    t = F.col(t_)["box_pixel"]
    made = _plan("splice", clamp_box(t, F.col("width"), F.col("height")), label_to_field(F.col(t_)["label"]), paste=F.slice(t, 1, 2), patch_w=F.greatest(F.lit(4), box_width(t)), patch_h=F.greatest(F.lit(4), box_height(t)), donor_idx=below(seed, "splice:donor", F.col("n_donors"), key))
    return df.withColumn(out, F.when(applicable("splice") & F.col(t_).isNotNull(), made)).drop(c, t_)


def plan_recompress_ghost(pages: DataFrame, seed: int = 0, out: str = "recompress_ghost") -> DataFrame:
    """A patch of at least 10 x 10 is recompressed and pasted 1 to 4 pixels off its place, both ways alike, kept on the page; then the whole page is
    recompressed at a lower quality. Not among the default operations."""
    key = F.col("doc_id")
    c, t_, off = spare(pages, "_c", "_t", "_off")
    df = pages.withColumn(c, candidates(F.col("ocr_boxes"), min_w=10, min_h=10)).withColumn(t_, pick(F.col(c), seed, "ghost:target", key))
    t = F.col(t_)["box_pixel"]
    df = df.withColumn(off, between(seed, "ghost:shift", F.lit(1), F.lit(4), key))
    place = [F.greatest(F.lit(0), F.least(F.element_at(t, i) + F.col(off), F.col(side) - extent)) for i, side, extent in ((1, "width", box_width(t)), (2, "height", box_height(t)))]
    quality = lambda purpose, values: F.get(F.array(*map(F.lit, values)), below(seed, purpose, F.lit(len(values)), key).cast("int"))
    made = _plan("recompress_ghost", clamp_box(t, F.col("width"), F.col("height")), label_to_field(F.col(t_)["label"]), source_box=t, paste=F.array(*place), patch_w=box_width(t), patch_h=box_height(t), patch_quality=quality("ghost:patch", PATCH_QUALITIES), page_quality=quality("ghost:page", PAGE_QUALITIES))
    return df.withColumn(out, F.when(F.col(t_).isNotNull(), made)).drop(c, t_, off)


@dataclass(frozen=True)
class ForgeryOp:
    """An operation: when it can be tried on a page, and its plan column (``plan(pages, seed, out)`` adds it, null where it fails).

    New ones go where names of operations go, or into OPS; the pixel step takes what it does to the image by the same name (``pixels.STEPS``).
    """

    name: str
    plan: Callable[..., DataFrame]
    applicable: Callable[[], Column] = has_boxes


OPS = {
    op.name: op
    for op in (
        ForgeryOp("digit_swap", plan_digit_swap, lambda: F.size(F.filter("ocr_boxes", lambda b: b["is_numeric"])) >= 2),
        ForgeryOp("copy_move", plan_copy_move),
        ForgeryOp("splice", plan_splice, lambda: has_boxes() & (F.col("n_donors") > 0)),
        ForgeryOp("recompress_ghost", plan_recompress_ghost),
    )
}


def planned(pages: DataFrame, seed: int = 0, ops: Iterable[str | ForgeryOp] = OP_NAMES) -> DataFrame:
    """Adds ``plans``: the plans of the operations that can be tried on the page and work, in its seeded order."""
    chosen = [OPS[op] if isinstance(op, str) else op for op in ops]
    df, names = pages, spare(pages, *(f"_op_{op.name}" for op in chosen))
    for op, name in zip(chosen, names):
        df = op.plan(df, seed, name)
    keyed = F.array(*(F.struct(order_key(seed, "order", F.col("doc_id"), op.name).alias("k"), F.when(op.applicable(), F.col(name)).alias("plan")) for op, name in zip(chosen, names)))
    plans = F.transform(F.array_sort(F.filter(keyed, lambda e: e["plan"].isNotNull())), lambda e: e["plan"])
    return df.withColumn("plans", plans).drop(*names)


def records(df: DataFrame, chosen: Column, keep: Iterable[str] = ()) -> DataFrame:
    """A training record for each of the chosen plans (a null plan is the clean record)."""
    rows = df.select(*keep, "source", "doc_id", "width", "height", F.explode(chosen).alias("plan"))
    bad = F.col("plan").isNotNull()
    reason = F.when(bad, reason_for(F.col("plan.op"), F.col("plan.field"))).otherwise(F.lit(CLEAN_REASON))
    return rows.select(*keep, F.lit(None).cast("string").alias("image_path"), "source", "doc_id", "width", "height", bad.alias("tampered"), F.col("plan.field").alias("field"), F.col("plan.op").alias("tamper_type"), F.col("plan.gt").alias("box_pixel"), reason.alias("reason"), "plan")


def _clean() -> Column:
    return F.array(F.lit(None).cast(PLAN))


def forge_variants(pages: DataFrame, n_tampered: int = 2, seed: int = 0, ops: Iterable[str | ForgeryOp] = OP_NAMES, keep: Iterable[str] = ()) -> DataFrame:
    """A clean record of each page and up to n_tampered with distinct operations, in the page's seeded order."""
    return records(planned(pages, seed, ops), F.concat(_clean(), F.slice("plans", 1, n_tampered)), keep)


def forge_one(pages: DataFrame, p_clean: float = 0.5, seed: int = 0, ops: Iterable[str | ForgeryOp] = OP_NAMES, keep: Iterable[str] = ()) -> DataFrame:
    """One record of each page: clean with probability p_clean or if nothing works, else the first operation that does."""
    chosen = F.when((unit(seed, "clean", F.col("doc_id")) < p_clean) | (F.size("plans") == 0), _clean()).otherwise(F.slice("plans", 1, 1))
    return records(planned(pages, seed, ops), chosen, keep)


def corpus_sample(pages: DataFrame, p_clean: float = 0.5, seed: int = 0) -> DataFrame:
    """forge_one over a whole corpus, with donors from all of it."""
    pool = harvest_donors(pages, split=None)
    return forge_one(with_donor_counts(pages, pool, split=None), p_clean, seed)


def with_donor_boxes(recs: DataFrame, donors: DataFrame, split: str | None = "split") -> DataFrame:
    """Adds donor_doc_id and donor_box of splices (null otherwise): what the pixel step crops."""
    groups = [c for c in (split, "source") if c]
    (i,) = spare(recs, "_i")
    pool = donors.select(*groups, F.col("donor_idx").alias(i), F.col("doc_id").alias("donor_doc_id"), F.col("box_pixel").alias("donor_box"))
    cond = [recs[g] == pool[g] for g in groups] + [recs["plan.donor_idx"] == pool[i]]
    joined = recs.join(pool, cond, "left")
    return joined.select(*(recs[c] for c in recs.columns), "donor_doc_id", "donor_box")
