"""Raw pages of two layouts into one nested schema: source, doc_id, width, height, image, ocr_boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprobe.functions.codec import is_numeric, strip_bio
from docprobe.functions.geometry import form_box_to_pixel, has_area, quad_to_bbox

BOX = "struct<text:string,box_pixel:array<int>,label:string,is_numeric:boolean>"


def _box(text: Column, box: Column, label: Column) -> Column:
    return F.struct(text.alias("text"), box.alias("box_pixel"), label.alias("label"), is_numeric(text).alias("is_numeric"))


def _page(df: DataFrame, source: str, split: str, ordinal: str, boxes: Column) -> DataFrame:
    kept = F.filter(boxes, lambda b: has_area(b["box_pixel"]))
    doc = F.concat(F.lit(f"{source}-{split}-"), F.col(ordinal).cast("string"))
    return df.select(F.lit(source).alias("source"), doc.alias("doc_id"), F.col("image.width").cast("int").alias("width"), F.col("image.height").cast("int").alias("height"), "image", F.coalesce(kept, F.array().cast(f"array<{BOX}>")).alias("ocr_boxes"))


def normalise_receipts(df: DataFrame, source: str = "sroie", split: str = "train", ordinal: str = "ordinal") -> DataFrame:
    """image, ocr[{box: quad, label?, text?}]: a field that the layout lacks gets its default, a null in it stays null."""
    fields = {f.name for f in df.schema["ocr"].dataType.elementType.fields}

    def one(e: Column) -> Column:
        return _box(e["text"] if "text" in fields else F.lit(""), quad_to_bbox(e["box"]), e["label"] if "label" in fields else F.lit("other"))

    return _page(df, source, split, ordinal, F.transform("ocr", one))


def tag_label(tag: Column, names: list[str] | None) -> Column:
    """A class number's name without its BIO prefix; the number as text if there are no names. Out of range is an error."""
    if not names:
        return tag.cast("string")
    return strip_bio(F.element_at(F.array(*map(F.lit, names)), tag + 1))


def normalise_forms(df: DataFrame, source: str = "funsd", split: str = "train", names: list[str] | None = None, ordinal: str = "ordinal") -> DataFrame:
    """image, words[], bboxes[] (0..1000), ner_tags[]: zipped up to the shortest of the three."""
    n = F.least(F.size("words"), F.size("bboxes"), F.size("ner_tags"))
    rows = F.arrays_zip(F.slice("words", F.lit(1), n).alias("word"), F.slice("bboxes", F.lit(1), n).alias("box"), F.slice("ner_tags", F.lit(1), n).alias("tag"))
    w, h = F.col("image.width"), F.col("image.height")
    return _page(df, source, split, ordinal, F.transform(rows, lambda r: _box(r["word"], form_box_to_pixel(r["box"], w, h), tag_label(r["tag"], names))))



def ingest_stats(pages: DataFrame) -> DataFrame:
    """kind (docs, boxes, numeric), key, n: pages a source, boxes a ``source:label``, numeric boxes in all."""
    boxes = pages.select("source", F.explode("ocr_boxes").alias("b"))
    docs = pages.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(F.lit("docs").alias("kind"), F.col("source").alias("key"), "n")
    by_label = boxes.groupBy(F.concat_ws(":", "source", "b.label").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("boxes").alias("kind"), "key", "n")
    numeric = boxes.agg(F.count_if("b.is_numeric").alias("n")).select(F.lit("numeric").alias("kind"), F.lit("").alias("key"), "n")
    return docs.unionByName(by_label).unionByName(numeric)
