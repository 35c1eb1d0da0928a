"""Verdicts as text: rendering targets, parsing completions, labels, paths. All of it as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docprobe.functions.geometry import pixel_to_norm

# --- fixed values ---
BOX_START, BOX_END = "<|box_start|>", "<|box_end|>"
CLEAN_REASONS = (
    "No inconsistencies detected.",
    "No visual evidence of tampering found.",
    "Document layout and font structures are consistent.",
    "All text fields appear authentic.",
    "Fonts, spacing, and alignment are uniform throughout.",
    "No signs of digit or field alteration.",
    "Ink, stroke weight, and baselines are consistent across the document.",
    "No copy-paste or splice artifacts detected.",
    "The document appears original and unmodified.",
    "Field values are consistent with the surrounding text.",
    "No compression or edge artifacts found around any field.",
    "Nothing indicates the document has been edited.",
)
CLEAN_REASON = CLEAN_REASONS[0]
BOX_PATTERN = r"\(\s*(\d+)\s*,\s*(\d+)\s*\)\s*,\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)"
REASONS = {
    "digit_swap": "The %s field appears altered: a digit was overwritten and its stroke weight and edges differ from the surrounding characters.",
    "copy_move": "The %s region shows copy-move tampering; a duplicated patch with matching texture was pasted into otherwise empty space.",
    "splice": "The %s field was spliced from another document; font and lighting differ from the surrounding text at the region edges.",
    "recompress_ghost": "The %s region shows double-compression (JPEG ghosting) artifacts inconsistent with the rest of the image.",
}
# --- end of fixed values ---

PREDICTION = "struct<tampered:boolean,field:string,box:string,box_norm:array<bigint>,reason:string>"
#: Decimal digits of other scripts start at these code points (ten in a row); a rule for Java's Unicode digit class.
_DIGIT_ZEROS = (0x660, 0x6F0, 0x7C0, 0x966, 0x9E6, 0xA66, 0xAE6, 0xB66, 0xBE6, 0xC66, 0xCE6, 0xD66, 0xE50, 0xED0, 0xF20, 0x1040, 0x17E0, 0x1810, 0xFF10)


def md5_mod12(key: Column) -> Column:
    """md5 of the key as a number, mod 12. 2**32 is 4 mod 12, and so is every power of it: the four 32-bit chunks fold."""
    digest = F.md5(F.coalesce(key, F.lit("")).cast("binary"))
    chunk = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]
    return F.pmod(4 * (chunk[0] + chunk[1] + chunk[2]) + chunk[3], F.lit(12)).cast("int")


def clean_reason(key: Column) -> Column:
    """One of the twelve clean reasons, the same for a key everywhere."""
    return F.element_at(F.array(*map(F.lit, CLEAN_REASONS)), md5_mod12(key) + 1)


def format_box(box: Column) -> Column:
    """Four numbers (cut to integers) as box text; a null or a box of another length is an error."""
    n = [F.element_at(box, i).cast("bigint") for i in range(1, 5)]
    text = F.format_string(f"{BOX_START}(%d,%d),(%d,%d){BOX_END}", *n)
    return F.when(box.isNotNull() & (F.size(box) == 4), text).otherwise(F.raise_error(F.lit("format_box: expected 4 ints")))


def _ascii_digits(s: Column) -> Column:
    other = "".join(chr(z + d) for z in _DIGIT_ZEROS for d in range(10))
    return F.translate(s, other, "0123456789" * len(_DIGIT_ZEROS))


def parse_box(text: Column) -> Column:
    """The first (x1,y1),(x2,y2) anywhere in the text as ARRAY<BIGINT>, else null; a number beyond BIGINT becomes the greatest one."""
    pattern = "(?U)" + BOX_PATTERN
    first = F.regexp_extract(text, pattern, 0)
    numbers = F.array(*(F.coalesce(_ascii_digits(F.regexp_extract(first, pattern, g)).try_cast("bigint"), F.lit((1 << 63) - 1)) for g in range(1, 5)))
    return F.when(first != "", numbers)


def quoted(s: Column) -> Column:
    """A JSON string (or null), quotes and all, other characters as they are."""
    arr = F.to_json(F.array(s))
    return F.when(s.isNull(), F.lit("null")).otherwise(F.substring(arr, F.lit(2), F.length(arr) - 2))


def target_json(tampered: Column, field: Column, box_pixel: Column, w: Column, h: Column, reason: Column, image_path: Column) -> Column:
    """What a model should answer; clean rows take their reason from the image path. Tampered without a box is an error."""
    box = F.when(box_pixel.isNull(), F.raise_error(F.lit("target_json: tampered record without box_pixel"))).otherwise(format_box(pixel_to_norm(box_pixel, w, h)))
    altered = F.concat(F.lit('{"tampered": true, "field": '), quoted(field), F.lit(', "box": '), quoted(box), F.lit(', "reason": '), quoted(reason), F.lit("}"))
    clean = F.concat(F.lit('{"tampered": false, "field": null, "box": null, "reason": '), quoted(clean_reason(image_path)), F.lit("}"))
    return F.when(F.coalesce(tampered, F.lit(False)), altered).otherwise(clean)


def first_json_object(text: Column) -> Column:
    """From the first ``{`` to the brace that closes it (braces inside strings do not count); null if none closes.

    The text is cut into string literals and single braces by one pattern, so that the fold runs over those pieces
    instead of characters: depth after each piece, and the length up to the piece that first brings it back to 0.
    """
    tail = F.substring(text, F.instr(text, "{"), F.length(text))
    pieces = F.regexp_extract_all(tail, F.lit(r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"?+|[{}]|[^"{}]++'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, p: Column) -> Column:
        depth = s["depth"] + F.when(p == "{", 1).when(p == "}", -1).otherwise(0)
        at = s["at"] + F.length(p)
        return F.struct(depth.alias("depth"), at.alias("at"), F.when(s["end"] > 0, s["end"]).when((p == "}") & (depth == 0), at).otherwise(0).alias("end"))

    end = F.aggregate(pieces, start, step)["end"]
    return F.when((F.instr(text, "{") > 0) & (end > 0), F.substring(tail, F.lit(1), end))


def parse_prediction(text: Column) -> Column:
    """The completion's verdict as a struct (PREDICTION), or null if there is none of the right types.

    Of a key said twice the last value counts; NaN and Infinity are numbers.
    """
    keys = ("tampered", "field", "box", "reason")
    v = F.from_json(first_json_object(text), ", ".join(f"{k} variant" for k in keys), {"allowSingleQuotes": "false"})

    def kind(key: str) -> Column:
        return F.schema_of_variant(v[key])

    def optional(key: str) -> Column:
        return F.coalesce(kind(key).isin("VOID", "STRING"), F.lit(True))

    def value(key: str) -> Column:
        return F.when(kind(key) == "STRING", F.try_variant_get(v[key], "$", "string"))

    fits = F.coalesce(kind("tampered") == "BOOLEAN", F.lit(False)) & optional("field") & optional("box") & optional("reason")
    made = F.struct(F.try_variant_get(v["tampered"], "$", "boolean").alias("tampered"), value("field").alias("field"), value("box").alias("box"), parse_box(value("box")).alias("box_norm"), value("reason").alias("reason"))
    return F.when(fits, made)


def is_numeric(text: Column) -> Column:
    """Whether a digit of any script occurs."""
    return F.rlike(F.coalesce(text, F.lit("")), F.lit(r"(?U)\d"))


def strip_bio(tag: Column) -> Column:
    """``B-HEADER`` to ``header``; nothing, or ``O``, to ``other``."""
    return F.when(F.coalesce(tag, F.lit("")).isin("", "O"), F.lit("other")).otherwise(F.lower(F.regexp_replace(tag, r"(?s)^[^-]*-", "")))


def label_to_field(label: Column) -> Column:
    return F.coalesce(F.nullif(label, F.lit("")), F.lit("field"))


def doc_seed(doc_id: Column, seed: int) -> Column:
    """A 32-bit seed of a document."""
    return F.crc32(doc_id.cast("string").cast("binary")).bitwiseXOR(F.lit(seed & 0xFFFFFFFF)).cast("bigint")


def variant_tag(tampered: Column, tamper_type: Column) -> Column:
    return F.when(tampered, tamper_type).otherwise(F.lit("clean"))


def image_path(split: Column, doc_id: Column, tag: Column, fmt: str = "jpg") -> Column:
    """images/<split>/<doc>__<variant>.<jpg or png>"""
    ext = "jpg" if fmt.lower() in ("jpg", "jpeg") else "png"
    return F.concat(F.lit("images/"), split, F.lit("/"), doc_id.cast("string"), F.lit("__"), tag, F.lit(f".{ext}"))


def image_uri(path: Column, data_root: str | None = None) -> Column:
    """file:// and the absolute path. ``data_root`` leads relative paths; ``.`` and ``..`` are resolved."""
    import os

    root = os.path.abspath(data_root or os.getcwd())
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    steps = F.filter(F.split(whole, "/"), lambda s: ~s.isin("", "."))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    return F.concat(F.lit("file:///"), F.array_join(F.when(whole.contains("/."), kept).otherwise(steps), "/"))


def reason_for(op: Column, field: Column) -> Column:
    """The reason of a forgery, with its field named."""
    out = F.lit(None).cast("string")
    for name, pattern in REASONS.items():
        before, after = pattern.split("%s")
        out = F.when(op == name, F.concat(F.lit(before), field, F.lit(after))).otherwise(out)
    return out
