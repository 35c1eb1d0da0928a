"""Record checks: one column of violation codes instead of the first exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED = ("image_path", "width", "height", "tampered", "field", "tamper_type", "box_pixel", "reason")


def violations(df: DataFrame) -> Column:
    """ARRAY<STRING> of codes, in the order of the checks; empty for a good record. A missing column is a code on every row."""
    missing = [F.lit(f"missing:{c}") for c in REQUIRED if c not in df.columns]
    if missing:
        return F.array(*missing)
    kinds = dict(df.dtypes)
    c = {k: F.col(k) for k in REQUIRED}
    yes = F.coalesce(c["tampered"], F.lit(False))
    box = [F.element_at("box_pixel", i) for i in range(1, 5)]
    good_box = c["box_pixel"].isNotNull() & (F.size("box_pixel") == 4) & ~F.exists("box_pixel", lambda v: v.isNull())
    blank = lambda k: F.coalesce(c[k], F.lit("")) == ""
    checks: list[tuple[str, Column]] = [
        ("image_path", F.lit(kinds["image_path"] != "string") | blank("image_path")),
        ("width", c["width"].isNull() | (c["width"] <= 0)),
        ("height", c["height"].isNull() | (c["height"] <= 0)),
        ("tampered", F.lit(kinds["tampered"] != "boolean") | c["tampered"].isNull()),
        ("reason", F.lit(kinds["reason"] != "string") | c["reason"].isNull()),
        ("box", yes & ~good_box),
        ("box_order", yes & F.when(good_box, (box[2] <= box[0]) | (box[3] <= box[1])).otherwise(False)),
        ("field", yes & blank("field")),
        ("tamper_type", yes & blank("tamper_type")),
        ("clean_field", c["tampered"].isNotNull() & ~yes & c["field"].isNotNull()),
        ("clean_tamper_type", c["tampered"].isNotNull() & ~yes & c["tamper_type"].isNotNull()),
        ("clean_box", c["tampered"].isNotNull() & ~yes & c["box_pixel"].isNotNull()),
    ]
    return F.filter(F.array(*(F.when(bad, F.lit(code)) for code, bad in checks)), lambda x: x.isNotNull())


def require_valid(df: DataFrame) -> DataFrame:
    """The rows as they are; the first bad one stops the job."""
    found = violations(df)
    guard = F.when(F.size(found) == 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("invalid record: "), F.array_join(found, ","))).cast("boolean"))
    return df.where(guard)
