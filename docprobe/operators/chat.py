"""Records as chat messages, and the loss mask over token ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docprobe.functions.codec import image_uri, target_json

# --- fixed values ---
SYSTEM_PROMPT = (
    "You are a document forensics expert. Given a document image, determine "
    "whether any field has been tampered with. Respond ONLY with a compact JSON "
    "object with keys: tampered (bool), field (string or null), box (string "
    "format '<|box_start|>(x1,y1),(x2,y2)<|box_end|>' in 0-1000 normalized "
    "coordinates, or null), reason (string). If untampered, set tampered=false, "
    "field=null, box=null."
)
USER_INSTRUCTION = "Inspect this document for tampering."
IGNORED = -100
# --- end of fixed values ---

CONTENT = "struct<type:string,text:string,image:string>"
MESSAGES = f"array<struct<role:string,content:array<{CONTENT}>>>"


def _part(text: Column | None = None, image: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(F.lit("text" if image is None else "image").alias("type"), (null if text is None else text).alias("text"), (null if image is None else image).alias("image"))


def _message(role: str, *parts: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))


def messages(data_root: str | None = None, include_target: bool = True) -> Column:
    """System, user (image and instruction) and, for training, assistant (target). Reads the columns of a record."""
    out = [_message("system", _part(F.lit(SYSTEM_PROMPT))), _message("user", _part(image=image_uri(F.col("image_path"), data_root)), _part(F.lit(USER_INSTRUCTION)))]
    if include_target:
        out.append(_message("assistant", _part(target_json(*(F.col(c) for c in ("tampered", "field", "box_pixel", "width", "height", "reason", "image_path"))))))
    return F.array(*out)


def loss_mask(df: DataFrame, start_id: int, end_id: int, pad_id: int, image_id: int, header: int, ids: str = "input_ids") -> DataFrame:
    """Adds labels, terminated, truncated and learnable to rows of token ids.

    Labels repeat the ids after the last ``start_id`` and the ``header`` ids that follow it; everything else, padding and image
    ids are IGNORED. A row without start_id is an error. truncated: the completion is empty or has no end_id. learnable: labels that count.
    """
    n, seq = F.size(ids), F.col(ids)
    at = F.array_position(F.reverse(seq), start_id)
    begin = F.when(at > 0, n - at + 1 + header).otherwise(F.raise_error(F.lit("loss_mask: no start token in the row")).cast("bigint"))
    out = df.withColumn("_b", begin.cast("int"))
    labels = F.transform(seq, lambda t, i: F.when((i < F.col("_b")) | t.isin(pad_id, image_id), F.lit(IGNORED)).otherwise(t.cast("int")))
    real = F.aggregate(F.transform(seq, lambda t, i: F.when(t != pad_id, i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    done = F.slice(seq, F.col("_b") + 1, F.greatest(real - F.col("_b"), F.lit(0)))
    out = out.withColumn("labels", labels).withColumn("terminated", F.array_contains(done, end_id)).withColumn("truncated", (F.col("_b") >= real) | ~F.array_contains(done, end_id))
    return out.withColumn("learnable", F.size(F.filter("labels", lambda t: t != IGNORED))).drop("_b")


def padded(ids: Column, length: Column | int, pad_id: int) -> Column:
    """Padded on the right to a length, and cut there."""
    size = length if isinstance(length, Column) else F.lit(length)
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad_id), size)), F.lit(1), size)


@dataclass(frozen=True)
class Special:
    """Ids with a meaning: start and end of a turn, padding, an image's place; header: ids between a start and the turn's text."""

    start: int
    end: int
    pad: int
    image: int
    header: int


#: All messages of some records -> their token ids (a chat template and a tokenizer).
Tokenizer = Callable[[list], Sequence[Sequence[int]]]


def collate(df: DataFrame, make: Callable[[], Tokenizer], special: Special, build: Column | None = None, max_length: int = 2048, batch: int = 8) -> DataFrame:
    """Records as training rows: input_ids, attention_mask, and what ``loss_mask`` adds.

    ``build`` makes the messages (default: ``messages()``); ``make`` loads the tokenizer once in each task, on the executor. Every ``batch`` rows that come
    together are padded on the right to the longest of them; longer ones than ``max_length`` are cut.
    """
    kept = df.columns
    ids = T.ArrayType(T.IntegerType())
    schema = T.StructType([*df.schema.fields, T.StructField("input_ids", ids), T.StructField("attention_mask", ids)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = make()
        for rows in batches:
            got = [list(t)[:max_length] for t in tokens(rows["_messages"].tolist())]
            longest = [max(map(len, got[i - i % batch : i - i % batch + batch])) for i in range(len(got))]
            yield rows[kept].assign(input_ids=[t + [special.pad] * (n - len(t)) for t, n in zip(got, longest)], attention_mask=[[1] * len(t) + [0] * (n - len(t)) for t, n in zip(got, longest)])

    given = df.withColumn("_messages", messages() if build is None else build)
    return loss_mask(given.mapInPandas(run, schema), special.start, special.end, special.pad, special.image, special.header)
