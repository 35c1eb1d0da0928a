"""Shared pieces of the training-data operators: word pattern, folds, Arrow mapping, scratch tables."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docprobe.sources.scratch import fresh, shuffles_deleted

#: A word: a run of characters other than space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(df: DataFrame) -> Column:
    """The text column, null read as empty."""
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def lowered(text: str) -> str:
    """Lower case in which every character keeps its place (what would become two characters stays)."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learnt from: crc32 of the id as text, mod 4, is 2 (a null id: false)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def hash01(*cols: Column) -> Column:
    """A reproducible number in [0, 1) from the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def release_memory() -> None:
    """Gives freed memory back to the system at the end of a task: idle workers count against the executor too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: What a Python worker keeps between tasks: module -> the cached function in it. A task of another module lets go of it.
KEPT = {"docprobe.llm.tokens": "encoder", "docprobe.llm.language_id": "automata"}


#: Rows that an operator sees at a time, whatever the session's batch size is.
ROWS_AT_ONCE = 2000


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, keeps: str = "") -> DataFrame:
    """mapInArrow whose batches are cut into pieces of at most ``ROWS_AT_ONCE`` rows.

    The session's limits on bytes and rows of an Arrow batch hold as the caller set them. ``keeps`` names the module whose cache the
    worker holds on to.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield batch.slice(a, ROWS_AT_ONCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for module, cache in KEPT.items():
            if module != keeps and module in sys.modules:
                getattr(sys.modules[module], cache).cache_clear()
        try:
            yield from fn(pieces(batches))
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


def runs_of_texts(batch: pa.RecordBatch, column: int, rows: int = 500, bytes_: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``rows`` rows and, unless a text is longer by itself, ``bytes_`` bytes of text."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    a = held = 0
    for b, n in enumerate(sizes):
        if b > a and (b - a >= rows or held + n > bytes_):
            yield batch.slice(a, b - a)
            a, held = b, 0
        held += n
    if a < len(sizes):
        yield batch.slice(a)


def stored(df: DataFrame, name: str, rows: int | None = None, per_file: int = 200_000) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back: cuts lineage, survives lost executors; the shuffles that made them go.

    rows: an upper bound of their number, where one is known; then there is one file for each ``per_file`` of them, so that the many
    small tables of an iteration are not cut into as many files as there are shuffle partitions.
    """
    path = fresh(df.sparkSession, name)
    with shuffles_deleted(df.sparkSession):
        (df if rows is None else df.coalesce(max(1, -(-rows // per_file)))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A group of more rows than this, and than a thousandth of the table, is crowded.
CROWDED = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, spread: Column) -> DataFrame:
    """The rows and ``group``, a struct of the other columns of the row of ``groups`` (keys, n, ...) with their keys; null if there is none.

    n is a group's number of rows, and total theirs altogether, so at most a thousand groups are crowded. Those are broadcast; their rows are dealt
    by ``spread`` (a column that tells them apart) in the shuffle join with the others, in which no key then holds more than a thousandth of the rows.
    """
    limit = max(CROWDED, total // 1000)
    rest = [c for c in groups.columns if c not in keys]
    crowded = groups.where(F.col("n") > limit).select(*keys, F.struct(*rest).alias("crowded"))
    others = groups.where(F.col("n") <= limit).select(*keys, F.lit(0).cast("bigint").alias("salt"), F.struct(*rest).alias("other"))
    met = rows.join(F.broadcast(crowded), keys, "left")
    met = met.withColumn("salt", F.when(F.col("crowded").isNull(), F.lit(0).cast("bigint")).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 40))))
    return met.join(others, [*keys, "salt"], "left").select(*rows.columns, F.coalesce("crowded", "other").alias("group"))
