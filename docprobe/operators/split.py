"""Splits without leakage, class balance, and the row selections that training makes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docprobe.operators.names import refuse, spare
from docprobe.operators.sampling import below, order_key

SPLITS = ("train", "val", "test")


def distinct_ids(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """The distinct ids in ascending order."""
    return df.select(key).distinct().orderBy(key)


def ranked(df: DataFrame, key: str, order: str, rank: str = "rank") -> DataFrame:
    """Adds ``rank`` (1-based over the whole table by ``order``, an md5 text, then key) without a one-task window.

    The first three hex digits of the order make 4096 slices of even size; slice counts (at most 4096 numbers)
    give each slice its offset, and a window ranks within it.
    """
    refuse(df, rank)
    part, ahead = spare(df, "_s", "_b")
    sliced = df.withColumn(part, F.substring(order, 1, 3))
    counts = sorted(map(tuple, sliced.groupBy(part).count().collect()))
    starts, before = {}, 0
    for s, n in counts:
        starts[s] = before
        before += n
    if not starts:
        return df.withColumn(rank, F.lit(0).cast("bigint"))
    base = df.sparkSession.createDataFrame(sorted(starts.items()), f"{part} string, {ahead} bigint")
    window = Window.partitionBy(part).orderBy(order, key)
    within = sliced.withColumn(rank, F.row_number().over(window)).join(F.broadcast(base), part)
    return within.select(*df.columns, (F.col(ahead) + F.col(rank)).alias(rank))


def assign_splits(df: DataFrame, ratios: dict[str, float], seed: int = 0, key: str = "doc_id") -> DataFrame:
    """key, split: ids in a seeded order, cut after round(n * train) and round(n * val) of them; the rest is test."""
    ids = df.select(key).distinct()
    order, rank = spare(ids, "_o", "_rank")
    got = ranked(ids.withColumn(order, order_key(seed, "split", F.col(key))), key, order, rank)
    n = ids.count()
    first, second = round(n * ratios["train"]), round(n * ratios["val"])
    return got.select(key, F.when(F.col(rank) <= first, "train").when(F.col(rank) <= first + second, "val").otherwise("test").alias("split"))


def leaked_ids(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids that occur in more than one split."""
    return df.groupBy(key).agg(F.min("split").alias("_lo"), F.max("split").alias("_hi")).where("_lo <> _hi").select(key)


def assert_no_leakage(df: DataFrame, key: str = "doc_id") -> None:
    found = leaked_ids(df, key).take(1)
    if found:
        raise AssertionError(f"LEAKAGE: {key} {found[0][0]!r} is in more than one split")


def group_docs(df: DataFrame, splits: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows with their split; the split table has one narrow row an id, and AQE broadcasts it if it is small."""
    return df.join(splits, key)


def balance(df: DataFrame, key: str, flag: str = "tampered", seed: int = 0) -> DataFrame:
    """All rows, and copies of the rarer class (picked with replacement) until both are equal; ``copy`` is 0 for originals.

    key: a unique column. Nothing is added if a class is empty. A table that has a column ``copy`` is refused. Copies find their row by its rank in a
    seeded order, so the join is on one number, spread evenly.
    """
    refuse(df, "copy")
    both = dict(map(tuple, df.groupBy(flag).count().collect()))
    yes, no = both.get(True, 0), both.get(False, 0)
    out = df.withColumn("copy", F.lit(0).cast("bigint"))
    if not yes or not no or yes == no:
        return out
    rare, small, large = yes < no, min(yes, no), max(yes, no)
    order, rank = spare(out, "_o", "_rank")
    rows = ranked(df.where(F.col(flag) == rare).withColumn(order, order_key(seed, "rank", F.col(key))), key, order, rank)
    picks = df.sparkSession.range(1, large - small + 1).select(F.col("id").alias("copy"), (below(seed, "copy", F.lit(small), F.col("id")) + 1).alias(rank))
    return out.unionByName(rows.join(picks, rank).select(*df.columns, "copy"))


def shuffled(df: DataFrame, *keys: str, seed: int = 0) -> DataFrame:
    """The rows in a seeded order."""
    return df.orderBy(order_key(seed, "shuffle", *map(F.col, keys)), *keys)


def keep_first_clean(df: DataFrame, order: str, path: str = "image_path", flag: str = "tampered") -> DataFrame:
    """Every tampered row, and of clean rows with one path the first by ``order``."""
    (k,) = spare(df, "_k")
    rank = F.row_number().over(Window.partitionBy(path, flag).orderBy(order))
    return df.withColumn(k, F.when(F.col(flag), F.lit(1)).otherwise(rank)).where(F.col(k) == 1).drop(k)


def round_robin(df: DataFrame, n: int, order: str, kind: str = "tamper_type", flag: str = "tampered") -> DataFrame:
    """n rows: n // 2 tampered ones taken in turn from the kinds (in order of first appearance), then the first clean ones."""
    r, f = spare(df, "_r", "_f")
    by_kind = Window.partitionBy(kind)
    turns = df.where(flag).withColumn(r, F.row_number().over(by_kind.orderBy(order))).where(F.col(r) <= max(n // 2, 1))
    turns = turns.withColumn(f, F.min(order).over(by_kind))
    bad = turns.orderBy(r, f, order).limit(n // 2).drop(r, f)
    taken = bad.count()
    good = df.where(~F.col(flag)).orderBy(order).limit(n - taken)
    return bad.unionByName(good).orderBy(order)


def first_per_group(df: DataFrame, n: int, order: list[str], *groups: str) -> DataFrame:
    """The first n rows of each group."""
    (k,) = spare(df, "_k")
    return df.withColumn(k, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(k) <= n).drop(k)


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)
