"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same number of expected copies, target / source size. Prefix sums of expected
copies run over the source's documents; one random offset (from the seed and the source) is added, and a document is taken once for each integer that its
interval crosses. Documents stand in order of size, so that neighbours are alike: the words taken differ from the target by less than
about the largest document. Equal sizes stand in the order of an md5 of id and text, which is the same at every size of the table.

Targets share out all sizes by weight (5, 2, 1, repeating over the sources by code point, null last); no source gets more than
``most`` times its own size, and the excess goes to the others by weight until none is above.

Texts are read once, into a stored table of (source, id, size, md5, how many rows are alike in these). Only that table is ranked: counts by
(source, size, slice) give the offset, a window within such a group the rest. Slices cut a size with many documents by
ranges of the md5, about ``ROWS_PER_SLICE`` each; they change no order, and so no result. Rows alike in source, id and text are one row of
the table with a count, whatever their number: they are counted before any shuffle and told apart again only in the output, in runs of ``RUN``.
``mixed_rows`` joins the copies back to whole documents.

Defined results: null text has size 0; an empty source (all sizes 0) has target 0 and is not taken; repeated rows are sampled each for itself, null ids are
kept; texts of any length count whole; an empty table gives no rows; other columns are ignored (``mixed_rows`` keeps them), also those named like a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docprobe.llm.common import WORD, stored, text_of

WEIGHTS = (5.0, 2.0, 1.0)
ROWS_PER_SLICE, RUN = 1_000_000, 100_000


def _queue(docs: DataFrame) -> Column:
    return F.coalesce(F.concat(F.lit("s"), docs["source"].cast("string")), F.lit("n"))


def _order(docs: DataFrame) -> Column:
    """md5 of id and text: the order within a size, and what tells documents apart."""
    return F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("null")), F.lit(":"), text_of(docs)).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """The columns of ``sizes`` (source, source_size) and target: water filling in closed form over the (few) sources."""
    ranked = sizes.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(most))
    by_level = Window.orderBy((F.col("cap") / F.col("w")).asc(), "i")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = F.sum("source_size").over(Window.partitionBy())
    left = ranked.withColumn("level", (everything - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # the level rises while sources fill up and falls from the first one on that does not: its maximum is the water level
    final = F.max("level").over(Window.partitionBy())
    return left.select(*(c for c in sizes.columns if c != "source_size"), "source_size", F.least("cap", F.col("w") * F.coalesce(final, F.lit(0.0))).alias("target"))


def ranked(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """doc_id, source, queue, size, o, m (rows alike in all of these), before (documents of the source that stand before them), source_size, target, rate."""
    size = F.regexp_count(text_of(docs), F.lit(WORD)).cast("bigint")
    light = docs.select("doc_id", docs["source"].cast("string").alias("source"), _queue(docs).alias("queue"), size.alias("size"), _order(docs).alias("o"))
    rows = stored(light.groupBy("queue", "source", "doc_id", "size", "o").agg(F.count(F.lit(1)).alias("m")), "mix-documents")
    sizes = rows.groupBy("queue", "source", "size").agg(F.sum("m").alias("n"))
    sizes = stored(sizes.withColumn("slices", F.ceil(F.col("n") / ROWS_PER_SLICE)), "mix-sizes")
    aims = targets(sizes.groupBy("queue", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.conv(F.substring("o", 1, 8), 16, 10).cast("bigint")
    rows = rows.join(sizes.select("queue", "size", "slices"), ["queue", "size"]).withColumn("slice", F.floor(place * F.col("slices") / (1 << 32)).cast("bigint"))
    counts = rows.groupBy("queue", "size", "slice").agg(F.sum("m").alias("n"))
    first = F.sum("n").over(Window.partitionBy("queue").orderBy("size", "slice")) - F.col("n")
    base = counts.select("queue", "size", "slice", first.alias("first")).join(aims.drop("source").withColumn("rate", rate), "queue")
    inside = F.sum("m").over(Window.partitionBy("queue", "size", "slice").orderBy("o", "doc_id")) - F.col("m")
    got = rows.withColumn("inside", inside).join(base, ["queue", "size", "slice"])
    return got.select("doc_id", "source", "queue", "size", "o", "m", (F.col("first") + F.col("inside")).alias("before"), "source_size", "target", "rate")


def _crossed(seed: int, after: Column, before: Column) -> Column:
    """Integers that the source's interval from ``before`` to ``after`` documents crosses."""
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:mix:"), "queue").cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    return (F.floor(after * F.col("rate") + offset) - F.floor(before * F.col("rate") + offset)).cast("bigint")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 0) -> DataFrame:
    """A row a document: doc_id, source, size, source_size, target, copies (how often it is emitted)."""
    rows = ranked(docs, weights, most)
    runs = rows.withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1, F.lit(RUN).cast("bigint"))))
    if not runs.where("at > 0").isEmpty():  # many rows alike: their runs go to as many tasks as there are
        runs = runs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = runs.withColumn("k", F.explode(F.sequence(F.col("at") + 1, F.least(F.col("at") + RUN, F.col("m"))))).withColumn("k", F.col("before") + F.col("k"))
    return each.select("doc_id", "source", "size", "source_size", "target", _crossed(seed, F.col("k"), F.col("k") - 1).alias("copies"))


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 0) -> DataFrame:
    """Whole documents, each as often as the mix takes it; columns keep their names and values, whatever those are.

    Rows alike in source, id and text share their group's places; those that differ elsewhere stand there one after another, each with its own count.
    """
    rows = ranked(docs, weights, most)
    taken = rows.select("queue", "o", "m", "before", "rate", _crossed(seed, F.col("before") + F.col("m"), F.col("before")).alias("copies"))
    taken = stored(taken.where("copies > 0"), "mix-copies")
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    met = docs.select(row, _queue(docs).alias("queue"), _order(docs).alias("o")).join(taken, ["queue", "o"])
    out = met.where("m = 1").select("row", "copies")
    if not taken.where("m > 1").isEmpty():
        kinds = met.where("m > 1").groupBy("queue", "o", "before", "rate", "row").agg(F.count(F.lit(1)).alias("c"))  # whole rows alike, counted before the shuffle
        upto = F.col("before") + F.sum("c").over(Window.partitionBy("queue", "o").orderBy(F.xxhash64("row"), F.to_json("row")))
        kinds = kinds.withColumn("upto", upto).select("row", _crossed(seed, F.col("upto"), F.col("upto") - F.col("c")).alias("copies"))
        out = out.unionByName(kinds.where("copies > 0"))
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("row.*")
