"""Row numbers of tables and lines that carry none, in the order in which files are read: by file name, then by place in the file.

Nothing is sorted and no window spans the table: a row's place within its file (or its split of one) comes with the row, and only counts a file or split, one
short row each, get prefix sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docprobe.sources.scratch import stored

#: A table of one row a file or split is broadcast up to so many rows (about 100 bytes each), else joined by sorting.
SMALL = 200_000
#: Slices of the two-level prefix sums.
SLICES = 256


def starts(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """``counts`` (columns ``by`` and n) and ``start``: the sum of n over the rows before, in the order of ``by``.

    Two levels: the rows are cut into ranges of that order, each range is summed, and a window runs within a range; the ranges' sums, at most ``SLICES`` numbers, are added up
    on the driver.
    """
    few = counts.count()
    cut = counts.repartitionByRange(max(1, min(SLICES, few // 1000)), *by).withColumn("slice", F.spark_partition_id())
    cut = stored(cut, "starts")  # the ranges are drawn by sampling: fixed here
    sums, before = [], 0
    for slice_, total in sorted(map(tuple, cut.groupBy("slice").agg(F.sum(n)).collect())):
        sums.append((slice_, before))
        before += total
    if not sums:
        return counts.withColumn("start", F.lit(0).cast("bigint"))
    offsets = F.broadcast(counts.sparkSession.createDataFrame(sums, "slice int, ahead bigint"))
    rows = Window.partitionBy("slice").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(offsets, "slice").select(*counts.columns, (F.col("ahead") + F.coalesce(F.sum(n).over(rows), F.lit(0))).cast("bigint").alias("start"))


def _met(rows: DataFrame, few: DataFrame, by: list[str]) -> DataFrame:
    return rows.join(F.broadcast(few) if few.count() <= SMALL else few, by)


def with_ordinals(spark: SparkSession, path: str | list[str], name: str = "ordinal") -> DataFrame:
    """A Parquet table and ``name``: 0 for the first row of the first file by name, and so on.

    Parquet knows each row's number within its file, whatever splits it is read in. An error if the table has a column of that name.
    """
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    if name in df.columns:
        raise ValueError(f"the table has a column {name!r}")
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    packed = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), file.alias("file"), row.alias("at"))
    counts = starts(stored(df.groupBy(file.alias("file")).agg(F.count(F.lit(1)).alias("n")), "rows-by-file"), ["file"]).select("file", "start")
    return _met(packed, stored(counts, "file-starts"), ["file"]).select("row.*", (F.col("start") + F.col("at")).alias(name))


def parquet_files(spark: SparkSession, path: str) -> list[str]:
    """The data files under a path, by name. Hidden files and folders do not count."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    walk, found = top.getFileSystem(conf).listFiles(top, True), []
    root = top.getFileSystem(conf).getFileStatus(top).getPath().toString()
    while walk.hasNext():
        at = walk.next().getPath().toString()
        if not any(p.startswith(("_", ".")) for p in at[len(root) :].split("/")):
            found.append(at)
    return sorted(found)


def rows_in(spark: SparkSession, file: str) -> int:
    """Rows of a Parquet file by its footer; no data is read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        return reader.getRecordCount()
    finally:
        reader.close()


def first_files(spark: SparkSession, path: str, limit: int) -> list[str]:
    """As many files, by name, as hold the first ``limit`` rows. Footers are read one after another, and none beyond the last file that is needed."""
    chosen, rows = [], 0
    for file in parquet_files(spark, path):
        if rows >= limit and chosen:
            break
        chosen.append(file)
        rows += rows_in(spark, file)
    return chosen


def first_rows(spark: SparkSession, path: str, limit: int, name: str = "ordinal") -> DataFrame:
    """The first ``limit`` rows in the order of files, with their ordinal; other files are not opened."""
    return with_ordinals(spark, first_files(spark, path, limit), name).where(F.col(name) < limit)


def with_positions(spark: SparkSession, path: str) -> DataFrame:
    """value, position: the lines of text files in the order of files and bytes; blank lines have no place and are left out.

    A task numbers its lines; (file, first byte of the split) put the splits in order. The numbered lines are stored, so that what is counted is what is read.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"))
    lines = stored(lines, "lines")
    splits = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"))
    splits = stored(starts(stored(splits, "splits"), ["file", "block"]).drop("n"), "split-starts")
    return _met(lines, splits, ["file", "block"]).select("value", (F.col("start") + F.col("k") - F.col("first")).alias("position"))


def paired_lines(spark: SparkSession, one: str, two: str) -> DataFrame:
    """position, one, two: the lines of two dumps by position. Dumps of unequal length are an error before anything is paired."""
    a, b = (stored(with_positions(spark, p).withColumnRenamed("value", c), f"positions-{c}") for p, c in ((one, "one"), (two, "two")))
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"mismatched lengths: {n} and {m} lines")
    return a.join(b, "position")


