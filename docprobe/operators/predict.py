"""Predictions by a pluggable model: any function from a batch of pandas rows to completions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docprobe.functions.codec import parse_prediction
from docprobe.operators.names import refuse

Predictor = Callable[[pd.DataFrame], "pd.Series"]


def generate(df: DataFrame, make: Callable[[], Predictor], out: str = "completion") -> DataFrame:
    """Adds the completions. ``make`` loads the model once in each task, on the executor."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make()
        for rows in batches:
            yield rows.assign(**{out: predict(rows)})

    return df.mapInPandas(run, schema)


def collect_predictions(df: DataFrame, completion: Column | str = "completion", limit: int | None = None, order: str = "doc_id") -> DataFrame:
    """Records with completions as evaluation rows: doc_id, source, tamper_type, true_tampered, true_box_pixel, width, height, pred."""
    rows = df if limit is None else df.orderBy(order).limit(limit)
    text = F.col(completion) if isinstance(completion, str) else completion
    return rows.select("doc_id", "source", "tamper_type", F.col("tampered").alias("true_tampered"), F.col("box_pixel").alias("true_box_pixel"), "width", "height", parse_prediction(text).alias("pred"))


LEDGER = "shard int, run string, rows bigint"


def ledger(df: DataFrame, path: str) -> DataFrame:
    """What ``generate_resumable`` has finished under ``path``: a row a shard. No folder: nothing."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/ledger")
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(LEDGER).parquet(f"{path}/ledger") if there else spark.createDataFrame([], LEDGER)


def generate_resumable(df: DataFrame, make: Callable[[], Predictor], path: str, key: str, shards: int = 64, at_once: int = 8, out: str = "completion", max_jobs: int | None = None) -> DataFrame:
    """Adds the completions, kept under ``path``: a job that was lost goes on where it stopped when it is called again.

    Records are dealt to ``shards`` by a hash of their key, whatever partitions they come in. Open shards are those without a row in the ledger (an anti join); ``at_once`` of them are one
    job, which appends its rows under a run of its own and then, once Spark has committed them, a row a shard to the ledger. Rows of a run that the ledger does not name were
    left by a job that died between the two; they are never read. So each record is predicted once over all calls, but for the shards of the job that died.
    The table must have the same rows on every call, and ``shards`` the same value. max_jobs: stop after so many; what is returned is what is finished.
    """
    refuse(df, "shard", "run")
    spark = df.sparkSession
    dealt = df.withColumn("shard", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(shards)).cast("int"))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField("shard", T.IntegerType()), T.StructField("run", T.StringType())])
    wanted = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    todo = sorted(r.shard for r in wanted.join(ledger(df, path), "shard", "left_anti").collect())  # at most ``shards`` numbers
    for i in range(0, len(todo), at_once)[:max_jobs]:
        some, run = todo[i : i + at_once], uuid.uuid4().hex
        rows = dealt.where(F.col("shard").isin(some)).repartition(len(some), "shard")
        generate(rows, make, out).withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{path}/rows")
        got = spark.read.schema(schema).parquet(f"{path}/rows").where(F.col("run") == run).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
        done = wanted.where(F.col("shard").isin(some)).join(got, "shard", "left").select("shard", F.lit(run).alias("run"), F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"))
        done.coalesce(1).write.mode("append").parquet(f"{path}/ledger")
    finished = F.broadcast(ledger(df, path).select("shard", "run"))  # at most ``shards`` rows
    return spark.read.schema(schema).parquet(f"{path}/rows").join(finished, ["shard", "run"], "left_semi").drop("shard", "run")
