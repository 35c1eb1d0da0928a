"""Training batches that depend on the rows and a seed alone, not on how the rows are partitioned.

Rows stand in a seeded order; every ``pool`` batches' worth of them is sorted by length and cut into batches, so that rows of a batch are of like length and little is
padded, while which rows come together still changes with the epoch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docprobe.operators.chat import Special, Tokenizer, loss_mask, messages
from docprobe.operators.names import refuse, spare
from docprobe.operators.sampling import order_key
from docprobe.operators.split import ranked


def batched(df: DataFrame, key: str, length: str, size: int = 8, seed: int = 0, epoch: int = 0, pool: int = 64) -> DataFrame:
    """Adds batch (0-based) and turn (a text: batches in its order are mixed). key: a unique column; length: what rows of a batch should share, null as 0.

    The order is an md5's, ranks run in two levels, and no window holds more than ``pool`` batches. Only the last batch of all may be smaller.
    """
    refuse(df, "batch", "turn")
    order, rank, chunk = spare(df, "_o", "_rank", "_chunk")
    rows = ranked(df.withColumn(order, order_key(seed, f"batch:{epoch}", F.col(key))), key, order, rank)
    rows = rows.withColumn(chunk, F.floor((F.col(rank) - 1) / (pool * size)))
    within = F.row_number().over(Window.partitionBy(chunk).orderBy(F.coalesce(F.col(length), F.lit(0)).desc(), order, key))
    batch = F.col(chunk) * pool + F.floor((within - 1) / size)
    return rows.withColumn("batch", batch.cast("bigint")).select(*df.columns, "batch", order_key(seed, f"turn:{epoch}", F.col("batch")).alias("turn"))


def padding(df: DataFrame, batch: str, length: str) -> DataFrame:
    """batches, tokens and padded: what padding every batch to its longest row adds."""
    each = df.groupBy(batch).agg(F.max(length).alias("longest"), F.count(F.lit(1)).alias("rows"), F.sum(length).alias("tokens"))
    return each.agg(F.count(F.lit(1)).alias("batches"), F.sum("tokens").alias("tokens"), F.sum(F.col("longest") * F.col("rows") - F.col("tokens")).alias("padded"))


def collate_batches(df: DataFrame, make: Callable[[], Tokenizer], special: Special, build: Column | None = None, max_length: int = 2048, batch: str = "batch") -> DataFrame:
    """As ``chat.collate``, for the batches of ``batched``: rows of one ``batch`` are padded to the longest of them wherever they lie.

    Records are tokenized where they are, in Arrow batches; only then are the rows of a batch padded, by the length of its longest row. No batch has to come together in one task.
    """
    (given,) = spare(df, "_messages")
    kept, ids = df.columns, T.ArrayType(T.IntegerType())
    schema = T.StructType([*df.schema.fields, T.StructField("input_ids", ids)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = make()
        for rows in batches:
            yield rows[kept].assign(input_ids=[list(t)[:max_length] for t in tokens(rows[given].tolist())])

    rows = df.withColumn(given, messages() if build is None else build).mapInPandas(run, schema)
    n, longest = F.size("input_ids"), F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    (to,) = spare(rows, "_longest")
    rows = rows.withColumn(to, longest)
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.col(to) - n))
    rows = rows.select(*kept, F.concat("input_ids", F.array_repeat(F.lit(special.pad), F.col(to) - n)).alias("input_ids"), mask.alias("attention_mask"))
    return loss_mask(rows, special.start, special.end, special.pad, special.image, special.header)
