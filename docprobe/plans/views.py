"""The domain mapped onto the driver's tables.

page = order, box = line item of the order, source = order priority, text = a part's brand or name; ground truth and predictions
come from labels and text lengths. Each view is one SELECT that Spark and DuckDB both read; ``{name}`` stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docprobe.functions.codec import is_numeric

LINEITEM = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"

#: doc_id, source, width, height
PAGES = "SELECT o_orderkey AS doc_id, o_orderpriority AS source, CAST(300 + o_orderkey % 400 AS INT) AS width, CAST(400 + (o_orderkey * 7) % 500 AS INT) AS height FROM {orders}"

#: doc_id, pos, text, label, x1, y1, x2, y2, width, height, source: a few boxes stick out of their page, some are too small for an operation
BOXES = f"""
WITH l AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINEITEM}) AS INT) AS pos FROM {{lineitem}}),
p AS ({PAGES})
SELECT p.doc_id, pos, CASE WHEN l_linestatus = 'O' THEN p_brand ELSE p_name END AS text,
 CASE (l_partkey + pos) % 8 WHEN 0 THEN 'total' WHEN 1 THEN 'date' WHEN 2 THEN 'company' WHEN 3 THEN 'address' WHEN 4 THEN 'answer' WHEN 5 THEN 'question' WHEN 6 THEN 'header' ELSE '' END AS label,
 CAST((l_partkey * 37 + pos * 53) % (width - 40) AS INT) AS x1, CAST((l_suppkey * 29 + pos * 71) % (height - 30) AS INT) AS y1,
 CAST((l_partkey * 37 + pos * 53) % (width - 40) + 3 + (l_partkey * 13 + pos) % 120 AS INT) AS x2, CAST((l_suppkey * 29 + pos * 71) % (height - 30) + 4 + (l_suppkey * 17 + pos) % 24 AS INT) AS y2,
 width, height, source
FROM l JOIN p ON l_orderkey = p.doc_id JOIN {{part}} ON l_partkey = p_partkey"""

#: doc_id, source, true_tampered, tamper_type, x1..y2 (null if clean), width, height, n: truth for evaluation
TRUTH = """
SELECT d.doc_id, d.source, quality = 0 AS true_tampered, CASE WHEN quality = 0 THEN CASE d.doc_id % 4 WHEN 0 THEN 'digit_swap' WHEN 1 THEN 'copy_move' WHEN 2 THEN 'splice' ELSE '' END END AS tamper_type,
 CAST(CASE WHEN quality = 0 THEN d.doc_id % 200 END AS INT) AS x1, CAST(CASE WHEN quality = 0 THEN d.doc_id % 150 END AS INT) AS y1,
 CAST(CASE WHEN quality = 0 THEN d.doc_id % 200 + 60 + d.n_chars % 80 END AS INT) AS x2, CAST(CASE WHEN quality = 0 THEN d.doc_id % 150 + 30 + d.n_chars % 40 END AS INT) AS y2,
 CAST(400 + d.doc_id % 300 AS INT) AS width, CAST(500 + d.doc_id % 200 AS INT) AS height, d.n_chars AS n
FROM {labels} JOIN {documents} d USING (doc_id)"""

#: TRUTH and what two predictors say: model (flag, box on the 0..1000 grid, kind of completion) and baseline
SAID = f"""
WITH t AS ({TRUTH})
SELECT *, (true_tampered AND (n + doc_id) % 7 <> 0) OR (NOT true_tampered AND (n + doc_id) % 23 = 0) AS says, (true_tampered AND (n + doc_id) % 3 = 0) OR (NOT true_tampered AND (n + doc_id) % 5 = 0) AS base_says,
 CAST(doc_id % 11 AS INT) AS shape, CAST(floor((doc_id % 200) * 1000 / (400 + doc_id % 300)) + n % 50 AS INT) AS bx1, CAST(floor((doc_id % 150) * 1000 / (500 + doc_id % 200)) + n % 30 AS INT) AS by1,
 CAST(floor((doc_id % 200 + 60 + n % 80) * 1000 / (400 + doc_id % 300)) + n % 70 AS INT) AS bx2, CAST(floor((doc_id % 150 + 30 + n % 40) * 1000 / (500 + doc_id % 200)) + n % 20 AS INT) AS by2
FROM t"""

_BOX_TEXT = "concat('<|box_start|>(', CAST(bx1 AS STRING), ',', CAST(by1 AS STRING), '), (', CAST(bx2 AS STRING), ',', CAST(by2 AS STRING), ')<|box_end|>')"


def _braced(text: str) -> str:
    """SQL text in which << and >> stand for braces (braces themselves name tables here)."""
    return f"replace(replace({text}, '<<', chr(123)), '>>', chr(125))"


_GOOD = _braced(f"""CASE WHEN says THEN concat('<<"tampered": true, "field": "total", "box": "', {_BOX_TEXT}, '", "reason": "edges <<differ>>">>') ELSE '<<"tampered": false, "field": null, "box": null, "reason": "fine">>' END""")
_OTHER = _braced("""CASE shape WHEN 3 THEN '<<"tampered": "yes", "field": null>>' WHEN 4 THEN '<<"tampered": true, "field": 5>>' WHEN 5 THEN '<<"tampered": true, "field": "total", "box": "top left", "reason": null>>' ELSE '<<"tampered": true>>' END""")
#: completions of eleven shapes: plain, chatty, two objects, cut short, wrong types, no box in the text, prose
COMPLETIONS = f"""
WITH s AS ({SAID}), g AS (SELECT *, {_GOOD} AS good, {_OTHER} AS other FROM s)
SELECT *, CASE shape WHEN 0 THEN concat('Sure! Here it is: ', good, ' Let me know.') WHEN 1 THEN concat(good, ' ', other) WHEN 2 THEN substr(good, 1, 30) WHEN 3 THEN other WHEN 4 THEN other WHEN 5 THEN other
 WHEN 6 THEN 'I see nothing wrong with it.' ELSE good END AS completion FROM g"""


#: Bytes of a table's files from which on it is never broadcast: rows in memory take many times their bytes in Parquet, by which Spark decides.
SHUFFLED = 4 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _large(df: DataFrame) -> bool:
    return int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes())) > SHUFFLED


def in_spark(spark: SparkSession, sf_dir: str, sql: str, **tables: DataFrame) -> DataFrame:
    """A view over the Parquet tables that it names, or over ``tables`` in their place."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: tables[n] if n in tables else _table(spark, sf_dir, n) for n in names})


def in_sql(sql: str) -> str:
    """The same view for an engine in which the tables are views of their own."""
    return re.sub(r"\{(\w+)\}", r"\1", sql).replace("AS STRING", "AS VARCHAR")


def _of_share(spark: SparkSession, sf_dir: str, share: tuple[int, int] | None, **keys: str) -> dict[str, DataFrame]:
    """The rows of some tables whose key falls to the share k of n; whole tables without one."""
    if share is None or share[1] == 1:
        return {}
    k, n = share
    return {name: _table(spark, sf_dir, name).where(F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(n)) == k) for name, key in keys.items()}


def boxes(spark: SparkSession, sf_dir: str, share: tuple[int, int] | None = None) -> DataFrame:
    """BOXES (of the share k of n of the pages, if given) with ``box`` as an array and ``is_numeric``. Pages and parts meet the boxes by shuffles where they are large."""
    part = _table(spark, sf_dir, "part")
    part = part.hint("merge") if _large(part) else part
    sql = BOXES.replace("\nSELECT p.doc_id", "\nSELECT /*+ MERGE(p) */ p.doc_id") if _large(_table(spark, sf_dir, "orders")) else BOXES
    return in_spark(spark, sf_dir, sql, part=part, **_of_share(spark, sf_dir, share, orders="o_orderkey", lineitem="l_orderkey")).select("*", F.array("x1", "y1", "x2", "y2").alias("box"), is_numeric(F.col("text")).alias("is_numeric"))


def pages(spark: SparkSession, sf_dir: str, share: tuple[int, int] | None = None) -> DataFrame:
    """A row a page with its boxes in order; pages without boxes have an empty array. share (k, n): only the k-th of n shares of the pages, dealt by their ids."""
    b = F.struct("pos", "text", F.col("box").alias("box_pixel"), "label", "is_numeric")
    grouped = boxes(spark, sf_dir, share).groupBy("doc_id").agg(F.sort_array(F.collect_list(b)).alias("b"))
    kind = "array<struct<pos:int,text:string,box_pixel:array<int>,label:string,is_numeric:boolean>>"
    return in_spark(spark, sf_dir, PAGES, **_of_share(spark, sf_dir, share, orders="o_orderkey")).join(grouped.hint("merge"), "doc_id", "left").select("doc_id", "source", "width", "height", F.coalesce(F.col("b"), F.array()).cast(kind).alias("ocr_boxes"))


def truth_columns() -> list:
    box = F.when(F.col("x1").isNotNull(), F.array("x1", "y1", "x2", "y2"))
    return ["doc_id", "source", "true_tampered", "tamper_type", box.alias("true_box_pixel"), "width", "height"]


def evaluation(spark: SparkSession, sf_dir: str, says: str = "says") -> DataFrame:
    """Evaluation rows with a structured prediction (no text); ``says`` picks the model or the baseline."""
    flag = F.col(says)
    norm = F.when(flag & (F.col("shape") != 5), F.array(*(F.col(c).cast("bigint") for c in ("bx1", "by1", "bx2", "by2"))))
    pred = F.struct(flag.alias("tampered"), F.when(flag, "total").alias("field"), F.lit(None).cast("string").alias("box"), norm.alias("box_norm"), F.lit("r").alias("reason"))
    got = in_spark(spark, sf_dir, SAID)
    return got.select(*truth_columns(), F.when(F.col("shape") != 6, pred).alias("pred"), F.coalesce("tamper_type", F.lit("clean")).alias("variant"))
