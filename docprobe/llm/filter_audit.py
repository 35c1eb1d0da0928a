"""How the filters of a corpus interact: what each removes, alone and behind the others, in every order.

Five filters are judged on whole texts: A few words, B few distinct words, C many capitals, D marks, E a copy of a text with a smaller id.
Each document has a mask of the filters that it fails; documents are counted by (part, mask), and all 120 orders follow from those counts.

Copies are found by partition refinement: documents are split by their number of code points, then by the hash of their first block, the second and so on
(blocks grow by ``GROWTH``; the last takes the rest), and after each split the documents that stand alone go. What survives is compared in full with the text of its
class's smallest id; a text that differs from it (equal hashes by chance) goes through the same again among those that differ. Classes are cut
into salted groups of at most ``GROUP`` rows for the comparison, so no copy that a third of the corpus repeats meets in one task; before that, rows hold numbers only.

Defined results: a null text is empty (it fails A; not B or C, as 0 < 0 is false); a null source is the part ''; rows without a doc_id are never
copies and make none; rows that repeat an id are documents each, and no copies of each other; labels count if any row of the id has them; an empty table gives no rows;
other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprobe.llm.common import join_groups, map_rows, stored, text_of

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_SHARE, CAPITAL_SHARE, MARKS = 200, 50, 2, b"#$%&*|"
CAPITALS = bytes(range(65, 91))
#: Bytes of the first block, how much longer each next one is, and how many there are.
FIRST, GROWTH, BLOCKS = 256, 16, 4
#: Rows of a class that are compared in one group, at most about.
GROUP = 1000
HASHES = [f"h{i}" for i in range(BLOCKS)]
CLASS = ["length", *HASHES]
KINDS = "doc_id bigint, part string, mask int, length bigint, " + ", ".join(f"{h} bigint" for h in HASHES)


def own_mask(text: bytes, n: int) -> int:
    """Bits of the filters that the text fails by itself (all but E)."""
    words = text.split()
    few = len(words) < MIN_WORDS
    same = 100 * len(set(words)) < DISTINCT_SHARE * len(words)
    loud = 100 * (len(text) - len(text.translate(None, CAPITALS))) > CAPITAL_SHARE * n
    marked = len(text) != len(text.translate(None, MARKS))
    return few | same << 1 | loud << 2 | marked << 3


def block_hashes(text: bytes) -> list[int]:
    import xxhash

    ends = [0, *(FIRST * sum(GROWTH**i for i in range(k + 1)) for k in range(BLOCKS - 1)), len(text)]
    raw = [xxhash.xxh3_64_intdigest(text[a:b] if a < b else b"") for a, b in zip(ends, ends[1:])]
    return [h - (1 << 64) if h >> 63 else h for h in raw]


def features(docs: DataFrame) -> DataFrame:
    """Numbers of each document: its part, mask without E, code points and block hashes; no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.utf8_length(batch.column(2)).to_pylist()
            texts = [t.as_buffer().to_pybytes() for t in batch.column(2)]
            hashes = list(zip(*map(block_hashes, texts)))
            masks = [own_mask(t, n) for t, n in zip(texts, lengths)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "part": batch.column(1), "mask": pa.array(masks, pa.int32()), "length": pa.array(lengths, pa.int64())} | {h: pa.array(c, pa.int64()) for h, c in zip(HASHES, hashes)})

    part = F.coalesce(docs["source"].cast("string"), F.lit(""))
    return map_rows(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), part.alias("part"), text_of(docs).alias("text")), run, KINDS)


def refined(rows: DataFrame, total: int) -> DataFrame:
    """doc_id, the class columns, and ``size`` and ``least`` (smallest id) of each class of two or more: by length first, then block by block."""
    left = rows.where("doc_id is not null").select("doc_id", *CLASS)
    for k in range(1, len(CLASS) + 1):
        keys = CLASS[:k]
        classes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).where("n > 1")
        met = join_groups(left, stored(classes, "audit-classes", total // 2), keys, total, F.col("doc_id")).where("group is not null")
        left = stored(met.select("doc_id", *CLASS, "group"), "audit-left", total)
        if k < len(CLASS):
            left = left.drop("group")
    return left.select("doc_id", *CLASS, F.col("group.n").alias("size"), "group.least").distinct()


def copies(docs: DataFrame, rows: DataFrame, total: int) -> DataFrame:
    """doc_id and class columns of the documents whose whole text is that of a smaller id, each once."""
    survivors = stored(refined(rows, total), "audit-survivors")
    ids = survivors.select("doc_id").distinct()
    texts = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    texts = texts.join(ids, "doc_id", "left_semi")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = list(zip(*(block_hashes(t.as_buffer().to_pybytes()) for t in batch.column(1))))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "length": pc.utf8_length(batch.column(1)).cast(pa.int64())} | {h: pa.array(c, pa.int64()) for h, c in zip(HASHES, hashes)} | {"text": batch.column(1)})

    kinds = "doc_id bigint, length bigint, " + ", ".join(f"{h} bigint" for h in HASHES) + ", text string"
    left = stored(map_rows(texts, keyed, kinds).join(survivors, ["doc_id", *CLASS]).distinct(), "audit-texts")
    found = None
    while True:
        same, left = compared(left)
        found = same if found is None else found.unionByName(same)
        if left.isEmpty():
            return found
        again = left.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("least")).where("size > 1")
        left = stored(left.drop("size", "least").join(again, CLASS), "audit-texts")


def compared(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of classes (doc_id, class columns, text, size, least): the rows equal to the text of their class's smallest id, and the rows that differ from it."""
    salts = F.ceil(F.col("size") / GROUP).cast("bigint")
    models = left.where("doc_id = least").groupBy(*CLASS).agg(F.min("text").alias("model"), F.first("size").alias("size"))
    models = models.select(*CLASS, "model", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("salt"))
    rows = left.withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts))
    met = stored(rows.join(models, [*CLASS, "salt"]).withColumn("same", F.col("text") == F.col("model")).drop("model", "salt"), "audit-compared")
    return met.where("same and doc_id > least").select("doc_id", *CLASS), met.where("not same").drop("same")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with good and toxic (0 or 1)."""
    marks = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), (labels["quality"] == 1).alias("good"), (labels["toxic"] == 1).alias("toxic"))
    marks = marks.where("doc_id is not null").groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c), F.lit(False)).cast("int")).alias(c) for c in ("good", "toxic")))
    met = rows.join(marks, "doc_id", "left")
    return met.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("good", "toxic")})


def by_order(counts: DataFrame) -> DataFrame:
    """The report from the counts of each part: documents, good and toxic ones by mask (arrays of 32)."""
    masks = np.arange(1 << len(FILTERS))
    size = np.array([bin(m).count("1") for m in masks])
    orders = list(permutations(range(len(FILTERS))))
    steps = [(o, k) for o in orders for k in range(len(FILTERS))]
    before = np.array([sum(1 << f for f in o[:k]) for o, k in steps])
    bit = np.array([1 << o[k] for o, k in steps])
    fails, free = (masks[:, None] & bit) > 0, (masks[:, None] & before) == 0
    shares = np.where(fails, len(orders) // np.maximum(size, 1)[:, None], 0)
    ways = {"kept": free & ~fails, "removed": free & fails, "redundant": fails & ~free, "unique_fails": masks[:, None] == bit, "shapley": shares}
    names = pa.array(["".join(FILTERS[f] for f in o) for o, _ in steps])
    numbers = pa.array([k + 1 for _, k in steps], pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, *cells in zip(*(batch.column(c).to_pylist() for c in ("part", "docs", "good", "toxic"))):
                n, good, toxic = (np.array(c, np.int64) for c in cells)
                out = {c: n @ w.astype(np.int64) for c, w in ways.items()} | {f"{c}_lost": x @ ways["removed"].astype(np.int64) for c, x in (("good", good), ("toxic", toxic))}
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(steps)), "filter_order": names, "step": numbers} | {c: pa.array(out[c]) for c in REPORT})

    return map_rows(counts, run, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in REPORT))


REPORT = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of ``REPORT``: a row for each part, order and step."""
    rows = stored(features(docs), "audit-features")
    total = rows.count()
    copy = stored(copies(docs, rows, total), "audit-copies").withColumn("copy", F.lit(16))
    known, unknown = rows.where("doc_id is not null"), rows.where("doc_id is null")  # what has no id meets neither copies nor labels
    marked = known.join(copy, ["doc_id", *CLASS], "left").withColumn("mask", F.col("mask").bitwiseOR(F.coalesce("copy", F.lit(0))))
    each = labelled(marked, labels).select("part", "mask", "good", "toxic").union(unknown.select("part", "mask", F.lit(0), F.lit(0)))
    counts = each.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("docs"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return by_order(counts.groupBy("part").agg(*(cells(c) for c in ("docs", "good", "toxic"))))


def cells(name: str) -> Column:
    """An array of 32: the column's number at each mask."""
    return F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(name))), F.lit(0)).cast("bigint") for m in range(1 << len(FILTERS)))).alias(name)
