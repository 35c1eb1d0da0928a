"""Mixture-controlled packing: deficit round robin over source queues into sequences of a fixed length.

Each source is a queue. Every window gives a source a quantum (its target share of the window's tokens); the source sends whole
documents while it has credit left, and what a document takes beyond it is a deficit that the next windows pay off. So a document whose source
has sent c tokens before it goes out in window floor(c / quantum): windows follow from prefix sums, whatever
partition the queue lies in, and deficits carry across windows and partitions by construction. A window's documents run source by source;
the stream is cut every ``length`` tokens, so only the very last sequence is padded.

Targets default to the sources' shares of all tokens, which ends all queues together. With other weights the
queues that still have documents fill the windows alone once one has run dry; a source that the weights do not name gets the smallest of them.

Flow: encode (narrow), store ids; prefix sums over (source, partition) totals; one shuffle of ids by groups of windows; cut. A group is at
most ``GROUP`` windows (4 million tokens at the defaults) whatever the input's size, and fewer where that leaves tasks idle; where a group starts is a prefix sum
over groups in two levels, met by a hash join in the same partitions as the ids. Queue offsets are broadcast up to ``MAX_BASES`` rows (checked; joined by shuffle beyond it).

Defined results: null text is empty text (just the end id); a null source is a queue of its own; repeated rows are
packed each for itself; null doc_ids are kept; a text longer than a window fills several; an empty table gives no pieces; other columns are ignored, also those named like a result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docprobe.llm.common import map_rows, runs_of_texts, stored, text_of
from docprobe.llm.tokens import encoder, public_path

MAX_BASES, GROUP, BLOCK = 100_000, 64, 4096
ENCODED = "part int, pos bigint, doc_id bigint, source string, n bigint, before bigint, ids binary"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def encode(docs: DataFrame, vocabulary: str, end_id: int, dropped: bool) -> DataFrame:
    """part, pos, doc_id, source, n, before (tokens of the source earlier in this partition), ids (16 or 32 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(vocabulary if "/" in vocabulary else public_path(vocabulary), dropped)
        end, part, pos, sent = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            sources, sizes, before, packed = batch.column(1).to_pylist(), [], [], []
            for part_ in runs_of_texts(batch, 2, rows=200):
                for ids in enc.ids(part_.column(2).to_pylist()):
                    wide = np.frombuffer(ids + end, "<u4")
                    sizes.append(len(wide))
                    narrow = wide.astype("<u2")
                    packed.append(b"\2" + narrow.tobytes() if (narrow == wide).all() else b"\4" + wide.tobytes())
            for s, n in zip(sources, sizes):
                before.append(sent.get(s, 0))
                sent[s] = before[-1] + n
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, part, np.int32)), pa.array(np.arange(pos, pos + k)), batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(before, pa.int64()), pa.array(packed, pa.binary())], names=[c.split()[0] for c in ENCODED.split(", ")])
            pos += k

    return map_rows(docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), text_of(docs).alias("text")), run, ENCODED, "docprobe.llm.tokens")


def pack(docs: DataFrame, length: int = 4096, weights: dict[str | None, float] | None = None, window: int = 16, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, dropped: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. window: sequences in a window."""
    spark = docs.sparkSession
    rows = stored(encode(docs, vocabulary, end_id, dropped), "packing-ids")
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("queue")
    parts = rows.groupBy(name, "part").agg(F.sum("n").alias("tokens"))
    queue = Window.partitionBy("queue")
    base = parts.select("queue", "part", F.sum("tokens").over(queue).alias("total"), (F.sum("tokens").over(queue.orderBy("part")) - F.col("tokens")).alias("earlier"))
    total = parts.agg(F.sum("tokens")).first()[0] or 0
    room = float(window * length)
    if weights is None:
        quantum = F.col("total") * F.lit(room / max(total, 1))
    else:
        if not weights or min(weights.values()) <= 0:
            raise ValueError("weights must be above 0")
        named = sorted((("n" if s is None else f"s{s}"), float(w)) for s, w in weights.items())
        each = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in named for x in p)), F.col("queue")), F.lit(float(min(weights.values()))))
        whole = parts.select("queue").distinct().agg(F.sum(each)).first()[0] or 1.0
        quantum = each * F.lit(room / whole)
    base = stored(base.select("queue", "part", "earlier", quantum.alias("quantum")), "packing-queues", parts.count())
    small = base.count() <= MAX_BASES
    got = rows.withColumn("queue", name).join(F.broadcast(base) if small else base, ["queue", "part"])
    got = got.withColumn("window", F.floor((F.col("earlier") + F.col("before")) / F.col("quantum")).cast("bigint"))
    last = (got.agg(F.max("window")).first()[0] or 0) + 1
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wide = max(1, min(GROUP, last // (8 * n)))
    got = got.withColumn("grp", F.floor(F.col("window") / wide).cast("bigint"))
    groups = stored(got.groupBy("grp").agg(F.sum("n").alias("n")).withColumn("block", F.floor(F.col("grp") / BLOCK)), "packing-groups", -(-last // wide))
    blocks = groups.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("earlier"))  # a row for each BLOCK groups
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("grp")) - F.col("n")
    starts = groups.withColumn("inside", inside).join(blocks, "block").select("grp", (F.col("earlier") + F.col("inside")).alias("begin"))
    dealt = got.select("grp", "window", "queue", "part", "pos", "doc_id", "ids").repartition(n, "grp").join(starts.repartition(n, "grp").hint("shuffle_hash"), "grp")
    dealt = dealt.sortWithinPartitions("grp", "window", "queue", "part", "pos")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for batch in batches:
            out: list[tuple] = []
            for grp, doc, start, cell in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                if grp != now:
                    now, at = grp, start
                raw = cell.as_buffer()
                ids = np.frombuffer(raw, "<u2" if raw[0:1].to_pybytes() == b"\2" else "<u4", offset=1).astype("<u4")
                begin, n = 0, len(ids)
                while begin < n:
                    take = min(n - begin, length - at % length)
                    out.append((doc, begin, take, zlib.crc32(ids[begin : begin + take].tobytes()), n, at // length, at % length))
                    begin += take
                    at += take
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[c.split()[0] for c in PIECES.split(", ")])

    return map_rows(dealt.select("grp", "doc_id", "begin", "ids"), cut, PIECES, "docprobe.llm.tokens")
