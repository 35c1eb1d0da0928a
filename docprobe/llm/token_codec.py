"""Token-id files in a word-aligned code (Simple-8b), written in document order and read back in parallel.

A 64-bit word holds a 4-bit selector and as many ids of equal width as fit into 60 bits. Selector 0 escapes: the next
word is one raw 64-bit id. A block is a run of whole documents of about ``BLOCK`` ids. Its payload begins with a header
(magic, format version, numbers of ids, documents and words), then the words, then the documents' lengths in the same code,
so that any block decodes by itself with a few array operations.

A file set is a Parquet table of blocks (shard, block, block_start, first_doc, n_ids, n_docs, n_null, doc_ids, payload), because only Spark's own writers
commit output safely to a cluster's store. Shards ascend in doc_id: rows are dealt by range and sorted within; rows of one id lie in the
order of a hash of their text, rows alike in both in that of the input, so that many of one id fill many shards. ``block_start``
counts the shard's ids before the block; shard totals (a row a shard) give the global start.

Defined results: null text is empty text (just the end id); repeated rows are all written; null doc_ids come first (the first ``n_null`` of a
block have none); a very long text makes a block by itself; an empty table gives an empty file set; other columns are ignored, also those named like a result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docprobe.llm.common import map_rows, runs_of_texts, text_of
from docprobe.llm.tokens import encoder, public_path
from docprobe.sources.scratch import fresh

#: selector -> (ids in a word, bits of each); 0 is the escape, 1 a run of zeros.
LAYOUT = [(1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
BLOCK = 1 << 16
MAGIC, HEADER = b"DPS8", struct.Struct("<4sIQQQQ")
BLOCKS = "shard int, block int, block_start bigint, first_doc bigint, n_ids bigint, n_docs bigint, n_null bigint, doc_ids binary, payload binary"


_SHORT = np.array([k.bit_length() for k in range(1 << 16)], np.int8)


def _bit_lengths(v: np.ndarray) -> np.ndarray:
    if len(v) and v.max() < 1 << 16:
        return _SHORT[v.astype(np.int64)]
    bits, rest = np.zeros(len(v), np.int8), v.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >= np.uint64(1) << np.uint64(step)
        bits[big] += step
        rest[big] >>= np.uint64(step)
    return bits + (rest > 0)


def pack(values: np.ndarray) -> np.ndarray:
    """Greedy: each word takes as many of the next values as fit."""
    v = np.ascontiguousarray(values, np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64)
    bits = _bit_lengths(v)
    pad = np.r_[bits, np.zeros(120, np.int8)]  # beyond the end anything fits
    choice = np.zeros(n, np.int8)
    most, covers = pad, 1  # greatest width among the next ``covers`` values
    for sel in range(15, 0, -1):  # from few wide values to many narrow ones: the last that fits takes most
        count, width = LAYOUT[sel]
        while covers < count:
            more = min(covers, count - covers)
            most = np.maximum(most[: len(most) - more], most[more:])
            covers += more
        np.copyto(choice, np.int8(sel), where=most[:n] <= width)
    step = np.array([c for c, _ in LAYOUT])[choice].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.array(starts)
    sels = choice[at]
    place = np.arange(len(at)) + np.r_[0, np.cumsum(sels == 0)[:-1]]
    words = np.zeros(len(at) + int((sels == 0).sum()), np.uint64)
    padded = np.r_[v, np.zeros(120, np.uint64)]
    for sel in np.unique(sels):
        count, width = LAYOUT[sel]
        mine = sels == sel
        if sel == 0:
            words[place[mine] + 1] = v[at[mine]]
            continue
        word = np.full(int(mine.sum()), int(sel) << 60, np.uint64)
        if width:
            for j in range(count):
                word |= padded[at[mine] + j] << np.uint64(j * width)
        words[place[mine]] = word
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first n values of packed words."""
    w = np.ascontiguousarray(words, np.uint64)
    sels = (w >> np.uint64(60)).astype(np.int64)
    if (sels == 0).any():  # a raw word after an escape is no selector, whatever its bits say
        is_word, i, flat = np.zeros(len(w), bool), 0, sels.tolist()
        while i < len(flat):
            is_word[i] = True
            i += 2 if flat[i] == 0 else 1
        heads = np.flatnonzero(is_word)
    else:
        heads = np.arange(len(w))
    sels = sels[heads]
    counts = np.array([c for c, _ in LAYOUT])[sels]
    first = np.r_[0, np.cumsum(counts)]
    out = np.zeros(int(first[-1]), np.uint64)
    for sel in np.unique(sels):
        count, width = LAYOUT[sel]
        mine = np.flatnonzero(sels == sel)
        if sel == 0:
            out[first[mine]] = w[heads[mine] + 1]
        elif width:
            mask, low = np.uint64((1 << width) - 1), w[heads[mine]]
            for j in range(count):
                out[first[mine] + j] = (low >> np.uint64(j * width)) & mask
    return out[:n]


def encode_block(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    words, tail = pack(ids), pack(lengths)
    return HEADER.pack(MAGIC, 1, len(ids), len(lengths), len(words), len(tail)) + words.astype("<u8").tobytes() + tail.astype("<u8").tobytes()


def decode_block(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, documents' lengths)."""
    magic, version, n_ids, n_docs, n_words, n_tail = HEADER.unpack_from(payload)
    if magic != MAGIC or version != 1:
        raise ValueError("not a block of this format")
    words = np.frombuffer(payload, "<u8", n_words + n_tail, HEADER.size)
    return unpack(words[:n_words], n_ids), unpack(words[n_words:], n_docs)


def write_tokens(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, dropped: bool = False, shards: int | None = None) -> None:
    """Encodes every text, appends ``end_id`` to each document and writes the blocks in ascending doc_id order.

    One shuffle (of id and text, by range). ``vocabulary`` is a file's path, or the name of a public vocabulary.
    """
    n = shards or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    order = ["doc_id", "h", "row"]
    dealt = rows.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(vocabulary if "/" in vocabulary else public_path(vocabulary), dropped)
        end = np.array([end_id], "<u4").tobytes()
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        parts: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, size
            ids = np.frombuffer(b"".join(parts), "<u4")
            payload = encode_block(ids, np.array([len(p) // 4 for p in parts]))
            keys = np.array([d or 0 for d in names], "<i8").tobytes()
            row = [[shard], [block], [start], [names[0]], [len(ids)], [len(names)], [names.count(None)], [keys], [payload]]
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary(), pa.binary()]
            block, start, size = block + 1, start + len(ids), 0
            names.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for part in runs_of_texts(batch, 1, rows=200):
                for doc, ids in zip(part.column(0).to_pylist(), enc.ids(part.column(1).to_pylist())):
                    names.append(doc)
                    parts.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= BLOCK:
                        yield flush()
        if names:
            yield flush()

    map_rows(dealt, run, BLOCKS, "docprobe.llm.tokens").write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, each block decoded by itself."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())  # a row a shard
    base, before = {}, 0
    for shard, n in totals:
        base[shard] = before
        before += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start, nulls, names, payload in zip(*(batch.column(i) for i in range(5))):
                ids, lengths = decode_block(payload.as_py())
                ends = np.cumsum(lengths.astype(np.int64))
                docs, begins = np.frombuffer(names.as_py(), "<i8"), ends - lengths.astype(np.int64)
                each = [ids[a:b].astype("<u4").tobytes() for a, b in zip(begins, ends)]
                out = [pa.array(docs, mask=np.arange(len(docs)) < nulls.as_py()), pa.array(begins + (base[shard.as_py()] + start.as_py())), pa.array(ends - begins), pa.array([zlib.crc32(e) for e in each], pa.int64())]
                if with_ids:
                    out.append(pa.array([np.frombuffer(e, "<u4").astype(np.int64).tolist() for e in each], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return map_rows(blocks.select("shard", "block_start", "n_null", "doc_ids", "payload"), run, schema, "docprobe.llm.tokens")


def write_and_read(docs: DataFrame, **options: object) -> DataFrame:
    """The round trip through files in the shared folder."""
    path = fresh(docs.sparkSession, "tokens")
    write_tokens(docs, path, **options)  # type: ignore[arg-type]
    return read_tokens(docs.sparkSession, path)
