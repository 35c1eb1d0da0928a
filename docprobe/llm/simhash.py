"""SimHash near-duplicates with pivot distance tables.

A fingerprint's bit is 1 if it is set in over half of the text's shingle hashes. Each distinct fingerprint gets its
row of the pivot table: Hamming distances to ``PIVOTS`` reference fingerprints. By the triangle inequality two fingerprints within
``radius`` have coordinates within ``radius`` of each other, so a pair whose largest coordinate difference is greater is
discarded, and only survivors are compared bit by bit.

Pivots alone leave a constant share of all pairs (about 0.34 for each independent pivot), so pairs are first met in buckets: the bits are cut into
radius + 3 bands, and two fingerprints within the radius agree in at least three of them; every choice of three bands is a key. A bucket of more than
``CAP`` fingerprints is not paired off: its members meet at their one-bit neighbours instead (two fingerprints are
within two bits exactly if they share one), which costs 65 rows a fingerprint and loses nothing.

Links become components by contraction rounds (each node joins the neighbour of least hash, new hashes each round): O(log n) rounds, every
intermediate table written to the shared folder. Only distinct fingerprints take part; documents are joined at the end.

Defined results: null and empty texts have fingerprint zero and are linked like any others; null doc_ids get their group's
id, or null if the group has no other; repeated rows are one class; very long texts are fingerprinted whole; an empty table gives no rows; other columns are ignored,
also those named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docprobe.llm.common import map_rows, stored, text_of
from docprobe.operators.names import spare

CAP = 64
SIGN = 1 << 63


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= SIGN else x


def _pivots(n: int) -> list[int]:
    """Reference fingerprints from a rule: multiples of the golden ratio, mixed."""
    out = []
    for k in range(1, n + 1):
        x = k * 0x9E3779B97F4A7C15 & (SIGN * 2 - 1)
        x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & (SIGN * 2 - 1)
        out.append(_signed(x ^ x >> 32))
    return out


PIVOTS = _pivots(16)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, A-Z lower-cased, joined by blanks; a shorter text is one run."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    runs = zip(*(w[i:] for i in range(words))) if len(w) >= words else [w]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(r), 42) for r in runs], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint of shingle hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (signed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), words)) for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fp": pa.array(fps, pa.int64())})

    return map_rows(docs.select(F.col("doc_id").cast("bigint"), text_of(docs).alias("text")), run, "doc_id bigint, fp bigint")


def pivot_row(fp: Column) -> Column:
    return F.array(*(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("tinyint") for p in PIVOTS))


def far_apart(a: Column, b: Column, radius: int) -> Column:
    """Whether the largest coordinate difference of two pivot rows rules the pair out."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("int") - y.cast("int")))) > radius


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band_masks(radius: int) -> list[int]:
    bands = radius + 3
    edges = [64 * i // bands for i in range(bands + 1)]
    masks = [sum(1 << k for k in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [_signed(x | y | z) for x, y, z in combinations(masks, 3)]


def links(fps: DataFrame, radius: int = 2, cap: int = CAP) -> DataFrame:
    """a, b (a < b): for each pair of distinct fingerprints within the radius, a link or a chain of links.

    Pairs in buckets of at most ``cap`` are all returned; members of larger ones are linked through shared one-bit neighbours.
    """
    if radius > 2:
        raise ValueError("larger buckets are only exact up to a radius of 2")
    n = fps.count()
    keys_each = len(band_masks(radius))
    table = stored(fps.select("fp", pivot_row(F.col("fp")).alias("row")), "simhash-pivots", n)
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(band_masks(radius)))))
    met = table.select("fp", "row", keys.alias("key")).select("fp", "row", "key.*")
    size = stored(met.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-buckets", n * keys_each // 2)
    met = stored(met.join(size, ["k", "v"]), "simhash-met", n * keys_each)
    small = met.where(F.col("n") <= cap)
    x, y = small.select("k", "v", F.col("fp").alias("a"), F.col("row").alias("ra")), small.select("k", "v", F.col("fp").alias("b"), F.col("row").alias("rb"))
    near = x.join(y, ["k", "v"]).where((F.col("a") < F.col("b")) & ~far_apart(F.col("ra"), F.col("rb"), radius) & (distance(F.col("a"), F.col("b")) <= radius)).select("a", "b")
    crowd = met.where(F.col("n") > cap).select("fp").distinct()
    around = crowd.select("fp", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)))).alias("v"))
    hubs = around.groupBy("v").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where(F.col("a") < F.col("top"))
    star = around.join(hubs.select("v", "a"), "v").where(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b"))
    return near.union(star).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, comp for every node of the edges; comp is some node of its component."""

    def rank(c: str, turn: int) -> Column:
        return F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("n"))

    now = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b"), "links")
    left = now.count()
    steps: list[DataFrame] = []
    while left:
        turn = len(steps)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(rank("b", turn)).alias("m"))
        step = stored(least.select(F.col("a").alias("node"), F.least("m", rank("a", turn))["n"].alias("to")), "joined", 2 * left)
        steps.append(step)
        one, two = step.select(F.col("node").alias("a"), F.col("to").alias("x")), step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = now.join(one, "a").join(two, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        now = stored(moved, "links", left)
        left = now.count()
    if not steps:
        return edges.sparkSession.createDataFrame([], "node bigint, comp bigint")
    comp = steps[0].withColumnRenamed("to", "comp")
    for k, step in enumerate(steps[1:], 1):
        comp = comp.join(step.withColumnRenamed("node", "at"), F.col("comp") == F.col("at"), "left").select("node", F.coalesce("to", "comp").alias("comp"))
        if k % 6 == 0:
            comp = stored(comp, "components")
    return comp


def near_groups(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links)."""
    each = stored(fingerprints(docs, words), "simhash-fingerprints")
    n = each.count()
    first = stored(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct", n)
    comp = components(links(first.select("fp"), radius))
    joined = first.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("comp", "fp").alias("root"))
    joined = stored(joined, "simhash-roots", n)
    lowest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    of = stored(joined.join(lowest, "root").select("fp", "component_id"), "simhash-components", n)
    return each.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- groups of texts alike in their shingles, for dropping near-duplicates ---

BANDS, ROWS, SLICE = 16, 3, 4096
#: A block of a crowded bucket holds about so many texts and so many distinct shingles at most.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: Bits of the map of a text's distinct shingles, in 64-bit words.
MAP_WORDS = 8
#: Reference maps: the empty one, and 15 from the rule of the other pivots.
PIVOT_MAPS = [[0] * MAP_WORDS, *(_pivots(15 * MAP_WORDS)[k * MAP_WORDS : (k + 1) * MAP_WORDS] for k in range(15))]


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, cls (hash of the word sequence), fp, m (number of distinct shingles), bits (map of distinct shingles), bands (each the hash of three least shingle hashes).

    Each distinct shingle sets one bit of the map, so two maps differ in at most as many bits as the sets differ in shingles.
    """
    rng = np.random.default_rng(20)
    mult = rng.integers(1, 1 << 63, BANDS * ROWS, np.uint64) | np.uint64(1)
    add = rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            cls, fps, sizes, maps, bands = [], [], [], [], []
            for cell in batch.column(1):
                text = cell.as_py()
                h = shingle_hashes(text, words)
                cls.append(xxhash.xxh3_128_hexdigest(b" ".join(text.encode("utf-8", "surrogatepass").lower().split())))
                fps.append(fingerprint(h))
                h = np.unique(h)
                sizes.append(len(h))
                bits = np.zeros(64 * MAP_WORDS, np.uint8)
                bits[(h % np.uint64(len(bits))).astype(np.int64)] = 1
                maps.append(np.packbits(bits, bitorder="little").view(np.int64))
                low = np.full(len(mult), np.iinfo(np.uint64).max, np.uint64)
                for a in range(0, len(h), 4096):
                    mixed = h[a : a + 4096, None] * mult[None, :] + add[None, :]
                    low = np.minimum(low, (mixed ^ (mixed >> np.uint64(31))).min(0))
                bands.append([_signed(xxhash.xxh64_intdigest(r.tobytes())) for r in low.reshape(BANDS, ROWS)])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "cls": pa.array(cls), "fp": pa.array(fps, pa.int64()), "m": pa.array(sizes, pa.int64()), "bits": pa.array(maps, pa.list_(pa.int64())), "bands": pa.array(bands, pa.list_(pa.int64()))})

    return map_rows(docs.select(F.col("doc_id").cast("bigint"), text_of(docs).alias("text")), run, "doc_id bigint, cls string, fp bigint, m bigint, bits array<bigint>, bands array<bigint>")


def map_pivot_row(bits: Column) -> Column:
    """Hamming distances of a map to the reference maps."""
    return F.array(*(sum((F.bit_count(bits[i].bitwiseXOR(F.lit(w))) for i, w in enumerate(p)), F.lit(0)).cast("smallint") for p in PIVOT_MAPS))


def may_be_alike(similarity: float, a: str, b: str) -> Column:
    """False only for pairs below the similarity: sets of ma and mb shingles that reach it differ in at most (1 - s) / (1 + s) of ma + mb.

    a, b: struct columns with m, bits and row (distances to the reference maps). The sizes come first, then the pivot table's largest coordinate difference,
    which is never above the distance of the maps, then that distance. One shingle of slack stands against rounding.
    """
    ma, mb = F.col(f"{a}.m"), F.col(f"{b}.m")
    most = (ma + mb) * F.lit((1 - similarity) / (1 + similarity)) + 1
    rows = F.array_max(F.zip_with(f"{a}.row", f"{b}.row", lambda x, y: F.abs(x.cast("int") - y.cast("int"))))
    differ = sum((F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(MAP_WORDS)), F.lit(0))
    return (F.abs(ma - mb) <= most) & (rows <= most) & (differ <= most)


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole texts (node, text) have the similarity; a's shingles are kept while a stays the same.

    Pairs and texts both grow with the input, so they meet by sorting, at every size.
    """
    tb, ta = texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    both = pairs.join(tb.hint("merge"), "b").join(ta.hint("merge"), "a")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:
                    last, left = a, np.unique(shingle_hashes(ta.as_py(), words))
                right = np.unique(shingle_hashes(tb.as_py(), words))
                shared = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(shared >= similarity * (len(left) + len(right) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_rows(both.select("a", "b", "ta", "tb"), compare, "a bigint, b bigint")


def links_in_block(nodes: list, parts: list, second: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of similarity or more that join all texts joined by such pairs, of different parts, of the first side and the second, or of the first
    side alone if the second is empty. Every pair is compared; a pair that earlier links have joined gives no further one.

    A text's shingles are marked, and the marks under each other text's shingles counted, for all of them at once.
    """
    order = np.argsort(second, kind="stable")
    nodes, sets, first = [nodes[i] for i in order], [sets[i] for i in order], int((~second).sum())
    label = np.unique([parts[i] for i in order], return_inverse=True)[1]
    size = np.array([len(s) for s in sets], np.int64)
    distinct, ids, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    many = count[ids] > 1  # a shingle of one text alone is shared with none
    ends = np.concatenate([[0], np.cumsum(many)])[np.concatenate([[0], np.cumsum(size)])]
    ids, mark, out = ids[many], np.zeros(len(distinct), bool), []
    for a in range(first):
        lo = first if first < len(nodes) else a + 1
        mine = ids[ends[a] : ends[a + 1]]
        mark[mine] = True
        hits = np.concatenate([[0], np.cumsum(mark[ids[ends[lo] :]], dtype=np.int64)])[ends[lo:] - ends[lo]]
        mark[mine] = False
        shared = np.diff(hits)
        for b in lo + np.flatnonzero((shared >= similarity * (size[a] + size[lo:] - shared)) & (label[lo:] != label[a])):
            if label[b] != label[a]:
                out.append((nodes[a], nodes[b]))
                label[label == label[b]] = label[a]
    return out


def crowded_links(large: DataFrame, part: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """a, b: links between the parts (node, comp; a node without a row is its own) that share a crowded bucket (k, v, node, m), none left out.

    Buckets of one part need no look. The others are dealt into blocks by hashing, a large part into blocks of its own, and each two blocks
    meet whole, except two of one part: the work is quadratic in a bucket's texts, but in many tasks of bounded size.
    """
    at = large.select("k", "v", "node", "m").join(part, "node", "left").select("k", "v", "node", "m", F.coalesce("comp", "node").alias("comp"))
    at = stored(at, "alike-crowd")
    need = lambda c, w: F.greatest(F.ceil(F.col(c) / BLOCK), F.ceil(F.col(w) / BLOCK_SHINGLES), F.lit(1))
    sizes = at.groupBy("k", "v", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("m").alias("w")).withColumn("own", (2 * F.col("c") > BLOCK) | (2 * F.col("w") > BLOCK_SHINGLES))
    pool = sizes.groupBy("k", "v").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.when(~F.col("own"), F.col("c"))).alias("pc"), F.sum(F.when(~F.col("own"), F.col("w"))).alias("pw")).where("parts > 1")
    sizes = sizes.join(pool, ["k", "v"]).select("k", "v", "comp", "own", F.when(F.col("own"), need("c", "w")).otherwise(need("pc", "pw")).alias("slots"))
    slot = F.pmod(F.xxhash64(F.when(F.col("own"), F.col("node")).otherwise(F.col("comp")), F.lit(9)), F.col("slots"))
    at = at.join(sizes, ["k", "v", "comp"]).select("k", "v", "node", "comp", F.when(F.col("own"), F.col("comp")).alias("of"), F.concat_ws(":", F.when(F.col("own"), F.col("comp").cast("string")).otherwise("pool"), slot).alias("block"))
    at = stored(at, "alike-blocks")
    blocks = at.groupBy("k", "v", "block").agg(F.first("of").alias("of"))
    one, two = blocks.select("k", "v", F.col("block").alias("i"), F.col("of").alias("oi")), blocks.select("k", "v", F.col("block").alias("j"), F.col("of").alias("oj"))
    duels = one.join(two, ["k", "v"]).where((F.col("i") <= F.col("j")) & F.coalesce(F.col("oi") != F.col("oj"), F.lit(True))).select("k", "v", "i", "j")
    duels = stored(duels, "alike-duels")
    sides = duels.select("*", F.col("i").alias("block"), F.lit(False).alias("second")).union(duels.where("i <> j").select("*", F.col("j").alias("block"), F.lit(True).alias("second")))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("node"), text_of(docs).alias("text")).join(at.select("node").distinct().hint("merge"), "node", "left_semi").dropDuplicates(["node"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"node": batch.column(0), "shingles": pa.array(sets, pa.binary())})

    def compare(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(s.as_buffer() or b"", np.uint64) for s in table.column("shingles")]
        got = links_in_block(table.column("node").to_pylist(), table.column("comp").to_pylist(), np.array(table.column("second").to_pylist(), bool), sets, similarity)
        return pa.table({"a": pa.array([a for a, _ in got], pa.int64()), "b": pa.array([b for _, b in got], pa.int64())})

    shingles = stored(map_rows(texts, cut, "node bigint, shingles binary"), "alike-shingles")
    met = sides.join(at.select("k", "v", "block", "node", "comp"), ["k", "v", "block"]).join(shingles.hint("merge"), "node")
    return met.select("k", "v", "i", "j", "second", "node", "comp", "shingles").groupBy("k", "v", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def alike(docs: DataFrame, words: int = 5, similarity: float = 0.8, cap: int = CAP, anchors: int = 4) -> DataFrame:
    """doc_id, keep_id: documents whose word sequences are equal, or whose sets of shingles have a Jaccard similarity of
    ``similarity`` or more (directly or over others), share a keep_id, the smallest of their doc_ids.

    Distinct word sequences meet where they share a band; only pairs that their numbers and maps of distinct shingles prove less alike are
    discarded (by the maps' pivot table first), and the exact similarity of whole texts decides. In a band's bucket of more than ``cap`` texts each first meets ``anchors`` of them and its successor; the parts that this leaves
    in a bucket are then compared whole.
    """
    each = stored(sketches(docs, words), "alike-sketches")
    n = each.count()
    first = stored(each.groupBy("cls").agg(F.min("doc_id").alias("node"), F.first("fp").alias("fp"), F.first("m").alias("m"), F.first("bits").alias("bits"), F.first("bands").alias("bands")), "alike-distinct", n)
    met = first.where(F.col("node").isNotNull()).withColumn("row", map_pivot_row(F.col("bits"))).select(F.struct("node", "fp", "m", "bits", "row").alias("s"), F.posexplode("bands").alias("k", "v"))
    size = stored(met.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "alike-buckets", n * BANDS // 2)
    met = stored(met.join(size, ["k", "v"]).select("k", "v", "n", "s.node", "s.m", "s"), "alike-met", n * BANDS)
    small, large = met.where(F.col("n") <= cap), met.where(F.col("n") > cap)

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select("k", "v", F.col("node").alias(s), F.col("s").alias(f"s{s}"))

    pairs = side(small, "a").join(side(small, "b"), ["k", "v"]).where("a < b").select("sa", "sb")
    # crowded buckets: a few anchors (least by hash, found by aggregation alone), and neighbours in slices of the order by fingerprint
    chosen = large.groupBy("k", "v").agg(*(F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), "s")).alias(f"m{i}") for i in range(anchors)))
    chosen = chosen.select("k", "v", F.explode(F.array_distinct(F.array(*(F.col(f"m{i}.s") for i in range(anchors))))).alias("sa"))
    star = side(large, "b").join(chosen, ["k", "v"]).where("sa.node <> b").select("sa", "sb")
    slices = F.pmod(F.xxhash64("node", F.lit(5)), F.ceil(F.col("n") / SLICE))  # no window holds much more than SLICE rows
    order = Window.partitionBy("k", "v", slices).orderBy("s.fp", "node")
    chain = large.select(F.col("s").alias("sa"), F.lead("s").over(order).alias("sb")).where("sb is not null")
    near = pairs.union(star).union(chain).where(may_be_alike(similarity, "sa", "sb"))
    near = stored(near.select(F.least("sa.node", "sb.node").alias("a"), F.greatest("sa.node", "sb.node").alias("b"), distance(F.col("sa.fp"), F.col("sb.fp")).alias("d")).distinct(), "alike-pairs", n * BANDS)
    wanted = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("node"), text_of(docs).alias("text")).join(wanted.hint("merge"), "node", "left_semi")
    texts = stored(texts.dropDuplicates(["node"]), "alike-texts")
    # each text's nearest partner first; what those links join needs no further look, and all other pairs are verified after them
    both = near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    nearest = both.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b")).distinct()
    sure = stored(verified(nearest, texts, words, similarity), "alike-nearest")
    part = components(sure)
    left, right = part.select(F.col("node").alias("a"), F.col("comp").alias("ca")), part.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    rest = near.select("a", "b").join(left, "a", "left").join(right, "b", "left").where(F.coalesce(F.col("ca") != F.col("cb"), F.lit(True)))
    rest = rest.select("a", "b").join(nearest, ["a", "b"], "left_anti")
    more = stored(verified(rest, texts, words, similarity), "alike-rest")
    found = sure.union(more)
    if not large.isEmpty():
        found = found.union(stored(crowded_links(large, components(found), docs, words, similarity), "alike-crowded"))
    comp = components(found)
    roots = stored(first.join(comp, "node", "left").select("cls", "node", F.coalesce("comp", "node").alias("root")), "alike-roots", n)
    lowest = roots.groupBy("root").agg(F.min("node").alias("keep_id"))
    of = stored(roots.join(lowest, "root", "left").select("cls", "keep_id"), "alike-kept", n)
    return each.join(of, "cls").select("doc_id", "keep_id")


def without_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id; of rows that repeat that id, one. Rows without a doc_id stay. All columns are kept."""
    groups = alike(docs, words, similarity)
    kept = stored(groups.where((F.col("doc_id") == F.col("keep_id")) | F.col("doc_id").isNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "alike-ids", docs.count())
    kept_id, place = spare(docs, "_kept_doc_id", "_place")
    same = docs["doc_id"].eqNullSafe(F.col(kept_id))
    out = docs.join(kept.select(F.col("doc_id").alias(kept_id)).hint("merge"), same, "left_semi")  # as many ids as documents: never broadcast
    if kept.where("n > 1").isEmpty():
        return out
    many = kept.where("n > 1").select(F.col("doc_id").alias(kept_id))
    order = Window.partitionBy("doc_id").orderBy(F.to_json(F.struct(*(docs[f"`{c}`"] for c in docs.columns if c != "doc_id"))))
    once = out.join(many, out["doc_id"].eqNullSafe(F.col(kept_id)), "left_semi").withColumn(place, F.row_number().over(order)).where((F.col(place) == 1) | F.col("doc_id").isNull()).drop(place)
    return out.join(many, out["doc_id"].eqNullSafe(F.col(kept_id)), "left_anti").unionByName(once)
