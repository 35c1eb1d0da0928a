"""Hard negatives for contrastive training: rows of another label whose score lies in a window beneath a positive's.

The rows are cut into blocks of about ``BLOCK_ROWS``; each block holds a ball tree for each of its labels (a node: centre, radius, rows from .. to), built where the
rows are and stored as one row of a table. Inner products of an anchor q with the rows of a node lie within q . centre +- |q| radius. A node goes
if that range misses the score window or ends strictly beneath the anchor's current k-th best; the label of a tree rules it in or out as a whole. What is left at the
leaves is scored exactly (products of whole numbers, in the narrowest type that holds every partial sum).

Anchors are the stated query set. They travel in packed groups of about ``ANCHORS``, broadcast a bounded number of bytes at a time
(``BROADCAST``; one pass over the trees for each), so no row of the table is shuffled against them. A task keeps each anchor's best over all trees it sees and
returns those alone; a window over at most k rows an anchor and task picks the best of all. Two searches: the k best of the same label, then the window of each.

Defined results: rows without an id, label or vector, or with a null, infinite or NaN component take no part; rows that repeat an id are rows each, none of which is
another's positive; anchors that repeat a whole row count once; scores tie by the smaller id; a shorter vector counts as continued with zeros; whole components saturate at
+-2**21, so that windows of up to 16,384 components fit a long; a positive with a negative score has no window; an empty table gives no rows; other columns are
ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docprobe.llm.common import map_rows, stored

BLOCK_ROWS, LEAF, ANCHORS, BROADCAST = 4096, 64, 256, 32 << 20
HIGHEST = 1 << 21
NONE = np.iinfo(np.int64).min
TREE = "ids binary, rows binary, dims int, first binary, last binary, child binary, label binary, centre binary, radius binary"


def prepared(vectors: DataFrame, corrected: Column | None = None) -> DataFrame:
    """vec_id, label, q (whole components) of the rows that take part. corrected: the label to use, from columns vec_id and label."""
    rows = vectors.select(vectors["vec_id"].cast("bigint").alias("vec_id"), vectors["label"].cast("bigint").alias("label"), vectors["embedding"].cast("array<double>").alias("e"))
    sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & sound)
    whole = F.transform("e", lambda x: F.greatest(F.lit(-HIGHEST), F.least(F.lit(HIGHEST), F.floor(x * 256.0))).cast("int"))
    return rows.select("vec_id", (F.col("label") if corrected is None else corrected).alias("label"), whole.alias("q"))


def matrix(cells: pa.Array) -> np.ndarray:
    """Vectors as rows of one int32 array, shorter ones with zeros behind."""
    lengths = np.diff(cells.offsets.to_numpy())
    values = cells.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    dims = int(lengths.max(initial=0))
    if (lengths == dims).all():
        return values.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims), np.int32)
    out[np.arange(dims) < lengths[:, None]] = values
    return out


def grown(x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(order of the rows, nodes): a tree for each label. Node: first and last row, child (its first; the other follows; -1: a leaf), label, centre, radius."""
    order = np.argsort(label, kind="stable")
    cuts = np.flatnonzero(np.diff(label[order])) + 1
    ends = np.concatenate([[0], cuts, [len(x)]])
    nodes = [[a, b, -1] for a, b in zip(ends, ends[1:])]
    i = 0
    while i < len(nodes):
        a, b, _ = nodes[i]
        if b - a > LEAF:
            part = x[order[a:b]].astype(float)
            far = part[np.argmax(((part - part.mean(0)) ** 2).sum(1))]
            across = part[np.argmax(((part - far) ** 2).sum(1))] - far
            mid = (a + b) // 2
            order[a:b] = order[a:b][np.argpartition(part @ across, mid - a)]
            nodes[i][2] = len(nodes)
            nodes += [[a, mid, -1], [mid, b, -1]]
        i += 1
    x = x[order].astype(float)
    centre = np.array([x[a:b].mean(0) for a, b, _ in nodes], np.float32)
    radius = np.array([np.sqrt(((x[a:b] - c) ** 2).sum(1).max()) for (a, b, _), c in zip(nodes, centre.astype(float))])
    first, last, child = (np.array(c, np.int64) for c in zip(*nodes))
    return order, {"first": first, "last": last, "child": child, "label": label[order][first], "centre": centre, "radius": radius}


def trees(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row a block: its rows in the order of its trees, and the nodes."""

    def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        x = matrix(batch.column(2))
        order, nodes = grown(x, label)
        cells = {"ids": ids[order], "rows": x[order]} | nodes
        out = {c: pa.array([v.tobytes()], pa.binary()) for c, v in cells.items()} | {"dims": pa.array([x.shape[1]], pa.int32())}
        return pa.RecordBatch.from_pydict({c: out[c] for c in (f.split()[0] for f in TREE.split(", "))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                piece, batch = batch.slice(0, block_rows - n), batch.slice(block_rows - n)
                held, n = [*held, piece], n + piece.num_rows
                if n == block_rows:
                    yield packed(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, n = [], 0
        if n:
            yield packed(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return map_rows(rows, run, TREE)


def products(q: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products (int64). most: |q| |x| at the largest, which no partial sum exceeds."""
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (q.astype(kind) @ x.astype(kind).T).astype(np.int64)


class Best:
    """The k best (score down, id up) of each of n queries."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), NONE), np.zeros((n, k), np.int64)

    def kth(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(query)
        old = self.score[touched].ravel(), self.id[touched].ravel(), np.repeat(touched, self.k)
        real = old[0] > NONE
        score, ids, query = (np.concatenate([o[real], n]) for o, n in zip(old, (score, ids, query)))
        order = np.lexsort((ids, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        self.score[query[keep], place[keep]] = score[order][keep]
        self.id[query[keep], place[keep]] = ids[order][keep]


def search(tree: dict[str, np.ndarray], q: np.ndarray, anchor: np.ndarray, ids: np.ndarray, label: np.ndarray, same: bool, lo: np.ndarray, hi: np.ndarray, best: Best) -> int:
    """Adds to ``best`` what a block has for each query (anchor: its row of q, ids and label), by branch and bound. Returns the number of pairs scored."""
    dims = max(q.shape[1], tree["rows"].shape[1])
    wide = lambda m: np.pad(m, ((0, 0), (0, dims - m.shape[1]))) if m.shape[1] < dims else m
    q, x, centre = wide(q), wide(tree["rows"]), wide(tree["centre"])
    norm = np.sqrt((q.astype(float) ** 2).sum(1))
    most = float(norm.max(initial=0.0)) * float(np.sqrt((x.astype(float) ** 2).sum(1).max(initial=0.0)))
    middle = q.astype(float) @ centre.astype(float).T
    reach = norm[:, None] * tree["radius"] * (1 + 1e-9) + 1e-9 * (most + 1) + 1e-6
    top, low = (middle + reach)[anchor], (middle - reach)[anchor]
    roots = np.ones(len(centre), bool)
    roots[tree["child"][tree["child"] >= 0]] = roots[tree["child"][tree["child"] >= 0] + 1] = False
    wanted = (tree["label"] == label[anchor][:, None]) if same else (tree["label"] != label[anchor][:, None])
    fits = wanted & (low <= hi[:, None]) & (top >= np.maximum(lo, best.kth())[:, None])
    alive, leaves, level = np.zeros_like(fits), [], np.flatnonzero(roots)
    alive[:, level] = fits[:, level]
    while len(level):
        level = level[alive[:, level].any(0)]
        inner = level[tree["child"][level] >= 0]
        leaves.append(level[tree["child"][level] < 0])
        for side in (0, 1):
            below = tree["child"][inner] + side
            alive[:, below] = alive[:, inner] & fits[:, below]
        level = np.concatenate([tree["child"][inner], tree["child"][inner] + 1])
    found, scored = np.concatenate(leaves) if leaves else np.zeros(0, int), 0

    def visit(node: int, who: np.ndarray) -> int:
        asked, back = np.unique(anchor[who], return_inverse=True)
        a, b = tree["first"][node], tree["last"][node]
        got = products(q[asked], x[a:b], most)
        n, got = got.size, got[back]
        good = (got >= np.maximum(lo[who], best.kth()[who])[:, None]) & (got <= hi[who][:, None])
        if same:
            good &= tree["ids"][a:b] != ids[anchor[who]][:, None]
        i, j = np.nonzero(good)
        if len(i):
            best.add(who[i], got[i, j], tree["ids"][a:b][j])
        return n

    # each query's most promising leaf first, which gives it a k-th best to prune with; then the leaves by what they promise to anyone
    ahead = np.where(alive[:, found], np.minimum(top[:, found], hi[:, None]), -np.inf)
    if len(found):
        first = np.where(np.isfinite(ahead.max(1)), found[ahead.argmax(1)], -1)
        for node in np.unique(first[first >= 0]):
            who = np.flatnonzero(first == node)
            scored += visit(node, who)
            alive[who, node] = False
    for node in found[np.argsort(-ahead.max(0, initial=-np.inf), kind="stable")]:
        who = np.flatnonzero(alive[:, node] & (top[:, node] >= best.kth()))
        if len(who):
            scored += visit(node, who)
    return scored


def _tree(row: dict, dims: int) -> dict[str, np.ndarray]:
    kinds = {"ids": np.int64, "rows": np.int32, "first": np.int64, "last": np.int64, "child": np.int64, "label": np.int64, "centre": np.float32, "radius": np.float64}
    out = {c: np.frombuffer(row[c].as_buffer(), k) for c, k in kinds.items()}
    return out | {"rows": out["rows"].reshape(len(out["ids"]), dims), "centre": out["centre"].reshape(len(out["first"]), dims)}


def packed_queries(queries: DataFrame, n: int, size: int = ANCHORS) -> DataFrame:
    """g (number of the group), size (bytes) and pack: the queries (a, vec_id, label, q, p, lo, hi) in groups of about ``size`` anchors, each vector once."""

    def pack(table: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.drop_columns(["g"]).schema) as out:
            out.write_table(table.drop_columns(["g"]))
        data = sink.getvalue().to_pybytes()
        return pa.table({"g": pa.array([table.column("g")[0].as_py()], pa.int32()), "size": pa.array([len(data)], pa.int64()), "pack": pa.array([data], pa.binary())})

    groups = max(1, -(-n // size))
    slim = queries.groupBy("a", "vec_id", "label", "q").agg(F.sort_array(F.collect_list(F.struct("p", "lo", "hi"))).alias("w"))  # at most k windows an anchor
    return slim.withColumn("g", F.pmod(F.xxhash64("a"), F.lit(groups)).cast("int")).groupBy("g").applyInArrow(pack, "g int, size bigint, pack binary")


def best_of(blocks: DataFrame, packs: DataFrame, k: int, same: bool, name: str, limit: int = BROADCAST) -> DataFrame:
    """a, p, score, id, place (from 1): the k best rows of each query over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple] = {}
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            for i in range(batch.num_rows):
                g = columns["g"][i].as_py()
                if g not in state:
                    table = pa.ipc.open_stream(columns["pack"][i].as_buffer()).read_all().combine_chunks()
                    w = table.column("w").combine_chunks()
                    anchor = np.repeat(np.arange(len(w)), np.diff(w.offsets.to_numpy()))
                    p, lo, hi = (w.flatten().field(c).to_numpy(zero_copy_only=False) for c in range(3))
                    of = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)  # noqa: B023, E731
                    state[g] = (matrix(table.column("q").combine_chunks()), anchor, of("vec_id"), of("label"), lo, hi, of("a")[anchor], p, Best(len(anchor), k))
                q, anchor, ids, label, lo, hi, _, _, best = state[g]
                search(_tree({c: v[i] for c, v in columns.items()}, columns["dims"][i].as_py()), q, anchor, ids, label, same, lo, hi, best)
        for *_, a, p, best in state.values():
            query, place = np.nonzero(best.score > NONE)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a[query]), "p": pa.array(p[query], pa.int32()), "score": pa.array(best.score[query, place]), "id": pa.array(best.id[query, place])})

    sizes = packs.agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("most")).first()
    at_once = max(1, limit // max(sizes["most"] or 1, 1))
    out = None
    for lo in range(0, sizes["n"], at_once):
        some = packs.where(F.col("g").between(lo, lo + at_once - 1)) if sizes["n"] > at_once else packs
        asked = F.explode(F.sequence(F.lit(lo), F.lit(min(lo + at_once, sizes["n"]) - 1)))
        met = blocks.withColumn("g", asked).join(F.broadcast(some.drop("size")), "g")
        got = stored(map_rows(met, run, "a bigint, p int, score bigint, id bigint"), name)
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = blocks.sparkSession.createDataFrame([], "a bigint, p int, score bigint, id bigint")
    place = F.row_number().over(Window.partitionBy("a", "p").orderBy(F.col("score").desc(), "id"))
    return out.withColumn("place", place).where(F.col("place") <= k)


def mined(vectors: DataFrame, anchors: Column, corrected: Column | None = None, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (a condition on vec_id and label) and each of its first ``positives`` other
    rows of its label, the first ``negatives`` rows of another label with a score from ``low`` to ``high`` hundredths of the positive's."""
    rows = stored(prepared(vectors, corrected), "mine-rows")
    n = rows.count()
    blocks = stored(trees(rows.repartition(max(1, -(-n // BLOCK_ROWS)))), "mine-trees")
    blocks = blocks.repartition(max(1, -(-n // BLOCK_ROWS)))  # a few blocks a file: deal them out again
    asked = stored(rows.where(anchors).distinct().withColumn("a", F.monotonically_increasing_id()), "mine-anchors")
    n_asked = asked.count()
    whole = asked.select("a", "vec_id", "label", "q", F.lit(0).alias("p"), F.lit(int(NONE) + 1).alias("lo"), F.lit(int(np.iinfo(np.int64).max)).alias("hi"))
    near = best_of(blocks, stored(packed_queries(whole, n_asked), "mine-queries"), positives, True, "mine-near")
    near = stored(near.select("a", F.col("place").alias("p"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "mine-positives")
    windows = near.where("positive_score >= 0").select("a", "p", F.expr(f"({low} * positive_score + 99) div 100").alias("lo"), F.expr(f"{high} * positive_score div 100").alias("hi"))
    packs = stored(packed_queries(asked.join(windows, "a"), n_asked), "mine-windows")
    far = best_of(blocks, packs, negatives, False, "mine-far")
    out = far.join(near, ["a", "p"]).join(asked.select("a", F.col("vec_id").alias("anchor_id")), "a")
    return out.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
