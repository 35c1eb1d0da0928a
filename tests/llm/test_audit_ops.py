"""Hard negatives, WARC archives and the filter audit against brute force, on odd rows and on empty tables."""

import gzip
import io
import math
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docprobe.llm import filter_audit, hard_negatives, warc
from docprobe.llm.common import join_groups

VECTORS = "vec_id bigint, embedding array<float>, label int, q int, a string, n int, g int, p string"


def by_hand(rows, every, positives=5, negatives=3):
    """The contract's words, over lists of (id, vector, label)."""
    good = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, [max(-(1 << 21), min(1 << 21, math.floor(256 * float(np.float32(x))))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for i, v, label in {(i, tuple(v), label) for i, v, label in good if i % every == 0}:
        scored = [(sum(x * y for x, y in zip(v, w)), j, m) for j, w, m in good]
        near = sorted((-s, j) for s, j, m in scored if m == label and j != i)[:positives]
        for s, j in near:
            far = sorted((-t, k) for t, k, m in scored if m != label and -50 * s <= 100 * t <= -95 * s)[:negatives]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(far)]
    return sorted(out)


def mined(spark, rows, every, **more):
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], VECTORS).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mined(df, F.col("vec_id") % every == 0, label, **more)
    return sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def test_hard_negatives(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(0, 0.2, 8).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(300)]
    rows += [(300 + i, rows[5][1], 1 + i % 2) for i in range(40)]  # one vector on many rows: ties by id
    rows += [(400, None, 1), (405, [0.1] * 8, None), (None, [0.1] * 8, 1), (410, [0.1, None, 0.3], 1), (415, [float("nan")] * 8, 1), (420, [float("inf")] * 8, 1)]
    rows += [(425, [], 1), (430, [0.5, 0.5], 2), (435, [1e30, -1e30, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], 0), (440, rows[5][1], 1), (440, rows[5][1], 1), (-5, rows[6][1], 0), (10, rows[7][1], 2)]
    want = by_hand(rows, 5)
    assert len(want) > 100
    assert mined(spark, rows, 5) == want


def test_hard_negatives_without_rows(spark):
    assert mined(spark, [], 5) == []
    assert mined(spark, [(1, [0.5], 1)], 5) == []
    assert mined(spark, [(5, [0.5], 1)], 5) == []


def test_tree_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(2)
    middles = rng.normal(0, 300, (8, 16))
    x = np.concatenate([rng.normal(m, 6, (500, 16)) for m in middles]).astype(np.int32)
    label = rng.integers(0, 4, len(x))
    order, nodes = hard_negatives.grown(x, label)
    tree = nodes | {"ids": np.arange(len(x))[order], "rows": x[order]}
    for a, b, c, r in zip(nodes["first"], nodes["last"], nodes["centre"].astype(float), nodes["radius"]):
        assert np.sqrt(((x[order][a:b] - c) ** 2).sum(1)).max() <= r + 1e-6
    q = x[::97]
    anchor, full = np.arange(len(q)), q.astype(np.int64) @ x.astype(np.int64).T
    lo, hi = np.full(len(q), 20_000), (full.max(1) * 0.9).astype(np.int64)
    best = hard_negatives.Best(len(q), 3)
    scored = hard_negatives.search(tree, q, anchor, np.arange(len(x))[::97], label[::97], False, lo, hi, best)
    for i in range(len(q)):
        want = sorted((-s, j) for j, s in enumerate(full[i].tolist()) if label[j] != label[::97][i] and lo[i] <= s <= hi[i])[:3]
        got = [(-s, j) for s, j in zip(best.score[i].tolist(), best.id[i].tolist()) if s > hard_negatives.NONE]
        assert got == want
    assert scored < 0.5 * full.size
    nearest = hard_negatives.Best(len(q), 3)
    few = hard_negatives.search(tree, q, anchor, np.arange(len(x))[::97], label[::97], True, np.full(len(q), -(1 << 60)), np.full(len(q), 1 << 60), nearest)
    assert few < 0.1 * full.size  # a quarter of the rows has the anchor's label


def test_queries_in_several_passes(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.3, (200, 4)).astype(np.float32).tolist()
    rows = hard_negatives.prepared(spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int"))
    asked = rows.where("vec_id < 60").withColumn("a", F.col("vec_id")).withColumns({"p": F.lit(0), "lo": F.lit(-10**12), "hi": F.lit(10**12)})
    packs = hard_negatives.packed_queries(asked, 60, size=10)
    assert packs.count() > 3
    blocks = hard_negatives.trees(rows, block_rows=50)
    order = ["a", "place"]
    once = hard_negatives.best_of(blocks, packs, 2, True, "t").orderBy(*order).collect()
    assert once == hard_negatives.best_of(blocks, packs, 2, True, "t", limit=1).orderBy(*order).collect() and len(once) == 120


# --- archives ---


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", 7, None, 3) for r in rows], "page_id bigint, url string, html string, key string, refers_to int, name string, n int")


def read_back(spark, tmp_path, rows, **more):
    warc.write_archives(pages(spark, rows).repartition(3), f"{tmp_path}/w", **more)
    return {r.page_id: r for r in warc.read_archives(spark, f"{tmp_path}/w").collect()}


def test_archives(spark, tmp_path):
    long = "".join(f"<p>é {i}</p>\r\n\r\n" for i in range(60_000))
    rows = [(1, "http://a/", "same"), (2, None, "same"), (3, "http://b/\r\nX: y", "same"), (4, "u", None), (5, "u", ""), (6, "u", long), (7, "u", "\x00\r\n\r\nWARC/1.1\r\n"), (-8, "http://ü/", "alone")]
    got = read_back(spark, tmp_path, rows)
    assert set(got) == {r[0] for r in rows}
    for i, url, html in rows:
        payload = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(payload), warc.digest(payload))
        assert got[i].url == (None if url is None else url.replace("\r", "%0D").replace("\n", "%0A"))
        assert got[i].html == (None if got[i].record_type == "revisit" else html or "")
    assert {i: r.refers_to for i, r in got.items()} == {1: 3, 2: 3, 3: None, 4: 5, 5: None, 6: None, 7: None, -8: None}
    assert all((r.record_type == "revisit") == (r.refers_to is not None) for r in got.values())


def test_archives_of_odd_rows(spark, tmp_path):
    rows = [(1, "u", "x"), (1, "u", "x"), (None, "u", "x"), (None, "u", "y"), (0, "u", "xy"), (2, "v", "xy")]
    warc.write_archives(pages(spark, rows), f"{tmp_path}/w", least_bytes=2, archive_bytes=1)
    got = sorted((r.page_id is None, r.page_id or 0, r.html or "", r.refers_to or -1) for r in warc.read_archives(spark, f"{tmp_path}/w").collect())
    assert got == [(False, 0, "", 2), (False, 1, "x", -1), (False, 1, "x", -1), (False, 2, "xy", -1), (True, 0, "x", -1), (True, 0, "y", -1)]
    assert [tuple(r) for r in warc.write_and_read(pages(spark, rows[:3])).select("page_id", "refers_to").collect()].count((None, 1)) == 1
    assert warc.write_and_read(pages(spark, [])).count() == 0


def test_crowded_payload(spark):
    rows = [(i, "u", "copy" if i % 3 else f"own {i}") for i in range(4000)]
    got = warc.write_and_read(pages(spark, rows))
    assert got.groupBy("record_type").count().orderBy("record_type").collect() == [("response", 1335), ("revisit", 2665)]
    assert got.where("refers_to is not null and refers_to <> 3998").count() == 0


def member(page_id=1, payload=b"hello " * 999, to=None):
    return warc.page_record(page_id, "u", payload, to, "2020-01-01T00:00:00Z")


def test_reader_goes_record_by_record():
    data = member(1) + member(2, b"") + member(3, b"x", 1)
    got = [warc.page_of(*r) for r in warc.records(io.BytesIO(data))]
    assert [(r[0], r[2], r[4], r[5]) for r in got] == [(1, 5994, "response", None), (2, 0, "response", None), (3, 1, "revisit", 1)]
    assert list(warc.records(io.BytesIO(b""))) == []
    again = gzip.decompress(member(1))  # another writer's member, weakly packed, read in pieces
    assert warc.page_of(*next(warc.records(io.BytesIO(gzip.compress(again, 1)))))[0] == 1


def test_reader_refuses_damage():
    whole = gzip.decompress(member())
    for bad in (whole.replace(b"hello", b"hullo", 1), whole[:-4], whole + b"\r\n", whole.replace(b"WARC/1.1", b"WURC/1.1"), whole.replace(b"Content-Length: 6", b"Content-Length: 7"), whole.split(b"\r\n\r\n")[0]):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(gzip.compress(bad))))
    for cut in (5, 40, len(member()) - 3):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(member()[:cut])))
    fields, block = next(warc.records(io.BytesIO(member())))
    with pytest.raises(ValueError):
        warc.page_of(fields | {"warc-payload-digest": "sha1:AAAA"}, block)


# --- filters ---


def report_by_hand(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    parts = {}
    for i, text, source in docs:
        text = text or ""
        words = text.encode().split()
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text), "E": i is not None and i > first[text]}
        parts.setdefault(source or "", []).append(({f for f, x in fails.items() if x}, i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        shapley = {f: sum(f in x and not x & set(o[: o.index(f)]) for o in permutations("ABCDE") for x, _, _ in rows) for f in "ABCDE"}
        for o in permutations("ABCDE"):
            for k, f in enumerate(o):
                here = [r for r in rows if not r[0] & set(o[:k])]
                lost = [r for r in here if f in r[0]]
                failing = sum(f in x for x, _, _ in rows)
                out.append((part, "".join(o), k + 1, len(here) - len(lost), len(lost), failing - len(lost), sum(x == {f} for x, _, _ in rows), sum(g for _, g, _ in lost), sum(t for _, _, t in lost), shapley[f]))
    return sorted(out)


COLUMNS = ("part", "filter_order", "step", *filter_audit.REPORT)


def test_audit_of_odd_rows(spark, odd_docs, no_docs, labels):
    marks = [tuple(r) for r in labels.collect()]
    docs = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    got = sorted(map(tuple, filter_audit.audit(odd_docs, labels).select(*COLUMNS).collect()))
    assert got == report_by_hand(docs, marks)
    assert filter_audit.audit(no_docs, labels).count() == 0
    assert sorted(map(tuple, filter_audit.audit(odd_docs, labels.limit(0)).select(*COLUMNS).collect())) == report_by_hand(docs, [])


def test_audit_of_copies(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)] + ["Big", "a#b", "é"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 600))) for _ in range(60)]
    texts += [t[:-1] + "x" for t in texts[:20]] + ["A" + t[1:] for t in texts[:20]]  # of one length, unlike at the end or at the start
    docs = [(int(i), texts[int(rng.integers(0, len(texts)))] if i % 3 else texts[0], f"s{i % 3}") for i in rng.permutation(2500)]
    marks = [(int(i), int(i) % 2, int(i) % 5 // 4) for i in range(0, 2500, 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = filter_audit.audit(df, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.select(*COLUMNS).collect())) == report_by_hand(docs, marks)


def test_texts_of_one_class_are_compared_whole(spark):
    """Were all hashes equal, the texts would still decide: what differs from its class's first text is compared with the next one."""
    rows = [(5, "a"), (3, "b"), (9, "a"), (4, "b"), (7, "c")]
    kinds = "doc_id long, length long, " + ", ".join(f"{h} long" for h in filter_audit.HASHES) + ", text string, size long, least long"
    same, rest = filter_audit.compared(spark.createDataFrame([(i, 1, 0, 0, 0, 0, t, 5, 3) for i, t in rows], kinds))
    assert [r.doc_id for r in same.collect()] == [4]
    assert sorted(r.doc_id for r in rest.collect()) == [5, 7, 9]


def test_block_hashes_follow_the_blocks():
    text = bytes(range(256)) * 300
    ends = [256, 4352, 69888]
    base = filter_audit.block_hashes(text)
    for k, at in enumerate([0, 256, 4352, 69888]):
        changed = bytearray(text)
        changed[at] ^= 1
        assert [i for i, (x, y) in enumerate(zip(base, filter_audit.block_hashes(bytes(changed)))) if x != y] == [k]
    assert filter_audit.block_hashes(b"") == filter_audit.block_hashes(b"") and len(base) == len(ends) + 1


def test_join_groups_spreads_crowded_ones(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("k"))
    groups = spark.createDataFrame([(0, 4000, "hot"), (4500, 1, "own")], "k int, n long, v string")
    got = join_groups(rows, groups, ["k"], 5000, F.col("id"))
    assert got.columns == ["id", "k", "group"]
    assert {(r[0], r[1]) for r in got.groupBy("group.v").count().collect()} == {("hot", 4000), ("own", 1), (None, 999)}
