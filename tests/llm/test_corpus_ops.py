"""Token files, packing, near-duplicates, fingerprints, mixing, and the pipeline."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docprobe.llm import packing, simhash, spotsigs, systematic_mix, token_codec, tokens

SF = "/root/testdata/sf0.01"


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


# --- token ids ---


@pytest.mark.parametrize("name,dropped", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_remembered_pieces_give_the_library_s_ids(name, dropped):
    enc = tokens.encoder(tokens.public_path(name), dropped)
    assert enc.by_model
    rng = random.Random(1)
    alphabet = [*"abcDEZéßñ' .,'!?\n\t  12²½ªµά'“’—§¶<|>%İﬁ", "'s", "'t", "'re", " '", "  ", "\r\n", "　", "́", "\x0b", "\x1c", "\x85", "\xa0", "<|endoftext|>", "é"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + ["", "Don't you'll it's", "x" * 5000]
    want = [np.array(e.ids, "<u4").tobytes() for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert enc.ids(texts) == want and enc.ids(texts) == want


def test_words_round_trip():
    rng = random.Random(2)
    for _ in range(400):
        top = rng.choice([0, 1, 3, 8, 16, 20, 33, 60, 64])
        v = np.array([rng.getrandbits(rng.randint(0, top)) if top else 0 for _ in range(rng.randint(0, 300))], np.uint64)
        words = token_codec.pack(v)
        assert (token_codec.unpack(words, len(v)) == v).all()
    ids, lengths = np.arange(5000) % 700, np.array([1, 4999])
    a, b = token_codec.decode_block(token_codec.encode_block(ids, lengths))
    assert (a == ids).all() and (b == lengths).all()
    with pytest.raises(ValueError):
        token_codec.decode_block(b"nope" + bytes(60))


def test_greedy_words_are_as_full_as_can_be():
    v = np.array([5] * 40 + [60000] * 3, np.uint64)
    words = token_codec.pack(v)
    assert [token_codec.LAYOUT[int(w >> np.uint64(60))] for w in words][:2] == [(20, 3), (20, 3)] and len(words) == 3


def test_token_files(odd_docs, no_docs, spark, tmp_path):
    path = tokens.public_path("byte_bpe_50k.json")
    token_codec.write_tokens(odd_docs, str(tmp_path / "t"), shards=3)
    got = token_codec.read_tokens(spark, str(tmp_path / "t"), with_ids=True).collect()
    tk = tokens.encoder(path, False).tokenizer
    want = sorted(((d is not None, d or 0, t), tk.encode(t, add_special_tokens=False).ids + [0]) for d, t in texts_of(odd_docs))
    start = 0
    for ((known, d, _), ids), r in zip(want, sorted(got, key=lambda r: r["start"])):
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (d if known else None, start, len(ids)) and r["ids"] == ids
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert len(got) == 10 and token_codec.write_and_read(no_docs).count() == 0


def test_one_id_on_all_rows_fills_many_shards(spark):
    rows = [(5, "all alike")] * 3000 + [(5, f"text {i}") for i in range(1000)] + [(-(1 << 63), "lowest id"), (None, "no id")] + [(None, "")] * 40
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = sorted(token_codec.write_and_read(df, shards=8).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in got] == np.r_[0, np.cumsum([r["n_tokens"] for r in got])[:-1]].tolist()
    assert [r["doc_id"] for r in got] == [None] * 41 + [-(1 << 63)] + [5] * 4000
    path = tokens.public_path("byte_bpe_50k.json")
    crc = lambda t: zlib.crc32(np.array(tokens.encoder(path, False).tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes())
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in got) == sorted((str(d), crc(t)) for d, t in rows)
    order = [F.col("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    sizes = [r["count"] for r in df.repartitionByRange(8, *order).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000


def test_long_runs_of_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word and more " * (i % 50)) for i in range(300)], "doc_id bigint, text string")
    got = sorted(token_codec.write_and_read(docs, shards=5).collect(), key=lambda r: r["doc_id"])
    starts = [r["start"] for r in got]
    assert starts == np.r_[0, np.cumsum([r["n_tokens"] for r in got])[:-1]].tolist()


# --- packing ---


def check_pieces(got, docs, length):
    enc = tokens.encoder(tokens.public_path("word_bpe_49k.json"), True).tokenizer
    ids = sorted((str(d), enc.encode(t, add_special_tokens=False).ids + [2]) for d, t in docs)
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    fills = []
    for _, parts in sorted(seqs.items()):
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        fills.append(at)
    assert sorted(seqs) == list(range(len(seqs))) and all(f == length for f in fills[:-1])
    total = sum(len(i) for _, i in ids)
    assert sum(r["length"] for r in got) == total
    by_doc = {}
    for r in got:
        by_doc.setdefault(str(r["doc_id"]), []).append(r)
    for name, pieces in by_doc.items():
        mine = [i for n, i in ids if n == name]
        assert sum(len(i) for i in mine) == sum(p["length"] for p in pieces)
        for p in pieces:
            assert any(len(i) == p["doc_tokens"] and zlib.crc32(np.array(i[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"] for i in mine)


def test_packing_edges(odd_docs, no_docs):
    check_pieces(packing.pack(odd_docs, length=64, window=2).collect(), texts_of(odd_docs), 64)
    assert packing.pack(no_docs).count() == 0


def test_windows_follow_the_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack(docs, length=1024, window=8).join(docs.select("doc_id", "source", F.length("text").alias("chars")), "doc_id").collect()
    check_pieces(got, texts_of(docs), 1024)
    total, share = 0, {}
    for r in got:
        share[r["source"]] = share.get(r["source"], 0) + r["length"]
        total += r["length"]
    longest = max(r["doc_tokens"] for r in got)
    sent = dict.fromkeys(share, 0)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        sent[r["source"]] += r["length"]
        done = r["sequence_id"] * 1024 + r["offset"] + r["length"]
        # every source is within a window's quantum and a document of its target at any time; all deficits together shift the clock
        assert abs(sent[r["source"]] - share[r["source"]] / total * done) <= longest + 8 * 1024


def test_weights_and_reruns(spark):
    docs = spark.createDataFrame([(i, "one two three four five " * 20, "a" if i % 2 else "b") for i in range(200)], "doc_id bigint, text string, source string")
    got = sorted(map(tuple, packing.pack(docs, length=256, window=4, weights={"a": 3, "b": 1}).collect()))
    assert got == sorted(map(tuple, packing.pack(docs, length=256, window=4, weights={"a": 3, "b": 1}).collect()))
    first = [r for r in got if r[5] < 20]
    odd = sum(r[2] for r in first if r[0] % 2)
    assert odd / sum(r[2] for r in first) == pytest.approx(0.75, abs=0.06)


def test_groups_of_windows_change_no_result(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "one two three four five " * (i % 30 + 1), f"s{i % 3}") for i in range(300)], "doc_id bigint, text string, source string")
    want = sorted(map(tuple, packing.pack(docs, length=64, window=2).collect()))
    monkeypatch.setattr(packing, "BLOCK", 3)
    for group, parts in ((1, 2), (3, 1), (64, 40)):
        monkeypatch.setattr(packing, "GROUP", group)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            assert sorted(map(tuple, packing.pack(docs, length=64, window=2).collect())) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
    check_pieces(packing.pack(docs, length=64, window=2, weights={"s0": 5, "s1": 1}).collect(), texts_of(docs), 64)
    with pytest.raises(ValueError, match="above 0"):
        packing.pack(docs, weights={"s0": 0})


# --- near-duplicates ---


def groups(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def py_fp(text):
    import xxhash

    w = text.translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_are_spark_s_hash_and_plain_python(spark):
    texts = ["", "One", "one TWO", "a b c", "A  b\tC d é", "x " * 500, "ÄÖ ß k\x0bz q"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in simhash.fingerprints(df).collect()}
    assert got == {i: py_fp(t) for i, t in enumerate(texts)}
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (2**64 - 1) == int(simhash.shingle_hashes("A b c", 3)[0])


@pytest.mark.parametrize("cap", [64, 3])
def test_links_and_components_against_all_pairs(spark, cap):
    rng = random.Random(3)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randint(0, 8)):
            y = x
            for _ in range(rng.randint(1, 4)):
                y ^= 1 << rng.randrange(64)
            fps.add(y)
            x = rng.choice([x, y])
    fps |= {0, 1, 3, 7, 15, 2**64 - 1}
    signed = sorted(simhash._signed(x) for x in fps)
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 2
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    edges = simhash.links(df, cap=cap)
    rows = [tuple(r) for r in edges.collect()]
    if cap == 64:
        assert sorted(rows) == sorted((a, b) for a in signed for b in signed if a < b and near(a, b))
    got = {r["node"]: r["comp"] for r in simhash.components(edges).collect()}
    want = groups(signed, near)
    got = {x: got.get(x, x) for x in signed}
    same = {}
    for x in signed:
        same.setdefault(got[x], set()).add(x)
    assert sorted(map(sorted, same.values())) == sorted(sorted(k for k in signed if want[k] == r) for r in set(want.values()))


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(500)] + [(1000, 1001)], "a bigint, b bigint")
    got = {r["node"]: r["comp"] for r in simhash.components(edges).collect()}
    assert len({got[i] for i in range(501)}) == 1 and got[1000] == got[1001] != got[0] and len(got) == 503
    assert simhash.components(edges.limit(0)).count() == 0


def test_near_groups_against_brute_force(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = dict(texts_of(docs))
    fps = {d: py_fp(t) for d, t in rows.items()}
    want = groups(sorted(rows), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 2)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_groups(docs).collect()}
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in rows}
    odd = simhash.near_groups(odd_docs).collect()
    assert len(odd) == 10 and {r["component_id"] for r in odd if r["doc_id"] in (2, 3, 5)} == {2} and {r["component_id"] for r in odd if r["doc_id"] in (-7, 7)} == {-7}
    assert simhash.near_groups(no_docs).count() == 0


def five(text):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("cap", [64, 4])
def test_alike_against_brute_force(spark, cap):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(80)]
        for _ in range(rng.choice([1, 2, 9, 20])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                t[rng.randrange(80)] = rng.choice(words)
            rows.append((n, " ".join(t)))
            n += 1
    sets = {d: five(t) for d, t in rows}
    want = groups([d for d, _ in rows], lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = {r["doc_id"]: r["keep_id"] for r in simhash.alike(spark.createDataFrame(rows, "doc_id bigint, text string"), cap=cap).collect()}
    assert got == want


@pytest.mark.parametrize("block", [1024, 16])
def test_alike_finds_the_original_in_crowded_buckets(spark, monkeypatch, block):
    """Copies are like the original, not like each other: every link of a crowded bucket goes through one text."""
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    rng = random.Random(8)
    rows, n = [], 0
    for copies in (90, 200):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for i in range(copies):
            t = list(base)
            for p in rng.sample(range(5, 295), 5) if i != 37 else ():
                t[p] = f"x{rng.randrange(10**6)}"
            rows.append((n, " ".join(t)))
            n += 1
    sets = {d: five(t) for d, t in rows}
    want = groups([d for d, _ in rows], lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = {r["doc_id"]: r["keep_id"] for r in simhash.alike(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want


def test_alike_ignores_how_often_a_passage_repeats(spark):
    rng = random.Random(9)
    rows = []
    for k in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(150)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base, *[f"w{rng.randrange(5000)}" for _ in range(12)] * 40]))]
    sets = {d: five(t) for d, t in rows}
    want = groups([d for d, _ in rows], lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = {r["doc_id"]: r["keep_id"] for r in simhash.alike(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want and set(got.values()) == {2 * k for k in range(40)}


def test_without_near_duplicates_edges(odd_docs, no_docs):
    got = simhash.without_near_duplicates(odd_docs)
    assert got.columns == odd_docs.columns and sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got.collect()) == [(False, 0), (True, -7), (True, 1), (True, 2), (True, 4), (True, 6)]
    assert simhash.without_near_duplicates(no_docs).count() == 0


# --- fingerprints of documents ---


def py_signatures(text):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    stop = set(spotsigs.ANCHORS)
    content = [(x, w[i - 1] if i and w[i - 1] in stop else None) for i, x in enumerate(w) if x not in stop]
    return {(content[i][1], *(c[0] for c in content[i : i + 3])) for i in range(len(content) - 2) if content[i][1]}


def test_signatures_against_python(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", "of", "und", "cat", "dog", "Tree.", "blue", "x1"]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["s"] for r in spotsigs.with_signatures(df, "text", "s").collect()}
    for i, t in enumerate(texts):
        want = {" ".join(s) for s in py_signatures(t)} or {" ".join(x for x in re.split(r"[\W_]+", t.lower()) if x)} - {""}
        assert got[i] == sorted(int(hashlib.md5(s.encode()).hexdigest()[:8], 16) for s in want)


def test_edited_texts_against_python(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    rows = sorted(texts_of(docs))
    got = {r["doc_id"]: r for r in spotsigs.fingerprint_pairs(docs).collect()}
    for k, (d, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = py_signatures(t), py_signatures(edited), py_signatures(other)
        if a and b and c:
            assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b), abs=1e-3) and r["near_next"] == pytest.approx(len(a & c) / len(a | c), abs=1e-3)
    odd = spotsigs.fingerprint_pairs(odd_docs).collect()
    assert len(odd) == 10 and spotsigs.fingerprint_pairs(no_docs).count() == 0
    by_id = {r["doc_id"]: r for r in odd}
    assert (by_id[2]["fingerprint"], by_id[3]["fingerprint"], by_id[3]["n_chars"]) == ("", "", 0)
    assert by_id[-7]["fingerprint"] == by_id[7]["fingerprint"] != "" and by_id[2]["near_next"] == 1.0 and by_id[6]["near_next"] == 0.0
    last, first = "the quick brown fox jumps over the lazy dog", "der die das und ein Haus mit Garten"
    assert by_id[7]["edited_sha256"] == hashlib.sha256((last[:22] + first[:21]).encode()).hexdigest()


def test_next_document_over_many_ranges(spark):
    ids = random.Random(7).sample(range(-(10**12), 10**12), 700)
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id bigint, text string")
    got = {r["doc_id"]: r["next_text"] for r in spotsigs.with_next(df, rows_per_range=5).where("not ghost").collect()}
    ids.sort()
    assert got == {d: f"text {ids[(k + 1) % 700]}" for k, d in enumerate(ids)}
    one = spotsigs.fingerprint_pairs(df.limit(1)).first()
    assert one["near_edited"] == pytest.approx(one["near_edited"]) and one["near_next"] == 1.0


@pytest.mark.parametrize("hot", [5, None])
def test_next_document_where_one_id_has_most_rows(spark, hot):
    rows = [(i, f"text {i}") for i in range(60)] + [(hot, f"more {i % 300}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = spotsigs.with_next(df, rows_per_range=10)
    sizes = [r["count"] for r in got.groupBy("range", "sub").count().collect()]
    assert max(sizes) < 60 and len(sizes) > 20
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want = [(str(d), t, order[(k + 1) % len(order)][1]) for k, (d, t) in enumerate(order)]
    assert sorted((str(r["doc_id"]), r["text"], r["next_text"]) for r in got.where("not ghost").collect()) == sorted(want)


def test_links_against_all_pairs(spark, odd_docs, no_docs, monkeypatch):
    rng = random.Random(8)
    words = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(40):
        t = [rng.choice(words) for _ in range(60)]
        for j in range(rng.choice([1, 3, 6])):
            u = list(t)
            for _ in range(j):
                u[rng.randrange(60)] = rng.choice(words)
            rows.append((len(rows), " the ".join(u)))
    rows += [(1000 + i, rows[i][1]) for i in range(20)] + [(2000, ""), (2001, None), (None, "lonely the cat ran far")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = {r["doc_id"]: frozenset(r["s"]) for r in spotsigs.with_signatures(df, "text", "s").collect()}
    first = {}
    for d in sorted(sets, key=lambda d: (d is None, d)):
        first.setdefault(sets[d], d)
    alike = lambda x, y: x != y and x | y and len(x & y) / len(x | y) >= 0.8
    want = sorted(str((d, first[s], sum(bool(alike(s, o)) for o in first))) for d, s in sets.items())
    for frequent in (20_000, 3):
        monkeypatch.setattr(spotsigs, "FREQUENT", frequent)
        assert sorted(str(tuple(r)) for r in spotsigs.links(df).collect()) == want
    assert sum(not w.endswith(" 0)") for w in want) > 20
    assert spotsigs.links(odd_docs).count() == 10 and spotsigs.links(no_docs).count() == 0


# --- mixing ---


def py_targets(sizes):
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    free, left, out = set(names), float(sum(sizes.values())), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in free}
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= full
    return out


def test_targets_against_refilling(spark):
    rng = random.Random(9)
    for n in (1, 2, 7, 25):
        sizes = {f"s{i}": rng.choice([0, 1, 10, 500, 10000]) for i in range(n)} | {None: 40}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r["source"]: r["target"] for r in systematic_mix.targets(df).collect()}
        assert got == pytest.approx(py_targets(sizes))


def test_mix_near_targets(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = systematic_mix.mix(docs).collect()
    again = systematic_mix.mix(docs.repartition(13)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and max(r["copies"] for r in got) <= 3
    by = {}
    for r in got:
        b = by.setdefault(r["source"], [r["target"], 0, 0])
        b[1] += r["size"] * r["copies"]
        b[2] = max(b[2], r["size"])
    for target, taken, largest in by.values():
        assert abs(taken - target) <= largest
    odd = {(r["doc_id"], r["source"], r["size"]): r for r in systematic_mix.mix(odd_docs).collect()}
    assert systematic_mix.mix(odd_docs).count() == 10 and systematic_mix.mix(no_docs).count() == 0
    assert (3, None, 0) in odd and (5, "c", 0) in odd and (None, "a", 8) in odd and odd[(3, None, 0)]["source_size"] == 39000
    assert odd[(7, "b", 9)]["source_size"] == 18 and odd[(1, "a", 5)]["source_size"] == 18


def test_slices_and_runs_change_no_result(spark, monkeypatch):
    """A hot size, a hot id and rows alike in everything; py_mix ranks them in one list."""
    rows = [(i, f"one two three {i % 7}", "a") for i in range(300)] + [(None, "one two three", "a")] * 150 + [(5, "x " * (i % 4), "b") for i in range(90)] + [(5, "same", None)] * 40
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    plain = sorted(map(str, systematic_mix.mix(df).collect()))
    monkeypatch.setattr(systematic_mix, "ROWS_PER_SLICE", 10)
    monkeypatch.setattr(systematic_mix, "RUN", 7)
    assert sorted(map(str, systematic_mix.mix(df).collect())) == plain and len(plain) == len(rows)
    sums = {s: sum(len(t.split()) for _, t, o in rows if o == s) for s in ("a", "b", None)}
    aims, want = py_targets(sums), []
    for s in sums:
        mine = sorted((len(t.split()), hashlib.md5(f"{'null' if d is None else d}:{t}".encode()).hexdigest(), d) for d, t, o in rows if o == s)
        u = int(hashlib.md5(f"0:mix:{'n' if s is None else 's' + s}".encode()).hexdigest()[:8], 16) / 2**32
        rate = aims[s] / sums[s]
        want += [(d, s, n, math.floor((k + 1) * rate + u) - math.floor(k * rate + u)) for k, (n, _, d) in enumerate(mine)]
    got = [(r["doc_id"], r["source"], r["size"], r["copies"]) for r in systematic_mix.mix(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    whole = sorted(map(str, (tuple(r) for r in systematic_mix.mixed_rows(df.withColumn("_mix", F.lit(1))).select("doc_id", "source", F.size(F.filter(F.split("text", " "), lambda w: w != "")).alias("n")).collect())))
    assert whole == sorted(str(r[:3]) for r in want for _ in range(r[3]))


def test_mixed_rows_edges(odd_docs, no_docs):
    got = systematic_mix.mixed_rows(odd_docs)
    assert got.columns == odd_docs.columns and systematic_mix.mixed_rows(no_docs).count() == 0
    assert got.count() == systematic_mix.mix(odd_docs).agg(F.sum("copies")).first()[0]


# --- pipeline ---


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.columns == docs.columns
        after.write.parquet(str(tmp_path / name))
        before, kept = kept, spark.read.parquet(str(tmp_path / name))
        assert kept.schema["text"].dataType == docs.schema["text"].dataType
        if name == "toxicity":
            lost = before.join(kept, "doc_id", "left_anti").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
            assert lost.where("toxic = 0").count() <= 0.05 * before.count()
        if name == "near-duplicates":
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            sets = {d: five(t) for d, t in texts.items()}
            want = groups(sorted(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
            assert {r["doc_id"] for r in kept.collect()} == set(want.values())
        if name == "secrets":
            assert kept.count() == before.count() and kept.where(F.col("text").rlike("[0-9a-f]{24}")).count() == 0
            assert kept.where(F.length("text") != F.col("n_chars")).count() == 0
        if name == "mix":
            taken = {r["doc_id"]: r["copies"] for r in systematic_mix.mix(before).collect()}
            assert {r["doc_id"]: r["count"] for r in kept.groupBy("doc_id").count().collect()} == {d: n for d, n in taken.items() if n}
    packed = cp.pack_sequences(spark, kept, SF).collect()
    check_pieces(packed, texts_of(kept), 4096)
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near-duplicates", "secrets", "mix", "packing"] and cp.ORACLE_SQL is None
    piece = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
    whole = cp.run(spark, SF).collect()  # cuts follow the order of input files, so only what whole documents hold is compared
    assert len({r["sequence_id"] for r in whole}) == len({r["sequence_id"] for r in packed})
    of_docs = lambda rows: sorted((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0)
    assert of_docs(whole) == of_docs(packed) and sum(r["length"] for r in whole) == sum(r["length"] for r in packed) and all(piece(r)[2] > 0 for r in whole)


def test_pipeline_on_odd_and_empty_tables(spark, odd_docs, no_docs, labels, tmp_path):
    import corpus_pipeline as cp

    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        stored = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for _, stage in cp.STAGES[:-1]:
            assert stage(spark, stored, str(tmp_path / name)).columns == docs.columns
    assert cp.drop_toxic(spark, no_docs, str(tmp_path / "none")).count() == 0 and cp.redact_secrets(spark, no_docs, "").count() == 0 and cp.mix_sources(spark, no_docs, "").count() == 0
    assert cp.run(spark, str(tmp_path / "none")).count() == 0
    got = cp.run(spark, str(tmp_path / "odd")).collect()
    assert {r["doc_id"] for r in got} <= {None, -7, 1, 2, 3, 4, 5, 6, 7} and all(r["length"] > 0 for r in got)


def test_pipeline_stages_keep_the_caller_s_columns(spark, odd_docs, labels, tmp_path):
    """Columns with the names that stages use inside come back as they were, on rows that repeat and rows that do not."""
    import corpus_pipeline as cp

    names = ["_kept_doc_id", "_k", "_place", "_mix_queue", "_mix_o", "_mix_row", "row", "key", "found", "crowded", "salt", "group", "copies", "o", "m", "n", "_costs", "doc", "fp", "cls", "node", "keep_id", "rate", "before"]
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd_docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in names})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.dtypes == docs.dtypes, name
        rows = got.collect()
        assert rows and all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in rows for c in names), name
    assert cp.pack_sequences(spark, docs, str(tmp_path)).count() > 0


def test_rows_that_differ_elsewhere_are_mixed_each_for_itself(spark):
    rows = [(1, "a b c", "s", i) for i in range(40)] + [(2, "x y", "t", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, extra int")
    got = systematic_mix.mixed_rows(df)
    taken = {(r["doc_id"], r["extra"]): r["count"] for r in got.groupBy("doc_id", "extra").count().collect()}
    whole = systematic_mix.mix(df.drop("extra")).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in whole if r["n"]} == {d: sum(n for (e, _), n in taken.items() if e == d) for d in {d for d, _ in taken}}
    assert all(n <= 3 for n in taken.values()) and len(taken) > 20
