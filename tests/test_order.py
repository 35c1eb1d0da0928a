"""Places, batches, shards and grids do not depend on files' splits or on partitions; private names clash with nothing."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docprobe.operators import batches, chat, evaluate, forge, pixels, predict, raster, split
from docprobe.operators.names import refuse, spare
from docprobe.sources import ordinals, readers

BOXES = "array<struct<pos:int,text:string,box_pixel:array<int>,label:string,is_numeric:boolean>>"


def in_files(df, path, files, order="id", kind="parquet"):
    df.repartitionByRange(files, order).sortWithinPartitions(order).write.format(kind).save(str(path))


@pytest.fixture()
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_ordinals_under_any_split(spark, tmp_path, small_splits):
    df = spark.range(5000).select("id", F.md5(F.col("id").cast("string")).alias("text"))
    in_files(df, tmp_path / "t", 7)
    for size in ("700", "5k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = ordinals.with_ordinals(spark, str(tmp_path / "t"))
        assert got.columns == ["id", "text", "ordinal"] and got.count() == 5000
        assert got.where("id <> ordinal").count() == 0
    with pytest.raises(ValueError, match="ordinal"):
        df.withColumn("ordinal", F.lit(1)).write.parquet(str(tmp_path / "u"))
        ordinals.with_ordinals(spark, str(tmp_path / "u"))
    spark.range(0).write.parquet(str(tmp_path / "none"))
    assert ordinals.with_ordinals(spark, str(tmp_path / "none")).count() == 0


def test_starts_in_two_levels(spark):
    rng = np.random.default_rng(0)
    sizes = [(f"f{i:05d}", int(rng.integers(0, 9))) for i in rng.permutation(4000)]
    got = ordinals.starts(spark.createDataFrame(sizes, "file string, n long"), ["file"])
    at, before = {}, 0
    for f, n in sorted(sizes):
        at[f] = before
        before += n
    assert {r.file: r.start for r in got.collect()} == at
    assert got.select("start").rdd.getNumPartitions() >= 1
    assert ordinals.starts(spark.createDataFrame([], "file string, n long"), ["file"]).count() == 0


def test_a_limit_opens_the_files_that_hold_it(spark, tmp_path):
    in_files(spark.range(900), tmp_path / "t", 9)
    path = str(tmp_path / "t")
    sizes = [ordinals.rows_in(spark, f) for f in ordinals.parquet_files(spark, path)]
    assert len(sizes) == 9 and sum(sizes) == 900
    for limit in (1, 40, sizes[0], sizes[0] + 1, 400, 900, 5000):
        need = next((i + 1 for i in range(9) if sum(sizes[: i + 1]) >= limit), 9)
        got = ordinals.first_rows(spark, path, limit)
        assert sum("/t/" in f for f in got.inputFiles()) == need
        assert sorted(r.id for r in got.collect()) == list(range(min(limit, 900)))
    assert ordinals.first_rows(spark, path, 0).count() == 0


def test_sources_without_a_number(spark, tmp_path):
    receipts = "id int, image struct<width:int,height:int>, ocr array<struct<box:array<array<double>>,label:string,text:string>>"
    df = spark.createDataFrame([(i, (100, 100), [([[1.0, 1.0], [9.0, 9.0 + i]], "l", f"t{i}")]) for i in range(50)], receipts)
    df.repartitionByRange(4, "id").sortWithinPartitions("id").drop("id").write.parquet(str(tmp_path / "r"))
    got = readers.read_sources(spark, {"sroie": str(tmp_path / "r")}, ["sroie"], limit_per_source=3)
    assert sorted((r.doc_id, r.ocr_boxes[0].text) for r in got.collect()) == [(f"sroie-train-{i}", f"t{i}") for i in range(3)]
    whole = readers.read_receipts(spark, str(tmp_path / "r"))
    assert {(r.doc_id, r.ocr_boxes[0].text) for r in whole.collect()} == {(f"sroie-train-{i}", f"t{i}") for i in range(50)}


def test_line_positions(spark, tmp_path, small_splits):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(3000)]
    for part in range(3):
        text = "".join(f"{x}\n" + "\n  \n" * (i % 7 == 0) for i, x in enumerate(lines[part * 1000 : (part + 1) * 1000]))
        (tmp_path / f"part-{part}.txt").write_text(text)
    for size in ("700", "64k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = ordinals.with_positions(spark, str(tmp_path))
        assert [r.value for r in got.orderBy("position").collect()] == lines
        assert got.agg(F.min("position"), F.max("position"), F.count_distinct("position")).first() == (0, 2999, 3000)


def test_dumps_pair_by_line(spark, tmp_path):
    a = spark.range(1000).select("id", (F.col("id") % 3 == 0).alias("correct_det"))
    b = spark.range(1000).select("id", (F.col("id") % 5 == 0).alias("correct_det"))
    in_files(a.select("id", "correct_det"), tmp_path / "a", 3, kind="json")
    in_files(b.select("id", "correct_det"), tmp_path / "b", 5, kind="json")
    in_files(b.where("id < 999"), tmp_path / "short", 2, kind="json")
    got = evaluate.paired_dumps(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert sorted(map(tuple, got.collect())) == [(i, i % 3 == 0, i % 5 == 0) for i in range(1000)]
    with pytest.raises(ValueError, match="mismatched lengths: 1000 and 999"):
        evaluate.paired_dumps(spark, str(tmp_path / "a"), str(tmp_path / "short"))
    with pytest.raises(Exception, match="no other in line"):
        evaluate.paired_dumps(spark, str(tmp_path / "a"), str(tmp_path / "b"), "other").collect()


def test_numbered_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"doc_id": "x", "width": 3}\n\n{"doc_id": "y"}\n')
    (tmp_path / "b.jsonl").write_text('\n{"doc_id": "z", "extra": 1}')
    got = readers.read_numbered_records(spark, str(tmp_path)).select("position", "doc_id", "width").orderBy("position").collect()
    assert [tuple(r) for r in got] == [(0, "x", 3), (1, "y", None), (2, "z", None)]
    (tmp_path / "c.jsonl").write_text("{not json")
    with pytest.raises(Exception):
        readers.read_numbered_records(spark, str(tmp_path)).collect()


# --- batches ---


def some_rows(spark, n=1000):
    return spark.range(n).select("id", (F.pmod(F.xxhash64("id"), F.lit(500))).alias("length"), F.lit("kept").alias("_o"), F.lit(1).alias("_rank"), F.lit(2).alias("_chunk"), F.lit(3).alias("_s"))


def test_batches_do_not_depend_on_partitions(spark):
    df = some_rows(spark)
    one, many = (sorted(map(tuple, batches.batched(df.repartition(p), "id", "length", size=8, pool=10).collect())) for p in (1, 40))
    assert one == many
    sizes = pd.Series([r[-2] for r in one]).value_counts()
    assert len(sizes) == 125 and (sizes == 8).all()
    other = sorted(map(tuple, batches.batched(df, "id", "length", size=8, pool=10, epoch=1).collect()))
    assert [r[-2] for r in other] != [r[-2] for r in one] and [r[:-2] for r in other] == [r[:-2] for r in one]
    near = batches.padding(batches.batched(df, "id", "length", pool=10), "batch", "length").first()
    far = batches.padding(df.withColumn("batch", F.floor(F.col("id") / 8)), "batch", "length").first()
    assert near.tokens == far.tokens and near.padded < 0.25 * far.padded
    assert batches.batched(df.limit(0), "id", "length").count() == 0
    odd = spark.createDataFrame([(1, None), (2, 5), (3, None)], "id long, length long")
    assert batches.batched(odd, "id", "length", size=2).count() == 3
    with pytest.raises(ValueError, match="batch"):
        batches.batched(df.withColumn("Batch", F.lit(1)), "id", "length")


SPECIAL = chat.Special(start=1, end=2, pad=0, image=9, header=1)


def test_collated_batches_are_alike_under_any_partitions(spark):
    part = lambda text: F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("image"))
    build = F.array(F.struct(F.lit("assistant").alias("role"), F.array(part(F.repeat(F.lit("x"), F.col("length").cast("int")))).alias("content")))
    tokenizer = lambda: lambda group: [[1, 3, *([7] * len(ms[0]["content"][0]["text"])), 2] for ms in group]
    df = some_rows(spark, 90).withColumn("length", F.col("length") % 40)
    dealt = batches.batched(df, "id", "length", size=8, pool=3)
    got = [sorted((r.id, r.batch, r.input_ids, r.attention_mask, r.labels, r.learnable) for r in batches.collate_batches(dealt.repartition(p), tokenizer, SPECIAL, build=build, max_length=30).collect()) for p in (1, 40)]
    assert got[0] == got[1]
    real = {r.id: min(30, r.length + 3) for r in df.collect()}
    for i, batch, ids, mask, labels, _ in got[0]:
        longest = max(real[j] for j, b, *_ in got[0] if b == batch)
        assert len(ids) == len(mask) == len(labels) == longest and sum(mask) == real[i] and not any(ids[real[i] :])


# --- inference that resumes ---


def dying(folder, fatal):
    """A predictor that notes each record it is asked for, and dies at one."""

    def make():
        def predict_rows(rows):
            for i in rows["doc_id"]:
                if fatal and i == fatal:
                    raise OSError("the model is lost")
                with open(f"{folder}/{i}", "a") as f:
                    f.write("x")
            return rows["doc_id"].map(lambda i: f"said {i}")

        return predict_rows

    return make


def test_inference_goes_on_where_it_stopped(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    df = spark.createDataFrame([(f"d{i}", i) for i in range(200)], "doc_id string, v int").repartition(6)
    shard = {r.doc_id: r.s for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int").alias("s")).collect()}
    fatal = next(i for i, s in shard.items() if s == 9)
    path = f"{tmp_path}/out"
    with pytest.raises(Exception, match="the model is lost"):
        predict.generate_resumable(df, dying(tmp_path / "calls", fatal), path, "doc_id", shards=16, at_once=1)
    assert sorted(r.shard for r in predict.ledger(df, path).collect()) == list(range(9))
    before = {p.name for p in (tmp_path / "calls").iterdir()}
    assert {i for i, s in shard.items() if s < 9} <= before
    # a job whose rows were committed, but which died before its entry in the ledger
    df.where("doc_id = 'd0'").select("doc_id", "v", F.lit("ghost").alias("completion"), F.lit(shard["d0"]).alias("shard"), F.lit("lost").alias("run")).write.mode("append").partitionBy("run").parquet(f"{path}/rows")
    got = predict.generate_resumable(df.repartition(3), dying(tmp_path / "calls", None), path, "doc_id", shards=16, at_once=1)
    assert got.columns == ["doc_id", "v", "completion"]
    assert sorted(map(tuple, got.collect())) == sorted((f"d{i}", i, f"said d{i}") for i in range(200))
    calls = {p.name: len(p.read_text()) for p in (tmp_path / "calls").iterdir()}
    assert set(calls) == set(shard) and all(calls[i] == 1 for i, s in shard.items() if s != 9)
    again = predict.generate_resumable(df, dying(tmp_path / "calls", "d1"), path, "doc_id", shards=16)  # nothing is open: nothing is asked
    assert again.count() == 200 and sum(calls.values()) == sum(len(p.read_text()) for p in (tmp_path / "calls").iterdir())
    none = predict.generate_resumable(df.limit(0), dying(tmp_path / "calls", None), f"{tmp_path}/none", "doc_id", shards=2)
    assert none.count() == 0


# --- places on crowded pages ---


def crowded_pages(spark, pages, boxes, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for p in range(pages):
        n = boxes if p % 4 else boxes // 50
        x, y = rng.integers(0, 1400, n), rng.integers(0, 1400, n)
        w, h = rng.integers(6, 30, n), rng.integers(6, 14, n)
        if p % 5 == 0:
            w[0], h[0], x[0], y[0] = 900, 1200, 3, 5  # fills many cells
        boxes_ = [(i, "t", [int(a), int(b), int(a + c), int(b + d)], "total", False) for i, (a, b, c, d) in enumerate(zip(x, y, w, h))]
        rows.append((f"p{p}", "s", 1450, 1450, boxes_))
    rows.append(("tiny", "s", 8, 8, [(0, "t", [0, 0, 8, 8], "total", False)]))
    rows.append(("empty", "s", 80, 80, []))
    return spark.createDataFrame(rows, f"doc_id string, source string, width int, height int, ocr_boxes {BOXES}")


def test_grid_finds_the_places_of_the_scan(spark):
    pages = crowded_pages(spark, 14, 10_000).cache()
    plans = [{r.doc_id: r.copy_move for r in forge.plan_copy_move(pages, seed=5, crowded=c).collect()} for c in (None, 0, 1000)]
    assert plans[0] == plans[1] == plans[2]
    assert sum(p is not None for p in plans[0].values()) >= 3 and sum(p is None for p in plans[0].values()) >= 3


# --- pixels by columns against pixels by arrays ---


def page_array(boxes, w, h, shade):
    y, x = np.mgrid[0:h, 0:w]
    out = 224 + (3 * x + 5 * y + shade) % 32
    for b in sorted(boxes):
        x1, y1, x2, y2 = b[2]
        part = np.s_[max(y1, 0) : y2, max(x1, 0) : x2]
        out[part] = ((7 * x + 11 * y + 13 * b[0] + shade) % 200)[part]
    return out.astype(np.uint8)


def test_resampling_and_turns_as_columns(spark):
    rng = np.random.default_rng(6)
    cases = [(rng.integers(0, 256, (int(h), int(w))), int(tw), int(th), float(a)) for w, h, tw, th, a in zip(rng.integers(1, 30, 40), rng.integers(1, 25, 40), rng.integers(1, 40, 40), rng.integers(1, 30, 40), rng.uniform(-10, 10, 40))]
    df = spark.createDataFrame([(i, v.tolist(), v.shape[1], v.shape[0], tw, th, a) for i, (v, tw, th, a) in enumerate(cases)], "i int, p array<array<bigint>>, w bigint, h bigint, tw bigint, th bigint, a double")
    unit = lambda f: F.rint(f(F.radians("a")) * float(1 << raster.TURN_BITS)).cast("bigint")
    df = df.withColumn("x", raster.taps(F.col("w"), F.col("tw"))).withColumn("y", raster.taps(F.col("h"), F.col("th")))
    got = df.select("i", raster.resized(F.col("p"), F.col("x"), F.col("y")).alias("r"), raster.turned(F.col("p"), F.col("w"), F.col("h"), unit(F.sin), unit(F.cos)).alias("t")).collect()
    for r in got:
        v, tw, th, a = cases[r.i]
        grey = np.repeat(v[:, :, None], 3, 2).astype(np.uint8)
        small = pixels.resized(grey, tw, th)[:, :, 0].astype(int)
        assert np.shape(r.r) == small.shape and np.abs(np.array(r.r) - small).max() <= 2 and (np.abs(np.array(r.r) - small) > 1).mean() < 0.02
        turned = pixels.rotated(grey, a)[:, :, 0].astype(int)
        assert np.shape(r.t) == turned.shape and (np.abs(np.array(r.t) - turned) > 1).mean() < 0.02  # at a border a rounding decides between black and not


def test_forged_pixels_are_those_of_the_arrays(spark):
    rng = np.random.default_rng(8)
    rows = []
    for p in range(30):
        boxes = [(i, f"{i}0", [int(a), int(b), int(a + c), int(b + d)], "total", True) for i, (a, b, c, d) in enumerate(zip(rng.integers(-5, 150, 6), rng.integers(-5, 110, 6), rng.integers(12, 60, 6), rng.integers(8, 25, 6)))]
        rows.append((p, "s", 180, 140, boxes))
    pages = spark.createDataFrame(rows, f"doc_id bigint, source string, width int, height int, ocr_boxes {BOXES}").cache()
    shade = {r.doc_id: r.s for r in pages.select("doc_id", raster.tone(F.col("doc_id")).alias("s")).collect()}
    drawn = {p: page_array(b, w, h, shade[p]) for p, _, w, h, b in rows}
    donors = forge.harvest_donors(pages, split=None)
    given = forge.with_donor_counts(pages, donors, split=None)
    pool = {r.donor_idx: (r.doc_id, list(r.box_pixel)) for r in donors.collect()}
    seen = 0
    for op, plan in (("copy_move", forge.plan_copy_move), ("splice", forge.plan_splice), ("digit_swap", forge.plan_digit_swap)):
        plans = plan(given).select(*pages.columns, F.col(op).alias("plan")).where("plan is not null").cache()
        full = raster.with_donor_pages(plans, donors, pages) if op == "splice" else plans
        rows_of = {}
        for r in raster.forged_pixels(full, op).collect():
            rows_of.setdefault(r.doc_id, []).append((r.x, r.y, r.before, r.after))
        for r in plans.collect():
            grey = np.repeat(drawn[r.doc_id][:, :, None], 3, 2)
            kind = r.plan.asDict()
            donor = None
            if op == "splice":
                owner, box = pool[r.plan.donor_idx]
                if min(box) < 0 or box[2] > 180 or box[3] > 140:
                    continue  # the arrays cut such a crop at the page's edge, the columns fill it with black
                donor = np.repeat(drawn[owner][:, :, None], 3, 2)[box[1] : box[3], box[0] : box[2]]
            elif min(kind["source_box"]) < 0 or kind["source_box"][2] > 180 or kind["source_box"][3] > 140:
                continue
            want = pixels.forged(grey, kind, donor)[:, :, 0].astype(int)
            out = drawn[r.doc_id].astype(int)
            for x, y, before, after in rows_of.get(r.doc_id, []):
                assert before == out[y, x]
                out[y, x] = after
            assert (np.abs(out - want) > 1).sum() <= (3 if kind["angle"] is not None else 0), (op, r.doc_id)
            seen += 1
    assert seen > 40


# --- names ---


def test_spare_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, _k int, _K_ int")
    assert spare(df, "_k", "b", "_k") == ["_k__", "b", "_k___"]
    with pytest.raises(ValueError):
        refuse(df, "A")


PRIVATE = ["_s", "_b", "_r", "_o", "_k", "_f", "_n", "_p", "_c", "_t", "_d", "_g", "_w", "_to", "_off", "_i", "_place", "_rank", "_chunk", "rank", "lo", "hi", "k", "n", "patch_w", "place", "cx", "cy", "_op_copy_move", "_messages", "_longest"]


def with_private(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in PRIVATE})


def kept(df):
    return all(tuple(r) == tuple(f"own {c}" for c in PRIVATE) for r in df.select(*PRIVATE).collect())


def test_columns_of_the_caller_s_keep_their_values(spark):
    pages = with_private(crowded_pages(spark, 5, 300).withColumn("is", F.lit(1)))
    pages = pages.withColumn("split", F.lit("train")).withColumn("n_donors", F.lit(3).cast("bigint"))
    for plan in (forge.plan_digit_swap, forge.plan_copy_move, forge.plan_splice, forge.plan_recompress_ghost, lambda p: forge.plan_copy_move(p, crowded=0), lambda p: forge.planned(p)):
        got = plan(pages)
        assert set(pages.columns) < set(got.columns) and kept(got)
    assert forge.harvest_donors(pages).count() > 0
    recs = with_private(spark.createDataFrame([(i, f"p{i}", i % 3 == 0, "abc"[i % 3], i) for i in range(30)], "doc_id int, image_path string, tampered boolean, tamper_type string, at int"))
    splits = split.assign_splits(recs, {"train": 0.7, "val": 0.15, "test": 0.15})
    assert splits.columns == ["doc_id", "split"] and kept(split.group_docs(recs, splits))
    balanced = split.balance(recs, "image_path")
    assert balanced.count() == 40 and balanced.columns == [*recs.columns, "copy"] and kept(balanced)
    for got in (split.keep_first_clean(recs, "at"), split.round_robin(recs, 10, "at"), split.first_per_group(recs, 2, ["at"], "tamper_type"), split.shuffled(recs, "doc_id"), split.first_rows(recs, 3, "at"), batches.batched(recs, "doc_id", "at")):
        assert set(recs.columns) <= set(got.columns) and kept(got) and got.count() > 0
    assert split.leaked_ids(group := split.group_docs(recs, splits)).count() == 0 and split.leaked_ids(group.withColumn("doc_id", F.lit(1))).count() == 1
    with pytest.raises(ValueError, match="copy"):
        split.balance(recs.withColumn("copy", F.lit(1)), "image_path")
