"""Column functions against known answers and plain Python."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from docprobe.functions import codec, geometry, stats
from docprobe.functions.validate import REQUIRED, require_valid, violations

BOX_DDL = "box array<double>, w int, h int"


def one(spark, column, data=None, schema=None):
    df = spark.createDataFrame(data or [(0,)], schema or "x int")
    return [r[0] for r in df.select(column.alias("r")).collect()]


def arr(*v):
    return F.array(*(F.lit(x) for x in v))


def py_norm(box, w, h):
    return [int(round(max(0, min(1000, v / s * 1000)))) for v, s in zip(box, (w, h, w, h))]


def test_pixel_to_norm_known_and_random(spark):
    rng = random.Random(1)
    rows = [([128.0, 64.0, 512.0, 320.0], 1024, 640), ([-7.0, -90.0, 5000.0, 4100.0], 811, 1217)]
    rows += [([float(rng.randint(-10, 2000)) for _ in range(4)], rng.randint(1, 2000), rng.randint(1, 2000)) for _ in range(500)]
    got = one(spark, geometry.pixel_to_norm(F.col("box"), F.col("w"), F.col("h")), rows, BOX_DDL)
    assert got[0] == [125, 100, 500, 500] and got[1] == [0, 0, 1000, 1000]
    assert got == [py_norm(*r) for r in rows]


@pytest.mark.parametrize("w,h", [(0, 10), (10, 0), (-1, 5)])
def test_page_without_extent_is_an_error(spark, w, h):
    for fn in (geometry.pixel_to_norm, geometry.norm_to_pixel):
        with pytest.raises(Exception, match="non-positive dims"):
            one(spark, fn(arr(1.0, 1.0, 2.0, 2.0), F.lit(w), F.lit(h)))


def test_norm_to_pixel_and_round_trip(spark):
    assert one(spark, geometry.norm_to_pixel(arr(125, 333, 876, 1000), F.lit(640), F.lit(900))) == [[80, 300, 561, 900]]
    rows = [([17.0, 221.0, 388.0, 254.0], 517, 907), ([3.0, 5.0, 1411.0, 1987.0], 1500, 2000)]
    back = geometry.norm_to_pixel(geometry.pixel_to_norm(F.col("box"), F.col("w"), F.col("h")), F.col("w"), F.col("h"))
    for (box, w, h), got in zip(rows, one(spark, back, rows, BOX_DDL)):
        assert all(abs(a - b) <= s / 1000 + 1 for a, b, s in zip(box, got, (w, h, w, h)))


@pytest.mark.parametrize(
    "a,b,expected",
    [
        ([3, 7, 19, 23], [3, 7, 19, 23], 1.0),
        ([3, 7, 19, 23], [40, 2, 51, 9], 0.0),
        ([2, 2, 8, 6], [8, 2, 12, 6], 0.0),
        ([0, 0, 12, 8], [4, 0, 16, 8], 1 / 2),
        ([1, 1, 31, 31], [11, 11, 21, 21], 1 / 9),
        ([6, 4, 6, 90], [6, 4, 60, 90], 0.0),
        ([70, 33, 12, 5], [12, 5, 70, 33], 1.0),
    ],
)
def test_iou(spark, a, b, expected):
    assert one(spark, geometry.iou(arr(*a), arr(*b)))[0] == pytest.approx(expected)


def test_quads_clamping_overlap(spark):
    quad = F.array(*(arr(*p) for p in ([31, 70], [95, 64], [99, 83], [27, 88])))
    assert one(spark, geometry.quad_to_bbox(quad)) == [[27, 64, 99, 88]]
    assert one(spark, geometry.clamp_box(arr(-5, -5, 500, 700), F.lit(400), F.lit(600))) == [[0, 0, 400, 600]]
    assert one(spark, geometry.clamp_box(arr(0.5, 1.5, 2.5, 3.5), F.lit(400), F.lit(600))) == [[0, 2, 2, 4]]  # half to even
    assert one(spark, geometry.overlap(arr(0, 0, 10, 10), arr(5, 5, 15, 15))) == [True]
    assert one(spark, geometry.overlap(arr(0, 0, 10, 10), arr(10, 0, 20, 10))) == [False]
    assert one(spark, geometry.has_area(arr(0, 0, 0, 5))) == [False]
    assert one(spark, geometry.clamp(F.lit(7), 0, 5)) == [5]


def test_format_and_parse_box(spark):
    text = "<|box_start|>(31,407),(299,455)<|box_end|>"
    assert one(spark, codec.format_box(arr(31, 407, 299, 455))) == [text]
    with pytest.raises(Exception, match="expected 4 ints"):
        one(spark, codec.format_box(arr(1, 2, 3)))
    good = [text, "at (31,407),(299,455) it is", "<|box_start|>( 31,407 ),(299 ,455)", "(\t31 , 407)\n,\n(299,455)"]
    assert one(spark, codec.parse_box(F.col("s")), [(s,) for s in good], "s string") == [[31, 407, 299, 455]] * 4
    bad = ["", "nowhere", "31,407,299,455", "(31,407)", "(31,x),(299,455)", None, "(31,-407),(299,455)", "(31,407) (299,455)"]
    assert one(spark, codec.parse_box(F.col("s")), [(s,) for s in bad], "s string") == [None] * len(bad)
    other = ["first (8,9),(10,11) then (12,13),(14,15)", "(8,9),(10,77777777777)", "(٨,٩),(10,11)"]
    assert one(spark, codec.parse_box(F.col("s")), [(s,) for s in other], "s string") == [[8, 9, 10, 11], [8, 9, 10, 77777777777], [8, 9, 10, 11]]


def test_clean_reason_is_md5_mod_twelve(spark):
    import hashlib

    keys = [f"img{i}.png" for i in range(200)] + ["", None, "ü"]
    expected = [codec.CLEAN_REASONS[int(hashlib.md5((k or "").encode()).hexdigest(), 16) % 12] for k in keys]
    assert one(spark, codec.clean_reason(F.col("k")), [(k,) for k in keys], "k string") == expected
    assert len(set(expected)) == 12


def test_target_json_is_what_python_writes(spark):
    schema = "t boolean, f string, b array<int>, w int, h int, r string, p string"
    rows = [(True, 'a "q" \\ ü\n', [10, 20, 30, 40], 100, 200, "é 😀", "x"), (True, None, [0, 0, 100, 200], 100, 200, None, "y"), (False, None, None, 10, 10, "unused", "images/z.png")]
    got = one(spark, codec.target_json(*(F.col(c) for c in "tfbwhrp")), rows, schema)
    for row, text in zip(rows, got):
        box = None if not row[0] else "<|box_start|>(%d,%d),(%d,%d)<|box_end|>" % tuple(py_norm(row[2], row[3], row[4]))
        reason = row[5] if row[0] else one(spark, codec.clean_reason(F.lit(row[6])))[0]
        assert text == json.dumps({"tampered": row[0], "field": row[1] if row[0] else None, "box": box, "reason": reason}, ensure_ascii=False)
    with pytest.raises(Exception, match="without box_pixel"):
        one(spark, codec.target_json(*(F.col(c) for c in "tfbwhrp")), [(True, "f", None, 1, 1, "r", "p")], schema)


def py_first_object(text):
    if text is None or "{" not in text:
        return None
    start = text.index("{")
    depth, inside, skip = 0, False, False
    for i, c in enumerate(text[start:], start):
        if inside:
            if skip:
                skip = False
            elif c == "\\":
                skip = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        else:
            depth += (c == "{") - (c == "}")
            if depth == 0 and c == "}":
                return text[start : i + 1]
    return None


def test_first_json_object_against_a_scan(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice('{}"\\a \n') for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["", None, "}{}", '{"a": "}"} x', '{"a": "\\"}"}', '{"' + "x" * 50000 + '"}', "{" * 300 + "}" * 300]
    assert one(spark, codec.first_json_object(F.col("t")), [(t,) for t in texts], "t string") == [py_first_object(t) for t in texts]


def test_parse_prediction(spark):
    good = [
        ('My verdict {"tampered": true, "field": "date", "box": "(8,9),(10,11)", "reason": "blur"} as asked', (True, "date", [8, 9, 10, 11])),
        ('{"tampered": false, "field": null, "box": null, "reason": ""} {"tampered": true}', (False, None, None)),
        ('{"tampered": true, "box": "lower right"}', (True, None, None)),
        ('}} {"tampered": false}', (False, None, None)),
        ('{"notes": [{"deep": {"er": 1}}], "tampered": false}', (False, None, None)),
        ('{"tampered": false, "tampered": true, "field": "a", "field": null}', (True, None, None)),
        ('{"tampered": true, "p": NaN, "q": [-Infinity], "box": "(1,2),(3,99999999999999999999)"}', (True, None, [1, 2, 3, (1 << 63) - 1])),
        ('{"tampered": true, "field": "x } \\" y"}', (True, 'x } " y', None)),
    ]
    for text, want in good:
        p = one(spark, codec.parse_prediction(F.lit(text)))[0]
        assert (p.tampered, p.field, p.box_norm) == want
    bad = ["", "all is well", "{tampered: true}", '{"tampered": false, "reason"', '[{"tampered"]', "7.5", None, '{"tampered": "no"}', '{"tampered": 0}', '{"tampered": false, "field": ["x"]}', '{"tampered": false, "box": 1.5}', '{"tampered": false, "reason": true}', '{"reason": "x"}', "{'tampered': false}", '{"tampered": null}', '{"tampered": true, oops}', '{"tampered": true,}', '{"tampered": true "field": "x"}', '{"tampered": 01}', '{"tampered": true, "field": "a\nb"}', '{"x": {"tampered": true}}', "{}"]
    assert one(spark, codec.parse_prediction(F.col("t")), [(t,) for t in bad], "t string") == [None] * len(bad)


def py_prediction(text):
    try:
        got = json.loads(py_first_object(text) or "")
    except ValueError:
        return None
    ok = isinstance(got.get("tampered"), bool) and all(isinstance(got.get(k), (str, type(None))) for k in ("field", "box", "reason"))
    return (got["tampered"], got.get("field"), got.get("reason")) if ok else None


def test_parse_prediction_against_a_json_parser(spark):
    rng = random.Random(4)
    keys, values = ['"tampered"', '"field"', '"reason"', '"x"', "field"], ["true", "false", "null", '"s"', "1", "-0.5e3", "NaN", "[1, {}]", '{"tampered": true}', "'q'", "01", "tru", '"a\\"b"', ""]
    texts = []
    for _ in range(3000):
        pairs = [(rng.choice(keys) if rng.random() < 0.9 else "") + rng.choice([": ", ":", " : ", ""] if rng.random() < 0.2 else [": "]) + rng.choice(values) for _ in range(rng.randint(0, 4))]
        texts.append(rng.choice(["", "so: "]) + "{" + rng.choice(['"tampered": true, ', '"tampered":false,', ""]) + rng.choice([", ", ",", ",,"] if rng.random() < 0.2 else [", "]).join(pairs) + "}" + rng.choice(["", " ok", "}"]))
    got = [p and (p.tampered, p.field, p.reason) for p in one(spark, codec.parse_prediction(F.col("t")), [(t,) for t in texts], "t string")]
    want = [py_prediction(t) for t in texts]
    assert [(t, g, w) for t, g, w in zip(texts, got, want) if g != w] == [] and sum(w is not None for w in want) > 100


def test_labels_seeds_paths(spark):
    texts = [("$45.99",), ("2018-12-25",), ("789417-W",), ("٣",), ("TOTAL",), ("",), (None,)]
    assert one(spark, codec.is_numeric(F.col("t")), texts, "t string") == [True, True, True, True, False, False, False]
    tags = [("O",), ("",), (None,), ("B-HEADER",), ("I-ANSWER",), ("PLAIN",), ("B-a-B",)]
    assert one(spark, codec.strip_bio(F.col("t")), tags, "t string") == ["other", "other", "other", "header", "answer", "plain", "a-b"]
    assert one(spark, codec.label_to_field(F.col("t")), [("total",), ("",), (None,)], "t string") == ["total", "field", "field"]
    import zlib

    assert one(spark, codec.doc_seed(F.lit("sroie-train-3"), 42)) == [zlib.crc32(b"sroie-train-3") ^ 42]
    assert one(spark, codec.image_uri(F.lit("images/a.png"), "/data/processed")) == ["file:///data/processed/images/a.png"]
    assert one(spark, codec.image_uri(F.lit("../x/./a.png"), "/data/processed")) == ["file:///data/x/a.png"]
    assert one(spark, codec.image_uri(F.lit("/abs/a.png"), "/data")) == ["file:///abs/a.png"]
    assert one(spark, codec.image_path(F.lit("train"), F.lit("d1"), F.lit("clean"), "jpeg")) == ["images/train/d1__clean.jpg"]
    assert one(spark, codec.image_path(F.lit("val"), F.lit("d1"), F.lit("splice"), "webp")) == ["images/val/d1__splice.png"]


def test_wilson_and_mcnemar(spark):
    p, lo, hi = (one(spark, c)[0] for c in stats.wilson(F.lit(8), F.lit(10)))
    assert p == 0.8 and lo == pytest.approx(0.490157, abs=1e-5) and hi == pytest.approx(0.943319, abs=1e-5)
    assert [one(spark, c)[0] for c in stats.wilson(F.lit(0), F.lit(0))] == [0.0, 0.0, 0.0]
    p, lo, hi = (one(spark, c)[0] for c in stats.wilson(F.lit(10), F.lit(10)))
    assert p == 1.0 and lo < 1 and hi == pytest.approx(1.0)
    pairs = [(0, 0), (8, 1), (1, 8), (0, 5), (7, 7), (120, 80), (900, 1100)]

    def exact(b, c):
        n = b + c
        return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n)

    got = one(spark, stats.mcnemar_p(F.col("b"), F.col("c")), pairs, "b bigint, c bigint")
    assert got == pytest.approx([exact(*x) for x in pairs], rel=1e-9) and got[1] == pytest.approx(0.0390625)
    assert one(spark, stats.clean_fraction(F.lit(1), F.lit(16))) == [0.062]  # half to even
    assert one(spark, stats.clean_fraction(F.lit(0), F.lit(0))) == [0.0]


RECORD = "image_path string, width int, height int, tampered boolean, field string, tamper_type string, box_pixel array<int>, reason string"
GOOD = {"image_path": "a.png", "width": 100, "height": 50, "tampered": True, "field": "total", "tamper_type": "splice", "box_pixel": [1, 2, 30, 40], "reason": "r"}
CLEAN = GOOD | {"tampered": False, "field": None, "tamper_type": None, "box_pixel": None}


@pytest.mark.parametrize(
    "base,change,code",
    [
        (GOOD, {}, []),
        (CLEAN, {}, []),
        (GOOD, {"width": 0}, ["width"]),
        (GOOD, {"height": None}, ["height"]),
        (GOOD, {"image_path": ""}, ["image_path"]),
        (GOOD, {"tampered": None}, ["tampered"]),
        (GOOD, {"reason": None}, ["reason"]),
        (GOOD, {"box_pixel": [1, 2, 3]}, ["box"]),
        (GOOD, {"box_pixel": None}, ["box"]),
        (GOOD, {"box_pixel": [50, 50, 10, 10]}, ["box_order"]),
        (GOOD, {"field": None}, ["field"]),
        (GOOD, {"tamper_type": ""}, ["tamper_type"]),
        (CLEAN, {"field": "x"}, ["clean_field"]),
        (CLEAN, {"box_pixel": [1, 2, 3, 4]}, ["clean_box"]),
        (CLEAN, {"tamper_type": "splice"}, ["clean_tamper_type"]),
    ],
)
def test_violations(spark, base, change, code):
    row = base | change
    df = spark.createDataFrame([tuple(row[c] for c in REQUIRED)], RECORD)
    assert df.select(violations(df)).first()[0] == code
    if code:
        with pytest.raises(Exception, match="invalid record"):
            require_valid(df).collect()
    else:
        assert require_valid(df).count() == 1


def test_missing_or_wrongly_typed_columns(spark):
    df = spark.createDataFrame([("a", 1)], "image_path string, height int")
    assert "missing:width" in df.select(violations(df)).first()[0]
    row = GOOD | {"tampered": "true"}
    df = spark.createDataFrame([tuple(row[c] for c in REQUIRED)], RECORD.replace("tampered boolean", "tampered string"))
    assert "tampered" in df.select(violations(df)).first()[0]
