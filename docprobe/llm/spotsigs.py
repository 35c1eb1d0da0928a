"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A text is cut into lower-case words. Wherever an anchor (a common word of the list) stands directly before a content word, the anchor and the
next ``CHAIN`` content words (anchors between them skipped) form a signature, kept as the first 32 bits of an md5. A run of anchors
is represented by its last one. The fingerprint is the sorted set of signatures, 8 hex digits each. A text
with words but without a signature has one, of all its words; a text without any letter or digit has the hash of its characters; the
empty text has the empty fingerprint. Equal texts therefore have equal fingerprints, and likeness is the Jaccard
similarity of the sets (two empty ones: 1).

``links`` joins a whole table: distinct fingerprints are partitioned by set length (sets whose sizes are further apart than
the threshold allows cannot meet), within a partition only sets that share one of their first signatures, rare ones first, meet,
and of those only pairs that their places in that order allow are compared whole (``similar_classes``).

All of it is DataFrame operations, but for the order of a set's signatures in ``links``.

Defined results: null text is the empty text; repeated rows, null ids (first in the order of ids) and very long texts are taken as they are, rows of one id in the
order of a hash of their text; the only document is its own next one; an empty table gives no rows; other columns are ignored, also those named like a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docprobe.llm.common import map_rows, stored, text_of
from docprobe.sources import scratch
from docprobe.sources.scratch import dropped, fresh, shuffles_deleted

CHAIN = 3
#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an the of to in is and or for on at by it as be are was were with from this that which his her their have has had not but they you we he she "
    "der die das und ein eine einer eines ist nicht mit für von den zu auf sich des dem im als auch es an werden aus er hat dass sie nach wird bei "
    "le la les un une des du de et à il est en que qui dans pour pas sur au avec par se plus ce ne son sont ou mais "
    "el los las una y o del al que en su por con para no se lo como más pero sus ha"
).split()


def content_words(text: Column) -> Column:
    """The content words in order (w), each with the anchor directly before it (a) or null; give it a column of its own before using it twice."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    stop = list(dict.fromkeys(ANCHORS))
    # each word with the one before it; then only content words, which hold the anchor directly before them
    paired = F.zip_with(words, F.concat(F.array(F.lit("")), words), lambda w, before: F.struct(w.alias("w"), before.alias("a")))
    return F.transform(F.filter(paired, lambda p: p["w"].isNotNull() & ~p["w"].isin(stop)), lambda p: F.struct(p["w"].alias("w"), F.when(p["a"].isin(stop), p["a"]).alias("a")))


def _hash(text: Column) -> Column:
    """The first 32 bits of a text's md5, which any SQL engine can compute as well."""
    return F.conv(F.left(F.md5(text.cast("binary")), F.lit(8)), 16, 10).cast("bigint")


def _chains(c: Column) -> Column:
    n = F.size(c)
    two = F.zip_with(c, F.slice(c, 2, n), lambda x, y: F.struct(x["a"].alias("a"), x["w"].alias("w0"), y["w"].alias("w1")))
    three = F.zip_with(two, F.slice(c, 3, n), lambda x, y: F.when(x["a"].isNotNull() & y["w"].isNotNull(), _hash(F.concat_ws(" ", x["a"], x["w0"], x["w1"], y["w"]))))
    return F.when(n >= CHAIN, F.filter(three, lambda h: h.isNotNull())).otherwise(F.array().cast("array<bigint>"))


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the signatures of a text column (null read as empty)."""
    t = F.coalesce(F.col(text), F.lit(""))
    got = df.withColumn("_c", content_words(t))
    got = got.withColumn("_s", F.sort_array(F.array_distinct(_chains(F.col("_c")))))
    words = F.array_join(F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " ")
    whole = _hash(F.when(words != "", words).otherwise(t))
    return got.withColumn(out, F.when(F.size("_s") > 0, F.col("_s")).when(t != "", F.array(whole)).otherwise(F.array().cast("array<bigint>"))).drop("_c", "_s")


def as_text(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def _passed(cuts: list[int]) -> Column:
    """How many of the (sorted) cuts the doc_id has reached: two levels of about the square root of the cuts each, so few comparisons a row."""
    g = math.isqrt(len(cuts)) + 1
    blocks = [cuts[i : i + g] for i in range(0, len(cuts), g)]
    passed = lambda cs: F.size(F.filter(cs, lambda c: c <= F.col("doc_id")))
    block = F.greatest(passed(F.lit([b[0] for b in blocks])), F.lit(1)) - 1
    return F.coalesce(block * g + passed(F.get(F.array(*(F.lit(b) for b in blocks)), block)), F.lit(0))


def with_next(docs: DataFrame, rows_per_range: int = 2_000, most_ranges: int = 100_000) -> DataFrame:
    """range, sub, ghost, doc_id, h, text, next_text: the text of the document with the next greater doc_id; after the last, the first.

    Ids are cut into ranges at approximate quantiles (at most ``most_ranges`` numbers on the driver); the rows of an id that has far more than a range's share are cut further by
    ranges of h, the hash of their text. Each (range, sub) is one group of a window, and the first document of a group is also sent to the
    group before it, as a ghost. Rows with equal doc_id stand in the order of h; null ids come first.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    n = rows.agg(F.count(F.lit(1))).first()[0]
    ranges = max(1, min(most_ranges, n // rows_per_range))
    cuts: list[int] = []
    if ranges > 1:
        cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []))
    rows = rows.select((_passed(cuts) if cuts else F.lit(0)).cast("int").alias("range"), "doc_id", "text", F.xxhash64("text").alias("h"))
    first = F.min(F.struct("doc_id"))  # nulls are least
    found = sorted((r["range"], r["m"]["doc_id"], r["n"]) for r in rows.groupBy("range").agg(first.alias("m"), F.count(F.lit(1)).alias("n")).collect())  # at most ``ranges`` + 1 rows
    share = max(rows_per_range, n // ranges)
    crowded = [(k, d, -(-c // share)) for k, d, c in found if c > 4 * share]
    rows = rows.withColumn("sub", F.lit(0))
    key = ["doc_id"]
    heads = [(k, 0, d) for k, d, _ in found]
    if crowded:
        key = ["doc_id", "h"]
        many = F.broadcast(spark.createDataFrame(crowded, "range int, many bigint, subs bigint"))
        sub = F.when(F.col("many").eqNullSafe(F.col("doc_id")), F.least(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("subs")), F.col("subs") - 1)).otherwise(F.col("subs"))
        rows = rows.join(many, "range", "left").withColumn("sub", F.coalesce(F.when(F.col("subs").isNotNull(), sub), F.lit(0)).cast("int")).drop("many", "subs")
        heads = sorted((r["range"], r["sub"], r["m"]["doc_id"], r["m"]["h"]) for r in rows.groupBy("range", "sub").agg(F.min(F.struct("doc_id", "h")).alias("m")).collect())
    ghosts = [(*h[2:], *heads[i - 1][:2]) for i, h in enumerate(heads)]  # the first group's head goes behind the last group
    also = spark.createDataFrame(ghosts, ", ".join(f"_{k} bigint" for k in key) + ", to_range int, to_sub int")
    met = [rows[k].eqNullSafe(F.col(f"_{k}")) for k in key]
    sent = rows.join(F.broadcast(also), met, "left")
    place = lambda a, b, ghost: F.struct(F.col(a).alias("range"), F.col(b).alias("sub"), F.lit(ghost).alias("ghost"))
    places = F.filter(F.array(place("range", "sub", False), place("to_range", "to_sub", True)), lambda p: p["range"].isNotNull())
    sent = sent.select(F.explode(places).alias("p"), "doc_id", "h", "text").select("p.*", "doc_id", "h", "text")
    return sent.withColumn("next_text", F.lead("text").over(_in_order()))


def _in_order() -> Window:
    return Window.partitionBy("range", "sub").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "h")


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (see op9)."""
    got = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    got = got.withColumn("edited", F.when(~F.col("ghost"), F.concat(F.left("text", n - half), F.left(F.coalesce("next_text", F.lit("")), half)))).drop("next_text")
    got = with_signatures(got, "text", "own").withColumn("next", F.lead("own").over(_in_order())).where(~F.col("ghost"))
    got = with_signatures(got, "edited", "changed")
    return got.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))


#: Places of the map that tells rare signatures from frequent ones; and those of them, at most, by which signatures are ordered.
MAP_BITS, FREQUENT = 22, 1 << 22


def rare_first(cls: DataFrame) -> DataFrame:
    """cls (key, s) with ``o``: the signatures by how often their place in a map occurs (its power of two), then ascending; one order for all sets.

    Places share counts, so a signature may seem more frequent than it is, which only costs time, but never rarer: what stands first is rare however large the table is. The map, a byte a
    place, is all that the driver gets.
    """
    slot = F.pmod("h", F.lit(1 << MAP_BITS)).cast("int").alias("slot")
    counts = cls.select(F.explode("s").alias("h")).select(slot).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    found = counts.where("n > 1").orderBy(F.col("n").desc(), "slot").limit(FREQUENT) if FREQUENT < 1 << MAP_BITS else counts.where("n > 1")
    with shuffles_deleted(cls.sparkSession):
        got = found.select("slot", F.floor(F.log2("n")).cast("tinyint").alias("level")).toArrow()
    levels = np.zeros(1 << MAP_BITS, np.uint8)
    levels[got.column("slot").to_numpy()] = got.column("level").to_numpy()

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column("s")
            flat, n = sets.flatten().to_numpy(zero_copy_only=False), np.asarray(pc.list_value_length(sets))
            o = flat[np.lexsort((flat, levels[flat & (len(levels) - 1)], np.repeat(np.arange(len(n)), n)))]
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "o": pa.ListArray.from_arrays(pa.array(ends), pa.array(o, pa.int64()))})

    return map_rows(cls.select("key", "s"), ordered, T.StructType([cls.schema["key"], T.StructField("o", T.ArrayType(T.LongType()))]))


def similar_classes(cls: DataFrame, threshold: float = 0.8) -> DataFrame:
    """a, b, likeness >= threshold of pairs (a < b) of classes. cls: key, s (sorted, different for every class).

    Length partitions: n is in partition floor(log n / -log threshold), and sets as alike as the threshold lie in the same or in neighbouring ones. Of two such sets the larger, of n
    signatures, has t n of the other's, so it posts its first n - ceil(t n) + 1 in the common order; the smaller has 2t / (1 + t) n of the larger's and posts accordingly fewer, to its
    own partition and the next. They share one of those. A pair whose signatures behind the shared one are too few to reach the overlap that the threshold asks for is dropped before the
    whole sets meet. Posts and pairs carry numbers of the classes, and of two sets that meet one is sent to the other.
    """
    numbered = rare_first(cls.where(F.size("s") > 0)).withColumn("id", F.monotonically_increasing_id())
    cls = stored(numbered.select("key", "id", F.transform("o", _signed).alias("o")), "spotsigs-classes")
    n = F.size("o")
    first = lambda share: F.slice("o", 1, n - F.ceil(n * F.lit(share) - 1e-9).cast("int") + 1)
    part = F.floor(F.log(n.cast("double")) / F.lit(-math.log(threshold)) + 1e-9).cast("int")
    posts = lambda share, side: cls.select(F.col("id").alias(side), n.alias(f"n{side}"), part.alias("part"), F.posexplode(first(share)).alias(f"i{side}", "h"))
    large = posts(threshold, "b")
    small = posts(2 * threshold / (1 + threshold), "a").withColumn("part", F.explode(F.array("part", F.col("part") + 1)))
    least = F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-9  # the overlap that the threshold asks for
    most = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) + F.least("ia", "ib")
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    close = ordered & (F.col("na") >= F.lit(threshold) * F.col("nb") - 1e-9) & (most >= least)
    pairs = small.join(large, ["h", "part"]).where(close).select("a", "b").distinct()
    side = lambda c: cls.select(F.col("id").alias(c), F.col("key").alias(f"k{c}"), F.col("o").alias(f"o{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("likeness", likeness(F.col("oa"), F.col("ob"))).where(F.col("likeness") >= threshold)
    return met.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "likeness")


def _signed(h: Column) -> Column:
    """A signature of 32 bits as an INT: half as wide in what is stored and sent."""
    return F.when(h < F.lit(1 << 31), h).otherwise(h - F.lit(1 << 32)).cast("int")


def links(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id (the least doc_id with the same fingerprint), n_links (other classes of likeness >= threshold): a row a document.

    Copies stay one class whatever their number; the empty fingerprint is a class without links.
    """
    rows = with_signatures(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("text")), "text", "s")
    spark = docs.sparkSession
    whole, sets_at = fresh(spark, "spotsigs-signatures"), fresh(spark, "spotsigs-sets")
    rows = scratch.stored(rows.select("doc_id", F.md5(as_text(F.col("s")).cast("binary")).alias("key"), "s"), "spotsigs-signatures", whole)
    sets = scratch.stored(rows.groupBy("key").agg(F.first("s").alias("s")), "spotsigs-sets", sets_at)  # read twice
    rows = stored(rows.select("doc_id", "key"), "spotsigs-keys")
    dropped(spark, whole)
    met = similar_classes(sets, threshold)
    dropped(spark, sets_at)  # the classes that meet have been stored by their numbers
    ids = rows.groupBy("key").agg(F.min("doc_id").alias("class_id"))
    pairs = stored(met, "spotsigs-pairs")
    both = pairs.select(F.col("a").alias("key")).unionAll(pairs.select(F.col("b").alias("key")))
    counts = both.groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    of = ids.join(counts, "key", "left").select("key", "class_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
    return rows.select("doc_id", "key").join(of, "key").select("doc_id", "class_id", "n_links")
