"""Quality rules whose cut-offs come with a guarantee on false rejections.

Per document: word, symbol, repeated-line and repeated-phrase counts; a fixed base rule; and ratio rules with
learnt cut-offs. All rules tighten together along one fixed path, from the most lenient notch of every grid to the strictest. For every stratum (language)
a step of the path holds if the exact binomial tail P(Bin(n, risk) <= false rejections) is at most alpha / strata, where the n labelled good documents
and the false rejections are counted for all rules of that step at once; the last step before the first that fails is taken. Testing in
that fixed order needs no correction along the path, the Bonferroni factor covers the strata, so with probability 1 - alpha
each stratum's false rejections (beyond the base rule) stay under ``risk``. A stratum with fewer than ln(alpha / strata) / ln(1 - risk) good labels
gets no cut-off, and rejects nothing.

All of it is DataFrame operations: one narrow pass over the texts, whose counts are stored; only they, never texts, meet the labels in
a shuffle. The cut-offs, a row a stratum, are broadcast up to ``MAX_STRATA`` rows and joined by a shuffle beyond.

Defined results: null text has no words (base_failed, not kept); null language is a stratum of its own; labels that are null, or on
unknown documents, are not used; a document labelled more than once is good only if all its labels say so, and counts once, however often its row repeats (the row of least
counts); repeated rows and null doc_ids are kept; texts of any length are counted whole; an empty table gives no rows; other columns are ignored,
also those named like a result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprobe.llm.common import stored, text_of

#: rule -> (numerator, denominator, cut-offs from lenient to strict); a document fails above the cut-off.
RULES = {
    "symbols": ("n_symbols", "word_chars", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01)),
    "dup_lines": ("n_dup_lines", "n_lines", (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3)),
    "single_letters": ("n_single", "n_words", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
    "repeat_words": ("n_repeat_words", "n_words", (0.5, 0.48, 0.46, 0.44, 0.42, 0.4, 0.38, 0.36, 0.34, 0.32, 0.3)),
}
#: The path: the first notch of every rule, then the second one, and so on.
PATH = sorted(((i, r) for r, (_, _, grid) in RULES.items() for i in range(len(grid))), key=lambda x: (x[0], list(RULES).index(x[1])))
MAX_STRATA = 10_000
#: Terms of the binomial tail that are summed one by one; what lies below is bounded by a geometric series.
EXACT_TERMS = 4000


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """keep columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_single.

    Each array is a column of its own before a higher-order function reads it. A window of three words is known by a
    64-bit mix of their hashes; only texts in which one repeats sort (hash, position) pairs. Two different windows of one text share a mix
    with probability under 1e-10 even at 50,000 words.
    """
    blank = " \t\n\x0b\x0c\r"
    t = docs.select(*keep, text_of(docs).alias("text"))
    core = F.btrim("text", F.lit(blank))
    t = t.select(*keep, "text", F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, f"[{blank}]+")).alias("w"), F.filter(F.split("text", "\n"), lambda s: F.btrim(s, F.lit(blank)) != "").alias("lines"))
    t = t.select(
        *keep,
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size(F.filter("w", lambda w: F.length(w) == 1)).cast("bigint").alias("n_single"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("x"),
    )
    n = F.size("x")
    mixed = F.zip_with(F.zip_with("x", F.slice("x", 2, n), lambda a, b: a.bitwiseXOR(F.shiftleft(b, 1))), F.slice("x", 3, n), lambda p, c: p.bitwiseXOR(F.shiftleft(c, 2)))
    t = t.withColumn("h", F.slice(mixed, F.lit(1), F.greatest(n - 2, F.lit(0)))).drop("x")
    t = t.withColumn("some", F.size("h") > F.size(F.array_distinct("h")))
    t = t.withColumn("s", F.when(F.col("some"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    before, after = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), "s"), F.slice("s", 2, F.size("s"))
    t = t.withColumn("z", F.zip_with(F.zip_with("s", after, lambda a, b: F.struct(a["h"].alias("h"), a["i"].alias("i"), F.coalesce(a["h"] == b["h"], F.lit(False)).alias("same"))), before, lambda a, b: F.when(a["same"] | (a["h"] == b["h"]), a["i"])))
    t = t.withColumn("z", F.sort_array(F.filter("z", lambda x: x.isNotNull())))
    last = F.struct(F.lit(-3).alias("p"), F.lit(0).alias("n"))
    covered = F.aggregate("z", last, lambda acc, p: F.struct(p.alias("p"), (acc["n"] + F.least(F.lit(3), p - acc["p"])).alias("n")), lambda acc: acc["n"])
    return t.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"), "n_lines", "n_single")


def base_failed() -> Column:
    """The fixed rule on the counts of ``features``."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratio(rule: str) -> Column:
    num, den, _ = RULES[rule]
    return F.col(num) / F.greatest(F.col(den), F.lit(1))


def log_gamma(x: Column) -> Column:
    """Stirling's series after raising x by 8: relative error below 1e-13 for x >= 1."""
    y = x + 8
    series = (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    step = x
    for k in range(1, 8):
        step = step * (x + k)
    return series - F.ln(step)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k < n p; from above if k exceeds EXACT_TERMS. Else 1."""
    kd, nd, odds = k.cast("double"), n.cast("double"), (1 - p) / p
    top = log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1) + kd * math.log(p) + (nd - kd) * math.log(1 - p)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    terms = F.sequence(F.lit(0), F.least(k, F.lit(EXACT_TERMS)).cast("int"))
    summed = F.aggregate(terms, start, lambda a, i: F.struct((a["term"] * (kd - i) / (nd - kd + i + 1) * odds).alias("term"), (a["sum"] + a["term"] * (kd - i) / (nd - kd + i + 1) * odds).alias("sum")))
    rest = F.when(k > EXACT_TERMS, summed["term"] / (1 - kd / (nd - kd + 1) * odds)).otherwise(0.0)  # ratios only fall from here on
    return F.when(k < nd * p, F.least(F.lit(1.0), F.exp(top) * (summed["sum"] + rest))).otherwise(1.0)


def cutoffs(good: DataFrame, risk: float, alpha: float) -> DataFrame:
    """stratum, rule, cutoff, n, false_rejections (of all rules together) for each pair that has a cut-off.

    ``good``: stratum and the counts of ``features`` of labelled good documents; those that fail the base rule are passed over.
    """
    steps = {r: [t for t, (_, rule) in enumerate(PATH) if rule == r] for r in RULES}

    # a document is rejected from some step on: counts by (stratum, that step) are all that is needed
    def from_step(rule: str) -> Column:
        passed = F.size(F.filter(F.array(*map(F.lit, RULES[rule][2])), lambda c: ratio(rule) <= c))
        return F.get(F.array(*map(F.lit, [*steps[rule], len(PATH)])), passed)

    rows = good.where(~base_failed()).select("stratum", F.least(*map(from_step, RULES)).alias("t"))
    hist = rows.groupBy("stratum", "t").agg(F.count(F.lit(1)).alias("c"))
    per = stored(hist.groupBy("stratum").agg(F.sum("c").alias("n"), F.collect_list(F.struct("t", "c")).alias("hist")), "quality-counts", MAX_STRATA)
    strata = max(per.count(), 1)
    long = per.select("stratum", "n", "hist", F.explode(F.sequence(F.lit(0), F.lit(len(PATH) - 1))).alias("t"))
    k = F.aggregate(F.filter("hist", lambda h: h["t"] <= F.col("t")), F.lit(0).cast("bigint"), lambda a, h: a + h["c"])
    held = long.select("stratum", "n", "t", k.alias("k")).withColumn("holds", binomial_tail(F.col("k"), F.col("n"), risk) <= alpha / strata)
    end = F.coalesce(F.min(F.when(~F.col("holds"), F.col("t"))), F.lit(len(PATH)))
    ends = held.groupBy("stratum", "n").agg(end.alias("end"), F.sort_array(F.collect_list(F.struct("t", "k"))).alias("ks")).where("end > 0")

    def cut(rule: str) -> Column:
        taken = F.size(F.filter(F.array(*map(F.lit, steps[rule])), lambda t: t < F.col("end")))
        return F.struct(F.lit(rule).alias("rule"), F.get(F.array(*(F.lit(float(c)) for c in RULES[rule][2])), taken - 1).alias("cutoff"))

    found = ends.select("stratum", "n", F.get("ks", F.col("end") - 1)["k"].alias("false_rejections"), F.explode(F.array(*map(cut, RULES))).alias("x"))
    return found.where("x.cutoff is not null").select("stratum", "x.rule", "x.cutoff", "n", "false_rejections")


def good_rows(features: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of counts for each document whose labels all say good."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("quality")).where("quality = 1")
    met = features.join(good, F.col("doc_id") == F.col("label_id"))
    counts = [c for c in features.columns if c != "doc_id"]
    return met.groupBy("doc_id").agg(F.min(F.struct(*counts)).alias("f")).select("f.*")


def apply_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.025, alpha: float = 0.05) -> DataFrame:
    """doc_id, the counts, base_failed, kept, failed_rules. labels: doc_id, quality (1: good)."""
    stratum = F.coalesce(F.col("lang").cast("string"), F.lit("\0null")).alias("stratum")
    f = stored(features(docs.withColumn("stratum", stratum), "doc_id", "stratum"), "quality-features")
    learnt = cutoffs(good_rows(f, labels), risk, alpha).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    learnt = stored(learnt, "quality-cutoffs", MAX_STRATA)
    few = learnt.count() <= MAX_STRATA
    cut = lambda r: F.try_element_at(F.col("cuts"), F.lit(r))
    failed = F.filter(F.array(*(F.when(ratio(r) > cut(r), F.lit(r)) for r in RULES)), lambda x: x.isNotNull())
    out = f.join(F.broadcast(learnt) if few else learnt, "stratum", "left")
    out = out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), failed.alias("failed"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), F.array_join("failed", ",").alias("failed_rules"))
