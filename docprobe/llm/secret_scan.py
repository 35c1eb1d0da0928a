"""Secret scanning: fixed token patterns, plus a password guess-cost model on values found beside credential words.

Base kinds (leftmost, non-overlapping, each kind for itself; failing matches are consumed and dropped):
assign (a credential word, a separator, a value of six or more characters), access (an access-key id of twenty
or more characters) and hex (twenty-four or more lower-case hex digits).

The method adds kind ``guess``. A wider context pattern proposes values; dynamic programming finds the cheapest
segmentation of a value into known words (case and look-alike characters undone), dates, repeats, keyboard walks
and brute-force characters, as log10 of guesses. Every value is costed, whether base spans cover it or not. Cheap values ("changeme", "qwerty123", "aaaaaa") are placeholders;
a value that costs ``min_log10_guesses`` or more is a secret.

Words are known from a short list of placeholders and from the corpus itself: a word that makes up a share s of the characters of a language costs 1 / s guesses (the least over the languages).
Shares are counted over all rows outside credential contexts, so that no value makes itself a word, and only of words that some value holds: the distinct values come
first, their runs of letters pick the words to count, and each distinct value is costed once, with the words that it holds. Nothing is collected; no number of words, values or languages is fixed. Values and words that many rows share
are spread by ``join_groups``.

Defined results: null text is empty text (no spans; base_sha256 is that of the empty string); a null doc_id or lang is kept;
repeated rows each give a row; texts of any length are scanned whole, one row at a time; other columns of the input are ignored by ``scan`` and kept by ``redact``, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprobe.llm.common import join_groups, lowered, map_rows, stored, text_of
from docprobe.operators.names import spare

KINDS = ("assign", "access", "hex", "guess")
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: m.end(2) - m.start(2) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), lambda m: True),  # same matches as [0-9a-f]+ kept from 24 on, found faster
)
CONTEXT_PATTERN = r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private)[_-]?key|credentials?|bearer|auth(?:orization)?)["']?\x20{0,3}(?::=|=>|[:=]|\x20is\x20)\x20{0,3}["'`]?([^\s"'`<>,;()\[\]{}|]{6,})"""
CONTEXT = re.compile(CONTEXT_PATTERN, re.I | re.A)
#: Every match holds one of these.
MARKS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth")
#: Common words of passwords and placeholders, commonest first.
COMMON = (
    "password passw0rd qwerty letmein welcome admin login changeme secret master dragon monkey shadow sunshine princess football "
    "baseball superman batman iloveyou trustno1 hello freedom whatever computer internet summer winter spring autumn london test "
    "testing example sample demo default guest user root system server database token value string null none true false your "
    "here todo fixme placeholder insert enter redacted hidden private public key api access credential account company service "
    "the and for with this that from not you are have word pass code name email phone love life time work home money"
).split()
RANK = {w: i + 1 for i, w in enumerate(COMMON)}
LOOKALIKE = str.maketrans("4@31!05$7", "aaeiiosst")
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz")
NEXT_TO = {pair for row in ROWS for a, b in zip(row, row[1:]) for pair in (a + b, b + a)}
DATES = tuple(
    re.compile(p)
    for p in (
        r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])",
        r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d",
        r"(?:19|20)\d\d",
    )
)
#: log10 of the guesses for one more segment, so that many tiny segments do not win.
SEGMENT = 0.3
#: log10 of the guesses for a unit said once more.
TWICE = math.log10(2)


def _alone(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.islower() else 30 if c.isupper() else 40)


def _starts(alive: list[int], best: list[float], j: int) -> list[int]:
    """The starts (in ascending order) of a segment of cost log10(its length) that may be the cheapest for an end at j or later; the last is the cheapest at j.

    A later start that is no dearer itself wins for good, and so does an earlier one that wins at j: the ratio of the two lengths only falls.
    """
    rising: list[int] = []
    for i in alive:
        while rising and best[i] <= best[rising[-1]]:
            rising.pop()
        rising.append(i)
    kept: list[int] = []
    for i in rising:
        if not kept or best[i] + math.log10(j - i) < best[kept[-1]] + math.log10(j - kept[-1]):
            kept.append(i)
    return kept


def segments(value: str, ranks: Mapping[str, float] = RANK, longest: int | None = None) -> tuple[float, list[tuple[str, int, int]]]:
    """(log10 guesses, the cheapest segmentation as (kind, start, end)). The empty value costs 0.

    ranks: known words, lower case, and after how many others each is guessed; longest: the length of the longest. A repeat is a run of one character, or a unit of 2 to 8 characters that
    stands directly before (as dear as a count of two, and no segment of its own).
    """
    n, low = len(value), lowered(value)
    plain = low.translate(LOOKALIKE)
    longest = max(map(len, ranks), default=0) if longest is None else longest
    ending: list[list[tuple[float, int, str]]] = [[] for _ in range(n + 1)]
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            for form, extra in ((low, 0.0), (plain, 0.3)):
                if (rank := ranks.get(form[i:j])) is not None:
                    ending[j].append((math.log10(rank + 1) + extra + (0.3 if value[i:j] != low[i:j] else 0.0), i, "word"))
        if "0" <= value[i] <= "3":
            for pattern in DATES:
                if m := pattern.match(value, i):
                    ending[m.end()].append((math.log10(119 * (365 if m.end() - i > 4 else 1)), i, "date"))
    best = [0.0] + [math.inf] * n
    back: list[tuple[int, str]] = [(0, "")] * (n + 1)
    brute = [math.inf] * (n + 1)  # the cheapest cost of a prefix whose last segment is brute force
    since = [0] * (n + 1)
    walk_from = same_from = 0  # where the runs of neighbouring keys and of one character that end here begin
    walks: list[int] = []
    sames: list[int] = []
    for j in range(1, n + 1):
        alone = _alone(value[j - 1])
        fresh, longer = best[j - 1] + SEGMENT, brute[j - 1]
        brute[j], since[j] = (longer, since[j - 1]) if longer <= fresh else (fresh, j - 1)
        brute[j] += alone
        best[j], back[j] = brute[j], (since[j], "brute")
        options = ending[j]
        if j > 1 and low[j - 2 : j] not in NEXT_TO:
            walk_from, walks = j - 1, []
        if j > 1 and low[j - 1] != low[j - 2]:
            same_from, sames = j - 1, []
        if j - 3 >= walk_from:
            walks = _starts([*walks, j - 3], best, j)
            options.append((math.log10(40 * (j - walks[-1])), walks[-1], "walk"))
        if j - 3 >= same_from:
            sames = _starts([*sames, j - 3], best, j)
            options.append((alone + math.log10(j - sames[-1]), sames[-1], "repeat"))
        for cost, i, kind in options:
            if best[i] + cost + SEGMENT < best[j]:
                best[j], back[j] = best[i] + cost + SEGMENT, (i, kind)
        for unit in range(2, min(8, j // 2) + 1):
            if best[j - unit] + TWICE < best[j] and low[j - unit : j] == low[j - 2 * unit : j - unit]:
                best[j], back[j] = best[j - unit] + TWICE, (j - unit, "repeat")
    out, j = [], n
    while j:
        i, kind = back[j]
        out.append((kind, i, j))
        j = i
    return best[n] if n else 0.0, out[::-1]


#: Letters of a known word, least and most; rows of a corpus word that is known at least; words that are looked up by broadcast at most.
SHORTEST, LONGEST, LEAST, FEW = 3, 16, 5, 200_000
#: What stands for a text's characters among words; no word holds digits.
WHOLE = "000"


def contexts(text: str) -> list[tuple[int, int]]:
    """Start and end of the values that stand in credential contexts."""
    out = []
    for m in CONTEXT.finditer(text):
        a, b = m.span(1)
        while b > a and text[b - 1] in ".!?:":
            b -= 1
        if b - a >= 6:
            out.append((a, b))
    return out


def has_context(text: Column) -> Column:
    """Whether a text has a match of the context pattern (one that is too short a value included)."""
    low = F.lower(text)
    marked = reduce(Column.__or__, (F.contains(low, F.lit(x)) for x in MARKS))
    return F.when(marked, F.rlike(text, F.lit(f"(?i){CONTEXT_PATTERN}"))).otherwise(F.lit(False))


def letter_runs(value: str) -> set[str]:
    """The runs of ``SHORTEST`` to ``LONGEST`` letters in a value, lower case, as written and with look-alikes undone."""
    out, low = set(), lowered(value)
    for form in {low, low.translate(LOOKALIKE)}:
        for m in re.finditer(r"[^\W\d_]+", form):
            run = m[0]
            for i in range(len(run) - SHORTEST + 1):
                out.update(run[i:j] for j in range(i + SHORTEST, min(len(run), i + LONGEST) + 1))
    return out


def context_values(docs: DataFrame) -> DataFrame:
    """key (SHA-256 of the text), start, end, vid (MD5 of the value), value, n (rows with that text): a row a value of each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, a, b, hashlib.md5(t[a:b].encode()).hexdigest(), t[a:b]) for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for a, b in contexts(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["key", "start", "end", "vid", "value"])

    text = text_of(docs)
    found = map_rows(docs.where(has_context(text)).select(F.sha2(text, 256), text), run, "key string, start bigint, end bigint, vid string, value string")
    return found.groupBy("key", "start", "end", "vid", "value").agg(F.count(F.lit(1)).alias("n"))


def word_guesses(docs: DataFrame, wanted: DataFrame, least: int = LEAST) -> DataFrame:
    """word, guesses of those of the ``wanted`` words (column word, each once) that occur ``least`` times or more in a language, credential contexts cut out.

    guesses: characters of the language's texts for each character that the word takes up in them, the least of all languages.
    """
    lang = F.coalesce(docs["lang"].cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    texts = docs.select(lang.alias("g"), text_of(docs).alias("text"))
    plain = F.lower(F.when(has_context(F.col("text")), F.regexp_replace("text", f"(?i){CONTEXT_PATTERN}", " ")).otherwise(F.col("text")))
    # besides its words each text gives one row that stands for its characters, so that texts are read once
    words = texts.select("g", F.length("text").alias("chars"), F.explode(F.concat(F.split(plain, r"[^\p{L}]+"), F.array(F.lit(WHOLE)))).alias("word")).where(F.length("word").between(SHORTEST, LONGEST))
    asked = wanted.union(wanted.sparkSession.createDataFrame([(WHOLE,)], "word string"))
    few = wanted.count() <= FEW  # 16 letters each: a few MB
    if few:  # what no value holds is not even counted
        words = words.join(F.broadcast(asked), "word", "left_semi")
    counts = words.groupBy("g", "word").agg(F.count(F.lit(1)).alias("times"), F.sum(F.when(F.col("word") == WHOLE, F.col("chars"))).alias("chars"))
    counts = stored(counts if few else counts.join(asked, "word", "left_semi"), "secrets-counts")
    known, sizes = counts.where((F.col("word") != WHOLE) & (F.col("times") >= least)), counts.where(F.col("word") == WHOLE)
    met = known.drop("chars").join(sizes.select("g", "chars"), "g")
    return met.groupBy("word").agg(F.min(F.col("chars") / (F.col("times") * F.length("word"))).alias("guesses"))


def value_costs(docs: DataFrame, values: DataFrame) -> DataFrame:
    """vid, n (rows of ``values``), cost: log10 of the guesses for each distinct value, by the words that the corpus shares with it."""
    each = values.groupBy("vid").agg(F.first("value").alias("value"), F.count(F.lit(1)).alias("n"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vid, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sorted(letter_runs(value))
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([vid] * len(own)), pa.array(own)], names=["vid", "word"])

    pairs = stored(map_rows(each.select("vid", "value"), runs, "vid string, word string"), "secrets-letters")
    wanted = stored(pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "secrets-wanted")
    known = stored(word_guesses(docs, wanted.select("word")).join(wanted, "word"), "secrets-words")
    met = join_groups(pairs, known, ["word"], pairs.count(), F.col("vid")).where("group is not null")
    own = met.groupBy("vid").agg(F.collect_list(F.struct("word", F.col("group.guesses").alias("guesses"))).alias("words"))  # at most 14 words a letter of the value

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = []
            for value, words in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                ranks = dict(RANK)
                for w in words or ():
                    ranks[w["word"]] = min(w["guesses"], ranks.get(w["word"], w["guesses"]))
                costs.append(segments(value, ranks, LONGEST)[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(costs)], names=["vid", "n", "cost"])

    return map_rows(each.join(own, "vid", "left").select("vid", "n", "value", "words"), cost, "vid string, n bigint, cost double")


COSTS = "array<struct<start:bigint,end:bigint,cost:double>>"


def costed(docs: DataFrame, name: str) -> DataFrame:
    """The documents and ``name``, the values of their contexts with their costs (``COSTS``, by place); null where a text has no context.

    Texts without a context, nearly all of them, go through no shuffle; with up to ``FEW`` values in all no text does.
    """
    text = text_of(docs)
    values = stored(context_values(docs), "secrets-values")
    n = values.count()
    if not n:
        return docs.withColumn(name, F.lit(None).cast(COSTS))
    costs = stored(value_costs(docs, values), "secrets-costs")
    placed = join_groups(values, costs, ["vid"], n, F.concat("key", F.col("start").cast("string")))
    found = F.sort_array(F.collect_list(F.struct("start", "end", F.col("group.cost").alias("cost"))))  # one text's contexts
    by_text = stored(placed.groupBy("key").agg(F.first("n").alias("n"), found.alias("found")), "secrets-by-text")
    columns = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    key = F.when(has_context(text), F.sha2(text, 256)).alias("key")
    if n <= FEW:  # 24 bytes a value: a few MB, and the texts are read once
        met = docs.select(columns, key).join(F.broadcast(by_text.select("key", "found")), "key", "left")
        return met.select("row.*", F.col("found").cast(COSTS).alias(name))
    rows = docs.where(has_context(text)).select(columns, key)
    total = by_text.agg(F.sum("n")).first()[0]
    met = join_groups(rows, by_text, ["key"], total, F.col("row.doc_id") if "doc_id" in docs.columns else F.lit(0))
    none = docs.where(~has_context(text)).withColumn(name, F.lit(None).cast(COSTS))
    return met.select("row.*", F.col("group.found").cast(COSTS).alias(name)).unionByName(none)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return [(kind, m.start(), m.end()) for kind, pattern, holds in BASE for m in pattern.finditer(text) if holds(m)]


def _ordered(found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def own_costs(text: str, ranks: Mapping[str, float]) -> list[tuple[int, int, float]]:
    """The values of a text's contexts and their costs by the given words alone."""
    longest = max(map(len, ranks), default=0)
    return [(a, b, segments(text[a:b], ranks, longest)[0]) for a, b in contexts(text)]


def find_secrets(text: str, min_log10_guesses: float = 8.0, ranks: Mapping[str, float] = RANK) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, end exclusive, by start and then kind as listed in KINDS."""
    return _ordered(base_spans(text) + [("guess", a, b) for a, b, cost in own_costs(text, ranks) if cost >= min_log10_guesses])


def _cell(costs: list[dict] | None) -> list[tuple[int, int, float]]:
    return [(c["start"], c["end"], c["cost"]) for c in costs or ()]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, min_log10_guesses: float = 8.0, ranks: Mapping[str, float] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans, costs (start:end:log10 of the guesses, of every value in a credential context).

    ranks: known words, instead of those of the corpus; then there is one narrow pass.
    """
    rows = costed(docs, *spare(docs, "_costs")) if ranks is None else docs.withColumn(*spare(docs, "_costs"), F.lit(None).cast(COSTS))
    words = None if ranks is None else dict(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans", "costs")}
            for cell, given in zip(batch.column(1), batch.column(2).to_pylist()):
                text = cell.as_py()
                costs = _cell(given) if words is None else own_costs(text, words)
                base = _ordered(base_spans(text))
                spans = _ordered(base + [("guess", a, b) for a, b, cost in costs if cost >= min_log10_guesses])
                for kind in KINDS:
                    cols[f"n_{kind}"].append(sum(s[0] == kind for s in spans))
                cols["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                cols["spans"].append(_joined(spans))
                cols["costs"].append(",".join(f"{a}:{b}:{cost:.2f}" for a, b, cost in costs))
            texts = ("base_sha256", "spans", "costs")
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | {k: pa.array(v, pa.string() if k in texts else pa.int64()) for k, v in cols.items()})

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_guess bigint, base_sha256 string, spans string, costs string"
    return map_rows(rows.select(rows["doc_id"].cast("bigint"), text_of(rows), rows.columns[-1]), run, schema)


def redact(docs: DataFrame, mark: str = "[secret]", min_log10_guesses: float = 8.0, ranks: Mapping[str, float] | None = None) -> DataFrame:
    """The documents with every found span (overlapping ones merged) replaced by ``mark`` and n_chars set anew.

    Rows and all other columns stay; a null text stays null.
    """
    rows = costed(docs, *spare(docs, "_costs")) if ranks is None else docs.withColumn(*spare(docs, "_costs"), F.lit(None).cast(COSTS))
    words = None if ranks is None else dict(ranks)
    at, count_at = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lengths = [], []
            for cell, given in zip(batch.column(at), batch.column(batch.num_columns - 1).to_pylist()):
                text = cell.as_py()
                if text:
                    costs = _cell(given) if words is None else own_costs(text, words)
                    parts, end = [], 0
                    for a, b in sorted([s[1:] for s in base_spans(text)] + [(a, b) for a, b, cost in costs if cost >= min_log10_guesses]):
                        if a >= end:
                            parts += [text[end:a], mark]
                        end = max(end, b)
                    text = "".join([*parts, text[end:]])
                texts.append(text)
                lengths.append(None if text is None else len(text))
            arrays = list(batch.columns)[:-1]
            arrays[at] = pa.array(texts, batch.schema.field(at).type)
            if count_at >= 0:
                arrays[count_at] = pa.array(lengths, pa.int64()).cast(batch.schema.field(count_at).type)
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names[:-1])

    return map_rows(rows, run, docs.schema)
