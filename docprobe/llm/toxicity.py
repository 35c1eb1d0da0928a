"""Toxicity by a linear-chain conditional random field over tokens.

Labels are given for documents, so tokens are labelled first: a greedy cover finds the few words and word beginnings
that explain the toxic documents of the sample and hardly occur in clean ones; in toxic documents those tokens are labelled 1. The
field (word, beginnings of 3 to 8 letters, neighbours; label transitions) is then trained on whole sentences. For every text,
forward-backward marginals give each token's probability; their maximum, sum and density enter a
logistic score, and runs of tokens with a marginal of 0.5 or more are the offending offsets.

Training uses a bounded sample (``rows_per_class`` toxic labelled rows and twice as many clean ones, picked by a hash of the id, never from the held-out
fold; of a longer text ``chars_per_row`` characters from a place set by a hash). Everything else covers all rows, whole, in one narrow pass. Sentences are the chains; all sentences of a batch run through
forward-backward at once, grouped by length.

Defined results: null or empty text gets the score of a text without tokens; labels that are null are not used; a row labelled twice counts as toxic
if any label says so; without labelled rows of both classes every score is the one of a text without tokens; repeated rows and null doc_ids are kept (of rows that repeat an id one is learnt
from); offsets are code points of the text as it stands; an empty table gives no rows; other columns are ignored, also those named like a result.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Callable, Container, Iterable, Iterator
from itertools import chain
from sys import intern

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprobe.llm.common import hash01, held_out, lowered, map_rows, release_memory, runs_of_texts, text_of

TOKEN = re.compile(r"[^\W_]+|[.!?\n]")
ENDS = frozenset(".!?\n")
LENGTHS = (3, 4, 5, 6, 7, 8)
#: Places of a grid of sentences that messages pass through at once, unless a sentence is longer by itself.
GRID = 100_000


def _features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in LENGTHS if len(word) > k)]


def _sentences(words: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for w in words:
        if w in ENDS:
            out.append([])
        else:
            out[-1].append(w)
    return [s for s in out if s]


class _Kept(dict):
    """word -> those of its features that are in a collection."""

    def __init__(self, among: Container[str]):
        super().__init__()
        self.among = among

    def __missing__(self, word: str) -> tuple[str, ...]:
        found = self[word] = tuple(f for f in _features(word) if f in self.among)
        return found


def _held(words: Iterable[str], features: Callable[[str], Iterable[str]], many: int) -> set[str]:
    """The features of a document's distinct words; marked by a second star, the beginnings that ``many`` of them share."""
    counts = Counter(chain.from_iterable(map(features, words)))
    return {*counts, *(f"{f}*" for f, c in counts.items() if c >= many)}


def toxic_features(texts: list[str], toxic: np.ndarray, min_docs: int = 5, min_rich: int = 2, many: int = 3, most: int = 400) -> set[str]:
    """Greedy cover of the toxic documents by features that are far more frequent there than in clean ones.

    A feature counts once for each pair of neighbours it occurs between: copies of one text repeat their words between the same
    neighbours, so they do not pass for evidence. ``min_docs`` documents have to hold it; of a word's beginning ``min_rich`` will do if each holds ``many`` different words that begin so,
    which a chance word does not bring about: such a beginning is a feature of its own, and clean documents are counted by the same measure. ``most``: of the features that the cover needs
    beyond those of 2 % of the toxic documents, which are all taken, how many in all.
    """
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    floor = lambda f: max(min_rich if f.endswith("**") else min_docs, 0.01 * n1)
    own = lambda f: f[:-1] if f.endswith("**") else f
    words = [[intern(w) for w in TOKEN.findall(lowered(t)) if w not in ENDS] for t in texts]  # one object a word: the driver's memory is small
    held = lambda i: _held(set(words[i]), _features, many)
    # most features are rare: a table of counts by hash sieves them out before any is kept by name
    sieve, mask, least = np.zeros(1 << 22, np.int32), (1 << 22) - 1, max(min(min_docs, min_rich), 0.01 * n1)
    for i in np.flatnonzero(toxic):
        sieve[np.unique(np.fromiter((hash(f) & mask for f in held(i)), np.int64))] += 1
    where: dict[str, array] = {}
    for i in np.flatnonzero(toxic):
        for f in held(i):
            if sieve[hash(f) & mask] >= least:
                where.setdefault(f, array("i")).append(i)
    where = {f: d for f, d in where.items() if len(d) >= floor(f)}
    clean: Counter[str] = Counter()
    known = _Kept({own(f) for f in where})
    for i in np.flatnonzero(~toxic):
        clean.update(_held(set(words[i]), known.__getitem__, many) & where.keys())
    good = {f: set(d) for f, d in where.items() if len(d) / n1 >= 25 * (clean[f] + 0.02) / n0}
    around: dict[str, set[tuple[str, str]]] = {own(f): set() for f in good}
    known = _Kept(around)
    for i in np.flatnonzero(toxic):
        mine = words[i]
        for k, w in enumerate(mine):
            for f in known[w]:
                around[f].add((mine[k - 1] if k else "", mine[k + 1] if k + 1 < len(mine) else ""))
    good = {f: d for f, d in good.items() if len(around[own(f)]) >= max(floor(f), 0.5 * len(d))}
    # a document often holds several toxic words: besides the cover, every feature of like strength is taken
    picked = {f for f, d in good.items() if len(d) >= 0.02 * n1}
    left = set(np.flatnonzero(toxic).tolist())
    while left and good and len(picked) < most:
        best = max(good, key=lambda f: (len(good[f]), -len(f), f))
        picked.add(best)
        left -= good.pop(best)
        good = {f: kept for f, d in good.items() if len(kept := d & left) >= floor(f)}
    return set(map(own, picked))


class Field:
    """Weights of the chain: unary log-odds by feature, and log-potentials of the four transitions."""

    def __init__(self) -> None:
        self.own: dict[str, float] = {}
        self.begin: dict[str, float] = {}
        self.left: dict[str, float] = {}
        self.right: dict[str, float] = {}
        self.bias = -4.0
        self.trans = np.zeros((2, 2))
        self.score = np.array([-20.0, 0.0, 0.0, 0.0])
        self.forget()

    def forget(self) -> None:
        """Empties the memory of words; row 0 stands for the ends of sentences."""
        self.index: dict[str, int] = dict.fromkeys(ENDS, 0)
        self.table = np.zeros((1, 3))

    def _row(self, w: str) -> tuple[float, float, float]:
        begin, own = self.begin, self.bias + self.own.get(w, 0.0)
        for k in range(LENGTHS[0], min(len(w) - 1, LENGTHS[-1]) + 1):
            own += begin.get(w[:k], 0.0)
        return own, self.left.get(w, 0.0), self.right.get(w, 0.0)

    def rows(self, tokens: list[str]) -> np.ndarray:
        """Rows of ``table`` (own log-odds, what the word gives its right and its left neighbour) for the tokens."""
        if len(self.index) > 200_000:
            self.forget()
        index = self.index
        ids = list(map(index.get, tokens))
        if None in ids:
            new = list({w for w, i in zip(tokens, ids) if i is None})
            index.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate([self.table, np.array([self._row(w) for w in new])])
            ids = list(map(index.__getitem__, tokens))
        return np.array(ids, np.int64)

    def marginals(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """P(label 1) of each token; rows: those of all sentences, one after another."""
        if not len(rows):
            return np.zeros(0)
        u = self.table[rows]
        odds = u[:, 0].copy()
        begins = np.r_[0, np.cumsum(sizes)[:-1]]
        inner = np.ones(len(rows), bool)
        inner[begins] = False
        at = np.flatnonzero(inner)
        odds[at] += u[at - 1, 1]
        odds[at - 1] += u[at, 2]
        return chain_marginals(odds, sizes, self.trans)[0]


def chain_marginals(odds: np.ndarray, sizes: np.ndarray, trans: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once; also the expected count of each transition if ``pairs``.

    Forward and backward messages of two labels are kept as log-odds (a chain's scale cancels out of the marginals).
    """
    t00, t01, t10, t11 = trans.ravel()
    begins = np.r_[0, np.cumsum(sizes)[:-1]]
    order = np.argsort(-sizes, kind="stable")
    out, counts = np.empty(len(odds)), np.zeros((2, 2))
    a = 0
    while a < len(order):
        longest = int(sizes[order[a]])
        b = a + max(1, min(len(order) - a, GRID // longest))
        some = order[a:b]
        size, begin = sizes[some], begins[some]
        grid = odds[np.minimum(begin[None, :] + np.arange(longest)[:, None], len(odds) - 1)]
        active = (size[None, :] > np.arange(longest)[:, None]).sum(1)  # lanes are in order of length
        forward, backward = np.empty_like(grid), np.zeros_like(grid)
        forward[0] = grid[0]
        for t in range(1, longest):
            k = active[t]
            f = forward[t - 1, :k]
            forward[t, :k] = grid[t, :k] + np.logaddexp(t01, f + t11) - np.logaddexp(t00, f + t10)
        for t in range(longest - 2, -1, -1):
            k = active[t + 1]
            g = grid[t + 1, :k] + backward[t + 1, :k]
            backward[t, :k] = np.logaddexp(t10, g + t11) - np.logaddexp(t00, g + t01)
        alive = size[None, :] > np.arange(longest)[:, None]
        with np.errstate(over="ignore"):
            p = 1 / (1 + np.exp(-(forward + backward)))
        out[(begin[None, :] + np.arange(longest)[:, None])[alive]] = p[alive]
        if pairs and longest > 1:
            both = alive[1:]
            f, g = forward[:-1][both], (grid + backward)[1:][both]
            logs = np.stack([np.full_like(f, t00), t01 + g, t10 + f, t11 + f + g])
            logs -= logs.max(0)
            e = np.exp(logs)
            counts += (e / e.sum(0)).sum(1).reshape(2, 2)
        a = b
    return out, counts


def train_field(texts: list[str], toxic: np.ndarray, epochs: int = 30, rate: float = 0.5) -> Field:
    """Adagrad on the conditional likelihood of whole sentences, and then a logistic fit of the document score."""
    marks = toxic_features(texts, toxic)
    release_memory()
    sentences, labels, plain, known = [], [], [], _Kept(marks)
    for text, bad in zip(texts, toxic):
        for s in _sentences(list(map(intern, TOKEN.findall(lowered(text))))):
            y = [int(bad and len(known[w]) > 0) for w in s]
            if any(y):
                sentences.append(s)
                labels.append(y)
            elif not bad:
                plain.append(s)
    every = max(1, len(plain) // max(2 * len(sentences), 1000))
    for s in plain[::every]:
        sentences.append(s)
        labels.append([0] * len(s))
    del plain, known
    field = Field()
    if not any(map(any, labels)):
        return field
    sizes = np.array([len(s) for s in sentences])
    words, y = list(chain.from_iterable(sentences)), np.fromiter(chain.from_iterable(labels), float, int(sizes.sum()))
    del sentences, labels
    # most features are rare: none is kept by name before a table of counts by hash has found enough
    counts, sieve, mask = Counter(words), np.zeros(1 << 22, np.int32), (1 << 22) - 1
    for w, c in counts.items():
        for f in _features(w):
            sieve[hash(f) & mask] += c
    seen: Counter[str] = Counter()
    for w, c in counts.items():
        for f in _features(w):
            if sieve[hash(f) & mask] >= 3:
                seen[f] += c
    own = {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c >= 3))}
    size = len(own)
    del counts, sieve, seen
    begins = np.r_[0, np.cumsum(sizes)[:-1]]
    first = np.zeros(len(words), bool)
    first[begins] = True
    kinds = {w: i for i, w in enumerate(dict.fromkeys(words))}
    table = np.full((len(kinds), 1 + len(LENGTHS)), size, np.int32)
    for w, i in kinds.items():
        got = [own[f] for f in _features(w) if f in own]
        table[i, : len(got)] = got
    place = np.fromiter(map(kinds.__getitem__, words), np.int64, len(words))
    word = np.array([own.get(w, size) for w in kinds])[place]
    before, after = np.where(first, size, np.r_[size, word[:-1]]), np.where(np.r_[first[1:], True], size, np.r_[word[1:], size])
    w, left, right, bias = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1), field.bias
    trans = np.zeros((2, 2))
    sums = [np.full(size + 1, 1e-6) for _ in range(3)] + [1e-6, np.full((2, 2), 1e-6)]
    pair_y = np.zeros((2, 2))
    inner = np.flatnonzero(~first)
    np.add.at(pair_y, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
    n = len(sizes)
    del words, word, kinds
    release_memory()
    for _ in range(epochs):
        odds = bias + w[table].sum(1)[place] + left[before] + right[after]  # a word's own part is added up once for all its places
        p, pair_p = chain_marginals(odds, sizes, trans, pairs=True)
        d = (p - y) / n
        grads = [np.bincount(table.ravel(), np.repeat(np.bincount(place, d, len(table)), table.shape[1]), size + 1) + 1e-5 * w, np.bincount(before, d, size + 1) + 1e-4 * left, np.bincount(after, d, size + 1) + 1e-4 * right, d.sum(), (pair_p - pair_y) / n]
        for k, g in enumerate(grads):
            sums[k] = sums[k] + g * g
        w -= rate * grads[0] / np.sqrt(sums[0])
        left -= 0.2 * rate * grads[1] / np.sqrt(sums[1])
        right -= 0.2 * rate * grads[2] / np.sqrt(sums[2])
        bias -= rate * grads[3] / math.sqrt(sums[3])
        trans -= 0.2 * rate * grads[4] / np.sqrt(sums[4])
        w[size] = left[size] = right[size] = 0.0
    strong = lambda v: {f: float(v[i]) for f, i in own.items() if abs(v[i]) > 1e-3}
    weights = strong(w)
    field.own = {f: v for f, v in weights.items() if not f.endswith("*")}
    field.begin = {f[:-1]: v for f, v in weights.items() if f.endswith("*")}
    field.left, field.right, field.bias, field.trans = strong(left), strong(right), float(bias), trans
    return field


def summaries(field: Field, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(constant, largest marginal, log of 1 + their sum, root of their mean) of each text, and the marginals of its tokens."""
    each_tokens = [TOKEN.findall(lowered(t)) for t in texts]
    rows = field.rows(list(chain.from_iterable(each_tokens)))
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in each_tokens])
    real = rows != 0
    sentence = (np.cumsum(~real) + owner)[real]  # grows at every end and at every new text
    sizes = np.diff(np.r_[0, np.flatnonzero(np.diff(sentence)) + 1, len(sentence)]) if len(sentence) else np.zeros(0, np.int64)
    tokens = np.bincount(owner[real], minlength=len(texts)) if len(texts) else []
    p = field.marginals(rows[real], sizes)
    p = np.where(p < 1e-3, 0.0, p)
    each = np.split(p, np.cumsum(tokens)[:-1]) if texts else []
    return np.array([[1.0, m.max(initial=0.0), math.log1p(m.sum()), math.sqrt(m.mean())] if len(m) else [1.0, 0.0, 0.0, 0.0] for m in each]).reshape(-1, 4), each


def fit_score(x: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the constant is moved from the sample's share of toxic rows to ``share``."""
    w, y = np.zeros(x.shape[1]), toxic.astype(float)
    ridge = np.diag([1e-6, 1e-4, 1e-4, 1e-4]) * len(x)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (p - y) + ridge @ w)
    mine = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    share = float(np.clip(share, 1e-3, 1 - 1e-3))
    w[0] += math.log(share / (1 - share)) - math.log(mine / (1 - mine))
    return w


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = 1_500, chars_per_row: int = 10_000) -> Field:
    """From a bounded sample: at most about ``rows_per_class`` toxic labelled rows and twice as many clean ones, outside the held-out fold, ``chars_per_row`` characters of each."""
    rank = hash01(F.col("doc_id"), F.lit("toxicity sample"))
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {t: min(1.0, rows_per_class * (1 if t == 1 else 2) / c) for t, c in n.items()}
    if not n.get(1) or not n.get(0):
        return Field()
    sample = known.where(rank <= F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    text = text_of(docs)
    at = F.pmod(F.xxhash64(text), F.greatest(F.length(text) - chars_per_row, F.lit(0)) + 1).cast("int")
    pieces = docs.select("doc_id", F.substring(text, at + 1, F.lit(chars_per_row)).alias("text"))
    got = pieces.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()  # a row a sampled id
    got = sorted({(r["doc_id"], r["text"], r["toxic"]) for r in got})
    texts, toxic = [r[1] for r in got], np.array([r[2] == 1 for r in got], bool)
    if not toxic.any() or toxic.all():
        return Field()
    field = train_field(texts, toxic)
    x = np.concatenate([summaries(field, texts[a : a + 200])[0] for a in range(0, len(texts), 200)])
    field.score = fit_score(x, toxic, n[1] / (n[1] + n[0]))
    field.forget()
    del got, texts, x
    release_memory()  # the driver's
    return field


def spans(text: str, marginals: np.ndarray, least: float = 0.5) -> list[tuple[int, int]]:
    """Code-point offsets (end exclusive) of runs of offending tokens."""
    out: list[tuple[int, int]] = []
    k, open_ = 0, False
    for m in TOKEN.finditer(lowered(text)):
        if m[0] in ENDS:
            open_ = False
            continue
        if marginals[k] >= least:
            out.append((out.pop()[0] if open_ else m.start(), m.end()))
            open_ = True
        else:
            open_ = False
        k += 1
    return out


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows_per_class: int = 1_500, field: Field | None = None, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (start:end, comma-joined); with ``keep`` the rows of docs below the threshold."""
    model = train(docs, labels, rows_per_class) if field is None else field
    at = docs.columns.index("text")

    def judged(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        x, each = summaries(model, texts)
        return 1 / (1 + np.exp(-x @ model.score)), each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs_of_texts(batch, 2, rows=250):
                texts = part.column(2).to_pylist()
                s, each = judged(texts)
                marked = [",".join(f"{b}:{e}" for b, e in spans(t, m)) if m.max(initial=0.0) >= 0.5 else "" for t, m in zip(texts, each)]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "held_out": part.column(1), "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32)), "spans": pa.array(marked, pa.string())})

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs_of_texts(batch, at, rows=250):
                s, _ = judged([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(s < threshold))

    if keep:
        return map_rows(docs, passing, docs.schema)
    rows = docs.select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held_out"), text_of(docs).alias("text"))
    return map_rows(rows, run, "doc_id bigint, held_out boolean, score double, predicted int, spans string")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose score stays below the threshold, all columns kept."""
    return score(docs, labels, threshold, keep=True)
