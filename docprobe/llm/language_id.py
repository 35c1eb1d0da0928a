"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton. A document is parsed against each automaton: a phrase
runs as long as it is a substring of that language's text, and the symbol that breaks it begins the next one. The
language whose phrases are fewest, normalised to bits per character (phrases * log2(training length) / characters),
wins; ties go to the first language by code point.

Parsing is vectorised: whole texts are cut into lanes of ``LANE`` symbols and all lanes step through the transition
tables at once. A lane starts afresh; then the parse that really enters it, in the state at the end of the lane before, runs beside it until
both are in the same state, from where on they agree. So phrase counts are those of one parse of the whole text. Frequent symbols have a
column in a dense table, the others' transitions are looked up in a sorted list: any number of letters is told apart.

Letters are folded to lower case; what is not a letter parts words, and runs of it count once.

The training sample is bounded by parameters: up to ``chars_per_language`` characters (less if there are many languages), in spans of at most ``span`` characters
from labelled documents of any length, picked by a hash of id and text. Everything else covers all rows, whole.

Defined results: null text, or text without a letter, is ``und`` with score 0; a null lang is not learnt from; with no
labelled rows at all everything is ``und``; null doc_ids and repeated rows are kept (rows alike are learnt from once); very long texts are parsed whole;
an empty table gives no rows; other columns are ignored, also those named like a result.
"""

from __future__ import annotations

import json
import sys
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprobe.llm.common import hash01, held_out, map_rows, runs_of_texts, text_of

LANE = 256
#: Symbols: 0 parts words, 1 is a letter that no training text has, 2 fills up short lanes.
GAP, OTHER, PAD = 0, 1, 2
#: Entries of the dense table.
DENSE = 16_000_000


def training_texts(docs: DataFrame, chars_per_language: int = 24_000, span: int = 2_000, total_chars: int = 600_000) -> dict[str, str]:
    """language -> sample text, from rows outside the held-out fold; a bounded collect."""
    text = text_of(docs)
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length(text) > 0))
    at = F.pmod(F.xxhash64(text, F.lit("span")), F.greatest(F.length(text) - span, F.lit(0)) + 1).cast("int")
    known = known.select(F.col("lang").cast("string").alias("lang"), hash01(F.col("doc_id"), text, F.lit("language sample")).alias("rank"), F.substring(text, at + 1, F.lit(span)).alias("piece"))
    sizes = {r["lang"]: r for r in known.groupBy("lang").agg(F.approx_count_distinct("rank", 0.02).alias("n"), F.avg(F.length("piece")).alias("mean")).collect()}  # a row a language
    if not sizes:
        return {}
    quota = max(500, min(chars_per_language, total_chars // len(sizes)))
    share = [(lang, min(1.0, (1.5 * quota / r["mean"] + 10) / r["n"])) for lang, r in sorted(sizes.items())]
    bound = F.try_element_at(F.map_from_entries(F.from_json(F.lit(json.dumps([{"k": k, "v": v} for k, v in share])), "array<struct<k:string,v:double>>")), F.col("lang"))
    few = known.where(F.col("rank") <= bound).groupBy("lang", "rank").agg(F.min("piece").alias("piece"))
    out: dict[str, str] = {}
    for lang, _, piece in sorted(map(tuple, few.collect())):
        if len(out.setdefault(lang, "")) < quota:
            out[lang] += piece + "\n"
    return out


class Automata:
    """Tables over one alphabet: entry = (next state << 1) | whether a phrase broke."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        seen = Counter(c for t in texts.values() for c in t.lower() if c.isalpha())
        letters = sorted(seen, key=lambda c: (-seen[c], c))
        self.symbols = len(letters) + PAD + 1
        self.classes = np.full(sys.maxunicode + 1, -1, np.int32)
        for i, c in enumerate(letters, PAD + 1):
            self.classes[ord(c)] = i
        grown = [self._grow(self.codes([texts[lang]])[0].tolist()) for lang in self.langs]
        states = sum(len(edges) + 1 for edges in grown)
        self.width = max(PAD + 1, min(self.symbols, DENSE // max(states, 1)))
        rare = self.symbols - self.width
        self.lengths = [max(2, n) for n in (len(self.codes([texts[lang]])[0]) for lang in self.langs)]
        self.table = np.zeros((states, self.width), np.int32)
        self.restart = np.zeros((len(grown), rare), np.int32)  # of rare symbols, by language
        self.roots = np.zeros(len(grown), np.int32)
        keys, values, first = [], [], 0
        for k, edges in enumerate(grown):
            idle = first + len(edges)  # one more state: before a phrase, where any symbol begins one
            start = np.full(self.symbols, idle << 1 | 1, np.int32)
            for c, s in edges[0].items():
                start[c] = (first + s) << 1 | 1
            self.table[first : idle + 1], self.restart[k], self.roots[k] = start[: self.width], start[self.width :], idle
            rows = np.repeat(np.arange(first, idle, dtype=np.int64), [len(e) for e in edges])
            cols = np.fromiter((c for e in edges for c in e), np.int64, len(rows))
            to = (first + np.fromiter((s for e in edges for s in e.values()), np.int64, len(rows))) << 1
            near = cols < self.width
            self.table[rows[near], cols[near]] = to[near]
            self.table[first : idle + 1, PAD] = np.arange(first, idle + 1) << 1
            keys.append(rows[~near] * self.symbols + cols[~near])
            values.append(to[~near])
            first = idle + 1
        self.keys = np.concatenate([*keys, [np.iinfo(np.int64).max]])
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.values = self.keys[order], np.concatenate([*values, [0]]).astype(np.int32)[order]
        self.table = self.table.ravel()

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts, one after another, and the number of each text's symbols (0 without a letter)."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        got = self.classes[points]
        unknown = np.flatnonzero(got < 0)
        if len(unknown):
            kinds, where = np.unique(points[unknown], return_inverse=True)
            for p in kinds:
                low = chr(p).lower()
                known = int(self.classes[ord(low)]) if len(low) == 1 else -1
                self.classes[p] = known if known > PAD else OTHER if chr(p).isalpha() else GAP
            got[unknown] = self.classes[kinds][where]
        ends = np.cumsum([len(t) for t in texts])
        keep = got != GAP
        keep[1:] |= got[:-1] != GAP  # of a run of gaps the first stays
        if len(keep):
            keep[np.r_[0, ends[:-1]][np.diff(np.r_[0, ends]) > 0]] = True
        letters = np.diff(np.r_[0, np.r_[0, np.cumsum(got != GAP)][ends]])
        before = np.r_[0, np.cumsum(keep)]
        sizes = np.diff(np.r_[0, before[ends]])
        if (letters == 0).any():
            keep &= np.repeat(letters > 0, np.diff(np.r_[0, ends]))
            sizes = np.where(letters > 0, sizes, 0)
        return got[keep], sizes

    def _grow(self, codes: list[int]) -> list[dict[int, int]]:
        """Edges of the suffix automaton of the codes, grown one symbol at a time; state 0 is its root."""
        edges: list[dict[int, int]] = [{}]
        length, link, last = [0], [-1], 0
        for c in codes:
            new = len(edges)
            edges.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = new
                p = link[p]
            if p >= 0:
                q = edges[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(edges)
                    edges.append(dict(edges[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[new] = twin
                    while p >= 0 and edges[p].get(c) == q:
                        edges[p][c] = twin
                        p = link[p]
            last = new
        return edges

    def _step(self, state: np.ndarray, symbol: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Table entries for states, symbols and languages of one shape."""
        if self.width == self.symbols:
            return self.table[state * np.int32(self.width) + symbol]
        value = self.table[state * np.int32(self.width) + np.minimum(symbol, self.width - 1)]
        rare = np.nonzero(symbol >= self.width)
        if len(rare[0]):
            s = symbol[rare]
            key = state[rare].astype(np.int64) * self.symbols + s
            at = np.searchsorted(self.keys, key)
            value[rare] = np.where(self.keys[at] == key, self.values[at], self.restart[lang[rare], s - self.width])
        return value

    def phrases(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) against each language (columns)."""
        lanes, n = -(-sizes // LANE), len(self.langs)
        owner = np.repeat(np.arange(len(sizes)), lanes)
        place = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = np.repeat(np.cumsum(sizes) - sizes, lanes) + place * LANE
        size = np.minimum(LANE, np.repeat(np.cumsum(sizes), lanes) - begin)
        order = np.argsort(-size, kind="stable")
        padded = np.r_[codes, np.zeros(LANE, codes.dtype)]
        counts, ends = np.zeros((len(owner), n), np.int64), np.zeros((len(owner), n), np.int32)
        for a in range(0, len(order), 4096):
            some = order[a : a + 4096]
            longest = int(size[some[0]])
            grid = padded[begin[some][None, :] + np.arange(longest)[:, None]]
            grid[np.arange(longest)[:, None] >= size[some][None, :]] = PAD
            state = np.tile(self.roots, (len(some), 1))
            lang = np.broadcast_to(np.arange(n), state.shape)
            broke = np.zeros(state.shape, np.int32)
            for symbols in grid:
                value = self._step(state, np.broadcast_to(symbols[:, None], state.shape), lang)
                broke += value & 1
                state = value >> 1
            counts[some], ends[some] = broke, state
        counts += self._carried(codes, place, begin, size, ends)
        total = np.zeros((len(sizes), n), np.int64)
        np.add.at(total, owner, counts)
        return total

    def _carried(self, codes: np.ndarray, place: np.ndarray, begin: np.ndarray, size: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """What each lane's count changes by when the parse enters it in the state at the end of the lane before.

        alone: the states at the lanes' ends when each starts afresh. A lane is run again only while the state that enters it changes.
        """
        n = len(self.langs)
        change, ends = np.zeros(alone.shape, np.int64), alone.copy()
        lane, lang = (x.ravel() for x in np.meshgrid(np.flatnonzero(place > 0), np.arange(n), indexing="ij"))
        turn = 0
        while len(lane):
            mine, own = ends[lane - 1, lang], self.roots[lang]
            diff, end = np.zeros(len(lane), np.int64), alone[lane, lang].copy()
            left = np.arange(len(lane))
            for t in range(LANE):
                left = left[size[lane[left]] > t]
                if not len(left):
                    break
                symbol, k = codes[begin[lane[left]] + t], lang[left]
                a, b = self._step(mine[left], symbol, k), self._step(own[left], symbol, k)
                mine[left], own[left] = a >> 1, b >> 1
                diff[left] += (a & 1) - (b & 1)
                end[left] = a >> 1
                met = a >> 1 == b >> 1
                end[left[met]] = alone[lane[left[met]], k[met]]
                left = left[~met]
            change[lane, lang] = diff
            moved = ends[lane, lang] != end
            ends[lane, lang] = end
            follows = moved & (lane + 1 < len(place))
            lane, lang = lane[follows] + 1, lang[follows]
            inside = place[lane] > 0
            lane, lang = lane[inside], lang[inside]
            turn += 1
            if turn >= 8 and len(lane):  # a parse that does not meet the lanes' own: the first such lane of a text, and then on
                lane, lang = self._one_by_one(codes, place, begin, size, alone, ends, change, lane, lang)
        return change

    def _one_by_one(self, codes: np.ndarray, place: np.ndarray, begin: np.ndarray, size: np.ndarray, alone: np.ndarray, ends: np.ndarray, change: np.ndarray, lane: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, lane after lane for each language, until a lane ends in the state that it had."""
        for k in range(len(self.langs)):
            done = -1
            for first in sorted(lane[lang == k].tolist()):
                at = first
                while at > done and at < len(place) and place[at] > 0:
                    mine, own, diff = int(ends[at - 1, k]), int(self.roots[k]), 0
                    for c in codes[begin[at] : begin[at] + size[at]].tolist():
                        a, b = (int(self._step(np.array([s], np.int32), np.array([c]), np.array([k]))[0]) for s in (mine, own)) if c >= self.width else (int(self.table[s * self.width + c]) for s in (mine, own))
                        mine, own, diff = a >> 1, b >> 1, diff + (a & 1) - (b & 1)
                        if mine == own:
                            mine = int(alone[at, k])
                            break
                    change[at, k], same = diff, ends[at, k] == mine
                    ends[at, k], done = mine, at
                    if same:
                        break
                    at += 1
        return lane[:0], lang[:0]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not texts or not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        codes, sizes = self.codes(texts)
        bits = self.phrases(codes, sizes) * np.log2(self.lengths) / np.maximum(sizes, 1)[:, None]
        best = bits.argmin(1)
        low = bits[np.arange(len(bits)), best]
        weight = np.exp2(-4.0 * (bits - low[:, None]))  # how far behind the others are, as a share
        score = 1 / weight.sum(1)
        return [self.langs[b] if n else "und" for b, n in zip(best, sizes)], [float(s) if n else 0.0 for s, n in zip(score, sizes)]


@lru_cache(2)
def automata(texts: tuple[tuple[str, str], ...]) -> Automata:
    """Built once in each Python worker."""
    return Automata(dict(texts))


def identify(docs: DataFrame, texts: dict[str, str] | None = None, **sample: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score. The model is a few hundred thousand characters, sent with the tasks."""
    learnt = tuple(sorted((training_texts(docs, **sample) if texts is None else texts).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = automata(learnt)
        for batch in batches:
            langs, scores = [], []
            for part in runs_of_texts(batch, 2):
                some = model.predict(part.column(2).to_pylist())
                langs += some[0]
                scores += some[1]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    rows = docs.select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held_out"), text_of(docs).alias("text"))
    return map_rows(rows, run, "doc_id bigint, held_out boolean, lang_pred string, score double", "docprobe.llm.language_id")
