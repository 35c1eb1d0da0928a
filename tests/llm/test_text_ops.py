"""Secret scan, quality rules, URL filter, language identification, toxicity."""

import dataclasses
import hashlib
import itertools
import math
import random
import re
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from docprobe.llm import language_id, quality_rules, secret_scan, toxicity, url_filter

SF = "/root/testdata/sf0.01"


def rows_of(df, *key):
    return sorted(df.collect(), key=lambda r: str([r[k] for k in key or ("doc_id",)]))


# --- secrets ---


def base_spans(text):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(x[2] for x in sorted(out))


def test_base_spans_against_plain_patterns():
    rng = random.Random(2)
    bits = ["token", "Secret", "api_key", "APIKEY", "paſſword", "passwd", " ", "=", ":", '"', "'", "abc", "deadbeef", "0123456789ab", "AKIA", "ABCDEFGH12345678", "é", "\n", "tok en", "-"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        got = [s for s in secret_scan.find_secrets(text) if s[0] != "guess"]
        assert secret_scan._joined(got) == base_spans(text)


def piece_cost(value, i, j):
    """The cheapest way to guess value[i:j] as one segment, SEGMENT included."""
    low, plain = value.lower(), value.lower().translate(secret_scan.LOOKALIKE)
    s = low[i:j]
    twist = 0.3 if value[i:j] != s else 0.0
    costs = [sum(secret_scan._alone(c) for c in value[i:j])]
    if s in secret_scan.RANK:
        costs.append(math.log10(secret_scan.RANK[s] + 1) + twist)
    if plain[i:j] in secret_scan.RANK and len(s) >= 3:
        costs.append(math.log10(secret_scan.RANK[plain[i:j]] + 1) + 0.3 + twist)
    if len(set(s)) == 1 and len(s) >= 3:
        costs.append(secret_scan._alone(value[j - 1]) + math.log10(len(s)))
    if len(s) >= 3 and all(s[k : k + 2] in secret_scan.NEXT_TO for k in range(len(s) - 1)):
        costs.append(math.log10(40 * len(s)))
    if any(p.fullmatch(value[i:j]) for p in secret_scan.DATES):
        costs.append(math.log10(119 * (365 if j - i > 4 else 1)))
    got = min(costs) + secret_scan.SEGMENT
    return min(got, secret_scan.TWICE) if 2 <= j - i <= min(8, i) and s == low[2 * i - j : i] else got


def least_cost(value):
    """All segmentations, tried one by one."""
    best = math.inf
    for n in range(len(value)):
        for cuts in itertools.combinations(range(1, len(value)), n):
            ends = [0, *cuts, len(value)]
            best = min(best, sum(piece_cost(value, a, b) for a, b in zip(ends, ends[1:])))
    return best


def least_cost_of_prefixes(value):
    best = [0.0]
    for j in range(1, len(value) + 1):
        best.append(min(best[i] + piece_cost(value, i, j) for i in range(j)))
    return best[-1]


@pytest.mark.parametrize("value", ["password", "P4ssw0rd", "qwe123", "aaaab1", "x7Gq!m", "admin2021", "zxcpass", "1999abc", "abab1212", "hahaha", "adminopqr"])
def test_guess_cost_is_the_cheapest_segmentation(value):
    cost, parts = secret_scan.segments(value)
    assert cost == pytest.approx(least_cost(value)) == pytest.approx(least_cost_of_prefixes(value))
    assert [parts[0][1], parts[-1][2]] == [0, len(value)] and all(a[2] == b[1] for a, b in zip(parts, parts[1:]))


def test_guess_cost_of_random_values():
    """Words, walks, runs, dates and loose characters next to and into each other."""
    rng = random.Random(3)
    words = sorted(secret_scan.RANK)

    def bit():
        kind = rng.randrange(7)
        if kind == 0:
            return rng.choice(words)
        if kind == 1:
            row = rng.choice(secret_scan.ROWS)
            a = rng.randrange(len(row) - 3)
            walk = row[a : a + rng.randint(2, 7)]
            return walk if rng.random() < 0.5 else walk[::-1]
        if kind == 2:
            return rng.choice("aA1z0") * rng.randint(1, 7)
        if kind == 3:
            return rng.choice(["2021", "1999-12-31", "31.12.1999", "20210304", "01022003"])
        if kind == 4:
            return (rng.choice(words)[: rng.randint(2, 5)]) * rng.randint(2, 3)
        return "".join(rng.choice("abcXYZ789!_") for _ in range(rng.randint(1, 4)))

    values = ["adminopqrstu", "shadowertyuiop", "aAaAaaab", "x" * 400] + ["".join(bit() for _ in range(rng.randint(1, 4))) for _ in range(2000)]
    for value in values:
        assert secret_scan.segments(value)[0] == pytest.approx(least_cost_of_prefixes(value)), value
    assert secret_scan.segments("adminopqrstu")[0] < 4 and secret_scan.segments("shadowertyuiop")[0] < 4.5
    assert secret_scan.segments("İİpassword")[1][-1] == ("word", 2, 10)


def scanned_by_hand(docs):
    """doc_id -> costs: words counted over all texts but for their contexts, every value by the dynamic programming over plain prefixes."""
    context = re.compile(secret_scan.CONTEXT_PATTERN, re.I | re.A)
    times, chars, out = {}, {}, {}
    for _, text, lang in docs:
        low = context.sub(" ", text or "").lower()
        chars[lang or ""] = chars.get(lang or "", 0) + len(text or "")
        for w in re.findall(r"[^\W\d_]+", low):
            times[w, lang or ""] = times.get((w, lang or ""), 0) + 1
    guesses = {}
    for (w, lang), n in times.items():
        if n >= secret_scan.LEAST and 3 <= len(w) <= 16:
            guesses[w] = min(chars[lang] / (n * len(w)), guesses.get(w, math.inf))
    words = {w: min(guesses.get(w, math.inf), secret_scan.RANK.get(w, math.inf)) for w in guesses.keys() | secret_scan.RANK.keys()}
    for i, text, _ in docs:
        out[i] = ",".join(f"{a}:{b}:{secret_scan.segments(text[a:b], words)[0]:.2f}" for a, b in secret_scan.contexts(text or ""))
    return out


def test_words_come_from_the_corpus_and_not_from_secrets(spark):
    rows = [(i, f"Der Gartenzaun und das Haus {i}. password: qzkvwxpl", "de") for i in range(8)]
    rows += [(100, "rareword token=RarewordRareword", "de"), (101, None, None), (102, "other other other other other pwd: GartenzaunHaus! secret: 0ther0ther", None), (103, "", "de"), (104, "nothing here", "de")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in secret_scan.scan(df).collect()}
    assert {i: r["costs"] for i, r in got.items()} == scanned_by_hand(rows)
    cost = lambda i: [float(c.split(":")[2]) for c in got[i]["costs"].split(",")]
    assert cost(102)[0] < 6 < 8 < cost(0)[0]
    assert got[0]["n_guess"] == 1 and got[0]["n_assign"] == 1  # the base span covers the value, and both are spans
    words = secret_scan.word_guesses(df, spark.createDataFrame([("gartenzaun",), ("rareword",), ("qzkvwxpl",), ("absent",)], "word string")).collect()
    assert [r["word"] for r in words] == ["gartenzaun"]


def test_values_that_many_rows_share(spark, monkeypatch):
    """One text on 3,000 rows, one value in 3,000 texts; and words looked up by a shuffle instead of a broadcast."""
    rows = [(i, "password: correcthorse77x", "en") for i in range(3000)] + [(5000 + i, f"text {i} token: correcthorse77x the horse", "en") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    one = rows_of(secret_scan.scan(df), "doc_id", "spans", "costs")
    want = scanned_by_hand(rows)
    assert len(one) == 6000 and all(r["costs"] == want[r["doc_id"]] for r in one)
    monkeypatch.setattr(secret_scan, "FEW", 0)  # words are looked up, and texts met, by a shuffle
    assert rows_of(secret_scan.scan(df), "doc_id", "spans", "costs") == one


def test_every_value_of_the_driver_s_documents_is_costed(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not Path(path).exists():
        pytest.skip("the driver's tables are not here")
    df = spark.read.parquet(path)
    rows = [tuple(r) for r in df.select("doc_id", "text", "lang").collect()]
    want = scanned_by_hand(rows)
    assert sum(c != "" for c in want.values()) > 5
    assert {r["doc_id"]: r["costs"] for r in secret_scan.scan(df).collect()} == want


def test_placeholders_pass_and_secrets_do_not():
    kinds = lambda t: [s[0] for s in secret_scan.find_secrets(t)]
    assert kinds("pwd: x7Gq!m2Zt9#k") == ["guess"] and kinds("pwd: changeme123") == [] and kinds("bearer: qwertyuiop") == []
    assert kinds("password: welcome2021") == ["assign"] and kinds("password: x7Gqm2Zt9kQw") == ["assign", "guess"]
    assert kinds("the token of the day is nice") == [] and kinds("") == []
    assert secret_scan.segments("abcabcabcabc")[0] < 4 < secret_scan.segments("akfjwoqpdkfm")[0]


def test_scan_and_redact(odd_docs, no_docs):
    got = rows_of(secret_scan.scan(odd_docs), "doc_id", "spans")
    assert len(got) == 10 and secret_scan.scan(no_docs).count() == 0
    null = next(r for r in got if r["doc_id"] == 3)
    assert null["base_sha256"] == hashlib.sha256(b"").hexdigest() and null["spans"] == ""
    one = next(r for r in got if r["doc_id"] == 1)
    assert one["n_assign"] == 1 and one["spans"].startswith("assign:17:")
    clean = secret_scan.redact(odd_docs)
    assert clean.columns == odd_docs.columns
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in clean.collect()}
    assert texts[1] == ("Hello there, the [secret]!", 26) and texts[3] == (None, None)


def test_a_guess_that_a_base_span_covers_in_part_is_removed_whole(spark):
    text = "password: Xk9mQ2v$8Lp!zR and so on"
    assert secret_scan.find_secrets(text) == [("assign", 0, 17), ("guess", 10, 24)]
    df = spark.createDataFrame([(1, text), (2, "password: hunter2hunter2 x")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["text"] for r in secret_scan.redact(df).collect()} == {1: "[secret] and so on", 2: "[secret] x"}


# --- quality rules ---


def py_features(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {g for g in grams if grams.count(g) > 1}
    covered = {i + k for i, g in enumerate(grams) if g in many for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_features_against_python(spark, odd_docs):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b", " ", "  ", "\n", "c#", "\t", "é", "|", "\x0b"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: tuple(r)[1:6] for r in quality_rules.features(df, "doc_id").collect()}
    assert got == {i: py_features(t) for i, t in enumerate(texts)}
    assert next(tuple(r)[1:6] for r in quality_rules.features(odd_docs, "doc_id").collect() if r["doc_id"] == 3) == (0, 0, 0, 0, 0)


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10, 0.1), (1, 20, 0.1), (5, 200, 0.05), (30, 1000, 0.05), (9, 10, 0.05), (100, 20000, 0.01)]
    for k, n, p in cases:
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
        if k < n * p:
            q = Fraction(p)
            exact = float(sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1))) if n <= 1000 else sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
            assert got == pytest.approx(exact, rel=1e-8)
        else:
            assert got == 1.0
    big = spark.range(1).select(quality_rules.binomial_tail(F.lit(9000), F.lit(1000000), 0.01)).first()[0]
    assert 0 < big < 1e-20


def test_cutoffs_hold_on_fresh_rows(spark):
    """The guarantee itself: on data from the same source, false rejections stay under the risk."""

    def sample(n, seed):
        r = np.random.default_rng(seed)
        sym = (r.beta(1, 60, n) * 100).astype(int)
        return [("s", 100, 100, int(x), 0, 0, 10, 0) for x in sym]

    ddl = "stratum string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_single bigint"
    got = {r["rule"]: r for r in quality_rules.cutoffs(spark.createDataFrame(sample(8000, 1), ddl), 0.04, 0.05).collect()}
    assert 0.02 <= got["symbols"]["cutoff"] <= 0.2
    fresh = [r[3] / 100 > got["symbols"]["cutoff"] for r in sample(20000, 2)]
    assert np.mean(fresh) <= 0.04
    few = quality_rules.cutoffs(spark.createDataFrame(sample(20, 3), ddl), 0.04, 0.05)
    assert few.count() == 0


def test_quality_edges(odd_docs, no_docs, labels):
    got = quality_rules.apply_rules(odd_docs, labels)
    assert got.count() == 10 and got.where("kept and base_failed").count() == 0
    assert quality_rules.apply_rules(no_docs, labels).count() == 0 and quality_rules.apply_rules(odd_docs, labels.limit(0)).count() == 10


# --- urls ---

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def py_judge(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fit = [(len(h + p), h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[1], best[2] if best else None


def test_urls_against_python(spark):
    rng = random.Random(6)
    urls = [None, "", "nothing", "://", "http://", "HTTP://Blog.EXAMPLE.Org/en/15?x=://y", "http://a.com", "http://xorg/es/", "http://a.b.com/fr/", "http://com/de/", "http://a.com/DE/", "http://example.org:80/es/", "http://a.net/login", "http://a.org/login"]
    urls += [f"http://{rng.choice(['', 'm.', 'www.', 'x'])}{rng.choice(['example.org', 'a.com', 'com', 'org', 'net', 'example.orgs'])}{rng.choice(['', '/', '/es/', '/en/1', '/en/12', '/en/2', '/fr/x', '/de/', '/de', '?q=/es/', '#/es/'])}" for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("host", F.lit("clash")).withColumn("path", F.lit(1))
    got = rows_of(url_filter.judge(df, [url_filter.host_rule(*r) for r in RULES]), "page_id")
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, action = py_judge(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (action or ("block" if "/login" in (urls[r["page_id"]] or "") else "allow"))
    assert url_filter.judge(df.limit(0), [url_filter.host_rule(*r) for r in RULES]).count() == 0
    assert url_filter.judge(df, [], ()).where("verdict <> 'allow'").count() == 0


def test_rarest_token_and_many_rules(spark):
    df = spark.createDataFrame([(i, f"http://site{i % 90}.org/a/b") for i in range(200)], "page_id bigint, url string")
    rules = [url_filter.host_rule("block", f"site{i}.org", "/a/") for i in range(0, 90, 3)] + [url_filter.host_rule("allow", f"zz{i}.org", "") for i in range(60)]
    index = url_filter.rarest_token_index(df, rules)
    assert len(index) == 90 and "site3" in index and "org" not in index
    got = url_filter.judge(df, rules)
    assert got.where("verdict = 'block'").count() == sum(i % 90 % 3 == 0 for i in range(200))
    with pytest.raises(ValueError, match="bounded"):
        url_filter.judge(df, rules[:1] * 20_001)


# --- language ---


def py_phrases(text, symbols):
    count, at = 0, 0
    while at < len(symbols):
        n = 1
        while at + n <= len(symbols) and symbols[at : at + n] in text:
            n += 1
        at += max(1, n - 1)
        count += 1
    return count


@pytest.mark.parametrize("lane,dense", [(256, 16_000_000), (16, 16_000_000), (16, 20_000), (7, 0)])
def test_phrases_against_substring_search(monkeypatch, lane, dense):
    """Over many lanes, with few and no columns for letters; some texts are pieces of the training text, some periodic."""
    monkeypatch.setattr(language_id, "LANE", lane)
    monkeypatch.setattr(language_id, "DENSE", dense)
    rng = random.Random(7)
    texts = {k: "".join(rng.choice(s) for _ in range(800)) for k, s in (("aa", "abc d"), ("bb", "abxy e"))}
    texts["cc"] = "ab" * 60 + " " + "dc" * 30
    model = language_id.Automata(texts)
    docs = ["".join(rng.choice("abcdxye Q!7") for _ in range(rng.randint(1, 900))) for _ in range(40)]
    docs += [texts["aa"][100:700] + texts["bb"][:300], "ab" * 500, "abc" * 300 + texts["aa"][:200], "dc" * 200 + "ab" * 400, "", "?"]
    codes, sizes = model.codes(docs)
    spelt = {k: bytes(model.codes([t])[0].astype(np.uint8)) for k, t in texts.items()}
    got = model.phrases(codes, sizes)
    at = 0
    for i, n in enumerate(sizes):
        piece = bytes(codes[at : at + n].astype(np.uint8))
        at += n
        assert [py_phrases(spelt[k], piece) for k in texts] == got[i].tolist()


def test_any_number_of_letters_is_told_apart(spark):
    """Two languages in Han script without a letter in common, and one of long documents only."""
    rng = random.Random(11)
    signs = {"zh": [chr(0x4E00 + i) for i in range(700)], "ko": [chr(0x4E00 + 700 + i) for i in range(700)], "de": [*"der die das und Haus Garten ist nicht"]}
    rows = []
    for lang, letters in signs.items():
        size = 9_000 if lang == "de" else 200
        rows += [(len(rows), "".join(rng.choice(letters) for _ in range(size)), lang) for _ in range(40)]
    rows += [(None, "the quick brown fox jumps over it " * 3 + str(i), "en") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learnt = language_id.training_texts(df)
    assert sorted(learnt) == ["de", "en", "ko", "zh"] and all(len(t) <= 26_100 for t in learnt.values()) and len(language_id.Automata(learnt).classes[0x4E00:0x4E00 + 1400].clip(0).nonzero()[0]) > 1300
    got = language_id.identify(df).collect()
    want = {r[0]: r[2] for r in rows if r[0] is not None}
    assert all(r["lang_pred"] == want.get(r["doc_id"], "en") for r in got)


def test_language_edges(odd_docs, no_docs):
    got = {r["doc_id"]: r for r in language_id.identify(odd_docs).collect()}
    assert got[3]["lang_pred"] == got[2]["lang_pred"] == got[5]["lang_pred"] == "und" and got[3]["score"] == 0.0
    assert language_id.identify(odd_docs).count() == 10 and language_id.identify(no_docs).count() == 0
    assert got[4]["lang_pred"] in ("en", "de", "fr") and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language_id.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert right / n > 0.96


# --- toxicity ---


def test_marginals_against_enumeration():
    rng = np.random.default_rng(8)
    for _ in range(20):
        sizes = rng.integers(1, 7, 5)
        odds, trans = rng.normal(0, 2, sizes.sum()), rng.normal(0, 1, (2, 2))
        got, pairs = toxicity.chain_marginals(odds, sizes, trans, pairs=True)
        want, counts, at = [], np.zeros((2, 2)), 0
        for n in sizes:
            u = odds[at : at + n]
            at += n
            total, each = 0.0, np.zeros(n)
            both = np.zeros((2, 2))
            for y in itertools.product((0, 1), repeat=int(n)):
                w = math.exp(sum(u[i] for i in range(n) if y[i]) + sum(trans[a][b] for a, b in zip(y, y[1:])))
                total += w
                each += w * np.array(y)
                for a, b in zip(y, y[1:]):
                    both[a][b] += w
            want += (each / total).tolist()
            counts += both / total
        assert got == pytest.approx(want) and pairs == pytest.approx(counts)


def test_toxicity_finds_words_and_offsets():
    rng = random.Random(9)
    words = ["the", "cat", "sat", "here", "tree", "house", "blue", "green", "river"]
    texts, toxic = [], []
    for i in range(400):
        t = [rng.choice(words) for _ in range(30)]
        if i % 4 == 0:
            t[rng.randrange(30)] = rng.choice(["Vileo", "vilex", "nasty"])
        texts.append(" ".join(t) + ".")
        toxic.append(i % 4 == 0)
    field = toxicity.train_field(texts, np.array(toxic))
    x, _ = toxicity.summaries(field, texts)
    field.score = toxicity.fit_score(x, np.array(toxic), 0.25)
    new = "The cat is a Vileq thing. Blue river!"
    x, [m] = toxicity.summaries(field, [new])
    assert 1 / (1 + math.exp(-float(x[0] @ field.score))) > 0.5
    assert [new[a:b] for a, b in toxicity.spans(new, m)] == ["Vileq"]
    odd = "\u0130\u0130\u0130 ẞ vileq house"  # a letter whose lower case is two code points
    assert [odd[a:b] for a, b in toxicity.spans(odd, toxicity.summaries(field, [odd])[1][0])] == ["vileq"]
    x, _ = toxicity.summaries(field, ["the cat sat.", ""])
    assert (1 / (1 + np.exp(-x @ field.score)) < 0.3).all()


def test_toxicity_edges(odd_docs, no_docs, labels):
    got = toxicity.score(odd_docs, labels)
    assert got.count() == 10 and got.where("score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").count() == 0
    assert toxicity.score(no_docs, labels).count() == 0 and toxicity.score(odd_docs, labels.limit(0)).where("predicted = 1").count() == 0
    kept = toxicity.without_toxic(odd_docs, labels.limit(0))
    assert kept.columns == odd_docs.columns and kept.count() == 10


def test_one_id_on_all_rows_gives_one_row_to_learn_from(spark):
    words = ["tree", "house", "blue", "green", "river"]
    rows = [(1, " ".join(words) + " vile.") for _ in range(500)] + [(i, " ".join(words[i % 5 :] * 4000)) for i in range(20, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(20, 40)] + [(i, 0) for i in range(40, 60)] + [(1, 1), (1, 1)], "doc_id bigint, toxic int")
    seen = {}
    real = toxicity.train_field

    def watch(texts, toxic, **more):
        seen["chars"] = [len(t) for t in texts]
        return real(texts, toxic, **more)

    toxicity.train_field = watch
    try:
        toxicity.train(docs, labels)
    finally:
        toxicity.train_field = real
    assert len(seen["chars"]) <= 41 and max(seen["chars"]) == 10_000 and min(seen["chars"]) < 40


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_toxicity_accuracy(spark, sf):
    """Few labels (37 toxic ones at sf0.01) and more."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out")
    r = got.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("false")).first()
    assert r["recall"] > 0.9 and r["false"] < 0.03


def test_many_url_rules_meet_the_urls_in_a_join(spark, monkeypatch):
    """As the hash table in the plan, on urls that fit own rules, host rules, both and none."""
    rules = [url_filter.host_rule(*r) for r in [("allow", "org", "/"), ("block", "example.org", "/es/"), ("allow", "net", "/login"), ("block", "com", "/de/")]]
    free = (*url_filter.OWN_RULES, url_filter.url_rule("digits", "block", r"\d{9}"))
    urls = [r.sample for r in url_filter.OWN_RULES] + ["http://www.example.org/es/x", "http://example.org/en", "https://a.com/de/1", "http://a.com/123456789", None, "", "no url", "http://site.net/login/a"] * 2
    df = spark.createDataFrame([(i % 300, u, "o", "g") for i, u in enumerate(urls)], "page_id bigint, url string, host string, r string")
    order = lambda got: sorted(map(str, got.collect()))
    plain = order(url_filter.judge(df, rules, free))
    monkeypatch.setattr(url_filter, "MAX_RULES", 5)
    assert order(url_filter.judge(df, rules, free)) == plain and len(plain) == len(urls)
    assert url_filter.judge(df.limit(0), rules, free).count() == 0
    with pytest.raises(ValueError, match="without a literal"):
        url_filter.judge(df, rules, tuple(url_filter.url_rule(f"d{i}", "block", rf"\d{{{i + 9}}}") for i in range(6)))


def test_many_strata_are_joined_without_a_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(["word", "other", "thing"][(i + k) % 3] for k in range(60)) + " x" * (i % 7), f"l{i % 3}") for i in range(400)], "doc_id bigint, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    one = rows_of(quality_rules.apply_rules(docs, labels), "doc_id")
    monkeypatch.setattr(quality_rules, "MAX_STRATA", 1)
    assert rows_of(quality_rules.apply_rules(docs, labels), "doc_id") == one


def test_own_url_rules_with_and_without_the_index(spark):
    rng = random.Random(5)
    samples = [r.sample for r in url_filter.OWN_RULES]
    urls = [*samples, *(u.upper() for u in samples), "data:x", "http://h.net/print", "http://h.net/?a&view=print", "http://h.net/x.exe\n", "http://h.net/login\n"]
    for u in samples:
        k = rng.randrange(len(u))
        urls += [u[:k] + rng.choice("/?&=.-x9") + u[k:], u[:k] + u[k + 1 :], u[:k]]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    plain = tuple(dataclasses.replace(r, literals=(), either=()) for r in url_filter.OWN_RULES)
    got, want = (rows_of(url_filter.judge(df, [], own), "page_id") for own in (url_filter.OWN_RULES, plain))
    assert got == want and len(url_filter.OWN_RULES) > 300
    fits = [re.compile(r.pattern.replace(r"\z", r"\Z")) for r in url_filter.OWN_RULES]
    assert {r["page_id"]: r["verdict"] for r in got} == {i: "block" if any(f.search(u.lower()) for f in fits) else "allow" for i, u in enumerate(urls)}
    assert all(r["verdict"] == "block" for r in got if r["page_id"] < len(samples))


def test_literals_are_whole_tokens_of_any_match():
    for r in url_filter.OWN_RULES:
        tokens = set(re.split("[^a-z0-9]+", r.sample))
        assert (set(r.literals) <= tokens) if not r.either else (set(r.either) & tokens)


@pytest.mark.parametrize("rule, num, den, value", [("symbols", "n_symbols", "word_chars", 0.04), ("dup_lines", "n_dup_lines", "n_lines", 0.45)])
def test_cutoffs_do_not_stop_at_a_lenient_end(spark, rule, num, den, value):
    """With plenty of good documents of low ratios, the bound and not the end of the grid is the stop."""
    base = {"stratum": "en", "n_words": 1000, "word_chars": 1000, "n_symbols": 0, "n_dup_lines": 0, "n_repeat_words": 0, "n_lines": 1000, "n_single": 0}
    df = spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {'string' if k == 'stratum' else 'bigint'}" for k in base))
    many = df.select("*", F.explode(F.sequence(F.lit(1), F.lit(20000)))).drop("col")
    got = {r["rule"]: r["cutoff"] for r in quality_rules.cutoffs(many, 0.01, 0.05).collect()}
    assert got[rule] < value


def test_all_rules_share_the_risk(spark):
    """False rejections of different documents by different rules add up; the path ends where their sum exceeds the risk."""
    base = {"stratum": "en", "n_words": 1000, "word_chars": 1000, "n_symbols": 0, "n_dup_lines": 0, "n_repeat_words": 0, "n_lines": 1000, "n_single": 0}
    ddl = ", ".join(f"{k} {'string' if k == 'stratum' else 'bigint'}" for k in base)
    rows = [tuple((base | ({"n_symbols": 45} if i < 40 else {"n_dup_lines": 420} if i < 80 else {})).values()) for i in range(2000)]
    got = {r["rule"]: r for r in quality_rules.cutoffs(spark.createDataFrame(rows, ddl), 0.03, 0.05).collect()}
    assert got["symbols"]["cutoff"] == 0.03 and got["dup_lines"]["cutoff"] == 0.45 and {r["false_rejections"] for r in got.values()} == {40}


def test_a_document_labelled_twice_counts_once(spark):
    f = spark.createDataFrame([(1, "en", 5), (1, "en", 5), (1, "en", 4), (2, "en", 7), (3, "en", 9)], "doc_id bigint, stratum string, n_words bigint")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 0), (3, None), (3, 1), (None, 1), (9, 1)], "doc_id bigint, quality int")
    assert sorted(map(tuple, quality_rules.good_rows(f, labels).collect())) == [("en", 4), ("en", 9)]
