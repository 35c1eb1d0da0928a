"""One query an operator, over its whole table with production parameters, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docprobe.llm import filter_audit, hard_negatives, language_id, packing, quality_rules, secret_scan, simhash, spotsigs, systematic_mix, token_codec, toxicity, url_filter, warc

HOST_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "costs")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.host_rule(*r) for r in HOST_RULES]
    return url_filter.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def packing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing to given targets, 3 : 2 : 1 and 1 for each other source: the tokens of each source in every 64 sequences."""
    weights = {"src0": 3.0, "src1": 2.0, "src2": 1.0, None: 1.0}
    docs = table(spark, sf_dir, "documents")
    pieces = packing.pack(docs, weights=weights).groupBy("doc_id", F.floor(F.col("sequence_id") / 64).alias("part")).agg(F.sum("length").alias("tokens"))
    of = docs.groupBy("doc_id").agg(F.min(F.coalesce("source", F.lit(""))).alias("source"))
    return pieces.join(of, "doc_id").groupBy("part", "source").agg(F.sum("tokens").alias("tokens"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codec.write_and_read(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op10_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = systematic_mix.mix(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", F.col("source_size").cast("bigint").alias("source_size"), F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    corrected = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, corrected)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(table(spark, sf_dir, "pages"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def spotsigs_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of equal fingerprints, and how many other classes are alike."""
    return spotsigs.links(table(spark, sf_dir, "documents"))


def _signatures_sql(rows: str) -> str:
    """Common table expressions: t, the rows (doc_id, side, text) with their words; s, the signatures (doc_id, side, g), in words."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(spotsigs.ANCHORS))
    return rf"""
t AS (SELECT *, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM ({rows})),
u AS (SELECT doc_id, side, i, w[i] AS w, CASE WHEN i > 1 AND w[i - 1] IN ({stop}) THEN w[i - 1] END AS a FROM (SELECT doc_id, side, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
c AS (SELECT doc_id, side, a, w, lead(w, 1) OVER (PARTITION BY doc_id, side ORDER BY i) AS w1, lead(w, 2) OVER (PARTITION BY doc_id, side ORDER BY i) AS w2 FROM u WHERE w NOT IN ({stop})),
g AS (SELECT DISTINCT doc_id, side, a || ' ' || w || ' ' || w1 || ' ' || w2 AS g FROM c WHERE a IS NOT NULL AND w2 IS NOT NULL),
s AS (SELECT * FROM g UNION ALL SELECT doc_id, side, CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') ELSE text END FROM t WHERE text <> '' AND (doc_id, side) NOT IN (SELECT (doc_id, side) FROM g))"""


def _spotsigs_links_sql(threshold: float = 0.8) -> str:
    return f"""
WITH {_signatures_sql("SELECT doc_id, 'own' AS side, coalesce(text, '') AS text FROM documents")},
k AS (SELECT t.doc_id, coalesce(string_agg(g, chr(10) ORDER BY g), '') AS k, count(g) AS n FROM t LEFT JOIN s USING (doc_id) GROUP BY t.doc_id),
r AS (SELECT k, min(doc_id) AS class_id, any_value(n) AS n FROM k GROUP BY k),
cs AS (SELECT class_id, n, g FROM r JOIN s ON s.doc_id = r.class_id),
p AS (SELECT x.class_id AS a, y.class_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS shared FROM cs x JOIN cs y ON x.g = y.g AND x.class_id <> y.class_id GROUP BY ALL),
l AS (SELECT a, count(*) AS n_links FROM p WHERE shared::DOUBLE / (na + nb - shared) >= {threshold} GROUP BY a)
SELECT k.doc_id, r.class_id, coalesce(n_links, 0) AS n_links FROM k JOIN r USING (k) LEFT JOIN l ON l.a = r.class_id"""


def _op9_sql() -> str:
    like = lambda a, b: f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
    follow = lambda x: f"coalesce(lead({x}) OVER (ORDER BY doc_id), first_value({x}) OVER (ORDER BY doc_id))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, length(text) AS n, {follow('text')} AS next_text FROM d),
e AS (SELECT doc_id, text, n, left(text, n - n // 2) || left(next_text, n // 2) AS edited FROM n),
{_signatures_sql("SELECT doc_id, 'own' AS side, text FROM e UNION ALL SELECT doc_id, 'edited', edited FROM e")},
h AS (SELECT doc_id, side, list(DISTINCT left(md5(g), 8)) AS h FROM s GROUP BY ALL),
f AS (SELECT e.*, coalesce(o.h, []) AS own, coalesce(c.h, []) AS changed FROM e LEFT JOIN h o ON o.doc_id = e.doc_id AND o.side = 'own' LEFT JOIN h c ON c.doc_id = e.doc_id AND c.side = 'edited'),
x AS (SELECT *, {follow('own')} AS next FROM f)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(list_sort(own), '') AS fingerprint, array_to_string(list_sort(changed), '') AS edited_fingerprint,
 {like('own', 'changed')} AS near_edited, {like('own', 'next')} AS near_next FROM x"""


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the secret scan that its fixed patterns give."""
    return secret_scan.scan(table(spark, sf_dir, "documents"), ranks=secret_scan.RANK).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def _secret_base_sql() -> str:
    either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    patterns = {
        "assign": f"""({either('password')}|{either('passwd')}|{either('secret')}|{either('token')}|{either('api')}_?{either('key')})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        "access": "(AKIA)([A-Z0-9]+)",
        "hex": "()([0-9a-f]+)",
    }
    least = {"assign": 6, "access": 16, "hex": 24}
    each = " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, {k} AS place, {least[kind]} AS least, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', 2) AS v, regexp_split_to_array(text, '{p}') AS gap FROM d"
        for k, (kind, p) in enumerate(patterns.items())
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, kind, place, least, unnest(m) AS m, unnest(v) AS v, unnest(gap[:len(m)]) AS gap, unnest(range(len(m))) AS i FROM ({each})),
s AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM m),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
 string_agg(kind || ':' || (e - length(m)) || ':' || e, ',' ORDER BY e - length(m), place) AS spans FROM s WHERE length(v) >= least GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN a USING (doc_id)"""


def _op2_sql(risk: float = 0.025, alpha: float = 0.05) -> str:
    path = ", ".join(f"({t}, '{r}', {float(quality_rules.RULES[r][2][i])!r}::DOUBLE)" for t, (i, r) in enumerate(quality_rules.PATH))
    ratios = " ".join(f"WHEN '{r}' THEN {num}::DOUBLE / greatest({den}, 1)" for r, (num, den, _) in quality_rules.RULES.items())
    word = r"[^\x20\x09-\x0D]"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, chr(1)) AS stratum FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{word}+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
f AS (SELECT w.doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, len(list_filter(w, lambda x: length(x) = 1)) AS n_single FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
path(t, rule, cutoff) AS (VALUES {path}),
good AS (SELECT b.* FROM b JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id) WHERE NOT base_failed),
from_step AS (SELECT doc_id, stratum, min(t) FILTER (CASE rule {ratios} END > cutoff) AS t FROM good, path GROUP BY ALL),
k AS (SELECT stratum, path.t, count(*) AS n, count(*) FILTER (from_step.t <= path.t) AS k FROM from_step, path GROUP BY ALL),
tail AS (SELECT stratum, t, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk!r}::DOUBLE) + (n - j) * ln(1 - {risk!r}::DOUBLE))) AS tail
 FROM (SELECT *, unnest(range(0, k + 1)) AS j FROM k WHERE k < n * {risk!r}) GROUP BY ALL),
h AS (SELECT k.stratum, k.t, coalesce(tail <= {alpha!r} / (SELECT count(DISTINCT stratum) FROM good), false) AS holds FROM k LEFT JOIN tail USING (stratum, t)),
e AS (SELECT stratum, coalesce(min(t) FILTER (NOT holds), 1000) AS fail FROM h GROUP BY ALL),
cut AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM e JOIN path ON t < fail GROUP BY ALL),
bad AS (SELECT DISTINCT doc_id FROM b JOIN cut USING (stratum) WHERE CASE rule {ratios} END > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM b"""


def _own_sql(url: str) -> str:
    """The verdict of the method's own rules, every pattern tried on every url."""
    by_action: dict[str, list[str]] = {}
    for r in url_filter.OWN_RULES:
        by_action.setdefault(r.action, []).append(f"(?:{r.pattern})")
    whens = " ".join(f"WHEN regexp_matches(lower(coalesce({url}, '')), '{'|'.join(patterns)}') THEN '{action}'" for action, patterns in by_action.items())
    return f"CASE {whens} ELSE 'allow' END"


def _op3_sql() -> str:
    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in HOST_RULES)
    return f"""
WITH p AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(action, rhost, rpath) AS (VALUES {rules}),
best AS (SELECT page_id, url, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action FROM (SELECT DISTINCT page_id, url, host, path FROM p), r
 WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id, url)
SELECT p.page_id, host, path, rule, coalesce(action, {_own_sql('p.url')}) AS verdict FROM p LEFT JOIN best ON p.page_id IS NOT DISTINCT FROM best.page_id AND p.url = best.url"""


def _url_samples() -> list[str]:
    """A url that fits each of the method's own rules, and one that just does not."""
    words = [r.name.rpartition(":")[2] for r in url_filter.OWN_RULES]
    return [u for r, w in zip(url_filter.OWN_RULES, words) for u in (r.sample, r.sample.replace(w, f"{w}x"))]


def url_own_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three urls made from each page's id for the method's own rules, judged by the index."""
    samples = _url_samples()
    urls = table(spark, sf_dir, "pages").select(F.explode(F.array(*(3 * F.col("page_id") + k for k in range(3)))).alias("page_id"))
    urls = urls.withColumn("url", F.get(url_filter._literal(samples, "array<string>"), F.pmod("page_id", F.lit(len(samples))).cast("int")))
    return url_filter.judge(urls, []).select("page_id", "verdict")


def _url_own_rules_sql() -> str:
    samples = _url_samples()
    return f"SELECT page_id, {_own_sql('url')} AS verdict FROM (SELECT page_id, ([{', '.join(repr(u) for u in samples)}])[page_id % {len(samples)} + 1] AS url FROM (SELECT 3 * page_id + k AS page_id FROM pages, range(0, 3) r(k)))"


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][i % 3 + 1] AS w, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, w * max(level) OVER ()) AS target FROM l),
k AS (SELECT d.*, t.source_size, t.target, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.o) AS k, CASE WHEN t.source_size > 0 THEN target / t.source_size ELSE 0 END AS rate,
 ('0x' || substr(md5('0:mix:' || coalesce('s' || d.source, 'n')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, size * (floor(k * rate + u) - floor((k - 1) * rate + u))::BIGINT AS taken FROM k"""

OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, r.vec_id AS r, a.label = r.label AS same, list_inner_product(a.q, r.q)::BIGINT AS s FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) a JOIN v r ON a.vec_id <> r.vec_id),
p AS (SELECT a, r AS p, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, r) <= 5)
SELECT a AS anchor_id, p AS positive_id, row_number() OVER (PARTITION BY a, p ORDER BY s DESC, r)::INT AS rank, r AS negative_id, ps AS positive_score, s AS negative_score
FROM p JOIN s USING (a) WHERE NOT same AND 50 * ps <= 100 * s AND 100 * s <= 95 * ps QUALIFY rank <= 3"""

OP12_SQL = """
WITH d AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top, sha1(html) AS hex FROM d)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, CASE WHEN top IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN top IS DISTINCT FROM page_id THEN top END AS refers_to,
 array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest FROM g"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text))::INT
 + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM d),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
b AS (SELECT unnest([0, 1, 2, 3, 4]) AS f),
o AS (SELECT [p.f, q.f, r.f, s.f, t.f] AS o FROM b p, b q, b r, b s, b t WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
st AS (SELECT list_aggregate(list_transform(o, lambda x: substr('ABCDE', x + 1, 1)), 'string_agg', '') AS filter_order, k AS step, o[k] AS f, coalesce(list_sum(list_transform(o[:k - 1], lambda x: 1 << x)), 0)::INT AS before FROM o, range(1, 6) r(k)),
x AS (SELECT part, filter_order, step, f, mask, n, good, toxic, (mask >> f) & 1 = 1 AS fails, mask & before = 0 AS here FROM c, st),
y AS (SELECT part, filter_order, step, any_value(f) AS f, coalesce(sum(n) FILTER (here AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (here AND fails), 0)::BIGINT AS removed,
 coalesce(sum(n) FILTER (fails AND NOT here), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = 1 << f), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (here AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (here AND fails), 0)::BIGINT AS toxic_lost
 FROM x GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM y"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secret_scan, op2_quality_rules, op3_url_filter, op4_language_id, op5_packing, op6_toxicity, op7_token_codec, op8_simhash, op9_spotsigs, op10_systematic_mix, op11_hard_negatives, op12_warc, op13_filter_audit, packing_weights, url_own_rules, spotsigs_links, secret_base_spans)
}
ORACLE: dict[str, str] = {"secret_base_spans": _secret_base_sql(), "op9_spotsigs": _op9_sql(), "url_own_rules": _url_own_rules_sql(), "spotsigs_links": _spotsigs_links_sql(), "op2_quality_rules": _op2_sql(), "op3_url_filter": _op3_sql(), "op10_systematic_mix": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_warc": OP12_SQL, "op13_filter_audit": OP13_SQL}
