"""URL filtering by rules that are indexed under their rarest literal token.

A rule is (pattern, action, name, strength): a regular expression over ``host + path`` or over the whole url, and what to do
when it matches. Every run of lower-case letters and digits that a matching url must contain as a whole token is a literal of the rule; the rule is
filed under the literal that the fewest urls of the table hold; one whose alternatives share no literal is filed under one token of each. A url is cut into tokens, the tokens fetch the filed
rules, and only those run their regular expression. Rules without a literal are tried on every url.

Up to ``MAX_RULES`` rules the index is a hash table inside the plan: a token's checksum names a bucket, so a look-up costs
the same for ten rules and for thousands. Matching is one narrow pass over the urls, whatever host is hot. Only the counts of the rules' own
tokens are gathered first. Beyond that the index is a table: the tokens of each distinct url meet it in a join, and the strongest rule that fits goes back to
the url's rows. Rules without a literal run on every url and stay in the plan, ``MAX_RULES`` of them at most.

Defined results: a null url, or one without ``://``, has empty host and path and no host rule; repeated rows and
null page_ids are kept; urls of any length are matched whole; an empty table gives no rows; other columns are ignored, also those named like a result.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprobe.llm.common import stored

MAX_RULES = 20_000
RULE = "struct<strength:int,name:string,action:string,pattern:string,url:boolean,given:boolean>"


@dataclass(frozen=True)
class Rule:
    """strength: the larger wins; ties go to the later name. target: ``site`` (host and path) or ``url`` (lower-cased).

    either: tokens of which any match has at least one whole; used instead of literals where a pattern has alternatives. sample: a url that matches.
    """

    name: str
    action: str
    pattern: str
    literals: tuple[str, ...]
    strength: int
    target: str = "site"
    either: tuple[str, ...] = ()
    sample: str = ""


def host_rule(action: str, host: str, path: str) -> Rule:
    """Fits the host and all its subdomains where the url's path starts with ``path``; the longest rule wins."""
    whole = re.findall(r"[a-z0-9]+", host) + re.findall(r"(?<![a-zA-Z0-9])[a-z0-9]+(?=[^a-zA-Z0-9])", path)
    return Rule(f"{host}{path}", action, f"^(?:[^/]*\\.)?{re.escape(host)}{re.escape(path) or r'(?=/|\z)'}", tuple(whole), len(host) + len(path))


def url_rule(name: str, action: str, pattern: str, *literals: str, either: tuple[str, ...] = (), sample: str = "") -> Rule:
    """A rule of the method's own: ``pattern`` on the lower-cased url; ``literals`` must all be whole tokens of any match, or one of ``either``."""
    return Rule(name, action, pattern, literals, 0, "url", either, sample)


# --- fixed values: what the method's own rules are made of ---
#: Query parameters that carry a session or a click.
PARAMETERS = "phpsessid jsessionid sessionid session_id sid aspsessionid cfid cftoken zenid oscsid sessid gclid fbclid msclkid dclid yclid utm_source utm_medium utm_campaign utm_term utm_content replytocom add-to-cart add_to_wishlist affiliate_id aff_id clickid".split()
#: First steps of paths behind which there are forms, not texts.
SECTIONS = (
    "login logout signin signout signup register registration cart basket checkout wishlist unsubscribe wp-admin wp-login wp-json administrator phpmyadmin cgi-bin "
    "lostpassword resetpassword captcha xmlrpc trackback oauth sso payment payments billing invoice order-status compare-products mailto sendmail contact-form"
).split()
#: Endings of files that hold no text.
ENDINGS = (
    "exe msi dmg apk iso bin dll deb rpm jar zip rar 7z tar gz bz2 xz cab jpg jpeg png gif bmp ico svg webp tiff mp3 mp4 avi mov wmv flv mkv wav ogg webm css js woff woff2 ttf eot swf torrent"
).split()
#: Words of hosts and paths of trade that is not wanted.
TRADES = "casino poker roulette blackjack betting sportsbook slots jackpot viagra cialis levitra payday adserver ads adclick clickbank doubleclick popunder porn xxx escort webcamgirls replica-watches essay-writing link-exchange".split()
#: Endless calendars: a section, then a year.
CALENDARS, YEARS = ("calendar", "events-calendar"), range(1960, 2061)
# --- end of fixed values ---


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text)


def own_rules() -> tuple[Rule, ...]:
    """The rules that a verdict falls back to when no host rule fits: one for each word, so that each has the word's tokens as literals."""
    out = [url_rule(f"parameter:{p}", "block", rf"[?&;]{p}=", *_words(p), sample=f"http://site.net/a?x=1&{p}=9") for p in PARAMETERS]
    out += [url_rule(f"section:{s}", "block", rf"/{s}(?:[/?#.]|\z)", *_words(s), sample=f"https://site.net/{s}/a") for s in SECTIONS]
    out += [url_rule(f"ending:{e}", "block", rf"\.{e}(?:[?#]|\z)", e, sample=f"http://site.net/file.{e}") for e in ENDINGS]
    out += [url_rule(f"trade:{t}", "block", rf"[./-]{t}[./-]", *_words(t), sample=f"http://www.{t}.net/") for t in TRADES]
    out += [url_rule(f"{c}:{y}", "block", rf"/{c}/{y}(?:[/?#]|\z)", *_words(c), str(y), sample=f"http://site.net/{c}/{y}/2") for c in CALENDARS for y in YEARS]
    return (*out, url_rule("print", "block", r"[?&;](?:print|printable|view=print)(?:[=&#]|\z)", either=("print", "printable"), sample="http://site.net/a?printable=1"), url_rule("data", "block", r"^data:", "data", sample="data:text/plain,a"))


OWN_RULES = own_rules()


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    got = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(got, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.split(F.lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"))


def rarest_token_index(pages: DataFrame, rules: list[Rule]) -> dict[str, list[int]]:
    """token -> numbers of the rules filed under it; '' holds the rules that have no literal."""
    wanted = sorted({t for r in rules if len(r.literals) > 1 for t in r.literals})
    seen: dict[str, int] = {}
    if wanted:
        hit = F.explode(F.array_intersect(_tokens(pages["url"]), _literal(wanted, "array<string>"))).alias("token")
        seen = {r["token"]: r["count"] for r in pages.select(hit).groupBy("token").count().collect()}  # at most one row a rule token
    index: dict[str, list[int]] = {}
    for k, rule in enumerate(rules):
        for token in rule.either or (min(rule.literals, key=lambda t: (seen.get(t, 0), t), default=""),):
            index.setdefault(token, []).append(k)
    return index


def _literal(value: list, kind: str) -> Column:
    """A constant of a nested type (the optimizer folds it)."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def fetched_rules(url: Column, index: dict[str, list[int]]) -> Column:
    """Numbers of the rules filed under a token of the url, and of those without a literal."""
    size = 1 << max(1, len(index)).bit_length()
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for token, numbers in sorted(index.items()):
        if token:
            buckets[zlib.crc32(token.encode()) % size].append({"token": token, "rules": numbers})
    table = _literal(buckets, "array<array<struct<token:string,rules:array<int>>>>")

    def filed(t: Column) -> Column:
        bucket = F.get(table, F.pmod(F.crc32(t), F.lit(size)).cast("int"))
        return F.flatten(F.transform(F.filter(bucket, lambda e: e["token"] == t), lambda e: e["rules"]))

    return F.array_distinct(F.concat(F.flatten(F.transform(_tokens(url), filed)), _literal(index.get("", []), "array<int>")))


def _best(fits: Column, given: Column) -> Column:
    return F.array_max(F.filter(fits, lambda r: r["given"] == given))


def _verdicts(df: DataFrame, default: str) -> DataFrame:
    """From g and o, the strongest of the given and of the own rules that fit."""
    return df.select("page_id", "host", "path", F.col("g.name").alias("rule"), F.coalesce("g.action", "o.action", F.lit(default)).alias("verdict"), F.when(F.col("g.name").isNull(), F.col("o.name")).alias("own_rule"))


def _fits(url: Column, r: Column) -> Column:
    """Whether a rule (a struct) fits a url, beside which host and path are columns."""
    return F.when(r["url"], F.rlike(F.lower(F.coalesce(url, F.lit(""))), r["pattern"])).otherwise((F.col("host") != "") & F.rlike(F.concat("host", "path"), r["pattern"]))


def _struct(r: Rule, given: bool) -> dict:
    return {"strength": r.strength, "name": r.name, "action": r.action, "pattern": r.pattern, "url": r.target == "url", "given": given}


def judge(pages: DataFrame, rules: list[Rule], own: tuple[Rule, ...] = OWN_RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, own_rule. ``rules`` decide first; ``own`` rules where none of them fits."""
    every = [*rules, *own]
    index = rarest_token_index(pages, every)
    if len(every) > MAX_RULES:
        return _judged_by_join(pages, [_struct(r, k < len(rules)) for k, r in enumerate(every)], index, default)
    table = _literal([_struct(r, k < len(rules)) for k, r in enumerate(every)], f"array<{RULE}>")
    base = pages.select("page_id", F.col("url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), fetched_rules(F.col("url"), index).alias("numbers"))
    got = base.select("page_id", "host", "path", F.filter(F.transform("numbers", lambda k: F.get(table, k)), lambda r: _fits(F.col("url"), r)).alias("fits"))
    got = got.select("page_id", "host", "path", _best(F.col("fits"), F.lit(True)).alias("g"), _best(F.col("fits"), F.lit(False)).alias("o"))
    return _verdicts(got, default)


def _judged_by_join(pages: DataFrame, rules: list[dict], index: dict[str, list[int]], default: str) -> DataFrame:
    """``judge`` with the index as a table of (token, rule). Urls without a rule's token take no part in the join."""
    anywhere = [rules[k] for k in index.get("", [])]
    if len(anywhere) > MAX_RULES:
        raise ValueError(f"{len(anywhere)} rules without a literal token run on every url; {MAX_RULES} at most")
    spark, order = pages.sparkSession, ["strength", "name", "action", "pattern", "url", "given"]
    filed = spark.createDataFrame([(t, tuple(rules[k][c] for c in order)) for t, numbers in index.items() if t for k in numbers], f"token string, r {RULE}")
    filed = stored(filed, "url-rules")
    urls = pages.select("url").where("url is not null").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hits = urls.select("url", "host", "path", F.explode(_tokens(F.col("url"))).alias("token")).join(filed, "token").where(_fits(F.col("url"), F.col("r")))
    strongest = hits.groupBy("url").agg(F.max(F.when(F.col("r.given"), F.col("r"))).alias("g"), F.max(F.when(~F.col("r.given"), F.col("r"))).alias("o"))
    base = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).join(stored(strongest, "url-verdicts"), "url", "left")
    fits = F.filter(_literal(anywhere, f"array<{RULE}>"), lambda r: _fits(F.col("url"), r))
    base = base.select("page_id", "host", "path", "g", "o", fits.alias("fits"))
    return _verdicts(base.select("page_id", "host", "path", F.greatest("g", _best(F.col("fits"), F.lit(True))).alias("g"), F.greatest("o", _best(F.col("fits"), F.lit(False))).alias("o")), default)
