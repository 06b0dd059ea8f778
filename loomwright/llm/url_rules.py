"""URL filtering by pattern rules indexed on their rarest literal token (operator 6).

A rule is either an address (``com/fr/``: a host with its subdomains and the start of a path) or a pattern: literal
text in which ``*`` stands for any run, ``^`` for one character that is neither letter nor digit, or for an end of the
url, and a leading ``||`` for the start of a word in the host. A rule's literal tokens are the runs of letters and
digits that can only match whole: those with ``^``, other punctuation or an end on both sides, and not ``*``. Each rule
is filed under that of its tokens which the fewest urls hold; a url looks up its own tokens and only the rules found run
as regular expressions, which are compiled when first needed. A pattern without a whole token is tried on every url, so
no match is lost.

Of the addresses that fit, the longest decides (of equal ones, a block); without one, a url is blocked if a pattern
fits, and else allowed. Rules come as a list or from a table; they are held by the driver and sent to each executor
once, so their number is bounded by its memory (some hundred bytes a rule), unlike that of the urls.

Cases: a null url and one without ``://`` have empty host and path, no rule, and the patterns' verdict (a null is
allowed); repeated rows and null ids are judged one by one; an empty table gives no rows; further columns are
ignored. In a table of rules, those with a null rule or verdict are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import Bloom, materialise

# The address rules (verdict, host/path).
ADDRESSES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
# Patterns of urls that training data seldom wants, by kind, over the lower-case url. The list is our own;
# a deployment brings its lists as tables.
PATTERNS = tuple(
    """
    ||casino^ ||casinos^ ||poker^ ||bet^ ||bets^ ||betting^ ||bookmaker^ ||jackpot^ ||slots^ ||roulette^ ||lottery^ ^casino^*^bonus^ ^free^spins^
    ||adult^ ||porn* ||sex^ ||xxx^ ||escort^ ||escorts^ ||hentai^ ||webcams^ ||nsfw^ ^adult^*^video* ^live^cams^
    ||pill^ ||pills^ ||viagra^ ||cialis^ ||pharmacy^*^cheap* ^without^prescription^
    ||spam^ ||linkfarm^ ||backlinks^ ||doorway^ ^payday^loan* ^buy^followers^ ^essay^writing^service^
    ||warez^ ||nulled^ ||keygen^ ||cracks^ ^crack^*^download^ ^serial^key^ ||torrents^ ^torrent^*^magnet^
    ||ad^ ||ads^ ||adserver^ ||adclick^ ||popads^ ||banner^ ||banners^ ||track^ ||tracker^ ||tracking^ ||trk^ ||pixel^ ^adclick^ ^click^*^redirect^ ^affiliate^*^id= ^pixel.gif^
    ^wp-login.php^ ^wp-admin^ ^xmlrpc.php^ ^cgi-bin^ ^phpmyadmin^ ^add-to-cart= ^add_to_cart= ^replytocom= ^phpsessid= ^jsessionid= ^sessionid= ^logout^ ^signin^*^return*
    .exe^ .msi^ .apk^ .dmg^ .iso^ .rar^ .torrent^
    """.split()
)

_TOKEN = re.compile("[a-z0-9]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

VERDICT = "host string, path string, rule string, verdict string, n_candidates int"


@dataclass(frozen=True)
class Rule:
    block: bool
    text: str
    regex: str
    tokens: tuple[str, ...]
    address: bool


def address_rule(verdict: str, text: str) -> Rule:
    host, _, path = text.partition("/")
    regex = rf"(?s)(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}"  # of host and path together
    low = path.translate(_LOWER)
    whole = [m[0] for m in _TOKEN.finditer(low) if m.end() < len(low)]  # the last may go on in the url
    return Rule(verdict == "block", text, regex, (*_TOKEN.findall(host), *whole), True)


def pattern_rule(text: str) -> Rule:
    body = text.removeprefix("||")
    parts = {"*": ".*", "^": "(?:[^a-z0-9]|^|$)"}
    regex = "".join(parts.get(c, re.escape(c)) for c in body)
    if body != text:
        regex = "^[^/?#]*://(?:[^/?#]*[^a-z0-9/?#])?" + regex
    begins = body != text  # a word of the host begins there
    whole = [m[0] for m in _TOKEN.finditer(body) if (m.start() or begins) and m.end() < len(body) and "*" not in (body[max(m.start() - 1, 0)], body[m.end()])]
    return Rule(True, text, f"(?s){regex}", tuple(whole), False)


def default_rules() -> list[Rule]:
    return [*(address_rule(*a) for a in ADDRESSES), *map(pattern_rule, PATTERNS)]


def rules_from_table(table: DataFrame) -> list[Rule]:
    """Rules from rows of ``verdict`` (allow or block) and ``rule``: an address, or a pattern, which blocks.

    A rule is an address if it has a ``/`` and none of the patterns' signs.
    """
    rows = table.where(F.col("rule").isNotNull() & F.col("verdict").isin("allow", "block")).select("verdict", "rule").distinct().collect()
    is_address = lambda r: "/" in r and not re.search(r"[*^]|^\|\|", r)
    found = [(r["verdict"], r["rule"]) for r in sorted(rows)]
    if wrong := [r for v, r in found if v == "allow" and not is_address(r)]:
        raise ValueError(f"patterns only block: {wrong[:5]}")
    return [address_rule(v, r) if is_address(r) else pattern_rule(r) for v, r in found]


def token_counts(urls: DataFrame, rules: Iterable[Rule]) -> dict[str, int]:
    """How many urls hold each of the rules' tokens: as many rows as the rules have tokens, whatever the urls."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    tokens = materialise(urls.sparkSession.createDataFrame(pd.DataFrame({"token": wanted})).withColumn("key", F.xxhash64("token")), "url-tokens")
    own = urls.select(F.explode(F.array_distinct(F.split(F.lower("url"), "[^a-z0-9]+"))).alias("token"))
    # Only the rules' tokens pass, and are counted where the urls are before anything moves, however common one is.
    mine = Bloom(tokens.select("key")).among(own.withColumn("key", F.xxhash64("token")), "key")
    return {r["token"]: r["count"] for r in mine.groupBy("token").count().join(tokens.select("token"), "token", "left_semi").collect()}


class Index:
    def __init__(self, rules: list[Rule], counts: dict[str, int]) -> None:
        self.rules = rules
        self.compiled: dict[int, re.Pattern[str]] = {}
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        for k, rule in enumerate(rules):
            if rule.tokens:
                self.by_token.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(k)
            else:
                self.always.append(k)

    def regex(self, k: int) -> re.Pattern[str]:
        found = self.compiled.get(k)
        if found is None:
            found = self.compiled[k] = re.compile(self.rules[k].regex)
        return found

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int]:
        if url is None:
            return "", "", None, "allow", 0
        host = path = ""
        at = url.find("://")
        if at >= 0:
            rest = re.split("[?#]", url[at + 3 :], maxsplit=1)[0]
            cut = rest.find("/")
            host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
            host = host.translate(_LOWER)
        lower = url.translate(_LOWER)
        candidates = [k for t in dict.fromkeys(_TOKEN.findall(lower)) for k in self.by_token.get(t, ())]
        best, block = None, False
        for k in (*candidates, *self.always):
            rule = self.rules[k]
            if rule.address:
                if (best is None or (len(rule.text), rule.block) > (len(best.text), best.block)) and self.regex(k).match(host + path):
                    best = rule
            elif not block and self.regex(k).search(lower):
                block = True
        if best is not None:
            block = best.block
        return host, path, best and best.text, "block" if block else "allow", len(candidates) + len(self.always)


def judge_urls(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``page_id`` with host, path, the deciding address rule, the verdict and how many rules were tried."""
    rules = default_rules() if rules is None else rules
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    shipped = pages.sparkSession.sparkContext.broadcast(Index(rules, token_counts(urls, rules)))  # grows with the rules alone

    @F.pandas_udf(VERDICT)
    def verdict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = shipped.value
        for urls in batches:
            yield pd.DataFrame(map(index.judge, urls), columns=[c.split()[0] for c in VERDICT.split(", ")])

    return urls.select("page_id", verdict("url").alias("v")).select("page_id", "v.*")


def oracle() -> str:
    """The same judgement as DuckDB SQL, each rule tried on each url; patterns become regular expressions within SQL."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    fits = []
    for verdict, rule in sorted(ADDRESSES, key=lambda a: -len(a[1])):
        host, _, path = rule.partition("/")
        fits.append((rule, verdict, f"(host = {text(host)} OR ends_with(host, {text('.' + host)})) AND starts_with(path, {text('/' + path)})"))
    patterns = ", ".join(f"({text(p)})" for p in PATTERNS)
    return f"""
WITH written(p) AS (
  VALUES {patterns}
), patterns AS (
  SELECT starts_with(p, '||') AS in_host, replace(replace(regexp_escape(ltrim(p, '|')), '\\^', '([^a-z0-9]|^|$)'), '\\*', '.*') AS body FROM written
), cut AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, url,
    translate(CASE WHEN contains(rest, '/') THEN substr(rest, 1, strpos(rest, '/') - 1) ELSE coalesce(rest, '') END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM cut
), ruled AS (
  SELECT *, CASE {" ".join(f"WHEN {c} THEN {text(r)}" for r, _, c in fits)} END AS rule FROM parts
), unwanted AS (
  SELECT DISTINCT url FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL), patterns
  WHERE regexp_matches(lower(url), CASE WHEN in_host THEN '^[^/?#]*://([^/?#]*[^a-z0-9/?#])?' || body ELSE body END, 's')
)
SELECT page_id, host, path, rule,
  CASE {" ".join(f"WHEN rule = {text(r)} THEN {text(v)}" for r, v, _ in fits)}
    WHEN unwanted.url IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN unwanted USING (url)"""
