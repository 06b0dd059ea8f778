"""Operators that judge rows one by one: packing, personal data, urls, media, quality rules, chat views, mixing."""

from __future__ import annotations

import hashlib
import io
import json
import math
import os
import random
import re
import struct
import time
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import chat_views, media, mixing, packing, pii, quality_rules, url_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, target string, p string"
#: Nulls in every column, empty, blank, long and repeated texts, and columns whose names the operators use themselves.
ODD = [
    (1, "plain words, and more of them.\nA second line.", "en", "a", 44, "x", "y", "z"),
    (1, "plain words, and more of them.\nA second line.", "en", "a", 44, "x", "y", "z"),
    (None, None, None, None, None, None, None, None),
    (2, "", "en", None, 0, None, None, None),
    (3, " \t\n", "en", "b", 3, None, None, None),
    (4, "lang " * 30_000, "en", "b", None, None, None, None),
    (5, "İstanbul ΑΣ naïve 日本語 \x1c x <|endoftext|> \U0001d7d9 ²½", None, "b", None, None, None, None),
    (None, "no id but text " * 9, "fr", "c", None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- packing ---


def test_encoder_equals_tokenizer():
    import public_tokenizers

    encode = packing.Encoder(public_tokenizers.path(packing.TOKENIZER))
    rng = random.Random(4)
    parts = ["word", "Über", "l'été", "don't", "'s", "x1y22", "...", "!?", "ß", "²", "\xa0", "\x85", "\n", "  ", "\x1c", "İ", "é", "<|endoftext|>", "µ", "日本", "a" * 80, "_", "😀", "\0"]
    for _ in range(400):
        text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12)))
        assert encode(text) == encode.whole(text), text


def test_encoder_without_the_faster_library(monkeypatch):
    import public_tokenizers

    encode = packing.Encoder(public_tokenizers.path(packing.TOKENIZER))
    encode.words.merge = None
    for text in ("plain words here, twice here.", "Über l'été", ""):
        assert encode(text) == encode.whole(text)


def test_differencing_is_near_equal_and_within_capacity():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 60, 400):
        sizes = rng.integers(1, 700, n)
        way = packing.pack(sizes, 2048)
        sums = np.bincount(way, sizes)
        assert sums.max() <= 2048 and len(way) == n
        if n >= 60:
            assert sums[sums > 0].sum() >= 0.93 * 2048 * (sums > 0).sum()
    assert len(set(packing.karmarkar_karp(np.array([8, 7, 6, 5, 4]), 2))) == 2


def test_packing_covers_every_id(spark, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = [r.asDict() for r in packing.pack_documents(odd, group=4).collect()]
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for key, text in {(r[0], r[1]) for r in ODD if r[0] not in (None, 1)}:
        ids = [*tok.encode(text, add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[key], key=lambda r: r["start"])
        assert [p["start"] for p in pieces] == list(np.cumsum([0, *[p["length"] for p in pieces]])[:-1])
        assert sum(p["length"] for p in pieces) == len(ids) == pieces[0]["doc_tokens"]
        for p in pieces:
            cut = ids[p["start"] : p["start"] + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(np.array(cut, "<u4").tobytes())
    assert len(by_doc[1]) == 2  # repeated rows are packed once each
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty).count() == 0


# --- personal data ---

E, I, C, P = (re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_spans(t):
    out = [(m.start(), m.end(), "email") for m in E.finditer(t)]
    out += [(m.start(), m.end(), "ip") for m in I.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in (("card", C, 12, 19), ("phone", P, 9, 15)):
        for m in pattern.finditer(t):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == "phone" or pii.luhn(digits)):
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_equal_plain_patterns():
    rng = random.Random(3)
    parts = ["a", "B1", ".", "@", "+", "-", " ", "%", "9", "0", "(", ")", "5", "é", "\n", "4111111111111111", "1.2.3.4", "+1 (555) 123-4567", "x@y.zz"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert brute_spans(text) == pii.find(text), text


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail bob (at) example (dot) com now", [("email", "bob (at) example (dot) com")]),
        ("anna at mail dot example dot org", [("email", "anna at mail dot example dot org")]),
        ("jоhn@exаmple.com", [("email", "jоhn@exаmple.com")]),
        ("plus one five five five one two three four five six seven ok", [("phone", "plus one five five five one two three four five six seven")]),
        ("ip １９２.168.0.1 x", [("ip", "１９２.168.0.1")]),
        ("four" + " one" * 15, [("card", "four" + " one" * 15)]),
        ("look at the dot in it, seven of one", []),
        ("meet @ 5.30 at one two three", []),
        ("café 10.0.0.1", [("ip", "10.0.0.1")]),
    ],
)
def test_disguises_map_back(text, found):
    base, spans = pii.detect(text)
    assert [(k, text[s:e]) for s, e, k in spans] == found
    assert set(base) <= set(spans)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        *((f"write anna at firma dot {end} now", [("email", f"anna at firma dot {end}")]) for end in ("de", "fr", "es", "it", "nl", "DE", "ch")),
        ("anna dot rossi at firma dot be", [("email", "anna dot rossi at firma dot be")]),
        ("look at red dot in the middle", []),
        ("stop at the dot de facto", []),
        ("aim at this dot it says", []),
        ("card 4111 1111 1111 111one ok", [("card", "4111 1111 1111 111one")]),
        ("card 4111 1111 one111 1111 ok", [("card", "4111 1111 one111 1111")]),
        ("card four111-1111-1111-11one1.", [("card", "four111-1111-1111-11one1")]),
        ("call +1 555 123 four five 67 ok", [("phone", "+1 555 123 four five 67")]),
        ("call plus 1 (555) 123 4567 ok", [("phone", "plus 1 (555) 123 4567")]),
        ("call +1 555 123 4567 one more time", [("phone", "+1 555 123 4567")]),
        ("card 4111 1111 1111 1112 or 111one", []),
        ("in 2024 one of 12 was 7 or eight", []),
        ("4111 1111 1111 111oneself", []),
    ],
)
def test_country_endings_and_few_spelled_digits(text, found):
    base, spans = pii.detect(text)
    assert [(k, text[s:e]) for s, e, k in spans] == found
    assert set(base) <= set(spans)


def mark_forms(words):
    """Every bracketed form of a mark, with and without blanks."""
    brackets = [(o, c) for o in "[({<" for c in "])}>"]
    return [f"{out}{o}{left}{w}{right}{c}{out}" for o, c in brackets for w in words for left in ("", " ") for right in ("", " ") for out in ("", " ", "  ")]


#: Disguises by kind: what is planted in a text, each alone.
PLANTED = {
    "email": [
        *(f"bob{a}example{d}com" for a in ("@", "(at)", " [at] ", "{@}", "&#64;", "&#x40;", "&commat;", " at ", " @ ") for d in (".", "[.]", " (dot) ", "&#46;", "&#x2E;", "&period;", " dot ") if (a, d) != ("@", ".")),
        "bob at example.com", "john @ example . com", "john@example . com", "john@example,com", "a@b。com", "anna.k at mail.example.org", "x_1 at firma.de", "b0b AT example.co.uk", "bоb@example.com", "bob＠example．com", "b\u200bob@example.com", "𝐛𝐨𝐛@example.com",
    ],
    "ip": [
        *(d.join(("192", "168", "0", "1")) for d in ("[.]", "(.)", "(dot)", " dot ", " [dot] ", "&#46;", "&period;", "{.}", " DOT ")),
        "10[.]0[.]0[.]1", "10.0.0[.]1", "１９２.168.0.1", "192\u200b.168.0.1", "١٠.0.0.1", "192。168。0。1", "127.O.O.1", "l0.0.0.I", "one nine two dot one six eight dot zero dot one", "ten"[:0] + "10 dot zero dot zero dot one",
    ],
    "card": ["４１１１ 1111 1111 1111", "four one one one" + " one" * 12, "4111 1111 1111 111one", "4111\u200b1111 1111 1111", "4111-1111-1111-111One", "4111 1111 1111 l111", "4lll llll llll llll", "4III-IIII-IIII-IIII"],
    "phone": ["plus one five five five one two three four five six seven", "+1 555 123 four five 67", "＋1 555 123 4567", "+1 555 l23 4O67", "plus one double five five one two three four five six seven", "plus 49 30 1234567"],
}
#: Prose that holds nothing of the kind.
CLEAN = [
    "see @ foo.bar now", "meet @ noon.then go", "look at example.com for more", "we met at noon. then we left", "find us at www.example.org today", "visit the shop at example.de", "more at example.com/page",
    "at 5.30 it rains", "at last. The end", "it stood at the dot on the map", "he scored one two three times", "five of nine, three to one", "chapter 3 [.] page 4", "(.) and [dot] alone",
    "a dot com company", "the dot matrix at work", "R&D &amp; more", "1 dot 2 dot 3", "twelve at the table. all of them", "prices @ 3.50 each", "I am at home.", "arrive at one", "&#64; alone",
]


@pytest.mark.parametrize("kind", pii.KINDS)
def test_disguises_of_each_kind(kind):
    """All planted ones are found at their place, wherever they stand, and nothing else; no text without any has a span."""
    for planted in PLANTED[kind]:
        for before, after in (("", ""), ("Write to ", " today."), ("Grüße 日本: ", "\nnext line"), ("x, ", ", y@ z")):
            if planted == "bob at example.com" and not before:
                continue  # as a text by itself it may as well be prose
            text = before + planted + after
            base, spans = pii.detect(text)
            start = len(before)
            assert (start, start + len(planted), kind) in spans, text
            assert all(start <= s and e <= start + len(planted) for s, e, _ in spans), text  # a base span may lie in it
            assert set(base) <= set(spans)
            # Text around it that has nothing to do with it changes nothing.
            beside = "a@b or see (dot); " + text
            assert (kind, planted) in [(k, beside[s:e]) for s, e, k in pii.detect(beside)[1]]


def test_clean_prose_has_no_spans():
    for text in (*CLEAN, " ".join(CLEAN)):
        assert pii.detect(text)[1] == [], text


def test_words_at_hosts_are_prose():
    """Of a thousand sentences with a word, " at " and a host hardly one has a span."""
    rng = random.Random(3)
    subjects = "customers people dinner lunch staff she he they everyone lives works stays meets books prices deals news shops friends guests".split()
    hosts = "ikea.com mario.it paris.fr shop.example.org hotel.de my.news.co.uk cafe.es store.net".split()
    frames = ["The {s} at {h} love it.", "We had {s} at {h} tonight", "{s} at {h} last week, and again", "On Monday {s} at {h} said so.", "It was good, {s} at {h} told us.", "contact us at {h} now", "{s} at {h}"]
    found = [t for t in (rng.choice(frames).format(s=rng.choice(subjects), h=rng.choice(hosts)) for _ in range(1000)) if pii.detect(t)[1]]
    assert len(found) < 10, found[:5]
    for text in ("contact: ann at ikea.com today", "mail ann at ikea.com", "ann.b at ikea.com is mine", "Staff:\nann at ikea.com\nbob at ikea.com", "she (ann at ikea.com) left"):
        assert len(pii.detect(text)[1]) >= 1, text


def test_every_form_of_a_mark_is_found_alone():
    ats = [*mark_forms(("at", "AT", "@")), "&#64;", "&commat;", " &COMMAT; ", " @", "  @", "@ ", " @ ", "@  "]
    dots = [*mark_forms(("dot", "Dot", ".")), " dot ", " DOT "]
    addresses = [f"john{a}example.com" for a in ats] + [f"john@example{d}com" for d in dots]
    addresses += [f"john{a}example{d}com" for a in ("(at)", " at ", " @ ") for d in dots]
    for address in addresses:
        assert [(k, f"mail {address} now"[s:e]) for s, e, k in pii.detect(f"mail {address} now")[1]] == [("email", address)], address


def test_prefilter_of_marks_loses_nothing(monkeypatch):
    rng = random.Random(12)
    parts = ["joe", " at ", "at", "@", " ", "(", "[", "{", "<", ")", "]", "}", ">", ".", "dot", " dot ", " DOT ", "com", "&#64;", "&#X2E;", "&period;", "x", "org", "10", "7", "İ", " AT "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    quick = [pii.detect(t) for t in texts]
    monkeypatch.setattr(pii, "_may_have_at", lambda low: True)
    monkeypatch.setattr(pii, "_may_have_dot", lambda low: True)
    for text, found in zip(texts, quick, strict=True):
        assert pii.detect(text) == found, text


def test_spans_of_random_disguises_lie_in_the_text():
    rng = random.Random(8)
    parts = ["one ", "two-", "nine", "oh ", " at ", "(at)", " dot ", "[dot]", "a", "а", "​", "@", ".", "com", "１", "4", " ", "plus "]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        base, spans = pii.detect(text)
        assert set(base) <= set(spans) and all(0 <= s < e <= len(text) for s, e, _ in spans)
        assert pii.masked(text) == text or spans


def test_long_runs_are_linear():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "+1" + " " * 300_000, "1." * 150_000, "one " * 80_000, "@" * 100_000):
        pii.detect(text)


def test_personal_data_query(odd, empty):
    rows = pii.find_personal_data(odd).collect()
    assert len(rows) == len(ODD) and {r["base_sha256"] for r in rows if r["doc_id"] in (2, 3)} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find_personal_data(empty).count() == 0


# --- urls ---


def brute_verdict(url, patterns=url_rules.PATTERNS, addresses=url_rules.ADDRESSES):
    host = path = ""
    if url and "://" in url:
        rest = re.split("[?#]", url.split("://", 1)[1])[0]
        host, slash, tail = rest.partition("/")
        host, path = "".join(c.lower() if c.isascii() else c for c in host), slash + tail
    fits = [(len(r), v, r) for v, r in addresses if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    if fits:
        _, verdict, rule = max(fits)  # "block" comes after "allow"
        return host, path, rule, verdict
    low = "".join(c.lower() if c.isascii() else c for c in url or "")
    return host, path, None, "block" if url is not None and any(fits_pattern(p, low) for p in patterns) else "allow"


def fits_pattern(pattern, url):
    """Whether the pattern fits somewhere in the url: sign by sign, without regular expressions."""
    plain = set("abcdefghijklmnopqrstuvwxyz0123456789")

    def ends(body, starts):
        """Where the url may stand after the body, from any of the places."""
        at = set(starts)
        for c in body:
            if c == "*":
                at = set(range(min(at), len(url) + 1)) if at else at
            elif c == "^":
                at = {k + 1 for k in at if k < len(url) and url[k] not in plain} | {k for k in at if k in (0, len(url))}
            else:
                at = {k + 1 for k in at if k < len(url) and url[k] == c}
        return at

    starts = set(range(len(url) + 1))
    if pattern.startswith("||"):
        pattern = pattern[2:]
        head = url.find("://")
        if head < 0 or any(c in "/?#" for c in url[:head]):
            return False
        stop = min([k for k in range(head + 3, len(url)) if url[k] in "/?#"] + [len(url)])
        starts = {head + 3} | {k for k in range(head + 4, stop + 1) if url[k - 1] not in plain}
    return bool(ends(pattern, starts))


def odd_urls(rng, n):
    words = ["http", "://", "example", ".", "org", "com", "net", "/", "es", "en", "1", "fr", "de", "?", "#", "-", "casino", "bonus", "pills", "bets", "payday", "loans", "porn", "video", "xxx", "adult", "warez", "crack", "Cheap", "download", "viagra", "é", ":", "@", "Spam-Farm", "x", "wp-login.php", "PHPSESSID", "=", ".exe", "^", "*", "||", "|"]
    made = ["".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(n // 2)]
    made += [f"http{rng.choice(['', 's'])}://" + "".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(n // 2)]
    return made + [None, "", "http://ORG/", "https://a.example.org/en/1?x", "https://example.org/es/", "https://notorg/", "ftp://user@com/fr/", "http://com/Fr/", "http://x/?a=b" + "/long" * 40_000, "http://casino.x", "http://mycasino.x/", "http://x/casino/", "http://x-casino-y.com"]


@pytest.mark.parametrize("patterns", [url_rules.PATTERNS, ("a*b", "^1^", "||es^", "||*pills", "^x^*^x^", "||e", "=*^1", "-farm")])
def test_index_finds_what_trying_every_rule_finds(spark, patterns):
    urls = odd_urls(random.Random(6), 3000)
    rules = [*(url_rules.address_rule(*a) for a in url_rules.ADDRESSES), *map(url_rules.pattern_rule, patterns)]
    df = spark.createDataFrame([(None if i % 50 == 7 else i, u, "h", "r") for i, u in enumerate(urls)] + [(1, urls[1], "h", "r")], "page_id long, url string, host string, rule string")
    got = url_rules.judge_urls(df, rules).collect()
    assert len(got) == len(urls) + 1 and sum(r["page_id"] is None for r in got) == sum(i % 50 == 7 for i in range(len(urls)))
    for r in got:
        if r["page_id"] is not None:
            url = urls[r["page_id"]]
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_verdict(url, patterns), (url or "")[:200]
    assert sum(r["n_candidates"] for r in got) < len(rules) * len(urls)
    assert url_rules.judge_urls(df.limit(0)).count() == 0


def test_a_hundred_thousand_rules_from_a_table(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30_000)]
    texts = {("block", f"{rng.choice(['||', '^'])}{rng.choice(words)}^{rng.choice(['', '*^' + rng.choice(words) + '^', rng.choice(words) + '='])}") for _ in range(70_000)}
    texts |= {(rng.choice(["allow", "block"]), f"{rng.choice(words)}.example/{rng.choice(['', 'a/', rng.choice(words) + '/'])}") for _ in range(40_000)}
    # A text with both verdicts blocks.
    table = spark.createDataFrame([*texts, ("block", None), (None, "x^"), ("maybe", "y^")], "verdict string, rule string")
    rules = url_rules.rules_from_table(table)
    assert len(rules) == len(texts) > 100_000
    urls = [f"http://{rng.choice(words)}.{rng.choice(['example', rng.choice(words)])}/{rng.choice(['', 'a/b', rng.choice(words) + '/?' + rng.choice(words) + '=1'])}" for _ in range(2000)]
    got = {r["page_id"]: r for r in url_rules.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert np.mean([r["n_candidates"] for r in got.values()]) < 30
    addresses = [(v, t) for v, t in texts if "/" in t]
    patterns = [t for _, t in texts if "/" not in t]
    for k in range(0, 2000, 100):
        assert (got[k]["rule"], got[k]["verdict"]) == brute_verdict(urls[k], patterns, addresses)[2:], urls[k]
    assert len({r["verdict"] for r in got.values()}) == 2
    with pytest.raises(ValueError, match="patterns only block"):
        url_rules.rules_from_table(spark.createDataFrame([("allow", "x^")], "verdict string, rule string"))


# --- media ---


def test_media_round_trip(spark, odd, empty, tmp_path):
    path = str(tmp_path / "archives")
    rows = media.store_and_describe(odd, path).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        texts = [t or "" for k, t, *_ in ODD if k == r["doc_id"]]
        data = [t.encode() for t in texts]
        payloads = [b + bytes(-len(b) % 64 if b else 64) for b in data]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) in [(len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for b, p in zip(data, payloads, strict=True)]
    assert media.store_and_describe(empty, str(tmp_path / "none")).count() == 0
    # The same members in byte ranges far smaller than an archive, each in exactly one.
    ranged = spark.read.format(media.FORMAT).option("range_mb", 1).load(path)
    assert ranged.select("origin").distinct().count() == len(ODD)
    reader = media._Reader({"path": path})
    reader.range, reader.batch = 300, 200
    parts = reader.partitions()
    assert len(parts) > 3 and sum(b.num_rows for p in parts for b in reader.read(p)) == len(ODD)


def stored(path):
    """The archives that a manifest names, and their members' bytes by key, through the standard library."""
    names = [n for n, _ in json.loads((path / media.MANIFEST).read_text())]
    found = {}
    for name in names:
        with zipfile.ZipFile(path / name) as z:
            found |= {int(i.filename.split("_")[1]): z.read(i) for i in z.infolist()}
    return names, found


def plain_decode(png):
    """Rows of samples of an 8-bit grey image: every filter type of the format, byte by byte."""
    at, data, head = 8, b"", None
    while at < len(png):
        (size,) = struct.unpack(">I", png[at : at + 4])
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        head, data = (struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head), data + (body if kind == b"IDAT" else b"")
        at += 12 + size
    width, height, depth, colour, *_ = head
    assert (depth, colour) == (8, 0)
    raw, rows = zlib.decompress(data), []
    for y in range(height):
        line = raw[y * (width + 1) : (y + 1) * (width + 1)]
        row = []
        for x, v in enumerate(line[1:]):
            left, up = (row[x - 1] if x else 0), (rows[-1][x] if rows else 0)
            corner = rows[-1][x - 1] if rows and x else 0
            paeth = min((left, up, corner), key=lambda p: abs(left + up - corner - p))
            row.append((v + (0, left, up, (left + up) // 2, paeth)[line[0]]) % 256)
        rows.append(row)
    return rows


def test_stored_form_and_features_by_an_independent_reader(spark, tmp_path):
    rng = random.Random(4)
    texts = {k: "".join(rng.choice("abc é日\n") for _ in range(rng.randint(0, 900))) for k in range(30)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r for r in media.store_and_describe(df, str(tmp_path)).collect()}
    _, members = stored(tmp_path)
    assert set(members) == set(got) == set(texts)
    for k, png in members.items():
        rows = plain_decode(png)
        flat = [v for row in rows for v in row]
        data = texts[k].encode()
        assert bytes(flat) == data + bytes(len(flat) - len(data)) and len(flat) % 64 == 0 and 0 < len(flat) < len(data) + 65
        r = got[k]
        assert (r["media_bytes"], r["media_sha256"], r["error"]) == (len(png), hashlib.sha256(png).hexdigest(), None)
        n, mean = len(flat), sum(flat) / len(flat)
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(flat).values())
        std = math.sqrt(sum((v - mean) ** 2 for v in flat) / n)
        shape, found_mean, found_std, found_entropy, bands = (x.split("=")[-1] for x in r["feature"].split(";"))
        assert shape == f"{len(rows)}x64" and len(bands) == 8
        assert [float(x) for x in (found_mean, found_std, found_entropy)] == pytest.approx([mean, std, entropy], abs=1e-4)


def test_damaged_members_cost_only_themselves(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(media, "WAIT", 0.001)
    df = spark.createDataFrame([(k, f"text {k} " * 50) for k in range(40)], "doc_id long, text string").repartition(4)
    media.write_archives(df.select(F.col("doc_id").alias("key"), F.col("text").cast("binary").alias("payload")), str(tmp_path))
    names, members = stored(tmp_path)
    assert len(names) == 4
    with zipfile.ZipFile(tmp_path / names[0]) as z:  # a byte within one member's data is turned
        hurt = z.infolist()[2]
    raw = bytearray((tmp_path / names[0]).read_bytes())
    raw[hurt.header_offset + 30 + len(hurt.filename) + 20] ^= 255
    (tmp_path / names[0]).write_bytes(raw)
    with zipfile.ZipFile(tmp_path / names[1]) as z:
        cut = {int(i.filename.split("_")[1]) for i in z.infolist()}
    (tmp_path / names[1]).write_bytes((tmp_path / names[1]).read_bytes()[:-400])  # the directory is cut off
    rows = media.media_features(media.read_archives(spark, str(tmp_path))).collect()
    bad = [r for r in rows if r["error"]]
    assert {(r["doc_id"], r["n_bytes"] is None, r["media_sha256"]) for r in bad} == {(int(hurt.filename.split("_")[1]), False, None), (None, True, None)}
    assert all("damaged" in r["error"] or names[1] in r["error"] for r in bad)
    good = {r["doc_id"]: r["media_sha256"] for r in rows if not r["error"]}
    assert set(good) == set(members) - cut - {int(hurt.filename.split("_")[1])}
    assert all(hashlib.sha256(members[k]).hexdigest() == v for k, v in good.items())


class Flaky:
    """A file system whose first handles on a file are cut short or fail."""

    def __init__(self, files, bad):
        self.files, self.bad, self.opens = files, bad, 0

    def __getattr__(self, name):
        return getattr(self.files, name)

    def open_input_file(self, path):
        self.opens += 1
        if self.opens <= self.bad:
            if self.opens % 2:
                raise OSError("the store is away")
            return io.BytesIO(self.files.open_input_file(path).read()[:100])
        return self.files.open_input_file(path)


def test_an_archive_is_opened_again(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(k, f"text {k} " * 50) for k in range(10)], "doc_id long, text string").repartition(1)
    media.write_archives(df.select(F.col("doc_id").alias("key"), F.col("text").cast("binary").alias("payload")), str(tmp_path))
    monkeypatch.setattr(time, "sleep", lambda s: None)
    whole = media.filesystem
    for bad, lost in ((3, 0), (99, 1)):
        flaky = Flaky(whole(str(tmp_path))[0], bad)
        monkeypatch.setattr(media, "filesystem", lambda uri, flaky=flaky: (flaky, whole(uri)[1]))
        reader = media._Reader({"path": str(tmp_path)})
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert sum(r["error"] is not None for r in rows) == lost and len(rows) == (1 if lost else 10)
        assert flaky.opens >= (media.ATTEMPTS if lost else bad + 1)


def test_reads_are_tried_again():
    calls, again = [], []

    def read():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("gone")
        return b"x"

    assert media.retried(read, wait=0.001, again=lambda: again.append(1)) == b"x" and (len(calls), len(again)) == (3, 2)
    with pytest.raises(ValueError, match="damaged"):
        media.decode_png(media.encode_png(bytes(64))[:-20] + b"\0" * 20)


# --- quality rules ---


def brute_counts(text):
    w = WORD.findall(text or "")
    windows: dict = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(spark, odd):
    rng = random.Random(9)
    phrase = "one two three four five six seven eight nine ten".split()
    texts = [" ".join(rng.choice([" ".join(phrase), rng.choice("abcdefg"), "\n", "x|y", " z", "repeat " * 3]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(odd.where("doc_id > 1").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    expected = dict(enumerate(texts)) | {k + 1000: t for k, t, *_ in ODD if k and k > 1}
    rows = quality_rules.judge(df).collect()
    assert len(rows) == len(expected)
    for r in rows:
        n, chars, symbols, lines, repeated = brute_counts(expected[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeated)
        assert r["base_failed"] == (n < 20 or 100 * repeated > 30 * n) and not (r["kept"] and r["base_failed"])


def test_estimates_find_a_known_model(spark):
    """Votes drawn from a model, at the parameters in use: both accuracies of each rule are found, and that of a rule that tells nothing."""
    rng = random.Random(1)
    right = {"a": (0.97, 0.9), "b": (0.9, 0.95), "c": (0.99, 0.6), "d": (0.95, 0.05), "e": (0.6, 0.9)}  # votes for the good, against the bad
    rows = []
    for _ in range(6000):
        good = rng.random() < 0.85
        rows.append((good, *[(1 if (rng.random() < g if good else rng.random() >= b) else -1) if rng.random() < 0.8 else 0 for g, b in right.values()]))
    found = quality_rules.estimate(spark.createDataFrame(rows, "good boolean, a int, b int, c int, d int, e int"), list(right))
    assert abs(found["prior"] - 0.85) < 0.03
    for r, (g, b) in right.items():
        assert abs(found[f"for_{r}"] - g) < 0.03 and abs(found[f"against_{r}"] - b) < 0.06, (r, found)


def brute_estimates(patterns, rounds=quality_rules.ROUNDS):
    """The maximisation in plain numbers, from rows of votes."""
    q = [quality_rules.START[min(2, sum(v < 0 for v in p))] for p in patterns]
    mean = lambda agreed, seen, share: (agreed + quality_rules.BELIEF * share) / (seen + quality_rules.BELIEF)
    for r in range(rounds):
        if r:
            odds = [math.log(prior / (1 - prior)) + sum(math.log(g / (1 - b)) if v > 0 else math.log((1 - g) / b) for v, g, b in zip(p, good, bad, strict=True) if v) for p in patterns]
            q = [1 / (1 + math.exp(-x)) for x in odds]
        prior = mean(sum(q), len(q), quality_rules.PRIOR)
        each = range(len(quality_rules.RULES))
        good = [mean(sum(x for p, x in zip(patterns, q, strict=True) if p[k] > 0), sum(x for p, x in zip(patterns, q, strict=True) if p[k]), quality_rules.RIGHT) for k in each]
        bad = [mean(sum(1 - x for p, x in zip(patterns, q, strict=True) if p[k] < 0), sum(1 - x for p, x in zip(patterns, q, strict=True) if p[k]), quality_rules.RIGHT) for k in each]
    return {"prior": prior} | {f"{side}_{r}": x for side, xs in (("for", good), ("against", bad)) for r, x in zip(quality_rules.RULES, xs, strict=True)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="tables aren't here")
def test_every_rule_votes_and_junk_goes(spark):
    """On the tables: every rule votes, estimates equal plain numbers, labelled junk goes and good texts stay."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    voted = quality_rules.materialise(quality_rules.measure(docs).withColumns(quality_rules.votes()), "votes").where(~quality_rules.base_failed())
    found = quality_rules.estimate(voted, list(quality_rules.RULES))
    patterns = [tuple(r) for r in voted.select(*quality_rules.RULES).collect()]
    assert found == pytest.approx(brute_estimates(patterns), abs=1e-9)
    assert all(sum(abs(p[k]) for p in patterns) > 0.5 * len(patterns) for k in range(len(quality_rules.RULES)))
    assert sum(any(p[k] < 0 for p in patterns) for k in range(len(quality_rules.RULES))) >= 8
    rows = {(r["label"], r["kept"]): r["n"] for r in quality_rules.judge(docs).join(labels, "doc_id").where("not base_failed").groupBy("label", "kept").agg(F.count("*").alias("n")).collect()}
    assert rows[0, False] > 0.95 * (rows[0, False] + rows[0, True]) and rows.get((1, False), 0) < 0.005 * rows[1, True]


def test_rules_without_rows(empty, odd):
    assert quality_rules.judge(empty).count() == 0
    assert quality_rules.judge(odd).where("n_words = 0 and kept").count() == 0


def test_rules_plan_is_native(odd):
    plan = quality_rules.judge(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# --- chat views ---


def test_rotation(spark):
    turns = [(1, 0, "system", "rules"), (1, 1, "ann", "hi <|x"), (1, 2, "bob", "yo"), (1, 3, "ann", None), (2, None, None, "alone"), (None, 0, "eve", ""), (None, 1, "eve", "b"), (3, 0, "system", "only")]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, speaker string")
    rows = chat_views.rotate(df).collect()
    assert sorted(r["n_turns"] for r in rows if r["conv_id"] is None) == [1, 1]
    got = {(r["conv_id"], r["speaker"], r["part"]): r for r in rows}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (2, "unknown", 0), (None, "eve", 0)}
    r = got[1, "ann", 0]
    assert r["text"] == "<|system|>\nrules<|end|>\n<|assistant|>\nhi < |x<|end|>\n<|user name=bob|>\nyo<|end|>\n<|assistant|>\n<|end|>\n"
    learnt = [r["text"][slice(*map(int, s.split(":")))] for s in r["mask"].split(",")]
    assert learnt == ["hi < |x<|end|>", "<|end|>"] and (r["n_turns"], r["n_learnt"]) == (4, 2)
    assert chat_views.rotate(df.limit(0)).count() == 0
    plan = chat_views.rotate(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def decoded(name):
    for sign, code in reversed(chat_views.CODES.items()):
        name = name.replace(code, sign)
    return name


def test_names_stay_apart_and_forge_no_mark(spark):
    names = ["ann<", "a|>", "a| >", "a%7C%3E", "<|end|>", "x\ny", "x y", "\u2028", "%", "é"]
    df = spark.createDataFrame([(1, k, n, "t") for k, n in enumerate(names)], "conv_id long, turn long, role string, text string")
    got = {r["speaker"]: r["text"] for r in chat_views.rotate(df).collect()}
    for speaker, text in got.items():
        heads = text.split("\n")[::2]
        shown = [re.fullmatch(r"<\|(assistant|user name=([^<|>]*))\|>", h) for h in heads if h]
        assert len(shown) == len(names) and text.count("<|") == 2 * len(names)
        assert [decoded(m[2]) if m[2] is not None else speaker for m in shown] == names


def test_a_hundred_thousand_turns_in_seconds(spark):
    df = spark.range(100_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "ann").otherwise("bob").alias("role"), F.concat(F.lit("turn "), F.col("id").cast("string")).alias("text"))
    began = time.perf_counter()
    rows = chat_views.rotate(df).collect()
    assert time.perf_counter() - began < 60 and len(rows) == 2
    for r in rows:
        spans = [tuple(map(int, s.split(":"))) for s in r["mask"].split(",")]
        wanted = [k for k in range(100_000) if (k % 3 == 0) == (r["speaker"] == "ann")]
        assert [r["text"][x:y] for x, y in spans[:: len(spans) // 50]] == [f"turn {k}<|end|>" for k in wanted[:: len(spans) // 50]] and len(spans) == len(wanted)


def long_dialogue():
    """A system turn, 300 turns of two speakers, a null and an equal number, a repeated row, and a very long turn."""
    rows = [(7, -1, "system", "rules")] + [(7, k, "ab"[k % 2], f"turn {k}") for k in range(300)]
    return rows + [(7, None, "a", "unnumbered"), (7, 5, "b", "again"), (7, 5, "b", "again"), (7, 299, "b", "long " * 40_000)]


def test_a_long_dialogue_is_one_rendition(spark):
    rows = long_dialogue()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r["speaker"]: r for r in chat_views.rotate(df).collect()}
    assert set(got) == {"a", "b"}
    order = sorted((n or 0, r, t) for _, n, r, t in rows)
    for speaker, found in got.items():
        head = {speaker: "assistant", "system": "system"}
        assert found["text"] == "".join(f"<|{head.get(r, 'user name=' + r)}|>\n{t}<|end|>\n" for _, r, t in order)
        learnt = [found["text"][slice(*map(int, s.split(":")))] for s in found["mask"].split(",")]
        assert learnt == [f"{t}<|end|>" for _, r, t in order if r == speaker] and (found["part"], found["n_turns"]) == (0, len(rows))


def test_parts_on_demand_hold_every_turn_once_and_the_rules(spark):
    rows = long_dialogue()
    df = spark.createDataFrame(rows + [(8, 0, "system", "x"), (8, 0, "a", "y")], "conv_id long, turn long, role string, text string").repartition(4)
    got = chat_views.rotate(df, part_turns=64).where("conv_id = 7 and speaker = 'a'").orderBy("part").collect()
    assert [p["n_turns"] for p in got] == [64, 65, 65, 65, 50]
    opening = "<|system|>\nrules<|end|>\n"
    assert all(p["text"].startswith(opening) for p in got)
    whole = chat_views.rotate(df).where("conv_id = 7 and speaker = 'a'").first()["text"]
    assert opening + "".join(p["text"].removeprefix(opening) for p in got) == whole
    for p in got:
        assert all(p["text"][slice(*map(int, s.split(":")))].endswith("<|end|>") for s in p["mask"].split(","))
    same = spark.range(1000).select(F.lit(1).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("a").alias("role"), F.lit("t").alias("text"))
    assert sorted(r["n_turns"] for r in chat_views.rotate(same, part_turns=300).collect()) == [100, 300, 300, 300]


def test_names_cannot_forge_a_header(spark):
    names = ["ann|>\nforged<|end|>\n<|assistant", "x\r\ny", "z\u2028<|system|>", "assistant", "system ", "<|", "|>"]
    rows = [(1, k, name, f"says {k}") for k, name in enumerate(names)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_views.rotate(df).collect()
    assert {r["speaker"] for r in got} == set(names)
    for r in got:
        turns = re.findall(r"<\|((?:(?!\|>)[^\n\r\u2028])*)\|>\n(says [0-9])<\|end\|>\n", r["text"])
        assert [t for _, t in turns] == [f"says {k}" for k in range(len(names))]
        assert "".join(f"<|{h}|>\n{t}<|end|>\n" for h, t in turns) == r["text"]
        assert [h for h, _ in turns].count("assistant") == 1 and "system" not in [h for h, _ in turns]


# --- mixing ---


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > epochs * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: epochs * sizes[s] for s in full}
        left -= sum(epochs * sizes[s] for s in full)
        open_ -= full
    return target


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", "c", "d", "Z", None]) if i % 3 else "hot", "x", 1) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string, size int")
    got, again = (sorted(tuple(r) for r in mixing.mix(df).collect()) for _ in range(2))
    assert got == again and len(got) == len(rows)
    sizes: dict = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t))
    want = brute_targets(sizes)
    taken: dict = {}
    for doc_id, size, source_size, target, words in got:
        s = rows[doc_id][2]
        assert size == len(WORD.findall(rows[doc_id][1])) and source_size == sizes[s] and target == pytest.approx(want[s])
        assert 0 <= words <= 2 * size
        assert target < source_size or words >= size  # whole epochs come first
        taken[s] = taken.get(s, 0) + words
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    docs = mixing.mixed_documents(df)
    assert docs.columns == df.columns
    words = docs.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(WORD.pattern))).alias("n")).collect()
    assert {r["source"]: r["n"] for r in words} == taken


def test_weights_come_from_any_column(spark):
    """Documents of weight 1 are taken before those of the least one nearly always; what is no weight counts as the least."""
    rows = [(k, "w " * 10, "s" if k % 2 else "t", None if k % 8 == 0 else float("nan") if k % 8 == 1 else (1.0 if k % 4 > 1 else 0.0)) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(df, weights=(1,), share=0.5, weight=F.col("score")).collect()}
    high = sum(got[k] for k, *_, w in rows if w == 1.0)
    low = sum(got[k] for k, *_, w in rows if w != 1.0)
    assert high > 8 * low and abs(high + low - 10_000) <= 2
    plain = {r["doc_id"]: r["taken"] for r in mixing.mix(df, weights=(1,), share=0.5).collect()}
    assert abs(sum(plain[k] for k, *_, w in rows if w == 1.0) - 5000) < 700
    docs = mixing.mixed_documents(df, weights=(1,), share=0.5, weight=F.col("score"))
    assert docs.columns == df.columns and docs.where("score = 1").count() > 8 * docs.where("score <> 1 OR score IS NULL").count()


def brute_mix(rows, uniform, weights=(5, 2, 1), share=1.5, epochs=2.0):
    """Words taken of each row (id, text, source, hash), source by source in the order of the keys."""
    sizes: dict = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = brute_targets(sizes, weights, share, epochs)
    out = []
    for source, size in sizes.items():
        times = int(want[source] // size) if size else 0
        left = math.floor(want[source] - times * size + 0.5)

        def key(k, source=source):
            _, t, _, own = rows[k]
            signs = sum(c in "#*$%&|<>!" for c in t or "")
            return -math.log(uniform[k]) / max(0.05, 1 - 4 * signs / max(1, len(t or ""))), own

        for k in sorted((k for k, r in enumerate(rows) if r[2] == source), key=key):
            n = len(WORD.findall(rows[k][1] or ""))
            out.append((rows[k][0], n, times * n + min(n, left)))
            left -= min(n, left)
    return sorted(out, key=str)


@pytest.mark.parametrize(("edge", "symbols", "copies"), [(1000, 0.3, 0), (5, 0.3, 0), (5, 1.0, 0), (5, 0.5, 400), (1, 0.0, 400)])
def test_the_order_of_taking_is_that_of_the_keys(spark, monkeypatch, edge, symbols, copies):
    """Row by row as by brute force, documents of the least weight and many equal rows included."""
    monkeypatch.setattr(mixing, "EDGE", edge)
    monkeypatch.setattr(mixing, "COPIES", 50)
    rng = random.Random(edge)
    texts = [" ".join(rng.choice(["####", "$%&"] if rng.random() < symbols else ["word", "two"]) for _ in range(rng.randint(1, 9))) for _ in range(900)]
    rows = [(i, t, "low" if i % 2 else rng.choice(["b", "c", None]), -1, "y") for i, t in enumerate(texts)] + [(None, "the same row again", "low", -1, "y")] * copies
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix_size long, _mix_taken string").repartition(5)
    keys = {(r["id"], r["source"]): (r["own"], r["u"], r["key"]) for r in df.select(*[c.alias(n) for n, c in mixing.key_columns().items()]).withColumn("u", mixing.uniform(F.col("own"))).collect()}
    assert len({k for _, _, k in keys.values()}) == len(keys)  # no ties among different rows
    plain = [(i, t, s, keys[i, s][0]) for i, t, s, *_ in rows]
    for share in (1.5, 0.45, 1.0):
        got = sorted(((r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(df, share=share).collect()), key=str)
        assert got == brute_mix(plain, [keys[i, s][1] for i, _, s, _ in plain], share=share)
        documents = mixing.mixed_documents(df, share=share)
        assert documents.columns == df.columns and documents.where("_mix_size != -1 or _mix_taken != 'y'").isEmpty()
        assert documents.agg(F.sum(F.regexp_count("text", F.lit(WORD.pattern)))).first()[0] == sum(n for _, _, n in got)


def test_many_sources(spark):
    names = [f"host{k}" for k in range(700)]
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 9), rng.choice(names)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    narrow = mixing._narrow(df)
    got = {r["source"]: r["target"] for r in mixing.targets(narrow).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_texts_of_a_mix_are_not_moved(spark):
    plan = mixing.mixed_documents(spark.createDataFrame(list(dict.fromkeys(ODD)), SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan and "Sort" not in plan


def test_better_documents_come_first(spark):
    rows = [(i, ("good words here " * 5) if i % 2 else ("#### $$$$ %%%% " * 5), "a" if i < 1000 else "b") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, weights=(1,), share=0.4).collect()
    good, bad = (sum(r["taken"] for r in got if r["doc_id"] % 2 == k) for k in (1, 0))
    assert good > 3 * bad


def test_mix_of_odd_rows(odd, empty):
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns and mixing.mixed_documents(empty).count() == 0
