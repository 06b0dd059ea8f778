"""Personal data found through offset-preserving deobfuscation (operator 4).

Base spans are those of four plain patterns over the text itself. The method adds what is disguised: a chain of
transducers rewrites the text (look-alike and full-width characters to ASCII, invisible characters away, spelled
digits to digits, the marks and entities that stand for ``@`` and ``.`` to these) and keeps, for each character written, the source
characters it stands for. Identifiers are detected in the normal form, and their spans are mapped back.

Every search runs in time linear in the text: candidates are found from their rarest character and no pattern
rescans a run of characters from each of its positions.

Cases: a null text counts as empty; an empty text has no spans and the hash of the empty string; null ids stay
null; repeated rows are searched one by one; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Span = tuple[int, int, str]
KINDS = ("email", "ip", "card", "phone")
_ORDER = {k: i for i, k in enumerate(KINDS)}

SPANS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    free = 0  # where the next match may begin
    at = text.find("@")
    while at >= 0:
        head = text[free:at]
        start = free + len(head.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        free = found.end() if found else at + 1
        if found:
            yield start, free, "email"
        at = text.find("@", free)


def find(text: str) -> list[Span]:
    """The base spans, by start and then kind."""
    spans = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            spans += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _NOT_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append((m.start(), m.end(), "card"))
        if "+" in text:
            spans += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(spans, key=lambda s: (s[0], _ORDER[s[2]]))


# Letters of other scripts that look like these ASCII letters.
_LOOK_ALIKES = {
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "еҽ", "h": "һ", "i": "іıι", "j": "јϳ", "k": "κк", "l": "ӏ", "m": "м", "n": "ո", "o": "оοօ",
    "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "т", "u": "υս", "v": "νѵ", "w": "ԝѡ", "x": "хχ", "y": "уүγ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ",
}
# Characters without a shape of their own.
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Spelled digits.
_SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_NUMBER_WORD = "zero|one|two|three|four|five|six|seven|eight|nine"
#: A run of at least three digits, of which three or more must be spelled; "oh" counts only inside such a run.
_SPELLED_RUN = re.compile(rf"(?i)\b(?:plus[\x20-]{{1,2}})?(?:(?:{_NUMBER_WORD})|[0-9](?=[\x20-]?(?:{_NUMBER_WORD})\b))(?:[\x20,.-]{{0,2}}\b(?:{_NUMBER_WORD}|oh)\b|[\x20-]?[0-9]+){{2,}}")
_SPELLED_TOKEN = re.compile(rf"(?i)plus|{_NUMBER_WORD}|oh|[0-9]+|[^a-z0-9]+")
_HAS_SPELLED = re.compile(rf"(?:{_NUMBER_WORD})[\x20,.-]{{1,2}}(?:{_NUMBER_WORD}|oh|[0-9])")

# Runs with fewer spelled digits: they count only where what they stand for is a card or phone number.
_MIXED_TOKEN = rf"(?:[0-9]++|(?:{_NUMBER_WORD}|oh)(?![^\W\d_]))"
_MIXED_RUN = re.compile(rf"(?i)(?:\+|(?<!\w)plus[\x20-]{{1,2}}|(?<![\w+])){_MIXED_TOKEN}(?:[\x20().-]{{0,2}}{_MIXED_TOKEN})++")
_MIXED_EDIT = re.compile(rf"(?i)plus[\x20-]{{1,2}}|{_NUMBER_WORD}|oh")
_HAS_MIXED = re.compile(rf"[0-9][\x20().-]{{0,2}}(?:{_NUMBER_WORD}|oh)(?![^\W\d_])|(?:plus|{_NUMBER_WORD})[\x20().-]{{0,2}}[0-9]")

# Digits said twice or three times, and addresses of numbers whose dots are spelled.
_TIMES = re.compile(rf"(?i)\b(double|triple)[\x20-](?:({_NUMBER_WORD}|oh)\b|([0-9])(?![0-9]))")
_GROUP = rf"(?:[0-9]{{1,3}}|(?:{_NUMBER_WORD}|oh)\b(?:[\x20-](?:{_NUMBER_WORD}|oh)\b){{0,2}})"
_SPELLED_IP = re.compile(rf"(?i)(?<![\w.]){_GROUP}(?:(?:\x20(?:dot|point)\x20|\x20?\.\x20?){_GROUP}){{3}}(?!\w)")
_IP_TOKEN = re.compile(rf"(?i){_NUMBER_WORD}|oh|\x20?(?:dot|point|\.)\x20?|[0-9]+|[\x20-]")

# Letters and signs that look like digits. They count in a run that has a digit, and only where the run then holds an identifier.
_DIGIT_ALIKES = {"l": "1", "I": "1", "|": "1", "O": "0", "o": "0"}
_GLYPH_RUN = re.compile(r"(?<![^\W_])(?<!\|)\+?[0-9lIOo|](?:[\x20().-]{0,2}[0-9lIOo|])++(?![^\W_])")
_HAS_GLYPH = re.compile(r"[0-9][\x20().-]{0,2}[lIOo|]|[lIOo|][\x20().-]{0,2}[0-9]")

#: What follows an at-sign, with blanks around dots or commas in their place.
_LOOSE_HOST = re.compile(r"(?<=@)[A-Za-z0-9-]{1,63}(?:(?:\x20{1,2}\.\x20{0,2}|\.\x20{0,2}|,\x20?)[A-Za-z0-9-]{1,63}){1,8}")
_LOOSE_DOT = re.compile(r"\x20{0,2}[.,]\x20{0,2}")


def _bracketed(words: str) -> str:
    return rf"[\[({{<]\x20?(?:{words})\x20?[\])}}>]"


# A mark that needs no word beside it: in brackets, or as an entity.
_SURE_AT = rf"(?:{_bracketed('at|@')}|&#0*64;|&#x0*40;|&commat;)"
_SURE_DOT = rf"(?:{_bracketed('dot|[.]')}|&#0*46;|&#x0*2e;|&period;)"
_ANY_DOT = rf"(?:\x20{{0,2}}{_SURE_DOT}\x20{{0,2}}|\x20dot\x20|\.)"
#: A bare " at " stands before a host only.
_HOST_AHEAD = rf"(?=[\w-]{{1,63}}(?:{_ANY_DOT}[\w-]{{1,63}}){{0,8}}{_ANY_DOT}[a-z]{{2}})"
_AT_MARK = re.compile(rf"(?i)\x20{{0,2}}{_SURE_AT}\x20{{0,2}}|\x20at\x20{_HOST_AHEAD}|\x20{{1,2}}@\x20{{0,2}}|@\x20{{1,2}}")
_DOT_MARK = re.compile(rf"(?i)\x20{{0,2}}{_SURE_DOT}\x20{{0,2}}|(?<=[\w-])\x20dot\x20(?=[a-z]{{2}})")
#: Between digits a dot mark needs no address around it.
_DIGIT_DOT_MARK = re.compile(rf"(?i)(?<=[0-9])(?:\x20{{0,2}}{_SURE_DOT}\x20{{0,2}}|\x20dot\x20)(?=[0-9])")
# What any of these needs, in texts in lower case: plain strings first, as most texts have none of them.
_CLOSED = (")", "]", "}", ">", " )", " ]", " }", " >")
_CLOSED_AT = tuple("at" + c for c in _CLOSED)
_OPENED_DOT = tuple(o + "." for o in ("(", "[", "{", "<", "( ", "[ ", "{ ", "< "))
_BARE_AT = re.compile(rf"\x20at\x20(?=[\w-]{{1,63}}{_ANY_DOT})")


def _may_have_at(low: str) -> bool:
    return "@" in low or "&#" in low or "&commat;" in low or any(x in low for x in _CLOSED_AT) or (" at " in low and _BARE_AT.search(low) is not None)


def _may_have_dot(low: str) -> bool:
    return "dot" in low or "&#" in low or "&period;" in low or any(x in low for x in _OPENED_DOT)


@lru_cache(1)
def _alike() -> dict[int, str | None]:
    """The character transducer's table: look-alikes, full-width and styled forms of ASCII, other scripts' digits, invisible characters."""
    table: dict[int, str | None] = {ord(c): to for to, froms in _LOOK_ALIKES.items() for c in froms} | {ord(c): None for c in _INVISIBLE}
    table |= {0x3002: ".", 0xFF61: "."}  # ideographic stops
    for code in (*range(0x0660, 0x3000), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)):
        c = chr(code)
        digit = unicodedata.digit(c, None) if unicodedata.category(c) == "Nd" else None
        plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", c) if code >= 0xFF01 else c
        if plain != c and len(plain) == 1 and plain.isascii():
            table.setdefault(code, plain)
    return table


@lru_cache(1)
def _odd() -> frozenset[str]:
    return frozenset(map(chr, _alike()))


def _has_odd(text: str) -> bool:
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _odd().isdisjoint(text)
    return "\xad" in text


class Mapped:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str, starts: array | None = None, ends: array | None = None) -> None:
        self.text, self.starts, self.ends = text, starts, ends

    def span(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end - 1])

    def rewrite(self, edits: Iterable[tuple[int, int, str]]) -> Mapped:
        """Replace ``[start, end)`` by a text each; whatever replaces a part stands for all of it."""
        text, starts, ends = [], array("q"), array("q")
        at = 0

        def keep(stop: int) -> None:
            text.append(self.text[at:stop])
            starts.extend(range(at, stop) if self.starts is None else self.starts[at:stop])
            ends.extend(range(at + 1, stop + 1) if self.ends is None else self.ends[at:stop])

        for start, end, new in edits:
            keep(start)
            begin, stop = self.span(start, end)
            text.append(new)
            starts.extend([begin] * len(new))
            ends.extend([stop] * len(new))
            at = end
        if not at:
            return self
        keep(len(self.text))
        return Mapped("".join(text), starts, ends)


def _alike_edits(text: str) -> Iterator[tuple[int, int, str]]:
    table = _alike()
    for k, c in enumerate(text):
        if c > "\x7f" and ord(c) in table:
            yield k, k + 1, table[ord(c)] or ""


def _spelled_edits(text: str) -> Iterator[tuple[int, int, str]]:
    """Each spelled digit for itself, so that a part of a run maps to its own words; separators inside a run go."""
    for run in _SPELLED_RUN.finditer(text):
        tokens = list(_SPELLED_TOKEN.finditer(text, run.start(), run.end()))
        if sum(t[0].lower() in _SPELLED for t in tokens) < 3:
            continue
        for t in tokens:
            low = t[0].lower()
            new = "+" if low == "plus" else _SPELLED.get(low, t[0] if low.isdigit() else "")
            if new != t[0]:
                yield t.start(), t.end(), new


def _mixed_edits(text: str) -> Iterator[tuple[int, int, str]]:
    """The spelled digits of a run that without them holds no card or phone number, and with them does; separators stay."""
    for run in _MIXED_RUN.finditer(text):
        edits = [(m.start(), m.end(), _SPELLED.get(m[0].lower(), "+")) for m in _MIXED_EDIT.finditer(run[0])]
        if not edits or any(kind in ("card", "phone") for _, _, kind in find(run[0])):
            continue
        read = Mapped(run[0]).rewrite(edits)
        spans = [read.span(start, end) for start, end, kind in find(read.text) if kind in ("card", "phone")]
        for start, end, new in edits:
            if any(s <= start and end <= e for s, e in spans):
                yield run.start() + start, run.start() + end, new


def _times_edits(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _TIMES.finditer(text):
        yield m.start(), m.end(), (_SPELLED[m[2].lower()] if m[2] else m[3]) * (2 if m[1].lower() == "double" else 3)


def _ip_edits(text: str) -> Iterator[tuple[int, int, str]]:
    """The digits and dots of a spelled address of four numbers."""
    for run in _SPELLED_IP.finditer(text):
        tokens = list(_IP_TOKEN.finditer(text, run.start(), run.end()))
        new = [_SPELLED.get(low, low if low.isdigit() else "." if low.strip(" -") else "") for low in (t[0].lower() for t in tokens)]
        if any(t[0].lower() in _SPELLED for t in tokens) and any(k == "ip" for _, _, k in find("".join(new))):
            yield from ((t.start(), t.end(), n) for t, n in zip(tokens, new, strict=True) if n != t[0])


def _glyph_edits(text: str) -> Iterator[tuple[int, int, str]]:
    """Look-alikes in runs of digits that hold a card, phone number or address with them and none without."""
    for run in _GLYPH_RUN.finditer(text):
        if not _DIGIT.search(run[0]) or any(k != "email" for _, _, k in find(run[0])):
            continue
        read = "".join(_DIGIT_ALIKES.get(c, c) for c in run[0])
        spans = [(x, y) for x, y, k in find(read) if k != "email"] if read != run[0] else []
        for k, c in enumerate(run[0]):
            if c in _DIGIT_ALIKES and any(x <= k < y for x, y in spans):
                yield run.start() + k, run.start() + k + 1, _DIGIT_ALIKES[c]


def _loose_edits(text: str) -> Iterator[tuple[int, int, str]]:
    """Dots with blanks around them, and commas, up to the first well-known ending of a host."""
    for run in _LOOSE_HOST.finditer(text):
        dots = list(_LOOSE_DOT.finditer(text, run.start(), run.end()))
        for k, dot in enumerate(dots):
            label = text[dot.end() : dots[k + 1].start() if k + 1 < len(dots) else run.end()]
            if label in _ENDINGS:
                yield from ((d.start(), d.end(), ".") for d in dots[: k + 1] if d[0] != ".")
            if label.lower() in _ENDINGS or dot[0] == "." and label.lower() in _COUNTRIES:
                break


def _mark_edits(pattern: re.Pattern[str], new: str, text: str) -> Iterator[tuple[int, int, str]]:
    for m in pattern.finditer(text):
        yield m.start(), m.end(), new


def normalise(text: str) -> Mapped:
    """The normal form with its way back; without anything disguised, the text itself."""
    out = Mapped(text)
    if _has_odd(text):
        out = out.rewrite(_alike_edits(out.text))
    low = out.text.lower()
    if "double" in low or "triple" in low:
        out = out.rewrite(_times_edits(out.text))
        low = out.text.lower()
    spelled = sum(map(low.count, _SPELLED))
    if spelled and ("dot" in low or "point" in low or "." in low):
        out = out.rewrite(_ip_edits(out.text))
    if spelled >= 3 and _HAS_SPELLED.search(low):
        out = out.rewrite(_spelled_edits(out.text))
    if (spelled or "plus" in low) and _DIGIT.search(low) and _HAS_MIXED.search(low):
        out = out.rewrite(_mixed_edits(out.text))
    if _DIGIT.search(low) and _HAS_GLYPH.search(out.text):
        out = out.rewrite(_glyph_edits(out.text))
    if _may_have_at(low):
        out = out.rewrite(_mark_edits(_AT_MARK, "@", out.text))
    if "@" in out.text:
        out = out.rewrite(_loose_edits(out.text))
    if _may_have_dot(low):
        out = out.rewrite(_mark_edits(_DIGIT_DOT_MARK, ".", out.text))
        if "@" in out.text:  # no other kind has a dot beside a letter
            out = out.rewrite(_mark_edits(_DOT_MARK, ".", out.text))
    return out


_BARE = re.compile(r"(?i)\x20(?:at|dot)\x20|\x20@|@\x20")
_PLAIN_HOST = re.compile(r"(?i)\x20at\x20[\w.-]+$")
# The endings that tell an address spelled in plain words from prose.
_ENDINGS = frozenset("com net org edu gov mil info biz io dev app uk eu".split())
# Endings of countries; those that are English words too; words that come before a dot in prose.
_COUNTRIES = frozenset(
    """ac ad ae af ag ai al am ao ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz
    de dj dk dm do dz ec ee eg er es et fi fj fk fm fo fr ga gd ge gf gg gh gi gl gm gn gp gq gr gt gu gw gy hk hn hr ht hu id ie il im in iq ir is it je jm jo jp
    ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz
    om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz
    ua ug us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw""".split()
)
_WORD_ENDINGS = frozenset("am as at be by do in is me my no so to us".split())
_BEFORE_DOT = frozenset("the an this that these those each every any one some its his her our your their my another last first next same".split())


# What tells an address from prose where only " at " stands before a host with its own dots: a label or a word of contact right
# before it; a sign in the local part; or that it is set off from what is around it on both sides.
_LABELLED = re.compile(
    r"(?i)(?:[:=]\x20{0,2}|\b(?:e-?mails?|mail(?:to)?|contact|write|reach|send|address|courriel|correo|escrib\w*|écri\w*|schreib\w*|kontakt\w*)(?:\x20(?:to|is|an|a|à))?\x20)$"
)
_SET_OFF = re.compile(r"(?:^|[\n,;(<\[|\"]\x20{0,2})$"), re.compile(r"\x20{0,2}(?:$|[\n,;)>\]|\"])")
# Words after a word of contact that are no names.
_NO_NAMES = frozenset("us me him her them you it we they someone anyone everyone people customers".split())


def _told(text: str, start: int, end: int, local: str) -> bool:
    """Whether there is evidence for an address."""
    if not local.isalpha():
        return True
    before = text[max(0, start - 40) : start]
    if local not in _NO_NAMES and _LABELLED.search(before):
        return True
    if start == 0 and end == len(text):  # nothing that it could be set off from
        return False
    return bool(_SET_OFF[0].search(before) and _SET_OFF[1].match(text, end))


def _likely(kind: str, found: str, text: str, start: int, end: int) -> bool:
    """A disguised address must end in letters, as top domains do, and one whose signs are spelled in bare words, or stand between blanks, as addresses rather than sentences do.

    That is in a well-known ending, or in a country's after labels that are none of ``_BEFORE_DOT``; where the
    country's ending is an English word too, the local part must hold more than letters or the domain a further label.
    A bare " at " before a host with its own dots needs further evidence.
    """
    if kind != "email":
        return True
    local, _, domain = found.lower().rpartition("@")
    *labels, last = domain.split(".")
    if not last.isalpha() or len(last) < 2:
        return False
    source = text[start:end]
    if not _BARE.search(source):
        return True
    if _PLAIN_HOST.search(source) and not _told(text, start, end, local):
        return False
    return last in _ENDINGS or last in _COUNTRIES and _BEFORE_DOT.isdisjoint(labels) and (last not in _WORD_ENDINGS or len(labels) > 1 or not local.isalpha())


def detect(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the base ones with those found in the normal form that lie in none of them."""
    text = text or ""
    base = find(text)
    normal = normalise(text)
    if normal.starts is None:
        return base, base
    added = []
    for start, end, kind in find(normal.text):
        source = normal.span(start, end)
        if not any(s <= source[0] and source[1] <= e for s, e, _ in base) and _likely(kind, normal.text[start:end], text, *source):
            added.append((*source, kind))
    return base, sorted({*base, *added}, key=lambda s: (s[0], _ORDER[s[2]], s[1]))


def shown(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Counts, hash and list of the spans of each document's text (code points, end exclusive).

    ``n_email`` to ``n_phone`` and ``base_sha256`` tell of the base spans, ``spans`` of all, ``n_added`` how many the method adds.
    """

    @F.pandas_udf(SPANS)
    def search(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base, spans = detect(text)
            kinds = [k for _, _, k in base]
            rows.append((*map(kinds.count, KINDS), hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans), len(spans) - len(base)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SPANS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), search(F.col("text").cast("string")).alias("s")).select("doc_id", "s.*")


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; spans that overlap are replaced as one."""
    _, spans = detect(text)
    if not spans:
        return text
    out, at = [], 0
    merged: list[list] = []
    for start, end, kind in spans:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    for start, end, kind in merged:
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def mask_personal_data(text: Column) -> Column:
    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return pd.Series([masked(t) for t in texts], dtype=object)

    return mask(text.cast("string"))
