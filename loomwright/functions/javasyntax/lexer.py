"""Tokens of Java 8 source."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Reserved words and literals, types and modifiers of the language, operators from long to short.
KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import "
    "instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try "
    "void volatile while true false null".split()
)
PRIMITIVES = frozenset("boolean byte char double float int long short".split())
MODIFIERS = frozenset("abstract default final native private protected public static strictfp synchronized transient volatile".split())
# ">>" and longer aren't tokens here: the parser joins ">"s where an expression allows it, so that generics close.
OPERATORS = ("<<=", "...", "->", "::", "++", "--", "&&", "||", "==", "!=", "<=", "+=", "-=", "*=", "/=", "&=", "|=", "^=", "%=", "<<")
SIGNS = "(){}[];,.@=<>!~?:+-*/&|^%"


class JavaError(Exception):
    """The text isn't Java; the message names what was met and where."""


@dataclass(frozen=True, slots=True)
class Token:
    kind: str  # name, word (reserved), literal, sign, end
    text: str
    line: int
    at: int  # place in the text, to tell ">>" from "> >"


_ESCAPE = r"\\(?:[btnfr\"'\\]|[0-3]?[0-7]{1,2}|u+[0-9a-fA-F]{4})"
_DIGITS = r"[0-9](?:[0-9_]*[0-9])?"
_TOKEN = re.compile(
    r"(?P<space>[ \t\f\r\n\x1a]+|//[^\r\n]*|/\*[\s\S]*?\*/)"
    r"|(?P<name>[^\W\d]|\$)"
    rf"|(?P<literal>0[xX](?:[0-9a-fA-F][0-9a-fA-F_]*)?\.?(?:[0-9a-fA-F][0-9a-fA-F_]*)?[pP][+-]?{_DIGITS}[fFdD]?|0[xX][0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?[lL]?|0[bB][01](?:[01_]*[01])?[lL]?"
    rf"|(?:{_DIGITS}\.(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?[fFdD]?|{_DIGITS}(?:[eE][+-]?{_DIGITS}[fFdD]?|[fFdDlL])?"
    rf"|'(?:{_ESCAPE}|[^'\\\r\n])'"
    rf'|"(?:{_ESCAPE}|[^"\\\r\n])*+")'
    r"|(?P<sign>" + "|".join(map(re.escape, (*OPERATORS, *SIGNS))) + ")"
)
_NAME = re.compile(r"[\w$]+")
_UNICODE = re.compile(r"(?<!\\)((?:\\\\)*)\\u+([0-9a-fA-F]{4})")


def tokens(text: str) -> list[Token]:
    """All tokens and an end. Unicode escapes are read first, as the language has it."""
    if "\\u" in text:
        text = _UNICODE.sub(lambda m: m[1] + chr(int(m[2], 16)), text)
    out: list[Token] = []
    at, line = 0, 1
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            what = "unterminated comment" if text.startswith("/*", at) else "unterminated or malformed literal" if text[at] in "\"'" else f"unexpected character {text[at]!r}"
            raise JavaError(f"{what} at line {line}")
        kind, end = m.lastgroup or "", m.end()
        if kind == "name":
            end = _NAME.match(text, at).end()
            word = text[at:end]
            out.append(Token("word" if word in KEYWORDS else "name", word, line, at))
        elif kind == "literal":
            if end < len(text) and (text[end].isalnum() or text[end] in "_$") and m[0][0] not in "\"'":
                raise JavaError(f"malformed number at line {line}")
            out.append(Token(kind, m[0], line, at))
        elif kind == "sign":
            out.append(Token(kind, m[0], line, at))
        line += text.count("\n", at, end)
        at = end
    out.append(Token("end", "", line, at))
    return out
