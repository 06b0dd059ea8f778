"""Syntax check of submissions: one vectorised function over code and language, with a registry by language.

Code is parsed, never run. Spark would evaluate a function inside a conditional for every row, so there is one
function for all languages and rejected rows come in as null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.functions import javasyntax, pysyntax

# Fixed value: the message for code without a checker.
UNSUPPORTED = "Cannot validate syntax: unsupported or undetected language."
VERDICT = "is_valid boolean, error string, failed boolean"

Checker = Callable[[str], str | None]
_CHECKERS: dict[str, Checker] = {"python": pysyntax.check, "java": javasyntax.check}


def register_checker(language: str, checker: Checker) -> None:
    """Add a language, or replace its checker: null for valid code, else the error. It is shipped with the query."""
    _CHECKERS[language] = checker


def verdict(code: str | None, language: str | None, checkers: dict[str, Checker] | None = None) -> tuple[bool | None, str | None, bool]:
    """``is_valid``, ``error`` and whether the checker itself failed. All null and false without code."""
    if code is None:
        return None, None, False
    checker = (_CHECKERS if checkers is None else checkers).get(language or "")
    if checker is None:
        return False, UNSUPPORTED, False
    try:
        error = checker(code)
    except pysyntax.ParserGaveUp:
        return None, None, True
    return error is None, error, False


def validate_syntax(code: Column, language: Column) -> Column:
    """``struct<is_valid, error, failed>``."""
    checkers = dict(_CHECKERS)

    @F.pandas_udf(VERDICT)
    def check(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for codes, languages in batches:
            rows = [verdict(c, lang, checkers) for c, lang in zip(codes, languages, strict=True)]
            yield pd.DataFrame(rows, columns=["is_valid", "error", "failed"]).astype({"is_valid": object})

    return check(code, language)
