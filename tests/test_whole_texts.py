"""The queries over every row, texts of the table included, against the parsers themselves."""

from __future__ import annotations

import ast
import warnings

import pytest
from pyspark.sql import functions as F

from loomwright.functions.giveup import ParserGaveUp
from loomwright.functions.javasyntax import check as check_java
from loomwright.operators.validate import validate_syntax
from loomwright.plans import catalog

TEXTS = {
    5: "word",
    11: "Plain prose, which is no code at all.",
    17: "",
    23: None,
    29: "one long text with public class and import in it. " * 4000,
    35: "x = 1\n" * 30_000,
    41: "/* only a comment */",
    47: "interface Shape { int area(); }\n" * 2000,
    53: "def f():\n    return 1\n",
    59: "(" * 50_000,
    65: "é日本😀 = 'prose'",
    71: "x\0y",
    77: " \t\n",
    83: "-" * 100_000 + "1",
}


def python_verdict(code):
    """Valid or not, null where the parser itself gives up."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(code)
    except SyntaxError:
        return False
    except (MemoryError, RecursionError, ValueError, OverflowError):
        return None
    return True


def java_verdict(code):
    try:
        return check_java(code) is None
    except ParserGaveUp:
        return None


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    rows = [(i, TEXTS.get(i, "unused")) for i in (*range(5), *TEXTS)] + [(None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    codes = {r["submission_id"]: (r["code"], r["filename"]) for r in catalog.submissions(spark, path).collect()}
    assert len(codes) == len(rows)
    # Every character of a text goes along, but for what would end a comment.
    for i, t in TEXTS.items():
        assert t is None and codes[i][0] is None or len(codes[i][0]) >= len(t or "")
    return path, codes


def found(spark, name, path):
    rows = catalog.QUERIES[name](spark, path).collect()
    by_id = {r["submission_id"]: r for r in rows}
    assert len(by_id) == len(rows)
    return by_id


def test_every_row_has_the_parsers_verdict(spark, whole):
    path, codes = whole
    python, java = found(spark, "validate_python", path), found(spark, "validate_java", path)
    assert python.keys() == java.keys() == codes.keys()
    for i, (code, _) in codes.items():
        if code is None:
            assert [tuple(r[i])[1:] for r in (python, java)] == [(None, None, False)] * 2
            continue
        expected = python_verdict(code)
        assert (python[i]["is_valid"], python[i]["failed"]) == (expected, expected is None), i
        ok = java_verdict(code)
        assert (java[i]["is_valid"], java[i]["has_error"], java[i]["failed"]) == (ok, True if ok is False else None, ok is None), i


def test_whole_raw_texts_have_the_parsers_verdict(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "id int, code string").repartition(3)
    for language, verdict in (("python", python_verdict), ("java", java_verdict)):
        got = {r["id"]: r["v"] for r in df.select("id", validate_syntax(F.col("code"), F.lit(language)).alias("v")).collect()}
        for i, code in TEXTS.items():
            expected = None if code is None else verdict(code)
            assert (got[i]["is_valid"], got[i]["failed"]) == (expected, code is not None and expected is None), (language, i)


def test_templates_decide_whatever_the_text(spark, whole):
    """What the oracle says of rows: a quoted or commented text changes no verdict."""
    path, codes = whole
    python, java = found(spark, "validate_python", path), found(spark, "validate_java", path)
    for i, (code, _) in codes.items():
        if code is not None and i is not None:
            assert (python[i]["is_valid"], java[i]["is_valid"], python[i]["failed"]) == (i % 6 in (0, 5), i % 6 in (1, 2), False), i


def test_every_row_is_answered(spark, whole):
    path, codes = whole
    answers, posted = found(spark, "submission_response", path), found(spark, "intake", path)
    assert answers.keys() == posted.keys() == codes.keys()

    def verdict(language, code):
        return {"python": python_verdict, "java": java_verdict}.get(language, lambda c: False)(code)

    for i, (code, name) in codes.items():
        if code is not None:
            assert answers[i]["is_valid"] == verdict(answers[i]["language"], code), i
        upload = i is not None and i % 2 == 1
        r = posted[i]
        if code is None or not (code or upload):
            assert tuple(r)[1:] == (400, None, None, None), i
            continue
        language = r["language"]
        if language is None:
            assert r["status"] == 500 and python_verdict(code) is None, i
            continue
        assert (r["status"], r["is_valid"], r["filename"]) == (200, str(verdict(language, code)).lower(), name if upload else None), i
