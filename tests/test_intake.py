"""Admission, detection, checking and responding, with the cases that the blueprint lists."""

from __future__ import annotations

import random
import sys

import pytest
from pyspark.sql import functions as F

from loomwright import schemas
from loomwright.functions import pysyntax
from loomwright.functions.admission import BOTH, MAX_UPLOAD_BYTES, NEITHER, NOT_UTF8, TOO_LARGE, frontend_accepts_name, frontend_accepts_paste
from loomwright.functions.detect import JAVA_SIGNALS, PYTHON_SIGNALS, detect_language
from loomwright.functions.giveup import ParserGaveUp
from loomwright.functions.javasyntax import check as check_java
from loomwright.operators.validate import UNSUPPORTED
from loomwright.plans.intake import INTERNAL, analyze_submissions, as_json, health

JAVA = 'public class Main {\n    public static void main(String[] args) {\n        System.out.println("Hello");\n    }\n}\n'
HALF_JAVA = "public class Main {\n    public static void main(String[] args) {\n"


def respond(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schemas.SUBMISSION)
    return [r.asDict() for r in analyze_submissions(df).orderBy("submission_id").collect()]


def test_reference_cases(spark):
    got = respond(
        spark,
        [
            ("def foo():\n    return 1\n", None, None),
            ("def foo(:\n    return 1\n", None, None),
            (JAVA, None, None),
            (HALF_JAVA, None, None),
            (None, None, None),
            ("print('hi')", "test.py", b"print('hi')"),
        ],
    )
    assert [(r["status"], r["language"], r["is_valid"]) for r in got] == [(200, "python", True), (200, "python", False), (200, "java", True), (200, "java", False), (400, None, None), (400, None, None)]
    assert got[0]["error"] is None and got[1]["error"] == "SyntaxError: invalid syntax at line 1" and got[3]["error"].startswith("JavaSyntaxError: ")
    assert [r["detail"] for r in got[4:]] == [NEITHER, BOTH]


def test_admission_order_and_limits(spark):
    fits, large = b"#" * MAX_UPLOAD_BYTES, b"#" * (MAX_UPLOAD_BYTES + 1)
    bad = [b"\xff\xfe", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf4\x90\x80\x80", b"\xe2\x82"]
    rows = [(None, "a.py", fits), (None, "a.py", large), (None, "a.py", b"\xff" * (MAX_UPLOAD_BYTES + 1)), ("#" * (MAX_UPLOAD_BYTES + 9), None, None), ("", None, None), (None, "e.py", b""), *((None, "b.py", b) for b in bad)]
    got = respond(spark, rows)
    assert [r["status"] for r in got] == [200, 413, 413, 200, 400, 200, 400, 400, 400, 400, 400]
    assert got[1]["detail"] == TOO_LARGE and got[4]["detail"] == NEITHER and got[6]["detail"] == NOT_UTF8
    assert (got[5]["language"], got[5]["is_valid"], got[5]["filename"]) == ("python", True, "e.py")


def test_names_and_ties(spark):
    rows = [(None, "A.PY", JAVA.encode()), (None, "c.txt", b"def f():\n  pass"), (None, "", JAVA.encode()), ("import java.util.*; public class M{}", None, None), ("public class " * 5 + "import def ", None, None), ("DEF X IMPORT Y", None, None), ("hello world", None, None)]
    got = respond(spark, rows)
    assert [r["language"] for r in got] == ["python", "python", "java", "python", "python", "unknown", "unknown"]
    assert got[6]["error"] == UNSUPPORTED and got[6]["is_valid"] is False


def test_one_row_that_the_parser_cannot_take_leaves_the_others(spark):
    got = respond(spark, [("import " + "-" * 200_000 + "1", None, None), ("x" + ".a" * 100_000 + " import ", None, None), ("import os", None, None)])
    assert got[2]["is_valid"] is True
    for r in got[:2]:
        assert (r["status"], r["detail"], r["is_valid"]) in [(500, INTERNAL, None), (200, None, False)]


def test_json_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "import os", None, None), (2, None, None, None)], schemas.SUBMISSION)
    got = {r["submission_id"]: r["body"] for r in as_json(analyze_submissions(df)).collect()}
    assert got == {1: '{"language":"python","is_valid":true,"error":null,"filename":null}', 2: f'{{"detail":"{NEITHER}"}}'.replace("\\", "")}
    assert health(df).collect()[0]["status"] == "ok"


def test_detection_equals_plain_statement(spark):
    rng = random.Random(5)
    parts = [*PYTHON_SIGNALS, *JAVA_SIGNALS, "x", "\n", "DEF ", "é", "publicclass"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 5))), rng.choice([None, "", "a.py", "B.JAVA", "c.txt", "py"])) for _ in range(400)]

    def plain(code, name):
        for end, lang in ((".py", "python"), (".java", "java")):
            if name and name.lower().endswith(end):
                return lang
        p, j = (sum(s in code for s in signals) for signals in (PYTHON_SIGNALS, JAVA_SIGNALS))
        return "unknown" if not p and not j else "python" if p >= j else "java"

    df = spark.createDataFrame(rows, "code string, filename string")
    got = df.select("code", "filename", detect_language(F.col("code"), F.col("filename")).alias("l")).collect()
    assert all(r["l"] == plain(r["code"], r["filename"]) for r in got)
    assert spark.createDataFrame([(None, None)], "a string, b string").select(detect_language(F.col("a"), F.col("b"))).first()[0] == "unknown"


def test_form_filters(spark):
    df = spark.createDataFrame([("a.PY", " x"), ("a.txt", " \n"), (None, None)], "n string, c string")
    assert [tuple(r) for r in df.select(frontend_accepts_name(F.col("n")), frontend_accepts_paste(F.col("c"))).collect()] == [(True, True), (False, False), (False, False)]


@pytest.mark.skipif(sys.version_info[:2] != (3, 13), reason="messages are those of 3.13")
@pytest.mark.parametrize(
    ("code", "error"),
    [
        ("", None),
        ("return 1", None),
        ("'\\d'", None),
        ("a = 1\r\nmatch a:\r\n    case 1: pass", None),
        ("def f():\nreturn 1", "SyntaxError: expected an indented block after function definition on line 1 at line 2"),
        ("if 1:\n\tx=1\n        y=2", "SyntaxError: inconsistent use of tabs and spaces in indentation at line 3"),
        ("\ufeffx=1", "SyntaxError: invalid non-printable character U+FEFF at line 1"),
        ("x=1\0", "SyntaxError: source code string cannot contain null bytes at line None"),
        ("def f(", "SyntaxError: '(' was never closed at line 1"),
        ("(" * 300 + ")" * 300, "SyntaxError: too many nested parentheses at line 1"),
    ],
)
def test_python_messages(code, error):
    assert pysyntax.check(code) == error


VALID_JAVA = [
    "",
    JAVA,
    "package a.b; import java.util.*; import static java.lang.Math.max; class A<T extends Comparable<T>> extends B<Map<String,List<Integer>>> implements C, D { int x = 1, y[] = {1,2,}; { x++; } static { } A() throws E { super(); } <U> U f(U u, int... a) { return (U) u; } }",
    "class A { void f() { Runnable r = () -> {}; F<I,I> g = x -> x + 1; B h = (a, b) -> a.f(b); Object o = int[]::clone; Object p = ArrayList<String>::new; } }",
    'class A { int f(int a) { for (int i = 0, j = 1; i < a >> 2; i++, j--) { a >>>= 1; } for (String s : xs) continue; do { a--; } while (a > 0); switch (a) { case 1: case 2: return 3; default: a = 4; } try (R r = new R(); S s = x) { } catch (E | F e) { } finally { } return a > 1 ? b : (int) c; } }',
    "enum E { A, B(1) { void f() {} }, C; int x; E(int... a) {} }",
    '@interface I { int value() default 1; String[] n() default {"a"}; }',
    "class A { var x = 1; int[][] a = new int[3][]; boolean q = a < b && c > d; Class<?> c = int.class; Class<?> d = String[].class; Object o = (Runnable & Serializable) () -> {}; }",
    "interface I { default void f() {} static int g() { return 1; } }",
    "class A { void f() { label: for(;;) { break label; } A.this.f(); int i = a[0]++; ((A) b).c(); new Thread(() -> run()).start(); List<List<String>> x = new ArrayList<>(); } }",
    "class A { char c = '\\u0041'; String s = \"\\t\\\"\"; double d = 1.5e3f + 0x1FL + 1_000 + .5; }",
]
INVALID_JAVA = [
    HALF_JAVA,
    "record P(int x) {}",
    "class A { int f(int x) { return switch (x) { case 1 -> 2; default -> 3; }; } }",
    'class A { String s = """\n a"""; }',
    'class A { String s = "abc; }',
    "class A { int x = ; }",
    "private int x; public class Y{ System.out.println( import ",
    "class A { void f() { int x = 1 } }",
    "hello world",
    "class A { void f() { 1 + 2; } }",
    "class A } {",
    "class A { /* }",
    "class A { void f() { try { } } }",
    "int x;",
    "class A { List<int> x; }",
]


@pytest.mark.parametrize("text", VALID_JAVA)
def test_java_accepts(text):
    assert check_java(text) is None


@pytest.mark.parametrize("text", INVALID_JAVA)
def test_java_refuses(text):
    assert check_java(text).startswith("JavaSyntaxError: ")


def test_java_ends_on_anything():
    rng = random.Random(2)
    words = "class A { } ( ) < > , ; = a . -> int new [ ] ? : @ \" ' + import \\u".split(" ")
    for _ in range(300):
        out = check_java(" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))))
        assert out is None or out.startswith("JavaSyntaxError: ")
    with pytest.raises(ParserGaveUp):  # valid, but too deep for the checker: no verdict rather than a wrong one
        check_java("class A { int x = " + "(" * 5000 + "1" + ")" * 5000 + "; }")
