"""Language of a piece of source code, as native expressions: by file extension, else by textual signals."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions in the order they are tried, and the signals of each language.
EXTENSIONS = ((".py", "python"), (".java", "java"))
PYTHON_SIGNALS = ("def ", "import ", "print(", "elif ", "self.")
JAVA_SIGNALS = ("public class", "public static void main", "System.out.println", "private ")


def score(code: Column, signals: tuple[str, ...]) -> Column:
    """How many of the signals occur in the code (each counts once). 0 for null."""
    return reduce(add, (F.coalesce(F.contains(code, F.lit(s)), F.lit(False)).cast("int") for s in signals))


def python_score(code: Column) -> Column:
    return score(code, PYTHON_SIGNALS)


def java_score(code: Column) -> Column:
    return score(code, JAVA_SIGNALS)


def detect_language(code: Column, filename: Column) -> Column:
    """``python``, ``java`` or ``unknown``. A known extension decides; equal scores above 0 are Python's."""
    name = F.lower(filename)
    python, java = python_score(code), java_score(code)
    out = None
    for ending, language in EXTENSIONS:
        hit = F.endswith(name, F.lit(ending))
        out = F.when(hit, language) if out is None else out.when(hit, language)
    return out.when((python == 0) & (java == 0), "unknown").when(python >= java, "python").otherwise("java")
