"""The operators as SQL functions of a session.

``detect_language``, ``admit``, ``text_length``, ``validate_syntax``; ``chunk_array``, ``chunk_text`` (a table function over a
text), ``chunk_documents`` (one over a table); ``l2_normalise``, ``cosine``; and the format ``loomwright_files``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomwright.config import Settings
from loomwright.functions.admission import BOTH, NEITHER, NOT_UTF8, TOO_LARGE
from loomwright.functions.chunking import split_text
from loomwright.functions.detect import EXTENSIONS, JAVA_SIGNALS, PYTHON_SIGNALS
from loomwright.operators.chunk import table_functions
from loomwright.operators.validate import VERDICT, verdict
from loomwright.sources import uploads


def _detect_sql() -> str:
    """The detection as one SQL expression over ``code`` and ``filename``, so that it runs without Python."""
    total = lambda signals: " + ".join(f"CAST(coalesce(contains(code, '{s}'), false) AS INT)" for s in signals)
    by_name = " ".join(f"WHEN endswith(lower(filename), '{e}') THEN '{lang}'" for e, lang in EXTENSIONS)
    python, java = total(PYTHON_SIGNALS), total(JAVA_SIGNALS)
    return f"CASE {by_name} WHEN {python} = 0 AND {java} = 0 THEN 'unknown' WHEN {python} >= {java} THEN 'python' ELSE 'java' END"


def _native(limit: int) -> dict[str, str]:
    """Admission, text length and vector arithmetic as SQL expressions, which run without Python."""
    text = lambda s: "'" + s.replace("'", "\\'") + "'"
    told = lambda status, detail: f"named_struct('status', {status}, 'detail', {'CAST(NULL AS STRING)' if detail is None else text(detail)})"
    return {
        "admit(code STRING, content BINARY) RETURNS STRUCT<status: INT, detail: STRING>": f"""CASE WHEN code IS NULL AND content IS NULL THEN {told(400, NEITHER)}
          WHEN code IS NOT NULL AND content IS NOT NULL THEN {told(400, BOTH)} WHEN octet_length(content) > {limit} THEN {told(413, TOO_LARGE)}
          WHEN NOT is_valid_utf8(CAST(content AS STRING)) THEN {told(400, NOT_UTF8)} ELSE {told(200, None)} END""",
        "text_length(text STRING) RETURNS INT": "coalesce(char_length(text), 0)",
        "l2_normalise(v ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>": "transform(v, x -> x / coalesce(nullif(sqrt(aggregate(v, 0D, (s, y) -> s + y * y)), 0D), 1D))",
        "cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(l2_normalise(a), l2_normalise(b), (x, y) -> x * y), 0D, (s, x) -> s + x)",
    }


def register(spark: SparkSession) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION detect_language(code STRING, filename STRING) RETURNS STRING RETURN {_detect_sql()}")

    @F.pandas_udf(VERDICT)
    def validate(codes: pd.Series, languages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([verdict(c, lang) for c, lang in zip(codes, languages, strict=True)], columns=["is_valid", "error", "failed"]).astype({"is_valid": object})

    size, overlap, limit = (settings := Settings.load()).chunk_size, settings.chunk_overlap, settings.max_upload_bytes

    @F.pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap))

    spark.udf.register("validate_syntax", validate)
    spark.udf.register("chunk_array", chunks)
    for name, function in table_functions(size, overlap).items():
        spark.udtf.register(name, function)
    for signature, body in _native(limit).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    uploads.register(spark)
