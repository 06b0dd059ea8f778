"""Admission of a submission: exactly one of pasted code and uploaded bytes, uploads small enough and valid UTF-8.

One ordered chain of native expressions; the first rule that fails gives status and detail. Rejected rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.config import Settings

# Fixed value: the limit of an upload, where no setting says otherwise.
MAX_UPLOAD_BYTES = Settings().max_upload_bytes

# The messages of the rejections.
NEITHER = "Provide either 'code' (pasted text) or 'file' (upload), not neither."
BOTH = "Provide only one of 'code' or 'file', not both."
TOO_LARGE = "File exceeds 1MB limit."
NOT_UTF8 = "File could not be decoded as UTF-8 text. Is this a valid source file?"


def _rules(code: Column, content: Column, n_bytes: Column, limit: int) -> list[tuple[Column, int, str]]:
    return [
        (code.isNull() & content.isNull(), 400, NEITHER),
        (code.isNotNull() & content.isNotNull(), 400, BOTH),
        (content.isNotNull() & (n_bytes > limit), 413, TOO_LARGE),
        (content.isNotNull() & ~F.is_valid_utf8(content.cast("string")), 400, NOT_UTF8),
    ]


def status_and_detail(code: Column, content: Column, limit: int | None = None) -> Column:
    """``struct<status int, detail string>``; 200 and null for admitted rows. The limit is the settings', unless given."""
    limit = Settings.load().max_upload_bytes if limit is None else limit
    rules = _rules(code, content, F.octet_length(content), limit)
    verdict = lambda s, d: F.struct(F.lit(s).alias("status"), F.lit(d).cast("string").alias("detail"))
    out = verdict(200, None)
    for broken, status, detail in reversed(rules):
        out = F.when(broken, verdict(status, detail)).otherwise(out)
    return out


def admit(submissions: DataFrame, limit: int | None = None, empty_code_is_absent: bool = True) -> DataFrame:
    """``submissions`` with ``status``, ``detail`` and ``source_text`` (null when rejected).

    A form field ``code`` left empty counts as absent unless told otherwise; an upload of no bytes is an empty file.
    The file name belongs to uploads alone.
    """
    code = F.when(F.col("code") == "", F.lit(None)).otherwise(F.col("code")) if empty_code_is_absent else F.col("code")
    judged = submissions.withColumn("code", code).withColumn("_v", status_and_detail(F.col("code"), F.col("content"), limit))
    text = F.when(F.col("_v.status") == 200, F.coalesce(F.col("content").cast("string"), F.col("code")))
    return judged.select(
        *[c for c in judged.columns if c not in ("_v", "filename")],
        F.when(F.col("content").isNotNull(), F.col("filename")).alias("filename"),
        F.col("_v.status").alias("status"),
        F.col("_v.detail").alias("detail"),
        text.alias("source_text"),
    )


def text_length(text: Column) -> Column:
    """Code points; 0 for null."""
    return F.coalesce(F.char_length(text), F.lit(0))


def frontend_accepts_name(filename: Column) -> Column:
    """The form's own filter on names, which the intake doesn't enforce."""
    return F.coalesce(F.lower(filename).rlike(r"\.(py|java)$"), F.lit(False))


def frontend_accepts_paste(code: Column) -> Column:
    """The form's own filter on pastes, which the intake doesn't enforce."""
    return F.coalesce(code.rlike(r"\S"), F.lit(False))
