"""Submissions to responses: admit, detect, check, respond. One narrow plan; rejected rows stay, with their status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.config import Settings
from loomwright.functions.admission import TOO_LARGE, admit
from loomwright.functions.detect import detect_language
from loomwright.operators.validate import validate_syntax

INTERNAL = "Internal Server Error"
RESPONSE_COLUMNS = ("status", "detail", "language", "is_valid", "error", "filename")


def analyze_submissions(submissions: DataFrame, limit: int | None = None, empty_code_is_absent: bool = True) -> DataFrame:
    """``code``, ``content`` and ``filename`` give way to status, detail, language, verdict, error and file name.

    A table read from files has ``n_bytes`` too, which stands for bytes that weren't read. If the checker itself
    fails on a row, or the row's file couldn't be read (``read_error``), that row has status 500 and no verdict. Without a
    ``limit`` that of the settings holds.
    """
    limit = Settings.load().max_upload_bytes if limit is None else limit
    unread = F.col("content").isNull() & (F.coalesce(F.col("n_bytes"), F.lit(0)) > limit) if "n_bytes" in submissions.columns else F.lit(False)
    lost = F.col("read_error").isNotNull() if "read_error" in submissions.columns else F.lit(False)
    if "code" not in submissions.columns:
        submissions = submissions.withColumn("code", F.lit(None).cast("string"))
    rest = [c for c in submissions.columns if c not in ("code", "content", "filename", "n_bytes", "read_error")]
    names = submissions.withColumn("_unread", unread).withColumn("_lost", lost)
    admitted = admit(names, limit, empty_code_is_absent)
    ok = (F.col("status") == 200) & ~F.col("_unread") & ~F.col("_lost")
    judged = admitted.withColumn("language", F.when(ok, detect_language(F.col("source_text"), F.col("filename")))).withColumn("_v", validate_syntax(F.when(ok, F.col("source_text")), F.col("language")))
    failed = F.coalesce(F.col("_v.failed"), F.lit(False)) | F.col("_lost")
    return judged.select(
        *rest,
        F.when(F.col("_unread"), 413).when(failed, 500).otherwise(F.col("status")).cast("int").alias("status"),
        F.when(F.col("_unread"), TOO_LARGE).when(failed, INTERNAL).otherwise(F.col("detail")).alias("detail"),
        F.when(~failed, F.col("language")).alias("language"),
        F.col("_v.is_valid").alias("is_valid"),
        F.col("_v.error").alias("error"),
        F.when(ok & ~failed, F.col("filename")).alias("filename"),
    )


def as_json(responses: DataFrame) -> DataFrame:
    """``status`` and ``body``: the response as JSON with its nulls, or the rejection's detail."""
    accepted = F.to_json(F.struct("language", "is_valid", "error", "filename"), {"ignoreNullFields": "false"})
    rejected = F.to_json(F.struct("detail"), {"ignoreNullFields": "false"})
    rest = [c for c in responses.columns if c not in RESPONSE_COLUMNS]
    return responses.select(*rest, "status", F.when(F.col("status") == 200, accepted).otherwise(rejected).alias("body"))


def health(df: DataFrame) -> DataFrame:
    """One row that says the engine answers."""
    return df.sparkSession.range(1).select(F.lit("ok").alias("status"))
