"""The intake as a stateless stream: files that appear in a directory become responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loomwright.config import Settings
from loomwright.plans.intake import analyze_submissions
from loomwright.sources import uploads


def stream_submissions(spark: SparkSession, path: str, log: str | None = None, limit: int | None = None) -> DataFrame:
    """Uploads as the batch reader gives them, each file once; ``log`` is kept beside the directory unless it is named.

    What the directory holds now is found by this call, what comes later by ``uploads.discover``, once or again and again
    (``uploads.keep_discovering``).
    """
    log = f"{path.rstrip('/')}.loomwright-log" if log is None else log
    limit = Settings.load().max_upload_bytes if limit is None else limit
    uploads.discover(spark, path, log)
    return uploads.stream(spark, log, limit).select("path", "filename", "content", "n_bytes", "read_error")


def stream_responses(submissions: DataFrame, out: str, checkpoint: str, limit: int | None = None, once: bool = True) -> StreamingQuery:
    """Write responses as JSON files; ``once`` works off what is there and ends."""
    writer = analyze_submissions(submissions, limit).writeStream.format("json").option("ignoreNullFields", "false").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
