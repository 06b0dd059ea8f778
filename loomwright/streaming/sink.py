"""Answers and rejects of a stream, each batch exactly once.

A batch is judged in one pass, written to a folder of its own, split into answers and rejects there, and published by one
rename of the whole folder. A batch that Spark runs again, because it failed between its writes or the process was lost before
the checkpoint knew, finds its marker, the folder itself, and leaves it alone; what an attempt left unfinished is written to
no name that a reader looks at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomwright.plans.intake import analyze_submissions, as_json
from loomwright.storage import children, delete, publish

KINDS = ("answers", "rejects")


def write_batch(submissions: DataFrame, batch: int, out: str, limit: int | None = None) -> bool:
    """Judge a batch and publish it under its number; false, and nothing done, if that has been done."""
    spark, name = submissions.sparkSession, f"batch={batch:012d}"
    if name in children(spark, out):
        return False
    passing = f"{out.rstrip('/')}/passing/{uuid.uuid4().hex}"
    judged = as_json(analyze_submissions(submissions, limit))
    kind = F.when(F.col("status") == 200, KINDS[0]).otherwise(KINDS[1])
    judged.withColumn("kind", kind).write.partitionBy("kind").parquet(passing)
    if publish(spark, passing, f"{out.rstrip('/')}/{name}"):
        return True
    delete(spark, passing)
    return False


def run(submissions: DataFrame, out: str, checkpoint: str, limit: int | None = None, once: bool = True) -> StreamingQuery:
    """Judge a stream of submissions into a folder of published batches."""
    writer = submissions.writeStream.foreachBatch(lambda df, n: write_batch(df, n, out, limit)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def read(spark: SparkSession, out: str, kind: str | None = None) -> DataFrame:
    """What the published batches hold: all of it, or its ``answers`` or ``rejects``."""
    names = [n for n in children(spark, out) if n.startswith("batch=")]
    if not names:
        raise FileNotFoundError(f"no batch in {out}")
    rows = spark.read.option("basePath", out).parquet(*[f"{out.rstrip('/')}/{n}" for n in names])
    return rows if kind is None else rows.where(F.col("kind") == kind)
