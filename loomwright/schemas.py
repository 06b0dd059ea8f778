"""Explicit schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

LANGUAGES = ("python", "java", "unknown")

SUBMISSION = T.StructType(
    [
        T.StructField("submission_id", T.LongType(), False),
        T.StructField("code", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("content", T.BinaryType()),
    ]
)

RESPONSE = T.StructType(
    [
        T.StructField("submission_id", T.LongType(), False),
        T.StructField("status", T.IntegerType(), False),
        T.StructField("detail", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("is_valid", T.BooleanType()),
        T.StructField("error", T.StringType()),
        T.StructField("filename", T.StringType()),
    ]
)

DOCUMENT = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("page", T.IntegerType()),
        T.StructField("text", T.StringType(), False),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

CHUNK = T.StructType(
    [
        T.StructField("chunk_id", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("page", T.IntegerType()),
        T.StructField("chunk_index", T.IntegerType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("est_tokens", T.IntegerType()),
    ]
)
