"""Registered queries of the engine's own operators over the standard tables, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright import sql
from loomwright.functions import vectors
from loomwright.functions.admission import BOTH, NEITHER, NOT_UTF8, TOO_LARGE, status_and_detail, text_length
from loomwright.functions.detect import EXTENSIONS, JAVA_SIGNALS, PYTHON_SIGNALS, detect_language, java_score, python_score
from loomwright.operators.chunk import chunk_documents, chunks_of
from loomwright.operators.embed import hashing_encoder
from loomwright.operators.search import top_k_cosine
from loomwright.operators.validate import validate_syntax
from loomwright.operators.vector_search import build_index, nearest, search_index
from loomwright.plans.chunk_oracle import chunk_rows
from loomwright.plans.intake import RESPONSE_COLUMNS, analyze_submissions, as_json
from loomwright.plans.knowledge_base import Built, build_knowledge_base, count_by_extension
from loomwright.sources import files, uploads
from loomwright.sources.collection import read_collection
from loomwright.sources.files import documents_from_table
from loomwright.storage import scratch
from loomwright.streaming import sink
from loomwright.streaming.intake import stream_submissions

# The standard tables hold prose, which has no signals of a language: code and file names are derived from the ids, and the
# text goes along whole, as comments or a string, in Spark and in SQL alike. So every character is admitted, searched for
# signals and parsed, and SQL knows the verdict on any text. 6 and 5 have no common factor: all thirty combinations occur.
PY_OK, JAVA_OK, TIE, JAVA_BAD, PY_BAD = "def f():\n    return ", "public class M{}", "import java.util.*; public class M{}", "private int x; public class Y{ System.out.println( import ", "def f(:"
NAMES = ("A.PY", "b.java", "c.txt", "")
LIMIT = 1_048_576
# Beginnings of file names that are awkward to list: blanks, signs of URIs, a hidden name, other scripts.
ODD_NAMES = ("a b ", "c+d", "100%", "x%20y", "#n", "é日", "_")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _commented(text: Column, mark: str) -> Column:
    """A text as comment lines: what would end a line, or mean something in a comment, is replaced."""
    return F.concat(F.lit(f"\n{mark} "), F.replace(F.translate(text, "\\\r\0", "/  "), F.lit("\n"), F.lit(f"\n{mark} ")))


def _quoted(text: Column) -> Column:
    """A text as a Python string."""
    escaped = F.replace(F.replace(F.translate(text, "\0", " "), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("text = \'\'\'"), escaped, F.lit("\'\'\'"))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    six, five, text = F.col("doc_id") % 6, F.col("doc_id") % 5, F.coalesce("text", F.lit(""))
    python, java = _commented(text, "#"), _commented(text, "//")
    heads = (F.concat(F.lit(PY_OK), F.col("doc_id").cast("string"), python), F.concat(F.lit(JAVA_OK), java), F.concat(F.lit(TIE), java), F.concat(F.lit(JAVA_BAD), java), F.concat(F.lit(PY_BAD), python))
    code = reduce(lambda c, x: c.when(six == x[0], x[1]), list(enumerate(heads))[1:], F.when(six == 0, heads[0])).otherwise(_quoted(text))
    name = reduce(lambda c, x: c.when(five == x[0], x[1]), list(enumerate(NAMES))[1:], F.when(five == 0, NAMES[0]))
    return docs.select(F.col("doc_id").alias("submission_id"), six.cast("int").alias("template"), F.when(F.col("text").isNotNull() | (six != 5), code).alias("code"), name.alias("filename"))


def _sql_commented(mark: str) -> str:
    return f"chr(10) || '{mark} ' || replace(translate(coalesce(text, ''), chr(92) || chr(13) || chr(0), '/  '), chr(10), chr(10) || '{mark} ')"


_SUBMISSIONS = f"""submissions AS (
  SELECT doc_id AS submission_id, CAST(doc_id % 6 AS INTEGER) AS template,
    CASE doc_id % 6 WHEN 0 THEN 'def f():' || chr(10) || '    return ' || CAST(doc_id AS VARCHAR) || {_sql_commented("#")} WHEN 1 THEN '{JAVA_OK}' || {_sql_commented("//")}
      WHEN 2 THEN '{TIE}' || {_sql_commented("//")} WHEN 3 THEN '{JAVA_BAD}' || {_sql_commented("//")} WHEN 4 THEN '{PY_BAD}' || {_sql_commented("#")}
      ELSE 'text = \'\'\'\'\'\'' || replace(replace(translate(text, chr(0), ' '), '\\', '\\\\'), '\'\'', '\\\'\'') || '\'\'\'\'\'\'' END AS code,
    CASE doc_id % 5 {" ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(NAMES))} END AS filename
  FROM documents)"""
_text = lambda s: "'" + s.replace("'", "''") + "'"
_PYTHON = " + ".join(f"CAST(coalesce(contains(code, '{s}'), false) AS INTEGER)" for s in PYTHON_SIGNALS)
_JAVA = " + ".join(f"CAST(coalesce(contains(code, '{s}'), false) AS INTEGER)" for s in JAVA_SIGNALS)
_LANGUAGE = "CASE " + " ".join(f"WHEN ends_with(lower(filename), '{e}') THEN '{lang}'" for e, lang in EXTENSIONS) + f" WHEN {_PYTHON} = 0 AND {_JAVA} = 0 THEN 'unknown' WHEN {_PYTHON} >= {_JAVA} THEN 'python' ELSE 'java' END"


def detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return submissions(spark, sf_dir).select("submission_id", "filename", detect_language(F.col("code"), F.col("filename")).alias("language"))


def detect_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("code")
    return submissions(spark, sf_dir).select("submission_id", python_score(code).alias("python_score"), java_score(code).alias("java_score"), text_length(code).alias("code_length"))


def language_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(spark, sf_dir).groupBy("language").agg(F.count("*").alias("submissions"))


def admission_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of pasted, uploaded, large and undecodable rows, made from the whole texts."""
    docs, i = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), F.col("doc_id")
    text, size = F.col("text"), F.octet_length("text")
    code = F.when(i % 3 == 0, text)
    most = F.when(i % 7 == 0, LIMIT + 1).when(i % 7 == 1, LIMIT).otherwise(0)
    good = F.concat(text, F.repeat(F.lit("a"), F.greatest(most - size, F.lit(0)).cast("int"))).cast("binary")
    bad = F.concat(F.unhex(F.lit("FF")), text.cast("binary"), F.repeat(F.lit("a"), F.greatest(most - size - 1, F.lit(0)).cast("int")).cast("binary"))
    content = F.when(i % 4 == 0, good).when(i % 4 == 1, bad).when(i % 4 == 2, good)
    judged = docs.select("doc_id", status_and_detail(code, content, LIMIT).alias("v"))
    return judged.select(i.alias("submission_id"), "v.status", "v.detail")


def _validated(rows: DataFrame, language: str) -> DataFrame:
    return rows.select("submission_id", "template", validate_syntax(F.col("code"), F.lit(language)).alias("v"))


def _verdicts(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select("submission_id", "v.is_valid", F.col("v.error").startswith(prefix).alias("has_error"), "v.failed")


def validate_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python's verdict on every row, whole texts of the table included."""
    return _verdicts(_validated(submissions(spark, sf_dir), "python"), "SyntaxError: ")


def validate_java(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Java checker's verdict on every row, whole texts of the table included."""
    return _verdicts(_validated(submissions(spark, sf_dir), "java"), "JavaSyntaxError: ")


def submission_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected language and verdict of every row."""
    language = detect_language(F.col("code"), F.col("filename"))
    rows = submissions(spark, sf_dir).select("submission_id", language.alias("language"), validate_syntax(F.col("code"), language).alias("v"))
    return rows.select("submission_id", "language", "v.is_valid", "v.failed")


def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole intake over every row: pastes for even ids and null ones, uploads for odd ones, as responses in JSON."""
    upload = F.coalesce(F.col("submission_id") % 2 == 1, F.lit(False))
    posted = submissions(spark, sf_dir).select("submission_id", F.when(~upload, F.col("code")).alias("code"), F.when(upload, F.col("code").cast("binary")).alias("content"), "filename")
    return _answers(analyze_submissions(posted).select("submission_id", *RESPONSE_COLUMNS))


def _answers(responses: DataFrame) -> DataFrame:
    out = as_json(responses)
    return out.select("submission_id", "status", *[F.get_json_object("body", f"$.{k}").alias(k) for k in ("language", "is_valid", "filename")])


def submission_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every submission as a file of a name that is awkward to list, read back as an upload and answered."""
    path = scratch(spark, "submissions")
    rows = submissions(spark, sf_dir)
    odd = F.element_at(F.array(*map(F.lit, ODD_NAMES)), (F.col("submission_id") % len(ODD_NAMES) + 1).cast("int"))
    files.write_files(rows.select(F.concat(odd, F.col("submission_id").cast("string"), F.lit("_"), F.coalesce("filename", F.lit("none"))).alias("name"), F.col("code").alias("content")), path)
    uploads = files.read_submissions(spark, path).drop("path")
    number = F.regexp_extract("filename", r"([0-9]+)_[^_]*$", 1).cast("long")
    return _answers(analyze_submissions(uploads.withColumn("submission_id", number)).select("submission_id", *RESPONSE_COLUMNS))


def _document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of three extensions, one of them not read, loaded again."""
    path = scratch(spark, "documents")
    docs = _read(spark, sf_dir, "documents")
    ending = F.element_at(F.array(*map(F.lit, (".md", ".txt", ".rst"))), (F.col("doc_id") % 3 + 1).cast("int"))
    files.write_files(docs.select(F.concat(F.col("source"), F.lit("/a b/"), F.col("doc_id").cast("string"), ending).alias("name"), F.col("text").alias("content")), path)
    loaders = {e: files.LOADERS[e] for e in (".md", ".txt")}
    return files.read_documents(spark, path, loaders)


def load_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of several extensions, loaded together from a tree of folders."""
    name = files.file_name(F.col("source"))
    return _document_files(spark, sf_dir).select(name.alias("name"), F.length("text").alias("length"), F.md5("text").alias("digest"))


def extension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_by_extension(_document_files(spark, sf_dir))


def chunks_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk_documents(documents_from_table(_read(spark, sf_dir, "documents")))
    return chunks.withColumn("origin", F.col("metadata")["source"]).drop("metadata")


_ORIGINS = (("documents", "text"), ("pages", "html"), ("conversations", "text"), ("benchmark", "text"))


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each source and whether each is at most the size; the pages' markup and the conversations too."""
    rows = [_read(spark, sf_dir, t).select(F.lit(t).alias("origin"), F.explode(chunks_of(F.col(c))).alias("chunk")) for t, c in _ORIGINS]
    return reduce(DataFrame.unionByName, rows).groupBy("origin").agg(F.count("*").alias("chunks"), F.max(F.length("chunk")).alias("longest"), F.sum(F.length("chunk")).alias("characters"))


def _collection(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame, Built]:
    """A collection of the documents, each given twice, that held others before: one in a hundred was another text, some have vanished, some are new."""
    path = scratch(spark, "collection")
    rows, i = _read(spark, sf_dir, "documents"), F.col("doc_id")
    docs = documents_from_table(rows)
    gone = rows.where(i % 50 == 3).withColumn("doc_id", -i - 1)
    before = rows.where(i % 100 != 11).withColumn("text", F.when(i % 100 == 7, F.concat(F.lit("Before. "), "text")).otherwise(F.col("text")))
    build_knowledge_base(docs.limit(1), path, hashing_encoder(16), "other")
    build_knowledge_base(documents_from_table(before.unionByName(gone)), path, hashing_encoder(), "check")
    return path, docs, build_knowledge_base(docs.unionByName(docs), path, hashing_encoder(), "check")


def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a collection holds: chunks with vectors of the test encoder, and what identifies it."""
    norm = F.round(vectors.l2_norm(F.col("embedding")), 4)
    return read_collection(spark, _collection(spark, sf_dir)[0], "check").select("chunk_id", "collection", "encoder_id", "dim", F.size("embedding").alias("width"), norm.alias("norm"))


def knowledge_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What builds report: documents and chunks, the chunks encoded for a change and for none, and the rows that the collection has."""
    path, docs, built = _collection(spark, sf_dir)
    again = build_knowledge_base(docs, path, hashing_encoder(), "check")
    rows = read_collection(spark, path, "check")
    told = {"documents": built.documents, "chunks": built.chunks, "encoded": built.encoded, "encoded_again": again.encoded, "left_again": again.left}
    return rows.agg(*[F.lit(v).cast("long").alias(k) for k, v in told.items()], F.count("*").alias("written"))


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' markup cut by the table function, from SQL, with the pages' other columns."""
    sql.register(spark)
    _read(spark, sf_dir, "pages").createOrReplaceTempView("loomwright_pages")
    return spark.sql("SELECT page_id, url, chunk_index, md5(chunk) AS digest, length(chunk) AS length FROM chunk_documents(TABLE(loomwright_pages), 800, 100, 'html')")


def _text_files(spark: SparkSession, sf_dir: str) -> str:
    """The documents as files, three in four of them in one folder."""
    path, i = scratch(spark, "files"), F.col("doc_id")
    folder = F.when(i % 4 == 0, F.concat(F.lit("deep/"), (i % 8).cast("string"), F.lit("/"))).otherwise("flat/")
    ending = F.element_at(F.array(*map(F.lit, (".md", ".TXT", ""))), (i % 3 + 1).cast("int"))
    files.write_files(_read(spark, sf_dir, "documents").select(F.concat(folder, F.lit("_"), i.cast("string"), ending).alias("name"), F.col("text").alias("content")), path)
    return path


def files_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the data source, from SQL, with filters on size and extension that keep other files closed."""
    uploads.register(spark)
    path = _text_files(spark, sf_dir)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW loomwright_uploaded USING {uploads.NAME} OPTIONS (path '{path}')")
    return spark.sql("SELECT filename, extension, n_bytes, md5(content) AS digest FROM loomwright_uploaded WHERE n_bytes >= 200 AND extension IN ('.md', '.txt')")


def files_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as a stream, judged into answers and rejects, each once though a batch is given twice."""
    path = _text_files(spark, sf_dir)
    log, out = scratch(spark, "files-log"), scratch(spark, "files-out")
    submitted = stream_submissions(spark, path, log, 4000)
    sink.run(submitted, out, scratch(spark, "files-state"), 4000).awaitTermination()
    batch = files.read_submissions(spark, path, 4000)
    assert not sink.write_batch(batch, 0, out, 4000)
    name = files.file_name(F.col("path"))
    return sink.read(spark, out).select(name.alias("name"), "status", "kind", F.get_json_object("body", "$.language").alias("language"))


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 7)).alias("v"))


def normalize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = _scaled(spark, sf_dir).select("vec_id", vectors.normalise(F.col("v")).alias("u"))
    return unit.select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(F.element_at("u", -1), 6).alias("last"), F.round(vectors.l2_norm(F.col("u")), 6).alias("norm"))


def topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to that of the least id (an extension)."""
    scaled = _scaled(spark, sf_dir)
    query = scaled.orderBy("vec_id").first()["v"]
    found = top_k_cosine(scaled, query, 10, column="v")
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"))


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _read(spark, sf_dir, "embeddings")
    return rows.where(F.col("vec_id") % 50 == 0), rows


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to each of those whose id 50 divides, exactly."""
    found = nearest(*_asked(spark, sf_dir), 10)
    return found.select("query", F.col("rank").cast("long").alias("rank"), "id", F.round("similarity", 6).alias("similarity"))


def indexed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by an inverted file over all vectors; how many of the exact ten each query finds."""
    asked, rows = _asked(spark, sf_dir)
    index = build_index(rows, scratch(spark, "vector-index"))
    found = search_index(spark, index, asked, 10, probes=16)
    exact = nearest(asked, rows, 10)
    both = exact.select("query", "id").join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    return both.groupBy("query").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "detect_language": detect,
    "detect_scores": detect_scores,
    "language_summary": language_summary,
    "admission_status": admission_status,
    "validate_python": validate_python,
    "validate_java": validate_java,
    "submission_response": submission_response,
    "intake": intake,
    "submission_files": submission_files,
    "load_union": load_union,
    "extension_counts": extension_counts,
    "chunks_all": chunks_all,
    "chunk_stats": chunk_stats,
    "index_documents": index_documents,
    "knowledge_base_counts": knowledge_base_counts,
    "chunk_table": chunk_table,
    "files_source": files_source,
    "files_stream": files_stream,
    "nearest_vectors": nearest_vectors,
    "indexed_vectors": indexed_vectors,
    "normalize_vectors": normalize_vectors,
    "topk_cosine": topk_cosine,
}

# Whether a row's code is valid in the language it was taken for: the templates decide, whatever the text.
_VALID_PYTHON, _VALID_JAVA = "(template IN (0, 5))", "(template IN (1, 2))"
_VALID = f"CASE language WHEN 'python' THEN {_VALID_PYTHON} WHEN 'java' THEN {_VALID_JAVA} ELSE false END"
_ODD = "CASE submission_id % 7 " + " ".join(f"WHEN {k} THEN {_text(n)}" for k, n in enumerate(ODD_NAMES)) + " END"
_FILES = "SELECT CAST(doc_id AS VARCHAR) || CASE doc_id % 3 WHEN 0 THEN '.md' ELSE '.txt' END AS name, length(text) AS length, md5(text) AS digest FROM documents WHERE doc_id % 3 < 2 AND text IS NOT NULL"
_TEXT_FILES = "SELECT '_' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT' ELSE '' END AS filename, CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' ELSE '' END AS extension, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS digest FROM documents WHERE text IS NOT NULL"
_CHUNKS = f"""WITH RECURSIVE {chunk_rows("SELECT doc_id AS id, text AS t FROM documents")}, keyed AS (
  SELECT sha256(id || chr(1) || chr(1) || chunk_index || chr(1) || chunk) AS chunk_id, CAST(id AS VARCHAR) AS source, CAST(NULL AS INTEGER) AS page, chunk_index, chunk AS text,
    CAST(ceil(length(chunk) / 4) AS INTEGER) AS est_tokens, CAST(id AS VARCHAR) AS origin FROM chunks
)"""
_EVERY_TEXT = " UNION ALL ".join(f"SELECT {_text(t)} || ':' || row_number() OVER () AS id, {c} AS t FROM {t}" for t, c in _ORIGINS)
_VECTORS = """scaled AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (1 + vec_id % 7)) AS v FROM embeddings),
unit AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM scaled)"""

ORACLES: dict[str, str] = {
    "detect_language": f"WITH {_SUBMISSIONS} SELECT submission_id, filename, {_LANGUAGE} AS language FROM submissions",
    "detect_scores": f"WITH {_SUBMISSIONS} SELECT submission_id, {_PYTHON} AS python_score, {_JAVA} AS java_score, coalesce(length(code), 0) AS code_length FROM submissions",
    "language_summary": f"WITH {_SUBMISSIONS} SELECT {_LANGUAGE} AS language, count(*) AS submissions FROM submissions GROUP BY 1",
    "admission_status": f"""
WITH grid AS (
  SELECT doc_id AS submission_id, doc_id % 3 = 0 AS pasted, doc_id % 4 <> 3 AS uploaded, doc_id % 4 = 1 AS undecodable,
    greatest(CASE doc_id % 7 WHEN 0 THEN {LIMIT + 1} WHEN 1 THEN {LIMIT} ELSE 0 END, strlen(coalesce(text, '')) + CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END) AS n_bytes FROM documents)
SELECT submission_id,
  CASE WHEN pasted = uploaded THEN 400 WHEN uploaded AND n_bytes > {LIMIT} THEN 413 WHEN uploaded AND undecodable THEN 400 ELSE 200 END AS status,
  CASE WHEN NOT pasted AND NOT uploaded THEN {_text(NEITHER)} WHEN pasted AND uploaded THEN {_text(BOTH)}
    WHEN uploaded AND n_bytes > {LIMIT} THEN {_text(TOO_LARGE)} WHEN uploaded AND undecodable THEN {_text(NOT_UTF8)} END AS detail FROM grid""",
    "validate_python": f"WITH {_SUBMISSIONS} SELECT submission_id, {_VALID_PYTHON} AS is_valid, CASE WHEN NOT {_VALID_PYTHON} THEN true END AS has_error, false AS failed FROM submissions WHERE code IS NOT NULL UNION ALL SELECT submission_id, NULL, NULL, false FROM submissions WHERE code IS NULL",
    "validate_java": f"WITH {_SUBMISSIONS} SELECT submission_id, {_VALID_JAVA} AS is_valid, CASE WHEN NOT {_VALID_JAVA} THEN true END AS has_error, false AS failed FROM submissions WHERE code IS NOT NULL UNION ALL SELECT submission_id, NULL, NULL, false FROM submissions WHERE code IS NULL",
    "submission_response": f"WITH {_SUBMISSIONS}, found AS (SELECT *, {_LANGUAGE} AS language FROM submissions) SELECT submission_id, language, {_VALID} AS is_valid, false AS failed FROM found",
    "intake": f"""
WITH {_SUBMISSIONS}, posted AS (SELECT submission_id, template, code, CASE WHEN submission_id % 2 = 1 THEN filename END AS filename FROM submissions),
found AS (SELECT *, {_LANGUAGE} AS language, code IS NULL OR code = '' AND submission_id % 2 = 0 AS absent FROM posted)
SELECT submission_id, CASE WHEN absent THEN 400 ELSE 200 END AS status, CASE WHEN NOT absent THEN language END AS language,
  CASE WHEN absent THEN NULL WHEN {_VALID} THEN 'true' ELSE 'false' END AS is_valid, CASE WHEN NOT absent THEN filename END AS filename FROM found""",
    "submission_files": f"""
WITH {_SUBMISSIONS}, posted AS (SELECT submission_id, template, code, {_ODD} || submission_id || '_' || coalesce(filename, 'none') AS filename FROM submissions WHERE code IS NOT NULL),
found AS (SELECT *, {_LANGUAGE} AS language FROM posted)
SELECT submission_id, 200 AS status, language, CASE WHEN {_VALID} THEN 'true' ELSE 'false' END AS is_valid, filename FROM found""",
    "load_union": _FILES,
    "extension_counts": f"SELECT regexp_extract(name, '[.][a-z]+$') AS extension, count(*) AS documents FROM ({_FILES}) GROUP BY 1",
    "chunks_all": f"{_CHUNKS} SELECT * FROM keyed",
    "chunk_stats": f"WITH RECURSIVE {chunk_rows(_EVERY_TEXT)} SELECT regexp_extract(id, '^[a-z]+') AS origin, count(*) AS chunks, max(length(chunk)) AS longest, CAST(sum(length(chunk)) AS BIGINT) AS characters FROM chunks GROUP BY 1",
    "index_documents": f"{_CHUNKS} SELECT chunk_id, 'check' AS collection, 'hashing-64' AS encoder_id, 64 AS dim, 64 AS width, CASE WHEN regexp_matches(text, '[\\p{{L}}\\p{{N}}_]') THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS norm FROM keyed",
    "knowledge_base_counts": f"{_CHUNKS} SELECT (SELECT 2 * count(*) FROM documents) AS documents, count(*) AS chunks, count(*) FILTER (CAST(source AS BIGINT) % 100 IN (7, 11)) AS encoded, CAST(0 AS BIGINT) AS encoded_again, CAST(0 AS BIGINT) AS left_again, count(*) AS written FROM keyed",
    "chunk_table": f"WITH RECURSIVE {chunk_rows('SELECT page_id AS id, html AS t FROM pages', 800, 100)} SELECT page_id, url, chunk_index, md5(chunk) AS digest, length(chunk) AS length FROM chunks JOIN pages ON page_id = id",
    "files_source": f"SELECT * FROM ({_TEXT_FILES}) WHERE n_bytes >= 200 AND extension <> ''",
    "files_stream": f"""
SELECT filename AS name, CASE WHEN n_bytes > 4000 THEN 413 ELSE 200 END AS status, CASE WHEN n_bytes > 4000 THEN 'rejects' ELSE 'answers' END AS kind,
  CASE WHEN n_bytes <= 4000 THEN language END AS language FROM (SELECT *, {_LANGUAGE} AS language FROM (SELECT *, text AS code FROM ({_TEXT_FILES}) JOIN documents ON doc_id = CAST(regexp_extract(filename, '[0-9]+') AS BIGINT)))""",
    "nearest_vectors": """
WITH unit AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS u FROM embeddings),
scored AS (SELECT q.vec_id AS query, v.vec_id AS id, list_sum(list_transform(range(1, len(q.u) + 1), lambda i: q.u[i] * v.u[i])) AS s FROM unit q, unit v WHERE q.vec_id % 50 = 0)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS rank, id, round(s, 6) AS similarity FROM scored QUALIFY rank <= 10""",
    "normalize_vectors": f"WITH {_VECTORS} SELECT vec_id, round(u[1], 6) AS first, round(u[-1], 6) AS last, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS norm FROM unit",
    "topk_cosine": f"""
WITH {_VECTORS}, query AS (SELECT u AS q FROM unit ORDER BY vec_id LIMIT 1)
SELECT vec_id, round(list_sum(list_transform(range(1, len(u) + 1), lambda i: u[i] * q[i])), 6) AS similarity FROM unit, query ORDER BY similarity DESC, vec_id LIMIT 10""",
}

__all__ = ["ORACLES", "QUERIES", "chunks_all", "submissions"]
