"""Chunks, vectors, sources, sinks, SQL functions and streaming."""

from __future__ import annotations

import logging
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from loomwright import config, sql
from loomwright.functions.admission import status_and_detail
from loomwright.functions.chunking import split_text
from loomwright.functions.vectors import normalise
from loomwright.operators.chunk import chunk_documents
from loomwright.operators.embed import EncoderMismatch, check_encoder, hashing_encoder, index_chunks
from loomwright.operators.search import search, top_k_cosine
from loomwright.plans.chunk_oracle import chunk_rows
from loomwright.plans.intake import analyze_submissions
from loomwright.plans.knowledge_base import Built, build_knowledge_base, count_by_extension
from loomwright.sources import files
from loomwright.sources.collection import read_collection
from loomwright.streaming.intake import stream_responses, stream_submissions


def placed(text: str, chunks: list[str], overlap: int) -> bool:
    """Whether the chunks lie in the text in order, leave only blanks between them and overlap by at most that much."""
    ends = {0}
    for c in chunks:
        new = set()
        for e in ends:
            at = text.find(c, max(0, e - overlap))
            while at >= 0 and (at <= e or not text[e:at].strip()):
                new.add(at + len(c))
                at = text.find(c, at + 1)
        ends = new
    return any(not text[e:].strip() for e in ends)


def test_chunks_begin_at_the_strongest_separator():
    sections = [f"\n## Part {k}\n" + "Some words in a sentence. " * 30 for k in range(4)]
    assert split_text("# Title" + "".join(sections)) == [("# Title" + sections[0]).strip(), *(s.strip() for s in sections[1:])]
    assert split_text("a b c d e f", 5, 2) == ["a b c", "c d", "d e", "e f"]
    assert split_text("aaaa. bbbb. cccc", 6, 0) == ["aaaa", ". bbbb", ". cccc"]


def test_chunk_invariants():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["word ", "a", ". ", "\n", "\n\n", "\n## t", "\n### u", "é😀", "x" * rng.randint(1, 90)]) for _ in range(rng.randint(0, 120)))
        size = rng.choice([20, 50, 200])
        overlap = rng.choice([0, 5, 19])
        chunks = split_text(text, size, overlap)
        assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
        assert placed(text, chunks, overlap)


def test_chunk_edges():
    assert split_text(None) == split_text("") == split_text(" \n\t") == []
    assert split_text("  " + "x" * 1190 + "\n") == ["x" * 1190]
    assert [len(c) for c in split_text("y" * 3000)] == [1200, 1200, 1000]
    with pytest.raises(ValueError, match="overlap"):
        split_text("x", 10, 11)


def documents(spark, rows):
    return spark.createDataFrame([(s, p, t, {"k": s}) for s, p, t in rows], "source string, page int, text string, metadata map<string,string>")


def test_chunks_have_stable_keys(spark):
    docs = documents(spark, [("a", None, "one two " * 400), ("b", 3, "short"), ("c", None, "")])
    got, again = (chunk_documents(docs).orderBy("source", "chunk_index").collect() for _ in range(2))
    assert got == again and len({r["chunk_id"] for r in got}) == len(got) == 5
    assert got[-1]["metadata"] == {"k": "b"} and got[-1]["page"] == 3 and got[-1]["est_tokens"] == 2


def test_collection_is_idempotent(spark, tmp_path):
    docs = documents(spark, [("a.md", None, "text " * 600), ("b.txt", None, "more")])
    out, enc = str(tmp_path / "kb"), hashing_encoder(16)
    first = build_knowledge_base(docs, out, enc, "one")
    build_knowledge_base(docs, out, enc, "two")
    assert build_knowledge_base(docs, out, enc, "one") == first == Built(2, read_collection(spark, out, "one").count())
    assert read_collection(spark, out, "two").count() == first.chunks
    assert build_knowledge_base(docs.limit(0), out, enc, "one") == Built(0, 0) and read_collection(spark, out, "one").count() == first.chunks
    check_encoder(read_collection(spark, out, "one"), enc)
    with pytest.raises(EncoderMismatch):
        check_encoder(read_collection(spark, out, "one"), hashing_encoder(8))
    assert {r["extension"]: r["documents"] for r in count_by_extension(docs).collect()} == {".md": 1, ".txt": 1}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, None)], "vec_id int, embedding array<float>")
    got = {r["vec_id"]: r["u"] for r in df.select("vec_id", normalise(F.col("embedding")).alias("u")).collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: [1.0, 0.0], 4: None}
    assert [r["vec_id"] for r in top_k_cosine(df.where("embedding is not null"), [1.0, 0.1], 2).collect()] == [3, 1]
    indexed = index_chunks(chunk_documents(documents(spark, [("a", None, "same words"), ("b", None, "same words")])), hashing_encoder(8), "c")
    vectors = [r["embedding"] for r in indexed.collect()]
    assert vectors[0] == vectors[1] and sum(x * x for x in vectors[0]) == pytest.approx(1, abs=1e-6)


def test_sources(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "deep").mkdir(parents=True)
    (root / "a.md").write_bytes(b"one\r\ntwo\rthree")
    (root / "deep/b c+d.txt").write_text("text", encoding="utf-8")
    (root / "B.MD").write_text("not read", encoding="utf-8")
    (root / "x.pdf").write_bytes(b"p1|p2")
    loaders = files.LOADERS | {".pdf": files.pdf_loader(lambda data: data.decode().split("|"))}
    got = sorted((r["source"].rsplit("/", 1)[1], r["page"], r["text"]) for r in files.read_documents(spark, str(root), loaders).collect())
    assert got == [("a.md", None, "one\ntwo\nthree"), ("b c+d.txt", None, "text"), ("x.pdf", 0, "p1"), ("x.pdf", 1, "p2")]
    (tmp_path / "none").mkdir()
    assert files.read_documents(spark, str(tmp_path / "none")).isEmpty()
    with pytest.raises(FileNotFoundError, match="Documents directory not found"):
        files.read_documents(spark, str(tmp_path / "missing"))


def test_submission_files_and_stream(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    for name, data in {"a.py": b"x = 1\n", "empty.py": b"", "big.py": b"#" * 1_048_577, "bad.java": b"class {"}.items():
        (root / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: (r["status"], r["language"], r["is_valid"]) for r in analyze_submissions(files.read_submissions(spark, str(root))).collect()}
    assert got == {"a.py": (200, "python", True), "empty.py": (200, "python", True), "big.py": (413, None, None), "bad.java": (200, "java", False)}
    stream_responses(stream_submissions(spark, str(root)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    rows = {r["path"].rsplit("/", 1)[1]: r["status"] for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert rows == {"a.py": 200, "big.py": 413, "bad.java": 200, "empty.py": 200}


ODD = ["a b.py", "100%.py", "x%20y.py", "c+d.java", "#n.py", "é日.py", "__init__.py", ".hidden.py", "?q=1&r.py"]


def test_odd_names_are_listed_once_and_plain(spark, tmp_path):
    root = tmp_path / "odd dir+%41"
    (root / "deep er" / "empty").mkdir(parents=True)
    for k, name in enumerate(ODD):
        (root / name).write_bytes(b"x = 1\n" * k)  # the first is empty
        (root / "deep er" / name).write_bytes(b"y = 1\n")
    got = files.read_submissions(spark, str(root)).collect()
    assert sorted((r["filename"], r["n_bytes"], len(r["content"])) for r in got) == sorted([(n, 6 * k, 6 * k) for k, n in enumerate(ODD)] + [(n, 6, 6) for n in ODD])
    assert len({r["path"] for r in got}) == 2 * len(ODD)
    plan = files.read_submissions(spark, str(root))._jdf.queryExecution().toString()
    assert not any(n in plan for n in ODD)  # names don't go through the driver
    (tmp_path / "none").mkdir()
    assert files.read_submissions(spark, str(tmp_path / "none")).count() == 0
    stream_responses(stream_submissions(spark, str(root)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    streamed = {r["filename"] for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert streamed == set(ODD)


def test_files_written_and_read(spark, tmp_path):
    rows = [("d/a b.txt", "one"), ("e%.txt", ""), (None, "x"), ("f.txt", None), ("f2.md", "\r\nz")]
    files.write_files(spark.createDataFrame(rows, "name string, content string"), str(tmp_path / "w"))
    got = {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in files.read_files(spark, str(tmp_path / "w")).collect()}
    assert got == {"a b.txt": b"one", "e%.txt": b"", "f2.md": b"\r\nz"}
    assert {(r["source"].rsplit("/", 1)[1], r["text"]) for r in files.read_documents(spark, str(tmp_path / "w")).collect()} == {("a b.txt", "one"), ("e%.txt", ""), ("f2.md", "\nz")}


def test_an_index_is_searched_with_its_own_encoder(spark):
    enc = hashing_encoder(32)
    index = index_chunks(chunk_documents(documents(spark, [("a", None, "red apples"), ("b", None, "blue sky")])), enc, "c")
    assert search(index, "apples that are red", enc, 1).first()["similarity"] > 0
    for other in (None, hashing_encoder(16)):
        with pytest.raises(EncoderMismatch):
            top_k_cosine(index, [0.0] * 32, 1, "chunk_id", encoder=other)
    with pytest.raises(EncoderMismatch):
        search(index, "apples", hashing_encoder(16), 1)


def test_settings_act(spark, tmp_path, monkeypatch):
    docs = documents(spark, [("a.md", None, "word " * 600)])
    monkeypatch.setenv("LOOMWRIGHT_CHUNK_SIZE", "300")
    monkeypatch.setenv("LOOMWRIGHT_CHUNK_OVERLAP", "0")
    monkeypatch.setenv("LOOMWRIGHT_MAX_UPLOAD_BYTES", "4")
    build_knowledge_base(docs, str(tmp_path / "kb"), hashing_encoder(4), "c")
    sizes = [len(r["text"]) for r in read_collection(spark, str(tmp_path / "kb"), "c").collect()]
    assert len(sizes) == 10 and max(sizes) <= 300
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_bytes(b"x = 1")
    assert [r["status"] for r in analyze_submissions(files.read_submissions(spark, str(tmp_path / "in"))).collect()] == [413]


def test_logs_go_to_stdout(capsys):
    logging.getLogger("loomwright").handlers.clear()
    config.configure_logging().info("a line")
    logging.getLogger("loomwright").handlers.clear()
    assert "a line" in capsys.readouterr().out


@pytest.mark.parametrize(("size", "overlap"), [(20, 0), (20, 5), (50, 19), (200, 20), (200, 200)])
def test_chunks_equal_their_statement_in_sql(size, overlap):
    rng = random.Random(size + overlap)
    parts = ["word ", "a", ". ", "\n", "\n\n", "\n## t", "\n### u", "é😀", "\u2003", "x" * 70, "\n\n\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    con = duckdb.connect()
    con.execute("CREATE TABLE r (id INT, t VARCHAR)")
    con.executemany("INSERT INTO r VALUES (?, ?)", list(enumerate(texts)))
    got: dict = {}
    for k, _, chunk in con.execute(f"WITH RECURSIVE {chunk_rows('SELECT id, t FROM r', size, overlap)} SELECT * FROM chunks ORDER BY id, chunk_index").fetchall():
        got.setdefault(k, []).append(chunk)
    assert [got.get(k, []) for k in range(len(texts))] == [split_text(t, size, overlap) for t in texts]


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT detect_language('import x', 'A.JAVA') AS a, detect_language('import x', NULL) AS b, validate_syntax('def f(:', 'python') AS v, size(chunk_array('abc')) AS n").first()
    assert (row["a"], row["b"], row["v"]["is_valid"], row["n"]) == ("java", "python", False, 1)
    got = spark.sql("SELECT d.id, c.* FROM VALUES (1, 'one two three'), (2, '') AS d(id, t), LATERAL chunk_text(d.t, 8, 0) AS c").collect()
    assert [(r["id"], r["chunk_index"], r["chunk"]) for r in sorted(got)] == [(1, 0, "one two"), (1, 1, "three")]


def test_chunks_of_a_table_from_sql(spark):
    sql.register(spark)
    rows = [(1, "one two three", "x", 7), (2, "", "y", 8), (None, None, None, None), (4, "four", "z", 9)]
    spark.createDataFrame(rows, "id int, text string, chunk string, n int").createOrReplaceTempView("t_docs")
    got = spark.sql("SELECT * FROM chunk_documents(TABLE(t_docs), 8, 0)")
    assert got.columns == ["id", "chunk", "n", "chunk_index", "chunk_"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, "x", 7, 0, "one two"), (1, "x", 7, 1, "three"), (4, "z", 9, 0, "four")]
    named = spark.sql("SELECT * FROM chunk_documents(TABLE(SELECT id, text AS body FROM t_docs), text_column => 'body')")
    assert sorted(tuple(r) for r in named.collect()) == [(1, 0, "one two three"), (4, 0, "four")]
    with pytest.raises(Exception, match="column html"):
        spark.sql("SELECT * FROM chunk_documents(TABLE(t_docs), text_column => 'html')").collect()


def test_admission_and_vectors_from_sql(spark, monkeypatch):
    monkeypatch.setenv("LOOMWRIGHT_MAX_UPLOAD_BYTES", "4")
    sql.register(spark)
    row = spark.sql("SELECT admit('x', NULL).status AS a, admit(NULL, NULL).detail AS b, admit(NULL, X'FF').status AS c, admit(NULL, X'6161616161').status AS d, admit('', X'61').status AS e, text_length('é😀') AS n, round(cosine(array(3D, 4D), array(6D, 8D)), 9) AS s, l2_normalise(array(0D)) AS z").first()
    assert tuple(row) == (200, "Provide either 'code' (pasted text) or 'file' (upload), not neither.", 400, 413, 400, 2, 1.0, [0.0])
    df = spark.createDataFrame([(None, bytearray(b"abcde"))], "code string, content binary")
    assert df.select(status_and_detail(F.col("code"), F.col("content")).alias("v")).first()["v"]["status"] == 413


def test_settings_reach_every_entry_point(spark, monkeypatch):
    monkeypatch.setenv("LOOMWRIGHT_CHUNK_SIZE", "8")
    monkeypatch.setenv("LOOMWRIGHT_CHUNK_OVERLAP", "0")
    sql.register(spark)
    df = spark.createDataFrame([("a", None, "one two three", None)], "source string, page int, text string, metadata map<string,string>")
    df.createOrReplaceTempView("t_set")
    assert [r["text"] for r in chunk_documents(df).collect()] == ["one two", "three"]
    assert spark.sql("SELECT chunk_array(text) FROM t_set").first()[0] == ["one two", "three"]
    assert spark.sql("SELECT count(*) FROM t_set, LATERAL chunk_text(text)").first()[0] == 2
    assert spark.sql("SELECT count(*) FROM chunk_documents(TABLE(t_set))").first()[0] == 2


def test_chunks_of_a_long_text_without_separators_are_quick():
    text = "x" * 2_000_000
    began = time.perf_counter()
    assert sum(map(len, split_text(text, 1200, 0))) == len(text)
    assert time.perf_counter() - began < 0.5


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("LOOMWRIGHT_CHUNK_SIZE=900\nOTHER=1\n# no\n", encoding="utf-8")
    got = config.Settings.load({"LOOMWRIGHT_LOG_LEVEL": "debug"}, str(tmp_path / ".env"))
    assert (got.chunk_size, got.log_level, got.chunk_overlap) == (900, "debug", 200)
