"""Cases that a round's findings named."""

from __future__ import annotations

import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import functions as F

from loomwright.operators import chunk, embed, vector_search
from loomwright.plans import catalog
from loomwright.sources import files, listing


def test_words_that_cancel_out_have_a_direction(spark, tmp_path):
    texts = ["word18 word21", "WORD21, word18.", "word18 word18 word21 word21", "... !", "one two three", "", None]
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": texts, "source": ["s"] * len(texts)}), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    got = catalog.index_documents(spark, str(tmp_path))
    wanted = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLES['index_documents']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(wanted)


def test_the_best_of_a_block_are_found_in_little_memory():
    rng = np.random.default_rng(2)
    a, ids = rng.integers(0, 40, (2048, 1)) / 7, pa.array(np.arange(2048))
    best = vector_search._Best(ids, 10)
    tracemalloc.start()
    for k in range(2):  # two blocks of vectors, with many ties
        best.meet(np.arange(2048)[::-1] + 2048 * k, lambda strip, k=k: np.round(np.sin(a[strip] * (np.arange(2048) % 300 + k)), 2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20  # a matrix of 2048 x 2048 has as much
    found = pa.Table.from_batches(best.rows()).to_pydict()
    assert len(found["query"]) == 2048 * 10
    for q in range(0, 2048, 97):
        every = [(-s, key) for k in range(2) for key, s in zip(np.arange(2048)[::-1] + 2048 * k, np.round(np.sin(a[q] * (np.arange(2048) % 300 + k)), 2), strict=True)]
        assert [(-s, i) for i, s in zip(found["id"][q * 10 : q * 10 + 10], found["similarity"][q * 10 : q * 10 + 10], strict=True)] == sorted(every)[:10]


def test_strips_and_blocks_find_what_all_pairs_find(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_search, "STRIP", 7)
    monkeypatch.setattr(vector_search, "BLOCK", 64)
    rng = np.random.default_rng(3)
    m = np.repeat(rng.normal(0, 1, (60, 8)), 5, 0)  # copies: ties by key
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "vec_id long, embedding array<double>").repartition(3)
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    wanted = [(q, [i for _, i in sorted((-round(float(s), 9), i) for i, s in enumerate(unit[q] @ unit.T))][:5]) for q in range(300)]
    near = lambda df: [(q, [r["id"] for r in sorted(df_rows, key=lambda r: r["rank"])]) for q, df_rows in sorted(_by_query(df).items())]
    assert near(vector_search.nearest(rows, rows, 5)) == wanted
    index = vector_search.build_index(rows, str(tmp_path / "ivf"), cells=4)
    assert near(vector_search.search_index(spark, index, rows, 5, probes=4, rerank=60)) == wanted


def _by_query(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query"], []).append(r)
    return out


def test_texts_are_split_and_encoded_in_slices(spark):
    lines = lambda k: "\n".join(f"line {k} {i}" for i in range(5000))
    rows = spark.createDataFrame([(k, None if k == 3 else "" if k == 5 else lines(k)) for k in range(60)], "k int, text string").coalesce(1)
    got = dict(rows.select("k", chunk.chunks_of(F.col("text"))).collect())
    assert got == {k: chunk.split_text(None if k == 3 else "" if k == 5 else lines(k)) for k in range(60)}
    most = spark.sparkContext.accumulator((0, 0), Most())

    def load():
        def run(texts):
            most.add((sum(map(len, texts)), len(texts)))
            return [[float(len(t)), 1.0] for t in texts]

        return run

    texts = rows.unionByName(spark.range(5000).selectExpr("cast(id + 60 as int) AS k", "'short' AS text")).coalesce(1)
    coded = dict(texts.select("k", embed.embed(F.col("text"), embed.Encoder("counted", 2, load))).collect())
    assert len(coded) == 5060 and all(v == [float(len(lines(k))) if k < 60 and k not in (3, 5) else 5.0 if k >= 60 else 0.0, 1.0] for k, v in coded.items())
    assert most.value[0] <= 2 << 20 < sum(len(lines(k)) for k in range(60)) and most.value[1] <= 1024


def test_tasks_follow_the_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "TASK_FILES", 20)
    monkeypatch.setattr(files, "TASK_BYTES", 5000)
    monkeypatch.setattr(listing, "PAGE", 30)
    at = str(tmp_path / "many")
    texts = {("deep/x/" if k % 5 == 0 else "") + f"f {k}.txt": "x" * k for k in range(300)}
    files.write_files(spark.createDataFrame([*texts.items(), ("none", None)], "name string, content string").coalesce(1), at)
    listed = files.list_files(spark, at)
    shares = [len(p) for p in files.read_listed(listed).select("path").rdd.glom().collect()]
    assert len(shares) >= 15 and max(shares) < 60  # 4 tasks of this session had 300 files
    few = files.read_listed(listed.where("n_bytes < 5"))
    assert few.rdd.getNumPartitions() == 4 and few.count() == 5
    monkeypatch.setattr(files, "TASK_FILES", 10_000)
    assert files.read_listed(listed).rdd.getNumPartitions() == 9  # 44,850 bytes
    found = {r["path"].split("/many/")[1]: bytes(r["content"]).decode() for r in files.read_files(spark, at).collect()}
    assert found == texts


class Most(AccumulatorParam):
    """The largest of each of two numbers."""

    def zero(self, value):
        return (0, 0)

    def addInPlace(self, a, b):  # noqa: N802
        return max(a[0], b[0]), max(a[1], b[1])
