"""Versions of a collection: what a change costs, what a lost build leaves, what another encoder may do."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomwright.operators import embed
from loomwright.operators.embed import Encoder, EncoderMismatch, hashing_encoder
from loomwright.operators.search import search_collection
from loomwright.plans import knowledge_base
from loomwright.plans.knowledge_base import build_knowledge_base
from loomwright.sources import collection as store
from loomwright.streaming import sink


def documents(spark, texts, meta="m"):
    rows = [(f"d{k}", None if k % 2 else k, t, {"of": meta}) for k, t in texts.items()]
    return spark.createDataFrame(rows, "source string, page int, text string, metadata map<string,string>").repartition(3)


def held(spark, path, **kw):
    rows = store.read_collection(spark, path, "c", **kw).collect()
    assert len({r["chunk_id"] for r in rows}) == len(rows)
    return sorted((r["source"], r["page"], r["chunk_index"], r["text"], r["metadata"]["of"], tuple(r["embedding"])) for r in rows)


def build(spark, path, texts, meta="m", enc=None, size=40):
    return build_knowledge_base(documents(spark, texts, meta), path, enc or hashing_encoder(8), "c", size, 5)


@pytest.fixture(scope="module")
def texts():
    return {k: f"document {k} " + "with some more words " * (k % 9) for k in range(200)}


def test_a_change_costs_what_changed(spark, tmp_path, texts):
    path, fresh = str(tmp_path / "kb"), str(tmp_path / "fresh")
    first = build(spark, path, texts)
    assert first.encoded == first.chunks == len(held(spark, path))
    assert build(spark, path, texts).encoded == 0 and store.versions(spark, path, "c") == [1]
    after = {k: t for k, t in texts.items() if k not in (3, 4)} | {7: "another text", 500: "a new one"}
    changed = build(spark, path, after)
    assert (changed.encoded, changed.left) == (2, 3)
    assert build(spark, fresh, after) == changed and held(spark, path) == held(spark, fresh)
    assert held(spark, path, version=1) == held(spark, path, version=1) != held(spark, path)
    # Back to the first texts: what had left is written anew, and not shadowed by its leaving.
    build(spark, path, texts)
    assert held(spark, path) == held(spark, path, version=1)
    store.compact(spark, path, "c")
    told = store.manifest(spark, path, "c")
    assert len(told.parts) == 1 and not told.gone and held(spark, path) == held(spark, path, version=1)
    assert store.expire(spark, path, "c") > 0 and store.versions(spark, path, "c") == [4]
    assert build(spark, path, texts).encoded == 0 and len(held(spark, path)) == first.chunks


def test_encodings_are_counted_where_they_happen(spark, tmp_path, texts):
    count = spark.sparkContext.accumulator(0)

    def load():
        run = hashing_encoder(8).load()

        def encode(batch):
            count.add(len(batch))
            return run(batch)

        return encode

    enc = Encoder("counted", 8, load)
    path = str(tmp_path / "kb")
    build(spark, path, texts, enc=enc)
    before = count.value
    built = build(spark, path, texts | {k: f"changed {k}" for k in (10, 20)}, enc=enc)
    assert count.value - before == built.encoded == 2


def test_metadata_and_copies(spark, tmp_path):
    path = str(tmp_path / "kb")
    one = documents(spark, {1: "same text", 2: ""})
    both = one.unionByName(one).unionByName(documents(spark, {1: "same text"}, "other"))
    built = build_knowledge_base(both, path, hashing_encoder(8), "c", 40, 5)
    assert (built.documents, built.chunks) == (5, 1)
    chosen = held(spark, path)[0][4]
    again = build(spark, path, {1: "same text", 2: ""}, "new")
    assert again.encoded == 1 and chosen in ("m", "other") and held(spark, path)[0][4] == "new"
    odd = spark.createDataFrame([("x", None, "t", None), (None, None, "t", None), ("y", 1, None, {})], "source string, page int, text string, metadata map<string,string>")
    assert build_knowledge_base(odd, path, hashing_encoder(8), "c", 40, 5).chunks == 2


def test_a_lost_build_leaves_the_collection_as_it_was(spark, tmp_path, texts, monkeypatch):
    path = str(tmp_path / "kb")
    build(spark, path, texts)
    before = held(spark, path)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", lost)
        with pytest.raises(RuntimeError, match="lost"):
            build(spark, path, {1: "other"})
    assert held(spark, path) == before

    def broken():
        return lost

    with pytest.raises(Exception, match="lost"):
        build(spark, path, {1: "other"}, enc=Encoder("hashing-8", 8, broken))
    assert held(spark, path) == before and store.versions(spark, path, "c") == [1]
    with monkeypatch.context() as m:  # of two builds on one version the second is refused
        m.setattr(store, "_publish", lambda *a: False)
        with pytest.raises(store.CollectionChanged):
            build(spark, path, {1: "other"})
    assert held(spark, path) == before
    assert build(spark, path, {1: "other"}).chunks == 1


def test_encoder_and_sizes_are_the_manifests(spark, tmp_path, texts, monkeypatch):
    path = str(tmp_path / "kb")
    first = build(spark, path, texts)
    for other in (hashing_encoder(16), Encoder("x", 8, hashing_encoder(8).load)):
        with pytest.raises(EncoderMismatch):
            build(spark, path, texts, enc=other)
        with pytest.raises(EncoderMismatch):
            search_collection(spark, path, "words", other, 3, "c")
    monkeypatch.setattr(embed, "check_encoder", None)  # nothing scans for it
    found = search_collection(spark, path, "document 17", hashing_encoder(8), 3, "c")
    assert "distinct" not in found._jdf.queryExecution().toString().lower() and found.count() == 3
    wider = build(spark, path, texts, size=80)
    assert wider.encoded == wider.chunks < first.chunks and len(held(spark, path)) == wider.chunks
    with pytest.raises(FileNotFoundError):
        store.read_collection(spark, path, "none")


def test_odd_collection_names(spark, tmp_path, texts):
    path = str(tmp_path / "kb")
    for name in ("a/b", "a=b c%", "é"):
        knowledge_base.build_knowledge_base(documents(spark, {1: name}), path, hashing_encoder(8), name)
        assert [r["text"] for r in store.read_collection(spark, path, name).collect()] == [name]


def test_a_batch_that_runs_twice_leaves_one_copy(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "x = 1", None, None), (2, None, None, "a.py"), (3, None, bytearray(b"class A {}"), "A.java")], "id int, code string, content binary, filename string")
    with monkeypatch.context() as m:  # lost after the batch was written and before it was published
        m.setattr(sink, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            sink.write_batch(rows, 0, out)
    with pytest.raises(FileNotFoundError):
        sink.read(spark, out)
    assert sink.write_batch(rows, 0, out) and not sink.write_batch(rows, 0, out)
    assert sorted((r["id"], r["status"], r["kind"]) for r in sink.read(spark, out).collect()) == [(1, 200, "answers"), (2, 400, "rejects"), (3, 200, "answers")]
    assert sink.write_batch(rows.where("id = 2").withColumn("id", F.lit(9)), 1, out)
    assert sorted(r["id"] for r in sink.read(spark, out, "rejects").collect()) == [2, 9]
