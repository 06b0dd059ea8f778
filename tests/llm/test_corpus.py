"""Operators over the whole corpus: near copies, the two classifiers, and the pipeline."""

from __future__ import annotations

import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import jaccard_join as jj
from loomwright.llm import quality_pu, toxicity
from loomwright.llm.common import Bloom, materialise

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_links(rows):
    """Class and number of links of each row, by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = [0] * len(rows)
    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    classes: dict = {}
    for k, (doc_id, _) in enumerate(rows):
        classes.setdefault(find(k), []).append(doc_id)
    return {doc_id: (min(classes[find(k)]), links[k], len(classes[find(k)])) for k, (doc_id, _) in enumerate(rows)}


def near_copy_corpus(rng, groups, singles):
    """Texts of random words: groups of copies with a few words changed, some exact, and a passage that many share."""
    words = [f"w{k}" for k in range(3000)]
    passage = " ".join(rng.choices(words, k=70))
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 120))) + (" " + passage if rng.random() < 0.4 else "") for _ in range(singles)]
    for size in groups:
        base = rng.choices(words, k=rng.randint(60, 200))
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_shingles_are_word_stretches():
    rng = random.Random(0)
    for _ in range(500):
        a, b = ("".join(rng.choice(["a", "b", " ", "\n", "é", "\xa0", "\t", "ab "]) for _ in range(rng.randint(0, 40))) for _ in range(2))
        x, y = jj.shingles(a), jj.shingles(b)
        assert (len(x), len(y)) == (len(shingle_set(a)), len(shingle_set(b)))
        assert len(np.intersect1d(x, y)) == len(shingle_set(a) & shingle_set(b))
    assert len(jj.shingles(None)) == len(jj.shingles(" \n")) == 0 and len(jj.shingles("one two")) == 1


@pytest.mark.parametrize(("limit", "block"), [(128, 256), (6, 5)])
def test_join_finds_every_link(spark, monkeypatch, limit, block):
    """With small limits the same rows go through deep paths, dense nodes and pairs of blocks."""
    monkeypatch.setattr(jj, "LIMIT", limit)
    monkeypatch.setattr(jj, "BLOCK", block)
    rows = near_copy_corpus(random.Random(11), [2, 2, 3, 5, 8, 60], 150) + [(900, ""), (901, None), (902, " "), (903, "few words"), (904, "few words")]
    df = spark.createDataFrame([(*r, "x", b"y") for r in rows], "doc_id long, text string, fp string, tokens binary").repartition(3)
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["class_size"]) for r in jj.near_duplicates(df).collect()}
    want = brute_links(rows)
    assert got == want
    kept = jj.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c, _, _ in want.values()})


def pairs_in(placed):
    """How many pairs the places hold."""
    sides = [F.count_if(F.col("side") == k).alias(f"n{k}") for k in (1, 2, 3)]
    own = F.col("n1") * F.col("n2") + F.col("n3") * (F.col("n1") + F.col("n2")) + F.col("n3") * (F.col("n3") - 1) / 2
    return placed.groupBy("leaf", "a", "b").agg(*sides).agg(F.sum(own)).first()[0] or 0


@pytest.mark.parametrize("bodies", [(60, 80), (25, 35), (0, 40), (5, 14)])
def test_a_shared_passage_is_no_reason_to_compare(spark, monkeypatch, bodies):
    """Texts that share most of their words, some of them copies: every link is found, and far fewer pairs than all are compared where there are few."""
    monkeypatch.setattr(jj, "LIMIT", 12)
    monkeypatch.setattr(jj, "BLOCK", 8)
    monkeypatch.setattr(jj, "SAMPLE", 24)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(9000)]
    passage = rng.choices(words, k=120)
    texts = [passage + rng.choices(words, k=rng.randint(*bodies)) for _ in range(260)]
    for _ in range(40):
        copy = list(rng.choice(texts))
        copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(copy)
    rows = list(enumerate(map(" ".join, texts)))
    seen, screened = [], jj._screened
    monkeypatch.setattr(jj, "_screened", lambda placed, s: (seen.append(pairs_in(placed)), screened(placed, s))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["class_size"]) for r in jj.near_duplicates(df).collect()}
    want = brute_links(rows)
    assert got == want
    links = sum(n for _, n, _ in want.values()) / 2
    assert links < 100 or bodies[0] < 25
    if links < 100:
        assert seen[0] < 0.05 * len(rows) ** 2 / 2


def layered_corpus(rng, n, kind):
    """Texts of a site: a passage of the site, one of its sections or some blocks of them, and words of their own."""
    words = [f"w{k}" for k in range(50_000)]
    passage, sections, blocks = rng.choices(words, k=120), [rng.choices(words, k=60) for _ in range(3)], [rng.choices(words, k=20) for _ in range(12)]
    if kind == "sections":
        return [" ".join(passage + rng.choice(sections) + rng.choices(words, k=40)) for _ in range(n)]
    return [" ".join(passage[:60] + sum((blocks[k] for k in sorted(rng.sample(range(12), 6))), []) + rng.choices(words, k=25)) for _ in range(n)]


def links_by_matrix(rows):
    """The number of links of each row, from all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    number: dict = {}
    ids = [np.array([number.setdefault(x, len(number)) for x in s]) for s in sets]
    both = np.zeros((len(rows), len(rows)), np.float32)
    for at in range(0, len(number), 4000):
        part = np.zeros((len(rows), 4000), np.float32)
        for i, own in enumerate(ids):
            part[i, own[(own >= at) & (own < at + 4000)] - at] = 1
        both += part @ part.T
    size = np.array([len(s) for s in sets])
    linked = both >= 0.8 * (size[:, None] + size[None] - both)
    np.fill_diagonal(linked, False)
    return linked.sum(1)


@pytest.mark.parametrize(("kind", "most"), [("sections", 0.01), ("blocks", 0.12)])
def test_layers_of_boilerplate_are_no_reason_to_compare(spark, monkeypatch, kind, most):
    """At the limits in use: pairs placed are a small part of all pairs, and every link is found."""
    rng = random.Random(6)
    texts = layered_corpus(rng, 3000, kind)
    for k in range(60):
        copy = texts[k].split()
        copy[rng.randrange(len(copy))] = "changed"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    seen, screened = [], jj._screened
    monkeypatch.setattr(jj, "_screened", lambda placed, s: (seen.append(pairs_in(placed)), screened(placed, s))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["n_links"] for r in jj.near_duplicates(df).collect()}
    assert [got[k] for k, _ in rows] == links_by_matrix(rows).tolist()
    assert seen[0] < most * len(rows) ** 2 / 2


@pytest.mark.parametrize("crowded", [10, 60])
def test_crowded_leaves_are_gone_through_again(spark, monkeypatch, crowded):
    """With a low limit the leaves of dense nodes are dense nodes themselves, twice over: the links stay the same."""
    monkeypatch.setattr(jj, "LIMIT", 12)
    monkeypatch.setattr(jj, "CROWDED", crowded)
    rng = random.Random(crowded)
    texts = layered_corpus(rng, 150, "blocks") + layered_corpus(rng, 150, "sections")
    for k in range(0, 300, 6):
        copy = texts[k].split()
        copy[rng.randrange(len(copy))] = "changed"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["n_links"] for r in jj.near_duplicates(df).collect()}
    assert [got[k] for k, _ in rows] == links_by_matrix(rows).tolist()


def text_moved(df, name="text"):
    """Exchanges of the plan that move a column of whole texts."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        names = node.output().mkString(",")
        if node.nodeName() == "Exchange" and re.search(rf"(?<!\w){name}#", names):
            found.append(node)
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return found


def unfiltered(node):
    """Whether texts come into an exchange straight from their scan, with no Bloom filter between."""
    text = node.toString()
    return "LeftSemi" not in text


def test_texts_move_only_behind_a_filter(spark, tmp_path):
    texts = " ".join(f"w{k}" for k in range(30))
    spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit(texts), F.col("id") % 400).alias("text")).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    wanted = docs.select(F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("fp")).limit(20)
    wanted.write.parquet(str(tmp_path / "wanted"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert not text_moved(jj._tokens(docs, spark.read.parquet(str(tmp_path / "wanted"))))
        moved = text_moved(jj.one_of_each(docs))
        assert moved and not any(map(unfiltered, moved))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """With one block for thousands of keys nearly every row passes the filters: the results are the same."""
    rows = near_copy_corpus(random.Random(12), [2, 3, 30], 60) + [(5000, "one text"), (5000, "one text"), (None, "one text"), (None, None), (None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, _row_key int").repartition(3)
    expected = sorted(map(str, jj.one_of_each(df).collect()))
    before = Bloom.__init__

    def full(self, keys, most=1):
        before(self, keys, 1)
        self.table = spark.range(1).select(F.lit(0).alias("block"), F.unhex(F.repeat(F.lit("FF"), 4096)).alias("bits"))

    monkeypatch.setattr(Bloom, "__init__", full)
    assert sorted(map(str, jj.one_of_each(df).collect())) == expected
    assert jj.one_of_each(df).columns == df.columns


def test_bloom_filter(spark):
    keys = materialise(spark.range(3000).select((F.col("id") * 7919).alias("k")), "keys")
    rows = spark.range(60_000).select((F.col("id") * 7919).alias("k"), F.lit(1).alias("_bloom_bits")).unionByName(spark.sql("SELECT CAST(NULL AS LONG) AS k, 1 AS _bloom_bits"))
    found = Bloom(keys)
    inside, outside = found.among(rows, "k"), found.apart(rows, "k")
    assert found.among(keys, "k").count() == 3000 and 3000 <= inside.count() < 3600 and inside.count() + outside.count() == 60_001
    assert inside.columns == rows.columns and not outside.where("k is null").isEmpty()
    assert Bloom(materialise(keys.limit(0), "keys")).among(rows, "k").count() == 0


def test_runs_follow_the_recall():
    assert jj.runs(0.8, 0.9999) == 4 and jj.runs(0.8, 0.99) < jj.runs(0.8, 0.999999)


def test_join_of_odd_rows(spark):
    text = "seven words that are the same here"
    rows = [(None, text), (None, text), (5, text), (5, text), (7, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"], r["class_id"], r["n_links"], r["class_size"]) for r in jj.near_duplicates(df).where("doc_id is not null or class_id is not null").collect())
    assert [g[2:] for g in got] == [(5, 3, 4), (5, 3, 4), (7, 0, 1), (5, 3, 4), (5, 3, 4)]
    assert sorted(str(r["text"]) for r in jj.one_of_each(df).collect()) == ["", "None", text]
    assert jj.near_duplicates(df.limit(0)).count() == 0 and jj.one_of_each(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5)]
    root = {n: n for e in edges for n in e}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["label"] for r in jj.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    alone = {n for n in root if all(a == b for a, b in edges if n in (a, b))}
    assert got == {n: find(n) for n in root if n not in alone}


# --- classifiers ---


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"))
    return (rank[label].mean() - (label.sum() - 1) / 2) / (~label).sum()


def labelled(spark, rng, n, make):
    """Documents, and labels of the half whose ids are even."""
    rows = [(k, *make(rng)) for k in range(n)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t), 1) for k, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long, quality int")
    labels = spark.createDataFrame([(k, int(y), int(y)) for k, _, y in rows if k % 2 == 0], "doc_id long, quality int, toxic int")
    return docs, labels, {k: y for k, _, y in rows}


def prose_or_junk(rng):
    words = ["".join(rng.choice(["ar", "en", "to", "is", "ou", "le"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 90))]
    if rng.random() < 0.75:
        return ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, len(words), 9)) + ".", True
    kind = rng.randrange(3)
    return (" ".join(w + "###" for w in words), " ".join(w.upper() + "!!" for w in words), " ".join(w for w in words[:6] for _ in range(9)))[kind], False


def rude_or_not(rng):
    words = ["".join(rng.choice(["ar", "en", "to", "is", "ou", "le", "mor"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 90))]
    rude = rng.random() < 0.3
    if rude:
        words[rng.randrange(len(words))] = rng.choice(["moron", "idiotic", "idiots"])
    return " ".join(words), rude


@pytest.mark.parametrize(("module", "make"), [(quality_pu, prose_or_junk), (toxicity, rude_or_not)])
def test_held_out_accuracy(spark, module, make):
    docs, labels, truth = labelled(spark, random.Random(4), 1600, make)
    rows = module.score_documents(docs, labels).collect()
    assert len(rows) == 1600
    for r in rows:
        assert r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= module.THRESHOLD)
    # Rows whose labels nothing has learnt from: the held-out fold and those without a label.
    unseen = [r for r in rows if r["held_out"] or r["doc_id"] % 2]
    label = np.array([truth[r["doc_id"]] for r in unseen])
    assert auc(np.array([r["score"] for r in unseen]), label) > 0.97
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in unseen]) > 0.93


@pytest.mark.parametrize("module", [quality_pu, toxicity])
def test_held_out_labels_and_other_columns_do_not_matter(spark, module):
    docs, labels, _ = labelled(spark, random.Random(5), 300, prose_or_junk)
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.col("quality"))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    a, b = ({r["doc_id"]: r["score"] for r in module.score_documents(d, y).collect()} for d, y in ((docs, labels), (other, turned)))
    assert a == pytest.approx(b, abs=1e-9)


@pytest.mark.parametrize("module", [quality_pu, toxicity])
def test_classifiers_of_odd_rows(spark, module):
    rows = [(1, "text", None), (1, "text", None), (None, None, "a"), (2, "", "b"), (3, "long " * 50_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for d, y in ((docs, labels), (docs, labels.limit(0)), (docs.limit(0), labels)):
        got = module.score_documents(d, y).collect()
        assert len(got) == d.count() and all(0 <= r["score"] <= 1 for r in got)


def plain_risk(p, u, w, prior):
    """The risk as a sum over rows."""
    loss = lambda x, y: np.log1p(np.exp(-y * float(x @ w)))
    positive = prior * np.mean([loss(x, 1) for x in p])
    negative = np.mean([loss(x, -1) for x in u]) - prior * np.mean([loss(x, -1) for x in p])
    return positive + max(0.0, negative), negative


@pytest.mark.parametrize("shift", [0.0, -3.0])
def test_risk_and_its_gradient(shift):
    """Against the plain sums and their differences; below zero the step raises the negatives' risk."""
    rng = np.random.default_rng(1)
    p, u, w = rng.normal(0.8, 1, (30, 4)), rng.normal(0, 1, (50, 4)) + shift, rng.normal(0, 1, 4)
    w = np.abs(w) if shift else w
    risk, grad = quality_pu.risk_gradient(p, u, w, 0.7)
    want, negative = plain_risk(p, u, w, 0.7)
    assert risk == pytest.approx(want) and (negative < 0) == bool(shift)
    part = lambda w: plain_risk(p, u, w, 0.7)[1 if shift else 0]
    slope = np.array([(part(w + d) - part(w - d)) / 2e-6 for d in np.eye(4) * 1e-6])
    assert grad == pytest.approx(-slope if shift else slope, abs=1e-6)


def test_samples_are_bounded_and_copies_count_once(spark, monkeypatch):
    monkeypatch.setattr(quality_pu, "POSITIVES", 20)
    monkeypatch.setattr(quality_pu, "UNLABELLED", 40)
    rows = [(k, "a" * (k % 23 + 1) + " " + "B" * (k // 23 + 1)) for k in range(300)] + [(5, "one text again and again")] * 400 + [(5, "five " + "C," * k) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, 1) for k in range(0, 300, 5)] + [(5, 0)], "doc_id long, quality int")
    p, u = quality_pu._samples(docs, labels)
    again = quality_pu._samples(docs.repartition(7), labels)
    assert len(p) == 20 and 10 <= len(u) <= 40
    assert (p == again[0]).all() and (u == again[1]).all()
    # Every row drawn is another.
    assert len({x.tobytes() for x in u}) > 0.8 * len(u)


def test_toxic_counts_and_ratios_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FEATURES", 300)
    docs, labels, truth = labelled(spark, random.Random(7), 400, rude_or_not)
    twice = docs.unionByName(docs.where("doc_id < 40"))
    sample = toxicity.training_rows(twice, labels, "toxic")
    rows = sample.collect()
    learnt = [k for k in range(0, 400, 2) if not held(k)]
    assert sorted(r["text"] for r in rows) == sorted(r["text"] for r in docs.collect() if r["doc_id"] in learnt)
    counts = toxicity.materialise(toxicity.class_counts(sample), "counts")
    got = {r["slot"]: (r["clean"], r["toxic"]) for r in counts.collect()}
    want: dict = {-1: [0, 0]}
    for r in rows:
        want[-1][r["label"]] += 1
        for h in set(toxicity.hashed(r["text"]).tolist()):
            want.setdefault(h, [0, 0])[r["label"]] += 1
    assert got == {k: tuple(v) for k, v in want.items()}
    n0, n1 = want.pop(-1)
    width = len(toxicity.ORDERS) << toxicity.BITS
    s0, s1 = (sum(v[y] for v in want.values()) + width for y in (0, 1))

    def apart(v):
        both = sum(v) / (n0 + n1)
        return abs(v[1] / n1 - v[0] / n0) / np.sqrt(both * (1 - both) * (1 / n0 + 1 / n1) + 1e-9)

    best = sorted((k for k, v in want.items() if sum(v) >= toxicity.SEEN), key=lambda k: (-round(apart(want[k]), 9), k))[:300]
    found = {r["slot"]: r["ratio"] for r in toxicity.telling(counts)}
    assert len(set(best) & set(found)) >= 299  # the last may tie
    for k, ratio in found.items():
        assert ratio == pytest.approx(np.log((want[k][1] + 1) / s1) - np.log((want[k][0] + 1) / s0))


def test_regression_reaches_the_least_loss():
    """The fitted weights have no slope left, by differences of the plainly written loss."""
    rng = np.random.default_rng(2)
    x = (rng.random((120, 5)) < 0.4).astype(float)
    y = (rng.random(120) < 1 / (1 + np.exp(-(x @ [2, -1, 0.5, 0, 1] - 1)))).astype(float)
    scale = np.array([1.0, 0.5, 2.0, 1.0, -1.0])
    row, col = np.nonzero(x)
    w, base = toxicity._fit(y, row, col, scale, rounds=6000)

    def loss(v):
        z = (x * scale) @ v[:5] + v[5]
        return (np.logaddexp(0, z) - y * z).mean() + toxicity.PENALTY / 2 * (v[:5] ** 2).sum()

    v = np.append(w, base)
    slope = [(loss(v + d) - loss(v - d)) / 2e-5 for d in np.eye(6) * 1e-5]
    assert np.abs(slope).max() < 2e-3


def test_best_threshold():
    labels, z = np.array([0, 0, 1, 0, 1, 1.0]), np.array([-5.0, -4.0, -3.0, -2.0, 1.0, 2.0])
    best = toxicity.best_threshold(labels, z)

    def f1(c):
        hit = ((z >= c) & (labels == 1)).sum()
        return 2 * hit / ((z >= c).sum() + labels.sum())

    assert f1(best) == max(f1(c) for c in [-9, *z, 9])
    assert toxicity.best_threshold(np.array([0.0, 1.0]), np.array([-3.0, 2.0])) == pytest.approx(-0.5) or toxicity.best_threshold(np.array([0.0, 1.0]), np.array([-3.0, 2.0])) == 0.0
    assert toxicity.best_threshold(np.zeros(3), np.array([1.0, 2.0, 3.0])) == 0.0
    assert toxicity.best_threshold(np.array([0.0, 1.0, 0.0, 1.0]), np.array([1.0, 1.0, 1.0, 1.0])) == 0.0  # ties share a verdict


def test_equal_texts_get_equal_scores(spark):
    docs, labels, _ = labelled(spark, random.Random(9), 200, rude_or_not)
    copies = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000)).unionByName(docs.limit(50))
    for module in (quality_pu, toxicity):
        rows = module.score_documents(copies, labels).withColumn("of", F.col("doc_id") % 1000).groupBy("of").agg(F.countDistinct("score").alias("s"), F.countDistinct("predicted").alias("p")).where("s > 1 or p > 1")
        assert rows.isEmpty()


def test_prior_is_near_the_share():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.9):
        positive = rng.normal(2, 1, 4000)
        mixed = np.concatenate([rng.normal(2, 1, int(8000 * share)), rng.normal(-3, 1, 8000 - int(8000 * share))])
        assert abs(quality_pu.estimate_prior(positive, mixed) - share) < 0.06


def test_prior_equals_its_plain_statement():
    """The least ratio of the upper tails over the thresholds where enough positives are above."""
    rng = np.random.default_rng(3)
    for n, m in ((1, 5), (40, 300), (500, 200)):
        positive, mixed = rng.normal(1, 1, n).round(1), np.concatenate([rng.normal(1, 1, m // 2), rng.normal(-2, 1, m - m // 2)]).round(1)
        slack = (np.log(4 / 0.1) / 2 / m) ** 0.5 + (np.log(4 / 0.1) / 2 / n) ** 0.5
        found = []
        for cut in np.unique(np.quantile(np.concatenate([positive, mixed]), [k / 400 for k in range(401)])):
            p, u = sum(x >= cut for x in positive) / n, sum(x >= cut for x in mixed) / m
            if p > 0.05:
                found.append(((u + slack) / p, u / p))
        best = min(found, key=lambda x: x[0])[0]
        assert any(quality_pu.estimate_prior(positive, mixed) == pytest.approx(min(0.98, max(0.02, r))) for value, r in found if value <= best + 1e-12)


CLASSES = ("\n", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"-()", "!?#*$%&|<>@^_`~=+/\\{}[]")


def class_of(byte):
    if byte > 127:
        return 8
    c = chr(byte)
    return 1 if c in " \t\r\x0b\x0c" else next((k for k, chars in enumerate(CLASSES, 2) if c in chars), 0)


def test_features_equal_their_plain_statement():
    import math
    import zlib as z
    from collections import Counter as C

    rng = random.Random(9)
    parts = ["word", "Word", "x1", "é", "日本", "\0", " ", "\n", "\t", ". ", "!?", "the the ", "\n\nline\n", "long" * 30]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["", None, " \n ", "a", "ab", "same line\nsame line\n" * 5]
    for text in texts:
        got = quality_pu.features(text)
        words = (text or "").split()
        if not words:
            assert not got.any()
            continue
        raw = text.encode()
        cs = [class_of(b) for b in raw]
        want = []
        for size in (1, 2, 3):
            grams = C(tuple(cs[k : k + size]) for k in range(len(cs) - size + 1))
            total = max(1, sum(grams.values()))
            names = [()]
            for _ in range(size):
                names = [(*n, c) for n in names for c in range(9)]
            want += [math.sqrt(grams[n] / total) for n in names]
        n, lines = len(words), [x for x in text.split("\n") if x.strip()]
        want += [math.log(1 + n) / 10, len(set(words)) / n, min(2, len(set(words)) / n**0.85), max(C(words).values()) / n]
        want += [sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(set(zip(words, words[1:], strict=False))) / max(1, n - 1)]
        want += [1 - len(set(lines)) / len(lines), min(1, len(lines) / n), min(2, sum(map(len, words)) / n / 20), min(2, max(map(len, words)) / 100)]
        want += [min(1.2, len(z.compress(raw, 1)) / (len(raw) + 20)), math.log(1 + n) / 3 if n < 20 else 0]
        assert got == pytest.approx(np.array(want, np.float32), abs=1e-6), text


# --- pipeline ---


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(6)
    rows = []
    for k in range(400):
        text, good = prose_or_junk(rng)
        rows.append((k, text + (f" mail me{k}@example.com now" if k % 10 == 0 else ""), "en", f"s{k % 4}", 0, good))
    rows += [(1000 + k, rows[k][1], "en", "s0", 0, rows[k][5]) for k in range(20)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([r[:5] for r in rows], columns).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(r[5]), 0) for r in rows if r[0] < 400], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    good = {r[0] for r in rows if r[5]}
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "PII", "mixing", "packing"]
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    found = {}
    for name, stage in pipeline.STAGES:
        stage(spark, kept, str(tmp_path)).write.parquet(str(tmp_path / name.replace(" ", "_")))
        kept = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        found[name] = kept
        if name != "packing":
            assert kept.columns == docs.columns
    ids = {n: {r["doc_id"] for r in df.select("doc_id").distinct().collect()} for n, df in found.items()}
    assert len(good - ids["quality classifier"]) <= 0.02 * len(good)
    before = [(r["doc_id"], r["text"]) for r in found["quality classifier"].select("doc_id", "text").collect()]
    assert ids["n-gram Jaccard join"] == {c for c, _, _ in brute_links(before).values()}
    assert found["PII"].where(F.col("text").contains("@example.com")).isEmpty() and not found["PII"].where(F.col("text").contains("<EMAIL>")).isEmpty()
    assert found["PII"].where(F.length("text") != F.col("n_chars")).isEmpty()
    assert found["mixing"].groupBy("doc_id").count().where("count > 2").isEmpty()
    assert found["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
    rerun = [sorted(map(tuple, df.collect())) for df in (found["packing"].select("doc_id", "start", "length", "ids_crc32"), pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32"))]
    assert [r[0] for r in rerun[0]] and len(rerun[0]) == len(rerun[1])


#: Nulls in every column, blank, very long and repeated texts, one language of letters outside ASCII, and columns that the stages' own are named like.
ODD = [
    (1, "Plain words in a sentence, and more of them. " * 6, "en", "a", 276, "x", 1, -1),
    (1, "Plain words in a sentence, and more of them. " * 6, "en", "a", 276, "x", 1, -1),
    (2, "Plain words in a sentence, and more of them. " * 6, None, "b", 276, "x", 2, -1),
    (None, None, None, None, None, None, None, None),
    (None, "Write to me@example.com or me (at) example (dot) org. " + "Then some words follow, as they do in prose. " * 9, "en", None, None, "y", None, -1),
    (3, "", "en", "a", 0, None, 3, -1),
    (4, " \t\n", "en", "b", 3, None, 3, -1),
    (5, "many words of a long text that goes on. " * 40_000, "en", "b", None, None, 3, -1),
    (6, "Été à la plage, où l'on lit des livres. " * 20, "fr", "c", 800, "z", 3, -1),
]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, _row_key int, _mix_size int"


@pytest.mark.parametrize("with_labels", [True, False])
def test_pipeline_of_odd_rows(spark, tmp_path, with_labels):
    pipeline = pytest.importorskip("corpus_pipeline")
    path = str(tmp_path)
    docs = spark.createDataFrame(ODD, ODD_SCHEMA).repartition(3)
    docs.write.parquet(f"{path}/documents.parquet")
    rows = [(1, 1, 0), (6, 1, 0), (4, 0, 1), (None, 1, 1), (2, None, None)] if with_labels else []
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    kept = spark.read.parquet(f"{path}/documents.parquet")
    found = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, kept, path).write.parquet(f"{path}/{k}")
        kept = found[name] = spark.read.parquet(f"{path}/{k}")
        if name != "packing":
            assert kept.columns == docs.columns
            assert kept.where("doc_id is not null and _mix_size != -1").isEmpty() and {r["label"] for r in kept.select("label").collect()} <= {"x", "y", "z", None}
    if not with_labels:
        assert found["quality classifier"].count() == len(ODD)
    before, after = (sorted(map(str, found[n].collect())) for n in ("quality classifier", "n-gram Jaccard join"))
    # Of the first three rows one stays; all others do.
    copies = [r for r in before if "Plain words" in r]
    assert len([r for r in after if "Plain words" in r]) == min(1, len(copies)) and set(after) <= set(before)
    assert sorted(r for r in after if "Plain words" not in r) == sorted(r for r in before if "Plain words" not in r)
    assert found["PII"].where(F.col("text").contains("example")).isEmpty() and found["PII"].count() == len(after)
    assert found["PII"].where("text is null").count() == found["n-gram Jaccard join"].where("text is null").count()
    sizes = found["PII"].groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(WORD.pattern))).alias("n")).collect()
    mixed = found["mixing"].agg(F.sum(F.regexp_count("text", F.lit(WORD.pattern)))).first()[0]
    assert abs(mixed - 1.5 * sum(r["n"] or 0 for r in sizes)) <= 2 * len(sizes)
    assert found["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()


def test_pipeline_of_an_empty_table(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], ODD_SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_cleanup_deletes_what_was_written(spark, tmp_path):
    from loomwright.llm import common

    at = common.scratch(spark, "x").rsplit("/", 1)[0]
    materialise(spark.range(3), "x")
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.Path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert files.exists(jvm.org.apache.hadoop.fs.Path(at))
    common.cleanup(spark)
    assert not files.exists(jvm.org.apache.hadoop.fs.Path(at))


def test_join_of_very_long_texts_and_equal_rows(spark):
    rng = random.Random(14)
    long = rng.choices([f"w{k}" for k in range(5000)], k=30_000)
    near = list(long)
    for _ in range(300):
        near[rng.randrange(len(near))] = "other"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (2, " ".join(near)), (3, " ".join(long[:9000])), (None, " ".join(long))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["class_id"], r["n_links"], r["class_size"]) for r in jj.near_duplicates(df).collect())
    assert got == [(0, 1, 3, 4), (1, 1, 3, 4), (2, 1, 3, 4), (2, 1, 3, 4), (3, 3, 0, 1)]
    assert sorted(r["doc_id"] for r in jj.one_of_each(df).collect()) == [1, 3]
