"""Merkle manifest, repeated passages and centroid clustering against plain statements of what they compute."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from loomwright.llm import kmeans, merkle, relative_lz
from loomwright.llm.words import stretches, word_hashes
from tests.llm.test_rowwise import ODD, SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- Merkle manifest ---


def said(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(digests):
    """The levels of a tree from its leaves up."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, at):
    """Before and after a node, level by level."""
    out = []
    for level in levels[:-1]:
        run = at // 3 * 3
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 3])))
        at //= 3
    return out


def plain_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text. A sorted list of the result's rows."""
    by_source = {}
    for doc_id, source, lang, n_chars, text in rows:
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        bad = text.replace("\n", "") if hit and text is not None else text
        leaf, now = (sha(*map(said, (doc_id, source, lang, n_chars, t))) for t in (text, bad))
        by_source.setdefault(source, []).append(((doc_id is not None, doc_id or 0), leaf, doc_id, now))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        by_source[name].sort(key=lambda r: r[:2])
        trees[name] = plain_tree([r[1] for r in by_source[name]])
    top = plain_tree([trees[n][-1][0] for n in names])
    out = []
    for k, name in enumerate(names):
        for at, (_, leaf, doc_id, now) in enumerate(by_source[name]):
            path = siblings(trees[name], at) + siblings(top, k)
            folded = now
            for before, after in path:
                folded = sha(before, folded, after)
            root = top[-1][0]
            out.append((doc_id, leaf, trees[name][-1][0], root, sha(*[x for pair in path for x in pair]), folded, folded == root))
    return sorted(out, key=repr)


def manifest_rows(df):
    found = merkle.manifest(df, merkle.without_line_ends)
    return sorted((tuple(r) for r in found.drop("path").collect()), key=repr)


@pytest.mark.parametrize("sizes", [(1,), (3,), (4, 1), (28, 9, 2, 1), (1, 1, 1, 1)])
def test_manifest_equals_plain_trees(spark, sizes):
    rng = random.Random(sum(sizes))
    rows = []
    for s, n in enumerate(sizes):
        for _ in range(n):
            rows.append((rng.randint(-50, 500), None if s == 1 else f"é{s}", "en", 5, rng.choice(["a\nb", "c", "", None])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    assert manifest_rows(df) == plain_manifest(rows)


def test_manifest_of_odd_rows(spark, odd, empty):
    """Nulls, ties and equal rows, one source with most rows, clashing names; and no rows."""
    assert manifest_rows(odd) == plain_manifest([(r[0], r[3], r[2], r[4], r[1]) for r in ODD])
    clash = odd.withColumnsRenamed({"size": "g", "target": "idx", "p": "d"})
    assert manifest_rows(clash) == manifest_rows(odd)
    assert merkle.manifest(empty, merkle.without_line_ends).collect() == []
    rows = [(7, "hot", "en", 1, "same\n")] * 40 + [(k, "hot", "en", 1, "x") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert manifest_rows(df) == plain_manifest(rows)


def test_a_proof_tells_any_change(spark):
    rows = [(k, f"s{k % 3}", "en", k, f"text {k}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert {r["verified"] for r in merkle.manifest(df).collect()} == {True}
    from pyspark.sql import functions as F

    found = {r["doc_id"]: r["verified"] for r in merkle.manifest(df, lambda d: {"lang": F.when(F.col("doc_id") == 7, "fr").otherwise(F.col("lang"))}).collect()}
    assert [k for k, ok in found.items() if not ok] == [7]


# --- repeated passages ---


def plain_removed(rows):
    """Rows of doc_id, number of words, number removed and hash of what is kept, as all windows tell."""
    texts = sorted({(d is None, d or 0, h, d, t) for d, h, t in rows}, key=lambda r: r[:3])
    seen, result = set(), {}
    for _, _, _, d, t in texts:
        words = WORD.findall(t or "")
        gone = set()
        for s in range(len(words) - 19):
            k = tuple(words[s : s + 20])
            if k in seen:
                gone.update(range(s, s + 20))
            seen.add(k)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        result[d, t] = (d, len(words), len(gone), sha(kept))
    return sorted((result[d, t] for d, _, t in rows), key=repr)


def removed_rows(df, block=relative_lz.BLOCK):
    from pyspark.sql import functions as F

    keyed = [tuple(r) for r in df.select("doc_id", F.xxhash64(F.col("text").cast("string")), "text").collect()]
    return sorted((tuple(r) for r in relative_lz.digests(df, block).collect()), key=repr), plain_removed(keyed)


def repeating_corpus(rng, n):
    """Passages that many texts share, cut, joined and changed in places; texts that repeat themselves; few words, so that stretches recur."""
    words = [f"w{k}" for k in range(60)]
    passages = [rng.choices(words, k=rng.randint(15, 90)) for _ in range(6)]
    hot = rng.choices(words, k=64)
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            part = list(hot if rng.random() < 0.4 else rng.choice(passages))
            a = rng.randrange(len(part))
            part = part[a:] if rng.random() < 0.3 else part
            if part and rng.random() < 0.4:
                part[rng.randrange(len(part))] = rng.choice(words)
            parts += part + rng.choices(words, k=rng.randint(0, 12))
        if rng.random() < 0.2:
            parts += ["a"] * rng.randint(1, 60)
        if rng.random() < 0.2:
            parts = parts * 2
        out.append(" ".join(parts))
    return out


@pytest.mark.parametrize("block", [32, 512])
def test_removed_words_equal_all_windows(spark, block):
    rng = random.Random(block)
    texts = repeating_corpus(rng, 150)
    rows = [(k, t) for k, t in enumerate(texts)] + [(200 + k, texts[3]) for k in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found, wanted = removed_rows(df, block)
    assert found == wanted and sum(r[2] for r in found) > 1000


def test_removed_words_of_odd_rows(spark, odd, empty):
    found, wanted = removed_rows(odd)
    assert found == wanted
    assert relative_lz.digests(empty).collect() == []
    kept = relative_lz.without_repeats(odd)
    assert kept.columns == [*odd.columns, "n_words", "removed", "kept"] and kept.count() == len(ODD)
    rows = [(1, "x y " * 30), (1, "x y " * 30 + "z"), (1, "x y " * 30), (None, "x y " * 30), (None, None)]
    found, wanted = removed_rows(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found == wanted


def test_factors_are_greedy_and_boundaries_are_checked():
    hashes = lambda text: word_hashes(text.encode())[0]
    a = " ".join(f"a{k}" for k in range(30))
    b = " ".join(f"b{k}" for k in range(30))
    # The reference has a, then the end of a followed by b: greedy takes all of a, and the window over its end is in the second.
    ref = relative_lz.Reference(hashes(f"{a} x {' '.join(a.split()[-12:])} {b}"))
    own = hashes(f"{a} {b}")
    assert relative_lz.parse(own, ref) == [(0, 0, 30), (30, 43, 30)]
    found = relative_lz.repeated(own, ref)
    assert np.flatnonzero(~found).tolist() == list(range(11, 18))
    runs = hashes("q " * 50)
    same = relative_lz.repeated(runs, relative_lz.Reference(runs), 0)
    assert not same[0] and same[1:].all()


def test_anchors_are_those_of_equal_windows():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 4, 400).astype(np.uint64)
    grams = stretches(words, relative_lz.GRAM)
    width = relative_lz.WINDOW - relative_lz.GRAM + 1
    own = relative_lz.anchors(words)[2]
    assert own.tolist() == [s + int(np.argmin(grams[s : s + width])) for s in range(len(words) - relative_lz.WINDOW + 1)]


# --- centroid clustering ---


def plain_clusters(rows, k, rounds, scale=256):
    """All vectors against all centroids, in whole numbers."""
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, sha(f"2:{r[0]}") if r[0] is not None else "", r[1]))[:k]
    c = [list(v) for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, z, strict=True)), n) for n, z in enumerate(c))
    for r in range(rounds + 1):
        own = [near(v) for _, v in kept]
        if r < rounds:
            for n in range(len(c)):
                mine = [v for (_, v), (_, m) in zip(kept, own, strict=True) if m == n]
                if mine:
                    c[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    total = sum(d for d, _ in own)
    each = {n: sum(d for d, m in own if m == n) for n in range(len(c))}
    return sorted(((i, n, d, each[n], total, sha(",".join(map(str, c[n])))) for (i, _), (d, n) in zip(kept, own, strict=True)), key=repr)


def cluster_rows(df, **kw):
    return sorted((tuple(r) for r in kmeans.cluster(df, **kw).collect()), key=repr)


def test_clusters_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "CHUNK", 50)
    rng = np.random.default_rng(8)
    middle = rng.normal(0, 1, (5, 64))
    rows = [(k, (middle[k % 5] + rng.normal(0, 0.05, 64)).astype(np.float32).tolist()) for k in range(300)]
    rows += [(1000 + k, rows[0][1]) for k in range(120)]  # copies hold many of the rows
    # Ties: vectors of few values; and odd ones.
    rows += [(2000 + k, rng.integers(0, 2, 64).astype(float).tolist()) for k in range(40)]
    odd = [None, [], [0.5] * 63, [0.5] * 65, [None] + [0.5] * 63, [float("nan")] + [0.5] * 63, [float("inf")] + [0.0] * 63]
    rows += [(3000 + k, v) for k, v in enumerate(odd)] + [(None, [0.25] * 64), (None, [0.25] * 64), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, v string, cluster int").repartition(4)
    assert cluster_rows(df, k=12, rounds=3) == plain_clusters(rows, 12, 3)


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(k, [float(k)] * 64) for k in range(3)]
    assert cluster_rows(spark.createDataFrame(rows, schema)) == plain_clusters(rows, 40, 5)
    assert cluster_rows(spark.createDataFrame([], schema)) == []
    assert cluster_rows(spark.createDataFrame([(1, None)], schema)) == []
    large = [(k, [(-1.0) ** (k + d) * 1e5 * (k + 1) / 9 for d in range(64)]) for k in range(9)] + [(9, [1e30] * 64)]
    assert cluster_rows(spark.createDataFrame(large, schema), k=3) == plain_clusters([(i, np.float32(v).tolist()) for i, v in large[:9]], 3, 5)


def test_filtering_spares_distances_and_loses_no_tie():
    rng = np.random.default_rng(2)
    middle = rng.integers(-2000, 2000, (20, 64))
    rows = np.concatenate([m + rng.integers(-20, 20, (100, 64)) for m in middle])
    tree = kmeans.Tree.build(pa.array(range(len(rows))), rows)
    cluster, counts, sums, compared = kmeans.assign(tree, middle)
    best = ((tree.rows[:, None] - middle[None]) ** 2).sum(2).argmin(1)
    assert (cluster == best).all() and compared < len(rows) * len(middle) / 4
    assert (counts == np.bincount(best, minlength=20)).all() and (sums[3] == tree.rows[best == 3].sum(0)).all()
    twice = np.concatenate([middle, middle])
    assert (kmeans.assign(tree, twice)[0] == best).all()
    equal = kmeans.Tree.build(pa.array(range(500)), np.full((500, 64), 7))
    assert (kmeans.assign(equal, np.array([[6] * 64, [8] * 64]))[0] == 0).all()
