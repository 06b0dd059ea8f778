"""A Merkle manifest of a dataset: a tree of hashes for each source, one over the sources, proofs, and their check (operator 11).

Every row is a leaf, the hash of its columns. Levels are built one after another, each a DataFrame written once:

1. Leaves get their place in their source. They are dealt by range over tasks, numbered there with ``row_number``, and moved
   on by the counts of the ranges before; so no source, however large, is sorted in one task.
2. ``idx / fanout``, rounded down, is the parent's place. The children of a parent, at most ``fanout``, are grouped, sorted by
   place and hashed. A source is done when it has one node, its subroot; the subroots are the leaves of a last tree.
3. From the root down each node's path goes to its children by a join on their parent's place, and every level puts the
   siblings in front. As a level has a third of the rows of the one below, all levels together cost little more than the last;
   the lowest runs carry what the result tells of their leaves, which no join has to fetch again.

Proofs are checked by folding a leaf with its siblings, as one who holds the root alone would do.

Cases: a null counts as ``-`` in any column; null ids come first in their source, null sources before all others; rows of
equal id are ordered by their hashes, and equal rows are leaves next to one another; a lone leaf is its own subroot; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomwright.llm.common import materialise, passing_tables

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
_PATH = "array<struct<before: binary, after: binary>>"


def item(value: Column) -> Column:
    """What is hashed of a value: ``-`` for null, else its bytes' number, a colon, and it."""
    said = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))


def leaf_hash(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(item, values)), 256))


def _text(digest: Column) -> Column:
    """A digest as it is hashed and shown: lowercase hex. Tables hold its 32 bytes."""
    return F.lower(F.hex(digest))


def _together(digests: Column) -> Column:
    """An array of digests as one text."""
    return F.array_join(F.transform(digests, _text), "")


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows``, which have been written, with their place ``idx`` among the ``n`` rows of their group ``g``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = rows.withColumn("tie", F.monotonically_increasing_id())  # equal rows, however many, go to many ranges
    keys = [F.col(c).asc_nulls_first() for c in ("g", *order, "tie")]
    ranged = materialise(tied.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()), "merkle-ranges")
    counts = ranged.groupBy("g", "part").agg(F.count("*").alias("own"))
    whole = Window.partitionBy("g")
    before = counts.select("g", "part", (F.sum("own").over(whole.orderBy("part")) - F.col("own")).alias("before"), F.sum("own").over(whole).alias("n"))
    number = F.row_number().over(Window.partitionBy("g", "part").orderBy(*keys[1:]))
    return ranged.withColumn("number", number).join(before, ["g", "part"]).withColumn("idx", F.col("before") + F.col("number") - 1).drop("part", "tie", "number", "before")


def _tree(leaves: DataFrame, fanout: int, payload: list[str]) -> list[DataFrame]:
    """The levels of the groups' trees from the leaves (``g``, ``idx``, ``n``, ``d``) up; above them ``kids`` has the children in order.

    ``payload`` names columns of the leaves that the lowest runs carry.
    """
    levels = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        below, most = levels[-1], -(-most // fanout)
        child = F.struct("idx", "d", *payload) if len(levels) == 1 else F.struct("idx", "d")
        runs = below.where("n > 1").groupBy("g", F.floor(F.col("idx") / fanout).alias("p"), F.ceil(F.col("n") / fanout).alias("m")).agg(F.array_sort(F.collect_list(child)).alias("kids"))
        d = F.unhex(F.sha2(_together(F.transform("kids", lambda k: k["d"])), 256))
        levels.append(materialise(runs.select("g", F.col("p").alias("idx"), F.col("m").alias("n"), d.alias("d"), "kids"), "merkle-level"))
    return levels


def _subroots(levels: list[DataFrame]) -> DataFrame:
    """``g``, ``level`` and digest ``d`` of the groups' last nodes."""
    return reduce(DataFrame.unionByName, [x.where("n = 1").select("g", F.lit(k).alias("level"), "d") for k, x in enumerate(levels)])


def _paths(levels: list[DataFrame], tops: DataFrame, carried: list[str], payload: list[str]) -> DataFrame:
    """The leaves (``g``, ``idx``, ``d`` and payload) with ``path``, their siblings on each level, and what ``tops`` carries.

    ``tops`` has the groups' subroots with their ``level`` and the ``path`` that goes on above it.
    """
    begin = lambda k: tops.where(F.col("level") == k).select("g", F.lit(0).cast("long").alias("idx"), "path", *carried)
    reached = begin(len(levels) - 1)
    for k in range(len(levels) - 1, 0, -1):
        runs = levels[k].select("g", "idx", "kids").join(reached, ["g", "idx"]).select("g", "kids", "path", *carried, F.posexplode("kids").alias("at", "kid"))
        side = lambda first, n: F.unhex(_together(F.transform(F.slice("kids", first, n), lambda x: x["d"])))
        own = F.struct(side(F.lit(1), F.col("at")).alias("before"), side(F.col("at") + 2, F.size("kids")).alias("after"))
        named = [F.col("kid")[c].alias(c) for c in (payload if k == 1 else [])]
        reached = runs.select("g", F.col("kid")["idx"].alias("idx"), F.col("kid")["d"].alias("d"), *named, F.array_prepend("path", own).alias("path"), *carried)
        alone = begin(k - 1)
        if k > 1:
            reached = reached.drop("d").unionByName(alone)
    single = levels[0].where("n = 1").join(begin(0), ["g", "idx"]).select("g", "idx", "d", *payload, "path", *carried)
    return reached.unionByName(single) if len(levels) > 1 else single


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to, as text."""
    return F.aggregate(path, _text(digest), lambda d, s: F.sha2(F.concat(_text(s["before"]), d, _text(s["after"])), 256))


def manifest(docs: DataFrame, tampered: Callable[[DataFrame], dict[str, Column]] | None = None, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id", group: str = "source", fanout: int = FANOUT) -> DataFrame:
    """A row for each row: ``doc_id`` (the key), ``leaf``, ``subroot``, ``root``, ``path``, ``proof_sha256``, ``folded_root`` and ``verified``.

    ``tampered`` gives what columns are when the proofs are checked; without it they are as they were. ``path`` has the
    siblings' bytes of each level, before and after the node's own.
    """
    with passing_tables(docs.sparkSession) as lasting:
        changed = tampered(docs) if tampered else {}
        group_key = F.when(F.col(group).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
        now = leaf_hash([changed.get(c, F.col(c)) for c in columns])
        own = docs.select(F.col(key).alias("key"), group_key.alias("g"), leaf_hash([F.col(c) for c in columns]).alias("d"), now.alias("now"))
        levels = _tree(materialise(_placed(materialise(own, "merkle-leaves"), ["key", "d"]), "merkle-places"), fanout, ["key", "now"])
        ends = materialise(_subroots(levels), "merkle-subroots")
        top = _tree(materialise(_placed(ends.select(F.lit("").alias("g"), F.col("g").alias("name"), "level", "d"), ["name"]), "merkle-tops"), fanout, ["name", "level"])
        root = _subroots(top).select("d").first()
        if root is None:
            return docs.sparkSession.createDataFrame([], _result(docs.schema[key].dataType))
        start = _subroots(top).select("g", "level", F.array().cast(_PATH).alias("path"))
        above = _paths(top, start, [], ["name", "level"])
        tops = materialise(above.select(F.col("name").alias("g"), "level", "path", F.col("d").alias("subroot")), "merkle-above")
        leaves = lasting(_paths(levels, tops, ["subroot"], ["key", "now"]), "merkle-paths")
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(_text(s["before"]), _text(s["after"]))), ""), 256)
    folded = leaves.select("*", proof.alias("proof_sha256"), fold(F.col("now"), F.col("path")).alias("folded_root"))
    return folded.select(
        F.col("key").alias("doc_id"), _text(F.col("d")).alias("leaf"), _text(F.col("subroot")).alias("subroot"), F.lit(bytes(root["d"]).hex()).alias("root"),
        "path", "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(bytes(root["d"]).hex())).alias("verified"),
    )


def _result(key: T.DataType) -> T.StructType:
    path = T.ArrayType(T.StructType([T.StructField("before", T.BinaryType()), T.StructField("after", T.BinaryType())]))
    kinds = {"doc_id": key, "leaf": T.StringType(), "subroot": T.StringType(), "root": T.StringType(), "path": path, "proof_sha256": T.StringType(), "folded_root": T.StringType(), "verified": T.BooleanType()}
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def without_line_ends(docs: DataFrame) -> dict[str, Column]:
    """The tampering of the registered query: where 2 divides the id's crc32, the text loses its line feeds."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return {"text": F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}


def _oracle() -> str:
    said = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(said(text if c == "text" else c) for c in COLUMNS) + ")"
    tree = lambda name, leaves: f"""{name}(g, level, idx, n, d) AS (
  SELECT g, 0, idx, n, d FROM {leaves}
  UNION ALL
  SELECT g, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY g, level, idx // 3, n
)"""  # noqa: E731
    # The crc32 of the id's text, bit by bit; it is even where the register, which is inverted at the end, is odd.
    shifts = "list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    even = f"list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: {shifts}) & 1 = 1"
    return f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, coalesce('1' || source, '0') AS g, {leaf("text")} AS d, {leaf("bad")} AS now
  FROM (SELECT *, CASE WHEN {even} THEN replace(text, chr(10), '') ELSE text END AS bad FROM documents)
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM hashed
), {tree("lower_tree", "leaves")}, tops AS (
  SELECT '' AS g, g AS name, level, d, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM lower_tree WHERE n = 1
), {tree("upper_tree", "tops")}, nodes AS (
  SELECT l.doc_id, l.g, l.idx AS leaf_idx, x.level, x.idx, x.d, x.idx // 3 = l.idx // CAST(pow(3, x.level + 1) AS BIGINT) AS near, x.idx = l.idx // CAST(pow(3, x.level) AS BIGINT) AS own
  FROM leaves l JOIN lower_tree x ON x.g = l.g AND x.n > 1 AND x.idx // 3 = l.idx // CAST(pow(3, x.level + 1) AS BIGINT)
  UNION ALL
  SELECT l.doc_id, l.g, l.idx, 100 + x.level, x.idx, x.d, true, x.idx = t.idx // CAST(pow(3, x.level) AS BIGINT)
  FROM leaves l JOIN tops t ON t.name = l.g JOIN upper_tree x ON x.n > 1 AND x.idx // 3 = t.idx // CAST(pow(3, x.level + 1) AS BIGINT)
), steps AS (
  SELECT g, leaf_idx, level, coalesce(string_agg(d, '' ORDER BY idx) FILTER (NOT own AND idx < mine), '') AS before, coalesce(string_agg(d, '' ORDER BY idx) FILTER (NOT own AND idx > mine), '') AS after
  FROM (SELECT *, max(CASE WHEN own THEN idx END) OVER (PARTITION BY g, leaf_idx, level) AS mine FROM nodes) GROUP BY ALL
), paths AS (
  SELECT g, leaf_idx, list(before ORDER BY level) AS b, list(after ORDER BY level) AS a FROM steps GROUP BY ALL
), folds(g, idx, k, d) AS (
  SELECT g, idx, 0, now FROM leaves
  UNION ALL
  SELECT f.g, f.idx, k + 1, sha256(b[k + 1] || d || a[k + 1]) FROM folds f JOIN paths p ON p.g = f.g AND p.leaf_idx = f.idx WHERE k < len(b)
), folded AS (
  SELECT g, idx, max_by(d, k) AS folded_root FROM folds GROUP BY ALL
), root AS (SELECT d AS root FROM upper_tree WHERE n = 1)
SELECT l.doc_id, l.d AS leaf, t.d AS subroot, root, sha256(coalesce(array_to_string(list_transform(range(1, len(b) + 1), lambda i: b[i] || a[i]), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN tops t ON t.name = l.g JOIN folded f ON f.g = l.g AND f.idx = l.idx CROSS JOIN root LEFT JOIN paths p ON p.g = l.g AND p.leaf_idx = l.idx"""


ORACLE = _oracle()
