"""Collections of indexed chunks: versions, each named by a manifest, over parts that are written once.

A build compares documents with those that the collection holds, by a hash of all that they are, and writes only what is new:
the chunks of new documents as another part, and which documents of which parts hold no more. Nothing that an older version
refers to is touched. The version becomes the collection's when its manifest gets its name, in one step, and not before: a build
that is killed leaves files that no manifest names, and of two builds at a time one is refused. The manifest tells which
encoder made the vectors and how texts were cut; no other encoder can add to them, and a search learns it without a scan.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators.embed import Encoder, EncoderMismatch
from loomwright.storage import children, delete, hadoop, publish, written

DEFAULT_COLLECTION = "knowledge_base"
#: Rows of ids (of 64 characters) that may be broadcast, after they were counted.
BROADCAST_IDS = 1_000_000


class CollectionChanged(RuntimeError):
    """Another build published a version meanwhile; this one has changed nothing."""


@dataclass(frozen=True)
class Manifest:
    version: int
    encoder_id: str
    dim: int
    size: int
    overlap: int
    documents: int
    chunks: int
    #: Tables of chunks, and of the documents of them that hold no more (``part``, ``doc``).
    parts: tuple[str, ...]
    gone: tuple[str, ...]
    #: Table of the documents that hold: ``doc``, ``part``, ``chunks``.
    live: str

    def check(self, encoder: Encoder) -> None:
        if (self.encoder_id, self.dim) != (encoder.encoder_id, encoder.dim):
            raise EncoderMismatch(f"the collection has vectors of {(self.encoder_id, self.dim)}, not {(encoder.encoder_id, encoder.dim)}")


def home(path: str, collection: str) -> str:
    return f"{path.rstrip('/')}/collection={quote(collection, safe='')}"


def versions(spark: SparkSession, path: str, collection: str = DEFAULT_COLLECTION) -> list[int]:
    return [int(n.removesuffix(".json")) for n in children(spark, f"{home(path, collection)}/manifests") if n.endswith(".json")]


def manifest(spark: SparkSession, path: str, collection: str = DEFAULT_COLLECTION, version: int | None = None) -> Manifest | None:
    """The manifest of a version, the last one unless told otherwise; null without a collection."""
    known = versions(spark, path, collection)
    if version is None and not known or version is not None and version not in known:
        return None
    at = f"{home(path, collection)}/manifests/{max(known) if version is None else version:012d}.json"
    told = json.loads("".join(r["value"] for r in spark.read.text(at, wholetext=True).collect()))
    return Manifest(**told | {"parts": tuple(told["parts"]), "gone": tuple(told["gone"])})


def _publish(spark: SparkSession, at: str, new: Manifest) -> bool:
    passing = f"{at}/passing/{uuid.uuid4().hex}.json"
    store, where = hadoop(spark, passing)
    out = store.create(where, False)
    out.write(bytearray(json.dumps(asdict(new)).encode()))
    out.close()
    if publish(spark, passing, f"{at}/manifests/{new.version:012d}.json"):
        return True
    delete(spark, passing)
    return False


def same_text(source: Column, page: Column, text: Column) -> Column:
    """What two documents with the same chunks have in common."""
    return F.sha2(F.concat_ws("\u0001", source, F.coalesce(page.cast("string"), F.lit("")), text), 256)


def identified(documents: DataFrame) -> DataFrame:
    """``documents`` with ``_text_id`` and ``_doc``, the hashes of what is cut into chunks and of all that is kept."""
    rest = F.to_json(F.array_sort(F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>")))))
    return documents.withColumn("_text_id", same_text(F.col("source"), F.col("page"), F.coalesce("text", F.lit("")))).withColumn("_doc", F.sha2(F.concat_ws("\u0001", "_text_id", rest), 256))


def _ids(df: DataFrame) -> DataFrame:
    """Ids for a join, broadcast if there are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


@dataclass(frozen=True)
class Change:
    """What a build has to do: ``fresh`` documents to cut and encode, the ids of all wanted ones and of those that go."""

    base: Manifest | None
    fresh: DataFrame
    wanted: DataFrame
    kept: DataFrame | None
    leaving: DataFrame | None
    loaded: int


def compare(spark: SparkSession, documents: DataFrame, path: str, collection: str, encoder: Encoder, size: int, overlap: int, scratch: str) -> Change:
    """Documents against what the collection holds. Texts stay where they are: only ids are moved.

    Equal documents count once; of those that differ in metadata alone the one of least hash holds.
    """
    base = manifest(spark, path, collection)
    if base is not None:
        base.check(encoder)
    rows = identified(documents)
    each = rows.groupBy("_text_id").agg(F.min("_doc").alias("doc"), F.count("*").alias("copies"))
    wanted = written(each, f"{scratch}/wanted")
    loaded = wanted.agg(F.sum("copies")).first()[0] or 0
    several = _ids(wanted.where("copies > 1").select("_text_id", F.col("doc").alias("_chosen")))
    single = rows.join(several, "_text_id", "left_anti")
    one_of = rows.join(several, "_text_id").where("_doc = _chosen").dropDuplicates(["_doc"]).select(*single.columns)
    rows = single.unionByName(one_of)
    if base is None or (base.size, base.overlap) != (size, overlap):
        return Change(base and replace(base, parts=(), gone=(), chunks=0), rows, wanted, None, None, loaded)
    live = spark.read.parquet(f"{home(path, collection)}/{base.live}")
    fresh = _ids(written(wanted.select("doc").join(live.select("doc"), "doc", "left_anti"), f"{scratch}/fresh"))
    leaving = written(live.join(wanted.select("doc"), "doc", "left_anti"), f"{scratch}/leaving")
    kept = live.join(wanted.select("doc"), "doc", "left_semi")
    return Change(base, rows.join(fresh, rows["_doc"] == fresh["doc"], "left_semi"), wanted, kept, leaving, loaded)


def commit(spark: SparkSession, change: Change, indexed: DataFrame, path: str, collection: str, encoder: Encoder, size: int, overlap: int) -> tuple[Manifest, int, int]:
    """Write what is new and publish it; the manifest, the chunks that were encoded and the documents that left.

    ``indexed`` has the chunks of the fresh documents, with ``doc``. A build that changes nothing publishes nothing.
    """
    at, base, run = home(path, collection), change.base, uuid.uuid4().hex
    made = [f"parts/{run}", f"live/{run}", f"gone/{run}"]
    part = written(indexed, f"{at}/{made[0]}")
    counts = part.groupBy("doc").agg(F.count("*").cast("int").alias("chunks"))
    encoded = part.count()
    left = change.leaving.count() if change.leaving is not None else 0
    new_docs = change.wanted.select("doc") if change.kept is None else change.wanted.select("doc").join(change.kept.select("doc"), "doc", "left_anti")
    new = new_docs.join(counts, "doc", "left").select("doc", F.lit(made[0]).alias("part"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
    live = written(new if change.kept is None else change.kept.select("doc", "part", "chunks").unionByName(new), f"{at}/{made[1]}")
    documents, chunks = live.agg(F.count("*"), F.coalesce(F.sum("chunks"), F.lit(0))).first()
    if change.kept is not None and base is not None and not left and documents == base.documents:
        for name in made[:2]:
            delete(spark, f"{at}/{name}")
        return base, 0, 0
    parts = ((*base.parts, made[0]) if encoded else base.parts) if base is not None else (made[0],)
    gone = base.gone if base is not None else ()
    if left:
        written(change.leaving.select("part", "doc"), f"{at}/{made[2]}")
        gone = (*gone, made[2])
    next_ = Manifest((base.version if base else 0) + 1, encoder.encoder_id, encoder.dim, size, overlap, documents, chunks, parts or (made[0],), gone, made[1])
    if not _publish(spark, at, next_):
        for name in made:
            delete(spark, f"{at}/{name}")
        raise CollectionChanged(f"{collection} has a version {next_.version} already")
    return next_, encoded, left


def _rows(spark: SparkSession, at: str, told: Manifest) -> DataFrame:
    tables = [spark.read.parquet(f"{at}/{p}").withColumn("_part", F.lit(p)) for p in told.parts]
    rows = reduce(DataFrame.unionByName, tables)
    if told.gone:
        gone = reduce(DataFrame.unionByName, [spark.read.parquet(f"{at}/{g}") for g in told.gone]).select(F.col("part").alias("_part"), "doc")
        rows = rows.join(_ids(gone), ["_part", "doc"], "left_anti")
    return rows


def read_collection(spark: SparkSession, path: str, collection: str = DEFAULT_COLLECTION, version: int | None = None) -> DataFrame:
    """The chunks of a collection as its last version, or a named one, has them."""
    told = manifest(spark, path, collection, version)
    if told is None:
        raise FileNotFoundError(f"no such collection or version: {path} {collection} {version or ''}".rstrip())
    return _rows(spark, home(path, collection), told).drop("_part", "doc")


def compact(spark: SparkSession, path: str, collection: str = DEFAULT_COLLECTION) -> Manifest:
    """One part in place of many, and no leaving documents in it. Nothing is encoded again."""
    at, told, run = home(path, collection), manifest(spark, path, collection), uuid.uuid4().hex
    written(_rows(spark, at, told).drop("_part"), f"{at}/parts/{run}")
    written(spark.read.parquet(f"{at}/{told.live}").withColumn("part", F.lit(f"parts/{run}")), f"{at}/live/{run}")
    new = replace(told, version=told.version + 1, parts=(f"parts/{run}",), gone=(), live=f"live/{run}")
    if not _publish(spark, at, new):
        raise CollectionChanged(f"{collection} has a version {new.version} already")
    return new


def expire(spark: SparkSession, path: str, collection: str = DEFAULT_COLLECTION, keep: int = 1) -> int:
    """Delete older versions but for the last ``keep``, and every table that none of these refers to. No build may be running."""
    at, known = home(path, collection), versions(spark, path, collection)
    for version in known[:-keep]:
        delete(spark, f"{at}/manifests/{version:012d}.json")
    held = {t for v in known[-keep:] if (m := manifest(spark, path, collection, v)) for t in (*m.parts, *m.gone, m.live)}
    dropped = [f"{kind}/{n}" for kind in ("parts", "live", "gone", "passing") for n in children(spark, f"{at}/{kind}") if f"{kind}/{n}" not in held]
    for name in dropped:
        delete(spark, f"{at}/{name}")
    return len(dropped)
