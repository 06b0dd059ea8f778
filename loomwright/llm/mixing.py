"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 9).

Each source gets a target of words. Whole epochs of it come first; of the words then left, documents are taken in
the order of their keys, -ln(u) / quality, until the budget is full; the last one is taken in part. u comes from a
hash of the row, so a rerun takes the same words.

The order within a source is never sorted as a whole. Keys are read as numbers of 63 bits and fall into ``2 ** STEP``
bins by their first bits, whose words are summed; the bin in which the budget runs out is found from these sums and
split by the next bits, until it holds at most ``EDGE`` rows of a source (rows of one key are one, however many). Only
these are ranked, which gives the one key per source at which the budget ends. What is joined to the documents is a row
for each source: Spark broadcasts it where its size allows, and then no text is moved.

Cases: a null text has size 0, as an empty one, and nothing is taken of it; a null source is a source like another
and comes last; sources of size 0 have target 0; ties of key are broken by the hash of the row; rows equal in id,
source and text follow one another, and any of them may be the one taken in part; null ids stay null; an empty table
gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwright.llm.common import WORD, fresh, materialise, n_words

# The weights of the sources in their order, and the share of all words that the mix holds.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
#: No target is above so many times its source's words.
EPOCHS = 2.0
#: Least quality weight of a document.
LEAST = 0.05
#: Bits of a key that a round looks at, and rows of a source that are ranked one by one.
STEP, EDGE = 9, 1000
#: Equal rows in a task that ranks them.
COPIES = 100_000
_BITS = 63
KEYS = ("id", "source", "size", "key", "own")


def quality(text: Column) -> Column:
    """Weight of a document, 0.05 to 1: falls with the share of symbols in its text."""
    signs = F.regexp_count(text, F.lit(r"[#*$%&|<>!]"))
    return F.greatest(F.lit(LEAST), 1 - 4 * F.coalesce(signs / F.greatest(F.length(text), F.lit(1)), F.lit(0.0)))


def uniform(own: Column) -> Column:
    """A number in (0, 1] from a row's hash, one of 2 ** 53."""
    return (F.shiftrightunsigned(F.xxhash64(own, F.lit(977)), 11) + 0.5) / float(1 << 53)


def key_columns(weight: Column | None = None) -> dict[str, Column]:
    """The columns of ``KEYS``: id, source, size in words, sampling key, hash of the row.

    ``weight`` is the documents' quality weight, if they bring one: a classifier's score or a posterior, say. What is null,
    not a number or below ``LEAST`` counts as ``LEAST``. Else ``quality`` of the text is taken.
    """
    if weight is not None:
        weight = F.greatest(F.coalesce(F.nanvl(weight.cast("double"), F.lit(LEAST)), F.lit(LEAST)), F.lit(LEAST))
    text, doc_id, source = F.col("text").cast("string"), F.col("doc_id"), F.col("source").cast("string")
    own = F.xxhash64(doc_id.cast("string"), source, text)
    return dict(zip(KEYS, (doc_id.cast("long"), source, n_words(text), -F.log(uniform(own)) / (quality(text) if weight is None else weight), own), strict=True))


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from rows with ``source`` and ``size``, written once.

    A target is min(epochs * size, t * weight) for the one t at which they sum to the budget. t rises from the level
    at which no source is full: sources that are full at it leave the rest of the budget to the others, until none
    becomes full. Sources are numbered by a sort over ranges and the counts of these, so any number of them will do.
    """
    total = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = total.withColumn("none", F.col("source").isNull()).repartitionByRange("none", "source").withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "mix-sources")
    before = F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))
    place = F.col("before") + F.row_number().over(W.partitionBy("part").orderBy("none", "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    weighed = materialise(ranged.join(F.broadcast(parts), "part").select("source", "source_size", weight.alias("weight"), (epochs * F.col("source_size")).alias("most")), "mix-weights")  # as many rows as partitions
    budget = weighed.agg(F.sum(share * F.col("source_size"))).first()[0] or 0.0
    level, full = 0.0, -1
    while True:
        is_full = level * F.col("weight") >= F.col("most")
        row = weighed.agg(F.count_if(is_full), F.sum(F.when(is_full, F.col("most"))), F.sum(F.when(~is_full, F.col("weight")))).first()
        if row[0] <= full or not row[2]:
            break
        full, level = row[0], (budget - (row[1] or 0.0)) / row[2]
    aim = F.when(is_full, F.col("most")).otherwise(F.least(F.col("most"), F.lit(level) * F.col("weight")))
    return weighed.select("source", "source_size", aim.alias("target"))


def _same(rows: DataFrame, source: str, sources: DataFrame, how: str = "inner") -> DataFrame:
    """Join rows with a table that has a row for each ``source``. Spark broadcasts it where its size allows, and else splits skewed tasks."""
    (own,) = fresh(rows, "_mix_of")
    return rows.join(sources.withColumnRenamed("source", own), F.col(source).eqNullSafe(F.col(own)), how).drop(own)


def _edges(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """The row at which a source's budget ``left`` runs out: ``source``, ``edge_key``, ``edge_own``, ``copies`` of it, how many of these are taken ``whole``, and ``part`` of the next.

    Sources whose rows all fit have none. ``rows`` are written narrow ones with ``place``, the key as a number.
    """
    bits = lambda n: F.shiftright("place", _BITS - n)
    state = budgets.select("source", F.lit(0).cast("long").alias("bin"), "left")
    for done in range(0, _BITS, STEP):
        inside = _same(rows, "source", state).where(bits(done) == F.col("bin"))
        sums = inside.groupBy("source", bits(done + STEP).alias("next")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.first("left").alias("left"))
        upto = F.sum("words").over(W.partitionBy("source").orderBy("next"))  # of at most 2 ** STEP rows
        found = sums.withColumn("before", upto - F.col("words")).where((F.col("before") <= F.col("left")) & (F.col("before") + F.col("words") > F.col("left")))
        state = materialise(found.select("source", F.col("next").alias("bin"), (F.col("left") - F.col("before")).alias("left"), "rows"), "mix-bins")
        if (state.agg(F.max("rows")).first()[0] or 0) <= EDGE:
            break
    last = _same(rows, "source", state.drop("rows")).where(bits(done + STEP) == F.col("bin"))
    equal = last.groupBy("source", "key", "own").agg(F.max("size").alias("size"), F.count("*").alias("copies"), F.first("left").alias("left"))
    order = W.partitionBy("source").orderBy("key", "own").rowsBetween(W.unboundedPreceding, -1)
    ranked = equal.withColumn("room", F.col("left") - F.coalesce(F.sum(F.col("size") * F.col("copies")).over(order), F.lit(0)))
    at = ranked.where((F.col("room") >= 0) & (F.col("room") < F.col("size") * F.col("copies")))
    return at.select("source", F.col("key").alias("edge_key"), F.col("own").alias("edge_own"), "copies", F.floor(F.col("room") / F.col("size")).alias("whole"), (F.col("room") % F.col("size")).alias("part"))


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """A row for each source: its size and target, how many whole epochs are taken, and where the rest of the budget ends."""
    aims = targets(rows, weights, share, epochs)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aims = aims.withColumn("times", times).withColumn("left", F.round(F.col("target") - F.col("times") * F.col("source_size")).cast("long"))
    aims = materialise(aims, "mix-targets")
    return materialise(_same(aims.drop("left"), "source", _edges(rows, aims.select("source", "left")), "left"), "mix-plan")


def _ranked(rows: DataFrame, source: str, copies: str) -> tuple[DataFrame, str]:
    """``rows``, equal ones of each source, numbered from 0, and the name of the number; ``copies`` says how many there are.

    They are dealt over tasks of about ``COPIES`` rows, written, and numbered from the counts of these.
    """
    deal, rank, before = fresh(rows, "_mix_deal", "_mix_rank", "_mix_before")
    dealt = rows.withColumn(deal, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.ceil(F.col(copies) / COPIES)))
    dealt = materialise(dealt, "mix-equal")
    counts = dealt.groupBy(F.col(source).alias("source"), F.col(deal).alias("deal")).agg(F.count("*").alias("n"))
    counts = counts.select("source", "deal", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("deal").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    of, which = fresh(dealt, "_mix_of", "_mix_which")
    joined = dealt.join(counts.toDF(of, which, before), F.col(source).eqNullSafe(F.col(of)) & (F.col(deal) == F.col(which))).drop(of, which)
    number = F.row_number().over(W.partitionBy(source, deal).orderBy(deal)) - 1
    return joined.withColumn(rank, F.col(before) + number).drop(deal, before), rank


def take(rows: DataFrame, own: dict[str, str], found: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``rows`` with their source's size and target and the words ``taken`` of each; ``own`` names their columns of ``KEYS``, the other names are given back."""
    kept = dict(zip(found.columns[1:], fresh(rows, *(f"_mix_{c}" for c in found.columns[1:])), strict=True))
    out = {"taken": fresh(rows, "_mix_taken")[0]}
    joined = _same(rows, own["source"], found.toDF("source", *kept.values()))
    c = {k: F.col(v) for k, v in (own | kept).items()}
    at_edge = F.coalesce((c["key"] == c["edge_key"]) & (c["own"] == c["edge_own"]), F.lit(False))
    ahead = (c["key"] < c["edge_key"]) | (c["key"] == c["edge_key"]) & (c["own"] < c["edge_own"])
    extra = F.when(c["edge_key"].isNull() | ahead, c["size"]).when(at_edge, c["part"]).otherwise(0)
    total = lambda more: (c["times"] * c["size"] + more).cast("long")
    several = at_edge & (c["copies"] > 1)
    if found.where("copies > 1").isEmpty():
        done = joined.withColumn(out["taken"], total(extra))
    else:
        ranked, rank = _ranked(joined.where(several), own["source"], kept["copies"])
        more = F.when(F.col(rank) < c["whole"], c["size"]).when(F.col(rank) == c["whole"], c["part"]).otherwise(0)
        done = joined.where(~several).withColumn(out["taken"], total(extra)).unionByName(ranked.withColumn(out["taken"], total(more)).drop(rank))
    return done, own | kept | out


def _narrow(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """The keys of the rows, written: the texts are read once for all that looks for the budgets' ends."""
    rows = docs.select(*[c.alias(n) for n, c in key_columns(weight).items()])
    return materialise(rows.withColumn("place", (F.col("key") * float(1 << 53)).cast("long")), "mix-rows")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, weight: Column | None = None) -> DataFrame:
    """``doc_id``, ``size``, its source's ``source_size`` and ``target``, and the words ``taken``. ``weight``: see ``key_columns``."""
    rows = _narrow(docs, weight)
    done, name = take(rows, {k: k for k in KEYS}, plan(rows, weights, share, epochs))
    return done.select(F.col("id").alias("doc_id"), "size", *[F.col(name[k]).alias(k) for k in ("source_size", "target", "taken")])


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), 0), 1, n.cast("int")), "")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, weight: Column | None = None) -> DataFrame:
    """The mix as documents: a row for each time a document is taken whole, and one cut after the words taken in part.

    ``n_chars``, where there is one, follows the text.
    """
    own = dict(zip(KEYS, fresh(docs, *(f"_mix_{k}" for k in KEYS)), strict=True))
    found = plan(_narrow(docs, weight), weights, share, epochs)
    done, name = take(docs.withColumns({own[k]: c for k, c in key_columns(weight).items()}), own, found)
    text, size, taken = F.col("text").cast("string"), F.col(name["size"]), F.col(name["taken"])
    whole = F.floor(taken / size).cast("int")
    part = (taken % size).cast("int")
    cut = F.when(part > 0, F.array(first_words(text, part))).otherwise(F.array().cast("array<string>"))
    out = done.where(taken > 0).withColumn("text", F.explode(F.concat(F.array_repeat(text, whole), cut)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)
