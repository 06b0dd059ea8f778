"""Shared helpers: reading tables, cutting lineage, Bloom filters of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.storage import cleanup, delete, scratch, shared_dir, written

__all__ = ["Bloom", "cleanup", "fresh", "held_out", "let", "materialise", "n_words", "passing_tables", "scratch", "shared_dir", "table"]

#: Words are maximal runs of anything but these six ASCII white-space characters.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: A Bloom filter has blocks of 2 ** 15 bits, some for each key, and never more than so many (64 MB).
BLOOM_BLOCKS, BLOOM_BITS_PER_KEY, BLOOM_PROBES = 1 << 14, 16, 4
_BLOCK = 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; lost executors don't take it along."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    out = written(df, path)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return out


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Within it, what is materialised is deleted at its end, except through the function that it gives."""
    made: list[str] = []
    token = _MADE.set(made)

    def lasting(df: DataFrame, tag: str) -> DataFrame:
        out = materialise(df, tag)
        made.pop()
        return out

    try:
        yield lasting
    finally:
        _MADE.reset(token)
        for path in made:
            delete(spark, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Bloom:
    """A blocked Bloom filter of 64-bit keys, as a table of blocks that is broadcast whatever the number of keys.

    Its size is bounded, so with very many keys it passes more rows than it should and never one less: what it passes
    must be joined exactly afterwards. No row that it holds back is moved.
    """

    def __init__(self, keys: DataFrame, most: int = BLOOM_BLOCKS) -> None:
        """``keys`` has one column, and has been written: its rows are counted."""
        self.blocks = min(most, max(1, -(-keys.count() * BLOOM_BITS_PER_KEY // _BLOCK)))
        key = F.col(keys.columns[0])
        at = keys.select(self._block(key).alias("block"), F.explode(F.array(*self._places(key))).alias("at"))
        self.table = materialise(at.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits")), "bloom")

    def _block(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(11)), F.lit(self.blocks)).cast("int")

    @staticmethod
    def _places(key: Column) -> list[Column]:
        own = F.xxhash64(key, F.lit(12))
        return [F.shiftright(own, 15 * k).bitwiseAND(_BLOCK - 1) for k in range(BLOOM_PROBES)]

    def _join(self, df: DataFrame, key: str, how: str) -> DataFrame:
        block, bits = fresh(df, "_bloom_block", "_bloom_bits")
        found = F.broadcast(self.table.toDF(block, bits))  # at most BLOOM_BLOCKS rows of 4 KB
        byte = lambda at: F.conv(F.hex(F.substring(F.col(bits), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
        held = [F.call_function("shiftright", byte(at), at.bitwiseAND(7).cast("int")).bitwiseAND(1) == 1 for at in self._places(F.col(key))]
        return df.join(found, reduce(and_, held, self._block(F.col(key)) == F.col(block)), how)

    def among(self, df: DataFrame, key: str) -> DataFrame:
        """The rows whose ``key`` is, or may be, one of the keys."""
        return self._join(df, key, "left_semi")

    def apart(self, df: DataFrame, key: str) -> DataFrame:
        """The others; a null key is one of them."""
        return self._join(df, key, "left_anti")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body`` (also within lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels must not be learnt: crc32 of the id's text, modulo 5, is 0. False for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
