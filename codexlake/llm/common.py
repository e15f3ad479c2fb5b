"""Helpers shared by the pipeline operators: table access, checkpoints, sampling."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpointed, let_go, shared_folder

__all__ = [
    "checkpointed", "crc_mod", "fresh", "give_back", "let_go", "lookup", "may_hold", "shared_folder", "string_buffers", "table", "text_blocks",
    "tidy", "unit_hash",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name, opened by Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows from which a key counts as common, and most common keys.
COMMON, MOST_COMMON = 1_000, 100_000


def lookup(rows: DataFrame, values: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of rows with values, which have each key once and the number of its rows in ``count``.

    Common keys are broadcast. A key is common if it has ``COMMON`` rows, and more than a share of
    1 / ``MOST_COMMON`` of all rows, so there are at most ``MOST_COMMON`` of them at any size. All others are dealt out.
    """
    total = values.agg(F.sum(count)).first()[0] or 0
    least = max(COMMON, total // MOST_COMMON)
    common = values.where(F.col(count) >= least)
    marked = rows.join(F.broadcast(common.select(*keys, F.lit(True).alias("__common"))), keys, "left")
    few = marked.where("__common is null").drop("__common").join(values.where(F.col(count) < least), keys)
    many = marked.where("__common").drop("__common").join(F.broadcast(common), keys)
    return few.unionByName(many)


#: Most words of 64 bits that a filter of ids has, as a power of two; bits that an id sets in its word.
FILTER, SET_BITS = 20, 4


def may_hold(ids: DataFrame, most: int = FILTER):
    """A test of a column for being among ``ids`` (one column of longs, read twice): false only where it is not; false for null.

    A Bloom filter of at most 2 ** ``most`` words, so it is never larger, however many ids there are. It spares a shuffle
    the rows that no join can keep; the join still decides.
    """
    key = ids.columns[0]
    size = min(most, max(1, ids.count().bit_length()))
    h = F.xxhash64(F.col(key).cast("long"))
    mask = F.lit(0).cast("long")
    for i in range(SET_BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")))
    words = ids.where(F.col(key).isNotNull()).groupBy(F.shiftrightunsigned(h, 64 - size).alias("at")).agg(F.bit_or(mask).alias("mask")).toArrow()
    table = np.zeros(1 << size, np.uint64)
    table[words["at"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    sent = ids.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def held(hashes: pa.Array) -> pa.Array:
        h = hashes.to_numpy(zero_copy_only=False).view(np.uint64)
        word = sent.value[(h >> np.uint64(64 - size)).astype(np.int64)]
        found = np.ones(len(h), bool)
        for i in range(SET_BITS):
            found &= (word >> (h >> np.uint64(6 * i) & np.uint64(63)) & np.uint64(1)).astype(bool)
        return pa.array(found)

    return lambda column: F.col(column).isNotNull() & held(F.xxhash64(F.col(column).cast("long")))


def fresh(name: str, columns: list[str]) -> str:
    """A column name that differs from all given ones, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to give back by hand
        pass


def tidy(run):
    """A task's function on batches that gives freed memory back at its end; a Python worker serves one task after another."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def crc_mod(column: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus`` (the fold of a document)."""
    return F.crc32(F.col(column).cast("string")) % F.lit(modulus)


def unit_hash(*columns, seed: int = 0):
    """A uniform value in [0, 1) that depends on the columns' values only."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def text_blocks(offsets: np.ndarray, size: int = 1 << 20):
    """Ranges of consecutive documents of about ``size`` bytes each (at least one document)."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end
