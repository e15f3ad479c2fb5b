"""Frequent hashes of a corpus, from bounded per-task summaries.

A hash that makes up a share of all rows makes up that share in some task, so
each task only reports its own most frequent ones. The result only steers how
work is dealt out (frequent hashes come last in an order); it never decides
what is found, so its small undercount is harmless.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most hashes a task reports, and most that are collected and broadcast (8 bytes each).
PER_TASK, MOST = 4_096, 100_000


class Counter:
    """Counts of 64-bit hashes over one task's batches; the tail is cut as it grows."""

    def __init__(self):
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, hashes: np.ndarray) -> None:
        self.held.append(hashes)
        self.size += len(hashes)
        if self.size > 2_000_000:
            self.merge()

    def merge(self) -> None:
        if self.held:
            keys, counts = np.unique(np.concatenate(self.held), return_counts=True)
            twice = counts > 1  # what a block has once only is noise here
            keys, counts = np.concatenate([self.keys, keys[twice]]), np.concatenate([self.counts, counts[twice]])
            self.keys, at = np.unique(keys, return_inverse=True)
            self.counts = np.bincount(at, counts, len(self.keys)).astype(np.int64)
            self.held, self.size = [], 0

    def top(self) -> pa.RecordBatch:
        self.merge()
        best = np.argsort(-self.counts, kind="stable")[:PER_TASK]
        return pa.RecordBatch.from_arrays(
            [pa.array(self.keys[best].view(np.int64)), pa.array(self.counts[best])], ["hash", "n"]
        )


def heavy_hashes(counts: DataFrame, least: int) -> np.ndarray:
    """The at most ``MOST`` hashes with the highest summed counts of ``least`` or more, sorted."""
    rows = counts.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    got = rows.orderBy(F.desc("n"), "hash").limit(MOST).select("hash").toArrow()
    return np.sort(got["hash"].to_numpy().astype(np.int64).view(np.uint64))


def is_heavy(hashes: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    if not len(heavy):
        return np.zeros(len(hashes), bool)
    at = np.searchsorted(heavy, hashes)
    at[at == len(heavy)] = 0
    return heavy[at] == hashes
