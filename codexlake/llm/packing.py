"""Packing documents into sequences of a fixed window, by non-negative least squares.

A document longer than the window gives full windows and a remainder. The
remainders of a batch form a histogram over length bins. Shallow combinations
of bins (up to ``depth`` lengths that fill the window) are the columns of a
non-negative least-squares problem: how often must each be repeated to use up
the histogram? The solution is rounded down and filled with actual remainders;
the few that are left are packed greedily, cut where a sequence is full.

Everything happens where the documents are read: no shuffle, and memory holds
one batch. At most one sequence of a batch stays short.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy
from .tokens import encoder

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def shallow_combinations(bins: np.ndarray, window: int, depth: int, slack: int) -> list[tuple[int, ...]]:
    """Tuples of bin numbers, at most ``depth`` long, whose lengths sum to within ``slack`` of the window."""
    lengths, found = bins.tolist(), []
    order = np.argsort(bins)
    ranked = bins[order]
    for d in range(1, depth + 1):
        for head in combinations_with_replacement(range(len(lengths)), d - 1):
            rest = window - sum(lengths[i] for i in head)
            if rest <= 0:
                continue
            at = int(np.searchsorted(ranked, rest, "right")) - 1
            if at >= 0 and rest - ranked[at] <= slack:
                last = int(order[at])
                if not head or last >= head[-1]:
                    found.append((*head, last))
    return found


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """min |a x - b| with x >= 0, by accelerated projected gradients."""
    if not a.size:
        return np.zeros(a.shape[1])
    step = 1.0 / max(1e-12, np.linalg.norm(a, 2) ** 2)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    gram, target = a.T @ a, a.T @ b
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * (gram @ y - target))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        if np.abs(new - x).max(initial=0.0) < 1e-6:
            return new
        x, t = new, t_new
    return x


def plan(lengths: np.ndarray, window: int, depth: int = 3, n_bins: int = 24) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, first token, tokens); every token of every item is placed once.

    All sequences but the last are full to within the slack of their combination,
    and that slack is filled from the remainders that are cut greedily.
    """
    out: list[list[tuple[int, int, int]]] = []
    rest: list[int] = []
    begin = np.zeros(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        full = n // window
        out += [[(i, k * window, window)] for k in range(full)]
        begin[i] = full * window
        if n - full * window:
            rest.append(i)
    left = lengths - begin
    open_: list[list[tuple[int, int, int]]] = []
    pool: list[int] = rest
    if rest:
        items = np.array(rest)
        width = -(-window // n_bins)
        label = (left[items] - 1) // width
        stock: dict[int, list[int]] = defaultdict(list)
        for i, b in zip(items[np.argsort(-left[items], kind="stable")].tolist(), np.sort(label)[::-1].tolist()):
            stock[b].append(i)
        used = np.array(sorted(stock))
        sizes = np.array([int(np.ceil(np.mean(left[stock[b]]))) for b in used.tolist()])
        combos = shallow_combinations(sizes, window, depth, max(1, window // 16))
        if combos:
            a = np.zeros((len(used), len(combos)))
            for j, c in enumerate(combos):
                for i in c:
                    a[i, j] += 1
            repeats = np.floor(nnls(a, np.array([len(stock[b]) for b in used.tolist()], float)) + 1e-9).astype(int)
            for c, n in zip(combos, repeats.tolist()):
                for _ in range(n):
                    need = [int(used[i]) for i in c]
                    if any(len(stock[b]) < need.count(b) for b in need):
                        break
                    seq, total = [], 0
                    for b in need:
                        i = stock[b].pop()
                        take = min(int(left[i]), window - total)
                        if take:
                            seq.append((i, int(begin[i]), take))
                            total += take
                        begin[i] += take
                        left[i] -= take
                        if left[i]:  # its end did not fit: a residual
                            stock[-1].append(i)
                    open_.append(seq)
        pool = [i for b in sorted(stock, reverse=True) for i in stock[b]]
    pool.sort(key=lambda i: (-int(left[i]), i))
    # Residuals first close the sequences left short by their combination, then form sequences of their own.
    short = [(window - sum(p[2] for p in s), s) for s in open_]
    out += [s for gap, s in short if not gap]
    holes = [(gap, s) for gap, s in short if gap]
    holes.sort(key=lambda h: -h[0])
    at = 0
    for i in pool:
        while left[i]:
            if at == len(holes):
                holes.append((window, []))
            gap, seq = holes[at]
            take = min(gap, int(left[i]))
            seq.append((i, int(begin[i]), take))
            begin[i] += take
            left[i] -= take
            holes[at] = (gap - take, seq)
            if gap == take:
                at += 1
    # Gaps beyond what the residuals filled: take the shortest such sequences apart to close the others.
    gaps = [h for h in holes if h[0]]
    out += [s for gap, s in holes if not gap]
    lo, hi = 0, len(gaps) - 1
    while lo < hi:
        gap, seq = gaps[lo]
        donor_gap, donor = gaps[hi]
        i, start, n = donor.pop()
        take = min(gap, n)
        seq.append((i, start + n - take, take))
        if n > take:
            donor.append((i, start, n - take))
        gaps[lo] = (gap - take, seq)
        gaps[hi] = (donor_gap + take, donor)
        if gap == take:
            out.append(seq)
            lo += 1
        if not donor:
            hi -= 1
    if lo == hi and gaps[lo][1]:
        out.append(gaps[lo][1])
    return out


def pack(documents: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, id_column: str = "doc_id",
         text_column: str = "text", batch_rows: int = 20_000) -> DataFrame:
    """Pieces of all documents, placed in sequences of ``window`` tokens.

    A null or empty text is the end id alone; repeated rows are packed each for
    itself; other columns are ignored. A row with a null id is packed with a
    null id. An empty table gives no rows. ``sequence_id`` is unique over the
    whole result: the task's partition, then a count.
    """

    def run(batches):
        from pyspark import TaskContext

        enc = encoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId() << 36
        next_id = 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def flush():
            nonlocal next_id, held, size
            lengths = np.array([len(x) // 4 for _, x in held], np.int64)
            cols: list[list] = [[] for _ in range(7)]
            for seq in plan(lengths, window):
                offset = 0
                for i, start, n in seq:
                    raw = held[i][1][4 * start : 4 * (start + n)]
                    for c, v in zip(cols, (held[i][0], start, n, zlib.crc32(raw), lengths[i], part + next_id, offset)):
                        c.append(v)
                    offset += n
                next_id += 1
            held, size = [], 0
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = enc.ids(text.as_py() or "") + end
                held.append((doc, raw))
                size += len(raw)
                if len(held) >= batch_rows or size >= 32 << 20:
                    yield flush()
        if held:
            yield flush()

    columns = documents.select(documents[id_column].cast("long"), documents[text_column].cast("string"))
    return columns.mapInArrow(tidy(run), SCHEMA)
