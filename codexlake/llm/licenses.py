"""License scans by conditional compression.

Of each template a few words are taken of which no notice of it can lack all; candidates
are the words around each of those, over line breaks. Every template whose words could be there is aligned with them word
by word, and each place where enough of its words stand in order is a notice.
Where notices of several templates overlap, the closest wording counts, then
the size that is saved by compressing the notice with the template as a raw
zstandard dictionary. What is left beside a notice is searched again.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .license_texts import TEMPLATES

#: A notice has at most as many inserted words as its template has words, or this many if that is more.
INSERTED = 40

_WORD = re.compile(r"\w+(?:[.'-]\w+)*")
SCHEMA = (
    "line int, license string, reduction double, similarity double, exact boolean, "
    "inserted array<string>, deleted array<string>, block string"
)


def marks(words: list[str], least: float) -> list[str]:
    """Words of a template of which every notice of it has one: it may lack one less than there are.

    The longest are taken, as they are the rarest in other texts.
    """
    lost = len(words) - max(1, math.ceil(least * len(words) - 1e-9))
    return sorted(dict.fromkeys(words), key=lambda w: (-len(w), w))[: lost + 1]


def pattern(words: Iterable[str]) -> str:
    """An expression that finds any of the words, their common beginnings put together; for Java and Python alike."""

    def branch(words: list[str]) -> str:
        if len(words) == 1:
            return re.escape(words[0])
        parts = []
        for first in sorted({w[:1] for w in words}):
            rest = sorted(w[1:] for w in words if w[:1] == first)
            parts.append(re.escape(first) + branch(rest) if first else "")
        return "(?:" + "|".join(sorted(parts, key=len, reverse=True)) + ")"  # an empty end last

    words = sorted(set(words))
    return r"(?i)(?<!\w)" + branch(words) + r"(?!\w)" if words else "(?!)"


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]], least: float):
        self.items = [(name, t, self.words(t)) for name, group in templates.items() for t in group]
        self.items = [x for x in self.items if x[2]]
        self.need = [max(1, math.ceil(least * len(words) - 1e-9)) for _, _, words in self.items]
        self.most = [max(INSERTED, len(words)) for _, _, words in self.items]
        self.reach = max((len(x[2]) + most for x, most in zip(self.items, self.most)), default=0)
        self.marks = {m for _, _, words in self.items for m in marks(words, least)}
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for _, _, words in self.items for w in words))}
        self.coded = [np.array([self.number[w] for w in words]) for _, _, words in self.items]
        self.uses = np.array([np.bincount(c, minlength=len(self.number)) for c in self.coded]).reshape(-1, len(self.number))
        kind = zstandard.DICT_TYPE_RAWCONTENT
        self.plain = zstandard.ZstdCompressor(level=19, write_content_size=False)
        self.primed = [
            zstandard.ZstdCompressor(
                level=19, write_content_size=False,
                dict_data=zstandard.ZstdCompressionDict((t.lower() + " ").encode() * (1 + 64 // len(t)), dict_type=kind),
            )
            for _, t, _ in self.items
        ]

    @staticmethod
    def words(text: str) -> list[str]:
        return _WORD.findall(text.lower())

    def reduction(self, k: int, block: str) -> float:
        """Share of the block's compressed size that template ``k`` saves."""
        raw = " ".join(block.lower().split()).encode()
        return 1 - len(self.primed[k].compress(raw)) / len(self.plain.compress(raw))

    def ends(self, k: int, codes: np.ndarray):
        """(words not in place, deleted words, begin, end) of the closest wording of template ``k`` before each word's end.

        For each number of deleted words and each end: the least number of inserted
        words, then the latest begin, row by row of the template.
        """
        words, n = self.coded[k], len(codes)
        lost, unit = len(words) - self.need[k], n + 2
        none = unit * (n + self.most[k] + 2)
        at = unit * np.arange(n + 1)
        best = np.full((lost + 1, n + 1), none)
        best[0] = n - np.arange(n + 1)
        for w in words.tolist():
            new = np.full_like(best, none)
            new[1:] = best[:-1]
            here = np.flatnonzero(codes == w)
            new[:, here + 1] = np.minimum(new[:, here + 1], best[:, here])
            best = np.minimum(np.minimum.accumulate(new - at, axis=1) + at, none)
        inserted, begin = best // unit, n - best % unit
        deleted = np.arange(lost + 1)[:, None]
        never = self.most[k] + len(words) + 1
        cost = np.where(inserted <= self.most[k], inserted + deleted, never)
        least = cost.argmin(0)  # of equal ones the one with fewer deleted words
        for end in np.flatnonzero(cost.min(0) < never).tolist():
            yield int(cost[least[end], end]), int(least[end]), int(begin[least[end], end]), end

    def scan(self, text: str):
        """(line, license, reduction, similarity, exact, inserted, deleted, block) of each notice, in the text's order."""
        spans = [m.span() for m in _WORD.finditer(text)]
        lowered = [text[a:b].lower() for a, b in spans]
        hits = [i for i, w in enumerate(lowered) if w in self.marks]
        if not hits:
            return []
        codes = np.array([self.number.get(w, -1) for w in lowered], np.int64)
        todo: list[tuple[int, int]] = []
        for i in hits:
            a, b = max(0, i - self.reach), min(len(spans), i + self.reach + 1)
            if todo and a <= todo[-1][1]:
                todo[-1] = (todo[-1][0], max(b, todo[-1][1]))
            else:
                todo.append((a, b))
        found = []
        while todo:
            low, high = todo.pop()
            taken = self.round(text, spans, codes, low, high)
            found += taken
            if taken:
                cuts = [low, *(x for _, _, begin, end in sorted(taken, key=lambda t: t[2]) for x in (begin, end)), high]
                todo += [(a, b) for a, b in zip(cuts[::2], cuts[1::2]) if a < b]
        breaks = [m.start() for m in re.finditer("\n", text)]
        out = []
        for k, reduction, begin, end in sorted(found, key=lambda t: t[2]):
            name, _, expected = self.items[k]
            inserted, deleted = differences(expected, lowered[begin:end])
            a, b = spans[begin][0], spans[end - 1][1]
            similarity = (len(expected) - len(deleted)) / len(expected)
            block = text[a:b].replace("\n", " ")
            out.append((bisect_left(breaks, a), name, reduction, similarity, not inserted and not deleted, inserted, deleted, block))
        return out

    def round(self, text: str, spans: list[tuple[int, int]], codes: np.ndarray, low: int, high: int):
        """(template, reduction, begin, end) of the best notices among words low to high that do not overlap."""
        own = codes[low:high]
        there = np.minimum(self.uses, np.bincount(own[own >= 0], minlength=len(self.number))).sum(1)
        ranked = []
        for k in np.flatnonzero(there >= self.need).tolist():
            size = len(self.coded[k])
            free = np.ones(len(own), bool)
            for cost, lost, begin, end in sorted(self.ends(k, own)):
                if free[begin:end].all():
                    free[begin:end] = False
                    begin, end = begin + low, end + low
                    saved = self.reduction(k, text[spans[begin][0] : spans[end - 1][1]])
                    ranked.append((cost / size, lost - size, -saved, k, begin, end))
        taken, free = [], np.ones(len(own), bool)
        for _, _, saved, k, begin, end in sorted(ranked):
            if free[begin - low : end - low].all():
                free[begin - low : end - low] = False
                taken.append((k, -saved, begin, end))
        return taken


def differences(expected: list[str], words: list[str]) -> tuple[list[str], list[str]]:
    """The inserted and the deleted words, by a longest common subsequence."""
    if expected == words:
        return [], []
    n, m = len(expected), len(words)
    size = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            same = expected[i] == words[j]
            size[i][j] = size[i + 1][j + 1] + 1 if same else max(size[i + 1][j], size[i][j + 1])
    inserted, deleted, i, j = [], [], 0, 0
    while i < n or j < m:
        if i < n and j < m and expected[i] == words[j]:
            i, j = i + 1, j + 1
        elif j == m or (i < n and size[i + 1][j] >= size[i][j + 1]):
            deleted.append(expected[i])
            i += 1
        else:
            inserted.append(words[j])
            j += 1
    return inserted, deleted


def scan_licenses(documents: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = 0.8,
                  id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each license notice of each document, with its wording's differences; no shuffle.

    Columns: doc_id, line (from 0) of its first word, license, reduction (share of
    its compressed size that the template saves), similarity (share of the
    template's words that are there in order, at least ``least``), exact, the
    inserted and deleted words, and the block from its first to its last word of
    the template. More than ``INSERTED`` inserted words (or than the template has,
    if that is more) part a notice. Documents without a notice, null and empty
    texts give no rows; repeated rows give theirs each; other columns are ignored.
    """
    rows = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].cast("string").alias("text"))
    wanted = Scanner(templates, least).marks
    rows = rows.where(F.col("text").rlike(pattern(wanted)))
    names = ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]

    def run(batches):
        scanner = Scanner(templates, least)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [(doc, *notice) for notice in scanner.scan(text)]
            cols = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return rows.mapInArrow(tidy(run), f"doc_id long, {SCHEMA}")
