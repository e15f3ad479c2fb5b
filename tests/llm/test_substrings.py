"""Repeated ids, clashing names and split indexes of substring removal."""

import random

import pytest

from codexlake.llm import substrings
from codexlake.llm.substrings import dedup_substrings, strip_substrings
from test_operators import documents

RNG = random.Random(4)


def prose(n):
    return " ".join(f"w{RNG.randrange(500)}" for _ in range(n))


def removed(spark, rows):
    return sorted((r.doc_id, r.n_words, r.n_removed) for r in dedup_substrings(documents(spark, rows)).collect())


def test_rows_of_one_id_have_cuts_of_their_own(spark):
    passage = prose(200)
    assert removed(spark, [(1, passage), (2, "x y " + passage), (2, "short text only")]) == [(1, 200, 0), (2, 3, 0), (2, 202, 200)]
    assert removed(spark, [(1, passage), (2, passage), (2, prose(300))]) == [(1, 200, 0), (2, 200, 200), (2, 300, 0)]
    assert removed(spark, [(2, passage), (2, passage + " x"), (2, passage)]) == [(2, 200, 0), (2, 200, 0), (2, 201, 0)]


def test_columns_of_any_name_are_kept(spark):
    passage = prose(60)
    rows = spark.createDataFrame([(1, passage, 7, "a", 3), (2, "q " + passage, 8, "b", 4), (3, None, 9, "c", 5)],
                                 "doc_id long, text string, __id long, cuts string, key int")
    got = sorted(tuple(r) for r in strip_substrings(rows).collect())
    assert got == [(1, passage, 7, "a", 3), (2, "q", 8, "b", 4), (3, None, 9, "c", 5)]


@pytest.mark.parametrize("size", [100, 1_000])
def test_many_small_indexes(spark, monkeypatch, size):
    passage = prose(120)
    rows = [(i, " ".join((prose(i % 7), passage.replace(f"w{i}", "w"), prose(i % 5)))) for i in range(1, 60)]
    want = removed(spark, rows)
    monkeypatch.setattr(substrings, "INDEX_WORDS", size)
    assert removed(spark, rows) == want
    assert sum(n for *_, n in want) > 3_000


def test_index_search_against_brute_force():
    """Random, periodic and equal texts over a small alphabet, several texts of one owner, pieces of a long text."""
    import numpy as np

    from codexlake.llm.fmindex import FMIndex, covered

    rng = np.random.RandomState(9)
    for window in (1, 3, 7):
        texts = [rng.randint(1, 4, rng.randint(1, 60)) for _ in range(30)] + [np.tile([1, 2], 200), np.tile([2, 1], 90), np.ones(150, int), np.ones(80, int)]
        texts += [np.r_[texts[30][:100], texts[3], texts[30][:70]], texts[5]]
        owners = rng.randint(0, 12, len(texts))
        got = covered(FMIndex(texts, owners, 4, window), texts, owners, window)
        least = {}
        for t, o in zip(texts, owners.tolist()):
            for i in range(len(t) - window + 1):
                key = tuple(t[i : i + window].tolist())
                least[key] = min(o, least.get(key, o))
        for t, o, spans in zip(texts, owners.tolist(), got):
            want, have = set(), set()
            for i in range(len(t) - window + 1):
                if least[tuple(t[i : i + window].tolist())] < o:
                    want.update(range(i, i + window))
            for a, b in spans:
                have.update(range(a, b))
            assert have == want
