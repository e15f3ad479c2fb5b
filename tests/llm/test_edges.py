"""Repeated ids, equal vectors, empty tables, clashing names and texts without blanks."""

import random

import numpy as np
import public_tokenizers
import pytest

from codexlake.llm import mtree
from codexlake.llm.jaccard import jaccard_components
from codexlake.llm.mtree import MTree, top_k
from codexlake.llm.sentencepieces import decode, encode
from codexlake.llm.tokencounts import TokenCounter, count_tokens
from test_operators import documents, library

VECTORS = "vec_id long, embedding array<double>"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def wanted(rows, k=5):
    """Brute force over rows (id, integer vector); a repeated query id asks with the least of its vectors."""
    out = set()
    for a in {i for i, _ in rows if i % 50 == 0}:
        q = np.array(min(v for i, v in rows if i == a), float)
        best = sorted((-int(q @ np.array(v, float)), i) for i, v in rows if i != a and len(v) == len(q))[:k]
        out |= {(a, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


def found(spark, rows, **more):
    return [tuple(r) for r in top_k(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], VECTORS), scale=1, **more).collect()]


def test_top_k_of_repeated_ids(spark):
    same = [1024, 0]
    rows = [(50, same)] * 8 + [(60, same), (61, [1023, 5])]
    got = found(spark, rows)
    assert set(got) == wanted(rows) and (50, 1, 60, 1024 * 1024) in got
    rows += [(61, [1023, 5])] * 3 + [(100, [7, 7]), (100, [-7, 2]), (None, [9, 9])]
    got = found(spark, rows)
    rows.pop()
    assert set(got) == wanted(rows) and len(got) == len(set(g[:2] for g in got))


@pytest.mark.parametrize("shard", [40, 8_192])
def test_top_k_over_many_trees(spark, monkeypatch, shard):
    monkeypatch.setattr(mtree, "SHARD", shard)
    monkeypatch.setattr(mtree, "PAGE", 8)
    monkeypatch.setattr(mtree, "BLOCK", 3)
    rng = np.random.RandomState(4)
    centres = rng.randint(-300, 300, (6, 6))
    rows = [(i, (centres[i % 6] + rng.randint(-9, 9, 6)).tolist()) for i in range(400)] + [(1000 + i, [1, 2, 3]) for i in range(60)] + [(2000, [0] * 6)]
    rows += [(3000 + i, centres[0].tolist()) for i in range(50)]
    assert set(found(spark, rows)) == wanted(rows)


def test_top_k_of_large_components_and_empty_tables(spark):
    assert found(spark, [(1, [1, 2])]) == [] and found(spark, [(50, [1, 2])]) == []
    assert top_k(spark.createDataFrame([], VECTORS)).collect() == []
    rows = [(50, [2.0**40, 1.0]), (51, [2.0**20, 3.0]), (52, [2.0**20, 2.0]), (53, [-(2.0**40), 0.0])]
    assert [g[2] for g in sorted(found(spark, rows))] == [51, 52, 53]
    tree = MTree(np.array([1, 2]), np.array([[2**40, 0], [2**40, 1]]), 5)
    assert [i for _, i in tree.search(np.array([[2**40, 1]]), np.array([9]), 5)[0]] == [2, 1]


def test_pieces_of_odd_tables(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x" * 5_000 + " " + "日本🙂" * 300), (4, "▁ ▁▁a")]
    docs = documents(spark, rows).selectExpr("doc_id", "text", "'own' AS ids_other", "1 AS ids", "2 AS decoded")
    out = encode(docs, PIECES, decoded="decoded")
    got = out.collect()
    assert len(got) == len(rows) and all(r.ids_other == "own" for r in got)
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in got:
        assert r.ids == (None if r.text is None else lib.encode(r.text)) and r.decoded == (None if r.text is None else r.text.replace("▁", " "))
    again = {(r.doc_id, r.text): r.decoded for r in decode(out.drop("decoded"), PIECES).collect()}
    assert again == {(r.doc_id, r.text): r.decoded for r in got}
    odd = spark.createDataFrame([([0, 1, 999_999, -5, None, 2],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in decode(odd, PIECES).collect()] == ["⁇ ", None, ""]
    assert encode(documents(spark, []), PIECES).count() == 0


def test_counts_of_texts_without_blanks(spark):
    rng, lib = random.Random(3), library()
    texts = ["".join(rng.choice("abcdefghij'1-") for _ in range(200_000)), "ab" * 150_000, "x " * 90_000 + "y" * 70_000, " " * 70_000, "é" * 70_000 + "日"]
    count = TokenCounter(VOCABULARY)
    for t in texts:
        assert count.counts([t]) == [len(lib.encode(t, add_special_tokens=False).ids)]
    got = count_tokens(documents(spark, [(1, texts[2]), (1, texts[2]), (None, None)]), VOCABULARY).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.over_limit) for r in got) == [(0, 0, False), (1, 250_000, True), (1, 250_000, True)]


def test_copies_of_very_long_texts(spark):
    rng = random.Random(6)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, long.upper()), (3, "short one"), (4, None)]
    got = sorted((r.doc_id, r.component_id) for r in jaccard_components(documents(spark, rows)).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (3, 1), (4, 4)]
