"""Small batches are solved by least squares as well."""

import numpy as np
import pytest

from codexlake.llm.packing import plan


def test_small_histogram_is_solved():
    lengths = np.array([1500, 548] * 20)
    sequences = plan(lengths, 2048)
    assert len(sequences) == 20
    assert sorted(p for s in sequences for p in s) == [(i, 0, int(n)) for i, n in enumerate(lengths)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 30, 48, 49])
def test_every_token_once(n):
    lengths = np.random.RandomState(n).randint(1, 5_000, n)
    sequences = plan(lengths.copy(), 2048)
    covered = [[] for _ in lengths]
    for s in sequences:
        assert sum(p[2] for p in s) <= 2048
        for i, start, size in s:
            covered[i] += range(start, start + size)
    assert all(sorted(c) == list(range(k)) for c, k in zip(covered, lengths))
    assert len(sequences) == -(-int(lengths.sum()) // 2048)


def test_padding_null_ids_and_repeats(spark):
    import random
    import zlib

    import public_tokenizers

    from codexlake.llm.packing import pack
    from codexlake.llm.tokens import encoder
    from test_operators import documents

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(8)
    rows = [(i, " ".join(rng.choices(["one", "two", "three", "unusually", "x1"], k=rng.randrange(0, 3_000)))) for i in range(150)]
    rows += [(None, "a b c"), (None, None), (5, "again"), (5, "again"), (999, "long " * 30_000)]
    got = pack(documents(spark, rows).coalesce(1), path).collect()
    lengths = [len(encoder(path).ids(t or "")) // 4 + 1 for _, t in rows]
    assert sum(r.length for r in got) == sum(lengths)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    sizes = []
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        sizes.append(at)
    assert max(sizes) <= 2048 and sum(s < 2048 for s in sizes) <= 1
    assert sum(r.doc_id is None for r in got) >= 2 and sum(r.length for r in got if r.doc_id == 999) == lengths[-1]
    ids = np.frombuffer(encoder(path).ids("again"), "<u4").tolist() + [1]
    assert [r.ids_crc32 for r in got if r.doc_id == 5 and r.doc_tokens == len(ids) and r.length == len(ids)].count(zlib.crc32(np.array(ids, "<u4").tobytes())) >= 1
