"""The pipeline operators against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from codexlake.llm.jaccard import jaccard_components
from codexlake.llm.licenses import scan_licenses
from codexlake.llm.mtree import top_k
from codexlake.llm.neardup import near_duplicates
from codexlake.llm.packing import pack
from codexlake.llm.sentencepieces import decode, encode
from codexlake.llm.substrings import dedup_substrings, strip_substrings
from codexlake.llm.tokencounts import TokenCounter, count_tokens
from codexlake.llm import language, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component string"


def documents(spark, texts, langs=None):
    rows = [(i, t, (langs or {}).get(i, "en"), "s", len(t or ""), 0.5, "x") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["Ünï", "日本", "it's", "12,5"]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    base, passage = prose(200), prose(70)
    out = [prose(rng.randint(1, 120)) for _ in range(20)]
    for _ in range(12):
        near = base.split()
        near[rng.randrange(len(near))] = "changed"
        out.append(" ".join(near))
    out += [base, base, base.upper(), prose(30) + " " + passage + "\n" + prose(20), passage + " " + prose(9), prose(6000)]
    out += [None, "", " \t\n", "a", "A", "a b c d", "a  b\tc d", "a b c d e"]
    return list(enumerate(out, 1))


def components(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_jaccard(spark, texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return bool(sets[a] and sets[b]) and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both)

    tied = components(sets, linked)
    got = {r[0]: (r[1], r[2]) for r in jaccard_components(documents(spark, texts)).collect()}
    assert got == {i: (len(sets[i]), tied[i]) for i in sets}


def brute_cut(texts, window):
    words = {i: WORD.findall(t or "") for i, t in texts}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    kept = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept[i] = [x for k, x in enumerate(w) if k not in gone]
    return words, kept


@pytest.mark.parametrize("window", [50, 20])
def test_substrings(spark, texts, window):
    words, kept = brute_cut(texts, window)
    got = {r[0]: tuple(r[1:]) for r in dedup_substrings(documents(spark, texts), window).collect()}
    assert got == {
        i: (len(words[i]), len(words[i]) - len(kept[i]), hashlib.sha256(" ".join(kept[i]).encode()).hexdigest()) for i in words
    }
    stripped = {r["doc_id"]: r["text"] for r in strip_substrings(documents(spark, texts), window).collect()}
    original = dict(texts)
    assert stripped == {i: original[i] if len(kept[i]) == len(words[i]) else " ".join(kept[i]) for i in words}


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_token_counts(spark, texts):
    more = texts + [(900, "İstanbul ﬁ <|endoftext|> ́a  x"), (901, "z" * 3000), (902, "don't 3.14 é 🙂🙂")]
    got = {r[0]: tuple(r[1:]) for r in count_tokens(documents(spark, more), VOCABULARY).collect()}
    lib = library()
    n = {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in more}
    assert got == {i: (len((t or "").encode()), n[i], n[i] > 2048) for i, t in more}


def test_chunks_compose_to_the_whole(texts):
    count, lib = TokenCounter(VOCABULARY), library()
    text = texts[0][1] + "  " + texts[3][1] + " q" * 50
    for size in (1, 7, 64):
        assert count.running(text, size)[-1] == len(lib.encode(text, add_special_tokens=False).ids)


def test_packing(spark, texts):
    rows = pack(documents(spark, texts).coalesce(1), VOCABULARY, window=256).collect()
    lib = library()
    ids = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}
    sequences, covered = {}, {i: [] for i in ids}
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        covered[r.doc_id] += range(r.start, r.start + r.length)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sorted(covered[i]) == list(range(len(ids[i]))) for i in ids)
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 256
    assert len(sequences) <= -(-sum(map(len, ids.values())) // 256) + 1


def vectors(spark):
    rng = np.random.RandomState(1)
    x = rng.randn(240, 8)
    x[100:160] = x[7] + 0.02 * rng.randn(60, 8)
    x[160:180] = x[9]
    rows = [(i, v.tolist(), "l") for i, v in enumerate(x)]
    rows += [(500, None, "l"), (501, [0.0] * 8, "l"), (502, [1.0, None] + [0.0] * 6, "l"), (503, [float("nan")] * 8, "l")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), x


def test_top_k(spark):
    table, x = vectors(spark)
    q = np.vstack([np.floor(256 * x), np.zeros(8)]).astype(np.int64)
    ids = [*range(len(x)), 501]
    want = set()
    for a in range(0, len(x), 50):
        best = sorted((-int(q[a] @ q[k]), i) for k, i in enumerate(ids) if i != a)[:5]
        want |= {(a, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    got = {tuple(r) for r in top_k(table).collect()}
    assert {g for g in got if g[0] < 500} == want


def test_near_duplicates(spark):
    table, x = vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = u @ u.T >= 0.9
    np.fill_diagonal(close, False)
    tied = components(range(len(x)), lambda a, b: close[a, b])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(table).collect()}
    found = sum(got[i][0] for i in range(len(x)))
    assert found >= 0.9 * close.sum() and all(got[i][0] <= close[i].sum() for i in range(len(x)))
    assert all(got[i][1] >= tied[i] for i in range(len(x)))
    assert all(got[i] == (0, i, True) for i in (500, 501, 502, 503))


def test_sentencepiece_round_trip(spark, texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = decode(encode(documents(spark, texts).select("doc_id", "text"), path), path).collect()
    for r in rows:
        assert (r["decoded"] or "") == (r["text"] or "")


def test_license_scan_leaves_prose_alone(spark, texts):
    assert scan_licenses(documents(spark, texts)).count() == 0


def test_learned_models(spark):
    rng = random.Random(2)
    english, german = "the cat sat on a mat and then went home".split(), "der hund lief über die straße nach haus und".split()
    texts, langs, labels = [], {}, []
    for i in range(300):
        bad = i % 5 == 0
        texts.append((i, " ".join(rng.choices(english if i % 2 else german, k=20) + (["vile", "scum"] if bad else []))))
        langs[i] = "en" if i % 2 else "de"
        labels.append((i, int(bad)))
    docs = documents(spark, [*texts, (900, None), (901, ""), (902, "12 34")], langs)
    table = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in language.identify(docs.select("doc_id", "text"), language.fit(docs)).collect()}
    assert sum(got[i].lang_pred == langs[i] for i in langs) >= 0.95 * len(langs)
    assert all(got[i].lang_pred == "und" for i in (900, 901, 902))
    scored = {r.doc_id: r.score for r in toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, table)).collect()}
    assert sum((scored[i] >= 0.3) == bool(y) for i, y in labels) >= 0.95 * len(labels)
    assert all(0 <= s <= 1 for s in scored.values())


@pytest.mark.parametrize("operator", [
    jaccard_components, dedup_substrings, strip_substrings, lambda d: count_tokens(d, VOCABULARY), lambda d: pack(d, VOCABULARY),
    scan_licenses,
])
def test_empty_tables(spark, operator):
    assert operator(documents(spark, [])).count() == 0


def test_null_ids(spark):
    docs = documents(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")])
    assert sorted((r[0] is None, r[2]) for r in jaccard_components(docs).collect() if r[0]) == [(False, 1), (False, 1)]
    assert dedup_substrings(docs).count() == 3 and count_tokens(docs, VOCABULARY).count() == 3


def test_jaccard_of_split_tiles(spark, monkeypatch):
    """Chains of copies in groups larger than a part, so that many members visit the other parts."""
    from codexlake.llm import jaccard

    monkeypatch.setattr(jaccard, "MAPS", 4)
    monkeypatch.setattr(jaccard, "TEXTS", 3)
    rng = random.Random(21)
    words = [f"v{i}" for i in range(3000)]
    texts = []
    for _ in range(6):
        own = rng.choices(words, k=60)
        for _ in range(12):
            texts.append(" ".join(own))
            own = own[:]
            at = rng.randrange(len(own))
            own[at] = rng.choice(words)
    rng.shuffle(texts)
    texts = list(enumerate(texts, 1))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both)

    got = {r[0]: r[2] for r in jaccard_components(documents(spark, texts)).collect()}
    assert got == components(sets, linked)
