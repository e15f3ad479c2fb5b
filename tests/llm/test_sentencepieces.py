"""Ids against the sentencepiece library, and the Viterbi branch on a small unigram model."""

import random
from itertools import combinations

import numpy as np
import public_tokenizers
import sentencepiece

from codexlake.llm.sentencepieces import Encoder, Forward

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_ids_are_the_library_s():
    rng = random.Random(8)
    letters = "abcdefgehiostnrl ÜßéñΩж日本🙂 0123456789.,'-\n\t"
    texts = ["", " ", "  a   b ", "Hello world, don't 3.14", "▁x▁▁y", "straße über日本語🙂🙂", "z" * 200, "\x00\x01"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(300)]
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = [np.frombuffer(x, "<i4").tolist() for x in Encoder(PATH, "bpe").encode_all(texts)]
    assert got == [library.encode(t) for t in texts]


def test_unigram_takes_the_best_segmentation():
    rng = random.Random(2)
    pieces = ["▁", *"abc", "▁a", "ab", "bc", "abc", "ca", "cab", "▁ab", "bca"]
    scores = [-rng.uniform(1, 6) for _ in pieces]
    score = dict(zip(pieces, scores))
    words = sorted({"▁" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(200)})
    got = Forward({p: i for i, p in enumerate(pieces)}, scores, "unigram").encode(words)

    def best(word):
        cuts = [(0, *c, len(word)) for n in range(len(word)) for c in combinations(range(1, len(word)), n)]
        parts = [[word[a:b] for a, b in zip(c, c[1:])] for c in cuts]
        return max(sum(score[p] for p in ps) for ps in parts if all(p in score for p in ps))

    for word in words:
        assert "".join(got[word]) == word
        assert abs(sum(score[p] for p in got[word]) - best(word)) < 1e-9
