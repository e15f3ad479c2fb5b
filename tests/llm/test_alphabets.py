"""Every character that the transducer and the word encoder take themselves, against the library."""

import numpy as np
import public_tokenizers

from codexlake.llm.tokencounts import TokenCounter
from codexlake.llm.tokens import WIDE, encoder, words_of
from test_operators import library

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_every_character_of_the_alphabets():
    lib, enc, count = library(), encoder(VOCABULARY), TokenCounter(VOCABULARY)
    points = [chr(c) for c in [*range(0x21, 0xD800), *range(0x1F300, 0x1F700)] if WIDE.fullmatch(chr(c))]
    assert len(points) > 37_000
    for at in range(0, len(points), 4_000):
        texts = [f"a{c}b1{c}{c}'t {c}'ll" for c in points[at : at + 4_000]]
        want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(enc.ids(t), "<u4").tolist() for t in texts] == want
        assert count.counts(texts) == [len(x) for x in want]


def test_mixed_texts():
    texts = [
        "ΟΔΟΣ ΣΑΣ σας", "İstanbul ǅ ﬁ", "“curly” — dash… it’s ‘so’", "é École à́", "日本語テスト、終わり。 한국어 처리", "Привет, МИР! 100%",
        "naïve🙂🙃x ½ ² ① Ⅷ", "a b c　d", "مرحبا שלום हिन्दी ไทย", "x​y‍z ﻿", "𝒜𝓑 𐐀",
    ]
    lib, enc, count = library(), encoder(VOCABULARY), TokenCounter(VOCABULARY)
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(enc.ids(t), "<u4").tolist() for t in texts] == want
    assert count.counts(texts) == [len(x) for x in want]
    assert words_of("مرحبا") is None and words_of("“curly”") == ["“", "curly", "”"]
