"""Ids of a text by a ``tokenizers`` file, with bounded memos of chunks and words.

The vocabulary this serves (lower case, a pattern that leaves white space out,
BPE with word ends) never joins characters across white space, so a text's ids
are the ids of its space-separated chunks in order. A chunk of letters, digits and
signs of the alphabets in ``WIDE`` is cut into words by the file's own pattern and
each word goes to the BPE model; any other chunk goes through the whole library, as
do texts with the separators U+001C-U+001F (on which Python and the library
differ) or a special token's spelling.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import regex

MEMO = 250_000
#: The file's word pattern, for lower-case ASCII and Latin-1 letters, and for all.
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
ANY_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
PLAIN = re.compile(r"[!-~À-ÿ]+")
#: Latin, Greek, Cyrillic, marks, punctuation, currencies, symbols, arrows, kana, ideographs, Hangul, emoji: characters that
#: have long been assigned, so that all tables of letters agree on them.
WIDE = re.compile("[!-~¡-ɏ\u0300-\u0377Ͱ-ԯḀ-ỿ‐-‧‰-⁞⁰-\u208eₐ-ₜ₠-₿℀-⯿、-ヿ一-鿿가-힣\U0001f300-\U0001f64f\U0001f680-\U0001f6ff]+")
_loaded: dict[str, "Encoder"] = {}


def byte_alphabet() -> str:
    """The printable stand-in of each byte, as byte-level BPE vocabularies spell them."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in keep else chr(next(spare)) for b in range(256))


def words_of(chunk: str) -> list[str] | None:
    """The lower-case words of a chunk without white space; None if only the library can tell."""
    if chunk.isascii():
        low = chunk.lower()
        return [low] if low.isalpha() else WORD.findall(low)
    if PLAIN.fullmatch(chunk):
        return WORD.findall(chunk.lower())
    if not WIDE.fullmatch(chunk):
        return None
    chunk = unicodedata.normalize("NFC", chunk)
    # A sigma at a word's end is no other letter here, as each character is lowered by itself.
    return ANY_WORD.findall("".join(map(str.lower, chunk)) if "Σ" in chunk else chunk.lower())


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.model = self.tok.model
        self.spelled = byte_alphabet()
        self.four = [i.to_bytes(4, "little") for i in range(self.tok.get_vocab_size())]
        self.odd = [*(t.content for t in self.tok.get_added_tokens_decoder().values()), *"\x1c\x1d\x1e\x1f"]
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        text = word if word.isascii() else word.encode().decode("latin-1").translate(self.spelled)
        four = self.four
        found = b"".join([four[t.id] for t in self.model.tokenize(text)])
        if len(self.words) >= MEMO:
            self.words.clear()
        self.words[word] = found
        return found

    def chunk(self, chunk: str) -> bytes:
        found = words_of(chunk)
        if found is None:
            return self.whole(chunk)
        words = self.words
        if len(found) == 1:
            return words.get(found[0]) or self.word(found[0])
        return b"".join([words.get(w) or self.word(w) for w in found])

    def ids(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        if any(s in text for s in self.odd):
            return self.whole(text)
        chunks = text.split()
        memo = self.memo
        parts = list(map(memo.get, chunks))
        if None not in parts:
            return b"".join(parts)
        old, extra = self.old, {}
        for i, known in enumerate(parts):
            if known is None:
                c = chunks[i]
                got = extra.get(c)
                if got is None:
                    got = old.get(c)
                    extra[c] = got = self.chunk(c) if got is None else got
                parts[i] = got
        if len(memo) + len(extra) > MEMO:  # the older half goes; what is still used comes back
            self.old, self.memo = memo, extra
        else:
            memo.update(extra)
        return b"".join(parts)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; kept for all tasks of the process."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
