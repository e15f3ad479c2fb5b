"""Token counts without tokenizing: a BPE vocabulary compiled to a deterministic transducer.

Greedy-merge BPE can be read from left to right: the last token of a prefix is
the one token that ends there and is compatible with the last token where it
begins (two tokens are compatible if merging their joined symbols gives just
the two back). So a state needs the last tokens at the few positions from which
a token may still grow, and each transition carries the change of the number of
tokens. States and transitions are made when a text first asks for them and are
then table lookups; all new words of a batch step through the tables together.

A text is cut into chunks. A chunk's map, from what is open before it to what
is open after it, is (text before its first blank, tokens of whole words, text
after its last blank); maps compose associatively, and a parallel prefix scan
of them gives the count up to the end of each chunk.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy
from .tokens import MEMO, byte_alphabet, encoder, words_of

#: Characters of a chunk; states after which the tables are begun anew.
CHUNK, MOST_STATES = 1 << 16, 200_000
_START = -1
_END = "</w>"
#: Added to the changes of a table in which -1 stands for one that is not yet known; a change is less than the longest token.
_SHIFT = 64


class Transducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {tuple(p): i for i, p in enumerate(pairs)}
        self.names = {i: t for t, i in self.vocab.items()}
        self.spelled = byte_alphabet()
        self.grows: set[str] = set()
        for t in self.vocab:
            t = t.removesuffix(_END)
            self.grows.update(t[:n] for n in range(1, len(t)))
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.column = np.full(256, -1, np.int64)
        self.columns = 0
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.next = np.empty((0, 0), np.int32)
        self.emits = np.empty((0, 0), np.int8)
        self.ends = np.empty((0, 0), np.int8)
        self.state(("", ((_START, 0),)))
        if len(self.fits) > 1_000_000:
            self.fits.clear()

    def state(self, key: tuple) -> int:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.keys)
            self.keys.append(key)
            self._room(found + 1, self.columns)
        return found

    def _room(self, states: int, columns: int) -> None:
        have = self.next.shape
        if states > have[0] or columns > have[1]:
            rows, wide = have
            if states > rows:
                rows = -(-(states + states // 4) // 1024) * 1024
            if columns > wide:
                wide = -(-columns // 8) * 8
            shape = rows, wide
            for name, empty in (("next", -1), ("emits", 0), ("ends", -1)):
                old = getattr(self, name)
                new = np.full(shape, empty, old.dtype)
                new[: have[0], : have[1]] = old
                setattr(self, name, new)

    def merge(self, symbols: list[str]) -> list[str]:
        """The symbols after all merges, lowest rank and leftmost first."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 60:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        found = self.fits.get(key)
        if found is None:
            name = self.names[right]
            body = name.removesuffix(_END)
            parts = [*body[:-1], body[-1] + _END] if body != name else list(body)
            expected = [name] if left == _START else [self.names[left], name]
            if left != _START:
                parts = [*self.names[left], *parts]
            found = self.fits[key] = self.merge(parts) == expected
        return found

    def _last(self, key: tuple, symbol: str, final: bool) -> tuple[int, int, str]:
        """Last token after one more symbol, the change of the count, and the text it was found in."""
        suffix, history = key
        text = suffix + symbol
        for n in range(len(text), 0, -1):
            begin = history[n - 1]
            if begin is None:
                continue
            token = self.vocab.get(text[-n:] + _END if final else text[-n:])
            if token is not None and self.compatible(begin[0], token):
                return token, 1 - begin[1], text
        raise ValueError(f"no token ends {text!r}")

    def compile(self, state: int, byte: int, final: bool) -> None:
        key, symbol = self.keys[state], self.spelled[byte]
        token, change, text = self._last(key, symbol, final)
        column = self.column[byte]
        if final:
            self.ends[state, column] = change + _SHIFT
            return
        history = [(token, 0), *(h and (h[0], h[1] + change) for h in key[1])]
        suffix = text
        while suffix and suffix not in self.grows:
            suffix = suffix[1:]
        kept = tuple(
            history[n] if n == 0 or suffix[len(suffix) - n :] in self.grows else None for n in range(len(suffix) + 1)
        )
        self.next[state, column] = self.state((suffix, kept))
        self.emits[state, column] = change

    def count(self, words: list[bytes]) -> np.ndarray:
        """Number of tokens of each non-empty word."""
        if len(self.keys) > MOST_STATES:
            self.reset()
        length = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        new = [b for b in np.unique(data).tolist() if self.column[b] < 0]
        for b in new:
            self.column[b] = self.columns
            self.columns += 1
        self._room(len(self.keys), self.columns)
        offset = np.r_[0, np.cumsum(length)][:-1]
        order = np.argsort(-length, kind="stable")
        length, offset = length[order], offset[order]
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for at in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length, -at, "left"))
            byte = data[offset[:live] + at]
            column = self.column[byte]
            more = int(np.searchsorted(-length, -(at + 1), "left"))  # these go on after this byte
            for final, part in ((False, slice(0, more)), (True, slice(more, live))):
                table = self.ends if final else self.next
                missing = np.flatnonzero(table[state[part], column[part]] < 0)
                if len(missing):
                    lacks = np.unique(state[part][missing] * 256 + byte[part][missing])
                    for x in lacks.tolist():
                        self.compile(x >> 8, x & 255, final)
            total[:more] += self.emits[state[:more], column[:more]]
            total[more:live] += self.ends[state[more:live], column[more:live]].astype(np.int64) - _SHIFT
            state[:more] = self.next[state[:more], column[:more]]
        out = np.empty(len(words), np.int64)
        out[order] = total
        return out


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does to a count: ``tail`` is None while no blank has been met."""

    head: str
    count: int
    tail: str | None


class TokenCounter:
    def __init__(self, path: str):
        self.machine = Transducer(path)
        self.library = encoder(path)
        self.memo: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def learn(self, chunks: set[str]) -> dict[str, int]:
        """Counts of space-separated chunks, new ones by the transducer, all together."""
        found, parts, odd = {}, {}, []
        words: dict[str, int] = {}
        for c in chunks:
            got = self.old.get(c)
            if got is not None:
                found[c] = got
                continue
            own = words_of(c)
            if own is None:
                odd.append(c)
            else:
                parts[c] = [words.setdefault(w, len(words)) for w in own]
        if words:
            counts = self.machine.count([w.encode() for w in words]).tolist()
            for c, at in parts.items():
                found[c] = sum([counts[i] for i in at])
        for c in odd:
            found[c] = len(self.library.whole(c)) // 4
        return found

    def know(self, texts: list[list[str]]) -> None:
        memo = self.memo
        new = {c for chunks in texts for c in chunks if c not in memo}
        if new:
            found = self.learn(new)
            if len(memo) + len(found) > MEMO:
                known = {c for chunks in texts for c in chunks}
                self.old = memo
                self.memo = found | {c: memo[c] for c in known if c in memo}
            else:
                memo.update(found)

    def fragment(self, text: str) -> int:
        if not text:
            return 0
        if len(text) > CHUNK:  # too long to be remembered
            return self.learn({text})[text]
        self.know([[text]])
        return self.memo[text]

    def chunk_map(self, chunk: str) -> ChunkMap:
        words = chunk.split()
        if not chunk or (len(words) == 1 and len(words[0]) == len(chunk)):
            return ChunkMap(chunk, 0, None)
        head = "" if chunk[0].isspace() else words.pop(0)
        tail = "" if chunk[-1].isspace() or not words else words.pop()
        self.know([words])
        return ChunkMap(head, sum(map(self.memo.__getitem__, words)), tail)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.tail is None:
            return ChunkMap(a.head + b.head, b.count, b.tail)
        if b.tail is None:
            return ChunkMap(a.head, a.count, a.tail + b.head)
        return ChunkMap(a.head, a.count + self.fragment(a.tail + b.head) + b.count, b.tail)

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """Inclusive prefix compositions, in a logarithmic number of parallel steps."""
        step = 1
        while step < len(maps):
            maps = [*maps[:step], *(self.compose(maps[i - step], maps[i]) for i in range(step, len(maps)))]
            step *= 2
        return maps

    def whole(self, text: str, size: int = CHUNK) -> int:
        """The number of tokens of a text, its chunks' maps composed pair by pair."""
        maps = [self.chunk_map(text[i : i + size]) for i in range(0, len(text), size)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return sum(self.fragment(m.head) + m.count + self.fragment(m.tail or "") for m in maps)

    def running(self, text: str, size: int = CHUNK) -> list[int]:
        """The number of tokens up to the end of each chunk of ``size`` characters."""
        maps = self.scan([self.chunk_map(text[i : i + size]) for i in range(0, len(text), size)])
        return [self.fragment(m.head) + m.count + self.fragment(m.tail or "") for m in maps]

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        plain: list[tuple[int, list[str]]] = []
        for i, text in enumerate(texts):
            if any(s in text for s in self.library.odd):
                out[i] = len(self.library.whole(text)) // 4
            elif len(text) > CHUNK:
                out[i] = self.whole(text)
            else:
                plain.append((i, text.split()))
        for at in range(0, len(plain), 500):
            part = plain[at : at + 500]
            self.know([chunks for _, chunks in part])
            get = self.memo.__getitem__
            for i, chunks in part:
                out[i] = sum(map(get, chunks))
        return out


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_tokens(documents: DataFrame, vocabulary: str, limit: int = 2048, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document's whole text, without a shuffle.

    The count is the library's for the vocabulary file, without added special
    tokens, truncation or padding. A null text counts as empty (0 tokens);
    repeated rows are counted each; null ids stay null; other columns are ignored.
    """
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]

    def run(batches):
        count = counter(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = np.array(count.counts(texts), np.int64)
            size = pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], names)

    columns = documents.select(documents[id_column].cast("long"), documents[text_column].cast("string"))
    return columns.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
