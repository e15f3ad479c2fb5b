"""SentencePiece encoding and decoding by forward passes shared over common prefixes.

A text is normalised by its model and cut into marked words (a run of marks and
what follows it); no piece of the model has a mark behind another character, so
words are encoded by themselves. The distinct new words of a batch are sorted,
which is a depth-first walk of their trie: going from one word to the next keeps
the forward states of the common prefix and computes only the rest.

Two kinds of model are served. For a unigram model the forward state is the best
score of the prefix (Viterbi). A BPE model has no such score; there the state is
the last piece of the prefix's encoding, which is the one piece that ends there
and stays apart from the last piece of the prefix before it when both are merged
together. So a BPE model (``kind="bpe"``, as that of the registered query) takes
the walk without scores. An automaton over the pieces gives those that end at a
prefix. Words with several marks in a row, where merges tie, are merged directly.
Characters without a piece fall back to their bytes.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import tidy

MARK = "▁"
#: Words that a memo holds, and characters of the longest one; pairs of pieces whose fit is remembered; bytes of text worked on at a time.
MEMO, LONGEST, PAIRS, BLOCK = 250_000, 64, 1_000_000, 2 << 20
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Forward:
    """Encodings of sorted words over a table of pieces and scores."""

    def __init__(self, pieces: dict[str, int], scores: list[float], kind: str = "bpe"):
        self.pieces, self.kind, self.scores = pieces, kind, scores
        self.names = {i: p for p, i in pieces.items()}
        self.unknown = min((scores[i] for i in self.names), default=0.0) - 10
        self.apart: dict[int, bool] = {}
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.start = len(scores)  # stands for the piece before a word's first, or for a character without a piece
        self._automaton()

    def _automaton(self) -> None:
        """An automaton that gives, for each prefix of a word, the pieces that end there, longest first."""
        self.go: dict[int, int] = {}
        tails: list[list[int]] = [[]]
        for piece, code in self.pieces.items():
            node = 0
            for c in piece:
                node = self.go.setdefault(node << 21 | ord(c), len(tails))
                if node == len(tails):
                    tails.append([])
            tails[node].append(code)
        self.fail = array("i", [0] * len(tails))
        ends: list[tuple] = [()] * len(tails)
        for key, node in self.go.items():  # a node's key is older than its children's, but its suffix may be younger
            ends[node] = key
        order = sorted(range(1, len(tails)), key=self._depths(ends).__getitem__)
        self.ending: list[tuple] = [()] * len(tails)
        for node in order:
            parent, c = ends[node] >> 21, ends[node] & 0x1FFFFF
            if parent:
                self.fail[node] = self.step(self.fail[parent], c)
            own = tuple((len(self.names[code]), code) for code in tails[node])
            self.ending[node] = own + self.ending[self.fail[node]]
        self.jump: dict[int, int] = {}

    @staticmethod
    def _depths(ends: list) -> list[int]:
        depth = [0] * len(ends)
        for node in range(1, len(ends)):  # parents come first
            depth[node] = depth[ends[node] >> 21] + 1
        return depth

    def step(self, node: int, c: int) -> int:
        """The node of the longest prefix of a piece that ends with the next character."""
        while True:
            found = self.go.get(node << 21 | c)
            if found is not None:
                return found
            if not node:
                return 0
            node = self.fail[node]

    def merge(self, word: str) -> list[str]:
        """The word's pieces after all merges, best score and then leftmost first."""
        return self._merged(list(word))[0]

    def _merged(self, parts: list[str]) -> tuple[list[str], tuple[str, str] | None]:
        """The pieces after all merges, and the last pair that was merged."""
        pair = None
        while len(parts) > 1:
            best, at = -np.inf, 0
            for i in range(len(parts) - 1):
                code = self.pieces.get(parts[i] + parts[i + 1])
                if code is not None and self.scores[code] > best:
                    best, at = self.scores[code], i
            if best == -np.inf:
                break
            pair = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, pair

    def split(self, code: int) -> tuple[int, int] | None:
        """The two pieces that a piece is merged from, itself twice for a character, None if it never comes about."""
        if code not in self.splits:
            name = self.names[code]
            parts, pair = self._merged(list(name))
            self.splits[code] = (code, code) if len(name) == 1 else None
            if len(name) > 1 and parts == [name]:
                self.splits[code] = self.pieces.get(pair[0], -1), self.pieces.get(pair[1], -1)
        return self.splits[code]

    def _rank(self, code: int) -> float:
        """Pieces in the order of their merges; characters come first."""
        return -self.scores[code] if len(self.names[code]) > 1 else -np.inf

    def fits(self, left: int, right: int) -> bool:
        """Whether two pieces stay apart when their characters are merged together.

        Undo the later of the two pieces' last merges again and again: what faces each other at the cut must
        not have been merged before that.
        """
        if len(self.apart) > PAIRS:
            self.apart.clear()
        self.apart[left * (self.start + 1) + right] = found = self._fits(left, right)
        return found

    def _fits(self, left: int, right: int) -> bool:
        if self.split(right) is None:
            return False
        if left == self.start:
            return True
        if self.split(left) is None:
            return False
        limit = (np.inf, True)  # merges of a rank below it, or of the same rank where the flag says so, come first
        while True:
            joined = self.pieces.get(self.names[left] + self.names[right])
            if joined is not None and len(self.names[joined]) > 1:
                rank = -self.scores[joined]
                if rank < limit[0] or (rank == limit[0] and limit[1]):
                    return False
            a, b = self._rank(left), self._rank(right)
            if a == b == -np.inf:
                return True
            if a > b:  # the left piece's last merge is left of the cut: of equal ranks it came first
                limit, left = (a, False), self.split(left)[1]
            else:
                limit, right = (b, True), self.split(right)[0]

    def paths(self, words: list[str]):
        """(word, ends of its pieces, their codes), last piece first; a character without a piece has the code ``start``.

        Sorted words are a depth-first walk of their trie, in which the states of common prefixes are shared. The state
        of a prefix is the begin of its last piece and that piece, and for a unigram model its best score.
        """
        begins, lasts, values, nodes = [0], [self.start], [0.0], [0]
        jump, ending, apart, many = self.jump, self.ending, self.apart, self.start + 1
        unigram, scores = self.kind == "unigram", self.scores
        previous = ""
        for word in sorted(words):
            if not unigram and word[:2] == MARK * 2:
                parts = self.merge(word)
                yield word, np.cumsum([len(p) for p in parts])[::-1].tolist(), [self.pieces.get(p, self.start) for p in parts[::-1]]
                continue
            shared, most = 0, min(len(word), len(previous))
            while shared < most and word[shared] == previous[shared]:
                shared += 1
            del begins[shared + 1 :], lasts[shared + 1 :], nodes[shared + 1 :]
            node = nodes[shared]
            if unigram:
                del values[shared + 1 :]
            if len(jump) > PAIRS:
                jump.clear()
            end = shared
            for c in map(ord, word[shared:]):
                end += 1
                key = node << 21 | c
                node = jump.get(key)
                if node is None:
                    node = jump[key] = self.step(key >> 21, key & 0x1FFFFF)
                at, piece = end - 1, self.start
                if unigram:
                    value = values[at] + self.unknown
                    for length, code in ending[node]:
                        if values[end - length] + scores[code] > value:
                            at, piece, value = end - length, code, values[end - length] + scores[code]
                    values.append(value)
                else:
                    for length, code in ending[node]:
                        left = lasts[end - length]
                        fit = apart.get(left * many + code)
                        if fit or (fit is None and self.fits(left, code)):
                            at, piece = end - length, code
                            break
                begins.append(at)
                lasts.append(piece)
                nodes.append(node)
            previous = word
            ends, codes, end = [], [], len(word)
            while end:
                ends.append(end)
                codes.append(lasts[end])
                end = begins[end]
            yield word, ends, codes

    def encode(self, words: list[str]) -> dict[str, list[str]]:
        """The pieces of each word."""
        out = {}
        for word, ends, _ in self.paths(words):
            cuts = [0, *ends[::-1]]
            out[word] = [word[a:b] for a, b in zip(cuts, cuts[1:])]
        return out


class Encoder:
    def __init__(self, path: str, kind: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.sp.get_piece_size())
        self.names = [self.sp.id_to_piece(i) for i in ids]
        usual = {
            p: i for i, p in enumerate(self.names)
            if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))
        }
        self.bytes = {int(m[1], 16): i for i, p in enumerate(self.names) if self.sp.is_byte(i) and (m := _BYTE.fullmatch(p))}
        self.unk = self.sp.unk_id()
        self.forward = Forward(usual, [self.sp.get_score(i) for i in ids], kind)
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        spelled = [self.names[i].replace(MARK, " ").encode() if self.names[i] in usual else b"" for i in ids]
        for byte, i in self.bytes.items():
            spelled[i] = bytes([byte])
        spelled[self.unk] = " ⁇ ".encode()
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.length = np.array([len(x) for x in spelled], np.int64)
        self.begin = np.cumsum(self.length) - self.length

    def _ids(self, word: str, ends: list[int], codes: list[int]) -> bytes:
        start = self.forward.start
        if start not in codes:
            codes.reverse()
            return array("i", codes).tobytes()
        out = array("i")
        for end, code in zip(ends[::-1], codes[::-1]):
            if code != start:
                out.append(code)
            elif len(self.bytes) == 256:
                out.extend([self.bytes[b] for b in word[end - 1].encode()])
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return out.tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids of each text as little-endian 32-bit numbers; null stays null."""
        out: list[bytes | None] = []
        part, size = [], 0
        for text in texts:
            part.append(text)
            size += len(text or "")
            if size >= BLOCK:
                out += self._encode_part(part)
                part, size = [], 0
        return out + self._encode_part(part)

    def _encode_part(self, texts: list[str | None]) -> list[bytes | None]:
        part = [None if t is None else _WORD.findall(self.sp.normalize(t)) for t in texts]
        memo, found, new = self.memo, {}, set()
        for words in part:
            if words:
                new.update(words)
        new = [w for w in new if w not in memo]
        unseen = []
        for w in new:
            got = self.old.get(w)
            if got is None:
                unseen.append(w)
            else:
                found[w] = got
        for w, ends, codes in self.forward.paths(unseen):
            found[w] = self._ids(w, ends, codes)
        out: list[bytes | None] = []
        for words in part:
            if words is None:
                out.append(None)
            else:
                out.append(b"".join([found[w] if w in found else memo[w] for w in words]))
        found = {w: ids for w, ids in found.items() if len(w) <= LONGEST}
        if len(memo) + len(found) > MEMO:  # the older half goes; what is still used comes back
            self.old, self.memo = memo, found
        else:
            memo.update(found)
        return out

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each sequence of ids (``offsets`` has n+1): pieces and bytes put together, marks as blanks, the first one left out."""
        ids = np.where((ids >= 0) & (ids < len(self.length)), ids, len(self.length))
        length, begin = np.append(self.length, 0)[ids], np.append(self.begin, 0)[ids]
        ends = np.r_[0, np.cumsum(length)]
        raw = self.spelled[np.repeat(begin - ends[:-1], length) + np.arange(ends[-1])].tobytes()
        cuts = ends[offsets].tolist()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
        return [t[1:] if t[:1] == " " else t for t in texts]


_loaded: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str = "bpe") -> Encoder:
    if (path, kind) not in _loaded:
        _loaded[path, kind] = Encoder(path, kind)
    return _loaded[path, kind]


def encode(documents: DataFrame, model: str, kind: str = "bpe", text_column: str = "text", into: str = "ids",
           decoded: str | None = None) -> DataFrame:
    """All columns and the ids of each whole text (array of int; null for a null text), without a shuffle.

    ``kind`` says how the model segments: "unigram" carries Viterbi scores forward, "bpe" (whose result is no
    best score) the last piece. Columns called ``into``, ``into``_crc32 (over the ids as little-endian unsigned 32-bit
    numbers) or ``into``_n are replaced, all others kept. With ``decoded`` the ids are decoded again in the same pass,
    into a column of that name. An empty text has no ids; repeated rows are encoded each; an empty table gives no rows.
    """
    added = [StructField(into, ArrayType(IntegerType(), False)), StructField(f"{into}_n", LongType()), StructField(f"{into}_crc32", LongType())]
    if decoded:
        added.append(StructField(decoded, StringType()))
    documents = documents.drop(*(f.name for f in added))
    at, names = documents.columns.index(text_column), documents.columns

    def run(batches):
        enc = encoder(model, kind)
        for whole in batches:
            for batch in slices(whole, whole.column(at)):
                raw = enc.encode_all(batch.column(at).to_pylist())
                null = np.array([r is None for r in raw], bool)
                n = np.array([len(r or b"") // 4 for r in raw], np.int64)
                offsets = np.r_[0, np.cumsum(n)]
                flat = b"".join(r for r in raw if r)
                values = pa.Array.from_buffers(pa.int32(), len(flat) // 4, [None, pa.py_buffer(flat)])
                crc = pa.array([None if r is None else zlib.crc32(r) for r in raw], pa.int64())
                columns = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values, mask=pa.array(null)), pa.array(n, mask=null), crc]
                if decoded:
                    columns.append(pa.array(enc.decode_all(np.frombuffer(flat, "<i4"), offsets), pa.string(), mask=null))
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, *(f.name for f in added)])

    return documents.mapInArrow(tidy(run), StructType([*documents.schema.fields, *added]))


def decode(rows: DataFrame, model: str, kind: str = "bpe", ids_column: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns and the text of each sequence of ids (null for null); unknown and null ids give nothing.

    An existing column called ``into`` is replaced; an empty table gives no rows.
    """
    rows = rows.drop(into)
    at, names = rows.columns.index(ids_column), rows.columns

    def run(batches):
        enc = encoder(model, kind)
        for whole in batches:
            for batch in slices(whole, whole.column(at)):
                column = batch.column(at).cast(pa.large_list(pa.int64()))
                ids = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                n = pa.compute.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False)
                texts = pa.array(enc.decode_all(ids, np.r_[0, np.cumsum(n)].astype(np.int64)), pa.string())
                texts = pa.compute.if_else(column.is_valid(), texts, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*names, into])

    return rows.mapInArrow(tidy(run), StructType([*rows.schema.fields, StructField(into, StringType())]))


def slices(batch: pa.RecordBatch, column: pa.Array):
    """Parts of a batch of about ``BLOCK`` bytes of text or ids each (one row at least)."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        size = pa.compute.binary_length(column)
    else:
        size = pa.compute.list_value_length(column)
    ends = np.cumsum(pa.compute.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + BLOCK, "right")))
        yield batch.slice(at, end - at)
        at = end
