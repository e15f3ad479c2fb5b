"""Substring dedup: words inside a run of ``window`` words that an earlier document also holds are removed.

1. Documents with equal words form a class by a 128-bit hash; all but its least
   document are wholly covered (if long enough) and take no further part. The
   same pass finds the corpus' frequent word k-grams from bounded summaries.
2. Every window of every document chooses an anchor: its least k-gram, frequent
   ones last. Neighbouring windows with one anchor make a segment. Equal
   windows have equal anchors, so anchors held by one document only are set
   aside; the others are found by hash range.
3. Segments of shared anchors are sent once for each content and task, with the
   least document that holds it, to the shard of their anchor. Frequent k-grams
   being last, a passage that many documents share gives few contents.
4. Each shard builds compressed FM-indexes of its contents and streams them
   through them: backward search gives the stretches of ``window`` words or more
   that also occur under a smaller document id.
5. Stretches go back to all documents that hold the content, and the words kept
   are put together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh, string_buffers, text_blocks, tidy
from .fmindex import FMIndex, covered
from .hashing import U, fold, grams, mix, word_hashes, word_spans
from .heavy import Counter, heavy_hashes, is_heavy

#: Words of an anchor; documents from which a k-gram counts as frequent; words that one index holds; words of the
#: corpus for each shard; parts into which a class of documents with equal words is dealt.
ANCHOR, FREQUENT, INDEX_WORDS, SHARD_WORDS, SALTS = 8, 16, 300_000, 3_000_000, 8
_TOP = U(1) << U(63)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def segments(h: np.ndarray, words: np.ndarray, window: int, heavy: np.ndarray):
    """Document, first word, number of words and anchor of every segment of a block of documents."""
    g = grams(h, ANCHOR)
    width = window - ANCHOR + 1
    if len(g) < width:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, U)
    value = g >> U(1)
    if len(heavy):
        value[is_heavy(g, heavy)] |= _TOP
    anchor = sliding_minimum(value, width)  # of the window that begins at each word
    doc = np.repeat(np.arange(len(words) - 1), np.diff(words))
    begin = np.arange(len(anchor))
    whole = begin + window <= words[1:][doc[: len(anchor)]]
    begin = begin[whole]
    anchor, doc = anchor[whole], doc[begin]
    if not len(begin):
        return begin, begin, begin, anchor
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(begin)] - 1
    return doc[first], begin[first] - words[doc[first]], begin[last] - begin[first] + window, anchor[first]


def blocks(texts: pa.Array):
    """Word hashes and word offsets of a column's documents, block by block."""
    data, offsets = string_buffers(texts)
    for a, b in text_blocks(offsets):
        yield a, b, *word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _survey(docs: DataFrame, window: int) -> DataFrame:
    """Rows (doc_id, key, n, c1, c2) for documents and (hash, n) for a task's frequent k-grams."""
    names = ["doc_id", "key", "n", "c1", "c2", "hash"]

    def run(batches):
        counter = Counter()
        for batch in batches:
            n, c1, c2 = [], [], []
            for _, _, h, words in blocks(batch.column(1)):
                g = grams(h, ANCHOR)
                for begin, end in zip(words[:-1].tolist(), words[1:].tolist()):
                    n.append(end - begin)
                    c1.append(fold(h[begin:end], 41))
                    c2.append(fold(h[begin:end], 43))
                    if end - begin >= window:
                        counter.add(np.unique(g[begin : end - ANCHOR + 1]))
            both = [pa.array(np.array(c, U).view(np.int64)) for c in (c1, c2)]
            cols = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), *both, pa.nulls(len(n), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names)
        top = counter.top()
        none = pa.nulls(top.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, top.column(1), none, none, top.column(0)], names)

    return docs.mapInArrow(tidy(run), "doc_id long, key long, n long, c1 long, c2 long, hash long")


def _anchors(docs: DataFrame, window: int, heavy, shards: int) -> DataFrame:
    """(doc_id, anchors): the anchors of each document that one with other words has too, by hash range.

    Of documents with equal words only the least has any.
    """

    def pack(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found_doc, found_anchor, found_words = [], [], []
            for a, _, h, words in blocks(batch.column(1)):
                doc, _, _, anchor = segments(h, words, window, heavy.value)
                equal = np.array([fold(h[i:j], 41) for i, j in zip(words[:-1].tolist(), words[1:].tolist())], U)
                found_doc.append(ids[a + doc])
                found_anchor.append(anchor)
                found_words.append(equal[doc])
            d, x, c = (np.concatenate(f) for f in (found_doc, found_anchor, found_words))
            shard = (mix(x) >> U(33)).astype(np.int64) % shards
            order = np.lexsort((d, c, x, shard))
            shard, d, x, c = shard[order], d[order].astype(np.int64), x[order], c[order]
            once = np.r_[True, (c[1:] != c[:-1]) | (x[1:] != x[:-1])] if len(d) else np.empty(0, bool)
            shard, d, x, c = shard[once], d[once], x[once], c[once]
            used, begin = np.unique(shard, return_index=True)
            cut = [slice(int(i), int(j)) for i, j in zip(begin, np.r_[begin[1:], len(d)])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), *(pa.array([v[i].tobytes() for i in cut], pa.binary()) for v in (x, d, c))],
                ["shard", "x", "d", "c"],
            )

    def match(batches):
        parts = [[], [], []]
        for batch in batches:
            for held, column, kind in zip(parts, batch.columns[1:], (U, np.int64, U)):
                held += [np.frombuffer(v.as_buffer(), kind) for v in column]
        if not parts[0]:
            return
        x, d, c = (np.concatenate(p) for p in parts)
        order = np.lexsort((d, c, x))
        x, d, c = x[order], d[order], c[order]
        least = np.r_[True, (x[1:] != x[:-1]) | (c[1:] != c[:-1])]  # of documents with equal words
        x, d = x[least], d[least]
        begin = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        size = np.diff(np.r_[begin, len(x)])
        keep = np.repeat(size > 1, size)
        x, d = x[keep], d[keep]
        order = np.argsort(d, kind="stable")
        x, d = x[order], d[order]
        ids, begin = np.unique(d, return_index=True)
        ends = np.r_[begin[1:], len(d)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array([x[i:j].tobytes() for i, j in zip(begin, ends)], pa.binary())],
            ["doc_id", "anchors"],
        )

    packed = docs.mapInArrow(tidy(pack), "shard int, x binary, d binary, c binary")
    return packed.repartitionById(shards, F.col("shard")).mapInArrow(tidy(match), "doc_id long, anchors binary")


SEGMENT = "doc_id long, key long, start long, n long, c1 long, c2 long, anchor long, words binary"


def _segments(docs: DataFrame, shared: DataFrame, window: int, heavy) -> DataFrame:
    """Occurrences (no words) of the segments with shared anchors, and each content once for each task."""
    gathered = shared.groupBy("doc_id").agg(F.collect_list("anchors").alias("anchors"))
    rows = docs.join(gathered, "doc_id").select("doc_id", "text", "anchors", "key")
    names = [x.split()[0] for x in SEGMENT.split(", ")]

    def run(batches):
        contents: dict[tuple[int, int], list] = {}
        held = 0

        def flush():
            got = [(v[0], 0, 0, v[1], *key, v[2], v[3]) for key, v in contents.items()]
            cols = list(zip(*got)) or [()] * 8
            kinds = [pa.int64()] * 7 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            ids, row_keys = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            own = [np.sort(np.frombuffer(b"".join(x), U)) for x in batch.column(2).to_pylist()]
            out = [[] for _ in range(7)]
            for a, b in text_blocks(offsets):
                raw = data[offsets[a] : offsets[b]]
                local = offsets[a : b + 1] - offsets[a]
                h, words = word_hashes(raw, local)
                begins, ends, _ = word_spans(raw, local)
                doc, start, n, anchor = segments(h, words, window, heavy.value)
                for i, s, m, x in zip(doc.tolist(), start.tolist(), n.tolist(), anchor):
                    if not is_heavy(np.array([x], U), own[a + i])[0]:
                        continue
                    at = int(words[i]) + s
                    key = tuple(np.array([fold(h[at : at + m], 31), fold(h[at : at + m], 37)], U).view(np.int64).tolist())
                    have = contents.get(key)
                    if have is None:
                        span = raw[begins[at] : ends[at + m - 1]].tobytes()
                        contents[key] = [ids[a + i], m, int(np.array(x).view(np.int64)), span]
                        held += len(span)
                    else:
                        have[0] = min(have[0], ids[a + i])
                    for c, v in zip(out, (ids[a + i], row_keys[a + i], s, m, *key, int(np.array(x).view(np.int64)))):
                        c.append(v)
            cols = [pa.array(c, pa.int64()) for c in out]
            yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(out[0]), pa.binary())], names)
            if held > 24 << 20:
                yield flush()
                contents, held = {}, 0
        yield flush()

    return rows.mapInArrow(tidy(run), SEGMENT)


def _stretches(contents: DataFrame, window: int, shards: int) -> DataFrame:
    """For each content its least document and the stretches that a smaller document holds too."""

    def solve(group: dict):
        """Contents go through indexes of about ``INDEX_WORDS`` words, each of those with smaller documents."""
        items = sorted(group.items(), key=lambda x: x[1][0])
        vocabulary: dict[bytes, int] = {}
        texts = []
        for _, (_, _, span) in items:
            texts.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in span.split()], np.int64))
        _, owners = np.unique(np.array([v[0] for _, v in items], np.int64), return_inverse=True)
        found: list[list] = [[] for _ in items]
        block = np.cumsum([len(t) for t in texts]) // INDEX_WORDS
        for number in np.unique(block).tolist():
            some = np.flatnonzero(block == number)
            index = FMIndex([texts[i] for i in some], owners[some], len(vocabulary) + 1, window)
            later = np.flatnonzero(owners > owners[some[0]])
            for i, own in zip(later.tolist(), covered(index, [texts[i] for i in later], owners[later], window)):
                found[i] += own
        for (key, v), own in zip(items, found):
            yield key[0], key[1], v[0], np.array(own, np.int32).tobytes()

    def emit(groups):
        cols = list(zip(*(row for g in groups for row in solve(g))))
        kinds = [pa.int64()] * 3 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["c1", "c2", "least", "stretches"])

    def run(batches):
        by_anchor: dict[int, dict] = {}
        for batch in batches:
            for doc, c1, c2, anchor, span in zip(*(c.to_pylist() for c in batch.columns)):
                group = by_anchor.setdefault(anchor, {})
                have = group.get((c1, c2))
                if have is None or doc < have[0]:
                    group[c1, c2] = (doc, anchor, span)
        group: dict = {}
        size = 0
        for part in by_anchor.values():
            if len(part) == 1:  # a lone content has no other to share windows with
                (key, v), = part.items()
                yield pa.RecordBatch.from_pylist(
                    [{"c1": key[0], "c2": key[1], "least": v[0], "stretches": b""}],
                    pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("least", pa.int64()), ("stretches", pa.binary())]),
                )
                continue
            group |= part
            size += sum(len(v[2]) for v in part.values()) // 5
            if size >= INDEX_WORDS:
                yield emit([group])
                group, size = {}, 0
        if group:
            yield emit([group])

    cols = contents.select("doc_id", "c1", "c2", "anchor", "words")
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int")
    return cols.repartitionById(shards, shard).mapInArrow(tidy(run), "c1 long, c2 long, least long, stretches binary")


def _cuts(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, key, cuts): the stretches of words to remove from each row of (doc_id, text, key) that loses any.

    The key is a hash of the text, so rows that repeat an id have cuts of their own.
    """
    spark = docs.sparkSession
    named = docs.where("doc_id is not null and text is not null")
    survey = checkpointed(_survey(named, window))
    heavy = heavy_hashes(survey.where("hash is not null").select("hash", "n"), FREQUENT)
    heavy = spark.sparkContext.broadcast(heavy)
    total = survey.where("hash is null").agg(F.sum("n")).collect()[0][0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_WORDS))
    whole = survey.where(f"hash is null and n >= {window}").select("doc_id", "key", "n", "c1", "c2")
    classes = whole.groupBy("c1", "c2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    classes = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = whole.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    copies = salted.join(classes, ["c1", "c2", "salt"]).where("doc_id > least")
    copies = copies.select("doc_id", "key", F.lit(0).cast("long").alias("start"), "n", F.lit(None).cast("binary").alias("stretches"))
    shared = _anchors(named, window, heavy, shards)
    found = checkpointed(_segments(named, shared, window, heavy))
    stretches = _stretches(found.where("words is not null"), window, shards)
    held = found.where("words is null").select("doc_id", "key", "start", "n", "c1", "c2")
    cut = held.join(stretches, ["c1", "c2"]).where("doc_id > least or length(stretches) > 0")
    own = F.when(F.col("doc_id") == F.col("least"), F.col("stretches"))
    cut = cut.select("doc_id", "key", "start", "n", own.alias("stretches")).union(copies)
    cut = cut.select("doc_id", "key", F.struct("start", "n", "stretches").alias("s"))
    return cut.groupBy("doc_id", "key").agg(F.collect_set("s").alias("cuts"))


def _keyed(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = documents[text_column].cast("string")
    return documents.select(documents[id_column].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))


def kept_words(text: str | None, cuts) -> tuple[int, list[bytes]]:
    """Number of words, and the words outside all cuts."""
    words = (text or "").encode().split()
    total = len(words)
    if cuts:
        gone = np.zeros(total + 1, np.int32)
        for s in cuts:
            if s["stretches"] is None:
                spans = [(0, s["n"])]
            else:
                spans = np.frombuffer(s["stretches"], np.int32).reshape(-1, 2).tolist()
            for i, j in spans:
                gone[s["start"] + i] += 1
                gone[s["start"] + j] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
    return total, words


def dedup_substrings(documents: DataFrame, window: int = 50, id_column: str = "doc_id",
                     text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document.

    Words are runs without white space, taken unchanged. A word is removed if it
    lies in a run of ``window`` words that also starts in a document with a
    smaller id, judged on the input. The words kept are joined by one blank.
    Null texts have no words. Rows that repeat an id are one document as far as
    their ids go: none of them is the other's original. A row with a null id
    loses nothing and is no one's original. Other columns are ignored; an empty
    table gives no rows.
    """
    docs = _keyed(documents, id_column, text_column)
    rows = docs.join(_cuts(docs, window), ["doc_id", "key"], "left").select("doc_id", "text", "cuts")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]

    def run(batches):
        for batch in batches:
            ids, texts, cuts = (c.to_pylist() for c in batch.columns)
            out = [[], [], []]
            for text, own in zip(texts, cuts):
                total, words = kept_words(text, own)
                for c, v in zip(out, (total, total - len(words), hashlib.sha256(b" ".join(words)).hexdigest())):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(out, kinds))], names
            )

    return rows.mapInArrow(tidy(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def strip_substrings(documents: DataFrame, window: int = 50, id_column: str = "doc_id",
                     text_column: str = "text") -> DataFrame:
    """The documents with repeated stretches removed from their texts; all columns are kept.

    The rule is that of ``dedup_substrings``. A text that loses nothing stays as
    it is, white space included; another is its kept words joined by one blank. Columns
    of any other name are kept as they are; a null text stays null.
    """
    cuts = _cuts(_keyed(documents, id_column, text_column), window)
    names = documents.columns
    id_, key, own = fresh("id", names), fresh("key", names), fresh("cuts", names)
    cuts = cuts.select(F.col("doc_id").alias(id_), F.col("key").alias(key), F.col("cuts").alias(own))
    same = (documents[id_column].cast("long") == cuts[id_]) & (F.xxhash64(documents[text_column].cast("string")) == cuts[key])
    rows = documents.join(cuts, same, "left").drop(id_, key)
    at = names.index(text_column)

    def run(batches):
        for batch in batches:
            texts, cuts = batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()
            for i, own in enumerate(cuts):
                if own:
                    texts[i] = b" ".join(kept_words(texts[i], own)[1]).decode()
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(tidy(run), documents.schema)
