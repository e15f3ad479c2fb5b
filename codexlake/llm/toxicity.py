"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of ASCII letters, digits and non-ASCII bytes, with A-Z lowered.
Features of a text are the set of its words, their stems (words cut to a few
bytes), word pairs and pairs that skip one word, hashed to ``2**FEATURE_BITS`` buckets. One task trains on a bounded
sample of labelled documents; per-coordinate rates and the L1 term leave a few
thousand non-zero weights, which is what is broadcast (the sample's bound is theirs too).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import crc_mod, string_buffers, text_blocks, tidy, unit_hash
from .hashing import LOWER, PUNCT, U, mix, span_hashes, word_spans

#: Buckets of the hashing trick.
FEATURE_BITS = 24
#: About the most labelled rows of each class that the model is fitted on, and, in the order of their ids' hashes,
#: the distinct features of a row's text that they may have in all.
SAMPLE_POSITIVE, SAMPLE_NEGATIVE, SAMPLE_FEATURES = 2_500, 5_000, 40_000_000

#: Lengths in bytes to which longer words are also cut, so that inflected forms share a feature.
STEMS = (4, 5, 6)

_PAIR, _SKIP, _STEM = U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x27D4EB2F165667C5)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every word, pair and skip-pair of a block of texts."""
    data = LOWER[data]
    starts, ends, words = word_spans(data, offsets, PUNCT)
    h = span_hashes(data, starts, ends)
    doc = np.repeat(np.arange(len(words) - 1, dtype=np.int32), np.diff(words))
    found, docs = [mix(h)], [doc]
    for n in STEMS:
        longer = np.flatnonzero(ends - starts > n)
        found.append(mix(span_hashes(data, starts[longer], starts[longer] + n) ^ _STEM))
        docs.append(doc[longer])
    for gap, salt in ((1, _PAIR), (2, _SKIP)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            found.append(mix(h[:-gap] * salt + h[gap:])[same])
            docs.append(doc[gap:][same])
    return (np.concatenate(found) >> U(64 - FEATURE_BITS)).astype(np.int32), np.concatenate(docs)


def feature_sets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct buckets of each text."""
    data, offsets = string_buffers(texts)
    out = []
    for a, b in text_blocks(offsets):
        f, d = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        key = np.unique(d.astype(np.int64) << FEATURE_BITS | f)
        cut = np.searchsorted(key, np.arange(b - a + 1, dtype=np.int64) << FEATURE_BITS)
        bucket = (key & ((1 << FEATURE_BITS) - 1)).astype(np.int32)
        out += [bucket[cut[i] : cut[i + 1]].copy() for i in range(b - a)]
    return out


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def train(sets: list[np.ndarray], labels: np.ndarray, prior: float, alpha: float = 0.6, beta: float = 1.0,
          l1: float = 4.0, l2: float = 1.0, epochs: int = 4, least: int = 3, seed: int = 7) -> Model:
    """Follow-the-regularised-leader with proximal L1 and L2 terms, one coordinate's rate for each feature.

    ``prior`` is the positives' share among all labelled rows; the sample's own
    share differs, and the bias is shifted by the difference of the log odds.
    Features seen in fewer than ``least`` documents are left out.
    """
    if not len(sets) or labels.min() == labels.max():
        p = min(max(prior, 1e-4), 1 - 1e-4)
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(p / (1 - p))))
    bounds = np.r_[0, np.cumsum([len(s) for s in sets])]
    flat = np.concatenate(sets)
    sets.clear()  # one array is given back as a whole, many small ones are not
    count = np.zeros(1 << FEATURE_BITS, np.uint16)  # samples are smaller than its range
    for a, b in zip(bounds, bounds[1:]):
        count[flat[a:b]] += 1
    seen = np.flatnonzero(count >= least)
    end, ends = 0, [0]
    for a, b in zip(bounds, bounds[1:]):  # in place: what stays is never longer
        own = flat[a:b]
        own = np.searchsorted(seen, own[count[own] >= least])
        flat[end : end + len(own)] = own
        end += len(own)
        ends.append(end)
    bounds = ends
    del count
    z, n = np.zeros(len(seen)), np.zeros(len(seen))
    zb = nb = 0.0
    rng = np.random.RandomState(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            at = flat[bounds[i] : bounds[i + 1]]
            zi, root = z[at], np.sqrt(n[at])
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2))
            bias = -zb / ((beta + np.sqrt(nb)) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30))) - labels[i]
            z[at] += g - (np.sqrt(n[at] + g * g) - root) / alpha * w
            n[at] += g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * bias
            nb += g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    bias = -zb / ((beta + np.sqrt(nb)) / alpha)
    share = labels.mean()
    p = min(max(prior, 1e-4), 1 - 1e-4)
    bias += np.log(p / (1 - p)) - np.log(share / (1 - share))
    keep = np.flatnonzero(w)
    return Model(seen[keep].astype(np.int64), w[keep], float(bias))


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", id_column: str = "doc_id",
        text_column: str = "text", fold: int | None = 2, folds: int = 4) -> Model:
    """A model from the labelled documents outside the held-out fold (all labelled ones if ``fold`` is None).

    Null labels and ids take no part; a document labelled more than once counts
    as positive if any row says so. About ``SAMPLE_POSITIVE`` and ``SAMPLE_NEGATIVE``
    rows are used, chosen by a hash of the id, until they have ``SAMPLE_FEATURES``. Without
    labels of both kinds every text gets the share of positives (a tenth, if there are none).
    """
    rows = labels.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("int").alias("y"))
    rows = rows.where("id is not null and y is not null")
    if fold is not None:
        rows = rows.where(crc_mod("id", folds) != fold)
    rows = rows.groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return train([], np.empty(0), 0.1)
    share = {y: min(1.0, most / max(1, counts.get(y, 0))) for y, most in ((1, SAMPLE_POSITIVE), (0, SAMPLE_NEGATIVE))}
    at = unit_hash(F.col("id"), seed=11).alias("at")
    rows = rows.select("id", "y", at).where(F.col("at") < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))
    rows = rows.limit(2 * (SAMPLE_POSITIVE + SAMPLE_NEGATIVE))
    sample = (
        documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
        .where("text is not null").join(F.broadcast(rows), "id")
    )
    prior = counts.get(1, 0) / total

    def run(batches):
        sets, y, size = [], [], 0
        for batch in batches:
            own = batch.column(1).to_pylist()
            for at in range(0, batch.num_rows, 100):  # features of few texts at a time
                for i, features in enumerate(feature_sets(batch.column(0).slice(at, 100)), at):
                    if size < SAMPLE_FEATURES:
                        size += len(features)
                        sets.append(features)
                        y.append(own[i])
        m = train(sets, np.array(y, float), prior)
        yield pa.RecordBatch.from_arrays(
            [pa.array([m.buckets.tobytes()], pa.binary()), pa.array([m.weights.tobytes()], pa.binary()), pa.array([float(m.bias)])],
            ["buckets", "weights", "bias"],
        )

    # One task trains the model, not the driver, and sees the sample's texts batch by batch.
    alone = sample.repartition(1).sortWithinPartitions("at", "id", "text").select("text", "y")
    got = alone.mapInArrow(tidy(run), "buckets binary, weights binary, bias double").collect()
    if not got:
        return train([], np.empty(0), prior)
    return Model(np.frombuffer(bytes(got[0].buckets), np.int64), np.frombuffer(bytes(got[0].weights), float), got[0].bias)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        bits = np.zeros(1 << FEATURE_BITS, bool)
        bits[model.buckets] = True
        self.bits = np.packbits(bits, bitorder="little")

    def __call__(self, texts: pa.Array) -> np.ndarray:
        data, offsets = string_buffers(texts)
        out = np.full(len(offsets) - 1, self.model.bias)
        for a, b in text_blocks(offsets):
            f, d = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            hit = np.flatnonzero(self.bits[f >> 3] >> (f & 7).astype(np.uint8) & 1)
            key = np.unique(d[hit].astype(np.int64) << FEATURE_BITS | f[hit])
            w = self.model.weights[np.searchsorted(self.model.buckets, key & ((1 << FEATURE_BITS) - 1))]
            out[a:b] += np.bincount(key >> FEATURE_BITS, w, b - a)
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def score(documents: DataFrame, model: Model, text_column: str = "text", into: str = "score") -> DataFrame:
    """All columns of ``documents`` and the score (0 to 1) of each whole text, without a shuffle.

    A null or empty text gets the model's bias as its score. Repeated rows are
    scored alike; an existing column called ``into`` is replaced.
    """
    if into in documents.columns:
        documents = documents.drop(into)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_column)
    schema = StructType([*documents.schema.fields, StructField(into, DoubleType(), False)])

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            column = batch.column(at)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scorer(column))], [*batch.schema.names, into]
            )

    return documents.mapInArrow(tidy(run), schema)
