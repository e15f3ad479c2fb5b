"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are its byte n-grams (A-Z lowered, white space as one blank),
hashed to ``BUCKETS`` rows of an embedding table. The mean of its rows goes
through a linear softmax. Table and softmax are fitted by stochastic gradient
descent in numpy on a bounded sample. A temperature and a rejection threshold
are then calibrated on a part of the sample kept out of the descent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import crc_mod, string_buffers, text_blocks, tidy, unit_hash
from .hashing import _BYTE, LOWER, SPACE, U

BUCKET_BITS = 15
NGRAMS = (2, 3, 4)
DIMENSIONS = 16
#: Most labelled documents of each language, and about how many of all, that the model is fitted on; beyond the first
#: document of each language, those in the order of their ids' hashes until they have so many distinct subwords.
SAMPLE, SAMPLE_ALL, SAMPLE_SUBWORDS = 1_500, 96_000, 40_000_000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_MUL = U(0x9E3779B97F4A7C15)


def subwords(data: np.ndarray, offsets: np.ndarray):
    """For each n-gram length, the buckets of a block's n-grams and their n+1 offsets by document."""
    symbol = np.where(SPACE[data], np.uint8(0x20), LOWER[data])
    values = _BYTE[symbol]
    h = values.copy()
    for n in range(2, max(NGRAMS) + 1):
        if len(h) <= 1:
            h = h[:0]
        else:
            h = h[:-1] * _MUL + values[n - 1 :]
        if n in NGRAMS:
            bucket = ((h ^ (h >> U(29))) * _MUL >> U(64 - BUCKET_BITS)).astype(np.int32)
            yield n, bucket


def _sums(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the table's rows over each document's n-grams, and how many there were."""
    lengths = np.diff(offsets)
    total, count = np.zeros((len(lengths), table.shape[1])), np.zeros(len(lengths), np.int64)
    for n, bucket in subwords(data, offsets):
        own = np.maximum(lengths - n + 1, 0)
        docs = np.flatnonzero(own)
        if not len(docs):
            continue
        begin = offsets[:-1][docs]
        bounds = np.empty(2 * len(docs), np.int64)
        bounds[0::2], bounds[1::2] = begin, np.minimum(begin + own[docs], len(bucket) - 1)
        for j in range(table.shape[1]):
            picked = table[:, j][bucket]
            sums = np.add.reduceat(picked, bounds)[0::2].astype(float)
            last = begin + own[docs] == len(bucket)
            sums[last] = [float(picked[b:].sum()) for b in begin[last]]
            total[docs, j] += sums
        count += own
    return total, count


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket x language: the embeddings already multiplied by the softmax's weights
    bias: np.ndarray
    temperature: float
    threshold: float


def _grams_of(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    data, offsets = string_buffers(texts)
    for i in range(len(offsets) - 1):
        own = [b for _, b in subwords(data[offsets[i] : offsets[i + 1]], offsets[i : i + 2] - offsets[i])]
        bucket, count = np.unique(np.concatenate(own), return_counts=True)
        out.append((bucket.astype(np.uint16), count.astype(np.int32)))
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(grams: list[tuple[np.ndarray, np.ndarray]], labels: list[str], epochs: int = 6, rate: float = 2.0,
          calibrate: float = 0.2, accuracy: float = 0.995, seed: int = 3) -> Model:
    """Fit embeddings and softmax by descent, then the temperature and the threshold on the part kept out."""
    languages = sorted(set(labels))
    k = len(languages)
    rng = np.random.RandomState(seed)
    e = rng.uniform(-1, 1, (1 << BUCKET_BITS, DIMENSIONS)) / DIMENSIONS
    w, bias = np.zeros((DIMENSIONS, k)), np.zeros(k)
    if k < 2:
        return Model(languages, np.zeros((1 << BUCKET_BITS, k), np.float32), bias, 1.0, 0.0)
    number = {x: i for i, x in enumerate(languages)}
    y = np.array([number[x] for x in labels])
    order = rng.permutation(len(y))
    n_cal = int(calibrate * len(y))
    kept, fitted = order[:n_cal], order[n_cal:]
    first = np.unique(y[kept], return_index=True)[1]
    moved = first[~np.isin(y[kept][first], y[fitted])]  # a language is fitted before it is calibrated
    kept, fitted = np.delete(kept, moved), np.concatenate([fitted, kept[moved]])
    n_cal = len(kept)
    steps, step = epochs * len(fitted), 0
    for _ in range(epochs):
        for i in rng.permutation(fitted):
            at, n = grams[i]
            if not len(at):
                continue
            share = n / n.sum()
            rows = e[at]
            mean = share @ rows
            g = _softmax(mean @ w + bias)
            g[y[i]] -= 1
            lr = rate * (1 - step / steps)
            back = w @ g
            w -= lr * 0.5 * np.outer(mean, g)
            bias -= lr * 0.05 * g
            e[at] = rows - lr * np.minimum(share * len(at) / 8, 1.0)[:, None] * back / 8
            step += 1
    logits = np.array([(grams[i][1] / max(1, grams[i][1].sum())) @ (e[grams[i][0]] @ w) + bias for i in kept])
    model = Model(languages, (e @ w).astype(np.float32), bias, 1.0, 0.0)
    if n_cal:
        nll = [-np.log(_softmax(logits / t)[np.arange(n_cal), y[kept]] + 1e-12).mean() for t in _TEMPERATURES]
        model.temperature = float(_TEMPERATURES[int(np.argmin(nll))])
        p = _softmax(logits / model.temperature)
        model.threshold = _threshold(p.max(1), p.argmax(1) == y[kept], accuracy)
    return model


_TEMPERATURES = np.geomspace(0.05, 5, 41)


def _threshold(confidence: np.ndarray, right: np.ndarray, accuracy: float) -> float:
    """The least confidence from which the accepted texts reach the accuracy; at most one half."""
    order = np.argsort(-confidence, kind="stable")
    reached = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= accuracy
    if not reached.any():
        return 0.5
    last = int(np.flatnonzero(reached)[-1])
    return 0.0 if last == len(order) - 1 else min(0.5, float(confidence[order[last]]))


def fit(documents: DataFrame, label: str = "lang", id_column: str = "doc_id", text_column: str = "text",
        fold: int | None = 1, folds: int = 3) -> Model:
    """A model from texts and labels outside the held-out fold (from all, if ``fold`` is None).

    About ``SAMPLE`` documents of each label are used, or fewer of each so that there are about
    ``SAMPLE_ALL``, but one at least, chosen by a hash of the id, until they have ``SAMPLE_SUBWORDS``;
    null ids, texts and labels take no part.
    """
    rows = documents.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(label).cast("string").alias("y")
    ).where("id is not null and y is not null and text is not null")
    if fold is not None:
        rows = rows.where(crc_mod("id", folds) != fold)
    rows = rows.withColumn("at", unit_hash(F.col("id").cast("string"), seed=5))
    counts = rows.groupBy("y").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    labels = counts.count()
    each = max(1, min(SAMPLE, SAMPLE_ALL // max(1, labels)))
    sample = rows.join(F.broadcast(counts), "y").where((F.col("at") < each / F.col("n")) | (F.col("at") == F.col("least")))
    sample = sample.select("text", "y", "at", "id", (F.col("at") == F.col("least")).alias("first")).limit(2 * (each + 1) * labels)

    def run(batches):
        grams, y, total = [], [], 0
        for batch in batches:
            own, first = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for at in range(0, batch.num_rows, 100):  # features of few texts at a time
                for i, g in enumerate(_grams_of(batch.column(0).slice(at, 100)), at):
                    if first[i] or total < SAMPLE_SUBWORDS:
                        total += len(g[0])
                        grams.append(g)
                        y.append(own[i])
        m = train(grams, y)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([m.languages], pa.list_(pa.string())), pa.array([m.table.tobytes()], pa.binary()),
                pa.array([np.asarray(m.bias, float).tolist()], pa.list_(pa.float64())),
                pa.array([float(m.temperature)]), pa.array([float(m.threshold)]),
            ],
            ["languages", "table", "bias", "temperature", "threshold"],
        )

    # One task fits the model, not the driver, and sees the sample's texts batch by batch.
    alone = sample.repartition(1).sortWithinPartitions("at", "id").select("text", "y", "first")
    got = alone.mapInArrow(tidy(run), "languages array<string>, table binary, bias array<double>, temperature double, threshold double").collect()
    if not got:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    m = got[0]
    weights = np.frombuffer(bytes(m.table), np.float32).reshape(1 << BUCKET_BITS, len(m.languages))
    return Model(list(m.languages), weights, np.array(m.bias), m.temperature, m.threshold)


class Predictor:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, texts: pa.Array):
        """Predicted label, confidence and rejection of each text."""
        m = self.model
        data, offsets = string_buffers(texts)
        n = len(offsets) - 1
        label, score, rejected = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
        if m.languages:
            for a, b in text_blocks(offsets):
                total, count = _sums(m.table, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                p = _softmax((total / np.maximum(count, 1)[:, None] + m.bias) / m.temperature)
                best = p.argmax(1)
                for i, text in enumerate(texts[a:b]):
                    text = text.as_py()
                    if text and _LETTER.search(text):
                        label[a + i], score[a + i] = m.languages[best[i]], p[i, best[i]]
                        rejected[a + i] = score[a + i] < m.threshold
        return label, score, rejected


def identify(documents: DataFrame, model: Model, text_column: str = "text",
             into: tuple[str, str, str] = ("lang_pred", "score", "lang_rejected")) -> DataFrame:
    """All columns of ``documents``, the label, its score and whether it is rejected (named by ``into``), without a shuffle.

    A text that is null or has no letter is ``und`` with score 0 and rejected.
    Other texts always get a learned label (``und`` if none was learned); they are rejected if their
    calibrated confidence is below the threshold. Of equally likely labels the first by name is
    taken. Whole texts count, however long; repeated rows are answered each; an empty table
    gives no rows. Existing columns named in ``into`` are replaced.
    """
    documents = documents.drop(*into)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_column)
    added = zip(into, (StringType(), DoubleType(), BooleanType()))
    schema = StructType([*documents.schema.fields, *(StructField(name, kind, False) for name, kind in added)])

    def run(batches):
        predictor = Predictor(sent.value)
        for batch in batches:
            label, score, rejected = predictor(batch.column(at))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(label, pa.string()), pa.array(score), pa.array(rejected)],
                [*batch.schema.names, *into],
            )

    return documents.mapInArrow(tidy(run), schema)
