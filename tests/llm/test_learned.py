"""The learned queries: held-out figures, folds, independence of held-out labels, odd texts and names."""

import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codexlake.llm import language, toxicity
from codexlake.llm.queries import QUERIES

DATA, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
needs_data = pytest.mark.skipif(not Path(DATA).is_dir(), reason="needs the test tables")
ODD = [(None, "nothing"), (7, None), (7, None), (8, ""), (9, " \n\t"), (10, "12 34 ..."), (11, "x"), (11, "x")]
SCHEMA = "doc_id long, text string, lang string, source string, score string, lang_pred int, lang_rejected string"


def crc(doc, modulus):
    return zlib.crc32(str(doc).encode()) % modulus


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "own", 5, "r") for i, t in rows], SCHEMA)


@needs_data
def test_language_on_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op4_language_id"](spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert len(held) > 250 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


@needs_data
def test_toxicity_on_held_out_documents(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = QUERIES["op5_toxicity_ftrl"](spark, LARGER).collect()
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    wins = sum((a > b) + (a == b) / 2 for a in bad for b in good)
    assert len(bad) >= 50 and wins >= 0.95 * len(bad) * len(good)


@needs_data
def test_held_out_labels_change_nothing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string"))
    other = docs.withColumn("lang", F.when(fold % 3 == 1, "zz").otherwise(F.col("lang")))
    a, b = language.fit(docs), language.fit(other)
    assert a.languages == b.languages and (a.table == b.table).all()
    flipped = labels.withColumn("toxic", F.when(fold % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    x, y = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert (x.buckets == y.buckets).all() and (x.weights == y.weights).all() and x.bias == y.bias and len(x.weights) > 0


def test_odd_texts_names_and_empty_tables(spark):
    trained = frame(spark, [(i, ("der hund und die katze " if i % 2 else "the dog and the cat ") * 3) for i in range(40)])
    trained = trained.withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "de").otherwise("en"))
    model = language.fit(trained, fold=None)
    long = "the dog and the cat " * 40_000
    rows = language.identify(frame(spark, [*ODD, (12, long)]), model, into=("a", "b", "c")).collect()
    assert len(rows) == len(ODD) + 1 and all((r.score, r.lang_pred, r.lang_rejected) == ("own", 5, "r") for r in rows)
    by_id = {r.doc_id: (r.a, r.b, r.c) for r in rows}
    assert all(by_id[i] == ("und", 0.0, True) for i in (7, 8, 9, 10)) and by_id[11][0] in ("de", "en") and by_id[12][0] == "en"
    replaced = language.identify(frame(spark, [(1, "the dog")]), model).first()
    assert replaced.lang_pred == "en" and replaced.score > 0.5
    assert language.identify(frame(spark, []), model).count() == 0
    nobody = language.fit(frame(spark, []), fold=None)
    assert [r.lang_pred for r in language.identify(frame(spark, [(1, "the dog")]), nobody).collect()] == ["und"]

    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    bad = frame(spark, [(i, "awful scum here now" if i % 4 == 0 else "kind words here now") for i in range(40)])
    judge = toxicity.fit(bad, labels, fold=None)
    rows = toxicity.score(frame(spark, [*ODD, (12, long + " awful scum"), (13, "awful scum here now")]), judge, into="t").collect()
    assert len(rows) == len(ODD) + 2 and all(r.score == "own" and 0 <= r.t <= 1 for r in rows)
    by_id = {r.doc_id: r.t for r in rows}
    assert by_id[7] == by_id[8] == by_id[9] and by_id[13] > 0.5 > by_id[8]
    assert toxicity.score(frame(spark, []), judge).count() == 0
    none = toxicity.fit(bad, labels.where("toxic = 1"), fold=None)
    assert 0 <= toxicity.score(bad, none).first().score <= 1
    assert toxicity.fit(bad, labels.limit(0)).bias < 0


def test_bounded_samples(spark, monkeypatch):
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(60)], "doc_id long, toxic int")
    docs = frame(spark, [(i, f"awful scum w{i} here" if i % 2 == 0 else f"kind words w{i} here") for i in range(60)])
    monkeypatch.setattr(toxicity, "SAMPLE_FEATURES", 300)  # some twenty texts' worth
    few = toxicity.fit(docs, labels, fold=None)
    assert 0 < len(few.weights)
    got = {r.doc_id: r.score for r in toxicity.score(docs, few, into="score").collect()}
    assert all((got[i] > 0.5) == (i % 2 == 0) for i in got)
