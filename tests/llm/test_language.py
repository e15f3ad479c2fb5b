"""More labels than the sample has room for by its share of each."""

import random

from codexlake.llm import language


def test_every_label_is_learned(spark, monkeypatch):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:02}": ["".join(rng.choices(letters, k=6)) for _ in range(4)] for k in range(80)}
    rows = [(i, " ".join(rng.choices(words[y], k=30)), y) for i, y in enumerate(y for y in words for _ in range(30))]
    docs = spark.createDataFrame([*rows, (-1, "qqq zzz qqq zzz", "rare")], "doc_id long, text string, lang string")
    model = language.fit(docs, fold=None)
    assert model.languages == [*sorted(words), "rare"]
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()}
    assert sum(got[i] == y for i, _, y in rows) >= 0.95 * len(rows)
    monkeypatch.setattr(language, "SAMPLE_ALL", 81)
    assert language.fit(docs, fold=None).languages == model.languages
