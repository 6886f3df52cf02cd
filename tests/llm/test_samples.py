"""Samples of a bounded size: by all bits of a hash, and by bytes."""

import numpy as np
from pyspark.sql import functions as F

from factgraph.llm import language, quality_rules
from factgraph.llm.common import sampled


def test_tiny_shares_are_met(spark):
    rows = spark.range(3_000_000)
    for share in (4e-7, 3e-5, 0.25):
        n = rows.where(sampled(share, F.lit("x"), "id")).count()
        assert abs(n - share * 3_000_000) <= 5 * (share * 3_000_000) ** 0.5 + 1
    assert rows.where(sampled(1.0, "id")).count() == 3_000_000 and rows.where(sampled(0.0, "id")).count() == 0


def test_few_labels_give_the_documented_share():
    for n, k in ((0, 0), (30, 23), (39, 30), (39, 0)):
        label = np.array([1.0] * k + [0.0] * (n - k))
        score = quality_rules.train(np.random.default_rng(0).normal(size=(n, len(quality_rules.STATISTICS))), label).score(np.zeros((1, len(quality_rules.STATISTICS))))
        assert abs(score[0] - (k + 1) / (n + 2)) < 1e-12


def test_repeated_labels_of_a_document_count_once(spark):
    docs = spark.createDataFrame([(i, "word " * (i + 1)) for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] * 3, "doc_id long, quality int")
    once = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    assert quality_rules.fit(docs, labels).offset == quality_rules.fit(docs, once).offset


def test_stretches_are_of_one_size_and_of_the_text():
    for text in ("a", "Ab" * 5000, "é" * 300):
        lent = language.stretches(text)
        assert len(lent) == language.STRETCHES * language.WINDOW and lent == language.stretches(text)
        for at in range(0, len(lent), language.WINDOW):
            held = lent[at : at + language.WINDOW].rstrip(b"\0")
            assert held and held in text.encode().lower()


def test_very_long_labelled_texts_and_windows_at_once(spark, monkeypatch):
    rows = [(i, ("thaing " if i % 2 else "schung ") * 60_000, "en" if i % 2 else "de") for i in range(24)] + [(30, "schung sch", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.fit(df)
    whole = net.predict([r[1] for r in rows])
    assert [p for p, _ in whole] == [r[2] or "de" for r in rows]
    monkeypatch.setattr(language, "WINDOWS_AT_ONCE", 3)
    assert net.predict([r[1] for r in rows]) == whole


def test_gradient_of_the_network_by_differences():
    """One step of training moves the loss as the network's own probabilities say it should: it falls."""
    texts = ["the thing there"] * 20 + ["der die schung"] * 20
    labels = ["en"] * 20 + ["de"] * 20
    lent = [language.stretches(f"{t} {i}") for i, t in enumerate(texts)]
    loss = lambda net: -np.mean([np.log(net.probabilities(np.frombuffer(w, np.uint8).reshape(-1, language.WINDOW))[:, net.languages.index(k)]).mean() for w, k in zip(lent, labels, strict=True)])
    assert loss(language.train(lent, labels, epochs=4)) < loss(language.train(lent, labels, epochs=1)) < 0.8


def test_compiled_rules_score_as_the_ensemble(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=(300, len(quality_rules.STATISTICS)))
    model = quality_rules.train(values, (values[:, 0] + values[:, 1] > 0).astype(float))
    assert model.rules
    frame = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(values)], "i int, " + ", ".join(f"stat_{s} double" for s in quality_rules.STATISTICS))
    got = [r.s for r in frame.select("i", model.column().alias("s")).orderBy("i").collect()]
    assert np.allclose(got, model.score(values), atol=1e-9)
