import random

import numpy as np

from tonearm.llm.quality import FEATURES, Discriminant, accepted, classify, featurised, fit, fit_texts, statistics


def _doc(rng, good):
    words = ["".join(rng.choice(["the", "ing", "an", "er", "ou"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 200))]
    if good:
        return ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, len(words), 9))
    return rng.choice([" ".join(words[:3]) * 30, " ".join(w + "###" for w in words), " ".join(w.upper() + "!!" for w in words)])


def _tables(spark, n=300):
    rng = random.Random(1)
    rows = [(i, _doc(rng, i % 4 != 0), "x", 0.5) for i in range(n)]
    docs = spark.createDataFrame(rows + [(900, None, "x", 0.5), (901, "", "x", 0.5), (None, "a b", "x", 0.5), (902, "word " * 50_000, "x", 0.5)], "doc_id long, text string, score string, label double")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0, 1.0) for i in range(n)] + [(3, None, 1, 1.0), (7, 5, 1, 1.0), (None, 1, 0, 1.0), (5, 1, 0, 1.0)], "doc_id long, quality int, toxic int, score double")
    return docs, labels, n


def test_held_out_accuracy(spark):
    docs, labels, n = _tables(spark)
    got = classify(docs, labels).collect()
    assert len(got) == n + 4
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < n]
    assert len(held) > 30 and np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_moments_match_numpy(spark):
    docs, labels, n = _tables(spark, 80)
    rows = {r.doc_id: np.array(r.x) for r in featurised(docs).collect()}
    model = fit(featurised(docs), labels.selectExpr("doc_id", "quality AS label"))
    x = {c: np.array([rows[i] for i in [*range(80), 5] if int(i % 4 != 0) == c]) for c in (0, 1)}
    direct = Discriminant({c: (len(v), v.sum(axis=0), v.T @ v) for c, v in x.items()})
    probe = np.array(list(rows.values()))
    assert np.allclose(model.score(probe), direct.score(probe), atol=1e-6)
    pooled = sum(len(v) * np.cov(v.T, bias=True) for v in x.values()) / 81
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    like = {}
    for c, v in x.items():
        own = (0.8 * np.cov(v.T, bias=True) + 0.2 * pooled) / np.outer(scale, scale)
        own = 0.98 * own + 0.02 * np.trace(own) / len(FEATURES) * np.eye(len(FEATURES)) + 1e-9 * np.eye(len(FEATURES))
        z = (probe - v.mean(axis=0)) / scale
        like[c] = -0.5 * (np.einsum("ij,jk,ik->i", z, np.linalg.inv(own), z) + np.linalg.slogdet(own)[1]) + np.log(len(v))
    assert np.allclose(direct.score(probe), 1 / (1 + np.exp(-np.clip(like[1] - like[0], -700, 700))), atol=1e-5)


def test_degenerate_tables(spark):
    docs, labels, _ = _tables(spark, 8)
    assert {r.score for r in classify(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in classify(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert classify(docs.limit(0), labels).count() == 0
    assert np.isfinite(statistics(["", " ", "\n\n", "x", "é" * 1000])).all()


def test_accepted_is_the_classifier(spark):
    docs, labels, _ = _tables(spark, 120)
    model = fit(featurised(docs), labels.selectExpr("doc_id", "quality AS label"))
    kept = accepted(docs, model)
    assert kept.schema == docs.schema
    good = {r.doc_id for r in featurised(docs).collect() if model.score(np.array([r.x]))[0] >= 0.3}
    assert {r.doc_id for r in kept.collect()} == good


def test_fit_on_texts_reads_labelled_ones_and_gives_the_same_model(spark):
    docs, labels, _ = _tables(spark, 80)
    labels = labels.where("doc_id < 50 OR doc_id IS NULL").selectExpr("doc_id", "quality AS label")
    probe = np.array([r.x for r in featurised(docs).collect()])
    whole = fit(featurised(docs), labels).score(probe)
    for most in (0, 1_000):
        assert np.allclose(fit_texts(docs, labels, broadcast_rows=most).score(probe), whole, atol=1e-6)
