import random

import numpy as np

from tonearm.llm.langid import OutputCodes, accepted, classify, codewords, counts, fit, predicted

SOUNDS = {"aa": ["ka", "ri", "mo", "tu"], "bb": ["sch", "ung", "ber", "ich"], "cc": ["ção", "nh", "lha", "or"], "dd": ["eau", "oi", "é", "ment"], "ee": ["sz", "cz", "ow", "ni"], "ff": ["жа", "ко", "ли", "ст"]}


def _text(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def _docs(spark, langs, each=120):
    rng = random.Random(2)
    rows = [(i, _text(rng, langs[i % len(langs)], rng.randrange(5, 60)), langs[i % len(langs)], 1.0) for i in range(each * len(langs))]
    rows += [(9000, None, langs[0], 1.0), (9001, "", langs[0], 1.0), (9002, "12 34 !?", langs[0], 1.0), (9003, _text(rng, langs[0], 4000), None, 1.0), (None, _text(rng, langs[0], 20), langs[0], 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), rows


def test_held_out_accuracy(spark):
    for langs in (["aa", "bb", "cc", "dd"], list(SOUNDS)):
        docs, rows = _docs(spark, langs)
        lang = {r[0]: r[2] for r in rows}
        got = classify(docs).collect()
        assert len(got) == len(rows)
        held = [r for r in got if r.held_out and r.doc_id < 9000]
        assert len(held) > 50 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
        by = {r.doc_id: r for r in got}
        assert [by[i].lang_pred for i in (9000, 9001, 9002, 9003, None)] == ["und", "und", "und", langs[0], langs[0]]
        assert all(0 <= r.score <= 1 for r in got) and by[9001].score == 0 and by[9001].ambiguous


def test_mixed_text_is_flagged(spark):
    docs, _ = _docs(spark, ["aa", "bb"])
    model = fit(docs)
    rng = random.Random(3)
    mixed = " ".join(w for a, b in zip(_text(rng, "aa", 200).split(), _text(rng, "bb", 200).split()) for w in (a, b))
    x = counts([_text(rng, "aa", 50), mixed])
    _, score, _ = model.decode(x)
    assert score[0] > score[1]


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 5, 9, 30):
        code = codewords(n).astype(int)
        gaps = (code.shape[1] - code @ code.T) // 2
        assert gaps[~np.eye(n, dtype=bool)].min() >= max(1, code.shape[1] // 4)
        assert (np.abs(code.sum(axis=0)) < n).all()


def test_one_language_none_and_empty(spark):
    schema = "doc_id long, text string, lang string"
    one = classify(spark.createDataFrame([(i, "some text", "xx") for i in range(20)], schema)).collect()
    assert {r.lang_pred for r in one} == {"xx"}
    none = classify(spark.createDataFrame([(1, "some text", None)], schema)).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]
    assert classify(spark.createDataFrame([], schema)).count() == 0


def test_accepted_keeps_columns(spark):
    docs, rows = _docs(spark, ["aa", "bb", "cc"])
    kept = accepted(docs, fit(docs))
    assert kept.schema == docs.schema
    got = kept.collect()
    assert len(got) == len(rows) - 3 and {r.lang for r in got if r.doc_id == 9003} == {"aa"}


def test_prediction_ignores_labels(spark):
    docs, _ = _docs(spark, ["aa", "bb", "cc"])
    model = fit(docs)
    a = predicted(docs, model).drop("doc_id")
    b = predicted(docs.withColumn("lang", docs.lang.substr(1, 0)), model).drop("doc_id")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert isinstance(model, OutputCodes)


def test_decoding_as_a_plain_loop():
    """Loss of every codeword bit by bit, weighted by trust; the least loss wins, and scores are its share."""
    import math

    rng = np.random.default_rng(8)
    languages = ["a", "b", "c", "d", "e", "f"]
    code = codewords(6)
    m = OutputCodes(languages, code, rng.normal(size=(30, code.shape[1])), rng.normal(size=code.shape[1]), rng.random(code.shape[1]))
    x = rng.normal(size=(40, 30))
    best, score, gap = m.decode(x)
    for i in range(40):
        margins = [sum(x[i, k] * m.weights[k, b] for k in range(30)) + m.bias[b] for b in range(code.shape[1])]
        losses = [sum(m.trust[b] * math.log1p(math.exp(-m.sharp * max(-2, min(2, margins[b])) * int(word[b]))) for b in range(len(word))) for word in code]
        like = [math.exp(-m.sharp * (v - min(losses))) for v in losses]
        like = [v / sum(like) for v in like]
        assert best[i] == losses.index(min(losses)) and abs(score[i] - max(like)) < 1e-9 and abs(gap[i] - (sorted(like)[-1] - sorted(like)[-2])) < 1e-9


def test_a_very_long_text(spark):
    docs, _ = _docs(spark, ["aa", "bb"])
    model = fit(docs)
    rng = random.Random(4)
    long = spark.createDataFrame([(1, _text(rng, "aa", 150_000)), (2, _text(rng, "bb", 150_000) + " x" * 10)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in predicted(long, model).collect()} == {1: "aa", 2: "bb"}
