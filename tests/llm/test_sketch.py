import hashlib
import random

import numpy as np

from tonearm.llm import sketch
from tonearm.llm._shingles import shingles
from tonearm.llm.sketch import containment, distinct, fingerprints, from_string, lowest, merge, merged, resemblance, to_string, with_edits


def _words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Ünï"]) + str(rng.randrange(50)) for _ in range(n))


def test_shingles_follow_the_definition():
    texts = ["", "  \n", "One", "one TWO\tthree\x0bfour", "a b c d e", "a b c d e a b c d e", "É b c d e f", "a  b c d E"]
    got = shingles(texts)

    def naive(t):
        words, cur = [], ""
        for c in t + " ":
            if c in " \t\n\x0b\x0c\r":
                words, cur = words + [cur] * bool(cur), ""
            else:
                cur += c.lower() if "A" <= c <= "Z" else c
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    want = [naive(t) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    for a, x in zip(want, got):
        for b, y in zip(want, got):
            assert len(a & b) == len(np.intersect1d(x, y))


def test_estimates():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([a[: len(a) // 2], rng.integers(0, 1 << 63, 2000).astype(np.uint64) * np.uint64(2)]))
    rng.shuffle(a)
    b = np.unique(np.concatenate([a[:2000], rng.integers(0, 1 << 63, 2000).astype(np.uint64) * np.uint64(2)]))
    a = np.sort(a)
    x, y = lowest(a), lowest(b)
    assert abs(resemblance(x, y) - 1 / 3) < 0.15 and abs(containment(x, y) - 0.5) < 0.2
    assert abs(distinct(x) / len(a) - 1) < 0.3
    assert (merge(x, y) == lowest(np.union1d(a, b))).all()
    assert (from_string(to_string(x)) == x).all() and to_string(lowest(a[:0])) == ""
    small, part = lowest(a[:50]), lowest(a[:40])
    assert resemblance(small, part) == 0.8 and distinct(small) == 50 and containment(part, small) == 1.0
    assert resemblance(lowest(a[:0]), lowest(a[:0])) == 1.0 and resemblance(small, lowest(a[:0])) == 0.0


def test_whole_table_and_merge(spark):
    rng = random.Random(6)
    rows = [(i * 7 % 101, _words(rng, rng.randrange(0, 200)), "x", 3) for i in range(60)] + [(200, None, "x", 3), (201, "", None, None), (202, _words(rng, 9000), None, 1), (5000, "last one", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, range string, late int").repartition(6)
    got = {r.doc_id: r for r in with_edits(docs, rows_each=9).collect()}
    order = sorted((d, t or "") for d, t, *_ in rows)
    assert len(got) == len(rows)
    for (d, t), (_, u) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edit = t[: len(t) - half] + u[:half]
        own, new, nxt = (lowest(shingles([x])[0]) for x in (t, edit, u))
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (to_string(own), to_string(new))
        assert (r.near_edited, r.near_next) == (resemblance(own, new), resemblance(own, nxt))
    prints = fingerprints(docs)
    keyed = prints.withColumn("g", prints.doc_id % 4)
    parts = {r.g: r.fingerprint for r in merged(keyed, "g").collect()}
    for g, f in parts.items():
        whole = np.unique(np.concatenate([shingles([t or ""])[0] for d, t, *_ in rows if d % 4 == g]))
        assert f == to_string(lowest(whole))


def test_null_ids_single_and_empty(spark):
    schema = "doc_id long, text string"
    rows = [(None, "a b c"), (3, "x y z"), (None, None)]
    got = sorted(with_edits(spark.createDataFrame(rows, schema)).collect(), key=str)
    assert len(got) == 3
    one = [r for r in got if r.doc_id == 3][0]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"x yx ").hexdigest()
    assert [r.near_next for r in got if r.doc_id is None] == [0.0, 0.0]
    many = with_edits(spark.createDataFrame([(None, f"n{i} o p") for i in range(40)] + [(i, f"w{i} b c d") for i in range(30)], schema), rows_each=7).collect()
    known = sorted((r.doc_id, r.edited_sha256) for r in many if r.doc_id is not None)
    texts = [f"w{i} b c d" for i in range(30)]
    edits = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:] + texts[:1])]
    assert known == [(i, hashlib.sha256(e.encode()).hexdigest()) for i, e in enumerate(edits)]
    alone = sorted(r.edited_sha256 for r in many if r.doc_id is None)
    assert alone == sorted(hashlib.sha256(t[: len(t) - len(t) // 2].encode()).hexdigest() for t in (f"n{i} o p" for i in range(40)))
    assert with_edits(spark.createDataFrame([], schema)).count() == 0
    twice = with_edits(spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c")], schema)).collect()
    assert len(twice) == 3 and sketch.K == 128
