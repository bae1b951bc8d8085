"""The segment index finds exactly the pairs that comparing all finds, and builds few."""

import random

import pytest
from pyspark.sql import functions as F

from tonearm.operators import entities, fuzzy
from tonearm.operators.fuzzy import nearest, other_row_matches, similar


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def alike(a, b):
    n = max(len(a), len(b))
    return 1.0 if a == b or n == 0 else 1 - distance(a, b) / n


def _texts(seed, n=60, longest=16):
    rng = random.Random(seed)
    out = {"", "a", "é", "ab", "日本語の本"}
    while len(out) < n:
        base = "".join(rng.choice("abcé ") for _ in range(rng.randrange(1, longest)))
        out.add(base)
        for _ in range(2):
            w = list(base)
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(2)] = rng.choice(["", "x", "b"])
            out.add("".join(w))
    return sorted(out)


def _df(spark, texts):
    return spark.createDataFrame([(t, 1) for t in texts] + [(None, 2), (texts[0], 3)], "text string, extra int")


@pytest.mark.parametrize("least", [1.0, 0.9, 0.8, 0.66, 0.5, 0.3])
def test_all_pairs_above_a_similarity(spark, least):
    a, b = _texts(1), _texts(2, longest=30)
    got = {(r.a, r.b) for r in similar(_df(spark, a + b[:20]), _df(spark, b), least).collect()}
    assert got == {(x, y) for x in set(a + b[:20]) for y in b if alike(x, y) >= least - 1e-7}


def test_nearest(spark):
    a, b = _texts(3), _texts(4)
    got = {}
    for r in nearest(_df(spark, a), _df(spark, b), 0.4).collect():
        got.setdefault(r.a, set()).add(r.b)
    want = {}
    for x in a:
        best = max(alike(x, y) for y in b)
        if best >= 0.4:
            want[x] = {y for y in b if alike(x, y) > best - 1e-7}
    assert got == want


def test_rows_against_all_other_rows(spark):
    rng = random.Random(5)
    texts = _texts(6, n=40)
    rows = [(i, rng.choice(texts[:25])) for i in range(40)] + [(100 + i, t) for i, t in enumerate(texts[25:])] + [(999, None)]
    got = {r.a: (r.b, pytest.approx(r.similarity, abs=1e-5)) for r in other_row_matches(spark.createDataFrame(rows, "k long, t string"), "k", "t", 0.3).collect()}
    want = {}
    for k, t in rows[:-1]:
        best = max(((round(alike(t, u), 6), j) for j, u in rows[:-1] if j != k), default=(0, 0))
        if best[0] >= 0.3:
            want[k] = (best[1], best[0])
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(got[k][1] == want[k][1] for k in want)


def test_few_pairs_are_built(spark, monkeypatch):
    """Of unlike texts a few in a thousand pairs meet by chance."""
    rng, compared = random.Random(7), fuzzy.names.similarity
    built = []
    for n in (300, 3000):
        texts = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(12)) for _ in range(n)]
        df = spark.createDataFrame([(t,) for t in texts], "text string")
        monkeypatch.setattr(fuzzy.names, "similarity", lambda a, b: F.lit(1.0).cast("float"))
        built.append(similar(df, df, 0.8).count())
        monkeypatch.setattr(fuzzy.names, "similarity", compared)
        assert similar(df, df, 0.8).count() == n
    print(built)
    assert built[0] < 0.008 * 300**2 and built[1] < 0.004 * 3000**2


def test_books(spark):
    books = [(1, "The Sea: a tale", "Ann Lee"), (2, "The  SEA", None), (3, "Thee Sea (x)", "Lee Ann"), (4, "Other", "Nobody")]
    offered = [(10, "the sea", ["ann lee"]), (11, "The Sea", ["Bo"]), (12, "the sea", ["ann lee"]), (13, "Sea, the", ["Ann Lee"])]
    got = {r.book_id: (r.position, round(r.confidence, 4)) for r in entities.matched_books(spark.createDataFrame(books, "book_id long, title string, author string"), spark.createDataFrame(offered, "position long, title string, authors array<string>"), 0.8).collect()}
    assert got == {1: (12, 1.0), 2: (12, 0.9), 3: (12, 0.875)}
