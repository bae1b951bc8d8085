"""The stored index gives what a scan of every text gives, and leaves most of itself unread."""

import math
import random
import re
from pathlib import Path

import pytest

from tonearm.operators import textindex
from tonearm.operators.textindex import add, built, search


def brute(docs, query, k1=1.2, b=0.75):
    words = list(dict.fromkeys(re.sub(r"[^\w-]", "", w) for w in query.lower().split()))
    split = {d: [w for w in re.sub(r"[^\w\s-]", "", (t or "").lower()).split() if w] for d, t in docs}
    mean = sum(map(len, split.values())) / len(split)
    counts = {d: [sum(w.startswith(q) for w in ws) for q in words] for d, ws in split.items()}
    df = [sum(c[i] > 0 for c in counts.values()) for i in range(len(words))]
    idf = [math.log(1 + (len(docs) - f + 0.5) / (f + 0.5)) for f in df]
    ranks = {d: sum(w * c * (k1 + 1) / (c + k1 * (1 - b + b * len(split[d]) / mean)) for w, c in zip(idf, counts[d])) for d in split if all(counts[d])}
    return sorted(ranks.items(), key=lambda x: (-x[1], x[0]))


def _docs(n, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}{i}" for i, (a, b) in enumerate((a, b) for a in "abcdefghij" for b in ("lue", "azz-", "Ock", "é"))]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 8, 40, 41, 200])))) for i in range(n)]
    return out + [(n, None), (n + 1, ""), (n + 2, "... !"), (n + 3, "a_b A_B a-b jazz")]


@pytest.fixture(scope="module")
def small(spark):
    block, textindex.BLOCK = textindex.BLOCK, 16
    docs = _docs(600)
    yield docs, built(spark.createDataFrame(docs, "id long, t string").repartition(3), "id", "t")
    textindex.BLOCK = block


@pytest.mark.parametrize("query", ["jazz", "blue", "b c", "a_ a-", "é d e", "blue0 zz", "g", "Jazz, jAzz blu", "nothing"])
@pytest.mark.parametrize("most", [None, 5, 50])
def test_as_a_scan(small, query, most):
    docs, index = small
    got = [(r.id, r.rank) for r in search(index, query, most).collect()]
    want = brute(docs, query)
    if most is None:
        got = sorted(got, key=lambda x: (-x[1], x[0]))
    assert [d for d, _ in got] == [d for d, _ in want[:most]]
    assert [r for _, r in got] == pytest.approx([r for _, r in want[:most]])


def test_parts_stay_unread(small, monkeypatch):
    monkeypatch.setattr(textindex, "AT_ONCE", 4)
    docs, index = small
    every = index.manifest().count()
    assert len(index.postings(["blue"]).inputFiles()) < every and index.postings(["zz"]) is None
    read = []
    search(index, "jlue36", 3, read=read).collect()
    blocks = index.postings(["jlue36"]).select("block").distinct().count()
    assert 0 < len(read) == len(set(read)) < 0.8 * blocks


def test_documents_are_added(spark, monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK", 16)
    docs = _docs(120, seed=2)
    index = built(spark.createDataFrame(docs[:50], "id long, t string"), "id", "t")
    add(index, spark.createDataFrame(docs[50:], "id long, t string"), "id", "t")
    for query in ("b", "jazz h"):
        assert [r.id for r in search(index, query, 20).collect()] == [d for d, _ in brute(docs, query)[:20]]


def test_empty(spark):
    index = built(spark.createDataFrame([], "id long, t string"), "id", "t")
    assert search(index, "x").count() == 0
    with pytest.raises(ValueError):
        search(index, " ,. ")


def test_disk_while_an_index_is_built(spark, tmp_path):
    """Shuffles, intermediate files and the index together stay near the size of the table; they were nine times this one."""
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(20_000)]
    docs = [(i, " ".join(rng.choice(words[: rng.choice([50, 1000, 20_000])]) for _ in range(rng.choice([20, 200, 600])))) for i in range(3000)]
    spark.createDataFrame(docs, "id long, t string").repartition(4).write.parquet(f"{tmp_path}/docs")
    local = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    folders = [*local, spark.conf.get("spark.checkpoint.dir").removeprefix("file://")]
    files = lambda top: {p: p.stat().st_size for d in top for p in Path(d).rglob("*") if p.is_file()}
    before = files(folders)
    index = built(spark.read.parquet(f"{tmp_path}/docs"), "id", "t")
    made = sum(n for p, n in files(folders).items() if p not in before)
    assert made < 3 * sum(files([tmp_path]).values())
    assert index.totals() == (3000, sum(len(t.split()) for _, t in docs) / 3000)
