"""A passage that every task sees once is frequent all the same: work follows the corpus, not how it is dealt out."""

import random

import numpy as np
import pytest

from tonearm.llm import setjoin
from tonearm.llm.setjoin import CELL_BITS, Order, counted, frequencies, near_duplicates, summarised


def _templates(n, seed=5):
    rng = random.Random(seed)
    common = [f"t{i}" for i in range(60)]
    return [(d, " ".join(common + [f"o{rng.randrange(10**9)}" for _ in range(30)])) for d in range(n)]


@pytest.mark.parametrize("n,tasks", [(100, 100), (100, 4), (400, 100)])
def test_boilerplate_spread_over_tasks(spark, monkeypatch, n, tasks):
    monkeypatch.setattr(setjoin, "BLOCK_SHINGLES", 3000)
    sent, linked = [], setjoin.linked_within

    def counting(docs, jobs):
        sent.append(jobs.count())
        return linked(docs, jobs)

    monkeypatch.setattr(setjoin, "linked_within", counting)
    docs = spark.createDataFrame(_templates(n), "doc_id long, text string").repartition(tasks)
    got = near_duplicates(docs).collect()
    assert len(got) == n and all(r.component_id == r.doc_id for r in got)
    assert sum(sent) == 0  # nothing is a candidate


def test_counts_don_t_depend_on_the_layout(spark):
    docs = spark.createDataFrame(_templates(60), "doc_id long, text string")
    tables = [frequencies(summarised(docs.repartition(k))) for k in (1, 7, 60)]
    assert (tables[0] == tables[1]).all() and (tables[0] == tables[2]).all()
    assert np.bincount(tables[0])[47:].sum() >= 56 - 5  # 60 times: class 47; a few cells may meet


def test_order_and_rows():
    rng = np.random.default_rng(1)
    s = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    table = np.zeros(1 << CELL_BITS, dtype=np.uint8)
    late = s[::3]
    table[(late >> np.uint64(64 - CELL_BITS)).astype(np.int64)] = 40
    assert Order(table).prefix(s, 300).tolist() == np.setdiff1d(s, late).tolist() + late.tolist()
    rows = counted(np.concatenate([s, s[:50]]))
    assert sum(int(np.frombuffer(setjoin.zlib.decompress(r["counts"]), "<u4").sum()) for r in rows) == len(s) + 50
