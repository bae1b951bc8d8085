import re
from collections import defaultdict

import pytest

import corpus_pipeline
from tonearm.llm import langid, quality, setjoin

from .test_secrets import ASSIGN
from .test_setjoin import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        out.append((name, before, docs))
    return {name: (before, after) for name, before, after in out}


def test_columns(stages):
    assert list(stages) == ["quality", "language", "near_duplicates", "secrets", "packing"]
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == list(corpus_pipeline.COLUMNS) and after.dtypes == before.select(*corpus_pipeline.COLUMNS).dtypes


def test_quality_decisions(spark, stages):
    before, after = stages["quality"]
    got = quality.classify(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in got.where("predicted = 1").collect()} == {r.doc_id for r in after.collect()}
    assert 0 < after.count() < before.count()


def test_language_decisions(stages):
    before, after = stages["language"]
    und = {r.doc_id for r in langid.classify(before).where("lang_pred = 'und'").collect()}
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} >= und
    assert after.count() >= 0.98 * before.count()


def test_near_duplicate_decisions(stages):
    before, after = stages["near_duplicates"]
    want = brute([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in after.collect()} == {d for d, (_, c) in want.items() if d == c}
    assert setjoin.near_duplicates(after).where("component_id <> doc_id").count() == 0


def test_secrets_are_masked(stages):
    before, after = stages["secrets"]
    old = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert not [m for m in ASSIGN.finditer(r.text) if len(m[2]) >= 6] and not re.search("[0-9a-f]{24}|AKIA[A-Z0-9]{16}", r.text)
        assert r.n_chars == len(r.text)
        assert r.text == old[r.doc_id] or "[SECRET]" in r.text


def test_packing_and_run(spark, stages):
    before, after = stages["packing"]
    rows = after.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in before.collect()}
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        ends = [o + n for o, n in sorted(b)]
        assert [o for o, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 4096
    whole = corpus_pipeline.run(spark, SF).collect()
    key = lambda rs: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rs)
    assert key(whole) == key(rows)
