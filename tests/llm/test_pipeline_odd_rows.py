"""Null, empty, very long, repeated and clashing input at every stage of the pipeline."""

import pytest

import corpus_pipeline
from tonearm.llm import langid, quality

SF = "/root/testdata/sf0.001"
EXTRA = ["row", "spans", "base", "score", "component_id", "x", "label", "shard", "keep"]
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def good(spark):
    """A document that quality accepts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ok = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    return max((r for r in docs.collect() if r.doc_id in ok and r.lang), key=lambda r: (len(r.text), r.doc_id))


@pytest.fixture(scope="module")
def odd(spark, good):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"{w}{i}" if i % 9 == 0 else w for i, w in enumerate(good.text.split() * 200))
    rows = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (None, good.text, good.lang, None, 1), (None, None, None, None, None)]
    rows += [(10**6 + 2, good.text, None, "s", 5)] * 2 + [(10**6 + 3, good.text + " token=abcdef12", good.lang, "s", 5), (10**6 + 4, long, good.lang, "s", 5), (10**6 + 5, " \n12 34", "en", "s", 6)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame(rows, schema))
    for i, c in enumerate(EXTRA):
        docs = docs.selectExpr("*", f"{i} AS {c}")
    return docs.cache()


def _odd(df):
    return sorted(((r.doc_id, r.text, r.lang) for r in df.collect() if r.doc_id is None or r.doc_id >= 10**6), key=str)


@pytest.mark.parametrize("name", [n for n in STAGES if n != "packing"])
def test_columns_and_empty_tables(spark, odd, name):
    assert STAGES[name](spark, odd.limit(0), SF).collect() == []
    assert STAGES[name](spark, odd, SF).columns == list(corpus_pipeline.COLUMNS)


def test_quality(spark, odd, good):
    got = _odd(STAGES["quality"](spark, odd, SF))
    texts = [t for _, t, _ in got]
    assert texts.count(good.text) == 3 and len([t for t in texts if t in (None, "")]) in (0, 3)


def test_language(spark, odd, good):
    got = {(d, t): v for d, t, v in _odd(STAGES["language"](spark, odd, SF))}
    assert {d for d, _ in got} == {None, 10**6 + 2, 10**6 + 3, 10**6 + 4} and (None, None) not in got
    assert got[10**6 + 2, good.text] == good.lang


def test_near_duplicates(spark, odd, good):
    got = [(d, t) for d, t, _ in _odd(STAGES["near_duplicates"](spark, odd, SF))]
    assert sum(d is None for d, _ in got) == 2 and {d for d, _ in got} >= {None, 10**6, 10**6 + 1, 10**6 + 4, 10**6 + 5}
    assert not {10**6 + 2, 10**6 + 3} & {d for d, _ in got}  # the first document of their text has a smaller doc_id


def test_secrets(spark, odd, good):
    got = _odd(STAGES["secrets"](spark, odd, SF))
    assert len(got) == 9 and (10**6, None, None) in got and (10**6 + 3, good.text + " [SECRET]", good.lang) in got


def test_packing(spark, odd):
    rows = STAGES["packing"](spark, odd, SF).collect()
    assert len([r for r in rows if r.doc_id == 10**6 + 2]) == 2 * len({r.piece for r in rows if r.doc_id == 10**6 + 2})
    assert [r.length for r in rows if r.doc_id == 10**6] == [1] and len([r for r in rows if r.doc_id == 10**6 + 4]) > 2
    assert STAGES["packing"](spark, odd.limit(0), SF).collect() == []


def test_letters_beyond_the_second_plane():
    text = chr(0x20000) * 5 + " " + chr(0x30000)
    assert langid.has_letter(text) and langid.counts([text])[0].sum() > 0
