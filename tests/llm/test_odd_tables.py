"""Empty tables, repeated rows and clashing extra columns for fingerprints, pieces, quality, languages and neighbours."""

import public_tokenizers
import pytest

from tonearm.llm import hnsw, langid, quality, sentencepiece, sketch

DOCS = "doc_id long, text string, lang string, x int, score string, n_ids string, fingerprint int, near_next string, row int"
ROWS = [(1, "one two three four five six", "en", 1, "s", "n", 2, "r", 3)] * 2 + [(2, "zwei Wörter hier", "de", 1, "s", "n", 2, "r", 3), (None, None, None, None, None, None, None, None, None)]


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, score double, x string")


QUERIES = {
    "sketch": lambda spark, docs: sketch.with_edits(docs),
    "pieces": lambda spark, docs: sentencepiece.round_trips(docs, public_tokenizers.path("piece_bpe_32k.model")),
    "quality": lambda spark, docs: quality.classify(docs, _labels(spark, [(1, 1, 0, 0.5, "x"), (2, 0, 0, 0.5, "x"), (None, 1, 1, None, None), (1, None, None, None, None)])),
    "languages": lambda spark, docs: langid.classify(docs),
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_documents(spark, name):
    assert QUERIES[name](spark, spark.createDataFrame([], DOCS)).collect() == []
    got = QUERIES[name](spark, spark.createDataFrame(ROWS, DOCS).repartition(2)).collect()
    assert sorted((r.doc_id for r in got), key=str) == [1, 1, 2, None]


def test_no_labels(spark):
    got = quality.classify(spark.createDataFrame(ROWS, DOCS), _labels(spark, [])).collect()
    assert {(r.score, r.predicted) for r in got} == {(0.5, 1)}


def test_vectors(spark):
    schema = "vec_id long, embedding array<double>, shard string, rank string, score int, vector int, query_id string, path int"
    assert hnsw.neighbours(spark.createDataFrame([], schema)).collect() == []
    rows = [(100, [1.0, 0.0], "a", "b", 1, 2, "q", 3), (7, [0.0, 1.0], "a", "b", 1, 2, "q", 3), (7, [0.0, 1.0], "a", "b", 1, 2, "q", 3)]
    got = hnsw.neighbours(spark.createDataFrame(rows, schema)).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got)] == [(100, 1, 7), (100, 2, 7)]
