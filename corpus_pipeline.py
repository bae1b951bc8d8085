"""From raw documents to packed training sequences.

Stages, each over all that the one before kept: the quality classifier and language ID drop documents,
the n-gram Jaccard join keeps one document of each group of near duplicates, the secret scan masks
secrets in the text, best-fit packing lays what is left into sequences.  Each stage's result is stored
and read again, so no stage depends on another's plan or executors.

Odd rows: quality scores null and empty texts as empty ones; language drops them, as they have no letter, and fills a
null lang.  Rows that repeat with one doc_id become one where duplicates are dropped; rows with a null doc_id all stay.
A null text stays null where secrets are masked and is a document of its end token alone where it is packed.  Texts
of any length are taken whole.  An empty table gives an empty result at every stage.  Every stage returns the
columns of documents alone, whatever other ones it is given; the last one returns what packing returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.llm import langid, packing, quality, secrets, setjoin
from tonearm.llm._store import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: SQL can express neither the classifiers nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out()).select("doc_id", F.col("quality").alias("label"))
    return quality.accepted(docs.select(*COLUMNS), quality.fit_texts(docs, labels))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language; fills a missing lang with the predicted one."""
    return langid.accepted(docs.select(*COLUMNS), langid.fit(docs.where(~langid.held_out())))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of every group of linked documents."""
    return setjoin.deduplicated(docs.select(*COLUMNS))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; n_chars follows the new text."""
    return secrets.masked(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document's tokens in sequences of at most 4096."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096, added_tokens=True)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; returns what the last one returns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
