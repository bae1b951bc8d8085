"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint is the k least distinct 48-bit shingle hashes of a text, ascending, six bytes each, in
base64.  Equal sets of shingles have equal fingerprints, and the fingerprint of a union is made from
the fingerprints alone.  Fewer than k values mean the whole set is there and estimates are exact.

Null text: empty.  A text without words has the empty fingerprint; two empty ones are alike (1.0), an
empty and another not at all (0.0).  Ties: equal shingles count once;
rows with equal doc_id follow each other in order of their texts.
A row with a null doc_id has no place in the order: no text follows it, and near_next is 0.  Texts of any
length are taken whole.  An empty table gives no rows.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._order import ranges_of
from ._shingles import shingles

K = 128
SPACE = 1 << 48


def lowest(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of ascending distinct 64-bit hashes."""
    top = hashes[: 2 * k] >> np.uint64(16)
    if len(top) > 1:
        top = top[np.concatenate([[True], top[1:] != top[:-1]])]
    return top[:k]


def to_string(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_string(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), dtype=np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).reshape(-1).view(">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union."""
    return np.union1d(a, b)[:k]


def _shared(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int, np.ndarray]:
    both = np.sort(np.concatenate([a, b]))
    again = both[1:] == both[:-1]
    union = both[np.concatenate([[True], ~again])] if len(both) else both
    union = union[:k]
    common = int(np.count_nonzero(both[1:][again] <= union[-1])) if len(union) else 0
    return common, len(union), union


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated size of the intersection over that of the union."""
    common, size, _ = _shared(a, b, k)
    return common / size if size else 1.0


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * SPACE / float(a[-1])


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    common, size, union = _shared(a, b, k)
    whole = distinct(union, k)
    return min(1.0, common / size * whole / max(distinct(a, k), 1.0))


def merged(df: DataFrame, key: str, fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """One fingerprint per key for the union of its rows; values are dealt out, not gathered."""
    hexes = F.lower(F.hex(F.unbase64(fingerprint)))
    parts = F.transform(F.sequence(F.lit(0), (F.length(hexes) / 12).cast("int") - 1), lambda i: F.substr(hexes, (i * 12 + 1).cast("int"), F.lit(12)))
    values = df.select(key, F.explode(F.when(F.length(hexes) > 0, parts)).alias("v")).distinct()
    least = values.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("v"))).where(F.col("r") <= k)
    joined = least.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("v")), "").alias("h"))
    return df.select(key).distinct().join(joined, key, "left").select(key, F.coalesce(F.regexp_replace(F.base64(F.unhex("h")), "\\s", ""), F.lit("")).alias("fingerprint"))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, fingerprint and distinct-shingle estimate of every text; no shuffle."""

    def run(batches_in):
        for batch in batches_in:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                got = [lowest(x, k) for x in shingles([t or "" for t in part.column("text").to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(to_string, got), pa.string()), pa.array([distinct(x, k) for x in got], pa.float64())], names=["doc_id", "fingerprint", "n_shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string, n_shingles double")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_edits(docs: DataFrame, k: int = K, rows_each: int = 4096) -> DataFrame:
    """Fingerprints of every text and of its edit: the second half gives way to the start of the next document.

    Texts are dealt out once, by ranges of doc_id; the first document of a range goes to the range
    before as well (that of the first range to the last), so every document meets its successor.
    """
    cut = ranges_of(docs, "doc_id", rows_each)
    n = len(cut)
    rows = cut.number(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "doc_id", "own")
    is_first = F.col("doc_id").isin(cut.firsts) if cut.firsts else F.lit(False)
    here = F.struct(F.col("own").alias("range"), F.lit(0).alias("late"))
    before = F.struct(F.when(F.col("own") > cut.nulls, F.col("own") - 1).otherwise(n - 1).cast("int").alias("range"), F.lit(1).alias("late"))
    sent = rows.select("doc_id", "text", F.explode(F.when(is_first, F.array(here, before)).otherwise(F.array(here))).alias("to"))
    dealt = sent.select("doc_id", "text", "to.range", "to.late").repartitionById(n, F.col("range")).sortWithinPartitions("range", "late", F.asc_nulls_first("doc_id"), "text")

    names = [c.split()[0] for c in EDITED.split(", ")]

    def rows_of(docs_: list, texts: list[str], alone: bool = False):
        """Rows of all but the last of consecutive documents, or of all of those that nothing follows."""
        after = [""] * len(texts) if alone else texts[1:]
        n_rows = len(after)
        halves = [len(t) // 2 for t in texts]
        edits = [a[: len(a) - h] + b[:h] for a, b, h in zip(texts, after, halves)]
        got = [lowest(x, k) for x in shingles(texts + edits)]
        own, new = got[: len(texts)], got[len(texts) :]
        cols = [
            pa.array(docs_[:n_rows], pa.int64()),
            pa.array([len(t) for t in texts[:n_rows]], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
            pa.array([to_string(x) for x in own[:n_rows]], pa.string()),
            pa.array([to_string(x) for x in new], pa.string()),
            pa.array([resemblance(a, b, k) for a, b in zip(own, new)], pa.float64()),
            pa.array([0.0] * n_rows if alone else [resemblance(a, b, k) for a, b in zip(own, own[1:])], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches_in):
        docs_, texts, size, over, span = [], [], 0, False, None
        for batch in batches_in:
            for i in range(0, batch.num_rows, 256):
                part, loose = batch.slice(i, 256), []
                for doc, text, late, place in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "late", "range"))):
                    if place != span:
                        docs_, texts, size, over, span = [], [], 0, False, place
                    if doc is None:
                        loose.append(text)
                        continue
                    if over:
                        continue  # the range's successor has come; more rows with its id belong elsewhere
                    docs_.append(doc)
                    texts.append(text)
                    size += len(text)
                    over = bool(late)
                    if len(texts) > 1 and (over or len(texts) > 1024 or size > 2_000_000):
                        yield rows_of(docs_, texts)
                        docs_, texts, size = docs_[-1:], texts[-1:], len(texts[-1])
                if loose:
                    yield rows_of([None] * len(loose), loose, alone=True)

    return dealt.mapInArrow(run, EDITED)
