"""Quality score of texts: regularised quadratic discriminant analysis over document statistics.

Each whole text becomes a vector of transformed statistics.  Each class keeps its mean and a shrunken
covariance (towards the pooled one, then towards a scaled identity), whose Cholesky factor is computed
once; a score is the logistic of the difference of Mahalanobis log-densities and of log priors.

Statistics of all labelled rows are summed in one aggregation; nothing is sampled.  Null text: empty.
Null or other labels than 0 and 1 teach nothing; a document with several labels counts once for each.
Where one class has no rows every score is the share of label 1 (0.5 without labels).  Rows with a
null doc_id are scored and never learnt from.  Rows that repeat are scored each, and each counts where its doc_id
is labelled.  Ties: a score of exactly the threshold is accepted, and equal texts
have equal scores.  Texts of any length are taken whole.  An empty table gives no rows.  Columns other than doc_id and text
are ignored (``accepted`` keeps them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shingles import text_bytes, word_hashes
from ._store import written

BROADCAST_ROWS = 1_000_000
FEATURES = ("log_words", "word_length", "symbols", "digits", "capitals", "stops", "distinct_words", "top_word", "repeats", "same_next", "same_lines", "line_words", "odd_words", "entropy")
_SYMBOL, _DIGIT, _UPPER, _STOP, _ALPHA = (np.zeros(256, dtype=bool) for _ in range(5))
_SYMBOL[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,'"]] = True
_DIGIT[48:58] = True
_UPPER[65:91] = True
_STOP[[ord("."), ord(",")]] = True
_ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _share(x, n, floor: float):
    """The log of a share, level below ``floor``: what is rare weighs the same in short and long texts."""
    return np.log(x / np.maximum(n, 1) + floor)


def _sums(mask: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[ends])


def statistics(texts: list[str]) -> np.ndarray:
    """One row of transformed statistics per text."""
    data, ends = text_bytes(texts)
    n_bytes = np.diff(ends).astype(float)
    words, many = word_hashes(data, ends)
    counts = {k: _sums(t[data], ends).astype(float) for k, t in (("symbol", _SYMBOL), ("digit", _DIGIT), ("upper", _UPPER), ("stop", _STOP), ("alpha", _ALPHA))}
    ws = _sums(data <= 32, ends).astype(float)
    out = np.zeros((len(texts), len(FEATURES)))
    stops = np.cumsum(many)
    for i, (n, stop) in enumerate(zip(many.tolist(), stops.tolist())):
        own = np.sort(words[stop - n : stop])
        if n:
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            runs = np.diff(first, append=n)
            raw = words[stop - n : stop]
            next_same = int(np.count_nonzero(raw[1:] == raw[:-1]))
            once, most = int(np.count_nonzero(runs == 1)), int(runs.max())
        else:
            runs, next_same, once, most = np.zeros(0), 0, 0, 0
        part = data[ends[i] : ends[i + 1]]
        lines = texts[i].split("\n")
        byte = np.bincount(part, minlength=256) / max(1, len(part))
        byte = byte[byte > 0]
        out[i, 6:] = (np.log((len(runs) + 1) / (n + 1)), _share(max(most - 2, 0), n, 0.2), _share(n - once, n, 0.2), _share(max(next_same - 1, 0), n, 0.2), _share(len(lines) - len(set(lines)), len(lines), 0.2), np.log1p(n / len(lines)), 0.0, float(-(byte * np.log2(byte)).sum()))
    m = many.astype(float)
    out[:, 0] = np.log1p(m)
    out[:, 1] = np.log1p((n_bytes - ws) / np.maximum(1, m))
    for c, k in enumerate(("symbol", "digit", "upper", "stop"), 2):
        out[:, c] = _share(counts[k], n_bytes, 0.03)
    out[:, 12] = _share(n_bytes - ws - counts["alpha"], n_bytes - ws, 0.05)
    return out


def featurised(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics as an array; reads each text once."""

    def run(batches_in):
        for batch in batches_in:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                x = statistics([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


class Discriminant:
    """Fitted from each class's count, sum and sum of outer products."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float = 0.2, to_identity: float = 0.02):
        n = {c: m[0] for c, m in moments.items()}
        self.share = n.get(1, 0) / sum(n.values()) if n and sum(n.values()) else 0.5
        self.ready = len(n) == 2 and min(n.values()) >= 2
        if not self.ready:
            return
        d = len(moments[0][1])
        mean = {c: s / k for c, (k, s, _) in moments.items()}
        cov = {c: q / k - np.outer(mean[c], mean[c]) for c, (k, _, q) in moments.items()}
        pooled = sum(n[c] * cov[c] for c in n) / sum(n.values())
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
        self.mean, self.inverse, self.log_det = {}, {}, {}
        for c in n:
            own = ((1 - to_pooled) * cov[c] + to_pooled * pooled) / np.outer(self.scale, self.scale)
            own = (1 - to_identity) * own + to_identity * max(np.trace(own) / d, 1e-6) * np.eye(d)
            factor = np.linalg.cholesky(own + 1e-9 * np.eye(d))
            self.inverse[c] = np.linalg.inv(factor)
            self.log_det[c] = 2 * float(np.log(np.diag(factor)).sum())
            self.mean[c] = mean[c]
        self.bias = float(np.log(n[1] / n[0]))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.share)
        like = {}
        for c in (0, 1):
            z = ((x - self.mean[c]) / self.scale) @ self.inverse[c].T
            like[c] = -0.5 * ((z * z).sum(axis=1) + self.log_det[c])
        return 1 / (1 + np.exp(-np.clip(like[1] - like[0] + self.bias, -700, 700)))


def fit(features: DataFrame, labels: DataFrame) -> Discriminant:
    """``labels``: doc_id and label 0 or 1. Two rows of sums reach the driver."""
    d = len(FEATURES)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    x = [F.col("x")[i] for i in range(d)]
    sums = [F.sum(v) for v in x] + [F.sum(x[i] * x[j]) for i in range(d) for j in range(i, d)]
    rows = features.join(known, "doc_id").groupBy("label").agg(F.count("*").alias("n"), F.array(*sums).alias("s")).collect()
    moments = {}
    for r in rows:
        s = np.array(r["s"], dtype=float)
        q = np.zeros((d, d))
        q[np.triu_indices(d)] = s[d:]
        moments[r["label"]] = (float(r["n"]), s[:d], q + np.triu(q, 1).T)
    return Discriminant(moments)


def fit_texts(docs: DataFrame, labels: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> Discriminant:
    """``fit`` on texts, for a model without scores of ``docs``: each labelled text is read once.

    Up to ``broadcast_rows`` labels are sent to the tasks, which then skip the other texts; beyond, the statistics of
    all texts meet the labels in a shuffle, as they are shorter than the texts.  The model is the same.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if ids.count() <= broadcast_rows:
        texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")
    return fit(featurised(texts), labels)


def scored(features: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    def run(batches_in):
        for batch in batches_in:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                s = model.score(x)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return features.select("doc_id", "x").mapInArrow(run, "doc_id long, score double, predicted int")


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; learns from labels that aren't held out."""
    features = written(featurised(docs), "quality-features")
    model = fit(features, labels.where(~held_out()).select("doc_id", F.col("quality").alias("label")))
    return scored(features, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``; texts don't move."""

    def run(batches_in):
        for batch in batches_in:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                keep = model.score(statistics([t or "" for t in part.column("text").to_pylist()])) >= threshold
                if keep.any():
                    yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
