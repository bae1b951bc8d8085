"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1.  For each bit one linear classifier over hashed letter
n-grams (1 to 3) says on which side a text lies.  Decoding adds, for every codeword, the logistic loss
of each bit's margin, weighted by how well that bit did in cross-validation; the least loss wins.
A small gap between the two best flags the text as ambiguous.

Null text and texts without a letter: ``und``, score 0.  Training takes at most ``per_language``
documents of each language (those of least hash) and ``max_rows`` in all, so of more than ``max_rows`` / 2
languages those with the most documents; rows with a null doc_id, a null language or no letters teach
nothing.  Without any training row, as in an empty table, every text is ``und``.  Texts of any length are taken whole.
Rows that repeat are predicted each on its own; a doc_id that repeats teaches with up to ``max_rows`` more rows in all.
Ties go to the language first in order.  Columns other than doc_id, text and lang are ignored (``accepted`` keeps them).
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import written

DIM = 1 << 13
UNDETERMINED = "und"
_LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def counts(texts: list[str]) -> np.ndarray:
    """Square roots of each text's n-gram shares, hashed into DIM places (rows without letters are 0)."""
    low = [t.lower() for t in texts]
    code = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    letter = _LETTER[code]
    edge = np.zeros(len(code), dtype=bool)
    edge[np.cumsum([len(t) + 1 for t in low]) - 1] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one gap after every word
    keep |= edge
    c = np.where(letter, code, 0)[keep].astype(np.uint32)
    d = doc[keep]
    h = c * np.uint32(0x9E3779B1)
    two = h[:-1] * np.uint32(31) + h[1:]
    three = two[:-1] * np.uint32(0x85EBCA6B) + h[2:]
    flat = []
    for x, own in ((h, d), (two, d[1:]), (three, d[2:])):
        x = x ^ (x >> np.uint32(15))
        x = x * np.uint32(0x2C1B3C6D)
        flat.append(own * DIM + (x >> np.uint32(19)).astype(np.int64))
    last = letter[keep]
    whole = [last, last[:-1] | last[1:], (d[:-2] == d[2:]) & last[1:-1]]
    out = np.bincount(np.concatenate([f[w] for f, w in zip(flat, whole)]), minlength=len(texts) * DIM).reshape(len(texts), DIM).astype(np.float32)
    total = out.sum(axis=1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1))


def codewords(n: int) -> np.ndarray:
    """n codewords: all distinct columns up to five languages, else columns chosen to keep rows far apart."""
    if n < 2:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 5:
        cols = [(1, *c) for c in itertools.product((1, -1), repeat=n - 1) if -1 in c]
        return np.array(cols, dtype=np.int8).T
    rng = np.random.default_rng(7)
    length = int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, length))
        gaps = (length - code.astype(int) @ code.T.astype(int)) // 2
        least = int(gaps[~np.eye(n, dtype=bool)].min())
        if least > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, least
    return best


class OutputCodes:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray, sharp: float = 6.0):
        self.languages, self.code, self.weights, self.bias, self.trust, self.sharp = languages, code, weights, bias, trust, sharp

    @classmethod
    def fit(cls, x: np.ndarray, lang: list[str], ridge: float = 0.02) -> "OutputCodes":
        languages = sorted(set(lang))
        code = codewords(len(languages)) if languages else np.zeros((0, 1), dtype=np.int8)
        if len(languages) < 2:
            return cls(languages, code, np.zeros((x.shape[1] if len(x) else DIM, 1), np.float32), np.ones(1), np.ones(1))
        y = code[[languages.index(v) for v in lang]].astype(float)
        share = np.array([lang.count(v) for v in languages], dtype=float)
        load = np.sqrt(1 / share[[languages.index(v) for v in lang]])[:, None]  # languages weigh the same
        load /= load.mean()
        kernel = ((x @ x.T).astype(np.float64) + 1.0) * load * load.T
        inverse = np.linalg.inv(kernel + ridge * len(lang) / 10 * np.eye(len(lang)))
        alpha = inverse @ (y * load)
        left_out = y * load - alpha / np.diag(inverse)[:, None]  # predictions of each row without it
        right = (np.sign(left_out) == y).mean(axis=0)
        trust = np.log((right + 0.01) / (1.01 - right)).clip(0.05)
        alpha = alpha * load
        return cls(languages, code, x.T @ alpha.astype(np.float32), alpha.sum(axis=0), trust / trust.sum())

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share of the softened losses, and the gap to the next."""
        margin = x @ self.weights + self.bias
        loss = np.log1p(np.exp(-self.sharp * np.clip(margin, -2, 2)[:, None, :] * self.code[None])) @ self.trust
        like = np.exp(-self.sharp * (loss - loss.min(axis=1, keepdims=True)))
        like /= like.sum(axis=1, keepdims=True)
        best = like.argmax(axis=1)
        two = np.sort(like, axis=1)[:, -2:]
        return best, like.max(axis=1), two[:, -1] - two[:, 0] if like.shape[1] > 1 else np.ones(len(x))


def training_ids(docs: DataFrame, per_language: int, max_rows: int) -> dict[str, list[int]]:
    """Ids of the sample: per language those of least hash; only the sample and its languages' counts reach the driver. ``docs``: doc_id, lang."""
    many = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max(1, max_rows // 2)).collect()}
    if not many:
        return {}
    each = max(2, min(per_language, max_rows // len(many)))
    span = 1 << 31
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(span))
    most = F.lit(0).cast("long")
    for lang, n in many.items():
        most = F.when(F.col("lang") == lang, F.lit(min(span, int(span * (2 * each + 50) / n)))).otherwise(most)
    got: dict[str, list[tuple[int, int]]] = {}
    for r in docs.select("doc_id", "lang", mark.alias("m")).where(F.col("m") < most).distinct().collect():
        got.setdefault(r["lang"], []).append((r["m"], r["doc_id"]))
    return {lang: [i for _, i in sorted(v)[:each]] for lang, v in got.items()}


def fit(docs: DataFrame, per_language: int = 400, max_rows: int = 2400) -> OutputCodes:
    """Learns from ``docs`` (doc_id, text, lang), from at most ``max_rows`` of them."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("doc_id IS NOT NULL AND lang IS NOT NULL AND text RLIKE '\\\\p{L}'")
    ids = training_ids(written(known.select("doc_id", "lang"), "lang-known"), per_language, max_rows)  # texts are read once for this
    wanted = sorted({i for v in ids.values() for i in v})

    def run(batches_in):
        for batch in batches_in:
            for i in range(0, batch.num_rows, 32):
                part = batch.slice(i, 32)
                x = counts(part.column("text").to_pylist())
                rows = [(np.flatnonzero(r), r) for r in x]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lang"), pa.array([a.astype("<u2").tobytes() for a, _ in rows], pa.binary()), pa.array([r[a].astype("<f4").tobytes() for a, r in rows], pa.binary())],
                    names=["doc_id", "lang", "places", "shares"],
                )

    rows = known.where(F.col("doc_id").isin(wanted)).mapInArrow(run, "doc_id long, lang string, places binary, shares binary").collect() if wanted else []
    rows = sorted(rows, key=lambda r: (r["lang"], r["doc_id"], bytes(r["places"])))[: 2 * max_rows]
    x = np.zeros((len(rows), DIM), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["places"], dtype="<u2")] = np.frombuffer(r["shares"], dtype="<f4")
    return OutputCodes.fit(x, [r["lang"] for r in rows])


def predicted(docs: DataFrame, model: OutputCodes, ambiguous_below: float = 0.2) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every whole text."""

    def run(batches_in):
        for batch in batches_in:
            for i in range(0, batch.num_rows, 32):
                part = batch.slice(i, 32)
                texts = [t or "" for t in part.column("text").to_pylist()]
                known = [has_letter(t) and bool(model.languages) for t in texts]
                best, score, gap = model.decode(counts(texts)) if model.languages else (np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([model.languages[b] if k else UNDETERMINED for b, k in zip(best, known)], pa.string()),
                        pa.array([float(s) if k else 0.0 for s, k in zip(score, known)], pa.float64()),
                        pa.array([bool(g < ambiguous_below) if k else True for g, k in zip(gap, known)], pa.bool_()),
                    ],
                    names=["doc_id", "lang_pred", "score", "ambiguous"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def classify(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous; learns from documents that aren't held out."""
    model = fit(docs.where(~held_out()), per_language)
    return predicted(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def accepted(docs: DataFrame, model: OutputCodes, least_score: float = 0.5, ambiguous_below: float = 0.2) -> DataFrame:
    """The rows of ``docs`` (text, lang and others) with a letter and a clear language; a null lang is filled.

    Rejected: texts without letters, and ambiguous ones of which the score is below ``least_score``.
    """

    def run(batches_in):
        for batch in batches_in:
            for i in range(0, batch.num_rows, 32):
                part = batch.slice(i, 32)
                texts = [t or "" for t in part.column("text").to_pylist()]
                if not model.languages:
                    continue
                best, score, gap = model.decode(counts(texts))
                keep = [has_letter(t) and not (g < ambiguous_below and s < least_score) for t, s, g in zip(texts, score, gap)]
                if not any(keep):
                    continue
                lang = pa.array([v if v is not None else model.languages[b] for v, b in zip(part.column("lang").to_pylist(), best)], part.schema.field("lang").type)
                yield part.set_column(part.schema.get_field_index("lang"), part.schema.field("lang"), lang).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
