"""Documents packed into sequences of bounded length: bounded-space online best fit.

Tokenised documents are cut only where longer than a sequence.  A packer keeps a fixed number of open
bins, found through a bitset keyed by free space: the lowest set bit at or above a piece's length is
the tightest bin that takes it.  Where no open bin takes a piece and all are in use, the fullest bin
closes first.  Pieces reach a packer in rounds, longest first, so short ones fill what long ones leave.

Null text: the end id alone.  Empty table: no rows.  Rows with equal doc_id are packed each on its own.
Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import batches, encoder, release
from ._store import written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class OpenBins:
    """At most ``limit`` open bins; ``put`` returns (bin, offset) of a piece."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bin_id = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_id

    def put(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            bin_id, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(bin_id)
            self.bits |= 1 << left
            self.open += 1
        return bin_id, self.capacity - free


def tokenised_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, keep_ids: bool = True, added_tokens: bool = False) -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit integers (null without ``keep_ids``) and their CRC-32.

    ``added_tokens``: strings of added tokens in a text become those tokens.
    """

    def cut(batches_in):
        enc = encoder(tokenizer)
        for batch in batches_in:
            at = 0
            for texts in batches(batch.column("text")):
                flat, stops = enc.encode(texts, added_tokens)
                out, lo = [], 0
                for j, hi in enumerate(stops.tolist()):
                    ids = np.append(flat[lo:hi], flat.dtype.type(end_id)).astype("<u4")
                    doc = batch.column("doc_id")[at + j].as_py()
                    for p, i in enumerate(range(0, len(ids), capacity)):
                        raw = ids[i : i + capacity].tobytes()
                        out.append((doc, p, i, len(raw) // 4, zlib.crc32(raw), raw if keep_ids else None))
                    lo = hi
                at += len(texts)
                d, p, s, n, c, r = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(p, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(r, pa.binary())], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def place(pieces: DataFrame, capacity: int = 4096, open_bins: int = 1024, pieces_per_packer: int = 200_000, pieces_per_round: int = 4096) -> DataFrame:
    """Packs pieces (doc_id, piece, start, length, ids_crc32), which must be a stored table: they are counted first.

    A packer takes its pieces in rounds by hash, each longest first: few enough bins are open at a time that hardly
    any closes early, and what a round leaves open the next one fills.
    """
    total = pieces.count()
    n, rounds = max(1, math.ceil(total / pieces_per_packer)), max(1, math.ceil(total / pieces_per_round))

    def pack(batches_in):
        bins, base = None, 0
        for batch in batches_in:
            if bins is None:
                from pyspark import TaskContext

                bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
            got = [bins.put(x) for x in batch.column("length").to_pylist()]
            at = pa.array([base + b for b, _ in got], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], at, pa.array([o for _, o in got], pa.int64())], names=[*batch.schema.names[1:], "sequence_id", "offset"])

    turn = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(rounds)).alias("turn")
    rows = pieces.select(turn, "doc_id", "piece", "start", "length", "ids_crc32")
    dealt = rows.repartition(n, "turn") if n > 1 else rows.coalesce(1)
    return dealt.sortWithinPartitions("turn", F.desc("length"), "doc_id", "piece", "ids_crc32").mapInArrow(pack, PLACED)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, open_bins: int = 1024, added_tokens: bool = False) -> DataFrame:
    """Tokenises and packs whole documents; returns one row per piece with its place."""
    return place(written(tokenised_pieces(docs, tokenizer, end_id, capacity, keep_ids=False, added_tokens=added_tokens).drop("ids"), "pieces"), capacity, open_bins)


def sequences(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id and its ids (little-endian unsigned 32-bit), pieces in place order."""
    ids = pieces.select("doc_id", "piece", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32"])
    whole = placed.join(ids, ["doc_id", "piece", "ids_crc32"])
    parts = whole.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("h")))).alias("p"))
    return parts.select("sequence_id", F.unhex(F.array_join(F.col("p.h"), "")).alias("ids"))
