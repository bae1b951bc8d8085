"""Token ids as one compressed wavelet-matrix file per shard.

A shard holds the documents of one contiguous range of doc_id in ascending order (rows with a null id
first), each followed by an end id.  Its file has one bit-plane per bit of the largest id.  A plane is
cut into blocks of 64 KiB, each compressed on its own where that helps, with the count of ones before
every block and every 512 bits, so access, rank, select, counting and occurrence lookup read only the
blocks they touch.  A table of doc_id and length per document closes the file.

Layout: magic ``TWM1``, u32 header length, JSON header, then the parts the header points to.
Null text: no ids but the end id.  Repeated rows are kept; equal doc_ids keep any order.  An empty
table writes no file.  Other columns are ignored, whatever their names.
Texts of any length are taken whole; one that exceeds a file's tokens makes a longer file.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bpe import batches, encoder, release
from ._order import ranges_of
from ._store import open_file, put_file, shared_dir, written

MAGIC = b"TWM1"
BLOCK = 1 << 16  # bytes of a plane
STEP = 64  # bytes between rank samples
MANIFEST = "shard long, part int, path string, docs long, tokens long"
TOKENS = "shard long, part int, doc_id long, local_start long, n_tokens long, ids binary"


class _Parts:
    def __init__(self):
        self.out, self.size = [], 0

    def add(self, raw: bytes) -> list[int]:
        at = self.size
        self.out.append(raw)
        self.size += len(raw)
        return [at, len(raw)]


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file's bytes for ``ids`` (unsigned integers) of consecutive documents."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    bits = max(1, int(ids.max(initial=0)).bit_length())
    parts, planes, cur = _Parts(), [], ids
    for b in reversed(range(bits)):
        if b == 7:
            cur = cur.astype(np.uint8)
        bit = (cur & cur.dtype.type(1 << b)).astype(bool)
        ones = int(np.count_nonzero(bit))
        packed = np.packbits(bit, bitorder="little")
        samples = np.zeros(len(packed) // STEP + 1, dtype=np.uint32)
        whole = packed[: len(packed) // STEP * STEP].reshape(-1, STEP)
        np.cumsum(np.bitwise_count(whole).sum(axis=1, dtype=np.uint32), out=samples[1:])
        blocks = []
        for i in range(0, len(packed), BLOCK):
            raw = packed[i : i + BLOCK].tobytes()
            small = press.compress(raw) if b >= bits - 6 else raw  # low planes are as good as random
            blocks.append([*parts.add(small), 1] if len(small) < len(raw) else [*parts.add(raw), 0])
        planes.append({"zeros": len(cur) - ones, "blocks": blocks, "ranks": parts.add(press.compress(samples.tobytes()))})
        if b:
            cur = np.concatenate([cur.compress(~bit), cur.compress(bit)])
    known = np.array([d is not None for d in doc_ids], dtype=bool)
    table = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    docs = parts.add(press.compress(np.diff(table, prepend=0).astype("<i8").tobytes() + np.array(lengths, dtype="<i8").tobytes() + np.packbits(known).tobytes()))
    head = json.dumps({"n": len(ids), "bits": bits, "planes": planes, "docs": docs, "n_docs": len(doc_ids)}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(parts.out)


class WaveletMatrix:
    """Reads one shard's file; ``source`` is a seekable binary reader or the file's bytes."""

    def __init__(self, source):
        self.f = io.BytesIO(source) if isinstance(source, (bytes, memoryview)) else source
        head = self.f.read(8)
        if head[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        (size,) = struct.unpack("<I", head[4:])
        self.head = json.loads(self.f.read(size))
        self.base, self.n, self.bits = 8 + size, self.head["n"], self.head["bits"]
        self._blocks: dict[tuple[int, int], bytes] = {}
        self._ranks: dict[int, np.ndarray] = {}

    def _read(self, at: int, size: int, packed: bool) -> bytes:
        import zstandard

        self.f.seek(self.base + at)
        raw = self.f.read(size)
        return zstandard.ZstdDecompressor().decompress(raw) if packed else raw

    def _block(self, level: int, i: int) -> bytes:
        if (level, i) not in self._blocks:
            if len(self._blocks) >= 256:
                self._blocks.pop(next(iter(self._blocks)))
            at, size, packed = self.head["planes"][level]["blocks"][i]
            self._blocks[level, i] = self._read(at, size, bool(packed))
        return self._blocks[level, i]

    def _bit(self, level: int, i: int) -> int:
        return self._block(level, i >> 19)[(i >> 3) % BLOCK] >> (i & 7) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if level not in self._ranks:
            self._ranks[level] = np.frombuffer(self._read(*self.head["planes"][level]["ranks"], True), dtype=np.uint32)
        step = (i >> 3) // STEP
        got = int(self._ranks[level][step])
        if i & (8 * STEP - 1):
            lo = step * STEP
            part = self._block(level, lo // BLOCK)[lo % BLOCK : lo % BLOCK + STEP]
            got += (int.from_bytes(part, "little") & (1 << (i - 8 * lo)) - 1).bit_count()
        return got

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        v = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._ones(level, i)
            i = self.head["planes"][level]["zeros"] + ones if bit else i - ones
            v = v << 1 | bit
        return v

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        """Where the occurrences of a symbol among the first i ids lie after the last plane."""
        lo, hi = 0, max(0, min(i, self.n))
        if symbol < 0 or symbol >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if symbol >> (self.bits - 1 - level) & 1:
                zeros = self.head["planes"][level]["zeros"]
                lo, hi = zeros + a, zeros + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of a symbol among the first i ids."""
        lo, hi = self._range(symbol, i)
        return hi - lo

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, k: int) -> int:
        """The position of occurrence k (from 0)."""
        lo, hi = self._range(symbol, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in reversed(range(self.bits)):
            bit = symbol >> (self.bits - 1 - level) & 1
            want = i - self.head["planes"][level]["zeros"] if bit else i
            a, b = 0, self.n  # the least prefix with more than ``want`` of this bit
            while a < b:
                m = (a + b) // 2
                ones = self._ones(level, m + 1)
                a, b = (a, m) if (ones if bit else m + 1 - ones) > want else (m + 1, b)
            i = a
        return i

    def positions(self, symbol: int):
        """All positions of a symbol, ascending."""
        return (self.select(symbol, k) for k in range(self.count(symbol)))

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """The doc_id and the length of each document."""
        raw, n = self._read(*self.head["docs"], True), self.head["n_docs"]
        ids = np.cumsum(np.frombuffer(raw, dtype="<i8", count=n))
        known = np.unpackbits(np.frombuffer(raw, dtype=np.uint8, offset=16 * n))[:n].astype(bool)
        return [i if k else None for i, k in zip(ids.tolist(), known.tolist())], np.frombuffer(raw, dtype="<i8", count=n, offset=8 * n)

    def decode(self) -> np.ndarray:
        """All ids in order, planes undone from the last to the first."""
        cur = np.zeros(self.n, dtype=np.uint8)
        for b in range(self.bits):
            level = self.bits - 1 - b
            if b == 8:
                cur = cur.astype(np.uint16 if self.bits <= 16 else np.uint32)
            plane = self.head["planes"][level]
            raw = b"".join(self._read(at, size, bool(packed)) for at, size, packed in plane["blocks"])
            bit = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=self.n, bitorder="little").view(bool)
            out, zeros = np.empty_like(cur), plane["zeros"]
            out[np.flatnonzero(~bit)] = cur[:zeros]
            out[np.flatnonzero(bit)] = cur[zeros:] | cur.dtype.type(1 << b)
            cur = out
        return cur


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 0, rows_per_shard: int = 4096, tokens_per_file: int = 1 << 21, added_tokens: bool = False) -> DataFrame:
    """Writes the files and returns their manifest. ``tokens_per_file`` bounds a task's memory: a shard with more gets more files.

    ``added_tokens``: strings of added tokens in a text become those tokens.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "wavelet")
    cut = ranges_of(docs, "doc_id", rows_per_shard)
    rows = cut.number(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id", "shard")
    placed = rows.repartitionById(len(cut), F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("doc_id"))

    def write(batches_in):
        enc = encoder(tokenizer)
        held, ids, lengths, shard, part, size = [], [], [], None, 0, 0

        def flush():
            nonlocal held, ids, lengths, part, size
            flat = np.concatenate(ids)
            path = f"{folder}/{shard:08d}-{part:04d}-{uuid.uuid4().hex}.twm"  # a retried task writes other files; only the manifest counts
            put_file(path, build(flat, held, lengths))
            row = pa.RecordBatch.from_pydict({"shard": [shard], "part": pa.array([part], pa.int32()), "path": [path], "docs": [len(held)], "tokens": [len(flat)]})
            held, ids, lengths, part, size = [], [], [], part + 1, 0
            return row

        for batch in batches_in:
            at = 0
            for texts in batches(batch.column("text")):
                flat, stops = enc.encode(texts, added_tokens)
                starts = np.concatenate([[0], stops[:-1]])
                for j in range(len(texts)):
                    s = batch.column("shard")[at + j].as_py()
                    if s != shard:
                        if held:
                            yield flush()
                        shard, part = s, 0
                    held.append(batch.column("doc_id")[at + j].as_py())
                    ids += [flat[starts[j] : stops[j]], np.array([end_id], dtype=flat.dtype)]
                    lengths.append(int(stops[j] - starts[j]) + 1)
                    size += lengths[-1]
                    if size >= tokens_per_file:
                        yield flush()
                at += len(texts)
        if held:
            yield flush()
        release()

    return written(placed.mapInArrow(write, MANIFEST), "wavelet-manifest")


def with_starts(manifest: DataFrame, block: int = 1024) -> DataFrame:
    """Adds the ids of all files before each one: sums by blocks of shards, then within a block."""
    parts = manifest.withColumn("block", F.floor(F.col("shard") / block))
    sums = parts.groupBy("block").agg(F.sum("tokens").alias("t"))
    before = sums.select("block", (F.sum("t").over(Window.orderBy("block")) - F.col("t")).alias("base"))
    here = Window.partitionBy("block").orderBy("shard", "part")
    return parts.join(before, "block").withColumn("file_start", F.col("base") + F.sum("tokens").over(here) - F.col("tokens")).drop("block", "base")


def read_documents(manifest: DataFrame) -> DataFrame:
    """Every document of every file: its place in the file and its ids as little-endian unsigned 32-bit integers."""

    def read(batches_in):
        for batch in batches_in:
            for row in batch.to_pylist():
                with open_file(row["path"]) as f:
                    matrix = WaveletMatrix(f)
                    ids, (doc_ids, lengths) = matrix.decode(), matrix.documents()
                ends = np.cumsum(lengths)
                for i in range(0, len(doc_ids), 256):
                    some = slice(i, i + 256)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "shard": [row["shard"]] * len(doc_ids[some]),
                            "part": pa.array([row["part"]] * len(doc_ids[some]), pa.int32()),
                            "doc_id": pa.array(doc_ids[some], pa.int64()),
                            "local_start": (ends - lengths)[some],
                            "n_tokens": lengths[some],
                            "ids": pa.array([ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends[some], lengths[some])], pa.binary()),
                        }
                    )

    spark = manifest.sparkSession
    n = max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism + manifest.count() // 8))
    return manifest.select("shard", "part", "path").repartition(n, "path").mapInArrow(read, TOKENS)


def document_index(manifest: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, global start, length with the end id, checksum."""

    def read(batches_in):
        release(caches=True)
        for batch in batches_in:
            for row in batch.to_pylist():
                with open_file(row["path"]) as f:
                    matrix = WaveletMatrix(f)
                    ids, (doc_ids, lengths) = matrix.decode(), matrix.documents()
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(ids[e - n : e].astype("<u4")) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": ends - lengths + row["file_start"], "n_tokens": lengths, "ids_crc32": pa.array(sums, pa.int64())})

    files = manifest.count()
    placed = with_starts(manifest).select("path", "file_start").repartition(max(1, min(files, 100_000)), "path")  # else the few rows meet in one task
    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
