"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

One pass over a text: at every position the automaton's output links give the pieces that end there,
longest first, and each relaxes the best split of the text up to that position.

* Unigram models: the split of greatest total score (Viterbi).
* BPE models: the greatest sum of scores is not what merging gives.  There a piece may end a prefix
  only if it and the last piece of what comes before stay apart when merged together; exactly one
  piece passes at each position, so the same single pass gives the ids that merging gives.

Characters outside the vocabulary become byte pieces (or the unknown piece).  Texts are cut between
bytes that adjoin in no piece, and the parts are cached, as their splits don't depend on each other.
Where merging decides, runs of spaces are merged directly: their pieces share one score.

``viterbi=True`` gives the split of greatest total score under any model, also of pieces made by merging.  The
registered query returns both over the whole table: the library's own ids, and counts and checksums of the best split.

Null text: empty, no ids.  Rows with equal or null doc_id are encoded each on its own.  Texts of any length are
taken whole.  Of pieces with equal best totals the longest wins.  An empty table gives no rows.  Columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import ChunkCache, batches, text_bytes

SPACE = "▁"
PAIRS = 1 << 20
_MODELS: dict[tuple[str, bool], "PieceModel"] = {}


class PieceModel(ChunkCache):
    """``pieces``: text and score by id; ``special``: ids that never match text; ``byte_ids``: id of each byte, if any."""

    def __init__(self, pieces: list[tuple[str, float]], special: set[int], byte_ids: dict[int, int], unknown: int, merges: bool, normalise=None):
        super().__init__(np.uint16 if len(pieces) <= 1 << 16 else np.uint32)
        import ahocorasick

        self.pieces, self.byte_ids, self.unknown, self.merges = pieces, byte_ids, unknown, merges
        self.normalise = normalise or (lambda t: SPACE + t.replace(" ", SPACE) if t else "")
        self.ids = {p: i for i, (p, _) in enumerate(pieces) if i not in special and i not in byte_ids.values() and p}
        self.score = [s for _, s in pieces]
        self.apart: dict[tuple[int, int], bool] = {}
        inside = np.zeros((256, 256), dtype=bool)  # adjoining bytes within some piece, a space for the space sign
        for p in self.ids:
            raw = np.frombuffer(p.replace(SPACE, " ").encode(), dtype=np.uint8)
            inside[raw[:-1], raw[1:]] = True
        inside[:, 0x80:0xC0] = True  # never within a character
        self.cut = ~inside
        self.alphabet = {p for p in self.ids if len(p) == 1}
        self.lost = min(self.score) - 10.0
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if not merges or self.merged(p) == [i]:
                self.automaton.add_word(p, (len(p), i))
        if self.ids:
            self.automaton.make_automaton()

    @classmethod
    def load(cls, path: str, viterbi: bool = False) -> "PieceModel":
        """One model for each Python worker, file and way; ``viterbi``: greatest total score also where the file says BPE."""
        if (path, viterbi) not in _MODELS:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            n = sp.get_piece_size()
            special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
            byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
            probe = "  a  ﬁ Ａ \n x "
            plain = sp.normalize(probe) == SPACE + probe.replace(" ", SPACE)
            pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(n)]
            ranks = [s for i, (_, s) in enumerate(pieces) if i not in special and i not in byte_ids.values()]
            merges = not viterbi and all(s == int(s) for s in ranks)  # BPE models number their merges; unigram scores are log-probabilities
            _MODELS[path, viterbi] = cls(pieces, special, byte_ids, sp.unk_id(), merges, None if plain else sp.normalize)
        return _MODELS[path, viterbi]

    def merged(self, text: str) -> list[int]:
        """BPE by the definition: join the adjacent pair of greatest score, the leftmost of equals, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out: list[int] = []
        for p in parts:
            out += [self.ids[p]] if p in self.ids else self._bytes(p)
        return out

    def _bytes(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]

    def _stay_apart(self, a: int, b: int) -> bool:
        got = self.apart.get((a, b))
        if got is None:
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            got = self.apart[a, b] = self.merged(self.pieces[a][0] + self.pieces[b][0]) == [a, b]
        return got

    def _known_run(self, s: str) -> list[int]:
        """Ids of a text all of whose characters are pieces (BPE)."""
        last, start = [-1] * (len(s) + 1), [0] * (len(s) + 1)
        for end, (size, i) in self.automaton.iter(s):
            at = end + 1 - size
            if last[end + 1] < 0 and (at == 0 or last[at] >= 0 and self._stay_apart(last[at], i)):
                last[end + 1], start[end + 1] = i, at
        out, at = [], len(s)
        while at:
            if last[at] < 0:
                return self.merged(s)
            out.append(last[at])
            at = start[at]
        return out[::-1]

    def split(self, s: str) -> list[int]:
        """Ids of a normalised text or word."""
        if self.merges:
            if SPACE * 2 in s:
                return self.merged(s) if len(s) <= 400 else self._long(s)
            out, at = [], 0
            for i, c in enumerate(s):
                if c not in self.alphabet:
                    out += (self._known_run(s[at:i]) if i > at else []) + self._bytes(c)
                    at = i + 1
            return out + (self._known_run(s[at:]) if at < len(s) else [])
        best: list[float] = [0.0] + [-np.inf] * len(s)
        last, start, done = [-1] * (len(s) + 1), [0] * (len(s) + 1), 0
        steps = list(self.automaton.iter(s)) if self.ids else []
        for end in range(len(s)):
            while done < len(steps) and steps[done][0] == end:
                size, i = steps[done][1]
                got = best[end + 1 - size] + self.score[i]
                if got > best[end + 1]:
                    best[end + 1], last[end + 1], start[end + 1] = got, i, end + 1 - size
                done += 1
            if s[end] not in self.alphabet and best[end] + self.lost > best[end + 1]:
                best[end + 1], last[end + 1], start[end + 1] = best[end] + self.lost, -1, end
        out, at = [], len(s)
        while at:
            out.append([last[at]] if last[at] >= 0 else self._bytes(s[start[at] : at]))
            at = start[at]
        return [i for part in out[::-1] for i in part]

    def _long(self, s: str) -> list[int]:
        """Merging with a heap, for long runs of spaces."""
        import heapq

        nxt, prv, part = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1)), list(s)
        heap: list[tuple[float, int, str]] = []

        def offer(i):
            if 0 <= i and nxt[i] < len(s):
                both = part[i] + part[nxt[i]]
                if both in self.ids:
                    heapq.heappush(heap, (-self.score[self.ids[both]], i, both))

        for i in range(len(s) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = nxt[i] if part[i] else len(s)
            if j >= len(s) or part[i] + part[j] != both:
                continue
            part[i], part[j], nxt[i] = both, "", nxt[j]
            if nxt[j] < len(s):
                prv[nxt[j]] = i
            offer(prv[i])
            offer(i)
        return [k for p in part if p for k in ([self.ids[p]] if p in self.ids else self._bytes(p))]

    def _heads(self, data: np.ndarray, head: np.ndarray) -> None:
        head[1:] = self.cut[data[:-1], data[1:]]

    def _learn(self, data, starts, lens):
        ids = [self.split(data[a:b].tobytes().decode().replace(" ", SPACE)) for a, b in zip(starts.tolist(), (starts + lens).tolist())]
        return np.array([i for x in ids for i in x], dtype=self.dtype), np.array([len(x) for x in ids], dtype=np.int64), np.arange(len(ids))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts as one array, and where each text's end."""
        return self.encode_bytes(*text_bytes([self.normalise(t).replace(SPACE, " ") for t in texts]))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces and bytes joined, the first space of the normaliser left out."""
        if not hasattr(self, "_raw"):
            self._raw = [b""] * len(self.pieces)
            for p, i in self.ids.items():
                self._raw[i] = p.replace(SPACE, " ").encode()
            for b, i in self.byte_ids.items():
                self._raw[i] = bytes([b])
            self._raw[self.unknown] = " \u2047 ".encode()
        text = b"".join(map(self._raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


ENCODED = "doc_id long, n_ids long, ids binary"


def encoded(docs: DataFrame, model: str, viterbi: bool = False) -> DataFrame:
    """doc_id, n_ids and ids (little-endian unsigned 32-bit integers) of every whole text."""

    def run(batches_in):
        m = PieceModel.load(model, viterbi)
        for batch in batches_in:
            at = 0
            for texts in batches(batch.column("text")):
                flat, stops = m.encode(texts)
                parts = [x.astype("<u4").tobytes() for x in np.split(flat, stops[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(np.diff(stops, prepend=0)), pa.array(parts, pa.binary())], names=["doc_id", "n_ids", "ids"])
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ENCODED)


def decoded(ids: DataFrame, model: str) -> DataFrame:
    """doc_id and text of encoded rows."""

    def run(batches_in):
        m = PieceModel.load(model)
        for batch in batches_in:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [m.decode(np.frombuffer(x, dtype="<u4").tolist()) if x is not None else None for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256 and whether decoding gives the text back, in one pass over the texts.

    best_n_ids, best_ids_crc32: the same of the split of greatest total score.
    """

    def run(batches_in):
        m, best = PieceModel.load(model), PieceModel.load(model, viterbi=True)
        for batch in batches_in:
            at = 0
            for texts in batches(batch.column("text")):
                flat, stops = m.encode(texts)
                parts = np.split(flat, stops[:-1])
                flat, best_stops = best.encode(texts)
                best_parts = np.split(flat, best_stops[:-1])
                back = [m.decode(x.tolist()) for x in parts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(texts)),
                        pa.array(np.diff(stops, prepend=0)),
                        pa.array([zlib.crc32(x.astype("<u4")) for x in parts], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                        pa.array([a == b for a, b in zip(texts, back)], pa.bool_()),
                        pa.array(np.diff(best_stops, prepend=0)),
                        pa.array([zlib.crc32(x.astype("<u4")) for x in best_parts], pa.int64()),
                    ],
                    names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip", "best_n_ids", "best_ids_crc32"],
                )
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean, best_n_ids long, best_ids_crc32 long")
