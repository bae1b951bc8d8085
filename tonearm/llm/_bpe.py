"""The tokenizers library behind a vectorised cache of word chunks.

The public vocabularies here split a text before any white space that follows something else, so a
text's ids are the ids of its chunks (white space, then what is not) laid end to end; a stop after
an ASCII letter starts a chunk too.  Chunks repeat
far more often than texts do.  A batch of texts is cut into chunks and hashed in numpy; the library
encodes each chunk that the cache lacks, many in one call; ids are then gathered from a flat pool.
The cache keeps the bytes of its chunks: each use is compared with them, so no hash decides what ids a chunk has.
Texts with white space beyond space, tab and line ends go to the library whole.

The string of an added token (``<|endoftext|>``) in a text is ordinary characters, or with ``added_tokens``
that token, as in the library's plain call; texts that hold one then go to the library whole too.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re

import numpy as np
import pyarrow as pa

CACHE_CHUNKS, CACHE_BYTES = 800_000, 1 << 27
TABLE, PROBES = 1 << 21, 24  # places in the hash table, and steps of a search
JOINT = 64  # chunks in one string
_ODD, _RARE = re.compile(r"[^\S \n\r\t]"), "\x0b\x0c\x1c\x1d\x1e\x1f"
_WS = np.zeros(256, dtype=bool)
_WS[[9, 10, 13, 32]] = True
_STOP, _LETTER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_STOP[list(b".,!?;:")] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_M1, _M2, _R = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), 0x9E3779B97F4A7C15
_S33 = np.uint64(33)
_ENCODERS: dict[tuple[str, str], "ChunkEncoder"] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _S33)
    h *= _M1
    h ^= h >> _S33
    h *= _M2
    h ^= h >> _S33
    return h


class Powers:
    """Powers of an odd constant modulo 2**64, as many as the longest item so far needs."""

    def __init__(self, base: int = _R):
        self.base, self.table = base, np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            step = np.uint64(pow(self.base, len(self.table), 1 << 64))
            self.table = np.concatenate([self.table, self.table * step])
        return self.table


_POWERS = Powers()


def _placed(at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Each byte mixed with its place."""
    return mixed(_POWERS.upto(int(at.max()) + 1 if len(at) else 0)[at] * (data.astype(np.uint64) + np.uint64(1)))


NEAR = 16  # places whose mixed bytes are looked up
_NEAR = _placed(np.repeat(np.arange(NEAR), 256), np.tile(np.arange(256), NEAR))


def hashed_spans(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the adjoining, non-empty byte spans that cover ``data``.

    Every byte is mixed with its place before the sum, so the hash is no polynomial: texts that agree in
    all sums of powers (Thue-Morse words and their exchanges) part like any others.
    """
    at = places(starts, lens, len(data))
    far = np.flatnonzero(at >= NEAR)
    near = np.minimum(at, NEAR - 1)
    near <<= 8
    near |= data
    h = _NEAR[near]
    if len(far):
        h[far] = _placed(at[far], data[far])
    return mixed(np.add.reduceat(h, starts) + lens.astype(np.uint64))


def places(starts: np.ndarray, lens: np.ndarray, n: int, base: np.ndarray | None = None) -> np.ndarray:
    """For each byte of adjoining spans its place in its span, plus the span's ``base``."""
    narrow = np.int32 if n < 1 << 30 else np.int64
    at = np.arange(n, dtype=narrow)
    at -= np.repeat((starts if base is None else starts - base).astype(narrow), lens)
    return at


def release(caches: bool = False) -> None:
    """Gives freed memory back to the system, and with ``caches`` the encoders' too: workers outlive their tasks."""
    if caches:
        _ENCODERS.clear()
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class ChunkCache:
    """Ids of chunks, learnt once while they stay in the cache; subclasses cut texts and encode chunks."""

    hashed = staticmethod(hashed_spans)

    def __init__(self, dtype):
        self.dtype = dtype
        self._clear()

    def _clear(self) -> None:
        self.keys, self.slots, self.used = np.zeros(TABLE, dtype=np.uint64), np.zeros(TABLE, dtype=np.int32), 0
        self.pool, self.pool_n = np.zeros(1 << 20, dtype=self.dtype), 0
        self.first, self.many = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 16, dtype=np.int32)
        self.raw, self.raw_n, self.at = np.zeros(1 << 20, dtype=np.uint8), 0, np.zeros(1 << 16, dtype=np.int64)
        self.size = np.zeros(1 << 16, dtype=np.int64)

    def _found(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key in the open-addressed table, or -1."""
        out, left, at = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), (keys & np.uint64(TABLE - 1)).astype(np.int64)
        for _ in range(PROBES):
            here = self.keys[at]
            hit = here == keys[left]
            out[left[hit]] = self.slots[at[hit]]
            on = ~hit & (here != 0)
            if not on.any():
                break
            left, at = left[on], (at[on] + 1) & (TABLE - 1)
        return out

    def _enter(self, keys: np.ndarray, slots: np.ndarray) -> None:
        """Adds distinct keys; one that finds no place within PROBES is learnt again when it comes again."""
        at = (keys & np.uint64(TABLE - 1)).astype(np.int64)
        for _ in range(PROBES):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]
            mine = free & (self.keys[at] == keys)  # of keys after one place, the last one got it
            self.slots[at[mine]] = slots[mine]
            if mine.all():
                break
            keys, slots, at = keys[~mine], slots[~mine], (at[~mine] + 1) & (TABLE - 1)
            if not len(keys):
                break

    def _heads(self, data: np.ndarray, head: np.ndarray) -> None:
        """Marks where chunks start, beside the first byte of every text."""
        raise NotImplementedError

    def _learn(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of chunks end to end, how many each has, and the order in which they come."""
        raise NotImplementedError

    def _kept(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """New slots for chunks, with their bytes and ids."""
        ids, many, order = self._learn(data, starts, lens)
        n, k, size = self.used, len(starts), int(lens.sum())
        while self.pool_n + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.raw_n + size > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros_like(self.raw)])
        while n + k > len(self.first):
            self.first, self.many, self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.many, self.at, self.size))
        self.pool[self.pool_n : self.pool_n + len(ids)] = ids
        self.many[n : n + k] = many
        self.first[n : n + k] = self.pool_n + np.cumsum(many) - many
        slot = np.empty(k, dtype=np.int64)
        slot[order] = np.arange(n, n + k)
        ends = np.cumsum(lens)
        self.raw[self.raw_n : self.raw_n + size] = data[np.repeat(starts - (ends - lens), lens) + np.arange(size)]
        self.at[slot], self.size[slot] = self.raw_n + ends - lens, lens
        self.pool_n += len(ids)
        self.raw_n += size
        self.used += k
        return slot

    def _slots(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The cache slot of each of the adjoining chunks of ``data``, whose hash is its key."""
        if self.used > CACHE_CHUNKS or self.raw_n > CACHE_BYTES:
            self._clear()
        got = self._found(keys)
        lost = np.flatnonzero(got < 0)
        if len(lost):
            new, where, back = np.unique(keys[lost], return_index=True, return_inverse=True)
            slot = self._kept(data, starts[lost[where]], lens[lost[where]])
            self._enter(new, slot)
            got[lost] = slot[back]
        wrong = self.size[got] != lens
        at = places(starts, lens, len(data), self.at[got])
        if wrong.any():  # a shorter kept chunk: its bytes may end before
            at = np.minimum(at, self.raw_n - 1)
        same = self.raw[at] == data
        if wrong.any() or not same.all():  # another chunk of equal hash: this one gets a slot of its own for once
            wrong |= ~np.logical_and.reduceat(same, starts)
            at = np.flatnonzero(wrong)
            got[at] = self._kept(data, starts[at], lens[at])
        return got

    def encode_bytes(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of adjoining UTF-8 texts as one array, and where each text's ids end."""
        if not len(data):
            return np.zeros(0, dtype=self.dtype), np.zeros(len(ends) - 1, dtype=np.int64)
        head = np.zeros(len(data), dtype=bool)
        self._heads(data, head)
        head[ends[:-1][np.diff(ends) > 0]] = True
        starts = np.flatnonzero(head)
        lens = np.diff(starts, append=len(data))
        keys = np.maximum(self.hashed(data, starts, lens), np.uint64(1))  # 0 marks a free place
        slots = self._slots(keys, data, starts, lens)
        many = self.many[slots].astype(np.int64)
        total = np.cumsum(many)
        flat = self.pool[np.repeat(self.first[slots] - (total - many), many) + np.arange(total[-1])]
        return flat, np.concatenate([[0], total])[np.searchsorted(starts, ends[1:])]


def text_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end in UTF-8, and where each one ends (from 0)."""
    arr = pa.array(texts, pa.large_string())
    ends = np.frombuffer(arr.buffers()[1], dtype=np.int64, count=len(texts) + 1)
    return (np.frombuffer(arr.buffers()[2], dtype=np.uint8, count=int(ends[-1])) if ends[-1] else np.zeros(0, dtype=np.uint8)), ends


def encoder(path: str) -> "ChunkEncoder":
    """One encoder for each Python worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


class ChunkEncoder(ChunkCache):
    """``encode(texts)``: ids of all texts as one uint16 array (uint32 for larger vocabularies), and where each text ends."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.lib.model._resize_cache(0)
        added = self.lib.get_added_tokens_decoder().values()
        self.added = [""] if any(a.normalized for a in added) else [a.content for a in added]  # normalised ones may show in any text
        vocab = self.lib.get_vocab()
        self.leads = not self.lib.model.end_of_word_suffix  # byte-level: a space shows as U+0120
        self.plain = self.lib
        if not self.leads:  # for lower-case words of letters: the same model without normaliser and word pattern
            self.plain = Tokenizer.from_file(path)
            self.plain.model._resize_cache(0)
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.edge = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.edge[[i for w, i in vocab.items() if (w[0] in "\u0120\u010a\u0109\u010d" if self.leads else w.endswith("</w>"))]] = True
        super().__init__(np.uint16 if self.lib.get_vocab_size() <= 1 << 16 else np.uint32)

    def _heads(self, data: np.ndarray, head: np.ndarray) -> None:
        ws = _WS[data]
        head[1:] = ws[1:] > ws[:-1]
        head[1:] |= _STOP[data[1:]] & _LETTER[data[:-1]]

    def _alone(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._ids(self.lib, chunks)

    def _ids(self, lib, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts end to end and how many each has; few at a time, as the library's records are large."""
        flat, many = [np.zeros(0, dtype=self.dtype)], []
        for i in range(0, len(texts), 256):
            ids = [e.ids for e in lib.encode_batch_fast(texts[i : i + 256], add_special_tokens=False)]
            flat.append(np.array([k for x in ids for k in x], dtype=self.dtype))
            many += map(len, ids)
        return np.concatenate(flat), np.array(many, dtype=np.int64)

    def _joint(self, data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adjoining chunks of which the ids show where one ends: by its first id (byte-level) or its last (word ends)."""
        raw, cut = data.tobytes(), np.append(0, np.cumsum(lens))
        ends = cut[np.minimum(np.arange(0, len(lens) + JOINT, JOINT), len(lens))].tolist()
        joined = [raw[x:y].decode() for x, y in zip(ends, ends[1:])]
        flat = self._ids(self.plain, joined)[0]
        at = np.flatnonzero(self.edge[flat])
        if len(at) != len(lens):
            cut = cut.tolist()
            return self._alone([raw[x:y].decode() for x, y in zip(cut, cut[1:])])
        return flat, np.diff(at, append=len(flat)) if self.leads else np.diff(at, prepend=-1)

    def _learn(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of chunks end to end, how many each has, and the order in which they come."""
        at = np.cumsum(lens) - lens
        part = data[np.repeat(starts - at, lens) + np.arange(int(lens.sum()))]
        head = _WS[part[at]] & (lens > 1)
        if self.leads:
            good = head & ~_WS[part[np.minimum(at + 1, len(part) - 1)]]
        else:  # ASCII letters and those of U+00C0-00FF only; they are lower-cased here
            after = np.append(False, part[:-1] == 0xC3)
            letter = _LETTER[part] | (part == 0xC3) | after & (part != 0x97) & (part != 0xB7)
            part = part + (32 * ((part >= 65) & (part <= 90) | after & (part <= 0x9E))).astype(np.uint8)
            part[at[head]] = 32
            letter[at] = True
            good = head & np.logical_and.reduceat(letter, at)
        mine = np.repeat(good, lens)
        a, m = self._joint(part[mine], lens[good]) if good.any() else self._alone([])
        rest = np.flatnonzero(~good)
        b, k = self._alone([data[x:y].tobytes().decode() for x, y in zip(starts[rest].tolist(), (starts + lens)[rest].tolist())])
        return np.concatenate([a, b]), np.concatenate([m, k]), np.concatenate([np.flatnonzero(good), rest])

    def _whole(self, text: str, added_tokens: bool) -> np.ndarray:
        self.lib.encode_special_tokens = not added_tokens
        try:
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype=self.dtype)
        finally:
            self.lib.encode_special_tokens = True

    def _odd(self, text: str, added_tokens: bool) -> bool:
        """Whether a text goes to the library whole."""
        spaces = any(c in text for c in _RARE) if text.isascii() else _ODD.search(text)
        return bool(spaces) or added_tokens and any(a in text for a in self.added)

    def encode(self, texts: list[str], added_tokens: bool = False) -> tuple[np.ndarray, np.ndarray]:
        odd = {i: self._whole(t, added_tokens) for i, t in enumerate(texts) if self._odd(t, added_tokens)}
        flat, stops = self.encode_bytes(*text_bytes(["" if i in odd else t for i, t in enumerate(texts)]))
        if odd:
            parts = np.split(flat, stops[:-1])
            for i, x in odd.items():
                parts[i] = x
            flat, stops = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        return flat, stops


def batches(column, rows: int = 2048, chars: int = 2_000_000):
    """Lists of texts of an Arrow column (null: empty), each of bounded size; a longer text comes alone."""
    out, size = [], 0
    for i in range(0, len(column), 256):
        for t in column.slice(i, 256).to_pylist():
            t = t or ""
            if out and (len(out) >= rows or size + len(t) > chars):
                yield out
                out, size = [], 0
            out.append(t)
            size += len(t)
    if out:
        yield out
