import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tonearm.llm.packing import OpenBins, pack, place, sequences, tokenised_pieces

WORDS = public_tokenizers.path("word_bpe_49k.json")


def _brute(lengths, capacity, limit):
    bins, out = [], []
    for n in lengths:
        fit = [b for b in bins if b[1] >= n]
        if fit:
            free = min(b[1] for b in fit)
            b = [b for b in bins if b[1] == free][-1]
        else:
            if len(bins) >= limit:
                bins.remove([b for b in bins if b[1] == min(x[1] for x in bins)][-1])
            b = [len({o[0] for o in out}), capacity]
        out.append((b[0], capacity - b[1]))
        if b in bins:
            bins.remove(b)
        b = [b[0], b[1] - n]
        if b[1]:
            bins.append(b)
    return out


def test_bins_follow_brute_force():
    rng = random.Random(3)
    for limit in (1, 4, 50):
        lengths = [rng.randint(1, 100) for _ in range(400)]
        bins = OpenBins(100, limit)
        assert [bins.put(n) for n in lengths] == _brute(lengths, 100, limit)


def test_whole_table(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("alpha beta gamma, Δelta. e!").strip() for _ in range(rng.randint(0, 300))), "x") for i in range(60)]
    rows += [(100, "hello world " * 5000, "x"), (101, None, None), (102, "", None), (None, "null", None), (1, rows[1][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    got = pack(docs, WORDS).collect()
    lib = Tokenizer.from_file(WORDS)
    want = []
    for d, t, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(d, p, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    assert len(bins) == -(-sum(r.length for r in got) // 4096)


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * i) for i in range(30)], "doc_id long, text string")
    pieces = tokenised_pieces(docs, WORDS, capacity=64)
    placed = place(pieces, 64)
    whole = {r.sequence_id: bytes(r.ids) for r in sequences(placed, pieces).collect()}
    for r in placed.collect():
        assert zlib.crc32(whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]) == r.ids_crc32


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), WORDS).count() == 0
