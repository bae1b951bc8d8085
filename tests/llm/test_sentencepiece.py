import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tonearm.llm.sentencepiece import PieceModel, decoded, encoded, round_trips

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  ", "a  b", "   x   y  ", "hello world", "日本語 ☃ 𝒳", "\n\n x\t\ty", " ▁ a▁b", "é", " " * 37 + "a" + " " * 20, "  " * 500 + "q", "Ünïcode ñandú!!", "<s> </s> <0x41>", "İx́", "word " * 3000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_same_ids_as_the_library(library):
    model = PieceModel.load(PATH)
    rng = random.Random(1)
    alphabet = "abcdefgh  éß\n.,-0129日"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)]
    flat, stops = model.encode(texts)
    got = [x.tolist() for x in np.split(flat, stops[:-1])]
    assert got == [library.encode(t) for t in texts]
    assert [model.decode(x) for x in got] == [t.replace("▁", " ") for t in texts]


def test_viterbi_against_all_splits():
    pieces = [("<unk>", 0.0), ("a", -2.0), ("b", -2.1), ("ab", -2.5), ("ba", -2.2), ("aba", -4.5), ("▁", -1.0), ("▁a", -1.9), ("bb", -9.0)]
    model = PieceModel(pieces, {0}, {}, 0, merges=False)
    score = dict(pieces)
    for n in range(1, 7):
        for word in itertools.product("ab", repeat=n):
            s = "▁" + "".join(word)
            best = max(sum(score[p] for p in parts) for parts in _splits(s, score))
            assert abs(sum(pieces[i][1] for i in model.split(s)) - best) < 1e-9
    assert model.split("▁zz") == [6, 0, 0]


def _as_unigram(path):
    """The library with the same pieces and scores, told that the model is a unigram one.

    Its lattice (``nbest_encode``) finds the greatest total; its quicker ``encode`` misses it where scores are ranks.
    """
    raw, at = bytearray(open(path, "rb").read()), 0

    def number(at):
        n = shift = 0
        while True:
            n |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return n, at

    def skip(kind, at):
        if kind == 2:
            size, at = number(at)
            return at + size
        return number(at)[1] if kind == 0 else at + (4 if kind == 5 else 8)

    while at < len(raw):
        key, at = number(at)
        if key >> 3 == 2:  # how the model was trained
            size, at = number(at)
            end = at + size
            while at < end:
                key, at = number(at)
                if key == 3 << 3:  # its type: 1 unigram, 2 BPE
                    raw[at] = 1
                at = skip(key & 7, at)
        else:
            at = skip(key & 7, at)
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(raw))


def test_viterbi_gives_the_ids_of_the_library_as_unigram(spark):
    library, model = _as_unigram(PATH), PieceModel.load(PATH, viterbi=True)
    rng = random.Random(2)
    texts = [t[:60] for t in TEXTS] + ["".join(rng.choice("abcdefgh  éß\n.,-0129日") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["the quick brown fox jumps over the lazy dog", "internationalisation of the unbelievable"]
    flat, stops = model.encode(texts)
    got = [x.tolist() for x in np.split(flat, stops[:-1])]
    want = [library.nbest_encode(t, nbest_size=2)[0] for t in texts]
    own, best = ([sum(model.score[i] for i in x) for x in y] for y in (got, want))
    assert all(b <= a <= b + 1e-6 * abs(b) for a, b in zip(own, best))  # the library adds in single precision
    assert sum(a == b for a, b in zip(got, want)) > 0.9 * len(texts)  # others: equal totals
    assert got != [PieceModel.load(PATH).encode([t])[0].tolist() for t in texts]
    assert [model.decode(x) for x in got] == [t.replace("▁", " ") for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trips = {r.doc_id: (r.best_n_ids, r.best_ids_crc32) for r in round_trips(docs, PATH).collect()}
    assert trips == {i: (len(x), zlib.crc32(np.array(x, dtype="<u4"))) for i, x in enumerate(got)}
    kept = {r.doc_id: np.frombuffer(r.ids, dtype="<u4").tolist() for r in encoded(docs, PATH, viterbi=True).collect()}
    assert kept == dict(enumerate(got))


def _splits(s, known):
    if not s:
        yield []
    for i in range(1, len(s) + 1):
        if s[:i] in known:
            for rest in _splits(s[i:], known):
                yield [s[:i], *rest]


def test_tables(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(50, None, 1), (None, "x", 1), (1, " ", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    back = sorted(((r.doc_id, r.text) for r in decoded(encoded(docs, PATH), PATH).collect()), key=str)
    assert back == sorted(((d, (t or "").replace("▁", " ")) for d, t, _ in rows), key=str)
    trips = round_trips(docs, PATH).collect()
    assert len(trips) == len(rows) and [r.doc_id for r in trips if not r.round_trip] == [8]
    assert round_trips(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
