"""Spans that agree in all sums of powers keep apart: in encoders, shingles, fingerprints and links."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tonearm.llm import queries
from tonearm.llm._bpe import ChunkEncoder, encoder, hashed_spans
from tonearm.llm._shingles import shingles


def _thue_morse(power):
    word = "a"
    for _ in range(power):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


PAIRS = [_thue_morse(k) for k in range(10, 15)]
PLACES = [lambda w: w, lambda w: f"one two {w} three four five six", lambda w: " ".join(["x", w, w, "y", w, "z"]), lambda w: " ".join(w)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("place", PLACES)
def test_encoders(name, place):
    lib = Tokenizer.from_file(public_tokenizers.path(name))
    texts = [place(w) for pair in PAIRS for w in pair]
    flat, stops = encoder(public_tokenizers.path(name)).encode(texts)
    assert [x.tolist() for x in np.split(flat, stops[:-1])] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces():
    import sentencepiece

    from tonearm.llm.sentencepiece import PieceModel

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, texts = sentencepiece.SentencePieceProcessor(model_file=path), [w for pair in PAIRS[:2] for w in pair]
    flat, stops = PieceModel.load(path).encode(texts)
    assert [x.tolist() for x in np.split(flat, stops[:-1])] == [lib.encode(t) for t in texts]


def test_ids_don_t_rest_on_the_hash():
    """Even with a hash of four values the cache gives the library's ids."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    bad = ChunkEncoder(path)
    bad.hashed = lambda data, starts, lens: hashed_spans(data, starts, lens) & np.uint64(3)
    texts = ["one two three, four. five one two", "six two one", "", "one\n\nseven Two", "a b c d e f g h"] * 3
    for part in (texts, texts[::-1]):
        flat, stops = bad.encode(part)
        assert [x.tolist() for x in np.split(flat, stops[:-1])] == [bad.lib.encode(t, add_special_tokens=False).ids for t in part]


@pytest.mark.parametrize("place", PLACES[:3])  # as words of one letter the two have the same factors, so equal sets
def test_shingles(place):
    for a, b in PAIRS:
        x, y = shingles([place(a), place(b)])
        assert x.tolist() != y.tolist()


def test_queries_on_a_table(spark, tmp_path):
    tm, co = PAIRS[0]
    spark.createDataFrame([(1, tm), (2, co), (3, "x y z")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: {r.doc_id: r for r in queries.queries()[name](spark, str(tmp_path)).collect()}
    for name, vocabulary, end in (("op2_wavelet_tokens", "byte_bpe_50k.json", 0), ("op3_best_fit_packing", "word_bpe_49k.json", 1)):
        lib, got = Tokenizer.from_file(public_tokenizers.path(vocabulary)), run(name)
        for doc, text in ((1, tm), (2, co), (3, "x y z")):
            assert got[doc].ids_crc32 == zlib.crc32(np.array(lib.encode(text, add_special_tokens=False).ids + [end], "<u4").tobytes())
    prints = run("op6_bottom_k_fingerprints")
    assert prints[1].fingerprint != prints[2].fingerprint and prints[1].near_next == 0.0
    assert [run("op7_ngram_jaccard_join")[d].component_id for d in (1, 2, 3)] == [1, 2, 3]
    assert run("op9_aho_corasick_pieces")[2].round_trip

