import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tonearm.llm._bpe import encoder
from tonearm.llm.wavelet import WaveletMatrix, build, document_index, read_documents, write_shards

TEXTS = ["", " ", "a  b\n\n c", "x\n\n", "\x1c a b  c", "it's\t'll don't ... ok?!  ", "  lead", "ÉCOLE Σας ñ  é, é.", "<|endoftext|> hi", "日本 語\r\n a", "İstanbul İ, x", "word,  next ,,, ..a", "hello. world!" * 500]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunk_encoder_is_the_library(name):
    lib = Tokenizer.from_file(public_tokenizers.path(name))
    lib.encode_special_tokens = True
    for texts in (TEXTS, TEXTS[::-1], [""], []):
        flat, stops = encoder(public_tokenizers.path(name)).encode(texts)
        got = [x.tolist() for x in np.split(flat, stops[:-1])] if texts else []
        assert got == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_rank_select_access():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 9000), 50_256).astype(np.uint16)
    m = WaveletMatrix(build(ids, [None, 5], [4000, 5000]))
    assert (m.decode() == ids).all()
    assert m.documents()[0] == [None, 5] and m.documents()[1].tolist() == [4000, 5000]
    for i in rng.integers(0, len(ids), 60).tolist():
        s = int(ids[i])
        assert m.access(i) == s
        assert m.rank(s, i) == int((ids[:i] == s).sum())
        assert m.select(s, m.rank(s, i)) == i
    assert list(m.positions(3)) == np.flatnonzero(ids == 3).tolist()
    assert m.count(50_300) == 0 and m.count(70_000) == 0
    with pytest.raises(IndexError):
        m.select(3, m.count(3))


def test_large_blocks():
    ids = np.random.default_rng(2).integers(0, 3, 1_200_000).astype(np.uint16)
    m = WaveletMatrix(build(ids, [1], [len(ids)]))
    assert m.rank(2, 1_100_000) == int((ids[:1_100_000] == 2).sum())
    assert m.access(1_199_999) == ids[-1] and (m.decode() == ids).all()


def test_whole_table(spark):
    rows = [(i * 3 + 1, t, 7) for i, t in enumerate(TEXTS)] + [(None, "null id", 7), (2, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(5)
    manifest = write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), rows_per_shard=4, tokens_per_file=50)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    want, at = [], 0
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, document_index(manifest).collect()), key=str) == sorted(want, key=str)
    assert manifest.count() > 3
    assert {(r.doc_id, zlib.crc32(bytes(r.ids))) for r in read_documents(manifest).collect()} == {(w[0], w[3]) for w in want}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert document_index(write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"))).count() == 0
