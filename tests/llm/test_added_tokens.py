import os

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tonearm.llm import queries
from tonearm.llm._bpe import encoder

TEXTS = ["see <|endoftext|> here", "plain words", "<|startoftext|>a b<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> < |endoftext|>", "a\x1c<|endoftext|> b", "see <|endoftext|> here, again"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_as_the_plain_library_call(name):
    lib = Tokenizer.from_file(public_tokenizers.path(name))
    enc = encoder(public_tokenizers.path(name))
    want = [lib.encode(t, add_special_tokens=False).ids for t in TEXTS]
    lib.encode_special_tokens = True
    ordinary = [lib.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert want != ordinary
    for added, ids in ((True, want), (False, ordinary), (True, want)):
        flat, stops = enc.encode(TEXTS, added)
        assert [x.tolist() for x in np.split(flat, stops[:-1])] == ids


def test_registered_queries_use_the_plain_call(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(os.path.join(tmp_path, "documents.parquet"))
    for query, name, column in ((queries.op2_wavelet_tokens, "byte_bpe_50k.json", "n_tokens"), (queries.op3_best_fit_packing, "word_bpe_49k.json", "length")):
        lib = Tokenizer.from_file(public_tokenizers.path(name))
        got = {r.doc_id: r[column] for r in query(spark, str(tmp_path)).collect()}
        assert got == {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(TEXTS)}
