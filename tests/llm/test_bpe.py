import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagequarry.llm import bpe, queries

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(text):
    return np.frombuffer(bpe.bpe().encode_batch([text])[0], "<u4").tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_encodes_as_the_library_does(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert bpe.bpe().decode(np.array(want, "<u4").tobytes()) == LIBRARY.decode(want, skip_special_tokens=False)


def test_runs_and_long_words():
    for text in ("a" * 5000, "abab" * 700, "!?" * 900, " " * 500, "\n" * 77 + "x", "thethethe" * 40, "é" * 300, "<|endoftext|>" * 3 + " <|endoftext|"):
        assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_neighbours_hold_exactly_where_merging_keeps_them():
    coder = bpe.Bpe(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 20_000, (2, 3000))
    apart = coder.compatible(a, b)
    for x, y, ok in zip(a.tolist(), b.tolist(), apart.tolist(), strict=True):
        assert ok == (coder.merged(coder.token[x] + coder.token[y]) == [x, y])


def test_words_merged_together_are_those_merged_alone():
    coder = bpe.bpe()
    words = [w.encode() for w in "a thetion unbelievably zzzzzz ééé reabcxyz 日本 averyveryverylongwordofmanyparts".split()]
    assert coder.merged_together(words) == [np.array(coder.merged(w), "<u4").tobytes() for w in words]


def test_query_on_odd_rows(odd):
    rows = bpe.encode_decode(odd).collect()
    texts = {(r.doc_id, r.text) for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.doc_id, r.decoded) in texts or r.decoded == ""
    assert bpe.encode_decode(odd.limit(0)).count() == 0


def test_query_matches_the_library(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op2_bpe(spark, sf_dir).collect():
        want = LIBRARY.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(want, skip_special_tokens=False).encode()).hexdigest()
