"""Documents with the string of an added token: op2 and op9."""

from __future__ import annotations

import numpy as np

from pollveil.llm import packing, token_spans
from pollveil.llm.tokenize import default_path, tokenizer
from tests.llm.helpers import documents

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>\n x", "a  <|endoftext|>  b\n<|endoftext", "no"]


def test_added_tokens_as_in_the_json_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [other.encode(t, add_special_tokens=False).ids for t in TEXTS]
    tok = tokenizer(default_path())
    assert [tok.encode_document(t).tolist() for t in TEXTS] == want
    assert all(tok.n_bytes[tok.encode_document(t)].sum() == len(t.encode()) for t in TEXTS)
    docs = documents(spark, [(k, t, "en", "a") for k, t in enumerate(TEXTS)])
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.pack(docs).collect()}
    assert got == {k: [*ids, packing.END_ID] for k, ids in enumerate(want)}
    counted = token_spans.token_counts(docs).collect()
    assert {r.doc_id: r.doc_tokens for r in counted} == {k: len(ids) for k, ids in enumerate(want)}
    assert all(sum(r.n_tokens for r in counted if r.doc_id == k) == len(ids) for k, ids in enumerate(want))
