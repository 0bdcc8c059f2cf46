import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkfold.llm import common, viterbi_pieces

PIECES = common.tokenizer_path("piece_bpe_32k.model")


def test_ids_are_the_library_s(spark, docs, rows):
    lib = viterbi_pieces.merges(PIECES).library
    want = Counter((i, tuple(lib.encode(t or ""))) for i, t in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in viterbi_pieces.encode(docs, PIECES).collect()) == want
    crc = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.elements())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in viterbi_pieces.digest(docs, PIECES).collect()) == crc
    corpus = common.table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text for r in corpus.collect()}
    assert all(r.ids == lib.encode(texts[r.doc_id] or "") for r in viterbi_pieces.encode(corpus, PIECES).collect())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aAé ▁\n\t12the中🙂", max_size=25), max_size=5))
def test_any_text_is_merged_as_the_library_does(texts):
    p = viterbi_pieces.merges(PIECES)
    ids, n = p.encode(*common.bytes_of(pa.array(texts, pa.large_string())))
    ends = np.cumsum(n)
    for t, e, k in zip(texts, ends, n):
        assert ids[e - k : e].tolist() == p.library.encode(t)
