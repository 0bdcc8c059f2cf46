import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkfold.llm import common, packing, prefix_counts, token_files, viterbi_pieces, wordpieces

WORDS, PIECES = common.tokenizer_path("word_bpe_49k.json"), common.tokenizer_path("piece_bpe_32k.model")


def _bytes(texts):
    return common.bytes_of(pa.array(texts, pa.large_string()))


def _ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAé ŒΣ'st<|endoftext|>\x1c\x85 \t\n12!*́中🙂_-", max_size=40), max_size=8))
def test_chunks_encode_as_whole_texts(texts):
    enc = wordpieces.encoder(WORDS)
    ids, n = enc.encode(*_bytes(texts))
    ends = np.cumsum(n)
    for t, e, k in zip(texts, ends, n):
        assert ids[e - k : e].tolist() == enc.library.encode(t, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=20), max_size=6))
def test_pack_ids_round_trip(lists):
    parts = [token_files.pack_ids(np.array(x, np.uint32)) for x in lists]
    back = token_files.unpack_ids(b"".join(c for c, _ in parts), b"".join(d for _, d in parts), np.array([len(x) for x in lists], np.int64))
    assert back.tolist() == [v for x in lists for v in x]


def test_token_files(spark, docs, rows):
    path = common.scratch(spark)
    token_files.write(docs, WORDS, path)
    got = token_files.read(spark, path).collect()
    want = sorted(((i is not None, i or 0, [*_ids(t), 1]) for i, t in rows), key=lambda x: x[:2])
    got.sort(key=lambda r: r.start)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i if some else None, tuple(x)) for some, i, x in want)
    assert [r.doc_id for r in got] == [i if some else None for some, i, _ in want]
    total = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (total, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        total += r.n_tokens


def test_token_files_of_an_empty_table(spark, empty):
    path = common.scratch(spark)
    token_files.write(empty, WORDS, path)
    assert token_files.read(spark, path).collect() == []


def test_counts_match_the_library(docs, rows):
    lib = prefix_counts.counter(PIECES).library
    got = Counter(tuple(r) for r in prefix_counts.count_tokens(docs, PIECES).collect())
    want = Counter((i, len((t or "").encode()), len(lib.encode(t or "")), len(lib.encode(t or "")) > 4096) for i, t in rows)
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAé ▁\n\t12the中🙂", max_size=25))
def test_every_prefix_count(text):
    c = prefix_counts.counter(PIECES)
    want = [len(c.library.encode(text[:k])) for k in range(len(text) + 1)]
    assert c.text_prefixes(text).tolist() == want
    budget = want[-1] // 2
    assert c.within(text, budget) == text[: max(k for k, n in enumerate(want) if n <= budget)]


def test_viterbi_matches_the_library_as_a_unigram_model():
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(PIECES, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    lib = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    p = viterbi_pieces.pieces(PIECES)
    words = "thering otherwise einen ththe houou ***".split()
    ids, n = p.encode(*_bytes(words))
    ends = np.cumsum(n)
    for w, e, k in zip(words, ends, n):
        assert ids[e - k : e].tolist() == lib.encode(w)


def test_viterbi_round_trip(docs, rows):
    assert all(r.round_trip for r in viterbi_pieces.digest(docs, PIECES).collect())
    back = viterbi_pieces.decode(viterbi_pieces.encode(docs, PIECES), PIECES)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, (t or "").replace("▁", " ")) for i, t in rows)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_pack_histogram_places_each_piece_once(histogram):
    placed = Counter()
    for count, pattern in packing.pack_histogram(histogram, 40):
        assert sum(pattern) <= 40
        for n in pattern:
            placed[n] += count
    assert placed == Counter(histogram)


def test_packing(docs, rows):
    whole, cut = packing.pack(packing.pieces(docs, WORDS, most=64), most=64, slack=4)
    got = whole.unionByName(packing.recut(docs, cut, WORDS, most=64)).collect()
    by_sequence, ids = {}, {}
    for i, t in rows:
        ids.setdefault(i, []).append([*_ids(t), 1])
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and len(x) == r.doc_tokens for x in ids[r.doc_id])
    assert sum(r.length for r in got) == sum(len(x) for v in ids.values() for x in v)
    padding = 0
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        at = 0
        for r in parts:
            assert r.offset == at
            at += r.length
        assert at <= 64
        padding += 0 if at & (at - 1) == 0 else 64 - at
    assert padding <= 4 * len(by_sequence)
    packed = whole.unionByName(packing.recut(docs, cut, WORDS, most=64))
    laid = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(docs, packed, WORDS).collect()}
    for s, parts in by_sequence.items():
        assert len(laid[s]) == sum(r.length for r in parts)
        assert all(zlib.crc32(laid[s][r.offset : r.offset + r.length].tobytes()) == r.ids_crc32 for r in parts)


def test_packing_of_an_empty_table(empty):
    whole, cut = packing.pack(packing.pieces(empty, WORDS))
    assert whole.collect() == [] and packing.recut(empty, cut, WORDS).collect() == []
