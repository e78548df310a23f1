"""SentencePiece, token counts, packing and token files against the libraries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as p
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trackframe.llm import packing, sentencepiece_codec, token_counts, token_files, tokenizer_cache

PIECES, BYTES, WORDS = p.path("piece_bpe_32k.model"), p.path("byte_bpe_50k.json"), p.path("word_bpe_49k.json")
LETTERS = "ab eTh  ▁\n\t15é漢😀  ing.,~\x00'sİß"


def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def key(r):
    return tuple(str(x) for x in r)


@pytest.fixture(scope="module")
def model():
    return sentencepiece_codec.PieceModel(PIECES, 500)


def some_texts(n):
    rng = random.Random(9)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(40))) for _ in range(n)] + ["", " ", "  a", "a  ", "\n\n", "▁▁x", " " * 40 + "x", "aaaaaaaaaaaaaaaaa"]


def test_pieces_equal_the_library(model):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = some_texts(3000)
    for at in range(0, len(texts), 100):  # the small cache turns over
        for t, raw in zip(texts[at : at + 100], model.encode_batch(texts[at : at + 100]), strict=True):
            ids = np.frombuffer(raw, "<u2").tolist()
            assert ids == sp.encode(t)
            assert model.decode(ids) == sp.decode(ids)


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ab", "a", "etaoinsr", "éaß漢b"])
def test_long_words_equal_the_library(model, letters):
    sp, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(len(letters))
    words = ["".join(rng.choice(letters) for _ in range(n)) for n in (60, 65, 66, 100, 500, 5000, 100_000)]
    for w, raw in zip(words, model.encode_batch(words), strict=True):
        assert np.frombuffer(raw, "<u2").tolist() == sp.encode(w)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999)), max_size=12))
def test_decoding_of_any_ids(ids):
    sp = test_decoding_of_any_ids.__dict__.setdefault("sp", sentencepiece.SentencePieceProcessor(model_file=PIECES))
    own = test_decoding_of_any_ids.__dict__.setdefault("own", sentencepiece_codec.PieceModel(PIECES))
    assert own.decode(ids) == sp.decode(ids)


@pytest.mark.parametrize("kind,path", [(tokenizer_cache.ByteLevelEncoder, BYTES), (tokenizer_cache.WordEncoder, WORDS)])
def test_cached_pieces_equal_the_library(kind, path, texts):
    encode, own = library(path), kind(path, 200)
    every = [*some_texts(3000), *texts.values(), "a <|endoftext|> b", "it's 5's, we'll. (x) abc1. q́ É́s ﬁ"]
    every += [t.replace(" ", "\n") for t in every] + [t.replace(" ", "  ") for t in every] + [t.replace("\t", "   ").replace("e", "\n\n\n") for t in every] + [t + e for t in every for e in ("\n", "\n\n", "  ", "\t\n")]
    rows = [t.encode() for t in every]
    ids, sizes = own.encode_many(rows, 7)
    assert own.count_many(rows).tolist() == (sizes - 1).tolist()
    for t, own_ids in zip(every, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert own_ids.tolist() == [*encode(t), 7], t


def test_op1(docs, plain, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for d, t in plain:
        ids = [*sp.encode(t), 2]
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted(map(key, sentencepiece_codec.encode_decode(docs, PIECES).collect())) == sorted(map(key, want))
    assert sentencepiece_codec.encode_decode(empty, PIECES).count() == 0


def test_op2(docs, plain, empty):
    encode = library(BYTES)
    n = np.array([len(encode(t)) for _, t in plain])
    got = token_counts.token_counts(docs, BYTES).orderBy("n_tokens").collect()
    assert [r.n_tokens for r in got] == sorted(set(n.tolist()))
    for r in got:
        k = r.n_tokens
        assert (r.n_docs, r.docs_upto, r.docs_longer, r.tokens_longer, r.tokens_truncated, r.docs_total, r.tokens_total) == ((n == k).sum(), (n <= k).sum(), (n > k).sum(), n[n > k].sum(), np.minimum(n, k).sum(), len(n), n.sum())
    totals = token_counts.token_counts(docs, BYTES).cache()
    for share in (0.0, 0.25, 0.5, 0.9, 1.0):
        assert token_counts.quantile(totals, share).first()[0] == min(k for k in n if (n <= k).sum() >= share * len(n))
    for limit in (0, 1, 2, 17, 100, 10**7):
        assert token_counts.truncated_total(totals, limit).first()[0] == np.minimum(n, limit).sum()
    none = token_counts.token_counts(empty, BYTES)
    assert none.count() == 0 and token_counts.quantile(none, 0.5).first()[0] is None and token_counts.truncated_total(none, 5).first()[0] is None


def test_op6(docs, plain, empty):
    encode = library(WORDS)
    got = packing.pack(docs, WORDS, window=64, open_windows=3).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 64
        padding += 0 if at & (at - 1) == 0 else 64 - at
    unique = {d: t for d, t in plain if d is not None and d != 5}
    total = sum(len(encode(t)) + 1 for _, t in plain)
    assert sum(r.length for r in got) == total and padding < 0.15 * total
    for d, t in unique.items():
        ids, at = np.array([*encode(t), 1], "<u4"), 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert packing.pack(empty, WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_codec_round_trip(values):
    ranks = np.array(values, np.uint32)
    control, data = token_files.encode_block(ranks)
    assert len(control) == -(-len(values) // 4)
    assert token_files.decode_block(control, data, len(values)).tolist() == values


def test_op9(docs, plain, empty):
    encode = library(BYTES)
    want, start = [], 0
    rows = sorted(((d, t) for d, t in plain if d is not None), key=lambda r: r[0])
    nulls = [t for d, t in plain if d is None]
    start = sum(len(encode(t)) + 1 for t in nulls)  # null ids come first
    for d, t in rows:
        ids = np.array([*encode(t), 0], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_files.round_trip(docs, BYTES).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == sorted(want)
    assert sum(r.doc_id is None for r in got) == 2
    assert token_files.round_trip(empty, BYTES).count() == 0
