"""BPE, token store and packing against the tokenizers library."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import make  # noqa: F401  (tests/llm/conftest.py)
from proofline.llm import bpe, libtokens, packing, tokenstore, wordsplit

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a  b   c ", " lead", "a\n b\n\nc \nd\t e", "x\xa0y", "it's WE'LL 'S", "12٣ ²", "ΑΣ Σ. İ ǅ ﬁ", "A<|endoftext|>b <|startoftext|>", "!" * 99, "ab" * 500]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encoders_equal_the_library(path, corpus):
    lib, own, memo = Tokenizer.from_file(path), bpe.SegmentTreeBPE(path, memo=50), libtokens.LibraryTokenizer(path)
    for text in [t or "" for _, t in corpus] + ODD:
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want
        assert np.frombuffer(memo.encode(text), "<u4").tolist() == want
        assert own.decode(array("I", want).tobytes()) == lib.decode(want, skip_special_tokens=False)


def test_segment_tree_equals_plain_merging():
    own, r = bpe.SegmentTreeBPE(WORDS), random.Random(4)
    for _ in range(200):
        piece = "".join(r.choice("aeinrst!") for _ in range(r.randrange(1, 40)))
        ids = [own.first[b] for b in piece.encode()]
        ids[-1] = own.last[piece.encode()[-1]]
        while True:
            found = [(own.merge[a << 32 | b] >> 32, i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if a << 32 | b in own.merge]
            if not found:
                break
            _, i = min(found)
            ids[i : i + 2] = [own.merge[ids[i] << 32 | ids[i + 1]] & 0xFFFFFFFF]
        assert np.frombuffer(own.encode_piece(piece.encode()), "<u4").tolist() == ids


def test_bpe_query(docs, corpus, empty):
    lib = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r for r in bpe.bpe_digests(docs, WORDS).collect()}
    assert len(got) == len(corpus)
    for i, t in corpus:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.bpe_digests(empty, WORDS).count() == 0
    assert bpe.encode_documents(docs, WORDS).filter("decoded is null or ids is null").count() == 0


def test_memo_keeps_what_is_used():
    made = []
    memo = wordsplit.Memo(lambda k: made.append(k) or k.encode(), 2)
    assert [memo[k] for k in "abcab"] == [b"a", b"b", b"c", b"a", b"b"] and made == ["a", "b", "c"]


def test_words_before_punctuation_are_kept_once():
    lib, own = Tokenizer.from_file(BYTES), libtokens.LibraryTokenizer(BYTES)
    text = "a stone, a stone. \tthe stone; 12, x1 it's stone's, stone's ... -stone end "
    assert np.frombuffer(own.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
    assert "stone" in own.memo.spaced and " stone" not in own.memo.pieces
    assert own.splitter.model is None


def test_plain_texts_by_character():
    """The same answer as a look at each character; what is left without usual ASCII decides."""
    plain = wordsplit.Splitter(BYTES).plain
    usual = lambda t: not wordsplit.UNUSUAL.search(t) and "<|" not in t
    for x in [*map(chr, range(0x3000)), "\ud800", "\U0001f600", "<|", "<\n|", "é<|", ""]:
        for t in (x, f"a {x} b", f"é{x}"):
            assert plain(t) == usual(t), repr(t)


def test_memos_are_given_up():
    assert libtokens.ready(BYTES, 10) is libtokens.ready(BYTES, 10)
    libtokens.forget()
    assert not libtokens._ready


def test_codes_give_any_token():
    r = random.Random(2)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = np.array([r.choice([r.randrange(256), r.randrange(65536), r.randrange(1 << 32)]) for _ in range(n)], np.uint32)
        codes = tokenstore.Codes.from_bytes(tokenstore.Codes.of(ids).to_bytes())
        assert [codes.get(i) for i in range(n)] == ids.tolist()
        for _ in range(50):
            a = r.randrange(n + 1)
            b = r.randrange(a, n + 1)
            assert codes.slice(a, b).tolist() == ids[a:b].tolist()
        with pytest.raises(IndexError):
            codes.get(n)


def test_token_store(spark, docs, corpus, empty):
    lib, files = Tokenizer.from_file(WORDS), tokenstore.write_tokens(docs, WORDS, shard=500)
    got = {r.doc_id: r for r in tokenstore.read_documents(files).collect()}
    flat = []
    for i, t in corpus:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (len(flat), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        flat += ids
    wanted = spark.createDataFrame([(p,) for p in (0, 1, 499, 500, 501, len(flat) - 1, len(flat), -1)], "position long")
    assert {(r.position, r.id) for r in tokenstore.tokens_at(files, wanted).collect()} == {(p, flat[p]) for p in (0, 1, 499, 500, 501, len(flat) - 1)}
    assert tokenstore.token_store(empty, WORDS).count() == 0


def test_token_store_with_repeated_and_null_ids(spark):
    rows = make(spark, [(1, "b"), (1, "a"), (1, "a"), (None, "z"), (0, None)])
    got = [(r.doc_id, r.start, r.n_tokens) for r in tokenstore.token_store(rows, WORDS).orderBy("start").collect()]
    assert got == [(None, 0, 2), (0, 2, 1), (1, 3, 2), (1, 5, 2), (1, 7, 2)]


def check_plan(histogram, capacity):
    runs, sequences = packing.plan(histogram, capacity)
    seen, held = {}, {}
    for length, rank, count, first, offset in runs:
        seen.setdefault(length, []).append((rank, count))
        for i in range(count):
            held.setdefault(first + i, []).append((offset, length))
    for length, n in histogram.items():
        at = 0
        for rank, count in sorted(seen[length]):
            assert rank == at
            at += count
        assert at == n
    assert sorted(held) == list(range(sequences))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_plans_are_whole_and_tight():
    r = random.Random(3)
    for h, most in [({}, 0), ({1: 1}, 1), ({64: 3}, 3), ({33: 10, 31: 10}, 10), ({40: 5, 24: 5, 1: 64}, 6), ({22: 9}, 5)]:
        assert check_plan(h, 64) <= most
    for _ in range(20):
        h = {n: r.randrange(1, 30) for n in r.sample(range(1, 129), r.randrange(1, 100))}
        lower = max(-(-sum(k * v for k, v in h.items()) // 128), sum(v for k, v in h.items() if k > 64))
        assert lower <= check_plan(h, 128) <= 1.25 * lower + 2
    even = {n: 20 for n in range(1, 257)}
    assert check_plan(even, 256) <= 1.02 * sum(k * v for k, v in even.items()) / 256 + 2


def test_cut():
    assert packing.cut(10, 4) == [(0, 2), (2, 4), (6, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(4, 4) == [(0, 4)]


def test_packing_query(docs, corpus, empty):
    lib, got = Tokenizer.from_file(BYTES), {}
    rows = packing.pack_documents(docs, BYTES, capacity=256).collect()
    for r in rows:
        got[r.doc_id, r.piece] = r
    for i, t in corpus:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        for k, (a, n) in enumerate(packing.cut(len(ids), 256)):
            r = got.pop((i, k))
            assert (r.start, r.length, r.ids_crc32) == (a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()))
    assert not got
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(empty, BYTES).count() == 0
