"""Jaccard join, MinHash, repeats and the run-length index against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np

from conftest import make  # noqa: F401
from proofline.llm import jaccard, minhash, repeats, rindex, shingles

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))


def set_of(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(texts, k, num, den):
    sets = {i: set_of(t, k) for i, t in texts}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_words_and_shingles(corpus):
    texts = [t for _, t in corpus] + ["lorem " * 300_000 + "end", "w" * 1_500_000 + " x"]
    names = {}
    for text, found in zip(texts, shingles.word_hashes(texts), strict=True):
        own = words_of(text)
        assert len(own) == len(found)
        for w, h in zip(own, found.tolist(), strict=True):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_jaccard_query(docs, corpus, empty):
    for k, num in ((4, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, k, num, 100).collect()}
        assert got == brute_components(corpus, k, num, 100)
    assert jaccard.jaccard_components(empty).count() == 0


def test_jaccard_at_the_threshold_and_repeated_rows(spark):
    base = [f"w{i}" for i in range(103)]  # 100 shingles of four words
    edge = base[:85] + ["x"] * 1
    texts = [(5, " ".join(base)), (5, " ".join(base)), (2, " ".join(base[:-15])), (9, " ".join(base[:-16])), (1, " ".join(edge)), (7, None), (8, "")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(make(spark, texts), 4, 85, 100).collect())
    want = brute_components([(i, t) for i, t in texts if i != 5] + [(5, texts[0][1])], 4, 85, 100)
    assert got == sorted([(5, *want[5]), *[(i, *v) for i, v in want.items()]])


def test_large_clusters_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CLUSTER", 800)
    monkeypatch.setattr(jaccard, "SEND", 3)
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(40):
        own = list(base)
        for at in r.sample(range(120), i % 4):
            own[at] = f"x{i}-{at}"
        texts.append((i, " ".join(own)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(make(spark, texts), 4, 85, 100).collect()}
    assert got == brute_components(texts, 4, 85, 100)


def test_signatures_lose_no_link():
    r, classes = random.Random(7), jaccard.Classes(80, 100)
    frequent = np.zeros(1 << jaccard.SLOT_BITS, bool)
    frequent[::3] = True
    for _ in range(1500):
        n = r.choice([6, 7, 12, 30, 33, 41, 60, 100, 500])
        a = {r.randrange(1 << 64) for _ in range(n)}
        b = set(a)
        for x in r.sample(sorted(a), r.randrange(0, n // 4 + 1)):
            if r.random() < 0.7:
                b.discard(x)
            if r.random() < 0.5:
                b.add(r.randrange(1 << 64))
        if b and a != b and 100 * len(a & b) >= 80 * len(a | b):
            one, two = (set(classes.signatures(np.array(sorted(s), np.uint64), frequent).tolist()) for s in (a, b))
            assert one & two


def test_sets_send_no_more_than_suffices():
    r, classes = random.Random(8), jaccard.Classes(80, 100)
    for n in (60, 500, 3000):
        own = np.array(sorted({r.randrange(1 << 64) for _ in range(n)}), np.uint64)
        c = int(np.searchsorted(classes.ends, n))
        assert len(classes.signatures(own, np.zeros(1 << jaccard.SLOT_BITS, bool))) == sum(classes.differ[x] + 1 for x in (c, c + 1))
    posts = np.array([(r.randrange(1 << 64), r.randrange(1 << 64)) for _ in range(50)], jaccard.POSTING)
    blocks = [x.tobytes() for x in np.split(jaccard.packed(posts), [7, 7, 20])]
    sign, name = jaccard.unpacked(blocks)
    assert sum(map(len, blocks)) == 14 * 50 and (sign == posts["sign"] >> np.uint64(16) << np.uint64(16)).all() and (name == posts["name"]).all()


def test_pairs_and_large_clusters_are_done_in_rounds(spark, monkeypatch):
    for name, value in (("BLOCK", 700), ("BLOCKS", 1), ("CLUSTER", 700), ("PAIRS", 1)):
        monkeypatch.setattr(jaccard, name, value)
    written, table = [], jaccard.store.table
    monkeypatch.setattr(jaccard.store, "table", lambda df, name: (written.append(name), table(df, name))[1])
    r = random.Random(6)
    texts = []
    for i in range(48):
        own = [f"w{i % 4}-{j}" for j in range(120)]
        for at in r.sample(range(120), i % 5):
            own[at] = f"x{i}-{at}"
        texts.append((i, " ".join(own)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(make(spark, texts), 4, 85, 100).collect()}
    assert got == brute_components(texts, 4, 85, 100)
    assert written.count("likely") > 1 and written.count("links") > 1 and written.count("sets") == 1


def test_keep_one(docs, corpus):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in brute_components(corpus, 5, 80, 100).items() if c == i)


def test_keep_one_of_repeated_rows(spark):
    rows = make(spark, [(3, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f"), (None, "q r s t u v")])
    assert [r.doc_id for r in jaccard.keep_one(rows).orderBy("doc_id").collect()] == [None, 3]


def test_null_ids_link(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join([*base[:-1], "x"]), " ".join(["y", *base[1:]])]
    rows = make(spark, [(None, texts[0]), (None, texts[1]), (4, texts[2])])
    assert [(r.doc_id, r.component_id) for r in jaccard.jaccard_components(rows, 4, 85, 100).orderBy("doc_id").collect()] == [(None, 4), (None, 4), (4, 4)]
    assert {r.component_id for r in jaccard.jaccard_components(rows.filter("doc_id is null"), 4, 85, 100).collect()} == {None}


def test_minhash_near_duplicates(docs, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.minhash_near_duplicates(docs).collect()}
    assert got == brute_components(corpus, 5, 80, 100)


def test_fingerprints(docs, corpus, empty):
    got = {r.doc_id: r for r in minhash.fingerprints(docs).collect()}
    texts = {i: t or "" for i, t in corpus}
    order = sorted(texts, reverse=True)
    for at, i in enumerate(order):
        text, after = texts[i], texts[order[(at + 1) % len(order)]]
        k = len(text) // 2
        changed = text[: len(text) - k] + after[:k]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        a, b = set_of(text, 5), set_of(changed, 5)
        if a and b:
            assert abs(got[i].near_edited - len(a & b) / len(a | b)) < 0.25
        for j in order[at + 1 :]:
            if texts[j] == text:
                assert got[i].fingerprint == got[j].fingerprint
    assert minhash.fingerprints(empty).count() == 0


def test_fingerprints_of_one_and_of_repeated_ids(spark):
    one = minhash.fingerprints(make(spark, [(4, "a b c d e f g h")])).first()
    assert one.near_next == 1.0 and one.n_chars == 15
    rows = make(spark, [(1, "a b"), (1, "a b"), (1, "c d"), (0, "x y z"), (0, "x y"), (None, "n")])
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in minhash.fingerprints(rows).collect()) == [-1, 0, 0, 1, 1, 1]


def test_classes_of_the_run_index():
    r = random.Random(3)
    for _ in range(60):
        base = bytes(r.choice(b"ab\x00") for _ in range(60))
        strings = []
        for _ in range(r.randrange(1, 12)):
            a = r.randrange(0, 30)
            own = bytearray(base[a : a + r.randrange(8, 30)])
            if r.random() < 0.5:
                own[r.randrange(len(own))] = r.choice(b"abc")
            strings.append(bytes(own))
        got, want = defaultdict(set), defaultdict(set)
        for s, at, number in zip(*(x.tolist() for x in rindex.classes(rindex.RunIndex(strings, 8))), strict=True):
            got[number].add((s, at))
        for s, own in enumerate(strings):
            for at in range(len(own) - 7):
                want[own[at : at + 8]].add((s, at))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def brute_repeats(texts, least):
    seen, out = set(), {}
    for i, text in sorted(texts, key=lambda x: x[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - least + 1):
            w = data[p : p + least]
            if w in seen:
                gone[p : p + least] = True
            seen.add(w)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out[i] = (len(data), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_query(docs, corpus, empty):
    rows = repeats.remove_repeats(docs).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert got == brute_repeats(corpus, 100)
    for r in rows:
        assert r.kept_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() or "�" not in r.text
        assert (r.bucket, r.kind, bytes(r.block), r.score) == (2, 3, b"x", 0.5)
    assert repeats.remove_repeats(empty).count() == 0


def test_repeats_of_few_symbols_and_overlaps(spark):
    r = random.Random(9)
    base = "".join(r.choice("ab") for _ in range(400))
    texts = [(i, base[a : a + r.randrange(50, 300)] + r.choice(["", "z"]) + base[:150]) for i, a in enumerate(r.randrange(0, 200) for _ in range(30))]
    texts += [(40, "!" * 350), (41, "!" * 99), (42, "ab" * 200)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeats.remove_repeats(make(spark, texts).repartition(4)).collect()}
    assert got == brute_repeats(texts, 100)


def test_repeats_with_repeated_rows(spark):
    r = random.Random(1)
    text = "".join(r.choice("abcdefgh") for _ in range(300))
    rows = repeats.remove_repeats(make(spark, [(1, text), (1, text), (2, text), (None, text[:150])])).collect()
    assert sorted((x.doc_id or -1, x.n_removed) for x in rows) == [(-1, 0), (1, 150), (1, 150), (2, 300)]
