"""Edge rows: nulls, ties, repeated rows, odd lengths, marks and hashes that mislead, clashing names."""

import hashlib
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import make
from proofline.llm import ann, bpe, jaccard, libtokens, minhash, packing, quality, repeats, rindex, shingles, store
from test_sets import brute_components, brute_repeats

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def brute_neighbours(rows, queries, k):
    """Lists of (vec_id, score) for each query row, in order, the row itself left out once."""
    good = [i for i, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q in queries:
        if q in good:
            v = np.array(rows[q][1])
            near = [(-float(ann.cosine(v[None], np.array(rows[i][1])[None])[0]), rows[i][0]) for i in good if i != q and len(rows[i][1]) == len(v)]
            out.append((rows[q][0], [(i, -s) for s, i in sorted(near)[:k]]))
    return sorted(out)


def test_neighbours_of_odd_lengths_and_repeated_ids(spark):
    r = np.random.default_rng(4)
    rows = [(0, [1.0, 2.0]), (7, [2.0, 1.0]), (50, r.normal(size=3).tolist())]
    rows += [(i, r.normal(size=3).tolist()) for i in range(1, 120)]
    rows += [(50, r.normal(size=3).tolist()), (100, rows[102][1]), (100, rows[102][1]), (3, rows[2][1]), (150, []), (200, [1.0])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, dim int, own int").repartition(5)
    found = ann.nearest(table, table.filter("vec_id % 50 = 0"), 5, query_bytes=100).collect()
    lists = {}
    for x in found:
        lists.setdefault((x.query_id, x.rank), []).append((x.vec_id, x.score))
    want = {}
    for q, near in brute_neighbours(rows, [i for i, (n, _) in enumerate(rows) if n % 50 == 0], 5):
        for n, one in enumerate(near):
            want.setdefault((q, n + 1), []).append(one)
    assert {k: sorted(v) for k, v in lists.items()} == {k: sorted(v) for k, v in want.items()}
    assert (0, 1) in lists and (0, 2) not in lists and (200, 1) not in lists
    assert len(lists[100, 1]) == 3 and all(s > 0.999999 for _, s in lists[100, 1])


def test_fingerprints_where_all_ids_are_null(spark):
    rows = make(spark, [(None, "a b c d e f"), (None, "g h"), (None, None)]).repartition(3)
    got = minhash.fingerprints(rows).collect()
    assert len(got) == 3 and {r.doc_id for r in got} == {None} and sorted(r.n_chars for r in got) == [0, 3, 11]
    many = make(spark, [(1, "same words here")] * 40 + [(2, "x")])
    assert len(minhash.fingerprints(many).collect()) == 41


def test_range_numbers_are_those_of_a_search(spark):
    points = [-5, 0, 3, 9, 10, 400]
    keys = [*range(-8, 15), 399, 400, 401, 1 << 60]
    got = spark.createDataFrame([(k,) for k in keys], "key long").select("key", store.range_no("key", points).alias("no")).collect()
    assert {r.key: r.no for r in got} == {k: sum(p < k for p in points) for k in keys}


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word


def test_words_of_one_structure_stay_apart(spark):
    a = thue_morse(4096)
    b = a.translate({97: 98, 98: 97})
    rows = make(spark, [(1, a), (2, b), (3, thue_morse(32)), (4, thue_morse(32).translate({97: 98, 98: 97}))])
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(rows, 4, 85, 100).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert len({r.fingerprint for r in minhash.fingerprints(rows).collect()}) == 4
    short = shingles.word_hashes([a[:32] + " " + a[:33] + " " + a[:31]])[0]
    assert len(set(short.tolist())) == 3


def test_many_rows_of_one_id(spark):
    base = [f"w{i}" for i in range(40)]
    texts = [(None if i % 2 else 5, " ".join([*base[: i % 7], f"x{i % 7}", *base[i % 7 + 1 :]])) for i in range(60)]
    found = jaccard.jaccard_components(make(spark, texts).repartition(4), 4, 85, 100)
    sets = {}
    for i, (d, t) in enumerate(texts):
        sets[i] = t
    parts = brute_components(list(sets.items()), 4, 85, 100)
    least = {}
    for i, (d, _) in enumerate(texts):
        root = parts[i][1]
        least[root] = min((x for x in (least.get(root), d) if x is not None), default=None)
    want = sorted((str(d), parts[i][0], str(least[parts[i][1]])) for i, (d, _) in enumerate(texts))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found.collect()) == want


def test_keep_one_of_rows_that_differ_elsewhere(spark):
    rows = spark.createDataFrame([(3, "a b c d e f", "y"), (3, "a b c d e f", "x"), (4, "a b c d e f", "w"), (9, None, "v"), (9, None, "v")], "doc_id long, text string, twin string")
    assert sorted((r.doc_id, r.text, r.twin) for r in jaccard.keep_one(rows).collect() if r.text) == [(3, "a b c d e f", "x")]
    assert jaccard.keep_one(rows).columns == rows.columns and jaccard.keep_one(rows).count() == 3


def test_keep_good_leaves_other_columns_alone(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(40)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} <= {0.5}


def test_quality_is_a_fit_of_every_chosen_row(spark):
    """The model equals one fitted in place on the same rows, and its weights are a minimum of the loss written out anew."""
    r = random.Random(6)
    texts = [" ".join(r.choice(["fine", "words", "stand", "here", "THE", "x!!"]) for _ in range(r.randrange(1, 60))) for _ in range(120)]
    rows = make(spark, list(enumerate(texts)) + [(3, texts[3] + " again"), (None, "q")]).repartition(6)
    labels = spark.createDataFrame([(i, int("!!" not in t[: len(t) // 2])) for i, t in enumerate(texts)] + [(1, 7)], "doc_id long, quality int")
    one, two = quality.train(rows, labels), quality.train(rows.repartition(3), labels)
    assert np.array_equal(one.weights, two.weights) and one.cut == two.cut
    own = quality.train(rows, labels, sample=20)
    assert not np.array_equal(one.weights, own.weights)
    x = np.array([quality.features(t) for t in texts])
    better = np.array(["!!" not in t[: len(t) // 2] for t in texts])
    model = quality.fit(x, better, pairs=500)
    rng = np.random.default_rng(5)
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    good, bad = np.flatnonzero(better), np.flatnonzero(~better)
    d = z[rng.choice(good, 500)] - z[rng.choice(bad, 500)]
    loss = lambda w: np.log1p(np.exp(-d @ w)).sum() + 0.5 * quality.RIDGE * w @ w
    for i in range(quality.FEATURES):
        for step in (-1e-3, 1e-3):
            moved = model.weights.copy()
            moved[i] += step
            assert loss(moved) >= loss(model.weights)
    scores = model.score(x)
    assert (scores >= 0.7).sum() == better.sum()


def test_quality_of_long_and_repeated_texts(spark):
    rows = make(spark, [(1, "good words stand here. " * 200_000), (1, "good words"), (1, "good words"), (2, "!!!! " * 10), (None, None)])
    labels = spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int")
    got = quality.classify(rows, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)


def test_marks_only_route():
    r = random.Random(8)
    data = [bytes(r.choice(b"abcd") for _ in range(40)) for _ in range(6)]
    bodies = [data[0], data[1], data[0], data[2], data[0][:20] + data[1][20:]]
    rows = np.zeros(len(bodies), repeats.ANCHOR)
    rows["doc"], rows["low"], rows["high"], rows["at"] = range(len(bodies)), 0, 20, 20
    first, others, of = repeats._earliest(rows)  # all marks are equal, the contents aren't
    assert first.tolist() == [0] and sorted(others.tolist()) == [1, 2, 3, 4]
    spans, odd = repeats.settle(rows, bodies.__getitem__, first, others, of, 20, True)
    assert [tuple(x) for x in spans.tolist()] == [(2, 0, 0, 40)] and sorted(odd.tolist()) == [1, 3, 4]
    none = np.zeros(0, np.int64)
    spans, _ = repeats.settle(rows, bodies.__getitem__, np.arange(5), none, none, 20, True)
    assert sorted((x[0], x[2], x[3]) for x in spans.tolist()) == [(2, 0, 40), (4, 0, 40)]


def test_strings_followed_through_an_index():
    r = random.Random(2)
    members = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 40))) for _ in range(8)]
    index = rindex.RunIndex(members, 5)
    tried, want = [], []
    for i, m in enumerate(members):
        for _ in range(5):
            own = bytearray(m)
            if r.random() < 0.7:
                own[r.randrange(len(own))] = ord("c")
            tried.append((i, bytes(own)))
            want.append(next((n for n in range(len(m)) if own[-1 - n] != m[-1 - n]), len(m)))
    assert index.follow(np.array([i for i, _ in tried]), [x for _, x in tried]).tolist() == want


def test_segments_are_cut_alike_everywhere():
    r = random.Random(5)
    line = bytes(r.choice(b"abcdef") for _ in range(90))
    texts = [bytes(r.choice(b"xyz") for _ in range(150)) + line + bytes(r.choice(b"uvw") for _ in range(150)) for _ in range(3)]
    for width in (1, 8, 1 << 15):
        strings = {}
        for n, data in enumerate([*texts, texts[0]]):
            found = repeats.anchors(data)
            rows = np.zeros(len(found[0]), repeats.WANT)
            for f, x in zip(("anchor", "at", "low", "high", "mark"), found, strict=True):
                rows[f] = x
            rows["doc"], rows["width"] = n, width
            seen = set()
            for row, body in repeats.cut(rows, data, 100):
                key, doc, _, at, low, high, _ = row
                assert body == data[at - high : at - low + 100] and high - low < width
                for start in range(at - high, at - low + 1):
                    assert start not in seen
                    seen.add(start)
                    strings.setdefault(data[start : start + 100], set()).add(key)
            assert seen == set(range(len(data) - 99))
        assert all(len(keys) == 1 for keys in strings.values())


def test_a_line_in_many_documents(spark):
    r = random.Random(3)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    line = words(14)
    texts = [(i, words(20) + line + words(20)) for i in range(1200)] + [(2000 + i, words(5) + line + " and the same tail of it, word by word") for i in range(30)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeats.remove_repeats(make(spark, texts).repartition(4)).collect()}
    assert got == brute_repeats(texts, 100)
    some = texts[:150] + texts[-30:]
    for shard in (300, 3000):  # anchors that are too large for an index are taken apart
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeats.remove_repeats(make(spark, some).repartition(4), shard=shard).collect()}
        assert got == brute_repeats(some, 100)


def _sliced():
    """Texts with a line that over a thousand share, and parts of them that begin or end within a few bytes of it."""
    r = random.Random(6)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    line = words(14)
    texts = [(i, words(20) + line + words(20)) for i in range(1200)]
    begins = [r.randrange(80, 125) for _ in range(80)]
    return texts, [(5000 + i, texts[i][1][a : a + 100 + r.randrange(0, 12)]) for i, a in enumerate(begins)]


def test_short_segments_are_cut_like_long_ones():
    texts, parts = _sliced()
    for width in (1, 8, 1 << 15):
        strings = {}
        for n, (_, text) in enumerate([*texts[:80], *parts]):
            data = text.encode()
            found = repeats.anchors(data)
            rows = np.zeros(len(found[0]), repeats.WANT)
            for f, x in zip(("anchor", "at", "low", "high", "mark"), found, strict=True):
                rows[f] = x
            rows["doc"], rows["width"] = n, width
            for (key, _, _, at, low, high, _), _ in repeats.cut(rows, data, 100):
                for start in range(at - high, at - low + 1):
                    strings.setdefault(data[start : start + 100], set()).add(key)
        assert all(len(keys) == 1 for keys in strings.values())


def test_parts_of_texts_with_a_line_of_many(spark):
    texts, parts = _sliced()
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeats.remove_repeats(make(spark, texts + parts).repartition(4)).collect()}
    assert got == brute_repeats(texts + parts, 100)


def test_rows_do_not_depend_on_the_numbers_that_switch_widths(spark, monkeypatch):
    texts, parts = _sliced()
    some = texts[:150] + parts
    want = brute_repeats(some, 100)
    rows = make(spark, some).repartition(4)
    named = rows.selectExpr("doc_id AS doc", "0L AS twin", "text")
    for many, held, widths in (((1 << 40, 1 << 40), 8 << 20, {1 << 15}), ((2, 1 << 40), 8 << 20, {8}), ((2, 2), 0, {1}), ((5, 100), 5000, {1 << 15, 8, 1})):
        monkeypatch.setattr(repeats, "MANY", many)
        monkeypatch.setattr(repeats, "HELD", held)
        blocks = [bytes(x.block) for x in repeats.find_segments(named, 4, 100).filter(F.col("kind") == repeats.WANTED).collect()]
        assert set(repeats.unpack(blocks, repeats.WANT)["width"].tolist()) == widths  # the switch is thrown in the tasks, too
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeats.remove_repeats(rows).collect()}
        assert got == want


def test_long_texts_in_repeats(spark):
    r = random.Random(4)
    half = "".join(r.choice("abcdefghijklmnop ") for _ in range(1_200_000))
    texts = [(1, half + half), (2, half[:500] + "!")]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in repeats.remove_repeats(make(spark, texts)).collect()}
    assert got == {1: (2_400_000, 1_200_000, 1), 2: (501, 500, 1)}


def test_code_points_on_which_tables_differ():
    lib, own, memo = {}, {}, {}
    for path in (WORDS, BYTES):
        lib[path], own[path], memo[path] = Tokenizer.from_file(path), bpe.SegmentTreeBPE(path), libtokens.LibraryTokenizer(path)
    odd = [0x558, 0xCDC, 0x209D, 0x1C89, 0xA7CB, 0x10D4A, 0x16D40, 0x378, 0x2FFF, 0xFFFE, 0x10FFFF, 0x85, 0xA0, 0x1680, 0x2028, 0x3000, 0x212B, 0x344, 0x130]
    points = sorted({*odd, *range(0, 0x3000, 7), *range(0x3000, 0x110000, 211)} - set(range(0xD800, 0xE000)))
    texts = [f"a{chr(c)}b {chr(c)}1 {chr(c)}{chr(c)}  " for c in points]
    for path in (WORDS, BYTES):
        for text, want in zip(texts, lib[path].encode_batch(texts, add_special_tokens=False), strict=True):
            ids = np.array(want.ids, "<u4").tobytes()
            assert own[path].encode(text) == ids and memo[path].encode(text) == ids, hex(ord(text[1]))
            assert own[path].decode(ids) == lib[path].decode(want.ids, skip_special_tokens=False)


def test_memo_leaves_long_keys_out():
    own = bpe.SegmentTreeBPE(BYTES)
    own.encode(("x" * 5000 + " ") * 3)
    assert all(len(k) <= 64 for m in (own.memo.pieces, own.memo.words, own.memo.spaced) for k in m)


def test_packing_of_repeated_and_null_ids(spark):
    rows = make(spark, [(1, "a b"), (1, "a b"), (None, "c"), (None, None), (2, "word " * 5000)])
    got = packing.pack_documents(rows, BYTES, capacity=512).collect()
    assert sum(r.doc_id == 1 for r in got) == 2 and sum(r.doc_id is None for r in got) == 2
    long = sorted((r.start, r.length) for r in got if r.doc_id == 2)
    assert long[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(long, long[1:], strict=False)) and {n for _, n in long[1:]} == {512}
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_tables_are_deleted_at_the_end_of_a_scope(spark):
    with store.Scope(spark) as outer:
        with store.Scope(spark) as scope:
            gone = store.table(spark.range(3).toDF("x"), "gone")
            kept = scope.keep(gone.filter("x > 0"), "kept")
        assert len(outer.made) == 1 and kept.count() == 2
        paths = outer.made.copy()
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert not any((p := jvm.org.apache.hadoop.fs.Path(x)).getFileSystem(conf).exists(p) for x in paths)
    assert spark.conf.get(store.CLEANUP, "false") == "false"


def test_cosines_of_large_and_tiny_vectors():
    for size in (1e200, 1e-200, 1e-160, 1e155, 5e-324, 1e308):
        got = ann.cosine(np.array([[size, size]]), np.array([[1.0, 2.0]]))[0]
        assert abs(got - 3 / np.sqrt(10)) < 1e-12, (size, got)
    assert abs(ann.cosine(np.array([[1e-300, 1e-300]]), np.array([[1e300, 2e300]]))[0] - 3 / np.sqrt(10)) < 1e-12


def test_only_texts_without_words_are_like_each_other_there():
    r = random.Random(6)
    texts = [" ".join(r.choice("abcdefgh") * r.randrange(1, 9) for _ in range(r.randrange(1, 9))) for _ in range(4000)]
    sig, none = minhash.signatures(texts), minhash.signatures(["", " ", None])
    assert (sig != minhash.EMPTY).all() and (none == minhash.EMPTY).all()


def test_fingerprints_follow_the_order_over_many_ranges(spark):
    low = -(1 << 63)
    rows = [(i, f"text number {i} of some") for i in range(300)] + [(None, "no id here"), (low, "the smallest id"), (7, "another seven")]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = minhash.fingerprints(make(spark, rows).repartition(6)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    key = {t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0] for i, t in rows if i == 7}
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, key.get(x[1], 0)), reverse=True)
    texts = [t for _, t in order]
    want = {}
    for n, (i, t) in enumerate(order):
        edit = minhash.edited(t, texts[(n + 1) % len(texts)])
        want.setdefault(i, set()).add(hashlib.sha256(edit.encode()).hexdigest())
    assert len(got) == len(rows)
    for i, some in want.items():
        assert {x.edited_sha256 for x in got if x.doc_id == i} == some
