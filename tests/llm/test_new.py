"""Codes of vectors, languages, divergence of sources: brute-force twins and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from proofline.llm import divergence, langid, vcodes

DATA = "/root/testdata/sf0.01"


def brute_codes(rows, parts, entries, rounds):
    """By vec_id order of (vec_id, vector, label): code, error; the digest. Whole numbers of any size; one length."""
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-len(kept[0][1]) // parts)
    cut = [[(v + [0] * (parts * width - len(v)))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, kept[n][0] or 0, b"".join(int(x).to_bytes(8, "little", signed=True) for part in cut[n] for x in part)))
    books = [[cut[n][p] for n in order[:entries]] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for v in cut:
                own.setdefault(near(v[p], books[p])[1], []).append(v[p])
            for e, some in own.items():
                books[p][e] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    return [(kept[n][0], "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), kept[n][2]) for n, f in enumerate(found)], digest


def codes_of(spark, rows, **how):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string, width int").repartition(3)
    return vcodes.compress(table, **how)


def test_codes_equal_brute_force(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=7).tolist(), int(r.integers(0, 3))) for i in range(60)]
    rows += [(None, r.normal(size=7).tolist(), None), (3, r.normal(size=7).tolist(), None), (3, rows[3][1], 1), (70, None, 1), (71, [1.0] * 6 + [None], 1), (72, [math.nan] * 7, 2), (73, [math.inf] * 7, 2)]
    got = codes_of(spark, [(*x, "x", 1) for x in rows], parts=2, entries=9, rounds=3).collect()
    want, digest = brute_codes(rows, 2, 9, 3)
    sums = Counter()
    for _, _, error, lab in want:
        sums[lab] += error
    key = lambda x: tuple((v is None, str(v)) for v in x)
    assert sorted([(x.vec_id, x.code, x.error, x.label_error) for x in got], key=key) == sorted([(i, c, e, sums[lab]) for i, c, e, lab in want], key=key)
    assert {x.codebooks_sha256 for x in got} == {digest}


@pytest.mark.parametrize("size", [3e5, 1e8, 2e15])
def test_codes_of_large_numbers_stay_exact(spark, size):
    r = np.random.default_rng(3)
    rows = [(i, (size * r.normal(size=4)).tolist(), 0) for i in range(30)]
    got = codes_of(spark, [(*x, "x", 1) for x in rows], parts=2, entries=4, rounds=2).collect()
    want, digest = brute_codes(rows, 2, 4, 2)
    fits = lambda n: n if n <= vcodes.MOST else None
    total = [fits(e) for _, _, e, _ in want]
    whole = None if None in total else fits(sum(total))
    assert sorted((x.vec_id, x.code, x.error, x.label_error) for x in got) == sorted((i, c, fits(e), whole) for i, c, e, _ in want)
    assert {x.codebooks_sha256 for x in got} == {digest}


def test_codes_of_odd_tables(spark):
    assert codes_of(spark, []).count() == 0 and codes_of(spark, []).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert codes_of(spark, [(1, None, 1, "x", 1)]).count() == 0
    got = {x.vec_id: x for x in codes_of(spark, [(1, [], 1, "x", 1), (2, [1.0, 2.0], 1, "x", 1), (3, [1.0, 2.0, 3.0, 4.0, 5.0], 1, "x", 1)]).collect()}
    assert all(x.code == "00000000" and x.error == 0 and x.label_error == 0 for x in got.values()) and len({x.codebooks_sha256 for x in got.values()}) == 3
    huge = {x.vec_id: x for x in codes_of(spark, [(1, [1e300, 0.0], 1, "x", 1), (2, [0.0, -1e300], 2, "x", 1)], entries=1).collect()}
    assert huge[1].error is None and huge[1].label_error is None
    with pytest.raises(ValueError):
        codes_of(spark, [], entries=257)


def test_labels_of_all_sizes_get_their_sums(spark):
    rows = spark.createDataFrame([(i, i % 5000 if i % 3 else None, 1) for i in range(9000)], "vec_id long, label int, error long")
    want = Counter(i % 5000 if i % 3 else None for i in range(9000))
    assert {(x.vec_id, x.label_error) for x in vcodes.with_label_errors(rows).collect()} == {(i, want[i % 5000 if i % 3 else None]) for i in range(9000)}


def test_codes_equal_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    want = con.sql(vcodes.oracle("embeddings"))
    found = vcodes.compress(spark.read.parquet(f"{DATA}/embeddings.parquet")).select(*want.columns)
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())


def brute_chances(counts, order, signs):
    """Interpolated Kneser-Ney by its definition, with dictionaries: the chance of a sign after those before it."""
    least = 1 / (signs + 2)
    grams = [Counter() for _ in range(order)]
    for word, n in counts.items():
        s = "^" + word + "^"
        for at in range(1, len(s)):
            for k in range(min(order, at + 1)):
                grams[k][at - k == 0, s[at - k : at + 1]] += n
    numbers = []
    for k in range(order):
        left = Counter(g[1:] for begins, g in grams[k + 1]) if k + 1 < order else {}
        numbers.append({g: c if begins or k + 1 == order else left[g] for (begins, g), c in grams[k].items()})
    cuts = []
    for own in numbers:
        once, twice = (sum(c == x for c in own.values()) for x in (1, 2))
        cuts.append(once / (once + 2 * twice) if once else 0.5)

    def chance(before, sign):
        k = len(before)
        below = chance(before[1:], sign) if k else least
        after = [c for g, c in numbers[k].items() if g[:-1] == before]
        if not after:
            return below
        return max(0, numbers[k].get(before + sign, 0) - cuts[k]) / sum(after) + cuts[k] * len(after) / sum(after) * below

    def cost(word):
        s = "^" + word + "^"
        return -sum(math.log(chance(s[max(0, at - order + 1) : at], s[at])) for at in range(1, len(s)))

    return chance, cost


def test_models_are_kneser_ney():
    counts = {"a": Counter({"the": 3, "then": 1, "at": 2, "that": 5, "hat": 1}), "b": Counter({"le": 2, "la": 3, "chat": 1, "alle": 2})}
    model = langid.learn(counts)
    signs = len(set("".join(w for own in counts.values() for w in own)))
    some = ["the", "hen", "zz", "chatte", "a", "lallelle", "thatthat", "é"]
    got = model.costs(some)
    for i, lang in enumerate(model.langs):
        chance, cost = brute_chances(counts[lang], langid.ORDER, signs)
        assert np.allclose(got[:, i], [cost(w) for w in some], rtol=1e-5)
        for before in ("", "^", "^t", "th", "^the", "zq"):
            alphabet = sorted(set("".join(w for own in counts.values() for w in own)))
            assert sum(chance(before, s) for s in [*alphabet, "^"]) + chance(before, "?") == pytest.approx(1)


def test_words_of_long_texts_are_those_of_the_whole(monkeypatch):
    text = "Thé  quick, brown fox1jumps " * 30 + "x" * 200 + " naïve éte 日本語"
    whole = langid.words(text)
    monkeypatch.setattr(langid, "BLOCK", 256)
    assert langid.words(text) == whole and whole["thé"] == 30 and whole["éte"] == 1 and whole["x" * 64] == 3


def test_languages_on_rows_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert sum(held) / len(held) > 0.99
    assert sum(r.rejected for r in got) < 0.02 * len(got)


def test_languages_of_odd_rows(spark, docs, empty, monkeypatch):
    assert langid.identify(empty).count() == 0
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(got) == docs.count() and {r.lang_pred for r in got.values()} == {"en", "und"}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, r in got.items():
        none = not re.search(r"[^\W\d_]", texts[i] or "")
        assert (r.lang_pred == "und") == none and (r.score == 0) == none and not (none and r.rejected)
    unlabelled = docs.withColumn("lang", docs["source"].substr(9, 1).cast("string")).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}
    a, b = [i for i in range(100, 120) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    rows = [(None, "das ist ein text", "de"), (a, "this is a text " * 40, "en"), (a, "this is a text " * 40, "en"), (b, "dies ist ein wort " * 40, "de"), (5, "other words of this kind", "en"), (7, "zcela jinak " * 9, None), (8, "ЖЖЖ ЩЩ", "en")]
    few = spark.createDataFrame([(i, t, lang, 1, 2) for i, t, lang in rows], "doc_id long, text string, lang string, score int, nats int")
    some = langid.identify(few).collect()
    assert len(some) == 7 and {r.doc_id: r.lang_pred for r in some if r.doc_id in (a, b)} == {a: "en", b: "de"}
    assert [r.lang_pred for r in some if r.doc_id is None] == ["de"] and [r.held_out for r in some if r.doc_id is None] == [False]
    # a bound that no text fits in leaves each language its first text
    assert set(langid.train(few, chars=1).langs) == {"de", "en"} and langid.train(few, langs=1).langs == ["en"]
    # a table of words' costs that is emptied all the time gives the same
    monkeypatch.setattr(langid, "MEMO", 3)
    monkeypatch.setattr(langid, "SLICE", 2)
    model = langid.train(few)
    texts = [t for _, t, _ in rows]
    one = langid.entropies(iter(texts), model, {}, [])[0]
    monkeypatch.undo()
    assert np.allclose(one, langid.entropies(iter(texts), model, {}, [])[0])


def brute_divergence(rows, least, top):
    """rows: text, lang, source."""
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", fold(t)), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        kept = {t for t, n in Counter(t for d in own for t in set(d[0])).items() if n >= least}
        counts = {s: Counter(t for d in own if d[2] == s for t in d[0] if t in kept) for s in {d[2] for d in own}}
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        q, p = share(whole), {s: share(c) for s, c in counts.items()}
        excess = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = sorted((-sum(excess(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s)
            out += [(lang, s, "pair", o, -v, n + 1) for n, (v, _, o) in enumerate(pairs)]
            best = sorted((-excess(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, n + 1) for n, (v, _, t) in enumerate(best[:top])]
    return sorted(out)


def test_divergence_equals_brute_force(spark, corpus, monkeypatch):
    signs = [(None, None), ("en", "a"), ("en", "b"), ("en", None), ("de", "a"), ("de", "é"), ("de", "z"), ("fr", "only"), ("en", "\U0001f642")]
    rows = [(t, *signs[i % len(signs)]) for i, t in enumerate([t for _, t in corpus] * 2)] + [("1 2 3", "xx", "p"), (None, "xx", "q"), ("", "xx", "r")]
    table = spark.createDataFrame([(i % 7 or None, t, lang, s, 1, 2, "x") for i, (t, lang, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, bucket int, g int, term string").repartition(5)
    want = brute_divergence(rows, 3, 200)
    assert sorted(map(tuple, divergence.diverge(table).collect())) == want
    assert sorted(map(tuple, divergence.diverge(table, top=2).collect())) == brute_divergence(rows, 3, 2)
    # small blocks, tables and buckets
    for name, value in (("HELD", 5), ("BLOCK", 50), ("ROWS", 40), ("TILE", 12), ("PAIRS", 9)):
        monkeypatch.setattr(divergence, name, value)
    texts = [t for t, _, _ in rows]
    assert all([w for some in divergence.terms((t or "").encode()) for w in some] == re.findall(rb"[a-z\x80-\xff]+", (t or "").encode().lower()) for t in texts)
    group, term, n = np.array([0, 1, 2, 0]), np.array([0, 0, 3, 4]), np.array([5, 2, 1, 7])
    small = dict(divergence.pair_rows((group, term, n), 5, np.array([17, 7, 6])))
    monkeypatch.undo()
    large = dict(divergence.pair_rows((group, term, n), 5, np.array([17, 7, 6])))
    assert {g: x.tolist() for g, x in small.items()} == {g: x.tolist() for g, x in large.items()}


def test_divergence_of_an_empty_table(spark, empty):
    assert divergence.diverge(empty).count() == 0


def test_shares_are_exact_for_large_counts():
    n, total = np.array([1, 10**14, 8 * 10**15, 9 * 10**15 - 1]), np.array(9 * 10**15)
    assert divergence.share(n, total).tolist() == [1 + 10**9 * int(x) // int(total) for x in n]


def test_divergence_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.sql(divergence.oracle("documents"))
    found = divergence.diverge(spark.read.parquet(f"{DATA}/documents.parquet")).select(*want.columns)
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())


