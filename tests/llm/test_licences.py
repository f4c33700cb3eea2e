"""Licence passages against brute force; rows without ids, ids with several texts, long copies, clashing names."""

import random
import re
import time

from proofline.llm import licences

DICE = 0.8


def words(text):
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def grams(w):
    return [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def brute(text, templates, places=()):
    """Best passages that don't overlap: (licence, dice), by the rule written out."""
    own, found = grams(words(text)), []
    for name, template in templates.items():
        wanted = set(grams(words(template)))
        n, b = len(grams(words(template))), len(wanted)
        most = int(n * (2 - DICE) / DICE + 1e-9)
        hit = [g in wanted for g in own]
        for s in range(len(own)):
            if hit[s] and not (s and hit[s - 1]):
                for e in range(s, min(len(own), s + most)):
                    if hit[e] and not (e + 1 < len(own) and hit[e + 1]):
                        some = set(own[s : e + 1])
                        dice = 2 * len(some & wanted) / (len(some) + b)
                        if dice >= DICE:
                            found.append((-len(some & wanted), -dice, name, s, e))
    taken = []
    for x in sorted(found):
        if all(x[4] < t[3] or t[4] < x[3] for t in taken) and not any(a <= x[3] and x[4] + 1 <= b for a, b in places):
            taken.append(x)
    return sorted((x[2], round(-x[1], 6)) for x in taken)


def passages(spark, rows, templates):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", licences.row_key())
    places = docs.select("key", docs["text"].alias("place")).filter("false")
    table = spark.createDataFrame(list(templates.items()), "licence string, text string")
    got = {}
    for r in licences.passages(docs, table, places, DICE).collect():
        got.setdefault(r.doc_id, []).append((r.licence, round(r.dice, 6)))
    return {k: sorted(v) for k, v in got.items()}


def test_passages_equal_brute_force(spark, monkeypatch):
    r = random.Random(3)
    alphabet = [f"w{i}" for i in range(14)]
    some = lambda n: [r.choice(alphabet) for _ in range(n)]
    templates = {"a": " ".join(some(6)), "b": " ".join(some(12)), "c": " ".join(some(25)), "d": "one"}
    rows = []
    for i in range(60):
        text = some(r.randrange(0, 12))
        for _ in range(r.randrange(0, 4)):
            copy = templates[r.choice("abc")].split()
            for _ in range(r.randrange(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(alphabet)
            if r.random() < 0.3:
                del copy[r.randrange(len(copy))]
            text += copy + some(r.randrange(0, 6))
        rows.append((i, " ".join(text)))
    want = {i: found for i, t in rows if (found := brute(t, templates))}
    assert len(want) > 30
    assert passages(spark, rows, templates) == want
    monkeypatch.setattr(licences, "STARTS", 2)
    monkeypatch.setattr(licences, "BIN", 5)
    assert passages(spark, rows, templates) == want


def test_rows_without_an_id_and_ids_with_several_texts(spark):
    mit, isc = "one two three. Released under the MIT License, thanks", "one two three. Released under the ISC License, thanks"
    text = (licences.TEXTS / "MIT.txt").read_text()
    rows = [(None, f"before {text} after"), (None, mit), (7, mit), (7, isc), (7, isc), (8, mit), (None, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, key string, licence int, pair int")
    got = sorted(((r.doc_id or 0, r.licence), r.n_places) for r in licences.scan(docs).collect())
    assert got == [((0, "MIT"), 2), ((7, "ISC"), 1), ((7, "MIT"), 1), ((8, "MIT"), 1)]


def test_passages_inside_a_place_or_around_it_count_once(spark):
    line = "Released under the MIT License."
    docs = spark.createDataFrame([(1, f"{line}\nmore words here"), (2, f"a b c {line} d e\n{line}"), (3, f"x. {line}\n{line}")], "doc_id long, text string")
    got = {(r.doc_id, r.licence): r.n_places for r in licences.scan(docs).collect()}
    assert got == {(1, "MIT"): 1, (2, "MIT"): 2, (3, "MIT"): 3}  # two lines, and the whole text


def test_edited_copies_of_a_long_licence_in_one_document(spark):
    r = random.Random(1)
    text = (licences.TEXTS / "GPL-2.0.txt").read_text().split()

    def copy():
        own = list(text)
        for i in r.sample(range(len(own)), 160):
            own[i] = "changed"
        return " ".join(own)

    filler = " ".join(f"word{i} of the software" for i in range(900))
    docs = spark.createDataFrame([(1, f"{copy()} {filler} {copy()} {filler} {copy()}")], "doc_id long, text string")
    licences.scan(docs).collect()  # compiled
    began = time.time()
    got = [(r.licence, r.n_places) for r in licences.scan(docs).collect()]
    assert got == [("GPL-2.0", 3)] and time.time() - began < 60
