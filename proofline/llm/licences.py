"""Operator 4: licence scan, in DataFrame functions alone.

Each distinct line, paragraph and whole text of a document is a place where a licence may stand.
Places and templates are normalised (lower case, runs of anything but letters and digits as one
space), and compared by the Dice coefficient of their sets of word bigrams. A coefficient of t
bounds the sizes: t b / (2 - t) <= a <= b (2 - t) / t. So a template of b bigrams is listed under
each size it can match, and a place meets only the templates listed under its own. Places whose
count of different words already exceeds every bound are left out before bigrams are made.

Notices inside longer places and whole licence texts (``licence_texts``) are found as passages. A
passage of Dice t shares at least t b / (2 - t) bigrams with its template, so a document that can
hold one has one of the template's b - t b / (2 - t) + 1 longest bigrams: these are the index by
which templates meet documents. The best passage begins and ends where a run of shared bigrams
does, and holds that many shared ones within the template's size bound; starts where no passage of that
size does are out at once. From each other start, one fold over the bigrams after it counts
different and shared ones (a bigram is new where it stood last before the start), and gives the ends at which the
shared ones grow; an end that adds none, or a start before another that shares as many, is never the better choice. Starts
are worked on by ``STARTS`` at a time, so the memory doesn't grow with a text. Of
passages that overlap, the one with more shared bigrams counts, of equal ones the more alike; a
passage that lies in a place found already, or around one of more than half its words, doesn't
count again.

Results for odd input: null and empty texts, and places of fewer than two words, match nothing;
templates of fewer than two words are never found; a place counts for its best template, of equal
ones the first by name; rows without an id are one document of the id null; of rows that share an id, equal places
count once, and passages once for each different text; texts of any length are read whole; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm import store

DICE = 0.8

#: Short notices by which works name their licence.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

#: Starts of passages that are worked on together; bigrams of a bin by which they meet the text.
STARTS, BIN = 64, 4096
#: Rows of a table that goes to every task.
SMALL = 1_000_000
#: Whole licence texts: files named by their licence.
TEXTS = Path(__file__).parent / "licence_texts"

SIGNS, GAP = r"[^\p{L}\p{N}]+", r"\n[ \t\r]*\n"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), SIGNS, " "))


def pairs(words: Column) -> Column:
    """The neighbouring pairs in an array of words, in order."""
    two = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) > 1, two).otherwise(F.array().cast("array<string>"))


def bigrams(words: Column) -> Column:
    """The set of neighbouring pairs in an array of words."""
    return F.array_distinct(pairs(words))


def listed(templates: DataFrame, dice: float) -> DataFrame:
    """Templates (licence, text) under every size of bigram set that they can match: (size, licence, wanted)."""
    own = templates.select("licence", bigrams(F.split(normalised(F.col("text")), " ")).alias("wanted")).filter(F.size("wanted") > 0)
    b = F.size("wanted")
    low, high = F.ceil(b * dice / (2 - dice) - 1e-9), F.floor(b * (2 - dice) / dice + 1e-9)
    return own.select(F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("size"), "licence", "wanted")


def row_key() -> Column:
    """What tells rows apart: the id and the text."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("text", F.lit(""))))


def spans(texts: DataFrame, places: DataFrame) -> DataFrame:
    """key, first, last: where the places found (key, place) lie in their text, by the numbers of words."""
    cut = lambda kind, parts: texts.select("key", F.posexplode(parts).alias("nth", "place")).withColumn("kind", F.lit(kind))
    rows = cut(0, F.split("text", "\n")).unionByName(cut(1, F.split("text", GAP))).unionByName(cut(2, F.array("text")))
    # places are told apart by their hashes, so no text is sorted or sent
    rows = rows.select("key", "kind", "nth", F.xxhash64("place").alias("place"), F.size(F.filter(F.split(normalised(F.col("place")), " "), lambda w: w != "")).alias("n"))
    ends = F.sum("n").over(Window.partitionBy("key", "kind").orderBy("nth"))
    return rows.withColumn("end", ends).join(places.select("key", F.xxhash64("place").alias("place")), ["key", "place"], "left_semi").select("key", (F.col("end") - F.col("n")).alias("first"), (F.col("end") - 1).alias("last"))


def passages(docs: DataFrame, templates: DataFrame, places: DataFrame, dice: float) -> DataFrame:
    """doc_id, licence, dice of passages inside longer texts that are none of the places found (key, place). docs: key, doc_id, text."""
    b = F.size("wanted")
    least, most = F.ceil(b * dice / (2 - dice) - 1e-9).cast("int"), F.floor(F.col("n") * (2 - dice) / dice + 1e-9).cast("int")
    own = templates.select("licence", pairs(F.split(normalised(F.col("text")), " ")).alias("all")).select("licence", F.size("all").alias("n"), F.array_distinct("all").alias("wanted"))
    own = own.filter(b > 0).select("*", b.alias("b"), least.alias("least"), most.alias("most"), F.xxhash64("licence", "wanted").alias("template"))
    rare = F.slice(F.array_sort(F.transform("wanted", lambda x: F.struct((-F.length(x)).alias("minus"), x.alias("pair")))), F.lit(1), b - F.col("least") + 1)
    index = own.select("template", F.explode(rare).alias("rare")).select("template", F.col("rare.pair").alias("pair"))
    wanted, bounds = own.select("template", F.explode("wanted").alias("pair")), own.select("template", "licence", "b", "least", "most")
    sent = F.broadcast if own.agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0] <= SMALL else lambda df: df
    texts, words = docs.filter("text is not null").select("key", "doc_id", "text"), F.split(normalised(F.col("text")), " ")
    grams = texts.select("key", words.alias("words")).select("key", F.explode(pairs(F.col("words"))).alias("pair"))
    meet = store.table(grams.join(sent(index), "pair").select("key", "template").distinct(), "meet")
    few = meet.count() <= SMALL
    keys = meet.select("key").distinct()
    # before the words are taken apart, which costs most; rows that repeat count once
    near = store.table(texts.join(F.broadcast(keys) if few else keys, "key").dropDuplicates(["key"]), "near")
    of = lambda some: near.join(F.broadcast(some) if few else some, "key", "left_semi")  # noqa: E731  (no more keys than ``meet`` has)
    grams = lambda texts: texts.select("key", words.alias("words")).select("key", F.posexplode(pairs(F.col("words"))).alias("pos", "pair"))
    hits = grams(near).join(sent(wanted), "pair").join(F.broadcast(meet) if few else meet, ["key", "template"]).select("key", "template", "pos").join(sent(bounds), "template")
    # a run's first bigram, from which enough shared ones lie within reach
    run = Window.partitionBy("key", "template").orderBy("pos")
    hits = store.table(hits.withColumns({"before": F.lag("pos").over(run), "nth": F.row_number().over(run)}), "hits")
    far = hits.select("key", "template", (F.col("nth") - F.col("least") + 1).alias("nth"), F.col("pos").alias("reach"))
    starts = hits.filter(F.col("before").isNull() | (F.col("before") < F.col("pos") - 1)).join(far, ["key", "template", "nth"]).filter(F.col("reach") - F.col("pos") < F.col("most"))
    gap = F.coalesce(F.col("pos") - F.lag("pos").over(run) > F.col("most"), F.lit(True))
    starts = starts.withColumn("island", F.sum(F.when(gap, 1).otherwise(0)).over(run))
    piece = F.floor((F.row_number().over(Window.partitionBy("key", "template", "island").orderBy("pos")) - 1) / STARTS)
    chunks = starts.withColumn("piece", piece).groupBy("key", "template", "island", "piece", "licence", "b", "most").agg(F.array_sort(F.collect_list("pos")).alias("starts"))
    low, high = F.get("starts", F.lit(0)), F.element_at("starts", -1) + F.col("most")
    chunks = store.table(chunks.withColumns({"low": low, "high": high}), "starts")
    bins = chunks.select("key", "template", "island", "piece", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / BIN).cast("int"), F.floor(F.col("high") / BIN).cast("int"))).alias("bin"))
    around = grams(of(chunks.select("key").distinct())).withColumn("bin", F.floor(F.col("pos") / BIN).cast("int"))
    around = around.join(bins, ["key", "bin"]).filter(F.col("pos").between(F.col("low"), F.col("high")))
    last = F.lag("pos").over(Window.partitionBy("key", "template", "island", "piece", "pair").orderBy("pos"))
    around = around.withColumn("last", F.coalesce(last, F.lit(-1))).join(sent(wanted.withColumn("hit", F.lit(True))), ["template", "pair"], "left")
    own = Window.partitionBy("key", "template", "island", "piece").orderBy("pos")
    around = around.withColumn("over", F.when(F.col("hit") & F.lead("hit").over(own).isNull(), F.col("pos")))
    run_end = F.min("over").over(Window.partitionBy("key", "template", "island", "piece").orderBy(F.desc("pos")))  # of the bigrams from here on
    line = F.struct("pos", "last", F.when(F.col("hit"), F.col("run_end")).alias("run"))
    lines = around.withColumn("run_end", run_end).groupBy("key", "template", "island", "piece").agg(F.array_sort(F.collect_list(line)).alias("line"))
    rows = store.table(chunks.join(lines, ["key", "template", "island", "piece"]).select("key", "licence", "b", "most", "low", "line", "starts"), "lines")
    start = F.col("start")
    found = rows.select("*", F.explode("starts").alias("start")).select("key", "licence", "start", F.inline(ends(F.slice("line", start - F.col("low") + 1, F.col("most")), start, F.col("most"), F.col("b"), dice)))
    # of starts with one end, those whose every later start shares less
    later = F.max("shared").over(Window.partitionBy("key", "licence", "end").orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, -1))
    found = store.table(found.withColumn("later", later).filter("later is null or later < shared").select("key", "licence", "start", "end", "shared", "dice"), "passages")
    some = spans(of(found.select("key").distinct()), places)
    held = some.select(F.col("key").alias("of"), "first", "last")
    inside = (F.col("start") >= F.col("first")) & (F.col("end") + 1 <= F.col("last"))
    outside = (F.col("start") <= F.col("first")) & (F.col("end") + 1 >= F.col("last")) & (F.col("end") + 2 - F.col("start") < 2 * (F.col("last") - F.col("first") + 1))
    found = found.join(held, (F.col("key") == F.col("of")) & (inside | outside), "left_anti")
    ranked = F.array_sort(F.collect_set(F.struct((-F.col("shared")).alias("shared"), (-F.col("dice")).alias("minus"), "licence", "start", "end")))
    free = lambda taken, x: ~F.exists(taken, lambda t: (t["start"] <= x["end"]) & (x["start"] <= t["end"]))
    kept = F.aggregate(F.slice("ranked", 2, F.size("ranked")), F.slice("ranked", 1, 1), lambda taken, x: F.when(free(taken, x), F.concat(taken, F.array(x))).otherwise(taken))
    kept = found.groupBy("key").agg(ranked.alias("ranked")).select("key", F.explode(kept).alias("one"))
    return kept.join(near.select("key", "doc_id"), "key").select("doc_id", F.col("one.licence").alias("licence"), (-F.col("one.minus")).alias("dice"))


def ends(line: Column, start: Column, most: Column, b: Column, dice: float) -> Column:
    """An array of (end, dice, shared): where passages from ``start`` on may end. line: the bigrams from the start on, as many as a passage may have.

    The n-th bigram that stood nowhere between the start and itself is the n-th different one, and the n-th of these that are shared the n-th
    shared one. A run's last of those is where the shared ones have grown, and a passage may end with the run.
    """
    new = F.filter(line, lambda x: x["last"] < start)
    shared = F.filter(F.transform(new, lambda x, i: F.struct(x["run"].alias("run"), (i + 1).alias("different"))), lambda x: x["run"].isNotNull())
    shared = F.transform(shared, lambda x, i: F.struct(x["run"].alias("end"), (2.0 * (i + 1) / (x["different"] + b)).alias("dice"), (i + 1).alias("shared")))
    last = F.zip_with(shared, F.slice(shared, F.lit(2), most), lambda x, after: F.when((x["dice"] >= dice) & (x["end"] < start + most) & ~x["end"].eqNullSafe(after["end"]), x))
    return F.filter(last, lambda x: x.isNotNull())


def scan(docs: DataFrame, templates: DataFrame | None = None, dice: float = DICE) -> DataFrame:
    """doc_id, licence, dice, n_places: every licence found in a document, its best coefficient and where often."""
    spark = docs.sparkSession
    if templates is None:
        templates = spark.createDataFrame(sorted(TEMPLATES.items()), "licence string, text string")
        whole = [(f.stem, f.read_text()) for f in sorted(TEXTS.glob("*.txt"))]
        every = templates.union(spark.createDataFrame(whole, "licence string, text string"))
    else:
        every = templates
    index = listed(templates, dice)
    bounds = index.agg(F.coalesce(F.max("size"), F.lit(0)).alias("most"), F.coalesce(F.sum("size"), F.lit(0)).alias("all")).first()
    places = F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", GAP), F.array("text")))
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("key", row_key())
    words = docs.select("key", "doc_id", F.explode(places).alias("place")).select("key", "doc_id", "place", F.split(normalised(F.col("place")), " ").alias("words"))
    # a set of bigrams has at least as many members as there are different words, but one
    near = words.filter((F.size("words") > 1) & (F.size(F.array_distinct("words")) - 1 <= bounds["most"]))
    found = near.select("key", "doc_id", "place", bigrams(F.col("words")).alias("found")).withColumn("size", F.size("found"))
    small = bounds["all"] <= SMALL  # bigrams in the index
    both = found.join(F.broadcast(index) if small else index, "size")
    shared = F.size(F.array_intersect("found", "wanted"))
    scored = both.withColumn("dice", 2.0 * shared / (F.col("size") + F.size("wanted"))).filter(F.col("dice") >= dice)
    best = store.table(scored.groupBy("key", "doc_id", "place").agg(F.min(F.struct((-F.col("dice")).alias("minus"), "licence")).alias("best")), "places")
    one = best.select("doc_id", "place", F.col("best.licence").alias("licence"), (-F.col("best.minus")).alias("dice")).distinct().drop("place")
    both = one.unionByName(passages(docs, every, best.select("key", "place"), dice))
    return both.groupBy("doc_id", "licence").agg(F.max("dice").alias("dice"), F.count("*").alias("n_places"))


def oracle(table: str, dice: float = DICE) -> str:
    """DuckDB SQL for ``scan`` with the templates above."""
    rows = ", ".join(f"('{k}', '{v}')" for k, v in sorted(TEMPLATES.items()))
    norm = lambda column: f"trim(regexp_replace(lower({column}), '{SIGNS}', ' ', 'g'))"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
        WITH t AS (SELECT licence, {pairs} AS wanted FROM (SELECT licence, string_split({norm("text")}, ' ') AS w FROM (VALUES {rows}) v(licence, text))),
        p AS (SELECT DISTINCT doc_id, place FROM (SELECT doc_id, unnest(list_concat(string_split(text, chr(10)), string_split_regex(text, '{GAP}'), [text])) AS place FROM {table} WHERE text IS NOT NULL)),
        f AS (SELECT doc_id, place, {pairs} AS found FROM (SELECT doc_id, place, string_split({norm("place")}, ' ') AS w FROM p)),
        s AS (SELECT doc_id, licence, place, 2.0::DOUBLE * len(list_intersect(found, wanted)) / (len(found) + len(wanted)) AS dice FROM f, t
              WHERE len(found) BETWEEN ceil(len(wanted) * {dice}::DOUBLE / (2 - {dice}::DOUBLE) - 1e-9) AND floor(len(wanted) * (2 - {dice}::DOUBLE) / {dice}::DOUBLE + 1e-9))
        SELECT doc_id, licence, max(dice) AS dice, count(*) AS n_places
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, place ORDER BY dice DESC, licence) AS nth FROM s WHERE dice >= {dice}::DOUBLE)
        WHERE nth = 1 GROUP BY doc_id, licence
    """
