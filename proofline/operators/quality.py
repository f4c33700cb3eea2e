"""Data quality: outliers in print, closed sets of words, cells, repeated and missing rows."""

from __future__ import annotations

from difflib import SequenceMatcher
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.exact import exact_text, printed_decimals
from proofline.functions.sizes import short

# Thresholds of the checks.
RATIO, LEAD, ONE_EDIT_FROM = 0.88, 0.04, 5
#: Likeness down to which choices can matter: to words of a few letters, which one edit changes most, and to others.
NEAR_SHORT, NEAR, SHORT_WORD = 0.76, 0.84, 8
MIN_SCORE, INK_FLOOR, INK_FACTOR = 0.90, 15, 4


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def alike(a: str, b: str) -> Column:
    """How alike two words are, as the share of matching runs of letters; nothing built in counts these."""
    return F.pandas_udf(_ratio, "double")(a, b)


def layouts(lengths: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """(word's length, choice's length, segment, its start and size, shift) by which words and choices that may be alike must meet.

    Words alike by t share all but k = (1 - t) (a + b) of their letters, in order. So of k + 1 segments of the choice one stands in the word whole, moved
    by k places at most. Short words, which one edit makes less alike, are compared further down.
    """
    out = []
    for b in lengths:
        for a in range(1, 2 * b + 2):
            t = NEAR_SHORT if a <= SHORT_WORD else NEAR
            k = int((1 - t) * (a + b) + 1e-9)
            if abs(a - b) <= k:
                cuts = [i * b // (k + 1) for i in range(k + 2)]
                for i, (begin, end) in enumerate(pairwise(cuts)):
                    out += [(a, b, i, begin, end - begin, d) for d in range(-k, k + 1) if 0 <= begin + d and begin + d + end - begin <= a] if end > begin else [(a, b, i, 0, 0, 0)]
    return out


def survivors(words: DataFrame, choices: DataFrame) -> DataFrame:
    """word, choice: the pairs that may be alike enough, or nearly, to matter; found by segments, so that words and choices are never crossed whole.

    A segment without letters, as of choices shorter than their number of segments, is met by all words of the length it stands for.
    """
    spark = words.sparkSession
    lengths = [r[0] for r in choices.select(F.length("choice").alias("n")).distinct().collect()]
    plan = short(spark.createDataFrame(layouts(sorted(lengths)), "a int, b int, i int, begin int, size int, shift int"), 5_000_000)
    cut = lambda text, at: F.substr(text, at + 1, F.col("size"))
    left = words.withColumn("a", F.length("word")).join(plan, "a").select("word", "a", "b", "i", cut(F.col("word"), F.col("begin") + F.col("shift")).alias("segment")).distinct()
    right = choices.withColumn("b", F.length("choice")).join(plan.select("a", "b", "i", "begin", "size").distinct(), "b").select("choice", "a", "b", "i", cut(F.col("choice"), F.col("begin")).alias("segment"))
    both = left.join(right, ["a", "b", "i", "segment"]).select("word", "choice").distinct()
    # a distance of d edits leaves at most a + b - d letters in common, counted twice
    most = F.length("word") + F.length("choice")
    least = F.when(F.length("word") <= SHORT_WORD, NEAR_SHORT).otherwise(NEAR)
    return both.filter(F.levenshtein("word", "choice") <= (1 - least) * most + 1e-9)


def closest(words: DataFrame, choices: DataFrame) -> DataFrame:
    """word, choice, how: each word's choice from a closed set, or none.

    An exact hit wins; otherwise the most alike choice (of equals the later by letters) counts if
    it is alike enough, or one edit away for words of five letters or more, and clearly ahead. Only pairs that can matter to this are compared: those of at least the
    likeness of a choice that counts, less the lead. The rare words whose best choice is less alike than that, though one edit away, meet all choices.
    """
    words, choices = words.select("word").filter("word is not null").distinct(), choices.select("choice").filter("choice is not null").distinct()
    exact = words.join(choices, F.col("word") == F.col("choice"), "left_semi")
    rest = words.join(exact, "word", "left_anti")
    pairs = survivors(rest, choices).withColumn("ratio", alike("word", "choice"))
    best = pairs.groupBy("word").agg(F.max("ratio").alias("best"), F.max(F.when(F.levenshtein("word", "choice", 1) >= 0, True)).alias("edit"))
    low = F.when(F.length("word") <= SHORT_WORD, NEAR_SHORT).otherwise(NEAR) + LEAD
    odd = best.filter(F.col("edit") & (F.col("best") < low) & (F.length("word") >= ONE_EDIT_FROM)).select("word")
    again = short(odd, 10_000).join(choices).withColumn("ratio", alike("word", "choice"))
    scored = pairs.join(F.broadcast(odd), "word", "left_anti").unionByName(again)
    w = Window.partitionBy("word").orderBy(F.desc("ratio"), F.desc("choice"))
    top = scored.withColumn("nth", F.row_number().over(w)).withColumn("next", F.lead("ratio", 1, 0.0).over(w)).filter("nth = 1")
    one_edit = (F.length("word") >= ONE_EDIT_FROM) & (F.levenshtein("word", "choice") <= 1)
    fine = ((F.col("ratio") >= RATIO) | one_edit) & (F.col("ratio") - F.col("next") >= LEAD)
    found = top.filter(fine).select("word", "choice", F.when(F.col("ratio") >= RATIO, "alike").otherwise("one edit").alias("how"))
    return exact.select("word", F.col("word").alias("choice"), F.lit("exact").alias("how")).unionByName(found)


def one_edit(words: DataFrame, choices: DataFrame) -> DataFrame:
    """word, choice pairs at most one edit apart, for words of five letters or more.

    choices are a short closed set; words meet those of their length, give or take one, so the sets are never crossed whole.
    """
    choices = short(choices.select("choice").distinct(), 10_000)
    a = words.select("word").distinct().filter(F.length("word") >= ONE_EDIT_FROM).withColumn("n", F.length("word"))
    b = choices.select("choice").distinct().withColumn("n", F.explode(F.array(F.length("choice") - 1, F.length("choice"), F.length("choice") + 1)))
    return a.join(b, "n").filter(F.levenshtein("word", "choice", 1) >= 0).select("word", "choice")


def precision_outliers(cells: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """Cells whose printed decimals differ from their column's usual ones.

    Only exact numbers count; a column needs more than three of them, and three alike; of equally
    usual ones the first seen counts.
    """
    rows = cells.withColumn("decimals", printed_decimals(F.col(value))).filter("decimals is not null")
    seen = rows.groupBy(*by, "decimals").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    w = Window.partitionBy(*by)
    usual = seen.withColumn("all", F.sum("n").over(w)).withColumn("nth", F.row_number().over(w.orderBy(F.desc("n"), "first")))
    usual = usual.filter("nth = 1 and all > 3 and n >= 3").select(*by, F.col("decimals").alias("usual"))
    return rows.join(usual, by).filter(F.col("decimals") != F.col("usual"))


def low_confidence(cells: DataFrame, score: str = "score") -> DataFrame:
    """Cells that were read with too little confidence, or with none stated."""
    return cells.filter(F.coalesce(F.col(score), F.lit(0.0)) < MIN_SCORE)


def cell_problems(cells: DataFrame, numeric: str = "numeric", single: str = "single") -> DataFrame:
    """Adds problems: empty, several pieces, not a number, low score. Cells have text, n_items, score and two flags."""
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    found = F.array(
        F.when(empty, "empty"),
        F.when(~empty & F.col(single) & (F.col("n_items") > 1), "several pieces"),
        F.when(~empty & F.col(numeric) & exact_text(F.col("text")).isNull(), "not a number"),
        F.when(~empty & (F.col("score") < MIN_SCORE), "low score"),
    )
    return cells.withColumn("problems", F.array_compact(found))


def robust_outliers(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Rows above max(15, 4 times the median) of their group."""
    limit = rows.groupBy(by).agg(F.greatest(F.lit(float(INK_FLOOR)), INK_FACTOR * F.median(value)).alias("upper"))
    return rows.join(limit, by).filter(F.col(value) > F.col("upper"))


def keep_first(rows: DataFrame, key: list[str], order: list[str], text: str) -> DataFrame:
    """The first row of each key, by a total order, and whether later ones say something else (``conflict``)."""
    first = F.min(F.struct(*order, text))
    return rows.groupBy(*key).agg(first[text].alias(text), (F.count_distinct(F.coalesce(text, F.lit("\0"))) > 1).alias("conflict"), F.count("*").alias("n"))


def validated(rows: DataFrame, key: list[str], order: list[str], id_column: str, page: str, n_pages: int) -> DataFrame:
    """Rows of a reply with a verdict: no id, repeated id (all but the first), page out of range, or ok."""
    nth = F.row_number().over(Window.partitionBy(*key, id_column).orderBy(*order))
    verdict = F.when(F.trim(F.coalesce(id_column, F.lit(""))) == "", "no id").when(F.col("nth") > 1, "repeated id").when(~F.col(page).between(1, n_pages), "no such page").otherwise("ok")
    return rows.withColumn("nth", nth).withColumn("verdict", verdict).drop("nth")


def required(pairs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row for each key with its fields as columns, and the required ones that are missing. pairs: key, label, value."""
    wide = pairs.groupBy(key).pivot("label", fields).agg(F.min("value"))
    return wide.withColumn("missing", F.array_compact(F.array(*[F.when(F.col(f).isNull(), f) for f in fields])))


def assemble(findings: DataFrame, recommendations: DataFrame, key: list[str]) -> DataFrame:
    """Findings with their recommendations; what is without its other half is marked."""
    left = findings.withColumn("has_finding", F.lit(True))
    both = left.join(recommendations.withColumn("has_recommendation", F.lit(True)), key, "full_outer")
    status = F.when(F.col("has_finding").isNull(), "extra recommendation").when(F.col("has_recommendation").isNull(), "no recommendation").otherwise("ok")
    return both.withColumn("status", status).drop("has_finding", "has_recommendation")
