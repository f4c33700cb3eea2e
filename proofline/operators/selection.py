"""Choosing: gates, ranks, ordered rules and what a request names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.exact import names_token, squeezed

#: Gate keys that allow a count up to the wanted one; others with whole numbers must equal it.
AT_MOST = ("unsafe_accepted", "wrong_outputs")


def gate_failures(results: DataFrame, gates: DataFrame) -> DataFrame:
    """task, model, key, why: the first failing condition of each result, in gate order; none if it passes.

    results: task, model, key, have (double); gates: task, key, ord, kind (bool, int, float), want.
    A key that ends in _max is an upper limit; a boolean must be the same; a float is a lower
    limit; other whole numbers must be equal; a missing measurement fails.
    """
    each = F.collect_list(F.struct("ord", "key", "kind", "want"))
    lists = gates.groupBy("task").agg(F.array_sort(each).alias("gates"))
    have = results.groupBy("task", "model").agg(F.map_from_entries(F.collect_list(F.struct("key", "have"))).alias("have"))
    return have.join(lists, "task").withColumn("first", first_failure(F.col("gates"), F.col("have"))).filter("first is not null").select("task", "model", "first.key", "first.why")


def first_failure(gates: Column, have: Column) -> Column:
    """(key, why) of the first of some ordered gates that a map of measurements fails; null if it passes."""

    def why(g: Column) -> Column:
        got, want = F.try_element_at(have, g["key"]), g["want"]
        fine = (
            F.when(g["key"].endswith("_max"), got <= want)
            .when(g["kind"] == "bool", got == want)
            .when(g["key"].isin(*AT_MOST), got <= want)
            .when(g["kind"] == "float", got >= want)
            .otherwise(got == want)
        )
        return F.when(got.isNull(), "not measured").when(~fine, "fails")

    failed = F.filter(F.transform(gates, lambda g: F.struct(g["key"].alias("key"), why(g).alias("why"))), lambda x: x["why"].isNotNull())
    return F.get(failed, F.lit(0))


def ladder(needs: Column, has: Column, tested: Column, qualified: Column, gate: Column, size: Column, room: Column, runs: Column) -> Column:
    """Why a candidate isn't eligible, by the first rung it misses; null if it is.

    Rungs: capabilities, a test at all, a run test, the safety gate, memory, availability.
    """
    lacks = F.array_join(F.array_sort(F.array_except(needs, has)), ", ")
    return (
        F.when(lacks != "", F.concat(F.lit("cannot: lacks "), lacks))
        .when(~tested, "not qualified: never tested for this task")
        .when(qualified == F.lit(False), "not qualified: a candidate, but no qualification test has been run")
        .when(gate.isNotNull(), F.concat(F.lit("failed the safety gate: "), gate))
        .when(size > room, F.concat(F.lit("does not fit: needs "), size, F.lit(" GB, "), room, F.lit(" GB available")))
        .when(~F.coalesce(runs, F.lit(False)), "qualified, but not available on this machine")
    )


def ranked(candidates: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """Adds rank to eligible candidates within ``by``; order must be total, with nulls last in either direction."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def choose(candidates: DataFrame, by: str, name: str, order: list[Column]) -> DataFrame:
    """by, chosen, runner_up, n_eligible from candidates with ``reason`` (null: eligible); no eligible one gives null."""
    fine = F.col("reason").isNull()
    nth = F.when(fine, F.row_number().over(Window.partitionBy(by).orderBy(F.desc(fine), *order)))
    place = lambda n: F.max(F.when(F.col("nth") == n, F.col(name)))
    return candidates.withColumn("nth", nth).groupBy(by).agg(place(1).alias("chosen"), place(2).alias("runner_up"), F.count_if(fine).alias("n_eligible"))


def first_rule(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first rule whose pattern the text matches, whatever the case."""
    out = F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(text.rlike(f"(?i){pattern}"), F.lit(name)).otherwise(out)
    return out


def first_pattern(text: Column, patterns: list[str]) -> Column:
    """The place of the first pattern that the text matches; null if none."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(patterns))):
        out = F.when(text.rlike(f"(?i){patterns[i]}"), F.lit(i)).otherwise(out)
    return out


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation, without empty ones, with white space collapsed."""
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = turns.withColumn("nth", last).filter(F.col("nth") <= n).withColumn("text", squeezed(F.col("text")))
    return rows.filter("text <> ''").select("conv_id", "turn", "role", "text")


def named(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Texts with each name of a short list (column ``name``) that they hold as a whole token, whatever the case."""
    listed = [r[0] for r in names.select("name").distinct().limit(1001).collect()]
    if len(listed) > 1000:
        raise ValueError("names are a short list of at most 1000")
    found = F.filter(F.array(*[F.lit(x) for x in sorted(listed)]), lambda x: names_token(F.col("text"), x))
    return texts.withColumn("name", F.explode(found))
