"""A stored keyword index: postings in blocks with the best score that each can give, so that a search skips blocks.

Postings lie sorted by term, the heaviest of a term first, in blocks of ``BLOCK``; Parquet's statistics keep a search to its terms' row groups, and
a block's bound to those that can matter. No text is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline.functions.sizes import short
from proofline.operators import retrieval as R

BLOCK = 128
#: Postings of a term that are put in order together; those of a common term are parted by their keys.
SPAN = 1 << 16
#: Room for rounding between a bound and a score.
ROOM = 1e-5


def weight(tf: Column, size: Column, mean: Column) -> Column:
    """What a word's occurrences are worth in a chunk, without the word's rarity."""
    return tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * size / mean))


def write(chunks: DataFrame, path: str, key: str = "doc_id") -> None:
    """Builds the index of chunks (key, text) below ``path``: postings in blocks, words' counts, the collection's size."""
    spark = chunks.sparkSession
    words = R.tokens(F.col("text"))
    each = chunks.select(F.col(key).alias("key"), words.alias("all")).filter(F.size("all") > 0).select("key", F.size("all").alias("len"), F.explode("all").alias("term"))
    each.groupBy("key", "len", "term").agg(F.count("*").alias("tf")).write.mode("overwrite").parquet(f"{path}/raw")
    raw = spark.read.parquet(f"{path}/raw")
    size = F.regexp_count(F.lower("text"), F.lit(R.TOKEN))
    chunks.select(size.alias("len")).filter("len > 0").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len")).write.mode("overwrite").parquet(f"{path}/size")
    raw.groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    whole = spark.read.parquet(f"{path}/size")
    # dealt by ranges of terms, once: counts, ranks and blocks of a term are made where its postings are
    rows = raw.repartitionByRange("term").withColumn("df", F.count("*").over(Window.partitionBy("term"))).join(F.broadcast(whole), how="cross")  # one row
    rows = rows.withColumns({"worth": weight(F.col("tf"), F.col("len"), F.col("avg_len")), "part": F.pmod(F.xxhash64("key"), F.floor(F.col("df") / SPAN) + 1)})
    nth = F.row_number().over(Window.partitionBy("term", "part").orderBy(F.desc("worth"), "key"))
    blocks = rows.withColumn("block", F.floor((nth - 1) / BLOCK)).groupBy("term", "part", "block").agg(F.max("worth").alias("most"), F.collect_list(F.struct("key", "tf", "len")).alias("postings"))
    blocks.sortWithinPartitions("term", "part", "block").write.mode("overwrite").parquet(f"{path}/postings")


def search(spark: SparkSession, path: str, queries: DataFrame, key: str = "doc_id", k: int = R.CANDIDATES) -> DataFrame:
    """query_id, key, score, rank0: what ``retrieval.bm25`` gives, from a stored index, for a batch of queries.

    The k-th best of what each query's heaviest blocks alone give is a floor: at least k chunks score so much. A block is skipped if its best posting and the best
    of the query's other words together stay below; so no chunk of a skipped block can be among the k, and all blocks of those that can be are read.
    """
    terms = short(R.query_terms(short(queries, R.MOST)), R.MOST_TERMS)
    wanted = [t for (t,) in terms.select("term").distinct().collect()]
    whole = spark.read.parquet(f"{path}/size")
    counts = spark.read.parquet(f"{path}/terms").filter(F.col("term").isin(wanted))
    idf = F.greatest(F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(R.IDF_FLOOR))
    weights = terms.join(counts, "term").join(F.broadcast(whole), how="cross").select("query_id", "term", idf.alias("idf"), "avg_len")
    postings = spark.read.parquet(f"{path}/postings").filter(F.col("term").isin(wanted))
    heads = postings.select("term", "part", "block", "most", F.size("postings").alias("n")).join(F.broadcast(weights), "term").withColumn("bound", F.col("idf") * F.col("most"))
    best = heads.groupBy("query_id", "term").agg(F.max("bound").alias("best"))
    best = best.join(best.groupBy("query_id").agg(F.sum("best").alias("sum")), "query_id")
    # each query's heaviest blocks of one word, with k postings or so: a word's postings are in different chunks
    ahead = F.sum("n").over(Window.partitionBy("query_id", "term").orderBy(F.desc("bound"), "part", "block")) - F.col("n")
    first = heads.withColumn("ahead", ahead).filter(F.col("ahead") < k).select("query_id", "term", "part", "block", "idf", "avg_len")
    scored = postings.join(F.broadcast(first), ["term", "part", "block"]).select("query_id", "idf", "avg_len", F.explode("postings").alias("p"))
    part = F.col("idf") * weight(F.col("p.tf"), F.col("p.len"), F.col("avg_len"))
    some = scored.groupBy("query_id", F.col("p.key").alias("key")).agg(F.sum(part).alias("score"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    floor = some.withColumn("nth", nth).filter(F.col("nth") == k).select("query_id", F.col("score").alias("floor"))
    bounds = heads.join(best, ["query_id", "term"]).join(floor, "query_id", "left")
    kept = bounds.filter(F.col("bound") + F.col("sum") - F.col("best") >= F.coalesce("floor", F.lit(0.0)) - ROOM).select("query_id", "term", "part", "block", "idf", "avg_len")
    rows = postings.join(kept, ["term", "part", "block"]).select("query_id", "idf", "avg_len", F.explode("postings").alias("p"))
    found = rows.groupBy("query_id", F.col("p.key").alias(key)).agg(F.round(F.sum(part), 6).alias("score"))
    return R.top(found, key, k)
