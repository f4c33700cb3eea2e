"""Hybrid retrieval for batches of queries: keywords, vectors, identifiers, fusion and references.

Queries are a DataFrame too, so ranks are windows partitioned by query; no query is a driver loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.sizes import short

# BM25's parameters, list lengths and fusion weights, and the shapes of identifiers.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
CANDIDATES, RRF_K, BONUS, TOP, MAX_SECTIONS = 50, 60, 2.0, 5, 3
IDENTIFIERS = (
    r"\b[A-Z]{2,}(?:-[A-Z0-9]+)+(?:\s+(?:Cl|Sec|Part|Div)\.?\s*[0-9IVX]+(?:\.\d+)*)*",
    r"\b[A-Z]{2,}\s+\d+[A-Z]?(?:\s+(?:Cl|Sec|Part|Div)\.?\s*[0-9IVX]+(?:\.\d+)*)+",
)
TOKEN = "[a-z0-9]+"
#: A word printed in lower case; letters, digits and signs of all scripts go on a word.
LOWER = r"(?U)\b[a-z]+\b"
#: Queries of a batch that are compared with every row.
MOST, MOST_TERMS = 1000, 20_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def postings(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, term, tf: the keyword index."""
    return chunks.select(key, F.explode(tokens(F.col("text"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def vocabulary(chunks: DataFrame) -> DataFrame:
    """term: the words printed in lower case somewhere in the collection: ordinary words, as names never are."""
    return chunks.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(LOWER), F.lit(0)))).alias("term")).distinct()


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term: each word of more than one letter, once."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")).filter(F.length("term") > 1)


def bm25(chunks: DataFrame, queries: DataFrame, key: str = "doc_id", k: int = CANDIDATES) -> DataFrame:
    """query_id, key, score, rank0: the k best chunks of any query word; higher is better, ties by key.

    For a batch of at most ``MOST`` queries, whose words go to every task. Chunks are read twice, for the size of the
    collection and for postings; of these only wanted words leave their task, and counts and scores share them.
    Chunks without words don't count.
    """
    terms = short(query_terms(short(queries, MOST)), MOST_TERMS)
    wanted = [t for (t,) in terms.select("term").distinct().collect()]
    size = F.regexp_count(F.lower("text"), F.lit(TOKEN))
    whole = chunks.select(size.alias("len")).filter("len > 0").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    each = chunks.select(key, tokens(F.col("text")).alias("all")).select(key, F.size("all").alias("len"), F.explode("all").alias("term"))
    tf = each.filter(F.col("term").isin(wanted)).groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    counts = tf.groupBy("term").agg(F.count("*").alias("df"))  # a row for each wanted word at most
    idf = F.greatest(F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    weights = terms.join(counts, "term").join(F.broadcast(whole)).select("query_id", "term", idf.alias("idf"), "avg_len")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = tf.join(F.broadcast(weights), "term").groupBy("query_id", key).agg(F.round(F.sum(part), 6).alias("score"))
    return top(scored, key, k)


def top(scored: DataFrame, key: str, k: int) -> DataFrame:
    """The k best of each query with a rank from 0; ties go to the smaller key."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return scored.withColumn("rank0", rank - 1).filter(F.col("rank0") < k)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def unit(v: Column) -> Column:
    """A vector of length 1; the zero vector stays zero."""
    d = v.cast("array<double>")
    return F.transform(d, lambda x: x / F.greatest(norm(d), F.lit(1e-9)))


def cosine_top(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", k: int = CANDIDATES) -> DataFrame:
    """query_id, key, score, rank0: the k nearest by cosine, for a batch of at most ``MOST`` queries (query_id, v)."""
    few = short(queries.select("query_id", F.col("v").cast("array<double>").alias("q")), MOST)
    d = F.col("embedding").cast("array<double>")
    dot = F.aggregate(F.zip_with(d, F.col("q"), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = vectors.join(few).select("query_id", key, F.round(dot / (norm(d) * norm(F.col("q"))), 6).alias("score"))
    return top(scored.filter("score is not null"), key, k)


def identifiers(text: Column) -> Column:
    """The identifiers in a text, by shape, each once."""
    found = [F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)) for p in IDENTIFIERS]
    return F.array_distinct(F.concat(*found))


def bare_id(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def identifier_hits(chunks: DataFrame, queries: DataFrame, key: str = "doc_id", own: Column | None = None) -> DataFrame:
    """query_id, key, n_ids: how many of a query's identifiers a chunk holds or, with ``own``, is named by; letters and digits alone compared."""
    wanted = queries.select("query_id", F.explode(identifiers(F.col("query"))).alias("wanted")).withColumn("wanted", bare_id(F.col("wanted"))).filter("wanted <> ''").distinct()
    rows = chunks.select(key, bare_id(F.col("text")).alias("bare"), bare_id(own if own is not None else F.lit("")).alias("own"))
    hits = rows.join(short(wanted, MOST), F.expr("contains(bare, wanted) or own = wanted"))
    return hits.groupBy("query_id", key).agg(F.count("*").alias("n_ids"))


def fuse(keyword: DataFrame, vector: DataFrame, named: DataFrame, key: str, k: int = TOP) -> DataFrame:
    """query_id, key, score: reciprocal ranks of both lists plus the bonus for identifiers; ties go to the larger key."""
    a, b = keyword.select("query_id", key, F.col("rank0").alias("ra")), vector.select("query_id", key, F.col("rank0").alias("rb"))
    all_ = a.join(b, ["query_id", key], "full_outer").join(named, ["query_id", key], "full_outer")
    part = lambda r: F.coalesce(1.0 / (RRF_K + F.col(r)), F.lit(0.0))
    score = F.round(part("ra") + part("rb") + BONUS / RRF_K * F.coalesce("n_ids", F.lit(0)), 9)
    scored = all_.withColumn("score", score).filter("score > 0")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(key)))
    return scored.withColumn("nth", nth).filter(F.col("nth") <= k).select("query_id", key, "score", "nth")


def references(texts: DataFrame, docs: DataFrame, pattern: str) -> DataFrame:
    """from_id, to_doc, section, at: pointers in a text to sections of known documents, in order of their first mention.

    pattern has a group for the document and one for the list of sections.
    """
    spans = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0))
    rows = texts.select(F.col("doc_id").alias("from_id"), F.posexplode(spans).alias("i", "span"))
    listed = F.regexp_extract_all(F.regexp_extract("span", pattern, 2), F.lit(r"(\d+(?:\.\d+)*)"), F.lit(1))
    rows = rows.select("from_id", "i", F.regexp_extract("span", pattern, 1).alias("to_doc"), F.posexplode(listed).alias("j", "section"))
    first = rows.groupBy("from_id", "to_doc", "section").agg(F.min(F.struct("i", "j")).alias("at"))
    return first.join(docs.select(F.col("name").alias("to_doc")).distinct(), "to_doc", "left_semi").select("from_id", "to_doc", "section", "at")


def hop(hits: DataFrame, refs: DataFrame, chunks: DataFrame, limit: int = MAX_SECTIONS) -> DataFrame:
    """query_id, to_doc, section, chunk: chunks of the sections that a query's hits point at, of at most 3 sections.

    hits: query_id, doc_id, section, nth; refs: from_id, to_doc, section, at; chunks: to_doc, section, chunk.
    Sections come in the order in which the hits, best first, mention them. One that is a hit itself, or
    that has no chunks, isn't followed and doesn't count; other sections of a document that was hit are followed.
    """
    named = hits.select("query_id", "doc_id", "nth").join(refs, F.col("doc_id") == F.col("from_id"))
    first = named.groupBy("query_id", "to_doc", "section").agg(F.min(F.struct("nth", "at")).alias("first"))
    seen = hits.select("query_id", F.col("doc_id").alias("to_doc"), "section").distinct()
    fresh = first.join(seen, ["query_id", "to_doc", "section"], "left_anti").join(chunks.select("to_doc", "section").distinct(), ["to_doc", "section"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("first", "to_doc", "section"))
    kept = fresh.withColumn("place", nth).filter(F.col("place") <= limit)
    return kept.join(chunks, ["to_doc", "section"]).select("query_id", "to_doc", "section", "chunk")


def citation(doc: Column, section: Column, first: Column, last: Column) -> Column:
    """How a passage is cited: document, section if any, page or pages."""
    pages = F.when(first == last, F.concat(F.lit("p. "), first)).otherwise(F.concat(F.lit("pp. "), first, F.lit("-"), last))
    return F.concat_ws(", ", doc, F.when(section != "0", F.concat(F.lit("section "), section)), pages)
