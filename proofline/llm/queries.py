"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from proofline.llm import ann, bpe, divergence, jaccard, langid, licences, minhash, packing, quality, repeats, tokenstore, vcodes, wrappers

WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(read(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs, keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints(read(spark, sf_dir, "documents"))


def near_duplicates_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7's bands, joined, and the Jaccard similarity verified: the component of every document."""
    return minhash.minhash_near_duplicates(read(spark, sf_dir, "documents"))


def op8_tokenstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.token_store(read(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))


def op9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(read(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTES))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vcodes.compress(read(spark, sf_dir, "embeddings"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.diverge(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_repeats": op3_repeats,
    "op4_licences": op4_licences,
    "op5_jaccard": op5_jaccard,
    "op6_neighbours": op6_neighbours,
    "op7_fingerprints": op7_fingerprints,
    "op8_tokenstore": op8_tokenstore,
    "op9_pages": op9_pages,
    "op10_packing": op10_packing,
    "op11_codes": op11_codes,
    "op12_language": op12_language,
    "op13_divergence": op13_divergence,
    "near_duplicates_minhash": near_duplicates_minhash,
}

ORACLES: dict[str, str] = {"op4_licences": licences.oracle("documents"), "op11_codes": vcodes.oracle("embeddings"), "op13_divergence": divergence.oracle("documents")}
