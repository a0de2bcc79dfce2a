"""Search: query terms against stored hashes of the same block, the best hashes a term, keys ranked by summed scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.functions.distance import PARTS, parts_distance
from lexmesh.operators.index import Options, hashed, postings_of, stored_hashes, term_hashes, terms, tokens
from lexmesh.sources.storage import settle

THRESHOLD = 150
CANDIDATES = 10_000
TOP = 120
#: Query terms that one broadcast may hold; more are joined by shuffle, hashes spread over SALTS a block.
MAX_BROADCAST_TERMS = 50_000
SALTS = 32


def query_terms(queries: DataFrame, options: Options) -> DataFrame:
    """(query_id, part, hash parts): the terms of (query_id, query) that aren't rejected, numbered from 0 in order. No sub-words."""
    plain = Options(**{**options.__dict__, "vocabulary": ()})
    words = tokens(queries, plain, "query_id", "query").withColumnRenamed("key", "query_id")
    kept = words.join(terms(words, plain).select("word", "norm", "unigram"), "word")
    kept = kept.join(hashed(kept, plain).drop("unigram"), "norm")
    part = F.row_number().over(Window.partitionBy("query_id").orderBy("pos")) - 1
    return kept.select("query_id", part.alias("part"), "norm", "unigram", *PARTS)


def match_hashes(parts: DataFrame, hashes: DataFrame, threshold: int = THRESHOLD, candidate_cap: int | None = CANDIDATES, top_k: int | None = TOP) -> DataFrame:
    """(query_id, part, hash_key, score, place): the best stored hashes of each query term.

    Of the hashes in the term's block at a distance of at most the threshold, the first candidate_cap in insertion order
    count; of these the top_k of highest score (threshold less distance), earlier ones first among equals. None lifts a
    limit.
    """
    prefix = parts.select("query_id", "part", F.col("unigram").alias("q_unigram"), *[F.col(c).alias(f"q_{c}") for c in PARTS])
    near = (F.col("q_unigram") == F.col("unigram")) & (parts_distance("q_", "") <= threshold)
    if parts.count() <= MAX_BROADCAST_TERMS:
        met = hashes.join(F.broadcast(prefix), near)
    else:
        salted = hashes.withColumn("_salt", F.pmod(F.xxhash64("hash_key"), F.lit(SALTS)).cast("int"))
        spread = prefix.withColumn("_q_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = salted.join(spread, near & (F.col("_salt") == F.col("_q_salt")))
    met = met.select("query_id", "part", "hash_key", "first_seen", (F.lit(threshold) - parts_distance("q_", "")).alias("score"))
    by = Window.partitionBy("query_id", "part")
    if candidate_cap is not None:
        met = met.withColumn("_n", F.row_number().over(by.orderBy("first_seen", "hash_key"))).filter(F.col("_n") <= candidate_cap)
    met = met.withColumn("place", F.row_number().over(by.orderBy(F.desc("score"), "first_seen", "hash_key")))
    if top_k is not None:
        met = met.filter(F.col("place") <= top_k)
    return met.select("query_id", "part", "hash_key", "score", "place")


def rank_keys(matches: DataFrame, postings: DataFrame, parts: DataFrame, invalid: DataFrame | None = None) -> DataFrame:
    """(query_id, key, scores, total, first_part, first_place): keys of matched hashes, their best score for each term (0 without), ordered by total."""
    found = matches.join(postings, "hash_key")
    if invalid is not None:
        found = found.join(invalid.select("key").distinct(), "key", "left_anti")
    best = found.groupBy("query_id", "key", "part").agg(F.max("score").alias("score"), F.min("place").alias("place"))
    sizes = parts.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    by_key = best.groupBy("query_id", "key").agg(
        F.map_from_entries(F.collect_list(F.struct("part", "score"))).alias("m"),
        F.sum("score").cast("long").alias("total"),
        F.min(F.struct("part", "place")).alias("first"),
    )
    dense = by_key.join(sizes, "query_id").withColumn("scores", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.element_at("m", i), F.lit(0))))
    return dense.select("query_id", "key", "scores", "total", F.col("first.part").alias("first_part"), F.col("first.place").alias("first_place"))


def search(queries: DataFrame, postings: DataFrame, hashes: DataFrame, options: Options, threshold: int = THRESHOLD, candidate_cap: int | None = CANDIDATES, top_k: int | None = TOP, invalid: DataFrame | None = None) -> DataFrame:
    """Ranked keys for (query_id, query): see rank_keys. A query of rejected terms alone finds nothing."""
    parts = settle(query_terms(queries, options), "parts")  # read three times below; a row per query term
    return rank_keys(match_hashes(parts, hashes, threshold, candidate_cap, top_k), postings, parts, invalid)


def search_texts(queries: DataFrame, docs: DataFrame, options: Options, threshold: int = THRESHOLD, candidate_cap: int | None = CANDIDATES, top_k: int | None = TOP, invalid: DataFrame | None = None) -> DataFrame:
    """What search finds in the index of documents (key, text), for one search, without that index.

    A term is only ever compared within its block, so the terms of the queries' blocks alone are hashed; and of the
    documents' words only those of the best hashes become postings, in a second reading. No document's words are shuffled.
    """
    parts = settle(query_terms(queries, options), "parts")
    blocks = [r["unigram"] for r in parts.select("unigram").distinct().collect()]  # ASCII characters
    dim = term_hashes(docs, options, blocks=blocks)
    best = settle(match_hashes(parts, stored_hashes(dim), threshold, candidate_cap, top_k), "best")
    wanted = settle(dim.join(best.select("hash_key").distinct(), "hash_key").select("word", "hash_key"), "wanted")
    return rank_keys(best, postings_of(docs, wanted, options), parts, invalid)
