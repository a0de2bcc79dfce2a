"""Index tables: terms of documents, a hash for each distinct term, postings."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lexmesh.functions.distance import hash_parts
from lexmesh.functions.text import DELIMITERS, augment, check_vocabulary, normalize_term, split_terms, subwords, subwords_of
from lexmesh.functions.tlsh import tlsh_hash
from lexmesh.functions.translit import unigram
from lexmesh.sources.storage import settle

#: Vocabularies up to this size are searched by expressions, larger ones by an Arrow function.
EXPRESSION_VOCABULARY = 200


@dataclass
class Options:
    """How terms are made and hashed. The same options must serve indexing and search."""

    delimiters: Sequence[str] = DELIMITERS
    vocabulary: Sequence[str] = ()
    permutation: Sequence[int] | None = None
    exact_quartiles: bool = False
    normalize: Callable[[Column], Column] = normalize_term
    letters: dict[str, str] = field(default_factory=dict)  # ASCII for characters without a rule, see functions.translit


def tokens(docs: DataFrame, options: Options, key: str = "key", text: str = "text") -> DataFrame:
    """(key, pos, word): the words of each document in order, repeats kept."""
    return docs.select(F.col(key).alias("key"), F.posexplode(split_terms(F.col(text), options.delimiters)).alias("pos", "word"))


def expand(words: DataFrame, vocabulary: Sequence[str], kept: Sequence[str] = ()) -> DataFrame:
    """(word, kept columns, rank, term): each distinct word itself (rank -1) and its sub-words by vocabulary rank.

    A word's sub-words don't depend on the words beside it, so they are found once a distinct word.
    """
    own = words.select("word", *kept, F.lit(-1).alias("rank"), F.col("word").alias("term"))
    if not vocabulary:
        return own
    check_vocabulary(vocabulary)
    if len(vocabulary) <= EXPRESSION_VOCABULARY:
        found = subwords(F.col("word"), vocabulary)
    else:
        listed = list(vocabulary)

        @F.pandas_udf(ArrayType(StringType()))
        def many(values: pd.Series) -> pd.Series:
            return values.map(lambda w: subwords_of(w, listed))

        found = many("word")
    rank = F.array_position(F.array(*map(F.lit, vocabulary)), F.col("term")).cast("int") if len(vocabulary) <= EXPRESSION_VOCABULARY else F.col("place")
    more = words.select("word", *kept, F.posexplode(found).alias("place", "term"))
    return own.unionByName(more.select("word", *kept, rank.alias("rank"), "term"))


def terms(words: DataFrame, options: Options, kept: Sequence[str] = ()) -> DataFrame:
    """(word, kept columns, rank, norm, unigram): normalised terms of distinct words; rejected ones are left out. With kept columns, words are distinct already."""
    df = expand(words if kept else words.select("word").distinct(), options.vocabulary, kept)
    # Exploded, so that filters on it stay here: moved below the words' grouping, they would normalise every occurrence.
    df = df.select("word", *kept, "rank", F.explode(F.array(options.normalize(F.col("term")))).alias("norm")).filter("norm IS NOT NULL")
    return df.select("*", F.explode(F.array(unigram(F.col("norm"), options.letters))).alias("unigram")).filter("unigram <> ''")


def hashed(norms: DataFrame, options: Options) -> DataFrame:
    """(norm, hash_key, hash70, unigram, parts): one hash for each distinct normalised term."""
    df = norms.select("norm", "unigram").distinct().withColumn("h", tlsh_hash(augment(F.col("norm")), options.permutation, options.exact_quartiles))
    df = df.filter("h.valid").select("norm", F.concat("h.hash", "unigram").alias("hash_key"), F.col("h.hash").alias("hash70"), "unigram")
    return df.select("*", *hash_parts(F.col("hash70")))


HASH_COLUMNS = ("hash_key", "hash70", "unigram", "check", "c0", "c1", "c2", "c3")


#: Terms that one task hashes.
TERMS_A_TASK = 20_000


def first_places(docs: DataFrame, options: Options, order: str = "key", text: str = "text") -> DataFrame:
    """(word, at): the distinct words and the least (doc, pos) at which each comes up, doc being the column order.

    A task sends each of its words once. Both numbers go into one long wherever the orders' span lets them, as hashed
    aggregation can't hold a struct; otherwise (null orders, a span of 2^32) the words are sorted.
    """
    seen = docs.select(F.col(order).cast("long").alias("doc"), F.posexplode(split_terms(F.col(text), options.delimiters)).alias("pos", "word"))
    doc = F.col(order).cast("long")
    least, most, unknown = docs.agg(F.min(doc), F.max(doc), F.count_if(doc.isNull())).first()
    if unknown or least is None or most - least >= 1 << 32:
        return seen.groupBy("word").agg(F.min(F.struct("doc", "pos")).alias("at"))
    at = F.min((F.col("doc") - F.lit(least)) * F.lit(1 << 31) + F.col("pos"))
    unpacked = F.struct((F.shiftright("at", 31) + F.lit(least)).cast("long").alias("doc"), F.col("at").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("pos"))
    return seen.groupBy("word").agg(at.alias("at")).select("word", unpacked.alias("at"))


def term_hashes(docs: DataFrame, options: Options, order: str | None = None, blocks: Sequence[str] | None = None) -> DataFrame:
    """(word, rank, first, HASH_COLUMNS) of the distinct words of documents (key, text), those of the blocks alone if given.

    first is where the word's term comes up first: (doc, 0, position), or (doc, 1, rank) for a sub-word, as sub-words come
    after all words of their document.
    """
    own = F.col("rank") < 0
    first = F.struct(F.col("at.doc").alias("doc"), F.when(own, F.lit(0)).otherwise(1).alias("sub"), F.when(own, F.col("at.pos")).otherwise(F.col("rank")).alias("pos"))
    words = terms(first_places(docs, options, order or "key"), options, ("at",))
    if blocks is not None:
        words = words.filter(F.col("unigram").isin(*blocks))
    # Both settled, so that texts are read once and each distinct term is hashed once however often the result is read.
    words = settle(words.select("word", "rank", "norm", "unigram", first.alias("first")), "words")
    norms = words.select("norm", "unigram").distinct().repartition(1 + words.count() // TERMS_A_TASK, "norm")
    return settle(words.drop("unigram").join(hashed(norms, options), "norm").select("word", "rank", "first", *HASH_COLUMNS), "terms")


def stored_hashes(dim: DataFrame) -> DataFrame:
    """(HASH_COLUMNS, first_seen) of term_hashes."""
    return dim.groupBy(*HASH_COLUMNS).agg(F.min("first").alias("first_seen"))


def postings_of(docs: DataFrame, dim: DataFrame, options: Options) -> DataFrame:
    """(hash_key, key) of the documents' words that dim (word, hash_key) holds, with repeats."""
    words = F.explode(F.array_distinct(split_terms(F.col("text"), options.delimiters)))
    return docs.select("key", words.alias("word")).join(dim.select("word", "hash_key"), "word").select("hash_key", "key")


def index_batch(docs: DataFrame, options: Options, subword_terms: bool = True, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, hashes) of documents (key, text).

    postings: distinct (hash_key, key). hashes: HASH_COLUMNS and first_seen, the least (order, position) at which the hash
    comes up; order is a column of docs, key by default. Only distinct words are normalised and hashed; what is shuffled
    by document is (word, key).
    """
    opts = options if subword_terms else Options(**{**options.__dict__, "vocabulary": ()})
    dim = term_hashes(docs, opts, order)
    return postings_of(docs, dim, opts).distinct(), stored_hashes(dim)
