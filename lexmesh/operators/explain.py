"""Which words of a paragraph a query word comes closest to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.functions.distance import PARTS, parts_distance
from lexmesh.functions.text import split_terms
from lexmesh.operators.index import Options, expand, hashed, terms

#: The distance reported when nothing compares.
NOTHING = 100_000


def explain_match(pairs: DataFrame, options: Options) -> DataFrame:
    """(pair_id, token_pos, query_token, base_substring, distance) for (pair_id, word, paragraph).

    The word is split into tokens (with sub-words), the paragraph at single spaces, its pieces into tokens; tokens with
    the same first character are compared, and the first nearest one is named. Rejected query tokens are left out; one
    without a comparable token has a null substring and the distance NOTHING.
    """
    mine = pairs.select("pair_id", F.posexplode(split_terms(F.col("word"), options.delimiters)).alias("pos", "word"))
    base = pairs.select("pair_id", F.posexplode(F.split("paragraph", " ", -1)).alias("piece", "p"))
    base = base.select("pair_id", "piece", F.posexplode(split_terms(F.col("p"), options.delimiters)).alias("pos", "word"))

    def with_hashes(df: DataFrame) -> DataFrame:
        found = terms(df, options)
        found = found.join(hashed(found, options).drop("unigram"), "norm").join(_texts(df, options), ["word", "rank"])
        return df.join(found, "word")

    q = with_hashes(mine).select("pair_id", F.struct(F.when(F.col("rank") < 0, 0).otherwise(1).alias("sub"), F.when(F.col("rank") < 0, F.col("pos")).otherwise(F.col("rank")).alias("pos"), "pos").alias("token_pos"), F.col("text").alias("query_token"), F.left("norm", F.lit(1)).alias("q_first"), *[F.col(c).alias(f"q_{c}") for c in PARTS])
    b = with_hashes(base).select(F.col("pair_id").alias("b_id"), "piece", F.struct(F.when(F.col("rank") < 0, 0).otherwise(1).alias("sub"), "rank", "pos").alias("at"), F.col("text").alias("base_substring"), F.left("norm", F.lit(1)).alias("first"), *PARTS)
    met = q.join(b, (F.col("pair_id") == F.col("b_id")) & (F.col("q_first") == F.col("first")), "left")
    near = F.coalesce(parts_distance("q_", ""), F.lit(NOTHING))
    out = met.groupBy("pair_id", "token_pos", "query_token").agg(F.min(F.struct(near.alias("distance"), "piece", "at", "base_substring")).alias("m"))
    number = F.row_number().over(Window.partitionBy("pair_id").orderBy("token_pos")) - 1
    return out.select("pair_id", number.alias("token_pos"), "query_token", F.col("m.base_substring").alias("base_substring"), F.col("m.distance").alias("distance"))


def _texts(df: DataFrame, options: Options) -> DataFrame:
    return expand(df.select("word").distinct(), options.vocabulary).withColumnRenamed("term", "text")
