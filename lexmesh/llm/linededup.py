"""Fuzzy line deduplication by MinHash of character shingles.

Signatures and the verification are Arrow functions; made of built-in functions alone, signatures cost several times the
time that a run may take (see the README). Search, comparison order and components are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.llm import minhash
from lexmesh.llm.common import cut, text_of
from lexmesh.llm.graph import components

SHINGLE = 5
SIMILARITY_PERCENT = 80
#: 16 bands of 6: a pair of similarity 0.8 meets in one with probability 0.992, one of 0.9 with 0.999997, one of 0.3 with 0.012.
BANDS, ROWS = 16, 6


def listed_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of docs (_rid, _doc, _t): (_rid, _doc, _lines) of every row, its lines with a word as (no, key), written; and (_key, _line) with repeats.

    The key is the line's md5, 128 bits: equal keys count as equal lines.
    """
    key = lambda line: F.unhex(F.md5(line))
    wordy = lambda line: line.rlike("[^ \\t-\\r]")
    numbered = F.transform(F.split("_t", "\n", -1), lambda x, i: F.when(wordy(x), F.struct(i.alias("no"), key(x).alias("key"))))
    lists = cut(docs.select("_rid", "_doc", F.filter(numbered, lambda x: x.isNotNull()).alias("_lines")), "lists")
    lines = docs.select(F.explode(F.split("_t", "\n", -1)).alias("_line")).filter(wordy(F.col("_line")))
    return lists, lines.select(key("_line").alias("_key"), "_line")


def line_classes(lists: DataFrame, lines: DataFrame) -> DataFrame:
    """(_rid, _doc, _no, component, kept) of every line with a word: equal and similar lines form one component, chains included.

    The first line of a component in the order of (doc_id, line number) is kept; among rows of one doc_id the row number
    decides. Candidates share a band and are compared exactly (see similar_links).
    """
    places = lists.select("_rid", "_doc", F.inline("_lines").alias("_no", "_key"))
    roots = components(minhash.similar_links(lines, minhash.Characters(SHINGLE), BANDS, ROWS, SIMILARITY_PERCENT))
    classed = cut(places.join(roots, F.col("_key") == F.col("node"), "left").withColumn("component", F.coalesce("root", "_key")).drop("node", "root", "_key"), "classed")
    last = F.coalesce("_doc", F.lit(2**63 - 1))
    heads = classed.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min(last).alias("_d")).filter("n > 1").select(F.col("component").alias("_c"), "_d")
    # Lines of components of one line are kept; of the others those of the least document are told apart.
    least = classed.join(heads, (F.col("component") == F.col("_c")) & (last == F.col("_d"))).groupBy("_c").agg(F.min(F.struct("_no", "_rid")).alias("_head"))
    out = classed.join(least, F.col("component") == F.col("_c"), "left")
    first = (F.col("_rid") == F.col("_head._rid")) & (F.col("_no") == F.col("_head._no"))
    return out.select("_rid", "_doc", "_no", "component", F.coalesce(first, F.lit(True)).alias("kept"))


def dedup_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines and n_removed of every row of docs.

    Nulls, empty texts and lines without words have no lines and lose none; blank lines always stay. A null doc_id comes
    last in the order. Repeated rows are documents of their own, the later ones losing their lines. An empty table gives
    no rows. Other columns are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), F.col(doc_id).cast("long").alias("_doc"), text_of(text).alias("_t"))
    lists, lines = listed_lines(rows)
    by = line_classes(lists, lines).groupBy("_rid").agg(F.count(F.lit(1)).alias("n_lines"), F.sum((~F.col("kept")).cast("long")).alias("n_removed")).withColumnRenamed("_rid", "_r")
    zero = F.lit(0).cast("long")
    out = lists.select("_rid", "_doc").join(by, F.col("_rid") == F.col("_r"), "left")
    return out.select(F.col("_doc").alias("doc_id"), F.coalesce("n_lines", zero).alias("n_lines"), F.coalesce("n_removed", zero).alias("n_removed"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the later lines of each component taken out of their texts; all columns and rows stay.

    Nulls, empty texts, ties, repeated rows and empty tables are as in dedup_report; a null text stays null. Columns may
    have any names: rows travel as one struct.
    """
    packed = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = cut(packed.select(F.monotonically_increasing_id().alias("_rid"), F.col("_id").cast("long").alias("_doc"), text_of("_text").alias("_t"), "_row"), "rows")
    gone = line_classes(*listed_lines(rows.drop("_row"))).filter("not kept").groupBy("_rid").agg(F.collect_list("_no").alias("_gone")).withColumnRenamed("_rid", "_r")
    met = rows.select("_rid", "_row").join(gone, F.col("_rid") == F.col("_r"), "left")
    kept = F.array_join(F.filter(F.split(F.col(f"_row.`{text}`"), "\n", -1), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    new = F.when(F.col("_gone").isNull(), F.col(f"_row.`{text}`")).otherwise(kept)
    return met.select(*[(new if c == text else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
