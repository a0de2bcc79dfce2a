"""Benchmark decontamination: size-partitioned MinHash containment search, verified on the shingles themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.common import broadcast_if_small, cut, text_of, words_of

SHINGLE = 5
CONTAINMENT_PERCENT = 80
#: Bytes of the items' shingles (their texts' length, and 40 for each row's frame) that a broadcast may hold; a larger benchmark joins by shuffle.
MAX_BROADCAST_BYTES = 64 << 20


def shingles(words: str, build) -> Column:
    """build(five words) at every place of the array column words; a shorter text has one shingle, all its words."""
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: build([F.get(words, i + k) for k in range(SHINGLE)]))
    short = F.array(build([F.get(words, F.lit(k)) for k in range(SHINGLE)]))
    return F.when(n >= SHINGLE, each).when(n > 0, short).otherwise(F.slice(short, 1, 0))


def hashes(words: str) -> Column:
    return shingles(words, lambda w: F.xxhash64(*w))


def strings(words: str) -> Column:
    return F.array_distinct(shingles(words, lambda w: F.concat_ws(" ", *w)))


def item_sketches(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_iid, sketch hash) and (_iid, item id, shingle count, shingle).

    Items are partitioned by size into classes of a factor of two. In a class of at most u shingles each item is
    sketched by its 1 + floor(u / 5) smallest shingle hashes. A document that contains four fifths of an item's shingles
    lacks at most a fifth of them, so it holds at least one of the sketch: the search misses nothing.
    """
    df = items.select("_item", strings("_w").alias("_s")).distinct().withColumn("n_item", F.size("_s").cast("long")).filter("n_item > 0")
    df = cut(df.withColumn("_iid", F.monotonically_increasing_id()), "items")
    largest = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n_item").cast("double"))) + 1) - 1
    depth = (1 + F.floor(largest * (100 - CONTAINMENT_PERCENT) / 100)).cast("int")
    sketch = F.slice(F.sort_array(F.transform("_s", lambda s: F.xxhash64(F.get(F.split(s, " "), F.lit(0)), *[F.get(F.split(s, " "), F.lit(k)) for k in range(1, SHINGLE)]))), 1, depth)
    return df.select("_iid", F.explode(sketch).alias("_h")), df.select("_iid", "_item", "n_item", F.explode("_s").alias("_shingle"))


def contained_items(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs (_rid, _doc, _item, n_item, n_shared) with at least 80 % of the item's distinct shingles in the row's text.

    rows: _rid (unique), _doc, _t (text); items: _item, _t.
    """
    prepared = lambda df: df.withColumn("_w", words_of(F.lower("_t"))).drop("_t")
    sketches, exact = item_sketches(prepared(items))
    small = (exact.agg(F.sum(F.octet_length("_shingle") + 40)).first()[0] or 0) <= MAX_BROADCAST_BYTES
    hint = F.broadcast if small else (lambda x: x)
    # Each row's different shingles only; without a broadcast, a shingle that very many rows have is a skewed join that Spark splits.
    probe = prepared(rows).select("_rid", F.explode(F.array_distinct(hashes("_w")) if not small else hashes("_w")).alias("_h"))
    found = cut(probe.join(hint(sketches), "_h").select("_rid", "_iid").distinct(), "candidates")
    # Only candidates' texts are read again, and only their shingles go out of the row.
    texts = rows.join(found.select("_rid").distinct(), "_rid").withColumn("_w", words_of(F.lower("_t")))
    spread = texts.select("_rid", "_doc", F.explode(strings("_w")).alias("_shingle"))
    shared = spread.join(hint(exact), "_shingle").groupBy("_rid", "_iid").agg(F.first("_doc").alias("_doc"), F.first("_item").alias("_item"), F.first("n_item").alias("n_item"), F.count(F.lit(1)).alias("n_shared"))
    shared = shared.filter(100 * F.col("n_shared") >= CONTAINMENT_PERCENT * F.col("n_item"))
    return shared.join(found, ["_rid", "_iid"], "left_semi")


def keyed(docs: DataFrame, doc_id: str, *what: Column) -> DataFrame:
    return cut(docs.select(F.monotonically_increasing_id().alias("_rid"), F.col(doc_id).alias("_doc"), *what), "keyed")


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_item and n_shared: the pairs in which a document contains a benchmark item.

    Words are lower-cased; shingles are five words, and an item of fewer words is one shingle, found in documents
    of just those words. Nulls and empty texts contain nothing and are contained nowhere. Repeated rows give a pair
    each; benchmark rows that repeat count once, rows of one id, or of none (null), with different texts are items of
    their own. Empty tables give no pairs. Other columns are not read.
    """
    items = benchmark.select(F.col(item_id).alias("_item"), text_of(item_text).alias("_t"))
    found = contained_items(keyed(docs, doc_id, text_of(text).alias("_t")), items)
    return found.select(F.col("_doc").alias("doc_id"), F.col("_item").alias("item_id"), "n_item", "n_shared")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that contain no benchmark item, with all their columns.

    Items count whatever their id, a null one included. Rows with null or empty texts contain nothing and stay, as does
    every row if the benchmark is empty. Rows that repeat are judged alike. Columns may have any names: rows travel as one
    struct.
    """
    items = benchmark.select(F.col(item_id).alias("_item"), text_of(item_text).alias("_t"))
    rows = keyed(docs, doc_id, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    bad = contained_items(rows.select("_rid", "_doc", text_of(F.col(f"_row.`{text}`")).alias("_t")), items).select("_rid").distinct()
    bad = broadcast_if_small(cut(bad, "leaks"))
    return rows.join(bad, "_rid", "left_anti").select("_row.*")


ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, w, row_number() OVER () AS iid FROM (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL)),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[p:p+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT iid, item_id, array_to_string(w[p:p+4], ' ') AS s FROM (SELECT iid, item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM b WHERE len(w) > 0)),
n AS (SELECT iid, count(*)::BIGINT AS n_item FROM bs GROUP BY iid),
m AS (SELECT ds.doc_id, bs.iid, bs.item_id, count(*)::BIGINT AS n_shared FROM ds JOIN bs ON ds.s = bs.s GROUP BY ds.doc_id, bs.iid, bs.item_id)
SELECT doc_id, m.item_id AS item_id, n_item, n_shared FROM m JOIN n ON m.iid = n.iid WHERE 100 * n_shared >= {CONTAINMENT_PERCENT} * n_item
"""
