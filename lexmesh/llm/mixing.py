"""Mixing sources to target weights by weighted fair queueing in virtual time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.llm.common import cut, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_PASSES = 2
#: Hex digits of the shuffle key that name a bucket: 4,096 buckets a source, so that no source is summed by one task.
BUCKET_DIGITS = 3


def source_targets(by: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = MAX_PASSES) -> DataFrame:
    """Add weight and target to one row per source (_source, source_size).

    Sources by code point, null last, take the weights in turn. A target is min(passes * size, weight * level), where
    level shares what the capped sources leave by weight. With sources in the order of cap / weight, level is the largest
    of (budget - caps before) / (weights from here on). Only one row per source is ordered here, never documents.
    """
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    df = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    df = df.withColumn("_cap", F.lit(float(passes)) * F.col("source_size"))
    before = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    budget = F.lit(float(share)) * F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    df = df.withColumn("_level", level)
    df = df.withColumn("target", F.least("_cap", F.col("weight") * F.max("_level").over(everything)))
    return df.select("_source", "source_size", "weight", "target")


def schedule(sized: DataFrame) -> DataFrame:
    """Give each row (_id, _source, size, ...) its place in its source's shuffled queue.

    Adds source_size, target and start, the words that the source serves before this row in its first pass; the second
    pass repeats the order, so the row then starts at source_size + start. The shuffle key is md5 of the id: reruns
    agree; rows of one id follow by size. Running sums are made in two levels (bucket totals, then within a bucket), so
    a source with a third of all rows spreads over 4,096 buckets.
    """
    sized = sized.withColumn("_key", F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("")))).withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    sums = cut(sized.groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum")), "mixing")
    targets = source_targets(sums.groupBy("_source").agg(F.sum("_sum").alias("source_size"))).withColumnRenamed("_source", "_ts")
    upto = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_source", "_bucket", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_base"))
    base = base.join(targets, F.col("_source").eqNullSafe(F.col("_ts"))).drop("_ts").withColumnsRenamed({"_source": "_bs", "_bucket": "_bb"})
    placed = sized.join(base, F.col("_source").eqNullSafe(F.col("_bs")) & (F.col("_bucket") == F.col("_bb"))).drop("_bs", "_bb")
    within = Window.partitionBy("_source", "_bucket").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("start", F.col("_base") + F.sum("size").over(within) - F.col("size")).drop("_key", "_bucket", "_base")


#: Range partitions of virtual time on either side of 1; the one running sum over them has a row each.
RANGES = 4096


def budget(total: Column | int, share: float = SHARE, passes: int = MAX_PASSES) -> Column:
    """Words that the mix holds: what the targets add up to."""
    return F.floor(F.lit(float(min(share, passes))) * total + 0.5).cast("long")


def packets(scheduled: DataFrame) -> DataFrame:
    """(_rid, _source, pass, size, lo, words, finish): what the queues serve, a row for each copy of a row's words.

    lo: words that the source has served before; finish: virtual finish time, the source's words up to the packet's end
    by its target. The copy in service at the end of its source's target is served as two packets, so that the mix can
    stop between them.
    """
    goal = F.floor(F.col("target") + 0.5).cast("long")
    out = scheduled.filter("size > 0").select("_rid", "_source", "size", "target", "start", "source_size", F.explode(F.sequence(F.lit(0), F.lit(MAX_PASSES - 1))).alias("pass"))
    out = out.withColumn("_from", F.col("start") + F.col("pass") * F.col("source_size")).withColumn("_to", F.col("_from") + F.col("size"))
    part = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    whole = F.array(part(F.col("_from"), F.col("_to")))
    parts = F.when((F.col("_from") < goal) & (goal < F.col("_to")), F.array(part(F.col("_from"), goal), part(goal, F.col("_to")))).otherwise(whole)
    out = out.withColumn("_p", F.explode(parts))
    return out.select("_rid", "_source", "pass", "size", F.col("_p.lo").alias("lo"), (F.col("_p.hi") - F.col("_p.lo")).alias("words"), (F.col("_p.hi") / F.col("target")).alias("finish"))


def taken_packets(served: DataFrame, total: Column) -> DataFrame:
    """Add taken: the words that fit into the budget when packets go out in the order of virtual finish time.

    Packets are sorted by ranges of virtual time: words are summed by range, the ranges' sums run up to each range, and
    within a range packets run up in order of finish, source and place. Queues are shuffled, so ranges are about even;
    the times after 1 map to as many ranges.
    """
    time = F.when(F.col("finish") <= 1, F.col("finish")).otherwise(2 - 1 / F.col("finish"))
    served = cut(served.withColumn("_range", F.floor(time * RANGES).cast("int")), "packets")
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = served.groupBy("_range").agg(F.sum("words").alias("_words")).select(F.col("_range").alias("_r"), F.coalesce(F.sum("_words").over(upto), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_range").orderBy("finish", F.col("_source").asc_nulls_last(), "lo").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = served.join(F.broadcast(before), F.col("_range") == F.col("_r"))  # 2 * RANGES + 1 rows at most
    left = total - (F.col("_before") + F.sum("words").over(within) - F.col("words"))
    return out.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("words"), left)).cast("long")).drop("_range", "_r", "_before")


def mixed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(schedule, packets with the words taken) of sized rows (_rid, _id, _source, size)."""
    placed = cut(schedule(rows), "placed")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return placed, taken_packets(packets(placed), budget(F.lit(total)))


def sized_rows(docs: DataFrame, doc_id: str, text: str, source: str, row: list[Column]) -> DataFrame:
    """(_rid, _id, _source, size) and row of docs, written."""
    size = F.regexp_count(text_of(text), F.lit("[^ \\t-\\r]+")).cast("long").alias("size")
    return cut(docs.select(F.monotonically_increasing_id().alias("_rid"), F.col(doc_id).alias("_id"), F.col(source).cast("string").alias("_source"), size, *row), "sizes")


def mix_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target and the words taken, for every row of docs.

    Nulls: a null text has size 0 and nothing of it is taken; null sources form the last source. Empty texts are of size
    0. Rows that repeat are documents of their own. An empty table gives no rows. Other columns are not read.
    """
    placed, served = mixed(sized_rows(docs, doc_id, text, source, []))
    taken = served.groupBy("_rid").agg(F.sum("taken").alias("taken")).withColumnRenamed("_rid", "_t")
    out = placed.join(taken, F.col("_rid") == F.col("_t"), "left")
    return out.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus in virtual-time order: rows of docs, a row once for each copy taken.

    A document is delivered whole: a copy goes in if at least half of its words do. Texts without words (null, empty,
    blank) take no words and aren't delivered. Null sources form the last source; rows that repeat, or share an id, are
    documents of their own; copies of equal finish time go by row number. An empty table gives no rows. Columns may have
    any names: rows travel as one struct.
    """
    rows = sized_rows(docs, doc_id, text, source, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")])
    _, served = mixed(rows.drop("_row"))
    copies = served.groupBy("_rid", "pass").agg(F.max("finish").alias("finish"), F.first("size").alias("size"), F.sum("taken").alias("taken")).filter(2 * F.col("taken") >= F.col("size"))
    times = copies.groupBy("_rid").agg(F.sort_array(F.collect_list("finish")).alias("_times")).withColumnRenamed("_rid", "_t")  # of two passes
    met = rows.select("_rid", "_row").join(times, F.col("_rid") == F.col("_t"))
    return met.select("_rid", "_row", F.explode("_times").alias("_finish")).orderBy("_finish", "_rid").select("_row.*")


ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN {WEIGHTS[0]}.0::DOUBLE WHEN 1 THEN {WEIGHTS[1]}.0::DOUBLE ELSE {WEIGHTS[2]}.0::DOUBLE END AS weight,
        {MAX_PASSES}.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lvl FROM o
      WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, weight * (SELECT max(lvl) FROM l)) AS target FROM l),
p AS (SELECT d.*, row_number() OVER () AS rid, sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start FROM d),
j AS (SELECT rid, doc_id, p.source, size, source_size, target, floor(target + 0.5)::BIGINT AS goal, start::BIGINT AS start FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, start + pass * source_size AS a, start + pass * source_size + size AS z FROM j, (SELECT unnest(range(0, {MAX_PASSES})) AS pass) WHERE size > 0),
k AS (SELECT rid, source, target, a AS lo, CASE WHEN a < goal AND goal < z THEN goal ELSE z END AS hi FROM c UNION ALL SELECT rid, source, target, goal, z FROM c WHERE a < goal AND goal < z),
r AS (SELECT rid, hi - lo AS words, sum(hi - lo) OVER (ORDER BY hi / target, source NULLS LAST, lo ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k),
g AS (SELECT rid, sum(greatest(0, least(words, (SELECT floor({float(min(SHARE, MAX_PASSES))}::DOUBLE * sum(size) + 0.5)::BIGINT FROM d) - upto + words)))::BIGINT AS taken FROM r GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM j LEFT JOIN g ON j.rid = g.rid
"""
