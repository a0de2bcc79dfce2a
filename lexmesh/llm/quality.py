"""Quality rules with host verdicts: base rules by document, failure rates by host shrunk towards a beta prior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.common import broadcast_if_small, cut, text_of, words_of

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: A host is rejected when its shrunk failure rate is above this: then a page of it is more likely bad than good.
MAX_HOST_RATE = 0.5


def with_features(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """keep and the base counts of each row's whole text, all in one pass within the row.

    Windows are compared by a 64-bit hash first; only rows in which hashes repeat compare the words themselves.
    """
    at = lambda i: [F.get("_w", i + k) for k in range(WINDOW)]
    places = F.sequence(F.lit(0), F.size("_w") - WINDOW)
    enough = F.size("_w") >= WINDOW
    df = docs.select(*keep, text.alias("_t"))
    df = df.select("*", words_of(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n", -1), lambda x: x.rlike("[^ \\t-\\r]")).alias("_l"))
    names = [c for c in docs.select(*keep).columns]
    df = df.select(
        *[F.col(f"`{c}`") for c in names],
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size(F.split("_t", r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(enough, F.transform(places, lambda i: F.xxhash64(*at(i)))).alias("_h"),
    )
    # Rows whose window hashes are all different need no more; the others sort (hash, words, place).
    df = df.withColumn("_again", enough & (F.size(F.array_distinct("_h")) < F.size("_h")))
    df = df.withColumn("_s", F.when(F.col("_again"), F.sort_array(F.transform(places, lambda i: F.struct(F.get("_h", i).alias("h"), F.concat_ws(" ", *at(i)).alias("k"), i.alias("p"))))))
    df = df.drop("_w", "_h", "_again")

    def same(i: Column, j: Column) -> Column:
        return F.coalesce((F.get("_s", i)["h"] == F.get("_s", j)["h"]) & (F.get("_s", i)["k"] == F.get("_s", j)["k"]), F.lit(False))

    repeated = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: same(i, i - 1) | same(i, i + 1))
    df = df.withColumn("_r", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(repeated, lambda i: F.get("_s", i)["p"]))))
    covered = F.aggregate(
        "_r",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end")),
        lambda a: a["n"].cast("long"),
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_s", "_r")
    bad = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", bad)


def host_verdicts(features: DataFrame, host: str = "_host", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: its documents, its failures, its shrunk failure rate and whether it is rejected.

    The prior is Beta(a, b) with the mean m and the variance v of the hosts' raw rates: a + b = m(1-m)/v - 1. If all rates
    are equal it is as strong as all documents together; a variance too large for a beta gives no prior. The two moments
    are one row on the driver; hosts stay distributed.
    """
    by = features.groupBy(host).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    raw = F.col("host_failed") / F.col("host_docs")
    row = by.agg(F.avg(raw).alias("m"), F.var_pop(raw).alias("v"), F.sum("host_docs").alias("n")).first()
    m, v, n = row["m"] or 0.0, row["v"] or 0.0, row["n"] or 0
    strength = float(n) if v <= 1e-15 else max(0.0, m * (1 - m) / v - 1)
    rate = (F.col("host_failed") + m * strength) / (F.col("host_docs") + strength)
    return by.withColumn("host_rate", rate).withColumn("host_rejected", F.col("host_rate") > max_rate)


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, the base counts, base_failed, host figures and kept of every row of docs.

    Nulls: a null text has no words and fails; null hosts form one host; a null doc_id stays null. Empty texts fail
    (fewer than ten words). Repeated rows each give a row. An empty table gives none. Other columns are not read, so
    their names cannot clash.
    """
    features = cut(with_features(docs, text_of(text), [F.col(doc_id).alias("doc_id"), F.col(host).alias("_host")]), "quality")
    verdicts = host_verdicts(features).withColumnRenamed("_host", "_of")
    out = features.join(verdicts, F.col("_host").eqNullSafe(F.col("_of")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_docs", "host_failed", "host_rejected", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    features = cut(with_features(docs, text_of(text), [row, F.col(host).alias("_host")]).select("_row", "_host", "base_failed"), "quality")
    verdicts = host_verdicts(features.select("_host", "base_failed"))
    rejected = broadcast_if_small(cut(verdicts.filter("host_rejected").select(F.col("_host").alias("_of")), "rejected"))
    good = features.filter(~F.col("base_failed")).join(rejected, F.col("_host").eqNullSafe(F.col("_of")), "left_anti")
    return good.select("_row.*")


ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls, row_number() OVER () AS rid FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 3)) AS p, ws FROM w WHERE len(ws) >= 5),
k AS (SELECT rid, p, list_aggregate(ws[p:p+4], 'string_agg', ' ') AS s FROM g),
c AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, s) AS n FROM k),
cov AS (SELECT DISTINCT rid, unnest(range(p, p + 5)) AS q FROM c WHERE n >= 2),
r AS (SELECT rid, count(*) AS n_repeat_words FROM cov GROUP BY rid),
f AS (SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f),
h AS (SELECT source, count(*)::BIGINT AS host_docs, count(*) FILTER (base_failed)::BIGINT AS host_failed FROM b GROUP BY source),
m AS (SELECT avg(host_failed / host_docs) AS m, var_pop(host_failed / host_docs) AS v, sum(host_docs)::DOUBLE AS n FROM h),
p AS (SELECT m, CASE WHEN v <= 1e-15 THEN n ELSE greatest(0, m * (1 - m) / v - 1) END AS s FROM m),
v AS (SELECT h.*, (host_failed + p.m * p.s) / (host_docs + p.s) > {MAX_HOST_RATE} AS host_rejected FROM h, p)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_docs, host_failed, host_rejected,
  NOT base_failed AND NOT host_rejected AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
