"""The index as an object: add documents one by one or as tables, search, mark keys invalid, save and load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmesh.functions.distance import hash_parts
from lexmesh.functions.translit import icu_table
from lexmesh.operators.explain import explain_match
from lexmesh.operators.index import HASH_COLUMNS, Options, index_batch
from lexmesh.operators.search import CANDIDATES, THRESHOLD, TOP, search
from lexmesh.sources.storage import read_json, read_vocabulary, settle, write_json

POSTINGS = "hash_key string, key bigint"
HASHES = "hash_key string, hash70 string, unigram string, check string, c0 bigint, c1 bigint, c2 bigint, c3 bigint, first_seen struct<doc:bigint,sub:int,pos:int>"


class FuzzyIndex:
    """A keyword index that finds misspelt words.

    Documents given one at a time wait on the driver until the next search, save or statistic needs them, then are indexed
    as one batch. Tables of any size go in by update_many. Tables are settled in the shared folder after each batch.
    """

    def __init__(self, spark: SparkSession, name: str = "keywordsearch", file_path: str | None = None, vocabulary: Sequence[str] | str = (), permutation: Sequence[int] | None = None, options: Options | None = None):
        self.spark, self.name = spark, name
        words = read_vocabulary(spark, vocabulary) if isinstance(vocabulary, str) else vocabulary
        self.options = options or Options(vocabulary=words, permutation=permutation, letters=icu_table(spark))
        self._clear()
        if file_path is not None:
            ok, message = self.load(file_path)
            if not ok:
                raise FileNotFoundError(message)

    def _clear(self) -> None:
        self.postings, self.hashes = self.spark.createDataFrame([], POSTINGS), self.spark.createDataFrame([], HASHES)
        self.invalid = self.spark.createDataFrame([], "key bigint")
        self.updates, self._next, self._waiting = 0, 0, []

    def update(self, data: str, key: int, use_extended_tokenizer: bool = True) -> None:
        """Add one document. What the key was indexed under before stays."""
        self._waiting.append((int(key), data, self._next, use_extended_tokenizer))
        self._next += 1
        self.updates += 1

    def update_many(self, docs: DataFrame, use_extended_tokenizer: bool = True, order: str | None = None, replace: bool = False) -> None:
        """Add the documents (key, text); among them insertion order is by the column order, key by default.

        replace=True first takes the keys' earlier postings away.
        """
        self._flush()
        if replace:
            self.postings = settle(self.postings.join(docs.select("key").distinct(), "key", "left_anti"), "postings")
        n = docs.count()
        self.updates += n
        placed = docs.select("key", "text", F.col(order or "key").cast("long").alias("_order"))
        least, most = placed.agg(F.min("_order"), F.max("_order")).first()
        placed = placed.withColumn("_order", F.col("_order") - F.lit(least or 0) + self._next)
        self._next += (most or 0) - (least or 0) + 1
        self._add(*index_batch(placed, self.options, use_extended_tokenizer, "_order"))

    def _add(self, postings: DataFrame, hashes: DataFrame) -> None:
        fresh = postings.join(self.postings, ["hash_key", "key"], "left_anti")
        new = hashes.join(self.hashes, "hash_key", "left_anti").select(*HASH_COLUMNS, "first_seen")
        cast = new.withColumn("first_seen", F.col("first_seen").cast("struct<doc:bigint,sub:int,pos:int>"))
        self.postings, self.hashes = settle(self.postings.unionByName(fresh), "postings"), settle(self.hashes.unionByName(cast), "hashes")

    def _flush(self) -> None:
        for extended in (True, False):
            rows = [r[:3] for r in self._waiting if r[3] == extended]
            if rows:
                self._add(*index_batch(self.spark.createDataFrame(rows, "key bigint, text string, ord bigint"), self.options, extended, "ord"))
        self._waiting = []

    def query_many(self, queries: DataFrame, threshold: int = THRESHOLD, candidate_cap: int | None = CANDIDATES, top_k: int | None = TOP) -> DataFrame:
        """Ranked keys of (query_id, query)."""
        self._flush()
        return search(queries, self.postings, self.hashes, self.options, threshold, candidate_cap, top_k, self.invalid)

    def query(self, query: str, threshold: int = THRESHOLD, timed: bool = False, limit: int | None = None) -> list[tuple[int, list[int]]]:
        """(key, scores by term) of one query, best first. Nothing is cached, so timed changes nothing."""
        found = self.query_many(self.spark.createDataFrame([(0, query)], "query_id int, query string"), threshold)
        found = found.orderBy(F.desc("total"), "first_part", "first_place", "key")
        return [(r["key"], list(r["scores"])) for r in (found if limit is None else found.limit(limit)).select("key", "scores").collect()]

    def invalidate(self, key: int) -> None:
        """Leave a key out of all results from now on."""
        self.invalid = settle(self.invalid.unionByName(self.spark.createDataFrame([(int(key),)], "key bigint")).distinct(), "invalid")

    def stats(self) -> dict[str, int | str]:
        self._flush()
        return {"name": self.name, "updates": self.updates, "keys": self.postings.select("key").distinct().count(), "hashes": self.hashes.count(), "invalid": self.invalid.distinct().count()}

    def __str__(self) -> str:
        s = self.stats()
        return f"FuzzyIndex: {s['name']}\nUpdates: {s['updates']}\nKeys indexed: {s['keys']}\nUnique hashes: {s['hashes']}\nInvalid keys: {s['invalid']}"

    def explain(self, word: str, paragraph: str) -> DataFrame:
        if " " in word:
            raise ValueError("expected a word, not a sentence")
        return explain_match(self.spark.createDataFrame([(0, word, paragraph)], "pair_id int, word string, paragraph string"), self.options)

    def save(self, path: str) -> tuple[bool, str]:
        """Write the JSON form to a folder (see write_json)."""
        self._flush()
        write_json(self.name, self.postings, self.hashes, self.invalid, path)
        return True, ""

    def load(self, path: str) -> tuple[bool, str]:
        """Replace the index by a JSON form, a file or a folder. Nothing changes unless all of it is there."""
        try:
            name, hashes, invalid = read_json(self.spark, path)
        except ValueError as e:
            return False, str(e)
        except AnalysisException:
            return False, f"{path} doesn't exist"
        self._clear()
        self.name = name
        entries = hashes.withColumns({"hash70": F.left("hash_key", F.lit(70)), "unigram": F.substring("hash_key", 71, 1)})
        seen = F.struct(F.col("place").cast("long").alias("doc"), F.lit(0).alias("sub"), F.lit(0).alias("pos"))
        self.hashes = settle(entries.select("hash_key", "hash70", "unigram", *hash_parts(F.col("hash70")), seen.alias("first_seen")), "hashes")
        self.postings = settle(hashes.select("hash_key", F.explode("keys").alias("key")), "postings")
        self.invalid = settle(invalid, "invalid")
        self._next = self.hashes.count()
        return True, ""

    def save_tables(self, path: str) -> None:
        """Write Parquet tables, hashes partitioned by block so that a search reads only the blocks of its terms."""
        self._flush()
        self.postings.write.mode("overwrite").parquet(f"{path}/postings")
        self.hashes.repartition("unigram").write.mode("overwrite").partitionBy("unigram").parquet(f"{path}/hashes")
        self.invalid.write.mode("overwrite").parquet(f"{path}/invalid")
        self.spark.createDataFrame([(self.name, self.updates, self._next)], "name string, updates bigint, next bigint").write.mode("overwrite").parquet(f"{path}/meta")

    def load_tables(self, path: str) -> None:
        row = self.spark.read.parquet(f"{path}/meta").first()
        self.name, self.updates, self._next, self._waiting = row["name"], row["updates"], row["next"], []
        self.postings, self.invalid = self.spark.read.parquet(f"{path}/postings"), self.spark.read.schema("key bigint").parquet(f"{path}/invalid")
        self.hashes = self.spark.read.schema(HASHES).parquet(f"{path}/hashes").select(*HASH_COLUMNS, "first_seen")

    def reset(self, path: str) -> None:
        """Empty the index and write the empty form to path; the name stays."""
        self._clear()
        self.save(path)
