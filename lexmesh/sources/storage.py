"""Tables in the folder that all machines share, vocabularies, permutations, file listings and JSON indexes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmesh.functions.text import check_vocabulary

INDEX_JSON = "map<string,struct<hash2ix:map<string,array<bigint>>,invalid_indices:array<bigint>>>"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local folder serves a local master (tests); on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lexmesh.folder", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="lexmesh-index-")
        spark.conf.set("lexmesh.folder", found)
    return found.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, so that its lineage ends there."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_vocabulary(spark: SparkSession, path: str) -> list[str]:
    """One lower-case word a line, longest first, then by code point. The words go to every task, so they are few by nature."""
    words = [r[0] for r in spark.read.text(path).select(F.trim("value")).filter("trim(value) <> ''").distinct().collect()]
    check_vocabulary(words)
    return sorted(words, key=lambda w: (-len(w), w))


def list_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(key, text): the names of the files below a folder, keys from 0 by name, equal names by path. Names alone are sorted by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select(F.element_at(F.split("path", "/"), -1).alias("text"), "path")
    return files.select((F.row_number().over(Window.orderBy("text", "path")) - 1).cast("long").alias("key"), "text")


def write_json(name: str, postings: DataFrame, hashes: DataFrame, invalid: DataFrame, path: str) -> None:
    """One JSON object a folder: {name: {"hash2ix": {hash key: [keys]}, "invalid_indices": [keys]}}, hash keys in insertion order.

    The format holds the index in one object, so it is for indexes that one machine can hold; tables have no such bound.
    """
    lists = postings.groupBy("hash_key").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    entries = hashes.join(lists, "hash_key").agg(F.sort_array(F.collect_list(F.struct("first_seen", "hash_key", "keys"))).alias("e"))
    body = F.map_from_entries(F.transform("e", lambda x: F.struct(x["hash_key"], x["keys"])))
    gone = invalid.agg(F.sort_array(F.collect_set("key")).alias("g"))
    whole = F.create_map(F.lit(name), F.struct(body.alias("hash2ix"), F.col("g").alias("invalid_indices")))
    entries.join(gone).select(F.to_json(whole).alias("value")).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> tuple[str, DataFrame, DataFrame]:
    """(name, (hash_key, place, keys), (key)) of a JSON index. Fails before anything is replaced if a part is missing."""
    raw = spark.read.text(path, wholetext=True).filter("trim(value) <> ''")
    parsed = raw.select(F.from_json("value", INDEX_JSON).alias("m")).select(F.map_entries("m").alias("e"))
    head = parsed.select(F.get("e", F.lit(0))["key"].alias("name"), F.get("e", F.lit(0))["value"]["hash2ix"].isNull().alias("no_hashes"), F.get("e", F.lit(0))["value"]["invalid_indices"].isNull().alias("no_invalid")).first()
    if head is None or head["name"] is None or head["no_hashes"]:
        raise ValueError("expected hash2ix key")
    if head["no_invalid"]:
        raise ValueError("expected invalid_indices key")
    one = parsed.select(F.get("e", F.lit(0))["value"].alias("v"))
    hashes = one.select(F.posexplode(F.map_entries("v.hash2ix")).alias("place", "h")).select(F.col("h.key").alias("hash_key"), "place", F.col("h.value").alias("keys"))
    return head["name"], hashes, one.select(F.explode("v.invalid_indices").alias("key"))


def vocabulary_or_empty(vocabulary: Sequence[str] | None) -> list[str]:
    out = list(vocabulary or [])
    check_vocabulary(out)
    return out
