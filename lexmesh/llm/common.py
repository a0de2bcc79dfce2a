"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a Java class: space and \\t to \\r.
SPACE = r"[ \t-\r]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines of the cluster share: spark.checkpoint.dir. Where it is unset a local folder serves a local master (tests); on a cluster that is an error."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    made = spark.conf.get("lexmesh.local.dir", None)
    if not made:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all machines share")
        made = "file://" + tempfile.mkdtemp(prefix="lexmesh-")
        spark.conf.set("lexmesh.local.dir", made)
    return made


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


_written: list[str] = []

#: With it Spark deletes a query's shuffle files when the query ends; else they stay until the driver collects its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there and a lost executor recomputes nothing above.

    What was shuffled for it is deleted at once, since nothing else reads it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._lexmesh_path = path
    _written.append(path)
    return back


def discard(df: DataFrame) -> None:
    """Delete the files behind a result of cut() that nothing reads any more."""
    delete(df.sparkSession, df._lexmesh_path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it is stored; one that is gone already is no error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def one_at_a_time(stage):
    """Make a stage function (spark, docs, sf_dir) delete what the stage before it had cut.

    That is safe where each stage's result is written before the next one starts, which then reads the written files.
    """

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _of_stages:
            delete(spark, _of_stages.pop())
        before = len(_written)
        out = stage(spark, docs, sf_dir)
        _of_stages.extend(_written[before:])
        return out

    run.__doc__ = stage.__doc__
    return run


_of_stages: list[str] = []

#: Rows of a few bytes that a broadcast may hold.
SMALL_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df, to be broadcast if it has at most so many rows; else it is joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bits of the map that stands for a larger set of keys at most (16 MB).
MAP_BITS = 1 << 27


def semi_join(df: DataFrame, col: str, keys: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """The rows of df whose col is among keys (one column, without repeats, written).

    At most so many keys are broadcast. Of more a bit map is broadcast, 16 bits a key up to MAP_BITS, so that of the other
    rows of df only those that meet a set bit by chance (a sixteenth, more beyond 8 million keys) are shuffled for the join.
    """
    (key,) = keys.columns
    n, exact = keys.count(), F.col(col) == F.col(key)
    if n <= rows:
        return df.join(F.broadcast(keys), exact).select(*df.columns)
    bits = max(1 << 15, min(MAP_BITS, 1 << (16 * n - 1).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    maps = keys.select(F.floor(place(key) / 32768).cast("int").alias("_part"), (place(key) % 32768).alias("_place"))
    maps = maps.groupBy("_part").agg(F.bitmap_construct_agg("_place").alias("_map"))
    maps = maps.select("_part", F.expr("transform(sequence(0, 511), i -> cast(conv(hex(substring(_map, 8 * i + 1, 8)), 16, -10) as bigint))").alias("_words"))
    near = df.withColumn("_place", place(col)).join(F.broadcast(maps), F.floor(F.col("_place") / 32768).cast("int") == F.col("_part"))
    near = near.withColumn("_place", (F.col("_place") % 32768).cast("int"))
    word = F.expr("_words[cast(shiftright(_place, 6) as int)]")  # its first byte holds the highest bits
    met = near.filter(F.getbit(word, F.expr("(7 - shiftright(_place, 3) % 8) * 8 + _place % 8")) == 1)
    return met.join(keys, exact).select(*df.columns)  # inner: Spark would move a semi join below the map


def text_of(col: str | Column) -> Column:
    """The text as a string, a null one as the empty text."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The maximal runs of characters other than space and \\t to \\r, in order, repeats kept."""
    return F.array_remove(F.split(text, SPACE + "+", -1), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Remembered(dict):
    """A bounded memory from keys to what make(keys) gives, in two generations.

    When the young one is full it becomes the old one and a new one begins; what is used again moves over. Frequent keys
    so stay, and never more than 2 * bound are held.
    """

    def __init__(self, make, bound: int):
        super().__init__()
        self.make, self.bound, self.old = make, bound, {}

    def need(self, keys: set) -> None:
        """See that all keys are there, making those that are new."""
        if len(self) > self.bound:
            self.old = dict(self)
            self.clear()
        new = []
        for k in keys.difference(self):
            got = self.old.get(k)
            if got is None:
                new.append(k)
            else:
                self[k] = got
        if new:
            self.update(zip(new, self.make(new), strict=True))
