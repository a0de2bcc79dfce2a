"""SimHash near-duplicates: fingerprints of word shingles, linked by a generalised pigeonhole search."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lexmesh.llm.common import cut, text_of
from lexmesh.llm.graph import components

SHINGLE = 3
DISTANCE = 2
BITS = 64
#: Members of one key that a task compares at a time; larger keys are compared block by block in many tasks.
BLOCK = 1024


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of the text's shingles of width words, repeats counted; 0 without words."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    ones, step, total = np.zeros(BITS, np.int64), 1 << 16, len(words) - width + 1
    for at in range(0, total, step):
        part = words[at : at + step + width - 1]
        hashed = np.array([xxhash.xxh64_intdigest(b" ".join(s), 42) for s in zip(*(part[k:] for k in range(width)), strict=False)], np.uint64)
        ones += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype=np.uint64).astype(np.int64)


def _bit_table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often bits i and j are both set, over the fingerprints of this partition: 64 * 64 rows."""
    both = np.zeros((BITS, BITS))
    for pdf in batches:
        bits = np.unpackbits(pdf["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        for at in range(0, len(bits), 65536):
            both += bits[at : at + 65536].T @ bits[at : at + 65536]
    i, j = np.divmod(np.arange(BITS * BITS), BITS)
    yield pd.DataFrame({"i": i, "j": j, "n": both.ravel().astype(np.int64)})


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Deal the bits into parts, correlated bits together: each part grows from the free bit with the largest correlations."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        width = (BITS - sum(map(len, out))) // (parts - k)
        own = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.remove(own[0])
        while len(own) < width:
            nxt = max(sorted(free), key=lambda b: corr[b, own].sum())
            own.append(nxt)
            free.remove(nxt)
        out.append(sorted(own))
    return out


def masks(bits: list[int], threshold: int) -> list[int]:
    """Keep-masks of a part: values within the threshold are equal under at least one (all choices of bits left out)."""
    whole = sum(1 << b for b in bits)
    return [whole - sum(1 << b for b in left) for left in combinations(bits, threshold)]


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of least cost that sum to total, by dynamic programming over the parts; -1 leaves a part out."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for done, (cost, chosen) in best.items():
            for t, c in options.items():
                if done + t not in nxt or cost + c < nxt[done + t][0]:
                    nxt[done + t] = (cost + c, [*chosen, t])
        best = nxt
    return best[total]


def plan_search(prints: DataFrame, distance: int = DISTANCE, part_counts: tuple[int, ...] = (2, 3, 4)) -> list[int]:
    """The keep-masks to group fingerprints by, from counts over all of them.

    Parts are 64/m wide; thresholds may differ and sum to distance - m + 1 (general pigeonhole: some part of a pair is
    then within its own). A threshold's cost is the rows it makes plus the pairs it must verify: for 0 exact, the
    squares of the value counts; for more, scaled by the odds that a bit differs. The driver sees 64 * 64 bit counts and
    one sum a part.
    """
    rows = prints.mapInPandas(_bit_table, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((BITS, BITS))
    for r in rows:
        both[r["i"], r["j"]] = r["n"]
    n = prints.count()
    layouts = {m: group_bits(both, n, m) for m in part_counts}
    flat = [(m, k, bits) for m, parts in layouts.items() for k, bits in enumerate(parts)]
    keys = prints.select(F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(signed(masks(bits, 0)[0])).alias("value")) for i, (_, _, bits) in enumerate(flat)])).alias("k")).select("k.*")
    pairs = {r["part"]: r["pairs"] for r in keys.groupBy("part", "value").count().groupBy("part").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    best = (float("inf"), [], 0)
    for m in part_counts:
        costs = []
        for i, (mm, _, bits) in enumerate(flat):
            if mm != m:
                continue
            odds = float((differ[bits] / np.maximum(1 - differ[bits], 1e-9)).sum())
            equal, options = float(pairs.get(i) or 0), {-1: 0.0}
            for t in range(distance + 1):
                options[t] = 20.0 * n * comb(len(bits), t) + equal * sum(odds**s for s in range(t + 1))
            costs.append(options)
        cost, chosen = allocate(costs, distance - m + 1)
        if cost < best[0]:
            best = (cost, chosen, m)
    return [x for bits, t in zip(layouts[best[2]], best[1], strict=True) if t >= 0 for x in masks(bits, t)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _stars(fp: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each group's connected parts, every member to the first of its part. Groups stand together in order."""
    a, b, at, lag = [], [], np.arange(len(fp)), 1
    while True:
        at = at[at + lag < len(fp)]
        at = at[group[at] == group[at + lag]]
        if not len(at):
            break
        near = np.bitwise_count((fp[at] ^ fp[at + lag]).view(np.uint64)) <= distance  # of a signed number it would count the absolute value's bits
        a.append(at[near])
        b.append(at[near] + lag)
        lag += 1
    i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
    root = np.arange(len(fp))
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    who = np.flatnonzero(root != np.arange(len(fp)))
    return fp[who], fp[root[who]]


def _compare(distance: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            key = pdf[["mask", "value", "i", "j"]].to_numpy(np.int64)
            group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(axis=1))]) if len(key) else np.empty(0, np.int64)
            done = group < group[-1] if len(key) else np.empty(0, bool)
            rest = pdf[~done]  # the last group may go on in the next batch
            if done.any():
                a, b = _stars(pdf["fp"].to_numpy(np.int64)[done], group[done], distance)
                yield pd.DataFrame({"a": a, "b": b})
        if rest is not None and len(rest):
            a, b = _stars(rest["fp"].to_numpy(np.int64), np.zeros(len(rest), np.int64), distance)
            yield pd.DataFrame({"a": a, "b": b})

    return run


def link_fingerprints(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect just those distinct fingerprints (column fp) that chains of near pairs connect."""
    keep = plan_search(prints, distance)
    keys = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(signed(m)).alias("value")) for i, m in enumerate(keep)])).alias("k")).select("fp", "k.*")
    sizes = keys.groupBy("mask", "value").count().filter("count > 1").withColumnRenamed("count", "size").withColumnsRenamed({"mask": "_m", "value": "_v"})
    met = keys.join(sizes, (F.col("mask") == F.col("_m")) & (F.col("value") == F.col("_v"))).drop("_m", "_v")
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    dealt = met.select("fp", "mask", "value", own.alias("_own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_other"))
    dealt = dealt.select("fp", "mask", "value", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"))
    dealt = dealt.repartition("mask", "value", "i", "j").sortWithinPartitions("mask", "value", "i", "j")
    return dealt.mapInPandas(_compare(distance), "a long, b long")


def classes(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(_fp, component_id, _first) for every distinct fingerprint of rows (_rid, _doc, _fp).

    component_id is the smallest _doc of the fingerprints it reaches; _first is the _rid of the first row that has it.
    """
    groups = cut(rows.groupBy(F.col("_fp").alias("fp")).agg(F.min("_doc").alias("rep"), F.min(F.struct(F.coalesce("_doc", F.lit(2**63 - 1)), "_rid")).alias("first")), "prints")
    roots = components(link_fingerprints(groups.select("fp"), distance))
    rooted = cut(groups.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.min("first").alias("_f")).withColumnRenamed("root", "_root")
    return rooted.join(least, F.col("root") == F.col("_root")).select(F.col("fp").alias("_of"), "component_id", F.col("_f._rid").alias("_first"))


def _printed(docs: DataFrame, doc_id: str, text: str, carry: bool) -> DataFrame:
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []
    return cut(docs.select(F.monotonically_increasing_id().alias("_rid"), F.col(doc_id).cast("long").alias("_doc"), fingerprints(text_of(text)).alias("_fp"), *row), "simhash")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs.

    Nulls and texts without words have fingerprint 0, linked like any other; a null doc_id is never a component_id unless
    its whole component has none. Repeated rows each give a row. Empty tables give no rows. Other columns are not read.
    """
    rows = _printed(docs, doc_id, text, False)
    out = rows.join(classes(rows, distance), F.col("_fp") == F.col("_of"))
    return out.select(F.col("_doc").alias("doc_id"), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row of each component of near_duplicates, that of the smallest doc_id, with all its columns.

    A null doc_id comes last; among rows of one doc_id the row number decides. Nulls and texts without words are as there.
    """
    rows = _printed(docs, doc_id, text, True)
    out = rows.join(classes(rows.select("_rid", "_doc", "_fp"), distance), F.col("_fp") == F.col("_of"))
    return out.filter("_rid = _first").select("_row.*")
