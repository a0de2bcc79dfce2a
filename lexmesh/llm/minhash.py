"""MinHash with independent hashes, and the components of texts whose exact similarity suffices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.common import broadcast_if_small, cut, semi_join


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: An odd multiplier for each value of a signature.
SEEDS = (mix(np.arange(1, 513, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

#: Characters of different texts after which a task of the comparison turns to the groups read so far.
HELD = 300_000
#: Sets of a group that are compared by one product of matrices at most, and cells of its matrix (16 MB).
DENSE_SETS, DENSE_CELLS = 512, 1 << 22
#: 8-byte keys that a broadcast may hold (about 20 MB as a hash table); more are joined by shuffle. Several are held at a
#: time, and the driver makes each: a million keys took 150 MB of it.
MAX_KEYS = 200_000


def band_keys(hashes: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The bands' keys of each set; hashes (64 bits) stand set by set, each set's from first on, none of them empty.

    A value of the signature is the least of the set's hashes under a permutation of its own.
    """
    x = (mix(hashes) >> np.uint64(32)).astype(np.uint32)
    some, least = np.empty_like(x), np.empty((bands * rows, len(first)), np.uint32)
    for seed, own in zip(SEEDS[: bands * rows], least, strict=True):
        np.multiply(x, seed, out=some)
        np.minimum.reduceat(some, first, out=own)
    out = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[:, None], len(first), axis=1)
    with np.errstate(over="ignore"):
        for k in range(rows):  # of all bands at once
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + least[k::rows])
    return out.T.view(np.int64)


def windows(lines: list[str], width: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each window of width characters, where each line's begin); a shorter line is its own window.

    With exact=True different windows of these lines have different numbers: the characters stand side by side in one
    number, if need be by their rank among the lines' characters. Else the number is a hash, the same in every call.
    """
    sizes, pad = np.array([len(x) for x in lines], np.int64), width  # an empty line has a window too
    codes = np.frombuffer(("\0" * pad).join([*lines, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes + pad) - sizes - pad
    bits = 64 // width
    if exact:
        codes = codes + np.uint64(1)
        short = np.concatenate([np.arange(s + n, s + width) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True) if n < width] or [np.empty(0, np.int64)])
        codes[short] = 0  # no character, unlike a NUL in the text
        if codes.max(initial=0) >> np.uint64(bits):
            kinds, codes = np.unique(codes, return_inverse=True)
            codes = codes.astype(np.uint64) + np.uint64(kinds[0] > 0)
            bits = max(bits, len(kinds).bit_length())
    with np.errstate(over="ignore"):
        step = np.uint64(1 << bits if exact else 0x100000001B3)
        size = len(codes) - width + 1
        out = codes[:size].copy()
        for k in range(1, width):
            if exact and bits * width > 64:  # very many different characters: pairs are ranked anew at each step
                out = np.unique(np.stack([out, codes[k : size + k]]), axis=1, return_inverse=True)[1].astype(np.uint64).ravel()
            else:
                out = out * step + codes[k : size + k]
    counts = np.maximum(1, sizes - width + 1)
    first = np.cumsum(counts) - counts
    return out[np.arange(counts.sum()) - np.repeat(first - starts, counts)], first


class Characters:
    """The sets of a line: its windows of width characters."""

    #: Characters of text that a block of a bucket's members has on average; a task compares two blocks at a time.
    block_chars = 1 << 20

    def __init__(self, width: int):
        self.width = width

    def numbers(self, lines: list[str], exact: bool) -> tuple[np.ndarray, np.ndarray]:
        return windows(lines, self.width, exact)


def signatures(kind, bands: int, rows: int):
    """An Arrow function from (_key, _line) to (_key, _bands, _chars); a line that a task has seen lately gives no second row."""
    schema = pa.schema([("_key", pa.binary()), ("_bands", pa.list_(pa.int64())), ("_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            fresh = {}
            for key, line in zip(batch["_key"].to_pylist(), batch["_line"].to_pylist(), strict=True):
                if key not in seen:
                    fresh[key] = line
            seen = (set() if len(seen) > 200_000 else seen).union(fresh)
            keys, lines, at = list(fresh), list(fresh.values()), 0
            while at < len(lines):  # a part of at most about 100,000 characters, or one longer line
                end, size = at, 0
                while end < len(lines) and (end == at or size + len(lines[end]) < 100_000) and end - at < 8192:
                    size += len(lines[end])
                    end += 1
                found = band_keys(*kind.numbers(lines[at:end], False), bands, rows)
                ends = pa.array(np.arange(0, (end - at + 1) * bands, bands, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(keys[at:end], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(found.ravel())), pa.array([len(x) for x in lines[at:end]], pa.int64())], schema=schema)
                at = end

    return run


def distinct(x: np.ndarray) -> np.ndarray:
    """The different numbers of x in order; sorting takes less than the hash table of np.unique."""
    x = np.sort(x)
    fresh = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=fresh[1:])
    return x[fresh]


def shared_by(one: np.ndarray, two: np.ndarray) -> int:
    """How many numbers two sets have in common."""
    x = np.concatenate([one, two])
    x.sort()
    return np.count_nonzero(x[1:] == x[:-1])


def connected(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set (distinct numbers) the first set of its component under a Jaccard similarity of percent or more.

    Few sets are all compared by one product of matrices. Of more, a set is compared with all others at once, through the
    lists of sets that hold each number; sets of the largest component need no turn of their own: whatever they could
    still be linked to has one.
    """
    n = len(sets)
    root, sizes = np.arange(n), np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    order = np.argsort(flat)
    ranked, ids = flat[order], np.empty(len(flat), np.int64)
    ids[order] = np.cumsum(np.append(False, ranked[1:] != ranked[:-1]))
    each, listed = np.bincount(ids), np.repeat(np.arange(n), sizes)
    several = each > 1
    if n <= DENSE_SETS and n * np.count_nonzero(several) <= DENSE_CELLS:
        there, common = np.zeros((n, np.count_nonzero(several)), np.float32), several[ids]
        there[listed[common], (np.cumsum(several) - 1)[ids[common]]] = 1
        both = (there @ there.T).astype(np.int64)
        both[root, root] = sizes  # with what no other set holds
        near = 100 * both >= percent * (sizes[:, None] + sizes - both)
        while True:
            least = np.where(near, root, n).min(axis=1)
            least = least[least]
            if np.array_equal(least, root):
                return root
            root = least
    listed = listed[order]
    begin = np.cumsum(each) - each
    first = np.cumsum(sizes) - sizes
    waiting = np.ones(n, bool)
    while True:
        largest = np.bincount(root).argmax()
        turn = np.flatnonzero(waiting & (root != largest)) if not waiting.all() else np.arange(1)
        if not len(turn):
            return root
        u = turn[0]
        waiting[u] = False
        own = ids[first[u] : first[u] + sizes[u]]
        k = each[own]
        both = np.bincount(listed[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin[own], k)], minlength=n)
        met = np.unique(root[100 * both >= percent * (sizes[u] + sizes - both)])
        if len(met) > 1:
            root[np.isin(root, met)] = met[0]


def _linked(kind, percent: int):
    """An Arrow function from the members (_band, i, j, _key, _line) of groups that stand together to the links (a, b).

    Small groups are read together, so that the sets of all their texts are made by one call, each text's once.
    """

    def links(groups: list[list[bytes]], texts: dict[bytes, str]) -> pa.RecordBatch:
        numbers, first = kind.numbers(list(texts.values()), True)
        sets = {k: distinct(part) for k, part in zip(texts, np.split(numbers, first[1:]), strict=True)}
        a, b = [], []
        for keys in groups:
            own = [sets[k] for k in keys]
            if len(own) == 2:
                both = shared_by(*own) if 100 * min(map(len, own)) >= percent * max(map(len, own)) else 0
                root = [0, 0 if 100 * both >= percent * (len(own[0]) + len(own[1]) - both) else 1]
            else:
                root = connected(own, percent).tolist()
            a += [keys[k] for k, r in enumerate(root) if r != k]
            b += [keys[r] for k, r in enumerate(root) if r != k]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, texts, size, now = [], {}, 0, None
        for batch in batches:
            for group, key, line in zip(zip(*(batch[c].to_pylist() for c in ("_band", "i", "j")), strict=True), batch["_key"].to_pylist(), batch["_line"].to_pylist(), strict=True):
                if group != now:
                    if size > HELD:
                        yield links([g for g in groups if len(g) > 1], texts)
                        groups, texts, size = [], {}, 0
                    groups.append([])
                    now = group
                groups[-1].append(key)
                if key not in texts:
                    texts[key] = line
                    size += len(line)
        if texts:
            yield links([g for g in groups if len(g) > 1], texts)

    return run


def similar_links(lines: DataFrame, kind, bands: int, rows: int, percent: int) -> DataFrame:
    """Links (a, b) that connect just those keys of lines (_key: 16 bytes, equal for equal lines alone; _line) that chains of similar pairs connect.

    kind makes the sets that are compared (see Characters).

    1. Buckets of one key alone are dropped by their least and largest key (partial sums first, so that a crowded bucket
    costs no task more). 2. Buckets of the same members count once. 3. The members of a bucket are dealt to blocks by
    their length; each pair of blocks is a group of its own, in which every pair is compared by its exact shingles, and
    only a link to the first of each local component goes out. No link is lost, none is listed twice for a pair of texts.
    """
    signed = cut(lines.mapInArrow(signatures(kind, bands, rows), "_key binary, _bands array<long>, _chars long"), "signed")
    banded = signed.select("_key", "_chars", F.explode("_bands").alias("_band"))
    low = F.xxhash64("_key").alias("_k")
    shared = cut(banded.select("_band", low).groupBy("_band").agg(F.min("_k").alias("_low"), F.max("_k").alias("_high")).filter("_low != _high").select(F.col("_band").alias("_s")), "shared")
    members = cut(semi_join(banded, "_band", shared, MAX_KEYS).distinct(), "members")
    one, two = F.xxhash64("_key"), F.xxhash64(F.lit(1), "_key")
    buckets = members.groupBy("_band").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(one).alias("x"), F.bit_xor(two).alias("y"), F.sum("_chars").alias("chars"))
    buckets = cut(buckets.filter("n > 1").groupBy("n", "x", "y").agg(F.min("_band").alias("_b"), F.first("chars").alias("chars")).select("_b", F.ceil(F.col("chars") / kind.block_chars).cast("int").alias("_blocks")), "buckets")
    met = members.join(broadcast_if_small(buckets, MAX_KEYS), F.col("_band") == F.col("_b")).select("_band", "_key", F.greatest("_blocks", F.lit(1)).alias("_blocks"))
    wanted = cut(members.select(F.col("_key").alias("_w")).distinct(), "wanted")
    texts = semi_join(lines, "_key", wanted, MAX_KEYS // 3).select(F.col("_key").alias("_t"), "_line")
    texts = texts.dropDuplicates(["_t"])  # stays dealt by its key for the join below
    own = F.pmod(F.xxhash64("_key"), F.col("_blocks")).cast("int")
    dealt = met.select("_band", "_key", own.alias("_own"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    dealt = dealt.select("_band", "_key", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"))
    full = dealt.join(texts, F.col("_key") == F.col("_t")).select("_band", "i", "j", "_key", "_line")
    full = full.repartition("_band", "i", "j").sortWithinPartitions("_band", "i", "j")
    return full.mapInArrow(_linked(kind, percent), "a binary, b binary")
