"""Hashes and distances against plain Python, and against known values if the published mapping table is given."""

import os
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmesh.functions.distance import digest_distance, hash_parts, parts_distance
from lexmesh.functions.tlsh import Selection, checked, default_permutation, hash_bytes, length_code, quartiles, read_permutation, tlsh_hash
from tests.test_text import plain_augment

KNOWN = {
    "hello": "76B09B250DCD4E3764DC44C771140D1D97C5D05C86126D981518511A776F3579695D55",
    "hallo": "14B09B655CD95463A6EC24CE732D59829744D07C9353AD7CA508410D37DD7578955451",
    "wolverine": "E1C0482249D80E2E0AAA08376E208BC0C3C4904E8108A224217EF1B5BB2E7A3A6C2D87",
    "wulvrine": "02C09B3114991EBA0BB44F376F414AD1C3C391BDC9052010343C7170730C7535D81D45",
    "a": "D5B09BB5D84706574ED9445575191565675450B8DB53F1542518801573910364946451",
    "1234": "DDB02B82C847C8D308C40001BC0C0874ABA09079D733E01C1408C305B3410354303782",
}


def distance(a, b):
    cells = lambda h: [int(x, 16) >> s & 3 for x in h[6:] for s in (0, 2)]
    gap = lambda x, y: 6 if abs(x - y) == 3 else abs(x - y)
    return (a[:2] != b[:2]) + sum(map(gap, cells(a), cells(b)))


def test_known_values():
    path = os.environ.get("LEXMESH_PERMUTATION")
    if not path:
        pytest.skip("LEXMESH_PERMUTATION names no file with the published mapping table")
    table = read_permutation(path)
    got = {w: hash_bytes([plain_augment(w).encode()], table)[0] for w in KNOWN}
    assert {w: h for w, (_, h) in got.items()} == KNOWN
    assert distance(got["wolverine"][1], got["wulvrine"][1]) == 93


def test_known_distances(spark):
    pairs = [("wolverine", "wulvrine", 93), ("hello", "hallo", 82)]
    rows = spark.createDataFrame([(KNOWN[a], KNOWN[b], d) for a, b, d in pairs], "a string, b string, d int")
    assert all(r[0] == r[1] for r in rows.select(digest_distance(F.col("a"), F.col("b")), "d").collect())


def naive_counts(data, table):
    counts, check = [0] * 256, 0
    step = lambda s, x, y, z: table[table[table[table[s] ^ x] ^ y] ^ z]
    for i in range(4, len(data)):
        w = data[i - 4 : i + 1][::-1]
        check = step(0, w[0], w[1], check)
        for s, j, k in ((2, 1, 2), (3, 1, 3), (5, 2, 3), (7, 2, 4), (11, 1, 4), (13, 3, 4)):
            counts[step(s, w[0], w[j], w[k])] += 1
    return counts, check


def test_batches_equal_single_texts():
    random.seed(5)
    table = default_permutation()
    texts = [bytes(random.randrange(256) for _ in range(random.choice([0, 3, 5, 50, 140, 700, 3300]))) for _ in range(40)]
    for text, (valid, got) in zip(texts, hash_bytes(texts), strict=True):
        counts, check = naive_counts(text, table)
        q = plain_quartiles(counts[:128])
        cells = "".join(f"{sum((sum(counts[4 * i + j] > x for x in sorted(q))) << 2 * j for j in range(4)):02X}" for i in range(31, -1, -1)) if list(q) == sorted(q) else got[6:]
        swap = lambda b: f"{b & 15:X}{b >> 4:X}"
        head = swap(check) + swap(length_code(max(1, len(text)))) + f"{q[0] * 100 // max(1, q[2]) % 16:X}{q[1] * 100 // max(1, q[2]) % 16:X}"
        assert got == head + cells
        assert valid == (sum(c > 0 for c in counts[:128]) > 64)


def plain_split(x, lo, hi):
    """A range as a new list: smaller values, the pivot, the others as a queue that has turned once for each smaller value after its first."""
    if hi - lo < 2:
        x[lo : hi + 1] = sorted(x[lo : hi + 1])
        return lo
    pivot, small, queue = x[(lo + hi) // 2], [], deque()
    for v in x[lo:hi]:
        if v < pivot:
            small.append(v)
            queue.rotate(-1)
        else:
            queue.append(v)
    queue.rotate(-1)
    x[lo : hi + 1] = [*small, pivot, *queue]
    return lo + len(small)


def plain_quartiles(counts):
    x = list(counts)

    def settle(place, lo, hi):
        low, high = [], 0
        while (at := plain_split(x, lo, hi)) != place:
            if at < place:
                low.append(at)
                lo = at + 1
            else:
                high += 1
                hi = at - 1
        return lo, low, high

    _, low, high = settle(63, 0, 127)
    q2, ends = x[63], [*low, 62, *[0] * 130]
    ends[high] = 64
    lo, q1 = 0, 0
    for end in ends[: len(low) + 1]:
        if end > 31:
            lo = settle(31, lo, end)[0]
        if end >= 31:
            q1 = x[31]
        if end == 31:
            break
        if end < 31:
            lo = end
    settle(95, ends[0], 127)
    return [q1, q2, x[95]]


def test_lossy_selection():
    pick = Selection(np.array([[3, 1, 2, 5, 4], [1, 2, 0, 9, 9]]))
    assert pick.split(np.arange(2), np.array([0, 1]), np.array([4, 2])).tolist() == [1, 1]
    assert pick.x.tolist() == [[1, 2, 2, 5, 3], [1, 0, 2, 9, 9]]  # the last 4 is gone, the 2 is there twice
    rng = np.random.default_rng(2)
    rows = np.concatenate([rng.poisson(rng.choice([0.5, 2, 6, 40], (600, 1)), (600, 128)), np.arange(128)[None, :], np.arange(128)[None, ::-1], np.zeros((1, 128), int)])
    assert quartiles(rows).tolist() == [plain_quartiles(r) for r in rows.tolist()]
    assert quartiles(np.arange(128)[None, :], exact=True).tolist() == [[31, 63, 95]]


def test_table_is_checked():
    assert sorted(default_permutation()) == list(range(256))
    with pytest.raises(ValueError):
        checked([1] * 256)


def test_distance_and_planes(spark):
    random.seed(1)
    some = ["".join(random.choice("0123456789ABCDEF") for _ in range(70)) for _ in range(60)]
    pairs = [(random.choice(some), random.choice(some)) for _ in range(300)] + [(h, h) for h in some]
    rows = spark.createDataFrame(pairs, "a string, b string")
    for c in ("a", "b"):
        rows = rows.select("*", *[x.alias(f"{c}_{n}") for x, n in zip(hash_parts(F.col(c)), ("check", "c0", "c1", "c2", "c3"), strict=True)])
    for r in rows.select("a", "b", digest_distance(F.col("a"), F.col("b")).alias("d"), digest_distance(F.col("b"), F.col("a")).alias("e"), parts_distance("a_", "b_").alias("f")).collect():
        assert r.d == r.e == r.f == distance(r.a, r.b)


def test_hash_column(spark):
    rows = spark.createDataFrame([("abc" * 30,), (None,), ("",)], "t string")
    got = [r.h for r in rows.select(tlsh_hash(F.col("t")).alias("h")).collect()]
    assert got[0].hash == hash_bytes([b"abc" * 30])[0][1]
    assert got[1] is None or got[1].hash is None
    assert not got[2].valid
