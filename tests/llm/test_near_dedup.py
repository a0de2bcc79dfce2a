"""The pipeline's near-duplicate stage against exact similarities of all pairs."""

import random

import numpy as np
import pytest
from tests.llm.helpers import corpus, documents, words

import corpus_pipeline
from lexmesh.llm import linededup, minhash
from lexmesh.llm.neardedup import keep_first
from lexmesh.llm.simhash import fingerprint


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def plain_kept(rows):
    """The least doc_id of each component: 5-word Jaccard of 0.8, or 5-word fingerprints within 2 bits."""
    sets, root = [shingles(t) for _, t, _ in rows], list(range(len(rows)))
    prints = [fingerprint(t or "", 5) for _, t, _ in rows]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) or (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def test_stage_removes_all_near_duplicates(spark):
    rng = random.Random(12)
    rows = [r for r in corpus() if r[0] is not None and r[0] != 3]
    for d in range(100, 160, 2):  # one to three changed words, on both sides of 0.8
        w = words(rng, rng.randint(40, 200))
        rows.append((d, " ".join(w), "s"))
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((d + 1, " ".join(w).upper(), "s"))
    frame = documents(spark, rows)
    got = corpus_pipeline.near_dedup_stage(spark, frame, "")
    assert got.columns == frame.columns
    ids = sorted(r.doc_id for r in got.collect())
    assert ids == plain_kept(rows) and 31 not in ids and sum(d >= 100 and d % 2 for d in ids) > 3
    assert corpus_pipeline.near_dedup_stage(spark, documents(spark, []), "").count() == 0


@pytest.mark.parametrize("union", [5, 10, 20, 40])
def test_bands_meet_as_often_as_stated(union):
    """Pairs of similarity 0.8, of few shingles and of many: 16 bands of 5 meet with probability 0.998."""
    rng, met, n = np.random.default_rng(union), 0, 2000
    for _ in range(n):
        x = rng.integers(0, 1 << 63, union, dtype=np.uint64)
        cut = union // 10 if union > 5 else 0
        a, b = x[: union - cut], x[(union - 4 * union // 5) - cut :]
        keys = minhash.band_keys(np.concatenate([a, b]), np.array([0, len(a)]), 16, 5)
        met += bool((keys[0] == keys[1]).any())
    assert met > 0.99 * n


@pytest.mark.parametrize("length", [9, 12, 16, 20, 25, 30])
def test_similar_lines_meet(length):
    """Pairs at 0.8 to 0.9, by one to three characters put before or behind a text, of every length class."""
    rng, met, n = random.Random(length), 0, 0
    for _ in range(2000):
        x = "".join(rng.choice("abcdefghijklmnop") for _ in range(length))
        more = "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 3)))
        a, b = x, rng.choice([x + more, more + x])
        one, two = ({y[i : i + 5] for i in range(len(y) - 4)} for y in (a, b))
        if 0.8 <= len(one & two) / len(one | two) <= 0.9:
            keys = minhash.band_keys(*minhash.windows([a, b], 5, False), linededup.BANDS, linededup.ROWS)
            met += bool((keys[0] == keys[1]).any())
            n += 1
    assert n > 50 and met > 0.97 * n


def test_exact_windows():
    """Numbers are equal just for equal windows, with few kinds of characters and with many, short lines and NULs."""
    rng = random.Random(4)
    for letters in ("ab\0", [chr(c) for c in range(0x4E00, 0x9000)], [chr(c) for c in range(1, 0x3000)], "é한\U0001f600a"):
        lines = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 4, 5, 6, 40]))) for _ in range(300)]
        numbers, first = minhash.windows(lines, 5, True)
        known = {}
        for line, part in zip(lines, np.split(numbers, first[1:]), strict=True):
            own = [line[i : i + 5] for i in range(max(1, len(line) - 4))]
            assert len(own) == len(part) and all(known.setdefault(w, x) == x for w, x in zip(own, part.tolist(), strict=True))
        assert len(set(known.values())) == len(known)


def test_connected_sets():
    rng = random.Random(3)
    for _ in range(60):
        base = [rng.sample(range(200), 20) for _ in range(3)]
        sets = [np.array(sorted({rng.randrange(200) if rng.random() < 0.06 else x for x in rng.choice(base)})) for _ in range(rng.randint(3, 25))]
        root = list(range(len(sets)))
        for _ in root:
            for i in root:
                for j in range(len(sets)):
                    both = len(np.intersect1d(sets[i], sets[j]))
                    if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                        root[i] = root[j] = min(root[i], root[j])
        got = minhash.connected(sets, 80)
        assert len(set(zip(got.tolist(), root, strict=True))) == len(set(got.tolist())) == len(set(root))


def test_few_sets_are_compared_at_once(monkeypatch):
    """Chains, copies, subsets and empty sets get the same components by a product of matrices as by turns, in far fewer steps."""
    rng = random.Random(8)
    monkeypatch.setattr(np, "isin", None)  # a step of the turns
    groups = [[np.arange(k, k + 30) for k in range(0, 60, 2)], [np.arange(k) for k in (10, 8, 7, 0, 0, 9)], [np.arange(5) + 9 * (k % 3) for k in range(9)]]
    groups += [[np.array(sorted(rng.sample(range(26), 22))) for _ in range(12)] for _ in range(20)]
    found = [minhash.connected(sets, 80).tolist() for sets in groups]
    assert found[0] == [0] * 30 and found[1] == [0, 0, 0, 3, 3, 0] and found[2] == [0, 1, 2] * 3
    monkeypatch.undo()
    monkeypatch.setattr(minhash, "DENSE_SETS", 0)
    for sets, roots in zip(groups, found, strict=True):
        by_turns = minhash.connected(sets, 80).tolist()
        assert len(set(zip(by_turns, roots, strict=True))) == len(set(by_turns)) == len(set(roots))
        assert all(r <= k and roots[r] == r for k, r in enumerate(roots))


def test_rows_of_one_id_stay_by_the_least_text(spark):
    """Repeated and null ids within a component: one row stays, that of the least text, also across texts of other cases."""
    body = " ".join(f"word{k}" for k in range(40))
    rows = [(3, body.upper()), (3, body), (3, body.upper() + " "), (5, body), (None, "alone one two three four"), (None, "ALONE one two three four"), (7, None), (7, "")]
    got = keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, "ALONE one two three four"), (3, body.upper()), (7, "")]
