"""Quality rules, mixing, decontamination and line deduplication against brute force."""

import hashlib
import random
import re

import duckdb
import pytest
from tests.llm.helpers import corpus, documents

from lexmesh.llm import decontam, linededup, mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = ("_w", "words", "size", "kept", "_rid", "target")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, corpus(), EXTRA).cache()


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def base_rules(text):
    w, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    cover = {q for i, x in enumerate(windows) if windows.count(x) > 1 for q in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)


def test_quality(spark, docs):
    rows = corpus() + [(50, "# a * b\n\n# a * b\n" + "x y z u v " * 3, "s1")]
    got = quality.quality_rules(documents(spark, rows, EXTRA)).collect()
    want = [(d, *base_rules(t)) for d, t, _ in rows if t is None or len(t) < 9000]
    assert set(want) <= {tuple(r)[:7] for r in got} and len(got) == len(rows)
    by = {}
    for _, t, s in rows:
        n = by.setdefault(s, [0, 0])
        n[0] += 1
        n[1] += base_rules(t)[5]
    rates = [f / n for n, f in by.values()]
    m = sum(rates) / len(rates)
    v = sum((r - m) ** 2 for r in rates) / len(rates)
    k = max(0, m * (1 - m) / v - 1)
    bad = {s for s, (n, f) in by.items() if (f + m * k) / (n + k) > 0.5}
    source = {(d, t): s for d, t, s in rows}
    assert all(r.host_rejected == any(source.get((r.doc_id, t)) in bad for d, t, _ in rows if d == r.doc_id) for r in got if r.doc_id != 3)
    assert all(r.kept == (not r.base_failed and not r.host_rejected) for r in got)
    kept = quality.keep_good(documents(spark, rows, EXTRA))
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_hosts_that_fail_take_their_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(20))
    rows = [(i, good + f" {i}", "good") for i in range(30)] + [(100 + i, "short", "bad") for i in range(30)] + [(200, good, "bad")]
    got = {r.doc_id: r for r in quality.quality_rules(documents(spark, rows)).collect()}
    assert not got[200].base_failed and got[200].host_rejected and not got[200].kept
    assert all(got[i].kept for i in range(30))


def test_equal_rates_and_no_rows(spark):
    rows = [(1, "short", "a"), (2, "short", "b")]
    assert [r.kept for r in quality.quality_rules(documents(spark, rows)).collect()] == [False, False]
    assert quality.quality_rules(documents(spark, [])).count() == 0 == quality.keep_good(documents(spark, [])).count()


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        share = {s: budget * weight[s] / total for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            budget -= out[s]
        free -= over
    return out


def test_mixing(spark, docs):
    got = mixing.mix_report(docs).collect()
    sizes = {}
    for _, t, s in corpus():
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    targets, taken = plain_targets(sizes), {}
    assert len(got) == len(corpus())
    assert sorted(r.size for r in got) == sorted(len(WORD.findall(t or "")) for _, t, _ in corpus())
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        s = [s for s in sizes if abs(targets[s] - r.target) < 1e-6 and sizes[s] == r.source_size]
        assert s
        taken[s[0]] = taken.get(s[0], 0) + r.taken
    assert all(abs(taken[s] - targets[s]) <= 0.5 + len(targets) / 2 for s in targets) and sum(taken.values()) == int(1.5 * sum(sizes.values()) + 0.5)
    plan = mixing.mix_report(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"sum\(words.*finish#\d+ ASC", plan), plan  # the words taken follow from the order of finish times
    assert key(mixing.mix_report(docs.repartition(7)).collect()) == key(got)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert max(r["count"] for r in mixed.groupBy("doc_id", "text").count().collect()) <= 4  # two rows of one id, twice each


def test_mixing_against_a_queue(spark, docs):
    """One queue after the other, word by word: each next packet is the one of the least virtual finish time."""
    got = mixing.mix_report(docs).collect()
    by, want = {}, {}
    for i, (d, t, s) in enumerate(corpus()):
        by.setdefault(s, []).append((hashlib.md5(("" if d is None else str(d)).encode()).hexdigest(), d is not None, d or 0, len(WORD.findall(t or "")), i))
    sizes = {s: sum(r[3] for r in rows) for s, rows in by.items()}
    targets, line = plain_targets(sizes), []
    for s, rows in by.items():
        at, goal = 0, int(targets[s] + 0.5)
        for _, _, _, n, i in sorted(rows) * 2:
            for lo, hi in ((at, goal), (goal, at + n)) if at < goal < at + n else ((at, at + n),):
                if hi > lo:
                    line.append((hi / targets[s], s is None, s or "", lo, hi - lo, i))
            at += n
    left = int(1.5 * sum(sizes.values()) + 0.5)
    for _, _, _, _, n, i in sorted(line):
        want[i] = want.get(i, 0) + min(n, left)
        left -= min(n, left)
    assert key((r.doc_id, r.size, r.taken) for r in got) == key((d, len(WORD.findall(t or "")), want.get(i, 0)) for i, (d, t, _) in enumerate(corpus()))


def test_mixing_edges(spark):
    assert mixing.mix_report(documents(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix_report(documents(spark, [(1, None, None), (2, "", "a")])).collect()] == [0, 0]
    one = mixing.mix_report(documents(spark, [(i, "a b c d", "a") for i in range(8)])).collect()
    assert sum(r.taken for r in one) == 48 and one[0].target == 48


def containment(doc, item):
    d, i = WORD.findall((doc or "").lower()), WORD.findall((item or "").lower())
    sh = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return len(sh(d) & sh(i)), len(sh(i))


def test_decontamination(spark, docs):
    rng, rows = random.Random(4), corpus()
    texts = [t for _, t, _ in rows if t and len(t.split()) > 40]
    items = []
    for i in range(60):
        w = rng.choice(texts).split()
        n = rng.randint(5, 40)
        at = rng.randrange(len(w) - n) if len(w) > n else 0
        part = w[at : at + n]
        for _ in range(rng.choice([0, 0, 1, 2])):
            part[rng.randrange(len(part))] = "changed"
        items.append((i, " ".join(part).upper()))
    items += [(90, None), (91, ""), (92, "one two"), (93, "ONE"), (None, "w1 w2"), (None, " ".join(texts[3].split()[2:20]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumnRenamed("text", "text")
    want = key((d, i, n, s) for d, t, _ in rows for i, x in items for s, n in [containment(t, x)] if n and 100 * s >= 80 * n and d is not None)
    got = decontam.find_leaks(docs, bench)
    assert got.columns == ["doc_id", "item_id", "n_item", "n_shared"]
    assert key(r for r in got.collect() if r.doc_id is not None) == want and len(want) > 20 and any(i is None for _, i, _, _ in want)
    clean = decontam.drop_leaks(docs, bench)
    assert clean.columns == docs.columns
    dirty = {w[0] for w in want}
    assert {r.doc_id for r in clean.collect()} - {None} == {d for d, _, _ in rows if d is not None} - dirty
    assert decontam.find_leaks(documents(spark, []), bench).count() == 0
    assert decontam.drop_leaks(docs, bench.limit(0)).count() == len(rows)


def test_decontamination_without_broadcast(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(1, " ".join(corpus()[0][1].split()[3:30]))], "item_id bigint, text string")
    want = key(decontam.find_leaks(docs, bench).collect())
    monkeypatch.setattr(decontam, "MAX_BROADCAST_BYTES", 0)
    assert key(decontam.find_leaks(docs, bench).collect()) == want and len(want) == 6


def test_lines(spark):
    rng = random.Random(9)
    base = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(999)}" for _ in range(rng.randint(2, 30))) for _ in range(25)]
    rows = []
    for d in range(30):
        lines = []
        for _ in range(rng.randint(1, 6)):
            x = rng.choice(base)
            if rng.random() < 0.5:
                k = rng.randrange(len(x))
                x = x[:k] + rng.choice("xyz") + x[k + 1 :]
            lines.append(x)
        rows.append((d, "\n".join([*lines, "", "ab", "  "]), "s"))
    rows += [(40, None, "s"), (41, "", "s"), (None, "ab\nnew line of text here", "s"), (42, "abc", "s"), (42, "abc", "s")]
    flat = sorted(((d if d is not None else 1 << 60, n, x) for d, t, _ in rows for n, x in enumerate((t or "").split("\n")) if WORD.search(x)), key=lambda r: r[:2])
    sets = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for _, _, x in flat]
    root = list(range(len(flat)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(flat)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    gone = {}
    for i, (d, _, _) in enumerate(flat):
        gone.setdefault(d, [0, 0])
        gone[d][0] += 1
        gone[d][1] += find(i) != i
    docs = documents(spark, rows, ("_line", "kept", "component"))
    got = {}
    for r in linededup.dedup_report(docs).collect():
        g = got.setdefault(1 << 60 if r.doc_id is None else r.doc_id, [0, 0])
        g[0] += r.n_lines
        g[1] += r.n_removed
    assert got == {d: gone.get(d, [0, 0]) for d in got} and len(got) == 34
    out = linededup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    kept = sum(bool(WORD.search(x)) for r in out.collect() for x in (r.text or "").split("\n"))
    assert kept == sum(find(i) == i for i in range(len(flat)))
    assert linededup.dedup_report(documents(spark, [])).count() == 0


@pytest.mark.parametrize("name,module", [("op1_quality_rules", quality), ("op8_benchmark_decontamination", decontam), ("op10_source_mixing", mixing)])
def test_sql(spark, tmp_path, name, module):
    """The SQL on the odd corpus, repeated ids aside."""
    from lexmesh.llm.queries import QUERIES

    rows = [r for i, r in enumerate(corpus()) if r[0] not in [x[0] for x in corpus()[:i]] and r[0] is not None]
    documents(spark, rows).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, " ".join(corpus()[0][1].split()[3:30])), (2, "one two"), (3, None), (4, " ".join(corpus()[11][1].split()[-12:]))]
    spark.createDataFrame(items, "item_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    rel = con.execute(module.ORACLE)
    want = [dict(zip([c[0] for c in rel.description], r, strict=True)) for r in rel.fetchall()]
    tidy = lambda d: repr(sorted((k, round(v, 6) if isinstance(v, float) else v) for k, v in d.items()))
    assert sorted(tidy(r.asDict()) for r in got.collect()) == sorted(map(tidy, want)) and want
