"""Near duplicates, token files and counts, suffix deduplication, language model, pages and the pipeline against brute force."""

import hashlib
import io
import os
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tests.llm.helpers import corpus, documents
from tokenizers import Tokenizer

import corpus_pipeline
from lexmesh.llm import html, lm, simhash, suffixdedup, tokencount, tokenfile
from lexmesh.llm.common import Remembered
from tests.llm.test_near_dedup import plain_kept
from tests.llm.test_native_operators import EXTRA, WORD, base_rules, containment

ODD = list("abcABC '’\n\t\r\x0b\x1c\x85  éÉßİΣσς12٣½ªµ<|>_-!?…中かな한\U0001f600́e‍ÿ") + ["<|endoftext|>", "<|startoftext|>", "'s", " don't ", "  ", "aaaa"]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, corpus(), EXTRA).cache()


def odd_texts(n=1500):
    rng = random.Random(2)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 50))) for _ in range(n)] + ["", "a" * 5000, "ab" * 3000, " " * 300, "<|endoftext|>" * 5, "ΑΣ ΟΔΟΣ. Σ"]


# SimHash

def plain_print(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(s), 42) for s in ([w] if len(w) < 3 else zip(w, w[1:], w[2:]))]  # noqa: B905
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(prints, distance=2):
    """prints: (doc_id, fingerprint); a null id is last."""
    rows = list(prints)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [least[find(i)] for i in range(len(rows))]


def test_simhash(spark, docs):
    rows = corpus()
    prints = [(d, plain_print(t)) for d, t, _ in rows]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(prints, plain_components(prints), strict=True)), key=repr)
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=repr) == want
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(c for _, _, c in want))
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_links_of_crowded_fingerprints(spark, monkeypatch):
    """Chains, a crowd around one value in small blocks, and correlated bits: components equal those of all pairs."""
    rng = random.Random(8)
    prints = {0, (1 << 64) - 1}
    for _ in range(6):
        x = rng.getrandbits(64) & ~0xFFFF
        for _ in range(40):
            prints.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    center = rng.getrandbits(64)
    prints |= {center ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    listed = sorted(prints)
    signed = [simhash.signed(p) for p in listed]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    links = simhash.link_fingerprints(df, block=16).collect()
    assert all(((a.a ^ a.b) & (1 << 64) - 1) for a in links)
    root = {p: p for p in signed}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for r in links:
        root[find(r.a)] = find(r.b)
    want = plain_components([(i, p) for i, p in enumerate(listed)])
    groups = {}
    for p, c in zip(signed, want, strict=True):
        groups.setdefault(c, set()).add(find(p))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_thresholds_are_allocated():
    assert simhash.allocate([{-1: 0, 0: 5, 1: 50}, {-1: 0, 0: 9, 1: 60}, {-1: 0, 0: 1, 1: 3}], 0) == (8.0, [0, -1, 1])
    assert sorted(b for part in simhash.group_bits(np.ones((64, 64)), 2, 3) for b in part) == list(range(64))
    assert len(simhash.masks([1, 2, 3], 1)) == 3


# Token files and counts

def test_ids_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts, library = odd_texts() + [t for _, t, _ in corpus() if t], Tokenizer.from_file(path)
    for ids, e in zip(tokenfile.Encoder(path).encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == [*e.ids, 1]


def test_counts_equal_the_library(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts, library = odd_texts() + [t for _, t, _ in corpus() if t], Tokenizer.from_file(path)
    assert tokencount.Counter(path).count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = sorted((tuple(r) for r in tokencount.token_counts(docs).collect()), key=repr)
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(((d, len((t or "").encode()), n(t), n(t) > 1024) for d, t, _ in corpus()), key=repr)


def test_memory_is_bounded():
    made = []
    r = Remembered(lambda ks: [made.append(k) or k * 2 for k in ks], 10)
    for i in range(200):
        r.need({"often", str(i)})
        assert r["often"] == "oftenoften" and len(r) + len(r.old) <= 24
    assert made.count("often") == 1


@pytest.mark.parametrize("bits", [False, True])
def test_file_round_trip(bits):
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 2 ** rng.integers(1, 32), n, dtype=np.uint32) for n in (0, 1, 7, 1000, 64, 5000, 0, 128)]
    out = io.BytesIO()
    w = tokenfile.Writer(out, bits, block=64)
    for i, t in enumerate(texts):
        w.add(None if i == 3 else i * 10, t)
    w.close()
    r = tokenfile.Reader(io.BytesIO(out.getvalue()))
    assert r.nulls.tolist() == [0, 0, 0, 1, 0, 0, 0, 0] and r.doc_ids[5] == 50
    assert all(np.array_equal(r.span(int(s), int(n)), t) for s, n, t in zip(r.starts, r.counts, texts, strict=True))
    with pytest.raises(ValueError):
        tokenfile.Reader(io.BytesIO(out.getvalue()[:-1]))


def test_token_files(spark, docs):
    library, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for d, t, _ in sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in tokenfile.token_digest(docs).collect()), key=lambda r: r[1]) == want
    assert tokenfile.token_digest(documents(spark, [])).count() == 0


# Suffix deduplication

def plain_removed(rows, length=50):
    first, last = {}, 1 << 62
    texts = [(last if d is None else d, (t or "").encode()) for d, t, _ in rows]
    for d, t in texts:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            first[w] = min(first.get(w, last), d)
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        yield None if d == last else d, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()


def test_suffix(spark, docs, monkeypatch):
    rng = random.Random(6)
    passage = "".join(rng.choice("abc ") for _ in range(120))
    rows = corpus() + [(60 + i, "".join(rng.choice("xyzé") for _ in range(rng.randint(0, 90))) + passage[rng.randint(0, 40) : rng.randint(80, 120)] + "q" * rng.randint(0, 200), "s") for i in range(25)]
    frame, want = documents(spark, rows, EXTRA), sorted(plain_removed(rows), key=repr)
    assert sorted((tuple(r) for r in suffixdedup.remove_repeats(frame).collect()), key=repr) == want
    monkeypatch.setattr(suffixdedup, "INDEX_BYTES", 500)  # crowded names are dealt to several indexes
    monkeypatch.setattr(suffixdedup, "LONGEST", 40)
    monkeypatch.setattr(suffixdedup, "HELD_NAMES", 30)
    got = suffixdedup.remove_repeats(frame, texts=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert suffixdedup.remove_repeats(documents(spark, [])).count() == 0


def test_long_texts_in_parts(monkeypatch):
    data = bytes(random.Random(1).choice(b"abcd") for _ in range(5000))
    whole = [x.tolist() for x in next(iter(suffixdedup.named_runs(data)))]
    monkeypatch.setattr(suffixdedup, "CHUNK", 700)
    names = lambda parts: [v for n, f, c in parts for v, k in zip(n, c, strict=True) for _ in range(k)]
    assert names(suffixdedup.named_runs(data)) == names([whole])


def test_index():
    rng = random.Random(3)
    for trial in range(60):
        base = [bytes(rng.choice(b"ab") for _ in range(rng.randint(50, 90))) for _ in range(3)]
        parts = []
        for _ in range(rng.randint(1, 10)):
            x = rng.choice(base)
            i = rng.randint(0, len(x) - 50)
            parts.append(bytes([rng.choice(b"abc\0\xff")]) * rng.randint(0, 3) + x[i : rng.randint(i + 50, len(x))])
        parts += [b"a" * 60, b"a" * 75] * (trial % 2)
        docs_ = np.array(sorted(rng.randrange(9) for _ in parts))
        want = {}
        for p, d in zip(parts, docs_, strict=True):
            for i in range(len(p) - 49):
                want[p[i : i + 50]] = min(want.get(p[i : i + 50], 99), d)
        got = list(zip(*suffixdedup.first_documents(parts, docs_), strict=True))
        assert all(want[parts[w][a : a + 50]] == least for w, a, least in got) and len(got) == sum(len(p) - 49 for p in parts)
        index = suffixdedup.RunIndex(parts)
        assert index.run_lengths.sum() == index.size == sum(map(len, parts)) + len(parts) and len(index.first_samples) == len(index.heads)


def test_index_holds_runs_only():
    """Of copies with few changes the index has far fewer elements than letters; streaming gives suffix order and shared letters."""
    rng = random.Random(5)
    base = bytes(rng.choice(b"abcdefgh") for _ in range(400))
    parts = [bytes(c if rng.random() > 0.005 else 120 for c in base) for _ in range(40)]
    index = suffixdedup.RunIndex(parts)
    assert max(v.size for v in vars(index).values() if isinstance(v, np.ndarray)) < index.size / 4
    rows = {}
    for lane, place, row, match in index.stream():
        rows.update({r: (parts[k][p:], m) for k, p, r, m in zip(lane.tolist(), place.tolist(), row.tolist(), match.tolist(), strict=True)})
    listed = [rows[r] for r in sorted(rows)]
    assert len(listed) == sum(map(len, parts)) and [s for s, _ in listed] == sorted(s for s, _ in listed)
    for (a, _), (b, m) in zip(listed, listed[1:], strict=False):
        n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert min(n, 50) == min(m, 50)


# Language model

def test_gradients():
    rng = np.random.default_rng(0)
    m = lm.Model(11, 4)
    for k in m.p:
        m.p[k] = rng.standard_normal(m.shapes[k]).astype(np.float32) * 0.5
    x, y = rng.integers(0, 11, (5, 3)), rng.integers(0, 11, (5, 3))
    fresh, live = np.zeros((5, 3), np.float32), np.ones((5, 3), bool)
    fresh[2, 1], live[4, 0] = 1, False
    h = rng.standard_normal((3, 4)).astype(np.float32)
    loss = lambda: -float(np.mean(m.window(x, y, fresh, live, h, False)[0]))
    grads = m.window(x, y, fresh, live, h, True)[3]
    for k in m.shapes:
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in m.shapes[k])
            keep = m.p[k][at]
            m.p[k][at] = keep + 1e-2
            up = loss()
            m.p[k][at] = keep - 1e-2
            down = loss()
            m.p[k][at] = keep
            assert abs((up - down) / 2e-2 - grads[k][at]) < 3e-3, k


def test_training_is_adam_of_each_parameter():
    """Training on one vector of all parameters gives what Adam gives array by array, and leaves the given start alone."""
    rng = np.random.default_rng(5)
    docs_ = [(i, rng.integers(0, 30, n).astype(np.int32)) for i, n in enumerate(rng.integers(1, 200, 40))]
    begin = lm.Model(30, 4).flat()
    one, two = lm.Model(30, 4).load(begin), lm.Model(30, 4).load(begin)
    seen = lm.train(one, iter(docs_), 1)
    mean, var = ({k: np.zeros(s) for k, s in two.shapes.items()} for _ in "ab")
    h = np.zeros((lm.LANES, 4), np.float32)
    for step, (x, y, fresh, live, _, _, _, used) in enumerate(lm.Lanes(iter(docs_), 1).windows(), 1):
        _, _, h[used], grads = two.window(x, y, fresh, live, h[used], True)
        scale = min(1, lm.CLIP / np.sqrt(sum((g.astype(float) ** 2).sum() for g in grads.values())))
        for k, g in grads.items():
            mean[k] = 0.9 * mean[k] + 0.1 * scale * g
            var[k] = 0.999 * var[k] + 0.001 * (scale * g) ** 2
            two.p[k] -= (lm.RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * mean[k] / (np.sqrt(var[k]) + 1e-8)).astype(np.float32)
    assert seen == sum(len(v) for _, v in docs_) and np.abs(one.flat() - begin).max() > 0.01
    assert np.allclose(one.flat(), two.flat(), atol=1e-3) and np.array_equal(begin, lm.Model(30, 4).flat())
    assert all(np.shares_memory(v, one.p["E"].base) for v in one.p.values())


def test_state_is_carried_and_probabilities_sum_to_one():
    m = lm.Model(7, 4)
    docs_ = [(i, np.array(v, np.int32)) for i, v in enumerate([[1, 2, 3] * 30, [4], [0, 5], [6] * 70, [2, 1]])]
    got = dict(lm.score(m, iter(docs_), 1))
    for i, ids in docs_:
        h, total = np.zeros((1, 4), np.float32), 0.0
        for t, w in enumerate(ids):
            before = ids[t - 1] if t else 1
            logp, _, after, _ = m.window(np.array([[before]]), np.array([[w]]), np.zeros((1, 1), np.float32), np.ones((1, 1), bool), h, False)
            every = sum(np.exp(m.window(np.array([[before]]), np.array([[v]]), np.zeros((1, 1), np.float32), np.ones((1, 1), bool), h, False)[0][0]) for v in range(m.classes * m.width))
            assert abs(every - 1) < 1e-4
            h, total = after, total + float(logp[0])
        assert abs(got[i] - total / np.log(10)) < 1e-3 * max(1, len(ids))


def held_out(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0


def test_scores(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "SENT_WORDS", 50)
    monkeypatch.setattr(lm, "MODEL_WORDS", 30)
    tokens = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] + [""]
    c = Counter(w for d, t, _ in corpus() if not held_out(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for d, t, _ in corpus():
        w = tokens(t)
        want[d, held_out(d), len(w), sum(x in c for x in w), n, round(sum(log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)] += 1
    got = lm.score_documents(docs).collect()
    assert Counter((*tuple(r)[:5], round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm.score_documents(documents(spark, [])).count() == 0
    only = lm.score_documents(documents(spark, [(next(i for i in range(99) if held_out(i)), "a b", "s")])).first()
    assert only.train_tokens == 0 and only.n_known == 0 and abs(only.base_score) < 1e-9


def test_scores_do_not_depend_on_partitions(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 1000)
    scores = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score) for r in lm.score_documents(df).collect())
    one, other = scores(docs.coalesce(1)), scores(docs.repartition(5, "text"))
    assert len(one) == len(other) and all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-3 * abs(a[3]) for a, b in zip(one, other, strict=True))


def test_shared_symbols_sum_to_one():
    counts = Counter({w.encode(): n for n, w in enumerate(("ending", "bending", "sending", "x", "yx", "", "one"), 1)})
    shared = np.zeros((lm.BINS, 2))
    for w, n in list(counts.items())[2:]:
        shared[lm.bin_of(w)] += n, 1
    v = lm.Vocabulary({w: i for i, w in enumerate(list(counts)[:2], 1)}, np.array([0, 1, 2]), sum(counts.values()), len(counts), shared, 2)
    assert v.size == lm.BINS + 2 and v.counts_of_model().sum() == v.n and v.symbol(b"ending") == lm.BINS and v.end == lm.bin_of(b"")
    for b in {lm.bin_of(w) for w in list(counts)[2:]}:
        inside = [n for w, n in list(counts.items())[2:] if lm.bin_of(w) == b]
        assert abs(sum((n + lm.WEIGHT) / 10 ** v.shares()[b] for n in [*inside, 0]) - 1) < 1e-9


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_held_out_documents_are_likelier_than_by_counts(spark):
    rows = [r for r in lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.97 * sum(r.base_score for r in rows)


def test_model_beats_counts_on_held_out_text(spark):
    """Text in which the next word follows from the last."""
    rng = random.Random(0)
    rows = []
    for d in range(400):
        at, out = rng.randrange(20), []
        for _ in range(150):
            at = (at * 3 + rng.randrange(2)) % 20
            out.append(f"w{at}")
        rows.append((d, " ".join(out), "s"))
    got = [r for r in lm.score_documents(documents(spark, rows)).collect() if r.held_out]
    assert len(got) > 10 and sum(r.score for r in got) > sum(r.base_score for r in got) * 0.9


# Pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";if(a<b)x();</script></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">Cookies</div>
<main><article class=post id='a>b'><header><h1>Title &amp; more</h1><p>By someone</p></header><p>First   <b>bold</b> part<br>next.<p>Second &lt;p&gt;&nbsp;x &eacute; &#8364; &am
<!-- no > comment --><div class="ad">Buy</div><ul><li>one<li>two <i>it</i></ul><aside>Side</aside><form><p>Mail</p><input></form><blockquote><p>Quote</p></blockquote>
<table><tr><td>a</td><td>b</td></tr></table><section class="comments"><article><p>Reader</p></article></section><footer>Foot</footer></article></main>
<div id="sidebar">Bar</div><footer>End</footer></body></html>"""
MAIN = ["Title & more", "First bold part next.", "Second <p> x é € &am", "one", "two it", "Quote", "a b"]


def test_blocks():
    assert [s for s, _ in html.blocks(PAGE)[0]] == MAIN
    for text, want in (("", []), ("plain  text", ["plain text"]), ("<p>a</p>b<p", ["a", "b"]), ("<div hidden>x</div>y", ["y"]), ("<!-- open", []), ("<script>x", []), ("<main><p>m</main><p>n", ["m"]), ("1 < 2 <p>x", ["1 < 2", "x"]), ("<p>a<span>b</p>c</div>", ["ab", "c"])):
        assert [s for s, _ in html.blocks(text)[0]] == want, text
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert [s for s, _ in html.blocks(deep)[0]] == ["x"]


def test_templates(spark):
    rng = random.Random(5)
    rows = []
    for i in range(40):
        own = "".join(f"<p>{' '.join(f'w{rng.randrange(10**6)}' for _ in range(8))}</p>" for _ in range(3))
        rows.append((i, f"http://a.example/{i}", f"<article><h1>T{i}</h1>{own}<div><p>Read this too</p><p>And this</p></div>{own[:40]}</article>"))
    copied = "<article><h1>Copy</h1><p>Same text</p><p>Same end</p></article>"
    rows += [(100 + i, "http://b.example/x", copied) for i in range(30)] + [(200, None, None), (201, "http://[bad", "<p>x</p>"), (202, "", "")]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all("Read this" not in got[i].text and "And this" not in got[i].text and got[i].text.startswith(f"T{i}\n\nw") for i in range(40))
    assert all(got[100 + i].text == "Copy\n\nSame text\n\nSame end" for i in range(30))
    assert got[200].text == "" and got[200].n_chars == 0 and got[201].text == "x" and got[202].text == ""
    assert html.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# Pipeline

def test_pipeline(spark, tmp_path):
    rows = [r for r in corpus() if r[0] is not None and r[0] != 3]
    leak = " ".join(corpus()[7][1].split()[5:30])
    documents(spark, rows).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = {(d, t): (d, t, s) for d, t, s in rows if not base_rules(t)[5]}.values()
    at = list(at)
    near = plain_kept(at)
    stage2 = [r for r in at if r[0] in near]
    stage3 = [r for r in stage2 if (m := containment(r[1], leak))[0] * 100 < 80 * m[1]]
    assert len(at) > len(stage2) > len(stage3)
    docs_ = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), want in zip(corpus_pipeline.STAGES[:3], (at, stage2, stage3), strict=False):
        out = stage(spark, docs_, str(tmp_path))
        assert out.columns == docs_.columns
        out.write.parquet(str(tmp_path / name))
        docs_ = spark.read.parquet(str(tmp_path / name))
        assert sorted(r.doc_id for r in docs_.collect()) == sorted(r[0] for r in want), name
    end = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in end} <= {r[0] for r in stage3} and max(Counter(r.doc_id for r in end).values()) <= 2
    end.sort(key=lambda r: r.start)
    assert [r.doc_id for r in end] == sorted(r.doc_id for r in end)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(end, end[1:], strict=False))
