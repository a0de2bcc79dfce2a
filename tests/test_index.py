"""Index and search against a plain Python index."""

import json

import pytest
from lexmesh.functions.text import DELIMITERS, STOP_WORDS, subwords_of
from lexmesh.functions.tlsh import hash_bytes
from lexmesh.operators import index as index_module
from lexmesh.operators.fuzzyindex import FuzzyIndex
from lexmesh.operators.index import Options, first_places, index_batch
from lexmesh.operators.search import search, search_texts
from lexmesh.sources.storage import list_files, read_vocabulary, settle
from lexmesh.streaming.ingest import ingest
from tests.test_hash import distance
from tests.test_text import plain_augment, plain_strip

DOCS = [(0, "small ring"), (1, "Smal-Ring of the red"), (2, "blue_bolt small"), (3, ""), (4, None), (5, "the of"), (6, "bolt bolt BOLT"), (7, "ring small"), (8, "smell smile smog smalls")]


class Plain:
    """The whole index as dictionaries."""

    def __init__(self, vocabulary=()):
        self.keys, self.vocabulary = {}, vocabulary

    def terms(self, text, sub):
        import re

        words = [w for w in re.split("|".join(map(re.escape, DELIMITERS)), text or "") if w]
        more = [v for v in self.vocabulary if sub and any(v in subwords_of(w, self.vocabulary) for w in words)]
        for w in words + more:
            w = plain_strip(w)
            if w and w.lower() not in STOP_WORDS:
                yield w.lower()

    def hash(self, term):
        return hash_bytes([plain_augment(term).encode()])[0][1]

    def update(self, text, key):
        for w in self.terms(text, True):
            self.keys.setdefault(self.hash(w) + w[0], {})[key] = 1

    def query(self, text, threshold=150, cap=10_000, top=120, gone=()):
        out, terms = {}, list(self.terms(text, False))
        for i, w in enumerate(terms):
            h = self.hash(w)
            near = [(threshold - d, k) for k in self.keys if k[70] == w[0] and (d := distance(h, k[:70])) <= threshold][:cap]
            near = sorted(near, key=lambda x: -x[0])[:top]
            for s, k in near:
                for key in self.keys[k]:
                    if key not in gone:
                        scores = out.setdefault(key, [0] * len(terms))
                        scores[i] = max(scores[i], s)
        return out


def frame(spark, docs=DOCS):
    return spark.createDataFrame(docs, "key bigint, text string")


def found(spark, index, query, **more):
    q = spark.createDataFrame([(0, query)], "query_id int, query string")
    return {r.key: list(r.scores) for r in index.query_many(q, **more).collect()}


@pytest.fixture(scope="module")
def both(spark):
    index, plain = FuzzyIndex(spark, options=Options()), Plain()
    index.update_many(frame(spark))
    for key, text in DOCS:
        plain.update(text, key)
    return index, plain


QUERIES = ["smal", "smal rng", "bolt bolt", "the of", "", "BLUE-bolt's", "zzz", "small ring red"]


@pytest.mark.parametrize("threshold", [150, 40, 300])
def test_search(spark, both, threshold):
    index, plain = both
    got = {i: {} for i in range(len(QUERIES))}
    for r in index.query_many(spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string"), threshold).collect():
        got[r.query_id][r.key] = list(r.scores)
    assert got == {i: plain.query(q, threshold) for i, q in enumerate(QUERIES)}


def test_limits_count_in_insertion_order(spark, both):
    index, plain = both
    for cap, top in ((1, 120), (2, 1), (None, 1), (3, None)):
        assert found(spark, index, "smal", threshold=400, candidate_cap=cap, top_k=top) == plain.query("smal", 400, cap or 10**9, top or 10**9)


def test_many_hashes(spark):
    """More hashes in reach than the top and the cap let through."""
    docs = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)}x") for i in range(300)]
    index, plain = FuzzyIndex(spark, options=Options()), Plain()
    index.update_many(frame(spark, docs))
    for key, text in docs:
        plain.update(text, key)
    got = found(spark, index, "wordaax", threshold=400)
    assert len(got) == 120 and got == plain.query("wordaax", 400)
    assert found(spark, index, "wordaax", threshold=400, candidate_cap=50) == plain.query("wordaax", 400, 50)


def test_distance_at_the_threshold_scores_zero(spark, both):
    index, plain = both
    d = distance(plain.hash("smal"), plain.hash("small"))
    assert found(spark, index, "smal", threshold=d)[0] == [0]
    assert 0 not in found(spark, index, "smal", threshold=d - 1) or found(spark, index, "smal", threshold=d - 1)[0] != [0]


def test_updates_one_by_one_and_ranking(spark):
    index = FuzzyIndex(spark, options=Options())
    for key, text in DOCS:
        if text:
            index.update(text, key)
    index.update("blue", 0)  # adds to what 0 has
    ranked = index.query("smal rng")
    assert [sum(s) for _, s in ranked] == sorted((sum(s) for _, s in ranked), reverse=True)
    assert ranked[0][0] in (0, 1, 7)
    assert 0 in dict(index.query("blue")) and 0 in dict(index.query("small"))
    assert index.query("the of") == []
    s = index.stats()
    assert s["updates"] == 8 and s["keys"] == 6
    assert "Unique hashes" in str(index)


def test_replace(spark):
    index = FuzzyIndex(spark, options=Options())
    index.update_many(frame(spark))
    index.update_many(frame(spark, [(0, "gizmo")]), replace=True)
    assert 0 in dict(index.query("gizmo")) and 0 not in dict(index.query("small", threshold=0))


def test_invalid_keys(spark, both):
    index = FuzzyIndex(spark, options=Options())
    index.update_many(frame(spark))
    index.invalidate(0)
    assert found(spark, index, "smal rng") == both[1].query("smal rng", gone={0})


def test_subwords(spark):
    vocabulary = ["ring", "mall", "bol"]
    index, plain = FuzzyIndex(spark, options=Options(vocabulary=vocabulary)), Plain(vocabulary)
    docs = [(0, "smallring"), (1, "boltring x"), (2, "Mall")]
    index.update_many(frame(spark, docs))
    for key, text in docs:
        plain.update(text, key)
    for q in ("ring", "mall", "bol", "smallring"):
        assert found(spark, index, q) == plain.query(q)
    index = FuzzyIndex(spark, options=Options(vocabulary=vocabulary))
    index.update("smallring", 0, use_extended_tokenizer=False)
    assert found(spark, index, "ring", threshold=0) == {}


def test_large_vocabulary_goes_to_arrow(spark):
    vocabulary = [f"w{i}q" for i in range(250)] + ["ring"]
    got = index_batch(frame(spark, [(0, "smallring w7qring")]), Options(vocabulary=vocabulary))[0]
    assert got.count() == 4


def test_json(spark, both, tmp_path):
    index, plain = both
    path = str(tmp_path / "index")
    assert index.save(path) == (True, "")
    other = FuzzyIndex(spark, file_path=path, options=Options())
    assert other.name == index.name and other.stats()["hashes"] == index.stats()["hashes"]
    assert found(spark, other, "smal rng") == plain.query("smal rng")
    (tmp_path / "bad.json").write_text(json.dumps({"x": {"hash2ix": {}}}))
    assert other.load(str(tmp_path / "bad.json")) == (False, "expected invalid_indices key")
    (tmp_path / "worse.json").write_text(json.dumps({"x": {"invalid_indices": []}}))
    assert other.load(str(tmp_path / "worse.json")) == (False, "expected hash2ix key")
    assert found(spark, other, "smal rng") == plain.query("smal rng")  # nothing was replaced
    assert other.load(str(tmp_path / "none"))[0] is False
    other.reset(str(tmp_path / "empty"))
    assert other.query("small") == [] and FuzzyIndex(spark, file_path=str(tmp_path / "empty"), options=Options()).stats()["hashes"] == 0


def test_tables(spark, both, tmp_path):
    index, plain = both
    index.save_tables(str(tmp_path / "t"))
    other = FuzzyIndex(spark, options=Options())
    other.load_tables(str(tmp_path / "t"))
    assert found(spark, other, "smal rng") == plain.query("smal rng")
    q = spark.createDataFrame([(0, "smal")], "query_id int, query string")
    plan = search(q, other.postings, other.hashes, Options())._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "ReadSchema" in plan and "WindowGroupLimit" in plan


def test_shuffled_search_equals_broadcast(spark, both, monkeypatch):
    from lexmesh.operators import search as module

    index, plain = both
    monkeypatch.setattr(module, "MAX_BROADCAST_TERMS", 0)
    assert found(spark, index, "smal rng") == plain.query("smal rng")


def test_explain(spark):
    index = FuzzyIndex(spark, options=Options())
    rows = {r.query_token: r for r in index.explain("smal_the_zzz", "a small ring  smell").collect()}
    assert set(rows) == {"smal", "zzz"}
    assert rows["smal"].base_substring == "small" and rows["zzz"].base_substring is None and rows["zzz"].distance == 100_000
    with pytest.raises(ValueError):
        index.explain("two words", "x")


def test_stream(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "in"))
    index = FuzzyIndex(spark, options=Options())
    for _ in range(2):
        ingest(spark.readStream.schema("key bigint, text string").parquet(str(tmp_path / "in")), index, str(tmp_path / "check")).awaitTermination()
        frame(spark, [(20, "anvil")]).write.mode("append").parquet(str(tmp_path / "in"))
    assert dict(index.query("small"))[0] and 20 in dict(index.query("anvil"))


def test_sources(spark, tmp_path):
    for n in ("wolverine.txt", "other.txt"):
        (tmp_path / n).write_text("x")
    assert {r.text for r in list_files(spark, str(tmp_path)).collect()} == {"wolverine.txt", "other.txt"}
    (tmp_path / "v").mkdir()
    (tmp_path / "v/vocab.txt").write_text("ab\n\nabc\nzz\n")
    assert read_vocabulary(spark, str(tmp_path / "v/vocab.txt")) == ["abc", "ab", "zz"]
    index = FuzzyIndex(spark, options=Options())
    index.update_many(list_files(spark, str(tmp_path)))
    assert len(index.query("wulvrine", threshold=200)) >= 1


def test_empty_index(spark):
    index = FuzzyIndex(spark, options=Options())
    assert index.query("small") == []
    index.update_many(frame(spark, []))
    assert index.query("small") == [] and index.stats()["keys"] == 0


ODD = [(0, "small ring, smalll «smäll»"), (0, "ring smal small"), (7, "ring (small) SMALL? Ömall"), (-4, "small bolt"), (9, None), (3, ""), (5, "of the // __small-smal:ring//\\"), (8, "b smallx smale smals")]


@pytest.mark.parametrize("more,vocabulary,cap,top", [([], (), 10_000, 120), ([(None, "smalls ring small")], ("mal", "in"), 3, 2), ([(1 << 40, "smalls ring bring")], (), None, None)], ids=["packed", "null key", "wide keys"])
def test_search_without_index_is_search(spark, more, vocabulary, cap, top):
    docs = ODD + more
    options, q = Options(vocabulary=vocabulary), spark.createDataFrame([(1, "smal rng"), (2, "the of"), (3, "ring ring")], "query_id int, query string")
    gone = spark.createDataFrame([(7,)], "key bigint")
    want = search(q, *index_batch(frame(spark, docs), options), options, 300, cap, top, gone).collect()
    got = search_texts(q, frame(spark, docs), options, 300, cap, top, gone).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and want


def test_only_blocks_of_the_query_are_hashed_and_no_text_is_sorted(spark, monkeypatch):
    """Words are grouped by hashing, a row each a task, and only terms that a query's term is compared with are hashed."""
    settled = {}
    monkeypatch.setattr(index_module, "settle", lambda df, name: settled.setdefault(name, settle(df, name)))
    q = spark.createDataFrame([(1, "smal")], "query_id int, query string")
    search_texts(q, frame(spark), Options()).collect()
    assert {r.unigram for r in settled["terms"].collect()} == {"s"}
    plan = first_places(frame(spark), Options())._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
