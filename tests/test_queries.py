"""Every keyword query at the smallest scale against its SQL, and the entry point with and without the training-data part."""

import os
import re
import shutil
import subprocess
import sys
import unicodedata

import duckdb
import pytest

import __spark_entry__
from lexmesh.plans import queries as keyword

DATA, ROOT = "/root/testdata/sf0.001", os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SQL = keyword.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("part", "documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got = keyword.QUERIES[name](spark, DATA)
    rel = duck.execute(SQL[name])
    want = sorted(repr(sorted(zip([c[0] for c in rel.description], r, strict=True))) for r in rel.fetchall())
    assert sorted(repr(sorted(r.asDict().items())) for r in got.collect()) == want and want


def test_transliteration_of_all_scripts(spark, tmp_path):
    """Words of several scripts, digits and signs; Latin ones agree with their decomposition, blocks with the first ASCII letter."""
    text = "Élan straße 北京 Москва Ωmega naïve 42nd ひらがな 한글 (quoted) don't Œuvre"
    rows = [(1, text), (2, "élan " + text.upper()), (3, None), (4, ""), (5, " \n ")]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.word: r.ascii for r in keyword.transliterate_words(spark, str(tmp_path)).collect()}
    assert set(got) == {w for _, t in rows for w in re.split(r"[ _.:/\\-]+", t or "") if w}
    assert all(a.isascii() for a in got.values()) and got["北京"] and got["한글"] and got["ひらがな"]
    for w in ("Élan", "naïve", "42nd", "(quoted)", "don't"):
        assert got[w] == unicodedata.normalize("NFD", w).encode("ascii", "ignore").decode()
    assert (got["straße"], got["Œuvre"].lower()[:2], got["Москва"][0], got["Ωmega"][-4:]) == ("strasse", "oe", "M", "mega")
    blocks = {r.unigram: r.n for r in keyword.unigram_histogram(spark, str(tmp_path)).collect()}
    assert blocks["4"] == 1 and blocks["e"] >= 1 and blocks["d"] == 1 and blocks["q"] == 1 and all(len(u) <= 1 for u in blocks)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_data_part(tmp_path):
    for name in ("__spark_entry__.py", "lexmesh"):
        copy = shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy
        copy(f"{ROOT}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "lexmesh/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and set(q) >= set(e.oracle_sql()), q; print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) == len(keyword.QUERIES), out.stderr


def test_nothing_else_imports_it():
    for folder, _, names in os.walk(f"{ROOT}/lexmesh"):
        if not folder.endswith("llm"):
            for n in names:
                if n.endswith(".py"):
                    with open(f"{folder}/{n}", encoding="utf-8") as f:
                        assert "lexmesh.llm" not in f.read()


def test_term_document_frequency_of_repeated_ids(spark, tmp_path, monkeypatch):
    """Rows of one id, null too, are one document; nothing but terms is shuffled where no id is repeated."""
    rows = [(1, "Ring (ring) bolt"), (1, "ring, the nut"), (None, "ring"), (None, "RING of bolt"), (2, "bolt-bolt ΟΔΟΣ"), (3, None), (4, "?? ring")]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    want = {"ring": 3, "bolt": 3, "nut": 1, "οδος": 1}
    for limit in (1_000_000, 1):
        monkeypatch.setattr(keyword, "MAX_BROADCAST_IDS", limit)
        assert {r.term: r.df for r in keyword.term_document_frequency(spark, str(tmp_path)).collect()} == want
    spark.createDataFrame(rows[4:], "doc_id bigint, text string").write.parquet(str(tmp_path / "b" / "documents.parquet"))
    plan = keyword.term_document_frequency(spark, str(tmp_path / "b"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
