"""Text functions against plain Python."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmesh.functions import text as t
from lexmesh.functions.translit import icu_table, transliterate, transliterator, unigram
from lexmesh.functions.translit_cli import main

EDGE = ["", " ", "_.-:/\\", "?*()", "the", "The Of", "(*a", "?[x", "[x]?", "a//b", "don't.", "Wolverine wolverine", "élan", "北京", "a{b}c", "x\ny", None, "–", "İ", "1234", "Rev2", "rev2", "\t", "aXb" * 50]


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def plain_strip(s):
    for c in t.STRIPPED:
        s = s.strip(c)
    return s


def test_split(spark):
    got = column(spark, EDGE, t.split_terms)
    assert got == [[x for x in re.split(r"[ _.\-:/\\]+", v or "") if x] for v in EDGE]


def test_strip_is_ordered(spark):
    given_ = [v for v in EDGE if v is not None] + ['"(*a', "*(*", "a?.", ".?a"]
    assert column(spark, given_, t.strip_term) == [plain_strip(v) for v in given_]


def test_normalize(spark):
    got = column(spark, ["(The)", "Hello,", "", "''", "Rev2", "rev2", None], t.normalize_term)
    assert got == [None, "hello", None, None, "rev2", "rev2", None]
    assert column(spark, ["Rev2", "rev2", "rev"], lambda c: t.normalize_term(c, skip_numbers=True)) == ["rev2", None, "rev"]
    with pytest.raises(NotImplementedError):
        t.normalize_term(F.lit("x"), stemmer=True)


def plain_augment(term):
    out = t.TEMPLATE
    for c in term:
        if c not in "{}":
            out = out.replace(c, "*")
    c = term.translate(str.maketrans(t.FREQUENCY, t.FREQUENCY[::-1]))
    return out.format(c, c, c)


def test_cipher_and_augment(spark):
    words = ["wolverine", "small", "a", "a{b", "x-y", "élan", "北", "{}", "1"]
    assert column(spark, ["wolverine"], t.cipher) == ["sjgrqvbkq"]
    assert column(spark, words, t.augment) == [plain_augment(w) for w in words]


VOCABULARY = ["over", "the", "ab", "a", "b"]


def test_subwords(spark):
    words = ["Overtheab", "aabb", "", "zzz", "NovertheX", "bab"]
    assert column(spark, words, lambda c: t.subwords(c, VOCABULARY)) == [t.subwords_of(w, VOCABULARY) for w in words]
    for bad in ("", "Ab"):
        with pytest.raises(ValueError):
            t.check_vocabulary([bad])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abX-", min_size=1, max_size=6), max_size=5))
def test_words_expand_alone(words):
    """Expanding each word alone gives what expanding all of them joined does."""
    joined, found = "X".join(w.lower() for w in words), []
    for v in VOCABULARY:
        if v in joined:
            found.append(v)
            joined = joined.replace(v, "N")
    alone = {v for w in words for v in t.subwords_of(w, VOCABULARY)}
    assert found == [v for v in VOCABULARY if v in alone]


def test_transliterate(spark):
    table = icu_table(spark)
    assert column(spark, ["kožušček", "plain", "", None, "30 \U0001d5c4\U0001d5c6/\U0001d5c1", "", "北亰"], lambda c: transliterate(c, table)) == ["kozuscek", "plain", "", None, "30 km/h", "", "Bei Jing "]
    assert column(spark, ["Κνωσός"], transliterate) == ["Knosos"]
    assert column(spark, ["ab"], lambda c: transliterate(c, errors="replace")) == ["a?b"]
    assert column(spark, ["ab"], lambda c: transliterate(c, errors="preserve")) == ["ab"]
    for errors in ("strict", "other"):
        with pytest.raises(ValueError):
            transliterator({}, errors)("a")
    assert column(spark, ["élan", "北", "x", ""], lambda c: unigram(c, table)) == ["e", "b", "x", ""]


def test_command_line(tmp_path, capsys):
    file = tmp_path / "f"
    file.write_bytes("é\nx\n".encode())
    assert main([str(file), "-e", "utf-8"]) == 0
    assert capsys.readouterr().out == "e\nx\n"
    assert main(["-c", "ü"]) == 0
    assert main([str(file), "-c", "x"]) == 1
    file.write_bytes(b"\xff\n")
    assert main([str(file), "-e", "utf-8"]) == 1
