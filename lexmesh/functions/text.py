"""Text functions of keyword indexing, as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide which terms and hashes an index holds.
DELIMITERS = (" ", "_", ".", "-", ":", "//", "/", "\\")
STRIPPED = ("*", ":", ",", ")", "(", "'", ".", '"', "\n", "\r", "[", "]", "?")
STOP_WORDS = ("the", "in", "of", "is", "a", "an", "and", "was", "it", "to", "he", "for", "as", "by", "on", "from", "are", "or", "that", "also", "with", "–", "at", "known", "his", "she", "has")
FREQUENCY = "etaonrishdlfcmugypwbvkjxzq"
TEMPLATE = "this is {}-{}-{} destined to be a value, otherwise would not have enough variation to begin with in the first place."


def split_terms(text: Column, delimiters: Sequence[str] = DELIMITERS) -> Column:
    """Non-empty pieces between delimiters, in order, repeats kept. A null text has none.

    Where single characters decide (a longer delimiter made of them adds nothing but empty pieces), runs of them are one
    delimiter and those at the ends are trimmed, so no empty piece comes up.
    """
    text, single = F.coalesce(text, F.lit("")), [d for d in delimiters if len(d) == 1]
    if single and all(set(d) <= set(single) for d in delimiters):
        text = F.btrim(text, F.lit("".join(single)))
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "[" + "".join(map(re.escape, single)) + "]+", -1))
    pattern = "|".join(re.escape(d) for d in sorted(delimiters, key=len, reverse=True))
    return F.filter(F.split(text, pattern, -1), lambda x: x != "")


def strip_term(term: Column) -> Column:
    """Take each of STRIPPED off both ends, one character after the other: what an earlier one uncovers it doesn't strip again."""
    bare = term
    for c in STRIPPED:
        bare = F.btrim(bare, F.lit(c))
    return F.when(F.btrim(term, F.lit("".join(STRIPPED))) == term, term).otherwise(bare)  # most words have none of them at their ends


def is_stop_word(term: Column) -> Column:
    return F.lower(term).isin(*STOP_WORDS)


def normalize_term(term: Column, stop_words: bool = True, skip_numbers: bool = False, stemmer: bool = False) -> Column:
    """The stripped term in lower case, or null if it is empty, a stop word or (skip_numbers) has a digit and no capital first."""
    if stemmer:
        raise NotImplementedError("stemming is not supported")

    def accepted(bare: Column) -> Column:
        keep = bare != ""
        if stop_words:
            keep &= ~is_stop_word(bare)
        if skip_numbers:
            keep &= bare.rlike(r"^\p{Lu}") | ~bare.rlike("[0-9]")
        return F.when(keep, F.lower(bare))

    return F.get(F.transform(F.array(strip_term(term)), accepted), F.lit(0))  # by way of an array, so that it is stripped once


def cipher(term: Column) -> Column:
    """Letters swapped by frequency: the commonest for the rarest and so on."""
    return F.translate(term, FREQUENCY, FREQUENCY[::-1])


def augment(term: Column) -> Column:
    """The text that is hashed for a term: the template with the term's letters starred out, and the ciphered term put in three times."""
    letters = F.regexp_replace(term, r"[{}]", "")
    starred = F.call_function("translate", F.lit(TEMPLATE), letters, F.repeat(F.lit("*"), F.length(letters)))
    return F.replace(starred, F.lit("{}"), cipher(term))


def subwords(word: Column, vocabulary: Sequence[str]) -> Column:
    """Vocabulary entries found in the lower-cased word, in vocabulary order; what an entry covers is hidden from later ones.

    Suited to vocabularies of up to a few hundred entries; lexmesh.operators.index takes larger ones to Arrow functions.
    """
    check_vocabulary(vocabulary)
    start = F.struct(F.lower(word).alias("left"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(
        F.array(*map(F.lit, vocabulary)).cast("array<string>"),
        start,
        lambda s, v: F.when(F.contains(s["left"], v), F.struct(F.replace(s["left"], v, F.lit("N")).alias("left"), F.concat(s["found"], F.array(v)).alias("found"))).otherwise(s),
        lambda s: s["found"],
    )


def subwords_of(word: str, vocabulary: Sequence[str]) -> list[str]:
    """The same for one Python string."""
    left, found = word.lower(), []
    for v in vocabulary:
        if v in left:
            found.append(v)
            left = left.replace(v, "N")
    return found


def check_vocabulary(vocabulary: Sequence[str]) -> None:
    for v in vocabulary:
        if not v or v != v.lower():
            raise ValueError(f"vocabulary entries are lower case and not empty: {v!r}")
