"""Unicode to ASCII, by rules: compatibility decomposition, character names, and the JVM's ICU transforms where it has them."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ERRORS = ("ignore", "strict", "replace", "preserve")
LETTER = re.compile(r"(?:GREEK|CYRILLIC|COPTIC|ARMENIAN|HEBREW|GEORGIAN|LATIN|MATHEMATICAL [A-Z -]*?)(?: (?:SMALL|CAPITAL))? (?:FINAL )?LETTER (?:FINAL )?([A-Z]+)")
# Letters whose name is not their sound.
SPECIAL = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ı": "i", "–": "-", "—": "--", "‘": "'", "’": "'", "“": '"', "”": '"', "«": "<<", "»": ">>", "…": "...", "€": "EUR", "©": "(c)", "®": "(r)", "·": "*", "×": "x", "÷": "/"}
SOUNDS = {"ALPHA": "a", "BETA": "b", "GAMMA": "g", "DELTA": "d", "EPSILON": "e", "ZETA": "z", "ETA": "e", "THETA": "th", "IOTA": "i", "KAPPA": "k", "LAMDA": "l", "LAMBDA": "l", "MU": "m", "NU": "n", "XI": "x", "OMICRON": "o", "PI": "p", "RHO": "r", "SIGMA": "s", "TAU": "t", "UPSILON": "u", "PHI": "ph", "CHI": "kh", "PSI": "ps", "OMEGA": "o", "SHORT": "i", "HARD": "'", "SOFT": "'", "EF": "f", "EL": "l", "EM": "m", "EN": "n", "ER": "r", "ES": "s", "BE": "b", "VE": "v", "GHE": "g", "DE": "d", "IE": "e", "IO": "io", "ZHE": "zh", "ZE": "z", "KA": "k", "PE": "p", "TE": "t", "HA": "kh", "TSE": "ts", "CHE": "ch", "SHA": "sh", "SHCHA": "shch", "YERU": "y"}


def by_rule(char: str) -> str | None:
    """ASCII for one character by decomposition or name; None if neither gives any."""
    if ord(char) < 0x80:
        return char
    if char in SPECIAL:
        return SPECIAL[char]
    plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
    if plain and plain.isascii():
        return plain
    if len(plain) == 1 and plain in SPECIAL:
        return SPECIAL[plain]
    if unicodedata.combining(char):
        return ""
    m = LETTER.match(unicodedata.name(plain[:1] or char, ""))
    if not m:
        return None
    sound = SOUNDS.get(m[1], m[1].lower())
    return sound.capitalize() if unicodedata.category(plain[:1])[1:] == "u" else sound


def icu_table(spark: SparkSession, first: int = 0x80, last: int = 0xFFFF) -> dict[str, str]:
    """What the JVM's ICU makes of the characters that no rule covers (CJK, kana, Hangul and others); empty without ICU.

    At most as many entries as the range has code points: the table is bounded by Unicode, not by data.
    """
    chars = [chr(c) for c in range(first, last + 1) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c))[0] in "LN" and by_rule(chr(c)) is None]
    try:
        to_ascii = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance("Any-Latin; NFD; [:Nonspacing Mark:] Remove; Latin-ASCII")
    except TypeError:
        return {}
    got = to_ascii.transliterate("\n".join(chars)).split("\n")
    return {c: g[:1].upper() + g[1:] + " " if "㐀" <= c <= "鿿" else g for c, g in zip(chars, got, strict=True) if g != c and g.isascii()}


def transliterator(table: dict[str, str], errors: str = "ignore", replace_str: str = "?"):
    """A function from string to string. Any other value of errors fails when a character without replacement is met."""

    @cache
    def one(char: str) -> str | None:
        got = by_rule(char)
        return table.get(char) if got is None else got

    def whole(text: str) -> str:
        out = []
        for i, c in enumerate(text):
            r = one(c)
            if r is None:
                if errors == "strict":
                    raise ValueError(f"no replacement found for character {c!r} in position {i}")
                if errors not in ERRORS:
                    raise ValueError(f"invalid value for errors parameter {errors!r}")
                r = {"ignore": "", "replace": replace_str, "preserve": c}[errors]
            out.append(r)
        return "".join(out)

    return whole


def transliterate(text: Column, table: dict[str, str] | None = None, errors: str = "ignore", replace_str: str = "?") -> Column:
    """ASCII for a text. Pure ASCII stays in the JVM; only other texts go to an Arrow function."""
    entries = table or {}

    @F.pandas_udf(StringType())
    def slow(values: pd.Series) -> pd.Series:
        whole = transliterator(entries, errors, replace_str)
        return values.map(lambda v: None if v is None else whole(v))

    ascii_only = ~text.rlike(r"[^\x00-\x7f]")
    return F.when(ascii_only, text).otherwise(slow(F.when(~ascii_only, text)))


@cache
def _ruled() -> dict[str, str]:
    """The first character, in lower case, that by_rule gives for each character beyond ASCII; empty if it gives none."""
    rules = ((c, by_rule(c)) for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) not in ("Cn", "Co", "Cs"))
    return {c: r[:1].lower() for c, r in rules if r is not None}


def unigram(term: Column, table: dict[str, str] | None = None) -> Column:
    """The first ASCII character of a term in lower case, the empty string if it has none. It names the term's block.

    One character decides, so a translation of single characters does, within the JVM.
    """
    known = {c: r[:1].lower() for c, r in (table or {}).items() if ord(c) >= 0x80} | _ruled()
    kept, dropped = [c for c, r in known.items() if r], [c for c, r in known.items() if not r]
    first = F.translate(F.left(term, F.lit(1)), "".join(kept + dropped), "".join(known[c] for c in kept))
    return F.when(first >= F.lit("\x80"), F.lit("")).otherwise(F.lower(first))
