"""Small corpora for the operators' tests."""

import random


def documents(spark, rows, extra=()):
    """rows: (doc_id, text, source). extra: clashing column names, filled with text."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint" + "".join(f", `{c}` string" for c in extra)
    full = [(d, t, "en", s, None if t is None else len(t), *["x"] * len(extra)) for d, t, s in rows]
    return spark.createDataFrame(full, schema)


def words(rng, n, size=400):
    return [f"w{rng.randrange(size):x}" for _ in range(n)]


def corpus(seed=1):
    """Texts with copies, near copies, passages, ties, nulls, empties, a long one and repeated rows."""
    rng = random.Random(seed)
    base = [" ".join(words(rng, rng.randint(30, 120))) for _ in range(12)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(20 + i, base[0], "s0") for i in range(5)]
    near = base[1].split()
    for i in range(4):
        near[rng.randrange(len(near))] = "other"
        rows.append((30 + i, " ".join(near), None))
    rows += [(40, None, "s1"), (41, "", "s1"), (42, " \n\t ", None), (43, "one two", "s2"), (44, "Ünï ßtraße 北京 \U0001f600 end", "s2")]
    rows += [(45, " ".join(words(rng, 3000)), "s0"), (46, base[2] + "\n" + base[3] + "\n" + base[2], "s1")]
    rows += [(47, base[4] + "\n" + base[5][:80] + " tail of its own here", "s1"), (3, base[3], "s0"), (None, base[6], "s0"), (48, "the same words " * 30, "s2")]
    return rows
