"""What works on many texts or places at once gives what the plain form gives."""

from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa

from lexmesh.llm import lm
from lexmesh.llm.tokenfile import END_ID, TOKENIZER, Encoder

TEXTS = ["", " \n a Bc\x0bÜN ÀB\x1cx\x85y z  end ", "a", "  ", "x y\tz\r\n", "Ab aB \x00q \U0001f600 w", "the end of the end"]


def plain(text):
    return text.encode().lower().split()


def test_words_are_read_together(monkeypatch):
    """op6 reads the words of many texts by Arrow functions."""
    monkeypatch.setattr(lm, "PART_CHARS", 12)
    monkeypatch.setattr(lm, "READ_CHARS", 12)
    flat, counts = lm.words(TEXTS)
    assert flat.to_pylist() == [w for t in TEXTS for w in plain(t)] and counts.tolist() == [len(plain(t)) for t in TEXTS]
    assert lm.bins_of(flat[3:]).tolist() == [lm.bin_of(w) for w in flat.to_pylist()[3:]]
    wanted, got = Counter(w for t in TEXTS for w in [*plain(t), lm.END]), Counter()
    for part in lm._counts(iter([pa.RecordBatch.from_pydict({"_t": TEXTS})])):
        for word, n in zip(part["word"].to_pylist(), part["n"].to_pylist(), strict=True):
            got[word] += n
    assert got == wanted
    for sent in ([lm.END, b"a", b"ab", b"the"], [b"end", b"x"]):
        v = lm.Vocabulary({w: i for i, w in enumerate(sent, 1)}, np.zeros(len(sent) + 1), 1, 1, np.zeros((lm.BINS, 2)), 2)
        read = list(lm.Known(v).read(TEXTS))
        assert len(read) == len(TEXTS)
        for text, (ids, symbols, rare) in zip(TEXTS, read, strict=True):
            own = [*plain(text), lm.END]
            assert ids.tolist() == [v.ids.get(w, 0) for w in own] and symbols.tolist() == [v.symbol(w) for w in own]
            assert rare == [w for w in own if w not in v.ids]


def test_thin_windows(monkeypatch):
    """op6 works on windows of few lanes by few calls: what they give is that of the form for many lanes, to rounding."""
    rng = np.random.default_rng(1)
    for size, lanes in ((1444, 7), (50, 3), (30, 1), (1444, 60)):
        m = lm.Model(size).start(rng.integers(0, 1000, size))
        m.p = {k: (a + 0.2 * rng.standard_normal(a.shape)).astype(np.float32) for k, a in m.p.items()}
        x, y = rng.integers(0, size, (2, lm.STEPS, lanes))
        fresh, live = (rng.random(x.shape) < 0.1).astype(np.float32), rng.random(x.shape) < 0.8
        h = rng.standard_normal((lanes, m.units)).astype(np.float32)
        for learn in (True, False):
            monkeypatch.setattr(lm, "THIN", 0)
            one = m.window(x, y, fresh, live, h, learn)
            monkeypatch.setattr(lm, "THIN", lm.STEPS * lanes)
            two = m.window(x, y, fresh, live, h, learn)
            assert np.allclose(one[0], two[0], atol=1e-5) and np.array_equal(one[1], two[1]) and np.allclose(one[2], two[2], atol=1e-5)
            assert (one[3] is None) == (two[3] is None) == (not learn)
            for k in one[3] or ():
                assert one[3][k].shape == two[3][k].shape and np.allclose(one[3][k], two[3][k], atol=1e-6)


def test_parts_of_pieces_go_to_the_library_once():
    """op3 sends a part once, however it is written and whatever stands beside it, and gets the library's ids."""
    texts = ["Word, word. (WORD) word's 'word' Ärger! ärger", "it's can't x''s '' a''b 12a3 <|endoftext|> a<|b <| ÿß~ word\x7f \x01 \x1cb", "Straße, STRASSE; naïve—no “word” 北京, ﬁne ét µm ª× a×b", ""]
    encoder, sent = Encoder(public_tokenizers.path(TOKENIZER)), []
    library, ids_of = encoder.tokenizer, encoder._ids
    encoder._ids = lambda some: sent.extend(some) or ids_of(some)
    for text, ids in zip(texts, encoder.encode(texts, 1), strict=True):
        assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, END_ID]
    parts = " ".join(sent).split()
    assert parts.count("word") == 1 and parts.count("ärger") == 1 and "Word," not in parts
