"""Token counts of byte-level BPE by merging ragged arrays rank by rank."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.common import text_of

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
REMEMBERED = 400_000
#: White space as Unicode has it (the library's \s).
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones are themselves, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + extra)] = b
            extra += 1
    return out


class Counter:
    """Counts tokens; pre-tokens are merged in batches and their counts remembered up to a bound."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.size = max(vocab.values()) + 1
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.byte_id = np.zeros(256, np.int64)
        for letter, b in byte_letters().items():
            self.byte_id[b] = vocab[letter]
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.special_text = tuple(special)
        self.split = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+").findall
        self.known: dict[str, int] = {}

    def merge_counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token when no pair can be merged.

        All pre-tokens lie in one array. In a round each finds its pair of lowest rank and merges all its places at once
        (of overlapping ones every second, from the left): a merge only makes pairs of higher rank, so that is the order
        in which one at a time would go. Those without pairs leave.
        """
        counts = np.array([len(t) for t in tokens], np.int64)
        flat = self.byte_id[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), counts)
        none = len(self.merged)
        while len(flat) > 1:
            pair = flat[:-1] * self.size + flat[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            rank = np.append(rank, none)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, first)
            spread = np.repeat(lowest, np.diff(np.append(first, len(flat))))
            hit = (rank == spread) & (spread < none)
            # Among neighbouring hits take the 1st, 3rd, ... of each run.
            start = hit & ~np.append(False, hit[:-1])
            place = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(start, place, 0))
            hit &= (place - run) % 2 == 0
            flat = np.where(hit, self.merged[np.where(hit, rank, 0)], flat)
            stay = ~np.append(False, hit[:-1])
            alive = stay & (spread < none)
            ended = stay & (spread == none)
            if ended.any():
                who, left = np.unique(owner[ended], return_counts=True)
                counts[who] = left
            flat, owner = flat[alive], owner[alive]
        if len(flat):
            counts[owner[0]] = 1
        return counts

    def _pieces(self, text: str) -> tuple[list[str], int]:
        if self.special is None or not any(s in text for s in self.special_text):
            return self.split(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in self.split(part)], len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            parts, n = self._pieces(text)
            known = self.known
            if new := [p for p in set(parts) if p not in known]:
                if len(known) > REMEMBERED:
                    known.clear()
                    new = list(set(parts))
                for at in range(0, len(new), 50_000):
                    some = new[at : at + 50_000]
                    known.update(zip(some, self.merge_counts([p.encode("utf-8", "surrogatepass") for p in some]).tolist(), strict=True))
            out.append(n + sum(map(known.__getitem__, parts)))
        return out


def _count(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        counter = Counter(public_tokenizers.path(tokenizer))
        for batch in batches:
            n_bytes = pc.binary_length(batch["_t"]).cast(pa.int64())
            n_tokens = pa.array(counter.count(batch["_t"].to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], n_bytes, n_tokens], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs, with no shuffle.

    Null and empty texts have 0 of both. Repeated rows each give a row, an empty table none. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("_t"))
    out = rows.mapInArrow(_count(tokenizer), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
