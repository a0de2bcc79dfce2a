"""Token ids in binary files: blocks of ids, byte or bit planes, zstandard, and an index of chunks and documents.

A file: MAGIC; the chunks; the index; the index's length (8 bytes) and crc32 (4 bytes); MAGIC. A chunk holds BLOCK ids
(the last one fewer), transposed into planes: plane k has byte k (or bit k) of every id. Each plane is compressed alone;
one of zeros takes no bytes. The index, compressed too, lists each chunk's offset, ids and plane sizes, and each
document's id (with a null flag) and count of ids.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.llm.common import Remembered, cut, fresh_path, text_of

MAGIC = b"LXIDS001"
BLOCK = 1 << 16
END_ID = 1
END = struct.pack("<I", END_ID)
TOKENIZER = "word_bpe_49k.json"
#: Pieces whose ids a worker remembers in each of two generations.
REMEMBERED = 400_000
#: Parts of pieces, likewise.
PARTS = 200_000


def planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of one block of 32-bit ids: 4 of bytes, or 32 of bits."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(rows[:, k]).tobytes() for k in range(4)]
    return [np.packbits(b).tobytes() for b in np.unpackbits(rows, axis=1, bitorder="little").T]


def unplane(parts: list[bytes | None], n: int, bits: bool) -> np.ndarray:
    """The ids back; None stands for a plane of zeros."""
    rows = np.zeros((n, 4), np.uint8)
    if bits:
        spread = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(parts):
            if p is not None:
                spread[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n)
        rows = np.packbits(spread, axis=1, bitorder="little")
    else:
        for k, p in enumerate(parts):
            if p is not None:
                rows[:, k] = np.frombuffer(p, np.uint8)
    return np.ascontiguousarray(rows).view("<u4").ravel()


class Writer:
    """Streams documents into one file; holds one block of ids and the counts of documents."""

    def __init__(self, out, bits: bool = False, block: int = BLOCK):
        self.out, self.bits, self.block, self.at = out, bits, block, len(MAGIC)
        self.zip, self.held, self.n_held = zstandard.ZstdCompressor(level=3), [], 0
        self.chunks, self.ids, self.counts = [], [], []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            flat = np.concatenate(self.held)
            full = len(flat) // self.block * self.block
            for at in range(0, full, self.block):
                self._chunk(flat[at : at + self.block])
            self.held, self.n_held = [flat[full:]], len(flat) - full

    def _chunk(self, ids: np.ndarray) -> None:
        sizes = []
        for p in planes(ids, self.bits):
            z = self.zip.compress(p) if any(p) else b""
            self.out.write(z)
            sizes.append(len(z))
        self.chunks.append((self.at, len(ids), *sizes))
        self.at += sum(sizes)

    def close(self) -> None:
        if self.n_held:
            self._chunk(np.concatenate(self.held))
        width = 2 + (32 if self.bits else 4)
        head = struct.pack("<BIQQ", self.bits, self.block, len(self.chunks), len(self.counts))
        nulls = np.array([x is None for x in self.ids], np.uint8)
        ids = np.array([0 if x is None else x for x in self.ids], "<i8")
        body = np.array(self.chunks, "<u8").reshape(-1, width).tobytes() + nulls.tobytes() + ids.tobytes() + np.array(self.counts, "<u8").tobytes()
        index = self.zip.compress(head + body)
        self.out.write(index + struct.pack("<QI", len(index), zlib.crc32(index)) + MAGIC)


class Reader:
    """Reads a file by its index; any span of ids touches only its chunks."""

    def __init__(self, file):
        self.file, tail = file, 12 + len(MAGIC)
        size = file.seek(0, 2)
        file.seek(size - tail)
        length, crc = struct.unpack("<QI", (end := file.read(tail))[:12])
        file.seek(size - tail - length)
        index = file.read(length)
        if end[12:] != MAGIC or zlib.crc32(index) != crc:
            raise ValueError("not a whole token file")
        raw = zstandard.ZstdDecompressor().decompress(index)
        self.bits, self.block, n_chunks, n = struct.unpack_from("<BIQQ", raw)
        at, width = struct.calcsize("<BIQQ"), 2 + (32 if self.bits else 4)
        self.chunks = np.frombuffer(raw, "<u8", n_chunks * width, at).reshape(-1, width)
        at += self.chunks.nbytes
        self.nulls = np.frombuffer(raw, np.uint8, n, at)
        self.doc_ids = np.frombuffer(raw, "<i8", n, at + n)
        self.counts = np.frombuffer(raw, "<u8", n, at + 9 * n).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.unzip, self.last = zstandard.ZstdDecompressor(), (-1, None)

    def chunk(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            at, n, *sizes = (int(x) for x in self.chunks[k])
            self.file.seek(at)
            parts = [self.unzip.decompress(self.file.read(s)) if s else None for s in sizes]
            self.last = (k, unplane(parts, n, bool(self.bits)))
        return self.last[1]

    def span(self, start: int, n: int) -> np.ndarray:
        if not n:
            return np.empty(0, "<u4")
        first, last = start // self.block, (start + n - 1) // self.block
        parts = [self.chunk(k)[max(0, start - k * self.block) : start + n - k * self.block] for k in range(first, last + 1)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


class Encoder:
    """The library's ids of whole texts.

    Its pattern drops white space and no step looks across it (normal forms and lower case neither), so a text's ids are
    those of its pieces between blanks in order; each new piece goes to the library once. Plain pieces are told apart
    into the parts that the pattern makes of them, in lower case, and a part goes to the library once, however it is
    written and whatever stands beside it. Parts go there many at a time, joined by spaces: each ends in one end-of-word
    symbol, which tells their ids apart. The library's fast form gives the same ids without their places in the text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known, self.made = Remembered(self._make, REMEMBERED), Remembered(self._of_parts, PARTS)
        self.odd = regex.compile(r"[\x1c-\x1f]").search  # blank to Python, symbols to the library
        self.between = regex.compile(r"[^ \t\n\r]+").findall
        self.plain = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
        self.parts = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+|\n").findall  # of plain pieces

    def pieces(self, text: str) -> list[str]:
        return self.between(text) if self.odd(text) else text.split()

    def _make(self, pieces: list[str]) -> list[bytes]:
        word = lambda p: p.isascii() and p.isalpha()
        split = {p: [p.lower()] for p in pieces if word(p)}
        mixed, parts = [p for p in pieces if p not in split and "<|" not in p and self.plain(p)], []
        ended = iter(mixed)
        for part in self.parts("".join([p + "\n" for p in mixed]).lower()):
            if part == "\n":
                split[next(ended)], parts = parts, []
            else:
                parts.append(part)
        self.made.need(set().union(*split.values()))
        out = {p: self.made[parts[0]] if len(parts) == 1 else b"".join(map(self.made.__getitem__, parts)) for p, parts in split.items()}
        rest = [p for p in pieces if p not in out]
        out.update(zip(rest, self._each(rest), strict=True))
        return [out[p] for p in pieces]

    def _of_parts(self, parts: list[str]) -> list[bytes]:
        ids = np.array(self._ids([" ".join(parts)])[0].ids, "<u4")
        stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
        if len(stops) != len(parts):
            return self._each(parts)
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip([0, *stops], stops, strict=False)]

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self._ids(texts)]

    def _ids(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def encode(self, texts: list[str], group: int = 512) -> Iterator[np.ndarray]:
        for at in range(0, len(texts), group):
            split = [self.pieces(t) for t in texts[at : at + group]]
            self.known.need(set().union(*split))
            for parts in split:
                yield np.frombuffer(b"".join([*map(self.known.__getitem__, parts), END]), "<u4")


@lru_cache(maxsize=2)
def encoder_of(tokenizer: str) -> Encoder:
    """One encoder a worker process, kept between tasks."""
    import public_tokenizers

    return Encoder(public_tokenizers.path(tokenizer))


def _write(folder: str, tokenizer: str, bits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = f"{base}/{uuid.uuid4().hex}.ids"  # of this attempt alone; the manifest names those that count
        encoder, n_docs, n_ids = encoder_of(tokenizer), 0, 0
        with fs.open_output_stream(name + ".part") as out:
            writer = Writer(out, bits)
            for batch in batches:
                for doc, flat in zip(batch["_id"].to_pylist(), encoder.encode(batch["_t"].to_pylist()), strict=True):
                    writer.add(doc, flat)
                    n_docs += 1
                    n_ids += len(flat)
            writer.close()
        fs.move(name + ".part", name)
        if n_docs:
            row = {"shard": TaskContext.get().partitionId(), "name": name.rsplit("/", 1)[1], "n_docs": n_docs, "n_ids": n_ids}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return run


def write_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, bits: bool = False) -> tuple[str, DataFrame]:
    """Write the ids of docs in ascending doc_id order; (folder, manifest).

    Rows are dealt by ranges of doc_id and each range streams into a file of its own, under a name of its own attempt:
    a task that runs twice leaves a file nobody reads. The manifest (shard, name, n_docs, n_ids, base; one row a file)
    gives the files' order and the ids before each.
    """
    folder = fresh_path(docs.sparkSession, "tokens")
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), text_of(text).alias("_t"))
    sorted_rows = rows.repartitionByRange(F.col("_id").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first(), "_t")
    manifest = cut(sorted_rows.mapInArrow(_write(folder, tokenizer, bits), "shard int, name string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return folder, manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for pdf in batches:
            for row in pdf.itertuples():
                with fs.open_input_file(f"{base}/{row.name}") as file:
                    reader = Reader(file)
                    for at in range(0, len(reader.counts), 4096):
                        part = slice(at, at + 4096)
                        crcs = [zlib.crc32(reader.span(int(s), int(n)).tobytes()) for s, n in zip(reader.starts[part], reader.counts[part], strict=True)]
                        ids = pd.array(reader.doc_ids[part].astype(np.int64), dtype="Int64")
                        ids[reader.nulls[part].astype(bool)] = pd.NA
                        yield pd.DataFrame({"doc_id": ids, "start": reader.starts[part] + row.base, "n_tokens": reader.counts[part], "ids_crc32": np.array(crcs, np.int64)})

    return run


def read_tokens(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    files = max(1, manifest.count())  # a task a file; left to itself Spark would put these few rows together
    return manifest.select("shard", "name", "base").repartition(files, "shard").mapInPandas(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files, read them back, and describe each document.

    Null and empty texts are the end id alone. Null ids come first; rows of one id follow by text. Repeated rows each
    have their own span. An empty table writes nothing and gives no rows. Other columns are not read.
    """
    return read_tokens(*write_tokens(docs, doc_id, text))
