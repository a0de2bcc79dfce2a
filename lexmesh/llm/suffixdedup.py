"""Exact substring deduplication: run-compressed Burrows-Wheeler indexes over passages that may repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.common import broadcast_if_small, cut, discard, text_of

#: Length of a match in bytes, and of the grams whose least hash names a window.
LENGTH = 50
GRAM = 20
#: Bytes of passages that one index holds at most, but for a few in excess; half of it on average.
INDEX_BYTES = 4 << 20
#: Windows of a passage, and of a text that are hashed at a time.
LONGEST = 2048
CHUNK = 1 << 20
#: 8-byte row numbers that a broadcast may hold; beyond that texts are shuffled unfiltered.
MAX_KEYS = 1_000_000
#: Names that a task compares among themselves before it sends them on.
HELD_NAMES = 500_000
U = np.uint64


def gram_hashes(b: np.ndarray, k: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each k bytes, by doubling."""
    with np.errstate(over="ignore"):
        power, level, have = {1: U(0x9E3779B97F4A7C15)}, {1: b.astype(U) + U(1)}, 1
        while 2 * have <= k:
            level[2 * have] = level[have][:-have] * power[have] + level[have][have:]
            power[2 * have] = power[have] * power[have]
            have *= 2
        out = level[have]
        for n in sorted(level, reverse=True):
            while have + n <= k:
                size = len(out) - n
                out = out[:size] * power[n] + level[n][have : have + size]
                have += n
        out = (out ^ (out >> U(29))) * U(0xBF58476D1CE4E5B9)
        return out ^ (out >> U(32))


def window_names(b: np.ndarray, length: int = LENGTH, k: int = GRAM) -> np.ndarray:
    """For each window of length bytes the least hash of its grams: equal windows have equal names, neighbours mostly share one."""
    low, n, width = gram_hashes(b, k), 1, length - k + 1
    while 2 * n <= width:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    if n < width:
        low = np.minimum(low[: len(low) - (width - n)], low[width - n :])
    return low


def named_runs(data: bytes, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(name, first window, windows) of the runs of windows with one name; long texts come in parts."""
    for at in range(0, max(0, len(data) - length + 1), CHUNK):
        names = window_names(np.frombuffer(data, np.uint8, min(CHUNK + length - 1, len(data) - at), at), length)
        first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
        yield names[first].astype(np.int64), first + at, np.diff(np.append(first, len(names)))


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of passages, each closed by an end mark of its own.

    Kept are arrays with an element for each run: its first row, its letter (heads), its length, the row that its first
    row maps to one letter further left, the text positions of its first and last row (sampled run ends), and the letters
    that the suffixes around its mapped border share. The sorted suffixes and the text serve the construction alone.
    """

    def __init__(self, passages: list[bytes], cap: int = LENGTH):
        sizes = np.array([len(p) + 1 for p in passages], np.int64)
        self.sizes, self.size = sizes, int(sizes.sum())
        self.owner = np.repeat(np.arange(len(passages)), sizes)
        self.ends = np.cumsum(sizes) - 1
        self.starts = self.ends - sizes + 1
        text = np.frombuffer(b"\0".join(passages) + b"\0", np.uint8).astype(np.int64) + 1
        text[self.ends] = 0
        self.text = text
        self.left = (self.ends[self.owner] - np.arange(len(text))).astype(np.int32)
        self._pack()
        order = self._order()
        before = np.where(np.isin(order, self.starts, assume_unique=True), -1, text[order - 1])
        self.first_rows = np.flatnonzero(np.append(True, (before[1:] != before[:-1]) | (before[1:] < 1)))
        self.heads = before[self.first_rows]
        self.run_lengths = np.diff(np.append(self.first_rows, len(order)))
        self.first_samples, self.last_samples = order[self.first_rows], order[np.append(self.first_rows[1:], len(order)) - 1]
        by_letter = np.argsort(self.heads, kind="stable")
        lengths = self.run_lengths[by_letter]
        self.maps_to = np.empty(len(by_letter), np.int64)
        self.maps_to[by_letter] = np.cumsum(lengths) - lengths
        # Of neighbours in by_letter with one letter, the last row of the one and the first of the other map side by side.
        self.shared = np.zeros(len(by_letter), np.int64)
        same = np.flatnonzero((self.heads[by_letter[1:]] == self.heads[by_letter[:-1]]) & (self.heads[by_letter[1:]] > 0))
        above, below = by_letter[same], by_letter[same + 1]
        self.shared[below] = self._shared(self.first_samples[below] - 1, self.last_samples[above] - 1, cap)
        del self.text, self.left, self.owner, self.packed

    def stream(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Stream all passages through the runs from their ends, a letter of each at a time.

        Gives (passage, place in it, row, letters shared with the row above). Inside a run that number grows by one with
        each letter, since the row above has the same letter before it; at the start of a run it is the run's own. It is
        right up to the cap, and at least the cap beyond.
        """
        lane = np.arange(len(self.sizes))
        row, match, step = lane, np.zeros(len(lane), np.int64), 0
        while True:
            run = np.searchsorted(self.first_rows, row, side="right") - 1
            go = self.heads[run] > 0
            if not go.all():
                lane, row, match, run = lane[go], row[go], match[go], run[go]
            if not len(lane):
                return
            step += 1
            inside = row - self.first_rows[run]
            match = np.where(inside > 0, match + 1, self.shared[run])
            row = self.maps_to[run] + inside
            yield lane, self.sizes[lane] - 1 - step, row, match

    def _pack(self) -> None:
        """For each position as many letters as one number holds, nothing from the end mark on."""
        codes = np.cumsum(np.bincount(self.text, minlength=257) > 0) - 1  # the mark is 0, the letters follow in order
        self.bits = max(1, int(codes[-1]).bit_length())
        self.letters = 62 // self.bits
        dense, n = codes[self.text], len(self.text)
        self.packed = np.zeros(n, np.int64)
        for k in range(self.letters):
            self.packed <<= self.bits
            self.packed[: n - k] |= np.where(self.left[: n - k] >= k, dense[k:], 0)

    def _order(self) -> np.ndarray:
        """Positions in the order of their suffixes, each up to its passage's end mark; the marks rank as their passages do.

        Sorted by the packed letters first, then by doubling; from round to round only positions that are still tied are
        sorted again. A rank is the first row of the tie.
        """
        n, passages, left, key = len(self.text), len(self.ends), self.left, self.packed
        order = np.argsort(key)
        sorted_key = key[order]
        fresh = np.append(True, sorted_key[1:] != sorted_key[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        depth = self.letters
        rows = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        while len(rows):
            at = order[rows]
            after = rank[np.minimum(at + depth, n - 1)]
            key = rank[at] * (n + passages + 1) + np.where(left[at] < depth, self.owner[at], passages + after)
            by = np.argsort(key)
            at, key = at[by], key[by]
            order[rows] = at
            fresh = np.append(True, key[1:] != key[:-1])
            rank[at] = rows[np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))]
            rows = rows[~(fresh & np.append(fresh[1:], True))]
            depth *= 2
        return order

    def _shared(self, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
        """How many letters the suffixes at a and b share, cap at most; end marks are never shared."""
        out, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
        n = len(self.text)
        for at in range(0, cap, self.letters):
            differ = self.packed[np.minimum(a[open_] + at, n - 1)] ^ self.packed[np.minimum(b[open_] + at, n - 1)]
            for k in range(1, self.letters + 1):
                out[open_] += differ >> self.bits * (self.letters - k) == 0
            open_ = open_[(differ == 0) & (np.minimum(self.left[a[open_]], self.left[b[open_]]) > at + self.letters)]
        return np.minimum(np.minimum(out, cap), np.minimum(self.left[a], self.left[b]))


def first_documents(passages: list[bytes], docs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, window, least document that has the window) for every window of every passage."""
    index = RunIndex(passages, length)
    begins, least = np.ones(index.size, bool), np.full(index.size, np.iinfo(np.int64).max)
    who, at, rows = [], [], []
    for lane, place, row, match in index.stream():
        begins[row] = match < length
        least[row] = docs[lane]
        whole = index.sizes[lane] - 1 - place >= length
        who.append(lane[whole])
        at.append(place[whole])
        rows.append(row[whole])
    group = np.flatnonzero(begins)  # equal windows stand together: each row but the first shares them with the row above
    best = np.minimum.reduceat(least, group)
    who, at, rows = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (who, at, rows))
    back = np.lexsort([at, who])
    return who[back], at[back], best[np.cumsum(begins)[rows[back]] - 1]


def _names(length: int):
    """(name, who) of the texts of (_rid, _t): who is 4 * _rid + 2 if the name is known to be in several of the task's texts + 1 if it is told so by another row of the task."""

    def told(names: list[np.ndarray], rids: list[int]) -> pa.RecordBatch:
        n, r = np.concatenate(names), np.repeat(np.array(rids, np.int64), [len(x) for x in names])
        order = np.argsort(n, kind="stable")
        n, r = n[order], r[order]
        first = np.append(True, n[1:] != n[:-1])
        known = ~(first & np.append(first[1:], True))
        return pa.RecordBatch.from_arrays([pa.array(n), pa.array(4 * r + 2 * known + ~first)], ["name", "who"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rids, size = [], [], 0
        for batch in batches:
            for rid, text in zip(batch["_rid"].to_pylist(), batch["_t"].to_pylist(), strict=True):
                found = [v for v, _, _ in named_runs(text.encode("utf-8", "surrogatepass"), length)]
                if found:
                    names.append(np.unique(np.concatenate(found)))
                    rids.append(rid)
                    size += len(names[-1])
                if size > HELD_NAMES:
                    yield told(names, rids)
                    names, rids, size = [], [], 0
        if size:
            yield told(names, rids)

    return run


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_rid, name) of the rows (name, who), in order of name, that are known to be shared or stand beside one of the same name."""
    last: tuple[np.ndarray, np.ndarray, bool] = (np.empty(0, np.int64), np.empty(0, np.int64), False)

    def some(n: np.ndarray, who: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
        keep = keep | (who & 2 > 0)
        return pa.RecordBatch.from_arrays([pa.array(who[keep] >> 2), pa.array(n[keep])], ["_rid", "name"])

    for batch in batches:
        if not len(batch):
            continue
        n, who = (np.append(old, batch[c].to_numpy()) for old, c in zip(last, ("name", "who"), strict=False))
        as_before = np.append(last[2], n[1:] == n[:-1])
        yield some(n[:-1], who[:-1], as_before[:-1] | as_before[1:])
        last = n[-1:], who[-1:], bool(as_before[-1])
    if len(last[0]):
        yield some(last[0], last[1], np.array([last[2]]))


PASSAGES = pa.schema([("_rid", pa.int64()), ("_doc", pa.int64()), ("name", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("passage", pa.binary())])


def _passages(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in PASSAGES]
            for rid, doc, text, wanted in zip(batch["_rid"].to_pylist(), batch["_doc"].to_pylist(), batch["_t"].to_pylist(), batch["_wanted"], strict=True):
                data, wanted = text.encode("utf-8", "surrogatepass"), np.sort(wanted.values.to_numpy(zero_copy_only=False))
                for names, first, n in named_runs(data, length):
                    spot = np.minimum(np.searchsorted(wanted, names), len(wanted) - 1)
                    for k in np.flatnonzero(wanted[spot] == names).tolist():
                        for at in range(int(first[k]), int(first[k] + n[k]), LONGEST):
                            size = min(LONGEST, int(first[k] + n[k]) - at)
                            for col, x in zip(cols, (rid, doc, int(names[k]), at, size, data[at : at + size + length - 1]), strict=True):
                                col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PASSAGES, strict=True)], schema=PASSAGES)

    return run


def _dealt(length: int):
    """Cut passages whose name has too many of them for one index: a window goes to one of _parts by its own hash, and the part makes a name of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in PASSAGES]
            for rid, doc, name, at, data, parts in zip(*(batch[c].to_pylist() for c in ("_rid", "_doc", "name", "at", "passage", "_parts")), strict=True):
                part = (gram_hashes(np.frombuffer(data, np.uint8), length) % U(parts)).astype(np.int64)
                first = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
                for i, j in zip(first, [*first[1:], len(part)], strict=True):
                    own = int(np.array([(name + 0x9E3779B97F4A7C15 * (int(part[i]) + 1)) % (1 << 64)], np.uint64).view(np.int64)[0])
                    for col, x in zip(cols, (rid, doc, own, at + i, j - i, data[i : j + length - 1]), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PASSAGES, strict=True)], schema=PASSAGES)

    return run


SPAN = pa.struct([("off", pa.int64()), ("n", pa.int64())])
VERDICTS = pa.schema([("name", pa.int64()), ("code", pa.int64()), ("first", pa.int64()), ("spans", pa.list_(SPAN))])


def _index(length: int):
    """From (bucket, name, code, first, passage), a bucket's rows together: the windows of each passage that a smaller document than its first has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.sort_by("first")
            first = rows["first"].to_numpy()
            who, at, least = first_documents(rows["passage"].to_pylist(), first, length)
            gone = least < first[who]
            who, at = who[gone], at[gone]
            start = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (at[1:] != at[:-1] + 1))) if len(who) else np.empty(0, np.int64)
            n = np.diff(np.append(start, len(who)))
            ends = np.searchsorted(who[start], np.arange(len(first) + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(at[start], pa.int64()), pa.array(n, pa.int64())], fields=list(SPAN))
            return pa.RecordBatch.from_arrays([pa.array(rows["name"].to_numpy()), pa.array(rows["code"].to_numpy()), pa.array(first), pa.ListArray.from_arrays(pa.array(ends), spans)], schema=VERDICTS)

        held, bucket = [], None
        for batch in batches:
            keys = batch["bucket"].to_numpy()
            for part in np.split(np.arange(len(keys)), np.flatnonzero(keys[1:] != keys[:-1]) + 1):
                if not len(part):
                    continue
                if bucket is not None and keys[part[0]] != bucket:
                    yield solved(pa.Table.from_batches(held))
                    held = []
                bucket = keys[part[0]]
                held.append(batch.slice(part[0], len(part)))
        if held:
            yield solved(pa.Table.from_batches(held))

    return run


REMOVED = pa.schema([("_rid", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("cut_sha256", pa.string()), ("kept", pa.binary())])


def _removed(length: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rid, text, spans in zip(batch["_rid"].to_pylist(), batch["_t"].to_pylist(), batch["_spans"], strict=True):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                at, n = (spans.values.field(k).to_numpy(zero_copy_only=False) for k in ("at", "n"))
                step = np.zeros(len(data) + 1, np.int32)
                np.add.at(step, at, 1)
                np.add.at(step, at + n + length - 1, -1)
                gone = np.cumsum(step[:-1]) > 0
                kept = data[~gone].tobytes()
                rows.append((rid, int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), hashlib.sha256(kept).hexdigest(), kept if texts else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), REMOVED, strict=True)], schema=REMOVED)

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs (with texts=True also the kept bytes).

    1. Of equal texts (by SHA-256) the first row of the least doc_id goes on; the rows of larger ids are removed whole. 2.
    Every window of 50 bytes is named by the least hash of its 20-byte grams; equal windows have one name. A task tells
    its own shared names; of each other name one row goes on, so that a crowded name costs a row a task. 3. Of names that
    several rows have, each run of windows makes a passage. If all passages of a name are equal, its windows belong to
    the least doc_id. 4. Different passages of one name go to a bucket by name, in which they are indexed (RunIndex) and
    streamed, each passage once: which of its windows has a smaller document than its first one? The passages of a name
    with more bytes than an index holds are dealt to several buckets by their windows. 5. In documents after a passage's
    first one the whole passage goes, in the first one the windows found by the index.

    Nulls and empty texts have no bytes. Rows of one doc_id never remove from each other; a null doc_id counts as the
    largest. Texts shorter than 50 bytes stay. An empty table gives no rows. Other columns are not read.
    """
    last = 2**63 - 1
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), (F.col(doc_id).isNull()).alias("_no"), F.coalesce(F.col(doc_id).cast("long"), F.lit(last)).alias("_doc"), text_of(text).alias("_t"))
    rows = cut(rows.withColumn("_sha", F.unhex(F.sha2("_t", 256))), "rows")
    texts_ = cut(rows.groupBy("_sha").agg(F.min(F.struct("_doc", "_rid")).alias("f"), F.count(F.lit(1)).alias("n")).select(F.col("_sha").alias("_of"), F.col("f._doc").alias("_least"), F.col("f._rid").alias("_rep"), "n"), "texts")
    copied = texts_.filter("n > 1").select("_of", "_rep")
    copies = rows.join(copied, F.col("_sha") == F.col("_of")).filter("_rid != _rep").select(F.col("_rid").alias("_copy"))
    reps = rows.select("_rid", "_doc", "_t").join(broadcast_if_small(cut(copies, "copies"), MAX_KEYS), F.col("_rid") == F.col("_copy"), "left_anti")
    names = reps.select("_rid", "_t").mapInArrow(_names(length), "name long, who long")
    names = names.repartition(F.when(F.col("who") % 2 == 1, F.xxhash64("who")).otherwise(F.col("name"))).sortWithinPartitions("name")
    wanted = names.mapInArrow(_several, "_rid long, name long").groupBy("_rid").agg(F.collect_list("name").alias("_wanted")).withColumnRenamed("_rid", "_w")
    wanted = cut(wanted, "wanted")

    def of(some: DataFrame, key: str) -> DataFrame:
        """The rows that some has, before they are shuffled to meet it."""
        return reps.join(broadcast_if_small(some.select(F.col(key).alias("_s")), MAX_KEYS), F.col("_rid") == F.col("_s"), "left_semi")

    picked = of(wanted, "_w").join(wanted, F.col("_rid") == F.col("_w")).select("_rid", "_doc", "_t", "_wanted")
    kinds = "_rid long, _doc long, name long, at long, n int, passage binary"
    found = cut(picked.mapInArrow(_passages(length), kinds).withColumn("code", F.xxhash64("passage")), "passages")
    discard(wanted)
    by_name = cut(found.groupBy("name").agg(F.min("code").alias("c"), F.max("code").alias("d"), F.min("_doc").alias("least")).select(F.col("name").alias("_n"), "least", (F.col("c") != F.col("d")).alias("differ")), "names")
    alike = found.select("_rid", "_doc", "name", "at", F.col("n").cast("long").alias("n")).join(by_name.filter("not differ"), F.col("name") == F.col("_n"))
    alike = cut(alike.filter(F.col("least") < F.col("_doc")).select("_rid", "at", "n"), "alike")
    mixed = found.join(broadcast_if_small(by_name.filter("differ").select("_n"), MAX_KEYS), F.col("name") == F.col("_n"), "left_semi")
    unique = cut(_different(mixed), "unique")
    sizes = unique.groupBy(F.col("name").alias("_n")).agg(F.sum(F.length("passage")).alias("bytes"), F.sum("n").alias("windows")).filter(F.col("bytes") > INDEX_BYTES)
    large = cut(sizes.select("_n", F.ceil(F.col("windows") * length / INDEX_BYTES).alias("_parts")), "large")
    if large.limit(1).count():
        pieces = mixed.join(large, F.col("name") == F.col("_n")).select("_rid", "_doc", "name", "at", "passage", "_parts").mapInArrow(_dealt(length), kinds)
        whole = mixed.join(large, F.col("name") == F.col("_n"), "left_anti")
        mixed = cut(whole.unionByName(pieces.withColumn("code", F.xxhash64("passage"))), "pieces")
        unique = cut(_different(mixed), "unique")
    total = unique.agg(F.sum(F.length("passage") + 1)).first()[0] or 0
    buckets = max(1, -(-total // INDEX_BYTES)) * 2
    dealt = unique.select(F.pmod(F.xxhash64("name"), F.lit(buckets)).cast("int").alias("bucket"), "name", "code", "first", "passage")
    spans = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_index(length), "name long, code long, first long, spans array<struct<off:long,n:long>>")
    spans = cut(spans.withColumnsRenamed({"name": "_vn", "code": "_vc"}), "verdicts")
    placed = mixed.drop("passage").join(spans, (F.col("name") == F.col("_vn")) & (F.col("code") == F.col("_vc")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("off"), F.col("n").cast("long").alias("n")))
    gone = placed.select("_rid", "at", F.inline(F.when(F.col("first") < F.col("_doc"), whole).otherwise(F.col("spans"))).alias("_off", "_size"))
    gone = gone.select("_rid", (F.col("at") + F.col("_off")).alias("at"), F.col("_size").alias("n"))
    listed = cut(alike.unionByName(gone).groupBy("_rid").agg(F.collect_list(F.struct("at", "n")).alias("_spans")).withColumnRenamed("_rid", "_g"), "spans")
    for done in (found, unique, alike, spans):
        discard(done)
    changed = of(listed, "_g").join(listed, F.col("_rid") == F.col("_g")).select("_rid", "_t", "_spans").mapInArrow(_removed(length, texts), "_rid long, n_removed long, n_spans long, cut_sha256 string, kept binary").withColumnRenamed("_rid", "_c")
    zero = F.lit(0).cast("long")
    each = rows.select("_doc", F.when(~F.col("_no"), F.col("_doc")).alias("_id"), "_sha", F.octet_length("_t").cast("long").alias("n_bytes"), *([F.encode("_t", "UTF-8").alias("_whole")] if texts else []))
    out = each.join(texts_.drop("n"), F.col("_sha") == F.col("_of")).join(changed, F.col("_rep") == F.col("_c"), "left")
    out = out.withColumn("_all", (F.col("_least") < F.col("_doc")) & (F.col("n_bytes") >= length))
    columns = [
        F.col("_id").alias("doc_id"),
        "n_bytes",
        F.when(F.col("_all"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(F.col("_all"), F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(F.col("_all"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha256", F.lower(F.hex("_sha")))).alias("kept_sha256"),
    ]
    return out.select(*columns, *([F.when(F.col("_all"), F.encode(F.lit(""), "UTF-8")).otherwise(F.coalesce("kept", "_whole")).alias("kept")] if texts else []))


def _different(found: DataFrame) -> DataFrame:
    """(name, code, first, n, passage): the different passages of each name, with the least document of each."""
    return found.groupBy("name", "code").agg(F.min("_doc").alias("first"), F.min("n").alias("n"), F.first("passage").alias("passage"))
