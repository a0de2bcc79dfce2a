"""A gated recurrent language model in numpy: class-factored output, truncated backpropagation, state carried through documents."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.common import cut, text_of

#: The word that ends a document; no real word is empty.
END = b""
#: Words that are symbols of the model by themselves, most frequent first. Every other word is a symbol together with those
#: whose ends hash alike, so that the network reads and predicts all of a text; within a symbol words share by their counts.
MODEL_WORDS = 1100
BINS = 344
ENDING = 3
#: Training tokens of a shard, and shards at most: what a task learns from follows from the documents' ids alone.
SHARD_TOKENS, MAX_SHARDS = 2_000_000, 4096
#: Words whose counts are sent to every task at most (about 2 MB); counts of the others are joined.
SENT_WORDS = 60_000
UNITS = 16
LANES = 512
STEPS = 32
#: Places (lanes by steps) up to which a window's classes are worked on side by side, and what its steps don't hand on at once.
THIN = 4096
RATE = 0.01
CLIP = 5.0
#: Shares of the training documents in each round; between rounds the models of all tasks are averaged.
ROUNDS = (0.1, 0.3, 0.6)
#: Characters of the texts that a task sorts by length at a time.
PART_CHARS = 1 << 24
#: Characters of the texts whose words are looked up together.
READ_CHARS = 1 << 22
WEIGHT = 0.1


def words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in A-Z lower case, split at space and \\t to \\r, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    flat, ends = lists.values.cast(pa.large_binary()), lists.offsets.to_numpy()
    some = pc.greater(pc.binary_length(flat), 0)  # blanks at a text's ends leave an empty one
    before = np.append(0, np.cumsum(some.to_numpy(zero_copy_only=False)))
    return flat.filter(some), np.diff(before[ends])


def parts_of(texts: list[str], chars: int = PART_CHARS) -> Iterator[list[str]]:
    """The texts in parts of so many characters, or a little more."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size < chars:
            size += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def bin_of(word: bytes) -> int:
    """The shared symbol of a word, by its last letters."""
    return zlib.crc32(word[-ENDING:]) % BINS


@dataclass
class Vocabulary:
    """The words sent to every task: ids from 1 on by falling count. Symbols of the model: 0 to BINS - 1 are shared, the first words follow."""

    ids: dict[bytes, int]
    counts: np.ndarray  # of ids, [0] is what is not sent
    n: int  # tokens
    v: int  # distinct tokens
    shared: np.ndarray  # (tokens, distinct tokens) of each shared symbol
    own: int  # words that are symbols by themselves

    @property
    def size(self) -> int:
        return BINS + min(len(self.ids), self.own)

    @property
    def end(self) -> int:
        return self.symbol(END)

    def symbol(self, word: bytes) -> int:
        at = self.ids.get(word, 0)
        return BINS + at - 1 if 0 < at <= self.own else bin_of(word)

    def counts_of_model(self) -> np.ndarray:
        """Counts of the model's symbols."""
        return np.concatenate([self.shared[:, 0], self.counts[1 : self.size - BINS + 1]])

    def shares(self) -> np.ndarray:
        """log10 of what (count + WEIGHT) sums to over the words of each symbol, its unseen words counting as one word; 0 for a word by itself."""
        return np.append(np.log10(self.shared[:, 0] + WEIGHT * (self.shared[:, 1] + 1)), np.zeros(self.size - BINS))


#: What crc32 adds for each value of a byte.
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = CRC >> np.uint32(1) ^ (CRC & np.uint32(1)) * np.uint32(0xEDB88320)


def bins_of(flat: pa.Array) -> np.ndarray:
    """bin_of each word."""
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data, sizes, ends = np.frombuffer(flat.buffers()[2] or b"", np.uint8), np.diff(ends), ends[1:]
    crc = np.full(len(flat), 0xFFFFFFFF, np.uint32)
    for k in range(ENDING, 0, -1):
        there = np.flatnonzero(sizes >= k)
        own = crc[there]
        crc[there] = CRC[(own ^ data[ends[there] - k]) & np.uint32(255)] ^ (own >> np.uint32(8))
    return (~crc % np.uint32(BINS)).astype(np.int32)


class Known:
    """Ids and symbols of words; only the words sent are held."""

    def __init__(self, vocabulary: Vocabulary):
        self.sent, self.end = pa.array(list(vocabulary.ids), pa.large_binary()), (vocabulary.ids.get(END, 0), vocabulary.end)
        self.ids = np.array([0, *vocabulary.ids.values()], np.int32)
        own = self.ids[1:]
        self.symbols = np.append(0, np.where(own <= vocabulary.own, BINS + own - 1, bins_of(self.sent))).astype(np.int32)

    def read(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
        """The ids and symbols of each text's tokens, and its words that are not sent."""
        for part in parts_of(texts, READ_CHARS):
            flat, counts = words(part)
            at = pc.index_in(flat, value_set=self.sent).fill_null(-1).to_numpy() + 1
            own, rest = self.symbols[at], np.flatnonzero(at == 0)
            rare = flat.take(pa.array(rest))
            own[rest] = bins_of(rare)
            stops = np.cumsum(counts + 1)
            ids, symbols, word = np.full(stops[-1], self.end[0], np.int32), np.full(stops[-1], self.end[1], np.int32), np.ones(stops[-1], bool)
            word[stops - 1] = False
            ids[word], symbols[word] = self.ids[at], own
            rare, rares = rare.to_pylist(), np.searchsorted(rest, np.append(0, np.cumsum(counts))).tolist()
            first = 0
            for k, stop in enumerate(stops.tolist()):
                yield ids[first:stop], symbols[first:stop], rare[rares[k] : rares[k + 1]] + [END] * (self.end[0] == 0)
                first = stop


def rows_of(n: int, length: int) -> np.ndarray:
    """n rows of numbers not yet set. A power of two between rows would bring them all to one place of the cache."""
    return np.empty((n, length + 16), np.float32)[:, :length]


class Model:
    """One layer of gated recurrent units. Words are dealt to classes of about equal size by frequency."""

    def __init__(self, size: int, units: int = UNITS, seed: int = 7):
        self.size, self.units = size, units
        self.width = max(1, math.ceil(math.sqrt(size)))
        self.classes = math.ceil(size / self.width)
        g, h = np.random.default_rng(seed), units
        self.shapes = {"E": (size, h), "Wx": (h, 3 * h), "Wh": (h, 3 * h), "b": (3 * h,), "Wc": (h, self.classes), "bc": (self.classes,), "Wo": (self.classes * self.width, h), "bo": (self.classes * self.width,)}
        self.p = {k: (g.standard_normal(s) * (0.1 if k in ("E", "Wo", "Wc") else 1 / math.sqrt(h)) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in self.shapes.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.shapes])

    def load(self, flat: np.ndarray) -> Model:
        return self.share(flat.astype(np.float32))

    def share(self, flat: np.ndarray) -> Model:
        """Take the parameters that stand in flat, which goes on to hold them."""
        at = 0
        for k, s in self.shapes.items():
            n = int(np.prod(s))
            self.p[k] = flat[at : at + n].reshape(s)
            at += n
        return self

    def start(self, counts: np.ndarray) -> Model:
        """Output biases at the log frequencies: before training the model is the unigram one."""
        logs = np.log(np.maximum(counts[: self.size], 0) + 0.5).astype(np.float32)
        bo = np.full(self.classes * self.width, -30, np.float32)
        bo[: self.size] = logs
        top = bo.reshape(self.classes, self.width)
        self.p["bo"] = bo
        self.p["bc"] = (np.log(np.exp(top - top.max()).sum(axis=1)) + top.max()).astype(np.float32)
        return self

    def window(self, x, y, fresh, live, h, learn: bool):
        """Run a window (steps x lanes). Returns natural log probabilities, the state after it and gradients if learning.

        Arrays have a row for each unit, so that operations run along lanes, and what a step or a class works on stays in
        a core's cache.
        """
        p, n = self.p, self.units
        steps, lanes = x.shape
        if x.size <= THIN and live.any():
            return self.thin(x, y, fresh, live, h, learn)
        x, h = np.ascontiguousarray(x, np.intp), np.ascontiguousarray(h.T)
        sign = np.repeat(np.float32([-1, 1]), (2 * n, n))[:, None]  # for exp(-x) of the gates
        wh, wx = np.ascontiguousarray(p["Wh"].T) * sign, np.ascontiguousarray((p["E"] @ p["Wx"] + p["b"]).T) * sign
        hs, keep = rows_of(n + 1, steps * lanes), []
        hs[n] = 1
        starts = fresh.any(axis=1)
        for t in range(steps):
            if starts[t]:
                h = h * (1 - fresh[t])
            gh, own = wh @ h, np.take(wx, x[t], axis=1, mode="clip")
            zr, ghc = gh[: 2 * n], gh[2 * n :]
            zr += own[: 2 * n]
            np.minimum(zr, np.float32(80), out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:n], zr[n:]
            c = r * ghc
            c += own[2 * n :]
            np.tanh(c, out=c)
            if learn:
                keep.append((h, z, r, c, ghc))
            h = h - c
            h *= z
            h += c
            hs[:n, t * lanes : (t + 1) * lanes] = h
        where, wanted = np.flatnonzero(live.ravel()), y.ravel()
        cls = (wanted[where] // self.width).astype(np.int16)
        order = np.argsort(cls, kind="stable")
        place = where[order]  # from here on by class
        ho, inner = np.take(hs, place, axis=1, mode="clip"), wanted[place] % self.width
        bound = np.searchsorted(cls[order], np.arange(self.classes + 1)).tolist()
        at, logp = np.arange(max(np.diff(bound))), np.empty(len(place), np.float32)
        grads = {k: np.zeros(s, np.float32) for k, s in self.shapes.items()} if learn else None
        both = np.empty((self.classes + self.width, n + 1), np.float32)  # weights and biases of the classes, and of a class's words
        both[: self.classes, :n], both[: self.classes, n] = p["Wc"].T, p["bc"]
        ones, some = np.ones(len(both), np.float32), np.empty(len(both) * len(at), np.float32)
        gc, dh = np.zeros((self.classes, n + 1), np.float32), rows_of(n, len(place)) if learn else None
        for k in range(self.classes):
            lo, hi = bound[k], bound[k + 1]
            if lo == hi:
                continue
            part, hk = slice(k * self.width, (k + 1) * self.width), ho[:, lo:hi]
            both[self.classes :, :n], both[self.classes :, n] = p["Wo"][part], p["bo"][part]
            e = np.matmul(both, hk, out=some[: len(both) * (hi - lo)].reshape(len(both), hi - lo))
            top, low = e[: self.classes], e[self.classes :]
            top -= top.max()  # one shift for all columns: their largest numbers are much closer than a float's range
            low -= low.max()
            ik = inner[lo:hi], at[: hi - lo]
            own = logp[lo:hi]
            np.add(top[k], low[ik], out=own)
            np.exp(e, out=e)
            tops, lows = (np.maximum(ones[: len(part_)] @ part_, np.float32(1e-37)) for part_ in (top, low))
            own -= np.log(tops)
            own -= np.log(lows)
            if learn:
                top *= 1 / tops
                low *= 1 / lows
                top[k] -= 1
                low[ik] -= 1
                g = e @ hk.T
                gc += g[: self.classes]
                grads["Wo"][part], grads["bo"][part] = g[self.classes :, :n], g[self.classes :, n]
                dh[:, lo:hi] = both[:, :n].T @ e
        if learn and len(where):
            scale = np.float32(1 / len(where))
            grads["Wc"], grads["bc"] = gc[:, :n].T, gc[:, n]
            for k in ("Wc", "bc", "Wo", "bo"):
                grads[k] = grads[k] * scale
            dh *= scale
            dhs, dx = rows_of(n, steps * lanes), rows_of(n, steps * lanes)
            dhs[:] = 0
            dhs[:, place] = dh
            back, dgh, dgx = np.zeros((n, lanes), np.float32), np.empty((3 * n, lanes), np.float32), np.empty((3 * n, lanes), np.float32)
            embedded, each = np.ascontiguousarray(p["E"].T), np.ones(lanes, np.float32)
            dz, dr, dc = dgx[:n], dgx[n : 2 * n], dgx[2 * n :]
            for t in reversed(range(steps)):
                before, z, r, c, ghc = keep[t]
                at = slice(t * lanes, (t + 1) * lanes)
                d = dhs[:, at] + back
                open_ = 1 - z
                np.multiply(c, c, out=dc)
                np.subtract(1, dc, out=dc)
                open_ *= d
                dc *= open_
                np.subtract(before, c, out=dz)
                dz *= open_
                dz *= z
                np.subtract(1, r, out=dr)
                dr *= r
                dr *= ghc
                dr *= dc
                dgh[: 2 * n] = dgx[: 2 * n]
                np.multiply(dc, r, out=dgh[2 * n :])
                grads["Wh"] += before @ dgh.T
                grads["Wx"] += np.take(embedded, x[t], axis=1, mode="clip") @ dgx.T
                grads["b"] += dgx @ each
                dx[:, at] = p["Wx"] @ dgx
                d *= z
                back = p["Wh"] @ dgh
                back += d
                if starts[t]:
                    back *= 1 - fresh[t]
            for j in range(n):
                grads["E"][:, j] = np.bincount(x.ravel(), dx[j], minlength=self.size)
        out = np.empty_like(logp)
        out[order] = logp
        return out, where, h.T, grads

    def thin(self, x, y, fresh, live, h, learn: bool):
        """The same of a window of few places, where the time goes by the calls: few are made, on all classes and steps.

        What only few long documents are left for would else cost a task more than all the others.
        """
        p, n = self.p, self.units
        steps, lanes = x.shape
        x = np.ascontiguousarray(x, np.intp).ravel()
        by_step = lambda a: np.ascontiguousarray(a.reshape(steps, lanes, -1).transpose(0, 2, 1))
        by_unit = lambda a: a.transpose(1, 0, 2).reshape(a.shape[1], -1)
        sign = np.repeat(np.float32([-1, 1]), (2 * n, n))  # for exp(-x) of the gates
        embedded, wh = p["E"][x], np.ascontiguousarray((p["Wh"] * sign).T)
        gx, gh, hs = by_step((embedded @ p["Wx"] + p["b"]) * sign), np.empty((steps, 3 * n, lanes), np.float32), np.empty((steps + 1, n, lanes), np.float32)
        gates, z, r, c, ghc = gx[:, : 2 * n], gx[:, :n], gx[:, n : 2 * n], gx[:, 2 * n :], gh[:, 2 * n :]
        hs[0] = h.T
        starts, some = fresh.any(axis=1).tolist(), np.empty((n, lanes), np.float32)
        for t in range(steps):
            before, after, zr, ct = hs[t], hs[t + 1], gates[t], c[t]
            if starts[t]:
                before = before * (1 - fresh[t])
            np.matmul(wh, before, out=gh[t])
            zr += gh[t, : 2 * n]
            np.minimum(zr, np.float32(80), out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            np.multiply(r[t], ghc[t], out=some)
            ct += some
            np.tanh(ct, out=ct)
            np.subtract(before, ct, out=after)
            after *= z[t]
            after += ct
        where, wanted = np.flatnonzero(live.ravel()), y.ravel()
        cls = (wanted[where] // self.width).astype(np.int16)
        order = np.argsort(cls, kind="stable")
        place, k = where[order], cls[order].astype(np.intp)  # from here on by class
        each, at = np.bincount(k, minlength=self.classes), np.arange(len(place))
        ho, inner, col = by_unit(hs[1:])[:, place], wanted[place] % self.width, at - (np.cumsum(each) - each)[k]
        wo, padded = p["Wo"].reshape(self.classes, self.width, n), np.zeros((self.classes, n, each.max()), np.float32)
        padded[k, :, col] = ho.T
        top, low = p["Wc"].T @ ho, wo @ padded
        top += p["bc"][:, None]
        low += p["bo"].reshape(self.classes, self.width, 1)
        top -= top.max()
        low -= low.max(axis=(1, 2), keepdims=True)
        logp = top[k, at] + low[k, inner, col]
        np.exp(top, out=top)
        np.exp(low, out=low)
        tops, lows = np.maximum(top.sum(axis=0), np.float32(1e-37)), np.maximum(low.sum(axis=1)[k, col], np.float32(1e-37))
        logp -= np.log(tops)
        logp -= np.log(lows)
        grads = None
        if learn:
            scale, own = np.float32(1 / len(where)), np.zeros((self.classes, 1, padded.shape[2]), np.float32)
            own[k, 0, col] = scale / lows
            top *= scale / tops
            low *= own  # nothing where no place is
            top[k, at] -= scale
            low[k, inner, col] -= scale
            dh = np.zeros((steps * lanes, n), np.float32)
            dh[place] = (wo.transpose(0, 2, 1) @ low)[k, :, col] + (p["Wc"] @ top).T
            dh = by_step(dh)
            open_, begun = 1 - z, hs[:-1] * (1 - fresh[:, None])
            dgx = np.empty((steps, 3 * n, lanes), np.float32)
            dgx[:, :n] = (begun - c) * open_ * z
            dgx[:, 2 * n :] = open_ * (1 - c * c)
            dgx[:, n : 2 * n] = dgx[:, 2 * n :] * (1 - r) * r * ghc
            dgh = dgx.copy()
            dgh[:, 2 * n :] *= r
            split, back = dgh.reshape(steps, 3, n, lanes), np.zeros((n, lanes), np.float32)
            for t in reversed(range(steps)):
                d = dh[t]
                d += back
                split[t] *= d
                np.matmul(p["Wh"], dgh[t], out=back)
                np.multiply(z[t], d, out=some)
                back += some
                if starts[t]:
                    back *= 1 - fresh[t]
            dgx.reshape(steps, 3, n, lanes)[:] *= dh[:, None]
            dgx, dgh = by_unit(dgx), by_unit(dgh)
            numbers = (x[:, None] * n + np.arange(n)).ravel()
            grads = {
                "E": np.bincount(numbers, (p["Wx"] @ dgx).T.ravel(), self.size * n).reshape(self.size, n).astype(np.float32),
                "Wx": (dgx @ embedded).T,
                "Wh": by_unit(begun) @ dgh.T,
                "b": dgx.sum(axis=1),
                "Wc": ho @ top.T,
                "bc": top.sum(axis=1),
                "Wo": (low @ padded.transpose(0, 2, 1)).reshape(-1, n),
                "bo": low.sum(axis=2).ravel(),
            }
        out = np.empty_like(logp)
        out[order] = logp
        return out, where, hs[steps].T, grads


class Lanes:
    """Feeds documents to a model in windows; lane k goes on with its document in the next window, so state is carried."""

    def __init__(self, docs: Iterator[tuple[object, np.ndarray]], end: int, lanes: int = LANES, steps: int = STEPS):
        self.docs, self.end, self.lanes, self.steps = docs, end, lanes, steps

    def windows(self):
        """(x, y, fresh, live, number of the document of each place, documents begun and ended, lanes in use).

        When no document is left to begin, only lanes still in use go on, so that one long text costs one lane.
        """
        at: list[list] = [[None, 0, -1] for _ in range(self.lanes)]  # ids, place, number
        number, empty, used = 0, False, np.arange(self.lanes)
        while True:
            if empty:
                used = np.array([k for k in used if at[k][0] is not None], np.int64)
            if not len(used):
                return
            shape = (len(used), self.steps)
            x, y, doc = np.full(shape, self.end, np.int32), np.zeros(shape, np.int32), np.full(shape, -1, np.int64)
            fresh = np.zeros(shape, np.float32)
            begun, ended = [], []
            for row, k in enumerate(used):
                lane, col = at[k], 0
                while col < self.steps:
                    if lane[0] is None:
                        nxt = None if empty else next(self.docs, None)
                        if nxt is None:
                            empty = True
                            break
                        lane[:] = [nxt[1], 0, number]
                        begun.append((number, nxt[0]))
                        number += 1
                    ids, place, own = lane
                    n = min(self.steps - col, len(ids) - place)
                    y[row, col : col + n] = ids[place : place + n]
                    if place:
                        x[row, col] = ids[place - 1]
                    else:
                        fresh[row, col] = 1
                    doc[row, col : col + n] = own
                    col += n
                    lane[1] = place + n
                    if lane[1] == len(ids):
                        ended.append(own)
                        lane[0] = None
            live = doc >= 0
            follows = np.flatnonzero(live[:, 1:] & (fresh[:, 1:] == 0))
            follows += follows // (self.steps - 1)  # as places of the whole rows
            x.ravel()[follows + 1] = y.ravel()[follows]
            if live.any():
                yield x.T, y.T, fresh.T, live.T, doc.T, begun, ended, used


def train(model: Model, docs: Iterator[tuple[object, np.ndarray]], end: int) -> int:
    """One pass with Adam over the documents' ids; the number of tokens learnt from."""
    flat, step, seen = model.flat(), 0, 0
    model.share(flat)
    mean, var, by = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
    h = np.zeros((LANES, model.units), np.float32)
    for x, y, fresh, live, _, _, _, used in Lanes(docs, end).windows():
        logp, _, h[used], grads = model.window(x, y, fresh, live, h[used], True)
        seen += len(logp)
        step += 1
        g = np.concatenate([grads[k].ravel() for k in model.shapes])
        norm = math.sqrt(float(g @ g))
        g *= np.float32(min(1.0, CLIP / max(norm, 1e-12)))
        rate = RATE * math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        np.subtract(g, mean, out=by)
        by *= np.float32(0.1)
        mean += by
        g *= g
        g -= var
        g *= np.float32(0.001)
        var += g
        np.sqrt(var, out=by)
        by += np.float32(1e-8)
        np.divide(mean, by, out=by)
        by *= np.float32(rate)
        flat -= by
    return seen


def score(model: Model, docs: Iterator[tuple[object, np.ndarray]], end: int) -> Iterator[tuple[object, float]]:
    """(key, log10 probability of the ids) of each document, as they end."""
    h, sums, keys = np.zeros((LANES, model.units), np.float32), np.zeros(LANES), {}
    for x, y, fresh, live, doc, begun, ended, used in Lanes(docs, end, LANES, 2 * STEPS).windows():
        logp, where, h[used], _ = model.window(x, y, fresh, live, h[used], False)
        keys.update(begun)
        own = doc.ravel()[where]
        low, high = own.min(), own.max() + 1
        if high > len(sums):
            sums = np.append(sums, np.zeros(high))
        sums[low:high] += np.bincount(own - low, logp)
        for d in ended:
            yield keys.pop(d), float(sums[d]) / math.log(10)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of this partition's tokens, counted within parts."""
    for batch in batches:
        for part in parts_of(batch["_t"].to_pylist()):
            each = words(part)[0].value_counts()
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([each.field(0).cast(pa.binary()), pa.array([END], pa.binary())]), pa.concat_arrays([each.field(1), pa.array([len(part)], pa.int64())])], ["word", "n"])


def count_words(train_rows: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """(word, n) over all training documents, and the vocabulary that goes to every task.

    The driver gets a histogram of at most some thousand rows, the BINS sums of the shared symbols, and the words of a
    count that SENT_WORDS words at most reach; words of the next lower class of counts are joined like all rarer ones.
    """
    counts = cut(train_rows.select("_t").mapInArrow(_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    level = F.floor(F.log2(F.col("n").cast("double")) * 32).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).collect()
    least, held = 1 << 30, 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        held += r["v"]
        if held > SENT_WORDS:
            break
        least = r["level"]
    top = sorted(((r["n"], bytes(r["word"])) for r in counts.filter(level >= least).collect()), key=lambda r: (-r[0], r[1]))
    ids = {w: i for i, (_, w) in enumerate(top, 1)}
    shared = np.zeros((BINS, 2))
    ending = F.expr(f"pmod(crc32(substring(word, greatest(1, octet_length(word) - {ENDING - 1}), {ENDING})), {BINS})").cast("int")
    for r in counts.groupBy(ending.alias("b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        shared[r["b"]] = r["n"], r["v"]
    for n, w in top[:MODEL_WORDS]:  # these are symbols by themselves
        shared[bin_of(w)] -= n, 1
    return counts, Vocabulary(ids, np.array([0, *(n for n, _ in top)], np.int64), sum(r["n"] for r in levels), sum(r["v"] for r in levels), shared, MODEL_WORDS)


def _train(shared, flat: np.ndarray):
    """An Arrow function that learns from the texts of (_shard, _t), a shard's rows together; longer texts of a part begin first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        known, model, shard, seen = Known(vocabulary), None, None, 0
        texts, size = [], 0

        def learn() -> int:
            symbols = ((None, own) for _, own, _ in known.read(sorted(texts, key=len, reverse=True)))
            return train(model, symbols, vocabulary.end)

        for batch in batches:
            for own, text in zip(batch["_shard"].to_pylist(), batch["_t"].to_pylist(), strict=True):
                if texts and (own != shard or size > PART_CHARS):
                    seen += learn()
                    texts, size = [], 0
                if own != shard:
                    if seen:
                        yield _weighed(shard, seen, model.flat().astype(np.float64) * seen)
                    model, shard, seen = Model(vocabulary.size).load(flat), own, 0
                texts.append(text)
                size += len(text)
        if texts:
            seen += learn()
            yield _weighed(shard, seen, model.flat().astype(np.float64) * seen)

    return run


def _weighed(shard: int, seen: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([seen], pa.int64()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["shard", "seen", "total"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows, which come in order of shard."""
    first, seen, total = 0, 0, None
    for batch in batches:
        for shard, n, raw in zip(*(batch[c].to_pylist() for c in ("shard", "seen", "total")), strict=True):
            part = np.frombuffer(raw, np.float32).astype(np.float64)
            first = shard if total is None else first
            seen, total = seen + n, part if total is None else total + part
    if seen:
        yield _weighed(first, seen, total)


def fit(train_rows: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """The model's parameters after one pass over all training documents (_id, _t, _round in [0, 1), _crc).

    Documents are dealt to shards by the crc32 of their ids, their number following from the tokens. Each round takes its
    share of the documents; every shard is learnt from in order of (id, text) starting at the same parameters, and the
    results are averaged by tokens: sums of a square root of the shards each, then of those, one row to the driver. So
    the result is the same however the table is partitioned.
    """
    spark = train_rows.sparkSession
    flat, low = Model(vocabulary.size).start(vocabulary.counts_of_model()).flat(), 0.0
    shared = spark.sparkContext.broadcast(vocabulary)
    shards = max(1, min(MAX_SHARDS, -(-vocabulary.n // SHARD_TOKENS)))
    groups, kinds = max(1, math.isqrt(shards)), "shard long, seen long, total binary"
    for share in ROUNDS:
        part = train_rows.filter((F.col("_round") >= low) & (F.col("_round") < low + share + 1e-9)).select((F.floor(F.col("_crc") / 10000) % shards).alias("_shard"), "_id", "_t")
        low += share
        models = part.repartitionById(shards, F.col("_shard").cast("int")).sortWithinPartitions("_shard", "_id", "_t").select("_shard", "_t").mapInArrow(_train(shared, flat), kinds)
        models = models.repartition(groups, F.col("shard") % groups).sortWithinPartitions("shard").mapInArrow(_add, kinds)
        got = models.repartition(1).sortWithinPartitions("shard").mapInArrow(_add, kinds).collect()
        if got:
            flat = (np.frombuffer(got[0]["total"], np.float32) / got[0]["seen"]).astype(np.float32)
    return flat


OUT = pa.schema([("_rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_sent", pa.int64()), ("base_sent", pa.float64()), ("model", pa.float64()), ("rare", pa.list_(pa.binary()))])


def _score(shared, flat: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary = shared.value
        model, known = Model(vocabulary.size).load(flat), Known(vocabulary)
        logs, shares = np.log10(vocabulary.counts + WEIGHT), vocabulary.shares()
        logs[0] = 0  # what is not sent

        def docs():
            for b in batches:
                rows = sorted(zip(*(b[c].to_pylist() for c in ("_rid", "_id", "held_out", "_t")), strict=True), key=lambda r: len(r[3]), reverse=True)  # long texts begin first
                for (rid, doc, out, _), (ids, symbols, rare) in zip(rows, known.read([r[3] for r in rows]), strict=True):
                    # Words of a shared symbol have its probability times their share; counts of those not sent are joined later.
                    base = logs[ids]
                    inside = base[symbols < BINS].sum() - shares[symbols].sum()
                    row = [rid, doc, out, len(ids), len(ids) - len(rare), float(base.sum()), float(inside), rare]
                    yield row, symbols

        held, n = [], 0
        for row, s in score(model, docs(), vocabulary.end):
            row[6] += s
            held.append(row)
            n += row[3]
            if n > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), OUT, strict=True)], schema=OUT)
                held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), OUT, strict=True)], schema=OUT)

    return run


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    score: the model's log10 probability of the whole text; a word of a shared symbol has the symbol's probability times
    its share (count + 0.1) among the symbol's words, unseen ones counting as one. A document is held out if crc32 of its id as
    text is divisible by 10; a null id counts as the empty text (crc32 0), so it is held out. Null and empty texts are
    the end token alone. Repeated rows each count and each give a row. Without training documents both scores rest on
    counts of zero. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    crc = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), F.col(doc_id).cast("long").alias("_id"), (crc % 10 == 0).alias("held_out"), (F.pmod(F.floor(crc / 10), F.lit(1000)) / 1000).alias("_round"), crc.alias("_crc"), text_of(text).alias("_t"))
    counts, vocabulary = count_words(rows.filter("not held_out"))
    flat = fit(rows.filter("not held_out"), vocabulary)
    scored = cut(rows.select("_rid", "_id", "held_out", "_t").mapInArrow(_score(spark.sparkContext.broadcast(vocabulary), flat), "_rid long, doc_id long, held_out boolean, n_tokens long, n_sent long, base_sent double, model double, rare array<binary>"), "scored")
    # Words that are not sent seldom recur in a text, so counting them by text first would shuffle them twice to save little.
    c = F.coalesce("n", F.lit(0))
    rare = scored.select("_rid", F.explode("rare").alias("word")).join(counts, "word", "left")
    tail = rare.groupBy("_rid").agg(F.sum(F.log10(c + WEIGHT)).alias("rare_sum"), F.sum((c > 0).cast("long")).alias("rare_known"))
    out = scored.drop("rare").join(tail, "_rid", "left")
    rare_sum = F.coalesce("rare_sum", F.lit(0.0))
    below = math.log10(vocabulary.n + WEIGHT * (vocabulary.v + 1))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_sent") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        (F.col("base_sent") + rare_sum - F.col("n_tokens") * below).alias("base_score"),
        (F.col("model") + rare_sum).alias("score"),
    )
