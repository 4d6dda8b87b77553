"""Blocks of token ids in an adaptive context-mixing range coder.

A block is coded as many interleaved streams that share one model, so numpy
takes one step of all streams at a time.  The model holds the last id seen
after the last two ids (order 2) and after the last id (order 1), each with a
confidence, and adaptive counts of ids (order 0).  For each state of the two
confidences, adaptive weights mix three ways of coding: the order-2 guess, the
order-1 guess, or the id by order-0 counts.  The model stands still for a
round of steps and then learns from all ids of the round at once; the coder,
which knows them before, looks everything up at once, too.  Every block starts
from an empty model and carries a checksum, so blocks decode on their own.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMR2"
U = np.uint64
STREAMS, STEPS = 2048, 512
ORDER2 = 1 << 18
ROUND = 16  # steps between two looks at what was seen
GAIN = 24
MIX, SHARE = 12, 20  # bits of the totals of the parts and of the order-0 shares
_HEAD = struct.Struct("<4sIIIII")
LOW32, WORD = U(0xFFFFFFFF), U(32)
#: What is added to a guess and its confidence (0 to 3, in the two low bits), by twice the confidence and 1 if it was right.
FOLLOWS = np.array([0, 1, -1, 1, -1, 1, -2, 0], np.int32)


class Model:
    """Predictions for a round of steps of all streams; coder and decoder keep equal ones."""

    def __init__(self, vocabulary: int):
        self.first, self.second = np.zeros(vocabulary, np.int32), np.zeros(ORDER2, np.int32)
        self.counts = np.ones(vocabulary, np.int64)
        self.weights = np.tile(np.array([4, 4, 8], np.int64), (32, 1))
        self.sums = np.zeros(vocabulary + 1, np.uint64)
        self.ends = np.zeros((32, 4), np.uint64)
        self.places: list[np.ndarray] = []
        self.rest: list[np.ndarray] = []
        self.rounds, self.due = 0, 1
        self.renew()

    def renew(self) -> None:
        """Let shares and weights follow what was seen: after rounds 1, 2, 4 and then every fourth."""
        if self.places:
            self.weights += np.bincount(np.concatenate(self.places), minlength=128).reshape(32, 4)[:, :3]
            self.weights[self.weights.sum(axis=1) > 1 << 17] >>= 1
            self.weights[self.weights < 1] = 1
            self.counts += GAIN * np.bincount(np.concatenate(self.rest), minlength=self.counts.size)
        self.places, self.rest = [], []
        share = 1 + (self.counts * (((1 << SHARE) - self.counts.size) / self.counts.sum())).astype(np.int64)
        np.cumsum(share.astype(np.uint64), out=self.sums[1:])
        mixed = 1 + self.weights * ((1 << MIX) - 3) // self.weights.sum(axis=1, keepdims=True)
        self.ends[:, 1:] = np.cumsum(mixed, axis=1)
        self.flat = self.ends.ravel() << U(SHARE)
        self.unit = np.zeros(128, np.uint64)  # of an order-0 share, by place
        self.unit[2::4] = self.ends[:, 3] - self.ends[:, 2]
        self.symbols = None

    def symbol_of(self, value: np.ndarray) -> np.ndarray:
        """The ids whose order-0 shares hold these numbers."""
        if self.symbols is None:
            self.symbols = np.repeat(np.arange(self.counts.size, dtype=np.uint32), np.diff(self.sums.view(np.int64)))
        return self.symbols[np.minimum(value, U(self.symbols.size - 1)).view(np.int64)]

    def context(self, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where the contexts lie, what is there, and the state of both confidences (its place in ``flat``)."""
        at = (last * 40503 + before * 65599) & (ORDER2 - 1)
        two, one = self.second[at], self.first[last]
        state = (two & 3) * 32 + (one & 3) * 8
        state += ((two ^ one) < 4) * np.int32(4)
        return at, two, one, state

    def learn(self, at: np.ndarray, last: np.ndarray, two: np.ndarray, one: np.ndarray, ids: np.ndarray, place: np.ndarray, rest: np.ndarray) -> None:
        """Take in the ids of a round; of one context the last step counts."""
        fresh = (ids << 2).astype(np.int32)
        for table, where, held in ((self.second, at, two), (self.first, last, one)):
            known = (held & 3) * 2 + ((held ^ fresh) < 4)
            new = held + FOLLOWS[known]
            np.copyto(new, fresh, where=known == 0)
            table[where] = new
        self.places.append(place)
        self.rest.append(rest)
        self.rounds += 1
        if self.rounds == self.due:
            self.due += min(self.rounds, 4)
            self.renew()


class Interval:
    """Low end and width of each stream, 64 bits; 32 leave at a time."""

    def __init__(self, streams: int):
        self.low, self.width = np.zeros(streams, U), np.full(streams, ~np.uint64(0))

    def narrow(self, unit: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Narrow all streams; returns those that have a word to shift, after their widths are fit for it."""
        low = self.low
        low += unit * start
        width = unit * size
        short = np.flatnonzero(width <= LOW32)
        if short.size:
            a, b = low[short], width[short]
            width[short] = np.where((a ^ (a + b - U(1))) > LOW32, LOW32 - (a & LOW32) + U(1), b)
        self.width = width
        return short


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """One self-contained record: header, words of each stream, checksum of the ids."""
    n = ids.size
    streams = max(1, min(STREAMS, n // STEPS))
    steps = -(-n // streams) if n else 0
    padded = np.zeros(streams * steps, np.int64)
    padded[:n] = ids
    rows = np.zeros((steps + 2, streams), np.int64)  # two steps before the first
    rows[2:] = padded.reshape(streams, steps).T
    model, box = Model(vocabulary), Interval(streams)
    words, count = np.zeros((streams, steps + 4), np.uint32), np.zeros(streams, np.int64)
    for t in range(0, steps, ROUND):
        now = rows[t + 2 : t + 2 + ROUND]
        x, last = now.ravel(), rows[t + 1 : t + 1 + len(now)].ravel()
        at, two, one, state = model.context(last, rows[t : t + len(now)].ravel())
        off2 = (two >> 2) != x
        off1 = off2 & ((one >> 2) != x)
        place = (state + off2 + off1).astype(np.int64)
        start = model.flat[place]
        size = model.flat[place + 1] - start
        rest = np.flatnonzero(off1)
        symbol, unit = x[rest], model.unit[place[rest]]
        start[rest] += unit * model.sums[symbol]
        size[rest] = unit * (model.sums[symbol + 1] - model.sums[symbol])
        start, size = start.reshape(now.shape), size.reshape(now.shape)
        for i in range(len(now)):
            short = box.narrow(box.width >> U(MIX + SHARE), start[i], size[i])
            if short.size:
                words[short, count[short]] = (box.low[short] >> WORD).astype(np.uint32)
                count[short] += 1
                box.low[short] <<= WORD
                box.width[short] <<= WORD
        model.learn(at, last, two, one, x, place, symbol)
    for _ in range(2):
        words[np.arange(streams), count] = (box.low >> WORD).astype(np.uint32)
        count += 1
        box.low <<= WORD
    body = count.astype("<u4").tobytes() + words[np.arange(words.shape[1]) < count[:, None]].astype("<u4").tobytes()
    return _HEAD.pack(MAGIC, vocabulary, n, streams, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def decode_block(record: bytes) -> np.ndarray:
    """The ids of a record as unsigned 32-bit numbers; raises ValueError if a checksum differs."""
    magic, vocabulary, n, streams, crc, body_crc = _HEAD.unpack_from(record)
    body = record[_HEAD.size :]
    if magic != MAGIC or zlib.crc32(body) != body_crc:
        raise ValueError("not a block, or a damaged one")
    steps = -(-n // streams) if n else 0
    count = np.frombuffer(body, "<u4", streams).astype(np.int64)
    words = np.concatenate([np.frombuffer(body, "<u4", offset=4 * streams).astype(U), np.zeros(2, U)])
    at = np.cumsum(count) - count
    code = (words[at] << WORD) | words[at + 1]
    at += 2
    model, box = Model(vocabulary), Interval(streams)
    rows = np.zeros((steps + 2, streams), np.int64)
    for t in range(0, steps, ROUND):
        seen = []
        for i in range(t, min(t + ROUND, steps)):
            where, two, one, state = model.context(rows[i + 1], rows[i])
            state = state.astype(np.int64)
            unit, ahead = box.width >> U(MIX + SHARE), code - box.low
            off2, off1 = ahead >= unit * model.flat[state + 1], ahead >= unit * model.flat[state + 2]
            place = state + off2 + off1
            start = model.flat[place]
            size = model.flat[place + 1] - start
            ids = (np.where(off2, one, two) >> 2).astype(np.int64)
            rest = np.flatnonzero(off1)
            share, begin = model.unit[place[rest]], start[rest]
            value = (ahead[rest] - unit[rest] * begin) // (unit[rest] * share)
            symbol = model.symbol_of(value).astype(np.int64)
            ids[rest] = symbol
            start[rest] = begin + share * model.sums[symbol]
            size[rest] = share * (model.sums[symbol + 1] - model.sums[symbol])
            rows[i + 2] = ids
            short = box.narrow(unit, start, size)
            if short.size:
                code[short] = (code[short] << WORD) | words[at[short]]
                at[short] += 1
                box.low[short] <<= WORD
                box.width[short] <<= WORD
            seen.append((where, two, one, place, symbol))
        last = rows[t + 1 : t + 1 + len(seen)].ravel()
        parts = [np.concatenate(x) for x in zip(*seen)]
        model.learn(parts[0], last, parts[1], parts[2], rows[t + 2 : t + 2 + len(seen)].ravel(), parts[3], parts[4])
    ids = np.ascontiguousarray(rows[2:].T).ravel()[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("the ids of a block differ from their checksum")
    return ids
