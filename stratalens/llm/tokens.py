"""Token ids of whole texts, as the tokenizers library gives them.

The library's file is the authority.  Its merges also run in tiktoken, which
takes a fifth of the time: a worker builds that twin from the very same file,
compares both on probes, and keeps to the library itself where the file is of
another kind, where a probe differs, or where a text holds an added token.

Texts of Latin letters go faster still: the pieces that merges never leave are
found by character classes in numpy, a batch of texts at a time, and pieces met
before are looked up in a cache by a 64-bit hash; the twin sees new ones only.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np

#: What a byte-level pre-tokenizer splits by.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBES = ["it's  we'll\n\n x \t y", "Ünïcode, ñ 12³ ½ — …", "  lead and trail  ", "a\r\n b\x1c\x85c d　e﻿", "日本語 текст 🙂👍🏽 ا", "aaaa" * 40, "<<{}>>!?$$$ ***"]


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


# White space of the pattern within the characters that are classed here.
_SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0)
LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)
#: Characters that are classed: Latin letters and common signs, whose categories never change.
_CLASSED = (*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC)
#: Characters of a chunk of texts, about, of a piece that is cached, and ids and slots of a cache.
CHUNK, LONGEST, POOL, SLOTS = 1 << 18, 64, 4 << 20, 1 << 20


def character_classes() -> np.ndarray:
    out = np.full(0x20AD, UNKNOWN, np.uint8)
    for c in _CLASSED:
        kind = unicodedata.category(chr(c))[0]
        out[c] = SPACE if c in _SPACES else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    return out


def piece_starts(codes: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces of the pattern begin, in texts one after another whose first characters are marked.

    Pieces are runs of one class, with a space before them if there is one.  Of
    a run of white space all but the last go together, or all of them at the
    end of a text; 's and the like are pieces of their own after a run.
    """
    last = np.r_[first[1:], True]
    change = first.copy()
    change[1:] |= kinds[1:] != kinds[:-1]
    space = kinds == SPACE
    start = change.copy()
    ends_run = space & ~last  # the last white space before something else
    ends_run[:-1] &= ~space[1:]
    start |= ends_run
    joined = np.zeros_like(start)  # what takes the space before it along
    joined[1:] = ends_run[:-1] & (codes[:-1] == 0x20)
    start &= ~joined
    quote = np.flatnonzero((codes == 0x27) & change & ~joined & ~last)
    if quote.size:
        after = quote + 1
        quote, after = quote[kinds[after] == LETTER], after[kinds[after] == LETTER]
        more = np.minimum(after + 1, codes.size - 1)
        goes_on = (more > after) & ~first[more] & (kinds[more] == LETTER)
        a, b = codes[after], np.where(goes_on, codes[more], 0)
        one = np.isin(a, [ord(c) for c in "sdmt"])
        two = ~one & ((a == ord("l")) & (b == ord("l")) | (a == ord("v")) & (b == ord("e")) | (a == ord("r")) & (b == ord("e")))
        start[after[one | two]] = False
        start[more[one & goes_on]] = True
        third = np.minimum(after[two] + 2, codes.size - 1)
        start[third[(third > after[two] + 1)]] = True  # another run begins there, or the rest of this one
    return start


class PieceCache:
    """Ids of pieces met before, by the hash of their characters: one place a hash, the newest piece stays.

    Two pieces share a 64-bit hash with a chance of about 1e-8 a worker.
    """

    def __init__(self, encode, classes: np.ndarray):
        rng = np.random.default_rng(11)
        odd = lambda n: rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.encode, self.letters, self.places = encode, odd(classes.size), odd(LONGEST)
        self.clear()

    def clear(self) -> None:
        self.hash, self.at, self.size = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.pool, self.used = np.zeros(POOL, np.uint32), 0

    def add(self, ids: list[int]) -> tuple[int, int]:
        at, n = self.used, len(ids)
        self.pool[at : at + n] = ids
        self.used += n
        return at, n

    def ids(self, joined: str, codes: np.ndarray, kinds: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """The ids of texts one after another, none empty, all of classed characters."""
        if self.used > POOL // 2:
            self.clear()
        ends = np.cumsum(lengths)
        first = np.zeros(codes.size, bool)
        first[ends - lengths] = True
        starts = np.flatnonzero(piece_starts(codes, kinds, first))
        size = np.diff(starts, append=codes.size)
        inside = np.arange(codes.size, dtype=np.int32) - np.repeat(starts.astype(np.int32), size)
        h = np.add.reduceat(self.letters[codes] * self.places[np.minimum(inside, LONGEST - 1)], starts)
        h ^= h >> np.uint64(29)
        h = h * np.uint64(0xBF58476D1CE4E5B9) + size.astype(np.uint64)
        slot = ((h >> np.uint64(32)) & np.uint64(SLOTS - 1)).view(np.int64)
        at, n = self.at[slot], self.size[slot]
        missing = np.flatnonzero(((self.hash[slot] != h) | (n == 0)) & (size <= LONGEST))
        if missing.size:
            new, where, which = np.unique(h[missing], return_index=True, return_inverse=True)
            found = np.array([self.add(self.encode(joined[starts[i] : starts[i] + size[i]])) for i in missing[where].tolist()], np.int32)
            at[missing], n[missing] = found[which].T
            place = slot[missing[where]]
            self.hash[place], self.at[place], self.size[place] = new, found[:, 0], found[:, 1]
        for i in np.flatnonzero(size > LONGEST).tolist():
            at[i], n[i] = self.add(self.encode(joined[starts[i] : starts[i] + size[i]]))
        upto = np.cumsum(n, dtype=np.int32)
        ids = self.pool[np.arange(upto[-1], dtype=np.int32) + np.repeat(at - (upto - n), n)]
        cuts = upto[np.searchsorted(starts, ends) - 1]
        return np.split(ids, cuts[:-1])


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.added = [x["content"] for x in own.get("added_tokens", [])]
        self.twin = self._twin(own)
        self.classes = character_classes()
        self.pieces = PieceCache(self.twin.encode_ordinary, self.classes) if self.twin is not None else None

    def _twin(self, own: dict):
        split = own.get("pre_tokenizer") or {}
        if own["model"].get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or own.get("normalizer"):
            return None
        import tiktoken

        of = byte_characters()
        ranks = {bytes(of[c] for c in token): i for token, i in own["model"]["vocab"].items() if token not in self.added}
        twin = tiktoken.Encoding("twin", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return twin if all(twin.encode_ordinary(x) == self._library(x) for x in PROBES) else None

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text as unsigned 32-bit numbers; none for an empty one."""
        if not text:
            return np.zeros(0, "<u4")
        if self.twin is None or any(x in text for x in self.added):
            return np.array(self._library(text), "<u4")
        return self.twin.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as ids() gives them, worked out for chunks of texts at once."""
        out: list[np.ndarray | None] = [None] * len(texts)
        held, size = [], 0
        for i, text in enumerate(texts):
            if self.pieces is None or not text or len(text) > 2 * CHUNK or any(x in text for x in self.added):
                out[i] = self.ids(text)
                continue
            held.append(i)
            size += len(text)
            if size >= CHUNK:
                self._chunk(texts, held, out)
                held, size = [], 0
        if held:
            self._chunk(texts, held, out)
        return out

    def _chunk(self, texts: list[str], held: list[int], out: list[np.ndarray | None]) -> None:
        lengths = np.array([len(texts[i]) for i in held])
        joined = "".join([texts[i] for i in held])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).view(np.int32)
        kinds = self.classes.take(codes, mode="clip")
        kinds[codes >= self.classes.size] = UNKNOWN
        starts = np.cumsum(lengths) - lengths
        strange = np.add.reduceat(kinds == UNKNOWN, starts) > 0
        if strange.any():  # those texts go through the twin whole
            for i in np.flatnonzero(strange).tolist():
                out[held[i]] = self.ids(texts[held[i]])
            keep = [i for i, odd in zip(held, strange.tolist()) if not odd]
            if keep:
                self._chunk(texts, keep, out)
            return
        for i, ids in zip(held, self.pieces.ids(joined, codes, kinds, lengths)):
            out[i] = ids


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
