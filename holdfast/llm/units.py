"""Whole texts to ids by way of their distinct units, in numpy.

A text is cut into units that no token crosses. Their 64-bit hashes number them; only units that this
worker has not seen are encoded, and the ids of whole texts are gathered from the numbered units. The
table lives in the Python worker, so later tasks find the units of earlier ones, and is bounded in bytes.
The hash is keyed with random numbers of the worker, so no text can be made whose units collide; two
units with one hash would be mixed up, and with n distinct units the odds are about n^2 / 2^65.
"""

from __future__ import annotations

import os
import re
import sys
import types
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd

_SALT = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def release() -> None:
    """Free the tables of this worker; tasks that need the memory for something else call it first."""
    sys.modules.pop("_holdfast_units", None)


#: Bytes of one text that are hashed at once, about; longer texts are cut between words.
LONG = 4 << 20
_GAP = re.compile(rb"[^ ] ")


def pieces(raw: bytes, limit: int = LONG) -> Iterator[bytes]:
    """A long text in parts of about `limit` bytes, each from a space behind another character; a longer word stays whole."""
    at = 0
    while len(raw) - at > limit:
        gap = _GAP.search(raw, at + limit)
        if gap is None:
            break
        yield raw[at : gap.start() + 1]
        at = gap.start() + 1
    yield raw[at:] if at else raw


class UnitEncoder:
    """Subclasses say how a text becomes bytes, where units lie in them, and what the ids of new units are."""

    #: Distinct units that a worker remembers at most, and ids of them; then it forgets those that it met only once.
    max_units, max_ids = 1_500_000, 4_000_000
    #: Bytes of text to encode at once: more is faster, as each slice updates the table, and takes more memory.
    slice_bytes = 2 << 20

    def __init__(self):
        self.powers = _powers(1 << 16)
        self.salt = np.frombuffer(os.urandom(256 * 8), np.uint64) | np.uint64(1)
        self.clear()

    def clear(self) -> None:
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)
        self.hits = np.zeros(1 << 16, np.uint16)
        self.used = 0

    def shrink(self) -> None:
        """Forget all units but those met in two slices or more; at most half of the bound stays."""
        n = len(self.keys)
        hits = self.hits[:n]
        keep = np.nonzero(hits >= 2)[0]
        if len(keep) > self.max_units // 2:
            keep = np.sort(keep[np.argsort(-hits[keep].astype(np.int32), kind="stable")[: self.max_units // 2]])
        begin = np.concatenate([np.zeros(1, np.int64), self.ends[:n]])[:-1]
        sizes = (self.ends[:n] - begin)[keep]
        if sizes.sum() > self.max_ids // 2:
            keep = keep[np.cumsum(sizes) <= self.max_ids // 2]
            sizes = (self.ends[:n] - begin)[keep]
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        ids = self.ids[np.repeat(begin[keep] - before[:-1], sizes) + np.arange(before[-1])]
        number = np.full(n, -1, np.int32)
        number[keep] = np.arange(len(keep), dtype=np.int32)
        moved = number[self.numbers]
        self.keys, self.numbers = self.keys[moved >= 0], moved[moved >= 0]
        self.ids, self.ends, self.hits, self.used = ids, before[1:].copy(), hits[keep] >> 1, len(ids)

    @classmethod
    def of(cls, path: str) -> UnitEncoder:
        """The encoder that this worker keeps for a model file."""
        home = sys.modules.setdefault("_holdfast_units", types.ModuleType("_holdfast_units")).__dict__
        key = f"{cls.__name__}:{path}"
        if key not in home:
            home[key] = cls(path)
        return home[key]

    def to_bytes(self, text: str) -> bytes:
        return text.encode("utf-8", "replace")

    def prepare(self, data: np.ndarray) -> np.ndarray:
        """Bytes that are the same to the encoder may be made equal here; lengths stay."""
        return data

    def units(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and stops. Each text ends with a line feed of ours, which belongs to no unit; `bounds` are the places behind it."""
        raise NotImplementedError

    def encode_units(self, units: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def _learn(self, keys: np.ndarray, units: list[str]) -> None:
        """Number new units on, in the order given, which is that of their keys."""
        lists = self.encode_units(units)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))
        first = len(self.keys)
        grown = lambda x, n: x if n <= len(x) else np.concatenate([x, np.zeros(max(n, len(x) * 3 // 2) - len(x), x.dtype)])
        self.ids, self.ends, self.hits = grown(self.ids, self.used + len(flat)), grown(self.ends, first + len(units)), grown(self.hits, first + len(units))
        self.ids[self.used : self.used + len(flat)] = flat
        self.ends[first : first + len(units)] = self.used + np.cumsum(sizes)
        self.used += len(flat)
        at = np.searchsorted(self.keys, keys)
        self.numbers = np.insert(self.numbers, at, np.arange(first, first + len(units), dtype=np.int32))
        self.keys = np.insert(self.keys, at, keys)

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many of them each text has (with `end` behind each, if given)."""
        raw = [self.to_bytes(t or "") for t in texts]
        if raw and sum(map(len, raw)) <= LONG:
            return self._ended(*self._encode(raw), end)
        ids, counts, held, size = [], np.zeros(len(texts), np.int64), [], 0

        def flush() -> None:
            nonlocal size
            found, n = self._encode([x for _, x in held])
            ids.append(found)
            np.add.at(counts, [i for i, _ in held], n)
            held.clear()
            size = 0

        for i, text in enumerate(raw):
            for piece in pieces(text):
                if held and size + len(piece) > LONG:
                    flush()
                held.append((i, piece))
                size += len(piece)
        if held:
            flush()
        return self._ended(np.concatenate(ids) if ids else np.zeros(0, np.uint32), counts, end)

    @staticmethod
    def _ended(ids: np.ndarray, counts: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        return (ids, counts) if end is None else (np.insert(ids, np.cumsum(counts), end), counts + 1)

    def _encode(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = self.prepare(np.frombuffer(b"\n".join(raw) + b"\n", np.uint8))
        bounds = np.cumsum([len(x) + 1 for x in raw])
        powers = self.powers if len(data) < len(self.powers[0]) else _powers(len(data) + 1)
        if len(data) <= LONG:
            self.powers = powers
        start, stop = self.units(data, bounds)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.salt[data] * powers[0][: len(data)], out=sums[1:])
        keys = (sums[stop] - sums[start]) * powers[1][start]
        keys ^= (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        codes, distinct = pd.factorize(keys)
        if len(self.keys) + len(distinct) > self.max_units or self.used > self.max_ids:
            self.shrink()
        # sorted keys are looked up with near accesses only
        order = np.argsort(distinct)
        wanted = distinct[order]
        at = np.minimum(np.searchsorted(self.keys, wanted), max(0, len(self.keys) - 1))
        known = self.keys[at] == wanted if len(self.keys) else np.zeros(len(wanted), bool)
        place = np.zeros(len(distinct), np.int32)
        place[order[known]] = self.numbers[at[known]]
        new = order[~known]
        if len(new):
            place[new] = len(self.keys) + np.arange(len(new), dtype=np.int32)
            first = np.zeros(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)  # the last one written is the first place
            blob = data.tobytes()
            self._learn(wanted[~known], [blob[a:b].decode() for a, b in zip(start[first[new]].tolist(), stop[first[new]].tolist(), strict=True)])
        self.hits[place] += self.hits[place] < 65535
        low, high = np.where(place > 0, self.ends[place - 1], 0), self.ends[place]
        sizes = (high - low)[codes]
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        ids = self.ids[np.repeat(low[codes] - before[:-1], sizes) + np.arange(before[-1])]
        upto = before[np.searchsorted(start, bounds)]
        counts = np.diff(np.concatenate([np.zeros(1, np.int64), upto]))
        return ids, counts
