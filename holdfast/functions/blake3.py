"""BLAKE3 of bytes (the public specification), as a Python function and a pandas UDF for columns."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

# fixed values of the specification
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64
MASK = 0xFFFFFFFF
#: Columns, then diagonals, of the state.
LANES = tuple((i, 4 + i, 8 + i, 12 + i) for i in range(4)) + tuple((i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4) for i in range(4))


def _compress(cv: tuple[int, ...], block: bytes, counter: int, flags: int) -> tuple[int, ...]:
    v = [*cv, *IV[:4], counter & MASK, counter >> 32, len(block), flags]
    words = list(struct.unpack("<16I", block.ljust(BLOCK, b"\0")))
    for round_ in range(7):
        for lane, (a, b, c, d) in enumerate(LANES):
            for half, (turn1, turn2) in enumerate(((16, 12), (8, 7))):
                v[a] = (v[a] + v[b] + words[2 * lane + half]) & MASK
                x = v[d] ^ v[a]
                v[d] = (x >> turn1 | x << (32 - turn1)) & MASK
                v[c] = (v[c] + v[d]) & MASK
                x = v[b] ^ v[c]
                v[b] = (x >> turn2 | x << (32 - turn2)) & MASK
        if round_ < 6:
            words = [words[i] for i in PERMUTATION]
    return tuple(v[i] ^ v[i + 8] for i in range(8))


def _chunk(data: bytes, number: int, root: bool) -> tuple[int, ...]:
    cv = IV
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)] or [b""]
    for i, block in enumerate(blocks):
        last = i == len(blocks) - 1
        cv = _compress(cv, block, number, CHUNK_START * (i == 0) | CHUNK_END * last | ROOT * (last and root))
    return cv


def digest(data: bytes) -> bytes:
    chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)] or [b""]

    def tree(low: int, high: int, root: bool) -> tuple[int, ...]:
        if high - low == 1:
            return _chunk(chunks[low], low, root)
        # the left side takes the greatest power of two of chunks that leaves some for the right
        middle = low + (1 << (high - low - 1).bit_length() - 1)
        pair = tree(low, middle, False) + tree(middle, high, False)
        return _compress(IV, struct.pack("<16I", *pair), 0, PARENT | ROOT * root)

    return struct.pack("<8I", *tree(0, len(chunks), True))


def blake3(column: Column) -> Column:
    @pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else digest(bytes(x)))

    return run(column)
