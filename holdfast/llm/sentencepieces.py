"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

Words are marked with U+2581 for the space before them. No piece has that mark behind another
character, so a text is the sequence of its marked words, and distinct words are encoded once. They
are sorted, which lays out their trie depth-first: going from one word to the next keeps the forward
states of the common prefix and computes only those of the new characters.

Forward states. Unigram models: the best score of a prefix, its last piece and where that starts. BPE
models: pieces are not scored by sums, but every prefix of a word has one encoding, and it ends with
the one piece that is stable next to the last piece of what precedes it; two pieces are stable next to
each other if merging their characters gives these two again. So the transition score is 0 or minus
infinity, one path survives, and it is the path that merging finds: merges inside a piece never depend
on what lies outside, as long as no merge crosses its ends. Characters without a piece become bytes.

Defined cases: null text has no ids, like an empty one; decoding ids of a text gives the text back,
except that U+2581 itself comes back as a space, as it does in the library; very long words take time
in proportion to their length; repeated rows are encoded alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from holdfast.llm.common import slices, small_batches, table
from holdfast.llm.units import UnitEncoder

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Pairs of pieces whose stability is remembered at most.
MAX_PAIRS = 300_000
#: Ids that are decoded at once.
DECODED = 1 << 16


def _wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces and scores of a model file; BPE and unigram models without text normalization."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        kind, fallback, prefix, squeeze, charsmap = UNIGRAM, 0, 1, 1, b""
        for field, value in _wire(data):
            if field == 1:
                piece, score, type_ = b"", 0.0, NORMAL
                for f, v in _wire(value):
                    piece, score, type_ = (v, score, type_) if f == 1 else (piece, struct.unpack("<f", v)[0], type_) if f == 2 else (piece, score, v) if f == 3 else (piece, score, type_)
                self.pieces.append(piece.decode())
                self.scores.append(score)
                self.types.append(type_)
            elif field == 2:
                found = dict(_wire(value))
                kind, fallback = found.get(3, UNIGRAM), found.get(35, 0)
            elif field == 3:
                found = dict(_wire(value))
                charsmap, prefix, squeeze = found.get(2, b""), found.get(3, 1), found.get(4, 1)
        if kind not in (UNIGRAM, BPE) or charsmap or not prefix or squeeze or set(self.types) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE and unigram models with plain pieces, a dummy prefix and no normalization are read")
        self.kind, self.fallback = kind, bool(fallback)
        self.unknown = self.types.index(UNKNOWN)
        self.vocab = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.vocab):
            raise ValueError("a piece crosses the start of a word")
        self.bytes = [i for i, t in enumerate(self.types) if t == BYTE]
        self.longest = max(map(len, self.vocab), default=1)
        self.outcast = min((self.scores[i] for i in self.vocab.values()), default=0.0) - 10.0
        # a line feed in no piece is a unit of its own
        self.cuts_lines = not any("\n" in p for p in self.vocab)
        self._stable: dict[int, bool] = {}
        self._raw = [b"" if t == CONTROL else bytes([self.bytes.index(i)]) if t == BYTE else " ⁇ ".encode() if t == UNKNOWN else p.replace(MARK, " ").encode() for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True))]

    def merge(self, symbols: list[str]) -> list[str]:
        """Byte-pair merging of a short sequence: best score first, leftmost of equals."""
        symbols = list(symbols)
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                found = self.vocab.get(symbols[i] + symbols[i + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def stable(self, left: int, right: int) -> bool:
        """Whether merging the characters of two pieces gives these two again; left is -1 before the first piece."""
        key = (left + 1) * len(self.pieces) + right
        found = self._stable.get(key)
        if found is None:
            if len(self._stable) >= MAX_PAIRS:
                self._stable.clear()
            pair = [self.pieces[left]] * (left >= 0) + [self.pieces[right]]
            found = self._stable[key] = self.merge([*"".join(pair)]) == pair
        return found

    def _extend_bpe(self, word: str, at: int, last: list[str], ids: list[int]) -> None:
        """The last piece of word[: at + 1], from those of its prefixes. A character without a piece (-2) merges with nothing."""
        get, known, n = self.vocab.get, self._stable.get, len(self.pieces)
        for size in range(min(self.longest, at + 1), 0, -1):
            piece = word[at + 1 - size : at + 1]
            right = get(piece, -2)
            if right >= 0:
                left = ids[at + 1 - size]
                if left == -2:
                    left = -1
                ok = known((left + 1) * n + right)
                if not (ok if ok is not None else self.stable(left, right)):
                    continue
            elif size > 1:
                continue
            last.append(piece)
            ids.append(right)
            return
        raise AssertionError("every prefix has an encoding")

    def _extend_unigram(self, word: str, at: int, last: list[str], best: list[float]) -> None:
        top, found = -np.inf, ""
        for size in range(min(self.longest, at + 1), 0, -1):
            piece = word[at + 1 - size : at + 1]
            i = self.vocab.get(piece)
            if i is not None or size == 1:
                score = best[at + 1 - size] + (self.outcast if i is None else self.scores[i])
                if score > top:
                    top, found = score, piece
        last.append(found)
        best.append(top)

    def _ids(self, piece: str) -> list[int]:
        found = self.vocab.get(piece)
        if found is not None:
            return [found]
        return [self.bytes[b] for b in piece.encode()] if self.fallback else [self.unknown]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of marked words, in the order given. Depth-first through the trie of the sorted words."""
        out: dict[str, list[int]] = {}
        last, best, ids_of, before = [""], [0.0], [-1], ""
        bpe = self.kind == BPE
        for word in sorted(set(words)):
            shared = len(commonprefix((before, word)))
            del last[shared + 1 :], best[shared + 1 :], ids_of[shared + 1 :]
            for at in range(shared, len(word)):
                if bpe:
                    self._extend_bpe(word, at, last, ids_of)
                else:
                    self._extend_unigram(word, at, last, best)
            path, at = [], len(word)
            while at:
                path.append(last[at])
                at -= len(last[at])
            ids: list[int] = []
            for piece in reversed(path):
                new = self._ids(piece)
                if not (new == [self.unknown] and ids[-1:] == new):  # neighbouring unknown characters are one unknown piece
                    ids += new
            out[word], before = ids, word
        return [out[w] for w in words]

    def decode(self, ids) -> str:
        raw = self._raw
        # a list of ids takes far more memory than the array, so a long text is put together by parts
        parts = [ids] if isinstance(ids, list | tuple) else [ids[i : i + DECODED].tolist() for i in range(0, len(ids), DECODED)]
        text = b"".join([b"".join([raw[i] for i in part]) for part in parts])
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


class PieceEncoder(UnitEncoder):
    """Marked words of whole texts. Spaces stand for the marks until a word is encoded."""

    max_units = 600_000
    slice_bytes = 1 << 19

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as f:
            self.model = Model(f.read())

    def to_bytes(self, text: str) -> bytes:
        return f" {text}".replace(MARK, " ").encode("utf-8", "replace") if text else b""

    def units(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        space, line = data == 32, data == 10
        begins = np.zeros(len(data) + 1, bool)
        begins[1:-1] = space[1:] & ~space[:-1]
        begins[0] = True
        if self.model.cuts_lines:
            begins[:-1] |= line
            begins[1:] |= line
        begins[bounds] = True
        begins[bounds - 1] = True
        edges = np.nonzero(begins)[0]
        start, stop = edges[:-1], edges[1:]
        keep = np.isin(start, bounds - 1, invert=True, assume_unique=True)
        return start[keep], stop[keep]

    def encode_units(self, units: list[str]) -> list[list[int]]:
        return self.model.encode_words([u.replace(" ", MARK) for u in units])


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_pieces, ids, decoded_sha256 (of the decoded ids), round_trip; and the columns in `keep`."""
    kept = ["doc_id", *(c for c in keep if c in docs.columns)]
    own = ["n_pieces", "ids", "decoded_sha256", "round_trip"]
    schema = T.StructType([*(docs.schema[c] for c in kept), *T._parse_datatype_string("n_pieces int, ids array<int>, decoded_sha256 string, round_trip boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceEncoder.of(path)
        for batch in slices(batches, "text", coder.slice_bytes):
            texts = batch.column("text").to_pylist()
            ids, counts = coder.encode(texts)
            ends = np.concatenate([[0], np.cumsum(counts)])
            back = [coder.model.decode(ids[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            same = [b == (t or "") for b, t in zip(back, texts, strict=True)]
            digests = [hashlib.sha256(b.encode()).hexdigest() for b in back]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(counts, pa.int32()), lists, pa.array(digests, pa.string()), pa.array(same, pa.bool_())], kept + own)

    return small_batches(docs).select(*kept, "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, ids) -> doc_id, text."""
    schema = T.StructType([encoded.schema["doc_id"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceEncoder.of(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([coder.model.decode(x or ()) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), model_path())
