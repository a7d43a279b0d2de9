"""Token ids in binary files: frequency-ranked, byte-aligned, with separate control bytes.

A value of 1 to 4 bytes has a 2-bit length code; four codes make a control byte, and the value bytes
follow in a block of their own, so numpy decodes a block by table lookup and gathers. Ids are replaced
by their rank in the corpus before that, so frequent ids take one byte. The rank table is bounded by
the vocabulary and broadcast.

Encoding: tokens never cross ASCII white space, so the library encodes each distinct word of a worker
once, and numpy gathers the ids of whole texts (holdfast.llm.units). The text is encoded twice, first to count,
then to write, which costs less than keeping the ids on disk between.

Files: each range of doc_id is one file of blocks; the manifest orders the files, and running sums over
files, then inside each, give the start of a document.

Defined cases: null text is like an empty one (just the end id); very long texts stay whole; rows with
equal doc_id keep an arbitrary order among them; null doc_id comes first; an empty table has no files.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from holdfast.llm.common import Scratch, slices, small_batches, table
from holdfast.llm.files import Writer, reading
from holdfast.llm.units import UnitEncoder

END_ID = 1
#: Bytes of text after which a worker gives memory back, as doing so at every batch takes its time.
GIVE_BACK_BYTES = 32 << 20
HEADER = "<4sIQQQ"  # magic, documents, values, control bytes, value bytes
MAGIC = b"HFTI"

#: Classes of bytes: white space, letters, digits, other ASCII, and bytes of which only the library knows.
_SPACE, _LETTER, _DIGIT, _OTHER, _UNKNOWN = range(5)
_CLASS = np.full(256, _UNKNOWN, np.uint8)
_CLASS[:128] = _OTHER
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class WordEncoder(UnitEncoder):
    """Runs of letters, of digits and of other characters, encoded by the library.

    The tokenizer lower-cases and cuts between these runs itself, but for an apostrophe that starts a
    contraction. Where a character beyond the Latin letters is near, there is no cut, and slices with
    special tokens, which it reads before anything else, are cut at white space only.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)

    def prepare(self, data: np.ndarray) -> np.ndarray:
        if b"<|" in data.tobytes():
            return data
        data = _LOWER[data]
        latin = np.nonzero(data[:-1] == 0xC3)[0] + 1
        upper = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
        data[upper] += 0x20
        return data

    def units(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = _CLASS[data]
        space = kind == _SPACE
        if b"<|" in data.tobytes():
            cut = np.zeros(len(data), bool)
        else:
            latin = np.nonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))[0]
            kind[latin] = kind[latin + 1] = _LETTER
            known = kind != _UNKNOWN
            cut = np.zeros(len(data), bool)
            cut[1:] = (kind[1:] != kind[:-1]) & known[1:] & known[:-1]
            # an apostrophe that may start a contraction goes with the letters behind it
            lone = np.nonzero((data[:-1] == 39) & (kind[1:] == _LETTER))[0]
            lone = lone[(lone == 0) | (kind[lone - 1] != _OTHER)]
            cut[lone + 1] = False
        cut[1:] |= space[1:] != space[:-1]
        cut[0] = True
        edges = np.append(np.nonzero(cut)[0], len(data))
        start, stop = edges[:-1], edges[1:]
        keep = ~space[start]
        return start[keep], stop[keep]

    def encode_units(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and value bytes."""
    size = 1 + (values > 0xFF) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    raw = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) < size[:, None]].tobytes()


_LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    stop = np.cumsum(size, dtype=np.int64)
    if (int(stop[-1]) if n else 0) != len(data):
        raise ValueError("control bytes and value bytes disagree")
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    start = stop - size
    out = raw[start]
    for i in (1, 2, 3):
        longer = size > i
        if longer.any():
            out[longer] |= raw[start[longer] + i] << np.uint32(8 * i)
    return out


def count(docs: DataFrame, path: str) -> DataFrame:
    """id, n: how often each id occurs in the corpus, end ids included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sums = WordEncoder.of(path), np.zeros(1 << 16, np.int64)
        for batch in slices(batches, "text", coder.slice_bytes, GIVE_BACK_BYTES):
            found = np.bincount(coder.encode(batch.column("text").to_pylist(), END_ID)[0], minlength=1 << 16)
            if len(found) > len(sums):
                sums = np.pad(sums, (0, len(found) - len(sums)))
            sums[: len(found)] += found
        ids = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(sums[ids])], ["id", "n"])

    return small_batches(docs).select("text").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def ranking(counts: DataFrame) -> np.ndarray:
    """Ids by falling frequency, then by id. At most the vocabulary comes to the driver."""
    found = counts.toPandas().sort_values(["n", "id"], ascending=[False, True])
    return found["id"].to_numpy(np.uint32)


def write(docs: DataFrame, path: str, order: np.ndarray, scratch: Scratch) -> DataFrame:
    """docs (doc_id, text) -> manifest: file, first (its smallest doc_id), tokens, bytes. Files go to the folder `ids`."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    folder = scratch.path("ids")
    rank = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    sent = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, ranks = WordEncoder.of(path), sent.value
        out, first, total = None, None, 0
        for batch in slices(batches, "text", coder.slice_bytes, GIVE_BACK_BYTES):
            ids = batch.column("doc_id")
            if out is None:
                out, first = Writer(folder, "part", ".ids"), ids.slice(0, 1)
            flat, counts = coder.encode(batch.column("text").to_pylist(), END_ID)
            flat, at, packed = ranks[flat], 0, []
            for n in counts.tolist():
                packed.append(pack(flat[at : at + n]))
                at += n
            sizes = np.array([[len(c), len(d)] for c, d in packed], np.int64)
            # one block: header, documents (id, flag of a null id, values, control bytes, value bytes), control bytes, value bytes
            head = np.column_stack([ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False), counts, sizes]).astype("<i8")
            out.write(struct.pack(HEADER, MAGIC, len(counts), int(counts.sum()), int(sizes[:, 0].sum()), int(sizes[:, 1].sum())))
            out.write(head.tobytes())
            out.write(b"".join(c for c, _ in packed))
            out.write(b"".join(d for _, d in packed))
            total += int(counts.sum())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([out.name]), first, pa.array([total], pa.int64()), pa.array([out.offset], pa.int64())], ["file", "first", "tokens", "bytes"])

    # ordered before it is encoded: the sampling for the ranges would encode everything once more
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return scratch.save(ordered.mapInArrow(run, f"file string, first {kind}, tokens long, bytes long"), "manifest")


def read(manifest: DataFrame, order: np.ndarray, scratch: Scratch) -> DataFrame:
    """manifest -> doc_id, start, n_tokens, ids (int array as little-endian bytes) in file order."""
    kind = manifest.schema["first"].dataType.simpleString()
    folder = scratch.path("ids")
    sent = manifest.sparkSession.sparkContext.broadcast(order)
    # one row for each file
    starts = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(W.orderBy(F.col("first").asc_nulls_first(), "file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_by_rank = sent.value
        with reading(folder) as files:
            for batch in batches:
                for name, size, base in zip(*(batch.column(c).to_pylist() for c in ("file", "bytes", "base")), strict=True):
                    at = 0
                    while at < size:
                        magic, docs, _, n_control, n_data = struct.unpack(HEADER, files.read(name, at, struct.calcsize(HEADER)))
                        if magic != MAGIC:
                            raise ValueError(f"{name}: no block at {at}")
                        at += struct.calcsize(HEADER)
                        head = np.frombuffer(files.read(name, at, docs * 40), "<i8").reshape(-1, 5)
                        control = files.read(name, at + docs * 40, n_control)
                        data = files.read(name, at + docs * 40 + n_control, n_data)
                        at += docs * 40 + n_control + n_data
                        rows, c, d = [], 0, 0
                        for _, _, n, nc, nd in head.tolist():
                            rows.append(ids_by_rank[unpack(control[c : c + nc], data[d : d + nd], n)].astype("<u4").tobytes())
                            c, d = c + nc, d + nd
                        ends = base + np.cumsum(head[:, 2])
                        yield pa.RecordBatch.from_arrays([pa.array(head[:, 0], mask=head[:, 1] == 1), pa.array(ends - head[:, 2]), pa.array(head[:, 2]), pa.array(rows, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                        base = int(ends[-1])

    # a number of our own: the rows are few and small, and would be put together into one task
    spread = starts.repartition(max(1, manifest.count()), F.col("file"))
    return spread.select("file", "bytes", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary").withColumn("doc_id", F.col("doc_id").cast(kind))


def tokenize(docs: DataFrame, path: str, scratch: Scratch) -> DataFrame:
    order = ranking(count(docs, path))
    return read(write(docs, path, order, scratch), order, scratch)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = tokenize(docs, public_tokenizers.path("word_bpe_49k.json"), Scratch(spark, "ids"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
