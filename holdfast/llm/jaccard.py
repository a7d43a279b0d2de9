"""N-gram Jaccard join: documents whose shingle sets overlap enough, by several global token orders.

A document's set is compared through prefixes: with similarity t, two linked sets share a token among
the first n - ceil(t n) + 1 of each, in any order that holds for all documents. Three orders are used.
All put tokens that are frequent in the corpus last (by a count sketch over all documents, which
grows with them up to a bound) and differ in a keyed permutation. A pair must share a prefix token in the first order to
become a candidate, and in each of the others before its sets are compared. Results are exact, up to
clashes of 64-bit hashes of shingles.

Copies: equal sets form a class, named by 64 bits of a digest of the set, and one row of it is joined. Large groups of near copies:
first, each prefix token proposes pairs with the document that has the fewest rarer ones; components of
what holds are found; then only pairs of different components, which share a token, are left to propose, so
a group that hangs together is never expanded into pairs. Sizes and the places of a token in both
prefixes bound what two sets can have in common, and are compared before documents are. All that can link is compared or already
connected, without caps.

Text is read again rather than kept: prefixes are a tenth of the sets, and full sets are made for
documents of candidate pairs only (found through a Bloom filter of bounded size, then joined exactly).

Defined cases: null or wordless text is an empty set, which links with nothing; fewer words than a
shingle count as one; every row is a document of its own, also where a doc_id comes twice, and keeps a row;
component_id is the smallest doc_id that is not null among what a row reaches, and null where there is none;
very long texts stay whole, hashed by parts, and share a block with fewer others; other columns are ignored.
`keep_one` leaves one row of each group, also of repeated rows, and all rows without words.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import NUMPY_BYTES, Scratch, slices, small_batches, table
from holdfast.llm.graph import components
from holdfast.llm.units import _SALT, _powers, pieces, release

#: Counters of the sketch: their number as bits, within bounds, how many go into one row of it, shingles
#: to a counter, and bytes of text to a shingle, about.
MIN_BITS, MAX_BITS, CHUNK_BITS, LOAD, WORD_BYTES = 18, 24, 14, 32, 6.4
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
#: Bits of the Bloom filter at most: 32 MB.
BLOOM_BITS = 1 << 28

#: Slots of a set's outline.
FOLDS = 256
#: Documents of a token that are compared in one block, on each side, and bytes of their sets, about.
BLOCK, BLOCK_BYTES = 128, 16 << 20

#: Bytes of a text whose words are hashed at once.
PART = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self, width: int):
        release()
        self.width, self.powers = width, _powers(1 << 20)

    def _words(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and how many each text has."""
        data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
        bounds = np.cumsum([len(x) + 1 for x in raw])
        powers = self.powers if len(data) < len(self.powers[0]) else _powers(len(data) + 1)
        edges = np.diff(np.concatenate([[True], _SPACE[data]]).astype(np.int8))
        start, stop = np.nonzero(edges == -1)[0], np.nonzero(edges == 1)[0]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_SALT[data] * powers[0][: len(data)], out=sums[1:])
        words = _mix((sums[stop] - sums[start]) * powers[1][start] + (stop - start).astype(np.uint64))
        return words, np.diff(np.concatenate([[0], np.searchsorted(start, bounds)]))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles in order, with repeats, and how many each text has."""
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        if sum(map(len, raw)) <= PART:
            words, sizes = self._words(raw)
        else:
            parts = [[self._words([piece])[0] for piece in pieces(x, PART)] for x in raw]
            sizes = np.array([sum(map(len, x)) for x in parts])
            words = np.concatenate([w for x in parts for w in x])
        upto = np.cumsum(sizes)
        # a shingle starts at each word that has enough words of its text behind it; short texts have one, of all words
        made = np.where(sizes >= self.width, sizes - self.width + 1, (sizes > 0).astype(np.int64))
        first = np.repeat(upto - sizes, made) + np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made)
        length = np.repeat(np.minimum(sizes, self.width), made)
        out = length.astype(np.uint64) * _M3
        for i in range(self.width):
            more = i < length
            out = np.where(more, _mix(out + _M3 + words[np.minimum(first + i, max(0, len(words) - 1))]), out) if len(words) else out
        return out, made


def sketch_bits(docs: DataFrame) -> int:
    """About LOAD shingles to a counter, within bounds: the sketch keeps its resolution while the corpus grows."""
    size = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(1 + size / WORD_BYTES / LOAD))))


def _slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def frequency_levels(docs: DataFrame, width: int, scratch: Scratch) -> np.ndarray:
    """For each counter, the logarithm of how often its shingles occur in all documents: 2 ** MAX_BITS bytes at most."""
    bits = sketch_bits(docs)

    def pack(sums: np.ndarray) -> bytes:
        # a counter stays at its largest value rather than start anew
        return zlib.compress(np.minimum(sums, 0xFFFFFFFF).astype("<u4").tobytes(), 1)

    def unpack(packed: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(packed), "<u4").astype(np.int64)

    def rows(chunks: list[int], sums: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array([pack(x) for x in sums], pa.binary()), pa.array([int(x.sum()) for x in sums], pa.int64())], ["chunk", "counts", "total"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, sums = Shingler(width), np.zeros(1 << bits, np.uint32)
        for batch in slices(batches, "text", NUMPY_BYTES):
            slot, n = np.unique(_slot(make(batch.column("text").to_pylist())[0], bits), return_counts=True)
            sums[slot] += n.astype(np.uint32)
        parts = sums.reshape(-1, 1 << CHUNK_BITS)
        used = np.nonzero(parts.any(axis=1))[0]
        for at in range(0, len(used), 64):
            yield rows(used[at : at + 64].tolist(), list(parts[used[at : at + 64]]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + unpack(packed)
        yield rows(list(sums), list(sums.values()))

    kind = "chunk int, counts binary, total long"
    merged = scratch.save(docs.select("text").mapInArrow(count, kind).repartition("chunk").mapInArrow(merge, kind), "sketch")
    mean = max(1.0, (merged.agg(F.sum("total").alias("n")).first()["n"] or 0) / (1 << bits))

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # counters up to twice the mean are alike; what stands out comes last
            out = [zlib.compress(np.log2(1 + unpack(x) / (2 * mean)).astype(np.uint8).tobytes(), 1) for x in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(out, pa.binary())], ["chunk", "levels"])

    levels = np.zeros((1 << bits - CHUNK_BITS, 1 << CHUNK_BITS), np.uint8)
    for row in merged.select("chunk", "counts").mapInArrow(grade, "chunk int, levels binary").toLocalIterator():
        levels[row["chunk"]] = np.frombuffer(zlib.decompress(row["levels"]), np.uint8)
    scratch.drop("sketch")
    return levels.ravel()


def prefix(own: np.ndarray, level: np.ndarray, order: int, share: tuple[int, int]) -> np.ndarray:
    """Tokens of a set that come first in an order: level, then a keyed permutation of the hash."""
    length = len(own) - -(-share[0] * len(own) // share[1]) + 1
    return np.sort(np.partition(level | (_mix(own ^ np.uint64(ORDERS[order])) >> np.uint64(8)), length - 1)[:length])


def _level(own: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return levels[_slot(own, len(levels).bit_length() - 1)].astype(np.uint64) << np.uint64(56)


def prefix_sets(docs: DataFrame, sent: Broadcast, width: int, share: tuple[int, int]) -> DataFrame:
    """docs (row, doc_id, h, text) and the broadcast levels -> row, doc_id, h, n, node (the class of its set; null for an empty one), prefix of the first order."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, levels = Shingler(width), sent.value
        for batch in slices(batches, "text", NUMPY_BYTES):
            found, made = make(batch.column("text").to_pylist())
            sizes, nodes, firsts, at = [], [], [], 0
            for m in made.tolist():
                own = np.unique(found[at : at + m])
                at += m
                sizes.append(len(own))
                nodes.append(int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True) if m else None)
                firsts.append(prefix(own, _level(own, levels), 0, share) if m else own)
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in firsts])]), pa.int32())
            tokens = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(firsts).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "h")), pa.array(sizes, pa.int32()), pa.array(nodes, pa.int64()), tokens], ["row", "doc_id", "h", "n", "node", "tokens"])

    return docs.mapInArrow(run, f"row long, doc_id {kind}, h long, n int, node long, tokens array<long>")


def _slots(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(_mix(ids.view(np.uint64) + np.uint64(k)) % np.uint64(bits)).astype(np.int64) for k in (1, 2, 3)]


def outline(own: np.ndarray, levels: np.ndarray, share: tuple[int, int]) -> bytes:
    """What the sieve needs of a set: how many tokens fall on each of FOLDS slots, and the prefixes of the further orders."""
    level = _level(own, levels)
    folds = np.bincount((own & np.uint64(FOLDS - 1)).astype(np.int64), minlength=FOLDS)
    rest = [prefix(own, level, k, share).astype(np.uint32) for k in range(1, len(ORDERS))]
    return np.concatenate([folds.astype(np.uint32), *rest]).tobytes()


def sets_of(docs: DataFrame, wanted: DataFrame, width: int, pack) -> tuple[DataFrame, Broadcast]:
    """node, tokens (what `pack` makes of the sorted set) of the rows of docs (h, text) that are in wanted (node, h); and what is to be freed with it.

    A Bloom filter of bounded size spares most other texts the work; the join then is exact.
    """
    count = wanted.count()
    bits = min(BLOOM_BITS, max(1 << 16, 1 << (16 * count).bit_length()))

    def collect_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits, bool)
        seen = False
        for batch in batches:
            seen = True
            for slots in _slots(batch.column("h").to_numpy(), bits):
                held[slots] = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(held).tobytes(), 1)], pa.binary())], ["bits"])

    bloom = np.zeros(bits // 8, np.uint8)
    for row in wanted.select("h").coalesce(8).mapInArrow(collect_bits, "bits binary").toLocalIterator():
        bloom |= np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, held = Shingler(width), sent.value
        for batch in batches:
            slots = _slots(batch.column("h").to_numpy(), bits)
            keep = np.all([held[s >> 3] >> (7 - (s & 7)).astype(np.uint8) & 1 for s in slots], axis=0)
            for part in slices(iter([batch.filter(pa.array(keep.astype(bool)))]), "text", NUMPY_BYTES):
                found, made = make(part.column("text").to_pylist())
                ends = np.cumsum(made)
                sets = [pack(np.unique(found[a:b])) for a, b in zip((ends - made).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("h"), pa.array(sets, pa.binary())], ["h", "tokens"])

    made = docs.select("h", "text").mapInArrow(run, "h long, tokens binary")
    return made.join(wanted, "h").dropDuplicates(["node"]).select("node", "tokens"), sent


class Join:
    """One run of the join over docs (doc_id, text). A row's hash h tells rows apart that differ in id or text."""

    def __init__(self, docs: DataFrame, scratch: Scratch, width: int, share: tuple[int, int]):
        self.docs, self.scratch, self.width, self.share = small_batches(docs).select("doc_id", "text", row_hash().alias("h")), scratch, width, share

    def _fits(self, na: str, ia: str, nb: str, ib: str) -> F.Column:
        """Sizes, and the places of a token that is the first in common, allow the similarity."""
        num, den = self.share
        na, ia, nb, ib = (F.col(c).cast("long") for c in (na, ia, nb, ib))
        most = F.least(na - ia, nb - ib)  # places count from 0, so the token itself is among these
        return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (most * (num + den) >= num * (na + nb))

    def _meet(self, pairs: DataFrame, name: str, pack, compare) -> DataFrame:
        """pairs (a, b, token, g) -> those that `compare` keeps, given the pairs of a block and the packed sets by node.

        Pairs meet in blocks of the documents that share their token (g on each side), so that a set is
        sent once to a block and not once for each pair.
        """
        scratch = self.scratch
        block = lambda c: F.pmod(F.xxhash64(c), F.col("g")).cast("int")
        keys = ["token", "i", "j"]
        placed = scratch.save(pairs.select("token", block("a").alias("i"), block("b").alias("j"), "a", "b", "g"), f"{name}-placed")
        members = scratch.save(placed.select(*keys, F.explode(F.array("a", "b")).alias("node")).distinct(), f"{name}-members")
        wanted = scratch.save(self.classes.select("node", "h").join(members.select("node").distinct(), "node", "left_semi"), f"{name}-wanted")
        sets, sent = sets_of(self.docs, wanted, self.width, pack)
        sets = scratch.save(sets, f"{name}-sets")
        sent.destroy()

        def run(pairs: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
            return pairs[compare(pairs, dict(zip(members["node"].tolist(), members["tokens"], strict=True)))][["a", "b", "token", "g"]]

        right = members.join(sets, "node").groupBy(*keys)
        out = placed.groupBy(*keys).cogroup(right).applyInPandas(run, "a long, b long, token long, g long")
        out = scratch.save(out, f"{name}-met")
        scratch.drop(*(f"{name}-{x}" for x in ("placed", "members", "wanted", "sets")))
        return out

    def _verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """pairs (a, b, token, g) -> links (a, b). A sieve of outlines comes first, then the sets themselves.

        The sieve intersects the filters of the further orders, and bounds the overlap by the slots:
        two sets have no more tokens in common than the smaller count of each slot, added up.
        """
        num, den = self.share
        share, sent = self.share, self.levels

        def sieve(pairs: pd.DataFrame, packed: dict) -> np.ndarray:
            own = {d: np.frombuffer(x, np.uint32) for d, x in packed.items()}
            folds = {d: x[:FOLDS].astype(np.int64) for d, x in own.items()}
            a, b = np.stack([folds[x] for x in pairs["a"].tolist()]), np.stack([folds[x] for x in pairs["b"].tolist()])
            most = np.minimum(a, b).sum(axis=1)
            keep = most * den >= num * (a.sum(axis=1) + b.sum(axis=1) - most)
            firsts: dict = {}

            def cut(x) -> list[set]:
                if x not in firsts:
                    n = int(folds[x].sum())
                    firsts[x] = [set(y.tolist()) for y in np.split(own[x][FOLDS:], len(ORDERS) - 1)] if n else []
                return firsts[x]

            for i in np.nonzero(keep)[0].tolist():
                keep[i] = all(not x.isdisjoint(y) for x, y in zip(cut(pairs["a"].iat[i]), cut(pairs["b"].iat[i]), strict=True))
            return keep

        def exact(pairs: pd.DataFrame, packed: dict) -> np.ndarray:
            own = {d: np.frombuffer(x, np.uint64) for d, x in packed.items()}
            out = np.zeros(len(pairs), bool)
            for i, (a, b) in enumerate(zip(pairs["a"].tolist(), pairs["b"].tolist(), strict=True)):
                common = len(np.intersect1d(own[a], own[b], assume_unique=True))
                out[i] = common * den >= num * (len(own[a]) + len(own[b]) - common)
            return out

        passed = self._meet(pairs, f"{name}-sieve", lambda own: outline(own, sent.value, share), sieve)
        return self._meet(passed, f"{name}-exact", lambda own: own.tobytes(), exact).select("a", "b")

    def _across(self, placed: DataFrame) -> DataFrame:
        """placed (token, g, node, n, i, c) -> pairs (a, b, token, g) of different components that may link.

        Sizes and places are compared first, then those of whole components, and documents last:
        neither a large component nor documents that differ too much are expanded into pairs.
        """
        scratch = self.scratch
        span = lambda d, *keys: d.groupBy(*keys).agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
        mixed = span(placed, "token").filter("lo < hi").select("token")
        open_ = scratch.save(placed.join(mixed, "token", "left_semi"), "open")
        kinds = scratch.save(span(open_, "token", "n", "i"), "kinds")
        x, y = kinds.toDF("token", "n", "i", "lo", "hi"), kinds.toDF("token", "n2", "i2", "lo2", "hi2")
        alive = x.join(y, "token").filter(self._fits("n", "i", "n2", "i2") & (F.least("lo", "lo2") < F.greatest("hi", "hi2"))).select("token", "n", "i").distinct()
        groups = scratch.save(open_.join(alive, ["token", "n", "i"], "left_semi"), "groups")
        classes = groups.select("token", "c", "n", "i").distinct()
        x, y = classes.toDF("token", "ca", "na", "ia"), classes.toDF("token", "cb", "nb", "ib")
        met = x.join(y, "token").filter((F.col("ca") < F.col("cb")) & self._fits("na", "ia", "nb", "ib"))
        a = groups.select("token", F.col("c").alias("ca"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("node").alias("x"), "g")
        b = groups.select("token", F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("node").alias("y"))
        pairs = met.join(a, ["token", "ca", "na", "ia"]).join(b, ["token", "cb", "nb", "ib"])
        return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "token", "g")

    @staticmethod
    def _once(pairs: DataFrame) -> DataFrame:
        """Each pair with the least of the tokens that propose it, so that pairs of a group meet under few tokens."""
        return pairs.groupBy("a", "b").agg(F.min(F.struct("token", "g")).alias("t")).select("a", "b", "t.token", "t.g")

    def run(self) -> DataFrame:
        """doc_id, h, n (size of the set), c (the group; null for an empty set) and top (its smallest doc_id) for every row."""
        scratch = self.scratch
        self.levels = scratch.spark.sparkContext.broadcast(frequency_levels(self.docs, self.width, scratch))
        made = scratch.save(prefix_sets(self.docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "h", "text"), self.levels, self.width, self.share), "prefixes")
        sets = scratch.save(made.select("doc_id", "h", "n", "node"), "sets")
        classes = made.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min(F.struct("row", "h")).alias("first"))
        self.classes = scratch.save(classes.select("node", "rep", "first.row", "first.h"), "classes")
        nodes = made.join(self.classes.select("row"), "row", "left_semi").select("node", "n", "tokens")
        tokens = scratch.save(nodes.select(F.posexplode("tokens").alias("i", "token"), "node", "n"), "tokens")
        scratch.drop("prefixes")
        # the lead of a token is the document that has the fewest rarer tokens: the middle of a group of near copies
        m = F.count(F.lit(1))
        g = F.greatest(F.ceil(m / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("long")
        counts = tokens.groupBy("token").agg(F.min(F.struct("i", "node", "n")).alias("lead"), m.alias("m"), g.alias("g"))
        counts = scratch.save(counts.filter("m > 1").drop("m"), "counts")
        shared = scratch.save(tokens.join(counts, "token"), "shared")
        scratch.drop("tokens", "counts")
        first = shared.filter(F.col("node") != F.col("lead.node")).filter(self._fits("n", "i", "lead.n", "lead.i"))
        first = first.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b"), "token", "g")
        first = scratch.save(self._once(first), "pairs1")
        links1 = self._verified(first, "first")
        comp = components(links1, scratch, "comp1")
        placed = shared.join(comp, "node", "left").select("token", "g", "node", "n", "i", F.coalesce("component", "node").alias("c"))
        placed = scratch.save(placed, "placed")
        scratch.drop("shared")
        second = scratch.save(self._once(self._across(placed)).join(first, ["a", "b"], "left_anti"), "pairs2")
        scratch.drop("placed", "open", "kinds", "groups")
        links2 = self._verified(second, "second")
        self.levels.destroy()
        comp = components(links1.union(links2), scratch, "comp2")
        of_class = scratch.save(self.classes.join(comp, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("c")), "of_class")
        tops = of_class.groupBy("c").agg(F.min("rep").alias("top"))
        named = scratch.save(of_class.join(tops, "c").select("node", "c", "top"), "named")
        scratch.only("sets", "named")
        # empty sets have no class; apart from the join they are no hot key of it
        empty = sets.filter("node is null").select("doc_id", "h", "n", F.lit(None).cast("long").alias("c"), F.col("doc_id").alias("top"))
        return sets.filter("node is not null").join(named, "node").select("doc_id", "h", "n", "c", "top").unionByName(empty)


def row_hash() -> F.Column:
    return F.xxhash64("doc_id", "text")


def join(docs: DataFrame, scratch: Scratch, width: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id for every row."""
    return Join(docs, scratch, width, share).run().select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("top").alias("component_id"))


def keep_one(docs: DataFrame, scratch: Scratch, width: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """Pipeline stage: of each group of linked documents the one with the smallest doc_id (a null one comes last); all columns stay."""
    rows = scratch.save(Join(docs, scratch, width, share).run().filter("c is not null").groupBy("c", "doc_id", "h").agg(F.count(F.lit(1)).alias("times")), "rows")
    kept = rows.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "h", "times")).alias("x")).select("x.h", "x.times")
    kept = scratch.save(kept, "kept")
    gone = rows.select("h").join(kept.select("h"), "h", "left_anti").distinct()
    # of equal rows that stay one is chosen, with a value for all other columns together
    gone = scratch.save(gone.unionByName(kept.filter("times > 1").select("h")), "gone")
    hashed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), row_hash().alias("h"))
    out = hashed.join(gone, "h", "left_anti").select("_row.*")
    repeated = scratch.save(kept.filter("times > 1").select("h"), "repeated")
    if repeated.limit(1).count():
        out = out.unionByName(hashed.join(repeated, "h", "left_semi").groupBy("h").agg(F.min("_row").alias("_row")).select("_row.*"))
    scratch.only("gone", "repeated")
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), Scratch(spark, "jaccard"), 3, (9, 10))
