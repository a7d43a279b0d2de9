"""Embedding near-duplicates by sorted projection passes.

Each pass hashes a vector to signs of its products with random directions; the bits, put together, are
a number, and sorting by it is sorting lexicographically by the hashes. Vectors near each other share
long prefixes in some passes. A pass compares every vector with the rest of its run (those that share
the first bits) and with the WINDOW ones before it; components over all passes are the groups. A pair at
the threshold shares a run in some pass with the chance RECALL, whatever the other vectors are and
however the rows are split over tasks; the window adds to that. The number of passes grows with n.

What is sorted are codes: components rounded to a byte each, with the length of what rounding took
away. Two codes bound the cosine of their vectors from both sides; pairs that the bounds decide need no
more, the others are looked up and compared in double precision. Some passes at a time are sorted, so
that the disk holds a few codes of each vector, however many passes there are.

Links are counted inside the groups, without listing pairs. All vectors within half of the threshold's
angle of a pivot are linked with each other (the triangle inequality of angles), so they are counted
by one aggregation; only vectors outside of that core are compared, block by block, with the group.

Equal vectors are one class, told apart by a digest of their bytes; links, groups and counts are of classes,
and rows get what their class has. Defined cases: vectors that are null, empty, zero, or hold null or
non-finite components link with nothing and keep their row; equal vectors link with each other; vectors
of different lengths never link; rows with one vec_id are vectors of their own, which link if they are near,
also with each other; a null vec_id keeps its row and stays alone; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm.common import Scratch, small_batches, table
from holdfast.llm.graph import components

THRESHOLD = 0.9
WINDOW = 64
#: Chance that a pair exactly at the threshold is compared in some pass.
RECALL = 0.995
BITS = 62
BLOCK = 1024
#: Longer runs are compared by blocks, in many tasks.
LIMIT = 8 * BLOCK
#: Hashing and moving a row costs as much as comparing so many pairs.
ROW_COST = 512
#: Rows that are multiplied at once with those before them.
TILE = 256
SEED = 11
#: Rows of a batch that are hashed or compared at once.
STEP = 4096
#: Passes that are sorted at the same time.
PASSES_AT_ONCE = 6
#: Bits fewer than those of a run, by which rows are dealt out to tasks; a task sorts the runs it gets.
COARSER = 3
#: Bytes in front of a code: its scale and what rounding took away, as 4-byte floats.
HEAD = 8


def bits_for(n: int, window: int = WINDOW) -> int:
    """Runs of evenly spread vectors hold about one or two windows."""
    return max(1, min(BITS, int(math.log2(max(2, n) / window)) if n > window else 1))


def passes_for(bits: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """A pair shares one bit with chance 1 - angle / pi, whatever the other vectors are, and a run if it shares all."""
    met = (1 - math.acos(threshold) / math.pi) ** bits
    return max(4, math.ceil(math.log1p(-recall) / math.log1p(-met)))


def directions(width: int, number: int) -> np.ndarray:
    return np.random.default_rng((SEED, width, number)).standard_normal((width, BITS))


def matrix(column: list[bytes], kind: str) -> np.ndarray:
    """Unit rows in double precision, from vectors of one length kept as bytes of numbers of that kind."""
    rows = np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def code(rows: np.ndarray) -> list[bytes]:
    """Unit rows as a byte for each component, behind their scale and the length of what that leaves out."""
    scale = (np.abs(rows).max(axis=1) / 127).astype(np.float32)
    small = np.rint(rows / scale[:, None].astype(np.float64)).clip(-127, 127).astype(np.int8)
    rest = rows - small * scale[:, None].astype(np.float64)
    # rounded up, and room for the arithmetic of 4-byte floats
    lost = (np.sqrt((rest * rest).sum(axis=1)) * 1.0001 + 1e-5).astype(np.float32)
    head = np.stack([scale, lost], axis=1)
    return [h + c for h, c in zip((x.tobytes() for x in head), (x.tobytes() for x in small), strict=True)]


def uncode(column: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rounded rows of codes of one length, in 4-byte floats, and what they leave out."""
    raw = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)
    head = np.ascontiguousarray(raw[:, :HEAD]).view(np.float32)
    return raw[:, HEAD:].view(np.int8) * head[:, :1], head[:, 1]


def decided(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For all pairs of two sets of codes: which link for certain, and which may."""
    about = a[0] @ b[0].T
    margin = a[1][:, None] + b[1][None, :] + 3 * a[1][:, None] * b[1][None, :]
    return about - margin >= threshold, np.abs(about - threshold) <= margin


def _kind(vectors: DataFrame) -> str:
    """The numbers that vectors are kept in: 4-byte floats where they are given so, else 8-byte ones."""
    return "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"


def _classes(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, d) with the class, null if the vector can't link, and the classes: d, rep (smallest vec_id), size, width, v (bytes)."""
    kind, id_type = _kind(vectors), vectors.schema["vec_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            # null vectors have no span of numbers, whatever lies below them
            sizes = pa.compute.list_value_length(column).fill_null(0).to_numpy()
            flat = column.flatten()
            numbers = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, kind)  # -0.0 is 0.0
            ends = np.cumsum(sizes)
            fine, some = np.concatenate([[0], np.cumsum(np.isfinite(numbers))]), np.concatenate([[0], np.cumsum(numbers != 0)])
            usable = (fine[ends] - fine[ends - sizes] == sizes) & (some[ends] > some[ends - sizes]) & ~batch.column("vec_id").is_null().to_numpy(zero_copy_only=False)
            raw = [numbers[a:b].tobytes() if ok else None for ok, a, b in zip(usable.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True)]
            digests = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "d", "v"])

    packed = scratch.save(small_batches(vectors).select("vec_id", "embedding").mapInArrow(pack, f"vec_id {id_type}, d binary, v binary"), "packed")
    size = int(kind[-1])
    groups = packed.filter("d is not null").groupBy("d").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("v").alias("v"))
    groups = groups.select("d", "rep", "size", (F.octet_length("v") / size).cast("int").alias("width"), "v")
    return packed.select("vec_id", "d"), scratch.save(groups, "classes")


def _keys(classes: DataFrame, kind: str, numbers: range, codes: bool = True) -> DataFrame:
    """part (pass and width in one number), key, d and, if asked for, code of every class in some passes."""
    names = ["part", "key", "d"] + ["code"] * codes

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                widths = part.column("width").to_numpy()
                for width in np.unique(widths).tolist():
                    own = part.filter(pa.array(widths == width))
                    rows = matrix(own.column("v").to_pylist(), kind)
                    rest = [own.column("d")] + ([pa.array(code(rows), pa.binary())] if codes else [])
                    for k in numbers:
                        if (width, k) not in made:
                            if len(made) > 256:
                                made.clear()
                            made[width, k] = directions(width, k)
                        bits = rows @ made[width, k] > 0
                        key = bits.astype(np.int64) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k << 32 | width, np.int64)), pa.array(key), *rest], names)

    return classes.select("d", "width", "v").mapInArrow(spread, "part long, key long, d binary" + ", code binary" * codes)


def bits_of(classes: DataFrame, kind: str, n: int, threshold: float, window: int, recall: float = RECALL) -> int:
    """How many bits a run shares: the count that costs least by the runs of the first pass; the recall is the same for all."""
    least = bits_for(n, window)
    if n <= LIMIT:
        return least
    tried = list(range(least, BITS + 1, 4))
    runs = _keys(classes, kind, range(1), False).select("part", "key", F.explode(F.array(*map(F.lit, tried))).alias("bits"))
    runs = runs.groupBy("part", "bits", F.expr(f"key div cast(pow(2, {BITS} - bits) as long)").alias("prefix")).count()
    pairs = {r["bits"]: r["pairs"] for r in runs.groupBy("bits").agg(F.sum(F.col("count") * F.col("count").cast("double")).alias("pairs")).collect()}
    return min(tried, key=lambda b: (passes_for(b, threshold, recall) * (pairs[b] + n * ROW_COST), b))


FOUND = "a binary, b binary, sure boolean, part long, prefix long"


def _found(ids: pa.Array, pairs: list[tuple[int, int]], sure: bool) -> pa.RecordBatch:
    sides = [ids.take(pa.array([p[k] for p in pairs], pa.int64())) if pairs else pa.array([], pa.binary()) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([*sides, pa.array([sure] * len(pairs), pa.bool_()), pa.nulls(len(pairs), pa.int64()), pa.nulls(len(pairs), pa.int64())], ["a", "b", "sure", "part", "prefix"])


def _edges(classes: DataFrame, kind: str, number: int, bits: int, threshold: float, window: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) that connect what the runs and windows of all passes have verified."""
    shift = BITS - bits

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the run and the window at the end of what came before
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                both = part if held is None else pa.concat_batches([held, part])
                sure, maybe, last = _linked(both, 0 if held is None else held.num_rows, threshold, window, shift)
                yield _found(both.column("d"), sure, True)
                yield _found(both.column("d"), maybe, False)
                if both.num_rows - last > LIMIT:  # the whole run is compared by blocks
                    end = both.slice(both.num_rows - 1)
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.bool_()), end.column("part"), pa.array([end.column("key")[0].as_py() >> shift], pa.int64())], ["a", "b", "sure", "part", "prefix"])
                    last = both.num_rows
                held = both.slice(max(0, min(last, both.num_rows - window)))

    names = []
    for start in range(0, number, PASSES_AT_ONCE):
        # runs whose first bits are alike are in one task, which sorts them
        dealt = _keys(classes, kind, range(start, min(number, start + PASSES_AT_ONCE))).withColumn("deal", F.shiftright("key", min(BITS - 1, shift + COARSER)))
        ordered = dealt.repartition("part", "deal").sortWithinPartitions("part", "key", "d").drop("deal")
        names.append(f"found{start}")
        scratch.save(ordered.mapInArrow(compare, FOUND), names[-1])
    found = scratch.spark.read.schema(FOUND).parquet(*[scratch.path(n) for n in names])
    run = ["part", "prefix"]
    long = scratch.save(found.filter("a is null").select(*run).distinct(), "long")
    both = found.filter("a is not null").select("a", "b", "sure")
    if long.limit(1).count():
        passes = [r["k"] for r in long.select(F.shiftright("part", 32).alias("k")).distinct().orderBy("k").collect()]  # at most the passes
        for k in passes:
            keys = _keys(classes, kind, range(k, k + 1)).withColumn("prefix", F.shiftright("key", shift))
            names.append(f"long{k}")
            scratch.save(_long(keys, long.filter(F.shiftright("part", 32) == k), threshold), names[-1])
            both = both.unionByName(scratch.spark.read.schema("a binary, b binary, sure boolean").parquet(scratch.path(names[-1])))
    asked = both.filter("not sure").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    v = classes.select("d", "v")
    asked = asked.join(v.toDF("a", "va"), "a").join(v.toDF("b", "vb"), "b")
    edges = scratch.save(both.filter("sure").select("a", "b").unionByName(_exact(asked, kind, threshold)).distinct(), "edges")
    scratch.drop(*names, "long")
    return edges


def _exact(pairs: DataFrame, kind: str, threshold: float) -> DataFrame:
    """pairs (a, va, b, vb) -> those (a, b) at the threshold or over it, in double precision."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                sizes = pa.compute.binary_length(part.column("va")).to_numpy()
                keep = np.zeros(part.num_rows, bool)
                for size in np.unique(sizes).tolist():
                    at = np.nonzero(sizes == size)[0]
                    own = part.take(pa.array(at))
                    keep[at] = (matrix(own.column("va").to_pylist(), kind) * matrix(own.column("vb").to_pylist(), kind)).sum(axis=1) >= threshold
                yield part.select(["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(verify, "a binary, b binary")


def _long(keys: DataFrame, long: DataFrame, threshold: float) -> DataFrame:
    """Links inside runs of more than LIMIT rows, every block against every block."""
    run = ["part", "prefix"]
    rows = keys.join(long, run).select(*run, "d", "code")
    sizes = rows.groupBy(*run).agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK)).cast("int").alias("blocks"))
    own = rows.join(sizes, run).withColumn("own", F.pmod(F.xxhash64("d"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(*run, "d", "code", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        a = group[group["own"] == group["i"].iloc[0]] if len(group) else group
        b = group[group["own"] == group["j"].iloc[0]] if len(group) else group
        if not len(a) or not len(b):
            return pd.DataFrame({"a": group["d"][:0], "b": group["d"][:0], "sure": pd.Series([], dtype=bool)})
        near, maybe = decided(uncode(a["code"].tolist()), uncode(b["code"].tolist()), threshold)
        ids = pd.concat([a["d"], b["d"]]).tolist()
        away = 0 if group["i"].iloc[0] == group["j"].iloc[0] else len(a)
        sure, asked = _reduced(len(ids), *_shifted(near, away), *_shifted(maybe, away))
        return pd.DataFrame([(ids[x], ids[y], True) for x, y in sure] + [(ids[x], ids[y], False) for x, y in asked], columns=["a", "b", "sure"]).astype({"sure": bool})

    return dealt.groupBy(*run, "i", "j").applyInPandas(compare, "a binary, b binary, sure boolean")


def _shifted(which: np.ndarray, away: int) -> tuple[np.ndarray, np.ndarray]:
    at, to = np.nonzero(which)
    to = to + away
    return at[at != to], to[at != to]


def _reduced(n: int, left: np.ndarray, right: np.ndarray, left2: np.ndarray, right2: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """A spanning forest of the certain pairs, and of the uncertain ones those whose ends it does not connect."""
    first, label = connected(n, left, right)
    open_ = label[left2] != label[right2]
    return [(int(x), i) for x, i in zip(first[label], range(n), strict=True) if x != i], list(zip(left2[open_].tolist(), right2[open_].tolist(), strict=True))


def connected(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each component, and the component of each place, by repeated minima of neighbours."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, before[left], low)
        np.minimum.at(root, before[right], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    first, label = np.unique(root, return_inverse=True)
    return first, label


def _linked(batch: pa.RecordBatch, old: int, threshold: float, window: int, shift: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]], int]:
    """Links of the rows from `old` on with those of their run and window before them: a forest of certain ones, uncertain ones; and where the last run starts."""
    parts, keys = (batch.column(n).to_numpy() for n in ("part", "key"))
    n = batch.num_rows
    new_part = np.r_[True, parts[1:] != parts[:-1]]
    new_run = new_part | np.r_[True, (keys[1:] >> shift) != (keys[:-1] >> shift)]
    at = np.arange(n)
    part, run = (np.maximum.accumulate(np.where(x, at, 0)) for x in (new_part, new_run))
    least = np.minimum(run, np.maximum(part, at - window))
    codes = batch.column("code")
    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
    for begin in np.nonzero(new_part)[0].tolist():
        end = int(np.searchsorted(part, begin, "right"))
        if end <= old:
            continue
        rows, lost = uncode(codes.slice(begin, end - begin).to_pylist())
        for start in range(max(begin, old), end, TILE):
            stop = min(end, start + TILE)
            low = int(least[start:stop].min())
            own, others = slice(start - begin, stop - begin), slice(low - begin, stop - begin)
            for k, which in enumerate(decided((rows[own], lost[own]), (rows[others], lost[others]), threshold)):
                i, j = np.nonzero(which)
                i, j = i + start, j + low
                mine = (j < i) & (j >= least[i])
                found[2 * k].append(j[mine])
                found[2 * k + 1].append(i[mine])
    sure, maybe = _reduced(n, *(np.concatenate(x) for x in found))
    return sure, maybe, int(run[-1]) if n else 0


def _counts(members: DataFrame, scratch: Scratch, kind: str, threshold: float) -> DataFrame:
    """members (d, c, size, width, v) of groups -> d, n: how many vectors of other classes each class links with."""
    pivots = scratch.save(members.filter("d = c").select("c", F.col("v").alias("pv")), "pivots")
    half = math.cos(math.acos(threshold) / 2) + 1e-9

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                core = np.zeros(part.num_rows, bool)
                widths = part.column("width").to_numpy()
                for width in np.unique(widths).tolist():
                    at = np.nonzero(widths == width)[0]
                    own = part.take(pa.array(at))
                    core[at] = (matrix(own.column("v").to_pylist(), kind) * matrix(own.column("pv").to_pylist(), kind)).sum(axis=1) >= half
                yield pa.RecordBatch.from_arrays([part.column(n) for n in ("d", "c", "size", "v")] + [pa.array(core)], ["d", "c", "size", "v", "core"])

    placed = members.join(pivots, "c").select("d", "c", "size", "width", "v", "pv").mapInArrow(place, "d binary, c binary, size long, v binary, core boolean")
    placed = scratch.save(placed, "placed")
    sums = placed.groupBy("c").agg(F.sum(F.when(F.col("core"), F.col("size"))).alias("core_size"), F.count(F.lit(1)).alias("m"), F.count_if(~F.col("core")).alias("f"))
    sums = scratch.save(sums, "sums")
    inside = placed.filter("core").join(sums.select("c", "core_size"), "c").select("d", (F.col("core_size") - F.col("size")).alias("n"))
    # members of groups that have vectors outside of the core, in blocks against blocks of those
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK)).cast("int")
    open_ = placed.join(sums.filter("f > 0").select("c", blocks("m").alias("mb"), blocks("f").alias("fb")), "c")
    own = lambda n: F.pmod(F.xxhash64("d"), F.col(n)).cast("int")
    rows = open_.select("d", "c", "size", "v", "core", F.lit(False).alias("asks"), own("mb").alias("i"), F.explode(F.expr("sequence(0, fb - 1)")).alias("j"))
    asks = open_.filter("not core").select("d", "c", "size", "v", "core", F.lit(True).alias("asks"), F.explode(F.expr("sequence(0, mb - 1)")).alias("i"), own("fb").alias("j"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        a, b = group[group["asks"]], group[~group["asks"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"d": group["d"][:0], "n": pd.Series([], dtype="int64")})
        near = matrix(b["v"].tolist(), kind) @ matrix(a["v"].tolist(), kind).T >= threshold
        number = pd.factorize(pd.concat([b["d"], a["d"]]))[0]
        near &= number[: len(b), None] != number[None, len(b) :]
        core = b["core"].to_numpy()
        out = pd.DataFrame({"d": np.concatenate([a["d"], b["d"][core]]), "n": np.concatenate([b["size"].to_numpy() @ near, near[core] @ a["size"].to_numpy()])})
        return out[out["n"] > 0]

    outside = rows.unionByName(asks).groupBy("c", "i", "j").applyInPandas(compare, "d binary, n long")
    counts = scratch.save(inside.unionByName(outside).groupBy("d").agg(F.sum("n").alias("n")), "counts")
    scratch.drop("pivots", "placed", "sums")
    return counts


def link(vectors: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, window: int = WINDOW, passes: int | None = None) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, n_links, component_id, kept."""
    kind = _kind(vectors)
    rows, classes = _classes(vectors, scratch)
    bits = bits_of(classes, kind, classes.count(), threshold, window)
    edges = _edges(classes, kind, passes or passes_for(bits, threshold), bits, threshold, window, scratch)
    comp = components(edges, scratch)
    tops = comp.select(F.col("component").alias("d")).distinct()
    groups = comp.select(F.col("node").alias("d"), F.col("component").alias("c")).unionByName(tops.select("d", F.col("d").alias("c")))
    members = scratch.save(groups.join(classes, "d").select("d", "c", "rep", "size", "width", "v"), "members")
    counts = _counts(members, scratch, kind, threshold)
    # a group is named by its smallest vec_id
    names = members.groupBy("c").agg(F.min("rep").alias("top"))
    placed = members.select("d", "c").join(names, "c").select("d", "top")
    of_class = classes.select("d", "rep", "size").join(placed, "d", "left").join(counts, "d", "left")
    of_class = scratch.save(of_class.select("d", F.coalesce("top", "rep").alias("c"), (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n")), "of_class")
    scratch.only("packed", "of_class")
    found = rows.filter("d is not null").join(of_class, "d").select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("c").alias("component_id"), (F.col("vec_id") == F.col("c")).alias("kept"))
    alone = rows.filter("d is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return found.unionByName(alone)


def query(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"), Scratch(spark, "neardup"))
