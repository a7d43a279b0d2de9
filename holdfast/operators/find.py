"""Selections of expected paths by where and how well their copies are kept."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import cursor, predicates as p
from holdfast.sources.adapter import Catalog

MAX_GROUPS, MAX_LOCATIONS, MAX_PAGE = 32, 2048, 1000
KEY = ["collection_id", "path_encoding", "path_bytes"]


@dataclass(frozen=True)
class Group:
    """At least one of the locations holds a verified copy (or none does, if negated)."""

    locations: tuple[str, ...]
    negated: bool = False
    verified_within: int | None = None


@dataclass(frozen=True)
class Filter:
    collection: str | None = None
    object_id: str | None = None
    identity: str | None = None
    path: tuple[str, bytes] | None = None
    prefix: tuple[str, bytes] | None = None
    copies_below: int | None = None
    verified_copies: bool = False
    verified_within: int | None = None
    absent_from: str | None = None
    groups: tuple[Group, ...] = field(default=())

    def check(self) -> None:
        if self.path and self.prefix:
            raise ValueError("choose a path or a prefix")
        if len(self.groups) > MAX_GROUPS or sum(len(g.locations) for g in self.groups) > MAX_LOCATIONS:
            raise ValueError("too many location selectors")
        if self.copies_below is None and (self.verified_copies or self.verified_within is not None):
            raise ValueError("counting verified copies needs copies_below")
        if any(not g.locations for g in self.groups):
            raise ValueError("a location group is empty")
        if self.identity not in (None, "resolved", "unresolved", "unknown"):
            raise ValueError(f"unsupported identity state: {self.identity}")


def _with_expected(files: DataFrame, objects: DataFrame) -> DataFrame:
    return files.join(objects.select("object_id", "expected"), "object_id")


def find_objects(c: Catalog, want: Filter, as_of: int) -> DataFrame:
    """Objects that meet all clauses. Groups fold into semi and anti joins on object_id; counts are aggregated before they are joined."""
    want.check()
    out = c.objects
    if want.collection is not None:
        out = out.filter(F.col("collection_id") == want.collection)
    if want.object_id is not None:
        out = out.filter(F.col("object_id") == want.object_id)
    if want.identity:
        out = out.filter(F.col("expected").isNotNull() if want.identity == "resolved" else F.col("expected").isNull())
    if want.path:
        out = out.filter((F.col("path_encoding") == want.path[0]) & (F.col("path_bytes") == F.lit(want.path[1])))
    if want.prefix:
        out = out.filter((F.col("path_encoding") == want.prefix[0]) & p.has_prefix("path_bytes", want.prefix[1]))
    if want.groups:
        out = out.filter(F.col("expected").isNotNull())
    base = out
    if want.absent_from is not None:
        there = c.files.filter((F.col("location_id") == want.absent_from) & (F.col("presence") == "present")).select("object_id")
        out = out.join(there, "object_id", "left_anti")
    for g in want.groups:
        held = c.files.filter(F.col("location_id").isin(*g.locations) & (F.col("presence") == "present") & (F.col("integrity") == "verified") & (F.col("last_check_result") == "ok"))
        good = _with_expected(held, base).filter(p.verified_copy() & p.within("last_success_ms", as_of, g.verified_within)).select("object_id")
        out = out.join(good, "object_id", "left_anti" if g.negated else "left_semi")
    if want.copies_below is not None:
        if want.verified_copies or want.verified_within is not None:
            counted = _with_expected(c.files, base).filter(p.verified_copy() & p.within("last_success_ms", as_of, want.verified_within))
        else:
            counted = c.files.filter(F.col("presence") == "present")
        counts = counted.groupBy("object_id").agg(F.count(F.lit(1)).alias("_n"))
        out = out.join(counts, "object_id", "left").filter(F.coalesce("_n", F.lit(0)) < want.copies_below).drop("_n")
    return out


def page(rows: DataFrame, limit: int, after: list | None = None, key: list[str] = KEY) -> DataFrame:
    """limit + 1 rows behind a key, in key order: the further one tells that there is more."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError("a page has 1 to 1000 rows")
    rows = rows if after is None else rows.filter(cursor.after(key, after))
    return rows.orderBy(*key).limit(limit + 1)


def show_objects(c: Catalog, objects: DataFrame) -> DataFrame:
    """Each object with its file rows, locations and devices, ordered by location name and id."""
    rows = objects.join(c.files, "object_id", "left").join(c.locations.select("location_id", F.col("display_name").alias("location_name"), "site_id", "device_id"), "location_id", "left")
    rows = rows.join(c.devices.select("device_id", "current_site_id"), "device_id", "left")
    entry = F.struct("location_name", "location_id", "presence", "integrity", "last_success_ms", p.location_first_site().alias("site"))
    return rows.groupBy("object_id", "collection_id").agg(F.array_sort(F.collect_list(F.when(F.col("location_id").isNotNull(), entry))).alias("copies"))


def removal_preview(c: Catalog, want: Filter, as_of: int) -> DataFrame:
    """Files of the one location of the first group that a removal would mark; they must not be missing already."""
    first = want.groups[0] if want.groups else None
    if first is None or first.negated or len(first.locations) != 1:
        raise ValueError("the first group must name the one location to remove from")
    there = c.files.filter((F.col("location_id") == first.locations[0]) & (F.col("presence") != "missing"))
    active = c.locations.filter(F.col("status") == "active").select("location_id")
    there = there.join(active, "location_id", "left_semi")
    return find_objects(c, want, as_of).join(there.select("object_id", "location_id", "presence", "integrity", "last_check_ms", "observed"), "object_id")


def mark_removed(c: Catalog, selected: DataFrame, at: int) -> DataFrame:
    """The files table after removal: selected rows become missing and unverified; what was observed stays."""
    newer = F.col("last_check_ms") > at
    rows = c.files.join(selected.select("object_id", "location_id", F.lit(True).alias("_gone")), ["object_id", "location_id"], "left")
    gone = F.col("_gone").isNotNull()
    checked = F.when(gone & newer, F.raise_error(F.lit("a selected check is newer than the removal"))).otherwise(F.when(gone, F.lit(at)).otherwise(F.col("last_check_ms")))
    return rows.select(
        "object_id", "location_id", F.when(gone, "missing").otherwise(F.col("presence")).alias("presence"), F.when(gone, "unverified").otherwise(F.col("integrity")).alias("integrity"),
        checked.cast("long").alias("last_check_ms"), F.when(gone, "missing").otherwise(F.col("last_check_result")).alias("last_check_result"), "observed", "last_success_ms",
    )


def host_copy(c: Catalog, source: str, destination: str, as_of: int, extra: tuple[Group, ...] = (), collection: str | None = None) -> DataFrame:
    """What to copy: verified at the source, and not present at the destination, however good the copy there is."""
    return find_objects(c, Filter(collection=collection, groups=(Group((source,)), *extra), absent_from=destination), as_of)


def host_remove(c: Catalog, target: str, backups: tuple[str, ...], age: int, as_of: int, collection: str | None = None) -> DataFrame:
    """What may go from the target: backups on other devices hold it. last_verified is the newest proof; it expires `age` later."""
    found = find_objects(c, Filter(collection=collection, groups=(Group((target,)), Group(backups, verified_within=age))), as_of)
    proofs = _with_expected(c.files.filter(F.col("location_id").isin(*backups)), found).filter(p.verified_copy() & p.within("last_success_ms", as_of, age))
    newest = proofs.groupBy("object_id").agg(F.max("last_success_ms").alias("last_verified"))
    return found.join(newest, "object_id").withColumn("expires", F.col("last_verified") + age)


def due_for_verification(c: Catalog, location: str, cutoff: int, everything: bool = False, done: DataFrame | None = None) -> DataFrame:
    due = (F.col("integrity") != "verified") | (F.col("presence") != "present") | F.col("last_success_ms").isNull() | (F.col("last_success_ms") <= cutoff)
    rows = c.files.filter((F.col("location_id") == location) & (F.lit(everything) | due))
    return rows if done is None else rows.join(done, "object_id", "left_anti")


def copy_worklist(c: Catalog, source: str, destination: str) -> DataFrame:
    """Verified at the source and without a verified copy at the destination; when it was verified does not matter."""
    good = (F.col("presence") == "present") & (F.col("integrity") == "verified") & (F.col("last_check_result") == "ok") & (F.col("observed") == F.col("expected"))
    held = _with_expected(c.files, c.objects).filter(good)
    at = lambda x: held.filter(F.col("location_id") == x).select("object_id")
    return c.objects.join(at(source), "object_id", "left_semi").join(at(destination), "object_id", "left_anti")


def resolve(c: Catalog, names: DataFrame, root: bytes) -> DataFrame:
    """names (name binary) -> object_id by the first of: exact relative path, object id, absolute path below `root`. More than one is ambiguous."""
    low = root.rstrip(b"/") + b"/"
    ranked = [
        names.join(c.objects, F.col("name") == F.col("path_bytes")).select("name", "object_id", F.lit(1).alias("rank")),
        names.join(c.objects, F.col("name") == F.col("object_id").cast("binary")).select("name", "object_id", F.lit(2).alias("rank")),
        names.filter(p.has_prefix("name", low)).withColumn("rest", F.expr(f"substring(name, {len(low) + 1})")).join(c.objects, F.col("rest") == F.col("path_bytes")).select("name", "object_id", F.lit(3).alias("rank")),
    ]
    every = ranked[0].union(ranked[1]).union(ranked[2])
    best = every.groupBy("name").agg(F.min("rank").alias("rank"))
    found = every.join(best, ["name", "rank"]).groupBy("name", "rank").agg(F.count(F.lit(1)).alias("n"), F.min("object_id").alias("object_id"))
    return names.join(found, "name", "left").select("name", F.when(F.col("n") == 1, F.col("object_id")).alias("object_id"), F.coalesce("n", F.lit(0)).alias("matches"))
