"""Predicates and expressions that operators share. Every freshness convention has a helper of its own."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def verified_copy(expected: str = "expected") -> Column:
    """A copy that its last check found good. Null digests make it null, which filters treat as false."""
    return (F.col("presence") == "present") & (F.col("integrity") == "verified") & (F.col("last_check_result") == "ok") & (F.col("observed") == F.col(expected)) & F.col("last_success_ms").isNotNull()


def within(time: str, as_of: int, age: int | None) -> Column:
    """Catalog freshness: both ends count, the future does not."""
    if age is None:
        return F.lit(True)
    return F.col(time).between(max(0, as_of - age), as_of)


def policy_age_faults(time: str, days: Column, now: int) -> dict[str, Column]:
    """Policy freshness: missing and future times are faults; stale at exactly time + age. At most one of these holds."""
    at = F.col(time)
    return {"time_missing": at.isNull(), "time_in_future": at > now, "stale": (at <= now) & (at + days * DAY_MS <= now)}


def policy_age_reason(time: str, days: Column, now: int, label: str) -> Column:
    return F.coalesce(*[F.when(fault, f"{label}_{name}") for name, fault in policy_age_faults(time, days, now).items()])


def policy_expiry(time: str, days: Column, now: int) -> Column:
    """When evidence that is fresh now stops being so."""
    at = F.col(time)
    return F.when((at <= now) & (at + days * DAY_MS > now), at + days * DAY_MS)


def prefix_upper(prefix: bytes) -> bytes | None:
    """The least byte string above all that start with the prefix; none if it is all FF."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def has_prefix(column: str, prefix: bytes) -> Column:
    """As a range, so that it reaches the scan's statistics."""
    upper = prefix_upper(prefix)
    low = F.col(column) >= F.lit(prefix)
    return low if upper is None else low & (F.col(column) < F.lit(upper))


def under_any(column: str, prefixes: Iterable[bytes]) -> Column:
    """The path is one of the prefixes or lies below it."""
    out = F.lit(False)
    for p in prefixes:
        out = out | (F.col(column) == F.lit(p)) | F.col(column).startswith(F.lit(p + b"/"))
    return out


def location_first_site(location: str = "site_id", device: str = "current_site_id") -> Column:
    return F.coalesce(location, device)


def device_first_site(location: str = "site_id", device: str = "current_site_id") -> Column:
    return F.coalesce(device, location)


def content_key(content: str = "content_id", external: str = "external_id", file: str | None = "file_id") -> Column:
    """One key for content known by digest, else by external identity, else by file."""
    key = F.when(F.col(content).isNotNull(), F.concat(F.lit("object:"), F.col(content))).when(F.col(external).isNotNull(), F.concat(F.lit("external:"), F.col(external)))
    return key.otherwise(F.concat(F.lit("file:"), F.col(file))) if file else key


def flag(condition: Column) -> Column:
    """A three-valued condition as 0 or 1."""
    return F.when(condition, 1).otherwise(0)


def total(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))
