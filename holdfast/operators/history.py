"""Audit rows and jobs, as pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import cursor


def object_history(history: DataFrame, object_id: str, limit: int, after: tuple[int, int] | None = None) -> DataFrame:
    """history (history_id, object_id, time_ms, ...): one object's rows by time and id, limit + 1 of them behind a key."""
    rows = history.filter(F.col("object_id") == object_id)
    if after is not None:
        rows = rows.filter(cursor.after(["time_ms", "history_id"], list(after)))
    return rows.orderBy("time_ms", "history_id").limit(limit + 1)


def subject_history(items: DataFrame, subject: str, offset: int, limit: int) -> DataFrame:
    """items (origin_id, origin_seq, item_index, item map): log items that name the subject, by position, from an offset."""
    named = F.exists(F.map_values("item"), lambda v: v == subject)
    return items.filter(named).orderBy("origin_id", "origin_seq", "item_index").offset(offset).limit(limit + 1)


def jobs(table: DataFrame, every: bool = False) -> DataFrame:
    """Running jobs, or all, newest first."""
    return (table if every else table.filter(F.col("status") == "running")).orderBy(F.desc("started_ms"), "job_id")


def scan_counts(events: DataFrame) -> DataFrame:
    """events (scan_id, file_id, change, integrity) -> new, changed, and verified files of each scan."""
    return events.groupBy("scan_id").agg(F.count_if(F.col("change") == "new").alias("new"), F.count_if(F.col("change") == "changed").alias("changed"), F.count_distinct(F.when(F.col("integrity") == "verified", F.col("file_id"))).alias("verified"))


def acceptance_preview(files: DataFrame, observed: DataFrame) -> DataFrame:
    """Active, resolved files (file_id, expected, state, identity_state, annex) whose observed digest differs from what is expected."""
    fit = (F.col("state") == "active") & (F.col("identity_state") == "resolved") & ~F.col("annex")
    return files.filter(fit).join(observed, "file_id").filter(~F.col("expected").eqNullSafe(F.col("observed"))).select("file_id", "expected", "observed")
