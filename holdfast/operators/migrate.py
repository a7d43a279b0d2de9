"""From logged evidence to one expected digest and one state for each file."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_expectation(expectations: DataFrame, projected: DataFrame, frontiers: DataFrame) -> DataFrame:
    """expectations (file_id, hash, origin_id, seq, item, record_id) of the projected hash (file_id, hash) -> the one that nothing follows.

    a precedes b within an origin by (seq, item), and between origins if b's record had seen a's. The
    order of independent ones is that of origin, seq and item. frontiers: record_id, origin_id, seq.
    """
    rows = expectations.join(projected, ["file_id", "hash"], "left_semi")
    seen = frontiers.groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("origin_id", "seq"))).alias("seen"))
    rows = rows.join(seen, "record_id", "left").select("file_id", "hash", "origin_id", "seq", "item", "record_id", "seen")

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        # one row after another of those whose origin has nothing before them and that have seen nothing else that is left
        left: dict[str, list[dict]] = {}
        for row in group.sort_values(["origin_id", "seq", "item"], ascending=False).to_dict("records"):
            row["seen"] = dict(row["seen"] or {}) if isinstance(row["seen"], dict | list) else {}
            left.setdefault(row["origin_id"], []).append(row)
        last = None
        while left:
            free = next((o for o in sorted(left) if all(x[-1]["seq"] > left[o][-1]["seen"].get(other, 0) for other, x in left.items() if other != o)), None)
            if free is None:
                raise ValueError(f"cyclic expectations of {group['file_id'].iloc[0]}")
            last = left[free].pop()
            if not left[free]:
                del left[free]
        return pd.DataFrame([{k: last[k] for k in ("file_id", "hash", "origin_id", "seq", "item", "record_id")}])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "seen")
    return rows.groupBy("file_id").applyInPandas(settle, kind)


def mapped_state(copies: DataFrame) -> DataFrame:
    """Presence and integrity of a copy in three states each, from its logged state, last check and error."""
    state, error = F.col("state"), F.col("error_code")
    presence = F.when(state == "missing", "missing").when(state.isin("present", "corrupt") & ~F.coalesce(error == "read_error", F.lit(False)), "present").otherwise("unknown")
    integrity = F.when((state == "corrupt") | (F.col("integrity_code") == 2), "damaged").when((state == "present") & (F.col("integrity_code") == 1) & error.isNull(), "verified").otherwise("unverified")
    return copies.select("copy_id", "location_id", presence.alias("presence"), integrity.alias("integrity"))
