"""Catalogs as folders."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from holdfast.plans import registry
from holdfast.sources import store
from holdfast.sources.adapter import TABLES, catalog

SF = "/root/testdata/sf0.001"


def test_stored_catalogs(spark, tmp_path):
    made, root = catalog(spark, SF), f"file://{tmp_path}/a"
    store.create(made, root)
    with pytest.raises(FileExistsError):
        store.create(made, root)
    found = store.open_catalog(spark, root)
    assert {r["table"]: r["whole"] for r in store.status(spark, root).collect()} == dict.fromkeys(TABLES, True)
    name = "k07_location_totals"
    assert sorted(map(str, registry.OF_CATALOG[name](found).collect())) == sorted(map(str, registry.QUERIES[name](spark, SF).collect()))
    rows = store.backup(spark, root, f"file://{tmp_path}/b").collect()
    assert len(rows) == len(TABLES) and all(r["equal"] for r in rows)
    # a lost file, another schema, another version, no manifest
    part = next(x for x in sorted(os.listdir(tmp_path / "b/sites")) if x.startswith("part"))
    os.remove(tmp_path / "b/sites" / part)
    found.sites.limit(3).write.mode("append").parquet(f"{tmp_path}/b/sites")
    assert not {r["table"]: r["whole"] for r in store.status(spark, f"file://{tmp_path}/b").collect()}["sites"]
    assert not {r["table"]: r["equal"] for r in store.compare(found, store.open_catalog(spark, f"file://{tmp_path}/b")).collect()}["sites"]
    shutil.rmtree(tmp_path / "b/sites")
    found.sites.withColumn("status", F.lit(1)).write.parquet(f"{tmp_path}/b/sites")
    with pytest.raises(store.NotACatalog, match="another schema"):
        store.open_catalog(spark, f"file://{tmp_path}/b")
    manifest = tmp_path / "b/manifest.json"
    text = json.loads(manifest.read_text())
    os.remove(manifest)
    for crc in (tmp_path / "b").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(store.NotACatalog, match="no manifest"):
        store.open_catalog(spark, f"file://{tmp_path}/b")
    manifest.write_text(json.dumps(text | {"version": 2}))
    with pytest.raises(store.NotACatalog, match="another version"):
        store.open_catalog(spark, f"file://{tmp_path}/b")
