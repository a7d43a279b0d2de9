"""Session settings that every entry point of the library shares."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: UTC and AQE are semantic or safety settings; partition counts belong to the caller's cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # call sites of every column expression, which take longer to find out than small queries to run
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: int | None = None, name: str = "holdfast") -> SparkSession:
    """A local[N] session, as the tests and bench.py use it."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", os.environ.get("HOLDFAST_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
