"""Session defaults."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "tesserae", cores: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; on one machine, a shuffle partition for each core."""
    n = cores or os.environ.get("BENCH_CPUS", "*")
    builder = SparkSession.builder.appName(app)
    if "spark.master" not in conf and not os.environ.get("MASTER"):
        builder = builder.master(f"local[{n}]")
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(n if n.isdigit() else os.cpu_count() or 8),
        "spark.sql.parquet.filterPushdown": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
