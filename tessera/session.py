"""Session helpers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it (on a cluster, ship it with --py-files)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([*paths, ROOT])
    return spark


def create(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and last-wins maps."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"} | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return reachable(builder.getOrCreate())
