"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that matter for correctness (time zone) or for plans at scale (adaptive execution).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Encodings beyond Spark's short list, such as windows-1252.
    "spark.sql.legacy.javaCharsets": "true",
    # Above this size the JVM leaves generated methods uncompiled; Spark then splits them instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(master: str | None = None, app: str = "twinledger", **conf: str) -> SparkSession:
    """Create or reuse a session with :data:`SETTINGS`; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
