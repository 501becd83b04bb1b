"""Settings by precedence: what is given, then the session's configuration, then the environment, then a default."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def resolve(given: str | None, key: str, default: str, spark: SparkSession | None = None) -> str:
    """The value of `key`: in the session as `spark.sheetloom.<key>`, in the environment as SHEETLOOM_<KEY>. Blank counts as unset."""
    configured = spark.conf.get(f"spark.sheetloom.{key}", None) if spark else None
    found = (v.strip() for v in (given, configured, os.environ.get(f"SHEETLOOM_{key.upper()}")) if v)
    return next((v for v in found if v), default)
