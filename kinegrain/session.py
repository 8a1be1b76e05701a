"""Session settings and small helpers that every subpackage shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings that change results, not speed: the oracle compares UTC wall clocks.
REQUIRED = {"spark.sql.session.timeZone": "UTC"}


def get_session(app: str = "kinegrain", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this package relies on.

    An existing session is reused; sizes (memory, partitions) are left to the
    cluster unless passed in ``conf``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables. Only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
