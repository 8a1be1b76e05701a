"""Tables written to the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder. Only where it is unset, as in
tests on one machine, a folder of our own is made. A table written here cuts
the lineage: a lost executor costs the tasks that ran on it, not the result.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI without a trailing slash."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="kinegrain-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/kinegrain/{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean() -> None:
    """Remove what this process has written; runs at exit as well."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone by now; the folder is temporary anyway
            continue


atexit.register(clean)


#: Bytes of an Arrow batch that goes to a Python worker; texts vary too much for a bound on rows alone.
BATCH_BYTES = 4 << 20


def bound_batches(df: DataFrame) -> None:
    """Bound the session's Arrow batches by bytes, unless it has a smaller bound already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    try:
        now = int(conf.get(key).lower().removesuffix("b"))
    except ValueError:  # written with a unit, so set by someone
        return
    if now <= 0 or now > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's size of a plan, which for a scan is its files' size; 0 where it knows none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < int(df.sparkSession.conf.get("spark.sql.defaultSizeInBytes", str(1 << 62))) >> 8 else 0


#: Tasks of one shuffle; where that many are not enough for partitions of the size asked for, these grow and are sorted on disk.
MOST_PARTITIONS = 50_000


def partitions_for(df: DataFrame, mb: int = 32) -> int:
    """Partitions of about ``mb`` MB, no fewer than the session's setting.

    For a plan whose size the optimizer does not know, as a relation made in
    memory, the session's setting is all there is to go by.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(-(-size_in_bytes(df) // (mb << 20)), MOST_PARTITIONS))
