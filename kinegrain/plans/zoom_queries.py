"""Queries over the virtual camera. Events stand in for gyro samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinegrain.operators import motion, zoom
from kinegrain.plans.motion_queries import SQL as MOTION_SQL
from kinegrain.plans.motion_queries import _rates, marked

LENS = zoom.Lens(3264, 2170, 12, 5, 3240, 2160, 2800.0)
SETTINGS = zoom.Settings(smoothness=0.3, readout_s=0.0248, max_zoom=1.5)


def _orientations(spark: SparkSession, sf_dir: str, dt: float = 0.02) -> DataFrame:
    q = motion.integrate_streams(_rates(spark, sf_dir), "user_id", "i", ["a", "b", "c"], dt)
    return q.withColumnRenamed("user_id", "clip")


def zoom_bisect(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = marked(spark, sf_dir).select(F.col("user_id").alias("clip"), F.col("i").alias("frame"), (F.col("i") * 0.02).alias("t"), "ok").withColumnRenamed("ok", "valid")
    out = zoom.stabilise(frames, _orientations(spark, sf_dir), 50.0, LENS, SETTINGS)
    return out.select("clip", "frame", F.round("zoom", 4).alias("zoom"), F.round("shutter", 4).alias("shutter"), "limited")


def fade_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = marked(spark, sf_dir).select(F.col("user_id").alias("clip"), F.col("i").alias("frame"), (F.col("i") * 0.02).alias("t"), F.lit(True).alias("valid"))
    settings = zoom.Settings(smoothness=0.3, max_zoom=1.5, dynamic=True, zoom_smooth=0.4, ends_early=True)
    out = zoom.stabilise(frames, _orientations(spark, sf_dir), 50.0, LENS, settings)
    return out.select("clip", "frame", F.round("zoom", 4).alias("zoom"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


def blend_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orientations mixed with the next sample's by a share, along the shorter way."""
    q = _orientations(spark, sf_dir, 0.1)
    b = q.select("clip", (F.col("i") - 1).alias("i"), *[F.col(c).alias(f"{c}1") for c in "wxyz"])
    j = q.join(b, ["clip", "i"])
    dot = F.col("w") * F.col("w1") + F.col("x") * F.col("x1") + F.col("y") * F.col("y1") + F.col("z") * F.col("z1")
    side = F.when(dot < 0, -1.0).otherwise(1.0)
    mixed = {c: F.col(c) + (side * F.col(f"{c}1") - F.col(c)) * 0.3 for c in "wxyz"}
    n = F.sqrt(sum((m * m for m in mixed.values()), F.lit(0.0)))
    return j.select("clip", "i", *[F.round(m / n, 6).alias(c) for c, m in mixed.items()])


def warp_knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row of the rotation of every sample's camera, as the knots of a warp are made."""
    q = _orientations(spark, sf_dir, 0.1)
    w, x, y, z = (F.col(c) for c in "wxyz")
    return q.select(
        "clip", "i", F.round(1 - 2 * (y * y + z * z), 6).alias("m00"), F.round(2 * (x * y - w * z), 6).alias("m01"), F.round(2 * (x * z + w * y), 6).alias("m02"))


QUERIES = {f.__name__: f for f in (zoom_bisect, fade_zoom, blend_paths, warp_knots)}

_INTEGRATED = MOTION_SQL["quaternion_integrate"].rpartition("SELECT user_id, i, round(w, 6)")[0]
_DOT = "(a.w * b.w + a.x * b.x + a.y * b.y + a.z * b.z)"
SQL = {
    "warp_knots": _INTEGRATED + "SELECT user_id AS clip, i, round(1 - 2 * (y * y + z * z), 6) AS m00, round(2 * (x * y - w * z), 6) AS m01, round(2 * (x * z + w * y), 6) AS m02 FROM q",
    "blend_paths": _INTEGRATED.rstrip() + f""",
m AS (SELECT a.user_id, a.i, {', '.join(f'0.7::DOUBLE * a.{c} + 0.3::DOUBLE * b.{c} * CASE WHEN {_DOT} < 0 THEN -1 ELSE 1 END AS {c}' for c in 'wxyz')} FROM q a JOIN q b ON b.user_id = a.user_id AND b.i = a.i + 1)
SELECT user_id AS clip, i, {', '.join(f'round({c} / sqrt(w * w + x * x + y * y + z * z), 6) AS {c}' for c in 'wxyz')} FROM m""",
}
