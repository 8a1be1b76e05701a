"""From the blocks of a clip's frames to a track: samples without gaps and the frame table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinegrain.operators import motion

#: A track's sample rate must lie between these.
RATES = (100.0, 100_000.0)


def timed_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of the main take with elapsed time, gaps and the samples after each.

    ``blocks`` holds (clip, number, frame, clock_us, lost, take, samples): the
    frame's place in the clip and its block's fields; rows without samples
    (null) carry no block. Clips with fewer than two blocks give no rows.
    """
    present = blocks.where("samples IS NOT NULL").withColumn("n", F.size("samples"))
    kept = motion.keep_take(present, "clip", "number", "take", "frame")
    count = Window.partitionBy("clip")
    kept = kept.withColumn("__k", F.count("*").over(count)).where("__k >= 2").drop("__k")
    timed = motion.unwrap_clock(kept, "clip", "number", "clock_us")
    w = Window.partitionBy("clip").orderBy("number")
    timed = timed.withColumn("dt", F.col("elapsed") - F.lag("elapsed").over(w))
    good = (F.col("lost") == 0) & (F.col("dt") > 0) & (F.col("n") > 0)
    rate = timed.groupBy("clip").agg(motion.upper_median(F.col("n") * 1e6 / F.when(good, F.col("dt")), good).alias("block_rate"))
    gaps = motion.detect_gaps(timed.join(rate, "clip"), "clip", "number", "elapsed", "n", "lost", "block_rate")
    return gaps.withColumn("after", F.sum(F.col("n") + F.col("gap")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def clip_rates(timed: DataFrame) -> DataFrame:
    """(clip, rate_hz, lost): samples after the first mark over the clock's span; impossible rates are left out."""
    span = timed.groupBy("clip").agg(
        ((F.max_by("after", "number") - F.min_by("after", "number")) * 1e6 / F.max("elapsed")).alias("rate_hz"), F.sum("gap").alias("lost"))
    return span.where(F.col("rate_hz").between(*RATES))


def samples(timed: DataFrame) -> DataFrame:
    """(clip, i, x, y, z) of every sample, missing ones on a straight line across their gap."""
    own = timed.select("clip", (F.col("after") - F.col("n")).alias("__base"), F.posexplode("samples").alias("__k", "s"))
    own = own.select("clip", (F.col("__base") + F.col("__k")).alias("i"), *[F.col(f"s.{c}").cast("bigint").alias(c) for c in "xyz"])
    ends = timed.select("clip", "number", "gap", "after", "n", *[F.try_element_at("samples", F.lit(k))[c].alias(f"{c}{k}") for k in (1, -1) for c in "xyz"])
    line = motion.fill_gaps(ends, "clip", "number", "gap", ["x1", "y1", "z1"], ["x-1", "y-1", "z-1"])
    at = ends.select("clip", "number", (F.col("after") - F.col("n") - F.col("gap")).alias("__base"))
    filled = line.join(at, ["clip", "number"]).select(
        "clip", (F.col("__base") + F.col("j") - 1).alias("i"), *[F.col(f"axis{k}").alias(c) for k, c in enumerate("xyz")])
    return own.unionByName(filled)


def frame_table(timed: DataFrame, files: DataFrame, fps: float) -> DataFrame:
    """(clip, frame, n, valid) for every number up to the last file or block of each clip.

    ``files`` holds the (clip, number) of files that exist.
    """
    numbers = files.select("clip", "number").unionByName(timed.select("clip", "number"))
    last = numbers.groupBy("clip").agg(F.max("number").alias("last"))
    every = last.select("clip", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last").cast("bigint"))).alias("number"))
    frames = every.join(files.select("clip", "number", F.lit(True).alias("exists")).distinct(), ["clip", "number"], "left")
    frames = frames.join(timed.select("clip", "number", "after", "gap", "broken"), ["clip", "number"], "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    rate = clip_rates(timed)
    # What a frame takes differs from clip to clip, so marks before the first block are set afterwards.
    table = motion.frame_table(frames, "clip", "number", "after", "gap", "broken", "exists", 0.0)
    first = timed.groupBy("clip").agg(F.min("number").alias("__first"), F.min_by("after", "number").alias("__after"))
    table = table.join(first, "clip").join(rate, "clip")
    early = F.floor(F.greatest(F.lit(0.0), F.col("__after") - F.col("rate_hz") / fps * (F.col("__first") - F.col("number")))).cast("bigint")
    return table.select("clip", F.col("number").alias("frame"), F.when(F.col("number") < F.col("__first"), early).otherwise(F.col("n")).alias("n"), "valid")


def marks(table: DataFrame, rates: DataFrame, fps: float) -> DataFrame:
    """(clip, frame, mark, valid): the frame table in seconds on a regular cadence."""
    rows = table.join(rates.select("clip", "rate_hz"), "clip").withColumn("mark", F.col("n") / F.col("rate_hz"))
    fitted = motion.regular_marks(rows.withColumn("key", F.xxhash64("clip")), "key", "frame", "mark", "valid", fps)
    return rows.withColumn("key", F.xxhash64("clip")).join(fitted, ["key", "frame"]).select("clip", "frame", F.col("fitted").alias("mark"), "valid", "lost", "late")


def turns(samples: DataFrame, rates: DataFrame, lsb_per_dps: float, axis: tuple[int, int, int]) -> DataFrame:
    """(clip, i, x, y, z): radians the camera turns in one sample's time, about its own axes.

    ``axis`` says which recorded axis, negated or not, is pan, tilt and roll;
    aiming right is a turn about +y, aiming down one about -x, roll about +z.
    """
    if sorted(abs(a) for a in axis) != [1, 2, 3]:
        raise ValueError("axis must name each of 1, 2, 3 once")
    pan, tilt, roll = (F.col("xyz"[abs(a) - 1]) * (-1.0 if a < 0 else 1.0) for a in axis)
    scale = F.lit(math.pi / 180 / lsb_per_dps) / F.col("rate_hz")
    rows = samples.join(rates.select("clip", "rate_hz"), "clip")
    return rows.select("clip", "i", (-tilt * scale).alias("x"), (pan * scale).alias("y"), (roll * scale).alias("z"))


def assemble(blocks: DataFrame, files: DataFrame, fps: float, lsb_per_dps: float, axis: tuple[int, int, int]) -> tuple[DataFrame, DataFrame]:
    """A clip's blocks to (orientations (clip, i, w, x, y, z), frames (clip, frame, mark, valid, lost, late)).

    Clips without a plausible rate, with fewer than two samples, or whose frame
    table falls or points beyond the samples give no rows in either.
    """
    timed = timed_blocks(blocks)
    rates = clip_rates(timed)
    table = frame_table(timed, files, fps)
    every = samples(timed)
    before = F.lag("n").over(Window.partitionBy("clip").orderBy("frame"))
    falls = table.withColumn("falls", F.col("n") < F.coalesce(before, F.lit(0))).groupBy("clip").agg(F.max("falls").alias("falls"), F.max("n").alias("last"))
    total = every.groupBy("clip").agg(F.count("*").alias("total"))
    good = falls.join(total, "clip").where("NOT falls AND last <= total AND total >= 2").select("clip")
    good_rates = rates.join(good, "clip", "left_semi")
    whole = motion.integrate_streams(turns(every, good_rates, lsb_per_dps, axis), "clip", "i", ["x", "y", "z"], 1.0)
    return whole, marks(table.join(good, "clip", "left_semi"), good_rates, fps)
