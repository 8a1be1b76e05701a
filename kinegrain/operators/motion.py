"""Operators over sample streams and frame marks.

A stream is a relation keyed by a clip (or stream) column and ordered by a
frame number or by seconds. What a window can express is a window; steps in
which a row depends on earlier results run per clip in Arrow groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Microsecond clocks are unsigned 32-bit counters.
CLOCK_SPAN = 1 << 32


def gaussian_lowpass(samples: DataFrame, key: str, t: str, value: str, sigma: float, out: str = "smooth") -> DataFrame:
    """Gaussian mean of the samples within three sigma, ends included.

    Rows of one key lie in one range frame, so memory is the frame's, not the
    stream's. ``sigma`` of 0 or less gives the signal itself.
    """
    if sigma <= 1e-6:
        return samples.withColumn(out, F.col(value).cast("double"))
    frame = f"OVER (PARTITION BY {key} ORDER BY {t} RANGE BETWEEN {3 * sigma!r}D PRECEDING AND {3 * sigma!r}D FOLLOWING)"
    near = samples.withColumn("__near", F.expr(f"collect_list(struct({t} AS t, CAST({value} AS DOUBLE) AS v)) {frame}"))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))

    def step(acc: Column, p: Column) -> Column:
        u = (p["t"] - F.col(t)) / sigma
        w = F.exp(u * u * -0.5)
        return F.struct((acc["s"] + w * p["v"]).alias("s"), (acc["w"] + w).alias("w"))

    return near.withColumn(out, F.aggregate("__near", zero, step, lambda a: a["s"] / a["w"])).drop("__near")


def gaussian_row_mean(frames: DataFrame, key: str, order: str, value: str, reach: int, out: str = "mean") -> DataFrame:
    """Mean over rows -reach..reach with weights exp(-0.5 (d / (reach / 2))^2), cut off at the ends."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-reach, reach)
    place = Window.partitionBy(key).orderBy(order)
    near = frames.withColumn("__near", F.collect_list(value).over(w)).withColumn("__at", F.least(F.row_number().over(place) - 1, F.lit(reach)))
    weight = lambda j: F.exp((j - F.col("__at")).cast("double") * (j - F.col("__at")) * (-2.0 / (reach * reach)))
    weighted = F.transform("__near", lambda v, j: F.struct((v * weight(j)).alias("s"), weight(j).alias("w")))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
    total = F.aggregate(weighted, zero, lambda a, p: F.struct((a["s"] + p["s"]).alias("s"), (a["w"] + p["w"]).alias("w")), lambda a: a["s"] / a["w"])
    return near.withColumn(out, total).drop("__near", "__at")


def envelope(frames: DataFrame, key: str, order: str, value: str, valid: str, reach: int) -> DataFrame:
    """``low``: smallest valid value within ``reach`` rows, the nearest where there is none; ``env``: its mean."""
    w = Window.partitionBy(key).orderBy(order)
    near = w.rowsBetween(-reach, reach)
    low = frames.withColumn("__low", F.min(F.when(F.col(valid), F.col(value))).over(near))
    before = F.last("__low", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("__low", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return low.withColumn("low", F.coalesce(before, after)).withColumn("env", F.avg("low").over(near)).drop("__low")


def upper_median(value: Column, keep: Column | None = None) -> Column:
    """The element after the middle of an even number of values, the middle one of an odd number."""
    values = F.array_sort(F.collect_list(F.when(keep, value) if keep is not None else value))
    return F.get(values, (F.size(values) / 2).cast("int"))


def values_at_ranks(rows: DataFrame, key: str, value: str, ranks: dict[str, Column], steps: int = 1024) -> DataFrame:
    """Exact order statistics for groups of any size: key and a column for each rank, counted from 0.

    A rank is an expression of ``n``, the group's number of values; one beyond
    it gives null. Equal values are counted together before they move. Counts
    of ``steps`` equal slices of a group's values find the slice that holds a
    rank, and only that slice is sorted. Null values and keys do not count.
    """
    counted = rows.where(F.col(value).isNotNull() & F.col(key).isNotNull()).groupBy(key, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    whole = counted.groupBy(key).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.sum("__c").alias("n"))
    share = F.when(F.col("__high") > F.col("__low"), (F.col("__v") - F.col("__low")) / (F.col("__high") - F.col("__low"))).otherwise(0.0)
    sliced = counted.join(whole, key).withColumn("__s", F.coalesce(F.least(F.floor(share * steps), F.lit(steps - 1)), F.lit(0)))
    slices = sliced.groupBy(key, "n", "__s").agg(F.sum("__c").alias("__in"))
    before = F.sum("__in").over(Window.partitionBy(key).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), r.cast("bigint").alias("r")) for name, r in ranks.items()]))
    slices = slices.withColumn("__before", F.coalesce(before, F.lit(0))).withColumn("__want", wanted)
    hit = slices.where((F.col("__want.r") >= F.col("__before")) & (F.col("__want.r") < F.col("__before") + F.col("__in"))).select(
        key, "__s", F.col("__want.name").alias("__name"), (F.col("__want.r") - F.col("__before")).alias("__r"))
    upto = F.sum("__c").over(Window.partitionBy(key, "__name").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    inside = sliced.select(key, "__s", "__v", "__c").join(hit, [key, "__s"]).withColumn("__upto", upto)
    found = inside.where(F.col("__upto") > F.col("__r")).groupBy(key, "__name").agg(F.min("__v").alias("__v"))
    values = found.groupBy(key).agg(*[F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in ranks])
    return whole.select(key).join(values, key, "left")


def steps(marks: DataFrame, key: str, frame: str, mark: str, valid: str) -> DataFrame:
    """Difference of successive valid marks per frame between them; null for the first."""
    w = Window.partitionBy(key).orderBy(frame)
    rows = marks.where(F.col(valid))
    return rows.withColumn("step", (F.col(mark) - F.lag(mark).over(w)) / (F.col(frame) - F.lag(frame).over(w)))


def unwrap_clock(blocks: DataFrame, key: str, order: str, clock: str, out: str = "elapsed") -> DataFrame:
    """Microseconds since the first block of an unsigned 32-bit clock that may wrap."""
    w = Window.partitionBy(key).orderBy(order)
    step = F.coalesce(F.pmod(F.col(clock) - F.lag(clock).over(w), F.lit(CLOCK_SPAN)), F.lit(0))
    return blocks.withColumn("__step", step).withColumn(out, F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def keep_take(blocks: DataFrame, key: str, order: str, take: str, frame: str) -> DataFrame:
    """Blocks of each clip's most frequent take (the smallest of equals) whose frame counter rises."""
    counts = blocks.groupBy(key, take).agg(F.count("*").alias("__n"))
    main = counts.groupBy(key).agg(F.max_by(take, F.struct("__n", -F.col(take))).alias("__take"))
    rows = blocks.join(main, key).where(F.col(take) == F.col("__take"))
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    high = rows.withColumn("__high", F.max(frame).over(w))
    return high.where("__high IS NULL").unionByName(high.where(F.col(frame) > F.col("__high"))).drop("__take", "__n", "__high")


def detect_gaps(blocks: DataFrame, key: str, order: str, elapsed: str, n: str, lost: str, rate: str) -> DataFrame:
    """``gap``: samples missing before a block; ``broken``: the clock says more than the count can.

    The reported loss is at most 99; where the clock expects over 50 samples
    more, or any more after a full count, the difference is added.
    """
    w = Window.partitionBy(key).orderBy(order)
    expected = F.round(F.col(rate) * (F.col(elapsed) - F.lag(elapsed).over(w)) / 1e6)
    extra = (expected - F.col(lost) - F.col(n)).cast("bigint")
    first = F.lag(elapsed).over(w).isNull() | F.col(rate).isNull()
    more = ~first & ((extra > 50) | ((F.col(lost) >= 99) & (extra > 0)))
    rows = blocks.withColumn("__extra", extra).withColumn("__more", more)
    gap = F.when(F.lag(elapsed).over(w).isNull(), 0).otherwise(F.col(lost)) + F.when(F.col("__more"), F.col("__extra")).otherwise(0)
    return rows.withColumn("gap", gap.cast("bigint")).withColumn("broken", F.col("__more") & (F.col("__extra") > 50)).drop("__extra", "__more")


def fill_gaps(blocks: DataFrame, key: str, order: str, gap: str, first: list[str], last: list[str]) -> DataFrame:
    """A row per missing sample on the straight line across its gap: key, order, j, one column per axis.

    The line runs from the last sample before to the first after; without one
    before it starts at 0, and a block without samples repeats the last.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks
    for k, (f, l) in enumerate(zip(first, last)):
        rows = rows.withColumn(f"__from{k}", F.coalesce(F.last(l, True).over(w), F.lit(0))).withColumn(f"__to{k}", F.coalesce(F.col(f), F.col(f"__from{k}")))
    rows = rows.where(F.col(gap) > 0).withColumn("j", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(gap))))
    line = lambda k: F.round(F.col(f"__from{k}") + (F.col(f"__to{k}") - F.col(f"__from{k}")) * F.col("j").cast("double") / (F.col(gap) + 1))
    return rows.select(key, order, "j", *[line(k).cast("bigint").alias(f"axis{k}") for k in range(len(first))])


def frame_table(frames: DataFrame, key: str, frame: str, after: str, gap: str, broken: str, exists: str, per_frame: float) -> DataFrame:
    """``n``: samples at each frame's mark, and ``valid``.

    ``after`` is null where a frame has no block. Between two blocks the count
    is interpolated; before the first it falls by ``per_frame`` to no less than
    0, after the last it stays. A frame between blocks is valid unless samples
    are missing there and its file exists; one outside the blocks is not.
    """
    w = Window.partitionBy(key).orderBy(frame)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    has = F.col(after).isNotNull()
    rows = frames.withColumn("__a", F.last(F.when(has, F.struct(F.col(frame).alias("f"), F.col(after).alias("n"))), True).over(back))
    rows = rows.withColumn("__b", F.first(F.when(has, F.struct(F.col(frame).alias("f"), F.col(after).alias("n"), F.col(gap).alias("g"), F.col(broken).alias("x"))), True).over(ahead))
    between = F.col("__a.n") + F.round((F.col("__b.n") - F.col("__a.n")).cast("double") * (F.col(frame) - F.col("__a.f")) / (F.col("__b.f") - F.col("__a.f")))
    n = F.when(has, F.col(after)).when(F.col("__a").isNull(), F.floor(F.greatest(F.lit(0.0), F.col("__b.n") - (F.col("__b.f") - F.col(frame)) * per_frame)))
    n = n.when(F.col("__b").isNull(), F.col("__a.n")).otherwise(between)
    inside = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    valid = has | (inside & (((F.col("__b.g") == 0) & ~F.col("__b.x")) | ~F.col(exists)))
    return rows.withColumn("n", n.cast("bigint")).withColumn("valid", F.coalesce(valid, F.lit(False))).drop("__a", "__b")


def distance_to_gap(frames: DataFrame, key: str, frame: str, valid: str, cap: int) -> DataFrame:
    """``distance``: rows to the nearest invalid one in either direction, 0 there, at most ``cap``."""
    w = Window.partitionBy(key).orderBy(frame)
    bad = F.when(~F.col(valid), F.col(frame))
    before = F.last(bad, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(bad, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return frames.withColumn("distance", F.least(F.coalesce(F.col(frame) - before, F.lit(cap)), F.coalesce(after - F.col(frame), F.lit(cap)), F.lit(cap)))


def at_time(points: DataFrame, samples: DataFrame, key: str, t: str, index: str, value: str, rate: float, out: str = "v") -> DataFrame:
    """The value between two samples of a constant rate; times are held to the stream's ends.

    A constant rate makes this an equi-join on the sample's number.
    """
    last = samples.groupBy(key).agg(F.max(index).alias("__last"))
    p = points.join(last, key)
    s = F.least(F.greatest(F.col(t) * rate, F.lit(0.0)), F.col("__last").cast("double"))
    p = p.withColumn("__s", s).withColumn("__i", F.greatest(F.least(F.floor("__s"), F.col("__last") - 1), F.lit(0)))
    a = samples.select(key, F.col(index).alias("__i"), F.col(value).alias("__v0"))
    b = samples.select(key, (F.col(index) - 1).alias("__i"), F.col(value).alias("__v1"))
    joined = p.join(a, [key, "__i"]).join(b, [key, "__i"], "left")
    mixed = F.col("__v0") + (F.col("__s") - F.col("__i")) * (F.coalesce("__v1", "__v0") - F.col("__v0"))
    return joined.withColumn(out, mixed).drop("__last", "__s", "__i", "__v0", "__v1")


# Steps that follow earlier results: numpy, one clip at a time.


def drop_cadence(m: np.ndarray, ok: np.ndarray, period: float, reach: int, residual: np.ndarray) -> np.ndarray:
    """Cadence number of every frame: a lasting step of whole periods in the marks counts as frames lost."""
    n, lost = len(m), 0
    cadence = np.zeros(n, np.int64)
    index = np.arange(n)
    for i in range(n):
        if ok[i] and i:
            behind = residual[max(0, i - reach): i][ok[max(0, i - reach): i]]
            stop = min(n, i + reach + 1)
            ahead = (m[i:stop] - (index[i:stop] + lost) * period)[ok[i:stop]]
            if len(behind) and len(ahead) >= 5:
                lost += max(0, int(np.floor((ahead.min() - behind.min()) / period + 0.5)))
        cadence[i] = i + lost
        residual[i] = m[i] - cadence[i] * period
    return cadence


def rolling(values: np.ndarray, reach: int, how) -> np.ndarray:
    """``how`` over rows -reach..reach, cut off at the ends."""
    wide = np.pad(values.astype(float), reach, constant_values=np.nan)
    return how(np.lib.stride_tricks.sliding_window_view(wide, 2 * reach + 1), axis=1)


def fit_marks(m: np.ndarray, ok: np.ndarray, fps: float) -> dict:
    """Marks on a regular cadence above the lower envelope of recorded ones.

    Gives ``marks``, ``lost`` frames, ``typical`` lateness and the number of
    ``late`` marks (over 5 ms). Fewer than eight marks, or steps of 0.1 ms or
    less, are returned as they are.
    """
    m, ok = np.asarray(m, float), np.asarray(ok, bool)
    at = np.flatnonzero(ok)
    out = {"marks": m.copy(), "lost": 0, "typical": 0.0, "late": 0}
    if len(at) < 8:
        return out
    step = np.sort(np.diff(m[at]) / np.diff(at))
    median = step[len(step) // 2]
    if not median > 1e-4:
        return out
    period = 1 / fps if fps > 1 and abs(median * fps - 1) < 0.02 else median
    wide, narrow = (max(5, int(np.floor(s / period + 0.5))) for s in (2.0, 0.5))
    residual = np.zeros(len(m))
    for turn in range(3):
        cadence = drop_cadence(m, ok, period, narrow, residual)
        with np.errstate(all="ignore"):
            low = rolling(np.where(ok, residual, np.nan), wide, lambda w, axis: np.fmin.reduce(w, axis=axis))
        seen = np.flatnonzero(~np.isnan(low))
        place = np.maximum(np.searchsorted(seen, np.arange(len(m)), side="right") - 1, 0)
        low = low[seen[place]]
        env = rolling(low, wide, np.nanmean)
        c = cadence - cadence.mean()
        slope = float((c * (env - env.mean())).sum() / (c * c).sum()) if (c * c).sum() > 0 else 0.0
        if abs(slope) < 1e-9 or turn == 2:
            break
        period += slope
    late = residual[at] - env[at]
    typical = float(np.sort(late)[len(late) // 2])
    out.update(marks=cadence * period + env + typical, lost=int(cadence[-1] - len(m) + 1), typical=typical, late=int((late - typical > 0.005).sum()))
    return out


def regular_marks(marks: DataFrame, key: str, frame: str, mark: str, valid: str, fps: float) -> DataFrame:
    """`fit_marks` for every clip: key, frame, fitted, lost, typical, late."""
    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column(frame).to_numpy(), kind="stable")
        got = fit_marks(group.column(mark).to_numpy()[order], group.column(valid).to_numpy(zero_copy_only=False)[order], fps)
        n = len(order)
        return pa.table({
            key: group.column(key), frame: pa.array(group.column(frame).to_numpy()[order]), "fitted": pa.array(got["marks"]),
            "lost": pa.array([got["lost"]] * n, pa.int64()), "typical": pa.array([got["typical"]] * n), "late": pa.array([got["late"]] * n, pa.int64())})

    rows = marks.select(F.col(key).cast("bigint"), F.col(frame).cast("bigint"), F.col(mark).cast("double"), F.col(valid).cast("boolean"))
    return rows.groupBy(key).applyInArrow(run, f"{key} bigint, {frame} bigint, fitted double, lost bigint, typical double, late bigint")


def turns(rates: np.ndarray, dt: float) -> np.ndarray:
    """Quaternions of the mean rates between successive samples; an identity first."""
    v = np.concatenate((np.zeros((1, 3)), 0.5 * (rates[1:] + rates[:-1]) * dt))
    angle = np.sqrt((v * v).sum(axis=1))
    scale = np.where(angle < 1e-12, 0.5, np.sin(0.5 * angle) / np.where(angle < 1e-12, 1, angle))
    return np.concatenate((np.cos(0.5 * angle)[:, None], v * scale[:, None]), axis=1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamilton product of quaternion arrays."""
    aw, ax, ay, az = np.moveaxis(a, -1, 0)
    bw, bx, by, bz = np.moveaxis(b, -1, 0)
    return np.stack((
        aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw), axis=-1)


def unit(q: np.ndarray) -> np.ndarray:
    norm = np.sqrt((q * q).sum(axis=-1, keepdims=True))
    return np.where(norm > 1e-300, q / np.where(norm > 1e-300, norm, 1), np.array([1.0, 0, 0, 0]))


def integrate(rates: np.ndarray, dt: float) -> np.ndarray:
    """Orientation at every sample, by doubling prefixes of the ordered product."""
    q = turns(rates, dt)
    reach = 1
    while reach < len(q):
        q[reach:] = unit(product(q[:-reach], q[reach:]))
        reach *= 2
    return q


def integrate_streams(samples: DataFrame, key: str, order: str, axes: list[str], dt: float) -> DataFrame:
    """Orientation (w, x, y, z) of every sample of every stream."""
    def run(group: pa.Table) -> pa.Table:
        at = np.argsort(group.column(order).to_numpy(), kind="stable")
        q = integrate(np.stack([group.column(a).to_numpy()[at] for a in axes], axis=1), dt)
        return pa.table({key: group.column(key), order: pa.array(group.column(order).to_numpy()[at]), **{n: pa.array(np.ascontiguousarray(q[:, k])) for k, n in enumerate("wxyz")}})

    rows = samples.select(key, F.col(order).cast("bigint"), *[F.col(a).cast("double") for a in axes])
    kind = samples.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInArrow(run, f"{key} {kind}, {order} bigint, w double, x double, y double, z double")
