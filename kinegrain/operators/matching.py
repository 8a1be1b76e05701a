"""Matching of recordings to calibrations, names, files and each other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def words(name: Column) -> Column:
    """Lower-case tokens of letters, digits, dot and minus; ``f4.5`` counts as ``4.5``."""
    found = F.regexp_extract_all(F.lower(name), F.lit("([a-z0-9.-]+)"), 1)
    return F.transform(found, lambda w: F.regexp_replace(w, "^f(?=[0-9])", ""))


def common_words(want: Column, have: Column) -> Column:
    """How many of the wanted words occur, repeated ones counted each time."""
    return F.size(F.filter(want, lambda w: F.array_contains(have, w)))


def name_score(want: Column, have: Column) -> Column:
    """Common words over the geometric mean of both counts; 0 without a common focal length."""
    focal = F.exists(have, lambda w: w.contains("mm") & F.array_contains(want, w))
    score = common_words(want, have) / F.sqrt(F.greatest(F.size(have), F.lit(1)) * F.greatest(F.size(want), F.lit(1)))
    return F.when(focal, score).otherwise(F.lit(0.0))


def is_aperture(w: Column) -> Column:
    """A word that starts with a digit, is no focal length, and has a dot or is one character."""
    return w.rlike("^[0-9]") & ~w.contains("mm") & (w.contains(".") | (F.length(w) <= 2))


def best_names(wanted: DataFrame, offered: DataFrame, least: float = 0.5, top: int = 16) -> DataFrame:
    """The best offered names for each wanted one: w_id, o_id, score, rank.

    A score needs a common focal length, and every aperture of the wanted name
    must occur, so names meet on a focal length and one aperture (an empty one
    for wanted names without any); all such pairs are scored, once for all names
    of the same words. Of several common focal lengths the first one brings the
    pair together. Ties keep the offered order. Ids are unique.
    """
    def facts(lists: DataFrame, out: str) -> DataFrame:
        return lists.withColumns({
            f"{out}_apertures": F.array_distinct(F.filter(out, is_aperture)), f"{out}_focals": F.array_distinct(F.filter(out, lambda w: w.contains("mm")))})

    # Names with the same words score alike: lists of words meet, each once.
    w = wanted.select("w_id", F.array_sort(words(F.col("name"))).alias("want"))
    o = first_of_each(offered.select("o_id", F.array_sort(words(F.col("name"))).alias("have")), ["have"], "o_id", ["o_id"], top)
    w_lists, o_lists = facts(w.select("want").distinct(), "want"), facts(o.select("have", "first"), "have")
    w_lists = w_lists.withColumns({"aperture": F.coalesce(F.array_min("want_apertures"), F.lit("")), "focal": F.explode("want_focals")})
    o_lists = o_lists.withColumn("focal", F.explode("have_focals")).withColumn("aperture", F.explode(F.array_append("have_apertures", F.lit(""))))
    met = meet(w_lists, o_lists, ["focal", "aperture"]).where(
        (F.size("want_apertures") <= 1) | (F.size(F.array_except("want_apertures", "have_apertures")) == 0))
    met = met.where(((F.size("want_focals") == 1) | (F.size("have_focals") == 1)) | (F.col("focal") == F.array_min(F.array_intersect("want_focals", "have_focals"))))
    # Only whole words count, and a common focal length is there by the join.
    score = common_words(F.col("want"), F.col("have")) / F.sqrt((F.size("have") * F.size("want")).cast("double"))
    scored = met.select("want", "have", "first", score.alias("score")).where(F.col("score") >= least)
    ranked = best_members(scored, o, ["want"], ["have"], "score", "o_id", top)
    found = ranked.groupBy("want").agg(F.collect_list(F.struct("o_id", "score", "place")).alias("found"))
    return w.join(found, "want").select("w_id", F.explode("found").alias("f")).select("w_id", "f.o_id", "f.score", F.col("f.place").alias("rank"))


#: Rows of a key on the left of `meet` that one task takes.
MEET_ROWS = 256


def meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The equi-join of both; a key with many rows on the left is dealt over tasks, each with the key's rows on the right."""
    parts = left.groupBy(*on).agg(F.ceil(F.count("*") / MEET_ROWS).alias("__parts"))
    dealt = left.join(parts, on).withColumn("__part", F.pmod(F.xxhash64(*[c for c in left.columns if c not in on]), F.col("__parts"))).drop("__parts")
    copied = right.join(parts, on).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__parts") - 1))).drop("__parts")
    return dealt.join(copied, [*on, "__part"]).drop("__part")


def first_of_each(rows: DataFrame, by: list[str], order: str, kept: list[str], top: int) -> DataFrame:
    """A row for each group ``by`` with ``members``, the ``kept`` columns of its first ``top`` rows in their order, and the ``first`` place in it."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    first = rows.withColumn("__nth", nth).where(F.col("__nth") <= top)
    return first.groupBy(*by).agg(F.min_by(order, "__nth").alias("first"), F.array_sort(F.collect_list(F.struct("__nth", *kept))).alias("members"))


def best_members(scored: DataFrame, groups: DataFrame, by: list[str], group: list[str], score: str, order: str, top: int) -> DataFrame:
    """The ``top`` best members of ``scored`` groups (``by``, ``group``, first, score), by score and then ``order``, with their ``place``.

    ``groups`` is what `first_of_each` gives. A group before whose first member
    ``top`` others' first members stand has none among the best, so no more
    than ``top`` groups are opened.
    """
    lists = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), "first"))
    best = scored.withColumn("__list", lists).where(F.col("__list") <= top).drop("__list", "first")
    opened = best.join(groups, group).select(*by, score, F.inline("members"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), order))
    return opened.withColumn("place", place).where(F.col("place") <= top).drop("__nth")


def apart(a: Column, b: Column, weight: float) -> Column:
    """Weighted distance in logarithms; unknown values (null, 0 or less) cost nothing."""
    return F.coalesce(F.when((a > 0) & (b > 0), F.abs(F.log(a / b)) * weight), F.lit(0.0))


#: Width of a bucket of focal lengths, in logarithms, and the bucket of points without one.
FOCAL_STEP = 0.1
NO_FOCAL = -(1 << 40)


#: Clips that one task of a bucket takes, and by how much costs may differ that count as equal until they are made exactly.
BUCKET_CLIPS = 50_000
EQUAL_COSTS = 1e-9


def _nearest_of(clips: pa.Table, points: pa.Table) -> pa.Table:
    """The clips' nearest points, with those about as near: (clip's columns, point's columns).

    Points of one focal length and aperture are a list by distance, in which a
    clip finds its neighbours by bisection. Lists whose focal length and
    aperture alone cost more than the best so far are passed over.
    """
    def logs(t: pa.Table, name: str) -> np.ndarray:
        v = t.column(name).cast(pa.float64()).to_numpy()
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(v > 0, np.log(v), np.nan)  # an unknown value is NaN and costs nothing

    f, a, d = (logs(clips, c) for c in ("focal", "aperture", "distance"))
    pf, pa_, pd = (logs(points, c) for c in ("p_focal", "p_aperture", "p_distance"))
    number = points.column("point").to_numpy()
    order = np.lexsort((number, pd, pa_, pf))
    pf, pa_, pd, number = pf[order], pa_[order], pd[order], number[order]
    differ = lambda x: (x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1]))
    edges = np.flatnonzero(np.concatenate(([True], differ(pf) | differ(pa_), [True]))) if len(pf) else np.zeros(0, np.int64)
    best = np.full(len(f), np.inf)
    rows, found, costs = [], [], []

    def offer(at: np.ndarray, i: np.ndarray, cost: np.ndarray) -> None:
        good = cost <= best[at] + EQUAL_COSTS
        at, cost = at[good], cost[good]
        best[at] = np.minimum(best[at], cost)
        rows.append(at)
        found.append(i[good])
        costs.append(cost)

    for low, high in zip(edges[:-1], edges[1:]):
        base = np.nan_to_num(8.0 * np.abs(f - pf[low])) + np.nan_to_num(2.0 * np.abs(a - pa_[low]))
        at = np.flatnonzero(base <= best + EQUAL_COSTS)
        if not len(at):
            continue
        known = low + int((~np.isnan(pd[low:high])).sum())
        if known < high:  # NaN is sorted last
            i = known + int(np.argmin(number[known:high]))
            offer(at, np.full(len(at), i), base[at])
        if known > low:
            blind = at[np.isnan(d[at])]
            offer(blind, np.full(len(blind), low + int(np.argmin(number[low:known]))), base[blind])
            at = at[~np.isnan(d[at])]
            place = low + np.searchsorted(pd[low:known], d[at])
            for i in (np.maximum(place - 1, low), np.minimum(place, known - 1)):
                offer(at, i, base[at] + 0.5 * np.abs(d[at] - pd[i]))
    row, i, cost = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, found, costs))
    good = cost <= best[row] + EQUAL_COSTS
    clips, points = clips.take(pa.array(row[good])), points.take(pa.array(order[i[good]]))
    return pa.table([*clips.columns, *points.columns], names=[*clips.column_names, *points.column_names])


def nearest_point(clips: DataFrame, points: DataFrame, vignette: bool, key: str = "clip") -> DataFrame:
    """The calibration point nearest in focal length, aperture (for a vignette) and distance.

    The least cost wins, of equal ones the first ``point``. Clips first meet
    the points of their own and the next buckets of focal length; the best cost
    there bounds how far away in focal length a better point can lie, and only
    clips whose bound reaches further meet the buckets out to it. Unknown focal
    lengths cost nothing: such points are met by every clip, such a clip meets
    every point. Equal points are one. ``key`` is unique among the clips.
    """
    cost = apart(F.col("p_focal"), F.col("focal"), 8.0)
    if vignette:
        cost = cost + apart(F.col("p_aperture"), F.col("aperture"), 2.0)
    cost = cost + apart(F.col("p_distance"), F.col("distance"), 0.5)
    bucket = lambda c: F.coalesce(F.floor(F.when(F.col(c) > 0, F.log(c)) / FOCAL_STEP).cast("bigint"), F.lit(NO_FOCAL))
    end = lambda c: F.least(F.col(c), F.lit(100.0)).alias(c)
    aperture = lambda c: (F.col(c) if vignette else F.lit(None)).cast("double").alias(c)
    p = points.select("point", "p_focal", aperture("p_aperture"), end("p_distance")).groupBy("p_focal", "p_aperture", "p_distance").agg(F.min("point").alias("point"))
    p = p.withColumn("bucket", bucket("p_focal"))
    c = clips.select(key, "focal", aperture("aperture"), end("distance")).withColumn("bucket", bucket("focal"))
    c_columns, p_columns = [key, "focal", "aperture", "distance"], ["p_focal", "p_aperture", "p_distance", "point"]
    schema = StructType([*c.select(*c_columns).schema, *p.select(*p_columns).schema])

    def meet_points(some: DataFrame, near: DataFrame) -> DataFrame:
        """The best of the points ``near`` in each row's bucket; a bucket with many clips is dealt over tasks."""
        tasks = some.groupBy("bucket").agg(F.ceil(F.count("*") / BUCKET_CLIPS).alias("tasks"))
        left = some.join(tasks, "bucket").withColumn("task", F.pmod(F.xxhash64(key), F.col("tasks")))
        right = near.join(tasks, "bucket").withColumn("task", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tasks") - 1)))
        both = left.select("bucket", "task", *c_columns).groupBy("bucket", "task").cogroup(right.select("bucket", "task", *p_columns).groupBy("bucket", "task"))
        found = both.applyInArrow(lambda x, y: _nearest_of(x.select(c_columns), y.select(p_columns)), schema)
        # Costs are made here, so that equal ones are equal.
        return found.groupBy(key).agg(F.min(F.struct(cost.alias("cost"), "point")).alias("b")).select(key, "b.point", "b.cost")

    b, known = F.col("bucket"), p.where(F.col("bucket") != NO_FOCAL)
    around = known.withColumn("bucket", F.explode(F.array(b - 1, b, b + 1, F.lit(NO_FOCAL).cast("bigint"))))
    everywhere = p.where(b == NO_FOCAL).drop("bucket").crossJoin(c.select("bucket").distinct())
    near = meet_points(c, around.unionByName(everywhere.select(*around.columns)))
    bound = c.where(b != NO_FOCAL).join(near.select(F.col(key).alias("__key"), F.col("cost").alias("__cost")), F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
    # Everything within one step of the focal length has been met.
    further = bound.where(F.col("__cost").isNull() | (F.col("__cost") > 8 * FOCAL_STEP))
    log, out_to = F.log("focal"), F.col("__cost") / 8 + 1e-9
    span = known.agg(F.min("bucket").alias("low"), F.max("bucket").alias("high"))
    # Unknown bounds are nulls, which `greatest` and `least` leave out.
    first = F.greatest(F.floor((log - out_to) / FOCAL_STEP).cast("bigint"), F.col("low"))
    last = F.least(F.floor((log + out_to) / FOCAL_STEP).cast("bigint"), F.col("high"))
    reach = further.crossJoin(F.broadcast(span)).withColumns({"first": first, "last": last}).where("first <= last")  # one row
    reach = reach.withColumnRenamed("bucket", "own").withColumn("bucket", F.explode(F.sequence("first", "last"))).where(F.abs(b - F.col("own")) > 1)
    far = meet_points(reach.select(*c_columns, "bucket"), known)
    both = near.unionByName(far).groupBy(key).agg(F.min(F.struct("cost", "point")).alias("b"))
    return both.select(key, F.col("b.point").alias("point"), F.col("b.cost").alias("cost"))


def longest_stem(names: DataFrame, stems: DataFrame) -> DataFrame:
    """For every (id, name) the longest stem that equals it or is followed by an underscore.

    Stems meet the prefixes of a name that end at an underscore or at its end,
    so this is an equi-join. Without one ``stem`` is null; of equally long
    stems the last ``ordinal`` wins.
    """
    parts = F.split("name", "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "_"))
    cut = names.select("id", "name", F.explode(prefixes).alias("prefix"))
    hit = cut.join(stems.select(F.col("stem").alias("prefix"), "ordinal"), "prefix", "left")
    best = F.max(F.when(F.col("ordinal").isNotNull(), F.struct(F.length("prefix").alias("l"), "ordinal", F.col("prefix").alias("stem"))))
    return hit.groupBy("id", "name").agg(best.alias("b")).select("id", "name", F.col("b.stem").alias("stem"))


def sequence_parts(path: Column) -> tuple[Column, Column, Column, Column]:
    """(prefix, number, digits, suffix) of a path whose name ends in a run of digits; nulls without one.

    The number is the last run of digits before the extension, of at most 12.
    """
    pattern = r"^(.*?)([0-9]+)(\.[^./\\]*)?$"
    digits = F.regexp_extract(path, pattern, 2)
    good = (digits != "") & (F.length(digits) <= 12)
    keep = lambda c: F.when(good, c)
    return (
        keep(F.regexp_extract(path, pattern, 1)), keep(digits.try_cast("bigint")), keep(F.length(digits)),
        keep(F.regexp_extract(path, pattern, 3)))


def numbered(prefix: Column, number: Column, digits: Column, suffix: Column) -> Column:
    """Path of a number, padded with zeros and never cut."""
    text = number.cast("string")
    return F.concat(prefix, F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, F.lit("0"))), suffix)


def first_source(*options: tuple[str, Column, Column]) -> tuple[Column, Column]:
    """(name, value) of the first option whose condition holds, in the order given."""
    name = value = None
    for n, ok, v in options:
        name = F.when(ok, F.lit(n)) if name is None else name.when(ok, F.lit(n))
        value = F.when(ok, v) if value is None else value.when(ok, v)
    return name.otherwise(F.lit("none")), value


def evict_oldest(files: DataFrame, age: str, size: str, limit: int) -> DataFrame:
    """Files to delete so that the newest ones within ``limit`` stay; the newest always stays.

    Running sums are made per block of ages and then over the blocks.
    """
    rows = files.withColumn("__block", F.floor(F.col(age) / 1024))
    inner = Window.partitionBy("__block").orderBy(F.desc(age)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__in", F.sum(size).over(inner))
    blocks = rows.groupBy("__block").agg(F.sum(size).alias("__sum"))
    outer = Window.orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("__block", F.coalesce(F.sum("__sum").over(outer), F.lit(0)).alias("__newer"))
    newest = files.agg(F.max(age).alias("__top"))
    rows = rows.join(blocks, "__block").crossJoin(F.broadcast(newest))
    return rows.where((F.col("__newer") + F.col("__in") > limit) & (F.col(age) < F.col("__top"))).select(*files.columns)


#: Aspect ratios with a name, and how near one must be.
RATIOS = [("1:1", 1.0), ("4:3", 4 / 3), ("3:2", 1.5), ("16:9", 16 / 9), ("17:9", 256 / 135), ("2:1", 2.0), ("2.39:1", 2.39), ("2.4:1", 2.4)]
RATIO_TOLERANCE = 0.006


def aspect_name(w: Column, h: Column) -> Column:
    """Name of an aspect ratio, or the ratio to two places; ``?`` for an empty size."""
    out = F.when((w <= 0) | (h <= 0), "?")
    for name, r in RATIOS:
        out = out.when(F.abs(w / h / r - 1) < RATIO_TOLERANCE, name)
    return out.otherwise(F.concat(F.format_number(w / h, 2), F.lit(":1")))


def sensor_window(active_w: Column, active_h: Column, crop: Column, window_w: Column, window_h: Column, recorded_w: Column, readout_us: Column) -> Column:
    """(w, h, rule): the sensor area a clip shows and which of five rules says so.

    1 a written window, 2 crop code 2 and 3 the readout of a 3000 x 2000 clip,
    4 crop code 1, 0 the whole sensor.
    """
    mid = (active_w == 3000) & (active_h == 2000)
    area = lambda w, h, rule: F.struct(w.alias("w"), h.alias("h"), F.lit(rule).alias("rule"))
    written = (F.coalesce(window_w, F.lit(0)) > 0) & (F.coalesce(recorded_w, F.lit(0)) > 0)
    n = lambda v: F.lit(v)
    return (
        F.when(written, area(window_w, window_h, 1)).when(mid & (crop == 2), area(n(4608), n(3072), 2))
        .when(mid & (F.round(readout_us) == 18926), area(n(4608), n(3072), 3)).when(crop == 1, area(n(4024), n(2682), 4))
        .otherwise(area(n(6000), n(4000), 0)))


def binning(raster_w: Column, raster_h: Column, window_w: Column, crop: Column, readout_us: Column, has_block: Column) -> Column:
    """1 binned, 0 not, -1 unknown: only 3024 x 2010 frames can be binned."""
    plain = F.coalesce(window_w, F.lit(0)) > 0
    return (
        F.when(~((raster_w == 3024) & (raster_h == 2010)), 0).when(~has_block, -1)
        .when(plain | (crop == 2) | (readout_us == 18926), 0).otherwise(1))


def focal_pixels(focal_mm: Column, pitch_nm: Column, window_w: Column, recorded_w: Column, sensor_pitch_mm: float = 0.006) -> Column:
    """Focal length in raster pixels, null when unknown."""
    pitch = F.coalesce(F.when(pitch_nm > 0, pitch_nm * 1e-6), F.coalesce(F.when(window_w > 0, window_w), F.lit(6000)) * sensor_pitch_mm / recorded_w)
    return F.when(focal_mm > 0, focal_mm / pitch)


def frame_time(mark: Column, readout_s: Column, exposure_s: Column, delay_s: Column, sync_ms: Column, extra_s: float = 0.0) -> Column:
    """Middle of a frame's exposure: its mark less half the readout and half the exposure, or a stored delay."""
    known = (exposure_s > 0) & (readout_s > 0)
    return mark - F.when(known, readout_s / 2 + exposure_s / 2 + extra_s).otherwise(delay_s) - sync_ms * 1e-3
