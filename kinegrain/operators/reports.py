"""Texts about clips: the status line, reports as JSON, and names of cached files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinegrain.functions import geometry

#: Start and factor of the 64-bit FNV-1a hash.
FNV_START, FNV_FACTOR = 14695981039346656037, 1099511628211
#: Fixed value: the start that cached files are named with, which lacks a digit of the standard one.
CACHE_START = 1469598103934665603
#: What made a sensor window known.
WINDOW_SOURCES = ["", "", ", MQ 50", ", MQ 50, recognised by its readout", ", DC Crop"]


def fnv1a(text: Column, start: int = FNV_START) -> Column:
    """64-bit FNV-1a of a text's bytes, as 16 hexadecimal digits. Exact decimals stand in for unsigned 64-bit numbers."""
    big = lambda v: F.lit(str(v)).cast("decimal(20,0)")
    digits = F.hex(text.cast("binary"))
    at = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(2))).otherwise(F.array().cast("array<int>"))

    def step(h: Column, i: Column) -> Column:
        byte = F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("int")
        low = (h % 256).cast("int")
        mixed = h - low.cast("decimal(20,0)") + low.bitwiseXOR(byte).cast("decimal(20,0)")
        return ((mixed.cast("decimal(20,0)") * F.lit(str(FNV_FACTOR)).cast("decimal(13,0)")) % F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(20,0)")

    h = F.aggregate(at, big(start), step)
    half = F.lit(str(1 << 32)).cast("decimal(20,0)")
    part = lambda v: F.lpad(F.lower(F.hex(v.cast("bigint"))), 8, "0")
    return F.concat(part(F.floor(h / half)), part(h % half))


def cache_name(path: Column) -> Column:
    """The file a clip's track is kept in: its path in upper case with back slashes, hashed."""
    upper = F.translate(path, "abcdefghijklmnopqrstuvwxyz/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ\\")
    return F.concat(fnv1a(upper, CACHE_START), F.lit(".fpgc"))


def status_text(rows: DataFrame, name: str = "status") -> DataFrame:
    """Add the line that says what a clip's track is and what is done with it.

    Columns: source (null for blocks in frames), frames, rate_hz, readout_ms,
    readout_override, focal_mm, focal_override, focal_px, pitch_nm, window_w,
    window_h, window_source, enabled, why_off, dynamic, manual_zoom, zoom_low,
    zoom_mean, zoom_high, limited, ends_early, clip_frames, no_data, lost,
    sync_ms, from_exposure, exposure_s, exposure_varies, readout_known,
    sync_offset_ms, late, dropped, first, last, range_note. A count of 0 and a
    null leave their part out.
    """
    c = F.col
    text = lambda form, *v: F.format_string(form, *v)
    some = lambda ok, v: F.coalesce(F.when(ok, v), F.lit(""))
    frames = c("frames").cast("bigint")
    number = lambda n: c(n).cast("string")
    parts = [
        text("%s: %d frames, ", F.coalesce("source", F.lit("gyro")), frames), some(c("source").isNull(), F.lit("in-frame, ")), text("%.2f Hz", c("rate_hz")),
        F.when(c("readout_ms") > 0, F.concat(text(", readout %.1f ms", c("readout_ms")), some(c("readout_override"), F.lit(" (override)"))))
        .otherwise(", readout unknown (no rolling-shutter correction)"),
    ]
    has_focal = F.coalesce(c("focal_px") > 0, F.lit(False))
    window = ~F.coalesce(c("pitch_nm") > 0, F.lit(False)) & (c("window_w") > 0) & (c("window_w") != 6000)
    source = F.get(F.array(*[F.lit(w) for w in WINDOW_SOURCES]), F.least(F.greatest(c("window_source"), F.lit(0)), F.lit(4)).cast("int"))
    zoom = F.when(c("dynamic"), text(", zoom %.3f to %.3f (dynamic, mean %.3f)", *[c(f"zoom_{k}") * c("manual_zoom") for k in ("low", "high", "mean")])).otherwise(
        text(", zoom %.3f", c("zoom_high") * c("manual_zoom")))
    limited = some(c("limited") > 0, F.concat(F.lit(" (at the limit: stabilisation reduced on "), number("limited"), F.lit(" frames)")))
    parts += [
        some(has_focal, text(", %.1f mm", c("focal_mm"))), some(has_focal & c("focal_override"), F.lit(" (override)")), some(has_focal, text(" = %.0f px", c("focal_px"))),
        some(has_focal & window, F.concat(text(" (sensor window %dx%d", c("window_w").cast("bigint"), c("window_h").cast("bigint")), source, F.lit(")"))),
        some(has_focal & c("enabled"), F.concat(zoom, limited)),
        some(c("ends_early"), F.concat(
            F.lit(" | gyro data ends at frame "), number("frames"),
            F.when(c("clip_frames") > 0, F.concat(F.lit(" of "), number("clip_frames"))).otherwise(" (before the end of the clip)"), F.lit(": stabilisation fades out over the second before it"))),
        some(c("no_data") > 0, F.concat(F.lit(" | no gyro data on "), number("no_data"), F.lit(" of "), number("frames"), F.lit(" frames: not stabilised there"))),
        some(c("lost") > 0, F.concat(F.lit(" | "), number("lost"), F.lit(" gyro samples missing (bridged)"))),
        F.when(c("from_exposure"), F.when(c("exposure_varies"), text(" | sync %.1f ms at the start = readout/2 + exposure/2 (the exposure changes in the clip)", c("sync_ms"))).otherwise(
            text(" | sync %.1f ms = readout/2 + exposure/2 (1/%.0f s)", c("sync_ms"), 1 / c("exposure_s"))))
        .otherwise(F.concat(text(" | sync %.1f ms from the gyro data (", c("sync_ms")), F.when(c("readout_known"), "exposure time").otherwise("readout time"), F.lit(" unknown)"))),
        some(c("sync_offset_ms") != 0, text(" %+.1f ms offset", c("sync_offset_ms"))),
        some(c("late") > 0, F.concat(F.lit(" | "), number("late"), F.lit(" late frame marks corrected"))),
        some(c("dropped") > 0, F.concat(F.lit(" | "), number("dropped"), F.lit(" frames dropped by the camera"))),
        F.when((c("first") == 0) & (c("last") == c("frames") - 1), " | range: whole clip").otherwise(
            F.concat(F.lit(" | range: frames "), (c("first") + 1).cast("string"), F.lit(" to "), (c("last") + 1).cast("string"), F.lit(" of "), number("frames"))),
        some(c("range_note") != "", F.concat(F.lit(" ("), c("range_note"), F.lit(")"))),
    ]
    head = F.when(~c("enabled"), F.lit("Off (switched off) | ")).when(~has_focal, F.concat(F.lit("Off: "), c("why_off"), F.lit(" | "))).otherwise("On | ")
    return rows.withColumn(name, F.concat(head, *parts))


def block_report(blocks: DataFrame, name: str = "report") -> DataFrame:
    """The fields of a frame's block as JSON; a frame without one says why (column ``why``)."""
    c = F.col
    fields = F.struct(
        F.array("window_w", "window_h").alias("window"), F.array("recorded_w", "recorded_h").alias("recorded"), F.lit(1).alias("present"), "frame", "clock_us",
        F.size("samples").alias("n"), "ring_index", "flags", "lost", "take", "readout_us", "mark_delay_us", "sensor_mode", "resolution", "dc_crop", "bit_depth",
        "axes", "lsb_per_dps", F.flatten(F.transform("samples", lambda s: F.array(s["x"], s["y"], s["z"]))).alias("samples"))
    return blocks.withColumn(name, F.when(c("samples").isNull(), F.to_json(F.struct(F.lit(0).alias("present"), c("why").alias("why")))).otherwise(F.to_json(fields)))


def map_report(points: DataFrame, place: geometry.Placement, transform: list[float] | None, width: float, height: float, name: str = "report") -> DataFrame:
    """How an output position (x, y) of a frame's placement is read, as JSON: scale, offset, and where it lands."""
    at = (F.col("x"), F.col("y"))
    back = geometry.through_transform(at, transform, width, height) if transform is not None else at
    ok = back[0].isNotNull()
    to = geometry.through_placement((F.coalesce(back[0], at[0]), F.coalesce(back[1], at[1])), place)
    return points.withColumn(name, F.to_json(F.struct(
        F.array(F.lit(place.scale_x), F.lit(place.scale_y)).alias("scale"), F.array(F.lit(place.off_x), F.lit(place.off_y)).alias("offset"),
        F.lit(int(transform is not None)).alias("xform"), F.lit(int(place.nearest)).alias("nearest"),
        F.struct("x", "y", F.round(to[0], 6).alias("source_x"), F.round(to[1], 6).alias("source_y"), ok.cast("int").alias("ok")).alias("point"))))


#: What a clip's report says, in order: plain fields, and lists of columns under one name.
GYRO_FIELDS: list[str | tuple[str, list[str]]] = [
    "source", "blocks", "no_data", "lost_samples", "file", "binned", "version", "frames", "samples", "rate_hz", "lsb_per_dps", ("raster", ["raster_w", "raster_h"]),
    ("active", ["active_x", "active_y", "active_w", "active_h"]), "fps", "readout_us", "exposure_us", "focal_um", "mark_delay_us", ("axes", ["axis_x", "axis_y", "axis_z"]),
    "flags", "preroll", "pitch_nm", "resolution", "dc_crop", "bit_depth", "sensor_mode", ("window", ["window_w", "window_h"]), ("recorded", ["recorded_w", "recorded_h"]),
    "window_source", "why_off", "delay_ms", "delay_from_exposure", "exposure_s", "dropped_frames", "late_marks", "typical_mark_lateness_ms", "status", "frame", "time", "on",
    "focal_px", "zoom", "auto_zoom", "ends_early", "clip_frames", "frame_zoom", "limited_frames", ("range", ["first", "last"]), "zoom_min", "zoom_mean", "zoom_max",
    ("orientation", ["w", "x", "y", "z"]), ("smoothed", ["smooth_w", "smooth_x", "smooth_y", "smooth_z"])]


def gyro_report(rows: DataFrame, name: str = "report") -> DataFrame:
    """One frame's track, camera and zoom as JSON; fields that ``rows`` does not have, or that are null, are left out."""
    have = set(rows.columns)
    fields = []
    for f in GYRO_FIELDS:
        if isinstance(f, str):
            fields += [F.col(f)] if f in have else []
        elif set(f[1]) <= have:
            fields.append(F.array(*f[1]).alias(f[0]))
    return rows.withColumn(name, F.to_json(F.struct(*fields)))
