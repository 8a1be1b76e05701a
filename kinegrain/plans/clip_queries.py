"""Queries about whole clips: texts, profiles, calibrations, warps and pictures through them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinegrain.functions import colour, geometry
from kinegrain.operators import develop, profiles, raster, reports, zoom
from kinegrain.plans.colour_queries import vignette_fit
from kinegrain.plans.match_queries import _names, parts
from kinegrain.plans.motion_queries import hourly, marked, streams
from kinegrain.plans.oracle import EVENTS
from kinegrain.plans.zoom_queries import LENS, SETTINGS, _orientations
from kinegrain.session import table
from kinegrain.streaming import host


def cache_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the files that keep what was made of each page's path."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", reports.cache_name(F.coalesce("url", F.lit(""))).alias("name"))


def preset_white(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature and tint of a white balance preset, null where a clip has none."""
    names = [*colour.PRESETS, "as shot", "custom"]
    p = parts(spark, sf_dir).select("p_partkey", F.get(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % len(names)).cast("int")).alias("preset"))
    pick = lambda k: F.create_map(*[F.lit(v) for n, t in colour.PRESETS.items() for v in (n, t[k])])[F.col("preset")]
    return p.select("p_partkey", "preset", pick(0).alias("kelvin"), pick(1).alias("tint"))


#: Two calibrations of a made camera, for illuminants 17 and 21.
CM1, CM2 = [0.9, -0.2, -0.1, -0.4, 1.2, 0.2, -0.1, 0.2, 0.7], [0.8, -0.3, -0.1, -0.5, 1.3, 0.2, -0.1, 0.1, 0.6]


def calibration_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the warmer calibration at each clip's temperature, and the matrix mixed by it."""
    p = parts(spark, sf_dir).select("p_partkey", (F.col("p_size") * 150 + 1500).cast("double").alias("kelvin"))
    warm, cold = float(colour.ILLUMINANTS[17]), float(colour.ILLUMINANTS[21])
    share = F.least(F.greatest((1 / F.col("kelvin") - 1 / cold) / (1 / warm - 1 / cold), F.lit(0.0)), F.lit(1.0))
    p = p.withColumn("share", share)
    mixed = [F.round(F.col("share") * a + (1 - F.col("share")) * b, 6).alias(f"m{k}") for k, (a, b) in enumerate(zip(CM1, CM2))]
    return p.select("p_partkey", F.round("share", 6).alias("share"), *mixed)


def determinant(m: list[list[Column]]) -> Column:
    """Along the first row; for the 4 x 4 systems of a fit."""
    if len(m) == 1:
        return m[0][0]
    terms = [m[0][j] * determinant([[row[k] for k in range(len(m)) if k != j] for row in m[1:]]) for j in range(len(m))]
    total = terms[0]
    for j, t in enumerate(terms[1:], 1):
        total = total - t if j % 2 else total + t
    return total


def vignette_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four coefficients of the radial gain: the normal equations solved, zeros where they are singular."""
    sums = vignette_fit(spark, sf_dir)  # one row
    m = [[F.col(f"m{i + j + 2}") for j in range(4)] for i in range(4)]
    b = [F.col(f"b{i + 1}") for i in range(4)]
    sums = sums.withColumn("det", determinant(m))
    found = [determinant([[b[i] if j == k else m[i][j] for j in range(4)] for i in range(4)]).alias(f"d{k}") for k in range(4)]
    return sums.select("det", *found).select(*[F.round(F.when(F.abs("det") < 1e-18, 0.0).otherwise(F.col(f"d{k}") / F.col("det")), 3).alias(f"a{k}") for k in range(4)])


def block_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly blocks as reports; every seventh hour stands for a frame without a block."""
    b = hourly(spark, sf_dir)
    sample = F.struct(F.col("first_v").alias("x"), F.col("last_v").alias("y"), F.col("n").alias("z"))
    b = b.select(
        "event_type", "hour", *[F.lit(v).alias(k) for k, v in {"window_w": 4608, "window_h": 3072, "recorded_w": 3000, "recorded_h": 2000, "ring_index": 0, "flags": 1, "take": 3, "readout_us": 18926,
                                                                "mark_delay_us": -5, "sensor_mode": 2, "resolution": 4, "dc_crop": 0, "bit_depth": 12, "lsb_per_dps": 16}.items()],
        F.col("hour").alias("frame"), F.col("clock").alias("clock_us"), "lost", F.array(F.lit(2), F.lit(-1), F.lit(3)).alias("axes"),
        F.when(F.col("hour") % 7 != 0, F.array(sample)).alias("samples"), F.lit("no block").alias("why"))
    return reports.block_report(b).select("event_type", "hour", "report")


def gyro_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole status line of each stream, from its facts and its number."""
    s = streams(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("frames"), F.count_if(F.col("event_id") % 7 == 0).alias("no_data"), F.max("value").alias("top"))
    u = F.col("user_id")
    s = s.select(
        "user_id", "frames", "no_data", F.when(u % 3 != 0, F.concat(F.lit("clip"), u.cast("string"))).alias("source"), (u % 97 + 2000.25).alias("rate_hz"),
        (u % 4 * 6.25).alias("readout_ms"), (u % 5 == 0).alias("readout_override"), (u % 50 + 14.5).alias("focal_mm"), (u % 6 == 1).alias("focal_override"),
        F.when(u % 8 != 0, u % 1000 + 1200.25).alias("focal_px"), F.lit(0.0).alias("pitch_nm"), F.when(u % 2 == 0, 4608).otherwise(6000).alias("window_w"), F.lit(3072).alias("window_h"),
        (u % 5).alias("window_source"), (u % 9 != 4).alias("enabled"), F.lit("focal length unknown").alias("why_off"), (u % 3 == 1).alias("dynamic"), F.lit(1.0).alias("manual_zoom"),
        F.lit(1.0625).alias("zoom_low"), F.lit(1.125).alias("zoom_mean"), (u % 8 / 8.0 + 1.25).alias("zoom_high"), (u % 4).alias("limited"), (u % 7 == 2).alias("ends_early"),
        F.when(u % 2 == 0, F.col("frames") + 5).alias("clip_frames"), (u % 11).alias("lost"), (u % 20 + 0.25).alias("sync_ms"), (u % 2 == 1).alias("from_exposure"), F.lit(0.02).alias("exposure_s"),
        (u % 10 == 3).alias("exposure_varies"), (u % 4 > 0).alias("readout_known"), (u % 3 - 1.0).alias("sync_offset_ms"), (u % 5).alias("late"), (u % 6).alias("dropped"),
        F.when(u % 4 == 0, 1).otherwise(0).alias("first"), (F.col("frames") - 1).alias("last"), F.when(u % 4 == 0, "from the host").otherwise("").alias("range_note"))
    return reports.status_text(s).select("user_id", "status")


def profile_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile for each supplier's clip, whose lens is named like the part of its number, among profiles made of all parts' names."""
    p = _names(spark, sf_dir, "p_partkey").join(parts(spark, sf_dir).select("p_partkey", "p_size"), "p_partkey")
    clips = p.join(table(spark, sf_dir, "supplier"), F.col("p_partkey") == F.col("s_suppkey")).select(F.col("p_partkey").alias("clip"), F.col("name").alias("lens_model"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_size").cast("double")).alias("focal_mm"))
    camera = F.when(F.col("p_partkey") % 10 == 0, "FUJIFILM X").otherwise("LEICA SL")
    mount = F.when(F.col("p_partkey") % 4 == 0, " l mount").otherwise("")
    path = F.concat(F.lit("/profiles/"), F.col("p_partkey").cast("string"), F.lit("/"), camera, F.lit(" ("), F.col("name"), mount, F.lit(") - RAW.lcp"))
    files = p.select(path.alias("path"), "p_partkey", "p_size")
    offered = profiles.installed(files.select("path")).join(files.select("path", F.col("p_partkey").alias("ordinal")), "path")
    entries = files.select(
        "path", F.col("p_size").cast("double").alias("focal"), (F.col("p_partkey") % 7 != 0).alias("has_warp"), (F.col("p_partkey") % 2 == 0).alias("has_vignette"),
        F.when(F.col("p_partkey") % 5 == 0, 1.5).otherwise(1.0).alias("format_factor"))
    return profiles.choose(clips, offered, entries, False).select("clip", "path", F.round("score", 6).alias("score"))


def frame_warps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The warp of every frame of each stream: its zoom, and the corner numbers of the first and last knot."""
    frames = marked(spark, sf_dir).select(F.col("user_id").alias("clip"), F.col("i").alias("frame"), (F.col("i") * 0.02).alias("t"), F.col("ok").alias("valid"))
    w = zoom.frame_warps(frames, _orientations(spark, sf_dir), 50.0, LENS, SETTINGS, 1.1)
    return w.select("clip", "frame", "on", F.round("inv_zoom", 6).alias("inv_zoom"), F.round(F.col("knots")[0][0], 6).alias("first"), F.round(F.col("knots")[32][5], 6).alias("last"))


def warped_picture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picture made of all vectors, through a warp, a lens and Lanczos-3 into a smaller frame, its vignette taken out."""
    rows = raster.from_embeddings(table(spark, sf_dir, "embeddings"))
    last = rows.agg(F.max("y").alias("y")).first().y or 0
    h = int(last) + 1
    level = F.transform("r", lambda v: v * 0.25 + 0.5)
    pictures = rows.select("img", "y", *[level.alias(f"r{k}") for k in range(3)])
    knots = [[1.0, -0.001 * k, 0.0, 0.001 * k, 1.0, 0.002, 0.0, -0.002, 1.0] for k in range(geometry.KNOTS)]
    warps = rows.select("img").distinct().select("img", F.lit(True).alias("on"), F.lit(0.95).alias("inv_zoom"), F.array(*[F.array(*[F.lit(v) for v in k]) for k in knots]).alias("knots"))
    g = develop.Geometry(
        48, 36, geometry.place(64, h, 48, 36, "stretch"), (0, 0, 64, h), None, geometry.Warp(200.0, 32.0, h / 2, float(h)), (32.0, h / 2, float(max(h, 64)) / 2, [0.98, 0, 0.01, 0, 0, 0, 0]), "lanczos3")
    out = develop.pass_through(pictures, g, warps, (32.0, h / 2, 2.0 / max(h, 64), (0.2, 0.05, 0.0, 0.0)))
    return out.select("y", "x", F.round("r", 6).alias("v"))


def host_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The used range of every render; streams stand for instances, of which some are retimed and some change their source."""
    s, u, i = streams(spark, sf_dir), F.col("user_id"), F.col("i")
    rows = s.select(
        "event_id", u.alias("instance"), i.alias("seq"), i.cast("double").alias("time"), F.when(u % 3 == 0, i + F.floor(i / 6)).otherwise(i + u % 4 - 1).cast("bigint").alias("source_frame"),
        F.when(i < 8, "a").otherwise("b").alias("source"), F.when(u % 5 > 0, F.lit(1.0)).alias("first"), (u % 10 + 3).cast("double").alias("last"))
    return host.host_ranges(rows).select("event_id", "retimed", "used_first", "used_last", "note")


QUERIES = {f.__name__: f for f in (host_ranges, cache_names, preset_white, calibration_mix, vignette_solve, block_reports, gyro_status, profile_choice, frame_warps, warped_picture)}


def _det(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    return "(" + "".join(("-" if j % 2 else "+") + f" {m[0][j]} * " + _det([[r[k] for k in range(len(m)) if k != j] for r in m[1:]]) for j in range(len(m))) + ")"


def _vignette_sql() -> str:
    from kinegrain.plans.colour_queries import SQL as COLOUR_SQL

    m = [[f"m{i + j + 2}" for j in range(4)] for i in range(4)]
    d = [_det([[f"b{i + 1}" if j == k else m[i][j] for j in range(4)] for i in range(4)]) for k in range(4)]
    return f"SELECT {', '.join(f'round(CASE WHEN abs({_det(m)}) < 1e-18 THEN 0 ELSE {x} / {_det(m)} END, 3) AS a{k}' for k, x in enumerate(d))} FROM ({COLOUR_SQL['vignette_fit']})"


_FNV = f"""list_reduce(list_prepend({reports.CACHE_START}::HUGEINT, list_transform(range(0, strlen(p)), lambda i: ('0x' || substr(hex(encode(p)), 2 * i + 1, 2))::HUGEINT)),
  lambda h, b: (xor(h, b) * {reports.FNV_FACTOR}::HUGEINT) % 18446744073709551616::HUGEINT)"""
_ZOOM = "(user_id % 8 / 8.0::DOUBLE + 1.25)"
SQL = {
    "host_ranges": f"""WITH {EVENTS}, r AS (SELECT event_id, user_id, i, i::DOUBLE AS t, CASE WHEN user_id % 3 = 0 THEN i // 6 ELSE user_id % 4 - 1 END AS o, i < 8 AS src,
  CASE WHEN user_id % 5 > 0 THEN 1.0::DOUBLE END AS a, user_id % 10 + 3 AS b FROM e),
m AS (SELECT *, coalesce(o <> lag(o) OVER (PARTITION BY user_id, src ORDER BY i), false) AS moved FROM r),
k AS (SELECT *, bool_or(moved) OVER (PARTITION BY user_id, src ORDER BY i) AS retimed, coalesce(b > a AND t BETWEEN a - 0.5::DOUBLE AND b + 0.5::DOUBLE, false) AS known FROM m),
g AS (SELECT *, known AND NOT retimed AND b + o >= 0 AND b >= a AS good FROM k)
SELECT event_id, retimed, CASE WHEN good THEN greatest(CAST(a + o AS BIGINT), 0) ELSE 0 END AS used_first, CASE WHEN good THEN CAST(b + o AS BIGINT) END AS used_last,
  CASE WHEN retimed THEN 'automatic: the clip is retimed, whole clip used' WHEN NOT known THEN 'automatic: the host reports no clip range'
    ELSE 'automatic: host clip range 1 to ' || b || ', source frame = time ' || CASE WHEN o + 1 >= 0 THEN '+' ELSE '' END || (o + 1) END AS note FROM g""",
    "cache_names": f"""WITH u AS (SELECT page_id, translate(coalesce(url, ''), 'abcdefghijklmnopqrstuvwxyz/', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ\\') AS p FROM pages),
h AS (SELECT page_id, {_FNV} AS h FROM u)
SELECT page_id, lower(lpad(hex((h // 4294967296)::UBIGINT), 8, '0')) || lower(lpad(hex((h % 4294967296)::UBIGINT), 8, '0')) || '.fpgc' AS name FROM h""",
    "preset_white": "WITH p AS (SELECT p_partkey, ["
    + ", ".join(f"'{n}'" for n in [*colour.PRESETS, "as shot", "custom"]) + "][p_partkey % 8 + 1] AS preset FROM part) SELECT p_partkey, preset, CASE preset "
    + " ".join(f"WHEN '{n}' THEN {t[0]}" for n, t in colour.PRESETS.items()) + " END AS kelvin, CASE preset " + " ".join(f"WHEN '{n}' THEN {t[1]}" for n, t in colour.PRESETS.items()) + " END AS tint FROM p",
    "calibration_mix": """WITH s AS (SELECT p_partkey, least(greatest((1 / (p_size * 150 + 1500)::DOUBLE - 1 / 6504::DOUBLE) / (1 / 2856::DOUBLE - 1 / 6504::DOUBLE), 0), 1) AS s FROM part)
SELECT p_partkey, round(s, 6) AS share, """ + ", ".join(f"round(s * {a}::DOUBLE + (1 - s) * {b}::DOUBLE, 6) AS m{k}" for k, (a, b) in enumerate(zip(CM1, CM2))) + " FROM s",
    "vignette_solve": _vignette_sql(),
    "block_reports": f"""WITH {EVENTS}, b AS (SELECT event_type, us // 3600000000 AS hour, count(*) AS n, max(us) % 4294967296 AS clock, arg_min(event_id, (us, event_id)) AS a, arg_max(event_id, (us, event_id)) AS z FROM e GROUP BY ALL)
SELECT event_type, hour, CASE WHEN hour % 7 = 0 THEN '{{"present":0,"why":"no block"}}' ELSE '{{"window":[4608,3072],"recorded":[3000,2000],"present":1,"frame":' || hour || ',"clock_us":' || clock
  || ',"n":1,"ring_index":0,"flags":1,"lost":' || CASE WHEN hour % 5 = 0 THEN 99 ELSE 0 END || ',"take":3,"readout_us":18926,"mark_delay_us":-5,"sensor_mode":2,"resolution":4,"dc_crop":0,"bit_depth":12,"axes":[2,-1,3],"lsb_per_dps":16,"samples":['
  || a || ',' || z || ',' || n || ']}}' END AS report FROM b""",
    "gyro_status": f"""WITH {EVENTS}, s AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_id % 7 = 0) AS bad FROM e GROUP BY user_id),
f AS (SELECT *, user_id % 9 <> 4 AS enabled, user_id % 8 <> 0 AS focal FROM s)
SELECT user_id, CASE WHEN NOT enabled THEN 'Off (switched off) | ' WHEN NOT focal THEN 'Off: focal length unknown | ' ELSE 'On | ' END
|| CASE WHEN user_id % 3 <> 0 THEN 'clip' || user_id || ': ' || n || ' frames, ' ELSE 'gyro: ' || n || ' frames, in-frame, ' END || printf('%.2f Hz', user_id % 97 + 2000.25::DOUBLE)
|| CASE WHEN user_id % 4 > 0 THEN printf(', readout %.1f ms', user_id % 4 * 6.25::DOUBLE + 0.0001) || CASE WHEN user_id % 5 = 0 THEN ' (override)' ELSE '' END ELSE ', readout unknown (no rolling-shutter correction)' END
|| CASE WHEN focal THEN printf(', %.1f mm', user_id % 50 + 14.5::DOUBLE) || CASE WHEN user_id % 6 = 1 THEN ' (override)' ELSE '' END || ' = ' || (user_id % 1000 + 1200) || ' px'
  || CASE WHEN user_id % 2 = 0 THEN ' (sensor window 4608x3072' || ['', '', ', MQ 50', ', MQ 50, recognised by its readout', ', DC Crop'][user_id % 5 + 1] || ')' ELSE '' END
  || CASE WHEN enabled THEN CASE WHEN user_id % 3 = 1 THEN ', zoom 1.063 to ' || printf('%.3f', {_ZOOM}) || ' (dynamic, mean 1.125)' ELSE printf(', zoom %.3f', {_ZOOM}) END
    || CASE WHEN user_id % 4 > 0 THEN ' (at the limit: stabilisation reduced on ' || user_id % 4 || ' frames)' ELSE '' END ELSE '' END ELSE '' END
|| CASE WHEN user_id % 7 = 2 THEN ' | gyro data ends at frame ' || n || CASE WHEN user_id % 2 = 0 THEN ' of ' || (n + 5) ELSE ' (before the end of the clip)' END || ': stabilisation fades out over the second before it' ELSE '' END
|| CASE WHEN bad > 0 THEN ' | no gyro data on ' || bad || ' of ' || n || ' frames: not stabilised there' ELSE '' END
|| CASE WHEN user_id % 11 > 0 THEN ' | ' || user_id % 11 || ' gyro samples missing (bridged)' ELSE '' END
|| CASE WHEN user_id % 2 = 1 THEN CASE WHEN user_id % 10 = 3 THEN ' | sync ' || user_id % 20 || '.3 ms at the start = readout/2 + exposure/2 (the exposure changes in the clip)' ELSE ' | sync ' || user_id % 20 || '.3 ms = readout/2 + exposure/2 (1/50 s)' END
  ELSE ' | sync ' || user_id % 20 || '.3 ms from the gyro data (' || CASE WHEN user_id % 4 > 0 THEN 'exposure time' ELSE 'readout time' END || ' unknown)' END
|| CASE user_id % 3 WHEN 0 THEN ' -1.0 ms offset' WHEN 2 THEN ' +1.0 ms offset' ELSE '' END
|| CASE WHEN user_id % 5 > 0 THEN ' | ' || user_id % 5 || ' late frame marks corrected' ELSE '' END || CASE WHEN user_id % 6 > 0 THEN ' | ' || user_id % 6 || ' frames dropped by the camera' ELSE '' END
|| CASE WHEN user_id % 4 = 0 THEN ' | range: frames 2 to ' || n || ' of ' || n || ' (from the host)' ELSE ' | range: whole clip' END AS status FROM f""",
}
