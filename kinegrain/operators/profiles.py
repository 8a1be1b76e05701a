"""Installed lens profiles and the one that fits a clip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinegrain.operators.matching import is_aperture, meet, words

#: Words that say what a profile holds, and cameras whose profiles do not reach a full-frame corner.
CONTENT = ("distortion", "vignette", "distortion_vignette")
SMALL_SENSORS = ("fujifilm", "olympus", "om digital")
#: Least share of common words, bonus for the preferred mount, focal coverage in logarithms, format
#: factor above which a profile is of a smaller sensor, and what that costs.
LEAST, BONUS, COVERS, FULL_FRAME, PENALTY = 0.5, 0.05, 0.08, 1.1, 0.3
#: Width of a bucket of focal lengths, in logarithms: what covers a focal length is in its bucket or the next.
FOCAL_STEP = COVERS * 1.01


def installed(files: DataFrame) -> DataFrame:
    """(path, name, preferred) of the profile files among ``files`` (path): the lens's words stand between the outermost brackets.

    Other files, files without brackets or words, and those made on smaller sensors are left out.
    """
    file = F.regexp_extract("path", r"[^/\\]*$", 0)
    inner = F.regexp_extract(file, r"^([^(]*)\((.*)\)", 2)
    camera = F.lower(F.regexp_extract(file, r"^([^(]*)\((.*)\)", 1))
    small = F.lit(False)
    for brand in SMALL_SENSORS:
        small = small | camera.contains(brand)
    rows = files.where(F.lower(file).endswith(".lcp") & file.rlike(r"^[^(]*\(.*\)") & ~small)
    named = rows.select("path", F.filter(words(inner), lambda w: ~w.isin(*CONTENT)).alias("name")).where(F.size("name") > 0)
    return named.withColumn("preferred", F.array_contains("name", "mount") & F.array_contains("name", "l"))


def known_as(name: Column) -> Column:
    """The words a profile answers to: its own, and of ``c019`` also ``019`` (three digits and more after one character)."""
    tails = F.filter(F.transform(name, lambda w: F.substring(w, 2, 1 << 20)), lambda t: t.rlike("^[0-9]{3,}$"))
    return F.array_distinct(F.concat(name, tails))


def choose(clips: DataFrame, profiles: DataFrame, entries: DataFrame, vignette: bool) -> DataFrame:
    """The profile of each clip: clip, path, score; clips that none fits have no row.

    ``clips`` holds (clip, lens_model, focal_mm), ``profiles`` what `installed`
    gives with an ``ordinal``, ``entries`` the calibrations (path, focal,
    has_warp, has_vignette, format_factor). Every aperture of the clip's lens
    must be in the profile's name, and a focal length where the clip does not
    tell its own; so names meet on an aperture, else on focal lengths, else on
    any word, and near the clip's focal length or on one of its name. All
    profiles that fit and cover the clip are judged; of those with the same
    words, focal length and kind of sensor the first one stands for the rest,
    which never come before it. Of equal scores the better fit wins, then the
    lower ordinal.
    """
    known, focals = F.col("own_focal") > 0, lambda c: F.array_distinct(F.filter(c, lambda w: w.contains("mm")))
    bucket = lambda c: F.floor(F.log(c) / FOCAL_STEP).cast("double")
    # Clips that tell their focal length meet entries of its bucket and those without one (""), others any entry of a focal length in their name.
    own = F.when(F.col("focal_mm") > 0, F.col("focal_mm").cast("double")).otherwise(0.0)
    asked = clips.select("clip", own.alias("own_focal"), F.array_sort(words(F.col("lens_model"))).alias("want")).where(F.size("want") > 0)
    near = F.when(known, F.array(bucket("own_focal").cast("string"), F.lit(""))).otherwise(focals("want"))
    wants = asked.select("want", "own_focal").distinct().withColumn("near", F.explode(near))
    c = wants.select("want", "near", known.alias("known")).distinct().withColumn("apertures", F.array_distinct(F.filter("want", is_aperture)))
    keys = F.when(F.size("apertures") > 0, F.slice(F.array_sort("apertures"), 1, 1)).when(~F.col("known"), F.array("near")).otherwise(F.array_distinct("want"))
    c = c.withColumn("keys", keys).withColumn("key", F.explode("keys"))

    small, b = F.coalesce(F.col("format_factor") > FULL_FRAME, F.lit(False)), bucket("e_focal")
    held = entries.where(F.col("has_vignette") if vignette else F.col("has_warp"))
    held = held.select("path", F.when(F.col("focal") > 0, F.col("focal").cast("double")).alias("e_focal"), small.alias("small"))
    p = profiles.select("path", F.array_sort("name").alias("name"), "preferred", "ordinal").join(held, "path")
    p = p.groupBy("name", "preferred", "small", "e_focal").agg(F.min(F.struct("ordinal", "path")).alias("first"))
    around = F.when(F.col("e_focal").isNull(), F.array(F.lit(""))).otherwise(F.transform(F.array(b - 1, b, b + 1), lambda n: n.cast("string")))
    whole = p.groupBy("name", "preferred", "small").agg(F.min("first").alias("first")).withColumn("e_focal", F.lit(None).cast("double"))
    p = p.withColumn("near", F.explode(around)).unionByName(whole.withColumn("near", F.explode(focals("name")))).withColumn("answers", known_as(F.col("name")))
    p = p.withColumn("key", F.explode("answers"))

    # A pair meets once, on the first of the keys that both have.
    pairs = meet(c, p, ["near", "key"]).where((F.size("keys") == 1) | (F.col("key") == F.filter("keys", lambda k: F.array_contains("answers", k))[0]))
    pairs = pairs.where((F.size("apertures") <= 1) | (F.size(F.array_except("apertures", "answers")) == 0))
    found = lambda w: F.array_contains("answers", w)
    share = F.size(F.filter("want", found)) / F.sqrt((F.size("want") * F.size("name")).cast("double"))
    fits = pairs.withColumn("fit", share).where(F.col("fit") >= LEAST).withColumn("fit", F.col("fit") + F.when(F.col("preferred"), BONUS).otherwise(0.0))
    fits = fits.withColumn("score", F.col("fit") - F.when(F.col("small"), PENALTY).otherwise(0.0)).where(F.col("score") >= LEAST)
    # Clips of the same words differ only in which focal lengths cover theirs: the best of each one is kept.
    least = F.min(F.struct((-F.col("score")).alias("score"), (-F.col("fit")).alias("fit"), "first"))
    best = fits.groupBy("want", "near", "e_focal").agg(least.alias("b"))
    covered = F.col("e_focal").isNull() | (F.abs(F.log(F.col("e_focal") / F.col("own_focal"))) < COVERS)
    chosen = wants.join(best, ["want", "near"]).where(covered).groupBy("want", "own_focal").agg(F.min("b").alias("b"))
    chosen = chosen.select("want", "own_focal", F.col("b.first.path").alias("path"), (-F.col("b.score")).alias("score"))
    return asked.join(chosen, ["want", "own_focal"]).select("clip", "path", "score").distinct()
