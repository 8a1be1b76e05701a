"""Queries over sample streams. Events stand in: a stream for each user, a signal, a clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinegrain.functions import tone
from kinegrain.operators import motion as m
from kinegrain.plans.oracle import EVENTS
from kinegrain.session import table

SIGMA, REACH, RATE = 86_400.0, 3, 0.001


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, value, us, t and i: the sample's number in its stream."""
    e = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", F.col("value").cast("double").alias("value"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    return e.withColumn("t", F.col("us") / 1e6).withColumn("i", F.row_number().over(w).cast("bigint") - 1)


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams whose sample is usable unless its id is a multiple of 7."""
    return streams(spark, sf_dir).withColumn("ok", F.col("event_id") % 7 != 0)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks: events of one type in one hour, with counts, a wrapping clock and a reported loss."""
    e = streams(spark, sf_dir)
    b = e.groupBy("event_type", F.floor(F.col("us") / 3_600_000_000).alias("hour")).agg(
        F.count("*").alias("n"), F.max("us").alias("us"), F.min_by("event_id", F.struct("us", "event_id")).alias("first_v"), F.max_by("event_id", F.struct("us", "event_id")).alias("last_v"))
    return b.withColumn("clock", F.pmod(F.col("us"), F.lit(m.CLOCK_SPAN))).withColumn("lost", F.when(F.col("hour") % 5 == 0, 99).otherwise(0))


def gauss_lowpass_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = m.gaussian_lowpass(streams(spark, sf_dir), "user_id", "t", "value", SIGMA)
    r = F.abs(F.col("value") - F.col("smooth"))
    return s.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max(r), 6).alias("largest"), F.round(F.avg(r), 6).alias("mean"))


def gauss_row_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = m.gaussian_row_mean(streams(spark, sf_dir), "user_id", "i", "value", REACH)
    return out.select("event_id", F.round("mean", 6).alias("mean"))


def envelope_min_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = m.envelope(marked(spark, sf_dir), "user_id", "i", "value", "ok", 1)
    return out.select("event_id", F.round("low", 6).alias("low"), F.round("env", 6).alias("env"))


def envelope_max_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest need nearby inside the middle three fifths of a stream, the ends' values outside; share: smallest, then mean."""
    s = streams(spark, sf_dir).withColumn("edge", F.floor(F.count("*").over(Window.partitionBy("user_id")) / 5))
    w = Window.partitionBy("user_id").orderBy("i")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inside = s.withColumn("most", F.max("i").over(whole)).where("i BETWEEN edge AND most - edge")
    near = w.rowsBetween(-REACH, REACH)
    need = inside.withColumn("top", F.greatest(F.lit(1.0), F.max(F.col("value") / 50).over(near))).withColumn("low", F.min(F.least(F.lit(1.0), F.col("value") / 50)).over(near))
    need = need.withColumn("share", F.avg("low").over(near)).select("event_id", "top", "share")
    every = s.join(need, "event_id", "left")
    filled = F.coalesce("top", F.when(F.col("i") < F.col("edge"), F.first("top", True).over(whole)).otherwise(F.last("top", True).over(whole)))
    return every.select("event_id", F.round(filled, 6).alias("top"), F.round("share", 6).alias("share"))


def upper_median_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = m.steps(marked(spark, sf_dir), "user_id", "i", "t", "ok")
    return s.groupBy("user_id").agg(
        F.round(m.upper_median(F.col("step")), 6).alias("step"), F.count_if(F.col("step") > 86400).alias("late"))


def cadence_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams(spark, sf_dir).groupBy("user_id").agg(F.coalesce(F.regr_slope("value", F.col("i").cast("double")), F.lit(0.0)).alias("slope"))
    return s.select("user_id", F.round("slope", 6).alias("slope"))


def clock_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = m.unwrap_clock(hourly(spark, sf_dir), "event_type", "hour", "clock")
    w = Window.partitionBy("event_type").orderBy("hour")
    rate = b.withColumn("after", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    span = rate.groupBy("event_type").agg(((F.max_by("after", "hour") - F.min_by("after", "hour")) * 1e6 / F.max("elapsed")).alias("rate"))
    return rate.join(span, "event_type").select("event_type", "hour", "elapsed", F.round("rate", 9).alias("rate"))


def with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = m.unwrap_clock(hourly(spark, sf_dir), "event_type", "hour", "clock").withColumn("rate", F.lit(0.05))
    return m.detect_gaps(b, "event_type", "hour", "elapsed", "n", "lost", "rate")


def gap_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_gaps(spark, sf_dir).select("event_type", "hour", "gap", "broken")


def gap_fill_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = m.fill_gaps(with_gaps(spark, sf_dir), "event_type", "hour", "gap", ["first_v"], ["last_v"])
    return line.groupBy("event_type", "hour").agg(F.count("*").alias("n"), F.sum("axis0").alias("total"), F.min("axis0").alias("low"), F.max("axis0").alias("high"))


def frame_table_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for every hour of all; hours without a block of a type are frames between blocks."""
    b = with_gaps(spark, sf_dir)
    w = Window.partitionBy("event_type").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("after", F.sum(F.col("n") + F.col("gap")).over(w))
    span = b.agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    kinds = b.select("event_type").distinct().crossJoin(F.broadcast(span))  # one row
    frames = kinds.select("event_type", F.explode(F.sequence("a", "b")).alias("hour")).join(b.select("event_type", "hour", "after", "gap", "broken"), ["event_type", "hour"], "left").withColumn("exists", F.col("hour") % 3 != 0)
    out = m.frame_table(frames, "event_type", "hour", "after", "gap", "broken", "exists", 2.5)
    return out.select("event_type", "hour", "n", "valid")


def majority_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = streams(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")
    return c.withColumn("k", F.row_number().over(w)).where("k = 1").select("user_id", "event_type", "n")


def rising_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams(spark, sf_dir).withColumn("take", F.col("event_id") % 2).withColumn("frame", (F.col("value") * 10).cast("bigint"))
    return m.keep_take(s, "user_id", "i", "take", "frame").select("event_id", "user_id", "take", "frame")


def distance_to_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.distance_to_gap(marked(spark, sf_dir), "user_id", "i", "ok", 5).select("event_id", "distance")


def fade_smoothstep(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = m.distance_to_gap(marked(spark, sf_dir), "user_id", "i", "ok", 8)
    g = tone.smoothstep(0.0, 1.0, F.greatest(F.col("distance") - 1, F.lit(0)).cast("double") / 5.0)
    return d.select("event_id", F.round(1 + (F.col("value") / 100) * g, 6).alias("zoom"))


def asof_lerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams(spark, sf_dir)
    points = s.select("event_id", "user_id", (F.col("value") / 10 - 1).alias("at"))
    return m.at_time(points, s, "user_id", "at", "i", "value", 1.0).select("event_id", F.round("v", 6).alias("v"))


def exposure_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of every fourth sample, interpolated between and held outside."""
    s = streams(spark, sf_dir).withColumn("probe", F.when(F.col("i") % 4 == 1, F.struct(F.col("i").alias("i"), F.col("value").alias("v"))))
    w = Window.partitionBy("user_id").orderBy("i")
    s = s.withColumn("a", F.last("probe", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.first("probe", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    between = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("i") - F.col("a.i")) / F.greatest(F.col("b.i") - F.col("a.i"), F.lit(1))
    return s.select("event_id", F.round(F.coalesce(between, "a.v", "b.v"), 6).alias("exposure"))


def nearest_earlier_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = marked(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("i").rowsBetween(-10, -1)
    found = F.when(F.col("ok"), F.col("event_id")).otherwise(F.last(F.when(F.col("ok"), F.col("event_id")), True).over(w))
    return s.select("event_id", found.alias("shown"))


def range_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The used range of every stream for a wanted one that may be reversed or too long, and each sample's piece."""
    s = streams(spark, sf_dir)
    w = Window.partitionBy("user_id")
    n = F.max("i").over(w)
    hold = lambda v: F.least(F.greatest(v, F.lit(0)), n)
    a, b = hold(F.col("user_id") % 9 - 2), hold(F.col("user_id") % 5 + 3)
    s = s.withColumn("first", F.when(a > b, 0).otherwise(a)).withColumn("last", F.when(a > b, n).otherwise(b))
    return s.select("event_id", "first", "last", F.when(F.col("i") < F.col("first"), 0).when(F.col("i") > F.col("last"), 2).otherwise(1).alias("piece"))


def dropped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = marked(spark, sf_dir).select("user_id", "i", (F.col("i") * 0.04 + F.col("value") / 5e4).alias("mark"), "ok")
    return m.regular_marks(s, "user_id", "i", "mark", "ok", 25.0)


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams(spark, sf_dir)
    return s.select("user_id", "i", (F.col("value") / 50).alias("a"), F.sin("value").alias("b"), F.cos(F.col("value") * 2).alias("c"))


def quaternion_integrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = m.integrate_streams(_rates(spark, sf_dir), "user_id", "i", ["a", "b", "c"], 0.1)
    return q.select("user_id", "i", *[F.round(c, 6).alias(c) for c in "wxyz"])


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams(spark, sf_dir)
    n = F.col("n")
    ranked = m.values_at_ranks(s, "event_type", "value", {"median": F.floor(n / 2), "p95": F.floor(n * 95 / 100)})
    rest = s.groupBy("event_type").agg(F.max("value").alias("top"), F.count_if(F.col("value") > 90).alias("late"))
    return ranked.join(rest, "event_type").select("event_type", "median", "p95", "top", "late")


def rate_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = m.unwrap_clock(hourly(spark, sf_dir), "event_type", "hour", "clock")
    w = Window.partitionBy("event_type").orderBy("hour")
    b = b.withColumn("dt", F.col("elapsed") - F.lag("elapsed").over(w))
    good = (F.col("lost") == 0) & (F.col("dt") > 0)
    rates = b.where(good).select("event_type", (F.col("n") * 1e6 / F.col("dt")).alias("v"))
    return m.values_at_ranks(rates, "event_type", "v", {"rate": F.floor(F.col("n") / 2)}).select("event_type", F.round("rate", 9).alias("rate"))


def zoom_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = streams(spark, sf_dir).groupBy("user_id").agg(
        F.round(F.least(F.lit(4.0), F.min(1 + F.col("value") / 200)), 6).alias("low"), F.round(F.avg(1 + F.col("value") / 200), 6).alias("mean"),
        F.round(F.greatest(F.lit(1.0), F.max(1 + F.col("value") / 200)), 6).alias("high"))
    return z


def loss_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_gaps(spark, sf_dir).groupBy("event_type").agg(
        F.count_if("broken").alias("broken"), F.sum("gap").alias("lost"), F.count("*").alias("blocks"))


def cheapest_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of four smoothing reaches the one with the least cost, the first of equals."""
    s = streams(spark, sf_dir)
    parts = []
    for k in range(4):
        r = m.gaussian_row_mean(s, "user_id", "i", "value", k + 1).withColumn("d", F.abs(F.col("value") - F.col("mean")))
        over = F.count_if(F.round(F.col("d"), 6) > 30)
        parts.append(r.groupBy("user_id").agg(over.alias("over"), F.max("d").alias("most")).withColumn("variant", F.lit(k)))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    cost = F.col("over") * 1_000_000 + F.round(F.col("most"), 3)
    return every.groupBy("user_id").agg(F.min_by("variant", F.struct(cost, "variant")).alias("variant"), F.round(F.min(cost), 3).alias("cost"))


QUERIES = {f.__name__: f for f in (
    gauss_lowpass_residual, gauss_row_mean, envelope_min_mean, envelope_max_need, upper_median_steps, cadence_slope, clock_unwrap, gap_detect,
    gap_fill_linear, frame_table_interp, majority_take, rising_counter, distance_to_gap, fade_smoothstep, asof_lerp, exposure_probes,
    nearest_earlier_ok, range_pieces, dropped_frames, quaternion_integrate, latency_percentiles, rate_median, zoom_stats, loss_counts, cheapest_variant)}

_OK = "event_id % 7 <> 0"
_BLOCKS = """b AS (SELECT event_type, us // 3600000000 AS hour, count(*) AS n, max(us) AS us, arg_min(event_id, (us, event_id)) AS first_v, arg_max(event_id, (us, event_id)) AS last_v,
    CASE WHEN (us // 3600000000) % 5 = 0 THEN 99 ELSE 0 END AS lost FROM e GROUP BY ALL),
c AS (SELECT *, us - first_value(us) OVER (PARTITION BY event_type ORDER BY hour) AS whole, us % 4294967296 AS clock FROM b),
s AS (SELECT *, coalesce((clock - lag(clock) OVER w + 4294967296) % 4294967296, 0) AS step FROM c WINDOW w AS (PARTITION BY event_type ORDER BY hour)),
u AS (SELECT *, CAST(sum(step) OVER (PARTITION BY event_type ORDER BY hour) AS BIGINT) AS elapsed FROM s)"""
_GAPS = """x AS (SELECT *, lag(elapsed) OVER w AS before, CAST(round(0.05::DOUBLE * (elapsed - lag(elapsed) OVER w) / 1000000) AS BIGINT) - lost - n AS extra FROM u WINDOW w AS (PARTITION BY event_type ORDER BY hour)),
g AS (SELECT *, CASE WHEN before IS NULL THEN 0 ELSE lost + CASE WHEN extra > 50 OR (lost >= 99 AND extra > 0) THEN extra ELSE 0 END END AS gap,
    coalesce(before IS NOT NULL AND extra > 50, false) AS broken FROM x)"""


def _row_mean(reach: int) -> str:
    return f"""SELECT a.user_id, a.event_id, a.value, sum(b.value * exp(-0.5::DOUBLE * pow((b.i - a.i) / ({reach} / 2.0::DOUBLE), 2))) / sum(exp(-0.5::DOUBLE * pow((b.i - a.i) / ({reach} / 2.0::DOUBLE), 2))) AS mean
  FROM e a JOIN e b ON a.user_id = b.user_id AND abs(a.i - b.i) <= {reach} GROUP BY ALL"""


SQL = {
    "gauss_lowpass_residual": f"""WITH {EVENTS},
m AS (SELECT a.event_id, a.user_id, a.value, sum(b.value * exp(-0.5::DOUBLE * pow((b.t - a.t) / {SIGMA}::DOUBLE, 2))) / sum(exp(-0.5::DOUBLE * pow((b.t - a.t) / {SIGMA}::DOUBLE, 2))) AS smooth
  FROM e a JOIN e b ON a.user_id = b.user_id AND b.t >= a.t - {3 * SIGMA}::DOUBLE AND b.t <= a.t + {3 * SIGMA}::DOUBLE GROUP BY ALL)
SELECT user_id, count(*) AS n, round(max(abs(value - smooth)), 6) AS largest, round(avg(abs(value - smooth)), 6) AS mean FROM m GROUP BY user_id""",
    "gauss_row_mean": f"WITH {EVENTS} SELECT event_id, round(mean, 6) AS mean FROM ({_row_mean(REACH)})",
    "envelope_min_mean": f"""WITH {EVENTS},
l AS (SELECT *, min(value) FILTER ({_OK}) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS l FROM e),
f AS (SELECT *, coalesce(last_value(l IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(l IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS low FROM l)
SELECT event_id, round(low, 6) AS low, round(avg(low) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS env FROM f""",
    "envelope_max_need": f"""WITH {EVENTS},
z AS (SELECT user_id, count(*) // 5 AS edge, count(*) - 1 - count(*) // 5 AS last FROM e GROUP BY user_id),
v AS (SELECT e.* FROM e JOIN z ON z.user_id = e.user_id AND i BETWEEN edge AND last),
r AS (SELECT a.user_id, a.i, greatest(1, max(b.value / 50)) AS top, min(least(1, b.value / 50)) AS low FROM v a JOIN v b ON a.user_id = b.user_id AND abs(a.i - b.i) <= 3 GROUP BY ALL),
q AS (SELECT a.user_id, a.i, any_value(a.top) AS top, avg(b.low) AS share FROM r a JOIN r b ON a.user_id = b.user_id AND abs(a.i - b.i) <= 3 GROUP BY ALL)
SELECT e.event_id, round(coalesce(q.top, CASE WHEN e.i < z.edge THEN (SELECT arg_min(top, i) FROM q y WHERE y.user_id = e.user_id) ELSE (SELECT arg_max(top, i) FROM q y WHERE y.user_id = e.user_id) END), 6) AS top, round(q.share, 6) AS share
FROM e JOIN z ON z.user_id = e.user_id LEFT JOIN q ON q.user_id = e.user_id AND q.i = e.i""",
    "upper_median_steps": f"""WITH {EVENTS},
s AS (SELECT user_id, (t - lag(t) OVER w) / (i - lag(i) OVER w) AS step FROM e WHERE {_OK} WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, round(list_sort(list(step) FILTER (step IS NOT NULL))[CAST(count(step) // 2 + 1 AS INTEGER)], 6) AS step, count(*) FILTER (step > 86400) AS late FROM s GROUP BY user_id""",
    "cadence_slope": f"WITH {EVENTS} SELECT user_id, round(coalesce(regr_slope(value, i::DOUBLE), 0), 6) AS slope FROM e GROUP BY user_id",
    "clock_unwrap": f"""WITH {EVENTS}, {_BLOCKS},
a AS (SELECT *, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY hour) AS BIGINT) AS after FROM u),
r AS (SELECT event_type, (arg_max(after, hour) - arg_min(after, hour)) * 1000000.0::DOUBLE / max(elapsed) AS rate FROM a GROUP BY event_type)
SELECT a.event_type, a.hour, a.elapsed, round(r.rate, 9) AS rate FROM a JOIN r ON a.event_type = r.event_type""",
    "gap_detect": f"WITH {EVENTS}, {_BLOCKS}, {_GAPS} SELECT event_type, hour, gap, broken FROM g",
    "gap_fill_linear": f"""WITH {EVENTS}, {_BLOCKS}, {_GAPS},
f AS (SELECT *, coalesce(lag(last_v) OVER (PARTITION BY event_type ORDER BY hour), 0) AS a FROM g),
l AS (SELECT event_type, hour, CAST(round(a + (first_v - a) * j::DOUBLE / (gap + 1)) AS BIGINT) AS v FROM (SELECT *, unnest(range(1, gap + 1)) AS j FROM f WHERE gap > 0))
SELECT event_type, hour, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, min(v) AS low, max(v) AS high FROM l GROUP BY ALL""",
    "frame_table_interp": f"""WITH {EVENTS}, {_BLOCKS}, {_GAPS},
a AS (SELECT *, CAST(sum(n + gap) OVER (PARTITION BY event_type ORDER BY hour) AS BIGINT) AS after FROM g),
h AS (SELECT unnest(range((SELECT min(hour) FROM a), (SELECT max(hour) + 1 FROM a))) AS hour),
f AS (SELECT k.event_type, h.hour, a.after, p.hour AS ph, p.after AS pn, q.hour AS qh, q.after AS qn, q.gap AS qg, q.broken AS qb
  FROM (SELECT DISTINCT event_type FROM a) k CROSS JOIN h LEFT JOIN a ON a.event_type = k.event_type AND a.hour = h.hour
  LEFT JOIN a p ON p.event_type = k.event_type AND p.hour = (SELECT max(z.hour) FROM a z WHERE z.event_type = k.event_type AND z.hour <= h.hour)
  LEFT JOIN a q ON q.event_type = k.event_type AND q.hour = (SELECT min(z.hour) FROM a z WHERE z.event_type = k.event_type AND z.hour >= h.hour))
SELECT event_type, hour, CAST(CASE WHEN after IS NOT NULL THEN after WHEN ph IS NULL THEN floor(greatest(0, qn - (qh - hour) * 2.5::DOUBLE)) WHEN qh IS NULL THEN pn
  ELSE pn + round((qn - pn)::DOUBLE * (hour - ph) / (qh - ph)) END AS BIGINT) AS n,
  after IS NOT NULL OR coalesce(ph IS NOT NULL AND qh IS NOT NULL AND ((qg = 0 AND NOT qb) OR hour % 3 = 0), false) AS valid FROM f""",
    "majority_take": f"""WITH {EVENTS}, c AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY ALL)
SELECT user_id, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1""",
    "rising_counter": f"""WITH {EVENTS}, f AS (SELECT *, event_id % 2 AS take, CAST(trunc(value * 10) AS BIGINT) AS frame FROM e),
t AS (SELECT user_id, take FROM (SELECT user_id, take, count(*) AS n FROM f GROUP BY user_id, take) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, take) = 1),
k AS (SELECT f.*, max(frame) OVER (PARTITION BY f.user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM f JOIN t ON f.user_id = t.user_id AND f.take = t.take)
SELECT event_id, user_id, take, frame FROM k WHERE high IS NULL OR frame > high""",
    "distance_to_gap": f"""WITH {EVENTS} SELECT a.event_id, coalesce(min(least(abs(a.i - b.i), 5)), 5) AS distance FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.event_id % 7 = 0 GROUP BY a.event_id""",
    "fade_smoothstep": f"""WITH {EVENTS}, d AS (SELECT a.event_id, a.value, coalesce(min(least(abs(a.i - b.i), 8)), 8) AS d FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.event_id % 7 = 0 GROUP BY ALL),
u AS (SELECT *, least(greatest(d - 1, 0) / 5.0::DOUBLE, 1) AS u FROM d)
SELECT event_id, round(1 + value / 100 * u * u * (3 - 2 * u), 6) AS zoom FROM u""",
    "asof_lerp": f"""WITH {EVENTS}, l AS (SELECT user_id, max(i) AS l FROM e GROUP BY user_id),
p AS (SELECT e.event_id, e.user_id, l, least(greatest(value / 10 - 1, 0), l) AS s FROM e JOIN l ON l.user_id = e.user_id),
q AS (SELECT *, greatest(least(CAST(floor(s) AS BIGINT), l - 1), 0) AS i FROM p)
SELECT q.event_id, round(a.value + (q.s - q.i) * (coalesce(b.value, a.value) - a.value), 6) AS v FROM q JOIN e a ON a.user_id = q.user_id AND a.i = q.i LEFT JOIN e b ON b.user_id = q.user_id AND b.i = q.i + 1""",
    "exposure_probes": f"""WITH {EVENTS}, p AS (SELECT user_id, i, value FROM e WHERE i % 4 = 1)
SELECT e.event_id, round(coalesce(a.value + (b.value - a.value) * (e.i - a.i) / greatest(b.i - a.i, 1), a.value, b.value), 6) AS exposure
FROM e LEFT JOIN p a ON a.user_id = e.user_id AND a.i = (SELECT max(z.i) FROM p z WHERE z.user_id = e.user_id AND z.i <= e.i)
LEFT JOIN p b ON b.user_id = e.user_id AND b.i = (SELECT min(z.i) FROM p z WHERE z.user_id = e.user_id AND z.i >= e.i)""",
    "nearest_earlier_ok": f"""WITH {EVENTS} SELECT a.event_id, CASE WHEN a.event_id % 7 <> 0 THEN a.event_id ELSE arg_max(b.event_id, b.i) END AS shown
FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 10 AND a.i - 1 AND b.event_id % 7 <> 0 GROUP BY a.event_id""",
    "range_pieces": f"""WITH {EVENTS}, n AS (SELECT *, max(i) OVER (PARTITION BY user_id) AS n FROM e),
h AS (SELECT *, least(greatest(user_id % 9 - 2, 0), n) AS a, least(greatest(user_id % 5 + 3, 0), n) AS b FROM n),
r AS (SELECT *, CASE WHEN a > b THEN 0 ELSE a END AS first, CASE WHEN a > b THEN n ELSE b END AS last FROM h)
SELECT event_id, first, last, CASE WHEN i < first THEN 0 WHEN i > last THEN 2 ELSE 1 END AS piece FROM r""",
    "quaternion_integrate": f"""WITH RECURSIVE {EVENTS},
r AS (SELECT user_id, i, value / 50 AS a, sin(value) AS b, cos(value * 2) AS c FROM e),
v AS (SELECT user_id, i, 0.05::DOUBLE * (a + lag(a) OVER w) AS x, 0.05::DOUBLE * (b + lag(b) OVER w) AS y, 0.05::DOUBLE * (c + lag(c) OVER w) AS z FROM r WINDOW w AS (PARTITION BY user_id ORDER BY i)),
n AS (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM v),
d AS (SELECT user_id, i, cos(n / 2) AS w, x * k AS x, y * k AS y, z * k AS z FROM (SELECT *, CASE WHEN n < 1e-12 THEN 0.5 ELSE sin(n / 2) / n END AS k FROM n)),
q AS (SELECT user_id, i, 1.0::DOUBLE AS w, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM e WHERE i = 0
  UNION ALL SELECT user_id, i, w / m, x / m, y / m, z / m FROM (SELECT *, sqrt(w * w + x * x + y * y + z * z) AS m FROM (
    SELECT d.user_id, d.i, q.w * d.w - q.x * d.x - q.y * d.y - q.z * d.z AS w, q.w * d.x + q.x * d.w + q.y * d.z - q.z * d.y AS x,
      q.w * d.y - q.x * d.z + q.y * d.w + q.z * d.x AS y, q.w * d.z + q.x * d.y - q.y * d.x + q.z * d.w AS z FROM q JOIN d ON d.user_id = q.user_id AND d.i = q.i + 1)))
SELECT user_id, i, round(w, 6) AS w, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM q""",
    "latency_percentiles": f"""WITH {EVENTS}, l AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n, count(*) FILTER (value > 90) AS late FROM e GROUP BY event_type)
SELECT event_type, v[n // 2 + 1] AS median, v[n * 95 // 100 + 1] AS p95, v[n] AS top, late FROM l""",
    "rate_median": f"""WITH {EVENTS}, {_BLOCKS}, d AS (SELECT *, elapsed - lag(elapsed) OVER (PARTITION BY event_type ORDER BY hour) AS dt FROM u),
k AS (SELECT event_type, list_sort(list(n * 1000000.0::DOUBLE / dt)) AS v FROM d WHERE lost = 0 AND dt > 0 GROUP BY event_type)
SELECT event_type, round(v[len(v) // 2 + 1], 9) AS rate FROM k""",
    "zoom_stats": f"WITH {EVENTS} SELECT user_id, round(least(4, min(1 + value / 200)), 6) AS low, round(avg(1 + value / 200), 6) AS mean, round(greatest(1, max(1 + value / 200)), 6) AS high FROM e GROUP BY user_id",
    "loss_counts": f"WITH {EVENTS}, {_BLOCKS}, {_GAPS} SELECT event_type, count(*) FILTER (broken) AS broken, CAST(sum(gap) AS BIGINT) AS lost, count(*) AS blocks FROM g GROUP BY event_type",
    "cheapest_variant": f"WITH {EVENTS}, v AS (" + " UNION ALL ".join(
        f"SELECT user_id, {k} AS variant, count(*) FILTER (round(abs(value - mean), 6) > 30) * 1000000 + round(max(abs(value - mean)), 3) AS cost FROM ({_row_mean(k + 1)}) GROUP BY user_id" for k in range(4))
    + ") SELECT user_id, arg_min(variant, (cost, variant)) AS variant, round(min(cost), 3) AS cost FROM v GROUP BY user_id",
}
