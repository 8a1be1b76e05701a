"""Queries that match, name and describe. Parts, suppliers, pages and documents stand in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinegrain.functions import binary
from kinegrain.operators import matching as mt
from kinegrain.plans.motion_queries import streams
from kinegrain.plans.oracle import EVENTS
from kinegrain.session import table


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("point"), (F.col("s_suppkey") % 50 * 3 + 14).cast("double").alias("p_focal"),
        F.when(F.col("s_suppkey") % 4 != 0, (F.col("s_suppkey") % 7 + 1) * 1.4).alias("p_aperture"), (F.abs(F.col("s_acctbal")) / 50 + 0.3).alias("p_distance"))


def nearest_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = parts(spark, sf_dir).select(
        F.col("p_partkey").alias("clip"), (F.col("p_size") * 2 + 12).cast("double").alias("focal"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey") % 11 + 1.8).alias("aperture"), (F.col("p_retailprice") / 20).alias("distance"))
    return mt.nearest_point(clips, points(spark, sf_dir), True).select("clip", "point", F.round("cost", 6).alias("cost"))


def _names(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Part names with a focal length and an aperture, as lens names have them."""
    p = parts(spark, sf_dir)
    name = F.concat_ws(" ", "p_name", F.concat(F.col("p_size").cast("string"), F.lit("mm")), F.concat(F.lit("F"), (F.col("p_partkey") % 3 + 2).cast("string"), F.lit(".8")))
    return p.select(F.col("p_partkey").alias(key), name.alias("name"))


def lens_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mt.best_names(_names(spark, sf_dir, "w_id"), _names(spark, sf_dir, "o_id"))
    return found.select("w_id", "o_id", F.round("score", 6).alias("score"), "rank")


def name_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _names(spark, sf_dir, "p_partkey").select("p_partkey", mt.words(F.col("name")).alias("w"))
    return n.select("p_partkey", F.array_join("w", "|").alias("words"), F.size(F.filter("w", mt.is_aperture)).alias("apertures"), F.exists("w", lambda w: w.contains("mm")).alias("focal"))


def source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's own map, else the frame's if it is bright enough, else the installed one."""
    p = parts(spark, sf_dir)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    j = p.join(s, p.p_partkey == s.s_suppkey, "left")
    kind, value = mt.first_source(
        ("file", F.col("p_partkey") % 3 == 0, F.col("p_retailprice")), ("frame", F.col("p_size") / 25 > 1.01, F.col("p_size").cast("double")),
        ("installed", F.col("s_acctbal").isNotNull(), F.col("s_acctbal")))
    return j.select("p_partkey", kind.alias("kind"), F.round(value, 4).alias("value"))


def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    names = p.select(F.col("p_partkey").alias("id"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_size").cast("string")).alias("name"))
    stems = p.select(F.substring_index(F.replace("p_name", F.lit(" "), F.lit("_")), "_", 1).alias("stem"), F.col("p_partkey").alias("ordinal"))
    stems = stems.groupBy("stem").agg(F.max("ordinal").alias("ordinal"))
    return mt.longest_stem(names, stems)


def sensor_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    k = F.col("p_partkey")
    mid = k % 2 == 0
    w = mt.sensor_window(
        F.when(mid, 3000).otherwise(6000), F.when(mid, 2000).otherwise(4000), k % 3, F.when(k % 7 == 0, 4608).otherwise(0), F.when(k % 7 == 0, 3072).otherwise(0),
        F.when(k % 7 == 0, 3000).otherwise(0), F.when(k % 5 == 0, 18926.2).otherwise(20000.0))
    return p.select("p_partkey", w.alias("w")).select("p_partkey", F.col("w.w").cast("bigint").alias("w"), F.col("w.h").cast("bigint").alias("h"), "w.rule")


def aspect_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir).select("p_partkey", (F.col("p_size") * 40 + 640).alias("w"), (F.col("p_partkey") % 30 * 36 + 480).alias("h"))
    return p.select("p_partkey", mt.aspect_name(F.col("w"), F.col("h")).alias("ratio"))


def sequence_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = F.regexp_extract("url", "^[^?#]*", 0)
    prefix, number, digits, suffix = mt.sequence_parts(path)
    following = mt.numbered(prefix, number + 1, digits, suffix)
    return pages.select("page_id", prefix.alias("prefix"), number.alias("number"), digits.alias("digits"), suffix.alias("suffix"), following.alias("following"))


def sequence_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered files of each clip in order, with the gap before each."""
    s = sequence_names(spark, sf_dir).where("number IS NOT NULL")
    w = Window.partitionBy("prefix").orderBy("number", "page_id")
    return s.select("page_id", F.row_number().over(w).alias("place"), (F.col("number") - F.lag("number").over(w)).alias("step"))


def xml_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "pages")
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return h.select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(hrefs).alias("links"),
        F.coalesce(F.get(hrefs, F.lit(0)), F.lit("")).alias("first"), F.size(F.regexp_extract_all("html", F.lit("<([a-z]+)"), 1)).alias("tags"))


def binary_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a 12-byte header, with the text's bytes as the payload."""
    c = F.col("c")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("c"))
    return d.select(
        "doc_id", binary.unsigned(c, 0, 2).alias("u16"), binary.unsigned(c, 2, 4).alias("u32"), binary.unsigned(c, 2, 4, False).alias("u32_big"),
        binary.signed(c, 6, 2).alias("i16"), F.round(binary.rational(binary.unsigned(c, 0, 2), binary.unsigned(c, 8, 1) - 32), 6).alias("ratio"))


def evict_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return mt.evict_oldest(d, "doc_id", "n_chars", 1_000_000)


def file_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of all files of each host, names and sizes; every file counts."""
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"), "url", F.octet_length("html").alias("size"))
    one = F.md5(F.concat_ws("|", F.upper("url"), "size").cast("binary"))
    return p.groupBy("host").agg(F.count("*").alias("files"), F.md5(F.array_join(F.array_sort(F.collect_list(one)), ",").cast("binary")).alias("signature"))


def correction_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    k = F.col("p_partkey")
    b = mt.binning(F.when(k % 2 == 0, 3024).otherwise(6048), F.lit(2010), F.when(k % 11 == 0, 3000).otherwise(0), k % 3, F.when(k % 5 == 0, 18926).otherwise(20000), k % 4 != 0)
    on = (k % 2 == 0) & (b != 0)
    return p.select("p_partkey", b.alias("binned"), F.when(on, -0.125).otherwise(0.0).alias("phase"), F.when(on, F.least(F.col("p_size") * 3, F.lit(100))).otherwise(0).alias("strength"),
                    ((k % 13 > 6) | (k % 2 == 1)).alias("ends_early"))


def window_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the sensor a clip shows, kept for all of its frames."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    w = sensor_window(spark, sf_dir).select("p_partkey", F.round(F.col("w") / 6000, 6).alias("share_w"), F.round(F.col("h") / 4000, 6).alias("share_h"))
    return o.join(w, o.o_custkey == w.p_partkey).select("o_orderkey", "share_w", "share_h")


def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams(spark, sf_dir)
    t = mt.frame_time(F.col("i") * 0.04, F.lit(0.0248), F.when(F.col("event_id") % 3 != 0, F.col("value") / 5000), F.lit(0.0174), F.col("user_id") % 7)
    return s.select("event_id", F.round(F.coalesce(t, F.col("i") * 0.04 - 0.0174 - F.col("user_id") % 7 * 1e-3), 9).alias("t"))


def focal_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    k = F.col("p_partkey")
    f = mt.focal_pixels(F.when(k % 4 != 0, F.col("p_size").cast("double")), F.when(k % 3 == 0, 5930.0), F.when(k % 5 == 0, 4608), F.lit(3000.0))
    return p.select("p_partkey", F.round(f, 6).alias("focal"))


def status_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line with the facts of each stream, separated by bars."""
    s = streams(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_id") % 7 == 0).alias("bad"), F.max("value").alias("top"))
    bad = F.when(F.col("bad") > 0, F.concat(F.col("bad").cast("string"), F.lit(" without data")))
    limit = F.when(F.col("top") > 99, F.lit("over the limit"))
    return s.select("user_id", F.concat_ws(" | ", F.concat(F.lit("stream "), F.col("user_id").cast("string")), F.concat(F.col("n").cast("string"), F.lit(" samples")), bad, limit).alias("status"))


def clip_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shutter angle, crop factor, equivalent focal length and the name shown for each part."""
    p = parts(spark, sf_dir)
    crop = 6000 / (F.col("p_size") * 50 + 3500)
    return p.select(
        "p_partkey", F.round(F.lit(360.0) * F.col("p_retailprice") / 1e5 * 25, 3).alias("angle"), F.round(crop, 3).alias("crop"), F.round(crop * F.col("p_size"), 3).alias("equivalent"),
        F.upper(F.substring_index("p_name", " ", -1)).alias("shown"), F.concat(F.lit("1/"), F.round(F.lit(1e5) / F.col("p_retailprice")).cast("bigint").cast("string")).alias("shutter"))


def sniff_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", binary.magic(F.col("html").cast("binary")).alias("kind"))


def profile_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name between a file name's outermost brackets, without the words that say what a profile holds."""
    p = parts(spark, sf_dir).select("p_partkey", F.concat("p_brand", F.lit(" ("), F.col("p_name"), F.lit(" vignette) - "), F.col("p_type"), F.lit(".lcp")).alias("file"))
    inner = F.regexp_extract("file", r"\((.*)\)", 1)
    kept = F.filter(mt.words(inner), lambda w: ~w.isin("distortion", "vignette", "and"))
    return p.select("p_partkey", F.array_join(kept, " ").alias("lens"), F.size(kept).alias("n"))


def shading_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain at a place of a 41 x 61 map, from its four nodes; the map is a table, met in an equi-join."""
    node = spark.range(41 * 61).select((F.col("id") / 61).cast("int").alias("i"), (F.col("id") % 61).cast("int").alias("j"))
    x, y = F.col("j") / 60 - 0.5, F.col("i") / 40 - 0.5
    node = node.select("i", "j", (1 / (1 - (x * x + y * y) * 0.8)).alias("gain"))
    p = parts(spark, sf_dir).select("p_partkey", (F.col("p_partkey") % 97 / 97 * 60).alias("u"), (F.col("p_size") / 51 * 40).alias("v"))
    p = p.withColumn("j", F.least(F.floor("u"), F.lit(59)).cast("int")).withColumn("i", F.least(F.floor("v"), F.lit(39)).cast("int"))
    corners = F.explode(F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in (0, 1) for b in (0, 1)]))
    c = p.withColumn("c", corners).select("p_partkey", (F.col("i") + F.col("c.di")).alias("i"), (F.col("j") + F.col("c.dj")).alias("j"), (1 - F.abs(F.col("u") - F.col("j") - F.col("c.dj"))).alias("wu"), (1 - F.abs(F.col("v") - F.col("i") - F.col("c.di"))).alias("wv"))
    return c.join(node, ["i", "j"]).groupBy("p_partkey").agg(F.round(F.sum(F.col("wu") * F.col("wv") * F.col("gain")), 6).alias("gain"))


QUERIES = {f.__name__: f for f in (
    nearest_calibration, lens_name_match, name_filters, source_priority, longest_prefix, sensor_window, aspect_name, sequence_names, sequence_listing,
    xml_attributes, binary_header, evict_oldest, file_signature, correction_gates, window_share, frame_times, focal_pixels, status_line, clip_facts,
    sniff_format, profile_names, shading_lookup)}

_NAME = "p_name || ' ' || p_size || 'mm F' || (p_partkey % 3 + 2) || '.8'"
_WORDS = "list_transform(regexp_extract_all(lower({0}), '[a-z0-9.-]+'), lambda w: regexp_replace(w, '^f([0-9])', '\\1'))"
_APERTURE = "(regexp_matches({0}, '^[0-9]') AND NOT contains({0}, 'mm') AND (contains({0}, '.') OR length({0}) <= 2))"
_WINDOW = """w AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN [4608, 3072, 1]
  WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 2 THEN [4608, 3072, 2] WHEN p_partkey % 2 = 0 AND p_partkey % 5 = 0 THEN [4608, 3072, 3]
  WHEN p_partkey % 3 = 1 THEN [4024, 2682, 4] ELSE [6000, 4000, 0] END AS w FROM part)"""
_SEQ = """s AS (SELECT page_id, regexp_extract(url, '^[^?#]*') AS path FROM pages),
q AS (SELECT page_id, regexp_extract(path, '^(.*?)([0-9]+)(\\.[^./\\\\]*)?$', ['prefix', 'digits', 'suffix']) AS p FROM s),
n AS (SELECT page_id, p.prefix AS prefix, p.digits AS d, p.suffix AS suffix, p.digits <> '' AND length(p.digits) <= 12 AS ok FROM q),
o AS (SELECT page_id, CASE WHEN ok THEN prefix END AS prefix, CASE WHEN ok THEN d::BIGINT END AS number, CASE WHEN ok THEN length(d) END AS digits, CASE WHEN ok THEN suffix END AS suffix FROM n)"""


def _u(offset: int, size: int, little: bool = True) -> str:
    byte = lambda k: f"('0x' || substr(h, {2 * k + 1}, 2))::BIGINT"
    order = range(size) if little else range(size - 1, -1, -1)
    return f"CASE WHEN length(h) >= {2 * (offset + size)} THEN " + " + ".join(f"{256 ** p} * {byte(offset + k)}" for p, k in enumerate(order)) + " END"


SQL = {
    "nearest_calibration": """WITH c AS (SELECT p_partkey AS clip, (p_size * 2 + 12)::DOUBLE AS f, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 11 + 1.8::DOUBLE END AS a, p_retailprice / 20 AS d FROM part),
p AS (SELECT s_suppkey AS point, (s_suppkey % 50 * 3 + 14)::DOUBLE AS pf, CASE WHEN s_suppkey % 4 <> 0 THEN (s_suppkey % 7 + 1) * 1.4::DOUBLE END AS pa, abs(s_acctbal) / 50 + 0.3::DOUBLE AS pd FROM supplier),
k AS (SELECT clip, point, 8 * abs(ln(pf / f)) + coalesce(2 * abs(ln(pa / a)), 0) + 0.5 * abs(ln(least(pd, 100) / least(d, 100))) AS cost FROM c, p)
SELECT clip, point, round(cost, 6) AS cost FROM k QUALIFY row_number() OVER (PARTITION BY clip ORDER BY cost, point) = 1""",
    "lens_name_match": f"""WITH n AS (SELECT p_partkey AS id, {_WORDS.format('(' + _NAME + ')')} AS w FROM part),
f AS (SELECT id, w, unnest(list_filter(list_distinct(w), lambda x: contains(x, 'mm'))) AS mm FROM n),
p AS (SELECT a.id AS w_id, b.id AS o_id, any_value(a.w) AS want, any_value(b.w) AS have FROM f a JOIN f b ON a.mm = b.mm GROUP BY a.id, b.id),
s AS (SELECT w_id, o_id, len(list_filter(want, lambda x: list_contains(have, x))) / sqrt(len(want) * len(have)) AS score FROM p
  WHERE len(list_filter(want, lambda x: {_APERTURE.format('x')} AND NOT list_contains(have, x))) = 0 AND len(list_filter(have, lambda x: contains(x, 'mm') AND list_contains(want, x))) > 0)
SELECT w_id, o_id, round(score, 6) AS score, row_number() OVER (PARTITION BY w_id ORDER BY score DESC, o_id) AS rank FROM s WHERE score >= 0.5
QUALIFY rank <= 16""",
    "name_filters": f"""WITH n AS (SELECT p_partkey, {_WORDS.format('(' + _NAME + ')')} AS w FROM part)
SELECT p_partkey, array_to_string(w, '|') AS words, len(list_filter(w, lambda x: {_APERTURE.format('x')})) AS apertures, len(list_filter(w, lambda x: contains(x, 'mm'))) > 0 AS focal FROM n""",
    "source_priority": """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'file' WHEN p_size / 25 > 1.01 THEN 'frame' WHEN s_acctbal IS NOT NULL THEN 'installed' ELSE 'none' END AS kind,
round(CASE WHEN p_partkey % 3 = 0 THEN p_retailprice WHEN p_size / 25 > 1.01 THEN p_size ELSE s_acctbal END, 4) AS value FROM part LEFT JOIN supplier ON p_partkey = s_suppkey""",
    "longest_prefix": """WITH n AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') || '_' || p_size AS name FROM part),
t AS (SELECT DISTINCT split_part(replace(p_name, ' ', '_'), '_', 1) AS stem FROM part)
SELECT id, name, arg_max(stem, length(stem)) AS stem FROM n LEFT JOIN t ON name = stem OR starts_with(name, stem || '_') GROUP BY id, name""",
    "sensor_window": f"WITH {_WINDOW} SELECT p_partkey, w[1]::BIGINT AS w, w[2]::BIGINT AS h, w[3] AS rule FROM w",
    "aspect_name": """WITH p AS (SELECT p_partkey, (p_size * 40 + 640) / (p_partkey % 30 * 36 + 480)::DOUBLE AS r FROM part)
SELECT p_partkey, CASE """ + " ".join(f"WHEN abs(r / {v!r}::DOUBLE - 1) < 0.006 THEN '{n}'" for n, v in mt.RATIOS) + " ELSE printf('%.2f:1', r) END AS ratio FROM p",
    "sequence_names": f"WITH {_SEQ} SELECT page_id, prefix, number, digits, suffix, prefix || CASE WHEN length((number + 1)::VARCHAR) >= digits THEN (number + 1)::VARCHAR ELSE lpad((number + 1)::VARCHAR, digits::INTEGER, '0') END || suffix AS following FROM o",
    "sequence_listing": f"WITH {_SEQ} SELECT page_id, row_number() OVER w AS place, number - lag(number) OVER w AS step FROM o WHERE number IS NOT NULL WINDOW w AS (PARTITION BY prefix ORDER BY number, page_id)",
    "xml_attributes": """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS links,
coalesce(regexp_extract_all(html, 'href="([^"]*)"', 1)[1], '') AS first, len(regexp_extract_all(html, '<[a-z]+')) AS tags FROM pages""",
    "binary_header": f"""WITH d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
f AS (SELECT doc_id, {_u(0, 2)} AS u16, {_u(2, 4)} AS u32, {_u(2, 4, False)} AS u32_big, {_u(6, 2)} AS w, {_u(8, 1)} AS b FROM d)
SELECT doc_id, u16, u32, u32_big, CASE WHEN w >= 32768 THEN w - 65536 ELSE w END AS i16, round(CASE WHEN b - 32 = 0 THEN 0 ELSE u16::DOUBLE / (b - 32) END, 6) AS ratio FROM f""",
    "evict_oldest": """WITH s AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id DESC) AS s, max(doc_id) OVER () AS top FROM documents) SELECT doc_id, n_chars FROM s WHERE s > 1000000 AND doc_id < top""",
    "file_signature": """WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, md5(upper(url) || '|' || strlen(html)) AS m FROM pages)
SELECT host, count(*) AS files, md5(string_agg(m, ',' ORDER BY m)) AS signature FROM p GROUP BY host""",
    "correction_gates": """WITH b AS (SELECT p_partkey AS k, p_size, CASE WHEN p_partkey % 2 <> 0 THEN 0 WHEN p_partkey % 4 = 0 THEN -1 WHEN p_partkey % 11 = 0 OR p_partkey % 3 = 2 OR p_partkey % 5 = 0 THEN 0 ELSE 1 END AS b FROM part)
SELECT k AS p_partkey, b AS binned, CASE WHEN k % 2 = 0 AND b <> 0 THEN -0.125::DOUBLE ELSE 0 END AS phase, CASE WHEN k % 2 = 0 AND b <> 0 THEN least(p_size * 3, 100) ELSE 0 END AS strength, k % 13 > 6 OR k % 2 = 1 AS ends_early FROM b""",
    "window_share": f"WITH {_WINDOW} SELECT o_orderkey, round(w[1] / 6000, 6) AS share_w, round(w[2] / 4000, 6) AS share_h FROM orders JOIN w ON o_custkey = p_partkey",
    "frame_times": f"""WITH {EVENTS} SELECT event_id, round(i * 0.04::DOUBLE - CASE WHEN event_id % 3 <> 0 AND value / 5000 > 0 THEN 0.0124::DOUBLE + value / 5000 / 2 ELSE 0.0174::DOUBLE END - user_id % 7 * 1e-3, 9) AS t FROM e""",
    "focal_pixels": "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN round(p_size / CASE WHEN p_partkey % 3 = 0 THEN 5930e-6 WHEN p_partkey % 5 = 0 THEN 4608 * 0.006 / 3000 ELSE 6000 * 0.006 / 3000 END, 6) END AS focal FROM part",
    "status_line": f"""WITH {EVENTS}, s AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_id % 7 = 0) AS bad, max(value) AS top FROM e GROUP BY user_id)
SELECT user_id, concat_ws(' | ', 'stream ' || user_id, n || ' samples', CASE WHEN bad > 0 THEN bad || ' without data' END, CASE WHEN top > 99 THEN 'over the limit' END) AS status FROM s""",
    "clip_facts": """SELECT p_partkey, round(360 * p_retailprice / 1e5 * 25, 3) AS angle, round(6000 / (p_size * 50 + 3500), 3) AS crop, round(6000 / (p_size * 50 + 3500) * p_size, 3) AS equivalent,
upper(split_part(p_name, ' ', -1)) AS shown, '1/' || CAST(round(1e5 / p_retailprice) AS BIGINT) AS shutter FROM part""",
    "sniff_format": "SELECT page_id, CASE WHEN starts_with(ltrim(html), '<') THEN 'xml' ELSE 'unknown' END AS kind FROM pages",
    "profile_names": f"""WITH p AS (SELECT p_partkey, regexp_extract(p_brand || ' (' || p_name || ' vignette) - ' || p_type || '.lcp', '\\((.*)\\)', 1) AS i FROM part),
w AS (SELECT p_partkey, list_filter({_WORDS.format('i')}, lambda x: x NOT IN ('distortion', 'vignette', 'and')) AS w FROM p)
SELECT p_partkey, array_to_string(w, ' ') AS lens, len(w) AS n FROM w""",
    "shading_lookup": """WITH p AS (SELECT p_partkey, p_partkey % 97 / 97::DOUBLE * 60 AS u, p_size / 51::DOUBLE * 40 AS v FROM part),
f AS (SELECT *, least(floor(u), 59) AS j, least(floor(v), 39) AS i FROM p),
k AS (SELECT p_partkey, a, b, 1 / (1 - 0.8::DOUBLE * (pow(j / 60 - 0.5, 2) + pow(i / 40 - 0.5, 2))) AS g00, 1 / (1 - 0.8::DOUBLE * (pow((j + 1) / 60 - 0.5, 2) + pow(i / 40 - 0.5, 2))) AS g01,
  1 / (1 - 0.8::DOUBLE * (pow(j / 60 - 0.5, 2) + pow((i + 1) / 40 - 0.5, 2))) AS g10, 1 / (1 - 0.8::DOUBLE * (pow((j + 1) / 60 - 0.5, 2) + pow((i + 1) / 40 - 0.5, 2))) AS g11 FROM (SELECT p_partkey, u - j AS a, v - i AS b, i, j FROM f))
SELECT p_partkey, round((1 - b) * ((1 - a) * g00 + a * g01) + b * ((1 - a) * g10 + a * g11), 6) AS gain FROM k""",
}
