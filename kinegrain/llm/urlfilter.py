"""URL filters: host-suffix and path-prefix expressions against hashed rules.

Every URL is expanded into the expressions a rule could be written as: the
last n labels of its host followed by the first m characters of its path, for
the (n, m) shapes that occur among the rules. Expressions meet rules in an
equi-join on a short prefix of their SHA-256; the full digest confirms a hit,
and the longest rule wins. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the digest that the join looks at (4 bytes).
PREFIX_DIGITS = 8
#: Tasks that the URLs of one expression are dealt over.
SPREAD = 16

#: The rules of the query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def url_host_path(url: Column) -> tuple[Column, Column]:
    """Host and path as the rules see them; both empty without a ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(raw), path


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows as a relation that needs no Python on the executors."""
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def _digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to every row of ``urls``.

    A rule (host, path, verdict) fits its host and all subdomains when the
    URL's path starts with the rule's path. The longest fitting rule wins; of
    equally long ones the one with the longer host, then ``block``. ``rule`` is
    null and ``verdict`` is ``default`` where none fits. A null URL, or one
    without ``://``, has an empty host and path and fits no rule. Rows are kept
    as they are, repeated ones included; columns of ``urls`` named host, path,
    rule or verdict are replaced. Rules with a null part are ignored.

    The rules' distinct (label count, path length) shapes are one row beside
    the URLs, as many as rules differ in shape; nothing is read to the driver.
    An expression that many URLs have, as a rule for a whole top domain makes
    it, is dealt over ``SPREAD`` tasks, and the rules are repeated for them.
    Work is done once for each distinct URL, so a repeated page costs one
    expansion, and the way back to the rows is an ordinary join that Spark may
    split where a URL is hot.
    """
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL AND host <> ''").select(
        ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    labels = lambda c: F.length(c) - F.length(F.replace(c, F.lit("."), F.lit(""))) + 1
    shape = F.struct(labels(F.col("r_host")).cast("int").alias("n"), F.length("r_path").alias("m"))
    shapes = rules.agg(F.collect_set(shape).alias("shapes"))
    expression = F.concat("r_host", "r_path")
    keyed = rules.select(
        F.substring(_digest(expression), 1, PREFIX_DIGITS).alias("prefix"), _digest(expression).alias("full"),
        expression.alias("rule"), F.length("r_host").alias("host_len"), "r_verdict").groupBy("prefix", "full", "rule", "host_len").agg(
        # one verdict for each rule; "block" sorts after "allow", so max lets it win
        F.max("r_verdict").alias("r_verdict"))
    names = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    key = "__url"
    rows = urls.select(*names, F.col(url).alias(key))
    distinct = rows.select(key).distinct()
    host, path = url_host_path(F.col(key))
    parsed = distinct.select(key, host.alias("host"), path.alias("path"))
    # One row of shapes; without rules it is an empty list and no URL has an expression.
    fits = lambda x: (F.col("host") != "") & (labels(F.col("host")) >= x["n"]) & (F.length("path") >= x["m"])
    written = lambda x: F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -x["n"]), F.substring(F.col("path"), F.lit(1), x["m"]))
    options = parsed.crossJoin(F.broadcast(shapes)).select(key, F.explode(F.transform(F.filter("shapes", fits), written)).alias("e"))
    expanded = options.select(key, _digest(F.col("e")).alias("digest"), F.pmod(F.xxhash64(key), F.lit(SPREAD)).cast("int").alias("salt"))
    expanded = expanded.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    salted = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    hits = expanded.join(salted, ["prefix", "salt"]).where(F.col("digest") == F.col("full"))
    best = hits.groupBy(key).agg(F.max(F.struct(F.length("rule").alias("l"), "host_len", "r_verdict", "rule")).alias("best"))
    best = best.withColumnRenamed(key, "__best_url")
    parsed = parsed.join(best, F.col(key) == F.col("__best_url"), "left").select(
        key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))
    judged = parsed.withColumnRenamed(key, "__judged")
    return rows.join(judged, F.col(key).eqNullSafe(F.col("__judged")), "left").select(*names, "host", "path", "rule", "verdict")
