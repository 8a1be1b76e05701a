"""The queries of the three operators that are DataFrame expressions throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinegrain.llm import chat, sharding, urlfilter
from kinegrain.session import table

BUDGET, HISTORY, RESERVE = 1024, 256, 128
#: Fixed value: both texts of the conversation that the query adds.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = dict(conversations.dtypes)
    added = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.lit(i).cast(kinds["turn"]).alias("turn"), F.lit(r).alias("role"), F.lit(CONTROL_TEXT).alias("text"))
        for i, r in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    back = chat.read_back(chat.format_windows(conversations.unionByName(added), BUDGET, HISTORY, RESERVE))
    per_window = back.select(
        "conv_id", F.size("turns").alias("n"), F.length("formatted").alias("chars"),
        F.struct(
            "window_start", "window_part",
            F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))).alias("said"),
            F.concat_ws("", "targets").alias("loss")).alias("w"))
    whole = per_window.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("w")).alias("w"))
    said = F.concat_ws("", F.transform("w", lambda x: x["said"]))
    loss = F.concat_ws("", F.transform("w", lambda x: x["loss"]))
    return whole.select(
        "conv_id", F.col("n_turns").cast("bigint").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint").alias("formatted_chars"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urlfilter.judge(pages, urlfilter.rule_table(spark, urlfilter.RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def shard_names(n: int = sharding.SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(documents, "doc_id", shard_names())


_HALF = (BUDGET - HISTORY - RESERVE) // 2
_ESCAPED = "(length({0}) + 4 * (length({0}) - length(replace({0}, '&', ''))) + 3 * (length({0}) - length(replace({0}, '<', ''))) + 3 * (length({0}) - length(replace({0}, '>', ''))))"

OP8_SQL = f"""
WITH t0 AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}'),
t AS (SELECT *, (strlen(text) + 3) // 4 + 4 AS tokens, {_ESCAPED.format("role")} + {_ESCAPED.format("text")} + 15 AS chars FROM t0),
c AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM t),
d AS (SELECT *, e - tokens AS b, (e - tokens) // {_HALF} AS bin, tokens > {_HALF} AS part FROM c),
w AS (SELECT conv_id, bin, part, min(b) AS s FROM d GROUP BY ALL),
repeats AS (
  SELECT w.conv_id, d.chars FROM w JOIN d ON w.conv_id IS NOT DISTINCT FROM d.conv_id
  WHERE d.e <= w.s AND (d.tokens <= {HISTORY} AND w.s - d.b <= {HISTORY}
    OR d.b = 0 AND d.role = 'system' AND (w.s > {HISTORY} OR d.tokens > {HISTORY}))),
r AS (SELECT conv_id, sum(chars) AS chars FROM repeats GROUP BY conv_id),
o AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars) AS chars,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss
  FROM t GROUP BY conv_id)
SELECT o.conv_id, o.n_turns, o.turns_sha256, CAST(length(o.loss) AS BIGINT) AS loss_chars, sha256(o.loss) AS loss_sha256,
  CAST(o.chars + coalesce(r.chars, 0) AS BIGINT) AS formatted_chars
FROM o LEFT JOIN r ON o.conv_id IS NOT DISTINCT FROM r.conv_id
"""

OP9_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (
  SELECT page_id, translate(raw, '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM m
"""


def op10_sql() -> str:
    names = shard_names()
    listed = ",".join(map(str, sharding.fill(names)))
    return f"""
WITH s AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {sharding.TABLE_SIZE} AS INTEGER) AS slot FROM documents),
l AS (SELECT string_split('{listed}', ',') AS t)
SELECT doc_id, slot, 'shard-' || lpad(l.t[slot + 1], 5, '0') AS shard FROM s, l
"""
