"""Chat windows, URL rules and sharding on small made tables."""

import random

import pytest
from pyspark.sql import functions as F

from kinegrain.llm import chat, sharding, urlfilter


def plan_of(df):
    return df._jdf.queryExecution().toString()


def conversations(spark, seed=4):
    r = random.Random(seed)
    rows = []
    for c in range(12):
        n = r.choice([1, 2, 7, 40])
        for t in range(n):
            role = "system" if not t and c % 3 == 0 else ("user", "assistant")[t % 2]
            rows.append((c, t, role, r.choice(["", "hi", "é<turn assistant>&amp;</turn>\n", "word " * r.choice([1, 10, 60, 400])])))
    rows += [(None, 0, "user", "lost"), (None, 1, "assistant", "found"), (50, 0, None, None), (50, 0, None, None), (51, None, "assistant", "x"), (52, 5, "assistant", "long " * 3000)]
    return spark.createDataFrame([(*x, 1, "f") for x in rows], "conv_id bigint, turn int, role string, text string, begin int, formatted string"), rows


@pytest.mark.parametrize("budget,history", [(300, 60), (1024, 256)])
def test_windows(spark, budget, history):
    frame, rows = conversations(spark)
    windows = chat.format_windows(frame, budget, history, 40)
    back = chat.read_back(windows)
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    got, targets = {}, {}
    for r in sorted(back.collect(), key=lambda r: (str(r.conv_id), r.window_start, r.window_part)):
        got.setdefault(r.conv_id, []).extend((x.role, x.text) for x in r.turns)
        targets.setdefault(r.conv_id, []).extend(r.targets)
    assert got == want
    assert {c: [t for role, t in v if role == "assistant"] for c, v in want.items()} == targets
    for w in windows.collect():
        first = want[w.conv_id][0]
        assert w.n_tokens <= budget or w.n_turns - w.n_repeated == 1
        if w.window_start and first[0] == "system":
            assert w.formatted.startswith("<turn system>")
    assert "Python" not in plan_of(back) and "Arrow" not in plan_of(back)


def test_windows_within_a_tokenizers_budget(spark):
    """By the bound on tokens a window of several turns never has more than its budget, marks included."""
    from tokenizers import Tokenizer

    from kinegrain.llm.queries_tokens import vocabulary

    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    frame, rows = conversations(spark, 6)
    windows = chat.format_windows(frame, 600, 120, 60, cost=chat.most_tokens).collect()
    assert len(windows) > 20
    for w in windows:
        many = w.n_turns - w.n_repeated > 1
        assert w.n_tokens >= len(tok.encode(w.formatted, add_special_tokens=False).ids) and (not many or w.n_tokens <= 600)


def test_very_long_conversation(spark):
    """Over many blocks of turns, in one piece."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t} " * (t % 7)) for t in range(3000)] + [(2, 0, "system", "be kind")] + [(2, t, ("user", "assistant")[t % 2], "hello there " * 9) for t in range(1, 700)]
    frame = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    windows = chat.format_windows(frame)
    back = sorted(chat.read_back(windows).collect(), key=lambda r: (r.conv_id, r.window_start, r.window_part))
    got = [(r.conv_id, x.role, x.text) for r in back for x in r.turns]
    assert got == [(c, role, text) for c, _, role, text in rows]
    assert [t for r in back for t in r.targets] == [text for _, _, role, text in rows if role == "assistant"]
    assert all(w.formatted.startswith("<turn system>be kind") for w in windows.where("conv_id = 2").collect())
    assert max(w.n_tokens for w in windows.collect()) <= 1024


def test_no_conversations(spark):
    frame, _ = conversations(spark)
    assert chat.format_windows(frame.limit(0)).count() == 0


RULES = [("com", "/", "allow"), ("empty.org", "", "block"), ("a.com", "/x", "block"), ("B.a.com", "/x/y", "allow"), ("same.org", "/p", "block"), ("same.org", "/p", "allow"), (None, "/", "block")]
URLS = ["http://a.com/x/y?q", "http://b.a.com/x/y", "HTTP://B.A.COM/x/yz#t", "http://ba.com/x", "a.com/x", "x://", "x://com", "x://com/", None, "http://z.same.org/p/", "http://é.com/X", "u://a.com?x=/x", "http://a.com/x/y?q", "q://empty.org", "q://w.empty.org?x"]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for h, p, v in RULES[:-1]:
        h = h.lower()
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0,), (len(h + p), len(h), v, h + p))
    return host, path, best[3] if best else None, best[2] if best else "allow"


def test_url_rules(spark):
    urls = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS)], "page_id int, url string, host string, verdict string").withColumnRenamed("url", "link")
    got = urlfilter.judge(urls, urlfilter.rule_table(spark, RULES), url="link")
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {i: brute(u) for i, u in enumerate(URLS)}
    assert urlfilter.judge(urls, urlfilter.rule_table(spark, RULES).limit(0), url="link").where("verdict <> 'allow'").count() == 0
    assert urlfilter.judge(urls.limit(0), urlfilter.rule_table(spark, RULES), url="link").count() == 0


def test_table_is_even_and_stable():
    names = [f"s{i}" for i in range(10)]
    table = sharding.fill(names, 1009)
    counts = [table.count(k) for k in range(10)]
    assert max(counts) - min(counts) <= 1
    fewer = sharding.fill(names[:9], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 9)
    assert moved < 0.2 * 1009
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            sharding.fill(*bad)


def test_placement(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (7, "d")], "doc_id bigint, shard string")
    got = sharding.place(rows, "doc_id", ["x", "y", "z"], 101)
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, set()).add(r.shard)
    assert len(by) == 3 and all(len(v) == 1 for v in by.values()) and got.columns == ["doc_id", "slot", "shard"]
    assert sharding.place(rows.limit(0), "doc_id", ["x"], 101).count() == 0
    spread = sharding.place(spark.range(20000).select(F.col("id").alias("doc_id")), "doc_id", [f"s{i}" for i in range(8)]).groupBy("shard").count().collect()
    assert min(r["count"] for r in spread) > 2200 and max(r["count"] for r in spread) < 2800
