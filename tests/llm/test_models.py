"""The random fields: exact inference, held-out accuracy, patterns and added spans."""

import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinegrain.llm import crf, pii, toxicity


def plain_marginals(first, e, t):
    out, log_z = np.zeros(len(e)), 0.0
    for a, b in zip(first[:-1], first[1:]):
        ahead, v = [], np.array([1.0, 0.0])
        for i in range(a, b):
            v = v @ (np.exp(t) * np.array([1, np.exp(e[i])]))
            ahead.append(v)
        log_z += np.log(v.sum()) if b > a else 0
        back = np.ones(2)
        for i in range(b - 1, a - 1, -1):
            z = ahead[i - a] * back
            out[i] = z[1] / z.sum()
            back = (np.exp(t) * np.array([1, np.exp(e[i])])) @ back
    return out, log_z


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 63, 64, 65, 150]), max_size=6), st.integers(0, 99))
def test_forward_backward(sizes, seed):
    r = np.random.default_rng(seed)
    first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    e, t = r.normal(size=first[-1]) * 3, r.normal(size=(2, 2))
    p, expected, log_z = crf.marginals(crf.Layout(first), e, t, pairs=True)
    q, want = plain_marginals(first, e, t)
    assert np.allclose(p, q) and np.isclose(log_z, want)
    assert np.isclose(expected.sum(), first[-1]) and np.isclose(expected[:, 1].sum(), q.sum())


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_toxicity(spark, sf_dir, sf):
    from kinegrain.llm.queries_models import op6_toxicity

    d = sf_dir.replace("sf0.001", sf)
    got = {r.doc_id: r for r in op6_toxicity(spark, d).drop("spans").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(got[k], y) for k, y in labels.items() if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(r.held_out for r, _ in held) and all(0 <= r.score <= 1 for r in got.values())
    bad, good = [r.predicted for r, y in held if y], [r.predicted for r, y in held if not y]
    assert sum(bad) >= 0.9 * len(bad) and sum(good) <= 0.02 * len(good)


def test_training_sample(spark):
    """Equal hashes' ties, null parts, repeated labels and long texts; the held-out fold never trains."""
    long_text = " ".join(f"w{i}" for i in range(30_000))
    docs = [(i, f"text {i // 2}", "x") for i in range(40)] + [(50, None, "x"), (None, "no id", "x"), (51, long_text, "x"), (3, "text 1", "x")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, toxic string")
    marks = [(i, i % 3 == 0) for i in range(40)] + [(50, 1), (51, 1), (None, 1), (5, None), (3, 0), (3, 0), (99, 1)]
    labels = spark.createDataFrame([(i, None if t is None else int(t)) for i, t in marks], "doc_id bigint, toxic int")
    texts, toxic = toxicity.training_sample(frame, labels)
    assert len(set(texts)) == len(texts)
    want = {}
    for i, t in marks:
        if i is not None and t is not None and zlib.crc32(str(i).encode()) % 4 != 2 and i < 50:
            want[f"text {i // 2}"] = max(want.get(f"text {i // 2}", 0), int(t))
    got = dict(zip(texts, toxic.tolist()))
    (stretched,) = [t for t in got if len(t) > 1000] or [""]
    got.pop(stretched, None)
    assert got == want
    words = stretched.split()
    assert not words or ({"w100", "w29900"} <= set(words) and set(words) <= set(long_text.split()) and len(stretched) <= toxicity.SAMPLE_CHARS + 10)
    assert toxicity.training_sample(frame, labels) [0] == texts
    few, _ = toxicity.training_sample(frame, labels, docs_bound=5)
    assert 1 <= len(few) <= 5 and set(few) <= set(texts)


def test_nothing_goes_without_evidence(spark):
    """One-class labels, labels no form explains, and texts without words."""
    rows = [(1, ""), (2, None), (3, "hello nice"), (None, "hello"), (4, "..."), (3, "hello nice")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    none_marked = toxicity.train(["a b", "c d", "e f"], np.array([1, 0, 1]))
    assert not none_marked.evidence
    for model in (toxicity.train(["x"], np.array([1])), none_marked, toxicity.train([], np.zeros(0, int)), toxicity.train(["", " "], np.array([1, 0]))):
        assert toxicity.drop_toxic(frame, model).count() == len(rows)
    texts = [f"some calm words {i} here" for i in range(40)] + [f"calm {i} you vile toad go" for i in range(30)]
    model = toxicity.train(texts, np.array([0] * 40 + [1] * 30))
    assert model.evidence
    kept = toxicity.drop_toxic(spark.createDataFrame(rows + [(9, "you vile toad")], "doc_id bigint, text string"), model).collect()
    assert sorted(map(str, (r.doc_id for r in kept))) == sorted(map(str, (d for d, _ in rows)))


def test_toxic_spans_and_edges(spark):
    texts = [f"some calm words {i} here" for i in range(40)] + [f"calm {i} you vile toad é! go" for i in range(12)]
    model = toxicity.train(texts, np.array([0] * 40 + [1] * 12))
    rows = [(1, "é you VILE toad, ok"), (2, None), (3, ""), (None, "calm"), (1, "é you VILE toad, ok"), (4, "calm " * 20000)]
    frame = spark.createDataFrame([(d, t, 0.5) for d, t in rows], "doc_id bigint, text string, score double")
    got = toxicity.score(frame, model).collect()
    assert len(got) == len(rows)
    first = next(r for r in got if r.doc_id == 1)
    assert first.predicted == 1 and "vile" in {"é you VILE toad, ok"[s.start: s.end].lower() for s in first.spans}
    assert all(r.predicted == 0 for r in got if r.doc_id != 1)
    assert toxicity.score(frame.limit(0), model).count() == 0
    assert 0 < toxicity.score(frame, toxicity.train(["a"], np.array([1]))).first().score < 1


# The patterns as stated, without the rewriting that keeps them linear.
STATED = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def stated_spans(text):
    out = []
    for k, pattern in enumerate(STATED):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = [True, all(int(p) <= 255 for p in m[0].split(".")) if k == 1 else True, 13 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15][k]
            if good:
                out.append((k, m.start(), m.end()))
    return out


PIECES = ["a", "B.", "@", "a@b.co", "@x.y", "1.2.3.4", "255", "256.1.1.1", ".", "-", " ", "+", "+1 (234) 555-6789", "4111111111111111", "4111-1111 1111 1111", "0", "12", "é", "%", "\n", "x@-.a-.b"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_base_patterns(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == stated_spans(text)


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000 + "@", "@" * 100_000, "+1" * 50_000, "1." * 100_000, "a.@" * 60_000, "+1" + " " * 200_000])
def test_patterns_stay_linear(text):
    base = pii.base_spans(text)
    pii.mentions(text, base)


def test_long_digit_groups():
    """Numbers beyond what Python turns into an int; leading zeros."""
    text = "0" * 5000 + ".1.2.3 " + "1" * 5000 + ".1.2.3 000.0.00.255 0256.1.1.1"
    zeros = "0" * 5000 + ".1.2.3"
    assert [text[a:b] for k, a, b in pii.base_spans(text) if k == 1] == [zeros, "000.0.00.255"]
    assert pii.added_spans([text], [pii.base_spans(text)], pii.default_model())[0] == []


def exact_marginals(model, scores, known, joined, node, hub, near):
    """All labellings of nodes and hubs, counted."""
    m, n = scores.shape
    hubs = int(hub.max()) + 1 if len(hub) else 0
    out, total = np.zeros((m, n)), 0.0
    for y in itertools.product(range(n), repeat=m + hubs):
        if any(known[i] and y[i] != known[i] for i in range(m)):
            continue
        w = sum(scores[i, y[i]] for i in range(m)) + sum(model.chain[y[i - 1], y[i]] for i in range(1, m) if joined[i])
        w += sum((min(pii.SKIP_NEAR, model.skip) if s else model.skip) for i, h, s in zip(node, hub, near) if y[i] == y[m + h])
        w = np.exp(w)
        total += w
        for i in range(m):
            out[i, y[i]] += w
    return out / total


@pytest.mark.parametrize("seed", range(6))
def test_marginals_against_all_labellings(seed):
    """Exact without a loop; near the truth with one."""
    r = np.random.default_rng(seed)
    model = pii.Model(np.zeros((1, 3)), r.normal(size=(3, 3)), 1.5)
    scores = r.normal(size=(4, 3))
    known = np.array([0, 2, 0, 0])
    none = np.zeros(0, np.int64)
    tree = [(np.array([False, True, False, True]), np.array([0, 2]), np.array([0, 0]), np.array([False, True])), (np.array([False, True, True, True]), none, none, none.astype(bool))]
    for joined, node, hub, near in tree:
        assert np.allclose(pii.infer(model, scores, known, joined, node, hub, near, 200), exact_marginals(model, scores, known, joined, node, hub, near), atol=1e-3)
    loop = (np.array([False, False, True, True]), np.array([0, 2, 3, 1]), np.array([0, 0, 0, 0]), np.zeros(4, bool))
    p, q = pii.infer(model, scores, known, *loop, 200), exact_marginals(model, scores, known, *loop)
    assert np.abs(p - q).max() < 0.15 and (p.argmax(axis=1) == q.argmax(axis=1))[q.max(axis=1) > 0.6].all()


def added(text, model):
    found, = pii.added_spans([text], [pii.base_spans(text)], model)
    return [(pii.NAMES[k + 1], text[a:b]) for k, a, b in found]


FILL = "lorem ipsum dolor " * 60
SEEDS = [f"word{i} call +1 ({200 + i}) 555-{1000 + 7 * i} today or write a.{i}@mail{i % 7}.example.com soon, host 10.{i}.3.{i + 1} up" for i in range(60)]
SEEDS += [f"order {1000000 + 37 * i} of 24{i:02d} lines, version 3.0.{i} and page 12-{i}" for i in range(60)]
SEEDS += [f"setting token = \"{i * 7919 + 1:032x}a{i:03x}\" kept in file {i}" for i in range(40)]


@pytest.fixture(scope="module")
def field():
    return pii.train(SEEDS)


@pytest.mark.parametrize("text,want", [
    ("call +1 (234) 555-6789 now. " + FILL + "again 234.555.6789 thanks", [("phone", "234.555.6789")]),
    ("+49 1512 3456789 or " + FILL + " 01512 3456789", [("phone", "01512 3456789")]),
    ("mail bob.x@site.org. " + FILL + " Bob.X(at)site.org", [("email", "Bob.X(at)site.org")]),
    ("card 4111111111111111 ok " + FILL + " card 4111111111111112", [("card", "4111111111111112")]),
    ("plain 1234567 of 7654321 lines", []),
    ("card 4111111111111111 ok " + FILL + " order 9807915762804490", []),
    ("a 4111111111111112 without any card", []),
    ("setting token = \"5f3ac1d2e4b5968778695a4b3c2d1e0f5f3a\" " + FILL + " see 5f3ac1d2e4b5968778695a4b3c2d1e0f5f3a", [("secret", "5f3ac1d2e4b5968778695a4b3c2d1e0f5f3a")] * 2),
    ("", []), ("@", []), ("1" * 30, [])])
def test_similar_mentions_share_a_label(field, text, want):
    assert added(text, field) == want
    # One document's field does not depend on those solved with it.
    other = "x 1234567 y +1 (234) 555-6789 " + FILL
    both = pii.added_spans([other, text], [pii.base_spans(other), pii.base_spans(text)], field)
    assert [(pii.NAMES[k + 1], text[a:b]) for k, a, b in both[1]] == want


def test_planted_mentions(field):
    """Precision and recall over documents with one base span and one loose repeat, or a decoy."""
    r = random.Random(2)
    right = wrong = planted = 0
    for i in range(200):
        n = f"{r.randrange(200, 999)} 555 {r.randrange(1000, 9999)}".split()
        a = "+1 (%s) %s-%s" % tuple(n)
        loose = r.choice([".".join(n), "-".join(n), "".join(n), "0" + "".join(n)])
        decoy = str(r.randrange(10**9, 10**10))
        text = f"{FILL[:r.randrange(200)]} tel {a} {FILL[:r.randrange(900)]} {loose if i % 2 else decoy} end"
        found = added(text, field)
        planted += i % 2
        right += i % 2 and found == [("phone", loose)]
        wrong += len(found) - (i % 2 and found == [("phone", loose)])
    assert right >= 0.95 * planted and wrong <= 2


@pytest.mark.parametrize("text", [" ".join(str(10**9 + 7919 * i) for i in range(20_000)) + " +1 234 555 6789", "a@ " * 50_000 + "b@c.de", "x" * 100_000 + " (at) y", "(at) " * 50_000 + "1", "1234567 " * 30_000 + "+1 234 555 6789"])
def test_field_stays_linear(field, text):
    began = time.time()
    pii.added_spans([text], [pii.base_spans(text)], field)
    assert time.time() - began < 30


def test_find_and_redact(spark):
    rows = [(1, "mail bob@x.org, ip 10.0.0.1"), (2, None), (3, ""), (3, "é +1 234 555 6789 é"), (None, "none 12"), (3, "é +1 234 555 6789 é")]
    frame = spark.createDataFrame([(d, t, "p", 3) for d, t in rows], "doc_id bigint, text string, pii string, n_chars bigint")
    model = pii.train(pii.training_sample(frame))
    got = pii.find_pii(frame, model).collect()
    phone = [("phone", 2, 17)]
    assert [[(s.kind, s.start, s.end) for s in r.pii] for r in got] == [[("email", 5, 14), ("ip", 19, 27)], [], [], phone, [], phone]
    clean = pii.redact(frame, model).collect()
    assert [r.text for r in clean] == ["mail [EMAIL], ip [IP]", None, "", "é [PHONE] é", "none 12", "é [PHONE] é"]
    assert [r.n_chars for r in clean] == [21, 3, 0, 11, 7, 11] and clean[0].pii == "p"
    assert pii.find_pii(frame.limit(0), model).count() == 0
    many = "a@b.co " * 40_000
    one = pii.redact(spark.createDataFrame([(many,)], "text string"), model).first().text
    assert one == "[EMAIL] " * 40_000
