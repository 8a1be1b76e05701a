"""Fingerprints against a plain restatement, and the query's neighbours."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from kinegrain.llm import winnowing as w


def plain(text, k, window):
    """Positions that some window keeps, by comparing every window's hashes."""
    if not text:
        return []
    if len(text) < k:
        return [0]
    h = []
    for i in range(len(text) - k + 1):
        # The hash of a k-gram alone: its fingerprint when it is the whole of a text of k characters.
        h.append(int(w.fingerprints([text[i: i + k]], k, 1)[0][0][0]))
    windows = [range(i, i + window) for i in range(len(h) - window + 1)] or [range(len(h))]
    return sorted({max(r, key=lambda i: (-h[i], i)) for r in windows})


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abcé漢 ", max_size=40), max_size=5))
def test_positions(texts):
    got = w.fingerprints(texts, 3, 4)
    assert [p.tolist() for _, p in got] == [plain(t, 3, 4) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab ", min_size=20, max_size=40), st.text(alphabet="ab ", max_size=20), st.text(alphabet="ab ", max_size=20))
def test_guarantee(shared, left, right):
    k, window = 5, 8
    a, b = w.fingerprints([left + shared, shared + right], k, window)
    assert set(a[0].tolist()) & set(b[0].tolist())


def test_long_text_equals_pieces(monkeypatch):
    texts = ["ab cd ef gh " * 300, "x", "", "abcdefghijklmnop" * 40, "zz" * 1000]
    whole = w.fingerprints(texts)
    monkeypatch.setattr(w, "SLICE_CHARS", 50)
    assert [(a.tolist(), b.tolist()) for a, b in w.fingerprints(texts)] == [(a.tolist(), b.tolist()) for a, b in whole]


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = []
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        e = w.edited(t, nxt)
        a, b, c = w.fingerprints([t, e, nxt])
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), w.text_form(a), w.text_form(b), w.likeness(a[0], b[0]), w.likeness(a[0], c[0])))
    return out


def test_query_rows(spark):
    rows = [(i * 3 % 17, f"text number {i} " * (i % 5 * 9)) for i in range(17)] + [(4, None), (4, None), (None, "é漢" * 99), (99, "x" * 5000)]
    for n in (1, 5):
        frame = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id bigint, text string, fingerprint string, n_chars int")
        got = w.fingerprint_and_edit(frame, partitions=n).collect()
        key = lambda r: repr(tuple(r))
        assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)
    assert w.fingerprint_and_edit(frame.limit(0)).count() == 0
    assert w.fingerprint_and_edit(frame.where("doc_id = 99")).first().near_next == 1.0
