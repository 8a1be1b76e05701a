"""The Jaccard join, its components, and decontamination against brute force."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinegrain.llm import components as cc
from kinegrain.llm import decontaminate, jaccard, sketches

WORDS = [f"w{i}" for i in range(60)]


def words_of(text):
    out, run = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            if run:
                out.append(run)
            run = ""
        else:
            run += c.lower() if "A" <= c <= "Z" else c
    return out


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[i: i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 85 * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed):
    r = random.Random(seed)
    rows, base = [], [" ".join(r.choices(WORDS, k=r.choice([1, 2, 5, 30, 80, 200]))) for _ in range(25)]
    for i in range(160):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(WORDS)
        if r.random() < 0.2:
            w = [x.upper() for x in w]
        rows.append((i * 7 % 1000, r.choice([" ", "\n", "  "]).join(w)))
    return rows + [(5000, None), (5001, ""), (5002, " \n "), (5003, "one two"), (5004, "ONE  two"), (None, "one two"), (5005, "  x"), (5003, "one two")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id bigint, text string, n int, s string")


@pytest.mark.parametrize("hot,tile", [(1 << 15, 1024), (4, 8)])
def test_components(spark, monkeypatch, hot, tile):
    monkeypatch.setattr(jaccard, "HOT_ROWS", hot)
    monkeypatch.setattr(jaccard, "TILE_CLASSES", tile)
    monkeypatch.setattr(cc, "ONE_TASK_LINKS", 0 if hot == 4 else 1000)
    rows = corpus(3)
    got = [tuple(r) for r in jaccard.components(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == brute_components(rows)


def brute_links(rows):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[i: i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    named = [j for j, (d, _) in enumerate(rows) if d is not None]
    links = lambda i: sum(j != i and bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) for j in named)
    return sorted(((d, len(sets[i]), links(i)) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("tile", [1024, 4])
def test_links_of_documents(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE_CLASSES", tile)
    rows = corpus(3)
    got = jaccard.components(frame(spark, rows), with_links=True).collect()
    assert sorted(((g.doc_id, g.n_shingles, g.n_links) for g in got), key=repr) == brute_links(rows)
    assert sorted(((g.doc_id, g.n_shingles, g.component_id) for g in got), key=repr) == brute_components(rows)


def test_documents_without_an_id_carry_links(spark):
    """5 and 9 are linked by a document between them that has no id; two rows without ids have each other only."""
    words = [f"v{i}" for i in range(120)]
    middle = words[:100] + ["x1"]
    rows = [(9, " ".join(words[:92] + words[:0])), (None, " ".join(words[:100])), (5, " ".join(words[:108])), (None, " ".join(f"u{i}" for i in range(40))), (None, " ".join(f"u{i}" for i in range(41)))]
    rows += [(None, " ".join(words[:100]))] * 3 + [(7, " ".join(middle[50:]))]
    got = [tuple(r) for r in jaccard.components(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == brute_components(rows)
    assert {c for d, _, c in got if d in (5, 9)} == {5}


def test_repetitive_words_stay_apart(spark):
    """Words whose sums of powers are equal modulo 2**64."""
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word + " x y z"), (2, other + " x y z"), (3, word + "\nX y z")]
    assert sorted(tuple(r) for r in jaccard.components(frame(spark, rows)).collect()) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 3000), st.integers(0, 3000), st.integers(0, 99))
def test_counts_bound_the_overlap(a, b, both, seed):
    r = np.random.default_rng(seed)
    pool = np.unique(r.integers(0, 1 << 63, a + b + both, dtype=np.uint64) * np.uint64(2))
    r.shuffle(pool)
    x, y = pool[: a + both], np.concatenate((pool[a: a + both], pool[a + both:]))
    bound = jaccard.most_overlap(jaccard.range_counts(x), jaccard.range_counts(y))
    assert len(np.intersect1d(x, y)) <= bound <= min(len(x), len(y))
    same = np.arange(1 << 10, dtype=np.uint64)  # all in one range
    assert jaccard.most_overlap(jaccard.range_counts(same), jaccard.range_counts(same[:300])) == 300


@pytest.mark.parametrize("small", [1, 3, 6])
def test_components_by_column_size(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL_COLUMN", small)
    rows = corpus(11)
    got = [tuple(r) for r in jaccard.components(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == brute_components(rows)


def test_items_without_an_id_hit(spark):
    text = " ".join(WORDS[:12])
    bench = spark.createDataFrame([(None, text), (None, "..."), (4, " ".join(WORDS[20:31]))], "item_id bigint, text string")
    got = decontaminate.find_overlaps(frame(spark, [(1, text), (2, "calm " + " ".join(WORDS[20:31]))]), bench).collect()
    assert sorted((g.doc_id, g.n_hit, g["items"]) for g in got) == [(1, 12, []), (2, 11, ["4"])]


def test_components_of_nothing(spark):
    assert jaccard.components(frame(spark, [])).count() == 0
    assert jaccard.components(frame(spark, [(1, None)])).collect()[0][:] == (1, 0, 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=40), min_size=2, max_size=30), st.sampled_from([50, 85]))
def test_link_roots(lists, percent):
    sets = [np.unique(np.array(x, np.uint64)) for x in lists]
    root = jaccard.link_roots(sets, percent)
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert root.tolist() == label


def brute_hits(rows, items):
    def words(t):
        out, run = [], ""
        for c in (t or "") + " ":
            ok = c.isascii() and c.isalnum() or ord(c) > 127
            if ok:
                run += c.lower() if "A" <= c <= "Z" else c
            elif run:
                out.append(run)
                run = ""
        return out

    windows = {}
    for k, t in items:
        w = words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i: i + n]), set()).add(str(k))
    out = []
    for d, t in rows:
        w = words(t)
        hit, found = set(), set()
        for i in range(len(w)):
            for n in {len(x) for x in windows}:
                if tuple(w[i: i + n]) in windows and i + n <= len(w):
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i: i + n])]
        out.append((d, len(w), len(hit), tuple(sorted(found)), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("with_short", [False, True])
def test_decontamination(spark, with_short):
    r = random.Random(5)
    few = WORDS[:6]
    items = [(i, " ".join(r.choices(WORDS, k=r.choice([10, 11, 15, 40])))) for i in range(12)] + [(100, items_text := " ".join(few + few)), (101, items_text), (102, None), (103, "...")]
    if with_short:
        items += [(7, "W3, é-w4"), (8, "w1 w2 w3"), (8, "w1 w2 w3")]
    rows = []
    for i in range(60):
        w = r.choices(WORDS, k=r.choice([0, 3, 12, 60]))
        for _ in range(r.choice([0, 1, 2])):
            source = (r.choice(items[:13])[1] or "").split()
            a = r.randrange(len(source) - 8)
            cut = source[a: a + r.choice([8, 9, 10, 14, 40])]
            at = r.randrange(len(w) + 1)
            w[at:at] = cut
        rows.append((i, r.choice([" ", "-", ".\n"]).join(w)))
    rows += [(1, None), (2, ""), (None, items[0][1].upper()), (3, items[0][1]), (3, items[0][1])]
    bench = spark.createDataFrame([(k, t, "c") for k, t in items], "item_id bigint, text string, doc_id string")
    got = decontaminate.find_overlaps(frame(spark, rows), bench).collect()
    assert sorted(((g.doc_id, g.n_words, g.n_hit, tuple(g["items"]), g.contaminated) for g in got), key=repr) == brute_hits(rows, items)


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    got = decontaminate.find_overlaps(frame(spark, [(1, "a b"), (2, None)]), bench).collect()
    assert sorted((g.doc_id, g.n_words, g.n_hit, g.contaminated) for g in got) == [(1, 2, 0, False), (2, 0, 0, False)]
    assert decontaminate.find_overlaps(frame(spark, []), bench).count() == 0


def chained(spark, columns):
    made = spark.createDataFrame(columns, "h bigint, salt bigint, salted boolean, n bigint, s bigint")
    return sorted((min(r.u, r.v), max(r.u, r.v), r.test) for r in jaccard._chain(made, 85, 2, True).collect())


def test_runs_of_sizes_in_a_column(spark):
    """Sizes far apart do not make a column large, and neither do copies of a class."""
    spread = [(1, 0, False, 4**i, i) for i in range(1, 12)] + [(1, 0, False, 4**5, 50)]
    assert chained(spark, spread) == [(5, 50, True)]
    copies = [(2, 0, False, 100, s) for s in (7, 8) for _ in range(9)]
    assert chained(spark, copies) == [(7, 8, True)]
    full = [(3, 0, False, 100, s) for s in range(8)]
    assert chained(spark, full) == [(s, s + 1, False) for s in range(7)]


def test_frequency_table_grows_with_the_input():
    assert [jaccard.table_bits(gb << 30) for gb in (0, 1, 3, 1000)] == [22, 24, 26, 26]


def test_tiles_of_neighbouring_bands_meet(spark):
    cells = [(1, b, (b << 24) + p, p) for b, n in ((3, 3), (4, 1), (9, 2)) for p in range(n)]
    made = spark.createDataFrame(cells, "c bigint, band bigint, tile bigint, part bigint")
    both = [{(r.i, r.j) for r in jaccard._tile_pairs(made, first).collect()} for first in (True, False)]
    near = {(x[2], y[2]) for x in cells for y in cells if x[2] <= y[2] and y[1] - x[1] <= 1}
    assert not both[0] & both[1] and both[0] | both[1] == near
    t = lambda b, p: (b << 24) + p
    assert both[0] == {(t(3, 0), t(3, p)) for p in range(3)} | {(t(3, 0), t(4, 0)), (t(4, 0), t(4, 0)), (t(9, 0), t(9, 0)), (t(9, 0), t(9, 1))}


def test_tables_of_counts_are_packed_by_the_slots_in_use():
    """A task's table with one slot in 18 in use, as with 2^26 slots and 16 MB of input."""
    r = np.random.default_rng(2)
    counter = sketches.Counter(20)
    counter.add(r.integers(0, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2))
    rows = [x for b in counter.rows() for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert sum(len(x) for _, x in rows) < 0.5 * len(zlib.compress(counter.table.tobytes(), 1))
    for k, x in rows:
        assert (sketches.unpack_counts(x, sketches.CHUNK) == counter.table[k * sketches.CHUNK: (k + 1) * sketches.CHUNK]).all()
    for part in (np.zeros(1 << 16, np.uint8), np.full(1 << 16, 255, np.uint8), np.array([0, 3, 0], np.uint8)):
        assert (sketches.unpack_counts(sketches.pack_counts(part), len(part)) == part).all()


def test_bound_of_tiles_is_that_of_pairs():
    r = np.random.default_rng(3)
    base = np.unique(r.integers(0, 1 << 63, 9000, dtype=np.uint64) * np.uint64(2))
    r.shuffle(base)
    sets = [base[:n] for n in (1, 5, 900, 1000, 1100, 7000, 8500, 9000)] + [base[-n:] for n in (900, 1000, 8800)] + [np.arange(1000, dtype=np.uint64)]
    sides = [(len(x), jaccard.range_counts(x)) for x in sets]
    may = jaccard.may_link(sides[:7], sides, 80)
    for i, (n, x) in enumerate(sides[:7]):
        for j, (m, y) in enumerate(sides):
            assert may[i, j] == (jaccard.most_overlap(x, y) * 180 >= 80 * (n + m))


def test_texts_go_to_few_pairs_of_tiles(spark, monkeypatch):
    """Texts that share a passage but do not link, in one cluster of many tiles: all pairs of tiles are looked at, few texts move."""
    monkeypatch.setattr(jaccard, "TILE_CLASSES", 4)
    moved = []
    monkeypatch.setattr(jaccard, "_resolve", lambda rows, *a, whole=jaccard._resolve: moved.append(rows) or whole(rows, *a))
    # Each shares a third of its words with all, so its n-grams' order must not tell the shared ones apart.
    monkeypatch.setattr(jaccard, "_order", lambda counts: np.zeros(len(counts), np.uint8))
    shared = " ".join(f"c{i}" for i in range(40))
    rows = [(i, shared + " " + " ".join(f"d{i}x{j}" for j in range(80))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " more") for i in (7, 33, 58)]
    got = [tuple(r) for r in jaccard.components(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == brute_components(rows)
    first, rest = (x.count() for x in moved)
    assert first >= len(rows) and rest <= 12
