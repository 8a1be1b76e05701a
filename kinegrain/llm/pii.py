"""Personal data: base patterns, and a skip-chain random field over a document's words.

Base spans are given by patterns and always stay. Beside them a document has
loose mentions: other groups of digits, words with an at sign, addresses
written out ("name (at) host (dot) org"), long codes. The words of mentions
and those around them are the nodes of a random field with one label each:
none, a kind of personal data, or secret. A node has potentials of its own
form and of the words beside it, learned from the patterns' labels; nodes next
to each other form a chain; and mentions that are repeated or similar anywhere
in the document (the same digits, digits but for one, one number ending like
another, one address spelled two ways) share potentials with a hub node for
what they have in common, so distant ones pull each other to one label at a
cost that is linear in their number. Loopy sum-product message passing gives
the nodes' marginals, and loose mentions whose words come out as personal data
are added as spans.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from kinegrain.llm import scratch
from kinegrain.llm import textkernel as tk
from kinegrain.llm.sampling import stretches

KINDS = ("email", "ip", "card", "phone")
#: A kind that only the field gives, from the context and the form of codes.
SECRET = "secret"
NAMES = ("none", *KINDS, SECRET)
LABELS = len(NAMES)
#: Bound of the training sample: texts with a digit or an at sign, and characters of
#: one. A longer text trains by stretches from all of it.
SAMPLE_DOCS = 2000
SAMPLE_CHARS = 8_000
STEPS = 60
ROUNDS = 40
DAMPING = 0.3
THRESHOLD = 0.5
#: Words on either side of a mention that are nodes with it.
CONTEXT = 6
#: Bits of the hashed features of a node, and features of one.
FEATURE_BITS = 16
FEATURES = 7
#: Agreement with the hub of a common form, in log potentials: before training for equal forms, and for similar ones.
SKIP_PRIOR = 5.0
SKIP_NEAR = 4.5
#: Characters of documents whose graphs are solved together.
GRAPH_CHARS = 1 << 19

# The patterns of the base spans, written so that they take linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Loose mentions: groups of digits, addresses written out, codes. Words with an at sign are found by scanning.
_DIGITS = re.compile(r"[0-9](?:[ ().,/:_-]{0,2}[0-9]){6,}+")
_SPELLED = re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}+ ?[(\[] ?at ?[)\]] ?[\w-]{1,64}+(?: ?(?:\.|[(\[] ?dot ?[)\]]) ?[\w-]{1,64}+)+", re.IGNORECASE)
_CODE = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+")
#: Contexts that say what a code is; they label codes for training only.
_ASSIGNED = re.compile(r"(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_-]{16,}+)", re.IGNORECASE)
_NOT_DIGIT = re.compile("[^0-9]+")
_AT_WORDS = re.compile(r"[(\[] ?(?:at|dot) ?[)\]]", re.IGNORECASE)
_NOT_ALNUM = re.compile(r"[\W_]+")
_EDGES = " \t.,;:()<>[]{}\"'!?#*&%$|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def find_emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: from every at sign outwards, never back into the match before."""
    out, limit = [], 0
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > limit and text[start - 1] in _LOCAL:
                start -= 1
        if domain and start < at:
            out.append((start, domain.end()))
            limit = domain.end()
        at = text.find("@", max(at + 1, limit))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; kinds are positions in ``KINDS``."""
    out = [(0, a, b) for a, b in find_emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


@dataclass
class Mention:
    start: int
    end: int
    kind: int  # base kind + 1, or 0
    sort: str  # what it looks like: digits, address, spelled, code


def at_words(text: str) -> Iterator[tuple[int, int]]:
    """Whole words that hold an at sign, without the marks around them."""
    at, done = text.find("@"), 0
    while at >= 0:
        a = at
        while a > done and not text[a - 1].isspace():
            a -= 1
        b = at + 1
        while b < len(text) and not text[b].isspace():
            b += 1
        word = text[a:b]
        core = word.strip(_EDGES)
        if core and core != "@":
            at_core = a + word.index(core[0]) if word[0] in _EDGES else a
            yield at_core, at_core + len(core)
        done = b
        at = text.find("@", b)


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[Mention]:
    """Base spans and the loose mentions that overlap none of them, in text order."""
    out = [Mention(a, b, k + 1, "address" if k == 0 else "digits") for k, a, b in base]
    loose: list[Mention] = []
    taken = sorted((a, b) for _, a, b in base)

    def add(found: Iterable[tuple[int, int]], sort: str) -> None:
        i, last = 0, 0
        new = []
        for a, b in found:
            # Base spans of two kinds may overlap, so the furthest end so far counts.
            while i < len(taken) and taken[i][0] < b:
                last = max(last, taken[i][1])
                i += 1
            if last <= a:
                new.append(Mention(a, b, 0, sort))
        loose.extend(new)
        taken[:] = sorted(taken + [(m.start, m.end) for m in new])

    add((m.span() for m in _SPELLED.finditer(text)), "spelled")
    add(at_words(text), "address")
    add((m.span() for m in _CODE.finditer(text) if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])), "code")
    add((m.span() for m in _DIGITS.finditer(text)), "digits")
    out += loose
    out.sort(key=lambda x: (x.start, x.end, x.kind))
    return out


def forms(text: str, m: Mention) -> list[tuple[object, bool]]:
    """What a mention has in common with others like it: (form, whether only similar)."""
    own = text[m.start: m.end]
    if m.sort == "digits":
        d = _NOT_DIGIT.sub("", own)
        out: list[tuple[object, bool]] = [((0, d), False)]
        if len(d) >= 10:
            # A number with and without its country's prefix.
            out.append(((1, d[-10:].lstrip("0")), True))
        if 7 <= len(d) <= 15:
            out.append(((2, d[-7:]), True))
        if 9 <= len(d) <= 24:
            # Digits but for one: two numbers a slip apart leave the same rest.
            out.append(((3, d), True))
            out += [((3, d[:i] + d[i + 1:]), True) for i in range(len(d)) if not i or d[i] != d[i - 1]]
        return out
    if m.sort == "code":
        return [((4, own.lower()), False)]
    plain = _NOT_ALNUM.sub("", _AT_WORDS.sub("", own)).lower()
    return [((5, own.lower()), False), ((6, plain), True)]


def describe(text: str, m: Mention) -> str:
    """A mention's own kind of look, one feature of all its words."""
    own = text[m.start: m.end]
    if m.sort == "digits":
        d = _NOT_DIGIT.sub("", own)
        parts = own.split(".")
        dotted = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 for p in parts)
        return f"digits {min(len(d), 20)} {13 <= len(d) <= 19 and luhn(d)} {dotted} {m.start > 0 and text[m.start - 1] == '+'}"
    if m.sort == "code":
        hexed = all(c in "0123456789abcdefABCDEF" for c in own)
        return f"code {hexed} {min(len(own) // 8, 8)}"
    return m.sort


@dataclass
class Graph:
    """The fields of several documents: nodes are words, in order."""
    docs: int
    features: np.ndarray  # nodes x FEATURES
    known: np.ndarray  # label of a base span's words, else 0
    joined: np.ndarray  # whether a node follows the one before it in the text
    node: np.ndarray  # of each link to a hub
    hub: np.ndarray
    near: np.ndarray
    mentions: list[tuple[int, Mention]]  # with the document's number
    first: np.ndarray  # first node, and one past the last, of each mention
    last: np.ndarray


_CLASS = np.arange(128, dtype=np.uint8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 57, 65, 97
_SPACE = np.zeros(128, bool)
_SPACE[[32, *range(9, 14), *range(28, 32)]] = True
_ALNUM = np.zeros(128, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
#: Characters whose presence in a word is told apart in its form.
_MARKS = "@.-+()/:=\"'_"


def hashed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def build_graph(texts: list[str], found: list[list[Mention]]) -> Graph:
    """Nodes, chains and hubs of the documents' mentions (as `mentions` gives them)."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    offset = np.cumsum(sizes) - sizes
    codes = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_ = np.minimum(codes, 127).astype(np.uint8)
    wide = codes > 127
    space = _SPACE[ascii_] & ~wide | (codes == 0xA0) | (codes == 0x85) | (codes == 0x2028) | (codes == 0x2029) | (codes == 0x3000)
    edge = np.flatnonzero(np.concatenate(([True], space[1:] != space[:-1], [True])))
    starts, ends = edge[:-1], edge[1:]
    inside = ~space[starts]
    starts, ends = starts[inside], ends[inside]
    of_doc = np.searchsorted(offset, starts, side="right") - 1
    flat = [(i, m) for i, ms in enumerate(found) for m in ms]
    begin = np.array([offset[i] + m.start for i, m in flat], np.int64)
    end = np.array([offset[i] + m.end for i, m in flat], np.int64)
    low, high = np.searchsorted(ends, begin, side="right"), np.searchsorted(starts, end, side="left")
    # Nodes: the mentions' words and those around them in the same document.
    doc_first, doc_last = np.searchsorted(of_doc, np.arange(len(texts))), np.searchsorted(of_doc, np.arange(len(texts)), side="right")
    owner = np.array([i for i, _ in flat], np.int64)
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, np.maximum(low - CONTEXT, doc_first[owner]), 1)
    np.add.at(cover, np.minimum(high + CONTEXT, doc_last[owner]), -1)
    words = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    place = np.cumsum(np.cumsum(cover[:-1]) > 0) - 1
    first, last = place[low], place[high - 1] + 1
    # Forms, from the words without the marks around them.
    s, e = starts[words], ends[words]
    lowered = codes.copy()
    upper = (codes >= 65) & (codes <= 90)
    lowered[upper] += 32
    solid = np.flatnonzero(_ALNUM[ascii_] & ~wide | wide)
    a = np.searchsorted(solid, s)
    b = np.searchsorted(solid, e)
    some = b > a
    core_s, core_e = s.copy(), e.copy()
    core_s[some], core_e[some] = solid[a[some]], solid[b[some] - 1] + 1
    raw = lowered.view(np.uint8)
    word_hash = tk.span_hashes(raw, core_s * 4, core_e * 4)
    all_hash = tk.span_hashes(raw, starts * 4, ends * 4)
    kind = np.where(wide, 97, _CLASS[ascii_]).astype(np.uint8)
    fresh = np.ones(len(kind), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[starts] = True
    kept = np.flatnonzero(fresh)
    shape_s, shape_e = np.searchsorted(kept, core_s), np.searchsorted(kept, core_e)
    fresh_core = core_s < core_e
    shape = tk.span_hashes(kind[kept], shape_s, np.where(fresh_core, np.minimum(shape_e, shape_s + 8), shape_s))
    bits = np.zeros(len(words), np.uint64)
    count = lambda flag: (c := np.concatenate(([0], np.cumsum(flag))))[core_e] - c[core_s]
    for k, flag in enumerate((kind == 65, kind == 97, *(codes == ord(c) for c in _MARKS))):
        bits |= (count(flag) > 0).astype(np.uint64) << np.uint64(k)
    digits = np.minimum(count(kind == 57), 20).astype(np.uint64)
    length = np.minimum(np.log2(np.maximum(core_e - core_s, 1)), 7).astype(np.uint64)
    before = np.where((words > 0) & (of_doc[np.maximum(words - 1, 0)] == of_doc[words]), all_hash[np.maximum(words - 1, 0)], 0)
    after_at = np.minimum(words + 1, len(starts) - 1)
    after = np.where((words + 1 < len(starts)) & (of_doc[after_at] == of_doc[words]), all_hash[after_at], 1)
    look = np.zeros(len(words), np.uint64)
    for (i, m), x, y in zip(flat, first.tolist(), last.tolist()):
        look[x:y] = hashed(describe(texts[i], m))
    plain = np.where(digits > 0, np.uint64(1), np.uint64(0)) | (bits >> np.uint64(2) & np.uint64(1)) << np.uint64(1)
    columns = (shape, tk.mix(bits * np.uint64(64) + length), tk.mix(digits + (bits << np.uint64(32))), before.astype(np.uint64), after.astype(np.uint64), look, plain)
    features = np.stack([(tk.mix(c + np.uint64((k + 1) * tk.BASE % (1 << 64))) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32) for k, c in enumerate(columns)], axis=1)
    known = np.zeros(len(words), np.int64)
    for (_, m), x, y in sorted(zip(flat, first.tolist(), last.tolist()), key=lambda r: -r[0][1].kind):
        if m.kind:
            known[x:y] = m.kind
    joined = np.zeros(len(words), bool)
    joined[1:] = (words[1:] == words[:-1] + 1) & (of_doc[words[1:]] == of_doc[words[:-1]])
    node, hub, near = _hubs(texts, found, first, last)
    return Graph(len(texts), features, known, joined, node, hub, near, flat, first, last)


def _hubs(texts: list[str], found: list[list[Mention]], first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (node, hub, whether only similar) of mentions with something in common in their document."""
    keys, members, near = array("q"), array("q"), array("b")
    number = 0
    for i, (text, ms) in enumerate(zip(texts, found)):
        # Where all mentions are base spans, or there is but one, links change nothing.
        if len(ms) > 1 and any(not m.kind for m in ms):
            for k, m in enumerate(ms):
                for form, similar in forms(text, m):
                    keys.append(hash((i, form)))
                    members.append(number + k)
                    near.append(similar)
        number += len(ms)
    none = np.zeros(0, np.int64)
    if not len(keys):
        return none, none, none.astype(bool)
    key, member, similar = np.frombuffer(keys, np.int64), np.frombuffer(members, np.int64), np.frombuffer(near, np.int8) > 0
    _, hub, count = np.unique(key, return_inverse=True, return_counts=True)
    shared = count[hub] > 1
    hub, member, similar = np.unique(hub[shared], return_inverse=True)[1], member[shared], similar[shared]
    words = (last - first)[member]
    return tk.ragged(first[member], words), np.repeat(hub, words), np.repeat(similar, words)


@dataclass
class Model:
    unary: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels
    skip: float


def default_model() -> Model:
    return Model(np.zeros((1 << FEATURE_BITS, LABELS)), np.zeros((LABELS, LABELS)), SKIP_PRIOR)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=1, keepdims=True)


def _added(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(index, values[:, k], minlength=n) for k in range(values.shape[1])], axis=1)


def infer(model: Model, scores: np.ndarray, known: np.ndarray, joined: np.ndarray, node: np.ndarray, hub: np.ndarray, near: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Marginals (nodes x labels) by loopy sum-product with damping.

    Messages pass along chains (``joined`` says that a node follows the one
    before) and over the links between nodes and hubs. ``known`` is the label
    of a base span, which stays, or 0. Exact where the graph has no loop.
    """
    m, n = scores.shape
    phi = np.exp(scores - scores.max(axis=1, keepdims=True, initial=0)) if m else np.zeros((0, n))
    fixed = np.flatnonzero(known)
    phi[fixed] = 0
    phi[fixed, known[fixed]] = 1
    chain = np.exp(model.chain)
    gain = np.where(near, np.exp(min(SKIP_NEAR, model.skip)), np.exp(model.skip))[:, None] - 1
    follows = np.flatnonzero(joined)
    hubs = int(hub.max()) + 1 if len(hub) else 0
    right, left = np.full((m, n), 1 / n), np.full((m, n), 1 / n)  # messages into a node from before and after
    up, down = np.full((len(node), n), 1 / n), np.full((len(node), n), 1 / n)  # to and from the hubs
    around = np.ones((m, n))  # of the hubs' messages into a node

    def scaled(logs: np.ndarray) -> np.ndarray:
        return np.exp(logs - logs.max(axis=1, keepdims=True, initial=-np.inf)) if len(logs) else logs

    for _ in range(rounds):
        new_right, new_left = np.full((m, n), 1 / n), np.full((m, n), 1 / n)
        new_right[follows] = _unit((phi * right * around)[follows - 1] @ chain)
        new_left[follows - 1] = _unit((phi * left * around)[follows] @ chain.T)
        change = max(float(np.abs(new_right - right).max(initial=0)), float(np.abs(new_left - left).max(initial=0)))
        right, left = DAMPING * right + (1 - DAMPING) * new_right, DAMPING * left + (1 - DAMPING) * new_left
        if len(node):
            logs = np.log(np.maximum(down, 1e-12))
            others = _added(node, logs, m)[node] - logs
            new_up = _unit(_unit((phi * right * left)[node] * scaled(others) + 1e-300) * gain + 1)
            logs = np.log(np.maximum(new_up, 1e-12))
            rest = _added(hub, logs, hubs)[hub] - logs  # what the others of one form say
            new_down = _unit(_unit(scaled(rest)) * gain + 1)
            change = max(change, float(np.abs(new_down - down).max()), float(np.abs(new_up - up).max()))
            up, down = new_up, DAMPING * down + (1 - DAMPING) * new_down
            around = scaled(_added(node, np.log(down), m))
        if change < 1e-5:
            break
    return _unit(phi * right * left * around + 1e-300)


def unary_scores(model: Model, features: np.ndarray) -> np.ndarray:
    out = np.zeros((len(features), LABELS))
    for k in range(features.shape[1]):
        out += model.unary[features[:, k]]
    return out


def training_labels(texts: list[str], graph: Graph) -> np.ndarray:
    """A label for every node: base spans', secrets' by context, and of a mention with the same form as one of these."""
    y = graph.known.copy()
    assigned = [{m.span(1) for m in _ASSIGNED.finditer(t)} for t in texts]
    label = []
    for (i, m), x, z in zip(graph.mentions, graph.first, graph.last):
        k = m.kind or (LABELS - 1 if m.sort == "code" and (m.start, m.end) in assigned[i] else 0)
        label.append(k)
        if k and not m.kind:
            y[x:z] = np.where(y[x:z], y[x:z], k)
    same = {}
    for (i, m), k in zip(graph.mentions, label):
        if k:
            same.setdefault((i, forms(texts[i], m)[0][0]), k)
    for (i, m), k, x, z in zip(graph.mentions, label, graph.first, graph.last):
        if not k:
            y[x:z] = np.where(y[x:z], y[x:z], same.get((i, forms(texts[i], m)[0][0]), 0))
    return y


def train(texts: list[str], steps: int = STEPS) -> Model:
    """Fit node and chain potentials by pseudo-likelihood, and the skip potential by how often equal forms agree.

    Labels are those of `training_labels`; every node's label is predicted from
    its features and its neighbours' labels. Without texts, or without any
    mention in them, the potentials are zero and the skip potential a prior.
    """
    model = default_model()
    found = [mentions(t, base_spans(t)) for t in texts]
    texts, found = [t for t, f in zip(texts, found) if f], [f for f in found if f]
    if not texts:
        return model
    graph = build_graph(texts, found)
    y = training_labels(texts, graph)
    ahead = np.zeros(len(y), bool)
    ahead[:-1] = graph.joined[1:]
    before, after = np.zeros(len(y), np.int64), np.zeros(len(y), np.int64)
    before[1:], after[:-1] = y[:-1], y[1:]
    seen = np.bincount(graph.features.ravel(), minlength=1 << FEATURE_BITS)
    target = np.eye(LABELS)[y]
    pairs = np.zeros((LABELS, LABELS))
    for _ in range(steps):
        s = unary_scores(model, graph.features)
        s += np.where(graph.joined[:, None], model.chain[before], 0)
        s += np.where(ahead[:, None], model.chain.T[after], 0)
        gap = target - _unit(np.exp(s - s.max(axis=1, keepdims=True)))
        g = np.zeros_like(model.unary)
        for k in range(FEATURES):
            g += _added(graph.features[:, k], gap, len(g))
        model.unary += 0.5 * (g / np.maximum(seen, 5)[:, None] - 0.02 * model.unary)
        pairs[:] = 0
        np.add.at(pairs, before[graph.joined], gap[graph.joined])
        np.add.at(pairs.T, after[ahead], gap[ahead])
        model.chain += 0.5 * (pairs / np.maximum(np.bincount(y, minlength=LABELS), 20)[:, None] - 0.02 * model.chain)
    # Smoothed by a prior worth a hundred pairs.
    agree = disagree = 0
    for text, ms in zip(texts, found):
        last: dict[object, int] = {}
        for m in ms:
            form = forms(text, m)[0][0]
            if form in last:
                agree += last[form] == m.kind
                disagree += last[form] != m.kind and bool(last[form] and m.kind)
            last[form] = m.kind
    prior = np.exp(SKIP_PRIOR) / (np.exp(SKIP_PRIOR) + LABELS - 1)
    share = (agree + 100 * prior) / (agree + disagree + 100)
    model.skip = float(np.log(share * (LABELS - 1) / (1 - share)))
    return model


def added_spans(texts: list[str], bases: list[list[tuple[int, int, int]]], model: Model) -> list[list[tuple[int, int, int]]]:
    """Of each text, the spans of loose mentions that the field labels: (label - 1, start, end)."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = [mentions(t, b) for t, b in zip(texts, bases)]
    own = [i for i, ms in enumerate(found) if any(not m.kind for m in ms)]
    if not own:
        return out
    graph = build_graph([texts[i] for i in own], [found[i] for i in own])
    p = infer(model, unary_scores(model, graph.features), graph.known, graph.joined, graph.node, graph.hub, graph.near)
    total = np.concatenate((np.zeros((1, LABELS)), np.cumsum(p, axis=0)))
    mean = (total[graph.last] - total[graph.first]) / np.maximum(graph.last - graph.first, 1)[:, None]
    for (i, m), q in zip(graph.mentions, mean):
        k = int(q[1:].argmax()) + 1
        if not m.kind and q[k] >= THRESHOLD:
            out[own[i]].append((k - 1, m.start, m.end))
    return out


def training_sample(docs: DataFrame) -> list[str]:
    """At most ``SAMPLE_DOCS`` distinct texts with a digit or an at sign, by smallest hash; of long ones, stretches from all of them."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    hashed_ = texts.withColumn("h", F.xxhash64("text"))
    # Hashes alone are ranked; the largest one taken then bounds what is read as text.
    bound = hashed_.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    if bound is None:
        return []
    taken = hashed_.where(F.col("h") <= bound).withColumn("text", stretches(F.col("text"), SAMPLE_CHARS)).groupBy("h").agg(F.min("text").alias("text"))
    return [r.text for r in sorted(taken.collect(), key=lambda r: r.h)]


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
SPAN_TYPE = "array<struct<kind string, start bigint, end bigint, base boolean>>"


def suspects(column: pa.Array) -> np.ndarray:
    """Rows whose text has a digit, an at sign or an "at" in brackets; others have no mention of any kind."""
    raw, offsets = tk.utf8_buffer(column)
    out = np.zeros(len(column), bool)
    for a, b in tk.slices(offsets):
        part = raw[offsets[a]: offsets[b]]
        hit = (part == 0x40) | ((part >= 0x30) & (part <= 0x39))
        closing = np.flatnonzero((part == 0x29) | (part == 0x5D))
        closing = closing[closing > 0]
        hit[closing[np.isin(part[closing - 1], (0x74, 0x54, 0x20))]] = True
        flag = np.concatenate(([0], np.cumsum(hit)))
        out[a:b] = np.diff(flag[offsets[a: b + 1] - offsets[a]]) > 0
    return out


def spans_of(column: pa.Array, model: Model) -> dict[int, list[tuple[int, int, int, bool]]]:
    """Of each row that has any: (label - 1, start, end, base), sorted."""
    out: dict[int, list[tuple[int, int, int, bool]]] = {}
    rows = np.flatnonzero(suspects(column)).tolist()
    while rows:
        texts, size = [], 0
        while len(texts) < len(rows) and (not texts or size < GRAPH_CHARS):
            texts.append(column[rows[len(texts)]].as_py())
            size += len(texts[-1])
        bases = [base_spans(t) for t in texts]
        for i, base, more in zip(rows, bases, added_spans(texts, bases, model)):
            if base or more:
                out[i] = sorted([(*x, True) for x in base] + [(*x, False) for x in more])
        rows = rows[len(texts):]
    return out


def find_pii(docs: DataFrame, model: Model, text: str = "text", out: str = "pii") -> DataFrame:
    """All columns of ``docs`` and ``out``: an array of (kind, start, end, base), by kind, then start.

    Kinds come in the order email, ip, card, phone, secret. Offsets are code
    points, ends exclusive; ``base`` tells the patterns' spans from those that
    the field adds. Spans of different kinds may overlap; added ones overlap no
    base span. A null or empty text has none. Rows and columns stay as they
    are, repeated rows too; a column already named like ``out`` is replaced. An
    empty table gives no rows. Equal texts have equal spans: a document's field
    depends on the document and the model alone.
    """
    names = [c for c in docs.columns if c != out]
    at = names.index(text)
    docs = docs.select(*names)
    scratch.bound_batches(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = spans_of(batch.column(at), sent.value)
            rows = [[{"kind": NAMES[k + 1], "start": a, "end": b, "base": x} for k, a, b, x in found.get(i, ())] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _SPAN)], names=[*names, out])
        tk.trim()

    schema = StructType([*docs.schema.fields, StructField(out, DataType.fromDDL(SPAN_TYPE))])
    return docs.mapInArrow(run, schema)


def cleaned(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping ones are joined and named by the first."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b, _ in spans):
        if a >= at:
            out += [text[at:a], f"[{NAMES[k + 1].upper()}]"]
        at = max(at, b)
    return "".join((*out, text[at:]))


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Replace every span by its kind in brackets; a column ``n_chars`` follows the text.

    Other columns and rows stay; a null text stays null. The work is linear in
    the text, however many spans it has.
    """
    names = docs.columns
    at = names.index(text)
    scratch.bound_batches(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            found = spans_of(column, sent.value)
            columns = list(batch.columns)
            if found:
                new = {i: cleaned(column[i].as_py(), s) for i, s in found.items()}
                rows = np.arange(batch.num_rows)
                changed = np.isin(rows, list(new))
                texts = pa.array([new[i] for i in sorted(new)], column.type)
                columns[at] = pc.replace_with_mask(column, pa.array(changed), texts)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        tk.trim()

    done = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.coalesce(F.length(text).cast(kind), F.col("n_chars")))
    return done.select(*names)
