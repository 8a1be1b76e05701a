"""A two-label linear-chain conditional random field over many sequences at once.

Sequences are cut into segments of equal length. Segment products of the
transfer matrices are made side by side for all segments, carried along each
sequence, and then unrolled inside the segments, again side by side; results
are those of the plain forward-backward recursion for sequences of any length.
"""

from __future__ import annotations

import numpy as np

SEGMENT = 64


class Layout:
    """How the tokens of ragged sequences lie in segments."""

    def __init__(self, first: np.ndarray) -> None:
        size = np.diff(first)
        segments = -(-size // SEGMENT)
        self.n = int(first[-1])
        self.count = int(segments.sum())
        self.start = np.cumsum(segments) - segments
        self.segments = segments
        doc = np.repeat(np.arange(len(size)), size)
        inside = np.arange(self.n) - np.repeat(first[:-1], size)
        self.row = self.start[doc] + inside // SEGMENT
        self.col = inside % SEGMENT
        self.valid = np.zeros((self.count, SEGMENT), bool)
        self.valid[self.row, self.col] = True
        self.longest = int(segments.max()) if len(segments) else 0
        self.by_length = np.argsort(-segments, kind="stable")

    def alive(self, k: int) -> np.ndarray:
        """Sequences with more than ``k`` segments."""
        return self.by_length[: int(np.searchsorted(-self.segments[self.by_length], -k, side="left"))]


def _norm(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def marginals(layout: Layout, emission: np.ndarray, transition: np.ndarray, pairs: bool = False):
    """P(label = 1) of each token; with ``pairs`` also the expected 2 x 2 transition counts and log Z.

    ``emission`` is the log potential of label 1 against label 0 of each token,
    ``transition`` the 2 x 2 log potentials; before its first token a sequence
    is in label 0.
    """
    t = np.exp(transition - transition.max())
    e = np.zeros((layout.count, SEGMENT))
    e[layout.row, layout.col] = np.clip(emission, -30, 30)
    # Potentials of both labels, scaled so that neither exceeds 1.
    one = np.exp(np.minimum(e, 0))
    zero = np.exp(-np.maximum(e, 0))
    n, valid = layout.count, layout.valid
    partial = [k for k in range(SEGMENT) if not valid[:, k].all()]
    ragged = set(partial)
    log_scale = 0.0
    product = np.zeros((n, 2, 2))
    product[:, 0, 0] = product[:, 1, 1] = 1
    for k in range(SEGMENT):
        new = np.empty_like(product)
        new[:, :, 0] = (product[:, :, 0] * t[0, 0] + product[:, :, 1] * t[1, 0]) * zero[:, k, None]
        new[:, :, 1] = (product[:, :, 0] * t[0, 1] + product[:, :, 1] * t[1, 1]) * one[:, k, None]
        new /= new.sum(axis=(1, 2), keepdims=True)
        product = np.where(valid[:, k, None, None], new, product) if k in ragged else new
    ahead, behind = np.zeros((n, 2)), np.ones((n, 2))
    ahead[layout.start[layout.segments > 0], 0] = 1
    for k in range(1, layout.longest):
        at = layout.start[layout.alive(k)] + k
        ahead[at] = _norm((ahead[at - 1][:, :, None] * product[at - 1]).sum(axis=1))
    last = layout.start + layout.segments - 1
    for k in range(1, layout.longest):
        at = last[layout.alive(k)] - k
        behind[at] = _norm((product[at + 1] * behind[at + 1][:, None, :]).sum(axis=2))
    f = np.empty((n, SEGMENT, 2))
    state = ahead
    for k in range(SEGMENT):
        new = np.empty_like(state)
        new[:, 0] = (state[:, 0] * t[0, 0] + state[:, 1] * t[1, 0]) * zero[:, k]
        new[:, 1] = (state[:, 0] * t[0, 1] + state[:, 1] * t[1, 1]) * one[:, k]
        scale = new.sum(axis=1)
        if pairs:
            log_scale += float(np.log(scale[valid[:, k]]).sum())
        new /= scale[:, None]
        state = np.where(valid[:, k, None], new, state) if k in ragged else new
        f[:, k] = state
    prob = np.empty((n, SEGMENT))
    expected = np.zeros((2, 2))
    state = behind
    for k in range(SEGMENT - 1, -1, -1):
        both = f[:, k] * state
        prob[:, k] = both[:, 1] / both.sum(axis=1)
        x0, x1 = zero[:, k] * state[:, 0], one[:, k] * state[:, 1]
        if pairs:
            before = f[:, k - 1] if k else ahead
            joint = np.stack((before[:, 0] * t[0, 0] * x0, before[:, 0] * t[0, 1] * x1, before[:, 1] * t[1, 0] * x0, before[:, 1] * t[1, 1] * x1), axis=1)
            expected += _norm(joint)[valid[:, k]].sum(axis=0).reshape(2, 2)
        new = np.stack((t[0, 0] * x0 + t[0, 1] * x1, t[1, 0] * x0 + t[1, 1] * x1), axis=1)
        new = _norm(new)
        state = np.where(valid[:, k, None], new, state) if k in ragged else new
    p = prob[layout.row, layout.col]
    if pairs:
        log_z = log_scale + layout.n * float(transition.max()) + float(np.maximum(np.clip(emission, -30, 30), 0).sum())
        return p, expected, log_z
    return p


def fit(first: np.ndarray, features: np.ndarray, labels: np.ndarray, size: int, weights: np.ndarray, rounds: int = 40, rate: float = 0.25, decay: float = 0.02, start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Maximise the likelihood of ``labels``; gives (feature weights, transition).

    ``features`` has a row of feature numbers for each token, of which ``size``
    exist; number 0 is on for no token's own account but serves as the bias.
    ``weights`` says how much a sequence's tokens count; ``start`` is a result to go on from.
    """
    layout = Layout(first)
    seen = np.bincount(features.ravel(), minlength=size)
    w, transition = (x.copy() for x in start) if start else (np.zeros(size), np.array([[0.0, -3.0], [0.0, -1.0]]))
    m_w, v_w, m_t, v_t = np.zeros(size), np.zeros(size), np.zeros((2, 2)), np.zeros((2, 2))
    y = labels.astype(np.int64)
    before = np.concatenate(([0], y[:-1]))
    before[first[:-1][first[:-1] < len(y)]] = 0
    observed = np.zeros((2, 2))
    np.add.at(observed, (before, y), 1)
    for k in range(1, rounds + 1):
        p, expected, _ = marginals(layout, w[features].sum(axis=1) + w[0], transition, pairs=True)
        gap = (y - p) * weights
        g = np.zeros(size)
        for c in range(features.shape[1]):
            g += np.bincount(features[:, c], gap, minlength=size)
        g[0] = gap.sum()
        g = g / np.sqrt(np.maximum(seen, 1)) - decay * w
        h = (observed - expected) / np.sqrt(max(len(y), 1))
        h[0, 0] = 0
        for grad, m, v, x in ((g, m_w, v_w, w), (h, m_t, v_t, transition)):
            m *= 0.8
            m += 0.2 * grad
            v *= 0.95
            v += 0.05 * grad * grad
            x += rate * (m / (1 - 0.8**k)) / (np.sqrt(v / (1 - 0.95**k)) + 1e-3)
    return w, transition
