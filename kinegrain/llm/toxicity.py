"""Toxicity by a linear-chain conditional random field.

Labels mark documents, not words. Words and word beginnings that occur in toxic
training documents significantly more often than in others give the tokens of
toxic documents their first labels. A chain over the tokens is trained on them,
so a token is judged by its own forms, also ones that had no label, and by its
neighbours; then the chain's own marginals relabel the toxic documents, and it
is trained again. Forward-backward marginals give offending spans, and their
sums a document's score, calibrated on the training documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinegrain.llm import crf, scratch
from kinegrain.llm import textkernel as tk
from kinegrain.llm.sampling import stretches

#: Bound of the training sample: distinct texts, and characters of one. A longer
#: text trains by words from all of it, in stretches spread evenly (`stretches`).
SAMPLE_DOCS = 4000
SAMPLE_CHARS = 8_000
FEATURE_BITS = 18
#: Tokens of training texts that are calibrated at once.
SLICE_TOKENS = 200_000
#: Lengths in bytes of the word beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 6, 7, 8)
#: A form marks tokens when this many toxic texts have it, and this share of all of
#: them, when it is this many times as frequent among the words of toxic texts as
#: among others', and when twice the log likelihood ratio of the two rates is at
#: least this. A text adds a form at most so often, and of near copies one counts.
LEAST_DOCS = 2
LEAST_SUPPORT = 0.015
LEAST_RATIO = 6.0
LEAST_EVIDENCE = 15.0
MOST_PER_TEXT = 5
#: Words the chain is fitted on: all toxic texts of the sample, then others up to this bound.
FIT_WORDS = 400_000
#: Steps of the first fit, and after the toxic texts are relabelled by the marginals that reach the bound.
FIT_STEPS = (40, 12)
RELABEL_MARGINAL = 0.5
#: Minimum hashes of a toxic training text, the share of them that makes two texts near copies, and
#: the words a text must have to count as one: short texts are alike without being copies.
SKETCH, COPY_SHARE, COPY_WORDS = 64, 0.4, 20
THRESHOLD = 0.3
#: Marginals that count towards a document's sum.
LEAST_MARGINAL = 0.25


@dataclass
class Model:
    weights: np.ndarray  # float32, by feature number
    transition: np.ndarray
    calibration: np.ndarray  # of `document_features`
    evidence: bool = True  # False: no form is known to mark anything, and the score says nothing


def token_features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a batch: rows [a, b), lowered bytes, their offsets, word starts, ends, first words, features."""
    raw, offsets = tk.utf8_buffer(column)
    for a, b in tk.slices(offsets):
        part = tk.LOWER[raw[offsets[a]: offsets[b]]]
        starts, ends, first = tk.word_spans(part, offsets[a: b + 1] - offsets[a], tk.ALNUM_WORD)
        forms = [tk.span_hashes(part, starts, ends)]
        for k in BEGINNINGS:
            cut = np.minimum(starts + k, ends)
            forms.append(tk.mix(tk.span_hashes(part, starts, cut) + np.uint64(k)))
        features = np.stack([(f >> np.uint64(64 - FEATURE_BITS)).astype(np.int32) for f in forms], axis=1)
        # Number 0 is the bias; a form that hashes to it takes the last number instead.
        features[features == 0] = (1 << FEATURE_BITS) - 1
        yield a, b, part, offsets[a: b + 1] - offsets[a], starts, ends, first, features


def document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(1, log(1 + m), largest marginal, log(1 + 100 m / words)) of every document, m its sum of marginals.

    Marginals under ``LEAST_MARGINAL`` stay out of the sum, so that length alone
    does not make a text toxic.
    """
    total = np.concatenate(([0.0], np.cumsum(np.where(p >= LEAST_MARGINAL, p, 0))))
    mass = np.maximum(total[first[1:]] - total[first[:-1]], 0)
    size = np.maximum(np.diff(first), 1)
    top = np.zeros(len(first) - 1)
    filled = first[1:] > first[:-1]
    if filled.any():
        top[filled] = np.maximum.reduceat(p, first[:-1][filled])
    return np.stack((np.ones(len(top)), np.log1p(mass), top, np.log1p(100 * mass / size)), axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def marking_forms(features: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Feature numbers that toxic texts have significantly more often, as flags."""
    size = 1 << FEATURE_BITS
    counts, docs = np.zeros((2, size)), np.zeros(size, np.int64)
    for c in range(features.shape[1]):
        # Beginnings of different lengths never share a number but by chance, so columns add up.
        pair, n = np.unique(doc * size + features[:, c], return_counts=True)
        bad = toxic[pair // size].astype(bool)
        form = pair % size
        n = np.minimum(n, MOST_PER_TEXT)
        counts[1] += np.bincount(form[bad], n[bad], minlength=size)
        counts[0] += np.bincount(form[~bad], n[~bad], minlength=size)
        docs += np.bincount(form[bad], minlength=size)
    words = np.bincount(toxic[doc], minlength=2).astype(float)
    total = counts.sum(axis=0)
    rate = (counts + 0.5) / np.maximum(words, 1)[:, None]
    expected = total * (words / words.sum())[:, None]
    part = np.where(counts > 0, counts * np.log(np.maximum(counts, 1e-9) / np.maximum(expected, 1e-9)), 0)
    return (docs >= max(LEAST_DOCS, LEAST_SUPPORT * toxic.sum())) & (rate[1] >= LEAST_RATIO * rate[0]) & (2 * part.sum(axis=0) >= LEAST_EVIDENCE)


def originals(words: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Flags of texts, without toxic ones that are near copies of an earlier toxic one.

    Copies of one toxic text share all its rare words, which would make these
    look like words of toxic texts in general.
    """
    out = np.ones(len(toxic), bool)
    bad = np.flatnonzero(toxic)
    own = np.flatnonzero(toxic[doc].astype(bool))
    size = np.bincount(doc, minlength=len(toxic))[bad]
    own = own[size[np.searchsorted(bad, doc[own])] >= COPY_WORDS]
    seen = size >= COPY_WORDS
    first = np.searchsorted(doc[own], bad[seen])
    sketch = np.full((len(bad), SKETCH), np.arange(len(bad))[:, None] + (1 << 40), np.uint64)
    base = words[own].astype(np.uint64)
    for k in range(SKETCH):
        hashed = tk.mix(base + np.uint64((k + 1) * tk.BASE % (1 << 64))) >> np.uint64(24)
        if len(first):
            sketch[seen, k] = np.minimum.reduceat(hashed, first)
    for i in range(1, len(bad)):
        leaders = np.flatnonzero(out[bad[:i]])
        out[bad[i]] = not ((sketch[leaders] == sketch[i]).mean(axis=1) >= COPY_SHARE).any()
    return out


def train(texts: list[str], toxic: np.ndarray) -> Model:
    """Fit on distinct texts with 0/1 labels.

    Without both labels, or without any form that marks toxic texts, there is
    no evidence: every score is then the labels' smoothed share, and
    `drop_toxic` drops nothing.
    """
    size = 1 << FEATURE_BITS
    share = (toxic.sum() + 0.5) / (len(toxic) + 1.0) if len(toxic) else 0.0
    flat = Model(np.zeros(size, np.float32), np.array([[0.0, -3.0], [0.0, -1.0]]), np.array([np.log(share / (1 - share)) if share else -30.0, 0, 0, 0]), False)
    if not len(toxic) or toxic.all() or not toxic.any():
        return flat
    firsts, feats = [np.zeros(1, np.int64)], []
    for *_, first, features in token_features(pa.array(texts, pa.large_string())):
        feats.append(features)
        firsts.append(first[1:] + firsts[-1][-1])
    features, first = np.concatenate(feats), np.concatenate(firsts)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    if not len(doc):
        return flat
    bad = toxic[doc].astype(bool)
    single = originals(features[:, 0], doc, toxic)[doc]
    labels = marking_forms(features[single], doc[single], toxic)[features].any(axis=1) & bad
    if not labels.any():
        return flat
    sizes = np.diff(first)
    others = np.flatnonzero(toxic == 0)
    room = max(FIT_WORDS - int(sizes[toxic == 1].sum()), FIT_WORDS // 2)
    fitted = np.sort(np.concatenate((np.flatnonzero(toxic), others[np.cumsum(sizes[others]) <= room])))
    at = tk.ragged(first[:-1][fitted], sizes[fitted])
    part_first, part = np.concatenate(([0], np.cumsum(sizes[fitted]))), features[at]
    start = p = None
    for steps in FIT_STEPS:
        if p is not None:
            labels = bad & (p >= RELABEL_MARGINAL)
            if not labels.any():
                break
        start = weights, transition = crf.fit(part_first, part, labels[at], size, np.ones(len(at)), rounds=steps, start=start)
        # All texts of the sample are judged, a few at a time.
        p = np.concatenate([
            crf.marginals(crf.Layout(first[a: b + 1] - first[a]), weights[features[first[a]: first[b]]].sum(axis=1) + weights[0], transition)
            for a, b in tk.slices(first, SLICE_TOKENS)])
    calibration = logistic(document_features(p, first), toxic.astype(float))
    del features, doc, labels, feats, part, at, bad, p
    tk.trim()
    return Model(weights.astype(np.float32), transition, calibration)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def training_sample(docs: DataFrame, labels: DataFrame, held_out: int = 2, docs_bound: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``docs_bound`` labelled documents outside the held-out fold.

    The sample is the labels with the smallest hashes of their doc_id, so it
    spreads over all of them; ties are settled by doc_id and label. Of equal
    texts one counts; a text's label is the largest it has. Null labels, null
    ids and null texts do not train. A text of over ``SAMPLE_CHARS`` characters
    trains by `stretches` of it.
    """
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(fold(F.col("doc_id")) != held_out).select(
        F.col("doc_id").cast("bigint").alias("l_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("l_id"), "l_id", "toxic").limit(docs_bound)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    texts = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select(stretches(F.col("text"), SAMPLE_CHARS).alias("text"), "toxic", "l_id")
    texts = texts.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("l_id").alias("l_id"))
    rows = texts.orderBy(F.xxhash64("l_id"), "l_id", "text").limit(docs_bound).select("text", "toxic").toArrow()
    return rows.column(0).to_pylist(), (rows.column(1).to_numpy() > 0).astype(np.int64)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted and spans of every row.

    ``score`` is between 0 and 1. ``spans`` lists (start, end, p) in code
    points of tokens that are toxic with probability of at least one half. A
    null text is empty, and an empty text's score is the base rate that the
    calibration gives to no toxic token. Repeated rows stay; other columns are
    ignored.
    """
    scratch.bound_batches(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans, _ = score_texts(sent.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(spans, span)], names=["doc_id", "score", "spans"])
        tk.trim()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id bigint, score double, spans array<struct<start bigint, end bigint, p double>>")
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def score_texts(model: Model, column: pa.Array) -> tuple[np.ndarray, list[list[dict]], np.ndarray]:
    """Scores, offending spans and largest marginals of a batch of texts."""
    out, most = np.zeros(len(column)), np.zeros(len(column))
    spans: list[list[dict]] = [[] for _ in range(len(column))]
    for a, b, part, begins, starts, ends, first, features in token_features(column):
        emission = model.weights[features].sum(axis=1, dtype=np.float64) + model.weights[0]
        p = crf.marginals(crf.Layout(first), emission, model.transition)
        facts = document_features(p, first)
        most[a:b] = facts[:, 2]
        x = facts @ model.calibration
        out[a:b] = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        hit = np.flatnonzero(p >= 0.5)
        if len(hit):
            chars = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
            of = np.searchsorted(first, hit, side="right") - 1
            for i, d in zip(hit.tolist(), of.tolist()):
                base = chars[begins[d]]
                spans[a + d].append({"start": int(chars[starts[i]] - base), "end": int(chars[ends[i]] - base), "p": float(p[i])})
    return out, spans, most


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score stays under ``threshold``, as they are.

    A row goes on evidence only: one whose text is null, or has no word that is
    toxic with a marginal of at least ``LEAST_MARGINAL``, stays whatever the
    labels' share; with a model without evidence all rows stay.
    """
    if not model.evidence:
        return docs
    at = docs.columns.index("text")
    scratch.bound_batches(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, _, top = score_texts(sent.value, batch.column(at))
            yield batch.filter(pa.array((scores < threshold) | (top < LEAST_MARGINAL)))
        tk.trim()

    return docs.mapInArrow(run, docs.schema)
