"""Token shards and packing against the tokenizers library used directly."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinegrain.llm import packing, repair, scratch, tokenbin, tokenmemo
from kinegrain.llm import textkernel as tk
from kinegrain.llm.queries_tokens import vocabulary
from kinegrain.llm.tokenmemo import Encoder

TEXTS = [
    "", " ", "a  b", "a\n b", " x y ", "  z", "it's  x", "I'LL be 12345 \x00 q", "e ́x y", "<|endoftext|> a <|endoftext|>", "x \x00y\x00 z",
    "ß İ ﬁ   k", "tab\tsep \t x", "nbsp  x  y", "ends with space ", "word " * 3000, "the same the same the same", "\n\n\n", "x" * 5000]


def encode(enc, texts):
    ids, first = enc.encode(pa.array(texts, pa.string()), 7)
    assert (ids[first[1:] - 1] == 7).all()
    return [ids[a: b - 1].astype("<u4").tobytes() for a, b in zip(first[:-1], first[1:])]


def direct(tokenizer, text):
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_memo_equals_library(name, spaced):
    enc = Encoder(vocabulary(name), spaced)
    for _ in range(2):
        assert encode(enc, TEXTS) == [direct(enc.tokenizer, t) for t in TEXTS]


_memo = {}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'sé \n\t\x00 ́.1漢")), max_size=30), max_size=4), st.booleans())
def test_memo_equals_library_on_odd_texts(texts, spaced):
    enc = _memo.setdefault(spaced, Encoder(vocabulary("byte_bpe_50k.json" if spaced else "word_bpe_49k.json"), spaced))
    assert encode(enc, texts) == [direct(enc.tokenizer, t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=60), max_size=8))
def test_repair_round_trip(docs):
    ids = np.array([x for d in docs for x in d], np.uint32)
    first = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
    data = repair.write_shard(np.arange(len(docs)), np.zeros(len(docs), bool), ids, first)
    shard = repair.Shard(data)
    assert shard.ids().tolist() == ids.tolist()
    for k, d in enumerate(docs):
        assert shard.document(k).tolist() == d
        assert shard.slice(k, len(d) // 3, len(d)).tolist() == d[len(d) // 3:]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=200), max_size=8), st.sampled_from([2, 3, 12]))
def test_repair_leaves_no_frequent_pair(docs, least):
    ids = np.array([x for d in docs for x in d], np.uint32)
    first = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
    seq, begins, left, right, base = repair.build(ids, first, least)
    counts, before = {}, None
    for a, b in zip(begins[:-1], begins[1:]):
        before = None
        for pair in zip(seq[a:b][:-1].tolist(), seq[a:b][1:].tolist()):
            # Of pairs that overlap each other only every second one can be replaced.
            counts[pair] = counts.get(pair, 0) + (pair != before)
            before = pair if pair != before else None
    assert max(counts.values(), default=0) < least or max(counts.values()) < max(least // 2, 2)
    assert repair.expand(seq, left, right, base, repair.expansion_lengths(left, right, base)).tolist() == ids.tolist()


def test_repair_of_many_symbols(monkeypatch):
    """Ids too wide to sort pair and place in one word."""
    ids = np.tile(np.array([1 << 30, 5, (1 << 30) + 7, 5], np.uint32), 500)
    shard = repair.Shard(repair.write_shard(np.array([1]), np.array([False]), ids, np.array([0, len(ids)])))
    assert shard.ids().tolist() == ids.tolist() and len(shard.symbols) < 12


def thue_morse(bits):
    out = "a"
    for _ in range(bits):
        out += out.translate(str.maketrans("ab", "ba"))
    return out


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_words_that_sums_of_powers_confuse(name, spaced):
    word = thue_morse(12)
    texts = [word, word.translate(str.maketrans("ab", "ba")), word + " x", "x " + word[1:]]
    enc = Encoder(vocabulary(name), spaced)
    assert encode(enc, texts) == [direct(enc.tokenizer, t) for t in texts]


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_equal_hashes_do_not_mix_chunks_up(monkeypatch, name, spaced):
    real = tk.span_hashes
    monkeypatch.setattr(tk, "span_hashes", lambda *a: real(*a) & np.uint64(0x7))
    enc = Encoder(vocabulary(name), spaced)
    for _ in range(2):
        assert encode(enc, TEXTS) == [direct(enc.tokenizer, t) for t in TEXTS]


def test_table_starts_afresh(monkeypatch):
    monkeypatch.setattr(tokenmemo, "TABLE_BITS", 8)
    enc = Encoder(vocabulary("byte_bpe_50k.json"), True)
    texts = [" ".join(f"w{i * 37 + j}" for j in range(40)) for i in range(30)]
    for _ in range(2):
        for t in texts:
            assert encode(enc, [t]) == [direct(enc.tokenizer, t)]


def test_repair_compresses_and_detects_damage():
    ids = np.tile(np.array([7, 8, 9, 10], np.uint32), 2000)
    data = repair.write_shard(np.array([1]), np.array([False]), ids, np.array([0, len(ids)]))
    assert len(data) < ids.nbytes / 10
    with pytest.raises(ValueError):
        repair.Shard(data[:60] + b"\xff" + data[61:])


ROWS = [(5, "b b"), (1, None), (1, None), (None, "null id"), (3, ""), (2, "word " * 900), (2, "a"), (9, "last  one")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id bigint, text string, part string, n_tokens int")


def test_shards_read_back(spark):
    folder = scratch.new_path(spark, "t")
    manifest = tokenbin.write_token_shards(frame(spark, ROWS), folder, vocabulary("byte_bpe_50k.json"), 2, shard_tokens=50, partitions=3)
    got = sorted(tokenbin.read_token_shards(spark, folder, manifest).collect(), key=lambda r: r.start)
    tok = Encoder(vocabulary("byte_bpe_50k.json"), True).tokenizer
    want, start = [], 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = direct(tok, t or "") + b"\2\0\0\0"
        want.append((i, start, len(ids) // 4, ids))
        start += len(ids) // 4
    assert [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got] == want


def test_empty_table(spark):
    folder = scratch.new_path(spark, "t")
    empty = frame(spark, [])
    manifest = tokenbin.write_token_shards(empty, folder, vocabulary("byte_bpe_50k.json"), 2)
    assert manifest.count() == 0
    assert packing.pack(empty, vocabulary("word_bpe_49k.json"), 1).count() == 0


def test_piece_lengths():
    assert packing.piece_lengths(2048 * 2 + 5, 2048) == [2048, 2048, 4, 1]
    assert packing.piece_lengths(1, 2048) == [1]


def test_packing(spark):
    got = packing.pack(frame(spark, ROWS), vocabulary("word_bpe_49k.json"), 1, longest=256).collect()
    tok = Encoder(vocabulary("word_bpe_49k.json"), False).tokenizer
    assert len({r.sequence_id for r in got}) == len(got)
    by_size = [r.length for r in sorted(got, key=lambda r: r.sequence_id)]
    assert by_size == sorted(by_size, reverse=True)
    assert all(r.length & (r.length - 1) == 0 and r.offset == 0 and r.ids_crc32 == zlib.crc32(r.ids) for r in got)
    # All documents' pieces, in order, are the library's ids; equal (doc_id, size) rows here have equal ids.
    want = {}
    for i, t in ROWS:
        ids = direct(tok, t or "") + b"\1\0\0\0"
        want.setdefault((i, len(ids) // 4), []).append(ids)
    for (i, n), copies in want.items():
        pieces = sorted((r.start, r.length, bytes(r.ids)) for r in got if r.doc_id == i and r.doc_tokens == n)
        assert pieces == sorted(p for ids in copies for p in cut(ids, 256))
    assert sum(r.length for r in got) == sum(len(x) // 4 for c in want.values() for x in c)
    per_batch = {}
    for r in got:
        per_batch.setdefault(r.batch_id, []).append(r.length)
    assert all(len(set(x)) == 1 and sum(x) <= max(1 << 16, x[0]) for x in per_batch.values())


def cut(ids, longest):
    out, at = [], 0
    for n in packing.piece_lengths(len(ids) // 4, longest):
        out.append((at, n, ids[4 * at: 4 * (at + n)]))
        at += n
    return out


def test_other_column_types(spark):
    """Ids and texts of other types are cast; a binary text is its characters."""
    frame = spark.createDataFrame([(3, bytearray(b"a b")), (None, None)], "doc_id int, text binary")
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in packing.pack(frame, vocabulary("word_bpe_49k.json"), 1).collect())[0] == (0, 1)
    folder = scratch.new_path(spark, "t")
    manifest = tokenbin.write_token_shards(frame, folder, vocabulary("byte_bpe_50k.json"), 2)
    assert tokenbin.read_token_shards(spark, folder, manifest).count() == 2
