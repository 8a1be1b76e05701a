"""The pipeline's stages against plain restatements on a small corpus."""

import pytest

from kinegrain.llm import pii, toxicity

pipeline = pytest.importorskip("corpus_pipeline")

BENCH = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def write_tables(spark, path):
    rows = []
    for i in range(60):
        rows.append((i, f"clean text number {i} " + " ".join(f"word{i}x{j}" for j in range(30))))
    rows += [(100 + i, f"you vile toad {i} " + " ".join(f"term{i}x{j}" for j in range(12))) for i in range(16)]
    rows += [(200, rows[3][1]), (201, rows[4][1] + " more"), (202, "before " + BENCH + " after"), (203, None), (204, ""), (205, "write to bob@x.org today please")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(100 <= d < 200)) for d, _ in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, BENCH)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs


def test_stages(spark, tmp_path):
    path = f"file://{tmp_path}"
    docs = write_tables(spark, path)
    kept = {r.doc_id for r in docs.collect()}
    gone = [set(range(100, 116)), {200, 201}, {202}, set()]
    for (name, stage), lost in zip(pipeline.STAGES, gone):
        after = stage(spark, docs, path)
        assert after.columns == docs.columns, name
        after = spark.createDataFrame(after.collect(), docs.schema)
        kept -= lost
        assert {r.doc_id for r in after.collect()} == kept, name
        docs = after
    assert docs.where("doc_id = 205").first().text == "write to [EMAIL] today please"
    packed = pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {r.doc_id for r in packed} == kept
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, pipeline.run(spark, path).collect())) == sorted(map(key, packed))


def test_stages_on_empty_tables(spark, tmp_path):
    path = f"file://{tmp_path}"
    docs = write_tables(spark, path).limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert docs.count() == 0


def test_repeated_rows(spark, tmp_path):
    path = f"file://{tmp_path}"
    docs = write_tables(spark, path).where("doc_id < 3")
    doubled = docs.unionByName(docs).unionByName(spark.createDataFrame([(None, "no id here", "en", "s", 1)] * 2, docs.schema))
    left = pipeline.drop_near_copies(spark, doubled, path).collect()
    assert sorted((r.doc_id for r in left), key=str) == [0, 1, 2, None, None]
    assert toxicity.drop_toxic(doubled, toxicity.train([], __import__("numpy").zeros(0, int))).count() == 8
    assert pii.redact(doubled, pii.default_model()).count() == 8


def test_near_copies_link_at_five_words_and_80_percent(spark, tmp_path):
    """Appended passages: 80 of 98 and 80 of 103 shingles of 5 words in common, so 0.82 links and 0.78 does not."""
    path = f"file://{tmp_path}"
    docs = write_tables(spark, path).limit(0)
    text = lambda name, n: " ".join(f"{name}{j}" for j in range(n))
    rows = [(1, text("a", 84)), (2, text("a", 84) + " " + text("b", 18)), (3, text("c", 84)), (4, text("c", 84) + " " + text("d", 23))]
    more = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], docs.schema)
    assert sorted(r.doc_id for r in pipeline.drop_near_copies(spark, more, path).collect()) == [1, 3, 4]


def test_decisions_reach_rows_without_an_id(spark, tmp_path):
    path = f"file://{tmp_path}"
    docs = write_tables(spark, path).limit(0)
    text = lambda name, n: " ".join(f"{name}{j}" for j in range(n))
    rows = [(1, text("a", 84)), (None, text("a", 85)), (None, text("q", 40)), (None, text("q", 41)), (None, None), (None, ""), (None, "x " + BENCH), (6, "y " + BENCH), (6, text("r", 30))]
    more = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], docs.schema)
    key = lambda x: repr(tuple(x))
    near = pipeline.drop_near_copies(spark, more, path).collect()
    # The two texts around the passage share 8 of 10 shingles, so the one without an id goes.
    assert sorted(((r.doc_id, r.text) for r in near), key=key) == sorted([r for r in rows if r not in (rows[1], rows[6])], key=key)
    left = pipeline.drop_contaminated(spark, more, path).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=key) == sorted([r for r in rows if BENCH not in (r[1] or "")], key=key)


def test_pipeline_with_labels_of_one_class(spark, tmp_path):
    """All documents marked toxic, one of thousands of zeros before dots: nothing goes for toxicity, nothing breaks."""
    path = f"file://{tmp_path}"
    rows = [(i, f"plain text number {i} " + " ".join(f"k{i}x{j}" for j in range(9))) for i in range(6)] + [(7, "0" * 5000 + ".1.2.3 end"), (8, None), (9, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, 1, 1) for d, _ in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, BENCH)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    assert {r.doc_id for r in pipeline.run(spark, path).collect()} == {d for d, _ in rows}


def test_copies_send_their_columns_once(spark, sf_dir, monkeypatch):
    """Of many copies one document's n-grams move, and one document stays."""
    from kinegrain.llm import jaccard

    sent = []
    monkeypatch.setattr(jaccard, "_columns", lambda *a, whole=jaccard._columns: sent.append(whole(*a)) or sent[-1])
    text = " ".join(f"w{i}" for i in range(104))
    docs = spark.createDataFrame([(i, text) for i in range(40)] + [(50, None)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in pipeline.drop_near_copies(spark, docs, sf_dir).collect()) == [0, 50]
    assert sent[0].count() == jaccard.prefix_size(100, 80) == 21
