"""Reading levels: held-out accuracy, trees, cleaning, edge cases."""

import numpy as np

from waymark.llm import boosting, reading

BIG = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    """Labels of every fifth labelled document are kept from the training."""
    docs, labels = (spark.read.parquet(f"{BIG}/{n}.parquet") for n in ("documents", "reading_labels"))
    found = {r.doc_id: r.reading_level for r in reading.score(docs, reading.train(docs, labels.filter("doc_id % 5 <> 0"))).collect()}
    hidden = [(r.doc_id, round(r.grade)) for r in reading.labels_of(labels.filter("doc_id % 5 = 0")).collect()]
    pairs = [(found[d], g) for d, g in hidden if d in found]
    assert len(pairs) > 80
    assert np.mean([a == b for a, b in pairs]) >= 0.8 and np.mean([abs(a - b) <= 1 for a, b in pairs]) >= 0.97
    eligible = docs.filter("coalesce(doc_kind, '') <> 'log' and n_chars >= 200").count()
    assert len(found) == eligible and set(found.values()) == {1, 2, 3, 4}


def test_boosting_fits():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 5))
    y = np.where(x[:, 0] > 0, 2.0, 0.0) + np.where(x[:, 1] * x[:, 0] > 0, 1.0, 0.0)
    model = boosting.fit(x[:600], y[:600], trees=80, depth=3, share=1.0)
    assert np.mean((model.predict(x[600:]) - y[600:]) ** 2) < 0.15
    flat = boosting.fit(np.ones((10, 2)), np.full(10, 3.0), trees=5)
    assert np.allclose(flat.predict(np.ones((3, 2))), 3.0)


def test_cut_points():
    levels = np.repeat([1.0, 2, 3, 4], 50)
    scores = levels + np.random.default_rng(1).normal(size=200) * 0.1
    cuts = boosting.cut_points(scores, levels)
    assert np.mean(np.searchsorted(cuts, scores, "right") + 1 == levels) > 0.97 and (np.diff(cuts) >= 0).all()


def test_cleaning():
    assert reading.clean("GroÃŸe H&auml;user <b>x</b>") == "große häuser x"
    assert reading.clean("a­b\r\nc\rd") == "ab\nc\nd"
    assert reading.clean('one <span class="' + "x" * 500 + '">two</span> a < b > c') == "one two a < b > c"


def test_clauses_and_openers():
    tokens = reading.Tokens()
    h, opens, doc, fixed = reading.read(["We saw the wall, which was old, because rain fell. It stood.", "plain words only"], tokens)
    words = ["we", "saw", "the", "wall", "which", "was", "old", "because", "rain", "fell", "it", "stood", "plain", "words", "only"]
    assert [w for w, o in zip(words, opens) if o] == ["which", "because"]
    at = reading.SPREAD + 3 + reading.SPREAD  # clause lengths come after those of words and sentences
    assert fixed[0, at] == 12 / 4 and fixed[1, at] == 3 and fixed[0, at + reading.SPREAD] == 2 and fixed[1, at + reading.SPREAD] == 1
    known, share = reading.openers(np.repeat(h, 10), np.repeat(opens, 10))
    rate = dict(zip(known.tolist(), share.tolist()))
    assert rate[int(h[4])] > 0.8 > 0.1 > rate[int(h[0])]


def test_features_do_not_depend_on_the_batch():
    texts = ["The cat sat. It ran, and hid!\nYes", "", "12 ... 34", "Ein Satz, der länger ist; noch einer.", "word " * 3000, "日本語 text. one two three four five words."]
    tokens = reading.Tokens()
    h, opens, doc, fixed = reading.read(texts, tokens)
    assert np.isfinite(fixed).all()
    for i, t in enumerate(texts):
        h1, o1, _, f1 = reading.read([t], tokens)
        assert np.array_equal(h[doc == i], h1) and np.array_equal(opens[doc == i], o1) and np.allclose(fixed[i], f1[0])


def test_edges(spark):
    kind = "doc_id bigint, text string, source string, doc_kind string, n_chars int, reading_level int"
    long_ = "The quick sensors measure the walls. " * 20
    docs = spark.createDataFrame([(1, long_, "s", "note", len(long_), 9), (2, long_, None, None, len(long_), 9), (3, long_, "s", "log", len(long_), 9), (4, None, "s", "note", None, 9), (5, "short", "s", "note", 5, 9), (6, "12 " * 100, None, "note", 300, 9), (7, long_ * 500, "s", "note", len(long_) * 500, 9)], kind)
    none = spark.createDataFrame([], "doc_id bigint, reader string, reading_level int, loaded_at timestamp_ntz")
    assert {(r.doc_id, r.reading_level) for r in reading.reading_levels(docs, none).collect()} == {(d, 2) for d in (1, 2, 6, 7)}
    few = spark.createDataFrame([(1, "a", 3), (1, "b", 3), (1, "b", 3), (2, "a", None), (3, "a", 7)], "doc_id bigint, reader string, reading_level int")
    got = {r.doc_id: r.reading_level for r in reading.reading_levels(docs, few).collect()}
    assert set(got) == {1, 2, 6, 7} and all(1 <= g <= 4 for g in got.values())
    assert reading.reading_levels(docs.limit(0), few).count() == 0


def test_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(reading, "MAX_TOTAL", 3000)
    text = "The quick sensors, which measure the walls, stand still. " * 10
    docs = spark.createDataFrame([(i, text, "ab"[i % 2], "note", len(text)) for i in range(40)], "doc_id bigint, text string, source string, doc_kind string, n_chars int")
    labels = spark.createDataFrame([(i, "r", 1 + i % 4) for i in range(40)], "doc_id bigint, reader string, reading_level int")
    assert len(reading.train(docs, labels).grades) == 3000 // len(text)


def test_folds_keep_every_source_whole():
    sources = ["a"] * 50 + ["b"] * 30 + ["c"] * 8 + ["d"] * 6 + ["e"] * 4 + ["f"] * 2
    folds = reading.Model._folds(sources)
    assert all(len({f for f, s in zip(folds, sources) if s == name}) == 1 for name in "abcdef")
    assert len(set(folds)) == 5 and len(set(reading.Model._folds(["a"] * 50))) == 5
