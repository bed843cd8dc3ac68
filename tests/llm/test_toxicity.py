"""Convolutional toxicity scores: layers against plain loops, held-out accuracy,
awkward rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftlog.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def some_model(seed=0):
    rng = np.random.default_rng(seed)
    words = rng.normal(size=(toxicity.BUCKETS + 1, toxicity.DIM)).astype(np.float32)
    words[-1] = 0
    filters = [rng.normal(size=(w, toxicity.DIM, 5)).astype(np.float32) for w in toxicity.WIDTHS]
    shifts = [rng.normal(size=5).astype(np.float32) for _ in filters]
    return toxicity.Model(words, filters, shifts, rng.normal(size=15).astype(np.float32), 0.5)


def plain(model, text):
    """Every window of every filter, one by one."""
    ids = toxicity._buckets(toxicity.word_hashes(text))
    x = [model.words[i].sum(0) for i in ids] + [np.zeros(toxicity.DIM)] * max(toxicity.WIDTHS)
    pooled = []
    for w, b in zip(model.filters, model.shifts):
        windows = [sum(x[p + j] @ w[j] for j in range(len(w))) for p in range(len(ids) + 1)]
        pooled += list(np.max(windows, 0) + b)
    return np.maximum(pooled, 0) @ model.out


TEXTS = ["", " \n", "one", "One, TWO two", "a b c d e f g", "Ärger über ß " * 9, "x" * 3000,
         "don't e.g. 1,2", "日本 語"]


def test_scores_are_the_plain_convolution(monkeypatch):
    model = some_model()
    want = [plain(model, t) for t in TEXTS]
    hashes = [toxicity.word_hashes(t) for t in TEXTS]
    assert np.allclose(model.raw(hashes), want, atol=1e-3)
    for piece in (1, 2, 3, 5):  # long texts in overlapping pieces
        monkeypatch.setattr(toxicity, "PIECE", piece)
        assert np.allclose(model.raw(hashes), want, atol=1e-3)


def test_a_score_depends_on_its_own_text_alone():
    model = some_model(1)
    hashes = [toxicity.word_hashes(t) for t in TEXTS]
    alone = [model.raw([h])[0] for h in hashes]
    assert np.allclose(model.raw(hashes[::-1])[::-1], alone, atol=1e-4)


def test_words_are_cut_and_hashed_as_stated():
    def of(t):
        return toxicity.word_hashes(t).tolist()
    assert of("Ab,cd  (EF)") == of("ab cd ef")
    assert len(of("a-b\tc")) == 3 and of("") == [] and of("...") == []
    long, other = of("abcdefgh abcdefzz")
    assert long[0] != other[0] and long[1] == other[1]  # same beginning


def labelled(n=400, seed=3):
    """Toxic: holds one of a few word pairs; each word alone is harmless."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 80))]
        toxic = i % 4 == 0
        at = rng.randrange(len(words))
        if toxic:
            words[at:at] = rng.choice([["vile", "toad"], ["rude", "oaf"]])
        else:
            words[at:at] = [rng.choice(["vile", "rude", "toad", "oaf"])]
        rows.append((i, " ".join(words), rng.choice(["en", "de", None]), int(toxic), "s"))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = labelled()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int, score string")
    return df, toxicity.train(df, df.select("doc_id", "toxic")), rows


def test_learns_windows_of_words(spark, trained):
    df, model, rows = trained
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    right = sum((got[r[0]] >= 0.3) == (r[3] == 1) for r in held)
    assert right >= 0.85 * len(held)
    assert all(0 <= s <= 1 for s in got.values())


def test_thresholds_by_language(spark, trained):
    df, model, _ = trained
    rows = [("en", 0.5), ("de", 0.5), ("xx", 0.5), (None, 0.5)]
    limits = toxicity.replace(model, thresholds={"en": 0.4, "de": 0.6}, threshold=0.55)
    scored = spark.createDataFrame(rows, "lang string, score double")
    got = {r["lang"]: r["f"] for r in scored.select("lang", toxicity.flagged(limits).alias("f")).collect()}
    assert got == {"en": True, "de": False, "xx": False, None: False}


def test_best_threshold_parts_the_labels():
    score = np.array([0.1, 0.2, 0.2, 0.7, 0.9])
    y = np.array([0, 0, 0, 1, 1])
    assert 0.2 < toxicity._best_threshold(score, y, np.ones(5)) <= 0.7


def test_labels_of_the_held_out_fold_are_never_seen(spark, trained):
    df, model, _ = trained
    turned = df.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic"))
                           .otherwise(F.col("toxic")))
    again = toxicity.train(turned, turned.select("doc_id", "toxic"))
    assert np.allclose(again.words, model.words, atol=1e-3) and np.isclose(again.base, model.base)


def test_awkward_rows(spark, trained):
    _, model, _ = trained
    rows = [(1, None, "en", "x"), (1, "", "en", "x"), (None, "vile toad", None, "y"),
            (2, "vile toad " * 40_000, "de", "z"), (2, "vile toad " * 40_000, "de", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = toxicity.score(df, model)
    assert got.columns == ["doc_id", "text", "lang", "score"]
    scores = [r["score"] for r in got.collect()]
    assert scores[0] == scores[1] and scores[3] == scores[4] and scores[2] > 0.3
    none = df.limit(0)
    assert toxicity.score(none, model).count() == 0
    empty = toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["score"] for r in toxicity.score(df, empty).collect()] == [0.5] * 5
    few = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, toxic int")
    assert toxicity.train(df, few).words is None


def test_the_sample_is_bounded_by_words(spark, trained):
    df, _, _ = trained
    assert toxicity.train(df, df.select("doc_id", "toxic"), sample_words=10).words is None
    assert toxicity.train(df, df.select("doc_id", "toxic"), sample_words=6000).words is not None


def test_query_on_held_out_rows(spark):
    """The registered query over sf0.1, against the labels it never saw."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    got = queries.QUERIES["op13_toxicity"](spark, SF).join(labels, "doc_id").where("held_out")
    rows = got.select("predicted", "toxic").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    wrong = sum(r["predicted"] and not r["toxic"] for r in rows)
    assert hit >= 0.7 * sum(r["toxic"] for r in rows)
    assert wrong <= 0.03 * len(rows)
