"""Stages of the pipeline against brute force, and on awkward rows."""

import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from shiftlog.llm import pii, quality, stages
from shiftlog.llm.common import table

SF = "/root/testdata/sf0.001"
AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text):
    w = words_of(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def test_filter_quality_keeps_by_its_score(spark, docs):
    model = quality.train(docs, table(spark, SF, "labels"))
    score = model.scorer()
    want = [r for r in docs.collect() if score(r["text"] or "") >= quality.THRESHOLD]
    got = stages.filter_quality(spark, docs, SF)
    assert got.columns == docs.columns
    assert rows(got) == sorted(map(tuple, want), key=repr)


def test_drop_near_duplicates_keeps_one_of_each_component(spark, docs):
    held = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    ids = sorted(held)
    component = {i: i for i in ids}

    def root(i):
        while component[i] != i:
            i = component[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = held[a], held[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                component[q] = p
    got = stages.drop_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [i for i in ids if root(i) == i]


def test_redact_replaces_the_spans(spark, docs):
    model = pii.train(docs)
    want = {}
    for r in docs.collect():
        spans = sorted(((a, -b, k) for k, a, b, *_ in pii.spans_of([r["text"] or ""], model)[0]))
        text, at, out = r["text"] or "", 0, []
        for a, b, kind in spans:
            if a >= at:
                out.append(text[at:a] + f"<{kind}>")
            at = max(at, -b)
        want[r["doc_id"]] = "".join(out) + text[at:] if spans else r["text"]
    got = {r["doc_id"]: r for r in stages.redact_personal_data(spark, docs, SF).collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for i, r in got.items() if "<email>" in (r["text"] or ""))


def test_pack_keeps_every_id(spark, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in stages.pack_sequences(spark, docs, SF).collect():
        assert r["length"] == len(r["input_ids"]) <= 1024
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["input_ids"]))
    for r in docs.collect():
        own = [i for _, ids in sorted(pieces[r["doc_id"]]) for i in ids]
        assert own == [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]


def test_stages_follow_one_another(spark):
    """The pipeline's rows are those of its stages applied in turn."""
    now = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        now = spark.createDataFrame(stage(spark, now, SF).collect() or [], stage(spark, now, SF).schema)
    got = corpus_pipeline.run(spark, SF)

    def sizes(df):
        return sorted((r["doc_id"], r["piece"], r["length"]) for r in df.collect())
    assert sizes(got) == sizes(now)


def test_awkward_rows(spark):
    text = "mail a.b@c.example.com now " + "word " * 300
    some = [(1, None, "en", "s", None, 0.5, "x"), (2, "", "en", "s", 0, None, "x"),
            (3, "a b", "de", "s", 3, 0.1, "x"), (3, "a b", "de", "s", 3, 0.1, "x"),
            (None, text, "en", "s", len(text), 0.2, "x"), (None, text, "en", "s", len(text), 0.2, "x"),
            (5, text, "en", None, len(text), 0.2, "x"), (6, "z " * 200_000, "en", "s", 400_000, 0.0, "x")]
    df = spark.createDataFrame(some, AWKWARD)
    none = df.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        assert out.count() >= 1
        if name != "pack_sequences":
            assert out.columns == df.columns
        assert stage(spark, none, SF).count() == 0
    kept = stages.drop_near_duplicates(spark, df, SF).collect()
    assert [r["doc_id"] for r in kept if r["text"] == "a b"] == [3]
    assert len([r for r in kept if r["text"] == text]) == 1
