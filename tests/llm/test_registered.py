"""Registered queries over all of sf0.001 against brute force."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from shiftlog.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


def result(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_op2_ids_are_the_librarys(spark, texts):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                            special_tokens={})
    want = set()
    for doc, text in texts.items():
        ids = np.array(tik.encode_ordinary(text), "<u4")
        want.add((doc, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
                  hashlib.sha256(text.encode()).hexdigest()))
    assert {tuple(r) for r in result(spark, "op2_bpe_words")} == want


def test_op3_law_of_bytes(spark, texts):
    rows = result(spark, "op3_virtual_slots")
    assert {(r["doc_id"], r["size"], r["text_crc32"], r["law"]) for r in rows} == {
        (d, len(t.encode()) + 8, zlib.crc32(t.encode()), "bytes") for d, t in texts.items()}
    load, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(load) <= set(range(24)) and len(load) == 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(len(t.encode()) + 8 for t in texts.values())
    assert max(load.values()) - min(load.values()) <= largest


def test_op6_pieces_digests_and_places(spark, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for doc, text in texts.items():
        ids = [*tok.encode(text, add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.add((doc, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    rows = result(spark, "op6_best_fit_packing")
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        held.sort()
        ends = np.cumsum([0, *(n for _, n in held)])
        assert [o for o, _ in held] == ends[:-1].tolist() and ends[-1] <= 1024
    least = -(-sum(r["length"] for r in rows) // 1024)
    assert len(places) <= 1.02 * least + 1


def luhn(digits):
    own = [int(d) for d in digits][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(own)) % 10 == 0


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19
     and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15)]


def test_op7_base_spans(spark, texts):
    for r in result(spark, "op7_pii"):
        found = [(k, m.start(), m.end()) for k, pattern, fits in KINDS
                 for m in re.finditer(pattern, texts[r["doc_id"]]) if fits(m.group())]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        count = collections.Counter(k for k, _, _ in found)
        assert [r[f"n_{k}"] for k, _, _ in KINDS] == [count[k] for k, _, _ in KINDS]
        assert set(text.split(",")) - {""} <= set(r["spans"].split(","))


def test_op8_and_op13_folds_and_scores(spark, texts):
    for name, modulus, left in (("op8_quality", 5, 0), ("op13_toxicity", 4, 2)):
        rows = result(spark, name)
        assert sorted(r["doc_id"] for r in rows) == sorted(texts)
        for r in rows:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == left)
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_op9_neighbours_and_edited_texts(spark, texts):
    ids = sorted(texts)
    rows = {r["doc_id"]: r for r in result(spark, "op9_bottom_k")}
    assert sorted(rows) == ids
    prints = {}
    for i, doc in enumerate(ids):
        text, after = texts[doc], texts[ids[(i + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert rows[doc]["n_chars"] == len(text)
        assert rows[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, rows[doc]["fingerprint"]) == rows[doc]["fingerprint"]
        for near in ("near_edited", "near_next"):
            assert 0 <= rows[doc][near] <= 1
        if text == after:
            assert rows[doc]["near_next"] == 1


def test_op10_links(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"])
           for r in result(spark, "op10_ego_join")}
    name = next(c for c in rows[0].asDict() if isinstance(rows[0][c], list))
    links = collections.defaultdict(set)
    for a in rows:
        for b in rows:
            if a["vec_id"] < b["vec_id"] and a["label"] == b["label"] and a["label"] is not None:
                x, y = np.array(a[name], float), np.array(b[name], float)
                if x @ y >= 0.98 * np.sqrt((x @ x) * (y @ y)) > 0:
                    links[a["vec_id"]].add(b["vec_id"])
                    links[b["vec_id"]].add(a["vec_id"])
    for r in rows:
        seen, edge = {r["vec_id"]}, [r["vec_id"]]
        while edge:
            edge = [y for x in edge for y in links[x] if y not in seen and not seen.add(y)]
        first = min(seen)
        assert got[r["vec_id"]] == (len(links[r["vec_id"]]), first, first == r["vec_id"])
