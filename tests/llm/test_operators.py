"""Every operator on awkward rows, against brute-force versions."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shiftlog.llm import (bpe, bpe_words, ego_join, fingerprints, jaccard_join, licenses, packing,
                          pii, quality, sharding, token_counts)

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, score double, tree string, spans string"


def words(rng, n):
    return " ".join(rng.choice(["the", "Reon", "éan", "ing,", "of", "tha"]) + str(rng.randrange(50))
                    for _ in range(n))


def awkward():
    """Nulls, empty, blank, very long, repeated and near-equal texts."""
    rng = random.Random(5)
    base = words(rng, 120).split(" ")
    near = list(base)
    near[60] = "other"
    texts = [None, "", " \n\t ", "one", "two words", "  lead\n \nand   gaps \n\n", "don't 'rx' 12ab",
             " ".join(base), " ".join(near), " ".join(base).upper(), words(rng, 30_000), "x" * 5000,
             " odd space \x1c ends", "日本語 テキスト", "mail a.b@c.example.com or +1 (017) 555-7713"]
    rows = [(i, t, 0.5, "t", "s") for i, t in enumerate(texts)]
    return rows + [(7, texts[7], 0.5, "t", "s"), (None, "null id", 0.5, "t", "s"),
                   (None, None, 0.5, "t", "s")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


def counted(rows):
    return collections.Counter(map(tuple, rows))


def test_runs_join_and_encode_alone(tik):
    for _, text, *_ in awkward():
        pieces = bpe.runs(text or "")
        assert "".join(pieces) == (text or "")
        assert [i for p in pieces for i in tik.encode_ordinary(p)] == tik.encode_ordinary(text or "")


def test_edits_count_like_a_new_encoding(spark, docs, empty, tik):
    trees = token_counts.build_trees(docs, RANKS, public_tokenizers.PATTERN)
    edits = F.expr("array(struct(cast(length(text) / 2 as int) as start, 3 as length, "
                   "'a  b' as insert), struct(0 as start, 1 as length, ' ' as insert), "
                   "struct(999999999 as start, 5 as length, 'end' as insert))")
    done = token_counts.apply_edits(trees.withColumn("edits", edits), RANKS,
                                    public_tokenizers.PATTERN)
    rows = done.select("text", "edited_text", token_counts.n_tokens("tree").alias("n"),
                       token_counts.n_tokens("edited_tree").alias("m")).collect()
    assert len(rows) == len(awkward())
    for r in rows:
        t = r["text"]
        half = len(t) // 2
        t = t[:half] + "a  b" + t[half + 3:]
        t = " " + t[1:] + "end"
        assert r["edited_text"] == t
        assert r["n"] == len(tik.encode_ordinary(r["text"]))
        assert r["m"] == len(tik.encode_ordinary(t))
    assert token_counts.build_trees(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_words_round_trip(docs, empty, tik):
    encoded = bpe_words.encode(docs, RANKS, public_tokenizers.PATTERN)
    got = counted((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"]))
                  for r in bpe_words.decode(encoded, RANKS).collect())
    want = counted((d, np.array(tik.encode_ordinary(t or ""), "<u4").tobytes(),
                    (t or "").encode()) for d, t, *_ in awkward())
    assert got == want
    at_once = bpe_words.encode(docs, RANKS, public_tokenizers.PATTERN, decoded=True)
    assert counted(map(tuple, at_once.collect())) == want
    assert counted(map(tuple, bpe_words.decode(at_once, RANKS).collect())) == want  # replaced
    assert bpe_words.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_shards_are_even_and_gapless(spark, docs, empty, tmp_path):
    rows = sharding.shard(docs.union(docs), 3, slots=64).collect()
    assert len(rows) == 2 * len(awkward())
    places = collections.defaultdict(list)
    for r in rows:
        places[r["shard"]].append(r["place"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharding.shard(empty, 3, slots=64).count() == 0
    even = {s: 100 + s % 7 for s in range(512)}
    moved = sharding.balance(even, 25, {s: s % 24 for s in range(512)})
    shards = {s: moved.get(s, s % 24) for s in range(512)}
    load = collections.Counter()
    for s, i in shards.items():
        load[i] += even[s]
    assert len(load) == 25 and max(load.values()) - min(load.values()) <= 210
    kept = sharding.SlotMap.create(spark, str(tmp_path / "map"), 4, 16)
    assert kept.rebalance({s: 5 for s in range(16)}, 5) == 1
    assert kept.read(0) == {s: s % 4 for s in range(16)} and set(kept.read().values()) == set(range(5))


def test_slots_are_a_function_of_the_rows(docs, monkeypatch):
    """The same slots however the rows are split, copies and null ids too."""
    many = docs.union(docs).union(docs)
    want = counted(sharding.records(many.coalesce(1)).collect())
    assert sum(want.values()) == 3 * len(awkward())
    assert counted(sharding.records(many.repartition(7)).collect()) == want
    monkeypatch.setattr(sharding, "CHUNK", 2)
    assert counted(sharding.records(many).collect()) == want


def sets_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


@pytest.mark.parametrize("n", range(7))
def test_short_texts_and_slices_of_few_words(n):
    """0 to 6 words alone, beside others and after a full slice of text."""
    from shiftlog.llm import shingles
    text = " ".join("abcdef"[:n])
    full = "w " * (shingles.SLICE // 2 + 5)
    for before in ([], ["x"], ["a b c d e f g"], [full], [""]):
        alone = shingles.shingle_sets([text])[0]
        assert len(alone) == (0 if n == 0 else max(1, n - 4))
        beside = shingles.shingle_sets([*before, text, "y z"])
        assert beside[len(before)].tolist() == alone.tolist()


def test_near_duplicates_of_short_texts_alone(spark):
    rows = [(1, "a b c"), (2, ""), (3, "A b C"), (4, None)]
    for some in (rows[:1], rows[:2], rows):
        got = jaccard_join.near_duplicates(spark.createDataFrame(some, "doc_id long, text string"))
        assert sorted(map(tuple, got.collect())) == [
            (i, int(bool(t)), 1 if t else i) for i, t in some]


def test_jaccard_components(spark, docs, empty):
    rng = random.Random(9)
    rows = [(d, t) for d, t, *_ in awkward() if d is not None]
    for k in range(12):
        base = words(rng, rng.choice([6, 20, 100])).split(" ")
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = "new%d" % rng.randrange(30)
            rows.append((100 + len(rows), " ".join(copy)))
    sets = {d: sets_of(t) for d, t in rows}
    root = {d: d for d in sets}
    for _ in rows:
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[d]] == root[d] for d in root):
            break
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert counted(got.collect()) == counted((d, len(sets[d]), root[d]) for d, _ in rows)
    assert jaccard_join.near_duplicates(empty).count() == 0
    assert jaccard_join.near_duplicates(docs).count() == len(awkward())


def test_tree_search_keeps_every_possible_link():
    rng = np.random.default_rng(3)
    points = rng.poisson(3, (200, jaccard_join.GROUPS))
    points[100:] = np.maximum(points[:100] - (rng.random((100, jaccard_join.GROUPS)) < 0.02), 0)
    sizes = points.sum(1)
    a, b = jaccard_join.RTree(points, sizes).search(points, sizes)
    bound = np.minimum(points[:, None], points[None]).sum(2)
    want = 180 * bound >= 80 * (sizes[:, None] + sizes[None])
    assert set(zip(a.tolist(), b.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(want))))


def test_a_group_of_near_copies_needs_few_checks(spark, monkeypatch):
    """300 texts that almost all link, in 300 components: some checks for each,
    not all 44850 pairs.  Of two far groups no pair is lost or made."""
    rng = np.random.default_rng(5)
    sets = [np.sort(np.concatenate([np.arange(100 * g, 100 * g + 95), 1000 + 5 * d + np.arange(5)]))
            .astype(np.uint64) for d, g in enumerate(rng.integers(0, 2, 300).tolist())]
    points = [zstandard.compress(jaccard_join.point_of(s).astype("<u2").tobytes()) for s in sets]
    reps = spark.createDataFrame([(d, bytearray(p)) for d, p in enumerate(points)], "id long, point binary")
    entries = spark.createDataFrame([(k, d, 100, d, 300) for d in range(300) for k in (1, 2)],
                                    "key long, id long, n int, component long, k long")
    asked = []

    def verify(pairs, _):
        rows = [tuple(p) for p in pairs.collect()]
        asked.extend(rows)
        links = [(a, b) for a, b in rows if jaccard_join.linked(sets[a], sets[b])]
        return spark.createDataFrame(links, "a long, b long")

    monkeypatch.setattr(jaccard_join, "verify", verify)
    whole = {r["node"]: r["component"] for r in jaccard_join._tree_links(entries, reps, None).collect()}
    group = [int(s[0]) for s in sets]
    assert whole == {d: group.index(g) for d, g in enumerate(group)}
    assert len(asked) < 10 * 300


def test_a_component_whose_strongest_pairs_fail_goes_on(spark, monkeypatch):
    """Only the weakest of a component's pairs is a link."""
    size = jaccard_join.GROUPS
    rows = {0: np.ones(size)} | {d: np.ones(size) for d in range(1, 40)}
    rows[39] = np.where(np.arange(size) < 10, 0, 1)
    reps = spark.createDataFrame([(d, bytearray(zstandard.compress(p.astype("<u2").tobytes())))
                                  for d, p in rows.items()], "id long, point binary")
    entries = spark.createDataFrame([(7, d, int(p.sum()), d, 40) for d, p in rows.items()],
                                    "key long, id long, n int, component long, k long")
    monkeypatch.setattr(jaccard_join, "verify",
                        lambda pairs, _: pairs.where("a = 3 AND b = 39"))
    got = jaccard_join._tree_links(entries, reps, None).collect()
    assert sorted(map(tuple, got)) == [(3, 3), (39, 3)]


def test_a_pair_is_left_to_its_lowest_common_key(spark):
    rng = np.random.default_rng(11)
    keys = {d: sorted(int(k) for k in rng.choice(60, rng.integers(1, 50), replace=False) - 30)
            for d in range(80)}
    lowest = [own[:jaccard_join.CARRIED] for own in keys.values()]
    point = zstandard.compress(np.ones(jaccard_join.GROUPS, "<u2").tobytes())
    rows = [(k, min(d % 2, other), max(d % 2, other), d, d // 2, jaccard_join.GROUPS, point, d % 2,
             lowest[d]) for d, own in keys.items() for k in own for other in (0, 1)]
    groups = spark.createDataFrame(rows, "key long, i int, j int, id long, component long, n int, "
                                         "point binary, part int, lowest array<long>")
    want = {(a, b) for a in keys for b in keys
            if a < b and a // 2 != b // 2 and set(keys[a]) & set(keys[b])}
    assert set(map(tuple, jaccard_join.tree_pairs(groups).collect())) == want
    a, b = (x.ravel() for x in np.indices((80, 80)))
    for key in (-30, 0, 29):
        met = jaccard_join._met_before(key, lowest, a, b)
        assert met.tolist() == [any(k < key for k in set(lowest[x]) & set(lowest[y]))
                                for x, y in zip(a, b)]


def test_licenses(spark, docs, empty):
    texts = ["Released under the MIT License.", "x. Licensed under the Apache License, Version 2.0.\ny",
             "This program is free software; either version 3 of the License, or (at your option) "
             "any later version.", None, ""]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [(r["licenses"], r["kind"]) for r in got.orderBy("doc_id").collect()] == [
        (["MIT"], "permissive"), (["Apache-2.0"], "permissive"), (["GPL-3.0-or-later"], "copyleft"),
        ([], "none"), ([], "none")]
    assert licenses.scan(docs).count() == len(awkward()) and licenses.scan(empty).count() == 0


GNU = """This {0} is free software{1} you can redistribute it and/or modify
it under the terms of the GNU {2} as published by
the Free Software Foundation{3} either version {4} of the License, or
(at your option) any later version."""
BSD = """Copyright (c) 2020, A. Nother
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
NOTICES = [
    ("Apache-2.0", "permissive", """Copyright 2020 A. Nother

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("MIT", "permissive", """Copyright (c) 2020 A. Nother

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""),
    ("BSD-2-Clause", "permissive", BSD.format("")),
    ("BSD-3-Clause", "permissive", BSD.format("""
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
""")),
    ("ISC", "permissive", """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"""),
    ("GPL-3.0-or-later", "copyleft", GNU.format("program", ":", "General Public License", ",", 3)),
    ("GPL-2.0-or-later", "copyleft", GNU.format("program", ";", "General Public License", ";", 2)),
    ("LGPL-2.1-or-later", "copyleft",
     GNU.format("library", ";", "Lesser General Public License", ";", "2.1")),
    ("AGPL-3.0-or-later", "copyleft",
     GNU.format("program", ":", "Affero General Public License", ",", 3)),
    ("MPL-2.0", "copyleft", """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("Unlicense", "permissive",
     "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-SA-4.0", "non-commercial", """This work is licensed under a Creative Commons
Attribution-NonCommercial-ShareAlike 4.0 International License."""),
    ("CC-BY-ND-4.0", "no-derivatives", """This work is licensed under a Creative Commons
Attribution-NoDerivatives 4.0 International License."""),
    ("CC-BY-4.0", "permissive",
     "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("MIT", "permissive", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0,MIT", "permissive", "SPDX-License-Identifier: (MIT OR Apache-2.0)"),
    ("GPL-2.0-or-later", "copyleft", "SPDX-License-Identifier: GPL-2.0+"),
    ("GPL-2.0", "copyleft", "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0"),
]


def test_licenses_of_standard_notices(spark):
    ways = [lambda t: t, lambda t: " ".join(t.split()), lambda t: t.replace("\n", "\r\n"),
            lambda t: "".join(f" * {x}\n" for x in t.split("\n")),
            lambda t: "".join(f"# {x}\n" for x in t.split("\n")) + "import os\n",
            lambda t: "prose before.\n" + re.sub(r"\s+", "\n", t) + "\n\nprose after"]
    rows = [(i * 10 + k, way(t)) for i, (_, _, t) in enumerate(NOTICES) for k, way in enumerate(ways)
            if not (k == 5 and "SPDX" in t)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (",".join(r["licenses"]), r["kind"]) for r in got} == {
        d: NOTICES[d // 10][:2] for d, _ in rows}


def test_packing_matches_best_fit_decreasing(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(docs, path, capacity=64).collect()
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    want = counted(tuple(tok.encode(t or "", add_special_tokens=False).ids) + (2,)
                   for _, t, *_ in awkward() if len(t or "") < 60)
    assert counted(tuple(r["input_ids"]) for r in rows
                   if r["piece"] == 0 and r["length"] < 64) >= want
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        held.sort()
        ends = [0, *(o + n for o, n in held)]
        assert [o for o, _ in held] == ends[:-1] and ends[-1] <= 64
    room = []
    for n in sorted((r["length"] for r in rows), reverse=True):
        fit = [x for x in room if x >= n]
        at = min(fit) if fit else 64
        if fit:
            room.remove(at)
        room.append(at - n)
    assert len(places) == len(room)
    assert packing.pack(empty, path).count() == 0


def test_added_tokens_keep_their_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> \n", "x  <|endoftext|>",
             "a <|endoftext| > b", "  \n<|endoftext|>  y", "<<|endoftext|>|>don't"]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
                        path).collect()
    assert {r["doc_id"]: r["input_ids"] for r in rows} == {
        d: tok.encode(t, add_special_tokens=False).ids + [2] for d, t in enumerate(texts)}


@pytest.fixture(scope="module")
def pii_model(docs):
    return pii.train(docs)


def test_personal_data(docs, empty, pii_model):
    text = "A 4111 1111 1111 1111 b 1.2.3.4.5.6.7.8 c a@b.co@d.ef +1 (017) 555-7713, 999.1.1.1"
    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")]
    got = pii.base_spans(text)
    assert [s for s in got if s[0] == "email"] == [("email", m.start(), m.end()) for m in
                                                   re.finditer(rules[0][1], text)]
    assert [text[a:b] for k, a, b in got if k == "ip"] == ["1.2.3.4", "5.6.7.8"]
    assert [text[a:b] for k, a, b in got if k == "card"] == ["4111 1111 1111 1111"]
    assert [text[a:b] for k, a, b in got if k == "phone"] == ["+1 (017) 555-7713"]
    found = pii.detect(docs, pii_model, "found")
    rows = {r["doc_id"]: r["text"] for r in pii.redact(found, "found").collect()}
    assert rows[14] == "mail <email> or <phone>" and rows[1] == ""
    assert pii.spans_of([words(random.Random(1), 500)], pii_model) == [[]]
    assert pii.detect(empty, pii_model).count() == 0


def test_secrets_of_any_length(pii_model):
    rng = random.Random(4)
    for alphabet, n in (("0123456789abcdef", 64), ("0123456789abcdef", 128),
                        ("abcdefghkmnpqrstuvwxyzABCDEFGHKLMNPQRSTUVWXYZ23456789", 300),
                        ("abcdefghkmnpqrstuvwxyzABCDEFGHKLMNPQRSTUVWXYZ", 60)):
        value = "".join(rng.choice(alphabet) for _ in range(n))
        text = f"the token: {value} of the"
        assert ("secret", 11, 11 + n) in pii.candidates(text)
        assert [s[:3] for s in pii.spans_of([text], pii_model)[0]] == [("secret", 11, 11 + n)]
    assert pii.candidates("x" * 200_000) == [("secret", 0, 200_000)]


def test_quality(spark, docs, empty):
    rng = random.Random(2)
    rows = [(i, words(rng, 60) if i % 3 else " | ".join(words(rng, 60).split()), int(i % 3 > 0))
            for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(table, table.select("doc_id", "quality"))
    got = (quality.score(table, model).where(quality.held_out())
           .select(((F.col("score") >= 0.3).cast("int") == F.col("quality")).cast("int").alias("ok")))
    assert got.agg(F.avg("ok")).first()[0] > 0.95
    scored = quality.score(docs, model).collect()
    assert len(scored) == len(awkward()) and all(0 <= r["score"] <= 1 for r in scored)
    none = quality.train(empty, table.select("doc_id", "quality"))
    assert quality.score(empty, none).count() == 0
    assert [zlib.crc32(b"%d" % i) % 5 == 0 for i in range(50)] == [
        r[0] for r in spark.range(50).select(quality.held_out("id")).collect()]


def test_quality_learns_from_whole_texts(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, 900) + (" signed by a careful author" if i % 2 else " ... more below"),
             i % 2) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(table, table.select("doc_id", "quality"))
    sizes = [len(t.encode()) for _, t, _ in rows]
    assert min(sizes) > 4500 and min(sizes) < np.exp(model.mean[3]) < max(sizes)
    assert b"careful author" in model.good and b"careful author" not in model.bad
    whole = "".join(chr(33 + i % 90) * 512 for i in range(50))
    blocks = quality.spread_blocks(whole)
    assert len(blocks) == quality.TEXT_BLOCKS
    assert (blocks[0].decode(), blocks[-1].decode()) == (whole[:512], whole[-512:])
    assert b"".join(quality.spread_blocks(whole[:1300])) == whole[:1300].encode()
    assert quality._dictionary([b"same"] * 100_000)
    assert quality.spread_blocks("") == []


def test_fingerprints(spark, empty):
    rows = [(d, t) for d, t, *_ in awkward()[:15]]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.edited_neighbours(table, 32).select(
        "*", fingerprints.resemblance(F.col("sketch"), F.col("next_sketch"), 32).alias("j"),
        fingerprints.distinct_shingles(F.col("sketch"), 32).alias("n")).collect()}
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        assert got[d]["edited"] == t[:len(t) - half] + after[:half]
        assert got[d]["sketch"] == sorted(got[d]["sketch"]) and len(got[d]["sketch"]) <= 32
        if len(got[d]["sketch"]) < 32:
            assert got[d]["n"] == len(got[d]["sketch"])
    assert got[7]["j"] > 0.6 and got[7]["sketch"] == got[9]["sketch"]
    parts = fingerprints.merge_groups(spark.createDataFrame(
        [("a", [1, 3, 5]), ("a", [2, 3]), ("b", [])], "k string, sketch array<long>"), "k", k=3)
    assert {r["k"]: r["sketch"] for r in parts.collect()} == {"a": [1, 2, 3]}
    assert fingerprints.edited_neighbours(empty).count() == 0
    lone = fingerprints.edited_neighbours(table.where("doc_id = 4")).first()
    assert hashlib.sha256(lone["edited"].encode()) and lone["edited"] == "two wtwo "


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 16))
    rows = [(i, (base[i % 6] + rng.normal(size=16) * 0.08).tolist(), i % 2) for i in range(120)]
    rows += [(200, rows[3][1], rows[3][2]), (201, None, 1), (202, [0.0] * 16, 1), (203, rows[3][1], None),
             (204, [float("nan")] * 16, 0), (205, [None] * 16, 0), (206, [1.0], 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in
           ego_join.near_duplicates(spark.createDataFrame(
               rows, "vec_id long, embedding array<double>, label int")).collect()}
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v, label in rows if i <= 200}
    label = {i: lab for i, _, lab in rows}
    near = {a: [b for b in ok if b != a and label[a] == label[b] and ok[a] @ ok[b] >= 0.98] for a in ok}
    for a in ok:
        seen, todo = {a}, [a]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        assert got[a] == (len(near[a]), min(seen), min(seen) == a)
    assert all(got[i] == (0, i, True) for i in range(201, 207))
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert ego_join.near_duplicates(none).count() == 0
