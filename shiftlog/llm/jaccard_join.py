"""Exact n-gram Jaccard join with a count-vector R-tree.

Shingles are hashed into groups and a document's group counts are a point;
the sum of coordinate minima bounds the overlap of two documents, and, with
the upper corners of their boxes, of two nodes of an R-tree.  Pairs that
survive the bound are verified on the whole sets.

One tree over all documents would compare almost everything: in so many
dimensions boxes overlap.  The root therefore splits on the rarest groups of
a very fine hashing (about one shingle each): two sets with Jaccard 0.8 or
more share one of the first n - ceil(0.8 n) + 1 groups of either in any
common order, here from rare to frequent.  A group that only one set has
cannot be shared, so a document with enough of those leaves at once.  Below
the root each group's documents are joined by an R-tree.

Copies are one class.  Only components are asked for, so pairs whose ends are
already connected need no check: a first round verifies each class against
one other class of its groups, the R-trees then propose what may still join
two components, the likeliest pairs of each component first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlog.llm.common import (batch_of, pack_numbers, rows_of, squeeze, stored, text_of,
                                 unpack_numbers)
from shiftlog.llm.components import merged
from shiftlog.llm.shingles import shingle_sets

#: Link: PERCENT of the union or more is common.
PERCENT = 80
#: Coordinates of a point.  Shingles that only one set has are left out: they
#: add nothing to an overlap.
GROUPS = 256
#: Characters of text in a block and bytes of text per bucket of fine groups.
BLOCK_CHARS = 5_000_000
BUCKET_BYTES = 12_000_000
#: Points in a node of the tree, and in one part of a large group.
NODE = 32
PART = 2048
#: Lowest keys of a class that its rows carry, to tell whether a pair has
#: already met under a lower key.
CARRIED = 32

_CELLS = "bucket long, block string, gaps binary, counts binary"
_TEXTS = "block string, doc_ids array<long>, sizes array<int>, texts binary"
_SETS = ("class string, n int, members array<long>, keys array<long>, point binary, text binary")
_CELLS_ARROW = pa.schema([("bucket", pa.int64()), ("block", pa.string()), ("gaps", pa.binary()),
                          ("counts", pa.binary())])
_TEXTS_ARROW = pa.schema([("block", pa.string()), ("doc_ids", pa.list_(pa.int64())),
                          ("sizes", pa.list_(pa.int32())), ("texts", pa.binary())])
_SETS_ARROW = pa.schema([("class", pa.string()), ("n", pa.int32()),
                         ("members", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())),
                         ("point", pa.binary()), ("text", pa.binary())])


def least_common(n):
    """Smallest overlap that a set of n shingles has with any it links with."""
    return (PERCENT * n + 99) // 100


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def point_of(hashes: np.ndarray) -> np.ndarray:
    return np.bincount((hashes % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)


class _Classes:
    """Distinct sets of a block of texts, with the documents of each."""

    def __init__(self, doc_ids: list, texts: list[str]):
        self.sets, self.texts, self.members, self.empty, at = [], [], [], [], {}
        for doc, text, hashes in zip(doc_ids, texts, shingle_sets(texts)):
            if not len(hashes):
                self.empty.append(doc)
                continue
            name = hashlib.blake2b(hashes.tobytes(), digest_size=16).hexdigest()
            if name not in at:
                at[name] = len(self.sets)
                self.sets.append(hashes)
                self.texts.append(text)
                self.members.append([])
            self.members[at[name]].append(doc)
        self.names = list(at)

    def cells(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Fine groups that the sets reach, and how many sets reach each."""
        shift = np.uint64(64 - bits)
        own = [_distinct(s >> shift) for s in self.sets]
        return np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]), return_counts=True)


def _distinct(ascending: np.ndarray) -> np.ndarray:
    keep = np.ones(len(ascending), bool)
    keep[1:] = ascending[1:] != ascending[:-1]
    return ascending[keep]


def _in_blocks(docs: DataFrame, kind: str, rows) -> DataFrame:
    """``rows(name, doc_ids, texts)`` of each block of documents in a task; a
    block's name is a digest of its texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, chars = [], [], 0

        def emit():
            digest = hashlib.blake2b(digest_size=12)
            for t in texts:
                data = t.encode()
                digest.update(b"%d " % len(data))
                digest.update(data)
            return rows(digest.hexdigest(), ids, texts)

        for batch in batches:
            for doc, text in zip(*rows_of(batch, "doc_id", "text")):
                ids.append(doc)
                texts.append(text)
                chars += len(text)
                if chars >= BLOCK_CHARS:
                    yield emit()
                    ids, texts, chars = [], [], 0
        if ids:
            yield emit()

    return docs.mapInArrow(run, kind)


def prefix_sets(docs: DataFrame) -> DataFrame:
    """Per block and distinct set: class, n, members, the fine groups in which
    partners must meet (keys), point and, where there are keys, the text."""
    texts = docs.select("doc_id", text_of().alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // BUCKET_BYTES))
    # fine groups: 64 times as many as there can be shingles
    bits = min(52, max(16, int(size).bit_length() - 2 + 6))

    def cell_rows(name: str, ids: list, texts_: list[str]) -> pa.RecordBatch:
        cells, counts = _Classes(ids, texts_).cells(bits)
        bounds = np.arange(buckets + 1, dtype=object) * (1 << bits) // buckets
        cuts = np.searchsorted(cells, bounds.astype(np.uint64))
        rows = []
        for b in np.flatnonzero(np.diff(cuts)):
            own = cells[cuts[b]:cuts[b + 1]]
            gaps = np.diff(own, prepend=np.uint64(bounds[b]))
            rows.append((int(b), name, squeeze(gaps.astype("<u8").view(np.uint8)
                                               .reshape(-1, 8).T.tobytes()),
                         pack_numbers(counts[cuts[b]:cuts[b + 1]])))
        return batch_of(rows, _CELLS_ARROW)

    def text_rows(name: str, ids: list, texts_: list[str]) -> pa.RecordBatch:
        coded = [t.encode() for t in texts_]
        return batch_of([(name, ids, [len(c) for c in coded], squeeze(b"".join(coded)))],
                        _TEXTS_ARROW)

    def rarity(group: pa.Table) -> pa.Table:
        """Over all blocks, how many sets reach each fine group of a bucket:
        0 for one, else by quarters of powers of two."""
        start = np.uint64(group["bucket"][0].as_py() * (1 << bits) // buckets)
        names, gaps, counts = rows_of(group, "block", "gaps", "counts")
        cells = []
        for g in gaps:
            raw = np.frombuffer(zstandard.decompress(g), np.uint8)
            own = np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()
            cells.append(start + own.cumsum(dtype=np.uint64))
        ends = np.cumsum([len(c) for c in cells])
        _, at = np.unique(np.concatenate(cells), return_inverse=True)
        total = np.bincount(at, np.concatenate([unpack_numbers(c) for c in counts]))
        level = np.where(total <= 1, 0, 1 + np.floor(4 * np.log2(np.maximum(total, 1))))
        parts = np.split(level.astype(np.uint8)[at], ends[:-1])
        return pa.Table.from_batches([batch_of(
            [(b, n, None, squeeze(p.tobytes())) for b, n, p in
             zip(group["bucket"].to_pylist(), names, parts)], _CELLS_ARROW)])

    def assemble(blocks: pa.Table, levels: pa.Table) -> pa.Table:
        known = dict(zip(*rows_of(levels, "bucket", "counts")))
        level = np.frombuffer(b"".join(zstandard.decompress(known[b]) for b in sorted(known)),
                              np.uint8)
        rows = []
        for ids, sizes, data in zip(*rows_of(blocks, "doc_ids", "sizes", "texts")):
            raw, ends = zstandard.decompress(data), np.cumsum([0, *sizes])
            own = _Classes(ids, [raw[a:b].decode() for a, b in zip(ends, ends[1:])])
            cells, _ = own.cells(bits)
            if len(cells) != len(level):
                raise RuntimeError("the passes over the documents cut different blocks")
            for name, hashes, text, members in zip(own.names, own.sets, own.texts, own.members):
                rank = level[np.searchsorted(cells, hashes >> np.uint64(64 - bits))]
                first = np.lexsort((hashes, rank))[:len(hashes) - least_common(len(hashes)) + 1]
                keys = hashes[first[rank[first] > 0]].view(np.int64).tolist()
                rows.append((name, len(hashes), members, keys,
                             squeeze(point_of(hashes[rank > 0]).astype("<u2").tobytes())
                             if keys else None, squeeze(text.encode()) if keys else None))
            if own.empty:
                rows.append((None, 0, own.empty, [], None, None))
        return pa.Table.from_batches([batch_of(rows, _SETS_ARROW)])

    levels = (_in_blocks(texts, _CELLS, cell_rows)
              .groupBy("bucket").applyInArrow(rarity, _CELLS))
    return (_in_blocks(texts, _TEXTS, text_rows).groupBy("block")
            .cogroup(levels.groupBy("block")).applyInArrow(assemble, _SETS))


def sizes_fit(a, b):
    """Column test: sets of these sizes can be linked at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def verify(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are linked, by their whole sets."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(64)
        def hashes(packed: bytes) -> np.ndarray:
            return shingle_sets([zstandard.decompress(packed).decode()])[0]

        for batch in batches:
            keep = [linked(hashes(x), hashes(y)) for x, y in zip(*rows_of(batch, "x", "y"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = reps.select(F.col("id").alias("a"), F.col("text").alias("x"))
    y = reps.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return stored(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
                  .mapInArrow(check, "a long, b long"), "verified")


class RTree:
    """Packed R-tree over count vectors: points sorted by size, then by their
    largest differences, ``NODE`` to a leaf and ``NODE`` nodes to a parent.
    A node keeps the upper corner of its box and its range of set sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        spread = np.argsort(-points.std(0), kind="stable")[:4]
        self.order = np.lexsort((*points[:, spread].T[::-1], sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = [(self.points, self.sizes, self.sizes)]
        while len(self.levels[-1][0]) > 1:
            high, least, most = self.levels[-1]
            at = np.arange(0, len(high), NODE)
            self.levels.append((np.maximum.reduceat(high, at), np.minimum.reduceat(least, at),
                                np.maximum.reduceat(most, at)))

    def search(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) pairs whose overlap bound allows a link; all queries
        descend together, level by level."""
        top = len(self.levels) - 1
        query = np.arange(len(points)).repeat(len(self.levels[top][0]))
        node = np.tile(np.arange(len(self.levels[top][0])), len(points))
        for depth in range(top, -1, -1):
            high, least, most = self.levels[depth]
            keep = np.zeros(len(query), bool)
            for a in range(0, len(query), 1 << 15):
                q, n = query[a:a + (1 << 15)], node[a:a + (1 << 15)]
                bound = np.minimum(points[q], high[n]).sum(1, dtype=np.int64)
                s = sizes[q]
                # overlap needed with the smallest set that may be below
                low = np.maximum(least[n], least_common(s))
                keep[a:a + (1 << 15)] = (((100 + PERCENT) * bound >= PERCENT * (s + low))
                                         & (100 * most[n] >= PERCENT * s)
                                         & (100 * s >= PERCENT * least[n]))
            query, node = query[keep], node[keep]
            if depth:
                below = len(self.levels[depth - 1][0])
                child = node[:, None] * NODE + np.arange(NODE)
                inside = child < below
                query = query.repeat(NODE).reshape(-1, NODE)[inside]
                node = child[inside]
        return query, self.order[node]


def _met_before(key: int, lowest: list[list[int]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows share a key below ``key`` among those they carry."""
    codes: dict[int, int] = {}
    left = np.full((len(lowest), CARRIED), -1, np.int32)
    for row, keys in zip(left, lowest):
        own = [codes.setdefault(k, len(codes)) for k in keys if k < key]
        row[:len(own)] = own
    right = np.where(left < 0, -2, left)
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 12):
        x, y = left[a[at:at + (1 << 12)]], right[b[at:at + (1 << 12)]]
        out[at:at + (1 << 12)] = (x[:, :, None] == y[:, None, :]).any((1, 2))
    return out


def _strongest(a: np.ndarray, b: np.ndarray, comp: np.ndarray, points: np.ndarray,
               sizes: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """For each component the ``most`` of its pairs with the highest bound on
    their overlap: the component, the pair, its score (that bound over both
    sizes) and whether the component has more pairs."""
    if not len(a):
        return comp[a], a, b, np.zeros(0), np.zeros(0, bool)
    bound = np.concatenate([np.minimum(points[a[at:at + (1 << 14)]], points[b[at:at + (1 << 14)]]).sum(1)
                            for at in range(0, len(a), 1 << 14)])
    own = np.concatenate([comp[a], comp[b]])
    score = np.tile(bound / (sizes[a] + sizes[b]), 2)
    order = np.lexsort((-score, own))
    starts = np.flatnonzero(np.diff(own[order], prepend=own[order[0]] - 1))
    counts = np.diff(starts, append=len(order))
    keep = np.arange(len(order)) - starts.repeat(counts) < most
    of = order[keep]
    return own[of], np.tile(a, 2)[of], np.tile(b, 2)[of], score[of], (counts > most).repeat(counts)[keep]


_FOUND = "component long, a long, b long, score double, left_out boolean"
_FOUND_ARROW = pa.schema([("component", pa.int64()), ("a", pa.int64()), ("b", pa.int64()),
                          ("score", pa.float64()), ("left_out", pa.bool_())])


def strong_pairs(groups: DataFrame, most: int) -> DataFrame:
    """Candidate pairs (a, b) of classes of different components within each
    group (key, i, j) of rows id, component, n, point, part, lowest: for each
    ``component`` the ``most`` strongest of its pairs, with their ``score``;
    ``left_out`` where the component has more pairs in the group.

    A group is a key's documents, or two parts (i, j) of a large one's.  A
    pair is left to the group of a lower key where the keys that both rows
    carry (``lowest``) show that it meets there; the group of its lowest
    common key always takes it, so none is lost.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def emit():
            _, _, _, names, comps, sizes, points, parts, lowest = zip(*held)
            sizes, parts = np.array(sizes, np.int64), np.array(parts)
            points = np.frombuffer(b"".join(map(zstandard.decompress, points)), "<u2")
            points = points.reshape(len(held), GROUPS).astype(np.int32)
            comp = np.array(comps)
            a, b = RTree(points, sizes).search(points, sizes)
            keep = (a < b) & (comp[a] != comp[b])
            if held[0][1] != held[0][2]:
                keep &= parts[a] != parts[b]
            a, b = a[keep], b[keep]
            keep = ~_met_before(held[0][0], lowest, a, b)
            own, a, b, score, left_out = _strongest(a[keep], b[keep], comp, points, sizes, most)
            x, y = np.array(names)[a], np.array(names)[b]
            found = (own, np.minimum(x, y), np.maximum(x, y), score, left_out)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in found], schema=_FOUND_ARROW)

        for batch in batches:
            columns = rows_of(batch, "key", "i", "j", "id", "component", "n", "point", "part",
                              "lowest")
            for row in zip(*columns):
                if held and row[:3] != held[0][:3]:
                    if len(held) > 1:
                        yield emit()
                    held.clear()
                held.append(row)
        if len(held) > 1:
            yield emit()

    return (groups.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
            .mapInArrow(run, _FOUND))


def tree_pairs(groups: DataFrame) -> DataFrame:
    """All candidate pairs (a, b) of ``strong_pairs``."""
    return strong_pairs(groups, 1 << 62).select("a", "b").distinct()


def _star_pairs(entries: DataFrame, seeds: range) -> DataFrame:
    """For each class and seed the one partner, among the lowest-hashed
    classes of its groups, with which it shares most groups; ``entries`` has
    key, id, n and component."""
    out = None
    for seed in seeds:
        order = F.xxhash64(F.lit(seed), "id")
        lowest = stored(entries.groupBy("key").agg(
            F.min(F.struct(order.alias("h"), "id", "n", "component")).alias("pivot"),
            F.count("*").alias("k")).where(F.col("k") > 1)
            .select("key", F.col("pivot.id").alias("pivot"), F.col("pivot.n").alias("m"),
                    F.col("pivot.component").alias("other")), "pivots")
        shared = (entries.join(lowest, "key")
                  .where((F.col("component") != F.col("other")) & sizes_fit(F.col("n"), F.col("m")))
                  .groupBy("id", "pivot").agg(F.count("*").alias("shared")))
        pairs = (shared.groupBy("id").agg(F.max(F.struct("shared", "pivot")).alias("best"))
                 .select(F.col("id").alias("a"), F.col("best.pivot").alias("b")))
        out = pairs if out is None else out.union(pairs)
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _alive(entries: DataFrame, whole: DataFrame | None) -> DataFrame:
    """Entries with their present component (None: no links yet), of keys with
    more than one; a key that has only one left can propose nothing."""
    named = entries.select("key", "id", "n", "component")
    if whole is not None:
        named = stored(named.drop("component").join(whole.withColumnRenamed("node", "id"), "id", "left")
                       .withColumn("component", F.coalesce("component", "id")), "entries")
    keys = stored(named.groupBy("key").agg(F.min("component").alias("x"),
                                           F.max("component").alias("y"), F.count("*").alias("k"))
                  .where(F.col("x") != F.col("y")).select("key", "k"), "alive")
    return stored(named.join(keys, "key"), "entries")


#: Seeds of the rounds that verify few pairs per class, before the trees.
ROUNDS = (range(0, 1), range(1, 4), range(4, 7))
#: Pairs of a component that the trees' first round verifies, and how many
#: times as many each further one: in a large group of near copies almost all
#: pairs are links, and a few for each component join them.
FIRST_PAIRS = 4
MORE_PAIRS = 15


def _tree_groups(entries: DataFrame, reps: DataFrame) -> DataFrame:
    """The groups of ``strong_pairs``: a key's classes; a large key is cut into
    parts, and every pair of parts is a group."""
    parts = F.ceil(F.col("k") / PART).cast("int")
    other = F.col("other")
    # no more than the class's own keys are collected
    lowest = entries.groupBy("id").agg(
        F.slice(F.sort_array(F.collect_list("key")), 1, CARRIED).alias("lowest"))
    return (entries.join(reps.select("id", "point"), "id").join(lowest, "id")
            .withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
            .select("key", F.least("part", other).alias("i"), F.greatest("part", other).alias("j"),
                    "id", "component", "n", "point", "part", "lowest"))


def _tree_links(entries: DataFrame, reps: DataFrame, whole: DataFrame | None) -> DataFrame:
    """``whole`` with the links that the trees find.

    A round verifies the strongest pairs of each component.  A pair that it
    leaves out is left out of both its components' pairs, so those that had
    more go on, as what they are joined to by now, to a round with more pairs,
    until none is left out.
    """
    most = FIRST_PAIRS
    while True:
        strongest = Window.partitionBy("component").orderBy(F.desc("score"), "a", "b")
        found = stored(strong_pairs(_tree_groups(entries, reps), most)
                       .withColumn("rank", F.row_number().over(strongest))
                       .where(F.col("rank") <= most + 1), "candidates")
        whole = merged(whole, verify(found.where(F.col("rank") <= most).select("a", "b").distinct(), reps))
        more = stored(found.where(F.col("left_out") | (F.col("rank") > most)).select("component")
                      .distinct(), "more")
        if more.isEmpty():
            return whole
        entries = _alive(entries.join(more, "component", "left_semi"), whole)
        most *= MORE_PAIRS


def class_components(sets: DataFrame) -> DataFrame:
    """class, component of the classes that have links, from ``prefix_sets``."""
    reps = sets.where(F.size("keys") > 0).groupBy("class").agg(
        F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("point").alias("point"),
        F.first("text").alias("text"))
    reps = stored(reps.withColumn("id", F.monotonically_increasing_id()), "reps")
    entries = reps.select("id", "n", F.explode("keys").alias("key"),
                          F.col("id").alias("component"))
    whole = None
    for seeds in ROUNDS:
        found = verify(_star_pairs(entries, seeds), reps)
        new = not found.isEmpty()
        whole = merged(whole, found) if new else whole
        if new or "k" not in entries.columns:
            entries = _alive(entries, whole)
    whole = _tree_links(entries, reps, whole)
    names = reps.select("id", "class")
    return (whole.join(names.withColumnRenamed("id", "node"), "node")
            .join(names.select(F.col("id").alias("component"), F.col("class").alias("whole")),
                  "component").select("class", F.col("whole").alias("component")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links,
    itself included) of every row.

    Null text is the empty text; a text without words has no shingles and
    links with nothing; rows with equal sets link; a null doc_id names no
    component (null, if all of it are null); repeated ids keep one result per
    row; an empty table gives no rows; other columns are ignored.
    """
    sets = stored(prefix_sets(docs).withColumn("first_id", F.array_min("members")), "sets")
    whole = class_components(sets)
    classes = (sets.where(F.col("class").isNotNull()).groupBy("class")
               .agg(F.min("first_id").alias("first_id"))
               .join(whole, "class", "left")
               .withColumn("component", F.coalesce("component", "class")))
    classes = stored(classes, "classes")
    first = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = stored(classes.join(first, "component").select("class", "component_id"), "known")
    return (sets.select("class", "n", "members").join(known, "class", "left")
            .select(F.explode("members").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
                    "component_id", "class")
            .select("doc_id", "n_shingles",
                    F.when(F.col("class").isNull(), F.col("doc_id"))
                    .otherwise(F.col("component_id")).alias("component_id")))


def components_sql() -> str:
    """DuckDB SQL of ``near_duplicates`` over ``documents`` (ids not null and
    not repeated): all pairs that share a shingle, and what links reach."""
    return f"""
WITH RECURSIVE
words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS shingle
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= {PERCENT} * (p.n + q.n - c)),
reach AS (
  SELECT doc_id, doc_id AS seen FROM documents
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.seen)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.seen) AS component_id
FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
GROUP BY d.doc_id"""
