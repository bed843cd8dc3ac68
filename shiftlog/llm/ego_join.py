"""Embedding near-duplicates by the epsilon grid order join.

Unit vectors within cosine ``t`` are within distance eps = sqrt(2 - 2t).
Vectors are put on a grid of that width over the leading principal
dimensions and sorted by label and cell (epsilon grid order); the order is cut
into blocks.  Two blocks, and recursively the halves of their sequences, are
compared unless their boxes are provably further apart than eps.  Identical
vectors are one class with a weight, so copies cost nothing.  Of a pair of
blocks only link counts and a spanning forest of the links come back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlog.llm.common import rows_of, stored
from shiftlog.llm.components import components

#: Leading principal dimensions of the grid.
DIMENSIONS = 6
#: Vectors in a block and in a leaf of the recursion.
BLOCK = 1024
LEAF = 128
#: Rounding allowance of distance bounds.
SLACK = 1e-9

_CLASSED = "vec_id long, label long, class string, vector binary"
_BLOCK = ("block string, label long, low array<double>, high array<double>, classes array<string>, "
          "weights array<long>, vectors binary")


def classed(vectors: DataFrame, vec: str) -> DataFrame:
    """vec_id, label, class and unit vector (binary, doubles); rows that link
    with nothing have a null class and vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, units = [], []
            for label, v in zip(*rows_of(batch, "label", "vec")):
                unit = None
                if label is not None and v and None not in v:
                    x = np.array(v, np.float64)
                    peak = np.abs(x).max()
                    if np.isfinite(peak) and peak > 0:
                        x = x / peak  # no overflow in the norm
                        unit = (x / np.sqrt(x @ x)).tobytes()
                units.append(unit)
                classes.append(unit and hashlib.blake2b(
                    b"%d:" % label + np.array(v, np.float64).tobytes(), digest_size=12).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(classes, pa.string()),
                 pa.array(units, pa.binary())], names=["vec_id", "label", "class", "vector"])

    return vectors.select("vec_id", F.col("label").cast("long").alias("label"),
                          F.col(vec).alias("vec")).mapInArrow(run, _CLASSED)


def principal(reps: DataFrame, dimensions: int) -> np.ndarray:
    """Leading principal directions of all vectors, by the sums of products
    (one row per pair of coordinates reaches the driver)."""
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            by_size: dict[int, list] = {}
            for v in rows_of(batch, "vector")[0]:
                x = np.frombuffer(v)
                by_size.setdefault(len(x), []).append(np.append(x, 1.0))
            for n, rows in by_size.items():
                x = np.array(rows)
                total[n] = total.get(n, 0) + x.T @ x
        for n, t in total.items():
            i, j = np.triu_indices(n + 1)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(t[i, j])],
                                             names=["i", "j", "s"])

    sums = (reps.select("vector").mapInArrow(products, "i long, j long, s double")
            .groupBy("i", "j").agg(F.sum("s").alias("s")).collect())
    size = max((r["j"] for r in sums), default=0)
    if not size:
        return np.zeros((0, dimensions))
    m = np.zeros((size + 1, size + 1))
    for r in sums:
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["s"]
    n = max(m[size, size], 1.0)
    mean = m[size, :size] / n
    _, axes = np.linalg.eigh(m[:size, :size] / n - np.outer(mean, mean))
    return axes[:, ::-1][:, :dimensions]


def _project(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    n = min(x.shape[1], len(axes))
    return x[:, :n] @ axes[:n]


def blocks(reps: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    """Classes in epsilon grid order, cut into blocks of one label each."""
    cells = [f"c{i}" for i in range(axes.shape[1])]

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = rows_of(batch, "vector")[0]
            at = [np.floor(_project(np.frombuffer(v)[None], axes)[0] / eps) for v in vectors]
            columns = np.array(at).reshape(len(vectors), len(cells)).T.astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, columns)],
                                             names=[*batch.schema.names, *cells])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def emit():
            labels, classes, weights, vectors = zip(*held)
            sizes = {len(v) for v in vectors}
            width = max(sizes) // 8
            x = np.zeros((len(held), width))
            for row, v in zip(x, vectors):
                own = np.frombuffer(v)
                row[:len(own)] = own
            p = _project(x, axes)
            return pa.RecordBatch.from_arrays(
                [pa.array([classes[0]]), pa.array([labels[0]], pa.int64()),
                 pa.array([p.min(0).tolist()]), pa.array([p.max(0).tolist()]),
                 pa.array([list(classes)]), pa.array([list(weights)], pa.list_(pa.int64())),
                 pa.array([x.tobytes()], pa.binary())],
                names=["block", "label", "low", "high", "classes", "weights", "vectors"])

        for batch in batches:
            for row in zip(*rows_of(batch, "label", "class", "weight", "vector")):
                if held and (len(held) == BLOCK or held[0][0] != row[0]
                             or len(held[0][3]) != len(row[3])):
                    yield emit()
                    held.clear()
                held.append(row)
        if held:
            yield emit()

    kinds = ", ".join(f"{c} int" for c in cells)
    order = ["label", *cells, "class"]  # classes are distinct: no range is too hot to cut
    return stored(
        reps.select("label", "class", "weight", "vector")
        .mapInArrow(grid, f"label long, class string, weight long, vector binary, {kinds}")
        .repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, _BLOCK), "blocks")


def block_pairs(blocks_: DataFrame, eps: float) -> DataFrame:
    """Pairs of blocks (also a block with itself) whose boxes are within eps;
    they meet on the grid cells of the first principal dimension."""
    meta = blocks_.select("block", "label", "low", "high")
    first, last = (F.floor(F.col(c)[0] / eps) for c in ("low", "high"))
    a = meta.withColumn("cell", F.explode(F.sequence(first - 1, last + 1)))
    b = meta.withColumn("cell", F.explode(F.sequence(first, last)))
    a, b = a.alias("a"), b.alias("b")
    apart = F.expr("aggregate(transform(sequence(0, size(a.low) - 1), i -> "
                   "pow(greatest(a.low[i] - b.high[i], b.low[i] - a.high[i], 0D), 2)), "
                   "0D, (s, x) -> s + x)")
    return (a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.cell") == F.col("b.cell"))
                   & (F.col("a.block") <= F.col("b.block")))
            .where(apart <= (eps + SLACK) ** 2)
            .select(F.col("a.block").alias("a"), F.col("b.block").alias("b")).distinct())


def _links(x, y, px, py, eps, least) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine at least ``least``: sequences in grid order are
    halved until small, and skipped where their boxes are too far apart."""
    out_i, out_j = [], []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        gap = np.maximum(np.maximum(px[a:b].min(0) - py[c:d].max(0),
                                    py[c:d].min(0) - px[a:b].max(0)), 0)
        if gap @ gap > (eps + SLACK) ** 2:
            continue
        if max(b - a, d - c) <= LEAF:
            i, j = np.nonzero(x[a:b] @ y[c:d].T >= least)
            out_i.append(i + a)
            out_j.append(j + c)
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]
    none = [np.zeros(0, np.int64)]
    return np.concatenate(out_i or none), np.concatenate(out_j or none)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over links i - j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_duplicates(vectors: DataFrame, least: float = 0.98, vec: str = "embedding",
                    dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, n_links (other vectors of the same label with cosine at least
    ``least``), component_id (smallest vec_id reachable over links), kept.

    A null label or vector, a zero vector and null or non-finite components
    link with nothing; vectors of different lengths do not link; copies link
    with each other and share a component; a null vec_id is a row like any
    other but names no component unless all of it is null; an empty table
    gives no rows; other columns are ignored.
    """
    eps = float(np.sqrt(max(2 - 2 * least, 0.0)))
    rows = stored(classed(vectors, vec), "vectors")
    reps = stored(rows.where(F.col("class").isNotNull()).groupBy("label", "class")
                  .agg(F.count("*").alias("weight"), F.min("vec_id").alias("first_id"),
                       F.first("vector").alias("vector")), "classes")
    axes = principal(reps, dimensions)
    if not len(axes):
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"),
                           F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    cut = blocks(reps, axes, eps)

    def compare(pair: pa.Table) -> pa.Table:
        p = {k: pair[k][0].as_py() for k in pair.column_names}
        x, y = (np.frombuffer(p[k]).reshape(len(p[c]), -1)
                for k, c in (("xs", "xc"), ("ys", "yc")))
        names = np.array(p["xc"] + p["yc"], object)
        if x.shape[1] != y.shape[1]:
            i = j = np.zeros(0, np.int64)
        else:
            i, j = _links(x, y, _project(x, axes), _project(y, axes), eps, least)
        if p["a"] == p["b"]:
            own = i < j
            i, j, offset = i[own], j[own], 0
        else:
            offset = len(x)
        j = j + offset
        weight = np.array(p["xw"] + p["yw"], np.int64)
        n = len(names)
        degree = (np.bincount(i, weight[j], n) + np.bincount(j, weight[i], n)).astype(np.int64)
        root, has = _forest(n, i, j), degree > 0
        return pa.table({"class": pa.array(names[has].tolist(), pa.string()),
                         "links": pa.array(degree[has]),
                         "root": pa.array(names[root[has]].tolist(), pa.string())})

    x = cut.select(F.col("block").alias("a"), F.col("classes").alias("xc"),
                   F.col("weights").alias("xw"), F.col("vectors").alias("xs"))
    y = cut.select(F.col("block").alias("b"), F.col("classes").alias("yc"),
                   F.col("weights").alias("yw"), F.col("vectors").alias("ys"))
    found = stored(block_pairs(cut, eps).join(x, "a").join(y, "b")
                   .groupBy("a", "b").applyInArrow(compare, "class string, links long, root string"),
                   "found")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    whole = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    labelled = stored(
        reps.select("class", "weight", "first_id").join(links, "class", "left")
        .join(whole.withColumnRenamed("node", "class"), "class", "left")
        .select("class", "first_id", F.coalesce("component", "class").alias("component"),
                (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "labelled")
    first = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = stored(labelled.join(first, "component").select("class", "n_links", "component_id"),
                   "known")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select("vec_id", "class").join(known, "class", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
