"""What each of several filters removes, under every order of applying them.

A document's outcome depends on the set of filters it fails alone, so the rows
are first counted by that set (one partially aggregated ``groupBy``).  Per part
the distinct sets form a mask matrix (0 where a filter fails, infinite where it
passes), and the orders form a position matrix (their inverse permutations:
the step at which each filter runs).  Their min-plus product is the step that
removes each set under each order; scattering the counts by it gives every
figure of the audit.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlog.llm.common import stored, text_of

#: All orders are listed, so their number is bounded: 7! = 5040.
MAX_FILTERS = 7


def positions(names: Sequence[str]) -> tuple[list[tuple[str, ...]], np.ndarray]:
    """Every order of ``names``, and for each the step (from 1) of each name."""
    orders = list(permutations(names))
    return orders, np.array([[o.index(n) + 1 for n in names] for o in orders], float)


def removal_steps(fails: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Min-plus product: ``[set, order]`` -> the step that removes the set's
    documents, infinite where they fail nothing."""
    mask = np.where(fails, 0.0, np.inf)
    step = np.full((len(fails), len(at)), np.inf)
    for f in range(fails.shape[1]):
        np.minimum(step, mask[:, f, None] + at[None, :, f], out=step)
    return step


def _figures(fails: np.ndarray, counts: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Figures by ``[order, step]`` (losses: ``[weight, order, step]``) from the
    failed sets, and ``counts[weight, set]`` whose first row counts documents."""
    n_orders, k = at.shape
    step = removal_steps(fails, at)
    gone = np.isfinite(step)
    sets, orders = np.nonzero(gone)
    cell = orders * k + step[gone].astype(int) - 1
    scattered = [np.bincount(cell, w[sets], n_orders * k).reshape(n_orders, k) for w in counts]
    n, removed = counts[0], scattered[0]
    runs = at.astype(int).argsort(1)  # the filter that each step runs
    late = np.stack([n @ (fails[:, f, None] & (step < at[None, :, f])) for f in range(k)], 1)
    alone = np.array([n @ (fails[:, f] & (fails.sum(1) == 1)) for f in range(k)])
    shapley = np.bincount(runs.ravel(), removed.ravel(), k)
    return {"kept": n.sum() - removed.cumsum(1), "removed": removed,
            "redundant": np.take_along_axis(late, runs, 1), "unique_fails": alone[runs],
            "lost": np.array(scattered[1:]).reshape(-1, n_orders, k), "shapley": shapley[runs]}


def audit(rows: DataFrame, part: str, filters: Sequence[str],
          weights: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """One row per part, order of ``filters`` (boolean columns, true: the row
    fails) and step.

    Columns: ``part``, ``filter_order`` (names joined), ``step`` (int from 1),
    and as long ``kept`` (after the step), ``removed`` (by it), ``redundant``
    (fail its filter, removed before), ``unique_fails`` (fail no other filter),
    one ``<weight>_lost`` per integer column of ``weights`` (its sum over the
    removed rows) and ``shapley`` (its filter's removed over all orders).

    A row stands for one document, or for as many as its column ``count`` says.
    A null flag passes, a null weight is 0, a null part is a part of its own;
    repeated rows count each; further columns are ignored, and a table without
    rows gives none.  A hot part is counted map-side, so that what is shuffled
    is at most one row per part, set and task.
    """
    if not 1 <= len(filters) <= MAX_FILTERS:
        raise ValueError(f"between 1 and {MAX_FILTERS} filters, not {len(filters)}")
    names, weights = list(filters), list(weights)
    flags = [F.coalesce(F.col(f), F.lit(False)).alias(f"fails_{i}") for i, f in enumerate(names)]
    sums = [F.sum(F.coalesce(F.col(w).cast("long"), F.lit(0))).alias(f"weight_{i}")
            for i, w in enumerate(weights)]
    sets = (rows.groupBy(F.col(part).alias("part"), *flags)
            .agg(F.sum(F.col(count) if count else F.lit(1)).alias("n"), *sums))
    figures = ["kept", "removed", "redundant", "unique_fails",
               *(f"{w}_lost" for w in weights), "shapley"]
    schema = T.StructType([
        T.StructField("part", rows.schema[part].dataType),
        T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType()),
        *(T.StructField(c, T.LongType()) for c in figures)])
    orders, at = positions(names)

    def of_part(sets: pa.Table) -> pa.Table:
        def matrix(prefix: str, count: int) -> np.ndarray:
            return np.array([sets[f"{prefix}_{i}"].to_numpy() for i in range(count)])

        counts = np.vstack([sets["n"].to_numpy(), *matrix("weight", len(weights))])
        made = _figures(matrix("fails", len(names)).T.astype(bool), counts, at)
        lost = made.pop("lost")
        made |= {f"{w}_lost": lost[i] for i, w in enumerate(weights)}
        k = len(names)
        out = {"part": pa.concat_arrays([sets["part"].combine_chunks()[:1]] * (k * len(orders))),
               "filter_order": pa.array(["".join(o) for o in orders for _ in range(k)]),
               "step": pa.array(list(range(1, k + 1)) * len(orders), pa.int32())}
        out |= {c: pa.array(np.rint(made[c]).astype(np.int64).ravel()) for c in figures}
        return pa.table(out)

    return sets.groupBy("part").applyInArrow(of_part, schema)


# -- five filters over the text of a document ---------------------------------

FILTERS = ("A", "B", "C", "D", "E")
SPACE = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that the text alone decides: under 100 words; under
    80 distinct words in 100; over 10 capitals A-Z in 100 code points; a sign
    of markup or code."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": F.size(words) < 100,
            "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
            "C": capitals * 100 > F.char_length(text) * 10,
            "D": text.rlike("[#$%&*|]")}


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, n, good, toxic): ``docs`` counted (``n``) by what
    they fail, ``part`` being the language (null: empty).

    E fails for a text that a smaller doc_id has too; texts are compared by
    their SHA-256.  A null doc_id is neither smaller nor larger than another,
    so it never fails E, and has no labels.  ``good`` and ``toxic`` are ``n``
    where a label row of the id says so, else 0.  Null texts are empty.

    The texts are read once; what later steps read and shuffle is a digest and
    the flags, with equal rows already counted together.  Copies of one text
    join their smallest id on (digest, id), and null ids are spread over the
    label join, so neither a hot text nor null ids meet in one task.
    """
    flags = text_filters(F.col("text"))
    seen = stored(
        docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"),
                    text_of().alias("text"))
        .groupBy("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
                 *(c.alias(f) for f, c in flags.items()))
        .agg(F.count(F.lit(1)).alias("n")), "filter_flags")
    first = seen.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
                  F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
             .withColumn("spread", F.lit(0)))
    spread = F.when(F.col("doc_id").isNull(), F.hash("digest")).otherwise(0)
    return (seen.join(first, ["digest", "doc_id"], "left")
            .withColumn("spread", spread).join(known, ["doc_id", "spread"], "left")
            .select("part", *flags, (F.col("first").isNull() & F.col("doc_id").isNotNull()).alias("E"),
                    "n", *((F.coalesce(F.col(c), F.lit(0)) * F.col("n")).alias(c)
                           for c in ("good", "toxic"))))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``audit`` of the five filters over ``docs``, by language."""
    return audit(failures(docs, labels), "part", FILTERS, ("good", "toxic"), "n")


def audit_sql() -> str:
    """DuckDB SQL of ``audit_documents``."""
    letters = ", ".join(f"('{f}')" for f in FILTERS)
    joins = " ".join(f"JOIN l l{i} ON " + " AND ".join(f"l{i}.f <> l{j}.f" for j in range(i))
                     for i in range(1, len(FILTERS)))
    order = " || ".join(f"l{i}.f" for i in range(len(FILTERS)))
    fails = " OR ".join(f"(letter = '{f}' AND {f}_)" for f in FILTERS)
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
d AS (SELECT *, list_filter(string_split_regex(text, '{SPACE}'), lambda w: w <> '') AS words FROM t),
y AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
             max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, len(words) < 100 AS A_,
             100 * len(list_distinct(words)) < 80 * len(words) AS B_,
             100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) AS C_,
             regexp_matches(text, '[#$%&*|]') AS D_,
             coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false) AS E_,
             coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM d LEFT JOIN y ON d.doc_id = y.doc_id),
s AS (SELECT part, A_, B_, C_, D_, E_, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
      FROM m GROUP BY ALL),
l AS (SELECT f FROM (VALUES {letters}) v(f)),
o AS (SELECT {order} AS filter_order FROM l l0 {joins}),
g AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter
      FROM o, (SELECT unnest(range(1, {len(FILTERS) + 1}))::INT AS step)),
x AS (SELECT s.*, g.*, ({fails}) AS fails,
             coalesce(least({", ".join(f"CASE WHEN {f}_ THEN instr(filter_order, '{f}') END" for f in FILTERS)}), 99) AS gone,
             {" + ".join(f"{f}_::INT" for f in FILTERS)} AS failed
      FROM s, g),
r AS (SELECT part, filter_order, step, letter,
             sum(CASE WHEN gone > step THEN n ELSE 0 END)::BIGINT AS kept,
             sum(CASE WHEN gone = step THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN fails AND gone < step THEN n ELSE 0 END)::BIGINT AS redundant,
             sum(CASE WHEN fails AND failed = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN gone = step THEN good ELSE 0 END)::BIGINT AS good_lost,
             sum(CASE WHEN gone = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
FROM r
"""
