"""Connected components of links too many for any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlog.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node of its component) of every node in
    ``links`` (a, b).

    Labels start as the nodes; in each round both ends of a link, and the
    nodes they are labelled with, take the smaller label, then each node takes
    its label's label, so the rounds grow with the logarithm of the longest
    chain.  It ends when no link has ends of different labels.  Every round is
    written to the shared folder.  No links: no rows.
    """
    links = stored(links.where(F.col("a") != F.col("b"))
                        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                        .distinct(), "links")
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = stored(nodes.withColumn("label", F.col("node")), "labels")
    while True:
        of_a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        open_links = stored(links.join(of_a, "a").join(of_b, "b")
                            .where(F.col("la") != F.col("lb")), "links")
        if open_links.isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        low = F.least("la", "lb")
        offers = (open_links.select(F.explode(F.array("a", "b", "la", "lb")).alias("node"),
                                    low.alias("offer"))
                  .groupBy("node").agg(F.min("offer").alias("offer")))
        lower = stored(labels.join(offers, "node", "left").select(
            "node", F.least("label", "offer").alias("label")), "labels")
        to = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = stored(lower.join(to, "label").select("node", F.col("next").alias("label")),
                        "labels")


def merged(whole: DataFrame | None, links: DataFrame) -> DataFrame:
    """``components`` of all links so far, from those of the earlier ones
    (None: no earlier links) and the new ``links``.

    New links are taken between the components their ends are in, so every
    link is looked at once, whatever the number of rounds it stays in.
    """
    if whole is None:
        return components(links)
    ends = links
    for end in ("a", "b"):
        of_end = whole.select(F.col("node").alias(end), F.col("component").alias(f"__{end}"))
        ends = ends.join(of_end, end, "left")
    joined = components(ends.select(*(F.coalesce(f"__{end}", end).alias(end) for end in ("a", "b"))))
    to = joined.select(F.col("node").alias("component"), F.col("component").alias("__to"))
    known = whole.join(to, "component", "left").select("node", F.coalesce("__to", "component")
                                                       .alias("component"))
    fresh = joined.join(whole, "node", "left_anti")  # ends that had no link before
    return stored(known.unionByName(fresh), "components")
