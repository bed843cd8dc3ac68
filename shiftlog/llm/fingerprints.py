"""Bottom-k sketches of word-shingle hashes, in native expressions.

A text's sketch is the ``K`` smallest distinct hashes of its five-word
shingles (fewer words: the whole sequence as one; none: no hashes).  Sketches
merge by union, and estimate resemblance, containment and the number of
distinct shingles; with fewer than ``K`` hashes the estimates are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlog.llm.common import text_of

K = 128
WORDS = 5
#: Rows of a neighbour bucket, and the most buckets (their bounds are literals).
BUCKET_ROWS = 500
MAX_BUCKETS = 2048
_SPAN = 2.0 ** 64


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, not once per use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sketch(text: Column, k: int = K) -> Column:
    """Sketch of a text: array<bigint>, ascending."""
    words = F.filter(F.split(F.lower(text), r"[ \t-\r]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(w: Column) -> Column:
        # past the end get() is null, which the hash leaves out: a short
        # sequence's first shingle is the whole sequence
        every = F.transform(w, lambda x, i: F.xxhash64(
            x, *(F.get(w, i + n) for n in range(1, WORDS))))
        return F.slice(every, 1, F.greatest(F.size(w) - (WORDS - 1), F.lit(1)))

    return F.slice(F.array_sort(F.array_distinct(_bind(hashes, shingles))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of two parts together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Jaccard estimate: the share of the union's sketch that both hold; two
    empty sketches are alike (1)."""
    both = F.array_intersect(a, b)
    share = _bind(merge(a, b, k), lambda u: F.size(F.array_intersect(u, both)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(share)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Number of distinct shingles: exact below ``k``, else from the place of
    the k-th smallest hash among all hashes."""
    place = (F.element_at(a, -1).cast("double") + _SPAN / 2) / _SPAN
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of ``a``'s shingles that ``b`` has (1 for an empty ``a``)."""
    j = resemblance(a, b, k)
    common = j / (1 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def merge_groups(parts: DataFrame, key: str, column: str = "sketch", k: int = K,
                 salts: int = 64) -> DataFrame:
    """One sketch per ``key`` from the sketches of its parts.

    The k smallest of each salt first, then of the key: no task sees more of
    a key than a salt's share or ``salts * k`` hashes.
    """
    values = (parts.select(key, F.explode(column).alias("h")).distinct()
              .withColumn("salt", F.pmod(F.col("h"), F.lit(salts))))
    for by in ([key, "salt"], [key]):
        order = Window.partitionBy(*by).orderBy("h")
        values = values.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    return values.groupBy(key).agg(F.array_sort(F.collect_list("h")).alias(column))


def as_text(a: Column) -> Column:
    """The sketch as a string: 16 hexadecimal digits for each hash."""
    return F.concat_ws("", F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")))


def neighbour_buckets(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with key, bucket and ghost, for windows over
    neighbours in the order of doc_id.

    Buckets are ranges of the key (a null id comes first); the first row of
    each is also put, as a ghost, at the end of the bucket before it (the
    first row of all at the end of the last), so every row finds its
    successor in its own bucket.
    """
    keyed = docs.withColumn("key", F.coalesce(F.col("doc_id"), F.lit(-2 ** 63)))
    n = keyed.count()
    parts = min(MAX_BUCKETS, max(1, -(-n // BUCKET_ROWS)))
    cuts = [i / parts for i in range(1, parts)]
    low, marks = keyed.agg(F.min("key"), F.percentile_approx(
        "key", cuts or [0.5], max(10_000, 20 * parts))).first()
    bounds = sorted({low, *(marks or [])}) if low is not None else [0]
    held = F.array(*(F.lit(b) for b in bounds))
    bucket = F.size(F.filter(held, lambda b: b <= F.col("key"))) - 1
    first = F.element_at(held, F.col("own") + 1) == F.col("key")
    before = F.when(F.col("own") == 0, len(bounds) - 1).otherwise(F.col("own") - 1)
    places = F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("ghost")),
                     F.when(first, F.struct(before.alias("bucket"), F.lit(1).alias("ghost"))))
    return (keyed.withColumn("own", bucket)
            .withColumn("place", F.explode(F.filter(places, lambda p: p.isNotNull())))
            .select("doc_id", "text", "key", "place.bucket", "place.ghost"))


def edited_neighbours(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every whole text and of an edited one, whose last
    floor(n/2) code points are replaced by the first as many (or all) of the
    next document's: doc_id, text, edited, sketch, edited_sketch, next_sketch.

    Null text is the empty text; of rows with equal ids any may follow; after
    the last row comes the first, a lone row follows itself; an empty table
    gives no rows; other columns are ignored.  One shuffle moves the texts.
    """
    order = Window.partitionBy("bucket").orderBy("ghost", "key")
    rows = neighbour_buckets(docs.select("doc_id", text_of().alias("text")))
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half),
                      F.substring(F.col("next_text"), F.lit(1), half))
    rows = (rows.withColumn("next_text", F.lead("text").over(order))
            .withColumn("edited", edited)
            .select("doc_id", "text", "key", "bucket", "ghost", "edited",
                    sketch(F.col("text"), k).alias("sketch"),
                    sketch(F.col("edited"), k).alias("edited_sketch")))
    return (rows.withColumn("next_sketch", F.lead("sketch").over(order))
            .where(F.col("ghost") == 0)
            .select("doc_id", "text", "edited", "sketch", "edited_sketch", "next_sketch"))
