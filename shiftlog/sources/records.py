"""CSV records of many files, split where their quotes allow it.

A field in quotes may hold separators, doubled quotes and line breaks, so a
line alone does not tell whether a record begins with it: the number of quotes
before it in its file does.  Lines are read in parallel, a file in as many
splits as Spark makes of it; one small row per split counts its lines and
quotes, and a running sum over a file's splits places every line in its file.
Lines whose quotes are balanced are records as they stand, without a shuffle.
Only files that hold records of several lines are ordered (split by split) to
put these together.

Every file has a header of its own; files with equal headers share a layout.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A record of more lines than this is taken for a quote that was never closed.
RECORD_LINES = 10_000
#: Text that means "missing" besides the empty one, as the reference's reader
#: takes it.
MISSING = "NA"

# Bits of an ordinal: number of the export, of the file in it, line in the file.
EXPORT_BITS, FILE_BITS, LINE_BITS = 6, 22, 35


@dataclass(frozen=True)
class Records:
    """``rows``: file, file_no (0.. by path), line (of its first line in the
    file, the header being 0), layout (index into ``layouts``), text, torn
    (a line of no complete record)."""

    rows: DataFrame
    layouts: list[list[str]]
    sep: str

    def ordinal(self, export: int = 0) -> Column:
        """A number per record that increases in the order of files and lines
        and is unique over the exports of one log."""
        if not 0 <= export < 1 << EXPORT_BITS:
            raise ValueError(f"export number {export} is not below {1 << EXPORT_BITS}")
        return (F.lit(export << (FILE_BITS + LINE_BITS)).cast("bigint")
                + F.shiftleft(F.col("file_no").cast("bigint"), LINE_BITS) + F.col("line"))


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return (spark.read.option("lineSep", "\n").text(list(paths))
            .select("value", F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("at"),
                    F.when(F.contains("value", F.lit('"')), _count("value", '"') % 2).otherwise(0)
                    .alias("odd")))


def _count(column: str | Column, mark: str) -> Column:
    """How often a one-byte mark occurs."""
    return (F.octet_length(column) - F.octet_length(F.replace(column, F.lit(mark)))).cast("bigint")


def _without_return(text: str | Column) -> Column:
    return F.when(F.endswith(text, F.lit("\r")), F.rtrim(text, F.lit("\r"))).otherwise(
        F.col(text) if isinstance(text, str) else text)


def _fields(header: str, sep: str) -> list[str]:
    return [name.strip() for name in next(csv.reader([header], delimiter=sep), [])]


def read_records(spark: SparkSession, paths: str | Sequence[str], sep: str = ",",
                 torn: str = "fail", max_lines: int = RECORD_LINES) -> Records | None:
    """Records of the files under ``paths``; None when they hold no line.

    ``torn="fail"`` raises when a file ends inside quotes; ``"keep"`` returns
    its lines from the open quote on, and those of records longer than
    ``max_lines``, one by one as torn.  Blank lines are no records.

    One job reads the headers and counts quotes first, one row per layout of
    which reaches the driver.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = _lines(spark, paths)
    so_far = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    blocks = (lines.groupBy("file", "block")
              .agg(F.count(F.lit(1)).alias("n"), F.sum("odd").alias("odds"), F.min("at").alias("first"))
              .select("file", "block", "first",
                      F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("lines_before"),
                      F.coalesce(F.sum("odds").over(so_far), F.lit(0)).alias("odds_before"),
                      F.sum("odds").over(whole).alias("file_odds")))
    files = blocks.where("block = 0").select("file", "first", "file_odds")
    # the line that each file begins with
    heads = (lines.where("block = 0").select("file", F.col("at").alias("first"), "value")
             .join(files, ["file", "first"]).withColumnRenamed("value", "header"))
    kinds = (heads.groupBy("header").agg(F.sum(F.col("file_odds") % 2).alias("torn"),
                                         F.max("file_odds").alias("odds"),
                                         F.min(F.when(F.col("file_odds") % 2 == 1, F.col("file")))
                                         .alias("example"))
             .collect())  # one row per layout
    if not kinds:
        return None
    kinds.sort(key=lambda k: k["header"])
    for k in kinds:
        if k["header"].count('"') % 2:
            raise ValueError(f"a header of several lines: {k['header']!r}")
        if k["torn"] and torn == "fail":
            raise ValueError(f"a quote is never closed in {k['example']} "
                             f"({k['torn']} such files)")
    layouts = [_fields(k["header"].lstrip("\ufeff").rstrip("\r"), sep) for k in kinds]
    layout = F.lit(0)
    for i, k in enumerate(kinds[1:], 1):
        layout = F.when(F.col("header") == k["header"], i).otherwise(layout)
    files = (heads if len(kinds) > 1 else files).select(
        "file", layout.alias("layout"),
        (F.row_number().over(Window.orderBy("file")) - 1).alias("file_no"))
    blocks = blocks.join(files, "file")
    # both scans are planned together, so they have the same splits
    placed = (lines.join(blocks, ["file", "block"])
              .withColumn("line", F.col("lines_before") + F.col("at") - F.col("first")))
    out = ["file", "file_no", "line", "layout"]
    # ``torn`` is known from the place of a line only: a check of a record must
    # not run below the joins and filters that tell what a record is
    rows = (placed.where("file_odds = 0")
            .select(*out, _without_return("value").alias("text"),
                    F.when(F.col("line") >= 0, F.lit(False)).alias("torn")))
    if any(k["odds"] for k in kinds):
        rows = rows.unionByName(_quoted(placed.where("file_odds > 0"), out, max_lines))
    rows = rows.where((F.col("line") > 0) & (F.trim("text") != ""))
    return Records(rows, layouts, sep)


def _quoted(placed: DataFrame, out: Sequence[str], max_lines: int) -> DataFrame:
    """Records of files in which some span several lines.

    A split's lines are put in order (a split is bounded by
    ``spark.sql.files.maxPartitionBytes``); the lines of a record share the
    number of the quote that opened it.
    """
    before = (Window.partitionBy("file", "block").orderBy("at")
              .rowsBetween(Window.unboundedPreceding, -1))
    seen = placed.withColumn("open", F.col("odds_before")
                             + F.coalesce(F.sum("odd").over(before), F.lit(0)))
    inside = F.col("open") % 2 == 1
    alone = ~inside & (F.col("odd") == 0)
    single = seen.where(alone).select(*out, _without_return("value").alias("text"),
                                      F.when(alone, F.lit(False)).alias("torn"))
    parts = seen.where(~alone).withColumn("quote", F.when(inside, F.col("open"))
                                          .otherwise(F.col("open") + 1))
    size = F.count(F.lit(1)).over(Window.partitionBy("file", "quote"))
    parts = parts.withColumn("torn", (size > max_lines) | ((F.col("quote") == F.col("file_odds"))
                                                           & (F.col("file_odds") % 2 == 1)))
    whole = (parts.groupBy("file", "file_no", "layout", "quote", "torn",
                           F.when(F.col("torn"), F.col("line")).alias("apart"))
             .agg(F.min("line").alias("line"),
                  F.sort_array(F.collect_list(F.struct("line", "value"))).alias("l")))
    joined = F.array_join(F.transform("l", lambda x: x["value"]), "\n")
    return single.unionByName(whole.select(
        *out, _without_return(joined).alias("text"), "torn"))


def parse(records: Records, names: Sequence[str], carry: Sequence[Column] = ()) -> DataFrame:
    """Fields of the records by header name: ``carry`` columns, one text column
    per name (NULL where a file lacks it, and for missing values), ``text`` and
    ``bad`` (torn, or not as many fields as its header).  White space round
    unquoted fields is trimmed."""
    width = max(map(len, records.layouts))
    schema = ", ".join(f"f{i} string" for i in range(width))
    fields = F.from_csv("text", schema, {
        "sep": records.sep, "quote": '"', "escape": '"', "nullValue": MISSING, "emptyValue": MISSING,
        "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    bare = F.when(F.contains("text", F.lit('"')), F.regexp_replace("text", '"[^"]*"', "")) \
        .otherwise(F.col("text"))
    n = _count(bare, records.sep) + 1

    def by_layout(values: Sequence) -> Column:
        """One value per layout; a plain one where all agree."""
        if len(set(map(str, values))) == 1:
            return values[0]
        out = F.lit(None)
        for i, value in enumerate(values):
            out = F.when(F.col("layout") == i, value).otherwise(out)
        return out

    def field(name: str) -> Column:
        none = F.lit(None).cast("string")
        return by_layout([F.col(f"f.f{own.index(name)}") if name in own else none
                          for own in records.layouts]).alias(name)

    wanted = by_layout([F.lit(len(own)) for own in records.layouts])
    parsed = records.rows.select(*carry, "text", "layout", fields.alias("f"),
                                 F.when(F.col("torn").isNotNull(), F.col("torn") | (n != wanted))
                                 .alias("bad"))
    kept = [c for c in parsed.columns if c not in ("text", "layout", "f", "bad")]
    return parsed.select(*kept, *[field(n) for n in names], "text", "bad")
