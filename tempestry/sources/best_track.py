"""Best-track text: a header line per storm, then one line per fix.

Files are read as splittable lines, so one very large archive is spread over
tasks like any other text.  A split may start in the middle of a storm; the
header it needs is the last one of an earlier split of the file.

``read_best_track`` reads the text once, a split at a time: the pass carries the last
header along, decodes the lines and ends each split with one summary row, its last header and
its number of lines.  A prefix scan over the summaries gives the header that a split's first lines inherit
and the number of its first line.  Lines are never exchanged between tasks or sorted.
"""

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempestry.schema import TRACK_SCHEMA
from tempestry.sources.staging import staged

# Fixed values of the format.
HEADER_PATTERN = r"^[A-Z]{2}\d{6},"
MISSING = "-999"
MISSING_WIND = "-99"
RADII = ["r34_ne", "r34_se", "r34_sw", "r34_nw"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line_no, value): lines with their order inside a file split."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        "value",
    )


def read_best_track(spark: SparkSession, path: str, **options) -> DataFrame:
    """Track table of the files at a path; see ``scan_lines`` for the options."""
    return scan_lines(read_lines(spark, path), **options)


# -- one pass over splits ------------------------------------------------------------------------

SCANNED = "file string, block bigint, kind string, number bigint, _storm string, value string"


class SplitScan:
    """Carries the last header and the line count of a split from one Arrow batch to the next."""

    def __init__(self, header_pattern: str):
        self.pattern = header_pattern
        self.split, self.header, self.count = None, None, 0

    def summary(self) -> list[tuple]:
        """The row that ends a split: its number of lines and its last header."""
        return [] if self.split is None else [(*self.split, "split", self.count, self.header, None)]

    def part(self, split: tuple, lines: pa.Array) -> Iterator[tuple]:
        """Rows of consecutive lines of one split: fixes under their header, those before any header as orphans."""
        if split != self.split:
            yield from self.summary()
            self.split, self.header, self.count = split, None, 0
        text = pc.utf8_trim_whitespace(lines)
        is_header = pc.match_substring_regex(text, self.pattern).to_numpy(zero_copy_only=False).astype(bool)
        filled = pc.not_equal(text, "").to_numpy(zero_copy_only=False).astype(bool)
        values = text.to_pylist()
        # the number of the header above each line, -1 where it stands in an earlier batch
        above = np.maximum.accumulate(np.where(is_header, np.arange(len(values)), -1)) if values else np.empty(0, int)
        for i in np.flatnonzero(filled & ~is_header):
            header = self.header if above[i] < 0 else values[above[i]]
            yield (*split, "orphan" if header is None else "fix", self.count + int(i), header, values[i])
        if len(above) and above[-1] >= 0:
            self.header = values[above[-1]]
        self.count += len(values)


def scan(batches: Iterator[pa.RecordBatch], header_pattern: str) -> Iterator[pa.RecordBatch]:
    """Scanned rows of (file, block, value) in order; the rows of a split follow each other."""
    state = SplitScan(header_pattern)
    names = [c.split()[0] for c in SCANNED.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def packed(rows):
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    for batch in batches:
        files, blocks, lines = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).fill_null("")
        places = list(zip(files, blocks))
        begins = [i for i in range(len(places)) if i == 0 or places[i] != places[i - 1]]
        rows = []
        for begin, end in zip(begins, [*begins[1:], len(places)]):
            rows += state.part(places[begin], lines.slice(begin, end - begin))
        yield packed(rows)
    yield packed(state.summary())


def scan_lines(
    lines: DataFrame,
    header_pattern: str = HEADER_PATTERN,
    null_wind_sentinel: bool = False,
    line_numbers: bool = False,
    folder: str | None = None,
) -> DataFrame:
    """Track table from (file, block, value), the lines of a split being together and in order, as files give them.

    The pass is run when this is called and its decoded rows are written to ``folder``, by default the session's shared folder;
    the result reads them.  ``line_numbers`` adds ``file`` and ``line_no``, the place of a fix in its file from 0.
    Lines before the first header of a file belong to no storm.
    """

    def run(batches):
        return scan(batches, header_pattern)

    scanned = lines.select("file", F.col("block").cast("long").alias("block"), "value").mapInArrow(run, SCANNED)
    table = staged(decode_fixes(scanned, null_wind_sentinel, ["file", "block", "number", "_storm", "kind"]), "best-track", ["kind"], folder)

    # one row per split of a file: its size is the text's divided by 128 MB
    splits = table.where("kind = 'split'").select("file", "block", F.col("number").alias("_lines"), "_storm")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.select(
        "file",
        "block",
        F.last("_storm", ignorenulls=True).over(earlier).alias("_inherited"),
        F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_first"),
    )
    own = [f.name for f in TRACK_SCHEMA.fields]
    orphans = table.where("kind = 'orphan'").join(before, ["file", "block"]).where("_inherited IS NOT NULL")
    found = table.where("kind = 'fix'")
    if line_numbers:
        own += ["file", "line_no"]
        found = found.join(before, ["file", "block"]).withColumn("line_no", F.col("_first") + F.col("number"))
        orphans = orphans.withColumn("line_no", F.col("_first") + F.col("number"))
    return found.select(*own).unionByName(orphans.withColumns(storm_columns("_inherited")).select(*own))


# -- lines in any order --------------------------------------------------------------------------


def parse_lines(
    lines: DataFrame,
    header_pattern: str = HEADER_PATTERN,
    null_wind_sentinel: bool = False,
) -> DataFrame:
    """Track table from (file, block, line_no, value) in any order, by a window over each split.

    For lines that files give in order ``scan_lines`` needs no exchange.  ``-999`` and empty mean missing for pressure and radii.  A missing wind is
    empty; the archive's ``-99`` stays a number unless ``null_wind_sentinel``.
    """
    trimmed = lines.withColumn("value", F.trim("value")).filter(F.col("value") != "")
    is_header = F.col("value").rlike(header_pattern)
    marked = trimmed.withColumn("_header", F.when(is_header, F.col("value")))

    in_block = (
        Window.partitionBy("file", "block")
        .orderBy("line_no")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    carried = marked.withColumn("_own", F.last("_header", ignorenulls=True).over(in_block))

    # split sizes are fixed, so this is one short row per 128 MB of text
    last_headers = marked.groupBy("file", "block").agg(
        F.max_by("_header", F.when(F.col("_header").isNotNull(), F.col("line_no"))).alias("_last")
    )
    earlier = (
        Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    inherited = last_headers.select(
        "file", "block", F.last("_last", ignorenulls=True).over(earlier).alias("_inherited")
    )
    fixes = (
        carried.filter(F.col("_header").isNull())
        .join(inherited, ["file", "block"], "left")
        .withColumn("_storm", F.coalesce("_own", "_inherited"))
        .filter(F.col("_storm").isNotNull())
    )
    return decode_fixes(fixes, null_wind_sentinel)


def _number(text: Column, missing: str | None = None) -> Column:
    number = F.when(text != "", text).try_cast("double")
    return number if missing is None else F.when(text != missing, number)


def _degrees(text: Column, negative: str) -> Column:
    """``15.0N`` to signed degrees."""
    size = F.expr("try_cast(NULL AS DOUBLE)")
    magnitude = F.when(F.length(text) > 1, F.substring(text, F.lit(1), F.length(text) - 1)).try_cast(
        "double"
    )
    return (
        F.when(text.endswith(negative), -magnitude).when(text.isNotNull(), magnitude).otherwise(size)
    )


def storm_columns(header: str) -> dict[str, Column]:
    """Id and name from the column of a header line."""
    head = F.split(header, ",")
    return {
        "storm_id": F.trim(F.try_element_at(head, F.lit(1))),
        "name": F.trim(F.try_element_at(head, F.lit(2))),
    }


def decode_fixes(fixes: DataFrame, null_wind_sentinel: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Columns from ``value`` (a fix line) and ``_storm`` (its header line), and those to ``keep``.

    Row-wise expressions only, so this part also runs on a stream of lines.
    """
    parts = F.transform(F.split("value", ","), lambda p: F.trim(p))
    split = fixes.withColumn("_parts", parts)

    def field(index):
        return F.try_element_at(F.col("_parts"), F.lit(index + 1))

    clock = field(1)
    minute = F.when(F.length(clock) == 4, F.substring(clock, 3, 2)).otherwise(F.lit("00"))
    date = field(0)

    def digits(text, start, size):
        return F.substring(text, start, size).try_cast("int")

    stamp = F.try_make_timestamp_ntz(
        digits(date, 1, 4),
        digits(date, 5, 2),
        digits(date, 7, 2),
        digits(clock, 1, 2),
        minute.try_cast("int"),
        F.lit(0),
    )
    wind = _number(field(6), MISSING_WIND if null_wind_sentinel else None)
    columns = {
        **storm_columns("_storm"),
        "timestamp": stamp,
        "record_identifier": field(2),
        "storm_type": field(3),
        "latitude": _degrees(field(4), "S"),
        "longitude": _degrees(field(5), "W"),
        "max_wind": wind,
        "min_pressure": _number(field(7), MISSING),
    }
    for offset, name in enumerate(RADII):
        columns[name] = _number(field(8 + offset), MISSING)
    return split.select(
        *[columns[f.name].cast(f.dataType).alias(f.name) for f in TRACK_SCHEMA.fields], *(keep or [])
    )
