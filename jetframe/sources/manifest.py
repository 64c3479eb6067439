"""Source manifests: headerless, sorted, LF-terminated TSV files with strict bytes.

Manifests on disk of any size are read by byte ranges, aligned to line feeds by Spark's text reader. Line
numbers are exact: the lines of every range are counted and the counts added up. What the reader
takes away (a byte order mark, the last line feed) shows in the bytes that are missing.
Manifests that are values of a table (``path, content``) go through the same rules.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jetframe.functions.identity import CHECKSUM_FORMAT
from jetframe.rules import broken_rules, union_all

BOM_HEX = "EFBBBF"
INTEGER = r"^\s*[+-]?\d+(_\d+)*\s*$"


def read_manifest_bytes(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content)``: one row per manifest file, so that byte rules can be checked."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def byte_violations(files: DataFrame) -> DataFrame:
    """Rules on a whole file: BOM, line ends, UTF-8."""
    content = F.col("content")
    cr = F.position(F.lit(b"\r"), content) > 0
    return broken_rules(
        files,
        F.col("path"),
        {
            "MANIFEST_BOM": F.hex(F.substring(content, 1, 3)) == BOM_HEX,
            "MANIFEST_LINE_ENDING": (F.length(content) == 0)
            | cr
            | (F.hex(F.substring(content, -1, 1)) != "0A"),
            "MANIFEST_UTF8": ~F.is_valid_utf8(content.cast("string")),
        },
    )


def size_of_ranges(files: DataFrame, least: int, most_ranges: int = 1024) -> int:
    """Bytes of a range: ``least``, or more where that would cut files ``(path, length)`` into more than about
    ``most_ranges``.  Every range is a task and a stored file, which many tiny ones would be all cost."""
    total = files.agg(F.sum("length").alias("bytes")).first()["bytes"] or 0
    return max(least, -(-total // most_ranges))


@contextmanager
def range_size(spark: SparkSession, size: int) -> Iterator[None]:
    """Within it, files are cut into ranges of ``size`` bytes; a table must be stored to keep the cut."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """``(path, range, at, value, file_size)``: raw lines with the byte range that held them.

    ``at`` grows by one from line to line of a range.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("at"),
        "value",
        F.col("_metadata.file_size").alias("file_size"),
    )


def range_counts(ranges: DataFrame) -> DataFrame:
    """``(path, range, first, before, missing)``: a range's first ``at``, the lines before it, and the bytes
    of the file that its lines and their line feeds do not account for."""
    counted = ranges.groupBy("path", "range").agg(
        F.min("at").alias("first"),
        F.count("*").alias("lines"),
        F.sum(F.octet_length("value") + 1).alias("bytes"),
        F.max("file_size").alias("file_size"),
    )
    earlier = Window.partitionBy("path").orderBy("range")
    whole = Window.partitionBy("path")
    return counted.select(
        "path",
        "range",
        "first",
        (F.sum("lines").over(earlier) - F.col("lines")).alias("before"),
        (F.max("file_size").over(whole) - F.sum("bytes").over(whole)).alias("missing"),
    )


# A mark that the reader took away is missing; a last line feed that is not there was counted too much.
MARKED, MARKED_OPEN, OPEN = 3, 2, -1


def numbered_lines(ranges: DataFrame) -> DataFrame:
    """``(path, range, line_no, line)`` with exact 1-based line numbers, whatever the ranges."""
    placed = ranges.join(range_counts(ranges), ["path", "range"])
    number = F.col("before") + F.col("at") - F.col("first") + 1
    marked = F.col("missing").isin(MARKED, MARKED_OPEN) & (number == 1)
    line = F.when(marked, F.concat(F.lit("\ufeff"), "value")).otherwise(F.col("value"))
    return placed.select("path", "range", number.alias("line_no"), line.alias("line"))


def range_byte_violations(ranges: DataFrame, files: DataFrame) -> DataFrame:
    """The rules on whole files, from their ranges; ``files`` lists ``(path, length)``, empty files too."""
    by_file = ranges.groupBy("path").agg(
        F.max(F.position(F.lit("\r"), F.col("value")) > 0).alias("cr"),
        F.max(~F.is_valid_utf8("value")).alias("broken"),
    )
    missing = range_counts(ranges).groupBy("path").agg(F.max("missing").alias("missing"))
    joined = (
        files.select("path", "length").join(by_file, "path", "left").join(missing, "path", "left")
    )
    # A file without a line is empty or a mark alone.
    alone = F.col("missing").isNull()
    return broken_rules(
        joined,
        F.col("path"),
        {
            "MANIFEST_BOM": F.col("missing").isin(MARKED, MARKED_OPEN) | (alone & (F.col("length") == 3)),
            "MANIFEST_LINE_ENDING": alone | F.col("cr") | F.col("missing").isin(OPEN, MARKED_OPEN),
            "MANIFEST_UTF8": F.col("broken"),
        },
    )


def range_violations(ranges: DataFrame, files: DataFrame) -> DataFrame:
    """All rules on manifests read by ranges."""
    return union_all(
        [range_byte_violations(ranges, files), line_violations(parse_lines(numbered_lines(ranges)))]
    )


def _value_lines(files: DataFrame) -> DataFrame:
    """``(path, lines)``: the lines of manifests that are values."""
    text = F.col("content").cast("string")
    ended = F.when(text.endswith("\n"), 1).otherwise(0)
    body = F.substring(text, F.lit(1), F.length(text) - ended)
    return files.select("path", F.split(body, "\n", -1).alias("lines"))


def manifest_lines(files: DataFrame) -> DataFrame:
    """``(path, range, line_no, line)`` with exact 1-based line numbers; a value is one range."""
    return _value_lines(files).select("path", F.posexplode("lines").alias("i", "line")).select(
        "path", F.lit(0).cast("bigint").alias("range"), (F.col("i") + 1).alias("line_no"), "line"
    )


def _number(text: Column) -> Column:
    return F.when(text.rlike(INTEGER), F.trim(text).try_cast("bigint"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Fields of every line; values that do not parse are null."""
    f = F.split("line", "\t", -1)
    return lines.select(
        "path",
        "range",
        "line_no",
        F.size(f).alias("n_fields"),
        f.alias("fields"),
        _number(F.get(f, F.lit(0))).alias("record_id"),
        F.get(f, F.lit(1)).alias("canonical_pfn"),
        F.get(f, F.lit(2)).alias("adler32"),
        _number(F.get(f, F.lit(3))).alias("size_bytes"),
    )


def range_disorder(good: DataFrame) -> DataFrame:
    """``(path, line_no)`` of lines that stand after a greater one, for manifests read by ranges.

    Neighbours are compared inside a range; the last line of a range meets the first of the next in a
    table with one row per range.
    """
    here = F.struct("record_id", "canonical_pfn")
    inside = Window.partitionBy("path", "range").orderBy("line_no")
    within = good.withColumn("before", F.lag(here).over(inside)).filter(F.col("before") > here)
    ends = good.groupBy("path", "range").agg(
        F.min("line_no").alias("line_no"),
        F.min_by(here, "line_no").alias("first"),
        F.max_by(here, "line_no").alias("last"),
    )
    between = ends.withColumn(
        "before", F.lag("last").over(Window.partitionBy("path").orderBy("range"))
    ).filter(F.col("before") > F.col("first"))
    return within.select("path", "line_no").union(between.select("path", "line_no"))


def _good_values(files: DataFrame) -> DataFrame:
    """``(path, good)``: the lines of manifests that are values whose fields are filled and parse."""

    def told(f: Column, i: Column) -> Column:
        record, size = _number(F.get(f, F.lit(0))), _number(F.get(f, F.lit(3)))
        filled = (F.size(f) == 4) & ~F.exists(f, lambda x: x == "")
        return F.struct(
            (filled & record.isNotNull() & size.isNotNull()).alias("good"),
            F.struct(record.alias("record_id"), F.get(f, F.lit(1)).alias("canonical_pfn")).alias("here"),
            (i + 1).alias("line_no"),
        )

    fields = F.transform("lines", lambda line: F.split(line, "\t", -1))
    return _value_lines(files).select("path", F.filter(F.transform(fields, told), lambda s: s["good"]).alias("good"))


def _neighbours(name: str, told: Callable[[Column, Column], Column]) -> Column:
    """What ``told`` says of neighbouring elements of an array, where it is not null."""
    pairs = F.greatest(F.size(name) - 1, F.lit(0))
    return F.array_compact(F.zip_with(F.slice(name, F.lit(1), pairs), F.slice(name, F.lit(2), pairs), told))


def value_disorder(files: DataFrame) -> DataFrame:
    """The same for manifests that are values: neighbours meet in their row, nothing is shuffled or sorted."""
    turned = _neighbours("good", lambda a, b: F.when(a["here"] > b["here"], b["line_no"]))
    return _good_values(files).select("path", F.explode(turned).alias("line_no"))


def value_repeats(files: DataFrame) -> DataFrame:
    """``(path, canonical_pfn, n)`` of names that repeat in a manifest that is a value.

    Names are ordered in their row, and only those equal to the one before are counted, so a shuffle holds
    repeats alone and not every name.
    """
    names = _good_values(files).select(
        "path", F.array_sort(F.transform("good", lambda s: s["here"]["canonical_pfn"])).alias("names")
    )
    again = _neighbours("names", lambda a, b: F.when(a == b, b))
    return (
        names.select("path", F.explode(again).alias("canonical_pfn"))
        .groupBy("path", "canonical_pfn")
        .agg((F.count(F.lit(1)) + 1).alias("n"))
    )


def line_violations(
    parsed: DataFrame, disorder: DataFrame | None = None, repeats: DataFrame | None = None
) -> DataFrame:
    """Rules on lines, repeated files and the order of neighbouring lines, per manifest.

    Order is by record, then by the UTF-8 bytes of the name, which is how Spark compares
    strings.  ``disorder`` and ``repeats`` have the lines out of order and the repeated
    names where they are known already.  Repeated names are counted with a map-side combined aggregate.
    """
    key = F.concat_ws(":", "path", F.col("line_no").cast("string"))
    four = F.col("n_fields") == 4
    filled = four & ~F.exists("fields", lambda x: x == "")
    numbers = F.col("record_id").isNotNull() & F.col("size_bytes").isNotNull()
    ok = filled & numbers
    rows = broken_rules(
        parsed,
        key,
        {
            "MANIFEST_FIELD_COUNT": ~four,
            "MANIFEST_EMPTY_FIELD": four & F.exists("fields", lambda x: x == ""),
            "MANIFEST_FIELD_VALUE": filled & ~numbers,
            "MANIFEST_RECORD_ID": ok & (F.col("record_id") <= 0),
            "MANIFEST_CHECKSUM": ok & ~F.col("adler32").rlike(CHECKSUM_FORMAT),
            "MANIFEST_SIZE": ok & (F.col("size_bytes") <= 0),
        },
    )
    good = parsed.filter(filled & numbers)
    if repeats is None:
        repeats = good.groupBy("path", "canonical_pfn").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = repeats.select(
        F.lit("MANIFEST_DUPLICATE_PFN").alias("rule"),
        F.concat_ws(":", "path", "canonical_pfn").alias("key"),
        F.concat(F.lit("count="), F.col("n").cast("string")).alias("detail"),
    )
    found = range_disorder(good) if disorder is None else disorder
    out_of_order = found.select(F.lit("MANIFEST_ORDER").alias("rule"), key.alias("key"), F.lit("").alias("detail"))
    return union_all([rows, repeated, out_of_order])


def manifest_violations(files: DataFrame) -> DataFrame:
    lines = parse_lines(manifest_lines(files))
    return union_all([byte_violations(files), line_violations(lines, value_disorder(files), value_repeats(files))])


def manifest_hash(files: DataFrame) -> DataFrame:
    """SHA-256 of the exact bytes of every manifest."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Parsed rows of manifests that :func:`manifest_violations` finds clean."""
    return parse_lines(manifest_lines(read_manifest_bytes(spark, path))).select(
        "path", "line_no", "record_id", "canonical_pfn", "adler32", "size_bytes"
    )
