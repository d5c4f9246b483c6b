"""Report files as ordered lines, and the order-dependent operators over them.

Files are read by the splittable text source, so that a file of any size is spread over tasks. A line is placed by its
file, the block it was read from and its position in the block. Operators that depend on line order work block by block
and carry the state of earlier blocks in from a small per-block summary; no task ever holds a whole file.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import rules
from ..functions.scalar import strip
from ..session import stage

PLACE = ["path", "block", "pos"]
_BLOCK = ["path", "block"]
BLOCK = 4 << 20  # most bytes of a block of a named source: the lines of a block are held by one task, in ten times as many bytes


@contextmanager
def block_bytes(spark: SparkSession, most: int = BLOCK):
    """Files read inside are cut into blocks of at most ``most`` bytes, or fewer where the session says so."""
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(old) <= most:
        yield
        return
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def scan(reader, path: str | Sequence[str], glob: str = "*.csv") -> DataFrame:
    """Raw text rows with their file metadata from ``spark.read`` or ``spark.readStream``."""
    text = reader.format("text").option("lineSep", "\n").option("pathGlobFilter", glob).load(path)
    meta = F.col("_metadata")
    return text.select(meta["file_path"].alias("path"), meta["file_name"].alias("file"), meta["file_size"].alias("file_size"),
                       meta["file_block_start"].alias("block"), F.col("value").cast("binary").alias("bytes"))


def place(raw: DataFrame) -> DataFrame:
    """Add the position of each row inside its block. Must directly follow the scan."""
    return raw.withColumn("pos", F.monotonically_increasing_id())


def read_lines(spark: SparkSession, path: str | Sequence[str], glob: str = "*.csv") -> DataFrame:
    """Lines of all files of a folder: file, path, file_size, block, pos, bytes, line."""
    return decode(place(scan(spark.read, path, glob)))


def folders(spark: SparkSession, path: str) -> dict[str, str]:
    """Path by name of the folders in a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().getName(): s.getPath().toString() for s in fs.listStatus(at) if s.isDirectory()}


def scan_parts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Raw rows of a folder as Spark writes one (``part-<number>...``), as those of one file of that name with its parts in order."""
    raw = place(scan(spark.read, folder, "part-*"))
    part = F.regexp_extract(F.substring_index("path", "/", -1), r"^part-(\d+)", 1).cast("long")
    return raw.withColumns({"block": F.shiftleft(part, 40) + F.col("block"), "path": F.lit(folder), "file": F.lit(name)})


def decode(placed: DataFrame) -> DataFrame:
    """Text of each line: UTF-8 if the whole file is valid UTF-8, else Latin-1. White space at the ends is removed."""
    valid = placed.groupBy("path").agg(F.bool_and(F.is_valid_utf8(F.col("bytes").cast("string"))).alias("_utf8"))
    latin = stage(valid.where("NOT _utf8"), "latin_files")  # a row per file, so the join goes by a known size and lines stay where they are
    text = F.when(F.col("_utf8").isNull(), F.decode("bytes", "UTF-8")).otherwise(F.decode("bytes", "ISO-8859-1"))
    return placed.join(latin, "path", "left").withColumn("line", strip(text)).drop("_utf8")


def list_files(spark: SparkSession, path: str | Sequence[str], glob: str = "*.csv") -> DataFrame:
    """path and file of all files of a folder, empty ones too, from the file index that the driver holds anyway."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).inputFiles()
    listed = spark.createDataFrame([(p,) for p in found], "path string")
    return listed.withColumn("file", F.url_decode(F.substring_index("path", "/", -1)))


def number_lines(placed: DataFrame) -> DataFrame:
    """Add ``line_no``, the place of each line in its file from 0, whatever blocks the file was read in."""
    blocks = placed.groupBy(*_BLOCK).agg(F.min("pos").alias("_p0"), F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = stage(blocks.select(*_BLOCK, "_p0", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")), "block_starts")
    return placed.join(starts, _BLOCK).withColumn("line_no", F.col("pos") - F.col("_p0") + F.col("_before")).drop("_p0", "_before")


def fingerprints(placed: DataFrame) -> DataFrame:
    """One hash per file over its whole content, the same however the file is split into blocks.

    Adds up two 64-bit hashes of every line and its number, which combines map side and needs no file in one task.
    """
    keyed = number_lines(placed).select("path", "file", "file_size", F.xxhash64("line_no", "bytes").alias("h1"), F.xxhash64(F.lit("2"), "bytes", "line_no").alias("h2"))
    wide = "decimal(38,0)"
    return keyed.groupBy("path", "file", "file_size").agg(F.sum(F.col("h1").cast(wide)).alias("a"), F.sum(F.col("h2").cast(wide)).alias("b")).select(
        "path", "file", F.md5(F.concat_ws("|", "file_size", "a", "b").cast("binary")).alias("hash"))


def first_lines(lines: DataFrame, n: int = 5) -> DataFrame:
    """The first n lines of each file as an array ``head``."""
    order = W.partitionBy(*_BLOCK).orderBy("pos")
    head = lines.where("block = 0").withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= n)
    listed = F.array_sort(F.collect_list(F.struct("_i", "line")))
    return head.groupBy("path", "file").agg(F.transform(listed, lambda x: x["line"]).alias("head"))


# ---------------------------------------------------------------- operators over the order of lines

def carry(lines: DataFrame, headers: Mapping[str, tuple[Column, Column]], resets: Mapping[str, Sequence[str]] | None = None,
          counts: Mapping[str, Column] | None = None) -> DataFrame:
    """Value of the latest header line at or before each line, per name in ``headers`` (is-header test, value).

    ``resets`` lists for a name the headers that clear it: a value older than such a header is dropped. ``counts`` adds per
    name the number of lines of the file, up to and including each line, that meet a test.
    """
    resets, counts = resets or {}, counts or {}
    at = F.struct("block", "pos")
    df = lines.withColumns({**{f"_h_{n}": F.when(test, F.struct(at.alias("at"), value.alias("v"))) for n, (test, value) in headers.items()},
                            **{f"_n_{n}": F.when(test, 1).otherwise(0).cast("long") for n, test in counts.items()}})
    here = W.partitionBy(*_BLOCK).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    summary = df.groupBy(*_BLOCK).agg(
        *[F.max_by(f"_h_{n}", F.when(F.col(f"_h_{n}").isNotNull(), F.col("pos"))).alias(f"_c_{n}") for n in headers],
        *[F.sum(f"_n_{n}").alias(f"_b_{n}") for n in counts])
    summary = summary.select(*_BLOCK, *[F.last(f"_c_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in headers],
                             *[F.coalesce(F.sum(f"_b_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in counts])
    df = df.withColumns({**{f"_s_{n}": F.last(f"_h_{n}", ignorenulls=True).over(here) for n in headers},
                         **{f"_r_{n}": F.sum(f"_n_{n}").over(here) for n in counts}}).join(summary, _BLOCK)
    df = df.withColumns({f"_s_{n}": F.coalesce(f"_s_{n}", f"_c_{n}") for n in headers})

    def value_of(name: str) -> Column:
        value = F.col(f"_s_{name}.v")
        for other in resets.get(name, ()):
            older = F.col(f"_s_{other}").isNotNull() & (F.col(f"_s_{other}.at") > F.col(f"_s_{name}.at"))
            value = F.when(~older, value)
        return value

    return (df.withColumns({**{n: value_of(n) for n in headers}, **{n: F.col(f"_r_{n}") + F.col(f"_b_{n}") for n in counts}})
            .drop(*[f"{p}{n}" for p in ("_h_", "_c_", "_s_") for n in headers], *[f"{p}{n}" for p in ("_n_", "_b_", "_r_") for n in counts]))


def previous(lines: DataFrame, value: Column, out: str) -> DataFrame:
    """The value on the line before, across blocks; NULL on the first line of a file."""
    df = lines.withColumn("_v", value)
    order = W.partitionBy(*_BLOCK).orderBy("pos")
    last = df.groupBy(*_BLOCK).agg(F.max_by(F.struct("_v"), "pos").alias("_l"))
    last = last.select(*_BLOCK, F.lag("_l").over(W.partitionBy("path").orderBy("block"))["_v"].alias("_before"))
    first = F.row_number().over(order) == 1
    return (df.withColumn("_lag", F.lag("_v").over(order)).withColumn("_first", first).join(last, _BLOCK)
            .withColumn(out, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_lag")))
            .drop("_v", "_lag", "_first", "_before"))


def following(lines: DataFrame, value: Column, n: int, out: str) -> DataFrame:
    """Array of the values on the next n lines, across blocks; shorter at the end of a file."""
    df = lines.withColumn("_v", F.struct(value.alias("v")))
    order = W.partitionBy(*_BLOCK).orderBy("pos")
    leads = F.array_compact(F.array(*[F.lead("_v", i).over(order) for i in range(1, n + 1)]))
    df = df.withColumn("_next", leads).withColumn("_i", F.row_number().over(order))
    starts = df.where(F.col("_i") <= n).groupBy(*_BLOCK).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias("_start"))
    blocks = W.partitionBy("path").orderBy("block")
    nothing = F.array().cast("array<struct<v:string>>")
    later = starts.select(*_BLOCK, F.flatten(F.array(*[F.coalesce(F.lead("_start", i).over(blocks), nothing) for i in range(1, n + 1)])).alias("_later"))
    joined = F.slice(F.concat("_next", F.coalesce("_later", nothing)), 1, n)
    return (df.join(later, _BLOCK).withColumn(out, F.transform(joined, lambda x: x["v"])).drop("_v", "_next", "_i", "_later"))


# ---------------------------------------------------------------- line classes and cells

def classify(lines: DataFrame, footer: str = rules.FOOTER) -> DataFrame:
    """Boolean columns for page breaks, footers, blank lines, noise (any of these), date lines and total lines."""
    line = F.col("line")
    page, foot, blank = line.rlike(rules.PAGE_BREAK), line.rlike(footer), strip(F.translate(line, ",", "")) == ""
    return lines.withColumns({"is_page_break": page, "is_footer": foot, "is_blank": blank, "is_noise": page | foot | blank,
                              "is_date_line": line.rlike(rules.DATE_LINE), "is_total": line.rlike(rules.TOTAL_LINE)})


N_NAMED = 4
# A quoted cell: quotes inside are doubled. Written without a choice per character, which is slow and deep on long cells.
QUOTED = r'"[^"]*(?:""[^"]*)*"'


def split_cells(lines: DataFrame) -> DataFrame:
    """All cells of a CSV line as the array ``cells``, quotes honoured, trimmed, empty as NULL.

    The first four are also columns c0 to c3; n_cells counts the cells on the line.
    """
    line = F.col("line")
    # Each cell is taken with the comma before it, so no match is empty.
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(rf",({QUOTED}(?=,|$)|[^,]*)"), 1)

    def clean(x: Column) -> Column:
        quoted = x.startswith('"') & x.rlike('^".*"$') & (F.length(x) > 1)
        return F.nullif(strip(F.when(quoted, F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)), F.lit(""))

    unquoted = F.when(line.contains('"'), F.regexp_replace(line, QUOTED, "")).otherwise(line)
    commas = F.length(unquoted) - F.length(F.translate(unquoted, ",", "")) + 1
    # An unquoted first cell ends at the first comma: header tests need no CSV parsing, so c0 does not read _raw. The other named cells
    # are taken one by one, so that a reader of these alone does not make the array.
    first = F.when(line.startswith('"'), F.get(F.transform(raw, clean), F.lit(0))).otherwise(F.nullif(strip(F.substring_index(line, ",", 1)), F.lit("")))
    return (lines.withColumn("_raw", raw)
            .withColumns({"cells": F.transform("_raw", clean), "n_cells": commas, "c0": first, **{f"c{i}": clean(F.get("_raw", F.lit(i))) for i in range(1, N_NAMED)}})
            .drop("_raw"))


def is_label() -> Column:
    """Only the first cell of the line holds text."""
    return F.col("c0").isNotNull() & ~F.exists(F.slice("cells", 2, F.greatest(F.size("cells"), F.lit(1))), lambda c: c.isNotNull())
