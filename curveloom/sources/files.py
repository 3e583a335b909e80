"""Point files, ratings files and results."""

from __future__ import annotations

import csv
import io
import itertools
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import global_positions
from ..operators.runs import heads_before, running_count
from ..runtime import Stages
from .delimited import line_maps, parse_lines

#: Lines above which an open quote is taken as broken, not as a record.
RECORD_LINES = 1000


@dataclass(frozen=True)
class PointFile:
    """How a point file is laid out. Field names match regardless of case; without a header they are column numbers from 1; ROWNUM and ? mean none."""

    id_field: str = "ROWNUM"
    category_field: str = "?"
    read_header: bool = True
    separator: str = "comma"


def _positions(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_row"), F.col("value").alias("raw_line"))
    p = global_positions(t, ["file", "_at", "_row"])
    first = p.groupBy("file").agg(F.min("pos").alias("_first"))
    return p.join(F.broadcast(first), "file").select("file", "pos", (F.col("pos") - F.col("_first") + 1).alias("line_no"), "raw_line")  # a row per file


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, raw_line)`` with lines numbered from 1 in each file; splits of a file are numbered by their offsets, in parallel."""
    return _positions(spark, path).select("file", "line_no", "raw_line")


def _standard_input(spark: SparkSession, chunk: int = 100_000) -> DataFrame:
    """Lines of standard input, staged ``chunk`` by chunk, so that the driver holds one chunk."""
    work, schema, at = Stages(spark, "stdin"), "file string, pos bigint, line_no bigint, raw_line string", 0
    out = spark.createDataFrame([], schema)
    while some := list(itertools.islice(sys.stdin, chunk)):
        out = out.unionByName(work.write(spark.createDataFrame([("-", at + i, at + i + 1, x.rstrip("\n")) for i, x in enumerate(some)], schema)))
        at += len(some)
    return out


def record_lines(lines: DataFrame, separator: str = "comma", most: int = RECORD_LINES) -> DataFrame:
    """``(file, line_no, record, raw_line)``: each line of ``lines(file, pos, line_no, raw_line)`` with the number of the line on which its record begins.

    A record goes on while a quote is open. What a line does to that state from either one is a map (to open, to closed, unchanged, or reversed); the maps are
    composed over ranges of lines and across the splits of a file by running counts, so no task reads a whole file. A record of over ``most`` lines is none: its
    lines stand alone. Lines that begin with ``#`` outside a quote open none.
    """
    work = Stages(lines.sparkSession, "records")
    x = work.write(line_maps(lines, separator))
    fixed = (F.col("from_closed") == F.col("from_open")) | (F.col("line_no") == 1)
    x = work.write(running_count(x, ~fixed & F.col("from_closed"), "turns"))
    # open after a line: the state its last line with a fixed outcome left, turned as often as reversing lines came since
    left = x.where(fixed).select(F.col("pos").alias("head"), (F.col("from_closed").cast("int") + F.col("turns")).alias("v"))
    after = heads_before(x.drop("raw_line"), x.where(fixed)).join(left, "head").select("file", "pos", ((F.col("turns") + F.col("v")) % 2 == 1).alias("open"))
    before = after.where("open").select("file", (F.col("pos") + 1).alias("pos"), F.lit(True).alias("inside"))
    y = work.write(x.select("file", "pos", "line_no", "raw_line").join(before, ["file", "pos"], "left"))
    heads = heads_before(y, y.where("inside is null"))
    long = heads.groupBy("head").agg(F.count("*").alias("n"), F.min("line_no").alias("record"))
    return heads.join(long, "head").select("file", "line_no", F.when(F.col("n") <= most, F.col("record")).otherwise(F.col("line_no")).alias("record"), "raw_line")


def read_points(spark: SparkSession, path: str, layout: PointFile = PointFile()) -> tuple[DataFrame, DataFrame]:
    """Readable points ``(id, category, coords, line_no)`` of a file, or of stdin (``-``), and the lines that can't be read ``(line_no, reason, offset)``.

    A quoted field may hold line breaks: lines that an open quote joins are read as one record, numbered by its first line. If they make no valid record they are read one by one, so
    a broken quote costs its own line only. Input without lines gives no rows.
    """
    if path == "-":
        lines = _standard_input(spark)
    else:
        lines = _positions(spark, path)
    lines = Stages(spark, "lines").write(lines)
    rec = Stages(spark, "records").write(record_lines(lines, layout.separator))
    head = rec.where("line_no = record and not startswith(raw_line, '#') and trim(raw_line) <> ''").orderBy("file", "record").limit(1).collect()
    names = []
    if head:
        first = rec.where((F.col("file") == head[0].file) & (F.col("record") == head[0].record)).orderBy("line_no").collect()  # one record
        text = "\n".join(r.raw_line for r in first).rstrip("\r").lstrip("\ufeff")
        names = [c.strip() for c in next(csv.reader(io.StringIO(text), delimiter="\t" if layout.separator == "tab" else ","))]
    conf = spark.createDataFrame([(0, layout.read_header, layout.id_field, layout.category_field, layout.separator, len(names), names if layout.read_header else None)], "file_id int, read_header boolean, id_field string, category_field string, field_sep string, n_columns int, column_names array<string>")
    joined = rec.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("line_no", "raw_line"))).alias("x")).where("size(x) > 1")
    joined = joined.select(F.lit(0).alias("file_id"), F.col("record").alias("line_no"), F.array_join(F.transform("x", lambda v: v["raw_line"]), "\n").alias("raw_line"))
    whole = Stages(spark, "whole").write(parse_lines(joined, conf).where("reason is null"))
    alone = rec.join(whole.select(F.col("line_no").alias("record")), "record", "left_anti")
    out = parse_lines(alone.select(F.lit(0).alias("file_id"), "line_no", "raw_line"), conf).unionByName(whole)
    return out.where("reason is null").select("id", "category", "coords", "line_no"), out.where("reason is not null").select("line_no", "reason", "offset")


def write_points(points: DataFrame, path: str, dims: int, names: tuple[str, str] = ("id", "category"), header: bool = True, order: str = "line_no") -> None:
    """``id,category,col0,...`` in input order: one file for a small result, else range-sorted parts whose names keep the order. ``""`` and ``?`` write nothing."""
    if path in ("", "?", None):
        return
    cols = [F.col("id").alias(names[0]), F.col("category").alias(names[1]), *[F.get("coords", F.lit(i)).alias(f"col{i}") for i in range(dims)]]
    out = points.orderBy(order).select(*cols)
    if path == "-":
        if header:
            print(",".join(out.columns))
        for row in out.toLocalIterator():
            print(",".join("" if v is None else str(v) for v in row))
    else:
        out.write.mode("overwrite").csv(path, header=header)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """``(movie, user, rating, date)`` of files whose first line is ``movie:`` and whose others are ``user,rating,date``."""
    lines = numbered_lines(spark, path)
    movie = lines.where("line_no = 1").select("file", F.expr("try_cast(rtrim(':', raw_line) as int)").alias("movie"))
    f = F.split("raw_line", ",")
    body = lines.where("line_no > 1 and raw_line like '%,%'").select("file", F.expr("try_cast(split(raw_line, ',')[0] as int)").alias("user"), F.expr("try_cast(split(raw_line, ',')[1] as int)").alias("rating"), f[2].alias("date"))
    return body.join(movie, "file").select("movie", "user", "rating", "date")


def read_probe(spark: SparkSession, path: str) -> DataFrame:
    """``(movie, user)``: lines that end in a colon open a group, the others are its members. The group is carried over by line number in each file."""
    lines = numbered_lines(spark, path).withColumn("movie", F.when(F.col("raw_line").endswith(":"), F.expr("try_cast(rtrim(':', raw_line) as int)")))
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("m", F.last("movie", ignorenulls=True).over(w)).where("movie is null").select(F.col("m").alias("movie"), F.expr("try_cast(raw_line as int)").alias("user"))
