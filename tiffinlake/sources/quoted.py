"""CSV records with quoted line breaks, from files that many tasks read at once.

A line break ends a record unless it lies inside quotes, and whether it does depends on everything before it in
its file. A task that reads a byte range from the middle can't know. It can tell, though, what its range does to
either state: where records would begin and end if the range began outside quotes, and if it began inside. Lines
are cut into pieces inside of which no record begins either way, each stored once with both answers. One small
row per range says how it ends in either case; chaining these along a file gives every range its true
state. Pieces that begin and end a record are records; the others, few, are put together in order.

A quote opens a field only at its start and doubles stand for one, as the reader of single lines has it. Quotes
that never close make the rest of a file one record, as they do for any reader.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .tables import stored

LINEAGE = "file string, modified timestamp"
PIECE = f"{LINEAGE}, block long, at long, text string, out_starts boolean, out_ends boolean, in_starts boolean, in_ends boolean"
#: Rows of a batch that tasks give back.
ROWS = 5000


def inside_after(line: str, inside: bool) -> bool:
    """Whether a line leaves off inside quotes, by whether it begins there."""
    at = 0
    while True:
        if inside:
            quote = line.find('"', at)
            if quote < 0:
                return True
            if line.startswith('"', quote + 1):
                at = quote + 2
                continue
            inside, at = False, quote + 1
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        comma = line.find(",", at)
        if comma < 0:
            return False
        at = comma + 1


def cut_into_pieces(lines: Iterator[str]) -> Iterator[tuple[str, bool, bool, bool, bool]]:
    """(text, record begins, ends if the range began outside quotes; the same if it began inside)."""
    outer, inner = False, True  # inside quotes now, by how the range began
    text: list[str] = []
    starts = (True, False)
    for line in lines:
        if text and not (outer and inner):
            yield "\n".join(text), starts[0], not outer, starts[1], not inner
            text, starts = [], (not outer, not inner)
        text.append(line)
        if '"' in line:
            outer, inner = inside_after(line, outer), inside_after(line, inner)
    if text:
        yield "\n".join(text), starts[0], not outer, starts[1], not inner


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in the order of their files to pieces; a task may read several ranges, one after the other."""
    names = ["file", "modified", "block", "at", "text", "out_starts", "out_ends", "in_starts", "in_ends"]

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def ranges() -> Iterator[tuple]:
        """(lineage and place of a range, its lines): lines have to be taken before the next range is."""
        source = rows()
        row = next(source, None)
        while row is not None:
            head = row[1:]

            def lines() -> Iterator[str]:
                nonlocal row
                while row is not None and row[1:] == head:
                    yield row[0]
                    row = next(source, None)

            yield head, lines()

    types = [pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.int64(), pa.string(), *[pa.bool_()] * 4]
    out: list[tuple] = []
    for (file, modified, block), lines in ranges():
        for at, piece in enumerate(cut_into_pieces(lines)):
            out.append((file, modified, block, at, *piece))
            if len(out) == ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """record, file, modified, first: the records of files as texts; ``first`` marks the first of each file."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    pieces = stored(lines.mapInArrow(_pieces, PIECE), "csv-pieces")
    # The last piece of a range tells how it ends; along a file, ranges follow each other.
    last = F.max(F.struct("at", "out_ends", "in_ends"))
    ranges = pieces.groupBy("file", "block").agg(last.alias("z")).select("file", "block", "z.out_ends", "z.in_ends")
    along = Window.partitionBy("file").orderBy("block")
    # A range that ends alike in both cases fixes the state, others pass it on: what counts is the last one that
    # fixes it and how many turn it round since.
    fixes = F.when(F.col("out_ends") == F.col("in_ends"), F.struct("block", "out_ends"))
    turns = F.when((F.col("out_ends") != F.col("in_ends")) & ~F.col("out_ends"), 1).otherwise(0)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("turned", F.sum(turns).over(along)).withColumn(
        "fixed", F.last(F.when(fixes.isNotNull(), F.struct("out_ends", "turned")), ignorenulls=True).over(before)
    )
    since = F.coalesce(F.lag("turned").over(along), F.lit(0)) - F.coalesce("fixed.turned", F.lit(0))
    outside = F.coalesce("fixed.out_ends", F.lit(True)) == (since % 2 == 0)
    states = ranges.select("file", "block", outside.alias("outside"))
    told = pieces.join(states, ["file", "block"]).select(
        "file", "modified", "block", "at", "text",
        F.when(F.col("outside"), F.col("out_starts")).otherwise(F.col("in_starts")).alias("starts"),
        F.when(F.col("outside"), F.col("out_ends")).otherwise(F.col("in_ends")).alias("ends"),
    )
    whole = told.filter("starts AND ends").select("text", "file", "modified", "block", "at")
    parts = told.filter("NOT (starts AND ends)")
    number = F.sum(F.col("starts").cast("int")).over(Window.partitionBy("file").orderBy("block", "at"))
    joined = parts.withColumn("number", number).groupBy("file", "modified", "number").agg(
        F.array_sort(F.collect_list(F.struct("block", "at", "text"))).alias("parts")
    )
    joined = joined.select(
        F.array_join("parts.text", "\n").alias("text"), "file", "modified",
        F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["at"].alias("at"),
    )
    text = F.regexp_replace(F.regexp_replace("text", r"\r$", ""), "\r\n", "\n")
    found = whole.unionByName(joined).select(
        text.alias("record"), "file", "modified", ((F.col("block") == 0) & (F.col("at") == 0)).alias("first")
    )
    return found.filter("record <> ''")
