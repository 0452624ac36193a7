"""CSV whose cells may hold line breaks, read in parallel by quote parity (SRC-01..07).

A line break ends a record only where an even number of quote marks lies before it. So

1. Spark reads the files as lines, split as it likes (any file system), and counts the quote marks of each split;
2. the counts, one row for each split, tell which splits begin inside a quoted cell;
3. each task cuts its splits into records; what a split's edge cuts in two comes out as pieces, which are put together by
   file and place;
4. each record is parsed by Spark's CSV parser, doubled quote marks and commas in cells included.

Files in which no line has an odd number of quote marks need none of this: Spark's reader takes them as they are.

Quote marks must follow RFC 4180 (they enclose a cell, and are doubled inside one). A file that ends inside a cell is refused. An
empty line is no record. Line breaks in cells are kept as written; a carriage return before a record's end is not part of it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OPTIONS = {"escape": '"', "multiLine": "true"}
#: a whole record, the end of one that began in an earlier split, the beginning of one that ends later, and what lies between
WHOLE, END, BEGIN, BETWEEN = 0, 1, 2, 3
_PIECES = "file string, start bigint, kind int, header boolean, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select("_metadata.file_path", "_metadata.file_block_start", "value").toDF("file", "start", "value")


def _quotes():
    return F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))


def has_line_breaks(lines: DataFrame) -> bool:
    """Whether some line has an odd number of quote marks."""
    return not lines.where(_quotes() % 2 == 1).isEmpty()


def _inside(lines: DataFrame) -> set[tuple[str, int]]:
    """The splits that begin inside a cell (the driver gets one number for each split)."""
    out, file, parity = set(), None, 0
    for r in lines.groupBy("file", "start").agg((F.sum(_quotes()) % 2).alias("odd")).orderBy("file", "start").toLocalIterator():
        if r["file"] != file:
            _even(file, parity)
            file, parity = r["file"], 0
        if parity:
            out.add((file, r["start"]))
        parity ^= r["odd"]
    _even(file, parity)
    return out


def _even(file: str | None, parity: int) -> None:
    if parity:
        raise ValueError(f"{file}: a quote mark is not closed")


class _Cutter:
    """Cuts the lines of one split after another into records and pieces."""

    def __init__(self, inside: set[tuple[str, int]]):
        self.inside = inside
        self.split: tuple[str, int] | None = None
        self.rows: list[tuple] = []

    def begin(self, split: tuple[str, int]) -> None:
        self.split, self.state, self.open = split, split in self.inside, []
        self.kind = END if self.state else WHOLE  # of the record whose lines are being gathered
        self.header = split[1] == 0

    def end(self) -> None:
        if self.split and self.open:
            self._put(BETWEEN if self.kind == END else BEGIN, "\n".join(self.open))

    def _put(self, kind: int, record: str) -> None:
        if kind in (WHOLE, END):
            record = record.removesuffix("\r")
        if kind != WHOLE or record:
            self.rows.append((*self.split, kind, self.header, record))
            self.header = False

    def lines(self, values: pa.Array) -> None:
        odd = pc.count_substring(values, '"').to_numpy(zero_copy_only=False) & 1
        open_after = (np.cumsum(odd) + self.state) & 1
        ends = np.flatnonzero(open_after == 0)
        texts = values.to_pylist()
        at = 0
        for e in ends.tolist():
            self._put(self.kind, "\n".join([*self.open, *texts[at : e + 1]]))
            self.kind, self.open, at = WHOLE, [], e + 1
        self.open += texts[at:]
        self.state = bool(open_after[-1]) if len(texts) else self.state

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * 5
        self.rows = []
        types = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "start", "kind", "header", "record"])


def _cut(inside: set[tuple[str, int]]):
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(inside)
        for batch in batches:
            files, starts = batch.column("file").to_pylist(), batch.column("start").to_numpy()
            edges = [0, *(i for i in range(1, len(files)) if starts[i] != starts[i - 1] or files[i] != files[i - 1]), len(files)]
            for a, b in zip(edges, edges[1:], strict=False):
                split = files[a], int(starts[a])
                if split != cutter.split:
                    cutter.end()
                    cutter.begin(split)
                cutter.lines(batch.column("value").slice(a, b - a))
            yield cutter.batch()
        cutter.end()
        yield cutter.batch()

    return cut


def records(lines: DataFrame) -> DataFrame:
    """``header, record``: the records of all files; ``header`` marks the first one of each."""
    pieces = lines.mapInArrow(_cut(_inside(lines)), _PIECES)
    # pieces: two for each split at most. Each beginning opens a record, which goes up to the next one
    begun = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    cut = pieces.where(F.col("kind") != WHOLE).withColumn("number", F.sum((F.col("kind") == BEGIN).cast("int")).over(begun))
    whole = cut.groupBy("file", "number").agg(
        F.max("header").alias("header"), F.array_sort(F.collect_list(F.struct("start", "kind", "record"))).alias("parts")
    )
    joined = whole.select("header", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    return pieces.where(F.col("kind") == WHOLE).select("header", "record").unionByName(joined)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file, or a folder of them, with a header in each: all cells as strings."""
    lines = _lines(spark, path)
    if not has_line_breaks(lines):
        return spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path)
    rows = records(lines)
    header = rows.where("header").first()["record"]
    # the names as Spark's reader makes them (repeated or empty ones too)
    names = spark.read.options(header=True, **_OPTIONS).csv(spark.sparkContext.parallelize([header])).columns
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    parsed = rows.where(~F.col("header")).select(F.from_csv("record", schema, _OPTIONS).alias("r")).select("r.*")
    return parsed.toDF(*names)
