"""Delimited text files: header checks, and one frame from files whose columns may be ordered
differently."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from virosieve.plans.durable import cut


class HeaderError(ValueError):
    """A file does not have the columns its format demands."""


def list_files(spark: SparkSession, paths: str | Sequence[str], suffix: str = "") -> list[str]:
    """Files named by paths, globs or directories with their sub-folders, on whatever file system they lie.

    Hidden files and folders are left out; an empty file is an error, as it lacks a header.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in [paths] if isinstance(paths, str) else paths:
        pattern = jvm.org.apache.hadoop.fs.Path(path)
        fs = pattern.getFileSystem(conf)
        matches = fs.globStatus(pattern)
        if matches is None or len(matches) == 0:
            raise FileNotFoundError(path)
        for status in matches:
            todo = [status]
            while todo:
                entry = todo.pop()
                if entry.isDirectory():
                    below = fs.listStatus(entry.getPath())
                    todo += [e for e in below if not e.getPath().getName().startswith((".", "_"))]
                elif entry.getPath().getName().endswith(suffix):
                    if entry.getLen() == 0:
                        raise HeaderError(f"{entry.getPath().toString()} is empty")
                    found.append(entry.getPath().toString())
    return sorted(found)


@dataclass(frozen=True)
class Header:
    """A distinct first line: its text, its column names, and a file that has it."""

    text: str
    names: tuple[str, ...]
    example: str


@dataclass(frozen=True)
class DelimitedFiles:
    """Delimited files of one separator and their distinct headers, of which there are few.

    ``firsts(file, header)`` tells the header of each file. It is a written table; files meet it by a join.
    """

    spark: SparkSession
    files: list[str]
    sep: str
    firsts: DataFrame
    headers: list[Header]

    def with_header(self, chosen: Iterable[Header]) -> "DelimitedFiles":
        """The files with one of the chosen headers; others are not read again."""
        headers = [h for h in self.headers if h in set(chosen)]
        firsts = self.firsts.filter(F.col("header").isin([h.text for h in headers]))
        theirs = {row["file"] for row in firsts.select("file").collect()}
        files = [file for file in self.files if self._as_spark(file) in theirs]
        # no file may be lost by the way its path is written; the join in ``rows`` tells them apart as well
        return replace(self, headers=headers, firsts=firsts, files=files if len(files) == len(theirs) else self.files)

    def _as_spark(self, file: str) -> str:
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).toUri().toString()

    def _by_header(self) -> list[tuple[Header, list[str]]] | None:
        """The files of each header, or nothing where a file is listed twice or its path is not written as Spark does."""
        if len(self.headers) == 1:
            of_it = self.firsts.filter(F.col("header") == self.headers[0].text).count()
            return [(self.headers[0], self.files)] if self.firsts.count() == len(self.files) == of_it else None
        number = F.coalesce(*[F.when(F.col("header") == h.text, i) for i, h in enumerate(self.headers)])
        found = self.firsts.select("file", number.alias("layout")).filter("layout IS NOT NULL").collect()
        layout, files = dict(found), [[] for _ in self.headers]
        if not len(layout) == len(found) == len(self.files):
            return None
        for file in self.files:
            at = layout.pop(self._as_spark(file), None)
            if at is None:
                return None
            files[at].append(file)
        return list(zip(self.headers, files, strict=True))

    def check(self, required: Iterable[str], exact: bool = False) -> None:
        for header in self.headers:
            missing = set(required) - set(header.names)
            surplus = set(header.names) - set(required) if exact else set()
            if missing or surplus:
                raise HeaderError(
                    f"{header.example}: missing columns {sorted(missing)}, unexpected columns {sorted(surplus)}"
                )

    def rows(self, required: Iterable[str], optional: Iterable[str] = ()) -> DataFrame:
        """All records: cells as text, blank ones null, and ``input_order``.

        The files of one header are one scan of the lines, as a join would shuffle all lines by their few files. The
        header tells which columns the cells are; an optional column that it lacks is null. Lines that repeat the
        header in a file's first block are left out, as are blank lines.
        """
        names, by_header = [*required, *optional], self._by_header()
        if by_header is not None:
            scans = [_records(_lines(self.spark, files).withColumn("layout", F.lit(0)), [h], names, self.sep) for h, files in by_header]
            return reduce(DataFrame.unionByName, scans)
        known = self.spark.createDataFrame([(h.text, i) for i, h in enumerate(self.headers)], "header string, layout int")
        layouts = self.firsts.join(F.broadcast(known), "header").drop("header")
        return _records(_lines(self.spark, self.files).join(layouts, "file"), self.headers, names, self.sep)


def _records(lines: DataFrame, headers: list[Header], names: list[str], sep: str) -> DataFrame:
    """The cells of lines whose ``layout`` is the number of their header."""
    record, is_header = None, F.lit(False)
    for i, header in enumerate(headers):
        here = F.col("layout") == i
        is_header = is_header | (here & (F.col("value") == header.text))
        cells = F.from_csv(
            "value", ", ".join(f"c{k} string" for k in range(len(header.names))),
            {"sep": sep, "quote": '"', "escape": '"', "nullValue": "", "mode": "PERMISSIVE"},
        )
        cell = {name: cells[f"c{k}"] for k, name in enumerate(header.names)}
        fields = F.struct(*[cell.get(name, F.lit(None).cast("string")).alias(f"c{k}") for k, name in enumerate(names)])
        record = fields if record is None and len(headers) == 1 else F.when(here, fields).otherwise(record)
    # Spark's own reader leaves lines of blanks and control characters out, too
    kept = lines.filter(~((F.col("block") == 0) & is_header) & F.col("value").rlike(r"[^\x00-\x20]"))
    # explode keeps expressions over the cells from parsing the line again, each for itself
    parsed = kept.select(record.alias("record"), "input_order").select(F.explode(F.array("record")).alias("record"), "input_order")
    return parsed.select(*[F.col(f"record.c{k}").alias(name) for k, name in enumerate(names)], "input_order")


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """``value, file, block, input_order`` of every line."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.text(files).select("value", *place, input_order())


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each run of rows with the same file."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(0).dictionary_encode()
        starts = np.flatnonzero(np.diff(codes.indices.to_numpy(), prepend=-1))
        if codes.dictionary[0].as_py() == last:
            starts = starts[1:]
        last = batch.column(0)[batch.num_rows - 1].as_py()
        if len(starts):
            yield batch.take(pa.array(starts))


def scan(spark: SparkSession, paths, sep: str) -> DelimitedFiles:
    """Find the files and their headers.

    Tasks take the first line of each file from a scan of the files' first blocks; the driver lists folders and
    gets the distinct headers only.
    """
    files = list_files(spark, paths)
    if not files:
        raise FileNotFoundError(str(paths))
    firsts = _lines(spark, files).filter("block = 0").select("file", F.col("value").alias("header"))
    firsts = cut(firsts.mapInArrow(_first_of_each, "file string, header string"), "headers")
    headers = []
    for text, example in firsts.groupBy("header").agg(F.min("file")).orderBy("header").collect():
        names = next(csv.reader([text.lstrip("\ufeff")], delimiter=sep), [])
        if not any(name.strip() for name in names):
            raise HeaderError(f"{example} has no header")
        headers.append(Header(text, tuple(name.strip() for name in names), example))
    return DelimitedFiles(spark, files, sep, firsts, headers)


def read_delimited(spark: SparkSession, paths, sep: str, required: Iterable[str], *, exact: bool = False) -> DataFrame:
    """All cells as text, blank cells as null, with a sortable ``input_order`` column.

    Every file must have the ``required`` columns, in any order, and no others when ``exact``.
    """
    required = list(required)
    found = scan(spark, paths, sep)
    found.check(required, exact)
    return found.rows(required)


def input_order():
    """Place of a record in its input: the file, the block of the file, the record in the block. It
    sorts as the records lie, however the blocks were dealt to tasks."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("record"),
    ).alias("input_order")


def renamed(rows: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Select and rename by ``model name -> file header``; ``input_order`` stays."""
    return rows.select(*[F.col(f"`{header}`").alias(name) for name, header in columns.items()], "input_order")


def cast_columns(rows: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Typed columns. A cell that does not fit its type fails the job, as it means a broken file."""
    return rows.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in rows.columns])
