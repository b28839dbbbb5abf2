"""CSV records of large files with line breaks inside quoted fields.

Spark splits a text file between lines, so a split may begin inside a quoted
field.  Each split is a chunk:

1. a chunk tells whether its end lies inside a quoted field, for both cases of
   its beginning; only lines with a quote matter.  Applying these answers one
   after another, per file, gives every chunk its true beginning (a few bytes
   for each chunk);
2. every chunk then cuts its lines into records.  What belongs to a record of
   an earlier chunk, or goes on in a later one, is put together by file and
   place; that is at most two pieces a chunk.

A quote opens a field only where a field begins; elsewhere in an unquoted
field it is an ordinary character.
"""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, line): the lines of each split in their order."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                    F.col("value").alias("line")))


def _scanner(delimiter: str):
    """Whether a line ends inside a quoted field, given its beginning."""
    def ends_inside(line, inside):
        at, n = 0, len(line)
        while True:
            if not inside:
                if at < n and line[at] == '"':
                    inside, at = True, at + 1
                else:
                    at = line.find(delimiter, at) + 1
                    if not at:
                        return False
                    continue
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1:at + 2] == '"':
                at += 2
                continue
            inside = False
            at = line.find(delimiter, at + 1) + 1
            if not at:
                return False
    return ends_inside


def beginnings(text: DataFrame, delimiter: str = ",") -> DataFrame:
    """(file, ends): for each file with quotes, in the order of its chunks with
    quotes, whether the chunk ends inside a quoted field."""
    ends_inside = _scanner(delimiter)

    def run(batches):
        at, ends = None, None
        out = []
        for b in batches:
            for file, start, line in zip(*(c.to_pylist() for c in b.columns)):
                if (file, start) != at:
                    if at is not None:
                        out.append((*at, *ends))
                    at, ends = (file, start), (False, True)
                a, z = ends
                a2 = ends_inside(line, a)
                ends = (a2, a2 if a == z else ends_inside(line, z))
        if at is not None:
            out.append((*at, *ends))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*out) if out else [[]] * 4, (pa.string(), pa.int64(), pa.bool_(), pa.bool_()))], ["file", "start", "a", "z"])

    # a chunk without quotes ends as it begins and may be left out
    ends = text.filter(F.contains("line", F.lit('"'))).mapInArrow(run, "file string, start long, a boolean, z boolean")
    per_file = ends.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("start", "a", "z"))).alias("c"))
    steps = F.aggregate("c", F.array().cast("array<struct<start:bigint,inside:boolean>>"), lambda seen, c: F.concat(
        seen, F.array(F.struct(c["start"].alias("start"),
                               F.when(F.coalesce(F.get(seen, F.size(seen) - 1)["inside"], F.lit(False)), c["z"])
                               .otherwise(c["a"]).alias("inside")))))
    return per_file.select("file", steps.alias("ends"))


def records(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(file, first, record): every record of the files, without order; ``first``
    marks the first one of a file."""
    text = lines(spark, path)
    ends = stored(beginnings(text, delimiter), "csv-ends")
    ends_inside = _scanner(delimiter)
    # the state before a chunk is that after the last chunk with a quote before it
    before = F.filter("ends", lambda e: e["start"] < F.col("start"))
    chunk_state = F.coalesce(F.get(before, F.size(before) - 1)["inside"], F.lit(False))
    starts = text.select("file", "start").distinct().join(ends, "file", "left").select(
        "file", "start", F.when(F.size("ends") > 0, chunk_state).otherwise(F.lit(False)).alias("inside"))
    inside = stored(starts.filter("inside"), "csv-starts")
    # one short row per chunk that begins inside a field; the order of lines is kept
    marked = text.join(F.broadcast(inside), ["file", "start"], "left").select(
        "file", "start", "line", F.coalesce("inside", F.lit(False)).alias("inside"))
    names = ["file", "start", "at", "head", "tail", "record"]

    def run(batches):
        chunk, held, head, open_, at = None, [], False, False, 0
        out = []

        def close(tail):
            nonlocal held, head, at
            out.append((*chunk, at, head, tail, "\n".join(held)))
            held, head, at = [], False, at + 1

        def send():
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*out) if out else [[]] * 6,
                (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()))], names)
            out.clear()
            return got

        for b in batches:
            for file, start, line, inside in zip(*(c.to_pylist() for c in b.columns)):
                if (file, start) != chunk:
                    if held:
                        close(True)
                    chunk, open_, head, at = (file, start), inside, inside, 0
                held.append(line)
                if open_ or '"' in line:
                    open_ = ends_inside(line, open_)
                if not open_:
                    close(False)
            if held and not open_:
                close(False)
            yield send()
        if held:
            close(True)
        yield send()

    cut = stored(marked.mapInArrow(run, "file string, start long, at long, head boolean, tail boolean, record string"),
                 "csv-records")
    first = (F.col("start") == 0) & (F.col("at") == 0)
    whole = cut.filter("not head and not tail").select("file", first.alias("first"), "record")
    # at most two pieces a chunk: a record begins where a piece has no head
    pieces = cut.filter("head or tail").withColumn("n", F.sum(F.when(F.col("head"), 0).otherwise(1)).over(
        Window.partitionBy("file").orderBy("start", "at")))
    joined = pieces.groupBy("file", "n").agg(
        F.sort_array(F.collect_list(F.struct("start", "at", "record"))).alias("p")).select(
        "file", ((F.col("p")[0]["start"] == 0) & (F.col("p")[0]["at"] == 0)).alias("first"),
        F.array_join(F.transform("p", lambda p: p["record"]), "\n").alias("record"))
    return whole.unionByName(joined)


def parsed(spark: SparkSession, path: str, header: bool = True, schema: T.StructType | str | None = None,
           delimiter: str = ",") -> DataFrame:
    """The rows of CSV files, as text columns or by a schema.  Empty lines are
    skipped; column names are those of the first file's header."""
    found = records(spark, path, delimiter)
    options = {"quote": '"', "escape": '"', "emptyValue": "", "sep": delimiter}
    found = found.withColumn("record", F.regexp_replace("record", r"^﻿|\r$", ""))
    body = found.filter(F.length("record") > 0)
    if schema is None:
        top = body.filter("first").orderBy("file").select("record").first()
        if top is None:
            return spark.createDataFrame([], T.StructType())
        width, names = _names(top[0], options)
        names = names if header else [f"_c{k}" for k in range(width)]
        schema = T.StructType([T.StructField(f"_{k}", T.StringType()) for k in range(width)])
    else:
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        names = schema.names
        schema = T.StructType([T.StructField(f"_{k}", f.dataType) for k, f in enumerate(schema.fields)])
    if header:
        body = body.filter("not first")
    row = F.from_csv("record", _ddl(schema), options)
    return body.select(row.alias("r")).select(*[F.col("r")[f"_{k}"].alias(n) for k, n in enumerate(names)])


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _names(top: str, options: dict) -> tuple[int, list[str]]:
    """The number of fields of a header record and their names: unnamed and
    repeated ones get a number."""
    fields = next(csv.reader(io.StringIO(top, newline=""), delimiter=options["sep"], doublequote=True), [])
    names: list[str] = []
    for k, f in enumerate(fields):
        name = f or f"_c{k}"
        names.append(name if name not in names else f"{name}{k}")
    return len(fields), names
