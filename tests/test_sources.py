"""Sources and sinks."""

import math
import os
import random
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from sparkscout.schema import INSIGHT_SCHEMA
from sparkscout.sources import insight_table, read_table, write_csv


def test_csv_read_infers_and_normalises(spark):
    d = tempfile.mkdtemp(prefix="sparkscout-test-")
    path = os.path.join(d, "sample.csv")
    with open(path, "w") as fh:
        fh.write("day,temperature_c,units,segment\n2024-01-01,NaN,3,VIP\n2024-01-02,12.5,4,New\n")
    df = read_table(spark, path)
    types = dict(df.dtypes)
    assert types["day"] == "timestamp" and types["temperature_c"] == "double"
    rows = df.orderBy("day").collect()
    assert rows[0]["temperature_c"] is None and rows[1]["temperature_c"] == 12.5


def test_csv_round_trip(spark):
    base = tempfile.mkdtemp(prefix="sparkscout-test-")
    src = spark.createDataFrame(pd.DataFrame({"a": [1, 2, 3], "b": ["x", "y", None]}))
    write_csv(src, os.path.join(base, "out"))
    back = read_table(spark, os.path.join(base, "out"), fmt="csv")
    assert sorted((r["a"], r["b"]) for r in back.collect()) == [(1, "x"), (2, "y"), (3, None)]


def test_insight_table_order_and_markers(spark):
    row = {f.name: None for f in INSIGHT_SCHEMA.fields}
    row.update(type="anomaly", description="**Value** has **3**", questions=["Why **x**?"],
               final_score=80.0, seq=1)
    df = spark.createDataFrame([tuple(row[f.name] for f in INSIGHT_SCHEMA.fields)], INSIGHT_SCHEMA)
    out = insight_table(df)
    assert out.columns[:3] == ["final_score", "type", "description"]
    r = out.first()
    assert r["description"] == "Value has 3" and r["questions"] == ["Why x?"]
    assert not math.isnan(r["final_score"])


def test_csv_quotes_line_breaks_and_missing_values(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="sparkscout-test-"), "q.csv")
    with open(path, "w") as fh:
        fh.write('id,amt,note,none\n1,NA,"a ""quoted"" word",\n2,3.5,"two\nlines, one field",N/A\n3,null,NA,\n')
    df = read_table(spark, path)
    assert dict(df.dtypes)["id"] == "bigint" and dict(df.dtypes)["amt"] == "double"
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, None, 'a "quoted" word', None), (2, 3.5, "two\nlines, one field", None), (3, None, None, None)]


def test_csv_round_trip_of_awkward_text(spark):
    base = tempfile.mkdtemp(prefix="sparkscout-test-")
    rows = [(1, 'say "x", then\ny'), (2, "back\\slash\\"), (3, "comma, only"), (4, '"')]
    write_csv(spark.createDataFrame(rows, "a long, b string"), os.path.join(base, "out"))
    back = read_table(spark, os.path.join(base, "out"), fmt="csv")
    assert sorted((r["a"], r["b"]) for r in back.collect()) == rows


def _awkward_file(path, rows, end="\n"):
    with open(path, "w", newline="") as fh:
        fh.write("id,note,plain" + end)
        for i, note, plain in rows:
            fh.write(f'{i},"{note}",{plain}{end}'.replace('"None"', ""))


def test_one_csv_file_is_read_by_many_tasks(spark, monkeypatch):
    """Splits that begin inside quoted fields, also ones that span several splits."""
    rng = random.Random(3)
    path = os.path.join(tempfile.mkdtemp(prefix="sparkscout-test-"), "large.csv")
    rows = []
    for i in range(3000):
        words = ["a,b", '""', "line\nbreak", '\n""quoted"",\n', "x" * rng.choice([1, 30, 9000 if i % 500 == 0 else 3]), "\n"]
        rows.append((i, "".join(rng.choice(words) for _ in range(rng.randint(1, 8))), rng.choice(['5"', "plain", "7"])))
    _awkward_file(path, rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        from sparkscout.sources.records import lines
        assert lines(spark, path).select("file", "start").distinct().count() > 20
        got = {r["id"]: (r["note"], r["plain"]) for r in read_table(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = pd.read_csv(path, keep_default_na=False, dtype=str)
    assert len(got) == 3000
    for i, note, plain in zip(want.id, want.note, want.plain):
        assert got[int(i)] == (note, plain), i


def test_csv_line_ends_blank_lines_and_wide_integers(spark):
    folder = tempfile.mkdtemp(prefix="sparkscout-test-")
    with open(os.path.join(folder, "a.csv"), "w", newline="") as fh:
        fh.write('﻿id,big,huge,t\r\n1,9223372036854775807,9223372036854775808,"x\r\ny"\r\n\r\n2,-5,3,z')
    df = read_table(spark, os.path.join(folder, "a.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "big": "bigint", "huge": "double", "t": "string"}
    rows = {r["id"]: r for r in df.collect()}
    assert rows[1]["big"] == 2 ** 63 - 1 and rows[1]["t"].replace("\r", "") == "x\ny" and rows[2]["t"] == "z"


def test_csv_with_a_schema_and_without_a_header(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="sparkscout-test-"), "a.csv")
    with open(path, "w") as fh:
        fh.write('1,"two\nlines"\n2,b\n')
    assert sorted(map(tuple, read_table(spark, path, schema="a int, b string", header=False).collect())) == [
        (1, "two\nlines"), (2, "b")]
    assert read_table(spark, path, header=False).columns == ["_c0", "_c1"]
