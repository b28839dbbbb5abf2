"""Table sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import INSIGHT_SCHEMA
from ..session import stored
from .records import parsed


def normalise(df: DataFrame) -> DataFrame:
    """NaN -> NULL for floating columns (one NaN poisons corr/avg) and
    DATE -> TIMESTAMP, so every miner sees one null and one time type."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType))
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("timestamp")
        out.append(c.alias(f.name))
    return df.select(*out)


def balance(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread an under-split scan (e.g. one file with one row group) over
    ``min_partitions`` tasks (default: the default parallelism) with a
    round-robin repartition.  Large inputs already have more splits than
    that and are returned unchanged, so this never reshuffles big data.
    Used by operators that multiply rows (pair lists) before aggregating.
    Hash partitioning on a row hash needs no sort, unlike round robin.
    Apply it to a scan or to an already materialised (cached) frame: reading
    the partition count of a plan that still contains a shuffle would make
    adaptive execution run that shuffle first."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    return df


# Texts that stand for a missing value in a CSV file.
NULL_MARKERS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def typed(df: DataFrame) -> DataFrame:
    """Text columns of a CSV table with missing-value markers as NULL and the
    narrowest type that all other values have: BIGINT, DOUBLE, BOOLEAN, ISO
    TIMESTAMP, else STRING.  One aggregate decides for all columns."""
    text = [F.col(f"`{c}`") for c in df.columns]
    plain = df.select(*[F.when(~F.trim(v).isin(NULL_MARKERS), v).alias(c) for v, c in zip(text, df.columns)])
    kinds = {"bigint": lambda v: v.rlike(r"^\s*[+-]?\d{1,19}\s*$") & F.trim(v).try_cast("bigint").isNotNull(),
             "double": lambda v: v.rlike(r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf(inity)?)\s*$")
             | v.rlike(r"(?i)^\s*[+-]?inf(inity)?\s*$"),
             "boolean": lambda v: F.lower(F.trim(v)).isin("true", "false"),
             "timestamp": lambda v: v.rlike(r"^\s*\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}.*)?$")
             & F.try_to_timestamp(F.trim(v)).isNotNull()}
    checks = [F.coalesce(F.bool_and(ok(F.col(f"`{c}`"))), F.lit(False)).alias(f"{kind}_{k}")
              for k, c in enumerate(df.columns) for kind, ok in kinds.items()]
    row = plain.agg(*checks).first() if checks else {}
    out = []
    for k, c in enumerate(df.columns):
        kind = next((x for x in kinds if row[f"{x}_{k}"]), "string")
        v = F.col(f"`{c}`")
        out.append((v if kind == "string" else F.trim(v).cast(kind)).alias(c))
    return plain.select(*out)


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               schema: T.StructType | str | None = None, header: bool = True, rebalance: bool = False,
               multiline: bool = True) -> DataFrame:
    """Read a CSV (header, inferred or given schema) or Parquet table.

    The format is taken from the extension when ``fmt`` is not given.  CSV
    fields may be quoted, ``""`` is a quote inside one, and the usual markers
    (:data:`NULL_MARKERS`) are missing values.  ``multiline`` lets quoted
    fields hold line breaks; large files are split all the same
    (:mod:`.records`).  With ``multiline=False`` every line is a record.
    ``rebalance`` spreads an under-split input over the cluster's default
    parallelism (see :func:`balance`).
    """
    fmt = fmt or ("csv" if path.rstrip("/").lower().endswith(".csv") else "parquet")
    if fmt == "csv":
        if multiline:
            df = parsed(spark, path, header, schema)
        else:
            reader = (spark.read.option("header", header).option("quote", '"').option("escape", '"')
                      .option("emptyValue", ""))
            df = reader.csv(path) if schema is None else reader.schema(schema).csv(path)
        if schema is None:
            df = typed(stored(df, "csv"))                    # parsed once; the types need a pass of their own
    else:
        reader = spark.read if schema is None else spark.read.schema(schema)
        df = reader.format(fmt).load(path)
    df = normalise(df)
    return balance(df) if rebalance else df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with a header row and no index column; quotes inside a
    field are doubled."""
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("emptyValue", "").csv(path))


def insight_table(insights: DataFrame) -> DataFrame:
    """S3: the raw insight table: ``final_score, type, description`` first,
    every other column after them, and ``**`` markers removed from all text
    (arrays of text are cleaned element-wise)."""
    lead = ["final_score", "type", "description"]
    rest = [c for c in insights.columns if c not in lead]
    cols = []
    for name in lead + rest:
        if name not in insights.columns:
            continue
        dt = insights.schema[name].dataType
        c = F.col(name)
        if isinstance(dt, T.StringType):
            c = F.replace(c, F.lit("**"), F.lit(""))
        elif isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.StringType):
            c = F.transform(c, lambda x: F.replace(x, F.lit("**"), F.lit("")))
        cols.append(c.alias(name))
    return insights.select(*cols)


def write_insights(insights: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S3 sink: the cleaned insight table as Parquet."""
    insight_table(insights).write.mode(mode).parquet(path)


__all__ = ["read_table", "write_csv", "insight_table", "write_insights", "normalise", "balance",
           "INSIGHT_SCHEMA"]
