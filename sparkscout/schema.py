"""Column roles, the insight record type and long-form helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)
CATEGORY_TYPES = (T.StringType, T.BooleanType)

FEATURE_MEAN = T.StructType([
    T.StructField("feature", T.StringType()),
    T.StructField("mean", T.DoubleType()),
])

# The single record type every miner emits (nullable except ``type``).
INSIGHT_SCHEMA = T.StructType([
    T.StructField("type", T.StringType(), False),
    T.StructField("col_a", T.StringType()),
    T.StructField("col_b", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("r_value", T.DoubleType()),
    T.StructField("spearman", T.DoubleType()),
    T.StructField("cluster_id", T.IntegerType()),
    T.StructField("size_pct", T.DoubleType()),
    T.StructField("silhouette_score", T.DoubleType()),
    T.StructField("defining_features", T.ArrayType(FEATURE_MEAN)),
    T.StructField("antecedent", T.ArrayType(T.StringType())),
    T.StructField("consequent", T.ArrayType(T.StringType())),
    T.StructField("support", T.DoubleType()),
    T.StructField("rule_confidence", T.DoubleType()),
    T.StructField("lift", T.DoubleType()),
    T.StructField("lag_rows", T.IntegerType()),
    T.StructField("column", T.StringType()),
    T.StructField("outlier_count", T.LongType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("extreme_value", T.DoubleType()),
    T.StructField("top_value", T.StringType()),
    T.StructField("top_pct", T.DoubleType()),
    T.StructField("n_unique", T.LongType()),
    T.StructField("skew", T.DoubleType()),
    T.StructField("cv", T.DoubleType()),
    T.StructField("iqr", T.DoubleType()),
    T.StructField("median", T.DoubleType()),
    T.StructField("description", T.StringType()),
    T.StructField("hypothesis", T.StringType()),
    T.StructField("questions", T.ArrayType(T.StringType())),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("novelty", T.DoubleType()),
    T.StructField("impact", T.DoubleType()),
    T.StructField("final_score", T.DoubleType()),
    T.StructField("seq", T.LongType()),
])

# Discovery order of the miners; ``seq`` = order * SEQ_BLOCK + position.
MINER_ORDER = {
    "correlation": 0, "cluster": 1, "association": 2, "time_lag": 3,
    "anomaly": 4, "distribution": 5, "numeric_insight": 6,
}
SEQ_BLOCK = 1_000_000_000


def numeric_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def time_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, TIME_TYPES)]


def category_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, CATEGORY_TYPES)]


def position_of(cols: list[str], name_col: str = "column") -> Column:
    """0-based schema position of the column named in ``name_col``."""
    if not cols:
        return F.lit(None).cast("int")
    return (F.array_position(F.array(*[F.lit(c) for c in cols]), F.col(name_col)) - 1).cast("int")


def to_long(df: DataFrame, cols: list[str], cast: str = "double",
            name: str = "column", value: str = "value",
            ids: list[str] | None = None) -> DataFrame:
    """Unpivot ``cols`` into (ids..., column, value) rows (one Expand, no shuffle)."""
    ids = list(ids or [])
    projected = df.select(*[F.col(f"`{c}`") for c in ids], *[F.col(f"`{c}`").cast(cast).alias(c) for c in cols])
    return projected.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in cols], name, value)


def conform(df: DataFrame, schema: T.StructType = INSIGHT_SCHEMA) -> DataFrame:
    """Project a partial insight frame onto the full insight schema."""
    present = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])
