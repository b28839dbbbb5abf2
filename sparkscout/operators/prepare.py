"""Cleaning, encoding and profiling.

Every decision (which column to drop, which median/mode to fill, which
format parses) is made from a per-column aggregate whose size is bounded by
the number of columns; the data itself is only ever rewritten by a
projection, so the cleaned table is one lazy ``select`` over the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import (CATEGORY_TYPES, NUMERIC_TYPES, TIME_TYPES, category_cols,
                      numeric_cols, time_cols)
from ..sources.tables import normalise
from .categorical import APPROX_RSD, surely_above
from .digests import digest_counts, few_values, modes
from .quantiles import column_quantiles

# Timestamp formats tried, in order, on string columns.  ``None``
# is Spark's ISO-8601 cast.  A value must contain a date separator, so that a
# bare number such as '1999' is never read as a date.
TIMESTAMP_FORMATS = [None, "yyyy/M/d", "M/d/yyyy", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy/M/d H:mm:ss",
                     "M/d/yyyy H:mm:ss", "d/M/yyyy H:mm:ss", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy",
                     "d MMMM yyyy", "d-MMM-yyyy", "yyyyMMdd"]
DATE_SHAPE = (r"^\s*(\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|\p{L}{3,9}\.? \d{1,2}, \d{4}|\d{1,2}[ -]\p{L}{3,9}[ -]\d{4}"
              r"|(19|20)\d{6}\s*$)")
# Cheap shape test per format: the parser only runs on values that can match.
FORMAT_SHAPES = {
    None: r"^\s*\d{4}-\d{1,2}-\d{1,2}",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "d.M.yyyy": r"^\d{1,2}\.\d{1,2}\.\d{4}$",
    "yyyy/M/d H:mm:ss": r"^\d{4}/\d{1,2}/\d{1,2} \d",
    "M/d/yyyy H:mm:ss": r"^\d{1,2}/\d{1,2}/\d{4} \d",
    "d/M/yyyy H:mm:ss": r"^\d{1,2}/\d{1,2}/\d{4} \d",
    "MMM d, yyyy": r"^\p{L}{3} \d{1,2}, \d{4}$",
    "MMMM d, yyyy": r"^\p{L}{3,9} \d{1,2}, \d{4}$",
    "d MMM yyyy": r"^\d{1,2} \p{L}{3} \d{4}$",
    "d MMMM yyyy": r"^\d{1,2} \p{L}{3,9} \d{4}$",
    "d-MMM-yyyy": r"^\d{1,2}-\p{L}{3}-\d{4}$",
    "yyyyMMdd": r"^(19|20)\d{6}$",
}


def _q(name: str) -> str:
    return f"`{name}`"


def strip(c):
    """Remove leading and trailing whitespace (not only spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def null_profile(df: DataFrame) -> DataFrame:
    """``(column, pos, n_rows, n_null, null_frac)`` in one aggregate."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count(F.col(_q(c))).alias(f"__nn{i}") for i, c in enumerate(cols)])
    stack = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("pos"), F.col(f"__nn{i}").alias("nn"))
        for i, c in enumerate(cols)]))
    long = row.select(F.col("__rows").alias("n_rows"), stack.alias("s"))
    return long.select("s.column", "s.pos", "n_rows",
                       (F.col("n_rows") - F.col("s.nn")).alias("n_null"),
                       F.when(F.col("n_rows") > 0, (F.col("n_rows") - F.col("s.nn")) / F.col("n_rows"))
                       .otherwise(F.lit(0.0)).alias("null_frac"))


def drop_sparse(df: DataFrame, max_null_frac: float = 0.5,
                profile: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Drop columns whose null fraction is strictly above ``max_null_frac``."""
    profile = profile if profile is not None else null_profile(df)
    dropped = [r["column"] for r in profile.filter(F.col("null_frac") > max_null_frac)
               .select("column").collect()]
    return df.drop(*dropped), dropped


def median_impute(df: DataFrame, cols: list[str] | None = None, approx: bool = False,
                  **quantile_kw) -> tuple[DataFrame, dict[str, float]]:
    """Fill nulls of numeric columns that have any with the exact median.

    Columns with nulls become DOUBLE (as an integer column with missing
    values is a float column in the analysed tool), so a .5 median is kept.
    """
    cols = cols if cols is not None else numeric_cols(df)
    if not cols:
        return df, {}
    prof = {r["column"]: r["n_null"] for r in null_profile(df.select(*[_q(c) for c in cols]))
            .collect()}
    gappy = [c for c in cols if prof.get(c, 0) > 0]
    if not gappy:
        return df, {}
    med = {r["column"]: r["median"] for r in
           column_quantiles(df, gappy, [0.5], ["median"], approx=approx, **quantile_kw).collect()}
    out = [F.coalesce(F.col(_q(c)).cast("double"), F.lit(med.get(c))).alias(c) if c in med
           else F.col(_q(c)) for c in df.columns]
    return df.select(*out), med


def _parse(c, fmt):
    shape = FORMAT_SHAPES.get(fmt, DATE_SHAPE)
    guarded = F.when(c.rlike(DATE_SHAPE) & c.rlike(shape), c)
    return F.try_to_timestamp(guarded) if fmt is None else F.try_to_timestamp(guarded, F.lit(fmt))


def timestamp_candidates(df: DataFrame, cols: list[str] | None = None,
                         formats: list[str | None] = TIMESTAMP_FORMATS) -> DataFrame:
    """Parsed fraction (over all rows) of each string column for each format:
    ``(column, pos, fmt_pos, format, parsed_frac)``."""
    cols = cols if cols is not None else [f.name for f in df.schema.fields
                                          if isinstance(f.dataType, T.StringType)]
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, pos int, fmt_pos int, format string, parsed_frac double")
    exprs, meta = [], []
    for ci, c in enumerate(cols):
        for fi, fmt in enumerate(formats):
            exprs.append(F.avg(_parse(F.col(_q(c)), fmt).isNotNull().cast("double")).alias(f"f{ci}_{fi}"))
            meta.append((c, ci, fi, fmt or "iso8601"))
    row = df.agg(*exprs)
    stack = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(ci).alias("pos"), F.lit(fi).alias("fmt_pos"),
                 F.lit(fn).alias("format"), F.col(f"f{ci}_{fi}").alias("parsed_frac"))
        for (c, ci, fi, fn) in meta]))
    return row.select(stack.alias("s")).select("s.*")


def infer_timestamps(df: DataFrame, cols: list[str] | None = None,
                     formats: list[str | None] = TIMESTAMP_FORMATS,
                     min_frac: float = 0.5) -> tuple[DataFrame, dict[str, str]]:
    """Convert string columns where a format parses more than ``min_frac``
    of all rows: the one that parses most, of equal ones the first, so dates
    that can be read either way are month-first.  Other values -> NULL."""
    cand = timestamp_candidates(df, cols, formats)
    chosen: dict[str, str] = {}
    for r in cand.filter(F.col("parsed_frac") > min_frac).orderBy("pos", F.col("parsed_frac").desc(), "fmt_pos").collect():
        chosen.setdefault(r["column"], r["format"])
    out = []
    for c in df.columns:
        if c in chosen:
            fmt = None if chosen[c] == "iso8601" else chosen[c]
            out.append(_parse(F.col(_q(c)), fmt).alias(c))
        else:
            out.append(F.col(_q(c)))
    return df.select(*out), chosen


def string_modes(df: DataFrame, cols: list[str], null_policy: str = "mode") -> DataFrame:
    """Per string column after trimming: whether it has gaps (null or blank)
    and its mode ``(column, pos, has_gap, mode)``.

    ``null_policy='mode'``: the mode is taken over non-blank values and fills
    both nulls and blanks.  ``'literal'``: nulls become the text ``'nan'`` and
    count as a value; only blanks are filled, by the mode over all values
    (which may be the blank itself).  Ties go to the smallest value.
    """
    values = _stripped(df, cols, null_policy)
    counts = digest_counts(values, cols)
    gap = ~F.col("solid") if null_policy == "mode" else ~F.col("solid") & F.col("d1").isNotNull()
    gaps = {r["column"]: r["g"] for r in counts.groupBy("column").agg(F.max(gap).alias("g")).collect()}
    mode = modes(values, counts.filter("solid") if null_policy == "mode" else counts, cols)
    return df.sparkSession.createDataFrame([(c, k, gaps[c], mode.get(c)) for k, c in enumerate(cols) if c in gaps],
                                           "column string, pos int, has_gap boolean, mode string")


def _stripped(df: DataFrame, cols: list[str], null_policy: str) -> DataFrame:
    return df.select(*[(strip(F.col(_q(c))) if null_policy == "mode"
                        else F.coalesce(strip(F.col(_q(c))), F.lit("nan"))).alias(c) for c in cols])


def clean_strings(df: DataFrame, cols: list[str] | None = None,
                  null_policy: str = "mode") -> tuple[DataFrame, dict[str, str]]:
    """P5 + P6: trim every string column, then fill gaps with the mode."""
    cols = cols if cols is not None else [f.name for f in df.schema.fields
                                          if isinstance(f.dataType, T.StringType)]
    if not cols:
        return df, {}
    modes = {r["column"]: r["mode"] for r in string_modes(df, cols, null_policy)
             .filter("has_gap").collect()}
    out = []
    for c in df.columns:
        if c not in cols:
            out.append(F.col(_q(c)))
            continue
        if null_policy == "mode":
            v = strip(F.col(_q(c)))
            if c in modes and modes[c] is not None:
                v = F.when(v.isNull() | (v == ""), F.lit(modes[c])).otherwise(v)
        else:
            v = F.coalesce(strip(F.col(_q(c))), F.lit("nan"))
            if c in modes and modes[c] is not None:
                v = F.when(v == "", F.lit(modes[c])).otherwise(v)
        out.append(v.alias(c))
    return df.select(*out), modes


def encoding_plan(df: DataFrame, cols: list[str] | None = None,
                  max_distinct: int = 10) -> DataFrame:
    """P7/P8 decision per string column: ``(column, pos, n_unique, action,
    categories)`` with ``action`` 'encode' (fewer than ``max_distinct``
    distinct non-null values; ``categories`` sorted ascending) or 'drop'."""
    cols = cols if cols is not None else [f.name for f in df.schema.fields
                                          if isinstance(f.dataType, T.StringType)]
    values = df.select(*[F.col(_q(c)) for c in cols])
    counts = digest_counts(values, cols).filter(F.col("d1").isNotNull())
    sizes = {r["column"]: r["n"] for r in counts.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    known = few_values(values, counts, [c for c, n in sizes.items() if n < max_distinct])
    return df.sparkSession.createDataFrame(
        [(c, k, sizes[c], "encode" if c in known else "drop", known.get(c)) for k, c in enumerate(cols) if c in sizes],
        "column string, pos int, n_unique long, action string, categories array<string>")


def label_encode(df: DataFrame, cols: list[str] | None = None,
                 max_distinct: int = 10) -> tuple[DataFrame, dict[str, list[str]]]:
    """P7 + P8: low-cardinality string columns -> alphabetical 0-based BYTE
    codes (null -> -1) via a literal map in the projection; other string
    columns are dropped."""
    cols = cols if cols is not None else [f.name for f in df.schema.fields
                                          if isinstance(f.dataType, T.StringType)]
    if not cols:
        return df, {}
    plan = encoding_plan(df, cols, max_distinct).collect()
    encode = {r["column"]: list(r["categories"]) for r in plan if r["action"] == "encode"}
    drop = {r["column"] for r in plan if r["action"] == "drop"}
    out = []
    for c in df.columns:
        if c in drop:
            continue
        if c in encode:
            cats = encode[c]
            if cats:
                m = F.create_map(*[x for i, v in enumerate(cats) for x in (F.lit(v), F.lit(i))])
                code = F.coalesce(F.element_at(m, F.col(_q(c))), F.lit(-1))
            else:
                code = F.lit(-1)
            out.append(code.cast("byte").alias(c))
        else:
            out.append(F.col(_q(c)))
    return df.select(*out), encode


def role_of(dt: T.DataType) -> str:
    if isinstance(dt, T.ByteType):
        return "code"
    if isinstance(dt, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dt, TIME_TYPES):
        return "time"
    if isinstance(dt, CATEGORY_TYPES):
        return "category"
    return "other"


def profile(df: DataFrame) -> DataFrame:
    """One row per column ``(column, pos, dtype, role, n_rows, n_cols,
    n_null, missing_pct)`` from one aggregate."""
    meta = df.sparkSession.createDataFrame(
        [(f.name, i, f.dataType.simpleString(), role_of(f.dataType))
         for i, f in enumerate(df.schema.fields)],
        "column string, pos int, dtype string, role string")
    nulls = null_profile(df)
    return nulls.join(meta, ["column", "pos"]).select(
        "column", "pos", "dtype", "role", "n_rows", F.lit(len(df.columns)).alias("n_cols"),
        "n_null", (F.col("null_frac") * 100).alias("missing_pct"))


def complete_cases(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows without nulls in ``cols`` (default: numeric columns)."""
    return df.na.drop(subset=cols if cols is not None else numeric_cols(df))


@dataclass
class Prepared:
    """P10 result: the encoded view for numeric miners, the cleaned
    (un-encoded) view for category miners, the time column and decisions."""
    encoded: DataFrame
    clean: DataFrame
    time_col: str | None
    dropped_sparse: list[str] = field(default_factory=list)
    medians: dict = field(default_factory=dict)
    timestamps: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)
    encodings: dict = field(default_factory=dict)

    @property
    def numeric(self) -> list[str]:
        return numeric_cols(self.encoded)

    @property
    def categories(self) -> list[str]:
        return category_cols(self.clean)

    def profile(self) -> DataFrame:
        return profile(self.encoded)


def _scan_columns(df: DataFrame, str_cols: list[str],
                  formats: list[str | None]) -> tuple[int, dict, dict]:
    """Pass A: one aggregate for the row count, the non-null count of every
    column and the parsed fraction of every (string column, format)."""
    exprs = [F.count(F.lit(1)).alias("__rows")]
    exprs += [F.count(F.col(_q(c))).alias(f"__nn{i}") for i, c in enumerate(df.columns)]
    exprs += [F.avg(_parse(F.col(_q(c)), fmt).isNotNull().cast("double")).alias(f"__ts{ci}_{fi}")
              for ci, c in enumerate(str_cols) for fi, fmt in enumerate(formats)]
    exprs += [F.approx_count_distinct(strip(F.col(_q(c))), APPROX_RSD).alias(f"__hd{ci}")
              for ci, c in enumerate(str_cols)]
    exprs += [F.count_if(strip(F.col(_q(c))) == "").alias(f"__bl{ci}") for ci, c in enumerate(str_cols)]
    row = df.agg(*exprs).first()
    nn = {c: row[f"__nn{i}"] for i, c in enumerate(df.columns)}
    ts = {(c, fi): row[f"__ts{ci}_{fi}"] for ci, c in enumerate(str_cols)
          for fi in range(len(formats))}
    ts.update({("__approx", c): row[f"__hd{ci}"] for ci, c in enumerate(str_cols)})
    ts.update({("__blank", c): row[f"__bl{ci}"] for ci, c in enumerate(str_cols)})
    return row["__rows"], nn, ts


def _string_summaries(df: DataFrame, cols: list[str], null_policy: str,
                      max_distinct: int) -> dict[str, dict]:
    """Pass B: one shuffle on value digests; from it, per column: gap flag, mode
    (of columns with gaps), distinct count after filling, and, where there are
    at most ``max_distinct``, all values in ascending order."""
    if not cols:
        return {}
    values = _stripped(df, cols, null_policy)
    counts = digest_counts(values, cols)
    out = {c: {"mode": None, "cats": [], "n_solid": 0, "has_gap": False} for c in cols}
    for r in counts.groupBy("column").agg(F.count_if("solid").alias("n"), F.max(~F.col("solid")).alias("gap")).collect():
        out[r["column"]] |= {"n_solid": r["n"], "has_gap": r["gap"]}
    solid = counts.filter("solid")
    for c, mode in modes(values, solid if null_policy == "mode" else counts,
                         [c for c in cols if out[c]["has_gap"]]).items():
        out[c]["mode"] = mode
    for c, cats in few_values(values, solid, [c for c in cols if out[c]["n_solid"] <= max_distinct]).items():
        out[c]["cats"] = cats
    for o in out.values():
        filled = o["has_gap"] and o["mode"] is not None
        if null_policy == "literal" and filled and o["mode"] == "":
            # the blank is the mode and stays a value of its own
            o["n_solid"] += 1
            o["cats"] = sorted(o["cats"] + [""])[:max_distinct]
    return out


def prepare(df: DataFrame, null_policy: str = "mode", approx: bool = False,
            max_distinct: int = 10, max_null_frac: float = 0.5,
            formats: list[str | None] = TIMESTAMP_FORMATS) -> Prepared:
    """P10: drop sparse columns, impute medians, infer timestamps, strip and
    fill strings, then label-encode; keeps both the encoded and the cleaned
    view.  Decisions come from two scans (one aggregate, one shuffle on
    string values) plus the median passes for columns that have nulls; the
    views are lazy projections over the source."""
    df = normalise(df)
    str_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    n_rows, nn, ts = _scan_columns(df, str_cols, formats)
    null_frac = {c: ((n_rows - nn[c]) / n_rows if n_rows else 0.0) for c in df.columns}
    dropped = [c for c in df.columns if null_frac[c] > max_null_frac]
    keep = [c for c in df.columns if c not in dropped]
    num = [c for c in numeric_cols(df) if c in keep]
    gappy = [c for c in num if nn[c] < n_rows]
    meds = {}
    if gappy:
        meds = {r["column"]: r["median"] for r in column_quantiles(
            df, gappy, [0.5], ["median"], approx=approx).collect()}
    stamps = {}
    for c in str_cols:
        if c not in keep:
            continue
        best = max(range(len(formats)), key=lambda fi: ts[(c, fi)] or 0.0)     # the first of equal ones
        if (ts[(c, best)] or 0.0) > 0.5:
            stamps[c] = formats[best] or "iso8601"
    texts = [c for c in str_cols if c in keep and c not in stamps]
    # HLL prefilter: a text column far above the encoding limit is dropped from
    # the encoded view without shuffling its values; its values are only
    # counted when it has gaps to fill with the mode
    wide = {c for c in texts if surely_above(ts[("__approx", c)], max_distinct)}
    gaps = {c for c in texts if (nn[c] < n_rows and null_policy == "mode")
            or ts[("__blank", c)] > 0}
    counted = [c for c in texts if c not in wide or c in gaps]
    summ = _string_summaries(df, counted, null_policy, max_distinct)
    for c in texts:
        if c not in summ:
            summ[c] = {"mode": None, "cats": [], "n_solid": max_distinct, "has_gap": False}
    modes = {c: o["mode"] for c, o in summ.items() if o["has_gap"]}
    clean_cols = []
    for c in keep:
        v = F.col(_q(c))
        if c in meds:
            v = F.coalesce(v.cast("double"), F.lit(meds[c]))
        elif c in stamps:
            v = _parse(v, None if stamps[c] == "iso8601" else stamps[c])
        elif c in summ:
            o = summ[c]
            if null_policy == "mode":
                v = strip(v)
                if o["has_gap"] and o["mode"] is not None:
                    v = F.when(v.isNull() | (v == ""), F.lit(o["mode"])).otherwise(v)
            else:
                v = F.coalesce(strip(v), F.lit("nan"))
                if o["has_gap"] and o["mode"] is not None:
                    v = F.when(v == "", F.lit(o["mode"])).otherwise(v)
        clean_cols.append(v.alias(c))
    clean = df.select(*clean_cols)
    enc_cols, encodings = [], {}
    for c in keep:
        if c in summ:
            o = summ[c]
            if o["n_solid"] >= max_distinct:
                continue  # high-cardinality text: dropped from the encoded view
            cats = o["cats"]
            encodings[c] = cats
            if cats:
                m = F.create_map(*[x for i, v in enumerate(cats) for x in (F.lit(v), F.lit(i))])
                code = F.coalesce(F.element_at(m, F.col(_q(c))), F.lit(-1))
            else:
                code = F.lit(-1)
            enc_cols.append(code.cast("byte").alias(c))
        else:
            enc_cols.append(F.col(_q(c)))
    encoded = clean.select(*enc_cols)
    tcols = time_cols(encoded)
    return Prepared(encoded=encoded, clean=clean, time_col=tcols[0] if tcols else None,
                    dropped_sparse=dropped, medians=meds, timestamps=stamps, modes=modes,
                    encodings=encodings)


__all__ = ["null_profile", "drop_sparse", "median_impute", "timestamp_candidates",
           "infer_timestamps", "string_modes", "clean_strings", "encoding_plan", "label_encode",
           "profile", "complete_cases", "prepare", "Prepared", "category_cols"]
