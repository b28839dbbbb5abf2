"""Registered queries over the driver tables, each with a DuckDB oracle.

Every query reads whole driver tables (or a table Spark derives from them by
a join or aggregate) and runs one operator of the library.  The oracle SQL
recomputes the same result independently in DuckDB; ratios are rounded to 6
decimals on both sides, and every computed column has the same alias on
both sides.  Queries marked "no oracle" (K-means, random forests, sampling,
free text) only get the driver's row-count check.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import markup_to_html, readable_label
from ..operators import (categorical, correlations, explore, lags, numeric, prepare, rules,
                         segments, whatif)
from ..plans.discovery import discover, diverse_top
from ..session import ensure_checkpoint_dir
from ..sources.tables import insight_table, read_table, write_csv

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, f"{d.rstrip('/')}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c if not isinstance(c, str) else F.col(c), 6)


def _sql_cols(cols):
    return ", ".join(cols)


# --------------------------------------------------------------------------
# Derived tables (Spark side and SQL side)
# --------------------------------------------------------------------------

def doc_labels(spark, d):
    """documents left join labels: quality/toxic are NULL for unlabelled docs."""
    docs = load(spark, d, "documents")
    lab = load(spark, d, "labels")
    return docs.join(lab, "doc_id", "left").select(
        "doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")


DOC_LABELS_SQL = ("SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic "
                  "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
DOC_LABEL_COLS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
DOC_LABEL_ROLES = ["numeric", "category", "category", "category", "numeric", "numeric", "numeric"]


def order_flags(spark, d):
    """orders with the returned-line quantity and status per order (NULL when
    the order has no returned line)."""
    li = load(spark, d, "lineitem")
    ret = (li.filter(F.col("l_returnflag") == "R").groupBy("l_orderkey")
           .agg(F.sum("l_quantity").alias("qty_r"), F.max("l_linestatus").alias("status_r")))
    o = load(spark, d, "orders")
    return o.join(ret, o["o_orderkey"] == ret["l_orderkey"], "left").drop("l_orderkey")


ORDER_FLAGS_SQL = (
    "SELECT o.*, r.qty_r, r.status_r FROM orders o LEFT JOIN ("
    "SELECT l_orderkey, sum(l_quantity) AS qty_r, max(l_linestatus) AS status_r "
    "FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) r ON o.o_orderkey = r.l_orderkey")

RULE_COLS = ["l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority"]


def line_orders(spark, d):
    li = load(spark, d, "lineitem")
    o = load(spark, d, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(*RULE_COLS)


LINE_ORDERS_SQL = ("SELECT l_returnflag, l_linestatus, o_orderstatus, o_orderpriority "
                   "FROM lineitem JOIN orders ON l_orderkey = o_orderkey")

LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]
PART_NUM = ["p_partkey", "p_size", "p_retailprice"]
EVENTS_NUM = ["event_id", "user_id", "value"]


# --------------------------------------------------------------------------
# SQL generators shared by several oracles
# --------------------------------------------------------------------------

def _union(parts):
    return "\nUNION ALL\n".join(parts)


def _corr_pairs_sql(src, cols, diagonal=False, both=False):
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if (i == j and not diagonal) or (j < i and not both):
                continue
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {i} AS pos_a, {j} AS pos_b, "
                         f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM {src}")
    return _union(parts)


def _moments_sql(src, cols):
    return _union([
        f"SELECT '{c}' AS \"column\", {i} AS pos, count({c}) AS n, avg({c}) AS mean, "
        f"stddev_samp({c}) AS std, skewness({c}) AS skew, "
        f"quantile_cont({c}, 0.25) AS q1, median({c}) AS median, quantile_cont({c}, 0.75) AS q3 "
        f"FROM {src}" for i, c in enumerate(cols)])


def _shape_sql(src, cols):
    return (f"SELECT *, q3 - q1 AS iqr, std / (abs(mean) + 1e-9) * 100 AS cv "
            f"FROM ({_moments_sql(src, cols)})")


def _outliers_sql(src, cols):
    parts = []
    for i, c in enumerate(cols):
        parts.append(
            f"SELECT '{c}' AS \"column\", {i} AS pos, s.n, s.mean, s.std, "
            f"(SELECT count(*) FROM {src} WHERE abs({c} - s.mean) > 3 * s.std) AS oc, "
            f"(SELECT max(abs({c})) FROM {src} WHERE abs({c} - s.mean) > 3 * s.std) AS ma, "
            f"(SELECT max({c}) FROM {src} WHERE abs({c} - s.mean) > 3 * s.std) AS mv "
            f"FROM (SELECT count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std FROM {src}) s")
    body = _union(parts)
    return (f"SELECT \"column\", pos, n, mean, std, oc AS outlier_count, "
            f"oc / n * 100 AS outlier_pct, "
            f"CASE WHEN mv = ma THEN ma ELSE -ma END AS extreme_value, "
            f"abs(CASE WHEN mv = ma THEN ma ELSE -ma END - mean) / std AS extreme_z "
            f"FROM ({body}) WHERE n >= 10 AND std <> 0 AND oc > 0")


def _dominance_sql(src, cols, min_top_pct=20.0):
    parts = []
    for i, c in enumerate(cols):
        parts.append(
            f"SELECT '{c}' AS \"column\", {i} AS pos, v, cnt, "
            f"row_number() OVER (ORDER BY cnt DESC, v ASC) AS rk, "
            f"sum(cnt) OVER () AS n, count(*) OVER () AS n_unique "
            f"FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS cnt FROM {src} "
            f"WHERE {c} IS NOT NULL GROUP BY 1)")
    ranked = _union(parts)
    return (
        f"SELECT \"column\", pos, CAST(max(n) AS BIGINT) AS n, max(n_unique) AS n_unique, "
        f"max(CASE WHEN rk = 1 THEN v END) AS top_value, "
        f"max(CASE WHEN rk = 1 THEN cnt END) / max(n) * 100 AS top_pct, "
        f"max(CASE WHEN rk = 2 THEN v END) AS second_value, "
        f"max(CASE WHEN rk = 2 THEN cnt END) / max(n) * 100 AS second_pct, "
        f"max(CASE WHEN rk = 3 THEN v END) AS third_value, "
        f"max(CASE WHEN rk = 3 THEN cnt END) / max(n) * 100 AS third_pct, "
        f"(max(n) - sum(CASE WHEN rk <= 3 THEN cnt ELSE 0 END)) / max(n) * 100 AS tail_pct, "
        f"max(n_unique) = 2 AS is_binary "
        f"FROM ({ranked}) GROUP BY \"column\", pos "
        f"HAVING max(n) >= 5 AND max(n_unique) <= greatest(10.0, max(n) * 0.3) "
        f"AND max(CASE WHEN rk = 1 THEN cnt END) / max(n) * 100 >= {min_top_pct}")


def _lag_table_sql(src, order, cols, lags_=lags.DEFAULT_LAGS):
    lag_exprs = ", ".join(
        f"lag(CAST({c} AS DOUBLE), {k}) OVER (ORDER BY {order}) AS lag_{k}_{i}"
        for k in lags_ for i, c in enumerate(cols))
    cur = ", ".join(f"CAST({c} AS DOUBLE) AS cur_{i}" for i, c in enumerate(cols))
    frame = f"(SELECT {cur}, {lag_exprs} FROM {src})"
    parts = []
    for k in lags_:
        for i, a in enumerate(cols):
            for j, b in enumerate(cols):
                if i == j:
                    continue
                parts.append(
                    f"SELECT '{a}' AS cause, '{b}' AS effect, {i} AS pos_cause, {j} AS pos_effect, "
                    f"{k} AS lag_rows, regr_count(cur_{j}, lag_{k}_{i}) AS n, "
                    f"corr(lag_{k}_{i}, cur_{j}) AS r FROM lagged")
    return f"WITH lagged AS {frame}\n" + _union(parts)


def _lead_sql(lag_sql, min_abs=0.25):
    return (
        f"WITH t AS ({lag_sql}), "
        f"b AS (SELECT *, row_number() OVER (PARTITION BY pos_cause, pos_effect "
        f"ORDER BY abs(r) DESC, lag_rows) AS rk FROM t WHERE r IS NOT NULL AND NOT isnan(r) AND r <> 0), "
        f"h AS (SELECT * FROM b WHERE rk = 1 AND abs(r) > {min_abs}), "
        f"f AS (SELECT *, row_number() OVER (PARTITION BY least(pos_cause, pos_effect), "
        f"greatest(pos_cause, pos_effect) ORDER BY pos_cause) AS rk2 FROM h) "
        f"SELECT cause, effect, lag_rows, round(r, 6) AS r_value FROM f WHERE rk2 = 1")


def _cube_sql(src, cols, min_support=0.05):
    """Frequent itemsets of one-item-per-column transactions via CUBE."""
    items = ", ".join(f"CASE WHEN grouping({c}) = 0 AND {c} IS NOT NULL THEN '{c}=' || {c} END"
                      for c in sorted(cols))
    mask = " + ".join(f"(1 - grouping({c})) * {1 << i}" for i, c in enumerate(cols))
    size = " + ".join(f"(1 - grouping({c}))" for c in cols)
    gflags = ", ".join(f"grouping({c}) AS g_{c}" for c in cols)
    return (
        f"WITH t AS MATERIALIZED ({src}), n AS MATERIALIZED (SELECT count(*) AS n FROM t), "
        f"c AS MATERIALIZED (SELECT {_sql_cols(cols)}, {gflags}, concat_ws(', ', {items}) AS items, "
        f"{mask} AS p, {size} AS size, count(*) AS freq FROM t GROUP BY CUBE ({_sql_cols(cols)})), "
        f"fi AS MATERIALIZED (SELECT c.* FROM c, n WHERE c.size > 0 AND c.freq >= {min_support} * n.n)")


def _rules_sql(src, cols, min_support=0.05):
    """Both joins are on a mask of columns and the itemset that it leaves."""
    match = lambda a, b: " AND ".join(f"({a}.g_{c} = 1 OR {a}.{c} = {b}.{c})" for c in cols)
    return (
        _cube_sql(src, cols, min_support) + ", "
        f"m AS MATERIALIZED (SELECT DISTINCT p FROM fi), "
        f"w AS MATERIALIZED (SELECT s.*, m.p AS ap, s.p - m.p AS cp FROM fi s, m "
        f"WHERE s.size >= 2 AND m.p <> s.p AND (m.p & s.p) = m.p), "
        f"r AS MATERIALIZED (SELECT a.items AS antecedent, k.items AS consequent, s.freq, "
        f"s.freq / n.n AS support, s.freq / a.freq AS confidence, "
        f"(s.freq / a.freq) / (k.freq / n.n) AS lift, s.ap, s.cp "
        f"FROM w s JOIN fi a ON a.p = s.ap AND {match('a', 's')} "
        f"JOIN fi k ON k.p = s.cp AND {match('k', 's')}, n) ")


def _title_sql(x):
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '(\\p{{L}}+|[^\\p{{L}}]+)', 1), "
            f"lambda r: CASE WHEN regexp_matches(r, '^\\p{{L}}') THEN upper(substr(r, 1, 1)) || "
            f"lower(substr(r, 2)) ELSE r END), '')")


def _label_sql(x):
    from ..functions.labels import ACRONYMS, UNIT_SUFFIXES
    stem_cases = " ".join(f"WHEN ends_with(lower({x}), '{s}') THEN substr({x}, 1, length({x}) - {len(s)})"
                          for s, _ in UNIT_SUFFIXES)
    unit_cases = " ".join(f"WHEN ends_with(lower({x}), '{s}') THEN '{lab}'" for s, lab in UNIT_SUFFIXES)
    stem = f"(CASE {stem_cases} ELSE {x} END)"
    unit = f"(CASE {unit_cases} ELSE '' END)"
    titled = _title_sql(f"trim(replace({stem}, '_', ' '))")
    acr = " ".join(f"WHEN w = '{k}' THEN '{v}'" for k, v in ACRONYMS.items())
    words = (f"array_to_string(list_transform(list_filter(string_split_regex({titled}, '\\s+'), "
             f"lambda w: w <> ''), lambda w: CASE {acr} ELSE w END), ' ')")
    return f"({words} || {unit})"


# --------------------------------------------------------------------------
# Queries
# --------------------------------------------------------------------------

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# ---- sources / sinks ------------------------------------------------------

@query("csv_roundtrip",
       "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, "
       "c_mktsegment FROM customer")
def q_csv_roundtrip(spark, d):
    """S2 then S1: write customer as CSV to the shared checkpoint folder and
    read it back with schema inference (integers widened to BIGINT)."""
    base = ensure_checkpoint_dir(spark)
    path = f"{base}/csv-{uuid.uuid4().hex}"
    write_csv(load(spark, d, "customer"), path)
    back = read_table(spark, path, fmt="csv")
    return back.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c)
                         for c, t in back.dtypes])


# ---- preparation ------------------------------------------------------------

SQL["null_profile"] = "WITH dl AS (" + DOC_LABELS_SQL + ")\n" + _union([
    f"SELECT '{c}' AS \"column\", {i} AS pos, count(*) AS n_rows, count(*) - count({c}) AS n_null, "
    f"round((count(*) - count({c})) / count(*), 6) AS null_frac FROM dl"
    for i, c in enumerate(DOC_LABEL_COLS)])


@query("null_profile")
def q_null_profile(spark, d):
    p = prepare.null_profile(doc_labels(spark, d))
    return p.select("column", "pos", "n_rows", "n_null", r6("null_frac").alias("null_frac"))


SQL["drop_sparse"] = (
    "WITH dl AS (" + DOC_LABELS_SQL + "), p AS (" + _union([
        f"SELECT '{c}' AS \"column\", {i} AS pos, (count(*) - count({c})) / count(*) AS f FROM dl"
        for i, c in enumerate(DOC_LABEL_COLS)]) +
    ") SELECT \"column\", pos, round(f, 6) AS null_frac, f > 0.5 AS dropped FROM p")


@query("drop_sparse")
def q_drop_sparse(spark, d):
    dl = doc_labels(spark, d)
    prof = prepare.null_profile(dl)
    _, dropped = prepare.drop_sparse(dl, 0.5, profile=prof)
    return prof.select("column", "pos", r6("null_frac").alias("null_frac"),
                       F.col("column").isin(dropped).alias("dropped"))


SQL["median_impute"] = (
    "WITH of AS (" + ORDER_FLAGS_SQL + ") SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice, "
    "round(COALESCE(qty_r, (SELECT median(qty_r) FROM of)), 6) AS qty_r FROM of")


@query("median_impute")
def q_median_impute(spark, d):
    of = order_flags(spark, d).select("o_orderkey", "o_totalprice", "qty_r")
    out, _ = prepare.median_impute(of, ["o_totalprice", "qty_r"])
    return out.select("o_orderkey", r6("o_totalprice").alias("o_totalprice"), r6("qty_r").alias("qty_r"))


_TS_SRC = ("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate_str, o_orderstatus, "
           "o_orderpriority FROM orders")
_TS_COLS = ["o_orderdate_str", "o_orderstatus", "o_orderpriority"]
SQL["infer_timestamp"] = "WITH t AS (" + _TS_SRC + "), f AS (" + _union([
    f"SELECT '{c}' AS \"column\", {i} AS pos, avg(CASE WHEN regexp_matches({c}, "
    f"'^\\s*\\d{{1,4}}[-/.]\\d{{1,2}}[-/.]\\d{{1,4}}') AND TRY_CAST({c} AS TIMESTAMP) IS NOT NULL "
    f"THEN 1.0 ELSE 0.0 END) AS f FROM t" for i, c in enumerate(_TS_COLS)]) + \
    ") SELECT \"column\", pos, round(f, 6) AS parsed_frac, f > 0.5 AS converted FROM f"


@query("infer_timestamp")
def q_infer_timestamp(spark, d):
    o = load(spark, d, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate_str"),
        "o_orderstatus", "o_orderpriority")
    _, chosen = prepare.infer_timestamps(o, _TS_COLS)
    cand = prepare.timestamp_candidates(o, _TS_COLS).filter(F.col("fmt_pos") == 0)
    return cand.select("column", "pos", r6("parsed_frac").alias("parsed_frac"),
                       F.col("column").isin(list(chosen)).alias("converted"))


# dates that are day-first, nine in ten before the 13th
SQL["infer_timestamp_day_first"] = (
    "SELECT o_orderkey, strftime(make_date(CAST(year(o_orderdate) AS INTEGER), CAST(month(o_orderdate) AS INTEGER), "
    "CAST(CASE WHEN o_orderkey % 10 = 0 THEN 28 ELSE o_orderkey % 12 + 1 END AS INTEGER)), '%Y-%m-%d') AS day FROM orders")


@query("infer_timestamp_day_first")
def q_infer_timestamp_day_first(spark, d):
    """P4 where the month-first reading parses most rows, but not as many."""
    day = F.when(F.col("o_orderkey") % 10 == 0, F.lit(28)).otherwise(F.col("o_orderkey") % 12 + 1).cast("int")
    text = F.format_string("%02d/%02d/%04d", day, F.month("o_orderdate"), F.year("o_orderdate"))
    out, _ = prepare.infer_timestamps(load(spark, d, "orders").select("o_orderkey", text.alias("day")), ["day"])
    return out.select("o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day"))


_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
SQL["trim_mode_impute"] = (
    "WITH of AS (" + ORDER_FLAGS_SQL + "), m AS (SELECT v FROM (SELECT " + _STRIP.format("status_r") +
    " AS v, count(*) AS c FROM of WHERE status_r IS NOT NULL AND " + _STRIP.format("status_r") +
    " <> '' GROUP BY 1) ORDER BY c DESC, v ASC LIMIT 1) "
    "SELECT o_orderkey, " + _STRIP.format("o_orderstatus") + " AS o_orderstatus, " +
    _STRIP.format("o_orderpriority") + " AS o_orderpriority, CASE WHEN status_r IS NULL OR " +
    _STRIP.format("status_r") + " = '' THEN (SELECT v FROM m) ELSE " + _STRIP.format("status_r") +
    " END AS status_r FROM of")


@query("trim_mode_impute")
def q_trim_mode_impute(spark, d):
    of = order_flags(spark, d).select("o_orderkey", "o_orderstatus", "o_orderpriority", "status_r")
    out, _ = prepare.clean_strings(of)
    return out


SQL["label_encode"] = (
    "SELECT l_orderkey, l_linenumber, "
    "CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS TINYINT) AS l_returnflag, "
    "CAST(dense_rank() OVER (ORDER BY l_linestatus) - 1 AS TINYINT) AS l_linestatus FROM lineitem")


@query("label_encode")
def q_label_encode(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    out, _ = prepare.label_encode(li)
    return out


_DOC_STR = ["text", "lang", "source"]
SQL["text_modes"] = _union([
    f"SELECT '{c}' AS \"column\", {i} AS pos, bool_or({c} IS NULL OR {_STRIP.format(c)} = '') AS has_gap, "
    f"(SELECT v FROM (SELECT {_STRIP.format(c)} AS v, count(*) AS n FROM documents GROUP BY 1) WHERE v <> '' "
    f"ORDER BY n DESC, v LIMIT 1) AS mode FROM documents" for i, c in enumerate(_DOC_STR)])


@query("text_modes")
def q_text_modes(spark, d):
    """P6 on whole texts, some of them equal and most of them not."""
    return prepare.string_modes(load(spark, d, "documents"), _DOC_STR)


SQL["drop_high_cardinality"] = "SELECT *, CASE WHEN n_unique < 10 THEN 'encode' ELSE 'drop' END AS action FROM (" + \
    _union([f"SELECT '{c}' AS \"column\", {i} AS pos, count(DISTINCT {c}) AS n_unique FROM documents"
            for i, c in enumerate(_DOC_STR)]) + ")"


@query("drop_high_cardinality")
def q_drop_high_cardinality(spark, d):
    plan = prepare.encoding_plan(load(spark, d, "documents"), _DOC_STR)
    return plan.select("column", "pos", "n_unique", "action")


SQL["column_profile"] = "WITH dl AS (" + DOC_LABELS_SQL + ")\n" + _union([
    f"SELECT '{c}' AS \"column\", {i} AS pos, '{r}' AS role, count(*) AS n_rows, "
    f"count(*) - count({c}) AS n_null, round((count(*) - count({c})) / count(*) * 100, 6) AS missing_pct FROM dl"
    for i, (c, r) in enumerate(zip(DOC_LABEL_COLS, DOC_LABEL_ROLES))])


@query("column_profile")
def q_column_profile(spark, d):
    p = prepare.profile(doc_labels(spark, d))
    return p.select("column", "pos", "role", "n_rows", "n_null", r6("missing_pct").alias("missing_pct"))


SQL["complete_cases"] = ("WITH dl AS (" + DOC_LABELS_SQL + ") SELECT doc_id, n_chars, quality, toxic "
                         "FROM dl WHERE doc_id IS NOT NULL AND n_chars IS NOT NULL AND quality IS NOT NULL "
                         "AND toxic IS NOT NULL")


@query("complete_cases")
def q_complete_cases(spark, d):
    dl = doc_labels(spark, d).select("doc_id", "n_chars", "quality", "toxic")
    return prepare.complete_cases(dl)


SQL["prepare_table"] = (
    "WITH of AS (" + ORDER_FLAGS_SQL + "), "
    "m AS (SELECT v FROM (SELECT status_r AS v, count(*) AS c FROM of WHERE status_r IS NOT NULL "
    "GROUP BY 1) ORDER BY c DESC, v LIMIT 1), "
    "f AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, "
    "COALESCE(qty_r, (SELECT median(qty_r) FROM of)) AS qty_r, "
    "COALESCE(status_r, (SELECT v FROM m)) AS status_r FROM of) "
    "SELECT o_orderkey, o_custkey, "
    "CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS TINYINT) AS o_orderstatus, "
    "round(o_totalprice, 6) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, "
    "CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS TINYINT) AS o_orderpriority, "
    "round(qty_r, 6) AS qty_r, "
    "CAST(dense_rank() OVER (ORDER BY status_r) - 1 AS TINYINT) AS status_r FROM f")


@query("prepare_table")
def q_prepare_table(spark, d):
    """P10 end to end on order_flags: median + mode imputation, encoding."""
    prep = prepare.prepare(order_flags(spark, d))
    e = prep.encoded
    return e.select("o_orderkey", "o_custkey", "o_orderstatus", r6("o_totalprice").alias("o_totalprice"),
                    F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"),
                    "o_orderpriority", r6("qty_r").alias("qty_r"), "status_r")


# ---- correlations -----------------------------------------------------------

SQL["pearson_pairs"] = (
    "SELECT col_a, col_b, round(r, 6) AS r_value, "
    "CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction, "
    "CASE WHEN abs(r) > 0.65 THEN 'strong' ELSE 'moderate' END AS strength FROM ("
    + _corr_pairs_sql("part", PART_NUM) + ") WHERE r IS NOT NULL AND abs(r) > 0.3")


@query("pearson_pairs")
def q_pearson_pairs(spark, d):
    f = correlations.pearson_findings(load(spark, d, "part"), PART_NUM, with_spearman=False)
    return f.select("col_a", "col_b", r6("r_value").alias("r_value"), "direction", "strength")


def _avg_rank(c):
    return (f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)")


SQL["spearman_pairs"] = (
    "WITH rk AS (SELECT " + ", ".join(f"{_avg_rank(c)} AS {c}" for c in PART_NUM) + " FROM part) "
    "SELECT col_a, col_b, round(r, 6) AS spearman FROM (" + _corr_pairs_sql("rk", PART_NUM) + ")")


@query("spearman_pairs")
def q_spearman_pairs(spark, d):
    s = correlations.spearman_long(load(spark, d, "part"), PART_NUM)
    return s.select("col_a", "col_b", r6("spearman").alias("spearman"))


SQL["correlation_matrix"] = (
    "SELECT col_a AS col_x, col_b AS col_y, round(r, 6) AS r FROM ("
    + _corr_pairs_sql("lineitem", LINEITEM_NUM, diagonal=True, both=True) + ")")


@query("correlation_matrix")
def q_correlation_matrix(spark, d):
    m = correlations.correlation_matrix(load(spark, d, "lineitem"), LINEITEM_NUM)
    return m.select("col_x", "col_y", r6("r").alias("r"))


SQL["strongest_pairs"] = (
    "WITH h AS (" + _corr_pairs_sql("part", PART_NUM) + "), "
    "s AS (SELECT 'positive' AS sign, col_a AS col_x, col_b AS col_y, r, "
    "row_number() OVER (ORDER BY r DESC, pos_a, pos_b) AS rank FROM h WHERE r > 0.45 "
    "UNION ALL SELECT 'negative', col_a, col_b, r, row_number() OVER (ORDER BY r ASC, pos_a, pos_b) "
    "FROM h WHERE r < -0.45) "
    "SELECT sign, CAST(rank AS INTEGER) AS rank, col_x, col_y, round(r, 6) AS r FROM s WHERE rank <= 2")


@query("strongest_pairs")
def q_strongest_pairs(spark, d):
    m = correlations.correlation_matrix(load(spark, d, "part"), PART_NUM)
    s = correlations.strongest_pairs(m)
    return s.select("sign", "rank", "col_x", "col_y", r6("r").alias("r"))


# ---- numeric column statistics ------------------------------------------------

SQL["sigma_outliers"] = (
    "SELECT \"column\", n, round(mean, 6) AS mean, round(std, 6) AS std, outlier_count, "
    "round(outlier_pct, 6) AS outlier_pct, round(extreme_value, 6) AS extreme_value, "
    "round(extreme_z, 6) AS extreme_z FROM (" + _outliers_sql("events", EVENTS_NUM) + ")")


@query("sigma_outliers")
def q_sigma_outliers(spark, d):
    o = numeric.sigma_outliers(load(spark, d, "events"), EVENTS_NUM)
    return o.select("column", "n", r6("mean").alias("mean"), r6("std").alias("std"), "outlier_count",
                    r6("outlier_pct").alias("outlier_pct"), r6("extreme_value").alias("extreme_value"),
                    r6("extreme_z").alias("extreme_z"))


_DL_NUM = ["doc_id", "n_chars", "quality", "toxic"]
SQL["skew_findings"] = (
    "WITH dl AS (" + DOC_LABELS_SQL + ") SELECT \"column\", round(skew, 6) AS skew, "
    "round(median, 6) AS median, round(mean, 6) AS mean, "
    "CASE WHEN skew > 0 THEN 'right' ELSE 'left' END AS direction FROM ("
    + _shape_sql("dl", _DL_NUM) + ") WHERE n >= 5 AND abs(skew) > 1.0")


@query("skew_findings")
def q_skew_findings(spark, d):
    shape = numeric.shape_stats(doc_labels(spark, d), _DL_NUM)
    f = numeric.skew_findings(shape)
    return f.select("column", r6("skew").alias("skew"), r6("median").alias("median"),
                    r6("mean").alias("mean"), "direction")


SQL["variability_findings"] = (
    "SELECT \"column\", round(cv, 6) AS cv, round(q1, 6) AS q1, round(q3, 6) AS q3, "
    "round(iqr, 6) AS iqr FROM (" + _shape_sql("lineitem", LINEITEM_NUM) + ") "
    "WHERE n >= 5 AND NOT coalesce(abs(skew) > 1.0, false) AND cv > 50")


@query("variability_findings")
def q_variability_findings(spark, d):
    shape = numeric.shape_stats(load(spark, d, "lineitem"), LINEITEM_NUM)
    f = numeric.variability_findings(shape)
    return f.select("column", r6("cv").alias("cv"), r6("q1").alias("q1"), r6("q3").alias("q3"),
                    r6("iqr").alias("iqr"))


SQL["skew_verdict"] = (
    "SELECT \"column\", round(skew, 6) AS skew, abs(skew) > 0.8 AS skewed, "
    "CASE WHEN abs(skew) <= 0.8 THEN 'balanced' WHEN skew > 0 THEN 'right' ELSE 'left' END AS direction "
    "FROM (" + _moments_sql("lineitem", LINEITEM_NUM[:2]) + ")")


@query("skew_verdict")
def q_skew_verdict(spark, d):
    v = numeric.skew_verdict(load(spark, d, "lineitem"), LINEITEM_NUM)
    return v.select("column", r6("skew").alias("skew"), "skewed", "direction")


# ---- categories ---------------------------------------------------------------

def _dominance_query(table, cols):
    def run(spark, d):
        f = categorical.dominant_categories(load(spark, d, table), cols)
        return f.select("column", "n", "n_unique", "top_value", r6("top_pct").alias("top_pct"),
                        "second_value", r6("second_pct").alias("second_pct"), "third_value",
                        r6("third_pct").alias("third_pct"), r6("tail_pct").alias("tail_pct"),
                        "is_binary")
    sql = ("SELECT \"column\", n, n_unique, top_value, round(top_pct, 6) AS top_pct, second_value, "
           "round(second_pct, 6) AS second_pct, third_value, round(third_pct, 6) AS third_pct, "
           "round(tail_pct, 6) AS tail_pct, is_binary FROM (" + _dominance_sql(table, cols) + ")")
    return run, sql


Q["category_dominance"], SQL["category_dominance"] = _dominance_query(
    "orders", ["o_orderstatus", "o_orderpriority"])
Q["category_dominance_documents"], SQL["category_dominance_documents"] = _dominance_query(
    "documents", ["text", "lang", "source"])

SQL["rule_candidates"] = (
    "WITH t AS (" + LINE_ORDERS_SQL + "), n AS (SELECT count(*) AS n FROM t), d AS (" +
    _union([f"SELECT '{c}' AS \"column\", {i} AS pos, count(DISTINCT {c}) AS n_unique FROM t"
            for i, c in enumerate(RULE_COLS)]) +
    ") SELECT \"column\", pos, n_unique FROM d, n WHERE n_unique >= 2 AND "
    "n_unique <= greatest(5, CAST(floor(n.n * 0.2) AS BIGINT))")


@query("rule_candidates")
def q_rule_candidates(spark, d):
    return categorical.rule_candidates(line_orders(spark, d), RULE_COLS).select("column", "pos", "n_unique")


# ---- segments ----------------------------------------------------------------------

SQL["segment_profile"] = (
    "WITH long AS (" + _union([f"SELECT l_returnflag AS segment, '{c}' AS feature, {i} AS pos, "
                                f"CAST({c} AS DOUBLE) AS v FROM lineitem"
                                for i, c in enumerate(LINEITEM_NUM)]) + "), "
    "seg AS (SELECT segment, feature, pos, avg(v) AS mean FROM long GROUP BY 1, 2, 3), "
    "ov AS (SELECT feature, avg(v) AS overall_mean FROM long GROUP BY 1), "
    "sz AS (SELECT l_returnflag AS segment, count(*) AS n, count(*) / sum(count(*)) OVER () * 100 AS size_pct "
    "FROM lineitem GROUP BY 1), "
    "j AS (SELECT seg.*, ov.overall_mean, abs(mean - overall_mean) / "
    "CASE WHEN overall_mean = 0 THEN 1e-9 ELSE overall_mean END AS diff FROM seg JOIN ov USING (feature)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY diff DESC, pos) AS rank FROM j) "
    "SELECT r.segment, round(sz.size_pct, 6) AS size_pct, sz.n, CAST(r.rank AS INTEGER) AS rank, r.feature, "
    "round(r.mean, 6) AS mean, round(r.overall_mean, 6) AS overall_mean, round(r.diff, 6) AS diff "
    "FROM r JOIN sz USING (segment) WHERE r.rank <= 3")


@query("segment_profile")
def q_segment_profile(spark, d):
    li = load(spark, d, "lineitem").select("l_returnflag", *LINEITEM_NUM)
    p = segments.segment_profile(li, "l_returnflag", LINEITEM_NUM)
    return p.select("segment", r6("size_pct").alias("size_pct"), "n", "rank", "feature",
                    r6("mean").alias("mean"), r6("overall_mean").alias("overall_mean"),
                    r6("diff").alias("diff"))


@query("kmeans_segments")
def q_kmeans_segments(spark, d):
    """No oracle: the random starts differ from any SQL formulation; the
    iterations have one (``kmeans_given_starts``)."""
    p = segments.kmeans_profile(load(spark, d, "events"), EVENTS_NUM)
    return p.select("segment", "size_pct", "rank", "feature", "mean", "k", "silhouette")


# ---- association rules ---------------------------------------------------------

SQL["frequent_itemsets"] = (
    _cube_sql(LINE_ORDERS_SQL, RULE_COLS) +
    " SELECT items, CAST(size AS INTEGER) AS size, freq, round(freq / n.n, 6) AS support FROM fi, n")


@query("frequent_itemsets")
def q_frequent_itemsets(spark, d):
    fi = rules.frequent_itemsets(line_orders(spark, d), RULE_COLS)
    return fi.select(F.array_join("items", ", ").alias("items"), "size", "freq",
                     r6("support").alias("support"))


SQL["association_rules"] = (
    _rules_sql(LINE_ORDERS_SQL, RULE_COLS) +
    "SELECT antecedent, consequent, freq, round(support, 6) AS support, "
    "round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM r "
    "WHERE lift >= 1.0 AND confidence >= 0.4")


def _rules_df(spark, d):
    lo = line_orders(spark, d)
    n = lo.count()
    fi = rules.frequent_itemsets(lo, RULE_COLS, n_rows=n)
    return rules.association_rules(fi, n)


@query("association_rules")
def q_association_rules(spark, d):
    r = _rules_df(spark, d)
    return r.select(F.array_join("antecedent", ", ").alias("antecedent"),
                    F.array_join("consequent", ", ").alias("consequent"), "freq",
                    r6("support").alias("support"), r6("confidence").alias("confidence"),
                    r6("lift").alias("lift"))


SQL["rule_dedup"] = (
    _rules_sql(LINE_ORDERS_SQL, RULE_COLS) + ", "
    "q AS (SELECT * FROM r WHERE lift >= 1.0 AND confidence >= 0.4 AND (ap & cp) = 0), "
    "u AS (SELECT *, row_number() OVER (PARTITION BY least(ap, cp), greatest(ap, cp) "
    "ORDER BY lift DESC, confidence DESC, antecedent, consequent) AS k FROM q), "
    "top AS (SELECT *, row_number() OVER (ORDER BY lift DESC, confidence DESC, antecedent, consequent) "
    "AS rank FROM u WHERE k = 1) "
    "SELECT CAST(rank AS INTEGER) AS rank, antecedent, consequent, round(support, 6) AS support, "
    "round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM top WHERE rank <= 5")


@query("rule_dedup")
def q_rule_dedup(spark, d):
    top = rules.dedup_rules(_rules_df(spark, d))
    return top.select("rank", F.array_join("antecedent", ", ").alias("antecedent"),
                      F.array_join("consequent", ", ").alias("consequent"),
                      r6("support").alias("support"), r6("confidence").alias("confidence"),
                      r6("lift").alias("lift"))


SQL["rule_insight_scores"] = (
    _rules_sql(LINE_ORDERS_SQL, RULE_COLS) + ", "
    "q AS (SELECT * FROM r WHERE lift >= 1.0 AND confidence >= 0.4 AND (ap & cp) = 0), "
    "u AS (SELECT *, row_number() OVER (PARTITION BY least(ap, cp), greatest(ap, cp) "
    "ORDER BY lift DESC, confidence DESC, antecedent, consequent) AS k FROM q), "
    "top AS (SELECT *, row_number() OVER (ORDER BY lift DESC, confidence DESC, antecedent, consequent) "
    "AS rank FROM u WHERE k = 1), "
    "s AS (SELECT antecedent, consequent, least((lift - 1) * 20 + confidence * 50, 100) AS conf_s, "
    "65 + least(4 * (bit_count(ap) + bit_count(cp)), 20) AS nov_s, "
    "least(confidence * 60 + (lift - 1) * 10, 100) AS imp_s FROM top WHERE rank <= 5) "
    "SELECT 'association' AS type, antecedent, consequent, round(conf_s, 6) AS confidence, "
    "round(CAST(nov_s AS DOUBLE), 6) AS novelty, round(imp_s, 6) AS impact, "
    "round(0.4 * conf_s + 0.3 * nov_s + 0.3 * imp_s, 6) AS final_score FROM s")


@query("rule_insight_scores")
def q_rule_insight_scores(spark, d):
    """M10 + R1-R4: the de-duplicated rules as scored association insights."""
    from ..functions.scoring import score
    from ..plans.discovery import rule_insights
    from ..schema import conform
    ins = score(conform(rule_insights(line_orders(spark, d), RULE_COLS)))
    return ins.select("type", F.array_join("antecedent", ", ").alias("antecedent"),
                      F.array_join("consequent", ", ").alias("consequent"),
                      r6("confidence").alias("confidence"), r6("novelty").alias("novelty"),
                      r6("impact").alias("impact"), r6("final_score").alias("final_score"))


@query("discover_line_orders")
def q_discover_line_orders(spark, d):
    """No oracle: every miner on line items joined with their orders (numeric,
    category and date columns; the line key breaks ship-date ties)."""
    li = load(spark, d, "lineitem")
    o = load(spark, d, "orders")
    t = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_returnflag", "l_linestatus", "o_orderpriority", "l_shipdate")
    ins = discover(t, tiebreak=["l_orderkey", "l_linenumber"])
    return ins.select("type", "col_a", "col_b", "column", "final_score", "seq")


# ---- lead / lag ---------------------------------------------------------------------

_EV_LAG_SQL = _lag_table_sql("events", "ts", EVENTS_NUM)
SQL["lag_correlations"] = ("SELECT cause, effect, lag_rows, n, round(r, 6) AS r FROM (" +
                           _EV_LAG_SQL + ")")


@query("lag_correlations")
def q_lag_correlations(spark, d):
    t = lags.lag_correlations(load(spark, d, "events"), "ts", EVENTS_NUM)
    return t.select("cause", "effect", "lag_rows", "n", r6("r").alias("r"))


SQL["lead_indicators"] = _lead_sql(_EV_LAG_SQL)


@query("lead_indicators")
def q_lead_indicators(spark, d):
    t = lags.lag_correlations(load(spark, d, "events"), "ts", EVENTS_NUM)
    f = lags.lead_indicators(t)
    return f.select("cause", "effect", "lag_rows", r6("r_value").alias("r_value"))


_OR_NUM = ["o_custkey", "o_totalprice"]
_OR_LAG_SQL = _lag_table_sql("orders", "o_orderdate, o_orderkey", _OR_NUM)
SQL["lag_correlations_orders"] = ("SELECT cause, effect, lag_rows, n, round(r, 6) AS r FROM (" +
                                  _OR_LAG_SQL + ")")


@query("lag_correlations_orders")
def q_lag_correlations_orders(spark, d):
    """Duplicate order dates: the order key breaks ties."""
    t = lags.lag_correlations(load(spark, d, "orders"), "o_orderdate", _OR_NUM, tiebreak=["o_orderkey"])
    return t.select("cause", "effect", "lag_rows", "n", r6("r").alias("r"))


# ---- insight table: scoring and ranking ------------------------------------------

def _event_findings_sql():
    """anomaly + distribution + numeric findings of the prepared events table,
    with their scores, in SQL."""
    enc = ("SELECT event_id, user_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS TINYINT) "
           "AS event_type, value FROM events")
    num = ["event_id", "user_id", "event_type", "value"]
    cats = ["event_type", "props"]
    anomalies = (f"SELECT 'anomaly' AS type, \"column\", 4000000000 + pos AS seq, outlier_count, "
                 f"NULL::DOUBLE AS top_pct, NULL::BIGINT AS n_unique, NULL::DOUBLE AS skew, NULL::DOUBLE AS cv "
                 f"FROM ({_outliers_sql('enc', num)})")
    dist = (f"SELECT 'distribution', \"column\", 5000000000 + pos, NULL, top_pct, n_unique, NULL, NULL "
            f"FROM ({_dominance_sql('events', cats)})")
    shape = f"({_shape_sql('enc', num)})"
    skew = (f"SELECT 'numeric_insight', \"column\", 6000000000 + pos, NULL, NULL, NULL, skew, NULL "
            f"FROM {shape} WHERE n >= 5 AND abs(skew) > 1.0")
    cv = (f"SELECT 'numeric_insight', \"column\", 6000000000 + pos, NULL, NULL, NULL, NULL, cv "
          f"FROM {shape} WHERE n >= 5 AND NOT coalesce(abs(skew) > 1.0, false) AND cv > 50")
    f = _union([anomalies, dist, skew, cv])
    conf = ("CASE type WHEN 'anomaly' THEN 90.0 WHEN 'distribution' THEN least(top_pct, 100) "
            "ELSE CASE WHEN skew IS NOT NULL AND skew <> 0 THEN least(abs(skew) * 30 + 40, 100) "
            "WHEN cv IS NOT NULL AND cv <> 0 THEN least(cv * 0.5 + 40, 100) ELSE 60.0 END END")
    nov = "CASE type WHEN 'anomaly' THEN 75.0 WHEN 'distribution' THEN 50.0 ELSE 60.0 END"
    imp = ("CASE type WHEN 'anomaly' THEN least(85 + outlier_count * 2, 100) "
           "WHEN 'distribution' THEN least(top_pct * 0.5 + n_unique * 3, 100) "
           "ELSE CASE WHEN skew IS NOT NULL AND skew <> 0 THEN least(abs(skew) * 25 + 30, 100) "
           "WHEN cv IS NOT NULL AND cv <> 0 THEN least(cv * 0.4 + 30, 100) ELSE 50.0 END END")
    return (f"WITH enc AS ({enc}), f AS ({f}), "
            f"s AS (SELECT type, \"column\", seq, CAST({conf} AS DOUBLE) AS confidence, "
            f"CAST({nov} AS DOUBLE) AS novelty, CAST({imp} AS DOUBLE) AS impact FROM f), "
            f"sc AS (SELECT *, 0.4 * confidence + 0.3 * novelty + 0.3 * impact AS final_score FROM s)")


def _event_insights(spark, d):
    return discover(load(spark, d, "events"), miners=["anomaly", "distribution", "numeric_insight"])


SQL["insight_scores"] = (_event_findings_sql() +
                         " SELECT type, \"column\", CAST(seq AS BIGINT) AS seq, round(confidence, 6) AS confidence, "
                         "round(novelty, 6) AS novelty, round(impact, 6) AS impact, "
                         "round(final_score, 6) AS final_score FROM sc")


@query("insight_scores")
def q_insight_scores(spark, d):
    ins = _event_insights(spark, d)
    return ins.select("type", "column", "seq", r6("confidence").alias("confidence"),
                      r6("novelty").alias("novelty"), r6("impact").alias("impact"),
                      r6("final_score").alias("final_score"))


SQL["insight_rank"] = (_event_findings_sql() +
                       " SELECT CAST(row_number() OVER (ORDER BY final_score DESC, seq) AS INTEGER) AS position, "
                       "type, \"column\", round(final_score, 6) AS final_score FROM sc")


@query("insight_rank")
def q_insight_rank(spark, d):
    from pyspark.sql import Window
    ins = _event_insights(spark, d)
    # the insight table has one row per finding (bounded by the column count)
    w = Window.orderBy(F.col("final_score").desc(), F.col("seq"))
    return ins.select(F.row_number().over(w).alias("position"), "type", "column",
                      r6("final_score").alias("final_score"))


SQL["diverse_top_n"] = (
    _event_findings_sql() +
    ", k AS (SELECT *, row_number() OVER (PARTITION BY coalesce(type, 'unknown') "
    "ORDER BY final_score DESC, seq) AS rn FROM sc WHERE final_score >= 50), "
    "o AS (SELECT *, row_number() OVER (ORDER BY rn > 3, final_score DESC, seq) AS display_rank FROM k) "
    "SELECT CAST(display_rank AS INTEGER) AS display_rank, type, \"column\", "
    "round(final_score, 6) AS final_score FROM o WHERE display_rank <= 10")


@query("diverse_top_n")
def q_diverse_top_n(spark, d):
    top = diverse_top(_event_insights(spark, d), n=10, max_per_type=3, min_score=50)
    return top.select("display_rank", "type", "column", r6("final_score").alias("final_score"))


def _fixed_sql(x, digits):
    """A number with fixed decimals, halves away from zero."""
    return f"CAST(CAST(round(CAST({x} AS DECIMAL(30,9)), {digits}) AS DECIMAL(30,{digits})) AS VARCHAR)"


def _event_texts_sql():
    """Findings of the prepared events table with their texts (T1-T3), as the
    table x beside those of :func:`_event_findings_sql`."""
    num, cats = ["event_id", "user_id", "event_type", "value"], ["event_type", "props"]
    f2, f1 = (lambda x: _fixed_sql(x, 2)), (lambda x: _fixed_sql(x, 1))
    label = "'**' || " + _label_sql('"column"') + " || '**'"
    hold = lambda figure, subject: (
        f"'Does the ' || {figure} || ' of ' || {subject} || ' hold in every part of the table?', "
        f"'Which other columns matter for ' || {subject} || '?'")
    top = "'**' || top_value || '**'"
    others = ("concat_ws(', ', " + ", ".join(
        f"'**' || {w}_value || '** (' || {f1(w + '_pct')} || '%)'" for w in ("top", "second", "third")) + ")")
    anomaly = (
        f"SELECT 'anomaly' AS type, \"column\", {label} || ' has **' || outlier_count || ' outlier(s)** (' || {f1('outlier_pct')} || "
        f"'% of values) more than 3 standard deviations from the mean (' || {f2('mean')} || ' ± ' || {f2('std')} || "
        f"'); the most extreme is **' || {f2('extreme_value')} || '** (' || {f1('extreme_z')} || 'σ).' AS description, "
        f"'The **' || outlier_count || ' extreme value(s)** in ' || {label} || ' may be exceptional events or data errors "
        f"and are worth a closer look.' AS hypothesis, "
        f"[{hold("outlier_count || ' extreme value(s)'", label)}, CASE WHEN outlier_count = 1 THEN "
        f"'Is the one value a mistake of recording?' ELSE 'Do the extreme values share a time, a source or a category?' END] "
        f"AS questions FROM ({_outliers_sql('enc', num)})")
    share = (
        f"SELECT 'distribution', \"column\", CASE WHEN is_binary THEN {label} || ' is binary: ' || {top} || ' makes up ' || "
        f"{f1('top_pct')} || '% of records against **' || second_value || '** at ' || {f1('second_pct')} || '%.' ELSE {label} || "
        f"' has **' || n_unique || ' categories**; the top ones are ' || {others} || '. The other ' || greatest(n_unique - 3, 0) || "
        f"' account for **' || {f1('tail_pct')} || '%** of the data.' END, "
        f"'Most records of ' || {label} || ' fall on ' || {top} || ' (' || {f1('top_pct')} || '%); a model trained on it without "
        f"balancing will favour that value.', "
        f"[{hold(f1('top_pct') + " || '%'", top + " || ' in ' || " + label)}, CASE WHEN top_pct > 50 THEN "
        f"'What is left to learn once the leading value is set aside?' ELSE 'Which of the ' || n_unique || ' values gain ground "
        f"over time?' END] FROM ({_dominance_sql('events', cats)})")
    shape = f"({_shape_sql('enc', num)})"
    skew = (
        f"SELECT 'numeric_insight', \"column\", {label} || ' is **' || CASE WHEN skew > 0 THEN 'right-skewed (a long upper tail)' "
        f"ELSE 'left-skewed (a long lower tail)' END || '** (skewness = ' || {f2('skew')} || '); median **' || {f2('median')} || "
        f"'** against mean **' || {f2('mean')} || '**.', 'The skew of ' || {label} || ' pulls the mean toward its ' || "
        f"CASE WHEN skew > 0 THEN 'upper' ELSE 'lower' END || ' tail; median-based figures describe the typical case better.', "
        f"[{hold("'skewness of ' || " + f2('skew'), label)}, CASE WHEN skew > 0 THEN 'Is a logarithm the better scale for it?' "
        f"ELSE 'Is there an upper limit that the values press against?' END] FROM {shape} WHERE n >= 5 AND abs(skew) > 1.0")
    cv = (
        f"SELECT 'numeric_insight', \"column\", {label} || ' varies widely (coefficient of variation = ' || {f1('cv')} || "
        f"'%); the interquartile range runs **' || {f2('q1')} || ' → ' || {f2('q3')} || '** (IQR = ' || {f2('iqr')} || ').', "
        f"'The spread of ' || {label} || ' (CV = ' || {f1('cv')} || '%) suggests several sub-populations; compare it segment by "
        f"segment.', [{hold("'coefficient of variation of ' || " + f1('cv') + " || '%'", label)}, "
        f"'Which category splits it into parts that vary less?'] FROM {shape} WHERE n >= 5 "
        f"AND NOT coalesce(abs(skew) > 1.0, false) AND cv > 50")
    return f"{_event_findings_sql()}, x AS ({_union([anomaly, share, skew, cv])}) "


SQL["narrate_insights"] = _event_texts_sql() + (
    "SELECT type, \"column\", description, hypothesis, array_to_string(questions, ' | ') AS questions FROM x")


@query("narrate_insights")
def q_narrate_insights(spark, d):
    """T1-T3 of the deterministic miners."""
    ins = _event_insights(spark, d)
    return ins.select("type", "column", "description", "hypothesis", F.array_join("questions", " | ").alias("questions"))


SQL["insight_table"] = _event_texts_sql() + (
    "SELECT round(sc.final_score, 6) AS final_score, x.type, replace(x.description, '**', '') AS description, x.\"column\", "
    "replace(hypothesis, '**', '') AS hypothesis, replace(array_to_string(questions, ' | '), '**', '') AS questions "
    "FROM x JOIN sc ON x.type = sc.type AND x.\"column\" = sc.\"column\"")


@query("insight_table")
def q_insight_table(spark, d):
    """S3: the columns that lead, texts without marks."""
    t = insight_table(_event_insights(spark, d))
    lead = t.columns[:3]
    return t.select(*[r6(c).alias(c) if c == "final_score" else F.col(c) for c in lead], "column", "hypothesis",
                    F.array_join("questions", " | ").alias("questions"))


@query("discover_events")
def q_discover_events(spark, d):
    """No oracle: every miner (K-means and FP-growth included) on events."""
    ins = discover(load(spark, d, "events"))
    return ins.select("type", "col_a", "col_b", "column", "final_score", "seq")


# ---- labels and markup ------------------------------------------------------------

SQL["readable_labels"] = "SELECT p_partkey, " + _label_sql("p_name") + " AS label FROM part"


@query("readable_labels")
def q_readable_labels(spark, d):
    return load(spark, d, "part").select("p_partkey", readable_label("p_name").alias("label"))


SQL["transactions"] = (
    "SELECT concat_ws(', ', 'l_returnflag=' || l_returnflag, 'l_linestatus=' || l_linestatus, "
    "'o_orderstatus=' || o_orderstatus, 'o_orderpriority=' || o_orderpriority) AS items, "
    "count(*) AS n FROM (" + LINE_ORDERS_SQL + ") GROUP BY 1")


@query("transactions")
def q_transactions(spark, d):
    """M6: one item per non-null category value; distinct transactions counted."""
    tx = rules.transactions(line_orders(spark, d), RULE_COLS)
    return tx.groupBy(F.array_join("items", ", ").alias("items")).agg(F.count(F.lit(1)).alias("n"))


SQL["item_labels"] = (
    "SELECT DISTINCT " + _label_sql("'l_linestatus'") + " || ' is ' || l_linestatus AS label "
    "FROM lineitem UNION SELECT DISTINCT " + _label_sql("'o_orderpriority'") +
    " || ' is ' || o_orderpriority FROM orders")


@query("item_labels")
def q_item_labels(spark, d):
    """T5 on every distinct item of two category columns, markers removed."""
    from ..functions.labels import item_label
    li = load(spark, d, "lineitem").select(F.concat(F.lit("l_linestatus="), "l_linestatus").alias("item"))
    o = load(spark, d, "orders").select(F.concat(F.lit("o_orderpriority="), "o_orderpriority").alias("item"))
    items = li.unionByName(o).distinct()
    return items.select(F.replace(item_label("item"), F.lit("**"), F.lit("")).alias("label")).distinct()


SQL["markup_to_html"] = (
    "SELECT doc_id, regexp_replace(regexp_replace(text, '\\*\\*(.*?)\\*\\*', '<strong>\\1</strong>', 'g'), "
    "'\\*(.*?)\\*', '<em>\\1</em>', 'g') AS html FROM documents")


@query("markup_to_html")
def q_markup_to_html(spark, d):
    return load(spark, d, "documents").select("doc_id", markup_to_html("text").alias("html"))


# ---- what-if --------------------------------------------------------------------

def _candidates_sql(table, cols):
    from ..operators.whatif import EXCLUDED_NAME_PARTS, KPI_NAME_PARTS
    bad = "|".join(EXCLUDED_NAME_PARTS)
    kpi = "|".join(KPI_NAME_PARTS)
    cc = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    nu = _union([f"SELECT '{c}' AS \"column\", {i} AS pos, count(DISTINCT {c}) AS n_unique FROM cc"
                 for i, c in enumerate(cols)])
    return (
        f"WITH cc AS (SELECT * FROM {table} WHERE {cc}), nu AS ({nu}), "
        f"b AS (SELECT *, NOT regexp_matches(lower(\"column\"), '{bad}') AND n_unique > 2 AS base_ok FROM nu), "
        f"v AS (SELECT *, CASE WHEN sum(CAST(base_ok AS INT)) OVER () >= 2 THEN base_ok "
        f"ELSE n_unique > 1 END AS v0 FROM b), "
        f"w AS (SELECT *, v0 AND sum(CAST(v0 AS INT)) OVER () >= 2 AS valid FROM v), "
        f"k AS (SELECT *, valid AND regexp_matches(lower(\"column\"), '{kpi}') AS kpi FROM w) "
        f"SELECT \"column\", pos, n_unique > 1 AS varies, n_unique > 2 AS several, valid, CASE WHEN sum(CAST(kpi AS INT)) OVER () > 0 THEN kpi "
        f"ELSE valid END AS is_target FROM k")


SQL["whatif_candidates"] = _candidates_sql("lineitem", LINEITEM_NUM)


@query("whatif_candidates")
def q_whatif_candidates(spark, d):
    return whatif.whatif_candidates(load(spark, d, "lineitem").select(*LINEITEM_NUM))


@query("whatif_scenarios")
def q_whatif_scenarios(spark, d):
    """No oracle: random-forest predictions."""
    return whatif.auto_whatif(load(spark, d, "part").select(*PART_NUM))


@query("whatif_single")
def q_whatif_single(spark, d):
    """No oracle: one +10 % scenario with its top drivers."""
    return whatif.whatif(load(spark, d, "part").select(*PART_NUM), "p_retailprice", "p_size", 10.0)


@query("top_drivers")
def q_top_drivers(spark, d):
    """No oracle: random-forest feature importances (W2) for the part
    retail price (50 trees, as the what-if model)."""
    from ..operators.whatif import fit_outcome_model, laid_out, numeric_frame, top_drivers
    data, cols = numeric_frame(load(spark, d, "part").select(*PART_NUM))
    data = laid_out(data)
    features = [c for c in cols if c != "p_retailprice"]
    model = fit_outcome_model(data, "p_retailprice", features)
    rows = [(i + 1, x["raw_col"], x["importance"]) for i, x in enumerate(top_drivers(model, features))]
    return spark.createDataFrame(rows, "rank int, raw_col string, importance double")


@query("kmeans_scaled")
def q_kmeans_scaled(spark, d):
    """No oracle: P11 standardisation before the K-means search."""
    p = segments.kmeans_profile(load(spark, d, "part"), PART_NUM, scale=True)
    return p.select("segment", "size_pct", "rank", "feature", "mean", "k", "silhouette")


def _lloyd_sql(steps: int) -> str:
    """Iterations over standardised columns from the rows of the three least keys."""
    out = ["WITH d AS (SELECT CAST(p_partkey AS DOUBLE) AS x0, CAST(p_size AS DOUBLE) AS x1, "
           "CAST(p_retailprice AS DOUBLE) AS x2 FROM part)",
           "w AS (SELECT stddev_samp(x0) AS w0, stddev_samp(x1) AS w1, stddev_samp(x2) AS w2 FROM d)",
           "c0 AS (SELECT CAST(row_number() OVER (ORDER BY x0) - 1 AS INTEGER) AS g, x0, x1, x2 FROM d "
           "ORDER BY x0 LIMIT 3)"]
    for k in range(1, steps + 1):
        far = " + ".join(f"((d.x{i} - c.x{i}) / w{i}) * ((d.x{i} - c.x{i}) / w{i})" for i in range(3))
        out.append(f"f{k} AS (SELECT d.x0, d.x1, d.x2, c.g, {far} AS far FROM d, c{k - 1} c, w)")
        out.append(f"a{k} AS (SELECT *, row_number() OVER (PARTITION BY x0 ORDER BY far, g) AS pick FROM f{k})")
        out.append(f"c{k} AS (SELECT g, count(*) AS n, avg(x0) AS x0, avg(x1) AS x1, avg(x2) AS x2 "
                   f"FROM a{k} WHERE pick = 1 GROUP BY g)")
    each = " UNION ALL ".join(f"SELECT g AS segment, n, '{c}' AS feature, round(x{i}, 4) AS centre FROM c{steps}"
                              for i, c in enumerate(PART_NUM))
    return (", ".join(out) + f", e AS (SELECT round(sum(far), 4) AS cost FROM a{steps} WHERE pick = 1) "
            f"SELECT r.*, e.cost FROM ({each}) r, e")


SQL["kmeans_given_starts"] = _lloyd_sql(4)


@query("kmeans_given_starts")
def q_kmeans_given_starts(spark, d):
    """M3's passes and P11 from given centres: the parts of the three least keys."""
    part = load(spark, d, "part")
    first = [[float(v) for v in r] for r in part.select(*PART_NUM).orderBy("p_partkey").limit(3).collect()]
    got = segments.kmeans_from(part, first, 4, PART_NUM, scale=True)
    return got.select("segment", "n", "feature", F.round("centre", 4).alias("centre"), F.round("cost", 4).alias("cost"))


# ---- exploration aggregates ---------------------------------------------------------

SQL["headline"] = "SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_cols, CAST(8 AS BIGINT) AS n_numeric FROM lineitem"


@query("headline")
def q_headline(spark, d):
    return explore.headline(load(spark, d, "lineitem")).select("n_rows", "n_cols", "n_numeric")


SQL["bar_means"] = ("SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 6) AS mean_value "
                    "FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2")


@query("bar_means")
def q_bar_means(spark, d):
    b = explore.bar_means(load(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", "l_linestatus")
    return b.select("l_returnflag", "l_linestatus", r6("mean_value").alias("mean_value"))


SQL["histogram_30"] = (
    "WITH mm AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), "
    "w AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 30 ELSE 1.0 END AS width FROM mm), "
    "b AS (SELECT CAST(least(floor((l_extendedprice - lo) / width) + 1, 30) AS INTEGER) AS bin, lo, width "
    "FROM lineitem, w WHERE l_extendedprice IS NOT NULL) "
    "SELECT bin, round(lo + (bin - 1) * width, 6) AS lo, round(lo + bin * width, 6) AS hi, count(*) AS n "
    "FROM b GROUP BY bin, lo, width")


@query("histogram_30")
def q_histogram_30(spark, d):
    h = explore.histogram(load(spark, d, "lineitem"), "l_extendedprice", 30)
    return h.select("bin", r6("lo").alias("lo"), r6("hi").alias("hi"), F.col("count").alias("n"))


_BOX_BASE = "SELECT CAST(event_type AS VARCHAR) AS category, value AS v FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL"
_BOX_STATS_SQL = (
    "WITH b AS (" + _BOX_BASE + "), q AS (SELECT category, count(*) AS n, quantile_cont(v, 0.25) AS q1, "
    "median(v) AS median, quantile_cont(v, 0.75) AS q3 FROM b GROUP BY 1), "
    "f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)")
SQL["box_stats"] = (
    _BOX_STATS_SQL + " SELECT f.category, f.n, round(q1, 6) AS q1, round(median, 6) AS median, "
    "round(q3, 6) AS q3, round(lower_fence, 6) AS lower_fence, round(upper_fence, 6) AS upper_fence, "
    "round(min(CASE WHEN v BETWEEN lower_fence AND upper_fence THEN v END), 6) AS whisker_low, "
    "round(max(CASE WHEN v BETWEEN lower_fence AND upper_fence THEN v END), 6) AS whisker_high, "
    "count(*) FILTER (WHERE NOT v BETWEEN lower_fence AND upper_fence) AS n_outliers "
    "FROM f JOIN b USING (category) GROUP BY f.category, f.n, q1, median, q3, lower_fence, upper_fence")


@query("box_stats")
def q_box_stats(spark, d):
    b = explore.box_stats(load(spark, d, "events"), "value", "event_type")
    return b.select("category", "n", *[r6(c).alias(c) for c in
                                       ["q1", "median", "q3", "lower_fence", "upper_fence",
                                        "whisker_low", "whisker_high"]], "n_outliers")


SQL["box_outliers"] = (_BOX_STATS_SQL + " SELECT category, round(v, 6) AS value FROM b JOIN f USING (category) "
                       "WHERE NOT v BETWEEN lower_fence AND upper_fence")


@query("box_outliers")
def q_box_outliers(spark, d):
    o = explore.box_outliers(load(spark, d, "events"), "value", "event_type")
    return o.select("category", r6("value").alias("value"))


SQL["pie_top10_other"] = (
    "WITH s AS (SELECT CAST(l_suppkey AS VARCHAR) AS name, coalesce(sum(l_quantity), 0) AS total "
    "FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1), "
    "r AS (SELECT *, row_number() OVER (ORDER BY total DESC, name ASC) AS rk FROM s) "
    "SELECT name, round(total, 4) AS total, CAST(rk AS INTEGER) AS slice_rank FROM r WHERE rk <= 10 "
    "UNION ALL SELECT 'Other', round(sum(total), 4), 11 FROM r WHERE rk > 10 HAVING count(*) > 0")


@query("pie_top10_other")
def q_pie_top10_other(spark, d):
    p = explore.pie_shares(load(spark, d, "lineitem"), "l_suppkey", "l_quantity", 10)
    return p.select("name", F.round("total", 4).alias("total"), "slice_rank")


SQL["line_sorted"] = ("SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_totalprice "
                      "FROM orders ORDER BY o_orderdate")


@query("line_sorted")
def q_line_sorted(spark, d):
    ln = explore.line_sorted(load(spark, d, "orders"), "o_orderdate", "o_totalprice")
    return ln.select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), "o_totalprice")


SQL["scatter"] = "SELECT l_quantity, l_extendedprice, l_returnflag, l_hover FROM (" \
    "SELECT l_quantity, l_extendedprice, l_returnflag, l_orderkey AS l_hover FROM lineitem)"


@query("scatter")
def q_scatter(spark, d):
    """E5: every row, with a colour and a hover column."""
    li = load(spark, d, "lineitem").withColumn("l_hover", F.col("l_orderkey"))
    return explore.scatter(li, "l_quantity", "l_extendedprice", "l_returnflag", ["l_hover"])


SQL["scatter_matrix"] = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem"


@query("scatter_matrix")
def q_scatter_matrix(spark, d):
    return explore.scatter_matrix(load(spark, d, "lineitem"))


SQL["scatter_bins"] = (
    "WITH r AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, "
    "max(l_extendedprice) AS y1 FROM lineitem) "
    "SELECT CAST(least(floor((l_quantity - x0) / ((x1 - x0) / 20)) + 1, 20) AS INTEGER) AS bin_x, "
    "CAST(least(floor((l_extendedprice - y0) / ((y1 - y0) / 20)) + 1, 20) AS INTEGER) AS bin_y, "
    "count(*) AS count FROM lineitem, r GROUP BY 1, 2")


@query("scatter_bins")
def q_scatter_bins(spark, d):
    return explore.scatter_bins(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice", bins=20)


SQL["box_stats_color"] = (
    "WITH b AS (SELECT l_returnflag AS category, l_linestatus AS color, CAST(l_quantity AS DOUBLE) AS v FROM lineitem), "
    "q AS (SELECT category, color, count(*) AS n, quantile_cont(v, 0.25) AS q1, median(v) AS median, "
    "quantile_cont(v, 0.75) AS q3 FROM b GROUP BY 1, 2) "
    "SELECT category, color, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3 FROM q")


@query("box_stats_color")
def q_box_stats_color(spark, d):
    b = explore.box_stats(load(spark, d, "lineitem"), "l_quantity", "l_returnflag", color="l_linestatus")
    return b.select("category", "color", "n", r6("q1").alias("q1"), r6("median").alias("median"), r6("q3").alias("q3"))


# ---- whole tables with hot rows, nulls, quotes and other date formats ---------------

_HOT_SQL = ("SELECT ts, event_id, CAST(user_id AS DOUBLE) AS user_id, value FROM events "
            "UNION ALL SELECT TIMESTAMP '1999-01-01 00:00:00', -1, 5.0, 2.5 FROM events WHERE event_id % 2 = 0")
SQL["lag_correlations_hot"] = ("WITH src AS (" + _HOT_SQL + "), lg AS (" + _lag_table_sql(
    "src", "ts, event_id", ["user_id", "value"]) + ") SELECT cause, effect, lag_rows, n, round(r, 6) AS r FROM lg")


@query("lag_correlations_hot")
def q_lag_correlations_hot(spark, d):
    """M11 where a third of all rows are equal in every column."""
    ev = load(spark, d, "events").select("ts", "event_id", F.col("user_id").cast("double").alias("user_id"), "value")
    same = load(spark, d, "events").filter("event_id % 2 = 0").select(
        F.lit("1999-01-01 00:00:00").cast("timestamp").alias("ts"), F.lit(-1).cast("bigint").alias("event_id"),
        F.lit(5.0).alias("user_id"), F.lit(2.5).alias("value"))
    t = lags.lag_correlations(ev.unionByName(same), "ts", ["user_id", "value"], tiebreak=["event_id"])
    return t.select("cause", "effect", "lag_rows", "n", r6("r").alias("r"))


_DAY_NUM = ["day_total", "day_orders", "week_mean"]
_DAY_SQL = ("SELECT o_orderdate AS day, sum(o_totalprice) AS day_total, CAST(count(*) AS DOUBLE) AS day_orders, "
            "avg(sum(o_totalprice)) OVER (ORDER BY o_orderdate ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS week_mean "
            "FROM orders GROUP BY o_orderdate")
SQL["lead_indicators_daily"] = _lead_sql("SELECT * FROM (" + _lag_table_sql("(" + _DAY_SQL + ")", "day", _DAY_NUM) + ")")


@query("lead_indicators_daily")
def q_lead_indicators_daily(spark, d):
    """M11 on one row per order day, with the mean of the last seven."""
    from pyspark.sql import Window
    days = load(spark, d, "orders").groupBy(F.col("o_orderdate").alias("day")).agg(
        F.sum("o_totalprice").alias("day_total"), F.count(F.lit(1)).cast("double").alias("day_orders"))
    # one row per day, however many orders there are
    days = days.withColumn("week_mean", F.avg("day_total").over(Window.orderBy("day").rowsBetween(-6, 0)))
    f = lags.lead_indicators(lags.lag_correlations(days, "day", _DAY_NUM))
    return f.select("cause", "effect", "lag_rows", r6("r_value").alias("r_value"))


def _pair_ranks_sql(src, cols):
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(
                f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(x, y), 6) AS spearman FROM (SELECT "
                f"rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS x, "
                f"rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS y "
                f"FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")
    return _union(parts)


SQL["spearman_doc_labels"] = "WITH dl AS (" + DOC_LABELS_SQL + ")\n" + _pair_ranks_sql("dl", _DL_NUM)


@query("spearman_doc_labels")
def q_spearman_doc_labels(spark, d):
    """M2 with nulls: each pair over the rows where both columns have a value."""
    s = correlations.spearman_long(doc_labels(spark, d), _DL_NUM)
    return s.select("col_a", "col_b", r6("spearman").alias("spearman"))


SQL["csv_documents"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"


@query("csv_documents")
def q_csv_documents(spark, d):
    """Whole texts with quotes and line breaks through a CSV file."""
    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    write_csv(load(spark, d, "documents"), path)
    return read_table(spark, path, fmt="csv")


_DATE_FORMS = {"us": ("M/d/yyyy", "%-m/%-d/%Y"), "day_first": ("d.M.yyyy", "%-d.%-m.%Y"),
               "named": ("MMM d, yyyy", "%b %-d, %Y"), "compact": ("yyyyMMdd", "%Y%m%d")}
SQL["infer_date_formats"] = ("SELECT o_orderkey, " + ", ".join(
    f"strftime(o_orderdate, '%Y-%m-%d') AS {c}" for c in _DATE_FORMS) + " FROM orders")


@query("infer_date_formats")
def q_infer_date_formats(spark, d):
    """P4 on dates written in several ways."""
    o = load(spark, d, "orders").select("o_orderkey", *[
        F.date_format("o_orderdate", f).alias(c) for c, (f, _) in _DATE_FORMS.items()])
    out, _ = prepare.infer_timestamps(o, list(_DATE_FORMS))
    return out.select("o_orderkey", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in _DATE_FORMS])


_WIDE_COLS = ["l_returnflag", "l_linestatus", "l_suppkey"]
_WIDE_SQL = "SELECT l_returnflag, l_linestatus, CAST(l_suppkey AS VARCHAR) AS l_suppkey FROM lineitem"
SQL["rules_wide_column"] = (
    _rules_sql(_WIDE_SQL, _WIDE_COLS) +
    "SELECT antecedent, consequent, freq, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM r "
    "WHERE lift >= 1.0 AND confidence >= 0.4")


@query("rules_wide_column")
def q_rules_wide_column(spark, d):
    """M7/M8 beside a column with as many values as there are suppliers."""
    t = load(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_suppkey").cast("string").alias("l_suppkey"))
    n = t.count()
    r = rules.association_rules(rules.frequent_itemsets(t, _WIDE_COLS, n_rows=n), n)
    return r.select(F.array_join("antecedent", ", ").alias("antecedent"), F.array_join("consequent", ", ").alias("consequent"),
                    "freq", r6("confidence").alias("confidence"), r6("lift").alias("lift"))


_SEL_SQL = ("SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'B' END AS pass, CAST(l_suppkey AS INTEGER) AS target_pos, "
            "CAST(min(l_partkey) AS INTEGER) AS change_rank, 'c' || (l_suppkey % 7) AS change_col, "
            "'c' || (l_linenumber % 5 + 2) AS target_col, avg(l_discount) * 12 AS delta_pct FROM lineitem "
            "GROUP BY l_linenumber, l_suppkey HAVING l_suppkey % 7 <> l_linenumber % 5 + 2")
SQL["whatif_selection"] = (
    f"WITH d AS ({_SEL_SQL}), able AS (SELECT * FROM d WHERE pass = 'B' OR abs(delta_pct) > 0.5), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY least(change_col, target_col), greatest(change_col, target_col) "
    "ORDER BY pass, target_pos, change_rank) AS k FROM able) "
    "SELECT pass, target_pos, change_rank, change_col, target_col FROM k WHERE k = 1 "
    "ORDER BY pass, target_pos, change_rank LIMIT 12")


@query("whatif_selection")
def q_whatif_selection(spark, d):
    """W7 selection over a table of effects taken from the line items."""
    li = load(spark, d, "lineitem")
    t = li.groupBy("l_linenumber", "l_suppkey").agg(
        F.min("l_partkey").cast("int").alias("change_rank"), (F.avg("l_discount") * 12).alias("delta_pct"))
    t = t.select(F.when(F.col("l_linenumber") % 2 == 0, "A").otherwise("B").alias("pass"),
                 F.col("l_suppkey").cast("int").alias("target_pos"), "change_rank",
                 F.concat(F.lit("c"), F.col("l_suppkey") % 7).alias("change_col"),
                 F.concat(F.lit("c"), F.col("l_linenumber") % 5 + 2).alias("target_col"), "delta_pct")
    t = t.filter("change_col <> target_col")
    return whatif.select_scenarios(t, limit=12).select("pass", "target_pos", "change_rank", "change_col", "target_col")


_delta_sql = "CASE WHEN base <> 0 THEN (changed - base) / base * 100 ELSE 0.0 END"
_sign_sql = lambda x: f"CASE WHEN {x} >= 0 THEN '+' ELSE '' END || {_fixed_sql(x, 1)}"
SQL["whatif_texts"] = (
    "WITH m AS (SELECT n_name, avg(l_extendedprice) AS base, avg(l_extendedprice * (1 - l_discount + 0.04)) AS changed "
    "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name), "
    f"d AS (SELECT *, {_delta_sql} AS delta FROM m) "
    "SELECT n_name, round(delta, 6) AS delta_pct, CASE WHEN delta > 2.0 THEN 'boost' WHEN delta < -2.0 THEN 'risk' "
    "ELSE 'inelastic' END AS recommendation, "
    f"'Changing **' || {_label_sql("'l_discount'")} || '** by **+4.0%** moves the average predicted **' || "
    f"{_label_sql("'l_extendedprice'")} || '** by **' || {_sign_sql('delta')} || '%** (' || {_fixed_sql('base', 2)} || ' -> ' || "
    f"{_fixed_sql('changed', 2)} || ').' AS narrative, "
    f"CASE WHEN delta > 2.0 THEN '**' || {_label_sql("'l_discount'")} || '** is a strong lever for **' || "
    f"{_label_sql("'l_extendedprice'")} || '**; raising it looks worthwhile.' WHEN delta < -2.0 THEN 'Raising **' || "
    f"{_label_sql("'l_discount'")} || '** is predicted to lower **' || {_label_sql("'l_extendedprice'")} || '** by ' || "
    f"{_fixed_sql('abs(delta)', 1)} || '%; proceed with care.' ELSE '**' || {_label_sql("'l_extendedprice'")} || "
    f"'** barely reacts to **' || {_label_sql("'l_discount'")} || '** (' || {_fixed_sql('delta', 2)} || "
    f"'%); look at stronger drivers.' END AS advice FROM d")


@query("whatif_texts")
def q_whatif_texts(spark, d):
    """Branch and texts of effects on the mean price by supplier nation."""
    li, su, na = (load(spark, d, t) for t in ("lineitem", "supplier", "nation"))
    t = (li.join(su, li["l_suppkey"] == su["s_suppkey"]).join(na, su["s_nationkey"] == na["n_nationkey"]).groupBy("n_name").agg(
        F.avg("l_extendedprice").alias("predicted_original_mean"),
        F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount") + 0.04)).alias("predicted_modified_mean")))
    t = t.select("n_name", F.lit("l_discount").alias("change_col"), F.lit("l_extendedprice").alias("target_col"),
                 F.lit(4.0).alias("pct_change_input"), "predicted_original_mean", "predicted_modified_mean",
                 whatif.delta_pct(F.col("predicted_original_mean"), F.col("predicted_modified_mean")).alias("delta_pct"))
    t = whatif.with_texts(t.withColumn("recommendation", whatif.branch(F.col("delta_pct"))))
    return t.select("n_name", r6("delta_pct").alias("delta_pct"), "recommendation", "narrative", "advice")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in Q}
