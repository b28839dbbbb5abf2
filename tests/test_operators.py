"""Planted patterns, brute-force references and edge cases on small
fixtures built inside the tests."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkscout.functions.labels import markup_to_html, readable_label
from sparkscout.operators import (categorical, correlations, lags, numeric, prepare, rules,
                                  segments, whatif)
from sparkscout.operators.quantiles import column_quantiles, exact_quantiles


def sales_fixture(n=517, seed=42):
    """Daily table with planted relations: temperature lowers sales, rain
    raises sales two rows later, traffic follows sales, VIP adds sales."""
    rng = np.random.default_rng(seed)
    day = np.arange(n)
    temp = 15 + 10 * np.sin(day / 365 * 2 * np.pi) + rng.normal(0, 3, n)
    rain = np.where(rng.random(n) < 0.2, rng.exponential(5, n), 0.0)
    seg = rng.choice(["New", "Returning", "VIP"], n)
    sales = 500 - 5 * temp + rng.normal(0, 20, n) + np.where(seg == "VIP", 200, 0)
    sales[2:] += 30 * rain[:-2]
    traffic = 3 * sales + rng.normal(0, 50, n)
    return pd.DataFrame({
        "date": pd.date_range("2023-01-01", periods=n, freq="D"),
        "temperature_c": temp, "rainfall_mm": rain, "sales_units": sales,
        "foot_traffic": traffic, "customer_segment": seg,
    })


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(sales_fixture())


# ---- quantiles -------------------------------------------------------------

@pytest.mark.parametrize("most,splits", [(1 << 20, 1000), (40, 8), (300, 16)])
def test_exact_quantiles_with_hot_value_heavy_tail_and_infinities(spark, most, splits):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(0, 1, 2000), np.full(1000, 0.25), rng.exponential(3, 500) ** 9])
    wild = np.concatenate([v, np.full(200, -np.inf), np.full(200, np.inf)])
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("b", float(x)) for x in wild], "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", probs, max_bracket_rows=most, splits=splits).collect()}
    for p in probs:
        name = f"q{p:g}".replace(".", "_")
        assert got["a"][name] == pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-12)
        want = np.sort(wild)[round((len(wild) - 1) * p)] if p in (0.0, 1.0) else np.quantile(wild, p)
        assert got["b"][name] == pytest.approx(want, rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 11])
def test_exact_quantiles_of_few_rows(spark, n):
    v = list(range(n))
    got = exact_quantiles(spark.createDataFrame([("a", float(x)) for x in v], "g string, v double"), ["g"], "v",
                          [0.25, 0.5, 0.75]).first()
    assert [got["q0_25"], got["q0_5"], got["q0_75"]] == pytest.approx(list(np.quantile(v, [0.25, 0.5, 0.75])))


def test_column_quantiles_ignore_nulls(spark):
    pdf = pd.DataFrame({"a": [1.0, None, 3.0, 4.0, None, 10.0], "b": [5, 5, 5, 5, 5, 5]})
    got = {r["column"]: r for r in column_quantiles(spark.createDataFrame(pdf), ["a", "b"],
                                                      [0.5], ["m"]).collect()}
    assert got["a"]["m"] == pytest.approx(3.5)
    assert got["a"]["n"] == 4
    assert got["b"]["m"] == 5.0


# ---- preparation -------------------------------------------------------------

def test_drop_sparse_keeps_exactly_half(spark):
    pdf = pd.DataFrame({"half": [1.0, None, 2.0, None], "most": [None, None, None, 1.0],
                        "full": [1, 2, 3, 4]})
    out, dropped = prepare.drop_sparse(spark.createDataFrame(pdf))
    assert dropped == ["most"]
    assert out.columns == ["half", "full"]


def test_mode_ties_take_smallest_and_fill_blanks(spark):
    pdf = pd.DataFrame({"s": [" b", "a ", "b", "a", "", None, "c"]})
    out, modes = prepare.clean_strings(spark.createDataFrame(pdf))
    assert modes == {"s": "a"}
    assert [r["s"] for r in out.collect()] == ["b", "a", "b", "a", "a", "a", "c"]


def test_literal_null_policy(spark):
    pdf = pd.DataFrame({"s": ["x", None, None, "", "y"]})
    out, _ = prepare.clean_strings(spark.createDataFrame(pdf), null_policy="literal")
    assert [r["s"] for r in out.collect()] == ["x", "nan", "nan", "nan", "y"]


def test_label_encode_alphabetical_with_null(spark):
    pdf = pd.DataFrame({"c": ["b", "a", None, "c", "a"], "hi": [str(i) for i in range(5)]})
    out, enc = prepare.label_encode(spark.createDataFrame(pdf), max_distinct=5)
    assert enc == {"c": ["a", "b", "c"]}
    assert "hi" not in out.columns
    assert [r["c"] for r in out.collect()] == [1, 0, -1, 2, 0]
    assert dict(out.dtypes)["c"] == "tinyint"


def test_infer_timestamps_needs_majority_and_separator(spark):
    pdf = pd.DataFrame({"d": ["2024-01-05", "2024-02-01", "junk", "2024-03-09"],
                        "y": ["1999", "2001", "2003", "2005"],
                        "few": ["2024-01-05", "x", "y", "z"]})
    out, chosen = prepare.infer_timestamps(spark.createDataFrame(pdf))
    assert chosen == {"d": "iso8601"}
    assert dict(out.dtypes)["d"] == "timestamp"
    assert out.filter(F.col("d").isNull()).count() == 1


def test_median_impute_keeps_half_values(spark):
    pdf = pd.DataFrame({"k": [1, 2, None, 3, 4]}, dtype="Int64")
    out, med = prepare.median_impute(spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None)))
    assert med == {"k": 2.5}
    assert [r["k"] for r in out.collect()] == [1.0, 2.0, 2.5, 3.0, 4.0]


def test_prepare_views(spark, sales):
    p = prepare.prepare(sales)
    assert p.time_col == "date"
    assert dict(p.encoded.dtypes)["customer_segment"] == "tinyint"
    assert "customer_segment" in p.categories
    prof = {r["column"]: r["role"] for r in p.profile().collect()}
    assert prof["customer_segment"] == "code" and prof["date"] == "time"


# ---- statistics ---------------------------------------------------------------

def test_constant_and_null_columns_do_not_fail(spark):
    pdf = pd.DataFrame({"c": [1.0] * 12, "x": np.arange(12.0), "z": [None] * 12})
    df = spark.createDataFrame(pdf, "c double, x double, z double")
    pairs = {(r["col_a"], r["col_b"]): r["r"] for r in correlations.pearson_long(df).collect()}
    assert pairs[("c", "x")] is None
    shape = {r["column"]: r for r in numeric.shape_stats(df).collect()}
    assert shape["c"]["skew"] == 0.0
    assert numeric.sigma_outliers(df).count() == 0


def test_sigma_outlier_extreme_is_largest_absolute(spark):
    v = [0.0] * 40 + [1.0] * 40 + [-30.0, 25.0]
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    r = numeric.sigma_outliers(df).first()
    assert r["outlier_count"] == 2
    assert r["extreme_value"] == -30.0


def test_skew_matches_pandas(spark, sales):
    shape = {r["column"]: r for r in numeric.shape_stats(sales).collect()}
    pdf = sales_fixture()
    assert shape["rainfall_mm"]["skew"] == pytest.approx(pdf["rainfall_mm"].skew(), rel=1e-9)
    assert shape["sales_units"]["median"] == pytest.approx(pdf["sales_units"].median(), rel=1e-12)


def test_planted_correlations(spark, sales):
    f = {(r["col_a"], r["col_b"]): r for r in correlations.pearson_findings(sales).collect()}
    assert f[("temperature_c", "sales_units")]["direction"] == "negative"
    assert f[("sales_units", "foot_traffic")]["strength"] == "strong"


def test_spearman_matches_pandas(spark, sales):
    s = {(r["col_a"], r["col_b"]): r["spearman"] for r in
         correlations.spearman_long(sales, ["temperature_c", "rainfall_mm", "sales_units"]).collect()}
    want = sales_fixture()[["temperature_c", "rainfall_mm", "sales_units"]].corr("spearman")
    assert s[("temperature_c", "rainfall_mm")] == pytest.approx(want.iloc[0, 1], abs=1e-9)
    assert s[("rainfall_mm", "sales_units")] == pytest.approx(want.iloc[1, 2], abs=1e-9)


def test_dominant_categories_binary_and_skip(spark):
    pdf = pd.DataFrame({"bin": ["y"] * 8 + ["n"] * 2, "ids": [str(i) for i in range(10)],
                        "flat": list("abcdefghij")})
    got = {r["column"]: r for r in categorical.dominant_categories(spark.createDataFrame(pdf)).collect()}
    assert set(got) == {"bin"}
    assert got["bin"]["is_binary"] and got["bin"]["top_pct"] == 80.0


# ---- lags ----------------------------------------------------------------------

def test_planted_lag_found(spark, sales):
    t = lags.lag_correlations(sales, "date", ["rainfall_mm", "sales_units", "temperature_c"])
    best = {(r["cause"], r["effect"]): r for r in lags.lead_indicators(t).collect()}
    assert best[("rainfall_mm", "sales_units")]["lag_rows"] == 2


@pytest.mark.parametrize("bucket", [1, 7, 60, 1 << 16])
def test_lags_equal_shift_for_any_bucket_and_hot_rows(spark, bucket):
    rng = np.random.default_rng(3)
    n = 700
    pdf = pd.DataFrame({"t": rng.integers(0, 50, n), "k": rng.permutation(n),
                        "a": rng.normal(size=n), "b": rng.normal(size=n)})
    pdf.loc[rng.choice(n, 60, replace=False), "b"] = np.nan
    same = pd.DataFrame({"t": [25] * 350, "k": [-1] * 350, "a": [0.5] * 350, "b": [2.0] * 350})
    pdf = pd.concat([pdf, same], ignore_index=True)
    df = spark.createDataFrame(pdf).repartition(5)
    ref = pdf.sort_values(["t", "k"]).reset_index(drop=True)
    got = {(r["cause"], r["effect"], r["lag_rows"]): r for r in lags.lag_correlations(
        df.withColumn("b", F.nanvl("b", F.lit(None).cast("double"))), "t", ["a", "b", "k"], tiebreak=["k"],
        bucket_rows=bucket).collect()}
    assert len(got) == 6 * 5
    for (x, y, k), r in got.items():
        shifted = ref[x].shift(k)
        assert r["n"] == (shifted.notna() & ref[y].notna()).sum()
        assert r["r"] == pytest.approx(shifted.corr(ref[y]), abs=1e-10)


# ---- pairs ----------------------------------------------------------------------

def test_correlations_with_nulls_match_pandas(spark):
    rng = np.random.default_rng(9)
    x = pd.DataFrame(rng.integers(0, 9, (400, 3)).astype(float), columns=["a.x", "b", "c"])
    x["b"] += x["a.x"]
    for c in x:
        x.loc[rng.choice(400, 90, replace=False), c] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x.to_numpy()],
                               "`a.x` double, b double, c double")
    want_p, want_s = x.corr(), x.corr("spearman")
    for r in correlations.pearson_long(df).collect():
        assert r["r"] == pytest.approx(want_p.loc[r["col_a"], r["col_b"]], abs=1e-12)
    for r in correlations.spearman_long(df).collect():
        assert r["spearman"] == pytest.approx(want_s.loc[r["col_a"], r["col_b"]], abs=1e-12)
    assert {r["column"] for r in numeric.column_moments(df).collect()} == {"a.x", "b", "c"}


def test_nan_in_a_raw_frame_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (5.0,)], "v double")
    assert [r["v"] for r in prepare.prepare(df).clean.collect()] == [1.0, 3.0, 3.0, 5.0]


# ---- association rules -----------------------------------------------------------

def _brute_rules(pdf, min_support=0.05, min_conf=0.4, min_lift=1.0):
    n = len(pdf)
    tx = [frozenset(f"{c}={v}" for c, v in row.items() if v is not None) for row in pdf.to_dict("records")]
    items = sorted(set().union(*tx))
    sup = {}
    for size in range(1, len(pdf.columns) + 1):
        for combo in itertools.combinations(items, size):
            s = sum(1 for t in tx if set(combo) <= t)
            if s / n >= min_support:
                sup[frozenset(combo)] = s
    out = {}
    for s, f in sup.items():
        if len(s) < 2:
            continue
        for r in range(1, len(s)):
            for a in itertools.combinations(sorted(s), r):
                a = frozenset(a)
                c = s - a
                conf = f / sup[a]
                lift = conf / (sup[c] / n)
                if lift >= min_lift and conf >= min_conf:
                    out[(", ".join(sorted(a)), ", ".join(sorted(c)))] = (f / n, conf, lift)
    return out


def test_rules_match_brute_force(spark):
    rng = np.random.default_rng(7)
    n = 400
    a = rng.choice(["x", "y"], n, p=[0.7, 0.3])
    b = np.where(a == "x", rng.choice(["p", "q"], n, p=[0.8, 0.2]), rng.choice(["p", "q"], n))
    c = np.where(b == "p", "u", rng.choice(["u", "v", "w"], n))
    pdf = pd.DataFrame({"a": a, "b": b, "c": c})
    df = spark.createDataFrame(pdf)
    fi = rules.frequent_itemsets(df, ["a", "b", "c"], n_rows=n)
    got = {(", ".join(r["antecedent"]), ", ".join(r["consequent"])): (r["support"], r["confidence"], r["lift"])
           for r in rules.association_rules(fi, n).collect()}
    want = _brute_rules(pdf)
    assert set(got) == set(want)
    assert any(len(k[1].split(", ")) > 1 for k in got)  # multi-item consequents exist
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12)
    top = rules.dedup_rules(rules.association_rules(fi, n)).collect()
    assert len(top) <= 5
    keys = set()
    for r in top:
        pair = frozenset([tuple(sorted({x.split("=")[0] for x in r["antecedent"]})),
                          tuple(sorted({x.split("=")[0] for x in r["consequent"]}))])
        assert pair not in keys
        keys.add(pair)
    lifts = [r["lift"] for r in top]
    assert lifts == sorted(lifts, reverse=True)


# ---- segments ------------------------------------------------------------------------

def test_segment_profile_sizes_and_ranking(spark, sales):
    p = segments.segment_profile(sales, "customer_segment",
                                 ["temperature_c", "rainfall_mm", "sales_units", "foot_traffic"])
    rows = p.collect()
    sizes = {r["segment"]: r["size_pct"] for r in rows}
    assert sum(sizes.values()) == pytest.approx(100.0)
    vip = sorted([r for r in rows if r["segment"] == "VIP"], key=lambda r: r["rank"])
    assert len(vip) == 3 and vip[0]["diff"] >= vip[1]["diff"] >= vip[2]["diff"]


def test_kmeans_segments_invariants(spark, sales):
    p = segments.kmeans_profile(sales, ["sales_units", "foot_traffic"], ks=range(2, 4))
    rows = p.collect()
    k = rows[0]["k"]
    assert 2 <= k <= 3
    sizes = {r["segment"]: r["size_pct"] for r in rows}
    assert len(sizes) == k and sum(sizes.values()) == pytest.approx(100.0)
    assert -1.0 <= rows[0]["silhouette"] <= 1.0


# ---- what-if -------------------------------------------------------------------------

def test_whatif_planted_effect_sign(spark):
    rng = np.random.default_rng(5)
    n = 600
    ad = rng.uniform(100, 1000, n)
    temp = rng.normal(20, 5, n)
    sales = 200 + 0.5 * ad - 4 * temp + rng.normal(0, 10, n)
    df = spark.createDataFrame(pd.DataFrame({"ad_spend_usd": ad, "temperature_c": temp,
                                             "sales_units": sales}))
    r = whatif.whatif(df, "sales_units", "ad_spend_usd", 20.0, num_trees=20, max_depth=6).first()
    assert r["delta_pct"] > 2.0 and r["recommendation"] == "boost"
    assert r["drivers"][0]["raw_col"] == "ad_spend_usd"
    with pytest.raises(ValueError):
        whatif.whatif(df, "sales_units", "sales_units", 10.0)
    auto = whatif.auto_whatif(df, num_trees=10, max_depth=5).collect()
    assert 1 <= len(auto) <= 3
    assert len({frozenset((r["target_col"], r["change_col"])) for r in auto}) == len(auto)


def test_whatif_candidates_name_rules(spark):
    pdf = pd.DataFrame({"customer_id": range(20), "humidity": np.arange(20) % 7,
                        "revenue": np.arange(20) * 1.5, "price": np.arange(20) % 9,
                        "load": np.arange(20) % 5, "flag": [0, 1] * 10})
    c = {r["column"]: r for r in whatif.whatif_candidates(spark.createDataFrame(pdf)).collect()}
    assert not c["customer_id"]["valid"] and not c["humidity"]["valid"]  # 'id' substring
    assert not c["flag"]["valid"]  # two distinct values
    assert c["revenue"]["is_target"] and c["price"]["is_target"]
    assert c["load"]["valid"] and not c["load"]["is_target"]
    # fewer than two valid columns -> fallback to everything with > 1 value
    few = pd.DataFrame({"customer_id": range(20), "revenue": np.arange(20) * 1.5, "flag": [0, 1] * 10})
    c2 = {r["column"]: r for r in whatif.whatif_candidates(spark.createDataFrame(few)).collect()}
    assert all(r["valid"] for r in c2.values())


# ---- labels --------------------------------------------------------------------------

@pytest.mark.parametrize("raw,want", [
    ("temperature_c", "Temperature (°C)"), ("rainfall_mm", "Rainfall (mm)"),
    ("sales_units", "Sales Units"), ("ad_spend_usd", "Ad Spend (USD)"),
    ("customer_id", "Customer ID"), ("x-ray_level", "X-Ray Level"),
    ("co2_percentage", "CO2 (%)"), ("  vip__tier ", "VIP Tier"),
])
def test_readable_label(spark, raw, want):
    assert spark.range(1).select(readable_label(F.lit(raw))).first()[0] == want


def test_markup_to_html(spark):
    s = "a **bold** and *it* plus **x**"
    got = spark.range(1).select(markup_to_html(F.lit(s))).first()[0]
    assert got == "a <strong>bold</strong> and <em>it</em> plus <strong>x</strong>"


# ---- HLL prefilter ------------------------------------------------------------------

def test_near_unique_columns_skipped_and_wide_text_gaps_filled(spark):
    n = 400
    pdf = pd.DataFrame({"uid": [f"u{i}" for i in range(n)],
                        "flag": ["a"] * 300 + ["b"] * 100,
                        "note": [None if i % 50 == 0 else f"t{i % 60}" for i in range(n)]})
    df = spark.createDataFrame(pdf)
    dom = {r["column"] for r in categorical.dominant_categories(df).collect()}
    assert "uid" not in dom and "flag" in dom
    cand = {r["column"] for r in categorical.rule_candidates(df).collect()}
    assert cand == {"flag", "note"}
    p = prepare.prepare(df)
    assert set(p.encoded.columns) == {"flag"}          # uid and note are too wide to encode
    mode = pdf["note"].dropna().value_counts()
    top = sorted(mode[mode == mode.max()].index)[0]
    filled = [r["note"] for r in p.clean.collect()]
    assert filled[0] == top and None not in filled


# ---- K-means on shared scans -----------------------------------------------------------

def test_shared_scan_kmeans_finds_planted_clusters(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.4, (150, 3)) for c in ((0, 0, 0), (6, 0, 1), (0, 7, 2), (5, 6, -4))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b.c", "d"]))
    labelled, k, sil = segments.kmeans_segments(df, restarts=4)
    got = labelled.toPandas()
    assert k == 4 and sorted(got.groupby("segment").size()) == [150] * 4
    # the silhouette is the one that Spark's evaluator finds for the same labels
    plain = labelled.toDF("x", "y", "z", "segment")
    vec = VectorAssembler(inputCols=["x", "y", "z"], outputCol="features").transform(plain)
    want = ClusteringEvaluator(predictionCol="segment", distanceMeasure="squaredEuclidean").evaluate(vec)
    assert sil == pytest.approx(want, abs=1e-9)
    # rows in another order and split give the same model
    again = segments.kmeans_segments(df.orderBy("d").repartition(5), restarts=4)
    assert again[1] == 4 and again[2] == pytest.approx(sil, abs=1e-9)


def test_kmeans_of_few_distinct_rows_and_repeats(spark):
    pdf = pd.DataFrame({"a": [0.0] * 40 + [1.0] * 40 + [9.0] * 3, "b": [0.0] * 40 + [1.0] * 40 + [9.0] * 3})
    labelled, k, sil = segments.kmeans_segments(spark.createDataFrame(pdf), restarts=3)
    assert k == 3 and sil == pytest.approx(1.0)
    assert segments.kmeans_segments(spark.createDataFrame(pdf.assign(a=1.0, b=2.0)), restarts=2) is None


def test_lloyd_iterations_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 2)) * [1, 30]
    first = x[:3].tolist()
    rows = segments.kmeans_from(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"])), first, 5, scale=True).toPandas()
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    c = z[:3].copy()
    for _ in range(5):
        own = ((z[:, None] - c) ** 2).sum(2).argmin(1)
        cost = ((z - c[own]) ** 2).sum()
        c = np.array([z[own == g].mean(0) for g in range(3)])
    want = c * x.std(0, ddof=1) + x.mean(0)
    got = rows.pivot(index="segment", columns="feature", values="centre")[["a", "b"]].to_numpy()
    assert np.allclose(got, want) and rows.cost[0] == pytest.approx(cost)
    assert rows.drop_duplicates("segment").sort_values("segment").n.tolist() == np.bincount(own).tolist()


# ---- ranks once per column --------------------------------------------------------------

def test_spearman_with_gaps_against_pandas(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"a": rng.integers(0, 9, 700).astype(float), "b": rng.normal(size=700), "c": rng.normal(size=700),
                        "d": rng.integers(0, 3, 700).astype(float)})
    pdf["c"] = pdf["a"] ** 2 + 0.3 * pdf["c"]
    pdf.loc[rng.random(700) < 0.3, "b"] = None
    pdf.loc[rng.random(700) < 0.2, "c"] = None
    df = spark.createDataFrame(pdf)
    want = pdf.corr(method="spearman")
    got = correlations.spearman_long(df).collect()
    assert len(got) == 6
    for r in got:
        assert r["spearman"] == pytest.approx(want.loc[r["col_a"], r["col_b"]], abs=1e-9)
    some = correlations.spearman_long(df, wanted=[(0, 2)]).collect()
    assert [(r["col_a"], r["col_b"]) for r in some] == [("a", "c")]


# ---- values by digest -------------------------------------------------------------------

def test_modes_of_long_texts(spark):
    long = "the same beginning of many texts, "
    rows = [(long + str(k % 7), "x") for k in range(70)] + [(long + "0", " x "), ("  ", None), (None, ""), ("short", "y")]
    got = {r["column"]: r for r in prepare.string_modes(spark.createDataFrame(rows, "a string, b string"), ["a", "b"]).collect()}
    assert got["a"]["mode"] == long + "0" and got["a"]["has_gap"] and got["b"]["mode"] == "x" and got["b"]["has_gap"]
    ties = [(long + c,) for c in "zyxw"] * 2 + [("a",)]
    assert prepare.string_modes(spark.createDataFrame(ties, "a string"), ["a"]).first()["mode"] == long + "w"
    plan = prepare.encoding_plan(spark.createDataFrame([(long + c,) for c in "ba"] * 3, "a string"), ["a"]).first()
    assert plan["categories"] == [long + "a", long + "b"] and plan["n_unique"] == 2


# ---- rules, scenarios -------------------------------------------------------------------

def test_rules_of_itemsets_of_many_items(spark):
    """Consequents grow while the confidence holds, whatever the size."""
    items = [(f"c{k:02d}", "v") for k in range(70)]
    sets = [(items, 70, 50, 0.5), (items[:1], 1, 100, 1.0), (items[1:], 69, 50, 0.5)] + [([i], 1, 90, 0.9) for i in items[1:]]
    sets += [(items[:k] + items[k + 1:], 69, 200, 1.0) for k in range(1, 70)]
    schema = "parts array<struct<column:string,value:string>>, size int, freq long, support double"
    got = rules.association_rules(spark.createDataFrame(sets, schema), 100, min_lift=0.0).filter("size(antecedent) = 69").collect()
    assert [r["consequent"] for r in got] == [["c00=v"]] and got[0]["confidence"] == 1.0


def test_scenarios_change_one_column_each(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a.x": rng.normal(10, 2, 400), "b": rng.normal(5, 1, 400)})
    pdf["y"] = 3 * pdf["a.x"] - pdf["b"]
    data, cols = whatif.numeric_frame(spark.createDataFrame(pdf))
    model = whatif.fit_outcome_model(data, "y", ["a.x", "b"], num_trees=10, max_depth=6)
    got = {r["scenario"]: r["predicted_mean"] for r in
           whatif.score_scenarios(data, model, ["a.x", "b"], [("a.x", 20.0), ("b", -10.0)]).collect()}
    for n, (c, p) in {-1: ("b", 0.0), 0: ("a.x", 20.0), 1: ("b", -10.0)}.items():
        changed = data.withColumn(c, F.col(f"`{c}`") * (1 + p / 100))
        want = model.transform(whatif._vector(changed, ["a.x", "b"])).agg(F.avg("prediction")).first()[0]
        assert got[n] == pytest.approx(want)


def test_intermediate_tables_end_with_their_scope(spark):
    import os

    from sparkscout.session import scope, stored
    with scope(spark):
        path = stored(spark.range(5), "probe").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_drivers_model_does_not_read_a_table_as_one_task(spark):
    rows = spark.range(20_000, numPartitions=1)
    laid = whatif.laid_out(rows)
    assert laid.rdd.getNumPartitions() > 1 and laid.count() == 20_000
    few = spark.range(100)
    assert whatif.laid_out(few) is few


def test_steady_blocks_are_a_partition_each(spark):
    """Short files of many blocks are not read as one task."""
    from sparkscout.operators.ordering import steady
    laid = steady(spark.range(40_000, numPartitions=1), rows=1000)
    sizes = [r["count"] for r in laid.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sizes == [1000] * 40
    assert sorted(r["id"] for r in laid.collect()) == list(range(40_000))


def test_kmeans_pass_gives_a_row_to_the_first_of_equal_centres(spark):
    from sparkscout.operators import lloyd
    x = np.asarray([[0.0, 0.0], [2.0, 0.0], [1.0, 0.0], [9.0, 9.0]])
    sets = [np.asarray([[0.0, 0.0], [2.0, 0.0], [9.0, 9.0]]), np.asarray([[1.0, 1.0], [1.0, 1.0]])]
    got = lloyd.one_pass(spark.createDataFrame(x.tolist(), "a double, b double").repartition(2), np.zeros(2), np.ones(2), sets)
    for (counts, sums, squares, cost), centres in zip(got, sets):
        far = ((x[:, None] - centres) ** 2).sum(2)
        own = far.argmin(1)
        for k in range(len(centres)):
            assert counts[k] == (own == k).sum()
            assert np.allclose(sums[k], x[own == k].sum(0))
            assert np.isclose(squares[k], (x[own == k] ** 2).sum())
        assert np.isclose(cost, far.min(1).sum())


@pytest.mark.parametrize("most", [1 << 20, 64])
def test_quantiles_of_few_values_copy_no_rows(spark, monkeypatch, most):
    """Rows of equal value are counted before they meet their brackets."""
    from pyspark.sql import DataFrame
    rng = np.random.default_rng(5)
    x = rng.choice([-3.0, -0.0, 0.0, 1.0, 2.5, math.inf], 5000)
    plans, taken = [], DataFrame.groupBy
    monkeypatch.setattr(DataFrame, "groupBy", lambda df, *a: (plans.append((df, a)), taken(df, *a))[1])
    rows = spark.createDataFrame([("a", v) for v in x.tolist()] + [("b", float(v)) for v in range(999)], "k string, v double")
    probs = [0.1, 0.25, 0.5, 0.6, 0.75]
    got = {r["k"]: [r[f"p{i}"] for i in range(5)] for r in exact_quantiles(
        rows, ["k"], "v", probs, [f"p{i}" for i in range(5)], max_bracket_rows=most, splits=20).collect()}
    assert got["a"] == np.quantile(x, probs, method="linear").tolist()
    assert np.allclose(got["b"], np.quantile(np.arange(999), probs))
    assert not any("_rank" in a and "_val" in a for _, a in plans)
