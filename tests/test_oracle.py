"""Every registered query against its DuckDB oracle on sf0.001, and a rows
check for the queries without one."""

import math

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from sparkscout.plans import catalog

QUERIES = catalog.queries()
ORACLE = catalog.oracle_sql()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except (ValueError, AttributeError):
            pass
    if hasattr(v, "tolist"):
        return tuple(_norm(x) for x in v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _canon(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")]
    return cols, sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = duck.execute(ORACLE[name]).df()
    c1, r1 = _canon(got)
    c2, r2 = _canon(want)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


#: queries without an oracle (learned models, free text) and what must hold
INVARIANTS = {
    "kmeans_segments": lambda p: p.segment.nunique() == p.k.iloc[0] and p["rank"].max() <= 3
    and abs(p.drop_duplicates("segment").size_pct.sum() - 100) < 1e-6 and p.silhouette.between(-1, 1).all(),
    "kmeans_scaled": lambda p: p.segment.nunique() == p.k.iloc[0] and p.silhouette.between(-1, 1).all(),
    "discover_events": lambda p: p.seq.is_unique and p.final_score.between(0, 100).all(),
    "discover_line_orders": lambda p: p.seq.is_unique and {"association", "cluster"} <= set(p.type),
    "top_drivers": lambda p: list(p["rank"]) == list(range(1, len(p) + 1)) and p.importance.is_monotonic_decreasing
    and abs(p.importance.sum() - 100) < 1e-6,
    "whatif_single": lambda p: len(p) == 1 and p.recommendation.isin(["boost", "risk", "inelastic"]).all(),
    "whatif_scenarios": lambda p: len(p) <= 3 and p["pass"].is_monotonic_increasing and (p.drivers.str.len() > 0).all(),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_oracle(spark, name):
    assert INVARIANTS[name](QUERIES[name](spark, SF_SMALL).toPandas())


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:3] == ["display_rank", "type", "col_a"]
    ranks = [r["display_rank"] for r in rows]
    assert sorted(ranks) == list(range(1, len(rows) + 1))
