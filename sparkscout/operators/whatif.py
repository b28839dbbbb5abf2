"""What-if scenario scoring.

A random-forest model of one target column is fitted on the complete
numeric rows (distributed tree growth); all scenarios ``(change column,
percent)`` are scored in *one* pass: a row gets one prediction column per
scenario, from its features with the changed one rewritten, and one aggregate
averages them.  Rows are neither copied nor shuffled.  The model depends only
on the target, so it is fitted once per target, not once per scenario.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import readable_label
from ..schema import numeric_cols
from .correlations import pearson_long
from .ordering import steady

# Name fragments (substring match, lower case) that exclude a
# column from automatic scenarios, and that mark a column as a business KPI.
EXCLUDED_NAME_PARTS = ["id", "episode", "season", "year", "month", "day", "week", "index", "zip"]
KPI_NAME_PARTS = ["amount", "val", "sales", "revenue", "profit", "equity", "price", "spend",
                  "cost", "score", "units", "traffic"]


def numeric_frame(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Numeric columns as DOUBLE, rows with a null in any of them dropped."""
    cols = numeric_cols(df)
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    for c in cols:                                                # names may hold dots
        rows = rows.filter(F.col(f"`{c}`").isNotNull() & ~F.isnan(f"`{c}`"))
    return rows, cols


def laid_out(data: DataFrame, few: int = 1 << 14) -> DataFrame:
    """``data``, in steady blocks if it has more than a ``few`` rows: a forest
    keeps 1 to 2 KB a row in the task that has it, so one split of a narrow
    table, which may hold all its rows, is too much."""
    return steady(data) if data.limit(few + 1).count() > few else data


def _vector(data: DataFrame, features: list[str]) -> DataFrame:
    """Add _features.  Names may hold dots, which the assembler can't take."""
    plain = [f"_f{k}" for k in range(len(features))]
    with_plain = data.select("*", *[F.col(f"`{c}`").alias(p) for c, p in zip(features, plain)])
    return VectorAssembler(inputCols=plain, outputCol="_features").transform(with_plain).drop(*plain)


def fit_outcome_model(data: DataFrame, target: str, features: list[str], num_trees: int = 50,
                      max_depth: int = 20, max_bins: int = 128, seed: int = 42):
    """Random forest of ``target`` on ``features`` (bootstrap, all
    features per split, in-sample)."""
    vec = _vector(data, features).withColumn("_target", F.col(f"`{target}`"))
    rf = RandomForestRegressor(featuresCol="_features", labelCol="_target", numTrees=num_trees,
                               maxDepth=max_depth, maxBins=max_bins, seed=seed,
                               featureSubsetStrategy="all", subsamplingRate=1.0, bootstrap=True,
                               maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=10)
    return rf.fit(vec)


def top_drivers(model, features: list[str], k: int = 5) -> list[dict]:
    """The ``k`` most important features, importance in percent."""
    imp = model.featureImportances.toArray()
    order = sorted(range(len(features)), key=lambda i: (-imp[i], i))[:k]
    return [{"raw_col": features[i], "importance": float(imp[i] * 100)} for i in order]


def score_scenarios(data: DataFrame, model, features: list[str],
                    scenarios: list[tuple[str, float]]) -> DataFrame:
    """W3 for many scenarios at once: ``(scenario, change_col, pct_change,
    predicted_mean)``; scenario -1 is the unchanged baseline."""
    spec = [(-1, None, 0.0)] + [(i, c, float(p)) for i, (c, p) in enumerate(scenarios)]
    plain = [f"_f{k}" for k in range(len(features))]              # names may hold dots
    rows = data.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(features, plain)])
    for n, (_, c, pct) in enumerate(spec):
        inputs = list(plain)
        if c in features:
            at = features.index(c)
            inputs[at] = f"_x{n}"
            rows = rows.withColumn(f"_x{n}", F.col(plain[at]) * (1 + pct / 100.0))
        rows = VectorAssembler(inputCols=inputs, outputCol=f"_v{n}").transform(rows)
        rows = model.transform(rows, {model.featuresCol: f"_v{n}", model.predictionCol: f"_p{n}"})
    means = rows.agg(*[F.avg(f"_p{n}").alias(f"_p{n}") for n in range(len(spec))])
    return means.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("scenario"), F.lit(c).cast("string").alias("change_col"), F.lit(p).alias("pct_change"),
                 F.col(f"_p{n}").alias("predicted_mean")) for n, (i, c, p) in enumerate(spec)])).alias("s")).select("s.*")


def delta_pct(base, changed):
    """Relative change of the mean in percent; 0 from a mean of 0."""
    return F.when(base != 0, (changed - base) / base * 100).otherwise(F.lit(0.0))


def branch(delta):
    """W4 branch: 'boost' above +2 %, 'risk' below -2 %, else 'inelastic'."""
    return F.when(delta > 2.0, F.lit("boost")).when(delta < -2.0, F.lit("risk")).otherwise(F.lit("inelastic"))


def with_texts(result: DataFrame) -> DataFrame:
    """W4 text: a one-line summary and the recommendation for its branch."""
    t, c = readable_label("target_col"), readable_label("change_col")
    d = F.col("delta_pct")
    summary = F.format_string(
        "Changing **%s** by **%+.1f%%** moves the average predicted **%s** by **%+.1f%%** "
        "(%.2f -> %.2f).", c, F.col("pct_change_input"), t, d,
        F.col("predicted_original_mean"), F.col("predicted_modified_mean"))
    advice = (F.when(F.col("recommendation") == "boost", F.format_string(
        "**%s** is a strong lever for **%s**; raising it looks worthwhile.", c, t))
        .when(F.col("recommendation") == "risk", F.format_string(
            "Raising **%s** is predicted to lower **%s** by %.1f%%; proceed with care.", c, t,
            F.abs(d)))
        .otherwise(F.format_string(
            "**%s** barely reacts to **%s** (%.2f%%); look at stronger drivers.", t, c, d)))
    return result.withColumn("narrative", summary).withColumn("advice", advice)


def whatif(df: DataFrame, target: str, change_col: str, pct_change: float = 10.0,
           **model_kw) -> DataFrame:
    """Effect on the mean prediction of ``target`` when ``change_col``
    changes by ``pct_change`` percent.  Raises ``ValueError`` (W5) for an
    unknown or non-numeric column or when target == change column."""
    data, cols = numeric_frame(df)
    if target not in cols or change_col not in cols:
        raise ValueError(f"what-if needs numeric columns; not found: "
                         f"{[c for c in (target, change_col) if c not in cols]}")
    if target == change_col:
        raise ValueError("target and change column must differ")
    features = [c for c in cols if c != target]
    data = steady(data)
    model = fit_outcome_model(data, target, features, **model_kw)
    scored = {r["scenario"]: r["predicted_mean"] for r in
              score_scenarios(data, model, features, [(change_col, pct_change)]).collect()}
    drivers = top_drivers(model, features)
    out = df.sparkSession.createDataFrame(
        [(change_col, target, float(pct_change), float(scored[-1]), float(scored[0]),
          [(x["raw_col"], x["importance"]) for x in drivers])],
        "change_col string, target_col string, pct_change_input double, "
        "predicted_original_mean double, predicted_modified_mean double, "
        "drivers array<struct<raw_col:string,importance:double>>")
    out = out.withColumn("delta_pct", delta_pct(F.col("predicted_original_mean"), F.col("predicted_modified_mean")))
    out = out.withColumn("recommendation", branch(F.col("delta_pct")))
    out = out.withColumn("drivers", F.transform("drivers", lambda x: F.struct(
        readable_label(x["raw_col"]).alias("feature"), x["raw_col"].alias("raw_col"),
        x["importance"].alias("importance"))))
    return with_texts(out)


def whatif_candidates(df: DataFrame) -> DataFrame:
    """Per numeric column of the complete numeric rows whether it takes
    two, or more than two, different values, whether it may be simulated and
    whether it is a target candidate.

    Two algebraic passes answer that: least and greatest value, then whether
    a value lies between them.  No distinct count is needed.
    """
    data, cols = numeric_frame(df)
    ends = data.agg(*[f(F.col(f"`{c}`")).alias(f"{n}{k}") for k, c in enumerate(cols)
                      for n, f in (("lo", F.min), ("hi", F.max))]).first() if cols else {}
    inner = data.agg(*[F.coalesce(F.bool_or((F.col(f"`{c}`") > ends[f"lo{k}"]) & (F.col(f"`{c}`") < ends[f"hi{k}"])),
                                  F.lit(False)).alias(f"m{k}") if ends[f"lo{k}"] is not None
                       else F.lit(False).alias(f"m{k}") for k, c in enumerate(cols)]).first() if cols else {}
    varies = {c: ends[f"lo{k}"] is not None and ends[f"lo{k}"] < ends[f"hi{k}"] for k, c in enumerate(cols)}
    several = {c: varies[c] and inner[f"m{k}"] for k, c in enumerate(cols)}
    named = {c: any(x in c.lower() for x in EXCLUDED_NAME_PARTS) for c in cols}
    usable = [c for c in cols if several[c] and not named[c]]
    if len(usable) < 2:
        usable = [c for c in cols if varies[c]]
    if len(usable) < 2:
        usable = []
    goals = [c for c in usable if any(x in c.lower() for x in KPI_NAME_PARTS)] or usable
    return df.sparkSession.createDataFrame(
        [(c, k, varies[c], several[c], c in usable, c in goals) for k, c in enumerate(cols)],
        "column string, pos int, varies boolean, several boolean, valid boolean, is_target boolean")


DELTAS = ("pass string, target_pos int, change_rank int, change_col string, target_col string, "
          "pct_change_input double, predicted_original_mean double, predicted_modified_mean double, "
          "delta_pct double, drivers array<struct<raw_col:string,importance:double>>")


def select_scenarios(deltas: DataFrame, limit: int = 3, min_effect: float = 0.5) -> DataFrame:
    """W7 selection over a table of scored scenarios (:data:`DELTAS`).

    Of pass A count effects above ``min_effect`` percent, of pass B any.  A
    pair of columns is reported once whichever is the target: at its place of
    lowest target and relation rank, in pass B only if pass A has no report of
    it.  The first ``limit`` reports in the order of pass, target and rank."""
    pair = [F.least("change_col", "target_col"), F.greatest("change_col", "target_col")]
    able = deltas.filter((F.col("pass") == "B") | (F.abs("delta_pct") > min_effect))
    order = ["pass", "target_pos", "change_rank"]
    best = Window.partitionBy(*pair).orderBy(*order)
    return (able.withColumn("_k", F.row_number().over(best)).filter("_k = 1").drop("_k")
            .orderBy(*order).limit(limit))


def relation_ranks(data: DataFrame, cols: list[str]) -> DataFrame:
    """(target, other, rank): the other columns by descending |r|, columns
    without r last, then in column order."""
    half = pearson_long(data, cols)
    both = half.select(F.col("col_a").alias("target"), F.col("col_b").alias("other"), F.col("pos_b").alias("pos"), "r") \
        .unionByName(half.select(F.col("col_b").alias("target"), F.col("col_a").alias("other"),
                                 F.col("pos_a").alias("pos"), "r"))
    w = Window.partitionBy("target").orderBy(F.abs("r").desc_nulls_last(), "pos")
    return both.select("target", "other", (F.row_number().over(w)).alias("rank"))


def auto_whatif(df: DataFrame, limit: int = 3, **model_kw) -> DataFrame:
    """Scenarios chosen without a question from the user.

    Each target, in column order, gets one model; all its changes (+20 % in
    pass A, +10 % in pass B) are scored in one job and added to a table, from
    which :func:`select_scenarios` takes the reports.  Targets after ``limit``
    reports of pass A can't change the result and are not fitted.
    """
    marks = whatif_candidates(df).orderBy("pos").collect()
    usable = [r["column"] for r in marks if r["valid"]]
    spark = df.sparkSession
    table = spark.createDataFrame([], DELTAS)
    if usable:
        data, cols = numeric_frame(df)
        data = steady(data)
        ranks: dict[str, list] = {}
        for r in relation_ranks(data, usable).orderBy("target", "rank").collect():   # pairs of columns
            ranks.setdefault(r["target"], []).append((r["other"], r["rank"]))
        for place, goal in enumerate(r["column"] for r in marks if r["is_target"]):
            features = [c for c in cols if c != goal]
            model = fit_outcome_model(data, goal, features, **model_kw)
            plan = [(p, pct, c, k) for p, pct in (("A", 20.0), ("B", 10.0)) for c, k in ranks.get(goal, [])]
            means = {r["scenario"]: r["predicted_mean"] for r in
                     score_scenarios(data, model, features, [(c, pct) for _, pct, c, _ in plan]).collect()}
            drivers = [(x["raw_col"], x["importance"]) for x in top_drivers(model, features)]
            table = table.unionByName(spark.createDataFrame(
                [(p, place, k, c, goal, pct, means[-1], means[n], None, drivers)
                 for n, (p, pct, c, k) in enumerate(plan)], DELTAS).withColumn("delta_pct", delta_pct(
                     F.col("predicted_original_mean"), F.col("predicted_modified_mean"))))
            if select_scenarios(table.filter(F.col("pass") == "A"), limit).count() >= limit:
                break
    chosen = select_scenarios(table, limit)
    named = F.transform("drivers", lambda x: F.struct(readable_label(x["raw_col"]).alias("feature"),
                                                      x["raw_col"].alias("raw_col"), x["importance"].alias("importance")))
    return with_texts(chosen.withColumn("drivers", named).withColumn(
        "recommendation", branch(F.col("delta_pct")))
        .orderBy("pass", "target_pos", "change_rank").drop("target_pos", "change_rank"))
