"""Queries for model protocols (I-06, I-07, I-09..I-11, I-13, I-14, I-17): fitted values are not SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourmark.functions import calendar as C
from hourmark.operators import features as feats
from hourmark.operators import metrics, models, shaping, splits
from hourmark.plans import series as S
from hourmark.plans.catalog import query

FEATURES = ["lag24", "lag48", "lag168", "hour_sin", "hour_cos", "day_of_week", *[f"site_{s}" for s in S.SITES]]
METRIC_SPEC = "variant:s rows:i mae:f rmse:f"
FOLDS = 5


def frame(spark: SparkSession, path: str) -> DataFrame:
    """Per-site hourly targets with lags, calendar, site flags, a whole-week fold and two weather stand-ins."""
    hourly = S.settle(S.site_hours(spark, path))
    rows = feats.hour_lags(hourly, ["site_id"], "valid_time_utc", ["value"], [2, 24, 26, 48, 168], names="lag{lag}").dropna(subset=["lag24"])
    rows = shaping.one_hot(C.with_calendar(rows), "site_id", S.SITES, "site_")
    market = S.market(spark, path).select("valid_time_utc", F.col("id_price").alias("weather_actual"))
    rows = rows.join(market, "valid_time_utc", "left").withColumns(
        {
            "weather_forecast": F.coalesce("lag24", F.lit(0.0)),
            "last_residual": F.col("lag2") - F.col("lag26"), "residual": F.col("value") - F.col("lag24"),
        }
    )
    weeks = splits.seasonal_folds(splits.week_table(hourly, "valid_time_utc"), FOLDS).select("week_start", "fold")
    # one row per calendar week, so the fold list may be broadcast
    rows = rows.withColumn("week_start", splits.week_start(F.col("valid_time_utc"))).join(F.broadcast(weeks), "week_start")
    numeric = [c for c in ("day_of_week", *[f"site_{s}" for s in S.SITES])]
    return S.settle(rows.withColumns({c: F.col(c).cast("double") for c in numeric}))


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Earlier two thirds of the days against the rest."""
    cut = S.cut_day(df, "delivery_date_local", (2, 3))
    return df.filter(F.col("delivery_date_local") <= cut), df.filter(F.col("delivery_date_local") > cut)


def _scores(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    long = shaping.melt(df, ["site_id", "valid_time_utc", "value"], columns)
    return metrics.point_metrics(long, ["variant"], "value", "prediction")


@query("i06_point_regressor", METRIC_SPEC)
def point_regressor(spark: SparkSession, path: str) -> DataFrame:
    """Boosted trees against persistence on a later window, clipped at zero."""
    train, test = _split(frame(spark, path))
    model = models.fit(train, FEATURES, models.boosted_trees("value", 15, 4))
    return _scores(models.predict(model, test, low=0.0), {"lag24": "persistence", "prediction": "trees"})


@query("i07_huber_spread", METRIC_SPEC)
def huber_spread(spark: SparkSession, path: str) -> DataFrame:
    """Residual learned under Huber loss and added back to the base."""
    train, test = _split(frame(spark, path))
    model = models.fit(train, FEATURES, models.huber_regression("residual"), standardise=True)
    scored = models.predict(model, test, "correction").withColumn("corrected", F.col("lag24") + F.col("correction"))
    return _scores(scored, {"lag24": "base", "corrected": "huber"})


@query("i09_cross_fit", "rows:i predicted:i keys:i mae:f")
def cross_fit(spark: SparkSession, path: str) -> DataFrame:
    """One out-of-fold prediction per row."""
    df = frame(spark, path)
    scored = models.cross_fit(df, "fold", FOLDS, FEATURES, models.boosted_trees("value", 8, 4), "oof", low=0.0)
    return scored.agg(
        F.count(F.lit(1)).alias("rows"), F.count("oof").alias("predicted"), F.count_distinct("site_id", "valid_time_utc").alias("keys"),
        metrics.mae(F.col("value"), F.col("oof")).alias("mae"),
    )


@query("i10_nested_cross_fit", METRIC_SPEC)
def nested_cross_fit(spark: SparkSession, path: str) -> DataFrame:
    """Proxy on actual weather, read from forecasts at prediction time."""
    df = frame(spark, path).dropna(subset=["weather_actual"])
    scored = models.nested_cross_fit(
        df, "fold", FOLDS, {"weather_actual": "weather_forecast"}, "value", ["lag24", "hour_sin", "hour_cos"], "value",
        lambda label: models.boosted_trees(label, 4, 3),
    )
    return _scores(scored, {"lag24": "persistence", "prediction": "nested"})


@query("i11_residual_correction", METRIC_SPEC)
def residual_correction(spark: SparkSession, path: str) -> DataFrame:
    """Baseline, residual persistence and a direct residual model over outer folds."""
    df = frame(spark, path).dropna(subset=["last_residual"])
    scored = models.cross_fit(df, "fold", FOLDS, ["last_residual", *FEATURES], models.boosted_trees("residual", 8, 4), "correction")
    scored = scored.withColumns(
        {"persisted": F.greatest(F.col("lag24") + F.col("last_residual"), F.lit(0.0)), "direct": F.greatest(F.col("lag24") + F.col("correction"), F.lit(0.0))}
    )
    return _scores(scored, {"lag24": "baseline", "persisted": "persistence", "direct": "direct"})


@query("i13_feature_importance", "feature:s importance:f")
def feature_importance(spark: SparkSession, path: str) -> DataFrame:
    train, _ = _split(frame(spark, path))
    model = models.fit(train, FEATURES, models.boosted_trees("value", 8, 4))
    return models.importances(model, FEATURES, spark)


@query("i14_ablation", "variant:s protocol:s rows:i mae:f rmse:f")
def ablation(spark: SparkSession, path: str) -> DataFrame:
    """Feature sets scored by chronological holdout and by pooled out-of-fold predictions."""
    df = frame(spark, path)
    train, test = _split(df)
    sets = {"lags_only": ["lag24", "lag48"], "with_calendar": ["lag24", "lag48", "hour_sin", "hour_cos", "day_of_week"]}
    tables = []
    for name, columns in sets.items():
        factory = models.huber_regression("value")
        held = models.predict(models.fit(train, columns, factory, standardise=True), test)
        pooled = models.cross_fit(df, "fold", FOLDS, columns, factory, "prediction")
        for protocol, scored in (("holdout", held), ("week_cv", pooled)):
            part = metrics.point_metrics(scored, [], "value", "prediction")
            tables.append(part.withColumns({"variant": F.lit(name), "protocol": F.lit(protocol)}))
    out = tables[0]
    for part in tables[1:]:
        out = out.unionByName(part)
    return out


@query("i17_component_table", "component:s variant:s rows:i mae:f rmse:f nmae:f")
def component_table(spark: SparkSession, path: str) -> DataFrame:
    """Several components trained early, tested late, in one metric table on identical rows."""
    train, test = _split(frame(spark, path))
    out = None
    for component, sites in (("power", ["view", "signup", "error"]), ("price", ["purchase", "click"])):
        seen, unseen = train.filter(F.col("site_id").isin(sites)), test.filter(F.col("site_id").isin(sites))
        model = models.fit(seen, FEATURES, models.boosted_trees("value", 8, 4))
        long = shaping.melt(models.predict(model, unseen, low=0.0), ["site_id", "valid_time_utc", "value"], {"lag24": "persistence", "prediction": "trees"})
        peak = seen.agg(F.max("value")).scalar()
        scores = metrics.point_metrics(long, ["variant"], "value", "prediction").withColumn("component", F.lit(component))
        scores = scores.withColumn("nmae", F.col("mae") / peak) if component == "power" else scores
        out = scores if out is None else out.unionByName(scores, allowMissingColumns=True)
    return out
