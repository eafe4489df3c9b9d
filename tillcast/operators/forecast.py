"""Forecast data operators: baselines, scores, error bands, next-day rollup, history.

They take any prediction column in cents, from a baseline or from a fitted model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.functions.columns import dollars, flag
from tillcast.functions.quantiles import exact_quantiles
from tillcast.operators.features import TARGET

# Baseline name -> feature; context shown beside a forecast; quantiles of the band.
BASELINES = {"baseline_last_week": "sales_lag_7", "baseline_rolling_7": "sales_roll_mean_7"}
CONTEXT = ("sales_lag_1", "sales_lag_7", "sales_roll_mean_7", "sales_roll_mean_28")
LOW_QUANTILE, HIGH_QUANTILE = 0.10, 0.90
MIN_TICKET_CENTS = 100
HONEST_SPLITS = ("val", "test")
TINY = 1e-9
TOP_FEATURES = 6


def target_scaler(rows: DataFrame, target: str = TARGET) -> DataFrame:
    """(mean, std) of the target on the train split, with the population deviation."""
    sd = F.stddev_pop(target)
    return rows.where(F.col("split") == "train").agg(
        F.avg(target).alias("mean"), F.when(sd > TINY, sd).otherwise(F.lit(1.0)).alias("std")
    )


def baseline_predictions(rows: DataFrame, predictors: dict[str, str] | None = None) -> DataFrame:
    """Long form (business_date, location_id, split, predictor, actual, predicted) in cents.

    ``predictors`` maps a name to a column; by default the two free guesses.
    """
    guesses = F.array(*[
        F.struct(F.lit(name).alias("predictor"), F.col(c).cast("double").alias("predicted"))
        for name, c in (predictors or BASELINES).items()
    ])
    return rows.where(F.col("is_future") == 0).select(
        "business_date", "location_id", "split", F.col(TARGET).alias("actual"), F.inline(guesses)
    )


def score(
    df: DataFrame, actual_col: str = "actual", predicted_col: str = "predicted",
    by: tuple[str, ...] = ("split", "predictor"),
) -> DataFrame:
    """MAE, RMSE, MAPE and mean actual in dollars. Days that sold nothing are left out of the MAPE, which
    is null when every day was zero."""
    actual = F.col(actual_col) / F.lit(100.0)
    error = F.abs(actual - F.col(predicted_col) / F.lit(100.0))
    share = F.when(F.col(actual_col) != 0, F.abs(error / actual))
    return df.groupBy(*by).agg(
        F.bround(F.avg(error), 2).alias("mae_dollars"),
        F.bround(F.sqrt(F.avg(error * error)), 2).alias("rmse_dollars"),
        F.bround(F.avg(share) * 100, 2).alias("mape_percent"),
        F.bround(F.avg(actual), 2).alias("mean_actual_dollars"),
        F.count(F.lit(1)).alias("n_days"),
    )


def verdict(scores: DataFrame, model: str, baselines: tuple[str, ...] = tuple(BASELINES)) -> DataFrame:
    """One row per baseline on the test split: how much lower the model's error is."""
    test = scores.where(F.col("split") == "test")
    against = test.where(F.col("predictor").isin(*baselines) & (F.col("predictor") != model)).select(
        F.col("predictor").alias("baseline"), F.col("mae_dollars").alias("baseline_mae_dollars")
    )
    ours = test.where(F.col("predictor") == model).select("mae_dollars").scalar()
    gain = F.col("baseline_mae_dollars") - F.col("model_mae_dollars")
    rows = against.withColumn("model_mae_dollars", ours).select(
        "baseline", "model_mae_dollars", "baseline_mae_dollars",
        F.bround(gain, 2).alias("improvement_dollars"),
        F.when(
            F.col("baseline_mae_dollars") != 0, F.bround(gain / F.col("baseline_mae_dollars") * 100, 1)
        ).otherwise(F.lit(0.0)).alias("improvement_percent"),
        flag(gain > 0).alias("model_wins"),
    )
    return rows.withColumn("beats_all_baselines", rows.agg(F.min("model_wins")).scalar())


def residual_band(
    df: DataFrame, actual_col: str = TARGET, predicted_col: str = "predicted",
    low: float = LOW_QUANTILE, high: float = HIGH_QUANTILE,
) -> DataFrame:
    """Exact quantiles (linear interpolation) and population deviation of actual - predicted on the
    validation split, one row; without validation rows nulls and a count of 0.
    """
    residuals = df.where(F.col("split") == "val").select(
        (F.col(actual_col) - F.col(predicted_col)).cast("double").alias("r")
    )
    ends = exact_quantiles(residuals, "r", [low, high])
    spread = residuals.agg(F.stddev_pop("r")).scalar()
    return ends.select(F.col("q0").alias("low"), F.col("q1").alias("high"), spread.alias("std"), "n")


def _band_value(band: DataFrame, name: str) -> Column:
    return band.select(name).scalar()


def confidence(predicted: Column, low: Column, high: Column) -> Column:
    """1 for a band that is narrow beside the prediction, 0 for one as wide as the prediction."""
    relative = F.when(predicted > 0, F.abs(high - low) / predicted).otherwise(F.lit(1.0))
    return F.greatest(F.least(1 - relative, F.lit(1.0)), F.lit(0.0))


def _future(
    rows: DataFrame, predicted_col: str, band: DataFrame, uncertainty_col: str | None
) -> DataFrame:
    """Forecast columns of the future rows, with the context still in unrounded cents."""
    p = F.col(predicted_col).cast("double")
    ticket = F.col("avg_ticket_lag_7")
    low, high = F.col("__low"), F.col("__high")
    orders = F.when((ticket >= MIN_TICKET_CENTS) & (p > 0), F.bround(p / ticket).cast("bigint"))
    return (
        rows.where(F.col("split") == "future")
        .withColumns({"__low": band.select("low").scalar(), "__high": band.select("high").scalar()})
        .select(
            "business_date", "location_id",
            dollars(p).alias("predicted_sales"),
            dollars(F.greatest(p + low, F.lit(0.0))).alias("interval_low"),
            dollars(p + high).alias("interval_high"),
            F.bround(confidence(p, low, high), 3).alias("confidence"),
            (dollars(F.col(uncertainty_col)) if uncertainty_col else F.lit(0.0)).alias("model_uncertainty"),
            orders.alias("estimated_orders"),
            *[F.col(c).cast("double").alias(c) for c in CONTEXT],
        )
    )


def forecast_rows(
    rows: DataFrame, predicted_col: str, band: DataFrame, uncertainty_col: str | None = None
) -> DataFrame:
    """Forecast of every future row in dollars, with band, confidence, order estimate and context.

    The low end never falls below zero; a ticket under one dollar gives no order estimate.
    """
    return _future(rows, predicted_col, band, uncertainty_col).withColumns(
        {c: dollars(F.col(c)) for c in CONTEXT}
    )


def next_day_rows(rows: DataFrame) -> DataFrame:
    """Rows of the earliest future date: of the locations that still trade there (a positive 28-day mean), or of all
    of them when none does."""
    day = rows.where(F.col("split") == "future").agg(F.min("business_date")).scalar()
    tomorrow = rows.where(F.col("split") == "future").withColumn("__day", day).where(
        F.col("business_date") == F.col("__day")
    ).drop("__day")
    trading = tomorrow.agg(F.coalesce(F.max(flag(F.col("sales_roll_mean_28") > 0)), F.lit(0))).scalar()
    return tomorrow.withColumn("__any", trading).where(
        (F.col("__any") == 0) | (F.col("sales_roll_mean_28") > 0)
    ).drop("__any")


def next_day_forecast(
    rows: DataFrame, predicted_col: str, band: DataFrame, uncertainty_col: str | None = None
) -> DataFrame:
    """The earliest future date summed over the locations that still trade (a positive 28-day mean), or
    over all of its locations when none does."""
    future = _future(rows, predicted_col, band, uncertainty_col)
    tomorrow = (
        future.withColumn("__day", rows.where(F.col("split") == "future").agg(F.min("business_date")).scalar())
        .where(F.col("business_date") == F.col("__day"))
        .withColumn("__trades", flag(F.col("sales_roll_mean_28") > 0))
    )
    sums = tomorrow.groupBy("business_date", "__trades").agg(
        *[F.sum(c).alias(c) for c in ("predicted_sales", "interval_low", "interval_high", *CONTEXT)],
        F.sum(F.col("model_uncertainty") * F.col("model_uncertainty")).alias("variance"),
        F.sum(F.when(F.col("estimated_orders") >= 0, F.col("estimated_orders"))).alias("estimated_orders"),
        F.count(F.lit(1)).alias("locations"),
    )
    # At most two rows: the sum of the trading locations is taken when there is one.
    values = [c for c in sums.columns if c not in ("business_date", "__trades")]
    total = (
        sums.groupBy("business_date")
        .agg(F.max_by(F.struct(*values), "__trades").alias("t"))
        .select("business_date", "t.*")
    )
    p = F.col("predicted_sales")
    width = F.greatest(F.col("interval_high") - F.col("interval_low"), F.lit(0.0))
    return total.select(
        "business_date",
        *[F.bround(c, 2).alias(c) for c in ("predicted_sales", "interval_low", "interval_high")],
        F.when(p > 0, F.bround(F.greatest(F.least(1 - width / p, F.lit(1.0)), F.lit(0.0)), 3))
        .otherwise(F.lit(0.0)).alias("confidence"),
        F.bround(F.sqrt("variance"), 2).alias("model_uncertainty"),
        "estimated_orders",
        *[dollars(F.col(c)).alias(c) for c in CONTEXT],
        "locations",
    )


def forecast_history(rows: DataFrame, predicted_col: str, days: int = 30, target: str = TARGET) -> DataFrame:
    """Actual against predicted, summed over locations, on days no model was trained on; newest first."""
    points = (
        rows.where(F.col("split").isin(*HONEST_SPLITS))
        .groupBy("split", "business_date")
        .agg(
            F.bround(F.sum(F.col(target) / F.lit(100.0)), 2).alias("actual"),
            F.bround(F.sum(F.col(predicted_col) / F.lit(100.0)), 2).alias("predicted"),
        )
    )
    return points.orderBy(F.desc("business_date"), "split").limit(days)


def test_metrics(scores: DataFrame, verdicts: DataFrame, model: str) -> DataFrame:
    """The model's test scores with the comparison against each baseline: one row per baseline."""
    block = scores.where((F.col("split") == "test") & (F.col("predictor") == model)).select(
        "split",
        F.col("mae_dollars").alias("mae"),
        F.col("rmse_dollars").alias("rmse"),
        F.col("mape_percent").alias("mape"),
        F.col("mean_actual_dollars").alias("mean_actual"),
        "n_days",
    )
    compared = verdicts.select(
        F.lit("test").alias("split"),
        F.regexp_replace(F.regexp_replace("baseline", "^baseline_", ""), "_", " ").alias("baseline"),
        F.col("baseline_mae_dollars").alias("baseline_mae"),
        F.col("improvement_dollars").alias("improvement"),
        "model_wins", "beats_all_baselines",
    )
    return block.join(compared, "split")


def explain(
    slopes: list[float], scaled: DataFrame, unscaled: DataFrame, columns: list[str], top: int = TOP_FEATURES
) -> DataFrame:
    """The features that moved the given rows' forecast most.

    For a linear model, gradient times input is slope times scaled value, summed over the rows.
    ``unscaled`` holds the same rows in original units, for display. Money is shown in dollars.
    """
    pushed = scaled.agg(*[
        F.sum(F.col(c).cast("double") * F.lit(w)).alias(c) for c, w in zip(columns, slopes)
    ])
    shown = unscaled.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])

    def long(wide: DataFrame, value: str) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias(value)) for c in columns])
        return wide.select(F.inline(entries))

    effect = long(pushed, "saliency")
    total = effect.agg(F.sum(F.abs("saliency"))).scalar()
    money = F.col("name").startswith("sales_") | F.col("name").startswith("avg_ticket")
    return (
        effect.withColumn("__total", total)
        .where(F.col("__total") > 0)
        .join(long(shown, "value"), "name")
        .select(
            "name",
            F.bround(F.when(money, F.col("value") / 100).otherwise(F.col("value")), 2).alias("value"),
            F.bround(F.abs("saliency") / F.col("__total"), 4).alias("contribution"),
            F.when(F.col("saliency") >= 0, "up").otherwise("down").alias("direction"),
            F.abs("saliency").alias("__size"),
        )
        .orderBy(F.desc("__size"), "name")
        .limit(top)
        .drop("__size")
    )
