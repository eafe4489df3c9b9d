"""Spark ML forecasts: fit on the train split, score any split, spread over refits, explanation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.operators import ridge
from tillcast.operators.features import TARGET
from tillcast.operators.forecast import TOP_FEATURES, explain, target_scaler
from tillcast.operators.ridge import REFITS, SEED


def _with_target(scaled: DataFrame) -> DataFrame:
    """Add the standardised target ``__y`` and its scale."""
    stats = target_scaler(scaled)
    return scaled.withColumns(
        {"__mean": stats.select("mean").scalar(), "__std": stats.select("std").scalar()}
    ).withColumn("__y", (F.col(TARGET) - F.col("__mean")) / F.col("__std"))


def _linear(weight_col: str | None = None) -> LinearRegression:
    model = LinearRegression(
        featuresCol="__x", labelCol="__y", predictionCol="__p", regParam=0.01, solver="normal"
    )
    return model.setWeightCol(weight_col) if weight_col else model


def fit_model(
    scaled: DataFrame, columns: list[str], estimator: str = "linear", seed: int = 42,
    weight_col: str | None = None,
) -> PipelineModel:
    """Fit on scaled features of the train split.

    ``gbt`` also reads the validation split and stops adding trees when it no longer improves;
    ``linear`` is ridge regression.
    """
    rows = _with_target(scaled)
    assembler = VectorAssembler(inputCols=columns, outputCol="__x")
    if estimator == "gbt":
        learned = rows.where(F.col("split").isin("train", "val")).withColumn("__val", F.col("split") == "val")
        model = GBTRegressor(
            featuresCol="__x", labelCol="__y", predictionCol="__p", seed=seed, maxIter=40, maxDepth=4,
            validationIndicatorCol="__val",
        )
    elif estimator == "linear":
        learned = rows.where(F.col("split") == "train")
        model = _linear(weight_col)
    else:
        raise ValueError(f"unknown estimator {estimator!r}")
    return Pipeline(stages=[assembler, model]).fit(learned)


def predict(model: PipelineModel, scaled: DataFrame, name: str = "predicted") -> DataFrame:
    """Add the prediction in cents to every row."""
    out = model.transform(_with_target(scaled))
    return out.withColumn(name, F.col("__p") * F.col("__std") + F.col("__mean")).drop(
        "__x", "__p", "__y", "__mean", "__std"
    )


def forecast_uncertainty(
    scaled: DataFrame, columns: list[str], refits: int = REFITS, seed: int = SEED
) -> DataFrame:
    """Future rows with the population deviation of their prediction over bootstrap refits, in cents: one pass over
    the train rows for all refits, see ``ridge.forecast_uncertainty``."""
    return ridge.forecast_uncertainty(scaled, columns, refits, seed)


def explain_forecast(
    model: PipelineModel, scaled: DataFrame, unscaled: DataFrame, columns: list[str], top: int = TOP_FEATURES
) -> DataFrame:
    """The features that moved the given rows' forecast most.

    For a linear model, gradient times input is coefficient times scaled value, summed over the rows.
    ``unscaled`` holds the same rows in original units, for display. Money is shown in dollars.
    """
    return explain([float(w) for w in model.stages[-1].coefficients], scaled, unscaled, columns, top)
