"""Ridge regression from sufficient statistics.

One pass over the rows adds up, for each split, the weighted moments of the features and the target. Every penalty, the
choice among them on the validation split, and every bootstrap refit are then small systems of equations, as large as
the number of features squared whatever the number of rows. Partial moments are summed by tasks in numpy and by the
engine across tasks; refits are solved side by side, one group of equations for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from math import exp, factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.operators.features import TARGET
from tillcast.operators.forecast import target_scaler

PENALTIES = (0.001, 0.01, 0.1, 1.0, 10.0)
# The penalty where no validation rows can choose one, and in refits.
DEFAULT_PENALTY = 0.01
REFITS = 100
SEED = 12345
BATCH = 8192
# Fixed values of the draw: cumulative probabilities of a Poisson variable with mean 1, rounded, and its digits.
POISSON = tuple(round(p, 9) for p in accumulate(exp(-1.0) / factorial(k) for k in range(9)))


def _with_target(scaled: DataFrame, target: str) -> DataFrame:
    """Add the standardised target ``__y`` with its ``__mean`` and ``__std``."""
    stats = target_scaler(scaled, target)
    return scaled.withColumns(
        {"__mean": stats.select("mean").scalar(), "__std": stats.select("std").scalar()}
    ).withColumn("__y", (F.col(target) - F.col("__mean")) / F.col("__std"))


def moments(rows: DataFrame, columns: list[str], target: str, group: str, weights: str | None = None) -> DataFrame:
    """(group, fit, i, j, s): sums of the products of columns i and j, over the rows of each group.

    Column 0 is one, then come ``columns`` and last the target, so s holds counts, sums and products alike. With
    ``weights``, an array column, there is one set of sums for each of its entries, numbered by ``fit``; without, one.
    """
    width = len(columns) + 2

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                x = np.ones((batch.num_rows, width))
                for i in range(1, width):
                    x[:, i] = batch.column(i).to_numpy(zero_copy_only=False)
                names = np.array(batch.column(0).to_pylist(), object)
                w = None
                if weights:
                    w = np.asarray(batch.column(width).flatten()).reshape(batch.num_rows, -1)
                for name in set(names.tolist()):
                    mine = names == name
                    part = x[mine]
                    if w is None:
                        made = (part.T @ part)[None]
                    else:
                        made = np.stack([(part * column[:, None]).T @ part for column in w[mine].T])
                    total[name] = total.get(name, 0) + made
        i, j = np.triu_indices(width)
        for name, made in total.items():
            fits = len(made)
            yield pa.RecordBatch.from_arrays([
                pa.array([name] * (fits * len(i)), pa.string()), pa.array(np.repeat(np.arange(fits), len(i)), pa.int32()),
                pa.array(np.tile(i, fits), pa.int32()), pa.array(np.tile(j, fits), pa.int32()), pa.array(made[:, i, j].ravel()),
            ], ["grp", "fit", "i", "j", "s"])

    used = [F.col(group).cast("string").alias("grp"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]]
    used += [F.col(target).cast("double").alias("y"), *([F.col(weights).alias("w")] if weights else [])]
    complete = rows.select(*used).dropna(subset=["y", *[f"x{i}" for i in range(len(columns))]])
    parts = complete.mapInArrow(summed, "grp string, fit int, i int, j int, s double")
    return parts.groupBy("grp", "fit", "i", "j").agg(F.sum("s").alias("s"))


def _square(i: np.ndarray, j: np.ndarray, s: np.ndarray) -> np.ndarray:
    out = np.zeros((int(i.max()) + 1,) * 2)
    out[i, j] = out[j, i] = s
    return out


def solve(products: np.ndarray, penalty: float) -> np.ndarray:
    """Intercept and coefficients: the mean squared error plus ``penalty`` times the coefficients' squares is least.

    The intercept is not penalised. Without rows the prediction is the mean of the standardised target, zero.
    """
    n, k = products[0, 0], len(products) - 2
    if n <= 0:
        return np.zeros(k + 1)
    mean = products[0, 1:] / n
    centred = products[1:, 1:] / n - np.outer(mean, mean)
    slopes = np.linalg.solve(centred[:-1, :-1] + penalty * np.eye(k), centred[:-1, -1])
    return np.concatenate([[mean[-1] - mean[:-1] @ slopes], slopes])


def mean_squared_error(products: np.ndarray, coefficients: np.ndarray) -> float | None:
    """Of a fit on the rows behind ``products``; None without rows."""
    if products is None or products[0, 0] <= 0:
        return None
    residual = np.append(-coefficients, 1.0)
    return float(max(residual @ products @ residual, 0.0) / products[0, 0])


@dataclass(frozen=True)
class Ridge:
    """A fitted model on the standardised target: the chosen penalty and, for each penalty tried, what came out."""

    columns: list[str]
    intercept: float
    slopes: list[float]
    penalty: float
    path: list[dict]


def fit_path(
    scaled: DataFrame, columns: list[str], penalties: tuple[float, ...] = PENALTIES, target: str = TARGET
) -> Ridge:
    """Fit every penalty on the train split and keep the one with the least error on the validation split.

    One pass over train and validation rows. On a tie the larger penalty is kept; without validation rows
    ``DEFAULT_PENALTY``. Rows with a null feature are left out.
    """
    rows = _with_target(scaled.where(F.col("split").isin("train", "val")), target)
    found = moments(rows, columns, "__y", "split").toPandas()  # two sets of numbers, features squared
    parts = {g: _square(p["i"].to_numpy(), p["j"].to_numpy(), p["s"].to_numpy()) for g, p in found.groupby("grp")}
    if "train" not in parts:
        raise ValueError("the train split has no complete rows to fit on")
    path = []
    tried = penalties if "val" in parts else (DEFAULT_PENALTY,)
    for penalty in sorted(tried, reverse=True):
        b = solve(parts["train"], penalty)
        path.append({
            "penalty": float(penalty), "intercept": float(b[0]), "slopes": [float(v) for v in b[1:]],
            "train_mse": mean_squared_error(parts["train"], b), "val_mse": mean_squared_error(parts.get("val"), b),
        })
    best = min(path, key=lambda p: (p["val_mse"] is not None and p["val_mse"], -p["penalty"]))
    return Ridge(columns, best["intercept"], best["slopes"], best["penalty"], path)


def path_table(scaled: DataFrame, model: Ridge) -> DataFrame:
    """(penalty, intercept, slope_<column> .., train_mse, val_mse, chosen), one row per penalty tried."""
    rows = [
        (p["penalty"], p["intercept"], *p["slopes"], p["train_mse"], p["val_mse"], int(p["penalty"] == model.penalty))
        for p in model.path
    ]
    slopes = ", ".join(f"`slope_{c}` double" for c in model.columns)
    schema = f"penalty double, intercept double, {slopes}, train_mse double, val_mse double, chosen int"
    return scaled.sparkSession.createDataFrame(rows, schema)


def predict(model: Ridge, scaled: DataFrame, name: str = "predicted", target: str = TARGET) -> DataFrame:
    """Add the prediction in cents to every row; built-in expressions only."""
    stats = target_scaler(scaled, target)
    raw = F.lit(model.intercept)
    for column, slope in zip(model.columns, model.slopes):
        raw = raw + F.col(column).cast("double") * F.lit(slope)
    return scaled.withColumns(
        {"__mean": stats.select("mean").scalar(), "__std": stats.select("std").scalar()}
    ).withColumn(name, raw * F.col("__std") + F.col("__mean")).drop("__mean", "__std")


def draws(refits: int = REFITS, seed: int = SEED) -> Column:
    """How often a row is drawn in each bootstrap round: Poisson(1) counts from a digest of the row's key.

    The first 32 bits of a digest of date, location, seed and round are a share of one; the count is how many of the
    cumulative probabilities lie at or below it. So a pass that is repeated draws the same rows.
    """

    def drawn(k: Column) -> Column:
        key = F.concat_ws("|", F.col("business_date").cast("string"), F.col("location_id").cast("string"), F.lit(str(seed)),
                          k.cast("string"))
        share = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
        count = F.lit(0.0)
        for edge in POISSON:
            count = count + F.when(share >= edge, 1.0).otherwise(0.0)
        return count

    return F.transform(F.sequence(F.lit(0), F.lit(refits - 1)), drawn)


def refit_coefficients(
    scaled: DataFrame, columns: list[str], refits: int = REFITS, seed: int = SEED, penalty: float = DEFAULT_PENALTY,
    target: str = TARGET,
) -> DataFrame:
    """(fit, intercept, slopes) of every bootstrap round, from one pass over the train rows.

    The weighted products of all rounds are added up together; each round's equations are then one group, as large
    as the number of features squared.
    """
    train = _with_target(scaled, target).where(F.col("split") == "train").withColumn("__w", draws(refits, seed))
    products = moments(train, columns, "__y", "split", "__w")

    def solved(part: pd.DataFrame) -> pd.DataFrame:
        b = solve(_square(part["i"].to_numpy(), part["j"].to_numpy(), part["s"].to_numpy()), penalty)
        return pd.DataFrame([{"fit": part["fit"].iloc[0], "intercept": float(b[0]), "slopes": b[1:].tolist()}])

    return products.groupBy("fit").applyInPandas(solved, "fit int, intercept double, slopes array<double>")


def forecast_uncertainty(
    scaled: DataFrame, columns: list[str], refits: int = REFITS, seed: int = SEED, penalty: float = DEFAULT_PENALTY,
    target: str = TARGET,
) -> DataFrame:
    """Future rows with the population deviation of their prediction over bootstrap refits, in cents.

    All refits' coefficients come from one pass over the train rows (see ``refit_coefficients``); they are a table of
    ``refits`` rows that stands beside each future row as one array.
    """
    fits = refit_coefficients(scaled, columns, refits, seed, penalty, target)
    every = fits.agg(F.collect_list(F.struct("intercept", "slopes"))).scalar()
    stats = target_scaler(scaled, target)
    future = scaled.where(F.col("split") == "future").withColumns(
        {"__fits": every, "__std": stats.select("std").scalar(), "__x": F.array(*[F.col(c).cast("double") for c in columns])}
    )
    zero = F.lit(0.0)

    def predicted(fit: Column) -> Column:
        return fit["intercept"] + F.aggregate(F.zip_with("__x", fit["slopes"], lambda x, b: x * b), zero, lambda a, v: a + v)

    samples = future.withColumn("__p", F.transform("__fits", predicted))
    mean = F.aggregate("__p", zero, lambda a, v: a + v) / F.size("__p")
    spread = samples.withColumn("__m", mean).withColumn(
        "__v", F.aggregate(F.transform("__p", lambda v: (v - F.col("__m")) * (v - F.col("__m"))), zero, lambda a, v: a + v)
    )
    return spread.withColumn("model_uncertainty", F.sqrt(F.col("__v") / F.size("__p")) * F.col("__std")).drop(
        "__fits", "__std", "__x", "__p", "__m", "__v"
    )
