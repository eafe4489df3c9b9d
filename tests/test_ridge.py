"""Ridge from sufficient statistics against plain numpy; isolated checks; the gate on trading days."""

import hashlib
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillcast.operators import forecast, ridge, validate
from tillcast.operators.features import TARGET

COLUMNS = [f"f{i}" for i in range(68)]
DAY0 = date(2026, 1, 1)


@pytest.fixture(scope="module")
def scaled(spark):
    """Five locations; some rows lack a feature; validation and future rows follow the train rows."""
    rng = np.random.default_rng(5)
    rows = []
    for n in range(80):
        for place in range(5):
            x = rng.normal(size=68)
            y = 50_000 + 4_000 * x[0] - 2_500 * x[7] + 900 * x[0] * (place == 2) + rng.normal() * 3_000
            split = "train" if n < 60 else "val" if n < 70 else "test" if n < 79 else "future"
            values = [float(v) for v in x]
            if (n, place) == (3, 1):
                values[4] = None
            rows.append((DAY0 + timedelta(days=n), f"L{place}", split, int(split == "future"), None if split == "future" else int(y), *values))
    schema = f"business_date date, location_id string, split string, is_future int, {TARGET} long, " + ", ".join(f"{c} double" for c in COLUMNS)
    return spark.createDataFrame(rows, schema).repartition(7)


def arrays(scaled, split):
    rows = [r for r in scaled.where(F.col("split") == split).collect() if None not in [r[c] for c in COLUMNS]]
    return rows, np.array([[r[c] for c in COLUMNS] for r in rows]), np.array([r[TARGET] or 0 for r in rows], float)


def solved(x, y, w, penalty):
    n = w.sum()
    mx, my = (w @ x) / n, (w @ y) / n
    a = ((x - mx) * w[:, None]).T @ (x - mx) / n + penalty * np.eye(x.shape[1])
    b = np.linalg.solve(a, ((x - mx) * w[:, None]).T @ (y - my) / n)
    return my - mx @ b, b


def target_scale(scaled):
    every = np.array([r[TARGET] for r in scaled.where("split = 'train'").collect()], float)
    return every.mean(), every.std()


def test_every_penalty_solves_the_normal_equations(scaled):
    _, x, y = arrays(scaled, "train")
    _, vx, vy = arrays(scaled, "val")
    mean, std = target_scale(scaled)
    model = ridge.fit_path(scaled, COLUMNS)
    errors = {}
    for p in model.path:
        b0, b = solved(x, (y - mean) / std, np.ones(len(y)), p["penalty"])
        assert np.allclose(p["slopes"], b) and np.isclose(p["intercept"], b0)
        errors[p["penalty"]] = np.mean(((vy - mean) / std - b0 - vx @ b) ** 2)
        assert np.isclose(p["val_mse"], errors[p["penalty"]])
    assert model.penalty == min(errors, key=errors.get)
    got = {(r.business_date, r.location_id): r.predicted for r in ridge.predict(model, scaled).collect()}
    rows, tx, _ = arrays(scaled, "test")
    want = (model.intercept + tx @ np.array(model.slopes)) * std + mean
    assert np.allclose([got[r.business_date, r.location_id] for r in rows], want)
    assert got[DAY0 + timedelta(days=3), "L1"] is None
    table = ridge.path_table(scaled, model)
    assert table.where("chosen = 1").first().penalty == model.penalty and "slope_f67" in table.columns


def test_without_validation_rows_the_default_penalty_is_used(scaled):
    model = ridge.fit_path(scaled.where("split <> 'val'"), COLUMNS[:3])
    assert model.penalty == ridge.DEFAULT_PENALTY and model.path[0]["val_mse"] is None
    with pytest.raises(ValueError, match="train"):
        ridge.fit_path(scaled.where("split = 'val'"), COLUMNS[:3])


def drawn(row, k):
    share = int(hashlib.md5(f"{row.business_date}|{row.location_id}|{ridge.SEED}|{k}".encode()).hexdigest()[:8], 16) / 2**32
    return sum(share >= edge for edge in ridge.POISSON)


def test_bootstrap_is_one_pass_with_repeatable_draws(scaled):
    rows, x, y = arrays(scaled, "train")
    mean, std = target_scale(scaled)
    future, fx, _ = arrays(scaled, "future")
    samples, weights = [], []
    for k in range(12):
        w = np.array([drawn(r, k) for r in rows], float)
        b0, b = solved(x, (y - mean) / std, w, ridge.DEFAULT_PENALTY)
        samples.append(b0 + fx @ b)
        weights.append(w.mean())
    assert abs(np.mean(weights) - 1) < 0.05
    got = {r.location_id: r.model_uncertainty for r in ridge.forecast_uncertainty(scaled, COLUMNS, refits=12).collect()}
    want = dict(zip([r.location_id for r in future], np.std(samples, axis=0) * std))
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in got)


def test_model_beside_the_free_guesses(scaled):
    """The verdict names the model against every baseline, and wins where it knows what the baselines do not."""
    rows = scaled.withColumns({"sales_lag_7": F.lit(30_000), "sales_roll_mean_7": F.lit(60_000.0)})
    rows = ridge.predict(ridge.fit_path(rows, COLUMNS), rows)
    scores = forecast.score(forecast.baseline_predictions(rows, forecast.BASELINES | {"model": "predicted"}))
    verdict = {r.baseline: r for r in forecast.verdict(scores, "model").collect()}
    assert set(verdict) == set(forecast.BASELINES) and all(r.model_wins == 1 == r.beats_all_baselines for r in verdict.values())
    band = forecast.residual_band(rows).first()
    residual = [r[TARGET] - r.predicted for r in rows.where("split = 'val'").collect()]
    assert np.allclose([band.low, band.high], np.quantile(residual, [0.1, 0.9])) and band.n == len(residual)


def shop(spark, orders):
    schema = "order_id string, location_id string, business_date date, business_hour int, state string, fulfillment_type string, " \
        "customer_id string, item_quantity double, revenue_cents long, net_sales_cents long, discount_cents long, tax_cents long, " \
        "tip_cents long, service_charge_cents long"
    rows = [(f"o{i}", f"L{p}", d, 12, "COMPLETED", None, None, 1.0, m, m, 0, 0, 0, 0) for i, (p, d, m) in enumerate(orders)]
    days = spark.createDataFrame([(DAY0 + timedelta(days=i),) for i in range(100)], "date date")
    return {
        "orders": spark.createDataFrame(rows, schema), "calendar_days": days,
        "weather": days.withColumn("source", F.lit("archive")),
        "order_items": spark.createDataFrame([("o0",), ("gone",)], "order_id string"),
    }


def test_a_check_that_cannot_run_is_an_error_row_of_its_own(spark, tmp_path):
    tables = shop(spark, [(0, DAY0 + timedelta(days=i), 100) for i in range(70)] + [(0, DAY0, -5), (0, DAY0 + timedelta(days=99), 1)])
    whole = {r.name: r for r in validate.checked_report(tables, DAY0 + timedelta(days=70)).collect()}
    assert len(whole) == 14 == len(validate.CHECKS)
    wrong = {name for name, r in whole.items() if not r.passed}
    assert wrong == {"money non-negative", "no future orders", "no long closures", "line items linked", "daily outliers"}
    missing = {name: df for name, df in tables.items() if name != "order_items"}
    rows = {r.name: r for r in validate.checked_report(missing, DAY0 + timedelta(days=70)).collect()}
    assert {n: r for n, r in rows.items() if n != "line items linked"} == {n: r for n, r in whole.items() if n != "line items linked"}
    lost = rows["line items linked"]
    assert (lost.severity, lost.passed, lost.value) == ("error", 0, None) and "order_items" in lost.detail
    # A table that can be planned but not read fails when it runs; only its own check is lost.
    tables["weather"].write.parquet(f"{tmp_path}/weather")
    tables["weather"] = spark.read.parquet(f"{tmp_path}/weather")
    for file in tmp_path.glob("weather/*.parquet"):
        file.unlink()
    rows = {r.name: r for r in validate.checked_report(tables, DAY0 + timedelta(days=70)).collect()}
    failed = {n for n, r in rows.items() if "could not run" in r.detail}
    assert failed == {"weather coverage", "weather is observed"}
    with pytest.raises(validate.DataQualityError, match="could not run"):
        validate.raise_if_blocked(validate.checked_report(missing, DAY0 + timedelta(days=70)))


def test_trading_days_are_days_not_rows(spark):
    many = shop(spark, [(p, DAY0, 100) for p in range(60)])["orders"]
    with pytest.raises(validate.DataQualityError, match="only 1 days"):
        validate.require_trading_days(many)
    assert validate.require_trading_days(shop(spark, [(0, DAY0 + timedelta(days=i), 1) for i in range(60)])["orders"]) == 60
