"""Forecasts with a season: additive Holt-Winters per key, fitted by grid, with intervals and a back-test.

Rows are counted per key and period first; a key is then one short series, whose length is the number of periods
and not of rows. Periods without rows count 0, from the first to the last period of all keys. Smoothing:

    level  = alpha (y - season) + (1 - alpha) (level + trend)
    trend  = beta (level - level before) + (1 - beta) trend
    season = gamma (y - level) + (1 - gamma) season

starting from the mean of the first season, the mean change between the first two, and the differences from that mean.
The parameters are those of the grid with the smallest sum of squared one-step errors after the first two
seasons, the first by alpha, beta, gamma if several agree. The interval around a forecast comes from the quantiles of the
errors of the same lead in the series; it widens no further than they do. A series of fewer than two seasons gets its mean and
no trend.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRID = (0.05, 0.2, 0.4, 0.7)
COVER = 0.9
HOUR, DAY = 3600, 86_400


def series(logs: DataFrame, key: str, step: int = HOUR) -> DataFrame:
    """``key, at, n``: rows per key and period of ``step`` seconds, with zeros where there are none."""
    period = F.floor(F.unix_timestamp("timestamp") / step).cast("long")
    counted = logs.filter(F.col("timestamp").isNotNull()).groupBy(key, period.alias("at")).agg(F.count("*").alias("n"))
    ends = counted.agg(F.min("at").alias("low"), F.max("at").alias("high"))  # one row
    grid = counted.select(key).distinct().join(F.broadcast(ends)).select(key, F.explode(F.sequence("low", "high")).alias("at"))
    joined = grid.join(counted.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")) & (grid["at"] == counted["at"]), "left")
    return joined.select(key, grid["at"], F.coalesce("n", F.lit(0)).alias("n"))


def smooth(y: np.ndarray, season: int, alpha: float, beta: float, gamma: float):
    """One-step forecasts of ``y``, and level, trend and seasons after its end."""
    first = y[:season].mean()
    level, trend = first, (y[season : 2 * season].mean() - first) / season
    seasons = list(y[:season] - first)
    ahead = np.empty(len(y))
    for t, value in enumerate(y):
        s = seasons[t % season]
        ahead[t] = level + trend + s
        before = level
        level = alpha * (value - s) + (1 - alpha) * (level + trend)
        trend = beta * (level - before) + (1 - beta) * trend
        seasons[t % season] = gamma * (value - level) + (1 - gamma) * s
    return ahead, level, trend, seasons


def _smooth_all(y: np.ndarray, season: int, grid: np.ndarray) -> np.ndarray:
    """Sums of squared one-step errors for all rows ``alpha, beta, gamma`` of ``grid`` at once."""
    a, b, g = grid.T
    first = y[:season].mean()
    level, trend = np.full(len(grid), first), np.full(len(grid), (y[season : 2 * season].mean() - first) / season)
    seasons = np.repeat((y[:season] - first)[:, None], len(grid), axis=1)
    wrong = np.zeros(len(grid))
    for t, value in enumerate(y):
        s = seasons[t % season].copy()
        if t >= 2 * season:
            wrong += (value - (level + trend + s)) ** 2
        before = level
        level = a * (value - s) + (1 - a) * (level + trend)
        trend = b * (level - before) + (1 - b) * trend
        seasons[t % season] = g * (value - level) + (1 - g) * s
    return wrong


def fit(y: np.ndarray, season: int, grid: tuple[float, ...] = GRID) -> tuple[float, float, float]:
    rows = np.array(list(itertools.product(grid, repeat=3)))
    wrong = _smooth_all(y, season, rows)
    # Sums that differ by rounding alone agree.
    return tuple(rows[np.flatnonzero(wrong <= wrong.min() * (1 + 1e-12) + 1e-12)[0]])


def predict(y: np.ndarray, season: int, ahead: int, cover: float = COVER) -> pd.DataFrame:
    """``lead, forecast, low, high`` and the parameters, for the ``ahead`` periods after ``y``."""
    lead = np.arange(1, ahead + 1)
    if len(y) < 2 * season:
        mean = np.full(ahead, y.mean())
        spread = np.quantile(y - y.mean(), [(1 - cover) / 2, (1 + cover) / 2])
        return pd.DataFrame({"lead": lead, "forecast": mean, "low": mean + spread[0], "high": mean + spread[1],
                             "alpha": np.nan, "beta": np.nan, "gamma": np.nan})
    params = fit(y, season)
    _, level, trend, seasons = smooth(y, season, *params)
    value = np.array([level + k * trend + seasons[(len(y) + k - 1) % season] for k in lead])
    errors = _lead_errors(y, season, params, ahead)
    low, high = (np.array([np.quantile(e, q) if len(e) else 0.0 for e in errors]) for q in ((1 - cover) / 2, (1 + cover) / 2))
    return pd.DataFrame({"lead": lead, "forecast": value, "low": value + low, "high": value + high,
                         "alpha": params[0], "beta": params[1], "gamma": params[2]})


def _lead_errors(y: np.ndarray, season: int, params, ahead: int) -> list[np.ndarray]:
    """Errors of forecasts made inside the series, by lead, from the second season on."""
    alpha, beta, gamma = params
    first = y[:season].mean()
    level, trend = first, (y[season : 2 * season].mean() - first) / season
    seasons = list(y[:season] - first)
    out: list[list[float]] = [[] for _ in range(ahead)]
    for t, value in enumerate(y):
        s = seasons[t % season]
        before = level
        level = alpha * (value - s) + (1 - alpha) * (level + trend)
        trend = beta * (level - before) + (1 - beta) * trend
        seasons[t % season] = gamma * (value - level) + (1 - gamma) * s
        if t >= 2 * season - 1:
            for k in range(1, min(ahead, len(y) - 1 - t) + 1):
                out[k - 1].append(y[t + k] - (level + k * trend + seasons[(t + k) % season]))
    return [np.array(e) for e in out]


_SHAPE = "at bigint, lead bigint, forecast double, low double, high double, alpha double, beta double, gamma double"


def _per_key(counted: DataFrame, key: str, shape: str, work) -> DataFrame:
    kind = counted.schema[key].dataType.simpleString()

    def run(keys, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        found = work(pdf["n"].to_numpy(dtype=float), int(pdf["at"].iloc[-1]))
        found.insert(0, key, keys[0])
        return found

    return counted.groupBy(key).applyInPandas(run, f"{key} {kind}, {shape}")


def forecast(logs: DataFrame, key: str = "service_name", season: int = 24, ahead: int = 24, step: int = HOUR,
             cover: float = COVER) -> DataFrame:
    """``key, period, lead, forecast, low, high, alpha, beta, gamma`` for the ``ahead`` periods after the last."""

    def work(y: np.ndarray, last: int) -> pd.DataFrame:
        out = predict(y, season, ahead, cover)
        out.insert(0, "at", last + out["lead"])
        return out

    found = _per_key(series(logs, key, step), key, _SHAPE, work)
    return found.withColumn("period", F.timestamp_seconds(F.col("at") * step)).drop("at")


def back_test(logs: DataFrame, key: str = "service_name", season: int = 24, ahead: int = 24, step: int = HOUR) -> DataFrame:
    """``key, season_error, trend_error, covered``: mean absolute errors over the last ``ahead`` periods of a forecast made
    before them and of a straight line through the periods before, and the share of periods inside the interval."""

    def work(y: np.ndarray, last: int) -> pd.DataFrame:
        seen, real = y[:-ahead], y[-ahead:]
        if len(seen) < 2:
            return pd.DataFrame({"season_error": [np.nan], "trend_error": [np.nan], "covered": [np.nan]})
        out = predict(seen, season, ahead)
        slope, base = np.polyfit(np.arange(len(seen)), seen, 1)
        line = base + slope * np.arange(len(seen), len(y))
        inside = (real >= out["low"].to_numpy()) & (real <= out["high"].to_numpy())
        return pd.DataFrame({
            "season_error": [np.abs(real - out["forecast"].to_numpy()).mean()], "trend_error": [np.abs(real - line).mean()],
            "covered": [inside.mean()],
        })

    return _per_key(series(logs, key, step), key, "season_error double, trend_error double, covered double", work)
