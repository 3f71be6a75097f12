"""Series made for the tests."""

import datetime as dt

import numpy as np

DAY0 = dt.date(2022, 1, 1)


def dates(n, step=1, start=DAY0):
    return [start + dt.timedelta(days=step * k) for k in range(n)]


def series(spark, values, series_id="a", days=None):
    days = days or dates(len(values))
    return spark.createDataFrame([(series_id, d, None if v is None else float(v)) for d, v in zip(days, values)], "series_id string, ts date, y double")


def linear(n, slope=0.3, noise=4.0, season=0.0, seed=7):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return 100 + slope * t + season * np.sin(2 * np.pi * t / 7) + rng.normal(0, noise, n)


def rows(df, *keys):
    out = [r.asDict() for r in df.collect()]
    return sorted(out, key=lambda r: tuple(r[k] for k in keys)) if keys else out
