"""Numeric model fitting on one series at a time (numpy); Spark runs these in parallel over series, folds and models."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions.calendar import default_lags, tree_windows

# The orders that the search scores, in this order: (p, d, q) and (P, D, Q).
SEASONAL_ORDERS = [((1, 1, 1), (0, 0, 0)), ((1, 1, 0), (0, 0, 0)), ((2, 1, 0), (0, 0, 0)), ((1, 1, 2), (0, 0, 0)), ((0, 1, 1), (1, 0, 0)), ((1, 1, 1), (1, 0, 0)), ((1, 0, 1), (1, 1, 0)), ((2, 1, 1), (1, 1, 0)), ((1, 1, 2), (1, 1, 0))]
PLAIN_ORDERS = [(0, 1, 0), (1, 1, 0), (0, 1, 1), (1, 1, 1), (2, 1, 0), (2, 1, 1), (1, 1, 2), (2, 1, 2), (1, 0, 1), (2, 0, 2)]
PREFERRED_SEASON = {"D": 7, "W": 12, "MS": 12, "M": 12, "QS": 4}
SEASON_LIST = [7, 12, 30, 52, 91, 365]


# ARIMA


def _poly(ar: np.ndarray, lag: int = 1) -> np.ndarray:
    out = np.zeros(len(ar) * lag + 1)
    out[0] = 1
    for k, a in enumerate(ar, 1):
        out[k * lag] = -a
    return out


def _inside(raw: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary polynomial from free numbers (partial autocorrelations by tanh)."""
    part = np.tanh(raw)
    out = np.zeros(0)
    for k, r in enumerate(part):
        out = np.r_[out - r * out[::-1], r] if k else np.array([r])
    return out


def _css(w: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """Residuals after the autoregressive start-up: full AR polynomial ar, MA coefficients ma."""
    lead = len(ar) - 1
    u = np.convolve(w, ar)[lead : len(w)]
    if not len(ma):
        return u
    out, e1, e2 = [], 0.0, 0.0
    m1, m2 = float(ma[0]), float(ma[1]) if len(ma) > 1 else 0.0
    for x in u.tolist():
        e = x - m1 * e1 - m2 * e2
        out.append(e)
        e1, e2 = e, e1
    return np.array(out)


def _difference(y: np.ndarray, d: int, seasonal: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    poly = np.array([1.0])
    for _ in range(d):
        poly = np.convolve(poly, [1, -1])
    for _ in range(seasonal):
        poly = np.convolve(poly, _poly(np.array([1.0]), period))
    return np.convolve(y, poly)[len(poly) - 1 : len(y)], poly


def fit_order(y: np.ndarray, order: tuple[int, int, int], seasonal: tuple[int, int, int] = (0, 0, 0), period: int = 0) -> dict:
    """Conditional least squares of one order: polynomials, variance, residuals and AIC."""
    (p, d, q), (sp, sd, _) = order, seasonal
    w, diff = _difference(y, d, sd, period)
    free = p + q + sp
    mean = w.mean() if d + sd == 0 else 0.0
    w = w - mean
    if len(w) < free + sp * period + p + 10:
        raise ValueError("too short for this order")

    def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ar = np.convolve(_poly(_inside(x[:p])), _poly(_inside(x[p + q :]), period) if sp else np.array([1.0]))
        return ar, -_inside(x[p : p + q]) if q else np.zeros(0)

    def resid(x: np.ndarray) -> np.ndarray:
        return _css(w, *split(x))

    x = np.full(free, 0.1)
    if free:  # Gauss-Newton with damping; a bounded number of rounds instead of a time limit
        r, damp = resid(x), 1e-2
        for _ in range(25):
            jac = np.stack([(resid(x + 1e-5 * e) - r) / 1e-5 for e in np.eye(free)], axis=1)
            step = np.linalg.solve(jac.T @ jac + damp * (np.diag(np.diag(jac.T @ jac)) + 1e-8 * np.eye(free)), jac.T @ r)
            new = np.clip(x - step, -4, 4)
            r2 = resid(new)
            if r2 @ r2 < r @ r:
                gain = 1 - (r2 @ r2) / (r @ r)
                x, r, damp = new, r2, max(damp / 5, 1e-9)
                if gain < 1e-7:
                    break
            else:
                damp *= 10
                if damp > 1e6:
                    break
    ar, ma = split(x)
    r = resid(x)
    var = float(r @ r) / len(r)
    if not np.isfinite(var) or var < 0:
        raise ValueError("no finite variance")
    aic = len(r) * (np.log(2 * np.pi * max(var, 1e-300)) + 1) + 2 * (free + 1 + (mean != 0))
    return {"ar": ar, "ma": ma, "diff": diff, "mean": mean, "var": var, "residuals": r, "aic": float(aic), "order": order, "seasonal_order": (*seasonal, period)}


def arima_season(n: int, frequency: str) -> int:
    p = PREFERRED_SEASON.get(frequency)
    if p and n >= 4 * p:
        return p
    return next((c for c in SEASON_LIST if n >= 4 * c), 0)


def arima_candidates(n: int, frequency: str) -> list[tuple[tuple[int, int, int], tuple[int, int, int], int]]:
    period = arima_season(n, frequency)
    return [(o, s, period) for o, s in SEASONAL_ORDERS] if period else [(o, (0, 0, 0), 0) for o in PLAIN_ORDERS]


def fit_arima(y: np.ndarray, horizon: int, frequency: str = "D") -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """The order of least AIC plus 0.001 for each order; the first wins ties; orders that fail are passed over."""
    best, best_score = None, np.inf
    for order, seasonal, period in arima_candidates(len(y), frequency):
        try:
            m = fit_order(y, order, seasonal, period)
        except (ValueError, np.linalg.LinAlgError):
            continue
        score = m["aic"] + 0.001 * (sum(order) + sum(seasonal))
        if score < best_score:
            best, best_score = m, score
    if best is None:
        best = fit_order(y, (1, 1, 1))
    horizon = max(1, horizon)
    full = np.convolve(best["ar"], best["diff"])
    past, errors = list(y), list(np.r_[np.zeros(2), best["residuals"]][-2:])
    shift = best["mean"] * best["ar"].sum() if best["mean"] else 0.0
    errors = errors[::-1] + []
    e1, e2 = errors[0], errors[1]
    ma = np.r_[best["ma"], np.zeros(2)][:2]
    fc = []
    for h in range(horizon):
        v = -full[1:] @ np.array(past[: -len(full) : -1][: len(full) - 1]) + shift
        v += (ma[0] * e1 + ma[1] * e2) if h == 0 else (ma[1] * e1 if h == 1 else 0.0)
        fc.append(float(v))
        past.append(float(v))
    psi = np.zeros(horizon)
    psi[0] = 1
    for j in range(1, horizon):
        psi[j] = (ma[j - 1] if j <= 2 else 0.0) - full[1 : j + 1] @ psi[j - 1 :: -1][: len(full) - 1]
    half = 1.96 * np.sqrt(best["var"] * np.cumsum(psi**2))
    fc = np.array(fc)
    meta = {k: best[k] for k in ("order", "seasonal_order", "aic", "residuals")}
    meta["label"] = ("SARIMA" if best["seasonal_order"][3] else "ARIMA") + str(best["order"]).replace(" ", "")
    return fc, fc - half, fc + half, meta


# Boosted trees


def calendar_row(day: np.datetime64) -> list[float]:
    """The calendar features of one date, in the order of the feature frame."""
    d = day.astype("datetime64[D]").item()
    iso = d.isocalendar()
    turn = 2 * np.pi
    after = (d.replace(day=28) + np.timedelta64(4, "D").item()).replace(day=1)
    month_days = (after - np.timedelta64(1, "D").item()).day
    wd = d.weekday()
    return [d.year, d.month, (d.month - 1) // 3 + 1, iso[1], wd, d.day, iso[0], iso[2], np.sin(turn * d.month / 12), np.cos(turn * d.month / 12), np.sin(turn * wd / 7), np.cos(turn * wd / 7), np.sin(turn * d.day / 31), np.cos(turn * d.day / 31), float(wd >= 5), float(d.day == 1), float(d.day >= 28), month_days, d.timetuple().tm_yday, iso[1]]


CALENDAR_NAMES = ["year", "month", "quarter", "week", "dayofweek", "dayofmonth", "iso_year", "iso_weekday", "sin_month", "cos_month", "sin_week", "cos_week", "sin_dayofmonth", "cos_dayofmonth", "is_weekend", "is_month_start", "is_month_end", "days_in_month", "day_of_year", "week_of_year"]


def history_row(past: np.ndarray, lags: list[int], windows: list[int]) -> list[float]:
    """Features of what is known before a step: the last values, rolling statistics of the last windows, momentum."""
    n = len(past)
    out = [past[n - k] if n >= k else np.nan for k in lags]
    for w in windows:
        tail = past[max(0, n - w) :]
        ok = len(tail) >= max(1, min(w, 14))
        out += [tail.mean(), tail.std(ddof=1) if len(tail) > 1 else np.nan, tail.min(), tail.max()] if ok else [np.nan] * 4
    w = windows[0]
    if n > w:
        before = past[n - 1 - w : n - 1].mean()
        out.append(past[n - w :].mean() / before - 1 if before else 0.0)
    else:
        out.append(np.nan)
    return out


class Boosted:
    """Gradient boosting of regression trees on binned features (squared loss, seeded row and column sampling)."""

    def __init__(self, n_trees: int = 300, rate: float = 0.05, depth: int = 5, rows: float = 0.8, columns: float = 0.8, bins: int = 32, seed: int = 42):
        self.n_trees, self.rate, self.depth, self.rows, self.columns, self.bins, self.seed = n_trees, rate, depth, rows, columns, bins, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        rng = np.random.default_rng(self.seed)
        n, k = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(k)]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)
        self.base, self.trees, self.reached, self.importance = float(y.mean()), [], [], np.zeros(k)
        pred = np.full(n, self.base)
        for _ in range(self.n_trees):
            use = np.flatnonzero(rng.random(n) < self.rows)
            cols = np.sort(rng.choice(k, max(1, int(round(self.columns * k))), replace=False))
            g, c = (y - pred)[use], len(cols)
            places = binned[use][:, cols] + np.arange(c) * self.bins  # each row's place in a node's histogram, column by column
            feature, cut = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1, int)
            node = np.zeros(n, int)

            def histograms(rows: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
                """Sums and counts (groups x columns x bins) of some of the rows in use."""
                key = (group[:, None] * (c * self.bins) + places[rows]).ravel()
                size, shape = groups * c * self.bins, (groups, c, self.bins)
                return np.bincount(key, np.repeat(g[rows], c), size).reshape(shape), np.bincount(key, minlength=size).reshape(shape)

            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                local = node[use] - first
                if not level:
                    sums, many = histograms(np.arange(len(use)), local, 1)
                else:  # the smaller child is counted, the other is what its parent has more
                    size = np.bincount(local, minlength=width).reshape(-1, 2)
                    small = 2 * np.arange(width // 2) + (size[:, 1] < size[:, 0])
                    rows = np.flatnonzero(small[local // 2] == local)
                    less, few = histograms(rows, local[rows] // 2, width // 2)
                    both, all_ = np.empty((width, c, self.bins)), np.empty((width, c, self.bins), many.dtype)
                    both[small], both[small ^ 1] = less, sums - less
                    all_[small], all_[small ^ 1] = few, many - few
                    both[all_ == 0] = 0  # not what rounding leaves, so empty bins tie
                    sums, many = both, all_
                sl, nl = sums.cumsum(2), many.cumsum(2)
                st, nt = sl[:, :, -1:], nl[:, :, -1:]
                gain = sl**2 / (nl + 1) + (st - sl) ** 2 / (nt - nl + 1) - st**2 / (nt + 1)
                gain[(nl < 1) | (nt - nl < 1)] = 0
                flat = gain.reshape(width, -1)
                best = flat.argmax(1)
                for m in range(width):
                    if flat[m, best[m]] > 1e-9:
                        feature[first + m], cut[first + m] = cols[best[m] // self.bins], best[m] % self.bins
                        self.importance[feature[first + m]] += flat[m, best[m]]
                f = feature[node]
                right = (f >= 0) & (binned[np.arange(n), np.maximum(f, 0)] > cut[node])
                node = 2 * node + 1 + right
            leaf = node - (2**self.depth - 1)
            total, count = np.bincount(leaf[use], g, 2**self.depth), np.bincount(leaf[use], minlength=2**self.depth)
            value = self.rate * total / (count + 1)
            pred += value[leaf]
            self.trees.append((feature, cut, value))
            self.reached.append(np.bincount(leaf, minlength=2**self.depth))
        self.importance /= max(self.importance.sum(), 1e-12)
        self.residuals = y - pred
        return self

    def predict(self, row: np.ndarray) -> float:
        b = [int(np.searchsorted(e, v, "left")) for e, v in zip(self.edges, row)]
        out = self.base
        for feature, cut, value in self.trees:
            node = 0
            for _ in range(self.depth):
                f = feature[node]
                node = 2 * node + 1 + (f >= 0 and b[f] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


def _next_day(day: np.datetime64, frequency: str) -> np.datetime64:
    day = day.astype("datetime64[D]")
    if frequency == "W":
        return day + 7
    months = {"MS": 1, "M": 1, "QS": 3, "Q": 3, "YS": 12}.get(frequency)
    if not months:
        return day + 1
    m = day.astype("datetime64[M]").astype(int)
    return np.datetime64(int(m // months * months + months), "M").astype("datetime64[D]")


@dataclass
class TreeFit:
    """Trees fitted to a series: the model of the scaled target, the complete rows of features, their names, lags and windows."""

    model: Boosted
    x: np.ndarray
    names: list[str]
    lags: list[int]
    windows: list[int]
    mean: float
    std: float


def tree_fit(y: np.ndarray, days: np.ndarray, frequency: str = "D", n_trees: int = 300, compat: bool = False) -> TreeFit:
    windows = tree_windows(frequency)
    lags = [k for k in default_lags(frequency) if len(y) - k >= 30 + windows[-1]] or [1]
    shift = 1 if compat else 0
    rows = [calendar_row(days[i]) + history_row(y[: i + shift], lags, windows) for i in range(len(y))]
    x = np.array(rows, float)
    names = CALENDAR_NAMES + [f"lag_{k}" for k in lags] + [f"rolling_{s}_{w}" for w in windows for s in ("mean", "std", "min", "max")] + ["momentum"]
    full = np.isfinite(x).all(1)
    if full.sum() < 30:
        raise ValueError("fewer than 30 complete rows")
    mean, std = y.mean(), y.std(ddof=1) or 1.0
    return TreeFit(Boosted(n_trees).fit(x[full], (y[full] - mean) / std), x[full], names, lags, windows, mean, std)


def fit_trees(y: np.ndarray, days: np.ndarray, horizon: int, frequency: str = "D", n_trees: int = 300, compat: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """Recursive boosted trees: a step is predicted from the calendar of its own date and what is known before it.

    compat=True pairs a value with features that include it, as older practice did; that leaks the target.
    """
    fitted = tree_fit(y, days, frequency, n_trees, compat)
    model, names, lags, windows, mean, std = fitted.model, fitted.names, fitted.lags, fitted.windows, fitted.mean, fitted.std
    keep = max([*lags, *windows]) + 2
    past, day, fc = list(y[-keep:]), days[-1], []
    for _ in range(horizon):
        upcoming = _next_day(day, frequency)
        row = np.array(calendar_row(day if compat else upcoming) + history_row(np.array(past), lags, windows), float)
        fc.append(model.predict(np.nan_to_num(row)) * std + mean)
        past = [*past[1:], fc[-1]]
        day = upcoming
    fc, sigma = np.array(fc), model.residuals.std() * std
    half = 1.96 * sigma * np.sqrt(np.arange(1, horizon + 1))
    importance = sorted(zip(names, model.importance.tolist()), key=lambda z: -z[1])
    return fc, fc - half, fc + half, {"n_features": len(names), "n_estimators": n_trees, "residual_std": float(sigma), "uncertainty_method": "residual_std", "importance": importance}
