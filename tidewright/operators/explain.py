"""Drivers, importances, the compact summary and the plain-language brief, as expressions over one row per series."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import METRICS

DRIVER = "array<struct<driver:string,signal:string,direction:string>>"
# Headings of the four sections of a brief, in order.
SECTIONS = ("Executive summary", "Drivers", "Risks", "Recommendation")


def _driver(cond: Column, driver: str, signal: Column, direction: Column) -> Column:
    return F.when(cond, F.struct(F.lit(driver).alias("driver"), signal.alias("signal"), direction.alias("direction")))


def driver_list(trend_direction: Column, slope_pct: Column, detected: Column, season: Column, strength: Column, level: Column, recent: Column | None = None, mean: Column | None = None) -> Column:
    """Trend, season (if detected), volatility, and where asked for the recent value against the mean.

    Rising volatility counts as negative, else it is neutral, and so is the recent value.  In the short list a season is
    always positive, in the list with the recent value only a strong one.
    """
    sign = F.when(trend_direction == "increasing", "positive").when(trend_direction == "decreasing", "negative").otherwise("neutral")
    items = [
        _driver(F.lit(True), "trend", F.format_string("%s, %.4f%% of the mean per period", trend_direction, F.coalesce(slope_pct, F.lit(0.0))), sign),
        _driver(F.coalesce(detected, F.lit(False)), "seasonality", F.format_string("%s season, strength %.3f", season, strength), F.lit("positive") if recent is None else F.when(strength > 0.3, "positive").otherwise("neutral")),
        _driver(F.lit(True), "volatility", F.format_string("volatility is %s", level), F.when(level == "increasing", "negative").otherwise("neutral")),
    ]
    if recent is not None and mean is not None:
        items.append(_driver(recent.isNotNull(), "recent value", F.format_string("%.2f against a mean of %.2f", recent, mean), F.lit("neutral")))
    return F.array_compact(F.array(*items)).cast(DRIVER)


def explain(trend: DataFrame, seasonality: DataFrame, volatility: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """series_id, drivers, caveats."""
    s = seasonality.select("series_id", "detected", "seasonality_type", "strength")
    out = trend.select("series_id", "direction", "slope_pct").join(s, "series_id", "left").join(volatility.select("series_id", "level"), "series_id", "left")
    recent = mean = None
    if stats is not None:
        out = out.join(stats.select("series_id", "recent", "mean"), "series_id", "left")
        recent, mean = F.col("recent"), F.col("mean")
    drivers = driver_list(F.col("direction"), F.col("slope_pct"), F.col("detected"), F.col("seasonality_type"), F.col("strength"), F.col("level"), recent, mean)
    caveats = F.array_compact(F.array(F.lit("Drivers describe past association, not cause."), F.when(F.col("level") == "increasing", F.lit("Volatility is rising, so the range may be too narrow."))))
    return out.select("series_id", drivers.alias("drivers"), caveats.alias("caveats"))


def top_importances(importances: DataFrame, most: int = 15) -> DataFrame:
    """The `most` most important features of each series (a top-k report): series_id, feature, importance, rank."""
    ranked = importances.selectExpr("*", "row_number() over (partition by series_id order by importance desc, feature) as rank")
    return ranked.where(F.col("rank") <= most)


def structured_input(leaderboard: DataFrame, change: DataFrame, means: DataFrame, trend: DataFrame, seasonality: DataFrame, drivers: DataFrame, quality: DataFrame, horizon: int, ends: DataFrame, volatility: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One compact row per series for the brief: best model with its five metrics (an equal join on its name), forecast, range, trend,
    season and volatility with their numbers, anomalies, up to six drivers, quality.  ends: see horizon_ends."""
    best = leaderboard.where("is_best").select("series_id", F.col("model").alias("best_model"), *METRICS)
    q = quality.select("series_id", F.col("score").alias("quality_score"), F.try_element_at("issues", F.lit(1)).getField("message").alias("first_issue"), (F.col("missing_targets") + F.col("unparsed_targets")).alias("missing_values"), F.col("outliers").alias("outlier_count"))
    out = best.join(change, "series_id").join(means, "series_id")
    parts = [
        ends,
        trend.select("series_id", F.col("direction").alias("trend"), *[F.col(c).alias(f"trend_{c}") for c in ("slope", "slope_pct", "p_value")]),
        seasonality.select("series_id", "detected", "seasonality_type", "period", "strength"),
        volatility.select("series_id", F.col("level").alias("volatility"), *[F.col(c).alias(f"volatility_{c}") for c in ("overall", "early", "recent", "ratio")]),
        anomalies.select("series_id", F.col("count").alias("anomaly_count")),
        drivers.select("series_id", F.slice("drivers", 1, 6).alias("drivers")),
        q,
    ]
    for part in parts:
        out = out.join(part, "series_id", "left")
    return out.withColumn("horizon", F.lit(horizon))


def brief(summary: DataFrame) -> DataFrame:
    """The four texts of a rule-based brief: executive_summary, drivers_text, risks, recommendation."""
    pct = F.format_string("%.1f%%", F.abs(F.coalesce("percent", F.lit(0.0))))
    verb = F.when(F.col("direction") == "increase", "rise by " ).when(F.col("direction") == "decrease", "fall by ")
    outlook = F.when(verb.isNull(), F.lit("is expected to stay about level")).otherwise(F.concat(F.lit("is expected to "), verb, pct))
    head = F.concat(F.lit("Over the next "), F.col("horizon").cast("string"), F.lit(" periods the target "), outlook, F.lit(", between "), F.format_string("%.0f", "mean_lower"), F.lit(" and "), F.format_string("%.0f", "mean_upper"), F.lit(" on average. The forecast comes from "), F.col("best_model"), F.coalesce(F.format_string(", whose error in backtests was %.1f%%", "smape"), F.lit("")), F.lit("."))
    names = lambda d: F.array_join(F.transform(F.filter("drivers", lambda x: x["direction"] == d), lambda x: x["driver"]), ", ")
    plus, minus = names("positive"), names("negative")
    drivers = F.concat_ws(" ", F.when(plus != "", F.concat(F.lit("Pushing up: "), plus, F.lit("."))), F.when(minus != "", F.concat(F.lit("Pulling down: "), minus, F.lit("."))), F.when((plus == "") & (minus == ""), F.lit("No strong driver stands out.")), F.when(F.coalesce("detected", F.lit(False)), F.concat(F.lit("The series has a "), F.col("seasonality_type"), F.lit(" season."))))
    wide = F.abs(F.try_divide(F.col("mean_upper") - F.col("mean_lower"), F.col("mean_yhat"))) > 0.5
    risks = F.concat_ws(" ", F.format_string("Data quality scores %d of 100.", F.col("quality_score")), F.when(F.col("first_issue").isNotNull(), F.concat(F.lit("First issue: "), F.col("first_issue"), F.lit("."))), F.when(wide, F.lit("The range is wide, so plans need slack.")))
    action = F.when(F.col("direction") == "increase", F.lit("Prepare for higher demand and check capacity early.")).when(F.col("direction") == "decrease", F.lit("Plan for lower demand and avoid excess stock.")).otherwise(F.lit("Keep the present plan and watch for change."))
    recommend = F.concat(action, F.lit(" Plan for values from "), F.format_string("%.0f", "mean_lower"), F.lit(" to "), F.format_string("%.0f", "mean_upper"), F.lit("."))
    return summary.select("series_id", head.alias("executive_summary"), drivers.alias("drivers_text"), risks.alias("risks"), recommend.alias("recommendation"), F.lit("rules").alias("generated_by"))


def parse_sections(text: str) -> dict[str, str]:
    """Split a text by the section headings (any case, with or without # or * marks); without headings all of it is the summary."""
    names = "|".join(map(re.escape, SECTIONS))
    hits = list(re.finditer(rf"(?im)^[#*\s]*({names})[*:\s]*$", text))
    if not hits:
        return {SECTIONS[0]: text.strip()}
    ends = [h.start() for h in hits[1:]] + [len(text)]
    known = {s.lower(): s for s in SECTIONS}
    return {known[h[1].lower()]: text[h.end() : e].strip() for h, e in zip(hits, ends)}


def generate(summary: DataFrame, interpreter: Callable[[str], str] | None = None, enabled: bool = False) -> DataFrame:
    """The rule-based brief, or an external interpreter's sections for each series where one is given and enabled.

    The interpreter gets a series' summary as JSON.  A failure keeps the rules' texts and is told in llm_error.  It is called
    row by row, since it is a callable for one series that takes far longer than a row's way to Python.
    """
    rules = brief(summary).withColumn("llm_error", F.lit(None).cast("string"))
    if interpreter is None or not enabled:
        return rules
    keys = ["executive_summary", "drivers_text", "risks", "recommendation"]

    @F.udf("struct<texts:map<string,string>,error:string>")
    def ask(payload: str):
        try:
            return {"texts": dict(zip(keys, (parse_sections(interpreter(payload)).get(s) for s in SECTIONS))), "error": None}
        except Exception as e:
            return {"texts": None, "error": str(e)[:200]}

    asked = summary.select("series_id", ask(F.to_json(F.struct(*summary.columns))).alias("x"))
    out = rules.drop("llm_error").join(asked, "series_id")
    for k in keys:
        out = out.withColumn(k, F.coalesce(F.try_element_at("x.texts", F.lit(k)), F.col(k)))
    return out.withColumn("generated_by", F.when(F.col("x.error").isNull(), "interpreter").otherwise("rules")).withColumn("llm_error", F.col("x.error")).drop("x")
