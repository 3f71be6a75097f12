import datetime as dt

import pytest

from helpers import dates, linear, rows, series
from tidewright.errors import ValidationError
from tidewright.operators import clean, validate


def raw(spark, n=100, **changes):
    data = [(str(d), str(round(v, 4)), k) for k, (d, v) in enumerate(zip(dates(n), linear(n, 1.0)))]
    for k, row in changes.get("set", {}).items():
        data[k] = row
    data += changes.get("add", [])
    return spark.createDataFrame(data, "date string, target string, seq int")


def report(df, **options):
    return df and rows(validate.quality_report(df, seq_col="seq", **options))[0]


def test_clean_series_scores_full(spark):
    r = report(raw(spark))
    assert r["score"] == 100 and r["is_valid"] and r["frequency"] == "D" and r["issues"] == []


@pytest.mark.parametrize("step,label", [(1, "D"), (7, "W"), (30, "MS"), (91, "QS"), (365, "YS"), (3, "IR")])
def test_frequency_labels(spark, step, label):
    assert rows(validate.detect_frequency(series(spark, range(12), days=dates(12, step))))[0]["frequency"] == label


def test_frequency_of_one_row_is_irregular(spark):
    assert rows(validate.detect_frequency(series(spark, [1])))[0]["frequency"] == "IR"


def test_missing_duplicate_outlier_negative(spark):
    d = dates(100)
    r = report(raw(spark, set={5: (str(d[5]), None, 5), 20: (str(d[20]), "100000", 20), 10: (str(d[10]), "-50", 10)}, add=[(str(d[30]), "1.0", 200)]), allow_negative=False)
    assert r["missing_targets"] == 1 and r["duplicates"] == 1 and r["outliers"] >= 1 and r["negatives"] == 1
    assert not r["is_valid"] and r["score"] <= 50
    assert [i["category"] for i in r["issues"]] == ["duplicates", "missing", "negative", "outliers"]


def test_unparsable_targets_are_counted_apart(spark):
    d = dates(100)
    r = report(raw(spark, set={k: (str(d[k]), "x", k) for k in range(6)}))
    assert r["unparsed_targets"] == 6 and r["missing_targets"] == 0 and r["n"] == 94


def test_all_dates_bad_is_empty(spark):
    r = report(raw(spark, n=3, set={k: ("nope", "1", k) for k in range(3)}))
    assert r["score"] == 0 and not r["is_valid"] and r["n"] == 0


def test_keep_last_and_order(spark):
    d = dates(100)
    out = rows(clean.preprocess(raw(spark, add=[(str(d[7]), "7.5", 500), ("bad", "1", 501)]), seq_col="seq"), "ts")
    assert len(out) == 100 and out[7]["y"] == 7.5
    assert [r["ts"].date() for r in out] == d


def test_nan_and_infinity_are_missing(spark):
    df = spark.createDataFrame([(dt.date(2022, 1, 1), float("nan")), (dt.date(2022, 1, 2), float("inf")), (dt.date(2022, 1, 3), 1.0)], "date date, target double")
    assert len(rows(clean.preprocess(df))) == 1


def test_required_columns(spark):
    with pytest.raises(ValidationError):
        clean.preprocess(spark.createDataFrame([(1,)], "x int"))


def test_cleaning_log_counts(spark):
    d = dates(100)
    r = rows(clean.cleaning_log(raw(spark, add=[(str(d[7]), "7.5", 500), ("bad", "1", 501)])))[0]
    assert (r["rows_in"], r["bad_dates"], r["duplicates"], r["null_targets"], r["rows_out"]) == (102, 1, 1, 0, 100)


def test_constant_series_and_flat_quartiles(spark):
    df = series(spark, [5.0] * 40).withColumnsRenamed({"ts": "date", "y": "target"})
    r = rows(validate.quality_report(df))[0]
    assert r["constant"] and r["outliers"] == 0 and r["score"] == 80


def test_gap_heuristic(spark):
    days = [d for k, d in enumerate(dates(100)) if k % 5]
    df = series(spark, linear(len(days)), days=days).withColumnsRenamed({"ts": "date", "y": "target"})
    r = rows(validate.quality_report(df))[0]
    assert r["frequency"] == "D" and r["missing_days"] == r["coverage_days"] - 80
