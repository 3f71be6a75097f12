import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import rows
from tidewright.errors import InsufficientHistory, LoadError, UnknownDataset
from tidewright.operators import explain
from tidewright.plans import pipeline
from tidewright.sources import readers
from tidewright.streaming import live

FAST = {"n_trees": 20, "horizon": 14}


@pytest.fixture(scope="module")
def result(spark):
    return pipeline.run(spark, readers.business_demand(spark, n_days=240, seed=1), pipeline.PipelineConfig(**FAST))


def test_end_to_end(result):
    fc = rows(result.forecast, "h")
    assert len(fc) == 14 and all(r["lower"] <= r["yhat"] <= r["upper"] for r in fc)
    assert [r["ds"] - fc[0]["ds"] for r in fc] == [dt.timedelta(days=k) for k in range(14)]
    assert {r["model"] for r in rows(result.leaderboard)} == {"naive", "seasonal_naive", "ets", "arima", "xgboost"}
    b = rows(result.brief)[0]
    assert all(b[k] for k in ("executive_summary", "drivers_text", "risks", "recommendation")) and b["generated_by"] == "rules"


def test_raw_defects_reach_the_report(spark):
    df = readers.business_demand(spark, n_days=120, seed=3).withColumn("target", F.when(F.col("date") == "2021-01-06", None).otherwise(F.col("target")))
    out = pipeline.run(spark, df, pipeline.PipelineConfig(include_xgboost=False, **FAST))
    assert rows(out.quality)[0]["missing_targets"] == 1


def test_many_series_and_short_ones(spark):
    df = readers.business_demand(spark, n_days=90, n_series=2).where("not (series_id = 'series_1' and date >= '2021-01-21')")
    out = pipeline.run(spark, df, pipeline.PipelineConfig(series_col="series_id", include_xgboost=False, **FAST))
    assert [r["series_id"] for r in rows(out.skipped)] == ["series_1"]
    assert {r["series_id"] for r in rows(out.forecast)} == {"series_0"}


def test_too_short_raises(spark):
    with pytest.raises(InsufficientHistory):
        pipeline.run(spark, readers.business_demand(spark, n_days=20))


@pytest.mark.parametrize("bad", [{"horizon": 0}, {"folds": 11}, {"train_frac": 0.99}, {"metric": "r2"}])
def test_config_ranges(bad):
    with pytest.raises(ValueError):
        pipeline.PipelineConfig(**bad)


def test_generator_repeats(spark):
    a, b = rows(readers.business_demand(spark, 60), "date"), rows(readers.business_demand(spark, 60).repartition(3), "date")
    assert a == b and min(r["target"] for r in a) >= 100
    assert rows(readers.business_demand(spark, 60, seed=7), "date") != a


def test_sources(spark, tmp_path):
    df = readers.business_demand(spark, 40)
    readers.write_csv(df, f"{tmp_path}/one.csv", single=True)
    assert rows(readers.load(spark, f"{tmp_path}/one.csv"), "date") == rows(df, "date")
    readers.write_json(df, f"{tmp_path}/x.json")
    assert readers.load(spark, f"{tmp_path}/x.json").count() == 40
    assert readers.load(spark, {"a": [1, 2], "b": ["x", "y"]}).count() == 2
    assert readers.load(spark).count() == 1095
    for bad in (f"{tmp_path}/none.csv", f"{tmp_path}/x.unknown", 5, {"a": [1], "b": []}):
        with pytest.raises(LoadError):
            readers.load(spark, bad).count()
    assert readers.ensure_sample(spark, f"{tmp_path}/sample").count() == readers.ensure_sample(spark, f"{tmp_path}/sample").count() == 1095


def test_catalogue_and_service_functions(spark, tmp_path):
    readers.write_csv(readers.business_demand(spark, 60), f"{tmp_path}/up.csv", single=True)
    assert pipeline.register_dataset(spark, f"{tmp_path}/up.csv") == "up" and "up" in pipeline.list_datasets(spark)
    assert rows(pipeline.validate_dataset(spark, "up"))[0]["score"] > 80
    assert rows(pipeline.explore_dataset(spark, "up"))[0]["trend"]
    assert {r["model"] for r in rows(pipeline.train_summary(spark, "up", models=("naive", "ets")))} == {"naive", "ets"}
    c = pipeline.PipelineConfig(include_xgboost=False, frequency="D", folds=1, **FAST)
    assert len(rows(pipeline.evaluate(spark, "up", c))) == 4
    assert rows(pipeline.recommend(spark, "up", c))[0]["recommendation"]
    with pytest.raises(UnknownDataset):
        pipeline.validate_dataset(spark, "nothing")
    spark.createDataFrame([], "date date, target double").write.option("header", True).csv(f"{tmp_path}/empty.csv")
    readers.put(spark, "tiny", readers.business_demand(spark, 35))
    with pytest.raises(InsufficientHistory):
        pipeline.evaluate(spark, "tiny", c)
    assert readers.drop(spark, "tiny") and pipeline.health() == {"status": "ok"}


def test_column_inference(spark):
    df = spark.createDataFrame([("x", "2024-01-01", 1, 2.0), ("y", "2024-01-02", 2, 3.0)], "name string, when string, n int, sales double")
    assert readers.infer_columns(df)[:2] == ("when", "n")
    assert readers.infer_columns(df, target_col="sales")[1] == "sales"
    assert readers.infer_columns(df.withColumnRenamed("when", "order_day"), strategy="name")[:2] == ("order_day", "sales")


def test_sections_and_interpreter(spark, result):
    text = "## Executive summary\nUp.\n**Drivers**\nTrend.\n# risks\nNone.\nRecommendation:\nGo."
    assert explain.parse_sections(text) == {"Executive summary": "Up.", "Drivers": "Trend.", "Risks": "None.", "Recommendation": "Go."}
    assert explain.parse_sections("just text") == {"Executive summary": "just text"}
    ok = rows(explain.generate(result.summary, lambda payload: text, enabled=True))[0]
    assert ok["generated_by"] == "interpreter" and ok["recommendation"] == "Go."

    def broken(payload):
        raise RuntimeError("offline")

    failed = rows(explain.generate(result.summary, broken, enabled=True))[0]
    assert failed["generated_by"] == "rules" and failed["llm_error"] == "offline" and failed["executive_summary"]
    assert rows(explain.generate(result.summary, lambda p: text))[0]["generated_by"] == "rules"


def test_stream_equals_batch(spark, tmp_path):
    data = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=17 * k), float(k)) for k in range(200)]
    df = spark.createDataFrame(data, "event_id long, ts timestamp, value double")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = live.bucket_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    live.run_available(stream, f"{tmp_path}/check", lambda batch, k: batch.write.mode("append").parquet(f"{tmp_path}/out"))
    got = {(r["ts"], r["y"], r["n"]) for r in rows(spark.read.parquet(f"{tmp_path}/out"))}
    want = {(r["ts"], r["y"], r["n"]) for r in rows(live.bucket_stream(df))}
    assert got <= want and len(want - got) <= 4  # the last buckets wait for the watermark
