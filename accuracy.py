"""The accuracy table of the README: all models on the generated sample, four expanding folds, ranked by sMAPE."""

from pyspark.sql import functions as F

from tidewright.operators import backtest
from tidewright.series import to_series
from tidewright.session import local_session
from tidewright.sources.readers import business_demand


def main() -> None:
    spark = local_session()
    series = to_series(business_demand(spark), F.col("date"), F.col("target")).persist()
    backtest.backtest(series, "D")["leaderboard"].orderBy("rank").select("rank", "model", "smape", "mae", "rmse", "wape", "n_folds_valid").show(truncate=False)


if __name__ == "__main__":
    main()
