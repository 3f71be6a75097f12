"""Sources, sinks, column inference, the sample generator and the dataset catalogue."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LoadError
from .catalogue import Catalogue
from .workbook import read_workbook

# Column names that are taken for dates, and words in names of targets.
DATE_NAMES = ("date", "datetime", "timestamp", "time", "ds", "day", "period")
DATE_WORDS, TARGET_WORDS = ("date", "time", "day"), ("target", "value", "demand", "sales")
SAMPLE = "sample"
PREFIX = "dataset_"


def load_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, **options) -> DataFrame:
    """A CSV file with a header; give a schema for large files, else the types are inferred by a second pass."""
    try:
        reader = spark.read.option("header", True).options(**options)
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    except Exception as e:
        raise LoadError(f"cannot read {path}: {str(e)[:200]}") from e


def load(spark: SparkSession, source: DataFrame | dict | list | str | Path | None = None, **options) -> DataFrame:
    """A DataFrame as it is, columns from a dict, rows from a list, a file by its suffix, or the sample."""
    if source is None:
        return resolve(spark, None)
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, dict):
        names = list(source)
        if len({len(v) for v in source.values()}) > 1:
            raise LoadError("columns differ in length")
        return spark.createDataFrame(list(zip(*source.values())), names)
    if isinstance(source, list):
        return spark.createDataFrame(source)
    if isinstance(source, (str, Path)):
        path = str(source)
        kind = path.rsplit(".", 1)[-1].lower()
        if kind in ("csv", "txt"):
            return load_csv(spark, path, **options)
        if kind in ("parquet", "orc", "json"):
            try:
                return spark.read.options(**options).format(kind).load(path)
            except Exception as e:
                raise LoadError(f"cannot read {path}: {str(e)[:200]}") from e
        if kind == "xlsx":
            return load_excel(spark, path, **options)
    raise LoadError(f"cannot load from {type(source).__name__}")


def load_excel(spark: SparkSession, path: str, **options) -> DataFrame:
    """The first sheet of a workbook, in tasks of row ranges (see workbook)."""
    try:
        return read_workbook(spark, path, **options)
    except Exception as e:
        raise LoadError(f"cannot read {path}: {str(e)[:200]}") from e


def upload(spark: SparkSession, path: str, name: str | None = None) -> str:
    """Read a file, refuse an empty one, register it under the name or the file's stem; returns the name."""
    df = load(spark, path)
    if df.isEmpty():
        raise LoadError("the file has no rows")
    name = name or Path(path).stem
    put(spark, name, df)
    return name


def infer_columns(df: DataFrame, date_col: str | None = None, target_col: str | None = None, strategy: str = "values") -> tuple[str | None, str | None, list[str]]:
    """(date column, target column, numeric candidates).  Explicit names win.

    values: a well-known name, else a timestamp or text column whose first 50 values all parse as dates; the first numeric
    column is the target.  name: by words in the names.
    """
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    if strategy == "name":
        date = date_col or next((c for c in df.columns if any(w in c.lower() for w in DATE_WORDS)), None)
        named = [c for c in numeric if any(w in c.lower() for w in TARGET_WORDS)]
        floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
        return date, target_col or next(iter([*named, *floats]), None), numeric
    date = date_col or next((c for c in df.columns if c.lower() in DATE_NAMES), None)
    if date is None:
        texts = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))]
        if texts:
            head = df.select(*texts).limit(50)  # what the inference looks at
            ok = head.agg(*[F.coalesce(F.every(F.try_to_timestamp(F.col(c).cast("string")).isNotNull()), F.lit(False)).alias(c) for c in texts]).first()
            date = next((c for c in texts if ok[c]), None)
    target = target_col or next((c for c in numeric if c != date), None)
    return date, target, numeric


def business_demand(spark: SparkSession, n_days: int = 1095, start: str = "2021-01-01", seed: int = 42, base: float = 800.0, trend_per_year: float = 120.0, noise_scale: float = 55.0, anomaly_prob: float = 0.015, n_series: int = 1) -> DataFrame:
    """date, target (and series_id): trend, yearly and weekly season, day-of-month wave, November promotion, noise, anomalies.

    Random numbers are hashes of seed, series and day, so any partitioning gives the same rows.
    """
    bits = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "s", "i", F.lit(k))), 1, 13), 16, 10)
    u = lambda k: (bits(k).cast("double") + 0.5) / float(1 << 52)
    rows = spark.range(n_days * n_series).select((F.col("id") % n_days).alias("i"), F.floor(F.col("id") / n_days).alias("s"))
    rows = rows.withColumn("date", F.date_add(F.lit(start).cast("date"), F.col("i").cast("int")))
    # Sizes, phases and periods of the waves
    weekly = F.when(F.weekday("date") < 5, 40 * F.sin(F.weekday("date") * F.pi() / 5) + 30).otherwise(-120.0)
    noise = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * F.pi() * u(2)) * noise_scale
    smooth = base + trend_per_year * F.col("i") / 365.0 + 140 * F.sin(2 * F.pi() * F.col("i") / 365.0 + 1.0) + weekly + 25 * F.sin(2 * F.pi() * (F.dayofmonth("date") - 1) / 30.0) + F.when(F.month("date") == 11, 180.0).otherwise(0.0)
    value = F.greatest(smooth + noise, F.lit(100.0))
    shock = F.when(u(3) < anomaly_prob, F.when(u(4) < 0.5, -1.0).otherwise(1.0) * (250 + 250 * u(5))).otherwise(0.0)
    out = rows.withColumn("target", F.round(F.greatest(value + shock, F.lit(100.0)), 2))
    return out.select("date", "target") if n_series == 1 else out.select(F.concat(F.lit("series_"), "s").alias("series_id"), "date", "target")


#: Spark's own formats of CSV end at the millisecond, and its writer trims texts.
AS_IT_IS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """A CSV file with a header; times keep their microseconds and texts the white space at their ends."""
    (df.coalesce(1) if single else df).write.mode("overwrite").options(header=True, **AS_IT_IS).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def ensure_sample(spark: SparkSession, path: str) -> DataFrame:
    """The sample as a CSV file, written once."""
    business_demand(spark).write.mode("ignore").option("header", True).csv(path)
    return load_csv(spark, path, "date date, target double")


# The catalogue of named datasets: views of the session, and the durable ones of the shared folder


def _view(name: str) -> str:
    return PREFIX + re.sub(r"\W", "_", name)


def put(spark: SparkSession, name: str, df: DataFrame, durable: bool = False) -> None:
    """Name df in this session; durable: write it as the next version of a dataset that outlives the session (see Catalogue)."""
    if durable:
        Catalogue(spark).put(name, df)
    else:
        df.createOrReplaceTempView(_view(name))


def get(spark: SparkSession, name: str) -> DataFrame:
    """A dataset of the session, else the latest version of a durable one."""
    if spark.catalog.tableExists(_view(name)):
        return spark.table(_view(name))
    return Catalogue(spark).get(name)


def drop(spark: SparkSession, name: str) -> bool:
    """Forget a dataset of the session, else drop a durable one."""
    return spark.catalog.dropTempView(_view(name)) or Catalogue(spark).drop(name)


def list_datasets(spark: SparkSession) -> list[str]:
    own = {t.name.removeprefix(PREFIX) for t in spark.catalog.listTables() if t.isTemporary and t.name.startswith(PREFIX)}
    return sorted(own | set(Catalogue(spark).names()))


def resolve(spark: SparkSession, name: str | None) -> DataFrame:
    """A named dataset; an unknown name is an error; no name is the sample."""
    return get(spark, name) if name else business_demand(spark)
