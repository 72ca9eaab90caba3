"""Daily bars: long DataFrames (symbol, dt, o, h, l, c, v), read, written, and made from the driver's tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ["o", "h", "l", "c", "v"]
BARS = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("dt", T.DateType()), *(T.StructField(c, T.DoubleType()) for c in PRICES)])
CSV = T.StructType([T.StructField("dt", T.DateType()), *(T.StructField(c, T.DoubleType()) for c in PRICES)])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, folder: str) -> DataFrame:
    """One CSV file per symbol, named by it; rows with an empty price go."""
    raw = spark.read.schema(CSV).option("header", True).csv(folder)
    symbol = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    return raw.select(symbol.alias("symbol"), "dt", *PRICES).dropna(subset=PRICES)


def write_csv(bars: DataFrame, folder: str) -> None:
    """One CSV file per symbol, put in place when it is whole. Symbols are written by different tasks; the folder is one that
    they share."""
    prices = list(PRICES)

    def put(own: pd.DataFrame) -> pd.DataFrame:
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        symbol = own["symbol"].iloc[0]
        lines = own.sort_values("dt")[["dt", *prices]].set_axis(["Date", *(c.upper() for c in prices)], axis=1)
        lines.to_csv(path := f"{folder}/.{symbol}.{uuid.uuid4().hex}", index=False)
        os.replace(path, f"{folder}/{symbol}.csv")
        return pd.DataFrame({"n": [len(own)]})

    bars.groupBy("symbol").applyInPandas(put, "n long").agg(F.sum("n")).collect()


def write_table(bars: DataFrame, path: str) -> None:
    """Parquet by symbol, so that one symbol's bars are read and replaced alone."""
    bars.repartition("symbol").sortWithinPartitions("symbol", "dt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BARS).parquet(path)


def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of 25 symbols: brands are symbols, ship dates are days, and standardised mean prices drive a path."""
    part = load(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    items = load(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("dt"), "l_extendedprice", "l_quantity", "l_discount")
    daily = (
        items.join(part, items["l_partkey"] == part["p_partkey"]).groupBy("symbol", "dt")
        .agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), F.sum("l_quantity").alias("v"), F.avg("l_discount").alias("g"))
    )
    whole = Window.partitionBy("symbol")
    order = whole.orderBy("dt")
    z = daily.withColumn("z", (F.col("p") - F.avg("p").over(whole)) / F.stddev_samp("p").over(whole))
    path = z.withColumn("c", 100 * F.exp(F.sum(F.lit(0.0003) + 0.015 * F.col("z")).over(order.rowsBetween(Window.unboundedPreceding, 0))))
    opened = path.withColumn("o", F.coalesce(F.lag("c").over(order), F.col("c")) * F.exp(0.1 * (F.col("g") - 0.05)))
    return opened.select("symbol", "dt", "o", F.greatest("o", "c").alias("h"), F.least("o", "c").alias("l"), "c", "v")


def from_events(events: DataFrame) -> DataFrame:
    """OHLCV by event type and day; ties in time go by event_id."""
    first = F.struct("ts", "event_id")
    day = events.groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("dt"))
    return day.agg(
        F.min_by("value", first).alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", first).alias("c"), F.count("*").cast("double").alias("v")
    )


#: The same bars in DuckDB, as the CTE `bars`.
SQL = """
px AS (SELECT p_brand AS symbol, CAST(l_shipdate AS date) AS dt, avg(l_extendedprice / l_quantity) AS p, sum(l_quantity) AS v, avg(l_discount) AS g
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
pz AS (SELECT *, (p - avg(p) OVER (PARTITION BY symbol)) / stddev_samp(p) OVER (PARTITION BY symbol) AS z FROM px),
pc AS (SELECT *, 100 * exp(sum(0.0003::double + 0.015::double * z) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS c FROM pz),
po AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY symbol ORDER BY dt), c) * exp(0.1::double * (g - 0.05::double)) AS o FROM pc),
bars AS (SELECT symbol, dt, o, greatest(o, c) AS h, least(o, c) AS l, c, v FROM po)
"""
