"""As-of exchange rates: each line takes the latest rate on or before its arrival day.

Rates are usually few (currencies x days), lines are many. The gaps between published days are then
filled once on the small side, which turns the as-of condition into an equality that a broadcast hash
join answers without moving the lines. A history too long for that, or one by time of day, is merged
with the lines in sorted order instead.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from cargoscope.operators.asof import asof_join
from cargoscope.session import BROADCAST_ROW_LIMIT


def rate_calendar(fx: DataFrame, last_day: date) -> DataFrame:
    """(ccy, rate_day, rate_to_cad) for every day from a currency's first rate to ``last_day``."""
    # One rate per (currency, day); a repeated pair keeps its highest rate.
    daily = fx.groupBy("ccy", "fx_date").agg(F.max("rate_to_cad").alias("rate_to_cad"))
    by_day = Window.partitionBy("ccy").orderBy("fx_date")
    until = F.coalesce(F.date_sub(F.lead("fx_date").over(by_day), 1), F.lit(last_day))
    return daily.withColumn("until", until).select(
        "ccy", F.explode(F.sequence("fx_date", "until")).alias("rate_day"), "rate_to_cad"
    )


def with_rate(df: DataFrame, fx: DataFrame, ccy: str, day: str, fx_time: str = "fx_date") -> DataFrame:
    """Add ``rate_to_cad``; null where no rate was published by that day or the currency is unknown.

    ``day`` and ``fx_time`` may be timestamps too.
    """
    if not all(isinstance(t, DateType) for t in (df.schema[day].dataType, fx.schema[fx_time].dataType)):
        return merged_rate(df, fx, ccy, day, fx_time)
    extent = fx.agg(
        F.min(fx_time).alias("first"), F.max(fx_time).alias("last"), F.countDistinct("ccy").alias("n")
    ).first()
    if extent["last"] is None:
        return df.withColumn("rate_to_cad", F.lit(None).cast(fx.schema["rate_to_cad"].dataType))
    # The calendar cannot have more rows than currencies times days.
    most_rows = extent["n"] * ((extent["last"] - extent["first"]).days + 1)
    if most_rows > BROADCAST_ROW_LIMIT:
        return merged_rate(df, fx, ccy, day, fx_time)
    calendar = rate_calendar(fx.withColumnRenamed(fx_time, "fx_date"), extent["last"]).select(
        F.col("ccy").alias("_ccy"), F.col("rate_day").alias("_day"), "rate_to_cad"
    )
    # After the last published day every currency keeps its final rate.
    lookup_day = F.when(F.col(day).isNotNull(), F.least(F.col(day), F.lit(extent["last"])))
    on = (F.col(ccy) == F.col("_ccy")) & (lookup_day == F.col("_day"))
    return df.join(F.broadcast(calendar), on, "left").drop("_ccy", "_day")


def merged_rate(df: DataFrame, fx: DataFrame, ccy: str, day: str, fx_time: str = "fx_date") -> DataFrame:
    """``with_rate`` for a history of any length and times of any grain: a sorted merge of both sides."""
    rates = fx.select(F.col("ccy").alias(ccy), fx_time, "rate_to_cad")
    return asof_join(df, rates, [ccy], day, fx_time, ["rate_to_cad"])


def distinct_pairs(lines: DataFrame) -> DataFrame:
    """Distinct (currency, arrival day) of parsed lines."""
    return lines.select("ccy", "arrival_date").distinct()


def fx_asof_join(lines: DataFrame, fx: DataFrame) -> DataFrame:
    """The rate in force for every distinct (currency, arrival day)."""
    return with_rate(distinct_pairs(lines), fx, "ccy", "arrival_date")


def latest_rate(fx: DataFrame, day) -> DataFrame:
    """Each currency's latest rate on or before one day."""
    newest = F.struct("fx_date", "rate_to_cad")
    return (
        fx.where(F.col("fx_date") <= F.lit(day).cast("date"))
        .groupBy("ccy")
        .agg(F.max(newest).alias("r"))
        .select("ccy", "r.fx_date", "r.rate_to_cad")
    )
