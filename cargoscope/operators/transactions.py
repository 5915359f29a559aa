"""Lines -> transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope.config import RiskConfig
from cargoscope.functions.cleaning import arrival_day, clean_number, count_where
from cargoscope.operators.fx import with_rate


def parsed_lines(lines: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """The line columns a transaction value needs, typed."""
    return lines.select(
        "clnt_sply_req_id",
        "bn_9",
        arrival_day(F.col("actual_arrival_dttm")).alias("arrival_date"),
        F.col("price_crncy_total").alias("ccy"),
        clean_number(F.col("price_val_total"), config.price_type).alias("price_val"),
    )


def line_rate_join(lines: DataFrame, fx: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """Typed lines with the rate in force on their arrival day."""
    rates = fx.withColumn("rate_to_cad", F.col("rate_to_cad").cast(config.rate_type))
    return with_rate(parsed_lines(lines, config), rates, "ccy", "arrival_date")


def txn_currency_profile(lines: DataFrame) -> DataFrame:
    """Distinct currencies per transaction (nulls ignored) and the highest code."""
    return lines.groupBy("clnt_sply_req_id").agg(
        F.countDistinct("price_crncy_total").alias("ccy_cnt"),
        F.max("price_crncy_total").alias("decl_ccy"),
    )


def txn_value(lines: DataFrame, fx: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """One row per transaction: converted and declared value, currency marks and line counts.

    The rate joins each line, as a broadcast where the rates are few. The lines then combine map-side, in
    a hash aggregate, into one row per transaction, importer and currency, for nearly every transaction a
    single row whatever the days of its lines; the shuffles and text comparisons see those rows only.
    """
    rates = fx.withColumn("rate_to_cad", F.col("rate_to_cad").cast(config.rate_type))
    combined = (
        with_rate(parsed_lines(lines, config), rates, "ccy", "arrival_date")
        .groupBy("clnt_sply_req_id", "bn_9", "ccy")
        .agg(
            F.max("arrival_date").alias("arrival_date"),
            F.sum(_converted(config)).alias("converted"),
            F.sum("price_val").alias("price_val"),
            count_where(F.col("rate_to_cad").isNull()).alias("unrated"),
            F.count("*").alias("n_lines"),
        )
    )
    # Lowest and highest code tell one currency from several.
    low, high = F.min("ccy"), F.max("ccy")
    one_currency = low == high
    return combined.groupBy("clnt_sply_req_id").agg(
        F.max("bn_9").alias("bn_9"),
        F.max("arrival_date").alias("arrival_date"),
        F.sum("converted").cast("double").alias("txn_value_cad"),
        F.when(one_currency, F.sum("price_val")).cast("double").alias("txn_value_decl"),
        F.when(one_currency, high).alias("decl_ccy"),
        F.when(low < high, 1).otherwise(0).alias("is_mixed_ccy_txn"),
        F.sum("unrated").alias("lines_fx_missing"),
        F.sum("n_lines").alias("line_cnt"),
    )


def _converted(config: RiskConfig) -> Column:
    if config.price_type == "double":
        return F.col("price_val") * F.col("rate_to_cad")
    # A sum of 24 digits times a rate of 12 keeps all of its decimals; wider operands would lose some.
    return F.col("price_val").cast("decimal(24,4)") * F.col("rate_to_cad")


def txn_ccy_join(lines: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """Every typed line with its transaction's currency profile."""
    return parsed_lines(lines, config).join(txn_currency_profile(lines), "clnt_sply_req_id")


def txn_value_summary(txn: DataFrame) -> DataFrame:
    """Headline figures of the transaction table."""
    return txn.agg(
        F.count("*").alias("n_transactions"),
        F.countDistinct("bn_9").alias("n_entities"),
        count_where(F.col("lines_fx_missing") > 0).alias("txns_with_fx_gaps"),
        count_where(F.col("is_mixed_ccy_txn") == 1).alias("txns_mixed_ccy"),
        F.count("txn_value_decl").alias("txns_with_decl_value"),
        F.min("line_cnt").alias("min_lines"),
        F.avg("line_cnt").alias("avg_lines"),
        F.max("line_cnt").alias("max_lines"),
        F.sum(F.col("txn_value_cad").cast("decimal(28,6)")).alias("total_value_cad"),
    )


def mixed_ccy_sample(txn: DataFrame, n: int = 5) -> DataFrame:
    return txn.where("is_mixed_ccy_txn = 1").orderBy("clnt_sply_req_id").limit(n)
