"""Each importer against its own history: value, timing, novelty and volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargoscope.config import AnomalyConfig
from cargoscope.functions.cleaning import (
    arrival_day,
    as_flag,
    count_where,
    present,
    year_month,
    z_score,
)
from cargoscope.functions.quantiles import exact_quantile
from cargoscope.operators.entities import active_days
from cargoscope.operators.keys import null_safe_join
from cargoscope.session import materialise


def scorable(txn: DataFrame) -> DataFrame:
    """Dated transactions with a positive converted value, and its logarithm."""
    return txn.where("txn_value_cad > 0 and arrival_date is not null").withColumn(
        "log_val", F.ln("txn_value_cad")
    )


def entity_baseline(txn: DataFrame) -> DataFrame:
    """Normal size and spread of an importer's transactions on the log scale, and its tenure."""
    first, last = F.min("arrival_date"), F.max("arrival_date")
    return (
        scorable(txn)
        .groupBy("bn_9")
        .agg(
            F.count("*").alias("txn_cnt"),
            F.avg("log_val").alias("mean_log_val"),
            F.stddev_samp("log_val").alias("std_log_val"),
            first.alias("first_arrival"),
            last.alias("last_arrival"),
            F.datediff(last, first).alias("tenure_days"),
        )
    )


def baseline_summary(baseline: DataFrame, config: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    return baseline.agg(
        F.count("*").alias("n_entities"),
        count_where(F.col("txn_cnt") >= config.min_txns).alias("n_with_baseline"),
        F.avg("txn_cnt").alias("avg_txn_cnt"),
        F.avg("tenure_days").alias("avg_tenure_days"),
    )


def txn_value_zscore(txn: DataFrame, config: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """Value z-score, days since the previous transaction and reactivation mark per transaction.

    The importer's statistics and the previous active day meet on one small (importer, day)
    table; the transactions then join that table once.
    """
    scored = scorable(txn)
    stats = scored.groupBy("bn_9").agg(
        F.count("*").alias("entity_txn_cnt"),
        F.avg("log_val").alias("_mean"),
        F.stddev_samp("log_val").alias("_sd"),
    )
    context = null_safe_join(active_days(scored), stats, ["bn_9"]).drop("n_txn", "first_value")
    since = F.when(
        F.col("clnt_sply_req_id") == F.col("first_id"), F.datediff("arrival_date", "prev_date")
    ).otherwise(0)
    return (
        null_safe_join(scored, context, ["bn_9", "arrival_date"])
        .withColumn("days_since_prev", since)
        .select(
            "clnt_sply_req_id",
            "bn_9",
            "arrival_date",
            "txn_value_cad",
            "entity_txn_cnt",
            z_score(F.col("log_val"), F.col("_mean"), F.col("_sd")).alias("value_z"),
            "days_since_prev",
            as_flag(F.col("days_since_prev") >= config.reactivation_days).alias("is_reactivation"),
        )
    )


def value_z_robust(txn: DataFrame) -> DataFrame:
    """(x - median) / MAD of the log value, the spread-resistant form of the value z-score.

    The medians, one row per importer, are written before the deviations are taken from them:
    the deviations are read three times.
    """
    scored = scorable(txn).select("clnt_sply_req_id", "bn_9", "log_val")
    medians = materialise(exact_quantile(scored, ["bn_9"], "log_val", 0.5, "median_log"))
    off = null_safe_join(scored, medians, ["bn_9"]).withColumn(
        "_dev", F.abs(F.col("log_val") - F.col("median_log"))
    )
    mads = exact_quantile(off, ["bn_9"], "_dev", 0.5, "mad_log")
    return null_safe_join(off, mads, ["bn_9"]).select(
        "clnt_sply_req_id",
        "bn_9",
        "median_log",
        "mad_log",
        z_score(F.col("log_val"), F.col("median_log"), F.col("mad_log")).alias("robust_z"),
    )


def is_value_anomaly(config: AnomalyConfig) -> Column:
    return (F.abs("value_z") >= config.value_z) & (F.col("entity_txn_cnt") >= config.min_txns)


def is_volume_spike(config: AnomalyConfig) -> Column:
    return (F.col("vol_z") >= config.monthly_z) & (F.col("n_months") >= config.min_months)


def txn_anomaly_rollup(scored: DataFrame, config: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    return scored.groupBy("bn_9").agg(
        count_where(is_value_anomaly(config)).alias("n_value_anom"),
        F.sum("is_reactivation").alias("n_reactivation"),
        F.max(F.abs("value_z")).alias("max_abs_z"),
    )


# -- novelty -------------------------------------------------------------------------------


def _dated(lines: DataFrame) -> DataFrame:
    return lines.withColumn("_day", arrival_day(F.col("actual_arrival_dttm"))).where(
        "_day is not null"
    )


def dim_first_seen(lines: DataFrame, dim: str) -> DataFrame:
    """First day each importer used each value of a dimension."""
    return (
        _dated(lines)
        .where(present(F.col(dim)))
        .groupBy("bn_9", F.col(dim).alias("dim_val"))
        .agg(F.min("_day").alias("dim_first"))
    )


def entity_span(lines: DataFrame) -> DataFrame:
    """First and last day of each importer."""
    return (
        _dated(lines)
        .groupBy("bn_9")
        .agg(F.min("_day").alias("ent_first"), F.max("_day").alias("ent_last"))
    )


def novelty_join(first_seen: DataFrame, span: DataFrame) -> DataFrame:
    return first_seen.join(span, "bn_9")


def is_late(config: AnomalyConfig) -> Column:
    return F.col("dim_first") > F.date_add("ent_first", config.novelty_grace_days)


def is_recent(config: AnomalyConfig) -> Column:
    return F.col("dim_first") >= F.date_sub("ent_last", config.recent_window_days)


def novelty(lines: DataFrame, dim: str, config: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """Distinct, late and recent-new values of one dimension per importer."""
    return single_novelty(novelty_profile(lines, {dim: "dim"}, config), "dim")


def single_novelty(profile: DataFrame, suffix: str) -> DataFrame:
    """One dimension's columns of a novelty profile, for importers that use the dimension."""
    return profile.where(F.col(f"n_{suffix}") > 0).select(
        "bn_9",
        F.col(f"n_{suffix}").alias("n_distinct_dim"),
        F.col(f"late_{suffix}").alias("n_late"),
        F.col(f"recent_new_{suffix}").alias("n_recent_new"),
    )


def novelty_profile(
    lines: DataFrame, dims: dict[str, str], config: AnomalyConfig = AnomalyConfig()
) -> DataFrame:
    """Novelty of several dimensions from one scan; ``dims`` maps dimension to output suffix.

    The lines first shrink to one row per (importer, combination of dimension values) with its
    first and last day; every later step works on that.
    """
    combos = _dated(lines).groupBy("bn_9", *dims).agg(
        F.min("_day").alias("_first"), F.max("_day").alias("_last")
    )
    # One row per dimension value, plus one unconditional row that carries the importer's span.
    pairs = [F.struct(F.lit(d).alias("dim"), F.col(d).alias("dim_val")) for d in dims]
    span = F.struct(F.lit("").alias("dim"), F.lit(None).cast("string").alias("dim_val"))
    seen = (
        combos.select("bn_9", "_first", "_last", F.inline(F.array(*pairs, span)))
        .where(present(F.col("dim_val")) | (F.col("dim") == ""))
        .groupBy("bn_9", "dim", "dim_val")
        .agg(F.min("_first").alias("dim_first"), F.max("_last").alias("dim_last"))
    )
    entity = seen.where("dim = ''").select(
        "bn_9", F.col("dim_first").alias("ent_first"), F.col("dim_last").alias("ent_last")
    )
    rows = seen.where("dim <> ''").join(entity, "bn_9")
    late = is_late(config)
    outs = []
    for dim, suffix in dims.items():
        mine = F.col("dim") == dim
        outs += [
            count_where(mine).alias(f"n_{suffix}"),
            count_where(mine & late).alias(f"late_{suffix}"),
            count_where(mine & late & is_recent(config)).alias(f"recent_new_{suffix}"),
        ]
    return rows.groupBy("bn_9").agg(*outs)


def novelty_pair_join(profile: DataFrame) -> DataFrame:
    """Importers using both dimensions, with a recent-new country or chapter.

    Both dimensions come from one profile, so the lines are read and shuffled once.
    """
    return profile.where(
        "n_countries > 0 and n_chapters > 0 and (recent_new_countries > 0 or recent_new_chapters > 0)"
    ).select("bn_9", "n_countries", "recent_new_countries", "n_chapters", "recent_new_chapters")


def novelty_normalised(nov: DataFrame) -> DataFrame:
    """Recent-new values as a share of all values, so broad importers do not dominate."""
    return nov.withColumn("recent_new_share", F.col("n_recent_new") / F.col("n_distinct_dim"))


# -- volume --------------------------------------------------------------------------------


def monthly_counts(txn: DataFrame) -> DataFrame:
    """Transactions per importer and active month."""
    return (
        txn.where("arrival_date is not null")
        .groupBy("bn_9", year_month(F.col("arrival_date")).alias("ym"))
        .agg(F.count("*").alias("n_txn"))
    )


def monthly_zero_filled(txn: DataFrame) -> DataFrame:
    """Transactions per importer and calendar month from its first to its last, quiet months as 0."""
    active = (
        txn.where("arrival_date is not null")
        .groupBy("bn_9", F.trunc("arrival_date", "month").alias("_month"))
        .agg(F.count("*").alias("n_txn"))
    )
    # A month row reaches up to the importer's next active month; the months between are quiet.
    history = Window.partitionBy("bn_9").orderBy("_month")
    until = F.coalesce(F.add_months(F.lead("_month").over(history), -1), F.col("_month"))
    months = F.explode(F.sequence("_month", "_until", F.expr("interval 1 month")))
    return (
        active.withColumn("_until", until)
        .select("bn_9", "_month", "n_txn", months.alias("_m"))
        .select(
            "bn_9",
            year_month(F.col("_m")).alias("ym"),
            F.when(F.col("_m") == F.col("_month"), F.col("n_txn")).otherwise(0).alias("n_txn"),
        )
    )


def monthly_volume_zscore(counts: DataFrame) -> DataFrame:
    """z-score of each month's count; a calendar bounds an importer's months, so a window is safe."""
    entity = Window.partitionBy("bn_9")
    mean, sd = F.avg("n_txn").over(entity), F.stddev_samp("n_txn").over(entity)
    return counts.select(
        "bn_9",
        "ym",
        "n_txn",
        F.count("*").over(entity).alias("n_months"),
        z_score(F.col("n_txn"), mean, sd).alias("vol_z"),
    )


def monthly_rollup(monthly: DataFrame, config: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    return monthly.groupBy("bn_9").agg(
        count_where(is_volume_spike(config)).alias("n_spike_months"),
        F.max("vol_z").alias("max_vol_z"),
    )


def peak_to_median_ratio(counts: DataFrame) -> DataFrame:
    """Busiest month over the median active month."""
    peaks = counts.groupBy("bn_9").agg(
        F.max("n_txn").alias("peak_month"), F.median("n_txn").alias("median_month")
    )
    return peaks.withColumn("peak_ratio", F.col("peak_month") / F.col("median_month"))


def series_volume_zscore(df: DataFrame, entity: str, day: Column) -> DataFrame:
    """The volume z-score on daily counts, for histories too short for months."""
    counts = df.groupBy(F.col(entity).alias("bn_9"), day.alias("ym")).agg(
        F.count("*").alias("n_txn")
    )
    return monthly_volume_zscore(counts)

