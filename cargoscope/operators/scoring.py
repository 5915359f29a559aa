"""Flags, scores and the reports drawn from them."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope.config import FLAG_LABELS, RULE_FLAGS, AnomalyConfig, RiskConfig
from cargoscope.functions.cleaning import add_all, as_flag
from cargoscope.functions.quantiles import named_quantiles
from cargoscope.session import materialise


def coerce_fill_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers from whatever the columns hold; anything unreadable becomes 0."""
    return df.withColumns(
        {c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in columns}
    )


def fill_flags_false(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in columns})


def columns_between(df: DataFrame, first: str, last: str) -> list[str]:
    names = df.columns
    return names[names.index(first) : names.index(last) + 1]


def move_columns(df: DataFrame, columns: list[str], after: str | None = None) -> DataFrame:
    """Columns moved behind another one, or to the end."""
    rest = [c for c in df.columns if c not in columns]
    at = len(rest) if after is None else rest.index(after) + 1
    return df.select(*rest[:at], *columns, *rest[at:])


def weighted_flag_sum(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    return df.withColumns(
        {
            "flag_count": add_all([F.col(c) for c in weights]).cast("int"),
            "risk_score": add_all([F.col(c) * F.lit(float(w)) for c, w in weights.items()]),
        }
    )


# -- typology flags ------------------------------------------------------------------------

_ZERO_FILLED = [
    "importer_numbered_share",
    "vendor_numbered_share",
    "round_1000_share",
    "round_100_share",
    "any_high_risk",
    "high_risk_share",
    "max_gap_days",
    "distinct_sections",
    "first_txn_value_cad",
]


def percentile_thresholds(entities: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """The three data-driven cut-offs in one row; inputs are already zero-filled."""
    q = config.flag_pctl
    regular, repeat = F.col("is_consolidator") == 0, F.col("txn_cnt") >= 2
    cut = named_quantiles(
        entities,
        {
            "round_thr": (F.when(regular, F.col("round_1000_share")), q),
            "gap_thr": (F.when(repeat, F.col("max_gap_days")), q),
            "first_thr": (F.col("first_txn_value_cad"), q),
        },
    )
    return cut.withColumn("round_thr", F.greatest("round_thr", F.lit(config.round_share_floor)))


def typology_flags(entities: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """All eight flags, their count and the weighted score.

    ``entities`` is read for the cut-offs and again for the flags: pass a written table.
    """
    filled = coerce_fill_zero(entities, _ZERO_FILLED)
    # One row of three numbers, computed once and used as constants.
    cut = percentile_thresholds(filled, config).first()
    rules = typology_rules(config, cut.asDict())
    return weighted_flag_sum(filled.withColumns(rules), config.weights)


def typology_rules(config: RiskConfig, cut: dict[str, float | None]) -> dict[str, Column]:
    """Flag name -> 0/1 expression, given the cut-offs."""

    def at_least(column: str, threshold: str) -> Column:
        # Compared at nine decimals: a value equal to the cut-off must not depend on rounding noise.
        return F.round(column, 9) >= F.round(F.lit(cut[threshold]).cast("double"), 9)

    share = F.greatest("importer_numbered_share", "vendor_numbered_share")
    regular = F.col("is_consolidator") == 0
    return {
        "i3_numbered": as_flag(share >= config.numbered_share_min),
        "i4_benford1": F.coalesce("i4_benford1", F.lit(0)),
        "i5_benford2": F.coalesce("i5_benford2", F.lit(0)),
        "i7_high_risk_juris": as_flag(F.col("any_high_risk") == 1),
        "i8_dormancy": as_flag(at_least("max_gap_days", "gap_thr") & (F.col("txn_cnt") >= 2)),
        "i9_rounded": as_flag(at_least("round_1000_share", "round_thr") & regular),
        "i10_high_first_txn": as_flag(at_least("first_txn_value_cad", "first_thr")),
        "i11_lines_of_trade": as_flag(
            (F.col("distinct_sections") >= config.sections_flag_min) & regular
        ),
    }


# -- behavioural flags ---------------------------------------------------------------------


def anomaly_flags(rollup: DataFrame) -> DataFrame:
    """The five rule flags and their sum; novelty does not count for consolidators."""
    regular = F.col("is_consolidator") == 0
    rules = {
        "a_value": F.col("n_value_anom") > 0,
        "a_reactivation": F.col("n_reactivation") > 0,
        "a_new_country": (F.col("recent_new_countries") > 0) & regular,
        "a_new_chapter": (F.col("recent_new_chapters") > 0) & regular,
        "a_volume_spike": F.col("n_spike_months") > 0,
    }
    flagged = rollup.withColumns({name: as_flag(rule) for name, rule in rules.items()})
    return flagged.withColumn("rule_score", add_all([F.col(c) for c in RULE_FLAGS]).cast("int"))


# -- reports -------------------------------------------------------------------------------


def flag_rates(df: DataFrame, flags: list[str]) -> DataFrame:
    """Share of entities per flag, highest first."""
    means = df.agg(*[F.avg(c).alias(c) for c in flags])
    long = means.unpivot([], flags, "flag", "flag_rate")
    return long.orderBy(F.desc("flag_rate"), "flag")


def score_histogram(df: DataFrame, score: str) -> DataFrame:
    return df.groupBy(score).agg(F.count("*").alias("n_entities")).orderBy(score)


def single_flag_counts(df: DataFrame, labels: dict[str, str] = FLAG_LABELS) -> DataFrame:
    """Count and share per flag with its label, highest first."""
    flags = list(labels)
    sums = df.agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in flags], F.count("*").alias("_n"))
    name = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return (
        sums.unpivot(["_n"], flags, "flag", "n_importers")
        .select(
            "flag",
            name[F.col("flag")].alias("label"),
            "n_importers",
            F.round(F.col("n_importers") / F.col("_n"), 4).alias("pct"),
        )
        .orderBy(F.desc("n_importers"), "flag")
    )


def flag_combinations(df: DataFrame, labels: dict[str, str] = FLAG_LABELS) -> DataFrame:
    """Entities tripping all flags of each combination of two or more, zero counts included.

    One pass turns each entity into a bit mask; the few distinct masks are then spread over the
    combinations they contain.
    """
    flags = list(labels)
    n_masks = 1 << len(flags)
    bits = [F.when(F.col(c) == 1, 1 << i).otherwise(0) for i, c in enumerate(flags)]
    masks = df.groupBy(add_all(bits).alias("mask")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("n")).scalar()

    inside = F.filter(
        F.sequence(F.lit(0), F.lit(n_masks - 1)), lambda c: F.col("mask").bitwiseAND(c) == c
    )
    hits = masks.select(F.explode(inside).alias("combo"), "n")
    hits = hits.groupBy("combo").agg(F.sum("n").alias("n"))

    rows = []
    for k in range(2, len(flags) + 1):
        for chosen in combinations(range(len(flags)), k):
            names = [flags[i] for i in chosen]
            rows.append(
                (
                    sum(1 << i for i in chosen),
                    k,
                    ", ".join(names),
                    " + ".join(labels[c] for c in names),
                )
            )
    listed = df.sparkSession.createDataFrame(rows, "combo int, k int, flags string, label string")
    count = F.coalesce("n", F.lit(0))
    return (
        listed.join(hits, "combo", "left")
        .select("k", "flags", "label", count.alias("n_importers"), (count / total).alias("pct"))
        .orderBy("k", F.desc("n_importers"), "label")
    )


def flag_lift(df: DataFrame, labels: dict[str, str] = FLAG_LABELS) -> DataFrame:
    """Observed share of each combination over the share expected if its flags were independent."""
    rates = flag_rates(df, list(labels))
    combos = flag_combinations(df, labels)
    expected = (
        combos.select("flags", F.explode(F.split("flags", ", ")).alias("flag"))
        .join(rates, "flag")
        .groupBy("flags")
        .agg(F.product("flag_rate").alias("expected_pct"))
    )
    return combos.join(expected, "flags").withColumn("lift", F.try_divide("pct", "expected_pct"))


def rule_ml_overlap(profile: DataFrame, min_rules: int = 2) -> DataFrame:
    both = (F.col("rule_score") >= min_rules) & (F.col("ml_outlier") == 1)
    return profile.agg(F.count_if(both).alias("n_overlap"))


def combined_risk_view(matrix: DataFrame, profile: DataFrame) -> DataFrame:
    """Typology and behaviour side by side; importers high on both come first."""
    m = matrix.select("bn_9", "is_consolidator", "txn_cnt", "total_value_cad", "flag_count", "risk_score")
    p = profile.select("bn_9", "rule_score")
    both = F.col("risk_score") + F.col("rule_score")
    return (
        m.join(p, "bn_9")
        .withColumn("combined_score", both)
        .withColumn("lower_score", F.least(F.col("risk_score"), F.col("rule_score").cast("double")))
        .orderBy(F.desc("lower_score"), F.desc("combined_score"), F.desc("total_value_cad"), "bn_9")
    )


def top_rows(df: DataFrame, n: int, *order) -> DataFrame:
    """Top-n report: each task keeps n rows before the final merge."""
    return df.orderBy(*order).limit(n)


def top_value_anomalies(scored: DataFrame, config: AnomalyConfig, n: int = 50) -> DataFrame:
    from cargoscope.operators.history import is_value_anomaly

    rows = scored.where(is_value_anomaly(config)).drop("is_reactivation")
    return top_rows(rows, n, F.desc(F.round(F.abs("value_z"), 6)), "clnt_sply_req_id")


def entity_drilldown(scored: DataFrame, bn_9: str | Column, n: int = 25) -> DataFrame:
    """One importer's most extreme transactions."""
    rows = scored.where(F.col("bn_9") == bn_9).select(
        "clnt_sply_req_id", "arrival_date", "txn_value_cad", "value_z", "days_since_prev", "is_reactivation"
    )
    return top_rows(rows, n, F.desc(F.round(F.abs("value_z"), 6)), "clnt_sply_req_id")


def _stage_ids(stages: dict[str, DataFrame]) -> DataFrame:
    """One row per entity id (null included) with a mark per stage that has it."""
    parts = [df.select("bn_9", F.lit(i).alias("_stage")) for i, df in enumerate(stages.values())]
    ids = reduce(DataFrame.unionByName, parts).groupBy("bn_9")
    return ids.agg(*[F.max(F.col("_stage") == i).alias(f"_in{i}") for i in range(len(stages))])


def entity_count_reconcile(stages: dict[str, DataFrame]) -> DataFrame:
    """Entities per stage, and how many of the first stage's ids each one lacks."""
    marks = _stage_ids(stages)
    counted = marks.agg(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("stage"),
                    F.count_if(F.col(f"_in{i}")).alias("n_entities"),
                    F.count_if(F.col("_in0") & ~F.col(f"_in{i}")).alias("n_dropped"),
                )
                for i, name in enumerate(stages)
            ]
        ).alias("rows")
    )
    return counted.select(F.inline("rows"))


def dropped_entities(stages: dict[str, DataFrame]) -> DataFrame:
    """The first stage's ids that each later stage lacks."""
    lost = [
        F.when(F.col("_in0") & ~F.col(f"_in{i}"), F.lit(name)) for i, name in enumerate(stages) if i
    ]
    named = _stage_ids(stages).select("bn_9", F.explode(F.array_compact(F.array(*lost))).alias("stage"))
    return named.select("stage", "bn_9")


def share_of_total(counts: DataFrame, count: str) -> DataFrame:
    """Each row's share of the sum of a count column; the counts are written once and read twice."""
    counts = materialise(counts)
    total = counts.agg(F.sum(count).alias("n")).scalar()
    return counts.withColumn("share", F.col(count) / total)


def count_with_share(df: DataFrame, key: str) -> DataFrame:
    """Rows per key with their share of all rows, most first."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return share_of_total(counts, "n").orderBy(F.desc("n"), key)
