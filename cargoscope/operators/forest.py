"""Isolation forest (Liu, Ting and Zhou, 2008) as Spark jobs.

* randomness is a counter, not a generator: every draw is a hash of (seed, tree, node) or of (entity, tree,
  seed), so the model depends neither on partitioning nor on task retries, and SQL grows the same trees;
* trees are grown side by side, one small group (at most ``sample_size`` rows) per tree;
* the grown forest has a fixed maximum size and is broadcast; all entities are scored in
  Arrow batches.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargoscope.functions.cleaning import signed_log1p
from cargoscope.functions.quantiles import named_quantiles
from cargoscope.session import materialise

# The functions below run in executor processes that need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_NODES = "tree int, node int, feature int, cut double, path double"
#: Hexadecimal digits of a draw: 52 bits, which a double holds exactly.
_DIGITS = 13


def drawn(seed: int, tree: int, node: int, what: str) -> float:
    """The number in [0, 1) that belongs to a node."""
    mark = hashlib.md5(f"{seed}:{tree}:{node}:{what}".encode(), usedforsecurity=False).hexdigest()
    return int(mark[:_DIGITS], 16) / 16.0**_DIGITS


def mean_depth(n: int) -> float:
    """Average path length of an unsuccessful search among ``n`` rows."""
    if n < 2:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def scaled_features(df: DataFrame, features: list[str], fit: Column) -> DataFrame:
    """Signed-log features standardised on the fit rows, nulls as 0, in columns ``x0..``."""
    logged = df.withColumns(
        {
            f"x{i}": signed_log1p(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
            for i, c in enumerate(features)
        }
    )
    names = [f"x{i}" for i in range(len(features))]
    moments = (
        logged.where(fit)
        .agg(*[f(n).alias(f"{k}_{n}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_pop))])
        .first()
    )

    def scaled(n: str) -> Column:
        mean, sd = moments[f"m_{n}"] or 0.0, moments[f"s_{n}"] or 1.0
        return (F.col(n) - mean) / sd

    return logged.withColumns({n: scaled(n) for n in names})


def tree_samples(
    rows: DataFrame, key: str, n_rows: int, n_trees: int, sample_size: int, seed: int
) -> DataFrame:
    """The rows of each tree: those with the lowest hash of (key, tree, seed).

    A hash cut keeps about four times the needed rows before they are ranked, so the fit set is
    never multiplied by the number of trees.
    """
    keep = 1.0 if n_rows == 0 else min(1.0, 4.0 * sample_size / n_rows)
    # Hashes are compared as text: the cut is the share's own hexadecimal digits.
    upto = f"{int(keep * 16**_DIGITS):0{_DIGITS}x}" if keep < 1.0 else "g"

    def mark(tree: Column) -> Column:
        name = F.coalesce(F.col(key).cast("string"), F.lit(""))
        return F.md5(F.concat_ws(":", name, tree.cast("string"), F.lit(str(seed))))

    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: mark(t) < F.lit(upto))
    chosen = rows.withColumn("tree", F.explode(trees)).withColumn("_u", mark(F.col("tree")))
    lowest = Window.partitionBy("tree").orderBy("_u", key)
    return chosen.withColumn("_rank", F.row_number().over(lowest)).where(F.col("_rank") <= sample_size).drop("_u", "_rank")


def tree_grower(n_features: int, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Function growing one tree from its sample; the children of node n are 2n and 2n + 1."""

    def grow(sample: pd.DataFrame) -> pd.DataFrame:
        tree = int(sample["tree"].iloc[0])
        data = sample[[f"x{i}" for i in range(n_features)]].to_numpy(float)
        limit = math.ceil(math.log2(max(len(data), 2)))
        nodes, pending = [], [(1, np.arange(len(data)), 0)]
        while pending:
            node, members, depth = pending.pop()
            part = data[members]
            low, high = part.min(axis=0), part.max(axis=0)
            varied = np.flatnonzero(high > low)
            if depth >= limit or len(members) < 2 or len(varied) == 0:
                nodes.append((tree, node, -1, 0.0, depth + mean_depth(len(members))))
                continue
            feature = int(varied[int(drawn(seed, tree, node, "feature") * len(varied))])
            cut = float(low[feature] + drawn(seed, tree, node, "cut") * (high[feature] - low[feature]))
            goes_left = part[:, feature] <= cut
            nodes.append((tree, node, feature, cut, 0.0))
            pending.append((2 * node + 1, members[~goes_left], depth + 1))
            pending.append((2 * node, members[goes_left], depth + 1))
        return pd.DataFrame(nodes, columns=[c.split()[0] for c in _NODES.split(", ")])

    return grow


def _packed(nodes: list, n_trees: int) -> dict[str, np.ndarray]:
    """Node rows as dense (tree, node) arrays; a leaf points to itself."""
    width = 1 + max(r["node"] for r in nodes)
    leaf = np.tile(np.arange(width), (n_trees, 1))
    forest = {
        "feature": np.zeros((n_trees, width), dtype=np.int64),
        "cut": np.zeros((n_trees, width)),
        "left": leaf.copy(),
        "right": leaf.copy(),
        "path": np.zeros((n_trees, width)),
    }
    for r in nodes:
        at = (r["tree"], r["node"])
        forest["path"][at] = r["path"]
        if r["feature"] >= 0:
            forest["feature"][at] = r["feature"]
            forest["cut"][at] = r["cut"]
            forest["left"][at] = 2 * r["node"]
            forest["right"][at] = 2 * r["node"] + 1
    return forest


def _mean_path(forest: dict[str, np.ndarray], data: np.ndarray, depth: int) -> np.ndarray:
    total, rows = np.zeros(len(data)), np.arange(len(data))
    for tree in range(len(forest["path"])):
        node = np.ones(len(data), dtype=np.int64)
        for _ in range(depth):
            left = data[rows, forest["feature"][tree][node]] <= forest["cut"][tree][node]
            node = np.where(left, forest["left"][tree][node], forest["right"][tree][node])
        total += forest["path"][tree][node]
    return total / len(forest["path"])


def isolation_scores(
    df: DataFrame,
    key: str,
    features: list[str],
    fit: Column,
    n_trees: int = 200,
    sample_size: int = 256,
    seed: int = 42,
) -> DataFrame:
    """``df`` plus ``ml_score`` in (0, 1], higher meaning easier to isolate.

    ``df`` is read several times: pass a written table.
    """
    scaled = scaled_features(df, features, fit)
    names = [f"x{i}" for i in range(len(features))]
    rows = scaled.where(fit).select(key, *names)
    n_rows = rows.count()
    if n_rows == 0:
        return df.withColumn("ml_score", F.lit(None).cast("double"))
    samples = tree_samples(rows, key, n_rows, n_trees, sample_size, seed)
    # At most n_trees * (2 * sample_size - 1) rows, whatever the data size.
    nodes = (
        samples.groupBy("tree").applyInPandas(tree_grower(len(names), seed), _NODES).collect()
    )
    psi = min(sample_size, n_rows)
    forest = df.sparkSession.sparkContext.broadcast(_packed(nodes, n_trees))
    depth, normal = math.ceil(math.log2(max(psi, 2))), max(mean_depth(psi), 1.0)

    @F.pandas_udf("double")
    def score(batch: pd.DataFrame) -> pd.Series:
        # Nine places: the order in which paths are summed does not tell equal scores apart.
        return pd.Series(np.round(2.0 ** (-_mean_path(forest.value, batch.to_numpy(float), depth) / normal), 9))

    return scaled.withColumn("ml_score", score(F.struct(*names))).drop(*names)


def isolation_forest(
    df: DataFrame,
    key: str,
    features: list[str],
    fit: Column,
    outlier_pctl: float = 0.99,
    n_trees: int = 200,
    sample_size: int = 256,
    seed: int = 42,
) -> DataFrame:
    """Scores plus the 0/1 outlier mark: fit rows at or above the fit set's cut-off score."""
    scored = materialise(isolation_scores(df, key, features, fit, n_trees, sample_size, seed))
    cutoff = named_quantiles(scored, {"cut": (F.when(fit, F.col("ml_score")), outlier_pctl)})
    outlier = (F.col("ml_score") >= cutoff.scalar()) & fit
    return scored.withColumn("ml_outlier", F.when(outlier, 1).otherwise(0))
