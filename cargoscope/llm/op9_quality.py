"""Quality rules: an isolation forest on rule statistics.

Every document gets rule statistics of its whole text; two hard rules reject it at once. The rest
is judged by an isolation forest: each tree splits at random on a small sample of statistics, and a
document that ends on short paths is anomalous. Labelled rows calibrate it: a statistic counts from
what clean documents reach, and the score above which a document is rejected is the quantile of the
clean ones' scores that loses ``clean_loss`` of them.

Bounded and documented: the forest has ``TREES`` trees of ``TREE_ROWS`` rows each, drawn by the
tree's seed out of ``SAMPLE_ROWS`` documents (lowest hashes); in every tree one row for each statistic
comes from up to ``STRATUM_ROWS`` of all documents in which it counts, so that a statistic that is
anomalous in any document can be split, however rare it is. The flagged words, the allowances and the
threshold come from all labelled rows; statistics and scores cover all documents.

Defined results: a null or empty text has 0 words and fails; without labels only the hard rules
reject; a document labelled twice counts twice; null labels are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope.llm.batches import bound_batches, by_bytes, span_sums
from cargoscope.llm.joins import hashed_sample, sized, without
from cargoscope.llm.shingles import hash_windows, hash_words, mix, split_words
from cargoscope.operators.segments import Running, running
from cargoscope.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES, TREE_ROWS, SAMPLE_ROWS = 200, 256, 20_000
STRATUM_ROWS = 1000
#: A flagged word is in this share (and number) of a language's toxic labelled texts, so many times
#: rarer in its others.
FLAG_SHARE, FLAG_LEAST, FLAG_LIFT = 0.05, 4, 20.0
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_marks", "n_flagged"]
FEATURES = ["symbols", "dup_lines", "repeats", "upper", "marks", "flagged"]


# --- statistics --------------------------------------------------------------------------------


def _repeats(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text, the words in 3-word windows that it holds at least twice."""
    covered = np.zeros(len(hashes) + 1, bool)
    windows = hash_windows(hashes, 3)
    if len(windows):
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        inside = text[:-2] == text[2:]
        at = np.flatnonzero(inside)
        own = mix(windows[at] + text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        for k in range(3):
            covered[at[again] + k] = True
    return span_sums(covered[: len(hashes)], offsets)


def _dup_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text, lines with a word and those of them that equal an earlier one."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    lines = coded.indices.to_numpy().astype(np.int64)
    real = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)[lines]
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    n = np.bincount(text[real], minlength=len(texts))
    first = np.unique(text[real] * (len(coded.dictionary) + 1) + lines[real])
    return n, n - np.bincount(first // (len(coded.dictionary) + 1), minlength=len(texts))


def text_statistics(texts: pa.Array, flagged: list[str]) -> dict[str, np.ndarray]:
    words, offsets = split_words(texts)
    coded = words.dictionary_encode()
    at = coded.indices.to_numpy()
    letters = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"[^\p{L}]+", "")
    bad = pc.is_in(letters, pa.array(flagged, pa.string())).to_numpy(zero_copy_only=False)
    chars = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    plain = pc.fill_null(texts, "")
    n_lines, dup = _dup_lines(texts)

    def matches(pattern: str) -> np.ndarray:
        return pc.count_substring_regex(plain, pattern).to_numpy(zero_copy_only=False).astype(np.int64)

    return {
        "n_words": np.diff(offsets),
        "word_chars": span_sums(chars[at], offsets) if len(at) else np.zeros(len(texts), np.int64),
        "n_symbols": matches("[#*$%&|<>]"),
        "n_dup_lines": dup,
        "n_repeat_words": _repeats(hash_words(words), offsets),
        "n_lines": n_lines,
        "n_upper": matches("[A-ZÀ-ÖØ-Þ]"),
        "n_marks": matches("[!?]"),
        "n_flagged": span_sums(bad[at], offsets) if len(at) else np.zeros(len(texts), np.int64),
    }


def _measurer(flagged: list[str]):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                found = text_statistics(part.column("text"), flagged)
                columns = [part.column("doc_id"), part.column("th")]
                columns += [pa.array(found[c].astype(np.int64)) for c in (*COUNTS, *MORE)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", *COUNTS, *MORE])

    return measure


def measured(docs: DataFrame, flagged: list[str]) -> DataFrame:
    """Rule statistics, the hard rules' verdict and the forest's features of every document."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, th long, " + ", ".join(f"{c} long" for c in (*COUNTS, *MORE))
    counts = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(_measurer(flagged), shape)

    def share(part: str, whole: str) -> Column:
        return F.sqrt(F.col(part) / F.greatest(F.col(whole), F.lit(1)))

    return counts.withColumns(
        {
            "base_failed": F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"),
            "symbols": share("n_symbols", "word_chars"),
            "dup_lines": share("n_dup_lines", "n_lines"),
            "repeats": share("n_repeat_words", "n_words"),
            "upper": share("n_upper", "word_chars"),
            "marks": share("n_marks", "word_chars"),
            "flagged": share("n_flagged", "n_words"),
        }
    )


# --- labelled rows -----------------------------------------------------------------------------


def labelled_rows(labels: DataFrame) -> DataFrame:
    """All rows with a key and both labels."""
    return labels.select("doc_id", "quality", "toxic").dropna()


def flagged_words(docs: DataFrame, labelled: DataFrame) -> list[str]:
    """Words that many toxic labelled texts of a language share and its other texts lack."""
    words = F.array_distinct(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"))
    bare = F.array_distinct(F.transform(words, lambda w: F.regexp_replace(w, r"[^\p{L}]+", "")))
    language = F.coalesce("lang", F.lit("")) if "lang" in docs.columns else F.lit("")
    held = docs.select("doc_id", "text", language.alias("lang")).join(sized(labelled), "doc_id")
    sizes = held.groupBy("lang").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("all"))
    each = held.select("lang", F.explode(bare).alias("word"), "toxic").where("word != ''")
    counted = each.groupBy("lang", "word").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    lift = ((F.col("t") + 0.5) / (F.col("bad") + 1)) / (
        (F.col("n") - F.col("t") + 0.5) / (F.col("all") - F.col("bad") + 1)
    )
    found = counted.where(F.col("t") >= FLAG_LEAST).join(sizes, "lang")
    found = found.where((F.col("t") >= FLAG_SHARE * F.col("bad")) & (lift >= FLAG_LIFT))
    return sorted({r["word"] for r in found.select("word").distinct().collect()})


# --- forest ------------------------------------------------------------------------------------


def mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, float)
    more = np.maximum(n, 3.0)
    return np.where(n < 2, 0.0, np.where(n == 2, 1.0, 2 * (np.log(more - 1) + np.euler_gamma) - 2 * (more - 1) / more))


def grow_tree(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Nodes as rows of (feature, cut, left, right, path); feature -1 is a leaf."""
    limit = int(np.ceil(np.log2(max(len(rows), 2))))
    nodes: list[list[float]] = []

    def add(part: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, depth + float(mean_path(len(part)))])
        low, high = part.min(axis=0), part.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth < limit and len(part) > 1 and len(open_features):
            f = int(rng.choice(open_features))
            cut = rng.uniform(low[f], high[f])
            left = part[:, f] <= cut
            if 0 < left.sum() < len(part):
                nodes[at][:4] = [f, cut, add(part[left], depth + 1), add(part[~left], depth + 1)]
        return at

    add(rows, 0)
    return np.array(nodes)


def path_lengths(x: np.ndarray, tree: np.ndarray) -> np.ndarray:
    feature, left, right = (tree[:, i].astype(np.int64) for i in (0, 2, 3))
    at = np.zeros(len(x), np.int64)
    while True:
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            return tree[at, 4]
        goes = x[np.arange(len(x)), np.maximum(f, 0)] <= tree[at, 1]
        at = np.where(inner, np.where(goes, left[at], right[at]), at)


def forest_scores(x: np.ndarray, trees: list[np.ndarray], rows: int) -> np.ndarray:
    """Anomaly scores in (0, 1): 2 ** -(mean path / expected path)."""
    if not trees or not len(x):
        return np.zeros(len(x))
    total = sum(path_lengths(x, t) for t in trees)
    return 2.0 ** (-total / len(trees) / max(float(mean_path(rows)), 1e-9))


def rare_rows(passed: DataFrame) -> list[np.ndarray]:
    """Per feature that is above 0 in any document, at most ``STRATUM_ROWS`` of those documents."""
    held = passed.agg(*[F.max(f).alias(f) for f in FEATURES]).first()
    found = []
    for f in FEATURES:
        if (held[f] or 0.0) > 0:
            picked = hashed_sample(passed.where(F.col(f) > 0).distinct(), STRATUM_ROWS, 9, "doc_id", *FEATURES)
            found.append(picked.select(*FEATURES).toPandas().to_numpy(float))
    return [rows for rows in found if len(rows)]


def grow_forest(stats: DataFrame) -> tuple[list[np.ndarray], int]:
    """Trees on a bounded sample of the documents that pass the hard rules, grown side by side.

    Every tree also holds a document of each feature's stratum: those of all documents that have it above 0.
    """
    spark = stats.sparkSession
    passed = stats.where("NOT base_failed").select("doc_id", *FEATURES)
    picked = hashed_sample(passed, SAMPLE_ROWS, 9, "doc_id", *FEATURES)
    sample = picked.select(*FEATURES).toPandas().to_numpy(float)
    if not len(sample):
        return [], 0
    strata = rare_rows(passed)
    plain = min(TREE_ROWS - len(strata), len(sample))
    rows = plain + len(strata)

    def grow(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for tree in part["id"]:
                rng = np.random.default_rng([9, int(tree)])
                drawn = [sample[rng.choice(len(sample), plain, replace=False)]]
                drawn += [s[rng.integers(len(s), size=1)] for s in strata]
                nodes = grow_tree(np.concatenate(drawn), rng)
                yield pd.DataFrame({"tree": [tree], "nodes": [nodes.tobytes()]})

    grown = spark.range(TREES).mapInPandas(grow, "tree long, nodes binary").orderBy("tree").collect()
    return [np.frombuffer(r["nodes"]).reshape(-1, 5) for r in grown], rows


def scored(stats: DataFrame, trees: list[np.ndarray], rows: int) -> DataFrame:
    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(score=forest_scores(part[FEATURES].to_numpy(float), trees, rows))

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema) + ", score double"
    return stats.mapInPandas(score, shape)


def clean_rows(stats: DataFrame, labelled: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of the clean labelled documents that pass the hard rules."""
    clean = sized(labelled.where("quality = 1 AND toxic = 0").select("doc_id"))
    return stats.where("NOT base_failed").join(clean, "doc_id").select(*columns)


def values_at(known: DataFrame, rank: Callable[[int], int]) -> dict[str, float]:
    """Per column of ``known`` the value at the 0-based ``rank`` of its row count, in ascending order.

    Equal values are counted first; running counts over range partitions then find the rank.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in known.columns])
    counts = materialise(known.select(F.inline(pairs)).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n")))
    rows = counts.where(F.col("name") == known.columns[0]).agg(F.sum("n")).first()[0]
    if not rows:
        return {}
    upto = running(counts, ["name"], ["value"], {"upto": Running("sum", "n")})
    found = upto.where(F.col("upto") > rank(rows)).groupBy("name").agg(F.min("value").alias("value")).collect()
    return {r["name"]: float(r["value"]) for r in found}


def clean_allowances(stats: DataFrame, labelled: DataFrame, clean_loss: float) -> dict[str, float]:
    """Per feature what clean labelled documents reach; at most half of ``clean_loss`` of them exceed any."""
    share = 1 - clean_loss / 2 / len(FEATURES)
    found = values_at(clean_rows(stats, labelled, *FEATURES), lambda n: int(np.ceil((n - 1) * share)))
    return {f: found.get(f, 0.0) for f in FEATURES}


def threshold(stats: DataFrame, labelled: DataFrame, clean_loss: float) -> float:
    """The score that all but ``clean_loss`` of the clean labelled documents stay at or under."""
    scores = clean_rows(stats, labelled, "score")
    return values_at(scores, lambda n: min(n - 1, int(np.ceil((1 - clean_loss) * n)) - 1)).get("score", 1.0)


def quality(docs: DataFrame, labels: DataFrame, *, clean_loss: float = 0.002) -> DataFrame:
    """Per document its rule statistics, ``base_failed``, ``kept``, the anomaly ``score`` and the text's hash ``th``."""
    labelled = materialise(labelled_rows(labels))
    words = flagged_words(docs, labelled)
    stats = materialise(measured(docs, words))
    allowed = clean_allowances(stats, labelled, clean_loss)
    stats = stats.withColumns({f: F.greatest(F.col(f) - a, F.lit(0.0)) for f, a in allowed.items()})
    judged = materialise(scored(stats, *grow_forest(stats)))
    limit = threshold(judged, labelled, clean_loss)
    return judged.select(
        "doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("score") <= limit)).alias("kept"), "score", "th"
    )


def keep_good(docs: DataFrame, labels: DataFrame, *, clean_loss: float = 0.002) -> DataFrame:
    """``docs`` without the documents that the rules reject."""
    rejected = materialise(quality(docs, labels, clean_loss=clean_loss).where("NOT kept").select("doc_id", "th").distinct())
    return without(docs, rejected)
