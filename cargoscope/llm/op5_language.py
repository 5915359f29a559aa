"""Language of whole texts by nearest centroid.

A text is a normalised TF-IDF vector of hashed 2- and 3-byte grams of its lower-cased letters.
Every language has several centroids (spherical k-means); a text gets the language of the centroid
with the largest cosine, and is marked rejected if it is further away than that centroid's own
texts.

Bounded and documented: centroids are fitted on at most ``SAMPLE_PER_LANGUAGE`` training texts per
language (lowest hashes). Document frequencies count every training text; every text is predicted.

Defined results: ``und`` with score 0 for a null text, one without a letter, and all texts when
nothing was learned; a null key counts as the empty text in the fold rule; repeated rows are
predicted alike; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargoscope.llm.batches import bound_batches, by_bytes
from cargoscope.llm.shingles import mix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIMENSIONS = 4096
CENTROIDS, ROUNDS = 4, 12
SAMPLE_PER_LANGUAGE = 800
#: Texts closer than this share of a centroid's own least similar texts are accepted.
SLACK = 0.8
UNKNOWN = "und"


def gram_counts(texts: pa.Array) -> np.ndarray:
    """Counts of hashed grams: one row per text."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}]+", " ")
    lengths = pc.binary_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer("".join(plain.to_pylist()).encode(), np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    out = np.zeros(len(texts) * DIMENSIONS, np.int64)
    for n in (2, 3):
        if len(raw) < n:
            continue
        code = reduce(lambda c, k: c | (raw[k : len(raw) - n + 1 + k] << np.uint64(8 * k)), range(n), np.uint64(n << 40))
        inside = row[: len(code)] == row[n - 1 :]
        at = (mix(code[inside]) % np.uint64(DIMENSIONS)).astype(np.int64)
        out += np.bincount(row[: len(code)][inside] * DIMENSIONS + at, minlength=len(out))
    return out.reshape(len(texts), DIMENSIONS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(counts.astype(np.float32)) * idf
    return weighted / np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in by_bytes(batch, "text", 2 << 20):
        for first in range(0, part.num_rows, 500):
            yield part.slice(first, 500)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, texts = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for part in _parts(batch):
            total += (gram_counts(part.column("text")) > 0).sum(axis=0)
            texts += part.num_rows
    gram = np.arange(-1, DIMENSIONS)  # gram -1 counts the texts
    yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(np.concatenate([[texts], total]))], ["gram", "n"])


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """Smoothed idf of every gram over all rows of ``texts``: ``DIMENSIONS`` numbers."""
    summed = texts.select("text").mapInArrow(_frequencies, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = {r["gram"]: r["n"] for r in summed.collect()}
    df = np.array([found.get(i, 0) for i in range(DIMENSIONS)], np.float32)
    return (np.log((1 + found.get(-1, 0)) / (1 + df)) + 1).astype(np.float32)


def cluster(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Spherical k-means; the first centres are spread out."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    for _ in range(min(k, len(x)) - 1):
        far = 1 - np.max(x @ np.array(centres).T, axis=1)
        centres.append(x[int(np.argmax(far))])
    c = np.array(centres)
    for _ in range(ROUNDS):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.array([x[near == i].sum(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def _fitter(idf: np.ndarray):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", "text"])
        texts = pa.array(pdf["text"].tolist(), pa.string())
        x = vectors(np.concatenate([gram_counts(texts.slice(i, 100)) for i in range(0, len(texts), 100)]), idf)
        x = x[np.linalg.norm(x, axis=1) > 0]
        if not len(x):
            return pd.DataFrame({"lang": [], "centre": [], "reach": []})
        c = cluster(x, CENTROIDS, 5)
        sims = x @ c.T
        near = np.argmax(sims, axis=1)
        rows = [(c[i], np.quantile(sims[near == i, i], 0.01)) for i in range(len(c)) if (near == i).any()]
        return pd.DataFrame(
            {"lang": pdf["lang"].iloc[0], "centre": [r[0].astype("<f4").tobytes() for r in rows], "reach": [float(r[1]) for r in rows]}
        )

    return fit


def training_sample(train: DataFrame) -> DataFrame:
    """At most ``SAMPLE_PER_LANGUAGE`` texts of each language: those with the lowest hashes.

    A cut on the hash, from the language's count, leaves a few times the rows before they are ranked.
    """
    sizes = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.lit(4.0 * SAMPLE_PER_LANGUAGE) / F.col("n")
    hashed = train.withColumn("_h", F.xxhash64(F.lit(5), "doc_id", "lang"))
    cut = hashed.join(F.broadcast(sizes.select("lang", share.alias("share"))), "lang").where(
        F.pmod("_h", F.lit(1 << 40)) < F.col("share") * float(1 << 40)
    )
    lowest = Window.partitionBy("lang").orderBy("_h", "doc_id", "text")
    return cut.withColumn("_r", F.row_number().over(lowest)).where(F.col("_r") <= SAMPLE_PER_LANGUAGE).drop("_r", "share")


def _predictor(idf: np.ndarray, centres: np.ndarray, langs: list[str], reach: np.ndarray):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                text = part.column("text")
                readable = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                if len(langs):
                    sims = vectors(gram_counts(text), idf) @ centres.T
                    best = np.argmax(sims, axis=1)
                    top = np.clip(sims[np.arange(len(best)), best], 0, 1).astype(float)
                    near = top >= SLACK * reach[best]
                else:
                    readable, best, top, near = readable & False, np.zeros(len(text), int), np.zeros(len(text)), readable
                found = [langs[i] if ok else UNKNOWN for i, ok in zip(best, readable, strict=True)]
                columns = [
                    part.column("doc_id"),
                    part.column("held_out"),
                    pa.array(found, pa.string()),
                    pa.array(np.where(readable, top, 0.0)),
                    pa.array(~(readable & near)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return predict


def held_out(key: str = "doc_id") -> Column:
    """Documents that are never learned from."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled training documents and predict every document."""
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    train = rows.where("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    idf = inverse_frequencies(train)
    fitted = training_sample(train).groupBy("lang").applyInPandas(_fitter(idf), "lang string, centre binary, reach double")
    found = sorted(fitted.collect(), key=lambda r: (r["lang"], bytes(r["centre"])))
    centres = np.array([np.frombuffer(r["centre"], "<f4") for r in found]).reshape(-1, DIMENSIONS)
    reach = np.array([r["reach"] for r in found])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "held_out").mapInArrow(
        _predictor(idf, centres, [r["lang"] for r in found], reach),
        f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean",
    )
