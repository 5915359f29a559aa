"""Benchmark decontamination by spaced-seed hashing.

A document overlaps an item when, for some alignment, a window of ``WINDOW`` consecutive words of
the item (the whole item if it is shorter) agrees with the document in at least 80 % of its words;
items under ``MIN_WORDS`` words overlap nothing. Words are runs of letters and digits, lower-cased.

Seeds are hashes of the words at the places of a fixed mask; the places between them are ignored.
``MASK`` fits inside every window of 13 words with 2 substitutions at least once, and one of
``SHORT_MASKS`` inside every shorter window, so no overlap is missed. Seeds of the test items are
joined with the seeds from every place of every document; a hit names an alignment, which is then
verified on the words around it.

Only DataFrame functions are used. Defined results: a null or empty text overlaps nothing; repeated
items are items of their own, rows with equal key and text are judged alike; null item texts are
ignored; an empty table on either side gives no overlaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope.llm.joins import same_doc, sized, without
from cargoscope.session import materialise

WINDOW, MIN_WORDS, PERCENT = 13, 8, 80
# Places of the words that a seed looks at.
MASK = (0, 1, 3, 6, 7)
SHORT_MASKS = ((0, 1, 2, 4), (0, 1, 4, 5))


def words(text: str) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _seeds(column: str, mask: tuple[int, ...]) -> Column:
    """Hashes at every place where the whole mask fits; the mask is part of the hash."""
    last = F.size(column) - mask[-1]
    tag = F.lit("".join(map(str, mask)))
    return F.when(
        last > 0,
        F.transform(
            F.sequence(F.lit(0), last - 1),
            lambda i: F.xxhash64(tag, *[F.get(column, i + k) for k in mask]),
        ),
    )


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, th, item_id, matches``: overlapping pairs with the best window's equal words.

    ``th`` is the text's hash, which tells rows with the same key apart.
    """
    items = benchmark.where("text IS NOT NULL").select("item_id", words("text").alias("iw"))
    items = materialise(
        items.where(F.size("iw") >= MIN_WORDS).withColumn("item_no", F.monotonically_increasing_id())
    )
    masks = [MASK]
    if not items.where(F.size("iw") < WINDOW).isEmpty():
        masks += SHORT_MASKS

    def seeds(column: str) -> Column:
        found = [_seeds(column, m) for m in masks]
        return F.explode(F.flatten(F.array_compact(F.array(*[F.transform(s, lambda v, i: F.struct(i.alias("at"), v.alias("seed"))) for s in found]))))

    test = materialise(items.select("item_no", seeds("iw").alias("s")).select("item_no", "s.at", "s.seed"))
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), words("text").alias("dw"))
    train = base.select("doc_id", "th", seeds("dw").alias("s")).select("doc_id", "th", F.col("s.at").alias("d_at"), "s.seed")
    hits = train.join(sized(test), "seed").select("doc_id", "th", "item_no", (F.col("d_at") - F.col("at")).alias("shift"))
    hits = materialise(
        hits.distinct().groupBy("doc_id", "th").agg(F.collect_list(F.struct("item_no", "shift")).alias("hits"))
    )
    near = (
        base.join(sized(hits, F.size("hits")), same_doc(base, hits))
        .select(hits["doc_id"], hits["th"], "dw", F.explode("hits").alias("hit"))
        .select("doc_id", "th", "dw", "hit.item_no", "hit.shift")
        .join(sized(items, F.size("iw")), "item_no")
    )
    equal = F.expr(
        "transform(iw, (w, i) -> CASE WHEN i + shift >= 0 AND get(dw, CAST(i + shift AS INT)) = w THEN 1 ELSE 0 END)"
    )
    span = F.least(F.lit(WINDOW), F.size("iw"))
    best = F.expr(
        "array_max(transform(sequence(0, size(iw) - span), s -> aggregate(slice(equal, s + 1, span), 0, (a, x) -> a + x)))"
    )
    judged = near.withColumns({"equal": equal, "span": span}).withColumn("matches", best)
    return (
        judged.where(100 * F.col("matches") >= PERCENT * F.col("span"))
        .groupBy("doc_id", "th", "item_id", "item_no")
        .agg(F.max("matches").alias("matches"))
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``contaminated``, the number of overlapping items and the smallest."""
    found = materialise(
        overlaps(docs, benchmark)
        .groupBy("doc_id", "th")
        .agg(F.count(F.lit(1)).alias("n_items"), F.min("item_id").alias("first_item"), F.max("matches").cast("long").alias("matches"))
    )
    keys = docs.select("doc_id", F.xxhash64("text").alias("th"))
    return keys.join(sized(found), same_doc(keys, found), "left").select(
        keys["doc_id"],
        F.isnotnull("n_items").alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        "first_item",
        F.coalesce("matches", F.lit(0)).alias("matches"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that overlap an item."""
    found = materialise(overlaps(docs, benchmark).select("doc_id", "th").distinct())
    return without(docs, found)


def found_ctes(documents: str, prefix: str = "") -> str:
    """DuckDB common table expressions that try every alignment sharing a word, without seeds.

    The last one, ``<prefix>found``, has a row per overlapping document.
    """
    return f"""{prefix}items AS (
    SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS iw
    FROM benchmark WHERE text IS NOT NULL
), {prefix}item_words AS (
    SELECT item_id, len(iw) AS n, unnest(iw) AS w, unnest(range(len(iw))) AS i FROM {prefix}items WHERE len(iw) >= {MIN_WORDS}
), {prefix}docs AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS dw FROM {documents}
), {prefix}doc_words AS (
    SELECT doc_id, unnest(dw) AS w, unnest(range(len(dw))) AS d FROM {prefix}docs
), {prefix}pairs AS (
    SELECT doc_id, item_id, least(n, {WINDOW}) AS span, d - i AS shift, i
    FROM {prefix}doc_words JOIN {prefix}item_words USING (w)
), {prefix}aligned AS (
    SELECT doc_id, item_id, span, shift, list(i) AS places FROM {prefix}pairs
    GROUP BY ALL HAVING 100 * count(*) >= {PERCENT} * span
), {prefix}windows AS (
    SELECT doc_id, item_id, span, unnest(places) AS s, places FROM {prefix}aligned
), {prefix}best AS (
    SELECT doc_id, item_id, span, max(len(list_filter(places, lambda x: x >= s AND x < s + span))) AS matches
    FROM {prefix}windows GROUP BY ALL
), {prefix}found AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items, min(item_id) AS first_item, max(matches) AS matches
    FROM {prefix}best WHERE 100 * matches >= {PERCENT} * span GROUP BY doc_id
)"""


def contamination_sql(documents: str) -> str:
    return f"""WITH {found_ctes(documents)}
SELECT r.doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, first_item,
    coalesce(matches, 0) AS matches
FROM {documents} r LEFT JOIN found f USING (doc_id)"""
