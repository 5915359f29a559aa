"""Mixing sources to target weights by hash-threshold histograms.

Every source gets a target from its weight, held at ``most`` times its size. A source's documents are
taken whole: ``target div size`` times all of them, and once more those whose mark, an MD5 of key and
text, is lowest. Nothing is sorted: words are summed by source and leading digits of the mark (at most
4096 buckets a source), the bucket that holds the threshold is refined by the next digits, and the
rows are filtered by the threshold found. A smaller target takes a part of what a larger one takes.

The threshold falls on one document; it is taken where that comes nearer to the target, so a source
misses its target by half of one document at most.

Defined results: a null text or a text without words has size 0; a null source is a source of its own,
the last one; a null key counts as empty in the mark. Equal rows are told apart by their place in the
scan (they are alike, so reruns give the same rows). All sizes 0: targets 0 and nothing taken; no rows
give no rows. Columns other than ``doc_id``, ``text`` and ``source`` are not read; ``full`` returns the
whole row, whatever its columns are called, as the struct ``row``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cargoscope.llm.joins import sized
from cargoscope.operators.segments import positions
from cargoscope.session import materialise

WEIGHTS = (5, 2, 1)
MOST = 3
#: Hexadecimal digits of the mark that one histogram tells apart.
DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"


def words_of(text: str) -> F.Column:
    """Number of words: each becomes one letter, then the white space goes."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), SPACE, "")).cast("long")


def measured(docs: DataFrame, full: bool = False) -> DataFrame:
    """Key, source, size and mark of every row, written once."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    mark = F.concat(
        F.md5(F.concat(key, F.lit(":"), F.coalesce("text", F.lit("")))),
        F.lpad(F.lower(F.hex(F.monotonically_increasing_id())), 16, "0"),
    )
    row = [F.struct("*").alias("row")] if full else []
    return materialise(docs.select("doc_id", "source", words_of("text").alias("size"), mark.alias("mark"), *row))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` for a table of one row per source (source, source_size).

    Sources above ``most`` times their size are held there and leave the sharing; each round does so for
    all that are above at once, from two sums over the sources.
    """
    ranked = positions(sizes.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], "_i").drop("_null")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_i") % len(weights) + 1).cast("int"))
    ranked = materialise(ranked.withColumn("_w", weight.cast("long")).drop("_i"))
    total, shares = ranked.agg(F.sum("source_size"), F.sum("_w")).first()
    if total is None:
        return ranked.select("source", "source_size", F.lit(0.0).alias("target"))
    rest, left, held = total, shares, F.lit(False)
    while True:
        wide = "decimal(38,0)"
        held = F.lit(most).cast(wide) * F.col("source_size") * F.lit(left).cast(wide) <= F.lit(rest).cast(wide) * F.col("_w")
        size, free = ranked.agg(F.sum(F.when(held, F.col("source_size"))), F.sum(F.when(~held, F.col("_w")))).first()
        if free is None or (total - most * (size or 0), free) == (rest, left):
            break
        rest, left = total - most * (size or 0), free
    share = (F.col("_w") * F.lit(rest)).cast("double") / F.lit(float(left))
    return ranked.select(
        "source", "source_size", F.when(held, (F.col("source_size") * most).cast("double")).otherwise(share).alias("target")
    )


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(source, full, upto, closed)``: all rows ``full`` times, and once more those with a mark below ``upto``.

    ``closed``: the document at ``upto`` (a leading part of its mark) is taken too.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = wanted.withColumn("full", whole.cast("long"))
    plan = materialise(plan.withColumn("rest", F.col("target") - (F.col("full") * F.col("source_size")).cast("double")))
    state = plan.where("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("base"), F.lit("").alias("upto"))
    found, chars = None, 0
    # The last digits are the row's place, so at the latest the whole mark tells two rows apart.
    while not state.isEmpty():
        chars += DIGITS
        state = materialise(_refined(rows, state, chars))
        done = state.where("n = 1")
        found = done if found is None else found.unionByName(done)
        state = state.where("n > 1").select("source", "rest", "base", "upto")
        rows = materialise(_inside(rows, state)) if not state.isEmpty() else rows
    if found is None:
        return plan.select("source", "full", F.lit(None).cast("string").alias("upto"), F.lit(False).alias("closed"))
    nearer = F.col("base") + F.col("words") - F.col("rest") < F.col("rest") - F.col("base")
    found = found.select(F.col("source").alias("_s"), "upto", nearer.alias("closed"))
    return plan.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "full", "upto", "closed")


def _inside(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of each source's boundary bucket."""
    edge = sized(state.select(F.col("source").alias("_s"), "upto"))
    here = F.col("source").eqNullSafe(F.col("_s")) & F.col("mark").startswith(F.col("upto"))
    return rows.join(edge, here).select("source", "size", "mark")


def _refined(rows: DataFrame, state: DataFrame, chars: int) -> DataFrame:
    """The bucket of ``chars`` leading digits in which the words run over what is wanted."""
    hist = rows.groupBy("source", F.substring("mark", 1, chars).alias("cut")).agg(
        F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")
    )
    before = Window.partitionBy("source").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    below = hist.withColumn("below", F.coalesce(F.sum("words").over(before), F.lit(0)))
    goal = state.select(F.col("source").alias("_s"), "rest", F.col("base").alias("_b"))
    over = below.join(goal, F.col("source").eqNullSafe(F.col("_s"))).where(
        "_b + below <= rest AND _b + below + words > rest"
    )
    return over.select("source", "rest", (F.col("_b") + F.col("below")).alias("base"), F.col("cut").alias("upto"), "words", "n")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, full: bool = False) -> DataFrame:
    """Per row its size, its source's size and target, ``copies`` and ``taken`` (copies x size)."""
    rows = measured(docs, full)
    sizes = materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    wanted = materialise(targets(sizes, weights, most))
    edges = thresholds(rows, wanted).select(F.col("source").alias("_e"), "full", "upto", "closed")
    plan = wanted.join(edges, F.col("source").eqNullSafe(F.col("_e"))).drop("_e").withColumnRenamed("source", "_s")
    cut = F.substring("mark", F.lit(1), F.length("upto"))
    more = F.coalesce((cut < F.col("upto")) | (F.col("closed") & (cut == F.col("upto"))), F.lit(False))
    joined = rows.join(sized(materialise(plan)), F.col("source").eqNullSafe(F.col("_s")))
    copies = F.col("full") + more.cast("long")
    row = ["row"] if full else []
    return joined.select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), *row
    )


def mixed_rows(mix_of: DataFrame) -> DataFrame:
    """The mix itself, from ``mix(..., full=True)``: every row as often as it is taken."""
    return mix_of.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


def mixing_sql(table: str, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> str:
    """The same rows in DuckDB: sources in the order in which they reach their limit, documents in that of their marks."""
    listed = ", ".join(map(str, weights))
    return rf"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS mark
    FROM {table}),
sources AS (
    SELECT source, sum(size)::BIGINT AS s, list_extract([{listed}], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1 AS INT)) AS w
    FROM sized GROUP BY source),
ordered AS (
    SELECT *, row_number() OVER (ORDER BY s::HUGEINT * {most} / w::DOUBLE, source NULLS LAST) AS k, sum(s) OVER () AS total
    FROM sources),
stages AS (
    SELECT *, total - {most} * coalesce(sum(s) OVER before, 0) AS r, sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w
    FROM ordered WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stop AS (
    SELECT min(k) AS k, arg_min(r, k) AS r, arg_min(left_w, k) AS left_w FROM stages WHERE {most} * s * left_w > r * w),
goals AS (
    SELECT source, s, CASE WHEN stop.k IS NULL OR o.k < stop.k THEN ({most} * s)::DOUBLE ELSE (w * stop.r)::DOUBLE / stop.left_w::DOUBLE END AS target
    FROM ordered o, stop),
plan AS (
    SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS whole FROM goals),
running AS (
    SELECT d.*, p.s, p.target, p.whole, p.target - p.whole * p.s AS rest,
           coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
    FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, s AS source_size, target,
       CAST(size * (whole + CASE WHEN below + size <= rest OR below <= rest AND below + size - rest < rest - below THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(whole + CASE WHEN rest > 0 AND (below + size <= rest OR below <= rest AND below + size - rest < rest - below) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM running"""
