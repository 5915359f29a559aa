"""Line de-duplication within an edit bound of one character, by deletion neighbourhoods.

A line with a word goes when an earlier line is equal to it or, from ``min_chars`` characters on, one edit
away: shorter lines would meet by accident. A line without a word goes if it has ``min_chars`` characters
and an earlier one is equal or one edit away. Order is (key, text hash, line number), null keys last.

1. Equal lines are grouped by a 128-bit hash; the earliest occurrence owns the line.
2. Lines one edit apart agree on a half. Hashes of the halves, tagged with the longer line's length,
   find the lines that could have a partner. Those agree before and after a block as well (about ``BLOCK``
   characters, or a 64th of a very long line): hashes of what lies around each block, which cost a long
   line many times its length, are taken of them only. All others need no variants.
3. Those lines emit every one-character deletion of the block as a hashed key. Lines that agree
   after deleting at the same place are one substitution apart; a line that equals another's
   deletion is one insertion apart. Each key keeps its earliest line, so a key with many lines
   costs a row per line and no pairs.
4. The line and the earliest partner are verified with the edit distance on their texts.

Only DataFrame functions are used. Defined results: a null text stays null with 0 lines; an empty
text is one empty line; rows with equal key and text count as one document and keep the same
lines; an empty table gives no rows; other columns are passed through, whatever they are called (but
``n_lines`` and ``n_removed`` are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope.llm.joins import same_doc, sized, whole_rows
from cargoscope.session import materialise

BLOCK, MAX_BLOCKS = 256, 64
MIN_CHARS = 24
#: A character that makes a line more than white space.
WORD = r"[^\x20\x09-\x0D]"

_ORDER = ["no_key", "doc_id", "th", "pos"]


def _measured(df: DataFrame, line: str) -> DataFrame:
    """The line's length and, for a partner of the same or one more character, block count and size.

    They are columns of their own, so that they are computed once and not for every block.
    """
    df = df.withColumn("_n", F.length(line))
    counts = {
        f"_count{k}": F.greatest(F.lit(2), F.least(F.ceil((F.col("_n") + k) / BLOCK), F.lit(MAX_BLOCKS))).cast("int")
        for k in (0, 1)
    }
    df = df.withColumns(counts)
    return df.withColumns({f"_size{k}": F.ceil((F.col("_n") + k) / F.col(f"_count{k}")).cast("int") for k in (0, 1)})


def _blocks(line: str) -> Column:
    """Around-the-block hashes of a measured line, for partners with ``longer`` more characters.

    Structs of hash, the characters before and after the block, and ``longer``.
    """

    def sides(longer: int) -> Column:
        def one(j: Column) -> Column:
            before = F.least(j * F.col(f"_size{longer}"), F.col("_n"))
            after = F.greatest(F.lit(0), F.col("_n") + longer - (j + 1) * F.col(f"_size{longer}"))
            return F.struct(j.alias("j"), before.alias("before"), after.alias("after"), F.lit(longer).alias("longer"))

        return F.transform(F.sequence(F.lit(0), F.col(f"_count{longer}") - 1), one)

    def hashed(b: Column) -> Column:
        lead = F.substring(F.col(line), F.lit(1), b["before"])
        rest = F.substring(F.col(line), F.col("_n") - b["after"] + 1, b["after"])
        around = F.xxhash64(F.col("_n") + b["longer"], b["j"], lead, rest)
        return F.struct(around.alias("around"), b["before"].alias("before"), b["after"].alias("after"), b["longer"].alias("longer"))

    others = F.transform(F.concat(sides(0), sides(1)), hashed)
    # Nearly all lines have two blocks: four plain expressions, without a function called per block.
    return F.when(F.col("_count1") == 2, F.array(*_halves(line))).otherwise(others)


def _halves(line: str) -> list[Column]:
    """The same structs for a measured line cut into two blocks, however long it is."""

    # Where every character is a byte, parts are cut out of the bytes: no character is looked for, the hash is the same.
    def part(first: Column, size: Column) -> Column:
        chars = F.substring(F.col(line), first, size)
        raw = F.substring(F.col(line).cast("binary"), first, size)
        return F.when(F.octet_length(line) == F.col("_n"), raw).otherwise(chars.cast("binary"))

    def half(longer: int, second: bool) -> Column:
        size = F.expr(f"(_n + {longer + 1}) DIV 2").cast("int")
        before, after = (size, F.lit(0)) if second else (F.lit(0), F.col("_n") + longer - size)
        before = F.least(before, F.col("_n"))
        rest = part(F.lit(1), before) if second else part(F.col("_n") - after + 1, after)
        around = F.xxhash64(F.col("_n") + longer, F.lit(int(second)), rest)
        return F.struct(around.alias("around"), before.alias("before"), after.alias("after"), F.lit(longer).alias("longer"))

    return [half(longer, second) for longer in (0, 1) for second in (False, True)]


def _earlier_neighbours(base: DataFrame, occurrences: DataFrame, owners: DataFrame) -> DataFrame:
    """Hashes (h1, h2) of lines with an earlier line one edit away."""

    def repeated(keyed: DataFrame) -> DataFrame:
        """Hashes that two different lines have."""
        return keyed.groupBy("around").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a != b").select("around")

    keyed = occurrences.select("h1", F.explode("halves").alias("around"))
    lines = keyed.join(repeated(keyed), "around").select("h1").distinct()
    wanted = materialise(
        owners.join(lines, "h1").select("h1", "h2", *[F.col(f"first.{c}").alias(c) for c in _ORDER])
    )
    per_doc = materialise(
        wanted.groupBy("no_key", "doc_id", "th").agg(F.collect_list(F.struct("pos", "h1", "h2")).alias("wanted"))
    )
    found = (
        base.join(sized(per_doc, F.size("wanted")), same_doc(base, per_doc))
        .select(per_doc["no_key"], per_doc["doc_id"], per_doc["th"], "lines", F.explode("wanted").alias("w"))
        .select("no_key", "doc_id", "th", F.col("w.pos").alias("pos"), "w.h1", "w.h2", F.expr("lines[w.pos]").alias("line"))
        .distinct()
    )
    found = materialise(found)
    blocks = _measured(found, "line").withColumn("b", F.explode(_blocks("line")))
    shared = repeated(blocks.select("h1", "b.around")).withColumnRenamed("around", "_k")
    each = blocks.join(shared, F.col("b.around") == F.col("_k"), "left_semi")
    middle = F.expr("substring(line, b.before + 1, length(line) - b.before - b.after)")
    each = each.select(F.struct(*_ORDER).alias("own"), "h1", "h2", "b", middle.alias("middle"))
    at = F.sequence(F.lit(1), F.length("middle"))

    def without(i: Column) -> Column:
        return F.concat(F.substring("middle", F.lit(1), i - 1), F.substring(F.col("middle"), i + 1, F.length("middle")))

    # kind 0: deleted at this place; kind 1: deleted anywhere; kind 2: this line itself, shorter.
    variants = F.when(
        F.col("b.longer") == 0,
        F.concat(
            F.transform(at, lambda i: F.struct(F.xxhash64("b.around", F.lit(0), i, without(i)).alias("v"), F.lit(0).alias("kind"))),
            F.transform(at, lambda i: F.struct(F.xxhash64("b.around", F.lit(1), without(i)).alias("v"), F.lit(1).alias("kind"))),
        ),
    ).otherwise(F.array(F.struct(F.xxhash64("b.around", F.lit(1), "middle").alias("v"), F.lit(2).alias("kind"))))
    emitted = each.where("length(middle) > 0 OR b.longer = 1").select("own", "h1", "h2", F.explode(variants).alias("e"))
    emitted = materialise(emitted.select("own", "h1", "h2", "e.v", "e.kind").distinct())
    classes = emitted.groupBy("v").agg(
        F.min(F.when(F.col("kind") == 2, F.col("own"))).alias("whole"),
        F.min(F.when(F.col("kind") != 2, F.col("own"))).alias("cut"),
        F.count(F.lit(1)).alias("n"),
    )
    met = emitted.join(classes.where("n > 1"), "v")
    partner = F.when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("cut"))
    best = met.withColumn("partner", partner).where("partner < own").groupBy("h1", "h2").agg(F.min("partner").alias("partner"))
    text = found.select("h1", "h2", "line")
    theirs = found.select(F.struct(*_ORDER).alias("partner"), F.col("line").alias("earlier"))
    verified = best.join(text, ["h1", "h2"]).join(theirs, "partner")
    return verified.where(F.levenshtein("line", "earlier") <= 1).select("h1", "h2").distinct()


def dedup_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with their remaining ``text``, and the columns ``n_lines`` and ``n_removed``."""

    def judged(x: Column) -> Column:
        return (F.length(x) >= min_chars) | x.rlike(WORD)

    base = whole_rows(docs).withColumn("lines", F.split("text", "\n"))
    found = base.select(F.isnull("doc_id").alias("no_key"), "doc_id", "th", F.posexplode_outer("lines").alias("pos", "line"))
    found = found.where(judged(F.col("line")))
    occurrences = _measured(found, "line").select(
        *_ORDER,
        F.xxhash64("line").alias("h1"),
        F.xxhash64(F.lit(6), "line").alias("h2"),
        F.when(F.col("_n") >= min_chars, F.array(*[h["around"] for h in _halves("line")])).alias("halves"),
    )
    occurrences = materialise(occurrences)
    places = occurrences.select("h1", "h2", F.struct(*_ORDER).alias("at"))
    owners = materialise(places.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")))
    near = materialise(_earlier_neighbours(base, occurrences, owners))
    marked = owners.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").where("n > 1 OR near")
    gone = places.join(marked, ["h1", "h2"]).where(F.col("near") | (F.col("at") != F.col("first")))
    per_doc = materialise(gone.groupBy("at.doc_id", "at.th").agg(F.collect_set("at.pos").alias("gone")))
    joined = base.join(sized(per_doc, F.size("gone")), same_doc(base, per_doc), "left")
    # The difference of two sets of places goes by hashing, so a text of very many lines costs no more per line.
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    others = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return joined.withColumn("kept", F.when(F.isnull("gone"), F.col("text")).otherwise(kept)).select(
        *others,
        F.col("kept").alias("text"),
        F.coalesce(F.array_size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def lines_sql(documents: str, min_chars: int = MIN_CHARS) -> str:
    """DuckDB query for ``dedup_lines`` on a table with unique keys."""
    return f"""WITH raw AS (
    SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM {documents}
), lines AS (
    SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM raw
), owners AS (
    SELECT line, min((doc_id, pos)) AS first FROM lines
    WHERE length(line) >= {min_chars} OR regexp_matches(line, '{WORD}') GROUP BY line
), cuts AS (
    SELECT line, first, i, left(line, i - 1) || substr(line, i + 1) AS cut
    FROM (SELECT * FROM owners WHERE length(line) >= {min_chars}), LATERAL (SELECT unnest(range(1, length(line) + 1)) AS i)
), same_place AS (
    SELECT length(line) AS n, i, cut, min(first) AS earliest FROM cuts GROUP BY ALL HAVING count(*) > 1
), shorter AS (
    SELECT c.line, c.first, o.line AS cut, o.first AS cut_first
    FROM cuts c JOIN owners o ON o.line = c.cut WHERE length(o.line) >= {min_chars}
), near AS (
    SELECT c.line FROM cuts c JOIN same_place s
        ON s.n = length(c.line) AND s.i = c.i AND s.cut = c.cut WHERE s.earliest < c.first
    UNION
    SELECT line FROM shorter WHERE cut_first < first
    UNION
    SELECT cut FROM shorter WHERE first < cut_first
), judged AS (
    SELECT l.doc_id, l.pos, l.line, o.line IS NULL OR (o.first = (l.doc_id, l.pos) AND n.line IS NULL) AS stays
    FROM lines l LEFT JOIN owners o ON o.line = l.line LEFT JOIN near n ON n.line = l.line
), joined AS (
    SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '') AS text,
        count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed
    FROM judged GROUP BY doc_id
)
SELECT r.doc_id, j.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM {documents} r LEFT JOIN joined j USING (doc_id)"""
