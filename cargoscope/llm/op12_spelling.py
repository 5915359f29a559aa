"""Spelling variant grouping by k-d trees over letter-count vectors.

Words one edit apart have letter counts at an L1 distance of two at most: a replaced letter takes one
count down and one up, an inserted letter takes one count up. For every word length the words lie in a
k-d tree whose upper part is grown from counts over all words, three letters a round, until a cell holds
at most ``CELL_WORDS`` words. Every word is looked for in the cells of its own length and of the next
one that its steps can reach. A cell's words form a k-d tree of their own inside a task; boxes out of
reach are pruned, the letter counts compared in the leaves, and then the order of the letters is verified.

Each pair of near words is found in one cell only (the cell of the later or longer word) and is counted
for both words there, so what leaves a cell is one row per word. A cell of words that are all alike in
their letters (no cut is possible, nor are two of them near) is dealt to slices instead.

Defined results: a null text has no words, a null key counts as empty; a word's letters are those of
``A-Za-z`` and U+00C0 to U+00FF; repeated rows count again; ties of a form go to the smallest word; an empty
table, or one without words, gives no rows. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoscope.llm.batches import bound_batches, by_bytes
from cargoscope.llm.joins import sized
from cargoscope.llm.kdtree import Node, grow, letter_counts, reach
from cargoscope.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST_LETTERS = 7
LEAST_COUNT = 2
FORM_RATIO = 10
#: Words of one cell: what a task holds at a time.
CELL_WORDS = 6000
#: Letters by which one round cuts a cell that is still too large.
CUTS = 3
LEAF_WORDS = 128
#: Of one letter, so many count in the product that compares letter counts; more make it a bound.
COUNTED = 4
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Cells grow beyond ``CELL_WORDS`` rather than in number, so that the upper trees stay small.
MOST_CELLS = 20_000
#: Characters from which a text's runs are counted one by one, not listed.
LONG_TEXT = 4 << 20
SLIP = 31


def slipped(prefix: int, run: str) -> str:
    """The run, without one letter where the checksum of key and run says so (``prefix``: that of the key)."""
    h = zlib.crc32(run.encode(), prefix)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counter(least: int) -> Callable:
    # A shorter run cannot give a word: letters are only taken away.
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def handed(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for part in by_bytes(batch, "text"):
                keys = pc.fill_null(part.column("doc_id").cast(pa.string()), "").to_pylist()
                texts = pc.ascii_lower(pc.fill_null(part.column("text"), "")).to_pylist()
                for key, text in zip(keys, texts, strict=True):
                    prefix = zlib.crc32(f"{key}:".encode())
                    found = runs.findall(text) if len(text) < LONG_TEXT else (m[0] for m in runs.finditer(text))
                    for word, n in Counter(found).items():
                        word = slipped(prefix, word)
                        if len(word) >= least:
                            held[word] += n
                    if len(held) > HELD_WORDS:
                        yield handed(held)
                        held = Counter()
        if held:
            yield handed(held)

    return run


def word_counts(docs: DataFrame, least: int = LEAST_LETTERS, at_least: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)`` of all texts; each task combines its documents before the shuffle."""
    bound_batches(docs.sparkSession)
    counted = docs.select("doc_id", "text").mapInArrow(_counter(least), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least)


# The upper tree. A cell is known by its path: the word length, then one bit a cut ("8", "8:010", ...).


def upper_trees(words: DataFrame, limit: int) -> tuple[dict[int, Node], dict[str, int]]:
    """A tree per word length with cells of at most ``limit`` words, and the slices of cells that no cut divides.

    Per round one aggregate over the letters of the words in large cells gives the share of words with more
    than 0, 1, 2 of a letter, and the letters nearest to one half cut the cell. What comes to the driver
    is a few cuts per cell; ``words`` (word, ...) may be of any size.
    """
    where = words.select("word", F.length("word").cast("string").alias("cell"))
    sizes = {r["cell"]: r["n"] for r in where.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    roots = {int(cell): Node() for cell in sizes}
    leaves = {cell: roots[int(cell)] for cell in sizes}
    limit = max(limit, -(-sum(sizes.values()) // MOST_CELLS))
    whole: dict[str, int] = {}
    large = {c: n for c, n in sizes.items() if n > limit}
    while large:
        spark = words.sparkSession
        names = F.broadcast(spark.createDataFrame([(c, n) for c, n in large.items()], "cell string, total long"))
        where = where.join(names, "cell")
        cuts: dict[str, list[tuple[int, int]]] = {c: [] for c in large}
        for r in _best_cuts(where).collect():
            cuts[r["cell"]] = [(c["code"], c["at"]) for c in r["cuts"]]
        for cell, found in cuts.items():
            if found:
                _divide(leaves, cell, found)
            else:
                whole[cell] = -(-large[cell] // limit)
        where = materialise(_moved(where.drop("total"), cuts))
        sizes = {r["cell"]: r["n"] for r in where.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        large = {c: n for c, n in sizes.items() if n > limit and c not in whole}
    slices = {}
    for i, cell in enumerate(sorted(leaves)):
        leaves[cell].name = i
        if cell in whole:
            slices[i] = whole[cell]
    return roots, slices


def _best_cuts(where: DataFrame) -> DataFrame:
    """Per cell the cuts (letter, at) that come nearest to halves, on different letters."""
    times = "transform(array_distinct(filter(split(word, ''), x -> x != '')), x -> struct(x AS letter, length(word) - length(replace(word, x, '')) AS k))"
    seen = where.select("cell", "total", F.inline(F.expr(times)))
    more = seen.select("cell", "total", "letter", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("at"))
    shares = more.groupBy("cell", "total", "letter", "at").agg(F.count(F.lit(1)).alias("above")).where("above < total")
    ranked = shares.select("cell", F.abs(F.col("above") / F.col("total") - 0.5).alias("off"), F.ascii("letter").alias("code"), "at")
    # At most one row per letter in a cell's list.
    per_letter = ranked.groupBy("cell", "code").agg(F.min(F.struct("off", "at")).alias("best"))
    listed = per_letter.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("best.off", "code", "best.at"))).alias("all"))
    return listed.select("cell", F.slice("all", 1, CUTS).alias("cuts"))


def _divide(leaves: dict[str, Node], cell: str, cuts: list[tuple[int, int]]) -> None:
    nodes = {"": leaves.pop(cell)}
    for letter, at in cuts:
        for path, node in list(nodes.items()):
            node.letter, node.at, node.left, node.right = letter, at, Node(), Node()
            nodes |= {path + "0": node.left, path + "1": node.right}
            del nodes[path]
    joint = cell if ":" in cell else f"{cell}:"
    leaves.update({joint + path: node for path, node in nodes.items()})


def _moved(where: DataFrame, cuts: dict[str, list[tuple[int, int]]]) -> DataFrame:
    """Words of divided cells under their new cells' names."""
    spark = where.sparkSession
    rows = [(c, [chr(k) for k, _ in found], [at for _, at in found]) for c, found in cuts.items() if found]
    if not rows:
        return where.where("false")
    plan = F.broadcast(spark.createDataFrame(rows, "cell string, letters array<string>, ats array<int>"))
    joint = F.when(F.col("cell").contains(":"), "").otherwise(":")
    # Replacing nothing by nothing would not count: a letter's count is what its removal shortens.
    bits = F.expr(
        "array_join(zip_with(letters, ats, (l, a) -> IF(length(word) - length(replace(word, l, '')) > a, '1', '0')), '')"
    )
    return where.join(plan, "cell").select("word", F.concat("cell", joint, bits).alias("cell"))


# Dealing words to cells.

_DEALT = pa.schema([("cell", pa.int64()), ("slice", pa.int32()), ("own", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])


def by_length(words: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per word length the rows and their letter codes (rows x length)."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    listed = words.to_pylist()
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        joined = "".join(listed[i] for i in rows).encode("latin-1")
        yield int(length), rows, np.frombuffer(joined, np.uint8).reshape(len(rows), int(length))


def _dealer(roots: dict[int, Node], slices: dict[int, int]) -> Callable:
    """Every word to its own cell (``own``) and to later cells of its length, and cells of the next, in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 10_000):
                part = batch.slice(start, 10_000)
                words, n = part.column("word"), part.column("n")
                sent = []
                for length, rows, codes in by_length(words):
                    counts = letter_counts(codes)
                    home = np.zeros(len(rows), np.int64)
                    for node, inside in reach(roots[length], counts, 0, 0):
                        home[inside] = node.name
                    for node, inside in reach(roots[length], counts, 1, 1):
                        inside = inside[home[inside] <= node.name]
                        sent.append((node.name, rows[inside], home[inside] == node.name))
                    if length + 1 in roots:
                        for node, inside in reach(roots[length + 1], counts, 1, 0):
                            sent.append((node.name, rows[inside], np.zeros(len(inside), bool)))
                yield from _sent(sent, words, n, slices)

    return run


def _sent(sent: list[tuple[int, np.ndarray, np.ndarray]], words: pa.Array, n: pa.Array, slices: dict[int, int]):
    """The rows for all cells; words of a sliced cell go to one slice each, words looked for there go to all."""
    cells, parts, rows, owns = [], [], [], []
    for cell, here, own in sent:
        count = slices.get(cell, 1)
        at = np.zeros(len(here), np.int64)
        if count > 1:
            at = np.array([zlib.crc32(words[int(i)].as_py().encode()) % count for i in here], np.int64)
        for k in range(count):
            keep = ~own | (at == k)
            cells.append(np.full(int(keep.sum()), cell, np.int64))
            parts.append(np.full(int(keep.sum()), k, np.int32))
            rows.append(here[keep])
            owns.append(own[keep])
    if rows:
        taken = pa.array(np.concatenate(rows))
        columns = [pa.array(np.concatenate(x)) for x in (cells, parts, owns)]
        yield pa.RecordBatch.from_arrays([*columns, words.take(taken), n.take(taken)], schema=_DEALT)


# Searching a cell.


class Cell:
    """The words of one cell as a k-d tree, and what is near to each so far."""

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n = np.array(words, object), n
        self.codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)
        counts = letter_counts(self.codes)
        self.tree = grow(counts, LEAF_WORDS)
        self.letters = np.flatnonzero(counts.any(axis=0))
        most = counts.max(axis=0)[self.letters]
        self.most = np.minimum(most, COUNTED)
        self.cut = np.where(most > COUNTED, COUNTED, np.iinfo(np.int32).max)
        self.bits = self._bits(counts)

    def _bits(self, counts: np.ndarray) -> np.ndarray:
        """1.0 for each of the first, second, ... of a letter: a product counts what two words share."""
        return np.concatenate(
            [(counts[:, self.letters[self.most >= k]] >= k) for k in range(1, int(self.most.max()) + 1)], axis=1
        ).astype(np.float32)

    def near(self, codes: np.ndarray, first: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of ``codes``, word of the cell) one edit apart; codes are as long as the cell's or one shorter.

        With ``first`` the rows are the cell's own words from there on; each pair is then given once.
        """
        same = codes.shape[1] == self.codes.shape[1]
        counts = letter_counts(codes)
        bits = self._bits(counts)
        found = []
        for leaf, rows in reach(self.tree, counts, 1, 1 if same else 0):
            # What the product may miss of letters that a word of the cell has more often than it counts.
            missed = np.maximum(counts[np.ix_(rows, self.letters)] - self.cut, 0).sum(axis=1)
            wanted = (codes.shape[1] - (1 if same else 0)) - missed
            shared = bits[rows] @ self.bits[leaf.rows].T
            a, b = np.nonzero(shared >= wanted[:, None] - 0.5)
            a, b = rows[a], leaf.rows[b]
            if first is not None:
                later = b > a + first
                a, b = a[later], b[later]
            near = replaced(codes[a], self.codes[b]) if same else inserted(codes[a], self.codes[b])
            found.append((a[near], b[near]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of equal length differ in exactly one place."""
    return (a != b).sum(axis=1) == 1


def inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of ``long`` are those of ``short`` with one letter inserted."""
    lead = np.cumprod(short == long[:, :-1], axis=1).sum(axis=1)
    tail = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return lead + tail >= short.shape[1]


class Best:
    """Per word the number of near words and the best of them: largest n, then smallest word."""

    def __init__(self):
        self.held: dict[str, list] = {}

    def add(self, words: np.ndarray, near: np.ndarray, near_n: np.ndarray) -> None:
        held = self.held
        for word, other, n in zip(words.tolist(), near.tolist(), near_n.tolist(), strict=True):
            old = held.get(word)
            if old is None:
                held[word] = [1, n, other]
            else:
                old[0] += 1
                if n > old[1] or n == old[1] and other < old[2]:
                    old[1], old[2] = n, other

    def handed(self) -> pa.RecordBatch:
        words, values = list(self.held), list(self.held.values())
        self.held = {}
        columns = [words, *([v[k] for v in values] for k in range(3))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FOUND.types, strict=True)], schema=_FOUND)


_FOUND = pa.schema([("word", pa.string()), ("links", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows with equal (cell, slice, own, length), each at most a batch long."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "slice", "own")]
        keys.append(pc.utf8_length(batch.column("word")).to_numpy(zero_copy_only=False).astype(np.int64))
        table = np.stack(keys, axis=1)
        cuts = np.flatnonzero(np.any(table[1:] != table[:-1], axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield tuple(table[a].tolist()), batch.slice(int(a), int(b - a))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of sorted cells: a cell's own words come first and are held, the rest passes by."""
    at, words, n, cell, best = None, [], [], None, Best()

    def built() -> Cell | None:
        return Cell(words, np.array(n, np.int64)) if words else None

    def inner(cell: Cell) -> None:
        for start in range(0, len(cell.words), 2000):
            a, b = cell.near(cell.codes[start : start + 2000], start)
            a = a + start
            best.add(cell.words[a], cell.words[b], cell.n[b])
            best.add(cell.words[b], cell.words[a], cell.n[a])

    for (name, part, own, _), group in _groups(batches):
        if (name, part) != at:
            if cell is None and words:
                inner(built())
            at, words, n, cell = (name, part), [], [], None
        listed, counted = group.column("word").to_pylist(), group.column("n").to_pylist()
        if own:
            words += listed
            n += counted
            continue
        if cell is None:
            if not words:
                continue
            cell = built()
            inner(cell)
        for start in range(0, len(listed), 2000):
            some = np.array(listed[start : start + 2000], object)
            some_n = np.array(counted[start : start + 2000], np.int64)
            codes = np.frombuffer("".join(some).encode("latin-1"), np.uint8).reshape(len(some), -1)
            a, b = cell.near(codes, None)
            best.add(some[a], cell.words[b], cell.n[b])
            best.add(cell.words[b], some[a], some_n[a])
        if len(best.held) > HELD_WORDS:
            yield best.handed()
    if cell is None and words:
        inner(built())
    yield best.handed()


def near_words(words: DataFrame, limit: int = CELL_WORDS) -> DataFrame:
    """``(word, n_near, best_n, best)`` for every word of ``words`` (word, n) that has a near word."""
    roots, slices = upper_trees(words, limit)
    if not roots:
        return words.select("word", F.lit(0).cast("long").alias("n_near"), F.col("n").alias("best_n"), F.col("word").alias("best")).where("false")
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = words.select("word", "n").mapInArrow(_dealer(roots, slices), "cell long, slice int, own boolean, word string, n long")
    found = (
        # A fixed number: tasks are to follow the work in a cell, not its few bytes.
        dealt.repartition(tasks, "cell", "slice")
        .sortWithinPartitions("cell", "slice", F.desc("own"), F.length("word"))
        .mapInArrow(_search, "word string, links long, best_n long, best string")
    )
    # The smallest of (-n, word) is the near word of largest n, ties by code points.
    first = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    merged = found.groupBy("word").agg(F.sum("links").alias("n_near"), first.alias("f"))
    return merged.select("word", "n_near", (-F.col("f.m")).alias("best_n"), F.col("f.best").alias("best"))


def with_roots(words: DataFrame) -> DataFrame:
    """Add ``root``: the forms followed to the last. Each round doubles the steps taken."""
    steps = materialise(words.where("form IS NOT NULL").select(F.col("word").alias("_w"), F.col("form").alias("_to")))
    while True:
        onward = steps.select(F.col("_w").alias("_from"), F.col("_to").alias("_next"))
        # Only forms that have a form themselves lead on; they are few, as each has a tenth of the next one's count.
        onward = onward.join(steps.select(F.col("_to").alias("_from")).distinct(), "_from", "left_semi")
        onward = materialise(onward)
        if onward.isEmpty():
            break
        joined = steps.join(sized(onward), F.col("_to") == F.col("_from"), "left")
        steps = materialise(joined.select("_w", F.coalesce("_next", "_to").alias("_to")))
    return words.join(steps, F.col("word") == F.col("_w"), "left").withColumn("root", F.coalesce("_to", "word")).drop("_w", "_to")


def spelling_variants(
    docs: DataFrame, least: int = LEAST_LETTERS, at_least: int = LEAST_COUNT, ratio: int = FORM_RATIO, limit: int = CELL_WORDS
) -> DataFrame:
    """One row per word: ``word, n, n_near, form, form_n, root``."""
    words = materialise(word_counts(docs, least, at_least))
    near = near_words(words, limit).withColumnRenamed("word", "_near")
    joined = words.join(near, F.col("word") == F.col("_near"), "left")
    good = F.col("best_n") >= ratio * F.col("n")
    rows = joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("best")).alias("form"),
        F.when(good, F.col("best_n")).alias("form_n"),
    )
    return with_roots(materialise(rows))
