"""op12: near words, forms and roots against all pairs, and edge cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cargoscope.llm import op12_spelling as op12
from cargoscope.llm.kdtree import grow, letter_counts, reach

SHAPE = "doc_id long, text string"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(AZ)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def plain(docs):
    words = counted(docs)
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    form, rows = {}, {}
    for w, n in words.items():
        others = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if v != w and near(v, w)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
        rows[w] = (n, len(others), form[w], words.get(form[w]))
    out = {}
    for w, row in rows.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (*row, root)
    return out


def got(df):
    rows = df.select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert len(rows) == len({r["word"] for r in rows})
    return {r["word"]: tuple(r)[1:] for r in rows}


def texts(seed, letters="abcé", n=400):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 11))) for _ in range(40)]
    for i in range(n):
        words = []
        for _ in range(rng.randrange(0, 30)):
            w = rng.choice(stems[: 1 + rng.randrange(len(stems))])
            for _ in range(rng.choice([0, 0, 1, 2])):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
            words.append(w.capitalize() if rng.random() < 0.2 else w)
        yield rng.choice([None, i, 3]), rng.choice([" ", "-", "\n", "ß1 "]).join(words)


@pytest.mark.parametrize(("seed", "limit"), [(1, 6000), (2, 40), (3, 7)])
def test_matches_all_pairs(spark, seed, limit):
    docs = list(texts(seed))
    df = spark.createDataFrame(docs, SHAPE).repartition(3)
    expected = plain(docs)
    assert got(op12.spelling_variants(df, limit=limit)) == expected
    assert any(v[2] for v in expected.values())


def test_anagrams_that_no_cut_divides(spark):
    rng = random.Random(5)
    words = set()
    while len(words) < 60:
        words.add("".join(rng.sample("aabbccdd", 8)))
    extra = {w[:3] + "z" + w[4:] for w in sorted(words)[:20]} | {w + "q" for w in sorted(words)[:20]} | {w[1:] for w in sorted(words)[:9]}
    docs = [(i, " ".join(sorted(words | extra))) for i in range(3)]
    df = spark.createDataFrame(docs, SHAPE)
    assert got(op12.spelling_variants(df, limit=10)) == plain(docs)


def test_chain_of_forms(spark):
    chain = [("aaaaaaaa", 3000), ("aaaaaaab", 250), ("aaaaaabb", 20), ("aaaaabbb", 2)]
    docs = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(chain, 1)]
    rows = got(op12.spelling_variants(spark.createDataFrame(docs, SHAPE)))
    assert rows == plain(docs)
    assert {r[4] for r in rows.values()} == {"aaaaaaaa"}


@pytest.mark.parametrize("docs", [[], [(1, None)], [(None, ""), (2, "short words only"), (3, "singular")]])
def test_no_words(spark, docs):
    df = op12.spelling_variants(spark.createDataFrame(docs, SHAPE))
    assert df.columns[:2] == ["word", "n"] and got(df) == {}


def test_very_long_text_repeated_rows_and_other_columns(spark):
    long = "Abcdefgh abcdefgi " * 300_000
    docs = [(1, long), (2, "a" * 2_000_000), (2, "a" * 2_000_000), (4, "abcdefgh x"), (4, "abcdefgh x")]
    names = ["word", "n", "form", "root", "cell", "own", "best", "_near"]
    df = spark.createDataFrame([(*d, *["v"] * len(names)) for d in docs], ["doc_id", "text", *names])
    rows = got(op12.spelling_variants(df))
    assert {w: r for w, r in rows.items() if len(w) < 99} == {w: r for w, r in plain(docs).items() if len(w) < 99}
    assert len(rows) == len(plain(docs))


@pytest.mark.parametrize(("up", "down"), [(0, 0), (1, 0), (1, 1), (2, 1)])
def test_reach_is_the_box_distance(up, down):
    rng = np.random.default_rng(up + 2 * down)
    data = rng.integers(97, 101, (300, 9)).astype(np.uint8)
    asked = rng.integers(97, 101, (80, 9)).astype(np.uint8)
    counts, looked = letter_counts(data), letter_counts(asked)
    found = set()
    for leaf, rows in reach(grow(counts, 8), looked, up, down):
        found |= {(int(a), int(b)) for a in rows for b in leaf.rows}
    for a in range(80):
        steps = counts.astype(int) - looked[a]
        fits = (np.maximum(steps, 0).sum(axis=1) <= up) & (np.maximum(-steps, 0).sum(axis=1) <= down)
        assert {(a, int(b)) for b in np.flatnonzero(fits)} <= found
    assert up + down > 1 or len(found) < 80 * 300
