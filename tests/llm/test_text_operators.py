"""Repeats, language, lines, leaks and quality against brute force or SQL."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cargoscope.llm import op4_repeats, op5_language, op6_line_dedup, op7_decontaminate, op9_quality, registry

FOLDER = "/root/testdata/sf0.001"


# --- repeats -----------------------------------------------------------------------------------


def brute_removed(texts):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for i, d in enumerate(data):
        for s in range(len(d) - 399):
            seen.setdefault(d[s : s + 400], []).append((i, s))
    out = [np.zeros(len(d), bool) for d in data]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                out[i][s : s + 400] = True
    rows = []
    for d, gone in zip(data, out, strict=True):
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = int((np.diff(gone, prepend=False) & gone).sum())
        rows.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return rows


def prose(rng, n):
    return "".join(rng.choice("abcdeé ") for _ in range(n))


def repeat_texts():
    rng = random.Random(4)
    shared = [prose(rng, n) for n in (395, 400, 401, 450, 700, 1500)]
    texts = ["", None, "x" * 399, "x" * 400, "x" * 900, "ab" * 700, "é" * 300]
    for i in range(40):
        a, b = rng.choice(shared), rng.choice(shared)
        texts.append(prose(rng, rng.randint(0, 600)) + a + prose(rng, rng.randint(0, 500)) + b + prose(rng, i % 3))
    for i in range(25):  # pieces of one long passage, so that left and right partners differ
        a = rng.randint(0, 900)
        texts.append(prose(rng, 5) + shared[-1][a : a + rng.randint(380, 600)] + prose(rng, 6))
    return [*texts, texts[10], texts[11]]


def test_repeats_equal_brute_force(spark):
    texts = repeat_texts()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, pack string")
    got = {r.doc_id: tuple(r)[1:5] for r in op4_repeats.remove_repeats(docs.repartition(5)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts)


def test_repeats_of_one_row_and_keys(spark):
    rng = random.Random(1)
    a, b = prose(rng, 800), prose(rng, 800)
    docs = spark.createDataFrame([(1, a), (1, a), (None, b), (2, b + "!"), (1, b[:399])], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in op4_repeats.remove_repeats(docs).collect())
    size = {t: len(t.encode()) for t in (a, b, b[:399])}
    want = [("1", size[a], size[a])] * 2 + [("1", size[b[:399]], size[b[:399]] if size[b[:399]] >= 400 else 0)]
    want += [("2", size[b] + 1, size[b]), ("None", size[b], size[b])]
    assert got == sorted(want)
    assert op4_repeats.remove_repeats(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6), max_size=12), max_size=6))
def test_merge_gives_sorted_strings_and_prefixes(runs):
    runs = [sorted(set(r)) for r in runs]

    def stream(r):
        for i, s in enumerate(r):
            yield s, op4_repeats.common_prefix(r[i - 1], s) if i else 0, 1

    got = list(op4_repeats.merge_runs([stream(r) for r in runs]))
    strings = [s for _, s, _, _ in got]
    assert strings == sorted(s for r in runs for s in r)
    for x, y, (_, _, shared, _) in zip(strings, strings[1:], got[1:], strict=False):
        assert shared == op4_repeats.common_prefix(x, y)


def test_blocks_round_trip():
    strings = sorted({prose(random.Random(i), 50).encode()[:40] for i in range(60)})
    payload = op4_repeats.encode_block(strings, [1] * len(strings))
    assert [s for s, _, _ in op4_repeats.decode_block(payload, len(strings))] == strings


def test_anchors_cover_every_window_once():
    data = (prose(random.Random(2), 3000) + "a" * 1200).encode()
    own = op4_repeats.anchors(data)
    assert np.concatenate([np.arange(lo, hi + 1) for _, lo, hi in own]).tolist() == list(range(len(data) - 399))
    assert all(lo <= a <= lo + 384 and hi <= a for a, lo, hi in own)


# --- language ----------------------------------------------------------------------------------


def test_language_accuracy_and_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame(
        [(9001, None, "en"), (9002, "", "de"), (9003, "123 !?", "fr"), (9004, "a", None), (None, "der die das und", "de")],
        "doc_id long, text string, lang string",
    )
    got = op5_language.identify(docs.select("doc_id", "text", "lang").unionByName(odd))
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == docs.count() + 5
    assert [rows[k].lang_pred for k in (9001, 9002, 9003)] == ["und"] * 3 and rows[9004].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in rows.values()) and rows[9001].score == 0
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    for k, r in rows.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2 if k is not None else False)
    held = [k for k, r in rows.items() if r.held_out and k in truth and truth[k][0] and len(truth[k][1]) > 200]
    assert np.mean([rows[k].lang_pred == truth[k][0] for k in held]) > 0.97


def test_language_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:4] for r in op5_language.identify(docs).collect()] == [("und", 0.0)]
    assert op5_language.identify(docs.limit(0)).count() == 0


# --- lines -------------------------------------------------------------------------------------


def close(a, b):
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[p:] == b[p + 1 :] if len(a) < len(b) else a[p + 1 :] == b[p + 1 :]


def brute_lines(rows, least=24):
    flat = []
    for i, (_, t) in enumerate(rows):
        flat += [(i, j, x) for j, x in enumerate(t.split("\n") if t is not None else [])]
    out = []
    for i, (_, t) in enumerate(rows):
        if t is None:
            out.append((None, 0, 0))
            continue
        lines = t.split("\n")
        keep = [
            x for j, x in enumerate(lines)
            if not any(
                (a, b) < (i, j) and (x == y if min(len(x), len(y)) < least else close(x, y))
                for a, b, y in flat if len(x) >= least or x.strip(" \t\n\x0b\x0c\r")
            )
        ]
        out.append(("\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


def line_rows():
    rng = random.Random(6)
    base = ["".join(rng.choice("abé ") for _ in range(n)) for n in (24, 25, 40, 127, 128, 129, 255, 256, 300, 700)]
    rows = [(0, None), (1, ""), (2, "\n"), (3, "short\nshort")]
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 5)):
            x = rng.choice(base)
            for _ in range(rng.choice((0, 1, 1, 2))):
                at = rng.randrange(len(x) + 1)
                x = rng.choice((x[:at] + "z" + x[at:], x[:at] + x[at + 1 :], x[:at] + "q" + x[at + 1 :]))
            lines.append(x)
        rows.append((10 + i, "\n".join([*lines, "short"])))
    return rows


def test_lines_equal_brute_force(spark):
    rows = line_rows()
    docs = spark.createDataFrame([(k, t, "x", 5) for k, t in rows], "doc_id long, text string, pos string, lines int")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in op6_line_dedup.dedup_lines(docs).collect()}
    want = brute_lines(rows)
    for (k, _), w in zip(rows, want, strict=True):
        assert got[k] == w, k
    assert op6_line_dedup.dedup_lines(docs).columns == ["doc_id", "pos", "lines", "text", "n_lines", "n_removed"]


def test_lines_null_and_repeated_keys(spark):
    x, y = "a line that is long enough", "another line, long enough"
    docs = spark.createDataFrame([(None, x), (1, f"{x}\n{y}"), (1, f"{x}\n{y}"), (2, y + "!")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text, r.n_removed) for r in op6_line_dedup.dedup_lines(docs).collect())
    assert got == [("1", f"{x}\n{y}", 0)] * 2 + [("2", "", 1), ("None", "", 1)]
    assert op6_line_dedup.dedup_lines(docs.limit(0)).count() == 0


# --- leaks -------------------------------------------------------------------------------------


def test_masks_fit_every_window():
    def fits(masks, width, wrong):
        return all(
            any(all(s + k not in bad for k in m) for m in masks for s in range(width - m[-1]))
            for bad in map(set, combinations(range(width), wrong))
        )

    assert fits([op7_decontaminate.MASK], 13, 2)
    for width in range(8, 13):
        assert fits(op7_decontaminate.SHORT_MASKS, width, width // 5)


def brute_leaks(docs, items):
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = {}
    for key, text in docs:
        d, found = split(text), {}
        for item, body in items:
            w = split(body)
            if body is None or len(w) < 8:
                continue
            span = min(13, len(w))
            for shift in range(-len(w), len(d)):
                hit = [0 <= i + shift < len(d) and d[i + shift] == x for i, x in enumerate(w)]
                best = max(sum(hit[s : s + span]) for s in range(len(w) - span + 1))
                if 100 * best >= 80 * span:
                    found[item] = max(found.get(item, 0), best)
        out[key] = (bool(found), len(found), min(found, default=None), max(found.values(), default=0))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([7, 8, 9, 10, 11, 12, 13, 14, 20, 30])]
    items += [(50, None), (51, "")]
    docs = [(0, None), (1, ""), (2, "one, two")]
    for i in range(80):
        w = items[rng.randrange(10)][1].split()
        a = rng.randrange(max(1, len(w) - 12))
        w = w[a : a + rng.randint(8, 30)]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "Other"
        docs.append((10 + i, " ".join([*rng.choices(vocabulary, k=rng.randint(0, 9)), *w, *rng.choices(vocabulary, k=4)]).replace(" ", ", ", 2)))
    table = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in op7_decontaminate.contamination(table, bench).collect()}
    want = brute_leaks(docs, items)
    assert got == want and any(v[0] for v in want.values()) and not all(v[0] for v in want.values())
    left = {r.doc_id for r in op7_decontaminate.decontaminate(table, bench).collect()}
    assert left == {k for k, v in want.items() if not v[0]}
    assert op7_decontaminate.contamination(table.limit(0), bench).count() == 0
    assert op7_decontaminate.contamination(table, bench.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("name", ["op6_line_dedup", "op7_decontaminate"])
def test_queries_equal_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    result = registry.queries()[name](spark, FOLDER)
    want = db.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert set(names) == set(result.columns)
    assert sorted(map(repr, map(tuple, result.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


# --- quality -----------------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, dup, len(covered)


ODD = ["", None, " \n\t", "a b c a b c", "x\nx\n x\n\n\n", "a a a a", "é#1 <b>|\x0bz", "l1 w\nl2\nl1 w\nl1 w", "w " * 60]


def test_quality_counts_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    rows += [(5000 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(k, t, 0.0) for k, t in rows], "doc_id long, text string, score double")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = {r.doc_id: r for r in op9_quality.quality(docs, labels).collect()}
    for k, t in rows:
        want = brute_counts(t)
        assert tuple(got[k])[1:6] == want, k
        assert got[k].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got[k].base_failed and got[k].kept)


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some words " * 3), (None, " ".join(f"w{i}" for i in range(70)))], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.base_failed, r.kept) for r in op9_quality.quality(docs, labels).collect()}
    assert got == {1: (True, False), None: (False, True)}
    assert op9_quality.quality(docs.limit(0), labels).count() == 0


def test_quality_keeps_clean_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    judged = op9_quality.quality(docs, labels).join(labels, "doc_id").where("NOT base_failed")
    good = F.expr("quality = 1 AND toxic = 0")
    shares = {r["g"]: r["k"] for r in judged.groupBy(good.alias("g")).agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert shares[True] > 0.99 and shares[False] < 0.2
