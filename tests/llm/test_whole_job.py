"""Cases that an earlier round left out of the job."""

from itertools import islice

import duckdb
import numpy as np

from cargoscope.llm import op3_minmax_dedup, op6_line_dedup, op7_decontaminate, op9_quality, registry
from tests.llm.test_text_operators import FOLDER, close, line_rows

# --- lines -------------------------------------------------------------------------------------


def brute_all_lines(rows, least=24):
    """Equal lines with a word of every length, and lines one edit apart from ``least`` characters on."""
    flat = [(i, j, x) for i, (_, t) in enumerate(rows) if t is not None for j, x in enumerate(t.split("\n"))]
    gone = set()
    for i, j, x in flat:
        for a, b, y in flat:
            if (a, b) >= (i, j):
                break
            if (x == y and (len(x) >= least or x.strip(" \t\n\x0b\x0c\r"))) or (min(len(x), len(y)) >= least and close(x, y)):
                gone.add((i, j))
                break
    out = {}
    for i, (k, t) in enumerate(rows):
        lines = t.split("\n") if t is not None else []
        keep = [x for j, x in enumerate(lines) if (i, j) not in gone]
        out[k] = ("\n".join(keep) if t is not None else None, len(lines), len(lines) - len(keep))
    return out


def test_short_repeats_go(spark):
    rows = [*line_rows(), (100, "Menu\n\n \t\nMenu\nmenu\n"), (101, "Menu\n\nx" + "\n" + " " * 24), (102, "x\nMenus\n" + " " * 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in op6_line_dedup.dedup_lines(docs).collect()}
    want = brute_all_lines(rows)
    assert got == want
    assert got[3] == ("short", 2, 1) and got[100] == ("Menu\n\n \t\nmenu\n", 6, 1) and got[102][0] == "Menus"


def test_all_lines_equal_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = db.execute(registry.oracle_sql()["op6_line_dedup"]).fetchall()
    result = registry.queries()["op6_line_dedup"](spark, FOLDER)
    got = result.select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sum(r.n_removed for r in got) > 74


# --- quality -----------------------------------------------------------------------------------


def test_one_anomaly_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(op9_quality, "SAMPLE_ROWS", 60)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(70)]
    rows = [(i, " ".join(words[i % 7 :] + [f"end{i}"])) for i in range(2000)]
    odd = {2000: "# | $ " * 20, 2001: "!? " * 40, 2002: "SHOUTING LOUDLY " * 1}
    rows += [(k, " ".join(words) + " " + extra) for k, extra in odd.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(500)], "doc_id long, quality int, toxic int")
    judged = {r.doc_id: r for r in op9_quality.quality(docs, labels).collect()}
    assert not any(r.base_failed for r in judged.values())
    assert {k for k, r in judged.items() if not r.kept} == odd.keys()


def test_a_large_language_leaves_words_to_a_small_one(spark):
    spell = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    many = " ".join(f"bad{spell(i)}" for i in range(1100))
    rows = [(i, many if i < 10 else "good words", "en") for i in range(200)]
    rows += [(200 + i, "malo peor" if i < 4 else "buenas palabras", "es") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = spark.createDataFrame([(i, 1, int(i < 10 or 200 <= i < 204)) for i in range(300)], "doc_id long, quality int, toxic int")
    assert set(op9_quality.flagged_words(docs, sample)) == {*many.split(), "malo", "peor"}


def test_words_allowances_and_threshold_use_every_label(spark, monkeypatch):
    monkeypatch.setattr(op9_quality, "LABELLED_ROWS", 6, raising=False)
    rows = [(i, "awful words" if i % 50 == 0 else "good words", "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = [(i, 1, int(i % 50 == 0)) for i in range(400)] + [(1, 1, 0), (2, None, 0), (None, 1, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = []
    flag, level = op9_quality.flagged_words, op9_quality.threshold
    monkeypatch.setattr(op9_quality, "flagged_words", lambda d, s: seen.append(found := flag(d, s)) or found)
    monkeypatch.setattr(op9_quality, "threshold", lambda d, s, loss: seen.append(s.count()) or level(d, s, loss))
    op9_quality.quality(docs, labels).collect()
    assert seen == [["awful"], 401]
    values = [((i * 37) % 401) / 7 for i in range(401)]
    stats = spark.createDataFrame(
        [(i, False, *[v * (k + 1) for k in range(6)], v) for i, v in enumerate(values)],
        ["doc_id", "base_failed", *op9_quality.FEATURES, "score"],
    )
    known = spark.createDataFrame([(i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    clean = np.array(values[:400])
    for loss in (0.002, 0.3, 0.9):
        allowed = op9_quality.clean_allowances(stats, known, loss)
        expected = [float(np.quantile(clean * (k + 1), 1 - loss / 12, method="higher")) for k in range(6)]
        assert [allowed[f] for f in op9_quality.FEATURES] == expected
        assert op9_quality.threshold(stats, known, loss) == np.sort(clean)[int(np.ceil((1 - loss) * 400)) - 1]


# --- near duplicates ---------------------------------------------------------------------------


def test_rows_of_one_key_are_not_multiplied(spark, monkeypatch):
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(12)]
    rows = [(None, t + end) for t in texts for end in ("", " more")] + [(5, t + " most") for t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fetch, fetched = op3_minmax_dedup._texts_of, []

    def counted(texts, wanted):
        out = fetch(texts, wanted)
        fetched.append((out.count(), wanted.count()))
        return out

    monkeypatch.setattr(op3_minmax_dedup, "_texts_of", counted)
    got = op3_minmax_dedup.near_duplicates(docs).collect()
    assert [n for n, _ in fetched] == [n for _, n in fetched] == [36]
    assert {r.component_id for r in got} == {5} and len(got) == 36


def test_rounds_have_no_end():
    assert list(islice(op3_minmax_dedup._rounds(), 5)) == [1, 8, 64, 500, 500]
    assert next(islice(op3_minmax_dedup._rounds(), 50_000, None)) == 500


def test_bands_follow_the_similarity():
    for percent, c, u in ((85, 6, 7), (80, 4, 5), (80, 800, 1000)):
        n = op3_minmax_dedup.bands_for(percent)
        assert (1 - (c * (c - 1) / (u * (u - 1))) ** 2) ** n < 1e-10
    assert op3_minmax_dedup.bands_for(80) > op3_minmax_dedup.bands_for(85) >= op3_minmax_dedup.bands_for(99) == 32


# --- extra columns ----------------------------------------------------------------------------

INTERNAL = "lines th kept gone row _th _key nid digest size bands component n_shingles c t n at first near doc item_id score _n".split()


def test_extra_columns_keep_their_values(spark):
    text = " ".join(f"word{i} more" for i in range(60))
    rows = [(i, f"{text} tail{i % 2}\nshort line\nown {i}") for i in range(6)]
    docs = spark.createDataFrame([(*r, *[f"{c}{r[0]}" for c in INTERNAL]) for r in rows], ["doc_id", "text", *INTERNAL])
    items = spark.createDataFrame([(1, " ".join(f"other{i}" for i in range(30)))], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    for name, out in {
        "lines": op6_line_dedup.dedup_lines(docs),
        "near": op3_minmax_dedup.keep_one(docs, percent=80),
        "benchmark": op7_decontaminate.decontaminate(docs, items),
        "quality": op9_quality.keep_good(docs, labels),
    }.items():
        got = out.collect()
        assert got and set(INTERNAL) <= set(out.columns), name
        for r in got:
            assert [r[c] for c in INTERNAL] == [f"{c}{r['doc_id']}" for c in INTERNAL], name
