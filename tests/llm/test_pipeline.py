"""Stages of the pipeline against brute force, each on its own input."""

import corpus_pipeline
from cargoscope.session import materialise
from tests.llm.test_near_and_counts import brute
from tests.llm.test_text_operators import brute_counts, brute_leaks, brute_lines
from tests.llm.test_tokens import check_places

FOLDER = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        rows = sorted((r.doc_id, r.text) for r in docs.collect())
        docs = materialise(stage(spark, docs, FOLDER))
        out = docs.collect()
        if name == "packing":
            assert {r.doc_id for r in out} == {k for k, _ in rows}
            total = sum(r.length for r in out)
            assert check_places(out, 2048) <= -(-total // 2048) + 1
            continue
        assert docs.columns == columns
        got = {r.doc_id: r.text for r in out}
        if name == "quality_rules":
            counts = {k: brute_counts(t) for k, t in rows}
            failed = {k for k, c in counts.items() if c[0] < 50 or 100 * c[4] > 50 * c[0]}
            labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
            assert not failed & got.keys() and all(got[k] == t for k, t in rows if k in got)
            assert all(k in got for k, _ in rows if labels.get(k) == (1, 0) and k not in failed)
        if name == "line_dedup":
            assert got == {k: w[0] for (k, _), w in zip(rows, brute_lines(rows), strict=True)}
            assert all(r.n_chars == len(r.text) for r in out)
        if name == "near_dedup":
            assert got.keys() == {k for k, _, _, kept in brute(rows, 80) if kept}
        if name == "decontamination":
            assert got.keys() == {k for k, v in brute_leaks(rows, items).items() if not v[0]}
    assert corpus_pipeline.run(spark, FOLDER).count() == len(out)


def test_stages_on_empty_and_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = " ".join(f"word{i} more" for i in range(60))
    rows = [(1, full, "en", "s", 1), (1, full, "en", "s", 1), (1, full + " end", None, None, None), (None, full, "en", "s", 1)]
    rows += [(2, None, None, None, None), (3, "", "en", "s", 0), (4, "w " * 5000, "en", "s", 0)]
    for given in ([], rows):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, FOLDER))
        assert docs.count() == 0 if not given else docs.count() >= 1


def test_one_of_each_group_stays(spark):
    full = " ".join(f"word{i} more" for i in range(60))
    rows = [(1, full), (1, full), (1, full + " end"), (2, full), (None, full), (5, None), (5, ""), (5, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted(str(r.doc_id) for r in corpus_pipeline.near_dedup(spark, docs, FOLDER).collect())
    assert left == ["1", "5", "5", "5"]
