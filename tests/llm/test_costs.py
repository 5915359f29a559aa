"""Work that must not be done per line, per word or kept between tasks."""

import random
import unicodedata

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cargoscope.llm import op2_packing, op4_repeats, op6_line_dedup
from cargoscope.llm.encoding import WordEncoder, encoder
from cargoscope.llm.registry import tokenizer_file
from cargoscope.session import discard, materialise

FILES = [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)]


def test_long_lines_are_hashed_by_halves_until_they_may_have_a_partner(spark, monkeypatch):
    written = []
    real = op6_line_dedup.materialise
    monkeypatch.setattr(op6_line_dedup, "materialise", lambda df: written.append(real(df)) or written[-1])
    pick = random.Random(1)
    long = "".join(pick.choice("abcdé ") for _ in range(5000))
    docs = [(1, f"{long}\nshort\n"), (2, long[:4000] + "é" + long[4000:]), (3, "short\nalone and without any partner at all"), (4, None)]
    got = op6_line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got} == {
        (1, f"{long}\nshort\n", 3, 0),
        (2, "", 1, 1),
        (3, "alone and without any partner at all", 2, 1),
        (4, None, 0, 0),
    }
    assert {len(r.halves) for r in written[0].collect() if r.halves is not None} == {4}


@pytest.mark.parametrize("second", ["x", "é"])
def test_repeated_lines_of_one_text_keep_their_first_place(spark, second):
    line = "a line that is long enough to be judged " + second
    docs = [(None, f"{line}\n\n{line}"), (7, f"\n{line}\n{line}\nother\nother"), (7, f"\n{line}\n{line}\nother\nother")]
    got = op6_line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text, r.n_removed) for r in got) == [
        ("7", f"\n{line}\nother", 2),
        ("7", f"\n{line}\nother", 2),
        ("None", "", 2),
    ]


@pytest.mark.parametrize("name, keeps", FILES)
def test_words_of_letters_skip_the_steps_that_leave_them_alone(name, keeps):
    path = tokenizer_file(name)
    own, whole = WordEncoder(path, keeps), Tokenizer.from_file(path)
    assert own.plain is not None
    pick = random.Random(2)
    letters = "abcdeABXYZ" + "".join(map(chr, range(0xC0, 0x100))) + "ĿſΣİǅ" + "é" + "'s .,!?\n\t\x1c ​9"
    texts = ["".join(pick.choice(letters) for _ in range(pick.randrange(60))) for _ in range(800)]
    texts += ["", None, "<|endoftext|>", "a<|endoftext|>b c", unicodedata.normalize("NFD", "éàü über ça")]
    ids, offsets = own.encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == whole.encode(text or "", add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name, keeps", FILES)
def test_words_of_unknown_pipelines_and_without_parting_string(name, keeps, tmp_path):
    whole = Tokenizer.from_file(tokenizer_file(name))
    own = WordEncoder(tokenizer_file(name), keeps, control_ids=False)
    assert own.parting is None
    whole.encode_special_tokens = True
    text = "Some words, été <|endoftext|> and more words"
    assert own.encode(pa.array([text]))[0].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_workers_return_memory_after_each_batch(monkeypatch):
    calls = []
    monkeypatch.setattr(op4_repeats, "give_back", lambda: calls.append(1))
    data = [bytes(random.Random(3).randrange(256) for _ in range(1000))] * 2
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([1, 1]), pa.array(data)], ["doc_id", "th", "data"])
    assert sum(b.num_rows for b in op4_repeats._anchor_rows(iter([batch, batch])))
    assert len(calls) == 2


@pytest.mark.parametrize("name, keeps", FILES)
def test_words_met_once_go_first_and_ids_stay(name, keeps):
    own, whole = encoder(tokenizer_file(name), keeps, words=40), Tokenizer.from_file(tokenizer_file(name))
    texts = [" ".join(f"w{i}x{k} often été," for k in range(10)) for i in range(30)] + ["<|endoftext|> a", None]
    for _ in range(2):
        for text in texts:
            ids, offsets = own.encode(pa.array([text], pa.string()))
            assert ids.tolist() == whole.encode(text or "", add_special_tokens=False).ids and offsets.tolist() == [0, len(ids)]
            assert len(own.slot) <= 40 + 40
    assert any("often" in w for w in own.slot)
    own.rest()
    assert len(own.slot) <= 40 and len(own.start) == len(own.slot) + 1 == len(own.again) + 1
    assert len(own.flat) == own.start[-1]


def test_packing_does_not_depend_on_what_workers_remember(spark):
    docs = [(i, " ".join(f"word{i * k} and" for k in range(50 * i))) for i in range(20)] + [(20, None), (None, "a b")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
    file = tokenizer_file("byte_bpe_50k.json")
    own = {"end_id": 0, "keeps_space": True, "capacity": 64}
    few = op2_packing.pieces(docs, file, slice_bytes=100, words=20, **own).collect()
    assert sorted(map(str, few)) == sorted(map(str, op2_packing.pieces(docs, file, **own).collect()))


def test_stages_are_emptied_without_python_workers(spark, monkeypatch):
    stage = materialise(spark.range(5).selectExpr("id", "array(id) AS `a b`", "map('x', id) AS m"))
    path = stage._stage_path
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *_: pytest.fail("an empty list goes through Python workers"))
    discard(stage)
    left = spark.read.parquet(path)
    assert left.dtypes == stage.dtypes and left.count() == 0
