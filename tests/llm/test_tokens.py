"""Token files and packing against plain encoding."""

import zlib
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cargoscope.llm import op1_token_store, op2_packing
from cargoscope.llm.encoding import WordEncoder
from cargoscope.llm.registry import tokenizer_file

WORD, BYTE = tokenizer_file("word_bpe_49k.json"), tokenizer_file("byte_bpe_50k.json")
ODD = ["", " ", "\n", "a b", "It's  two", "x. Y,\nZ.\n\n q ", "é İΣ <|endoftext|>", "\x01 a\x01b ", None]


def plain(path, texts, control_ids=True):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = not control_ids
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize(("path", "keeps"), [(WORD, False), (BYTE, True)])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(alphabet=" \n\t ab,.'s!é̈T1\x01\x1c<|>", max_size=30), max_size=6))
def test_encoder_equals_whole_texts(path, keeps, texts):
    ids, offsets = WordEncoder(path, keeps).encode(pa.array([*texts, *ODD], pa.string()))
    for i, want in enumerate(plain(path, [*texts, *ODD])):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == want


CONTROLS = st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", " ", "a b", "x.Y", "\n", "\x01"])


@pytest.mark.parametrize("control_ids", [True, False])
@pytest.mark.parametrize(("path", "keeps"), [(WORD, False), (BYTE, True)])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.lists(CONTROLS, max_size=6).map("".join), max_size=5))
def test_control_strings_in_texts(path, keeps, control_ids, texts):
    ids, offsets = WordEncoder(path, keeps, control_ids).encode(pa.array([*texts, *ODD], pa.string()))
    for i, want in enumerate(plain(path, [*texts, *ODD], control_ids)):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == want


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def documents(spark, extra=()):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + list(extra)
    return spark.createDataFrame(rows, "doc_id long, text string, shard string")


def test_store_round_trip(spark):
    docs = documents(spark, [(3, "again", "x"), (3, "again", "x"), (None, "no key", "x")])
    got = op1_token_store.document_index(spark, docs, WORD, end_id=1).collect()
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for (key, _), ids in zip(rows, plain(WORD, [t for _, t in rows]), strict=True):
        want.append((key, at, len(ids) + 1, crc([*ids, 1])))
        at += len(ids) + 1
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want


def test_store_with_a_third_of_the_rows_under_one_key(spark):
    rows = [(7, f"text {i % 90} of a hot key", "x") for i in range(300)] + [(7, "same", "x")] * 100
    rows += [(100 + i, f"other {i}", "x") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(6)
    got = sorted(op1_token_store.document_index(spark, docs, WORD, end_id=1).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(k for k, _, _ in rows)
    want = sorted((k, crc([*ids, 1])) for (k, _, _), ids in zip(rows, plain(WORD, [t for _, t, _ in rows]), strict=True))
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    # The hot key lies in several files.
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) > 1


def test_id_too_wide_for_the_store_is_an_error(spark):
    docs = spark.createDataFrame([(1, "a few words here")], "doc_id long, text string")
    with pytest.raises(Exception, match="does not fit 1 bytes"):
        op1_token_store.write_store(docs, WORD, end_id=1, id_bytes=1)


def test_store_lookup_of_absent_keys(spark):
    store = op1_token_store.write_store(documents(spark), WORD, end_id=1)
    keys = spark.createDataFrame([(2, 0), (2, 1), (99, 0), (None, 0)], "key long, copy int")
    found = op1_token_store.read_ids(store, op1_token_store.lookup(store, keys)).collect()
    assert [(r.key, r.copy) for r in found] == [(2, 0)]
    assert np.frombuffer(found[0].ids, "<u4").tolist() == [1]


def test_store_empty(spark):
    assert op1_token_store.document_index(spark, documents(spark).limit(0), WORD, end_id=1).count() == 0


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(3)
    h1, h2 = rng.integers(0, 2**64, (2, 20_000), np.uint64)
    bits, sizes, slot = op1_token_store.build_hash(h1, h2)
    assert sorted(slot) == list(range(20_000))
    assert (op1_token_store.find_slots(bits, sizes, h1, h2) == slot).all()


def test_packing(spark):
    docs = documents(spark, [(20, "word " * 5000, "x"), (21, "ab " * 900, "x"), (21, "ab " * 900, "x"), (None, "k", "x")])
    rows = op2_packing.pack(docs, BYTE, capacity=64, with_ids=True).collect()
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.piece)):
        assert r.length <= 64 and r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        by_doc.setdefault(r.doc_id, []).append(r)
    source = docs.collect()
    for key in {r.doc_id for r in source} - {21}:
        text = next(r.text for r in source if r.doc_id == key)
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in by_doc[key]), "<u4").tolist()
        assert ids == [*plain(BYTE, [text])[0], 0]
        assert [r.start for r in by_doc[key]] == np.cumsum([0, *(r.length for r in by_doc[key])])[:-1].tolist()
        assert all(r.length == 64 for r in by_doc[key][1:])
    assert sum(r.length for r in by_doc[21]) == 2 * (len(plain(BYTE, ["ab " * 900])[0]) + 1)
    check_places(rows, 64)
    joined = op2_packing.sequences(op2_packing.pack(docs, BYTE, capacity=64, with_ids=True))
    assert joined.where(F.length("ids") != 4 * F.col("length")).count() == 0
    assert op2_packing.pack(docs.limit(0), BYTE).count() == 0


def check_places(rows, capacity):
    """Sequences are filled without gaps from 0 and within capacity."""
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= capacity
    return len(at)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 24), min_size=1, max_size=60))
def test_plan_places_every_piece(lengths):
    histogram = {x: lengths.count(x) for x in set(lengths)}
    plan = op2_packing.packing_plan(histogram, 24)
    seen, used = set(), {}
    for r in plan.itertuples():
        last = plan[(plan.length == r.length) & (plan["first"] > r.first)]["first"].min()
        end = histogram[r.length] if np.isnan(last) else int(last)
        for rank in range(r.first, end):
            i = rank - r.first
            where = (r.sequence + i // r.copies, r.offset + i % r.copies * r.length)
            assert where not in seen
            seen.add(where)
            used[where[0]] = used.get(where[0], 0) + r.length
    assert len(seen) == len(lengths) and max(used.values()) <= 24


def fewest(lengths, capacity):
    """Exact minimum by trying all ways (few pieces)."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
def test_reduction_loses_nothing(lengths):
    """What is fixed plus the optimum of the rest is the optimum of all."""
    counts = np.bincount(lengths, minlength=13).astype(np.int64)
    fixed = op2_packing.reduce_dominated(counts, 12)
    rest = [int(x) for x in np.repeat(np.arange(13), counts)]
    ordered = sorted(lengths, reverse=True)
    assert sum(t for _, t in fixed) + (fewest(sorted(rest, reverse=True), 12) if rest else 0) == fewest(ordered, 12)


def test_largest_pair():
    for sizes in combinations_with_replacement(range(1, 7), 4):
        values, counts = np.unique(sizes, return_counts=True)
        for room in range(1, 13):
            sums = [a + b for i, a in enumerate(sizes) for b in sizes[i + 1 :] if a + b <= room]
            assert sum(op2_packing._largest_pair(values, counts, room)) == max(sums, default=0)
