"""op11: whole tries against a plain loop, and edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from cargoscope.llm import op11_prefix_trie as op11

SHAPE = "conv_id long, turn long, role string, text string"


def rebuilt(data):
    own = defaultdict(list)
    for c, turn, role, text in data:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(rows)] for c, rows in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def plain(data):
    convs = rebuilt(data)
    member, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            member[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for node in member:
        if node:
            children[node[:-1]].append(node)
    rows = {}
    for node in sorted(member, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        kids = children[node]
        leaves = sum(rows[k][5] for k in kids) if kids else 1
        saved = (len(member[node]) - 1) * words + sum(rows[k][6] for k in kids)
        ids = ",".join(map(str, sorted(ends.get(node, []))))
        up = min(member[node[:-1]]) if node else None
        rows[node] = (min(member[node]), len(node), up, len(member[node]), len(kids), leaves, saved, hashlib.sha256(ids.encode()).hexdigest())
    return sorted(rows.values(), key=repr)


def got(spark, data, block=op11.BLOCK):
    df = data if not isinstance(data, list) else spark.createDataFrame(data, SHAPE).repartition(3)
    out = op11.prefix_trie(op11.rebuilt(df), block)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def talks(seed, n=70, most=14):
    """Conversations that share beginnings of any length, some of them whole."""
    rng = random.Random(seed)
    told = [[]]
    for c in range(n):
        base = rng.choice(told)
        turns = base[: rng.randrange(len(base) + 1)] if rng.random() < 0.7 else list(base)
        while len(turns) < most and rng.random() < 0.75:
            turns = [*turns, (rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", None, "", " d\ne"]))]
        told.append(turns)
        for i, (role, text) in enumerate(turns):
            yield (c * rng.choice([1, 1, 3]) if c % 7 else c, None if i == 0 and c % 5 == 0 else i * 2, role, text)


@pytest.mark.parametrize(("seed", "block"), [(1, 4), (2, 4), (3, 1), (4, 3)])
def test_matches_a_plain_loop(spark, seed, block):
    data = list(talks(seed))
    assert got(spark, data, block) == plain(data)


def test_ties_repeats_nulls_and_odd_ids(spark):
    data = [(5, 1, "b", "x"), (5, 1, "a", "y"), (5, 1, "a", "y"), (5, 1, None, None), (None, 0, "user", "lost"), (-3, 0, "u", "v")]
    data += [(c, None, "u", "same words here") for c in (100, 101, 102, 103, 104, 105)]
    assert got(spark, data) == plain(data)


def test_empty_table_and_conversations_that_lose_all_turns(spark):
    assert got(spark, []) == []
    lone = [(c, 0, "u", "w") for c in (7, 27, 43, 999)]
    assert got(spark, lone) == plain(lone)
    assert plain(lone)[0][4] < 4


def test_long_conversations_and_texts(spark):
    long = [(20, i, "user", "word " * 3) for i in range(150)] + [(40, i, "user", "word " * 3) for i in range(150)]
    data = [*long, (60, 0, "user", "x " * 300_000)]
    assert got(spark, data) == plain(data)


def test_one_conversation_holds_most_rows_and_one_is_copied(spark):
    data = [(0, i, "u", f"t{i}") for i in range(400)]
    data += [(20 * c, i, "u", f"s{i}") for c in range(1, 60) for i in range(3)]
    assert got(spark, data) == plain(data)


def test_other_columns(spark):
    names = ["pos", "block", "d1", "tie", "words", "_key", "n", "h"]
    data = list(talks(9, n=20))
    df = spark.createDataFrame([(*r, *["v"] * len(names)) for r in data], ["conv_id", "turn", "role", "text", *names])
    assert got(spark, df) == plain(data)
