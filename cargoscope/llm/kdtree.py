"""K-d trees over letter-count vectors, and range searches that prune boxes.

A vector counts a word's letters (code points below 256). One replaced letter takes one letter's count
down and another's up by one; one inserted letter takes one count up. A box out of reach of these steps
holds no such neighbour.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LETTERS = 256


@dataclass
class Node:
    """A box, cut at ``count(letter) <= at`` (left) against above (right); a leaf has no letter."""

    letter: int = -1
    at: int = 0
    left: Node | None = None
    right: Node | None = None
    name: int = -1
    rows: np.ndarray | None = None


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """Counts of all letters per row of codes (rows x length)."""
    n, width = codes.shape
    flat = codes.astype(np.int64) + np.arange(n, dtype=np.int64)[:, None] * LETTERS
    return np.bincount(flat.ravel(), minlength=n * LETTERS).reshape(n, LETTERS).astype(np.int32)


def reach(root: Node, counts: np.ndarray, up: int, down: int) -> Iterator[tuple[Node, np.ndarray]]:
    """Leaves, each with the rows of ``counts`` that ``up`` and ``down`` steps may take into its box."""
    n = len(counts)
    start = (root, np.arange(n), np.zeros(n, np.int32), np.zeros(n, np.int32), {})
    stack = [start]
    while stack:
        node, rows, ups, downs, box = stack.pop()
        if not len(rows):
            continue
        if node.letter < 0:
            yield node, rows
            continue
        have = counts[rows, node.letter]
        low, high = box.get(node.letter, (0, np.iinfo(np.int32).max))
        # A letter's distance from its range, which only the new bound can have enlarged.
        over = np.maximum(have - node.at, 0) - np.maximum(have - high, 0)
        keep = (downs + over) <= down
        stack.append((node.left, rows[keep], ups[keep], (downs + over)[keep], box | {node.letter: (low, node.at)}))
        under = np.maximum(node.at + 1 - have, 0) - np.maximum(low - have, 0)
        keep = (ups + under) <= up
        stack.append((node.right, rows[keep], (ups + under)[keep], downs[keep], box | {node.letter: (node.at + 1, high)}))


def grow(counts: np.ndarray, leaf: int) -> Node:
    """A tree over rows of ``counts`` whose leaves hold at most ``leaf`` rows, unless all are alike."""
    root = Node(rows=np.arange(len(counts)))
    stack = [root]
    while stack:
        node = stack.pop()
        if len(node.rows) <= leaf:
            continue
        here = counts[node.rows]
        best = None
        for at in range(int(here.max())):
            share = (here > at).mean(axis=0)
            letter = int(np.argmin(np.abs(share - 0.5)))
            if 0 < share[letter] < 1 and (best is None or abs(share[letter] - 0.5) < best[0]):
                best = (abs(share[letter] - 0.5), letter, at)
        if best is None:
            continue
        _, node.letter, node.at = best
        above = here[:, node.letter] > node.at
        node.left, node.right = Node(rows=node.rows[~above]), Node(rows=node.rows[above])
        node.rows = None
        stack += [node.left, node.right]
    return root
