"""Faults found in round 3."""

import random

import numpy as np
import pyarrow as pa

from gaugework.llm import induced, suffixes


def order_of(text):
    return induced.suffix_array(np.array(text), 50)[0].tolist()


def test_seed_substring_that_ends_with_its_key():
    # three symbols fit into a key; one seed substring ends there, a longer one goes on.
    text = [600_000, 3, 600_000, 3, 600_000, 3, 3, 0]
    assert order_of(text) == sorted(range(len(text)), key=lambda i: text[i:])
    r = random.Random(3)
    for _ in range(400):
        text = [r.choice([1, 2, 3, 600_000]) for _ in range(r.randint(5, 60))] + [0]
        assert order_of(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_rows_of_lone_anchors_need_no_loop():
    anchor = np.array([1, 2, 2, 3, 3, 4])
    piece = pa.array([b"a", b"b", b"b", b"c", b"d", b"d"], pa.binary())
    alone, covered = suffixes._alone(anchor, piece, np.array([1, 4, 7, 1, 1, 9]))
    assert alone.tolist() == [False, True, True, False, False, False]
    assert covered.tolist() == [False, False, True, False, False, False]
    assert suffixes._bytes(piece[1:4]) == [b"b", b"b", b"c"] and suffixes._bytes(piece[:0]) == []
