"""The fault of round 3 in ``op3_pieces``: memory of the executors."""

import random

import numpy as np
import pyarrow as pa

from gaugework.llm import pieces


def test_what_all_workers_share_is_small():
    # Each Python worker holds the broadcast units and the vocabulary: buffers, no strings of Python.
    coder = pieces.Coder(pieces.default_path())
    assert not {"ranks", "table"} & set(vars(coder))
    units = ["▁das", "zq☃x", "", "é" * 3, "y" * (pieces.LONG + 5), "▁😀", "▁a"]
    borders = [sum(1 << k for k in range(len(u) + 1)) if len(u) <= pieces.LONG else None for u in units]
    ids, size = coder.spelled(pa.array(units), pa.array(borders, pa.int64()))
    assert isinstance(ids, np.ndarray) and size.sum() == len(ids)
    wanted = []
    for u in units:
        single = [coder.ranks.get(c, (None,))[0] for c in u]
        spelled = [[i] if i is not None else [coder.byte_zero + b for b in c.encode()] for c, i in zip(u, single, strict=True)]
        wanted.append(sum(spelled, []) if len(u) <= pieces.LONG else coder.long(u))
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == wanted


def test_merges_are_the_edges_of_two_characters_or_more():
    table = pieces.Coder(pieces.default_path()).table
    units = ["▁Straße", "", "▁theaesth", "日本", "▁▁▁"]
    edges, merges = (pieces.edges_of(table, units, m).to_pylist() for m in (False, True))
    for all_, some in zip(edges, merges, strict=True):
        assert some == [{"ends": e["ends"], "inside": e["inside"]} for e in all_ if e["end"] - e["begin"] > 1]


def test_words_and_units_are_those_of_the_plain_functions():
    r = random.Random(4)
    texts = ["", " ", "a", " a", "a ", "a  b", "a▁b c", "Wort, Wort. wort", "x,y é,. é, ²x 日本! .", "a\nb c\t d, e"]
    texts += ["".join(r.choice("abZé.,;▁ \n²́") for _ in range(r.randint(0, 40))) for _ in range(300)]
    texts += ["".join(r.choice("abZé.,; ") for _ in range(r.randint(0, 9))).strip() for _ in range(300)]
    words, places, n_words = pieces.words_in(pa.array(texts))
    units, flat, size = pieces.units_of_words(words)
    parts = [units.take(pa.array(p)).to_pylist() for p in np.split(flat, np.cumsum(size)[:-1])]
    found = [sum((parts[k] for k in p), []) for p in np.split(places, np.cumsum(n_words)[:-1])]
    assert found == [pieces.units_of(t) for t in texts] and len(set(units.to_pylist())) == len(units)


def test_no_null_list_goes_to_a_python_worker(spark):
    # Spark's Arrow writer passes over the nulls of a list column anew for every row of a batch, and
    # a third worker per task held the ids once more.
    documents = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    found = pieces.piece_counts(documents, pieces.default_path())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    last = [line for line in plan.splitlines() if "MapInArrow" in line]
    assert len(last) == 2 and "own" in last[0] + last[1]
    both = pieces.encode(documents, pieces.default_path(), "text")
    again = pieces.decode(pieces.encode(documents, pieces.default_path()), pieces.default_path())
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, again.select(both.columns).collect()))
