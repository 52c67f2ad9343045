"""Lexical search, suffix arrays and the filter audit against brute force, and their edge cases."""

import hashlib
import math
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from test_llm import EDGES, frame

from gaugework.llm import filter_audit, induced, lexical, suffixes

SF = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    key = lambda r: tuple((v is None, v) for v in r)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)


# --- lexical search ---------------------------------------------------------------------------


def ranked(docs, items, top):
    texts = [(d, Counter(lexical.terms_of(t))) for d, t in docs]
    n_docs = sum(1 for _, c in texts if c)
    length = sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in texts:
            score = 0
            for t in lexical.terms_of(text):
                if c[t]:
                    m = 75 + (25 * sum(c.values()) * n_docs) // length
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc))
        scored.sort(key=lambda x: x[:2] + (x[2] or 0,))
        out += [(item, k, d, -s) for k, (s, _, d) in enumerate(scored[:top], 1)]
    return sorted(out, key=lambda r: tuple((v is None, v) for v in r))


ITEMS = [(1, "w1 w2 w3 w3 w40 W50"), (2, "w7 w7 w8"), (3, None), (4, ""), (5, "nowhere"), (None, "w1 ß日本"), (7, "twice a")]


@pytest.mark.parametrize("block,items", [(16_384, 2_000), (17, 2)])
def test_search_is_brute_force(spark, monkeypatch, block, items):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "ITEMS", items)
    r = random.Random(5)
    docs = [(i // 2, " ".join(f"w{int(r.expovariate(0.05))}" for _ in range(r.randint(0, 60)))) for i in range(400)]
    docs += EDGES + docs[:20] + [(None, "w7 w8 w8"), (900, "W1 ß日本,x")]
    found = lexical.search(frame(spark, docs, extra=True).repartition(3), spark.createDataFrame(ITEMS + ITEMS[:1], "item_id long, text string"))
    assert rows_of(found, "item_id", "rank", "doc_id", "score") == ranked(docs, ITEMS, lexical.TOP)


def test_pair_bounds_hold_and_spare_documents():
    r = np.random.default_rng(2)
    import pyarrow as pa

    n, vocabulary = 3_000, 40
    lists = [np.sort(r.choice(vocabulary, r.integers(0, 9), replace=False)) for _ in range(n)]
    terms = pa.array([x.tolist() for x in lists], pa.list_(pa.int32()))
    counts = pa.array([r.integers(1, 5, len(x)).tolist() for x in lists], pa.list_(pa.int32()))
    stats = lexical.Statistics(n, 30_000, r.integers(0, 9_000, vocabulary))
    block = lexical.Block(r.integers(1, 40, n), terms, counts, stats)
    pairs = lexical.pairs_of([(t, 1 + t % 2) for t in range(0, vocabulary, 3)], stats.weight)
    for pair in pairs:
        block.precompute(pair)
        both = np.zeros(n, np.int64)
        for term, repeats in pair:
            doc, impact = block.postings(term)
            both[doc] += repeats * impact
        assert block.bound[pair] == both.max()
    everything, score = block.search(pairs, 1)
    for needed in (int(score.max()), int(np.sort(score)[-20]), 10**9):
        found, some = block.search(pairs, needed)
        assert found.tolist() == everything[score >= needed].tolist() and (some == score[score >= needed]).all()


def test_search_empty(spark):
    none = frame(spark, [])
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(none, items).count() == 0
    assert lexical.search(frame(spark, EDGES), items.where("false")).count() == 0


# --- suffix arrays ----------------------------------------------------------------------------


def sorted_suffixes(text, depth):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    shared = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while k < depth and a + k < len(text) and b + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        shared.append(k)
    return order, shared


@pytest.mark.parametrize("base,memory", [(1 << 22, 64_000_000), (0, 64_000_000), (0, 64)])
def test_induced_sorting(monkeypatch, base, memory):
    monkeypatch.setattr(induced, "BASE", base)
    monkeypatch.setattr(induced, "IN_MEMORY", memory)  # 64 bytes: arrays lie on disk
    monkeypatch.setattr(induced, "STEP", 7)
    monkeypatch.setattr(induced.Queue.__init__, "__defaults__", (memory,))
    r = random.Random(3)
    for trial in range(60):
        n, k = r.randint(0, 50), r.choice([1, 2, 3, 200, 100_000])
        text = [r.randint(1, k) for _ in range(n)]
        if trial % 3 == 0:
            text = (text[: r.randint(1, 7)] * 50)[:n]
        text.append(0)
        depth = r.choice([4, 50])
        order, shared = induced.suffix_array(np.array(text), depth)
        assert (order.tolist(), shared.tolist()) == sorted_suffixes(text, depth)


def test_queue_gives_equal_keys_in_their_order():
    queue, r = induced.Queue(100), np.random.default_rng(1)
    pushed = []
    for _ in range(60):
        key = r.integers(0, 9, r.integers(0, 30))
        at = np.arange(len(key)) + len(pushed)
        pushed += list(zip(key.tolist(), at.tolist()))
        queue.push(key, at, at)
    out = []
    while (block := queue.peek(5)) is not None:
        count = int(r.integers(1, len(block[0]) + 1))
        queue.pop(count)
        out += list(zip(block[0][:count].tolist(), block[1][:count].tolist()))
    assert out == sorted(pushed)


def uncovered(rows, window):
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - window + 1) if doc is not None else ():
            first[data[i : i + window]] = min(doc, first.get(data[i : i + window], doc))
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1) if doc is not None else ():
            if first[data[i : i + window]] < doc:
                gone[i : i + window] = b"\1" * window
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: tuple((v is None, v) for v in r))


@pytest.mark.parametrize("hot,different,size", [(20_000, 300_000, 2_000_000), (3, 10, 2_000_000), (20_000, 10, 0)])
def test_copies_go_as_by_brute_force(spark, monkeypatch, hot, different, size):
    monkeypatch.setattr(suffixes, "SHARD_BYTES", size)
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "DIFFERENT", different)
    r = random.Random(9)
    words = ["".join(r.choice("abcde \0é") for _ in range(r.randint(3, 9))) for _ in range(40)]
    line = "the same line of some sixty bytes stands in a third of all texts"
    rows = []
    for i in range(150):
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 40)))
        if i % 3 == 0:
            text = text[: len(text) // 2] + line + text[len(text) // 2 :]
        if i % 7 == 0 and rows:
            text = rows[r.randrange(len(rows))][1][r.randint(0, 9) :] + text
        rows.append((r.choice([i, i, i // 2, None]), text))
    long = "wort " * 3_000
    rows += rows[:9] + [(1, None), (2, ""), (3, "x" * 5_000), (4, "x" * 4_999), (None, long), (5, long), (6, long[:-3]), (6, long[1:])]
    docs = frame(spark, rows, extra=True).repartition(5)
    done = suffixes.without_copies(docs)
    assert set(done.columns) == {*docs.columns, *suffixes.COLUMNS}
    found = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in done.collect()]
    assert sorted(found, key=lambda r: tuple((v is None, v) for v in r)) == uncovered(rows, suffixes.WINDOW)


def test_copies_edges(spark):
    out = rows_of(suffixes.without_copies(frame(spark, EDGES, extra=True)), "doc_id", "n_bytes", "n_removed")
    assert [n for *_, n in out] == [0] * len(EDGES)
    assert suffixes.without_copies(frame(spark, [])).count() == 0


# --- filter audit -----------------------------------------------------------------------------


def test_positional_popcount():
    r = np.random.default_rng(4)
    for n in (0, 1, 63, 64, 65, 1_000, 5_003):
        words = r.integers(0, 1 << 32, n, dtype=np.uint32)
        assert filter_audit.positional_popcount(words).tolist() == [int((words >> i & 1).sum()) for i in range(32)]


def audited(rows, good, toxic):
    """Every order simulated on the documents themselves."""
    failed = []
    for doc, text, source in rows:
        t = text or ""
        w = t.encode().split()
        f = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w))
        f += "C" * (100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t)) + "D" * any(c in "#$%&*|" for c in t)
        f += "E" * any(d is not None and doc is not None and d < doc and (x or "") == t for d, x, _ in rows)
        failed.append((source or "", set(f), doc in good, doc in toxic))
    out = []
    for part in {p for p, *_ in failed}:
        mine = [x[1:] for x in failed if x[0] == part]
        rows_here, share = [], Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order, 1):
                removed = [x for x in left if c in x[0]]
                left = [x for x in left if c not in x[0]]
                share[c] += len(removed)
                redundant = sum(c in x[0] for x in mine) - len(removed)
                only = sum(x[0] == {c} for x in mine)
                lost = sum(x[1] for x in removed), sum(x[2] for x in removed)
                rows_here.append(("".join(order), step, len(left), len(removed), redundant, only, *lost, c))
        out += [(part, *r[:-1], share[r[-1]]) for r in rows_here]
    return sorted(out, key=lambda r: tuple((v is None, v) for v in r))


def test_audit_is_every_order_simulated(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS", 1)
    r = random.Random(8)
    texts = [" ".join(r.choice(["Ab", "c", "d#", "ef", "GH"][: r.randint(1, 5)]) + str(r.randrange(r.choice([3, 400]))) for _ in range(r.choice([5, 150, 260]))) for _ in range(25)]
    rows = [(r.choice([i, i, None]), r.choice(texts), r.choice(["web", "web", "wiki", "", None])) for i in range(120)]
    rows += [(d, t, "edge") for d, t in EDGES] + [(3, texts[0], "web"), (3, texts[0], "web")]
    docs = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, source string, failed int, part string")
    marks = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 100, 3)] + [(6, 1, 0), (6, None, None), (None, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    known = [m for m in marks if m[0] is not None]
    want = audited(rows, {d for d, q, _ in known if q == 1}, {d for d, _, t in known if t == 1})
    out = filter_audit.audit(filter_audit.subset_survivors(filter_audit.failed_filters(docs, labels)))
    assert rows_of(out, *out.columns) == want
    assert filter_audit.audit(filter_audit.subset_survivors(filter_audit.failed_filters(docs.where("false"), labels))).count() == 0
