"""Ranked lexical search: MaxScore whose bounds come from pairs of terms.

One narrow pass over the texts writes an index: per document the number of its terms and, for the
terms of the items, how often each occurs. From it come the counts that weights need, and then every
task answers all items over the documents it holds, block by block; only its best documents leave.

A block has its own inverted lists with impacts. The terms of an item are paired, neighbours in
weight together, and for every pair the block precomputes the *intersection list*: the documents
that hold both terms, their joint impact and its maximum. A document that holds both is bounded by
the joint maximum, one that holds a single term by that term's, so a pair is bounded by the larger
of these, which is often far below the sum of two maxima that no document attains together.
MaxScore adds the pair bounds from the least on: pairs whose bounds together stay below the score
an item already needs cannot lift a document alone. Only documents of the other pairs are
candidates; they meet the left-out pairs from the largest bound down, first the intersection list,
then, as far as the bound of a single term still allows, the two lists, and leave as soon as what
is left cannot suffice. No document is left out that could still enter: bounds equal to the needed
score go on, because of ties.

Items are answered in blocks of at most ``ITEMS``, whose terms are broadcast; the results of tasks
are merged in two steps. Terms are met by 64-bit hash and length.

Defined results: a null or empty text has no terms and is never listed; equal scores go by doc_id,
null last; repeated document rows are listed one by one; equal rows of an item (id and text) are one
item; an item without known terms, or an empty table, gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugework.llm.common import document_runs, narrowed, stored, table, text_buffer, word_hashes

TOP = 20
#: Items that are answered together; their terms are broadcast.
ITEMS = 2_000
#: Documents of a block, which has inverted lists of its own.
BLOCK = 16_384
#: Tasks whose best documents are merged in the first of two steps.
MERGED = 256
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(TERM)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall((text or "").translate(_LOWER))


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes separate terms, and each byte with A-Z lower-cased."""
    code = np.arange(256)
    letter = (code >= 0x41) & (code <= 0x5A) | (code >= 0x61) & (code <= 0x7A)
    separator = (code < 0x80) & ~letter & ~((code >= 0x30) & (code <= 0x39))
    return separator, np.where((code >= 0x41) & (code <= 0x5A), code + 32, code)


@dataclass
class Vocabulary:
    """The terms of a block of items by number, and the items as (id, [(term, repeats)])."""

    terms: list[str]
    items: list[tuple[int | None, list[tuple[int, int]]]]

    @staticmethod
    def of(items: list[tuple[int | None, str | None]]) -> Vocabulary:
        number: dict[str, int] = {}
        made = []
        for item_id, text in items:
            counted = Counter(terms_of(text))
            made.append((item_id, [(number.setdefault(t, len(number)), n) for t, n in counted.items()]))
        return Vocabulary(list(number), made)

    def hashed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes of the terms, their numbers and lengths in bytes."""
        data, offsets = text_buffer(pa.array(self.terms, pa.string()))
        h, doc, first, end = word_hashes(data, offsets, *_byte_tables())
        order = np.argsort(h)
        if (h[order][1:] == h[order][:-1]).any():
            raise ValueError("two terms have one hash")
        return h[order], doc[order], (end - first)[order]


def build_index(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n, terms, counts): all terms of each document counted, and which terms of the
    vocabulary it holds how often."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary.hashed())

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number, size = shared.value
        tables = _byte_tables()
        for batch in batches:
            data, offsets = text_buffer(batch["text"])
            for a, b in document_runs(offsets):
                part = data[offsets[a] : offsets[b]]
                h, doc, first, end = word_hashes(part, offsets[a : b + 1] - offsets[a], *tables)
                n = np.bincount(doc, minlength=b - a)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    hit = (known[at] == h) & (size[at] == end - first)
                else:
                    at, hit = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
                both, count = np.unique(doc[hit] << 32 | number[at[hit]], return_counts=True)
                cuts = pa.array(np.searchsorted(both >> 32, np.arange(b - a + 1)).astype(np.int32))
                lists = [
                    pa.ListArray.from_arrays(cuts, pa.array(c.astype(np.int32)))
                    for c in (both & 0xFFFFFFFF, count)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), pa.array(n.astype(np.int64)), *lists],
                    ["doc_id", "n", "terms", "counts"],
                )

    rows = narrowed(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(index, "doc_id long, n long, terms array<int>, counts array<int>")


@dataclass
class Statistics:
    """N, L and the weight of each term of the vocabulary."""

    documents: int
    length: int
    weight: np.ndarray


def statistics(index: DataFrame, terms: int) -> Statistics:
    n, length = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = np.zeros(terms, np.int64)
    held = index.select(F.explode("terms").alias("term")).groupBy("term").count()
    for term, df in held.toLocalIterator():  # as many rows as the vocabulary has terms
        weight[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
    return Statistics(n, length, weight)


def pairs_of(terms: list[tuple[int, int]], weight: np.ndarray) -> list[tuple[tuple[int, int], ...]]:
    """The terms of an item that have a weight, paired with their neighbours in weight; a last one may be alone."""
    order = sorted((t for t in terms if weight[t[0]] > 0), key=lambda t: (weight[t[0]], t[0]))
    return [tuple(sorted(order[i : i + 2])) for i in range(0, len(order), 2)]


class Block:
    """Inverted lists of some documents, with the impacts of single terms and of pairs."""

    def __init__(self, n: np.ndarray, terms: pa.ListArray, counts: pa.ListArray, stats: Statistics) -> None:
        doc = np.repeat(np.arange(len(n)), terms.value_lengths().to_numpy())
        term, tf = (c.flatten().to_numpy().astype(np.int64) for c in (terms, counts))
        m = 75 + (25 * n * stats.documents) // max(stats.length, 1)
        impact = stats.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        order = np.argsort(term, kind="stable")
        self.size, self.doc, self.impact = len(n), doc[order], impact[order]
        self.cut = np.searchsorted(term[order], np.arange(len(stats.weight) + 1))
        self.joint: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        self.bound: dict[tuple, int] = {}
        #: The most that a document may have which holds one term of a pair.
        self.alone: dict[tuple, int] = {}

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.cut[term], self.cut[term + 1]
        return self.doc[a:b], self.impact[a:b]

    def precompute(self, pair: tuple[tuple[int, int], ...]) -> None:
        """The intersection list of a pair, its joint maximum and the bound that follows."""
        if pair in self.bound:
            return
        lists = [(d, q * i) for d, i, q in ((*self.postings(t), q) for t, q in pair)]
        self.alone[pair] = self.bound[pair] = max(int(i.max(initial=0)) for _, i in lists)
        if len(pair) == 2:
            (d, i), (e, j) = sorted(lists, key=lambda x: len(x[0]))
            at = np.minimum(np.searchsorted(e, d), max(len(e) - 1, 0))
            both = e[at] == d if len(e) else np.zeros(0, bool)
            joint = i[both] + j[at[both]]
            self.joint[pair] = d[both], joint
            self.bound[pair] = max(self.bound[pair], int(joint.max(initial=0)))

    def search(self, pairs: list[tuple], needed: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents whose score reaches ``needed`` (at least 1), and their scores."""
        pairs = sorted(pairs, key=self.bound.__getitem__)
        total = np.cumsum([0, *(self.bound[p] for p in pairs)])
        spared = int(np.searchsorted(total, needed, side="left")) - 1  # pairs that cannot suffice
        score = np.zeros(self.size, np.int64)
        for pair in pairs[spared:]:
            for term, repeats in pair:
                doc, impact = self.postings(term)
                score[doc] += repeats * impact
        found = np.flatnonzero((score > 0) & (score + total[spared] >= needed))
        score = score[found]
        for k in range(spared - 1, -1, -1):
            pair, rest = pairs[k], total[k]
            apart = np.ones(len(found), bool)
            if len(pair) == 2:
                at, hit = _looked_up(self.joint[pair][0], found)
                score[hit] += self.joint[pair][1][at[hit]]
                apart = ~hit
            apart &= score + self.alone[pair] + rest >= needed
            for term, repeats in pair:
                doc, impact = self.postings(term)
                at, hit = _looked_up(doc, found)
                hit &= apart
                score[hit] += repeats * impact[at[hit]]
            held = score + rest >= needed
            found, score = found[held], score[held]
        return found, score


def _looked_up(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``wanted`` stand in the sorted ``values``, and which of them do."""
    if not len(values):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return at, values[at] == wanted


class Best:
    """The best documents of an item so far: highest score first, then doc_id, null last."""

    def __init__(self) -> None:
        self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def needed(self) -> int:
        return int(self.score[-1]) if len(self.score) == TOP else 1

    def add(self, score: np.ndarray, doc_id: np.ndarray, null: np.ndarray) -> None:
        score, doc_id, null = (
            np.concatenate(c) for c in ((self.score, score), (self.id, doc_id), (self.null, null))
        )
        order = np.lexsort((doc_id, null, -score))[:TOP]
        self.score, self.id, self.null = score[order], doc_id[order], null[order]


def best_of_tasks(index: DataFrame, vocabulary: Vocabulary, stats: Statistics) -> DataFrame:
    """(item, item_id, task, doc_id, score): the best documents that each task holds for an item."""
    work = [(item_id, pairs_of(terms, stats.weight)) for item_id, terms in vocabulary.items]
    shared = index.sparkSession.sparkContext.broadcast((work, stats))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, stats = shared.value
        best = [Best() for _ in work]
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                part = batch.slice(first, BLOCK)
                block = Block(part["n"].to_numpy(), part["terms"], part["counts"], stats)
                null = part["doc_id"].is_null().to_numpy(zero_copy_only=False)
                doc_id = part["doc_id"].fill_null(0).to_numpy()
                for pair in {p for _, pairs in work for p in pairs}:
                    block.precompute(pair)
                for mine, (_, pairs) in zip(best, work, strict=True):
                    found, score = block.search(pairs, mine.needed)
                    if len(found):
                        mine.add(score, doc_id[found], null[found])
        task = TaskContext.get().partitionId()
        size = [len(b.score) for b in best]
        columns = [
            pa.array(np.repeat(np.arange(len(best), dtype=np.int32), size)),
            pa.array([work[k][0] for k, n in enumerate(size) for _ in range(n)], pa.int64()),
            pa.array(np.full(sum(size), task, np.int32)),
            pa.array(np.concatenate([b.id for b in best]), mask=np.concatenate([b.null for b in best])),
            pa.array(np.concatenate([b.score for b in best])),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "task", "doc_id", "score"])

    return index.mapInArrow(answer, "item int, item_id long, task int, doc_id long, score long")


def search(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item (item_id, text) its best documents."""
    spark = documents.sparkSession
    items = items.select(F.col("item_id").cast("long"), "text").distinct()
    blocks = max(1, -(-items.count() // ITEMS))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    dealt = stored(dealt, "items") if blocks > 1 else dealt
    found = []
    for k in range(blocks):
        rows = [tuple(r) for r in dealt.where(F.col("block") == k).select("item_id", "text").collect()]
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        if not rows:
            continue
        vocabulary = Vocabulary.of(rows)
        index = stored(build_index(documents, vocabulary), "lexical-index")
        stats = statistics(index, len(vocabulary.terms))
        found.append(best_of_tasks(index, vocabulary, stats).withColumn("block", F.lit(k)))
    none = spark.createDataFrame([], "item int, item_id long, task int, doc_id long, score long, block int")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = Window.partitionBy("block", "item", (F.col("task") / MERGED).cast("int")).orderBy(*order)
    merged = reduce(DataFrame.unionAll, found, none)
    merged = merged.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= TOP)
    whole = Window.partitionBy("block", "item").orderBy(*order)
    ranked = merged.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= TOP)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark item its 20 best documents."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
c AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_all FROM d),
i AS (
  SELECT item_id, t, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
  GROUP BY item_id, t),
p AS (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY k, t),
f AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY t, n_docs),
s AS (
  SELECT item_id, p.k, doc_id,
    sum(q * f.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(d.w) * n_docs) // n_all))))::BIGINT AS score
  FROM i JOIN p USING (t) JOIN f USING (t) JOIN d ON d.k = p.k, c GROUP BY item_id, p.k, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 20
"""
