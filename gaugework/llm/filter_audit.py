"""Filter interaction audit: what five filters remove in every order, from truth-table words.

A document fails some of the filters A to E. Its *survival word* has a bit for each of the 32
subsets of filters, set where the document fails none of the subset. One pass adds the words up
per part and label by carry-save positional popcounts: sixteen words become one word of sixteens
and one each of eights, fours, twos and ones, and so on, so a bit is counted only where few words
are left. The 32 sums of a part, how many documents survive each subset, answer every question
about every order: what is kept after a prefix of an order is the sum of that subset.

Texts never move: the filters are looked at where a text is read, and what travels is a digest and
some flags per document. Only filter E looks at other documents; the least doc_id of each digest is
added up before it moves, and documents meet it in a join that Spark splits where one text has very
many copies. Labels come by doc_id, rows without one stay out of that join.

Defined results: a null text is empty and a null source the empty string; a null doc_id is neither
larger nor smaller than another, so E never fails there and no other row fails for it; rows of one
doc_id and text do not fail E for each other; a document is good (toxic) if any label row of its
doc_id says so; extra columns are ignored; an empty table has no part and gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm.common import anew, narrowed, table, words_of
from gaugework.llm.quality_rules import let

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
LABELS = ("all", "good", "toxic")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Parts that a task holds before it passes their sums on.
PARTS = 4_096


def failures(text: Column) -> Column:
    """A struct of booleans: whether a whole text fails the filters A to D."""
    text = F.coalesce(text, F.lit(""))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))

    def judged(words: Column) -> Column:
        return F.struct(
            (F.size(words) < 200).alias("A"),
            (100 * F.size(F.array_distinct(words)) < 50 * F.size(words)).alias("B"),
            (100 * capitals > 2 * F.length(text)).alias("C"),
            text.rlike(r"[#$%&*|]").alias("D"),
        )

    return let(words_of(text), judged)


def failed_filters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, good, toxic) per document: ``failed`` has bit k set where it fails the k-th
    filter."""
    documents = narrowed(documents, "doc_id", "text", "source")
    facts = documents.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
        failures(F.col("text")).alias("f"),
    ).select(
        "doc_id",
        "part",
        "digest",
        sum(F.col(f"f.{c}").cast("int") * (1 << k) for k, c in enumerate("ABCD")).alias("failed"),
    )
    known = facts.where("doc_id IS NOT NULL").withColumn("short", F.xxhash64("digest"))
    copies = (
        known.groupBy("digest")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first < last")
        .select(anew(F.xxhash64("digest")).alias("at"), F.col("digest").alias("same"), "first")
    )
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * 16
    met = known.join(copies, (anew(F.col("short")) == F.col("at")) & (F.col("digest") == F.col("same")), "left")
    marks = labels.groupBy("doc_id").agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    met = met.select("doc_id", "part", (F.col("failed") + later).alias("failed")).join(marks, "doc_id", "left")
    none = F.lit(False)
    met = met.select("part", "failed", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))
    return met.unionAll(facts.where("doc_id IS NULL").select("part", "failed", none, none))


def survival_words() -> np.ndarray:
    """The word of each set of failed filters: bit s is set where s and the set share none."""
    subsets, failed = np.arange(SUBSETS, dtype=np.uint32), np.arange(SUBSETS)
    return np.array([(np.uint32(1) << subsets[(subsets & f) == 0]).sum(dtype=np.uint32) for f in failed])


def _carry_save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three words added bit by bit: the carries and the sums."""
    either = a ^ b
    return (a & b) | (either & c), either ^ c


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit ``words`` have each bit set."""
    if len(words) < 64:
        return (words[:, None] >> np.arange(32, dtype=np.uint32) & np.uint32(1)).sum(axis=0, dtype=np.int64)
    planes = np.zeros((16, -(-len(words) // 16)), np.uint32)
    planes.reshape(-1)[: len(words)] = words
    total, weight, level = np.zeros(32, np.int64), 1, list(planes)
    while len(level) > 1:
        # Words of one weight, three at a time: their carries weigh twice as much.
        rest, carries = level[0], []
        for b, c in zip(level[1::2], [*level[2::2], np.zeros_like(rest)], strict=False):
            carry, rest = _carry_save(rest, b, c)
            carries.append(carry)
        total += weight * positional_popcount(rest)
        weight, level = 2 * weight, carries
    return total + weight * positional_popcount(level[0])


COUNTS = "part string, " + ", ".join(f"{label}_{s} long" for label in LABELS for s in range(SUBSETS))


def subset_survivors(failed: DataFrame) -> DataFrame:
    """(part, all_0 .. toxic_31): the documents of a part, the good and the toxic ones among them,
    that survive each subset of filters; bit k of the subset's number stands for filter k."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = survival_words()
        held: dict[str, np.ndarray] = {}

        def passed_on() -> pa.RecordBatch:
            sums = np.stack(list(held.values())) if held else np.zeros((0, 3 * SUBSETS), np.int64)
            columns = [pa.array(list(held), pa.string()), *(pa.array(c) for c in sums.T.copy())]
            held.clear()
            names = ["part", *(f"{label}_{s}" for label in LABELS for s in range(SUBSETS))]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            words = word[batch["failed"].to_numpy()]
            marks = [np.ones(len(words), bool)]
            marks += [batch[c].to_numpy(zero_copy_only=False) for c in ("good", "toxic")]
            parts = batch["part"].dictionary_encode()
            code, names = parts.indices.to_numpy(), parts.dictionary.to_pylist()
            order = np.argsort(code, kind="stable")
            cuts = np.searchsorted(code[order], np.arange(len(names) + 1))
            for k, name in enumerate(names):
                mine = order[cuts[k] : cuts[k + 1]]
                new = np.concatenate([positional_popcount(words[mine[m[mine]]]) for m in marks])
                held[name] = held[name] + new if name in held else new
            if len(held) > PARTS:
                yield passed_on()
        yield passed_on()

    sums = [F.sum(f"{label}_{s}").alias(f"{label}_{s}") for label in LABELS for s in range(SUBSETS)]
    return failed.mapInArrow(count, COUNTS).groupBy("part").agg(*sums)


def _steps() -> list[tuple[str, int, int, int]]:
    """(order, step, number of its filter, subset of the filters before it) of all orders."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            k = FILTERS.index(letter)
            out.append(("".join(order), step, k, before))
            before |= 1 << k
    return out


def audit(survivors: DataFrame) -> DataFrame:
    """A row per part, order and step from the survivors of each subset."""
    spark = survivors.sparkSession
    steps = _steps()
    literal = F.array(*[F.struct(*(F.lit(v).alias(n) for n, v in zip("oskb", s, strict=True))) for s in steps])
    vectors = survivors.select(
        "part", *[F.array(*[F.col(f"{label}_{s}") for s in range(SUBSETS)]).alias(label) for label in LABELS]
    )
    shares = []
    for k in range(len(FILTERS)):
        of = [b for _, _, x, b in steps if x == k]
        weights = {b: of.count(b) for b in sorted(set(of))}
        shares.append(sum(n * (F.get("all", F.lit(b)) - F.get("all", F.lit(b | 1 << k))) for b, n in weights.items()))
    vectors = vectors.withColumn("share", F.array(*shares))
    rows = vectors.select("*", F.explode(literal).alias("t"))
    own = F.call_function("shiftleft", F.lit(1), F.col("t.k"))
    after = F.col("t.b").bitwiseOR(own)

    def at(label: str, subset: Column) -> Column:
        return F.get(F.col(label), subset)

    def removed(label: str) -> Column:
        return at(label, F.col("t.b")) - at(label, after)

    everything = SUBSETS - 1
    return rows.select(
        "part",
        F.col("t.o").alias("filter_order"),
        F.col("t.s").alias("step"),
        at("all", after).alias("kept"),
        removed("all").alias("removed"),
        (at("all", F.lit(0)) - at("all", own) - removed("all")).alias("redundant"),
        (at("all", everything - own) - at("all", F.lit(everything))).alias("unique_fails"),
        removed("good").alias("good_lost"),
        removed("toxic").alias("toxic_lost"),
        F.get("share", F.col("t.k")).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part by part, every order of the five filters, step by step."""
    failed = failed_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(subset_survivors(failed))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
m AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
r AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(d.doc_id > first_id, false)::INT AS f
  FROM d JOIN m USING (t) LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, f, count(*) AS n, sum(good) AS g, sum(toxic) AS x FROM r GROUP BY part, f),
o(filter_order, step, k, before) AS (
  SELECT '', 0, 0, 0
  UNION ALL
  SELECT filter_order || substr('ABCDE', i + 1, 1), step + 1, i, CASE WHEN step = 0 THEN 0 ELSE before | (1 << k) END
  FROM o, range(5) AS t(i) WHERE step < 5 AND NOT contains(filter_order, substr('ABCDE', i + 1, 1))),
p AS (SELECT a.filter_order, b.step, b.k, b.before FROM o a JOIN o b ON b.step > 0 AND starts_with(a.filter_order, b.filter_order) WHERE a.step = 5),
s AS (
  SELECT c.part, filter_order, step, k,
    sum(CASE WHEN f & (before | (1 << k)) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN f & before = 0 AND f & (1 << k) > 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN f & before > 0 AND f & (1 << k) > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN f = 1 << k THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN f & before = 0 AND f & (1 << k) > 0 THEN g ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN f & before = 0 AND f & (1 << k) > 0 THEN x ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, p GROUP BY c.part, filter_order, step, k)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley
FROM s
"""
