"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint has one vote per bit from the XXH64 of every shingle. Two fingerprints with
at most three differing bits differ by at most one bit in one of their halves. The anchors of a
half are the words of the Hamming code of length 31, beside a free 32nd bit: a perfect code, so
every half lies within one bit (the covering radius) of exactly one code word with its own 32nd
bit, its *home*. A half also visits every anchor within radius plus threshold, two bits: 17 at
most. If two halves differ by at most one bit, each visits the other's home. So equal anchors
bring all links together, and what meets is compared bit by bit.

Copies collapse into one fingerprint before anchors are dealt, and an anchor passes on only a
spanning forest of its links, so neither copies nor large groups of near copies become pairs.

Defined results: a null text, an empty one and one without words have fingerprint zero and link
like any other; fewer words than a shingle are one shingle; repeated rows share a component; the
component of rows without any id is null; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from gaugework.llm.common import narrowed, stored, table
from gaugework.llm.graph import components

SHINGLE = 3
SEED = 42
THRESHOLD = 3
#: Shingles whose bits are counted together.
_ROWS = 1 << 15


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z and the six ASCII spaces
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = np.concatenate([[0], ends[:-1]])[:n].tolist()
    last = (ends[-n:] - 1).tolist()
    pieces = [line[a:b] for a, b in zip(first, last, strict=True)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for i in range(0, n, _ROWS):
        part = h[i : i + _ROWS].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(bit) for bit in np.flatnonzero(2 * votes > n))


def with_simhash(documents: DataFrame, column: str = "fingerprint") -> DataFrame:
    """``documents`` with the fingerprint as a signed 64-bit number."""
    schema = documents.drop(column).withColumn(column, F.lit(0).cast("long")).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(t.as_py()) for t in batch["text"]]
            found = np.array(found, np.uint64).view(np.int64)
            kept = [i for i, name in enumerate(batch.schema.names) if name != column]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(found, pa.int64())],
                [*(batch.schema.names[i] for i in kept), column],
            )

    return documents.mapInArrow(apply, schema)


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) of 32-bit values: every code word within two bits of each."""
    half = half.astype(np.int64)
    syndrome = np.zeros(len(half), np.int64)
    for i in range(31):
        syndrome ^= np.where(half >> i & 1, i + 1, 0)
    rows = np.arange(len(half))
    home = half ^ np.where(syndrome, 1 << np.maximum(syndrome - 1, 0), 0)
    found = [(rows, home, True), (rows, home ^ (1 << 31), False)]
    for i in range(1, 32):
        j = syndrome ^ i  # flipping places i and j leaves a code word
        some = (syndrome > 0) & (i < j)
        found.append((rows[some], half[some] ^ (1 << (i - 1)) ^ (1 << (j[some] - 1)), False))
    return (
        np.concatenate([r for r, _, _ in found]),
        np.concatenate([a for _, a, _ in found]),
        np.concatenate([np.full(len(r), h) for r, _, h in found]),
    )


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 1 << 14):
            f = batch["fingerprint"].slice(first, 1 << 14).to_numpy().astype(np.int64)
            for number, half in enumerate((f & 0xFFFFFFFF, f >> 32 & 0xFFFFFFFF)):
                row, anchor, home = anchors(half)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor | number << 32, pa.int64()),
                        pa.array(f[row], pa.int64()),
                        pa.array(home, pa.bool_()),
                    ],
                    ["anchor", "f", "home"],
                )


def forest(f: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Links that join every two of the given fingerprints that links join: each fingerprint is
    compared with those not reached so far, so that many near copies give few links."""
    links: list[tuple[int, int]] = []
    rest = f
    while len(rest) > 1:
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            u = reached.pop()
            near = np.bitwise_count((rest ^ u).view(np.uint64)) <= threshold
            new, rest = rest[near], rest[~near]
            links += zip(repeat(int(u)), new.tolist())
            reached += list(new)
    return links


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal anchors; the rows come sorted by anchor."""

    def links(a: np.ndarray, f: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        cuts = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]])
        homes = np.add.reduceat(home.astype(np.int64), cuts[:-1]) if len(a) else cuts[:0]
        found: set[tuple[int, int]] = set()
        for k in np.flatnonzero((np.diff(cuts) > 1) & (homes > 0)):
            found.update(forest(f[cuts[k] : cuts[k + 1]]))
        u, v = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    a, f, home = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    for batch in batches:
        a = np.concatenate([a, batch["anchor"].to_numpy()])
        f = np.concatenate([f, batch["f"].to_numpy()])
        home = np.concatenate([home, batch["home"].to_numpy(zero_copy_only=False)])
        open_run = np.searchsorted(a, a[-1]) if len(a) else 0  # its anchor may go on
        if open_run:
            yield links(a[:open_run], f[:open_run], home[:open_run])
            a, f, home = a[open_run:], f[open_run:], home[open_run:]
    yield links(a, f, home)


def linked(fingerprints: DataFrame) -> DataFrame:
    """(u, v): links that connect all different ``fingerprint`` values within the threshold."""
    dealt = fingerprints.select("fingerprint").distinct().mapInArrow(
        _deal, "anchor long, f long, home boolean"
    )
    met = dealt.repartition("anchor").sortWithinPartitions("anchor")
    return met.mapInArrow(_compare, "u long, v long").distinct()


def classes(hashed: DataFrame) -> DataFrame:
    """(fingerprint, component_id) of a stored table (doc_id, fingerprint)."""
    least = hashed.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    root = components(linked(hashed))
    joined = least.join(root.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    joined = joined.withColumn("root", F.coalesce("root", "fingerprint"))
    whole = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.join(whole, "root").select("fingerprint", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = narrowed(table(spark, sf_dir, "documents"), "doc_id", "text")
    hashed = stored(with_simhash(documents).select("doc_id", "fingerprint"), "simhash")
    return hashed.join(classes(hashed), "fingerprint").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each component: the one with the smallest id, then the smallest text hash; rows
    without id come last, equal rows leave one."""
    key = [F.coalesce("doc_id", F.lit((1 << 63) - 1)), F.xxhash64(F.coalesce("text", F.lit("")))]
    names = ["__id", "__text"]
    keyed = [c.alias(n) for c, n in zip(key, names, strict=True)]
    hashed = with_simhash(narrowed(documents, "doc_id", "text"))
    hashed = stored(hashed.select("doc_id", *keyed, "fingerprint"), "simhash")
    root = components(linked(hashed)).withColumnRenamed("node", "fingerprint")
    least = hashed.groupBy("fingerprint").agg(F.min(F.struct(*names)).alias("least"))
    chosen = (
        least.join(root, "fingerprint", "left")
        .groupBy(F.coalesce("root", "fingerprint").alias("root"))
        .agg(F.min("least").alias("least"))
        .select("least.*")
    )
    columns = [F.col(f"`{c}`") for c in documents.columns]
    kept = documents.select(*columns, *keyed).join(chosen, names)
    # Where the key is shared, the text decides; the join has brought such rows together.
    first = F.row_number().over(Window.partitionBy(*names).orderBy("text"))
    return kept.withColumn("__first", first).where("__first = 1").select(*columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component of near duplicates stays."""
    return keep_one(docs)
