"""Substring deduplication: repeated runs of ``WINDOW`` words by prefix-partitioned suffixes.

A repeat of 35 words is an internal node of the corpus' suffix tree at depth 35 or more, and a
word goes if one of these nodes covers it. The tree is built in parts that share a prefix, with
prefixes as long as needed:

1. *Short prefix.* Of the first 24 twelve-word prefixes in a window, the one with the least hash
   marks a suffix to look at, its *anchor*: equal windows have equal anchors at equal places, and
   only about one word in twelve is an anchor. Anchors whose prefix occurs once are leaves and
   drop out, after counts that are added up before they move.
2. *Groups that fit in memory.* What is left is dealt by its prefix, each anchor with the nodes
   (35-word hashes) of the windows that contain it. A prefix with more than ``GROUP_ROWS`` anchors
   is dealt to several parts. A part sorts its nodes; a node that comes twice is internal.
3. *Long prefix.* Where a prefix has several parts, a node seen once in its part is compared
   again under its whole 35-word prefix; a part sends each node once, however often it saw it, so
   a passage that a third of the documents share costs a row per part.

Only positions and hashes move until the spans to remove return to the texts. Nodes are compared
by 64-bit hash. Documents are known by their id (by a hash of the text where it is null) and a
checksum of the text, so rows with the same id and text are told apart only as occurrences.

Defined results: a null or empty text has no words; a text shorter than a window keeps all words;
repeated rows repeat all their windows and so lose every word of them; extra columns are kept by
:func:`without_repeats`, which leaves a text without repeats as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm.common import (
    anew,
    document_runs,
    mixed,
    narrowed,
    space_bytes,
    table,
    text_buffer,
    word_hashes,
    words_of,
)

WINDOW, PREFIX = 35, 12
#: Prefix places in a window, of which the least is its anchor.
PLACES = WINDOW - PREFIX + 1
#: Anchors in one part of a prefix; 24 nodes each.
GROUP_ROWS = 20_000
_FACTOR = np.cumprod(np.full(WINDOW, 0xD6E8FEB86659FD93, np.uint64), dtype=np.uint64)


def _rolled(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of every ``length`` neighbouring values."""
    n = len(h) - length + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(length if n > 0 else 0):
        out += h[i : i + n] * _FACTOR[i]
    return mixed(out)


def _least(g: np.ndarray) -> np.ndarray:
    """Place of the first least value among every ``PLACES`` neighbours, by doubling spans."""
    place = {1: np.arange(len(g))}
    span = 1

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a[: len(b)], b[: len(a)]
        return np.where(g[b] < g[a], b, a)

    while 2 * span <= PLACES:
        place[2 * span] = joined(place[span], place[span][span:])
        span *= 2
    found, covered = place[span], span
    while covered < PLACES:
        span = max(s for s in place if s <= PLACES - covered)
        found, covered = joined(found, place[span][covered:]), covered + span
    return found


def _windows(texts: pa.Array) -> Iterator[tuple]:
    """For runs of documents: (first row, words before each row, document, start in the document
    and 35-word hash of every window, number of its anchor, and of the anchors: document, place in
    the document, prefix hash)."""
    data, offsets = text_buffer(texts)
    for a, b in document_runs(offsets):
        part = data[offsets[a] : offsets[b]]
        h, doc, _, _ = word_hashes(part, offsets[a : b + 1] - offsets[a], space_bytes())
        if len(h) < WINDOW:
            continue
        before = np.searchsorted(doc, np.arange(b - a))
        start = np.flatnonzero(doc[WINDOW - 1 :] == doc[: len(doc) - WINDOW + 1])
        if not len(start):
            continue
        prefix = _rolled(h, PREFIX)
        least = _least(prefix)[start]
        anchor, number = np.unique(least, return_inverse=True)
        yield (
            a,
            doc[start],
            start - before[doc[start]],
            _rolled(h, WINDOW)[start],
            number,
            doc[anchor],
            anchor - before[doc[anchor]],
            prefix[anchor].view(np.int64),
        )


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "sum", "place", "prefix"]
    for batch in batches:
        key, check = (batch[c].to_numpy() for c in ("__key", "__sum"))
        for a, *_, doc, place, prefix in _windows(batch["text"]):
            columns = [key[a + doc], check[a + doc], place, prefix]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per occurrence of a prefix that is repeated: where its windows start, their nodes."""
    names = ["prefix", "part", "parts", "key", "sum", "start", "nodes"]
    for batch in batches:
        key, check = (batch[c].to_numpy() for c in ("__key", "__sum"))
        live = batch["live"]
        owner = np.repeat(np.arange(len(live)), np.diff(live.offsets.to_numpy()))
        flat = live.flatten()
        place, parts = (flat.field(c).to_numpy().astype(np.int64) for c in ("place", "parts"))
        wanted = owner << 32 | place
        order = np.argsort(wanted, kind="stable")
        wanted, parts = wanted[order], parts[order]
        for a, _, start, node, number, doc, at, prefix in _windows(batch["text"]):
            mine = (a + doc) << 32 | at
            found = np.searchsorted(wanted, mine)
            held = np.flatnonzero(wanted[np.minimum(found, len(wanted) - 1)] == mine)
            if not len(held):
                continue
            first = np.searchsorted(number, held)  # windows come in the order of their anchors
            end = np.searchsorted(number, held, side="right")
            rows = a + doc[held]
            of = parts[found[held]]
            part = (mixed(key[rows].view(np.uint64)) % of.astype(np.uint64)).astype(np.int64)
            raw, cuts = node.tobytes(), zip((8 * first).tolist(), (8 * end).tolist(), strict=True)
            columns = [prefix[held], part, of, key[rows], check[rows], start[first]]
            nodes = pa.array([raw[i:j] for i, j in cuts], pa.binary())
            columns = [*(pa.array(c, pa.int64()) for c in columns), nodes]
            yield pa.RecordBatch.from_arrays(columns, names)


def _runs(values: np.ndarray) -> np.ndarray:
    """For each value, how often it comes in ``values``."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], values[order][1:] != values[order][:-1]]))
    out = np.empty(len(values), np.int64)
    out[order] = np.repeat(np.diff(np.append(cuts, len(values))), np.diff(np.append(cuts, len(values))))
    return out


MARKS = "key long, sum long, start long, n long, node long, several boolean"


def _internal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of n neighbouring starts of windows whose node comes twice in its part; of divided
    prefixes also the other starts, one by one with their node, and each internal node once. Rows
    come sorted by prefix and part."""

    def out(key, check, start, length, node, several) -> pa.RecordBatch:
        n = len(start)
        columns = [
            pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64())
            for c in (key, check, start, length, node)
        ]
        columns.append(pa.array(np.full(n, several)))
        return pa.RecordBatch.from_arrays(columns, ["key", "sum", "start", "n", "node", "several"])

    def judged(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        nodes = rows["nodes"].combine_chunks().cast(pa.large_binary())
        if isinstance(nodes, pa.ChunkedArray):
            nodes = nodes.chunk(0)
        offsets = np.frombuffer(nodes.buffers()[1], np.int64)[nodes.offset :][: len(nodes) + 1]
        node = np.frombuffer(nodes.buffers()[2], np.int64)[offsets[0] // 8 : offsets[-1] // 8]
        count = np.diff(offsets) // 8
        number = {c: rows[c].to_numpy() for c in rows.column_names if c != "nodes"}
        row = np.repeat(np.arange(len(count)), count)
        start = number["start"][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        group = mixed((number["prefix"] + number["part"] * 0x9E3779B9).view(np.uint64))[row]
        twice = _runs(mixed(node.view(np.uint64)) ^ group) > 1
        fresh = np.diff(row, prepend=-1) != 0
        opens = np.flatnonzero(twice & (fresh | ~np.roll(twice, 1)))
        shuts = np.flatnonzero(twice & (np.roll(fresh, -1) | ~np.roll(twice, -1)))
        key, check = number["key"][row[opens]], number["sum"][row[opens]]
        yield out(key, check, start[opens], shuts - opens + 1, None, True)
        divided = number["parts"][row] > 1
        one = divided & ~twice
        ones = np.ones(int(one.sum()), np.int64)
        yield out(number["key"][row][one], number["sum"][row][one], start[one], ones, node[one], False)
        internal = np.unique(node[divided & twice])
        none = np.zeros(len(internal), np.int64)
        yield out(None, None, none, none, internal, True)

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if waiting and sum(b.num_rows for b in waiting) >= GROUP_ROWS:
            rows = pa.Table.from_batches(waiting)
            p, q = rows["prefix"].to_numpy(), rows["part"].to_numpy()
            other = np.flatnonzero((p != p[-1]) | (q != q[-1]))
            last = int(other[-1]) + 1 if len(other) else 0
            if last:  # the last part may go on
                yield from judged(rows.slice(0, last))
                waiting = rows.slice(last).to_batches()
        waiting.append(batch)
    if waiting:
        yield from judged(pa.Table.from_batches(waiting))


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lets starts of repeated windows pass; rows come sorted by node, those without node are
    such starts. A node that several parts send, or one part as internal, is repeated."""

    def judged(rows: pa.Table) -> pa.RecordBatch:
        node = rows["node"].combine_chunks()
        known = node.is_valid().to_numpy(zero_copy_only=False)
        value = node.fill_null(0).to_numpy()
        several = rows["several"].to_numpy()
        keep = ~known
        if known.any():
            v = value[known]
            runs = _runs(v) > 1
            keep[known] = runs | several[known]
        keep &= rows["key"].is_valid().to_numpy()
        names = ["key", "sum", "start", "n"]
        columns = [pa.array(rows[c].fill_null(0).to_numpy()[keep], pa.int64()) for c in names]
        return pa.RecordBatch.from_arrays(columns, names)

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= GROUP_ROWS:
            rows = pa.Table.from_batches(waiting)
            node = rows["node"].combine_chunks()
            filled = node.fill_null(0).to_numpy()
            same = (filled == filled[-1]) & node.is_valid().to_numpy(zero_copy_only=False)
            last = len(filled) if not same[-1] else int(np.flatnonzero(same)[0])
            if last:
                yield judged(rows.slice(0, last))
            waiting = rows.slice(last).to_batches()
    if waiting:
        yield judged(pa.Table.from_batches(waiting))


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.withColumns(
        {
            "__key": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)),
            "__sum": F.coalesce(F.crc32(text), F.lit(0).cast("long")),
        }
    )


def repeated_starts(documents: DataFrame) -> DataFrame:
    """(__key, __sum, __starts): for each document with a repeated window, runs (start, n) of words
    at which such windows start. ``documents`` has the columns of :func:`_keyed`."""
    texts = documents.select("__key", "__sum", "text")
    anchors = texts.mapInArrow(_anchors, "key long, sum long, place long, prefix long")
    counted = anchors.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1")
    counted = counted.select(anew(F.col("prefix")).alias("at"), "n")
    parts = F.ceil(F.col("n") / GROUP_ROWS).cast("int")
    live = (
        anchors.join(counted, anew(F.col("prefix")) == F.col("at"))
        .groupBy(F.col("key").alias("__key"), F.col("sum").alias("__sum"))
        .agg(F.collect_set(F.struct("place", parts.alias("parts"))).alias("live"))
    )
    # All columns come along, so that Spark moves the texts once for this join and the last one.
    suffixes = (
        documents.join(live, ["__key", "__sum"])
        .mapInArrow(
            _suffixes,
            "prefix long, part long, parts long, key long, sum long, start long, nodes binary",
        )
        .repartition("prefix", "part")
        .sortWithinPartitions("prefix", "part")
    )
    spread = F.coalesce(F.col("node"), F.xxhash64("key", "start"))
    return (
        suffixes.mapInArrow(_internal, MARKS)
        .repartition(spread)
        .sortWithinPartitions("node")
        .mapInArrow(_decide, "key long, sum long, start long, n long")
        .groupBy(F.col("key").alias("__key"), F.col("sum").alias("__sum"))
        .agg(F.collect_set(F.struct("start", "n")).alias("__starts"))
    )


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _cut(text: str | None, starts: list[dict[str, int]] | None) -> tuple[str | None, int, int]:
    """The text without the words that windows in the runs ``starts`` cover, words, words removed.
    A word goes with the white space behind it."""
    data = (text or "").encode()
    if not starts:
        return text, len(data.split()), 0
    begins = [m.start() for m in _WORD.finditer(data)]
    edge = np.zeros(len(begins) + WINDOW + 1, np.int64)
    first, length = np.array([(x["start"], x["n"]) for x in starts]).T
    np.add.at(edge, first, 1)
    np.add.at(edge, first + length - 1 + WINDOW, -1)
    gone = np.cumsum(edge)[: len(begins)] > 0
    turns = np.flatnonzero(np.diff(gone, prepend=False))
    kept, at = [], 0
    for i, turn in enumerate(turns):
        if i % 2 == 0:
            kept.append(data[at : begins[turn]])
        at = begins[turn]
    if len(turns) % 2 == 0:
        kept.append(data[at:])
    return b"".join(kept).decode(), len(begins), int(gone.sum())


def without_repeats(documents: DataFrame) -> DataFrame:
    """``documents`` with the words of repeated windows removed from ``text``, ``n_words`` and
    ``n_removed``."""
    columns = [c for c in documents.columns if c not in ("n_words", "n_removed")]
    keyed = _keyed(documents.select(*[F.col(f"`{c}`") for c in columns]))
    marked = keyed.join(repeated_starts(keyed), ["__key", "__sum"], "left")
    marked = marked.select(*[F.col(f"`{c}`") for c in columns], "__starts")
    schema = marked.drop("__starts").withColumns(
        {"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}
    ).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch["text"].to_pylist(), batch["__starts"].to_pylist(), strict=True)
            rows = [_cut(text, starts) for text, starts in both]
            new = {
                "text": pa.array([t for t, _, _ in rows], pa.string()),
                "n_words": pa.array([n for _, n, _ in rows], pa.int64()),
                "n_removed": pa.array([n for _, _, n in rows], pa.int64()),
            }
            names = schema.names
            yield pa.RecordBatch.from_arrays(
                [new[c] if c in new else batch[c] for c in names], names
            )

    return marked.mapInArrow(apply, schema)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = narrowed(table(spark, sf_dir, "documents"), "doc_id", "text")
    return without_repeats(documents).select(
        "doc_id",
        "n_words",
        "n_removed",
        F.sha2(F.array_join(words_of(F.col("text")), " "), 256).alias("kept_sha256"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages go from the texts; a document stays, if only empty.
    ``n_chars`` follows the text."""
    done = without_repeats(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (SELECT k, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35),
w AS (SELECT s.k, i, hash(list_slice(words, i, i + 34)) AS a, md5(array_to_string(list_slice(words, i, i + 34), ' ')) AS b FROM s JOIN d USING (k)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY a, b) AS c FROM w) WHERE c > 1),
g AS (SELECT DISTINCT k, unnest(range(i, i + 35)) AS i FROM r),
p AS (SELECT k, list(i) AS gone FROM g GROUP BY k),
f AS (
  SELECT doc_id, words, coalesce(gone, []) AS gone,
    CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i)) END AS kept
  FROM d LEFT JOIN p USING (k))
SELECT doc_id, len(words)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM f
"""
