"""Packing by vector bin packing with the dot-product heuristic.

An example has tokens, segments (its pieces) and loss-bearing tokens; a sequence has a limit on
each. A sequence is filled by taking, of the examples that fit, the one whose demand has the
largest dot product with the room left, both as shares of the limits: long examples while much
room is left, and those that use the scarce kind of room least when one runs out. When none fits,
the longest one is cut to the room that is left and its rest waits for the next sequence.
Stretches of a full sequence's length are cut off before that. What remains at the end of a block
is cut into powers of two, which need no padding.

Blocks of ``BLOCK`` examples are packed inside the tasks that read them, so nothing is shuffled
and memory is bounded by the block; a sequence number holds the partition and a running number.

Which ids of an example bear loss is stated by a column of spans (for instance the answers of a
conversation). Without it all ids but the first do, so that an example's loss is always below its
tokens and a loss limit that is not below the token limit cannot bind.

Defined results: a null or empty text is one example that holds the closing id alone; repeated
rows are packed one by one; documents without id are packed under a null id; extra columns are
ignored; an empty table gives no piece. Every id lies in exactly one piece. Spans may overlap or
reach beyond the example; null spans count as none stated, an empty list as no loss at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from gaugework.llm.common import narrowed, table
from gaugework.llm.tokens import default_path, ranked

#: Examples packed together, and the ids they may hold.
BLOCK, BLOCK_IDS = 4_096, 8_000_000
TOGETHER = 256
CLOSING_ID = 1


@dataclass(frozen=True)
class Limits:
    tokens: int = 2_048
    segments: int = 128
    loss: int = 2_048


def loss_between(spans: list[tuple[int, int]], start: int, end: int) -> int:
    """Loss-bearing tokens of an example between two of its positions."""
    return sum(max(0, min(b, end) - max(a, start)) for a, b in spans)


def room_for(spans: list[tuple[int, int]], start: int, loss: int, most: int) -> int:
    """The most tokens from ``start``, up to ``most``, that hold at most ``loss`` loss tokens."""
    for a, b in sorted(spans):
        a = max(a, start)
        if a < b:
            if b - a > loss:
                return min(most, a - start + loss)
            loss -= b - a
    return most


def merged_spans(spans: list[dict] | None, n: int) -> list[tuple[int, int]]:
    """Stated spans (start, end) in their order, without overlaps, within the ids 1 to n: the first
    id, which nothing precedes, bears no loss."""
    if spans is None:
        return [(1, n)]
    out: list[tuple[int, int]] = []
    known = [(s["start"], s["end"]) for s in spans if s and s["start"] is not None and s["end"] is not None]
    for a, b in sorted((max(a, 1), min(b, n)) for a, b in known):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        elif a < b:
            out.append((a, b))
    return out


Example = tuple[int, int, list[tuple[int, int]]]  # first and end position, loss spans


def pack(examples: list[Example], limits: Limits) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (number of the example, start, end) that together hold every position
    of every example once."""
    sequences: list[list[tuple[int, int, int]]] = []
    start = np.array([a for a, _, _ in examples], np.int64)
    size = np.array([b - a for a, b, _ in examples], np.int64)
    loss = np.array([loss_between(s, a, b) for a, b, s in examples], np.int64)
    live = np.flatnonzero(size > 0)

    def cut_off(i: int, n: int) -> tuple[int, int, int]:
        a, spans = int(start[i]), examples[i][2]
        start[i] += n
        size[i] -= n
        loss[i] -= loss_between(spans, a, a + n)
        return i, a, a + n

    for i in live:  # stretches that fill a sequence on their own
        while size[i] >= limits.tokens:
            n = room_for(examples[i][2], int(start[i]), limits.loss, limits.tokens)
            sequences.append([cut_off(i, n)])
    live = live[size[live] > 0]
    share = np.array([limits.tokens, limits.segments, limits.loss], float) ** -2
    while len(live):
        pieces, room = [], [limits.tokens, limits.segments, limits.loss]
        while room[0] and room[1] and len(live):
            fits = (size[live] <= room[0]) & (loss[live] <= room[2])
            if fits.any():
                dot = size[live] * (room[0] * share[0]) + loss[live] * (room[2] * share[2])
                at = int(np.argmax(np.where(fits, dot, -1)))
                n = int(size[live[at]])
            else:
                at = int(np.argmax(size[live]))
                i = live[at]
                most = min(int(size[i]), room[0])
                n = room_for(examples[i][2], int(start[i]), room[2], most)
                if not n:
                    break
            i, before = live[at], int(loss[live[at]])
            pieces.append(cut_off(i, n))
            room = [room[0] - n, room[1] - 1, room[2] - (before - int(loss[i]))]
            if not size[i]:
                live = np.delete(live, at)
        sequences.append(pieces)
    if sequences:
        sequences += _powers_of_two(sequences.pop())
    return [s for s in sequences if s]


def _powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A sequence cut anew into sequences whose lengths are powers of two."""
    out, rest = [], list(pieces)
    total = sum(b - a for _, a, b in pieces)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        part = []
        while room:
            i, a, b = rest.pop(0)
            n = min(room, b - a)
            part.append((i, a, a + n))
            room -= n
            if a + n < b:
                rest.insert(0, (i, a + n, b))
        out.append(part)
    return out


def encoder(path: str):
    """A function from a text to its ids, special strings read as the library does."""
    coder = ranked(path)
    return lambda text: coder.encode_to_numpy(text or "", allowed_special="all")


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, loss_tokens long"
)


def pack_documents(
    documents: DataFrame, path: str, limits: Limits = Limits(), spans: str | None = None
) -> DataFrame:
    """Pieces of all ``documents`` (doc_id, text) in sequences; the first id of a document, which
    nothing precedes, bears no loss. ``spans`` names a column array<struct<start, end>> of the ids
    that bear loss, counted from 0 in the ids of the text with the closing id at their end; without
    it all but the first do."""
    if limits.loss < 1:
        raise ValueError("the loss limit has to be positive")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = encoder(path), TaskContext.get().partitionId() << 40
        closing = np.array([CLOSING_ID], "<u4").tobytes()
        block: list[tuple[int | None, bytes, list[dict] | None]] = []

        def packed() -> pa.RecordBatch:
            nonlocal number
            rows: list[tuple] = []
            examples = [(0, len(ids) // 4, merged_spans(stated, len(ids) // 4)) for _, ids, stated in block]
            for pieces in pack(examples, limits):
                offset = 0
                for i, a, b in pieces:
                    doc_id, ids, _ = block[i]
                    crc = zlib.crc32(memoryview(ids)[4 * a : 4 * b])
                    loss = loss_between(examples[i][2], a, b)
                    rows.append((doc_id, a, b - a, crc, len(ids) // 4, number, offset, loss))
                    offset += b - a
                number += 1
            block.clear()
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        held = 0
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(i, TOGETHER)
                stated = part["spans"].to_pylist() if spans else [None] * part.num_rows
                for doc_id, text, own in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), stated, strict=True):
                    ids = encode(text).astype("<u4").tobytes()
                    block.append((doc_id, ids + closing, own))
                    held += len(ids) // 4
                    if len(block) >= BLOCK or held >= BLOCK_IDS:
                        yield packed()
                        held = 0
        if block:
            yield packed()

    rows = narrowed(documents, "doc_id", "text", *([spans] if spans else []))
    rows = rows.withColumn("doc_id", rows["doc_id"].cast("long"))
    if spans:
        rows = rows.withColumnRenamed(spans, "spans")
    return rows.mapInArrow(apply, SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_path())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the packed pieces."""
    return pack_documents(docs, default_path())
