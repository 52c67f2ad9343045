"""Removal of repeated byte strings by suffix arrays that are sorted outside memory.

A byte goes if a string of ``WINDOW`` bytes covers it that also starts in a document with a smaller
doc_id. Suffixes that share their first ``WINDOW`` bytes stand together in a suffix array; the
smallest doc_id among them keeps them, all others are covered. The corpus is dealt to *shards* so
that equal strings meet, and each shard has a suffix array of its own, built by
:mod:`gaugework.llm.induced` with priority queues on disk, however many bytes it has:

0. *Copies.* A document whose whole text a smaller doc_id has goes whole; of equal texts only that of
   the smallest doc_id goes on.
1. *Anchors.* Of the 16-byte strings in a window the one with the least hash is its anchor, so equal
   windows have equal anchors at equal places. A batch of documents sends the hashes of its anchors
   packed, one row per part of the hashes; an anchor that two of its texts have goes as one.
   Where a hash is met in two texts, the numbers of its anchors go back to the documents.
2. *Pieces.* The bytes around such an anchor that its windows cover are a piece. Pieces of one
   anchor meet in one shard. Where an anchor is met more than ``HOT`` times, its windows are dealt
   one by one by all their bytes instead, which spreads them over all shards. Within a batch of
   documents, and again in a shard, equal pieces move on as one; those of larger doc_ids are covered
   whole.
3. *Shards.* The different pieces of a shard make its text, but for those that are their anchor's
   only one: no other piece has one of their windows; beyond ``SHARD_BYTES`` the next anchor begins
   another text. Most of them share their anchor by chance only: pieces without a window whose hash
   occurs again in the text are left out. The suffixes are sorted with common prefixes,
   and neighbours that share ``WINDOW`` bytes form the groups whose smallest doc_id is found. A
   covered window goes back to the document that the piece is from.

Anchors, equal pieces and hashes of windows only save work: that a window is covered by that of
another piece is read from the suffix array alone, by all its bytes. Documents are known by doc_id
and a 64-bit hash of their text; whole texts are compared by SHA-256.

Defined results: a null or empty text has no bytes; a null doc_id is neither smaller nor larger than
another, its document keeps all bytes and takes none from others; rows with one doc_id do not cover
each other; extra columns are kept; removal may cut characters, so what is kept is binary.
"""

from __future__ import annotations

import tempfile
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm.common import anew, document_runs, mixed, stored, table, text_buffer
from gaugework.llm.induced import STEP, _only, allot, steps, suffix_array

WINDOW, GRAM = 50, 16
#: Anchor places in a window.
PLACES = WINDOW - GRAM + 1
#: Times that an anchor is met above which its windows are dealt one by one.
HOT = 20_000
#: Hot anchors that are broadcast; more of them are joined.
BROADCAST = 1_000_000
#: Bytes after which a shard ends with its anchor; an anchor is never divided, however large.
SHARD_BYTES = 2_000_000
#: Different pieces that a task holds to find equal ones.
DIFFERENT = 300_000
_FACTORS = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)]
#: Bits of a hash that move; the others say to which part.
_BITS, _SHARD = (1 << 48) - 1, (1 << 32) - 1


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of every 16 neighbouring bytes, by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    span = 1
    for factor in _FACTORS:
        if len(h) <= span:
            return np.zeros(0, np.uint64)
        h = h[:-span] * factor + h[span:]
        span *= 2
        if span < GRAM:
            h = h ^ (h >> np.uint64(31))
    return mixed(h)


def window_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of every ``WINDOW`` neighbouring bytes, from those of four grams that cover them."""
    g = gram_hashes(data)
    n = max(0, len(data) - WINDOW + 1)
    h = np.zeros(n, np.uint64)
    for at, factor in zip((0, GRAM, 2 * GRAM, WINDOW - GRAM), _FACTORS, strict=True):
        h = h * factor + g[at : at + n]
    return h


def _least(g: np.ndarray) -> np.ndarray:
    """Place of the least value, by its upper 32 bits, among every ``PLACES`` neighbours, the first
    of equals: values and places in one number, whose minima are taken over doubled spans."""
    low, span = g >> np.uint64(32) << np.uint64(32) | np.arange(len(g), dtype=np.uint64), 1
    while span < PLACES:
        step = min(span, PLACES - span)
        low = np.minimum(low[: len(low) - step], low[step:])
        span += step
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the documents in a buffer, each anchor's hash, document, number in it, first window there
    and how many windows it has."""
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none.astype(np.uint64), none, none, none, none
    g = gram_hashes(data)
    least = _least(g)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))[: len(least)]
    start = np.flatnonzero(offsets[1:][doc] - np.arange(len(least)) >= WINDOW)
    least, doc = least[start], doc[start]
    opens = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])]))
    if not len(start):
        opens = none
    owner = doc[opens].astype(np.int64)
    number = np.arange(len(opens)) - np.searchsorted(owner, owner)
    return g[least[opens]], owner, number, start[opens] - offsets[owner], np.diff(np.append(opens, len(least)))


def anchors_of(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """:func:`anchors` of a whole batch."""
    data, offsets = text_buffer(texts)
    found = [[c.astype(np.uint64)] if i == 0 else [c] for i, c in enumerate([np.zeros(0, np.int64)] * 5)]
    for a, b in document_runs(offsets):
        gram, doc, *rest = anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for column, values in zip(found, (gram, doc + a, *rest), strict=True):
            column.append(values)
    return tuple(np.concatenate(c) for c in found)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row of the columns differs from the one before it."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    differs = np.ones(len(columns[0]), bool)
    differs[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(differs)


def _packed(gram: np.ndarray, doc: np.ndarray, number: np.ndarray, several: np.ndarray, times: np.ndarray) -> bytes:
    """Anchors of single documents (hash, document key and checksum, number) in the order of the
    documents, and hashes that several documents have with how often."""
    opens = _starts(doc["key"], doc["sum"])
    count = np.diff(np.append(opens, len(doc)))
    step = np.diff(number, prepend=0)
    step[opens] = number[opens]
    small = [doc["key"][opens], doc["sum"][opens], count, step, times]
    head = np.array([len(opens), len(gram), len(several)], "<i8").tobytes()
    columns = zlib.compress(b"".join(c.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in small), 1)
    grams = np.concatenate([gram, several]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return head + grams + columns


def _unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    """Hash, key, checksum and number of the anchors of single documents; the other hashes and how
    often they were met."""
    docs, n, several = np.frombuffer(data, "<i8", 3)
    end = 24 + 6 * (n + several)
    grams = np.zeros((n + several, 8), np.uint8)
    grams[:, :6] = np.frombuffer(data[24:end], np.uint8).reshape(-1, 6)
    grams = grams.view("<u8")[:, 0]
    raw = np.frombuffer(zlib.decompress(data[end:]), np.uint8)
    small, at = [], 0
    for size in (docs, docs, docs, n, several):
        small.append(np.ascontiguousarray(raw[at : at + 8 * size].reshape(8, size).T).view("<i8")[:, 0] if size else np.zeros(0, np.int64))
        at += 8 * size
    key, check, count, step, times = small
    total = np.cumsum(step)
    first = np.cumsum(count) - count
    number = total - np.repeat(total[first] - step[first], count)
    return grams[:n], np.repeat(key, count), np.repeat(check, count), number, grams[n:], times


MET = "part long, doc long, sum long, data binary"


def _met(parts: int):
    """A row per part of the hashes with the anchors of a batch, and a row per document with the
    numbers of its anchors that another text of the batch has too."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, row, number, *_ = anchors_of(batch["text"])
            if not len(gram):
                continue
            doc = np.empty(len(gram), [("key", "<i8"), ("sum", "<i8")])
            doc["key"], doc["sum"] = (batch[c].to_numpy()[row] for c in ("__key", "__sum"))
            part, gram = ((gram >> np.uint64(48)) % np.uint64(parts)).astype(np.uint16), gram & np.uint64(_BITS)
            # Anchors come by row and number.
            order = np.lexsort((gram, part))
            opens = _starts(part[order], gram[order])
            size = np.diff(np.append(opens, len(order)))
            texts = doc["sum"][order]
            differ = np.minimum.reduceat(texts, opens) < np.maximum.reduceat(texts, opens)
            live = np.sort(order[np.repeat(differ, size)])
            at = _starts(row[live])
            out: list[tuple] = []
            for a, b in zip(at.tolist(), np.append(at, len(live))[1:].tolist(), strict=True):
                key, check = doc[live[a]].tolist()
                out.append((key % parts, key, check, number[live[a:b]].astype("<u4").tobytes()))
            lone = np.sort(order[np.repeat(~differ, size)])
            lone = lone[np.argsort(part[lone], kind="stable")]
            head = opens[differ]
            shared_part, shared, times = part[order[head]], gram[order[head]], size[differ]
            for p in np.union1d(np.unique(part[lone]), np.unique(shared_part)).tolist():
                mine = lone[np.searchsorted(part[lone], p) : np.searchsorted(part[lone], p, "right")]
                a, b = np.searchsorted(shared_part, p), np.searchsorted(shared_part, p, "right")
                data = _packed(gram[mine], doc[mine], number[mine], shared[a:b], times[a:b])
                out.append((p, None, None, data))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["part", "doc", "sum", "data"]
            )

    return met


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, sum, number): the numbers of the anchors that another text has too; without a doc, as
    sum, the key of a hot anchor's shard. Rows come sorted by part."""
    names = ["doc", "sum", "number"]

    def judged(packed: list[bytes]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*map(_unpacked, packed), strict=True)]
        gram, key, check, number, several, times = columns
        both = np.concatenate([gram, several])
        order = np.argsort(both, kind="stable")
        opens = _starts(both[order])
        size = np.diff(np.append(opens, len(order)))
        edge = np.iinfo(np.int64)
        low = np.concatenate([check, np.full(len(several), edge.min)])[order]
        high = np.concatenate([check, np.full(len(several), edge.max)])[order]
        differ = np.minimum.reduceat(low, opens) < np.maximum.reduceat(high, opens)
        met = np.add.reduceat(np.concatenate([np.ones(len(gram), np.int64), times])[order], opens)
        hot = both[order[opens[differ & (met > HOT)]]].astype(np.int64) & _SHARD
        live = order[np.repeat(differ, size)]
        live = live[live < len(gram)]
        live = live[np.lexsort((number[live], check[live], key[live]))]
        docs = pa.concat_arrays([pa.array(key[live]), pa.nulls(len(hot), pa.int64())])
        sums = pa.array(np.concatenate([check[live], hot]))
        numbers = pa.concat_arrays([pa.array(number[live]), pa.nulls(len(hot), pa.int64())])
        yield pa.RecordBatch.from_arrays([docs, sums, numbers], names)

    held: list[bytes] = []
    last = None
    for batch in batches:
        direct = batch["doc"].is_valid()
        lists = [np.frombuffer(x, "<u4") for x in batch["data"].filter(direct).to_pylist()]
        count = [len(x) for x in lists]
        known = [np.repeat(batch[c].filter(direct).to_numpy(), count) for c in ("doc", "sum")]
        known.append(np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in known], names)
        lone = pc.invert(direct)
        for part, data in zip(batch["part"].filter(lone).to_pylist(), batch["data"].filter(lone).to_pylist(), strict=True):
            if part != last and held:
                yield from judged(held)
                held = []
            last = part
            held.append(data)
    if held:
        yield from judged(held)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of a batch of documents, each different one once (with the smallest doc_id), and
    the runs of windows that an equal piece of a smaller doc_id covers."""
    for batch in batches:
        batch = batch.filter(batch["__copy"].is_null())
        if not batch.num_rows:
            continue
        key, check = (batch[c].to_numpy() for c in ("__key", "__sum"))
        gram, row, number, start, n = anchors_of(batch["text"])
        live = batch["live"]
        wanted = np.sort(np.repeat(np.arange(len(live)) << 32, live.value_lengths().to_numpy()) + live.flatten().to_numpy())
        mine = row << 32 | number
        live = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)] == mine)
        live = live[np.argsort(key[row[live]], kind="stable")]
        gram, row, start, n = gram[live], row[live], start[live], n[live]
        data, offsets = text_buffer(batch["text"])
        raw, first, doc = data.tobytes(), offsets[row] + start, key[row]
        seen: dict[bytes, int] = {}
        texts: list[bytes | None] = []
        for a, b, d in zip(first.tolist(), (first + n - 1 + WINDOW).tolist(), doc.tolist(), strict=True):
            piece = raw[a:b]
            if seen.setdefault(piece, d) < d:
                texts.append(None)
                continue
            texts.append(piece)
            if len(seen) > DIFFERENT:
                seen.clear()
        alone = np.fromiter((x is not None for x in texts), bool, len(texts))
        # Covered runs that adjoin are one.
        order = np.flatnonzero(~alone)
        order = order[np.lexsort((start[order], row[order]))]
        opens = np.ones(len(order), bool)
        opens[1:] = (row[order][1:] != row[order][:-1]) | (start[order][1:] != (start + n)[order][:-1])
        opens = np.flatnonzero(opens)
        total = np.add.reduceat(n[order], opens) if len(opens) else opens
        kept, head = np.flatnonzero(alone), order[opens]
        at = np.concatenate([kept, head])
        shard = np.concatenate([gram[kept].view(np.int64) & _SHARD, doc[head] & _SHARD])
        columns = [shard, doc[at], check[row[at]], start[at], np.concatenate([n[kept], total])]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns), pa.array([*(texts[i] for i in kept.tolist()), *([None] * len(head))], pa.binary())],
            ["shard", "doc", "sum", "start", "n", "piece"],
        )


def _divided(pieces: DataFrame, hot: DataFrame) -> DataFrame:
    """``pieces`` with those of ``hot`` anchors window by window, dealt by all their bytes."""
    known = hot.withColumn("hot", F.lit(True))
    windows = F.when(F.col("hot") & F.col("piece").isNotNull(), F.sequence(F.lit(0), F.col("n").cast("int") - 1))
    rows = pieces.join(known, "shard", "left").withColumn("i", F.explode(F.coalesce(windows, F.array(F.lit(-1)))))
    one = F.col("i") >= 0
    cut = F.expr(f"substring(piece, i + 1, {WINDOW})")
    return rows.select(
        F.when(one, F.xxhash64(cut).bitwiseAND(F.lit(_SHARD))).otherwise(F.col("shard")).alias("shard"),
        "doc",
        "sum",
        (F.col("start") + F.greatest(F.col("i"), F.lit(0))).alias("start"),
        F.when(one, F.lit(1).cast("long")).otherwise(F.col("n")).alias("n"),
        F.when(one, cut).otherwise(F.col("piece")).alias("piece"),
    )


class Shard:
    """The different pieces of a shard as one text, and who has them. Texts wait in a temporary file."""

    #: Symbols: 0 ends the text, 1 a piece, bytes follow.
    FIRST = 2

    def __init__(self) -> None:
        self.file = tempfile.TemporaryFile()
        self.size, self.least, self.bytes = array("q"), array("q"), 0
        self.holders = array("q")  # piece, doc_id, checksum, start

    def add(self, piece: bytes, doc: int, holders: list[tuple[int, int, int]]) -> None:
        self.file.write(piece + b"\0")
        self.bytes += len(piece) + 1
        self.size.append(len(piece))
        self.least.append(doc)
        for holder in holders:
            self.hold(*holder)

    def hold(self, *holder: int) -> None:
        """One more place of the piece that was added last."""
        self.holders.extend((len(self.size) - 1, *holder))

    def text(self) -> np.ndarray:
        self.file.flush()
        size = np.frombuffer(self.size, np.int64)
        ends = np.cumsum(size + 1)
        out = allot(int(ends[-1]) + 1, np.uint16)
        self.file.seek(0)
        for a, b in steps(len(out) - 1):
            out[a:b] = np.frombuffer(self.file.read(b - a), np.uint8) + np.uint16(self.FIRST)
        for a, b in steps(len(ends)):
            out[ends[a:b] - 1] = 1
        return out

    @staticmethod
    def matched(text: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The pieces of a text that have a window whose hash occurs again in it. The others share no
        window with any piece, so nothing is lost when their suffixes are not sorted."""
        h = window_hashes(text)
        # Upper bits of a hash and the place in one number, which is sorted faster than places by hash.
        bits = np.uint64(len(h).bit_length())
        both = np.sort(h >> bits << bits | np.arange(len(h), dtype=np.uint64))
        again = np.flatnonzero(both[1:] >> bits == both[:-1] >> bits)
        at = both[np.union1d(again, again + 1)] & ((np.uint64(1) << bits) - np.uint64(1))
        return np.unique(np.searchsorted(begin, at.astype(np.int64), "right") - 1)

    def covered(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(piece, start, n) of the runs of windows that a piece of a smaller doc_id has too, in the
        order of the pieces."""
        if not len(self.size):
            return
        size, least = np.frombuffer(self.size, np.int64), np.frombuffer(self.least, np.int64)
        text = self.text()
        sorted_ones = self.matched(text, np.cumsum(size + 1) - size - 1)
        if not len(sorted_ones):
            return
        wanted = np.zeros(len(size), bool)
        wanted[sorted_ones] = True
        text = _only(text, np.append(np.repeat(wanted, size + 1), True))
        size, least = size[sorted_ones], least[sorted_ones]
        begin = np.cumsum(size + 1) - size - 1
        suffixes, prefixes = suffix_array(text, WINDOW)
        n = len(text)
        del text
        marked = allot(n, np.bool_)
        a = 0
        while a < n:
            b = min(a + STEP, n)
            while b < n and prefixes[b] >= WINDOW:  # a group is looked at whole
                more = np.flatnonzero(prefixes[b : b + STEP] < WINDOW)
                b = b + int(more[0]) if len(more) else min(b + STEP, n)
            at, opens = np.asarray(suffixes[a:b]), np.asarray(prefixes[a:b]) < WINDOW
            opens[0] = True
            piece = np.searchsorted(begin, at, "right") - 1
            doc = least[piece]
            groups = np.flatnonzero(opens)
            first = np.repeat(np.minimum.reduceat(doc, groups), np.diff(np.append(groups, len(at))))
            marked[at[(doc > first) & (at + WINDOW <= begin[piece] + size[piece])]] = True
            a = b
        for a, b in steps(n):
            # Runs end with their piece, as no window starts at its last bytes.
            on = np.flatnonzero(marked[a:b]) + a
            if len(on):
                opens = np.flatnonzero(np.concatenate([[True], on[1:] != on[:-1] + 1]))
                piece = np.searchsorted(begin, on[opens], "right") - 1
                yield sorted_ones[piece], on[opens] - begin[piece], np.diff(np.append(opens, len(on)))


def _bytes(values: pa.Array) -> list[bytes]:
    """The values of a binary array without nulls."""
    if not len(values):
        return []
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].tolist()
    raw = values.buffers()[2].to_pybytes() if values.buffers()[2] else b""
    return [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _alone(anchor: np.ndarray, piece: pa.Array, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of anchors that lie within the batch and have one piece, and which of these a smaller doc_id
    has. Rows come sorted by anchor, piece and doc_id; the first and the last anchor may go on elsewhere."""
    first = _starts(anchor)
    differ = np.ones(len(anchor), np.int64)
    differ[1:] = np.asarray(pc.not_equal(piece[1:], piece[:-1]))
    differ[first] = 1
    size = np.diff(np.append(first, len(anchor)))
    one = np.add.reduceat(differ, first) == 1
    one[[0, -1]] = False
    alone = np.repeat(one, size)
    return alone, alone & (doc > np.repeat(doc[first], size))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of n neighbouring starts of covered windows. Rows come sorted by anchor, piece and doc_id;
    those without a piece are such runs."""
    names = ["doc", "sum", "start", "n"]

    def out(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    def spans(shard: Shard) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(shard.holders, np.int64).reshape(-1, 4)
        owner = np.ascontiguousarray(held[:, 0])
        for piece, start, run in shard.covered():
            # Every holder of a piece has the runs of the piece.
            first = np.searchsorted(owner, piece, "left")
            count = np.searchsorted(owner, piece, "right") - first
            of = np.repeat(np.arange(len(piece)), count)
            holder = held[np.repeat(first, count) + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)]
            for a in range(0, len(of), 100_000):
                h, o = holder[a : a + 100_000], of[a : a + 100_000]
                yield out(h[:, 1], h[:, 2], h[:, 3] + start[o], run[o])

    shard = Shard()
    # The first piece of an anchor waits, with its holders, for a second one.
    anchor, last, least, waiting = None, None, 0, None
    for batch in batches:
        there = np.asarray(batch["piece"].is_valid())
        numbers = np.stack([batch[c].to_numpy() for c in names])
        if not there.all():
            yield out(*numbers[:, ~there])
            batch, numbers = batch.filter(pa.array(there)), numbers[:, there]
        if not batch.num_rows:
            continue
        alone, covered = _alone(batch["shard"].to_numpy(), batch["piece"], numbers[0])
        if covered.any():
            yield out(*numbers[:, covered])
        batch, numbers = batch.filter(pa.array(~alone)), numbers[:, ~alone]
        pieces = _bytes(batch["piece"])
        passed: list[tuple[int, int, int, int]] = []
        for at, piece, doc, check, start, n in zip(batch["shard"].to_numpy().tolist(), pieces, *numbers.tolist(), strict=True):
            if at != anchor:
                if shard.bytes > SHARD_BYTES:
                    yield from spans(shard)
                    shard = Shard()
                anchor, last, least, waiting = at, piece, doc, (piece, doc, [])
            elif piece != last:
                if waiting is not None:
                    shard.add(*waiting)
                    waiting = None
                last, least = piece, doc
                shard.add(piece, doc, [])
            if doc > least:
                passed.append((doc, check, start, n))
            elif waiting is not None:
                waiting[2].append((doc, check, start))
            else:
                shard.hold(doc, check, start)
        if passed:
            yield out(*np.array(passed, np.int64).T)
    yield from spans(shard)


def _keyed(documents: DataFrame) -> DataFrame:
    """``documents``, whose doc_ids are not null, with ``__key`` and ``__sum``."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    return documents.withColumns({"__key": key, "__sum": F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(_BITS))})


def copies_of(keyed: DataFrame) -> DataFrame:
    """(__key, __sum) of the documents whose whole text, if it has a window, a smaller doc_id has."""
    facts = keyed.where(F.octet_length("text") >= WINDOW)
    facts = facts.select("__key", "__sum", F.unhex(F.sha2("text", 256)).alias("digest"))
    groups = (
        facts.groupBy("digest", "__sum")
        .agg(F.min("__key").alias("first"), F.max("__key").alias("last"))
        .where("first < last")
        .select(anew(F.col("__sum")).alias("at"), F.col("digest").alias("same"), "first")
    )
    met = facts.join(groups, (anew(F.col("__sum")) == F.col("at")) & (F.col("digest") == F.col("same")))
    return met.where("__key > first").select("__key", "__sum").distinct()


def covered_windows(keyed: DataFrame, marked: DataFrame) -> DataFrame:
    """(__key, __sum, __runs): for the documents of :func:`_keyed` that have a window which also
    starts in a document with a smaller doc_id, runs (start, n) of bytes at which such windows start.
    ``marked`` has the same documents with ``__copy`` where :func:`copies_of` names them; they stay
    out."""
    spark = keyed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed.select("__key", "__sum", "text").where(F.octet_length("text") >= WINDOW)
    met = texts.mapInArrow(_met(parts), MET).repartition("part").sortWithinPartitions("part")
    shared = stored(met.mapInArrow(_shared_anchors, "doc long, sum long, number long"), "anchors")
    live = shared.where("doc IS NOT NULL").groupBy(F.col("doc").alias("__key"), F.col("sum").alias("__sum"))
    # All columns come along, so that Spark moves the texts once for this join and the last one.
    pieces = marked.join(live.agg(F.collect_list(F.col("number").cast("int")).alias("live")), ["__key", "__sum"]).mapInArrow(
        _pieces, "shard long, doc long, sum long, start long, n long, piece binary"
    )
    hot = shared.where("doc IS NULL").select(F.col("sum").alias("shard")).distinct()
    n_hot = hot.count()
    if n_hot:
        pieces = _divided(pieces, F.broadcast(hot) if n_hot <= BROADCAST else hot)
    return (
        pieces.repartition("shard")
        .sortWithinPartitions("shard", "piece", "doc")
        .mapInArrow(_spans, "doc long, sum long, start long, n long")
        .groupBy(F.col("doc").alias("__key"), F.col("sum").alias("__sum"))
        .agg(F.collect_list(F.struct("start", "n")).alias("__runs"))
    )


def cut(text: str | None, first: np.ndarray, n: np.ndarray, copy: bool | None = None) -> tuple[bytes, int, int, int]:
    """The bytes that none of the runs of ``n`` windows from ``first`` covers, none of a copy; bytes,
    bytes removed and removed runs."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    if copy:
        return b"", len(data), len(data), 1
    if not len(first):
        return data.tobytes(), len(data), 0, 0
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + n - 1 + WINDOW, -1)
    gone = np.cumsum(edge)[:-1] > 0
    return data[~gone].tobytes(), len(data), int(gone.sum()), int(np.count_nonzero(np.diff(gone, prepend=False) & gone))


COLUMNS = ("kept", "n_bytes", "n_removed", "n_spans")


def without_copies(documents: DataFrame) -> DataFrame:
    """``documents`` with ``kept``, the bytes of ``text`` that stay, ``n_bytes``, ``n_removed`` and
    ``n_spans``, the removed runs."""
    columns = [c for c in documents.columns if c not in COLUMNS]
    documents = documents.select(*[F.col(f"`{c}`") for c in columns])
    keyed = _keyed(documents.where("doc_id IS NOT NULL"))
    copies = stored(copies_of(keyed), "copies").withColumn("__copy", F.lit(True))
    # The texts move for this join; those on the same key find them in place.
    marked = keyed.join(copies, ["__key", "__sum"], "left")
    done = marked.join(covered_windows(keyed, marked), ["__key", "__sum"], "left")
    done = done.select(*[F.col(f"`{c}`") for c in columns], "__copy", "__runs")
    lone = documents.where("doc_id IS NULL").withColumns(
        {c: F.lit(None).cast(done.schema[c].dataType) for c in ("__copy", "__runs")}
    )
    done = done.unionAll(lone)
    schema = documents.withColumns(
        {"kept": F.lit(None).cast("binary"), **{c: F.lit(0).cast("long") for c in COLUMNS[1:]}}
    ).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch["__runs"]
            first, n = (c.to_numpy(zero_copy_only=False) for c in runs.flatten().flatten())
            end = np.cumsum(runs.value_lengths().fill_null(0).to_numpy()).tolist()
            rows = zip(batch["text"].to_pylist(), [0, *end], end, batch["__copy"].to_pylist(), strict=False)
            parts = [cut(text, first[a:b], n[a:b], copy) for text, a, b, copy in rows]
            kept, *numbers = zip(*parts, strict=True) if parts else [()] * 4
            new = dict(zip(COLUMNS, [pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in numbers)], strict=True))
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch[c] for c in schema.names], schema.names)

    return done.mapInArrow(apply, schema)


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the bytes that repeat strings of documents with smaller doc_ids."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = without_copies(documents)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT k, doc_id, unnest(range(0, len(h) // 2 - 49, 200)) AS o, unnest(list_transform(range(0, len(h) // 2 - 49, 200), lambda x: array_slice(h, 2 * x + 1, 2 * x + 498))) AS h
  FROM d WHERE doc_id IS NOT NULL),
w AS (
  SELECT k, doc_id, unnest(range(o, o + len(h) // 2 - 49)) AS i,
    unnest(list_transform(range(0, len(h) // 2 - 49), lambda x: md5(array_slice(h, 2 * x + 1, 2 * x + 100)))) AS m
  FROM b),
f AS (SELECT m, min(doc_id) AS f FROM w GROUP BY m HAVING min(doc_id) < max(doc_id)),
c AS (SELECT k, i, CASE WHEN i <= lag(i) OVER (PARTITION BY k ORDER BY i) + 50 THEN 0 ELSE 1 END AS o FROM w JOIN f USING (m) WHERE f < doc_id),
g AS (SELECT k, i, sum(o) OVER (PARTITION BY k ORDER BY i) AS g FROM c),
s AS (SELECT k, g, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY k, g),
p AS (SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS e FROM s),
r AS (
  SELECT k, count(*) AS n, sum(b - a)::BIGINT AS gone, max(b) AS z, string_agg(array_slice(h, 2 * e + 1, 2 * a), '' ORDER BY a) AS t
  FROM p JOIN d USING (k) GROUP BY k)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE t || array_slice(h, 2 * z + 1, len(h)) END)) AS kept_sha256
FROM d LEFT JOIN r USING (k)
"""
