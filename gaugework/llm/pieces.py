"""SentencePiece encoding and decoding as a relational lattice.

A text gets the leading space sign, its spaces become space signs, and it is cut into *units*
that no piece of the vocabulary crosses (checked when the vocabulary is read). Each different unit
of a block of documents is encoded once: its substrings of bounded length are exploded and met with the piece table, the
edges found are grouped by unit, and a higher-order ``aggregate`` folds them into the best path.
Explosion, equi-join and grouping run in numpy within the task that holds the unit, so that no
substring is a row of its own; the fold is a Spark expression and gives the borders of the path. The
pieces between them are looked up in numpy again.

Two folds exist. Where pieces have log probabilities (a unigram model) it is Viterbi: position by
position, the best score and the edge it came by. A BPE model takes the merge of best score
first, which is not the path of best total score, so for such a model the fold runs over the
edges in the order of their scores and keeps a bit set of the borders still standing; an edge
merges if exactly one border stands inside it. Characters without a piece become byte pieces.
Units of more than ``LONG`` characters, too long for the bit set, go through a small Python
function: a heap of merges for a BPE, Viterbi over positions for a unigram model.

Texts are cut once, into stored blocks of documents: the different units of a block, and the
documents as numbers of them. Everything after reads the blocks. The most frequent units (``HEAD``
at most, a parameter) are encoded once and broadcast; a rarer unit seldom comes twice in a block, so
it is encoded once per block that has it, where the block is read. No document and no rare unit moves.
:func:`decode` looks up the bytes of each id in the broadcast piece table; :func:`encode` does the
same on request, in the task that has the ids.

Defined results: a null or empty text has no pieces; repeated rows are encoded one by one; extra
columns are ignored. :func:`decode` undoes :func:`encode` exactly, also for white space; only a
space sign in the text itself comes back as a space, as in the library.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm.common import narrowed, stored, table
from gaugework.llm.quality_rules import let

SPACE_SIGN = "▁"
UNIT = regex.compile(r"▁*[\p{L}\p{M}]+|▁*[^\p{L}\p{M}▁]+|▁+")
LONG = 60
#: Marks of hashes: a piece goes on behind the string, a piece ends with it.
MARK_BITS, GOES_ON, ENDS = 20, 1, 2
#: Units that are broadcast with their counts of pieces.
HEAD = 300_000
#: Units whose substrings one numpy step handles.
TOGETHER = 2_048
#: A block of documents ends beyond so many different words or characters.
DIFFERENT = 400_000
BLOCK_CHARS = 8_000_000
#: Documents that are decoded together.
DOCUMENTS = 256


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> tuple[list[tuple[str, int, float]], int, bool]:
    """(piece, id, score) of the ordinary pieces, the id of byte 0, and whether it is a BPE."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.vocab_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            out.append((model.id_to_piece(i), i, model.get_score(i)))
    if any(UNIT.fullmatch(piece) is None for piece, _, _ in out):
        raise ValueError(f"{path}: a piece crosses the borders of units")
    # A BPE trainer numbers its merges: whole, falling scores.
    bpe = all(float(score).is_integer() for _, _, score in out)
    return out, model.piece_to_id("<0x00>"), bpe


def units_of(text: str | None) -> list[str]:
    if not text:
        return []
    return UNIT.findall(SPACE_SIGN + text.replace(" ", SPACE_SIGN))


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), position)


class PieceTable:
    """The pieces as arrays: for each length their sorted hashes, code points, ids and ranks; and
    ``marks``, by the first bits of a hash, whether a piece may go on behind it or end there."""

    def __init__(self, pieces: list[tuple[str, int, float]]) -> None:
        order = {score: k for k, score in enumerate(sorted({s for _, _, s in pieces}, reverse=True))}
        by_length: dict[int, list[tuple[str, int, float]]] = defaultdict(list)
        for piece in pieces:
            by_length[len(piece[0])].append(piece)
        self.lengths = {}
        self.marks = np.zeros(1 << MARK_BITS, np.uint8)
        for k, found in sorted(by_length.items()):
            codes = np.array([[ord(c) for c in p] for p, _, _ in found], np.uint64)
            h = np.zeros(len(found), np.uint64)
            for n, column in enumerate(codes.T, 1):
                h = extended(h, column)
                self.marks[h >> np.uint64(64 - MARK_BITS)] |= ENDS if n == k else GOES_ON
            at = np.argsort(h)
            if (h[at][1:] == h[at][:-1]).any():
                raise ValueError("two pieces of a length have one hash")
            ids = np.array([i for _, i, _ in found], np.int32)[at]
            scores = np.array([s for _, _, s in found], float)[at]
            ranks = np.array([order[s] for _, _, s in found], np.int64)[at]
            self.lengths[k] = (h[at], codes[at], ids, scores, ranks)


    def held(self, k: int, h: np.ndarray, begin: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the substrings of ``k`` code points are pieces, and their places among those."""
        keys, spelled = self.lengths[k][:2]
        place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = np.flatnonzero(keys[place] == h)
        place = place[hit]
        same = (codes[begin[hit][:, None] + np.arange(k)] == spelled[place]).all(axis=1)
        return hit[same], place[same]


def extended(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The hash of strings that are longer by one code point."""
    h = (h ^ code) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


EDGES = "array<struct<score: double, begin: int, end: int, id: int, ends: long, inside: long>>"
MERGES = "array<struct<ends: long, inside: long>>"


def spelled_out(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all units one after the other, and the sizes of the units."""
    codes = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").astype(np.uint64)
    return codes, np.fromiter(map(len, units), np.int64, len(units))


def edges_of(table: PieceTable, units: list[str], merges: bool = False) -> pa.Array:
    """The pieces found in each unit, best score first and leftmost of equals: all substrings of
    a length are hashed at once, met with the pieces of that length and compared by code points.
    With ``merges`` only what the fold of a BPE reads: pieces of two characters or more, as bits."""
    codes, size = spelled_out(units)
    unit = np.repeat(np.arange(len(units)), size)
    first = np.repeat(np.cumsum(size) - size, size)
    at, left = np.arange(len(codes)), np.repeat(np.cumsum(size), size) - np.arange(len(codes))
    h = np.zeros(len(codes), np.uint64)
    found = [[np.zeros(0, t)] for t in (np.int64, np.int64, np.int64, np.int32, float, np.int64)]
    for k in range(1, max(table.lengths, default=0) + 1):
        h = extended(h, codes[at + k - 1])
        marks = table.marks[h >> np.uint64(64 - MARK_BITS)]
        if k in table.lengths and (k > 1 or not merges):
            end_here = np.flatnonzero(marks & ENDS)
            hit, place = table.held(k, h[end_here], at[end_here], codes)
            begin = at[end_here[hit]]
            ids, scores, ranks = (c[place] for c in table.lengths[k][2:])
            new = (unit[begin], begin - first[begin], np.full(len(begin), k), ids, scores, ranks)
            for column, values in zip(found, new, strict=True):
                column.append(values)
        further = (marks & GOES_ON > 0) & (left[at] > k)
        at, h = at[further], h[further]
    of, begin, k, ids, scores, ranks = (np.concatenate(c) for c in found)
    order = np.lexsort((begin, ranks, of))
    of, begin, k, ids, scores = (c[order] for c in (of, begin, k, ids, scores))
    end, one = begin + k, np.int64(1)
    # Bits 0 to 62 are enough for the folds; longer units go another way.
    ends = one << np.minimum(begin, 62) | one << np.minimum(end, 62)
    inside = (one << np.minimum(end, 62)) - (one << np.minimum(begin + 1, 62))
    columns = {"ends": pa.array(ends), "inside": pa.array(inside)}
    if not merges:
        places = {"begin": pa.array(begin.astype(np.int32)), "end": pa.array(end.astype(np.int32))}
        columns = {"score": pa.array(scores)} | places | {"id": pa.array(ids)} | columns
    rows = pa.StructArray.from_arrays(list(columns.values()), list(columns))
    cuts = np.searchsorted(of, np.arange(len(units) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), rows)


def lattice(units: DataFrame, pieces: DataFrame, longest: int, merges: bool = False) -> DataFrame:
    """``units`` with the column ``edges``: of each different unit the pieces of at most ``longest`` characters found in
    it, with begin and end, best score first (``merges``: as in :func:`edges_of`). The piece table is as long as the
    vocabulary and is broadcast. Substrings are exploded, met with it and grouped by unit within the task: as rows of
    their own they were some 57 per unit, and the most costly part of the query."""
    spark = units.sparkSession
    known = pieces.select("piece", "id", "score").where(F.length("piece") <= longest)
    shared = spark.sparkContext.broadcast([tuple(r) for r in known.toLocalIterator()])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(i, TOGETHER)
                found = edges_of(table, some["unit"].to_pylist(), merges)
                yield pa.RecordBatch.from_arrays([*some.columns, found], [*some.schema.names, "edges"])

    kind = MERGES if merges else EDGES
    return units.mapInArrow(meet, units.withColumn("edges", F.lit(None).cast(kind)).schema)


def merged(unit: Column, edges: Column) -> Column:
    """Borders that stand after the merges, as bits, of a unit of at most ``LONG`` characters; the
    edges come best score first."""
    all_borders = _bit(F.length(unit) + 1) - 1

    def step(borders: Column, e: Column) -> Column:
        ends = borders.bitwiseAND(e["ends"]) == e["ends"]
        one = F.bit_count(borders.bitwiseAND(e["inside"])) == 1
        without = borders.bitwiseAND(F.bitwise_not(e["inside"]))
        return F.when(one & ends, without).otherwise(borders)

    return F.aggregate(edges, all_borders, step)


def viterbi(unit: Column, edges: Column) -> Column:
    """Borders of the path with the best total score, as bits; an uncovered character costs more
    than any path. Of equal paths the one whose last piece is longest."""
    none = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("borders")))

    def way(e: Column) -> Column:
        return F.struct(*(e[c].alias(c) for c in ("score", "begin", "end", "id")))

    def step(best: Column, end: Column) -> Column:
        ways = F.transform(
            F.concat(
                F.transform(F.filter(edges, lambda e: e["end"] == end), way),
                F.array(F.struct(F.lit(-1e6).alias("score"), (end - 1).alias("begin"), end.alias("end"), F.lit(-1).alias("id"))),
            ),
            lambda e: F.struct(
                (F.get(best, e["begin"])["score"] + e["score"]).alias("score"),
                (-e["begin"]).alias("order"),
                F.get(best, e["begin"])["borders"].bitwiseOR(_bit(end)).alias("borders"),
            ),
        )
        pick = lambda w: F.array(F.struct(w["score"].alias("score"), w["borders"].alias("borders")))
        return F.concat(best, let(F.array_max(ways), pick))

    path = F.aggregate(F.sequence(F.lit(1), F.length(unit)), none, step)
    return F.element_at(path, -1)["borders"]


def ids_between(table: PieceTable, units: list[str], borders: np.ndarray, byte_zero: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the pieces between neighbouring borders (bits, per unit), one unit after the
    other, and how many each unit has; where there is no piece, the ids of the bytes."""
    codes, size = spelled_out(units)
    of = np.repeat(np.arange(len(units)), size)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
    begin = np.flatnonzero(borders[of] >> place & 1)
    length = np.diff(begin, append=len(codes))
    ids = np.full(len(begin), -1, np.int32)
    for k in table.lengths:
        some = np.flatnonzero(length == k)
        h = np.zeros(len(some), np.uint64)
        for n in range(k):
            h = extended(h, codes[begin[some] + n])
        hit, at = table.held(k, h, begin[some], codes)
        ids[some[hit]] = table.lengths[k][2][at]
    n = np.ones(len(begin), np.int64)
    if len(bare := np.flatnonzero(ids < 0)):
        text = "".join(units)
        ends = zip(begin[bare].tolist(), (begin + length)[bare].tolist(), strict=True)
        spelled = [text[a:b].encode() for a, b in ends]
        n[bare] = list(map(len, spelled))
        ids = np.repeat(ids, n)
        ids[ids < 0] = np.frombuffer(b"".join(spelled), np.uint8).astype(np.int32) + byte_zero
    return ids, np.bincount(of[begin], n, len(units)).astype(np.int64)


def merge_long(unit: str, ranks: dict[str, tuple[int, float]], byte_zero: int) -> list[int]:
    """The ids of one unit of any length: best merge first, leftmost of equals."""
    n = len(unit)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[float, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n:
            last = end[end[i]]
            if (known := ranks.get(unit[i:last])) is not None:
                heapq.heappush(heap, (-known[1], i, last))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, last = heapq.heappop(heap)
        if end[i] < 0 or end[i] >= last or end[end[i]] != last:
            continue  # one of the two has merged elsewhere
        middle = end[i]
        end[i], end[middle] = last, -1
        if last < n:
            before[last] = i
        offer(i)
        offer(before[i])
    out, i = [], 0
    while i < n:
        known = ranks.get(unit[i : end[i]])
        out += [known[0]] if known else [byte_zero + b for b in unit[i : end[i]].encode()]
        i = end[i]
    return out


def viterbi_long(unit: str, ranks: dict[str, tuple[int, float]], byte_zero: int, longest: int) -> list[int]:
    """The ids of the path of one unit of any length with the best total score, by the rules of
    :func:`viterbi`."""
    best, begin = [0.0], [0]
    for end in range(1, len(unit) + 1):
        # From the longest piece on, so that of equal paths it stays.
        found, at = float("-inf"), end - 1
        for i in range(max(0, end - longest), end):
            known = ranks.get(unit[i:end])
            if known is not None and best[i] + known[1] > found:
                found, at = best[i] + known[1], i
        if best[end - 1] - 1e6 > found:
            found, at = best[end - 1] - 1e6, end - 1
        best.append(found)
        begin.append(at)
    cut, end = [], len(unit)
    while end:
        cut.append((begin[end], end))
        end = begin[end]
    out: list[int] = []
    for i, end in reversed(cut):
        known = ranks.get(unit[i:end])
        out += [known[0]] if known else [byte_zero + b for b in unit[i:end].encode()]
    return out


class Coder:
    """A vocabulary as its folds and its functions for long units need it."""

    def __init__(self, path: str) -> None:
        self.known, self.byte_zero, self.bpe = read_pieces(path)
        self.longest = max(len(p) for p, _, _ in self.known)

    @cached_property
    def ranks(self) -> dict[str, tuple[int, float]]:
        return {p: (i, s) for p, i, s in self.known}

    @cached_property
    def table(self) -> PieceTable:
        return PieceTable(self.known)

    def borders(self) -> Column:
        """The borders, as bits, of the columns ``unit`` and ``edges``; null for long units."""
        unit, edges = F.col("unit"), F.col("edges")
        return F.when(F.length(unit) <= LONG, (merged if self.bpe else viterbi)(unit, edges))

    def long(self, unit: str) -> list[int]:
        if self.bpe:
            return merge_long(unit, self.ranks, self.byte_zero)
        return viterbi_long(unit, self.ranks, self.byte_zero, self.longest)

    def spelled(self, unit: pa.Array, borders: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units one after the other, and how many each has, from their borders."""
        units, bits = unit.to_pylist(), borders.fill_null(0).to_numpy(zero_copy_only=False)
        long = [k for k, u in enumerate(units) if len(u) > LONG]
        short = units.copy() if long else units
        for k in long:
            short[k] = ""
        ids, size = ids_between(self.table, short, bits, self.byte_zero)
        if long:
            parts = np.split(ids, np.cumsum(size)[:-1])
            for k in long:
                parts[k] = np.array(self.long(units[k]), np.int32)
            ids, size = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, size


def encode_units(units: DataFrame, path: str) -> DataFrame:
    """A table of different units with the column ``ids``."""
    spark, coder = units.sparkSession, Coder(path)
    pieces = spark.createDataFrame(coder.known, "piece string, id int, score double")
    shared, names = spark.sparkContext.broadcast(coder), units.columns
    short = lattice(units.where(F.length("unit") <= LONG), pieces, coder.longest, coder.bpe)
    long = units.where(F.length("unit") > LONG).withColumn("borders", F.lit(None).cast("long"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = list_of(*shared.value.spelled(batch["unit"], batch["borders"]))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), ids], [*names, "ids"])

    schema = units.withColumn("ids", F.lit(None).cast("array<int>")).schema
    return short.select(*names, coder.borders().alias("borders")).unionAll(long).mapInArrow(spell, schema)


def words_of(text: str) -> list[str]:
    """Keys for the stretches of a text that no unit crosses: its words between single spaces.
    Where spaces stand together or last they belong to one unit, so the keys are the units
    themselves, each behind a space, which no word holds."""
    words = text.split(" ") if text else []
    return [" " + u for u in units_of(text)] if "" in words or SPACE_SIGN in text else words


def units_in(key: str) -> list[str]:
    """The units of a key of :func:`words_of`; letters only are one unit, marks behind them another."""
    if key.isalpha():
        return [SPACE_SIGN + key]
    if key[0] == " ":
        return [key[1:]]
    if (letters := key.rstrip(punctuation)).isalpha():
        return [SPACE_SIGN + letters, key[len(letters) :]]
    return UNIT.findall(SPACE_SIGN + key)


def spread(flat: np.ndarray, size: np.ndarray, index: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """The parts of ``flat``, which have these sizes, put together in the order of ``index``."""
    begin, out = np.cumsum(size) - size, [flat[:0]]
    for first in range(0, len(index), step):
        some = index[first : first + step]
        n = size[some]
        shift = begin[some] - (np.cumsum(n) - n)
        out.append(flat[np.repeat(shift, n) + np.arange(n.sum())])
    return np.concatenate(out)


def packed(codes: np.ndarray) -> bytes:
    """Small numbers made small for the way: the low bytes of all, then the next, through zlib."""
    planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def list_of(flat: pa.Array | np.ndarray, size: np.ndarray) -> pa.ListArray:
    """Values and the sizes of their lists as an Arrow column of lists."""
    cuts = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), flat if isinstance(flat, pa.Array) else pa.array(flat))


BLOCKS = "block long, doc_ids array<long>, sizes array<long>, places binary, units array<string>, n array<long>"


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different keys of :func:`words_of` of the texts; the numbers of each text's keys, one
    text after the other, and how many it has. Texts whose spaces stand alone are split in Arrow."""
    odd = pc.equal(texts, "")
    for found in (pc.starts_with(texts, " "), pc.ends_with(texts, " "), pc.match_substring(texts, "  ")):
        odd = pc.or_(odd, found)
    odd = pc.or_(odd, pc.match_substring(texts, SPACE_SIGN))
    plain = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
    others = [words_of(t) for t in texts.filter(odd).to_pylist()]
    keys = pa.concat_arrays([plain.flatten(), pa.array([w for o in others for w in o], pa.string())])
    odd = odd.to_numpy(zero_copy_only=False)
    size = np.concatenate([plain.value_lengths().to_numpy(), np.fromiter(map(len, others), np.int64, len(others))])
    came = np.argsort(np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]))
    coded = keys.dictionary_encode()
    return coded.dictionary, spread(coded.indices.to_numpy(), size, came), size[came]


def units_of_words(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different units of the words; the numbers of each word's units, one word after the
    other, and how many it has. Words of ASCII letters are one unit and stay in Arrow."""
    plain = pc.ascii_is_alpha(words)
    others = [units_in(w) for w in words.filter(pc.invert(plain)).to_pylist()]
    whole = pc.binary_join_element_wise(SPACE_SIGN, words.filter(plain), "")
    flat = pa.concat_arrays([whole, pa.array([u for o in others for u in o], pa.string())]).dictionary_encode()
    plain = plain.to_numpy(zero_copy_only=False)
    size = np.concatenate([np.ones(len(whole), np.int64), np.fromiter(map(len, others), np.int64, len(others))])
    came = np.argsort(np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]))
    return flat.dictionary, spread(flat.indices.to_numpy(), size, came), size[came]


def block_rows(doc_ids: pa.Array, texts: pa.Array, different: int) -> Iterator[list[pa.Array]]:
    """The columns of a block behind its name: its different units, the most frequent first, how
    often each occurs, and for every document the numbers of its units in order. Documents with
    more than ``different`` words together are halved."""
    words, places, n_words = words_in(texts)
    if len(words) > different and len(texts) > 1:
        half = len(texts) // 2
        yield from block_rows(doc_ids[:half], texts[:half], different)
        yield from block_rows(doc_ids[half:], texts[half:], different)
        return
    units, flat, size = units_of_words(words)
    coded = spread(flat, size, places)
    n = np.bincount(coded, minlength=len(units))
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ends = np.concatenate([[0], np.cumsum(size[places])])
    sizes = np.diff(ends[np.concatenate([[0], np.cumsum(n_words)])])
    yield [
        list_of(doc_ids, np.array([len(doc_ids)])),
        list_of(sizes, np.array([len(sizes)])),
        pa.array([packed(rank[coded])], pa.binary()),
        list_of(units.take(pa.array(order)), np.array([len(units)])),
        list_of(n[order].astype(np.int64), np.array([len(n)])),
    ]


def blocks(documents: DataFrame) -> DataFrame:
    """The documents cut once, as the blocks of :func:`block_rows`: a task ends a block at
    ``BLOCK_CHARS`` characters and halves it beyond ``DIFFERENT`` different words, so that it holds
    no more than that and one document. Only different words are cut into units."""
    chars, different = BLOCK_CHARS, DIFFERENT

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
        held, read = [], 0
        for batch in batches:
            doc_ids, texts = batch["doc_id"].cast(pa.int64()), batch["text"].fill_null("")
            upto, first, before = np.cumsum(pc.utf8_length(texts).to_numpy()), 0, 0
            while first < len(texts):
                # The block ends with the document that brings it beyond ``chars``.
                last = int(np.searchsorted(upto, before + chars - read, side="right"))
                end = min(last + 1, len(texts))
                held.append((doc_ids[first:end], texts[first:end]))
                read, before, first = read + int(upto[end - 1]) - before, int(upto[end - 1]), end
                if last < len(texts):
                    yield tuple(map(pa.concat_arrays, zip(*held, strict=True)))
                    held, read = [], 0
        if held:
            yield tuple(map(pa.concat_arrays, zip(*held, strict=True)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A block is one row of one task, written before anything reads it: its number is only a name.
        block, names = TaskContext.get().partitionId() << 32, ["block", "doc_ids", "sizes", "places", "units", "n"]
        for doc_ids, texts in full(batches):
            for columns in block_rows(doc_ids, texts, different):
                yield pa.RecordBatch.from_arrays([pa.array([block]), *columns], names)
                block += 1
            # Idle workers stay; what they hold counts beside the next stage's.
            pa.default_memory_pool().release_unused()

    return stored(narrowed(documents, "doc_id", "text").mapInArrow(cut, BLOCKS), "blocks")


def repeated_units(cut: DataFrame) -> DataFrame:
    """(unit, n): the units met more than once and how often, added up per block before they move."""
    both = F.explode(F.arrays_zip("units", "n")).alias("both")
    rows = cut.select(both).select(F.col("both.units").alias("unit"), "both.n")
    return rows.groupBy("unit").agg(F.sum("n").alias("n")).where("n > 1")


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The units above the count that at most ``most`` units exceed, on a scale of 16 steps per
    doubling, so that what the driver sees is some hundred numbers."""
    step = F.floor(16 * F.log2("n"))
    left, lowest = most, None
    for row in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        left -= row["count"]
        if left < 0:
            break
        lowest = row["step"]
    return counts.where(F.lit(False) if lowest is None else step >= lowest)


def with_ids(
    doc_ids: pa.Array, n_units: np.ndarray, codes: np.ndarray, flat: np.ndarray, size: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """The documents of a block with their ids, some at a time: the ids of each code lie in ``flat``
    one after the other."""
    ends = np.concatenate([[0], np.cumsum(n_units)])
    for first in range(0, len(n_units), DOCUMENTS):
        n = n_units[first : first + DOCUMENTS]
        some = codes[ends[first] : ends[first + len(n)]]
        cuts = np.concatenate([[0], np.cumsum(size[some])])[ends[first : first + len(n) + 1] - ends[first]]
        columns = [doc_ids.slice(first, len(n)), pa.array(n), list_of(spread(flat, size, some), np.diff(cuts))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_units", "ids"])


def as_bytes(rows: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as stream:
        stream.write_batch(rows)
    return out.getvalue().to_pybytes()


def from_bytes(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def encode(documents: DataFrame, path: str, text: str | None = None) -> DataFrame:
    """(doc_id, n_units, ids): the ids of every row of ``documents`` in their order, and the number
    of its units. ``text`` names a further column, the text decoded from these ids as :func:`decode`
    gives it, but in the task that has put them together: ids then need no third Python worker."""
    spark, coder = documents.sparkSession, Coder(path)
    cut = blocks(documents)
    counts = stored(repeated_units(cut), "units")
    frequent = encode_units(most_frequent(counts, HEAD), path).select("unit", "ids").toArrow().combine_chunks()
    units, ids = (frequent[c].combine_chunks() for c in ("unit", "ids"))
    # As buffers: a list and a dictionary of so many strings in every Python worker took most of its memory.
    size = ids.value_lengths().to_numpy().astype(np.int64)
    flat = ids.flatten().to_numpy().astype(np.int32)
    shared = spark.sparkContext.broadcast((units, flat, size, coder, spelling(path) if text else None))
    del frequent, units, ids, size, flat

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block a row per unit that is not in the head, with its lattice, in order; then a
        row without unit, whose ``own`` is the block, its places as codes: those of the head, then
        the rare ones. All that is not a unit's lies in this one value: Spark's Arrow writer counts
        the nulls of a list column anew for each row, the square of the rows of a batch."""
        head, _, _, coder, _ = shared.value

        def row(own: list[bytes], units: pa.Array, edges: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), units, edges], ["own", "unit", "edges"])

        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.slice(k, 1)
                units = block["units"].flatten()
                codes = pc.index_in(units, value_set=head)
                rare = units.filter(codes.is_null())
                codes = codes.fill_null(-1).to_numpy().astype(np.int64)
                codes[codes < 0] = len(head) + np.arange(len(rare))
                for first in range(0, len(rare), TOGETHER):
                    some = rare.slice(first, TOGETHER)
                    short = [u if len(u) <= LONG else "" for u in some.to_pylist()]
                    yield row([b""] * len(some), some, edges_of(coder.table, short, coder.bpe))
                places = pa.array([packed(codes[unpacked(block["places"][0].as_py())])], pa.binary())
                own = pa.RecordBatch.from_arrays([block["doc_ids"], block["sizes"], places], ["doc_ids", "sizes", "places"])
                yield row([as_bytes(own)], pa.nulls(1, pa.string()), edges_of(coder.table, [""], coder.bpe))

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come as ``laid_out`` gave them, since nothing between moves any."""
        _, flat, size, coder, letters = shared.value
        rare: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            first = 0
            for end in np.flatnonzero(batch["unit"].is_null().to_numpy(zero_copy_only=False)).tolist():
                some = batch.slice(first, end - first)
                rare.append(coder.spelled(some["unit"], some["borders"]))
                own = from_bytes(batch["own"][end].as_py())
                sizes, codes = own["sizes"].flatten().to_numpy(), unpacked(own["places"][0].as_py())
                all_ids, all_sizes = (np.concatenate(c) for c in zip((flat, size), *rare, strict=True))
                for part in with_ids(own["doc_ids"].flatten(), sizes, codes, all_ids, all_sizes):
                    yield with_text(part, text, letters) if text else part
                rare, first = [], end + 1
            rest = batch.slice(first)
            rare.append(coder.spelled(rest["unit"], rest["borders"]))

    rows = cut.select("doc_ids", "sizes", "places", "units")
    rows = rows.mapInArrow(laid_out, f"own binary, unit string, edges {MERGES if coder.bpe else EDGES}")
    rows = rows.select("own", "unit", coder.borders().alias("borders"))
    schema = "doc_id long, n_units long, ids array<int>" + (f", `{text}` string" if text else "")
    return rows.mapInArrow(put_together, schema)


def spelling(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids one after the other, and how many each has."""
    known, byte_zero, _ = read_pieces(path)
    codes = {i: p.encode() for p, i, _ in known} | {byte_zero + b: bytes([b]) for b in range(256)}
    # Control ids and numbers beyond the table give no bytes, as the last entry.
    codes = [codes.get(i, b"") for i in range(max(codes) + 2)]
    return np.frombuffer(b"".join(codes), np.uint8), np.fromiter(map(len, codes), np.int64, len(codes))


def with_text(part: pa.RecordBatch, column: str, letters: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """``part`` with the text of its ``ids`` in ``column``: the bytes of the ids put together in order."""
    flat, size = letters
    n = part["ids"].value_lengths().fill_null(0).to_numpy()
    ids = part["ids"].flatten().to_numpy().astype(np.int64)
    ids = np.where((ids < 0) | (ids >= len(size)), len(size) - 1, ids)
    data = spread(flat, size, ids).tobytes()
    ends = np.concatenate([[0], np.cumsum(size[ids])])[np.concatenate([[0], np.cumsum(n)])].tolist()
    texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]
    text = pa.array([t.replace(SPACE_SIGN, " ")[1:] for t in texts], pa.string())
    kept = [c for c in part.schema.names if c != column]
    return pa.RecordBatch.from_arrays([*(part[c] for c in kept), text], [*kept, column])


def decode(encoded: DataFrame, path: str, column: str = "text") -> DataFrame:
    """``encoded`` with the text of its ``ids`` in ``column``: each id looked up in the piece table,
    which is broadcast, and the bytes put together in order."""
    shared = encoded.sparkSession.sparkContext.broadcast(spelling(path))
    schema = encoded.drop(column).withColumn(column, F.lit("")).schema

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, DOCUMENTS):
                yield with_text(batch.slice(first, DOCUMENTS), column, shared.value)

    return encoded.mapInArrow(look_up, schema)


def piece_counts(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_units, n_pieces, ids_crc32, text_crc32) per row: the CRC-32 of all its ids in
    their order, in decimal with one space between, and that of the UTF-8 text decoded from them."""
    both = encode(documents, path, "text")
    stated = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(
        "doc_id",
        "n_units",
        F.size("ids").cast("long").alias("n_pieces"),
        F.crc32(stated).alias("ids_crc32"),
        F.crc32("text").alias("text_crc32"),
    )


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: units, pieces, and checksums of the ids and of the text decoded from them."""
    return piece_counts(table(spark, sf_dir, "documents"), default_path())
