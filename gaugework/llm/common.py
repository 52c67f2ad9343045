"""Small helpers shared by the operators: tables, the shared folder, text buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of words, as a Java and Python character class: space, tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
#: Bytes of text that one numpy step handles; a longer document is handled alone.
CHUNK_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read again: its lineage ends here,
    so that a lost executor costs only the reading tasks. The folder lives as long as the job's
    shared folder; nothing else reads it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """The words of a text, null read as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def narrowed(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns neither travel nor clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def anew(key: Column) -> Column:
    """A join key in place of a 64-bit one. A table that was just grouped by ``key`` is dealt by
    it already, and Spark then joins without dealing it again, which keeps it from splitting the
    hot keys of the other side. Under this key both sides are dealt for the join."""
    return key.bitwiseXOR(F.lit(1).cast("long"))


# --- text buffers in numpy -------------------------------------------------------------------


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of an Arrow string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def document_runs(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most ``limit`` bytes together, one document at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_known: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, separator: np.ndarray, fold: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the documents in a buffer: 64-bit hash, document number, first and end byte.

    ``separator`` marks the bytes that split words, ``fold`` maps bytes before hashing. The hash
    is a sum of byte values times powers of an odd base, so one running sum gives every word.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    if len(_known.get("power", ())) < n:
        size = max(n, CHUNK_BYTES)
        _known["power"], _known["inverse"] = _powers(_BASE, size), _powers(_INVERSE, size)
    inside = ~separator[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    first, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    value = _VALUES if fold is None else _VALUES[fold]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value[data] * _known["power"][:n], out=total[1:], dtype=np.uint64)
    h = (total[end] - total[first]) * _known["inverse"][first]
    h = mixed(h + (end - first).astype(np.uint64) * np.uint64(_BASE))
    return h, np.searchsorted(offsets[1:], first, side="right"), first, end


def space_bytes() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return out
