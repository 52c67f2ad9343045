"""Token counts of a byte-level BPE with a whole-token shortcut.

Offline, each vocabulary string is tried: those that are one pre-token and that the tokenizer
itself encodes as one token are *whole*. A text is cut into pre-tokens; whole ones count as one
token at once, and only the rest goes through the merges, each different one once per worker as
long as the memory for them lasts. Strings of special tokens inside a text count as one token, as
the library does by default.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted one by
one; extra columns are ignored by the query, kept by :func:`count_tokens`.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm.common import narrowed, table

LIMIT = 1024
#: Pre-tokens that a worker remembers before it starts anew; bounds its memory, not the result.
MEMORY = 300_000
#: Documents that are cut together.
TOGETHER = 256


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(path: str):
    """The tokenizer, on one thread: Spark deals out the work."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ranked(path: str):
    """The same vocabulary for the faster of the two libraries, which takes it as byte strings
    ranked by merge. Only a byte-level BPE whose ids follow its merges can be read so."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        stated = json.load(f)
    model = stated["model"]
    if model["type"] != "BPE" or stated["pre_tokenizer"]["type"] != "ByteLevel":
        raise ValueError(f"{path}: not a byte-level BPE")
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(model["vocab"][a + b] != 256 + k for k, (a, b) in enumerate(pairs)):
        raise ValueError(f"{path}: ids don't follow the merges")
    own = [b for b in range(256) if chr(b).isprintable() and b != 32 and b != 0xAD]
    byte = {chr(b): b for b in own} | {
        chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)
    }
    special = {t["content"]: t["id"] for t in stated["added_tokens"]}
    ranks = {
        bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special
    }
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def pattern() -> regex.Pattern:
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


def specials(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings that alone are one pre-token and one token; at most the size of
    the vocabulary."""
    tokenizer, pre = load(path), pattern()
    special = set(specials(tokenizer))
    ids = sorted(tokenizer.get_vocab().values())
    texts = [tokenizer.decode([i], skip_special_tokens=False) for i in ids]
    usable = [
        (i, s) for i, s in zip(ids, texts, strict=True) if s not in special and pre.findall(s) == [s]
    ]
    coded = tokenizer.encode_batch([s for _, s in usable], add_special_tokens=False)
    return frozenset(s for (i, s), c in zip(usable, coded, strict=True) if c.ids == [i])


class Counter:
    """Counts tokens of texts in one task."""

    def __init__(self, path: str, whole: frozenset[str]) -> None:
        self.coder, self.pre, self.whole = ranked(path), pattern(), whole
        marks = sorted(self.coder.special_tokens_set, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, marks))) if marks else None
        self.merged: dict[str, int] = {}

    def _parts(self, text: str) -> list[str]:
        return self.special.split(text) if self.special else [text]

    def __call__(self, texts: list[str | None]) -> list[int]:
        counts, rests = [], []
        for text in texts:
            parts = self._parts(text or "")
            n, rest = len(parts) - 1, []
            for part in parts:
                pieces = self.pre.findall(part)
                other = [p for p in pieces if p not in self.whole]
                n += len(pieces) - len(other)
                rest += other
            counts.append(n)
            rests.append(rest)
        found = {p for rest in rests for p in rest}
        if len(self.merged) + len(found) > MEMORY:
            self.merged.clear()
        merge = self.coder.encode_ordinary
        for p in found - self.merged.keys():
            self.merged[p] = len(merge(p))
        known = self.merged.__getitem__
        return [n + sum(map(known, rest)) for n, rest in zip(counts, rests, strict=True)]


def count_tokens(documents: DataFrame, path: str, column: str = "n_tokens") -> DataFrame:
    """``documents`` with the number of tokens of ``text``; one pass, no shuffle. The set of
    whole tokens is broadcast: it is never larger than the vocabulary."""
    schema = documents.drop(column).withColumn(column, F.lit(0).cast("long")).schema
    whole = documents.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, whole.value)
        for batch in batches:
            counts: list[int] = []
            for i in range(0, batch.num_rows, TOGETHER):
                counts += counter(batch["text"].slice(i, TOGETHER).to_pylist())
            kept = [i for i, name in enumerate(batch.schema.names) if name != column]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(counts, pa.int64())],
                [*(batch.schema.names[i] for i in kept), column],
            )

    return documents.mapInArrow(apply, schema)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = narrowed(table(spark, sf_dir, "documents"), "doc_id", "text")
    return count_tokens(documents, default_path()).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > LIMIT).alias("over_limit"),
    )
