"""PII surrogates: detected entities get keyed replacements of the same kind and format.

An entity has a *canonical* form in which its spellings agree (an address in lower case, a number
as its digits, a name word in lower case), so every mention of it gets the same surrogate. A
surrogate is drawn by HMAC from (key, kind, canonical form, attempt) and keeps the shape: digits
stay digits, letters keep their case, hexadecimal stays hexadecimal, separators stay, a card
number that passes the Luhn check passes it again, an IBAN keeps its country and its check digits
hold. The mailbox and the domain of an e-mail address are entities of their own, so addresses of
one domain stay addresses of one domain. Given names keep gender (told by the title before them)
and script, family names the script.

A person is found behind a title with a capital letter. The words of the name are then replaced
wherever the text has them as whole words with a capital letter, with or without a title; a word
that stands somewhere as a given name is that given name throughout the text. A name that no title
introduces in its text is not found, nor is a name in a text that only another text introduces.

The collision check is relational: over the table of all different entities, a surrogate may
neither equal a real entity of its kind nor be shared by two. Losers draw again with the next
attempt, those settled earlier keep theirs, until nothing collides. Text-like kinds grow with each
attempt, so they always settle; where a kind of fixed length has no room left, :func:`settle` fails
and names it. Only the entities that needed more than one attempt have to be looked up when texts
are rewritten: up to ``BROADCAST`` of them are broadcast, more are joined to the texts that mention
them.

Defined results: a null or empty text stays as it is with no entities; repeated rows are rewritten
alike; overlapping matches give the one that starts first, then the longest; a secret of marks only
(a masked one) is none; extra columns are kept, but for one of the name that the count gets.
Without entities nothing changes.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm.common import narrowed, stored, table

#: A caller who publishes texts gives a key of their own.
KEY = b"gaugework surrogates"

#: Where a caller sets a key for the pipeline stage, as a Spark setting.
KEY_SETTING = "spark.gaugework.surrogates.key"
#: Entities with later attempts that are broadcast; more of them are joined to the texts.
BROADCAST = 200_000
#: Rounds without fewer collisions after which a kind counts as exhausted.
STALLED = 16

#: Titles and the gender they tell, n for none.
_TITLES = {
    "mr": "m", "mister": "m", "sir": "m", "herr": "m", "monsieur": "m", "señor": "m", "sr": "m", "don": "m",
    "signor": "m", "господин": "m", "κύριος": "m",
    "mrs": "f", "ms": "f", "miss": "f", "madam": "f", "lady": "f", "frau": "f", "fräulein": "f",
    "madame": "f", "mme": "f", "mlle": "f", "señora": "f", "sra": "f", "señorita": "f", "doña": "f",
    "signora": "f", "госпожа": "f", "κυρία": "f",
    "dr": "n", "doctor": "n", "doktor": "n", "prof": "n", "professor": "n",
}
_NAME = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_IPV6 = r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?"
_PATTERNS = (
    # (kind, what a text must hold for the pattern to be tried, pattern; its group is the entity)
    ("email", ("@",), re.compile(r"(?<![\w.+-])([\w+-]+(?:\.[\w+-]+)*@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,})")),
    ("card", None, re.compile(r"(?<![\w.-])(\d{4}(?:[ -]?\d{4}){3}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\w-])")),
    ("iban", None, re.compile(r"(?<![\w-])([A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,4})?)(?![\w-])")),
    ("ssn", None, re.compile(r"(?<![\w.-])(\d{3}-\d{2}-\d{4})(?![\w-])")),
    ("ip", None, re.compile(r"(?<![\w.])((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?![\w]|\.\d)")),
    ("ipv6", ("::", ":"), re.compile(rf"(?<![\w:.])({_IPV6})(?![\w:]|\.\d)")),
    ("phone", None, re.compile(r"(?<![\w.])(\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?![\w-])")),
    ("key", ("AKIA", "ghp_", "gho_", "sk-", "xox"), re.compile(r"(?<!\w)((?:AKIA[0-9A-Z]{16}|gh[po]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,}|xox[abp]-[0-9A-Za-z-]{10,}))(?!\w)")),
    ("secret", ("=", ":"), re.compile(r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b[\"']?\s*[:=]\s*[\"']?([^\s\"',;]{6,})")),
)
#: Titles as they are written: with a capital letter, or in capitals.
_WRITTEN = sorted({f for t in _TITLES for f in (t.capitalize(), t.upper())}, key=lambda t: (-len(t), t))
_TITLE = "|".join(_WRITTEN)
_PERSON = re.compile(rf"(?<!\w)((?:(?:{_TITLE})\.?[ \t]+)+)({_NAME}(?:[ \t]+{_NAME})?)")
_DIGIT = re.compile(r"[0-9]")

Match = tuple[int, int, str, str]  # begin, end, kind, canonical form


def _script(word: str) -> str:
    c = ord(word[0])
    return "greek" if 0x370 <= c < 0x400 else "cyrillic" if 0x400 <= c < 0x530 else "latin"


def _canonical(kind: str, found: str) -> str | None:
    """The form in which the spellings of an entity agree; None where it is none after all."""
    if kind in ("card", "phone", "ssn"):
        return "".join(c for c in found if c.isdigit())
    if kind == "iban":
        bare = found.replace(" ", "")
        return bare if 15 <= len(bare) <= 34 and _mod97(bare) == 1 else None
    if kind == "ipv6":
        try:
            return ipaddress.IPv6Address(found).exploded if len(found) > 2 else None
        except ValueError:
            return None
    if kind == "secret" and not any(c.isalnum() for c in found):
        return None
    return found.lower() if kind == "email" else found


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _known_names(text: str) -> dict[str, str]:
    """The name words that titles introduce in a text, in lower case, with their kinds."""
    known: dict[str, str] = {}
    for m in _PERSON.finditer(text):
        titles = m[1].replace(".", " ").split()
        words = [w for w in re.finditer(_NAME, m[2]) if w[0][0].isupper()]
        words = [w for w in words if w[0].lower() not in _TITLES]
        if not words or words[0].start():
            continue
        genders = [_TITLES[t.lower()] for t in titles]
        gender = next((g for g in genders if g != "n"), "n")
        for i, w in enumerate(words):
            name = re.sub(r"['’]s$", "", w[0].lower())
            if i == 0 and len(words) > 1:
                if not known.get(name, "").startswith("given"):
                    known[name] = f"given {gender} {_script(name)}"
            else:
                known.setdefault(name, f"family {_script(name)}")
    return known


def detect(text: str | None) -> list[Match]:
    """The entities of a text in their order, without overlaps."""
    found: list[Match] = []
    if not text:
        return found
    digits = _DIGIT.search(text) is not None
    for kind, needs, pattern in _PATTERNS:
        if digits if needs is None else any(s in text for s in needs):
            for m in pattern.finditer(text):
                if (canonical := _canonical(kind, m[1])) is None:
                    continue
                if kind == "email":
                    at = m.start(1) + m[1].index("@")
                    found.append((m.start(1), at, "mailbox", canonical))
                    found.append((at + 1, m.end(1), "domain", canonical.partition("@")[2]))
                else:
                    found.append((m.start(1), m.end(1), kind, canonical))
    if any(t in text for t in _WRITTEN) and (known := _known_names(text)):
        names = "|".join(re.escape(n) for n in sorted(known, key=len, reverse=True))
        for m in re.finditer(rf"(?<!\w)(?:{names})(?!\w)", text, re.IGNORECASE):
            if m[0][0].isupper() and m[0].lower() in known:
                found.append((m.start(), m.end(), known[m[0].lower()], m[0].lower()))
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[Match] = []
    for one in found:
        if not out or one[0] >= out[-1][1]:
            out.append(one)
    return out


def _stream(key: bytes, *parts: object) -> Iterator[int]:
    """Endless keyed numbers below 2**16."""
    seed = "\0".join(map(str, parts)).encode()
    block = 0
    while True:
        d = hmac.new(key, seed + b"\0%d" % block, hashlib.sha256).digest()
        yield from (d[i] << 8 | d[i + 1] for i in range(0, 32, 2))
        block += 1


#: Syllables and endings by script, fixed values: consonants, vowels, endings by gender, family.
_SOUNDS = {
    "latin": ("bdfgklmnprstv", "aeiou", {"m": "n", "f": "a", "n": "is"}, "er"),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", {"m": "н", "f": "а", "n": "и"}, "ко"),
    "greek": ("βγδζκλμνπρστφ", "αεηιου", {"m": "ς", "f": "α", "n": "ι"}, "δη"),
}


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10


def _grown(canonical: str, fixed: int, draw: Iterator[int], attempt: int) -> str:
    """:func:`_alike`, longer by a letter with each attempt, and where there is nothing to draw."""
    more = attempt + 4 * (not any(c.isalnum() for c in canonical[fixed:]))
    return _alike(canonical, fixed, draw) + "".join(chr(97 + next(draw) % 26) for _ in range(more))


def _alike(canonical: str, fixed: int, draw: Iterator[int]) -> str:
    """Characters of the same class behind the first ``fixed`` ones."""
    low = canonical[fixed:]
    hexadecimal = all(c in "0123456789abcdefABCDEF" for c in low if c.isalnum())
    letters = 6 if hexadecimal else 26
    out = [canonical[:fixed]]
    for c in low:
        if c.isdecimal():
            out.append(chr(48 + next(draw) % 10))
        elif c.isalpha():
            out.append(chr((65 if c.isupper() else 97) + next(draw) % letters))
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, canonical: str, attempt: int) -> str:
    """The canonical form of the replacement."""
    draw = _stream(key, kind, canonical, attempt)
    if kind == "ip":
        return ".".join(str(1 + next(draw) % 254) for _ in range(4))
    if kind == "card":
        body = _alike(canonical, 1, draw)
        if _luhn(canonical):
            return body
        return next(body[:-1] + d for d in "0123456789" if not _luhn(body[:-1] + d))
    if kind == "phone":
        fixed = max(0, len(canonical) - 10)
        body = _alike(canonical, fixed, draw)
        return body[:fixed] + str(2 + next(draw) % 8) + body[fixed + 1 :]
    if kind == "ssn":
        return _alike(canonical, 0, draw)
    if kind == "iban":
        body = canonical[:2] + "00" + _alike(canonical, 4, draw)[4:]
        return canonical[:2] + f"{98 - _mod97(body):02d}" + body[4:]
    if kind == "ipv6":
        return _alike(canonical, 0, draw)
    if kind == "mailbox":
        # Distinct within its domain, which has a surrogate of its own.
        local, at, domain = canonical.partition("@")
        return _grown(local.replace("_", "-"), 0, draw, attempt) + at + domain
    if kind == "domain":
        rest, dot, top = canonical.rpartition(".")
        return _grown(rest.replace("_", "-"), 0, draw, attempt) + dot + top
    if kind == "key":
        return _grown(canonical, 4 if canonical[:4] in ("AKIA", "ghp_", "gho_") else 3, draw, attempt)
    if kind == "secret":
        return _grown(canonical, 0, draw, attempt)
    consonants, vowels, given, family = _SOUNDS[kind.split()[-1]]
    syllables = 2 + attempt // 8  # longer names once the short ones run out
    word = "".join(
        consonants[next(draw) % len(consonants)] + vowels[next(draw) % len(vowels)]
        for _ in range(syllables)
    )
    return word + (family if kind.startswith("family") else given[kind.split()[1]])


def _dressed(kind: str, mention: str, replacement: str) -> str:
    """The replacement in the format of a mention."""
    if kind in ("card", "phone", "ssn"):
        digits = iter(replacement)
        return "".join(next(digits) if c.isdigit() else c for c in mention)
    if kind == "iban":
        signs = iter(replacement)
        return "".join(c if c == " " else next(signs) for c in mention)
    if kind == "ipv6":
        new = ipaddress.IPv6Address(replacement).compressed if "::" in mention or len(mention) < 39 else replacement
        return new.upper() if mention.upper() == mention else new
    if kind in ("mailbox", "domain"):
        replacement = replacement.partition("@")[0]
        if len(mention) != len(replacement):
            return replacement
        both = zip(mention, replacement, strict=True)
        return "".join(r.upper() if m.isupper() else r for m, r in both)
    if kind.startswith(("given", "family")):
        if len(mention) > 1 and mention.isupper():
            return replacement.upper()
        return replacement[0].upper() + replacement[1:]
    return replacement


def rewrite(text: str | None, key: bytes, later: dict[tuple[str, str], int]) -> tuple[str | None, int]:
    """The text with surrogates, and the number of mentions, an address being one. ``later`` has the attempt of the
    entities whose first attempt collided."""
    found = detect(text)
    if not found:
        return text, 0
    out, at = [], 0
    for begin, end, kind, canonical in found:
        new = surrogate(key, kind, canonical, later.get((kind, canonical), 0))
        out += [text[at:begin], _dressed(kind, text[begin:end], new)]
        at = end
    return "".join(out) + text[at:], sum(kind != "domain" for _, _, kind, _ in found)


def entities(documents: DataFrame) -> DataFrame:
    """(kind, canonical): the different entities of all texts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = sorted({m[2:] for text in batch["text"] for m in detect(text.as_py())})
            columns = [pa.array(c, pa.string()) for c in zip(*seen, strict=True)] if seen else [pa.array([], pa.string())] * 2
            yield pa.RecordBatch.from_arrays(columns, ["kind", "canonical"])

    return narrowed(documents, "text").mapInArrow(find, "kind string, canonical string").distinct()


def settle(found: DataFrame, key: bytes = KEY) -> tuple[DataFrame, int]:
    """(kind, canonical, attempt, surrogate) without collisions, and the number of entities that
    needed more than one attempt. Each round halves the losers or better unless a kind is nearly
    exhausted; after ``STALLED`` rounds without fewer losers of a kind it fails."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            new = pa.array([surrogate(key, k, c, a) for k, c, a in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, new], [*batch.schema.names, "surrogate"])

    real = found.select("kind", F.col("canonical").alias("surrogate"), F.lit(True).alias("real"))
    now = found.select("kind", "canonical", F.lit(0).alias("attempt"))
    fewest: dict[str, tuple[int, int]] = {}
    for turn in count():
        drawn = stored(
            now.mapInArrow(draw, "kind string, canonical string, attempt int, surrogate string"),
            "surrogates",
        )
        best = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canonical")).alias("best"))
        judged = (
            drawn.join(best, ["kind", "surrogate"])
            .join(real, ["kind", "surrogate"], "left")
            .withColumn("lost", F.col("real").isNotNull() | (F.col("best.canonical") != F.col("canonical")))
        )
        state = judged.groupBy("kind").agg(F.count_if("lost").alias("lost"), F.count_if(F.expr("attempt > 0 or lost")).alias("late")).collect()
        if not any(r["lost"] for r in state):
            return drawn, sum(r["late"] for r in state)
        for kind, lost, _ in state:
            if kind not in fewest or lost < fewest[kind][0]:
                fewest[kind] = lost, turn
            elif lost and turn - fewest[kind][1] >= STALLED:
                raise ValueError(f"no room left for {lost} surrogates of the kind {kind}")
        again = F.col("attempt") + F.col("lost").cast("int")
        now = judged.select("kind", "canonical", again.alias("attempt"))


def replace(documents: DataFrame, key: bytes = KEY, column: str = "n_entities") -> DataFrame:
    """``documents`` with surrogates in ``text`` and the number of mentions in ``column``."""
    columns = [c for c in documents.columns if c != column]
    rows = documents.select(*[F.col(f"`{c}`") for c in columns])
    schema = rows.withColumn(column, F.lit(0).cast("long")).schema
    settled, late = settle(stored(entities(rows), "entities"), key)
    later_column = _unused("__later", columns)
    joined = late > BROADCAST
    few: dict[tuple[str, str], int] = {}
    if joined:
        rows = _with_attempts(rows, settled.where("attempt > 0"), later_column)
    elif late:
        few = {(r["kind"], r["canonical"]): r["attempt"] for r in settled.where("attempt > 0").collect()}
    shared = rows.sparkSession.sparkContext.broadcast(few)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            attempts = batch[later_column].to_pylist() if joined else [None] * batch.num_rows
            done = []
            for text, later in zip(batch["text"].to_pylist(), attempts, strict=True):
                known = {(x["kind"], x["canonical"]): x["attempt"] for x in later or ()} if joined else shared.value
                done.append(rewrite(text, key, known))
            new = {
                "text": pa.array([t for t, _ in done], pa.string()),
                column: pa.array([n for _, n in done], pa.int64()),
            }
            yield pa.RecordBatch.from_arrays(
                [new[c] if c in new else batch[c] for c in schema.names], schema.names
            )

    return rows.mapInArrow(apply, schema)


def _unused(name: str, columns: list[str]) -> str:
    """``name``, or a longer one that no column has."""
    while name in columns:
        name += "_"
    return name


def _with_attempts(rows: DataFrame, later: DataFrame, column: str = "__later") -> DataFrame:
    """``rows`` with the later attempts among the entities that their text mentions, in ``column``."""
    hash_column = _unused("__hash", [*rows.columns, column])

    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [
                (h, *m)
                for h, text in zip(batch["hash"].to_pylist(), batch["text"], strict=True)
                for m in {m[2:] for m in detect(text.as_py())}
            ]
            columns = list(zip(*seen, strict=True)) or [(), (), ()]
            types = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["hash", "kind", "canonical"]
            )

    text = F.xxhash64(F.coalesce("text", F.lit("")))
    found = rows.select(text.alias("hash"), "text").mapInArrow(
        mentions, "hash long, kind string, canonical string"
    )
    per_text = (
        found.join(later, ["kind", "canonical"])
        .groupBy(F.col("hash").alias(hash_column))
        .agg(F.collect_set(F.struct("kind", "canonical", "attempt")).alias(column))
    )
    return rows.withColumn(hash_column, text).join(per_text, hash_column, "left").drop(hash_column)


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = narrowed(table(spark, sf_dir, "documents"), "doc_id", "text")
    return replace(documents).select("doc_id", "text", "n_entities")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts with surrogates; ``n_chars`` follows the text. The key is that of
    ``KEY_SETTING``, if the session sets it."""
    key = spark.conf.get(KEY_SETTING, None)
    count_column = _unused("__entities", docs.columns)
    done = replace(docs, key.encode() if key else KEY, column=count_column)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])
