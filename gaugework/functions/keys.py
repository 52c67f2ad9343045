"""Row identity: natural ordering, portable keys, keyed hashes and content digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: the reserved separator between hashed fields. Keys may not contain it.
SEPARATOR = "\x1f"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def natural_key(c: Column | str) -> Column:
    """A string whose byte order is the natural order of ``c`` ("2" before "10").

    Digit runs become ``0`` + digit count + digits without leading zeros, text runs become
    ``1`` + lower-cased text + a terminator below every character. Digit runs sort before
    text runs, so ids of mixed shape have an order instead of an error.
    """
    chunks = F.regexp_extract_all(_col(c).cast("string"), F.lit(r"([0-9]+|[^0-9]+)"), 1)

    def encode(chunk: Column) -> Column:
        digits = F.regexp_replace(chunk, "^0+(?=.)", "")
        return F.when(
            chunk.rlike("^[0-9]"),
            F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 6, "0"), digits),
        ).otherwise(F.concat(F.lit("1"), F.lower(chunk), F.lit("\x01")))

    return F.array_join(F.transform(chunks, encode), "")


def canonical_key(c: Column | str) -> Column:
    """Backslashes become slashes; nothing else is rewritten."""
    return F.translate(_col(c).cast("string"), "\\", "/")


def key_fault(c: Column | str) -> Column:
    """Why a key may not seed anything: ``blank``, ``separator`` or null when it is usable."""
    text = _col(c).cast("string")
    return (
        F.when(text.isNull() | ~text.rlike(r"\S"), F.lit("blank"))
        .when(F.contains(text, F.lit(SEPARATOR)), F.lit("separator"))
        .otherwise(F.lit(None).cast("string"))
    )


def strict_key(c: Column | str) -> Column:
    """:func:`canonical_key`, failing the job on a key that :func:`key_fault` names."""
    fault = key_fault(c)
    return F.when(
        fault.isNotNull(), F.raise_error(F.concat(F.lit("unusable key: "), fault))
    ).otherwise(canonical_key(c))


def is_portable_key(c: Column | str) -> Column:
    """Relative POSIX spelling: not empty, no backslash, root, ``..`` segment or drive letter."""
    text = F.coalesce(_col(c).cast("string"), F.lit(""))
    segments = F.split(text, "/")
    return (
        (text != "")
        & ~F.contains(text, F.lit("\\"))
        & ~F.startswith(text, F.lit("/"))
        & ~F.array_contains(segments, "..")
        & ~F.contains(F.get(segments, F.lit(0)), F.lit(":"))
    )


def keyed_digest(*fields: Column | str | int) -> Column:
    """SHA-256 in hex over the fields joined by the reserved separator.

    Plain Python strings and integers are literals here; pass columns as ``Column``. A null field
    fails the job: it would vanish from the joined text and share the digest of a shorter key.
    """
    missing = F.raise_error(F.lit("a field of a keyed digest is null")).cast("string")
    parts = [
        F.coalesce(f.cast("string"), missing) if isinstance(f, Column) else F.lit(str(f))
        for f in fields
    ]
    return F.sha2(F.concat_ws(SEPARATOR, *parts), 256)


def keyed_seed(*fields: Column | str | int) -> Column:
    """The first eight digest bytes as an unsigned 64-bit integer, in ``decimal(20,0)``."""
    return F.conv(F.substring(keyed_digest(*fields), 1, 16), 16, 10).cast("decimal(20,0)")


def digest_uniform(digest: Column, slot: int = 0) -> Column:
    """A double in (0, 1) from the ``slot``-th group of 48 digest bits; exact in a double."""
    bits = F.conv(F.substring(digest, 1 + 12 * slot, 12), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**48))


def short_hash(c: Column | str) -> Column:
    """Twelve hex digits that let identifiers group without being published; null stays null."""
    return F.substring(F.sha2(_col(c).cast("string"), 256), 1, 12)


def content_digest(c: Column | str) -> Column:
    """SHA-256 of a binary or string column."""
    return F.sha2(_col(c), 256)


def text_digest(c: Column | str) -> Column:
    """SHA-256 that does not depend on the line-ending convention of the text."""
    return F.sha2(F.regexp_replace(_col(c), "\r\n", "\n"), 256)


def array_digest(c: Column | str, shape: Column | str, kind: str = "double", places: int = 6) -> Column:
    """SHA-256 over element type, shape and values at a fixed number of decimal places."""
    scale = F.lit(float(10**places))
    rendered = F.transform(
        _col(c), lambda v: F.rint(v.cast("double") * scale).cast("long").cast("string")
    )
    return keyed_digest(kind, _col(shape), F.array_join(rendered, ","))


def probe_positions(n: Column, k: int) -> Column:
    """``k`` evenly spread row positions out of ``n`` (all of them when ``n <= k``)."""
    every = F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda i: F.rint(i * (n - 1) / F.lit(float(max(k - 1, 1)))).cast("long"),
    )
    return F.when(n <= 0, F.array().cast("array<long>")).when(n <= k, every).otherwise(spread)


_MANTISSA = 2.0**52


def _exact_power(e: Column) -> Column:
    """Two to a whole power, exactly."""
    return F.pow(F.lit(2.0), e.cast("double"))


def order_key(c: Column | str) -> Column:
    """A 64-bit integer whose order is the order of a double: not a number last, null stays null,
    both zeros are 0. Built by exact arithmetic on exponent and mantissa, so :func:`from_order_key`
    gives the double back."""
    x = _col(c).cast("double")
    a = F.abs(x)
    near = F.greatest(F.floor(F.log2(a)), F.lit(-1022)).cast("int")
    # The logarithm may miss a power of two by one.
    e = F.when((near > -1022) & (_exact_power(near) > a), near - 1)
    e = e.when((near < 1023) & (_exact_power(near + 1) <= a), near + 1).otherwise(near)
    normal = F.shiftleft((e + 1023).cast("long"), 52) + ((a / _exact_power(e) - 1.0) * _MANTISSA).cast("long")
    small = (a * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    infinite = F.lit(0x7FF0000000000000)
    size = (
        F.when(F.isnan(x), infinite + 1)
        .when(a == F.lit(float("inf")), infinite)
        .when(a < F.lit(2.0**-1022), small)
        .otherwise(normal)
    )
    return F.when(x.isNull(), F.lit(None).cast("long")).when(x < 0, -size).otherwise(size)


def from_order_key(k: Column) -> Column:
    """The double of an :func:`order_key`."""
    a = F.abs(k)
    e = F.shiftright(a, 52).cast("int")
    m = a.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    infinite = F.lit(0x7FF0000000000000)
    size = (
        F.when(a > infinite, F.lit(float("nan")))
        .when(a == infinite, F.lit(float("inf")))
        .when(e == 0, m * F.lit(2.0**-537) * F.lit(2.0**-537))
        .otherwise((F.lit(1.0) + m / F.lit(_MANTISSA)) * _exact_power(e - 1023))
    )
    return F.when(k < 0, -size).otherwise(size)


def exact_array_digest(c: Column | str, kind: str) -> Column:
    """SHA-256 over element type, length and every value of an array, exactly: equal arrays of one
    type have one digest, and no others do. Numbers are spelled so that they can be read back; null
    elements count, a null array has no digest. ``kind`` is the type of the column, as the schema
    names it (:func:`typed_array_digest` takes it from there)."""
    values = _col(c)
    spelled = F.transform(values, lambda v: F.coalesce(v.cast("string"), F.lit("null")))
    return F.when(
        values.isNotNull(), keyed_digest(kind, F.size(values), F.array_join(spelled, ","))
    )


def typed_array_digest(df: DataFrame, name: str) -> Column:
    """:func:`exact_array_digest` of a column with the element type that its schema states."""
    return exact_array_digest(F.col(f"`{name}`"), df.schema[name].dataType.simpleString())


#: Modulus and base of :func:`sequence_term`; fixed, so that checks of different runs compare.
SEQUENCE_PRIME, SEQUENCE_BASE = (1 << 31) - 1, 1_947_203_011


def sequence_term(position: Column | str, digest: Column) -> Column:
    """One term of a polynomial over a sequence: ``digest`` (a 64-bit hash) times the power of the
    base that the 0-based ``position`` names, modulo a prime below 2^31. The sum of all terms modulo
    the prime depends on what stands where; the sum of a shifted sequence is the sum times a power,
    so parts can be added in any order."""
    place = _col(position).cast("long")
    powers, base = [], SEQUENCE_BASE
    for _ in range(40):
        powers.append(base)
        base = base * base % SEQUENCE_PRIME
    one = F.struct(place.alias("left"), F.lit(1).cast("long").alias("power"))
    power = F.aggregate(
        F.array(*[F.lit(p).cast("long") for p in powers]),
        one,
        lambda acc, p: F.struct(
            F.shiftright(acc["left"], 1).alias("left"),
            F.when(acc["left"].bitwiseAND(F.lit(1).cast("long")) == 1, acc["power"] * p % SEQUENCE_PRIME)
            .otherwise(acc["power"])
            .alias("power"),
        ),
        lambda acc: acc["power"],
    )
    return F.pmod(digest, F.lit(SEQUENCE_PRIME)) * power % SEQUENCE_PRIME
