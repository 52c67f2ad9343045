"""Keys, digests, scalar value operators and calibration decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugework.functions import geometry, keys, values
from gaugework.operators.ordering import canonical_order, rank, sequence_check, sequence_digest, sequences_differ
from gaugework.operators.selection import probe_rows
from gaugework.operators.splits import classify, unknown_signatures
from gaugework.plans.registry import ORACLES, digest_sql, natural_sql, query, r, table, uniform_sql


@query("natural_keys", f"SELECT doc_id, source, {natural_sql('source')} AS natural FROM documents")
def natural_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", keys.natural_key("source").alias("natural"))


@query(
    "canonical_order",
    f"""SELECT doc_id, source, row_number() OVER (ORDER BY {natural_sql('source')}, source, doc_id) - 1 AS position
FROM documents""",
)
def canonical_order_query(spark: SparkSession, d: str) -> DataFrame:
    return canonical_order(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")


_PATH = r"replace(regexp_replace(url, '^https?:/', ''), '/en/', '\en\')"


@query(
    "canonical_keys",
    f"""WITH p AS (SELECT page_id, {_PATH} AS key FROM pages)
SELECT page_id, key, replace(key, '\\', '/') AS canonical,
       CASE WHEN key IS NULL OR trim(key) = '' THEN 'blank' WHEN contains(key, chr(31)) THEN 'separator' END AS fault
FROM p""",
)
def canonical_keys(spark: SparkSession, d: str) -> DataFrame:
    key = F.replace(F.regexp_replace("url", "^https?:/", ""), F.lit("/en/"), F.lit("\\en\\"))
    return table(spark, d, "pages").select("page_id", key.alias("key")).select(
        "page_id", "key", keys.canonical_key("key").alias("canonical"), keys.key_fault("key").alias("fault")
    )


@query(
    "portable_keys",
    r"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '/de/') THEN regexp_replace(url, '^https?:/', '')
                                WHEN contains(url, '/en/') THEN regexp_replace(url, '^https?://', '')
                                WHEN contains(url, '/fr/') THEN replace(regexp_replace(url, '^https?://', ''), '/fr/', '/../')
                                ELSE url END AS key FROM pages)
SELECT page_id, key, key <> '' AND NOT contains(key, '\') AND NOT starts_with(key, '/')
       AND NOT list_contains(string_split(key, '/'), '..') AND NOT contains(string_split(key, '/')[1], ':') AS portable
FROM p""",
)
def portable_keys(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    bare = F.regexp_replace(url, "^https?://", "")
    key = (
        F.when(F.contains(url, F.lit("/de/")), F.regexp_replace(url, "^https?:/", ""))
        .when(F.contains(url, F.lit("/en/")), bare)
        .when(F.contains(url, F.lit("/fr/")), F.replace(bare, F.lit("/fr/"), F.lit("/../")))
        .otherwise(url)
    )
    return table(spark, d, "pages").select("page_id", key.alias("key")).withColumn(
        "portable", keys.is_portable_key("key")
    )


@query(
    "keyed_seed",
    f"""SELECT event_id, (('0x' || substr({digest_sql("'entity_v1'", '2026', 'event_id')}, 1, 16))::UBIGINT)::VARCHAR AS seed
FROM events""",
)
def keyed_seed(spark: SparkSession, d: str) -> DataFrame:
    seed = keys.keyed_seed("entity_v1", 2026, F.col("event_id"))
    return table(spark, d, "events").select("event_id", seed.cast("string").alias("seed"))


@query("short_hash", "SELECT page_id, substr(sha256(url), 1, 12) AS url_hash FROM pages")
def short_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", keys.short_hash("url").alias("url_hash"))


@query(
    "content_digest",
    r"""
SELECT doc_id, sha256(text) AS content, sha256(replace(replace(text, chr(10), chr(13) || chr(10)), chr(13) || chr(10), chr(10))) AS text_digest
FROM documents""",
)
def content_digest(spark: SparkSession, d: str) -> DataFrame:
    """The text digest must not see the changed line endings."""
    other = F.regexp_replace("text", "\n", "\r\n")
    return table(spark, d, "documents").select(
        "doc_id", keys.content_digest("text").alias("content"), keys.text_digest(other).alias("text_digest")
    )


@query(
    "array_digest",
    """
SELECT vec_id, sha256(concat_ws(chr(31), 'double', len(embedding)::VARCHAR, array_to_string(
  list_transform(embedding, lambda v: (round_even(v::DOUBLE * 1000000.0, 0)::BIGINT)::VARCHAR), ','))) AS digest
FROM embeddings""",
)
def array_digest(spark: SparkSession, d: str) -> DataFrame:
    shape = F.size("embedding").cast("string")
    return table(spark, d, "embeddings").select("vec_id", keys.array_digest("embedding", shape).alias("digest"))


@query(
    "sequence_digest",
    """
WITH p AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events),
b AS (SELECT pos // 4096 AS b, sha256(string_agg(event_id::VARCHAR || chr(31), '' ORDER BY pos)) AS h FROM p GROUP BY ALL)
SELECT (SELECT count(*) FROM events) AS rows,
       CASE WHEN count(*) = 1 THEN min(h) ELSE sha256(string_agg(h || chr(31), '' ORDER BY b)) END AS digest FROM b""",
)
def sequence_digest_query(spark: SparkSession, d: str) -> DataFrame:
    return sequence_digest(table(spark, d, "events").select("ts", "event_id"), ["ts", "event_id"], "event_id")


@query(
    "probe_rows",
    """
WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position, count(*) OVER () AS n
           FROM orders)
SELECT o_orderkey, position FROM p WHERE position IN (
  SELECT round_even(i * (n - 1) / 11.0, 0)::BIGINT FROM range(12) t(i), (SELECT count(*) AS n FROM orders))""",
)
def probe_rows_query(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderdate", "o_orderkey")
    return probe_rows(orders, ["o_orderdate", "o_orderkey"], 12).select("o_orderkey", "position")


@query(
    "window_normalize",
    """
SELECT l_suppkey, count(*) AS n, round(avg((least(greatest(l_extendedprice, 20000), 80000) - 20000) / 60000), 8) AS mean,
       count_if(l_extendedprice < 20000) AS below, count_if(l_extendedprice > 80000) AS above
FROM lineitem GROUP BY l_suppkey""",
)
def window_normalize(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("n"),
        r(F.avg(values.window_normalize(price, 50000, 60000)), 8).alias("mean"),
        F.count_if(price < 20000).alias("below"),
        F.count_if(price > 80000).alias("above"),
    )


@query(
    "bounds_fraction",
    """
SELECT event_type, round(avg((value < 10)::INTEGER), 8) AS below, round(avg((value BETWEEN 10 AND 100)::INTEGER), 8) AS inside,
       round(avg((value > 100)::INTEGER), 8) AS above FROM events GROUP BY event_type""",
)
def bounds_fraction(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(
        r(values.fraction(v < 10), 8).alias("below"),
        r(values.fraction(v.between(10, 100)), 8).alias("inside"),
        r(values.fraction(v > 100), 8).alias("above"),
    )


@query(
    "quantize8",
    """
WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE + 0.5 AS v FROM embeddings),
z AS (SELECT vec_id, v, round_even(least(greatest(v, 0), 1) * 255, 0)::INTEGER AS q FROM c)
SELECT vec_id, sum(q)::BIGINT AS total, max(abs(q / 255.0::DOUBLE - least(greatest(v, 0), 1))) <= 0.5 / 255 + 1e-12 AS within_half_step
FROM z GROUP BY vec_id""",
)
def quantize8(spark: SparkSession, d: str) -> DataFrame:
    shifted = F.transform("embedding", lambda v: v.cast("double") + 0.5)
    steps = F.transform(shifted, values.quantize8)
    clipped = F.transform(shifted, lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))
    error = F.array_max(F.zip_with(steps, clipped, lambda a, b: F.abs(values.dequantize8(a) - b)))
    return table(spark, d, "embeddings").select(
        "vec_id",
        F.aggregate(steps, F.lit(0).cast("long"), lambda s, v: s + v).alias("total"),
        (error <= 0.5 / 255 + 1e-12).alias("within_half_step"),
    )


_NOISE = digest_sql("'noise_v1'", "2026", "event_id")


@query(
    "keyed_noise",
    f"""
WITH e AS (SELECT event_id, least(value / 500, 1) AS x, {_NOISE} AS h FROM events),
z AS (SELECT event_id, x, sqrt(-2 * ln({uniform_sql('h', 0)})) * cos(2 * pi() * {uniform_sql('h', 1)}) AS z FROM e)
SELECT event_id, round(x, 8) AS clean, round(least(greatest(x + (0.02 + 0.05 * sqrt(greatest(x, 0))) * z, 0), 1), 8) AS noisy
FROM z""",
)
def keyed_noise(spark: SparkSession, d: str) -> DataFrame:
    x = F.least(F.col("value") / 500, F.lit(1.0))
    noisy = values.keyed_noise(x, "noise_v1", 2026, F.col("event_id"), floor=0.02, signal=0.05)
    return table(spark, d, "events").select("event_id", r(x, 8).alias("clean"), r(noisy, 8).alias("noisy"))


@query(
    "strict_integers",
    """
SELECT l_returnflag, count(*) AS n, count_if(l_quantity = floor(l_quantity)) AS whole_quantity,
       count_if(l_extendedprice = floor(l_extendedprice)) AS whole_price,
       sum(CASE WHEN l_extendedprice = floor(l_extendedprice) THEN l_extendedprice::BIGINT END)::BIGINT AS whole_price_sum
FROM lineitem GROUP BY l_returnflag""",
)
def strict_integers(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"),
        F.count_if(values.is_strict_integer(F.col("l_quantity"))).alias("whole_quantity"),
        F.count_if(values.is_strict_integer(price)).alias("whole_price"),
        F.sum(F.when(values.is_strict_integer(price), price.cast("long"))).alias("whole_price_sum"),
    )


@query(
    "sentinels",
    """
WITH s AS (SELECT *, CASE event_type WHEN 'view' THEN 40 WHEN 'click' THEN 90 WHEN 'signup' THEN 25 END AS a,
                  CASE event_type WHEN 'view' THEN 60 WHEN 'click' THEN 10 END AS b FROM events)
SELECT event_type, count(*) AS n,
       count(*) FILTER (WHERE value BETWEEN least(a, coalesce(b, a)) AND greatest(a, coalesce(b, a))) AS flagged,
       count(*) FILTER (WHERE a IS NULL) AS undeclared FROM s GROUP BY event_type""",
)
def sentinels(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    first = F.when(kind == "view", 40).when(kind == "click", 90).when(kind == "signup", 25)
    limit = F.when(kind == "view", 60).when(kind == "click", 10)
    flag = values.sentinel_flag(F.col("value"), first, limit)
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(flag).alias("flagged"), F.count_if(flag.isNull()).alias("undeclared")
    )


@query(
    "calibration",
    """
WITH m AS (SELECT event_id, value, CASE event_type WHEN 'view' THEN 'HU' WHEN 'click' THEN 'OD' END AS lut,
                  CASE WHEN event_type <> 'error' THEN 2.0 END AS slope, CASE WHEN value > 5 THEN -10.0 END AS intercept,
                  CASE WHEN value > 200 THEN 'MR' ELSE 'CT' END AS modality FROM events),
e AS (SELECT *, CASE WHEN modality <> 'CT' THEN 'wrong modality' WHEN lut = 'OD' THEN 'lookup table unit OD'
                     WHEN lut IS NULL AND slope IS NULL AND intercept IS NULL THEN 'missing slope and intercept'
                     WHEN lut IS NULL AND slope IS NULL THEN 'missing slope'
                     WHEN lut IS NULL AND intercept IS NULL THEN 'missing intercept' END AS error FROM m)
SELECT CASE WHEN error IS NULL THEN CASE WHEN lut IS NULL THEN 'affine' ELSE 'lookup' END END AS method, error,
       count(*) AS units, round(avg(CASE WHEN error IS NULL AND lut IS NULL THEN value * slope + intercept END), 6) AS mean_value
FROM e GROUP BY ALL""",
)
def calibration(spark: SparkSession, d: str) -> DataFrame:
    kind, v = F.col("event_type"), F.col("value")
    slope, intercept = F.when(kind != "error", 2.0), F.when(v > 5, -10.0)
    decision = values.calibration(
        F.when(kind == "view", "HU").when(kind == "click", "OD"), slope, intercept,
        F.when(v > 200, "MR").otherwise("CT"),
    )
    rows = table(spark, d, "events").select(decision.alias("c"), values.affine_rescale(v, slope, intercept).alias("x"))
    return rows.groupBy(F.col("c.method").alias("method"), F.col("c.error").alias("error")).agg(
        F.count("*").alias("units"), r(F.avg(F.when(F.col("c.method") == "affine", F.col("x")))).alias("mean_value")
    )


@query(
    "plane_normals",
    """
WITH o AS (SELECT vec_id, embedding[1]::DOUBLE AS a1, embedding[2]::DOUBLE AS a2, embedding[3]::DOUBLE AS a3, embedding[4]::DOUBLE AS b1,
                  embedding[5]::DOUBLE AS b2, embedding[6]::DOUBLE AS b3, embedding[7]::DOUBLE AS p1, embedding[8]::DOUBLE AS p2,
                  embedding[9]::DOUBLE AS p3 FROM embeddings),
c AS (SELECT *, a2 * b3 - a3 * b2 AS x, a3 * b1 - a1 * b3 AS y, a1 * b2 - a2 * b1 AS z FROM o),
n AS (SELECT vec_id, p1, p2, p3, x / sqrt(x*x + y*y + z*z) AS x, y / sqrt(x*x + y*y + z*z) AS y, z / sqrt(x*x + y*y + z*z) AS z FROM c)
SELECT vec_id, round(x, 8) AS nx, round(y, 8) AS ny, round(z, 8) AS nz, round(p1 * x + p2 * y + p3 * z, 8) AS projected,
       round(p1 * x + p2 * y + p3 * z - p3, 8) AS projected_minus_z,
       abs(x) <= 0.6 AND abs(y) <= 0.6 AND abs(abs(z) - 1) <= 0.6 AS is_axial FROM n""",
)
def plane_normals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(
        "vec_id",
        geometry.plane_normal(F.slice("embedding", 1, 6)).alias("n"),
        F.slice("embedding", 7, 3).alias("p"),
    )
    projected = geometry.projected_position(F.col("p"), F.col("n"))
    return rows.select(
        "vec_id",
        *[r(F.get("n", F.lit(i)), 8).alias(name) for i, name in enumerate(("nx", "ny", "nz"))],
        r(projected, 8).alias("projected"),
        r(projected - F.get("p", F.lit(2)).cast("double"), 8).alias("projected_minus_z"),
        geometry.is_axial(F.col("n"), 0.6).alias("is_axial"),
    )


_SIGNATURES = {("view", 0): "A", ("click", 0): "A", ("view", 1): "B", ("click", 1): "B", ("purchase", 0): "C", ("purchase", 1): "C"}


def _signed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_type", (F.col("value") > 50).cast("int").alias("level"))


@query(
    "classify",
    """
SELECT CASE WHEN event_type = 'purchase' THEN 'C' WHEN value > 50 THEN 'B' ELSE 'A' END AS stratum, count(*) AS units
FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL""",
)
def classify_query(spark: SparkSession, d: str) -> DataFrame:
    known = _signed(spark, d).where(F.col("event_type").isin("view", "click", "purchase"))
    labelled = classify(known, ["event_type", "level"], _SIGNATURES)
    return labelled.groupBy("stratum").agg(F.count("*").alias("units"))


@query(
    "unknown_signatures",
    """SELECT event_type, (value > 50)::INTEGER AS level, count(*) AS rows FROM events
WHERE event_type NOT IN ('view', 'click', 'purchase') GROUP BY ALL""",
)
def unknown_signatures_query(spark: SparkSession, d: str) -> DataFrame:
    return unknown_signatures(_signed(spark, d), ["event_type", "level"], _SIGNATURES)


_SLICED = 2_000


@query("canonical_order_sliced", ORACLES["canonical_order"])
def canonical_order_sliced(spark: SparkSession, d: str) -> DataFrame:
    """The canonical order by the plan for groups that no task can hold, with a small limit."""
    documents = table(spark, d, "documents").select("doc_id", "source")
    return canonical_order(documents, "source", "doc_id", slice_rows=_SLICED)


def _powers() -> str:
    powers, base = [], keys.SEQUENCE_BASE
    for _ in range(40):
        powers.append(base)
        base = base * base % keys.SEQUENCE_PRIME
    return ", ".join(map(str, powers))


@query(
    "sequence_check",
    f"""
WITH t AS (SELECT doc_id AS pos, ('0x' || substr(sha256(source), 1, 12))::BIGINT % {keys.SEQUENCE_PRIME} AS h FROM documents),
m AS (SELECT h, list_reduce(list_prepend(1::BIGINT, list_transform([{_powers()}]::BIGINT[],
  lambda p, i: CASE WHEN (pos >> (i - 1)) & 1 = 1 THEN p ELSE 1 END)), lambda a, b: a * b % {keys.SEQUENCE_PRIME}) AS power FROM t)
SELECT count(*) AS rows, coalesce(sum(h * power % {keys.SEQUENCE_PRIME}) % {keys.SEQUENCE_PRIME}, 0)::BIGINT AS "check" FROM m""",
)
def sequence_check_query(spark: SparkSession, d: str) -> DataFrame:
    """The sources of all documents by doc_id, checked without ordering them."""
    return sequence_check(table(spark, d, "documents"), "doc_id", "source")


@query(
    "sequences_differ",
    """
WITH a AS (SELECT doc_id, source FROM documents),
b AS (SELECT CASE WHEN doc_id % 100 = 0 THEN doc_id + 1 WHEN doc_id % 100 = 1 THEN doc_id - 1 ELSE doc_id END AS doc_id, source
      FROM documents WHERE doc_id % 50 <> 7),
j AS (SELECT coalesce(a.doc_id, b.doc_id) AS p, a.source IS DISTINCT FROM b.source AS off FROM a FULL JOIN b USING (doc_id))
SELECT (SELECT count(*) FROM a) AS left_rows, (SELECT count(*) FROM b) AS right_rows,
  count_if(off) AS different_positions, min(CASE WHEN off THEN p END) AS first_difference FROM j""",
)
def sequences_differ_query(spark: SparkSession, d: str) -> DataFrame:
    """Documents against a copy in which neighbours are swapped and rows are dropped."""
    left = table(spark, d, "documents").select("doc_id", "source")
    place = F.col("doc_id") % 100
    swapped = F.when(place == 0, F.col("doc_id") + 1).when(place == 1, F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    right = left.where(F.col("doc_id") % 50 != 7).select(swapped.alias("doc_id"), "source")
    return sequences_differ(left, right, "doc_id", "source")


@query(
    "order_keys",
    """
SELECT l_orderkey, l_linenumber, l_extendedprice - 50000 AS value,
  row_number() OVER (ORDER BY l_extendedprice - 50000, l_orderkey, l_linenumber) AS place FROM lineitem WHERE l_linenumber = 1""",
)
def order_keys(spark: SparkSession, d: str) -> DataFrame:
    """Doubles of both signs through their order keys and back, ranked by the key."""
    lines = table(spark, d, "lineitem").where("l_linenumber = 1")
    key = keys.order_key(F.col("l_extendedprice") - 50000)
    keyed = lines.select("l_orderkey", "l_linenumber", key.alias("key"))
    ranked = rank(keyed, [], ["key", "l_orderkey", "l_linenumber"], "place")
    return ranked.select(
        "l_orderkey", "l_linenumber", keys.from_order_key(F.col("key")).alias("value"), (F.col("place") + 1).alias("place")
    )


@query(
    "exact_digests",
    """
WITH e AS (SELECT vec_id, embedding AS a, list_transform(embedding, lambda v, i: CASE WHEN i = 1 AND vec_id % 3 = 0 THEN v::DOUBLE + 3e-7 ELSE v::DOUBLE END) AS b FROM embeddings)
SELECT vec_id, a::DOUBLE[] = b AS same_values, false AS same_across_types FROM e""",
)
def exact_digests(spark: SparkSession, d: str) -> DataFrame:
    """Digests agree exactly where all values do: one element off by 3e-7, and float against double."""
    vectors = table(spark, d, "embeddings").withColumn("a", F.col("embedding").cast("array<double>"))
    moved = F.transform(
        "a", lambda v, i: F.when((i == 0) & (F.col("vec_id") % 3 == 0), v + F.lit(3e-7)).otherwise(v)
    )
    vectors = vectors.withColumn("b", moved)
    one, two, raw = (keys.typed_array_digest(vectors, c) for c in ("a", "b", "embedding"))
    return vectors.select("vec_id", (one == two).alias("same_values"), (one == raw).alias("same_across_types"))
