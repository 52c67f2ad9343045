"""Splits and sampling epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gaugework.operators import joins, sampling, selection, splits
from gaugework.operators.splits import entity_facts
from gaugework.plans.registry import digest_sql, natural_sql, query, table

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]
SIZES = {"validation": 0.15, "test": 0.15}


def _customers(spark: SparkSession, d: str) -> DataFrame:
    """Entities: customers with their segment as stratum and their order count as weight."""
    weights = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("weight"))
    return (
        table(spark, d, "customer")
        .select("c_custkey", F.col("c_mktsegment").alias("segment"))
        .join(weights, "c_custkey", "left")
        .withColumn("weight", F.coalesce("weight", F.lit(0)))
    )


def _split(spark: SparkSession, d: str) -> DataFrame:
    entities = _customers(spark, d)
    return splits.group_split(
        entities, "c_custkey", "segment", "weight", SIZES, SEGMENTS, bound=_entity_count(spark, d)
    )


def _entity_count(spark: SparkSession, d: str) -> int:
    return table(spark, d, "customer").count()


_ENTITIES = """
ent AS (SELECT c_custkey, c_mktsegment AS segment, coalesce(n, 0) AS weight
        FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)"""
_ALLOCATION = f"""{_ENTITIES},
cnt AS (SELECT segment, count(*) AS n, sum(count(*)) OVER () AS total FROM ent WHERE segment <> 'MACHINERY' GROUP BY segment),
parts AS (SELECT p.partition, floor(p.share * total + 0.5)::BIGINT AS size, segment, n, total
          FROM cnt, (VALUES ('validation', 0.15::DOUBLE), ('test', 0.15)) p(partition, share)),
base AS (SELECT *, (size * n) // total AS base, (size * n) % total AS rest FROM parts),
rnk AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY rest DESC, segment) - 1 AS k,
               size - sum(base) OVER (PARTITION BY partition) AS open FROM base),
slots AS (SELECT segment AS stratum, partition, n, (base + (k < open)::INTEGER)::BIGINT AS slots FROM rnk),
alloc AS (SELECT stratum, partition, slots FROM slots
          UNION ALL SELECT stratum, 'train', (any_value(n) - sum(slots))::BIGINT FROM slots GROUP BY stratum)"""
_DEAL = f"""{_ALLOCATION},
wide AS (SELECT stratum, sum(slots)::BIGINT AS n, max(CASE WHEN partition = 'validation' THEN slots END)::BIGINT AS v,
                max(CASE WHEN partition = 'test' THEN slots END)::BIGINT AS t FROM alloc GROUP BY stratum),
rnkd AS (SELECT c_custkey, segment, weight, row_number() OVER (PARTITION BY segment ORDER BY weight DESC, {natural_sql('c_custkey')}, c_custkey) - 1 AS r
         FROM ent WHERE segment <> 'MACHINERY'),
pos AS (SELECT *, v + t AS m, (r * (v + t) + n // 2) // n AS slot, (r * (v + t) + v + t + n // 2) // n AS next_slot
        FROM rnkd JOIN wide ON stratum = segment),
par AS (SELECT *, CASE WHEN (slot // 2) % 2 = 1 AND (CASE WHEN slot % 2 = 0 THEN slot + 1 ELSE slot - 1 END) < m
                       THEN (CASE WHEN slot % 2 = 0 THEN slot + 1 ELSE slot - 1 END) ELSE slot END AS j FROM pos),
dealt AS (SELECT c_custkey, segment, weight, CASE WHEN next_slot = slot THEN 'train' WHEN ((j + 1) * v) // m > (j * v) // m THEN 'validation' ELSE 'test' END AS partition
          FROM par UNION ALL SELECT c_custkey, segment, weight, 'stress' FROM ent WHERE segment = 'MACHINERY')"""


@query(
    "entity_facts",
    """SELECT o_custkey, c_mktsegment, c_nationkey, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
)
def entity_facts_query(spark: SparkSession, d: str) -> DataFrame:
    """One row per customer with orders: attributes proved constant, and the number of orders."""
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    units = joins.inherit(table(spark, d, "orders").select("o_custkey"), customers, "o_custkey", ["c_mktsegment", "c_nationkey"])
    return entity_facts(units, "o_custkey", ["c_mktsegment", "c_nationkey"], "orders")


@query("stratum_allocation", f"WITH {_ALLOCATION} SELECT * FROM alloc")
def stratum_allocation(spark: SparkSession, d: str) -> DataFrame:
    return splits.allocate(_customers(spark, d), "segment", SIZES, SEGMENTS)


@query(
    "two_strata_allocation",
    f"""
WITH {_ENTITIES},
t AS (SELECT count_if(segment = 'BUILDING') AS a, count(*) AS n FROM ent WHERE segment IN ('BUILDING', 'FURNITURE')),
s AS (SELECT *, floor(0.15::DOUBLE * n + 0.5)::BIGINT AS v, floor(0.15::DOUBLE * n + 0.5)::BIGINT AS e FROM t),
g AS (SELECT *, n - v - e AS r, a - i - j AS k FROM (
  SELECT s.*, unnest(range(1, v)) AS i FROM s) x, LATERAL (SELECT unnest(range(1, e)) AS j)),
f AS (SELECT *, round(abs(i / v - a / n) + abs(j / e - a / n) + abs(k / r - a / n), 12) AS score,
             CASE WHEN i = j THEN 1 ELSE 2 END AS asym FROM g WHERE k >= 0 AND r - k >= 0),
b AS (SELECT * FROM f ORDER BY score, asym, i, j LIMIT 1)
SELECT 'BUILDING' AS stratum, 'validation' AS partition, i AS slots FROM b UNION ALL SELECT 'FURNITURE', 'validation', v - i FROM b
UNION ALL SELECT 'BUILDING', 'test', j FROM b UNION ALL SELECT 'FURNITURE', 'test', e - j FROM b
UNION ALL SELECT 'BUILDING', 'train', k FROM b UNION ALL SELECT 'FURNITURE', 'train', r - k FROM b""",
)
def two_strata_allocation(spark: SparkSession, d: str) -> DataFrame:
    return splits.allocate(_customers(spark, d), "segment", SIZES, ["BUILDING", "FURNITURE"])


@query("group_split", f"WITH {_DEAL} SELECT * FROM dealt")
def group_split(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d)


_REPORT = ", ".join(f"count_if(segment = '{s}') AS entities_{s}" for s in [*SEGMENTS, "MACHINERY"])


@query(
    "split_report",
    f"""WITH {_DEAL}
SELECT partition, count(*) AS entities, sum(weight)::BIGINT AS units, min(weight) AS min_units, max(weight) AS max_units, {_REPORT},
       quantile_cont(weight, 0.5) AS median_units FROM dealt GROUP BY partition""",
)
def split_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_report(_split(spark, d), "partition", "segment", "weight", [*SEGMENTS, "MACHINERY"], _entity_count(spark, d))


_CHECKS = {
    "no duplicate entities": "(SELECT count(*) FROM (SELECT 1 FROM customer GROUP BY c_custkey HAVING count(*) > 1))",
    "every entity assigned, none added": """(SELECT count(*) FROM customer c FULL JOIN dealt d ON c.c_custkey = d.c_custkey
        WHERE c.c_custkey IS NULL OR d.c_custkey IS NULL)""",
    "known partition labels": "(SELECT count(*) FROM dealt WHERE partition NOT IN ('train', 'validation', 'test', 'stress'))",
    "no entity in two partitions": "(SELECT count(*) FROM (SELECT 1 FROM dealt GROUP BY c_custkey HAVING count(*) > 1))",
    "rare strata only in stress": "(SELECT count(*) FROM dealt WHERE segment = 'MACHINERY' AND partition <> 'stress')",
    "stress holds only rare strata": "(SELECT count(*) FROM dealt WHERE segment <> 'MACHINERY' AND partition = 'stress')",
    "every stratum in every evaluation partition": """(SELECT 8 - count(*) FROM (SELECT DISTINCT partition, segment FROM dealt
        WHERE partition IN ('validation', 'test') AND segment <> 'MACHINERY'))""",
}


@query(
    "validate_split",
    f"WITH {_DEAL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"check\", {n} = 0 AS passed, {n}::BIGINT AS n_bad" for c, n in _CHECKS.items()
    ),
)
def validate_split(spark: SparkSession, d: str) -> DataFrame:
    cohort = _customers(spark, d)
    report = splits.validate_split(_split(spark, d), cohort, "c_custkey", "segment", SEGMENTS, list(SIZES))
    return report.select("check", "passed", "n_bad")


@query(
    "balanced_split",
    f"""WITH {_DEAL}, w AS (SELECT sum(CASE partition WHEN 'validation' THEN weight WHEN 'test' THEN -weight ELSE 0 END) AS gap FROM dealt)
SELECT partition, segment, count(*) AS entities, true AS evened FROM dealt GROUP BY ALL""",
)
def balanced_split(spark: SparkSession, d: str) -> DataFrame:
    """Counts must survive the swaps, and the two totals end within one unit of each other."""
    even = splits.balance_evaluation(_split(spark, d), "c_custkey", "segment", "weight")
    signed = F.when(F.col("partition") == "validation", F.col("weight")).when(F.col("partition") == "test", -F.col("weight"))
    counts = even.groupBy("partition", "segment").agg(F.count("*").alias("entities"), F.sum(signed).alias("_d"))
    everything = Window.partitionBy(F.lit(0))  # one row per (partition, segment)
    return counts.withColumn("evened", F.abs(F.sum("_d").over(everything)) <= 1).drop("_d")


@query(
    "inherit_attributes",
    f"""WITH {_DEAL}
SELECT o_orderkey, o_custkey, partition, segment, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS index
FROM orders JOIN dealt ON c_custkey = o_custkey""",
)
def inherit_attributes(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    entities = _split(spark, d).select(F.col("c_custkey").alias("o_custkey"), "partition", "segment")
    units = joins.inherit(orders, entities, "o_custkey", ["partition", "segment"])
    out = selection.positional_index(units, "o_custkey", "o_orderdate", "o_orderkey", bound=orders.count(), materialize=True)
    return out.drop("o_orderdate")


# -- epochs: entities are users, units are events

SEED, EPOCH = 2026, 3


def _pools(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_id")


_QUOTAS = f"""
pools AS (SELECT user_id, count(*) AS pool FROM events GROUP BY user_id),
idx AS (SELECT *, row_number() OVER (ORDER BY {natural_sql('user_id')}, user_id) - 1 AS entity_index,
               count(*) OVER () AS n, (sum(pool) OVER ())::BIGINT AS size FROM pools),
quo AS (SELECT user_id, pool, entity_index, size // n + ((((entity_index - ({EPOCH} * (size % n)) % n) % n + n) % n) < size % n)::INTEGER AS quota,
               n, size FROM idx)"""
_DRAWS = f"""{_QUOTAS},
passes AS (SELECT event_id, user_id, pool, quota, unnest(range(0, (quota - 1) // pool + 1)) AS pass FROM events JOIN quo USING (user_id)),
hashed AS (SELECT *, {digest_sql("'entity_balanced_v1'", str(SEED), str(EPOCH), "user_id", "pass", "event_id")} AS h FROM passes),
drawn AS (SELECT *, pass * pool + row_number() OVER (PARTITION BY user_id, pass ORDER BY h, event_id) - 1 AS draw FROM hashed),
kept AS (SELECT user_id, event_id, pass, draw FROM drawn WHERE draw < quota)"""


@query("epoch_quotas", f"WITH {_QUOTAS} SELECT user_id, pool, entity_index, quota FROM quo")
def epoch_quotas(spark: SparkSession, d: str) -> DataFrame:
    return sampling.epoch_quotas(_pools(spark, d), "user_id", EPOCH)


@query(
    "balanced_epoch",
    f"""WITH {_DRAWS}
SELECT user_id, event_id, pass, draw,
       row_number() OVER (ORDER BY {digest_sql("'entity_balanced_v1'", str(SEED), str(EPOCH), "'order'", "user_id", "draw")}, user_id, draw) - 1 AS position
FROM kept""",
)
def balanced_epoch(spark: SparkSession, d: str) -> DataFrame:
    return sampling.balanced_epoch(_pools(spark, d), "user_id", "event_id", SEED, EPOCH)


@query(
    "epoch_report",
    f"""WITH {_DRAWS}, per AS (SELECT user_id, count(*) AS n FROM kept GROUP BY user_id)
SELECT (SELECT count(*) FROM kept) AS draws, count(*) AS entities, min(n) AS min_draws, max(n) AS max_draws,
       (SELECT count(DISTINCT event_id) FROM kept) AS unique_units,
       (SELECT count(*) - count(DISTINCT event_id) FROM kept) AS repeats,
       (SELECT count(*) FROM events) - (SELECT count(DISTINCT event_id) FROM kept) AS undrawn FROM per""",
)
def epoch_report(spark: SparkSession, d: str) -> DataFrame:
    units = _pools(spark, d)
    draws = sampling.entity_draws(units, "user_id", "event_id", SEED, EPOCH)
    return sampling.epoch_report(draws, units, "user_id", "event_id")


@query(
    "draw_distribution",
    f"WITH {_QUOTAS} SELECT quota AS draws, count(*) AS entities FROM quo GROUP BY quota",
)
def draw_distribution(spark: SparkSession, d: str) -> DataFrame:
    draws = sampling.entity_draws(_pools(spark, d), "user_id", "event_id", SEED, EPOCH)
    return sampling.draw_distribution(draws, "user_id")


@query(
    "rotation_totals",
    f"""WITH {_QUOTAS}, x AS (SELECT user_id, n, size, count_if((((entity_index - (e * (size % n)) % n) % n + n) % n) < size % n) AS extra_draws
  FROM quo, range(8) t(e) GROUP BY ALL)
SELECT user_id, extra_draws, 8 * (size // n) + extra_draws AS total_draws FROM x""",
)
def rotation_totals(spark: SparkSession, d: str) -> DataFrame:
    return sampling.rotation_totals(_pools(spark, d), "user_id", 8)


@query(
    "epoch_audit",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"check\", true AS passed"
        for c in ("same seed and epoch repeat", "another epoch differs", "another seed differs", "first pass repeats nothing")
    ),
)
def epoch_audit(spark: SparkSession, d: str) -> DataFrame:
    return sampling.epoch_audit(_pools(spark, d), "user_id", "event_id", SEED, EPOCH).select("check", "passed")
