"""Key sets, alignment, agreement and constraint reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugework.functions.keys import content_digest
from gaugework.functions.values import is_finite
from gaugework.operators import constraints as q
from gaugework.operators import joins, stats
from gaugework.operators.gates import Gates
from gaugework.plans.registry import query, rounded, table


@query(
    "orphans",
    "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def orphans(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.orphans(orders, lines, "o_orderkey")


@query(
    "missing_and_extra",
    """
WITH l AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'),
r AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F')
SELECT CASE WHEN r.k IS NULL THEN 'left_only' WHEN l.k IS NULL THEN 'right_only' ELSE 'both' END AS side,
       count(*) AS keys FROM l FULL JOIN r ON l.k = r.k GROUP BY ALL""",
)
def missing_and_extra(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"))
    right = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    return joins.missing_and_extra(left, right, "k")


@query(
    "members_elsewhere",
    """
SELECT o_orderstatus AS partition, count(*) AS orders FROM orders
WHERE o_orderstatus <> 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
GROUP BY ALL""",
)
def members_elsewhere(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("partition"))
    members = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    out = joins.members_elsewhere(rows, members, "o_custkey", "partition", "F")
    return out.groupBy("partition").agg(F.count("*").alias("orders"))


@query(
    "inherited_mismatches",
    """
SELECT count(*) AS units, count_if(o_orderstatus <> l_linestatus) AS mismatched
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def inherited_mismatches(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linestatus").alias("status"))
    entities = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("status")
    )
    return joins.inherited_mismatches(units, entities, "l_orderkey", "status")


@query(
    "positional_alignment",
    """
WITH a AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS p FROM events),
b AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS p FROM events WHERE value > 1)
SELECT count(a.p) AS left_rows, count(b.p) AS right_rows,
       count_if(a.event_id IS DISTINCT FROM b.event_id) AS order_mismatches,
       count_if(a.event_id IS DISTINCT FROM b.event_id) = 0 AS identical_order
FROM a FULL JOIN b ON a.p = b.p""",
)
def positional_alignment(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "ts", "value")
    order = ["ts", "event_id"]
    return joins.positional_alignment(events, events.where("value > 1"), order, order, "event_id")


@query(
    "witness_agreement",
    """
WITH w AS (
  SELECT o_orderkey AS k, 'header' AS witness, o_orderstatus AS value FROM orders
  UNION ALL
  SELECT l_orderkey, 'lines', CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'P' END
  FROM lineitem GROUP BY l_orderkey),
a AS (SELECT k, count(DISTINCT witness) AS witnesses,
             count(DISTINCT witness) >= 2 AND min(value) = max(value) AS agree FROM w GROUP BY k)
SELECT witnesses, agree, count(*) AS orders FROM a GROUP BY ALL""",
)
def witness_agreement(spark: SparkSession, d: str) -> DataFrame:
    header = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), F.lit("header").alias("witness"), F.col("o_orderstatus").alias("value")
    )
    # Two counts instead of min/max of text keep the pass over the lines a hash aggregate.
    lines = (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("k"))
        .agg(F.count_if(F.col("l_linestatus") == "F").alias("f"), F.count("*").alias("n"))
        .select(
            "k",
            F.lit("lines").alias("witness"),
            F.when(F.col("f") == F.col("n"), "F").when(F.col("f") == 0, "O").otherwise("P").alias("value"),
        )
    )
    agreed = joins.witness_agreement(header.unionByName(lines), ["k"], required=2)
    return agreed.groupBy("witnesses", "agree").agg(F.count("*").alias("orders"))


def _plan_and_results(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Planned (nation, segment) pairs of four regions; results: pairs with a rich customer."""
    customers = table(spark, d, "customer")
    regions = table(spark, d, "region").where(F.col("r_name").isin("AFRICA", "AMERICA", "ASIA", "EUROPE"))
    nations = table(spark, d, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    segments = [F.lit(s) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")]
    plan = nations.select(F.col("n_nationkey").alias("nation"), F.explode(F.array(*segments)).alias("segment"))
    results = customers.where("c_acctbal > 9000").select(
        F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")
    )
    return plan, results


_PLAN = """
plan AS (SELECT n_nationkey AS nation, s.segment FROM nation JOIN region ON n_regionkey = r_regionkey
         CROSS JOIN (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY')) s(segment)
         WHERE r_name IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')),
results AS (SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS segment FROM customer WHERE c_acctbal > 9000)"""


@query("plan_gaps", f"WITH {_PLAN} SELECT * FROM plan EXCEPT SELECT * FROM results")
def plan_gaps(spark: SparkSession, d: str) -> DataFrame:
    return q.plan_gaps(*_plan_and_results(spark, d), ["nation", "segment"])


@query("unplanned", f"WITH {_PLAN} SELECT * FROM results EXCEPT SELECT * FROM plan")
def unplanned(spark: SparkSession, d: str) -> DataFrame:
    return q.unplanned(*_plan_and_results(spark, d), ["nation", "segment"])


@query(
    "pooled_sources",
    """
SELECT nation, 2::BIGINT AS sources FROM (
  SELECT DISTINCT c_nationkey AS nation FROM customer WHERE c_acctbal > 9500
  INTERSECT SELECT DISTINCT s_nationkey FROM supplier)""",
)
def pooled_sources(spark: SparkSession, d: str) -> DataFrame:
    pooled = q.pooled_sources(
        {
            "customer": table(spark, d, "customer").where("c_acctbal > 9500").select(F.col("c_nationkey").alias("nation")),
            "supplier": table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")),
        },
        "nation",
    )
    return q.clashing_entities(pooled, "nation")


@query(
    "leakage",
    """
SELECT o_custkey, count(DISTINCT o_orderstatus) AS partitions FROM orders GROUP BY o_custkey
HAVING count(DISTINCT o_orderstatus) > 1""",
)
def leakage(spark: SparkSession, d: str) -> DataFrame:
    return q.leaking_entities(table(spark, d, "orders"), "o_custkey", "o_orderstatus")


@query(
    "inconsistent_groups",
    """
SELECT l_orderkey, count(DISTINCT l_linestatus) AS variants FROM lineitem GROUP BY l_orderkey
HAVING count(DISTINCT l_linestatus) > 1""",
)
def inconsistent_groups(spark: SparkSession, d: str) -> DataFrame:
    return q.inconsistent_groups(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linestatus"])


@query(
    "duplicates",
    """
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
)
def duplicates(spark: SparkSession, d: str) -> DataFrame:
    return q.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


_ROW_CHECKS = {
    "finite value": "isfinite(value)",
    "positive value": "value > 0",
    "value within 300": "value BETWEEN 0 AND 300",
    "known type": "event_type IN ('view', 'click', 'signup', 'purchase')",
}


@query(
    "row_checks",
    " UNION ALL ".join(
        f"SELECT '{name}' AS \"check\", count_if(NOT ({cond})) = 0 AS passed, count_if(NOT ({cond})) AS n_bad, "
        f"coalesce(min(CASE WHEN NOT ({cond}) THEN event_id END)::VARCHAR, '') AS detail FROM events"
        for name, cond in _ROW_CHECKS.items()
    ),
)
def row_checks(spark: SparkSession, d: str) -> DataFrame:
    value = F.col("value")
    good = {
        "finite value": is_finite(value),
        "positive value": value > 0,
        "value within 300": value.between(0, 300),
        "known type": F.col("event_type").isin("view", "click", "signup", "purchase"),
    }
    return q.rows(table(spark, d, "events"), good, "event_id")


@query(
    "gate_report",
    """
WITH s AS (SELECT l_suppkey, avg(l_quantity) AS a, sum(l_quantity) / count(l_quantity) AS b FROM lineitem GROUP BY l_suppkey)
SELECT 'unique o_orderkey' AS "check", count(*) = 0 AS passed, count(*) AS n_bad, '' AS detail FROM (
  SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'unique l_orderkey,l_linenumber', count(*) = 0, count(*), '' FROM (
  SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'constant l_linestatus per l_orderkey', count(*) = 0, count(*), '' FROM (
  SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linestatus) > 1)
UNION ALL SELECT 'same keys', count(*) = 0, count(*), 'missing 0, extra ' || count(*) FROM (
  SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'no entity in two partitions', count(*) = 0, count(*), '' FROM (
  SELECT 1 FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1)
UNION ALL SELECT 'only partitions F,O', count(*) = 0, count(*), '' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'two routes agree', count(*) = 0, count(*), '' FROM s WHERE abs(a - b) > 1e-9
UNION ALL SELECT 'not empty', count(*) > 0, (count(*) = 0)::BIGINT, '' FROM orders""",
)
def gate_report(spark: SparkSession, d: str) -> DataFrame:
    """Eight gates on two tables, each table read once."""
    gates = Gates()
    orders, lines = gates.table(table(spark, d, "orders")), gates.table(table(spark, d, "lineitem"))
    orders.unique(["o_orderkey"])
    lines.unique(["l_orderkey", "l_linenumber"]).constant(["l_orderkey"], ["l_linestatus"])
    gates.same_keys(lines, ["l_orderkey"], orders, ["o_orderkey"])
    orders.no_leakage("o_custkey", "o_orderstatus").only_partitions("o_orderstatus", ["F", "O"])
    lines.two_routes(["l_suppkey"], "l_quantity", ["l_returnflag"], 1e-9)
    orders.not_empty()
    return gates.report()


@query(
    "candidate_sweep",
    """
WITH c AS (SELECT * FROM (VALUES (0.02, 10), (0.02, 25), (0.05, 10), (0.05, 25)) t(discount, quantity)),
e AS (SELECT discount, quantity, l_suppkey,
             avg(CASE WHEN l_discount >= discount AND l_quantity >= quantity THEN 1.0 ELSE 0.0 END) AS hit
      FROM lineitem CROSS JOIN c GROUP BY ALL)
SELECT discount::DOUBLE AS discount, quantity, count(*) AS entities, round(avg(hit), 6) AS entity_weighted_hit
FROM e GROUP BY ALL""",
)
def candidate_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Every line under every candidate threshold; suppliers weigh equally."""
    candidates = [{"discount": a, "quantity": b} for a in (0.02, 0.05) for b in (10, 25)]
    units = table(spark, d, "lineitem").select("l_suppkey", "l_discount", "l_quantity")
    grid = joins.candidate_grid(units, candidates).select("*", "candidate.*")
    hit = (F.col("l_discount") >= F.col("discount")) & (F.col("l_quantity") >= F.col("quantity"))
    entities = stats.entity_means(
        grid.withColumn("hit", hit.cast("double")), ["discount", "quantity", "l_suppkey"], ["hit"]
    )
    out = entities.groupBy("discount", "quantity").agg(
        F.count("*").alias("entities"), F.avg("mean_hit").alias("entity_weighted_hit")
    )
    return rounded(out, ["entity_weighted_hit"])


@query(
    "expected_counts",
    """
WITH p AS (SELECT * FROM (VALUES ('ENTRY', 1), ('AUTO', 1)) t(g, w)),
c AS (SELECT event_type AS g, count(*) AS n FROM events GROUP BY event_type),
o AS (SELECT o_orderpriority AS g, count(*) AS n FROM orders GROUP BY o_orderpriority)
SELECT 'counts per event type' AS "check",
  count_if(n IS DISTINCT FROM w) + (sum(n) IS DISTINCT FROM sum(w))::BIGINT = 0 AS passed,
  count_if(n IS DISTINCT FROM w) + (sum(n) IS DISTINCT FROM sum(w))::BIGINT AS n_bad, '' AS detail
FROM c FULL JOIN p USING (g)
UNION ALL SELECT 'counts per priority', max(n) = 0, 0, '' FROM (SELECT 0 AS n FROM o)
UNION ALL SELECT 'required event_id', count(*) = 0, count(*), '' FROM events WHERE event_id IS NULL""",
)
def expected_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows per group against a plan that is wrong, one that is right, and a required value."""
    events, orders = table(spark, d, "events"), table(spark, d, "orders")
    # One row per priority: there are five.
    right = {r["o_orderpriority"]: r["count"] for r in orders.groupBy("o_orderpriority").count().collect()}
    gates = Gates()
    seen = gates.table(events).expected_counts("event_type", {"ENTRY": 1, "AUTO": 1}, check="counts per event type")
    gates.table(orders).expected_counts("o_orderpriority", right, check="counts per priority")
    seen.rows({"required event_id": F.col("event_id").isNotNull()})
    return gates.report()


@query(
    "sealed_gate",
    """
WITH m AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS part FROM documents),
o AS (SELECT min(source) AS open FROM documents)
SELECT 'every row has a known label' AS "check", count(*) = 0 AS passed, count(*) AS n_bad, '' AS detail FROM m WHERE part IS NULL
UNION ALL SELECT 'only open rows', count(*) = 0, count(*), '' FROM m, o WHERE part IS NULL OR part <> open""",
)
def sealed_gate(spark: SparkSession, d: str) -> DataFrame:
    """Labels of a manifest in one pass: unlabelled rows, and rows that are not open. No content."""
    documents = table(spark, d, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("part")
    )
    first = table(spark, d, "documents").agg(F.min("source")).first()[0]
    known = F.col("part").isNotNull()
    gates = Gates()
    gates.table(documents).rows({"every row has a known label": known, "only open rows": F.col("part") == first})
    return gates.report()


@query(
    "identical_bytes",
    """
SELECT 'identical content' AS "check", count(*) = 0 AS passed, count(*) AS n_bad, '' AS detail FROM (
  SELECT d.doc_id FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id
  WHERE p.page_id IS NULL OR sha256(encode(d.text)) IS DISTINCT FROM sha256(encode(p.html))
  UNION ALL SELECT page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM documents))""",
)
def identical_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Two tables that should hold the same content under the same ids, and do not."""
    left = table(spark, d, "documents").select(F.col("doc_id").alias("k"), content_digest("text").alias("digest"))
    right = table(spark, d, "pages").select(F.col("page_id").alias("k"), content_digest("html").alias("digest"))
    return q.same_bytes(left, right, ["k"], "digest")


@query(
    "recorded_choice",
    """
WITH a AS (SELECT o_custkey, max(o_totalprice) AS c FROM orders GROUP BY o_custkey),
b AS (SELECT o_custkey, max(o_totalprice) AS c FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey)
SELECT 'recorded choice equals recomputed choice' AS "check", count_if(a.c IS DISTINCT FROM b.c) = 0 AS passed,
  count_if(a.c IS DISTINCT FROM b.c) AS n_bad, '' AS detail FROM a FULL JOIN b USING (o_custkey)""",
)
def recorded_choice(spark: SparkSession, d: str) -> DataFrame:
    """The best order of each customer, recorded over all orders and computed again without some."""
    orders = table(spark, d, "orders")
    best = lambda df: df.groupBy("o_custkey").agg(F.max("o_totalprice").alias("c"))
    return q.recorded_choice(best(orders), best(orders.where("o_orderstatus <> 'P'")), ["o_custkey"], "c")
