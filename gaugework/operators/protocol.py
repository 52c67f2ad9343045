"""Whole evaluations composed from the operators: gates first, one scoring pass, then tables.

The scored units are the only large intermediate. They are checkpointed once in the cluster's
checkpoint folder, and every gate reads that copy; the entity means are checkpointed likewise
for the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from gaugework.functions.values import is_finite
from gaugework.operators import constraints as q
from gaugework.operators import joins, runs, stats
from gaugework.operators.gates import Gates, RowGates
from gaugework.session import ensure_checkpoint_dir
from gaugework.sources.publish import Output, publish_once


@dataclass(frozen=True)
class Study:
    """Names and rules an evaluation is held to; fixed before any unit is read."""

    unit: str
    entity: str
    partition: str
    stratum: str
    metrics: tuple[str, ...]
    baseline: str
    methods: tuple[str, ...]
    allowed: tuple[str, ...]
    lower: tuple[str, ...] = ("mae", "mse")
    higher: tuple[str, ...] = ("psnr", "ssim")
    expected: dict[str, int] = field(default_factory=dict)
    #: Partitions that exist but are not opened.
    sealed: tuple[str, ...] = ()


def manifest_gates(manifest: DataFrame, study: Study) -> DataFrame:
    """Checks on metadata alone, in one pass over it: keys, leakage, labels and, where given, exact
    counts. A label must be an open or a sealed partition of the study; a row without one fails."""
    columns = q.required_columns(manifest, [study.unit, study.entity, study.partition, study.stratum])
    q.require(columns)
    gates = Gates()
    rows = gates.table(manifest)
    rows.unique([study.unit]).constant([study.entity], [study.stratum])
    rows.no_leakage(study.entity, study.partition)
    rows.only_partitions(study.partition, sorted({*study.allowed, *study.sealed, *study.expected}))
    if study.expected:
        rows.expected_counts(study.partition, study.expected)
    return q.combine([columns, gates.report()])


def finite_metrics(study: Study) -> RowGates:
    """The row gates of scored units; they are counted while the scores are written."""
    return RowGates({f"finite {m}": is_finite(F.col(m)) for m in study.metrics}, study.unit)


def score_gates(scored: DataFrame, units: DataFrame, study: Study) -> DataFrame:
    """Checks across scored units, in one pass over them and one over the units: one row per unit and
    method, one shared input, every planned row and no other."""
    named = F.array(*[F.lit(m) for m in study.methods])
    plan = units.select(study.unit, F.explode(named).alias("method"))
    keys = [study.unit, "method"]
    gates = Gates()
    rows, planned = gates.table(scored), gates.table(plan)
    rows.unique(keys).constant([study.unit], ["input_digest"], "shared input digest")
    rows.rows({"input digest present": F.col("input_digest").isNotNull()})
    gates.planned(planned, keys, rows, keys)
    return gates.report()


def result_tables(scored: DataFrame, study: Study, bound: int | None = None) -> dict[str, DataFrame]:
    """Entity means, primary and pooled results, strata, and paired deltas against the baseline."""
    metrics = list(study.metrics)
    ensure_checkpoint_dir(scored.sparkSession)
    entities = stats.entity_means(scored, ["method", study.entity], metrics, [study.stratum]).checkpoint()
    pooled = scored.groupBy("method").agg(*[F.avg(m).alias(m) for m in metrics])
    tables = {
        "entities": entities,
        "primary": stats.describe_entities(entities, metrics, ["method"], bound),
        "pooled": stats.to_long(pooled, ["method"], {m: m for m in metrics}),
        "strata": entities.groupBy("method", study.stratum).agg(
            F.count("*").alias("entities"), *[F.avg(f"mean_{m}").alias(f"mean_{m}") for m in metrics]
        ),
    }
    matched = [study.stratum, "unit_count"]
    for name in study.methods:
        if name == study.baseline:
            continue
        pairs = joins.strict_pairs_of(
            entities, study.entity, "method", name, study.baseline, metrics, matched
        )
        tables[f"deltas_{name}"] = pairs
        tables[f"summary_{name}"] = stats.paired_delta_summary(
            pairs, metrics, study.lower, study.higher, bound
        )
    return tables


def evaluate(
    manifest: DataFrame,
    study: Study,
    partition: str,
    score: Callable[[DataFrame], DataFrame],
    destination: str | None = None,
    limit: int | None = None,
    canonical: tuple[str, ...] = (),
) -> dict[str, DataFrame]:
    """Gate, read one open partition, score, gate again, analyse, and publish once.

    ``score`` maps the manifest rows of the partition to one row per (unit, method) with the
    metrics and ``input_digest``. All reports fail before anything is published.
    """
    q.require(manifest_gates(manifest, study))
    units = q.open_partition(manifest, study.partition, partition, list(study.allowed))
    if limit is not None:
        units = units.orderBy(study.unit).limit(limit)
    q.require(q.not_empty(units, f"units of {partition}"))

    ensure_checkpoint_dir(manifest.sparkSession)
    units = q.require_open(units, study.partition, list(study.allowed))
    finite = finite_metrics(study)
    scored = finite.watch(score(units)).checkpoint()
    q.require(q.combine([finite.report(manifest.sparkSession), score_gates(scored, units, study)]))
    tables = result_tables(scored, study, units.count())
    if destination is not None:
        outputs = {"units": Output(scored, "parquet", (), ("method",), (study.unit,))}
        for name, table in tables.items():
            data = name.startswith(("entities", "deltas"))
            order = [c for c in ("method", study.entity, study.stratum, "metric") if c in table.columns]
            outputs[name] = Output(table, "parquet" if data else "csv", (), (), tuple(order))
        publish_once(manifest.sparkSession, outputs, destination, limit, canonical)
    return {"units": scored, **tables}


def compare_runs(
    results: DataFrame,
    plan: DataFrame,
    witnesses: DataFrame,
    a: str,
    b: str,
    metrics: list[str],
    lower: tuple[str, ...],
    higher: tuple[str, ...],
    required_witnesses: int = 4,
    min_runs: int = runs.MIN_CONSISTENT_RUNS,
) -> dict[str, DataFrame]:
    """Two methods over all planned runs: completeness, witness proof, paired summary, claim.

    ``results`` is ``method, run, metric, value``; ``plan`` is ``method, run``; ``witnesses`` is
    ``method, run, field, witness, value``.
    """
    keys = ["method", "run"]
    proof = joins.witness_agreement(witnesses, [*keys, "field"], required_witnesses)
    q.require(
        q.combine(
            [
                q.planned(plan, results, keys),
                q.planned(plan, witnesses, keys),
                q.rows(proof, {"witnesses agree": F.col("agree")}, "run"),
                q.unique(results, [*keys, "metric"]),
            ]
        )
    )
    pairs = runs.paired_runs(results, a, b, lower, higher)
    summary = runs.paired_run_summary(pairs, min_runs).withColumn("phrase", runs.permitted_phrase(a, b))
    return {
        "spread": runs.run_spread(results, ["method", "metric"]),
        "pairs": pairs,
        "summary": summary,
        "claim": runs.overall_claim(summary, a, b, metrics),
    }
