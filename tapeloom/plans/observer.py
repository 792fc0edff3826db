"""All analyzers over many symbols: coverage gate, one report row for each symbol and analyzer, and their summary."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, Window, functions as F

from tapeloom.functions.sheet import Sheet

from . import analyzers

#: fixed values: points that an issue takes from the health of 100
PENALTY = {"INFO": 2, "WARNING": 10, "ERROR": 25, "CRITICAL": 50, "FATAL": 100}


def report(features: DataFrame, least: float = 0.8) -> DataFrame:
    """(symbol, ts, analyzer, status, coverage, health, verdict): verdict is the record as JSON, null if blocked.

    All analyzers that have their columns share one plan over the feature table, whose windows they have in common.
    """
    found = analyzers.coverage(features, least)
    ready = [n for n, (_, state) in found.items() if state == "READY"]
    gone = {c for n in ready for c in analyzers.required(n) if c not in features.columns}
    table = features.withColumns({c: F.lit(None).cast("double") for c in sorted(gone)}) if gone else features
    s = Sheet({f.name: f.dataType.simpleString() for f in table.schema})
    out, names = {}, {}
    for name in ready:
        columns, votes = analyzers.ANALYZERS[name](s)
        columns = columns | {f"evidence_{k}": v.evidence() for k, v in votes.items()}
        names[name] = {c: f"{name}: {c}" for c in columns}
        out |= {names[name][c]: e for c, e in columns.items()}
    last = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    rows = s.spark(table, out, 2).withColumn("rank_", F.row_number().over(last)).where("rank_ = 1")
    records = []
    for name, (share, state) in found.items():
        lost = 0 if share >= 1 else PENALTY["WARNING"] if state == "READY" else PENALTY["CRITICAL"]
        verdict = F.to_json(F.struct(*(F.col(f"`{c}`").alias(k) for k, c in {"close": "close", **names[name]}.items()))) if name in names else F.lit(None).cast("string")
        values = (("analyzer", F.lit(name)), ("status", F.lit("PASS" if name in names else "BLOCKED")), ("coverage", F.lit(float(share))), ("health", F.lit(max(0, 100 - lost))), ("verdict", verdict))
        records.append(F.struct(*(v.alias(k) for k, v in values)))
    return rows.select("symbol", "ts", F.explode(F.array(*records)).alias("r")).select("symbol", "ts", "r.*")


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("analyzer").agg(
        F.count("*").alias("symbols"), F.sum(F.when(F.col("status") == "PASS", 1).otherwise(0)).alias("passed"), F.avg("coverage").alias("coverage"), F.avg("health").alias("health")
    )


def measured(features: DataFrame, names: list[str] | None = None) -> list[dict]:
    """(analyzer, rows, seconds) of each analyzer that the table has the columns for, run one after another over all bars."""
    out = []
    for name, (_, state) in analyzers.coverage(features).items():
        if state != "READY" or (names is not None and name not in names):
            continue
        gone = {c: F.lit(None).cast("double") for c in analyzers.required(name) if c not in features.columns}
        seen = Observation()
        began = time.perf_counter()
        found = analyzers.analyze(features.withColumns(gone) if gone else features, name, latest=False, evidence=False)
        found.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        out.append({"analyzer": name, "rows": seen.get["rows"], "seconds": time.perf_counter() - began})
    return out
