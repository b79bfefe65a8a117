"""Pipeline health as DataFrames: states, roll-ups, incidents, lag, counters, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changemill.operators.fold import latest_per_key
from changemill.operators.ordering import nearest_in_group
from changemill.session import cut_lineage

# ---- Fixed values: histogram bounds in seconds, state order, lag threshold -----------------
MESSAGE_BUCKETS = (0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0)
CONNECTION_BUCKETS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0)
DISCOVERY_BUCKETS = (1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)
CREATION_BUCKETS = (1.0, 5.0, 10.0, 30.0, 60.0, 120.0)
STATE_ORDER = ("ERROR", "FAILED", "PAUSED", "RUNNING", "UNKNOWN")
LAG_WARNING_SECONDS = 60
HEARTBEAT_TOPICS = r"^__[^.]*heartbeat\."
OPERATION_NAMES = {"c": "insert", "r": "insert", "u": "update", "d": "delete", "t": "truncate"}
# -------------------------------------------------------------------------------------------


def has_failed_task(tasks: Column) -> Column:
    return F.coalesce(F.exists(tasks, lambda t: t["state"] == "FAILED"), F.lit(False))


def is_healthy(state: Column, task_failed: Column) -> Column:
    """Running or paused, and no failed task."""
    return state.isin("RUNNING", "PAUSED") & ~task_failed


def is_recoverable(state: Column, task_failed: Column) -> Column:
    """Healthy, or in a state that a resume or restart can mend."""
    return is_healthy(state, task_failed) | state.isin("PAUSED", "FAILED") | task_failed


def overall_health() -> Column:
    """healthy, degraded (both sides recoverable) or unhealthy, from a two-sided sample."""
    source = (F.col("source_state"), F.col("source_task_failed"))
    sink = (F.col("sink_state"), F.col("sink_task_failed"))
    return (
        F.when(is_healthy(*source) & is_healthy(*sink), "healthy")
        .when(is_recoverable(*source) & is_recoverable(*sink), "degraded")
        .otherwise("unhealthy")
    )


def health_rollup(samples: DataFrame, by: Sequence[str] = ("pipeline",)) -> DataFrame:
    """Samples per health class, one aggregate."""
    rows = samples.withColumn("_health", overall_health())
    return rows.groupBy(*by).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("_health") == h).alias(h) for h in ("healthy", "degraded", "unhealthy")],
    )


def latest_samples(samples: DataFrame, order: str, deleted: DataFrame | None = None) -> DataFrame:
    """Newest sample per pipeline, deleted pipelines left out, problem states first."""
    rows = samples if deleted is None else samples.join(deleted.select("pipeline"), "pipeline", "left_anti")
    newest = latest_per_key(rows, ["pipeline"], order)
    rank = F
    for i, state in enumerate(STATE_ORDER):
        rank = rank.when(F.col("source_state") == state, F.lit(i))
    return newest.withColumn("severity", rank.otherwise(F.lit(len(STATE_ORDER) - 1))).orderBy("severity", "pipeline")


def enrich_status(configs: DataFrame, statuses: DataFrame, targets: DataFrame) -> DataFrame:
    """Configs with source state, sink state and target database.

    ``configs``: pipeline, client, source_name, sink_name; ``statuses``: name, state,
    task_failed; ``targets``: client, target_db. A name without a status is NOT_FOUND, a
    config without a sink name is NOT_CONFIGURED.
    """
    src = statuses.select(F.col("name").alias("source_name"), F.col("state").alias("_ss"), F.col("task_failed").alias("_sf"))
    snk = statuses.select(F.col("name").alias("sink_name"), F.col("state").alias("_ks"))
    rows = configs.join(src, "source_name", "left").join(snk, "sink_name", "left").join(targets, "client", "left")
    state = F.coalesce("_ss", F.lit("NOT_FOUND"))
    sink = F.when(F.col("sink_name").isNull(), "NOT_CONFIGURED").otherwise(F.coalesce("_ks", F.lit("NOT_FOUND")))
    healthy = is_healthy(state, F.coalesce("_sf", F.lit(False)))
    return rows.select("pipeline", state.alias("source_state"), sink.alias("sink_state"), healthy.alias("is_healthy"), "target_db")


def state_counts(rows: DataFrame, column: str, states: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Total and one conditional count per named state, in one pass."""
    counts = [F.count("*").alias("total"), *[F.count_if(F.col(column) == v).alias(k) for k, v in states.items()]]
    return rows.groupBy(*by).agg(*counts) if by else rows.agg(*counts)


def connection_health(connectors: DataFrame, connections: DataFrame) -> DataFrame:
    """no_connectors, degraded (any failed), healthy (all running) or partial, per connection."""
    totals = connectors.groupBy("connection").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("state") == "RUNNING").alias("running"),
        F.count_if(F.col("state") == "FAILED").alias("failed"),
    )
    rows = connections.select("connection").join(totals, "connection", "left").na.fill(0, ["total", "running", "failed"])
    status = (
        F.when(F.col("total") == 0, "no_connectors")
        .when(F.col("failed") > 0, "degraded")
        .when(F.col("running") == F.col("total"), "healthy")
        .otherwise("partial")
    )
    return rows.withColumn("health", status)


def sink_badges(sinks: DataFrame, by: str) -> DataFrame:
    """One badge per client: any FAILED, else any PAUSED, else all RUNNING, else UNKNOWN."""
    state = F.col("state")
    badge = (
        F.when(F.bool_or(state == "FAILED"), "FAILED")
        .when(F.bool_or(state == "PAUSED"), "PAUSED")
        .when(F.bool_and(state == "RUNNING"), "RUNNING")
        .otherwise("UNKNOWN")
    )
    return sinks.groupBy(by).agg(badge.alias("badge"))


ALERT_KINDS = ("source_failed", "connector_missing", "sink_failed")


def alert_signals() -> dict[str, Column]:
    """Signal of a two-sided sample per alert kind: 1 where the kind fires, 0 where the whole
    pipeline is healthy, which is what resolves alerts, null where the sample does neither."""
    source_failed = (F.col("source_state") == "FAILED") | F.col("source_task_failed")
    sink_failed = (F.col("sink_state") == "FAILED") | F.col("sink_task_failed")
    missing = ~source_failed & (F.col("source_state") == "NOT_FOUND")
    healthy = overall_health() == "healthy"
    fires = dict(zip(ALERT_KINDS, (source_failed, missing, sink_failed), strict=True))
    return {kind: F.when(healthy, 0).when(on, 1) for kind, on in fires.items()}


def incidents(samples: DataFrame, slice_unit: str = "HOUR") -> DataFrame:
    """Incidents of every pipeline and alert kind: opened at the first firing sample, silent
    while open, resolved at the first healthy sample after it (null while still open).

    Signals that repeat the one before change nothing; the alternating rest are the opens and
    resolutions. Both look-ups of a neighbouring row go slice by slice, so a pipeline that
    holds much of all samples is spread over its hours, and all kinds share one sort.
    """
    # Few rows are left of the turns; they are read twice below, so they are computed once and kept.
    return paired_turns(cut_lineage(signal_turns(samples, slice_unit)), slice_unit)


def signal_turns(samples: DataFrame, slice_unit: str = "HOUR", standing: DataFrame | None = None) -> DataFrame:
    """Samples at which an alert kind's signal differs from the one before: (pipeline, ts, check_id, event_type, signal).

    ``standing``: last turns of earlier samples, in the same form; signals go on from them. Without any a signal starts at 0.
    """
    order, hour = ["ts", "check_id"], F.date_trunc(slice_unit, F.col("ts"))
    signals = samples.select("pipeline", *order, *[s.alias(k) for k, s in alert_signals().items()], F.lit(False).alias("_old"))
    if standing is not None:
        last = {k: F.max_by(F.when(F.col("event_type") == k, F.col("signal")), F.when(F.col("event_type") == k, F.struct(*order))).alias(k) for k in ALERT_KINDS}
        rows = standing.groupBy("pipeline").agg(F.max(F.struct(*order)).alias("_at"), *last.values())
        signals = signals.unionByName(rows.select("pipeline", "_at.*", *ALERT_KINDS, F.lit(True).alias("_old")))
    before = {f"_{k}": F.col(k) for k in ALERT_KINDS}
    marked = nearest_in_group(signals, ["pipeline"], order, before, hour).where("NOT _old")
    turned = [
        F.when(F.coalesce(f"_{k}", F.lit(0)) != F.col(k), F.struct(F.lit(k).alias("event_type"), F.col(k).alias("signal")))
        for k in ALERT_KINDS
    ]
    return marked.select("pipeline", *order, F.inline(F.array_compact(F.array(*turned))))


def paired_turns(turns: DataFrame, slice_unit: str = "HOUR") -> DataFrame:
    """Each opening turn with the time of the next turn of its kind."""
    order, hour = ["ts", "check_id"], F.date_trunc(slice_unit, F.col("ts"))
    paired = nearest_in_group(turns, ["pipeline", "event_type"], order, {"resolved_at": F.col("ts")}, hour, following=True)
    return paired.where("signal = 1").select("pipeline", "event_type", F.col("check_id").alias("opened_by"), F.col("ts").alias("opened_at"), "resolved_at")


def dead_letter_counts(offsets: DataFrame) -> DataFrame:
    """Messages held per dead-letter topic: high minus low of every partition, never negative."""
    return offsets.groupBy("topic").agg(F.sum(F.greatest(F.lit(0), F.col("high") - F.col("low"))).alias("n"))


def consumer_lag(high: DataFrame, committed: DataFrame) -> DataFrame:
    """Messages behind per topic and partition; no commit means everything is behind."""
    rows = high.join(committed.select("topic", "part", "committed"), ["topic", "part"], "left")
    behind = F.greatest(F.col("high") - F.greatest(F.coalesce("committed", F.lit(0)), F.lit(0)), F.lit(0))
    return rows.select("topic", "part", "high", "committed", behind.alias("lag"))


def seconds_behind(applied: DataFrame, by: Sequence[str]) -> DataFrame:
    """Seconds between the newest event and the newest applied event, with a warning flag.

    ``applied``: ts, applied_at (null while an event waits).
    """
    lag = F.timestamp_diff("SECOND", F.max(F.when(F.col("applied_at").isNotNull(), F.col("ts"))), F.max("ts"))
    return applied.groupBy(*by).agg(lag.alias("lag_seconds")).withColumn("is_late", F.col("lag_seconds") > LAG_WARNING_SECONDS)


def event_counts(feed: DataFrame, by: Sequence[str], op: str = "op") -> DataFrame:
    """Events per group and named operation."""
    name = F
    for code, text in OPERATION_NAMES.items():
        name = name.when(F.col(op) == code, F.lit(text))
    return feed.groupBy(*by, name.otherwise("unknown").alias("operation")).agg(F.count("*").alias("n"))


def latency_histogram(rows: DataFrame, seconds: Column, by: Sequence[str], buckets: Sequence[float] = MESSAGE_BUCKETS) -> DataFrame:
    """Cumulative histogram: rows at or below each bound and +Inf, per group.

    All bounds are counted in one aggregate; only its few result rows are turned to long form.
    """
    counts = [F.count_if(seconds <= F.lit(b)).alias(f"_le{i}") for i, b in enumerate(buckets)]
    wide = rows.groupBy(*by).agg(*counts, F.count(seconds).alias("_inf"))
    pairs = [F.struct(F.lit(str(b)).alias("le"), F.col(f"_le{i}").alias("n")) for i, b in enumerate(buckets)]
    pairs.append(F.struct(F.lit("+Inf").alias("le"), F.col("_inf").alias("n")))
    return wide.select(*by, F.inline(F.array(*pairs)))


def batch_results(rows: DataFrame, failed: Column) -> DataFrame:
    """Processed rows and errors of a batch."""
    return rows.agg(F.count_if(~failed).alias("processed"), F.count_if(failed).alias("errors"))


def without_heartbeats(feed: DataFrame) -> DataFrame:
    """Data rows of a feed: heartbeats advance positions and lag but carry no change."""
    return feed.where(~F.col("topic").rlike(HEARTBEAT_TOPICS))
