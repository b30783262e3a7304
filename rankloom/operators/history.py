"""Event-log and run-history analytics. ``now`` is always a parameter."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import order
from rankloom.functions.numeric import num, ratio, rnd, stable_mean, stable_sum

# --- fixed values -----------------------------------------------------------
STAGE_ORDER = (
    "pipeline", "fetch", "heavy_analysis", "features", "scoring", "competitors", "competitor_page", "competitor_analysis",
    "competitor_aggregation", "recommendations", "finalize",
)
TASK_STAGES = {
    "app.process_audit": "pipeline", "app.process_audit_fetch_target": "fetch",
    "app.process_audit_run_heavy_analysis": "heavy_analysis", "app.process_audit_extract_features": "features",
    "app.process_audit_score_target": "scoring", "app.process_audit_collect_competitors": "competitors",
    "app.process_audit_collect_competitor_page": "competitor_page", "app.process_audit_analyze_competitor_page": "competitor_analysis",
    "app.process_audit_aggregate_competitors": "competitor_aggregation",
    "app.process_audit_generate_recommendations": "recommendations", "app.process_audit_finalize": "finalize",
}
TERMINAL_EVENTS = ("completed", "failed", "aborted")
FAN_OUT_STAGES = ("competitor_page", "competitor_analysis")
TERMINAL_STATUSES = ("completed", "completed_with_warnings", "failed")
STALE_MINUTES = 15
RECENT_RUNS = 50
QUEUED_WAIT_SECONDS = 300.0
DISPATCH_WAIT_SECONDS = 180.0
BACKLOG_FACTOR = 3.0
SAMPLE_LIMIT = 10
LOW_SCORE, HIGH_SCORE = 50.0, 80.0
TRANSITIONS = (
    ("queued", "processing"), ("queued", "failed"), ("processing", "completed"), ("processing", "completed_with_warnings"),
    ("processing", "failed"), ("completed", "processing"), ("completed_with_warnings", "processing"), ("failed", "processing"),
)
# --- end of fixed values ----------------------------------------------------


def lookup(column: Column, table: dict[str, object], default: Column) -> Column:
    """A short fixed mapping as one CASE, which needs no join."""
    return reduce(lambda rest, kv: F.when(column == kv[0], F.lit(kv[1])).otherwise(rest), table.items(), default)


def logical_stage(stage: Column) -> Column:
    return lookup(stage, TASK_STAGES, stage)


def stage_position(stage: Column) -> Column:
    return lookup(stage, {name: i for i, name in enumerate(STAGE_ORDER)}, F.lit(999))


def seconds_between(start: Column, end: Column) -> Column:
    """Signed seconds with microseconds."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)


def latest_version_events(events: DataFrame) -> DataFrame:
    """Events of each audit's latest processing version; audits without any version keep all events.

    The latest version is an aggregate joined back, not a window over the
    whole audit, so an audit with very many events is split like any other
    skewed join key.
    """
    latest = events.groupBy("audit_id").agg(F.max("processing_version").alias("latest"))
    return events.join(latest, "audit_id").filter(F.col("latest").isNull() | (F.col("processing_version") == F.col("latest"))).drop("latest")


def stage_diagnostics(events: DataFrame) -> DataFrame:
    """Per (audit, version, stage): event counts, durations, serial or fan-out path, first and last event."""
    rows = events.withColumn("stage", logical_stage(F.col("stage"))).withColumn("ms", rnd(F.when(F.col("event").isin(*TERMINAL_EVENTS), F.col("duration_ms")), 2))
    happened = lambda name: F.count_if(F.col("event") == name)
    stats = rows.groupBy("audit_id", "processing_version", "stage").agg(
        happened("dispatched").alias("dispatch_count"), happened("started").alias("started_count"), happened("completed").alias("completed_count"),
        happened("failed").alias("failed_count"), happened("aborted").alias("aborted_count"), stable_sum(F.col("ms"), 2).alias("total"),
        F.count("ms").alias("timed"), F.max("ms").alias("max_duration_ms"), F.min_by("created_at", "id").alias("first_event_at"),
        F.max_by("created_at", "id").alias("last_event_at"), F.max_by("event", "id").alias("latest_event"), F.count(F.lit(1)).alias("events"),
    )
    fan_out = F.col("stage").isin(*FAN_OUT_STAGES)
    return stats.select(
        "audit_id", "processing_version", "stage", "dispatch_count", "started_count", "completed_count", "failed_count", "aborted_count",
        (F.col("completed_count") + F.col("failed_count") + F.col("aborted_count")).alias("terminal_count"),
        rnd(F.col("total"), 2).alias("total_duration_ms"), rnd(F.col("total") / F.col("timed"), 2).alias("average_duration_ms"), "max_duration_ms",
        F.when(fan_out, "fan_out_max").otherwise("serial_sum").alias("critical_path_mode"),
        F.when(fan_out, F.col("max_duration_ms")).otherwise(rnd(F.col("total"), 2)).alias("critical_path_duration_ms"),
        "first_event_at", "last_event_at", "latest_event",
    )


def run_diagnostics(events: DataFrame, audits: DataFrame | None = None) -> DataFrame:
    """Per (audit, version): span, terminal stage and event, critical path over the stages, derived status."""
    stages = stage_diagnostics(events)
    path = stages.groupBy("audit_id", "processing_version").agg(
        rnd(stable_sum(F.col("critical_path_duration_ms"), 2), 2).alias("critical_path_duration_ms"),
        F.count("critical_path_duration_ms").alias("critical_path_stages"),
    )
    runs = events.groupBy("audit_id", "processing_version").agg(
        F.count(F.lit(1)).alias("event_count"), F.count_if(F.col("event") == "dispatched").alias("dispatch_count"),
        F.min_by("created_at", "id").alias("started_at"), F.max_by("created_at", "id").alias("finished_at"),
        F.max_by(F.struct("stage", "event", "final_status"), "id").alias("last"),
    )
    joined = runs.join(path.withColumnsRenamed({"audit_id": "p_audit", "processing_version": "p_version"}), (F.col("audit_id") == F.col("p_audit")) & F.col("processing_version").eqNullSafe(F.col("p_version")))
    fallback = F.lit("processing")
    if audits is not None:
        joined = joined.join(audits.select("audit_id", F.col("status").alias("audit_status")), "audit_id", "left")
        fallback = F.coalesce("audit_status", fallback)
    pipeline = F.col("last.stage") == "pipeline"
    status = (
        F.when(pipeline & (F.col("last.event") == "completed"), F.coalesce("last.final_status", fallback))
        .when(pipeline & F.col("last.event").isin("failed", "aborted"), "failed")
        .otherwise(fallback)
    )
    return joined.select(
        "audit_id", "processing_version", "event_count", "dispatch_count", "started_at", "finished_at",
        rnd(seconds_between(F.col("started_at"), F.col("finished_at")) * F.lit(1000.0), 2).alias("total_duration_ms"),
        logical_stage(F.col("last.stage")).alias("terminal_stage"), F.col("last.event").alias("terminal_event"),
        "critical_path_duration_ms", "critical_path_stages", status.alias("status"),
    )


def stage_status() -> Column:
    latest = F.col("latest_event")
    return (
        F.when((F.col("failed_count") > 0) | (latest == "failed"), "failed")
        .when((F.col("aborted_count") > 0) | (latest == "aborted"), "aborted")
        .when((F.col("completed_count") > 0) | (latest == "completed"), "completed")
        .when((F.col("started_count") > F.col("terminal_count")) | (latest == "started"), "running")
        .when((F.col("dispatch_count") > 0) | (latest == "dispatched"), "dispatched")
        .otherwise("pending")
    )


def fan_out_summary(stages: DataFrame) -> DataFrame:
    """First fan-out stage of each run with the work still in flight."""
    fan_out = stages.filter(F.col("stage").isin(*FAN_OUT_STAGES))
    first = fan_out.groupBy("audit_id", "processing_version").agg(
        F.min_by(F.struct("stage", "dispatch_count", "started_count", "terminal_count", "total_duration_ms", "max_duration_ms"), stage_position(F.col("stage"))).alias("s")
    ).select("audit_id", "processing_version", "s.*")
    return first.withColumn("in_flight_count", F.greatest(F.lit(0), F.col("started_count") - F.col("terminal_count")))


def score_distribution(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Size, mean, extremes, interpolated quartiles and low and high counts; scores are counted at 4 digits."""
    scores = rows.select(*keys, rnd(F.col("score"), 4).alias("s"))
    quartile = F.percentile("s", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = scores.groupBy(*keys).agg(
        F.count("s").alias("sample_size"), rnd(stable_mean(F.col("s"), 4), 4).alias("average"), F.min("s").alias("min"), F.max("s").alias("max"),
        quartile.alias("q"), F.count_if(F.col("s") < LOW_SCORE).alias("low_score_count"), F.count_if(F.col("s") >= HIGH_SCORE).alias("high_score_count"),
    )
    at = lambda i, name: rnd(F.col("q")[i], 4).alias(name)
    return stats.select(*keys, "sample_size", "average", "min", "max", at(0, "p25"), at(1, "p50"), at(2, "p75"), "low_score_count", "high_score_count")


def with_coverage(audits: DataFrame) -> DataFrame:
    """Found, analyzed and failed peers; the detail rows fill in where the summary is silent."""
    found = F.coalesce("found_summary", "detail_found")
    analyzed = F.coalesce("analyzed_summary", "detail_analyzed")
    return audits.withColumn("found", found).withColumn("analyzed", analyzed).withColumn(
        "failed", F.coalesce(F.col("failed_summary"), F.greatest(F.lit(0), F.col("found") - F.col("analyzed")))
    )


def competitor_coverage(audits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    totals = with_coverage(audits).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_size"), F.sum("found").alias("total_found"), F.sum("analyzed").alias("total_analyzed"), F.sum("failed").alias("total_failed")
    )
    per_run = lambda name: rnd(ratio(F.col(f"total_{name}"), F.col("sample_size"), None), 4).alias(f"average_{name}")
    return totals.select(
        "*", per_run("found"), per_run("analyzed"), per_run("failed"), rnd(ratio(F.col("total_analyzed"), F.col("total_found"), None), 4).alias("coverage_ratio")
    )


def recent_window(audits: DataFrame, now: str, days: int) -> DataFrame:
    """Audits of the last ``days`` days (1 to 365); a literal bound, so it reaches the scan."""
    held = min(max(days, 1), 365)
    return audits.filter(F.col("created_at") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {held} DAYS"))


def model_usage(audits: DataFrame, active_model: str | None = None) -> DataFrame:
    """Per model: audits, statuses, warnings, failures, scores and coverage; audits without model info are left out."""
    known = audits.filter(F.col("model_key").isNotNull())
    happened = lambda name: F.count_if(F.col("status") == name)
    warned = (F.col("status") == "completed_with_warnings") | (F.col("warning_messages") > 0)
    counts = known.groupBy("model_key").agg(
        F.count(F.lit(1)).alias("audit_count"), *[happened(s).alias(f"status_{s}") for s in ("queued", "processing", *TERMINAL_STATUSES)],
        F.count_if(warned).alias("warning_count"), F.sum("warning_messages").alias("warning_message_count"),
        happened("failed").alias("failure_count"), F.max("created_at").alias("last_audit_at"),
    )
    joined = counts.join(score_distribution(known, ["model_key"]), "model_key").join(
        competitor_coverage(known, ["model_key"]).drop("sample_size"), "model_key"
    )
    active = F.col("model_key") == active_model if active_model is not None else F.lit(False)
    return joined.withColumn("is_active_model", active)


def status_overview(audits: DataFrame, now: str) -> DataFrame:
    """Audits per status and active stage plus stuck and oldest figures as (metric, key, value) rows."""
    at = F.lit(now).cast("timestamp_ntz")
    processing = F.col("status") == "processing"
    totals = audits.groupBy().agg(
        F.count(F.lit(1)).cast("double").alias("total"),
        F.count_if(processing & (F.col("updated_at") < at - F.expr(f"INTERVAL {STALE_MINUTES} MINUTES"))).cast("double").alias("stuck"),
        F.min(F.when(F.col("status") == "queued", F.col("created_at"))).alias("queued_since"),
        F.min(F.when(processing, F.col("updated_at"))).alias("processing_since"),
    )
    age = lambda name: rnd(F.greatest(F.lit(0.0), seconds_between(F.col(name), at)), 2)
    entries = F.array(
        F.struct(F.lit("total").alias("metric"), F.lit("").alias("key"), F.col("total").alias("value")),
        F.struct(F.lit("stuck_processing_count").alias("metric"), F.lit("").alias("key"), F.col("stuck").alias("value")),
        F.struct(F.lit("oldest_queued_age_seconds").alias("metric"), F.lit("").alias("key"), age("queued_since").alias("value")),
        F.struct(F.lit("oldest_processing_update_age_seconds").alias("metric"), F.lit("").alias("key"), age("processing_since").alias("value")),
    )
    by = lambda rows, column, metric: rows.groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(metric).alias("metric"), "key", "value")
    return (
        totals.select(F.explode(entries).alias("e")).select("e.*")
        .unionByName(by(audits, "status", "by_status"))
        .unionByName(by(audits.filter(processing & F.col("orchestration_stage").isNotNull()), "orchestration_stage", "active_by_stage"))
    )


def recent_durations(audits: DataFrame, k: int = RECENT_RUNS) -> DataFrame:
    """Durations of the latest k finished runs (a top-k, then one aggregate)."""
    last = (
        audits.filter(F.col("status").isin(*TERMINAL_STATUSES) & F.col("updated_at").isNotNull())
        .select("id", "created_at", "updated_at").orderBy(F.desc("updated_at"), "id").limit(k)
    )
    ms = last.select(F.greatest(F.lit(0.0), rnd(seconds_between(F.col("created_at"), F.col("updated_at")) * F.lit(1000.0), 2)).alias("ms"))
    return ms.groupBy().agg(
        F.count(F.lit(1)).alias("sample_size"), rnd(stable_mean(F.col("ms"), 2), 2).alias("average_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms")
    )


def dispatch_waiting(audits: DataFrame, events: DataFrame, now: str, k: int = SAMPLE_LIMIT) -> DataFrame:
    """Processing runs whose latest event is an old dispatch; the k longest waiting."""
    latest = events.filter(F.col("processing_version").isNotNull()).groupBy("audit_id", "processing_version").agg(
        F.max_by(F.struct("event", "stage", "created_at"), "id").alias("last")
    )
    running = audits.filter((F.col("status") == "processing") & (F.col("processing_version") > 0)).select("audit_id", "processing_version", "orchestration_stage")
    waiting = running.join(latest, ["audit_id", "processing_version"]).filter(F.col("last.event") == "dispatched")
    aged = waiting.select(
        "audit_id", "processing_version", logical_stage(F.col("last.stage")).alias("dispatch_stage"), "orchestration_stage",
        rnd(F.greatest(F.lit(0.0), seconds_between(F.col("last.created_at"), F.lit(now).cast("timestamp_ntz"))), 2).alias("dispatch_age_seconds"),
    )
    return aged.filter(F.col("dispatch_age_seconds") >= DISPATCH_WAIT_SECONDS).orderBy(F.desc("dispatch_age_seconds"), "audit_id").limit(k)


def queue_pressure(queues: DataFrame, samples: DataFrame) -> DataFrame:
    """Pressure status of every queue from depth, workers and running tasks; queues without a sample are idle."""
    rows = queues.join(samples, "queue", "left")
    depth, workers, capacity = num("depth"), num("worker_count"), F.greatest(num("estimated_concurrency"), F.lit(1.0))
    inflight = F.coalesce(F.col("inflight_tasks").cast("double"), num("active_tasks") + num("reserved_tasks") + num("scheduled_tasks"))
    status = (
        F.when((depth == 0) & (inflight > 0), "busy").when(depth == 0, "idle")
        .when((workers == 0) & (inflight > 0), "draining").when(workers == 0, "stuck")
        .when((inflight == 0) & (depth > capacity), "backlogged").when(inflight == 0, "waiting")
        .when(depth > capacity * BACKLOG_FACTOR, "backlogged").otherwise("draining")
    )
    return rows.select(
        *[c for c in rows.columns if c not in ("depth", "worker_count", "inflight_tasks")], depth.cast("bigint").alias("depth"),
        workers.cast("bigint").alias("worker_count"), inflight.cast("bigint").alias("inflight_tasks"),
        F.greatest(num("estimated_concurrency") - num("active_tasks"), F.lit(0.0)).cast("bigint").alias("available_capacity"), status.alias("pressure_status"),
    )


def execution_alerts(overview: DataFrame, waiting: DataFrame, pressure: DataFrame) -> DataFrame:
    """Alerts from the status overview, waiting dispatches and queue pressure."""
    row = lambda code, severity, subject, value: [F.lit(code).alias("code"), F.lit(severity).alias("severity"), subject.alias("subject"), value.cast("double").alias("value")]
    none = F.lit(None).cast("string")
    stuck = overview.filter((F.col("metric") == "stuck_processing_count") & (F.col("value") > 0)).select(*row("stuck_processing_audits", "error", none, F.col("value")))
    queued = overview.filter((F.col("metric") == "oldest_queued_age_seconds") & (F.col("value") >= QUEUED_WAIT_SECONDS)).select(*row("queued_audits_waiting_too_long", "warning", none, F.col("value")))
    dispatched = waiting.groupBy().agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0).select(*row("dispatched_stages_waiting_too_long", "warning", none, F.col("n")))
    no_workers = pressure.filter(F.col("pressure_status") == "stuck").select(*row("queue_without_workers", "error", F.col("queue"), F.col("depth")))
    backlog = pressure.filter(F.col("pressure_status") == "backlogged").select(*row("queue_backlog_detected", "warning", F.col("queue"), F.col("depth")))
    return stuck.unionByName(queued).unionByName(dispatched).unionByName(no_workers).unionByName(backlog)


def load_summary(records: DataFrame, duration_seconds: float) -> DataFrame:
    """Admission rates, throughput per minute and latency percentiles of a load run."""
    admitted = lambda name: F.count_if(F.col("admission_status") == name)
    minutes = F.lit(duration_seconds / 60.0)
    ms = F.col("total_duration_ms").cast("double")
    terminal = F.col("terminal_status")
    stats = records.groupBy().agg(
        F.count(F.lit(1)).alias("requested"), admitted("accepted").alias("accepted"), admitted("rejected").alias("rejected"), admitted("error").alias("errors"),
        F.count_if(terminal.isin("completed", "completed_with_warnings")).alias("successful"),
        F.count_if(terminal.isin(*TERMINAL_STATUSES, "timeout")).alias("terminal"), F.count(ms).alias("latency_count"), rnd(F.min(ms), 2).alias("latency_min"),
        rnd(F.avg(ms), 2).alias("latency_average"), rnd(F.max(ms), 2).alias("latency_max"),
    )
    # percentiles of the latencies as they are stored, over ranges of them and not in one state
    levels = order.quantiles(records.select(ms.alias("ms")), [], "ms", {"p50": 0.5, "p95": 0.95})
    stats = stats.join(F.broadcast(levels), F.lit(True), "left")
    return stats.select(
        "requested", "accepted", "rejected", "errors", rnd(ratio(F.col("accepted"), F.col("requested"), None), 4).alias("acceptance_rate"),
        rnd(ratio(F.col("rejected"), F.col("requested"), None), 4).alias("rejection_rate"), rnd(F.col("accepted") / minutes, 2).alias("accepted_per_minute"),
        rnd(F.col("terminal") / minutes, 2).alias("terminal_per_minute"), rnd(F.col("successful") / minutes, 2).alias("successful_terminal_per_minute"),
        "latency_count", "latency_min", "latency_average", rnd(F.col("p50"), 2).alias("latency_p50"), rnd(F.col("p95"), 2).alias("latency_p95"), "latency_max",
    )


def backlog_summary(samples: DataFrame) -> DataFrame:
    """Per queue: deepest backlog and counts per pressure status over all samples (map of queues exploded)."""
    queues = samples.select("sample_id", F.explode("queues").alias("queue", "s"))
    return queues.groupBy("queue", F.coalesce("s.pressure_status", F.lit("unknown")).alias("pressure_status")).agg(
        F.count(F.lit(1)).alias("samples"), F.max("s.depth").alias("max_depth")
    )


def backlog_totals(samples: DataFrame) -> DataFrame:
    depth = F.aggregate(F.map_values("queues"), F.lit(0).cast("bigint"), lambda acc, s: acc + s["depth"])
    bad = lambda name: F.size(F.filter(F.map_values("queues"), lambda s: s["pressure_status"] == name))
    per_sample = samples.select(depth.alias("total_depth"), bad("backlogged").alias("backlogged"), bad("stuck").alias("stuck"))
    return per_sample.groupBy().agg(
        F.count(F.lit(1)).alias("samples"), rnd(F.avg("total_depth"), 2).alias("average_total_depth"), F.max("total_depth").alias("max_total_depth"),
        rnd(F.count_if((F.col("backlogged") > 0) | (F.col("stuck") > 0)) / F.count(F.lit(1)), 4).alias("degraded_sample_ratio"),
        F.max("backlogged").alias("max_backlogged_queue_count"), F.max("stuck").alias("max_stuck_queue_count"),
    )


def sample_workers(samples: DataFrame) -> DataFrame:
    """One row per worker of samples that list their workers in an array."""
    return samples.select("sample_id", F.explode("workers").alias("w")).select("sample_id", "w.profile", "w.active_tasks", "w.concurrency")


def worker_utilization(workers: DataFrame) -> DataFrame:
    """Mean and peak utilisation overall and per profile, from one row per sample and worker: per sample first, then over samples."""
    named = workers.select("sample_id", F.coalesce("profile", F.lit("unassigned")).alias("profile"), "active_tasks", "concurrency")
    per_sample = named.rollup("sample_id", "profile").agg(
        F.grouping_id().alias("gid"), F.sum("active_tasks").alias("active"), F.sum("concurrency").alias("capacity")
    ).filter(F.col("gid") <= 1)
    scoped = per_sample.select(F.when(F.col("gid") == 1, "overall").otherwise(F.concat(F.lit("profile:"), "profile")).alias("scope"), "active", "capacity")
    used = ratio(F.col("active"), F.col("capacity"), None)
    return scoped.groupBy("scope").agg(
        F.count(F.lit(1)).alias("sample_count"), rnd(F.avg("active"), 2).alias("average_active_tasks"), rnd(F.avg("capacity"), 2).alias("average_estimated_concurrency"),
        rnd(F.avg(used), 2).alias("average_active_utilization_ratio"), rnd(F.coalesce(F.max(used), F.lit(0.0)), 2).alias("peak_active_utilization_ratio"),
    )


def alert_counts(samples: DataFrame) -> DataFrame:
    """Alerts per code over all samples."""
    codes = samples.select(F.explode("alerts").alias("code")).groupBy(F.coalesce("code", F.lit("unknown")).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    total = samples.groupBy().agg(F.count_if(F.size("alerts") > 0).alias("n")).select(F.lit("samples_with_alerts").alias("code"), "n")
    return codes.unionByName(total)


def history_flags(audits: DataFrame, hidden: DataFrame, now: str) -> DataFrame:
    """Successful, stale, problematic and hidden flags per run."""
    at = F.lit(now).cast("timestamp_ntz")
    joined = audits.join(hidden.select("id").distinct().withColumn("_hidden", F.lit(True)), "id", "left")
    stale = F.col("status").isin("queued", "processing") & (F.col("created_at") <= at) & (
        seconds_between(F.col("created_at"), at) >= F.lit(STALE_MINUTES * 60.0)
    )
    complete = F.coalesce(F.coalesce("analyzed_summary", F.lit(0)) >= F.coalesce("requested_top_n", "found_summary"), F.lit(False))
    warned = (F.col("status") == "completed_with_warnings") & ~complete
    return joined.select(
        *audits.columns, F.coalesce("_hidden", F.lit(False)).alias("is_hidden"), F.col("status").isin("completed", "completed_with_warnings").alias("is_successful"),
        F.coalesce(stale, F.lit(False)).alias("is_stale"), ((F.col("status") == "failed") | warned | F.coalesce(stale, F.lit(False))).alias("is_problematic"),
    )


def history_filter(flagged: DataFrame, status: str = "all", domain: str = "", search: str = "", focus: str = "all") -> DataFrame:
    focuses = {
        "all": ~F.col("is_hidden"), "successful": ~F.col("is_hidden") & F.col("is_successful"), "problematic": ~F.col("is_hidden") & F.col("is_problematic"),
        "stale": ~F.col("is_hidden") & F.col("is_stale"), "hidden": F.col("is_hidden"),
    }
    condition = focuses.get(focus, focuses["all"])
    if status != "all":
        condition = condition & (F.col("status") == status)
    if domain.strip():
        condition = condition & F.lower(F.trim("domain")).contains(domain.strip().lower())
    if search.strip():
        condition = condition & F.lower(F.concat_ws(" ", "query", "domain", "target_url")).contains(search.strip().lower())
    return flagged.filter(condition)


def history_totals(flagged: DataFrame, filtered: DataFrame) -> DataFrame:
    shown = ~F.col("is_hidden")
    totals = flagged.groupBy().agg(
        F.count(F.lit(1)).alias("total"), F.count_if(shown).alias("visible"), F.count_if(shown & F.col("is_successful")).alias("successful"),
        F.count_if(shown & F.col("is_problematic")).alias("problematic"), F.count_if(shown & F.col("is_stale")).alias("stale"), F.count_if("is_hidden").alias("hidden"),
    )
    return totals.join(F.broadcast(filtered.groupBy().agg(F.count(F.lit(1)).alias("filtered"))), F.lit(True))


def transition_violations(log: DataFrame, bucket_size: int = 10000) -> DataFrame:
    """Status changes the state table does not allow, per run in id order.

    ``lag`` runs inside id buckets, so a run with very many rows is spread
    over its buckets; the first row of a bucket gets its predecessor from the
    last row of the previous bucket, taken from a table with one row per
    (run, bucket).
    """
    rows = log.withColumn("_bucket", F.floor(F.col("id") / bucket_size))
    inside = Window.partitionBy("audit_id", "_bucket").orderBy("id")
    ends = rows.groupBy("audit_id", "_bucket").agg(F.max_by("status", "id").alias("_end"))
    carried = ends.select("audit_id", "_bucket", F.lag("_end").over(Window.partitionBy("audit_id").orderBy("_bucket")).alias("_carry"))
    lagged = rows.withColumn("_prev", F.lag("status").over(inside)).join(carried, ["audit_id", "_bucket"])
    pairs = lagged.select("audit_id", "id", F.coalesce("_prev", "_carry").alias("from_status"), F.col("status").alias("to_status"))
    allowed = reduce(
        lambda a, b: a | b, [(F.col("from_status") == a) & (F.col("to_status") == b) for a, b in TRANSITIONS], F.col("from_status") == F.col("to_status")
    )
    return pairs.filter(F.col("from_status").isNotNull() & ~allowed)
