"""Event-log and run-history queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import history
from rankloom.plans.oracle_text import big, mean, rnd
from rankloom.plans.registry import Catalog
from rankloom.sources.views import load_view, view_cte

CATALOG = Catalog()

_NOW = "2024-02-15 12:00:00"
_RUNS_NOW = "1998-12-01 00:00:00"
_E = view_cte("v_events")
_STAGE_SQL = "CASE stage WHEN 'app.process_audit_fetch_target' THEN 'fetch' ELSE stage END"
_LATEST = "lv AS (SELECT * FROM (SELECT *, max(processing_version) OVER (PARTITION BY audit_id) AS latest FROM v_events) WHERE latest IS NULL OR processing_version = latest)"
_TERMINAL = "event IN ('completed', 'failed', 'aborted')"
_STAGES = f"""
ev AS (SELECT * REPLACE ({_STAGE_SQL} AS stage), stage AS raw_stage, CASE WHEN {_TERMINAL} THEN {rnd('duration_ms', 2)} END AS ms FROM lv),
sg AS (SELECT audit_id, processing_version, stage, {big("count(*) FILTER (event = 'dispatched')")} AS dispatch_count, {big("count(*) FILTER (event = 'started')")} AS started_count,
  {big("count(*) FILTER (event = 'completed')")} AS completed_count, {big("count(*) FILTER (event = 'failed')")} AS failed_count, {big("count(*) FILTER (event = 'aborted')")} AS aborted_count,
  {big(f"count(*) FILTER ({_TERMINAL})")} AS terminal_count, {rnd('sum(round_even(ms * 1e2, 0)) / 1e2', 2)} AS total_duration_ms, {rnd(mean('ms', 2), 2)} AS average_duration_ms, max(ms) AS max_duration_ms,
  CASE WHEN stage IN ('competitor_page', 'competitor_analysis') THEN 'fan_out_max' ELSE 'serial_sum' END AS critical_path_mode,
  CASE WHEN stage IN ('competitor_page', 'competitor_analysis') THEN max(ms) ELSE {rnd('sum(round_even(ms * 1e2, 0)) / 1e2', 2)} END AS critical_path_duration_ms,
  arg_min(created_at, id) AS first_event_at, arg_max(created_at, id) AS last_event_at, arg_max(event, id) AS latest_event FROM ev GROUP BY audit_id, processing_version, stage)"""


def _latest(spark: SparkSession, folder: str) -> DataFrame:
    return history.latest_version_events(load_view(spark, folder, "v_events"))


@CATALOG.query("latest_version_events", _E + "," + _LATEST + " SELECT id, audit_id, processing_version, stage, event FROM lv")
def latest_version_events(spark: SparkSession, folder: str) -> DataFrame:
    return _latest(spark, folder).select("id", "audit_id", "processing_version", "stage", "event")


@CATALOG.query("stage_diagnostics", _E + "," + _LATEST + "," + _STAGES + " SELECT * FROM sg")
def stage_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    return history.stage_diagnostics(_latest(spark, folder))


_RUNS = f"""
rn AS (SELECT audit_id, processing_version, {big('count(*)')} AS event_count, {big("count(*) FILTER (event = 'dispatched')")} AS dispatch_count, arg_min(created_at, id) AS started_at, arg_max(created_at, id) AS finished_at,
  arg_max(stage, id) AS ls, arg_max(raw_stage, id) AS lraw, arg_max(event, id) AS le, max(id) AS lid FROM ev GROUP BY audit_id, processing_version),
cp AS (SELECT audit_id, processing_version, {rnd('sum(round_even(critical_path_duration_ms * 1e2, 0)) / 1e2', 2)} AS critical_path_duration_ms, {big('count(critical_path_duration_ms)')} AS critical_path_stages FROM sg GROUP BY ALL),
rd AS (SELECT rn.audit_id, rn.processing_version, event_count, dispatch_count, started_at, finished_at, {rnd('date_diff(\'microsecond\', started_at, finished_at) / 1e6 * 1e3', 2)} AS total_duration_ms, ls AS terminal_stage, le AS terminal_event,
  critical_path_duration_ms, critical_path_stages, CASE WHEN lraw = 'pipeline' AND le = 'completed' THEN coalesce((SELECT final_status FROM v_events z WHERE z.id = rn.lid), 'processing')
    WHEN lraw = 'pipeline' AND le IN ('failed', 'aborted') THEN 'failed' ELSE 'processing' END AS status FROM rn JOIN cp ON rn.audit_id = cp.audit_id AND rn.processing_version IS NOT DISTINCT FROM cp.processing_version)"""


@CATALOG.query("run_diagnostics", _E + "," + _LATEST + "," + _STAGES + "," + _RUNS + " SELECT * FROM rd")
def run_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    return history.run_diagnostics(_latest(spark, folder))


@CATALOG.query("stage_status", _E + "," + _LATEST + "," + _STAGES + """ SELECT audit_id, processing_version, stage, CASE WHEN failed_count > 0 OR latest_event = 'failed' THEN 'failed'
  WHEN aborted_count > 0 THEN 'aborted' WHEN completed_count > 0 THEN 'completed' WHEN started_count > terminal_count OR latest_event = 'started' THEN 'running' WHEN dispatch_count > 0 THEN 'dispatched' ELSE 'pending' END AS status FROM sg""")
def stage_status(spark: SparkSession, folder: str) -> DataFrame:
    return history.stage_diagnostics(_latest(spark, folder)).select("audit_id", "processing_version", "stage", history.stage_status().alias("status"))


@CATALOG.query("fan_out_summary", _E + "," + _LATEST + "," + _STAGES + f""" SELECT audit_id, processing_version, stage, dispatch_count, started_count, terminal_count, total_duration_ms, max_duration_ms, greatest(0, started_count - terminal_count) AS in_flight_count
  FROM sg WHERE stage IN ('competitor_page', 'competitor_analysis') QUALIFY row_number() OVER (PARTITION BY audit_id, processing_version ORDER BY CASE stage WHEN 'competitor_page' THEN 0 ELSE 1 END) = 1""")
def fan_out_summary(spark: SparkSession, folder: str) -> DataFrame:
    return history.fan_out_summary(history.stage_diagnostics(_latest(spark, folder)))


_A = view_cte("v_audits")


def _audits(spark: SparkSession, folder: str) -> DataFrame:
    return load_view(spark, folder, "v_audits").withColumn("updated_at", F.expr("created_at + make_dt_interval(0, 0, CAST(updated_minutes AS INT), 0)"))


_AUD = _A + ", au AS (SELECT *, created_at + updated_minutes * INTERVAL 1 MINUTE AS updated_at FROM v_audits)"


@CATALOG.query("scan_audits", _AUD + f" SELECT id, status, created_at FROM au WHERE created_at >= TIMESTAMP '1998-06-01 00:00:00' ORDER BY created_at DESC, id LIMIT 200")
def scan_audits(spark: SparkSession, folder: str) -> DataFrame:
    from rankloom.sources.scans import recent_audits

    return recent_audits(_audits(spark, folder), "1998-06-01 00:00:00", 200).select("id", "status", "created_at")


def _dist_sql(source: str, key: str) -> str:
    head, tail = (f"{key}, ", f" GROUP BY {key}") if key else ("", "")
    return f"""(SELECT {head}{big('count(s)')} AS sample_size, {rnd(mean('s', 4), 4)} AS average, min(s) AS min, max(s) AS max, {rnd('quantile_cont(s, 25e-2)', 4)} AS p25, {rnd('quantile_cont(s, 5e-1)', 4)} AS p50,
  {rnd('quantile_cont(s, 75e-2)', 4)} AS p75, {big('count(*) FILTER (s < 50)')} AS low_score_count, {big('count(*) FILTER (s >= 80)')} AS high_score_count FROM {source}{tail})"""


def _cov_sql(source: str, key: str) -> str:
    head, tail = (f"{key}, ", f" GROUP BY {key}") if key else ("", "")
    return f"""(SELECT *, {rnd('total_found * 1e0 / sample_size', 4)} AS average_found, {rnd('total_analyzed * 1e0 / sample_size', 4)} AS average_analyzed, {rnd('total_failed * 1e0 / sample_size', 4)} AS average_failed,
  {rnd('total_analyzed * 1e0 / nullif(total_found, 0)', 4)} AS coverage_ratio FROM (SELECT {head}{big('count(*)')} AS sample_size, {big('sum(fo)')} AS total_found, {big('sum(an)')} AS total_analyzed,
  {big('sum(coalesce(failed_summary, greatest(0, fo - an)))')} AS total_failed FROM {source}{tail}))"""


_SCORED = f"sc AS (SELECT *, {rnd('score', 4)} AS s, coalesce(found_summary, detail_found) AS fo, coalesce(analyzed_summary, detail_analyzed) AS an FROM au)"


@CATALOG.query("score_distribution", _AUD + "," + _SCORED + f" SELECT * FROM {_dist_sql('sc', '')}")
def score_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return history.score_distribution(_audits(spark, folder))


@CATALOG.query("competitor_coverage", _AUD + "," + _SCORED + f" SELECT * FROM {_cov_sql('sc', 'domain')}")
def competitor_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return history.competitor_coverage(_audits(spark, folder), ["domain"])


@CATALOG.query("model_usage", _AUD + "," + _SCORED.replace("FROM au", f"FROM au WHERE created_at >= TIMESTAMP '{_RUNS_NOW}' - INTERVAL 120 DAY AND model_key IS NOT NULL") + f""",
us AS (SELECT model_key, {big('count(*)')} AS audit_count, {', '.join(big(f"count(*) FILTER (status = '{s}')") + f' AS status_{s}' for s in ('queued', 'processing', *history.TERMINAL_STATUSES))},
  {big("count(*) FILTER (status = 'completed_with_warnings' OR warning_messages > 0)")} AS warning_count, {big('sum(warning_messages)')} AS warning_message_count, {big("count(*) FILTER (status = 'failed')")} AS failure_count, max(created_at) AS last_audit_at FROM sc GROUP BY model_key)
SELECT us.*, d.* EXCLUDE (model_key), c.* EXCLUDE (model_key, sample_size), us.model_key = '2-HIGH' AS is_active_model FROM us JOIN {_dist_sql('sc', 'model_key')} d ON us.model_key = d.model_key JOIN {_cov_sql('sc', 'model_key')} c ON us.model_key = c.model_key""")
def model_usage(spark: SparkSession, folder: str) -> DataFrame:
    return history.model_usage(history.recent_window(_audits(spark, folder), _RUNS_NOW, 120), "2-HIGH")


_OVER = f"""
tt AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (status = 'processing' AND updated_at < TIMESTAMP '{_RUNS_NOW}' - INTERVAL 15 MINUTE) AS DOUBLE) AS st, min(created_at) FILTER (status = 'queued') AS q, min(updated_at) FILTER (status = 'processing') AS p FROM au),
ov AS (SELECT 'total' AS metric, '' AS key, n AS value FROM tt UNION ALL SELECT 'stuck_processing_count', '', st FROM tt
UNION ALL SELECT 'oldest_queued_age_seconds', '', greatest(0e0, date_diff('microsecond', q, TIMESTAMP '{_RUNS_NOW}') / 1e6) FROM tt
UNION ALL SELECT 'oldest_processing_update_age_seconds', '', greatest(0e0, date_diff('microsecond', p, TIMESTAMP '{_RUNS_NOW}') / 1e6) FROM tt
UNION ALL SELECT 'by_status', status, CAST(count(*) AS DOUBLE) FROM au GROUP BY status
UNION ALL SELECT 'active_by_stage', orchestration_stage, CAST(count(*) AS DOUBLE) FROM au WHERE status = 'processing' AND orchestration_stage IS NOT NULL GROUP BY orchestration_stage)"""


@CATALOG.query("status_overview", _AUD + "," + _OVER + " SELECT * FROM ov")
def status_overview(spark: SparkSession, folder: str) -> DataFrame:
    return history.status_overview(_audits(spark, folder), _RUNS_NOW)


@CATALOG.query("recent_durations", _AUD + f""", l AS (SELECT greatest(0e0, {rnd("date_diff('microsecond', created_at, updated_at) / 1e6 * 1e3", 2)}) AS ms FROM au WHERE status IN {history.TERMINAL_STATUSES!r} ORDER BY updated_at DESC, id LIMIT 50)
SELECT {big('count(*)')} AS sample_size, {rnd(mean('ms', 2), 2)} AS average_ms, min(ms) AS min_ms, max(ms) AS max_ms FROM l""")
def recent_durations(spark: SparkSession, folder: str) -> DataFrame:
    return history.recent_durations(_audits(spark, folder))


_RUN_AUDITS = "SELECT user_id AS audit_id, CASE WHEN user_id % 3 = 0 THEN 'completed' ELSE 'processing' END AS status, 2 AS processing_version, 'scoring' AS orchestration_stage FROM (SELECT DISTINCT user_id FROM events)"
_WAIT = f"""
ra AS ({_RUN_AUDITS}), la AS (SELECT audit_id, processing_version, arg_max(event, id) AS e, arg_max({_STAGE_SQL}, id) AS s, arg_max(created_at, id) AS t FROM v_events WHERE processing_version IS NOT NULL GROUP BY ALL),
wt AS (SELECT ra.audit_id, ra.processing_version, s AS dispatch_stage, orchestration_stage, {rnd(f"greatest(0e0, date_diff('microsecond', t, TIMESTAMP '{_NOW}') / 1e6)", 2)} AS dispatch_age_seconds FROM ra JOIN la ON ra.audit_id = la.audit_id AND ra.processing_version = la.processing_version WHERE status = 'processing' AND e = 'dispatched'),
wk AS (SELECT * FROM wt WHERE dispatch_age_seconds >= 180 ORDER BY dispatch_age_seconds DESC, audit_id LIMIT 10)"""


def _waiting(spark: SparkSession, folder: str) -> DataFrame:
    events = load_view(spark, folder, "v_events")
    runs = events.select("audit_id").distinct().select(
        "audit_id", F.when(F.col("audit_id") % 3 == 0, "completed").otherwise("processing").alias("status"),
        F.lit(2).alias("processing_version"), F.lit("scoring").alias("orchestration_stage"),
    )
    return history.dispatch_waiting(runs, events, _NOW)


@CATALOG.query("dispatch_waiting", _E + "," + _WAIT + " SELECT * FROM wk")
def dispatch_waiting(spark: SparkSession, folder: str) -> DataFrame:
    return _waiting(spark, folder)


# A stage plays the queue; event counts of the log give its depth, workers and running tasks.
_PRESS = f"""
qs AS (SELECT {_STAGE_SQL} AS queue, count(*) FILTER (event = 'dispatched' AND id % 40 = 0) AS depth, count(DISTINCT audit_id) FILTER (audit_id % 50 = 1 AND stage <> 'scoring') AS worker_count,
  count(*) FILTER (event = 'started' AND id % 90 = 0) AS active_tasks, 0 AS reserved_tasks, count(*) FILTER (event = 'aborted' AND id % 200 = 0) AS scheduled_tasks FROM v_events WHERE stage <> 'finalize' GROUP BY 1),
qd AS (SELECT DISTINCT {_STAGE_SQL} AS queue FROM v_events),
pr AS (SELECT qd.queue, coalesce(depth, 0) AS depth, coalesce(worker_count, 0) AS workers, coalesce(active_tasks, 0) + coalesce(scheduled_tasks, 0) AS inflight, greatest(coalesce(worker_count, 0) - coalesce(active_tasks, 0), 0) AS cap, greatest(coalesce(worker_count, 0), 1) AS conc FROM qd LEFT JOIN qs USING (queue)),
ps AS (SELECT queue, {big('depth')} AS depth, {big('workers')} AS worker_count, {big('inflight')} AS inflight_tasks, {big('cap')} AS available_capacity, CASE WHEN depth = 0 AND inflight > 0 THEN 'busy' WHEN depth = 0 THEN 'idle' WHEN workers = 0 AND inflight > 0 THEN 'draining' WHEN workers = 0 THEN 'stuck'
  WHEN inflight = 0 AND depth > conc THEN 'backlogged' WHEN inflight = 0 THEN 'waiting' WHEN depth > conc * 3 THEN 'backlogged' ELSE 'draining' END AS pressure_status FROM pr)"""


def _pressure(spark: SparkSession, folder: str) -> DataFrame:
    events = load_view(spark, folder, "v_events").withColumn("queue", history.logical_stage(F.col("stage")))
    samples = events.filter(F.col("stage") != "finalize").groupBy("queue").agg(
        F.count_if((F.col("event") == "dispatched") & (F.col("id") % 40 == 0)).alias("depth"),
        F.countDistinct(F.when((F.col("audit_id") % 50 == 1) & (F.col("stage") != "scoring"), F.col("audit_id"))).alias("worker_count"),
        F.count_if((F.col("event") == "started") & (F.col("id") % 90 == 0)).alias("active_tasks"), F.lit(0).alias("reserved_tasks"),
        F.count_if((F.col("event") == "aborted") & (F.col("id") % 200 == 0)).alias("scheduled_tasks"),
    ).withColumn("estimated_concurrency", F.col("worker_count")).withColumn("inflight_tasks", F.lit(None).cast("bigint"))
    return history.queue_pressure(events.select("queue").distinct(), samples)


@CATALOG.query("queue_pressure", _E + "," + _PRESS + " SELECT * FROM ps")
def queue_pressure(spark: SparkSession, folder: str) -> DataFrame:
    return _pressure(spark, folder).select("queue", "depth", "worker_count", "inflight_tasks", "available_capacity", "pressure_status")


@CATALOG.query("execution_alerts", _AUD + "," + _OVER + "," + view_cte("v_events")[5:] + "," + _WAIT + "," + _PRESS + f"""
SELECT 'stuck_processing_audits' AS code, 'error' AS severity, CAST(NULL AS VARCHAR) AS subject, value FROM ov WHERE metric = 'stuck_processing_count' AND value > 0
UNION ALL SELECT 'queued_audits_waiting_too_long', 'warning', NULL, value FROM ov WHERE metric = 'oldest_queued_age_seconds' AND value >= 300
UNION ALL SELECT 'dispatched_stages_waiting_too_long', 'warning', NULL, CAST(count(*) AS DOUBLE) FROM wk HAVING count(*) > 0
UNION ALL SELECT 'queue_without_workers', 'error', queue, CAST(depth AS DOUBLE) FROM ps WHERE pressure_status = 'stuck'
UNION ALL SELECT 'queue_backlog_detected', 'warning', queue, CAST(depth AS DOUBLE) FROM ps WHERE pressure_status = 'backlogged'""")
def execution_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return history.execution_alerts(history.status_overview(_audits(spark, folder), _RUNS_NOW), _waiting(spark, folder), _pressure(spark, folder))


_LOAD = "CASE WHEN id % 13 = 0 THEN 'rejected' WHEN id % 29 = 0 THEN 'error' ELSE 'accepted' END"


@CATALOG.query("load_summary", _AUD + f""", r AS (SELECT {_LOAD} AS a, CASE WHEN {_LOAD} = 'accepted' THEN CASE WHEN status IN ('queued', 'processing') THEN 'timeout' ELSE status END END AS t, CASE WHEN {_LOAD} = 'accepted' THEN score * 37e0 END AS ms FROM au),
s AS (SELECT count(*) AS n, count(*) FILTER (a = 'accepted') AS ac, count(*) FILTER (a = 'rejected') AS re, count(*) FILTER (a = 'error') AS er, count(*) FILTER (t IN ('completed', 'completed_with_warnings')) AS su, count(t) AS te FROM r)
SELECT {big('n')} AS requested, {big('ac')} AS accepted, {big('re')} AS rejected, {big('er')} AS errors, {rnd('ac * 1e0 / n', 4)} AS acceptance_rate, {rnd('re * 1e0 / n', 4)} AS rejection_rate, {rnd('ac / 6e1', 2)} AS accepted_per_minute,
  {rnd('te / 6e1', 2)} AS terminal_per_minute, {rnd('su / 6e1', 2)} AS successful_terminal_per_minute, {big('(SELECT count(ms) FROM r)')} AS latency_count, (SELECT {rnd('min(ms)', 2)} FROM r) AS latency_min, (SELECT {rnd('avg(ms)', 2)} FROM r) AS latency_average,
  (SELECT {rnd('quantile_cont(ms, 5e-1)', 2)} FROM r) AS latency_p50, (SELECT {rnd('quantile_cont(ms, 95e-2)', 2)} FROM r) AS latency_p95, (SELECT {rnd('max(ms)', 2)} FROM r) AS latency_max FROM s""")
def load_summary(spark: SparkSession, folder: str) -> DataFrame:
    accepted = F.expr(_LOAD) == "accepted"
    records = _audits(spark, folder).select(
        F.expr(_LOAD).alias("admission_status"),
        F.when(accepted, F.when(F.col("status").isin("queued", "processing"), "timeout").otherwise(F.col("status"))).alias("terminal_status"),
        F.when(accepted, F.col("score") * F.lit(37.0)).alias("total_duration_ms"),
    )
    return history.load_summary(records, 3600.0)


# An hour of the log plays one runtime sample: stages are queues, users are workers.
_SAMPLES = f"""
sq AS (SELECT date_trunc('hour', created_at) AS sample_id, {_STAGE_SQL} AS queue, count(*) AS depth, count(*) FILTER (event = 'started') AS st, count(*) FILTER (event = 'failed') AS fa FROM v_events GROUP BY ALL),
sp AS (SELECT *, CASE WHEN fa > 0 AND st = 0 THEN 'stuck' WHEN depth >= 3 THEN 'backlogged' WHEN st > 0 THEN 'draining' ELSE 'waiting' END AS pressure_status FROM sq)"""


def _hours(spark: SparkSession, folder: str) -> DataFrame:
    return load_view(spark, folder, "v_events").withColumn("sample_id", F.date_trunc("hour", "created_at")).withColumn("queue", history.logical_stage(F.col("stage")))


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    events = _hours(spark, folder)
    per_queue = events.groupBy("sample_id", "queue").agg(
        F.count(F.lit(1)).alias("depth"), F.count_if(F.col("event") == "started").alias("st"), F.count_if(F.col("event") == "failed").alias("fa")
    )
    status = F.when((F.col("fa") > 0) & (F.col("st") == 0), "stuck").when(F.col("depth") >= 3, "backlogged").when(F.col("st") > 0, "draining").otherwise("waiting")
    return per_queue.groupBy("sample_id").agg(
        F.map_from_entries(F.collect_list(F.struct("queue", F.struct(F.col("depth"), status.alias("pressure_status"))))).alias("queues"),
        F.flatten(F.collect_list(F.when(F.col("fa") > 1, F.array(F.lit("failures"), F.col("queue"))).otherwise(F.array().cast("array<string>")))).alias("alerts"),
    )


def _workers(spark: SparkSession, folder: str) -> DataFrame:
    workers = _hours(spark, folder).groupBy("sample_id", "audit_id").agg(F.count_if(F.col("event") == "started").alias("active_tasks"), F.count_if(F.col("event") != "dispatched").alias("concurrency"))
    return workers.withColumn("profile", F.when(F.col("audit_id") % 4 > 0, F.concat(F.lit("p"), (F.col("audit_id") % 4).cast("string"))))


@CATALOG.query("backlog_summary", _E + "," + _SAMPLES + f" SELECT queue, pressure_status, {big('count(*)')} AS samples, {big('max(depth)')} AS max_depth FROM sp GROUP BY ALL")
def backlog_summary(spark: SparkSession, folder: str) -> DataFrame:
    return history.backlog_summary(_samples(spark, folder))


@CATALOG.query("backlog_totals", _E + "," + _SAMPLES + f""", z AS (SELECT sample_id, sum(depth) AS d, count(*) FILTER (pressure_status = 'backlogged') AS b, count(*) FILTER (pressure_status = 'stuck') AS s FROM sp GROUP BY sample_id)
SELECT {big('count(*)')} AS samples, {rnd('avg(d)', 2)} AS average_total_depth, {big('max(d)')} AS max_total_depth, {rnd('count(*) FILTER (b > 0 OR s > 0) * 1e0 / count(*)', 4)} AS degraded_sample_ratio, CAST(max(b) AS INT) AS max_backlogged_queue_count, CAST(max(s) AS INT) AS max_stuck_queue_count FROM z""")
def backlog_totals(spark: SparkSession, folder: str) -> DataFrame:
    return history.backlog_totals(_samples(spark, folder))


@CATALOG.query("worker_utilization", _E + f""", w AS (SELECT date_trunc('hour', created_at) AS sample_id, audit_id, count(*) FILTER (event = 'started') AS a, count(*) FILTER (event <> 'dispatched') AS c FROM v_events GROUP BY ALL),
p AS (SELECT sample_id, CASE WHEN audit_id % 4 > 0 THEN 'profile:p' || (audit_id % 4) ELSE 'profile:unassigned' END AS scope, sum(a) AS a, sum(c) AS c FROM w GROUP BY ALL UNION ALL SELECT sample_id, 'overall', sum(a), sum(c) FROM w GROUP BY ALL)
SELECT scope, {big('count(*)')} AS sample_count, {rnd('avg(a)', 2)} AS average_active_tasks, {rnd('avg(c)', 2)} AS average_estimated_concurrency, {rnd('avg(a * 1e0 / nullif(c, 0))', 2)} AS average_active_utilization_ratio, {rnd('coalesce(max(a * 1e0 / nullif(c, 0)), 0e0)', 2)} AS peak_active_utilization_ratio FROM p GROUP BY scope""")
def worker_utilization(spark: SparkSession, folder: str) -> DataFrame:
    return history.worker_utilization(_workers(spark, folder))


@CATALOG.query("alert_counts", _E + "," + _SAMPLES + f""" SELECT 'failures' AS code, {big('count(*)')} AS n FROM sp WHERE fa > 1 UNION ALL SELECT queue, {big('count(*)')} FROM sp WHERE fa > 1 GROUP BY queue
UNION ALL SELECT 'samples_with_alerts', {big('count(DISTINCT sample_id)')} FROM sp WHERE fa > 1""")
def alert_counts(spark: SparkSession, folder: str) -> DataFrame:
    return history.alert_counts(_samples(spark, folder))


_FLAGS = f"""
fg AS (SELECT *, id % 7 = 0 AS is_hidden, status IN ('completed', 'completed_with_warnings') AS ok, status IN ('queued', 'processing') AND created_at <= TIMESTAMP '{_RUNS_NOW}' AND date_diff('microsecond', created_at, TIMESTAMP '{_RUNS_NOW}') / 1e6 >= 900 AS stale,
  status = 'completed_with_warnings' AND NOT coalesce(coalesce(analyzed_summary, 0) >= coalesce(requested_top_n, found_summary), FALSE) AS warned FROM au),
fp AS (SELECT *, status = 'failed' OR warned OR stale AS bad FROM fg)"""


def _flagged(spark: SparkSession, folder: str) -> DataFrame:
    audits = _audits(spark, folder)
    return history.history_flags(audits, audits.filter(F.col("id") % 7 == 0), _RUNS_NOW)


@CATALOG.query("history_view", _AUD + "," + _FLAGS + " SELECT id, is_hidden, ok AS is_successful, stale AS is_stale, bad AS is_problematic FROM fp WHERE NOT is_hidden AND bad AND contains(domain, 'machin') AND contains(lower(query || ' ' || domain || ' ' || target_url), 'query 1')")
def history_view(spark: SparkSession, folder: str) -> DataFrame:
    rows = history.history_filter(_flagged(spark, folder), domain=" MACHIN", search="Query 1", focus="problematic")
    return rows.select("id", "is_hidden", "is_successful", "is_stale", "is_problematic")


@CATALOG.query("history_totals", _AUD + "," + _FLAGS + f""" SELECT {big('count(*)')} AS total, {big('count(*) FILTER (NOT is_hidden)')} AS visible, {big('count(*) FILTER (NOT is_hidden AND ok)')} AS successful, {big('count(*) FILTER (NOT is_hidden AND bad)')} AS problematic,
  {big('count(*) FILTER (NOT is_hidden AND stale)')} AS stale, {big('count(*) FILTER (is_hidden)')} AS hidden, {big("count(*) FILTER (NOT is_hidden AND ok AND status = 'completed')")} AS filtered FROM fp""")
def history_totals(spark: SparkSession, folder: str) -> DataFrame:
    flagged = _flagged(spark, folder)
    return history.history_totals(flagged, history.history_filter(flagged, status="completed", focus="successful"))


_STATUS = "CASE event WHEN 'dispatched' THEN 'queued' WHEN 'started' THEN 'processing' WHEN 'completed' THEN 'completed' WHEN 'failed' THEN 'failed' ELSE 'completed_with_warnings' END"


@CATALOG.query("transition_violations", _E + f""", l AS (SELECT audit_id, id, {_STATUS} AS to_status, lag({_STATUS}) OVER (PARTITION BY audit_id ORDER BY id) AS from_status FROM v_events)
SELECT audit_id, id, from_status, to_status FROM l WHERE from_status IS NOT NULL AND from_status <> to_status AND (from_status, to_status) NOT IN ({', '.join(f"('{a}', '{b}')" for a, b in history.TRANSITIONS)})""")
def transition_violations(spark: SparkSession, folder: str) -> DataFrame:
    log = load_view(spark, folder, "v_events").select("audit_id", "id", F.expr(_STATUS).alias("status"))
    return history.transition_violations(log, bucket_size=1000)
