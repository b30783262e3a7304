"""Views over finished runs: early stop, cause of a low score, confidence in the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.numeric import rnd

# --- fixed values -----------------------------------------------------------
SKIPPED_STAGES = ("heavy_analysis", "competitors", "competitor_page", "competitor_analysis", "competitor_aggregation", "recommendations")
IN_FLIGHT = ("queued", "processing")
SUCCESSFUL = ("completed", "completed_with_warnings")
MISMATCH_REASONS = ("confident_full_query_mismatch", "probable_query_topic_mismatch")
MISMATCH_BANDS = ("full_mismatch", "probable_mismatch")
MIN_ANALYZED = 1
MIN_COVERAGE = 0.5
# --- end of fixed values ----------------------------------------------------

_BREAKDOWN = (
    "struct<final_score:double,relevance_guardrail:struct<early_stop:boolean,early_stop_status:string,early_stop_reason:string,reason:string,band_min:double,"
    "band_max:double,early_stop_decision:struct<reason:string,score_floor:double,score_ceiling:double,safe_to_skip_competitors:boolean>>>"
)
_SUMMARY = "struct<final_score:double,score_basis:string,relevance_guardrail:struct<reason:string,status:string,score_ceiling:double>>"


def _finite(column: Column) -> Column:
    return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)


def _said(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def early_stop_summary(audits: DataFrame) -> DataFrame:
    """Runs that were stopped early, with the first usable value of each field. JSON columns are parsed once."""
    rows = audits.select("*", F.from_json("score_breakdown", _BREAKDOWN).alias("b"), F.from_json("comparison_summary", _SUMMARY).alias("c"))
    guard, decision = "b.relevance_guardrail", "b.relevance_guardrail.early_stop_decision"
    stopped = rows.filter(F.col(f"{guard}.early_stop"))
    first = lambda *names: F.coalesce(*[_finite(F.col(n)) for n in names])
    positive = lambda column, default: F.coalesce(F.when(column != 0, column), F.lit(default))
    return stopped.select(
        *[c for c in audits.columns if c not in ("score_breakdown", "comparison_summary", "score")],
        F.coalesce(
            _said(F.col(f"{decision}.reason")), _said(F.col(f"{guard}.early_stop_reason")), _said(F.col(f"{guard}.reason")),
            _said(F.col("c.relevance_guardrail.reason")), F.lit("query_relevance_early_stop"),
        ).alias("reason"),
        F.coalesce(_said(F.col(f"{guard}.early_stop_status")), _said(F.col("c.relevance_guardrail.status")), F.lit("completed")).alias("stop_status"),
        rnd(first("score", "b.final_score", "c.final_score"), 4).alias("score"),
        positive(first(f"{decision}.score_floor", f"{guard}.band_min"), 0.0).alias("score_floor"),
        positive(first(f"{decision}.score_ceiling", f"{guard}.band_max", "c.relevance_guardrail.score_ceiling"), 5.0).alias("score_ceiling"),
        F.coalesce(_said(F.col("c.score_basis")), F.lit("query_relevance_early_stop")).alias("score_basis"),
        F.coalesce(F.col(f"{decision}.safe_to_skip_competitors"), F.lit(False)).alias("safe_to_skip_competitors"), F.lit(len(SKIPPED_STAGES)).alias("skipped_stages"),
    )


def low_score_reason(runs: DataFrame) -> DataFrame:
    """First matching cause of a low score; blocking causes come first, a score of 80 or more has none."""
    status, score, gap = F.col("http_status"), F.col("final_score"), F.col("score_gap")
    true = lambda c: F.coalesce(c, F.lit(False))
    broken = true(status >= 400) | true(F.col("target_fetch_status") == "failed") | true(F.col("failure_stage") == "fetch") | true(F.col("http_status_ok") == 0)
    blocked = true(F.col("page_indexable") == 0) | true(F.col("robots_noindex") == 1)
    unusable = (
        true(F.col("guardrail_reason") == "page_unusable") | true(F.col("guardrail_band") == "unusable")
        | true((F.col("word_count") < 20) & (F.col("text_length_chars") < 200))
    )
    mismatch = true(F.col("early_stop")) | true(F.col("guardrail_reason").isin(*MISMATCH_REASONS)) | true(F.col("guardrail_band").isin(*MISMATCH_BANDS))
    issues = true(F.col("recommendation_count") > 0) | true(F.col("groups_with_issues") > 0) | true(F.col("negative_factors") > 0)
    kind = (
        F.when(true(status == 404), "http_404").when(broken, "http_error").when(blocked, "noindex").when(unusable, "unusable")
        .when(true(score >= 80), "unknown").when(mismatch, "query_mismatch").when(true(score < 80) & true(gap <= -5), "competitor_gap")
        .when(true(score < 80) & issues, "seo_gaps").otherwise("unknown")
    )
    named = runs.withColumn("kind", kind)
    blocking = F.col("kind").isin("http_404", "http_error", "noindex", "unusable")
    tone = F.when(blocking, "error").when(F.col("kind") == "query_mismatch", "warning").when(F.col("kind").isin("competitor_gap", "seo_gaps"), "info").otherwise("neutral")
    return named.select("*", F.when(blocking, "page_unavailable").otherwise(F.col("kind")).alias("category"), tone.alias("tone"), blocking.alias("is_blocking"))


def confidence_reasons() -> Column:
    """Reasons (code, tone) behind the confidence of one run, in the order they are shown."""
    reason = lambda code, tone: F.struct(F.lit(code).alias("code"), (tone if isinstance(tone, Column) else F.lit(tone)).alias("tone"))
    status = F.col("status")
    done, failed = F.coalesce(status.isin(*SUCCESSFUL), F.lit(False)), F.coalesce(status == "failed", F.lit(False))
    waiting = F.coalesce(status.isin(*IN_FLIGHT), F.lit(False))
    when_missing = F.when(done, "warning").otherwise("muted")
    fetch, method = F.col("target_fetch_status"), F.col("target_fetch_method")
    covered = done & (F.coalesce("competitors_analyzed", F.lit(0)) >= MIN_ANALYZED)
    recommended = F.coalesce(F.col("recommendation_count") > 0, F.lit(False))
    scored = F.col("final_score").isNotNull()
    said = lambda condition, code, tone: F.when(condition, reason(code, tone))
    listed = [
        F.when(status.isNull(), reason("audit_not_selected", "muted")).when(waiting, reason("audit_in_progress", "muted")).when(failed, reason("audit_failed", "error"))
        .when(status == "completed_with_warnings", reason("audit_completed_with_warnings", "warning")).otherwise(reason("audit_completed", "ok")),
        F.when(fetch == "failed", reason("target_fetch_failed", "error"))
        .when((fetch == "success") & method.isin("browser", "http_retry"), reason("target_fetch_fallback", "warning"))
        .when(fetch == "success", reason("target_fetch_success", "ok")).otherwise(reason("target_fetch_unknown", when_missing)),
        F.when(F.col("feature_schema").isNotNull(), reason("feature_schema_present", "ok")).otherwise(reason("feature_schema_missing", when_missing)),
        F.when(F.col("has_heavy_analysis"), reason("heavy_analysis_present", "ok")).otherwise(reason("heavy_analysis_missing", when_missing)),
        F.when(scored, reason("score_present", "ok")).otherwise(reason("score_missing", F.when(done | failed, "error").otherwise("muted"))),
        said(scored & F.col("has_model_info"), "model_metadata_present", "ok"),
        said(scored & ~F.col("has_model_info") & F.col("has_breakdown"), "missing_model_metadata", "warning"),
        said(scored & ~F.col("has_model_info") & ~F.col("has_breakdown"), "missing_score_breakdown", "warning"),
        F.when(~done, reason("competitor_coverage_pending", "muted")).when(~covered, reason("no_competitors_analyzed", "warning")).otherwise(reason("competitor_coverage_present", "ok")),
        said(covered & F.coalesce(F.col("coverage_ratio") < MIN_COVERAGE, F.lit(False)), "low_competitor_coverage", "warning"),
        said(covered & F.coalesce(F.col("competitors_failed") > 0, F.lit(False)), "competitor_fetch_failures", "warning"),
        F.when(recommended, reason("recommendations_present", "ok")).when(done, reason("recommendations_missing", "warning")).otherwise(reason("recommendations_pending", "muted")),
    ]
    warnings = F.transform(F.array_repeat(F.lit("runtime_warning"), F.coalesce("warning_messages", F.lit(0)).cast("int")), lambda w: F.struct(w.alias("code"), F.lit("warning").alias("tone")))
    failure = F.array(said(F.coalesce(F.col("has_failure"), F.lit(False)), "failure_context_present", "error"))
    return F.array_compact(F.concat(F.array(*listed), warnings, failure))


def score_confidence(runs: DataFrame) -> DataFrame:
    """Confidence level and counts per tone."""
    rows = runs.withColumn("reasons", confidence_reasons())
    has = lambda tone: F.exists("reasons", lambda r: r["tone"] == tone)
    count = lambda tone: F.size(F.filter("reasons", lambda r: r["tone"] == tone))
    level = (
        F.when(F.col("status").isNull() | F.col("status").isin(*IN_FLIGHT), "unknown").when((F.col("status") == "failed") | has("error"), "low")
        .when(F.col("final_score").isNull(), "unknown").when(has("warning"), "medium").otherwise("high")
    )
    return rows.select("*", level.alias("level"), count("error").alias("error_count"), count("warning").alias("warning_count"), count("ok").alias("passed_count"))
