"""Page sets per query: cleaning, candidate selection, peer statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import order, urls
from rankloom.functions.numeric import clip, flag, present_mean, ratio, rnd, stable_mean, stable_sum, tie_percentile, value_histogram

# --- fixed values -----------------------------------------------------------
BOT_BLOCK_CODES = (
    "http_401", "http_403", "http_429", "browser_blocked", "bot_protection_suspected", "captcha_detected", "access_denied",
)
RENDER_LIMITED_CODES = ("javascript_required", "browser_fetch_failed", "browser_timeout", "browser_unavailable")
THIN_CODES = ("empty_content",)
MIN_COMPETITORS = 2
MIN_ACCEPTED_SCORE = 10.0
MAX_CANDIDATES = 100
SERP_RELATIVE_GROUPS: dict[str, tuple[str, ...]] = {
    "query_match": (
        "keyword_coverage_ratio", "query_prominence_score", "title_heading_keyword_alignment", "early_query_coverage_ratio",
    ),
    "semantic_relevance": (
        "semantic_similarity", "query_semantic_alignment", "title_semantic_alignment", "heading_semantic_alignment",
    ),
    "content_depth": ("content_depth_semantic_score", "semantic_content_richness", "conversion_signal_score"),
    "technical_seo": ("technical_seo_score", "technical_metadata_score", "canonical_signal_score", "url_hygiene_score"),
    "commercial_trust": (
        "commercial_trust_score", "commercial_signals_score", "trust_signals_score", "contact_options_score",
    ),
    "intent_alignment": (
        "intent_alignment_score", "commercial_intent_alignment", "local_intent_alignment",
        "informational_intent_alignment", "navigational_intent_alignment",
    ),
}
RELATIVE_METRICS = ("gap_to_top", "gap_to_median", "percentile", "z_score")
# --- end of fixed values ----------------------------------------------------


def serp_normalize(raw: DataFrame, top_n: int = 10, payload: Sequence[str] = ()) -> DataFrame:
    """Usable results per (query, page): filtered, first per URL, first ``top_n``, ranked across pages.

    The first-per-URL step is a ``min_by`` with map-side combine and the
    row_number filter becomes a per-task group limit, so neither step moves a
    whole hot query through one task.
    """
    cleaned = raw.withColumn("url", F.trim("url")).filter((F.col("url") != "") & ~urls.is_excluded(F.col("url")))
    kept = ["position", "title", "snippet", *payload]
    first = (
        cleaned.groupBy("query", "serp_page", "url")
        .agg(F.min_by(F.struct(*kept), F.struct("position", *payload)).alias("r"))
        .select("query", "serp_page", "url", *[F.col(f"r.{name}").alias(name) for name in kept])
    )
    order = Window.partitionBy("query", "serp_page").orderBy("position", "url")
    return (
        first.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= top_n)
        .select(
            "query", "serp_page", "url",
            F.trim("title").alias("title"), F.trim("snippet").alias("snippet"),
            (F.col("serp_page") * top_n + F.col("place")).cast("int").alias("rank"),
            *payload,
        )
    )


def candidate_limit(requested: Column) -> Column:
    """Requested peers plus a replacement reserve of half of them (3 to 10), within 100."""
    wanted = F.least(F.when(requested > 0, requested).otherwise(F.lit(10)), F.lit(MAX_CANDIDATES))
    reserve = F.least(
        F.greatest(F.lit(3), F.floor((wanted + 1) / 2).cast("int")),
        F.lit(10),
        F.greatest(F.lit(0), F.lit(MAX_CANDIDATES) - wanted),
    )
    return (wanted + reserve).cast("int")


def competitor_candidates(results: DataFrame, targets: DataFrame, payload: Sequence[str] = (), pages: int = 3) -> DataFrame:
    """Candidates per audit: other domains only, first row per domain, first ``limit`` in rank order.

    ``results`` are normalized results; a page counts only when every page
    before it has results. ``targets`` carries audit_id, query, target_domain
    and candidate_limit.
    """
    early = results.filter(F.col("serp_page") < pages)
    reach = early.groupBy("query").agg(F.bit_or(F.expr("shiftleft(1, serp_page)")).alias("page_bits"))
    reachable = reduce(
        lambda otherwise, page: F.when(
            F.col("page_bits").bitwiseAND((1 << (page + 1)) - 1) == (1 << (page + 1)) - 1, F.lit(page)
        ).otherwise(otherwise),
        range(pages),
        F.lit(-1),
    )
    usable = (
        early.join(reach.select("query", reachable.alias("last_page")), "query")
        .filter(F.col("serp_page") <= F.col("last_page"))
        .withColumn("domain", urls.domain(F.col("url")))
    )
    kept = ["serp_page", "rank", "url", "title", "snippet", *payload]
    joined = usable.join(targets.select("audit_id", "query", "target_domain", "candidate_limit"), "query").filter(
        (F.col("domain") != "") & (F.col("domain") != F.col("target_domain"))
    )
    first = (
        joined.groupBy("audit_id", "domain")
        .agg(
            F.min_by(F.struct(*kept), F.struct("rank", "url")).alias("r"),
            F.first("candidate_limit").alias("candidate_limit"),
        )
        .select("audit_id", "domain", "candidate_limit", *[F.col(f"r.{name}").alias(name) for name in kept])
    )
    order = Window.partitionBy("audit_id").orderBy("rank", "url")
    return (
        first.withColumn("candidate_index", F.row_number().over(order))
        .filter(F.col("candidate_index") <= MAX_CANDIDATES)
        .filter(F.col("candidate_index") <= F.col("candidate_limit"))
        .drop("candidate_limit")
    )


def discard_reason() -> Column:
    """Why a collected peer is not used; null for a usable one."""
    code = F.lower(F.trim(F.coalesce("fetch_error_code", F.lit(""))))
    status = F.lower(F.trim(F.coalesce("fetch_status", F.lit(""))))
    unanalyzed = (F.col("features_present") == 0) | F.col("score").isNull()
    return (
        F.when(code.isin(*BOT_BLOCK_CODES), "bot_block_suspected")
        .when(code.isin(*RENDER_LIMITED_CODES), "render_limited")
        .when(code.isin(*THIN_CODES), "thin_content")
        .when((status != "") & (status != "success") & unanalyzed, "fetch_failed")
        .when(unanalyzed, "not_analyzed")
        .when(F.col("score") < MIN_ACCEPTED_SCORE, "score_below_minimum")
        .when((F.col("word_count") < 20.0) & (F.col("text_length_chars") < 200.0), "thin_content")
    )


def competitor_selection(candidates: DataFrame) -> DataFrame:
    """Accepted, unused and discarded candidates with replacement flags.

    Input groups are candidate lists, at most 100 rows per audit by
    construction, so one window per audit is safe.
    """
    reasons = candidates.withColumn("discard_reason", discard_reason())
    before = Window.partitionBy("audit_id").orderBy("candidate_index").rowsBetween(Window.unboundedPreceding, -1)
    ok = F.col("discard_reason").isNull()
    wanted = F.when(F.col("requested_top_n") > 0, F.col("requested_top_n"))
    open_slot = wanted.isNull() | (F.col("accepted_before") < wanted)
    status = F.when(~ok, "discarded").when(open_slot, "accepted").otherwise("unused")
    return (
        reasons.withColumn("accepted_before", F.coalesce(F.sum(flag(ok)).over(before), F.lit(0)))
        .withColumn("context_status", status)
        .withColumn(
            "replacement_candidate",
            flag((F.col("context_status") == "accepted") & wanted.isNotNull() & (F.col("candidate_index") > wanted)),
        )
        .withColumn("replacement_attempt", flag(~ok & wanted.isNotNull() & (F.col("accepted_before") < wanted)))
        .drop("accepted_before")
    )


def _labelled_counts(label: str) -> Column:
    """``label:count`` of discarded entries in label order, over the collected (label, n) entries of one audit."""
    gone = F.filter("entries", lambda e: e["context_status"] == "discarded")
    labels = F.array_sort(F.array_distinct(F.transform(gone, lambda e: e[label])))
    total = lambda name: F.aggregate(F.filter(gone, lambda e: e[label] == name), F.lit(0).cast("bigint"), lambda n, e: n + e["n"])
    return F.array_join(F.array_sort(F.transform(labels, lambda name: F.concat_ws(":", name, total(name).cast("string")))), ",")


def context_quality(audits: DataFrame, selected: DataFrame, min_competitors: int = MIN_COMPETITORS) -> DataFrame:
    """One row per audit: counts, coverage, status ladder, reason and error-code histograms.

    The selection is read once: counted by audit, status, reason and code, and
    those counts (at most one per candidate, so 100 an audit) by audit.
    """
    filled = lambda name: F.nullif(F.trim(F.coalesce(F.col(name), F.lit(""))), F.lit(""))
    code = F.coalesce(
        filled("fetch_error_code"),
        F.when(F.lower(filled("fetch_status")) == "success", F.col("discard_reason")),
        filled("fetch_status"),
        F.lit("unknown"),
    )
    entries = selected.groupBy("audit_id", "context_status", "discard_reason", code.alias("code")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("replacement_attempt").alias("attempts"), F.sum("replacement_candidate").alias("used")
    )
    of = lambda status: F.sum(F.when(F.col("context_status") == status, F.col("n")).otherwise(0))
    counts = entries.groupBy("audit_id").agg(
        F.sum("n").alias("found"), of("accepted").alias("analyzed"), of("discarded").alias("failed"), of("unused").alias("unused_candidates"),
        F.sum("attempts").alias("replacement_attempts"), F.sum("used").alias("replacements_used"),
        F.collect_list(F.struct("context_status", "discard_reason", "code", "n")).alias("entries"),
    )
    counts = counts.select("*", _labelled_counts("discard_reason").alias("discard_reasons"), _labelled_counts("code").alias("fetch_error_codes")).drop("entries")
    joined = (
        audits.select("audit_id", "requested_top_n")
        .join(counts, "audit_id", "left")
        .na.fill(0, ["found", "analyzed", "failed", "unused_candidates", "replacement_attempts", "replacements_used"])
        .na.fill("", ["discard_reasons", "fetch_error_codes"])
    )
    wanted = F.when(F.col("requested_top_n") > 0, F.col("requested_top_n"))
    expected = F.coalesce(wanted, F.greatest(F.col("found"), F.lit(min_competitors)))
    status = (
        F.when(F.col("found") == 0, "no_serp_results")
        .when(F.col("analyzed") < min_competitors, "insufficient_processed_competitors")
        .when(wanted.isNotNull() & (F.col("analyzed") >= wanted), "ready")
        .when(F.col("failed") > 0, "partial_but_usable")
        .otherwise("ready")
    )
    return joined.select(
        "audit_id", status.alias("status"),
        flag(F.col("analyzed") >= min_competitors).alias("context_available"),
        F.col("found").alias("competitors_found"), F.col("analyzed").alias("competitors_analyzed"),
        F.col("failed").alias("competitors_failed"), "unused_candidates", "replacement_attempts", "replacements_used",
        rnd(ratio(F.col("analyzed"), expected), 4).alias("coverage_ratio"),
        "discard_reasons", "fetch_error_codes",
    )


def gap_strength(gap: Column, full_loss: float) -> Column:
    return F.when(gap >= 0, F.lit(100.0)).otherwise(clip(F.lit(100.0) + gap / F.lit(full_loss) * F.lit(100.0), 0.0, 100.0))


def competitiveness(targets: DataFrame, peers: DataFrame, min_competitors: int = MIN_COMPETITORS) -> DataFrame:
    """Target score adjusted by its peers: gaps, strength, tie-aware percentile and position band.

    ``targets``: audit_id, user_score. ``peers``: accepted peers with
    audit_id and score (at most 100 per audit).
    """
    own = targets.select("audit_id", rnd(clip(F.col("user_score"), 0.0, 100.0), 4).alias("primary_page_score"))
    scored = peers.filter(F.col("score").isNotNull()).select(
        "audit_id", rnd(clip(F.col("score"), 0.0, 100.0), 4).alias("peer")
    )
    stats = (
        scored.join(own, "audit_id")
        .groupBy("audit_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("peer").alias("average_score"),
            F.max("peer").alias("best_score"),
            F.median("peer").alias("median_score"),
            F.count_if(F.col("peer") < F.col("primary_page_score")).alias("below"),
            F.count_if(F.col("peer") == F.col("primary_page_score")).alias("equal"),
        )
    )
    enough = F.col("n") >= min_competitors
    average_gap = F.col("primary_page_score") - F.col("average_score")
    best_gap = F.col("primary_page_score") - F.col("best_score")
    base = own.join(stats, "audit_id", "left").na.fill(0, ["n"]).select(
        "*", average_gap.alias("average_gap"), best_gap.alias("best_gap")
    )
    market = gap_strength(F.col("average_gap"), 25.0) * F.lit(0.62) + gap_strength(F.col("best_gap"), 30.0) * F.lit(0.38)
    adjustment = clip(F.col("average_gap") * F.lit(0.12) + F.col("best_gap") * F.lit(0.08), -6.0, 4.0)
    final = rnd(clip(F.col("primary_page_score") * F.lit(0.72) + market * F.lit(0.28) + adjustment, 0.0, 100.0), 4)
    band = (
        F.when((F.col("average_gap") >= 5.0) & (F.col("best_gap") >= 0.0), "leading")
        .when((F.col("average_gap") >= -3.0) & (F.col("best_gap") >= -8.0), "competitive")
        .when((F.col("average_gap") >= -8.0) & (F.col("best_gap") >= -15.0), "close_gap")
        .when(F.col("average_gap") >= -16.0, "behind")
        .otherwise("far_behind")
    )
    scored_rows = base.withColumn(
        "competitiveness_score", F.when(enough, final).otherwise(F.col("primary_page_score"))
    )
    return scored_rows.select(
        "audit_id", "primary_page_score", F.col("n").alias("competitors_scored"),
        F.when(enough, "competitiveness_score").otherwise("primary_page_score").alias("score_basis"),
        "competitiveness_score",
        rnd(F.col("competitiveness_score") - F.col("primary_page_score"), 4).alias("score_delta"),
        F.when(enough, rnd(F.col("average_score"), 4)).alias("competitor_average_score"),
        F.when(enough, F.col("best_score")).alias("competitor_best_score"),
        F.when(enough, rnd(F.col("median_score"), 4)).alias("competitor_median_score"),
        F.when(enough, rnd(F.col("average_gap"), 4)).alias("average_score_gap"),
        F.when(enough, rnd(F.col("best_gap"), 4)).alias("best_score_gap"),
        F.when(enough, rnd(tie_percentile(F.col("below"), F.col("equal"), F.col("n")) * F.lit(100.0), 4)).alias("score_percentile"),
        F.when(enough, band).otherwise("not_enough_data").alias("position_band"),
    )


def comparison_summary(quality: DataFrame, competitive: DataFrame) -> DataFrame:
    """Context quality and competitiveness side by side with the displayed differences."""
    average = F.col("competitor_average_score")
    return quality.join(competitive, "audit_id").select(
        "audit_id", F.col("competitiveness_score").alias("user_score"), "primary_page_score", "score_basis",
        F.col("competitor_average_score").alias("competitors_average_score"),
        rnd(F.col("competitiveness_score") - average, 4).alias("score_difference"),
        rnd(F.col("primary_page_score") - average, 4).alias("primary_score_difference"),
        "competitors_found", "competitors_analyzed", "competitors_failed", "replacement_attempts",
        F.col("status").alias("competitor_context_status"), "position_band", "score_percentile",
    )


def group_values(rows: DataFrame, keys: Sequence[str], groups: Mapping[str, Sequence[str]] = SERP_RELATIVE_GROUPS, every: bool = False) -> DataFrame:
    """Long form (keys, grp, value): mean of the present features of each group, rounded to 6 digits; with ``every`` also without a value."""
    pairs = F.array(*[F.struct(F.lit(name).alias("grp"), rnd(present_mean(cols), 6).alias("value")) for name, cols in groups.items()])
    long = rows.select(*keys, F.explode(pairs).alias("g")).select(*keys, "g.grp", "g.value")
    return long if every else long.filter(F.col("value").isNotNull())


def _relative_columns() -> list[Column]:
    gap_top = F.col("value") - F.col("top_value")
    z = F.when(F.col("variance") > 0, (F.col("value") - F.col("mean_value")) / F.sqrt("variance")).otherwise(F.lit(0.0))
    return [
        rnd(gap_top, 6).alias("gap_to_top"),
        rnd(F.col("value") - F.col("median_value"), 6).alias("gap_to_median"),
        rnd(tie_percentile(F.col("below"), F.col("equal"), F.col("peers")), 6).alias("percentile"),
        rnd(z, 5).alias("z_score"),
        (F.lit(1.0) - clip(-gap_top, 0.0, 1.0)).alias("gap_score"),
    ]


def with_group_means(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_groups``: the mean of the present features of every group, in order, rounded to 6 digits."""
    return rows.withColumn("_groups", F.array(*[rnd(present_mean(cols), 6) for cols in SERP_RELATIVE_GROUPS.values()]))


def serp_relative_target(targets: DataFrame, peers: DataFrame, dealt: bool = False) -> DataFrame:
    """Target page against its peers, one row per audit with the columns of every group.

    Both inputs carry audit_id and the group features, or ``_groups``; peer
    lists hold at most 100 rows per audit. ``dealt``: rows lie by audit already.
    """
    values = lambda rows, name: (rows if "_groups" in rows.columns else with_group_means(rows)).select("audit_id", F.col("_groups").alias(name))
    # peers are dealt by audit with all groups in their row; groups come apart where they are summed
    met = values(targets, "own").join(values(peers, "peers") if dealt else values(peers, "peers").repartition("audit_id"), "audit_id")
    each = F.arrays_zip(F.array(*[F.lit(name) for name in SERP_RELATIVE_GROUPS]).alias("grp"), F.col("own").alias("value"), F.col("peers").alias("peer"))
    stats = (
        met.select("audit_id", F.explode(each).alias("g")).select("audit_id", "g.grp", "g.value", "g.peer")
        .filter("value is not null and peer is not null")
        .groupBy("audit_id", "grp", "value")
        .agg(
            F.count(F.lit(1)).alias("peers"), F.max("peer").alias("top_value"), F.median("peer").alias("median_value"),
            F.avg("peer").alias("mean_value"), F.var_pop("peer").alias("raw_variance"),
            F.count_if(F.col("peer") < F.col("value")).alias("below"), F.count_if(F.col("peer") == F.col("value")).alias("equal"),
        )
        .withColumn("variance", F.when(F.col("raw_variance") < 1e-12, F.lit(0.0)).otherwise(F.col("raw_variance")))
        .select("audit_id", "grp", *_relative_columns())
    )
    per_group = [
        F.max(F.when(F.col("grp") == name, F.col(metric))).alias(f"relative_{metric}_{name}")
        for name in SERP_RELATIVE_GROUPS
        for metric in ("gap_to_top", "gap_to_median", "percentile", "z_score")
    ]
    pivoted = stats.groupBy("audit_id").agg(
        F.count(F.lit(1)).alias("groups"), stable_mean(F.col("percentile"), 6).alias("p"), stable_mean(F.col("gap_score"), 6).alias("g"), *per_group
    )
    counts = peers.groupBy("audit_id").agg(F.count(F.lit(1)).alias("context_count"))
    return (
        targets.select("audit_id")
        .join(counts, "audit_id", "left")
        .join(pivoted, "audit_id", "left")
        .na.fill(0, ["context_count", "groups"])
        .select(
            "audit_id", flag(F.col("context_count") > 0).alias("serp_relative_context_available"),
            F.col("context_count").alias("serp_relative_context_count"), F.col("groups").alias("serp_relative_group_count"),
            F.coalesce(rnd(F.col("p"), 6), F.lit(0.0)).alias("serp_relative_percentile"),
            F.coalesce(rnd(F.col("g"), 6), F.lit(0.0)).alias("serp_relative_gap_score"),
            *[c for c in pivoted.columns if c.startswith("relative_")],
        )
    )


def leave_one_out(rows: DataFrame, key: str = "query") -> DataFrame:
    """Statistics of each (key, grp, value) against all other rows of the group.

    Everything needed depends only on the row's own value and the value
    histogram of its group: counts come from running sums, mean and variance
    by subtracting the own value, top and median from positions. Input is
    the long form of ``group_values``; values have 6 digits, so a histogram
    has at most about a million entries however many rows the group has. One
    shuffle after map-side counting; all windows share it. Sums run over
    whole millionths, which add exactly.
    """
    keys = [key, "grp"]
    hist = value_histogram(rows, keys, "value")
    group = Window.partitionBy(*keys)
    first_middle = F.floor((F.col("n_total") - 2) / 2)
    value_at = lambda position: F.max(
        F.when((F.col("n_below") <= position) & (F.col("n_below") + F.col("n_equal") > position), F.col("value"))
    ).over(group)
    units = F.rint(F.col("value") * 1e6)
    stats = hist.filter(F.col("n_total") > 1).select(
        "*",
        F.sum(units * F.col("n_equal")).over(group).alias("total"), F.sum(units * units * F.col("n_equal")).over(group).alias("squares"),
        F.max("value").over(group).alias("best"),
        F.max(F.when(F.col("n_below") + F.col("n_equal") < F.col("n_total"), F.col("value"))).over(group).alias("second"),
        value_at(first_middle).alias("m0"), value_at(first_middle + 1).alias("m1"), value_at(first_middle + 2).alias("m2"),
    )
    others = (F.col("n_total") - 1).cast("double")
    rest, rest_squares = F.col("total") - units, F.col("squares") - units * units
    variance = (rest_squares - rest * rest / others) / others / 1e12
    # position k of the rest is position k of the whole below the own row, k + 1 from it on
    rest_at = lambda position, here, after: F.when(F.col("n_below") + F.col("n_equal") - 1 <= position, after).otherwise(here)
    low = rest_at(first_middle, F.col("m0"), F.col("m1"))
    high = rest_at(first_middle + 1, F.col("m1"), F.col("m2"))
    shaped = stats.select(
        *keys, "value", (F.col("n_total") - 1).alias("peers"),
        F.when((F.col("value") == F.col("best")) & (F.col("n_equal") == 1), F.col("second")).otherwise(F.col("best")).alias("top_value"),
        F.when(F.col("n_total") % 2 == 0, low).otherwise((low + high) / 2.0).alias("median_value"),
        (rest / others / 1e6).alias("mean_value"), F.when(variance < 1e-12, F.lit(0.0)).otherwise(variance).alias("variance"),
        F.col("n_below").alias("below"), (F.col("n_equal") - 1).alias("equal"),
    )
    return shaped.select(*keys, "value", "peers", *_relative_columns())


def _relative_long(rows: DataFrame, row_keys: Sequence[str], every: bool = False) -> DataFrame:
    """``serp_relative_all`` by value: statistics are joined back on (query, grp, value), which spreads a query over its values."""
    long = group_values(rows, list(row_keys), every=every)
    stats = leave_one_out(long.filter(F.col("value").isNotNull()).select(row_keys[0], "grp", "value"), row_keys[0])
    matched = long.join(stats, [row_keys[0], "grp", "value"], "left" if every else "inner")
    per_group = [
        F.max(F.when(F.col("grp") == name, F.col(metric))).alias(f"relative_{metric}_{name}")
        for name in SERP_RELATIVE_GROUPS
        for metric in RELATIVE_METRICS
    ]
    return matched.groupBy(*row_keys).agg(
        F.max("peers").alias("serp_relative_context_count"),
        F.count("peers").alias("serp_relative_group_count"),
        rnd(stable_mean(F.col("percentile"), 6), 6).alias("serp_relative_percentile"),
        rnd(stable_mean(F.col("gap_score"), 6), 6).alias("serp_relative_gap_score"),
        *per_group,
    )


def _relative_wide(rows: DataFrame, row_keys: Sequence[str], every: bool = False) -> DataFrame:
    """``serp_relative_all`` for queries that one task holds: a row stays one row, and all windows share the shuffle by query."""
    key, names = row_keys[0], list(SERP_RELATIVE_GROUPS)
    whole = Window.partitionBy(key)
    wide = rows
    for name in names:
        v, total = F.col(name), F.col("_total")
        ordered = whole.orderBy(v.asc_nulls_last())
        all_of = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        units = F.rint(v * 1e6)
        placed = wide.select(
            "*", F.row_number().over(ordered).alias("_at"), (F.rank().over(ordered) - 1).alias("below"), F.count(name).over(ordered).alias("_upto"),
            F.count(name).over(all_of).alias("_total"), F.sum(units).over(all_of).alias("_sum"), F.sum(units * units).over(all_of).alias("_squares"), F.max(name).over(all_of).alias("_best"),
        )
        first_middle = F.floor((total - 2) / 2)
        value_at = lambda position: F.max(F.when(F.col("_at") - 1 == position, v)).over(whole)
        known = placed.select("*", value_at(first_middle).alias("_m0"), value_at(first_middle + 1).alias("_m1"), value_at(first_middle + 2).alias("_m2"), value_at(total - 2).alias("_second"))
        others = F.when(total > 1, (total - 1).cast("double"))
        rest, rest_squares = F.col("_sum") - units, F.col("_squares") - units * units
        variance = (rest_squares - rest * rest / others) / others / 1e12
        rest_at = lambda position, here, after: F.when(F.col("_upto") - 1 <= position, after).otherwise(here)
        low, high = rest_at(first_middle, F.col("_m0"), F.col("_m1")), rest_at(first_middle + 1, F.col("_m1"), F.col("_m2"))
        unique = F.col("_upto") - F.col("below") == 1
        measured = known.select(
            *wide.columns, v.alias("value"), (total - 1).alias("peers"), F.when((v == F.col("_best")) & unique, F.col("_second")).otherwise(F.col("_best")).alias("top_value"),
            F.when(total % 2 == 0, low).otherwise((low + high) / 2.0).alias("median_value"), (rest / others / 1e6).alias("mean_value"),
            F.when(variance < 1e-12, F.lit(0.0)).otherwise(variance).alias("variance"), "below", (F.col("_upto") - F.col("below") - 1).alias("equal"),
        )
        compared = F.when(v.isNotNull() & (F.col("peers") > 0), F.struct("peers", *_relative_columns()))
        wide = measured.select(*[compared.alias(c) if c == name else c for c in wide.columns])
    each = F.array_compact(F.array(*[F.col(n) for n in names]))
    millionths = lambda metric: F.aggregate(each, F.lit(0.0), lambda total, g: total + F.rint(g[metric] * 1e6))
    groups = F.sum(F.size(each))
    mean = lambda metric: rnd(F.sum(millionths(metric)) / F.nullif(groups * F.lit(1e6), F.lit(0.0)), 6)
    # rows of one key are one row, as by value; their shuffle by query serves
    compared_rows = wide.groupBy(*row_keys).agg(
        F.max(F.greatest(*[F.col(f"{n}.peers") for n in names])).alias("serp_relative_context_count"), groups.cast("bigint").alias("serp_relative_group_count"),
        mean("percentile").alias("serp_relative_percentile"), mean("gap_score").alias("serp_relative_gap_score"),
        *[F.max(f"{name}.{metric}").alias(f"relative_{metric}_{name}") for name in names for metric in RELATIVE_METRICS],
    )
    return compared_rows if every else compared_rows.filter(F.col("serp_relative_group_count") > 0)


def serp_relative_all(rows: DataFrame, row_keys: Sequence[str] = ("query", "url"), own: int = order.OWN, every: bool = False) -> DataFrame:
    """Leave-one-out comparison of every row with the rest of its query.

    Rows are dealt once by query. A query of more rows than one task should
    hold (``order.large_keys``) is compared by its values instead. The first of
    ``row_keys`` is the query; columns that are only carried along may be among
    the others. With ``every``, rows without a peer stay too.
    """
    key = row_keys[0]
    values = rows.select(*row_keys, *[rnd(present_mean(cols), 6).alias(name) for name, cols in SERP_RELATIVE_GROUPS.items()])
    large = order.large_keys(values.select(key), [key], own)
    if large is None:
        return _relative_wide(values, row_keys, every)
    features = sorted({c for cols in SERP_RELATIVE_GROUPS.values() for c in cols})
    few = _relative_wide(values.join(F.broadcast(large), key, "left_anti"), row_keys, every)
    return few.unionByName(_relative_long(rows.select(*row_keys, *features).join(F.broadcast(large), key, "left_semi"), row_keys, every))


def unpivot(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return rows.unpivot(list(keys), [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


def peer_benchmark(peers: DataFrame, lower_is_better: Sequence[str], higher_is_better: Sequence[str], neutral: Sequence[str], key: str = "query") -> DataFrame:
    """Per (key, metric): upper quartile, lower quartile or mean, by the metric's direction.

    Quartiles are those of the values as they are stored, from ordered counts
    that cut a large key into ranges.
    """
    metrics = [*higher_is_better, *lower_is_better, *neutral]
    long = unpivot(peers, [key], metrics).filter(F.col("value").isNotNull())
    ordered = order.ordered_counts(long, [key, "metric"], "value")
    stats = ordered.groupBy(key, "metric").agg(
        order.interpolated("value", 0.25).alias("low"), order.interpolated("value", 0.75).alias("high"),
        (F.sum(F.col("value") * F.col("n_equal")) / F.max("n_total")).alias("mean"), F.max("n_total").alias("n"),
    )
    value = (
        F.when(F.col("metric").isin(*higher_is_better), F.col("high"))
        .when(F.col("metric").isin(*lower_is_better), F.col("low"))
        .otherwise(F.col("mean"))
    )
    return stats.select(key, "metric", rnd(value, 4).alias("benchmark"), "n")


def peer_average(peers: DataFrame, metrics: Sequence[str], score: str, key: str = "query") -> DataFrame:
    """Mean per feature where an absent feature counts as 0; mean score over scored peers. Six digits are added as whole numbers."""
    means = [
        rnd(stable_sum(F.coalesce(F.col(m).cast("double"), F.lit(0.0)), 6) / F.count(F.lit(1)), 4).alias(f"avg_{m}") for m in metrics
    ]
    return peers.groupBy(key).agg(F.count(F.lit(1)).alias("peers"), *means, rnd(stable_mean(F.col(score), 6), 4).alias("average_peer_score"))


def compare_sites(rows: DataFrame, side: str = "side", score: str = "score") -> DataFrame:
    """Average score of own pages and of peers and their clamped difference."""
    means = rows.groupBy().agg(
        F.coalesce(stable_mean(F.when(F.col(side) == "user", F.col(score)), 4), F.lit(0.0)).alias("u"),
        F.coalesce(stable_mean(F.when(F.col(side) == "competitor", F.col(score)), 4), F.lit(0.0)).alias("c"),
    )
    return means.select(
        rnd(F.col("u"), 4).alias("user_average_score"), rnd(F.col("c"), 4).alias("competitor_average_score"),
        rnd(clip(rnd(F.col("u"), 4) - rnd(F.col("c"), 4), 0.0, 100.0), 4).alias("score_difference"),
    )


def fan_in_ready(audits: DataFrame, competitor_rows: DataFrame, open_statuses: Sequence[str]) -> DataFrame:
    """Audits without any competitor row still open (also those without rows).

    Counting open and closed rows first keeps the join at one row per audit.
    """
    counts = competitor_rows.groupBy("audit_id").agg(
        F.count(F.lit(1)).alias("competitor_rows"),
        F.count_if(F.col("status").isin(*open_statuses)).alias("open_rows"),
    )
    return (
        audits.join(counts, "audit_id", "left")
        .na.fill(0, ["competitor_rows", "open_rows"])
        .filter(F.col("open_rows") == 0)
        .select("audit_id", "competitor_rows")
    )
