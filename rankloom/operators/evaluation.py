"""Ranking evaluation over long prediction tables (model, query, url, rank, target_score, prediction)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import order
from rankloom.functions.numeric import flag, num, ratio, rnd, stable_mean
from rankloom.functions.urls import is_aggregator
from rankloom.operators.preferences import STRONG_MARGIN, UNCERTAIN_MARGIN, WEAK_MARGIN, WEIGHTS, preference_summary
from rankloom.session import kept

# --- fixed values -----------------------------------------------------------
TEXT_VOLUME_FEATURES = ("word_count", "text_length_chars", "paragraph_count", "sentence_count")
SEMANTIC_FEATURES = (
    "semantic_similarity", "query_semantic_alignment", "keyword_coverage_ratio", "intent_alignment_score",
    "commercial_intent_alignment", "local_intent_alignment", "informational_intent_alignment",
)
TECHNICAL_FEATURES = (
    "http_status_ok", "canonical_signal_score", "page_indexable", "technical_seo_score", "technical_metadata_score",
)
# of the six names the classifier lists, only these two are ever produced as features
COMMERCIAL_FEATURES = ("price_present", "phone_present")
ABSOLUTE_ERROR_TOLERANCE = 0.05
RANKING_FAMILY_MAE_LIMIT = 50.0
HARD_NEGATIVE_CAP = 35.0
COMMERCIAL_QUERY_TERMS = ("купить", "цена", "стоимость", "заказать")
# --- end of fixed values ----------------------------------------------------

QUERY_KEYS = ("model", "query")


def regression_metrics(predictions: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    error = F.col("prediction") - F.col("target_score")
    return predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        rnd(F.sqrt(F.avg(error * error)), 6).alias("rmse"),
        rnd(F.avg(F.abs(error)), 6).alias("mae"),
    )


def _top(predictions: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per group. The filter on row_number becomes a group limit before the shuffle."""
    ranked = predictions.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rn") <= k)


def _gain(k: int) -> Column:
    return F.sum((F.pow(F.lit(2.0), F.col("target_score") / F.lit(100.0)) - F.lit(1.0)) / F.log2(F.col("rn") + F.lit(1.0)))


def ndcg(predictions: DataFrame, k: int = 10, keys: Sequence[str] = QUERY_KEYS) -> DataFrame:
    """NDCG@k per group; 0 where the ideal gain is 0."""
    slim = predictions.select(*keys, "url", "rank", "target_score", "prediction")
    got = _top(slim, keys, [F.desc("prediction"), F.asc("rank"), F.asc("url")], k)
    ideal = _top(slim, keys, [F.desc("target_score"), F.asc("rank"), F.asc("url")], k)
    both = got.groupBy(*keys).agg(_gain(k).alias("dcg")).join(ideal.groupBy(*keys).agg(_gain(k).alias("ideal")), list(keys))
    return both.select(*keys, ratio(F.col("dcg"), F.col("ideal")).alias("ndcg"))


def spearman(predictions: DataFrame, keys: Sequence[str] = QUERY_KEYS) -> DataFrame:
    """Rank correlation per group with average ranks for ties; null for constant or single-row groups.

    Ranks are those of the values as they are stored. (target, prediction)
    pairs are counted first; ranks of distinct values come from ordered counts,
    which cut a large group into ranges, and go back by joins on the value.
    """
    pairs = (
        predictions.select(*keys, F.col("target_score").cast("double").alias("t"), F.col("prediction").cast("double").alias("p"))
        .groupBy(*keys, "t", "p")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranks = lambda value, name: order.average_ranks(pairs.groupBy(*keys, value).agg(F.sum("n").alias("n_equal")), keys, value, name)
    ranked = pairs.join(ranks("t", "rt").withColumnRenamed("n_total", "total"), [*keys, "t"]).join(ranks("p", "rp").drop("n_total"), [*keys, "p"])
    dt = F.col("rt") - (F.col("total") + 1) / 2.0
    dp = F.col("rp") - (F.col("total") + 1) / 2.0
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.col("n") * dt * dp).alias("tp"), F.sum(F.col("n") * dt * dt).alias("tt"), F.sum(F.col("n") * dp * dp).alias("pp")
    )
    usable = (F.col("tt") > 0) & (F.col("pp") > 0)
    return sums.select(*keys, F.when(usable, F.col("tp") / F.sqrt(F.col("tt") * F.col("pp"))).alias("spearman"))


def top_hit(predictions: DataFrame, k: int = 3, keys: Sequence[str] = QUERY_KEYS) -> DataFrame:
    """1 where one of the k best predicted pages is among the k best ranked ones."""
    slim = predictions.select(*keys, "url", "rank", "prediction")
    predicted = _top(slim, keys, [F.desc("prediction"), F.asc("rank"), F.asc("url")], k)
    actual = _top(slim, keys, [F.asc("rank"), F.asc("url")], k)
    both = (
        predicted.groupBy(*keys).agg(F.collect_set("url").alias("p"))
        .join(actual.groupBy(*keys).agg(F.collect_set("url").alias("a")), list(keys))
    )
    return both.select(*keys, flag(F.arrays_overlap("p", "a")).cast("double").alias("top3_hit"))


def _metrics_apart(predictions: DataFrame, keys: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """``query_metrics`` metric by metric, none of which needs a group in one task."""
    slim = kept(predictions)
    counts = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *extra)
    return (
        counts.join(ndcg(slim, 10, keys), list(keys))
        .join(spearman(slim, keys), list(keys))
        .join(top_hit(slim, 3, keys), list(keys))
    )


def _metrics_together(predictions: DataFrame, keys: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """``query_metrics`` of groups that one task holds: all places come from windows that share one shuffle."""
    group = Window.partitionBy(*keys)
    of = lambda *by: group.orderBy(*by)
    every = lambda by: of(by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same = lambda by: of(by).rangeBetween(Window.currentRow, Window.currentRow)
    t, p = F.desc("target_score"), F.desc("prediction")
    # average ranks count from the other end, which leaves the correlation as it is; each order is sorted once
    mean_rank = lambda by: F.rank().over(of(by)) + (F.count(F.lit(1)).over(same(by)) - 1) / 2.0
    known = (F.col("target_score").isNotNull() & F.col("prediction").isNotNull()).cast("int")
    placed = predictions.withColumns({"target_score": F.col("target_score").cast("double"), "prediction": F.col("prediction").cast("double")})
    placed = placed.withColumn("ar", F.row_number().over(of(F.asc("rank"), F.asc("url"))))
    placed = placed.withColumn("tr", F.row_number().over(of(t, F.asc("rank"), F.asc("url")))).withColumn("rt", mean_rank(t))
    placed = placed.withColumn("pr", F.row_number().over(of(p, F.asc("rank"), F.asc("url")))).withColumn("rp", mean_rank(p))
    placed = placed.withColumn("total", F.count(F.lit(1)).over(every(p)))
    centred = lambda name: F.when(known == 1, F.col(name) - (F.col("total") + 1) / 2.0)
    dt, dp = centred("rt"), centred("rp")
    gain = F.pow(F.lit(2.0), F.col("target_score") / F.lit(100.0)) - F.lit(1.0)
    top = lambda place: F.sum(F.when(F.col(place) <= 10, gain / F.log2(F.col(place) + F.lit(1.0))))
    # a page given twice may be first by one of its rows and predicted by the other: URLs are what is compared, at most three a side
    urls = lambda place: F.collect_set(F.when(F.col(place) <= 3, F.col("url")))
    sums = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), *extra, top("pr").alias("dcg"), top("tr").alias("ideal"), urls("pr").alias("p"), urls("ar").alias("a"),
        F.sum(dt * dp).alias("tp"), F.sum(dt * dt).alias("tt"), F.sum(dp * dp).alias("pp"),
    )
    usable = (F.col("tt") > 0) & (F.col("pp") > 0)
    others = [c for c in sums.columns if c not in ("dcg", "ideal", "p", "a", "tp", "tt", "pp")]
    return sums.select(
        *others, ratio(F.col("dcg"), F.col("ideal")).alias("ndcg"), F.when(usable, F.col("tp") / F.sqrt(F.col("tt") * F.col("pp"))).alias("spearman"),
        flag(F.arrays_overlap("p", "a")).cast("double").alias("top3_hit"),
    )


def query_metrics(predictions: DataFrame, keys: Sequence[str] = QUERY_KEYS, extra: Sequence[Column] = (), carried: Sequence[str] = (), own: int = order.OWN, dealt: bool = False) -> DataFrame:
    """All metrics of every group, and ``extra`` aggregates over the ``carried`` columns.

    Rows are dealt once by group. A group of more rows than one task should
    hold (``order.large_keys``) is measured metric by metric instead. ``dealt``:
    rows lie by one of the keys already, and one task holds those of each.
    """
    slim = predictions.select(*keys, *carried, "url", "rank", "target_score", "prediction")
    large = None if dealt else order.large_keys(slim.select(*keys), keys, own)
    if large is None:
        return _metrics_together(slim, keys, extra)
    cut, on = F.broadcast(large), list(keys)
    few, many = _metrics_together(slim.join(cut, on, "left_anti"), keys, extra), _metrics_apart(slim.join(cut, on, "left_semi"), keys, extra)
    return few.unionByName(many)


def _mean_columns() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("queries"),
        F.coalesce(rnd(F.avg("spearman"), 6), F.lit(0.0)).alias("spearman_mean"),
        rnd(F.avg("ndcg"), 6).alias("ndcg_at_10"),
        rnd(F.avg("top3_hit"), 6).alias("top_3_hit_rate"),
    ]


def mean_metrics(per_query: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    return per_query.groupBy(*keys).agg(*_mean_columns())


def query_breakdown(predictions: DataFrame) -> DataFrame:
    """Metrics per query; the intent is "mixed" where a query has several."""
    known = F.coalesce("intent", F.lit("unknown"))
    measured = query_metrics(predictions, extra=[F.min(known).alias("lo"), F.max(known).alias("hi")], carried=["intent"])
    label = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("mixed")
    return measured.select(
        *QUERY_KEYS, label.alias("intent"), "rows",
        F.coalesce(rnd(F.col("spearman"), 6), F.lit(0.0)).alias("spearman_mean"),
        rnd(F.col("ndcg"), 6).alias("ndcg_at_10"), F.col("top3_hit").alias("top_3_hit_rate"),
    )


def intent_breakdown(predictions: DataFrame) -> DataFrame:
    """Metrics per intent, averaged over the queries inside it."""
    labelled = predictions.withColumn("intent", F.coalesce("intent", F.lit("unknown")))
    per_query = query_metrics(labelled, ("model", "intent", "query"))
    rows = per_query.groupBy("model", "intent").agg(F.sum("rows").alias("rows"))
    return mean_metrics(per_query, ("model", "intent")).join(rows, ["model", "intent"])


def stability(breakdown: DataFrame, scope: str) -> DataFrame:
    """Population standard deviation of each metric across the groups of a breakdown."""
    spread = lambda name: F.when(F.count(F.lit(1)) < 2, F.lit(0.0)).otherwise(rnd(F.stddev_pop(name), 6))
    return breakdown.groupBy("model").agg(
        F.lit(scope).alias("scope"), F.count(F.lit(1)).alias("groups"),
        spread("spearman_mean").alias("spearman_stddev"), spread("ndcg_at_10").alias("ndcg_stddev"),
        spread("top_3_hit_rate").alias("top3_stddev"),
    )


def model_metrics(predictions: DataFrame, dealt: bool = False) -> DataFrame:
    """Errors and ranking metrics of every model; errors are summed by query where the rows lie, and then added up."""
    error = F.col("prediction") - F.col("target_score")
    sums = [F.count(error).alias("n_errors"), F.sum(error * error).alias("squares"), F.sum(F.abs(error)).alias("sizes")]
    measured = query_metrics(predictions, extra=sums, dealt=dealt).filter(F.col("model").isNotNull())
    mean = lambda name: F.sum(name) / F.nullif(F.sum("n_errors"), F.lit(0))
    return measured.groupBy("model").agg(
        F.sum("rows").alias("rows"), rnd(F.sqrt(mean("squares")), 6).alias("rmse"), rnd(mean("sizes"), 6).alias("mae"), *_mean_columns()
    )


def sort_key() -> Column:
    """Higher is better: rank correlation, then NDCG, then top-3 hits, then low error."""
    return F.struct(F.col("spearman_mean"), F.col("ndcg_at_10"), F.col("top_3_hit_rate"), (-F.col("mae")).alias("neg_mae"))


def candidate_compare(metrics: DataFrame, reference: str) -> DataFrame:
    """Metric differences of every model to the reference; metric tables have one row per model."""
    names = ("spearman_mean", "ndcg_at_10", "top_3_hit_rate", "rmse", "mae")
    base = metrics.filter(F.col("model") == reference).select(*[F.col(n).alias(f"ref_{n}") for n in names], sort_key().alias("ref_key"))
    joined = metrics.filter(F.col("model") != reference).join(F.broadcast(base), F.lit(True))
    wins = sort_key() > F.col("ref_key")
    return joined.select(
        "model", *[rnd(F.col(n) - F.col(f"ref_{n}"), 6).alias(f"delta_{n}") for n in names],
        wins.alias("outperforms_reference"), F.when(wins, "publish_candidate").otherwise("keep_reference").alias("recommendation"),
    )


def top3_regressions(predictions: DataFrame, reference: str, candidate: str) -> DataFrame:
    """Queries the reference hit and the candidate missed, with lost and promoted pages.

    The three top-3 sets are bounded by construction; ties of equal prediction
    and rank go to the later URL, as the reversed sort of the source does.
    """
    slim = predictions.select("model", "query", "url", "rank", "prediction")
    reversed_ties = [F.desc("prediction"), F.asc("rank"), F.desc("url")]
    tops = _top(slim, QUERY_KEYS, reversed_ties, 3).groupBy("query").agg(
        F.array_sort(F.collect_set(F.when(F.col("model") == reference, F.col("url")))).alias("ref_top"),
        F.array_sort(F.collect_set(F.when(F.col("model") == candidate, F.col("url")))).alias("cand_top"),
    )
    actual = (
        _top(slim.filter(F.col("model") == reference), ("query",), [F.asc("rank"), F.asc("url")], 3)
        .groupBy("query").agg(F.array_sort(F.collect_set("url")).alias("actual_top"))
    )
    sets = tops.join(actual, "query").select(
        "query", "actual_top", "cand_top",
        F.arrays_overlap("ref_top", "actual_top").alias("reference_hit"),
        F.arrays_overlap("cand_top", "actual_top").alias("candidate_hit"),
    )
    outcome = (
        F.when(F.col("reference_hit") & ~F.col("candidate_hit"), "regressed")
        .when(~F.col("reference_hit") & F.col("candidate_hit"), "improved")
        .otherwise("same")
    )
    return sets.select(
        "query", "reference_hit", "candidate_hit", outcome.alias("outcome"),
        F.array_except("actual_top", "cand_top").alias("lost_urls"), F.array_except("cand_top", "actual_top").alias("promoted_urls"),
    )


def failure_patterns(
    regressions: DataFrame, rows: DataFrame, top_feature: str = "", top_feature_group: str = "",
    commercial: Sequence[str] = COMMERCIAL_FEATURES,
) -> DataFrame:
    """Pattern labels per regressed query from feature differences between promoted and lost pages."""
    regressed = regressions.filter(F.col("outcome") == "regressed")
    sides = regressed.select(
        "query",
        F.explode(
            F.concat(
                F.transform("lost_urls", lambda u: F.struct(u.alias("url"), F.lit("lost").alias("side"))),
                F.transform("promoted_urls", lambda u: F.struct(u.alias("url"), F.lit("promoted").alias("side"))),
            )
        ).alias("s"),
    ).select("query", "s.url", "s.side")
    mean_of = lambda names: reduce(lambda a, b: a + b, [num(n) for n in names]) / float(len(names))
    measured = rows.select(
        "query", "url", mean_of(TEXT_VOLUME_FEATURES).alias("text"), mean_of(SEMANTIC_FEATURES).alias("semantic"),
        mean_of(TECHNICAL_FEATURES).alias("technical"), mean_of(list(commercial)).alias("commercial"),
        num("rank").alias("position"), flag(is_aggregator(F.col("url"), F.col("domain"), F.col("title"))).alias("aggregator"),
    )
    joined = sides.join(measured, ["query", "url"])
    side_mean = lambda side, name: F.avg(F.when(F.col("side") == side, F.col(name)))
    deltas = joined.groupBy("query").agg(
        *[
            F.coalesce(rnd(side_mean("promoted", n) - side_mean("lost", n), 9), F.lit(0.0)).alias(f"{n}_delta")
            for n in ("text", "semantic", "technical", "commercial", "position")
        ],
        F.max("aggregator").alias("aggregator"),
    )
    always_text = "word_count" in top_feature.lower() or top_feature_group.lower() == "supporting"
    labels = F.array_compact(
        F.array(
            F.when(F.col("aggregator") == 1, F.lit("aggregator_or_marketplace_distortion")),
            F.when(F.col("position_delta") > 2.0, F.lit("rank_prior_disagreement")),
            F.when(F.col("semantic_delta") < -0.05, F.lit("semantic_or_intent_mismatch")),
            F.when(F.lit(always_text) | (F.col("text_delta") > 250), F.lit("shortcut_text_volume")),
            F.when(F.col("technical_delta") < -0.05, F.lit("technical_indexability_mismatch")),
            F.when((F.col("commercial_delta") > 0.08) & (F.col("semantic_delta") <= 0.02), F.lit("weak_commercial_signal_overweighted")),
        )
    )
    named = deltas.withColumn("patterns", labels)
    return named.withColumn(
        "patterns", F.when(F.size("patterns") == 0, F.array(F.lit("unknown_requires_manual_review"))).otherwise(F.col("patterns"))
    )


def preference_accuracy(pairs: DataFrame, predictions: DataFrame) -> DataFrame:
    """Share of pairs whose winner is predicted above the loser, per model.

    Both lookups are joins on (query, url); the pair table is never grouped by
    query, so a hot query only makes its own pairs more numerous.
    """
    scores = predictions.select("model", "query", "url", "prediction")
    winner = scores.select("model", "query", F.col("url").alias("winner_url"), F.col("prediction").alias("w"))
    loser = scores.select("model", "query", F.col("url").alias("loser_url"), F.col("prediction").alias("l"))
    judged = pairs.join(winner, ["query", "winner_url"]).join(loser, ["model", "query", "loser_url"])
    weight = F.when(F.col("weight") == 0, F.lit(1.0)).otherwise(F.col("weight"))
    hit = F.col("w") > F.col("l")
    return judged.groupBy("model").agg(
        F.count(F.lit(1)).alias("evaluated_preferences"),
        rnd(F.avg(hit.cast("double")), 6).alias("accuracy"),
        rnd(F.sum(F.when(hit, weight).otherwise(F.lit(0.0))) / F.sum(weight), 6).alias("weighted_accuracy"),
    )


def label_preference_accuracy(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """``preference_accuracy`` over every pair that the labels imply, counted without building a pair.

    Pairs whose targets differ by a margin or more are the preferences; those
    ordered alike by the prediction are the hits. Both counts per margin are
    dominance counts, so work grows with the pages and not with their pairs.
    """
    scores = predictions.filter(F.col("prediction").isNotNull()).select("model", "query", "url", F.col("prediction").cast("double").alias("prediction"))
    return implied_preference_accuracy(scores.join(labels.select("query", "url", "ranking_target_score"), ["query", "url"]))


def implied_preference_accuracy(scored: DataFrame) -> DataFrame:
    """``label_preference_accuracy`` of rows that carry their label: model, query, ranking_target_score, prediction (not null)."""
    keys = ["model", "query"]
    placed = scored.select(*keys, F.rint(F.col("ranking_target_score") * 1e4).cast("bigint").alias("target"), F.col("prediction").cast("double").alias("place"))
    margins = {"strong": STRONG_MARGIN, "weak": WEAK_MARGIN, "uncertain": UNCERTAIN_MARGIN}
    hits = order.dominated(placed, keys, "target", "place", {name: int(m * 1e4) for name, m in margins.items()})
    pairs = preference_summary(placed.select("model", "query", (F.col("target") / 1e4).alias("ranking_target_score")), keys)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("strength"), F.col(f"{n}_pairs").alias("pairs")) for n in margins])).alias("e")
    at = lambda name: F.coalesce(F.sum(F.when(F.col("margin") == name, F.col("hits"))), F.lit(0))
    found = hits.groupBy("model").agg(at("strong").alias("s"), at("weak").alias("w"), at("uncertain").alias("u"))
    total = pairs.select("model", each).groupBy("model").agg(*[F.sum(F.when(F.col("e.strength") == n, F.col("e.pairs"))).alias(f"n_{n}") for n in margins])
    wide = total.join(found, "model", "left").na.fill(0, ["s", "w", "u"])
    # counts of a margin include those of the larger ones
    hit = {"strong": F.col("s"), "weak": F.col("w") - F.col("s"), "uncertain": F.col("u") - F.col("w")}
    weight = {n: 1.0 if WEIGHTS[n] == 0 else WEIGHTS[n] for n in margins}
    evaluated = F.col("n_strong") + F.col("n_weak") + F.col("n_uncertain")
    weigh = lambda counts: reduce(lambda a, b: a + b, [counts[n] * F.lit(weight[n]) for n in margins])
    return wide.filter(evaluated > 0).select(
        "model", evaluated.alias("evaluated_preferences"), rnd(F.col("u") / evaluated, 6).alias("accuracy"),
        rnd(weigh(hit) / weigh({n: F.col(f"n_{n}") for n in margins}), 6).alias("weighted_accuracy"),
    )


def prediction_delta(rows: DataFrame, primary: str, candidate: str) -> DataFrame:
    """Summary of candidate minus primary over all rows; the quantile is that of the unrounded differences."""
    delta = rows.select((F.col(candidate) - F.col(primary)).alias("d"), F.col(candidate).alias("c"))
    sums = delta.groupBy().agg(
        F.count(F.lit(1)).alias("rows"), rnd(F.avg("d"), 6).alias("mean_delta"), rnd(F.avg(F.abs("d")), 6).alias("mean_abs_delta"),
        rnd(F.max(F.abs("d")), 6).alias("max_abs_delta"), F.count_if(F.col("c") < 0).alias("below_zero"), F.count_if(F.col("c") > 100).alias("above_hundred"),
    )
    spread = order.quantiles(delta.select(F.abs("d").alias("d")), [], "d", {"p95": 0.95}).select(rnd(F.col("p95"), 6).alias("p95_abs_delta"))
    joined = sums.join(F.broadcast(spread), F.lit(True), "left")
    return joined.select("rows", "mean_delta", "mean_abs_delta", "p95_abs_delta", "max_abs_delta", "below_zero", "above_hundred")


def relative_consistency(rows: DataFrame, primary: str, candidate: str) -> DataFrame:
    """How often weak rows are boosted and strong rows dropped by the candidate."""
    delta = F.col(candidate) - F.col(primary)
    low = (num("serp_relative_percentile") < 0.35) | (num("serp_relative_gap_score") < 0.55)
    high = (num("serp_relative_percentile") >= 0.65) & (num("serp_relative_gap_score") >= 0.75)
    counts = rows.groupBy().agg(
        F.count_if(low).alias("low_relative_rows"), F.count_if(high).alias("high_relative_rows"),
        F.count_if(low & (delta > 5)).alias("low_relative_boost_violations"),
        F.count_if(high & (delta < -5)).alias("high_relative_drop_violations"),
    )
    rated = counts.select(
        "*",
        rnd(ratio(F.col("low_relative_boost_violations"), F.col("low_relative_rows")), 6).alias("low_violation_rate"),
        rnd(ratio(F.col("high_relative_drop_violations"), F.col("high_relative_rows")), 6).alias("high_violation_rate"),
    )
    return rated.withColumn("passed", (F.col("low_violation_rate") <= 0.2) & (F.col("high_violation_rate") <= 0.2))


def prediction_bounds(predictions: DataFrame) -> DataFrame:
    bounds = predictions.groupBy("model").agg(
        F.count(F.lit(1)).alias("rows"), rnd(F.min("prediction"), 6).alias("min_score"), rnd(F.max("prediction"), 6).alias("max_score"),
        F.count_if(F.col("prediction") < 0).alias("below_zero_count"), F.count_if(F.col("prediction") > 100).alias("above_hundred_count"),
    )
    return bounds.withColumn("passed", (F.col("rows") > 0) & (F.col("below_zero_count") == 0) & (F.col("above_hundred_count") == 0))


def check_rows(wide: DataFrame, checks: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Turn named conditions over a one-row-per-key table into (keys, check, passed) rows."""
    entries = F.array(*[F.struct(F.lit(name).alias("check_name"), F.coalesce(cond, F.lit(False)).alias("passed")) for name, cond in checks.items()])
    return wide.select(*keys, F.explode(entries).alias("c")).select(*keys, "c.check_name", "c.passed")


def band_guardrails(rows: DataFrame, raw: str, runtime: str, min_rows: int = 40, split_valid: bool = True, contract_present: bool = True) -> DataFrame:
    """The product checks per relevance band over predictions, in one aggregate pass."""
    band, hard = F.col("band"), F.col("hard_negative") == 1
    mismatch = F.coalesce(F.col("relevance_multiplier"), F.lit(1.0)) <= 0.15
    strong = band == "strong_match"
    low_base = strong & (F.coalesce("base_score", "target_score") <= 55)
    commercial_words = "|".join(COMMERCIAL_QUERY_TERMS)
    plain = strong & ~F.lower(F.coalesce("query", F.lit(""))).rlike(commercial_words)
    value, model = F.col(runtime), F.col(raw)
    above = lambda condition, limit: F.count_if(condition & (value > limit))
    mean_if = lambda condition: stable_mean(F.when(condition, value), 4)
    wide = rows.groupBy().agg(
        F.count(F.lit(1)).alias("rows"), above(mismatch, 35.0).alias("unrelated_above"), F.count_if(mismatch).alias("mismatch_rows"),
        F.count_if(mismatch & (value <= 20)).alias("mismatch_low"),
        above(band == "full_mismatch", 5.0).alias("full_above"), above(band == "probable_mismatch", 25.0).alias("probable_above"),
        above(band == "weak_match", 55.0).alias("weak_above"), above(band == "partial_match", 80.0).alias("partial_above"),
        F.count_if(hard & (model > HARD_NEGATIVE_CAP)).alias("hard_above"), F.count_if(strong).alias("strong_rows"),
        mean_if(strong).alias("strong_mean"), F.count_if(low_base).alias("strong_low_rows"), mean_if(low_base).alias("strong_low_mean"),
        F.max(F.when(low_base, value)).alias("strong_low_max"), F.count_if(plain).alias("plain_rows"), mean_if(plain).alias("plain_mean"),
    )
    checks = {
        "candidate_available": F.lit(True),
        "validation_rows_present": F.col("rows") >= min_rows,
        "materialized_split_valid": F.lit(split_valid),
        "unrelated_pages_not_above_35": F.col("unrelated_above") == 0,
        "mismatch_below_20_ratio": ratio(F.col("mismatch_low"), F.col("mismatch_rows"), 1.0) >= 0.9,
        "full_mismatch_runtime_cap_5": F.col("full_above") == 0,
        "probable_mismatch_runtime_cap_25": F.col("probable_above") == 0,
        "weak_match_runtime_cap_55": F.col("weak_above") == 0,
        "partial_match_runtime_cap_80": F.col("partial_above") == 0,
        "hard_negatives_learned_below_cap": F.col("hard_above") == 0,
        "strong_relevance_not_collapsed": (F.col("strong_rows") == 0) | (F.col("strong_mean") >= 45),
        "strong_relevance_with_weak_seo_not_overrated": (F.col("strong_low_rows") == 0)
        | ((F.col("strong_low_mean") <= 55) & (F.col("strong_low_max") <= 65)),
        "noncommercial_relevant_pages_not_cut": (F.col("plain_rows") == 0) | (F.col("plain_mean") >= 45),
        "score_contract_version_present": F.lit(contract_present),
    }
    return check_rows(wide, checks)


def failure_samples(rows: DataFrame, raw: str, runtime: str, limit: int = 8) -> DataFrame:
    """First rows, by query and URL, that break the hard-negative and unrelated-page limits."""
    hard = (F.col("hard_negative") == 1) & (F.col(raw) > HARD_NEGATIVE_CAP)
    unrelated = (F.coalesce(F.col("relevance_multiplier"), F.lit(1.0)) <= 0.15) & (F.col(runtime) > 35)
    kinds = F.array_compact(F.array(F.when(hard, F.lit("hard_negative_above_cap")), F.when(unrelated, F.lit("unrelated_above_35"))))
    listed = rows.select("query", "url", "band", F.col(raw).alias("raw_prediction"), F.col(runtime).alias("runtime_prediction"), F.explode(kinds).alias("sample"))
    return _top(listed, ("sample",), [F.asc("query"), F.asc("url")], limit).drop("rn")


def release_gate(metrics: DataFrame, reference: str, families: dict[str, str] | None = None, evidence: dict[str, bool] | None = None) -> DataFrame:
    """Checks of every candidate against the reference with tolerances; one row per (model, check)."""
    given = {"feature_importance_available": True, "runtime_explanations_bounded": True, "explainability_sensible": True, **(evidence or {})}
    names = ("spearman_mean", "ndcg_at_10", "top_3_hit_rate", "rmse", "mae")
    base = metrics.filter(F.col("model") == reference).select(*[F.col(n).alias(f"ref_{n}") for n in names])
    wide = metrics.filter(F.col("model") != reference).join(F.broadcast(base), F.lit(True))
    limit = lambda n: rnd(F.col(f"ref_{n}") * F.lit(1.0 + ABSOLUTE_ERROR_TOLERANCE), 6)
    checks = {
        "candidate_available": F.lit(True),
        "ndcg_at_10_not_worse": F.col("ndcg_at_10") >= F.col("ref_ndcg_at_10"),
        "top_3_hit_rate_not_worse": F.col("top_3_hit_rate") >= F.col("ref_top_3_hit_rate"),
        "spearman_mean_not_worse": F.col("spearman_mean") >= F.col("ref_spearman_mean"),
        "rmse_comparable_or_better": F.col("rmse") <= limit("rmse"),
        "mae_comparable_or_better": F.col("mae") <= limit("mae"),
        **{name: F.lit(value) for name, value in given.items()},
    }
    ranking = [m for m, family in (families or {}).items() if family == "ranking"]
    if ranking:
        checks["ranking_family_absolute_error_viable"] = ~F.col("model").isin(*ranking) | (F.col("mae") <= RANKING_FAMILY_MAE_LIMIT)
    return check_rows(wide, checks, ["model"])


def release_decision(gates: DataFrame, metrics: DataFrame, reference: str) -> DataFrame:
    """publish_candidate or keep_reference with the reason, from gate rows and metrics (one row per model)."""
    passed = gates.groupBy("model").agg(F.every("passed").alias("gate_passed"))
    keyed = metrics.join(passed, "model", "left").select("model", "gate_passed", sort_key().alias("key"))
    best = keyed.groupBy().agg(
        F.max(F.when((F.col("model") != reference) & F.col("gate_passed"), F.col("key"))).alias("best_key"),
        F.max_by("model", F.when((F.col("model") != reference) & F.col("gate_passed"), F.col("key"))).alias("best_model"),
        F.max(F.when(F.col("model") == reference, F.col("key"))).alias("reference_key"),
    )
    none, wins = F.col("best_key").isNull(), F.col("best_key") > F.col("reference_key")
    return best.select(
        F.when(none | ~wins, "keep_reference").otherwise("publish_candidate").alias("recommendation"),
        F.when(~none, F.col("best_model")).alias("selected_candidate"),
        F.when(none, "no_candidate_passed_all_publish_gates")
        .when(wins, "candidate_passed_all_publish_gates_and_outperformed_reference")
        .otherwise("best_gate_passing_candidate_does_not_outperform_reference_sort_key").alias("reason"),
    )


def replay_guardrails(items: DataFrame, evidence: DataFrame, active_models: Sequence[str] = (), min_coverage: float = 0.5) -> DataFrame:
    """Catalogue left join stored evidence: one row per (item, check) with pass, warn or fail."""
    rows = items.join(evidence, "id", "left")
    found, analyzed = num("competitors_found"), num("competitors_analyzed")
    ok = lambda condition: F.when(F.coalesce(condition, F.lit(False)), "pass").otherwise("fail")
    checks = {
        "audit_status": ok(F.col("audit_status").isin("completed", "completed_with_warnings")),
        "score_boundedness": ok(F.col("score").between(0.0, 100.0)),
        "competitor_coverage": ok((analyzed >= 1) & (ratio(analyzed, found) >= min_coverage)),
        "recommendation_availability": ok(num("recommendations_count") >= 1),
        "model_metadata_presence": ok(F.col("model_key").isNotNull()),
        "runtime_warnings": F.when(num("warning_messages") > 0, "warn").otherwise("pass"),
    }
    if active_models:
        checks["active_model_match"] = F.when(F.col("model_key").isNotNull(), ok(F.col("model_key").isin(*active_models)))
    entries = F.array(*[F.struct(F.lit(name).alias("check_name"), status.alias("status")) for name, status in checks.items()])
    return rows.select("id", F.explode(entries).alias("c")).select("id", "c.*").filter(F.col("status").isNotNull())


def replay_decisions(checks: DataFrame) -> DataFrame:
    counts = checks.groupBy("id").agg(
        F.count_if(F.col("status") == "fail").alias("failed"), F.count_if(F.col("status") == "warn").alias("warned"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "fail", F.col("check_name")))).alias("failed_checks"),
    )
    decision = F.when(F.col("failed") > 0, "failed").when(F.col("warned") > 0, "warning").otherwise("passed")
    return counts.select("id", decision.alias("decision"), "failed", "warned", F.concat_ws(",", "failed_checks").alias("failed_checks"))
