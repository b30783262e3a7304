"""Training-table building: seeds, caps, label joins, splits, coverage and quality checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import urls
from rankloom.functions.numeric import (
    clip, first_by_hash, floor_position, index_percentile, nearest_position, num, numbered_by_hash, ratio, rnd,
    value_histogram,
)
from rankloom.operators.evaluation import check_rows

# --- fixed values -----------------------------------------------------------
SEED_CITIES = (
    ("Москва", 213), ("Санкт-Петербург", 2), ("Екатеринбург", 54), ("Новосибирск", 65), ("Казань", 43), ("Краснодар", 35),
    ("Самара", 51), ("Нижний Новгород", 47),
)
# template, intent, uses a city
SEED_PATTERNS = (
    ("{category} {city}", "commercial", True),
    ("{category} цена {city}", "commercial", True),
    ("как выбрать {category}", "informational", False),
    ("{category} отзывы", "informational", False),
)
QUALITY_THRESHOLDS = (
    ("min_rows", "rows_count", 400.0, "min"),
    ("min_unique_queries", "unique_queries", 40.0, "min"),
    ("min_unique_domains", "unique_domains", 250.0, "min"),
    ("min_unique_categories", "unique_categories", 6.0, "min"),
    ("min_unique_cities", "unique_cities", 6.0, "min"),
    ("min_query_coverage_ratio", "query_coverage_ratio", 0.2, "min"),
    ("min_average_rows_per_query", "average_rows_per_query", 5.0, "min"),
    ("max_failure_rate", "failure_rate", 0.2, "max"),
)
DOMAIN_CAP = 12
MIN_FINAL_QUERIES, MIN_FINAL_CATEGORIES, MIN_FINAL_CITIES = 500, 50, 5
MIN_VALIDATION_ROWS = 40
HARD_NEGATIVE_CAP = 35.0
SHORTCUT_CAPS = {
    "text_length_chars": 9600.0, "html_length_chars": 60000.0, "word_count": 1600.0, "unique_word_count": 1200.0,
    "sentence_count": 90.0, "paragraph_count": 36.0, "avg_sentence_length": 38.0, "avg_paragraph_length": 180.0,
    "h1_count": 2.0, "h2_count": 10.0, "h3_count": 12.0, "heading_count": 18.0, "link_count": 80.0, "image_count": 24.0,
    "list_item_count": 40.0, "strong_tag_count": 24.0, "link_density_per_1000_words": 80.0,
    "image_density_per_1000_words": 28.0, "list_density_per_1000_words": 60.0, "strong_density_per_1000_words": 40.0,
    "content_link_ratio": 80.0, "structured_data_valid_json_ld_count": 4.0,
}
UNIT_FEATURES = (
    "unique_word_ratio", "title_keyword_coverage_ratio", "meta_keyword_coverage_ratio", "heading_query_coverage_ratio",
    "early_query_coverage_ratio", "keyword_coverage_ratio", "text_to_html_ratio", "semantic_similarity",
    "query_semantic_alignment", "title_semantic_alignment", "heading_semantic_alignment", "title_heading_keyword_alignment",
    "content_depth_semantic_score", "query_prominence_score", "title_length_quality", "meta_length_quality",
    "keyword_balance_score", "semantic_content_richness", "cta_semantic_score", "canonical_signal_score",
    "technical_seo_score", "technical_metadata_score", "redirect_efficiency_score", "url_hygiene_score",
    "commercial_signals_score", "trust_signals_score", "contact_options_score", "commercial_trust_score",
    "mobile_readiness_score", "rendering_score", "performance_proxy_score", "performance_resource_complexity_score",
    "heavy_analysis_overall_score", "intent_alignment_score", "commercial_intent_alignment", "local_intent_alignment",
    "informational_intent_alignment", "navigational_intent_alignment",
)
BINARY_SUFFIXES = ("_present", "_ok", "_matches_final_url", "_indexable")
# --- end of fixed values ----------------------------------------------------


def seed_catalog(
    categories: DataFrame, cities: Sequence[tuple[str, int]] = SEED_CITIES,
    patterns: Sequence[tuple[str, str, bool]] = SEED_PATTERNS, top_n: int = 10, pages: int = 2,
) -> DataFrame:
    """Query seeds for every category, pattern and (where the pattern has one) city.

    Cities and patterns are short lists of the caller, so they are exploded
    inside each category row; nothing is joined or shuffled. One row per
    distinct query.
    """
    options = []
    for template, intent, uses_city in patterns:
        for city, region in cities if uses_city else (("", None),):
            query = F.replace(F.lit(template.replace("{city}", city)), F.lit("{category}"), F.col("category"))
            options.append(
                F.struct(query.alias("query"), F.lit(intent).alias("intent"), F.lit(city).alias("city"), F.lit(region).cast("int").alias("region_code"))
            )
    return (
        categories.select("category", F.explode(F.array(*options)).alias("s"))
        .select("s.query", "category", "s.intent", "s.city", "s.region_code", F.lit(max(1, top_n)).alias("top_n"), F.lit(max(1, pages)).alias("pages_to_scan"))
        .dropDuplicates(["query"])
    )


def weak_label(rank: Column, top_n: Column) -> Column:
    """Linear score of a rank: 100 for the first, 0 for the last."""
    held = F.least(F.greatest(rank, F.lit(1)), top_n)
    return F.when((rank <= 1) | (top_n <= 1), F.lit(100.0)).otherwise(
        rnd((top_n - held).cast("double") / (top_n - 1).cast("double") * F.lit(100.0), 4)
    )


def domain_cap(results: DataFrame, existing: DataFrame, cap: int = DOMAIN_CAP, order: Sequence[str] = ("seed_no", "serp_page", "rank", "url")) -> DataFrame:
    """At most ``cap`` rows per domain over the collection, counting rows already stored.

    Only the first ``cap`` rows of a domain can ever be kept, so the window is
    cut to that many rows per task before the shuffle and a hot domain stays
    small. ``existing`` is aggregated first and joined on domain.
    """
    first = results.filter(F.col("domain") != "").withColumn(
        "_n", F.row_number().over(Window.partitionBy("domain").orderBy(*order))
    ).filter(F.col("_n") <= cap)
    stored = existing.groupBy("domain").agg(F.count(F.lit(1)).alias("_stored"))
    return (
        first.join(stored, "domain", "left")
        .filter(F.coalesce("_stored", F.lit(0)) + F.col("_n") <= cap)
        .drop("_n", "_stored")
    )


def last_label(labels: DataFrame, order: str) -> DataFrame:
    """One label per (query, url); the last line wins."""
    kept = [c for c in labels.columns if c not in ("query", "url")]
    return labels.groupBy("query", "url").agg(F.max_by(F.struct(*kept), order).alias("l")).select(
        "query", "url", *[F.col(f"l.{name}").alias(name) for name in kept]
    )


def label_blend(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """0.7 expert + 0.3 weak where an expert label exists, else the weak score."""
    joined = rows.join(labels.select("query", "url", "expert_target_score"), ["query", "url"], "left")
    blended = rnd(F.col("expert_target_score") * F.lit(0.7) + F.col("weak_target_score") * F.lit(0.3), 4)
    return joined.withColumn("label_source", F.when(F.col("expert_target_score").isNull(), "weak_serp").otherwise("hybrid")).withColumn(
        "target_score", F.coalesce(blended, rnd(F.col("weak_target_score"), 4))
    )


def unmatched_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return labels.join(rows.select("query", "url"), ["query", "url"], "left_anti")


def label_apply(rows: DataFrame, labels: DataFrame, strict: bool = True) -> DataFrame:
    """Replace targets by labels; in strict mode a row without a label fails the job."""
    joined = rows.join(labels.select("query", "url", "expert_target_score"), ["query", "url"], "left" if strict else "inner")
    if strict:
        checked = F.when(F.col("expert_target_score").isNull(), F.raise_error(F.concat(F.lit("no label for "), "query", F.lit(" -> "), "url")).cast("double")).otherwise(F.col("expert_target_score"))
        joined = joined.withColumn("expert_target_score", checked)
    new = rnd(clip(F.col("expert_target_score"), 0.0, 100.0), 4)
    return joined.withColumn("old_target_score", F.col("target_score")).withColumn("target_score", new)


def label_coverage(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Applied, missing and unmatched labels from one full outer join."""
    left = rows.select("query", "url", F.lit(1).alias("r"))
    right = labels.select("query", "url", F.lit(1).alias("l"))
    sides = left.join(right, ["query", "url"], "full_outer")
    return sides.groupBy().agg(
        F.count("r").alias("source_rows"), F.count_if(F.col("r").isNotNull() & F.col("l").isNotNull()).alias("labels_applied"),
        F.count_if(F.col("l").isNull()).alias("missing_labels"), F.count_if(F.col("r").isNull()).alias("unmatched_labels"),
    )


def score_stats(scores: DataFrame, keys: Sequence[str], value: str, rule: str = "nearest", nullable: bool = True) -> DataFrame:
    """min, p25, mean, p50, p75, p90, max per key by the nearest-rank or the floor-rank rule.

    Values are rounded to 4 digits and counted first, so every percentile is
    read from a bounded histogram. A value that is never null needs no filter,
    which the optimizer would write out over the whole expression behind it.
    """
    present = scores.filter(F.col(value).isNotNull()) if nullable else scores
    rounded = present.select(*keys, rnd(F.col(value), 4).alias("_v"))
    hist = value_histogram(rounded, keys, "_v")
    position = nearest_position if rule == "nearest" else floor_position
    at = lambda q: index_percentile(hist, keys, "_v", position(F.col("n_total"), q))
    return hist.groupBy(*keys).agg(
        F.max("n_total").alias("n"), F.min("_v").alias("min"), at(0.25).alias("p25"),
        rnd(F.sum(F.rint(F.col("_v") * 1e4) * F.col("n_equal")) / F.max("n_total") / F.lit(1e4), 4).alias("mean"),
        at(0.5).alias("p50"), at(0.75).alias("p75"), at(0.9).alias("p90"), F.max("_v").alias("max"),
    )


def collection_stats(rows: DataFrame, failures: DataFrame) -> DataFrame:
    """Counts and rates over stored rows and failures in one aggregate."""
    both = rows.select("query", "domain", num("text_length_chars").alias("chars"), F.lit(1).alias("ok")).unionByName(
        failures.select(F.lit(None).cast("string").alias("query"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("chars"), F.lit(0).alias("ok"))
    )
    counts = both.groupBy().agg(
        F.count_if(F.col("ok") == 1).alias("rows_count"), F.count_if(F.col("ok") == 0).alias("failures_count"),
        F.countDistinct(F.nullif("query", F.lit(""))).alias("unique_queries"), F.countDistinct(F.nullif("domain", F.lit(""))).alias("unique_domains"),
        F.count_if((F.col("ok") == 1) & (F.col("chars") <= 0)).alias("empty"),
    )
    return counts.select(
        "rows_count", "failures_count", "unique_queries", "unique_domains",
        rnd(ratio(F.col("failures_count"), F.col("rows_count") + F.col("failures_count")), 6).alias("failure_rate"),
        rnd(ratio(F.col("empty"), F.col("rows_count")), 6).alias("empty_text_rate"),
    )


def dimension_coverage(seeds: DataFrame, rows: DataFrame, dimension: str, order: str = "line_no") -> DataFrame:
    """Per value of a dimension: distinct seed queries and successful ones; a query's first value counts."""
    def counted(source: DataFrame, name: str) -> DataFrame:
        clean = source.select(F.trim("query").alias("query"), F.trim(dimension).alias("value"), order).filter(
            (F.col("query") != "") & (F.col("value") != "")
        )
        first = clean.groupBy("query").agg(F.min_by("value", order).alias("value"))
        return first.groupBy("value").agg(F.count(F.lit(1)).alias(name))

    both = counted(seeds, "seed_queries").join(counted(rows, "success_queries"), "value", "full_outer").na.fill(0)
    return both.select("value", "seed_queries", "success_queries", rnd(ratio(F.col("success_queries"), F.col("seed_queries")), 6).alias("coverage_ratio"))


def dataset_manifest(rows: DataFrame, failures: DataFrame, seeds: DataFrame) -> DataFrame:
    """All coverage, rank, label and artifact numbers of a dataset in one row."""
    filled = lambda name: F.nullif(F.trim(F.coalesce(F.col(name), F.lit(""))), F.lit(""))
    stats = rows.groupBy().agg(
        F.count(F.lit(1)).alias("rows_count"), F.countDistinct(filled("query")).alias("unique_queries"),
        F.countDistinct(filled("domain")).alias("unique_domains"), F.countDistinct(filled("category")).alias("unique_categories"),
        F.countDistinct(filled("city")).alias("unique_cities"), F.sum("rank").alias("rank_sum"), F.count("rank").alias("ranked"),
        F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"),
        F.count("expert_target_score").alias("expert_rows_count"), F.count_if(F.col("label_source") == "hybrid").alias("hybrid_rows_count"),
        F.count(filled("artifact_path")).alias("rows_with_artifact_paths"),
    )
    failed = failures.groupBy().agg(F.count(F.lit(1)).alias("failures_count"))
    seeded = seeds.groupBy().agg(F.countDistinct(filled("query")).alias("seed_queries_count"))
    attempted = (
        rows.select("query").unionByName(failures.select("query")).groupBy().agg(F.countDistinct(filled("query")).alias("attempted_queries"))
    )
    # four one-row tables
    wide = reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), [failed, seeded, attempted], stats)
    return wide.select(
        "rows_count", "failures_count", (F.col("rows_count") + F.col("failures_count")).alias("attempts_count"), "unique_queries", "attempted_queries",
        "seed_queries_count", "unique_domains", "unique_categories", "unique_cities",
        rnd(ratio(F.col("unique_queries"), F.col("seed_queries_count"), 1.0), 6).alias("query_coverage_ratio"),
        rnd(ratio(F.col("attempted_queries"), F.col("seed_queries_count"), 1.0), 6).alias("attempted_query_coverage_ratio"),
        rnd(ratio(F.col("rows_count"), F.col("unique_queries")), 6).alias("average_rows_per_query"),
        rnd(ratio(F.col("failures_count"), F.col("rows_count") + F.col("failures_count")), 6).alias("failure_rate"),
        rnd(ratio(F.col("rank_sum"), F.col("ranked")), 6).alias("average_rank"), "best_rank", "worst_rank",
        "expert_rows_count", (F.col("rows_count") - F.col("expert_rows_count")).alias("weak_only_rows_count"), "hybrid_rows_count", "rows_with_artifact_paths",
    )


def top_failures(failures: DataFrame, k: int = 5) -> DataFrame:
    message = F.coalesce(F.nullif(F.trim(F.coalesce("fetch_error", F.lit(""))), F.lit("")), F.lit("unknown_failure"))
    return failures.groupBy(message.alias("message")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "message").limit(k)


def quality_gates(manifest: DataFrame, split: DataFrame | None = None, thresholds: Sequence[tuple[str, str, float, str]] = QUALITY_THRESHOLDS) -> DataFrame:
    """One row per threshold check; with a split also the six split checks (thresholds are inlined)."""
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("check_name"), rnd(F.col(metric).cast("double"), 6).alias("actual"), F.lit(expected).alias("expected"),
                F.lit(comparator).alias("comparator"),
                (F.col(metric) >= expected if comparator == "min" else F.col(metric) <= expected).alias("passed"),
            )
            for name, metric, expected, comparator in thresholds
        ]
    )
    gates = manifest.select(F.explode(entries).alias("g")).select("g.*")
    if split is None:
        return gates
    counts = split.groupBy("query").agg(
        F.bool_or(F.col("partition").isin("train", "both")).alias("t"), F.bool_or(F.col("partition").isin("validation", "both")).alias("v"),
        F.min("split_mode").alias("split_mode"),
    ).groupBy().agg(
        F.count(F.lit(1)).alias("n"), F.count_if("t").alias("t"), F.count_if("v").alias("v"), F.count_if(F.col("t") & F.col("v")).alias("both"),
        F.min("split_mode").alias("lo"), F.max("split_mode").alias("hi"),
    )
    wide = counts.join(F.broadcast(manifest.select("unique_queries")), F.lit(True))
    checks = {
        "split_present": F.col("n") > 0, "split_group_by_query": (F.col("lo") == "group_by_query") & (F.col("hi") == "group_by_query"),
        "split_train_queries_present": F.col("t") > 0, "split_validation_queries_present": F.col("v") > 0,
        "split_query_partitions_disjoint": F.col("both") == 0, "split_covers_dataset_queries": F.col("n") == F.col("unique_queries"),
    }
    extra = check_rows(wide, checks).select(
        "check_name", F.col("passed").cast("double").alias("actual"), F.lit(1.0).alias("expected"), F.lit("is").alias("comparator"), "passed"
    )
    return gates.unionByName(extra)


def split_hash(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("query")))


def group_split(rows: DataFrame, size: float = 0.2, seed: int = 42) -> DataFrame:
    """query -> train or validation so that no query is in both.

    The validation queries are the ceil(size * n) smallest hashes, found
    exactly without a global sort.
    """
    queries = rows.select(F.trim("query").alias("query")).filter(F.col("query") != "").distinct().withColumn("h", split_hash(seed))
    marked = first_by_hash(queries, [], "h", F.ceil(F.col("n_total") * F.lit(size)))
    return marked.select(
        "query", F.when(F.col("chosen"), "validation").otherwise("train").alias("partition"), F.lit("group_by_query").alias("split_mode")
    )


def with_group_split(rows: DataFrame, size: float = 0.2, seed: int = 42) -> DataFrame:
    """``with_partition`` of the rows' own ``group_split``, without a join by query.

    Validation queries are those up to a cut of the hashes, so every row is
    placed by its own hash and wide rows stay where they are.
    """
    cut = group_split(rows, size, seed).filter("partition = 'validation'").select(F.max(split_hash(seed)).alias("_cut"))
    known = rows.filter((F.col("query") != "") & (F.col("query") == F.trim("query")))
    placed = known.join(F.broadcast(cut), F.lit(True)).withColumn("partition", F.when(split_hash(seed) <= F.col("_cut"), "validation").otherwise("train"))
    return placed.drop("_cut")


def majority(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent non-empty value per key, the smaller value on ties."""
    counts = rows.filter(F.trim(value) != "").groupBy(key, F.trim(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(key).agg(F.min_by("_v", F.struct(-F.col("_n"), F.col("_v"))).alias(value))


def stratified_split(rows: DataFrame, size: float = 0.2, seed: int = 42) -> DataFrame:
    """Group split inside each query's majority category: at least one, never all (unless there is just one)."""
    queries = majority(rows.withColumn("query", F.trim("query")), "query", "category")
    every = rows.select(F.trim("query").alias("query")).distinct().join(queries, "query", "left").na.fill("unknown", ["category"])
    wanted = F.greatest(F.lit(1), F.rint(F.col("n_total") * F.lit(size)).cast("bigint"))
    wanted = F.when((wanted >= F.col("n_total")) & (F.col("n_total") > 1), F.col("n_total") - 1).otherwise(wanted)
    marked = first_by_hash(every.withColumn("h", split_hash(seed)), ["category"], "h", wanted)
    return marked.select(
        "query", "category", F.when(F.col("chosen"), "validation").otherwise("train").alias("partition"),
        F.lit("group_by_query_category_stratified").alias("split_mode"),
    )


def split_assignment(train: DataFrame, validation: DataFrame) -> DataFrame:
    """query -> train, validation or both from two row sets."""
    sides = train.select("query", F.lit(True).alias("t"), F.lit(False).alias("v")).unionByName(
        validation.select("query", F.lit(False).alias("t"), F.lit(True).alias("v"))
    )
    marked = sides.filter(F.trim("query") != "").groupBy("query").agg(F.bool_or("t").alias("t"), F.bool_or("v").alias("v"), F.count(F.lit(1)).alias("rows"))
    name = F.when(F.col("t") & F.col("v"), "both").when(F.col("t"), "train").otherwise("validation")
    return marked.select("query", name.alias("partition"), "rows")


def split_leakage(rows: DataFrame, split: DataFrame) -> DataFrame:
    """Queries in both parts, labelled queries outside the split and split queries without rows."""
    labelled = rows.select(F.trim("query").alias("query")).filter(F.col("query") != "").distinct()
    parts = split.groupBy("query").agg(
        F.bool_or(F.col("partition").isin("train", "both")).alias("t"), F.bool_or(F.col("partition").isin("validation", "both")).alias("v")
    )
    sides = labelled.withColumn("r", F.lit(True)).join(parts.withColumn("s", F.lit(True)), "query", "full_outer").na.fill(False)
    counts = sides.groupBy().agg(
        F.count_if("r").alias("label_queries"), F.count_if("t").alias("train_queries"), F.count_if("v").alias("validation_queries"),
        F.count_if(F.col("t") & F.col("v")).alias("query_overlap"), F.count_if(F.col("r") & ~F.col("s")).alias("uncovered_queries"),
        F.count_if(F.col("s") & ~F.col("r")).alias("extra_queries"),
    )
    return counts.withColumn("passed", (F.col("query_overlap") == 0) & (F.col("uncovered_queries") == 0) & (F.col("label_queries") > 0))


def with_partition(rows: DataFrame, split: DataFrame) -> DataFrame:
    return rows.join(split.select("query", "partition").distinct(), "query")


def split_validation(rows: DataFrame, split: DataFrame, schema_version: str) -> DataFrame:
    """The 17 checks of a labelled split. Dimensions are reduced to one row per value before comparing."""
    joined = rows.join(split.select("query", "partition"), "query", "left")
    train, validation = F.col("partition") == "train", F.col("partition") == "validation"
    hard = F.col("hard_negative") == 1
    totals = joined.groupBy().agg(
        F.count(F.lit(1)).alias("n"), F.count_if(train).alias("nt"), F.count_if(validation).alias("nv"), F.count_if(hard & train).alias("ht"),
        F.count_if(hard & validation).alias("hv"), F.count_if(hard & (F.col("target_score") > HARD_NEGATIVE_CAP)).alias("above"),
        F.count_if(F.col("target_score").isNull()).alias("missing"), F.count_if(~F.col("label_schema_version").eqNullSafe(F.lit(schema_version))).alias("schema"),
    )

    def lacking(dimension: str) -> DataFrame:
        per_value = joined.filter(F.trim(dimension) != "").groupBy(dimension).agg(
            F.coalesce(F.bool_or(train), F.lit(False)).alias("t"), F.coalesce(F.bool_or(validation), F.lit(False)).alias("v")
        )
        return per_value.groupBy().agg(F.count_if(~F.col("t")).alias(f"{dimension}_t"), F.count_if(~F.col("v")).alias(f"{dimension}_v"))

    modes = split.groupBy().agg(F.count(F.lit(1)).alias("sn"), F.every(F.col("split_mode").startswith("group_by_query")).alias("grouped"))
    leak = split_leakage(rows, split)
    wide = reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), [lacking("category"), lacking("city"), modes, leak], totals)
    floor = F.least(F.lit(MIN_VALIDATION_ROWS), F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(0.2))))
    return check_rows(
        wide,
        {
            "split_exists": F.col("sn") > 0, "split_mode_grouped": F.col("grouped"), "query_overlap_absent": F.col("query_overlap") == 0,
            "all_labeled_queries_covered": F.col("uncovered_queries") == 0, "no_extra_split_queries": F.col("extra_queries") == 0,
            "train_rows_present": F.col("nt") > 0, "validation_rows_present": F.col("nv") >= floor,
            "validation_queries_present": F.col("validation_queries") > 0, "categories_present_in_train": F.col("category_t") == 0,
            "categories_present_in_validation": F.col("category_v") == 0, "cities_present_in_train": F.col("city_t") == 0,
            "cities_present_in_validation": F.col("city_v") == 0, "hard_negatives_in_train": F.col("ht") > 0,
            "hard_negatives_in_validation": F.col("hv") > 0, "hard_negative_cap_respected": F.col("above") == 0,
            "target_scores_present": F.col("missing") == 0, "label_schema_consistent": F.col("schema") == 0,
        },
    )


def partition_stats(rows: DataFrame) -> DataFrame:
    """Per partition: sizes, distinct counts, largest domain, hard negatives and floor-rank score percentiles."""
    hard = F.col("hard_negative") == 1
    per_domain = rows.filter(F.trim("domain") != "").groupBy("partition", "domain").agg(F.count(F.lit(1)).alias("n"))
    domains = per_domain.groupBy("partition").agg(F.count(F.lit(1)).alias("domains"), F.max("n").alias("max_domain_rows"))
    base = rows.groupBy("partition").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("query").alias("queries"), F.countDistinct("category").alias("categories"),
        F.countDistinct("city").alias("cities"), F.count_if(hard).alias("hard_negative_rows"),
        F.countDistinct(F.when(hard, F.col("query"))).alias("hard_negative_queries"),
        F.count_if(hard & (F.col("target_score") > HARD_NEGATIVE_CAP)).alias("hard_negative_above_cap"),
    )
    scores = score_stats(rows, ["partition"], "target_score", "floor").select("partition", "min", "p25", "p50", "p75", "p90", "max")
    return base.join(domains, "partition", "left").join(scores, "partition", "left")


def histogram(rows: DataFrame, keys: Sequence[str], value: Column, kind: str) -> DataFrame:
    return rows.groupBy(*keys, F.lit(kind).alias("kind"), value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def coverage_levels(rows: DataFrame, value: str) -> DataFrame:
    """Least, floor-rank quartiles and 90th percentile, and largest value of a coverage column, in one row."""
    stats = score_stats(rows.withColumn("_all", F.lit(0)), ["_all"], value, "floor")
    return stats.select(*[rnd(F.col(c), 4).alias(f"coverage_{c}") for c in ("min", "p25", "p50", "p75", "p90", "max")])


def controlled(name: str) -> Column:
    """Feature value under the policy: never negative, shortcuts capped, unit and binary features at most 1."""
    value = F.greatest(F.lit(0.0), num(name))
    if name in SHORTCUT_CAPS:
        return F.least(value, F.lit(SHORTCUT_CAPS[name]))
    if name in UNIT_FEATURES or name.endswith(BINARY_SUFFIXES) or name.startswith("intent_is_"):
        return F.least(value, F.lit(1.0))
    return value


def feature_caps(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return rows.withColumns({name: controlled(name) for name in features})


def feature_caps_report(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Affected rows and the largest value before and after, per feature, from one aggregate."""
    aggregates = []
    for name in features:
        before, after = num(name), controlled(name)
        aggregates.append(
            F.struct(
                F.lit(name).alias("feature"), F.lit("shortcut" if name in SHORTCUT_CAPS else "bounded").alias("kind"),
                F.count_if(before != after).alias("affected_rows"), F.greatest(F.lit(0.0), F.max(before)).alias("max_before"), F.max(after).alias("max_after"),
            ).alias(f"f_{name}")
        )
    wide = rows.groupBy().agg(*aggregates)
    return wide.select(F.explode(F.array(*[F.col(f"f_{name}") for name in features])).alias("f")).select("f.*")


def dataset_readiness(rows: DataFrame, hard_required: bool = True, cap: int = DOMAIN_CAP) -> DataFrame:
    """Minimum queries, categories and cities, the domain cap and the presence of hard negatives."""
    filled = lambda name: F.nullif(F.trim(F.coalesce(F.col(name), F.lit(""))), F.lit(""))
    counts = rows.groupBy().agg(
        F.countDistinct(filled("query")).alias("q"), F.countDistinct(filled("category")).alias("c"), F.countDistinct(filled("city")).alias("t"),
        F.count_if(F.col("hard_negative") == 1).alias("h"),
    )
    largest = rows.filter(F.trim("domain") != "").groupBy("domain").agg(F.count(F.lit(1)).alias("n")).groupBy().agg(F.coalesce(F.max("n"), F.lit(0)).alias("d"))
    wide = counts.join(F.broadcast(largest), F.lit(True))
    return check_rows(
        wide,
        {
            "hard_negatives_present": (F.col("h") > 0) | F.lit(not hard_required), "min_queries": F.col("q") >= MIN_FINAL_QUERIES,
            "min_categories": F.col("c") >= MIN_FINAL_CATEGORIES, "min_cities": F.col("t") >= MIN_FINAL_CITIES, "domain_cap": F.col("d") <= cap,
        },
    )


def page_type(url: Column) -> Column:
    """homepage, article, product, category or content from the path."""
    route = F.lower(urls.path(url))
    has = lambda *tokens: route.rlike("|".join(tokens))
    return (
        F.when(route.isin("", "/"), "homepage").when(has("blog", "article", "news", "post"), "article")
        .when(has("product", "catalog", "shop", "item"), "product").when(has("service", "solutions", "category"), "category")
        .otherwise("content")
    )


def append_new(results: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose (query, url) is not stored yet, one per key."""
    fresh = results.filter(F.trim("url") != "").dropDuplicates(["query", "url"])
    return fresh.join(stored.select("query", "url"), ["query", "url"], "left_anti")


_EXTREME_SHIFT = {
    True: {"product": 4.0, "category": 3.0, "homepage": 2.0, "content": -2.0, "article": -8.0},
    False: {"article": 4.0, "content": 3.0, "product": -3.0},
}


def extreme_score(rows: DataFrame) -> DataFrame:
    """Landing-page score used to pick label candidates."""
    unit = lambda name: clip(num(name), 0.0, 1.0)
    semantic = clip((num("semantic_similarity") + 0.05) / 0.95, 0.0, 1.0)
    depth = clip(num("word_count") / 1800.0, 0.0, 1.0)
    fallback = (
        F.lit(0.35) * unit("title_keyword_coverage_ratio") + F.lit(0.25) * unit("heading_query_coverage_ratio")
        + F.lit(0.25) * unit("early_query_coverage_ratio") + F.lit(0.15) * unit("keyword_coverage_ratio")
    )
    prominence = clip(F.coalesce(F.col("query_prominence_score"), fallback), 0.0, 1.0)
    fit = clip(
        F.lit(0.25) * unit("title_keyword_coverage_ratio") + F.lit(0.20) * unit("heading_query_coverage_ratio")
        + F.lit(0.20) * unit("query_in_text") + F.lit(0.15) * unit("query_in_title") + F.lit(0.20) * prominence, 0.0, 1.0,
    )
    raw = F.lit(100.0) * (
        F.lit(0.22) * semantic + F.lit(0.17) * unit("keyword_coverage_ratio") + F.lit(0.18) * unit("commercial_trust_score")
        + F.lit(0.13) * unit("technical_seo_score") + F.lit(0.14) * depth + F.lit(0.11) * fit
        + F.lit(0.05) * clip(num("weak_target_score") / 100.0, 0.0, 1.0)
    )
    shift = lambda commercial: reduce(
        lambda rest, kv: F.when(F.col("page_type") == kv[0], F.lit(kv[1])).otherwise(rest), _EXTREME_SHIFT[commercial].items(), F.lit(0.0)
    )
    penalty = lambda condition, points: F.when(condition, F.lit(points)).otherwise(F.lit(0.0))
    words = num("word_count")
    total = (
        raw + F.when(F.coalesce(F.nullif(F.trim("intent"), F.lit("")), F.lit("commercial")) == "commercial", shift(True)).otherwise(shift(False))
        - F.when(words < 100, F.lit(35.0)).when(words < 250, F.lit(22.0)).when(words < 600, F.lit(8.0)).otherwise(F.lit(0.0))
        - penalty(num("page_indexable", 1.0) < 1, 15.0) - penalty(num("http_status_ok", 1.0) < 1, 20.0)
        - penalty(unit("commercial_trust_score") < 0.25, 8.0) - penalty(unit("technical_seo_score") < 0.5, 6.0)
        - penalty((semantic < 0.15) & (unit("keyword_coverage_ratio") < 0.5), 12.0)
        - penalty(num("title_present") < 1, 3.0) - penalty(num("meta_description_present") < 1, 2.0)
    )
    return rows.withColumn("extreme_score", rnd(clip(total, 0.0, 100.0), 1))


def label_extremes(scored: DataFrame, limit: int | None = None) -> DataFrame:
    """Best and worst page of every query; with a limit, the first labels in query order."""
    best = F.max(F.struct("extreme_score", (-F.col("rank")).alias("r"), "url"))
    worst = F.min(F.struct("extreme_score", F.col("rank").alias("r"), "url"))
    picked = scored.filter((F.trim("query") != "") & (F.trim("url") != "")).groupBy("query").agg(best.alias("best"), worst.alias("worst"))
    entry = lambda name, order: F.struct(F.lit(order).alias("place"), F.col(f"{name}.url").alias("url"), F.col(f"{name}.extreme_score").alias("score"))
    both = F.when(F.col("best.url") == F.col("worst.url"), F.array(entry("best", 1))).otherwise(F.array(entry("best", 1), entry("worst", 2)))
    rows = picked.select("query", F.explode(both).alias("e")).select("query", "e.place", "e.url", "e.score")
    return rows if limit is None else rows.orderBy("query", "place").limit(limit)
