"""Hard negatives: pages of other categories as rows of a seed's query, with features measured against that query."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.numeric import numbered_by_hash
from rankloom.functions.order import next_marked
from rankloom.operators import page_features as pf
from rankloom.session import kept

# --- fixed values -----------------------------------------------------------
POLICY_VERSION = "dataset-v7-hard-negatives-v1"
LABEL_SOURCE = "hard_negative_v7"
NEGATIVE_RANK, NEGATIVE_PAGE = 999, -1
LABEL_COLUMNS = ("weak_target_score", "expert_target_score", "target_score")
SEED_COLUMNS = ("query", "category", "intent", "city", "region_code")
# --- end of fixed values ----------------------------------------------------


def listed_categories(rows: DataFrame, usable: Column) -> DataFrame:
    """One row per category: its rows, its number in name order and its number among those with a usable row.

    The numbering is a window over the distinct categories only.
    """
    counts = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(usable).alias("usable_rows"))
    order = Window.orderBy("category")
    some = F.when(F.col("usable_rows") > 0, 1).otherwise(0)
    return counts.select(
        "category", "n", (F.row_number().over(order) - 1).alias("number"), (some == 1).alias("filled"),
        (F.sum(some).over(order) - some).alias("filled_before"),
    )


def draws(rows: DataFrame, seeds: DataFrame, usable: Column, k: int = 2) -> DataFrame:
    """(seed columns as ``seed_*``, draw, category, position): where each seed's k negatives are looked for.

    Seed number i starts at category i * k of the others, in name order and
    going round, and takes one row of each category from there on that has a
    usable one; draw d looks from row i + d of its category on. Seeds without
    a query have none, seeds of one query count once.
    """
    named = seeds.filter(F.trim("query") != "").groupBy("query").agg(F.min(F.struct(*[F.col(c) for c in SEED_COLUMNS if c in seeds.columns])).alias("s")).select("s.*")
    categories = listed_categories(rows, usable)
    totals = categories.groupBy().agg(F.count(F.lit(1)).alias("total"), F.count_if("filled").alias("total_filled"))
    numbered = numbered_by_hash(named.withColumn("_h", F.md5("query")), [], "_h", "seed_no").drop("_h")
    seeded = numbered.select("seed_no", *[F.col(c).alias(f"seed_{c}") for c in named.columns])
    own = categories.select(
        F.col("category").alias("seed_category"), F.col("number").alias("own"), F.col("filled").cast("int").alias("own_filled"), F.col("filled_before").alias("own_before"),
    )
    # without its own category the seed's ring has these many places, filled ones among them
    ring = (
        seeded.withColumn("seed_category", F.trim("seed_category")).join(own, "seed_category", "left").join(F.broadcast(totals), F.lit(True)).na.fill(0, ["own_filled"])
        .withColumn("others", F.col("total") - F.col("own").isNotNull().cast("int")).withColumn("choices", F.col("total_filled") - F.col("own_filled")).filter("choices > 0")
    )
    place = F.pmod(F.col("seed_no") * k, F.col("others"))
    starts = ring.withColumn("start", F.when(F.col("own").isNull() | (place < F.col("own")), place).otherwise(place + 1))
    before = categories.select(F.col("number").alias("start"), F.col("filled_before").alias("start_before"))
    skipped = F.when((F.col("own_filled") == 1) & (F.col("own") < F.col("start")), 1).otherwise(0)
    turn = F.pmod(F.col("start_before") - skipped + F.col("draw"), F.col("choices"))
    filled = categories.filter("filled").select(F.col("filled_before").alias("choice"), "category", "n")
    return (
        starts.join(before, "start").withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(k), F.col("choices")) - 1)))
        .withColumn("choice", F.when((F.col("own_filled") == 0) | (turn < F.col("own_before")), turn).otherwise(turn + 1)).join(filled, "choice")
        .select(*[c for c in seeded.columns if c != "seed_no"], "draw", "category", F.pmod(F.col("seed_no") + F.col("draw"), F.col("n")).alias("position"))
    )


def drawn_rows(rows: DataFrame, seeds: DataFrame, usable: Column, k: int = 2) -> DataFrame:
    """``rows`` that are drawn, once for each draw, with ``seed_*`` and ``draw``.

    Rows of a category are numbered by the hash of query and url without a
    sort of the whole category. An unusable row hands over to the next usable
    one of its category, going round. All this sees the key columns only, which
    are written once; the rows themselves are joined at the end.
    """
    named = rows.withColumn("category", F.trim("category")).filter(F.col("category") != "")
    slim = kept(named.select("query", "url", "category", F.coalesce(usable, F.lit(False)).alias("_usable")))
    numbered = numbered_by_hash(slim.withColumn("_h", F.md5(F.concat_ws("|", "query", "url"))), ["category"], "_h", "position").drop("_h")
    wanted = draws(slim, seeds, F.col("_usable"), k)
    successors = next_marked(numbered, ["category"], "position", "_usable", "found")
    placed = wanted.join(successors, ["category", "position"]).drop("position").withColumnRenamed("found", "position")
    picks = numbered.filter("_usable").drop("_usable").join(placed, ["category", "position"]).drop("position")
    return named.join(picks, ["query", "url", "category"])


def hard_negatives(
    rows: DataFrame, seeds: DataFrame, snapshots: DataFrame, features: Sequence[str], k: int = 2, key: str = "artifact_id",
    measure: Callable[[DataFrame], DataFrame] = pf.audit_features,
) -> DataFrame:
    """``rows`` and, for each seed, up to k pages of other categories as rows of its query.

    A row is usable if its ``key`` has a snapshot. A negative keeps its page
    and takes query, category, intent, city and region from the seed; labels
    are emptied, rank and result page say that it was never ranked, and
    ``features`` are measured again on the snapshot against the new query
    (``measure``: rows of query and snapshot to rows with features). Rows are
    taken to be unique by query and url.
    """
    known = snapshots.select(F.col(key).alias("_key")).distinct().withColumn("_known", F.lit(True))
    marked = rows.join(known, F.col(key) == F.col("_key"), "left").drop("_key")
    found = drawn_rows(marked, seeds, F.col("_known"), k).drop("_known")

    # a page is measured once for each query it is drawn for
    asked = found.select(F.col("seed_query").alias("query"), F.col(key).alias("page_key")).distinct()
    pages = snapshots.withColumnRenamed(key, "page_key").drop("query")
    measured = measure(asked.join(pages, "page_key")).select(F.col("query").alias("seed_query"), F.col("page_key").alias(key), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"_new_{f}") for f in features])

    replaced = {c: F.coalesce(F.col(f"seed_{c}"), F.lit("")) if c in ("intent", "city", "region_code") else F.col(f"seed_{c}") for c in SEED_COLUMNS if f"seed_{c}" in found.columns}
    fixed = {"rank": F.lit(NEGATIVE_RANK), "serp_page": F.lit(NEGATIVE_PAGE), "label_source": F.lit(LABEL_SOURCE), **{c: F.lit(None) for c in LABEL_COLUMNS}}
    fresh = {f: F.col(f"_new_{f}") for f in features}
    kinds = dict(rows.dtypes)

    def column(name: str) -> Column:
        value = {**fixed, **replaced, **fresh}.get(name)
        return F.col(name) if value is None else value.cast(kinds[name]).alias(name)

    policy = lambda hard, version, query, category, url: [
        F.lit(hard).alias("hard_negative"), version.alias("hard_negative_policy_version"), query.alias("hard_negative_source_query"),
        category.alias("hard_negative_source_category"), url.alias("hard_negative_source_url"),
    ]
    negatives = found.join(measured, ["seed_query", key]).select(
        *[column(c) for c in rows.columns], *policy(1, F.lit(POLICY_VERSION), F.col("query"), F.col("category"), F.col("url")),
    )
    empty = F.lit("")
    return rows.select("*", *policy(0, empty, empty, empty, empty)).unionByName(negatives)


def hard_negative_report(dataset: DataFrame) -> DataFrame:
    """How many rows were added per source and per target category, and the totals; one row per (kind, category)."""
    added = dataset.filter("hard_negative = 1")
    per = lambda kind, name: added.groupBy(F.lit(kind).alias("kind"), F.col(name).alias("category")).agg(F.count(F.lit(1)).alias("rows"))
    total = dataset.groupBy(F.when(F.col("hard_negative") == 1, "hard_negative_rows").otherwise("source_rows").alias("kind"), F.lit("").alias("category")).agg(F.count(F.lit(1)).alias("rows"))
    return total.unionByName(per("source_category", "hard_negative_source_category")).unionByName(per("target_category", "category"))
