"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target size. A source whose target is r times its size
gives floor(r) whole copies of each of its documents for certain; the rest is
a sample without replacement. For it every document draws a uniform number u
and has an inclusion probability p; documents are taken in ascending order of
the Pareto ranking variable (u / (1 - u)) / (p / (1 - p)) until the rest of
the target is filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import WORD, cut, row_hash

_BINS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: float, source: str = "source") -> DataFrame:
    """One row per source: source_size, target.

    ``sizes`` has one row per source with its ``source_size``. Sources in
    ascending order of code points, null last, take the weights in turn. The
    sum of all sizes is shared by weight; a target stops at ``most`` times its
    source's size, and what is cut off goes to the others by weight until no
    target is above. A source of size 0 has target 0; with ``most`` of at
    least 1 the whole sum always finds a place.

    The table of sources is a dimension: one row per source, whose capping
    order (by weight over size) is worked out on prefix sums in one step. For
    a cap set of the sources with the smallest ``most * size / weight``, the
    level of the others is the uncapped rest over their weights; the right set
    is the shortest for which no other source is above its cap.
    """
    order = Window.orderBy(F.col(source).asc_nulls_last())
    numbered = sizes.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col(source).asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    levels = (
        numbered.withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    )
    # the first source, in order of its ratio, that is not above its cap sets the level
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"]
    return levels.withColumn("level", level).select(
        source, "source_size", F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))).alias("target")
    )


def pareto_mix(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    most: float = 3.0,
    seed: int = 17,
    size: Column | None = None,
    importance: Column | None = None,
    content: Column | None = None,
) -> DataFrame:
    """One row per document: its columns ``doc_id``, ``source`` and size, source_size, target, copies, taken, rank_value, content.

    ``size`` defaults to the number of words of ``text``. ``importance``
    (positive, default: the same for all) makes inclusion probabilities
    unequal: p is the source's open fraction times importance over its size-weighted mean,
    1 at most.

    * Null or empty text: size 0, never in the sample, taken 0.
    * Null source: a source of its own, the last one.
    * Equal rows draw the same u; which of them the cut keeps does not matter.
    * Empty table: no rows. Extra columns are ignored.
    * Words taken miss a target by half a document's size at most, plus what whole
      copies of one document cannot split.

    The slim table (no text) is written once. Each source's cut is found by
    radix steps over the ranking variable: sums per (source, bin), the bin
    that holds the cut, bins inside it, and only those rows are ordered. So a
    source with a third of all rows is never in one task.
    """
    measured = size if size is not None else word_count(F.col("text"))
    wanted = importance if importance is not None else F.lit(1.0)
    slim = cut(
        docs.select("doc_id", "source", measured.alias("size"), wanted.cast("double").alias("importance"), (content if content is not None else row_hash("doc_id", "text", "source")).alias("content"))
    )
    by_source = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("importance")).alias("mass"))
    shares = source_targets(by_source.select("source", "source_size"), weights, most)
    plan = cut(
        shares.alias("a")
        .join(by_source.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
        .select("a.source", "a.source_size", "a.target", "b.mass")
        .withColumn("ratio", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0))
        # a fraction within rounding of a whole number is that number
        .withColumn("whole", F.floor(F.col("ratio") + F.lit(1e-9)).cast("long"))
        .withColumn("open", F.greatest(F.lit(0.0), F.col("ratio") - F.col("whole")))
        .withColumn("want", F.col("open") * F.col("source_size"))
    )
    # 52 bits of a hash, moved off both ends
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col("content")), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    chance = F.least(F.lit(1.0), F.col("open") * F.col("importance") * F.col("source_size") / F.col("mass"))
    odds = F.col("u") / (1.0 - F.col("u"))
    ranked = (
        slim.alias("d")
        .join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
        .select("d.*", "p.source_size", "p.target", "p.whole", "p.open", "p.want", "p.mass")
        .withColumn("u", uniform)
        .withColumn("chance", F.when((F.col("size") > 0) & (F.col("want") > 0), chance))
        .withColumn("rank_value", F.when(F.col("chance") >= 1.0, F.lit(0.0)).otherwise(odds * (1.0 - F.col("chance")) / F.col("chance")))
        # the same order on (0, 1), where bins of equal width make sense
        .withColumn("place", F.col("rank_value") / (1.0 + F.col("rank_value")))
        .withColumn("bin", F.least(F.floor(F.col("place") * _BINS), F.lit(_BINS - 1)).cast("int"))
        .withColumn("fine", F.least(F.floor((F.col("place") * _BINS - F.col("bin")) * _BINS), F.lit(_BINS - 1)).cast("int"))
    )
    coarse = _cut_bin(ranked.filter(F.col("chance").isNotNull()), "bin", F.col("want"), [])
    inside = _join_cut(ranked, coarse, "bin")
    finer = _cut_bin(inside.filter(F.col("side") == 0), "fine", F.col("left"), ["left"])
    settled = _join_cut(inside, finer, "fine", held="side")
    order = Window.partitionBy("source").orderBy("rank_value", "content", "doc_id")
    last = (
        settled.filter(F.col("side") == 0)
        .withColumn("before", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("extra", (F.col("before") + F.col("size") / 2.0 <= F.col("left")).cast("long"))
        .drop("before")
    )
    rest = settled.filter(F.col("side") != 0).withColumn("extra", (F.col("side") < 0).cast("long"))
    return (
        last.unionByName(rest)
        .withColumn("copies", F.col("whole") + F.col("extra"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "rank_value", "content")
    )


def _cut_bin(rows: DataFrame, bin_column: str, want: Column, carried: list[str]) -> DataFrame:
    """One row per source: the bin in which the running size passes what is wanted, and what is left for that bin."""
    sums = rows.withColumn("aim", want).groupBy("source", bin_column).agg(F.sum("size").alias("mass_here"), F.max("aim").alias("aim"))
    run = Window.partitionBy("source").orderBy(bin_column)
    return (
        sums.withColumn("upto", F.sum("mass_here").over(run))
        .filter(F.col("upto") > F.col("aim"))
        .groupBy("source")
        .agg(F.min_by(F.struct(F.col(bin_column).alias("at"), (F.col("aim") - F.col("upto") + F.col("mass_here")).alias("left")), bin_column).alias("cut"))
        .select(F.col("source").alias("cut_source"), F.col("cut.at").alias("at"), F.col("cut.left").alias("still"))
    )


def _join_cut(rows: DataFrame, cuts: DataFrame, bin_column: str, held: str | None = None) -> DataFrame:
    """side: -1 taken, 0 in the bin of the cut, 1 not taken; left: size wanted from that bin."""
    joined = rows.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left")
    # without a bin of the cut, all that can be drawn is wanted
    side = F.when(F.col("chance").isNull(), 1).when(F.col("at").isNull(), -1).otherwise(F.signum(F.col(bin_column) - F.col("at")))
    if held:
        side = F.when(F.col(held) != 0, F.col(held)).otherwise(side)
        left = F.when((F.col(held) == 0) & F.col("still").isNotNull(), F.col("still")).otherwise(F.col("left"))
    else:
        left = F.col("still")
    return joined.withColumn("new_side", side.cast("int")).withColumn("new_left", left).drop("at", "still", "cut_source", *[c for c in ("side", "left") if c in rows.columns]).withColumnsRenamed({"new_side": "side", "new_left": "left"})


def mixed_copies(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: every document of ``docs`` as often as the mix takes it, columns as they came.

    Rows are told apart by content; of equal rows as many copies come out as
    the mix gave them together.
    """
    named = docs.withColumn("_content", row_hash("doc_id", "text", "source"))
    counts = pareto_mix(named, content=F.col("_content"), **options).groupBy("content").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    order = F.xxhash64("_content")
    joined = named.join(counts.withColumnRenamed("content", "_content"), "_content")
    # equal rows share their copies evenly; the remainder goes to the first of them
    numbered = joined.filter(F.col("_rows") == 1).withColumn("_n", F.col("_copies"))
    repeated = (
        joined.filter(F.col("_rows") > 1)
        .withColumn("_k", F.row_number().over(Window.partitionBy("_content").orderBy(order)))
        .withColumn("_n", (F.col("_copies") / F.col("_rows")).cast("long") + (F.col("_k") <= F.col("_copies") % F.col("_rows")).cast("long"))
        .drop("_k")
    )
    return (
        numbered.unionByName(repeated)
        .withColumn("_copy", F.explode(F.when(F.col("_n") > 0, F.sequence(F.lit(1).cast("long"), F.col("_n"))).otherwise(F.array().cast("array<bigint>"))))
        .select(*docs.columns)
    )
