"""Order statistics of unrounded values, exact for groups of any size and without a group in one task.

Values are counted map-side first. A group whose distinct values would be more
than a task's fair share is cut into ranges at splitters, so that one group is
many window partitions; counts of whole ranges then carry over. At most
``1 / SHARE`` groups can be that large, which bounds what is broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.session import kept, stored

OWN = 1 << 16
SHARE = 0.001
RANGES = 256
_STEP = 16


def _range_of(value: Column, splitters: Column) -> Column:
    """Number of splitters below the value, found in two steps of 16."""
    below = lambda part: F.size(F.filter(part, lambda s: s < value))
    coarse = below(F.transform(F.sequence(F.lit(1), F.lit(RANGES // _STEP - 1)), lambda i: F.get(splitters, i * _STEP - 1)))
    fine = lambda c: c * _STEP + below(F.slice(splitters, c * _STEP + 1, F.lit(_STEP - 1)))
    return F.get(F.transform(F.array(coarse), fine), F.lit(0))


def large_keys(rows: DataFrame, keys: Sequence[str], own: int = OWN) -> DataFrame | None:
    """Keys with more rows than one task should hold: more than ``own`` and than ``SHARE`` of all. None without any.

    At most ``1 / SHARE`` keys hold that share, so the driver asks for no more
    of the largest ones, and what is broadcast stays small whatever the input.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > own)
    found = sizes.orderBy(F.desc("_rows")).limit(int(1 / SHARE)).collect()
    if not found:
        return None
    limit = rows.count() * SHARE
    kinds = ", ".join(f"`{k}` {kind}" for k, kind in rows.select(*keys).dtypes)
    named = [tuple(r[k] for k in keys) for r in found if r["_rows"] > limit]
    return rows.sparkSession.createDataFrame(named, kinds) if named else None


def splitters_of(counts: DataFrame, keys: Sequence[str], large: DataFrame, value: str) -> DataFrame:
    """(keys, _splitters): for each of the few ``large`` groups a sorted array that cuts its rows into even ranges."""
    inside = counts.join(F.broadcast(large), list(keys), "left_semi")
    steps = [i / RANGES for i in range(1, RANGES)]
    found = inside.groupBy(*keys).agg(F.percentile_approx(value, steps, 20 * RANGES).alias("_splitters"))
    return counts.sparkSession.createDataFrame(found.collect(), found.schema)


def with_ranges(rows: DataFrame, keys: Sequence[str], value: str, splitters: DataFrame, name: str) -> DataFrame:
    """``rows`` with the number of the range their value lies in; 0 throughout groups that are not cut."""
    cut = rows.join(F.broadcast(splitters), list(keys), "left")
    return cut.withColumn(name, F.when(F.col("_splitters").isNull(), F.lit(0)).otherwise(_range_of(F.col(value), F.col("_splitters")))).drop("_splitters")


def ordered_counts(rows: DataFrame, keys: Sequence[str], value: str, own: int = OWN) -> DataFrame:
    """Distinct values per group: keys, value, n_equal, n_below (smaller ones), n_total. Values must not be null."""
    return order_counts(rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_equal")), keys, value, own)


def order_counts(counts: DataFrame, keys: Sequence[str], value: str, own: int = OWN) -> DataFrame:
    """``ordered_counts`` of values that are counted already (keys, value, n_equal).

    The counts are written once, as several steps read them.
    """
    counts, names = (counts, list(keys)) if keys else (counts.withColumn("_all", F.lit(0)), ["_all"])
    counts = kept(counts)
    large = large_keys(counts, names, own)
    running = lambda parts: Window.partitionBy(*parts).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if large is None:
        below = F.sum("n_equal").over(running(names)) - F.col("n_equal")
        return counts.select(*keys, value, "n_equal", below.alias("n_below"), F.sum("n_equal").over(Window.partitionBy(*names)).alias("n_total"))

    splitters = splitters_of(counts, names, large, value)
    placed = with_ranges(counts, names, value, splitters, "_range")
    # whole ranges, of the groups that are cut only: a few hundred rows for each of a bounded number of groups
    parts = placed.join(F.broadcast(large), names, "left_semi").groupBy(*names, "_range").agg(F.sum("n_equal").alias("_part"))
    group = Window.partitionBy(*names)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*names, "_range", F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_before"), F.sum("_part").over(group).alias("_whole"))
    inside = [*names, "_range"]
    local = placed.select(
        *inside, value, "n_equal", (F.sum("n_equal").over(running(inside)) - F.col("n_equal")).alias("_below"), F.sum("n_equal").over(Window.partitionBy(*inside)).alias("_here")
    )
    return local.join(F.broadcast(carried), inside, "left").select(
        *keys, value, "n_equal", (F.col("_below") + F.coalesce("_before", F.lit(0))).alias("n_below"), F.coalesce("_whole", "_here").alias("n_total"),
    )


def value_at(value: str, position: Column) -> Column:
    """Aggregate over ordered counts: the value at a 0-based sorted position."""
    return F.min(F.when(F.col("n_below") + F.col("n_equal") > position, F.col(value)))


def interpolated(value: str, fraction: float) -> Column:
    """Aggregate over ordered counts: the quantile between the two nearest positions, as exact percentiles interpolate."""
    place = (F.max("n_total") - 1) * F.lit(float(fraction))
    at = (F.col("n_total") - 1) * F.lit(float(fraction))
    low, high = value_at(value, F.floor(at)), value_at(value, F.ceil(at))
    share = place - F.floor(place)
    return F.when(low == high, low).otherwise(low + (high - low) * share)


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, fractions: Mapping[str, float], own: int = OWN) -> DataFrame:
    """Per group: the number of values and the named quantiles of values that are not null."""
    ordered = ordered_counts(rows.filter(F.col(value).isNotNull()), keys, value, own)
    return ordered.groupBy(*keys).agg(F.max("n_total").alias("n"), *[interpolated(value, f).alias(name) for name, f in fractions.items()])


def average_ranks(counts: DataFrame, keys: Sequence[str], value: str, name: str, own: int = OWN) -> DataFrame:
    """Rank of every distinct value of (keys, value, n_equal), ties sharing their mean rank, and n_total."""
    ranked = order_counts(counts, keys, value, own)
    return ranked.select(*keys, value, (F.col("n_below") + (F.col("n_equal") + 1) / 2.0).alias(name), "n_total")


# ---- the next marked position of a ring ------------------------------------------
def next_marked(rows: DataFrame, keys: Sequence[str], position: str, marked: str, name: str, block: int = 1 << 16) -> DataFrame:
    """keys, position and ``name``: the first marked position from the row's own on, going round at the end of the group.

    Positions count from 0 without gaps. Blocks of neighbouring positions look
    ahead inside themselves (``last_value`` that ignores nulls, from the end);
    what they do not find is the first marked position of a later block, one
    row per block. Null where a group has no marked row.
    """
    placed = rows.select(*keys, position, F.when(F.col(marked), F.col(position)).alias("_own"), F.floor(F.col(position) / block).alias("_block"))
    ahead = Window.partitionBy(*keys, "_block").orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = placed.withColumn("_next", F.last("_own", ignorenulls=True).over(ahead))
    blocks = placed.groupBy(*keys, "_block").agg(F.min("_own").alias("_first"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carried = blocks.select(*keys, "_block", F.coalesce(F.last("_first", ignorenulls=True).over(later), F.min("_first").over(whole)).alias("_carry"))
    same = reduce(lambda a, b: a & b, [F.col(f"i.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "_block"]])
    joined = inside.alias("i").join(carried.alias("c"), same)
    return joined.select(*[F.col(f"i.{k}").alias(k) for k in keys], position, F.coalesce("_next", "_carry").alias(name))


# ---- two-dimensional dominance ----------------------------------------------------
CELL_POINTS = 1 << 18


def dominated(points: DataFrame, keys: Sequence[str], first: str, second: str, margins: Mapping[str, int], own: int = OWN) -> DataFrame:
    """Per group and margin m: pairs (i, j) with first_i - first_j >= m and second_i > second_j, no pair being built.

    ``first`` holds whole numbers, ``second`` any; equal points are counted before the shuffle.
    For every margin a point asks how many points lie below (first - m,
    second). Groups are cut into ranges of both coordinates: pairs of different
    ranges in both are sums over the grid of range counts, pairs inside a range
    of ``first`` or of ``second`` are counted in that range's own cell. So a
    group of n points is shuffled twice, whatever its pairs. Without a large
    group every point is shuffled once and asks inside its task.
    """
    spark = points.sparkSession
    counted = stored(points.groupBy(*keys, first, second).agg(F.count(F.lit(1)).alias("_n")).withColumnsRenamed({first: "_x", second: "_y"}))
    large = large_keys(counted, keys, own)
    group = F.xxhash64(*keys)
    kinds = dict(points.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "_ask string, _hits long"])
    dealt = lambda cells: cells.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_cell").sortWithinPartitions("_cell", *keys)

    if large is None:
        cells = dealt(counted.select(*keys, "_x", "_y", "_n", group.alias("_cell")))
        found = cells.mapInArrow(_counted_cells(list(keys), dict(margins)), schema)
        return found.groupBy(*keys, F.col("_ask").alias("margin")).agg(F.sum("_hits").alias("hits"))

    # a point is data once, and asks once for each margin
    sides = F.array(
        F.struct(F.lit("").alias("ask"), F.col("_x").alias("x")), *[F.struct(F.lit(name).alias("ask"), (F.col("_x") - F.lit(m)).alias("x")) for name, m in margins.items()]
    )
    events = counted.select(*keys, "_y", "_n", F.explode(sides).alias("e")).select(*keys, F.col("e.ask").alias("_ask"), F.col("e.x").alias("_x"), "_y", "_n")

    def counted_cells(cells: DataFrame) -> DataFrame:
        return dealt(cells).select(*keys, "_cell", "_way", "_bx", "_ask", "_x", "_y", "_n").mapInArrow(_counted_cells(list(keys)), schema)

    placed = with_ranges(events, keys, "_x", splitters_of(counted, keys, large, "_x"), "_bx")
    placed = with_ranges(placed, keys, "_y", splitters_of(counted, keys, large, "_y"), "_by")
    # inside a range of x: all data of the same range; inside a range of y: data of earlier ranges of x
    first_way = placed.select("*", F.lit(0).alias("_way"), F.xxhash64(group, F.lit(0), "_bx").alias("_cell"))
    cut = F.broadcast(large)
    second_way = placed.join(cut, list(keys), "left_semi").filter((F.col("_bx") > 0) | (F.col("_ask") == "")).select("*", F.lit(1).alias("_way"), F.xxhash64(group, F.lit(1), "_by").alias("_cell"))
    found = counted_cells(first_way.unionByName(second_way))

    grid = placed.join(cut, list(keys), "left_semi").groupBy(*keys, "_bx", "_by", "_ask").agg(F.sum("_n").alias("_n")).filter((F.col("_bx") > 0) | (F.col("_ask") == ""))
    # a group's grid is at most RANGES squared sums, in one row
    crossing = grid.groupBy(*keys).agg(F.collect_list(F.struct("_bx", "_by", "_ask", "_n")).alias("_grid"))
    over = crossing.mapInArrow(_counted_grids(list(keys)), schema)
    return found.unionByName(over).groupBy(*keys, F.col("_ask").alias("margin")).agg(F.sum("_hits").alias("hits"))


def _counted_cells(keys: list[str], margins: dict[str, int] | None = None):
    """Pairs inside cells, for all cells of about ``CELL_POINTS`` points at once; a cell that spans batches is held together.

    With ``margins`` a cell holds the points of whole groups, which ask here;
    without, rows say what they ask.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401

        held = []
        most = CELL_POINTS // (1 + len(margins or ()))

        def counted(table):
            return _cell_hits(table, keys) if margins is None else _group_hits(table, keys, margins)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held.append(table)
            if sum(t.num_rows for t in held) < most:
                continue
            whole = pa.concat_tables(held).combine_chunks()
            cell = whole.column("_cell").to_numpy()
            last = int((cell != cell[-1]).sum())  # rows of one cell are neighbours: the last cell may go on
            if last:
                yield from counted(whole.slice(0, last)).to_batches()
            held = [whole.slice(last)]
        if held:
            yield from counted(pa.concat_tables(held).combine_chunks()).to_batches()

    return run


def _cell_hits(table, keys: list[str]):
    import numpy as np
    import pyarrow as pa

    # rows are sorted by cell and keys; groups whose cells share a hash stay apart
    cell, way = _run_numbers(table, ["_cell", *keys]), table.column("_way").to_numpy()
    x, y, n, bx = (table.column(c).to_numpy() for c in ("_x", "_y", "_n", "_bx"))
    ask = table.column("_ask").to_pandas().to_numpy(dtype=object)
    data = ask == ""
    # one order for all cells: inside a range of x by x, data before those that ask; inside a range of y by the range of x, those that ask first
    time = np.where(way == 0, x, bx)
    turn = np.where(way == 0, ~data, data)
    hits = below_counts(cell, time, turn, y, np.where(data, n, 0)) * np.where(data, 0, n)
    rows = np.flatnonzero(~data & (hits > 0))
    columns = [table.column(k).take(pa.array(rows)) for k in keys]
    out = pa.table([*columns, pa.array(ask[rows], pa.string()), pa.array(hits[rows], pa.int64())], [*keys, "_ask", "_hits"])
    return out.group_by([*keys, "_ask"]).aggregate([("_hits", "sum")]).rename_columns([*keys, "_ask", "_hits"]).combine_chunks()


def _group_hits(table, keys: list[str], margins: dict[str, int]):
    import numpy as np
    import pyarrow as pa

    group = _run_numbers(table, ["_cell", *keys])
    size = len(group)
    x, y, n = (table.column(c).to_numpy() for c in ("_x", "_y", "_n"))
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    # data and those that ask for all margins in one order; data come before those that ask at the same place
    asked = [x, *(x - m for m in margins.values())]
    turn = np.repeat([False] + [True] * len(margins), size)
    every = lambda v: np.tile(v, len(asked))
    below = below_counts(every(group), np.concatenate(asked), turn, every(y), np.where(turn, 0, every(n)))
    sums = [np.add.reduceat(below[k * size : (k + 1) * size] * n, first) for k in range(1, len(asked))]
    columns = [pa.concat_arrays([table.column(k).combine_chunks().take(pa.array(first))] * len(sums)) for k in keys]
    out = pa.table([*columns, pa.array(np.repeat(list(margins), len(first)), pa.string()), pa.array(np.concatenate(sums), pa.int64())], [*keys, "_ask", "_hits"])
    return out.filter(pa.compute.greater(out.column("_hits"), 0)).combine_chunks()


def _run_numbers(table, names: list[str]):
    """0, 1, ... for runs of neighbouring rows that are equal in all the named columns."""
    import numpy as np

    turns = np.zeros(table.num_rows, bool)
    for name in names:
        codes = table.column(name).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        turns[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(turns)


def below_counts(cell, time, turn, y, weight):
    """For every row: the weight of rows of its cell that stand earlier (by time, then turn) and have a smaller y.

    One pass over the bits of the rank of y, from the highest: rows that share
    the higher bits stay together in their order of time, and those with bit 1
    take the weight of the earlier ones with bit 0.
    """
    import numpy as np

    size = len(cell)
    if not size:
        return np.zeros(0, np.int64)
    order = np.lexsort((turn, time, cell))
    by_value = np.lexsort((y, cell))
    changed = (cell[by_value][1:] != cell[by_value][:-1]) | (y[by_value][1:] != y[by_value][:-1])
    rank = np.empty(size, np.int64)
    rank[by_value] = np.concatenate([[0], np.cumsum(changed)])
    start = np.concatenate([[True], cell[by_value][1:] != cell[by_value][:-1]])
    lowest = np.empty(size, np.int64)
    lowest[by_value] = np.maximum.accumulate(np.where(start, rank[by_value], 0))
    number = np.empty(size, np.int64)
    number[by_value] = np.cumsum(start) - 1
    rank, group, held = (rank - lowest)[order], number[order], weight[order].astype(np.int64)
    total = np.zeros(size, np.int64)
    at = np.arange(size)
    # rows start in order of cell and time; every pass splits each run by the next bit, zeros first, and keeps the order inside
    for bit in range(max(1, int(rank.max()).bit_length()) - 1, -1, -1):
        one = rank[at] >> bit & 1
        run = group[at]
        zeros = np.where(one == 0, held[at], 0)
        before = np.cumsum(zeros) - zeros
        first = np.concatenate([[True], run[1:] != run[:-1]])
        base = np.maximum.accumulate(np.where(first, np.arange(size), 0))
        total[at] += np.where(one == 1, before - before[base], 0)
        key = run * 2 + one
        at = at[np.argsort(key, kind="stable")]
        group = group * 2 + (rank >> bit & 1)
    out = np.empty(size, np.int64)
    out[order] = total
    return out


def _counted_grids(keys: list[str]):
    """Pairs of different ranges in both coordinates, from the grid of range counts of a group."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                columns: dict[int, list] = {}
                for entry in batch.column("_grid")[i].as_py():
                    columns.setdefault(entry["_bx"], []).append(entry)
                below = np.zeros(RANGES, np.int64)
                hits: dict[str, int] = {}
                for bx in sorted(columns):
                    smaller = np.cumsum(below) - below
                    for entry in columns[bx]:
                        if entry["_ask"]:
                            hits[entry["_ask"]] = hits.get(entry["_ask"], 0) + entry["_n"] * int(smaller[entry["_by"]])
                        else:
                            below[entry["_by"]] += entry["_n"]
                if hits:
                    own = [batch.column(k).take(pa.array([i] * len(hits))) for k in keys]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(list(hits)), pa.array(list(hits.values()), pa.int64())], [*keys, "_ask", "_hits"])

    return run
